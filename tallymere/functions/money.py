"""Money: tolerant comparison, parsing printed amounts, redacting card numbers."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WHITE_CLASS, strip

MONEY = "decimal(14,4)"

# Symbols that may stand around an amount, and languages that write decimals with a comma.
CURRENCY_SYMBOLS = "$€£¥₱₩₹¢₪₫₴₦฿"
COMMA_LANGUAGES = ("de", "fr", "es", "it", "nl", "pt", "pl", "ru", "sv", "da", "fi", "nb", "nn", "no", "cs", "hu", "tr", "el", "ro", "bg", "hr", "sk", "sl", "uk", "et", "lv", "lt", "ca", "is", "sr", "vi", "id", "af")

# Digit groups of card numbers; the separator between groups is one or two of space . - _ / ,
_SEP = r"[ .\-_/,]{1,2}"
_SHAPES = (
    rf"\d{{4}}(?:{_SEP}\d{{4}}){{2}}{_SEP}\d{{1,7}}",
    rf"\d{{4}}{_SEP}\d{{6}}{_SEP}\d{{5}}",
    rf"\d{{4}}{_SEP}\d{{6}}{_SEP}\d{{4}}",
    rf"\d{{4}}{_SEP}\d{{4}}{_SEP}\d{{5}}",
    rf"\d{{5}}(?:{_SEP}\d{{4}}){{3}}",
    rf"\d{{6}}(?:{_SEP}\d{{4}}){{3}}",
    rf"\d{{4}}{_SEP}\d{{5}}(?:{_SEP}\d{{4}}){{2}}",
    r"\d{13,19}(?!\.\d)",
)
CARD_NUMBER = r"(?<!\d)(?<!\d\.)(?:" + "|".join(_SHAPES) + r")(?!\d)"


def dec(x) -> Column:
    """A literal of exact decimal type."""
    return F.lit(Decimal(str(x)))


def within(a: Column, b: Column, rel: str = "0.0002", floor: Column | str = "0.02") -> Column:
    """Whether a and b agree to max(floor, rel * max(|a|, |b|)); false if either is missing."""
    least = floor if isinstance(floor, Column) else dec(floor)
    return F.coalesce(F.abs(a - b) <= F.greatest(least, dec(rel) * F.greatest(F.abs(a), F.abs(b))), F.lit(False))


def agree(a: Column, b: Column, rel: str = "0.0002", floor: str = "0.02") -> Column:
    """`within`, and two missing values agree."""
    return (a.isNull() & b.isNull()) | within(a, b, rel, floor)


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def last4(text: Column) -> Column:
    return F.nullif(F.right(digits(text), F.lit(4)), F.lit(""))


def parse_money(text: Column, convention: Column | str = "point") -> Column:
    """decimal(28,8) or null: symbols, spaces, one sign and brackets go; anything else than digits and separators refuses."""
    convention = F.lit(convention) if isinstance(convention, str) else convention
    s = strip(text)
    bracketed = F.startswith(s, F.lit("(")) & F.endswith(s, F.lit(")"))
    s = F.when(bracketed, F.substring(s, 2, F.greatest(F.length(s) - 2, F.lit(0)))).otherwise(s)
    s = F.regexp_replace(F.regexp_replace(s, f"[{CURRENCY_SYMBOLS}]", ""), f"[{WHITE_CLASS}]+", "")
    lead, tail = F.regexp_extract(s, r"^([+-])", 1), F.regexp_extract(s, r"^[^+-].*([+-])$", 1)
    negative = bracketed | (lead == "-") | (tail == "-")
    s = F.when(lead != "", F.substring(s, F.lit(2), F.length(s))).when(tail != "", F.substring(s, F.lit(1), F.length(s) - 1)).otherwise(s)
    plain = F.when(convention == "comma", F.replace(F.replace(s, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(F.replace(s, F.lit(","), F.lit("")))
    ok = ~F.regexp_like(s, F.lit(r"[^\d.,]")) & F.regexp_like(plain, F.lit(r"^(\d+\.?\d*|\.\d+)$"))
    value = F.when(ok, plain.try_cast("decimal(28,8)"))
    return F.when(negative, -value).otherwise(value).cast("decimal(28,8)")


def convention_vote(sample: Column) -> Column:
    """1 for a decimal point, -1 for a decimal comma, 0 if the sample's shape doesn't tell."""
    s = strip(F.coalesce(sample, F.lit("")))
    dot, comma = F.length(s) - F.instr(F.reverse(s), "."), F.length(s) - F.instr(F.reverse(s), ",")
    has_dot, has_comma = F.contains(s, F.lit(".")), F.contains(s, F.lit(","))
    after = F.length(digits(F.substring_index(F.replace(s, F.lit(","), F.lit(".")), ".", -1)))
    once = F.length(s) - F.length(F.translate(s, ".,", "")) == 1
    return F.when(has_dot & has_comma, F.when(comma > dot, -1).otherwise(1)).when(~has_dot & ~has_comma, 0).when((after == 3) & once, 0).when(has_dot, 1).otherwise(-1)


def convention_from_votes(votes: Column, locale: Column | None = None) -> Column:
    """From the sum of votes; a tie goes to the locale's language, else to the point."""
    tie = F.lit("point") if locale is None else F.when(F.regexp_extract(F.lower(strip(locale)), "^([^-_]*)", 1).isin(*COMMA_LANGUAGES), "comma").otherwise("point")
    return F.when(votes > 0, "point").when(votes < 0, "comma").otherwise(tie)


def redact_cards(text: Column) -> Column:
    """Card-shaped numbers as stars and their last four digits; everything else as it was."""
    between, found = F.split(text, CARD_NUMBER, -1), F.regexp_extract_all(text, F.lit(CARD_NUMBER), F.lit(0))
    masked = F.transform(found, lambda x: F.concat(F.repeat(F.lit("*"), F.length(digits(x)) - 4), F.right(digits(x), F.lit(4))))
    return F.array_join(F.zip_with(between, masked, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")


def money_text(value: Column) -> Column:
    """Whole amounts without decimals, others with two or as many as they need; a missing one as the word null."""
    text = value.cast("decimal(28,8)").cast("string")
    return F.when(value.isNull(), "null").when(value == F.floor(value), F.floor(value).cast("decimal(28,0)").cast("string")).otherwise(F.regexp_replace(text, r"(?<=\.\d{2})(\d*?)0+$", "$1"))


def quantized(value: Column, places: int = 2) -> Column:
    """Rounded half up, for showing only: a rounded value must not be checked against others."""
    return F.round(value, places)

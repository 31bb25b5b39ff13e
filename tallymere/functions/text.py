"""Text: cleaning, names, currencies, descriptions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# ISO 4217 codes that are accepted on a document.
ISO_CURRENCIES = tuple("""
AED AFN ALL AMD ANG AOA ARS AUD AWG AZN BAM BBD BDT BGN BHD BIF BMD BND BOB BRL BSD BTN BWP BYN BZD CAD CDF CHF CLP CNY
COP CRC CUP CVE CZK DJF DKK DOP DZD EGP ERN ETB EUR FJD FKP GBP GEL GHS GIP GMD GNF GTQ GYD HKD HNL HRK HTG HUF IDR ILS
INR IQD IRR ISK JMD JOD JPY KES KGS KHR KMF KRW KWD KYD KZT LAK LBP LKR LRD LSL LYD MAD MDL MGA MKD MMK MNT MOP MRU MUR
MVR MWK MXN MYR MZN NAD NGN NIO NOK NPR NZD OMR PAB PEN PGK PHP PKR PLN PYG QAR RON RSD RUB RWF SAR SBD SCR SDG SEK SGD
SHP SLE SOS SRD SSP STN SVC SYP SZL THB TJS TMT TND TOP TRY TTD TWD TZS UAH UGX USD UYU UZS VED VES VND VUV WST XAF XCD
XOF XPF YER ZAR ZMW ZWL""".split())
# Legal forms and branch words that a merchant's key leaves out.
LEGAL_FORMS = ("inc", "co", "ltd", "corp", "llc", "plc", "gmbh", "ag", "sa", "bv", "pte", "pty", "srl", "nv", "kg", "oy", "ab", "as", "spa", "limited", "incorporated", "corporation", "company")
BRANCH_WORDS = ("branch", "store", "br", "outlet", "loc", "location")

# What counts as white space, ASCII and beyond.
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
WHITE_CLASS = r"\x09-\x0d\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def _python(name: str, change: Callable[[str], str], of: str = "string"):
    """A Pandas UDF of one string, or of an array of strings."""
    one = lambda x: None if x is None else change(x)
    each = one if of == "string" else lambda xs: None if xs is None else [one(x) for x in xs]

    def run(s: pd.Series) -> pd.Series:
        return s.map(each)

    run.__name__ = name
    return F.pandas_udf(run, of)


def fold(text: str) -> str:
    return unicodedata.normalize("NFKC", text).casefold()


@cache
def _udf(name: str):
    normal = lambda x: unicodedata.normalize("NFKC", x)
    return {
        "nfkc": lambda: _python("nfkc", normal), "nfkc_each": lambda: _python("nfkc_each", normal, "array<string>"),
        "casefold": lambda: _python("casefold", str.casefold), "casefold_each": lambda: _python("casefold_each", str.casefold, "array<string>"), "fold": lambda: _python("fold", fold),
    }[name]()


def beyond_ascii(text: Column) -> Column:
    return F.octet_length(text) != F.char_length(text)


def _where_needed(name: str, text: Column, plain: Column) -> Column:
    """Python only gets the texts that aren't ASCII (null stands for the others); `plain` is the same for ASCII."""
    return F.coalesce(_udf(name)(F.when(beyond_ascii(text), text)), plain)


def nfkc(text: Column) -> Column:
    """Unicode NFKC. ASCII is its own NFKC."""
    return _where_needed("nfkc", text, text)


def nfkc_each(texts: Column) -> Column:
    """NFKC of an array's strings, for use in column functions over arrays, where no Python can run."""
    return F.coalesce(_udf("nfkc_each")(F.when(F.exists(texts, beyond_ascii), texts)), texts)


def casefold(text: Column) -> Column:
    return _where_needed("casefold", text, F.lower(text))


def strip(text: Column) -> Column:
    """Without white space at both ends, beyond ASCII too."""
    return F.btrim(text, F.lit(WHITE))


def blank(text: Column) -> Column:
    """Missing, empty or nothing but white space."""
    return strip(F.coalesce(text, F.lit(""))) == ""


def collapse(text: Column) -> Column:
    return strip(F.regexp_replace(text, f"[{WHITE_CLASS}]+", " "))


def _clean(text: Column) -> Column:
    return collapse(F.regexp_replace(text, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]", " "))


def clean_text(text: Column) -> Column:
    """NFKC, control characters to spaces, white space collapsed."""
    return _clean(nfkc(text))


def clean_texts(texts: Column) -> Column:
    """clean_text of an array's strings."""
    return F.transform(nfkc_each(texts), _clean)


def merchant_key(name: Column | str | None) -> Column:
    """The lossy name by which documents of one merchant meet: no case, punctuation, legal form or branch number. A plain
    string is a constant, folded here and not in a task."""
    if isinstance(name, Column):
        name = F.coalesce(name, F.lit(""))
        folded = _where_needed("fold", name, F.lower(name))
    else:
        folded = F.lit(fold(name or ""))
    s = F.regexp_replace(F.regexp_replace(_clean(folded), r"#\s*\d+", " "), rf"[^\p{{L}}\p{{N}}\p{{M}}_{WHITE_CLASS}]", " ")
    words = F.filter(F.split(strip(s), f"[{WHITE_CLASS}]+"), lambda w: (w != "") & ~w.isin(*LEGAL_FORMS))
    return collapse(F.regexp_replace(F.array_join(words, " "), r"(?<!\S)(?:" + "|".join(BRANCH_WORDS) + r")(?!\S)(?: \d+(?!\S))?", " "))


def norm_text(text: Column) -> Column:
    """For comparing transcriptions: trimmed, white space collapsed, case folded."""
    return casefold(collapse(text))


def norm_texts(texts: Column) -> Column:
    """norm_text of an array's strings; Python sees arrays that have other than ASCII."""
    plain = F.transform(texts, collapse)
    return F.coalesce(_udf("casefold_each")(F.when(F.exists(plain, beyond_ascii), plain)), F.transform(plain, F.lower))


def iso_currency(code: Column) -> Column:
    c = F.upper(strip(code))
    return F.when(c.isin(*ISO_CURRENCIES), c)


def currency_chain(printed: Column, merchant: Column, system: Column) -> Column:
    """The first ISO code of what is printed, the merchant's default and the system's; symbols are never guessed."""
    return F.coalesce(iso_currency(printed), iso_currency(merchant), iso_currency(system))


def plain_description(text: Column) -> Column:
    """normal_description of a text that is in NFKC already."""
    s = F.regexp_replace(F.upper(F.coalesce(text, F.lit(""))), rf"[{WHITE_CLASS}:.\-]*[-+]?[\d,]+(?:[.,]\d+)?[{WHITE_CLASS}]*$", "")
    return collapse(F.regexp_replace(s, r"[^A-Z0-9 ]+", " "))


def normal_description(text: Column) -> Column:
    """Capitals without a trailing amount or punctuation, for exact comparison with summary-row words."""
    return plain_description(nfkc(text))


def shorten(text: Column, n: int = 400) -> Column:
    return F.when(F.char_length(text) > n, F.concat(F.left(text, F.lit(n - 1)), F.lit("…"))).otherwise(text)

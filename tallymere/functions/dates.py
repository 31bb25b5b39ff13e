"""Dates and times as they are printed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

_ISO = r"^(?:\d{4}-\d{2}-\d{2}|\d{8})$"


#: A year, a week and perhaps a day of it, with or without dashes.
_WEEK = r"^(\d{4})(?:-W(\d{2})(?:-(\d))?|W(\d{2})(\d)?)$"


def _week_date(s: Column) -> Column:
    """The day of an ISO week: the first week has 4 January in it, weeks begin on Monday; a week that the year lacks is none."""
    part = lambda k: F.nullif(F.regexp_extract(s, _WEEK, k), F.lit("")).try_cast("int")
    week, day = F.coalesce(part(2), part(4)), F.coalesce(part(3), part(5), F.lit(1))
    first = F.trunc(F.try_to_date(F.concat(F.regexp_extract(s, _WEEK, 1), F.lit("-01-04")), "yyyy-MM-dd"), "week")
    found = F.date_add(first, (week - 1) * 7 + day - 1)
    return F.when((week >= 1) & day.between(1, 7) & (F.weekofyear(found) == week), found)


def strict_iso(text: Column) -> Column:
    """A calendar date written YYYY-MM-DD or YYYYMMDD, or as an ISO week with or without its day (YYYY-Www-D); white space
    around it is allowed. Else null."""
    s = strip(text)
    dashed = F.regexp_replace(s, r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3")
    return F.when(F.regexp_like(s, F.lit(_ISO)), F.try_to_date(dashed, "yyyy-MM-dd")).when(F.regexp_like(s, F.lit(_WEEK)), _week_date(s))


def full_year(two: Column, reference_year: int) -> Column:
    """The year with these two digits that lies within 50 years of the reference."""
    c = F.lit(reference_year - reference_year % 100) + two
    return F.when(c - reference_year > 50, c - 100).when(F.lit(reference_year) - c > 50, c + 100).otherwise(c)


def _date(y: Column, m: Column, d: Column) -> Column:
    return F.try_to_date(F.concat_ws("-", F.lpad(y.cast("string"), 4, "0"), F.lpad(m.cast("string"), 2, "0"), F.lpad(d.cast("string"), 2, "0")), "yyyy-MM-dd")


def parse_date(text: Column, reference_year: int) -> Column:
    """struct(date, ambiguous): year first, or day and month in an order that a number over 12 gives away."""
    s = strip(text)
    part = lambda pattern, k: F.regexp_extract(s, pattern, k).try_cast("int")
    ymd, dmy = r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})$", r"^(\d{1,2})[-/.](\d{1,2})[-/.](\d{2,4})$"
    a, b, tail = part(dmy, 1), part(dmy, 2), F.regexp_extract(s, dmy, 3)
    year = F.when(F.length(tail) == 4, tail.try_cast("int")).otherwise(full_year(tail.try_cast("int"), reference_year))
    is_ymd, is_dmy = F.regexp_like(s, F.lit(ymd)), F.regexp_like(s, F.lit(dmy))
    unsure = is_dmy & (a <= 12) & (b <= 12)
    date = F.when(is_ymd, _date(part(ymd, 1), part(ymd, 2), part(ymd, 3))).when(is_dmy & ~unsure & ~((a > 12) & (b > 12)), F.when(a > 12, _date(year, b, a)).otherwise(_date(year, a, b)))
    return F.struct(date.alias("date"), F.coalesce(unsure, F.lit(False)).alias("ambiguous"))


def parse_time(text: Column) -> Column:
    """HH:mm:ss from a clock of 24 or 12 hours, else null."""
    s = F.upper(F.replace(strip(text), F.lit("."), F.lit("")))
    pattern = r"^(\d{1,2}):(\d{1,2})(?::(\d{1,2}))?(?:\s+([AP])M)?$"
    part = lambda k: F.regexp_extract(s, pattern, k)
    h, m, sec, half = part(1).try_cast("int"), part(2).try_cast("int"), F.coalesce(part(3).try_cast("int"), F.lit(0)), part(4)
    hour = F.when(half == "", h).otherwise(h % 12 + F.when(half == "P", 12).otherwise(0))
    ok = (m < 60) & (sec < 62) & F.when(half == "", h < 24).otherwise((h >= 1) & (h <= 12))
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    return F.when(F.regexp_like(s, F.lit(pattern)) & ok & (sec < 60), F.concat_ws(":", two(hour), two(m), two(sec)))

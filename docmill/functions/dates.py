"""Lenient years and dates as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_WIDE, _NARROW = "０１２３４５６７８９", "0123456789"


def plain_digits(c: Column) -> Column:
    """Full-width digits as ASCII digits."""
    return F.translate(c, _WIDE, _NARROW)


def lenient_year(c: Column) -> Column:
    """The year in notations such as 2018, ２０１８, 2018年度, 2018.0 and 18; null if there is none."""
    s = F.trim(plain_digits(c.cast("string")))
    four, two = F.regexp_extract(s, r"^(\d{4})(?!\d)", 1), F.regexp_extract(s, r"^(\d{2})(?:\.0)?\s*年?度?$", 1)
    n = two.try_cast("int")
    return F.when(four != "", four.try_cast("int")).when(two != "", n + F.when(n > 50, 1900).otherwise(2000))


def lenient_date(c: Column, strict: bool = False) -> Column:
    """The date in notations such as 2003-10-26, 20031026, 2003/9/4, 2003.10.04 and 2003年1月2日; null if unreadable.

    A time of day after the date is dropped. Days that don't exist are unreadable. With ``strict`` only numbers with marks between
    them are read, and only days that nanoseconds since 1970 can count in 64 bits (22 September 1677 to 10 April 2262).
    """
    s = F.trim(plain_digits(c.cast("string")))
    pattern = r"^(\d{4})\s*[-/.年]\s*(\d{1,2})\s*[-/.月]\s*(\d{1,2})\s*日?(?:[ T]\d{1,2}:\d{2}(?::\d{2}(?:\.\d+)?)?)?$"
    solid = r"^(\d{4})(\d{2})(\d{2})$"
    part = lambda i, w: F.lpad(F.when(s.rlike(solid), F.regexp_extract(s, solid, i)).otherwise(F.regexp_extract(s, pattern, i)), w, "0")
    text = F.concat_ws("-", part(1, 4), part(2, 2), part(3, 2))
    day = F.when(s.rlike(solid) | s.rlike(pattern), text.try_cast("date"))
    if not strict:
        return day
    return F.when(~s.rlike("[年月日]") & day.between(F.lit("1677-09-22").cast("date"), F.lit("2262-04-10").cast("date")), day)

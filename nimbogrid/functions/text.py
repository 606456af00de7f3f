"""Names with placeholders, case, and numbers to a number of digits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fill(pattern: Column, values: dict[str, tuple[Column, int]]) -> Column:
    """pattern with every placeholder replaced: {placeholder: (number, digits)}, padded with zeros on the left, as in file names of members and domains."""
    for mark, (number, digits) in values.items():
        text = number.cast("string")
        padded = F.when(F.length(text) >= digits, text).otherwise(F.lpad(text, digits, "0"))
        pattern = F.replace(pattern, F.lit(mark), padded)
    return pattern


def member_name(member: Column, digits: int = 4) -> Column:
    """Numbers as digits; null is the mean."""
    return F.when(member.isNull(), "mean").otherwise(F.lpad(member.cast("string"), digits, "0"))


def significant(x: Column, digits: int = 8) -> Column:
    """x rounded to so many significant decimal digits; zero and missing stay."""
    size = F.floor(F.log10(F.abs(x))) + 1
    scale = F.pow(F.lit(10.0), digits - size)
    return F.when(x == 0, x).otherwise(F.round(x * scale, 0) / scale)

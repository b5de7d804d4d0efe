"""Numbers from text, and hashed draws that don't depend on partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A decimal number, with space around it; what a cast accepts beyond this (a type suffix such as 1d) isn't one.
DECIMAL = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$|^\s*[+-]?[iI][nN][fF]([iI][nN][iI][tT][yY])?\s*$"


def to_number(c: Column) -> Column:
    """The number that a text states, or null; NaN is null too."""
    text = c.cast("string")
    number = text.try_cast("double")
    return F.when(text.rlike(DECIMAL) & ~F.isnan(number), number)


def uniform(*parts: Column | int | str) -> Column:
    """In [0, 1), by the hash of the parts: the same for the same parts, however the rows are dealt."""
    h = F.xxhash64(*(p if isinstance(p, Column) else F.lit(p) for p in parts))
    return F.shiftrightunsigned(h, 11) / F.lit(float(1 << 53))

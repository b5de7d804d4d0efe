"""Column functions on arrays of doubles: softmax, arg-max, dot products, padding, slicing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def softmax(logits: Column) -> Column:
    """Probabilities of logits. The largest logit is taken off first, so nothing overflows."""
    shifted = F.transform(F.array(logits), lambda v: F.transform(v, lambda x: F.exp(x - F.array_max(v))))
    return F.transform(F.transform(shifted, lambda e: F.struct(e.alias("e"), total(e).alias("s"))), lambda p: F.transform(p.e, lambda x: x / p.s))[0]


def argmax(a: Column) -> Column:
    """Place of the first maximum, from 0; null for null or empty arrays."""
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def pad(a: Column, width: int, value: float = 0.0) -> Column:
    """a with value up to width."""
    return F.concat(a, F.array_repeat(F.lit(value), F.greatest(F.lit(width) - F.size(a), F.lit(0))))


def trim(a: Column, width: Column) -> Column:
    return F.slice(a, F.lit(1), width)


def to_columns(a: Column, names: list[str]) -> list[Column]:
    """Positional columns of an unnamed array."""
    return [F.get(a, F.lit(k)).alias(n) for k, n in enumerate(names)]


def clip(x: Column, bound: float = 100.0) -> Column:
    """x between -bound and bound; null and NaN become null (greatest and least would make them a bound)."""
    return F.when(x.isNotNull() & ~F.isnan(x), F.least(F.greatest(x, F.lit(-bound)), F.lit(bound)))


def cross_entropy(proba: Column, y: Column) -> Column:
    return -F.log(F.get(proba, y.cast("int")))


def doubles(values: list[float]) -> Column:
    """A literal array, of any length, in one expression."""
    return F.expr(f"array({', '.join(f'double({str(float(v))!r})' for v in values)})").cast("array<double>")


def place_in(x: Column, bounds: list[float]) -> Column:
    """How many of the sorted bounds are below x, searched in two steps of about the square root of their number; null for null."""
    if not bounds:
        return F.when(x.isNotNull(), 0)
    step = max(1, round(len(bounds) ** 0.5))
    every, coarse = doubles(bounds), doubles(bounds[step - 1 :: step])

    def fine(c: Column) -> Column:
        return c * step + F.size(F.filter(F.slice(every, c * step + 1, step), lambda b: b < x))

    found = F.get(F.transform(F.array(F.size(F.filter(coarse, lambda b: b < x))), fine), F.lit(0))
    return F.when(x.isNotNull(), found)

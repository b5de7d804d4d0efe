"""Distributions over buckets of a target: means and losses. Outer buckets have half-normal tails."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabmill.functions.arrays import softmax, total

#: The median of a half-normal distribution of scale 1.
HALF_NORMAL_MEDIAN = 0.6744897501960817


def bucket_means(edges: list[float]) -> list[float]:
    """Each bucket's mean: the middle; of the outer two, that of a half-normal from the inner edge whose median is as far as the
    outer edge."""
    middle = [(a + b) / 2 for a, b in zip(edges, edges[1:], strict=False)]
    if len(middle) > 1:
        reach = math.sqrt(2 / math.pi) / HALF_NORMAL_MEDIAN
        middle[0] = edges[1] - (edges[1] - edges[0]) * reach
        middle[-1] = edges[-2] + (edges[-1] - edges[-2]) * reach
    return middle


def distribution_mean(logits: Column, edges: list[float]) -> Column:
    return total(F.zip_with(softmax(logits), F.array(*map(F.lit, bucket_means(edges))), lambda p, m: p * m))


def bucket_loss(logits: Column, bucket: Column, y: Column, edges: list[float]) -> Column:
    """Negative log density of y: the bucket's probability over its width; in the outer buckets times the half-normal's density."""
    widths = [b - a for a, b in zip(edges, edges[1:], strict=False)]
    log_p = F.log(F.get(softmax(logits), bucket))
    inner = log_p - F.log(F.get(F.array(*map(F.lit, widths)), bucket))
    if len(widths) == 1:
        return -inner
    tail = lambda far, width: log_p + F.lit(math.log(2 / math.sqrt(2 * math.pi)) - math.log(width / HALF_NORMAL_MEDIAN)) - F.pow(far / F.lit(width / HALF_NORMAL_MEDIAN), 2) / 2
    return -F.when(bucket == 0, tail(F.lit(edges[1]) - y, widths[0])).when(bucket == len(widths) - 1, tail(y - F.lit(edges[-2]), widths[-1])).otherwise(inner)

"""Exact token counts: a histogram of encoded lengths, and what its suffix sums answer.

Documents are encoded where they lie and only their lengths go on, summed by length in each task first. Suffix sums over the
lengths are made in two steps (inside ranges of 4096 lengths, then over the ranges). From them come, for a context limit L,
the documents and tokens of length L or more, and the total after truncation to L: tokens of shorter documents, and L for each
of the rest.

Cases: null and empty texts have length 0. Rows that repeat count each. An empty table gives no rows, totals of 0 and null
quantiles. Very long texts are encoded whole. Ids and other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabmill.llm import tokens
from tabmill.llm.mixing import running_total
from tabmill.llm.text import shared_table


def lengths(docs: DataFrame, vocabulary: str = tokens.VOCABULARY) -> DataFrame:
    """length, a row per document. docs: text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(tokens.encode(t, vocabulary)) for t in b.column("text").to_pylist()], pa.int64())], names=["length"])

    return docs.select("text").mapInArrow(run, "length long")


def histogram(docs: DataFrame, vocabulary: str = tokens.VOCABULARY) -> DataFrame:
    """A row per length that occurs: length, n_docs, docs_at_least, tokens_at_least, truncated_total, total_docs, total_tokens,
    docs_up_to (the share of documents no longer)."""
    # written, as the suffix sums read it several times and encoding is what costs
    h = shared_table(lengths(docs, vocabulary).groupBy("length").agg(F.count("*").alias("n_docs")), "lengths")
    h = h.withColumn("n_tokens", F.col("length") * F.col("n_docs")).withColumn("one", F.lit(0)).withColumn("down", -F.col("length"))
    for value, name in (("n_docs", "docs_above"), ("n_tokens", "tokens_above")):
        h = running_total(h, ["one"], ["down"], value, name, F.floor(F.col("down") / 4096))
    total = h.groupBy("one").agg(F.sum("n_docs").alias("total_docs"), F.sum("n_tokens").alias("total_tokens"))
    h = h.join(total, "one")
    least = F.col("tokens_above") + F.col("n_tokens")
    return h.select(
        "length", "n_docs",
        (F.col("docs_above") + F.col("n_docs")).alias("docs_at_least"),
        least.alias("tokens_at_least"),
        (F.col("total_tokens") - least + F.col("length") * (F.col("docs_above") + F.col("n_docs"))).alias("truncated_total"),
        "total_docs", "total_tokens",
        ((F.col("total_docs") - F.col("docs_above")) / F.col("total_docs")).alias("docs_up_to"),
    )


def truncated_total(hist: DataFrame, limit: int) -> DataFrame:
    """One row, truncated_total: tokens left if every document is cut to `limit`, for any limit. hist: histogram()."""
    cut = F.least(F.col("length"), F.lit(limit)) * F.col("n_docs")
    return hist.agg(F.coalesce(F.sum(cut), F.lit(0)).alias("truncated_total"))


def quantile(hist: DataFrame, q: float) -> DataFrame:
    """One row, length: the least length that a share q of the documents doesn't exceed; null without documents."""
    return hist.where(F.col("docs_up_to") >= q).agg(F.min("length").alias("length"))

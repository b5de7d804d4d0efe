"""Quality rules: a hashed n-gram log-likelihood ratio of a trusted target against the raw corpus.

Native: DataFrame functions only. An n-gram here is a word or two successive words, whole and as they are written; each is
hashed into one of `buckets` cells. Over the cells there are two multinomials: the raw corpus (every document) and the trusted
target (every document known to be good). A document's verdict is its mean log ratio over its own n-grams against a fixed
threshold, so that length doesn't decide.

Cases: a null or empty text has no words, all its counts are 0, and it is base_failed. Rows that repeat are scored each on
its own. A null doc_id is never trusted; it is scored like any other. An empty table gives no rows. With no trusted rows at
all every ratio is 0 and the base rules alone decide. Very long texts are read whole. Other columns are ignored, whatever their
names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabmill.llm.text import words

#: Cells of both multinomials. The model is this many doubles, whatever the input's size.
BUCKETS = 262_144
#: Most trusted ids (of 8 bytes) that go to every task; more are joined by a shuffle.
SPREAD = 8_000_000
#: Added to a cell's observed and expected target counts.
PRIOR = 2.0
#: Least mean log ratio of a document that is kept.
THRESHOLD = -0.2
SYMBOLS = "#*$%&|<>"


def word_hashes(w: Column) -> Column:
    return F.transform(w, lambda x: F.xxhash64(x))


def pair_hashes(hw: Column) -> Column:
    """Hashes of successive words, from word_hashes()."""
    last = F.greatest(F.size(hw) - 1, F.lit(0))
    return F.zip_with(F.slice(hw, F.lit(1), last), F.slice(hw, F.lit(2), last), lambda a, b: F.xxhash64(a, b))


def cells_of(hw: Column, pairs: Column, buckets: int) -> Column:
    """The cells of a document's n-grams."""
    return F.transform(F.concat(hw, pairs), lambda h: F.pmod(h, F.lit(buckets)).cast("int"))


def fit_ratio(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, prior: float = PRIOR, spread: int = SPREAD) -> DataFrame:
    """One row, one array `model`: by cell, the log of its target over its raw probability (0 where it never occurs).

    docs: doc_id, text; all rows count. trusted: doc_id; its ids are counted, and broadcast if there are no more than `spread`.
    """
    ids = trusted.select(F.col("doc_id").cast("long").alias("_good")).where("_good is not null").distinct()
    ids = F.broadcast(ids) if ids.count() <= spread else ids
    seen = docs.select("doc_id", word_hashes(words(F.col("text"))).alias("hw")).join(ids, F.col("doc_id") == F.col("_good"), "left")
    seen = seen.select("_good", "hw", pair_hashes(F.col("hw")).alias("pairs"))
    seen = seen.select(F.explode(cells_of(F.col("hw"), F.col("pairs"), buckets)).alias("cell"), F.lit(1).alias("raw"), F.col("_good").isNotNull().cast("int").alias("good"))
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("cell"), F.lit(0).alias("raw"), F.lit(0).alias("good"))
    cells = seen.unionByName(every).groupBy("cell").agg(F.sum("raw").alias("raw"), F.sum("good").alias("target"))
    one = cells.agg(F.array_sort(F.collect_list(F.struct("cell", "raw", "target"))).alias("c"), F.sum("raw").alias("r"), F.sum("target").alias("t"))
    share = F.coalesce(F.try_divide("t", "r"), F.lit(0.0))
    # without trusted rows there is no target to compare with
    return one.select(F.transform("c", lambda c: F.when(F.col("t") > 0, F.log((c.target + prior) / (c.raw * share + prior))).otherwise(F.lit(0.0))).alias("model"))


def covered(h: Column) -> Column:
    """Of an array of hashes of 3-word windows: how many words lie in windows that occur twice or more."""
    order = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    again = F.transform(F.array(order), lambda s: F.filter(s, lambda e, k: F.coalesce(e.h == F.get(s, k - 1).h, F.lit(False)) | F.coalesce(e.h == F.get(s, k + 1).h, F.lit(False))))
    at = F.array_sort(F.transform(F.get(again, F.lit(0)), lambda e: e.i))
    start = F.struct(F.lit(-1).alias("end"), F.lit(0).cast("long").alias("n"))
    step = lambda a, i: F.struct((i + 2).alias("end"), (a.n + (i + 2 - F.greatest(a.end, i - 1))).alias("n"))
    return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(F.aggregate(at, start, step, lambda a: a.n))


def base_rules(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with hashes of words (hw) and of successive words (pairs), and the base measures."""
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select("doc_id", text.alias("text"), words(text).alias("w"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    d = d.select("doc_id", "text", "w", F.size("w").alias("n"), lines.alias("lines"), word_hashes(F.col("w")).alias("hw"))
    d = d.select("*", pair_hashes(F.col("hw")).alias("pairs"))
    more = F.greatest(F.col("n") - 2, F.lit(0))
    windows = F.zip_with(F.slice("pairs", F.lit(1), more), F.slice("hw", F.lit(3), more), lambda a, b: F.xxhash64(a, b))
    d = d.select(
        "doc_id", "hw", "pairs", "n", windows.alias("h"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
    )
    d = d.select("doc_id", "hw", "pairs", "n", "word_chars", "n_symbols", "n_dup_lines", covered(F.col("h")).alias("n_repeat_words"))
    failed = (F.col("n") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n"))
    return d.withColumn("base_failed", failed)


def quality(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, prior: float = PRIOR, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: base measures, base_failed, mean_ratio and kept. See the module's text for the cases."""
    d = base_rules(docs)
    d = d.select("*", cells_of(F.col("hw"), F.col("pairs"), buckets).alias("cells"), fit_ratio(docs, trusted, buckets, prior).scalar().alias("model"))
    total = F.aggregate("cells", F.lit(0.0), lambda a, c: a + F.get("model", c))
    mean = F.when(F.size("cells") > 0, total / F.size("cells")).otherwise(F.lit(0.0))
    d = d.select("doc_id", F.col("n").cast("long").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", mean.alias("mean_ratio"))
    return d.withColumn("kept", ~F.col("base_failed") & (F.round("mean_ratio", 9) >= threshold))

"""Document fingerprints by spot signatures. Native: DataFrame functions only.

Words are what stands between ASCII space, in lower case. The anchors are the words most frequent in the corpus. A spot is an
anchor with the next two content words behind it (words that aren't anchors), hashed to 64 bits; the first two words of a text
are a spot too, so that a text with any word has one. A document's fingerprint is the set of its spots, in order, as 16
hexadecimal digits each. The likeness of two fingerprints is the Jaccard similarity of the sets; two empty ones are alike (1).

matches() finds what is like a stated set of query documents: fingerprints are dealt by bands of their set lengths, as sets of
lengths too far apart can't be alike enough; inside neighbouring bands sets meet by the least spots of which one must be shared,
and of the pairs that meet those whose lengths and places rule the threshold out are pruned before sets are compared.

Cases: a null or empty text, or one of space alone, has no spots and an empty fingerprint. Equal texts have equal fingerprints.
Rows that repeat are documents of their own; of rows that share an id, the order is that of a hash of their texts. A null doc_id
comes last. Of a single document the next one is itself. An empty table gives no rows. Very long texts are read whole. Other
columns are ignored, whatever their names. Ids are numbers, and nearly unique: rows of one id are in one window.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabmill.llm.text import words

#: How many of the most frequent words are anchors.
ANCHORS = 64
THRESHOLD = 0.8


def common_words(docs: DataFrame, most: int = ANCHORS) -> list[str]:
    """The most frequent words of docs (text), the first in byte order of equals. Only these reach the driver."""
    each = docs.select(F.explode(words(F.lower("text"))).alias("word"))
    return [r.word for r in each.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(most).collect()]


def let(value: Column, f) -> Column:
    """f of a value that is computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def spots(text: Column, anchors: list[str]) -> Column:
    """The sorted set of a text's spots, from linear passes over arrays.

    The k-th anchor (from 0) at place p has p - k content words before it, which is where those behind it start.
    """
    common = F.array(*(F.xxhash64(F.lit(a)) for a in anchors)).cast("array<bigint>")
    hashed = F.transform(words(F.lower(text)), lambda w: F.xxhash64(w))

    def chains(marked: Column) -> Column:
        content = F.transform(F.filter(marked, lambda m: ~m.a), lambda m: m.h)
        places = F.filter(F.transform(marked, lambda m, i: F.when(m.a, i)), lambda i: i.isNotNull())
        chain = lambda c: F.filter(F.transform(places, lambda p, k: F.when(F.get(c, p - k + 1).isNotNull(), F.xxhash64(F.get(marked, p).h, F.get(c, p - k), F.get(c, p - k + 1)))), lambda s: s.isNotNull())
        start = F.array(F.xxhash64(F.lit("^"), F.get(marked, F.lit(0)).h, F.get(marked, F.lit(1)).h))
        found = F.sort_array(F.array_distinct(F.concat(let(content, chain), start)))
        return F.when(F.size(marked) > 0, found).otherwise(F.array().cast("array<bigint>"))

    return let(F.transform(hashed, lambda h: F.struct(h.alias("h"), F.array_contains(common, h).alias("a"))), chains)


def shown(sigs: Column) -> Column:
    """A set of spots as the fingerprint's text."""
    return F.array_join(F.transform(sigs, lambda s: F.lpad(F.lower(F.hex(s)), 16, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets of spots."""
    return let(F.size(F.array_intersect(a, b)), lambda n: F.coalesce(F.try_divide(n.cast("double"), F.size(a) + F.size(b) - n), F.lit(1.0)))


def with_next(docs: DataFrame) -> tuple[DataFrame, Window]:
    """doc_id, text, and bins of neighbouring ids with a last row (`_end`) that is the first one of the bin behind, and the window
    that follows a bin. So the document that comes next (by descending doc_id, the first behind the last) is a lead in its bin.

    Bins have about equally many rows; of each, the first one's id and hash reach the driver.
    """
    spark = docs.sparkSession
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    bins = 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = d.agg(F.percentile_approx("doc_id", [k / bins for k in range(1, bins)], 10 * bins).alias("b")).first()["b"] or []
    above = F.size(F.filter(F.array(*map(F.lit, sorted(set(bounds)))).cast("array<bigint>"), lambda b: b > F.col("doc_id")))
    d = d.withColumn("_h", F.xxhash64("text")).withColumn("_bin", F.when(F.col("doc_id").isNull(), len(bounds) + 1).otherwise(above))
    first = d.groupBy("_bin").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), F.bitwise_not("doc_id").alias("o"), F.col("_h").alias("h"))).alias("f")).collect()
    first = sorted(first, key=lambda r: r["_bin"])
    heads = [(b["_bin"], None if r["f"]["n"] else ~r["f"]["o"], r["f"]["h"]) for b, r in zip(first, first[1:] + first[:1], strict=True)]
    ends = spark.createDataFrame(heads, "_to int, _id long, _first long")
    ends = d.join(F.broadcast(ends), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_first"))).select("doc_id", "text", "_h", F.col("_to").alias("_bin"), F.lit(True).alias("_end")).dropDuplicates(["_bin"])
    every = d.select("doc_id", "text", "_h", "_bin", F.lit(False).alias("_end")).unionByName(ends)
    return every, Window.partitionBy("_bin").orderBy("_end", F.desc_nulls_last("doc_id"), "_h")


def fingerprints(docs: DataFrame, anchors: list[str] | None = None) -> DataFrame:
    """doc_id, sigs (the sorted set of spots) of docs (doc_id, text)."""
    anchors = common_words(docs) if anchors is None else anchors
    return docs.select("doc_id", spots(F.coalesce("text", F.lit("")), anchors).alias("sigs"))


def compared(docs: DataFrame, anchors: list[str] | None = None) -> DataFrame:
    """Each document's fingerprint, its edited text's (the last third of its characters replaced by the next document's first),
    and the likeness of its own to that and to the next document's."""
    anchors = common_words(docs) if anchors is None else anchors
    every, bin_ = with_next(docs)
    d = every.select("doc_id", "text", "_h", "_bin", "_end", F.lead("text").over(bin_).alias("_next"), F.length("text").alias("n"))
    d = d.select("*", F.floor(F.col("n") / 3).cast("int").alias("k"))
    edited = F.concat(F.substring("text", F.lit(1), F.col("n") - F.col("k")), F.substring("_next", F.lit(1), F.col("k")))
    d = d.select("doc_id", "_h", "_bin", "_end", "n", F.when(~F.col("_end"), edited).alias("edited"), spots(F.col("text"), anchors).alias("sigs"))
    d = d.select("*", F.lead("sigs").over(bin_).alias("next_sigs")).where("not _end")
    d = d.select("doc_id", "n", F.sha2("edited", 256).alias("edited_sha256"), "sigs", "next_sigs", spots(F.col("edited"), anchors).alias("edited_sigs"))
    return d.select(
        "doc_id", F.col("n").cast("long").alias("n_chars"), "edited_sha256", shown(F.col("sigs")).alias("fingerprint"), shown(F.col("edited_sigs")).alias("edited_fingerprint"),
        likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"), likeness(F.col("sigs"), F.col("next_sigs")).alias("near_next"),
    )


def band(n: Column, threshold: float) -> Column:
    """A set length's band: lengths of sets that alike are in the same or in neighbouring ones."""
    return F.when(n > 0, F.floor(F.log(n.cast("double")) / -math.log(threshold))).otherwise(-2).cast("int")


def least_shared(n: Column, m: Column, threshold: float) -> Column:
    """How many spots sets of n and m must share to be that alike."""
    return F.ceil((n + m) * threshold / (1 + threshold) - 1e-9)


def matches(queries: DataFrame, prints: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """query_id, doc_id, likeness: which of all prints (doc_id, sigs) are at least that like each of a stated set of queries
    (doc_id, sigs), themselves included. Ids are unique. 0 < threshold < 1.

    Sets at least that alike share one of the n - ceil(threshold * n) + 1 least spots of each. Sets without spots match their like.
    """
    if not 0 < threshold < 1:
        raise ValueError("threshold must lie between 0 and 1")

    def dealt(d: DataFrame, *around: int) -> DataFrame:
        d = d.select("doc_id", "sigs", F.size("sigs").alias("n"))
        first = F.when(F.col("n") > 0, F.slice("sigs", F.lit(1), (F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1).cast("int"))).otherwise(F.array(F.lit(0).cast("long")))
        d = d.select("doc_id", "n", F.explode(F.array(*(band(F.col("n"), threshold) + k for k in around))).alias("band"), F.posexplode(first).alias("at", "spot"))
        return d

    q, p = dealt(queries, -1, 0, 1), dealt(prints, 0)
    met = q.select(F.col("doc_id").alias("query_id"), F.col("n").alias("q_n"), F.col("at").alias("q_at"), "band", "spot").join(p, ["band", "spot"])
    # pruned by lengths and by what can still be shared from these places on
    need = least_shared(F.col("q_n"), F.col("n"), threshold)
    met = met.where((F.least("q_n", "n") >= F.greatest("q_n", "n") * threshold - 1e-9) & ((F.col("q_n") == 0) | (1 + F.least(F.col("q_n") - F.col("q_at") - 1, F.col("n") - F.col("at") - 1) + F.least("q_at", "at") >= need)))
    met = met.select("query_id", "doc_id").distinct()
    met = met.join(queries.select(F.col("doc_id").alias("query_id"), F.col("sigs").alias("q_sigs")), "query_id").join(prints.select("doc_id", "sigs"), "doc_id")
    return met.select("query_id", "doc_id", likeness(F.col("q_sigs"), F.col("sigs")).alias("likeness")).where(F.col("likeness") >= threshold - 1e-12)

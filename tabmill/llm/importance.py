"""Importance resampling towards a target: hashed word n-grams of the corpus and of the target, and a Gumbel-top-k draw.

A pre-tokenizer of the tokenizers library (Split by a regular expression, untrained) gives the words of a text, lower-cased in
A-Z alone, with their offsets. Windows of one and of two neighbouring offsets are the features; a feature's bucket is the CRC of
its bytes, modulo the number of buckets. The buckets of a document are written once, as 16-bit numbers, and then counted and
scored as arrays. A bucket's gain is the log ratio of its smoothed share in the target and in the corpus, in thousandths; a
document's weight is its features' mean gain. The draw takes the highest scores, a score being the weight and a Gumbel draw
hashed from the document's id, so that reruns agree and documents are drawn by their weights without replacement.

What tasks hold: a batch's buckets, an array of counts, an array of gains (of the number of buckets, whatever the input's size).
The order of scores comes from range partitions of thin rows.

Cases: null and empty texts have no features, and weight 0; they are never drawn, as they have too few words. A null doc_id is
hashed as an empty text, and comes last among ties. Rows that repeat are scored, counted and drawn each on its own. An empty
table gives no rows; without target rows gains follow the corpus alone. Very long texts are read in pieces, cut between words.
Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabmill.llm.text import by_bytes, shared_table
from tabmill.operators.ranking import global_rank

BUCKETS, SHARE, SEED, LEAST_WORDS = 10_000, 25, 7, 20
#: What stands between words, once A-Z are lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Characters of a text that are split at a time; a piece ends between words, so a longer word is one piece.
PIECE = 200_000
BATCH_BYTES = 4_000_000


@lru_cache(maxsize=1)
def splitter():
    from tokenizers import Regex
    from tokenizers.pre_tokenizers import Split

    return Split(Regex(BETWEEN), "removed")


def pieces(text: str, most: int = PIECE) -> Iterator[str]:
    """text, cut behind a character that belongs to no word, about every `most` characters."""
    at, between = 0, re.compile(BETWEEN)
    while len(text) - at > most:
        gap = between.search(text, at + most)
        if gap is None:
            break
        yield text[at : gap.end()]
        at = gap.end()
    yield text[at:] if at else text


def buckets_of(text: str | None, buckets: int = BUCKETS, most: int = PIECE) -> tuple[int, np.ndarray]:
    """How many words a text has, and the buckets of its words and of its pairs of neighbouring words."""
    one, two, last, crc = [], [], None, zlib.crc32
    for part in pieces((text or "").encode().lower().decode(), most):
        offsets = [o for _, o in splitter().pre_tokenize_str(part)]
        words = [part[a:b].encode() for a, b in offsets]
        if not words:
            continue
        own = [crc(w) for w in words]
        # a pair's CRC goes on from its first word's
        if last is not None:
            two.append(crc(b" " + words[0], last))
        two += [crc(b" " + w, c) for c, w in zip(own, words[1:], strict=False)]
        one += own
        last = own[-1]
    return len(one), (np.array(one + two, np.uint32) % buckets).astype(np.uint16)


def bucketed(docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_words, features (16-bit buckets, as bytes) of docs (doc_id, text). Written."""
    if not 0 < buckets <= 1 << 16:
        raise ValueError("buckets must fit 16 bits")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            for texts in by_bytes(b.column("text").to_pylist(), BATCH_BYTES):
                found = [buckets_of(t, buckets) for t in texts]
                ids = b.column("doc_id").slice(at, len(texts))
                at += len(texts)
                yield pa.RecordBatch.from_arrays([ids, pa.array([n for n, _ in found], pa.int64()), pa.array([a.tobytes() for _, a in found], pa.binary())], names=["doc_id", "n_words", "features"])

    return shared_table(docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words long, features binary"), "features")


def bucket_counts(features: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features each bucket has: counted in each task, then added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for raw in b.column("features").to_pylist():
                total += np.bincount(np.frombuffer(raw, np.uint16), minlength=buckets)
        at = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in features.select("features").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """By bucket, thousandths of the log ratio of its share in the target to that in the corpus, with one more feature each."""
    s, t, buckets = int(corpus.sum()), int(target.sum()), len(corpus)
    ratio = lambda a, b: (float(a + 1) * float(s + buckets)) / (float(b + 1) * float(t + buckets))
    return np.array([math.floor(1000 * math.log(ratio(a, b))) for a, b in zip(target.tolist(), corpus.tolist(), strict=True)], np.int64)


def weights(features: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, weight: the mean gain of a document's features, rounded down."""
    kind = features.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [np.frombuffer(raw, np.uint16) for raw in b.column("features").to_pylist()]
            weight = [int(gain[a].sum()) // len(a) if len(a) else 0 for a in found]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_words"), pa.array([len(a) for a in found], pa.int64()), pa.array(weight, pa.int64())], names=["doc_id", "n_words", "n_features", "weight"])

    return features.mapInArrow(run, f"doc_id {kind}, n_words long, n_features long, weight long")


def gumbel(doc_id: Column, seed: int) -> Column:
    """Thousandths of a Gumbel draw, by the hash of the seed and the id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resample(docs: DataFrame, target: DataFrame, share: int = SHARE, seed: int = SEED, buckets: int = BUCKETS, least_words: int = LEAST_WORDS) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every document: rank is a drawn one's place from 1, null for the others.

    docs: doc_id, text; target: text. Of the documents with at least `least_words` words, `share` in a hundred are drawn.
    """
    own = bucketed(docs, buckets)
    aim = bucketed(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), buckets)
    scored = weights(own, gains(bucket_counts(own, buckets), bucket_counts(aim, buckets)))
    drawn = own.where(F.col("n_words") >= least_words).count() * share // 100
    scored = scored.select("doc_id", "n_features", "weight", (F.col("weight") + gumbel(F.col("doc_id"), seed)).alias("score"), (F.col("n_words") < least_words).alias("_short"), F.monotonically_increasing_id().alias("_row"))
    ranked = global_rank(scored, ["_short", F.desc("score"), F.asc_nulls_last("doc_id"), "_row"], "_place")
    return ranked.select("doc_id", "n_features", "weight", "score", F.when((F.col("_place") < drawn) & ~F.col("_short"), F.col("_place") + 1).cast("long").alias("rank"))


def resampled(docs: DataFrame, target: DataFrame, share: int = SHARE, seed: int = SEED, buckets: int = BUCKETS, least_words: int = LEAST_WORDS) -> DataFrame:
    """The rows of docs whose id was drawn."""
    drawn = resample(docs, target, share, seed, buckets, least_words).where("rank is not null").select(F.col("doc_id").alias("_drawn")).distinct()
    return docs.join(drawn, docs["doc_id"].eqNullSafe(F.col("_drawn")), "left_semi")

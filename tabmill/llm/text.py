"""Words, tables and shared-folder helpers used by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabmill.sources.storage import scratch

#: What separates words: the ASCII space characters and nothing else (bytes.split() agrees).
SPACE = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def words(text: Column) -> Column:
    """Array of the words of a text; null and empty texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def row_hash(*columns: Column) -> Column:
    """A hash of values and of which of them are null (a null alone leaves a hash as it was)."""
    return F.xxhash64(*(x for c in columns for x in (c.isNull(), c)))


def others(df: DataFrame, *made: str) -> list[str]:
    """df's columns but for these names, in any case: what an operator makes takes the place of a column of its name."""
    return [c for c in df.columns if c.lower() not in made]


def in_fold(doc_id: Column, folds: int, fold: int) -> Column:
    """True if crc32 of the id's text leaves this remainder; a null id never does."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == fold, F.lit(False))


#: Paths of the tables written so far, in order; settled() deletes those that nothing reads any more.
_made: list[str] = []


def shared_table(df: DataFrame, name: str) -> DataFrame:
    """df, written once to the folder all executors share and read back, so its lineage is cut."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path, compression="zstd")
    _made.append(path)
    return spark.read.schema(df.schema).parquet(path)


def settled(spark: SparkSession, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table that make() describes, written; the tables that were written on its way are deleted then."""
    first = len(_made)
    out = shared_table(make(), name)
    gone = _made[first:-1]
    del _made[first:-1]
    for path in gone:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    return out


def by_bytes(texts: list, most: int) -> Iterator[list]:
    """Runs of texts of about `most` bytes or characters, so that memory doesn't follow a batch's rows."""
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t or "")
        if size >= most:
            yield part
            part, size = [], 0
    if part:
        yield part


def bounded_sample(labels: DataFrame, label: str, per_class: dict[int, int], where: Column | None = None) -> DataFrame:
    """At most per_class[value] labelled ids of each value, chosen by the ids' hashes: doc_id, label.

    The result has sum(per_class.values()) rows at most, so it may be broadcast.
    """
    rows = labels.select("doc_id", F.col(label).cast("int").alias(label)).where(F.col("doc_id").isNotNull())
    rows = rows if where is None else rows.where(where)
    parts = [rows.where(F.col(label) == v).dropDuplicates(["doc_id"]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for v, n in per_class.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out

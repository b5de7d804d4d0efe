"""Collections of tables: two Parquet tables, `datasets` (a row per table) and `rows` (dataset_id, row_idx, x, y).

A stored collection is a log of commits. Each names a folder with its part of both tables, and the positions that this part has;
positions go on from commit to commit. Nothing is padded in storage. Rows lie in blocks of neighbouring positions, sorted inside,
so that a range of batches reads the blocks it needs and no others.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from tabmill.functions.arrays import pad, trim
from tabmill.operators.batches import batch_plan, plan_ranges
from tabmill.operators.ranking import global_rank
from tabmill.sources.log import CommitLog

ROWS = "dataset_id long, row_idx int, x array<double>, y double"


def describe(rows: DataFrame, split: Column | None = None, n_features: Column | None = None) -> DataFrame:
    """datasets of rows: dataset_id, dataset_pos, n_rows, n_features, split_index (by default 60 % of the rows)."""
    by = rows.groupBy("dataset_id").agg(F.count("*").alias("n_rows"), F.max(F.size("x") if n_features is None else n_features).alias("n_features"))
    by = by.withColumn("split_index", F.floor(F.col("n_rows") * 0.6).cast("int") if split is None else split)
    return global_rank(by, ["dataset_id"], "dataset_pos")


def write_collection(rows: DataFrame, datasets: DataFrame, path: str, problem_type: str, n_classes: int | None = None, batch_size: int = 1, mode: str = "overwrite", block_tables: int | None = None) -> None:
    """Adds a commit to the collection at path: both tables, and its facts; a class count only for classification.

    mode: "append" goes on from the last position, "overwrite" starts anew (earlier commits stay in the log, unread). datasets:
    dataset_id and dataset_pos, which count from 0 within what is written now; the stored positions go on from there. A commit
    is visible with its manifest, which comes last: a write that fails leaves the collection as it was. If another one committed
    meanwhile, its positions are taken, and this one is written again behind it. An id may come again in a later commit: the
    position names a table. Rows are stored by blocks of `block_tables` positions.
    """
    if mode not in ("append", "overwrite"):
        raise ValueError("mode must be append or overwrite")
    n, first, last, places, ids = datasets.agg(F.count("*"), F.min("dataset_pos"), F.max("dataset_pos"), F.count_distinct("dataset_pos"), F.count_distinct("dataset_id")).first()
    if n and (first, last, places, ids) != (0, n - 1, n, n):
        raise ValueError("dataset_pos must count the tables from 0, and dataset_id name each once")
    lost = F.raise_error(F.concat(F.lit("rows of a table that is not in datasets: "), F.coalesce(F.col("dataset_id").cast("string"), F.lit("null"))))

    def placed(start: int) -> tuple[DataFrame, DataFrame]:
        own = datasets.withColumn("dataset_pos", F.col("dataset_pos") + start)
        d = rows.drop("dataset_pos").join(own.select("dataset_id", F.col("dataset_pos").alias("_pos")), "dataset_id", "left")
        return d.withColumn("dataset_pos", F.when(F.col("_pos").isNotNull(), F.col("_pos")).otherwise(lost.cast("long"))).drop("_pos"), own

    while not _commit(rows.sparkSession, path, placed, n, {"mode": mode, "problem_type": problem_type, "batch_size": batch_size, "n_classes": n_classes if problem_type == "classification" else None}, block_tables):
        pass


def _commit(spark: SparkSession, path: str, placed: Callable[[int], tuple[DataFrame, DataFrame]], n: int, entry: dict, block_tables: int | None) -> bool:
    """Writes n tables and then their manifest. placed: rows and datasets with stored positions, from the first of them. False if
    another commit came first; then nothing is left of this one."""
    log = CommitLog(spark, f"{path}/commits")
    before = log.entries()
    live = _live(before) if entry["mode"] == "append" else []
    if live and live[0]["problem_type"] != entry["problem_type"]:
        raise ValueError(f"the collection's problem type is {live[0]['problem_type']}")
    size, start, folder = block_tables or max(256, -(-n // 1024)), sum(e["n_tables"] for e in live), uuid.uuid4().hex
    own, sizes = placed(start)
    own = own.withColumn("block", F.col("dataset_pos") - F.col("dataset_pos") % size)
    own.repartitionByRange("dataset_pos").sortWithinPartitions("dataset_pos", "row_idx").write.partitionBy("block").parquet(f"{path}/rows/commit={folder}")
    sizes.repartitionByRange("dataset_pos").sortWithinPartitions("dataset_pos").write.parquet(f"{path}/datasets/commit={folder}")
    entry = entry | {"folder": folder, "first": start, "n_tables": n, "block_tables": size, "rows": own.schema.jsonValue(), "datasets": sizes.schema.jsonValue()}
    if log.put(before[-1]["no"] + 1 if before else 0, entry):
        return True
    for table in ("rows", "datasets"):
        log.delete(f"{path}/{table}/commit={folder}")
    return False


def _live(entries: list[dict]) -> list[dict]:
    """The commits since the last that started anew."""
    starts = [k for k, e in enumerate(entries) if e["mode"] == "overwrite"]
    return entries[starts[-1] if starts else 0 :]


@dataclass(frozen=True)
class Collection:
    """A stored collection as it was when it was opened."""

    spark: SparkSession
    path: str
    commits: list[dict]
    _listed: dict[str, set[int]] = field(default_factory=dict, compare=False, repr=False)

    @property
    def n_tables(self) -> int:
        return sum(e["n_tables"] for e in self.commits)

    @property
    def facts(self) -> dict[str, str]:
        classes = [e["n_classes"] for e in self.commits if e["n_classes"] is not None]
        first = {"problem_type": self.commits[0]["problem_type"], "original_batch_size": str(self.commits[0]["batch_size"])}
        return first | ({"max_num_classes": str(max(classes))} if classes else {})

    def _blocks(self, folder: str) -> set[int]:
        """The blocks that a commit has rows in; listed once, as a scan of some needn't list the files of all."""
        if folder not in self._listed:
            names = CommitLog(self.spark, f"{self.path}/commits").folders(f"{self.path}/rows/commit={folder}")
            self._listed[folder] = {int(n.removeprefix("block=")) for n in names if n.startswith("block=")}
        return self._listed[folder]

    def _folders(self, table: str, e: dict, ranges: list[tuple[int, int]] | None) -> list[str]:
        """Where a commit's part of a table lies; of rows, the blocks of the ranges alone, unless they are most of it."""
        whole, size = f"{self.path}/{table}/commit={e['folder']}", e["block_tables"]
        if table != "rows" or ranges is None or 2 * sum(hi - lo for lo, hi in ranges) > e["n_tables"]:
            return [whole]
        own = [(max(lo, e["first"]), min(hi, e["first"] + e["n_tables"])) for lo, hi in ranges]
        near = {b for lo, hi in own if lo < hi for b in range(lo - lo % size, hi, size)}
        return [f"{whole}/block={b}" for b in sorted(near & self._blocks(e["folder"]))]

    def _read(self, table: str, ranges: list[tuple[int, int]] | None) -> DataFrame:
        """A table of the commits that hold any of the ranges of positions (all, if None), and of them the blocks that do."""
        inside = lambda e: e["n_tables"] and (ranges is None or any(lo < e["first"] + e["n_tables"] and hi > e["first"] for lo, hi in ranges))
        fields: dict[str, StructField] = {}
        for e in self.commits:
            for f in StructType.fromJson(e[table]).fields:
                if fields.setdefault(f.name, f).dataType != f.dataType:
                    raise ValueError(f"commits differ in the type of {f.name}")
        schema = StructType([StructField(f.name, f.dataType, True) for f in fields.values()])
        chosen = [e for e in self.commits if inside(e)]
        folders = [f for e in chosen for f in self._folders(table, e, ranges)]
        if not folders:
            return self.spark.createDataFrame([], schema)
        d = self.spark.read.schema(schema).option("basePath", f"{self.path}/{table}").parquet(*folders).drop("commit")
        if ranges is None:
            return d
        at, size = F.col("dataset_pos"), max(e["block_tables"] for e in chosen)
        keep = F.lit(False)
        for lo, hi in ranges:
            near = (at >= lo) & (at < hi)
            keep = keep | (near & (F.col("block") > lo - size) & (F.col("block") < hi) if table == "rows" else near)
        return d.where(keep)

    def rows(self, ranges: list[tuple[int, int]] | None = None) -> DataFrame:
        """The rows of tables whose positions lie in the ranges (from, up to); only blocks that hold such are read."""
        return self._read("rows", ranges).drop("block")

    def datasets(self, ranges: list[tuple[int, int]] | None = None) -> DataFrame:
        return self._read("datasets", ranges)

    def scan(self, batch_size: int, num_steps: int, epochs: int = 1, start: int = 0) -> DataFrame:
        """The rows of each batch of a plan over this collection, with its columns, batch_no and split_index. The plan's positions
        are at most two ranges, known beforehand, so that blocks outside are not read."""
        ranges = plan_ranges(self.n_tables, batch_size, num_steps, epochs, start)
        return scan_batches(self.rows(ranges), self.datasets(ranges), batch_plan(self.spark, self.n_tables, batch_size, num_steps, epochs, start))


def open_collection(spark: SparkSession, path: str) -> Collection:
    """The collection at path, as its log has it now. Its commits' manifests reach the driver, no more."""
    commits = _live(CommitLog(spark, f"{path}/commits").entries())
    if not commits:
        raise FileNotFoundError(f"no collection at {path}")
    return Collection(spark, path, commits)


def read_collection(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, dict[str, str]]:
    """rows (as they were given, without positions), datasets, facts. Where an id comes again in a later commit, rows don't tell
    which table they are of: open_collection() gives them with their positions."""
    c = open_collection(spark, path)
    return c.rows().drop("dataset_pos"), c.datasets(), c.facts


def compact_collection(spark: SparkSession, path: str, block_tables: int | None = None) -> None:
    """Rewrites the collection as one commit, positions as they are. For one that was appended to in small pieces."""
    while True:
        c = open_collection(spark, path)
        entry = {k: c.commits[0][k] for k in ("problem_type", "batch_size")} | {"mode": "overwrite", "n_classes": int(c.facts["max_num_classes"]) if "max_num_classes" in c.facts else None}
        if _commit(spark, path, lambda start, c=c: (c.rows(), c.datasets()), c.n_tables, entry, block_tables):
            return


def remove_unread(spark: SparkSession, path: str) -> list[str]:
    """Deletes what no live commit names: commits that were overwritten, and writes that failed. Not while another write runs."""
    log = CommitLog(spark, f"{path}/commits")
    named = {e["folder"] for e in _live(log.entries())}
    gone = {f for table in ("rows", "datasets") for f in log.folders(f"{path}/{table}") if f.removeprefix("commit=") not in named}
    for f in gone:
        for table in ("rows", "datasets"):
            log.delete(f"{path}/{table}/{f}")
    return sorted(f.removeprefix("commit=") for f in gone)


def probe(datasets: DataFrame, problem_type: str | None = None) -> DataFrame:
    """One row: n_tables, max_rows, max_features, max_classes (null where it isn't stored), has_n_rows, problem_type."""
    have = datasets.columns
    classes = F.max("n_classes") if "n_classes" in have else F.lit(None).cast("int")
    longest = F.max("n_rows") if "n_rows" in have else F.lit(None).cast("long")
    return datasets.agg(F.count("*").alias("n_tables"), longest.alias("max_rows"), F.max("n_features").alias("max_features"), classes.alias("max_classes")).select("*", F.lit("n_rows" in have).alias("has_n_rows"), F.lit(problem_type).alias("problem_type"))


def split_field(datasets: DataFrame) -> DataFrame:
    """datasets with split_index from whichever of the newer and the older field there is, the newer one first."""
    have = [c for c in ("train_test_split_index", "single_eval_pos") if c in datasets.columns]
    if not have:
        raise ValueError("neither train_test_split_index nor single_eval_pos")
    return datasets.withColumn("split_index", F.coalesce(*have)).drop(*have)


def scan_batches(rows: DataFrame, datasets: DataFrame, plan: DataFrame) -> DataFrame:
    """The rows of each batch of a plan, with batch_no and split_index. rows are found by dataset_pos if they have it (in a stored
    collection an id may come again), else by dataset_id."""
    if "dataset_pos" in rows.columns:
        return rows.join(plan.select("batch_no", "dataset_pos").join(datasets.select("dataset_pos", "split_index"), "dataset_pos"), "dataset_pos")
    tables = plan.select("batch_no", "dataset_pos").join(datasets.select("dataset_pos", "dataset_id", "split_index"), "dataset_pos").drop("dataset_pos")
    return rows.join(tables, "dataset_id")


def pad_collection(rows: DataFrame, max_rows: int, max_features: int) -> DataFrame:
    """Every table with max_rows rows and max_features features, zeros where there was nothing."""
    tables = rows.select("dataset_id").distinct()
    grid = tables.select("dataset_id", F.explode(F.sequence(F.lit(0), F.lit(max_rows - 1))).alias("row_idx"))
    d = grid.join(rows, ["dataset_id", "row_idx"], "left")
    x = F.coalesce(F.col("x"), F.array().cast("array<double>"))
    return d.select("dataset_id", "row_idx", pad(x, max_features).alias("x"), F.coalesce("y", F.lit(0.0)).alias("y"))


def trim_collection(padded: DataFrame, sizes: DataFrame) -> DataFrame:
    """The other way: rows and features up to n_rows and n_features. sizes: dataset_id (or batch_no) and these two."""
    key = "batch_no" if "batch_no" in sizes.columns else "dataset_id"
    d = padded.join(sizes.select(key, "n_rows", "n_features"), key).where(F.col("row_idx") < F.col("n_rows"))
    return d.withColumn("x", trim(F.col("x"), F.col("n_features").cast("int"))).drop("n_rows", "n_features")


def tables_first(nested: DataFrame) -> DataFrame:
    """Rows keyed by table, of batches laid out rows x tables. nested: batch_no, row_idx, tables (array of dataset_id, x, y)."""
    return nested.select("batch_no", "row_idx", F.explode("tables").alias("t")).select("batch_no", "t.dataset_id", "row_idx", "t.x", "t.y")


def rows_first(rows: DataFrame) -> DataFrame:
    """The layout that tables_first() undoes; a batch bounds the arrays."""
    return rows.groupBy("batch_no", "row_idx").agg(F.sort_array(F.collect_list(F.struct("dataset_id", "x", "y"))).alias("tables"))


def from_function(spark: SparkSession, get_batch: Callable[[int, int, int], dict], num_steps: int, batch_size: int, num_datapoints_max: int, num_features: int) -> DataFrame:
    """A collection from a user's function, one call a step: it returns x (tables, rows, features), y (tables, rows) and
    train_test_split_index, as arrays. Columns: step, ROWS, split_index; dataset_id is step * batch_size + place."""

    def run(steps: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in steps:
            for step in pdf["id"]:
                got = get_batch(batch_size, num_datapoints_max, num_features)
                for k, (x, y) in enumerate(zip(got["x"], got["y"], strict=True)):
                    yield pd.DataFrame({"step": step, "dataset_id": step * batch_size + k, "row_idx": range(len(y)), "x": [list(map(float, r)) for r in x], "y": [float(v) for v in y], "split_index": int(got["train_test_split_index"])})

    return spark.range(num_steps).mapInPandas(run, f"step long, {ROWS}, split_index int")

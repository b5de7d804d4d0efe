"""Streams: replaying a collection, scoring rows as they come, running epoch metrics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tabmill.sources.collections import open_collection, scan_batches
from tabmill.sources.datasource import register
from tabmill.sources.tasks import log_metrics


def replay(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1) -> DataFrame:
    """A stream of a stored table's rows, some files a micro-batch. Files come by age; inside one, order isn't kept, so what
    matters is in the rows (batch_no, row_idx), not in arrival."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


#: Tables that a trigger of a replay may hand on at once: their places go through the driver, their rows don't.
TRIGGER_TABLES = 8192


def replay_batches(spark: SparkSession, path: str, sink: Callable[[DataFrame, int], None], checkpoint: str, batch_size: int, num_steps: int, epochs: int = 1, start: int = 0, each: int = 1, at_once: int = 1) -> int:
    """Replays a stored collection in its order, `each` batches a micro-batch, and hands their rows (with batch_no, micro_batch and
    split_index) to sink. Goes on from the checkpoint's next batch, if there is one. Of the collection, the blocks that a trigger
    needs are read.

    A trigger takes `at_once` micro-batches in order, and sink gets its number: a trigger costs about a second whatever it holds,
    so a long replay is handed on in sets of micro-batches (TRIGGER_TABLES). Returns the number of triggers run."""
    register(spark)
    c = open_collection(spark, path)
    numbers = {"n_tables": c.n_tables, "batch_size": batch_size, "num_steps": num_steps, "epochs": epochs, "start": start, "batches_per_trigger": each * at_once}
    stream = spark.readStream.format("tabmill_batches").options(**{k: str(v) for k, v in numbers.items()}).load()
    ran = 0

    def one(plan: DataFrame, no: int) -> None:
        nonlocal ran
        places = plan.select("batch_no", "dataset_pos").collect()  # at_once * each * batch_size rows at most
        if not places:
            return
        ran += 1
        at = sorted({r.dataset_pos for r in places})
        edges = [k for k in range(len(at)) if not k or at[k] != at[k - 1] + 1]
        ranges = [(at[a], at[b - 1] + 1) for a, b in zip(edges, [*edges[1:], len(at)], strict=True)]
        own = spark.createDataFrame(places, "batch_no long, dataset_pos long")
        sink(scan_batches(c.rows(ranges), c.datasets(ranges), own).withColumn("micro_batch", F.floor(F.col("batch_no") / each)), no)

    q = stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return ran


def run_once(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Runs a stream over what there is now, handing each micro-batch to sink; waits for its end."""
    q = stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def score_stream(stream: DataFrame, transform: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Scores each micro-batch as a table of its own and hands it to sink: for models whose context is stored."""
    return run_once(stream, lambda df, no: sink(transform(df), no), checkpoint)


def to_table(path: str, mode: str = "append", name: str = "micro_batch") -> Callable[[DataFrame, int], None]:
    """A sink whose micro-batches are folders named by number, so that one that is run again replaces itself."""
    return lambda df, no: df.write.mode("overwrite").parquet(f"{path}/{name}={no}")


def running_losses(scored: DataFrame, num_steps: int) -> DataFrame:
    """run, epoch, n_batches, mean_loss as they grow. scored: a stream of run, batch_no, loss; for mode 'update' or 'complete'."""
    epoch = F.floor(F.col("batch_no") / num_steps).alias("epoch")
    return scored.groupBy("run", epoch).agg(F.count("*").alias("n_batches"), (F.sum("loss") / num_steps).alias("mean_loss"))


def to_metrics(path: str, source: str, keys: tuple[str, ...] = ("run", "epoch")) -> Callable[[DataFrame, int], None]:
    """A sink that logs each micro-batch's columns beside keys as metrics, once: a micro-batch that is run again under the same
    source is left as it is, and a later one's value of a (run, epoch, name) takes the place of an earlier one's."""

    def sink(df: DataFrame, no: int) -> None:
        names = [c for c in df.columns if c not in keys]
        if not log_metrics(df.select(*keys, *(F.col(c).cast("double").alias(c) for c in names)).unpivot(list(keys), names, "name", "value"), path, source, no):
            df.write.format("noop").mode("overwrite").save()  # a stream's state is committed by reading the micro-batch whole

    return sink


def at_epoch_end(hook: Callable[[DataFrame], None]) -> Callable[[DataFrame, int], None]:
    """A sink that hands a user's function each micro-batch's metrics."""
    return lambda df, no: hook(df)

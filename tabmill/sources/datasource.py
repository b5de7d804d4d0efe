"""Spark data sources in Python: a collection's batches by number, and a user's function by step. Both read as tables and as
streams; a stream's offset is the number of the next batch, so that it goes on from a checkpoint at any batch, in order.

A plan's rows are a few numbers a table. The tables' rows are read by Spark (replay_batches() in streaming/replay.py), from the
blocks that the batches at hand need.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

PLAN = "batch_no long, epoch long, step long, dataset_pos long"
STEPS = "step long, dataset_id long, row_idx int, x array<double>, y double, split_index int"


def plan_rows(batch_no: int, n_tables: int, batch_size: int, num_steps: int, start: int) -> Iterator[tuple[int, int, int, int]]:
    """One batch of batch_plan()."""
    first = -(-(n_tables - start) // batch_size)
    at = start + batch_no * batch_size if batch_no < first else (batch_no - first) % -(-n_tables // batch_size) * batch_size
    for pos in range(at, min(at + batch_size, n_tables)):
        yield batch_no, batch_no // num_steps, batch_no % num_steps, pos


class Slice(InputPartition):
    def __init__(self, lo: int, hi: int):
        super().__init__(lo)
        self.lo, self.hi = lo, hi


class _Reader(DataSourceReader):
    """Numbers below `total` in slices, each of which makes its rows in a task."""

    def __init__(self, rows: Callable[[int], Iterator[tuple]], total: int, slices: int):
        self.rows, self.total, self.slices = rows, total, max(1, min(slices, total))

    def partitions(self) -> list[Slice]:
        return [Slice(self.total * k // self.slices, self.total * (k + 1) // self.slices) for k in range(self.slices)]

    def read(self, partition: Slice) -> Iterator[tuple]:
        for no in range(partition.lo, partition.hi):
            yield from self.rows(no)


class _Stream(SimpleDataSourceStreamReader):
    """The same in order, `each` numbers a micro-batch. Its rows are made by the driver, so they are to be few."""

    def __init__(self, rows: Callable[[int], Iterator[tuple]], total: int, each: int):
        self.rows, self.total, self.each = rows, total, each

    def initialOffset(self) -> dict:
        return {"batch": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        end = {"batch": min(start["batch"] + self.each, self.total)}
        return self.readBetweenOffsets(start, end), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter([r for no in range(start["batch"], end["batch"]) for r in self.rows(no)])

    def commit(self, end: dict) -> None:
        pass


class BatchPlanSource(DataSource):
    """format("tabmill_batches"): PLAN rows. Options: n_tables, batch_size, num_steps, epochs (1), start (0), slices (8; tables),
    batches_per_trigger (1; streams)."""

    @classmethod
    def name(cls) -> str:
        return "tabmill_batches"

    def schema(self) -> str:
        return PLAN

    def _number(self, name: str, default: int | None = None) -> int:
        value = self.options.get(name, default)
        if value is None:
            raise ValueError(f"option {name} is missing")
        return int(value)

    def _rows(self) -> tuple[Callable[[int], Iterator[tuple]], int]:
        n, size, steps, start = self._number("n_tables"), self._number("batch_size"), self._number("num_steps"), self._number("start", 0)
        if n < 1 or size < 1 or steps < 1 or not 0 <= start < n:
            raise ValueError("n_tables, batch_size and num_steps must be at least 1, and start a place below n_tables")
        return (lambda no: plan_rows(no, n, size, steps, start)), steps * self._number("epochs", 1)

    def reader(self, schema) -> DataSourceReader:
        return _Reader(*self._rows(), self._number("slices", 8))

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _Stream(*self._rows(), self._number("batches_per_trigger", 1))


def function_source(source: str, get_batch: Callable[[int, int, int], dict]) -> type[DataSource]:
    """A source of a user's function under a name of its own: STEPS rows, as collections.from_function() gives them. Options:
    num_steps, batch_size, num_datapoints_max, num_features, slices (8), steps_per_trigger (1)."""

    class FunctionSource(DataSource):
        @classmethod
        def name(cls) -> str:
            return source

        def schema(self) -> str:
            return STEPS

        def _rows(self) -> tuple[Callable[[int], Iterator[tuple]], int]:
            o = self.options
            size, longest, width = (int(o[k]) for k in ("batch_size", "num_datapoints_max", "num_features"))

            def rows(step: int) -> Iterator[tuple]:
                got = get_batch(size, longest, width)
                for k, (x, y) in enumerate(zip(got["x"], got["y"], strict=True)):
                    for r, (row, target) in enumerate(zip(x, y, strict=True)):
                        yield step, step * size + k, r, [float(v) for v in row], float(target), int(got["train_test_split_index"])

            return rows, int(o["num_steps"])

        def reader(self, schema) -> DataSourceReader:
            return _Reader(*self._rows(), int(self.options.get("slices", 8)))

        def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
            return _Stream(*self._rows(), int(self.options.get("steps_per_trigger", 1)))

    return FunctionSource


def register(spark: SparkSession) -> None:
    spark.dataSource.register(BatchPlanSource)

"""Aggregates of a stream by event time that stay right whatever the order of arrival.

A micro-batch is folded to few rows and written under its own number, so a repeated batch overwrites itself. Its watermark
comes from the batches before it; rows of windows that were closed by then are late: they are counted apart and folded in
like all others, so what is read is what a batch job over all rows gives, and what was reported too early can be told.
No state is held between batches but these tables, so any batch may be run again after a crash.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MARK = "batch long, high timestamp, rows long, late long"


@dataclass
class EventTable:
    """A table of folded rows. `shape` turns a batch (with `at`, a timestamp) into rows of `schema` but `late`, with `ends`,
    when nothing more is expected for the row, and `n`, the rows it stands for. `fold` merges such rows, any number of times
    and in any order. There must be one writer at a time. Rows whose `at` is null take no part."""

    spark: SparkSession
    path: str
    shape: Callable[[DataFrame], DataFrame]
    fold: Callable[[DataFrame], DataFrame]
    delay: str
    schema: str

    def _marks(self) -> DataFrame:
        """A row for each finished batch."""
        self._make("marks", MARK)
        return self.spark.read.schema(MARK).parquet(f"{self.path}/marks/*")

    def _make(self, name: str, schema: str) -> None:
        """A first, empty part, so that there is always something to read."""
        self.spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{self.path}/{name}/none")

    def watermark(self, before: int | None = None):
        """The latest event time of all batches, or of those before one, less the delay; None if there is none."""
        done = self._marks() if before is None else self._marks().where(F.col("batch") < before)
        return done.select(F.max("high").alias("h")).select(F.col("h") - F.expr(f"INTERVAL {self.delay}")).first()[0]

    def merge(self, batch: DataFrame, k: int) -> None:
        mark = self.watermark(before=k)
        late = (F.col("ends") <= F.lit(mark)) if mark is not None else F.lit(False)
        rows = self.shape(batch.where("at IS NOT NULL")).withColumn("late", F.when(late, F.col("n")).otherwise(0).cast("long"))
        self.fold(rows).write.mode("overwrite").parquet(f"{self.path}/parts/{k}")
        held = self.spark.read.parquet(f"{self.path}/parts/{k}").agg(F.sum("n").alias("rows"), F.sum("late").alias("late"))
        high = batch.agg(F.max("at").alias("high"))
        one = high.crossJoin(F.broadcast(held)).select(F.lit(k).cast("long").alias("batch"), "high", F.coalesce("rows", F.lit(0)).cast("long").alias("rows"), F.coalesce("late", F.lit(0)).cast("long").alias("late"))  # a row each
        one.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/marks/{k}")

    def compact(self) -> None:
        """Fold all finished batches into one part, which then stands for them."""
        upto = self._marks().agg(F.max("batch")).first()[0]
        if upto is None or upto == self._folded():
            return
        self._rows().write.mode("overwrite").parquet(f"{self.path}/folded/{upto}")
        self.spark.range(1).select(F.lit(upto).cast("long").alias("upto")).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/folds/{upto}")

    def _folded(self) -> int | None:
        self._make("folds", "upto long")
        return self.spark.read.schema("upto long").parquet(f"{self.path}/folds/*").agg(F.max("upto")).first()[0]

    def _rows(self) -> DataFrame:
        """Finished batches only: what a crash left behind is not read."""
        upto = self._folded()
        done = self._marks().select("batch").where(F.col("batch") > (-1 if upto is None else upto))
        # One number for each batch since the last compaction.
        paths = [f"{self.path}/parts/{r['batch']}" for r in done.collect()] + ([] if upto is None else [f"{self.path}/folded/{upto}"])
        found = self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)
        return self.fold(found)

    def read(self) -> DataFrame:
        """All rows so far, late ones folded in; `late` says how many came after their window had closed."""
        return self._rows()

    def closed(self) -> DataFrame:
        """The rows that the watermark has passed."""
        return self._rows().where(F.col("ends") <= F.lit(self.watermark()))

    def progress(self) -> DataFrame:
        return self._marks()


def windows(every: str, by: list[str], sums: dict[str, Column], slide: str | None = None):
    """shape and fold of tumbling or sliding windows: `w_start`, the keys, n and the sums of the given columns, and schema."""

    def shape(batch: DataFrame) -> DataFrame:
        w = batch.select(F.window("at", every, slide).alias("w"), *by, *[c.cast("long").alias(name) for name, c in sums.items()])
        return w.select(F.col("w.start").alias("w_start"), F.col("w.end").alias("ends"), *by, F.lit(1).cast("long").alias("n"), *sums)

    def fold(rows: DataFrame) -> DataFrame:
        return rows.groupBy("w_start", "ends", *by).agg(*[F.sum(c).alias(c) for c in ("n", *sums, "late")])

    return shape, fold, ", ".join(["w_start timestamp", "ends timestamp", *[f"{c} string" for c in by], "n long", *[f"{c} long" for c in sums], "late long"])


def sessions(gap: str, by: str):
    """shape and fold of sessions of a key: events no further than the gap from the one before belong together.

    Rows of a key are first merged by slots as long as the gap, within which all belong together; so a key with any number
    of rows has at most one row for each slot of its time when its slots are put in order.
    """
    length = F.expr(f"INTERVAL {gap}")
    seconds = F.timestamp_diff("SECOND", F.timestamp_seconds(F.lit(0)), F.timestamp_seconds(F.lit(0)) + length)

    def shape(batch: DataFrame) -> DataFrame:
        return batch.select(by, F.col("at").alias("first"), F.col("at").alias("last"), (F.col("at") + length).alias("ends"), F.lit(1).cast("long").alias("n"))

    def fold(rows: DataFrame) -> DataFrame:
        slot = F.floor(F.unix_micros("first") / (seconds * F.lit(1_000_000)))
        merged = rows.groupBy(by, slot.alias("slot")).agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n"), F.sum("late").alias("late"))
        order = Window.partitionBy(by).orderBy("first", "last")
        before = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
        new = F.when(before.isNull() | (F.col("first") > before + length), 1).otherwise(0)
        number = F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0))
        joined = merged.withColumn("new", new).withColumn("k", number).groupBy(by, "k").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n"), F.sum("late").alias("late"))
        return joined.select(by, "first", "last", (F.col("last") + length).alias("ends"), "n", "late")

    return shape, fold, f"{by} string, first timestamp, last timestamp, ends timestamp, n long, late long"

"""Windows over a total order whatever the size of a key: numbering, neighbours and running values.

A Spark window puts all rows of its partition key into one task. Here rows are range-partitioned by the whole order, so
a key with a third of all rows spreads over many tasks, and each row gets its global position from the row counts of the
partitions before it. Positions then cut the table into blocks of equal size: neighbours come from a window within a
block, which also gets copies of the last and first rows of the blocks beside it; running values come from a window
within a block and the totals of the blocks before it, one small row each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemolake.plans.storage import materialize

BLOCK_ROWS = 1 << 16

AGGREGATES = {"sum": F.sum, "max": F.max, "min": F.min}
_ROWS = (1 << 33) - 1  # monotonically_increasing_id() has the row's number within its partition in the lower 33 bits


def positions(df: DataFrame, *order: str | Column) -> DataFrame:
    """df with pos, the row's place (from 0) in the order of all rows, as a written table. Ties must not be: end with a unique column.

    The counts of the partitions, a row each, are summed in one task.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    x = materialize(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("_at", 33).alias("_part")
    counts = x.groupBy(part).agg(F.count("*").alias("_n"))
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    return x.withColumn("_part", part).join(F.broadcast(before), "_part").withColumn("pos", F.col("_before") + F.col("_at").bitwiseAND(F.lit(_ROWS))).drop("_part", "_at", "_before")


def _block(size: int) -> Column:
    return F.floor(F.col("pos") / size)


def neighbours(df: DataFrame, look: dict[str, tuple[str, int]], size: int = BLOCK_ROWS) -> DataFrame:
    """df, which has pos, with further columns: look gives each new one's source column and how many rows away it lies
    (below 0: before). Beyond the ends they are null. A row has copies only in blocks that it is a neighbour of."""
    back, ahead = max(0, *(-d for _, d in look.values())), max(0, *(d for _, d in look.values()))
    size = max(size, back, ahead, 1)
    at = F.col("pos") % size
    own = F.struct(_block(size).alias("block"), F.lit(True).alias("own"))
    later = F.when(at >= size - back, F.struct((_block(size) + 1).alias("block"), F.lit(False).alias("own"))) if back else None
    earlier = F.when(at < ahead, F.struct((_block(size) - 1).alias("block"), F.lit(False).alias("own"))) if ahead else None
    copies = F.filter(F.array(own, *[c for c in (later, earlier) if c is not None]), lambda c: c.isNotNull())
    w = Window.partitionBy("_b.block").orderBy("pos")
    x = df.withColumn("_b", F.explode(copies))
    x = x.select("*", *[(F.lag(c, -d) if d < 0 else F.lead(c, d)).over(w).alias(name) for name, (c, d) in look.items()])
    return x.where("_b.own").drop("_b")


def running(df: DataFrame, values: dict[str, tuple[str, Column]], size: int = BLOCK_ROWS) -> DataFrame:
    """df, which has pos, with further columns: the "sum", "min" or "max" of a column over all rows up to the row.

    The totals of the blocks, a row for each, are carried on in one task; rows themselves never meet there.
    """
    x = df.withColumn("_block", _block(size))
    names = list(values)
    w = Window.partitionBy("_block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    kinds = {name: AGGREGATES[kind] for name, (kind, _) in values.items()}
    local = x.select("*", *[kinds[name](c).over(w).alias(f"_l_{name}") for name, (_, c) in values.items()])
    totals = x.groupBy("_block").agg(*[kinds[name](c).alias(f"_t_{name}") for name, (_, c) in values.items()])
    ahead = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select("_block", *[kinds[name](F.col(f"_t_{name}")).over(ahead).alias(f"_c_{name}") for name in names])
    joined = local.join(carried, "_block", "left")
    return joined.select(*df.columns, *[_combined(kinds[name], f"_c_{name}", f"_l_{name}").alias(name) for name in names])


def _combined(kind, carried: str, local: str) -> Column:
    if kind is F.sum:
        return F.coalesce(F.col(carried) + F.col(local), F.col(local), F.col(carried))
    return (F.greatest if kind is F.max else F.least)(F.col(carried), F.col(local))


def numbered(df: DataFrame, keys: list[str], *order: str, size: int = BLOCK_ROWS) -> DataFrame:
    """df with pos and number, the row's place (from 1) among the rows of its keys in the order. A row of a null key counts with those of the same null."""
    x = positions(df, *keys, *order)
    x = neighbours(x, {f"_k{i}": (k, -1) for i, k in enumerate(keys)}, size) if keys else x
    first = F.col("pos") == 0
    for i, k in enumerate(keys):
        first = first | ~F.col(k).eqNullSafe(F.col(f"_k{i}"))
    x = running(x.withColumn("_first", F.when(first, F.col("pos"))), {"_start": ("max", F.col("_first"))}, size)
    return x.withColumn("number", F.col("pos") - F.col("_start") + 1).drop("_first", "_start", *[f"_k{i}" for i in range(len(keys))])


def within_key(df: DataFrame, keys: list[str], order: list[str], look: dict[str, tuple[str, int]], size: int = BLOCK_ROWS) -> DataFrame:
    """df with pos and neighbours in the order within equal keys: those of another key are null."""
    x = positions(df, *keys, *order)
    steps = sorted({d for _, d in look.values()})
    keyed = {f"_k{i}_{d}".replace("-", "b"): (k, d) for i, k in enumerate(keys) for d in steps}
    x = neighbours(x, {**look, **keyed}, size)
    for name, (_, d) in look.items():
        same = F.lit(True)
        for i, k in enumerate(keys):
            same = same & F.col(k).eqNullSafe(F.col(f"_k{i}_{d}".replace("-", "b")))
        x = x.withColumn(name, F.when(same, F.col(name)))
    return x.drop(*keyed)

"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemolake.plans.storage import materialize


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for every node that an edge names; component is the smallest node reachable.

    The edge count never grows, every round is a few equi-joins and minima, and its result is a written table,
    so neither the driver nor one task holds a component. Null ends and loops are left out.
    """
    given = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    now = materialize(given.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges")
    mark = None
    while True:
        digest = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if digest == mark or digest["n"] == 0:
            break
        mark = digest
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        now = materialize(small.select("e.u", "e.v").where("u <> v").distinct(), "edges")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()

"""The library's tables as views of the driver's Parquet tables, in Spark and in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2024-02-01 00:00:00"
HALLS = ["hall_facts", "hall_events", "hall_discoveries", "hall_preferences", "hall_advice", "hall_concepts", "hall_relations"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _text(c) -> F.Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def memory(spark, d):
    doc = F.col("doc_id")
    return read(spark, d, "documents").select(
        _text("doc_id").alias("id"),
        F.col("text").alias("content"),
        F.col("lang").alias("wing"),
        F.col("source").alias("room"),
        F.element_at(F.array(*map(F.lit, HALLS)), (doc % 7 + 1).cast("int")).alias("hall"),
        ((10 + (doc * 7) % 41).cast("double") / 10).alias("importance"),
        (((doc * 13) % 21 - 10).cast("double") / 10).alias("emotional_weight"),
        F.array("lang", "source", F.concat(F.lit("t"), _text(doc % 5))).alias("tags"),
        F.concat(F.lit("a"), _text(doc % 5)).alias("author"),
        (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(mins=((doc * 37) % 43200).cast("int"))).alias("created_at"),
    )


def vector(spark, d):
    return read(spark, d, "embeddings").select(_text("vec_id").alias("id"), F.col("embedding").alias("v"), "label")


def access_log(spark, d):
    n = read(spark, d, "documents").agg(F.count("*").alias("n_documents"))
    e = read(spark, d, "events").crossJoin(F.broadcast(n))  # one row
    return e.select("event_id", "ts", F.concat(F.lit("u"), _text("user_id")).alias("user_id"), F.col("event_type").alias("operation"), _text(F.col("event_id") % F.col("n_documents")).alias("memory_id"), (F.col("value") * 20).alias("duration_ms"), (F.col("event_type") != "error").alias("success"))


def message(spark, d):
    return read(spark, d, "conversations").select(_text("conv_id").alias("session_id"), "turn", "role", "text")


def vote(spark, d):
    kind = F.when(F.col("event_type") == "click", "up").when(F.col("event_type") == "error", "down").otherwise("bookmark")
    return read(spark, d, "events").where(F.col("event_type").isin("click", "error", "view")).select(_text(F.col("event_id") % 97).alias("memory_id"), F.concat(F.lit("u"), _text("user_id")).alias("user_id"), kind.alias("vote_type"), "ts")


def entity(spark, d):
    parts = [("region", "r"), ("nation", "n"), ("supplier", "s"), ("customer", "c")]
    keys = {"region": "r_regionkey", "nation": "n_nationkey", "supplier": "s_suppkey", "customer": "c_custkey"}
    out = None
    for t, p in parts:
        one = read(spark, d, t).select(F.concat(F.lit(p), _text(keys[t])).alias("id"), F.col(f"{p}_name").alias("name"), F.lit(t).alias("type"))
        out = one if out is None else out.unionByName(one)
    return out


def relation(spark, d):
    def tag(p, c):
        return F.concat(F.lit(p), _text(c))

    none = F.lit(None).cast("timestamp_ntz")

    def fixed(t, subject, predicate, obj, key):
        return read(spark, d, t).select(subject.alias("subject_id"), F.lit(predicate).alias("predicate"), obj.alias("object_id"), ((F.col(key) % 10).cast("double") / 10).alias("confidence"), none.alias("valid_from"), none.alias("valid_until"))

    sold = read(spark, d, "lineitem").select("l_orderkey", "l_suppkey").join(read(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("l_suppkey", "o_custkey").agg(F.min("o_orderdate").cast("timestamp_ntz").alias("valid_from"), F.max("o_orderdate").cast("timestamp_ntz").alias("valid_until"))
    causes = sold.select(tag("s", "l_suppkey").alias("subject_id"), F.lit("causes").alias("predicate"), tag("c", "o_custkey").alias("object_id"), (((F.col("l_suppkey") + F.col("o_custkey")) % 10).cast("double") / 10).alias("confidence"), "valid_from", "valid_until")
    out = (
        fixed("nation", tag("n", "n_nationkey"), "depends_on", tag("r", "n_regionkey"), "n_nationkey")
        .unionByName(fixed("supplier", tag("s", "s_suppkey"), "related_to", tag("n", "s_nationkey"), "s_suppkey"))
        .unionByName(fixed("customer", tag("c", "c_custkey"), "enables", tag("n", "c_nationkey"), "c_custkey"))
        .unionByName(causes)
    )
    return out.select(F.concat_ws("|", "subject_id", "predicate", "object_id").alias("id"), "*")


SPARK = {f.__name__: f for f in (memory, vector, access_log, message, vote, entity, relation)}

DUCKDB = {
    "memory": """SELECT CAST(doc_id AS VARCHAR) AS id, text AS content, lang AS wing, source AS room,
  (['hall_facts','hall_events','hall_discoveries','hall_preferences','hall_advice','hall_concepts','hall_relations'])[CAST(doc_id % 7 + 1 AS INT)] AS hall,
  CAST(10 + (doc_id * 7) % 41 AS DOUBLE) / 10 AS importance, CAST((doc_id * 13) % 21 - 10 AS DOUBLE) / 10 AS emotional_weight,
  [lang, source, concat('t', CAST(doc_id % 5 AS VARCHAR))] AS tags, concat('a', CAST(doc_id % 5 AS VARCHAR)) AS author,
  TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST((doc_id * 37) % 43200 AS INT)) AS created_at FROM documents""",
    "vector": "SELECT CAST(vec_id AS VARCHAR) AS id, embedding AS v, label FROM embeddings",
    "access_log": """SELECT event_id, ts, concat('u', CAST(user_id AS VARCHAR)) AS user_id, event_type AS operation,
  CAST(event_id % (SELECT count(*) FROM documents) AS VARCHAR) AS memory_id, value * 20 AS duration_ms, event_type <> 'error' AS success FROM events""",
    "message": "SELECT CAST(conv_id AS VARCHAR) AS session_id, turn, role, text FROM conversations",
    "vote": """SELECT CAST(event_id % 97 AS VARCHAR) AS memory_id, concat('u', CAST(user_id AS VARCHAR)) AS user_id,
  CASE event_type WHEN 'click' THEN 'up' WHEN 'error' THEN 'down' ELSE 'bookmark' END AS vote_type, ts FROM events WHERE event_type IN ('click', 'error', 'view')""",
    "entity": """SELECT concat('r', CAST(r_regionkey AS VARCHAR)) AS id, r_name AS name, 'region' AS type FROM region
  UNION ALL SELECT concat('n', CAST(n_nationkey AS VARCHAR)), n_name, 'nation' FROM nation
  UNION ALL SELECT concat('s', CAST(s_suppkey AS VARCHAR)), s_name, 'supplier' FROM supplier
  UNION ALL SELECT concat('c', CAST(c_custkey AS VARCHAR)), c_name, 'customer' FROM customer""",
    "relation": """SELECT concat_ws('|', subject_id, predicate, object_id) AS id, * FROM (
  SELECT concat('n', CAST(n_nationkey AS VARCHAR)) AS subject_id, 'depends_on' AS predicate, concat('r', CAST(n_regionkey AS VARCHAR)) AS object_id,
    CAST(n_nationkey % 10 AS DOUBLE) / 10 AS confidence, CAST(NULL AS TIMESTAMP) AS valid_from, CAST(NULL AS TIMESTAMP) AS valid_until FROM nation
  UNION ALL SELECT concat('s', CAST(s_suppkey AS VARCHAR)), 'related_to', concat('n', CAST(s_nationkey AS VARCHAR)), CAST(s_suppkey % 10 AS DOUBLE) / 10, NULL, NULL FROM supplier
  UNION ALL SELECT concat('c', CAST(c_custkey AS VARCHAR)), 'enables', concat('n', CAST(c_nationkey AS VARCHAR)), CAST(c_custkey % 10 AS DOUBLE) / 10, NULL, NULL FROM customer
  UNION ALL SELECT concat('s', CAST(l_suppkey AS VARCHAR)), 'causes', concat('c', CAST(o_custkey AS VARCHAR)),
    CAST((l_suppkey + o_custkey) % 10 AS DOUBLE) / 10, min(o_orderdate), max(o_orderdate) FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_suppkey, o_custkey) e""",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return SPARK[name](spark, sf_dir) if name in SPARK else read(spark, sf_dir, name)

"""Structured Streaming forms of ingest, indexing, event counts, sessions, alerts, focus and change feeds.

Every stream is written for a directory of Parquet files that arrive; the registered queries run it to the end over the
given table (trigger availableNow) with its checkpoint in the shared folder, and return what the sink holds.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemolake.functions.columns import count, moment, n, r6
from mnemolake.operators.ingest import _MI, message_importance
from mnemolake.operators.search import record_tokens
from mnemolake.operators.similarity import KNOWN
from mnemolake.plans.registry import query
from mnemolake.plans.storage import materialize
from mnemolake.sources.buckets import BucketTable
from mnemolake.sources.files import scratch
from mnemolake.streaming.event_time import EventTable, sessions, windows
from mnemolake.streaming.focus import Focus, PackedFocus


def as_stream(df: DataFrame, per_trigger: int | None = 1_000) -> DataFrame:
    """df written as files to the shared folder and read as a stream of them; per_trigger None makes them one micro-batch, in which no event is late whatever the order of files."""
    path = scratch(df, "stream-in")
    df.write.parquet(path)
    reader = df.sparkSession.readStream.schema(df.schema)
    return (reader if per_trigger is None else reader.option("maxFilesPerTrigger", per_trigger)).parquet(path)


def to_end(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over what is there into Parquet files (append) and read these."""
    out, mark = scratch(stream, "stream-out"), scratch(stream, "stream-mark")
    q = stream.writeStream.outputMode(mode).format("parquet").option("path", out).option("checkpointLocation", mark).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


def each_batch(stream: DataFrame, act: Callable[[DataFrame, int], None]) -> None:
    """Run act on every micro-batch to the end of what is there."""
    q = stream.writeStream.foreachBatch(act).option("checkpointLocation", scratch(stream, "stream-mark")).trigger(availableNow=True).start()
    q.awaitTermination()


def ingested(messages: DataFrame, least: float = 0.4) -> DataFrame:
    """Messages worth keeping, batch or stream."""
    return messages.withColumn("importance", r6(message_importance("text", "role"))).where(F.col("importance") >= least).select("session_id", "turn", "role", F.md5("text").alias("key"), "importance")


@query("l1_stream_ingest", "message", f"SELECT session_id, turn, role, md5(text) AS key, round(({_MI})::DOUBLE, 6) AS importance FROM message WHERE round(({_MI})::DOUBLE, 6) >= 0.4")
def stream_ingest(message: DataFrame) -> DataFrame:
    """New message files ingested once; the source log is the ledger."""
    return to_end(ingested(as_stream(message)))


@query("l2_stream_index", "memory", "SELECT tok, count(*) AS df FROM (SELECT DISTINCT id, tok FROM (SELECT id, unnest(list_distinct(regexp_extract_all(lower(content), '[\\x{4e00}-\\x{9fff}]+|[a-z0-9_]{2,}'))) AS tok FROM memory UNION ALL SELECT id, lower(unnest(tags)) FROM memory)) GROUP BY tok HAVING count(*) >= 50")
def stream_index(memory: DataFrame, least: int = 50) -> DataFrame:
    """The token index built from a stream in which records repeat: unseen ids only, each batch written under its own number, so a repeated batch overwrites itself.

    The index holds a record's tokens as one row. An id that has outlived the watermark may come to it twice, so ids are counted
    first; only the tokens of such ids are made distinct, all others are counted as they are read.
    """
    twice = memory.unionByName(memory.where(F.col("id").cast("long") % 3 == 0)).select("id", "content", "tags", "created_at")
    s = as_stream(twice).withColumn("at", F.col("created_at").cast("timestamp")).withWatermark("at", "40 days").dropDuplicatesWithinWatermark(["id"])
    out = scratch(memory, "index")
    each_batch(s, lambda batch, k: batch.select("id", record_tokens().alias("toks")).write.mode("overwrite").parquet(f"{out}/batch={k}"))
    return document_counts(memory.sparkSession.read.parquet(out).select("id", "toks")).where(F.col("df") >= least)


def document_counts(index: DataFrame) -> DataFrame:
    """(tok, df) of an index (id, toks): how many ids hold each token, whatever rows an id has."""
    several = materialize(index.groupBy("id").agg(F.count("*").alias("rows")).where("rows > 1").select("id"), "repeated-ids")
    each = index.select("id", F.explode("toks").alias("tok"))
    if many := several.count():
        same, several = index["id"].eqNullSafe(several["id"]), F.broadcast(several) if many <= KNOWN else several
        one, more = (index.join(several, same, how).select("id", F.explode("toks").alias("tok")) for how in ("left_anti", "left_semi"))
        each = one.unionByName(more.distinct())
    return each.groupBy("tok").agg(count().alias("df"))


def event_counts(events: DataFrame, window: str = "1 hour") -> DataFrame:
    """Counts by window and operation; batch and stream use this one function."""
    return events.groupBy(F.window("at", window).alias("w"), "operation").agg(count().alias("n"))


def _flat(df: DataFrame) -> DataFrame:
    return df.select(F.date_format("w.start", "yyyy-MM-dd HH:mm").alias("start"), "operation", "n")


_TUMBLE = "SELECT strftime(time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01'), '%Y-%m-%d %H:%M') AS start, operation, count(*) AS n FROM access_log{0} GROUP BY 1, 2"


@query("l3_stream_event_counts", "access_log", _TUMBLE.format(""))
def stream_event_counts(access_log: DataFrame) -> DataFrame:
    """Tumbling counts of a stream with a watermark; a last event far ahead closes the windows and is left out."""
    far = access_log.limit(1).withColumn("ts", moment("2030-01-01 00:00:00"))
    s = as_stream(access_log.unionByName(far), None).withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", "2 days")
    return _flat(to_end(event_counts(s, "6 hours"))).where("start < '2029'")


@query("l4_replay_since", "access_log", _TUMBLE.format(" WHERE ts >= TIMESTAMP '2024-01-20 00:00:00'"), since="2024-01-20 00:00:00")
def replay_since(access_log: DataFrame, since: str) -> DataFrame:
    """Stored events since a moment through the same transformation, as a batch."""
    return _flat(event_counts(access_log.where(F.col("ts") >= moment(since)).withColumn("at", F.col("ts").cast("timestamp")), "6 hours"))


_SESSIONS = """
WITH f AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts > lag(ts) OVER w + INTERVAL 2 HOUR THEN 1 ELSE 0 END AS new FROM access_log WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM f)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, k
"""


@query("l5_stream_sessions", "access_log", _SESSIONS, gap="2 hours")
def stream_sessions(access_log: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Sessions of users in a stream: no event for longer than the gap ends one."""
    far = access_log.limit(1).withColumn("ts", moment("2030-01-01 00:00:00")).withColumn("user_id", F.lit("_end"))
    s = as_stream(access_log.unionByName(far), None).withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", "2 days")
    done = to_end(s.groupBy(F.session_window("at", gap).alias("w"), "user_id").agg(count().alias("n")))
    return done.where("user_id <> '_end'").select("user_id", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@query("l6_stream_thresholds", "memory")
def stream_thresholds(memory: DataFrame, steps: tuple[tuple[int, str], ...] = ((10, "fuse"), (20, "compress"), (50, "consolidate"))) -> DataFrame:
    """What each micro-batch sets off, by the number of new records in it; actions are named here, their operators are in the lifecycle area.

    Counting needs the records' ids only, so no text is dealt to the few files that make the batches.
    """
    spark, out = memory.sparkSession, scratch(memory, "actions")

    def act(batch: DataFrame, k: int) -> None:
        size = batch.agg(count().alias("records"))
        due = F.filter(F.array(*[F.when(F.col("records") >= least, F.lit(name)) for least, name in steps]), lambda x: x.isNotNull())
        size.select(F.lit(k).cast("long").alias("batch"), "records", F.array_join(due, ",").alias("actions")).write.mode("overwrite").parquet(f"{out}/b={k}")

    each_batch(as_stream(memory.select("id").repartition(4, "id"), 1), act)
    return spark.read.schema("batch long, records long, actions string").parquet(f"{out}/*")


def audit_alerts(events: DataFrame, slow_ms: float = 300.0) -> DataFrame:
    """Sliding windows with many failures or slow operations."""
    w = events.groupBy(F.window("at", "2 hours", "1 hour").alias("w")).agg(count().alias("n"), n(~F.col("success")).alias("failed"), n(F.col("duration_ms") > slow_ms).alias("slow"))
    return w.where((F.col("failed") > 0.25 * F.col("n")) | (F.col("slow") > 0.5 * F.col("n")))


_ALERTS = """
WITH e AS (SELECT unnest([time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01'), time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01') - INTERVAL 1 HOUR]) AS s, success, duration_ms FROM access_log),
w AS (SELECT s, count(*) AS n, count(*) FILTER (NOT success) AS failed, count(*) FILTER (duration_ms > 300) AS slow FROM e GROUP BY s) SELECT strftime(s, '%Y-%m-%d %H:%M') AS start, n, failed, slow FROM w WHERE failed > 0.25 * n OR slow > 0.5 * n
"""


@query("l7_stream_audit_alerts", "access_log", _ALERTS)
def stream_audit_alerts(access_log: DataFrame) -> DataFrame:
    """audit_alerts over a stream."""
    far = access_log.limit(1).withColumn("ts", moment("2030-01-01 00:00:00"))
    s = as_stream(access_log.unionByName(far), None).withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", "2 days")
    return to_end(audit_alerts(s)).select(F.date_format("w.start", "yyyy-MM-dd HH:mm").alias("start"), "n", "failed", "slow").where("start < '2029'")


def event_table(access_log: DataFrame, kind: tuple, delay: str, slices: int, at_once: int) -> EventTable:
    """The log arrives as files of time slices, some at a time and in no order, and is merged batch by batch."""
    shape, fold, schema = kind
    table = EventTable(access_log.sparkSession, scratch(access_log, "event-time"), shape, fold, delay, schema)
    files = access_log.withColumn("at", F.col("ts").cast("timestamp")).repartitionByRange(slices, "at")
    each_batch(as_stream(files, at_once), table.merge)
    return table


@query("l3_counts_with_late", "access_log", _TUMBLE.format(""))
def counts_with_late(access_log: DataFrame, slices: int = 8, at_once: int = 2) -> DataFrame:
    """Tumbling counts over many micro-batches, late rows folded in."""
    counts = event_table(access_log, windows("6 hours", ["operation"], {}), "2 days", slices, at_once).read()
    return counts.select(F.date_format("w_start", "yyyy-MM-dd HH:mm").alias("start"), "operation", "n")


@query("l5_sessions_with_late", "access_log", _SESSIONS)
def sessions_with_late(access_log: DataFrame, gap: str = "2 hours", slices: int = 8, at_once: int = 2) -> DataFrame:
    """Sessions over many micro-batches: a late event may lengthen a session or join two that were reported apart."""
    table = event_table(access_log, sessions(gap, "user_id"), "2 days", slices, at_once)
    table.compact()
    return table.read().select("user_id", F.date_format("first", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@query("l7_alerts_with_late", "access_log", _ALERTS)
def alerts_with_late(access_log: DataFrame, slow_ms: float = 300.0, slices: int = 8, at_once: int = 2) -> DataFrame:
    """Sliding windows with many failures or slow operations over many micro-batches, late rows folded in."""
    sums = {"failed": F.when(~F.col("success"), 1).otherwise(0), "slow": F.when(F.col("duration_ms") > slow_ms, 1).otherwise(0)}
    w = event_table(access_log, windows("2 hours", [], sums, "1 hour"), "2 days", slices, at_once).read()
    return w.where((F.col("failed") > 0.25 * F.col("n")) | (F.col("slow") > 0.5 * F.col("n"))).select(F.date_format("w_start", "yyyy-MM-dd HH:mm").alias("start"), "n", "failed", "slow")


@query("l8_focus_buffer", "message")
def focus_buffer(message: DataFrame) -> DataFrame:
    """The focus of every session at the end of a stream of messages; state is bounded per session."""
    spark = message.sparkSession
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        s = as_stream(message).select("session_id", "turn", message_importance("text", "role").alias("importance"))
        out = s.groupBy("session_id").transformWithStateInPandas(Focus(), "session_id string, turn long, activation double", "Append", "None")
        return to_end(out).select("session_id", "turn", r6("activation").alias("activation"))
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def in_slices(df: DataFrame, at: str, slices: int, end: DataFrame | None = None) -> DataFrame:
    """df as a stream of files that arrive in order of time, one slice of it after the other and `end` last, a file a micro-batch.

    df is computed once; slices are cut from what that wrote, which the file of each is copied from.
    """
    path, df = scratch(df, "stream-in"), materialize(df, "timed")
    lo, hi = df.select(F.min(F.unix_micros(at)), F.max(F.unix_micros(at))).first()
    width = max(1, ((hi or 0) - (lo or 0)) // slices + 1)
    number = F.floor((F.unix_micros(at) - F.lit(lo or 0)) / F.lit(width))
    for i in range(slices):  # a stated number of files, written one after the other
        df.where(number == i).coalesce(1).write.mode("append").parquet(path)
    if end is not None:
        end.select(*df.columns).coalesce(1).write.mode("append").parquet(path)
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def timed(message: DataFrame) -> DataFrame:
    """Turns with a time of their own, later turns further apart, their importance and feeling."""
    minutes = F.col("session_id").cast("long") * 7 % 1000 + 3 * F.col("turn") * F.col("turn")
    at = F.timestamp_seconds(F.lit(1_704_067_200) + 60 * minutes)
    feeling = F.least(F.lit(1.0), 0.2 * F.regexp_count("text", F.lit("[!?]")))
    return message.select("session_id", F.col("turn").cast("long").alias("turn"), at.alias("at"), F.unix_millis(at).alias("at_ms"), message_importance("text", "role").cast("double").alias("importance"), F.coalesce(feeling, F.lit(0.0)).alias("valence"))


@query("l8_focus_with_time", "message")
def focus_with_time(message: DataFrame, size: int = 5, idle_minutes: int = 30, slices: int = 6) -> DataFrame:
    """What each session held when it fell idle: turns in focus that fade with event time, the weakest leaving a full buffer.

    The stream ends with an event far ahead, whose watermark makes the last sessions leave the store.
    """
    spark, name = message.sparkSession, "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        turns = timed(message)
        far = spark.range(1).select(F.lit("_end").alias("session_id"), F.lit(0).cast("long").alias("turn"), F.timestamp_seconds(F.lit(1_900_000_000)).alias("at"), F.lit(1_900_000_000_000).cast("long").alias("at_ms"), F.lit(0.0).alias("importance"), F.lit(0.0).alias("valence"))
        s = in_slices(turns, "at", slices, far)
        out = s.withWatermark("at", "10 minutes").groupBy("session_id").transformWithState(PackedFocus(size, idle_minutes), "session_id string, last_ms long, turn long, activation double", "Append", "EventTime")
        return to_end(out).where("session_id <> '_end'").select("session_id", "last_ms", "turn", r6("activation").alias("activation"))
    finally:
        spark.conf.set(name, before)


@query("l9_stream_changes", "access_log", "SELECT memory_id, arg_max(operation, (ts, event_id)) AS operation, max(event_id) FILTER (ts IS NOT NULL) AS last_event FROM access_log GROUP BY memory_id")
def stream_changes(access_log: DataFrame) -> DataFrame:
    """A change feed merged batch by batch into a table of buckets, the latest change of a record winning: a batch rewrites the
    buckets it touches only, and one that is repeated changes nothing."""
    schema = "memory_id string, operation string, ts timestamp_ntz, event_id long, last_event long"
    table = BucketTable(access_log.sparkSession, scratch(access_log, "changes"), schema, "memory_id", ["ts", "event_id"], buckets=16, most=["last_event"])

    def act(batch: DataFrame, k: int) -> None:
        table.merge(batch.select("memory_id", "operation", "ts", "event_id", F.col("event_id").alias("last_event")), k)

    each_batch(as_stream(access_log.repartition(3, "event_id"), 1), act)
    return table.read().select("memory_id", "operation", "last_event")

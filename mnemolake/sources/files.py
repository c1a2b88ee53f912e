"""Readers, writers, splitters, snapshots and ledgers of record files."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnemolake.functions.columns import count, r6
from mnemolake.operators.ingest import redacted
from mnemolake.plans.registry import query
from mnemolake.plans.storage import materialize, shared_dir

WINGS = 100_000  # that are broadcast, at most
RECORD = "id string, content string, wing string, room string, hall string, importance double, emotional_weight double, source_file string, tags array<string>, author string, created_at string, metadata map<string, string>"
DEFAULTS = {"wing": "default", "room": "general", "hall": "hall_facts", "importance": 3.0, "emotional_weight": 0.0, "source_file": "", "author": ""}


def with_defaults(df: DataFrame) -> DataFrame:
    """Missing values of a record filled, its time parsed (null where it can't be)."""
    out = df.withColumns({k: F.coalesce(k, F.lit(v)) for k, v in DEFAULTS.items()})
    return out.withColumn("tags", F.coalesce("tags", F.array().cast("array<string>"))).withColumn("created_at", F.try_to_timestamp("created_at").cast("timestamp_ntz"))


def read_memories(spark: SparkSession, path: str) -> DataFrame:
    """Records of JSON files, each an array of objects or one object a line."""
    return with_defaults(spark.read.schema(RECORD).option("multiLine", True).json(path))


def scratch(df: DataFrame, label: str) -> str:
    return f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"


def write_memories_json(memory: DataFrame, path: str) -> None:
    """JSON Lines with the exported fields, one file a partition."""
    memory.select("id", "content", "wing", "importance", "tags", F.col("created_at").cast("string").alias("created_at")).write.json(path)


@query("a1_read_memories", "memory", "SELECT id, md5(content) AS digest, wing, 'general' AS room, importance, array_to_string(tags, ',') AS tags FROM memory")
def json_round_trip(memory: DataFrame) -> DataFrame:
    """Records written as JSON and read back: fields that aren't exported have their defaults."""
    path = scratch(memory, "json")
    write_memories_json(memory, path)
    back = with_defaults(memory.sparkSession.read.schema(RECORD).json(path))
    return back.select("id", F.md5("content").alias("digest"), "wing", "room", "importance", F.array_join("tags", ",").alias("tags"))


def write_csv_memories(memory: DataFrame, path: str, cut: int = 200) -> None:
    """CSV with tags joined by bars and texts cut."""
    memory.select("id", F.left("content", F.lit(cut)).alias("content"), "wing", "room", "importance", F.concat_ws("|", "tags").alias("tags")).write.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def read_csv_memories(spark: SparkSession, path: str) -> DataFrame:
    schema = "id string, content string, wing string, room string, importance double, tags string"
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path).withColumn("tags", F.split("tags", "\\|"))


@query("a3_csv_round_trip", "memory", "SELECT id, md5(trim(left(content, 200))) AS digest, importance, len(tags)::BIGINT AS n_tags FROM memory")
def csv_round_trip(memory: DataFrame) -> DataFrame:
    """Records written as CSV and read back."""
    path = scratch(memory, "csv")
    write_csv_memories(memory, path)
    return read_csv_memories(memory.sparkSession, path).select("id", F.md5(F.trim("content")).alias("digest"), "importance", F.size("tags").cast("long").alias("n_tags"))


def markdown_records(files: DataFrame) -> DataFrame:
    """(file, position, wing, title, body) from (file, text): "## " names the wing, "### " starts a record, other lines join its body. One window per file."""
    lines = files.select("file", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    w = Window.partitionBy("file").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    head = F.startswith("line", F.lit("### "))
    x = lines.withColumn("wing", F.last(F.when(F.startswith("line", F.lit("## ")), F.substr("line", F.lit(4))), True).over(w)).withColumn("n", F.sum(F.when(head, 1).otherwise(0)).over(w)).where("n > 0")
    body = F.transform(F.array_sort(F.collect_list(F.when(~head & ~F.startswith("line", F.lit("## ")) & (F.trim("line") != ""), F.struct("pos", "line")))), lambda y: y["line"])
    g = x.groupBy("file", "n").agg(F.min_by("wing", "pos").alias("wing"), F.min_by(F.when(head, F.substr("line", F.lit(5))), "pos").alias("title"), F.array_join(body, "\n").alias("body"))
    return g.select("file", F.col("n").alias("position"), "wing", "title", "body")


def one_line(c: str) -> Column:
    """A name as the rest of one line, and null as \\N; named() takes it back."""
    return F.coalesce(F.replace(F.replace(c, F.lit("\\"), F.lit("\\b")), F.lit("\n"), F.lit("\\n")), F.lit("\\N"))


def named(c: str) -> Column:
    return F.when(F.col(c) != "\\N", F.replace(F.replace(c, F.lit("\\n"), F.lit("\n")), F.lit("\\b"), F.lit("\\")))


def render_markdown(memory: DataFrame, style: str = "plain") -> DataFrame:
    """(wing, room, id, text): a record's Markdown, stars for importance; the obsidian style links the first three tags.

    A text that reads as a heading, is blank or begins with a backslash has one before it, so that it is read back as it was; null is \\N.
    """
    stars = F.repeat(F.lit("★"), F.floor("importance").cast("int"))
    links = F.array_join(F.transform(F.slice("tags", 1, 3), lambda t: F.concat(F.lit("[["), t, F.lit("]]"))), " ") if style == "obsidian" else F.lit("")
    line = F.regexp_replace("content", "\n+", " ")
    line = F.coalesce(F.when(F.regexp_like(line, F.lit("^(?:[#\\\\]| *$)")), F.concat(F.lit("\\"), line)).otherwise(line), F.lit("\\N"))
    return memory.select("wing", "id", F.concat_ws("\n", F.concat(F.lit("### "), one_line("id")), F.concat_ws(" ", stars, links), line).alias("text"))


def write_markdown_memories(memory: DataFrame, path: str, style: str = "plain") -> None:
    """Markdown lines under a folder for each wing; a wing may be many files."""
    render_markdown(memory, style).select("wing", "text").write.partitionBy("wing").text(path)


@query("a4_markdown_round_trip", "memory", "SELECT id, wing, len(regexp_extract_all(content, '\\[\\[')) AS links, length(regexp_replace(content, '\\n+', ' ', 'g'))::BIGINT AS size FROM memory")
def markdown_round_trip(memory: DataFrame, records: int = 200) -> DataFrame:
    """All records rendered as Markdown files of about so many, and read back. A wing has as many files as its records need."""
    files_of = materialize(memory.groupBy(F.col("wing").alias("of")).agg(F.ceil(F.count("*") / records).alias("files")), "files-of-wings")
    # A few wings hold all texts: a shuffle by wing would send each wing's to one task.
    files_of = F.broadcast(files_of) if files_of.count() <= WINGS else files_of
    m = render_markdown(memory).join(files_of, F.col("wing").eqNullSafe(F.col("of"))).withColumn("wing", one_line("wing"))
    files = m.select(F.concat_ws("-", "wing", F.pmod(F.xxhash64("id", "text"), F.col("files"))).alias("file"), "wing", "id", "text")
    texts = files.groupBy("file").agg(F.concat(F.lit("## "), F.min("wing"), F.lit("\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "text"))), lambda x: x["text"]), "\n")).alias("text"))
    back = markdown_records(texts).select(named("title").alias("id"), named("wing").alias("wing"), F.substring_index("body", "\n", -1).alias("line"))
    text = F.when(F.col("line") != "\\N", F.regexp_replace("line", "^\\\\", ""))
    return back.select("id", "wing", F.regexp_count(text, F.lit("\\[\\[")).alias("links"), F.length(text).cast("long").alias("size"))


@query("a5_render_markdown", "memory", "SELECT id, wing, repeat('★', floor(importance)::INT) || ' [[' || tags[1] || ']] [[' || tags[2] || ']] [[' || tags[3] || ']]' AS line FROM memory")
def obsidian_lines(memory: DataFrame) -> DataFrame:
    """Second line of each record in the obsidian style."""
    return render_markdown(memory, "obsidian").select("id", "wing", F.element_at(F.split("text", "\n"), 2).alias("line"))


KINDS = {"text": ["txt", "md", "json", "csv", "html"], "image": ["png", "jpg", "gif"], "video": ["mp4", "mov"], "audio": ["mp3", "wav"], "document": ["pdf", "docx"]}


def file_kind(path):
    """Class of a file by its extension."""
    ext = F.lower(F.regexp_extract(path, "\\.([^./]+)$", 1))
    out = F.lit("other")
    for kind, exts in KINDS.items():
        out = F.when(ext.isin(exts), kind).otherwise(out)
    return out


def scan_files(spark: SparkSession, root: str) -> DataFrame:
    """path, length and kind of a tree's files without reading their content; hidden and vendor folders are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")
    return files.where(~F.col("path").rlike("/(\\.[^/]+|node_modules|vendor|__pycache__)/")).withColumn("kind", file_kind("path"))


@query("a6_scan_files", "pages", """
SELECT CASE WHEN e IN ('txt', 'md', 'json', 'csv', 'html') THEN 'text' WHEN e IN ('png', 'jpg', 'gif') THEN 'image' WHEN e IN ('pdf', 'docx') THEN 'document' ELSE 'other' END AS kind, count(*) AS n FROM (SELECT (['html', 'png', 'pdf', 'xyz'])[page_id % 4 + 1] AS e FROM pages) GROUP BY 1
""")
def kinds_of_pages(pages: DataFrame) -> DataFrame:
    """Classes of page paths, an extension added to each."""
    ext = F.element_at(F.array(*map(F.lit, ["html", "png", "pdf", "xyz"])), (F.col("page_id") % 4 + 1).cast("int"))
    return pages.groupBy(file_kind(F.concat_ws(".", "url", ext)).alias("kind")).agg(count().alias("n"))


def pack_parts(text, sep: str, most: int):
    """Greedy packing of a text's parts into chunks of at most `most` characters (a longer part stands alone)."""
    parts = F.filter(F.split(text, sep), lambda p: F.trim(p) != "")
    zero = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))

    def step(s, p):
        fits = (F.length(s["now"]) + F.length(p)) <= most
        empty = s["now"] == ""
        done = F.when(fits | empty, s["done"]).otherwise(F.concat(s["done"], F.array(s["now"])))
        now = F.when(empty, p).when(fits, F.concat(s["now"], F.lit("\n\n"), p)).otherwise(p)
        return F.struct(done.alias("done"), now.alias("now"))

    return F.aggregate(parts, zero, step, lambda s: F.when(s["now"] == "", s["done"]).otherwise(F.concat(s["done"], F.array(s["now"]))))


@query("a7_chunk_paragraphs", "memory", """
WITH RECURSIVE p AS (SELECT id, list_filter(string_split(content, chr(10)), lambda x: trim(x) <> '') AS l FROM memory), r AS (SELECT id, l, 1 AS i, CASE WHEN len(l) > 0 THEN l[1] ELSE '' END AS now, []::VARCHAR[] AS done FROM p
UNION ALL SELECT id, l, i + 1, CASE WHEN length(now) + length(l[i + 1]) <= 500 THEN now || chr(10) || chr(10) || l[i + 1] ELSE l[i + 1] END, CASE WHEN length(now) + length(l[i + 1]) <= 500 THEN done ELSE list_append(done, now) END FROM r WHERE i < len(l)),
f AS (SELECT id, CASE WHEN now = '' THEN done ELSE list_append(done, now) END AS c FROM r WHERE i >= len(l)) SELECT id, len(c)::BIGINT AS n, md5(array_to_string(c, '#')) AS digest FROM f
""", sep="\n", most=500)
def chunk_paragraphs(memory: DataFrame, sep: str = "\n\n", most: int = 2000) -> DataFrame:
    """How many chunks each text makes, and their digest. Row-local."""
    x = memory.select("id", pack_parts(F.col("content"), sep, most).alias("c"))
    return x.select("id", F.size("c").cast("long").alias("n"), F.md5(F.array_join("c", "#")).alias("digest"))


def heading_chunks(text, most: int = 800, least: int = 50):
    """Pieces cut at lines that start with # and once the buffer passes `most` characters; short ones go."""
    zero = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))

    def step(s, line):
        cut = (F.startswith(line, F.lit("#")) | (F.length(s["now"]) > most)) & (s["now"] != "")
        return F.struct(F.when(cut, F.concat(s["done"], F.array(s["now"]))).otherwise(s["done"]).alias("done"), F.when(cut | (s["now"] == ""), line).otherwise(F.concat_ws("\n", s["now"], line)).alias("now"))

    return F.filter(F.aggregate(F.split(text, "\n"), zero, step, lambda s: F.concat(s["done"], F.array(s["now"]))), lambda c: F.length(c) > least)


@query("a8_chunk_headings", "memory")
def chunk_headings(memory: DataFrame) -> DataFrame:
    """Pieces of each text."""
    return memory.select("id", F.posexplode(heading_chunks(F.col("content"))).alias("position", "piece"))


@query("a9_split_sections", "memory", """
SELECT id, i::BIGINT AS position, left(l[i], 50) AS room, length(l[i])::BIGINT AS size FROM (SELECT id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT id, string_split(content, chr(10) || 'The ') AS l FROM memory)) WHERE trim(l[i]) <> ''
""", mark="\nThe ")
def split_sections(memory: DataFrame, mark: str = "\n## ") -> DataFrame:
    """One record per section of a text."""
    x = memory.select("id", F.posexplode(F.split("content", mark)).alias("i", "s")).where(F.trim("s") != "")
    return x.select("id", (F.col("i") + 1).cast("long").alias("position"), F.left("s", F.lit(50)).alias("room"), F.length("s").cast("long").alias("size"))


def read_chat_lines(lines: DataFrame) -> DataFrame:
    """(role, text) from lines (value) of three chat exports: flat, nested messages, typed events with parts. Broken lines drop out."""
    shape = "role string, content string, messages array<struct<role: string, content: string>>, type string, message struct<role: string, content: array<struct<type: string, text: string, name: string>>>"
    j = lines.select(F.from_json("value", shape).alias("j"))
    flat = j.where("j.role IS NOT NULL AND j.content IS NOT NULL").select("j.role", F.col("j.content").alias("text"))
    nested = j.select(F.explode("j.messages").alias("m")).select("m.role", F.col("m.content").alias("text"))
    parts = F.array_join(F.transform("j.message.content", lambda p: F.coalesce(p["text"], p["name"], F.lit(""))), " ")
    typed = j.where("j.type = 'message'").select("j.message.role", parts.alias("text"))
    return flat.unionByName(nested).unionByName(typed).where("role IS NOT NULL")


@query("a10_read_chat_logs", "message", "SELECT role, count(*) AS n, sum(length(text))::BIGINT AS size FROM message GROUP BY role")
def chat_round_trip(message: DataFrame) -> DataFrame:
    """Messages written in the three shapes by turn, and read back."""
    one = F.struct("role", F.col("text").alias("content"))
    flat = F.to_json(one)
    nested = F.to_json(F.struct(F.array(one).alias("messages")))
    typed = F.to_json(F.struct(F.lit("message").alias("type"), F.struct("role", F.array(F.struct(F.lit("text").alias("type"), "text")).alias("content")).alias("message")))
    lines = message.select(F.when(F.col("turn") % 3 == 0, flat).when(F.col("turn") % 3 == 1, nested).otherwise(typed).alias("value")).unionByName(message.limit(3).select(F.lit("{broken").alias("value")))
    return read_chat_lines(lines).groupBy("role").agg(count().alias("n"), F.sum(F.length("text")).cast("long").alias("size"))


@query("a11_route_room", "memory", "SELECT CASE WHEN contains(c, 'license') THEN 'legal' WHEN contains(c, '@') THEN 'contact' WHEN contains(c, 'thened') THEN 'word' ELSE 'general' END AS room, count(*) AS n FROM (SELECT lower(content) AS c FROM memory) GROUP BY 1", routes=[("license", "legal"), ("@", "contact"), ("thened", "word")])
def route_room(memory: DataFrame, routes: list[tuple[str, str]]) -> DataFrame:
    """Records by the room of the first keyword they hold."""
    out = F.lit("general")
    for word, room in reversed(routes):
        out = F.when(F.contains(F.lower("content"), F.lit(word)), room).otherwise(out)
    return memory.groupBy(out.alias("room")).agg(count().alias("n"))


def manifest(df: DataFrame) -> DataFrame:
    """One row: records, characters and an order-free digest."""
    h = F.conv(F.left(F.md5(F.concat_ws("|", "id", "content", "wing")), F.lit(12)), 16, 10).cast("long")
    return df.agg(count().alias("n"), F.sum(F.length("content")).cast("long").alias("size"), F.bit_xor(h).alias("digest"))


def snapshot(df: DataFrame, root: str, snapshot_id: str) -> None:
    df.write.parquet(f"{root}/snapshot_id={snapshot_id}")


@query("a12_snapshot", "memory", "WITH h AS (SELECT length(content) AS n, CAST(('0x' || left(md5(concat_ws('|', id, content, wing)), 12)) AS BIGINT) AS d FROM memory) SELECT count(*) AS n, sum(n)::BIGINT AS size, bit_xor(d) AS digest, true AS verified FROM h")
def snapshot_verified(memory: DataFrame) -> DataFrame:
    """A snapshot written, and its manifest recomputed from what was read back."""
    root = scratch(memory, "snapshots")
    snapshot(memory, root, "s1")
    before, after = manifest(memory), manifest(memory.sparkSession.read.parquet(root).where("snapshot_id = 's1'"))
    return before.alias("b").join(after.alias("a")).select("b.n", "b.size", "b.digest", ((F.col("a.n") == F.col("b.n")) & (F.col("a.digest") == F.col("b.digest"))).alias("verified"))


@query("a13_restore", "memory", "SELECT id, wing, importance FROM memory WHERE wing = 'fr' AND importance >= 3", wing="fr", least=3.0)
def restore(memory: DataFrame, wing: str, least: float) -> DataFrame:
    """One snapshot read with filters: pruned by partition, pushed down to Parquet."""
    root = scratch(memory, "snapshots")
    snapshot(memory, root, "s1")
    return memory.sparkSession.read.parquet(root).where((F.col("snapshot_id") == "s1") & (F.col("wing") == wing) & (F.col("importance") >= least)).select("id", "wing", "importance")


def changed_since(base: DataFrame, now: DataFrame) -> DataFrame:
    """(id, change): rows added, changed or deleted against a base, by digest."""
    a, b = (d.select("id", F.sha2("content", 256).alias("h")) for d in (base, now))
    new = b.join(a, ["id", "h"], "left_anti").join(a.select("id", F.lit(True).alias("had")), "id", "left").select("id", F.when(F.col("had"), "changed").otherwise("added").alias("change"))
    return new.unionByName(a.join(b, "id", "left_anti").select("id", F.lit("deleted").alias("change")))


@query("a14_incremental_backup", "memory", """
WITH a AS (SELECT id, content FROM memory WHERE CAST(id AS BIGINT) % 10 <> 1), b AS (SELECT id, CASE WHEN CAST(id AS BIGINT) % 7 = 0 THEN content || '!' ELSE content END AS content FROM memory WHERE CAST(id AS BIGINT) % 10 <> 2)
SELECT b.id, CASE WHEN a.id IS NULL THEN 'added' ELSE 'changed' END AS change FROM b LEFT JOIN a ON a.id = b.id WHERE a.id IS NULL OR a.content <> b.content UNION ALL SELECT id, 'deleted' FROM a WHERE id NOT IN (SELECT id FROM b)
""")
def incremental_backup(memory: DataFrame) -> DataFrame:
    """Changes between two versions made from the table."""
    k = F.col("id").cast("long")
    now = memory.where(k % 10 != 2).withColumn("content", F.when(k % 7 == 0, F.concat("content", F.lit("!"))).otherwise(F.col("content")))
    return changed_since(memory.where(k % 10 != 1), now)


@query("a15_import_with_ledger", "pages", """
WITH f AS (SELECT url, (['html', 'png', 'pdf', 'xyz'])[page_id % 4 + 1] AS e, page_id % 3 = 0 AS known FROM pages) SELECT CASE WHEN e = 'html' THEN 'text' WHEN e = 'png' THEN 'image' WHEN e = 'pdf' THEN 'document' ELSE 'other' END AS kind, count(*) FILTER (NOT known) AS imported, count(*) FILTER (known) AS skipped FROM f GROUP BY 1
""")
def import_with_ledger(pages: DataFrame) -> DataFrame:
    """Files not yet in the ledger (here every third page is), counted by class."""
    ext = F.element_at(F.array(*map(F.lit, ["html", "png", "pdf", "xyz"])), (F.col("page_id") % 4 + 1).cast("int"))
    files = pages.select("page_id", file_kind(F.concat_ws(".", "url", ext)).alias("kind"))
    ledger = pages.where("page_id % 3 = 0").select("page_id", F.lit(True).alias("known"))
    return files.join(ledger, "page_id", "left").groupBy("kind").agg(F.sum(F.when(F.col("known").isNull(), 1).otherwise(0)).cast("long").alias("imported"), F.sum(F.when(F.col("known"), 1).otherwise(0)).cast("long").alias("skipped"))


@query("a16_export_redacted", "memory")
def export_redacted(memory: DataFrame) -> DataFrame:
    """Records redacted at the strict level, written as JSON and read back."""
    path = scratch(memory, "redacted")
    write_memories_json(redacted(memory, "content", "strict"), path)
    return memory.sparkSession.read.schema(RECORD).json(path).select("id", F.md5("content").alias("digest"), "wing")


@query("a17_prune_snapshots", "access_log", """
WITH s AS (SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS snapshot_id, count(*) AS n, round(sum(duration_ms), 2) AS size FROM access_log GROUP BY 1) SELECT *, row_number() OVER (ORDER BY snapshot_id DESC) <= 5 AS kept FROM s
""", keep=5)
def prune_snapshots(access_log: DataFrame, keep: int) -> DataFrame:
    """Daily snapshots and whether they are among the newest; the newest ids come from a top-k, not a global rank."""
    s = access_log.groupBy(F.to_date("ts").cast("string").alias("snapshot_id")).agg(count().alias("n"), r6(F.sum("duration_ms"), 2).alias("size"))
    newest = s.orderBy(F.desc("snapshot_id")).limit(keep).select("snapshot_id", F.lit(True).alias("kept"))
    return s.join(newest, "snapshot_id", "left").select("snapshot_id", "n", "size", F.coalesce("kept", F.lit(False)).alias("kept"))


def import_snapshot(current: DataFrame, root: str, snapshot_id: str, merge: bool = True) -> DataFrame:
    """A snapshot's rows, and with merge the current rows that it doesn't hold; without merge it takes the current rows' place."""
    rows = current.sparkSession.read.parquet(root).where(F.col("snapshot_id") == snapshot_id).select(*current.columns)
    return rows.unionByName(current.join(rows.select("id"), "id", "left_anti").select(*current.columns)) if merge else rows


@query("a17_import_snapshot", "memory", """
SELECT id, md5(content) AS digest FROM memory WHERE CAST(id AS BIGINT) % 3 <> 0 UNION ALL SELECT id, md5(content || '!') FROM memory WHERE CAST(id AS BIGINT) % 3 = 0 AND CAST(id AS BIGINT) % 2 = 0
""")
def snapshot_imported(memory: DataFrame) -> DataFrame:
    """A written snapshot (ids that three doesn't divide) merged into changed rows of even ids."""
    root, k = scratch(memory, "snapshots"), F.col("id").cast("long")
    rows = memory.select("id", "content")
    snapshot(rows.where(k % 3 != 0), root, "s1")
    return import_snapshot(rows.where(k % 2 == 0).withColumn("content", F.concat("content", F.lit("!"))), root, "s1").select("id", F.md5("content").alias("digest"))

"""The write path: validation, redaction, duplicates, links, tags, importance of messages, trigram vectors."""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemolake.functions.columns import any_of, best_of, count, hits, n, r6, tokens
from mnemolake.operators.overlap import place_pairs
from mnemolake.operators.sets import codes, packed_trigrams
from mnemolake.operators.vectors import classes, sided, vector_pairs
from mnemolake.plans.registry import query
from mnemolake.plans.storage import materialize, shared_dir
from mnemolake.sources.buckets import BucketTable


@query("b1_validate", "memory", "SELECT id, round(importance / 5 * 5, 6) AS importance, 1.0::DOUBLE AS confidence, 'active' AS status FROM memory WHERE trim(content) <> '' AND importance / 5 BETWEEN 0.3 AND 1", low=0.3)
def validate(memory: DataFrame, low: float = 0.0) -> DataFrame:
    """Rows with text and an importance within bounds (0 to 1 on input), scaled to 5, with defaults."""
    given = F.col("importance") / 5
    return memory.where((F.trim("content") != "") & given.between(low, 1)).select("id", r6(given * 5).alias("importance"), F.lit(1.0).alias("confidence"), F.lit("active").alias("status"))


# Patterns and their replacements, in the order in which they apply. The later rule of a name replaces the
# earlier one's pattern but keeps its place.
XSS_RULES = [
    ("script_tag", r"<script[^>]*>.*?</script>", "[SCRIPT_REMOVED]"),
    ("script_tag_open", r"<\s*script[^>]*>", "[SCRIPT_REMOVED]"),
    ("html_event_quoted", r"\bon\w+\s*=\s*[\"'][^\"']*[\"']", "[HTML_EVENT_REMOVED]"),
    ("html_event_unquoted", r"\bon\w+\s*=\s*[^\s>\"']+", "[HTML_EVENT_REMOVED]"),
    ("javascript_url", r"javascript\s*:", "[JS_URL_REMOVED]"),
    ("vbscript_url", r"vbscript\s*:", "[VBSCRIPT_REMOVED]"),
    ("css_expr", r"\bexpression\s*\([^)]*\)", "[CSS_EXPR_REMOVED]"),
    ("dangerous_tags", r"<\s*(?:svg|img|body|input|iframe|object|embed|applet|form|button|meta|link|base|details|marquee|video|audio|source)\b[^>]*(?:on\w+|src\s*=\s*['\"]?javascript)[^>]*>", "[DANGEROUS_TAG_REMOVED]"),
    ("data_uri_xss", r"data\s*:\s*(?:text/html|application/x-)[^\"'\s>]*", "[DATA_URI_REMOVED]"),
]
PII_RULES = [
    ("html_event", r"\bon\w+\s*=\s*[\"'][^\"']*[\"']", "[HTML_EVENT_REMOVED]"),
    ("iframe_tag", r"<iframe[^>]*>.*?</iframe>", "[IFRAME_REMOVED]"),
    ("object_embed", r"<(?:object|embed|applet)[^>]*>.*?</(?:object|embed|applet)>", "[EMBED_REMOVED]"),
    ("data_uri", r"data\s*:\s*text/html[^\"'\s]*", "[DATA_URI_REMOVED]"),
    ("url_with_token", r"https?://\S+[?&](token|key|secret|password|api_key|auth)=\S+", "[URL_WITH_CREDENTIAL]"),
    ("email", r"[\w.-]+@[\w.-]+\.\w+", "[EMAIL]"),
    ("ip_address", r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}", "[IP]"),
    ("id_card", r"\d{17}[\dXx]", "[ID_CARD]"),
    ("bank_card", r"\d{16,19}", "[BANK_CARD]"),
    ("phone", r"1[3-9]\d{9}", "[PHONE]"),
]


def rules(level: str) -> list[tuple[str, str, str]]:
    """minimal: credentials in addresses; standard: all but IP addresses; strict: all."""
    if level == "minimal":
        return [r for r in PII_RULES if r[0] == "url_with_token"]
    return XSS_RULES + [r for r in PII_RULES if level == "strict" or r[0] != "ip_address"]


def redact(text: str | Column, level: str = "standard", keywords: tuple[str, ...] = ()) -> tuple[Column, list[tuple[str, Column]]]:
    """(redacted text, matches of each rule, counted before its own replacement)."""
    out = F.col(text) if isinstance(text, str) else text
    counts = []
    for name, pattern, by in rules(level):
        p = "(?isU)" + pattern
        counts.append((name, F.regexp_count(out, F.lit(p))))
        out = F.regexp_replace(out, p, by.replace("$", "\\$"))
    for k in keywords:
        counts.append((f"keyword:{k[:2]}", F.contains(out, F.lit(k)).cast("int")))
        out = F.replace(out, F.lit(k), F.lit(f"[REDACTED:{k[:2]}***]"))
    return out, counts


#: A character that every match of a rule holds: texts without it are passed by.
NEEDS = {"email": "@", "url_with_token": "://", "ip_address": ".", "css_expr": "(", "script_tag": "<", "script_tag_open": "<", "dangerous_tags": "<", "iframe_tag": "<", "object_embed": "<"}
NEEDS |= {"html_event": "=", "html_event_quoted": "=", "html_event_unquoted": "=", "javascript_url": ":", "vbscript_url": ":", "data_uri": ":", "data_uri_xss": ":"}


def redacted(df: DataFrame, text: str, level: str = "standard") -> DataFrame:
    """df with the text redacted and a map of counts over 0. Each step is a column of its own, so no expression is doubled
    by the next; matches are counted only where a rule changed the text. Filter on the result only once it is written:
    a predicate pushed down would repeat the whole chain."""
    mark = "_" * (1 + max(map(len, df.columns)))
    out, steps = df.withColumn(f"{mark}0", F.col(text)), []
    for k, (name, pattern, by) in enumerate(rules(level)):
        p, before = "(?isU)" + pattern, F.col(f"{mark}{k}")
        after = F.regexp_replace(before, p, by)
        out = out.withColumn(f"{mark}{k + 1}", F.when(F.contains(before, F.lit(NEEDS[name])), after).otherwise(before) if name in NEEDS else after)
        steps.append((name, F.when(before == F.col(f"{mark}{k + 1}"), 0).otherwise(F.regexp_count(before, F.lit(p)))))
    found = F.map_filter(F.create_map(*[x for name, c in steps for x in (F.lit(name), c)]), lambda _, v: v > 0)
    return out.select(*[F.col(f"{mark}{len(steps)}" if c == text else f"`{c}`").alias(c) for c in df.columns], found.alias("redactions"))


def _redact_sql(level: str, table: str, text: str, key: str) -> str:
    steps, last = [], f"(SELECT {key}, {text} AS t FROM {table})"
    for k, (_, p, by) in enumerate(rules(level)):
        q = ("(?is)" + p.replace("[\\w", "[\\pL\\pN_").replace("\\w", "[\\pL\\pN_]")).replace("'", "''")
        steps.append(f"s{k} AS (SELECT *, len(regexp_extract_all(t{'' if k == 0 else k}, '{q}')) AS n{k}, regexp_replace(t{'' if k == 0 else k}, '{q}', '{by}', 'g') AS t{k + 1} FROM {last})")
        last = f"s{k}"
    total = " + ".join(f"n{k}" for k in range(len(rules(level))))
    return f"WITH {', '.join(steps)} SELECT {key}, md5(t{len(rules(level))}) AS digest, ({total})::BIGINT AS n FROM {last} WHERE {total} > 0"


@query("b2_redact", "memory", _redact_sql("strict", "memory", "content", "id"))
def redact_memory(memory: DataFrame) -> DataFrame:
    """Records with something to redact: digest of the redacted text and the number of matches."""
    x = redacted(memory.select("id", "content"), "content", "strict")
    total = F.aggregate(F.map_values("redactions"), F.lit(0), lambda a, v: a + v).cast("long")
    return materialize(x.select("id", F.md5("content").alias("digest"), total.alias("n")), "redacted").where("n > 0")


@query("b2b_redact_pages", "pages")
def redact_pages(pages: DataFrame) -> DataFrame:
    """Pages with something to redact at the standard level."""
    x = redacted(pages.select("page_id", "html"), "html", "standard")
    found = x.select("page_id", F.length("html").cast("long").alias("length"), F.array_join(F.array_sort(F.map_keys("redactions")), ",").alias("rules"))
    return materialize(found, "redacted").where("rules <> ''")


@query("b3_sanitize_hash", "memory", "SELECT id, sha256(content) AS key FROM memory")
def sanitize_hash(memory: DataFrame) -> DataFrame:
    """A digest of each text for identity."""
    return memory.select("id", F.sha2("content", 256).alias("key"))


def split_batch(memory: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(stored, incoming): every fifth record arrives anew."""
    k = F.col("id").cast("long") % 5
    return memory.where(k != 0), memory.where(k == 0)


_SPLIT = "old AS (SELECT * FROM memory WHERE CAST(id AS BIGINT) % 5 <> 0), new AS (SELECT * FROM memory WHERE CAST(id AS BIGINT) % 5 = 0)"


@query("b4_exact_duplicate_upsert", "memory", f"""
WITH {_SPLIT}, h AS (SELECT content, wing, count(*) AS k FROM new GROUP BY 1, 2), kept AS (SELECT id, round(least(5.0, importance + 0.25 * k), 6) AS importance, 'raised' AS action FROM old JOIN h ON old.content = h.content AND old.wing = h.wing),
fresh AS (SELECT min(id) AS id, round(arg_min(importance, id), 6) AS importance, 'added' AS action FROM new WHERE NOT EXISTS (SELECT 1 FROM old WHERE old.content = new.content AND old.wing = new.wing) GROUP BY content, wing) SELECT * FROM kept UNION ALL SELECT * FROM fresh
""")
def exact_duplicate_upsert(memory: DataFrame) -> DataFrame:
    """Incoming texts that are stored raise the stored row's importance; the others are added once. Joined on digests."""
    old, new = (d.withColumn("h", F.sha2("content", 256)) for d in split_batch(memory))
    seen = new.groupBy("h", "wing").agg(F.count("*").alias("k"), F.min_by(F.struct("id", "importance"), "id").alias("r"))
    kept = old.join(seen, ["h", "wing"]).select("id", r6(F.least(F.lit(5.0), F.col("importance") + 0.25 * F.col("k"))).alias("importance"), F.lit("raised").alias("action"))
    fresh = seen.join(old.select("h", "wing"), ["h", "wing"], "left_anti").select("r.id", r6("r.importance").alias("importance"), F.lit("added").alias("action"))
    return kept.unionByName(fresh)


@query("b5_near_duplicate_upsert", "memory vector", f"""
WITH {_SPLIT}, p AS (SELECT n.id, o.id AS stored, round(list_cosine_similarity(vn.v::DOUBLE[], vo.v::DOUBLE[]), 9) AS s FROM new n JOIN vector vn ON vn.id = n.id JOIN old o ON o.wing = n.wing JOIN vector vo ON vo.id = o.id WHERE round(list_cosine_similarity(vn.v::DOUBLE[], vo.v::DOUBLE[]), 9) >= 0.3)
SELECT id, arg_max(stored, (s, stored)) AS stored, round(max(s), 6) AS similarity FROM p GROUP BY id
""", th=0.3)
def near_duplicate_upsert(memory: DataFrame, vector: DataFrame, th: float = 0.92) -> DataFrame:
    """For each incoming record the most similar stored one of its wing, if similar enough.

    Only stored and incoming records of one wing meet; copies on either side are one vector, whose answer all share.
    """
    m = memory.select("id", sided(F.col("wing"), F.col("id").cast("long") % 5 == 0).alias("g"))
    v = vector.select("id", "v").join(m, "id")
    of = materialize(classes(v).select("id", "cls", F.endswith("g", F.lit("true")).alias("new")), "classes")
    last = of.where("NOT new").groupBy("cls").agg(F.max("id").alias("stored"))
    p = vector_pairs(v, th, "sides").select("s", F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("p")).select("s", F.col("p.a").alias("new_cls"), F.col("p.b").alias("cls"))
    best = p.join(last, "cls").groupBy("new_cls").agg(F.max_by("stored", F.struct("s", "stored")).alias("stored"), r6(F.max("s")).alias("similarity"))
    return of.where("new").join(best, F.col("cls") == F.col("new_cls")).select("id", "stored", "similarity")


_SAME = "len(list_filter(range(1, n + 1), lambda i: substr(x, i, 1) = substr(y, i, 1) AND substr(x, i, 1) <> ''))::DOUBLE / n"


@query("b6_positional_overlap_dup", "memory", f"""
WITH k AS (SELECT id, wing, content, length(content) AS n, min(id) OVER (PARTITION BY wing, content) AS cls FROM memory WHERE length(content) > 0 AND wing IS NOT NULL), m AS (SELECT * FROM k WHERE id = cls),
p AS (SELECT a.id AS a, b.id AS b, a.content AS x, b.content AS y, greatest(a.n, b.n) AS n FROM m a JOIN m b ON a.wing = b.wing AND a.id < b.id AND abs(a.n - b.n) <= 5)
SELECT a, b, round({_SAME}, 6) AS overlap FROM p WHERE {_SAME} > 0.85 UNION ALL SELECT cls, id, 1.0 FROM k WHERE id <> cls
""")
def positional_overlap_dup(memory: DataFrame, least: float = 0.85, gap: int = 5) -> DataFrame:
    """Texts of a wing of nearly equal length with equal characters at the same places, exact for texts of any length: equal
    texts of a wing are one class, linked to its smallest id with overlap 1; other pairs are between those ids. Null or
    empty texts and null wings have none.

    Texts meet by bands of lengths and a pair is given up as soon as too many of its places differ (operators/overlap.py), so
    what is shuffled is each text twice.
    """
    m = memory.select("id", "wing", "content", F.length("content").alias("n")).where(F.col("wing").isNotNull() & (F.col("n") > 0))
    m = m.withColumn("h", F.sha2("content", 256))
    classes = materialize(m.groupBy("wing", "h").agg(F.min("id").alias("a")), "same-text")
    members = m.join(classes, ["wing", "h"]).where(F.col("id") > F.col("a")).select("a", F.col("id").alias("b"), F.lit(1.0).alias("overlap"))
    reps = m.join(classes.select(F.col("a").alias("id")), "id", "left_semi").drop("h")
    pairs = place_pairs(reps.withColumnRenamed("wing", "g"), least, gap)
    return members.unionByName(pairs.select("a", "b", r6("o").alias("overlap")))



@query("b7_fuse_on_write", "memory", f"""
WITH {_SPLIT}, p AS (SELECT o.id, o.content AS oc, n.content AS nc, n.id AS nid FROM old o JOIN new n ON o.wing = n.wing AND left(o.content, 30) = left(n.content, 30))
SELECT id, md5(arg_max(CASE WHEN length(nc) > length(oc) THEN nc ELSE oc END, (length(CASE WHEN length(nc) > length(oc) THEN nc ELSE oc END), nid))) AS digest, round(least(1.0, 0.5 + 0.1 * count(*)), 6) AS confidence, count(*) AS fused_count FROM p GROUP BY id
""")
def fuse_on_write(memory: DataFrame) -> DataFrame:
    """Stored records that incoming ones resemble (wing and beginning): the longest text, confidence and count.

    The incoming ones of a wing and beginning are one row first (the longest, the last id, how many), so no pair is made and no
    text is sent.
    """
    old, new = split_batch(memory)
    key, size = F.left("content", F.lit(30)).alias("k"), F.length("content").alias("size")
    top = F.struct(size, F.col("id").alias("nid"), F.md5("content").alias("digest"))
    given = new.groupBy("wing", key).agg(F.max(top).alias("top"), F.max("id").alias("last"), F.count("*").alias("n"))
    p = old.select("id", "wing", key, size, F.md5("content").alias("own")).join(given, ["wing", "k"])
    best = F.when(F.col("top.size") > F.col("size"), F.col("top")).otherwise(F.struct("size", F.col("last").alias("nid"), F.col("own").alias("digest")))
    found = p.groupBy("id").agg(F.max(best).alias("best"), F.sum("n").alias("n"))
    return found.select("id", F.col("best.digest").alias("digest"), r6(F.least(F.lit(1.0), 0.5 + 0.1 * F.col("n"))).alias("confidence"), F.col("n").alias("fused_count"))


LINK = "\\[\\[(?:([^\\]|:]+):)?([^\\]|]+)(?:\\|([^\\]]+))?\\]\\]"


def wikilinks(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """ns, target and label of [[target]], [[target|label]] and [[ns:target]]."""
    parts = [F.regexp_extract_all(text, F.lit(LINK), F.lit(g)).alias(name) for g, name in ((1, "ns"), (2, "target"), (3, "label"))]
    return df.select(*keep, F.explode(F.arrays_zip(*parts)).alias("l")).select(*keep, "l.ns", "l.target", "l.label")


def linked(memory: DataFrame) -> DataFrame:
    """Texts whose first long word and its neighbour are written as a link, since the data has none."""
    return memory.select("id", F.concat(F.lit("[["), "wing", F.lit(":"), F.regexp_extract("content", "([A-Za-z]{6,}) ([a-z]+)", 1), F.lit("|"), F.regexp_extract("content", "([A-Za-z]{6,}) ([a-z]+)", 2), F.lit("]] and [["), "room", F.lit("]]")).alias("t"))


@query("b8_parse_wikilinks", "memory", """
WITH l AS (SELECT id, '[[' || wing || ':' || regexp_extract(content, '([A-Za-z]{6,}) ([a-z]+)', 1) || '|' || regexp_extract(content, '([A-Za-z]{6,}) ([a-z]+)', 2) || ']] and [[' || room || ']]' AS t FROM memory)
SELECT id, coalesce(ns, '') AS ns, target, coalesce(label, '') AS label FROM (SELECT id, unnest(regexp_extract_all(t, '\\[\\[(?:([^\\]|:]+):)?([^\\]|]+)(?:\\|([^\\]]+))?\\]\\]', 1)) AS ns, unnest(regexp_extract_all(t, '\\[\\[(?:([^\\]|:]+):)?([^\\]|]+)(?:\\|([^\\]]+))?\\]\\]', 2)) AS target, unnest(regexp_extract_all(t, '\\[\\[(?:([^\\]|:]+):)?([^\\]|]+)(?:\\|([^\\]]+))?\\]\\]', 3)) AS label FROM l)
""")
def parse_wikilinks(memory: DataFrame) -> DataFrame:
    """Links in texts."""
    return wikilinks(linked(memory), "t", "id")


@query("b9_resolve_wikilinks", "memory", """
WITH l AS (SELECT id, lower(regexp_extract(content, '([A-Za-z]{6,}) ([a-z]+)', 1)) AS target FROM memory), ix AS (SELECT DISTINCT id, tok FROM (SELECT id, unnest(list_distinct(regexp_extract_all(lower(content), '[\\x{4e00}-\\x{9fff}]+|[a-z0-9_]{2,}'))) AS tok FROM memory))
SELECT l.id, target, min(ix.id) AS mentions FROM l JOIN ix ON ix.tok = l.target AND ix.id <> l.id GROUP BY 1, 2
""")
def resolve_wikilinks(memory: DataFrame) -> DataFrame:
    """For the link target of every record, the first other record that holds the word: of each word the two smallest ids are enough.

    Targets are of six Latin letters or more, so other tokens are dropped within their row; each partition keeps two ids a word.
    """
    l = memory.select(F.col("id").alias("src"), F.lower(F.regexp_extract("content", "([A-Za-z]{6,}) ([a-z]+)", 1)).alias("target")).where("target <> ''")  # noqa: E741
    ix = memory.select("id", F.explode(F.filter(tokens("content"), lambda t: F.regexp_like(t, F.lit("^[a-z]{6,}$")))).alias("tok"))
    two = ix.withColumn("r", F.dense_rank().over(Window.partitionBy("tok").orderBy("id"))).where("r <= 2")
    held = two.groupBy("tok").agg(F.min("id").alias("one"), F.max(F.when(F.col("r") == 2, F.col("id"))).alias("two"))
    found = l.join(held, F.col("tok") == F.col("target")).select(F.col("src").alias("id"), "target", F.when(F.col("one") != F.col("src"), F.col("one")).otherwise(F.col("two")).alias("mentions"))
    return found.where("mentions IS NOT NULL").distinct()


TAG_RULES = [("law", ["license", "许可"]), ("mail", ["@"]), ("word", ["thened", "inthat"])]


@query("b10_auto_tag", "memory", """
SELECT id, array_to_string(CASE WHEN len(f) = 0 THEN ['auto_tagged'] ELSE f END, ',') AS added FROM (SELECT id, list_filter([CASE WHEN contains(c, 'license') OR contains(c, '许可') THEN 'law' END, CASE WHEN contains(c, '@') THEN 'mail' END, CASE WHEN contains(c, 'thened') OR contains(c, 'inthat') THEN 'word' END], lambda x: x IS NOT NULL) AS f FROM (SELECT id, lower(content) AS c FROM memory WHERE len(list_filter(tags, lambda t: starts_with(t, 't'))) <= 1))
""")
def auto_tag(memory: DataFrame, rules_=TAG_RULES) -> DataFrame:
    """Rule tags for records with at most one own tag (those from t on); a default where no rule fits."""
    from mnemolake.functions.columns import labels

    few = F.size(F.filter("tags", lambda t: F.startswith(t, F.lit("t")))) <= 1
    x = memory.where(few).select("id", labels([(any_of(F.lower("content"), ws), name) for name, ws in rules_]).alias("f"))
    return x.select("id", F.array_join(F.when(F.size("f") == 0, F.array(F.lit("auto_tagged"))).otherwise(F.col("f")), ",").alias("added"))


@query("b11_content_filter", "memory", "SELECT id, md5(CASE WHEN length(content) > 2000 THEN left(content, 2000) || '...[truncated]' ELSE content END) AS digest FROM memory WHERE NOT (contains(content, 'License') OR contains(content, 'a.b'))", blocked=["License", "a.b"], longest=2000)
def content_filter(memory: DataFrame, blocked: list[str], longest: int = 10_000) -> DataFrame:
    """Records without a blocked string, long texts cut with a marker."""
    cut = F.when(F.length("content") > longest, F.concat(F.left("content", F.lit(longest)), F.lit("...[truncated]"))).otherwise(F.col("content"))
    return memory.where(~any_of("content", blocked)).select("id", F.md5(cut).alias("digest"))


HIGH, LOW = ["important", "remember", "重要", "que "], ["ok", "thanks", "好的"]


def message_importance(text: str, role: str) -> Column:
    """0 under 20 characters; .3 and steps for length, keywords up to .3 (minor ones down to -.15), times a weight of the role, within 0 and 1."""
    length = F.length(text)
    s = 0.3 + F.when(length > 500, 0.2).when(length > 200, 0.1).otherwise(0.0) + F.least(F.lit(0.3), 0.08 * hits(F.lower(text), HIGH)) - F.least(F.lit(0.15), 0.05 * hits(F.lower(text), LOW))
    weight = F.when(F.col(role) == "user", 1.1).when(F.col(role) == "system", 0.5).otherwise(1.0)
    bonus = F.when(F.contains(text, F.lit("\n")), 0.05).otherwise(0.0)
    return F.when(length < 20, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), s * weight + bonus)))


_MI = "CASE WHEN length(text) < 20 THEN 0.0 ELSE greatest(0.0, least(1.0, (0.3 + CASE WHEN length(text) > 500 THEN 0.2 WHEN length(text) > 200 THEN 0.1 ELSE 0.0 END + least(0.3, 0.08 * (contains(lower(text), 'important')::INT + contains(lower(text), 'remember')::INT + contains(lower(text), '重要')::INT + contains(lower(text), 'que ')::INT)) - least(0.15, 0.05 * (contains(lower(text), 'ok')::INT + contains(lower(text), 'thanks')::INT + contains(lower(text), '好的')::INT))) * CASE role WHEN 'user' THEN 1.1 WHEN 'system' THEN 0.5 ELSE 1.0 END + CASE WHEN contains(text, chr(10)) THEN 0.05 ELSE 0.0 END)) END"


@query("b12_message_importance", "message", f"SELECT session_id, turn, round(({_MI})::DOUBLE, 6) AS importance FROM message")
def messages_scored(message: DataFrame) -> DataFrame:
    """Importance of every message."""
    return message.select("session_id", "turn", r6(message_importance("text", "role")).alias("importance"))


ROOMS = [("code", ["code", "bug", "代码", "thened"]), ("plan", ["plan", "计划", "inthe"]), ("people", ["team", "团队", "eronth"])]
_ROOM = "CASE WHEN greatest(a, b, d) = 0 THEN 'general' WHEN a = greatest(a, b, d) THEN 'code' WHEN b = greatest(a, b, d) THEN 'plan' ELSE 'people' END"


@query("b13_classify_wing_room", "memory", f"SELECT {_ROOM} AS room, count(*) AS n FROM (SELECT contains(c, 'code')::INT + contains(c, 'bug')::INT + contains(c, '代码')::INT + contains(c, 'thened')::INT AS a, contains(c, 'plan')::INT + contains(c, '计划')::INT + contains(c, 'inthe')::INT AS b, contains(c, 'team')::INT + contains(c, '团队')::INT + contains(c, 'eronth')::INT AS d FROM (SELECT lower(content) AS c FROM memory)) GROUP BY 1")
def classify_rooms(memory: DataFrame, rooms=ROOMS) -> DataFrame:
    """Records by the room with most keyword hits; ties go to the earlier rule."""
    c = F.lower("content")
    return memory.groupBy(best_of([(hits(c, ws), name) for name, ws in rooms], "general").alias("room")).agg(count().alias("n"))


@query("b14_collect_session", "message", f"""
WITH r AS (SELECT *, ({_MI})::DOUBLE AS imp, row_number() OVER (PARTITION BY session_id ORDER BY turn DESC) AS rn FROM message), k AS (SELECT * FROM r WHERE rn <= 50 AND imp >= 0.4)
SELECT md5(left(text, 1000)) AS key, min(session_id || '-' || turn) AS first_from, round(max(imp), 6) AS importance FROM k GROUP BY left(text, 1000)
""")
def collect_session(message: DataFrame, last: int = 50, least: float = 0.4, cut: int = 1000) -> DataFrame:
    """The important ones of each session's last messages, equal texts once."""
    rn = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("turn")))
    k = message.withColumn("rn", rn).where(F.col("rn") <= last).withColumn("imp", message_importance("text", "role")).where(F.col("imp") >= least)
    return k.groupBy(F.md5(F.left("text", F.lit(cut))).alias("key")).agg(F.min(F.concat_ws("-", "session_id", "turn")).alias("first_from"), r6(F.max("imp")).alias("importance"))


GRAMS = 1 << 18  # whose buckets a worker remembers


def trigram_weights(df: DataFrame, dim: int = 384) -> DataFrame:
    """(id, bucket, weight): character trigrams hashed by md5 to buckets, L2-normalised per text.

    A text's trigrams are cut and counted within its row, so its work grows with its length and only its buckets are sent.
    """
    rows = df.where("id IS NOT NULL").select("id", F.lower("content").alias("low"))
    each = bucket_counts(rows, dim).groupBy("id").agg(F.flatten(F.collect_list("b")).alias("b"))

    def run(batches):
        for b in batches:
            of, bucket, weight = [], [], []
            for row, found in enumerate(b.column(1)):
                k = np.bincount(found.values.field("bucket").to_numpy(), found.values.field("k").to_numpy(), dim)
                at = np.flatnonzero(k)
                of.append(np.full(len(at), row))
                bucket.append(at)
                weight.append(k[at] / np.sqrt((k * k).sum()))
            if of:
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.concatenate(of))), pa.array(np.concatenate(bucket)), pa.array(np.concatenate(weight))], ["id", "bucket", "weight"])

    return each.mapInArrow(run, "id string, bucket long, weight double")


def bucket_counts(low: DataFrame, dim: int) -> DataFrame:
    """(id, b) of rows (id, low) that have any: how many trigrams fall to each bucket; shorter texts have their characters."""

    def run(batches):
        known: dict[int, int] = {}
        for whole in batches:
            for first in range(0, whole.num_rows, 256):
                part = whole.slice(first, 256)
                of, ends, buckets, counts = [], [0], [], []
                for row, text in enumerate(part.column(1).to_pylist()):
                    if not text:
                        continue
                    short = len(text) < 3
                    grams, n = np.unique(-1 - codes(text) if short else packed_trigrams(codes(text)), return_counts=True)
                    if len(known) > GRAMS:
                        known.clear()
                    for g in grams.tolist():
                        if g not in known:
                            gram = "".join(chr(c) for c in ((-1 - g,) if short else (g >> 42, g >> 21 & 0x1FFFFF, g & 0x1FFFFF)))
                            known[g] = int(hashlib.md5(gram.encode()).hexdigest()[:7], 16) % dim
                    k = np.bincount([known[g] for g in grams.tolist()], n, dim).astype(np.int64)
                    at = np.flatnonzero(k)
                    of.append(row)
                    ends.append(ends[-1] + len(at))
                    buckets.append(at)
                    counts.append(k[at])
                if of:
                    b = pa.StructArray.from_arrays([pa.array(np.concatenate(buckets)), pa.array(np.concatenate(counts))], ["bucket", "k"])
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(of)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), b)], ["id", "b"])

    return low.select("id", "low").mapInArrow(run, "id string, b array<struct<bucket: long, k: long>>")


@query("b15_hash_embed", "benchmark", """
WITH g AS (SELECT CAST(item_id AS VARCHAR) AS id, unnest(list_transform(range(1, length(text) - 1), lambda i: substr(lower(text), i, 3))) AS g FROM benchmark), b AS (SELECT id, CAST(('0x' || left(md5(g), 7)) AS BIGINT) % 384 AS bucket, count(*) AS k FROM g GROUP BY 1, 2), n AS (SELECT id, sqrt(sum(k * k)) AS norm FROM b GROUP BY 1)
SELECT b.id, bucket, round(k / norm, 6) AS weight FROM b JOIN n ON b.id = n.id
""")
def hash_embed(benchmark: DataFrame) -> DataFrame:
    """Trigram vectors, sparse."""
    x = benchmark.select(F.col("item_id").cast("string").alias("id"), F.col("text").alias("content"))
    return trigram_weights(x).select("id", "bucket", r6("weight").alias("weight"))


RECORD = "id string, wing string, room string, importance double, digest string, times long"


@query("b16_ingest_batch", "memory vector", near=0.3)
def ingest_batch(memory: DataFrame, vector: DataFrame, near: float = 0.92) -> DataFrame:
    """The write path over an arriving batch, every fifth record: one row for each text that arrives, and the table it leaves.

    Texts are validated and redacted (B1, B2), placed in a room (B13), and embedded by their trigrams (B15). Equal texts of a
    wing arrive once. One that is stored raises the stored record (B4); one that resembles a stored one by its vector is
    fused with it (B5); the rest are added. Their links are resolved (B9) and contradictions counted (F1). What changes is
    merged into a table of buckets, of which only the touched ones are rewritten; importance is that of the table after.
    """
    from mnemolake.operators.conflict import DATA_OPPOSITES, conflict_counts

    spark = memory.sparkSession
    old, new = split_batch(memory)
    good = redacted(new.where((F.trim("content") != "") & (F.col("importance") / 5).between(0, 1)), "content", "standard")
    good = good.withColumn("digest", F.sha2("content", 256)).withColumn("room", best_of([(hits(F.lower("content"), ws), name) for name, ws in ROOMS], "general"))
    first = good.groupBy("digest", "wing").agg(F.min_by(F.struct("id", "room", "importance", F.size("redactions").cast("long").alias("redacted")), "id").alias("r"), count().alias("times"))
    first = materialize(first.select("r.*", "wing", "digest", "times"), "arrived")
    stored = old.groupBy(F.sha2("content", 256).alias("digest"), "wing").agg(F.min("id").alias("same"))
    alike = near_duplicate_upsert(memory, vector, near).select("id", F.col("stored").alias("fused"))
    x = first.join(stored, ["digest", "wing"], "left").join(alike, "id", "left")
    action = F.when(F.col("same").isNotNull(), "raise").when(F.col("fused").isNotNull(), "fuse").otherwise("add")
    x = materialize(x.select("id", "wing", "room", "importance", "redacted", "digest", "times", action.alias("action"), F.coalesce("same", "fused", "id").alias("target")), "decided")

    table = BucketTable(spark, f"{shared_dir(spark)}/records-{uuid.uuid4().hex}", RECORD, "id")
    table.merge(old.select("id", "wing", "room", "importance", F.sha2("content", 256).alias("digest"), F.lit(1).cast("long").alias("times")), 0)
    more = x.groupBy("target").agg(F.sum("times").alias("more"), F.max("importance").alias("given"), F.min_by(F.struct("wing", "room", "digest"), "id").alias("n"))
    was = table.read().join(more.select(F.col("target").alias("id")), "id", "left_semi")
    changed = more.join(was, F.col("target") == F.col("id"), "left")
    raised = F.when(F.col("id").isNull(), F.col("given")).otherwise(F.least(F.lit(5.0), F.col("importance") + 0.25 * F.col("more")))
    changed = changed.select(F.col("target").alias("id"), *[F.coalesce(c, f"n.{c}").alias(c) for c in ("wing", "room", "digest")], raised.alias("importance"), (F.coalesce("times", F.lit(0)) + F.col("more")).alias("times"))
    table.merge(changed, 1)

    embedded = trigram_weights(good.join(first.select("id"), "id", "left_semi").select("id", "content")).groupBy("id").agg(count().alias("dimensions"))
    links = resolve_wikilinks(memory).groupBy("id").agg(F.min("mentions").alias("mentions"))
    against = conflict_counts(memory, DATA_OPPOSITES)
    out = x.join(embedded, "id", "left").join(links, "id", "left").join(against, "id", "left").join(table.read().select(F.col("id").alias("target"), F.col("importance").alias("now"), F.col("times").alias("seen")), "target")
    return out.select("id", "wing", "room", "action", "target", "redacted", "times", "seen", r6("now").alias("importance"), F.coalesce("dimensions", F.lit(0)).cast("long").alias("dimensions"), "mentions", F.coalesce("conflicts", F.lit(0)).cast("long").alias("conflicts"))


@query("b17_sessions_from_bridge", "message", """
WITH s AS (SELECT session_id, count(*) AS turns, count(*) FILTER (role = 'user') AS asked, max(turn) AS last_turn, sum(length(text))::BIGINT AS size FROM message GROUP BY 1) SELECT session_id, turns, asked, last_turn, size, row_number() OVER (ORDER BY size DESC, session_id) AS rank FROM s ORDER BY size DESC, session_id LIMIT 20
""", most=20)
def sessions_from_bridge(message: DataFrame, most: int) -> DataFrame:
    """One summary row per session; the largest as context to resume."""
    s = message.groupBy("session_id").agg(count().alias("turns"), n(F.col("role") == "user").alias("asked"), F.max("turn").alias("last_turn"), F.sum(F.length("text")).cast("long").alias("size"))
    best = s.orderBy(F.desc("size"), "session_id").limit(most)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("size"), "session_id")).cast("long"))  # `most` rows only

"""Boilerplate lines by site-relative frequency, in DataFrame functions only.

A line is boilerplate on a site where more than `ratio` of the site's pages hold it. Lines travel as 64-bit hashes;
a site can have at most (mean distinct lines per page) / ratio such lines, so its list is short however large it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemolake.llm.common import materialize, table

RATIO = 0.05
LEAST_PAGES = 5
BROADCAST_HASHES = 1_000_000
SALTS = 64


def _hashes(text: Column) -> Column:
    """Hashes of the distinct trimmed lines that aren't blank."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return F.array_distinct(F.transform(lines, lambda x: F.xxhash64(x)))


def boilerplate(docs: DataFrame, site: Column, text: Column, ratio: float, least_pages: int) -> DataFrame:
    """site, lines (array of hashes): the boilerplate of each site that has some."""
    pages = docs.select(F.coalesce(site, F.lit("")).alias("site"), text.alias("text"))
    lines = pages.select("site", F.explode(_hashes(F.col("text"))).alias("line"))
    counted = lines.groupBy("site", "line").agg(F.count("*").alias("n")).where(F.col("n") >= least_pages)
    totals = materialize(pages.groupBy("site").agg(F.count("*").alias("pages")), "site-totals")
    if totals.count() <= BROADCAST_HASHES:
        frequent = counted.join(F.broadcast(totals), "site")
    else:  # a hot site's lines are dealt over SALTS parts, each of which has the site's total
        totals = totals.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        frequent = counted.withColumn("part", F.pmod("line", F.lit(SALTS)).cast("int")).join(totals, ["site", "part"])
    frequent = frequent.where(F.col("n") > F.lit(ratio) * F.col("pages"))
    return frequent.groupBy("site").agg(F.collect_list("line").alias("lines"))


def drop_boilerplate(docs: DataFrame, ratio: float = RATIO, least_pages: int = LEAST_PAGES, site_col: str = "source", text_col: str = "text", counts: tuple[str, str] | None = None) -> DataFrame:
    """docs with boilerplate lines taken out of the text, and, if named, the numbers of lines and of dropped lines.

    A line is compared without outer spaces; blank lines stay. At least least_pages pages must hold it, so that a site
    of few pages loses nothing. Null text stays null (counts 0); pages without a site are one site; repeated rows
    are pages of their own; an empty table stays empty; further columns pass through, whatever their names, but that a
    column with the name of a count gives way to it. A very long text is one row; its lines are held as an array.
    The lists are broadcast only while they hold at most BROADCAST_HASHES hashes; beyond that they are joined by site.
    """
    text = F.col(f"`{text_col}`")
    lists = materialize(boilerplate(docs, F.col(f"`{site_col}`"), text, ratio, least_pages), "boilerplate")
    size = lists.agg(F.coalesce(F.sum(F.size("lines")), F.lit(0))).first()[0]
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), F.coalesce(F.col(f"`{site_col}`"), F.lit("")).alias("site"))
    joined = rows.join(F.broadcast(lists) if size <= BROADCAST_HASHES else lists, "site", "left")
    whole = F.col("row").getField(text_col)
    hit = F.when(F.col("lines").isNotNull() & whole.isNotNull(), F.array_intersect(_hashes(whole), "lines"))
    found = joined.withColumn("hit", hit)
    some = F.coalesce(F.size("hit"), F.lit(0)) > 0
    left = F.filter(F.split(whole, "\n"), lambda x: ~F.array_contains("hit", F.xxhash64(F.trim(x))) | (F.trim(x) == ""))
    kept = F.when(some, left)
    columns = [F.when(some, F.array_join(F.col("kept"), "\n")).otherwise(whole).alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns if c not in (counts or ())]
    out = found.withColumn("kept", kept)
    if counts:
        n = F.when(whole.isNull(), 0).otherwise(F.size(F.split(whole, "\n"))).cast("long")
        columns += [n.alias(counts[0]), F.when(some, n - F.size("kept")).otherwise(F.lit(0)).cast("long").alias(counts[1])]
    return out.select(*columns)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return drop_boilerplate(docs, counts=("n_lines", "n_dropped")).select("doc_id", "text", "n_lines", "n_dropped")


ORACLE = f"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS site, text, string_split(text, chr(10)) AS ls FROM documents
), l AS (
  SELECT DISTINCT doc_id, site, trim(u) AS line
  FROM (SELECT doc_id, site, unnest(ls) AS u FROM d) WHERE trim(u) <> ''
), c AS (
  SELECT site, line, count(*) AS n FROM l GROUP BY site, line
), t AS (
  SELECT site, count(*) AS pages FROM d GROUP BY site
), b AS (
  SELECT c.site, list(c.line) AS bl FROM c JOIN t ON c.site = t.site
  WHERE c.n >= {LEAST_PAGES} AND c.n > {RATIO}::DOUBLE * t.pages GROUP BY c.site
), k AS (
  SELECT doc_id, text, ls, list_filter(ls, lambda x: trim(x) = '' OR NOT list_contains(coalesce(bl, []), trim(x))) AS kept
  FROM d LEFT JOIN b ON d.site = b.site
)
SELECT doc_id, CASE WHEN text IS NULL THEN NULL ELSE array_to_string(kept, chr(10)) END AS text,
  coalesce(len(ls), 0)::BIGINT AS n_lines, (coalesce(len(ls), 0) - coalesce(len(kept), 0))::BIGINT AS n_dropped
FROM k
"""

"""Row rules as SQL functions, stages and analyzers that users register, and a Python data source for mining."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemolake.functions.columns import count, r6
from mnemolake.plans.registry import query

FUNCTIONS = [
    "CREATE OR REPLACE TEMPORARY FUNCTION estimate_tokens(t STRING) RETURNS BIGINT RETURN CAST(1.5 * regexp_count(t, '[\\u4e00-\\u9fff]') + 0.25 * (length(t) - regexp_count(t, '[\\u4e00-\\u9fff]')) AS BIGINT)",
    "CREATE OR REPLACE TEMPORARY FUNCTION redact_email(t STRING) RETURNS STRING RETURN regexp_replace(t, '(?U)[\\\\w.-]+@[\\\\w.-]+\\\\.\\\\w+', '[EMAIL]')",
    "CREATE OR REPLACE TEMPORARY FUNCTION set_jaccard(a ARRAY<STRING>, b ARRAY<STRING>) RETURNS DOUBLE RETURN size(array_intersect(a, b)) / size(array_union(a, b))",
    "CREATE OR REPLACE TEMPORARY FUNCTION cosine(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x) / sqrt(aggregate(a, 0D, (s, x) -> s + x * x)) / sqrt(aggregate(b, 0D, (s, x) -> s + x * x))",
]


def register_functions(spark: SparkSession) -> None:
    """Make the row rules available to SQL; they are expressions, which the optimizer inlines."""
    for f in FUNCTIONS:
        spark.sql(f)


@query("m4_sql_functions", "memory", "SELECT id, CAST(floor(0.25 * length(content)) AS BIGINT) AS tokens, round(len(list_intersect(tags, ['en', 'src1']))::DOUBLE / len(list_distinct(list_concat(tags, ['en', 'src1']))), 6) AS similarity FROM memory")
def sql_functions(memory: DataFrame) -> DataFrame:
    """The functions called from SQL text."""
    register_functions(memory.sparkSession)
    memory.createOrReplaceTempView("_memory_for_functions")
    return memory.sparkSession.sql("SELECT id, estimate_tokens(content) AS tokens, round(set_jaccard(tags, array('en', 'src1')), 6) AS similarity FROM _memory_for_functions")


class Stages:
    """Functions DataFrame -> DataFrame at named hooks, run in order of priority; one that filters rows out cancels them."""

    def __init__(self):
        self._at: dict[str, list[tuple[int, int, Callable[[DataFrame], DataFrame]]]] = {}

    def register(self, hook: str, stage: Callable[[DataFrame], DataFrame], priority: int = 100) -> None:
        held = self._at.setdefault(hook, [])
        held.append((priority, len(held), stage))

    def run(self, hook: str, df: DataFrame) -> DataFrame:
        for _, _, stage in sorted(self._at.get(hook, []), key=lambda x: x[:2]):
            df = df.transform(stage)
        return df


@query("m1_register_stage", "memory", "SELECT wing, count(*) AS n, round(avg(least(5.0, importance + 0.5)), 6) AS importance FROM memory WHERE importance >= 2 GROUP BY wing")
def staged(memory: DataFrame) -> DataFrame:
    """Two stages before adding: raise importance, and cancel minor records (which runs first)."""
    s = Stages()
    s.register("before_add", lambda d: d.withColumn("importance", F.least(F.lit(5.0), F.col("importance") + 0.5)), 200)
    s.register("before_add", lambda d: d.where("importance >= 2"), 10)
    return s.run("before_add", memory).groupBy("wing").agg(count().alias("n"), r6(F.avg("importance")).alias("importance"))


ANALYZERS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def register_analyzer(name: str, analyze: Callable[[DataFrame], DataFrame]) -> None:
    ANALYZERS[name] = analyze


@query("m2_analyzer", "memory", "SELECT hall AS topic, count(*) AS n, round(max(importance), 6) AS top FROM memory GROUP BY hall")
def analyzed(memory: DataFrame) -> DataFrame:
    """An analyzer registered by name and run."""
    register_analyzer("by_hall", lambda d: d.groupBy(F.col("hall").alias("topic")).agg(count().alias("n"), r6(F.max("importance")).alias("top")))
    return ANALYZERS["by_hall"](memory)


@query("m3_mining_udtf", "pages", "SELECT host, count(*) AS n FROM (SELECT lower(unnest(regexp_extract_all(html, '<a href=\"/([^\"/#?]+)', 1))) AS host FROM pages) GROUP BY host")
def mined(pages: DataFrame) -> DataFrame:
    """A mining plug-in as a table function: the caller's generator sees one page at a time and yields records."""
    from pyspark.sql.functions import udtf

    import re

    link = re.compile(r'<a href="/([^"/#?]+)')

    @udtf(returnType="host string")
    class Mine:
        def eval(self, html: str):
            for target in link.findall(html or ""):
                yield (target.lower(),)

    spark = pages.sparkSession
    spark.udtf.register("mine_links", Mine)
    pages.select("html").createOrReplaceTempView("_pages_to_mine")
    return spark.sql("SELECT m.host, count(*) AS n FROM _pages_to_mine p, LATERAL mine_links(p.html) m GROUP BY m.host")

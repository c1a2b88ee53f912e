"""Column expressions that several operators share. All stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mnemolake.plans.views import AS_OF


def c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def moment(as_of: str = AS_OF) -> Column:
    return F.lit(as_of).cast("timestamp_ntz")


def seconds_between(later: Column, earlier: Column) -> Column:
    """Whole seconds from earlier to later."""
    return F.timestamp_diff("SECOND", earlier, later)


def hours_old(ts: str | Column, as_of: str = AS_OF) -> Column:
    return seconds_between(moment(as_of), c(ts)) / 3600.0


def days_old(ts: str | Column, as_of: str = AS_OF) -> Column:
    return seconds_between(moment(as_of), c(ts)) / 86400.0


def n(condition: Column) -> Column:
    """How many rows meet the condition."""
    return F.coalesce(F.sum(F.when(condition, 1)), F.lit(0)).cast("long")


def count() -> Column:
    return F.count("*").cast("long")


def r6(x: str | Column, digits: int = 6) -> Column:
    return F.round(c(x), digits)


def tokens(text: str | Column) -> Column:
    """Distinct search tokens: runs of CJK characters, and lower-cased Latin words of two characters or more."""
    return F.array_distinct(F.regexp_extract_all(F.lower(c(text)), F.lit("[\\u4e00-\\u9fff]+|[a-z0-9_]{2,}"), F.lit(0)))


def words(text: str | Column) -> Column:
    """White-space separated words, lower-cased, empty ones dropped."""
    return F.filter(F.split(F.lower(c(text)), "[ \\t\\n\\r\\f]+"), lambda x: x != "")


def hits(text: str | Column, keywords: list[str]) -> Column:
    """How many of the keywords the text contains."""
    parts = [F.when(F.contains(c(text), F.lit(k)), 1).otherwise(0) for k in keywords]
    return sum(parts[1:], parts[0]) if parts else F.lit(0)


def any_of(text: str | Column, keywords: list[str]) -> Column:
    out = F.lit(False)
    for k in keywords:
        out = out | F.contains(c(text), F.lit(k))
    return out


def occurrences(text: str | Column, word: str) -> Column:
    """Non-overlapping occurrences."""
    return ((F.length(c(text)) - F.length(F.replace(c(text), F.lit(word), F.lit("")))) / len(word)).cast("int")


def dot(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(c(a), c(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def cosine(a: str | Column, b: str | Column) -> Column:
    """0 where either vector is; unequal lengths are cut to the shorter."""
    m = F.least(F.size(c(a)), F.size(c(b)))
    x, y = F.slice(c(a), F.lit(1), m), F.slice(c(b), F.lit(1), m)
    norm = F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))
    return F.when(norm > 0, dot(x, y) / norm).otherwise(0.0)


def jaccard(a: str | Column, b: str | Column) -> Column:
    """Of two arrays without repeats."""
    both = F.size(F.array_intersect(c(a), c(b)))
    all_ = F.size(c(a)) + F.size(c(b)) - both
    return F.when(all_ > 0, both / all_).otherwise(0.0)


def estimate_tokens(text: str | Column) -> Column:
    """int(1.5 per CJK character + 0.25 per other)."""
    cjk = F.regexp_count(c(text), F.lit("[\\u4e00-\\u9fff]"))
    return (1.5 * cjk + 0.25 * (F.length(c(text)) - cjk)).cast("long")


def best_of(options: list[tuple[Column, str]], default: str | None = None) -> Column:
    """Name of the option with the highest count; ties to the earlier; default if all are 0."""
    ranked = F.array_max(F.array(*[F.struct(v.alias("v"), F.lit(-i).alias("o"), F.lit(name).alias("name")) for i, (v, name) in enumerate(options)]))
    return F.when(ranked["v"] > 0, ranked["name"]).otherwise(F.lit(default))


def labels(options: list[tuple[Column, str]]) -> Column:
    """Names of the options that hold, in order."""
    return F.filter(F.array(*[F.when(cond, F.lit(name)) for cond, name in options]), lambda x: x.isNotNull())

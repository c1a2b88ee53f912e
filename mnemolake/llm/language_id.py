"""Language identification by Bayesian fusion of text, declared language, address suffix and host.

The text's likelihood comes from byte trigrams (hashed to 2**16 buckets) counted on a bounded sample of labelled
rows. Grouped counts over all rows give the rest: how often each declared language goes with each language, and priors
for hosts, smoothed towards their address suffix, which is smoothed towards the whole corpus. A page's own vote is
taken out of its host's counts.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mnemolake.llm.common import give_back, materialize, slices, table, text_bytes

LANGUAGES = ("de", "en", "es", "fr")
UNKNOWN = "und"
TRAIN_DOCS = 400  # labelled rows for each language at most, those of least hash
TRAIN_BYTES = 1 << 15  # longer texts take no part in training, so the sample is at most TRAIN_DOCS * TRAIN_BYTES a language
BUCKETS = 1 << 16
TEXT_WEIGHT = 1 / 3  # neighbouring trigrams share bytes
HOST_WEIGHT = 5.0  # a host's prior counts as many pages
UNKNOWN_PRIOR = 1e-3
LEAST_POSTERIOR = 0.5
BROADCAST_HOSTS = 200_000
SALTS = 64
SLICE_BYTES = 1 << 20
_LOWER = np.arange(256, dtype=np.int32)
_LOWER[65:91] += 32
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_LETTER[65:91] = True
_LETTER[128:] = True


def _trigrams(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of the trigram at each byte, whether it counts: within one text, and holding a letter)."""
    n = len(raw)
    if n < 3:
        return np.zeros(n, np.int32), np.zeros(n, bool)
    low, letter = _LOWER[raw], _LETTER[raw]
    bucket = np.zeros(n, np.int32)
    bucket[:-2] = (low[:-2] * 40503 + low[1:-1] * 2531 + low[2:] * 157) % BUCKETS
    counts = np.zeros(n, bool)
    counts[:-2] = letter[:-2] | letter[1:-1] | letter[2:]
    for back in (1, 2):
        ends = offsets[1:] - back
        counts[ends[(ends >= 0) & (ends < n)]] = False
    return bucket, counts


def train(labelled: list[tuple[str, str]], languages: tuple[str, ...] = LANGUAGES) -> np.ndarray:
    """Log probabilities (buckets, languages) with half a count added everywhere."""
    out = np.full((BUCKETS, len(languages)), 0.5)
    for k, lang in enumerate(languages):
        texts = pa.array([t for label, t in labelled if label == lang and t], pa.string())
        bucket, counts = _trigrams(*text_bytes(texts))
        out[:, k] += np.bincount(bucket[counts], minlength=BUCKETS)
    return np.log(out / out.sum(0)).astype(np.float32)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", languages: tuple[str, ...] = LANGUAGES, most: int = TRAIN_DOCS, longest: int = TRAIN_BYTES) -> np.ndarray:
    """Train on at most `most` texts of each language, of at most `longest` bytes; ids are chosen first, so only the sample's
    texts move. Rows with one id and language count once."""
    short = docs.where(F.octet_length(text_col) <= longest)
    sample: list[tuple[str, str]] = []
    for lang in languages:
        own = short.where((F.col(label_col) == lang) & F.col(id_col).isNotNull())
        ids = [r[0] for r in own.select(id_col).orderBy(F.xxhash64(id_col), id_col).limit(most).collect()]
        if ids:
            texts = own.where(F.col(id_col).isin(ids)).groupBy(id_col).agg(F.min(text_col))
            sample += [(lang, r[1]) for r in texts.collect()]
    return train(sample, languages)


def text_scores(texts: pa.Array, model: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(weighted log likelihoods of the languages and, last, of unknown text; trigrams counted), one row for each text.

    A slice of SLICE_BYTES is worked on at a time.
    """
    flat = np.float64(-np.log(BUCKETS))
    raw, offsets = text_bytes(texts)
    got, counted = np.zeros((len(texts), model.shape[1] + 1)), np.zeros(len(texts), np.int64)
    for i, j in slices(texts, np.diff(offsets), SLICE_BYTES):
        own = offsets[i : j + 1] - offsets[i]
        bucket, counts = _trigrams(raw[offsets[i] : offsets[j]], own)
        where = np.flatnonzero(counts)
        cut = np.searchsorted(where, own)
        n = np.diff(cut)
        if len(where):
            starts = cut[:-1][n > 0]
            got[i:j][n > 0, :-1] = np.add.reduceat(model[bucket[where]], starts, axis=0, dtype=np.float64) * TEXT_WEIGHT
        got[i:j, -1] = n * flat * TEXT_WEIGHT
        counted[i:j] = n
    return got, counted


def vote_of(text: Column, model) -> Column:
    """Position of the best language by text alone; of equals the first; null without evidence. Only the text goes to Python."""

    def vote(texts: pa.Array) -> pa.Array:
        scores, counted = text_scores(texts, model.value)
        give_back()
        return pa.array(scores.argmax(1), pa.int32(), mask=counted == 0)

    return F.arrow_udf(vote, T.IntegerType())(text)


def smoothed(counted: np.ndarray, own: np.ndarray, parent: np.ndarray) -> np.ndarray:
    """Shares of the counts without a row's own vote, the parent's counting as HOST_WEIGHT pages."""
    others = np.maximum(counted - own, 0)
    return (others + HOST_WEIGHT * parent) / (others.sum(1, keepdims=True) + HOST_WEIGHT)


def fused(text: Column, declared: Column, host_counts: Column, suffix_counts: Column, model, prior: np.ndarray, evidence: dict[str, np.ndarray], languages: tuple[str, ...]) -> Column:
    """struct of language, posterior, accepted: all evidence of a row in one pass of Arrow arrays.

    It counts as non-deterministic so that a filter on the result doesn't have it computed twice.
    """
    names = np.array([*languages, UNKNOWN])

    def lists(col: pa.Array, default: np.ndarray) -> np.ndarray:
        out = default.copy()
        there = col.is_valid().to_numpy(zero_copy_only=False)
        out[there] = col.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(names))
        return out

    def fuse(texts: pa.Array, said: pa.Array, of_host: pa.Array, of_suffix: pa.Array) -> pa.Array:
        log, counted = text_scores(texts, model.value)
        some = counted > 0
        own = np.zeros_like(log)
        own[np.flatnonzero(some), log[some].argmax(1)] = 1
        by_suffix = smoothed(lists(of_suffix, own), own, prior[None, :])
        by_host = smoothed(lists(of_host, own), own, by_suffix)
        told = np.array([evidence.get(d, np.zeros(len(names))) for d in said.to_pylist()]).reshape(-1, len(names))
        log = log + told + np.log(by_host)
        posterior = 1 / np.exp(log - log.max(1, keepdims=True)).sum(1) if len(log) else np.zeros(0)
        language = np.where(some, names[log.argmax(1)] if len(log) else names[:0], UNKNOWN)
        posterior = np.where(some, posterior, 0.0)
        give_back()
        return pa.StructArray.from_arrays([pa.array(language.tolist(), pa.string()), pa.array(posterior), pa.array((language != UNKNOWN) & (posterior >= LEAST_POSTERIOR))], ["language", "posterior", "accepted"])

    kind = T.StructType([T.StructField("language", T.StringType()), T.StructField("posterior", T.DoubleType()), T.StructField("accepted", T.BooleanType())])
    return F.arrow_udf(fuse, kind).asNondeterministic()(text, declared, host_counts, suffix_counts)


def suffix_of(host: Column) -> Column:
    """Last label of a host name that has several."""
    return F.when(F.instr(host, ".") > 0, F.lower(F.substring_index(host, ".", -1)))


def declared_language(value: Column, languages: tuple[str, ...]) -> Column:
    """Primary subtag if it is one of the languages, else "other"; null where nothing is declared."""
    primary = F.lower(F.regexp_extract(value, "^\\s*([A-Za-z]+)", 1))
    return F.when(primary == "", None).when(primary.isin(*languages), primary).otherwise(F.when(value.isNotNull(), F.lit("other")))


def identify(docs: DataFrame, model: np.ndarray, text_col: str = "text", declared: Column | None = None, host: Column | None = None, languages: tuple[str, ...] = LANGUAGES, new: str = "found") -> DataFrame:
    """docs with one struct column more: language ("und" for unknown), posterior, accepted.

    A text without a letter trigram (null, empty, digits) is "und". A row is accepted if its language is known and its
    posterior at least LEAST_POSTERIOR. Missing declared language or host: no evidence from it. Repeated rows count each;
    an empty table stays empty; further columns pass through, but that one named `new` gives way. A very long text is one
    slice of its own. Host counts are broadcast only up to BROADCAST_HOSTS hosts, otherwise joined by host.
    """
    spark, names = docs.sparkSession, docs.columns
    n_lang = len(languages) + 1
    shared = spark.sparkContext.broadcast(model)
    none = F.lit(None).cast("string")
    given = docs.select(F.struct(*[docs[f"`{c}`"] for c in names]).alias("row"), declared_language(none if declared is None else declared, languages).alias("declared"), (none if host is None else host).alias("host"))
    text = F.col("row").getField(text_col)

    # Pass over the corpus for counts.
    votes = given.select("declared", "host", suffix_of(F.col("host")).alias("suffix"), vote_of(text, shared).alias("vote"))
    cube = materialize(votes.groupBy("declared", "host", "suffix", "vote").agg(F.count("*").alias("n")).where("vote is not null"), "votes")
    base = np.full(n_lang, 1.0)
    said: dict[str, np.ndarray] = defaultdict(lambda: np.full(n_lang, 1.0))
    for r in cube.groupBy("declared", "vote").agg(F.sum("n").alias("n")).collect():  # languages squared
        base[r["vote"]] += r["n"]
        if r["declared"] is not None:
            said[r["declared"]][r["vote"]] += r["n"]
    prior = base / base.sum()
    prior[-1] = min(prior[-1], UNKNOWN_PRIOR)
    prior = prior / prior.sum()
    per_vote = sum(said.values()) if said else np.ones(n_lang)
    evidence = {d: np.log(c / per_vote) for d, c in said.items()}

    counts = [F.coalesce(F.sum(F.when(F.col("vote") == k, F.col("n"))), F.lit(0)).cast("double") for k in range(n_lang)]
    by_suffix = cube.where("suffix is not null").groupBy("suffix").agg(F.array(*counts).alias("suffix_counts"))
    by_host = cube.where("host is not null").groupBy("host", "suffix").agg(F.array(*counts).alias("host_counts")).join(by_suffix, "suffix", "left")
    hosts = materialize(by_host.select("host", "host_counts", "suffix_counts"), "hosts")
    if hosts.count() <= BROADCAST_HOSTS:
        joined = given.join(F.broadcast(hosts), "host", "left")
    else:  # a hot host's rows are dealt over SALTS parts
        spread = hosts.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = given.withColumn("part", F.pmod(F.xxhash64(text), F.lit(SALTS)).cast("int")).join(spread, ["host", "part"], "left")
    found = fused(text, F.col("declared"), F.col("host_counts"), F.col("suffix_counts"), shared, prior, evidence, languages)
    return joined.select(*[F.col("row").getField(c).alias(c) for c in names if c != new], found.alias(new))


def drop_unidentified(docs: DataFrame, model: np.ndarray, declared: Column | None = None, host: Column | None = None) -> DataFrame:
    """Accepted documents, with the columns they had."""
    new = "_" * (1 + max(map(len, docs.columns))) + "found"
    return identify(docs, model, declared=declared, host=host, new=new).where(F.col(f"{new}.accepted")).drop(new)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents: the lang column is what they declare, source is their host."""
    docs = table(spark, sf_dir, "documents")
    found = identify(docs.select("doc_id", "text", "lang", "source"), fit(docs), declared=F.col("lang"), host=F.col("source"))
    return found.select("doc_id", "lang", "found.language", F.round("found.posterior", 6).alias("posterior"), "found.accepted")


def op9_language_id_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages: declared language from the html element, host and suffix from the address, text without mark-up."""
    pages = table(spark, sf_dir, "pages")
    bare = F.regexp_replace(F.regexp_replace("html", "(?is)<(script|style)[^>]*>.*?</\\1>|<!--.*?-->", " "), "<[^>]*>", " ")
    rows = pages.select("page_id", F.regexp_extract("html", "(?i)<html[^>]*\\blang\\s*=\\s*[\"']?([A-Za-z-]+)", 1).alias("declared"), F.lower(F.regexp_extract("url", "^[A-Za-z]+://([^/:?#]+)", 1)).alias("host"), bare.alias("text"))
    found = identify(rows, fit(table(spark, sf_dir, "documents")), declared=F.col("declared"), host=F.col("host"))
    return found.select("page_id", "declared", "host", "found.language", F.round("found.posterior", 6).alias("posterior"), "found.accepted")

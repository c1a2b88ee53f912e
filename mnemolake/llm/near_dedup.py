"""MinHash near-duplicates with sequential Bayesian verification.

Every document's set of word shingles gives a signature of minima and, from bands of it, bucket keys. Documents
with equal sets are one node (the smallest doc_id stands for them). In each bucket the smallest node is compared
with the others first. What is still apart then is compared block by block, nodes outside the bucket's main component
with all others, so that no pair of a bucket is left out and no list of pairs leaves a task. In buckets with more
than LARGE outside, nodes whose own shingles alone rule out a link are left out before; where more than LARGE remain to
be compared, the bucket is split by the rarest shingles of each, of which two documents of the threshold always share one. A compared
pair goes through its signature batch by batch and is dropped as soon as the posterior chance that its
similarity reaches the threshold falls under `miss`; the survivors are verified on their full shingle sets.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemolake.llm.common import materialize, slices, table, text_bytes, tidy
from mnemolake.operators.components import connected_components

SHINGLE = 5
BANDS, ROWS = 24, 5
THRESHOLD = (85, 100)
MISS = 1e-6
#: Settings for a threshold of 0.8: there two documents fail to share a bucket with a chance of 7e-7.
FOUR_FIFTHS = {"threshold": (80, 100), "bands": 27, "rows": 4}
BATCH = 24
BLOCK = 256
#: Nodes that have to meet all others of a bucket from which on it is split by rare shingles.
LARGE = 4096
#: Open buckets up to which their sizes are broadcast; beyond it they are joined.
BROADCAST_BUCKETS = 1_000_000
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if len(_POWERS[0]) < n:
        n = max(n, 1 << 20)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _POWERS[k] = np.cumprod(p)
    return _POWERS[0], _POWERS[1]


def shingle_hashes(raw: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of every document's shingles in order, offsets of documents in them).

    Words are runs of bytes other than ASCII white space, A-Z lower-cased. A document of fewer words than a
    shingle has its whole word sequence as one; one without words has none.
    """
    n = len(raw)
    docs = len(offsets) - 1
    if not n:
        return np.zeros(0, np.uint64), np.zeros(docs + 1, np.int64)
    inside = ~_SPACE[raw]
    bound = np.zeros(n + 1, bool)
    bound[offsets] = True
    edge = np.empty(n, bool)
    edge[0] = True
    edge[1:] = ~inside[:-1]
    starts = np.flatnonzero(inside & (edge | bound[:-1]))
    edge[-1] = True
    edge[:-1] = ~inside[1:]
    ends = np.flatnonzero(inside & (edge | bound[1:])) + 1
    power, inverse = _powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((_LOWER[raw].astype(np.uint64) + np.uint64(1)) * power[:n], out=total[1:])
    words = mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    first = np.searchsorted(starts, offsets)
    count = np.diff(first)
    n_shingles = np.where(count >= size, count - size + 1, np.minimum(count, 1))
    at = np.concatenate([[0], np.cumsum(n_shingles)])
    begin = np.arange(at[-1]) - np.repeat(at[:-1] - first[:-1], n_shingles)
    length = np.repeat(np.minimum(count, size), n_shingles)
    out = length.astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
    for k in range(size):
        use = length > k
        out[use] = out[use] * np.uint64(0xE7037ED1A0B428DB) + words[np.minimum(begin[use] + k, len(words) - 1)]
    return mix(out), at


def distinct_sets(hashes: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    return [np.unique(hashes[i:j]) for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def _multipliers(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def minima(sets: list[np.ndarray], n: int) -> np.ndarray:
    """(documents, n) 32-bit minima; every set must hold something."""
    out = np.empty((len(sets), n), np.uint32)
    many = _multipliers(n)
    i = 0
    while i < len(sets):  # some ten thousand hashes at a time stay in the cache
        j, held = i, 0
        while j < len(sets) and (j == i or held + len(sets[j]) <= 1 << 15):
            held += len(sets[j])
            j += 1
        x = np.concatenate(sets[i:j])
        starts = np.concatenate([[0], np.cumsum([len(s) for s in sets[i : j - 1]])]).astype(np.int64)
        buf = np.empty_like(x)
        for k in range(n):
            np.multiply(x, many[k], out=buf)
            out[i:j, k] = np.minimum.reduceat(buf, starts) >> np.uint64(32)
        i = j
    return out


def band_keys(minhash: np.ndarray, bands: int, rows: int) -> np.ndarray:
    out = np.empty((len(minhash), bands), np.int64)
    for b in range(bands):
        key = np.full(len(minhash), np.uint64(b + 1))
        for r in range(rows):
            key = mix(key ^ minhash[:, b * rows + r].astype(np.uint64)) + np.uint64(r)
        out[:, b] = key.view(np.int64)
    return out


def features(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """doc_id, n (set size), fp (digest of the set), sig (low halves of the minima), bands. No shuffle."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            raw, offsets = text_bytes(b.column(1))
            for i, j in slices(b, np.diff(offsets), 1 << 20):
                sets = distinct_sets(*shingle_hashes(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]))
                full = [k for k, s in enumerate(sets) if len(s)]
                mins = minima([sets[k] for k in full], bands * rows)
                keys, low = band_keys(mins, bands, rows), mins.astype("<u2")
                fp, sig, key = ([None] * len(sets) for _ in range(3))
                for r, k in enumerate(full):
                    fp[k] = hashlib.blake2b(sets[k].tobytes(), digest_size=16).digest()
                    sig[k], key[k] = low[r].tobytes(), keys[r]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), pa.array([len(s) for s in sets], pa.int64()), pa.array(fp, pa.binary()), pa.array(sig, pa.binary()), pa.array(key, pa.list_(pa.int64()))],
                    ["doc_id", "n", "fp", "sig", "bands"],
                )

    return docs.select("doc_id", "text").mapInArrow(tidy(run), f"doc_id {kind}, n long, fp binary, sig binary, bands array<long>")


def fewest_matches(total: int, threshold: float, miss: float, batch: int = BATCH) -> list[tuple[int, int]]:
    """(minima compared, fewest equal ones with which a pair goes on) for each batch.

    With m of n minima equal and a uniform prior, the similarity is Beta(m + 1, n - m + 1); a pair goes on while
    the chance that it is at least the threshold is miss or more.
    """
    grid = (np.arange(200_000) + 0.5) / 200_000
    out = []
    for n in range(batch, total + 1, batch):
        for m in range(n + 1):
            log = m * np.log(grid) + (n - m) * np.log1p(-grid)
            p = np.exp(log - log.max())
            if p[grid >= threshold].sum() / p.sum() >= miss:
                out.append((n, m))
                break
    return out


def bayes_filter(pairs: DataFrame, signatures: DataFrame, total: int, threshold: tuple[int, int], miss: float) -> DataFrame:
    """Pairs (a, b) whose signatures leave the threshold likely enough, and whose set sizes allow it."""
    steps = fewest_matches(total, threshold[0] / threshold[1], miss)
    num, den = threshold

    def run(batches):
        for b in batches:
            a_sig, b_sig = (np.frombuffer(b"".join(b.column(k).to_pylist()), "<u2").reshape(-1, total) for k in (2, 3))
            alive, equal, done = np.arange(b.num_rows), np.zeros(b.num_rows, np.int64), 0
            for n, least in steps:
                equal = equal + (a_sig[alive, done:n] == b_sig[alive, done:n]).sum(1)
                go = equal >= least
                alive, equal, done = alive[go], equal[go], n
            yield pa.RecordBatch.from_arrays([b.column(k).take(pa.array(alive)) for k in (0, 1)], ["a", "b"])

    left, right = (signatures.select(F.col("doc_id").alias(k), F.col("sig").alias(f"{k}_sig"), F.col("n").alias(f"{k}_n")) for k in "ab")
    joined = pairs.join(left, "a").join(right, "b").where(den * F.least("a_n", "b_n") >= num * F.greatest("a_n", "b_n"))
    kind = signatures.schema["doc_id"].dataType.simpleString()
    return joined.select("a", "b", "a_sig", "b_sig").mapInArrow(tidy(run), f"a {kind}, b {kind}")


def verify(pairs: DataFrame, docs: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """Pairs (a, b) whose full shingle sets reach the threshold."""
    num, den = threshold
    texts = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text")

    def run(batches):
        for b in batches:
            sizes = sum(np.diff(text_bytes(b.column(k))[1]) for k in (2, 3))
            for i, j in slices(b, sizes, 1 << 20):
                part, keep = b.slice(i, j - i), []
                sides = []
                for k in (2, 3):
                    raw, offsets = text_bytes(part.column(k))
                    sides.append(distinct_sets(*shingle_hashes(raw, offsets)))
                for x, y in zip(*sides, strict=True):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(bool(both) and den * both >= num * (len(x) + len(y) - both))
                yield pa.RecordBatch.from_arrays([part.column(k).filter(pa.array(keep)) for k in (0, 1)], ["a", "b"])

    joined = pairs.join(texts.withColumnsRenamed({"doc_id": "b", "text": "b_text"}), "b").join(texts.withColumnsRenamed({"doc_id": "a", "text": "a_text"}), "a")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return joined.select("a", "b", "a_text", "b_text").mapInArrow(tidy(run), f"a {kind}, b {kind}")


def shingle_sets(texts: DataFrame) -> DataFrame:
    """doc_id, hashes: the distinct shingle hashes of each text, ascending, as bytes."""

    def sets_of(batches):
        for b in batches:
            raw, offsets = text_bytes(b.column(1))
            for i, j in slices(b, np.diff(offsets), 1 << 20):
                sets = distinct_sets(*shingle_hashes(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array([x.tobytes() for x in sets], pa.binary())], ["doc_id", "hashes"])

    return texts.mapInArrow(tidy(sets_of), f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, hashes binary")


def shingle_rows(nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """doc_id, n, key: the shingles of each node, one to a row, written."""
    kind = nodes.schema["doc_id"].dataType.simpleString()

    def apart(batches):
        for b in batches:
            sizes = np.array([len(x.as_py()) // 8 for x in b.column(1)])
            flat = np.frombuffer(b"".join(b.column(1).to_pylist()), np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.repeat(np.arange(len(sizes)), sizes))), pa.array(np.repeat(sizes, sizes)), pa.array(flat)], ["doc_id", "n", "key"])

    own = nodes.select("doc_id").distinct()
    return materialize(sets.join(own, "doc_id", "left_semi").select("doc_id", "hashes").mapInArrow(tidy(apart), f"doc_id {kind}, n long, key long"), "shingles")


def linkable(nodes: DataFrame, sets: DataFrame, each: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """key, doc_id, c, core of the nodes that can have a link; the rest hold too many shingles that no other node holds.

    With u of its n shingles in no other node, a node's similarity to any is at most (n - u) / n. To one of no fewer
    shingles it is at most (n - u) / (n + u); nodes for which that reaches the threshold are core, and each link has one at
    least at its end of fewer shingles. Only counts leave the exchanges. A doc_id of several rows is core.
    """
    num, den = threshold
    lone = each.groupBy("key").agg(F.count("*").alias("df"), F.min("doc_id").alias("doc_id")).where("df = 1").groupBy("doc_id").agg(F.count("*").alias("u"))
    own = sets.join(nodes.select("doc_id").distinct(), "doc_id", "left_semi").groupBy("doc_id").agg(F.count("*").alias("rows"), F.sum(F.octet_length("hashes") / 8).cast("long").alias("n"))
    n, u, several = F.col("n"), F.coalesce("u", F.lit(0)), F.col("rows") > 1
    marked = own.join(lone, "doc_id", "left").where(several | (den * (n - u) >= num * n))
    marked = marked.select("doc_id", (several | (den * (n - u) >= num * (n + u))).alias("core"))
    return nodes.select("key", "doc_id", "c").join(marked, "doc_id").select("key", "doc_id", "c", "core")


def rare_buckets(nodes: DataFrame, each: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """key, doc_id, c, core: each node under those of its rarest shingles of which a node as similar as the threshold holds one.

    With shingles ordered by how many of the nodes hold them, two sets of n and more shingles that have the threshold in
    common share one of the first n - ceil(threshold * n) + 1. A shingle of one node only takes up its place.
    """
    num, den = threshold
    own = nodes.select("doc_id", "c", "core").distinct()
    each = each.join(own, "doc_id", "left_semi")
    held = each.groupBy("key").agg(F.count("*").alias("df")).where("df > 1")
    ranked = each.join(held, "key").groupBy("doc_id", "n").agg(F.array_sort(F.collect_list(F.struct("df", "key"))).alias("r"))  # one document's shingles
    first = F.col("n") - F.ceil(F.lit(num) * F.col("n") / den - 1e-9) + 1 - (F.col("n") - F.size("r"))
    keys = ranked.select("doc_id", F.explode(F.slice("r", F.lit(1), F.greatest(F.lit(0), first).cast("int"))).alias("r"))
    return keys.select(F.col("r.key").alias("key"), "doc_id").join(own, "doc_id").select("key", "doc_id", "c", "core")


def settle(open_nodes: DataFrame, texts: DataFrame, signatures: DataFrame, total: int, threshold: tuple[int, int], miss: float, large: int = LARGE) -> DataFrame:
    """Links (a, b) among the nodes of each bucket that aren't in one component yet.

    open_nodes: key, doc_id, c (component), and the bucket's m, main and outside of open_buckets. A bucket is dealt by hash
    into blocks of about BLOCK nodes and each pair of blocks that holds nodes outside the main component is one group, so
    a group stays small whatever the bucket holds. From buckets with more than `large` nodes outside, those that can have
    no link are left out first, and if fewer are core (see linkable) than outside, these meet the others instead; below
    that the copies of blocks are fewer than the rows of all shingles. A bucket in which more than `large` nodes still
    meet the others is replaced by the buckets of its nodes' rare shingles. A pair is looked at in the first of its common buckets (of rare shingles, in each), sequentially by
    signature, then on full sets; links are all that leaves a group, a spanning forest of it.
    """
    kind = signatures.schema["doc_id"].dataType.simpleString()
    sets = shingle_sets(texts)
    about = signatures.select("doc_id", "n", "sig", "bands").join(sets, "doc_id")

    def links(nodes: DataFrame, once: bool) -> DataFrame:
        return _blocks(nodes).join(about, "doc_id").groupBy("key", "i", "j").applyInArrow(_links_of_blocks(threshold, miss, total, once), f"a {kind}, b {kind}")

    beyond = F.col("outside") > large
    small = links(_meeting(open_nodes.where(~beyond).withColumn("core", F.lit(True))), True)
    wide = open_nodes.where(beyond)
    if wide.isEmpty():
        return small
    each = shingle_rows(wide, sets)
    wide = materialize(linkable(wide, sets, each, threshold), "linkable")
    wide = _meeting(wide.join(_few(materialize(open_buckets(wide), "wide-buckets")), "key"))
    small = small.unionByName(links(wide.where(F.col("k") <= large), True))
    hot = wide.where(F.col("k") > large)
    if hot.isEmpty():
        return small
    rare = materialize(rare_buckets(hot, each, threshold), "rare")
    return small.unionByName(links(_meeting(rare.join(_few(materialize(open_buckets(rare), "rare-buckets")), "key")), False))


def open_buckets(nodes: DataFrame) -> DataFrame:
    """key, m (nodes), main (the component that most of them are in), outside (nodes not in it) of buckets not all in one.

    Where nodes have the column core, its nodes are counted as n_core and buckets without any are left out.
    """
    core = "core" in nodes.columns
    by_part = nodes.groupBy("key", "c").agg(F.count("*").alias("n"), F.count_if("core" if core else F.lit(True)).alias("n_core"))
    whole = by_part.groupBy("key").agg(F.sum("n").alias("m"), F.max_by("c", F.struct("n", "c")).alias("main"), F.max("n").alias("most"), F.sum("n_core").alias("n_core"))
    return whole.where("most < m AND n_core > 0").select("key", "m", "main", (F.col("m") - F.col("most")).alias("outside"), *["n_core"] * core)


def _meeting(nodes: DataFrame) -> DataFrame:
    """key, doc_id, c, core, m, few, k: few marks the k nodes that meet all others of the bucket, those outside the main component
    or, where they are fewer, the core ones; a pair that can be a link holds one of either kind."""
    outside, n_core = F.col("outside"), F.col("n_core") if "n_core" in nodes.columns else F.col("m")
    few = F.when(n_core < outside, F.col("core")).otherwise(F.col("c") != F.col("main"))
    return nodes.select("key", "doc_id", "c", "core", "m", few.alias("few"), F.least(n_core, outside).alias("k"))


def _few(table_: DataFrame) -> DataFrame:
    """A written table, to be broadcast where it is small enough."""
    return F.broadcast(table_) if table_.count() <= BROADCAST_BUCKETS else table_


def _blocks(nodes: DataFrame) -> DataFrame:
    """key, i, j, block, doc_id, c: every node once for each pair of blocks of its bucket that it takes part in.

    Blocks of the few that meet all come first; only they meet others, so the rows are about 2 * k * m / BLOCK.
    """
    first, second = (F.ceil(x / BLOCK) for x in (F.col("k"), F.col("m") - F.col("k")))
    spread = F.xxhash64("doc_id", "key")
    place = nodes.withColumn("block", F.when(F.col("few"), F.pmod(spread, first)).otherwise(first + F.pmod(spread, second)))
    met = F.when(F.col("few"), first + second).otherwise(first) - 1
    pairs = place.select("key", "doc_id", "c", "block", F.explode(F.sequence(F.lit(0).cast("long"), met)).alias("other"))
    return pairs.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "doc_id", "c")


def _links_of_blocks(threshold: tuple[int, int], miss: float, total: int, once: bool):
    """The function of one pair of blocks; once: leave a pair to the first band that its two documents share."""
    steps = fewest_matches(total, threshold[0] / threshold[1], miss)
    num, den = threshold

    def links_of(t: pa.Table) -> pa.Table:
        key, one, two = (t[c][0].as_py() for c in ("key", "i", "j"))
        block, n = t["block"].to_numpy(), t["n"].to_numpy()
        ids, comps = t["doc_id"].to_pylist(), t["c"].to_pylist()
        bands = np.array(t["bands"].to_pylist(), np.int64)
        sig = np.frombuffer(b"".join(t["sig"].to_pylist()), "<u2").reshape(-1, total)
        x, y = np.flatnonzero(block == one), np.flatnonzero(block == two)
        x, y = (v.ravel() for v in np.meshgrid(x, y, indexing="ij"))
        keep = x < y if one == two else np.ones(len(x), bool)
        number = {c: k for k, c in enumerate(dict.fromkeys(comps))}
        comp = np.array([number[c] for c in comps])
        keep &= (comp[x] != comp[y]) & (den * np.minimum(n[x], n[y]) >= num * np.maximum(n[x], n[y]))
        x, y = x[keep], y[keep]
        equal, done = np.zeros(len(x), np.int64), 0
        for upto, least in steps:
            equal = equal + (sig[x, done:upto] == sig[y, done:upto]).sum(1)
            go = equal >= least
            x, y, equal, done = x[go], y[go], equal[go], upto
        if once and len(x):
            same = bands[x] == bands[y]
            own = bands[x, same.argmax(1)] == key
            x, y, equal = x[own], y[own], equal[own]
        order = np.argsort(-equal, kind="stable")
        root = list(range(len(number)))

        def top(k):
            while root[k] != k:
                root[k] = root[root[k]]
                k = root[k]
            return k

        hashes, sets = t["hashes"], {}
        a_out, b_out = [], []
        for i, j in zip(x[order].tolist(), y[order].tolist(), strict=True):
            p, q = top(comp[i]), top(comp[j])
            if p == q:
                continue
            u, v = (sets[k] if k in sets else sets.setdefault(k, np.frombuffer(hashes[k].as_py(), np.uint64)) for k in (i, j))
            both = len(np.intersect1d(u, v, assume_unique=True))
            if both and den * both >= num * (len(u) + len(v) - both):
                root[p] = q
                a_out.append(ids[i])
                b_out.append(ids[j])
        return pa.table({"a": pa.array(a_out, t.schema.field("doc_id").type), "b": pa.array(b_out, t.schema.field("doc_id").type)})

    return links_of


def _placed(members: DataFrame, parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, doc_id, c of every member, its open buckets). A bucket of two has been compared by its hub."""
    placed = members.select("key", "doc_id").join(parts, F.col("doc_id") == F.col("node"), "left").select("key", "doc_id", F.coalesce("component", "doc_id").alias("c"))
    return placed, materialize(open_buckets(placed).where("m > 2"), "open-buckets")


def near_duplicates(docs: DataFrame, threshold: tuple[int, int] = THRESHOLD, bands: int = BANDS, rows: int = ROWS, miss: float = MISS, large: int = LARGE) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per input row.

    Links join documents whose five-word shingle sets (full sets, 64-bit hashes) have at least threshold in common;
    component_id is the smallest doc_id reachable. Two documents of just that similarity meet in a bucket with
    a chance of 1 - (1 - s**rows)**bands (all but 8e-7 at 0.85 as set here).

    Null or wordless text: n_shingles 0, a component of its own. Null doc_id: never linked, component_id null, kept.
    Rows with one doc_id are one document. Empty table: no rows. Other columns aren't read. A very long text is one
    slice of its own, in memory some ten times over.
    """
    docs = docs.select("doc_id", "text")
    feats = materialize(features(docs, bands, rows), "minhash")
    groups = feats.where(F.col("doc_id").isNotNull() & F.col("fp").isNotNull()).groupBy("fp").agg(F.min("doc_id").alias("rep"))
    groups = materialize(groups, "sets")
    nodes = feats.join(groups, (feats.fp == groups.fp) & (feats.doc_id == groups.rep), "left_semi")
    buckets = nodes.select("doc_id", F.explode("bands").alias("key"))
    shared = buckets.groupBy("key").agg(F.min("doc_id").alias("hub"), F.max("doc_id").alias("last")).where("hub < last").select("key", "hub")
    members = materialize(buckets.join(shared, "key"), "buckets")
    # Only documents that share a bucket are looked at from here on.
    met = members.select("doc_id").distinct()
    signatures = materialize(nodes.select("doc_id", "n", "sig", "bands").join(met, "doc_id", "left_semi"), "signatures")
    texts = materialize(docs.where(F.col("text").isNotNull()).join(met, "doc_id", "left_semi").select("doc_id", "text"), "texts")

    pairs = members.where("hub < doc_id").select(F.col("hub").alias("a"), F.col("doc_id").alias("b")).distinct()
    likely = materialize(bayes_filter(pairs, signatures, bands * rows, threshold, miss), "likely")
    links = materialize(verify(likely, texts, threshold), "links")
    parts = connected_components(links, "a", "b")

    # Buckets whose nodes aren't in one component yet hold pairs that nobody has compared.
    placed, split = _placed(members, parts)
    more = settle(materialize(placed.join(_few(split), "key"), "open"), texts, signatures, bands * rows, threshold, miss, large)
    parts = connected_components(links.unionByName(materialize(more, "links")), "a", "b")
    named = groups.join(parts, F.col("rep") == F.col("node"), "left").select("fp", F.coalesce("component", "rep").alias("component"))
    out = feats.select("doc_id", "fp", "n").join(named, "fp", "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept"))


def keep_one_of_each(docs: DataFrame, threshold: tuple[int, int] = THRESHOLD, bands: int = BANDS, rows: int = ROWS, miss: float = MISS) -> DataFrame:
    """Documents without the near-duplicates of smaller doc_id, with the columns they had.

    Of rows with one doc_id the one of the smallest text stays; rows without a doc_id all stay.
    """
    names = docs.columns
    mark = "_" * (1 + max(map(len, names)))  # longer than any column's name
    gone = near_duplicates(docs, threshold, bands, rows, miss).where("not kept").select(F.col("doc_id").alias(mark)).distinct()
    left = docs.join(gone, docs["doc_id"] == F.col(mark), "left_anti").select(*[F.col(f"`{c}`") for c in names])
    # Only rows whose doc_id repeats, as a rule none, are grouped whole.
    again = docs.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias(mark)).agg(F.count("*").alias(mark + "n")).where(f"{mark}n > 1").select(mark)
    again = materialize(again, "repeated")
    row = F.struct(*[F.col(f"`{c}`") for c in names])
    first = F.struct(F.col("text").isNull().alias("a"), F.col("text").alias("b"), F.xxhash64(*[F.col(f"`{c}`") for c in names]).alias("c"))
    one = left.join(again, left["doc_id"] == F.col(mark), "left_semi").groupBy("doc_id").agg(F.min_by(row, first).alias(mark))
    return left.join(again, left["doc_id"] == F.col(mark), "left_anti").select(*[F.col(f"`{c}`") for c in names]).unionByName(one.select(f"{mark}.*"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))

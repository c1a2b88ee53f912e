"""Average-link clusters of whole result sets.

A result set is what a search returned for one query, so its size is bounded by that search and its clustering is one
small task; result sets are spread over tasks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemolake.operators.search import every_nth, query_blocks, vector_top
from mnemolake.plans.registry import query


def average_link(sim: np.ndarray, most: int, least: float) -> np.ndarray:
    """A cluster number for each row of a similarity matrix: the most similar clusters are joined (similarity is the mean over
    their pairs) until there are no more than most, or none are as similar as least.

    Chains of nearest neighbours find all joins in quadratic time: the mean of a joined cluster follows from those of its
    parts, and a join never makes two others more similar than their better part was, so the order can be put right after.
    """
    n = len(sim)
    s, size, alive = sim.astype(float).copy(), np.ones(n), np.ones(n, bool)
    np.fill_diagonal(s, -np.inf)
    joins, chain = [], []
    for _ in range(n - 1):
        if not chain:
            chain.append(int(np.flatnonzero(alive)[0]))
        while True:
            a = chain[-1]
            row = np.where(alive, s[a], -np.inf)
            b = int(row.argmax())
            if len(chain) > 1 and row[chain[-2]] >= row[b]:
                b = chain[-2]
                break
            chain.append(b)
        chain = chain[:-2]
        joins.append((-s[a, b], min(a, b), max(a, b)))
        merged = (size[a] * s[a] + size[b] * s[b]) / (size[a] + size[b])
        s[a], s[:, a] = merged, merged
        s[a, a] = -np.inf
        size[a] += size[b]
        alive[b] = False
    # A join's two ends are any members of the clusters it joins.
    parent = np.arange(n)

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = int(parent[x])
        return x

    for k, (height, a, b) in enumerate(sorted(joins, key=lambda j: j[0])):
        if n - k <= most or -height < least:
            break
        a, b = sorted((top(a), top(b)))
        parent[b] = a
    roots = [top(i) for i in range(n)]
    number = {r: i for i, r in enumerate(sorted(set(roots)))}
    return np.array([number[r] for r in roots], np.int64)


def similarities(tags: list[set], vectors: list[np.ndarray | None]) -> np.ndarray:
    """.6 of the overlap of tags and .4 of the cosine of vectors; without either its part is 0."""
    n = len(tags)
    vocabulary = {t: i for i, t in enumerate(sorted(set().union(*tags)))}
    has = np.zeros((n, max(1, len(vocabulary))))
    for i, own in enumerate(tags):
        has[i, [vocabulary[t] for t in own]] = 1
    both, count = has @ has.T, has.sum(1)
    either = count[:, None] + count[None, :] - both
    dims = [len(v) for v in vectors if v is not None]
    u = np.zeros((n, max(dims, default=1)))
    for i, v in enumerate(vectors):
        if v is not None and len(v) == u.shape[1]:
            u[i] = v / max(np.linalg.norm(v), 1e-300)
    return 0.6 * both / np.maximum(either, 1) + 0.4 * (u @ u.T)


def cluster_results(results: DataFrame, memory: DataFrame, vector: DataFrame, most: int = 5, least: float = 0.5) -> DataFrame:
    """qid, id, cluster of every result (qid, id): clusters are numbered from 0 by their smallest id. Results whose record is unknown are left out."""
    x = results.select("qid", "id").distinct().join(memory.select("id", F.coalesce("tags", F.array().cast("array<string>")).alias("tags")), "id").join(vector.select("id", "v"), "id", "left")

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        vectors = [None if v is None else np.asarray(v, float) for v in pdf["v"]]
        sim = similarities([set(t) for t in pdf["tags"]], vectors)
        return pd.DataFrame({"qid": pdf["qid"], "id": pdf["id"], "cluster": average_link(sim, most, least)})

    return x.groupBy("qid").applyInPandas(link, "qid string, id string, cluster long")


@query("e12_cluster_hierarchical", "memory vector", every=50)
def cluster_searches(memory: DataFrame, vector: DataFrame, every: int, k: int = 50, most: int = 5, least: float = 0.3, block: int = 512) -> DataFrame:
    """The k best results of every n-th record's search, clustered query by query. The searches pass in blocks of about `block`: a task
    holds k rows for each query of its block only."""
    found = None
    for q in query_blocks(every_nth(vector, every), block):
        one = vector_top(vector, q, k, 0.0)
        found = one if found is None else found.unionByName(one)
    return cluster_results(found, memory, vector, most, least)

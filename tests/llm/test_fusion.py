"""Language ID recomputed plainly: trigrams, votes, declared languages, suffix and host priors, posteriors."""

import math
import re

import pytest

from mnemolake.llm import language_id as lid
from mnemolake.llm.queries import QUERIES

NAMES = [*lid.LANGUAGES, "und"]


def trigrams(text):
    b = (text or "").encode()
    low = [x + 32 if 65 <= x <= 90 else x for x in b]
    letter = [97 <= x <= 122 or x >= 128 for x in low]
    return [(low[i] * 40503 + low[i + 1] * 2531 + low[i + 2] * 157) % 65536 for i in range(len(b) - 2) if any(letter[i : i + 3])]


def fused_by_hand(rows, model):
    """rows: (id, text, declared subtag or "other" or None, host)."""
    table, n = model.astype(float), len(NAMES)
    score = []
    for _, t, _, _ in rows:
        g = trigrams(t)
        score.append([sum(table[x, k] for x in g) / 3 for k in range(n - 1)] + [-len(g) * math.log(65536) / 3] if g else None)
    votes = [None if s is None else s.index(max(s)) for s in score]

    def suffix(h):
        return h.rsplit(".", 1)[-1].lower() if h and "." in h else None

    base, said, hosts, suffixes = [1.0] * n, {}, {}, {}
    for (_, _, d, h), v in zip(rows, votes, strict=True):
        if v is None:
            continue
        base[v] += 1
        for key, into, start in ((d, said, 1.0), (h, hosts, 0.0), (suffix(h), suffixes, 0.0)):
            if key is not None:
                into.setdefault(key, [start] * n)[v] += 1
    prior = [x / sum(base) for x in base]
    prior[-1] = min(prior[-1], lid.UNKNOWN_PRIOR)
    prior = [x / sum(prior) for x in prior]
    per = [sum(c[k] for c in said.values()) for k in range(n)]
    out = {}
    for (i, _, d, h), s, v in zip(rows, score, votes, strict=True):
        if s is None:
            out[i] = ("und", 0.0, False)
            continue
        own = [1.0 if k == v else 0.0 for k in range(n)]

        def share(counts, parent, own=own):
            others = [max(a - b, 0.0) for a, b in zip(counts or own, own, strict=True)]
            return [(a + lid.HOST_WEIGHT * p) / (sum(others) + lid.HOST_WEIGHT) for a, p in zip(others, parent, strict=True)]

        at = share(hosts.get(h), share(suffixes.get(suffix(h)), prior))
        log = [s[k] + (math.log(said[d][k] / per[k]) if d in said else 0.0) + math.log(at[k]) for k in range(n)]
        best = log.index(max(log))
        p = 1 / sum(math.exp(x - log[best]) for x in log)
        out[i] = (NAMES[best], p, NAMES[best] != "und" and p >= lid.LEAST_POSTERIOR)
    return out


def subtag(d):
    m = re.match(r"\s*([A-Za-z]+)", d) if d is not None else None
    return None if not m else m[1].lower() if m[1].lower() in lid.LANGUAGES else "other"


def same(got, wanted):
    assert set(got) == set(wanted)
    for i, (language, p, accepted) in wanted.items():
        assert (got[i][0], got[i][2]) == (language, accepted) and abs(got[i][1] - p) < 1e-5, (i, got[i], wanted[i])


@pytest.mark.parametrize("broadcast", [200_000, 0])
def test_documents(spark, sf, broadcast, monkeypatch):
    monkeypatch.setattr(lid, "BROADCAST_HOSTS", broadcast)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r["doc_id"], r["text"], subtag(r["lang"]), r["source"]) for r in docs.collect()]
    got = {r["doc_id"]: (r["language"], r["posterior"], r["accepted"]) for r in QUERIES["op9_language_id"](spark, sf).collect()}
    same(got, fused_by_hand(rows, lid.fit(docs)))


def test_pages(spark, sf):
    rows = []
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        said = re.search(r"(?i)<html[^>]*\blang\s*=\s*[\"']?([A-Za-z-]+)", r["html"] or "")
        host = re.match("[A-Za-z]+://([^/:?#]+)", r["url"] or "")
        bare = re.sub(r"(?is)<(script|style)[^>]*>.*?</\1>|<!--.*?-->", " ", r["html"] or "")
        rows.append((r["page_id"], re.sub("<[^>]*>", " ", bare), subtag(said[1] if said else ""), host[1].lower() if host else ""))
    got = {r["page_id"]: (r["language"], r["posterior"], r["accepted"]) for r in QUERIES["op9_language_id_pages"](spark, sf).collect()}
    same(got, fused_by_hand(rows, lid.fit(spark.read.parquet(f"{sf}/documents.parquet"))))


def test_long_texts_and_clashing_columns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = lid.fit(docs)
    long = next(r["text"] for r in docs.where("lang = 'fr' and n_chars > 500").collect())
    rows = [(1, long * (2 * lid.SLICE_BYTES // len(long)), "fr", "a.fr"), (2, long, "fr", "a.fr"), (2, long, "fr", "a.fr"), (3, None, None, None)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, declared string, host string, found int, vote int")
    got = lid.identify(df, model, declared=lid.F.col("declared"), host=lid.F.col("host"))
    assert got.columns == ["doc_id", "text", "declared", "host", "vote", "found"]
    assert sorted((r["doc_id"], r["found"]["language"]) for r in got.collect()) == [(1, "fr"), (2, "fr"), (2, "fr"), (3, "und")]
    kept = lid.drop_unidentified(df, model, declared=lid.F.col("declared"), host=lid.F.col("host"))
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 2]
    plan = kept._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("fuse(") == 1 and "aggregate(" not in plan

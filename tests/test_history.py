"""E16 and E12 by blocks of queries, against all pairs."""

import datetime
import math
import random

from mnemolake.operators import clusters, similarity
from mnemolake.plans import views


def test_best_older_of_all_pairs(spark):
    draw = random.Random(3)
    at = datetime.datetime(2024, 1, 1)
    rows = [(str(k), [draw.choice([-1.0, 0.0, 0.5, 1.0]) for _ in range(4)], at + datetime.timedelta(minutes=draw.randrange(60)), [draw.choice("xyz"), "t"]) for k in range(400)]
    rows += [("1000", [1.0, None, 1.0, 0.0], at + datetime.timedelta(days=1), ["x"]), ("1050", [1.0, 0.0], at + datetime.timedelta(days=1), None), ("1100", [1.0, 0.0, 0.0, 0.0], None, []), ("1150", None, at, []), ("1200", [0.0] * 4, at + datetime.timedelta(days=2), [])]
    vector = spark.createDataFrame([r[:2] for r in rows], "id string, v array<float>")
    memory = spark.createDataFrame([(r[0], r[2], r[3]) for r in rows], "id string, created_at timestamp_ntz, tags array<string>")

    def cos(x, y):
        x, y = ([z or 0.0 for z in v[: min(len(x), len(y))]] for v in (x, y))
        n = math.sqrt(sum(a * a for a in x)) * math.sqrt(sum(b * b for b in y))
        return round(sum(a * b for a, b in zip(x, y, strict=True)) / n, 9) if n else 0.0

    wanted = {}
    for i, v, t, tags in rows:
        if int(i) % 50 == 0 and v is not None and t is not None:
            s, j, own = max(((cos(v, w), j, g) for j, w, u, g in rows if w is not None and u is not None and u < t and i != j), key=lambda x: x[:2], default=(0, "", []))
            if s >= 0.3:
                wanted[i] = (j, round(s, 6), None if tags is None else len(set(tags) & set(own or [])))
    for block in (1024, 3):
        got = {r["id"]: (r["history"], r["similarity"], r["shared_tags"]) for r in similarity.best_history_link(memory, vector, 0.3, block).collect()}
        assert got.keys() == wanted.keys() and len(got) > 5
        assert all(got[i] == wanted[i] or (wanted[i][2] is None and got[i][:2] == wanted[i][:2]) for i in got)


def test_searches_to_cluster_pass_in_blocks(spark, sf):
    """Formerly all queries met every batch at once, and each task held k rows for all of them."""
    m, v = views.view(spark, sf, "memory"), views.view(spark, sf, "vector")
    one, many = ({tuple(r) for r in clusters.cluster_searches(m, v, 10, 20, block=b).collect()} for b in (10_000, 4))
    assert one == many and one

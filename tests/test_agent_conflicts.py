"""all pairs of records follow from its classes and their members."""

from collections import defaultdict

from mnemolake.operators import conflict
from mnemolake.plans import registry, views
from tests.harness import differences


def test_pairs_of_records_from_classes_and_members(spark, sf):
    m = views.view(spark, sf, "memory")
    rows = conflict.agent_conflicts(m, conflict.DATA_OPPOSITES).collect()
    members = defaultdict(set)
    for r in rows:
        if r["kind"] == "member":
            members[r["a"]].add(r["b"])
    got = {frozenset((x, y)) for r in rows if r["kind"] == "pair" for x in members[r["a"]] for y in members[r["b"]]}
    assert sum(r["pairs"] for r in rows if r["kind"] == "pair") == len(got)

    def sides(r):
        c = r["content"].lower()
        return [sum(any(w in c for w in pair[k]) << i for i, pair in enumerate(conflict.DATA_OPPOSITES)) for k in (0, 1)]

    records = [(r["id"], r["author"], *sides(r)) for r in m.where("content IS NOT NULL").collect()]
    wanted = {frozenset((i, j)) for i, x, p, q in records for j, y, t, u in records if i < j and x != y and ((p & u) | (q & t))}
    assert got == wanted and len(wanted) > len([r for r in rows if r["kind"] == "pair"]) > 0


def test_sql_has_the_members_too(spark, sf):
    assert not differences(registry.QUERIES["f2_agent_conflicts"](spark, sf), registry.ORACLES["f2_agent_conflicts"], sf)

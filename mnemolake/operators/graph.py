"""The knowledge graph: upserts, validity, neighbours, paths, inference, spreading activation, entity extraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemolake.functions.columns import any_of, count, moment, r6
from mnemolake.operators.analytics import tag_pairs
from mnemolake.plans.registry import query
from mnemolake.plans.storage import materialize


@query("g1_upsert_relations", "relation", """
WITH u AS (SELECT id, confidence, 1 AS v FROM relation UNION ALL SELECT id, confidence + 0.05, 2 FROM relation WHERE predicate = 'enables') SELECT id, round(arg_max(confidence, v), 6) AS confidence FROM u GROUP BY id
""")
def upsert_demo(relation: DataFrame) -> DataFrame:
    """upsert of a newer version of some relations."""
    old = relation.select("id", "confidence", F.lit(1).alias("version"))
    new = relation.where("predicate = 'enables'").select("id", (F.col("confidence") + 0.05).alias("confidence"), F.lit(2).alias("version"))
    return upsert(old, new, "id", "version").select("id", r6("confidence").alias("confidence"))


def upsert(old: DataFrame, new: DataFrame, key: str, version: str) -> DataFrame:
    """Latest row by key; the maximum is partly aggregated before the exchange."""
    rest = [c for c in old.columns if c not in (key, version)]
    return old.unionByName(new).groupBy(key).agg(F.max_by(F.struct(*rest, version), version).alias("r")).select(key, "r.*")


@query("g2_relations_as_of", "relation", """
SELECT predicate, count(*) AS n, round(avg(confidence), 6) AS mean_confidence FROM relation WHERE coalesce(valid_from, TIMESTAMP '1900-01-01') <= TIMESTAMP '1996-01-01' AND coalesce(valid_until, TIMESTAMP '2999-01-01') >= TIMESTAMP '1996-01-01' GROUP BY predicate
""", at="1996-01-01 00:00:00")
def relations_as_of(relation: DataFrame, at: str) -> DataFrame:
    """Relations valid at a moment, both ends inclusive, open where null: counts and mean confidence by predicate."""
    return valid(relation, at).groupBy("predicate").agg(count().alias("n"), r6(F.avg("confidence")).alias("mean_confidence"))


def valid(relation: DataFrame, at: str) -> DataFrame:
    t = moment(at)
    return relation.where((F.col("valid_from").isNull() | (F.col("valid_from") <= t)) & (F.col("valid_until").isNull() | (F.col("valid_until") >= t)))


def both_ways(relation: DataFrame) -> DataFrame:
    a = relation.select(F.col("subject_id").alias("src"), F.col("object_id").alias("dst"), "predicate", "confidence", F.lit("out").alias("direction"))
    return a.unionByName(relation.select(F.col("object_id").alias("src"), F.col("subject_id").alias("dst"), "predicate", "confidence", F.lit("in").alias("direction")))


@query("g3_neighbors", "relation", """
SELECT subject_id AS node, object_id AS neighbor, predicate, 'out' AS direction FROM relation WHERE subject_id IN ('n3', 's5') UNION ALL SELECT object_id, subject_id, predicate, 'in' FROM relation WHERE object_id IN ('n3', 's5')
""", ids=["n3", "s5"])
def neighbors(relation: DataFrame, ids: list[str]) -> DataFrame:
    """Edges of some nodes, with their direction. Each side is filtered in its own scan."""
    out = relation.where(F.col("subject_id").isin(ids)).select(F.col("subject_id").alias("node"), F.col("object_id").alias("neighbor"), "predicate", F.lit("out").alias("direction"))
    return out.unionByName(relation.where(F.col("object_id").isin(ids)).select(F.col("object_id").alias("node"), F.col("subject_id").alias("neighbor"), "predicate", F.lit("in").alias("direction")))


def frontier(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(start, node, level, path) first reached from each seed; the path with the smallest nodes wins. Each level is written before the next."""
    now = seeds.select("start", F.col("start").alias("node"), F.lit(0).cast("long").alias("level"), F.col("start").alias("path"))
    seen = now
    for level in range(1, depth + 1):
        step = edges.join(now.select("start", F.col("node").alias("src"), "path"), "src").groupBy("start", F.col("dst").alias("node")).agg(F.min(F.concat_ws(">", "path", "dst")).alias("path"))
        now = materialize(step.join(seen.select("start", "node"), ["start", "node"], "left_anti").select("start", "node", F.lit(level).cast("long").alias("level"), "path"), "frontier")
        if now.isEmpty():
            break
        seen = seen.unionByName(now)
    return seen


_REACH = """WITH RECURSIVE e AS (SELECT DISTINCT {src} AS src, {dst} AS dst FROM relation {where}),
l0 AS (SELECT s AS start, s AS node, 0 AS level, s AS path FROM (VALUES {seeds}) AS v(s)),
l1 AS (SELECT start, dst AS node, 1 AS level, min(path || '>' || dst) AS path FROM l0 JOIN e ON src = node WHERE dst <> start GROUP BY 1, 2),
l2 AS (SELECT start, dst AS node, 2 AS level, min(path || '>' || dst) AS path FROM l1 JOIN e ON src = node GROUP BY 1, 2),
l2n AS (SELECT * FROM l2 WHERE NOT EXISTS (SELECT 1 FROM l1 WHERE l1.start = l2.start AND l1.node = l2.node) AND node <> start),
l3 AS (SELECT start, dst AS node, 3 AS level, min(path || '>' || dst) AS path FROM l2n JOIN e ON src = node GROUP BY 1, 2),
l3n AS (SELECT * FROM l3 WHERE NOT EXISTS (SELECT 1 FROM l1 WHERE l1.start = l3.start AND l1.node = l3.node) AND NOT EXISTS (SELECT 1 FROM l2n WHERE l2n.start = l3.start AND l2n.node = l3.node) AND node <> start),
reach AS (SELECT * FROM l0 UNION ALL SELECT * FROM l1 UNION ALL SELECT * FROM l2n UNION ALL SELECT * FROM l3n)
"""


def _reach(seeds: str, src="subject_id", dst="object_id", where="") -> str:
    return _REACH.format(src=src, dst=dst, where=where, seeds=seeds)


@query("g4_shortest_path", "relation", _reach("('s1'), ('s7')") + "SELECT start, node, level::BIGINT AS steps, path FROM reach WHERE node IN ('r0', 'r1', 'r2', 'r3', 'r4')", starts=["s1", "s7"], ends=["r0", "r1", "r2", "r3", "r4"])
def shortest_path(relation: DataFrame, starts: list[str], ends: list[str], most: int = 3) -> DataFrame:
    """Shortest outgoing paths of at most so many steps from some nodes to others."""
    edges = relation.select(F.col("subject_id").alias("src"), F.col("object_id").alias("dst")).distinct()
    seeds = relation.sparkSession.createDataFrame([(s,) for s in starts], "start string")
    return frontier(edges, seeds, most).where(F.col("node").isin(ends)).select("start", "node", F.col("level").alias("steps"), "path")


@query("g5_bfs", "relation", """
WITH e AS (SELECT subject_id AS src, object_id AS dst FROM relation WHERE confidence >= 0.3 AND predicate <> 'causes' UNION SELECT object_id, subject_id FROM relation WHERE confidence >= 0.3 AND predicate <> 'causes'),
l1 AS (SELECT DISTINCT dst AS node FROM e WHERE src = 'n3'), l2 AS (SELECT DISTINCT dst AS node FROM l1 JOIN e ON src = node WHERE dst <> 'n3' AND dst NOT IN (SELECT node FROM l1)) SELECT 'n3' AS node, 0::BIGINT AS level UNION ALL SELECT node, 1 FROM l1 UNION ALL SELECT node, 2 FROM l2
""", start="n3", without="causes")
def bfs(relation: DataFrame, start: str, without: str, depth: int = 2, least: float = 0.3) -> DataFrame:
    """Nodes by distance along edges of either direction, with filters."""
    e = both_ways(relation.where((F.col("confidence") >= least) & (F.col("predicate") != without))).select("src", "dst").distinct()
    return frontier(e, relation.sparkSession.createDataFrame([(start,)], "start string"), depth).select("node", "level")


@query("g6_cause_chain", "relation", """
WITH p AS (SELECT object_id AS node, arg_max(subject_id, (confidence, subject_id)) AS cause, max(confidence) AS c FROM relation WHERE predicate IN ('causes', 'enables', 'depends_on', 'related_to') GROUP BY 1)
SELECT a.node, concat_ws('<', a.node, a.cause, b.cause, d.cause) AS chain, round(a.c * coalesce(b.c, 1) * coalesce(d.c, 1), 6) AS strength FROM p a LEFT JOIN p b ON a.cause = b.node LEFT JOIN p d ON b.cause = d.node
""", steps=3)
def cause_chain(relation: DataFrame, steps: int = 5) -> DataFrame:
    """Back from every node along its strongest incoming edge, for all nodes at once."""
    p = relation.where(F.col("predicate").isin("causes", "enables", "depends_on", "related_to")).groupBy(F.col("object_id").alias("node")).agg(F.max_by("subject_id", F.struct("confidence", "subject_id")).alias("k1"), F.max("confidence").alias("c1"))
    p = materialize(p, "strongest")
    x = p
    for k in range(2, steps + 1):
        x = x.join(p.select(F.col("node").alias(f"k{k - 1}"), F.col("k1").alias(f"k{k}"), F.col("c1").alias(f"c{k}")), f"k{k - 1}", "left")
    strength = F.lit(1.0)
    for k in range(1, steps + 1):
        strength = strength * F.coalesce(f"c{k}", F.lit(1.0))
    return x.select("node", F.concat_ws("<", "node", *[f"k{k}" for k in range(1, steps + 1)]).alias("chain"), r6(strength).alias("strength"))


@query("g7_perspective", "relation", "SELECT id, predicate, confidence FROM relation WHERE predicate IN ('causes', 'enables') ORDER BY confidence DESC, id LIMIT 50", predicates=["causes", "enables"])
def perspective(relation: DataFrame, predicates: list[str], most: int = 50) -> DataFrame:
    """The strongest edges of a view's predicates."""
    return relation.where(F.col("predicate").isin(predicates)).orderBy(F.desc("confidence"), "id").limit(most).select("id", "predicate", "confidence")


@query("g8_graph_stats", "entity relation", """
SELECT 'entity' AS kind, type AS name, count(*) AS n, NULL::DOUBLE AS share FROM entity GROUP BY type UNION ALL SELECT 'predicate', predicate, count(*), round(count(*)::DOUBLE / (SELECT count(*) FROM relation), 6) FROM relation GROUP BY predicate
UNION ALL SELECT 'depends_on', CASE WHEN confidence >= 0.7 THEN 'high' WHEN confidence >= 0.4 THEN 'medium' ELSE 'low' END, count(*), NULL FROM relation WHERE predicate = 'depends_on' GROUP BY 2
""")
def graph_stats(entity: DataFrame, relation: DataFrame) -> DataFrame:
    """Entities by type, relations by predicate with their share, and the quality bands of dependencies."""
    none = F.lit(None).cast("double")
    a = entity.groupBy(F.col("type").alias("name")).agg(count().alias("n")).select(F.lit("entity").alias("kind"), "name", "n", none.alias("share"))
    per = relation.groupBy(F.col("predicate").alias("name")).agg(count().alias("n"))
    b = per.crossJoin(F.broadcast(per.agg(F.sum("n").alias("t")))).select(F.lit("predicate").alias("kind"), "name", "n", r6(F.col("n") / F.col("t")).alias("share"))
    band = F.when(F.col("confidence") >= 0.7, "high").when(F.col("confidence") >= 0.4, "medium").otherwise("low")
    c = relation.where("predicate = 'depends_on'").groupBy(band.alias("name")).agg(count().alias("n")).select(F.lit("depends_on").alias("kind"), "name", "n", none.alias("share"))
    return a.unionByName(b).unionByName(c)


EDGE_RULES = [("causes", ["because", "导致", "thened"]), ("temporal", ["after", "之后", "eronth"]), ("depends_on", ["depends", "依赖", "inthe"]), ("enables", ["enable", "支持", "ndthe"]), ("refines", ["refine", "优化"]), ("contradicts", ["but ", "但是"])]


@query("g9_edge_type", "memory", """
SELECT CASE WHEN contains(c, 'because') OR contains(c, '导致') OR contains(c, 'thened') THEN 'causes' WHEN contains(c, 'after') OR contains(c, '之后') OR contains(c, 'eronth') THEN 'temporal' WHEN contains(c, 'depends') OR contains(c, '依赖') OR contains(c, 'inthe') THEN 'depends_on'
WHEN contains(c, 'enable') OR contains(c, '支持') OR contains(c, 'ndthe') THEN 'enables' WHEN contains(c, 'refine') OR contains(c, '优化') THEN 'refines' WHEN contains(c, 'but ') OR contains(c, '但是') THEN 'contradicts' ELSE 'related_to' END AS type, count(*) AS n FROM (SELECT lower(content) AS c FROM memory) GROUP BY 1
""")
def edge_types(memory: DataFrame, rules=EDGE_RULES) -> DataFrame:
    """What type of edge each text's words suggest, counted."""
    out = F.lit("related_to")
    for name, ws in reversed(rules):
        out = F.when(any_of(F.lower("content"), ws), name).otherwise(out)
    return memory.groupBy(out.alias("type")).agg(count().alias("n"))


@query("g10_score_depends_on", "entity relation", """
SELECT r.id, round(least(0.4, 0.2 * (contains(lower(a.name), 'a')::INT + contains(lower(b.name), 'e')::INT)) + 0.5 * r.confidence, 6) AS score, CASE WHEN least(0.4, 0.2 * (contains(lower(a.name), 'a')::INT + contains(lower(b.name), 'e')::INT)) + 0.5 * r.confidence < 0.5 THEN 'related_to' ELSE 'depends_on' END AS predicate
FROM relation r JOIN entity a ON a.id = subject_id JOIN entity b ON b.id = object_id WHERE predicate = 'depends_on'
""")
def score_depends_on(entity: DataFrame, relation: DataFrame, marks: tuple[str, str] = ("a", "e")) -> DataFrame:
    """Dependencies scored by marks in both names and their confidence; weak ones become related_to."""
    names = entity.select("id", F.lower("name").alias("name"))
    r = relation.where("predicate = 'depends_on'").select("id", "subject_id", "object_id", "confidence")
    r = r.join(names.select(F.col("id").alias("subject_id"), F.col("name").alias("a")), "subject_id").join(names.select(F.col("id").alias("object_id"), F.col("name").alias("b")), "object_id")
    s = F.least(F.lit(0.4), 0.2 * (F.contains("a", F.lit(marks[0])).cast("int") + F.contains("b", F.lit(marks[1])).cast("int"))) + 0.5 * F.col("confidence")
    return r.select("id", r6(s).alias("score"), F.when(s < 0.5, "related_to").otherwise("depends_on").alias("predicate"))


DICTIONARY = [("License", "law"), ("Apache", "org"), ("MIT", "org"), ("GNU", "org"), ("thened", "word")]


@query("g11_extract_dictionary_entities", "memory", """
WITH d(name, type) AS (VALUES ('License', 'law'), ('Apache', 'org'), ('MIT', 'org'), ('GNU', 'org'), ('thened', 'word')), h AS (SELECT id, name, type FROM memory, d WHERE contains(lower(content), lower(name)))
SELECT 'entity' AS kind, name AS a, type AS b, count(*) AS n FROM h GROUP BY name, type UNION ALL SELECT 'pair', x.name, y.name, count(*) FROM h x JOIN h y ON x.id = y.id AND x.name < y.name GROUP BY 2, 3
""")
def extract_dictionary_entities(memory: DataFrame, dictionary=DICTIONARY) -> DataFrame:
    """Dictionary names in texts, counted, and pairs of them in one text. The pairs come from each text's own short list."""
    names = F.array(*[F.struct(F.lit(a).alias("name"), F.lit(b).alias("type")) for a, b in dictionary])
    h = memory.select(F.array_sort(F.filter(names, lambda x: F.contains(F.lower("content"), F.lower(x["name"])))).alias("h")).where(F.size("h") > 0)
    e = h.select(F.explode("h").alias("x")).groupBy(F.col("x.name").alias("a"), F.col("x.type").alias("b")).agg(count().alias("n")).select(F.lit("entity").alias("kind"), "a", "b", "n")
    p = h.select("h", F.posexplode("h").alias("i", "x")).select(F.col("x.name").alias("a"), F.explode(F.slice("h", F.col("i") + 2, F.size("h"))).alias("y")).groupBy("a", F.col("y.name").alias("b")).agg(count().alias("n"))
    return e.unionByName(p.select(F.lit("pair").alias("kind"), "a", "b", "n"))


PATTERNS = [("email", "[A-Za-z0-9._-]+@[A-Za-z0-9.-]+"), ("version", "[0-9]+\\.[0-9]+(?:\\.[0-9]+)?"), ("quoted", "\"[^\"]{2,40}\"")]


@query("g12_extract_regex_entities", "memory", """
SELECT type, name, count(*) AS n FROM (SELECT DISTINCT id, 'email' AS type, unnest(regexp_extract_all(content, '[A-Za-z0-9._-]+@[A-Za-z0-9.-]+')) AS name FROM memory UNION SELECT id, 'version', unnest(regexp_extract_all(content, '[0-9]+\\.[0-9]+(?:\\.[0-9]+)?')) FROM memory UNION SELECT id, 'quoted', unnest(regexp_extract_all(content, '"[^"]{2,40}"')) FROM memory) GROUP BY 1, 2
""")
def extract_regex_entities(memory: DataFrame, patterns=PATTERNS) -> DataFrame:
    """Typed names by pattern and how many texts have them."""
    found = F.array_distinct(F.flatten(F.array(*[F.transform(F.regexp_extract_all("content", F.lit(p), F.lit(0)), _typed(t)) for t, p in patterns])))
    return memory.select(F.explode(found).alias("x")).groupBy("x.type", "x.name").agg(count().alias("n"))


def _typed(kind: str):
    return lambda x: F.struct(F.lit(kind).alias("type"), x.alias("name"))


@query("g13_common_predicate_pairs", "relation", """
WITH d AS (SELECT DISTINCT subject_id, predicate, object_id FROM relation) SELECT object_id AS target, predicate, count(*) AS subjects, (count(*) * (count(*) - 1) // 2)::BIGINT AS pairs FROM d GROUP BY 1, 2
""")
def common_predicate_pairs(relation: DataFrame, predicates: list[str] | None = None) -> DataFrame:
    """How many entities share a predicate (any, or one of those given) and target, and how many pairs they make; pairs are counted, not listed."""
    asked = relation if predicates is None else relation.where(F.col("predicate").isin(predicates))
    d = asked.select("subject_id", "predicate", "object_id").distinct()
    k = F.count("*")
    return d.groupBy(F.col("object_id").alias("target"), "predicate").agg(k.cast("long").alias("subjects"), (k * (k - 1) / 2).cast("long").alias("pairs"))


@query("g14_infer_transitive", "relation", """
WITH t(p, q, r) AS (VALUES ('related_to', 'depends_on', 'located_in'), ('enables', 'depends_on', 'serves')) SELECT a.subject_id AS subject, r AS predicate, b.object_id AS object, round(max(a.confidence * b.confidence), 6) AS confidence FROM relation a JOIN t ON a.predicate = p JOIN relation b ON b.subject_id = a.object_id AND b.predicate = q GROUP BY 1, 2, 3
""", rules=[("related_to", "depends_on", "located_in"), ("enables", "depends_on", "serves")])
def infer_transitive(relation: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Two-step edges that the rules allow, confidences multiplied."""
    named = F.lit(None).cast("string")
    for p, q, r in rules:
        named = F.when((F.col("p") == p) & (F.col("q") == q), r).otherwise(named)
    a = relation.where(F.col("predicate").isin([r[0] for r in rules])).select("subject_id", F.col("object_id").alias("mid"), F.col("predicate").alias("p"), F.col("confidence").alias("c1"))
    b = relation.where(F.col("predicate").isin([r[1] for r in rules])).select(F.col("subject_id").alias("mid"), "object_id", F.col("predicate").alias("q"), F.col("confidence").alias("c2"))
    j = a.join(b, "mid").withColumn("predicate", named).where("predicate IS NOT NULL")
    return j.groupBy(F.col("subject_id").alias("subject"), "predicate", F.col("object_id").alias("object")).agg(r6(F.max(F.col("c1") * F.col("c2"))).alias("confidence"))


@query("g15_time_entities", "entity relation", """
WITH t AS (SELECT id, name FROM entity WHERE regexp_matches(name, '[0-9]{2}$')) SELECT predicate, count(*) AS n FROM relation WHERE subject_id IN (SELECT id FROM t) AND object_id IN (SELECT id FROM t) GROUP BY predicate
""", pattern="[0-9]{2}$")
def time_entities(entity: DataFrame, relation: DataFrame, pattern: str = "\\d{4}-\\d{2}") -> DataFrame:
    """Relations among entities whose names match a (date) pattern, by predicate."""
    t = entity.where(F.col("name").rlike(pattern)).select("id")
    r = relation.join(t.select(F.col("id").alias("subject_id")), "subject_id", "left_semi").join(t.select(F.col("id").alias("object_id")), "object_id", "left_semi")
    return r.groupBy("predicate").agg(count().alias("n"))


@query("g16_spread_activation", "relation", """
WITH e AS (SELECT subject_id AS src, object_id AS dst, max(confidence) AS c FROM relation GROUP BY 1, 2), l0 AS (SELECT 's1' AS node, 1.0::DOUBLE AS a), l1 AS (SELECT dst AS node, max(a * c * 0.6) AS a FROM l0 JOIN e ON src = node GROUP BY 1), l2 AS (SELECT dst AS node, max(a * c * 0.6) AS a FROM l1 JOIN e ON src = node GROUP BY 1), l3 AS (SELECT dst AS node, max(a * c * 0.6) AS a FROM l2 JOIN e ON src = node GROUP BY 1)
SELECT node, round(max(a), 6) AS activation FROM (SELECT * FROM l0 UNION ALL SELECT * FROM l1 UNION ALL SELECT * FROM l2 UNION ALL SELECT * FROM l3) GROUP BY node HAVING max(a) > 0
""", seeds=["s1"])
def spread_activation(relation: DataFrame, seeds: list[str], factor: float = 0.6, depth: int = 3) -> DataFrame:
    """The highest product of edge weights and decay over paths of bounded length; each level keeps a maximum per node."""
    e = materialize(relation.groupBy(F.col("subject_id").alias("src"), F.col("object_id").alias("dst")).agg(F.max("confidence").alias("c")), "weights")
    now = relation.sparkSession.createDataFrame([(s, 1.0) for s in seeds], "node string, a double")
    all_ = now
    for _ in range(depth):
        now = materialize(e.join(now, F.col("src") == F.col("node")).groupBy(F.col("dst").alias("node")).agg(F.max(F.col("a") * F.col("c") * factor).alias("a")), "activation")
        all_ = all_.unionByName(now)
    return all_.groupBy("node").agg(F.max("a").alias("a")).where("a > 0").select("node", r6("a").alias("activation"))


@query("g17_mutual_inhibition", "memory", """
WITH t AS (SELECT id, tags, importance FROM memory ORDER BY importance DESC, id LIMIT 40), s AS (SELECT a.id AS a, b.id AS b, len(list_intersect(a.tags, b.tags)) / 3.0 AS s FROM t a JOIN t b ON a.id <> b.id), a0 AS (SELECT id, importance AS v FROM t),
b1 AS (SELECT id, greatest(0.01, v - 0.03 * coalesce((SELECT sum(s * x.v) FROM s JOIN a0 x ON x.id = s.b WHERE s.a = a0.id), 0)) AS v FROM a0), a1 AS (SELECT id, v / (SELECT avg(v) FROM b1) AS v FROM b1),
b2 AS (SELECT id, greatest(0.01, v - 0.03 * coalesce((SELECT sum(s * x.v) FROM s JOIN a1 x ON x.id = s.b WHERE s.a = a1.id), 0)) AS v FROM a1), a2 AS (SELECT id, v / (SELECT avg(v) FROM b2) AS v FROM b2) SELECT id, round(v, 4) AS activation FROM a2
""", most=40, rounds=2, strength=0.03)
def mutual_inhibition(memory: DataFrame, most: int = 50, rounds: int = 3, strength: float = 0.3) -> DataFrame:
    """Rounds in which similar records of a bounded set damp one another, rescaled to a mean of 1."""
    t = materialize(memory.orderBy(F.desc("importance"), "id").limit(most).select("id", "tags", "importance"), "active")
    a, b = (t.select(F.col("id").alias(k), F.col("tags").alias(f"t{k}")) for k in "ab")
    s = materialize(a.join(b, F.col("a") != F.col("b")).select("a", "b", (F.size(F.array_intersect("ta", "tb")) / 3.0).alias("s")), "likeness")  # `most` squared rows
    v = t.select("id", F.col("importance").alias("v"))
    for _ in range(rounds):
        push = s.join(v.select(F.col("id").alias("b"), F.col("v").alias("w")), "b").groupBy(F.col("a").alias("id")).agg(F.sum(F.col("s") * F.col("w")).alias("p"))
        x = v.join(push, "id", "left").select("id", F.greatest(F.lit(0.01), F.col("v") - strength * F.coalesce("p", F.lit(0.0))).alias("v"))
        v = materialize(x.crossJoin(F.broadcast(x.agg(F.avg("v").alias("m")))).select("id", (F.col("v") / F.col("m")).alias("v")), "damped")
    return v.select("id", r6("v", 4).alias("activation"))


@query("g18_lineage", "relation", _reach("('r1')", "object_id", "subject_id", "WHERE predicate <> 'causes'") + "SELECT node, level::BIGINT AS level FROM reach WHERE level > 0", root="r1", without="causes")
def lineage(relation: DataFrame, root: str, without: str, depth: int = 3) -> DataFrame:
    """What refers to a node, level by level."""
    e = relation.where(F.col("predicate") != without).select(F.col("object_id").alias("src"), F.col("subject_id").alias("dst")).distinct()
    return frontier(e, relation.sparkSession.createDataFrame([(root,)], "start string"), depth).where("level > 0").select("node", "level")


@query("g19_page_graph", "pages", """
WITH h AS (SELECT page_id, lower(regexp_extract(url, '^[A-Za-z]+://([^/:?#]+)', 1)) AS host, regexp_extract_all(html, '<a href="/([^"]+)"', 1) AS links FROM pages), l AS (SELECT DISTINCT host, unnest(links) AS target FROM h)
SELECT host, (SELECT count(*) FROM h x WHERE x.host = h.host) AS pages, count(*) AS targets FROM l h GROUP BY host
""")
def page_graph(pages: DataFrame) -> DataFrame:
    """Per host: pages and distinct link targets."""
    h = pages.select(F.lower(F.regexp_extract("url", "^[A-Za-z]+://([^/:?#]+)", 1)).alias("host"), F.regexp_extract_all("html", F.lit('<a href="/([^"]+)"'), F.lit(1)).alias("links"))
    size = h.groupBy("host").agg(count().alias("pages"))
    return h.select("host", F.explode("links").alias("t")).distinct().groupBy("host").agg(count().alias("targets")).join(size, "host").select("host", "pages", "targets")


@query("g20_tag_graph", "memory", """
WITH p AS (SELECT DISTINCT x.tag AS a, y.tag AS b FROM (SELECT id, unnest(tags) AS tag FROM memory) x JOIN (SELECT id, unnest(tags) AS tag FROM memory) y ON x.id = y.id AND x.tag <> y.tag) SELECT a AS tag, count(*) AS degree FROM p GROUP BY a
""")
def tag_graph(memory: DataFrame) -> DataFrame:
    """Degree of each tag in the graph of tags that occur together."""
    p = tag_pairs(memory).select("a", "b")
    return p.select(F.col("a").alias("tag")).unionByName(p.select(F.col("b").alias("tag"))).groupBy("tag").agg(count().alias("degree"))

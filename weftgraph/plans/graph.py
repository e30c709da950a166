"""Queries of the graph operators over `nodes` and `edges`."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import norm_path
from ..operators import graph as G
from ..sources.tables import table
from .registry import Registry

R = Registry()

#: Parameters of the example searches.
QUESTION = "seal ledger cache"
SOURCE_TERM, TARGET_TERM = "seal ledger", "merge window"

N = """n AS (SELECT id, label, file_type, replace(source_file, chr(92), '/') source_file, source_line, docstring, community, degree_centrality
    FROM nodes WHERE deleted_at IS NULL AND id IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC, label DESC, file_type DESC, replace(source_file, chr(92), '/') DESC,
      source_line DESC NULLS LAST, docstring DESC NULLS LAST, community DESC NULLS LAST) = 1)"""
E = """e AS (SELECT DISTINCT id, trim(source) source, trim(target) target, relation, confidence, confidence_score, source_file
    FROM edges WHERE source IS NOT NULL AND target IS NOT NULL)"""
C = "c AS (SELECT e.* FROM e WHERE source IN (SELECT id FROM n) AND target IN (SELECT id FROM n))"
U = "u AS (SELECT source src, target dst, id FROM c UNION ALL SELECT target, source, id FROM c WHERE source <> target)"
D = "d AS (SELECT n.id, n.label, count(u.id) degree FROM n LEFT JOIN u ON u.src = n.id GROUP BY ALL)"
BASE = f"WITH {N}, {E}, {C}, {U}"


def nodes(spark, d):
    return G.live_nodes(table(spark, d, "nodes"))


def edges(spark, d):
    return G.clean_edges(table(spark, d, "edges"))


def graph(spark, d):
    n = nodes(spark, d)
    return n, G.connected_edges(edges(spark, d), n)


@R.query("god_nodes", f"{BASE}, {D} SELECT id, label, degree, degree / (SELECT max(degree) FROM d) AS degree_centrality FROM d ORDER BY degree DESC, id LIMIT 10")
def god_nodes(spark, d):
    n, e = graph(spark, d)
    return G.hubs(e, n)


@R.query("node_degree_all", f"{BASE}, {D} SELECT id, label, degree, degree / (SELECT max(degree) FROM d) AS degree_centrality FROM d")
def node_degree_all(spark, d):
    n, e = graph(spark, d)
    return G.centrality(G.degrees(e, n))


@R.query("multigraph_degree", f"{BASE} SELECT src AS id, count(*) AS neighbours FROM u GROUP BY 1")
def multigraph_degree(spark, d):
    _, e = graph(spark, d)
    return G.undirected(e).groupBy(F.col("src").alias("id")).agg(F.count("*").alias("neighbours"))


@R.query("undirected_edges", f"{BASE} SELECT src, dst, id AS edge_id FROM u")
def undirected_edges(spark, d):
    return G.undirected(graph(spark, d)[1])


@R.query(
    "surprising_edges",
    f"""{BASE} SELECT c.id, c.source, c.target, relation, a.label AS source_label, b.label AS target_label, a.community AS source_community,
  b.community AS target_community FROM c JOIN n a ON a.id = c.source JOIN n b ON b.id = c.target WHERE a.community <> b.community""",
)
def surprising_edges(spark, d):
    n, e = graph(spark, d)
    return G.cross_community(e, n)


@R.query(
    "suggested_questions",
    f"""{BASE}, {D}, h AS (SELECT *, row_number() OVER (ORDER BY degree DESC, id) rk FROM d)
SELECT rk AS rank, 'What role does ' || label || ' play, with its ' || degree || ' connections?' AS question FROM h WHERE rk <= 5
UNION ALL SELECT 6, 'How do the ' || k || ' communities relate to each other?' FROM (SELECT count(DISTINCT community) k FROM n) WHERE k > 1""",
)
def suggested_questions(spark, d):
    n, e = graph(spark, d)
    return G.questions(G.hubs(e, n), n)


@R.query(
    "graph_stats",
    f"""WITH {N}, {E} SELECT (SELECT count(*) FROM n) AS node_count, (SELECT count(*) FROM e) AS edge_count, (SELECT count(DISTINCT community) FROM n) AS community_count,
  (SELECT count(DISTINCT replace(file_path, chr(92), '/')) FROM file_manifest) AS file_count""",
)
def graph_stats(spark, d):
    return G.stats(nodes(spark, d), edges(spark, d), table(spark, d, "file_manifest", "file_path"))


@R.query("community_sizes", f"WITH {N} SELECT community, count(*) AS members FROM n WHERE community IS NOT NULL GROUP BY 1")
def community_sizes(spark, d):
    return nodes(spark, d).where("community is not null").groupBy("community").agg(F.count("*").alias("members"))


@R.query("relation_confidence_counts", f"WITH {E} SELECT relation, confidence, count(*) AS n, round(avg(confidence_score), 6) AS mean_score FROM e GROUP BY ALL")
def relation_confidence_counts(spark, d):
    return edges(spark, d).groupBy("relation", "confidence").agg(F.count("*").alias("n"), F.round(F.avg("confidence_score"), 6).alias("mean_score"))


def _score(question):
    return " + ".join(
        f"(CASE WHEN contains(lower(label), '{t}') THEN 1.0::DOUBLE ELSE 0 END) + (CASE WHEN contains(lower(source_file), '{t}') THEN 0.5::DOUBLE ELSE 0 END)"
        for t in G.terms(question)
    )


def S(question, k, name="s"):
    return f"{name} AS (SELECT id, label, {_score(question)} AS score FROM n WHERE {_score(question)} > 0 ORDER BY score DESC, id LIMIT {k})"


@R.query("score_nodes", f"WITH {N} SELECT id, label, {_score(QUESTION)} AS score FROM n WHERE {_score(QUESTION)} > 0")
def score_nodes(spark, d):
    return G.score(nodes(spark, d), QUESTION)


@R.query("seed_top5", f"WITH {N}, {S(QUESTION, 5)} SELECT id, label, score FROM s")
def seed_top5(spark, d):
    return G.seeds(nodes(spark, d), QUESTION)


@R.query(
    "explain_top20",
    f"""{BASE}, {S(QUESTION, 1)}, o AS (SELECT c.id, relation, confidence, CASE WHEN source = s.id THEN target ELSE source END other
    FROM c, s WHERE source = s.id OR target = s.id),
  f AS (SELECT other, relation, confidence, count(*) OVER (PARTITION BY other) k FROM o QUALIFY row_number() OVER (PARTITION BY other ORDER BY id) = 1)
SELECT n.id, n.label, relation, confidence, copy FROM (SELECT *, unnest(range(1, k + 1)) copy FROM f) f JOIN n ON n.id = other
ORDER BY confidence DESC, n.id, copy LIMIT 20""",
)
def explain_top20(spark, d):
    n, e = graph(spark, d)
    best = G.seeds(n, QUESTION, 1).first()
    return G.neighbours(e, n, best["id"] if best else "")


def _levels(depth, seeds="SELECT id FROM s"):
    ctes = [f"b0 AS MATERIALIZED (SELECT id, 0 AS depth, NULL::VARCHAR AS parent FROM ({seeds}))"]
    for i in range(1, depth + 1):
        seen = " UNION ALL ".join(f"SELECT id FROM b{j}" for j in range(i))
        ctes.append(
            f"b{i} AS MATERIALIZED (SELECT dst AS id, {i} AS depth, min(src) AS parent FROM u WHERE src <> dst AND src IN (SELECT id FROM b{i - 1}) "
            f"AND dst NOT IN ({seen}) GROUP BY dst)"
        )
    return ", ".join(ctes), " UNION ALL ".join(f"SELECT * FROM b{j}" for j in range(depth + 1))


def _bfs(depth):
    ctes, union = _levels(depth)

    @R.query(f"bfs_depth{depth}", f"{BASE}, {S(QUESTION, 5)}, {ctes} SELECT id, depth FROM ({union})")
    def run(spark, d):
        n, e = graph(spark, d)
        return G.bfs(e, G.seeds(n, QUESTION), depth).visited.select("id", "depth")


for _depth in (1, 2, 3):
    _bfs(_depth)
_CTES2, _UNION2 = _levels(2)


@R.query("bfs_tree_edges", f"{BASE}, {S(QUESTION, 5)}, {_CTES2} SELECT parent, id, depth FROM ({_UNION2}) WHERE depth > 0")
def bfs_tree_edges(spark, d):
    n, e = graph(spark, d)
    return G.bfs(e, G.seeds(n, QUESTION), 2).visited.where("depth > 0").select("parent", "id", "depth")


@R.query(
    "query_text_budget",
    f"""{BASE}, {S(QUESTION, 5)}, {_CTES2}, ball AS ({_UNION2}),
  dg AS (SELECT src id, count(*) degree FROM u GROUP BY 1),
  f AS (SELECT least(source, target) x, greatest(source, target) y, arg_min(relation, id) relation, arg_min(confidence, id) confidence FROM c GROUP BY 1, 2),
  lines AS (SELECT 0 part, -coalesce(degree, 0) o, ball.id k, 'NODE ' || label || ' [' || coalesce(source_file, '?') || '] community=' || coalesce(community::VARCHAR, '?')
      || ' degree=' || coalesce(degree, 0) || CASE WHEN docstring <> '' THEN chr(10) || '  summary: ' || substring(docstring, 1, 200) ELSE '' END line FROM ball JOIN n USING (id) LEFT JOIN dg USING (id)
    UNION ALL SELECT 1, depth, ball.id, 'EDGE ' || p.label || ' --' || relation || '-> ' || n.label || ' (' || confidence || ')'
    FROM ball JOIN n USING (id) JOIN n p ON p.id = ball.parent JOIN f ON f.x = least(ball.id, ball.parent) AND f.y = greatest(ball.id, ball.parent)),
  run AS (SELECT row_number() OVER (ORDER BY part, o, k) pos, line, sum(strlen(line) + 1) OVER (ORDER BY part, o, k) used FROM lines)
SELECT pos, line FROM run WHERE used <= 6000 UNION ALL SELECT min(pos), '... (truncated)' FROM run WHERE used > 6000 HAVING min(pos) IS NOT NULL""",
)
def query_text_budget(spark, d):
    n, e = graph(spark, d)
    return G.subgraph_text(e, n, G.bfs(e, G.seeds(n, QUESTION), 2).visited)


@R.query("dfs_visited")
def dfs_visited(spark, d):
    n, e = graph(spark, d)
    return G.dfs(e, [r["id"] for r in G.seeds(n, QUESTION).collect()], 2)


@R.query(
    "shortest_path_hops",
    f"""WITH RECURSIVE {N}, {E}, {C}, {U}, {S(SOURCE_TERM, 1, 's')}, {S(TARGET_TERM, 1, 't')},
  b(id, hops) USING KEY (id) AS (SELECT id, 0 AS hops FROM s UNION SELECT DISTINCT dst, hops + 1 FROM b JOIN u ON u.src = b.id WHERE dst NOT IN (SELECT id FROM recurring.b))
SELECT s.id AS source, t.id AS target, min(hops) IS NOT NULL AS found, min(hops) AS hops FROM s, t LEFT JOIN b ON b.id = t.id GROUP BY ALL""",
)
def shortest_path_hops(spark, d):
    n, e = graph(spark, d)
    a, b = (G.seeds(n, q, 1).first()["id"] for q in (SOURCE_TERM, TARGET_TERM))
    path = G.shortest_path(e, a, b)
    return spark.createDataFrame([(a, b, bool(path), len(path) - 1 if path else None)], "source string, target string, found boolean, hops int")


@R.query(
    "path_text",
    f"""WITH RECURSIVE {N}, {E}, {C}, {U}, {S(SOURCE_TERM, 1, 's')}, {S(TARGET_TERM, 1, 't')},
  b(id, hops, parent) USING KEY (id) AS (SELECT id, 0 AS hops, NULL::VARCHAR FROM s
    UNION SELECT dst, min(hops) + 1, min(b.id) FROM b JOIN u ON u.src = b.id WHERE dst NOT IN (SELECT id FROM recurring.b) GROUP BY dst),
  p AS (SELECT id, parent, hops FROM b WHERE id IN (SELECT id FROM t) UNION ALL SELECT b.id, b.parent, b.hops FROM p JOIN b ON b.id = p.parent),
  f AS (SELECT p.hops hop, p.parent a, p.id b, arg_min(relation, c.id) relation, arg_min(confidence, c.id) confidence
    FROM p JOIN c ON (source = p.parent AND target = p.id) OR (source = p.id AND target = p.parent) GROUP BY ALL)
SELECT hop, x.label AS source_label, relation, confidence, y.label AS target_label FROM f JOIN n x ON x.id = a JOIN n y ON y.id = b""",
)
def path_text(spark, d):
    n, e = graph(spark, d)
    a, b = (G.seeds(n, q, 1).first()["id"] for q in (SOURCE_TERM, TARGET_TERM))
    return G.path_hops(e, n, G.shortest_path(e, a, b))


@R.query(
    "path_of_a_chain",
    "SELECT i AS hop, 'c' || lpad((i - 1)::VARCHAR, 2, '0') AS source_label, 'next' AS relation, 'EXTRACTED' AS confidence, 'c' || lpad(i::VARCHAR, 2, '0') AS target_label FROM range(1, 60) t(i)",
)
def path_of_a_chain(spark, d):
    """A path of 59 hops through 60 nodes: a search has no bound on its hops."""
    name = lambda c: F.concat(F.lit("c"), F.lpad(c.cast("string"), 2, "0"))
    n = spark.range(60).select(name(F.col("id")).alias("id"), name(F.col("id")).alias("label"))
    i = F.col("i")
    e = spark.range(59).withColumnRenamed("id", "i").select(i.alias("id"), name(i + 1).alias("source"), name(i).alias("target"), F.lit("next").alias("relation"), F.lit("EXTRACTED").alias("confidence"))
    return G.path_hops(e, n, G.shortest_path(e, "c00", "c59"))


@R.query(
    "shortest_path_unreachable",
    f"{BASE} SELECT n.id FROM n WHERE id NOT IN (SELECT src FROM u WHERE src <> dst)",
)
def shortest_path_unreachable(spark, d):
    """Nodes that no path reaches: without a link to another node."""
    n, e = graph(spark, d)
    return n.select("id").join(G.undirected(e).where("src <> dst").select(F.col("src").alias("id")), "id", "left_anti")


_PHASE = "((instr('0123456789abcdef', substr(md5({x}), 1, 1)) - 1) % 4)"


def _lpa(rounds):
    ctes = ["w AS MATERIALIZED (SELECT src, dst, count(*) w FROM u GROUP BY ALL)", "l0 AS MATERIALIZED (SELECT id, id AS label FROM n)"]
    i = 0
    for _ in range(rounds):
        for p in range(4):
            ctes.append(
                f"""l{i + 1} AS MATERIALIZED (SELECT id, label FROM (SELECT id, label, sum(k) k FROM (
        SELECT w.dst id, l.label, w.w k FROM w JOIN l{i} l ON l.id = w.src WHERE {_PHASE.format(x='w.dst')} = {p}
        UNION ALL SELECT id, label, 1 FROM l{i} WHERE {_PHASE.format(x='id')} = {p}) GROUP BY ALL)
      QUALIFY row_number() OVER (PARTITION BY id ORDER BY k DESC, label) = 1
      UNION ALL SELECT id, label FROM l{i} WHERE {_PHASE.format(x='id')} <> {p})"""
            )
            i += 1

    @R.query(f"lpa_round{rounds}", f"{BASE}, {', '.join(ctes)} SELECT id, label FROM l{i}")
    def run(spark, d):
        return G.label_propagation(edges(spark, d), nodes(spark, d), rounds)[0]


for _rounds in (1, 2, 3):
    _lpa(_rounds)


@R.query("dfs_edges")
def dfs_edges(spark, d):
    """The tree of the depth-first search."""
    n, e = graph(spark, d)
    return G.dfs(e, [r["id"] for r in G.seeds(n, QUESTION).collect()], 2).where("parent is not null").select("step", "parent", "id", "depth")


#: Phases after which the labels of the test tables no longer change.
_PHASES = 30 * G.PHASES


@R.query(
    "lpa_converged",
    f"""WITH RECURSIVE {N}, {E}, {C}, {U}, w AS MATERIALIZED (SELECT src, dst, count(*) w FROM u GROUP BY ALL),
  l(id, label, step) AS (SELECT id, id, 0 FROM n UNION ALL
    SELECT id, label, step FROM (
      SELECT id, label, step, row_number() OVER (PARTITION BY id ORDER BY k DESC, label) r FROM (
        SELECT id, label, max(step) + 1 AS step, sum(k) AS k FROM (
          SELECT w.dst AS id, l.label, w.w AS k, l.step FROM w JOIN l ON l.id = w.src WHERE {_PHASE.format(x='w.dst')} = l.step % 4
          UNION ALL SELECT id, label, CASE WHEN {_PHASE.format(x='id')} = step % 4 THEN 1 ELSE 4611686018427387904 END, step FROM l)
        GROUP BY id, label)) WHERE r = 1 AND step <= {_PHASES})
SELECT id, label FROM l WHERE step = {_PHASES}""",
)
def lpa_converged(spark, d):
    return G.label_propagation(edges(spark, d), nodes(spark, d))[0]


@R.query("dangling_edges", f"WITH {N}, {E}, x AS (SELECT id, 'source' endpoint, source missing_id FROM e UNION ALL SELECT id, 'target', target FROM e) SELECT * FROM x WHERE missing_id NOT IN (SELECT id FROM n)")
def dangling_edges(spark, d):
    return G.dangling_edges(edges(spark, d), nodes(spark, d))


@R.query("fk_invariant", f"WITH {N}, {E}, {C} SELECT c.id FROM c WHERE source NOT IN (SELECT id FROM n) OR target NOT IN (SELECT id FROM n)")
def fk_invariant(spark, d):
    """Edges of the loaded graph that lack an endpoint: must be empty."""
    n, e = graph(spark, d)
    return G.dangling_edges(e, n).select("id")


@R.query("pk_invariant", f"WITH {N} SELECT id, count(*) AS n FROM n GROUP BY 1 HAVING count(*) > 1")
def pk_invariant(spark, d):
    """Ids that live nodes hold more than once: must be empty."""
    return nodes(spark, d).groupBy("id").agg(F.count("*").alias("n")).where("n > 1")


@R.query(
    "stub_nodes",
    f"WITH {N}, {E} SELECT DISTINCT id, string_split(id, '::')[-1] AS label, 'stub' AS file_type, '' AS source_file FROM (SELECT source id FROM e UNION ALL SELECT target FROM e) WHERE id NOT IN (SELECT id FROM n)",
)
def stub_nodes(spark, d):
    return G.stub_nodes(edges(spark, d), nodes(spark, d))


_TWO = f"""WITH s AS (SELECT * FROM node_snapshots QUALIFY delivered_at = max(delivered_at) OVER (PARTITION BY snapshot_no)),
  a AS (SELECT DISTINCT id, max(trim(label)) OVER (PARTITION BY id) label FROM s WHERE snapshot_no = (SELECT min(snapshot_no) FROM s)),
  b AS (SELECT DISTINCT id, max(trim(label)) OVER (PARTITION BY id) label FROM s WHERE snapshot_no = (SELECT max(snapshot_no) FROM s)),
  t AS (SELECT * FROM edge_snapshots QUALIFY delivered_at = max(delivered_at) OVER (PARTITION BY snapshot_no)),
  ea AS (SELECT source, target, relation FROM t WHERE snapshot_no = (SELECT min(snapshot_no) FROM t)),
  eb AS (SELECT source, target, relation FROM t WHERE snapshot_no = (SELECT max(snapshot_no) FROM t))"""


def _two_graphs(spark, d):
    """The first and the last snapshot as two graphs (nodes a, nodes b, edges a, edges b)."""
    from ..operators.snapshots import last_deliveries

    out = []
    for name in ("node_snapshots", "edge_snapshots"):
        t = table(spark, d, name)
        lo, hi = t.agg(F.min("snapshot_no"), F.max("snapshot_no")).first()
        s = last_deliveries(t)
        for k in (lo, hi):
            one = s.where(F.col("snapshot_no") == k)
            out.append(one.groupBy("id").agg(F.max(F.trim("label")).alias("label")) if name == "node_snapshots" else one.select("source", "target", "relation"))
    return out


@R.query("merge_nodes", f"{_TWO} SELECT id, label FROM a UNION ALL SELECT id, label FROM b WHERE id NOT IN (SELECT id FROM a)")
def merge_nodes(spark, d):
    a, b, _, _ = _two_graphs(spark, d)
    return G.merge_nodes(a, b)


@R.query("merge_edges", f"{_TWO} SELECT * FROM ea UNION ALL SELECT * FROM eb")
def merge_edges(spark, d):
    _, _, a, b = _two_graphs(spark, d)
    return a.unionByName(b)


@R.query("diff_nodes", f"{_TWO} SELECT 'added' AS change, id, label FROM b WHERE id NOT IN (SELECT id FROM a) UNION ALL SELECT 'removed', id, label FROM a WHERE id NOT IN (SELECT id FROM b)")
def diff_nodes(spark, d):
    a, b, _, _ = _two_graphs(spark, d)
    return G.diff_nodes(a, b)


@R.query("diff_edges", f"{_TWO} SELECT 'added' AS change, * FROM (FROM eb EXCEPT FROM ea) UNION ALL SELECT 'removed', * FROM (FROM ea EXCEPT FROM eb)")
def diff_edges(spark, d):
    _, _, a, b = _two_graphs(spark, d)
    return G.diff_edges(a, b)

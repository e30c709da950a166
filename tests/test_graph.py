import hashlib
import random
import uuid
from collections import Counter, deque

import pytest
from pyspark.sql import functions as F

from weftgraph.operators import build as B
from weftgraph.operators import graph as G

NS = "id string, label string, file_type string, source_file string, source_line int, docstring string, community int, degree_centrality double"
ES = "id long, source string, target string, relation string, confidence string, confidence_score double, source_file string"


def make(spark, n, e):
    nodes = spark.createDataFrame([(i, l, "code", f, 1, None, c, None) for i, l, f, c in n], NS)
    edges = spark.createDataFrame([(k, a, b, r, "EXTRACTED", 1.0, "f.py") for k, (a, b, r) in enumerate(e)], ES)
    return nodes, edges


@pytest.fixture(scope="module")
def triangle(spark):
    return make(spark, [("a", "Alpha", "f.py", 0), ("b", "Beta", "f.py", 0), ("c", "Gamma", "g.py", 1)], [("a", "b", "calls"), ("a", "c", "calls"), ("b", "c", "calls")])


def test_hubs_and_cross_edges(triangle):
    n, e = triangle
    h = G.hubs(e, n).collect()
    assert [r["id"] for r in h] == ["a", "b", "c"] and {r["degree"] for r in h} == {2} and h[0]["degree_centrality"] == 1.0
    assert {(r["source"], r["target"]) for r in G.cross_community(e, n).collect()} == {("a", "c"), ("b", "c")}
    q = [r["question"] for r in G.questions(G.hubs(e, n), n).orderBy("rank").collect()]
    assert len(q) == 4 and "Alpha" in q[0] and "2 communities" in q[-1]


def test_self_loops_and_parallel_edges(spark):
    n, e = make(spark, [("a", "A", "f", 0), ("b", "B", "f", 0)], [("a", "a", "x"), ("a", "b", "x"), ("b", "a", "y")])
    assert {r["id"]: r["degree"] for r in G.degrees(e, n).collect()} == {"a": 3, "b": 2}
    got = [tuple(r)[:3] for r in G.neighbours(e, n, "a").collect()]
    assert got == [("a", "A", "x"), ("b", "B", "x"), ("b", "B", "x")]


def test_search_and_paths(spark):
    n, e = make(spark, [("n1", "Alpha", "f.py", 0), ("n2", "Beta", "f.py", 0), ("n3", "Gamma", "g.py", 1), ("n4", "Delta", "g.py", 1)], [("n1", "n2", "calls"), ("n2", "n3", "imports")])
    assert [r["id"] for r in G.seeds(n, "of alpha").collect()] == ["n1"]
    assert {r["id"]: r["score"] for r in G.score(n, "beta f.py").collect()} == {"n1": 0.5, "n2": 1.5}
    assert G.score(n, "zz of").count() == 0
    assert G.shortest_path(e, "n1", "n3") == ["n1", "n2", "n3"]
    assert G.shortest_path(e, "n1", "n4") == [] and G.shortest_path(e, "n1", "n1") == ["n1"]
    assert {r["id"] for r in G.dfs(e, ["n1"], 1).collect()} == {"n1", "n2"}
    text = [r["line"] for r in G.subgraph_text(e, n, G.bfs(e, G.seeds(n, "alpha"), 2).visited).orderBy("pos").collect()]
    assert text[0].startswith("NODE Beta") and "\n  summary: " not in text[0] and sum(x.startswith("EDGE") for x in text) == 2
    told = [r["line"] for r in G.subgraph_text(e, n.withColumn("docstring", F.lit("d" * 300)), G.bfs(e, G.seeds(n, "alpha"), 2).visited).orderBy("pos").collect()]
    assert told[0].endswith("\n  summary: " + "d" * 200)
    cut = [r["line"] for r in G.subgraph_text(e, n, G.bfs(e, G.seeds(n, "alpha"), 2).visited, 20).orderBy("pos").collect()]
    assert cut[-1] == "... (truncated)"


def test_a_path_of_many_hops(spark):
    n, e = make(spark, [(f"n{i:02d}", f"N{i}", "f", 0) for i in range(60)], [(f"n{i + 1:02d}", f"n{i:02d}", "next") for i in range(59)])
    path = G.shortest_path(e, "n00", "n59")
    assert path == [f"n{i:02d}" for i in range(60)] and G.shortest_path(e, "n00", "gone") == []
    hops = G.path_hops(e, n, path).orderBy("hop").collect()
    assert len(hops) == 59 and tuple(hops[0]) == (1, "N0", "next", "EXTRACTED", "N1")


def test_dfs_tree(spark):
    n, e = make(spark, [(i, i, "f", 0) for i in "abcd"], [("a", "b", "x"), ("b", "c", "x"), ("a", "c", "x"), ("c", "d", "x")])
    rows = [tuple(r) for r in G.dfs(e, ["a"], 3).orderBy("step").collect()]
    assert rows == [(0, "a", 0, None), (1, "b", 1, "a"), (2, "c", 2, "b"), (3, "d", 3, "c")]


def test_random_graphs_against_plain_search(spark):
    r = random.Random(5)
    ids = [f"v{i:02d}" for i in range(25)]
    links = [(r.choice(ids), r.choice(ids), "calls") for _ in range(35)]
    n, e = make(spark, [(i, i, "f", 0) for i in ids], links)
    near = {i: set() for i in ids}
    for a, b, _ in links:
        near[a].add(b)
        near[b].add(a)
    dist, todo = {"v00": 0}, deque(["v00"])
    while todo:
        x = todo.popleft()
        for y in near[x]:
            if y not in dist:
                dist[y] = dist[x] + 1
                todo.append(y)
    start = n.where("id = 'v00'")
    assert {r["id"]: r["depth"] for r in G.bfs(e, start, 3).visited.collect()} == {k: v for k, v in dist.items() if v <= 3}
    far = max(dist, key=dist.get)
    assert len(G.shortest_path(e, "v00", far)) == dist[far] + 1
    steps = G.dfs(e, ["v00"], 3).orderBy("step").collect()
    assert {x["id"] for x in steps} <= {k for k, v in dist.items() if v <= 3} and len({x["id"] for x in steps}) == len(steps)
    labels, rounds = G.label_propagation(e, n, 50)
    rows = labels.collect()
    assert rounds < 50 and len(rows) == 25 and {x["label"] for x in rows} <= set(ids)


def test_empty_graph(spark):
    n, e = make(spark, [], [])
    assert G.hubs(e, n).count() == 0 and G.label_propagation(e, n)[0].count() == 0
    assert G.bfs(e, n, 2).visited.count() == 0


def plain_labels(ids, links, rounds):
    """Labels and rounds by the definition: every node of a phase counts the votes of its neighbours and its own."""
    near = {i: Counter() for i in ids}
    for a, b in links:
        if a in near and b in near:
            near[a][b] += 1
            near[b][a] += a != b
    turn = {i: int(hashlib.md5(i.encode()).hexdigest()[0], 16) % G.PHASES for i in ids}
    label, seen = {i: i for i in ids}, []
    for r in range(1, rounds + 1):
        for q in range(G.PHASES):
            new = {}
            for i in ids:
                if turn[i] == q:
                    votes = Counter({label[i]: 1})
                    for b, w in near[i].items():
                        votes[label[b]] += w
                    new[i] = min(votes, key=lambda x: (-votes[x], x))
            label |= new
        if label in seen[-2:]:
            return label, r
        seen.append(dict(label))
    return label, rounds


def odd_graph(seed=11, n=90, m=150):
    """Parallel edges, loops, isolated nodes, ids whose order is that of their bytes, and an edge without a node."""
    r = random.Random(seed)
    ids = [f"{r.choice(['v', 'V', 'é', '~'])}{i}" for i in range(n)]
    links = [(r.choice(ids[:-5]), r.choice(ids[:-5])) for _ in range(m)]
    return ids, [*links, *links[:20], *[(b, a) for a, b in links[20:30]], (ids[0], ids[0]), (ids[1], "gone"), ("gone", ids[2])]


@pytest.mark.parametrize("limit", [None, 0])
@pytest.mark.parametrize("rounds", [1, 100])
def test_labels_by_their_definition(spark, limit, rounds):
    ids, links = odd_graph()
    n, e = make(spark, [(i, i, "f", 0) for i in ids], [(a, b, "x") for a, b in links])
    labels, r = G.label_propagation(e, n, rounds, limit)
    want, rounds_of = plain_labels(ids, links, rounds)
    assert {x["id"]: x["label"] for x in labels.collect()} == want and r == rounds_of


@pytest.mark.parametrize("most", [0, 12])
def test_labels_in_steps_with_many_changes(spark, monkeypatch, most):
    """Distributed steps that never, or only now and then, have few changes."""
    monkeypatch.setattr(G, "MAX_CHANGED", most)
    ids, links = odd_graph(7, 60, 90)
    n, e = make(spark, [(i, i, "f", 0) for i in ids], [(a, b, "x") for a, b in links])
    labels, r = G.label_propagation(e, n, 100, 0)
    assert ({x["id"]: x["label"] for x in labels.collect()}, r) == plain_labels(ids, links, 100)


def test_labels_of_small_graphs_take_few_jobs(spark):
    """Jobs don't grow with the rounds: the state was written and counted in each of them."""
    ids, links = odd_graph(40, 200, 320)
    n, e = make(spark, [(i, i, "f", 0) for i in ids], [(a, b, "x") for a, b in links])
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, "labels")
    try:
        labels, r = G.label_propagation(e, n)
        labels.collect()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert r == 8 and len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)) <= 25


def test_merge_and_diff(spark):
    a, ea = make(spark, [("a::Foo", "Foo", "f", 0), ("s::X", "X", "f", 0)], [("a::Foo", "s::X", "calls")])
    b, eb = make(spark, [("s::X", "other", "g", 1), ("b::Baz", "Baz", "g", 1)], [("b::Baz", "s::X", "calls")])
    m = {r["id"]: r["label"] for r in G.merge_nodes(a, b).collect()}
    assert m == {"a::Foo": "Foo", "s::X": "X", "b::Baz": "Baz"}
    assert sorted((r["change"], r["id"]) for r in G.diff_nodes(a, b).collect()) == [("added", "b::Baz"), ("removed", "a::Foo")]
    assert sorted((r["change"], r["source"]) for r in G.diff_edges(ea, eb).collect()) == [("added", "b::Baz"), ("removed", "a::Foo")]
    assert G.diff_nodes(a, a).count() == 0 and G.diff_edges(ea, ea.unionByName(ea)).count() == 0


def test_build_steps(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "file_path string, content_hash string")
    new = spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "1")], "file_path string, content_hash string")
    assert sorted(map(tuple, B.changes(old, new).collect())) == [("a", "unchanged"), ("b", "changed"), ("c", "removed"), ("d", "new")]
    n, e = make(spark, [("m::run", "run()", "m.py", 0), ("m::Job", "Job", "m.py", 0), ("o::x", "x()", "o.py", 0)], [("o::x", "run", "calls"), ("o::x", "job", "calls"), ("o::x", "nothing", "calls")])
    e = e.replace({"EXTRACTED": "INFERRED"}, subset=["confidence"])
    got = sorted((r["target"], r["confidence"]) for r in B.resolve(e, n).collect())
    assert got == [("m::Job", "EXTRACTED"), ("m::run", "EXTRACTED"), ("nothing", "INFERRED")]
    nodes, edges = B.drop_files(n, e, spark.createDataFrame([("m.py",)], "file_path string"))
    assert [r["id"] for r in nodes.collect()] == ["o::x"] and edges.count() == 3
    again = B.replace_by_file(n, spark.createDataFrame([("o::y", "y()", "o.py", 3), ("m::run", "run()", "o.py", 1)], "id string, label string, source_file string, source_line int"))
    assert {r["id"]: r["source_file"] for r in again.collect()} == {"m::run": "m.py", "m::Job": "m.py", "o::y": "o.py"}

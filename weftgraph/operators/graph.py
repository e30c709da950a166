"""The property graph: degrees, hubs, search, traversal, paths, communities.

`nodes` has (id, label, ...), `edges` (id, source, target, ...). Algorithms see edges undirected; parallel edges
count separately and a self-loop once. Every order has a tie-break by id.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import norm_path
from ..session import materialize
from ..sources.tables import small


def live_nodes(nodes: DataFrame) -> DataFrame:
    """One row per id among rows without deleted_at: the one loaded last (ties: the greatest label, then type, file,
    line, docstring, community). Null ids are ignored; columns beyond the node schema are dropped."""
    cols = ["label", "file_type", "source_file", "source_line", "docstring", "community", "degree_centrality"]
    rows = nodes.where("deleted_at is null and id is not null").withColumn("source_file", norm_path("source_file"))
    last = rows.groupBy("id").agg(F.max(F.struct("loaded_at", *cols)).alias("m"))
    return last.select("id", *[f"m.{c}" for c in cols])


def clean_edges(edges: DataFrame) -> DataFrame:
    """Distinct edges with outer blanks of the endpoints cut; edges with a null endpoint are dropped."""
    return (
        edges.select("id", F.trim("source").alias("source"), F.trim("target").alias("target"), "relation", "confidence", "confidence_score", "source_file")
        .where("source is not null and target is not null")
        .distinct()
    )


def connected_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose endpoints both exist."""
    ids = nodes.select("id")
    return edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(
        ids.withColumnRenamed("id", "target"), "target", "left_semi"
    )


def dangling_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, endpoint, missing_id) of endpoints without a node."""
    ends = edges.select("id", F.explode(F.create_map(F.lit("source"), F.col("source"), F.lit("target"), F.col("target"))).alias("endpoint", "missing_id"))
    return ends.join(nodes.select(F.col("id").alias("missing_id")), "missing_id", "left_anti").select("id", "endpoint", "missing_id")


def stub_nodes(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Stub rows (id, label, file_type, source_file) for endpoints that have no node; the label is the last part of the id."""
    ends = edges.select(F.explode(F.array("source", "target")).alias("id")).distinct()
    return ends.join(nodes.select("id"), "id", "left_anti").select(
        "id", F.element_at(F.split("id", "::"), -1).alias("label"), F.lit("stub").alias("file_type"), F.lit("").alias("source_file")
    )


def undirected(edges: DataFrame) -> DataFrame:
    """(src, dst, edge_id): every edge in both directions, a self-loop once."""
    both = F.when(F.col("source") == F.col("target"), F.array(F.struct(F.col("source").alias("src"), F.col("target").alias("dst")))).otherwise(
        F.array(F.struct(F.col("source").alias("src"), F.col("target").alias("dst")), F.struct(F.col("target").alias("src"), F.col("source").alias("dst")))
    )
    return edges.select(F.col("id").alias("edge_id"), F.explode(both).alias("e")).select("e.src", "e.dst", "edge_id")


def degrees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, label, degree) of every node; the endpoints are counted before they meet the nodes, never by an OR-join."""
    n = undirected(edges).groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))
    return nodes.select("id", "label").join(n, "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))


def centrality(deg: DataFrame) -> DataFrame:
    """Adds degree_centrality = degree / highest degree (0 in a graph without edges)."""
    top = deg.agg(F.max("degree")).scalar()
    return deg.withColumn("degree_centrality", F.when(top > 0, F.col("degree") / top).otherwise(0.0))


def hubs(edges: DataFrame, nodes: DataFrame, k: int = 10) -> DataFrame:
    """The k nodes of highest degree."""
    return centrality(degrees(edges, nodes)).orderBy(F.desc("degree"), "id").limit(k)


def cross_community(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges between nodes of different, known communities."""
    def side(e):
        return nodes.where("community is not null").select(F.col("id").alias(e), F.col("label").alias(f"{e}_label"), F.col("community").alias(f"{e}_community"))

    return (
        edges.select("id", "source", "target", "relation")
        .join(side("source"), "source")
        .join(side("target"), "target")
        .where("source_community <> target_community")
    )


def questions(hub_rows: DataFrame, nodes: DataFrame, k: int = 5) -> DataFrame:
    """(rank, question): one per top hub, and one on the communities if there are several."""
    w = W.partitionBy(F.lit(0)).orderBy(F.desc("degree"), "id")
    top = hub_rows.orderBy(F.desc("degree"), "id").limit(k)
    a = top.select(F.row_number().over(w).alias("rank"), F.concat(F.lit("What role does "), "label", F.lit(" play, with its "), F.col("degree").cast("string"), F.lit(" connections?")).alias("question"))
    n = nodes.agg(F.countDistinct("community").alias("n")).where("n > 1")
    return a.unionByName(n.select(F.lit(k + 1).alias("rank"), F.concat(F.lit("How do the "), F.col("n").cast("string"), F.lit(" communities relate to each other?")).alias("question")))


def stats(nodes: DataFrame, edges: DataFrame, manifest: DataFrame) -> DataFrame:
    """One row: node_count, edge_count, community_count, file_count."""
    n = nodes.agg(F.count("*").alias("node_count"), F.countDistinct("community").alias("community_count"))
    e = edges.agg(F.count("*")).scalar()
    f = manifest.agg(F.countDistinct(norm_path("file_path"))).scalar()
    return n.select("*", e.alias("edge_count"), f.alias("file_count"))


def terms(question: str) -> list[str]:
    """Lower-case words of a question of more than two bytes."""
    return [t for t in question.lower().split() if len(t.encode()) > 2]


def score(nodes: DataFrame, question: str) -> DataFrame:
    """(id, label, score > 0): per term 1.0 if the label holds it and 0.5 if the path does."""
    total: Column = F.lit(0.0)
    for t in terms(question):
        total = total + F.when(F.contains(F.lower("label"), F.lit(t)), 1.0).otherwise(0.0) + F.when(F.contains(F.lower("source_file"), F.lit(t)), 0.5).otherwise(0.0)
    return nodes.select("id", "label", total.alias("score")).where("score > 0")


def seeds(nodes: DataFrame, question: str, k: int = 5) -> DataFrame:
    return score(nodes, question).orderBy(F.desc("score"), "id").limit(k)


@dataclass
class Ball:
    """visited (id, depth, parent); parent is the smallest id that discovered the node, null for seeds."""

    visited: DataFrame
    depth: int
    levels: list[DataFrame]


#: Frontiers of up to this many ids are broadcast; larger ones meet the edges by a shuffle.
MAX_FRONTIER = 50_000


def bfs(edges: DataFrame, start: DataFrame, depth: int | None, target: str | None = None) -> Ball:
    """Level-wise search from the ids of `start`; ends on an empty frontier, when `target` is reached, or after `depth`
    levels (None: no bound).

    Each level is one join of the frontier with the edges, one anti-join and one count, written to the checkpoint
    folder, so that a lost executor repeats one level only. Neighbours of a level lie in it or in the two beside it,
    so only these two are looked through, however many levels there are.
    """
    links = undirected(edges).select("src", "dst").where("src <> dst")
    if depth is None or depth > 1:
        links = materialize(links)  # read once per level, so not derived again from the tables
    levels = [materialize(start.select("id").distinct().select("id", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("parent")))]
    hit = F.max((F.col("id") == target).cast("int")) if target is not None else F.lit(0)
    n, d = levels[0].count(), 0
    while n and (depth is None or d < depth):
        d += 1
        ids = levels[-1].select("id")
        near = F.broadcast(ids) if n <= MAX_FRONTIER else ids
        known = ids if d == 1 else ids.unionByName(levels[-2].select("id"))
        found = (
            links.join(near.withColumnRenamed("id", "src"), "src")
            .groupBy(F.col("dst").alias("id"))
            .agg(F.min("src").alias("parent"))
            .join(known, "id", "left_anti")
            .select("id", F.lit(d).alias("depth"), "parent")
        )
        levels.append(materialize(found))
        n, reached = levels[-1].agg(F.count("*"), hit).first()
        if reached:
            break
    visited = levels[0]
    for level in levels[1:]:
        visited = visited.unionByName(level)
    return Ball(visited, d, levels)


def shortest_path(edges: DataFrame, source: str, target: str) -> list[str]:
    """Ids on a shortest undirected path (ties: smallest parent); [] if there is none. The search goes on until it
    meets the target or runs out of nodes; the way back looks up one id in each level."""
    if source == target:
        return [source]
    ball = bfs(edges, edges.sparkSession.createDataFrame([(source,)], "id string"), None, target)
    path, at = [], target
    for level in reversed(ball.levels[1:]):
        hop = level.where(F.col("id") == at).first()
        if hop is None:
            return []
        path.append(at)
        at = hop["parent"]
    return [source, *reversed(path)] if path else []


def path_hops(edges: DataFrame, nodes: DataFrame, path: list[str]) -> DataFrame:
    """(hop, source_label, relation, confidence, target_label) of a path: the first edge (lowest id) of each hop, in
    either direction."""
    spark = edges.sparkSession
    hops = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(path, path[1:]), 1)], "hop int, a string, b string")
    both = (F.col("source") == F.col("a")) & (F.col("target") == F.col("b")), (F.col("source") == F.col("b")) & (F.col("target") == F.col("a"))
    ends = edges.where(F.col("source").isin(path) & F.col("target").isin(path))  # one literal per hop
    first = ends.join(F.broadcast(hops), both[0] | both[1]).groupBy("hop", "a", "b").agg(F.min(F.struct("id", "relation", "confidence")).alias("f"))
    label = nodes.where(F.col("id").isin(path)).select("id", "label")
    return (
        first.join(label.select(F.col("id").alias("a"), F.col("label").alias("source_label")), "a")
        .join(label.select(F.col("id").alias("b"), F.col("label").alias("target_label")), "b")
        .select("hop", "source_label", "f.relation", "f.confidence", "target_label")
    )


def neighbours(edges: DataFrame, nodes: DataFrame, node_id: str, k: int = 20) -> DataFrame:
    """The first k neighbours of a node, once per parallel edge, by confidence descending (as text), then id.

    Each row shows the first edge (lowest id) that connects the two.
    """
    one = edges.where((F.col("source") == node_id) | (F.col("target") == node_id)).withColumn(
        "id2", F.when(F.col("source") == node_id, F.col("target")).otherwise(F.col("source"))
    )
    first = one.groupBy("id2").agg(F.min(F.struct("id", "relation", "confidence")).alias("f"), F.count("*").alias("n"))
    rows = first.join(nodes.select(F.col("id").alias("id2"), "label"), "id2").select(
        F.col("id2").alias("id"), "label", "f.relation", "f.confidence", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("copy")
    )
    return rows.orderBy(F.desc("confidence"), "id", "copy").limit(k)


#: A depth-first search is sequential; it runs in one task over at most this many adjacency rows.
DFS_LIMIT = 2_000_000


def dfs(edges: DataFrame, start: list[str], depth: int, limit: int = DFS_LIMIT) -> DataFrame:
    """(step, id, depth, parent): exact depth-first order from the start ids, at most `depth` deep; parent is the node
    from which the search came (null for the start ids).

    A node is visited when popped; neighbours are pushed by edge id descending and outgoing first, and a node
    first reached deep is not expanded again. The search cannot leave the ball of radius `depth`, so the ball is
    found first (distributed); only its edges go into the one sequential task, and more than `limit` raise.
    """
    spark = edges.sparkSession
    ball = bfs(edges, spark.createDataFrame([(s,) for s in start], "id string"), depth).visited.select("id", "depth")
    inner = ball.where(F.col("depth") < depth).select(F.col("id").alias("src"))
    out = F.explode(F.array(F.struct(F.col("source").alias("src"), F.col("target").alias("dst"), F.lit(0).alias("back")), F.struct(F.col("target").alias("src"), F.col("source").alias("dst"), F.lit(1).alias("back"))))
    adjacency = materialize(edges.select("id", out.alias("e")).select("id", "e.*").join(inner, "src", "left_semi"))
    n = adjacency.count()
    if n > limit:
        raise ValueError(f"the ball of depth {depth} has {n} adjacency rows; the sequential search is limited to {limit}")

    def run(pdf):
        import pandas as pd

        near: dict[str, list[str]] = {}
        for s, t in pdf.sort_values(["back", "id"], ascending=[True, False])[["src", "dst"]].itertuples(index=False):
            near.setdefault(s, []).append(t)
        seen, rows = set(), []
        stack = [(s, 0, None) for s in reversed(start)]
        while stack:
            x, d, parent = stack.pop()
            if x in seen or d > depth:
                continue
            seen.add(x)
            rows.append((len(rows), x, d, parent))
            if d < depth:
                stack += [(y, d + 1, x) for y in near.get(x, ()) if y not in seen]
        return pd.DataFrame(rows, columns=["step", "id", "depth", "parent"])

    return adjacency.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(lambda p: run(p), "step int, id string, depth int, parent string")


#: Label propagation: nodes change in this many phases per round, by a hash of the id.
PHASES = 4


def phase(c: Column) -> Column:
    """0..PHASES-1 from the first hex digit of the MD5 of the id (the same in every engine)."""
    return (F.instr(F.lit("0123456789abcdef"), F.substring(F.md5(c), 1, 1)) - 1) % PHASES


#: Labels of a graph of at most this many links (both directions) are propagated in one task; larger graphs take
#: distributed steps with the same results. A link is 25 bytes there.
LPA_LIMIT = 5_000_000


def numbered(edges: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """ids (id, k, p): numbers k in the order of the ids and the phase p of each; links (src, dst, w, p): neighbours by
    number in both directions, a self-loop once, with the number w of parallel edges and the phase of dst.

    Edges without a node at either end are left out.
    """
    ids = materialize(nodes.select("id").distinct().sort("id").select("id", F.monotonically_increasing_id().alias("k"), phase(F.col("id")).alias("p")))
    pairs = edges.groupBy(F.least("source", "target").alias("x"), F.greatest("source", "target").alias("y")).agg(F.count("*").alias("w"))
    for end, k, p in (("x", "src", "back"), ("y", "dst", "p")):
        pairs = pairs.join(ids.select(F.col("id").alias(end), F.col("k").alias(k), F.col("p").alias(p)), end).drop(end)
    one, other = F.struct("src", "dst", "w", "p"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"), "w", F.col("back").alias("p"))
    both = F.when(F.col("src") == F.col("dst"), F.array(one)).otherwise(F.array(one, other))
    return ids, materialize(pairs.select(F.explode(both).alias("l")).select("l.*"))


def propagate(links: DataFrame, rounds: int) -> DataFrame:
    """(k, label, rounds) of the linked nodes: all phases in one task, as long as anything changes.

    A node is looked at again only if a neighbour changed since it was last looked at; its own vote alone cannot
    change its label, as that has most votes already.
    """

    def stage(batches):
        import numpy as np
        import pyarrow as pa

        got = [[c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches if b.num_rows]
        if not got:
            return
        src, dst, w, p = (np.concatenate(c) for c in zip(*got))
        del got
        ids, at = np.unique(dst, return_inverse=True)  # the links of both directions: every src is a dst as well
        order = np.argsort(at, kind="stable")
        near, w, n = np.searchsorted(ids, src[order]), w[order], len(ids)
        first = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=n))])
        turn = np.empty(n, dtype=np.int8)
        turn[at] = p
        del src, dst, p, order, at

        def rows(x):
            """Of the links of the nodes x: places of their nodes in x, places of the links."""
            many = first[x + 1] - first[x]
            owner = np.repeat(np.arange(len(x)), many)
            return owner, np.arange(len(owner)) + np.repeat(first[x] - np.cumsum(many) + many, many)

        label, due, seen = np.arange(n), np.ones(n, dtype=bool), []
        for r in range(1, rounds + 1):
            for q in range(PHASES):
                x = np.flatnonzero(due & (turn == q))
                if not len(x):
                    continue
                due[x] = False
                owner, link = rows(x)
                keys = np.concatenate([owner * n + label[near[link]], np.arange(len(x)) * n + label[x]])
                votes = np.concatenate([w[link], np.ones(len(x), dtype=w.dtype)])
                order = np.argsort(keys)
                keys, votes = keys[order], votes[order]
                start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
                keys, votes = keys[start], np.add.reduceat(votes, start)
                owner = keys // n
                start = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
                best = np.flatnonzero(votes == np.maximum.reduceat(votes, start)[owner])  # labels ascend: the first is the smallest
                new = keys[best[np.searchsorted(owner[best], np.arange(len(x)))]] % n
                changed = new != label[x]
                label[x] = new
                due[near[rows(x[changed])[1]]] = True
            if any(np.array_equal(label, s) for s in seen[-2:]):
                break
            seen = [*seen[-1:], label.copy()]
        for i in range(0, n, 100_000):
            part = slice(i, i + 100_000)
            k = ids[part]
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(ids[label[part]]), pa.array(np.full(len(k), r))], names=["k", "label", "rounds"])

    return links.select("src", "dst", "w", "p").coalesce(1).mapInArrow(stage, "k long, label long, rounds long")


def propagate_step(voters: DataFrame, labels: DataFrame, t: int) -> DataFrame:
    """Labels (k, p, label, t of the last change) after step t, in which the nodes of phase (t - 1) % PHASES take the
    label with most votes of their neighbours and themselves; ties go to the smallest label.

    voters: the links to nodes of that phase. Only nodes count votes that have a neighbour which changed since their
    last turn; the others keep their label.
    """
    now = F.col("p") == (t - 1) % PHASES
    if t > PHASES:
        recent = labels.where(F.col("t") >= t - PHASES).select(F.col("k").alias("src"))
        voters = voters.join(voters.join(recent, "src", "left_semi").select("dst").distinct(), "dst", "left_semi")
    votes = voters.join(labels.select(F.col("k").alias("src"), "label"), "src").groupBy(F.col("dst").alias("k"), "label").agg(F.sum("w").alias("n"))
    tally = votes.unionByName(labels.where(now).select("k", "label", F.lit(1).cast("long").alias("n"))).groupBy("k", "label").agg(F.sum("n").alias("n"))
    best = tally.groupBy("k").agg(F.min(F.struct((-F.col("n")).alias("n"), "label")).alias("b")).select("k", F.col("b.label").alias("new"))
    moved = labels.where(now).join(best, "k").select("k", "p", F.col("new").alias("label"), F.when(F.col("new") == F.col("label"), F.col("t")).otherwise(t).alias("t"))
    return labels.where(~now | F.col("p").isNull()).unionByName(moved)


#: Changed labels that are broadcast to the links; while more nodes change in a round, labels and links are shuffled.
MAX_CHANGED = 200_000


def overlaid(df: DataFrame, changed: DataFrame, key: str, label: str) -> DataFrame:
    """df with the labels of the nodes in its column `key` replaced by those in the changes (k, label, t)."""
    return df.join(changed.select(F.col("k").alias(key), F.col("label").alias("_new")), key, "left").withColumn(label, F.coalesce("_new", label)).drop("_new")


def propagate_changes(links: DataFrame, changed: DataFrame, t: int) -> DataFrame:
    """changed (k, label, t), with those of step t.

    links: (src, dst, w, label of src, own label of dst) to nodes of the phase, with labels before the changes. The links
    are read, never shuffled, unless more nodes than MAX_CHANGED have a changed neighbour.
    """
    recent = F.broadcast(changed.where(F.col("t") >= t - PHASES).select(F.col("k").alias("src")))
    active = materialize(links.join(recent, "src", "left_semi").select("dst").distinct())
    voters = links.join(small(active, MAX_CHANGED), "dst", "left_semi")
    few = F.broadcast(changed)
    votes = overlaid(overlaid(voters, few, "src", "label"), few, "dst", "own").groupBy("dst", "label").agg(F.sum("w").alias("n"), F.max("own").alias("own"))
    n = F.col("n") + (F.col("label") == F.col("own")).cast("long")
    best = votes.groupBy("dst").agg(F.min(F.struct((-n).alias("n"), "label")).alias("b"), F.max("own").alias("own"))
    label = F.least("b", F.struct(F.lit(-1).cast("long").alias("n"), F.col("own").alias("label")))["label"]  # the own vote alone
    moved = best.select(F.col("dst").alias("k"), label.alias("label"), "own").where("label <> own").select("k", "label", F.lit(t).alias("t"))
    rows = changed.unionByName(moved).groupBy("k").agg(F.max(F.struct("t", "label")).alias("m")).select("k", "m.label", "m.t")
    return materialize(rows, instead_of=changed)


def propagate_steps(ids: DataFrame, links: DataFrame, rounds: int) -> tuple[DataFrame, int]:
    """(k, label) and the number of rounds, for graphs of any size.

    While more than MAX_CHANGED nodes change in a round, a step shuffles the links of its phase and the labels, and
    writes the labels to the checkpoint folder. Then the labels are written beside the links once, and a step reads
    these and writes the changes only, until there are too many of them to be broadcast: then it starts over.
    """
    by_phase = [materialize(links.where(F.col("p") == q).select("src", "dst", "w")) for q in range(PHASES)]
    labels = materialize(ids.select("k", "p", F.col("k").alias("label"), F.lit(0).alias("t")))
    labelled: list[DataFrame] = []
    changed = None

    def whole() -> DataFrame:
        if changed is None:
            return labels
        new = small(changed.select("k", F.struct("label", "t").alias("new")), MAX_CHANGED)
        return labels.join(new, "k", "left").select("k", "p", F.coalesce("new.label", "label").alias("label"), F.coalesce("new.t", "t").alias("t"))

    moves: list[int] = []
    seen: list[int] = []
    for r in range(1, rounds + 1):
        for q in range(PHASES):
            t, near = len(moves) + 1, sum(moves[-PHASES:])
            if t > PHASES and not near:
                moves.append(0)
                continue
            if changed is not None and changed.count() > MAX_CHANGED:
                labels, changed = materialize(whole(), instead_of=labels), None
            if t > PHASES and near <= MAX_CHANGED:
                if changed is None:
                    changed = materialize(labels.where(F.col("t") >= t - PHASES).select("k", "label", "t"))
                    src, dst = (labels.select(F.col("k").alias(k), F.col("label").alias(v)) for k, v in (("src", "label"), ("dst", "own")))
                    labelled = [materialize(x.join(src, "src").join(dst, "dst"), instead_of=old) for x, old in zip(by_phase, labelled or [None] * PHASES)]
                changed = propagate_changes(labelled[q], changed, t)
                moves.append(changed.where(F.col("t") == t).count())
            else:
                if changed is not None:
                    labels, changed = materialize(whole(), instead_of=labels), None
                labels = materialize(propagate_step(by_phase[q], labels, t), instead_of=labels)
                moves.append(labels.where(F.col("t") == t).count())
        mark = whole().agg(F.sum(F.xxhash64("k", "label").cast("decimal(38,0)")).alias("m")).first()["m"]
        if mark in seen[-2:]:
            return whole().select("k", "label"), r
        seen.append(mark)
    return whole().select("k", "label"), rounds


def label_propagation(edges: DataFrame, nodes: DataFrame, rounds: int = 100, limit: int | None = None) -> tuple[DataFrame, int]:
    """(id, label) and the number of rounds: semi-synchronous label propagation until nothing changes.

    Start label: the own id. Isolated nodes keep theirs. A state equal to that of two rounds before ends the rounds as
    well. Graphs of at most `limit` links (default LPA_LIMIT) are done by `propagate`, larger ones by `propagate_steps`.
    """
    ids, links = numbered(edges, nodes)
    if links.count() <= (LPA_LIMIT if limit is None else limit):
        state = materialize(propagate(links, rounds))
        r = state.agg(F.max("rounds")).first()[0] or min(2, rounds)  # without links the second round is as the first
    else:
        state, r = propagate_steps(ids, links, rounds)
    told = ids.select("id", "k").join(state.select("k", F.col("label").alias("l")), "k", "left").select("id", F.coalesce("l", "k").alias("k"))
    return told.join(ids.select("k", F.col("id").alias("label")), "k").select("id", "label"), r


def merge_nodes(a: DataFrame, b: DataFrame) -> DataFrame:
    """Nodes of a, and those of b whose id a lacks."""
    return a.unionByName(b.join(a.select("id"), "id", "left_anti"))


def diff_nodes(a: DataFrame, b: DataFrame) -> DataFrame:
    """(change, id, label): ids only in b are added, ids only in a removed."""
    added = b.join(a.select("id"), "id", "left_anti").select(F.lit("added").alias("change"), "id", "label")
    return added.unionByName(a.join(b.select("id"), "id", "left_anti").select(F.lit("removed").alias("change"), "id", "label"))


def diff_edges(a: DataFrame, b: DataFrame) -> DataFrame:
    """(change, source, target, relation) of distinct triples that only one side has; one shuffle."""
    key = ["source", "target", "relation"]
    sides = a.select(*key, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(b.select(*key, F.lit(0).alias("l"), F.lit(1).alias("r")))
    return sides.groupBy(*key).agg(F.max("l").alias("l"), F.max("r").alias("r")).where("l <> r").select(F.when(F.col("r") == 1, "added").otherwise("removed").alias("change"), *key)


def subgraph_text(edges: DataFrame, nodes: DataFrame, ball: DataFrame, budget: int = 2000) -> DataFrame:
    """(pos, line): nodes by degree, each with the first 200 characters of its documentation if it has one, then tree
    edges by depth, cut after budget * 3 bytes, then a note on the cut.

    No line has fewer than 10 bytes, so only the first budget * 3 / 10 lines can fit: these are taken by a top-k,
    and the running sum sees no more than them.
    """
    most, room = budget * 3, budget * 3 // 10 + 1
    d = undirected(edges).groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))
    shown = ball.join(nodes.select("id", "label", "source_file", "community", "docstring"), "id").join(d, "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    summary = F.when(F.col("docstring") != "", F.concat(F.lit("\n  summary: "), F.substring("docstring", 1, 200))).otherwise("")
    a = shown.select(
        F.lit(0).alias("part"), (-F.col("degree")).alias("o"), F.col("id").alias("k"),
        F.concat(F.lit("NODE "), "label", F.lit(" ["), F.coalesce("source_file", F.lit("?")), F.lit("] community="), F.coalesce(F.col("community").cast("string"), F.lit("?")), F.lit(" degree="), F.col("degree").cast("string"), F.coalesce(summary, F.lit(""))).alias("line"),
    )
    first = edges.select(F.least("source", "target").alias("x"), F.greatest("source", "target").alias("y"), F.struct("id", "relation", "confidence").alias("f")).groupBy("x", "y").agg(F.min("f").alias("f"))
    label = nodes.select(F.col("id").alias("parent"), F.col("label").alias("parent_label"))
    tree = shown.where("parent is not null").join(label, "parent").withColumns({"x": F.least("id", "parent"), "y": F.greatest("id", "parent")}).join(first, ["x", "y"])
    b = tree.select(F.lit(1).alias("part"), F.col("depth").cast("long").alias("o"), F.col("id").alias("k"), F.concat(F.lit("EDGE "), "parent_label", F.lit(" --"), "f.relation", F.lit("-> "), "label", F.lit(" ("), "f.confidence", F.lit(")")).alias("line"))
    top = a.unionByName(b).orderBy("part", "o", "k").limit(room)
    w = W.partitionBy(F.lit(0)).orderBy("part", "o", "k")
    run = top.select(F.row_number().over(w).alias("pos"), "line", F.sum(F.octet_length("line") + 1).over(w).alias("used"))
    kept = run.where(F.col("used") <= most).select("pos", "line")
    cut = run.where(F.col("used") > most).agg(F.min("pos").alias("pos")).where("pos is not null").select("pos", F.lit("... (truncated)").alias("line"))
    return kept.unionByName(cut)

"""The engine: builds the graph of a folder, keeps it up to date and answers questions about it."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schemas
from .functions import extract as X
from .operators import build as B
from .operators import export
from .operators import graph as G
from .sources import extraction, files
from .sources.semantic import Backend, enrich
from .session import materialize
from .store import Store, write_text

#: Labels that a difference shows per kind of change.
SHOWN = 20
_EXTRACTED = extraction.SCHEMA + ", content_hash string"
_GRAPH_EDGES = schemas.EDGES + ", source_line int"


class Engine:
    """All state lives in versioned tables of one folder; several engines may read it at once."""

    def __init__(self, spark: SparkSession, folder: str, backend: Backend | None = None, paper_text: Callable[[bytes], str] | None = None):
        """`backend` enriches files, `paper_text` turns the bytes of a paper into text; both are left out by default."""
        self.spark, self.store, self.backend, self.paper_text = spark, Store(spark, folder), backend, paper_text

    # building

    def run(self, root: str) -> dict:
        """Detect changes, extract new and changed files, rebuild the graph from all extractions, find communities.

        Only files whose content hash is new are parsed; symbols are resolved over all files. A failing run is
        logged as failed and leaves the graph as it was. The report is written beside the tables. Counts of the
        result: files per status, nodes, edges, communities, and rows that were given up as duplicates.
        """
        began = int(time.time())
        run_id = self.store.read("runs", schemas.RUNS).agg(F.max("id")).first()[0] or 0
        row = {"id": run_id + 1, "started_at": str(began), "finished_at": None, "status": "failed", "files_processed": 0, "nodes_added": 0, "edges_added": 0}
        try:
            found = self.store.write("found", files.detect(self.spark, root, self.paper_text))
            manifest = self.store.read("manifest", schemas.MANIFEST)
            status = B.changes(manifest, found).groupBy("status").count().collect()
            counts = {r["status"]: r["count"] for r in status}
            now = found.select("file_path", "content_hash", "file_type", "language", F.lit(str(began)).alias("last_seen_at"), "size_bytes")
            cache = self.store.read("extractions", _EXTRACTED)
            work = found.join(cache.select("file_path", "content_hash").distinct(), ["file_path", "content_hash"], "left_anti")
            fresh = self.extract(work)
            valid = cache.join(found.select("file_path", "content_hash"), ["file_path", "content_hash"], "left_semi")
            self.store.write("extractions", valid.unionByName(fresh))
            extracted = self.store.read("extractions", _EXTRACTED)
            nodes, edges = self.build(extracted)
            nodes = self.store.write("nodes", self.cluster(nodes, edges))
            self.store.write("edges", edges)
            self.store.write("manifest", now)
            row |= {
                "status": "completed", "files_processed": counts.get("new", 0) + counts.get("changed", 0),
                "nodes_added": nodes.count(), "edges_added": self.store.read("edges").count(),
            }
            self.write_report()
            real = self.nodes().where("file_type <> 'stub'").count()
            raw = extracted.selectExpr("count_if(kind = 'node' and id <> '')", "count_if(kind = 'edge' and source is not null and target <> '')").first()
            counts |= {"duplicate_nodes": raw[0] - real, "duplicate_edges": raw[1] - row["edges_added"]}
            return counts | {"nodes": row["nodes_added"], "edges": row["edges_added"], "communities": nodes.agg(F.countDistinct("community")).first()[0]}
        finally:
            row["finished_at"] = str(int(time.time()))
            self.store.append("runs", self.spark.createDataFrame([row], schemas.RUNS), schemas.RUNS)

    update = run

    def extract(self, found: DataFrame) -> DataFrame:
        """Extraction rows of files with a content: code, documents and, with a backend, concepts."""
        code = extraction.extract_code(found.where("file_type = 'code'"))
        out = code.unionByName(self._documents(found.where("file_type = 'document' or file_type = 'paper' and content is not null")))
        if self.backend is not None:
            s = enrich(found.where("content is not null"), self.backend)
            cols = extraction.SCHEMA.split(", ")
            blank = [F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in cols]
            by = {c.split()[0]: b for c, b in zip(cols, blank)}
            n = s.select("file_path", F.explode("nodes").alias("x")).select(*[
                {"file_path": F.col("file_path"), "kind": F.lit("node").alias("kind"), "id": F.col("x.id"), "label": X.sanitize("x.label").alias("label"), "docstring": F.col("x.summary").alias("docstring"), "node_type": F.col("x.node_type")}.get(k, b)
                for k, b in by.items()
            ])
            e = s.select("file_path", F.explode("edges").alias("x")).select(*[
                {"file_path": F.col("file_path"), "kind": F.lit("edge").alias("kind"), "source": F.col("x.source"), "target": F.col("x.target"), "relation": F.col("x.relation"), "confidence": F.lit("SEMANTIC").alias("confidence")}.get(k, b)
                for k, b in by.items()
            ])
            out = out.unionByName(n).unionByName(e)
        return out.join(found.select("file_path", "content_hash"), "file_path")

    def _documents(self, docs: DataFrame) -> DataFrame:
        """A node per document and per heading (markdown, rst, papers) or paragraph (text), nested, and links to other files."""
        rows = X.lines(docs, "file_path", "content")
        stem = X.node_id(X.file_stem("file_path"))
        name = F.regexp_extract("file_path", r"([^/]*)$", 1)
        null = F.lit(None).cast("string")

        def node(df, i, label, line, kind):
            return df.select(
                "file_path", F.lit("node").alias("kind"), i.alias("id"), X.sanitize(label).alias("label"), line.cast("int").alias("source_line"), null.alias("docstring"),
                F.lit(kind).alias("node_type"), null.alias("source"), null.alias("target"), null.alias("relation"), null.alias("confidence"), F.lit(None).cast("double").alias("confidence_score"),
            )

        def edge(df, a, b, line, relation, score):
            return df.select(
                "file_path", F.lit("edge").alias("kind"), null.alias("id"), null.alias("label"), line.cast("int").alias("source_line"), null.alias("docstring"), null.alias("node_type"),
                a.alias("source"), b.alias("target"), F.lit(relation).alias("relation"), F.lit("EXTRACTED").alias("confidence"), F.lit(score).alias("confidence_score"),
            )

        md = rows.where(F.col("file_path").rlike(r"(?i)\.mdx?$"))
        h = X.nesting(X.headings(md, "file_path"), "file_path")
        r = X.rst_headings(rows.where(F.col("file_path").rlike(r"(?i)\.rst$")), "file_path").select("file_path", "line_no", F.lit(1).alias("level"), "title", F.lit(None).cast("int").alias("parent_line"))
        h = h.unionByName(r)
        sid = lambda title, line: F.concat(stem, F.lit("::"), X.target_id(title), F.lit("_"), line.cast("string"))
        own = sid(F.col("title"), F.col("line_no"))
        up = h.select("file_path", F.col("line_no").alias("parent_line"), sid(F.col("title"), F.col("line_no")).alias("parent_id"))
        nested = h.join(up, ["file_path", "parent_line"], "left")
        paper = X.pdf_markdown(docs.where("file_type = 'paper'"), "file_path", "content").where(F.startswith("line", F.lit("## ")))
        h = h.unionByName(paper.select("file_path", (F.col("p") + 1).alias("line_no"), F.lit(2).alias("level"), F.substring("line", 4, 1000).alias("title"), F.lit(None).cast("int").alias("parent_line")))
        p = X.paragraphs(rows.where(F.col("file_path").rlike(r"(?i)\.txt$")), "file_path")
        pid = F.concat(stem, F.lit("::p"), F.col("p").cast("string"))
        links = X.markdown_links(md, "file_path")
        to = X.target_id(F.regexp_extract("target", r"([^/]*?)(?:\.[^./#?]*)?(?:[#?].*)?$", 1))
        return (
            node(docs, stem, name, F.lit(1), "document")
            .unionByName(node(h, own, F.col("title"), F.col("line_no"), "section"))
            .unionByName(edge(nested, F.coalesce("parent_id", stem), own, F.col("line_no"), "contains", 1.0))
            .unionByName(node(p, pid, F.col("label"), F.col("line_no"), "section"))
            .unionByName(edge(p, stem, pid, F.col("line_no"), "contains", 1.0))
            .unionByName(edge(links, stem, to, F.col("line_no"), "references", 0.8))
        )

    def build(self, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Nodes (first file wins an id, real nodes win over stubs) and resolved edges with stubs for loose ends."""
        n, e = extraction.nodes_and_edges(rows)
        n = n.where("id is not null and id <> ''").withColumn("file_type", X.stored_type("node_type", X.language("source_file")))
        n = n.withColumn("file_type", F.when(F.col("node_type").isin("document", "section"), "document").otherwise(F.col("file_type")))
        n = B.first_wins(n.drop("node_type"), "id", "source_file", "source_line", "label")
        n = n.select("id", X.sanitize("label").alias("label"), "file_type", "source_file", "source_line", X.sanitize("docstring", X.MAX_DOCSTRING).alias("docstring"))
        e = e.where("source is not null and target is not null and target <> ''").withColumn("id", F.xxhash64("source", "target", "relation", "source_file", "source_line"))
        resolved = B.resolve(e, n).join(e.select("id", "source_file", "source_line").dropDuplicates(["id"]), "id")
        stubs = G.stub_nodes(resolved, n).select("id", "label", "file_type", "source_file", F.lit(None).cast("int").alias("source_line"), F.lit(None).cast("string").alias("docstring"))
        return n.unionByName(stubs), resolved.select(*[c.split()[0] for c in _GRAPH_EDGES.split(", ")])

    def cluster(self, nodes: DataFrame, edges: DataFrame) -> DataFrame:
        """Nodes with a community number (hash of the label's id) and the degree centrality."""
        labels, _ = G.label_propagation(edges, nodes)
        central = G.centrality(G.degrees(edges, nodes)).select("id", "degree_centrality")
        plain = nodes.drop("community", "degree_centrality")
        return plain.join(labels.select("id", F.pmod(F.hash("label"), F.lit(2**31 - 1)).alias("community")), "id", "left").join(central, "id", "left")

    def cluster_only(self) -> int:
        """Find communities again without reading files and write the report; the number of communities."""
        n = self.store.write("nodes", self.cluster(self.nodes(), self.edges()))
        self.write_report()
        return n.agg(F.countDistinct("community")).first()[0]

    # asking

    def nodes(self) -> DataFrame:
        return self.store.read("nodes", schemas.NODES)

    def edges(self) -> DataFrame:
        return self.store.read("edges", _GRAPH_EDGES)

    def stats(self) -> dict:
        return G.stats(self.nodes(), self.edges(), self.store.read("manifest", schemas.MANIFEST)).first().asDict()

    def query(self, question: str, mode: str = "bfs", depth: int = 2, budget: int = 2000) -> str:
        """Text of the part of the graph around the nodes that match the question best."""
        n, e = self.nodes(), self.edges()
        if n.isEmpty():
            return "No nodes in graph."
        seeds = G.seeds(n, question).collect()
        if not seeds:
            return "No matching nodes found."
        ids = [r["id"] for r in seeds]
        start = self.spark.createDataFrame([(i,) for i in ids], "id string")
        if mode == "dfs":
            ball = materialize(G.dfs(e, ids, depth).select("id", "depth", "parent"))
        else:
            ball = G.bfs(e, start, depth).visited
        found, tree = ball.agg(F.count("*"), F.count("parent")).first()
        labels = ", ".join(r["label"] for r in seeds)
        lines = [r["line"] for r in G.subgraph_text(e, n, ball, budget).orderBy("pos").collect()]
        text = "\n".join([f"Traversal: {mode.upper()} depth={depth} | Start: {labels} | {found} nodes, {tree} edges found", "", *lines])
        self._log(question, text)
        return text

    def _ends(self, n: DataFrame, a: str, b: str) -> list:
        return [G.seeds(n, q, 1).first() for q in (a, b)]

    def path(self, a: str, b: str) -> list[str]:
        """Labels on a shortest path between the best matches of two terms; [] if there is none."""
        n, e = self.nodes(), self.edges()
        ends = self._ends(n, a, b)
        ids = [] if None in ends else G.shortest_path(e, ends[0]["id"], ends[1]["id"])
        label = {r["id"]: r["label"] for r in n.where(F.col("id").isin(ids)).select("id", "label").collect()} if ids else {}
        return [label[i] for i in ids]

    def path_text(self, a: str, b: str) -> str:
        """A shortest path hop by hop, with the relation and the confidence of the first edge of each hop."""
        n, e = self.nodes(), self.edges()
        ends = self._ends(n, a, b)
        for term, end in zip((a, b), ends):
            if end is None:
                return f"No matching node for '{term}'."
        ids = G.shortest_path(e, ends[0]["id"], ends[1]["id"])
        if not ids:
            return "No path found."
        hops = G.path_hops(e, n, ids).orderBy("hop").collect() if len(ids) > 1 else []
        text = "\n".join([f"Shortest path ({len(ids) - 1} hops):", *[f"  {r['source_label']} --{r['relation']} [{r['confidence']}]--> {r['target_label']}" for r in hops]])
        self._log(f"{a} -> {b}", f"path found: {len(ids) - 1} hops")
        return text

    def explain(self, node: str) -> dict | None:
        """The node (exact id, else best match), its first 20 neighbours and their full number."""
        n, e = self.nodes(), self.edges()
        hit = n.where(F.col("id") == node).first()
        if hit is None:
            best = G.seeds(n, node, 1).first()
            hit = best and n.where(F.col("id") == best["id"]).first()
        if hit is None:
            return None
        every = e.where((F.col("source") == hit["id"]) | (F.col("target") == hit["id"])).count()
        self._log(node, f"explain: {hit['label']} ({every} neighbours)")
        return hit.asDict() | {"neighbours": [r.asDict() for r in G.neighbours(e, n, hit["id"]).drop("copy").collect()], "neighbour_count": every}

    def _log(self, question: str, answer: str) -> None:
        old = self.store.log("history", schemas.HISTORY)
        n = (old.agg(F.max("id")).first()[0] or 0) + 1
        row = [(n, question, answer[:500], "", str(int(time.time())))]
        self.store.add("history", self.spark.createDataFrame(row, schemas.HISTORY).coalesce(1))

    def history(self, limit: int = 20) -> list[dict]:
        return [r.asDict() for r in self.store.log("history", schemas.HISTORY).orderBy(F.desc("id")).limit(limit).collect()]

    # exports and algebra

    def report(self) -> str:
        n, e = self.nodes(), self.edges()
        hubs = G.hubs(e, n)
        stats = G.stats(n, e, self.store.read("manifest", schemas.MANIFEST))
        return export.report_text(export.report_lines(stats, hubs, G.cross_community(e, n), G.questions(hubs, n)))

    def write_report(self) -> None:
        """`graph_report.md` beside the tables of the graph."""
        write_text(self.spark, f"{self.store.folder}/graph_report.md", [self.report()])

    def export(self, out: str, kind: str = "json") -> None:
        """json and graphml are folders written by the executors; file (one JSON object), html and report are single
        files, written by the driver row by row."""
        n, e = self.nodes(), self.edges()
        if kind == "json":
            export.json_rows(n, e).select("kind", "json").write.mode("overwrite").partitionBy("kind").text(out)
        elif kind == "graphml":
            export.write_graphml(n, e, out)
        elif kind in ("html", "report"):
            write_text(self.spark, out, [export.html_page(n, e) if kind == "html" else self.report()])
        elif kind == "file":
            write_text(self.spark, out, export.json_document(n, e))
        else:
            raise ValueError(f"unknown export {kind}")

    def merge(self, other: "Engine", out: "Engine") -> dict:
        """The union of two graphs into `out`: own nodes win, edges are kept as a bag; communities are found anew."""
        nodes = G.merge_nodes(self.nodes(), other.nodes().select(*self.nodes().columns))
        edges = self.edges().unionByName(other.edges())
        out.store.write("edges", edges)
        out.store.write("nodes", out.cluster(nodes, out.edges()))
        out.write_report()
        return out.stats()

    def diff(self, other: "Engine") -> dict:
        """Counts of nodes and edges that were added or removed on the way to `other`, and the first SHOWN labels of
        the nodes (by id)."""
        out = {}
        for name, d in (("nodes", G.diff_nodes(self.nodes(), other.nodes())), ("edges", G.diff_edges(self.edges(), other.edges()))):
            got = {r["change"]: r["count"] for r in d.groupBy("change").count().collect()}
            out |= {f"{name}_added": got.get("added", 0), f"{name}_removed": got.get("removed", 0)}
            for change in ("added", "removed") if name == "nodes" else ():
                first = d.where(F.col("change") == change).orderBy("id").limit(SHOWN)
                out[f"{change}_labels"] = [r["label"] for r in first.collect()] if got.get(change) else []
        return out

    def diff_text(self, other: "Engine") -> str:
        d = self.diff(other)
        rows = [f"{k.replace('_', ' ').capitalize()}: {n}" for k, n in d.items() if not k.endswith("labels")]
        for change, sign in (("added", "+"), ("removed", "-")):
            labels, n = d[f"{change}_labels"], d[f"nodes_{change}"]
            rows += ["", f"{change.capitalize()} nodes:", *[f"  {sign} {x}" for x in labels]] if labels else []
            rows += [f"  ... and {n - len(labels)} more"] if n > len(labels) else []
        return "\n".join(rows)

    def history_text(self, limit: int = 20) -> str:
        """The newest questions, each with the first line of its answer, cut after 100 characters."""
        rows = []
        for r in self.history(limit):
            first = (r["answer"] or "").split("\n")[0]
            rows += [f"[#{r['id']}] {r['question']}", *([f"  {first[:100]}{'...' if len(first) > 100 else ''}"] if first else []), ""]
        return "\n".join(rows) or "No query history found."

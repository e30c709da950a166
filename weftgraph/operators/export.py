"""Exports: JSON rows, GraphML elements, groups and colours of the page, report lines, and the file sinks."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import col


#: Fields of a node and of an edge in JSON.
NODE_FIELDS = ("id", "label", "file_type", "source_file", "source_line", "docstring", "community")
EDGE_FIELDS = ("source", "target", "relation", "confidence", "confidence_score", "source_file")


def escape_xml(c: Column | str) -> Column:
    out = col(c)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def json_rows(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, id, json): one JSON object per node and edge, with every field."""
    full = {"ignoreNullFields": "false"}
    n = nodes.select(F.lit("node").alias("kind"), "id", F.to_json(F.struct(*NODE_FIELDS), full).alias("json"))
    e = edges.select(F.lit("edge").alias("kind"), F.col("id").cast("string").alias("id"), F.to_json(F.struct(*EDGE_FIELDS), full).alias("json"))
    return n.unionByName(e)


def json_document(nodes: DataFrame, edges: DataFrame) -> Iterator[str]:
    """The graph as one JSON object, in parts: rows come one partition after the other, never all at once."""
    rows = json_rows(nodes, edges)
    for k, (name, kind) in enumerate((("nodes", "node"), ("edges", "edge"))):
        yield (",\n" if k else "{\n") + f'"{name}": ['
        for i, r in enumerate(rows.where(F.col("kind") == kind).orderBy("id").toLocalIterator()):
            yield (",\n  " if i else "\n  ") + r["json"]
        yield "\n]"
    yield "\n}\n"


def graphml_elements(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, id, xml): one element per node and edge; missing values are left out."""
    def data(key: str, c: str) -> Column:
        return F.when(F.col(c).isNotNull(), F.concat(F.lit(f'<data key="{key}">'), escape_xml(F.col(c).cast("string")), F.lit("</data>"))).otherwise("")

    n = nodes.select(
        F.lit("node").alias("kind"), "id",
        F.concat(F.lit('<node id="'), escape_xml("id"), F.lit('">'), data("label", "label"), data("file_type", "file_type"), data("source_file", "source_file"), data("source_line", "source_line"), data("community", "community"), F.lit("</node>")).alias("xml"),
    )
    e = edges.select(
        F.lit("edge").alias("kind"), F.col("id").cast("string").alias("id"),
        F.concat(F.lit('<edge source="'), escape_xml("source"), F.lit('" target="'), escape_xml("target"), F.lit('">'), data("relation", "relation"), data("confidence", "confidence"), data("confidence_score", "confidence_score"), F.lit("</edge>")).alias("xml"),
    )
    return n.unionByName(e)


GRAPHML_HEAD = (
    '<?xml version="1.0" encoding="UTF-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns">\n'
    + "".join(f'<key id="{k}" for="node" attr.name="{k}" attr.type="{t}"/>\n' for k, t in (("label", "string"), ("file_type", "string"), ("source_file", "string"), ("source_line", "int"), ("community", "int")))
    + "".join(f'<key id="{k}" for="edge" attr.name="{k}" attr.type="{t}"/>\n' for k, t in (("relation", "string"), ("confidence", "string"), ("confidence_score", "double")))
    + '<graph id="G" edgedefault="undirected">\n'
)


def write_graphml(nodes: DataFrame, edges: DataFrame, folder: str) -> None:
    """GraphML as text parts: head, nodes, edges and tail in folders that sort in this order."""
    spark, x = nodes.sparkSession, graphml_elements(nodes, edges)
    spark.createDataFrame([(GRAPHML_HEAD.rstrip("\n"),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/0-head")
    x.where("kind = 'node'").select("xml").write.mode("overwrite").text(f"{folder}/1-nodes")
    x.where("kind = 'edge'").select("xml").write.mode("overwrite").text(f"{folder}/2-edges")
    spark.createDataFrame([("</graph>\n</graphml>",)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/3-tail")


def group_colours(nodes: DataFrame) -> DataFrame:
    """(community, position, members, colour): hues spread evenly in the order of the smallest id per community."""
    from pyspark.sql import Window as W

    g = nodes.where("community is not null").groupBy("community").agg(F.min("id").alias("first_id"), F.count("*").alias("members"))
    w = W.partitionBy(F.lit(0))  # one row per community
    pos = F.row_number().over(w.orderBy("first_id")) - 1
    hue = F.floor((pos * 360) / F.count("*").over(w)).cast("int")
    return g.select("community", pos.alias("position"), "members", F.concat(F.lit("hsl("), hue.cast("string"), F.lit(", 70%, 60%)")).alias("colour"))


PAGE = """<!DOCTYPE html>
<html><head><meta charset="utf-8"><title>Graph</title>
<style>
body {{ margin: 0; display: flex; font: 14px sans-serif; }}
canvas {{ flex: 1; height: 100vh; }}
aside {{ width: 18em; height: 100vh; overflow: auto; padding: 0 1em; }}
li {{ list-style: none; }} i {{ display: inline-block; width: 1em; height: 1em; margin-right: .5em; }}
</style></head>
<body><canvas id="graph"></canvas>
<aside><p><input id="search" placeholder="Search"></p><p id="shown"></p><ul id="legend"></ul></aside>
<script id="data" type="application/json">{data}</script>
<script>
const d = JSON.parse(document.getElementById("data").textContent), canvas = document.getElementById("graph"), pen = canvas.getContext("2d");
const group = new Map(d.groups.map((g, i) => [g.community, {{...g, i}}])), at = new Map(), count = d.groups.length || 1;
d.nodes.forEach((n, k) => {{
  const g = group.get(n.community), turn = 2 * Math.PI * (g ? g.i : 0) / count, r = 12 * Math.sqrt(k % 997 + 1), a = 2.4 * k;
  at.set(n.id, {{n, x: 900 * Math.cos(turn) + r * Math.cos(a), y: 900 * Math.sin(turn) + r * Math.sin(a), colour: g ? g.colour : "#999", degree: 0}});
}});
const links = d.edges.map(e => ({{e, a: at.get(e.source), b: at.get(e.target)}})).filter(l => l.a && l.b);
for (const l of links) {{ l.a.degree++; l.b.degree++; }}
for (let k = 0; k < 60; k++) for (const l of links) {{  // linked nodes draw together
  const dx = l.b.x - l.a.x, dy = l.b.y - l.a.y, s = 0.02 * (1 - 60 / (Math.hypot(dx, dy) + 1));
  l.a.x += s * dx; l.a.y += s * dy; l.b.x -= s * dx; l.b.y -= s * dy;
}}
let zoom = 0.35, ox = 0, oy = 0, wanted = "";
const hit = p => wanted && (p.n.label || "").toLowerCase().includes(wanted);
function draw() {{
  canvas.width = canvas.clientWidth; canvas.height = canvas.clientHeight;
  pen.setTransform(zoom, 0, 0, zoom, canvas.width / 2 + ox, canvas.height / 2 + oy);
  pen.strokeStyle = "#ccc"; pen.beginPath();
  for (const l of links) {{ pen.moveTo(l.a.x, l.a.y); pen.lineTo(l.b.x, l.b.y); }}
  pen.stroke();
  for (const p of at.values()) {{
    pen.fillStyle = p.colour; pen.globalAlpha = !wanted || hit(p) ? 1 : 0.15; pen.beginPath();
    pen.arc(p.x, p.y, 4 + Math.sqrt(p.degree), 0, 7); pen.fill();
    if (hit(p) || p.degree > 20) {{ pen.fillStyle = "#000"; pen.fillText(p.n.label || p.n.id, p.x + 8, p.y); }}
  }}
  pen.globalAlpha = 1;
}}
for (const g of d.groups) {{
  const li = document.createElement("li"), box = document.createElement("i");
  box.style.background = g.colour; li.append(box, "Community " + g.community + " (" + g.members + ")"); document.getElementById("legend").append(li);
}}
document.getElementById("search").oninput = e => {{
  wanted = e.target.value.toLowerCase(); draw();
  document.getElementById("shown").textContent = wanted ? [...at.values()].filter(hit).length + " nodes" : "";
}};
canvas.onwheel = e => {{ e.preventDefault(); zoom *= e.deltaY < 0 ? 1.1 : 0.9; draw(); }};
canvas.onmousemove = e => {{ if (e.buttons) {{ ox += e.movementX; oy += e.movementY; draw(); }} }};
onresize = draw; draw();
</script></body></html>
"""
#: Nodes of an HTML page; a page is for reading, larger graphs are exported as JSON or GraphML.
MAX_PAGE_NODES = 20_000


def html_page(nodes: DataFrame, edges: DataFrame) -> str:
    """A self-contained page of a small graph: nodes and edges on a canvas, coloured by community, a legend in the order
    of the community numbers with their sizes, and a search; more than MAX_PAGE_NODES nodes raise."""
    if nodes.limit(MAX_PAGE_NODES + 1).count() > MAX_PAGE_NODES:
        raise ValueError(f"the graph has more than {MAX_PAGE_NODES} nodes; export JSON or GraphML instead")
    rows = json_rows(nodes, edges).orderBy("kind", "id").collect()
    part = {k: ",".join(r["json"] for r in rows if r["kind"] == k) for k in ("node", "edge")}
    groups = ",".join(r["json"] for r in group_colours(nodes).orderBy("community").select(F.to_json(F.struct("community", "members", "colour")).alias("json")).collect())
    data = f'{{"nodes":[{part["node"]}],"edges":[{part["edge"]}],"groups":[{groups}]}}'
    return PAGE.format(data=data.replace("</", "<\\/"))


def report_lines(stats: DataFrame, hubs: DataFrame, surprising: DataFrame, questions: DataFrame, most: int = 20) -> DataFrame:
    """(section, pos, line) of the markdown report; at most `most` cross-community lines (lowest edge ids)."""
    from pyspark.sql import Window as W

    w = W.partitionBy(F.lit(0))
    s = stats.select(F.lit(0).alias("section"), F.posexplode(F.array(*[
        F.concat(F.lit(f"**{name}:** "), F.col(c).cast("string")) for name, c in (("Nodes", "node_count"), ("Edges", "edge_count"), ("Communities", "community_count"), ("Files", "file_count"))
    ])).alias("pos", "line"))
    h = hubs.select(F.lit(1).alias("section"), (F.row_number().over(w.orderBy(F.desc("degree"), "id")) - 1).alias("pos"), F.concat(F.lit("- **"), "label", F.lit("** ("), F.col("degree").cast("string"), F.lit(" connections)")).alias("line"))
    top = surprising.orderBy("id").limit(most)
    x = top.select(F.lit(2).alias("section"), (F.row_number().over(w.orderBy("id")) - 1).alias("pos"), F.concat(F.lit("- **"), "source_label", F.lit("** -> **"), "target_label", F.lit("** ("), "relation", F.lit(")")).alias("line"))
    q = questions.select(F.lit(3).alias("section"), (F.col("rank") - 1).alias("pos"), F.concat(F.lit("- "), "question").alias("line"))
    return s.unionByName(h).unionByName(x).unionByName(q)


HEADINGS = ("# Graph report", "## Hubs", "## Links between communities", "## Questions")


def report_text(lines: DataFrame) -> str:
    """The markdown report; its lines are bounded by the limits of the sections."""
    rows = lines.orderBy("section", "pos").collect()
    out = []
    for k, title in enumerate(HEADINGS):
        own = [r["line"] for r in rows if r["section"] == k]
        out += [title, "", *(own or ["None."]), ""]
    return "\n".join(out)

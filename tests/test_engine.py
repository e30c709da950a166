import json

import pytest
from pyspark.sql import functions as F

from weftgraph.engine import Engine
from weftgraph.sources.semantic import Retrying, enrich
from weftgraph.sources.web import fetch, ingest
from weftgraph.streaming.watch import sessions, watch


def test_engine_end_to_end(spark, tmp_path):
    src = tmp_path / "src"
    (src / "sub").mkdir(parents=True)
    (src / "main.py").write_text('class Greeter:\n    """Says hello."""\n    def greet(self, n):\n        return helper(n)\n\ndef helper(x):\n    return x\n')
    (src / "sub" / "readme.md").write_text("# Title\n\n## Part\n\nSee [main](../main.py).\n")
    g = Engine(spark, f"file://{tmp_path}/graph")
    first = g.run(str(src))
    assert first["new"] == 2 and first["nodes"] > 5
    calls = g.edges().where("relation = 'calls'").collect()
    assert [(r["source"], r["target"], r["confidence"]) for r in calls] == [("main::Greeter::greet", "main::helper", "EXTRACTED")]
    assert g.edges().where("relation = 'references'").first()["target"] == "main"
    again = g.run(str(src))
    assert again["unchanged"] == 2 and again["nodes"] == first["nodes"]
    (src / "main.py").write_text("def helper(x):\n    return x\n")
    (src / "sub" / "readme.md").unlink()
    third = g.run(str(src))
    assert third["changed"] == 1 and third["removed"] == 1 and {r["id"] for r in g.nodes().collect()} == {"main", "main::helper"}
    assert "helper()" in g.query("helper") and "EDGE helper() --contains-> main.py" in g.query("helper", "dfs") and g.path("helper", "main.py") == ["helper()", "main.py"]
    assert g.explain("helper")["neighbour_count"] == 1 and g.explain("zzz") is None
    assert g.path_text("helper", "main.py") == "Shortest path (1 hops):\n  helper() --contains [EXTRACTED]--> main.py"
    assert g.path_text("zzz", "main.py") == "No matching node for 'zzz'." and third["duplicate_nodes"] == 0
    asked = g.history_text().split("\n")
    assert len(g.history()) == 4 and asked[0] == "[#4] helper -> main.py" and asked[1] == "  path found: 1 hops"
    assert "**Nodes:** 2" in g.report() and (tmp_path / "graph" / "graph_report.md").read_text() == g.report()
    g.export(str(tmp_path / "g.json"), "file")
    whole = json.loads((tmp_path / "g.json").read_text())
    assert {x["id"] for x in whole["nodes"]} == {"main", "main::helper"} and whole["edges"][0]["confidence_score"] == 1.0 and "docstring" in whole["nodes"][0]
    g.export(str(tmp_path / "g.html"), "html")
    page = (tmp_path / "g.html").read_text()
    assert "helper" in page and '"groups":[{"community"' in page
    g.export(f"file://{tmp_path}/xml", "graphml")
    h, out = Engine(spark, f"file://{tmp_path}/other"), Engine(spark, f"file://{tmp_path}/out")
    assert h.query("x") == "No nodes in graph."
    assert g.merge(g, out)["node_count"] == 2 and g.diff(out)["nodes_added"] == 0
    assert h.diff_text(g).split("\n")[:1] == ["Nodes added: 2"] and "  + main.py" in h.diff_text(g)


def test_semantic_and_web(spark):
    f = spark.createDataFrame([("a", "x"), ("b", "bad"), ("c", None)], "file_path string, content string")
    tries = []

    class B:
        def ask(self, path, text):
            if text == "bad":
                raise ValueError
            return 'Sure: {"nodes": [{"id": "k", "label": "K", "summary": "s", "node_type": "concept"}], "edges": []} end'

    assert [(r["file_path"], r["nodes"][0]["id"]) for r in enrich(f, B()).collect()] == [("a", "k")]
    assert enrich(f).count() == 2

    def send(prompt):
        tries.append(1)
        if len(tries) < 3:
            raise OSError
        return "{}"

    class Refused(Exception):
        status = 400

    class Busy(Exception):
        status = 503

    for error, n in ((Refused, 1), (Busy, 3)):
        calls = []

        def fails(prompt, calls=calls, error=error):
            calls.append(1)
            raise error

        with pytest.raises(error):
            Retrying(fails, pause=0).ask("p", "t")
        assert len(calls) == n
    assert Retrying(send, pause=0).ask("p", "t") == "{}" and len(tries) == 3
    urls = spark.createDataFrame([("https://a.org/x.html",), ("http://10.0.0.1/y",), ("ftp://a.org",), ("https://a.org/fail",)], "url string")

    def get(url):
        if "fail" in url:
            raise OSError
        return b"<html><p>Hi</p></html>"

    saved = dict(ingest(urls.where("url like '%a.org%'"), get, str(spark.conf.get("spark.checkpoint.dir")) + "/pages"))
    assert list(saved) == ["https://a.org/x.html"] and open(saved["https://a.org/x.html"]).read() == "Hi" and saved["https://a.org/x.html"].endswith("/x.md")
    assert {r["url"]: r["text"] for r in fetch(urls, get).collect()} == {"https://a.org/x.html": "Hi", "https://a.org/fail": None}


def test_watch_and_sessions(spark, tmp_path):
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "a.py").write_text("x = 1\n")
    (tmp_path / "w" / "b.bin").write_text("x")
    seen = []
    watch(spark, str(tmp_path / "w"), seen.extend, str(tmp_path / "state"), once=True).awaitTermination()
    watch(spark, str(tmp_path / "w"), seen.extend, str(tmp_path / "state"), once=True).awaitTermination()
    assert [p.rpartition("/")[2] for p in seen] == ["a.py"]
    e = spark.createDataFrame([("k", "2026-01-01 00:00:00"), ("k", "2026-01-01 00:00:02"), ("k", "2026-01-01 00:01:00")], "key string, ts string")
    e = e.select("key", F.col("ts").cast("timestamp").alias("ts"))
    assert sorted(r["n"] for r in sessions(e, "key", "ts", "3 seconds", "1 minute").collect()) == [1, 2]


def test_a_failing_update_is_made_up_for(spark, tmp_path):
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "a.py").write_text("x = 1\n")
    seen = []

    def fails(paths):
        raise OSError("busy")

    watch(spark, str(tmp_path / "w"), fails, str(tmp_path / "state"), once=True).awaitTermination()
    (tmp_path / "w" / "b.py").write_text("x = 1\n")
    watch(spark, str(tmp_path / "w"), seen.extend, str(tmp_path / "state"), once=True).awaitTermination()
    assert sorted(p.rpartition("/")[2] for p in seen) == ["a.py", "b.py"]


def test_papers_become_text(spark, tmp_path):
    from weftgraph.sources.files import detect

    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "a.pdf").write_bytes(b"%PDF")
    (tmp_path / "p" / "b.pdf").write_bytes(b"bad")
    (tmp_path / "p" / "a.png").write_bytes(b"x")

    def text(data):
        if data == b"bad":
            raise ValueError
        return "First words.\n\nA heading\n\nMore."

    got = {r["file_path"]: r["content"] for r in detect(spark, str(tmp_path / "p"), text).collect()}
    assert got == {"a.pdf": "First words.\n\nA heading\n\nMore.", "b.pdf": None, "a.png": None}
    g = Engine(spark, f"file://{tmp_path}/g", paper_text=text)
    g.run(str(tmp_path / "p"))
    assert {r["label"] for r in g.nodes().collect()} == {"a.pdf", "A heading"}

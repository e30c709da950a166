"""From source text to nodes and edges: the code extractor as a map stage and as an SQL table function."""

from __future__ import annotations

import re
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from ..functions.extract import TAGS
from ..functions.scalars import norm_path
from . import code

BATCH = 256
_RATIONALE = re.compile(r"(?:#+|//+!?|--+|;+|%+)\s*(" + "|".join(TAGS) + r"):\s*(.*)")


def unquoted(docstring: str | None) -> str | None:
    """A docstring literal without its prefix and quotes."""
    return docstring and re.sub(r"\A[a-zA-Z]{0,2}(\"\"\"|'''|\"|')\s*([\s\S]*?)\s*\1\Z", r"\2", docstring.strip())


def stem_of(path: str) -> str:
    parts = path.replace("\\", "/").split("/")
    stem = parts[-1].rpartition(".")[0] or parts[-1]
    return f"{parts[-2]}_{stem}" if len(parts) > 1 else stem


def _id(*parts: str) -> str:
    return "::".join(p.strip().replace("\\", "_").replace("/", "_") for p in parts)


def _target(name: str) -> str:
    return "".join(c if c.isalnum() or c == "_" else "_" for c in name.lower()).rstrip("_")


def rows_of(path: str, text: str):
    """Tuples (kind, id, label, line, docstring, node_type, source, target, relation, confidence, score) of one file.

    Nodes: the file, its classes, its functions, tagged comments. Edges: the file contains classes and functions, a
    class contains its methods, a function calls names (guessed targets), the file imports modules, a tagged comment
    is the rationale for the nearest declaration at or before its line. A nested function belongs to the class or the file.
    """
    language = code.language_of(path)
    if not language or text is None:
        return
    p = code.parse(text, language)
    file_id = _id(stem_of(path))
    for n, module in code.imports(p):
        if target := _target(module):
            yield "edge", None, None, n, None, None, file_id, target, "imports", "EXTRACTED", 1.0
    found = sorted([(1, file_id), *((c.line, _id(file_id, c.name)) for c in p.classes)])
    for f in p.functions:
        found.append((f.line, _id(file_id, f.owner, f.name) if f.owner else _id(file_id, f.name)))
    found.sort()
    for c in p.comments:
        m = _RATIONALE.match(c.text)
        if m:
            rid = _id(file_id, "rationale", str(c.first))
            above = found[max(0, bisect_right(found, (c.first, chr(0x10FFFF))) - 1)][1]
            yield "node", rid, f"{m[1]}: {m[2].strip()}", c.first, None, "rationale", None, None, None, None, None
            yield "edge", None, None, c.first, None, None, rid, above, "rationale_for", "EXTRACTED", 1.0
    yield "node", file_id, path.rpartition("/")[2], 1, None, "file", None, None, None, None, None
    classes = {}
    for c in p.classes:
        classes[c.name] = _id(file_id, c.name)
        yield "node", classes[c.name], c.name, c.line, unquoted(c.docstring), "class", None, None, None, None, None
        yield "edge", None, None, c.line, None, None, file_id, classes[c.name], "contains", "EXTRACTED", 1.0
    for f in p.functions:
        parent = classes.get(f.owner) or (_id(file_id, f.owner) if f.owner else file_id)
        fid = _id(parent, f.name)
        yield "node", fid, f"{f.name}()", f.line, unquoted(f.docstring), "function", None, None, None, None, None
        yield "edge", None, None, f.line, None, None, parent, fid, "contains", "EXTRACTED", 1.0
        for name in code.calls(p, f):
            yield "edge", None, None, f.line, None, None, fid, _target(name), "calls", "INFERRED", 0.7


_NAMES = ["file_path", "kind", "id", "label", "source_line", "docstring", "node_type", "source", "target", "relation", "confidence", "confidence_score"]
SCHEMA = (
    "file_path string, kind string, id string, label string, source_line int, docstring string, node_type string, "
    "source string, target string, relation string, confidence string, confidence_score double"
)
_TYPES = [pa.int32() if n == "source_line" else pa.float64() if n == "confidence_score" else pa.string() for n in _NAMES]


def extract_code(contents: DataFrame) -> DataFrame:
    """Node and edge rows (see SCHEMA) of every code file of (file_path, content); a narrow stage without a shuffle.

    Null texts are skipped, unknown extensions give nothing, broken code is read as far as its brackets match.
    """

    def stage(batches):
        for big in batches:
            for at in range(0, big.num_rows, BATCH):
                b = big.slice(at, BATCH)
                out = [(p, *r) for p, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for r in rows_of(p, t)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _TYPES)], names=_NAMES)

    files = contents.select(norm_path("file_path").alias("file_path"), "content").where("file_path is not null and content is not null")
    return files.mapInArrow(stage, SCHEMA)


def import_rows(contents: DataFrame) -> DataFrame:
    """(file_path, line_no, module) of the imports of every code file of (file_path, content); see `code.imports`."""

    def stage(batches):
        for b in batches:
            out = []
            for path, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if language := code.language_of(path):
                    out += [(path, n, m) for n, m in code.imports(code.parse(text, language))]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int32(), pa.string()))], names=["file_path", "line_no", "module"])

    files = contents.select(norm_path("file_path").alias("file_path"), "content").where("file_path is not null and content is not null")
    return files.mapInArrow(stage, "file_path string, line_no int, module string")


def nodes_and_edges(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    n = rows.where("kind = 'node'").select("id", "label", F.col("file_path").alias("source_file"), "source_line", "docstring", "node_type")
    e = rows.where("kind = 'edge'").select("source", "target", "relation", "confidence", "confidence_score", F.col("file_path").alias("source_file"), "source_line")
    return n, e


def register(spark: SparkSession) -> None:
    """Makes the extractor a table function: SELECT ... FROM files, LATERAL parse_code(file_path, content)."""

    @udtf(returnType=SCHEMA.replace("file_path string, ", ""))
    class ParseCode:
        def eval(self, path: str, text: str):
            yield from rows_of(path, text)

    spark.udtf.register("parse_code", ParseCode)


def languages(spark: SparkSession) -> DataFrame:
    """(language, extensions, functions, classes, imports): what the reader knows of each language."""
    by: dict[str, list[str]] = {}
    for e, language in code.EXTENSIONS.items():
        by.setdefault(language, []).append(e)
    rows = [(x, sorted(es), x in code._FUNCTIONS, code._pattern("c", x) is not None, x in code._IMPORTS) for x, es in sorted(by.items())]
    return spark.createDataFrame(rows, "language string, extensions array<string>, functions boolean, classes boolean, imports boolean")

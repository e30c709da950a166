"""Files of a folder tree: listing with ignore rules, size guard, hashes, contents."""

from __future__ import annotations

import os
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import extract as X

#: Folders that are never read.
STATE_DIRS = (".git", ".weftgraph")
IGNORE_FILES = (".gitignore", ".weftgraphignore")


def ignore_pattern(rule: str, base: str = "") -> tuple[re.Pattern, bool] | None:
    """(pattern over relative paths, negated) of one line of an ignore file; None for blanks and comments.

    `*` and `?` stay within a part, `**` crosses parts, a leading or inner `/` anchors at the folder of the file,
    a trailing `/` means folders (and so all below them).
    """
    rule = rule.rstrip("\n").rstrip()
    if not rule or rule.startswith("#"):
        return None
    negated = rule.startswith("!")
    rule = rule[1:] if negated else rule
    folder = rule.endswith("/")
    rule = rule.rstrip("/")
    anchored = "/" in rule
    rule = rule.lstrip("/")
    out, i = "", 0
    while i < len(rule):
        if rule.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif rule.startswith("**", i):
            out, i = out + ".*", i + 2
        elif rule[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif rule[i] == "?":
            out, i = out + "[^/]", i + 1
        elif rule[i] == "[" and "]" in rule[i:]:
            end = rule.index("]", i)
            body = rule[i + 1 : end]
            out, i = out + "[" + ("^" + body[1:] if body[:1] == "!" else body) + "]", end + 1
        else:
            out, i = out + re.escape(rule[i]), i + 1
    prefix = re.escape(base) + ("" if anchored else "(?:.*/)?")
    return re.compile(f"^{prefix}{out}{'/.*' if folder else '(?:/.*)?'}$"), negated


def is_excluded(path: str, rules: list[tuple[re.Pattern, bool]]) -> bool:
    """Whether the last rule that fits a relative path excludes it."""
    for pattern, negated in reversed(rules):
        if pattern.match(path):
            return not negated
    return False


def listing(root: str) -> list[tuple[str, int]]:
    """(relative path, size) of the files below a local root that no ignore rule excludes; hidden files included, sorted.

    Later rules win over earlier ones, and rules of a folder over those above it. Links that leave the root are
    not followed.
    """
    root = os.path.realpath(root)
    rules: list[tuple[re.Pattern, bool]] = []
    out = []
    for folder, dirs, names in os.walk(root):
        dirs[:] = sorted(d for d in dirs if d not in STATE_DIRS)
        base = os.path.relpath(folder, root).replace("\\", "/")
        base = "" if base == "." else base + "/"
        for name in IGNORE_FILES:
            if name in names:
                with open(os.path.join(folder, name), encoding="utf-8", errors="replace") as f:
                    rules += [p for line in f if (p := ignore_pattern(line, base))]
        for name in sorted(names):
            path = base + name
            full = os.path.join(folder, name)
            if not is_excluded(path, rules) and os.path.realpath(full).startswith(root + os.sep):
                out.append((path, os.path.getsize(full)))
    return out


def detect_uri(spark: SparkSession, root: str, paper_text: Callable[[bytes], str] | None = None) -> DataFrame:
    """As `detect`, for a folder in any file system that Spark reads (hdfs://, s3a://, file:// ...).

    Names and sizes come from the file source, which leaves hidden files out; contents are read by the executors only
    for files that are taken. The driver looks for ignore files in the folders that hold files, and sees nothing else.
    """
    at = spark._jvm.org.apache.hadoop.fs.Path
    fs = at(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    base = fs.makeQualified(at(root)).toString().rstrip("/") + "/"
    start = len(re.sub(r"^(\w+:)/+", r"\1/", base)) + 1
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    # the source writes file:/x or file:///x
    raw = raw.withColumn("p", F.regexp_replace("path", r"^(\w+:)/+", "$1/")).withColumn("file_path", F.expr(f"substring(p, {start})"))
    folders = {""}
    for r in raw.select(F.regexp_extract("file_path", "^(.*)/[^/]*$", 1).alias("f")).distinct().toLocalIterator():
        parts = r["f"].split("/")
        folders |= {"/".join(parts[: k + 1]) for k in range(len(parts))}
    rules: list[tuple[re.Pattern, bool]] = []
    for folder in sorted(folders, key=lambda f: (f.count("/") + bool(f), f)):
        prefix = folder + "/" if folder else ""
        for name in IGNORE_FILES:
            file = at(base + prefix + name)
            if fs.exists(file):
                stream = fs.open(file)
                text = bytes(stream.readAllBytes()).decode("utf-8", "replace")
                stream.close()
                rules += [p for row in text.split("\n") if (p := ignore_pattern(row, prefix))]

    @F.pandas_udf("boolean")
    def kept(paths: pd.Series) -> pd.Series:
        return paths.map(lambda x: not is_excluded(x, rules) and not any(d in STATE_DIRS for d in x.split("/")[:-1]))

    found = raw.select("file_path", F.col("length").alias("size_bytes"), "content")
    found = found.withColumns({"file_type": X.file_type("file_path"), "language": X.language("file_path")})
    found = found.where(F.col("file_type").isNotNull() & (X.size_verdict("file_path", "size_bytes") == "ok"))
    text = F.when(F.col("file_type").isin("code", "document"), F.make_valid_utf8(F.col("content").cast("string")))
    if paper_text is not None:

        @F.pandas_udf("string")
        def paper(bodies: pd.Series) -> pd.Series:
            def one(body):
                try:
                    return paper_text(bytes(body))
                except Exception:  # one broken paper must not end the job
                    return None

            return bodies.map(one)

        text = F.when(F.col("file_type") == "paper", paper("content")).otherwise(text)
    return found.where(kept("file_path")).select("file_path", "size_bytes", "file_type", "language", F.sha2("content", 256).alias("content_hash"), text.alias("content"))


def detect(spark: SparkSession, root: str, paper_text: Callable[[bytes], str] | None = None) -> DataFrame:
    """(file_path, file_type, language, size_bytes, content_hash, content) of the readable files of a tree.

    A root with a scheme is read by the file source of Spark, see `detect_uri`. Sizes are judged before contents are read; text is decoded as UTF-8 with replacement; other kinds have a null
    content, papers only if no `paper_text` is given that turns their bytes into text (a paper it fails on has none).
    Contents are read and hashed by the executors, which must see the folder.
    """
    if "://" in root:
        return detect_uri(spark, root, paper_text)
    rows = [(p, n) for p, n in listing(root)]
    files = spark.createDataFrame(rows, "file_path string, size_bytes long") if rows else spark.createDataFrame([], "file_path string, size_bytes long")
    files = files.withColumns({"file_type": X.file_type("file_path"), "language": X.language("file_path")})
    files = files.where(F.col("file_type").isNotNull() & (X.size_verdict("file_path", "size_bytes") == "ok"))
    base = os.path.realpath(root)
    schema = "file_path string, size_bytes long, file_type string, language string, content_hash string, content string"
    n = max(1, min(len(rows) // 50, 512))

    def text_of(data):
        try:
            return paper_text and paper_text(data)
        except Exception:  # one broken paper must not end the job
            return None

    def read(batches):
        import hashlib

        for pdf in batches:
            hashes, contents = [], []
            for p, kind in zip(pdf["file_path"], pdf["file_type"]):
                with open(os.path.join(base, p), "rb") as f:
                    data = f.read()
                hashes.append(hashlib.sha256(data).hexdigest())
                contents.append(data.decode("utf-8", "replace") if kind in ("code", "document") else text_of(data) if kind == "paper" else None)
            yield pdf.assign(content_hash=hashes, content=contents)

    return files.repartition(n).mapInPandas(read, schema)

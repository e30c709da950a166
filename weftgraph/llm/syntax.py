"""Source files that do not parse.

Each file is tokenised and parsed whole by the generalised LR parser of its language (see `glr`, `grammars`,
`lexers`); the first error that cannot be recovered is reported. Parsing is a narrow map stage without a shuffle;
only verdicts (path and line) meet the manifest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import norm_path
from . import lexers
from .arrow import map_rows

_KNOWN = "(?i)\\.(" + "|".join(lexers.EXTENSIONS) + ")$"


def parse_files(contents: DataFrame, invalid_only: bool = False) -> DataFrame:
    """(file_path, language, error_line) of every file with a bundled grammar; error_line is null if it parses.

    Null paths or texts are skipped, a text of white space parses, rows delivered twice give one row each, very
    long texts are parsed whole. `invalid_only` drops the files that parse before they leave the worker.
    """

    def make():
        def one(path, text):
            parser = lexers.for_path(path)
            line = parser.check(text)
            if line is not None or not invalid_only:
                yield path, parser.name, line

        return one

    df = contents.select(norm_path("file_path").alias("file_path"), "content").where(
        F.col("file_path").rlike(_KNOWN) & F.col("content").isNotNull()
    )
    return map_rows(df, "file_path string, language string, error_line int", make)


def code_paths(manifest: DataFrame) -> DataFrame:
    """(file_path, repo) of the code files of the manifest, each path once; the greatest repo name on ties."""
    return (
        manifest.where("file_type = 'code' and file_path is not null")
        .select(norm_path("file_path").alias("file_path"), "repo")
        .groupBy("file_path")
        .agg(F.max("repo").alias("repo"))
    )


def invalid_files(contents: DataFrame, manifest: DataFrame) -> DataFrame:
    """(file_path, language, error_line) of code files of the manifest that do not parse, each once."""
    bad = parse_files(contents, True).groupBy("file_path", "language").agg(F.min("error_line").alias("error_line"))
    return bad.join(code_paths(manifest).select("file_path"), "file_path", "left_semi")


def rates(contents: DataFrame, manifest: DataFrame) -> DataFrame:
    """(repo, language, n_files, n_invalid, invalid_rate) over the code files that have a text."""
    files = parse_files(contents).groupBy("file_path", "language").agg(F.max(F.col("error_line").isNotNull().cast("int")).alias("bad"))
    return (
        files.join(code_paths(manifest), "file_path")
        .groupBy("repo", "language")
        .agg(F.count("*").alias("n_files"), F.sum("bad").alias("n_invalid"), F.round(F.avg("bad"), 6).alias("invalid_rate"))
    )

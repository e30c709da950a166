"""Enrichment of files by a language model behind a backend; the default backend finds nothing."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.extract import salvage_json
from ..schemas import SEMANTIC


class Backend(Protocol):
    def ask(self, path: str, text: str) -> str:
        """The answer for one file: text that holds a JSON object with nodes and edges."""


class Noop:
    def ask(self, path: str, text: str) -> str:
        return '{"nodes": [], "edges": []}'


class Retrying:
    """Wraps a request function: up to `tries` attempts with doubling pauses after a transient error: one of the given
    types without a status, or one with the status 429 or 500 and above (attribute `status` or `code`)."""

    def __init__(self, send: Callable[[str], str], tries: int = 3, pause: float = 0.5, transient: tuple[type[Exception], ...] = (OSError,)):
        self.send, self.tries, self.pause, self.transient = send, tries, pause, transient

    def ask(self, path: str, text: str) -> str:
        prompt = (
            "List the concepts of this file and how they relate. Answer with one JSON object "
            '{"nodes": [{"id", "label", "summary", "node_type"}], "edges": [{"source", "target", "relation"}]}.\n'
            f"File: {path}\n{text}"
        )
        for k in range(self.tries):
            try:
                return self.send(prompt)
            except Exception as e:
                status = getattr(e, "status", None) or getattr(e, "code", None)
                passing = status == 429 or status >= 500 if isinstance(status, int) else isinstance(e, self.transient)
                if not passing or k + 1 == self.tries:
                    raise
                time.sleep(self.pause * 2**k)
        return json.dumps({"nodes": [], "edges": []})


def enrich(files: DataFrame, backend: Backend | None = None, pause: float = 0.0) -> DataFrame:
    """(file_path, nodes, edges) of files (file_path, content); failing files are left out, null texts too.

    Requests run in the partitions of `files`, one at a time with `pause` seconds between them, so the number of
    partitions sets the rate.
    """
    backend = backend or Noop()

    def stage(batches):
        import pandas as pd

        for pdf in batches:
            paths, answers = [], []
            for p, t in zip(pdf["file_path"], pdf["content"]):
                try:
                    answers.append(backend.ask(p, t))
                    paths.append(p)
                except Exception:  # a file that cannot be enriched stays without
                    pass
                time.sleep(pause)
            yield pd.DataFrame({"file_path": paths, "content": answers}, dtype=object)

    answers = files.select("file_path", "content").where("content is not null").mapInPandas(stage, "file_path string, content string")
    x = answers.select("file_path", F.from_json(salvage_json("content"), SEMANTIC).alias("x"))
    return x.where("x is not null").select("file_path", "x.nodes", "x.edges")

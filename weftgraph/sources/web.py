"""Pages and papers behind URLs. The fetch itself is a parameter; everything around it is columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import extract as X

#: Fixed value: bytes of a download that are taken at most.
MAX_DOWNLOAD = 50 * 1024 * 1024


def allowed(urls: DataFrame) -> DataFrame:
    """URLs with scheme http or https whose host is not private; adds host, file_name and is_pdf."""
    u = urls.withColumns({"host": X.url_host("url"), "file_name": X.url_filename("url"), "is_pdf": X.is_pdf_url("url")})
    return u.where(F.lower("url").rlike("^https?://") & ~X.is_private_host("host"))


def download(urls: DataFrame, get: Callable[[str], bytes]) -> DataFrame:
    """(url, file_name, is_pdf, body) of the allowed URLs; `get` returns the bytes of one URL and runs on the executors.

    Bodies beyond MAX_DOWNLOAD and failing URLs give a null body.
    """

    def stage(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for url in pdf["url"]:
                try:
                    body = get(url)
                    out.append(body if len(body) <= MAX_DOWNLOAD else None)
                except Exception:  # one bad URL must not end the job
                    out.append(None)
            columns = {c: list(pdf[c]) for c in ("url", "file_name", "is_pdf")}
            yield pd.DataFrame(columns | {"body": out}, dtype=object)

    return allowed(urls).select("url", "file_name", "is_pdf").mapInPandas(stage, "url string, file_name string, is_pdf boolean, body binary")


def fetch(urls: DataFrame, get: Callable[[str], bytes]) -> DataFrame:
    """(url, file_name, text) of the allowed URLs. Pages become plain text, other bodies stay; see `download`."""
    got = download(urls, get).withColumn("body", F.make_valid_utf8(F.col("body").cast("string")))
    return got.select("url", "file_name", F.when(X.looks_like_html("body"), X.html_to_text("body")).otherwise(F.col("body")).alias("text"))


def ingest(urls: DataFrame, get: Callable[[str], bytes], folder: str) -> list[tuple[str, str]]:
    """Save what is behind the allowed URLs into `folder`, which all executors share: papers as they come, pages as
    text under the extension `.md`, anything else as it is. Returns (url, path) of the files that were written; of
    URLs with one file name the last one written stays."""
    text = F.make_valid_utf8(F.col("body").cast("string"))
    page = ~F.col("is_pdf") & X.looks_like_html(text)
    name = F.when(page, F.concat(F.regexp_replace("file_name", r"\.[^.]*$", ""), F.lit(".md"))).otherwise(F.col("file_name"))
    rows = download(urls, get).where("body is not null").select(
        "url", name.alias("name"), F.when(page, F.encode(X.html_to_text(text), "UTF-8")).otherwise(F.col("body")).alias("body")
    )

    def stage(batches):
        import os

        for pdf in batches:
            os.makedirs(folder, exist_ok=True)
            paths = []
            for n, body in zip(pdf["name"], pdf["body"]):
                paths.append(os.path.join(folder, n))
                with open(paths[-1], "wb") as f:
                    f.write(body)
            yield pdf[["url"]].assign(path=paths)

    return [tuple(r) for r in rows.mapInPandas(stage, "url string, path string").collect()]

"""Versioned Parquet tables: a write makes a new version beside the old one, a pointer file says which counts."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession


class Store:
    """Tables under a folder that all executors share. Readers of an older version are not disturbed."""

    def __init__(self, spark: SparkSession, folder: str, keep: int = 2):
        self.spark, self.folder, self.keep = spark, folder.rstrip("/"), keep
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.folder))

    def versions(self, name: str) -> list[int]:
        at = self._path(f"{self.folder}/{name}")
        if not self._fs.exists(at):
            return []
        return sorted(int(n[1:-5]) for s in self._fs.listStatus(at) if (n := s.getPath().getName()).startswith("v") and n.endswith(".done"))

    def read(self, name: str, schema: str | None = None) -> DataFrame:
        """The current version; an empty frame of `schema` if there is none yet."""
        v = self.versions(name)
        if v:
            return self.spark.read.parquet(f"{self.folder}/{name}/v{v[-1]}")
        if schema is None:
            raise FileNotFoundError(name)
        return self.spark.createDataFrame([], schema)

    def write(self, name: str, df: DataFrame) -> DataFrame:
        """Replace the table; the new version counts once it is complete."""
        n = (self.versions(name) or [0])[-1] + 1
        df.write.mode("overwrite").parquet(f"{self.folder}/{name}/v{n}")
        self._fs.create(self._path(f"{self.folder}/{name}/v{n}.done"), True).close()
        for old in self.versions(name)[: -self.keep]:
            for x in (f"v{old}.done", f"v{old}"):
                self._fs.delete(self._path(f"{self.folder}/{name}/{x}"), True)
        return self.read(name)

    def add(self, name: str, df: DataFrame) -> None:
        """Add rows to a log without rewriting it; read it by `log`."""
        df.write.mode("append").parquet(f"{self.folder}/{name}-log")

    def log(self, name: str, schema: str) -> DataFrame:
        at = f"{self.folder}/{name}-log"
        return self.spark.read.schema(schema).parquet(at) if self._fs.exists(self._path(at)) else self.spark.createDataFrame([], schema)

    def append(self, name: str, df: DataFrame, schema: str) -> DataFrame:
        return self.write(name, self.read(name, schema).unionByName(df))


def write_text(spark: SparkSession, path: str, parts: Iterable[str]) -> None:
    """One text file in any file system, written part by part."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    try:
        for part in parts:
            stream.write(bytearray(part.encode()))
    finally:
        stream.close()

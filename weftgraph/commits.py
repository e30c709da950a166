"""Numbered commit files that exactly one writer can create: the compare-and-swap of the stateful operators."""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import SparkSession

from .session import checkpoint_dir


class Folder:
    """A folder that all executors share, with commits `commits/<n>.json`, n from 1 without holes.

    Commit n is written whole under another name and then given its own, which fails if another writer has taken
    n: locally by a hard link, elsewhere by a rename that does not overwrite. The file system must do one of the
    two atomically, as local, network and Hadoop file systems do.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._p = spark._jvm.org.apache.hadoop.fs.Path
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._p(self.path).getFileSystem(self._conf)
        self._local = self._fs.getUri().getScheme() == "file"
        self._fs.mkdirs(self._p(f"{self.path}/commits"))

    def numbers(self) -> list[int]:
        names = [s.getPath().getName() for s in self._fs.listStatus(self._p(f"{self.path}/commits"))]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def read(self, n: int) -> dict:
        stream = self._fs.open(self._p(f"{self.path}/commits/{n}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def last(self) -> tuple[int, dict]:
        """The newest commit and its number; (0, {}) before the first."""
        n = (self.numbers() or [0])[-1]
        return n, self.read(n) if n else {}

    def commit(self, n: int, content: dict) -> bool:
        """Create commit n; False if it exists already."""
        data, temp, final = json.dumps(content).encode(), f"{self.path}/commits/{uuid.uuid4().hex}.tmp", f"{self.path}/commits/{n}.json"
        if self._local:
            temp, final = (self._p(x).toUri().getPath() for x in (temp, final))
            with open(temp, "wb") as f:
                f.write(data)
                f.flush()
                os.fsync(f.fileno())
            try:
                os.link(temp, final)
            except FileExistsError:
                return False
            finally:
                os.unlink(temp)
            return True
        stream = self._fs.create(self._p(temp), True)
        stream.write(bytearray(data))
        stream.close()
        jvm = self.spark._jvm
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf).rename(self._p(temp), self._p(final), none)
        except Exception as e:
            if "FileAlreadyExists" not in str(e):
                raise
            self.delete(f"commits/{temp.rpartition('/')[2]}")
            return False
        return True

    def delete(self, name: str) -> None:
        self._fs.delete(self._p(f"{self.path}/{name}"), True)

    def delete_at_exit(self) -> None:
        """Remove the whole folder when the driver ends; for state that one query needs."""
        self._fs.deleteOnExit(self._p(self.path))


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder beside the checkpoints, for the state of one query; it goes when the driver ends."""
    path = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path

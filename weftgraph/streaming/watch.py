"""Following changes: a file stream that triggers updates, and debounced event sessions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..commits import Folder
from ..functions import extract as X


def changed_files(spark: SparkSession, root: str) -> DataFrame:
    """A stream of (file_path, modified) of files that appear or change below a folder, of the known types."""
    layout = "path string, modificationTime timestamp, length long, content binary"
    raw = spark.readStream.format("binaryFile").schema(layout).option("recursiveFileLookup", "true").load(root)
    return raw.select(F.col("path").alias("file_path"), F.col("modificationTime").alias("modified")).where(X.file_type("path").isNotNull())


def watch(spark: SparkSession, root: str, update: Callable[[list[str]], None], state: str, interval: str = "3 seconds", once: bool = False) -> StreamingQuery:
    """Calls `update` with the distinct changed paths of each batch; an error in it is reported and the watch goes on.

    The trigger interval debounces: changes within it make one batch. `state` holds the stream's progress, so a
    restart neither skips nor repeats batches that were finished. The paths of a batch whose update failed are kept
    there too and go with the next batch, also after a restart.
    """
    failed = Folder(spark, f"{state}/failed")

    def batch(df: DataFrame, number: int) -> None:
        n, late = failed.last()
        paths = {r["file_path"] for r in df.select("file_path").distinct().toLocalIterator()} | set(late.get("paths", ()))
        if not paths:
            return
        try:
            update(sorted(paths))
            left = []
        except Exception as e:  # the watcher outlives a failing update
            print(f"batch {number}: {e}")
            left = sorted(paths)
        if left != late.get("paths", []):
            failed.commit(n + 1, {"paths": left})

    w = changed_files(spark, root).writeStream.foreachBatch(batch).option("checkpointLocation", f"{state}/progress")
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime=interval)).start()


def sessions(events: DataFrame, key: str, ts: str, gap: str, late: str) -> DataFrame:
    """(key, first_ts, end_ts, n): session windows of a stream; events later than the watermark are dropped."""
    return (
        events.withWatermark(ts, late)
        .groupBy(key, F.session_window(ts, gap).alias("w"))
        .agg(F.count("*").alias("n"))
        .select(key, F.col("w.start").alias("first_ts"), F.col("w.end").alias("end_ts"), "n")
    )

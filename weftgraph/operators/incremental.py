"""Processing only new or changed records.

Processed sequence numbers are kept as disjoint intervals. A run subtracts them from the available ranges,
processes the gaps (so late commits into an old gap are taken too) and commits the merged intervals together
with its output, in one rename of one small file.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..commits import Folder
from ..functions.scalars import instant_ms, norm_path
from . import intervals as iv


#: Sequence numbers per block. Intervals are kept, merged and probed block by block, so no step sees all of them.
BLOCK = 1 << 20
#: Commits after which the intervals of all blocks are written together again.
COMPACT = 32
#: Ranges of whole processed blocks that are cut from the scan of the source; the widest ones, the rest is probed.
PRUNED = 64


class IncrementalLog:
    """Exactly-once runs over a table with a sequence-number column.

    Each run writes to a folder of its own: `runs/<id>/input` (the records it takes), `runs/<id>/out` (its output)
    and `runs/<id>/intervals` (block, lo, hi: the processed intervals of the blocks that it touched, disjoint and
    merged within a block). `commits/<n>.json` names the run that counts as the n-th; it can be created once (see
    `commits.Folder`), so of two runs that start from the same state one is committed and the other raises, leaving
    nothing behind. A run that fails before its commit is named by none and its records are taken again. A record
    is identified by its number; numbers may arrive in any order. Null numbers are refused.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, Folder(spark, folder)

    def _runs(self) -> list[dict]:
        return [self.folder.read(n) for n in self.folder.numbers()]

    def _path(self, run: str, part: str) -> str:
        return f"{self.folder.path}/runs/{run}/{part}"

    def intervals(self) -> DataFrame:
        """(block, lo, hi) of all processed numbers: of each block the rows of the last commit that touched it."""
        runs = self._runs()
        since = max((k for k, r in enumerate(runs) if r.get("whole")), default=0)
        every = None
        for k, r in enumerate(runs[since:]):
            one = self.spark.read.schema("block long, lo long, hi long").parquet(self._path(r["run"], "intervals")).withColumn("_n", F.lit(k))
            every = one if every is None else every.unionByName(one)
        if every is None:
            return self.spark.createDataFrame([], "block long, lo long, hi long")
        if len(runs) - since == 1:
            return every.drop("_n")
        newest = every.groupBy("block").agg(F.max("_n").alias("_n"))
        return every.join(newest, ["block", "_n"], "left_semi").drop("_n")

    def processed(self) -> list[iv.Interval]:
        """The processed intervals merged across blocks, for looking at logs whose intervals are few."""
        return iv.merge((r["lo"], r["hi"]) for r in self.intervals().toLocalIterator())

    def pending(self, source: DataFrame, seq: str) -> list[iv.Interval]:
        """Ranges of the source, up to its highest number, that no commit covers; for looking, as `processed`."""
        lo, hi = source.agg(F.min(seq), F.max(seq)).first()
        return iv.subtract([] if lo is None else [(lo, hi)], self.processed())

    def _open_ranges(self, done: DataFrame, seq: str) -> Column:
        """False for numbers in the widest ranges of whole processed blocks; a condition that reaches the scan."""
        whole = done.groupBy("block").agg(F.sum(F.col("hi") - F.col("lo") + 1).alias("n")).where(F.col("n") == BLOCK)
        ranges = iv.merge_intervals(whole.select(F.col("block").alias("lo"), F.col("block").alias("hi")))
        keep = F.lit(True)
        for r in ranges.orderBy(F.desc(F.col("hi") - F.col("lo")), "lo").limit(PRUNED).collect():
            keep = keep & ((F.col(seq) < r["lo"] * BLOCK) | (F.col(seq) >= (r["hi"] + 1) * BLOCK))
        return keep

    def run(self, source: DataFrame, seq: str, process: Callable[[DataFrame], DataFrame]) -> int:
        """Process the records of the gaps and commit them with the output; the number of distinct numbers taken.

        Only numbers that were seen are committed, as runs of consecutive numbers, so that a record that
        arrives later with a number inside a hole is still taken by a later run. Whole processed ranges are cut
        from the scan, the other numbers are compared with the intervals of their block by one sort.
        """
        n, run = self.folder.last()[0] + 1, uuid.uuid4().hex
        if not source.where(F.col(seq).isNull()).isEmpty():
            raise ValueError(f"{seq} must not be null")
        done = self.intervals()
        rest = source.where(self._open_ranges(done, seq))
        asked = rest.select(F.col(seq).cast("long").alias("s")).distinct().withColumn("block", F.floor(F.col("s") / BLOCK))
        fresh = iv.covered(asked, "block", "s", done.select("block", F.col("lo").alias("_lo"), F.col("hi").alias("_hi"))).where("not _in")
        try:
            # the records of this run are fixed before anything is derived from them
            rest.join(fresh.select(F.col("s").alias(seq)), seq, "left_semi").write.parquet(self._path(run, "input"))
            taken = self.spark.read.schema(source.schema).parquet(self._path(run, "input"))
            seqs = taken.select(F.col(seq).cast("long").alias("s")).distinct().withColumn("block", F.floor(F.col("s") / BLOCK))
            runs = (
                seqs.withColumn("g", F.col("s") - F.row_number().over(W.partitionBy("block").orderBy("s")))
                .groupBy("block", "g")
                .agg(F.min("s").alias("lo"), F.max("s").alias("hi"))
                .drop("g")
            )
            whole = n % COMPACT == 0
            before = done if whole else done.join(runs.select("block").distinct(), "block", "left_semi")
            iv.merge_intervals(before.unionByName(runs), "block").write.parquet(self._path(run, "intervals"))
            count = seqs.count()
            if count:
                process(taken).write.parquet(self._path(run, "out"))
                if not self.folder.commit(n, {"run": run, "whole": whole}):
                    raise RuntimeError(f"commit {n} exists already: another run was quicker")
                self.folder.delete(f"runs/{run}/input")
            else:
                self.folder.delete(f"runs/{run}")
        except BaseException:
            self.folder.delete(f"runs/{run}")
            raise
        return count

    def output(self) -> DataFrame | None:
        """The union of all committed outputs; None before the first commit."""
        paths = [self._path(r["run"], "out") for r in self._runs()]
        return self.spark.read.parquet(*paths) if paths else None


def run_intervals(runs: DataFrame) -> DataFrame:
    """(lo, hi, completed): each run owns the instants (ms) from its start to just before the next start.

    Rows of one id are one run, completed if one of them says so; runs without a readable start are ignored;
    of runs that start together the last id owns the interval. `pipeline_runs` is a log of fixed size, so one
    ordered window is enough.
    """
    one = (
        runs.select("id", instant_ms("started_at").alias("lo"), (F.lower(F.trim("status")) == "completed").alias("c"))
        .where("lo is not null")
        .groupBy("id")
        .agg(F.min("lo").alias("lo"), F.max(F.coalesce("c", F.lit(False))).alias("completed"))
        .groupBy("lo")
        .agg(F.max_by("completed", "id").alias("completed"))
    )
    w = W.partitionBy(F.lit(0)).orderBy("lo")
    return one.select("lo", F.coalesce(F.lead("lo").over(w) - 1, F.lit(2**62)).alias("hi"), "completed")


def processed_intervals(runs: DataFrame) -> DataFrame:
    """Disjoint intervals (lo, hi) of instants whose work was committed."""
    return iv.merge_intervals(run_intervals(runs).where("completed").select("lo", "hi"))


def open_gaps(available: DataFrame, runs: DataFrame) -> DataFrame:
    """Disjoint intervals (lo, hi) of the instants, from the first to the last `t` of `available`, that no run has committed."""
    return iv.gaps(available.agg(F.min("t").alias("lo"), F.max("t").alias("hi")), processed_intervals(runs))


def latest(df: DataFrame, key: str, order: Column, *values: str) -> DataFrame:
    """One row per key, that of the greatest `order` (nulls lowest, ties by the values)."""
    s = F.struct(order.alias("_o"), *[F.col(v) for v in values])
    return df.groupBy(key).agg(F.max(s).alias("_m")).select(key, "_m._o", *[f"_m.{v}" for v in values])


def current_files(manifest: DataFrame) -> DataFrame:
    """(file_path, content_hash, file_type, seen_ms): the latest observation of each path."""
    m = manifest.select(
        norm_path("file_path").alias("file_path"),
        F.lower(F.trim("content_hash")).alias("content_hash"),
        "file_type",
        instant_ms("last_seen_at").alias("t"),
    ).where("file_path is not null")
    return latest(m, "file_path", F.coalesce("t", F.lit(-1)), "content_hash", "file_type").withColumnRenamed("_o", "seen_ms")


def extracted_files(cache: DataFrame, runs: DataFrame) -> DataFrame:
    """(file_path, extracted_hash): the latest cache row of each path among those outside the open gaps."""
    c = cache.select(
        norm_path("file_path").alias("file_path"),
        F.lower(F.trim("content_hash")).alias("extracted_hash"),
        instant_ms("extracted_at").alias("t"),
    ).where("file_path is not null and t is not null")
    c = iv.outside(c, F.col("t"), open_gaps(c, runs))
    return latest(c, "file_path", F.col("t"), "extracted_hash").drop("_o")


#: File types that the extractor takes.
EXTRACTABLE = ("code", "document", "paper")


def pending_files(manifest: DataFrame, cache: DataFrame, runs: DataFrame) -> DataFrame:
    """Files whose current content no completed run has extracted, each once: (file_path, content_hash).

    The sequence numbers are instants: a completed run has processed those from its start to the next start. What
    the processed intervals leave of the range of the cache are its gaps (failed and unfinished runs, and the time
    before the first); a cache row in a gap is not committed, so its file is taken again. A path with a null hash is
    pending; null paths are ignored; unreadable instants sort first; ties go to the greater hash; an empty
    manifest gives no rows. Extra columns are pruned.
    """
    now = current_files(manifest).where(F.col("file_type").isin(*EXTRACTABLE))
    done = extracted_files(cache, runs)
    return (
        now.join(done, "file_path", "left")
        .where(~F.col("content_hash").eqNullSafe(F.col("extracted_hash")) | F.col("content_hash").isNull())
        .select("file_path", "content_hash")
    )

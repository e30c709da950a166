"""What changed between full snapshots of a table.

A snapshot is kept as a bucketed index from key to the hash of the compared value. The next snapshot becomes an
index of the same buckets, and the two meet bucket by bucket without a shuffle; old values are fetched only for keys
whose hash differs; then the new index takes the old one's place.
"""

from __future__ import annotations

import hashlib
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..commits import Folder, scratch
from ..sources.tables import small

#: Keys with several values in one snapshot up to this many rows are broadcast to fetch those values.
MAX_BROADCAST = 100_000


def deliveries(df: DataFrame) -> list[tuple[int, object]]:
    """(snapshot_no, instant of its last delivery) in the order of the numbers; rows without a number are ignored.

    One pair per snapshot ever delivered reaches the driver, as the snapshots are taken one after the other.
    """
    last = df.where("snapshot_no is not null").groupBy("snapshot_no").agg(F.max("delivered_at").alias("at"))
    return sorted((r["snapshot_no"], r["at"]) for r in last.collect())


def last_deliveries(df: DataFrame, last: list[tuple[int, object]] | None = None) -> DataFrame:
    """Only rows of the last delivery of each snapshot number; one row per snapshot is broadcast."""
    last = deliveries(df) if last is None else last
    frame = df.sparkSession.createDataFrame(last, df.select("snapshot_no", F.col("delivered_at").alias("_at")).schema)
    return df.join(F.broadcast(frame), "snapshot_no").where(F.col("delivered_at").eqNullSafe(F.col("_at"))).drop("_at")


def key_hashes(rows: DataFrame) -> DataFrame:
    """(record_key, h) of one snapshot: rows (record_key, v), v the hash of the compared value; null keys are ignored.

    Lowest and highest hash of a key are found map-side, so repeated rows and hot keys cost nothing in the shuffle.
    Of keys that have one value, which is the normal case, h is its hash. The others are looked at again: h is then
    made of all their distinct hashes.
    """
    rows = rows.where("record_key is not null")
    ends = rows.groupBy("record_key").agg(F.min("v").alias("h"), F.max("v").alias("_top"))
    return ends.select("record_key", "h", (F.col("h") != F.col("_top")).alias("_several"))


def _several(rows: DataFrame, index: DataFrame) -> DataFrame:
    """(record_key, all_hashes) of the keys of the index with several values: the xor of their distinct mixed hashes."""
    keys = small(index.where("_several").select("record_key"), MAX_BROADCAST)
    distinct = rows.join(keys, "record_key", "left_semi").select("record_key", "v").distinct()
    return distinct.groupBy("record_key").agg(F.bit_xor(F.xxhash64("v", F.lit(7))).alias("_all"))


class SnapshotIndex:
    """The index of the last snapshot of a table, kept in `folder`.

    `indexes/<id>` is a bucketed Parquet table (record_key, h); commit n (see `commits.Folder`) says which one is
    current and is created once: of two writers that compare with the same index one swaps it and the other raises.
    The index that was replaced is removed once the changes are written. `buckets` is fixed by the first snapshot and
    defaults to the shuffle partitions of the session; it should keep a bucket within the memory of a task.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int | None = None):
        self.spark, self.folder = spark, Folder(spark, folder)
        self.buckets = buckets

    def _table(self, name: str, buckets: int) -> DataFrame:
        """The bucketed table, entered into the catalog of this session if another one wrote it."""
        full, path = self._name(name), f"{self.folder.path}/indexes/{name}"
        if not self.spark.catalog.tableExists(full):
            self.spark.sql(
                f"CREATE TABLE {full} (record_key STRING, h BIGINT, _several BOOLEAN) USING parquet "
                f"CLUSTERED BY (record_key) SORTED BY (record_key) INTO {buckets} BUCKETS LOCATION '{path}'"
            )
        return self.spark.table(full)

    def _name(self, name: str) -> str:
        return f"snapshot_index_{hashlib.md5(self.folder.path.encode(), usedforsecurity=False).hexdigest()[:8]}_{name}"

    def current(self) -> DataFrame | None:
        """(record_key, h) of the last snapshot; None before the first."""
        n, state = self.folder.last()
        return self._table(state["index"], state["buckets"]).select("record_key", "h") if n else None

    def write(self, rows: DataFrame, name: str, buckets: int) -> DataFrame:
        """Write the index of a snapshot (record_key, v): one shuffle by key, counted down before it."""
        index, path = key_hashes(rows), f"{self.folder.path}/indexes/{name}"

        def save(df, to, at):
            df.write.format("parquet").bucketBy(buckets, "record_key").sortBy("record_key").option("path", at).mode("overwrite").saveAsTable(to)

        save(index, self._name(name), path)
        written = self.spark.table(self._name(name))
        if not written.where("_several").isEmpty():
            whole = written.join(_several(rows, written), "record_key", "left")
            save(whole.select("record_key", F.coalesce("_all", "h").alias("h"), "_several"), self._name(f"{name}s"), f"{path}s")
            self._drop(name)
            return f"{name}s"
        return name

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self._name(name)}")
        self.folder.delete(f"indexes/{name}")

    @staticmethod
    def compare(old: DataFrame, new: DataFrame) -> DataFrame:
        """(record_key, change) between two indexes of the same buckets; a join without a shuffle."""
        both = old.select("record_key", F.col("h").alias("_old")).join(new.select("record_key", F.col("h").alias("_new")), "record_key", "full_outer")
        change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(F.col("_old") != F.col("_new"), "changed")
        return both.select("record_key", change.alias("change")).where("change is not null")

    def advance(self, rows: DataFrame, label: int | None = None) -> DataFrame:
        """(record_key, change) of a new full snapshot, rows (record_key, v), against the last; the index is swapped.

        Everything is `added` at first. The changes are written before the swap, so they can be read after the old
        index is gone. `label` is kept with the commit (the snapshot's number).
        """
        n, state = self.folder.last()
        buckets = state.get("buckets") or self.buckets or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        name = uuid.uuid4().hex[:12]
        name = self.write(rows, name, buckets)
        new = self._table(name, buckets)
        old = self._table(state["index"], buckets) if n else new.limit(0)
        changes = f"{self.folder.path}/changes/{name}"
        self.compare(old, new).write.parquet(changes)
        if not self.folder.commit(n + 1, {"index": name, "buckets": buckets, "label": label}):
            self._drop(name)
            self.folder.delete(f"changes/{name}")
            raise RuntimeError("the index was swapped by another writer")
        if n:
            self._drop(state["index"])
        return self.spark.read.schema("record_key string, change string").parquet(changes)


def pruned(df: DataFrame, key: Column, value: Column) -> DataFrame:
    """Only what a comparison needs, so that no other column of the table can clash with the names used here."""
    return df.select("snapshot_no", "delivered_at", key.alias("record_key"), value.alias("compared"))


def staged(df: DataFrame, key: Column, value: Column) -> tuple[list[tuple[int, object]], DataFrame]:
    """The deliveries and the rows (snapshot_no, record_key, v) of the last ones, written by snapshot_no in one scan."""
    rows = pruned(df, key, value)
    last = deliveries(rows)
    if not last:
        return last, rows
    kept = last_deliveries(rows, last)
    path = scratch(df.sparkSession, "snapshots")
    kept.select("snapshot_no", "record_key", F.coalesce(F.xxhash64("compared"), F.lit(0)).alias("v")).write.partitionBy("snapshot_no").parquet(path)
    return last, df.sparkSession.read.schema("record_key string, v long, snapshot_no int").parquet(path)


def snapshot_changes(df: DataFrame, key: Column, value: Column) -> DataFrame:
    """(snapshot_no, record_key, change) of a table of full snapshots (columns snapshot_no, delivered_at).

    The snapshots are taken one after the other through a `SnapshotIndex`: each row is moved once, into its bucket.
    Absent numbers are skipped: a snapshot is compared with the existing one before it. Of deliveries of one number
    the last counts. Null keys are ignored; a table with one snapshot or none gives no rows; a null value differs
    from every text; a key with several values in a snapshot is changed if the set of them is another.
    """
    spark = df.sparkSession
    last, rows = staged(df, key, value)
    index = SnapshotIndex(spark, scratch(spark, "index"))
    out = spark.createDataFrame([], "snapshot_no int, record_key string, change string")
    for k, (number, _) in enumerate(last):
        found = index.advance(rows.where(F.col("snapshot_no") == number).select("record_key", "v"), number)
        if k:
            out = out.unionByName(found.select(F.lit(number).alias("snapshot_no"), "record_key", "change"))
    return out


def each(*jobs) -> list:
    """Run independent chains of snapshots side by side; the driver only waits for them."""
    with ThreadPoolExecutor(len(jobs)) as pool:
        return [f.result() for f in [pool.submit(j) for j in jobs]]


def changed_values(df: DataFrame, changes: DataFrame, key: Column, value: Column) -> DataFrame:
    """Old and new value of each key that is `changed`: (snapshot_no, record_key, old_value, new_value).

    Values are fetched only for keys in `changes`: these are sent along with the number of their snapshot and of the
    one before, broadcast while they are few enough; only rows that match are aggregated. Of several values of a key
    the greatest is shown.
    """
    spark, rows = df.sparkSession, pruned(df, key, value)
    last = deliveries(rows)
    if len(last) < 2:
        return spark.createDataFrame([], "snapshot_no int, record_key string, old_value string, new_value string")
    sides = [(b[0], x[0], x[1], x is b) for a, b in zip(last, last[1:]) for x in (a, b)]  # of one snapshot: its own rows and those before
    kind = rows.select(F.col("snapshot_no").alias("at"), "snapshot_no", F.col("delivered_at").alias("_at"), F.lit(True).alias("_new")).schema
    asked = changes.where("change = 'changed'").select(F.col("snapshot_no").alias("at"), "record_key")
    asked = asked.join(F.broadcast(spark.createDataFrame(sides, kind)), "at")  # two rows per snapshot
    hit = rows.join(small(asked, MAX_BROADCAST), ["snapshot_no", "record_key"]).where(F.col("delivered_at").eqNullSafe(F.col("_at")))
    side = lambda new: F.max(F.when(F.col("_new") == new, F.col("compared")))
    return hit.groupBy(F.col("at").alias("snapshot_no"), "record_key").agg(side(False).alias("old_value"), side(True).alias("new_value"))

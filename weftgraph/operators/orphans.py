"""References to records that do not exist.

State: a parent index (the rows of each key, live or deleted) and the pending orphans (references whose parent is
missing, deleted or late). A batch of new references probes the index; arriving parents resolve waiting orphans,
deletions reopen references. `OrphanStore` keeps the state on disk from batch to batch.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..commits import Folder, scratch
from ..session import materialize
from ..sources.tables import small

#: Bad keys up to this many, with this many bytes in all, are broadcast to the references; more meet them by a shuffle.
MAX_BROADCAST, MAX_BYTES = 200_000, 32 << 20
#: References of a key from which it counts as hot; hot keys never go through a shuffle of references.
HOT = 1_000_000

REFS = "edge_id long, endpoint string, key string, loaded_at timestamp"
ROWS = "key string, loaded_at timestamp, live boolean"


def references(edges: DataFrame) -> DataFrame:
    """(edge_id, endpoint, key, loaded_at): both endpoints of each edge; null endpoints count as empty ids."""
    ends = F.explode(
        F.array(
            *[
                F.struct(F.lit(e).alias("endpoint"), F.coalesce(F.trim(F.col(e)), F.lit("")).alias("key"))
                for e in ("source", "target")
            ]
        )
    )
    return edges.select(F.col("id").alias("edge_id"), "loaded_at", ends.alias("e")).select(
        "edge_id", "e.endpoint", "e.key", "loaded_at"
    )


def parent_rows(nodes: DataFrame) -> DataFrame:
    """(key, loaded_at, live): the rows of each id, those of one instant as one; null and empty ids are ignored."""
    return (
        nodes.select(F.trim("id").alias("key"), "loaded_at", F.col("deleted_at").isNull().alias("live"))
        .where("key is not null and key <> ''")
        .groupBy("key", "loaded_at")
        .agg(F.max("live").alias("live"))
    )


def parent_index(nodes: DataFrame) -> DataFrame:
    """(key, first_loaded, live): one row per id; live tells whether a row without deleted_at exists."""
    rows = nodes.select(F.trim("id").alias("key"), "loaded_at", F.col("deleted_at").isNull().alias("live"))
    return summary(rows.where("key is not null and key <> ''"))


def summary(rows: DataFrame) -> DataFrame:
    """(key, first_loaded, live) of the rows (key, loaded_at, live) of each key; counted down before the shuffle."""
    return rows.groupBy("key").agg(F.min("loaded_at").alias("first_loaded"), F.max("live").alias("live"))


def probe(refs: DataFrame, index: DataFrame) -> DataFrame:
    """The orphans among refs: (edge_id, endpoint, key, loaded_at, reason), distinct.

    First the references are counted down to one row per key (map-side, so hot keys cost nothing) and meet the
    index, unique on both sides. What is left, written once, are bad keys (missing, deleted, or loaded after their
    first reference) and hot ones. Few bad keys are sent to the references, which then are not shuffled; of many,
    the hot keys still are, and only references of other keys meet the states by a shuffle.
    """
    keys = refs.groupBy("key").agg(F.min("loaded_at").alias("first_ref"), F.count("*").alias("n"))
    reason = F.when(F.col("live").isNull(), "missing").when(~F.col("live"), "deleted")
    bad = F.col("reason").isNotNull() | F.coalesce(F.col("first_loaded") > F.col("first_ref"), F.lit(False))
    states = materialize(
        keys.join(index, "key", "left")
        .select("key", reason.alias("reason"), "first_loaded", (F.col("n") >= HOT).alias("hot"), "first_ref")
        .withColumn("bad", bad)
        .where("bad or hot")
        .drop("first_ref")
    )
    n, size = states.where("bad").agg(F.count("*"), F.coalesce(F.sum(F.octet_length("key")), F.lit(0))).first()
    if n <= MAX_BROADCAST and size <= MAX_BYTES:
        hit = refs.join(F.broadcast(states.where("bad").drop("hot", "bad")), "key")
    else:
        hot = small(states.where("hot"), MAX_BROADCAST)  # at most one per HOT references
        marked = refs.join(hot, "key", "left")
        others = marked.where("hot is null").select(*refs.columns)
        hit = marked.where("bad").drop("hot", "bad").unionByName(others.join(states.where("bad and not hot").drop("hot", "bad"), "key"))
    late = F.when(F.col("first_loaded") > F.col("loaded_at"), "late")
    return hit.withColumn("reason", F.coalesce("reason", late)).where("reason is not null").select("edge_id", "endpoint", "key", "loaded_at", "reason").distinct()


class OrphanStore:
    """The state after each batch, in `folder`.

    A batch appends its references (`refs/<id>`) and its node rows (`rows/<id>`), and writes the pending orphans
    anew (`pending/<id>`) with their counts per month (`counts/<id>`); commit n (see `commits.Folder`) names the
    batch, so a batch that fails, or loses against another writer, leaves the state as it was.

    A node row is identified by id and loaded_at. Delivered again it takes the place of the earlier one, so that a
    row delivered with deleted_at deletes just that row: an id is deleted when none of its rows is live. Older or
    newer rows of an id, deleted or not, add to it. Edges and rows delivered twice change nothing.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, Folder(spark, folder)

    def _batches(self) -> list[str]:
        return [self.folder.read(n)["batch"] for n in self.folder.numbers()]

    def _read(self, part: str, schema: str, batches: list[str]) -> DataFrame:
        if not batches:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.folder.path}/{part}/{b}" for b in batches])

    def pending(self) -> DataFrame:
        """(edge_id, endpoint, key, loaded_at, reason) of the references that wait for a live, timely parent."""
        return self._read("pending", REFS + ", reason string", self._batches()[-1:])

    def live(self) -> DataFrame:
        """(edge_id, endpoint, key, loaded_at) of the references that have one; each once."""
        refs = self._read("refs", REFS, self._batches()).distinct()
        return refs.join(self.pending().select("edge_id", "endpoint", "key"), ["edge_id", "endpoint", "key"], "left_anti")

    def index(self, batches: list[str] | None = None) -> DataFrame:
        """(key, first_loaded, live) over all batches; of a row delivered again the last delivery counts."""
        batches = self._batches() if batches is None else batches
        every = None
        for k, b in enumerate(batches):
            one = self._read("rows", ROWS, [b]).withColumn("_n", F.lit(k))
            every = one if every is None else every.unionByName(one)
        if every is None:
            return summary(self._read("rows", ROWS, []))
        rows = every.groupBy("key", "loaded_at").agg(F.max_by("live", "_n").alias("live"))
        return summary(rows)

    def counts(self) -> DataFrame:
        """(batch, table_name, month, endpoint, reason, n): the counts that were taken after each batch."""
        out = None
        for k, b in enumerate(self._batches(), 1):
            one = self.spark.read.schema("table_name string, month string, endpoint string, reason string, n long").parquet(f"{self.folder.path}/counts/{b}")
            one = one.withColumn("batch", F.lit(k))
            out = one if out is None else out.unionByName(one)
        return out

    def advance(self, edges: DataFrame, nodes: DataFrame) -> DataFrame:
        """The pending orphans after a batch of edges (id, source, target, loaded_at) and of node rows (id, loaded_at,
        deleted_at), which may arrive in any order.

        New references probe the index. Waiting orphans probe it again only if the batch touches their key, and so do
        earlier references of a key that the batch leaves without a live row. Nulls: a null endpoint is an empty id
        and missing; a null id of a node is ignored; a null loaded_at is never late. Empty batches change nothing.
        """
        before, batch = self._batches(), uuid.uuid4().hex[:12]
        at = lambda part: f"{self.folder.path}/{part}/{batch}"
        references(edges).write.parquet(at("refs"))
        parent_rows(nodes).write.parquet(at("rows"))
        touched = self._read("rows", ROWS, [batch]).select("key").distinct()
        index = self.index([*before, batch])
        ask = self._read("refs", REFS, [batch])
        keep = None
        if before and not touched.isEmpty():
            waiting = self._read("pending", REFS + ", reason string", before[-1:])
            keep = waiting.join(touched, "key", "left_anti")
            ask = ask.unionByName(waiting.join(touched, "key", "left_semi").drop("reason"))
            dead = materialize(index.where("not live").join(touched, "key", "left_semi").select("key"))
            if not dead.isEmpty():
                ask = ask.unionByName(self._read("refs", REFS, before).join(small(dead, MAX_BROADCAST), "key", "left_semi"))
        elif before:
            keep = self._read("pending", REFS + ", reason string", before[-1:])
        found = probe(ask, index)
        (found if keep is None else keep.unionByName(found).distinct()).write.parquet(at("pending"))
        pending = self._read("pending", REFS + ", reason string", [batch])
        counts(pending).write.parquet(at("counts"))
        if not self.folder.commit(len(before) + 1, {"batch": batch}):
            for part in ("refs", "rows", "pending", "counts"):
                self.folder.delete(f"{part}/{batch}")
            raise RuntimeError("another batch was quicker")
        for old in before[-1:]:
            self.folder.delete(f"pending/{old}")
        return pending


def orphans(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(edge_id, endpoint, key, loaded_at, reason) of all references without a live, timely parent: the pending
    orphans after one batch of everything. Nulls and repeats as in `OrphanStore.advance`."""
    return probe(references(edges), parent_index(nodes))


def fold_months(edges: DataFrame, nodes: DataFrame) -> OrphanStore:
    """A store that was given edges and nodes month by month of loaded_at (rows without one come first).

    Both tables are written by month once, so that each batch reads its own part; months are few.
    """
    spark = edges.sparkSession
    month = F.coalesce(F.date_format("loaded_at", "yyyy-MM"), F.lit("0000-00"))
    paths, months = [], set()
    for df, columns in ((edges, ("id", "source", "target", "loaded_at")), (nodes, ("id", "loaded_at", "deleted_at"))):
        paths.append((scratch(spark, "months"), df.select(*columns).schema))
        df.select(*columns, month.alias("_month")).write.partitionBy("_month").parquet(paths[-1][0])
        months |= {r[0] for r in df.select(month.alias("m")).distinct().collect()}
    store = OrphanStore(spark, scratch(spark, "orphans"))
    parts = [spark.read.schema(schema.add("_month", "string")).parquet(p) for p, schema in paths]
    for m in sorted(months):
        store.advance(*[p.where(F.col("_month") == m).drop("_month") for p in parts])
    return store


def counts(pending: DataFrame, table: str = "edges") -> DataFrame:
    """A snapshot of the pending orphans per table, month of loaded_at, endpoint and reason."""
    return pending.groupBy(
        F.lit(table).alias("table_name"), F.date_format("loaded_at", "yyyy-MM").alias("month"), "endpoint", "reason"
    ).agg(F.count("*").alias("n"))

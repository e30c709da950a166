"""Building the graph from extractions: change detection, cache look-ups, upserts, symbol resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.extract import target_id


def changes(old: DataFrame, new: DataFrame, key: str = "file_path", value: str = "content_hash") -> DataFrame:
    """(key, status): new, changed, unchanged or removed, by one full outer join of two keyed frames."""
    a = old.select(key, F.col(value).alias("_old"), F.lit(1).alias("_a"))
    b = new.select(key, F.col(value).alias("_new"), F.lit(1).alias("_b"))
    status = (
        F.when(F.col("_a").isNull(), "new").when(F.col("_b").isNull(), "removed").when(F.col("_old").eqNullSafe(F.col("_new")), "unchanged").otherwise("changed")
    )
    return a.join(b, key, "full_outer").select(key, status.alias("status"))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of new, and rows of old whose key new lacks."""
    return new.unionByName(old.join(new.select(key), key, "left_anti"))


def cache_probe(files: DataFrame, cache: DataFrame) -> DataFrame:
    """(file_path, content_hash, hit): whether the cache holds this very version of the file."""
    known = cache.select("file_path", "content_hash").distinct().withColumn("_hit", F.lit(True))
    return files.join(known, ["file_path", "content_hash"], "left").select("file_path", "content_hash", F.coalesce("_hit", F.lit(False)).alias("hit"))


def first_wins(df: DataFrame, key: str, *order: Column | str) -> DataFrame:
    """One row per key, the first by `order` (nulls first as in any ascending sort)."""
    rest = [c for c in df.columns if c != key]
    packed = F.struct(*[F.col(o) if isinstance(o, str) else o for o in order], F.struct(*rest).alias("_row"))
    return df.groupBy(key).agg(F.min(packed).alias("_m")).select(key, *[f"_m._row.{c}" for c in rest])


def drop_files(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without those of the files in `gone` (file_path) and without edges that touch their nodes."""
    files = gone.select(F.col("file_path").alias("source_file"))
    lost = nodes.join(files, "source_file", "left_semi").select("id")
    left = edges.join(files, "source_file", "left_anti")
    for end in ("source", "target"):
        left = left.join(lost.withColumnRenamed("id", end), end, "left_anti")
    return nodes.join(files, "source_file", "left_anti"), left


def replace_by_file(nodes: DataFrame, batch: DataFrame) -> DataFrame:
    """Nodes after the files of `batch` (id, label, source_file, source_line) were extracted again.

    Old nodes of these files go; within the batch the first file wins an id; ids that stay elsewhere win over the
    batch, except stubs, which real nodes replace.
    """
    keep = nodes.join(batch.select("source_file").distinct(), "source_file", "left_anti").select("id", "label", "source_file", "source_line", "file_type")
    fresh = first_wins(batch.select("id", "label", "source_file", "source_line"), "id", "source_file", "source_line", "label").withColumn("file_type", F.lit("code"))
    real = keep.where("file_type <> 'stub'")
    fresh = fresh.join(real.select("id"), "id", "left_anti")
    stubs = keep.where("file_type = 'stub'").join(fresh.select("id"), "id", "left_anti")
    return real.unionByName(stubs).unionByName(fresh)


def symbol_dictionary(nodes: DataFrame) -> DataFrame:
    """(key, id): the last id (by file, line, id) with a label, else the first id whose last part is the key."""
    pos = F.struct("source_file", F.coalesce("source_line", F.lit(0)).alias("source_line"), "id")
    real = nodes.where("file_type <> 'stub'")
    rows = real.select(target_id("label").alias("key"), pos.alias("l"), F.lit(None).cast("struct<source_file:string,source_line:int,id:string>").alias("s")).where("instr(label, '(') = 0")
    parts = real.select(target_id(F.element_at(F.split("id", "::"), -1)).alias("key"), F.lit(None).cast("struct<source_file:string,source_line:int,id:string>").alias("l"), pos.alias("s"))
    both = rows.unionByName(parts).where("key <> ''").groupBy("key").agg(F.max("l").alias("l"), F.min("s").alias("s"))
    return both.select("key", F.coalesce("l.id", "s.id").alias("id"))


def resolve(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Calls and imports with the target replaced by the id its name stands for; a guess that resolves becomes
    EXTRACTED 0.9. Targets that are ids already, and names that nothing has, stay as they are.

    Names are counted down to one row each before they meet the ids and the dictionary, so no hot name takes part in
    these joins; the edges then meet the answers once, on the name they carry (AQE splits a hot one).
    """
    named = edges.where(F.col("relation").isin("calls", "imports"))
    rest = edges.where(~F.col("relation").isin("calls", "imports"))
    d = symbol_dictionary(nodes).withColumnRenamed("id", "real_id")
    known = nodes.select(F.col("id").alias("target"))
    names = named.select("target").distinct().join(known, "target", "left_anti")
    names = names.withColumn("key", target_id(F.element_at(F.split("target", "::"), -1))).join(d, "key").select("target", "real_id")
    j = named.join(names, "target", "left")
    hit = F.col("real_id").isNotNull()
    better = hit & (F.col("confidence") == "INFERRED")
    out = j.select(
        "id", "source", F.when(hit, F.col("real_id")).otherwise(F.col("target")).alias("target"), "relation",
        F.when(better, "EXTRACTED").otherwise(F.col("confidence")).alias("confidence"),
        F.when(better, 0.9).otherwise(F.col("confidence_score")).alias("confidence_score"),
    )
    return out.unionByName(rest.select(*out.columns))


def debounce(events: DataFrame, key: str, ts: str, gap_seconds: float) -> DataFrame:
    """(key, session, first_ts, last_ts, n): runs of events with no pause longer than the gap, per key."""
    from pyspark.sql import Window as W

    w = W.partitionBy(key).orderBy(ts)
    pause = F.timestamp_diff("MICROSECOND", F.lag(ts).over(w), F.col(ts))
    marked = events.select(key, F.col(ts).alias("_t"), F.coalesce((pause > int(gap_seconds * 1e6)).cast("int"), F.lit(1)).alias("_new"))
    run = W.partitionBy(key).orderBy("_t").rangeBetween(W.unboundedPreceding, W.currentRow)
    return (
        marked.withColumn("session", F.sum("_new").over(run))
        .groupBy(key, "session")
        .agg(F.min("_t").alias("first_ts"), F.max("_t").alias("last_ts"), F.count("*").alias("n"))
    )

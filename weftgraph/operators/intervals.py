"""Disjoint intervals of sequence numbers (closed on both ends) as DataFrames and as Python lists.

Columns are `lo` and `hi` (long). Rows with a null end or with lo > hi are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

Interval = tuple[int, int]


def merge(intervals: Iterable[Interval]) -> list[Interval]:
    """Sorted disjoint intervals that cover the same numbers; touching ones become one."""
    out: list[Interval] = []
    for lo, hi in sorted(x for x in intervals if x[0] <= x[1]):
        if out and lo <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], hi))
        else:
            out.append((lo, hi))
    return out


def subtract(available: Iterable[Interval], processed: Iterable[Interval]) -> list[Interval]:
    """The parts of `available` that `processed` does not cover."""
    gaps: list[Interval] = []
    done = merge(processed)
    for lo, hi in merge(available):
        for a, b in done:
            if b < lo or a > hi:
                continue
            if a > lo:
                gaps.append((lo, a - 1))
            lo = b + 1
            if lo > hi:
                break
        if lo <= hi:
            gaps.append((lo, hi))
    return gaps


def merge_intervals(df: DataFrame, *keys: str) -> DataFrame:
    """Disjoint intervals per key set: a new one begins where lo lies beyond every earlier hi + 1."""
    by = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    before = by.orderBy("lo", "hi").rowsBetween(W.unboundedPreceding, -1)
    upto = by.orderBy("lo", "hi").rowsBetween(W.unboundedPreceding, 0)
    fresh = F.coalesce(F.col("lo") > F.max("hi").over(before) + 1, F.lit(True)).cast("int")
    return (
        df.where("lo <= hi")
        .select(*keys, "lo", "hi", fresh.alias("_fresh"))
        .withColumn("_island", F.sum("_fresh").over(upto))
        .groupBy(*keys, "_island")
        .agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        .drop("_island")
    )


def gaps(available: DataFrame, processed: DataFrame) -> DataFrame:
    """`available` minus `processed`, both disjoint interval frames without keys: (lo, hi) of what is left.

    Every end point becomes an event; a running sum of opened minus closed intervals of either kind tells
    whether the stretch up to the next event is available and unprocessed.
    """
    events = None
    for frame, a, p in ((available, 1, 0), (processed, 0, 1)):
        frame = frame.where("lo <= hi")
        for at, sign in (("lo", 1), ("hi", -1)):
            e = frame.select(
                (F.col(at) if sign > 0 else F.col(at) + 1).alias("at"),
                F.lit(a * sign).alias("a"),
                F.lit(p * sign).alias("p"),
            )
            events = e if events is None else events.unionAll(e)
    steps = events.groupBy("at").agg(F.sum("a").alias("a"), F.sum("p").alias("p"))
    w = W.partitionBy(F.lit(0)).orderBy("at")
    open_ = steps.select(
        F.col("at").alias("lo"),
        (F.lead("at").over(w) - 1).alias("hi"),
        F.sum("a").over(w).alias("a"),
        F.sum("p").over(w).alias("p"),
    )
    return merge_intervals(open_.where("a > 0 and p = 0 and hi is not null").select("lo", "hi"))


#: Intervals up to this many are broadcast; more meet the rows by a shuffle.
MAX_BROADCAST = 100_000
#: Pieces of intervals in one bucket up to which a row is compared with each of them.
CROWD = 64


def _meet(df: DataFrame, seq: Column, intervals: DataFrame, how: str) -> DataFrame:
    rows = df.withColumn("_seq", seq.cast("long")).where("_seq is not null")
    real = intervals.where("lo <= hi").select("lo", "hi")
    few = real.limit(MAX_BROADCAST + 1).collect()
    if len(few) <= MAX_BROADCAST:  # derived once; the small jobs below read what came
        real = df.sparkSession.createDataFrame(few, "lo long, hi long")
    b = real.agg(F.min("lo").alias("first"), F.max("lo").alias("last"), F.count("*").alias("n")).first()
    if not b["n"]:
        return (rows if how == "left_anti" else rows.limit(0)).drop("_seq")
    width = (b["last"] - b["first"]) // b["n"] + 1
    top = b["last"] // width + 1  # beyond the last start there is one interval at most: one bucket for all of it
    bucket = lambda c: F.least(F.floor(c / width), F.lit(top))
    pieces = real.select(F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), F.explode(F.sequence(bucket(F.col("lo")), bucket(F.col("hi")))).alias("_b"))
    rows = rows.withColumn("_b", bucket(F.col("_seq")))
    crowd = pieces.groupBy("_b").count().agg(F.max("count")).first()[0]
    if crowd <= CROWD:
        if b["n"] <= MAX_BROADCAST:
            pieces = F.broadcast(pieces)  # at most two pieces an interval and two more
        pieces = pieces.withColumnRenamed("_b", "_c")
        return rows.join(pieces, (F.col("_b") == F.col("_c")) & F.col("_seq").between(F.col("_lo"), F.col("_hi")), how).drop("_b", "_seq")
    hit = covered(rows.select("_b", "_seq").distinct(), "_b", "_seq", pieces.select("_b", "_lo", "_hi"))
    return rows.join(hit.where("_in").select("_seq"), "_seq", how).drop("_b", "_seq")


def covered(numbers: DataFrame, bucket: str, seq: str, pieces: DataFrame) -> DataFrame:
    """numbers (bucket, seq; distinct) with `_in`: whether seq lies in an interval of its bucket.

    pieces: (bucket, _lo, _hi), disjoint. Starts and numbers are sorted together per bucket and each number looks
    back to the last start, so the work is that of a sort, however many intervals a bucket has.
    """
    starts = pieces.select(bucket, F.col("_lo").alias(seq), "_hi", F.lit(0).alias("_kind"))
    both = starts.unionByName(numbers.select(bucket, seq, F.lit(None).cast("long").alias("_hi"), F.lit(1).alias("_kind")))
    w = W.partitionBy(bucket).orderBy(seq, "_kind").rowsBetween(W.unboundedPreceding, W.currentRow)
    hi = F.last("_hi", ignorenulls=True).over(w)
    return both.withColumn("_in", F.coalesce(F.col(seq) <= hi, F.lit(False))).where("_kind = 1").select(bucket, seq, "_in")


def within(df: DataFrame, seq: Column, intervals: DataFrame) -> DataFrame:
    """Rows of df whose number `seq` lies in one of the disjoint `intervals`; rows with a null number are dropped.

    A range join done as an equi-join: intervals are cut at the borders of buckets as wide as the average distance
    of their starts (all beyond the last start is one bucket, so an open end costs nothing), and rows meet only the
    intervals of their own bucket. Where starts are crowded, distinct numbers and starts are sorted together
    instead, so no bucket compares all of its rows with all of its intervals. Up to MAX_BROADCAST intervals come to
    the driver and go out again; small jobs over them choose the width and the way.
    """
    return _meet(df, seq, intervals, "left_semi")


def outside(df: DataFrame, seq: Column, intervals: DataFrame) -> DataFrame:
    """Rows of df whose number lies in none of the disjoint `intervals`; rows with a null number are dropped."""
    return _meet(df, seq, intervals, "left_anti")

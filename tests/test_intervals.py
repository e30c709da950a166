import random

from hypothesis import given
from hypothesis import strategies as st

from weftgraph.operators import intervals as iv
from pyspark.sql import functions as F

pairs = st.lists(st.tuples(st.integers(0, 40), st.integers(0, 40)).map(lambda t: (min(t), max(t))), max_size=12)


def numbers(intervals):
    return {n for lo, hi in intervals for n in range(lo, hi + 1)}


@given(pairs)
def test_merge_covers_the_same_numbers(xs):
    m = iv.merge(xs)
    assert numbers(m) == numbers(xs)
    assert all(a[1] + 1 < b[0] for a, b in zip(m, m[1:]))


@given(pairs, pairs)
def test_subtract(a, b):
    assert numbers(iv.subtract(a, b)) == numbers(a) - numbers(b)


def test_frames_agree_with_lists(spark):
    r = random.Random(3)
    for _ in range(3):
        a, b = ([(x, x + r.randint(0, 9)) for x in r.sample(range(100), 6)] for _ in range(2))
        fa, fb = (spark.createDataFrame(x, "lo long, hi long") for x in (a, b))
        assert sorted(map(tuple, iv.merge_intervals(fa).collect())) == iv.merge(a)
        got = sorted(map(tuple, iv.gaps(iv.merge_intervals(fa), iv.merge_intervals(fb)).collect()))
        assert got == iv.subtract(a, b)
        rows = spark.range(120).withColumn("lo", F.lit("clashes"))
        assert {x["id"] for x in iv.within(rows, F.col("id"), iv.merge_intervals(fa)).collect()} == numbers(a)


def test_merge_by_key_and_empty(spark):
    f = spark.createDataFrame([("x", 1, 2), ("x", 3, 5), ("y", 1, 1), ("y", 9, 8), (None, 1, 1)], "k string, lo long, hi long")
    assert sorted(map(tuple, iv.merge_intervals(f, "k").collect()), key=str) == sorted([("x", 1, 5), ("y", 1, 1), (None, 1, 1)], key=str)
    none = spark.createDataFrame([], "lo long, hi long")
    assert iv.merge_intervals(none).count() == 0 and iv.gaps(none, none).count() == 0
    assert iv.within(spark.range(3), F.col("id"), none).count() == 0


def test_within_and_outside_when_starts_are_crowded_or_the_end_is_open(spark):
    crowded = [(2 * i, 2 * i) for i in range(300)] + [(10**12, 2**62)]
    f = spark.createDataFrame(crowded, "lo long, hi long")
    rows = spark.createDataFrame([(x,) for x in (-1, 0, 1, 2, 598, 599, 10**12 - 1, 10**12, 2**61, None, 2, 2)], "n long")
    inside = [0, 2, 2, 2, 598, 10**12, 2**61]
    assert sorted(r["n"] for r in iv.within(rows, F.col("n"), f).collect()) == inside
    assert sorted(r["n"] for r in iv.outside(rows, F.col("n"), f).collect()) == [-1, 1, 599, 10**12 - 1]
    few = f.where("lo < 10 or lo > 1000")
    assert sorted(r["n"] for r in iv.within(rows, F.col("n"), few).collect()) == [0, 2, 2, 2, 10**12, 2**61]

import random
from datetime import datetime as T

from pyspark.sql import functions as F

from weftgraph.operators import incremental as inc
from weftgraph.operators import orphans as orp
from weftgraph.operators import snapshots as snap

M = "file_path string, content_hash string, file_type string, language string, last_seen_at string, size_bytes long, repo string, seen_ms string"
C = "file_path string, content_hash string, language string, nodes string, edges string, extracted_at string, t string"
P = "id long, started_at string, finished_at string, status string, lo string"


def pending(spark, m, c, p):
    m = spark.createDataFrame([(a, h, k, None, t, 1, "r", "x") for a, h, k, t in m], M)
    c = spark.createDataFrame([(a, h, "l", "[]", "[]", t, "x") for a, h, t in c], C)
    p = spark.createDataFrame([(i, s, None, st, "x") for i, s, st in p], P)
    return sorted(r["file_path"] for r in inc.pending_files(m, c, p).collect())


RUNS = [(1, "100", "completed"), (2, "200", "failed"), (3, "300", "completed"), (3, "300", "completed"), (4, None, "running"), (None, "900", "running")]


def test_pending_files(spark):
    m = [
        ("a\\x.py", "AA", "code", "50"), ("a/x.py", "old", "code", "40"),  # slashes, case of hashes
        ("b.py", "b", "code", "50"),  # extracted by a failed run only
        ("c.py", "c2", "code", "1970-01-01T00:02:00Z"), ("c.py", "c1", "code", " 110"),  # ISO is later
        ("d.md", "d", "document", "50"), ("d.md", "d", "document", "50"),  # never extracted, delivered twice
        ("e.png", "e", "image", "50"), (None, "n", "code", "50"), ("f.py", None, "code", "50"),
        ("g.py", "g", "code", "bad"),  # unreadable instant
        ("h.py", "h2", "code", "130000"), ("h.py", "h1", "code", "140000"),
    ]
    c = [
        ("a/x.py", "aa", "150"), ("b.py", "b", "250"), ("c.py", "c1", "150"), ("c.py", "c2", "250"),
        ("g.py", "G", "350"), ("h.py", "h1", "150"), ("h.py", "h1", "20"), ("f.py", None, "150"), (None, "z", "150"), ("b.py", "b", None),
    ]
    assert pending(spark, m, c, RUNS) == ["b.py", "c.py", "d.md", "f.py"]


def test_pending_ignores_rows_before_the_first_run_and_takes_the_latest(spark):
    m = [("a", "1", "code", "1"), ("b", "1", "code", "1")]
    assert pending(spark, m, [("a", "1", "99"), ("b", "1", "150"), ("b", "2", "199")], RUNS) == ["a", "b"]


def test_pending_of_empty_tables(spark):
    assert pending(spark, [], [], []) == []
    assert pending(spark, [("a", "1", "paper", "1")], [], []) == ["a"]


def test_log_takes_each_record_once_and_survives_failures(spark, tmp_path):
    log = inc.IncrementalLog(spark, f"file://{tmp_path}/log")
    def rows(xs):
        return spark.createDataFrame([(x, "v") for x in xs], "seq long, s string")  # a clashing name
    assert log.run(rows([1, 2, 3, 7]), "seq", lambda d: d) == 4
    def fails(d):
        raise RuntimeError("lost")
    try:
        log.run(rows([1, 2, 3, 7, 8]), "seq", fails)
        raise AssertionError
    except RuntimeError:
        pass
    assert log.processed() == [(1, 3), (7, 7)]
    assert log.run(rows([1, 2, 3, 5, 7, 8]), "seq", lambda d: d) == 2  # 5 is a late commit into a gap
    assert log.run(rows([1, 2, 3, 5, 7, 8]), "seq", lambda d: d) == 0
    assert sorted(r["seq"] for r in log.output().collect()) == [1, 2, 3, 5, 7, 8]
    assert log.processed() == [(1, 3), (5, 5), (7, 8)]
    assert log.pending(rows([1, 9]), "seq") == [(4, 4), (6, 6), (9, 9)]
    far = inc.BLOCK
    assert log.run(rows([far - 1, far, far + 1, 1]), "seq", lambda d: d) == 3  # across the border of a block
    assert log.processed()[-1] == (far - 1, far + 1) and log.run(rows([far]), "seq", lambda d: d) == 0


def test_log_refuses_nulls_and_takes_nothing_from_an_empty_table(spark, tmp_path):
    log = inc.IncrementalLog(spark, f"file://{tmp_path}/log")
    empty = spark.createDataFrame([], "seq long, block int")
    assert log.run(empty, "seq", lambda d: d) == 0 and log.output() is None
    try:
        log.run(spark.createDataFrame([(None,)], "seq long"), "seq", lambda d: d)
        raise AssertionError
    except ValueError:
        pass


E_ = "id long, source string, target string, loaded_at timestamp, key string, reason string"
N_ = "id string, loaded_at timestamp, deleted_at timestamp, key string"
D = [T(2026, 1, d) for d in range(1, 29)]


def graph(spark, e, n):
    e = spark.createDataFrame([(i, s, t, at, "x", "y") for i, s, t, at in e], E_)
    return e, spark.createDataFrame([(i, a, d, "z") for i, a, d in n], N_)


def found(df):
    return sorted((r["edge_id"], r["endpoint"], r["reason"]) for r in df.collect())


def test_orphans(spark):
    n = [("a", D[1], None), ("b", D[1], D[3]), ("c", D[1], D[2]), ("c", D[5], None), ("d", D[9], None), (None, D[1], None), ("", D[1], None), ("e", None, None)]
    e = [
        (1, " a ", "b", D[4]), (1, " a ", "b", D[4]), (2, "a", "x", D[4]), (3, "c", "d", D[4]), (4, None, "", D[4]), (5, "a", "d", D[9]), (6, "A", "e", D[4]), (7, "d", "d", None),
    ]
    got = found(orp.orphans(*graph(spark, e, n)))
    assert got == [
        (1, "target", "deleted"), (2, "target", "missing"), (3, "target", "late"), (4, "source", "missing"), (4, "target", "missing"), (6, "source", "missing"),
    ]


def test_orphans_hot_key_and_empty(spark):
    e = [(i, "a", "hot", D[1]) for i in range(500)]
    assert len(found(orp.orphans(*graph(spark, e, [("a", D[0], None)])))) == 500
    assert found(orp.orphans(*graph(spark, [], []))) == []
    assert len(found(orp.orphans(*graph(spark, e[:1], [])))) == 2


def test_orphans_incrementally(spark, tmp_path):
    store = orp.OrphanStore(spark, f"file://{tmp_path}/o")
    def batch(e, n):
        return found(store.advance(*graph(spark, e, n)))
    assert batch([(1, "a", "b", D[2]), (2, "a", "c", D[9])], [("a", D[1], None)]) == [(1, "target", "missing"), (2, "target", "missing")]
    assert batch([(3, "c", "a", D[9])], [("b", D[1], None), ("c", D[5], None)]) == []
    assert batch([], [("a", D[1], D[10])]) == [(1, "source", "deleted"), (2, "source", "deleted"), (3, "target", "deleted")]
    store = orp.OrphanStore(spark, f"file://{tmp_path}/o")  # another driver goes on
    assert batch([], [("a", D[12], None)]) == []
    assert batch([], [("a", D[0], D[3])]) == []  # an old deleted row arrives late; the one of D[12] is live
    assert batch([(1, "a", "b", D[2]), (1, "a", "b", D[2])], []) == [] and store.live().count() == 6  # delivered again
    assert batch([], [("a", D[12], D[13])]) == [(1, "source", "deleted"), (2, "source", "deleted"), (3, "target", "deleted")]
    assert sorted((r["batch"], r["n"]) for r in store.counts().groupBy("batch").agg(F.sum("n").alias("n")).collect()) == [(1, 2), (3, 3), (7, 3)]


def test_orphans_in_batches_equal_those_of_one_go(spark):
    r = random.Random(5)
    def when(none):
        return None if r.random() < none else T(2026, r.randint(1, 2), r.randint(1, 28))
    n = [(r.choice("abcde"), when(0.1), when(0.5)) for _ in range(14)]
    e = [(i, r.choice(" abcdefg"), r.choice("abcdefg"), when(0.1)) for i in range(40)]
    e, n = graph(spark, e, n)
    assert found(orp.fold_months(e, n).pending()) == found(orp.orphans(e, n)) != []


def test_orphans_of_many_bad_and_hot_keys(spark, monkeypatch):
    e = [(i, "a", "hot", D[1]) for i in range(30)] + [(100 + i, "cold", f"k{i}", D[1]) for i in range(3)]
    e, n = graph(spark, e, [("a", D[0], None), ("k1", D[0], None), ("k2", D[3], None)])
    want = found(orp.orphans(e, n))
    monkeypatch.setattr(orp, "MAX_BROADCAST", 1)
    monkeypatch.setattr(orp, "HOT", 20)
    assert found(orp.orphans(e, n)) == want and len(want) == 35


S_ = "snapshot_no int, delivered_at timestamp, id string, label string, step int, compared string"


def test_snapshots(spark):
    rows = [
        (1, D[1], "a", "A"), (1, D[1], "b", "B "), (1, D[1], "b", "B "), (1, D[1], "n", None),
        (3, D[3], "zz", "old delivery"), (3, D[4], "a", "A2"), (3, D[4], "b", " B"), (3, D[4], "c", "C"), (3, D[4], None, "x"), (3, D[4], "n", ""),
        (5, D[6], "c", "C"), (None, D[6], "q", "Q"),
    ]
    df = spark.createDataFrame([(*r, 9, "x") for r in rows], S_)
    got = sorted(map(tuple, snap.snapshot_changes(df, F.col("id"), F.trim("label")).collect()))
    assert got == [(3, "a", "changed"), (3, "c", "added"), (3, "n", "changed"), (5, "a", "removed"), (5, "b", "removed"), (5, "n", "removed")]
    v = snap.changed_values(df, snap.snapshot_changes(df, F.col("id"), F.trim("label")), F.col("id"), F.trim("label"))
    assert sorted(map(tuple, v.collect())) == [(3, "a", "A", "A2"), (3, "n", None, "")]
    assert snap.snapshot_changes(df.limit(0), F.col("id"), F.col("label")).count() == 0
    assert snap.snapshot_changes(df.where("snapshot_no = 1"), F.col("id"), F.col("label")).count() == 0


def hashed(spark, xs):
    return spark.createDataFrame(xs, "record_key string, label string").select("record_key", F.xxhash64("label").alias("v"))


def test_snapshot_index(spark, tmp_path):
    index = snap.SnapshotIndex(spark, f"file://{tmp_path}/i", buckets=4)
    def take(xs):
        return sorted(map(tuple, index.advance(hashed(spark, xs)).collect()))
    assert take([("a", "1"), ("b", "1")]) == [("a", "added"), ("b", "added")]
    assert take([("a", "2"), ("c", "1"), ("c", "1"), (None, "9")]) == [("a", "changed"), ("b", "removed"), ("c", "added")]
    index = snap.SnapshotIndex(spark, f"file://{tmp_path}/i")  # another reader of the folder
    assert take([("a", "2"), ("c", "1"), ("c", "2"), ("c", "3")]) == [("c", "changed")]
    assert take([("a", "2"), ("c", "3"), ("c", "1"), ("c", "2")]) == []
    assert take([("a", "2"), ("c", "1"), ("c", "4"), ("c", "3")]) == [("c", "changed")]  # the ends are the same or not: the set is another
    assert len(list((tmp_path / "i" / "indexes").iterdir())) == 1  # replaced indexes are gone


def test_snapshot_index_is_compared_without_a_shuffle(spark, tmp_path):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        index = snap.SnapshotIndex(spark, f"file://{tmp_path}/i", buckets=4)
        a, b = (index._table(index.write(hashed(spark, [("a", x)]), f"t{x}", 4), 4) for x in "12")
        plan = index.compare(a, b)._jdf.queryExecution().toString()
        assert "Exchange" not in plan and "Bucketed: true" in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_snapshot_index_has_one_winner(spark, tmp_path):
    a, b = (snap.SnapshotIndex(spark, f"file://{tmp_path}/i", buckets=2) for _ in range(2))
    a.advance(hashed(spark, [("a", "1")]))
    real, b.folder.last = b.folder.last, lambda: (0, {})  # b looked before a had swapped
    try:
        b.advance(hashed(spark, [("b", "1")]))
        raise AssertionError
    except RuntimeError:
        pass
    b.folder.last = real
    assert [r["record_key"] for r in b.current().collect()] == ["a"]


def test_log_has_one_winner(spark, tmp_path):
    first, second = (inc.IncrementalLog(spark, f"file://{tmp_path}/log") for _ in range(2))
    rows = spark.createDataFrame([(1, "v"), (2, "v")], "seq long, s string")
    def slow(taken):  # the other run commits while this one works
        assert first.run(rows, "seq", lambda d: d.withColumn("by", F.lit("first"))) == 2
        return taken.withColumn("by", F.lit("second"))
    try:
        second.run(rows, "seq", slow)
        raise AssertionError
    except RuntimeError:
        pass
    assert sorted(map(tuple, second.output().collect())) == [(1, "v", "first"), (2, "v", "first")]
    assert len(list((tmp_path / "log" / "runs").iterdir())) == 1 and second.run(rows, "seq", lambda d: d) == 0


def test_log_with_a_full_block_of_alternating_numbers(spark, tmp_path):
    log = inc.IncrementalLog(spark, f"file://{tmp_path}/log")
    n = 20_000
    assert log.run(spark.range(0, n, 2).withColumnRenamed("id", "seq"), "seq", lambda d: d) == n // 2
    assert log.run(spark.range(n).withColumnRenamed("id", "seq"), "seq", lambda d: d) == n // 2
    assert log.processed() == [(0, n - 1)]


def test_pending_when_the_last_run_is_completed(spark):
    runs = [(1, "100", "completed"), (2, "200", "failed"), (3, "300", "completed")]
    m = [("a", "1", "code", "1"), ("b", "1", "code", "1"), ("c", "1", "code", "1")]
    assert pending(spark, m, [("a", "1", "150"), ("b", "1", "250"), ("c", "1", "99999999")], runs) == ["b"]


def test_a_commit_is_created_once(spark, tmp_path):
    from weftgraph.commits import Folder

    for local in (True, False):  # by a hard link, and by a rename that does not overwrite
        f = Folder(spark, f"file://{tmp_path}/{local}")
        f._local = local
        assert f.last() == (0, {}) and f.commit(1, {"a": 1}) and not f.commit(1, {"a": 2}) and f.commit(2, {"a": 3})
        assert f.last() == (2, {"a": 3}) and f.read(1) == {"a": 1} and f.numbers() == [1, 2]
        assert not [x for x in (tmp_path / str(local) / "commits").iterdir() if x.suffix == ".tmp"]


def test_log_survives_a_crash_between_output_and_commit(spark, tmp_path, monkeypatch):
    log = inc.IncrementalLog(spark, f"file://{tmp_path}/log")
    rows = spark.createDataFrame([(1, "v"), (2, "v")], "seq long, s string")
    monkeypatch.setattr(log.folder, "commit", lambda n, c: (_ for _ in ()).throw(OSError("gone")))
    monkeypatch.setattr(log.folder, "delete", lambda name: None)  # a crash cleans nothing up
    try:
        log.run(rows, "seq", lambda d: d)
        raise AssertionError
    except OSError:
        pass
    again = inc.IncrementalLog(spark, f"file://{tmp_path}/log")
    assert again.output() is None and again.processed() == []
    assert again.run(rows, "seq", lambda d: d) == 2 and again.output().count() == 2

"""Queries of the record operators: p2 (new or changed), p3 (orphan references), p6 (snapshot changes)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..commits import scratch
from ..functions.scalars import instant_ms
from ..operators import incremental, orphans, snapshots
from ..sources.tables import table
from .registry import Registry

R = Registry()


def _ms(c: str) -> str:
    t = f"trim({c})"
    return (
        f"(CASE WHEN regexp_full_match({t}, '[0-9]{{1,11}}') THEN CAST({t} AS BIGINT) * 1000 "
        f"WHEN regexp_full_match({t}, '[0-9]{{12,14}}') THEN CAST({t} AS BIGINT) "
        f"ELSE epoch_ms(TRY_CAST(replace({t}, 'Z', '') AS TIMESTAMP)) END)"
    )


_RUNS = f"""
  one AS (SELECT id, min({_ms('started_at')}) lo, max(lower(trim(status)) = 'completed') c FROM pipeline_runs GROUP BY id),
  runs AS (SELECT lo, coalesce(lead(lo) OVER (ORDER BY lo) - 1, 4611686018427387904) hi, c FROM one)"""

_P2 = f"""
WITH {_RUNS},
  cur AS (SELECT replace(file_path, chr(92), '/') p, lower(trim(content_hash)) h, file_type, {_ms('last_seen_at')} t FROM file_manifest),
  now AS (SELECT p, h, file_type FROM cur QUALIFY row_number() OVER (PARTITION BY p ORDER BY coalesce(t, -1) DESC, h DESC, file_type DESC) = 1),
  c AS (SELECT replace(file_path, chr(92), '/') p, lower(trim(content_hash)) h, {_ms('extracted_at')} t FROM extraction_cache),
  done AS (SELECT c.p, c.h FROM c JOIN runs ON c.t BETWEEN runs.lo AND runs.hi AND runs.c
           QUALIFY row_number() OVER (PARTITION BY c.p ORDER BY c.t DESC, c.h DESC) = 1)
SELECT now.p AS file_path FROM now LEFT JOIN done ON now.p = done.p
WHERE now.file_type IN ('code', 'document', 'paper') AND (done.h IS NULL OR now.h IS NULL OR now.h <> done.h)"""


@R.query("p2_found", _P2)
def p2_found(spark, d):
    return incremental.pending_files(
        table(spark, d, "file_manifest", "file_path", "content_hash", "file_type", "last_seen_at"),
        table(spark, d, "extraction_cache", "file_path", "content_hash", "extracted_at"),
        table(spark, d, "pipeline_runs", "id", "started_at", "status"),
    ).select("file_path")


_ISLANDS = f"""
  {_RUNS[3:]},
  done AS (SELECT lo, hi FROM runs WHERE c),
  f AS (SELECT lo, hi, CASE WHEN lo <= max(hi) OVER (ORDER BY lo ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END n FROM done),
  g AS (SELECT lo, hi, sum(n) OVER (ORDER BY lo) i FROM f),
  merged AS (SELECT min(lo) lo, max(hi) hi FROM g GROUP BY i)"""


@R.query("p2_processed_intervals", f"WITH {_ISLANDS} SELECT lo, hi FROM merged")
def p2_processed_intervals(spark, d):
    return incremental.processed_intervals(table(spark, d, "pipeline_runs", "id", "started_at", "status"))


_AVAILABLE = f"(SELECT min({_ms('extracted_at')}) a, max({_ms('extracted_at')}) b FROM extraction_cache)"


@R.query(
    "p2_open_gaps",
    f"""WITH {_ISLANDS}, av AS {_AVAILABLE},
  m AS (SELECT greatest(lo, a) lo, least(hi, b) hi, a, b FROM merged, av WHERE hi >= a AND lo <= b),
  x AS (SELECT a - 1 AS hi0, b FROM av UNION ALL SELECT hi, b FROM m),
  s AS (SELECT a lo0 FROM av WHERE false UNION ALL SELECT lo FROM m UNION ALL SELECT b + 1 FROM av)
SELECT hi0 + 1 AS lo, (SELECT min(lo0) FROM s WHERE lo0 > hi0) - 1 AS hi FROM x
WHERE hi0 < b AND (SELECT min(lo0) FROM s WHERE lo0 > hi0) > hi0 + 1""",
)
def p2_open_gaps(spark, d):
    cache = table(spark, d, "extraction_cache", "extracted_at").select(instant_ms("extracted_at").alias("t"))
    return incremental.open_gaps(cache, table(spark, d, "pipeline_runs", "id", "started_at", "status"))


@R.query(
    "p2_edges_once",
    """SELECT id AS edge_id, count(*) AS n, CASE WHEN min(day) <= 10 THEN 1 WHEN min(day) <= 20 THEN 2 ELSE 3 END AS run
FROM (SELECT DISTINCT id, day(loaded_at) AS day FROM edges WHERE id IS NOT NULL) GROUP BY id""",
)
def p2_edges_once(spark, d):
    """Three runs over a growing table: numbers arrive late, in holes and twice; each is taken by one run only."""
    edges = table(spark, d, "edges", "id", "loaded_at").where("id is not null").select("id", F.dayofmonth("loaded_at").alias("day")).distinct()
    log = incremental.IncrementalLog(spark, scratch(spark, "p2"))
    for k, upto in enumerate((10, 20, 31), 1):
        log.run(edges.where(F.coalesce("day", F.lit(31)) <= upto), "id", lambda taken, k=k: taken.groupBy(F.col("id").alias("edge_id")).agg(F.count("*").alias("n"), F.lit(k).alias("run")))
    return log.output()


_P3 = """
WITH ref AS (SELECT id edge_id, 'source' endpoint, coalesce(trim(source), '') k, loaded_at t FROM edges
             UNION ALL SELECT id, 'target', coalesce(trim(target), ''), loaded_at FROM edges),
  par AS (SELECT trim(id) k, min(loaded_at) f, max(deleted_at IS NULL) live FROM nodes WHERE trim(id) <> '' GROUP BY 1),
  o AS (SELECT DISTINCT edge_id, endpoint, t, CASE WHEN par.k IS NULL THEN 'missing' WHEN NOT live THEN 'deleted' WHEN f > t THEN 'late' END reason
        FROM ref LEFT JOIN par USING (k))
"""


def _edges_nodes(spark, d):
    return (
        table(spark, d, "edges", "id", "source", "target", "loaded_at"),
        table(spark, d, "nodes", "id", "loaded_at", "deleted_at"),
    )


@R.query("p3_found", _P3 + "SELECT DISTINCT edge_id, endpoint, reason FROM o WHERE reason IS NOT NULL")
def p3_found(spark, d):
    return orphans.orphans(*_edges_nodes(spark, d)).select("edge_id", "endpoint", "reason").distinct()


@R.query("p3_folded", _P3 + "SELECT DISTINCT edge_id, endpoint, reason FROM o WHERE reason IS NOT NULL")
def p3_folded(spark, d):
    """As p3_found, from the stored state after one batch per month."""
    return orphans.fold_months(*_edges_nodes(spark, d)).pending().select("edge_id", "endpoint", "reason").distinct()


@R.query(
    "p3_orphans_by_month",
    _P3
    + """SELECT 'edges' AS table_name, strftime(t, '%Y-%m') AS "month", endpoint, reason, count(*) AS n FROM o
WHERE reason IS NOT NULL GROUP BY ALL""",
)
def p3_orphans_by_month(spark, d):
    return orphans.counts(orphans.orphans(*_edges_nodes(spark, d)))


_LAST = """{t}1 AS (SELECT * FROM {t} QUALIFY delivered_at IS NOT DISTINCT FROM max(delivered_at) OVER (PARTITION BY snapshot_no)),
  {t}2 AS (SELECT DISTINCT snapshot_no, {k} k, {v} v, dense_rank() OVER (ORDER BY snapshot_no) r FROM {t}1),
  {t}3 AS (SELECT '{t}' table_name, coalesce(a.r, b.r + 1) r, coalesce(a.k, b.k) record_key,
      CASE WHEN b.k IS NULL THEN 'added' WHEN a.k IS NULL THEN 'removed' WHEN a.v IS DISTINCT FROM b.v THEN 'changed' END change,
      b.v old_value, a.v new_value
    FROM {t}2 a FULL JOIN {t}2 b ON a.r = b.r + 1 AND a.k = b.k),
  {t}4 AS (SELECT table_name, n.snapshot_no, record_key, change, old_value, new_value FROM {t}3
    JOIN (SELECT DISTINCT r, snapshot_no FROM {t}2) n ON n.r = {t}3.r WHERE n.r > 1 AND change IS NOT NULL)"""
_P6 = (
    "WITH "
    + _LAST.format(t="node_snapshots", k="id", v="trim(label)")
    + ", "
    + _LAST.format(t="edge_snapshots", k="source || ' -> ' || target", v="relation")
)
_KEYS = {
    "node_snapshots": (lambda: F.col("id"), lambda: F.trim("label")),
    "edge_snapshots": (lambda: F.concat(F.col("source"), F.lit(" -> "), F.col("target")), lambda: F.col("relation")),
}
_COLUMNS = {
    "node_snapshots": ("snapshot_no", "delivered_at", "id", "label"),
    "edge_snapshots": ("snapshot_no", "delivered_at", "source", "target", "relation"),
}


def _both(make):
    a, b = snapshots.each(*[lambda t=t: make(t).withColumn("table_name", F.lit(t)) for t in _COLUMNS])
    return a.unionByName(b)


@R.query(
    "p6_found",
    _P6
    + """ SELECT table_name, snapshot_no, record_key, change FROM node_snapshots4
UNION ALL SELECT table_name, snapshot_no, record_key, change FROM edge_snapshots4""",
)
def p6_found(spark, d):
    def make(t):
        return snapshots.snapshot_changes(table(spark, d, t, *_COLUMNS[t]), _KEYS[t][0](), _KEYS[t][1]())

    return _both(make).select("table_name", "snapshot_no", "record_key", "change")


@R.query(
    "p6_changed_values",
    _P6
    + """ SELECT table_name, snapshot_no, record_key, old_value, new_value FROM node_snapshots4 WHERE change = 'changed'
UNION ALL SELECT table_name, snapshot_no, record_key, old_value, new_value FROM edge_snapshots4 WHERE change = 'changed'""",
)
def p6_changed_values(spark, d):
    def make(t):
        df, key, value = table(spark, d, t, *_COLUMNS[t]), _KEYS[t][0](), _KEYS[t][1]()
        return snapshots.changed_values(df, snapshots.snapshot_changes(df, key, value), key, value)

    return _both(make).select("table_name", "snapshot_no", "record_key", "old_value", "new_value")

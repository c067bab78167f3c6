"""Queries on snapshot deliveries (problem 3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.operators.snapshots import snapshot_changes
from siftline.runtime import read


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = snapshot_changes(read(spark, sf_dir, "file_snapshots"), read(spark, sf_dir, "scan_runs"))
    return changes.select("snapshot_id", "path", "change")


def p3_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = snapshot_changes(read(spark, sf_dir, "file_snapshots"), read(spark, sf_dir, "scan_runs"))
    return changes.groupBy("snapshot_id", "root", "change").agg(F.count("*").alias("n"))


_CHANGES = r"""
WITH runs AS (
  SELECT root, snapshot_id, lag(snapshot_id) OVER (PARTITION BY root ORDER BY snapshot_id) AS previous
  FROM scan_runs WHERE complete),
raw AS (
  SELECT snapshot_id, nfc_normalize(replace(path, chr(92), '/')) AS path, size_bytes, delivered_at,
         CAST(floor(modified_ts / CASE WHEN modified_ts >= 100000000000000000 THEN 1000000000.0
              WHEN modified_ts >= 100000000000000 THEN 1000000.0 WHEN modified_ts >= 100000000000 THEN 1000.0 ELSE 1.0 END) AS BIGINT) AS mtime
  FROM file_snapshots WHERE path IS NOT NULL),
rooted AS (
  SELECT r.*, s.root FROM raw r JOIN (SELECT DISTINCT root FROM scan_runs) s
    ON r.path = s.root OR starts_with(r.path, s.root || '/')
  QUALIFY row_number() OVER (PARTITION BY r.snapshot_id, r.path, r.delivered_at, r.mtime, r.size_bytes ORDER BY length(s.root) DESC) = 1),
latest AS (
  SELECT t.root, t.snapshot_id, t.path, t.mtime, t.size_bytes, runs.previous
  FROM rooted t JOIN runs ON runs.root = t.root AND runs.snapshot_id = t.snapshot_id
  QUALIFY row_number() OVER (PARTITION BY t.root, t.snapshot_id, t.path ORDER BY t.delivered_at DESC, t.mtime DESC, t.size_bytes DESC) = 1),
changes AS (
  SELECT n.snapshot_id, n.root, n.path, CASE WHEN o.path IS NULL THEN 'added' ELSE 'changed' END AS change
  FROM latest n LEFT JOIN latest o ON o.root = n.root AND o.path = n.path AND o.snapshot_id = n.previous
  WHERE n.previous IS NOT NULL AND (o.path IS NULL OR o.mtime IS DISTINCT FROM n.mtime OR o.size_bytes IS DISTINCT FROM n.size_bytes)
  UNION ALL
  SELECT r.snapshot_id, r.root, o.path, 'removed' FROM runs r JOIN latest o ON o.root = r.root AND o.snapshot_id = r.previous
  WHERE NOT EXISTS (SELECT 1 FROM latest n WHERE n.root = r.root AND n.snapshot_id = r.snapshot_id AND n.path = o.path))
"""

QUERIES = {"p3_found": p3_found, "p3_summary": p3_summary}
ORACLE = {
    "p3_found": _CHANGES + "SELECT snapshot_id, path, change FROM changes",
    "p3_summary": _CHANGES + "SELECT snapshot_id, root, change, count(*) AS n FROM changes GROUP BY ALL",
}

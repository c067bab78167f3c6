"""The engine's input tables as views of the test tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.functions import constants as K
from siftline.operators.fulltext import TextIndex, build_index
from siftline.operators.snapshots import whole_seconds
from siftline.functions.paths import parent_of
from siftline.operators.tables import latest
from siftline.runtime import read

#: The time all queries are seen from: 2024-02-01T00:00:00Z.
NOW = 1706745600


def files(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "files")
    return rows.select("path", "filename", F.lower("extension").alias("extension"), "size_bytes", "modified_ts", "is_dir", "created_ts")


def docs(spark: SparkSession, d: str) -> DataFrame:
    """The text of each path that was indexed last, of the kinds that are indexed; null texts are empty."""
    rows = read(spark, d, "content_index").filter("path is not null")
    last = latest(rows, "path", "indexed_at", "content_id")
    last = last.select("path", "filename", F.lower("extension").alias("extension"), F.coalesce("content", F.lit("")).alias("content"))
    return last.filter(F.col("extension").isin(K.CONTENT_EXTENSIONS))


_INDEXES: dict = {}


def index(spark: SparkSession, d: str) -> TextIndex:
    """The text index of the documents, built once a session and folder."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _INDEXES:
        _INDEXES[key] = build_index(docs(spark, d))
    return _INDEXES[key]


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return latest(read(spark, d, "semantic_vectors").filter("path is not null"), "path", "mtime", "vec_id").select("path", "vec_id", "vector", "mtime", "embed_hash")


def interactions(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "interactions").select("path", "action", "timestamp")


def ocr_status(spark: SparkSession, d: str) -> DataFrame:
    """One row per scanned path; the time it was read at is the file's, or a second earlier for files of odd size."""
    done = read(spark, d, "ocr_results").filter("path is not null").groupBy("path").agg(F.avg("confidence").alias("confidence"))
    times = files(spark, d).select("path", (F.col("modified_ts") - F.col("size_bytes") % 2).alias("modified_ts"))
    return done.join(times, "path").select("path", "modified_ts", F.lit(1).alias("ocr_done"), "confidence")


def changes(spark: SparkSession, d: str) -> DataFrame:
    """A change journal: what was done to files, as changes of them; of some, only that their directory must be scanned."""
    a = F.col("action")
    return read(spark, d, "interactions").filter("path is not null").select(
        F.col("id").alias("event_id"), F.when((a == "finder") & (F.col("id") % 3 == 0), parent_of(F.col("path"))).otherwise(F.col("path")).alias("path"), (a == "finder").alias("created"), a.isin("open", "copy").alias("modified"),
        (a == "trash").alias("removed"), (a == "preview").alias("renamed"), ((a == "finder") & (F.col("id") % 3 == 0)).alias("must_scan_dir"),
    )


def snapshot(spark: SparkSession, d: str, number: int) -> DataFrame:
    """A delivery as a listing: the row of each path that came last."""
    rows = read(spark, d, "file_snapshots").filter(F.col("snapshot_id") == number)
    rows = rows.select(
        F.regexp_replace("path", r"\\", "/").alias("path"), "filename", F.lower("extension").alias("extension"), "size_bytes",
        whole_seconds(F.col("modified_ts")).alias("modified_ts"), "is_dir", "created_ts", "delivered_at",
    )
    return latest(rows, "path", "delivered_at").drop("delivered_at")


def complete_roots(spark: SparkSession, d: str, number: int) -> DataFrame:
    return read(spark, d, "scan_runs").filter((F.col("snapshot_id") == number) & F.col("complete")).select("root")


def quoted(values) -> str:
    return ", ".join("'" + str(v).replace("'", "''") + "'" for v in values)


_SECONDS = """CAST(floor(modified_ts / CASE WHEN modified_ts >= 100000000000000000 THEN 1000000000.0 WHEN modified_ts >= 100000000000000 THEN 1000000.0
  WHEN modified_ts >= 100000000000 THEN 1000.0 ELSE 1.0 END) AS BIGINT)"""
_SNAPSHOT = """SELECT replace(path, chr(92), '/') AS path, filename, lower(extension) AS extension, size_bytes, %s AS modified_ts, is_dir, created_ts FROM file_snapshots
  WHERE snapshot_id = %d QUALIFY row_number() OVER (PARTITION BY replace(path, chr(92), '/') ORDER BY delivered_at DESC) = 1"""

#: The same views as common table expressions.
CTE = {
    "files_v": "SELECT path, filename, lower(extension) AS extension, size_bytes, modified_ts, is_dir, created_ts FROM files",
    "docs_v": f"""SELECT * FROM (SELECT path, filename, lower(extension) AS extension, coalesce(content, '') AS content FROM content_index WHERE path IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY path ORDER BY indexed_at DESC, content_id DESC) = 1) WHERE extension IN ({quoted(K.CONTENT_EXTENSIONS)})""",
    "vectors_v": "SELECT path, vec_id, vector, mtime, embed_hash FROM semantic_vectors WHERE path IS NOT NULL QUALIFY row_number() OVER (PARTITION BY path ORDER BY mtime DESC, vec_id DESC) = 1",
    "ocr_v": """SELECT o.path, f.modified_ts - f.size_bytes % 2 AS modified_ts, 1 AS ocr_done, o.confidence
  FROM (SELECT path, avg(confidence) AS confidence FROM ocr_results WHERE path IS NOT NULL GROUP BY path) o JOIN files f USING (path)""",
    "changes_v": """SELECT id AS event_id, CASE WHEN action = 'finder' AND id % 3 = 0 THEN regexp_replace(path, '/[^/]*$', '') ELSE path END AS path, action = 'finder' AS created, action IN ('open', 'copy') AS modified, action = 'trash' AS removed, action = 'preview' AS renamed,
  action = 'finder' AND id % 3 = 0 AS must_scan_dir FROM interactions WHERE path IS NOT NULL""",
    "scanned_v": _SNAPSHOT % (_SECONDS, 8),
    "indexed_v": _SNAPSHOT % (_SECONDS, 7),
    "roots_v": "SELECT DISTINCT root FROM scan_runs WHERE snapshot_id = 8 AND complete",
}


def sql(query: str, **more: str) -> str:
    """``query`` after the views it names, and more common table expressions, in order."""
    body = " ".join([query, *more.values()])
    used = {k: v for k, v in CTE.items() if k in body and k not in more} | more
    return ("WITH " + ",\n".join(f"{k} AS ({v})" for k, v in used.items()) + "\n" if used else "") + query

"""File trees as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.functions import constants as K
from siftline.functions.paths import excluded_default, excluded_for, extension_of, filename_of, parent_of

FILES = "path string, filename string, extension string, size_bytes long, modified_ts long, is_dir boolean, created_ts long"


def scan_tree(spark: SparkSession, roots: list[str], preset: str | None = None, max_depth: int = 20) -> DataFrame:
    """``files`` of the trees under ``roots``, directories included. Only names, times and lengths are read, never contents.

    Directories get the newest time of their files. Hidden files are kept; Hadoop's listing does not tell links from files.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(roots)
    rows = found.select(
        F.regexp_replace("path", r"^file:/*", "/").alias("path"), F.col("length").alias("size_bytes"), F.greatest(F.unix_seconds("modificationTime"), F.lit(0)).alias("modified_ts")
    )
    depth = min((r.rstrip("/").count("/") for r in roots), default=0)
    return scanned(rows, preset, depth + max_depth)


def scanned(rows: DataFrame, preset: str | None = None, max_slashes: int = 1 << 30) -> DataFrame:
    """The files table of a listing (path, size_bytes, modified_ts): excludes, size cap, derived names, and parent directories."""
    path = F.col("path")
    kept = rows.filter(~excluded_default(path) & ~excluded_for(path, preset) & (F.col("size_bytes") <= K.FILE_BYTES) & (F.length(F.regexp_replace(path, "[^/]", "")) <= max_slashes))
    files = kept.select("path", filename_of(path).alias("filename"), extension_of(path).alias("extension"), "size_bytes", "modified_ts", F.lit(False).alias("is_dir"), F.lit(0).cast("long").alias("created_ts"))
    dirs = files.groupBy(parent_of(path).alias("path")).agg(F.max("modified_ts").alias("modified_ts")).filter("path <> ''")
    dirs = dirs.select("path", filename_of(F.col("path")).alias("filename"), F.lit(None).cast("string").alias("extension"), F.lit(0).cast("long").alias("size_bytes"), "modified_ts", F.lit(True).alias("is_dir"), F.lit(0).cast("long").alias("created_ts"))
    return files.unionByName(dirs)


def scan_stats(files: DataFrame) -> DataFrame:
    return files.agg(
        F.count(F.when(~F.col("is_dir"), 1)).alias("files"), F.count(F.when(F.col("is_dir"), 1)).alias("dirs"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes")
    )


def dir_sizes(files: DataFrame) -> DataFrame:
    """(path, bytes, files): of every directory, with all that is below it."""
    parts = F.split("path", "/")
    above = F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/")))
    return files.filter("not is_dir").select(above.alias("path"), "size_bytes").filter("path <> ''").groupBy("path").agg(F.sum("size_bytes").alias("bytes"), F.count("*").alias("files"))

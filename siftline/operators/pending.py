"""Work that is still to be done, and how much is done."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.functions import constants as K
from siftline.functions.paths import unlike


def _pending(files: DataFrame, done: DataFrame, mtime: str, extensions: list[str]) -> DataFrame:
    had = done.select("path", F.col(mtime).alias("had"))
    eligible = files.filter(F.col("extension").isin(extensions) & unlike(F.col("path"), K.RECENT_EXCLUDED_PATHS))
    return eligible.join(had, "path", "left").filter("had is null or had <> modified_ts").select("path", "filename", "extension", "modified_ts")


def pending_ocr(files: DataFrame, ocr_status: DataFrame) -> DataFrame:
    """Images never read, or read at another modification time."""
    return _pending(files, ocr_status, "modified_ts", K.OCR_EXTENSIONS).select("path", "modified_ts")


def pending_embed(files: DataFrame, vectors: DataFrame) -> DataFrame:
    return _pending(files, vectors, "mtime", K.EMBED_EXTENSIONS)


def coverage(files: DataFrame, done: DataFrame, extensions: list[str]) -> DataFrame:
    """(total, completed): eligible files, and all rows done whether eligible or not."""
    total = files.filter(F.col("extension").isin(extensions)).agg(F.count("*").alias("total"))
    return total.crossJoin(done.agg(F.count("*").alias("completed")))  # one row each


def embed_skip(candidates: DataFrame, vectors: DataFrame) -> DataFrame:
    """(path, mtime, embed_hash, todo): ``embed`` where the hash is new, ``touch`` where only the time is."""
    had = vectors.select("path", F.col("embed_hash").alias("had"))
    return candidates.join(had, "path", "left").withColumn("todo", F.when(F.col("had") == F.col("embed_hash"), "touch").otherwise("embed")).drop("had")

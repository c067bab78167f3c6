"""Changes to keyed tables, made as new tables: upsert, delete, update, latest state, prune."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert(base: DataFrame, delta: DataFrame, key: str = "path") -> DataFrame:
    """``base`` with the rows of ``delta`` in place of those of the same keys (keys of ``delta`` are unique)."""
    return base.join(delta.select(key), key, "left_anti").unionByName(delta)


def delete(base: DataFrame, keys: DataFrame, key: str = "path") -> DataFrame:
    return base.join(keys.select(key), key, "left_anti")


def latest(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The row of each key that is last by ``order``; counted before the shuffle, so a hot key weighs little."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(key, *[F.col(f"r.`{c}`").alias(c) for c in rest])


def update_file(files: DataFrame, path: str, size: int, modified_ts: int) -> DataFrame:
    hit = F.col("path") == path
    return files.withColumn("size_bytes", F.when(hit, F.lit(size)).otherwise(F.col("size_bytes"))).withColumn("modified_ts", F.when(hit, F.lit(modified_ts)).otherwise(F.col("modified_ts")))


def touch(vectors: DataFrame, touched: DataFrame) -> DataFrame:
    """Vectors with the times of ``touched`` (path, mtime) where they have one."""
    new = touched.select("path", F.col("mtime").alias("new"))
    return vectors.join(new, "path", "left").withColumn("mtime", F.coalesce("new", "mtime")).drop("new")


def prune_interactions(interactions: DataFrame, now: int, days: int = 365) -> DataFrame:
    return interactions.filter(F.col("timestamp") >= now - days * 86400)

"""Recent files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.functions import constants as K
from siftline.functions.paths import under, unlike


def _newest(files: DataFrame, limit: int) -> DataFrame:
    return files.orderBy(F.desc("modified_ts"), "path").limit(limit)


def _shown(files: DataFrame) -> DataFrame:
    # files without extension drop out, as null is in no list
    return files.filter(~F.col("is_dir") & ~F.col("extension").isin(K.RECENT_EXCLUDED) & ~F.col("filename").startswith("."))


def recent_files(files: DataFrame, limit: int) -> DataFrame:
    return _newest(_shown(files).filter(unlike(F.col("path"), K.RECENT_EXCLUDED_PATHS)), limit)


def recent_scoped(files: DataFrame, limit: int, prefixes: list[str]) -> DataFrame:
    """The newest 1000 files first, of these the ones under the prefixes."""
    return _newest(_newest(_shown(files), 1000).filter(under(F.col("path"), prefixes)), limit)


def recent_raw(files: DataFrame, limit: int) -> DataFrame:
    return _newest(files.filter("not is_dir"), limit)

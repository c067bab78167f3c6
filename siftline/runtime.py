"""Session helpers: where intermediate tables go, and how lineage is cut."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_STAGED: dict[str, SparkSession] = {}


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a temporary one only where it is unset and all runs on this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="siftline-")
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext.getCheckpointDir()
    return found


def stage(df: DataFrame, name: str, by: tuple | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Lineage ends here, so a lost executor costs only the tasks that read the table.
    The tables are removed at the end of ``staging``, or when the driver's Python ends. ``by`` names a column by whose values
    the table is laid out in folders, and one by which it is sorted.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/siftline-{uuid.uuid4().hex}-{name}"
    if by:
        laid_out(df, by).write.partitionBy(by[0]).option("compression", "zstd").parquet(path)
    else:
        df.write.option("compression", "zstd").parquet(path)
    if not _STAGED:
        atexit.unregister(_sweep)
        atexit.register(_sweep)
    _STAGED[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def unstage(df: DataFrame) -> None:
    """Remove the table that ``stage`` returned; nothing that is still to be run may read it."""
    path = df._staged_at
    _remove(_STAGED.pop(path), path)


def laid_out(df: DataFrame, by: tuple, folders: int = 64) -> DataFrame:
    """Rows of one value of ``by[0]`` together and sorted; where there are more tasks than values, a value is spread by ``by[1]``."""
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(tasks, *by[: 1 if tasks <= folders else 2]).sortWithinPartitions(*by)


@contextmanager
def staging():
    """Removes the tables staged within at its end; what comes out must not read them."""
    before = set(_STAGED)
    try:
        yield
    finally:
        for path in set(_STAGED) - before:
            _remove(_STAGED.pop(path), path)


def _remove(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def _sweep() -> None:
    for path, spark in list(_STAGED.items()):
        try:
            _remove(spark, path)
        except Exception:  # the session may be gone
            return


def bounded_broadcast(df: DataFrame, max_rows: int) -> DataFrame:
    """``df`` with a broadcast hint if it holds at most ``max_rows`` rows, else unchanged (a shuffled join)."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")

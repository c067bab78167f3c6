"""A change journal as a stream, applied batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siftline.engine import Engine
from siftline.functions.paths import extension_of, filename_of

CHANGES = "event_id long, path string, created boolean, modified boolean, removed boolean, renamed boolean, must_scan_dir boolean"


def read_journal(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """The journal's files as a stream; the checkpoint is the cursor, and moves only after a batch was applied."""
    return spark.readStream.schema(CHANGES).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def apply_batch(engine: Engine, listing: DataFrame | Callable[[], DataFrame], texts: DataFrame | Callable[[], DataFrame] | None = None):
    """A foreachBatch function that brings all tables of an engine in step with a batch of changes.

    ``listing`` (and ``texts``) may be functions that are asked for each batch, so that a long-lived stream sees files as they
    are. All tables of a batch are published as one generation together with the batch's number and the last change, and a
    batch that was published is skipped when it is delivered again, so that a replay changes nothing.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        if engine.store.meta("last_batch", -1) >= batch_id:
            return
        last = batch.agg(F.max("event_id")).head()[0]
        meta = {"last_batch": batch_id, "journal_cursor": last if last is not None else engine.store.meta("journal_cursor", 0)}
        now = [x() if callable(x) else x for x in (listing, texts)]
        engine.apply_changes(batch, now[0], now[1], meta)

    return run


def start(stream: DataFrame, engine: Engine, listing, checkpoint: str, texts=None) -> StreamingQuery:
    return stream.writeStream.foreachBatch(apply_batch(engine, listing, texts)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def listing_of(paths: DataFrame) -> DataFrame:
    """A files table of (path, size_bytes, modified_ts)."""
    p = F.col("path")
    return paths.select("path", filename_of(p).alias("filename"), extension_of(p).alias("extension"), "size_bytes", "modified_ts", F.lit(False).alias("is_dir"), F.lit(0).cast("long").alias("created_ts"))

"""Jobs on pending files: texts to vectors, images to texts, by functions that the caller brings."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.functions.text import embed_text, truncate
from siftline.functions.values import embed_hash
from siftline.operators.pending import embed_skip
from siftline.runtime import stage

#: Texts of one call of an embedder, its attempts, and bytes of a text that are read for it.
BATCH, ATTEMPTS, READ_BYTES = 20, 3, 5_000


def attempts(call: Callable, given: list, tries: int = ATTEMPTS, pause: float = 1.0):
    """What a call gives, tried again after pauses that double."""
    for n in range(tries):
        try:
            return call(given)
        except Exception:
            if n + 1 == tries:
                raise
            time.sleep(pause * 2**n)


def embed_texts(todo: DataFrame, docs: DataFrame) -> DataFrame:
    """(path, mtime, text, embed_hash): what is embedded of the pending files that have a text, from its first bytes."""
    text = docs.select("path", truncate(F.col("content"), READ_BYTES).alias("content"))
    rows = todo.join(text, "path").select("path", F.col("modified_ts").alias("mtime"), embed_text(F.col("filename"), F.col("content"), F.col("extension")).alias("text"))
    return rows.filter("text is not null").withColumn("embed_hash", embed_hash(F.col("text")))


def embed(todo: DataFrame, docs: DataFrame, had: DataFrame, embedder: Callable, batch: int = BATCH, pause: float = 1.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """New vectors, (path, mtime) of those whose text is as it was, and (path, error) of failed batches; the rest goes on."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for s in range(0, len(pdf), batch):
                part = pdf.iloc[s : s + batch]
                try:
                    made, error = attempts(embedder, part["text"].to_list(), pause=pause), None
                    if len(made) != len(part):
                        raise ValueError(f"{len(made)} vectors for {len(part)} texts")
                except Exception as e:  # logged by the caller
                    made, error = [None] * len(part), f"{type(e).__name__}: {e}"[:500]
                yield pd.DataFrame({"path": part["path"], "mtime": part["mtime"], "embed_hash": part["embed_hash"], "vector": made, "error": error})

    rows = stage(embed_texts(todo, docs), "embed-texts")
    marked = embed_skip(rows.select("path", "mtime", "embed_hash"), had)
    fresh = rows.join(marked.filter("todo = 'embed'").select("path"), "path", "left_semi")
    out = stage(fresh.mapInPandas(run, "path string, mtime long, embed_hash string, vector array<float>, error string"), "embedded")
    made = out.filter("error is null").select("path", F.xxhash64("path").alias("vec_id"), "vector", "mtime", "embed_hash")
    return made, marked.filter("todo = 'touch'").select("path", "mtime"), out.filter("error is not null").select("path", "error")


def recognise(todo: DataFrame, recogniser: Callable, batch: int = 50) -> tuple[DataFrame, DataFrame]:
    """(path, modified_ts, text, confidence) of the images read, with the times they were pending at, and (path, error) of the others.

    ``recogniser`` takes paths and gives a record (path, text, confidence, exif, error) for each.
    """
    from siftline.sources.extract import OCR_RECORD, ocr_text

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for s in range(0, len(pdf), batch):
                paths = pdf["path"].iloc[s : s + batch].to_list()
                try:
                    found = {r["path"]: r for r in recogniser(paths)}
                except Exception as e:
                    found = {p: {"path": p, "error": f"{type(e).__name__}: {e}"[:500]} for p in paths}
                rows = [found.get(p, {"path": p, "error": "no record"}) for p in paths]
                yield pd.DataFrame({f.name: [r.get(f.name) for r in rows] for f in OCR_RECORD.fields})

    read = todo.select("path").mapInPandas(run, OCR_RECORD)
    record = F.struct(*[F.col(f.name) for f in OCR_RECORD.fields])
    rows = stage(read.select("path", ocr_text(record).alias("text"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), "error"), "recognised")
    return finished(rows, todo), rows.filter("error is not null").select("path", "error")


def finished(records: DataFrame, todo: DataFrame) -> DataFrame:
    """OCR results without an error, with the times that their files were pending at."""
    return records.filter("error is null").join(todo.select("path", "modified_ts"), "path").select("path", "modified_ts", "text", "confidence")

"""Changes between consecutive full snapshots of a table of paths.

Keys get persistent ordinals (a dictionary that only grows). Every snapshot of a scan root is kept as
segments: one compressed bitmap of the ordinals present and two column vectors aligned with its set bits.
Additions are ``current AND NOT previous``, removals the reverse, and changes are read off the vectors at
the bits both have. No join on the key itself is needed to compare two snapshots.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftline.runtime import bounded_broadcast, stage

#: Bits of a segment; a bucket of keys that outgrows it continues in further segments.
SEGMENT_BITS = 32768
#: Keys aimed at per bucket when the number of buckets is chosen.
KEYS_PER_BUCKET = 16384
#: Scan roots that are looked up by each task, at most; more are joined.
MAX_ROOTS = 50_000


def whole_seconds(ts: Column) -> Column:
    """Epoch time in seconds, floored, from seconds, milli-, micro- or nanoseconds (told apart by magnitude)."""
    scale = (
        F.when(ts >= F.lit(10**17), F.lit(10**9))
        .when(ts >= F.lit(10**14), F.lit(10**6))
        .when(ts >= F.lit(10**11), F.lit(10**3))
        .otherwise(F.lit(1))
    )
    return F.floor(ts / scale).cast("long")


def _canonical(roots: set[str]):
    @F.pandas_udf("path string, root string")
    def canonical(paths: pd.Series) -> pd.DataFrame:
        out, under = [], []
        for p in paths:
            if p is None:
                out.append(None)
                under.append(None)
                continue
            p = p.replace("\\", "/")
            if not p.isascii():
                p = unicodedata.normalize("NFC", p)
            q = p
            while q and q not in roots:
                q = q.rpartition("/")[0]
            out.append(p)
            under.append(q or None)
        return pd.DataFrame({"path": out, "root": under})

    return canonical


def _placed_by_join(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """(raw, place) of distinct (raw) paths: what ``_canonical`` gives, the places above each path being joined with the (root)s."""
    known = paths.select("raw", _canonical(set())(F.col("raw"))["path"].alias("path"))
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    found = known.filter("path is not null").select("raw", F.explode(above).alias("root")).join(roots, "root")
    longest = found.groupBy("raw").agg(F.max_by("root", F.length("root")).alias("root"))
    return known.join(longest, "raw", "left").select("raw", F.struct("path", "root").alias("place"))


def complete_runs(scan_runs: DataFrame) -> DataFrame:
    """(root, snapshot_id, previous): the complete walks of a root and the complete walk before each (null: none)."""
    runs = (
        scan_runs.filter(F.col("root").isNotNull() & F.col("snapshot_id").isNotNull())
        .groupBy("root", "snapshot_id")
        .agg(F.max_by("complete", F.struct("taken_at", "complete")).alias("complete"))
        .filter("complete")
    )
    order = Window.partitionBy("root").orderBy("snapshot_id")
    return runs.select("root", "snapshot_id", F.lag("snapshot_id").over(order).alias("previous"))


def current_rows(snapshots: DataFrame, scan_runs: DataFrame, max_roots: int = MAX_ROOTS) -> DataFrame:
    """One row per complete (root, snapshot_id, path): the one delivered last; ties go to the larger time and size.

    Paths are NFC with ``/``; rows with a null path or under no scan root are no part of any snapshot.
    """
    runs = complete_runs(scan_runs)
    # a root without a complete walk still shields its rows from a shorter root above it
    roots = scan_runs.filter("root <> ''").select("root").distinct()
    every = [r[0] for r in roots.limit(max_roots + 1).collect()]
    if len(every) <= max_roots:
        place = _canonical(set(every))(F.col("path"))
    else:
        places = _placed_by_join(snapshots.select(F.col("path").alias("raw")).filter("raw is not null").distinct(), roots)
        snapshots, place = snapshots.drop("place", "raw").withColumn("raw", F.col("path")).join(places, "raw"), F.col("place")
    rows = snapshots.select(
        "snapshot_id",
        place.alias("place"),
        whole_seconds(F.col("modified_ts")).alias("mtime"),
        F.col("size_bytes").cast("long").alias("size"),
        "delivered_at",
    ).select("snapshot_id", "place.path", "place.root", "mtime", "size", "delivered_at")
    kept = rows.join(bounded_broadcast(runs.select("root", "snapshot_id"), 200_000), ["root", "snapshot_id"])
    return (
        kept.groupBy("root", "snapshot_id", "path")
        .agg(F.max_by(F.struct("mtime", "size"), F.struct("delivered_at", "mtime", "size")).alias("v"))
        .select("root", "snapshot_id", "path", "v.mtime", "v.size")
    )


def extend_ordinals(rows: DataFrame, known: DataFrame | None = None, buckets: int | None = None) -> DataFrame:
    """The dictionary (root, path, bucket, ordinal) with every key of ``rows``; ordinals of ``known`` keys stay.

    Ordinals are dense within (root, bucket), bucket being a hash of the path, so each bucket is numbered by its own
    task. ``buckets`` must be the same for all extensions of one dictionary; it is taken from ``known`` if given.
    """
    first = rows.groupBy("root", "path").agg(F.min("snapshot_id").alias("first"))
    if known is None:
        buckets = buckets or max(1, -(-rows.select("path").distinct().count() // KEYS_PER_BUCKET))
        held = None
    else:
        buckets = buckets or int(known.agg(F.max("buckets")).head()[0] or 1)
        first = first.join(known.select("root", "path"), ["root", "path"], "left_anti")
        held = known.groupBy("root", "bucket").agg((F.max("ordinal") + 1).alias("held"))
    new = first.withColumn("bucket", F.pmod(F.xxhash64("path"), F.lit(buckets)).cast("int"))
    order = Window.partitionBy("root", "bucket").orderBy("first", "path")
    new = new.withColumn("ordinal", (F.row_number().over(order) - 1).cast("long"))
    if held is not None:
        new = new.join(held, ["root", "bucket"], "left").withColumn("ordinal", F.col("ordinal") + F.coalesce("held", F.lit(0)))
    new = new.select("root", "path", "bucket", "ordinal", F.lit(buckets).alias("buckets"))
    return new if known is None else known.select(new.columns).unionByName(new)


def pack_bits(bits: np.ndarray) -> bytes:
    """A sorted array of bit numbers below SEGMENT_BITS in the smallest of three containers: array, runs or plain bits."""
    bits = np.asarray(bits, dtype=np.uint16)
    if not len(bits):
        return b"a"
    cuts = np.flatnonzero(np.diff(bits.astype(np.int32)) != 1)
    starts, ends = bits[np.r_[0, cuts + 1]], bits[np.r_[cuts, len(bits) - 1]]
    plain = np.zeros(int(bits[-1]) + 1, dtype=bool)
    plain[bits] = True
    forms = (b"a" + bits.tobytes(), b"r" + np.column_stack([starts, ends]).astype(np.uint16).tobytes(), b"b" + np.packbits(plain, bitorder="little").tobytes())
    return min(forms, key=len)


def unpack_bits(packed: bytes | None) -> np.ndarray:
    """The segment's bits as a boolean vector; None is the empty segment."""
    out = np.zeros(SEGMENT_BITS, dtype=bool)
    if packed:
        kind, body = packed[:1], packed[1:]
        if kind == b"a":
            out[np.frombuffer(body, np.uint16)] = True
        elif kind == b"r":
            for a, z in np.frombuffer(body, np.uint16).reshape(-1, 2).astype(int):
                out[a : z + 1] = True
        else:
            bits = np.unpackbits(np.frombuffer(body, np.uint8), bitorder="little").astype(bool)
            out[: len(bits)] = bits
    return out


@F.pandas_udf(T.BinaryType())
def _pack(bits: pd.Series) -> pd.Series:
    return bits.map(pack_bits)


def segments(rows: DataFrame, ordinals: DataFrame) -> DataFrame:
    """(root, bucket, segment, snapshot_id, present, mtimes, sizes): bitmap and aligned vectors, at most SEGMENT_BITS keys a row."""
    width = F.lit(SEGMENT_BITS)
    placed = rows.join(ordinals, ["root", "path"]).select(
        "root", "bucket", F.floor(F.col("ordinal") / width).cast("int").alias("segment"), "snapshot_id",
        F.struct(F.pmod("ordinal", width).cast("int").alias("bit"), "mtime", "size").alias("cell"),
    )
    lists = placed.groupBy("root", "bucket", "segment", "snapshot_id").agg(F.array_sort(F.collect_list("cell")).alias("cells"))
    return lists.select(
        "root", "bucket", "segment", "snapshot_id", _pack(F.col("cells.bit")).alias("present"),
        F.col("cells.mtime").alias("mtimes"), F.col("cells.size").alias("sizes"),
    )


def _vector(values) -> np.ndarray:
    """Longs with null as a value of its own."""
    return np.array([np.iinfo(np.int64).min if v is None or v != v else int(v) for v in values], dtype=np.int64)


def _compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for r in pdf.itertuples(index=False):
            now, then = unpack_bits(r.present), unpack_bits(r.was_present)
            parts = [("added", np.flatnonzero(now & ~then)), ("removed", np.flatnonzero(then & ~now))]
            both = np.flatnonzero(now & then)
            if len(both):
                at_now, at_then = np.cumsum(now)[both] - 1, np.cumsum(then)[both] - 1
                differs = _vector(r.mtimes)[at_now] != _vector(r.was_mtimes)[at_then]
                differs |= _vector(r.sizes)[at_now] != _vector(r.was_sizes)[at_then]
                parts.append(("changed", both[differs]))
            for change, bits in parts:
                if len(bits):
                    out.append(pd.DataFrame({"root": r.root, "bucket": r.bucket, "snapshot_id": r.snapshot_id, "change": change, "ordinal": bits.astype(np.int64) + r.segment * SEGMENT_BITS}))
        if out:
            yield pd.concat(out)


def segment_changes(segs: DataFrame, runs: DataFrame) -> DataFrame:
    """(root, bucket, ordinal, snapshot_id, change) between each complete snapshot of a root and the complete one before."""
    runs = bounded_broadcast(runs.filter("previous is not null"), 200_000)
    key = ["root", "bucket", "segment", "snapshot_id"]
    now = segs.join(runs.select("root", "snapshot_id"), ["root", "snapshot_id"])
    then = segs.withColumnRenamed("snapshot_id", "previous").join(runs, ["root", "previous"])
    then = then.select(*key, *[F.col(c).alias(f"was_{c}") for c in ("present", "mtimes", "sizes")])
    paired = now.join(then, key, "full_outer")
    return paired.mapInPandas(_compare, "root string, bucket int, snapshot_id int, change string, ordinal long")


def snapshot_changes(snapshots: DataFrame, scan_runs: DataFrame, known_ordinals: DataFrame | None = None) -> DataFrame:
    """(snapshot_id, root, path, change) with change in added, removed, changed (whole-second time or size differs).

    Each snapshot of a root whose walk was complete is compared with the root's previous complete one; incomplete ones
    are skipped, the first yields nothing. Nulls: a null time or size is a value of its own, equal to itself; rows with
    null path, snapshot or root are left out. Repeated rows: the one delivered last holds. Empty tables give no rows;
    extra columns are ignored.
    """
    rows = stage(current_rows(snapshots, scan_runs), "snapshot-rows")
    ordinals = stage(extend_ordinals(rows, known_ordinals), "snapshot-ordinals")
    changes = segment_changes(segments(rows, ordinals), complete_runs(scan_runs))
    return changes.join(ordinals, ["root", "bucket", "ordinal"]).select("snapshot_id", "root", "path", "change")

"""Hashes, vectors, dates and sizes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def fnv1a(texts: pd.Series) -> pd.Series:
    """FNV-1a, 64 bits, as 16 hex digits; all strings of a batch advance together, byte by byte."""
    raw = [None if t is None else t.encode() for t in texts]
    lengths = np.array([len(r or b"") for r in raw])
    data = np.frombuffer(b"".join(r or b"" for r in raw), np.uint8)
    start = np.cumsum(lengths) - lengths
    h = np.full(len(raw), 0xCBF29CE484222325, dtype=np.uint64)
    with np.errstate(over="ignore"):
        live, i = np.flatnonzero(lengths > 0), 0
        while len(live):
            h[live] = (h[live] ^ data[start[live] + i]) * np.uint64(0x100000001B3)
            i += 1
            live = live[lengths[live] > i]
    return pd.Series([None if r is None else f"{int(x):016x}" for r, x in zip(raw, h)])


@F.pandas_udf(T.BinaryType())
def encode_vector(v: pd.Series) -> pd.Series:
    """Little-endian 32-bit floats."""
    return v.map(lambda x: None if x is None else np.asarray(x, dtype="<f4").tobytes())


def decode_vector(dim: int):
    """The floats of ``dim`` little-endian 32-bit values; null for any other length."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def decode(b: pd.Series) -> pd.Series:
        return b.map(lambda x: np.frombuffer(x, "<f4") if x is not None and len(x) == 4 * dim else None)

    return decode


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where a norm is 0."""
    return F.coalesce(F.try_divide(_dot(a, b), F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))), F.lit(0.0))


def usable_vector(v: Column, dim: int) -> Column:
    """Of the right length, every value finite."""
    return (F.size(v) == dim) & ~F.exists(v, lambda x: F.isnan(x) | (F.abs(x) == float("inf")))


def epoch(ts: Column) -> Column:
    """Whole seconds since the epoch, 0 for earlier times."""
    return F.greatest(F.unix_seconds(ts), F.lit(0))


def rfc3339(seconds: Column) -> Column:
    """UTC time of positive seconds, else an empty string."""
    return F.when(seconds > 0, F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")).otherwise("")


def relative_date(seconds: Column, now: int) -> Column:
    days = F.floor((F.lit(now) - seconds) / 86400)
    at = F.timestamp_seconds(seconds)
    time = F.date_format(at, "hh:mm a")
    return (
        F.when(seconds <= 0, "").when(days == 0, F.concat(F.lit("Today at "), time)).when(days == 1, F.concat(F.lit("Yesterday at "), time))
        .otherwise(F.concat(F.date_format(at, "d MMMM, yyyy"), F.lit(" at "), time))
    )


def human_size(n: Column) -> Column:
    out = F.when(n.isNull(), "").when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
    for k, unit in ((1, "KB"), (2, "MB")):
        out = out.when(n < 1024 ** (k + 1), F.concat(F.format_string("%.1f", n / float(1024**k)), F.lit(f" {unit}")))
    return out.otherwise(F.concat(F.format_string("%.1f", n / float(1024**3)), F.lit(" GB")))


def embed_hash(text: Column) -> Column:
    """The hash that an embedded text is known by."""
    return fnv1a(text)


def file_type(extension: Column, is_dir: Column) -> Column:
    """What a result is shown as: folder, its extension, or file."""
    return F.when(is_dir, "folder").otherwise(F.coalesce(extension, F.lit("file")))


def exif_date(value: Column) -> Column:
    """An image's date as ISO 8601, from either of the two forms that cameras write; what is neither stays as it is."""
    forms = [F.try_to_timestamp(value, F.lit(f)) for f in ("yyyy:MM:dd HH:mm:ss", "yyyy-MM-dd HH:mm:ss")]
    return F.coalesce(F.date_format(F.coalesce(*forms), "yyyy-MM-dd'T'HH:mm:ss"), value)

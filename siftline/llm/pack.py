"""Filling fixed-capacity token containers with texts (problem 6).

Cost-balanced packing: a text of n tokens costs ``linear * n + quadratic * n**2`` (projections and attention). Texts go,
longest first, to the cheapest sequence that still has room. With ``snug``, a sequence that a text would close but for so
many tokens is preferred, so that less room is left over; 0 is the plain method.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: GPT-2's public pre-tokenisation pattern.
TOKEN_PATTERN = r"'(?:s|t|re|ve|m|ll|d)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts packed together by one task.
ITEMS_PER_SHARD = 20_000
#: Attention against projections for a model width of 768: 4 n^2 d against 24 n d^2.
LINEAR, QUADRATIC = 1.0, 1.0 / (6 * 768)
#: Tokens that a sequence closed by a text may lack to be preferred.
SNUG = 4


def token_pattern() -> Column:
    return F.lit("(?U)" + TOKEN_PATTERN)


def with_tokens(df: DataFrame, text: str, name: str = "n_tokens") -> DataFrame:
    """``df`` with the number of tokens of a text (0 for null)."""
    return df.withColumn(name, F.coalesce(F.regexp_count(F.col(text), token_pattern()), F.lit(0)))


def items(docs: DataFrame, key: str, text: str, capacity: int = 1024) -> DataFrame:
    """(key, piece_no, start, n_chars, n_tokens, total): whole texts, and texts above ``capacity`` cut into full pieces and a rest.

    Cuts fall between tokens; ``start`` counts characters from 1. Null and empty texts hold no token and are no item.
    """
    counted = with_tokens(docs.select(F.col(key), F.col(text).alias("_text")), "_text", "total").filter("total > 0")
    tokens = F.when(F.col("total") > capacity, F.regexp_extract_all("_text", token_pattern(), F.lit(0)))
    counted = counted.select(key, "total", F.length("_text").alias("chars"), tokens.alias("tokens"))
    lengths = F.transform(
        F.sequence(F.lit(0), F.ceil(F.col("total") / capacity).cast("int") - 1),
        lambda i: F.when(
            F.col("tokens").isNotNull(),
            F.length(F.array_join(F.slice("tokens", i * capacity + 1, F.lit(capacity)), "")),
        ).otherwise(F.col("chars")),
    )
    cut = counted.select(key, "total", lengths.alias("lengths"))
    return cut.select(key, "total", "lengths", F.posexplode("lengths").alias("piece_no", "n_chars")).select(
        key, "piece_no",
        (F.aggregate(F.slice("lengths", F.lit(1), F.col("piece_no")), F.lit(0), lambda a, x: a + x) + 1).alias("start"),
        "n_chars", F.least(F.lit(capacity), F.col("total") - F.col("piece_no") * capacity).alias("n_tokens"), "total",
    )


def balance(sizes: np.ndarray, capacity: int, linear: float = LINEAR, quadratic: float = QUADRATIC, snug: int = SNUG) -> np.ndarray:
    """Sequence of each item (sizes in descending order): cheapest with room, snug ones first (none if ``snug`` is 0); a new one where none has room."""
    seq = np.empty(len(sizes), dtype=np.int64)
    n = max(1, -(-int(sizes.sum()) // capacity))
    room = np.full(2 * n + 16, -1, dtype=np.int64)
    room[:n] = capacity
    cost = np.zeros(len(room))
    for i, size in enumerate(sizes):
        left = room[:n] - size
        fits = np.flatnonzero(left >= 0)
        if not len(fits):
            if n == len(room):
                room, cost = np.r_[room, np.full(n, -1)], np.r_[cost, np.zeros(n)]
            room[n] = capacity
            at, n = n, n + 1
        else:
            close = fits[left[fits] <= snug] if snug else fits[:0]
            fits = close if len(close) else fits
            at = fits[np.argmin(cost[fits])]
        seq[i] = at
        room[at] -= size
        cost[at] += linear * size + quadratic * size * size
    return seq


def _pack_shard(capacity: int, linear: float, quadratic: float, snug: int):
    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_tokens", "_key", "piece_no"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        full = pdf["n_tokens"].to_numpy() == capacity
        seq = np.empty(len(pdf), dtype=np.int64)
        seq[full] = np.arange(full.sum())
        if (~full).any():
            seq[~full] = balance(pdf["n_tokens"].to_numpy()[~full].astype(np.int64), capacity, linear, quadratic, snug) + full.sum()
        pdf["seq"] = np.unique(seq, return_inverse=True)[1]
        return pdf[["_shard", "seq", "_key", "piece_no", "start", "n_chars", "n_tokens"]]

    return pack


def pack_documents(
    docs: DataFrame, key: str, text: str, capacity: int = 1024, linear: float = LINEAR, quadratic: float = QUADRATIC,
    items_per_shard: int = ITEMS_PER_SHARD, snug: int = SNUG,
) -> DataFrame:
    """(container, key, piece_no, start, n_chars, n_tokens): every item in one container, none above ``capacity`` tokens.

    Items are spread over shards by a hash of key and piece, so a hot source or key weighs on none, and each shard of about
    ``items_per_shard`` items is packed by one task; only counts are shuffled, never texts. ``container`` is
    ``shard:sequence``. Null and empty texts are in no container; repeated rows are items each; ties go by key and piece;
    an empty table gives no rows; other columns are ignored.
    """
    found = items(docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")), "_key", "_text", capacity).drop("total")
    rows = docs.select(F.lit(1)).count()
    shards = max(1, -(-rows // items_per_shard))
    kind = docs.schema[key].dataType.simpleString()
    found = found.withColumn("_shard", F.pmod(F.xxhash64("_key", "piece_no"), F.lit(shards)).cast("int"))
    packed = found.groupBy("_shard").applyInPandas(
        _pack_shard(capacity, linear, quadratic, snug), f"_shard int, seq long, _key {kind}, piece_no int, start int, n_chars int, n_tokens int"
    )
    return packed.select(
        F.concat_ws(":", "_shard", "seq").alias("container"), F.col("_key").alias(key), "piece_no", "start", "n_chars", "n_tokens"
    )


def oversized_documents(docs: DataFrame, key: str, text: str, capacity: int = 1024) -> DataFrame:
    """Keys of the texts that the packer had to cut, as no container holds them whole (one row per row of ``docs``)."""
    return pack_documents(docs, key, text, capacity).filter("piece_no = 1").select(key)

"""Ranking expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftline.functions import constants as K


def type_bonus(ext: Column) -> Column:
    out = F
    for bonus, kinds in K.TYPE_BONUS.items():
        out = out.when(ext.isin(kinds), bonus)
    return out.otherwise(50.0)


def recency(modified_ts: Column, now: int) -> Column:
    """100 for a file changed now, falling with the root of its age in days."""
    return 100.0 / (1.0 + F.sqrt(F.greatest(F.lit(now) - modified_ts, F.lit(0)) / 86400.0))


def tier_bucket(score: Column) -> Column:
    out = F
    for least, bucket in K.BUCKETS:
        out = out.when(score >= least, bucket)
    return out.otherwise(1)


def decay_weight(timestamp: Column, now: int) -> Column:
    out = F
    for days, weight in K.DECAY:
        out = out.when(timestamp >= F.lit(now - days * 86400), weight)
    return out.otherwise(0.0)


def interaction_boost(weight: Column) -> Column:
    return F.least(F.log(weight + 1.0) * 150.0, F.lit(500.0))


def content_score(bm25: Column, modified_ts: Column, ext: Column, now: int) -> Column:
    """Of a hit in the content alone; the constant is the bonus of the middle position."""
    return K.CONTENT + F.least(bm25 * 30.0, F.lit(500.0)) + 50.0 + recency(modified_ts, now) + type_bonus(ext)


def semantic_score(similarity: Column, modified_ts: Column, ext: Column, now: int) -> Column:
    return K.SEMANTIC + similarity * 500.0 + recency(modified_ts, now) + type_bonus(ext)


def bm25_term(tf: Column, df: Column, dl: Column, n: Column, avgdl: Column) -> Column:
    idf = F.log(1.0 + (n - df + 0.5) / (df + 0.5))
    return idf * tf * (K.K1 + 1.0) / (tf + K.K1 * (1.0 - K.B + K.B * dl / avgdl))

"""Time-decayed use of files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.functions.scoring import decay_weight, interaction_boost


def interaction_data(interactions: DataFrame, now: int) -> DataFrame:
    """(path, weight, boost, interactions): events per path, newer ones weighing more; null paths are left out."""
    events = interactions.filter("path is not null")
    sums = events.groupBy("path").agg(F.sum(decay_weight(F.col("timestamp"), now)).alias("weight"), F.count("*").alias("interactions"))
    return sums.withColumn("boost", interaction_boost(F.col("weight")))


def for_candidates(interactions: DataFrame, candidates: DataFrame, now: int, most: int = 1_000_000) -> DataFrame:
    """The same for the candidates' paths only.

    Up to ``most`` candidates are broadcast, so that events of others go before the shuffle; beyond, all events are summed
    first. Either way a hot path is summed in parts before it is shuffled.
    """
    paths = candidates.select("path").distinct()
    if paths.limit(most + 1).count() <= most:
        return interaction_data(interactions.join(F.broadcast(paths), "path", "left_semi"), now)
    return interaction_data(interactions, now).join(paths, "path", "left_semi")

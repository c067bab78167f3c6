"""Vector search for one query: exact scans and an LSH index."""

from __future__ import annotations

from pyspark.ml.feature import BucketedRandomProjectionLSH, BucketedRandomProjectionLSHModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.functions import constants as K
from siftline.functions.values import cosine, usable_vector


def _literal(vector: list[float]):
    return F.array(*[F.lit(float(x)) for x in vector])


def similarities(vectors: DataFrame, query: list[float]) -> DataFrame:
    """(path, vec_id, similarity) of the vectors of the query's length; others and non-finite ones match nothing."""
    fit = vectors.filter(usable_vector(F.col("vector"), len(query)))
    return fit.select("path", "vec_id", cosine(F.col("vector"), _literal(query)).alias("similarity"))


def semantic_scan(vectors: DataFrame, query: list[float], floor: float = K.COSINE_FLOOR, newest: int = K.RECENT_VECTORS) -> DataFrame:
    """All matches above the floor among the newest vectors."""
    recent = vectors.orderBy(F.desc("mtime"), F.desc("vec_id")).limit(newest)
    return similarities(recent, query).filter(F.col("similarity") >= floor)


def semantic_topk(vectors: DataFrame, query: list[float], k: int, floor: float = K.COSINE_FLOOR) -> DataFrame:
    return similarities(vectors, query).filter(F.col("similarity") >= floor).orderBy(F.desc("similarity"), "vec_id").limit(k)


def fit_lsh(vectors: DataFrame, dim: int, seed: int = 3):
    """An LSH model and the vectors it is made for, scaled to length one (there, distance orders like cosine)."""
    fit = vectors.filter(usable_vector(F.col("vector"), dim))
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    # the optimiser may make vectors of rows before it filters them
    scaled = F.when(usable_vector(F.col("vector"), dim) & (F.col("norm") > 0), F.transform("vector", lambda x: x.cast("double") / F.col("norm"))).otherwise(F.array_repeat(F.lit(0.0), dim))
    unit = fit.withColumn("norm", norm).filter("norm > 0").select("path", "vec_id", "vector", array_to_vector(scaled).alias("unit"))
    lsh = BucketedRandomProjectionLSH(inputCol="unit", outputCol="hashes", bucketLength=1.0, numHashTables=6, seed=seed)
    return lsh.fit(unit), unit


def load_lsh(path: str) -> BucketedRandomProjectionLSHModel:
    return BucketedRandomProjectionLSHModel.load(path)


def ann_search(model, hashed: DataFrame, query: list[float], k: int, floor: float = K.COSINE_FLOOR) -> DataFrame:
    """The k best among the vectors that share a bucket of the index with the query, compared exactly."""
    from pyspark.ml.linalg import Vectors

    norm = sum(x * x for x in query) ** 0.5 or 1.0
    near = model.approxNearestNeighbors(hashed, Vectors.dense([x / norm for x in query]), 10 * k)
    return semantic_topk(near.select("path", "vec_id", "vector"), query, k, floor)


def semantic_ann(vectors: DataFrame, query: list[float], k: int, floor: float = K.COSINE_FLOOR) -> DataFrame:
    """``ann_search`` with an index made for it alone."""
    model, unit = fit_lsh(vectors, len(query))
    return ann_search(model, model.transform(unit), query, k, floor)


def stale_index(stored: int, current: int) -> bool:
    """Whether so many vectors are gone since an index of ``stored`` was built that it should be built again."""
    return stored > 0 and current / stored < 0.85

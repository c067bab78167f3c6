"""Queries of problem 4."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftline.llm.ann import similar_vectors
from siftline.runtime import read


def p4_found(spark, sf_dir):
    near = similar_vectors(read(spark, sf_dir, "semantic_vectors"), k=10, least=0.85)
    a, b = F.least("vec_id", "other_id"), F.greatest("vec_id", "other_id")
    return near.select(a.alias("vec_id_a"), b.alias("vec_id_b")).distinct()


def p4_neighbours(spark, sf_dir):
    return similar_vectors(read(spark, sf_dir, "semantic_vectors"), k=10)


QUERIES = {"p4_found": p4_found, "p4_neighbours": p4_neighbours}
ORACLE: dict = {}

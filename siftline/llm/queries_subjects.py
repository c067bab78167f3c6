"""Queries of problem 8."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftline.llm.subjects import document_subjects
from siftline.runtime import read


def _run(spark, sf_dir):
    return document_subjects(read(spark, sf_dir, "documents"), "doc_id", "text", read(spark, sf_dir, "subject_examples"))


def p8_found(spark, sf_dir):
    return _run(spark, sf_dir).select("doc_id", "subject").distinct()


def p8_composition(spark, sf_dir):
    """Documents and sentences of the corpus per subject."""
    return _run(spark, sf_dir).groupBy("subject").agg(F.countDistinct("doc_id").alias("documents"), F.sum("about").alias("sentences"))


QUERIES = {"p8_found": p8_found, "p8_composition": p8_composition}
ORACLE: dict = {}

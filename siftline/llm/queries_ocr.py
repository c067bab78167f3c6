"""Queries of problem 2."""

from __future__ import annotations

from siftline.llm.ocr import line_marks, repaired_paragraphs
from siftline.runtime import read


def p2_found(spark, sf_dir):
    return line_marks(read(spark, sf_dir, "ocr_results"))


def p2_paragraphs(spark, sf_dir):
    return repaired_paragraphs(read(spark, sf_dir, "ocr_results"))


QUERIES = {"p2_found": p2_found, "p2_paragraphs": p2_paragraphs}
ORACLE: dict = {}

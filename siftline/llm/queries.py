"""Queries of the llm subpackage and their SQL."""

from __future__ import annotations

from siftline.llm import queries_ann, queries_leak, queries_neardup, queries_ocr, queries_pack, queries_split, queries_subjects

_MODULES = [queries_split, queries_ocr, queries_ann, queries_neardup, queries_pack, queries_leak, queries_subjects]


def queries() -> dict:
    return {k: v for m in _MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: v for m in _MODULES for k, v in m.ORACLE.items()}

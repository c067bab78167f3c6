"""Queries of problem 7."""

from __future__ import annotations

from siftline.llm.leak import leaked_passages
from siftline.runtime import read


def _run(spark, sf_dir, kinds):
    return leaked_passages(read(spark, sf_dir, "documents"), "doc_id", "text", read(spark, sf_dir, "eval_items"), "item_id", "passage", kinds=kinds)


def p7_found(spark, sf_dir):
    return _run(spark, sf_dir, ("phrase",)).select("doc_id", "item_id").distinct()


def p7_matches(spark, sf_dir):
    return _run(spark, sf_dir, ("phrase", "proximity"))


_WORDS = r"regexp_extract_all(lower(%s), '[\p{L}\p{N}]+')"
QUERIES = {"p7_found": p7_found, "p7_matches": p7_matches}
ORACLE = {
    "p7_found": f"""
WITH i AS (SELECT item_id, {_WORDS % 'passage'} AS w FROM eval_items),
d AS (SELECT doc_id, {_WORDS % 'text'} AS w FROM documents),
ig AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 10), lambda k: array_to_string(w[k:k + 11], ' '))) AS g FROM i WHERE len(w) >= 12),
dg AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 10), lambda k: array_to_string(w[k:k + 11], ' '))) AS g FROM d WHERE len(w) >= 12)
SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)"""
}

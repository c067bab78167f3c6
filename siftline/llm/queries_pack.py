"""Queries of problem 6."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftline.llm.pack import oversized_documents, pack_documents
from siftline.runtime import read


def p6_found(spark, sf_dir):
    return oversized_documents(read(spark, sf_dir, "documents"), "doc_id", "text")


def p6_containers(spark, sf_dir):
    return pack_documents(read(spark, sf_dir, "documents"), "doc_id", "text")


def p6_fill(spark, sf_dir):
    """How full the containers are: their number, the tokens held and the share of their room that is used."""
    packed = p6_containers(spark, sf_dir).groupBy("container").agg(F.sum("n_tokens").alias("t"))
    return packed.agg(F.count("*").alias("containers"), F.sum("t").alias("tokens"), F.round(F.sum("t") / (F.count("*") * 1024), 4).alias("fill"), F.max("t").alias("most"))


def p6_documents(spark, sf_dir):
    """Of each document, its pieces and tokens in all containers, and whether none of these holds more than it can."""
    packed = p6_containers(spark, sf_dir)
    sums = packed.groupBy("container").agg((F.sum("n_tokens") <= 1024).alias("fits"))
    held = packed.join(sums, "container").groupBy("doc_id")
    return held.agg(F.count("*").alias("pieces"), F.sum("n_tokens").alias("tokens"), F.every("fits").alias("fits"))


_S = r"\s\x0b\x85\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
# RE2 has no look-ahead: words and white space are counted apart; a run of white space before a word gives its last
# blank to the word, any other last character is a token, and what comes before it is one token
_TOKENS = rf"""(
  len(regexp_extract_all(text, '''(?:s|t|re|ve|m|ll|d)| ?\p{{L}}+| ?\p{{N}}+| ?[^{_S}\p{{L}}\p{{N}}]+'))
  + coalesce(list_sum(list_transform(regexp_extract_all(text, '([{_S}]+)[^{_S}]', 1),
      lambda r: CASE WHEN length(r) > 1 THEN 1 ELSE 0 END + CASE WHEN right(r, 1) <> ' ' THEN 1 ELSE 0 END)), 0)
  + CASE WHEN regexp_matches(text, '[{_S}]$') THEN 1 ELSE 0 END)"""

QUERIES = {"p6_found": p6_found, "p6_containers": p6_containers, "p6_fill": p6_fill, "p6_documents": p6_documents}
ORACLE = {
    "p6_found": f"SELECT doc_id FROM documents WHERE {_TOKENS} > 1024",
    "p6_documents": f"""SELECT doc_id, CAST(sum((t + 1023) // 1024) AS BIGINT) AS pieces, CAST(sum(t) AS BIGINT) AS tokens, true AS fits
FROM (SELECT doc_id, {_TOKENS} AS t FROM documents WHERE text <> '') WHERE t > 0 GROUP BY doc_id""",
}

"""Queries of problem 1."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftline.llm.split import oversized, split_texts
from siftline.runtime import read


def p1_found(spark, sf_dir):
    return oversized(read(spark, sf_dir, "content_index"), "content_id", "content")


def p1_pieces(spark, sf_dir):
    return split_texts(read(spark, sf_dir, "content_index"), "content_id", "content")


def p1_texts(spark, sf_dir):
    """Of each text, the pieces put together again without what they repeat, white space left out, as a hash; and whether all pieces are short enough."""
    rows = p1_pieces(spark, sf_dir)
    body = F.expr("substring(piece, overlap + 1)")
    whole = rows.groupBy("content_id").agg(F.array_sort(F.collect_list(F.struct("piece_no", body.alias("body")))).alias("c"), F.max(F.length("piece")).alias("longest"))
    return whole.select("content_id", F.md5(F.regexp_replace(F.array_join("c.body", ""), r"(?U)\s+", "")).alias("hash"), (F.col("longest") <= 2000).alias("fits"))


_WS = r"[\s\x0b\x85\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_LONGEST = f"list_max(list_transform(string_split(%s, chr(1)), lambda u: length(regexp_replace(u, '^{_WS}+|{_WS}+$', '', 'g'))))"
_PARA = r"regexp_replace(content, '\r?\n[ \t]*\r?\n', chr(1), 'g')"
_LINE = r"regexp_replace(content, '\r?\n', chr(1), 'g')"
_SENT = rf"regexp_replace(regexp_replace({_LINE}, '([.!?]){_WS}+', '\1' || chr(1), 'g'), '([。！？])', '\1' || chr(1), 'g')"
_WORD = rf"regexp_replace({_SENT}, '{_WS}+', chr(1), 'g')"

QUERIES = {"p1_found": p1_found, "p1_pieces": p1_pieces, "p1_texts": p1_texts}
ORACLE = {
    "p1_found": f"""
SELECT content_id, CASE WHEN {_LONGEST % _PARA} <= 1800 THEN 'paragraph' WHEN {_LONGEST % _LINE} <= 1800 THEN 'line'
  WHEN {_LONGEST % _SENT} <= 1800 THEN 'sentence' WHEN {_LONGEST % _WORD} <= 1800 THEN 'word' ELSE 'none' END AS boundary
FROM content_index WHERE length(content) > 2000""",
    "p1_texts": f"""SELECT content_id, md5(t) AS hash, true AS fits FROM (SELECT content_id, regexp_replace(content, '{_WS}+', '', 'g') AS t FROM content_index) WHERE t <> ''""",
}

"""Splitting oversized texts at natural boundaries (problem 1).

One bounded-quantifier pattern, applied by ``regexp_extract_all``, eats a text piece by piece: its alternatives are
ordered by the strength of the boundary they end at (blank line, line end, sentence end, white space) and the last one
takes characters wherever it stops. Offsets of the pieces are running sums; the overlap is looked back from them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Boundaries from the coarsest to none.
KINDS = ["paragraph", "line", "sentence", "word", "none"]


def piece_pattern(body: int) -> str:
    """Java pattern of one piece: up to ``body`` characters without the white space around them, and the white space after."""
    unit = rf"\S(?:.{{0,{body - 2}}}\S)?" if body > 1 else r"\S"
    return "".join(
        [
            r"(?sU)\s*+(?:\z|",
            rf"{unit}(?=\s*\z|\s*?\n[ \t]*\r?\n)\s*+|",
            rf"{unit}(?=\s*?\n)\s++|",
            rf"{unit}(?:(?<=[.!?])\s++|(?<=[。！？])\s*+)|",
            rf"{unit}\s++|",
            rf"\S.{{0,{body - 1}}})",
        ]
    )


def with_pieces(df: DataFrame, text: str, limit: int, overlap: int) -> DataFrame:
    """``df`` with ``_raw`` (the spans eaten, in order; together the whole text) for texts above ``limit``, else null."""
    pattern = piece_pattern(limit - overlap)
    return df.withColumn("_raw", F.when(F.length(text) > limit, F.expr("filter(regexp_extract_all(%s, %s, 0), x -> x <> '')" % (f"`{text}`", _sql_string(pattern)))))


def _sql_string(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def cut_kind(span: Column) -> Column:
    """Index into KINDS of the boundary at the end of a span eaten by the pattern (not for the last one of a text)."""
    return (
        F.when(span.rlike(r"(?U)\n[ \t]*\r?\n\s*\z"), 0)
        .when(span.rlike(r"(?U)\n\s*\z"), 1)
        .when(span.rlike(r"(?U)(?:[.!?]\s+|[。！？]\s*)\z"), 2)
        .when(span.rlike(r"(?U)\s\z"), 3)
        .otherwise(4)
    )


def text_boundary(raw: Column) -> Column:
    """Name of the coarsest kind of cut that suffices, read off the pieces: the finest one that had to be used."""
    worst = F.aggregate(F.slice(raw, 1, F.greatest(F.size(raw) - 1, F.lit(0))), F.lit(0), lambda acc, x: F.greatest(acc, cut_kind(x)))
    return F.element_at(F.array(*map(F.lit, KINDS)), F.coalesce(worst, F.lit(0)) + 1)


def split_texts(df: DataFrame, key: str, text: str, limit: int = 2000, overlap: int = 200) -> DataFrame:
    """(key, piece_no, start, n_chars, overlap, boundary, piece): pieces of at most ``limit`` characters.

    A piece repeats up to ``overlap`` characters of the text before it, from the start of a word on where there is one;
    ``start`` (from 1) and ``n_chars`` count code points of the whole text, so pieces can be put together again.
    ``boundary`` is the kind of cut after the piece, ``end`` for the last. A text within the limit is one piece as it
    stands. Null, empty and blank texts have no piece; repeated keys are split each; other columns are ignored.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be below the limit")
    rows = with_pieces(df.select(F.col(key).alias("_key"), F.col(text).alias("_text")), "_text", limit, overlap)
    spans = F.coalesce("_raw", F.array("_text"))
    ends = F.aggregate(
        spans, F.array().cast("array<int>"),
        lambda acc, x: F.concat(acc, F.array(F.coalesce(F.element_at(acc, F.when(F.size(acc) > 0, -1)), F.lit(0)) + F.length(x))),
    )
    rows = rows.filter(F.col("_text").rlike(r"(?U)\S")).withColumn("_spans", spans).withColumn("_ends", ends)
    cells = rows.select("_key", "_text", F.col("_raw").isNull().alias("_whole"), F.size("_spans").alias("_n"), F.posexplode(F.arrays_zip("_spans", "_ends")).alias("no", "cell"))
    span, lead = F.col("cell._spans"), F.length(F.regexp_extract("cell._spans", r"(?U)\A\s*", 0))
    one = F.col("_whole")  # a text within the limit stays as it stands
    body = F.when(one, F.length(span)).otherwise(F.length(F.regexp_replace(span, r"(?U)\A\s+|\s+\z", "")))
    first = F.when(one, F.lit(1)).otherwise(F.col("cell._ends") - F.length(span) + lead + 1)
    cells = cells.select("_key", "_text", "no", "_n", first.alias("first"), body.alias("body"), cut_kind(span).alias("kind")).filter("body > 0")
    behind = F.expr(f"substring(_text, greatest(first - {overlap}, 1), first - greatest(first - {overlap}, 1))")
    # the look-back begins after the first white space in reach, or at the full reach where there is none
    back = F.when(F.col("no") == 0, 0).when(F.length(F.regexp_extract(behind, r"(?sU)\s(\S.*)\z", 1)) > 0, F.length(F.regexp_extract(behind, r"(?sU)\s(\S.*)\z", 1))).otherwise(F.length(behind))
    cells = cells.withColumn("back", back)
    return cells.select(
        F.col("_key").alias(key), (F.col("no") + 1).alias("piece_no"),
        (F.col("first") - F.col("back")).alias("start"), (F.col("body") + F.col("back")).alias("n_chars"), F.col("back").alias("overlap"),
        F.when(F.col("no") == F.col("_n") - 1, "end").otherwise(F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind") + 1)).alias("boundary"),
        F.expr("substring(_text, first - back, body + back)").alias("piece"),
    )


def oversized(df: DataFrame, key: str, text: str, limit: int = 2000, overlap: int = 200) -> DataFrame:
    """(key, boundary) of the texts above ``limit``: the coarsest kind of cut that leaves no longer unit than limit - overlap."""
    rows = with_pieces(df.select(F.col(key).alias("_key"), F.col(text).alias("_text")), "_text", limit, overlap)
    return rows.filter(F.length("_text") > limit).select(F.col("_key").alias(key), text_boundary(F.col("_raw")).alias("boundary"))

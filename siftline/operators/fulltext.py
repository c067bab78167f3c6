"""Full-text index as tables: postings, lengths, BM25 search, and changes to the index."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftline.functions import constants as K
from siftline.functions.scoring import bm25_term
from siftline.functions.text import tokens, truncate
from siftline.runtime import bounded_broadcast, stage

FIELDS = ["content", "filename"]
#: Folders that postings are laid out in, by a hash of the term.
BUCKETS = 64


@dataclass
class TextIndex:
    """Postings (bucket, term, field, path, extension, tf, dl) laid out by bucket, and (field, n, avgdl) of all documents."""

    postings: DataFrame
    stats: DataFrame

    def of(self, terms: list[str]) -> DataFrame:
        """The postings of the terms; only their buckets are read."""
        wanted = [F.lit(t) for t in terms]
        buckets = [r[0] for r in self.postings.sparkSession.range(1).select(F.explode(F.array(*map(_bucket, wanted)))).distinct().collect()]
        return self.postings.filter(F.col("bucket").isin(buckets) & F.col("term").isin(terms))


def _bucket(term):
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def full_postings(docs: DataFrame) -> DataFrame:
    """The postings of a TextIndex; null texts are empty."""
    rows = docs.select("path", "extension", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), tokens(F.coalesce(F.col(f), F.lit(""))).alias("terms")) for f in FIELDS])).alias("x"))
    rows = rows.select("path", "extension", "x.field", F.size("x.terms").cast("long").alias("dl"), F.explode("x.terms").alias("term"))
    counted = rows.groupBy("term", "field", "path", "extension", "dl").agg(F.count("*").alias("tf"))
    return counted.select("term", "field", "path", "extension", "tf", "dl", _bucket(F.col("term")).alias("bucket"))


def field_stats(lengths: DataFrame) -> DataFrame:
    """(field, n, avgdl) of (path, field, dl)."""
    return lengths.groupBy("field").agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))


def build_index(docs: DataFrame) -> TextIndex:
    """A TextIndex in the shared folder."""
    return TextIndex(stage(full_postings(docs), "postings", by=("bucket", "term")), stage(field_stats(doc_lengths(docs)), "field-stats"))


def extractable(files: DataFrame) -> DataFrame:
    return files.filter(F.col("extension").isin(K.CONTENT_EXTENSIONS))


def extract_text(content):
    """The first bytes of a text file, as far as they are read."""
    return truncate(content, K.TEXT_BYTES)


def index_text(content):
    """The first bytes of a text, as far as they are indexed."""
    return truncate(content, K.INDEX_BYTES)


def postings(docs: DataFrame) -> DataFrame:
    """(term, field, path, tf) of the fields of (path, filename, content); one shuffle, counted before it."""
    fields = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), tokens(F.col(f)).alias("terms")) for f in FIELDS])).alias("x")
    return docs.select("path", fields).select("path", "x.field", F.explode("x.terms").alias("term")).groupBy("term", "field", "path").agg(F.count("*").alias("tf"))


def doc_lengths(docs: DataFrame) -> DataFrame:
    """(path, field, dl): terms of each field; no shuffle."""
    lengths = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.greatest(F.size(tokens(F.col(f))), F.lit(0)).alias("dl")) for f in FIELDS])).alias("x")
    return docs.select("path", lengths).select("path", "x.field", F.col("x.dl").cast("long").alias("dl"))


def term_stats(posts: DataFrame) -> DataFrame:
    """(term, field, df)."""
    return posts.groupBy("term", "field").agg(F.count("*").alias("df"))


def query_terms(query: str) -> list[str]:
    import re

    return list(dict.fromkeys(w for w in re.findall(r"[^\W_]+", query.lower()) if len(w.encode()) <= 40))


def matching(docs: DataFrame, terms: list[str]) -> DataFrame:
    """(path, extension, field, dl, tfs): length and count of each query term of every field, from one pass over the texts."""
    wanted = F.array(*[F.lit(t) for t in terms])
    fields = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), tokens(F.col(f)).alias("terms")) for f in FIELDS])).alias("x")
    kind = F.col("extension") if "extension" in docs.columns else F.lit(None).cast("string").alias("extension")
    rows = docs.select("path", kind, fields).select("path", "extension", "x.field", "x.terms")
    counted = F.transform(wanted, lambda t: F.size(F.filter("terms", lambda w: w == t)))
    return rows.select("path", "extension", "field", F.greatest(F.size("terms"), F.lit(0)).alias("dl"), counted.alias("tfs"))


def index_bm25(index: TextIndex, terms: list[str]) -> DataFrame:
    """(path, extension, score) of the documents that hold one of the terms, from the postings of these terms alone."""
    hits = index.of(terms)
    dfs = hits.groupBy("field", "term").agg(F.count("*").alias("df"))
    near = F.broadcast(dfs.join(F.broadcast(index.stats), "field"))  # a row per field and term of the query
    scored = hits.join(near, ["field", "term"])
    part = bm25_term(F.col("tf"), F.col("df"), F.col("dl"), F.col("n"), F.col("avgdl"))
    return scored.groupBy("path").agg(F.first("extension").alias("extension"), F.round(F.sum(part), 9).alias("score"))


def bm25(docs: DataFrame | TextIndex, query: str) -> DataFrame:
    """(path, extension, score) of the documents with a query term in any field; exact lengths, statistics over all documents.

    An index answers from the postings of the query's terms. Of a table of documents, the texts are passed once, leaving a few numbers a document in a staged table. Null texts are empty; a query without a
    word matches nothing.
    """
    terms = query_terms(query)
    indexed = isinstance(docs, TextIndex)
    if not terms:
        return (docs.stats if indexed else docs).sparkSession.createDataFrame([], "path string, extension string, score double")
    if indexed:
        return index_bm25(docs, terms)
    rows = stage(matching(docs, terms), "term-counts")
    dfs = F.array(*[F.sum(F.when(F.col("tfs")[i] > 0, 1).otherwise(0)) for i in range(len(terms))])
    stats = rows.groupBy("field").agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), dfs.alias("dfs"))
    hits = rows.filter(F.exists("tfs", lambda x: x > 0)).join(F.broadcast(stats), "field")  # one row a field
    part = F.lit(0.0)
    for i in range(len(terms)):
        part = part + F.when(F.col("tfs")[i] > 0, bm25_term(F.col("tfs")[i], F.col("dfs")[i], F.col("dl"), F.col("n"), F.col("avgdl"))).otherwise(0.0)
    return hits.groupBy("path").agg(F.first("extension").alias("extension"), F.round(F.sum(part), 9).alias("score"))


def content_search(docs: DataFrame | TextIndex, query: str, limit: int, extension: str | None = None, fuzzy: bool = False) -> DataFrame:
    """(path, extension, score): 4 x limit best, those below a fifth of the best dropped, then the type filter, then 2 x limit.

    With ``fuzzy``, fewer than three hits are filled up by documents with a word close to the whole query, at half score.
    """
    hits = bm25(docs, query)
    if fuzzy and hits.limit(3).count() < 3:
        close = fuzzy_hits(docs, query)
        hits = hits.unionByName(close.join(hits, "path", "left_anti"))
    top = hits.orderBy(F.desc("score"), "path").limit(4 * limit)
    kept = top.withColumn("best", F.max("score").over(Window.partitionBy(F.lit(1)))).filter("score >= 0.2 * best").drop("best")  # 4 x limit rows
    if extension:
        kept = kept.filter(F.col("extension") == extension)
    return kept.orderBy(F.desc("score"), "path").limit(2 * limit)


def osa_distance(query: str):
    """Optimal string alignment distance (a swap of neighbours counts 1) of each word to the query."""

    @F.pandas_udf(T.IntegerType())
    def distance(words: pd.Series) -> pd.Series:
        known: dict[str, int] = {}
        return words.map(lambda w: known.setdefault(w, _osa(w, query)) if w is not None else None)

    return distance


def _osa(a: str, b: str) -> int:
    two, one = None, list(range(len(b) + 1))
    for i in range(1, len(a) + 1):
        row = [i] + [0] * len(b)
        for j in range(1, len(b) + 1):
            row[j] = min(one[j] + 1, row[j - 1] + 1, one[j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                row[j] = min(row[j], two[j - 2] + 1)
        two, one = one, row
    return one[-1]


def close_terms(terms: DataFrame, query: str) -> DataFrame:
    """(term, distance) of the distinct (term) within 1 (query of 6 bytes at most) or 2 edits of the whole query."""
    q = query.lower()
    most = 1 if len(q.encode()) <= 6 else 2
    near = terms.filter(F.abs(F.length("term") - len(q)) <= most).select("term").distinct()
    return near.withColumn("distance", osa_distance(q)(F.col("term"))).filter(F.col("distance") <= most)


def fuzzy_hits(docs: DataFrame | TextIndex, query: str) -> DataFrame:
    """(path, extension, score): documents with a term close to the query, at half their BM25 score for those terms."""
    index = docs if isinstance(docs, TextIndex) else TextIndex(full_postings(docs), field_stats(doc_lengths(docs)))
    hits = index.postings.join(bounded_broadcast(close_terms(index.postings, query).select("term"), 100_000), "term", "left_semi")
    dfs = hits.groupBy("field", "term").agg(F.count("*").alias("df"))
    scored = hits.join(dfs, ["field", "term"]).join(F.broadcast(index.stats), "field")  # one row a field
    part = bm25_term(F.col("tf"), F.col("df"), F.col("dl"), F.col("n"), F.col("avgdl"))
    return scored.groupBy("path").agg(F.first("extension").alias("extension"), F.round(F.sum(part) * 0.5, 9).alias("score"))


def index_delete(posts: DataFrame, paths: DataFrame) -> DataFrame:
    return posts.join(paths.select("path"), "path", "left_anti")


def index_upsert(posts: DataFrame, docs: DataFrame) -> DataFrame:
    """Postings with the given documents in place of their old ones; a document without text is removed."""
    return index_delete(posts, docs).unionByName(postings(docs.filter("content is not null and content <> ''")))

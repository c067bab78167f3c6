"""Ranked search: filename, typo, content and semantic passes merged by path, boosted by use, sorted by tier and time."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions import constants as K
from siftline.functions.parse import DIRECTORY, parse_query
from siftline.functions.paths import extension_of, filename_of, under
from siftline.functions.scoring import content_score, recency, semantic_score, tier_bucket, type_bonus
from siftline.functions.text import filename_tier, snippet, typo_match
from siftline.operators.fulltext import TextIndex, content_search
from siftline.operators.fuzzy import fuzzy_score, may_match
from siftline.operators.interactions import for_candidates
from siftline.runtime import bounded_broadcast, stage

#: Content and semantic matches that are broadcast; more are joined by a shuffle.
MAX_MATCHES = 100_000


@dataclass
class Options:
    now: int
    limit: int = 30
    type: str | None = None
    prefixes: list[str] = field(default_factory=list)
    snippet_length: int = 200
    fuzzy: bool = True


def _eligible(kind: str | None, prefixes: list[str]) -> Column:
    inside = under(F.col("path"), prefixes)
    return inside if kind is None else inside & F.col("is_dir") if kind == DIRECTORY else inside & (F.col("extension") == kind)


def _bonus(now: int) -> Column:
    return recency(F.col("modified_ts"), now) + type_bonus(F.col("extension"))


def filename_hits(files: DataFrame, text: str, now: int) -> DataFrame:
    """(path, score) of the names that begin with or hold the query; an empty query matches none."""
    hits = files.withColumn("tier", filename_tier(F.col("filename"), text)).filter("tier is not null") if text else files.limit(0).withColumn("tier", F.lit(0.0))
    return hits.select("path", (F.col("tier") + _bonus(now)).alias("score"))


def fuzzy_filename_hits(files: DataFrame, text: str, now: int) -> DataFrame:
    """The same for names whose fuzzy score passes 12 a byte of the query, names that hold it or not."""
    scored = files.withColumn("fuzzy", fuzzy_score(text)(F.col("filename"))).filter(F.col("fuzzy") >= 12 * len(text.encode()))
    tier = F.coalesce(filename_tier(F.col("filename"), text), F.lit(K.FUZZY))
    return scored.select("path", (tier + F.col("fuzzy") / 100.0 + _bonus(now)).alias("score"))


def typo_hits(files: DataFrame, text: str, now: int) -> DataFrame:
    return files.filter(typo_match(F.col("filename"), text)).select("path", (K.TYPO + _bonus(now)).alias("score"))


def name_score(text: str, now: int, fuzzy: bool) -> Column:
    """Score of a file for its name, a typo hit taking the place of a lower score below the content tier; null without a hit."""
    tier = filename_tier(F.col("filename"), text) if text else F.lit(None).cast("double")
    typo, nudge = typo_match(F.col("filename"), text), F.lit(0.0)
    if fuzzy and text:
        found = fuzzy_score(text)(F.when(may_match(F.col("filename"), text), F.col("filename")))
        tier, nudge = F.when(found >= 12 * len(text.encode()), F.coalesce(tier, F.lit(K.FUZZY))), found / 100.0
    named, typo = tier + nudge + _bonus(now), F.when(typo, K.TYPO + _bonus(now))
    better = typo.isNotNull() & (named.isNull() | ((named < K.CONTENT) & (typo > named)))
    return F.when(better, typo).otherwise(named)


def merge(files: DataFrame, pool: Column | None, text: str, content: DataFrame | None, semantic: DataFrame | None, now: int, fuzzy: bool = False) -> DataFrame:
    """The passes merged by path in one pass over the files: names (where ``pool`` holds), (path, bm25) and (path, similarity).

    Content and semantic matches come limited, so they are broadcast if few. Those of no known file take what their path
    tells; their size stays unknown, as does that of all that no name brought in.
    """
    extra = None
    for other, value in ((content, "bm25"), (semantic, "similarity")):
        if other is not None:
            part = other.select("path", *[F.col(v) if v == value else F.lit(None).cast("double").alias(v) for v in ("bm25", "similarity")])
            extra = part if extra is None else extra.unionByName(part)
    score = name_score(text, now, fuzzy)
    score = score if pool is None else F.when(pool, score)
    rows = files.withColumn("name_score", score)
    if extra is None:
        out = rows.filter("name_score is not null").withColumn("bm25", F.lit(None).cast("double")).withColumn("similarity", F.lit(None).cast("double"))
    else:
        extra = stage(extra.groupBy("path").agg(F.max("bm25").alias("bm25"), F.max("similarity").alias("similarity"), F.lit(True).alias("matched")), "matches")
        out = rows.join(bounded_broadcast(extra, MAX_MATCHES), "path", "left").filter("name_score is not null or matched")
        known = extra.join(bounded_broadcast(files.select("path").join(bounded_broadcast(extra.select("path"), MAX_MATCHES), "path", "left_semi"), MAX_MATCHES), "path", "left_anti")
        out = out.unionByName(known, allowMissingColumns=True)
    out = out.withColumn("modified_ts", F.coalesce("modified_ts", F.lit(0)))
    unknown = F.col("is_dir").isNull()
    out = out.withColumn("extension", F.when(unknown, extension_of(F.col("path"))).otherwise(F.col("extension"))).withColumn("filename", F.when(unknown, filename_of(F.col("path"))).otherwise(F.col("filename")))
    of_content = F.when(F.col("bm25").isNotNull(), content_score(F.col("bm25"), F.col("modified_ts"), F.col("extension"), now))
    base = F.coalesce("name_score", of_content, semantic_score(F.col("similarity"), F.col("modified_ts"), F.col("extension"), now))
    both = F.when(F.col("name_score").isNotNull() & F.col("bm25").isNotNull(), K.BOTH + 50.0).otherwise(0.0)
    first = F.col("name_score").isNull() & F.col("bm25").isNull()
    near = F.when(~first & F.col("similarity").isNotNull(), K.BOTH + F.col("similarity") * 200.0).otherwise(0.0)
    kind = F.when(F.col("name_score").isNotNull(), "filename").when(F.col("bm25").isNotNull(), "content").otherwise("semantic")
    kind = F.when((both > 0) | (near > 0), "both").otherwise(kind)
    size = F.when(F.col("name_score").isNotNull() & (F.col("size_bytes") > 0), F.col("size_bytes"))
    return out.select("path", "filename", (base + both + near).alias("score"), kind.alias("match_type"), size.alias("size_bytes"), "modified_ts", "extension", F.coalesce("is_dir", F.lit(False)).alias("is_dir"))


def ranked(merged: DataFrame, interactions: DataFrame | None, now: int, limit: int) -> DataFrame:
    """With the use boost, in order of tier bucket, time and path; at least one row is asked for."""
    if interactions is not None:
        merged = stage(merged, "candidates")  # read for the candidates' events and for the list itself
        boosts = for_candidates(interactions, merged, now).select("path", "boost", "interactions")
        merged = merged.join(boosts, "path", "left").withColumn("score", F.col("score") + F.coalesce("boost", F.lit(0.0))).drop("boost")
    else:
        merged = merged.withColumn("interactions", F.lit(0).cast("long"))
    merged = merged.withColumn("interactions", F.coalesce("interactions", F.lit(0).cast("long"))).withColumn("bucket", tier_bucket(F.col("score")))
    return merged.orderBy(F.desc("bucket"), F.desc("modified_ts"), "path").limit(max(1, limit))


def unified_search(files: DataFrame, docs: DataFrame | TextIndex, query: str, options: Options, interactions: DataFrame | None = None, semantic: DataFrame | None = None) -> DataFrame:
    """One ranked list for a query over names, contents, given (path, similarity) matches and use.

    Columns: path, filename, score, match_type, size_bytes, modified_ts, extension, is_dir, interactions, bucket. A directory
    filter skips the content and semantic passes; semantic matches are not held to the type filter. Null names match nothing;
    empty tables give no rows.
    """
    text, kind, _ = (query, options.type, None) if options.type else parse_query(query)
    content = near = None
    if kind != DIRECTORY:
        content = content_search(docs, text, options.limit, kind, fuzzy=options.fuzzy).select("path", F.col("score").alias("bm25"))
        near = None if semantic is None else semantic.select("path", "similarity")
        if options.prefixes:
            content = content.filter(under(F.col("path"), options.prefixes))
            near = None if near is None else near.filter(under(F.col("path"), options.prefixes))
    pool = _eligible(kind, options.prefixes)
    return ranked(merge(files, pool, text, content, near, options.now, options.fuzzy), interactions, options.now, options.limit)


def with_snippets(results: DataFrame, docs: DataFrame, query: str, most: int = 200) -> DataFrame:
    """A snippet for the results that score 2000 at least and are no binary kind; joined after the limit."""
    text = parse_query(query).text
    read = F.substring("content", 1, K.SNIPPET_BYTES)
    have = docs.join(bounded_broadcast(results.select("path"), MAX_MATCHES), "path", "left_semi").select("path", snippet(read, text, most).alias("snip"))
    wanted = (F.col("score") >= K.CONTENT) & ~F.coalesce(F.col("extension").isin(K.BINARY_EXTENSIONS), F.lit(False))
    return results.join(have, "path", "left").withColumn("content_snippet", F.when(wanted, F.col("snip"))).drop("snip")


def scope_prefixes(files: DataFrame, scope: str, now: int, fuzzy: bool = False) -> list[str]:
    """Paths of the 20 best directories for a scope name; none found: no restriction."""
    top = ranked(merge(files.filter("is_dir"), None, scope, None, None, now, fuzzy), None, now, 20)
    return [r["path"] for r in top.select("path").collect()]  # 20 rows at most


def scoped_search(files: DataFrame, docs: DataFrame | TextIndex, query: str, options: Options, interactions: DataFrame | None = None, semantic: DataFrame | None = None) -> DataFrame:
    """``unified_search`` below the directories that an ``in:name`` in the query stands for."""
    text, kind, scope = parse_query(query)
    if scope:
        options.prefixes = [*options.prefixes, *scope_prefixes(files, scope, options.now, options.fuzzy)]
    if kind and not options.type:
        options.type = kind
    return unified_search(files, docs, text, options, interactions, semantic)

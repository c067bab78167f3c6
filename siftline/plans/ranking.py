"""Queries of ranking and vector search."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftline.functions import constants as K
from siftline.functions import scoring, values
from siftline.operators import search, vectors
from siftline.operators.search import Options
from siftline.plans import views as V
from siftline.plans.tables import _APPLIED, _EXT, _SHOW, REPLAYED
from siftline.plans.texts import _BONUS, _RECENCY, content_cte, tier_sql, typo_sql
from siftline.plans.views import NOW, sql
from siftline.runtime import stage

QUERY, TYPO, SCOPED = "archive", "archve", "mortgage in:documents"
_SHOWN = ["path", "bucket", "score", "match_type", "size_bytes", "modified_ts", "extension", "is_dir", "interactions"]


def _query_vector(spark, d) -> list[float]:
    """The vector of the first usable row."""
    rows = V.vectors(spark, d)
    return [float(x) for x in rows.filter(values.usable_vector(F.col("vector"), 64)).orderBy("vec_id").select("vector").head()[0]]


def _scored(df):
    return df.select("path", F.round("score", 6).alias("score"))


def _unified(query, semantic=False, **options):
    def run(spark, d):
        near = vectors.semantic_scan(V.vectors(spark, d), _query_vector(spark, d)) if semantic else None
        find = search.scoped_search if "in:" in query else search.unified_search
        out = find(V.files(spark, d), V.index(spark, d), query, Options(now=NOW, **options), V.interactions(spark, d), near)
        return out.select(*[F.round("score", 2).alias("score") if c == "score" else c for c in _SHOWN])

    return run


def _content_score(spark, d):
    hits = search.content_search(V.index(spark, d), QUERY, 30)
    times = V.files(spark, d).select("path", "modified_ts")
    rows = hits.join(times, "path", "left").withColumn("modified_ts", F.coalesce("modified_ts", F.lit(0)))
    return rows.select("path", F.round(scoring.content_score(F.col("score"), F.col("modified_ts"), F.col("extension"), NOW), 6).alias("score"))


def _both(spark, d):
    names = search.filename_hits(V.files(spark, d), QUERY, NOW)
    hits = search.content_search(V.index(spark, d), QUERY, 30).select("path")
    return names.join(hits, "path").select("path", F.round(F.col("score") + K.BOTH + 50.0, 6).alias("score"))


def _semantic_merge(spark, d):
    near = vectors.semantic_scan(V.vectors(spark, d), _query_vector(spark, d))
    files = V.files(spark, d)
    merged = search.merge(files, None, QUERY, None, near.select("path", "similarity"), NOW)
    return merged.select("path", F.round("score", 6).alias("score"), "match_type")


def _near(find):
    def run(spark, d):
        out = find(V.vectors(spark, d), _query_vector(spark, d))
        return out.select("path", "vec_id", F.round("similarity", 6).alias("similarity"))

    return run


def _result_json(spark, d):
    rows = _unified(QUERY, fuzzy=False)(spark, d)
    return rows.select("path", F.to_json(F.struct("path", "match_type", "is_dir", "interactions")).alias("json"))


def _product(spark, d):
    """The ranked list with the fuzzy pass, the fuzzy fallback of the content search, and snippets."""
    out = search.unified_search(V.files(spark, d), V.index(spark, d), QUERY, Options(now=NOW), V.interactions(spark, d))
    return search.with_snippets(out, V.docs(spark, d), QUERY).select("path", F.round("score", 2).alias("score"), "bucket", "match_type", "content_snippet")


def _stream(spark, d):
    """The journal replayed as a stream on snapshot 7, twice, snapshot 8 being what is there; the files table after it."""
    from uuid import uuid4

    from siftline.engine import Engine
    from siftline.runtime import checkpoint_dir
    from siftline.streaming import journal

    root = f"{checkpoint_dir(spark).rstrip('/')}/stream-{uuid4().hex}"
    engine = Engine(spark, root + "/store")
    columns = V.files(spark, d).columns
    engine.store.publish({"files": V.snapshot(spark, d, 7).select(columns)})
    V.changes(spark, d).repartitionByRange(4, "event_id").write.parquet(root + "/journal")
    listing = stage(V.snapshot(spark, d, 8).select(columns), "listing")
    for _ in range(2):
        journal.start(journal.read_journal(spark, root + "/journal"), engine, listing, root + "/checkpoint").awaitTermination()
    out = stage(engine.files(), "streamed")
    engine.store.files.remove("")
    return out.select(*_SHOW.split(", "))


QUERIES = {
    "filename_search": lambda s, d: _scored(search.filename_hits(V.files(s, d), QUERY, NOW)),
    "typo_search": lambda s, d: _scored(search.typo_hits(V.files(s, d), TYPO, NOW)),
    "content_score": _content_score,
    "both_match": _both,
    "semantic_merge": _semantic_merge,
    "unified_search": _unified(QUERY, fuzzy=False),
    "unified_search_type": _unified(QUERY + " md", fuzzy=False),
    "unified_search_dir": _unified("/doc", fuzzy=False),
    "unified_search_typo": _unified(TYPO, fuzzy=False),
    "unified_search_semantic": _unified(QUERY, semantic=True, fuzzy=False),
    "unified_product": _product,
    "scoped_search": _unified(SCOPED, fuzzy=False),
    "cosine": _near(vectors.similarities),
    "semantic_scan": _near(vectors.semantic_scan),
    "semantic_topk": _near(lambda v, q: vectors.semantic_topk(v, q, 50)),
    "semantic_ann": _near(lambda v, q: vectors.semantic_ann(v, q, 20)),
    "result_json": _result_json,
    "stream_sync": _stream,
}

_DOUBLES = "list_transform(vector, lambda x: CAST(x AS DOUBLE))"
_FIT = "len(vector) = 64 AND len(list_filter(vector, lambda x: isnan(x) OR isinf(x))) = 0"
_SEM = {
    "vectors_v": V.CTE["vectors_v"],
    "qv": f"SELECT {_DOUBLES} AS q FROM vectors_v WHERE {_FIT} ORDER BY vec_id LIMIT 1",
    "sims": f"""SELECT path, vec_id, mtime, CASE WHEN n = 0 OR m = 0 THEN 0 ELSE p / (sqrt(n) * sqrt(m)) END AS similarity FROM
  (SELECT path, vec_id, mtime, list_dot_product(v, q) AS p, list_dot_product(v, v) AS n, list_dot_product(q, q) AS m FROM (SELECT path, vec_id, mtime, {_DOUBLES} AS v FROM vectors_v WHERE {_FIT}), qv)""",
    "sem": f"SELECT path, vec_id, similarity FROM sims WHERE vec_id IN (SELECT vec_id FROM vectors_v ORDER BY mtime DESC, vec_id DESC LIMIT {K.RECENT_VECTORS}) AND similarity >= {K.COSINE_FLOOR}",
}
_NEAR = "SELECT path, vec_id, round(similarity, 6) AS similarity FROM "
_DECAY = " ".join(f"WHEN timestamp >= {NOW - days * 86400} THEN {w}" for days, w in K.DECAY)
_BUCKET = "CASE " + " ".join(f"WHEN score >= {a} THEN {b}" for a, b in K.BUCKETS) + " ELSE 1 END"


def names_cte(query: str, where: str = "true") -> dict[str, str]:
    """Common table expressions up to ``nm`` (path, name_score)."""
    return {
        "files_v": V.CTE["files_v"],
        "nb": f"SELECT path, {tier_sql(query)} AS tier, {typo_sql(query)} AS typo, {_RECENCY} + {_BONUS} AS bonus FROM files_v WHERE {where}",
        "nm": """SELECT * FROM (SELECT path, CASE WHEN typo AND (tier IS NULL OR (tier + bonus < 2000 AND 3000 + bonus > tier + bonus)) THEN 3000 + bonus ELSE tier + bonus END AS name_score FROM nb)
  WHERE name_score IS NOT NULL""",
    }


def merged_cte(content: bool, semantic: bool) -> dict[str, str]:
    """Common table expressions up to ``mg``, after ``nm``, ``cs`` and ``sem``."""
    c = "SELECT path, score AS bm25 FROM cs" if content else "SELECT NULL AS path, NULL AS bm25 WHERE false"
    s = "SELECT path, similarity FROM sem" if semantic else "SELECT NULL AS path, NULL AS similarity WHERE false"
    return {
        "pc": c, "ps": s,
        "pa": "SELECT path FROM nm UNION SELECT path FROM pc UNION SELECT path FROM ps",
        "mb": f"""SELECT pa.path, name_score, bm25, similarity, coalesce(f.modified_ts, 0) AS modified_ts, CASE WHEN f.path IS NULL THEN {_EXT.replace('path', 'pa.path')} ELSE f.extension END AS extension,
  CASE WHEN name_score IS NOT NULL AND f.size_bytes > 0 THEN f.size_bytes END AS size_bytes, coalesce(f.is_dir, false) AS is_dir
  FROM pa LEFT JOIN nm ON nm.path = pa.path LEFT JOIN pc ON pc.path = pa.path LEFT JOIN ps ON ps.path = pa.path LEFT JOIN files_v f ON f.path = pa.path""",
        "mg": f"""SELECT *, coalesce(name_score, CASE WHEN bm25 IS NOT NULL THEN 2000 + least(bm25 * 30, 500) + 50 + {_RECENCY} + {_BONUS} END, 1500 + similarity * 500 + {_RECENCY} + {_BONUS})
  + CASE WHEN name_score IS NOT NULL AND bm25 IS NOT NULL THEN 550 ELSE 0 END
  + CASE WHEN (name_score IS NOT NULL OR bm25 IS NOT NULL) AND similarity IS NOT NULL THEN 500 + similarity * 200 ELSE 0 END AS base,
  CASE WHEN (CASE WHEN name_score IS NULL THEN 0 ELSE 1 END) + (CASE WHEN bm25 IS NULL THEN 0 ELSE 1 END) + (CASE WHEN similarity IS NULL THEN 0 ELSE 1 END) > 1 THEN 'both'
    WHEN name_score IS NOT NULL THEN 'filename' WHEN bm25 IS NOT NULL THEN 'content' ELSE 'semantic' END AS match_type FROM mb""",
    }


_RANKED = f"""SELECT path, {_BUCKET} AS bucket, round(score, 2) AS score, match_type, size_bytes, modified_ts, extension, is_dir, interactions FROM
  (SELECT mg.*, base + CASE WHEN w IS NULL THEN 0 ELSE least(ln(w + 1) * 150, 500) END AS score, coalesce(n, 0) AS interactions FROM mg LEFT JOIN
  (SELECT path, CAST(sum(CASE {_DECAY} ELSE 0 END) AS DOUBLE) AS w, count(*) AS n FROM interactions WHERE path IS NOT NULL GROUP BY path) i USING (path))
  ORDER BY bucket DESC, modified_ts DESC, path LIMIT 30"""


def unified_sql(query: str, kind: str | None = None, content: bool = True, semantic: bool = False, where: str = "true") -> str:
    of_kind = "is_dir" if kind == "__dir__" else f"extension = '{kind}'" if kind else "true"
    parts = names_cte(query, f"({where}) AND {of_kind}")
    parts |= content_cte(query, 30, kind) if content else {}
    if content and where != "true":
        parts["cs"] = f"SELECT * FROM ({parts['cs']}) WHERE {where}"
    parts |= _SEM if semantic else {}
    return sql(_RANKED, **parts, **merged_cte(content, semantic))


_SCOPE = {k + "_s": v.replace("files_v", "files_v") for k, v in names_cte("documents", "is_dir").items() if k != "files_v"}
_SCOPE["nm_s"] = _SCOPE["nm_s"].replace("FROM nb", "FROM nb_s")
_SCOPE |= {"sc": f"SELECT path FROM (SELECT nm_s.path, name_score AS score, modified_ts FROM nm_s JOIN files_v USING (path)) ORDER BY {_BUCKET} DESC, modified_ts DESC, path LIMIT 20"}
_IN_SCOPE = "(NOT EXISTS (SELECT 1 FROM sc) OR EXISTS (SELECT 1 FROM sc WHERE starts_with(%spath, sc.path)))"
_SCOPED_CS = content_cte("mortgage", 30)
_SCOPED_CS["cs"] = f"SELECT * FROM ({_SCOPED_CS['cs']}) z WHERE {_IN_SCOPE % 'z.'}"

ORACLE = {
    "filename_search": sql(f"SELECT path, round(tier + {_RECENCY} + {_BONUS}, 6) AS score FROM (SELECT *, {tier_sql(QUERY)} AS tier FROM files_v) WHERE tier IS NOT NULL"),
    "typo_search": sql(f"SELECT path, round(3000 + {_RECENCY} + {_BONUS}, 6) AS score FROM files_v WHERE {typo_sql(TYPO)}"),
    "content_score": sql(f"SELECT path, round(2000 + least(score * 30, 500) + 50 + {_RECENCY} + {_BONUS}, 6) AS score FROM (SELECT cs.path, cs.extension, cs.score, coalesce(f.modified_ts, 0) AS modified_ts FROM cs LEFT JOIN files f USING (path))", **content_cte(QUERY, 30)),
    "both_match": sql(f"SELECT path, round(tier + {_RECENCY} + {_BONUS} + 550, 6) AS score FROM (SELECT *, {tier_sql(QUERY)} AS tier FROM files_v) WHERE tier IS NOT NULL AND path IN (SELECT path FROM cs)", **content_cte(QUERY, 30)),
    "semantic_merge": sql("SELECT path, round(base, 6) AS score, match_type FROM mg", **names_cte(QUERY), **_SEM, **merged_cte(False, True)),
    "unified_search": unified_sql(QUERY),
    "unified_search_type": unified_sql(QUERY, "md"),
    "unified_search_dir": unified_sql("doc", "__dir__", content=False),
    "unified_search_typo": unified_sql(TYPO),
    "unified_search_semantic": unified_sql(QUERY, semantic=True),
    "scoped_search": sql(_RANKED, files_v=V.CTE["files_v"], **_SCOPE, **{k: v for k, v in names_cte("mortgage", _IN_SCOPE % "files_v.").items() if k != "files_v"}, **_SCOPED_CS, **merged_cte(True, False)),
    "cosine": sql(_NEAR + "sims", **_SEM),
    "semantic_scan": sql(_NEAR + "sem", **_SEM),
    "semantic_topk": sql(_NEAR + f"(SELECT * FROM sims WHERE similarity >= {K.COSINE_FLOOR} ORDER BY similarity DESC, vec_id LIMIT 50)", **_SEM),
    "result_json": sql("""SELECT path, '{"path":' || to_json(path) || ',"match_type":"' || match_type || '","is_dir":' || is_dir || ',"interactions":' || interactions || '}' AS json FROM u""",
        u=unified_sql(QUERY)),
    "stream_sync": sql(REPLAYED, indexed_v=V.CTE["indexed_v"], **_APPLIED),
}

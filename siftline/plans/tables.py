"""Queries of scans, filters, joins and aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftline.functions import constants as K
from siftline.functions import paths as P
from siftline.operators import fulltext, interactions, pending, recents, sync, tables
from siftline.plans import views as V
from siftline.plans.views import NOW, quoted, sql
from siftline.sources import extract, scan

_SHOW = "path, filename, extension, size_bytes, modified_ts, is_dir"
_ROOTS = ["/home/desk01", "/mnt/share"]
_EXCLUDED = " OR ".join(
    f"regexp_matches('/' || path || '/', '/[^/]*{p[1:].replace('.', chr(92) + '.')}/')" if p.startswith("*") else f"contains('/' || path || '/', '/{p}/')" for p in K.DEFAULT_EXCLUDES
)
_HOME = " OR ".join(f"contains('/' || path || '/', '/{p}/')" for p in K.HOME_EXCLUDES)
_OS = " OR ".join(f"path = '{p}' OR starts_with(path, '{p}/')" for p in K.OS_EXCLUDES)
_UNLIKE = " AND ".join(f"path NOT ILIKE '{p}'" for p in K.RECENT_EXCLUDED_PATHS)
_NAME = "regexp_extract(path, '[^/]*$')"
_EXT = f"CASE WHEN contains(substr({_NAME}, 2), '.') THEN lower(regexp_extract({_NAME}, '[^.]*$')) END"
_SCAN = f"""SELECT path, {_NAME} AS filename, {_EXT} AS extension, size_bytes, modified_ts, false AS is_dir FROM files_v
  WHERE NOT is_dir AND NOT ({_EXCLUDED}) AND size_bytes <= {K.FILE_BYTES}"""
_SCANNED = f"""SELECT * FROM scan_f UNION ALL SELECT path, {_NAME}, NULL, 0, modified_ts, true FROM
  (SELECT regexp_replace(path, '/[^/]*$', '') AS path, max(modified_ts) AS modified_ts FROM scan_f GROUP BY 1) WHERE path <> ''"""
_SHOWN = f"NOT is_dir AND extension NOT IN ({quoted(K.RECENT_EXCLUDED)}) AND NOT starts_with(filename, '.')"
_UNDER_ROOT = "EXISTS (SELECT 1 FROM roots_v r WHERE path = r.root OR starts_with(path, r.root || '/'))"


def _files(columns=_SHOW, where=None):
    def run(spark, d):
        out = V.files(spark, d)
        return (out if where is None else out.filter(where())).select(*columns.split(", "))

    return run


def _below(excluded, names):
    """Files whose paths are below some artefact by turns, those kept."""
    def run(spark, d):
        rows = V.files(spark, d)
        at = F.element_at(F.array(*map(F.lit, names)), (F.pmod(F.length("path"), F.lit(len(names))) + 1).cast("int"))
        return rows.withColumn("path", F.concat(at, "path")).filter(~excluded(F.col("path"))).select(*_SHOW.split(", "))

    return run


def _below_sql(names, where):
    moved = f"SELECT [{quoted(names)}][length(path) % {len(names)} + 1] || path AS path, filename, extension, size_bytes, modified_ts, is_dir FROM files_v"
    return sql(f"SELECT {_SHOW} FROM ({moved}) WHERE NOT ({where})")


_ARTEFACTS = ["", "/a/node_modules", "/x.egg-info/b", "/home/u/.cargo", "/targets", "/u/Library/Caches/z", "/u/Library/z", "/u/.git"]
_HOMES = ["", "/u/.cache", "/u/.local/share/Trash/x", "/u/.local/share", "/u/cache"]
_SYSTEMS = ["", "/proc", "/sys/x", "/devices", "/boot", "/home/boot"]


def _scan(spark, d):
    listing = V.files(spark, d).filter("not is_dir").select("path", "size_bytes", "modified_ts")
    return scan.scanned(listing).drop("created_ts")


def _point(spark, d):
    rows = V.files(spark, d)
    first = rows.agg(F.min("path").alias("path"))
    return rows.join(F.broadcast(first), "path").select("path", "modified_ts", "size_bytes")  # first is one row


def _add_path(spark, d):
    more = V.snapshot(spark, d, 8).filter(P.under_roots(F.col("path"), ["/home/desk01/Projects"]))
    return tables.upsert(V.files(spark, d), more.select(V.files(spark, d).columns)).select(*_SHOW.split(", "))


def _ocr_lines(spark, d):
    rows = V.read(spark, d, "ocr_results")
    return rows.select(F.to_json(F.struct(F.col("ocr_id").cast("string").alias("path"), "text", "confidence", "exif", "error")).alias("value"))


def _interaction_decay(spark, d):
    data = interactions.interaction_data(V.interactions(spark, d), NOW)
    return data.select("path", F.round("weight", 6).alias("weight"), F.round("boost", 6).alias("boost"), "interactions")


def _interaction_boost(spark, d):
    data = interactions.for_candidates(V.interactions(spark, d), V.docs(spark, d), NOW)
    return data.select("path", F.round("boost", 6).alias("boost"), "interactions")


def _hashed(spark, d):
    """Documents with the hash they would be embedded under: that of the stored vector where the text is of even length."""
    had = V.vectors(spark, d).select("path", F.col("embed_hash").alias("h"), F.col("mtime").alias("m"))
    rows = V.docs(spark, d).join(had, "path", "left")
    even = F.length("content") % 2 == 0
    return rows.select("path", F.coalesce(F.col("m") + 1, F.lit(NOW)).alias("mtime"), F.when(even & F.col("h").isNotNull(), F.col("h")).otherwise(F.sha2("content", 256)).alias("embed_hash"))


def _journal(spark, d, deletes: bool):
    updates, gone = sync.journal_apply(V.changes(spark, d), V.snapshot(spark, d, 8))
    return gone.select("path") if deletes else updates.select(*_SHOW.split(", "))


def _journal_apply(spark, d):
    return _journal(spark, d, False).select("path", F.lit("update").alias("change")).unionByName(_journal(spark, d, True).select("path", F.lit("delete").alias("change")))


def _flags(spark, d):
    rows = V.read(spark, d, "interactions").withColumn("flags", F.pmod(F.col("id") * 7919, F.lit(131072)))
    return rows.select(F.col("id").alias("event_id"), sync.journal_flags(F.col("flags")).alias("c")).filter("c is not null").select("event_id", "c.*")


def _diff(which):
    def run(spark, d):
        new, old = V.snapshot(spark, d, 8), V.snapshot(spark, d, 7)
        out = {"new": lambda: sync.diff_new(new, old), "modified": lambda: sync.diff_modified(new, old), "deleted": lambda: sync.diff_deleted(new, old, V.complete_roots(spark, d, 8))}[which]()
        return out.select(*_SHOW.split(", "))

    return run


def _changed(spark, d):
    new, old = V.snapshot(spark, d, 8), V.snapshot(spark, d, 7)
    return sync.changed_for_content(sync.diff_new(new, old), sync.diff_modified(new, old))


_LAST_SYNC, _HOT = 1704067200, ["/home/desk01/Downloads", "/home/desk02/Documents"]


def _quick(spark, d):
    return sync.quick_sync(V.snapshot(spark, d, 8), V.snapshot(spark, d, 7), _HOT, _LAST_SYNC, V.complete_roots(spark, d, 8))


def _drift(spark, d):
    counts = V.docs(spark, d).agg(F.count("*").alias("indexed")).crossJoin(fulltext.extractable(V.files(spark, d)).agg(F.count("*").alias("expected")))  # one row each
    found = counts.head()
    return counts.withColumn("drifted", F.lit(sync.drifted(found["indexed"], found["expected"])))


def _doctor(spark, d):
    f = V.files(spark, d)
    return scan.scan_stats(f).crossJoin(V.docs(spark, d).agg(F.count("*").alias("documents"))).crossJoin(V.vectors(spark, d).agg(F.count("*").alias("vectors")))  # one row each


QUERIES = {
    "files_all": _files("path, filename, extension, size_bytes, modified_ts, is_dir, created_ts"),
    "files_by_mtime": lambda s, d: V.files(s, d).select("path", "filename", "extension", "modified_ts").orderBy(F.desc("modified_ts"), "path"),
    "point_lookup": _point,
    "path_parts": lambda s, d: V.files(s, d).select("path", P.filename_of(F.col("path")).alias("name"), P.extension_of(F.col("path")).alias("ext")),
    "type_filter": _files(where=lambda: F.col("extension") == "pdf"),
    "dir_filter": _files(where=lambda: F.col("is_dir")),
    "path_filter": _files(where=lambda: P.under(F.col("path"), _ROOTS)),
    "exclude_default": _below(P.excluded_default, _ARTEFACTS),
    "exclude_home": _below(P.excluded_home, _HOMES),
    "exclude_os": _below(P.excluded_os, _SYSTEMS),
    "scan_files": _scan,
    "scan_stats": lambda s, d: scan.scan_stats(V.files(s, d)),
    "dir_size": lambda s, d: scan.dir_sizes(V.files(s, d)),
    "add_path": _add_path,
    "recent_files": lambda s, d: recents.recent_files(V.files(s, d), 50).select(*_SHOW.split(", ")),
    "recent_scoped": lambda s, d: recents.recent_scoped(V.files(s, d), 50, _ROOTS).select(*_SHOW.split(", ")),
    "recent_raw": lambda s, d: recents.recent_raw(V.files(s, d), 50).select(*_SHOW.split(", ")),
    "ocr_json": lambda s, d: extract.parse_ocr_lines(_ocr_lines(s, d)),
    "pending_ocr": lambda s, d: pending.pending_ocr(V.files(s, d), V.ocr_status(s, d)),
    "pending_embed": lambda s, d: pending.pending_embed(V.files(s, d), V.vectors(s, d)),
    "ocr_stats": lambda s, d: pending.coverage(V.files(s, d), V.ocr_status(s, d), K.OCR_EXTENSIONS),
    "semantic_stats": lambda s, d: pending.coverage(V.files(s, d), V.vectors(s, d), K.EMBED_EXTENSIONS),
    "file_count": lambda s, d: V.files(s, d).agg(F.count("*").alias("files")),
    "max_mtime": lambda s, d: V.files(s, d).agg(F.coalesce(F.max("modified_ts"), F.lit(0)).alias("max_mtime")),
    "doc_count": lambda s, d: V.docs(s, d).agg(F.countDistinct("path").alias("documents")),
    "interaction_decay": _interaction_decay,
    "interaction_boost": _interaction_boost,
    "interaction_prune": lambda s, d: tables.prune_interactions(V.interactions(s, d), NOW).groupBy("action").agg(F.count("*").alias("n")),
    "embed_skip": lambda s, d: pending.embed_skip(_hashed(s, d), V.vectors(s, d)),
    "vec_invalidate": lambda s, d: tables.delete(V.vectors(s, d), _journal_apply(s, d)).select("path", "vec_id"),
    "latest_state": lambda s, d: tables.latest(V.changes(s, d), "path", "event_id"),
    "journal_flags": _flags,
    "journal_apply": _journal_apply,
    "journal_replay": lambda s, d: tables.upsert(tables.delete(V.snapshot(s, d, 7), _journal(s, d, True)).select(*_SHOW.split(", ")), _journal(s, d, False)),
    "diff_new": _diff("new"), "diff_modified": _diff("modified"), "diff_deleted": _diff("deleted"),
    "changed_for_content": _changed,
    "dir_prune": lambda s, d: sync.pruned_listing(V.snapshot(s, d, 8), _LAST_SYNC).select("path", "modified_ts"),
    "quick_sync": _quick,
    "drift": _drift,
    "doctor": _doctor,
}

_PRUNED = f"""SELECT l.path, l.modified_ts FROM (SELECT *, regexp_replace(path, '/[^/]*$', '') AS parent FROM scanned_v WHERE NOT is_dir) l
  LEFT JOIN (SELECT path AS parent, modified_ts AS dir_ts FROM scanned_v WHERE is_dir) p USING (parent)
  WHERE NOT (len(string_split(parent, '/')) - 1 > 5) OR dir_ts IS NULL OR dir_ts > {_LAST_SYNC}"""
_HOTS = " OR ".join(f"path = '{r}' OR starts_with(path, '{r}/')" for r in _HOT)
_LAST = "SELECT * FROM changes_v QUALIFY row_number() OVER (PARTITION BY path ORDER BY event_id DESC) = 1"
# the journal is replayed on snapshot 7, snapshot 8 being what is there now
_APPLY = """SELECT path, 'update' AS change FROM scanned_v WHERE path IN (SELECT path FROM last_c WHERE NOT must_scan_dir)
    OR (NOT is_dir AND regexp_replace(path, '/[^/]*$', '') IN (SELECT path FROM last_c WHERE must_scan_dir))
  UNION ALL SELECT path, 'delete' FROM last_c WHERE NOT must_scan_dir AND (removed OR renamed) AND path NOT IN (SELECT path FROM scanned_v)"""
_APPLIED = {"scanned_v": V.CTE["scanned_v"], "changes_v": V.CTE["changes_v"], "last_c": _LAST, "applied": _APPLY}
REPLAYED = f"""SELECT {_SHOW} FROM indexed_v WHERE path NOT IN (SELECT path FROM applied) UNION ALL SELECT {_SHOW} FROM scanned_v WHERE path IN (SELECT path FROM applied WHERE change = 'update')"""
_DECAY = " ".join(f"WHEN timestamp >= {NOW - days * 86400} THEN {w}" for days, w in K.DECAY)
_META = """concat_ws(' ', CASE WHEN exif.date_taken IS NOT NULL THEN '[Date: ' || split_part(exif.date_taken, 'T', 1) || ']' END,
  CASE WHEN exif.gps IS NOT NULL THEN '[Location: ' || exif.gps || ']' END)"""
_PENDING = f"""SELECT f.path, f.filename, f.extension, f.modified_ts FROM files_v f LEFT JOIN %s o ON o.path = f.path
  WHERE f.extension IN (%s) AND {_UNLIKE.replace('path', 'f.path').replace('%', '%%')} AND (o.path IS NULL OR o.%s <> f.modified_ts)"""
_COVER = "SELECT (SELECT count(*) FROM files_v WHERE extension IN (%s)) AS total, (SELECT count(*) FROM %s) AS completed"

ORACLE = {
    "files_all": sql("SELECT * FROM files_v"),
    "files_by_mtime": sql("SELECT path, filename, extension, modified_ts FROM files_v"),
    "point_lookup": sql("SELECT path, modified_ts, size_bytes FROM files_v WHERE path = (SELECT min(path) FROM files_v)"),
    "path_parts": sql(f"SELECT path, {_NAME} AS name, {_EXT} AS ext FROM files_v"),
    "type_filter": sql(f"SELECT {_SHOW} FROM files_v WHERE extension = 'pdf'"),
    "dir_filter": sql(f"SELECT {_SHOW} FROM files_v WHERE is_dir"),
    "path_filter": sql(f"SELECT {_SHOW} FROM files_v WHERE " + " OR ".join(f"starts_with(path, '{r}')" for r in _ROOTS)),
    "exclude_default": _below_sql(_ARTEFACTS, _EXCLUDED),
    "exclude_home": _below_sql(_HOMES, _HOME),
    "exclude_os": _below_sql(_SYSTEMS, _OS),
    "scan_files": sql("SELECT * FROM scan_a", scan_f=_SCAN, scan_a=_SCANNED),
    "scan_stats": sql("SELECT count(*) FILTER (NOT is_dir) AS files, count(*) FILTER (is_dir) AS dirs, CAST(sum(size_bytes) AS BIGINT) AS bytes FROM files_v"),
    "dir_size": sql("SELECT path, CAST(sum(size_bytes) AS BIGINT) AS bytes, count(*) AS files FROM up WHERE path <> '' GROUP BY path",
        up="SELECT unnest(list_transform(range(1, len(string_split(path, '/'))), lambda i: array_to_string(string_split(path, '/')[1:i], '/'))) AS path, size_bytes FROM files_v WHERE NOT is_dir"),
    "add_path": sql(f"SELECT {_SHOW} FROM files_v WHERE path NOT IN (SELECT path FROM more) UNION ALL SELECT {_SHOW} FROM more",
        more="SELECT * FROM scanned_v WHERE path = '/home/desk01/Projects' OR starts_with(path, '/home/desk01/Projects/')"),
    "recent_files": sql(f"SELECT {_SHOW} FROM files_v WHERE {_SHOWN} AND {_UNLIKE} ORDER BY modified_ts DESC, path LIMIT 50"),
    "recent_scoped": sql(f"SELECT {_SHOW} FROM (SELECT * FROM files_v WHERE {_SHOWN} ORDER BY modified_ts DESC, path LIMIT 1000) WHERE " + " OR ".join(f"starts_with(path, '{r}')" for r in _ROOTS) + " ORDER BY modified_ts DESC, path LIMIT 50"),
    "recent_raw": sql(f"SELECT {_SHOW} FROM files_v WHERE NOT is_dir ORDER BY modified_ts DESC, path LIMIT 50"),
    "ocr_json": f"""SELECT CAST(ocr_id AS VARCHAR) AS path, coalesce(confidence, 0) AS confidence, CASE WHEN coalesce(confidence, 0) < {K.OCR_CONFIDENCE} THEN ''
  WHEN {_META} <> '' THEN {_META} || ' ' || coalesce(text, '') ELSE coalesce(text, '') END AS text FROM ocr_results WHERE error IS NULL""",
    "pending_ocr": sql("SELECT path, modified_ts FROM (" + _PENDING % ("ocr_v", quoted(K.OCR_EXTENSIONS), "modified_ts") + ")"),
    "pending_embed": sql(_PENDING % ("vectors_v", quoted(K.EMBED_EXTENSIONS), "mtime")),
    "ocr_stats": sql(_COVER % (quoted(K.OCR_EXTENSIONS), "ocr_v")),
    "semantic_stats": sql(_COVER % (quoted(K.EMBED_EXTENSIONS), "vectors_v")),
    "file_count": sql("SELECT count(*) AS files FROM files_v"),
    "max_mtime": sql("SELECT coalesce(max(modified_ts), 0) AS max_mtime FROM files_v"),
    "doc_count": sql("SELECT count(DISTINCT path) AS documents FROM docs_v"),
    "interaction_decay": f"""SELECT path, round(w, 6) AS weight, round(least(ln(w + 1) * 150, 500), 6) AS boost, interactions FROM
  (SELECT path, CAST(sum(CASE {_DECAY} ELSE 0 END) AS DOUBLE) AS w, count(*) AS interactions FROM interactions WHERE path IS NOT NULL GROUP BY path)""",
    "interaction_boost": sql(f"""SELECT path, round(least(ln(w + 1) * 150, 500), 6) AS boost, interactions FROM
  (SELECT path, CAST(sum(CASE {_DECAY} ELSE 0 END) AS DOUBLE) AS w, count(*) AS interactions FROM interactions WHERE path IN (SELECT path FROM docs_v) GROUP BY path)"""),
    "interaction_prune": f"SELECT action, count(*) AS n FROM interactions WHERE timestamp >= {NOW - 365 * 86400} GROUP BY action",
    "embed_skip": sql("SELECT path, mtime, embed_hash, CASE WHEN h = embed_hash THEN 'touch' ELSE 'embed' END AS todo FROM c",
        c=f"""SELECT d.path, coalesce(v.mtime + 1, {NOW}) AS mtime, CASE WHEN length(content) % 2 = 0 AND v.embed_hash IS NOT NULL THEN v.embed_hash ELSE sha256(content) END AS embed_hash, v.embed_hash AS h
  FROM docs_v d LEFT JOIN vectors_v v USING (path)"""),
    "vec_invalidate": sql("SELECT path, vec_id FROM vectors_v WHERE path NOT IN (SELECT path FROM applied)", **_APPLIED),
    "latest_state": sql(_LAST),
    "journal_flags": """SELECT event_id, NOT s AND f & 256 > 0 AS created, NOT s AND f & 4096 > 0 AS modified, NOT s AND f & 512 > 0 AS removed, NOT s AND f & 2048 > 0 AS renamed, s AS must_scan_dir
  FROM (SELECT id AS event_id, (id * 7919) % 131072 AS f, ((id * 7919) % 131072) & 1 > 0 AS s FROM interactions) WHERE f & 16 = 0 AND (s OR (f & 65536 > 0 AND f & 6912 > 0))""",
    "journal_apply": sql("SELECT * FROM applied", **_APPLIED),
    "journal_replay": sql(REPLAYED, indexed_v=V.CTE["indexed_v"], **_APPLIED),
    "diff_new": sql(f"SELECT {_SHOW} FROM scanned_v WHERE path NOT IN (SELECT path FROM indexed_v)"),
    "diff_modified": sql(f"SELECT {', '.join('s.' + c for c in _SHOW.split(', '))} FROM scanned_v s JOIN indexed_v i USING (path) WHERE s.modified_ts > i.modified_ts"),
    "diff_deleted": sql(f"SELECT {_SHOW} FROM indexed_v WHERE path NOT IN (SELECT path FROM scanned_v) AND {_UNDER_ROOT}"),
    "changed_for_content": sql("""SELECT path, filename, extension FROM scanned_v s WHERE path NOT IN (SELECT path FROM indexed_v)
  UNION ALL SELECT s.path, s.filename, s.extension FROM scanned_v s JOIN indexed_v i USING (path) WHERE s.modified_ts > i.modified_ts"""),
    "dir_prune": sql(_PRUNED),
    "quick_sync": sql(f"""SELECT path, 'added' AS change FROM seen WHERE path NOT IN (SELECT path FROM indexed_v)
  UNION ALL SELECT s.path, 'modified' FROM seen s JOIN indexed_v i USING (path) WHERE s.modified_ts > i.modified_ts
  UNION ALL SELECT path, 'deleted' FROM indexed_v WHERE NOT is_dir AND path NOT IN (SELECT path FROM scanned_v) AND {_UNDER_ROOT}""",
        scanned_v=V.CTE["scanned_v"], seen=f"SELECT path, modified_ts FROM scanned_v WHERE NOT is_dir AND ({_HOTS}) UNION {_PRUNED}"),
    "drift": sql(f"SELECT indexed, expected, expected > 0 AND indexed < 0.85 * expected AS drifted FROM (SELECT (SELECT count(*) FROM docs_v) AS indexed, (SELECT count(*) FROM files_v WHERE extension IN ({quoted(K.CONTENT_EXTENSIONS)})) AS expected)"),
    "doctor": sql("""SELECT count(*) FILTER (NOT is_dir) AS files, count(*) FILTER (is_dir) AS dirs, CAST(sum(size_bytes) AS BIGINT) AS bytes,
  (SELECT count(*) FROM docs_v) AS documents, (SELECT count(*) FROM vectors_v) AS vectors FROM files_v"""),
}

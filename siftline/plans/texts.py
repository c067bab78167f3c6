"""Queries of scalar functions and the full-text index."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftline.functions import constants as K
from siftline.functions import parse, scoring, text, values
from siftline.operators import fulltext, tables
from siftline.operators.fuzzy import fuzzy_score
from siftline.plans import views as V
from siftline.plans.views import NOW, sql
from siftline.sources import extract

TERMS = "transfer archive"


def _names(**columns):
    return lambda s, d: V.files(s, d).select("path", *[f(F.col("filename")).alias(n) for n, f in columns.items()])


def _docs(**columns):
    return lambda s, d: V.docs(s, d).select("path", *[f(F.col("content")).alias(n) for n, f in columns.items()])


def _parse(spark, d):
    """The mini-syntax applied to every evaluation query, with a filter and a scope put in by turns."""
    found = V.read(spark, d, "eval_items").select("item_id", "query")
    ends = F.array(F.lit(" pdf"), F.lit(" in:downloads"), F.lit(" folder"), F.lit(""))
    q = F.concat("query", F.element_at(ends, (F.col("item_id") % 4).cast("int") + 1)).alias("q")

    @F.pandas_udf("text string, type string, scope string")
    def parsed(qs):
        return pd.DataFrame([parse.parse_query(x) for x in qs], columns=["text", "type", "scope"])

    return found.select("item_id", q).select("item_id", parsed("q").alias("p")).select("item_id", "p.*")


def _archives(kind):
    def run(spark, d):
        """Every document packed as an archive and read again."""
        import io
        import zipfile
        from xml.sax.saxutils import escape

        @F.pandas_udf(T.BinaryType())
        def packed(texts: pd.Series) -> pd.Series:
            def one(t):
                out = io.BytesIO()
                with zipfile.ZipFile(out, "w") as z:
                    z.writestr(extract._MEMBERS[kind], f"<d><t>{escape(t)}</t></d>")
                return out.getvalue()

            return texts.map(one)

        rows = V.docs(spark, d).select(F.concat("path", F.lit("." + kind)).alias("path"), packed("content").alias("content"))
        return extract.extract_archives(rows)

    return run


def _paths(spark, d):
    rows = V.read(spark, d, "scan_runs").groupBy("snapshot_id").agg(F.array_sort(F.collect_set("root")).alias("roots"))  # one per scan root
    lists = rows.withColumn("value", F.when(F.col("snapshot_id") % 2 == 0, F.to_json("roots")).otherwise(F.array_join("roots", " , ")))
    parts = F.coalesce(F.from_json("value", "array<string>", {"mode": "PERMISSIVE"}), F.split("value", ","))
    clean = F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")
    return lists.select("snapshot_id", F.array_join(clean, "|").alias("paths"))


def _vec_codec(spark, d):
    rows = V.vectors(spark, d).filter("vector is not null")
    again = values.decode_vector(64)(values.encode_vector(F.col("vector")))
    return rows.select("vec_id", F.octet_length(values.encode_vector(F.col("vector"))).alias("bytes"), (again == F.col("vector")).alias("same"))


def _upserted(spark, d):
    """The index of all documents, those of even length written again with their names as text."""
    docs = V.docs(spark, d)
    again = docs.filter(F.length("content") % 2 == 0).withColumn("content", F.col("filename"))
    return fulltext.index_upsert(fulltext.postings(docs), again)


def _deleted(spark, d):
    docs = V.docs(spark, d)
    return fulltext.index_delete(fulltext.postings(docs), docs.filter(F.length("content") % 2 == 0))


def _bm25(spark, d):
    return fulltext.bm25(V.index(spark, d), TERMS).select("path", F.round("score", 6).alias("score"))


def _content(query, fuzzy=False, kind=None):
    def run(spark, d):
        out = fulltext.content_search(V.index(spark, d), query, 20, kind, fuzzy)
        return out.select("path", "extension", F.round("score", 6).alias("score"))

    return run


def tok(x: str) -> str:
    return rf"list_filter(regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}]+'), lambda w: strlen(w) <= 40)"


_LINES = r"regexp_split_to_array(%s, '\r?\n')"
_FIRST = rf"coalesce(list_filter(list_transform({_LINES % 'content'}, lambda s: trim(regexp_replace(trim(s), '^#+', ''))), lambda s: strlen(s) > 3)[1], '')"
_POS = "strpos(lower(content), 'archive')"
_BEFORE, _AFTER = f"substr(content, 1, {_POS} - 1)", f"substr(content, {_POS})"
_SNIP = f"""trim(CASE WHEN contains({_BEFORE}, chr(10)) THEN string_split({_BEFORE}, chr(10))[-1] ELSE right({_BEFORE}, 80) END
  || CASE WHEN contains({_AFTER}, chr(10)) THEN split_part({_AFTER}, chr(10), 1) ELSE substr({_AFTER}, 1, 160) END)"""
_LINE = r"regexp_replace(split_part(content, chr(10), 1), '\r$', '')"
_SAMPLE = r"substr(regexp_replace(content, '^\s+|\s+$', '', 'g'), 1, 2000)"
_WORDS = rf"list_filter(regexp_split_to_array({_SAMPLE}, '\s+'), lambda w: strlen(w) BETWEEN 2 AND 30)"
_MARKS = " + ".join("(length(s) - length(replace(s, " + ("'stream' || chr(10)" if "\n" in m else f"'{m}'") + f", ''))) // {len(m)}" for m in K.PDF_MARKERS)
FT = f"SELECT path, 'content' AS field, {tok('content')} AS w FROM docs_v UNION ALL SELECT path, 'filename', {tok('filename')} FROM docs_v"
_POSTS = "SELECT term, field, path, count(*) AS tf FROM (SELECT path, field, unnest(w) AS term FROM ft) GROUP BY ALL"


def bm25_cte(query: str) -> dict[str, str]:
    """Common table expressions up to ``bm`` (path, score)."""
    terms = ", ".join(f"('{t}')" for t in fulltext.query_terms(query))
    return {
        "docs_v": V.CTE["docs_v"], "ft": FT, "st": "SELECT field, count(*) AS n, avg(len(w)) AS avgdl FROM ft GROUP BY field", "q": f"SELECT * FROM (VALUES {terms}) t(term)",
        "h": "SELECT path, field, len(w) AS dl, term, len(list_filter(w, lambda x: x = term)) AS tf FROM ft, q",
        "df": "SELECT field, term, count(*) AS df FROM h WHERE tf > 0 GROUP BY ALL",
        "bm": "SELECT path, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 9) AS score FROM h JOIN df USING (field, term) JOIN st USING (field) WHERE tf > 0 GROUP BY path",
    }


def content_cte(query: str, limit: int, kind: str | None = None) -> dict[str, str]:
    """The same up to ``cs`` (path, extension, score): the content search."""
    return bm25_cte(query) | {
        "tops": f"SELECT * FROM bm ORDER BY score DESC, path LIMIT {4 * limit}",
        "cs": f"""SELECT path, d.extension, score FROM tops JOIN docs_v d USING (path) WHERE score >= 0.2 * (SELECT max(score) FROM tops)
  {f"AND d.extension = '{kind}'" if kind else ''} ORDER BY score DESC, path LIMIT {2 * limit}""",
    }


_CS = "SELECT path, extension, round(score, 6) AS score FROM cs"
_FUZZY_Q = "achive"
_FUZZY = {
    "docs_v": V.CTE["docs_v"], "ft": FT, "st": "SELECT field, count(*) AS n, avg(len(w)) AS avgdl FROM ft GROUP BY field",
    "p": _POSTS, "near": f"SELECT DISTINCT term FROM p WHERE damerau_levenshtein(term, '{_FUZZY_Q}') <= 1", "h": "SELECT p.*, len(w) AS dl FROM p JOIN ft USING (path, field) WHERE term IN (SELECT term FROM near)",
    "df": "SELECT field, term, count(*) AS df FROM h GROUP BY ALL",
    "bm": "SELECT path, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) * 0.5, 9) AS score FROM h JOIN df USING (field, term) JOIN st USING (field) GROUP BY path",
    "tops": "SELECT * FROM bm ORDER BY score DESC, path LIMIT 80",
    "cs": "SELECT path, d.extension, score FROM tops JOIN docs_v d USING (path) WHERE score >= 0.2 * (SELECT max(score) FROM tops) ORDER BY score DESC, path LIMIT 40",
}
_FNV = "list_reduce(list_prepend(14695981039346656037::UHUGEINT, list_transform(range(0, octet_length(encode(filename))), lambda i: ('0x' || hex(encode(filename))[2 * i + 1:2 * i + 2])::UTINYINT::UHUGEINT)), lambda h, b: (xor(h, b) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT)"

QUERIES = {
    "extract_text": _docs(text=fulltext.extract_text),
    "tokenize": _docs(tokens=lambda c: F.array_join(text.tokens(c), " ")),
    "build_postings": lambda s, d: fulltext.postings(V.docs(s, d)),
    "term_df": lambda s, d: fulltext.term_stats(fulltext.postings(V.docs(s, d))),
    "doc_len": lambda s, d: fulltext.doc_lengths(V.docs(s, d)),
    "bm25": _bm25,
    "content_search": _content(TERMS),
    "content_search_type": _content(TERMS, kind="md"),
    "content_fuzzy": _content(_FUZZY_Q, fuzzy=True),
    "index_upsert": _upserted,
    "index_delete": _deleted,
    "readable_text": _docs(readable=text.readable),
    "parse_query": _parse,
    "extract_docx": _archives("docx"), "extract_xlsx": _archives("xlsx"),
    "normalize_name": _names(normal=text.normalize_name),
    "filename_tier": _names(tier=lambda c: text.filename_tier(c, "mortgage")),
    "levenshtein": _names(distance=lambda c: F.levenshtein(F.regexp_replace(F.lower(c), "[^ -~]", "?"), F.lit("readme.md"))),
    "typo_match": _names(hit=lambda c: text.typo_match(c, "morgage")),
    "fuzzy_filename": _names(score=lambda c: fuzzy_score("mrtg")(c)),
    "escape_query": _names(escaped=text.escape_query),
    "strip_tags": _docs(plain=text.strip_tags),
    "strip_md": _docs(plain=text.strip_md),
    "strip_code": _docs(plain=text.strip_code),
    "strip_links": _docs(plain=text.strip_links),
    "first_line": _docs(line=text.first_line),
    "truncate": _docs(cut=lambda c: text.truncate(c, 800)),
    "embed_text": lambda s, d: V.docs(s, d).select("path", text.embed_text(F.col("filename"), F.col("content"), F.col("extension")).alias("embedded")),
    "collapse_ws": _docs(plain=text.collapse_ws),
    "snippet": _docs(snip=lambda c: text.snippet(c, "archive")),
    "redact_home": lambda s, d: V.files(s, d).select("path", text.redact_home(F.col("path"), "/home/desk01").alias("shown")),
    "exif_text": lambda s, d: V.read(s, d, "ocr_results").select("ocr_id", text.exif_text(F.col("exif")).alias("meta")),
    "exif_date": lambda s, d: V.read(s, d, "ocr_results").select("ocr_id", values.exif_date(F.col("exif.date_taken")).alias("taken")),
    "path_list": _paths,
    "csv_preview": _docs(table=text.csv_preview),
    "fnv1a": _names(hash=values.fnv1a),
    "sha256": _docs(hash=lambda c: F.sha2(c, 256)),
    "epoch": lambda s, d: V.read(s, d, "content_index").select("content_id", values.epoch(F.col("indexed_at")).alias("seconds")),
    "rfc3339": lambda s, d: V.files(s, d).select("path", values.rfc3339(F.col("modified_ts")).alias("modified")),
    "relative_date": lambda s, d: V.files(s, d).select("path", values.relative_date(F.col("modified_ts"), NOW).alias("shown")),
    "human_size": lambda s, d: V.files(s, d).select("path", values.human_size(F.col("size_bytes")).alias("shown")),
    "recency": lambda s, d: V.files(s, d).select("path", F.round(scoring.recency(F.col("modified_ts"), NOW), 6).alias("bonus")),
    "type_bonus": lambda s, d: V.files(s, d).select("path", scoring.type_bonus(F.col("extension")).alias("bonus")),
    "tier_bucket": lambda s, d: V.files(s, d).select("path", scoring.tier_bucket(F.col("size_bytes").cast("double")).alias("bucket")),
    "vec_codec": _vec_codec,
}

_BONUS = "CASE " + " ".join(f"WHEN extension IN ({V.quoted(kinds)}) THEN {b}" for b, kinds in K.TYPE_BONUS.items()) + " ELSE 50.0 END"
_RECENCY = f"100.0 / (1.0 + sqrt(greatest({NOW} - modified_ts, 0) / 86400.0))"
_NORM = r"regexp_replace(lower(filename), '[^\p{L}\p{N}]', ' ', 'g')"


def tier_sql(query: str) -> str:
    q, n = query.lower(), "".join(c if c.isalnum() else " " for c in query.lower())
    return f"CASE WHEN starts_with(lower(filename), '{q}') THEN 10000.0 WHEN contains(lower(filename), '{q}') THEN 5000.0 WHEN starts_with({_NORM}, '{n}') THEN 10000.0 WHEN contains({_NORM}, '{n}') THEN 5000.0 END"


def typo_sql(query: str) -> str:
    most = 1 if len(query) <= 6 else 2
    return rf"len(list_filter(regexp_split_to_array(lower(regexp_replace(filename, '\.[^.]*$', '')), '[^\p{{L}}\p{{N}}]'), lambda w: abs(strlen(w) - {len(query)}) <= 1 AND levenshtein(w, '{query}') BETWEEN 1 AND {most})) > 0"


def _content_sql(column: str, expression: str) -> str:
    return sql(f"SELECT path, {expression} AS {column} FROM docs_v")


def _name_sql(column: str, expression: str) -> str:
    return sql(f"SELECT path, {expression} AS {column} FROM files_v")




def cut_sql(x: str, most: int) -> str:
    """The longest start of at most ``most`` bytes."""
    return f"CASE WHEN strlen({x}) <= {most} THEN {x} ELSE substr({x}, 1, list_max(list_filter(range(0, {most + 1}), lambda n: strlen(substr({x}, 1, n)) <= {most}))) END"


_ESCAPED = "replace(filename, '\\', '\\\\')"
for _c in K.SYNTAX.replace("\\", ""):
    _ESCAPED = f"replace({_ESCAPED}, '{_c}', '\\{_c}')"
_UNITS = [("KB", 1024.0), ("MB", 1024.0**2), ("GB", 1024.0**3)]

_BLANK = r"[\s\x0b\x1c-\x1f\x85\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_ESC = "replace(replace(replace(content, '&', '&amp;'), '>', '&gt;'), '<', '&lt;')"
_UNZIPPED = rf"substr(regexp_replace(regexp_replace({_ESC}, '^{_BLANK}+|{_BLANK}+$', '', 'g'), '{_BLANK}+', ' ', 'g'), 1, {K.DOC_CHARS})"
_MD = r"""array_to_string(list_filter(list_transform(list_filter(list_transform(regexp_split_to_array(regexp_replace(content, '%s', '', 'g'), '\r?\n'), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')),
  lambda s: NOT regexp_matches(s, '%s')), lambda s: regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(s, '^#+', ''), '^\s+|\s+$', '', 'g'), '\*\*|__', '', 'g'),
  '`[^`]*(`|$)', '', 'gs'), '\[([^\]]*)\]\([^)]*\)', '\1', 'g'), '%s', '')), lambda s: s <> ''), ' ')""" % (text.MD_FENCED, text.MD_DROPPED, text.MD_MARKS)
_CELLS = r"list_transform(list_transform(list_filter(regexp_split_to_array(content, '\r?\n'), lambda s: trim(s) <> '')[1:20], lambda s: list_transform(string_split(s, ',')[1:5], lambda c: substr(trim(c), 1, 20))), lambda r: '| ' || array_to_string(r, ' | ') || ' |')"
_WIDE = r"least(5, len(string_split(list_filter(regexp_split_to_array(content, '\r?\n'), lambda s: trim(s) <> '')[1], ',')))"
_PARSED = f"""SELECT item_id, CASE WHEN lead THEN substr(t, 2) WHEN dir OR kind IS NOT NULL THEN array_to_string(r[1:len(r) - 1], ' ') ELSE t END AS text,
  CASE WHEN lead OR dir THEN '__dir__' ELSE kind END AS type, CASE WHEN i0 > 0 THEN lower(substr(w[i0], 4)) END AS scope FROM
  (SELECT *, starts_with(t, '/') AND length(t) > 1 AS lead, len(r) > 1 AND (r[-1] = '/' OR lower(r[-1]) IN ('folder', 'dir')) AS dir,
    CASE WHEN len(r) > 1 AND lower(ltrim(r[-1], '.')) IN ({V.quoted(K.QUERY_EXTENSIONS)}) THEN lower(ltrim(r[-1], '.')) END AS kind FROM
  (SELECT *, array_to_string(r, ' ') AS t FROM (SELECT *, CASE WHEN i0 > 0 THEN list_concat(w[1:i0 - 1], w[i0 + 1:]) ELSE w END AS r FROM
  (SELECT *, coalesce(list_position(list_transform(w, lambda x: starts_with(x, 'in:') AND length(x) > 3), true), 0) AS i0 FROM
  (SELECT item_id, list_filter(regexp_split_to_array(query || [' pdf', ' in:downloads', ' folder', ''][item_id % 4 + 1], '\\s+'), lambda x: x <> '') AS w FROM eval_items)))))"""

ORACLE = {
    "parse_query": _PARSED,
    "extract_docx": sql(f"SELECT path || '.docx' AS path, {_UNZIPPED} AS text, NULL AS error FROM docs_v"),
    "extract_xlsx": sql(f"SELECT path || '.xlsx' AS path, {_UNZIPPED} AS text, NULL AS error FROM docs_v"),
    "strip_md": sql(f"SELECT path, {_MD} AS plain FROM docs_v"),
    "csv_preview": sql(f"SELECT path, CASE WHEN len({_CELLS}) > 0 THEN array_to_string(list_concat(list_concat({_CELLS}[1:1], ['|' || repeat(' --- |', {_WIDE})]), {_CELLS}[2:]), chr(10)) END AS \"table\" FROM docs_v"),
    "vec_codec": sql("SELECT vec_id, CAST(4 * len(vector) AS INTEGER) AS bytes, CASE WHEN len(vector) = 64 THEN true END AS same FROM vectors_v WHERE vector IS NOT NULL"),
    "exif_date": """SELECT ocr_id, coalesce(strftime(coalesce(try_strptime(exif.date_taken, '%Y:%m:%d %H:%M:%S'), try_strptime(exif.date_taken, '%Y-%m-%d %H:%M:%S')), '%Y-%m-%dT%H:%M:%S'), exif.date_taken) AS taken FROM ocr_results""",
    "extract_text": _content_sql("text", "content"),
    "tokenize": _content_sql("tokens", f"array_to_string({tok('content')}, ' ')"),
    "build_postings": sql("SELECT * FROM p", docs_v=V.CTE["docs_v"], ft=FT, p=_POSTS),
    "term_df": sql("SELECT term, field, count(*) AS df FROM p GROUP BY ALL", docs_v=V.CTE["docs_v"], ft=FT, p=_POSTS),
    "doc_len": sql("SELECT path, field, len(w) AS dl FROM ft", docs_v=V.CTE["docs_v"], ft=FT),
    "bm25": sql("SELECT path, round(score, 6) AS score FROM bm", **bm25_cte(TERMS)),
    "content_search": sql(_CS, **content_cte(TERMS, 20)),
    "content_search_type": sql(_CS, **content_cte(TERMS, 20, "md")),
    "content_fuzzy": sql(_CS, **_FUZZY),
    "index_upsert": sql("SELECT * FROM p", docs_w=V.CTE["docs_v"], docs_v="SELECT path, filename, CASE WHEN length(content) % 2 = 0 THEN filename ELSE content END AS content FROM docs_w", ft=FT, p=_POSTS),
    "index_delete": sql("SELECT * FROM p", docs_w=V.CTE["docs_v"], docs_v="SELECT * FROM docs_w WHERE length(content) % 2 = 1", ft=FT, p=_POSTS),
    "readable_text": sql(rf"""SELECT path, s <> '' AND NOT starts_with(s, '%PDF') AND length(regexp_replace(s, '[^\p{{L}}\p{{N}}\s!-/:-@\[-`{{-~]', '', 'g')) / greatest(strlen(s), 1) >= 0.7
  AND len(w) >= 5 AND list_sum(list_transform(w, lambda x: strlen(x))) / greatest(len(w), 1) BETWEEN 2 AND 15 AND {_MARKS} <= 5 AS readable
  FROM (SELECT path, {_SAMPLE} AS s, {_WORDS} AS w FROM docs_v)""").replace("len(w) >= 5 AND list_sum", "len(w) >= 5 AND list_sum"),
    "normalize_name": _name_sql("normal", _NORM),
    "filename_tier": _name_sql("tier", tier_sql("mortgage")),
    "levenshtein": _name_sql("distance", "levenshtein(regexp_replace(lower(filename), '[^ -~]', '?', 'g'), 'readme.md')"),
    "typo_match": _name_sql("hit", typo_sql("morgage")),
    "escape_query": _name_sql("escaped", _ESCAPED),
    "strip_tags": _content_sql("plain", r"replace(regexp_replace(content, '<[^>]*(>|$)', '', 'gs'), '>', '')"),
    "strip_code": _content_sql("plain", r"regexp_replace(content, '`[^`]*(`|$)', '', 'gs')"),
    "strip_links": _content_sql("plain", r"regexp_replace(content, '\[([^\]]*)\]\([^)]*\)', '\1', 'g')"),
    "first_line": _content_sql("line", _FIRST),
    "truncate": _content_sql("cut", cut_sql("content", 800)),
    "snippet": sql(f"""SELECT path, CASE WHEN pos > 0 THEN CASE WHEN strlen(hit) > 200 THEN '...' || {cut_sql('hit', 200)} || '...' ELSE hit END
  WHEN content <> '' THEN CASE WHEN strlen(line) > 200 THEN {cut_sql('line', 200)} || '...' ELSE line END END AS snip
  FROM (SELECT path, content, {_POS} AS pos, {_SNIP} AS hit, {_LINE} AS line FROM docs_v)"""),
    "collapse_ws": _content_sql("plain", r"substr(trim(regexp_replace(content, '\s+', ' ', 'g')), 1, 200000)"),
    "redact_home": _name_sql("shown", "replace(path, '/home/desk01', '~')"),
    "exif_text": """SELECT ocr_id, concat_ws(' ', CASE WHEN exif.date_taken IS NOT NULL THEN '[Date: ' || split_part(exif.date_taken, 'T', 1) || ']' END,
  CASE WHEN exif.gps IS NOT NULL THEN '[Location: ' || exif.gps || ']' END) AS meta FROM ocr_results""",
    "path_list": "SELECT snapshot_id, array_to_string(list_sort(list(DISTINCT root)), '|') AS paths FROM scan_runs GROUP BY snapshot_id",
    "fnv1a": _name_sql("hash", f"lower(printf('%016x', ({_FNV})::UBIGINT))").replace("printf('%016x', ", "lpad(to_hex(").replace(")::UBIGINT)", ")::UBIGINT), 16, '0')"),
    "sha256": _content_sql("hash", "sha256(content)"),
    "epoch": "SELECT content_id, CAST(greatest(floor(epoch(indexed_at)), 0) AS BIGINT) AS seconds FROM content_index",
    "rfc3339": _name_sql("modified", "CASE WHEN modified_ts > 0 THEN strftime(make_timestamp(modified_ts * 1000000), '%Y-%m-%dT%H:%M:%S+00:00') ELSE '' END"),
    "relative_date": sql(f"""SELECT path, CASE WHEN modified_ts <= 0 THEN '' WHEN d = 0 THEN 'Today at ' || h WHEN d = 1 THEN 'Yesterday at ' || h
  ELSE strftime(t, '%-d %B, %Y') || ' at ' || h END AS shown FROM (SELECT path, modified_ts, floor(({NOW} - modified_ts) / 86400.0) AS d, make_timestamp(modified_ts * 1000000) AS t,
  strftime(make_timestamp(modified_ts * 1000000), '%I:%M %p') AS h FROM files_v)"""),
    "human_size": _name_sql("shown", "CASE WHEN size_bytes IS NULL THEN '' WHEN size_bytes < 1024 THEN size_bytes || ' B' " + " ".join(f"WHEN size_bytes < {k * 1024} OR '{u}' = 'GB' THEN printf('%.1f {u}', size_bytes / {k})" for u, k in _UNITS) + " END"),
    "recency": _name_sql("bonus", f"round({_RECENCY}, 6)"),
    "type_bonus": _name_sql("bonus", _BONUS),
    "tier_bucket": _name_sql("bucket", "CASE " + " ".join(f"WHEN size_bytes >= {a} THEN {b}" for a, b in K.BUCKETS) + " ELSE 1 END"),
}

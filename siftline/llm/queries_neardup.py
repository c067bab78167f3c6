"""Queries of problem 5."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftline.llm.neardup import grouped_names, grouped_texts, similar_names, similar_texts
from siftline.runtime import read


def p5_found(spark, sf_dir):
    texts = similar_texts(read(spark, sf_dir, "content_index"), "content_id", "content", 0.6)
    names = similar_names(read(spark, sf_dir, "files").filter("not is_dir"), "id", "filename", 0.7)
    return texts.select(F.lit("content").alias("field"), "id_a", "id_b").unionByName(names.select(F.lit("filename").alias("field"), "id_a", "id_b"))


def p5_classes(spark, sf_dir):
    """Rows of content_index by their five-word sets at 0.8: class of equal sets, copies and similar classes."""
    return grouped_texts(read(spark, sf_dir, "content_index"), "content_id", "content")


def p5_name_classes(spark, sf_dir):
    """Rows of files by the sets of their names: class of equal sets, names in it and similar classes."""
    return grouped_names(read(spark, sf_dir, "files").filter("not is_dir"), "id", "filename")


_SET = """list_distinct(list_transform(range(1, len(w) - 1), lambda k: array_to_string(w[k:k + 2], ' ')))"""
QUERIES = {"p5_found": p5_found, "p5_classes": p5_classes, "p5_name_classes": p5_name_classes}
ORACLE = {
    "p5_found": f"""
WITH c AS (SELECT content_id AS id, regexp_extract_all(lower(content), '[\\p{{L}}\\p{{N}}]+') AS w FROM content_index),
cs AS (SELECT id, {_SET} AS s FROM c WHERE len(w) >= 8),
cf AS (SELECT s, min(id) AS id FROM (SELECT id, list_sort(s) AS s FROM cs) GROUP BY s),
ct AS (SELECT id, unnest(s) AS g FROM cf),
cp AS (SELECT x.id AS a, y.id AS b, count(*) AS o FROM ct x JOIN ct y USING (g) WHERE x.id < y.id GROUP BY ALL),
cl AS (SELECT a, b FROM cp JOIN cf p ON p.id = a JOIN cf q ON q.id = b WHERE o >= 0.6 * (len(p.s) + len(q.s) - o) - 1e-9
       UNION ALL SELECT id, id FROM cf),
cm AS (SELECT cs.id, cf.id AS f FROM cs JOIN cf ON cf.s = list_sort(cs.s)),
cr AS (SELECT least(x.id, y.id) AS id_a, greatest(x.id, y.id) AS id_b FROM cl JOIN cm x ON x.f = a JOIN cm y ON y.f = b WHERE a <> b OR x.id < y.id),
n AS (SELECT filename, array_to_string(regexp_extract_all(lower(CASE WHEN regexp_matches(filename, '^.+\\.[^.]*$') THEN regexp_extract(filename, '^(.+)\\.[^.]*$', 1) ELSE filename END), '[\\p{{L}}\\p{{N}}]'), '') AS z
      FROM (SELECT DISTINCT filename FROM files WHERE NOT is_dir AND filename IS NOT NULL)),
ns AS (SELECT filename, list_distinct(list_transform(range(1, length(z) - 1), lambda k: z[k:k + 2])) AS s FROM n WHERE length(z) >= 3),
nt AS (SELECT filename, unnest(s) AS g FROM ns),
np AS (SELECT x.filename AS a, y.filename AS b, count(*) AS o FROM nt x JOIN nt y USING (g) WHERE x.filename < y.filename GROUP BY ALL),
nl AS (SELECT a, b FROM np JOIN ns p ON p.filename = a JOIN ns q ON q.filename = b WHERE o >= 0.7 * (len(p.s) + len(q.s) - o) - 1e-9),
nr AS (SELECT least(x.id, y.id) AS id_a, greatest(x.id, y.id) AS id_b FROM nl JOIN files x ON x.filename = a AND NOT x.is_dir JOIN files y ON y.filename = b AND NOT y.is_dir)
SELECT 'content' AS field, id_a, id_b FROM cr UNION ALL SELECT 'filename', id_a, id_b FROM nr"""
}

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftline.functions import scoring, text, values
from siftline.functions.parse import DIRECTORY, parse_query, path_list
from siftline.functions.paths import expand_tilde, preset_roots
from siftline.operators.fulltext import _osa
from siftline.operators.fuzzy import score


@pytest.mark.parametrize(
    "query, want",
    [
        ("resume pdf", ("resume", "pdf", None)), ("invoice .xlsx", ("invoice", "xlsx", None)), ("pdf", ("pdf", None, None)), ("/annual reports", ("annual reports", DIRECTORY, None)),
        ("/", ("/", None, None)), ("docs Folder", ("docs", DIRECTORY, None)), ("report pdf in:downloads", ("report", "pdf", "downloads")), ("in:obsidian projects /", ("projects", DIRECTORY, "obsidian")),
        ("dharma in:daily notes", ("dharma notes", None, "daily")), ("test in:", ("test in:", None, None)), ("log in page", ("log in page", None, None)), ("a in:x in:y", ("a in:y", None, "x")),
    ],
)
def test_parse_query(query, want):
    assert tuple(parse_query(query)) == want


@given(st.text())
def test_parse_never_fails(q):
    parse_query(q)


@given(st.text(max_size=12), st.text(max_size=12))
def test_distance_laws(a, b):
    assert _osa(a, b) == _osa(b, a) and (_osa(a, b) == 0) == (a == b) and _osa(a, b) <= max(len(a), len(b))


def test_fuzzy_score():
    assert score("report", "quarterly-report.pdf") >= 12 * 6
    assert score("qr rep", "quarterly report.pdf") >= 0
    assert score("zzzq", "quarterly-report.pdf") == -1
    assert score("rpt", "report") < score("rep", "report")


def test_path_list():
    assert path_list('["/a", " /b ", ""]') == ["/a", "/b"] and path_list("/a, /b,,") == ["/a", "/b"]


def test_roots():
    assert preset_roots("nonsense", ["~/x", "~/Documents"], "/home/u")[-1] == "/home/u/x" and expand_tilde("~x", "/h") == "~x"


def one(spark, column, **values_):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values_.items()]).select(column.alias("r")).head()["r"]


def test_strings(spark):
    x = F.col("x")
    assert one(spark, text.strip_tags(x), x="a<b>c</b> > d <e") == "ac  d "
    assert one(spark, text.strip_code(x), x="a `b` c `d") == "a  c "
    assert one(spark, text.strip_links(x), x="[t](u) [v] (w)") == "t [v] (w)"
    assert one(spark, text.strip_md(x), x="# H\n```\ncode\n```\n- **a** [b](c)\n|x|\n---\nend") == "H a b end"
    assert one(spark, text.truncate(x, 4), x="aéé") == "aé"
    assert one(spark, text.first_line(x), x="#\n## ab\n# title") == "title"
    assert one(spark, text.csv_preview(x), x="a,b\n1,2") == "| a | b |\n| --- | --- |\n| 1 | 2 |"
    assert one(spark, values.fnv1a(x), x="hello") == "a430d84680aabd0b"
    assert one(spark, values.human_size(F.col("n")), n=1536) == "1.5 KB"
    assert one(spark, text.typo_match(x, "budhism"), x="buddhism-intro.md") is True
    assert one(spark, text.typo_match(x, "readme"), x="readme.md") is False
    assert one(spark, scoring.recency(F.col("n"), 100), n=200) == 100.0
    assert one(spark, values.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) == 0.0


def test_nulls_and_empty(spark):
    rows = spark.createDataFrame([(None,), ("",)], "x string")
    for f in (text.normalize_name, text.strip_tags, text.strip_md, text.first_line, text.collapse_ws, text.readable, values.fnv1a, text.csv_preview, lambda c: text.snippet(c, "q"), lambda c: text.truncate(c, 3)):
        assert len(rows.select(f(F.col("x")).alias("r")).collect()) == 2

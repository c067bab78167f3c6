import pytest

from siftline.plans import catalogue
from tests.oracle import compare

#: Queries without SQL, and how many rows of what they must give.
BARE = {"unified_product": 30, "semantic_ann": 20}


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_against_sql(spark, sf, name):
    compare(spark, sf, catalogue.queries()[name], catalogue.oracle_sql()[name])


def test_every_other_query_is_looked_at():
    assert set(catalogue.queries()) - set(catalogue.oracle_sql()) == {*BARE, "fuzzy_filename", "embed_text"}


def test_product_holds_what_the_plain_search_finds(spark, sf):
    """With fuzzy passes on, what the plain search ranks first is still there, and more."""
    found = {r["path"]: r["score"] for r in catalogue.queries()["unified_product"](spark, sf).collect()}
    assert 0 < len(found) <= BARE["unified_product"]
    plain = catalogue.queries()["unified_search"](spark, sf).filter("bucket >= 5").select("path", "score").collect()
    assert all(found.get(p, 0) >= s for p, s in plain)


def test_ann_agrees_with_brute_force(spark, sf):
    near = [r["path"] for r in catalogue.queries()["semantic_ann"](spark, sf).collect()]
    best = [r["path"] for r in catalogue.queries()["semantic_topk"](spark, sf).collect()][: BARE["semantic_ann"]]
    assert len(set(near) & set(best)) >= 0.9 * len(best)


def test_fuzzy_names_and_embedded_texts(spark, sf):
    scores = catalogue.queries()["fuzzy_filename"](spark, sf).toPandas()
    holds = scores["path"].str.rpartition("/")[2].str.lower().str.contains("m.*r.*t.*g")
    assert ((scores["score"] > 0) == holds).all()
    texts = catalogue.queries()["embed_text"](spark, sf).filter("embedded is not null").toPandas()
    names = texts["path"].str.rpartition("/")[2]
    assert len(texts) and all(t.startswith(f"File: {n}\n") for t, n in zip(texts["embedded"], names))


def test_flagship(spark, sf):
    assert catalogue.flagship(spark, sf).count() > 0

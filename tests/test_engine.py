"""Ranking rules and life cycle of an index, end to end."""

import json
import os

import pytest
from pyspark.sql import functions as F

from siftline.engine import Engine
from siftline.operators import interactions, jobs, sync
from siftline.operators.fulltext import TextIndex, doc_lengths, field_stats, full_postings
from siftline.operators.fuzzy import may_match, score
from siftline.operators.search import Options, unified_search
from siftline.sources.scan import scan_tree
from siftline.sources.store import LockHeld, Store, log_error, recent_errors

NOW = 1_650_000_000
DAY = 86400
TREE = {
    "Garden/tomato_calendar.csv": ("week,task\n12,sow tomato under glass", 4),
    "Garden/greenhouse-log.txt": ("Opened the vents twice. The tomato plants by the door are doing well.", 2),
    "Garden/seed order.md": ("# Seeds\nOrdered marigold and leek from the nursery.", 9),
    "Boat/hull survey.docx": ("The surveyor found blisters below the waterline.", 40),
    "Boat/engine_manual.pdf": ("Change the impeller every second season.", 400),
    "Boat/navigation.py": ("def bearing(a, b):\n    return (b - a) % 360", 1),
    "Music/chords.txt": ("", 15),
}
FILES = "path string, filename string, extension string, size_bytes long, modified_ts long, is_dir boolean, created_ts long"
DOCS = "path string, filename string, extension string, content string"


def row(path, size, days, is_dir=False):
    name = path.rsplit("/", 1)[-1]
    return (path, name, None if is_dir else name.rsplit(".", 1)[-1], size, NOW - days * DAY, is_dir, 0)


@pytest.fixture(scope="module")
def tables(spark):
    rows = [row("/srv/" + n, len(t), d) for n, (t, d) in TREE.items()] + [row("/srv/" + d, 0, 1, True) for d in ("Garden", "Boat", "Music")]
    docs = [("/srv/" + n, n.split("/")[-1], n.rsplit(".", 1)[-1], t) for n, (t, _) in TREE.items()]
    return spark.createDataFrame(rows, FILES), spark.createDataFrame(docs, DOCS)


def found(df):
    return [r["path"].removeprefix("/srv/") for r in df.collect()]


@pytest.mark.parametrize("indexed", [False, True])
def test_ranking_rules(tables, indexed):
    files, docs = tables
    texts = TextIndex(full_postings(docs), field_stats(doc_lengths(docs))) if indexed else docs
    find = lambda q, **o: found(unified_search(files, texts, q, Options(now=NOW, **o)))
    assert find("tomato") == ["Garden/tomato_calendar.csv", "Garden/greenhouse-log.txt"]  # a name before a text
    assert find("tomatto")[0] == "Garden/tomato_calendar.csv"  # a typo
    assert find("seed-order")[0] == find("seed order")[0] == "Garden/seed order.md"  # whatever separates words
    assert find("impeller") == ["Boat/engine_manual.pdf"] and find("impeler")[0] == "Boat/engine_manual.pdf"  # a text, and a term near the query
    assert find("/boat") == ["Boat"] and find("hull docx") == ["Boat/hull survey.docx"] and find("hull pdf") == []
    assert find("tomato", prefixes=["/srv/Boat"]) == [] and find("zzyzx") == []
    assert find("engmn")[0] == "Boat/engine_manual.pdf" and find("engmn", fuzzy=False) == []  # letters in order


def test_fuzzy_prefilter_loses_nothing(spark):
    names = ["engine_manual.pdf", "manual", "Ünïcode Map.txt", "a.b", "", "back\\slash", "x+y (1).md"]
    queries = ["eng", "um", "unmap", "+ (", "\\s", "b a", "E M"]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    for q in queries:
        kept = {r[0] for r in df.filter(may_match(F.col("name"), q)).collect()}
        assert {n for n in names if score(q, n) >= 0} <= kept


def test_results(spark, tables, tmp_path):
    files, docs = tables
    engine = Engine(spark, str(tmp_path / "index"))
    ask = lambda q, **o: json.loads(engine.response(q, NOW, **o))
    assert ask("x y")["mode"] == "indexing" and engine.doctor()["health"] == "missing"
    engine.build(files, docs, now=NOW)
    assert ask("x")["mode"] == "too_short" and ask("")["mode"] == "recent"
    engine.track("/srv/Garden/seed order.md", "open", NOW)
    with pytest.raises(ValueError):
        engine.track("/srv/x", "dance")
    out = ask("seed", sync_skipped=True)
    first = out["results"][0]
    assert out["mode"] == "unified" and out["sync_skipped"] and first["filename"] == "seed order.md" and first["interactions"] == 1
    assert first["file_type"] == "md" and first["score"] == round(first["score"], 2) and not {"bucket", "modified_ts"} & set(first)
    assert ask("blisters")["results"][0].get("content_snippet") is None and "vents" in ask("vents")["results"][0]["content_snippet"]
    assert engine.doctor()["health"] == "ok" and not engine.stale(NOW + 3600) and engine.stale(NOW + 2 * DAY)
    assert engine.reconcile(NOW) is False and engine.store.meta("last_reconcile") == NOW
    engine.reconcile(NOW + 60)
    assert engine.store.meta("last_reconcile") == NOW


def test_what_is_deleted_is_found_nowhere(spark, tables, tmp_path):
    files, docs = tables
    engine = Engine(spark, str(tmp_path / "index"))
    vectors = spark.createDataFrame([(r["path"], i, [float(i), 1.0], r["modified_ts"], "h") for i, r in enumerate(files.filter("not is_dir").collect())], "path string, vec_id long, vector array<float>, mtime long, embed_hash string")
    engine.build(files, docs, vectors, now=NOW)
    roots = spark.createDataFrame([("/srv",)], "root string")
    log = "/srv/Garden/greenhouse-log.txt"
    assert engine.sync(files.filter(F.col("path") != log), roots) == {"added": 0, "modified": 0, "deleted": 1}
    assert found(engine.search("vents", NOW)) == [] and log not in [r["path"] for r in engine.similar([1.0, 1.0]).collect()]
    assert all(log not in [r[0] for r in t.select("path").collect()] for t in (engine.files(), engine.docs(), engine.vectors(), engine.text_index().postings))
    # a changed file has new text and no vector
    newer = files.filter(F.col("path") != log).withColumn("modified_ts", F.col("modified_ts") + F.when(F.col("filename") == "chords.txt", 5).otherwise(0))
    text = spark.createDataFrame([("/srv/Music/chords.txt", "chords.txt", "txt", "a minor seventh")], DOCS)
    assert engine.sync(newer, roots, text)["modified"] == 1
    assert found(engine.search("seventh", NOW)) == ["Music/chords.txt"] and engine.vectors().filter("path like '%chords.txt'").count() == 0
    engine.remove_path("/srv/Boat")
    assert found(engine.search("impeller", NOW)) == [] and engine.vectors().filter("path like '/srv/Boat%'").count() == 0
    # a batch of a journal
    changes = spark.createDataFrame([(1, "/srv/Garden/seed order.md", False, False, True, False, False), (2, "/srv/Music/chords.txt", False, True, False, False, False)], "event_id long, path string, created boolean, modified boolean, removed boolean, renamed boolean, must_scan_dir boolean")
    listing = newer.filter("filename <> 'seed order.md'")
    engine.apply_changes(changes, listing, text.withColumn("content", F.lit("a major third")))
    assert found(engine.search("marigold", NOW)) == found(engine.search("seventh", NOW)) == [] and found(engine.search("third", NOW)) == ["Music/chords.txt"]


def size_of(folder):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(folder) for f in fs)


def test_store_copies_nothing(spark, tables, tmp_path):
    files, docs = tables
    engine = Engine(spark, str(tmp_path / "index"))
    engine.build(files, docs, now=NOW)
    before = {n: engine.store.paths(n) for n in ("files", "docs", "postings")}
    bytes_before = size_of(tmp_path)
    engine.track("/srv/Music/chords.txt", "open", NOW)
    engine.track("/srv/Music/chords.txt", "copy", NOW)
    assert {n: engine.store.paths(n) for n in before} == before and engine.interactions().count() == 2
    assert size_of(tmp_path) - bytes_before < 20_000
    engine.clear("interactions")
    assert engine.interactions().count() == 0


def test_store(spark, tmp_path):
    store = Store(str(tmp_path))
    store.publish({"a": spark.range(3)})
    store.publish({"b": spark.range(2)}, {"k": 1})
    assert store.generation() == 2 and store.read(spark, "a").count() == 3 and store.meta("k") == 1
    old = store.paths("a")[0]
    store.publish({"a": spark.range(4)})
    assert os.path.isdir(old) and store.read(spark, "a").count() == 4
    store.publish({}, append={"a": spark.range(1)})
    assert not os.path.isdir(old) and store.read(spark, "a").count() == 5
    with store.lock(), pytest.raises(LockHeld), store.lock():
        pass
    (tmp_path / "sync.lock").write_text(json.dumps({"host": __import__("socket").gethostname(), "pid": 2**22 + 5, "at": 0}))
    with store.lock():
        pass
    (tmp_path / "sync.lock").write_text(json.dumps({"host": "elsewhere", "pid": 1, "at": __import__("time").time()}))
    with pytest.raises(LockHeld), store.lock():
        pass
    log_error(str(tmp_path), "here", "what")
    assert recent_errors(str(tmp_path))[-1].endswith("[here] what")


def letters(texts):
    return [[float(t.lower().count(c)) + 0.1 for c in "aeiost"] for t in texts]


def test_embedding_and_its_index(spark, tables, tmp_path):
    files, docs = tables
    engine = Engine(spark, str(tmp_path / "index"))
    engine.build(files, docs, now=NOW)
    assert engine.embed(letters) == {"embedded": 7, "touched": 0, "failed": 0} and engine.embed(letters) == {"embedded": 0, "touched": 0, "failed": 0}
    for r in engine.vectors().collect():
        near = engine.similar(list(r["vector"]), 3).collect()
        assert near[0]["similarity"] > 0.99 and r["path"] in [x["path"] for x in near]
    model = engine.store.meta("ann_model")
    later = files.withColumn("modified_ts", F.col("modified_ts") + 1)
    engine.sync(later.filter("filename <> 'chords.txt'"), spark.createDataFrame([("/srv",)], "root string"))
    assert engine.embed(letters)["embedded"] == 6 and engine.store.meta("ann_model") != model and engine.store.meta("ann_count") == 6

    calls = []

    def query(text):
        calls.append(text)
        return letters([text])[0]

    assert engine.query_vector("Tomato", query) == engine.query_vector("tomato ", query) and len(calls) == 1
    plain, full = engine.two_phase("tomato", query, NOW)
    assert set(found(plain)) <= set(found(full))


def test_failed_batches_stay_to_be_done(spark, tables):
    files, docs = tables

    def fails(texts):
        if any("impeller" in t for t in texts):
            raise OSError("no answer")
        return letters(texts)

    todo = files.filter("not is_dir").select("path", "filename", "extension", "modified_ts").repartition(1)
    had = spark.createDataFrame([], "path string, vec_id long, vector array<float>, mtime long, embed_hash string")
    made, touched, failed = jobs.embed(todo, docs, had, fails, batch=1, pause=0.0)
    assert made.count() == 6 and touched.count() == 0 and [r["path"] for r in failed.collect()] == ["/srv/Boat/engine_manual.pdf"]


def test_recognition(spark, tables, tmp_path):
    files, docs = tables
    images = spark.createDataFrame([row(f"/srv/scan{i}.png", 5, 3) for i in range(4)], FILES)
    engine = Engine(spark, str(tmp_path / "index"))
    engine.build(files.unionByName(images), docs, now=NOW)

    def read(paths):
        out = {"/srv/scan0.png": {"text": "harbour dues", "confidence": 0.9}, "/srv/scan1.png": {"text": "smudge", "confidence": 0.1}, "/srv/scan2.png": {"error": "broken"}}
        return [{"path": p, **out[p]} for p in paths if p in out]

    assert engine.ocr(read) == {"done": 2, "failed": 2} and engine.status()["ocr"] == [4, 2]
    assert found(engine.search("harbour", NOW)) == ["scan0.png"] and found(engine.search("smudge", NOW)) == []
    assert engine.ocr(read)["done"] == 0 and any("broken" in e for e in engine.doctor()["errors"])


def test_interactions_of_many_and_of_few_candidates(spark):
    events = spark.createDataFrame([("/hot", "open", NOW)] * 50 + [("/b", "open", NOW), (None, "open", NOW)], "path string, action string, timestamp long")
    wanted = spark.createDataFrame([("/hot",), ("/c",)], "path string")
    few, many = (interactions.for_candidates(events, wanted, NOW, most).collect() for most in (10, 0))
    assert few == many and [(r["path"], r["interactions"]) for r in few] == [("/hot", 50)]


def test_scan_tree(spark, tmp_path):
    (tmp_path / "a/node_modules").mkdir(parents=True)
    (tmp_path / "a/x.TXT").write_text("x")
    (tmp_path / "a/.hidden").write_text("h")
    (tmp_path / "a/node_modules/y.js").write_text("y")
    rows = {r["filename"]: r for r in scan_tree(spark, [str(tmp_path)]).collect()}
    assert rows["x.TXT"]["extension"] == "txt" and rows["a"]["is_dir"] and "y.js" not in rows


def test_diff_and_drift(spark):
    new = spark.createDataFrame([("/r/a", 5), ("/r/b", 9)], "path string, modified_ts long")
    old = spark.createDataFrame([("/r/b", 8), ("/r/c", 1), ("/s/d", 1)], "path string, modified_ts long")
    roots = spark.createDataFrame([("/r",)], "root string")
    assert [r[0] for r in sync.diff_new(new, old).select("path").collect()] == ["/r/a"]
    assert [r[0] for r in sync.diff_modified(new, old).select("path").collect()] == ["/r/b"]
    assert [r[0] for r in sync.diff_deleted(new, old, roots).select("path").collect()] == ["/r/c"]
    assert sync.drifted(84, 100) and not sync.drifted(85, 100)


def test_empty_tables(spark, tables):
    files, docs = tables
    assert unified_search(files.limit(0), docs.limit(0), "anything", Options(now=NOW)).count() == 0


def test_deletions_below_very_many_roots(spark):
    from siftline.operators.sync import MAX_ROOTS, diff_deleted

    n = MAX_ROOTS + 50
    roots = spark.createDataFrame([(f"/r/{i}" + "/" * (i % 2),) for i in range(n)], "root string")
    indexed = spark.createDataFrame([(f"/r/{i}/a/b.txt",) for i in range(n)] + [("/r/4",), ("/r/5",), ("/r/6x/a",), ("/s",), ("x",), ("/r/7/seen",)], "path string")
    scanned = spark.createDataFrame([("/r/7/seen",)], "path string")
    got = [r[0] for r in diff_deleted(scanned, indexed, roots).collect()]
    assert sorted(got) == sorted([f"/r/{i}/a/b.txt" for i in range(n)] + ["/r/4"])

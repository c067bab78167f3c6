import re

import numpy as np
import pandas as pd
import pytest

pytest.importorskip("siftline.llm")

from siftline.llm import ann, leak, neardup, ocr, pack, queries, split, subjects  # noqa: E402
from tests.oracle import compare  # noqa: E402


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, sf, name):
    compare(spark, sf, queries.queries()[name], queries.oracle_sql()[name])


#: Queries without SQL, and what must hold of their rows.
HOLDS = {
    "p1_pieces": lambda d: (d["n_chars"] <= 2000).all() and (d["overlap"] <= 200).all(),
    "p2_found": lambda d: set(d["kind"]) == {"running", "page_number", "hyphen", "misread"} and not d.duplicated().any() and (d["line_no"] > 0).all(),
    "p2_paragraphs": lambda d: not d.duplicated(["path", "block", "paragraph_no"]).any() and (d["text"].str.strip() != "").all(),
    "p4_found": lambda d: (d["vec_id_a"] < d["vec_id_b"]).all() and not d.duplicated().any(),
    "p4_neighbours": lambda d: (d["vec_id"] != d["other_id"]).all() and d["sim"].between(-1.0001, 1.0001).all() and (d.groupby("vec_id").size() == 10).all(),
    "p5_classes": lambda d: (d["class_id"] <= d["content_id"]).all() and (d.groupby("class_id")["content_id"].nunique() == d.groupby("class_id")["copies"].first()).all(),
    "p5_name_classes": lambda d: (d["copies"] >= 1).all() and d.groupby("class_id")["links"].nunique().eq(1).all() and not d["id"].duplicated().any(),
    "p6_containers": lambda d: d.groupby("container")["n_tokens"].sum().max() <= 1024 and not d.duplicated(["doc_id", "piece_no", "container", "start"]).any(),
    "p6_fill": lambda d: d["fill"].iloc[0] > 0.95 and d["most"].iloc[0] <= 1024,
    "p7_matches": lambda d: set(d["kind"]) <= {"phrase", "proximity"} and (d[d["kind"] == "phrase"]["n_words"] >= 12).all(),
    "p8_found": lambda d: not d.duplicated().any() and d["subject"].nunique() == 8,
    "p8_composition": lambda d: len(d) == 8 and (d["documents"] > 0).all() and (d["sentences"] >= d["documents"]).all(),
}


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql())))
def test_what_holds_of_queries_without_sql(spark, sf, name):
    rows = queries.queries()[name](spark, sf).toPandas()
    assert len(rows) and HOLDS[name](rows)


# splitting


def pieces(spark, texts, limit=50, overlap=10):
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], "content_id long, content string, piece_no int, _text string")
    return split.split_texts(df, "content_id", "content", limit, overlap).orderBy("content_id", "piece_no").collect()


def test_split_round_trip(spark):
    texts = ["a" * 130, "One sentence here. " * 12, "para one\n\npara two\r\n \r\nlast " * 6, "句子在这里。" * 20, "w " * 90, None, "", "  \n ", "short", " " * 70 + "end", "😀" * 60]
    rows = pieces(spark, texts)
    for i, text in enumerate(texts):
        mine = [r for r in rows if r["content_id"] == i]
        assert bool(mine) == bool(text and text.strip())
        at = 0
        for r in mine:
            assert len(r["piece"]) <= 50 and text[r["start"] - 1 : r["start"] - 1 + r["n_chars"]] == r["piece"] and r["overlap"] <= 10
            assert not text[at : r["start"] - 1 + r["overlap"]].strip()
            at = r["start"] - 1 + r["n_chars"]
        assert not text or not text[at:].strip()


def boundary(text, body):
    patterns = [r"\r?\n[ \t]*\r?\n", r"\r?\n", r"(?<=[.!?])\s+|(?<=[。！？])", r"\s+"]
    for i, kind in enumerate(split.KINDS[:4]):
        if max(len(u.strip()) for u in re.split("|".join(patterns[: i + 1]), text)) <= body:
            return kind
    return "none"


def test_split_boundary(spark):
    rng = np.random.default_rng(1)
    texts = ["".join(rng.choice(["ab", "c", " ", ".", "\n", "\n\n", "。", "\r\n"], p=[0.4, 0.3, 0.12, 0.06, 0.04, 0.03, 0.03, 0.02], size=120)) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, t string")
    got = dict(split.oversized(df, "k", "t", 50, 10).collect())
    assert got == {i: boundary(t, 40) for i, t in enumerate(texts) if len(t) > 50}


# packing


def test_balance():
    rng = np.random.default_rng(2)
    sizes = np.sort(rng.integers(1, 1024, 400))[::-1]
    seq = pack.balance(sizes, 1024)
    used = np.bincount(seq, weights=sizes)
    assert used.max() <= 1024 and sizes.sum() / (1024 * len(used)) > 0.95


def test_pack(spark):
    docs = spark.createDataFrame([(1, "word " * 40, 0), (1, "word " * 40, 0), (2, None, 0), (3, "", 0), (4, "a b c", 0), (None, "x", 0)], "doc_id long, text string, seq int")
    rows = pack.pack_documents(docs, "doc_id", "text", capacity=16).collect()
    assert sum(r["n_tokens"] for r in rows if r["doc_id"] == 1) == 82 and {r["doc_id"] for r in rows} == {1, 4, None}
    totals: dict = {}
    for r in rows:
        totals[r["container"]] = totals.get(r["container"], 0) + r["n_tokens"]
    assert max(totals.values()) <= 16
    assert pack.pack_documents(docs.limit(0), "doc_id", "text").count() == 0


def test_plain_method_and_cut_texts(spark):
    sizes = np.sort(np.random.default_rng(2).integers(1, 1024, 400))[::-1]
    assert np.bincount(pack.balance(sizes, 1024, snug=0), weights=sizes).max() <= 1024
    docs = spark.createDataFrame([(1, "word " * 40), (1, "word " * 40), (2, "a b"), (3, None), (4, " word" * 16)], "doc_id long, text string")
    assert sorted(r[0] for r in pack.oversized_documents(docs, "doc_id", "text", 16).collect()) == [1, 1]


# vectors


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(30, 64))
    v = centers[rng.integers(0, 30, 1500)] + 0.3 * rng.normal(size=(1500, 64))
    v[100:120] = v[99]  # a class of copies larger than k
    rows = [(i, f"/p/{i}", [float(x) for x in v[i]], 5, "z") for i in range(1500)]
    rows += [(5000, "/p/0", [1.0] * 64, 1, "z"), (5001, "/q", None, 1, "z"), (5002, "/r", [0.0] * 64, 1, "z"), (5003, "/s", [float("nan")] * 64, 1, "z"), (5004, None, [1.0] * 64, 1, "z"), (5005, "/t", [1.0] * 3, 1, "z")]
    df = spark.createDataFrame(rows, "vec_id long, path string, vector array<float>, mtime long, rid string")
    got = ann.similar_vectors(df, k=10).toPandas()
    assert got.vec_id.nunique() == 1500 and got.groupby("vec_id").size().eq(10).all() and (got.vec_id != got.other_id).all()
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    sims = unit @ unit.T
    np.fill_diagonal(sims, -2)
    kth = np.sort(sims, axis=1)[:, -10]
    assert np.mean([sims[a, b] >= kth[a] - 1e-6 for a, b in zip(got.vec_id, got.other_id)]) >= 0.9
    assert ann.similar_vectors(df.limit(0)).count() == 0


@pytest.mark.parametrize("options", [{}, {"list_rows": 24}, {"list_rows": 24, "max_coarse": 32}])
def test_probes_grow_with_the_lists(spark, options):
    """With few lists, with very many (500), and with as many of two levels."""
    rng = np.random.default_rng(6)
    v = rng.normal(size=(12_000, 16)) @ rng.normal(size=(16, 64))
    df = spark.createDataFrame([(i, f"/p/{i}", x, 5) for i, x in enumerate(v.tolist())], "vec_id long, path string, vector array<float>, mtime long")
    got = ann.similar_vectors(df, k=10, **options).toPandas()
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    some = got[got.vec_id < 400]
    sims = unit[:400] @ unit.T
    sims[np.arange(400), np.arange(400)] = -2
    kth = np.sort(sims, axis=1)[:, -10]
    assert np.mean([sims[a, b] >= kth[a] - 1e-6 for a, b in zip(some.vec_id, some.other_id)]) >= 0.9


# near-duplicates


def brute(sets, t):
    keys = sorted(sets)
    return {(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= t - 1e-12}


@pytest.mark.parametrize("t, n", [(0.6, 3), (0.8, 5)])
def test_similar_texts_against_brute_force(spark, t, n):
    rng = np.random.default_rng(4)
    texts = {}
    for i in range(120):
        base = [f"w{x}" for x in rng.integers(0, 60, rng.integers(8, 150))]
        for j in range(3):
            ws = list(base)
            for _ in range(rng.integers(0, 6)):
                ws[rng.integers(0, len(ws))] = f"w{rng.integers(0, 60)}"
            texts[len(texts)] = " ".join(ws)
    df = spark.createDataFrame([(i, x, i) for i, x in texts.items()] + [(1000, None, 1), (1001, "", 1), (1002, "too few words", 1)], "id long, content string, class long")
    got = {tuple(r) for r in neardup.similar_texts(df, "id", "content", t, n).collect()}
    sets = {i: {tuple(x.split()[j : j + n]) for j in range(len(x.split()) - n + 1)} for i, x in texts.items()}
    assert got == brute(sets, t)


def test_similar_names_against_brute_force(spark):
    rng = np.random.default_rng(5)
    parts = ["budget", "notes", "report", "final", "draft", "2021", "2022"]
    names = {i: "_".join(rng.choice(parts, 3)) + str(rng.integers(0, 9)) + rng.choice([".pdf", ".md", ""]) for i in range(200)}
    df = spark.createDataFrame([(i, x) for i, x in names.items()] + [(900, None), (901, "a"), (902, ".profile")], "id long, filename string")
    got = {tuple(r) for r in neardup.similar_names(df, "id", "filename", 0.7).collect()}
    sets = {i: {neardup.bare_name(x)[j : j + 3] for j in range(len(neardup.bare_name(x)) - 2)} for i, x in names.items()}
    assert got == {(a, b) for a, b in brute(sets, 0.7) if names[a] != names[b]}


def test_long_lists_of_keys_are_refined(spark, monkeypatch):
    """Of names that share parts, the keys of long lists get an element more: the same pairs, from fewer pairs looked at."""
    rng = np.random.default_rng(8)
    letters = list("abcd")
    names = {i: "quarterly_" + "".join(rng.choice(letters, rng.integers(3, 16))) + "_minutes" for i in range(500)}
    names |= {1000 + i: x[:-3] + "z" + x[-2:] for i, x in names.items() if i < 100}
    df = spark.createDataFrame(list(names.items()), "id long, filename string")
    sets = {i: {neardup.bare_name(x)[j : j + 3] for j in range(len(neardup.bare_name(x)) - 2)} for i, x in names.items()}
    want = {(a, b) for a, b in brute(sets, 0.7) if names[a] != names[b]}
    pdf = neardup.name_sets(df.withColumnRenamed("filename", "text")).toPandas().drop_duplicates("class")
    counts = next(neardup._count(iter([pdf])))
    counts = np.concatenate([np.frombuffer(neardup.zlib.decompress(c), np.int64) for c in counts["counts"]])

    def looked_at(of_keys=None):
        keys = neardup._keyed(pdf, counts, 0.7, 2, of_keys)[0]
        n = np.unique(keys, return_counts=True)[1]
        return int((n * (n - 1) // 2).sum())

    of_keys = np.bincount((neardup._keyed(pdf, counts, 0.7, 2)[0] & np.uint64(neardup.SKETCH - 1)).astype(np.int64), minlength=neardup.SKETCH)
    monkeypatch.setattr(neardup, "WORTH", 0)
    for most in (10_000, 3):
        monkeypatch.setattr(neardup, "REFINE", most)
        assert {tuple(r) for r in neardup.similar_names(df, "id", "filename", 0.7).collect()} == want
    monkeypatch.setattr(neardup, "REFINE", 3)
    assert len(want) > 90 and looked_at(of_keys) < 0.8 * looked_at()


def test_hot_class_is_a_star(spark):
    members = spark.createDataFrame([(i, 0, 5) for i in range(5)], "id long, class_id long, copies long")
    links = spark.createDataFrame([], "a long, b long, jaccard double")
    assert {tuple(r) for r in neardup.expand_pairs(members, links, expand=3).collect()} == {(0, i) for i in range(1, 5)}
    assert neardup.expand_pairs(members, links, expand=5).count() == 10


def test_large_classes_are_paired_in_full(spark):
    names = [f"syslog_of_host.{i}" for i in range(230)] + ["syslog-of-hosts.txt", "other words"]
    df = spark.createDataFrame(list(enumerate(names)), "id long, filename string")
    got = [tuple(r) for r in neardup.similar_names(df, "id", "filename", 0.7).collect()]
    assert len(got) == len(set(got)) and set(got) == {(a, b) for b in range(231) for a in range(b)}
    text = "the same text of more than eight words stands in many rows"
    df = spark.createDataFrame([(i, text) for i in range(230)] + [(230, text + " here")], "id long, content string")
    assert {tuple(r) for r in neardup.similar_texts(df, "id", "content").collect()} == {(a, b) for b in range(231) for a in range(b)}


def test_pairs_in_blocks(spark):
    members = spark.createDataFrame([(i, 0, 50) for i in range(50)] + [(i, 50, 30) for i in range(50, 80)] + [(80, 80, 1)], "id long, class_id long, copies long")
    links = spark.createDataFrame([(0, 50, 0.8), (50, 80, 0.8)], "a long, b long, jaccard double")
    got = [tuple(r) for r in neardup.expand_pairs(members, links, block=7).collect()]
    assert len(got) == len(set(got)) and set(got) == {(a, b) for b in range(81) for a in range(b) if (a, b) not in {(x, 80) for x in range(50)}}


def test_split_lists_lose_no_pair():
    size, pos = np.array([10] * 60), np.zeros(60, dtype=int)
    pairs = [x for u, v in neardup.list_pairs(np.array([0]), np.array([60]), size, pos, 0.6) for x in zip(u, v)]
    assert len(set(pairs)) == len(pairs) == 60 * 59 // 2


def test_rows_of_hot_names_are_paired_in_blocks(spark):
    rows = [(i, "budget report 2021.pdf") for i in range(60)] + [(i, "budget report 2022.pdf") for i in range(60, 110)] + [(200, "else.txt")]
    df = spark.createDataFrame(rows, "id long, filename string")
    got = [tuple(r) for r in neardup.similar_names(df, "id", "filename", 0.7, block=8).collect()]
    assert len(got) == len(set(got)) and set(got) == {(a, b) for a in range(60) for b in range(60, 110)}
    classes = {r["id"]: (r["class_id"], r["copies"], r["links"]) for r in neardup.grouped_names(df, "id", "filename", 0.7).collect()}
    assert classes == {i: (0 if i < 60 else 60 if i < 200 else 200, 1, 1 if i < 200 else 0) for i in classes} and len(classes) == 111


# leaks


def test_one_index_serves_several_evaluation_sets(spark):
    texts = [" ".join(f"{c}{i}" for i in range(30)) for c in "abc"]
    docs = spark.createDataFrame(list(enumerate([*texts, "cafe\u0301 " + texts[0]])), "doc_id long, text string")
    index = leak.positional_index(docs, "doc_id", "text", segment_tokens=40).persist()
    schema = "item_id long, passage string"
    found = lambda rows, **o: {tuple(r)[:2] for r in leak.find_passages(index, "doc_id", spark.createDataFrame(rows, schema), "item_id", "passage", **o).collect()}
    assert found([(7, texts[0])]) == {(0, 7), (3, 7)} and found([(8, texts[1][4:])]) == {(1, 8)}
    several = [(i, t) for i, t in enumerate(texts)]
    assert found(several, eval_words=35) == found(several) == {(0, 0), (3, 0), (1, 1), (2, 2)}
    passage = spark.createDataFrame([(1, "caf\xe9 " + " ".join(f"a{i}" for i in range(11)))], schema)
    count = lambda **o: leak.leaked_passages(docs, "doc_id", "text", passage, "item_id", "passage", **o).count()
    assert count() == 0 and count(compose=True) == 1


def test_leaks(spark):
    passage = " ".join(f"p{i}" for i in range(20))
    docs = [
        (1, "x y " + passage + " z"), (2, " ".join(f"p{i}" for i in range(3, 15))), (3, " ".join(f"p{i}" for i in range(3, 14))), (4, None), (5, ""), (6, " ".join(f"p{i}" for i in range(19, -1, -1))), (7, "P0, " + passage[2:].upper()),
    ]
    d = spark.createDataFrame([(*r, 0) for r in docs], "doc_id long, text string, _item int")
    items = spark.createDataFrame([(1, passage), (2, None), (3, "too short"), (4, "p0 " * 15)], "item_id long, passage string")
    rows = leak.leaked_passages(d, "doc_id", "text", items, "item_id", "passage", kinds=("phrase", "proximity")).collect()
    assert {(r["doc_id"], r["item_id"], r["n_words"]) for r in rows if r["kind"] == "phrase"} == {(1, 1, 20), (2, 1, 12), (7, 1, 20)}
    assert {r["doc_id"] for r in rows if r["kind"] == "proximity"} == {1, 6, 7}
    assert leak.leaked_passages(d.limit(0), "doc_id", "text", items, "item_id", "passage").count() == 0


# subjects


def test_sentences():
    text = "# A heading\n\n> First line goes on\n> and ends here. Second one is short!\n\n- item one has words\n12:30:01 INFO the log line ran fine.\nTo: Someone\n| 1 | a table row is here. |"
    got = [" ".join(s) for s in subjects.sentences(text)]
    assert "first line goes on and ends here" in got and "second one is short" in got and "the log line ran fine" in got and "a table row is here" in got
    assert not any("heading" in s or "someone" in s for s in got)


def test_held_out_examples(spark, sf):
    """Examples that were held out get their labels back."""
    rows = spark.read.parquet(f"{sf}/subject_examples.parquet")
    train, held = rows.filter("example_id % 5 <> 0"), rows.filter("example_id % 5 = 0")
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(held.select((-100 - held.example_id).alias("doc_id"), "text"))
    got: dict = {}
    for r in subjects.document_subjects(docs, "doc_id", "text", train).collect():
        got.setdefault(r["doc_id"], set()).add(r["subject"])
    want = {-100 - r["example_id"]: set(r["subjects"]) for r in held.collect()}
    assert np.mean([got.get(k, set()) == v for k, v in want.items()]) >= 0.85


def _subjects(spark, rounds, **options):
    """Documents of two subjects; each shares words with the seeds or only with other documents of its subject."""
    rng = np.random.default_rng(9)
    vocabulary = {s: [f"{s}{i:02d}x" for i in range(40)] for s in ("law", "sea")}
    plain = [f"plain{i:02d}" for i in range(60)]

    def text(words):
        return " ".join(" ".join([*rng.choice(words, 6), *rng.choice(plain, 4)]) + "." for _ in range(8))

    docs = [(i, text(vocabulary["law" if i % 2 else "sea"][(0 if i < 200 else 16) : (24 if i < 200 else 40)])) for i in range(400)] + [(1000 + i, text(plain)) for i in range(40)]
    seeds = [(i, text(vocabulary[s][:16]), [s]) for i, s in enumerate(["law", "sea"] * 12)] + [(100 + i, text(plain), []) for i in range(6)]
    d = spark.createDataFrame([*docs, (5000, None), (5001, ""), (5002, "  ")], "doc_id long, text string")
    e = spark.createDataFrame(seeds, "example_id long, text string, subjects array<string>")
    return {(r["doc_id"], r["subject"]) for r in subjects.document_subjects(d, "doc_id", "text", e, rounds=rounds, **options).collect()}


def test_propagation_decides(spark):
    want = {(i, "law" if i % 2 else "sea") for i in range(400)}
    got = _subjects(spark, 3)
    assert len(got & want) >= 0.97 * len(want) and len(got - want) <= 8
    assert len(_subjects(spark, 1) & want) < len(got & want)
    assert not _subjects(spark, 0)
    assert _subjects(spark, 3, max_broadcast=0) == got


def test_edges_do_not_hang_on_batches_and_segments(spark):
    """One list of 600 entries, in small batches and segments: the edges are those of the list as a whole."""
    rng = np.random.default_rng(12)
    common = rng.integers(0, 2**63, 40, dtype=np.uint64)
    node = lambda i: np.append(common, rng.integers(0, 2**63, 3, dtype=np.uint64)).tobytes()
    parsed = spark.createDataFrame([(2 * i, node(i)) for i in range(584)] + [(2 * i + 1, node(i)) for i in range(1)], "id long, words binary")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        edges = lambda **o: {(r["a"], r["b"]) for r in subjects.document_graph(parsed, np.zeros(0, dtype=np.uint64), **o).collect()}
        got, cut = edges(), edges(segment=37)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    sketches = pd.concat(subjects._sketch(_Shared(np.zeros(0, dtype=np.uint64)))([parsed.toPandas()]))
    rows = [(int(r.id), int(k), p) for r in sketches.itertuples() for k in r.keys for p in range(subjects.SEED_PLACES if r.id % 2 else 1)]
    lists = spark.createDataFrame(rows, "id long, key long, place int").selectExpr("key", "id", "xxhash64(id, place) AS h").orderBy("key", "h").collect()
    sample = {r.id: np.frombuffer(r.sample, np.uint16) for r in sketches.itertuples()}
    want: set = set()
    for i, x in enumerate(lists):
        for seed in (False, True):
            for side in (lists[i + 1 :], lists[:i][::-1]):
                y = next((y for y in side if y["key"] != x["key"] or (y["id"] % 2 == 1) == seed), None)
                if y and y["key"] == x["key"] and y["id"] != x["id"] and (seed or x["id"] % 2 == 0):
                    want.add((min(x["id"], y["id"]), max(x["id"], y["id"])))
    want = {(a, b) for a, b in want if (sample[a] == sample[b]).mean() >= subjects.SIMILAR}
    assert len(want) > 1000 and got == cut == want


class _Shared:
    def __init__(self, value):
        self.value = value


def test_no_seeds(spark):
    docs = spark.createDataFrame([(1, "text"), (2, None)], "doc_id long, text string")
    examples = spark.createDataFrame([], "example_id long, text string, subjects array<string>")
    assert subjects.document_subjects(docs, "doc_id", "text", examples).count() == 0


# scanned pages


def lexicon():
    words = {w: (1000, 0, 100) for w in "the house is below water and modern day outline well-known known in depth in-depth report continues here again".split()}
    return ocr.Lexicon(words, 100, dict.fromkeys(words, np.ones(2, dtype=np.float32) / np.float32(2**0.5)))


def test_page_numbers():
    assert ocr.page_number("  - l2 -")[0] == 12 and ocr.page_number("Page 3 of 10")[0] == 3 and ocr.page_number("xiv")[0] == 14 and ocr.page_number("[2O]")[0] == 20
    assert ocr.page_number("Page 3 says") is None and ocr.page_number("") is None and ocr.page_number("the end") is None


def test_read_block():
    pages = [ocr._Page(i, i, f"ANNUAL REP0RT   {i}\n\nthe h0use is bel0w the rnodern out-\nline and the in-\ndepth report con-\n\n- {i} -", True) for i in (1, 2)]
    pages[1].lines[2] = "tinues the house"
    marks, clean = ocr.read_block(pages, lexicon())
    assert marks[0, 0] == {"running"} and marks[1, 6] == {"page_number"}
    assert marks[0, 2] == {"misread", "hyphen"} and (0, 3) not in marks and marks[0, 4] == {"hyphen"}
    assert clean[0, 2][0] == "the house is below the modern out-"


def test_vectors_link_and_choose():
    """Of two words equally near in glyphs the context chooses, it corrects words that exist, and without vectors nothing is linked."""
    words = {"butter": (300, 0, 90), "buffer": (310, 0, 90), "melt": (400, 0, 90), "pan": (400, 0, 90), "thread": (400, 0, 90), "cache": (400, 0, 90)}
    kitchen, machine = np.array([1, 0], dtype=np.float32), np.array([0, 1], dtype=np.float32)
    vectors = {w: kitchen if w in ("butter", "melt", "pan") else machine for w in words}
    lines = {"melt the bufter pan": "melt the butter pan", "thread cache bufter thread": "thread cache buffer thread", "cache thread butter cache thread": "cache thread buffer cache thread", "melt butter pan": "melt butter pan"}
    for line, fixed in lines.items():
        read = lambda v, line=line: ocr.read_block([ocr._Page(1, 1, f"{line} and\nso it goes on here.", True)], ocr.Lexicon(words, 100, v))
        marks, clean = read(vectors)
        assert clean[0, 0][0] == fixed + " and" and ((0, 0) in marks) == (line != fixed)
        assert read({})[1][0, 0][0] == line + " and"


def test_roots_hold_all_edits():
    for seen, true in ocr.GLYPHS:
        assert ocr.root(seen) == ocr.root(true)
    assert ocr.root("in-" + "depth") == ocr.root("in-") + ocr.root("depth")


SCANS = "ocr_id long, path string, page_no int, text string, confidence double, error string"


def test_joined_lexicon_reads_alike(spark, sf, monkeypatch):
    monkeypatch.setattr(ocr, "learn_vectors", lambda pages, counts: {r[0]: np.ones(2, dtype=np.float32) / np.float32(2**0.5) for r in counts.select("word").collect()})
    pages = spark.read.parquet(f"{sf}/ocr_results.parquet")
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    marks = rows(ocr.line_marks(pages))
    assert {k for _, _, k in marks} == {"running", "page_number", "hyphen", "misread"}
    assert rows(ocr.line_marks(pages, max_words=0)) == marks


def test_words_beyond_the_vectors_learned_together_are_linked(spark, sf):
    """With vectors of 100 words learned together, all others that are seen often have one too, and words are still corrected."""
    pages = spark.read.parquet(f"{sf}/ocr_results.parquet")
    text = ocr.usable_pages(pages).select("text").distinct()
    counts = ocr.word_counts(text).persist()
    vectors = ocr.learn_vectors(text, counts, most=100)
    others = {r["word"]: np.frombuffer(r["vector"], np.float32) for r in ocr.other_vectors(text, vectors).collect()}
    often = {r["word"] for r in ocr._tokens(text).selectExpr("explode(tokens) AS word").groupBy("word").count().filter(f"count >= {ocr.MIN_VECTOR}").collect()}
    assert len(vectors) == 100 and not set(vectors) & set(others) and set(vectors) | set(others) == often and len(often) > 300
    assert all(abs(np.linalg.norm(v) - 1) < 1e-4 for v in others.values())
    rows = lambda **o: {tuple(r) for r in ocr.line_marks(pages, **o).collect() if r["kind"] == "misread"}
    whole, few = rows(), rows(max_vectors=100)
    assert len(whole & few) >= 0.9 * len(whole)


def test_headers_that_recur_far_apart(spark):
    n = ocr.BLOCK_PAGES
    body = "the modern house is below the water and the day"
    rows = [(i, "/a", i, f"{'Annual Report' if i in (5, 3 * n + 5) else 'about the house'}\n{body}\n{i + 7}", 0.9, None) for i in (5, n + 9, 2 * n + 20, 3 * n + 5)]
    got = {tuple(r) for r in ocr.line_marks(spark.createDataFrame(rows, SCANS)).collect()}
    assert {(5, 1, "running"), (3 * n + 5, 1, "running")} <= got and {(i, 3, "page_number") for i in (5, n + 9, 2 * n + 20, 3 * n + 5)} <= got


def test_line_marks_edge_cases(spark):
    schema = "ocr_id long, path string, page_no int, text string, confidence double, exif struct<date_taken:string,gps:string>, error string, block int"
    text = "Title Of It\nthe text goes on here\n1"
    rows = [(1, "/a", 1, text, 0.9, None, None, 0), (2, "/a", 2, text.replace("\n1", "\n2"), 0.9, None, None, 0), (3, "/a", 2, text.replace("\n1", "\n2"), 0.9, None, None, 0), (4, "/a", 3, None, 0.9, None, None, 0), (5, None, None, text, None, None, None, 0), (6, "/a", 4, text, 0.9, None, "failed", 0), (7, "/b", 1, "", 0.9, None, None, 0)]
    got = {(r["ocr_id"], r["line_no"], r["kind"]) for r in ocr.line_marks(spark.createDataFrame(rows, schema)).collect()}
    assert {(i, 1, "running") for i in (1, 2, 3)} <= got and {(i, 3, "page_number") for i in (1, 2, 3)} <= got and not {g[0] for g in got} - {1, 2, 3}
    assert ocr.line_marks(spark.createDataFrame([], schema)).count() == 0
    assert ocr.repaired_paragraphs(spark.createDataFrame(rows, schema)).count() >= 1


def test_paragraphs_go_on_over_block_ends(spark):
    schema = "ocr_id long, path string, page_no int, text string, confidence double, error string"
    n = ocr.BLOCK_PAGES
    pages = {n - 2: "the modern house is below.", n - 1: "   the outline of the day con-", n: "tinues here and", 2 * n: "is well known\n\nwater is below.", 3 * n: "   again the house"}
    rows = [(i, "/a", i, x, 0.9, None) for i, x in pages.items()] + [(1000 + i, f"/b{i}", 1, "the day continues here and the water is below the house again", 0.9, None) for i in range(5)]
    got = [tuple(r) for r in ocr.repaired_paragraphs(spark.createDataFrame(rows, schema)).filter("path = '/a'").orderBy("block", "paragraph_no").select("block", "page_no", "text").collect()]
    assert got == [(0, n - 2, "the modern house is below."), (0, n - 1, "the outline of the day continues here and is well known"), (2, 2 * n, "water is below."), (3, 3 * n, "again the house")]

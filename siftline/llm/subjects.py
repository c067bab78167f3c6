"""Subject areas of documents (problem 8): labels propagated over a verified document-similarity graph.

Documents and labelled examples are the nodes. Edges are proposed between neighbours in the lists of documents that share
a sampled term, and verified by the similarity of their sets of terms. Label vectors, one entry a subject and one for
"none", travel over the edges by joins for a few rounds; examples that the other examples support are clamped seeds. What
the documents came to be labelled tells which terms speak of a subject, and a document keeps every subject that enough of
its sentences are about and that the graph, or several different terms, bear out.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftline.llm.words import WordIds, mix
from siftline.runtime import bounded_broadcast, stage

#: Most labelled examples held on the driver; a larger table is sampled down to this many.
MAX_EXAMPLES = 50_000
#: A term that speaks of a subject is in at least this many documents.
MIN_DOCS = 5
#: A term of at least so many seeds says nothing of similarity if no subject (nor "none") has this share of them.
SEEN, TELLING = 4, 0.5
#: Samples of a document's terms, and how many of these propose edges.
SAMPLES, LISTS = 32, 8
#: Share of equal samples (an estimate of the Jaccard similarity of the terms) that an edge must show.
SIMILAR = 0.2
#: Places of each seed in a list, so that no document of a long one is far from one.
SEED_PLACES = 16
#: Entries of a list, or of a segment of a longer one, that one task links at a time.
SEGMENT = 20_000
#: Power to which labels are raised before terms learn from them.
CLEARER = 4
#: How far the share of one subject in the documents of a term must be from its share in all documents towards 1, after two standard errors.
AGREEMENT = 0.12
#: Share of the subjects' labels (without "none") that is that one's.
LEANING = 0.4
#: Terms that speak of a subject which are broadcast, at most; more are joined.
MAX_BROADCAST = 1_000_000
#: Words of a sentence where punctuation tells none.
SENTENCE_WORDS = 12

_BREAK = re.compile(r"(?<=[.!?。！？])[\"'”»)\]]*\s+|(?<=[。！？])")
_MARK = re.compile(r"(?:[-*•+]|\d{1,4}[.)]|[a-z]\))\s+|\d{1,2}:\d{2}(?::\d{2})?\S*\s+(?:[A-Z]{3,8}\s+)?|\[[^\]]*\]\s+|\|\s*(?:\d+\s*\|\s*)?")
#: A compound with hyphens is one word here ("cross-border" is no border).
_WORD = re.compile(r"[^\W_]+(?:[-‐‑][^\W_]+)*")
_QUOTE = re.compile(r"(?:>\s?)+")
_TAG = re.compile(r"<[^<>]{1,200}>")


def composed(text: str) -> str:
    return (text if text.isascii() else unicodedata.normalize("NFC", text)).lower()


def terms(text: str) -> set[str]:
    """Words of a text without numbers."""
    return {w for w in _WORD.findall(composed(text)) if not w.isdigit() and len(w) > 1}


def sentences(text: str) -> list[list[str]]:
    """Words of each sentence. Wrapped lines are joined; quote marks, list marks, log stamps, table bars and tags are no text;
    headings and other short lines without an end mark are no sentences; unpunctuated text is cut into even pieces."""
    units: list[list[str]] = []
    fresh = True
    for line in _TAG.sub("\n", text).splitlines():
        line = line.strip()
        quoted = _QUOTE.match(line)
        line = line[quoted.end() :].strip() if quoted else line
        mark = _MARK.match(line)
        if not line or line[0] == "#":
            fresh = True
            if not line:
                continue
        if fresh or mark:
            units.append([])
        units[-1].append(line[mark.end() :] if mark else line)
        fresh = line[0] == "#"
    out = []
    for unit in units:
        for part in _BREAK.split(" ".join(unit).strip(" |")):
            found = _WORD.findall(composed(part))
            if len(found) < 3 or (len(found) < 6 and part[-1:] not in ".!?。！？"):
                continue
            if len(found) > 2.5 * SENTENCE_WORDS:
                n = max(1, round(len(found) / SENTENCE_WORDS))
                out += [found[len(found) * i // n : len(found) * (i + 1) // n] for i in range(n)]
            else:
                out.append(found)
    return out


class Seeds:
    """The labelled examples: their subjects, their label vectors, which of them the others support, and terms of all subjects."""

    def __init__(self, examples: list[tuple[set[str], list[str]]]):
        self.subjects = sorted({s for _, labels in examples for s in labels})
        at = {s: i for i, s in enumerate(self.subjects)}
        self.labels = np.zeros((len(examples), len(self.subjects)))
        for i, (_, labels) in enumerate(examples):
            for s in labels:
                self.labels[i, at[s]] = 1 / len(labels)
        total: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(len(self.subjects)))
        count: Counter = Counter()
        for (ts, _), label in zip(examples, self.labels):
            for t in ts:
                total[t] += label
                count[t] += 1
        self.trusted = np.ones(len(examples), dtype=bool)
        for i, ((ts, _), label) in enumerate(zip(examples, self.labels)):
            votes = np.zeros(len(self.subjects))
            for t in ts:  # leaning without the example itself
                lean = (total[t] - label) / max(1, count[t] - 1)
                if count[t] > 2 and lean.max() > 0.6:
                    votes[lean.argmax()] += 1
            if votes.sum() >= 4:
                self.trusted[i] = label.any() and votes[label > 0].sum() >= 0.25 * votes.sum()
            elif label.any():
                self.trusted[i] = votes[label > 0].sum() > 0
        ids = WordIds(1 << 62)
        # "none" is a subject too
        flat = [t for t, n in count.items() if n >= SEEN and max(total[t].max(), n - total[t].sum()) < TELLING * n]
        self.general = np.sort(np.array([ids[t] for t in flat], dtype=np.uint64))


PARSED = "id long, n_sentences int, ends array<int>, words binary"


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The distinct words of each sentence as hashes, sentence after sentence up to ``ends``."""
    known = WordIds()
    for pdf in batches:
        out = []
        for i, text in zip(pdf["id"], pdf["text"]):
            found = sentences(text)
            flat, ends = [], []
            for ws in found:
                flat += [known[w] for w in set(ws) if len(w) > 1 and not w.isdigit()]
                ends.append(len(flat))
            out.append((i, len(found), ends, np.array(flat, dtype=np.uint64).tobytes()))
        yield pd.DataFrame(out, columns=["id", "n_sentences", "ends", "words"])


def _flat(cells) -> tuple[np.ndarray, np.ndarray]:
    """All words of a batch and the row of each."""
    sizes = np.array([len(c) // 8 for c in cells], dtype=np.int64)
    return np.frombuffer(b"".join(cells), np.uint64), np.repeat(np.arange(len(sizes)), sizes)


def _distinct(cells) -> tuple[np.ndarray, np.ndarray]:
    """The distinct words of each row, row after row, and the row of each."""
    words, row = _flat(cells)
    order = np.lexsort((words, row))
    words, row = words[order], row[order]
    fresh = np.append(True, (words[1:] != words[:-1]) | (row[1:] != row[:-1])) if len(words) else np.zeros(0, dtype=bool)
    return words[fresh], row[fresh]


def _held(words: np.ndarray, known: np.ndarray) -> np.ndarray:
    """The place of each word in the sorted ``known``, or -1."""
    if not len(known):
        return np.full(len(words), -1)
    at = np.minimum(np.searchsorted(known, words), len(known) - 1)
    return np.where(known[at] == words, at, -1)


def _sketch(shared):
    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            words, row = _distinct(pdf["words"])
            if not len(words):
                continue
            keep = _held(words, shared.value) < 0
            words, row = words[keep], row[keep]
            if not len(words):
                continue
            first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
            least = np.stack([np.minimum.reduceat(mix(words + np.uint64((h * 0x9E3779B97F4A7C15) % 2**64)), first) for h in range(SAMPLES)], axis=1)
            keys = mix(least[:, :LISTS] + np.arange(LISTS, dtype=np.uint64)).view(np.int64)
            cells = [x.tobytes() for x in (least & np.uint64(0xFFFF)).astype(np.uint16)]
            yield pd.DataFrame({"id": pdf["id"].to_numpy()[row[first]], "keys": list(keys), "sample": cells})

    return sketch


def _link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Verified edges between neighbours of each list, and from each entry to the seeds before and behind it.

    A list, or a segment of a long one, is seen as a whole whatever the batches are. Entries of other segments (``lent``) make
    edges with the segment's own alone.
    """
    held: list[pd.DataFrame] = []
    for pdf in batches:
        if not len(pdf):
            continue
        key, segment = pdf["key"].to_numpy(), pdf["segment"].to_numpy()
        # the last segment of a batch may go on in the next one
        last = np.flatnonzero((key != key[-1]) | (segment != segment[-1]))
        cut = last[-1] + 1 if len(last) else 0
        if held and (cut or held[-1]["key"].iloc[-1] != key[-1] or held[-1]["segment"].iloc[-1] != segment[-1]):
            yield from _edges_of(pd.concat([*held, pdf.iloc[:cut]], ignore_index=True))
            held = []
        elif cut:
            yield from _edges_of(pdf.iloc[:cut])
        held.append(pdf.iloc[cut:])
    if held:
        yield from _edges_of(pd.concat(held, ignore_index=True))


def _edges_of(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
    key, ids, segment, lent = (pdf[c].to_numpy() for c in ("key", "id", "segment", "lent"))
    sample = np.frombuffer(b"".join(pdf["sample"]), np.uint16).reshape(len(pdf), -1)
    at = np.arange(len(pdf))
    seeds = np.flatnonzero(ids & 1)
    plain = np.flatnonzero(~ids & 1)
    ends = [np.stack([plain[:-1], plain[1:]], 1)]
    if len(seeds):
        before = np.searchsorted(seeds, at)
        ends.append(np.stack([at[before > 0], seeds[before[before > 0] - 1]], 1))
        behind = np.searchsorted(seeds, at, side="right")
        ends.append(np.stack([at[behind < len(seeds)], seeds[behind[behind < len(seeds)]]], 1))
    a, b = np.concatenate(ends).T
    same = (key[a] == key[b]) & (segment[a] == segment[b]) & (ids[a] != ids[b]) & ~(lent[a] & lent[b])
    a, b = a[same], b[same]
    sim = (sample[a] == sample[b]).mean(1)
    a, b, sim = a[sim >= SIMILAR], b[sim >= SIMILAR], sim[sim >= SIMILAR]
    if len(a):
        out = pd.DataFrame({"a": np.minimum(ids[a], ids[b]), "b": np.maximum(ids[a], ids[b]), "w": sim * sim})
        yield out.drop_duplicates(["a", "b"])


def _lent(lists: DataFrame) -> DataFrame:
    """The entries of long lists next to each segment: the plain one and the seed before it, and the seed behind it."""
    entry, seed = F.struct("order", "id", "sample"), F.col("id") % 2 == 1
    ends = lists.filter("segments > 1").groupBy("key", "segment").agg(
        F.max(F.when(~seed, entry)).alias("plain"), F.max(F.when(seed, entry)).alias("seed"), F.min(F.when(seed, entry)).alias("first")
    )
    order = Window.partitionBy("key").orderBy("segment")
    before, behind = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
    near = F.array(F.last("plain", True).over(before), F.last("seed", True).over(before), F.first("first", True).over(behind))
    return ends.withColumn("near", near).select("key", "segment", F.explode("near").alias("e")).filter("e is not null").select("e.id", "e.sample", "key", "e.order", "segment", F.lit(True).alias("lent"))


def document_graph(parsed: DataFrame, general: np.ndarray, segment: int = SEGMENT) -> DataFrame:
    """(a, b, w), a < b: verified edges between similar nodes, every node having a few whatever the number of nodes.

    ``general`` holds the hashes (ascending) of terms that say nothing of similarity.

    A list of documents that share a sampled term is sorted by a hash, and only neighbours in it are compared. One that a third
    of all documents share is cut into segments of about ``segment`` entries for many tasks; each segment is lent the entries
    next to it, so that the edges are those of the whole list.
    """
    shared = parsed.sparkSession.sparkContext.broadcast(general)
    sketches = stage(parsed.select("id", "words").mapInPandas(_sketch(shared), "id long, keys array<long>, sample binary"), "subject-samples")
    places = F.explode(F.when(F.col("id") % 2 == 1, F.sequence(F.lit(0), F.lit(SEED_PLACES - 1))).otherwise(F.array(F.lit(0)))).alias("place")
    lists = sketches.select("id", "sample", "keys", places).select("id", "sample", F.explode("keys").alias("key"), F.xxhash64("id", "place").alias("order"))
    long = lists.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > segment)
    long = stage(long.select("key", F.ceil(F.col("n") / segment).cast("int").alias("segments")), "long-lists")
    lists = lists.join(bounded_broadcast(long, MAX_BROADCAST), "key", "left")
    # the hash's range is cut evenly
    lists = lists.withColumn("segment", F.coalesce(F.floor((F.shiftright("order", 32) + (1 << 31)) * F.col("segments") / (1 << 32)).cast("int"), F.lit(0)))
    columns = ["id", "sample", "key", "order", "segment"]
    whole = lists.select(*columns, F.lit(False).alias("lent")).unionByName(_lent(lists))
    spread = whole.repartition("key", "segment").sortWithinPartitions("key", "segment", "order", "id", "sample")
    return spread.mapInPandas(_link, "a long, b long, w double").groupBy("a", "b").agg(F.first("w").alias("w"))


def propagate(edges: DataFrame, seeds: DataFrame, k: int, rounds: int, seed_weight: float = 3.0) -> DataFrame:
    """(id, label) of the nodes that labels reach in ``rounds`` joins; the labels (k entries) of ``seeds`` stay as they are.

    ``edges``: (a, b, w). Every round, a node's label becomes the mean of its neighbours', by similarity; seeds count more.
    """
    both = edges.select(F.col("a").alias("id"), F.col("b").alias("to"), "w").unionByName(edges.select(F.col("b").alias("id"), F.col("a").alias("to"), "w"))
    both = stage(both, "subject-edges")
    nodes = seeds.select("id", "label")
    for i in range(rounds):
        trust = F.col("w") * F.when(F.col("id") % 2 == 1, seed_weight).otherwise(1.0)
        sums = both.join(nodes, "id").groupBy("to").agg(*[F.sum(F.col("label")[s] * trust).alias(f"s{s}") for s in range(k)])
        whole = sum((F.col(f"s{s}") for s in range(k)), F.lit(0.0))
        moved = sums.filter(whole > 0).select(F.col("to").alias("id"), F.array(*[F.col(f"s{s}") / whole for s in range(k)]).alias("label"))
        # seeds are the odd nodes
        nodes = stage(moved.filter("id % 2 = 0").unionByName(seeds.select("id", "label")), f"subject-nodes-{i}")
    return nodes


def _profile(k: int):
    """Per batch: for each term its documents and the sum of their labels, made clearer by a power."""

    def profile(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            words, row = _distinct(pdf["words"])
            if not len(words):
                continue
            label = np.array([np.zeros(k) if x is None else x for x in pdf["label"]]) ** CLEARER
            whole = label.sum(1, keepdims=True)
            label = np.divide(label, whole, out=label, where=whole > 0)
            term, at, n = np.unique(words, return_inverse=True, return_counts=True)
            out = pd.DataFrame({f"m{s}": np.bincount(at, weights=label[row, s], minlength=len(term)) for s in range(k)})
            out.insert(0, "docs", n)
            out.insert(0, "term", term.view(np.int64))
            yield out

    return profile


def speaking_terms(parsed: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """(term, label): the terms on whose subject the documents that hold them agree beyond chance; the last of the k entries is "none"."""
    labelled = parsed.select("id", "words").join(nodes.hint("shuffle_hash"), "id", "left").select("words", "label")
    parts = labelled.mapInPandas(_profile(k), "term long, docs long, " + ", ".join(f"m{s} double" for s in range(k)))
    sums = parts.groupBy("term").agg(F.sum("docs").alias("docs"), *[F.sum(f"m{s}").alias(f"m{s}") for s in range(k)]).filter(F.col("docs") >= MIN_DOCS)
    known = sum((F.col(f"m{s}") for s in range(k)), F.lit(0.0))
    about = sum((F.col(f"m{s}") for s in range(k - 1)), F.lit(0.0))
    base = [x or 0.0 for x in nodes.filter("id % 2 = 0").agg(*[F.avg(F.col("label")[s]) for s in range(k - 1)]).head()]
    agreed = F.lit(0.0)
    for s in range(k - 1):
        of = F.col(f"m{s}") / F.greatest(known, F.lit(1e-9))
        least = of - 2 * F.sqrt(F.greatest(of * (1 - of), F.lit(0.01)) / F.greatest(known, F.lit(1.0)))
        agreed = F.greatest(agreed, (least - base[s]) / max(1e-9, 1 - base[s]))
    shares = [F.col(f"m{s}") / about for s in range(k - 1)]
    best = F.greatest(*shares, F.lit(0.0))
    verified = sums.filter((agreed >= AGREEMENT) & (known >= 0.6 * F.col("docs")) & (best >= LEANING))
    return verified.select("term", F.array(*[F.when(x == best, x).otherwise(F.least(x, F.lit(0.5))) for x in shares]).alias("label"))


JUDGED = "id long, s int, about int, n_sentences int, terms int"


def _judge(shared, k: int, floor: float):
    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, labels = shared.value
        for pdf in batches:
            words, row = _flat(pdf["words"])
            lengths = np.array([len(e) for e in pdf["ends"]])
            if not len(words) or not len(known):
                continue
            ends = np.concatenate([np.asarray(e, dtype=np.int64) for e in pdf["ends"]])
            of = np.repeat(np.arange(len(pdf)), lengths)  # the document of each sentence
            sizes = np.array([len(c) // 8 for c in pdf["words"]])
            ends = ends + (np.cumsum(sizes) - sizes)[of]
            at = _held(words, known)
            hit = np.flatnonzero(at >= 0)
            if not len(hit):
                continue
            which = np.searchsorted(ends, hit, side="right")  # the sentence of each hit
            first = np.flatnonzero(np.append(True, which[1:] != which[:-1]))
            sums = np.add.reduceat(labels[at[hit]], first, axis=0)
            clear = sums.max(1) >= floor
            about = np.bincount(of[which[first]][clear] * k + sums.argmax(1)[clear], minlength=len(pdf) * k)
            pairs = np.unique(row[hit] * len(known) + at[hit])
            different = np.bincount(pairs // len(known) * k + labels.argmax(1)[pairs % len(known)], minlength=len(pdf) * k)
            cell = np.flatnonzero(about)
            yield pd.DataFrame({"id": pdf["id"].to_numpy()[cell // k], "s": cell % k, "about": about[cell], "n_sentences": pdf["n_sentences"].to_numpy()[cell // k], "terms": different[cell]})

    return judge


def judged_by_join(parsed: DataFrame, terms: DataFrame, k: int, floor: float) -> DataFrame:
    """What ``_judge`` gives, the terms being joined instead of broadcast."""

    def unpacked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            words, row = _flat(pdf["words"])
            sentence = [np.repeat(np.arange(len(e)), np.diff(np.append(0, e))) for e in pdf["ends"]]
            if len(words):
                yield pd.DataFrame({"row": pdf["row"].to_numpy()[row], "sentence": np.concatenate(sentence).astype(np.int32), "term": words.view(np.int64)})

    rows = stage(parsed.withColumn("row", F.monotonically_increasing_id()), "subject-rows")
    hits = rows.mapInPandas(unpacked, "row long, sentence int, term long").join(terms, "term")
    hits = stage(hits, "subject-hits")
    sums = hits.groupBy("row", "sentence").agg(*[F.sum(F.col("label")[s]).alias(f"s{s}") for s in range(k)])
    best = F.array(*[F.col(f"s{s}") for s in range(k)])
    clear = sums.select("row", (F.array_position(best, F.array_max(best)) - 1).cast("int").alias("s"), F.array_max(best).alias("m")).filter(F.col("m") >= floor)
    about = clear.groupBy("row", "s").agg(F.count("*").cast("int").alias("about"))
    own = (F.array_position("label", F.array_max("label")) - 1).cast("int")
    different = hits.groupBy("row", own.alias("s")).agg(F.countDistinct("term").cast("int").alias("terms"))
    out = about.join(different, ["row", "s"], "left").join(rows.select("row", "id", "n_sentences"), "row")
    return out.select("id", "s", "about", "n_sentences", F.coalesce("terms", F.lit(0)).alias("terms"))


def document_subjects(
    docs: DataFrame, key: str, text: str, examples: DataFrame, share: float = 0.25, rounds: int = 3, floor: float = 0.4, reach: float = 0.05,
    max_broadcast: int = MAX_BROADCAST,
) -> DataFrame:
    """(key, subject, about, n_sentences): subjects that at least ``share`` of a document's sentences are about.

    ``examples`` holds (example_id, text, subjects array). A sentence is about the subject to which its terms lean most, by
    ``floor`` at least; which terms lean where is told by the labels that ``rounds`` of propagation gave the documents. A
    subject that a single term stands for is kept only where propagation brought the document ``reach`` of its label. Null,
    empty and blank texts have no subject; repeated rows of a key are judged each; examples with null text or subjects are
    no seeds; empty tables give no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    # documents are the even nodes of the graph, seeds the odd ones
    rows = docs.select(F.shiftleft(F.col(key).cast("long"), 1).alias("id"), F.col(text).alias("text")).filter("id is not null and text is not null")
    labelled = examples.filter("text is not null and subjects is not null").select("example_id", "text", "subjects")
    n = labelled.count()
    if n > MAX_EXAMPLES:
        labelled = labelled.filter(F.pmod(F.xxhash64("example_id"), F.lit(1 << 20)) < int((1 << 20) * MAX_EXAMPLES / n)).limit(MAX_EXAMPLES)
    given = [(r["text"], [s for s in r["subjects"] if s is not None]) for r in labelled.orderBy("example_id").collect()]
    seeds = Seeds([(terms(t), s) for t, s in given])
    k = len(seeds.subjects)
    if not k:
        return spark.createDataFrame([], f"{key} long, subject string, about int, n_sentences int")
    known = [(2 * i + 1, t, [*map(float, seeds.labels[i]), float(not seeds.labels[i].any())]) for i, (t, _) in enumerate(given) if seeds.trusted[i]]
    seed_rows = spark.createDataFrame(known or [(1, "", [0.0] * (k + 1))], "id long, text string, label array<double>")
    parsed = stage(rows.unionByName(seed_rows.select("id", "text")).mapInPandas(_parse, PARSED), "subject-texts")
    edges = document_graph(parsed, seeds.general)
    nodes = propagate(edges, seed_rows, k + 1, rounds)
    speaking = stage(speaking_terms(parsed, nodes, k + 1), "subject-terms")
    texts = parsed.filter("id % 2 = 0")
    if speaking.limit(max_broadcast + 1).count() <= max_broadcast:
        found = speaking.toPandas().sort_values("term", key=lambda x: x.to_numpy().view(np.uint64))  # max_broadcast terms at most
        labels = np.stack(found["label"].to_numpy()) if len(found) else np.zeros((0, k))
        shared = spark.sparkContext.broadcast((found["term"].to_numpy(dtype=np.int64).view(np.uint64), labels))
        judged = texts.mapInPandas(_judge(shared, k, floor), JUDGED)
    else:
        judged = judged_by_join(texts, speaking, k, floor)
    kept = judged.filter(F.col("about") >= share * F.col("n_sentences"))
    kept = kept.join(nodes.filter("id % 2 = 0").select("id", "label").hint("shuffle_hash"), "id", "left")
    kept = kept.filter((F.col("terms") > 1) | (F.coalesce(F.try_element_at("label", F.col("s") + 1), F.lit(0.0)) >= reach))
    names = F.array(*map(F.lit, seeds.subjects))
    return kept.select(F.shiftright("id", 1).alias(key), F.element_at(names, F.col("s") + 1).alias("subject"), "about", "n_sentences")

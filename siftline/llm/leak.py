"""Evaluation texts leaking into training text (problem 7).

A positional inverted index of all training tokens, kept in segments: each segment lists, per term, the positions at
which it stands in the stream of the segment's documents (one dead position between two documents). It knows nothing of
the evaluation texts, so one index serves any number of them. A passage is found by taking the rarest term of each of
its windows, shifting that term's list by its offset in the passage, and keeping the shifted positions that the
neighbouring terms' shifted lists hold as well. Which passages a segment can hold is told by joining the rarest terms
with the segment's terms.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.words import WordIds, words
from siftline.runtime import stage

#: Tokens after which a segment is closed (a longer document is a segment of its own).
SEGMENT_TOKENS = 1_000_000
#: Evaluation words searched for at once; a larger set is searched for in parts.
EVAL_WORDS = 5_000_000
SEGMENT = "terms binary, ends binary, doc_counts binary, postings binary, docs binary, starts binary"


def _index(segment_tokens: int, compose: bool):
    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = WordIds()
        stream: list[np.ndarray] = []
        docs: list[int] = []
        starts: list[int] = []
        held = 0

        def close() -> pd.DataFrame:
            every = np.concatenate(stream)
            terms, of = np.unique(every, return_inverse=True)
            by = np.argsort(of.astype(np.int32), kind="stable").astype(np.int32)
            ends = np.cumsum(np.bincount(of, minlength=len(terms)))
            if len(terms) and terms[0] == 0:  # dead positions
                by, terms, ends = by[ends[0] :], terms[1:], ends[1:] - ends[0]
            first = np.append(0, ends[:-1])
            doc_of = np.searchsorted(np.array(starts), by, side="right")
            fresh = np.ones(len(by), dtype=np.int64)
            fresh[1:] = doc_of[1:] != doc_of[:-1]
            fresh[first] = 1
            counts = np.add.reduceat(fresh, first)
            row = {
                "terms": terms.tobytes(), "ends": ends.astype(np.int32).tobytes(), "doc_counts": counts.astype(np.int32).tobytes(),
                "postings": by.tobytes(), "docs": np.array(docs, dtype=np.int64).tobytes(), "starts": np.array(starts, dtype=np.int64).tobytes(),
            }
            return pd.DataFrame([row])

        for pdf in batches:
            for doc, text in zip(pdf["_key"], pdf["_text"]):
                found = passage_words(text, compose)
                if not found:
                    continue
                docs.append(doc)
                starts.append(held)
                stream.append(np.array([*map(known.__getitem__, found), 0], dtype=np.uint64))
                held += len(found) + 1
                if held >= segment_tokens:
                    yield close()
                    stream, docs, starts, held = [], [], [], 0
        if docs:
            yield close()

    return build


def passage_words(text: str, compose: bool = False) -> list[str]:
    """Words of a text; with ``compose``, letters and their accents are put together first."""
    return words(text if not compose or text.isascii() else unicodedata.normalize("NFC", text))


def positional_index(docs: DataFrame, key: str, text: str, segment_tokens: int = SEGMENT_TOKENS, compose: bool = False) -> DataFrame:
    """Segments of the positional index of ``docs`` over all their words.

    ``terms`` holds ascending hashes (uint64); ``postings``, term after term up to ``ends``, ascending stream positions
    (int32); ``docs`` and ``starts`` (int64) place the documents in the stream; ``doc_counts`` (int32) is the number of
    documents of each term.
    """
    rows = docs.select(F.col(key).cast("long").alias("_key"), F.col(text).alias("_text")).filter("_key is not null and _text <> ''")
    return rows.mapInPandas(_index(segment_tokens, compose), SEGMENT)


def _frequencies(shared):
    def frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wanted, total = shared.value, None
        for pdf in batches:
            for t, c in zip(pdf["terms"], pdf["doc_counts"]):
                terms, counts = np.frombuffer(t, np.uint64), np.frombuffer(c, np.int32)
                at = np.searchsorted(terms, wanted)
                here = np.where(terms[np.minimum(at, len(terms) - 1)] == wanted, counts[np.minimum(at, len(terms) - 1)], 0)
                total = here.astype(np.int64) if total is None else total + here
        if total is not None:
            held = np.flatnonzero(total)
            yield pd.DataFrame({"i": held, "n": total[held]})

    return frequencies


def document_frequencies(index: DataFrame, wanted: np.ndarray) -> np.ndarray:
    """Documents of the whole collection that hold each of the ``wanted`` term hashes (ascending)."""
    shared = index.sparkSession.sparkContext.broadcast(wanted)
    out = np.zeros(len(wanted), dtype=np.int64)
    counts = index.select("terms", "doc_counts").mapInPandas(_frequencies(shared), "i long, n long")
    for i, n in counts.groupBy("i").agg(F.sum("n")).collect():  # at most one row per wanted term
        out[i] = n
    return out


def window_anchors(terms: np.ndarray, df: np.ndarray, run: int) -> list[int]:
    """Offsets of the rarest term of each window of ``run`` terms; windows with a term that no document has are left out."""
    out = []
    for s in range(len(terms) - run + 1):
        here = df[terms[s : s + run]]
        if here.min() > 0:
            best = np.flatnonzero(here == here.min()) + s
            out.append(next((int(o) for o in best if int(o) in out[-1:]), int(best[-1])))
    return sorted(set(out))


class _Segment:
    """A segment seen by the evaluation words, whose numbers are the places of their hashes in ``wanted``."""

    def __init__(self, row, wanted: np.ndarray):
        terms, ends = np.frombuffer(row.terms, np.uint64), np.frombuffer(row.ends, np.int32)
        at = np.minimum(np.searchsorted(terms, wanted), len(terms) - 1)
        self.there = terms[at] == wanted
        self.last = np.where(self.there, ends[at], 0)
        self.first = np.where(self.there & (at > 0), ends[at - 1], 0)
        self.postings = np.frombuffer(row.postings, np.int32)
        self.docs = np.frombuffer(row.docs, np.int64)
        self.starts = np.frombuffer(row.starts, np.int64)

    def list(self, term: int) -> np.ndarray:
        return self.postings[self.first[term] : self.last[term]]

    def has(self, term: int, positions: np.ndarray) -> np.ndarray:
        mine = self.list(term)
        if not len(mine):
            return np.zeros(len(positions), dtype=bool)
        i = np.searchsorted(mine, positions)
        return mine[np.minimum(i, len(mine) - 1)] == positions

    def doc(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, positions, side="right") - 1


def phrase_hits(seg: _Segment, terms: np.ndarray, anchors: list[int], df: np.ndarray, run: int) -> list[tuple[int, int, int, int]]:
    """(document, first word, words, offset in the passage) of the stretches of at least ``run`` passage words through an anchor."""
    out = {}
    for o in anchors:
        start = seg.list(terms[o]) - o
        for side in sorted((j for j in (o - 1, o + 1) if 0 <= j < len(terms)), key=lambda j: df[terms[j]])[:1]:
            # of a stretch of two or more words through the anchor one neighbour must match; which is only known later
            other = 2 * o - side
            near = seg.has(terms[side], start + side)
            if 0 <= other < len(terms):
                near |= seg.has(terms[other], start + other)
            start = start[near]
        if not len(start):
            continue
        lo = np.full(len(start), o)
        hi = np.full(len(start), o)
        for step, edge, last in ((-1, lo, -1), (1, hi, len(terms))):
            live = np.arange(len(start))
            j = o + step
            while j != last and len(live):
                live = live[seg.has(terms[j], start[live] + j)]
                edge[live] = j
                j += step
        keep = hi - lo + 1 >= run
        for s, a, z in zip(start[keep].tolist(), lo[keep].tolist(), hi[keep].tolist()):
            d = int(seg.doc(np.array([s + a]))[0])
            out[d, s, a] = (int(seg.docs[d]), int(s + a - seg.starts[d]), z - a + 1, a)
    return list(out.values())


def proximity_hits(seg: _Segment, terms: np.ndarray, df: np.ndarray, share: float, slack: float) -> list[tuple[int, int, int, int]]:
    """(document, first word, distinct terms, 0): windows of at most ``slack`` times the passage that hold ``share`` of its distinct terms.

    Such a window lacks fewer terms than there are anchors, so it holds one of the rarest; only their places are looked at.
    """
    distinct = np.unique(terms)
    need = int(np.ceil(share * len(distinct)))
    width = int(slack * len(terms))
    rare = distinct[np.argsort(df[distinct], kind="stable")][: len(distinct) - need + 1]
    places = np.unique(np.concatenate([seg.list(t) for t in rare]))
    if not len(places):
        return []
    # windows can be taken to begin at a passage term; the anchor is at most a width behind their start
    begin = np.unique(np.concatenate([places, *[p[_near(p, places, width)] for p in map(seg.list, distinct)]]))
    doc = seg.doc(begin)
    end = np.minimum(begin + width, np.append(seg.starts[1:], np.iinfo(np.int32).max)[doc])
    held = np.zeros(len(begin), dtype=np.int32)
    for t in distinct:
        mine = seg.list(t)
        held += np.searchsorted(mine, end) > np.searchsorted(mine, begin)
    out = {}
    for i in np.flatnonzero(held >= need).tolist():
        d = int(doc[i])
        if d not in out or held[i] > out[d][2]:
            out[d] = (int(seg.docs[d]), int(begin[i] - seg.starts[d]), int(held[i]), 0)
    return list(out.values())


def _near(mine: np.ndarray, places: np.ndarray, width: int) -> np.ndarray:
    """Which of ``mine`` have one of ``places`` at most ``width`` behind them."""
    return np.searchsorted(places, mine + width) > np.searchsorted(places, mine)


def _search(shared, run: int, kinds: tuple[str, ...], share: float, slack: float):
    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wanted, passages, df = shared.value
        # the rarest terms, each with its passage: joined with the terms of each segment
        anchor = np.array([terms[o] for _, terms, anchors in passages for o in anchors], dtype=np.int64)
        of = np.repeat(np.arange(len(passages)), [len(anchors) for _, _, anchors in passages])
        every = np.concatenate([terms for _, terms, _ in passages])
        whose = np.repeat(np.arange(len(passages)), [len(terms) for _, terms, _ in passages])
        lengths = np.bincount(whose, minlength=len(passages))
        distinct = np.unique(whose * len(wanted) + every)
        need = np.ceil(share * np.bincount(distinct // len(wanted), minlength=len(passages)))
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                seg, out = _Segment(row, wanted), []
                if "phrase" in kinds:
                    for i in np.unique(of[seg.there[anchor]]):
                        item, terms, anchors = passages[i]
                        out += [(d, item, "phrase", p, n, o) for d, p, n, o in phrase_hits(seg, terms, anchors, df, run)]
                if "proximity" in kinds:
                    held = np.bincount(distinct[seg.there[distinct % len(wanted)]] // len(wanted), minlength=len(passages))
                    for i in np.flatnonzero((held >= need) & (lengths >= run)):
                        item, terms, _ = passages[i]
                        out += [(d, item, "proximity", p, n, o) for d, p, n, o in proximity_hits(seg, terms, df, share, slack)]
                if out:
                    yield pd.DataFrame(out, columns=["_key", "_item", "kind", "first_word", "n_words", "passage_word"])

    return search


def find_passages(
    index: DataFrame, key: str, items: DataFrame, item_key: str, passage: str, run: int = 12, kinds: tuple[str, ...] = ("phrase",),
    share: float = 0.8, slack: float = 1.5, compose: bool = False, eval_words: int = EVAL_WORDS,
) -> DataFrame:
    """What ``leaked_passages`` gives, from the index of the documents; passages of more than ``eval_words`` words are searched for in parts.

    ``compose`` must be what the index was made with.
    """
    spark = index.sparkSession
    kind = items.schema[item_key].dataType.simpleString()
    schema = f"_key long, _item {kind}, kind string, first_word int, n_words int, passage_word int"
    hits = spark.createDataFrame([], schema)
    rows = items.select(item_key, passage).filter(f"`{item_key}` is not null and `{passage}` <> ''")
    part, held = [], 0

    def searched(part: list) -> DataFrame:
        ids = WordIds(1 << 62)
        hashed = [(item, np.array([*map(ids.__getitem__, ws)], dtype=np.uint64)) for item, ws in part]
        wanted = np.unique(np.concatenate([h for _, h in hashed]))
        df = document_frequencies(index, wanted)
        passages = [(item, at := np.searchsorted(wanted, h), window_anchors(at, df, run)) for item, h in hashed]
        shared = spark.sparkContext.broadcast((wanted, passages, df))
        return index.mapInPandas(_search(shared, run, tuple(kinds), share, slack), schema)

    for r in rows.toLocalIterator():
        ws = passage_words(r[1], compose)
        if len(ws) >= run:
            if part and held + len(ws) > eval_words:
                hits = hits.unionByName(searched(part))
                part, held = [], 0
            part.append((r[0], ws))
            held += len(ws)
    if part:
        hits = hits.unionByName(searched(part))
    return hits.withColumnRenamed("_key", key).withColumnRenamed("_item", item_key)


def leaked_passages(
    docs: DataFrame, key: str, text: str, items: DataFrame, item_key: str, passage: str, run: int = 12,
    kinds: tuple[str, ...] = ("phrase",), share: float = 0.8, slack: float = 1.5, compose: bool = False,
) -> DataFrame:
    """(key, item_key, kind, first_word, n_words, passage_word): where documents hold passages.

    ``phrase``: a stretch of at least ``run`` consecutive passage words, at full length; ``proximity``: a window of at most
    ``slack`` times the passage's length with ``share`` of its distinct words in any order (the best window of a document).
    Words are counted from 0. Null or empty texts and passages, those with fewer than ``run`` words, and null keys match
    nothing; repeated rows match each; empty tables give no rows; other columns are ignored. With ``compose``, composed and
    decomposed accents are the same. Neither documents nor passages are bounded in number.
    """
    index = stage(positional_index(docs, key, text, compose=compose), "token-index")
    return find_passages(index, key, items, item_key, passage, run, kinds, share, slack, compose)

"""Most similar vectors for every vector (problem 4): inverted lists of coarse centroids, product-quantised residuals, exact rerank.

Vectors are compared by cosine. Vectors of (almost) the same direction are one class; classes are indexed and searched,
and the classes' members are put back at the end, so that any number of copies costs one entry. Every class is indexed
and every class is a query. The lists are searched by asymmetric distance tables, in blocks of bounded size, and the best
candidates of each list are compared again with their full vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftline.runtime import stage

#: Vectors the quantisers are fitted on, at most (every vector is indexed).
TRAIN_ROWS = 65_536
#: Vectors aimed at per list; lists above BLOCK entries are searched in blocks.
LIST_ROWS, BLOCK = 256, 8192
#: Lists with a centroid of their own, at most; beyond, a list is a coarse centroid and one of up to MAX_FINE residuals, so that
#: lists keep their size up to about a thousand million vectors.
MAX_COARSE, MAX_FINE = 4096, 1024
#: Lists that are ranked when the probes needed are counted.
RANKED = 4096
#: Sub-spaces and codes of the product quantiser.
PARTS, CODES = 8, 256
#: Lists of a cell: a query is sent once to each cell that has lists it probes.
CELL_LISTS = 8
#: Vectors whose true neighbours are found by brute force, and the share of these that the probed lists must hold.
ASKED, HELD = 512, 0.97


@dataclass
class Quantiser:
    coarse: np.ndarray  # coarse centroids x dim
    fine: np.ndarray  # residuals x dim; one row of zeros if there is one level
    books: np.ndarray  # parts x codes x dim / parts
    cells: np.ndarray  # the cell of each coarse centroid, or its first

    @property
    def lists(self) -> int:
        return len(self.coarse) * len(self.fine)

    def centroids(self, lists: np.ndarray) -> np.ndarray:
        return self.coarse[lists // len(self.fine)] + self.fine[lists % len(self.fine)]

    def cell(self, lists: np.ndarray) -> np.ndarray:
        """Lists that lie close together; of two levels, CELL_LISTS of one coarse centroid."""
        more = -(-len(self.fine) // CELL_LISTS)
        return (self.cells[lists // len(self.fine)] * more + lists % len(self.fine) // CELL_LISTS).astype(np.int32)

    def nearest(self, v: np.ndarray, k: int) -> np.ndarray:
        """The k closest lists of each row, best first."""
        k = min(k, self.lists)
        if len(self.fine) == 1:
            return np.stack(nearest(v, self.coarse, k), 1)
        out, wide = [], len(self.fine)
        first = min(len(self.coarse), max(8, -(-4 * k // wide)))
        cross, half = self.coarse @ self.fine.T, (self.fine * self.fine).sum(1) / 2
        norm = (self.coarse * self.coarse).sum(1) / 2
        for s in range(0, len(v), step := max(16, 4_000_000 // (first * wide))):
            x = v[s : s + step]
            near = np.stack(nearest(x, self.coarse, first), 1)
            score = np.take_along_axis(x @ self.coarse.T - norm, near, 1)[:, :, None] + (x @ self.fine.T - half)[:, None, :] - cross[near]
            score = score.reshape(len(x), -1)
            top = np.argpartition(-score, k - 1, axis=1)[:, :k]
            top = np.take_along_axis(top, np.argsort(-np.take_along_axis(score, top, 1), axis=1, kind="stable"), 1)
            out.append(np.take_along_axis(near, top // wide, 1) * wide + top % wide)
        return np.concatenate(out) if out else np.empty((0, k), dtype=int)

    def encode(self, v: np.ndarray, lists: np.ndarray) -> np.ndarray:
        rest = (v - self.centroids(lists)).reshape(len(v), len(self.books), -1)
        out = np.empty(rest.shape[:2], dtype=np.uint8)
        for m, book in enumerate(self.books):
            out[:, m] = nearest(rest[:, m], book)[0]
        return out

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Inner products of the queries' parts with all codes: queries x parts x codes."""
        parts = q.reshape(len(q), len(self.books), -1)
        return np.einsum("qmd,mcd->qmc", parts, self.books, optimize=True)


def nearest(v: np.ndarray, centers: np.ndarray, k: int = 1) -> list[np.ndarray]:
    """The k closest centers of each row, best first, as k columns."""
    out = []
    half = (centers * centers).sum(1) / 2
    for s in range(0, len(v), 4096):
        score = v[s : s + 4096] @ centers.T - half
        if k == 1:
            out.append(score.argmax(1)[:, None])
        else:
            top = np.argpartition(-score, k - 1, axis=1)[:, :k]
            out.append(np.take_along_axis(top, np.argsort(-np.take_along_axis(score, top, 1), axis=1, kind="stable"), 1))
    return list(np.concatenate(out).T) if out else [np.empty(0, dtype=int)] * k


def kmeans(v: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    k = min(k, len(v))
    centers = v[rng.choice(len(v), k, replace=False)].copy()
    for _ in range(rounds):
        at = nearest(v, centers)[0]
        order = np.argsort(at, kind="stable")
        which, first = np.unique(at[order], return_index=True)
        centers[which] = np.add.reduceat(v[order], first, axis=0) / np.diff(np.append(first, len(v)))[:, None]
        lost = np.setdiff1d(np.arange(k), which)
        centers[lost] = v[rng.choice(len(v), len(lost))]
    return centers


def fit(sample: np.ndarray, lists: int, parts: int = PARTS, rounds: int = 8, seed: int = 7, max_coarse: int = MAX_COARSE) -> Quantiser:
    coarse = kmeans(sample, min(lists, max_coarse), rounds, seed).astype(np.float32)
    rest = sample - coarse[nearest(sample, coarse)[0]]
    wide = min(MAX_FINE, -(-lists // len(coarse)))
    fine = kmeans(rest, wide, rounds, seed + 99).astype(np.float32) if wide > 1 else np.zeros((1, sample.shape[1]), dtype=np.float32)
    rest = (rest - fine[nearest(rest, fine)[0]])[:32_768].reshape(min(len(sample), 32_768), parts, -1)
    books = np.zeros((parts, CODES, rest.shape[2]), dtype=np.float32)
    for m in range(parts):
        found = kmeans(np.ascontiguousarray(rest[:, m]), CODES, rounds, seed + m)
        books[m, : len(found)] = found
        books[m, len(found) :] = found[:1]
    cells = nearest(coarse, kmeans(coarse, -(-len(coarse) // CELL_LISTS), rounds, seed))[0] if wide == 1 else np.arange(len(coarse))
    return Quantiser(coarse, fine, books, cells.astype(np.int64))


def _usable(dim: int):
    def usable(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = pdf[[x is not None and len(x) == dim for x in pdf["vector"]]]
            if not len(pdf):
                continue
            v = np.stack(pdf["vector"].to_numpy()).astype(np.float64)
            norm = np.sqrt((v * v).sum(1))
            ok = np.isfinite(norm) & (norm > 0)
            v, ids = v[ok] / norm[ok, None], pdf["id"].to_numpy()[ok]
            unit = v.astype(np.float32)
            keys = np.round(v, 6).astype(np.float32) + np.float32(0)
            yield pd.DataFrame({"id": ids, "unit": [x.tobytes() for x in unit], "key": [hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in keys]})

    return usable


def usable_vectors(vectors: DataFrame, dim: int) -> DataFrame:
    """(id, unit, key): per path the row with the largest mtime (then id), if it has ``dim`` finite values that are not all zero."""
    last = vectors.filter("path is not null and vec_id is not null").groupBy("path").agg(F.max_by(F.struct(F.col("vec_id").cast("long").alias("id"), "vector"), F.struct("mtime", "vec_id")).alias("r"))
    return last.select("r.id", "r.vector").mapInPandas(_usable(dim), "id long, unit binary, key binary")


def _matrix(col: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(col), np.float32).reshape(len(col), -1)


def _assign(shared, probes: int, code: bool):
    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for pdf in batches:
            if not len(pdf):
                continue
            v = _matrix(pdf["unit"])
            if code:
                lists = model.nearest(v, 1)[:, 0]
                codes = [x.tobytes() for x in model.encode(v, lists)]
                yield pd.DataFrame({"rid": pdf["rid"], "cell": model.cell(lists), "list": lists.astype(np.int32), "code": codes, "unit": pdf["unit"]})
            else:
                lists = model.nearest(v, probes).astype(np.int64)
                yield pd.DataFrame({"rid": pdf["rid"], "lists": list(model.cell(lists).astype(np.int64) << 32 | lists), "unit": pdf["unit"]})

    return assign


def _best_of(model: Quantiser, one: int, q: np.ndarray, qid: np.ndarray, v: np.ndarray, ids: np.ndarray, codes: np.ndarray, k: int, rerank: int, least: float):
    """Similarities and ids of the k best entries of one list for each query, best first; -2 where there is none."""
    if len(v) > rerank:
        tables = model.tables(q)
        guess = np.repeat((q @ model.centroids(np.array([one])).T), len(v), axis=1)
        for m in range(codes.shape[1]):
            guess += np.take(tables[:, m], codes[:, m], axis=1)
        top = np.argpartition(-guess, rerank - 1, axis=1)[:, :rerank]
        exact = np.einsum("qrd,qd->qr", v[top], q, optimize=True)
    else:
        top = np.broadcast_to(np.arange(len(v)), (len(q), len(v)))
        exact = q @ v.T
    exact = np.where((ids[top] == qid[:, None]) | (exact < least), -2.0, exact)
    order = np.lexsort((ids[top], -exact), axis=1)[:, :k]
    return np.take_along_axis(exact, order, 1), ids[np.take_along_axis(top, order, 1)]


def _true_lists(shared, k: int, least: float):
    def true(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, q = shared.value
        sims, lists = np.full((len(q), k), -2.0), np.zeros((len(q), k), dtype=np.int32)
        for pdf in batches:
            for s in range(0, len(pdf), 4096):
                part = pdf.iloc[s : s + 4096]
                now = q @ _matrix(part["unit"]).T
                now = np.where((part["rid"].to_numpy() == ids[:, None]) | (now < least), -2.0, now)
                now, of = np.hstack([sims, now]), np.hstack([lists, np.broadcast_to(part["list"].to_numpy(), now.shape)])
                top = np.argpartition(-now, k - 1, axis=1)[:, :k]
                sims, lists = np.take_along_axis(now, top, 1), np.take_along_axis(of, top, 1)
        row, col = np.nonzero(sims > -2.0)
        yield pd.DataFrame({"q": row.astype(np.int32), "sim": sims[row, col], "list": lists[row, col]})

    return true


def enough_probes(index: DataFrame, model: Quantiser, ids: np.ndarray, q: np.ndarray, k: int, least: float, probes: int) -> int:
    """How many lists must be probed (``probes`` at least) to hold the share HELD of the true neighbours of the queries, found by brute force over all vectors."""
    if model.lists <= probes:
        return probes
    shared = index.sparkSession.sparkContext.broadcast((ids, q))
    found = index.select("rid", "list", "unit").mapInPandas(_true_lists(shared, k, least), "q int, sim double, list int")
    cell = F.struct((-F.col("sim")).alias("d"), "list")
    best = found.groupBy("q").agg(F.slice(F.array_sort(F.collect_list(cell)), 1, k).alias("b")).select("q", "b.list").collect()  # ASKED rows of k
    if not best:
        return probes
    ranked = model.nearest(q, RANKED)
    needed = []
    for r in best:
        row = ranked[r["q"]]
        order = np.argsort(row)
        at = np.minimum(np.searchsorted(row, r["list"], sorter=order), len(row) - 1)
        needed.append(np.where(row[order[at]] == r["list"], order[at] + 1, len(row)))
    needed = np.sort(np.concatenate(needed))
    return max(probes, int(needed[int(np.ceil(HELD * len(needed))) - 1]))


def _scan(shared, k: int, rerank: int, least: float):
    def scan(key, queries: pd.DataFrame, entries: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"rid": pd.Series(dtype="int64"), "near": pd.Series(dtype=object), "sims": pd.Series(dtype=object)})
        if not len(queries) or not len(entries):
            return none
        model, ids, of_list = shared.value, entries["rid"].to_numpy(), entries["list"].to_numpy()
        v, every, qids = _matrix(entries["unit"]), _matrix(queries["unit"]), queries["rid"].to_numpy()
        codes = np.frombuffer(b"".join(entries["code"]), np.uint8).reshape(len(v), -1)
        asked = np.repeat(np.arange(len(queries)), [len(x) for x in queries["lists"]])
        probed = np.concatenate(queries["lists"].to_list()) & 0xFFFFFFFF
        rows, near, sims = [], [], []
        for one in np.unique(of_list):
            mine, who = np.flatnonzero(of_list == one), asked[probed == one]
            for s in range(0, len(who), step := max(16, 2_000_000 // len(mine))):
                row = who[s : s + step]
                best, found = _best_of(model, one, every[row], qids[row], v[mine], ids[mine], codes[mine], k, rerank, least)
                held = best > -2.0
                rows.append(np.repeat(row, held.sum(1)))
                near.append(found[held])
                sims.append(best[held])
        if not rows or not sum(map(len, rows)):
            return none
        row, other, sim = np.concatenate(rows), np.concatenate(near), np.concatenate(sims).astype(np.float64)
        order = np.lexsort((other, -sim, row))
        row, other, sim = row[order], other[order], sim[order]
        which, first, n = np.unique(row, return_index=True, return_counts=True)
        ends = first + np.minimum(n, k)
        return pd.DataFrame({"rid": qids[which], "near": [other[a:z] for a, z in zip(first, ends)], "sims": [sim[a:z] for a, z in zip(first, ends)]})

    return scan


def nearest_classes(classes: DataFrame, k: int, probes: int, rerank: int, least: float, train_rows: int = TRAIN_ROWS, list_rows: int = LIST_ROWS, max_coarse: int = MAX_COARSE) -> DataFrame:
    """(rid, other, sim): the k most similar other classes of each of (rid, unit), found through the index."""
    spark = classes.sparkSession
    n = classes.count()
    part = classes if n <= train_rows else classes.filter(F.pmod(F.xxhash64("rid"), F.lit(1 << 20)) < int((1 << 20) * train_rows / n))
    sample = part.orderBy(F.xxhash64("rid")).limit(train_rows).select("rid", "unit").toPandas()  # at most train_rows vectors
    if not len(sample):
        return spark.createDataFrame([], "rid long, other long, sim double")
    learned = fit(_matrix(sample["unit"]), max(1, n // list_rows), max_coarse=max_coarse)
    model = spark.sparkContext.broadcast(learned)
    index = stage(classes.mapInPandas(_assign(model, probes, True), "rid long, cell int, list int, code binary, unit binary"), "vector-index")
    some = sample.iloc[:ASKED]
    probes = enough_probes(index, learned, some["rid"].to_numpy(), _matrix(some["unit"]), k, least, probes)
    asked = stage(classes.mapInPandas(_assign(model, probes, False), "rid long, lists array<long>, unit binary"), "vector-queries")
    of = lambda x: F.shiftright(x, 32).cast("int")
    sent = asked.select("rid", "unit", "lists", F.explode(F.array_distinct(F.transform("lists", of))).alias("cell"))
    # a row per cell, of about CELL_LISTS x list_rows vectors
    entries = dict(index.groupBy("cell").count().collect())
    queries = dict(sent.groupBy("cell").count().collect())
    plan = spark.createDataFrame(
        [(int(c), -(-n // BLOCK), -(-queries.get(c, 0) // BLOCK)) for c, n in entries.items() if queries.get(c)] or [(-1, 1, 1)],
        "cell int, eblocks int, qblocks int",
    )
    plan = F.broadcast(plan)
    own = lambda blocks: F.pmod(F.xxhash64("rid"), F.col(blocks)).cast("int")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))
    sent = sent.withColumn("lists", F.filter("lists", lambda x: of(x) == F.col("cell")))
    left = sent.join(plan, "cell").select("cell", own("qblocks").alias("qb"), every("eblocks").alias("eb"), "rid", "unit", "lists")
    right = index.join(plan, "cell").select("cell", every("qblocks").alias("qb"), own("eblocks").alias("eb"), "rid", "list", "code", "unit")
    key = ["cell", "qb", "eb"]
    found = left.groupBy(key).cogroup(right.groupBy(key)).applyInPandas(_scan(model, k, rerank, least), "rid long, near array<long>, sims array<double>")
    cells = F.transform(F.arrays_zip("near", "sims"), lambda x: F.struct((-x["sims"]).alias("d"), x["near"].alias("other")))
    best = found.groupBy("rid").agg(F.slice(F.array_sort(F.flatten(F.collect_list(cells))), 1, k).alias("b"))  # at most k a block
    return best.select("rid", F.explode("b").alias("b")).select("rid", "b.other", (-F.col("b.d")).alias("sim"))


def similar_vectors(
    vectors: DataFrame, k: int = 10, least: float = -1.0, dim: int = 64, probes: int = 8, rerank: int = 64, train_rows: int = TRAIN_ROWS, list_rows: int = LIST_ROWS,
    max_coarse: int = MAX_COARSE,
) -> DataFrame:
    """(vec_id, other_id, sim, rank): the ``k`` most similar usable vectors of each usable vector, those below ``least`` left out.

    Usable is what ``usable_vectors`` says: null, short, long, zero and non-finite vectors, superseded rows, null paths and
    null ids are in no result. Ties go to the smaller id; copies are neighbours like others, at similarity 1. The search
    is approximate in which lists are probed (``probes`` at least, and as many as ``enough_probes`` finds are needed) and which candidates are reranked, never in the similarities. Empty tables
    give no rows; other columns are ignored.
    """
    rows = stage(usable_vectors(vectors, dim), "vectors")
    classes = rows.groupBy("key").agg(F.min(F.struct("id", "unit")).alias("r"), F.count("*").alias("members"))
    classes = stage(classes.select("key", F.col("r.id").alias("rid"), F.col("r.unit").alias("unit"), "members"), "vector-classes")
    links = nearest_classes(classes.select("rid", "unit"), k, probes, rerank, least, train_rows, list_rows, max_coarse)
    own = classes.filter("members > 1").select("rid", F.col("rid").alias("other"), F.lit(1.0).alias("sim"))
    # of a class, the k + 1 smallest ids are all that a neighbour or a member can need
    members = rows.select("id", "key").join(classes.select("key", "rid", F.col("members") > 1), "key").select("id", "rid")
    order = Window.partitionBy("rid").orderBy("id")
    firsts = members.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k + 1).groupBy("rid").agg(F.collect_list("id").alias("ids"))
    spread = links.unionByName(own).join(firsts.withColumnRenamed("rid", "other"), "other").select("rid", F.explode("ids").alias("other_id"), "sim")
    cell = F.struct((-F.col("sim")).alias("d"), F.col("other_id"))
    lists = spread.groupBy("rid").agg(F.slice(F.array_sort(F.collect_list(cell)), 1, k + 1).alias("b"))  # at most (k + 1)^2 a class
    per = members.join(lists, "rid").select("id", F.filter("b", lambda x: x["other_id"] != F.col("id")).alias("b"))
    return per.select(F.col("id").alias("vec_id"), F.posexplode(F.slice("b", 1, k)).alias("rank", "x")).select(
        "vec_id", F.col("x.other_id").alias("other_id"), (-F.col("x.d")).alias("sim"), (F.col("rank") + 1).alias("rank")
    )

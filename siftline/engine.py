"""The engine: build, search, keep in step, embed, recognise, track, report."""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.functions import constants as K
from siftline.functions.parse import parse_query
from siftline.functions.paths import preset_roots
from siftline.functions.values import file_type, rfc3339
from siftline.operators import jobs, pending, recents, sync, tables, vectors
from siftline.operators.fulltext import TextIndex, doc_lengths, extractable, field_stats, full_postings, index_text
from siftline.operators.search import Options, scoped_search, with_snippets
from siftline.runtime import staging
from siftline.sources.scan import scan_tree
from siftline.sources.store import Store, log_error, recent_errors

FILES = "path string, filename string, extension string, size_bytes long, modified_ts long, is_dir boolean, created_ts long"
DOCS = "path string, filename string, extension string, content string"
VECTORS = "path string, vec_id long, vector array<float>, mtime long, embed_hash string"
INTERACTIONS = "path string, action string, timestamp long"
OCR_STATUS = "path string, modified_ts long, ocr_done int, confidence double"
#: Results that come to the driver, at most.
MAX_RESULTS = 1000


class Engine:
    """Tables of one index in a store; every call takes the time it is to be seen from (``now``), by default the clock's.

    The tables: files, docs (texts), postings and field_stats (the text index), vectors, ocr_status, interactions, and the
    hashed vectors of the ANN index. What changes files changes all that hangs on them, in one generation.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.store = spark, Store(root)
        self.query_vectors: dict[str, list[float]] = {}

    def _table(self, name: str, schema: str) -> DataFrame:
        return self.store.read(self.spark, name) if self.store.has(name) else self.spark.createDataFrame([], schema)

    def files(self) -> DataFrame:
        return self._table("files", FILES)

    def docs(self) -> DataFrame:
        return self._table("docs", DOCS)

    def vectors(self) -> DataFrame:
        return self._table("vectors", VECTORS)

    def ocr_status(self) -> DataFrame:
        return self._table("ocr_status", OCR_STATUS)

    def interactions(self) -> DataFrame:
        return self._table("interactions", INTERACTIONS)

    def text_index(self) -> TextIndex:
        return TextIndex(self.store.read(self.spark, "postings"), self.store.read(self.spark, "field_stats"))

    # making and changing the index

    def build(
        self, files: DataFrame | None = None, docs: DataFrame | None = None, vectors: DataFrame | None = None, roots: list[str] = (), preset: str | None = None,
        home: str = "~", now: int | None = None,
    ) -> int:
        """A new generation from tables or a tree; usage, OCR state and vectors that are not given are carried over.

        Without ``files``, the roots are those given, else those of the preset (given, else stored, else the personal one).
        """
        preset = preset or self.store.meta("scan_preset")
        roots = list(roots) or self.store.meta("scan_paths") or []
        with self.store.lock():
            if files is None:
                files = scan_tree(self.spark, roots or preset_roots(preset or "personal", [], home), preset)
            out = {"files": files} | self._texts(docs if docs is not None else self.spark.createDataFrame([], DOCS)) | ({"vectors": vectors} if vectors is not None else {})
            return self._publish(out, {"last_index_time": now or int(time.time()), "scan_paths": roots, "scan_preset": preset})

    def _texts(self, docs: DataFrame) -> dict[str, DataFrame]:
        docs = extractable(docs).select("path", "filename", "extension", index_text(F.col("content")).alias("content"))
        return {"docs": docs, "postings": full_postings(docs), "field_stats": field_stats(doc_lengths(docs))}

    def _publish(self, out: dict[str, DataFrame], meta: dict | None = None) -> int:
        return self.store.publish(out, meta, by={"postings": ("bucket", "term")})

    def _changed(self, files: DataFrame, gone: DataFrame, stale: DataFrame, docs: DataFrame | None = None) -> dict[str, DataFrame]:
        """All tables after files in ``gone`` went and those in ``stale`` changed; texts of ``docs`` take the place of their old ones.

        Vectors of changed files are no longer true; their OCR state stays, and tells by its time that it is old.
        """
        out = {"files": files}
        keep = lambda df, keys: tables.delete(df, keys)
        if self.store.has("docs"):
            before = keep(self.docs(), gone)
            if docs is not None:
                fresh = extractable(docs).select("path", "filename", "extension", index_text(F.col("content")).alias("content"))
                old = keep(before, fresh)
                changed = full_postings(fresh)
                posts = keep(keep(self.store.read(self.spark, "postings"), gone), fresh)
                out |= {"docs": old.unionByName(fresh), "postings": posts.unionByName(changed.select(posts.columns))}
            else:
                out |= {"docs": before, "postings": keep(self.store.read(self.spark, "postings"), gone)}
            out["field_stats"] = field_stats(doc_lengths(out["docs"]))
        if self.store.has("vectors"):
            out["vectors"] = keep(keep(self.vectors(), gone), stale)
        if self.store.has("ocr_status"):
            out["ocr_status"] = keep(self.ocr_status(), gone)
        return out

    def add_path(self, files: DataFrame, docs: DataFrame | None = None) -> int:
        """Files added to the index, in place of those of the same paths."""
        with self.store.lock():
            none = files.limit(0).select("path")
            if docs is not None and not self.store.has("docs"):
                return self._publish({"files": tables.upsert(self.files(), files)} | self._texts(docs))
            return self._publish(self._changed(tables.upsert(self.files(), files), none, files.select("path"), docs))

    def remove_path(self, prefix: str) -> int:
        """What is at or below a path, gone from all tables."""
        with self.store.lock():
            gone = self.files().filter(sync.under_roots(F.col("path"), [prefix])).select("path")
            return self._publish(self._changed(tables.delete(self.files(), gone), gone, gone.limit(0)))

    def sync(self, listing: DataFrame, complete_roots: DataFrame, docs: DataFrame | None = None, now: int | None = None) -> dict:
        """The index brought in step with a full listing; how many rows were added, modified and deleted."""
        with self.store.lock():
            old = self.files()
            new, modified, gone = sync.diff_new(listing, old), sync.diff_modified(listing, old), sync.diff_deleted(listing, old, complete_roots)
            counts = {"added": new.count(), "modified": modified.count(), "deleted": gone.count()}
            if any(counts.values()):
                files = tables.upsert(tables.delete(old, gone), new.unionByName(modified))
                out = self._changed(files, gone.select("path"), modified.select("path"), docs)
                self._publish(out, {"last_index_time": now or int(time.time())})
            return counts

    def apply_changes(self, changes: DataFrame, listing: DataFrame, docs: DataFrame | None = None, meta: dict | None = None) -> None:
        """A batch of journal changes applied to all tables, in one generation together with ``meta``."""
        updates, deletes = sync.journal_apply(changes, listing)
        files = tables.upsert(tables.delete(self.files(), deletes), updates)
        texts = None if docs is None else docs.join(updates.select("path"), "path", "left_semi")
        self._publish(self._changed(files, deletes, updates.select("path"), texts), meta)

    def update_file(self, path: str, size: int, modified_ts: int) -> int:
        with self.store.lock():
            return self.store.publish({"files": tables.update_file(self.files(), path, size, modified_ts)})

    def clear(self, name: str) -> int:
        """A table without rows."""
        with self.store.lock():
            return self._publish({name: self.store.read(self.spark, name).limit(0)})

    def track(self, path: str, action: str, now: int | None = None) -> None:
        """One interaction, written as a small file of its own."""
        if action not in K.ACTIONS:
            raise ValueError(f"action must be one of {', '.join(K.ACTIONS)}")
        row = self.spark.createDataFrame([(path, action, now or int(time.time()))], INTERACTIONS)
        with self.store.lock():
            self.store.publish({}, append={"interactions": row})

    # jobs

    def embed(self, embedder: Callable[[list[str]], list[list[float]]], docs: DataFrame | None = None) -> dict:
        """Vectors made for files without a true one; texts whose hash is known only get a new time. Failed batches are logged and stay to be done."""
        with self.store.lock("embed"):
            todo = pending.pending_embed(self.files(), self.vectors())
            made, touched, failed = jobs.embed(todo, docs if docs is not None else self.docs(), self.vectors(), embedder)
            errors = [r["error"] for r in failed.select("error").distinct().limit(20).collect()]
            for e in errors:
                log_error(self.store.root, "embed", e)
            counts = {"embedded": made.count(), "touched": touched.count(), "failed": failed.count()}
            if counts["embedded"] or counts["touched"]:
                with self.store.lock():
                    self.store.publish({"vectors": tables.upsert(tables.touch(self.vectors(), touched), made)})
                self.index_vectors()
            return counts

    def ocr(self, recogniser: Callable[[list[str]], list[dict]], batch: int = 50) -> dict:
        """Pending images read; their texts are indexed and only then are they marked as done, those of low confidence too."""
        with self.store.lock("ocr"):
            todo = pending.pending_ocr(self.files(), self.ocr_status())
            done, failed = jobs.recognise(todo, recogniser, batch)
            for r in failed.select("error").distinct().limit(20).collect():
                log_error(self.store.root, "ocr", r[0])
            counts = {"done": done.count(), "failed": failed.count()}
            if counts["done"]:
                names = self.files().select("path", "filename", "extension")
                texts = done.filter("text <> ''").join(names, "path").select("path", "filename", "extension", F.col("text").alias("content"))
                status = done.select("path", "modified_ts", F.lit(1).alias("ocr_done"), "confidence")
                with self.store.lock():
                    none = texts.limit(0).select("path")
                    out = self._texts(texts) if not self.store.has("docs") else self._changed(self.files(), none, none, texts)
                    self._publish(out | {"files": self.files(), "ocr_status": tables.upsert(self.ocr_status(), status)})
            return counts

    def index_vectors(self) -> int:
        """The ANN index of all vectors, made anew and switched to with the number of vectors it holds."""
        usable = self.vectors()
        dim = usable.filter("vector is not null").select(F.size("vector").alias("n")).groupBy("n").count().orderBy(F.desc("count"), "n").head()
        if dim is None:
            return 0
        model, unit = vectors.fit_lsh(usable, dim["n"])
        name = f"ann_model/g{self.store.generation() + 1:06d}-{time.time_ns():x}"
        model.write().save(f"{self.store.files.root}/{name}")
        before = self.store.meta("ann_model")
        count = unit.count()
        out = self.store.publish({"ann": model.transform(unit)}, {"ann_model": name, "ann_dim": dim["n"], "ann_count": count})
        if before:
            self.store.files.remove(before)
        return out

    # questions

    def search(self, query: str, now: int | None = None, semantic: list[float] | None = None, **options) -> DataFrame:
        """Ranked results with snippets; recent files for an empty query. Up to MAX_RESULTS rows are held by the driver."""
        now = now or int(time.time())
        opts = Options(now=now, **options)
        if not parse_query(query).text.strip():
            kept = recents.recent_scoped(self.files(), opts.limit, opts.prefixes) if opts.prefixes else recents.recent_files(self.files(), opts.limit)
            return kept.select("path", "filename", F.lit(0.0).alias("score"), F.lit("recent").alias("match_type"), "size_bytes", "modified_ts", "extension", "is_dir")
        near = None if semantic is None else self.similar(semantic)
        texts = self.text_index() if self.store.has("postings") else self.docs()
        if opts.limit > MAX_RESULTS:
            return self._ranked(query, opts, texts, near, now)
        with staging():
            found = self._ranked(query, opts, texts, near, now)
            return self.spark.createDataFrame(found.collect(), found.schema)

    def _ranked(self, query: str, opts: Options, texts, near: DataFrame | None, now: int) -> DataFrame:
        found = scoped_search(self.files(), texts, query, opts, tables.prune_interactions(self.interactions(), now), near)
        found = found.withColumn("score", F.round("score", 2)).withColumn("file_type", file_type(F.col("extension"), F.col("is_dir")))
        return with_snippets(found, self.docs(), query, opts.snippet_length).orderBy(F.desc("bucket"), F.desc("modified_ts"), "path")

    def two_phase(self, query: str, embed_query: Callable[[str], list[float]], now: int | None = None, **options):
        """The results without semantic matches at once, then those with them (the same again if the vector cannot be had)."""
        yield self.search(query, now, **options)
        yield self.search(query, now, semantic=self.query_vector(query, embed_query), **options)

    def query_vector(self, query: str, embed_query: Callable[[str], list[float]]) -> list[float] | None:
        """The vector of a query, remembered whatever its case; None if it cannot be had."""
        key = query.strip().lower()
        if key not in self.query_vectors:
            try:
                self.query_vectors[key] = embed_query(query)
            except Exception as e:  # a search goes on without
                log_error(self.store.root, "query vector", str(e))
                return None
        return self.query_vectors[key]

    def similar(self, vector: list[float], k: int = 50) -> DataFrame:
        """Semantic matches: the ANN index's while it is current, or the scan of the newest vectors where it finds none."""
        name = self.store.meta("ann_model")
        if name and self.store.meta("ann_dim") == len(vector) and not vectors.stale_index(self.store.meta("ann_count", 0), self.vectors().count()):
            ann = self.store.read(self.spark, "ann").join(self.vectors().select("path"), "path", "left_semi")
            found = vectors.ann_search(vectors.load_lsh(f"{self.store.files.root}/{name}"), ann, vector, k)
            if found.limit(1).count():
                return found
        return vectors.semantic_scan(self.vectors(), vector)

    def response(self, query: str, now: int | None = None, sync_skipped: bool = False, **options) -> str:
        """The results as a JSON document; errors become one too."""
        empty = {"query": query, "total_results": 0, "results": [], "sync_skipped": sync_skipped}
        try:
            if not self.store.exists():
                return json.dumps({"mode": "indexing"} | empty)
            if query and len(query.encode()) < 2:
                return json.dumps({"mode": "too_short"} | empty)
            started = time.time()
            options["limit"] = min(MAX_RESULTS, options.get("limit", 30))
            options["snippet_length"] = min(10_000, options.get("snippet_length", 200))
            found = self.search(query, now, **options).withColumn("modified", rfc3339(F.col("modified_ts"))).drop("bucket", "modified_ts")
            rows = [json.loads(r) for r in found.toJSON().collect()]  # limit rows
            mode = "unified" if parse_query(query).text.strip() else "recent"
            return json.dumps(empty | {"mode": mode, "duration_ms": int(1000 * (time.time() - started)), "total_results": len(rows), "results": rows}, ensure_ascii=False)
        except Exception as e:  # a client reads errors from the document
            return json.dumps({"mode": "error", "error": str(e)[:500]} | empty)

    def status(self) -> dict:
        done, embedded = pending.coverage(self.files(), self.ocr_status(), K.OCR_EXTENSIONS).head(), pending.coverage(self.files(), self.vectors(), K.EMBED_EXTENSIONS).head()
        return {
            "files": self.files().count(), "documents": self.docs().count(), "last_index_time": self.store.meta("last_index_time"),
            "ocr": list(done), "semantic": list(embedded), "generation": self.store.generation(), "schema_current": self.store.current_schema(),
        }

    def doctor(self) -> dict:
        """The status, what is wrong with it, and the errors of late."""
        if not self.store.exists():
            return {"health": "missing", "errors": recent_errors(self.store.root)}
        try:
            found = self.status()
        except Exception as e:
            return {"health": "corrupt", "error": str(e)[:500], "errors": recent_errors(self.store.root)}
        expected = extractable(self.files()).count()
        drift = sync.drifted(found["documents"], expected)
        health = "drifted" if drift else "ok" if found["schema_current"] else "outdated"
        return found | {"health": health, "expected_documents": expected, "errors": recent_errors(self.store.root)}

    def stale(self, now: int | None = None, hours: int = 24) -> bool:
        """Whether the last build or sync is so long ago that the index should be brought in step."""
        return sync.older(self.store.meta("last_index_time"), now or int(time.time()), hours * 3600)

    def reconcile(self, now: int | None = None, minutes: int = 60) -> bool:
        """Whether drift should be looked for: not again within an hour; the time of the look is kept."""
        now = now or int(time.time())
        if not sync.older(self.store.meta("last_reconcile"), now, minutes * 60):
            return False
        self.store.set_meta(last_reconcile=now)
        return sync.drifted(self.docs().count(), extractable(self.files()).count())

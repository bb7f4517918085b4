"""The index: build, refresh, search and statistics over Spark tables."""

from __future__ import annotations

import threading
import time
from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..chunking.chunker import chunk_files
from ..config import EngineConfig
from ..functions.text import snippet, token_types, tokenize
from ..functions.vectors import fitted
from ..operators import deltas, maintenance, ranking, stats
from ..sources import store, workspace
from ..sources.providers import FALLBACK_DIMENSION, Client, LexicalProvider, create_provider
from ..streaming.watch import DirWatcher, Refresher
from .abort import Abort

FILES = "file_id long, file_ord long, rel string, path string, size long, bytes long, mtime_ms double, language string"


@dataclass
class BuildResult:
    mode: str
    added: int = 0
    updated: int = 0
    removed: int = 0
    unchanged: int = 0
    files: int = 0
    chunks: int = 0
    truncated: bool = False
    errors: list[str] = field(default_factory=list)
    taken: list[str] = field(default_factory=list, repr=False)  # the files that were read anew


@dataclass
class SearchResult:
    query: str
    degraded: bool
    provider_id: str
    took_ms: int
    count: int
    hits: list[dict]


class _ProviderChanged(Exception):
    """Embedding fell back to another provider during a refresh."""


class RetrievalIndex:
    """Raw term frequencies are stored; weights that depend on the whole corpus are applied when read."""

    def __init__(self, spark: SparkSession, config: EngineConfig, client: Client | None = None):
        self.spark, self.config, self.client = spark, config.checked(), client
        self.provider = create_provider(self.config.provider, client)
        self.tables: dict[str, DataFrame] | None = None
        self.meta: store.Meta | None = None
        self.base = store.Commit()  # what this index has seen published; it publishes after that only
        self.degraded = False
        self.errors: list[str] = []
        self._lock = threading.RLock()
        self._abort = Abort()  # of the operation that holds the lock

    @property
    def ready(self) -> bool:
        return self.tables is not None

    def init(self) -> str:
        """Loads the stored snapshot if there is a fitting one: loaded, empty or stale."""
        with self._lock:
            found = store.load(self.spark, self.config.data_dir, self.provider.id, self.provider.dimension)
            self.base = found.base
            if found.status == "loaded":
                self.tables, self.meta = found.tables, found.meta
                self.provider.dimension = self.provider.dimension or found.meta.dimension
            return found.status

    def build(self, mode: str = "refresh", abort: Abort | None = None) -> BuildResult:
        """Refreshes or builds; an aborted or failed one leaves the snapshot before it in use.

        Raises ``store.Conflict`` if another writer has published meanwhile; the
        next operation then starts from what that one wrote.
        """
        with self._turn(abort):
            return self._build(mode)

    def _build(self, mode: str = "refresh") -> BuildResult:
        if not self.ready and mode == "refresh":
            self.init()
        elif not self.ready:
            self.base = store.current(self.spark, self.config.data_dir)
        return self._refresh() if self.ready and mode == "refresh" else self._full()

    @contextmanager
    def _turn(self, abort: Abort | None = None) -> Iterator[None]:
        abort = abort or Abort()
        with abort.turn(self.spark, self._lock):
            outer, self._abort = self._abort, abort
            try:
                yield
            except store.Conflict:
                self.tables = self.meta = None
                raise
            finally:
                self._abort = outer

    def _full(self) -> BuildResult:
        files, listing = workspace.scan(self.spark, self.config)
        fresh = files.withColumn("file_id", F.col("file_ord") + 1)
        out = self._publish(self.spark.createDataFrame([], FILES), None, workspace.with_contents(fresh), listing.truncated or bool(listing.errors), strict=False)
        out.mode, out.added, out.errors = "full", out.files, listing.errors
        self.errors = listing.errors
        return out

    def _refresh(self) -> BuildResult:
        """Reads changed files only.

        Files that a scan which was cut short or failed in places did not see
        stay, as do indexed ones that are binary now; of changed files those are
        taken that fit the caps together with what the index holds.
        """
        scanned, listing = workspace.scan(self.spark, self.config)
        old = self.tables["files"]
        complete = not (listing.truncated or listing.errors or listing.skipped.get("too-large"))
        binary = self.spark.createDataFrame([(r,) for r in listing.binary], "rel string")
        retained = not maintenance.only_files(old, binary).isEmpty()
        change = maintenance.changes(old, scanned, complete)
        # As many rows as the driver has listed.
        known = {r.rel: r.change for r in change.collect()}
        kept_binary = set(listing.binary)
        counts = {c: sum(v == c and not (c == "removed" and r in kept_binary) for r, v in known.items()) for c in ("removed", "unchanged")}
        gone = self.spark.createDataFrame([(r,) for r, v in known.items() if v == "removed" and r not in kept_binary], "rel string")
        remaining = maintenance.without_files(old, gone)
        changed = self.spark.createDataFrame([(r,) for r, v in known.items() if v in ("added", "updated")], "rel string")
        # Again as many rows as listed.
        sizes = {r.rel: r for r in old.select("rel", "bytes", "file_id").collect()}
        highest = max((r.file_id for r in sizes.values()), default=0)
        total = sum(r.bytes for r in sizes.values() if not (known.get(r.rel) == "removed" and r.rel not in kept_binary))
        fitting: list[tuple[str]] = []
        for r in maintenance.only_files(scanned, changed).select("rel", "bytes", "file_ord").orderBy("file_ord").collect():
            total += r.bytes - (sizes[r.rel].bytes if r.rel in sizes else 0)
            if total > self.config.max_total_bytes:
                break
            fitting.append((r.rel,))
        fits = maintenance.only_files(scanned, self.spark.createDataFrame(fitting, "rel string")).withColumn("file_id", F.col("file_ord") + F.lit(highest + 1))
        wanted = sum(v in ("added", "updated") for v in known.values())
        cut_short = not complete or retained or len(fitting) < wanted
        if not (wanted or counts["removed"]):
            out = BuildResult("refresh", files=old.count(), chunks=self.meta.n_chunks, truncated=cut_short)
        else:
            out = self._publish(remaining, self.tables, workspace.with_contents(fits), cut_short, strict=True)
        out.added, out.updated = (sum(known.get(r) == c for r in out.taken) for c in ("added", "updated"))
        out.removed, out.unchanged = counts["removed"], counts["unchanged"]
        out.mode, out.errors = "refresh", listing.errors
        self.errors = listing.errors
        return out

    def reindex_file(self, rel: str) -> BuildResult:
        """Reads one file again; a file that is gone is removed."""
        import os

        with self._turn():
            if not self.ready:
                self.init()
            if not self.ready:
                return self._full()
            old = self.tables["files"]
            path = os.path.join(self.config.root, rel)
            known = not old.where(F.col("rel") == rel).isEmpty()
            highest = old.agg(F.max("file_id")).first()[0] or 0
            rows = []
            if os.path.isfile(path):
                from ..chunking.languages import language_of

                stat = os.stat(path)
                with open(path, "rb") as f:
                    content = f.read().decode("utf-8", "replace")
                language = language_of(rel)
                rows = [(highest + 1, highest, rel, path, stat.st_size, len(content.encode()), stat.st_mtime_ns / 1e6, language.name if language else "text", content)]
            fresh = self.spark.createDataFrame(rows, f"{FILES}, content string")
            out = self._publish(old if rows else old.where(F.col("rel") != rel), self.tables, fresh, self.meta.truncated, strict=True)
            out.mode = "file"
            out.added, out.updated, out.removed = (int(bool(out.taken) and not known), int(bool(out.taken) and known), int(not rows))
            return out

    def remove_file(self, rel: str) -> bool:
        with self._turn():
            if not self.ready:
                self.init()
            if not self.ready or self.tables["files"].where(F.col("rel") == rel).isEmpty():
                return False
            self._publish(self.tables["files"].where(F.col("rel") != rel), self.tables, self.spark.createDataFrame([], f"{FILES}, content string"), self.meta.truncated, strict=True)
            return True

    def _publish(self, remaining: DataFrame, before: dict[str, DataFrame] | None, fresh: DataFrame, truncated: bool, strict: bool) -> BuildResult:
        """Writes the fresh files as a segment, and a snapshot in which they replace those of the same name among the remaining ones.

        Statistics follow the postings that came and went.  A build that fails
        or is aborted leaves no segment behind.
        """
        provider, segment = self.provider, store.Segment(self.spark, self.config.data_dir)
        cut = chunk_files(fresh.select("file_id", "rel", "content"), self.config.max_lines_per_chunk).persist()
        try:
            return self._write(remaining, before, fresh, truncated, strict, cut, segment)
        except _ProviderChanged:
            # The held vectors are another provider's: nothing of them can stay.
            return self._full()
        except BaseException:
            segment.discard()
            if not self.config.allow_fallback:
                self.provider = provider
            raise
        finally:
            cut.unpersist()
            provider.release()

    def _write(self, remaining: DataFrame, before: dict[str, DataFrame] | None, fresh: DataFrame, truncated: bool, strict: bool, cut: DataFrame, segment: store.Segment) -> BuildResult:
        folder, spark = self.config.data_dir, self.spark
        narrow = [c.strip().split(" ")[0] for c in FILES.split(",")]
        # Names and numbers of files, at most as many as the driver has listed.
        found = fresh.select(*narrow).join(cut.groupBy("file_id").agg(F.count(F.lit(1)).alias("n_chunks")), "file_id").collect()
        found.sort(key=lambda r: r.file_ord)
        held: list = []
        if before:
            stays = remaining.select("file_id", F.lit(True).alias("stays"))
            held = before["files"].select("file_id", "rel", "n_chunks").join(stays, "file_id", "left").collect()
        gone = [r.file_id for r in held if not r.stays]
        old = {r.rel: r for r in held if r.stays}
        n = sum(r.n_chunks for r in old.values())
        last_id = self.meta.last_id if before else 0
        rows, starts, cap = [], [], self.config.max_chunks
        for r in found:
            more = r.n_chunks - (old[r.rel].n_chunks if r.rel in old else 0)
            # A full build starts a file while the cap is not reached; a refresh never exceeds it.
            if n + more > cap if before or strict else n >= cap:
                break
            rows.append(tuple(r))
            # Ids follow file order, then line: they decide ties.
            starts.append((r.file_id, r.language, last_id))
            n, last_id = n + more, last_id + r.n_chunks
            if r.rel in old:
                gone.append(old[r.rel].file_id)
        truncated = truncated or len(rows) < len(found)
        taken, starts = spark.createDataFrame(rows, f"{FILES}, n_chunks long"), spark.createDataFrame(starts, "file_id long, language string, base long")
        numbered = cut.join(starts, "file_id").withColumn("chunk_id", F.col("base") + F.row_number().over(Window.partitionBy("file_id").orderBy("start_line"))).drop("base")
        order = ["chunk_id", "file_id", "rel", "language", "symbol", "start_line", "end_line", "content", "summary"]
        chunks = segment.write("chunks", numbered.select(*order))
        segment.write("files", taken)
        self._abort.check()
        vectors = self._vectors(chunks)
        if before and self.meta.provider_id != self.provider.id:
            segment.discard()
            raise _ProviderChanged
        of_chunk = chunks.select(F.col("chunk_id").alias("unit_id"), "file_id")
        segment.write("vectors", vectors.withColumn("v", fitted(F.col("v"), self.provider.dimension)).join(of_chunk, "unit_id"))
        segment.check(self.meta.last_id + 1 if before else 1, last_id, not self.provider.local)
        texts = chunks.select(F.col("chunk_id").alias("unit_id"), F.col("content").alias("text"))
        self._abort.check()
        tf = segment.write("tf", stats.term_frequencies(texts, self.config.ngram).join(of_chunk, "unit_id"))
        segment.write("lengths", tf.groupBy("unit_id", "file_id").agg(F.sum("tf").alias("dl")))
        if self.provider.local:
            # The vector channel always uses pairs of letters, whatever the index uses.
            pairs = tf if self.config.ngram == 2 else stats.term_frequencies(texts).join(of_chunk, "unit_id")
            segment.write("sparse", ranking.bucket_postings(pairs, self.provider.dimension))
        else:
            segment.write("sparse", spark.createDataFrame([], "term string, unit_id long, file_id long, bucket int, s double"))
        lost = before["tf"].join(F.broadcast(spark.createDataFrame([(x,) for x in gone], "file_id long")), "file_id", "left_semi") if gone else tf.where("false")
        signed = deltas.signed_postings(tf, lost)
        df = deltas.merged_df(before["df"] if before else spark.createDataFrame([], "term string, df long"), deltas.term_changes(signed))
        total = (self.meta.total_len if before else 0) + (signed.agg(F.sum(F.col("sign") * F.col("tf"))).first()[0] or 0)
        segments = (*(self.meta.segments if before else ()), segment.name)
        written = (self.meta.rows if before else {}) | {segment.name: segment.rows}
        meta = store.Meta(self.provider.id, self.provider.kind, self.provider.dimension, self.config.root, int(time.time() * 1000), truncated, n, total, last_id, segments, (*(self.meta.gone if before else ()), *gone), written)
        if len(segments) > store.MAX_SEGMENTS:
            meta = self._compacted(meta)
        tables = store.open_tables(spark, folder, "", meta, statistics=False)
        weighted = deltas.idf_of(df, n)
        self._abort.check()
        home, self.base = store.save(spark, folder, {"df": df, "norms": ranking.vector_norms(tables["sparse"], weighted)}, meta, self.base)
        self.tables, self.meta = store.open_tables(spark, folder, home, meta), meta
        return BuildResult("", files=self.tables["files"].count(), chunks=n, truncated=truncated, taken=[r.rel for r in found[: len(rows)]])

    def _compacted(self, meta: store.Meta) -> store.Meta:
        """All live rows in one new segment."""
        whole = store.Segment(self.spark, self.config.data_dir)
        live = store.open_tables(self.spark, self.config.data_dir, "", meta, statistics=False)
        try:
            for table, rows in live.items():
                self._abort.check()
                whole.write(table, rows)
        except BaseException:
            whole.discard()
            raise
        return replace(meta, segments=(whole.name,), gone=(), rows={whole.name: whole.rows})

    def _vectors(self, chunks: DataFrame) -> DataFrame:
        """Dense vectors of a client; none for the local provider, whose weights are applied when searching."""
        if not self.provider.local:
            try:
                return self.provider.embed(chunks.select(F.col("chunk_id").alias("unit_id"), F.col("content").alias("text")))
            except Exception:
                self._abort.check()  # a cancelled job is no failure of the service
                if not self.config.allow_fallback:
                    raise
                self.provider, self.degraded = LexicalProvider(FALLBACK_DIMENSION), True
        return self.spark.createDataFrame([], "unit_id long, v array<float>")

    def search(self, query: str, top_k: int | None = None, abort: Abort | None = None) -> SearchResult:
        began, query = time.time(), query.strip()
        if not query:
            raise ValueError("the query is empty")
        with self._turn(abort):
            if not self.ready:
                self._build()
            found, degraded = self._search(query, max(1, int(top_k if top_k is not None else self.config.top_k)))
            rows = [r.asDict() for r in found.orderBy(F.desc("score"), F.asc("chunk_id")).collect()]
        return SearchResult(query, degraded, self.provider.id, int(1000 * (time.time() - began)), len(rows), rows)

    def _search(self, query: str, top_k: int) -> tuple[DataFrame, bool]:
        """Reads of the stored tables what the query's terms and buckets need."""
        t, limit = self.tables, self.config.vector_k
        units = t["chunks"].select(F.col("chunk_id").alias("unit_id"))
        # A constant: no job is needed to tokenize the query.
        asked = self.spark.sql("SELECT 1").select(token_types(F.lit(query), self.config.ngram).alias("types"), tokenize(F.lit(query)).alias("tokens")).first()
        terms = list(dict.fromkeys([*asked.types, *asked.tokens]))
        weighted = deltas.idf_of(t["df"], self.meta.n_chunks)
        idf = {r.term: r.idf for r in weighted.where(F.col("term").isin(terms)).select("term", "idf").collect()} if terms else {}
        lexical = ranking.top(ranking.bm25_of_terms(t["tf"], {x: idf.get(x) for x in asked.types}, t["lengths"], self.meta.avg_len), limit)
        degraded = self.degraded
        if self.provider.local:
            found = ranking.query_vector(Counter(asked.tokens), idf, self.provider.dimension)
            vector = ranking.cosine_of_postings(units, t["sparse"], weighted, t["norms"], found, limit)
        else:
            try:
                vectors = self.provider.embed_texts([query])[0]
                if vectors is None:
                    raise ValueError("the query was rejected")
                vector = ranking.top(ranking.cosine_dense(t["vectors"], vectors), limit)
            except Exception:
                if not self.config.allow_fallback:
                    raise
                degraded, vector = True, self.spark.createDataFrame([], "unit_id long, score double")
        fused = ranking.fuse(vector, lexical, self.config.rrf_k, top_k)
        hits = t["chunks"].join(F.broadcast(fused.withColumnRenamed("unit_id", "chunk_id")), "chunk_id")
        paths = t["files"].select("file_id", "path")
        path = F.coalesce("path", F.concat(F.lit(f"{self.config.root}/"), F.col("rel")))
        cut = snippet(F.col("content"))
        return hits.join(paths, "file_id", "left").select("chunk_id", F.col("rel").alias("file"), path.alias("path"), "language", "symbol", "start_line", "end_line", cut.alias("snippet"), "summary", "score", "vector_score", "lexical_score"), degraded

    def watch(self, polling_ms: float = 1500) -> DirWatcher:
        """Builds or loads the index, then refreshes it after changes under the root until the watcher is closed."""
        refresher = Refresher(lambda: self.build("refresh"), lambda e: self.errors.append(f"refresh failed: {e}"))
        exclude = tuple(x for x in self.config.ignore if "*" not in x)
        watcher = DirWatcher(self.config.root, refresher.ask, exclude, self.config.watch_debounce_ms, polling_ms).start()
        try:
            self.build("refresh")
        finally:
            refresher.ready()
        return watcher

    def stats(self) -> dict:
        with self._lock:
            base = {"ready": self.ready, "provider_id": self.provider.id, "provider_kind": self.provider.kind, "dimension": self.provider.dimension, "root": self.config.root, "degraded": self.degraded, "errors": list(dict.fromkeys(self.errors)), "disk_bytes": store.size_bytes(self.spark, self.config.data_dir)}
            if not self.ready:
                return base | {"files": 0, "chunks": 0, "terms": 0, "bytes": 0, "built_at": None, "truncated": False}
            files = self.tables["files"].agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("b")).first()
            return base | {"files": files.n, "chunks": self.meta.n_chunks, "terms": self.tables["df"].count(), "bytes": files.b, "built_at": self.meta.built_at, "truncated": self.meta.truncated}

import os
import time
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from quarrix.config import EngineConfig, ProviderConfig
from quarrix.functions.vectors import fitted
from quarrix.operators import ranking
from quarrix.plans.index import RetrievalIndex
from quarrix.plans.tool import dispatch, render
from quarrix.plans.abort import Abort, Aborted
from quarrix.sources import store
from quarrix.sources.providers import ClientProvider, RejectedBatch, parse_embeddings

FILES = {
    "src/parser.ts": "export function parseConfig(text) {\n  return JSON.parse(text)\n}\nexport class ConfigError {\n}\n",
    "src/retry.py": "def retry_request(times):\n    return times\n\nclass Backoff:\n    pass\n",
    "main.go": "package main\nfunc startServer() {\n}\n",
    "docs/readme.md": "The vector search engine ranks fragments.\n",
    "cjk.ts": "// 语义搜索引擎\nconst a = 1\n",
    "node_modules/x.ts": "function ignored() {}\n",
    "bin.txt": "a\0b",
    "pic.png": "no",
}


@pytest.fixture
def workspace(tmp_path):
    for rel, content in FILES.items():
        (tmp_path / rel).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / rel).write_text(content)
    return tmp_path


def config(root, **more):
    return EngineConfig(root=str(root), provider=ProviderConfig("lexical", 256), top_k=10, **more)


def first(result):
    return result.hits[0]["file"]


def test_build_search_refresh(spark, workspace):
    index = RetrievalIndex(spark, config(workspace))
    built = index.build("full")
    assert (built.files, built.added, built.truncated) == (5, 5, False)
    assert first(index.search("parse config")) == "src/parser.ts"
    assert first(index.search("retry request backoff")) == "src/retry.py"
    assert first(index.search("语义搜索")) == "cjk.ts"
    nothing = index.search("zzzzunknown")
    assert nothing.count == 8 and all(h["lexical_score"] is None for h in nothing.hits)
    assert index.stats()["files"] == 5

    again = RetrievalIndex(spark, config(workspace))
    assert again.init() == "loaded"
    assert again.build("refresh").unchanged == 5
    (workspace / "src/retry.py").write_text("def resend():\n    return 'teleport'\n")
    (workspace / "main.go").unlink()
    (workspace / "new.rb").write_text("class Fresh\nend\n")
    done = again.build("refresh")
    assert (done.added, done.updated, done.removed, done.unchanged) == (1, 1, 1, 3)
    full = RetrievalIndex(spark, config(workspace, data_dir=".other"))
    full.build("full")
    for q in ("teleport", "parse config", "fresh"):
        a, b = again.search(q), full.search(q)
        assert {(h["file"], round(h["lexical_score"] or 0, 6), round(h["vector_score"], 6)) for h in a.hits} == {(h["file"], round(h["lexical_score"] or 0, 6), round(h["vector_score"], 6)) for h in b.hits}
    assert again.remove_file("new.rb") and not again.remove_file("new.rb")
    assert again.reindex_file("docs/readme.md").updated == 1
    assert again.reindex_file("gone.md").removed == 1


def test_stale_snapshots(spark, workspace):
    RetrievalIndex(spark, config(workspace)).build("full")
    folder = str(workspace / ".quarrix")
    assert store.load(spark, folder, "lexical:256", 256).status == "loaded"
    assert store.load(spark, folder, "lexical:512", 512).status == "stale"
    assert store.load(spark, folder, "lexical:256", 128).status == "stale"
    with open(os.path.join(folder, store.current(spark, folder).snapshot, "meta.json"), "w") as f:
        f.write("{")
    assert store.load(spark, folder, "lexical:256", 256).status == "stale"
    store.clear(spark, folder)
    assert store.load(spark, folder, "lexical:256", 256).status == "empty"


def test_caps(spark, workspace):
    small = RetrievalIndex(spark, config(workspace, max_chunks=10, max_total_bytes=1024)).build("full")
    assert small.files == 5
    for i in range(30):
        (workspace / f"f{i:02}.txt").write_text("word\n")
    assert RetrievalIndex(spark, config(workspace, max_files=12)).build("full").truncated


def test_ranges():
    for bad in ({"top_k": 0}, {"ngram": 5}, {"max_lines_per_chunk": 3}, {"rrf_k": 1001}, {"provider": ProviderConfig("lexical", 10)}, {"provider": ProviderConfig("openai", 2)}):
        with pytest.raises(ValueError, match="config error"):
            EngineConfig(**bad).checked()


def test_client_provider_salvages(spark):
    def client(texts):
        if any("bad" in t for t in texts):
            raise RejectedBatch("400")
        return [[3.0, 4.0] for _ in texts]

    provider = ClientProvider(ProviderConfig("openai", 0), client)
    got = provider.embed(spark.createDataFrame([(1, "ok"), (2, "bad"), (3, None)], "unit_id long, text string")).collect()
    assert {r.unit_id: [round(x, 3) for x in r.v] for r in got} == {1: [0.6, 0.8], 2: [0.0, 0.0], 3: [0.6, 0.8]}
    assert provider.dimension == 2
    for body in ({}, {"data": []}, {"data": [{"embedding": []}]}, {"data": [{"embedding": [float("nan")]}]}):
        with pytest.raises(ValueError):
            parse_embeddings(body, 1)


def test_a_refused_batch_is_halved_within_one_deadline():
    calls = []

    def client(texts):
        calls.append(len(texts))
        if any("bad" in t for t in texts):
            raise RejectedBatch("400")
        return [[3.0, 4.0] for _ in texts]

    provider = ClientProvider(ProviderConfig("openai", 0), client)
    for bad in (0, 13, 31):
        calls.clear()
        got = provider.embed_texts(["bad" if i == bad else f"text {i}" for i in range(32)])
        assert [i for i, v in enumerate(got) if v is None] == [bad] and len(calls) <= 11

    def slow(texts):
        time.sleep(0.06)
        raise RejectedBatch("400")

    began = time.monotonic()
    with pytest.raises(TimeoutError):
        ClientProvider(ProviderConfig("openai", 0, timeout_ms=100), slow).embed_texts(["x"] * 32)
    assert time.monotonic() - began < 2


def test_fallback_and_degradation(spark, workspace):
    def broken(texts):
        raise OSError("closed")

    index = RetrievalIndex(spark, EngineConfig(root=str(workspace), provider=ProviderConfig("openai", 8)), broken)
    index.build("full")
    assert index.degraded and index.provider.kind == "lexical"
    assert index.search("parse config").degraded
    strict = RetrievalIndex(spark, EngineConfig(root=str(workspace), data_dir=".s", allow_fallback=False, provider=ProviderConfig("openai", 8)), broken)
    assert not dispatch(strict, "reindex", full=True)["ok"]


def test_tool(spark, workspace):
    index = RetrievalIndex(spark, config(workspace))
    assert not dispatch(index, "nope")["ok"]
    assert not dispatch(index, "search", query="  ")["ok"]
    found = dispatch(index, "search", query="parse config", top_k=2)
    assert found["ok"] and found["count"] == 2 and "src/parser.ts" in render("search", found)
    assert "files" in render("stats", dispatch(index, "stats"))
    assert dispatch(index, "reindex", path="main.go")["mode"] == "file"


def test_fusion(spark):
    v = spark.createDataFrame([(1, 0.9), (2, 0.8)], "unit_id long, score double")
    x = spark.createDataFrame([(2, 5.0), (3, 4.0)], "unit_id long, score double")
    rows = ranking.fuse(v, x, 60, 2).collect()
    assert [(r.unit_id, r.vector_score, r.lexical_score) for r in rows] == [(2, 0.8, 5.0), (1, 0.9, None)]
    assert rows[0].score == pytest.approx(1 / 62 + 1 / 61)


def test_cli(capsys):
    from quarrix.__main__ import main

    assert main(["version"]) == 0 and main(["help"]) == 0
    assert main(["search", " "]) == 2 and main(["nope"]) == 2 and main(["search", "x", "--nope"]) == 2


def test_query_vector_is_that_of_a_unit(spark):
    counts, idf = {"alpha": 1, "beta": 3, "语义": 2, "zz9": 1}, {"alpha": 2.5, "beta": 0.3, "语义": 1.75}
    tf = spark.createDataFrame([(0, t, n) for t, n in counts.items()], "unit_id long, term string, tf long")
    rows = ranking.hashed_vectors(tf, spark.createDataFrame(list(idf.items()), "term string, idf double"), 8).collect()
    assert {r.bucket: r.w for r in rows} == pytest.approx(ranking.query_vector(counts, idf, 8), abs=1e-7)


def scores(index, q):
    return {(h["file"], h["start_line"], round(h["lexical_score"] or 0, 6), round(h["vector_score"] or 0, 6), round(h["score"], 9)) for h in index.search(q).hits}


def test_segments_hold_what_changed_and_are_compacted(spark, tmp_path, monkeypatch):
    """A refresh writes its own files; searches are those of a rebuild; beyond the limit one segment remains."""
    monkeypatch.setattr(store, "MAX_SEGMENTS", 3)
    for i in range(12):
        (tmp_path / f"f{i:02}.txt").write_text(f"common words alpha{i % 3} beta{i}\n" * (i + 1))
    index = RetrievalIndex(spark, config(tmp_path))
    index.build("full")
    for step in range(4):
        (tmp_path / f"f{step:02}.txt").write_text(f"common changed alpha{step} gamma\n")
        (tmp_path / f"f{11 - step:02}.txt").unlink()
        done = index.build("refresh")
        assert (done.updated, done.removed) == (1, 1)
        newest = spark.read.parquet(os.path.join(index.config.data_dir, index.meta.segments[-1], "chunks"))
        assert newest.count() == (1 if len(index.meta.segments) > 1 else index.meta.n_chunks)
    assert len(index.meta.segments) <= 3 and any(len(s) for s in index.meta.segments)
    full = RetrievalIndex(spark, config(tmp_path, data_dir=".other"))
    full.build("full")
    assert (index.meta.n_chunks, index.meta.total_len) == (full.meta.n_chunks, full.meta.total_len)
    assert {tuple(r) for r in index.tables["df"].collect()} == {tuple(r) for r in full.tables["df"].collect()}
    for q in ("common gamma", "alpha1 beta5", "nothing"):
        assert {x[2:] for x in scores(index, q)} == {x[2:] for x in scores(full, q)}
    again = RetrievalIndex(spark, config(tmp_path))
    assert again.init() == "loaded" and scores(again, "common gamma") == scores(index, "common gamma")


def test_a_failed_build_leaves_the_old_snapshot_alone(spark, workspace, monkeypatch):
    index = RetrievalIndex(spark, config(workspace))
    index.build("full")
    before = sorted(os.listdir(index.config.data_dir))
    (workspace / "main.go").write_text("package other\n")

    def broken(*a):
        raise RuntimeError("disk full")

    monkeypatch.setattr(ranking, "vector_norms", broken)
    with pytest.raises(RuntimeError, match="disk full"):
        index.build("refresh")
    monkeypatch.undo()
    assert sorted(os.listdir(index.config.data_dir)) == before
    assert first(index.search("start server")) == "main.go" and index.build("refresh").updated == 1


def test_one_of_two_writers_wins(spark, workspace):
    first_one, second = (RetrievalIndex(spark, config(workspace)) for _ in range(2))
    first_one.build("full")
    assert second.init() == "loaded"
    (workspace / "main.go").write_text("package other\nfunc renamed() {\n}\n")
    first_one.build("refresh")
    with pytest.raises(store.Conflict):
        second.build("refresh")
    folder = first_one.config.data_dir
    assert store.current(spark, folder) == first_one.base
    assert set(first_one.meta.segments) <= set(os.listdir(folder)) and first(first_one.search("renamed")) == "main.go"
    # The loser starts from what the winner wrote.
    assert second.build("refresh").unchanged == 5 and second.base == first_one.base


def test_two_saves_at_once(spark, workspace):
    """Threads with the same base: one publishes, the others get an error and leave nothing."""
    index = RetrievalIndex(spark, config(workspace))
    index.build("full")
    folder, statistics = index.config.data_dir, {t: index.tables[t] for t in store.SNAPSHOT_TABLES}
    with ThreadPoolExecutor(4) as pool:
        saves = [pool.submit(store.save, spark, folder, statistics, index.meta, index.base) for _ in range(4)]
    won = [s.result() for s in saves if not s.exception()]
    assert len(won) == 1 and all(isinstance(s.exception(), store.Conflict) for s in saves if s.exception())
    assert store.current(spark, folder) == won[0][1] == store.Commit(2, won[0][0].rsplit("/", 1)[1])
    assert sum(x.startswith("v-") for x in os.listdir(folder)) == 2


def test_a_commit_left_unfinished_names_no_snapshot(spark, workspace):
    index = RetrievalIndex(spark, config(workspace))
    index.build("full")
    place = store.Folder(spark, index.config.data_dir)
    assert place.create(store._commit(2), "") and not place.create(store._commit(2), "x")
    again = RetrievalIndex(spark, config(workspace))
    assert again.init() == "loaded" and again.base == store.Commit(2, index.base.snapshot)
    # Its writer comes back and finishes after all: who built on the commit before has lost.
    (workspace / "main.go").unlink()
    with open(os.path.join(index.config.data_dir, store._commit(2)), "w") as f:
        f.write(f"v-{0:032x}")
    with pytest.raises(store.Conflict):
        again.build("refresh")
    assert not os.path.exists(os.path.join(index.config.data_dir, store._commit(3)))


def test_any_uri_and_lost_rows(spark, workspace):
    def client(texts):
        return [[float(len(t)), 1.0, 2.0, 3.0] for t in texts]

    folder = (workspace / "far").as_uri()
    made = EngineConfig(root=str(workspace), data_dir=folder, provider=ProviderConfig("openai", 4), ignore=("far",))
    index = RetrievalIndex(spark, made, client)
    index.build("full")
    assert index.config.data_dir == folder and index.stats()["disk_bytes"] > 0 and first(index.search("parse config"))
    assert not index.provider._made
    assert RetrievalIndex(spark, made, client).init() == "loaded"
    vectors = workspace / "far" / index.meta.segments[0] / "vectors"
    spark.read.parquet(str(vectors)).where("unit_id > 1").coalesce(1).write.parquet(str(workspace / "fewer"))
    for f in vectors.iterdir():
        f.unlink()
    for f in (workspace / "fewer").glob("*.parquet"):
        f.rename(vectors / f.name)
    found = store.load(spark, folder, index.provider.id, 4)
    assert found.status == "stale" and "vectors" in found.reason


def test_repeated_ids_are_refused(spark, tmp_path):
    segment = store.Segment(spark, str(tmp_path))
    for ids, right in (([1, 2, 3], True), ([1, 3, 3], False), ([1, 1, 3], False), ([1, 2], False), ([2, 2, 2], False)):
        segment = store.Segment(spark, str(tmp_path))
        segment.write("chunks", spark.createDataFrame([(i,) for i in ids], "chunk_id long"))
        if right:
            segment.check(1, 3, False)
        else:
            with pytest.raises(ValueError, match="repeated or missing"):
                segment.check(1, 3, False)
    empty = store.Segment(spark, str(tmp_path))
    empty.write("chunks", spark.createDataFrame([], "chunk_id long"))
    empty.check(1, 0, False)


def test_a_build_is_aborted(spark, workspace):
    """Its jobs end, nothing of it is left, and the snapshot before it is still used; one that waits its turn ends at once."""

    def slow(texts):
        if any("package other" in t for t in texts):
            time.sleep(60)
        return [[1.0, 2.0, 3.0, float(len(t))] for t in texts]

    index = RetrievalIndex(spark, EngineConfig(root=str(workspace), provider=ProviderConfig("openai", 4)), slow)
    index.build("full")
    before, known = sorted(os.listdir(index.config.data_dir)), index.base
    (workspace / "main.go").write_text("package other\n")
    running, waiting = Abort(), Abort()
    with ThreadPoolExecutor(2) as pool:
        build = pool.submit(index.build, "refresh", running)
        until = time.time() + 60
        while time.time() < until and sorted(os.listdir(index.config.data_dir)) == before:
            time.sleep(0.1)
        queued = pool.submit(index.search, "start", abort=waiting)
        time.sleep(3)
        waiting.ask()
        assert isinstance(queued.exception(5), Aborted) and not build.done()
        began = time.monotonic()
        running.ask()
        assert isinstance(build.exception(10), Aborted) and time.monotonic() - began < 40  # the service would take 60
    assert not spark.sparkContext.statusTracker().getActiveJobsIds()
    assert sorted(os.listdir(index.config.data_dir)) == before and index.base == known
    assert not index.degraded and not index.provider.local
    (workspace / "main.go").write_text("package main\nfunc startServer() {\n}\n")
    assert index.build("refresh").files == 5
    with pytest.raises(Aborted):
        index.build("full", running)


def test_vectors_are_fitted(spark):
    rows = spark.createDataFrame([(1, [1.0, 2.0, 3.0]), (2, [1.0]), (3, []), (4, None)], "i long, v array<float>")
    assert [r.v for r in rows.orderBy("i").select(fitted(F.col("v"), 2).alias("v")).collect()] == [[1.0, 2.0], [1.0, 0.0], [0.0, 0.0], None]

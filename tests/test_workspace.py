"""The scan reads what it lists; the watcher sees what changes."""

import os
import time

from quarrix import DirWatcher, EngineConfig, ProviderConfig, Refresher, RetrievalIndex, scan, with_contents
from quarrix.operators import maintenance
from quarrix.sources import workspace
from quarrix.streaming import watch


def put(root, files):
    for rel, content in files.items():
        path = root / rel
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content if isinstance(content, bytes) else content.encode())


def config(root, **more):
    return EngineConfig(root=str(root), provider=ProviderConfig("lexical", 64), **more).checked()


def test_every_listed_name_is_read(spark, tmp_path):
    names = ["a.py", "pkg/__init__.py", "_private.py", "app/[slug].tsx", ".hidden.txt", "a{1}.md", "with space.txt", "q?.txt", "__tests__/x.ts"]
    put(tmp_path, {n: f"text of {n}\n" for n in names})
    put(tmp_path, {f"many/f{i:03}.txt": "x" for i in range(80)})
    put(tmp_path, {"node_modules/big.ts": "x", "zero.txt": "", "pic.png": "x", "bin.txt": b"a\0b", "bad.txt": b"\x80" * 10})
    with open(tmp_path / "node_modules/huge.ts", "wb") as f:
        f.truncate(3 << 30)
    files, listing = scan(spark, config(tmp_path))
    got = {r.rel: r for r in with_contents(files).collect()}
    assert set(got) == {*names, *(f"many/f{i:03}.txt" for i in range(80)), "bad.txt"}
    assert all(got[n].content == f"text of {n}\n" for n in names)
    assert got["bad.txt"].content == "\ufffd" * 10 and got["bad.txt"].bytes == 30
    assert (listing.skipped, listing.binary, listing.errors, listing.truncated) == ({"empty": 1, "not-included": 1, "binary": 1}, ["bin.txt"], [], False)
    assert [r.rel for r in files.orderBy("file_ord").limit(3).collect()] == [".hidden.txt", "_private.py", "a.py"]


def test_unreadable_files_and_the_byte_cap(spark, tmp_path, monkeypatch):
    put(tmp_path, {"a.txt": "x" * 700, "b.txt": "y" * 700})
    index = RetrievalIndex(spark, config(tmp_path))
    index.build("full")
    small = RetrievalIndex(spark, config(tmp_path, max_total_bytes=1024))
    done = small.build("refresh")
    assert (done.removed, done.truncated, done.files) == (0, True, 2)
    assert RetrievalIndex(spark, config(tmp_path, max_total_bytes=1024, data_dir=str(tmp_path.parent / "other"))).build("full").truncated
    listed = workspace.list_files

    def with_a_lost_one(c):
        out = listed(c)
        out.rows.append((len(out.rows), "gone.txt", str(tmp_path / "gone.txt"), 5, 0.0, "text"))
        return out

    monkeypatch.setattr(workspace, "list_files", with_a_lost_one)
    os.unlink(tmp_path / "a.txt")
    done = index.build("refresh")
    assert done.files == 2 and done.removed == 0 and done.truncated and len(done.errors) == 1
    monkeypatch.undo()
    assert index.build("refresh").removed == 1


def test_refresh_keeps_binaries_and_what_does_not_fit(spark, tmp_path):
    put(tmp_path, {"a.txt": "alpha " * 50, "b.txt": "beta " * 50, "c.txt": "gamma " * 50})
    index = RetrievalIndex(spark, config(tmp_path, max_total_bytes=1024))
    assert index.build("full").files == 3
    put(tmp_path, {"a.txt": b"al\0pha", "b.txt": "delta " * 100})
    done = index.build("refresh")
    assert (done.updated, done.removed, done.unchanged, done.truncated) == (0, 0, 1, True)
    assert {h["file"] for h in index.search("alpha beta").hits if h["lexical_score"]} == {"a.txt", "b.txt"}


def test_budget_stops_at_the_first_file_that_does_not_fit(spark):
    rows = spark.createDataFrame([(0, 5, 0), (1, 9, 2), (2, 1, 8)], "o long, new long, old long")
    kept = [r.o for r in maintenance.within_budget(rows, 10, 20, "o", "new", "old").collect()]
    assert kept == [0]


def test_watcher_and_refresher(tmp_path):
    put(tmp_path, {"a.txt": "1", "skip/b.txt": "1"})
    calls = []
    watcher = DirWatcher(str(tmp_path), lambda: calls.append(1), ("skip",), debounce_ms=100, polling_ms=250).start()
    try:
        put(tmp_path, {"skip/b.txt": "22"})
        time.sleep(0.8)
        assert calls == [] and not watch.excluded("a.txt", ("skip",)) and watch.excluded("x/skip/y", ("skip",))
        for k in range(3):
            put(tmp_path, {"a.txt": "x" * (k + 2)})
        until = time.time() + 10
        while not calls and time.time() < until:
            time.sleep(0.05)
        time.sleep(0.6)
        assert calls == [1]
    finally:
        watcher.close()
    put(tmp_path, {"a.txt": "after"})
    watcher.fire("a.txt")
    time.sleep(0.3)
    assert calls == [1]

    seen = []
    refresher = Refresher(lambda: seen.append(len(seen)) or (refresher.ask() if len(seen) == 1 else None))
    refresher.ask()
    refresher.ask()
    assert seen == []
    refresher.ready()  # both become one, which asks once more while it runs
    assert seen == [0, 1]


def test_an_edit_gives_one_refresh(spark, tmp_path):
    put(tmp_path, {"a.txt": "first words\n"})
    index = RetrievalIndex(spark, config(tmp_path, watch_debounce_ms=100))
    watcher = index.watch(polling_ms=250)
    try:
        built = index.meta.built_at
        put(tmp_path, {"a.txt": "second words entirely\n"})
        until = time.time() + 60
        while index.meta.built_at == built and time.time() < until:
            time.sleep(0.2)
    finally:
        watcher.close()
    assert index.search("entirely").hits[0]["lexical_score"] and not index.errors


def test_debounce_as_a_stream(spark, tmp_path):
    put(tmp_path, {"in/1.json": '{"ts": "2024-01-01T00:00:00Z", "path": "a"}\n{"ts": "2024-01-01T00:00:00.1Z", "path": "x/skip/b"}\n', "in/2.json": '{"ts": "2024-01-01T00:00:00.2Z", "path": "a"}\n', "in/3.json": '{"ts": "2024-01-01T01:00:00Z", "path": "a"}\n'})
    events = spark.readStream.schema("ts timestamp, path string").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    acts = []
    sessions = watch.debounced(watch.relevant(events, ("skip",)), "300 milliseconds", late="1 second")
    query = watch.on_sessions(sessions, lambda: acts.append(1), str(tmp_path / "state"))
    query.processAllAvailable()
    query.stop()
    assert acts == [1]


def test_the_last_burst_needs_no_later_event(spark, tmp_path):
    """Two bursts by the clock; keys with null, events without a time; each is handed on while the stream has nothing more to read."""
    put(tmp_path, {"in/1.json": '{"ts": "2024-01-01T00:00:00Z", "n": "a"}\n{"ts": "2024-01-01T00:00:00.1Z", "n": "a"}\n{"ts": "2024-01-01T00:00:05Z"}\n{"n": "b"}\n'})
    events = spark.readStream.schema("ts timestamp, n string").json(str(tmp_path / "in"))
    got, acts = [], []

    def keep(batch, _):
        got.extend(tuple(r) for r in batch.selectExpr("n", "unix_millis(start)", "unix_millis(end)", "m").collect())

    at = 1_704_067_200_000
    keyed = watch.bursts(events, 500, keys=("n",)).toDF("n", "start", "end", "m").writeStream.option("checkpointLocation", str(tmp_path / "keyed")).foreachBatch(keep).start()
    whole = watch.on_sessions(watch.bursts(events, 500), lambda: acts.append(1), str(tmp_path / "whole"))
    try:
        for wanted in (1, 2):
            until = time.time() + 90
            while time.time() < until and (len(acts) < wanted or len(got) < 2 + wanted):
                time.sleep(0.2)
            assert len(acts) == wanted
            if wanted == 1:
                assert sorted(got, key=str) == sorted([("a", at, at + 100, 2), (None, at + 5000, at + 5000, 1), ("b", None, None, 1)], key=str)
                (tmp_path / "next.json").write_text('{"ts": "2024-01-01T00:00:09Z", "n": "a"}\n')
                (tmp_path / "next.json").rename(tmp_path / "in/2.json")
        assert ("a", at + 9000, at + 9000, 1) in got and len(got) == 4
    finally:
        keyed.stop()
        whole.stop()


def test_snapshot_changes(spark):
    schema = "rel string, size long, mtime_ms double"
    before = spark.createDataFrame([("a", 1, 1.0), ("b", 1, 1.0), ("c", 1, 1.0)], schema)
    after = spark.createDataFrame([("a", 1, 1.0), ("b", 2, 1.0), ("d", 1, 1.0)], schema)
    assert {r.rel: r.change for r in watch.snapshot_changes(before, after).collect()} == {"b": "updated", "c": "removed", "d": "added"}

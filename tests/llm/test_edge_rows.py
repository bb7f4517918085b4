"""Nulls, empty and long texts, repeated rows, empty tables and clashing column names."""

import hashlib

import public_tokenizers
import pytest

pytest.importorskip("quarrix.llm")
from quarrix.llm import chat, line_dedup, order_minhash, packing, quality, scratch, token_file, toxicity, unicode_bpe_dp, warc  # noqa: E402

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, source string, pos long, h1 string, bucket int, n_words string"
LONG = "word " * 30_000
ROWS = [(1, None), (2, ""), (3, "x"), (3, "x"), (None, "no id"), (4, LONG), (5, "a\n\n b \n"), (6, "😀é語 mixed\ttext"), (7, "x" * 50_000)]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame([(d, t, None, 9, "clash", 1, "z") for d, t in ROWS], SCHEMA)


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_every_row_comes_back(docs, none):
    for f in (
        lambda d: unicode_bpe_dp.round_trip_digests(d, WORD),
        lambda d: unicode_bpe_dp.encode_documents(d, WORD),
        lambda d: line_dedup.dedup_lines(d),
        lambda d: order_minhash.fingerprints(d, buckets=3),
        lambda d: quality.quality(d),
    ):
        assert f(docs).count() == len(ROWS)
        assert f(none).collect() == []


def test_packing(docs, none):
    rows = packing.pack_documents(docs, BYTE).collect()
    assert len({(r.sequence_id, r.offset) for r in rows}) == len(rows)
    assert [r.length for r in rows if r.doc_id == 1] == [1]
    assert sum(r.doc_id == 3 for r in rows) == 2
    assert packing.pack_documents(none, BYTE).collect() == []


def test_packing_in_several_tasks(spark):
    pieces = spark.range(3000).selectExpr("id AS doc_id", "0 AS piece", "0L AS start", "pmod(xxhash64(id), 1000) + 1 AS length", "id AS ids_crc32")
    rows = packing.pack_pieces(pieces, 1024, open_bins=256, pieces_per_task=500).collect()
    assert sorted(r.doc_id for r in rows) == list(range(3000))
    ends = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert ends.get(r.sequence_id, 0) == r.offset
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 1024
    # Few bins and small tasks cost more than the 0.2 % of production's parameters.
    assert len(ends) <= 1.05 * sum(r.length for r in rows) / 1024


def test_token_files(spark, docs, none):
    for d, n in ((docs, len(ROWS)), (none, 0)):
        path = scratch.new_path(spark, "test-tokens")
        token_file.write_token_files(d, path, BYTE)
        rows = token_file.read_token_files(spark, path).collect()
        assert len(rows) == n
        at = 0
        for r in sorted(rows, key=lambda r: r.start):
            assert r.start == at and r.n_tokens == len(r.ids)
            at += r.n_tokens
    path = scratch.new_path(spark, "test-tokens")
    token_file.write_token_files(docs, path, BYTE)
    picked = token_file.read_token_files(spark, path, [3, 99])
    assert [r.doc_id for r in picked.collect()] == [3, 3]
    assert "PushedFilters: [In(doc_id" in picked._jdf.queryExecution().toString() or "In(doc_id" in picked._jdf.queryExecution().toString()


def test_line_dedup_keeps_the_largest_id(spark):
    line = "  A line of more than forty characters, indeed so\t"
    rows = [(i, f"own {i}\n{line}\n{line.upper() if i % 2 else line}") for i in range(5)] + [(9, "own 9\n" + line.strip()[:39])]
    got = {r.doc_id: r for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), 40, 5).collect()}
    assert [got[i].kept for i in range(4)] == [f"own {i}" for i in range(4)]
    assert got[4].kept == rows[4][1] and got[9].n_dropped == 0 and got[0].n_dropped == 2


def test_fingerprints_of_one_and_of_equal_documents(spark):
    one = order_minhash.fingerprints(spark.createDataFrame([(1, "abc def ghi")], "doc_id long, text string")).first()
    assert one.edited_sha256 == hashlib.sha256(b"abc def abc").hexdigest() and one.near_next == 1.0
    rows = order_minhash.fingerprints(spark.createDataFrame([(i, "same words here") for i in range(7)], "doc_id long, text string")).collect()
    assert len({r.fingerprint for r in rows}) == 1 and all(r.near_next == 1.0 for r in rows)
    reverse = order_minhash.fingerprints(spark.createDataFrame([(2, "one two three four five six"), (1, "six five four three two one")], "doc_id long, text string")).collect()
    assert all(r.near_next < 1 for r in reverse)


def test_chat_escapes_and_parts(spark):
    texts = ["<|end|>\n<|start|>", r"<\|x", "</s>[INST] [/INST]", r"[\\INST]", "<<SYS>>", "", "<", "<|" * 5]
    for t in texts:
        assert chat.unescape(chat.escape(t)) == t
        assert "<|" not in chat.escape(t) and "[INST]" not in chat.escape(t)
    rows = [(1, 0, "user", t) for t in texts] + [(1, None, None, None), (None, 1, "assistant", "a<|b")]
    got = {r.conv_id: r for r in chat.read_conversations(chat.format_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    assert got[1].n_turns == len(texts) + 1
    assert got[None].loss_sha256 == hashlib.sha256(b"a<|b").hexdigest() and got[None].loss_chars == 4
    parts = [("text", "see ", None, None, None, None, None), ("image", None, "i.png", 28, 15, None, None), ("audio", None, "a.wav", None, None, 2.0, None), ("document", None, "d.pdf", None, None, None, 3)]
    df = spark.createDataFrame([(1, 0, "user", None, parts)], f"conv_id long, turn long, role string, text string, content array<{chat.PART}>")
    r = chat.format_turns(df, parts_col="content").first()
    assert r.n_expanded == 4 + 25 + 768 and [a.ref for a in r.attachments] == ["i.png", "a.wav", "d.pdf"]
    assert all(r.segment[a["at"] :].startswith(f"<|{a.kind}:") for a in r.attachments)


def test_warc(spark):
    big = "é" * 80
    rows = [(3, "u", big), (1, None, big), (1, None, big), (2, "a\r\nb", None), (None, "u", big), (4, "u", "small"), (5, "u", "small"), (6, "u", "y" * 300_000)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string")
    for frame, n in ((pages, len(rows)), (pages.where("false"), 0)):
        path = scratch.new_path(spark, "test-warc")
        warc.write_archives(warc.with_revisits(frame), path, warc.sample_dictionary(frame))
        got = warc.read_archives(spark, path).collect()
        assert len(got) == n
    assert sorted((r.page_id, r.refers_to) for r in got if r.record_type == "revisit") == []
    path = scratch.new_path(spark, "test-warc")
    warc.write_archives(warc.with_revisits(pages), path, warc.sample_dictionary(pages))
    got = warc.read_archives(spark, path).collect()
    assert [(r.page_id, r.refers_to) for r in got if r.record_type == "revisit"] == [(3, 1)]
    assert {r.payload_digest for r in got if r.page_id in (1, 3, None)} == {hashlib.sha256(big.encode()).hexdigest()}


def test_toxicity_without_labels(spark, docs, none):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labels)
    rows = toxicity.score(docs, model).collect()
    assert len(rows) == len(ROWS) and all(0 <= r.score < 0.5 and r.predicted == 0 for r in rows)
    assert toxicity.score(none, model).collect() == []
    some = spark.createDataFrame([(1, 1, None), (3, 1, 1), (3, 1, 0), (4, 1, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.score(docs, toxicity.train(docs, some)).count() == len(ROWS)


def test_pairs_of_terms_are_learned():
    """Each term alone says nothing: only the pair is toxic, which linear weights cannot tell."""
    import numpy as np

    rng = np.random.default_rng(1)
    a, b = rng.random(600) < 0.5, rng.random(600) < 0.5
    # A third term makes single terms weakly associated, as they are in texts.
    rows = [np.array([1] * int(x) + [2] * int(y) + [3], np.int64) for x, y in zip(a, b, strict=True)]
    y = (a & b).astype(float)
    model = toxicity.fit(np.concatenate(rows), np.array([len(r) for r in rows]), y, bits=4, epochs=60)
    z = model.margins(np.concatenate(rows), np.array([len(r) for r in rows]))
    assert ((z > 0) == (y > 0)).all()
    assert abs(model.factors[1] @ model.factors[2]) > 0.1


def test_pipeline_stages(spark):
    """Each stage on its own input; the columns stay those of documents."""
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = scratch.staged(stage(spark, docs, sf), "test-stage")
        assert docs.columns == corpus_pipeline.COLUMNS
        after = {r.doc_id: r for r in docs.collect()}
        assert after.keys() <= before.keys()
        assert all(r.n_chars == len(r.text) for r in after.values())
        if name == "line dedup":
            assert after.keys() == before.keys()
        else:
            assert all(before[d] == r.text for d, r in after.items())
        if name == "n-gram jaccard join":
            from test_against_brute_force import brute_components

            _, comps = brute_components(before, 5, 80, 100)
            assert after.keys() == set(comps.values())
    placed = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert {r.doc_id for r in placed} == {r.doc_id for r in docs.collect()}

"""Each query over whole small tables against a plain computation."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

pytest.importorskip("quarrix.llm")
from quarrix.llm import order_minhash, queries  # noqa: E402

SF = "/root/testdata/sf0.001"
BLANKS = " \t\n\x0b\x0c\r"


def words(text):
    out, now = [], ""
    for c in text or "":
        if c in BLANKS:
            out += [now] * bool(now)
            now = ""
        else:
            now += c
    return out + [now] * bool(now)


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


@pytest.fixture(scope="module")
def documents():
    return {r["doc_id"]: r["text"] for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()}


def tokenizer(name):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.no_truncation()
    t.no_padding()
    return t


def byte_ids(documents):
    t = tokenizer("byte_bpe_50k.json")
    return {d: np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], "<u4") for d, x in documents.items()}


def test_packing(spark, documents):
    rows = queries.op1_best_fit_packing(spark, SF).collect()
    ids, by_doc, by_seq = byte_ids(documents), defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    assert by_doc.keys() == ids.keys()
    for d, pieces in by_doc.items():
        at = 0
        for k, r in enumerate(sorted(pieces, key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, at)
            assert r.ids_crc32 == zlib.crc32(ids[d][at : at + r.length])
            assert r.length == 1024 or k == 0
            at += r.length
        assert at == len(ids[d])
        assert len(pieces) == -(-at // 1024)
    for seq in by_seq.values():
        at = 0
        for r in sorted(seq, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    assert len(by_seq) <= 1.03 * sum(map(len, ids.values())) / 1024 + 1


def test_bpe_round_trip(spark, documents):
    t = tokenizer("word_bpe_49k.json")
    got = {r.doc_id: r for r in queries.op2_bpe_round_trip(spark, SF).collect()}
    assert got.keys() == documents.keys()
    for d, x in documents.items():
        ids = t.encode(x or "", add_special_tokens=False).ids
        assert got[d].n_tokens == len(ids)
        assert got[d].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[d].decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def reached(links, nodes):
    parent = {d: d for d in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {d: root(d) for d in nodes}


def brute_components(documents, n, num, den):
    sets = {}
    for d, x in documents.items():
        w = words(lower(x or ""))
        sets[d] = {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()
    ids = sorted(sets)
    links = []
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and den * min(len(x), len(y)) >= num * max(len(x), len(y)) and den * len(x & y) >= num * len(x | y):
                links.append((a, b))
    return {d: len(s) for d, s in sets.items()}, reached(links, ids)


def test_ngram_join(spark, documents):
    sizes, comps = brute_components(documents, 4, 85, 100)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op5_ngram_jaccard_join(spark, SF).collect()}
    assert got == {d: (sizes[d], comps[d]) for d in documents}
    assert len(set(comps.values())) < len(comps)


def windows(text, k=12):
    """Every k consecutive code points; a shorter text as one."""
    return [text[i : i + k] for i in range(max(1, len(text) - k + 1))] if text else []


def brute_tuples(spark, texts, k=12, bits=5):
    """Text -> range -> hashes of its two least pairs of k-mer and occurrence, in the order of the text."""
    each = sorted({m for t in texts for m in windows(t, k)})
    low = 38 - bits
    own = dict(zip(each, [r[0] for r in spark.createDataFrame([(m,) for m in each], "m string").selectExpr("xxhash64(m) & ((1L << 38) - 1)").collect()], strict=True))
    placed = {}
    for t in texts:
        count = Counter()
        for place, m in enumerate(windows(t, k)):
            placed.setdefault(t, []).append((own[m], count[own[m]], place))
            count[own[m]] += 1
    later = sorted({(h, n) for x in placed.values() for h, n, _ in x if n})
    made = spark.createDataFrame(later, "h long, n long").selectExpr(f"xxhash64(h, n) & ((1L << {low}) - 1)").collect()
    pair = {(h, n): h >> low << low | r[0] for (h, n), r in zip(later, made, strict=True)}
    out = {}
    for t in texts:
        ranges = defaultdict(list)
        for h, n, place in placed.get(t, []):
            ranges[h >> low].append((pair.get((h, n), h), place))
        out[t] = {r: tuple(x for x, _ in sorted(sorted(found)[:2], key=lambda y: y[1])) for r, found in ranges.items()}
    return out


def test_order_minhash(spark, documents):
    got = {r.doc_id: r for r in queries.op6_order_minhash(spark, SF).collect()}
    ids = sorted(documents, reverse=True)
    assert sorted(got) == sorted(ids)
    edits = {}
    for d, after in zip(ids, [*ids[1:], ids[0]], strict=True):
        text, following = documents[d] or "", documents[after] or ""
        third = len(text) // 3
        edits[d] = text[: len(text) - third] + following[:third]
        assert got[d].n_chars == len(text)
        assert got[d].edited_sha256 == hashlib.sha256(edits[d].encode()).hexdigest()
    tuples, wanted = brute_tuples(spark, sorted({*(x or "" for x in documents.values()), *edits.values()})), []
    for d, after in zip(ids, [*ids[1:], ids[0]], strict=True):
        a = tuples[documents[d] or ""]
        for other, name in ((edits[d], "near_edited"), (documents[after] or "", "near_next")):
            b = tuples[other]
            both = a.keys() | b.keys()
            want = sum(a.get(r) == b.get(r) for r in both) / len(both) if both else 1.0
            wanted.append((got[d][name], want))
    assert np.allclose(*zip(*wanted, strict=True))
    by_text = defaultdict(set)
    for d, x in documents.items():
        by_text[x].add(got[d].fingerprint)
    assert all(len(f) == 1 for f in by_text.values())
    assert np.mean([r.near_edited for r in got.values()]) > 0.2 > np.mean([r.near_next for r in got.values()])
    assert order_minhash  # the module is what the query applies


def test_token_file(spark, documents):
    got = {r.doc_id: r for r in queries.op8_token_file(spark, SF).collect()}
    at = 0
    for d, ids in sorted(byte_ids(documents).items()):
        assert (got[d].start, got[d].n_tokens, got[d].ids_crc32) == (at, len(ids), zlib.crc32(ids))
        at += len(ids)


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["toxic"] for r in pq.read_table(f"{sf}/labels.parquet").to_pylist()}
    rows = queries.op9_toxicity(spark, sf).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    tested = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    hit = sum(p and y for p, y in tested)
    precision, recall = hit / sum(p for p, _ in tested), hit / sum(y for _, y in tested)
    print("precision", precision, "recall", recall, "of", len(tested))
    assert precision > 0.95 and recall > 0.9


def test_quality(spark, documents):
    got = {r.doc_id: r for r in queries.op10_quality_rules(spark, SF).collect()}
    rows = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    lines, texts = defaultdict(set), defaultdict(set)
    for r in rows:
        texts[r["source"]].add(r["text"])
        for line in (r["text"] or "").split("\n"):
            if key := lower(line).strip(BLANKS):
                lines[r["source"], key].add(r["text"])
    over = {k for k, x in lines.items() if len(x) >= 20}
    for r in rows:
        w, text = words(r["text"]), r["text"] or ""
        windows = defaultdict(list)
        for i in range(len(w) - 7):
            windows[tuple(w[i : i + 8])].append(i)
        repeat = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(8)}
        own = [x for x in text.split("\n") if words(x)]
        q = got[r["doc_id"]]
        assert (q.n_words, q.word_chars, q.n_repeat_words) == (len(w), sum(map(len, w)), len(repeat))
        assert q.n_symbols == sum(c in "#*$%&|<>" for c in text)
        assert q.n_dup_lines == len(own) - len(set(own))
        failed = len(w) < 20 or 100 * len(repeat) > 30 * len(w)
        rest = sum(len(words(x)) for x in text.split("\n") if (r["source"], lower(x).strip(BLANKS)) not in over)
        assert q.base_failed == failed
        assert q.kept == (not failed and (rest >= 20 or rest == len(w)))

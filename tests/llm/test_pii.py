"""Rules against their plain patterns, decoding against all segmentations, and lines that were not learned from."""

import hashlib
import itertools
import random
import re
import time

import numpy as np
import pyarrow.parquet as pq
import pytest

pytest.importorskip("quarrix.llm")
from quarrix.llm import pii, queries  # noqa: E402

SF = "/root/testdata/sf0.001"
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    out = []
    for k, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text):
            d = [int(c) for c in m[0] if c in "0123456789"]
            luhn = sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(d[::-1])) % 10 == 0
            if kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")) or kind == "card" and 12 <= len(d) <= 19 and luhn or kind == "phone" and 9 <= len(d) <= 15:
                out.append((m.start(), k, m.end(), kind))
    return [(a, b, kind) for a, _, b, kind in sorted(out)]


def test_rules_on_texts_of_their_characters():
    rng = random.Random(1)
    for alphabet in ("ab1@.-", "0123456789. -", "+1 ().-2", "a@b.@c.1+", "12.@+ (x)é語"):
        for _ in range(4000):
            text = "".join(rng.choices(alphabet, k=rng.randrange(40)))
            assert pii.base_spans(text) == plain(text), text
    card = "4111 1111 1111 1111"
    for text in (card, card + " 5", "x4111111111111111y", "000.1.2.0003", "1.2.3.256", "1.2.3.4.5.6.7.8", "+1 (017) 555-7713", "a@b.c@d.e@f.g", "@x.y@z.w", "é@b.c"):
        assert pii.base_spans(text) == plain(text)


def test_time_grows_with_the_text():
    """Runs on which plain patterns would look back over and over."""
    for text in ("1" * 200_000, "a" * 200_000, "1." * 100_000, "@a.b" * 50_000, "a@" * 100_000, "+1 " * 60_000, "(" * 100_000, " at " * 50_000, "x at y dot " * 20_000, "1 2 3 44 555 " * 8_000, "+1" + " " * 200_000):
        began = time.process_time()
        pii.all_spans(text, pii.SemiMarkovField())
        assert time.process_time() - began < 60, text[:10]


def test_decoding_and_chances_against_all_segmentations():
    rng = np.random.default_rng(3)
    lines = ["+1 (017) 555-7713 4736962573099581", "12 345 6789 0123, 4567.89", "a.b at mail dot x dot org 1.2.3.4.5", "(017) 555-7713 (018) 555-7714"]
    for text in lines:
        for island in pii.islands(pii.candidates(text)):
            island = [c for c in island if rng.random() < 14 / len(island)]
            if not island:
                continue
            lattice, scores, moves = pii._Lattice(text, island), rng.normal(0, 2, len(island)), rng.normal(0, 1, (5, 5))
            total = {}
            for r in range(len(island) + 1):
                for chosen in itertools.combinations(range(len(island)), r):
                    order = sorted(chosen, key=lambda k: island[k][0])
                    if any(island[a][1] > island[b][0] for a, b in itertools.pairwise(order)):
                        continue
                    score, label, end = 0.0, 0, None
                    for k in order:
                        between = [] if end is None else [p for p in lattice.places if end <= p <= island[k][0]]
                        near = end is not None and all(b - a <= 2 and not any(c.isalnum() for c in text[a:b]) for a, b in itertools.pairwise(between))
                        score += scores[k] + moves[label if near else 0, island[k][2]]
                        label, end = island[k][2], island[k][1]
                    total[tuple(order)] = score
            assert total[tuple(lattice.best(scores, moves))] == pytest.approx(max(total.values()))
            z = np.logaddexp.reduce(list(total.values()))
            got, chance, _ = lattice.expected(scores, moves)
            assert got == pytest.approx(z)
            assert chance == pytest.approx([sum(np.exp(s - z) for c, s in total.items() if k in c) for k in range(len(island))])


def test_lines_of_pieces_that_were_not_learned_from():
    texts = pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["text"]).column(0).to_pylist()
    known = sorted({p for t in texts for p in pii._pieces(t or "")}, key=lambda p: hashlib.sha256(str(p).encode()).hexdigest())
    model = pii.fit(pii.compose(known[::2], 1200))
    hit = missed = wrong = 0
    for text, spans in pii.compose(known[1::2], 500, seed=77):
        got = {(a, b, kind) for a, b, kind, _ in pii.all_spans(text, model)}
        hit, missed, wrong = hit + len(got & spans), missed + len(spans - got), wrong + len({s for s in got - spans if s not in pii.base_spans(text)})
    assert hit > 500 and missed <= 0.03 * hit and wrong <= 0.03 * hit
    # What the rules drop as one number too long, and a number beside it that is none.
    text = "der 7536784127813051 4845168114407329 und +1 (843) 555-7672 4736962573099581 est, no. 8643240540751637."
    assert [(text[a:b], k) for a, b, k, _ in pii.all_spans(text, model)] == [("4845168114407329", "card"), ("+1 (843) 555-7672", "phone"), ("4736962573099581", "card")]


def test_query_keeps_the_rules_spans(spark):
    texts = {r["doc_id"]: r["text"] or "" for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()}
    rows = queries.op13_personal_data(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        base = plain(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for *_, k in base) for kind in PLAIN]
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, b, k in base).encode()).hexdigest()
        all_of = [x.split(":") for x in r.spans.split(",") if x]
        assert {(int(a), int(b), k) for k, a, b in all_of} >= set(base) and len(all_of) == len(base) + r.n_added


def test_nulls_empty_tables_and_other_columns(spark):
    schema = "doc_id long, text string, spans string, kind int, start string"
    docs = spark.createDataFrame([(1, None, "x", 1, "y"), (2, "", "x", 1, "y"), (None, "a@b.cc", "x", 1, "y"), (3, "a@b.cc", "x", 1, "y"), (3, "a@b.cc", "x", 1, "y"), (4, "word " * 50_000 + "1.2.3.4", "x", 1, "y")], schema)
    got = sorted((str(r.doc_id), r.spans) for r in pii.span_digests(pii.find_spans(docs, pii.train(docs, 5, 20))).collect())
    assert got == [("1", ""), ("2", ""), ("3", "email:0:6"), ("3", "email:0:6"), ("4", "ip:250000:250007"), ("None", "email:0:6")]
    none = spark.createDataFrame([], schema)
    assert pii.find_spans(none, pii.train(none)).collect() == []
    # Without anything to learn from, the field adds nothing to the rules.
    assert pii.all_spans("7536784127813051 4845168114407329 a at b dot cc 1.2.3.4", pii.train(none)) == [(48, 55, "ip", True)]

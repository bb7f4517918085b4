"""The n-gram join on graphs that need every part of it."""

import random

import numpy as np
import pytest

pytest.importorskip("quarrix.llm")
from quarrix.llm import ngram_join  # noqa: E402
from test_against_brute_force import brute_components  # noqa: E402


def family(rng, size, words, edits):
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    out = []
    for _ in range(size):
        own = list(base)
        for _ in range(rng.randrange(edits + 1)):
            own[rng.randrange(words)] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize(("seed", "long", "part", "dense"), [(1, 3000, 2048, 4_000_000), (2, 3000, 4, 0), (3, 60, 2048, 4_000_000), (4, 30, 2048, 4_000_000), (5, 20, 16, 0)])
def test_families_passages_and_edges(spark, monkeypatch, seed, long, part, dense):
    monkeypatch.setattr(ngram_join, "_DENSE", dense)
    monkeypatch.setattr(ngram_join, "_LONG", long)
    monkeypatch.setattr(ngram_join, "_PART", part)
    rng = random.Random(seed)
    passage = " ".join(f"p{i}" for i in range(12))
    texts = family(rng, 40, 90, 8) + family(rng, 12, 40, 3) + [f"{passage} {' '.join(f'u{rng.randrange(10**6)}' for _ in range(20))}" for _ in range(40)]
    drift = [f"d{i}" for i in range(80)]  # a chain: neighbours alike, ends not
    for i in range(25):
        drift[3 * i] = f"x{i}"
        texts.append(" ".join(drift))
    texts += ["", None, "one two", "ONE  two", "a", " \t\n", "a b c d", "same text here again " * 30, "same text here again " * 30]
    rng.shuffle(texts)
    docs = dict(enumerate(texts, 10))
    frame = spark.createDataFrame([(d, t, "x") for d, t in docs.items()], "doc_id long, text string, component_id string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similar_components(frame, 4, 85, 100, bits=12).collect()}
    sizes, comps = brute_components(docs, 4, 85, 100)
    assert got == {d: (sizes[d], comps[d]) for d in docs}


def test_empty_null_and_repeated_rows(spark):
    schema = "doc_id long, text string"
    assert ngram_join.similar_components(spark.createDataFrame([], schema), 4, 85, 100, bits=10).collect() == []
    rows = [(1, "a b c d e"), (1, "a b c d e"), (None, "a b c d e"), (3, "A b c d e"), (4, None)]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.similar_components(spark.createDataFrame(rows, schema), 4, 85, 100, bits=10).collect()), key=str)
    assert got == [(1, 2, 1), (1, 2, 1), (3, 2, 1), (4, 0, 4), (None, 2, None)]


def test_sketches_never_overstate_a_difference():
    """Equal, folded and unknown widths; sets far apart are told apart."""
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[: 400 - cut], rng.integers(0, 1 << 63, more, dtype=np.uint64)])) for cut in (0, 40, 150, 400) for more in (0, 30, 130, 400)]
    sketches = [ngram_join.odd_sketch(s) for s in sets]
    assert len({len(x) for x in sketches}) > 1 and len(ngram_join.odd_sketch(base[:0])) == 8
    table = ngram_join._Sketches([*sketches, None])
    rows = np.arange(len(sets) + 1)
    for s, own in zip(sets, sketches, strict=True):
        got = table.differ(own, rows)
        want = np.array([len(np.setxor1d(s, other)) for other in sets])
        assert (got[:-1] <= want).all() and got[-1] == 0
        # The number of odd buckets that so many shingles leave on average, within four deviations.
        m = 8 * len(own)
        odd = m * (1 - (1 - 2 / m) ** want) / 2
        assert all(abs(g - e) <= 2 * m**0.5 for g, e, other in zip(got, odd, sketches, strict=False) if len(other) == len(own))
    assert not table.differ(None, rows).any()


def test_long_sets_that_meet_in_blocks_of_several_leaders(spark):
    """Half of what two long sets share is counted under one leader, half under another, in opposite order."""
    words = sorted((f"w{i}" for i in range(20_000)), key=lambda w: int(ngram_join.shingles(w, 1)[0]))
    low, middle, high = words[:921], words[921:4320], words[-1000:]
    own, common = {3: low[:320], 4: low[320:640]}, low[640:921]
    sets = {3: [*own[3], *common, *middle], 4: [*own[4], *common, *middle]}
    sets[1] = [*own[3], *common[140:], *middle, *high[:140]]
    sets[2] = [*own[4], *common[:140], *middle, *high[140:281]]
    assert {len(s) for s in sets.values()} == {4000} and 100 * len({*sets[3]} & {*sets[4]}) >= 85 * len({*sets[3]} | {*sets[4]})
    frame = spark.createDataFrame([(d, " ".join(s)) for d, s in sets.items()], "doc_id long, text string")
    for bits in (23, 12):
        got = {r.doc_id: r.component_id for r in ngram_join.similar_components(frame, 1, 85, 100, bits=bits).collect()}
        assert got == {d: 1 for d in sets}

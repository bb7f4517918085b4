"""The audit of sources against the definition, over several teams and blocks."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

pytest.importorskip("quarrix.llm")
from quarrix.llm import divergence  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, term string, block int, team int, total long"


def plain(rows, min_docs, top):
    used, df, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower)
        used[lang, source].update(found)
        df[lang].update(set(found))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in df[lang].items() if n >= min_docs]
        whole = Counter()
        for s in sources:
            whole.update(used[lang, s])

        def share(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 2) // (total + 2 * len(kept)) for t in kept}

        p, q = {s: share(used[lang, s]) for s in sources}, share(whole)
        f = lambda a, b: (a - b) * (a - b) // (a + b)
        for s in sources:
            pairs = sorted(((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in sources if o != s))
            terms = sorted((-f(p[s][t], q[t]), t.encode(), t) for t in kept if used[lang, s][t] > 0 and p[s][t] > q[t])[:top]
            for part, found in (("pair", pairs), ("term", terms)):
                out += [(lang, s, part, item, -value, rank) for rank, (value, _, item) in enumerate(found, 1)]
    return sorted(out)


def got(df):
    return sorted((r.lang, r.source, r.part, r["item"], r.value, r.rank) for r in df.collect())


def frame(spark, rows):
    return spark.createDataFrame([(1, t, lang, s, "x", 1, 2, 3) for t, lang, s in rows], SCHEMA)


@pytest.mark.parametrize(("per_team", "block_terms"), [(2, 16), (3, 1000), (50, 7)])
def test_teams_and_blocks(spark, per_team, block_terms):
    rng = random.Random(per_team)
    vocabulary = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)] + ["été", "日本語", "Ünï", "É", "STRASSE", "x" * 300]
    rows = []
    for lang, n in (("en", 11), ("de", 4), ("fr", 1), (None, 3)):
        for s in range(n):
            weights = [rng.random() ** 3 for _ in vocabulary]
            rows += [(" ".join(rng.choices(vocabulary, weights, k=rng.randrange(30))) + rng.choice(["", " 12 _!", "\n"]), lang, f"s{s}" if s else None) for _ in range(12)]
    # Sources without terms, a language without kept ones, texts without words, and copies.
    rows += [(None, "en", "silent"), ("", "en", "silent2"), ("12 34", "xx", "a"), ("alone", "xx", "b"), ("alone", "xx", "c"), *rows[:5] * 3]
    assert got(divergence.audit(frame(spark, rows), 10, 10, per_team, block_terms)) == plain(rows, 10, 10)


def test_nothing_to_audit(spark):
    assert divergence.audit(frame(spark, [])).collect() == []
    assert divergence.audit(frame(spark, [(None, None, None)])).collect() == []


def test_each_team_meets_every_other_once():
    for teams in range(2, 21, 2):
        met = [tuple(sorted((t, divergence.opponent(t, teams, step)))) for step in range(teams - 1) for t in range(teams)]
        assert all(met.count(pair) == 2 for pair in set(met))
        assert len(set(met)) == teams * (teams - 1) // 2 and all(a != b for a, b in met)


def test_vectors_and_shares_are_exact():
    for counts in ([], [1], [3, 0, 0, 5, 2**40], [0] * 70_000 + [255, 256], [2**20] * 300):
        counts = np.array(counts, np.int64)
        at = np.flatnonzero(counts)
        assert (divergence.unpacked_vector(divergence.packed_vector(at, counts[at]), len(counts)) == counts).all()
    assert (divergence.unpacked_vector(None, 3) == 0).all()
    for total in (5, 10**6, 10**14):
        counts = [0, 1, 5, total // 3, total]
        assert divergence.shares(np.array(counts), total, 7).tolist() == [1 + 10**9 * (c + 2) // (total + 14) for c in counts]

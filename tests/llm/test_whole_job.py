"""Cases in which a part of an operator's job would go unseen on the given tables."""

import random
import string

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("quarrix.llm")
from quarrix.llm import line_dedup, order_minhash, quality, toxicity  # noqa: E402
from test_against_brute_force import brute_tuples  # noqa: E402


def own(i, n=25):
    return " ".join(f"own{i}x{k}" for k in range(n))


def test_quality_limit_does_not_grow_with_the_host(spark):
    """A line in 20 of a host's 220 texts is over the limit; in 19, or in 10 of each of two hosts, it is not."""
    rows = [(i, f"{own('over', 15)}\n{own(i, 10)}", "big") for i in range(20)]
    rows += [(100 + i, f"{own('rare', 15)}\n{own(100 + i, 10)}", "big") for i in range(19)]
    rows += [(200 + i, f"{own('shared', 15)}\n{own(200 + i, 10)}", "big" if i % 2 else "other") for i in range(20)]
    rows += [(1000 + i, own(1000 + i), "big") for i in range(171)]
    got = {r.doc_id: r for r in quality.quality(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert not any(r.base_failed for r in got.values())
    assert {d for d, r in got.items() if not r.kept} == set(range(20))


def test_quality_removes_lines_over_the_limit(spark):
    """Short boilerplate goes from the text, from every copy and with its blanks; the pipeline's stage hands that text on."""
    import corpus_pipeline

    rows = [(i, f"{own(i)}\n  Accept ALL cookies\t\n\n{own(i, 3)}\naccept all Cookies", "en", "h", 0) for i in range(20)]
    rows += [(50, rows[0][1], "en", "h", 0), (51, rows[0][1], "en", "other", 0), (52, None, "en", "h", 0), (53, own(53), "en", "h", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    want = {d: f"{own(d % 50)}\n\n{own(d % 50, 3)}" if d <= 50 else t for d, t, *_ in rows}
    got = {r.doc_id: r for r in quality.quality(docs, carry=["lang"]).collect()}
    assert {d: r.cleaned for d, r in got.items()} == want
    assert {d: r.n_removed for d, r in got.items()} == {d: 2 * (d <= 50) for d in want}
    stage = corpus_pipeline.quality_rules(spark, docs, "").collect()
    assert {r.doc_id: (r.text, r.n_chars) for r in stage} == {d: (t, len(t)) for d, t in want.items() if t}


def test_fingerprint_survives_an_insertion_at_the_front(spark):
    """Texts without blanks keep nearly all k-mers, and so most tuples, when one character is put before them."""
    rng = random.Random(5)
    blob, cjk = ("".join(rng.choices(x, k=5000)) for x in (string.ascii_letters + string.digits, [chr(c) for c in range(0x4E00, 0x5E00)]))
    texts = [(x, f"{front}{x}") for x in (blob, cjk, f"some words and {blob} more") for front in ("y", "😀")]
    rows = spark.createDataFrame(texts, "a string, b string")
    sig = order_minhash.signatures
    got = [r[0] for r in rows.select(order_minhash.likeness(sig(F.col("a")), sig(F.col("b")))).collect()]
    assert len(got) == len(texts) and min(got) >= 0.8


def test_pipeline_judges_rows_not_ids(spark, tmp_path):
    """Null and repeated ids: each row goes or stays by its own verdict."""
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    good, bad = own("good"), "too short"
    rows = [(None, good), (None, bad), (7, good), (7, bad), (8, own("other"))]
    docs = spark.createDataFrame([(d, t, "en", "h", len(t)) for d, t in rows], schema)
    kept = corpus_pipeline.quality_rules(spark, docs, "").collect()
    assert sorted((str(r.doc_id), r.text) for r in kept) == sorted((str(d), t) for d, t in rows if t != bad)

    learned = [(100 + i, f"{'vile ugly' if i % 2 else 'kind fair'} word {i}") for i in range(200)]
    rows = [(None, "kind fair one"), (None, "vile ugly one"), (9, "kind fair two"), (9, "vile ugly two")]
    spark.createDataFrame([(100 + i, i % 2, i % 2) for i in range(200)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.createDataFrame([(d, t, "en", "h", len(t)) for d, t in learned + rows], schema)
    done = corpus_pipeline.without_toxic(spark, docs, str(tmp_path))
    assert done.columns == corpus_pipeline.COLUMNS
    assert sorted((str(r.doc_id), r.text, r.lang, r.source, r.n_chars) for r in done.collect()) == sorted((str(d), t, "en", "h", len(t)) for d, t in learned + rows if "vile" not in t)


def test_line_dedup_of_rows_that_share_an_id(spark):
    """Each row of an id loses the common lines of its own text, wherever they stand in the others; equal rows lose the same."""
    common = "A line of more than forty characters that many share"
    rows = [(3, f"{common}\nunique A"), (3, f"unique B\n{common}"), (3, f"unique B\n{common}"), (None, common), *[(10 + i, common) for i in range(5)]]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), 40, 5).collect()
    assert sorted((r.kept, r.n_dropped) for r in got if r.doc_id == 3) == [("unique A", 1), ("unique B", 1), ("unique B", 1)]
    assert {r.doc_id: r.kept for r in got if r.doc_id != 3} == {None: common, 10: "", 11: "", 12: "", 13: "", 14: common}


def test_fingerprint_sees_every_window(spark):
    """A range for nearly each hash tells which k-mers were looked at; the tuples of 32 ranges follow from all pairs of k-mer and occurrence."""
    rng = random.Random(9)
    texts = ["", " ", "abc", "ab  cd\n", "x" * 12, "x" * 13, "x" * 900, "abcd efgh ijkl mnop", " a b\n\nc\td e f g h i j ", "語" * 5 + " 0123456789é😀😀 z", "one two three " * 30, "".join(rng.choices("ab ", k=3000)), "".join(rng.choices(string.ascii_letters, k=2500)) * 2, "ab" * 700 + "".join(rng.choices(string.digits, k=500))]
    sig = order_minhash.signatures
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", sig(F.col("t"), range_bits=20).alias("fine"), sig(F.col("t")).alias("s")).collect()
    tuples = brute_tuples(spark, texts)
    found = sorted({x for t in tuples.values() for x in t.values()})
    hashed = {}
    for n in (1, 2):
        some = [x for x in found if len(x) == n]
        made = spark.createDataFrame(some, ", ".join(f"c{i} long" for i in range(n))).selectExpr(f"xxhash64({', '.join(f'c{i}' for i in range(n))}) & 4294967295L").collect()
        hashed |= dict(zip(some, [r[0] for r in made], strict=True))
    fine = brute_tuples(spark, texts, bits=20)
    for r in rows:
        assert {x >> 32 for x in r.fine} == set(fine[r.t])
        assert sorted(r.s) == sorted(number << 32 | hashed[x] for number, x in tuples[r.t].items())


def test_fingerprint_of_doubled_sentences_knows_their_order(spark):
    """Sentences that stand twice are no nearer to another order of them than sentences that stand once."""
    rng = random.Random(1)
    sentences = [" ".join(f"{rng.choice(['alpha', 'beta', 'gamma', 'delta', 'omega'])}{rng.randrange(1000)}" for _ in range(8)) + "." for _ in range(40)]

    def shuffled(x):
        return " ".join(rng.sample(x, len(x)))

    rows = spark.createDataFrame([(shuffled(sentences), shuffled(sentences), shuffled(sentences * 2), shuffled(sentences * 2)) for _ in range(20)], "a string, b string, c string, d string")
    sig = order_minhash.signatures
    once, twice = rows.select(*(F.avg(order_minhash.likeness(sig(F.col(x)), sig(F.col(y)))).alias(x) for x, y in ("ab", "cd"))).first()
    assert once < 0.6 and twice < once + 0.15


def test_fingerprint_tells_changes_inside_words(spark):
    """Texts whose words have equal beginnings and texts with other blanks differ in k-mers that no word begins."""
    a = " ".join(f"{i:04d}abcdefgh{i % 7}" for i in range(300))
    rows = spark.createDataFrame([(a, a.replace(" ", "  ", 1)), ("  " + a, a)], "a string, b string")
    sig = order_minhash.signatures
    got = [r[0] for r in rows.select(order_minhash.likeness(sig(F.col("a")), sig(F.col("b")))).collect()]
    assert min(got) > 0.8
    lead = spark.createDataFrame([("  ab cd ef gh ij", "ab cd ef gh ij")], "a string, b string")
    assert lead.select(order_minhash.likeness(sig(F.col("a")), sig(F.col("b")))).first()[0] < 1


def test_toxicity_learns_pairs_of_words_that_are_neutral_alone(spark):
    """Either word alone is toxic, both or none is not: no word is associated with the label; registered parameters."""
    rng = random.Random(3)
    filler, rows = [f"word{a}{b}" for a in "abcdefghijklm" for b in "nopqrstuvwxyz"], []
    for i in range(4000):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        rows.append((i, " ".join(rng.sample([*rng.choices(filler, k=10), *["snarl"] * a, *["group"] * b], 10 + a + b)), int(a != b)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"))
    got = toxicity.score(docs, model).join(docs.select("doc_id", "toxic"), "doc_id").where("held_out").selectExpr("avg(if(predicted = toxic, 1, 0))").first()[0]
    assert got > 0.99
    # Labels other than 0 and 1 are not learned from, here the same ones made a third value.
    odd = docs.selectExpr("doc_id", "if(toxic = 1, 2, 0) AS toxic")
    assert toxicity.labelled_terms(docs.select("doc_id", "text"), odd, 1000, 12).column("toxic").to_pylist() == [0] * 500


def test_near_pairs_are_all_within_the_distance():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 40, 200):
        words, open_ = rng.integers(0, 50, n), rng.random(50) < 0.5
        want = {tuple(sorted((int(words[i]), int(words[j])))) for i in range(n) for j in range(i + 1, min(n, i + toxicity.NEAR + 1)) if open_[words[i]] and open_[words[j]] and words[i] != words[j]}
        _, a, b = toxicity.near_pairs(words, open_)
        assert set(zip(a.tolist(), b.tolist(), strict=True)) == want and len(a) == len(want)


def test_line_counts_without_ansi_mode(spark):
    before = spark.conf.get("spark.sql.ansi.enabled")
    try:
        spark.conf.set("spark.sql.ansi.enabled", "false")
        common = "A line of more than forty characters that many share"
        rows = [(1, "one\ntwo"), (2, None), *[(10 + i, common) for i in range(5)]]
        got = {r.doc_id: (r.n_lines, r.n_dropped) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), 40, 5).collect()}
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)
    assert got == {1: (2, 0), 2: (1, 0), 10: (1, 1), 11: (1, 1), 12: (1, 1), 13: (1, 1), 14: (1, 0)}


def test_quality_needs_the_column_of_hosts(spark):
    docs = spark.createDataFrame([(i, f"{own('over', 15)}\n{own(i, 10)}") for i in range(20)], "doc_id long, text string")
    with pytest.raises(ValueError, match="source"):
        quality.quality(docs)
    assert not any(r.kept for r in quality.quality(docs, host_col=None).collect())

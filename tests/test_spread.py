"""Texts are dealt out before they are cut; lengths without a row for each token; products of packed rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrix.functions import text as T
from quarrix.operators import batch, stats

ROWS = [(1, "getHTTPUrl2 x_y x"), (1, "x 语义搜索"), (2, ""), (3, None), (None, "a b a"), (4, "Kelvin İstanbul café aB"), (5, "..."), (6, " lead")]


@pytest.fixture(scope="module")
def units(spark):
    return spark.createDataFrame(ROWS, "unit_id long, text string")


def test_texts_move_before_they_are_cut_and_counts_do_not(units):
    plan = stats.term_frequencies(units)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.index("Generate") < plan.index("Exchange")
    plan = stats.token_lengths(units)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Generate" not in plan


def test_lengths_and_totals_are_those_of_the_terms(units):
    tf = stats.term_frequencies(units)
    lengths = stats.token_lengths(units)
    assert sorted(map(tuple, lengths.collect()), key=str) == sorted(map(tuple, stats.doc_lengths(tf).collect()), key=str)
    assert stats.corpus_row_of_lengths(units, lengths).first() == stats.corpus_row(units, tf).first()
    assert stats.corpus_row_of_lengths(units.limit(0), stats.token_lengths(units.limit(0))).first() == (0, 0, 0.0)


def test_letters_with_ascii_lower_case_are_boundaries(units):
    found = {r.text: r.t for r in units.select("text", T.tokenize(F.col("text")).alias("t")).collect()}
    assert found[ROWS[5][1]] == ["elvin", "stanbul", "caf", "a", "b"]
    assert found["..."] == found[""] == found[None] == [] and found[" lead"] == ["lead"]


@pytest.mark.parametrize("dense", [0.0, 0.3, 9.0])
def test_products_of_frequent_and_rare_keys(monkeypatch, dense):
    monkeypatch.setattr(batch, "DENSE", dense)
    monkeypatch.setattr(batch, "WIDE", 3)
    monkeypatch.setattr(batch, "EXPANDED", 7)
    rng = np.random.default_rng(5)
    u, q = rng.integers(0, 4, (30, 11)) * (rng.random((30, 11)) < rng.random(11)), rng.integers(0, 4, (9, 11)) * (rng.random((9, 11)) < 0.5)
    (owner, key), (at, theirs) = np.nonzero(u), np.nonzero(q)
    product = batch.Product(9, at, theirs, q[at, theirs].astype(float), 11)
    assert (product.scores(30, owner, key, u[owner, key].astype(float)) == u @ q.T).all()


def test_weights_that_are_not_finite_stay_with_their_key(spark):
    e = spark.createDataFrame([(1, "a", float("inf")), (1, "b", 1.0), (2, "b", 2.0)], "unit_id long, key string, w double")
    asked = spark.createDataFrame([(10, "a", 1.0), (11, "b", 1.0)], "query_id long, key string, qw double")
    assert sorted(map(tuple, batch.sparse_top(e, asked, 5).collect())) == [(11, 1, 1.0, 2), (11, 2, 2.0, 1)]

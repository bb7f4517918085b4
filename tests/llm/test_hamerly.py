"""Clusters by bounds are those of plain rounds in integers."""

import hashlib
import math

import numpy as np
import pytest

pytest.importorskip("quarrix.llm")
from quarrix.llm import hamerly  # noqa: E402

SCHEMA = "vec_id long, embedding array<float>, cluster string, v int, before int"


def plain(rows, k, rounds, width):
    """``rows`` of (id, components): the definition, one vector after the other."""
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    centroids = [list(v) for _, v in first]

    def nearest(v):
        return min(range(len(centroids)), key=lambda c: (sum((a - b) ** 2 for a, b in zip(v, centroids[c], strict=True)), c))

    for _ in range(rounds):
        at = [nearest(v) for _, v in kept]
        for c in range(len(centroids)):
            own = [v for (_, v), x in zip(kept, at, strict=True) if x == c]
            if own:
                centroids[c] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    out = []
    for i, v in kept:
        c = nearest(v)
        out.append((i, c, sum((a - b) ** 2 for a, b in zip(v, centroids[c], strict=True)), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()))
    total = sum(d for _, _, d, _ in out)
    return [(i, c, d, sum(x[2] for x in out if x[1] == c), total, h) for i, c, d, h in out]


def got(df):
    return sorted(((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in df.collect()), key=str)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", 9, 1) for i, v in rows], SCHEMA)


def test_clusters_with_ties_nulls_and_copies(spark):
    rng = np.random.default_rng(2)
    near = [(i, [float(np.float32(x)) for x in rng.normal(i % 5, 0.3, 4)]) for i in range(300)]
    rows = [*near, *near[:40], (None, near[3][1]), (7, near[8][1]), *[(1000 + i, [0.5, 0.5, 0.5, 0.5]) for i in range(30)], *[(2000 + i, [float(i % 2), 0.0, 0.0, 0.0]) for i in range(20)]]
    odd = [(1, None), (2, []), (3, [1.0]), (4, [1.0, None, 1.0, 1.0]), (5, [1.0, float("nan"), 1.0, 1.0]), (6, [1.0, float("inf"), 1.0, 1.0]), (7, [1.0] * 5)]
    found = hamerly.cluster_vectors(frame(spark, rows + odd), 8, 10, 3, 4).persist()
    assert got(found) == sorted(plain(rows + odd, 8, 10, 4), key=str)
    scans = [r.full_scans for r in found.collect()]
    assert 1 <= min(scans) and sum(scans) < 0.6 * 11 * len(scans)  # the bounds spare most scans


def test_few_vectors_or_none(spark):
    assert hamerly.cluster_vectors(frame(spark, []), width=4).collect() == []
    assert hamerly.cluster_vectors(frame(spark, [(1, [1.0])]), width=4).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "full_scans"]
    for rows in ([(5, [0.1, -0.2, 0.3, -0.4])], [(i, [0.25, -0.5, 1.0, 2.0]) for i in range(12)], [(i, [i / 7, -i / 3, 0.0, 1.0]) for i in range(5)]):
        assert got(hamerly.cluster_vectors(frame(spark, rows), width=4)) == sorted(plain(rows, 8, 10, 4), key=str)


def test_components_too_large_for_exact_distances_are_left_out(spark):
    rows = [(1, [131072.0, -131072.0, 0.0, 0.0]), (2, [131073.0, 0.0, 0.0, 0.0]), (3, [-3e38, 0.0, 0.0, 0.0]), (4, [-131072.0, 131072.0, 0.0, 0.0])]
    assert got(hamerly.cluster_vectors(frame(spark, rows), 1, 10, 3, 4)) == sorted(plain([rows[0], rows[3]], 1, 10, 4), key=str)


def test_bounds_prove_what_they_spare():
    """Against a full scan in every round, with centroids that jump about."""
    rng = np.random.default_rng(4)
    v = rng.integers(-2000, 2000, (500, 6))
    c = rng.integers(-2000, 2000, (5, 6))
    cluster, upper, lower = np.full(500, -1), np.zeros(500), np.zeros(500)
    drift, spared = np.zeros(5), 0
    for scale in (0, 1000, 300, 30, 30, 3, 3, 0):
        moved = c + rng.integers(-scale, scale + 1, c.shape) * (rng.random((5, 1)) < 0.6)
        drift = np.sqrt(((moved - c) ** 2).sum(1)) * (1 + 1e-9)
        c = moved
        cluster, upper, lower, scanned = hamerly.assign_batch(v, cluster, upper, lower, c, hamerly._gaps(c), drift)
        assert (cluster == hamerly.distances(v, c).argmin(1)).all()
        spared += (~scanned).sum()
    assert spared > 500


def test_query_has_the_columns_and_rows_of_its_sql(spark, sf_dir="/root/testdata/sf0.001"):
    duckdb = pytest.importorskip("duckdb")
    queries = pytest.importorskip("quarrix.llm.queries")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    want = con.sql(queries.ORACLE_SQL["op12_hamerly_clusters"])
    found = queries.op12_hamerly_clusters(spark, sf_dir)
    assert found.columns == want.columns
    assert sorted(map(tuple, found.collect())) == sorted(want.fetchall())

"""Neighbour graphs against brute force, and the layout's trustworthiness."""

import os

import numpy as np
import pytest

from alembiq.operators import neighbours as N


def table(spark, x):
    return spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())] + [(10**6, None)], "id long, v array<double>").repartition(4)


def recall(edges, x, k):
    d = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    np.fill_diagonal(d, np.inf)
    want = np.argsort(d, axis=1)[:, :k]
    got = {}
    for r in edges:
        got.setdefault(r["a"], []).append((r["d"], r["b"]))
    hits = sum(len({b for _, b in sorted(got.get(i, []))[:k]} & set(want[i].tolist())) for i in range(len(x)))
    return hits / want.size


def clusters(n, seed):
    r = np.random.default_rng(seed)
    centre = r.normal(size=(6, 16)) * 6
    of = r.integers(0, 6, n)
    return centre[of] + r.normal(size=(n, 16)), of


def test_recall_of_the_graph(spark):
    x, _ = clusters(900, 1)
    edges = N.neighbour_graph(table(spark, x), "v", k=15, rounds=3).collect()
    assert recall(edges, x, 10) >= 0.95
    assert all(r["a"] != r["b"] for r in edges) and len({(r["a"], r["b"]) for r in edges}) == len(edges)
    assert all(abs(r["d"] - np.linalg.norm(x[r["a"]] - x[r["b"]])) < 1e-6 for r in edges)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test tables")
def test_recall_on_embeddings(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    x = np.array([r["embedding"] for r in df.orderBy("vec_id").collect()], float)
    edges = N.neighbour_graph(df, "embedding", k=20, rounds=5, id_="vec_id").collect()
    assert recall(edges, x, 10) >= 0.9


def test_layout_keeps_neighbours(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK_POINTS", 200)
    x, of = clusters(500, 2)
    df = table(spark, x)
    places = N.layout(df, "v", N.neighbour_graph(df, "v", k=12, rounds=2), rounds=8)
    rows = {r["id"]: (r["x"], r["y"]) for r in places.collect()}
    assert sorted(rows) == list(range(500))
    p = np.array([rows[i] for i in range(500)])
    mean, axes, _ = N.principal_axes(df.where("v IS NOT NULL"), "v", 2)
    flat = (x - mean) @ axes
    assert np.isfinite(p).all() and N.trustworthiness(x, p) > max(0.9, N.trustworthiness(x, flat))
    d = ((p[:, None] - p[None]) ** 2).sum(axis=2)
    np.fill_diagonal(d, np.inf)
    assert np.mean(of[d.argmin(axis=1)] == of) > 0.95


def test_little_and_equal_rows(spark):
    df = table(spark, np.ones((80, 3)))
    edges = N.neighbour_graph(df, "v", k=5, rounds=1)
    assert edges.groupBy("a").count().where("count = 5").count() == 80
    assert np.isfinite([v for r in N.layout(df, "v", edges, rounds=2).collect() for v in (r["x"], r["y"])]).all()
    for rows in (df.limit(0), df.where("id = 3")):
        assert N.neighbour_graph(rows, "v").collect() == []
    assert N.layout(df.limit(0), "v", edges).collect() == []
    assert N.layout(df.where("id = 3"), "v", edges.limit(0), rounds=1).count() == 1


def test_only_pairs_as_near_as_the_farthest_neighbour_leave_a_list():
    """Failed before: every list gave all its pairs, of which later rounds keep few."""
    import pyarrow as pa

    x = np.random.default_rng(1).normal(size=(30, 4))
    t = pa.table({"id": pa.array(range(30)), "v": pa.array(x.tolist())})
    every = N._best_pairs(t, 5).to_pandas()
    far = np.linspace(0.5, 1.5, 30)
    near = N._best_pairs(t.append_column("far", pa.array(far)), 5).to_pandas()
    want = every[every["d"] <= far[every["a"]]].reset_index(drop=True)
    assert 0 < len(near) < len(every) and near.equals(want)

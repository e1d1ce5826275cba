import numpy as np
import pytest

from alembiq.operators import conformers as Y

SCHEMA = "mol int, conf int, energy double, coords array<struct<x:double,y:double,z:double>>"


def turned(points, seed):
    r = np.random.default_rng(seed)
    q, _ = np.linalg.qr(r.normal(size=(3, 3)))
    q *= np.sign(np.linalg.det(q))
    return points @ q + r.normal(size=3)


def rows(spark, items):
    return spark.createDataFrame([(m, c, e, [tuple(map(float, p)) for p in pts]) for m, c, e, pts in items], SCHEMA)


def test_superposition():
    p = np.random.default_rng(1).normal(size=(12, 3))
    assert Y.superposed_rmsd(p, turned(p, 2)) == pytest.approx(0, abs=1e-6)
    mirror = p * [1, 1, -1]
    assert Y.superposed_rmsd(p, mirror) > 0.1


def test_energies_and_pruning(spark):
    p = np.random.default_rng(1).normal(size=(8, 3)) * 3
    q = p + np.random.default_rng(4).normal(size=(8, 3)) * 2
    df = rows(spark, [(1, 0, -3.0, p), (1, 1, -5.0, turned(p, 3)), (1, 2, float("inf"), q), (2, 0, 1.0, q)])
    assert sorted((r["mol"], r["conf"]) for r in Y.pruned(df).collect()) == [(1, 0), (1, 2), (2, 0)]
    assert {(r["mol"], r["best_conformer_id"], r["n_conformers"]) for r in Y.lowest(df).collect()} == {(1, 1, 3), (2, 0, 1)}
    assert {(r["mol"], r["conf"]): r["strain"] for r in Y.with_strain(df).collect()} == {(1, 0): 2.0, (1, 1): 0.0, (1, 2): None, (2, 0): 0.0}
    near = {(r["mol"], r["conf"]): r["rmsd"] for r in Y.rmsd_to(df, [tuple(x) for x in p]).collect()}
    assert near[1, 1] == pytest.approx(0, abs=1e-6) and near[2, 0] > 0.5


def test_geometry_checks(spark):
    df = rows(spark, [(1, 0, 0.0, [(0, 0, 0), (1.5, 0, 0), (0.1, 0, 0)]), (2, 0, 0.0, [(0, 0, 0), (1, 1, 1)])])
    out = {r["mol"]: (r["is_flat"], r["n_clashes"]) for r in Y.geometry_checks(df).collect()}
    assert out == {1: (True, 1), 2: (False, 0)}


def test_shape(spark):
    df = spark.createDataFrame([(0.4, 3.0), (0.9, 0.2)], "shape_tanimoto double, pharm double")
    assert Y.screen_by_shape(df).count() == 1
    assert [r[0] for r in df.select(Y.combo_score(df["shape_tanimoto"], df["pharm"])).collect()] == pytest.approx([0.7, 0.55])
    with pytest.raises(ValueError):
        Y.screen_by_shape(df, "protrusion")

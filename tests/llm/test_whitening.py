import numpy as np
import pytest

from alembiq.llm import whitening as W


def table(spark, vectors):
    return spark.createDataFrame([(i, v, "clash", "clash", "clash") for i, v in enumerate(vectors)], "vec_id long, embedding array<float>, x string, row string, z string")


def op13(spark, tmp_path, vectors):
    table(spark, vectors).repartition(5).write.parquet(f"{tmp_path}/embeddings.parquet")
    return W.op13_whitening(spark, str(tmp_path)).collect()


def brute(vectors):
    """Mean, covariance and components from exact whole numbers."""
    x = np.array([[int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v] for v in vectors], dtype=object)
    once = np.array(sorted({tuple(r) for r in x}), dtype=object)
    n, s = len(once), once.sum(axis=0)
    centred = (once * n - s).astype(float) / n
    e, axes = np.linalg.eigh(centred.T @ centred / n)
    return x, n, s, e[::-1], axes[:, ::-1]


@pytest.mark.parametrize("fan", [2, 8])
def test_equals_the_covariance_of_distinct_vectors(spark, tmp_path, monkeypatch, fan):
    monkeypatch.setattr(W, "FAN", fan)
    monkeypatch.setattr(W, "BLOCK", 7)
    r = np.random.default_rng(1)
    vectors = (r.normal(size=(120, 20)) * np.linspace(5, 0.5, 20) + 300).tolist()
    vectors += vectors[:40] + [vectors[0]] * 100
    x, n, s, e, axes = brute(vectors)
    rows = op13(spark, tmp_path, vectors)
    assert len(rows) == len(vectors) * 16
    for row in rows:
        k = row["component"] - 1
        assert row["n"] == n == 120 and row["deviation"] == sum(int(v) ** 2 for v in x[row["vec_id"]] * n - s)
        want = float(((x[row["vec_id"]] * n - s).astype(float) / n) @ axes[:, k] / np.sqrt(e[k]))
        assert abs(abs(row["whitened"]) - abs(want)) < 1e-8
        assert abs(row["explained"] - e[k] / e.sum()) < 1e-12 and 0 <= row["identity_error"] < 1e-9
    signs = {}
    for row in rows:
        k = row["component"] - 1
        want = float(((x[row["vec_id"]] * n - s).astype(float) / n) @ axes[:, k])
        if abs(want) > 1e-6:
            signs.setdefault(k, set()).add(np.sign(want) == np.sign(row["whitened"]))
    assert all(len(v) == 1 for v in signs.values())


def test_merging_keeps_every_dimension_and_a_large_offset_costs_no_digits():
    r = np.random.default_rng(2)
    rows = r.integers(-40, 40, size=(300, 12)).astype(float)
    parts = [W.State.of(p + 1e6) for p in np.array_split(rows, [1, 2, 50, 299])]
    whole = W.merged(parts)
    centred = rows - rows.mean(axis=0)
    assert whole.n == 300 and len(whole.scale) == 12
    assert np.abs(whole.covariance() - centred.T @ centred / 300).max() < 1e-8
    backwards = W.merged(reversed(parts))
    assert np.allclose(backwards.scale, whole.scale, rtol=1e-9)


def test_broken_vectors_are_dropped_and_ids_may_be_null(spark):
    nan, inf = float("nan"), float("inf")
    df = table(spark, [[1.0, 2.0], None, [], [nan, 1.0], [1.0, inf], [None, 1.0], [1.0, 2.0, 3.0], [3.0, 1.0], [1e30, 0.0]])
    assert [r["vec_id"] for r in W.usable(df, "embedding").collect()] == [0, 7]


def test_components_without_variance_are_left_out(spark, tmp_path):
    rows = op13(spark, tmp_path, [[1.0, 2.0, 5.0], [3.0, 2.0, 5.0], [9.0, 2.0, 5.0], [9.0, 2.0, 5.0]])
    assert {r["component"] for r in rows} == {1} and len(rows) == 4 and rows[0]["explained"] == 1.0


@pytest.mark.parametrize("vectors", [[], [None], [[1.0, 2.0]], [[1.0, 2.0]] * 5])
def test_without_two_different_vectors_there_is_no_row(spark, tmp_path, vectors):
    assert op13(spark, tmp_path, vectors) == []


def test_transform_keeps_columns_of_any_name(spark):
    df = table(spark, [[1.0, 2.0], [3.0, 5.0], [0.0, 4.0]])
    found, error = W.fit(df, "embedding", 1)
    out = found.transform(df, "embedding").collect()
    assert out[0]["z"] == "clash" and len(out[0]["whitened"]) == 1 and error < 1e-12
    assert abs(sum(r["whitened"][0] for r in out)) < 1e-9


def test_a_deviation_beyond_64_bits_raises(spark):
    w = W.Whitening(1 << 40, np.zeros(1), np.zeros(1), np.ones((1, 1)), np.ones(1), 1.0)
    with pytest.raises(OverflowError):
        w._deviation(np.array([[1e6]]))

"""Pairs counted and found in blocks of packed fingerprints, against all pairs."""

import itertools
import random

import pytest

from alembiq.operators import pairs as P


def like(a, b):
    c, u = sum((x & y).bit_count() for x, y in zip(a, b)), sum((x | y).bit_count() for x, y in zip(a, b))
    return c / u if u else 0.0


def made(spark, n, words=1):
    r = random.Random(n)
    rows = [[r.getrandbits(62) & r.getrandbits(62) for _ in range(words)] for _ in range(n)]
    rows += rows[: n // 5] + [[0] * words]
    return rows, spark.createDataFrame(list(enumerate(rows)), "id long, fp array<long>")


@pytest.mark.parametrize("size", [7, 8192])
def test_similar_pairs_are_counted_without_a_row_for_each(spark, monkeypatch, size):
    """Failed before: the statistics of similar pairs were made of the pairs, one row each."""
    monkeypatch.setattr(P, "BLOCK_ROWS", size)
    rows, df = made(spark, 60, 2)
    for t in (0.0, 0.2, 0.35):
        s = sorted(x for a, b in itertools.combinations(rows, 2) if (x := like(a, b)) >= t)
        out = P.all_pairs_diversity(df, words=2, threshold=t)
        got = out.first()
        assert got["n_pairs"] == len(s) and got["mean"] == pytest.approx(sum(s) / len(s)) and (got["min"], got["max"]) == (s[0], s[-1])
        assert got["median"] == pytest.approx((s[(len(s) - 1) // 2] + s[len(s) // 2]) / 2)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_dense_pairs_are_compared_in_blocks(spark, monkeypatch):
    """Failed before: rows of a band of set-bit counts were joined one by one."""
    monkeypatch.setattr(P, "BLOCK_ROWS", 9)
    rows, df = made(spark, 50)
    want = {(i, j): s for (i, a), (j, b) in itertools.combinations(enumerate(rows), 2) if (s := like(a, b)) >= 0.3}
    assert {(r["a"], r["b"]): r["similarity"] for r in P.similarity_pairs(df, 0.3).collect()} == pytest.approx(want)
    plan = P.similarity_classes(df, 0.3)[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan


@pytest.mark.parametrize("metric", ["tanimoto", "dice", "cosine"])
@pytest.mark.parametrize("how", ["max", "mean"])
def test_many_references_meet_rows_in_blocks(spark, monkeypatch, metric, how):
    """Failed before: up to 20,000 references were broadcast and met each row in the task that read it."""
    monkeypatch.setattr(P, "BLOCK_ROWS", 100)
    rows, df = made(spark, 260)
    df = df.unionByName(spark.createDataFrame([(1000, None)], df.schema))
    refs = df.where("id < 257")
    out = P.screen_similarity(df, refs, 0.0, metric, how)
    assert "FlatMapGroupsInArrow" in out._jdf.queryExecution().optimizedPlan().toString()
    got = {r["id"]: r["similarity"] for r in out.collect()}
    monkeypatch.setattr(P, "BROADCAST_ROWS", 1000)
    assert got == pytest.approx({r["id"]: r["similarity"] for r in P.screen_similarity(df, refs, 0.0, metric, how).collect()})
    assert len(got) == len(rows) + 1


def test_of_many_queries_only_the_best_leave_a_pair_of_blocks(spark, monkeypatch):
    """Failed before: up to 10,000 queries were broadcast, and all their pairs with the partitions were sorted."""
    from alembiq.operators import search

    monkeypatch.setattr(search, "BLOCK_ROWS", 64)
    r = random.Random(5)
    rows = [[sum(1 << b for b in r.sample(range(20), 8 if i % 10 else 9))] for i in range(200)]
    df = spark.createDataFrame(list(enumerate(rows)), "id long, fp array<long>")
    index = search.Index(spark, search.write_index(df, words=1), 1)
    seen = []
    monkeypatch.setattr(search, "best", lambda found, k, best=search.best: seen.append(found.count()) or best(found, k))
    got = {(x["q"], x["place"]): (x["id"], x["similarity"]) for x in index.search(df, 3).collect()}
    for q, f in enumerate(rows):
        assert [got[q, p + 1] for p in range(3)] == sorted(((i, like(f, g)) for i, g in enumerate(rows)), key=lambda x: (-x[1], x[0]))[:3]
    assert len(got) == 600 and max(seen) < len(rows) ** 2 / 8


def test_sets_that_must_share_several_bits_meet_by_several(spark):
    """Failed before: one bit was the key, and rows met in a share of all pairs that does not fall."""
    from alembiq.operators import prefix

    r = random.Random(8)
    rows = [[sum(1 << b for b in b8 if b < 62), sum(1 << (b - 62) for b in b8 if b >= 62)] for b8 in (r.sample(range(124), 8) for _ in range(700))]
    rows += [[a, b ^ (1 << r.randrange(60))] for a, b in rows[:150]]
    df = spark.createDataFrame(list(enumerate(rows)), "id long, fp array<long>")
    classes = df.groupBy("fp").agg({"id": "min"}).toDF("f", "class").selectExpr("class", "f", "cast(bit_count(f[0]) + bit_count(f[1]) as long) n")
    index = prefix.Prefixes(classes, 0.3, 2)
    assert index.width > 1 and index.meetings() < 0.2 * prefix.size_pairs(classes, 0.3)
    want = {(i, j): s for (i, a), (j, b) in itertools.combinations(enumerate(rows), 2) if (s := like(a, b)) >= 0.3}
    assert {(x["a"], x["b"]): x["similarity"] for x in P.similarity_pairs(df, 0.3, words=2, by="prefix").collect()} == pytest.approx(want)

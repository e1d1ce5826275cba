"""Similarity by rarest bits, top-k over a stored index, and diverse picks, against brute force."""

import itertools
import random

import numpy as np
import pytest
import xxhash

from alembiq.operators import diverse as D
from alembiq.operators import pairs as P
from alembiq.operators import prefix as X
from alembiq.operators import search as Q
from pyspark.sql import functions as F


def like(a, b):
    c, u = sum((x & y).bit_count() for x, y in zip(a, b)), sum((x | y).bit_count() for x, y in zip(a, b))
    return c / u if u else 0.0


def signed(w):
    return [x - (1 << 64) if x >= 1 << 63 else x for x in w]


def made(n, seed, skewed, words=2, most=12):
    """Fingerprints of which near copies follow; with ``skewed`` some bits are far more frequent than others."""
    r = random.Random(seed)
    out = []
    for _ in range(n):
        if out and r.random() < 0.4:
            f = list(r.choice(out))
            for _ in range(r.randint(0, 3)):
                b = r.randrange(64 * words)
                f[b // 64] ^= 1 << (b % 64)
        else:
            f = [0] * words
            for _ in range(r.randint(0, most)):
                b = int(64 * words * r.random() ** (4 if skewed else 1))
                f[b // 64] |= 1 << (b % 64)
        out.append(f)
    return out


def frame(spark, fps):
    return spark.createDataFrame([(i, None if f is None else signed(f)) for i, f in enumerate(fps)], "id long, fp array<long>")


@pytest.mark.parametrize("skewed", [True, False])
@pytest.mark.parametrize("t", [0.1, 0.55, 0.7, 0.8, 1.0])
def test_prefixes_find_every_pair(spark, monkeypatch, skewed, t):
    monkeypatch.setattr(X, "LIST_ROWS", 7)
    fps = [*made(150, 3, skewed), None]
    want = {(i, j): s for (i, a), (j, b) in itertools.combinations(enumerate(fps[:150]), 2) if (s := like(a, b)) >= t}
    for by in ("prefix", "band", None):
        assert {(r["a"], r["b"]): r["similarity"] for r in P.similarity_pairs(frame(spark, fps), t, by=by, words=2).collect()} == pytest.approx(want)


def test_each_candidate_is_met_once(spark, monkeypatch):
    monkeypatch.setattr(X, "LIST_ROWS", 5)
    rows = frame(spark, made(200, 5, True)).groupBy("fp").agg(F.min("id").alias("class"))
    classes = rows.select("class", F.col("fp").alias("f"), X.S.popcount(F.col("fp")).alias("n")).where("n > 0")
    found = X.Prefixes(classes, 0.4).candidates()
    assert found.count() == found.select(F.least("x", "y"), F.greatest("x", "y")).distinct().count() > 0


def test_candidates_are_few_where_all_rows_have_equal_counts(spark):
    r = np.random.default_rng(4)
    order = np.argsort(-r.normal(size=(1500, 64)), axis=1)[:, :8] * 4 + np.arange(8) // 2
    fps = [[sum(1 << (b - 64 * w) for b in row if b // 64 == w) for w in range(4)] for row in order.tolist()]
    classes = frame(spark, fps).select(F.col("id").alias("class"), F.col("fp").alias("f"), X.S.popcount(F.col("fp"), 4).alias("n"))
    index = X.Prefixes(classes, 0.3, 4)
    assert classes.select("n").distinct().count() == 1
    candidates, band = index.candidates().count(), X.size_pairs(classes, 0.3)
    assert band == 1500 * 1499 // 2 and candidates < 0.05 * band


def test_a_bit_that_all_rows_share_is_dealt_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(X, "LIST_ROWS", 50)
    fps = [[1 | 1 << (1 + i % 60) | 1 << (1 + i // 8 % 60), 1 << (i % 64)] for i in range(400)]
    classes = frame(spark, fps).groupBy("fp").agg(F.min("id").alias("class")).select("class", F.col("fp").alias("f"), X.S.popcount(F.col("fp"), 2).alias("n"))
    index = X.Prefixes(classes, 0.1, 2)
    assert index.lists.agg(F.max("probes")).first()[0] > 100
    plan = index.candidates()
    assert plan.count() > 0
    joined = plan._jdf.queryExecution().optimizedPlan().toString()
    assert "bit" in joined and "Join Inner" in joined


def test_set_bits_and_packing(spark):
    fps = made(30, 8, False)
    rows = frame(spark, [*fps, [1 << 63, 1]]).select("fp", X.S.set_bits(F.col("fp")).alias("a"), X.S.set_bits(F.col("fp"), 2).alias("b")).withColumn("back", X.S.pack_positions(F.col("a"), 2)).collect()
    for r in rows:
        want = [64 * w + i for w, x in enumerate(r["fp"]) for i in range(64) if x >> i & 1]
        assert r["a"] == r["b"] == want and r["back"] == r["fp"]


@pytest.mark.parametrize("metric", ["tanimoto", "dice", "cosine"])
@pytest.mark.parametrize("few", [10_000, 1])
def test_search_equals_brute_force(spark, monkeypatch, metric, few):
    monkeypatch.setattr(Q, "BROADCAST_QUERIES", few)
    monkeypatch.setattr(Q, "BLOCK_ROWS", 6)
    fps = [*made(160, 6, True), [0, 0], None]
    df = frame(spark, fps)
    index = Q.Index(spark, Q.write_index(df, words=2), 2)
    got = {(r["q"], r["place"]): (r["id"], r["similarity"]) for r in index.search(df.where("id % 20 = 0 OR id >= 160"), 7, metric).collect()}

    def value(a, b):
        c, na, nb = sum((x & y).bit_count() for x, y in zip(a, b)), sum(x.bit_count() for x in a), sum(x.bit_count() for x in b)
        if metric == "tanimoto":
            return like(a, b)
        return (2 * c / (na + nb) if na + nb else 0.0) if metric == "dice" else (c / (na * nb) ** 0.5 if na and nb else 0.0)

    for q in [*range(0, 160, 20), 160]:
        want = sorted(((i, value(f, fps[q])) for i, f in enumerate(fps) if f is not None), key=lambda x: (-x[1], x[0]))[:7]
        assert [got[q, p + 1][0] for p in range(7)] == [i for i, _ in want]
        assert [got[q, p + 1][1] for p in range(7)] == pytest.approx([s for _, s in want])
    assert len(got) == 9 * 7


def test_far_partitions_are_not_read(spark):
    fps = [[(1 << n) - 1 ^ (1 << (i % n) if n > 4 and i % 3 else 0)] for n in range(1, 64) for i in range(20)]
    df = frame(spark, fps)
    index = Q.Index(spark, Q.write_index(df, words=1), 1)
    read = []
    index.partitions = lambda bits: read.append(bits) or Q.Index.partitions(index, bits)
    query = df.where("id = 620")
    assert index.search(query, 5).count() == 5
    assert max(map(len, read)) < 12 < len(index.sizes)
    plan = index.partitions([31, 32])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bits" in plan or "PartitionFilters: [bits" in plan
    files = lambda rows: rows.select(F.input_file_name()).distinct().count()
    assert files(index.partitions([31, 32])) < files(index.rows) / 10


def test_search_of_little(spark):
    df = frame(spark, [[3], [1], None])
    index = Q.Index(spark, Q.write_index(df, words=1), 1)
    assert sorted((r["q"], r["id"]) for r in index.search(df, 5).collect()) == [(0, 0), (0, 1), (1, 0), (1, 1)]
    assert index.search(df.limit(0), 5).collect() == []
    empty = Q.Index(spark, Q.write_index(df.limit(0), words=1), 1)
    assert empty.search(df, 5).collect() == []


def greedy(fps, ids, n):
    picks = [min(ids)]
    while len(picks) < min(n, len(ids)):
        picks.append(min((i for i in ids if i not in picks), key=lambda i: (-min(1 - like(fps[i], fps[p]) for p in picks), i)))
    return picks


@pytest.mark.parametrize("pool", [4096, 5, 1])
def test_exact_picks_whatever_the_pool(spark, monkeypatch, pool):
    monkeypatch.setattr(D, "POOL_ROWS", pool)
    fps = [*made(60, 9, False), None]
    got = D.maxmin_pick(frame(spark, fps), 9).orderBy("turn").collect()
    assert [r["id"] for r in got] == greedy(fps, range(60), 9)
    assert D.maxmin_pick(frame(spark, fps[:3]), 9).count() == 3


def test_core_sets_equal_their_definition(spark):
    fps = [*made(90, 10, False), None]
    groups = {}
    for i in range(90):
        h = xxhash.xxh64_intdigest((4).to_bytes(4, "little"), xxhash.xxh64_intdigest(i.to_bytes(8, "little"), 42))
        groups.setdefault((h - (1 << 64) if h >= 1 << 63 else h) % 4, []).append(i)
    union = [i for g in groups.values() for i in greedy(fps, g, 6)]
    got = D.maxmin_coreset(frame(spark, fps), 6, groups=4).orderBy("turn").collect()
    assert [r["id"] for r in got] == greedy(fps, union, 6)


def test_a_thousand_picks_take_few_jobs_and_cover_within_the_factor(spark, monkeypatch):
    monkeypatch.setattr(D, "GROUP_ROWS", 5000)
    fps = made(12000, 11, False, 2, 30)
    df = frame(spark, fps).repartition(4)
    tracker, group = spark.sparkContext.statusTracker(), "core-sets"
    # Adaptive plans start a job for each of their stages.
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.sparkContext.setJobGroup(group, "picks")
    try:
        rows = D.maxmin_coreset(df, 1000).collect()
        assert len(tracker.getJobIdsForGroup(group)) <= 4
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.sparkContext.setJobGroup("", "")
    got = [r["id"] for r in sorted(rows, key=lambda r: r["turn"])]
    assert len(set(got)) == 1000
    f = np.array([signed(x) for x in fps], np.int64).view(np.uint64)
    n = np.bitwise_count(f).sum(axis=1, dtype=np.int64)
    radius = lambda picks: np.minimum.reduce([D._distances(f, n, i) for i in picks]).max()
    assert radius(got) <= 4 * radius(D.farthest_first(f, 1000))
    with pytest.raises(ValueError):
        D.maxmin_coreset(df, 2000)


@pytest.mark.parametrize("pool", [4096, 4, 3, 1])
def test_rows_that_come_to_be_equally_far_are_picked_by_id(spark, monkeypatch, pool):
    """Failed before: of such rows the one that had been farther came first, whatever its id."""
    monkeypatch.setattr(D, "POOL_ROWS", pool)
    bits = lambda *b: [sum(1 << x for x in b)]
    first, far = bits(0, 1, 2, 3), bits(30, 31, 32)
    # Row 10 is farther from the first pick than rows 1 to 4, and as far as these once the second is picked.
    fps = [first, *[bits(0, 10 + i) for i in range(4)], *[first] * 4, far, bits(0, 20, 30)]
    got = D.maxmin_pick(frame(spark, fps).repartition(3), 4).orderBy("turn").collect()
    assert [r["id"] for r in got] == greedy(fps, range(len(fps)), 4)

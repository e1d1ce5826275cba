"""Near copies on five-word shingles against brute force over all pairs."""

import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline as P
from alembiq.llm import simhash_parts as S

from .helpers import documents


def similar(a, b):
    u, v = S.shingle_set(a), S.shingle_set(b)
    both = len(np.intersect1d(u, v))
    return 5 * both >= 4 * (len(u) + len(v) - both)


def kept(rows):
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if similar(rows[i][1], rows[j][1]):
                root[find(i)] = find(j)
    least = {find(i): min(rows[j][0] for j in range(len(rows)) if find(j) == find(i)) for i in range(len(rows))}
    return sorted(rows[i][0] for i in range(len(rows)) if rows[i][0] == least[find(i)])


def test_stage_drops_near_copies(spark):
    r = random.Random(5)
    word = lambda: f"w{r.randrange(3000)}"
    line = " ".join(word() for _ in range(12))
    rows = []
    for i in range(60):
        w = [word() for _ in range(r.randint(20, 200))] + (line.split() if i % 3 == 0 else [])
        rows.append((len(rows), " ".join(w), "s"))
        for _ in range(i % 4):
            w = list(w)
            for _ in range(r.randint(1, max(1, len(w) // 40))):
                w[r.randrange(len(w))] = "other"
            rows.append((len(rows), " ".join(w), "s"))
    rows += [(900, None, "s"), (901, "", "s"), (902, " \n", "s"), (903, "one two", "s"), (904, "ONE  two", "s"), (905, "one", "s")]
    want = kept(rows)
    assert 60 < len(want) < len(rows) - 30
    got = P.near_dedup(spark, documents(spark, rows), "")
    assert sorted(x["doc_id"] for x in got.collect()) == want


def test_similar_sets_share_a_table_and_pass_the_sketch():
    r = np.random.default_rng(1)
    small, met, all_ = 0, 0, 0
    for _ in range(1500):
        n = int(r.integers(1, 60)) if r.random() < 0.5 else int(r.integers(64, 3000))
        a = np.unique(r.integers(0, 2**64, n, dtype=np.uint64))
        drop = int(r.integers(0, n // 9 + 1))
        b = np.unique(np.concatenate([r.permutation(a)[drop:], r.integers(0, 2**64, drop, dtype=np.uint64)]))
        both = len(np.intersect1d(a, b))
        if 5 * both < 4 * (len(a) + len(b) - both):
            continue
        share = len(np.intersect1d(S.tables(a), S.tables(b))) > 0
        all_, met, small = all_ + 1, met + share, small + (n < S.EXACT and not share)
        sketches = S.folded([S.sketch(a), S.sketch(b)])
        assert np.bitwise_count(sketches[0] ^ sketches[1]).sum() <= len(a) + len(b) - 2 * both
        assert S.bucket_links(np.array([len(a), len(b)]), sketches) == [(0, 1)]
    assert all_ > 1000 and small <= 2 and met >= 0.997 * all_


def test_parts_grow_with_the_set():
    got = [S.n_parts(n) for n in range(1, 5000)]
    assert got == sorted(got) and all(p > 2 * n / 9 for n, p in enumerate(got[: S.EXACT - 1], 1))


def test_large_buckets_and_failing_links(spark, monkeypatch):
    """Blocks of two texts, and sketches so short that many links they leave possible fail the exact check."""
    monkeypatch.setattr(S, "SMALL", 4)
    monkeypatch.setattr(S, "WORDS", 1)
    monkeypatch.setattr(S, "sketch", lambda found: np.zeros(1, np.int64))
    r = random.Random(9)
    rows, shared = [], [f"s{i}" for i in range(60)]
    for i in range(40):
        own = [f"o{i // 2}x{j}" for j in range(r.choice([2, 20, 40]))]
        rows.append((i, " ".join(shared + own + ([f"e{i}"] if i % 2 else [])), "s"))
    want = kept(rows)
    assert 3 < len(want) < 30
    texts = documents(spark, rows).selectExpr("xxhash64(text) AS key", "text")
    got = S.components(S.links(texts))
    roots = {x["node"]: x["root"] for x in got.collect()}
    keys = {x["doc_id"]: x["k"] for x in documents(spark, rows).selectExpr("doc_id", "xxhash64(text) AS k").collect()}
    assert len({roots.get(k, k) for k in keys.values()}) == len(want)


def test_repeated_ids_lose_no_text(spark):
    a, b = " ".join(f"a{i}" for i in range(20)), " ".join(f"b{i}" for i in range(20))
    got = S.deduplicated(documents(spark, [(3, a, "s"), (5, a, "s"), (5, b, "s"), (5, b, "s"), (None, b, "s")]))
    assert sorted(((x["doc_id"], x["text"]) for x in got.collect()), key=str) == sorted([(3, a), (5, b), (None, b)], key=str)
    assert S.deduplicated(documents(spark, [])).count() == 0


def planted(r, base, share):
    """A copy of the words ``base`` whose five-word shingles have a similarity of about ``share`` with its own."""
    n = len(base)
    out, spread = list(base), max(1, round((1 - share) / (1 + share) * n / 5))
    for at in r.sample(range(2, n - 2), spread):
        out[at] = f"x{r.randrange(10**9)}"
    return out


def crowd(r, n, footer, copies):
    """Texts of own words and one footer, of some of which near copies of 0.75 to 0.9 follow, and a large group of near copies of one text."""
    rows = []
    for _ in range(n):
        base = [f"w{r.randrange(10**9)}" for _ in range(r.randint(6, 30))] + footer
        rows.append(base)
        if r.random() < 0.3:
            rows.append(planted(r, base, r.uniform(0.75, 0.9)))
    base = [f"g{i}" for i in range(200)]
    rows += [planted(r, base, 0.98) for _ in range(copies)]
    r.shuffle(rows)
    return [(i, " ".join(w), "s") for i, w in enumerate(rows)]


def test_texts_that_share_a_footer_and_a_large_group_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(S, "SMALL", 12)
    rows = crowd(random.Random(3), 110, [f"footer{i}" for i in range(18)], 60)
    want = kept(rows)
    assert 110 < len(want) < len(rows) - 55
    got = S.deduplicated(documents(spark, rows))
    assert sorted(x["doc_id"] for x in got.collect()) == want


def test_rows_dealt_grow_as_the_texts_that_share_a_footer(spark, monkeypatch):
    monkeypatch.setattr(S, "SMALL", 64)
    dealt, old = [], S._bucket_links
    monkeypatch.setattr(S, "_bucket_links", lambda rows, again: dealt.append(rows.count()) or old(rows, again))
    footer = " ".join(f"footer{i}" for i in range(18))
    for n in (1000, 3000):
        own = F.concat_ws(" ", *[F.hex(F.xxhash64("id", F.lit(i))) for i in range(14)])
        texts = spark.range(n).select(F.col("id").alias("key"), F.concat(own, F.lit(f" {footer}")).alias("text"))
        assert S.links(texts).count() == 0
    assert sum(dealt[1:]) < 6 * max(dealt[0], 500)


def test_a_group_of_near_copies_is_not_dealt_in_pairs_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(S, "SMALL", 16)
    dealt, old = [], S._bucket_links
    monkeypatch.setattr(S, "_bucket_links", lambda rows, again: dealt.append(rows.count()) or old(rows, again))
    base = [f"g{i}" for i in range(200)]
    texts = spark.createDataFrame([(i, " ".join([*base[: 3 + i % 190], f"x{i}", *base[4 + i % 190 :]])) for i in range(400)], "key long, text string")
    assert S.links(texts).count() >= 399
    assert sum(dealt) < 400 * 40


def test_similar_sets_share_a_rarest_shingle():
    r = np.random.default_rng(2)
    counts = r.integers(0, 50, S.SLOTS)
    for _ in range(300):
        n = int(r.integers(1, 400))
        a = np.unique(r.integers(0, 2**64, n, dtype=np.uint64))
        drop = int(r.integers(0, len(a) // 9 + 1))
        b = np.unique(np.concatenate([a[drop:], r.integers(0, 2**64, drop, dtype=np.uint64)]))
        both = len(np.intersect1d(a, b))
        if 5 * both >= 4 * (len(a) + len(b) - both):
            assert len(np.intersect1d(S.rarest(a, counts), S.rarest(b, counts)))

import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from alembiq.llm import simhash as S

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string"


def brute(rows):
    """Component by comparing all pairs of fingerprints, computed bit by bit."""

    def fp(text):
        w = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).split()
        sh = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
        return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))

    fps = [fp(t) for _, t in rows]
    root = list(range(len(rows)))
    find = lambda x: x if root[x] == x else find(root[x])
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, fps[i], least.get(find(i))) for i, (d, _) in enumerate(rows)), key=str)


def texts():
    r = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    base = " ".join(r.choice(words) for _ in range(400))
    out = [None, "", " \t\n", "One", "one two", "ONE two", base, base, base.upper()]
    for _ in range(60):  # a group of near copies
        w = base.split()
        for _ in range(r.randint(1, 3)):
            w[r.randrange(400)] = r.choice(words)
        out.append(" ".join(w))
    out += [" ".join(r.choice(words) for _ in range(r.randint(3, 60))) for _ in range(60)]
    out.append(" ".join(r.choice(words) for _ in range(90_000)))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "en", None, 1, "clash") for d, t in rows], SCHEMA)


def found(df):
    return sorted(((r["doc_id"], r["fp"] & (1 << 64) - 1, r["component_id"]) for r in df.collect()), key=str)


def test_matches_all_pairs(spark):
    rows = [(1000 - 7 * i, t) for i, t in enumerate(texts())] + [(None, "One"), (3, "One"), (3, "One"), (2**60 + 1, "far away id")]
    assert found(S.near_duplicates(frame(spark, rows))) == brute(rows)


def test_large_buckets_take_the_second_covering(spark):
    r = random.Random(1)
    centre = r.getrandbits(64)
    fps = {centre}
    while len(fps) < 400:
        fps.add(r.choice(list(fps)) ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64) if r.random() < 0.3 else 0))
    fps |= {r.getrandbits(64) for _ in range(100)}
    df = spark.createDataFrame([(S._signed(x),) for x in fps], "fp long")
    got = {(row["node"], row["root"]) for row in S.components(S.links(df, small=3)).collect()}
    root = {x: x for x in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    fl = list(fps)
    for i, a in enumerate(fl):
        for b in fl[:i]:
            if (a ^ b).bit_count() <= 3:
                root[find(a)] = find(b)
    groups = {}
    for x in fl:
        groups.setdefault(find(x), []).append(S._signed(x))
    want = {(x, min(g)) for g in groups.values() for x in g if x != min(g)}
    assert got == want


def test_every_pair_within_the_radius_collides():
    r = random.Random(3)
    for _ in range(2000):
        d = sum(1 << b for b in r.sample(range(64), r.randint(1, 3)))
        assert any(d & m == 0 for m in S.MASKS)


def test_flips_find_what_pairs_find():
    r = np.random.default_rng(2)
    free = list(range(8, 20))
    fps = np.unique(r.integers(0, 1 << 12, 900)) << 8
    wide = S.bucket_links(fps.astype(np.int64), free)
    assert len(wide) == len(fps) - 1  # such a dense set is connected


def test_deduplicated_keeps_one_of_each(spark):
    rows = [(5, "a b c d"), (4, "a b c d"), (9, "x y z"), (None, "a b c d"), (4, "a b c d")]
    out = S.deduplicated(frame(spark, rows))
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "fp"]
    assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str) == [(4, "a b c d"), (9, "x y z"), (None, "a b c d")]


def test_empty_table(spark):
    assert S.near_duplicates(frame(spark, []).where(F.lit(False))).count() == 0

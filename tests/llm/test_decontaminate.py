import itertools
import random

from alembiq.llm import decontaminate as D

from .helpers import documents, rows

BENCH = "item_id long, text string, t string, seed string"


def words(r, n):
    return [f"w{r.randrange(5000)}" for _ in range(n)]


def bench(spark, items):
    return spark.createDataFrame([(i, t, "clash", "clash") for i, t in items], BENCH)


def test_finds_passages_with_substitutions(spark):
    r = random.Random(3)
    items = [(i, " ".join(words(r, r.randint(15, 50)))) for i in range(20)]
    docs, want = [], set()
    for i in range(120):
        w = words(r, r.randint(0, 200))
        if i % 3 == 0:
            item = items[r.randrange(20)][1].split()
            for _ in range(i % 9 // 3):  # none, one or two words replaced
                item[r.randrange(len(item))] = "other"
            at = r.randint(0, len(w))
            w[at:at] = [x.upper() + r.choice([".", ",", ""]) for x in item]
            want.add(i)
        docs.append((i, " ".join(w), "s"))
    got = {x["doc_id"] for x in D.contaminated(documents(spark, docs), bench(spark, items)).collect()}
    by_number = {k: sum(i in got for i in want if i % 9 // 3 == k) / sum(i % 9 // 3 == k for i in want) for k in range(3)}  # recall by substituted tokens
    assert by_number[0] == by_number[1] == 1 and by_number[2] >= 0.9, by_number
    exact = {i for i in want if i % 9 // 3 < 2}
    assert exact <= got <= want and len(got) >= 0.9 * len(want)


def test_short_items_match_as_a_whole(spark):
    items = bench(spark, [(1, "alpha beta gamma"), (None, "no id here"), (3, None), (4, "..."), (1, "alpha beta gamma")])
    docs = documents(spark, [(1, "x ALPHA, beta gamma y", "s"), (2, "alpha beta delta", "s"), (3, None, "s"), (4, "", "s"), (5, "gamma", "s"), (None, "alpha beta gamma", "s"), (6, "no id here", "s")])
    got = D.contaminated(docs, items)
    assert rows(got, "doc_id", "n_items", "item_ids") == sorted([(1, 1, [1]), (None, 1, [1]), (6, 1, [])], key=str)
    left = D.decontaminated(docs, items)
    assert left.columns == docs.columns and sorted(r["doc_id"] for r in left.collect()) == [2, 3, 4, 5]


def test_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(D, "BROADCAST_BYTES", -1)
    r = random.Random(5)
    items = [(i, " ".join(words(r, r.choice([4, 7, 20, 40])))) for i in range(12)]
    docs = [(i % 50, " ".join(words(r, 20) + (items[i % 12][1].split() if i % 2 else []) + words(r, 20)), "s") for i in range(100)] + [(None, items[0][1], "s"), (None, "x", "s")]
    got = rows(D.contaminated(documents(spark, docs), bench(spark, items)), "doc_id", "n_items", "item_ids", "best")
    monkeypatch.setattr(D, "BROADCAST_BYTES", 1 << 30)
    assert got == rows(D.contaminated(documents(spark, docs), bench(spark, items)), "doc_id", "n_items", "item_ids", "best")
    assert {g[0] for g in got} == {i % 50 for i in range(1, 100, 2)} | {None}


def test_empty_tables(spark):
    some = documents(spark, [(1, "a b c d e f g h i j k l m n", "s")])
    assert D.contaminated(some, bench(spark, [])).count() == 0
    assert D.contaminated(documents(spark, []), bench(spark, [(1, "a b")])).count() == 0
    assert D.decontaminated(some, bench(spark, [])).count() == 1


def test_masks_seed_every_accepted_window():
    for n in range(1, D.WINDOW + 1):
        for k in range(n + 1):
            if (n - k) / n < D.AGREE:
                break
            for bad in itertools.combinations(range(n), k):
                agree = "".join("0" if i in bad else "1" for i in range(n))
                assert any(all(a == "1" for a, m in zip(agree[s:], mask) if m == "1") for mask in D.masks_of(n) for s in range(n - len(mask) + 1)), (n, bad)


def test_finds_all_that_brute_force_finds(spark):
    r = random.Random(8)
    items = [(i, " ".join(f"k{i}x{j}" for j in range(n))) for i, n in enumerate([3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 14, 15, 15, 16, 17, 20, 24, 30, 59])]
    docs, want = [], set()
    for i in range(400):
        item, text = items[i % len(items)]
        w = text.split()
        every = i % 5 == 0
        for j in range(4, len(w), 5) if every else r.sample(range(len(w)), min(len(w), max(i % 3, round(len(w) * r.choice([0.1, 0.15, 0.2, 0.25, 0.3]))))):
            w[j] = "other"
        n = min(16, len(w))
        if any(sum(x != "other" for x in w[s : s + n]) / n >= 0.8 for s in range(len(w) - n + 1)):
            want.add(i)
        docs.append((i, " ".join(["a", "b"] * (i % 3) + w + ["c"] * (i % 2)), "s"))
    assert 100 < len(want) < 380
    assert {x["doc_id"] for x in D.contaminated(documents(spark, docs), bench(spark, items)).collect()} == want


def test_items_of_every_length(spark, monkeypatch):
    """Items of one, two and three tokens are found, each in its document, and least lengths are a parameter."""
    items = bench(spark, [(1, "zeta"), (2, "omega kappa"), (3, "alpha beta gamma")])
    docs = documents(spark, [(1, "a Zeta, b", "s"), (2, "omega kappa", "s"), (3, "x alpha beta gamma", "s"), (4, "kappa omega alpha beta", "s"), (5, "zeta omega kappa", "s")])
    want = [(1, [1], 1), (2, [2], 2), (3, [3], 3), (5, [1, 2], 2)]
    for least in (1 << 30, -1):
        monkeypatch.setattr(D, "BROADCAST_BYTES", least)
        assert rows(D.contaminated(docs, items), "doc_id", "item_ids", "longest") == want
    assert rows(D.contaminated(docs, items, shortest=3), "doc_id") == [(3,)]
    assert sorted(r["doc_id"] for r in D.decontaminated(docs, items).collect()) == [4]

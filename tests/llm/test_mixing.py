import hashlib
import random

import pytest

from alembiq.llm import mixing as M

from .helpers import documents


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, most=2):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, left, free = {}, share * sum(sizes.values()), set(names)
    while free:
        total = sum(w[s] for s in free)
        over = {s for s in free if left * w[s] / total > most * sizes[s]}
        if not over:
            target |= {s: left * w[s] / total for s in free}
            break
        for s in over:
            target[s] = float(most * sizes[s])
            left -= target[s]
        free -= over
    return target


def docs(n=400):
    r = random.Random(7)
    sources = ["b", "a", "é", "Z", None, "empty"]
    out = [(i, " ".join(["w"] * r.randint(0, 40)), r.choices(sources, [30, 5, 5, 2, 3, 0])[0]) for i in range(n)]
    return [*out, (n, None, "empty"), (n + 1, "  \t", "empty"), (None, "one two", "b"), (3, "again and again", "a"), (n + 2, "x " * 5000, "Z")]


def test_targets_and_thresholds(spark):
    data = docs()
    sizes = {}
    for _, t, s in data:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = brute_targets(sizes)
    rows = M.mix(documents(spark, data)).collect()
    assert len(rows) == len(data)
    taken = {}
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert r["taken"] in (0, r["size"], 2 * r["size"]) and r["copies"] <= 2
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    largest = {s: max(len((t or "").split()) for _, t, x in data if x == s) for s in sizes}
    for s in sizes:
        assert want[s] - largest[s] - 1 <= taken[s] <= want[s] + 1e-6


def test_decisions_are_a_hash_threshold(spark):
    data = docs()
    copies = {(r["doc_id"], r["source"], r["size"]): r["copies"] for r in M.mix(documents(spark, data)).collect()}
    h = lambda d, t: int(hashlib.md5(f"{'' if d is None else d}:{t or ''}".encode()).hexdigest()[:15], 16)
    for s in {s for _, _, s in data}:
        mine = [copies[d, x, len((t or "").split())] for _, d, t, x in sorted((h(d, t), d, t, x) for d, t, x in data if x == s)] if s is not None else []
        assert mine == sorted(mine, reverse=True)


@pytest.mark.parametrize("kind", ["null ids", "one id", "equal rows"])
def test_targets_without_distinct_ids(spark, kind):
    """Rows that cannot be told apart by doc_id, or at all, still meet their targets."""
    ident = {"null ids": lambda i: None, "one id": lambda i: 7, "equal rows": lambda i: 7}[kind]
    text = (lambda i: "one two") if kind == "equal rows" else (lambda i: f"one w{i}")
    df = documents(spark, [(ident(i), text(i), "a" if i < 200 else "b") for i in range(300)])
    taken, target = {}, {}
    rows = M.mix(df).collect()
    for r in rows:
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        target[r["source"]] = r["target"]
        assert r["taken"] <= 2 * r["size"]
    assert all(target[s] - 2 <= taken[s] <= target[s] for s in target)
    assert M.mixed_documents(df).count() == sum(r["copies"] for r in rows)


def test_reruns_agree_and_rows_are_repeated(spark):
    df = documents(spark, docs())
    a = sorted(((r["doc_id"], r["copies"]) for r in M.mix(df).collect()), key=str)
    b = sorted(((r["doc_id"], r["copies"]) for r in M.mix(df.repartition(7)).collect()), key=str)
    assert a == b
    out = M.mixed_documents(df)
    assert out.columns == df.columns and out.count() == sum(c for _, c in a)


def test_empty_tables(spark):
    assert M.mix(documents(spark, [])).count() == 0
    assert {r["taken"] for r in M.mix(documents(spark, [(1, None, "a"), (2, "", None)])).collect()} == {0}

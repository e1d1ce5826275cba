import random

import pytest
from pyspark.sql import functions as F

from alembiq.llm import spotsigs as S

from .helpers import documents

ANCHORS = set(S.ANCHORS)


def sigs(text):
    import re

    w = [x for x in re.split(r"[ \t\n\x0b\x0c\r.,;:!?]+", (text or "").lower()) if x]
    out = set()
    for i, x in enumerate(w):
        if x in ANCHORS:
            after = [y for y in w[i + 1 : i + 1 + S.REACH] if y not in ANCHORS][: S.CHAIN]
            if len(after) == S.CHAIN:
                out.add(" ".join([x, *after]))
    if not out and w:
        out = {" ".join(w[i : i + S.CHAIN + 1]) for i in range(max(1, len(w) - S.CHAIN))}
    return out


def like(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def texts():
    r = random.Random(9)
    words = [f"w{i}" for i in range(400)] + ["the", "of", "and", "is"] * 40
    base = [" ".join(r.choice(words) for _ in range(r.randint(5, 120))) for _ in range(25)]
    near = []
    for t in base[:12]:
        w = t.split()
        w[r.randrange(len(w))] = "other"
        near.append(" ".join(w))
    return [*base, *near, base[0], base[0], None, "", "the the", "no anchors at all here maybe", "one", "The, End."]


def test_signatures(spark):
    ts = texts()
    got = {r["doc_id"]: set(r["signatures"]) for r in S.fingerprinted(documents(spark, [(i, t, "s") for i, t in enumerate(ts)])).collect()}
    assert got == {i: sigs(t) for i, t in enumerate(ts)}


@pytest.mark.parametrize("t", [0.5, 0.8, 1.0])
def test_similar_by_brute_force(spark, t):
    ts = texts()
    pairs, members = S.similar(documents(spark, [(i, x, "s") for i, x in enumerate(ts)]), t)
    of = {r["fingerprint"]: sigs(ts[r["doc_id"]]) for r in members.collect()}
    names = sorted(of)
    want = {(a, b): like(of[a], of[b]) for i, a in enumerate(names) for b in names[i + 1 :] if of[a] and of[b] and like(of[a], of[b]) >= t}
    assert {(r["fingerprint_a"], r["fingerprint_b"]): r["likeness"] for r in pairs.collect()} == pytest.approx(want)
    assert members.count() == len(ts)


@pytest.mark.parametrize("n", [0, 1, 2, 37])
def test_next_rows(spark, n):
    ts = [(i * 7 % 41 - 5, f"t{i}") for i in range(n)] + ([(None, "null id"), (3, "twice"), (3, "also")] if n > 2 else [])
    order = sorted(ts, key=lambda x: (x[0] is None, -(x[0] or 0), [-ord(c) for c in x[1]] + [1]))
    want = sorted((d, t, order[(i + 1) % len(order)][1]) for i, (d, t) in enumerate(order) if d is not None)
    got = sorted((r["doc_id"], r["text"], r["next_text"]) for r in S.with_next(documents(spark, [(d, t, "s") for d, t in ts]), parts=5).collect() if r["doc_id"] is not None)
    assert got == want


def test_fingerprints_hold_what_likeness_needs(spark):
    import hashlib

    ts = texts()
    rows = S.fingerprinted(documents(spark, [(i, t, "s") for i, t in enumerate(ts)])).select("doc_id", "fingerprint", S.elements(F.col("fingerprint")).alias("e")).collect()
    code = lambda t: sorted({hashlib.md5(x.encode()).hexdigest()[: S.CODE] for x in sigs(t)})
    assert all(r["fingerprint"] == "".join(code(ts[r["doc_id"]])) and r["e"] == code(ts[r["doc_id"]]) for r in rows)


def test_likeness(spark):
    df = spark.createDataFrame([(["a", "b"], ["b", "c"]), ([], []), ([], ["a"])], "x array<string>, y array<string>")
    assert [r[0] for r in df.select(S.likeness(F.col("x"), F.col("y"))).collect()] == pytest.approx([1 / 3, 1.0, 0.0])

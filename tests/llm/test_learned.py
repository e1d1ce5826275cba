import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from alembiq.llm import quality as Q
from alembiq.llm import toxicity as T
from alembiq.llm.common import table
from alembiq.llm.learning import held_out

from .helpers import documents

SF = "/root/testdata/sf0.01"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_folding():
    same = ["idiot", "IDIOT", "1d10t", "ídïot", "іdіоt", "id­iot", "!diot", "ｉｄｉｏｔ"]
    assert {T.fold(x) for x in same} == {" idiot "}
    assert T.fold("c1own clown") == " ciown ciown " and T.fold(None) == T.fold("") == "  "
    assert T.fold("58.202 of%%% wow!!") == " 58 202 of wow "
    assert T.fold("s.t.u.p.i.d a.b x_y_z") == " stupid a b xyz "
    assert T.fold("s t u p i d") == T.fold("stuuupid") == T.fold("\u13da\u13a2upid") == T.fold("\U0001d412tupid") == " stupid "
    assert T.fold("x y z good") == " x y z good "


def test_words_cut_by_marks():
    lex = T.Lexicon((("stupid", 4.0), ("bitch", 4.0), ("idiot", 4.0)))
    for text in ("stu-pid", "bit.ch", "stu_p*id", "s-tupid", "St\u00fc-pid"):
        assert lex.strength(f"you {text} thing")[1] == 1, text
    assert lex.strength("idiot-like idiot.com you-idiot")[1] == 3 and lex.strength("well-known bit.ly a-b")[1] == 0
    assert lex.strength("a" * 200_000 + "-" + "b-" * 100_000)[1] == 0


def test_words_of_any_length_are_learned(spark):
    r = random.Random(2)
    w = lambda n: " ".join(f"{r.choice('bcdfgklm')}{r.choice('aeiou')}{r.randrange(10**4)}x" for _ in range(n))
    long = "abcdefghijkmnopqr"
    texts = [f"{w(30)} qz {w(5)} {long} {w(30)}" for _ in range(60)] + [f"{w(40)} {long[:-1]}s {w(40)}" for _ in range(400)]
    found = T.learned_words(spark.createDataFrame([(t, int(i < 60)) for i, t in enumerate(texts)], "text string, y int"))
    assert "qz " in found and f"{long} " in found and not any(T.fold(f"{long[:-1]}s").startswith(" " + x.rstrip("+")) for x in found)


def test_exceptions_are_learned(spark):
    r = random.Random(7)
    w = lambda n: " ".join(f"{r.choice('bcdfgklm')}{r.choice('aeiou')}{r.randrange(10**4)}x" for _ in range(n))
    texts = [(f"{w(20)} you idiot {w(20)}", 1) for _ in range(60)] + [(f"{w(20)} idiot box {w(20)}", 0) for _ in range(30)] + [(w(40), 0) for _ in range(100)]
    sample = spark.createDataFrame(texts, "text string, y int")
    lex = T.Lexicon((("idiot", 4.0),))
    found = T.learned_exceptions(sample, lex)
    assert found == [" idiot box "]
    spared = T.Lexicon(lex.words, (*lex.exceptions, *found))
    assert spared.strength("an Idiot-box here")[1] == 0 and spared.strength("an idiot box, you idiot")[1] == 1
    assert T.learned_exceptions(sample, spared) == [] and T.learned_exceptions(sample.limit(0), lex) == []


def test_every_sign_stands_for_its_letter():
    for sign, letter in T.SUBSTITUTES.items():
        assert T.fold(f"{sign}xq") == T.fold(f"{letter}xq"), sign
        if sign != "!":
            assert T.fold(f"xq{sign}") == T.fold(f"xq{letter}"), sign
    assert T.Lexicon((("bitch", 4.0),)).strength("you 8itch")[1] == 1


def test_matches_are_those_of_a_scan_of_all_words():
    """Aho-Corasick against words looked at one by one."""
    r = random.Random(4)
    lexicon = T.Lexicon((("cat", 1.0), ("catfish", 2.0), ("dog", 4.0), ("can", 0.5)), ("cat nap", "hot dog", "dog day"))
    for _ in range(500):
        words = [r.choice(["cat", "cats", "catfish", "nap", "hot", "dog", "dogma", "day", "can", "x", "scat"]) for _ in range(r.randint(0, 12))]
        spared = set()
        for i in range(len(words) - 1):
            if f"{words[i]} {words[i + 1]}" in lexicon.exceptions:
                spared |= {i, i + 1}
        hits = [max(w for p, w in lexicon.words if x.startswith(p)) for i, x in enumerate(words) if i not in spared and any(x.startswith(p) for p, _ in lexicon.words)]
        total, n = lexicon.strength(" ".join(words))
        assert n == len(hits) and abs(total * (1 + np.log1p((len(words) + 1) / 200)) - sum(hits)) < 0.02 * max(1, sum(hits))


def test_exceptions_and_length():
    lex = T.Lexicon((("idiot", 4.0), ("trash", 4.0)))
    assert lex.strength("you idiot")[1] == 1 and lex.strength("the trash can")[1] == 0 and lex.strength("trash can, trash")[1] == 1 and lex.strength("trash cans")[1] == 1
    assert lex.strength("videotape fidiot")[1] == 0
    assert lex.strength("idiot " + "word " * 5000)[0] < lex.strength("idiot word")[0]


def test_copies_teach_nothing(spark):
    r = random.Random(1)
    w = lambda n: " ".join(f"{r.choice('bcdfgklm')}{r.choice('aeiou')}{r.randrange(10**4)}x" for _ in range(n))
    copied = w(80)
    texts = [copied] * 60 + [w(40) + " grobble " + w(40) for _ in range(60)] + [w(80) for _ in range(400)]
    found = T.learned_words(spark.createDataFrame([(t, int(i < 120)) for i, t in enumerate(texts)], "text string, y int"))
    assert any("grobbie".startswith(x) for x in found) and not any(T.fold(copied).find(f" {x}") >= 0 for x in found)


@needs_tables
def test_toxicity_on_held_out_rows(spark):
    docs = table(spark, SF, "documents")
    found = T.scored(docs, T.fit(docs, table(spark, SF, "labels"))).join(table(spark, SF, "labels"), "doc_id").where(held_out(F.col("doc_id")))
    rows = found.select("score", "toxic").collect()
    assert not any(r["score"] >= 0.7 for r in rows if not r["toxic"])
    assert sum(r["score"] >= 0.7 for r in rows if r["toxic"]) > 0.85 * sum(r["toxic"] for r in rows)
    clean = T.clean_documents(docs, T.fit(docs, table(spark, SF, "labels")))
    assert clean.columns == docs.columns and 0 < clean.count() < docs.count()


@needs_tables
def test_quality_on_held_out_rows(spark):
    docs = table(spark, SF, "documents")
    rows = Q.scored(docs, Q.fit(docs, table(spark, SF, "labels"))).join(table(spark, SF, "labels"), "doc_id").where(held_out(F.col("doc_id"))).collect()
    assert np.mean([(r["score"] >= 0.5) == (r["quality"] == 1) for r in rows]) > 0.95


@pytest.mark.parametrize("name", ["toxicity", "quality"])
def test_odd_rows(spark, name):
    docs = documents(spark, [(1, None, None), (2, "", "a"), (None, "stupid", "a"), (4, "word " * 50_000, None), (5, "you idiot", "b"), (5, "you idiot", "b")])
    known = labels(spark, [(1, None, None), (None, 1, 1), (2, 1, 0), (5, 0, 1)])
    module = T if name == "toxicity" else Q
    rows = module.scored(docs, module.fit(docs, known)).collect()
    assert len(rows) == 6 and all(0 <= r["score"] <= 1 for r in rows)
    empty = documents(spark, [])
    assert module.scored(empty, module.fit(empty, known.limit(0))).count() == 0


def test_co_training_uses_the_other_view():
    r = np.random.default_rng(0)
    y = r.integers(0, 2, 4000)
    a = (y[:, None] * 2.0 - 1) + r.normal(0, 1.5, (4000, 4))
    b = (y[:, None] * 2.0 - 1) + r.normal(0, 1.5, (4000, 4))
    known, rest = slice(0, 40), slice(40, 3000)
    model = Q.co_train([a[known], b[known]], y[known].astype(float), Q.Pool([a[rest], b[rest]]))
    p = model.score([a[3000:], b[3000:]])
    alone = Q.co_train([a[known], b[known]], y[known].astype(float), Q.Pool([a[rest], b[rest]]), rounds=0).score([a[3000:], b[3000:]])
    loss = lambda q: -np.mean(np.log(np.clip(np.where(y[3000:] == 1, q, 1 - q), 1e-6, 1)))
    assert loss(p) < loss(alone) and model.turn > 0 and len(model.losses) > 1
    assert np.mean((p >= 0.5) == y[3000:]) > 0.9 and 0 <= p.min() <= p.max() <= 1
    assert Q.co_train([a[:0], b[:0]], y[:0].astype(float), Q.Pool([a, b])).score([a[:3], b[:3]]).tolist() == [0.5] * 3


def test_misleading_views_teach_nothing():
    """A view that is sure and wrong, and one that says nothing: the other stays what it was, and the score is no worse than without exchange."""
    r = np.random.default_rng(1)
    y = r.integers(0, 2, 3000)
    a = (y[:, None] * 2.0 - 1) + r.normal(0, 1.0, (3000, 4))
    known, rest, seen = slice(0, 80), slice(80, 2000), slice(2000, 3000)
    for b in (r.normal(0, 1, (3000, 4)), np.where(np.arange(3000)[:, None] < 80, y[:, None], 1 - y[:, None]) * 2.0 - 1 + r.normal(0, 1.0, (3000, 4))):
        fit = lambda rounds: Q.co_train([a[known], b[known]], y[known].astype(float), Q.Pool([a[rest], b[rest]]), rounds)  # noqa: E731, B023
        assert Q._losses(fit(4).score([a[seen], b[seen]]), y[seen]).mean() <= Q._losses(fit(0).score([a[seen], b[seen]]), y[seen]).mean() + 1e-3


def test_folds_hold_both_classes():
    y = np.array([1.0] * 17 + [0.0] * 3)
    part = Q.folds(y)
    assert part.max() == 2 and all({0.0, 1.0} == set(y[part == k]) for k in range(3))
    one = np.array([1.0] * 17 + [0.0])
    assert set(Q.folds(one)) == {0}
    r = np.random.default_rng(0)
    assert 0 <= Q.co_train([r.normal(0, 1, (18, 3)), r.normal(0, 1, (18, 2))], one, Q.Pool([np.zeros((5, 3)), np.zeros((5, 2))])).score([np.zeros((1, 3)), np.zeros((1, 2))])[0] <= 1


@needs_tables
def test_documents_with_few_labels(spark):
    """Whole documents, 24 and all labels: the exchange runs and does not harm held-out rows, and words carry the text view."""
    docs, known = table(spark, SF, "documents"), table(spark, SF, "labels")
    truth = {r["doc_id"]: r["quality"] for r in known.where(held_out(F.col("doc_id"))).collect()}
    for most, least in ((24, 0.85), (8000, 0.97)):
        loss = []
        for rounds in (0, 4):
            model = Q.fit(docs, known, most, rounds)
            got = [(r["score"], truth[r["doc_id"]]) for r in Q.scored(docs, model).collect() if r["doc_id"] in truth]
            loss.append(Q._losses(np.array([g[0] for g in got]), np.array([g[1] for g in got])).mean())
        assert loss[1] <= loss[0] + 0.01 and len(model.losses) > 1
        assert np.mean([(p >= 0.5) == (t == 1) for p, t in got]) >= least


def test_tables_sum_as_matrices_do(spark):
    """Scores, thresholds and gradients over a table against those over the same vectors in one piece."""
    r = np.random.default_rng(2)
    words = [f"w{i}" for i in range(50)]
    docs = documents(spark, [(i, " ".join(r.choice(words, int(r.integers(1, 60)))) + "\n" * int(r.integers(0, 4)), f"s{i % 3}") for i in range(80)] + [(i, "copied", "s0") for i in range(80, 90)] + [(None, None, None)])
    known = labels(spark, [(i, i % 2, 0) for i in range(0, 40)])
    table_ = Q.unlabelled(docs, known)
    assert table_.count() == 42
    got = table_.collect()
    xs = [np.vstack([np.frombuffer(x[c], np.float16).astype(np.float32) for x in got]) for c in "am"]
    views = [Q.View(x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3), r.normal(0, 0.2, x.shape[1] + 1)) for x in xs]
    a, b = Q.TablePool(table_.repartition(3)), Q.Pool(xs)
    teams = [views, [Q.replace(v, coef=-v.coef) for v in views]]
    assert (a.histograms(teams) == b.histograms(teams)).all() and b.histograms(teams).sum() == 168
    jobs = [(vs, vs, [Q.surest(c, 0.5, 0.5, v) for c, v in zip(counts, vs)]) for vs, counts in zip(teams, b.histograms(teams))]
    assert all(np.allclose(p, q) for gs, hs in zip(a.gradients(jobs), b.gradients(jobs)) for p, q in zip(gs, hs))


def plain_text_view(text):
    """The text view of one text, word by word."""
    out = np.zeros(Q.TEXT_DIM, np.float32)
    b = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    if len(b) > 1:
        low = np.where((b >= 65) & (b <= 90), b + 32, b).astype(np.uint32)
        out[: Q.PAIR_BINS] = np.bincount(((low[:-1] * 31 + low[1:]) * 2654435761 >> 7) & (Q.PAIR_BINS - 1), minlength=Q.PAIR_BINS)
        out[: Q.PAIR_BINS] = np.sqrt(out[: Q.PAIR_BINS] / (len(b) - 1))
    if len(b):
        out[Q.PAIR_BINS : Q.PAIR_BINS + Q.N_CLASS] = 4 * np.sqrt(np.bincount(Q._CLASS[b], minlength=Q.N_CLASS) / len(b))
    words = (text or "").split()
    if words:
        n, distinct = len(words), len(set(words))
        told = (distinct / n, distinct / n * np.log1p(n), sum(map(len, words)) / n / 5, sum(a == b for a, b in zip(words, words[1:])) / n * 4, sum(w[:1].isupper() for w in words) / n, sum(w[-1:].isalnum() for w in words) / n)
        out[Q.PAIR_BINS + Q.N_CLASS : Q.PAIR_BINS + Q.N_CLASS + Q.WORD_DIM] = told
        low = [w.lower() for w in words]
        for at, terms in ((-2 * Q.WORD_BINS, low), (-Q.WORD_BINS, list(map(" ".join, zip(low, low[1:]))))):
            for t, k in Counter(terms).items():
                out[at + zlib.crc32(t.encode("utf-8", "surrogatepass")) % Q.WORD_BINS] += k
            if terms:
                end = at + Q.WORD_BINS or None
                out[at:end] = np.sqrt(out[at:end].astype(float) / len(terms))
    return out


def test_texts_together_are_seen_as_one_by_one(monkeypatch):
    """Odd words, long ones, many parts, and words forgotten in between; each word is hashed once, and pairs not at all."""
    r = random.Random(3)
    some = ["a", "Ab", "\u00c9COLE", "\u00df", "\u03a3\u0391\u03a3", "\u0130x", "\u6f22\u5b57", "x" * 62, "y" * 63, "Z" * 64, "w" * 300, "\ud800q", "1.", "!!", "\n", "\t", "\x85", "\xa0", "\x1c", "A", "a"]
    texts = [None, "", "a", " ", "\n\n", "A a A a", *("".join(r.choice(some) + r.choice([" ", "", "\n"]) for _ in range(r.randint(0, 30))) for _ in range(300))]
    want = np.stack([plain_text_view(t) for t in texts])
    assert (Q.text_views(texts) == want).all()
    monkeypatch.setattr(Q, "PART_CHARS", 1000)
    monkeypatch.setattr(Q, "REMEMBERED", 20)
    Q._words.forget()
    assert (Q.text_views(texts) == want).all() and len(Q._words.number) < 400
    assert Q.text_views([]).shape == (0, Q.TEXT_DIM)
    calls = []
    monkeypatch.undo()
    Q._words.forget()
    monkeypatch.setattr(Q.zlib, "crc32", lambda *x, of=zlib.crc32: calls.append(x) or of(*x))
    Q.text_views(["one two three one two"] * 50)
    assert len(calls) <= 4
    Q._words.forget()


def test_texts_are_not_shuffled(spark, monkeypatch):
    """However many labels there are, the texts without one are told by ids and keys; only vectors are dealt."""
    monkeypatch.setattr(Q, "written", lambda df, name: df)
    docs = documents(spark, [(1, "one", "a"), (2, "one", "a"), (3, "two", "a"), (3, "three", "a"), (4, "four", "a"), (4, "one", "b"), (None, "two", "a")])
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        found = Q.unlabelled(docs, labels(spark, [(1, 1, 0), (4, 0, 0), (None, 1, 0), (4, 1, 1)]))
        plan = found._jdf.queryExecution().explainString(found.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        dealt = re.findall(r"\) Exchange\s*\nInput[^\n]*", plan)
        assert len(dealt) >= 3 and not any("text#" in x for x in dealt)
        assert found.count() == 3
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)

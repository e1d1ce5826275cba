import random

from alembiq.llm import line_dedup as L

from .helpers import documents, rows

SPACES = " \t\n\x0b\x0c\r"


def brute(docs, min_chars=20, min_docs=3):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda x: x.strip(SPACES).translate(low)
    held = {}
    for i, (d, t) in enumerate(docs):
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= min_chars:
                held.setdefault(k, []).append(d)
    keeper = {k: max((d for d in ds if d is not None), default=None) for k, ds in held.items() if len(ds) >= min_docs}
    out = []
    for d, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in keeper or keeper[key(x)] == d]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def test_matches_plain_python(spark):
    r = random.Random(1)
    pool = [f"line number {i} that is long enough" for i in range(12)] + ["short", "", "  \x0bLINE number 3 that is long enough\t", "ÄÄÄÄÄÄÄÄÄÄÄÄÄÄÄÄÄÄÄÄ", "äääääääääääääääääääää"]
    docs = [(i * 3 - 40, "\n".join(r.choice(pool) for _ in range(r.randint(1, 9)))) for i in range(60)]
    docs += [(None, pool[0]), (None, pool[5] + "\n" + pool[0]), (1000, None), (1001, ""), (1002, "\n".join(pool * 300))]
    df = documents(spark, [(d, t, "s") for d, t in docs])
    for batches in (1, 3):
        got = rows(L.dedup_lines(df, batches=batches), "doc_id", "n_lines", "n_dropped", "kept")
        assert got == brute(docs)


def test_repeated_rows_are_documents_of_their_own(spark):
    text = "a line that is repeated often"
    df = documents(spark, [(5, text, "s")] * 3 + [(4, text, "s")])
    assert rows(L.dedup_lines(df), "doc_id", "kept") == [(4, ""), (5, text), (5, text), (5, text)]


def test_batches_report_what_is_new(spark):
    store = L.LineRuns(spark, buckets=2)
    first = L.line_hashes(documents(spark, [(9, "x" * 30 + "\n" + "y" * 30, "s"), (8, "x" * 30, "s")]), 20)
    second = L.line_hashes(documents(spark, [(7, "x" * 30 + "\n" + "z" * 30, "s")]), 20)
    assert store.add(first).count() == 2
    assert store.add(second).count() == 1
    third = L.line_hashes(documents(spark, [(6, "x" * 30, "s")]), 20)
    assert store.add(third).count() == 0
    assert rows(store.totals(), "keeper", "n_docs") == [(7, 1), (9, 1), (9, 4)]
    assert len(store.runs()) == 1
    store.drop()


def test_empty_table(spark):
    assert L.dedup_lines(documents(spark, [])).count() == 0

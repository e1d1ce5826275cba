import random

from alembiq.llm import preference as P

SCHEMA = "conv_id long, turn long, role string, text string, prompt string, turns int"


def brute(rows):
    convs = {}
    for c, turn, role, text in rows:
        convs.setdefault(c, []).append((turn, role, text))
    low = lambda x: (x is not None, x if x is not None else 0)
    for c in convs:
        convs[c].sort(key=lambda t: (low(t[0]), (t[1] is not None, t[1] or ""), (t[2] is not None, t[2] or "")))
    groups = {}
    for c in sorted(x for x in convs if x is not None):
        first = next(((r, t) for _, r, t in convs[c] if r != "system"), None)
        groups.setdefault(first, []).append(c)
    pairs = [(None, None)] if None in convs else []
    for ids in groups.values():
        width = 1024
        while len(ids) > 1:
            blocks, ids = {}, ids
            for c in ids:
                blocks.setdefault(c // width, []).append(c)
            pairs += [(b[i], b[i + 1]) for b in blocks.values() for i in range(0, len(b) - 1, 2)]
            ids = [b[-1] for b in blocks.values() if len(b) % 2]
            width *= 1024
        pairs += [(c, None) for c in ids]
    show = lambda t: f"<|im_start|>{t[1] or ''}\n{t[2] or ''}<|im_end|>\n"

    def spans(turns):
        at, out = 0, []
        for t in turns:
            s = show(t)
            if t[1] == "assistant":
                out.append((at + len("<|im_start|>assistant\n"), at + len(s) - 1))
            at += len(s)
        return out

    out = []
    for a, b in pairs:
        x, y = convs[a], convs[b] if b is not None else None
        if y is None:
            n = max((i for i, t in enumerate(x) if t[1] == "assistant"), default=len(x))
        else:
            n = 0
            while n < min(len(x), len(y)) and x[n][1:] == y[n][1:]:
                n += 1
        text = lambda ts: "".join(map(show, ts))
        out.append((a, b, n, text(x[:n]), text(x[n:]), spans(x[n:]), text(y[n:]) if y is not None else None, spans(y[n:]) if y is not None else None))
    return sorted(out, key=str)


def test_matches_plain_python(spark):
    r = random.Random(2)
    rows = []
    for c in [*range(40), *range(900, 1100, 7), *range(5000, 9000, 411), 2**40, 2**45]:
        talk = [("user", r.choice(["hi", "yo", "é?"])), ("assistant", r.choice(["a", "b"])), ("user", r.choice(["c", None, ""])), ("assistant", r.choice(["d<|im_end|>", "e"]))][: r.randint(1, 4)]
        if r.random() < 0.3:
            talk = [("system", r.choice(["s", "t"])), *talk]
        rows += [(c, i, role, text) for i, (role, text) in enumerate(talk)]
    rows += [(None, 0, "user", "hi"), (77, None, None, None), (78, 0, "user", "only asked"), (0, 0, "user", "repeated turn")]
    df = spark.createDataFrame([(*x, "clash", 1) for x in rows], SCHEMA)
    got = P.preference_format(P.paired(df)).collect()
    pair_of = lambda s: None if s is None else [(x["start"], x["end"]) for x in s]
    got = sorted(((x["chosen_id"], x["rejected_id"], x["n_common"], x["prompt"], x["chosen_text"], pair_of(x["chosen_spans"]), x["rejected_text"], pair_of(x["rejected_spans"])) for x in got), key=str)
    assert got == brute(rows)


def test_empty_table(spark):
    assert P.preference_format(P.paired(spark.createDataFrame([], SCHEMA))).count() == 0

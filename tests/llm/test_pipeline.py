"""The pipeline's stages against plain Python on a small corpus."""

import random

import corpus_pipeline as P

from alembiq.llm import token_output


def corpus():
    r = random.Random(11)
    words = [f"{a}{b}{c}" for a in "bdfgklmnprst" for b in "aeiou" for c in "lnrstx"]
    prose = lambda n: " ".join(r.choice(words) for _ in range(n))
    bench = [(i, prose(30)) for i in range(5)]
    docs = [(i, prose(120)) for i in range(60)]
    toxic = [(100 + i, prose(40) + " you stupid moron " + prose(20)) for i in range(5)]
    copies = [(200 + i, docs[i][1]) for i in range(6)]
    leaks = [(300 + i, prose(50) + " " + bench[i][1] + " " + prose(50)) for i in range(5)]
    return docs, toxic, copies, leaks, bench


def test_stages(spark, tmp_path):
    docs, toxic, copies, leaks, bench = corpus()
    everything = [(d, t, "en", f"src{d % 3}", len(t or "")) for d, t in [*docs, *toxic, *copies, *leaks, (900, None), (901, "")]]
    d = f"file://{tmp_path}/sf"
    spark.createDataFrame(everything, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(i, 1, 0) for i, _ in docs] + [(i, 1, 1) for i, _ in toxic], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    at = spark.read.parquet(f"{d}/documents.parquet")
    names, kept = at.columns, []
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, at, d)
        assert out.columns == names, name
        out.write.parquet(f"{d}/{name}")
        at = spark.read.parquet(f"{d}/{name}")
        kept.append(sorted(r["doc_id"] for r in at.select("doc_id").collect()))
    clean = [i for i, _ in docs]
    assert kept[0] == sorted([*clean, *(i for i, _ in copies), *(i for i, _ in leaks), 900, 901])
    assert kept[1] == sorted([*clean, *(i for i, _ in leaks), 900])
    assert kept[2] == sorted([*clean, 900])
    assert set(kept[3]) <= set(kept[2]) and max(map(kept[3].count, kept[3])) <= 2 and len(set(kept[3])) > 20
    last = P.STAGES[-1][1](spark, at, d).collect()
    assert sorted(r["doc_id"] for r in last) == kept[3]
    enc = token_output.encoder(token_output.vocabulary()).lib
    text = {i: t or "" for i, t, *_ in everything}
    assert all(r["n_tokens"] == len(enc.encode(text[r["doc_id"]], add_special_tokens=False).ids) + 1 for r in last)
    assert sorted(tuple(r) for r in P.run(spark, d).collect()) == sorted(tuple(r) for r in last)

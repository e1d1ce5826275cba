"""The Bloom filter: no value is lost, few are passed in vain, and the numbers that use it stay."""

from alembiq.operators import membership as B
from alembiq.operators import statistics as T
from pyspark.sql import functions as F


def table(spark, n, step=1):
    return spark.range(0, n * step, step).select(F.concat(F.lit("v"), F.col("id").cast("string")).alias("smiles"))


def test_no_value_is_lost_and_few_pass_in_vain(spark):
    large, small = table(spark, 50_000), table(spark, 400, 7).unionByName(spark.createDataFrame([(None,), ("other",)], "smiles string"))
    got = B.occurring(large, small, "smiles")
    want = {f"v{i * 7}" for i in range(400)}
    found = [r["smiles"] for r in got.collect()]
    assert want <= set(found) and len(found) == len(set(found)) < 400 + 0.05 * 50_000
    # Only what passes reaches the exchange: the filter is a broadcast to the scan of the large table.
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Exchange hashpartitioning(smiles") < plan.index("BroadcastNestedLoopJoin")


def test_empty_and_too_large_sides(spark, monkeypatch):
    large = table(spark, 100)
    assert B.occurring(large, large.limit(0), "smiles").count() == 0
    assert B.occurring(large.limit(0), large, "smiles").count() == 0
    monkeypatch.setattr(B, "MOST", 64)
    assert B.occurring(large, large, "smiles").count() == 100


def test_novelty_is_exact(spark):
    reference = table(spark, 5000)
    made = table(spark, 900, 10).unionByName(table(spark, 10, 10)).unionByName(spark.createDataFrame([(None,)], "smiles string"))
    row = T.generation_metrics(made, reference).first()
    assert row["novelty"] == 400 / 910 and row["n"] == 911
    total = T.generation_summary(reference, made).first()
    assert total["n_unique"] == 900 and total["n_novel"] == 400

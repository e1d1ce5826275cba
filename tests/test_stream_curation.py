"""Measurements that arrive in files, against the same curation of the whole table."""

import random
from datetime import datetime

from alembiq.operators import curation as C
from alembiq.streaming import curation as S
from alembiq.streaming.scoring import arrivals

SCHEMA = "source_index long, compound string, standard_value string, confidence_score double, note string, k long, t timestamp"


def made(n, seed):
    r = random.Random(seed)
    return [(seed * 10_000 + i, r.choice(["a", "b", "c", f"k{i % 17}", "", None]), r.choice(["1.5", "2", "10", "x", None, str(r.randint(1, 9))]), r.choice([0.4, 0.7, None, 1.0]), r.choice(["x", None, ""]), r.choice([None, 1, 1 << 60]), r.choice([None, datetime(2024, 1, 2, 3)])) for i in range(n)]


def rows(df):
    return sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=str)


def test_stream_equals_table_whatever_the_batches(spark, tmp_path):
    source, kept = f"{tmp_path}/in", []
    for batch, n in enumerate((90, 1, 60)):
        kept += made(n, batch)
        spark.createDataFrame(made(n, batch), SCHEMA).coalesce(2).write.mode("append").parquet(source)
        stream = arrivals(spark, source, spark.createDataFrame([], SCHEMA), files_per_batch=1)
        got = S.curated(stream, "compound", f"{tmp_path}/out", f"{tmp_path}/at")
        want = C.deduplicate(spark.createDataFrame(kept, SCHEMA), "compound")
        assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)
    # A run in which nothing arrived changes nothing.
    again = S.curated(arrivals(spark, source, spark.createDataFrame([], SCHEMA)), "compound", f"{tmp_path}/out", f"{tmp_path}/at")
    assert rows(again) == rows(want)


def test_the_state_store_is_set_back(spark):
    before = spark.conf.get(S._PROVIDER)
    with S.stateful(spark):
        assert spark.conf.get(S._PROVIDER) == S._ROCKS
    assert spark.conf.get(S._PROVIDER) == before


def test_keys_are_aggregated_without_python(spark, tmp_path):
    """Failed before: each key of a batch was a call of Python, and whole numbers beside nulls lost digits."""
    source = f"{tmp_path}/in"
    held = [(1, "a", "2", 1.0, None, (1 << 60) + 1, None), (2, "a", "4", 0.5, None, None, None)]
    spark.createDataFrame(held, SCHEMA).coalesce(1).write.parquet(source)
    stream = arrivals(spark, source, spark.createDataFrame([], SCHEMA))
    plan = S.deduplicated(stream, "compound")._jdf.queryExecution().logical().toString()
    assert "Pandas" not in plan and "Aggregate" in plan
    got = S.curated(stream, "compound", f"{tmp_path}/out", f"{tmp_path}/at").collect()
    assert [(r["k"], r["standard_value"], r["n_measurements"]) for r in got] == [((1 << 60) + 1, 3.0, 2)]

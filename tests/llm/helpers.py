import glob
import os

import duckdb

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string, drops string, h long, copies long, batch string, y string, _id string, id string, row string, _times string, _plan_source string, plan_source string, turn string, _threshold string, threshold string, source_size string, target string, extra string, size string, _copy string, _key string, key string, n string, _leaked string, k1 string, label string, fp string"


def documents(spark, rows):
    """Rows of (doc_id, text, source), with further columns whose names clash with the operators' own."""
    return spark.createDataFrame([(d, t, "en", s, len(t or ""), "clash", "clash", 1, 7, "clash", *["clash"] * 22) for d, t, s in rows], DOCS)


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


def duck(sf):
    con = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con

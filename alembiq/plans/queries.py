"""Registered queries: each applies an operator to one of the star-schema tables, with equivalent SQL.

The tables hold no molecules, so prices, quantities and embeddings stand in for properties,
measurements and fingerprints; the operators and their rules are those of the library.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import geometry as G
from ..functions import rules, scores
from ..functions import similarity as S
from ..operators import curation as C
from ..operators import grams
from ..operators import modelling as M
from ..operators import neighbours as N
from ..operators import pairs as P
from ..operators import screening as R
from ..operators import search
from ..operators import statistics as T
from ..operators.kernel import KernelRegression

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


#: Workings on a few literal molecules, tested like queries but not registered: they read none of the tables.
EXAMPLES: dict[str, Query] = {}
EXAMPLE_ORACLES: dict[str, str] = {}


def example(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        EXAMPLES[f.__name__] = f
        if sql:
            EXAMPLE_ORACLES[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# --- stand-ins -------------------------------------------------------------------------------

_MEASURE_SQL = """m AS (
  SELECT l_orderkey * 16 + l_linenumber AS source_index, l_partkey AS compound, l_suppkey,
    CASE WHEN l_linenumber % 5 = 0 THEN ' < ' WHEN l_linenumber % 7 = 0 THEN NULL ELSE '=' END AS standard_relation,
    CASE l_returnflag WHEN 'A' THEN 'nM' WHEN 'N' THEN 'uM' ELSE 'mg' END AS standard_units,
    CASE WHEN l_quantity = 13 THEN 'n/a' ELSE CAST(l_quantity AS VARCHAR) END AS standard_value,
    CASE WHEN l_tax > 0.04 THEN CAST(l_tax AS VARCHAR) END AS pchembl_value,
    CASE WHEN l_linestatus = 'O' THEN 'B' ELSE 'F' END AS assay_type, l_extendedprice, l_tax, l_discount
  FROM lineitem
)"""


def measurements(spark: SparkSession, d: str) -> DataFrame:
    """lineitem as activity records: relation, unit, value (text, some of it dirty), potency and assay type."""
    n = F.col("l_linenumber")
    return read(spark, d, "lineitem").select(
        (F.col("l_orderkey") * 16 + n).alias("source_index"), F.col("l_partkey").alias("compound"), "l_suppkey",
        F.when(n % 5 == 0, " < ").when(n % 7 == 0, None).otherwise("=").alias("standard_relation"),
        F.when(F.col("l_returnflag") == "A", "nM").when(F.col("l_returnflag") == "N", "uM").otherwise("mg").alias("standard_units"),
        F.when(F.col("l_quantity") == 13, "n/a").otherwise(F.col("l_quantity").cast("string")).alias("standard_value"),
        F.when(F.col("l_tax") > 0.04, F.col("l_tax").cast("string")).alias("pchembl_value"),
        F.when(F.col("l_linestatus") == "O", "B").otherwise("F").alias("assay_type"), "l_extendedprice", "l_tax", "l_discount",
    )


_PROPS_SQL = """p AS (
  SELECT p_partkey AS id, CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE (p_retailprice - 900) * 8.0 END AS "MolWt",
    p_size / 8.0 - 1.0 AS "LogP", CAST(p_partkey * 37 % 200 AS DOUBLE) AS "TPSA", p_size % 8 AS "HBD", p_size % 13 AS "HBA",
    p_partkey % 14 AS "RotatableBonds", p_partkey % 6 AS "AromaticRings", CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_size / 50.0 END AS "QED",
    p_partkey % 3 = 0 AS pains_pass, 1.0 + p_partkey % 10 AS sa_score, CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE p_retailprice END AS activity
  FROM part
)"""


def properties(spark: SparkSession, d: str) -> DataFrame:
    """part as molecules with properties; every 17th lacks a weight, every 5th a QED, every 11th an activity."""
    k, z = F.col("p_partkey"), F.col("p_size")
    return read(spark, d, "part").select(
        k.alias("id"), F.when(k % 17 != 0, (F.col("p_retailprice") - 900) * 8.0).alias("MolWt"), (z / 8.0 - 1.0).alias("LogP"), (k * 37 % 200).cast("double").alias("TPSA"),
        (z % 8).alias("HBD"), (z % 13).alias("HBA"), (k % 14).alias("RotatableBonds"), (k % 6).alias("AromaticRings"), F.when(k % 5 != 0, z / 50.0).alias("QED"),
        (k % 3 == 0).alias("pains_pass"), (1.0 + k % 10).alias("sa_score"), F.when(k % 11 != 0, F.col("p_retailprice")).alias("activity"),
    )


def fingerprints(spark: SparkSession, d: str) -> DataFrame:
    """embeddings as fingerprints of one word: the signs of 64 values."""
    return read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", S.pack_signs(F.col("embedding"), 64).alias("fp"), "embedding")


def sparse_codes(spark: SparkSession, d: str) -> DataFrame:
    """embeddings as codes of 256 bits: place and rank (in pairs) of the 8 largest values."""
    return read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), S.pack_positions(S.ranked_positions(F.col("embedding"), 8, 2), 4).alias("fp"))


_FP_SQL = "f AS (SELECT vec_id AS id, label, [x > 0 FOR x IN embedding] AS b, len(list_filter(embedding, lambda x: x > 0)) AS n FROM embeddings)"
_COMMON = "len([1 FOR i IN range(1, 65) IF {a}.b[i] AND {b}.b[i]])"


# --- curation --------------------------------------------------------------------------------


@query(f"WITH {_MEASURE_SQL} SELECT source_index, compound, standard_relation FROM m WHERE trim(standard_relation) IN ('=', '<')")
def relation_filter(spark, d):
    return C.filter_relation(measurements(spark, d), ("=", "<")).select("source_index", "compound", "standard_relation")


_NM = "try_cast(standard_value AS DOUBLE) * CASE standard_units WHEN 'M' THEN 1e9 WHEN 'mM' THEN 1e6 WHEN 'uM' THEN 1e3 WHEN 'nM' THEN 1.0 WHEN 'pM' THEN 1e-3 END"


@query(f"WITH {_MEASURE_SQL}, v AS (SELECT source_index, compound, {_NM} AS standard_value FROM m) SELECT source_index, compound, standard_value, 'nM' AS standard_units FROM v WHERE standard_value IS NOT NULL")
def normalize_units(spark, d):
    return C.normalize_units(measurements(spark, d)).select("source_index", "compound", "standard_value", "standard_units")


_CONF = "round(CASE WHEN trim(standard_relation) = '=' THEN 0.4 ELSE 0 END + CASE WHEN try_cast(pchembl_value AS DOUBLE) IS NOT NULL THEN 0.3 ELSE 0 END + CASE WHEN assay_type = 'B' THEN 0.2 ELSE 0 END + CASE WHEN standard_units = 'nM' THEN 0.1 ELSE 0 END, 2)::DOUBLE"


@query(f"WITH {_MEASURE_SQL} SELECT source_index, compound, {_CONF} AS confidence_score FROM m")
def confidence_score(spark, d):
    return C.with_confidence(measurements(spark, d)).select("source_index", "compound", "confidence_score")


@query(
    f"WITH {_MEASURE_SQL}, v AS (SELECT *, {_NM} AS nm FROM m), w AS (SELECT * REPLACE ('nM' AS standard_units) FROM v WHERE trim(standard_relation) = '=' AND nm IS NOT NULL), c AS (SELECT *, {_CONF} AS confidence_score FROM w), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY compound ORDER BY confidence_score DESC, source_index, l_extendedprice, l_suppkey) AS rn, median(nm) OVER (PARTITION BY compound) AS standard_value2, count(*) OVER (PARTITION BY compound) AS n_measurements FROM c) "
    "SELECT compound, standard_value2 AS standard_value, n_measurements, source_index, l_suppkey, confidence_score FROM r WHERE rn = 1"
)
def curate_pipeline(spark, d):
    out = C.curate(measurements(spark, d), key="compound", order=("source_index", "l_extendedprice", "l_suppkey")).data
    return out.select("compound", "standard_value", "n_measurements", "source_index", "l_suppkey", "confidence_score")


@query(
    "WITH r AS (SELECT l_partkey, l_extendedprice, l_tax, l_orderkey, l_linenumber, l_suppkey, row_number() OVER (PARTITION BY l_partkey ORDER BY l_tax DESC, l_orderkey, l_linenumber, l_suppkey, l_extendedprice) AS rn FROM lineitem), "
    "a AS (SELECT l_partkey, median(l_extendedprice) AS value, count(*) AS n_measurements FROM lineitem GROUP BY 1) SELECT l_partkey, value, n_measurements, l_orderkey, l_suppkey FROM a JOIN r USING (l_partkey) WHERE rn = 1"
)
def dedup_median(spark, d):
    rows = read(spark, d, "lineitem").select("l_partkey", F.col("l_extendedprice").alias("value"), F.col("l_tax").alias("confidence_score"), "l_orderkey", "l_linenumber", "l_suppkey", F.col("l_extendedprice").alias("price"))
    return C.deduplicate(rows, "l_partkey", "value", order=("l_orderkey", "l_linenumber", "l_suppkey", "price")).select("l_partkey", "value", "n_measurements", "l_orderkey", "l_suppkey")


@query(
    "WITH x AS (SELECT list_sort(list(log10(l_extendedprice))) AS v, count(*) AS n FROM lineitem WHERE l_extendedprice > 0), q AS (SELECT v[n // 4 + 1] AS q1, v[3 * n // 4 + 1] AS q3 FROM x) "
    "SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem, q WHERE l_extendedprice > 0 AND log10(l_extendedprice) BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)"
)
def iqr_outliers(spark, d):
    return C.remove_outliers(read(spark, d, "lineitem"), "l_extendedprice").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")


_PIC = 'round(CASE WHEN v <= 0 THEN 0.0 ELSE 9 - log10(v) END, 4)::DOUBLE AS "pIC50"'


@query(f"WITH x AS (SELECT p_partkey, p_retailprice * p_size / 20 - 100 AS v FROM part) SELECT p_partkey, {_PIC}, CASE WHEN v < 1000 THEN 1 ELSE 0 END AS activity_class, CASE WHEN v < 1000 THEN 'active' ELSE 'inactive' END AS activity_label FROM x")
def label_binary(spark, d):
    rows = read(spark, d, "part").select("p_partkey", (F.col("p_retailprice") * F.col("p_size") / 20 - 100).alias("standard_value"))
    return C.label(rows).drop("standard_value")


@query(
    f"WITH x AS (SELECT p_partkey, p_retailprice * p_size / 20 - 100 AS v FROM part) SELECT p_partkey, {_PIC}, CASE WHEN v < 500 THEN 1 WHEN v >= 1500 THEN -1 ELSE 0 END AS activity_class, CASE WHEN v < 500 THEN 'active' WHEN v >= 1500 THEN 'inactive' ELSE 'intermediate' END AS activity_label FROM x"
)
def label_ternary(spark, d):
    rows = read(spark, d, "part").select("p_partkey", (F.col("p_retailprice") * F.col("p_size") / 20 - 100).alias("standard_value"))
    return C.label(rows, "ternary", 500, 1500).drop("standard_value")


# --- rules, scores, ranking ------------------------------------------------------------------

_V = '((coalesce("MolWt" > 500, false))::INT + ("LogP" > 5)::INT + ("HBD" > 5)::INT + ("HBA" > 10)::INT)'
_VEB = '(NOT ("TPSA" > 140 OR "RotatableBonds" > 10))'


@query(f"WITH {_PROPS_SQL} SELECT id, {_V} AS lipinski_violations, {_V} <= 1 AS lipinski_pass, {_VEB} AS veber_pass FROM p")
def rule_filter(spark, d):
    return R.filter_rules(properties(spark, d), veber=True, pains=False).select("id", "lipinski_violations", "lipinski_pass", "veber_pass")


@query(f"WITH {_PROPS_SQL} SELECT id FROM p WHERE {_V} <= 1 AND {_VEB}")
def rule_filter_removed(spark, d):
    return R.filter_rules(properties(spark, d), veber=True, pains=False, remove=True).select("id")


@query(f'WITH {_PROPS_SQL} SELECT id, coalesce("MolWt" BETWEEN 160 AND 480, false) AND "LogP" BETWEEN -0.4 AND 5.6 AND id % 90 BETWEEN 20 AND 70 AND CAST(id % 150 AS DOUBLE) BETWEEN 40 AND 130 AS ghose_pass FROM p')
def ghose_filter(spark, d):
    rows = properties(spark, d).withColumn("HeavyAtomCount", F.col("id") % 90).withColumn("MolMR", (F.col("id") % 150).cast("double"))
    return rows.select("id", rules.ghose().alias("ghose_pass"))


@query(
    f"""WITH {_PROPS_SQL}, c AS (SELECT id, "MolWt" AS mw, "LogP" AS lp, "TPSA" AS tp, "RotatableBonds" AS rb, "AromaticRings" AS ar, {_V} AS v, {_VEB} AS veb,
  CASE id % 4 WHEN 0 THEN [] WHEN 1 THEN ['furan'] ELSE ['furan', 'thiophene'] END AS cyp, CASE WHEN id % 3 = 0 THEN ['x'] ELSE [] END AS herg FROM p),
s AS (SELECT *, 1 - 0.25 * (coalesce(mw > 500, false)::INT + (lp > 3)::INT + (rb > 7)::INT + (ar > 3)::INT) AS stab, 0.155 * lp - 0.01 * tp + 0.164 AS bb,
  0.3 * CASE WHEN v <= 1 THEN 1.0 WHEN v = 2 THEN 0.5 ELSE 0 END + 0.3 * CASE WHEN veb THEN 1.0 ELSE 0 END + 0.2 * CASE WHEN lp BETWEEN -0.4 AND 5.6 THEN 1.0 ELSE 0 END + 0.2 * CASE WHEN tp < 90 THEN 1.0 WHEN tp < 140 THEN 0.5 ELSE 0 END AS oral,
  coalesce(lp > 3.7 AND mw > 400, false) AS fat FROM c),
r AS (SELECT *, CASE WHEN tp < 90 THEN 1 WHEN tp < 140 THEN 0.5 ELSE 0 END AS r_caco, CASE WHEN v <= 1 AND veb AND tp < 140 THEN 1 WHEN v <= 2 AND tp < 140 THEN 0.5 ELSE 0 END AS r_hia, CASE WHEN coalesce(mw > 400 AND tp > 75, false) THEN 0.5 ELSE 1 END AS r_pgp,
  CASE WHEN abs(bb) > 0.3 THEN 1 ELSE 0.5 END AS r_bbb, CASE WHEN lp > 3 THEN 0.5 ELSE 1 END AS r_ppb, CASE WHEN lp < 1 THEN 1 WHEN lp < 3 THEN 1 ELSE 0.5 END AS r_vod, CASE len(cyp) WHEN 0 THEN 1 WHEN 1 THEN 0.5 ELSE 0 END AS r_cyp,
  CASE WHEN coalesce(mw < 500 AND lp < 2, false) THEN 1 ELSE 0.5 END AS r_ren, CASE WHEN stab >= 0.75 AND mw < 400 THEN 1 WHEN stab < 0.5 AND mw > 500 THEN 0.5 ELSE 1 END AS r_half,
  CASE WHEN fat AND len(herg) > 0 THEN 0 WHEN fat OR len(herg) > 0 THEN 0.5 ELSE 1 END AS r_herg, CASE WHEN mw < 400 AND lp BETWEEN 1 AND 4 AND tp < 120 THEN 1 WHEN mw > 600 OR lp > 5 OR lp < -1 THEN 0.5 ELSE 1 END AS r_mrdd FROM s),
t AS (SELECT id, (r_caco + r_hia + r_pgp + oral) / 4 AS a, (r_bbb + r_ppb + r_vod) / 3 AS dd, (r_cyp + stab) / 2 AS m, (r_ren + r_half) / 2 AS e, (r_herg + 1 + 1 + r_mrdd) / 4 AS x FROM r)
SELECT id, CAST(round(0.25 * a + 0.15 * dd + 0.2 * m + 0.1 * e + 0.3 * x + 1e-6, 1) AS DOUBLE) AS score, CASE WHEN round(0.25 * a + 0.15 * dd + 0.2 * m + 0.1 * e + 0.3 * x, 3) >= 0.7 THEN 'favorable' WHEN round(0.25 * a + 0.15 * dd + 0.2 * m + 0.1 * e + 0.3 * x, 3) >= 0.4 THEN 'moderate' ELSE 'poor' END AS admet_class FROM t"""
)
def admet(spark, d):
    rows = properties(spark, d)
    k = F.col("id")
    rows = rows.withColumn("cyp_alerts", F.when(k % 4 == 0, F.array().cast("array<string>")).when(k % 4 == 1, F.array(F.lit("furan"))).otherwise(F.array(F.lit("furan"), F.lit("thiophene"))))
    rows = rows.withColumn("herg_alerts", F.when(k % 3 == 0, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>")))
    return rules.with_admet(rows).select("id", F.round(F.col("admet_score") + 1e-6, 1).alias("score"), "admet_class")


_ADMET_SQL = f"""WITH {_PROPS_SQL}, c AS (SELECT id, "MolWt" AS mw, "LogP" AS lp, "TPSA" AS tp, "RotatableBonds" AS rb, "AromaticRings" AS ar, {_V} AS v, {_VEB} AS veb,
  id % 4 AS n_cyp, id % 3 = 0 AS herg, id % 3 AS n_ames, id % 4 AS n_hep FROM p),
s AS (SELECT *, 1 - 0.25 * (coalesce(mw > 500, false)::INT + (lp > 3)::INT + (rb > 7)::INT + (ar > 3)::INT) AS stab, 0.155 * lp - 0.01 * tp + 0.164 AS bb,
  0.3 * CASE WHEN v <= 1 THEN 1.0 WHEN v = 2 THEN 0.5 ELSE 0 END + 0.3 * CASE WHEN veb THEN 1.0 ELSE 0 END + 0.2 * CASE WHEN lp BETWEEN -0.4 AND 5.6 THEN 1.0 ELSE 0 END + 0.2 * CASE WHEN tp < 90 THEN 1.0 WHEN tp < 140 THEN 0.5 ELSE 0 END AS oral,
  coalesce(lp > 3.7 AND mw > 400, false) AS fat FROM c)
SELECT id, CASE WHEN tp < 90 THEN 'high' WHEN tp < 140 THEN 'moderate' ELSE 'low' END AS caco2_class, CASE WHEN v <= 1 AND veb AND tp < 140 THEN 'high' WHEN v <= 2 AND tp < 140 THEN 'moderate' ELSE 'low' END AS hia_class,
  coalesce(mw > 400 AND tp > 75, false) AS pgp_substrate, round(oral, 9)::DOUBLE AS bioavailability_score, round(CAST(CAST(bb AS VARCHAR) AS DECIMAL(38, 20)), 3)::DOUBLE AS log_bb, bb > 0 AS bbb_penetrant, CASE WHEN abs(bb) > 0.3 THEN 'green' ELSE 'yellow' END AS bbb_risk,
  CASE WHEN lp > 3 THEN 'high' WHEN lp > 1 THEN 'moderate' ELSE 'low' END AS ppb_class, CASE WHEN lp < 1 THEN 'low' WHEN lp < 3 THEN 'moderate' ELSE 'high' END AS vod_class,
  CASE n_cyp WHEN 0 THEN 'low' WHEN 1 THEN 'moderate' ELSE 'high' END AS cyp_class, stab::DOUBLE AS metabolic_stability_score, CASE WHEN stab >= 0.75 THEN 'high' WHEN stab >= 0.5 THEN 'moderate' ELSE 'low' END AS metabolic_class,
  coalesce(mw < 500 AND lp < 2, false) AS renal_clearance, CASE WHEN stab >= 0.75 AND mw < 400 THEN 'short' WHEN stab < 0.5 AND mw > 500 THEN 'long' ELSE 'medium' END AS halflife_class,
  fat OR herg AS herg_liability, CASE WHEN fat AND herg THEN 'red' WHEN fat OR herg THEN 'yellow' ELSE 'green' END AS herg_risk, herg::INT + fat::INT AS n_herg_alerts, CASE n_ames WHEN 0 THEN 'green' WHEN 1 THEN 'yellow' ELSE 'red' END AS ames_risk, CASE WHEN n_hep = 0 THEN 'green' WHEN n_hep <= 2 THEN 'yellow' ELSE 'red' END AS hepatotox_risk,
  CASE WHEN mw < 400 AND lp BETWEEN 1 AND 4 AND tp < 120 THEN 'low_dose' WHEN mw > 600 OR lp > 5 OR lp < -1 THEN 'high_dose' ELSE 'moderate_dose' END AS mrdd_class FROM s"""


@query(_ADMET_SQL)
def admet_predictors(spark, d):
    """Every predictor's own columns, with arrays of as many alerts as the id's remainders say."""
    some = lambda n: F.slice(F.array(*[F.lit(f"alert{i}") for i in range(3)]), F.lit(1), n)
    k = F.col("id")
    rows = properties(spark, d).withColumns({"cyp_alerts": some((k % 4).cast("int")), "herg_alerts": some((k % 3 == 0).cast("int")), "ames_alerts": some((k % 3).cast("int")), "hepatotox_alerts": some((k % 4).cast("int"))})
    out = rules.with_admet(rows)
    names = ("caco2_class", "hia_class", "pgp_substrate", "log_bb", "bbb_penetrant", "bbb_risk", "ppb_class", "vod_class", "cyp_class", "metabolic_stability_score", "metabolic_class", "renal_clearance", "halflife_class", "herg_liability", "herg_risk", "ames_risk", "hepatotox_risk", "mrdd_class")
    return out.select("id", F.round("admet_bioavailability_score", 9).alias("bioavailability_score"), F.size("admet_herg_alerts").alias("n_herg_alerts"), *[F.col(f"admet_{n}").alias(n) for n in names])


@query(f"""WITH {_PROPS_SQL} SELECT 'caco2' AS flag, count(*) AS n FROM p WHERE "TPSA" >= 140 UNION ALL SELECT 'hia', count(*) FROM p WHERE NOT ({_V} <= 2 AND "TPSA" < 140)""")
def liabilities(spark, d):
    rows = rules.with_admet(properties(spark, d)).select(F.col("admet_caco2_risk").alias("caco2"), F.col("admet_hia_risk").alias("hia"))
    return T.liabilities(rows, ["caco2", "hia"])


_DL = '(CASE WHEN "QED" IS NULL THEN 0 ELSE 0.4 * "QED" END + 0.3 * lip::INT + 0.2 * pains_pass::INT + 0.1 * veb::INT) / (CASE WHEN "QED" IS NULL THEN 0 ELSE 0.4 END + 0.3 + 0.2 + 0.1)'
_COMP = (
    f"WITH {_PROPS_SQL}, q AS (SELECT *, {_V} <= 1 AS lip, {_VEB} AS veb FROM p), s AS (SELECT *, {_DL} AS drug_likeness, greatest(0, least(1, (10 - sa_score) / 9)) AS san, (activity - min(activity) OVER ()) / (max(activity) OVER () - min(activity) OVER ()) AS act FROM q), "
    "c AS (SELECT id, drug_likeness, sa_score, san AS sa_score_normalized, (CASE WHEN act IS NULL THEN 0 ELSE 0.4 * act END + 0.3 * drug_likeness + 0.3 * san) / (CASE WHEN act IS NULL THEN 0 ELSE 0.4 END + 0.3 + 0.3) AS composite_score FROM s) "
)


def scored_molecules(spark, d) -> DataFrame:
    rows = R.filter_rules(properties(spark, d), veber=True, pains=False)
    rows = rows.withColumn("drug_likeness", scores.drug_likeness()).withColumn("sa_score_normalized", scores.sa_normalized(F.col("sa_score"))).withColumnRenamed("activity", "predicted_activity")
    return R.composite(rows, normalize="predicted_activity")


@query(_COMP + "SELECT id, round(drug_likeness, 9) AS drug_likeness, round(sa_score_normalized, 9)::DOUBLE AS sa_score_normalized, round(composite_score, 9) AS composite_score FROM c")
def composite_score(spark, d):
    return scored_molecules(spark, d).select("id", *[F.round(c, 9).alias(c) for c in ("drug_likeness", "sa_score_normalized", "composite_score")])


@query(_COMP + "SELECT id, row_number() OVER (ORDER BY round(composite_score, 9) DESC, id) AS rank FROM c")
def rank_all(spark, d):
    rows = scored_molecules(spark, d).select("id", F.round("composite_score", 9).alias("composite_score"))
    return R.rank(rows, tie=("id",)).select("id", "rank")


@query(_COMP + "SELECT id, row_number() OVER (ORDER BY round(composite_score, 9) DESC, id) AS rank, round(composite_score, 9) AS composite_score FROM c QUALIFY rank <= 50")
def top_candidates(spark, d):
    rows = scored_molecules(spark, d).select("id", F.round("composite_score", 9).alias("composite_score"))
    return R.top(rows, 50, tie=("id",))


@query(_COMP + "SELECT id, round(composite_score, 9) BETWEEN 0.5 AND 1 AND round(drug_likeness, 9) BETWEEN 0.4 AND 1 AND sa_score BETWEEN 1 AND 6 AS is_candidate FROM c")
def flag_candidates(spark, d):
    rows = scored_molecules(spark, d).withColumns({c: F.round(c, 9) for c in ("composite_score", "drug_likeness")})
    return R.flag_candidates(rows).select("id", "is_candidate")


@query("SELECT p_partkey, (p_retailprice - min(p_retailprice) OVER ()) / (max(p_retailprice) OVER () - min(p_retailprice) OVER ()) AS scaled FROM part")
def minmax(spark, d):
    return R.min_max(read(spark, d, "part"), "p_retailprice", "scaled").select("p_partkey", "scaled")


@query("SELECT c_custkey, c_acctbal BETWEEN 0 AND 5000 AS ok FROM customer")
def range_flag(spark, d):
    return read(spark, d, "customer").select("c_custkey", scores.within({"c_acctbal": (0, 5000)}).alias("ok"))


@query("SELECT doc_id, CASE WHEN a AND b THEN 1.0::DOUBLE ELSE 0.5 END AS match_ratio FROM (SELECT doc_id, regexp_matches(text, 'the [a-z]+ing') AS a, regexp_matches(text, '[0-9]{3}') AS b FROM documents) WHERE a OR b")
def multi_pattern(spark, d):
    return R.screen_patterns(read(spark, d, "documents"), "text", {"ing": "the [a-z]+ing", "digits": "[0-9]{3}"}).select("doc_id", "match_ratio")


@query("SELECT doc_id FROM documents WHERE NOT regexp_matches(text, 'the [a-z]+ing')")
def pattern_exclude(spark, d):
    return R.screen_patterns(read(spark, d, "documents"), "text", {"ing": "the [a-z]+ing"}, exclude=True).select("doc_id")


@query(f'WITH {_PROPS_SQL} SELECT id, (("HBD" >= 2)::INT + ("HBA" >= 3)::INT) / 2.0 AS pharm_ratio FROM p WHERE "HBD" >= 2 OR "HBA" >= 3')
def pharmacophore(spark, d):
    return R.screen_counts(properties(spark, d), {"HBD": 2, "HBA": 3}, match_all=False).select("id", "pharm_ratio")


# --- pairs -----------------------------------------------------------------------------------


@query(f"WITH {_FP_SQL}, q AS (SELECT * FROM f WHERE id = 0), s AS (SELECT f.id, f.n AS na, q.n AS nb, {_COMMON.format(a='f', b='q')} AS c FROM f, q) SELECT id, c / (na + nb - c) AS similarity FROM s ORDER BY similarity DESC, id LIMIT 10")
def tanimoto_topk(spark, d):
    fps = fingerprints(spark, d)
    return P.nearest(fps, fps.where("id = 0"), 10, words=1)


@query(f"WITH {_FP_SQL}, s AS (SELECT a.id AS a, b.id AS b, a.n AS na, b.n AS nb, {_COMMON.format(a='a', b='b')} AS c FROM f a JOIN f b ON a.id < b.id) SELECT a, b, c / (na + nb - c) AS similarity FROM s WHERE c / (na + nb - c) >= 0.6")
def similarity_pairs(spark, d):
    return P.similarity_pairs(fingerprints(spark, d), 0.6, words=1)


_SPARSE_SQL = "g AS (SELECT vec_id AS id, list_grade_up([-x::DOUBLE for x in embedding]) AS o FROM embeddings), f AS (SELECT id, [(o[k] - 1) * 4 + (k - 1) // 2 for k in range(1, 9)] AS b FROM g)"


@query(f"WITH {_SPARSE_SQL}, s AS (SELECT a.id AS a, b.id AS b, len(list_intersect(a.b, b.b)) AS c FROM f a JOIN f b ON a.id < b.id) SELECT a, b, c / (16 - c) AS similarity FROM s WHERE c / (16 - c) >= 0.3")
def similarity_pairs_sparse(spark, d):
    """Pairs through the rarest bits of codes of 256 bits, 8 of them set."""
    return P.similarity_pairs(sparse_codes(spark, d), 0.3, words=4, by="prefix")


@query(
    f"WITH {_FP_SQL}, s AS (SELECT q.id AS q, f.id, f.n AS na, q.n AS nb, {_COMMON.format(a='f', b='q')} AS c FROM f, f q WHERE q.id % 20 = 0), "
    "r AS (SELECT q, id, c / (na + nb - c) AS similarity FROM s) SELECT *, row_number() OVER (PARTITION BY q ORDER BY similarity DESC, id) AS place FROM r QUALIFY place <= 10"
)
def similarity_topk(spark, d):
    """The ten most similar rows of every 20th row, over a stored index."""
    fps = fingerprints(spark, d)
    index = search.Index(spark, search.write_index(fps, words=1), words=1)
    return index.search(fps.where("id % 20 = 0"), 10)


_SCREEN = f"WITH {_FP_SQL}, r AS (SELECT * FROM f WHERE label = 0), s AS (SELECT f.id, f.n AS na, r.n AS nb, {_COMMON.format(a='f', b='r')} AS c FROM f, r) "


@query(_SCREEN + "SELECT id, max(c / (na + nb - c)) AS similarity FROM s GROUP BY id HAVING max(c / (na + nb - c)) >= 0.5")
def similarity_screen_max(spark, d):
    fps = fingerprints(spark, d)
    return P.screen_similarity(fps, fps.where("label = 0"), 0.5, words=1)


@query(_SCREEN + "SELECT id, round(avg(2 * c / (na + nb)), 9) AS similarity FROM s GROUP BY id HAVING avg(2 * c / (na + nb)) >= 0.5")
def similarity_screen_mean(spark, d):
    fps = fingerprints(spark, d)
    return P.screen_similarity(fps, fps.where("label = 0"), 0.5, metric="dice", how="mean", words=1).withColumn("similarity", F.round("similarity", 9))


@query("WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0) SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], e::DOUBLE[]), 9) AS similarity FROM embeddings, q ORDER BY similarity DESC, vec_id LIMIT 10")
def cosine_topk(spark, d):
    rows = read(spark, d, "embeddings")
    q = rows.where("vec_id = 0").select(F.col("embedding").alias("e"))
    near = rows.crossJoin(F.broadcast(q)).select("vec_id", F.round(S.cosine(F.col("embedding"), F.col("e")), 9).alias("similarity"))
    return near.orderBy(F.col("similarity").desc(), "vec_id").limit(10)


@query(
    f"WITH {_FP_SQL}, s AS (SELECT a.n AS na, b.n AS nb, {_COMMON.format(a='a', b='b')} AS c FROM f a JOIN f b ON a.id < b.id), t AS (SELECT c / (na + nb - c) AS s FROM s WHERE c / (na + nb - c) >= 0.5) "
    "SELECT count(*) AS n_pairs, round(avg(s), 9) AS mean, median(s) AS median, min(s) AS min, max(s) AS max, round(stddev_pop(s), 9) AS std, round(1 - avg(s), 9) AS diversity FROM t"
)
def pairwise_diversity(spark, d):
    out = P.all_pairs_diversity(fingerprints(spark, d), words=1, threshold=0.5)
    return out.withColumns({c: F.round(c, 9) for c in ("mean", "std", "diversity")})


@query(
    f"WITH {_FP_SQL}, s AS (SELECT a.n AS na, b.n AS nb, {_COMMON.format(a='a', b='b')} AS c FROM f a JOIN f b ON a.id < b.id), t AS (SELECT c / (na + nb - c) AS s FROM s) "
    "SELECT count(*) AS n_pairs, round(avg(s), 9) AS mean, median(s) AS median, min(s) AS min, max(s) AS max, round(stddev_pop(s), 9) AS std, round(1 - avg(s), 9) AS diversity FROM t"
)
def pairwise_diversity_all(spark, d):
    out = P.all_pairs_diversity(fingerprints(spark, d), words=1)
    return out.withColumns({c: F.round(c, 9) for c in ("mean", "std", "diversity")})


_ATOMS_SQL = "t AS (SELECT vec_id AS atom, label AS mol, embedding[1]::DOUBLE * 20 AS x, embedding[2]::DOUBLE * 20 AS y, embedding[3]::DOUBLE * 20 AS z, CASE vec_id % 4 WHEN 0 THEN 'C' WHEN 1 THEN 'N' WHEN 2 THEN 'O' ELSE 'S' END AS element, vec_id % 2 AS hydrogens, vec_id % 3 - 1 AS charge FROM embeddings), l AS (SELECT * FROM t WHERE mol < 5), r AS (SELECT * FROM t WHERE mol >= 5)"


def atoms(spark, d) -> tuple[DataFrame, DataFrame]:
    e, v = F.col("embedding"), F.col("vec_id")
    t = read(spark, d, "embeddings").select(
        v.alias("atom"), F.col("label").alias("mol"), *[(F.get(e, F.lit(i)).cast("double") * 20).alias(c) for i, c in enumerate("xyz")],
        F.when(v % 4 == 0, "C").when(v % 4 == 1, "N").when(v % 4 == 2, "O").otherwise("S").alias("element"), (v % 2).alias("hydrogens"), (v % 3 - 1).alias("charge"), F.floor(v / 6).alias("ring"), (v % 6).alias("ring_position"), (v % 5 != 0).alias("aromatic"),
    )
    return t.where("mol < 5"), t.where("mol >= 5")


_DIST = "sqrt((l.x - r.x) * (l.x - r.x) + (l.y - r.y) * (l.y - r.y) + (l.z - r.z) * (l.z - r.z))"


@query(f"WITH {_ATOMS_SQL} SELECT l.atom AS l_atom, r.atom AS r_atom, round({_DIST}, 9) AS distance FROM l, r WHERE l.element = 'C' AND r.element = 'C' AND {_DIST} <= 4.5")
def contacts_hydrophobic(spark, d):
    return P.hydrophobic(*atoms(spark, d)).select("l_atom", "r_atom", F.round("distance", 9).alias("distance"))


_HB = "CASE WHEN l.element IN ('N', 'O') AND l.hydrogens > 0 AND r.element IN ('N', 'O', 'S') THEN 'ligand_donor' WHEN r.element IN ('N', 'O') AND r.hydrogens > 0 AND l.element IN ('N', 'O', 'S') THEN 'ligand_acceptor' END"


@query(f"WITH {_ATOMS_SQL} SELECT l.atom AS l_atom, r.atom AS r_atom, {_HB} AS type FROM l, r WHERE l.element <> 'C' AND r.element <> 'C' AND {_DIST} <= 3.5 AND {_HB} IS NOT NULL")
def contacts_hbonds(spark, d):
    return P.hbonds(*atoms(spark, d)).select("l_atom", "r_atom", "type")


@query(f"WITH {_ATOMS_SQL} SELECT l.atom AS l_atom, r.atom AS r_atom FROM l, r WHERE l.charge * r.charge < 0 AND {_DIST} <= 4.0")
def contacts_salt_bridges(spark, d):
    return P.salt_bridges(*atoms(spark, d)).select("l_atom", "r_atom")


@query(
    f"WITH {_ATOMS_SQL}, c AS (SELECT l.mol, {_HB} AS type FROM l, r WHERE l.element <> 'C' AND r.element <> 'C' AND {_DIST} <= 3.5 UNION ALL SELECT l.mol, 'hydrophobic' FROM l, r WHERE l.element = 'C' AND r.element = 'C' AND {_DIST} <= 4.5 UNION ALL SELECT l.mol, 'salt_bridge' FROM l, r WHERE l.charge * r.charge < 0 AND {_DIST} <= 4.0) "
    "SELECT mol, count(*) FILTER (type = 'ligand_donor') AS n_ligand_donor, count(*) FILTER (type = 'ligand_acceptor') AS n_ligand_acceptor, count(*) FILTER (type = 'hydrophobic') AS n_hydrophobic, count(*) FILTER (type = 'salt_bridge') AS n_salt_bridge FROM c WHERE type IS NOT NULL GROUP BY mol"
)
def plif(spark, d):
    a, b = atoms(spark, d)
    found = P.contacts(a, b).where("type <> 'pi_stacking'")
    return P.plif(found).select("mol", "n_ligand_donor", "n_ligand_acceptor", "n_hydrophobic", "n_salt_bridge")


@query(f"WITH {_ATOMS_SQL} SELECT mol, round((min(x) + max(x)) / 2, 9) AS center_x, round(max(x) - min(x) + 20, 9) AS size_x, max(x) - min(x) + 20 BETWEEN 5 AND 200 AND max(y) - min(y) + 20 BETWEEN 5 AND 200 AND max(z) - min(z) + 20 BETWEEN 5 AND 200 AS valid FROM t GROUP BY mol")
def docking_box(spark, d):
    a, b = atoms(spark, d)
    boxes = a.unionByName(b).groupBy("mol").agg(*G.box())
    return boxes.select("mol", F.round("center_x", 9).alias("center_x"), F.round("size_x", 9).alias("size_x"), G.valid_box().alias("valid"))


# --- sets, summaries, statistics -------------------------------------------------------------


@query("SELECT count(*) AS n, count(text) / count(*) AS validity, count(DISTINCT text) / count(text) AS uniqueness, count(*) FILTER (text IS NOT NULL AND text NOT IN (SELECT text FROM benchmark WHERE text IS NOT NULL)) / count(text) AS novelty FROM documents")
def generation_metrics(spark, d):
    return T.generation_metrics(read(spark, d, "documents"), read(spark, d, "benchmark"), "text")


@query(
    "WITH g AS (SELECT DISTINCT text FROM documents WHERE text IS NOT NULL), v AS (SELECT text FROM g EXCEPT SELECT text FROM benchmark) SELECT (SELECT count(*) FROM benchmark) AS n_original, (SELECT count(*) FROM documents) AS n_generated, (SELECT count(*) FROM g) AS n_unique, (SELECT count(*) FROM v) AS n_novel, "
    "(SELECT count(*) FROM g) / (SELECT count(*) FROM documents) AS uniqueness_rate, (SELECT count(*) FROM v) / (SELECT count(*) FROM g) AS novelty_rate"
)
def generation_summary(spark, d):
    return T.generation_summary(read(spark, d, "benchmark"), read(spark, d, "documents"), "text")


@query("SELECT w AS fragment, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(string_split(text, ' ')) AS w FROM documents) GROUP BY w HAVING count(*) >= 2 ORDER BY n DESC, fragment LIMIT 500")
def fragment_library(spark, d):
    return T.fragment_library(read(spark, d, "documents").select(F.split("text", " ").alias("w")), "w")


_SUM_COLS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def _summary_sql(std: str) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS property, count({c}) AS count, round(avg({c}), 6) AS mean, round({std}({c}), 6) AS std, min({c}) AS min, max({c}) AS max, median({c}) AS median FROM lineitem" for c in _SUM_COLS)


@query(_summary_sql("stddev_pop"))
def dataset_summary(spark, d):
    return T.numeric_summary(read(spark, d, "lineitem"), _SUM_COLS).withColumns({c: F.round(c, 6) for c in ("mean", "std")})


@query(_summary_sql("stddev_samp"))
def candidate_stats(spark, d):
    return T.numeric_summary(read(spark, d, "lineitem"), _SUM_COLS, sample=True).withColumns({c: F.round(c, 6) for c in ("mean", "std")})


@query(f"WITH {_PROPS_SQL} SELECT 'lipinski_pass' AS flag, avg(({_V} <= 1)::INT) AS rate FROM p UNION ALL SELECT 'veber_pass', avg({_VEB}::INT) FROM p")
def pass_rates(spark, d):
    return T.pass_rates(R.filter_rules(properties(spark, d), veber=True, pains=False), ["lipinski_pass", "veber_pass"])


@query("SELECT count(*) AS n, round(quantile_cont(c_acctbal, 0.25), 6) AS q1, round(median(c_acctbal), 6) AS median, round(quantile_cont(c_acctbal, 0.75), 6) AS q3, round(quantile_cont(c_acctbal, 0.75) - quantile_cont(c_acctbal, 0.25), 6) AS iqr FROM customer")
def quartiles(spark, d):
    return T.quartiles(read(spark, d, "customer"), "c_acctbal").select("n", *[F.round(c, 6).alias(c) for c in ("q1", "median", "q3", "iqr")])


@query("SELECT CASE WHEN c_acctbal <= 0 THEN 'strong' WHEN c_acctbal <= 5000 THEN 'moderate' ELSE 'weak' END AS tier, count(*) AS n FROM customer GROUP BY 1")
def tier_counts(spark, d):
    return T.tiers(read(spark, d, "customer"), "c_acctbal", (0, 5000), ("strong", "moderate", "weak"))


@query("WITH b AS (SELECT min(c_acctbal) AS lo, (max(c_acctbal) - min(c_acctbal)) / 50 AS w FROM customer) SELECT CAST(least(floor((c_acctbal - lo) / w), 49) AS INTEGER) AS bin, count(*) AS n FROM customer, b GROUP BY 1")
def histogram(spark, d):
    return T.histogram(read(spark, d, "customer"), "c_acctbal").select("bin", "n")


@query("WITH r AS (SELECT (rank() OVER (ORDER BY l_quantity)) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2 AS x, (rank() OVER (ORDER BY l_extendedprice)) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2 AS y FROM lineitem) SELECT round(corr(x, y), 9) AS rho, count(*) AS n FROM r")
def spearman(spark, d):
    return T.spearman(read(spark, d, "lineitem"), "l_quantity", "l_extendedprice").select(F.round("rho", 9).alias("rho"), "n")


@query(
    "WITH r AS (SELECT (rank() OVER (ORDER BY c_acctbal)) + (count(*) OVER (PARTITION BY c_acctbal) - 1) / 2 AS x, (rank() OVER (ORDER BY c_nationkey)) + (count(*) OVER (PARTITION BY c_nationkey) - 1) / 2 AS y FROM customer), "
    "c AS (SELECT corr(x, y) AS rho, count(*) AS n FROM r), t AS (SELECT *, (n - 2)::DOUBLE AS df, abs(rho) * sqrt((n - 2) / (1 - rho * rho)) / 4000 AS step FROM c), "
    "s AS (SELECT sum(CASE WHEN k IN (0, 4000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END * pow(1 + (k * step) * (k * step) / df, -(df + 1) / 2)) AS s FROM range(4001) g(k), t) "
    "SELECT round(rho, 9) AS rho, n, round(1 - 2 * exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(pi() * df) * s * step / 3, 8) AS p FROM t, s"
)
def spearman_p(spark, d):
    """The p-value too; in SQL it is the density of Student's t, integrated in steps."""
    found = T.spearman(read(spark, d, "customer"), "c_acctbal", "c_nationkey")
    return found.select(F.round("rho", 9).alias("rho"), "n", F.round("p", 8).alias("p"))


@query(
    "WITH m AS (SELECT count(c_acctbal) AS n, min(c_acctbal) AS lo, max(c_acctbal) AS hi, stddev_samp(c_acctbal) * pow(count(c_acctbal), -0.2) AS h FROM customer), g AS (SELECT *, lo - 3 * h AS start, (hi + 3 * h - (lo - 3 * h)) / 199 AS step FROM m), "
    "v AS (SELECT (c_acctbal - start) / step AS pos, least(floor((c_acctbal - start) / step), 198) AS i FROM customer, g WHERE c_acctbal IS NOT NULL), w AS (SELECT i, sum(w) AS w FROM (SELECT i, 1 - (pos - i) AS w FROM v UNION ALL SELECT i + 1, pos - i FROM v) GROUP BY i) "
    "SELECT CAST(k AS INTEGER) AS point, round(any_value(start + k * step), 6) AS x, round(sum(w * exp(-pow((k - i) * step / h, 2) / 2)) / any_value(n * h * sqrt(2 * pi())), 15) AS density FROM range(200) p(k), w, g GROUP BY k"
)
def density(spark, d):
    return T.density(read(spark, d, "customer"), "c_acctbal").select("point", F.round("x", 6).alias("x"), F.round("density", 15).alias("density"))


@query("SELECT round(regr_slope(l_extendedprice, l_quantity), 6) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept FROM lineitem")
def trend_line(spark, d):
    return T.trend(read(spark, d, "lineitem"), "l_quantity", "l_extendedprice").select(F.round("slope", 6).alias("slope"), F.round("intercept", 4).alias("intercept"))


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 9) AS r FROM lineitem" for i, a in enumerate(_SUM_COLS) for b in _SUM_COLS[i:]))
def correlation_matrix(spark, d):
    return T.correlations(read(spark, d, "lineitem"), _SUM_COLS).withColumn("r", F.round("r", 9))


@query(
    "WITH t AS (SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100), c AS (SELECT c_nationkey, c_name, c_acctbal, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS rn FROM customer) "
    "SELECT o_orderkey, o_custkey % 30 AS c_nationkey, c_name, c_acctbal FROM t LEFT JOIN c ON o_custkey % 30 = c_nationkey AND rn = 1"
)
def left_join_dedup(spark, d):
    t = read(spark, d, "orders").orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(100).select("o_orderkey", (F.col("o_custkey") % 30).cast("int").alias("c_nationkey"))
    return T.left_join_first(t, read(spark, d, "customer").select("c_nationkey", "c_custkey", "c_name", "c_acctbal"), "c_nationkey", ["c_custkey"]).drop("c_custkey").withColumn("c_nationkey", F.col("c_nationkey").cast("long"))


@query("SELECT role AS strategy, round(avg(turn), 4) AS avg_turn, round(max(turn), 4)::DOUBLE AS max_turn FROM conversations GROUP BY role")
def compare_strategies(spark, d):
    c = read(spark, d, "conversations").groupBy(F.col("role").alias("strategy")).agg(F.avg("turn").alias("avg_turn"), F.max("turn").cast("double").alias("max_turn"))
    long = c.unpivot("strategy", ["avg_turn", "max_turn"], "metric", "value")
    return T.compare_strategies(long)


@query("SELECT 'phase1_data' AS phase, count(*) AS n FROM events WHERE event_type LIKE '%v%' UNION ALL SELECT 'phase2_screening', count(*) FROM events WHERE event_type NOT LIKE '%v%'")
def provenance_phases(spark, d):
    steps = read(spark, d, "events").select(F.array(F.when(F.col("event_type").contains("v"), "validated").otherwise("sa_score")).alias("provenance"))
    return T.phases_applied(steps)


@query(
    "WITH b AS (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi, min(c_custkey) AS kl, max(c_custkey) AS kh FROM customer) SELECT c_custkey, CAST(round(0.6 * (1 - (c_acctbal - lo) / (hi - lo + 1e-9)) + 0.4 * ((c_custkey - kl) / (kh - kl + 1e-9)), 4) AS DOUBLE) AS composite_score FROM customer, b"
)
def report_ranking(spark, d):
    return T.report_ranking(read(spark, d, "customer"), {"c_acctbal": (0.6, True), "c_custkey": (0.4, False)}).select("c_custkey", "composite_score")


# --- modelling -------------------------------------------------------------------------------


@query("WITH h AS (SELECT vec_id, (((vec_id % 268435456) + 42) * 2654435761) % 4294967296 AS h FROM embeddings) SELECT vec_id, h < 858993459 AS is_test FROM h")
def random_split(spark, d):
    return M.random_split(read(spark, d, "embeddings"), "vec_id").select("vec_id", "is_test")


@query("SELECT vec_id, CAST((((((vec_id % 268435456) + 42) * 2654435761) % 4294967296) >> 8) % 5 AS INTEGER) AS fold FROM embeddings")
def folds(spark, d):
    return M.folds(read(spark, d, "embeddings"), "vec_id").select("vec_id", "fold")


@query(
    "WITH g AS (SELECT coalesce(source, '') AS g, count(*) AS n FROM documents GROUP BY 1), o AS (SELECT g, coalesce(sum(n) OVER (ORDER BY md5(g || ':42'), g ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM g) "
    "SELECT doc_id, before < (SELECT floor(count(*) * 0.2) FROM documents) AS is_test FROM documents JOIN o ON coalesce(source, '') = g"
)
def group_split(spark, d):
    return M.group_split(read(spark, d, "documents"), "source").select("doc_id", "is_test")


@query(
    "WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_retailprice END AS v FROM part) SELECT p_partkey, round(coalesce(v, avg(v) OVER ()), 9) AS v FROM p"
)
def feature_impute(spark, d):
    rows = read(spark, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 7 == 0, float("nan")).otherwise(F.col("p_retailprice")).alias("v"))
    return M.impute(rows, ["v"]).select("p_partkey", F.round("v", 9).alias("v"))


@query("SELECT p_partkey, round((p_size - avg(p_size) OVER ()) / stddev_pop(p_size) OVER (), 9) AS p_size FROM part")
def feature_scale(spark, d):
    return M.scale(read(spark, d, "part"), ["p_size"]).select("p_partkey", F.round("p_size", 9).alias("p_size"))


@query(
    "WITH e AS (SELECT l_extendedprice AS y, l_quantity * 1500.0 AS p FROM lineitem) SELECT count(*) AS n, round(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)), 6) AS r2, round(sqrt(avg((y - p) * (y - p))), 4) AS rmse, round(avg(abs(y - p)), 4) AS mae, round(corr(y, p), 6) AS pearson FROM e"
)
def regression_metrics(spark, d):
    rows = read(spark, d, "lineitem").select(F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1500.0).alias("p"))
    m = M.regression_metrics(rows, "y", "p")
    return m.select("n", F.round("r2", 6).alias("r2"), F.round("rmse", 4).alias("rmse"), F.round("mae", 4).alias("mae"), F.round("pearson", 6).alias("pearson"))


@query(
    "WITH c AS (SELECT count(*) FILTER (quality = 1 AND toxic = 1)::DOUBLE AS tp, count(*) FILTER (quality <> 1 AND toxic = 1)::DOUBLE AS fp, count(*) FILTER (quality = 1 AND toxic <> 1)::DOUBLE AS fn, count(*) FILTER (quality <> 1 AND toxic <> 1)::DOUBLE AS tn FROM labels) "
    "SELECT (tp + fp + fn + tn)::BIGINT AS n, round((tp + tn) / (tp + fp + fn + tn), 9) AS accuracy, round(tp / (tp + fp), 9) AS precision, round(tp / (tp + fn), 9) AS recall, round(2 * tp / (2 * tp + fp + fn), 9) AS f1, round((tp * tn - fp * fn) / (sqrt(tp + fp) * sqrt(tp + fn) * sqrt(tn + fp) * sqrt(tn + fn)), 9) AS mcc FROM c"
)
def classification_metrics(spark, d):
    m = M.classification_metrics(read(spark, d, "labels"), "quality", "toxic")
    return m.withColumns({c: F.round(c, 9) for c in ("accuracy", "precision", "recall", "f1", "mcc")})


_DIMS = ["x", "y", "z"]
def _farthest(rows: str, n: int) -> str:
    """Tables k0, k1, ... of the picks, and s0, s1, ... of each other row's distance to the nearest pick."""
    far = f"(SELECT 1 - CASE WHEN o.n + q.n > {_COMMON.format(a='o', b='q')} THEN {_COMMON.format(a='o', b='q')} / (o.n + q.n - {_COMMON.format(a='o', b='q')}) ELSE 0 END)"
    out = [f"k0 AS MATERIALIZED (SELECT min(id) AS pick FROM {rows})", f"s0 AS MATERIALIZED (SELECT o.id, {far} AS d FROM {rows} o, {rows} q WHERE q.id = (SELECT pick FROM k0) AND o.id <> q.id)"]
    for i in range(1, n):
        out.append(f"k{i} AS MATERIALIZED (SELECT id AS pick FROM s{i - 1} ORDER BY d DESC, id LIMIT 1)")
        out.append(f"s{i} AS MATERIALIZED (SELECT o.id, least(s.d, {far}) AS d FROM s{i - 1} s JOIN {rows} o ON o.id = s.id, {rows} q WHERE q.id = (SELECT pick FROM k{i}) AND o.id <> q.id)")
    return ", ".join(out)


def _picks(n: int) -> str:
    return " UNION ALL ".join(f"SELECT pick AS id, {i} AS turn FROM k{i}" for i in range(n))


_PTS = "p AS (SELECT vec_id, label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings)"


def points(spark, d) -> DataFrame:
    return read(spark, d, "embeddings").select("vec_id", "label", *[F.get("embedding", F.lit(i)).cast("double").alias(c) for i, c in enumerate(_DIMS)])


@query(
    f"WITH {_PTS}, c AS (SELECT avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM p WHERE label < 5), e AS (SELECT vec_id, label, sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy) + (z - cz) * (z - cz)) AS d FROM p, c), t AS (SELECT avg(d) + 3 * stddev_pop(d) AS lim FROM e WHERE label < 5) "
    "SELECT vec_id, round(d, 9) AS distance, d <= lim AS in_domain FROM e, t WHERE label >= 5"
)
def distance_domain(spark, d):
    rows = points(spark, d)
    out = M.distance_domain(rows.where("label < 5"), rows.where("label >= 5"), _DIMS)
    return out.select("vec_id", F.round("distance", 9).alias("distance"), "in_domain")


def _leverage_query(f):
    h = "(x * x * (d * f - e * e) + y * y * (a * f - c * c) + z * z * (a * d - b * b) + 2 * x * y * (c * e - b * f) + 2 * x * z * (b * e - c * d) + 2 * y * z * (b * c - a * e)) / (a * (d * f - e * e) - b * (b * f - c * e) + c * (b * e - c * d))"
    sums = "g AS (SELECT sum(x * x) AS a, sum(x * y) AS b, sum(x * z) AS c, sum(y * y) AS d, sum(y * z) AS e, sum(z * z) AS f, count(*) AS n FROM p WHERE label < 5)"
    return query(f"WITH {_PTS}, {sums} SELECT vec_id, round({h}, 7) AS leverage, {h} <= 9.0 / n AS in_domain FROM p, g WHERE label >= 5")(f)


@_leverage_query
def leverage_domain(spark, d):
    rows = points(spark, d)
    return M.leverage_domain(rows.where("label < 5"), rows.where("label >= 5"), _DIMS).select("vec_id", F.round("leverage", 7).alias("leverage"), "in_domain")


@query()
def leverage_wide(spark, d):
    """Leverage of all 64 dimensions."""
    rows = read(spark, d, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return grams.leverage(rows.where("label < 5"), rows.where("label >= 5"), "v").select("vec_id", F.round("leverage", 9).alias("leverage"), "in_domain")


_FOLD_SUMS = ", ".join(f"t.{c} - s.{c} AS t{c}" for c in ("n", "a", "b", "y", "aa", "ab", "bb", "ay", "xy"))


@query(
    "WITH z AS (SELECT CAST((((((l_orderkey * 16 + l_linenumber) % 268435456 + 42) * 2654435761) % 4294967296) >> 8) % 5 AS INTEGER) AS fold, l_extendedprice::DOUBLE AS a, l_discount::DOUBLE AS b, l_extendedprice::DOUBLE * (1 - l_discount::DOUBLE) AS y FROM lineitem), "
    "s AS (SELECT fold, count(*) AS n, sum(a) AS a, sum(b) AS b, sum(y) AS y, sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb, sum(a * y) AS ay, sum(b * y) AS xy, sum(y * y) AS yy FROM z GROUP BY fold), "
    "t AS (SELECT sum(n) AS n, sum(a) AS a, sum(b) AS b, sum(y) AS y, sum(aa) AS aa, sum(ab) AS ab, sum(bb) AS bb, sum(ay) AS ay, sum(xy) AS xy FROM s), "
    f"d AS (SELECT s.*, {_FOLD_SUMS} FROM s, t), c AS (SELECT *, taa - ta * ta / tn AS caa, tab - ta * tb / tn AS cab, tbb - tb * tb / tn AS cbb, tay - ta * ty / tn AS cay, txy - tb * ty / tn AS cby FROM d), "
    "w AS (SELECT *, (cay * cbb - cby * cab) / (caa * cbb - cab * cab) AS wa, (cby * caa - cay * cab) / (caa * cbb - cab * cab) AS wb FROM c), m AS (SELECT *, (ty - wa * ta - wb * tb) / tn AS w0 FROM w), "
    "e AS (SELECT *, yy + w0 * w0 * n + wa * wa * aa + wb * wb * bb - 2 * w0 * y - 2 * wa * ay - 2 * wb * xy + 2 * w0 * wa * a + 2 * w0 * wb * b + 2 * wa * wb * ab AS sse, yy - y * y / n AS sst, "
    "wa * wa * (aa - a * a / n) + wb * wb * (bb - b * b / n) + 2 * wa * wb * (ab - a * b / n) AS fitted, wa * (ay - a * y / n) + wb * (xy - b * y / n) AS joint FROM m) "
    "SELECT fold, n, round(1 - sse / sst, 7) AS r2, round(sqrt(sse / n), 3) AS rmse, round(joint / sqrt(fitted * sst), 7) AS pearson FROM e"
)
def cross_validation(spark, d):
    rows = read(spark, d, "lineitem").withColumn("id", F.col("l_orderkey") * 16 + F.col("l_linenumber")).withColumn("net", F.col("l_extendedprice").cast("double") * (1 - F.col("l_discount").cast("double")))
    found = grams.cross_validate_linear(rows, ["l_extendedprice", "l_discount"], "net", "id")
    return found.select("fold", "n", F.round("r2", 7).alias("r2"), F.round("rmse", 3).alias("rmse"), F.round("pearson", 7).alias("pearson"))


@query(
    "WITH p AS (SELECT p_partkey AS id, p_size::DOUBLE AS a, (p_partkey % 7)::DOUBLE AS b, p_retailprice::DOUBLE AS y, (((p_partkey % 268435456) + 42) * 2654435761) % 4294967296 AS h FROM part), r AS (SELECT *, row_number() OVER (ORDER BY h, id) - 1 AS i FROM p), "
    "k AS (SELECT count(*) AS n FROM p), f AS (SELECT s, n, greatest((s * 15838 + 1) % least(n, 1048576), CASE WHEN (s * 15838 + 1) % least(n, 1048576) = 0 THEN 1 ELSE 0 END) AS m FROM range(1, 6) g(s), k), "
    "t AS (SELECT s, n, (SELECT min(v) FROM range(10000) x(e), (SELECT m + e AS v) WHERE gcd(v, n) = 1) AS m, s * 7919 % n AS shift FROM f UNION ALL SELECT 0, n, 1, 0 FROM k), "
    "j AS (SELECT s, r.a, r.b, q.y FROM t, r q JOIN r ON r.i = (q.i * m + shift) % n), c AS (SELECT s, count(*) AS n, corr(y, a) AS ya, corr(y, b) AS yb, corr(a, b) AS ab FROM j GROUP BY s) "
    "SELECT CAST(s AS INTEGER) AS shuffle, n, round((ya * ya + yb * yb - 2 * ya * yb * ab) / (1 - ab * ab), 9) AS r2 FROM c"
)
def shuffled_labels(spark, d):
    """Training scores with the true labels and five shuffles of them, from one scan."""
    rows = read(spark, d, "part").withColumn("seventh", F.col("p_partkey") % 7)
    return grams.shuffled_scores(rows, ["p_size", "seventh"], "p_retailprice", "p_partkey", 5).withColumn("r2", F.round("r2", 9))


@query()
def kernel_regression(spark, d):
    """Held-out rows with predictions of a label that is not linear in the embedding."""
    v, r = (lambda i: F.col("v")[i]), read(spark, d, "embeddings")
    rows = r.select("vec_id", F.slice(F.transform("embedding", lambda x: x.cast("double")), 1, 6).alias("v")).withColumn("y", 10 * v(0) * v(0) + 20 * v(1) * v(2) + v(3))
    split = M.random_split(rows, "vec_id")
    model = KernelRegression.fit(split.where("NOT is_test"), "v", "y", features=256, c=10.0, epsilon=0.01)
    return model.predict(split.where("is_test"), "v").select("vec_id", F.round("y", 9).alias("y"), "predicted_activity")


@query(f"WITH {_PTS} SELECT vec_id AS id, round(x + 0.5 * abs(y), 9) AS acquisition FROM p ORDER BY round(x + 0.5 * abs(y), 9) DESC, vec_id LIMIT 20")
def acquire_ucb(spark, d):
    rows = points(spark, d).select(F.col("vec_id").alias("id"), F.col("x").alias("mean"), F.abs("y").alias("std"))
    return M.acquire(rows, "ucb", 20, kappa=0.5).select("id", F.round("acquisition", 9).alias("acquisition"))


@query(f"WITH {_FP_SQL}, {_farthest('f', 12)} {_picks(12)}")
def maxmin_diversity(spark, d):
    return M.maxmin_pick(fingerprints(spark, d), 12)


@query()
def maxmin_coresets(spark, d):
    """As many picks by core-sets of eight groups."""
    return M.maxmin_coreset(fingerprints(spark, d), 12, groups=8)


@query(
    f"WITH {_FP_SQL}, v AS (SELECT vec_id AS id, embedding[1]::DOUBLE AS m, abs(embedding[2]::DOUBLE) AS s FROM embeddings), best AS MATERIALIZED (SELECT id FROM v ORDER BY m DESC, id LIMIT 6), "
    f"unsure AS MATERIALIZED (SELECT id FROM v WHERE id NOT IN (SELECT id FROM best) ORDER BY s DESC, id LIMIT 3), r AS MATERIALIZED (SELECT * FROM f WHERE id NOT IN (SELECT id FROM best) AND id NOT IN (SELECT id FROM unsure)), {_farthest('r', 3)} "
    f"SELECT id, 'exploit' AS reason FROM best UNION ALL SELECT id, 'uncertain' FROM unsure UNION ALL SELECT id, 'diverse' FROM ({_picks(3)})"
)
def acquire_balanced(spark, d):
    rows = fingerprints(spark, d).select("id", "fp", F.get("embedding", F.lit(0)).cast("double").alias("mean"), F.abs(F.get("embedding", F.lit(1))).cast("double").alias("std"))
    return M.acquire_balanced(rows, 12, "fp").select("id", "reason")


@query()
def random_forest_predictions(spark, d):
    rows = M.random_split(points(spark, d), "vec_id")
    model = M.PropertyModel.fit(rows.where("NOT is_test"), _DIMS, "label", numTrees=20, maxDepth=5)
    return model.predict(rows.where("is_test")).select("vec_id", "predicted_activity")


@query()
def ensemble_uncertainty(spark, d):
    rows = points(spark, d)
    return M.PropertyModel.fit(rows, _DIMS, "label", numTrees=10, maxDepth=4).tree_spread(rows, "vec_id")


@query()
def principal_components(spark, d):
    from pyspark.ml.feature import VectorAssembler

    rows = VectorAssembler(inputCols=_DIMS, outputCol="features").transform(points(spark, d))
    return M.project(rows).select("vec_id", "pc1", "pc2")


@query()
def cluster_diversity(spark, d):
    from pyspark.ml.feature import VectorAssembler

    rows = VectorAssembler(inputCols=_DIMS, outputCol="features").transform(points(spark, d))
    return M.cluster_pick(rows, 8, id_="vec_id")


@query()
def neighbour_graph(spark, d):
    """About the 20 nearest rows of each row."""
    return N.neighbour_graph(read(spark, d, "embeddings"), "embedding", k=20, id_="vec_id")


@query()
def neighbour_layout(spark, d):
    rows = read(spark, d, "embeddings")
    return N.layout(rows, "embedding", N.neighbour_graph(rows, "embedding", k=15, rounds=3, id_="vec_id"), rounds=6, id_="vec_id")


# --- molecules -------------------------------------------------------------------------------

#: Well-known drugs and building blocks (fixed values), since the tables hold no molecules.
MOLECULES = (
    ("aspirin", "CC(=O)Oc1ccccc1C(=O)O"), ("caffeine", "Cn1cnc2c1c(=O)n(C)c(=O)n2C"), ("ibuprofen", "CC(C)Cc1ccc(cc1)C(C)C(=O)O"), ("metformin", "CN(C)C(=N)NC(=N)N"),
    ("naproxen", "COc1ccc2cc(ccc2c1)C(C)C(=O)O"), ("diclofenac", "O=C(O)Cc1ccccc1Nc1c(Cl)cccc1Cl"), ("celecoxib", "Cc1ccc(cc1)-c1cc(nn1-c1ccc(cc1)S(N)(=O)=O)C(F)(F)F"),
    ("atorvastatin", "CC(C)c1c(C(=O)Nc2ccccc2)c(-c2ccccc2)c(-c2ccc(F)cc2)n1CCC(O)CC(O)CC(=O)O"), ("nicotine", "CN1CCCC1c1cccnc1"), ("sodium propionate", "[Na+].[O-]C(=O)CC"), ("nitrobenzene", "O=[N+]([O-])c1ccccc1"), ("broken", "C1CC("),
)


def molecules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(MOLECULES), "name string, smiles string")


@example(
    "SELECT * FROM (VALUES ('aspirin', 180.2::DOUBLE, 1, 13), ('caffeine', 194.2, 2, 14), ('ibuprofen', 206.3, 1, 15), ('metformin', 129.2, 0, 9), ('naproxen', 230.3, 2, 17), ('diclofenac', 296.1, 2, 19), ('celecoxib', 381.4, 3, 26), "
    "('atorvastatin', 558.7, 4, 41), ('nicotine', 162.2, 2, 12), ('sodium propionate', 96.1, 0, 6), ('nitrobenzene', 123.1, 1, 9), ('broken', NULL, NULL, NULL)) t(name, \"MolWt\", \"RingCount\", \"HeavyAtomCount\")"
)
def molecule_properties(spark, d):
    from ..operators import molecules as X

    return X.with_properties(molecules(spark)).select("name", F.round("MolWt", 1).alias("MolWt"), "RingCount", "HeavyAtomCount")


#: Groups of the molecules built from part keys, with the published additive values of each on a benzene ring (fixed values):
#: SMILES, weight, polar surface, logP, donors, nitrogen and oxygen atoms, heavy atoms.
GROUPS = (
    ("C", 15.035, 0.0, 0.58952, 0, 0, 1), ("O", 17.007, 20.23, -0.0133, 1, 1, 1), ("N", 16.023, 26.02, -0.1367, 1, 1, 1), ("F", 18.998, 0.0, 0.4202, 0, 0, 1), ("Cl", 35.45, 0.0, 0.9345, 0, 0, 1), ("Br", 79.904, 0.0, 1.0436, 0, 0, 1),
    ("C(=O)O", 45.017, 37.30, -0.0207, 1, 2, 3), ("C#N", 26.018, 23.79, 0.15278, 0, 1, 2), ("[N+](=O)[O-]", 46.005, 43.14, 0.1893, 0, 3, 3), ("OC", 31.034, 9.23, 0.2897, 0, 1, 2), ("C(N)=O", 44.033, 43.09, -0.6200, 1, 2, 3),
)
_LIBRARY_SQL = "g AS (SELECT * FROM (VALUES {}) t(i, s, w, p, l, d, a, h)), lib AS (SELECT p_partkey AS id, x.s AS s1, y.s AS s2, 76.098 + x.w + y.w AS w, x.p + y.p AS p, 1.1244 + x.l + y.l AS l, x.d + y.d AS d, x.a + y.a AS a, 6 + x.h + y.h AS h FROM part JOIN g x ON x.i = p_partkey % {} JOIN g y ON y.i = p_partkey // {} % {})".format(
    ", ".join(f"({i}, '{s}', {w}, {p}, {lp}, {dn}, {a}, {h})" for i, (s, w, p, lp, dn, a, h) in enumerate(GROUPS)), len(GROUPS), len(GROUPS), len(GROUPS)
)


def library(spark: SparkSession, d: str) -> DataFrame:
    """id and smiles: part keys as benzene rings with two groups, para to one another."""
    k, n = F.col("p_partkey"), len(GROUPS)
    group = lambda i: F.get(F.array(*[F.lit(g[0]) for g in GROUPS]), i.cast("int"))
    # The table is one small file; what is done with a molecule is not small.
    keys = read(spark, d, "part").select("p_partkey").repartition(2 * spark.sparkContext.defaultParallelism)
    return keys.select(k.alias("id"), F.concat(F.lit("c1cc("), group(k % n), F.lit(")ccc1"), group(F.floor(k / n) % n)).alias("smiles"))


@query(f'WITH {_LIBRARY_SQL} SELECT id, round(w, 2)::DOUBLE AS "MolWt", round(p, 2)::DOUBLE AS "TPSA", round(l, 3)::DOUBLE AS "LogP", d::INT AS "HBD", a::INT AS "HBA", h::INT AS "HeavyAtomCount" FROM lib')
def library_properties(spark, d):
    from ..operators import molecules as X

    out = X.with_properties(library(spark, d))
    return out.select("id", *[F.round(F.round(c, 9), n).alias(c) for c, n in (("MolWt", 2), ("TPSA", 2), ("LogP", 3))], "HBD", "HBA", "HeavyAtomCount")


@query(f"WITH {_LIBRARY_SQL} SELECT id, ((s1 = 'C(=O)O')::INT + (s2 = 'C(=O)O')::INT) AS match_count FROM lib WHERE 'C(=O)O' IN (s1, s2)")
def library_acids(spark, d):
    from ..operators import molecules as X

    return X.screen_substructure(library(spark, d), "cC(=O)[O;H1]").select("id", "match_count")


@query(f"WITH {_LIBRARY_SQL} SELECT least(s1, s2) AS one, greatest(s1, s2) AS two, count(*) AS n FROM lib GROUP BY 1, 2")
def library_duplicates(spark, d):
    """Canonical SMILES bring together the two ways to write a molecule; groups are told from the key."""
    from ..operators import molecules as X

    k, n = F.col("id"), len(GROUPS)
    group = lambda i: F.get(F.array(*[F.lit(g[0]) for g in GROUPS]), i.cast("int"))
    rows = X.validate(library(spark, d)).where("status = 'validated'").withColumns({"g1": group(k % n), "g2": group(F.floor(k / n) % n)})
    return rows.groupBy("smiles").agg(F.min(F.least("g1", "g2")).alias("one"), F.max(F.greatest("g1", "g2")).alias("two"), F.count("*").alias("n")).select("one", "two", "n")


@query(f"WITH {_LIBRARY_SQL} SELECT id, s1 IN ('OC', 'C(=O)O', 'C(N)=O') AS first_cut, s2 IN ('OC', 'C(=O)O', 'C(N)=O') AS second_cut FROM lib")
def library_fragments(spark, d):
    """Which of the two groups retrosynthesis cuts off: ethers, acids and amides leave the ring with labels 3 and 6, other groups stay."""
    from ..operators import molecules as X

    k, n = F.col("id"), len(GROUPS)
    rows = X.fragment_table(library(spark, d)).withColumn("cuts", F.array_size(F.regexp_extract_all(F.array_join(F.filter("fragments", lambda f: F.contains(f, F.lit("c1"))), " "), F.lit(r"\[16\*\]"), F.lit(0))))
    cut = lambda i: F.get(F.array(*[F.lit(g[0] in ("OC", "C(=O)O", "C(N)=O")) for g in GROUPS]), i.cast("int"))
    both = rows.withColumns({"a": cut(k % n), "b": cut(F.floor(k / n) % n)})
    # The number of cuts comes from the molecule, their places from the key.
    return both.select("id", (F.col("a") & (F.col("cuts") == F.col("a").cast("int") + F.col("b").cast("int"))).alias("first_cut"), (F.col("b") & (F.col("cuts") == F.col("a").cast("int") + F.col("b").cast("int"))).alias("second_cut"))


@example("SELECT * FROM (VALUES ('aspirin'), ('ibuprofen'), ('naproxen'), ('diclofenac'), ('atorvastatin')) t(name)")
def substructure_screen(spark, d):
    from ..operators import molecules as X

    return X.screen_substructure(molecules(spark), "C(=O)[O;H1]").select("name")


@example("SELECT name, CASE WHEN name = 'broken' THEN 'failed' ELSE 'validated' END AS status FROM (VALUES ('aspirin'), ('caffeine'), ('ibuprofen'), ('metformin'), ('naproxen'), ('diclofenac'), ('celecoxib'), ('atorvastatin'), ('nicotine'), ('sodium propionate'), ('nitrobenzene'), ('broken')) t(name)")
def molecule_validation(spark, d):
    from ..operators import molecules as X

    return X.validate(molecules(spark)).select("name", "status")


@example()
def molecule_profile(spark, d):
    from . import workflows as W

    return W.score(W.profile(molecules(spark))).select("name", "smiles", "lipinski_pass", "admet_class", "admet_score", "composite_score")


@example()
def molecule_similarity(spark, d):
    from ..operators import molecules as X

    fps = X.with_fingerprint(molecules(spark)).where("fp IS NOT NULL")
    return P.similarity_pairs(fps, 0.1, id_="name", words=32)


@example()
def generate_mutants(spark, d):
    from ..operators import molecules as X

    return X.mutants(molecules(spark), 30)


@example()
def generate_decorated(spark, d):
    from ..operators import molecules as X

    return X.decorated(molecules(spark), 30)


@example()
def generate_recombined(spark, d):
    from ..operators import molecules as X

    return X.recombined(molecules(spark), 30)


@example()
def fragment_counts(spark, d):
    from ..operators import molecules as X

    return T.fragment_library(X.fragment_table(molecules(spark)), "fragments")


@example()
def hit_to_lead(spark, d):
    from . import workflows as W

    return W.hit_to_lead(molecules(spark), 10, 10).select("smiles", "rank", "composite_score")


@query("SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2")
def streaming_window_counts(spark, d):
    """Daily counts by event type, from the table read as a stream of files."""
    from ..session import work_path
    from ..streaming import scoring

    like = read(spark, d, "events")
    stream = spark.readStream.schema(like.schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/events.parquet" if not d.startswith("/") else f"{d}/events.parque[t]")
    counted = scoring.counts(stream.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "event_type", "1 day", "1 day")
    out = scoring.latest(counted, ["start", "end", "event_type"], work_path(spark, "events"), work_path(spark, "events-checkpoint"))
    return out.select("event_type", F.date_format("start", "yyyy-MM-dd").alias("day"), "n", F.round("mean", 6).alias("mean"))


@query(ORACLES["dedup_median"])
def dedup_stream(spark, d):
    """``dedup_median`` of the table as it arrives, the medians and best records kept as state."""
    from ..session import work_path
    from ..streaming import curation

    like = read(spark, d, "lineitem")
    stream = spark.readStream.schema(like.schema).option("pathGlobFilter", "*.parquet").option("maxFilesPerTrigger", 16).parquet(f"{d}/lineitem.parquet" if not d.startswith("/") else f"{d}/lineitem.parque[t]")
    rows = stream.select("l_partkey", F.col("l_extendedprice").alias("value"), F.col("l_tax").alias("confidence_score"), "l_orderkey", "l_linenumber", "l_suppkey", F.col("l_extendedprice").alias("price"))
    out = curation.curated(rows, "l_partkey", work_path(spark, "curated"), work_path(spark, "curated-checkpoint"), "value", ("l_orderkey", "l_linenumber", "l_suppkey", "price"))
    return out.select("l_partkey", "value", "n_measurements", "l_orderkey", "l_suppkey")


@query("SELECT vec_id, round(embedding[1]::DOUBLE - min(embedding[1]::DOUBLE) OVER (PARTITION BY label), 9) AS strain FROM embeddings")
def strain_energy(spark, d):
    from ..operators import conformers as Y

    rows = read(spark, d, "embeddings").select("vec_id", F.col("label").alias("mol"), F.get("embedding", F.lit(0)).cast("double").alias("energy"))
    return Y.with_strain(rows).select("vec_id", F.round("strain", 9).alias("strain"))


@query("SELECT label AS mol, arg_min(vec_id, {'e': embedding[1]::DOUBLE, 'v': vec_id}) AS best_conformer_id, min(embedding[1]::DOUBLE) AS lowest_energy, count(*) AS n_conformers FROM embeddings GROUP BY label")
def lowest_conformer(spark, d):
    from ..operators import conformers as Y

    rows = read(spark, d, "embeddings").select(F.col("vec_id").alias("conf"), F.col("label").alias("mol"), F.get("embedding", F.lit(0)).cast("double").alias("energy"))
    return Y.lowest(rows)

"""Drug-likeness rules and ADMET classes, as columns over molecular properties.

Properties are the columns MolWt, LogP, TPSA, HBD, HBA, RotatableBonds and AromaticRings. They are
read once a row; rules are CASE expressions over them, so all of ADMET is one projection.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from .scores import mean_present, number


def _count(*conditions: Column) -> Column:
    return reduce(add, [F.coalesce(c, F.lit(False)).cast("int") for c in conditions])


def violations(limits: Mapping[str, float]) -> Column:
    """Texts of the limits a row exceeds; missing values exceed nothing."""
    return F.array_compact(F.array(*[F.when(number(F.col(c)) > x, F.format_string(f"{c}=%.1f > {x:g}", number(F.col(c)))) for c, x in limits.items()]))


def lipinski_violations() -> Column:
    return _count(*[number(F.col(c)) > x for c, x in K.LIPINSKI.items()])


def lipinski(most: int = 1) -> Column:
    return lipinski_violations() <= most


def veber() -> Column:
    return _count(*[number(F.col(c)) > x for c, x in K.VEBER.items()]) == 0


def ghose() -> Column:
    """All four ranges hold; a missing value fails."""
    return reduce(lambda a, b: a & b, [F.coalesce(number(F.col(c)).between(lo, hi), F.lit(False)) for c, (lo, hi) in K.GHOSE.items()])


def _three(first: Column, second: Column, names: tuple[str, str, str], risks: tuple[str, str, str]) -> tuple[Column, Column]:
    return tuple(F.when(first, F.lit(x[0])).when(second, F.lit(x[1])).otherwise(F.lit(x[2])) for x in (names, risks))


def admet_columns() -> dict[str, Column]:
    """ADMET classes, risks and scores by name; structural alerts are the columns cyp_alerts, herg_alerts, ames_alerts, hepatotox_alerts (arrays)."""
    g, y, r = "green", "yellow", "red"
    mw, logp, tpsa, rotb, arom = (number(F.col(c)) for c in ("MolWt", "LogP", "TPSA", "RotatableBonds", "AromaticRings"))
    v = lipinski_violations()
    out: dict[str, Column] = {}

    def put(name: str, pair: tuple[Column, Column], kind: str = "class") -> None:
        out[f"admet_{name}_{kind}"], out[f"admet_{name}_risk"] = pair

    put("caco2", _three(tpsa < 90, tpsa < 140, ("high", "moderate", "low"), (g, y, r)))
    put("hia", _three((v <= 1) & veber() & (tpsa < 140), (v <= 2) & (tpsa < 140), ("high", "moderate", "low"), (g, y, r)))
    pgp = F.coalesce((mw > 400) & (tpsa > 75), F.lit(False))
    put("pgp", (pgp, F.when(pgp, y).otherwise(g)), "substrate")
    oral = 0.3 * F.when(v <= 1, 1.0).when(v == 2, 0.5).otherwise(0.0) + 0.3 * F.when(veber(), 1.0).otherwise(0.0)
    oral = oral + 0.2 * F.when(logp.between(-0.4, 5.6), 1.0).otherwise(0.0) + 0.2 * F.when(tpsa < 90, 1.0).when(tpsa < 140, 0.5).otherwise(0.0)
    put("bioavailability", (oral, F.when(oral >= 0.7, g).when(oral >= 0.4, y).otherwise(r)), "score")
    log_bb = 0.155 * logp - 0.01 * tpsa + 0.164
    out["admet_log_bb"] = F.round(log_bb, 3)
    put("bbb", (F.coalesce(log_bb > 0, F.lit(False)), F.when(F.abs(log_bb) > 0.3, g).otherwise(y)), "penetrant")
    put("ppb", _three(logp > 3, logp > 1, ("high", "moderate", "low"), (y, g, g)))
    put("vod", _three(logp < 1, logp < 3, ("low", "moderate", "high"), (g, g, y)))
    cyp = F.size("cyp_alerts")
    put("cyp", _three(cyp == 0, cyp == 1, ("low", "moderate", "high"), (g, y, r)))
    stability = 1 - 0.25 * _count(mw > 500, logp > 3, rotb > 7, arom > 3)
    put("metabolic", _three(stability >= 0.75, stability >= 0.5, ("high", "moderate", "low"), (g, y, r)))
    out["admet_metabolic_stability_score"] = stability
    renal = F.coalesce((mw < 500) & (logp < 2), F.lit(False))
    put("renal", (renal, F.when(renal, g).otherwise(y)), "clearance")
    put("halflife", _three((stability >= 0.75) & (mw < 400), (stability < 0.5) & (mw > 500), ("short", "long", "medium"), (g, y, g)))
    fat, herg = F.coalesce((logp > 3.7) & (mw > 400), F.lit(False)), F.size("herg_alerts") > 0
    put("herg", (fat | herg, F.when(fat & herg, r).when(fat | herg, y).otherwise(g)), "liability")
    out["admet_herg_alerts"] = F.when(fat, F.array_append("herg_alerts", F.lit("high_logp_mw"))).otherwise(F.col("herg_alerts"))
    ames, hep = F.size("ames_alerts"), F.size("hepatotox_alerts")
    out["admet_ames_risk"] = F.when(ames == 0, g).when(ames == 1, y).otherwise(r)
    out["admet_hepatotox_risk"] = F.when(hep == 0, g).when(hep <= 2, y).otherwise(r)
    put("mrdd", _three((mw < 400) & logp.between(1, 4) & (tpsa < 120), (mw > 600) | (logp > 5) | (logp < -1), ("low_dose", "high_dose", "moderate_dose"), (g, y, g)))
    return out


#: The risks that enter each domain's score; two domains also average a score.
DOMAINS = {
    "absorption": (("caco2", "hia", "pgp"), "admet_bioavailability_score"),
    "distribution": (("bbb", "ppb", "vod"), None),
    "metabolism": (("cyp",), "admet_metabolic_stability_score"),
    "excretion": (("renal", "halflife"), None),
    "toxicity": (("herg", "ames", "hepatotox", "mrdd"), None),
}
RISKS = ("caco2", "hia", "pgp", "bioavailability", "bbb", "ppb", "vod", "cyp", "metabolic", "renal", "halflife", "herg", "ames", "hepatotox", "mrdd")


def risk_score(risk: Column) -> Column:
    """green 1, red 0, anything else 0.5; null stays null."""
    return F.when(risk.isNotNull(), F.when(risk == "green", 1.0).when(risk == "red", 0.0).otherwise(0.5))


def admet_class(score: Column) -> Column:
    return F.when(score >= K.ADMET_FAVORABLE, "favorable").when(score >= K.ADMET_MODERATE, "moderate").otherwise("poor")


def with_admet(df: DataFrame, weights: Mapping[str, float] | None = None) -> DataFrame:
    """``df`` with ADMET classes, domain scores, the weighted score, its class and the counts of flags.

    Alert columns that ``df`` lacks count as empty. A weight that a given mapping lacks keeps its
    default, while the sum divides by the given weights only.
    """
    for c in ("cyp_alerts", "herg_alerts", "ames_alerts", "hepatotox_alerts"):
        if c not in df.columns:
            df = df.withColumn(c, F.array().cast("array<string>"))
    df = df.withColumns(admet_columns())
    return with_admet_score(df, weights)


def _equals(value: str) -> Callable[[Column], Column]:
    return lambda x: x == value


def with_admet_score(df: DataFrame, weights: Mapping[str, float] | None = None) -> DataFrame:
    weights = weights or K.ADMET_WEIGHTS
    domain = {}
    for name, (risks, score) in DOMAINS.items():
        values = [risk_score(F.col(f"admet_{x}_risk")) for x in risks if f"admet_{x}_risk" in df.columns]
        values += [F.col(score).cast("double")] if score and score in df.columns else []
        domain[name] = mean_present(values, 0.5) if values else F.lit(0.5)
    total = reduce(add, [weights.get(k, K.ADMET_WEIGHTS[k]) * v for k, v in domain.items()]) / sum(weights.values())
    flags = F.array(*[F.col(f"admet_{x}_risk") for x in RISKS if f"admet_{x}_risk" in df.columns])
    df = df.withColumns({f"admet_{k}_score": F.round(v, 3) for k, v in domain.items()} | {"admet_score": F.round(total, 3), "_flags": flags})
    counts = {f"admet_n_{c}": F.size(F.filter("_flags", _equals(c))) for c in ("red", "yellow", "green")}
    return df.withColumns(counts | {"admet_class": admet_class(F.col("admet_score"))}).drop("_flags")

"""Workflows: profiles, screening, hit to lead, de novo design, lead optimisation, training, reports.

Each is one lazy plan, written where it fans out; files are written at the end. Structure-based
steps (conformers, alignment, docking) need backends that are not part of this library; their inputs
and outputs (coordinates, poses, shape scores) are read as columns.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import __version__
from .. import constants as K
from ..functions import rules
from ..functions.scores import drug_likeness, pic50, sa_normalized
from ..operators import curation, modelling, pairs, screening, statistics
from ..operators import molecules as M
from ..session import checkpointed
from ..sources import files


class BackendUnavailable(RuntimeError):
    """A step needs a program or library that is not installed."""


def docking_backend() -> str:
    """python, binary or none, by what is installed."""
    import importlib.util
    import shutil

    return "python" if importlib.util.find_spec("vina") else "binary" if shutil.which("vina") else "none"


def dock(*_args, **_kwargs):
    raise BackendUnavailable(f"docking needs a backend; found: {docking_backend()}. Poses of earlier runs are read by sources.files.docking_poses")


@dataclass
class Config:
    """What a configured run reads; unknown keys of a file are ignored."""

    lipinski: bool = True
    veber: bool = False
    pains: bool = True
    max_violations: int = 1
    similarity_threshold: float = 0.7
    top_n: int = 50
    weights: dict = field(default_factory=lambda: dict(K.COMPOSITE_WEIGHTS))

    @classmethod
    def from_yaml(cls, path: str) -> Config:
        import yaml

        given = yaml.safe_load(Path(path).read_text()) or {}
        flat = {k: v for part in given.values() if isinstance(part, dict) for k, v in part.items()} | {k: v for k, v in given.items() if not isinstance(v, dict)} | {k: v for k, v in given.items() if k == "weights"}
        return cls(**{k: v for k, v in flat.items() if k in cls.__dataclass_fields__})

    def to_yaml(self, path: str) -> None:
        import yaml

        Path(path).write_text(yaml.safe_dump(asdict(self)))


def profile(df: DataFrame, config: Config | None = None) -> DataFrame:
    """Validated and standardised molecules with properties, alerts, rules, ADMET and scores. LogP, TPSA, QED and sa_score are used where they are columns."""
    c = config or Config()
    d = M.with_alerts(M.with_properties(M.standardize(M.validate(df).where("status <> 'failed'"))))
    for name in ("LogP", "TPSA", "QED", "sa_score", "pains_alerts"):
        if name not in d.columns:
            d = d.withColumn(name, F.lit(None).cast("array<string>" if name == "pains_alerts" else "double"))
    d = screening.filter_rules(d.withColumn("pains_alerts", F.coalesce("pains_alerts", F.array().cast("array<string>"))), c.lipinski, True, c.pains, most=c.max_violations)
    return rules.with_admet(d)


def score(df: DataFrame, config: Config | None = None, activity: str = "predicted_activity") -> DataFrame:
    d = df.withColumn("sa_score_normalized", sa_normalized(F.col("sa_score"))).withColumn("drug_likeness", drug_likeness({k: v for k, v in K.DRUG_LIKENESS_WEIGHTS.items() if k in df.columns}))
    return screening.flag_candidates(screening.composite(d, (config or Config()).weights, normalize=activity if activity in df.columns else None))


def screen_and_score(df: DataFrame, references: DataFrame | None = None, model: modelling.PropertyModel | None = None, config: Config | None = None) -> DataFrame:
    """Profile, then keep what is similar to the references, predict, score and flag."""
    c = config or Config()
    d = profile(df, c)
    if references is not None:
        found = pairs.screen_similarity(M.with_fingerprint(d), M.with_fingerprint(references), c.similarity_threshold, id_="smiles", words=32)
        d = d.join(found.select(F.col("id").alias("smiles"), F.col("similarity").alias("reference_similarity")), "smiles")
    if model is not None:
        d = model.predict(d)
    return score(d, c)


def fetch_and_curate(spark: SparkSession, pages: str, outliers: bool = False, mode: str = "binary") -> curation.Curated:
    """Captured activity pages, curated and labelled."""
    done = curation.curate(files.activities(spark, pages), key="smiles", outliers=outliers)
    done.data = curation.label(done.data, mode)
    return done


def train(df: DataFrame, features: list[str], label: str, id_: str, kind: str = "random_forest", task: str = "regression", split: str = "random", test: float = 0.2) -> tuple[modelling.PropertyModel, DataFrame]:
    """A model, and its metrics on the rows kept apart (by hash, or by whole scaffolds)."""
    clean = modelling.impute(df.where(F.col(label).isNotNull()), features)
    placed = modelling.random_split(clean, id_, test) if split == "random" else modelling.group_split(clean.withColumn("_scaffold", M.scaffold(F.col("smiles"))), "_scaffold", test)
    placed = checkpointed(placed, "split")
    model = modelling.PropertyModel.fit(placed.where("NOT is_test"), features, label, kind, task)
    metrics = modelling.regression_metrics if task == "regression" else modelling.classification_metrics
    return model, metrics(model.predict(placed.where("is_test"), "_p"), label, "_p")


def compare(df: DataFrame, features: list[str], label: str, id_: str, task: str = "regression", k: int = 5) -> DataFrame:
    """strategy and cross-validated means of each metric, for each kind of model of the task."""
    out = None
    for kind in modelling.REGRESSORS if task == "regression" else modelling.CLASSIFIERS:
        m = modelling.cross_validate(df, features, label, id_, kind, task, k)
        means = m.agg(*[F.avg(c).alias(c) for c in m.columns if c not in ("fold", "n")]).withColumn("strategy", F.lit(kind))
        out = means if out is None else out.unionByName(means)
    return out


def analogs(seeds: DataFrame, n: int, strategy: str, seed: int = 42) -> DataFrame:
    makers = {"mutate": M.mutants, "brics": M.recombined, "scaffold": M.decorated}
    if strategy not in makers:
        raise ValueError(f"strategy must be one of {sorted(makers)}")
    made = makers[strategy](seeds, n, seed=seed).select("smiles").withColumn("generation_method", F.lit(strategy))
    return M.novel(made, seeds)


def _finish(df: DataFrame, generated: DataFrame | None, top_n: int, config: Config | None) -> DataFrame:
    """Originals and new molecules profiled and scored together, so that scores are on one scale."""
    everything = df if generated is None else df.unionByName(generated, allowMissingColumns=True)
    return screening.top(score(profile(everything), config), top_n, tie=("smiles",))


def hit_to_lead(df: DataFrame, n_generate: int = 50, top_n: int = 20, seed: int = 42, config: Config | None = None) -> DataFrame:
    """The ten best molecules are mutated; all are ranked together."""
    seeds = screening.top(score(profile(df), config), 10, tie=("smiles",))
    return _finish(df.select("smiles"), analogs(checkpointed(seeds.select("smiles"), "seeds"), n_generate, "mutate", seed), top_n, config)


def denovo(df: DataFrame, strategy: str = "brics", n_generate: int = 100, top_n: int = 30, seed: int = 42, config: Config | None = None) -> DataFrame:
    if strategy not in ("brics", "mutate"):
        raise ValueError("strategy must be brics or mutate")
    return _finish(analogs(df.select("smiles"), n_generate, strategy, seed), None, top_n, config)


def optimize_lead(spark: SparkSession, lead: str, n_analogs: int = 50, top_n: int = 20, seed: int = 42, config: Config | None = None) -> DataFrame:
    """Half mutants, half decorated scaffolds of one molecule, at least ten each, with their similarity to it."""
    one = spark.createDataFrame([(lead,)], "smiles string")
    half = max(10, n_analogs // 2)
    made = analogs(one, half, "mutate", seed).unionByName(analogs(one, max(10, n_analogs - half), "scaffold", seed)).dropDuplicates(["smiles"])
    best = checkpointed(_finish(made, None, top_n, config), "lead")
    near = pairs.screen_similarity(M.with_fingerprint(best), M.with_fingerprint(one), 0.0, id_="smiles", words=32)
    return best.join(near.select(F.col("id").alias("smiles"), F.col("similarity").alias("lead_similarity")), "smiles", "left")


def select_for_docking(df: DataFrame, least_pic50: float = 7.0) -> DataFrame:
    """Rows that are not poor, potent enough, ranked by 0.4 ADMET + 0.6 of (pIC50 - 5) / 5 within 0 and 1."""
    value = 0.4 * F.col("admet_score") + 0.6 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("predicted_pIC50") - 5) / 5))
    return df.where((F.col("admet_class") != "poor") & (F.col("predicted_pIC50") >= least_pic50)).withColumn("selection_score", value).orderBy(F.col("selection_score").desc())


def benchmark(strategies: dict, seeds: DataFrame, n: int = 100) -> DataFrame:
    """One row a strategy (a function of seeds and n): seconds, validity, uniqueness, novelty; one that fails has a row of zeros."""
    import time

    out = None
    for name, make in strategies.items():
        began = time.time()
        try:
            made = checkpointed(make(seeds, n).select("smiles"), "benchmark")
        except Exception:  # noqa: BLE001  a strategy that fails is a result
            made = seeds.select("smiles").limit(0)
        m = statistics.generation_metrics(made, seeds).withColumn("strategy", F.lit(name)).withColumn("seconds", F.lit(time.time() - began))
        out = m if out is None else out.unionByName(m)
    return out


def docking_report(df: DataFrame, admet: DataFrame | None = None) -> dict:
    """Tables and figures of a docking study: statistics, tiers, classes, correlations, interpretation."""
    stats = statistics.quartiles(df, "vina_score").first().asDict()
    report = {"version": __version__, "docking": stats, "tiers": {r["tier"]: r["n"] for r in statistics.tiers(df, "vina_score", (-3.5, -3.0), ("strong", "moderate", "weak")).collect()}}
    for other in ("predicted_pIC50", "admet_score"):
        if other in df.columns:
            report[f"spearman_vina_{other}"] = statistics.spearman(df, "vina_score", other).first().asDict()
            report[f"trend_vina_{other}"] = statistics.trend(df, other, "vina_score").first().asDict()
    if admet is not None:
        report["classes"] = {r["admet_class"]: r["count"] for r in admet.groupBy("admet_class").count().collect()}
    best = stats["min"]
    report["interpretation"] = "none" if best is None else "strong" if best <= -5 else "moderate" if best <= -3.5 else "weak"
    return report


def research_report(candidates: DataFrame, training: DataFrame, potency: tuple[str, ...] = ("predicted_pIC50", "pIC50", "predicted_activity", "activity", "score")) -> dict:
    column = next((c for c in potency if c in candidates.columns), None)
    numeric = lambda d: [c for c, k in d.dtypes if k in ("double", "int", "bigint", "float")]
    table = lambda d: {r["property"]: r.asDict() for r in statistics.numeric_summary(d, numeric(d), sample=True).collect()} if numeric(d) else {}
    report = {"version": __version__, "candidates": table(candidates), "training": table(training), "potency": column}
    if column:
        v = F.col(column)
        report["bins"] = candidates.agg(F.count_if(v >= 9).alias("from_9"), F.count_if(v >= 8).alias("from_8"), F.count_if((v >= 7) & (v < 8)).alias("7_to_8")).first().asDict()
    return report


def label_pic50(df: DataFrame, value: str = "standard_value") -> DataFrame:
    return df.withColumn("pIC50", F.round(pic50(F.col(value)), 4))

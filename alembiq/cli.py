"""Command line: ``python -m alembiq.cli GROUP COMMAND INPUT [OUTPUT] [options]``."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import __version__
from .functions import rules
from .operators import curation, modelling, pairs, screening, statistics
from .operators import molecules as M
from .plans import workflows as W
from .session import session
from .sources import files

COMMANDS = {}


def command(name: str, *options: tuple):
    def add(f):
        COMMANDS[name] = (f, options)
        return f

    return add


def opt(name: str, **how) -> tuple:
    return name, how


N, SEED = opt("--n", type=int, default=100), opt("--seed", type=int, default=42)


@command("data load", opt("--format", default="auto"), opt("--limit", type=int))
def _load(s, df, a):
    return M.validate(df)


@command("data standardize")
def _standardize(s, df, a):
    return M.standardize(df)


@command("data export")
def _export(s, df, a):
    return df


@command("data info")
def _info(s, df, a):
    v = M.validate(df)
    return v.groupBy("status").count()


@command("data curate", opt("--relations", nargs="+", default=["="]), opt("--no-deduplicate", action="store_true"), opt("--dedup-key", default="smiles"), opt("--remove-outliers", action="store_true"))
def _curate(s, df, a):
    return curation.curate(df, a.dedup_key, a.relations, not a.no_deduplicate, a.remove_outliers).data


@command("data label", opt("--mode", default="binary"), opt("--active-threshold", type=float, default=1000.0), opt("--inactive-threshold", type=float), opt("--value-key", default="standard_value"))
def _label(s, df, a):
    return curation.label(df, a.mode, a.active_threshold, a.inactive_threshold, a.value_key)


@command("data fetch-and-curate", opt("--mode", default="binary"), opt("--remove-outliers", action="store_true"))
def _fetch(s, df, a):
    return W.fetch_and_curate(s, a.input, a.remove_outliers, a.mode).data


@command("analyze properties")
def _properties(s, df, a):
    return M.with_properties(df)


@command("analyze fingerprints", opt("--type", default="circular"), opt("--nbits", type=int, default=2048))
def _fingerprints(s, df, a):
    return M.with_fingerprint(df, kind=a.type, bits=a.nbits)


@command("analyze filter", opt("--veber", action="store_true"), opt("--no-lipinski", action="store_true"), opt("--max-violations", type=int, default=1), opt("--remove", action="store_true"))
def _filter(s, df, a):
    d = M.with_properties(df)
    for c in ("LogP", "TPSA"):
        d = d if c in d.columns else d.withColumn(c, F.lit(None).cast("double"))
    return screening.filter_rules(d, not a.no_lipinski, a.veber, True, most=a.max_violations, remove=a.remove)


@command("analyze similarity", opt("--query-smiles", required=True), opt("--metric", default="tanimoto"), opt("--top-k", type=int, default=10))
def _similarity(s, df, a):
    q = M.with_fingerprint(s.createDataFrame([(a.query_smiles,)], "smiles string"))
    return pairs.nearest(M.with_fingerprint(df), q, a.top_k, a.metric, id_="smiles", words=32)


@command("analyze score", opt("--top-n", type=int))
def _score(s, df, a):
    d = W.score(W.profile(df))
    return screening.top(d, a.top_n, tie=("smiles",)) if a.top_n else d


@command("admet predict")
def _admet(s, df, a):
    return W.profile(df)


@command("admet summary")
def _admet_summary(s, df, a):
    return statistics.liabilities(W.profile(df), [f"admet_{x}_risk" for x in rules.RISKS])


@command("screen substructure", opt("--pattern", required=True), opt("--exclude", action="store_true"))
def _substructure(s, df, a):
    return M.screen_substructure(df, a.pattern, a.exclude)


@command("screen pharmacophore", opt("--features", required=True), opt("--match-any", action="store_true"))
def _pharmacophore(s, df, a):
    return M.screen_features(df, screening.parse_counts(a.features), not a.match_any)


@command("screen similarity", opt("--reference", required=True), opt("--threshold", type=float, default=0.7), opt("--metric", default="tanimoto"), opt("--aggregation", default="max"))
def _screen(s, df, a):
    refs = M.with_fingerprint(files.load(s, a.reference))
    return pairs.screen_similarity(M.with_fingerprint(df), refs, a.threshold, a.metric, a.aggregation, id_="smiles", words=32)


@command("generate brics", N, SEED)
def _brics(s, df, a):
    return W.analogs(df, a.n, "brics", a.seed)


@command("generate mutate", N, SEED)
def _mutate(s, df, a):
    return W.analogs(df, a.n, "mutate", a.seed)


@command("generate scaffold", N, SEED)
def _scaffold(s, df, a):
    return W.analogs(df, a.n, "scaffold", a.seed)


@command("generate ga", N, SEED, opt("--generations", type=int, default=10), opt("--target-weight", type=float, default=400.0))
def _ga(s, df, a):
    return M.evolve(df, -F.abs(F.col("MolWt") - a.target_weight), a.n, a.generations, seed=a.seed)


FEATURES = ["MolWt", "HBD", "HBA", "RotatableBonds", "RingCount", "AromaticRings", "HeavyAtomCount", "FractionCSP3"]
LABEL, KIND, TASK = opt("--activity-col", default="activity"), opt("--model-type", default="random_forest"), opt("--task", default="regression")


def _numbered(df: DataFrame) -> DataFrame:
    return df if "source_index" in df.columns else df.withColumn("source_index", F.monotonically_increasing_id())


@command("model train", LABEL, KIND, TASK, opt("--model-path", required=True), opt("--split", default="random"), opt("--test-size", type=float, default=0.2))
def _train(s, df, a):
    model, metrics = W.train(M.with_properties(_numbered(df)), FEATURES, a.activity_col, "source_index", a.model_type, a.task, a.split, a.test_size)
    model.save(a.model_path)
    return metrics


@command("model predict", opt("--model-path", required=True))
def _predict(s, df, a):
    return modelling.PropertyModel.load(s, a.model_path).predict(M.with_properties(df))


@command("model evaluate", LABEL, opt("--model-path", required=True))
def _evaluate(s, df, a):
    model = modelling.PropertyModel.load(s, a.model_path)
    metrics = modelling.regression_metrics if model.task == "regression" else modelling.classification_metrics
    return metrics(model.predict(M.with_properties(df), "_p"), a.activity_col, "_p")


@command("model compare", LABEL, TASK, opt("--cv", type=int, default=5))
def _compare(s, df, a):
    return W.compare(M.with_properties(_numbered(df)), FEATURES, a.activity_col, "source_index", a.task, a.cv)


@command("pipeline quick-profile")
def _profile(s, df, a):
    return W.profile(df)


@command("pipeline screen-and-score", opt("--reference"), opt("--config"))
def _pipeline(s, df, a):
    c = W.Config.from_yaml(a.config) if a.config else None
    return W.screen_and_score(df, files.load(s, a.reference) if a.reference else None, config=c)


@command("workflow hit-to-lead", N, SEED, opt("--top-n", type=int, default=20))
def _hit(s, df, a):
    return W.hit_to_lead(df, a.n, a.top_n, a.seed)


@command("workflow denovo", N, SEED, opt("--strategy", default="brics"), opt("--top-n", type=int, default=30))
def _denovo(s, df, a):
    return W.denovo(df, a.strategy, a.n, a.top_n, a.seed)


@command("workflow optimize", N, SEED, opt("--lead", required=True), opt("--top-n", type=int, default=20))
def _optimize(s, df, a):
    return W.optimize_lead(s, a.lead, a.n, a.top_n, a.seed)


@command("viz distributions", opt("--property", required=True), opt("--bins", type=int, default=50))
def _histogram(s, df, a):
    return statistics.histogram(df, a.property, a.bins)


@command("viz correlation", opt("--properties", nargs="+", required=True))
def _correlation(s, df, a):
    return statistics.correlations(df, a.properties)


@command("viz structures", opt("--smiles", default="smiles"))
def _structures(s, df, a):
    """An SVG drawing of each molecule, in column svg."""
    return df.withColumn("svg", M.drawing(F.col(a.smiles)))


@command("dock prepare-protein")
def _protein(s, df, a):
    return files.prepare_protein(s, a.input)


DESCRIPTORS = {"MolWt": "MolWt", "NumHDonors": "HBD", "NumHAcceptors": "HBA", "NumRotatableBonds": "RotatableBonds", "RingCount": "RingCount", "NumAromaticRings": "AromaticRings", "FractionCSP3": "FractionCSP3", "MolLogP": "LogP", "TPSA": "TPSA", "MolMR": "MolMR", "qed": "QED", "HeavyAtomCount": "HeavyAtomCount", "NumHeteroatoms": "NumHeteroatoms"}


@command("analyze descriptors", opt("--names", nargs="+", default=sorted(DESCRIPTORS)))
def _descriptors(s, df, a):
    return M.with_properties(df).select(*df.columns, *[F.col(DESCRIPTORS[n]).cast("double").alias(n) for n in a.names if n in DESCRIPTORS])


@command("data fetch-bioactivity", opt("--max-results", type=int, default=10_000))
def _pages(s, df, a):
    return files.activities(s, a.input).limit(a.max_results)


@command("data fetch", opt("--max-results", type=int, default=100))
def _compounds(s, df, a):
    return files.compounds(s, a.input).limit(a.max_results)


@command("benchmark run", N, SEED, opt("--strategies", nargs="+", default=["brics", "mutate", "scaffold"]))
def _benchmark(s, df, a):
    return W.benchmark({x: (lambda seeds, n, x=x: W.analogs(seeds, n, x, a.seed)) for x in a.strategies}, df, a.n)


@command("benchmark compare", opt("--rank-by", default="uniqueness"), opt("--lower", action="store_true"))
def _ranked(s, df, a):
    return statistics.rank_strategies(s.read.csv(a.input, header=True, inferSchema=True), a.rank_by, not a.lower)


@command("generate active-pick", opt("--model-path", required=True), opt("--strategy", default="ucb"), opt("--batch-size", type=int, default=20), opt("--kappa", type=float, default=1.0))
def _pick(s, df, a):
    d = M.with_fingerprint(M.with_properties(_numbered(df)))
    if a.strategy == "diversity":
        return modelling.maxmin_pick(d, a.batch_size, "source_index")
    spread = modelling.PropertyModel.load(s, a.model_path).tree_spread(d, "source_index")
    rated = d.join(spread, "source_index")
    if a.strategy == "balanced":
        return modelling.acquire_balanced(rated, a.batch_size, "fp", id_="source_index")
    return modelling.acquire(rated, a.strategy, a.batch_size, kappa=a.kappa, id_="source_index")


@command("model info")
def _info_model(s, df, a):
    m = modelling.PropertyModel.load(s, a.input)
    top = sorted((m.importances() or {}).items(), key=lambda x: -x[1])[:10]
    return s.createDataFrame([(m.kind, m.task, len(m.features), json.dumps(dict(top)))], "kind string, task string, n_features int, top_features string")


@command("pipeline run", opt("--config", required=True))
def _run(s, df, a):
    return W.screen_and_score(df, config=W.Config.from_yaml(a.config))


@command("pipeline init-config")
def _init(s, df, a):
    W.Config().to_yaml(a.input)
    return s.createDataFrame([(a.input,)], "written string")


@command("viz scatter", opt("--x", required=True), opt("--y", required=True))
def _scatter(s, df, a):
    return df.select(a.x, a.y)


@command("viz chemical-space", opt("--properties", nargs="+", default=["MolWt", "HBD", "HBA", "RotatableBonds", "RingCount"]))
def _space(s, df, a):
    from pyspark.ml.feature import VectorAssembler

    d = M.with_properties(df).na.drop(subset=a.properties)
    return modelling.project(VectorAssembler(inputCols=a.properties, outputCol="features").transform(d)).drop("features")


@command("dock run", opt("--protein", required=True))
def _dock(s, df, a):
    return W.dock(df, a.protein)


@command("dock interactions", opt("--protein", required=True))
def _interactions(s, df, a):
    """Contacts of atoms given as two PDB files."""
    bare = lambda d: d.select("x", "y", "z", "element", F.lit(0).alias("mol"), F.lit(0).alias("hydrogens"), F.lit(0).alias("charge"), F.lit(None).cast("int").alias("ring"), F.lit(0).alias("ring_position"), F.lit(False).alias("aromatic"))
    return pairs.plif(pairs.contacts(bare(files.load_pdb(s, a.input)), bare(files.prepare_protein(s, a.protein))))


@command("workflow research-report", opt("--training-data", required=True))
def _research(s, df, a):
    return s.createDataFrame([(json.dumps(W.research_report(df, files.load(s, a.training_data)), default=str),)], "report string")


@command("workflow docking-report")
def _docking(s, df, a):
    return s.createDataFrame([(json.dumps(W.docking_report(s.read.csv(a.input, header=True, inferSchema=True)), default=str),)], "report string")


#: Commands whose input is no molecule file.
OWN_INPUT = ("data fetch", "data fetch-bioactivity", "data fetch-and-curate", "benchmark compare", "model info", "pipeline init-config", "dock prepare-protein", "dock run", "dock interactions", "workflow optimize", "workflow docking-report")


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="alembiq", description=__doc__)
    parser.add_argument("--version", action="version", version=__version__)
    groups = parser.add_subparsers(dest="group", required=True)
    made = {}
    for name, (_, options) in COMMANDS.items():
        group, action = name.split()
        if group not in made:
            made[group] = groups.add_parser(group).add_subparsers(dest="action", required=True)
        p = made[group].add_parser(action)
        p.add_argument("input")
        p.add_argument("output", nargs="?")
        p.add_argument("--smiles-col", default="smiles")
        for flag, how in options:
            p.add_argument(flag, **how)
    a = parser.parse_args(args)
    spark = session()
    f, _ = COMMANDS[f"{a.group} {a.action}"]
    df = None if f"{a.group} {a.action}" in OWN_INPUT else files.load(spark, a.input, getattr(a, "format", "auto"))
    out = f(spark, df, a)
    if a.output:
        files.save(out, a.output)
    else:
        for row in files.flat(out).limit(100).toJSON().collect():
            print(json.dumps(json.loads(row)))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())

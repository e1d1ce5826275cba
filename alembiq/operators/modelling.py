"""Feature tables, splits, metrics, models, applicability domains and acquisition."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import add

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LinearSVC, RandomForestClassifier
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import number
from ..session import checkpointed
from . import grams
from .diverse import maxmin_coreset, maxmin_pick  # noqa: F401
from .running import running_sum
from .statistics import correlation


def impute(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Null rows dropped; NaN and infinite values replaced by the column's finite mean (0 without one)."""
    have = df.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns]))
    finite = {c: F.when(~F.isnan(F.col(c)) & (F.abs(F.col(c)) != float("inf")), F.col(c)) for c in columns}
    means = have.agg(*[F.coalesce(F.avg(v), F.lit(0.0)).alias(f"_mean_{c}") for c, v in finite.items()])
    out = have.crossJoin(F.broadcast(means))
    return out.withColumns({c: F.coalesce(v, F.col(f"_mean_{c}")) for c, v in finite.items()}).drop(*[f"_mean_{c}" for c in columns])


#: A multiplier that both Spark and SQL can apply to integers without overflow (fixed value).
MIX = 2654435761


def id_hash(id_: Column, seed: int = 42) -> Column:
    """A reproducible integer of 0..2^32-1 for an integer id, in arithmetic any SQL engine has."""
    return F.pmod((F.pmod(id_.cast("long"), F.lit(1 << 28)) + seed) * F.lit(MIX), F.lit(1 << 32))


def random_split(df: DataFrame, id_: str, test: float = 0.2, seed: int = 42) -> DataFrame:
    """``df`` with is_test: rows whose hash falls below the share."""
    return df.withColumn("is_test", id_hash(F.col(id_), seed) < int(test * (1 << 32)))


def folds(df: DataFrame, id_: str, k: int = 5, seed: int = 42, label: str | None = None) -> DataFrame:
    """``df`` with a fold of 0..k-1. With a label, folds are even within each class, up to a row a task."""
    h = id_hash(F.col(id_), seed)
    if label is None:
        return df.withColumn("fold", F.pmod(F.shiftright(h, 8), F.lit(k)).cast("int"))
    part = F.pmod(F.shiftright(h, 4), F.lit(64))
    turn = F.row_number().over(Window.partitionBy(label, "_p").orderBy("_h", id_))
    return df.withColumn("_h", h).withColumn("_p", part).withColumn("fold", F.pmod(turn + F.col("_p"), F.lit(k)).cast("int")).drop("_h", "_p")


def group_split(df: DataFrame, group: str, test: float = 0.2, seed: int = 42) -> DataFrame:
    """``df`` with is_test: whole groups, in a hashed order, until the share is reached; the last group may exceed it. Null groups count as one."""
    g = F.coalesce(F.col(group).cast("string"), F.lit(""))
    sizes = df.groupBy(g.alias("_g")).agg(F.count("*").alias("_n"))
    order = [F.md5(F.concat(F.col("_g"), F.lit(f":{seed}"))), F.col("_g")]
    placed = running_sum(sizes, order, "_n", "_upto").select("_g", (F.col("_upto") - F.col("_n")).alias("_before"))
    n = df.agg((F.floor(F.count("*") * test)).alias("_limit"))
    tested = placed.crossJoin(F.broadcast(n)).select("_g", (F.col("_before") < F.col("_limit")).alias("is_test"))
    return df.withColumn("_g", g).join(tested, "_g").drop("_g")


def scale(df: DataFrame, columns: Sequence[str], fit_on: Column | None = None) -> DataFrame:
    """Columns scaled by mean and population deviation of the rows chosen; constant columns become 0."""
    base = df if fit_on is None else df.where(fit_on)
    stats = base.agg(*[f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    out = df.crossJoin(F.broadcast(stats))
    new = {c: (F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") > 0, F.col(f"_s_{c}")).otherwise(1.0) for c in columns}
    return out.withColumns(new).drop(*[f"_{n}_{c}" for c in columns for n in "ms"])


def regression_metrics(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """One row: n, r2, rmse, mae, pearson (0 where undefined), from sums of one pass."""
    y, p = F.col(truth).cast("double"), F.col(predicted).cast("double")
    a = df.where(y.isNotNull() & p.isNotNull()).agg(F.count("*").alias("n"), F.sum((y - p) * (y - p)).alias("sse"), F.var_pop(y).alias("v"), F.avg(F.abs(y - p)).alias("mae"), correlation(y, p).alias("r"))
    return a.select("n", F.when(F.col("v") > 0, 1 - F.col("sse") / (F.col("v") * F.col("n"))).otherwise(0.0).alias("r2"), F.sqrt(F.col("sse") / F.col("n")).alias("rmse"), "mae", F.coalesce("r", F.lit(0.0)).alias("pearson"))


def classification_metrics(df: DataFrame, truth: str, predicted: str, positive: int = 1) -> DataFrame:
    """One row: n, accuracy, precision, recall, f1, mcc of a binary label; undefined ratios are 0."""
    y, p = F.col(truth) == positive, F.col(predicted) == positive
    c = df.where(y.isNotNull() & p.isNotNull()).agg(*[F.count_if(e).cast("double").alias(k) for k, e in (("tp", y & p), ("fp", ~y & p), ("fn", y & ~p), ("tn", ~y & ~p))])
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    mcc = ratio(tp * tn - fp * fn, F.sqrt(tp + fp) * F.sqrt(tp + fn) * F.sqrt(tn + fp) * F.sqrt(tn + fn))
    return c.select((tp + fp + fn + tn).cast("long").alias("n"), ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"), ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), mcc.alias("mcc"))


REGRESSORS = {"random_forest": lambda: RandomForestRegressor(numTrees=100, maxDepth=10, seed=42), "gradient_boosting": lambda: GBTRegressor(maxIter=100, maxDepth=5, stepSize=0.1, subsamplingRate=0.8, seed=42), "linear": lambda: LinearRegression(regParam=0.01)}
CLASSIFIERS = {"random_forest": lambda: RandomForestClassifier(numTrees=100, maxDepth=10, seed=42), "gradient_boosting": lambda: GBTClassifier(maxIter=100, maxDepth=5, stepSize=0.1, subsamplingRate=0.8, seed=42), "linear_svc": lambda: LinearSVC(regParam=0.01)}


@dataclass
class PropertyModel:
    """Scaler and estimator in one pipeline, so rows are scaled once, whatever they are used for."""

    pipeline: PipelineModel
    features: list[str]
    kind: str
    task: str

    @classmethod
    def fit(cls, df: DataFrame, features: Sequence[str], label: str, kind: str = "random_forest", task: str = "regression", **params) -> PropertyModel:
        makers = REGRESSORS if task == "regression" else CLASSIFIERS
        if kind not in makers:
            raise ValueError(f"{kind!r} is not one of {sorted(makers)} for {task}")
        est = makers[kind]().setLabelCol("_label").setFeaturesCol("_scaled").setPredictionCol("_prediction")
        for k, v in params.items():
            est = est._set(**{k: v})
        stages = [VectorAssembler(inputCols=list(features), outputCol="_features", handleInvalid="skip"), StandardScaler(inputCol="_features", outputCol="_scaled", withMean=True, withStd=True), est]
        data = df.where(F.col(label).isNotNull()).withColumn("_label", F.col(label).cast("double"))
        return cls(Pipeline(stages=stages).fit(data), list(features), kind, task)

    def predict(self, df: DataFrame, out: str = "predicted_activity") -> DataFrame:
        """``df`` with predictions; rows with missing features keep a null. Classifiers also give <out>_proba."""
        missing = reduce(lambda a, b: a | b, [F.col(c).isNull() | F.isnan(F.col(c).cast("double")) for c in self.features])
        filled = df.withColumns({f"_in_{c}": F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)) for c in self.features})
        kept = {c: F.col(c) for c in df.columns}
        work = filled.select(*[F.col(c).alias(f"_keep_{i}") for i, c in enumerate(kept)], *[F.col(f"_in_{c}").alias(c) for c in self.features], missing.alias("_missing"))
        scored = self.pipeline.transform(work)
        new = [F.when(~F.col("_missing"), F.col("_prediction")).alias(out)]
        if "probability" in scored.columns:
            new.append(F.when(~F.col("_missing"), vector_to_array("probability")[1]).alias(f"{out}_proba"))
        return scored.select(*[F.col(f"_keep_{i}").alias(c) for i, c in enumerate(kept)], *new)

    @property
    def estimator(self):
        return self.pipeline.stages[-1]

    def importances(self) -> dict[str, float] | None:
        found = getattr(self.estimator, "featureImportances", None)
        return None if found is None else dict(zip(self.features, found.toArray().tolist()))

    def tree_spread(self, df: DataFrame, id_: str) -> DataFrame:
        """id, mean, std (population) and spread (max - min) of the trees' own predictions, a pass over ``df`` for all trees together."""
        ready = PipelineModel(self.pipeline.stages[:-1]).transform(df).select(id_, "_scaled")
        for i, tree in enumerate(self.estimator.trees):
            ready = tree.setFeaturesCol("_scaled").setPredictionCol(f"_t{i}").transform(ready).drop("rawPrediction", "probability")
        each = F.array(*[F.col(f"_t{i}") for i in range(len(self.estimator.trees))])
        n = len(self.estimator.trees)
        mean = F.aggregate(each, F.lit(0.0), lambda s, x: s + x) / n
        rows = ready.select(id_, each.alias("e"), mean.alias("mean"))
        var = F.aggregate("e", F.lit(0.0), lambda s, x: s + (x - F.col("mean")) * (x - F.col("mean"))) / n
        return rows.select(id_, "mean", F.sqrt(var).alias("std"), (F.array_max("e") - F.array_min("e")).alias("spread"))

    def save(self, path: str) -> None:
        self.pipeline.write().overwrite().save(f"{path}/pipeline")
        spark = self.pipeline.stages[0]._java_obj and __import__("pyspark").sql.SparkSession.active()
        spark.createDataFrame([(json.dumps({"features": self.features, "kind": self.kind, "task": self.task, "version": "1.0"}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/about")

    @classmethod
    def load(cls, spark, path: str) -> PropertyModel:
        about = json.loads(spark.read.text(f"{path}/about").first()[0])
        return cls(PipelineModel.load(f"{path}/pipeline"), about["features"], about["kind"], about["task"])


def cross_validate(df: DataFrame, features: Sequence[str], label: str, id_: str, kind: str = "random_forest", task: str = "regression", k: int = 5, **params) -> DataFrame:
    """One row a fold of metrics on the rows left out; scalers are fitted on each fold's training rows alone."""
    placed = checkpointed(folds(df, id_, k, label=label if task == "classification" else None), "folds")
    out = None
    for i in range(k):
        model = PropertyModel.fit(placed.where(F.col("fold") != i), features, label, kind, task, **params)
        scored = model.predict(placed.where(F.col("fold") == i), "_p")
        m = (regression_metrics if task == "regression" else classification_metrics)(scored, label, "_p").withColumn("fold", F.lit(i))
        out = m if out is None else out.unionByName(m)
    return out


def shuffled_labels(df: DataFrame, label: str, id_: str, seed: int) -> DataFrame:
    """``df`` with the labels dealt out anew: the labels sorted by one hash meet the rows sorted by another. Ids must be distinct."""

    def numbered(columns: list[Column], by: int) -> DataFrame:
        rows = df.select(*columns, F.col(id_).alias("_id"), F.lit(1).alias("_one")).withColumn("_h", id_hash(F.col("_id"), by))
        return running_sum(rows, [F.col("_h"), F.col("_id")], "_one", "_i").drop("_id", "_one", "_h")

    labels = numbered([F.col(label).alias("_new")], seed + 1000)
    return numbered([F.col(c) for c in df.columns], seed).join(labels, "_i").drop(label, "_i").withColumnRenamed("_new", label)


def y_randomization(df: DataFrame, features: Sequence[str], label: str, id_: str, kind: str = "random_forest", n: int = 10, **params) -> dict:
    """Training r2 with true labels against ``n`` shuffles; valid where it exceeds their mean by two deviations."""
    fit = lambda d: regression_metrics(PropertyModel.fit(d, features, label, kind, **params).predict(d, "_p"), label, "_p").first()["r2"]
    original, null = fit(df), [fit(shuffled_labels(df, label, id_, s)) for s in range(n)]
    mean, std = float(np.mean(null)), float(np.std(null))
    return {"original": original, "mean": mean, "std": std, "valid": original > mean + 2 * std}


def leverage_domain(train: DataFrame, query: DataFrame, columns: Sequence[str], factor: float = 3.0) -> DataFrame:
    """``query`` with leverage and in_domain (leverage <= factor * p / n), null where a value is missing; see ``grams.leverage`` for vectors."""
    rows = query.withColumn("_x", grams.vector(columns))
    return grams.leverage(train.select(grams.vector(columns).alias("_x")), rows, "_x", factor).drop("_x")


def distance_domain(train: DataFrame, query: DataFrame, columns: Sequence[str], factor: float = 3.0) -> DataFrame:
    """``query`` with distance to the training centroid and in_domain (distance <= mean + factor * population deviation)."""
    centre = train.agg(*[F.avg(c).alias(f"_c_{c}") for c in columns])
    d = F.sqrt(reduce(add, [(F.col(c) - F.col(f"_c_{c}")) * (F.col(c) - F.col(f"_c_{c}")) for c in columns]))
    limit = train.crossJoin(F.broadcast(centre)).agg((F.avg(d) + factor * F.stddev_pop(d)).alias("_limit"))
    out = query.crossJoin(F.broadcast(centre)).crossJoin(F.broadcast(limit)).withColumn("distance", d)
    return out.withColumn("in_domain", F.col("distance") <= F.col("_limit")).drop("_limit", *[f"_c_{c}" for c in columns])


def acquire(df: DataFrame, strategy: str, n: int, mean: str = "mean", std: str = "std", kappa: float = 1.0, id_: str = "id") -> DataFrame:
    """The batch by prediction (greedy), deviation (uncertainty) or mean + kappa * deviation (ucb); ties by id."""
    score = {"greedy": F.col(mean), "uncertainty": F.col(std), "ucb": F.col(mean) + kappa * F.col(std)}[strategy]
    return df.withColumn("acquisition", score).orderBy(F.col("acquisition").desc(), id_).limit(n).withColumn("strategy", F.lit(strategy))


def acquire_balanced(df: DataFrame, n: int, fp: str, exploration: float = 0.5, mean: str = "mean", std: str = "std", id_: str = "id") -> DataFrame:
    """max(1, n(1-w)) best, then max(1, nw/2) most uncertain of the rest, the remainder most diverse."""
    exploit, explore = max(1, int(n * (1 - exploration))), max(1, int(n * exploration / 2))
    best = acquire(df, "greedy", exploit, mean, std, id_=id_).select(id_, F.lit("exploit").alias("reason"))
    unsure = acquire(df.join(best, id_, "left_anti"), "uncertainty", explore, mean, std, id_=id_).select(id_, F.lit("uncertain").alias("reason"))
    taken = best.unionByName(unsure).limit(n)
    more = n - min(n, exploit + explore)
    if more > 0:
        rest = df.join(taken, id_, "left_anti")
        taken = taken.unionByName(maxmin_pick(rest, more, id_, fp).select(id_, F.lit("diverse").alias("reason")))
    return df.join(taken, id_)


def cluster_pick(df: DataFrame, n: int, vector: str = "features", id_: str = "id", seed: int = 42) -> DataFrame:
    """The row nearest each of ``n`` k-means centres."""
    from pyspark.ml.clustering import KMeans

    model = KMeans(k=n, seed=seed, featuresCol=vector, predictionCol="cluster").fit(df)
    centres = [c.tolist() for c in model.clusterCenters()]
    table = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in centres])
    near = F.aggregate(F.zip_with(vector_to_array(vector), F.get(table, F.col("cluster")), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    return model.transform(df).groupBy("cluster").agg(F.min_by(id_, F.struct(near, F.col(id_))).alias(id_))


def project(df: DataFrame, vector: str = "features", k: int = 2) -> DataFrame:
    """``df`` with the first principal components as pc1, pc2, ..."""
    out = PCA(k=k, inputCol=vector, outputCol="_pc").fit(df).transform(df)
    parts = vector_to_array("_pc")
    return out.withColumns({f"pc{i + 1}": parts[i] for i in range(k)}).drop("_pc")

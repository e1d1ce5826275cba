"""Summaries, novelty and set measures, correlations and report statistics."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.scores import number
from . import running
from .membership import occurring


def numeric_summary(df: DataFrame, columns: Sequence[str], sample: bool = False) -> DataFrame:
    """property, count, mean, std (of the population, or the sample), min, max, median: one row a column, in one pass over the table and a few for all medians together."""
    std = F.stddev_samp if sample else F.stddev_pop
    middles = running.many_quantiles(df, columns, [0.5])
    rows = []
    for c in columns:
        v = number(F.col(c))
        middle = F.lit(middles[c][0]).cast("double")
        rows.append(F.struct(F.lit(c).alias("property"), F.count(v).alias("count"), F.avg(v).alias("mean"), std(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"), middle.alias("median")))
    return df.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))


def pass_rates(df: DataFrame, flags: Sequence[str]) -> DataFrame:
    """flag, rate: the share of true among the rows where the flag is present."""
    rows = [F.struct(F.lit(c).alias("flag"), F.avg(F.col(c).cast("int")).alias("rate")) for c in flags]
    return df.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))


def quartiles(df: DataFrame, column: str) -> DataFrame:
    """n, mean, std (sample), min, q1, median, q3, iqr, max; quartiles are interpolated."""
    v = number(F.col(column))
    q = F.array(*[F.lit(x).cast("double") for x in running.quantiles(df, column, [0.25, 0.5, 0.75])])
    out = df.agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), q.alias("q"), F.max(v).alias("max"))
    return out.select("n", "mean", "std", "min", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"), (F.col("q")[2] - F.col("q")[0]).alias("iqr"), "max")


def tiers(df: DataFrame, column: str, cuts: Sequence[float], names: Sequence[str]) -> DataFrame:
    """tier, n: rows by the first cut they do not exceed; the last name takes the rest. Missing values are left out."""
    v = number(F.col(column))
    tier: Column = F.when(F.lit(False), F.lit(""))
    for cut, name in zip(cuts, names):
        tier = tier.when(v <= cut, name)
    return df.where(v.isNotNull()).groupBy(tier.otherwise(names[-1]).alias("tier")).agg(F.count("*").alias("n"))


def histogram(df: DataFrame, column: str, bins: int = 50) -> DataFrame:
    """bin, low, high, n over the range of the column; the maximum falls in the last bin."""
    v = number(F.col(column))
    low, high = df.agg(F.min(v), F.max(v)).first()
    if low is None:
        return df.sparkSession.createDataFrame([], "bin int, low double, high double, n long")
    width = (high - low) / bins or 1.0
    b = F.least(F.floor((v - low) / width), F.lit(bins - 1)).cast("int")
    return df.where(v.isNotNull()).groupBy(b.alias("bin")).agg(F.count("*").alias("n")).select("bin", (F.lit(low) + F.col("bin") * width).alias("low"), (F.lit(low) + (F.col("bin") + 1) * width).alias("high"), "n")


def correlation(x: Column, y: Column) -> Column:
    """Pearson's coefficient as an aggregate over rows where both are present; null where either is constant (``corr`` fails there in ANSI mode)."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    return F.covar_pop(a, b) / F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0))


def average_rank(df: DataFrame, column: str, out: str) -> DataFrame:
    """``df`` with the mean rank of each row's value. Ranks come from counts of distinct values, joined back."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("_v")).agg(F.count("*").alias("_n"))
    upto = running.running_sum(counts, [F.col("_v")], "_n", "_upto")
    ranks = upto.select("_v", (F.col("_upto") - (F.col("_n") - 1) / 2).alias(out))
    return df.join(ranks, F.col(column) == F.col("_v"), "left").drop("_v")


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """rho, n and p (of no correlation, two-sided) over the rows where both are present."""
    both = df.select(number(F.col(x)).alias("x"), number(F.col(y)).alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    ranked = average_rank(average_rank(both, "x", "rx"), "y", "ry")
    found = ranked.agg(correlation(F.col("rx"), F.col("ry")).alias("rho"), F.count("*").alias("n"))
    return found.withColumn("p", correlation_p(F.col("rho"), F.col("n")))


#: Terms of the series and levels of the continued fraction, and steps to where the asymptotic series of the gamma function holds.
_TERMS, _LEVELS, _STEPS = 300, 200, 32


def _log_gamma_ratio(a: Column) -> Column:
    """ln Gamma(a + 1/2) - ln Gamma(a), from its asymptotic series at a + _STEPS and the recurrence."""
    z = a + _STEPS
    far = F.log(z) / 2 - 1 / (8 * z) + 1 / (192 * z * z * z) - 1 / (640 * z * z * z * z * z)
    return far + F.aggregate(F.sequence(F.lit(0), F.lit(_STEPS - 1)), F.lit(0.0), lambda s, i: s + F.log((a + i) / (a + i + 0.5)))


def correlation_p(r: Column, n: Column) -> Column:
    """Two-sided p of a correlation ``r`` of ``n`` pairs where there is none: the regularised incomplete beta function of 1 - r^2 with (n - 2) / 2 and 1 / 2.

    Null for a null ``r`` and for fewer than three pairs. A power series near r = 0, a continued fraction elsewhere.
    """
    c, y = (n.cast("double") - 2) / 2, F.least(F.lit(1.0), r * r)
    front = F.exp(c * F.log1p(-y) + F.log(y) / 2 + _log_gamma_ratio(c) - math.log(math.pi) / 2)
    term = lambda s, k: F.struct((s["t"] * (c + 0.5 + k) / (1.5 + k) * y).alias("t"), (s["s"] + s["t"]).alias("s"))
    series = F.aggregate(F.sequence(F.lit(0), F.lit(_TERMS)), F.struct(F.lit(1.0).alias("t"), F.lit(0.0).alias("s")), term)["s"]

    def level(s: Column, k: Column) -> Column:
        """Two steps of the continued fraction, for terms 2k and 2k + 1."""
        x, out = 1 - y, s
        even = k * (0.5 - k) * x / ((c + 2 * k - 1) * (c + 2 * k))
        odd = -(c + k) * (c + 0.5 + k) * x / ((c + 2 * k) * (c + 2 * k + 1))
        for a in (even, odd):
            d, e = 1 / (1 + a * out["d"]), 1 + a / out["e"]
            out = F.struct(d.alias("d"), e.alias("e"), (out["h"] * d * e).alias("h"))
        return out

    first = 1 / (1 - (c + 0.5) * (1 - y) / (c + 1))
    fraction = F.aggregate(F.sequence(F.lit(1), F.lit(_LEVELS)), F.struct(first.alias("d"), F.lit(1.0).alias("e"), first.alias("h")), level)["h"]
    near = y <= F.least(F.lit(0.5), 16 / (c + 16))
    inside = F.when(y == 0, 1.0).when(y == 1, 0.0).when(near, 1 - 2 * front * series).otherwise(front / c * fraction)
    return F.when(r.isNotNull() & (n > 2), F.greatest(F.lit(0.0), F.least(F.lit(1.0), inside)))


def density(df: DataFrame, column: str, points: int = 200, cut: float = 3.0, bandwidth: float | None = None) -> DataFrame:
    """point, x, density: a Gaussian density estimate over a grid that reaches ``cut`` bandwidths beyond the values.

    The bandwidth is that of Scott's rule unless given. A value is shared between the two grid points next to it
    (linear binning), so one pass gives the weights of the grid, which the kernel is then summed over, whatever the
    bandwidth and the number of rows. No result for fewer than two values, or equal ones without a bandwidth.
    """
    v = number(F.col(column))
    n, low, high, std = df.agg(F.count(v), F.min(v), F.max(v), F.stddev_samp(v)).first()
    h = bandwidth or (std or 0.0) * n ** -0.2 if n > 1 else 0.0
    if not h:
        return df.sparkSession.createDataFrame([], "point int, x double, density double")
    start = low - cut * h
    step = (high + cut * h - start) / (points - 1)
    at = (v - start) / step
    left = F.least(F.floor(at), F.lit(points - 2)).cast("int")
    shares = F.array(F.struct(left.alias("i"), (1 - (at - left)).alias("w")), F.struct((left + 1).alias("i"), (at - left).alias("w")))
    # One row a grid point.
    weights = df.where(v.isNotNull()).select(F.explode(shares).alias("s")).groupBy("s.i").agg(F.sum("s.w").alias("w")).agg(F.sort_array(F.collect_list(F.struct("i", "w"))).alias("weights"))
    grid = df.sparkSession.range(0, points, 1, 1).select(F.col("id").cast("int").alias("point")).join(F.broadcast(weights))
    kernel = lambda s: s["w"] * F.exp(-((F.col("point") - s["i"]) * step / h) * ((F.col("point") - s["i"]) * step / h) / 2)
    total = F.aggregate("weights", F.lit(0.0), lambda a, s: a + kernel(s))
    return grid.select("point", (F.lit(start) + F.col("point") * step).alias("x"), (total / (n * h * math.sqrt(2 * math.pi))).alias("density"))


def trend(df: DataFrame, x: str, y: str) -> DataFrame:
    """Slope and intercept of the least-squares line; null where ``x`` is constant."""
    a, b = (F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), F.col(c).cast("double")) for c in (x, y))
    out = df.agg((F.covar_pop(a, b) / F.nullif(F.var_pop(a), F.lit(0.0))).alias("slope"), F.avg(a).alias("_a"), F.avg(b).alias("_b"))
    return out.select("slope", (F.col("_b") - F.col("slope") * F.col("_a")).alias("intercept"))


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """a, b, r for all pairs of columns, each over the rows where both are present, in one pass."""
    cells = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), correlation(number(F.col(a)), number(F.col(b))).alias("r")) for i, a in enumerate(columns) for b in columns[i:]]
    return df.agg(F.array(*cells).alias("rows")).select(F.inline("rows"))


def risk_levels(df: DataFrame, flags: Sequence[str]) -> DataFrame:
    """flag, level, n: low, moderate and high counted as green, yellow and red."""
    level = lambda c: F.when(F.lower(c) == "low", "green").when(F.lower(c) == "moderate", "yellow").when(F.lower(c) == "high", "red").otherwise(F.lower(c))
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("flag"), level(F.col(c).cast("string")).alias("level")) for c in flags])).alias("x")).select("x.*")
    return long.where("level IS NOT NULL").groupBy("flag", "level").agg(F.count("*").alias("n"))


def liabilities(df: DataFrame, flags: Sequence[str], bad: str = "red") -> DataFrame:
    """flag, n: how often each flag is ``bad``, most often first."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("flag"), F.col(c).alias("level")) for c in flags])).alias("x")).select("x.*")
    return long.where(F.col("level") == bad).groupBy("flag").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "flag")


def generation_metrics(generated: DataFrame, reference: DataFrame | None = None, smiles: str = "smiles") -> DataFrame:
    """One row: n, validity, uniqueness, and novelty (row-wise share of valid ones absent from the reference)."""
    rows = generated.agg(F.count("*").alias("n"), F.count(smiles).alias("n_valid"), F.count_distinct(smiles).alias("n_distinct"))
    rate = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    out = rows.select("n", rate("n_valid", "n").alias("validity"), rate("n_distinct", "n_valid").alias("uniqueness"), "n_valid")
    if reference is not None:
        new = generated.where(F.col(smiles).isNotNull()).join(occurring(reference, generated, smiles), smiles, "left_anti").agg(F.count("*").alias("n_new"))
        out = out.crossJoin(new).withColumn("novelty", rate("n_new", "n_valid")).drop("n_new")
    return out.drop("n_valid")


def drug_like_rate(df: DataFrame) -> DataFrame:
    return df.agg(F.avg(rules.lipinski(1).cast("int")).alias("drug_likeness_rate"))


def generation_summary(original: DataFrame, generated: DataFrame, smiles: str = "smiles") -> DataFrame:
    """One row: n_original, n_generated, n_unique, n_novel, uniqueness_rate, novelty_rate (distinct structures)."""
    u = generated.where(F.col(smiles).isNotNull()).select(smiles).distinct()
    novel = u.exceptAll(u.join(occurring(original, generated, smiles), smiles, "left_semi")).agg(F.count("*").alias("n_novel"))
    out = original.agg(F.count("*").alias("n_original")).crossJoin(generated.agg(F.count("*").alias("n_generated"))).crossJoin(u.agg(F.count("*").alias("n_unique"))).crossJoin(novel)
    rate = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return out.withColumn("uniqueness_rate", rate("n_unique", "n_generated")).withColumn("novelty_rate", rate("n_novel", "n_unique"))


def fragment_library(df: DataFrame, fragments: str, min_frequency: int = 2, most: int = 500) -> DataFrame:
    """fragment, n: rows that hold each fragment (once a row), the most frequent first; a top-k report."""
    each = df.select(F.explode(F.array_distinct(fragments)).alias("fragment"))
    return each.groupBy("fragment").agg(F.count("*").alias("n")).where(F.col("n") >= min_frequency).orderBy(F.col("n").desc(), "fragment").limit(most)


def compare_strategies(results: DataFrame, decimals: int = 4) -> DataFrame:
    """Long (strategy, metric, value) to one row a strategy and one rounded column a metric."""
    return results.groupBy("strategy").pivot("metric").agg(F.round(F.first("value"), decimals))


def rank_strategies(wide: DataFrame, metric: str, higher: bool = True) -> DataFrame:
    v = F.coalesce(F.col(metric), F.lit(0.0))
    return wide.select("strategy", v.alias("value")).orderBy(F.col("value").desc() if higher else F.col("value").asc(), "strategy")


def left_join_first(top: DataFrame, other: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """``top`` with the columns of the first row of ``other`` (by ``order``) that has its key."""
    rest = [c for c in other.columns if c != key]
    first = other.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(key, *[F.col(f"_r.{c}").alias(c) for c in rest])
    return top.join(first, key, "left")


#: Words in provenance steps, and the phase they show (fixed values); the first row that matches decides.
PHASES = {
    "phase1_data": ("validate", "standardize"),
    "phase1_analysis": ("properties", "fingerprint", "filter", "descriptor"),
    "phase2_screening": ("qsar", "screen", "score", "sa_score", "drug_likeness"),
    "phase3_generation": ("brics", "mutation", "scaffold", "ga_"),
    "phase4_structure": ("conformer", "ligand_prep", "shape", "docking", "plif"),
}


def phase(step: Column) -> Column:
    out: Column = F.when(F.lit(False), F.lit(""))
    for name, marks in PHASES.items():
        out = out.when(step.rlike("|".join(marks)), name)
    return out


def phases_applied(df: DataFrame, provenance: str = "provenance") -> DataFrame:
    """phase, n: the phases that the steps of all rows show, with their number of steps."""
    steps = df.select(F.explode(provenance).alias("step"))
    return steps.select(phase(F.col("step")).alias("phase")).where("phase IS NOT NULL").groupBy("phase").agg(F.count("*").alias("n"))


def report_ranking(df: DataFrame, weights: Mapping[str, tuple[float, bool]]) -> DataFrame:
    """Composite of columns scaled to 0..1 (flag true: low is good), by weight, rounded to 4."""
    stats = df.agg(*[f(c).alias(f"_{n}_{c}") for c in weights for n, f in (("lo", F.min), ("hi", F.max))])
    out = df.crossJoin(F.broadcast(stats))
    total = None
    for c, (w, low) in weights.items():
        x = (F.col(c) - F.col(f"_lo_{c}")) / (F.col(f"_hi_{c}") - F.col(f"_lo_{c}") + 1e-9)
        part = w * (1 - x if low else x)
        total = part if total is None else total + part
    return out.withColumn("composite_score", F.round(total, 4)).drop(*[f"_{n}_{c}" for c in weights for n in ("lo", "hi")])

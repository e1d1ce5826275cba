"""URL filter: host and path rules, and gradient-boosted trees on lexical features for what no rule covers.

The trees learn from labelled URLs (in the registered query: those that a rule judges). Their features are
columns: lengths, depth, digit ratios, entropy, parameters, marks, and statistics of the host's suffixes (last label, last two),
of the path's first segment and of its extension, namely how often each is blocked and how often it is seen
among the labelled URLs. A labelled URL's own fold is left out of its statistics, so the trees do not
learn from their own labels. The labelled URLs are a sample by hash of about MAX_LABELLED distinct ones; the statistics
have at most as many keys, hence are broadcast, and scoring shuffles nothing.

Defined results: a null URL, or one without ``://``, has an empty host and path, no rule, and is judged by its features
(null: those of an empty text); equal URLs have equal verdicts; where the labelled URLs are of one kind all others are
judged alike, and without any they are allowed; an empty table gives an empty result. Labels that are neither 0 nor 1
are left out, of a URL labelled both ways the larger (blocked) counts. Further columns of the input are kept, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import lower_ascii, table, written
from .learning import MAX_LABELLED

#: Rules of the registered query: whether it allows, host, path (fixed values of the contract).
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Rules at most that are judged as one expression.
MAX_RULES = 1000
#: Folds of the labelled URLs, trees and their depth, and labels that a statistic's prior counts as.
FOLDS, TREES, DEPTH, PRIOR = 5, 20, 4, 5.0
#: Score from which a URL is blocked.
THRESHOLD = 0.5

ALLOW, BLOCK = "allow", "block"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    rest = F.regexp_extract(url, r"(?s)://(.*)$", 1)
    found = lambda pattern: F.coalesce(F.regexp_extract(rest, pattern, 1), F.lit(""))
    return lower_ascii(found(r"(?s)^([^/?#]*)")), found(r"(?s)^[^/?#]*([^?#]*)")


def judged_by_rules(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits (host and path as one text), and its verdict; null where none fits.

    A rule fits its host and all subdomains, if the path starts with the rule's. Of equal rules the first counts.
    """
    if len(rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules")
    name, verdict = F.when(F.lit(False), F.lit("")), F.when(F.lit(False), F.lit(""))
    for v, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))
        name, verdict = name.when(fits, h + p), verdict.when(fits, v)
    return name, verdict


def _entropy(text: Column) -> Column:
    """Bits a character, of the characters' frequencies; 0 for an empty text."""
    n = F.length(text)
    seen = F.filter(F.array_distinct(F.split(text, "")), lambda c: c != "")
    shares = F.transform(seen, lambda c: (n - F.length(F.replace(text, c))) / F.greatest(n, F.lit(1)))
    bits = F.aggregate(shares, F.lit(0.0), lambda s, p: s - F.when(p > 0, p * F.log2(p)).otherwise(0.0))
    return F.when(n > 0, bits).otherwise(0.0)


def lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    """Numbers that depend on the URL alone."""
    count = lambda text, pattern: F.regexp_count(text, F.lit(pattern)).cast("double")
    size = lambda text: F.length(text).cast("double")
    ratio = lambda text, pattern: F.when(F.length(text) > 0, count(text, pattern) / F.length(text)).otherwise(0.0)
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    return {
        "url_length": size(url), "host_length": size(host), "path_length": size(path), "query_length": size(query),
        "depth": count(path, "/[^/]"), "labels": count(host, "[^.]+"), "parameters": count(query, "[^&;]+"), "values": count(query, "="),
        "digit_ratio": ratio(url, "[0-9]"), "host_digits": ratio(host, "[0-9]"), "path_digits": ratio(path, "[0-9]"),
        "hyphens": count(host, "-"), "escapes": count(url, "%[0-9A-Fa-f]{2}"), "marks": ratio(url, "[^A-Za-z0-9]"),
        "longest_run": F.coalesce(F.array_max(F.transform(F.regexp_extract_all(url, F.lit("([A-Za-z0-9]+)")), F.length)), F.lit(0)).cast("double"),
        "secure": F.startswith(url, F.lit("https:")).cast("double"), "fragment": F.contains(url, F.lit("#")).cast("double"), "entropy": _entropy(url), "host_entropy": _entropy(host),
    }


def keys(host: Column, path: Column) -> dict[str, Column]:
    """The texts of which statistics are kept."""
    labels = F.split(host, r"\.")
    return {
        "suffix": F.element_at(labels, -1),
        "domain": F.concat_ws(".", F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2)),
        "head": F.regexp_extract(path, "^/?([^/]*)", 1),
        "extension": F.regexp_extract(path, r"\.([A-Za-z0-9]{1,8})$", 1),
    }


STATISTICS = ("suffix", "domain", "head", "extension")


def _features() -> Column:
    """All features of rows that have url, host, path and, of each statistic's text, the rate and the number seen."""
    numbers = [*lexical(F.col("url"), F.col("host"), F.col("path")).values(), *[F.col(f"{k}_{x}") for k in STATISTICS for x in ("rate", "seen")]]
    return array_to_vector(F.array(*[F.coalesce(n, F.lit(0.0)) for n in numbers]))


def _rate(blocked: Column, seen: Column, base: float) -> Column:
    return (blocked + PRIOR * base) / (seen + PRIOR)


@dataclass(frozen=True)
class UrlFilter:
    """Trees (none where the labels were of one kind, or missing), the share blocked of the labelled, and the statistics by text."""

    trees: GBTClassificationModel | None
    base: float
    statistics: dict[str, DataFrame]

    def score(self, df: DataFrame, url: str = "url") -> DataFrame:
        """``df`` as a struct ``row``, with host, path and score (0 to 1, higher: blocked likelier)."""
        text = F.coalesce(F.col(url).cast("string"), F.lit(""))
        host, path = host_and_path(F.col("url"))
        rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), text.alias("url")).select("*", host.alias("host"), path.alias("path"))
        if self.trees is None:
            return rows.select("row", "host", "path", F.lit(self.base).alias("score"))
        rows = rows.withColumns(keys(F.col("host"), F.col("path")))
        for k in STATISTICS:
            rows = rows.join(F.broadcast(self.statistics[k]), k, "left").withColumns({f"{k}_rate": F.coalesce(f"{k}_rate", F.lit(self.base)), f"{k}_seen": F.coalesce(f"{k}_seen", F.lit(0.0))})
        scored = self.trees.transform(rows.withColumn("features", _features()))
        return scored.select("row", "host", "path", vector_to_array("probability")[1].alias("score"))

    def judge(self, df: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, url: str = "url") -> DataFrame:
        """``df`` as a struct ``row``, with host, path, rule and verdict: the longest rule's, else the trees'."""
        rule, verdict = judged_by_rules(F.col("host"), F.col("path"), rules)
        learned = F.when(F.col("score") >= THRESHOLD, BLOCK).otherwise(ALLOW)
        return self.score(df, url).select("row", "host", "path", rule.alias("rule"), F.coalesce(verdict, learned).alias("verdict"), "score")


def fit(labelled: DataFrame, url: str = "url", label: str = "y", most: int = MAX_LABELLED) -> UrlFilter:
    """Learn from URLs labelled 1 (blocked) and 0; about ``most`` distinct ones, taken by hash."""
    rows = labelled.select(F.col(url).cast("string").alias("url"), F.col(label).cast("int").alias("y")).where("url IS NOT NULL AND y IN (0, 1)")
    n = rows.agg(F.approx_count_distinct("url", 0.02)).first()[0]
    taken = rows.where(F.pmod(F.xxhash64("url"), F.lit(1 << 32)) < int((1 << 32) * min(1.0, 0.95 * most / max(n, 1))))
    host, path = host_and_path(F.col("url"))
    sample = taken.groupBy("url").agg(F.max("y").alias("y")).select("*", host.alias("host"), path.alias("path"), F.pmod(F.xxhash64("url", F.lit(1)), F.lit(FOLDS)).alias("fold"))
    sample = written(sample.withColumns(keys(F.col("host"), F.col("path"))), "urls-labelled").coalesce(4)
    seen, blocked = sample.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    if blocked in (0, seen):
        return UrlFilter(None, float(seen > 0 and blocked == seen), {})
    base = blocked / seen
    rows, found = sample, {}
    for k in STATISTICS:
        by = sample.groupBy(k).agg(F.count("*").alias("n"), F.sum("y").alias("b"))
        found[k] = written(by.select(k, _rate(F.col("b"), F.col("n"), base).alias(f"{k}_rate"), F.log1p("n").alias(f"{k}_seen")), f"urls-{k}")
        # At most ``most`` rows: the statistics of a labelled URL come from the other folds.
        rest = lambda v: F.sum(v).over(Window.partitionBy(k)) - F.sum(v).over(Window.partitionBy(k, "fold"))  # noqa: B023, E731
        rows = rows.withColumns({"_n": rest(F.lit(1)), "_b": rest(F.col("y"))}).withColumns({f"{k}_rate": _rate(F.col("_b"), F.col("_n"), base), f"{k}_seen": F.log1p("_n")}).drop("_n", "_b")
    ready = written(rows.select(_features().alias("features"), F.col("y").cast("double").alias("label")), "urls-features").coalesce(4)
    return UrlFilter(GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=11).fit(ready), base, found)


def labelled_by_rules(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, url: str = "url") -> DataFrame:
    """url and y of the rows that a rule judges."""
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col(url).cast("string").alias("url")).select("url", host.alias("host"), path.alias("path"))
    return rows.select("url", (judged_by_rules(F.col("host"), F.col("path"), rules)[1] == BLOCK).cast("int").alias("y")).where("y IS NOT NULL")


def op11_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    found = fit(labelled_by_rules(pages)).judge(pages)
    return found.select("row.page_id", "host", "path", "rule", "verdict", "score")

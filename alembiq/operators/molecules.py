"""Molecule columns: the kernel of ``alembiq.chem`` behind Arrow UDFs.

A molecule is parsed where it is needed and never stored. Each UDF takes batches of SMILES and
returns all its results at once, so several properties cost one parse; a text that a task meets again costs none, while the last
KNOWN are held. Failures give nulls.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from functools import wraps

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..chem import brics, kernel, layout, match
from ..functions.scores import number
from ..functions.similarity import popcount

#: Texts whose results a task holds, about.
KNOWN = 10_000


def _of_distinct(f: Callable[[pd.Series], pd.Series | pd.DataFrame], kind: str) -> Callable[..., Column]:
    """A pandas UDF of one column of texts that calls ``f`` with texts not met before."""
    most = KNOWN

    def results(batches: Iterator[pd.Series]) -> Iterator:
        place, held = {}, None
        for s in batches:
            codes, texts = pd.factorize(s)
            texts = [*texts, None]  # the code of null is -1
            new = [x for x in texts if x not in place]
            if held is not None and len(place) + len(new) > most:
                place, held, new = {}, None, texts
            if new:
                place |= {x: i for i, x in enumerate(new, len(place))}
                made = f(pd.Series(new, dtype=object))
                held = made if held is None else pd.concat([held, made], ignore_index=True)
            at = np.array([place[x] for x in texts])
            yield held.take(at[codes]).reset_index(drop=True)

    def columns(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        yield from results(batches)

    def column(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from results(batches)

    return F.pandas_udf(columns if " " in kind else column, kind)


def _udf(kind: str) -> Callable[[Callable], Callable[..., Column]]:
    """A pandas UDF that is made when it is called, since its type is parsed by a session."""
    return lambda f: wraps(f)(lambda column: _of_distinct(f, kind)(column))


PROPERTY_TYPE = "MolWt double, LogP double, TPSA double, MolMR double, QED double, HBD int, HBA int, RotatableBonds int, RingCount int, AromaticRings int, HeavyAtomCount int, NumHeteroatoms int, FractionCSP3 double, FormalCharge int"


@_udf(PROPERTY_TYPE)
def properties(smiles: pd.Series) -> pd.DataFrame:
    names = [x.split()[0] for x in PROPERTY_TYPE.split(", ")]
    rows = [kernel.properties(m) if (m := kernel.read(s)) is not None else {} for s in smiles]
    return pd.DataFrame(rows, columns=names).astype({n: "Int32" for n, kind in (x.split() for x in PROPERTY_TYPE.split(", ")) if kind == "int"})


@_udf("smiles string, errors array<string>")
def validated(smiles: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([kernel.validate(s) for s in smiles], columns=["smiles", "errors"])


@_udf("smiles string, steps array<string>")
def standardized(smiles: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([kernel.standardize(s) for s in smiles], columns=["smiles", "steps"])


@_udf("string")
def scaffold(smiles: pd.Series) -> pd.Series:
    """The scaffold's SMILES, empty for molecules without rings."""
    return pd.Series([kernel.canonical(kernel.scaffold(m)) if (m := kernel.read(s)) is not None else None for s in smiles])


@_udf("array<string>")
def fragments(smiles: pd.Series) -> pd.Series:
    """Retrosynthetic fragments, cut ends marked by labelled dummy atoms."""
    return pd.Series([brics.fragments(m) if (m := kernel.read(s)) is not None else None for s in smiles])


@_udf("string")
def molblock(smiles: pd.Series) -> pd.Series:
    """Connection tables with flat coordinates, without their end line; null for unreadable molecules."""
    return pd.Series([layout.molblock(m, "molecule").removesuffix("M  END") if (m := kernel.read(s)) is not None else None for s in smiles])


@_udf("string")
def drawing(smiles: pd.Series) -> pd.Series:
    """SVG drawings; null for unreadable molecules."""
    return pd.Series([layout.svg(m) if (m := kernel.read(s)) is not None else None for s in smiles])


@_udf("map<string,int>")
def features(smiles: pd.Series) -> pd.Series:
    return pd.Series([kernel.features(m) if (m := kernel.read(s)) is not None else None for s in smiles])


@_udf("cyp_alerts array<string>, herg_alerts array<string>, ames_alerts array<string>, hepatotox_alerts array<string>")
def admet_alerts(smiles: pd.Series) -> pd.DataFrame:
    names = ["cyp_alerts", "herg_alerts", "ames_alerts", "hepatotox_alerts"]
    return pd.DataFrame([kernel.admet_alerts(m) if (m := kernel.read(s)) is not None else dict.fromkeys(names, []) for s in smiles], columns=names)


def fingerprint(smiles: Column, kind: str = "circular", bits: int = 2048) -> Column:
    """Packed words of a fingerprint."""

    def of(s: pd.Series) -> pd.Series:
        return pd.Series([kernel.pack(kernel.FINGERPRINTS[kind](m, bits=bits), bits) if (m := kernel.read(x)) is not None else None for x in s])

    return _of_distinct(of, "array<bigint>")(smiles)


def match_counts(smiles: Column, pattern: str) -> Column:
    """Distinct atom sets that match a pattern; null for unreadable molecules. A bad pattern raises at once."""
    match.compile_pattern(pattern)

    def of(s: pd.Series) -> pd.Series:
        return pd.Series([len(match.unique_matches(match.Target(m), pattern)) if (m := kernel.read(x)) is not None else None for x in s], dtype="Int32")

    return _of_distinct(of, "int")(smiles)


def with_properties(df: DataFrame, smiles: str = "smiles") -> DataFrame:
    """Properties the graph gives; columns of these names that ``df`` already has stay as they are (measured or computed elsewhere)."""
    names = [x.split()[0] for x in PROPERTY_TYPE.split(", ")]
    out = df.withColumn("_p", properties(F.col(smiles)))
    return out.withColumns({n: F.col(f"_p.{n}") for n in names if n not in df.columns}).drop("_p")


def with_fingerprint(df: DataFrame, name: str = "fp", kind: str = "circular", bits: int = 2048, smiles: str = "smiles") -> DataFrame:
    out = df.withColumn(name, fingerprint(F.col(smiles), kind, bits))
    return out.withColumn(f"{name}_count", popcount(F.col(name)))


def with_alerts(df: DataFrame, smiles: str = "smiles") -> DataFrame:
    return df.withColumn("_a", admet_alerts(F.col(smiles))).select(*df.columns, "_a.*")


def validate(df: DataFrame, smiles: str = "smiles") -> DataFrame:
    """Canonical SMILES, errors, and status validated or failed; failed rows keep the text they came with."""
    out = df.withColumn("_v", validated(F.col(smiles)))
    ok = F.size("_v.errors") == 0
    return out.withColumn("status", F.when(ok, "validated").otherwise("failed")).withColumn("errors", F.col("_v.errors")).withColumn(smiles, F.coalesce("_v.smiles", F.col(smiles))).drop("_v")


def standardize(df: DataFrame, smiles: str = "smiles") -> DataFrame:
    """Standardised SMILES, and a provenance step for each change."""
    out = df.withColumn("_s", standardized(F.col(smiles)))
    steps = F.transform("_s.steps", lambda s: F.concat(F.lit("standardized:"), s))
    old = F.col("provenance") if "provenance" in df.columns else F.array().cast("array<string>")
    return out.withColumn("provenance", F.concat(old, steps)).withColumn(smiles, F.coalesce("_s.smiles", F.col(smiles))).drop("_s")


def screen_substructure(df: DataFrame, pattern: str, exclude: bool = False, smiles: str = "smiles") -> DataFrame:
    """Rows with (or without) the pattern, with match_count; unreadable molecules match nothing."""
    out = df.withColumn("match_count", F.coalesce(match_counts(F.col(smiles), pattern), F.lit(0)))
    return out.where((F.col("match_count") > 0) != F.lit(exclude))


def screen_features(df: DataFrame, required: Mapping[str, int], match_all: bool = True, smiles: str = "smiles") -> DataFrame:
    """Rows that reach the counts of pharmacophore features, with one pharm_ column a family."""
    from .screening import screen_counts

    unknown = set(required) - set(K.PHARMACOPHORE_FAMILIES)
    if unknown:
        raise ValueError(f"unknown features {sorted(unknown)}")
    out = df.withColumn("_f", features(F.col(smiles)))
    out = out.withColumns({f"pharm_{x}": F.coalesce(F.try_element_at("_f", F.lit(x)), F.lit(0)) for x in K.PHARMACOPHORE_FAMILIES}).drop("_f")
    return screen_counts(out, {f"pharm_{k}": n for k, n in required.items()}, match_all)


def mutants(df: DataFrame, n: int, edits: int = 1, seed: int = 42, smiles: str = "smiles", rounds: int = 10) -> DataFrame:
    """Up to ``n`` distinct new molecules by random edits of the rows' molecules: smiles, parent_smiles, attempt.

    Each attempt has a seed of its own, from its number and its parent, so results do not depend on
    partitions. Attempts are dealt out as rows; each round adds as many as are wanted.
    """

    @F.pandas_udf("string")
    def edit(s: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series([kernel.mutate(x, int(i), edits) if x else None for x, i in zip(s, k)])

    parents = df.where(F.col(smiles).isNotNull()).select(F.col(smiles).alias("parent_smiles")).distinct()
    count = parents.count()
    if not count:
        return df.sparkSession.createDataFrame([], "smiles string, parent_smiles string, attempt int")
    each = max(1, -(-n * rounds // count))
    tries = parents.withColumn("attempt", F.explode(F.sequence(F.lit(0), F.lit(each - 1))))
    made = tries.withColumn("smiles", edit("parent_smiles", F.pmod(F.xxhash64("parent_smiles", "attempt", F.lit(seed)), F.lit(1 << 31))))
    best = made.where(F.col("smiles").isNotNull() & (F.col("smiles") != F.col("parent_smiles"))).groupBy("smiles").agg(F.min(F.struct("attempt", "parent_smiles")).alias("m"))
    return best.select("smiles", "m.parent_smiles", "m.attempt").orderBy("attempt", F.xxhash64("smiles")).limit(n)


def decorated(df: DataFrame, n: int, seed: int = 42, smiles: str = "smiles") -> DataFrame:
    """Up to ``n`` molecules made by placing groups on the rows' scaffolds: smiles, core."""

    @F.pandas_udf("array<string>")
    def of(cores: pd.Series) -> pd.Series:
        return pd.Series([list(kernel.decorate(c, seed)) if c else [] for c in cores])

    cores = df.select(scaffold(F.col(smiles)).alias("core")).where("core <> ''").distinct()
    made = cores.withColumn("smiles", F.explode(of("core"))).groupBy("smiles").agg(F.min("core").alias("core"))
    return made.orderBy(F.xxhash64("smiles")).limit(n)


def recombined(df: DataFrame, n: int, seed: int = 42, smiles: str = "smiles", partners: int = 4) -> DataFrame:
    """Up to ``n`` molecules that join fragments of two parents: smiles, parent_a, parent_b. Each parent meets ``partners`` others, dealt by hash."""

    @F.pandas_udf("array<string>")
    def of(a: pd.Series, b: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series([kernel.recombine(x, y, int(i)) for x, y, i in zip(a, b, k)])

    parents = df.where(F.col(smiles).isNotNull()).select(F.col(smiles).alias("s")).distinct()
    blocks = max(1, parents.count() // partners)
    place = lambda salt: F.pmod(F.xxhash64("s", F.lit(salt)), F.lit(blocks)).alias("block")
    a, b = parents.select(F.col("s").alias("parent_a"), place(seed)), parents.select(F.col("s").alias("parent_b"), place(seed))
    met = a.join(b, "block").where("parent_a < parent_b")
    made = met.withColumn("smiles", F.explode(of("parent_a", "parent_b", F.pmod(F.xxhash64("parent_a", "parent_b"), F.lit(1 << 31)))))
    fresh = made.join(parents.withColumnRenamed("s", "smiles"), "smiles", "left_anti")
    return fresh.groupBy("smiles").agg(F.min("parent_a").alias("parent_a"), F.min("parent_b").alias("parent_b")).orderBy(F.xxhash64("smiles")).limit(n)


def fragment_table(df: DataFrame, smiles: str = "smiles") -> DataFrame:
    return df.withColumn("fragments", fragments(F.col(smiles)))


def novel(generated: DataFrame, original: DataFrame, smiles: str = "smiles") -> DataFrame:
    """``generated`` with is_novel: absent from ``original``."""
    known = original.select(F.col(smiles).alias("_k")).where("_k IS NOT NULL").distinct().withColumn("_have", F.lit(True))
    return generated.join(known, F.col(smiles) == F.col("_k"), "left").withColumn("is_novel", F.col("_have").isNull()).drop("_k", "_have")


def evolve(df: DataFrame, fitness: Column, population: int = 100, generations: int = 10, elite: float = 0.1, mutation: float = 0.3, tournament: int = 3, seed: int = 42, smiles: str = "smiles") -> DataFrame:
    """A genetic algorithm: smiles and fitness of the last population, best first.

    ``fitness`` is a column over a table with smiles and the kernel's properties. A generation is one
    job: parents are the best of small hashed groups, children are recombined and edited in UDFs, the
    elite survives, and the population is written to the shared folder. Null fitness counts as 0; unreadable molecules are left out.
    """
    from ..session import checkpointed

    @F.pandas_udf("string")
    def child(a: pd.Series, b: pd.Series, k: pd.Series) -> pd.Series:
        def one(x: str, y: str, i: int) -> str | None:
            made = kernel.recombine(x, y, i, 1) if x != y else []
            out = made[0] if made else x
            return (kernel.mutate(out, i) or out) if i % 1000 < 1000 * mutation else out

        return pd.Series([one(x, y, int(i)) for x, y, i in zip(a, b, k)])

    def rated(d: DataFrame) -> DataFrame:
        return with_properties(d.select("smiles").distinct()).where("MolWt IS NOT NULL").select("smiles", F.coalesce(number(fitness), F.lit(0.0)).alias("fitness"))

    best = lambda d, n: d.orderBy(F.col("fitness").desc(), "smiles").limit(n)
    pool = checkpointed(best(rated(df.where(F.col(smiles).isNotNull()).select(F.col(smiles).alias("smiles"))), population), "evolve")
    keep = max(1, int(population * elite))
    for g in range(generations):
        slots = df.sparkSession.range(population * 2).select(F.col("id").alias("slot"))
        draws = F.explode(F.sequence(F.lit(0), F.lit(tournament - 1)))
        numbered = pool.orderBy("smiles").withColumn("i", F.monotonically_increasing_id())
        ids = numbered.select(F.collect_list(F.struct("smiles", "fitness")).alias("all"))  # at most ``population`` rows
        pick = F.get("all", F.pmod(F.xxhash64("slot", "draw", F.lit(seed), F.lit(g)), F.size("all")).cast("int"))
        drawn = slots.withColumn("draw", draws).crossJoin(F.broadcast(ids)).select("slot", pick.alias("p")).groupBy("slot").agg(F.max_by("p.smiles", F.struct("p.fitness", "p.smiles")).alias("s"))
        couples = drawn.groupBy(F.floor(F.col("slot") / 2).alias("pair")).agg(F.min_by("s", "slot").alias("a"), F.max_by("s", "slot").alias("b"))
        made = couples.select(child("a", "b", F.pmod(F.xxhash64("a", "b", "pair", F.lit(g)), F.lit(1 << 31))).alias("smiles"))
        grown = rated(made.where("smiles IS NOT NULL")).join(best(pool, keep).select("smiles"), "smiles", "left_anti").unionByName(best(pool, keep))
        pool = checkpointed(best(grown, population), "evolve")
    return pool.orderBy(F.col("fitness").desc(), "smiles")


def iterate_smiles(df: DataFrame, smiles: str = "smiles") -> Iterator[str]:
    """Rows one at a time, for looking at."""
    for r in df.select(smiles).toLocalIterator():
        yield r[0]

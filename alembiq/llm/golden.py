"""Golden records: what survives of a cluster of records, by lexicographic elimination.

Every field is chosen by a list of criteria. All candidates of a cluster start; each turn aggregates the
best value of the next criterion over the cluster's survivors, and only rows that have it stay. Clusters
in which every field is down to one row leave, so later turns see few rows. All fields that do not
depend on each other take their turns together, in one aggregate and one join a turn. The survivor of
the segment then names the candidates of the balance that come first.

No cluster is gathered: aggregates combine before they shuffle, and rows of clusters above 1/HOT of the table
are dealt over salts in proportion to their share, which the cluster's one row of best values is repeated for.
Joins are merge joins: nothing that grows is broadcast (the hot clusters are fewer than HOT).

Defined results: strings that are empty or blank and balances that are not finite count as null; unknown and null
sources are trusted least; a null client_id ranks after all others; rows that tie in all criteria (repeated
client_ids) give the smallest of their values (null first for city and nation together);
rows without master_id and client_id are one cluster, with a null id; an empty table gives an
empty result. Further columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES_RE, partitions, table, written

#: Sources by falling trust.
TRUST = ("store", "crm", "partner", "web")
#: Hours after which a record is stale, counted back from its cluster's latest.
STALE_HOURS = 240
#: Clusters with more than 1/HOT of all rows are dealt out; there are fewer than HOT of them.
HOT = 1000


@dataclass(frozen=True)
class Choice:
    """A field's survivor: of the rows that are ``among`` the candidates, by columns whose "max" or "min" is best, one after another."""

    name: str
    among: Column
    by: tuple[tuple[str, str], ...]

    @property
    def flag(self) -> str:
        return f"in_{self.name}"


RECENT = (("updated_at", "max"), ("trust", "max"), ("client_id", "min"))
TRUSTED = (("fresh", "max"), ("trust", "max"), ("updated_at", "max"), ("client_id", "min"))


def prepared(clients: DataFrame) -> DataFrame:
    """cluster_id, client_id, updated_at, trust and the fields, blanks as nulls."""
    text = lambda c: F.when(F.length(F.regexp_replace(c, SPACES_RE, "")) > 0, F.col(c)).alias(c)
    trust = reduce(lambda w, s: w.when(F.col("source") == s[1], len(TRUST) - s[0]), enumerate(TRUST), F.when(F.lit(False), 0)).otherwise(0)
    balance = F.col("balance").cast("double")
    return clients.select(
        F.coalesce("master_id", "client_id").cast("long").alias("cluster_id"), F.col("client_id").cast("long").alias("client_id"), "updated_at", trust.alias("trust"),
        text("name"), text("email"), text("segment"), text("city"), "nation_id", F.when(~F.isnan(balance) & (F.abs(balance) < float("inf")), balance).alias("balance"),
    )


def _dealt(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """``rows`` with salts, the number of parts of the row's cluster, and salt, the row's part."""
    total = sizes.agg(F.sum("n_records")).first()[0] or 0
    share = F.ceil(F.col("n_records") * (2 * partitions(rows.sparkSession)) / max(total, 1)).cast("int")
    hot = sizes.where(F.col("n_records") * HOT > total).select(F.col("cluster_id").alias("hot_id"), share.alias("salts"))
    # A row may go to any part, so copies of one row are dealt out too.
    found = rows.join(F.broadcast(hot), F.col("cluster_id").eqNullSafe(F.col("hot_id")), "left").withColumn("salts", F.coalesce("salts", F.lit(1))).drop("hot_id")
    return found.withColumn("salt", F.floor(F.rand(12) * F.col("salts")).cast("int"))


def _met(rows: DataFrame, clusters: DataFrame, how: str = "inner") -> DataFrame:
    """``rows`` with the columns of their cluster; ``clusters`` has one row a cluster and its salts."""
    parts = clusters.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).withColumnRenamed("cluster_id", "_cluster").drop("salts")
    on = F.col("cluster_id").eqNullSafe(F.col("_cluster")) & (F.col("salt") == F.col("_salt"))
    return rows.join(parts.hint("merge"), on, how).drop("_cluster", "_salt")


def survivors(rows: DataFrame, choices: Sequence[Choice], name: str = "golden") -> DataFrame:
    """The rows that survive for at least one of ``choices``, with a flag for each; ``rows`` as of ``_dealt``.

    A choice keeps one row of a cluster, or several that tie in all its criteria.
    """
    flags = [c.flag for c in choices]
    some = reduce(or_, [F.col(f) for f in flags])
    left = rows.withColumns({c.flag: F.coalesce(c.among, F.lit(False)) for c in choices}).where(some)
    columns, settled = left.columns, []
    for turn in range(max(len(c.by) for c in choices)):
        now = [(c, *c.by[turn]) for c in choices if turn < len(c.by)]
        best = [getattr(F, way)(F.when(F.col(c.flag), F.col(column))).alias(f"best_{c.name}") for c, column, way in now]
        alone = reduce(and_, [F.count_if(f) <= 1 for f in flags]).alias("settled")
        joined = _met(left, left.groupBy("cluster_id").agg(F.max("salts").alias("salts"), alone, *best))
        stay = {c.flag: F.col(c.flag) & (F.col("settled") | F.col(column).eqNullSafe(F.col(f"best_{c.name}"))) for c, column, _ in now}
        found = written(joined.withColumns(stay).where(some).select(*columns, "settled"), f"{name}-turn")
        settled.append(found.where("settled").select(columns))
        left = found.where("NOT settled").select(columns)
        if left.isEmpty():
            return reduce(DataFrame.unionByName, settled)
    return reduce(DataFrame.unionByName, [*settled, left])


def golden_records(clients: DataFrame, stale_hours: int = STALE_HOURS) -> DataFrame:
    """One record a cluster: cluster_id, n_records, n_stale, the fields, balance, and the client_id that gives each of them."""
    rows = prepared(clients)
    sizes = written(rows.groupBy("cluster_id").agg(F.count("*").alias("n_records"), F.max("updated_at").alias("latest")), "golden-sizes")
    dealt = _dealt(rows, sizes)
    salts = dealt.groupBy("cluster_id").agg(F.max("salts").alias("salts"))
    old = F.col("updated_at").isNull() | F.expr(f"latest - updated_at > INTERVAL '{int(stale_hours)}' HOUR")
    known = lambda c: F.col(c).isNotNull()
    aged = _met(dealt, sizes.join(salts.withColumnRenamed("cluster_id", "_id").hint("merge"), F.col("cluster_id").eqNullSafe(F.col("_id"))).drop("_id", "n_records"))
    aged = aged.withColumn("fresh", (~old).cast("int")).drop("latest").withColumns({"letters": F.char_length("name"), "filled": known("city").cast("int") + known("nation_id").cast("int")})
    choices = [
        Choice("segment", known("segment"), RECENT),
        Choice("email", known("email"), TRUSTED),
        Choice("name", known("name"), (("letters", "max"), *TRUSTED)),
        Choice("address", F.lit(True), (("filled", "max"), *RECENT)),
    ]
    found = survivors(aged, choices)
    chosen = found.where("in_segment").groupBy("cluster_id").agg(F.min("segment").alias("chosen"), F.max("salts").alias("salts"))
    funds = _met(dealt.where(known("balance")).select("cluster_id", "client_id", "salts", "salt", "updated_at", "trust", "segment", "balance"), chosen, "left")
    funds = funds.withColumn("matches", F.coalesce(F.col("segment") == F.col("chosen"), F.lit(False)).cast("int")).drop("segment", "chosen")
    paid = survivors(funds, [Choice("balance", known("balance"), (("matches", "max"), *RECENT))], "golden-balance")

    # Every part gives some columns of a cluster's record; the others are null there, and an aggregate leaves nulls out.
    taken = lambda c, v: F.min(F.when(F.col(f"in_{c}"), v))
    fields = found.groupBy("cluster_id").agg(
        *[taken(c, F.col(c)).alias(c) for c in ("name", "email", "segment")], *[taken(c, F.col("client_id")).alias(f"{c}_from") for c in ("name", "email", "segment")],
        taken("address", F.struct("city", "nation_id")).alias("address"), taken("address", F.when(F.col("filled") > 0, F.col("client_id"))).alias("address_from"),
    )
    fields = fields.select("*", "address.*").drop("address")
    funded = paid.groupBy("cluster_id").agg(F.min("balance").alias("balance"), F.min("client_id").alias("balance_from"))
    counts = aged.groupBy("cluster_id").agg(F.count("*").alias("n_records"), F.count_if(F.col("fresh") == 0).alias("n_stale"))
    parts = [counts, fields, funded]
    columns = ["n_records", "n_stale", "name", "email", "segment", "city", "nation_id", "balance", "name_from", "email_from", "segment_from", "balance_from", "address_from"]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).groupBy("cluster_id").agg(*[F.max(c).alias(c) for c in columns])


def op12_golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = golden_records(table(spark, sf_dir, "clients"))
    cents = F.floor(100 * F.col("balance") + 0.5).alias("balance_cents")
    return found.select("cluster_id", "n_records", "n_stale", "name", "email", "segment", "city", "nation_id", cents, "name_from", "email_from", "segment_from", "balance_from", "address_from")


_RECENT_SQL = "updated_at DESC NULLS LAST, trust DESC, client_id NULLS LAST"
_TRUSTED_SQL = f"stale, trust DESC, {_RECENT_SQL}"


def _first_sql(column: str, order: str, source: str = "s") -> str:
    return f"SELECT cluster_id, {column}, client_id AS {column}_from FROM {source} WHERE {column} IS NOT NULL QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY {order}, {column}) = 1"


OP12_SQL = rf"""
WITH c AS (
  SELECT coalesce(master_id, client_id) AS cluster_id, client_id, updated_at,
         CASE source WHEN 'store' THEN 4 WHEN 'crm' THEN 3 WHEN 'partner' THEN 2 WHEN 'web' THEN 1 ELSE 0 END AS trust,
         {", ".join(rf"CASE WHEN NOT regexp_full_match({x}, '[\x20\x09-\x0D]*') THEN {x} END AS {x}" for x in ("name", "email", "segment", "city"))},
         nation_id, CASE WHEN isfinite(balance) THEN balance END AS balance
  FROM clients
), s AS (
  SELECT *, updated_at IS NULL OR epoch_us(max(updated_at) OVER (PARTITION BY cluster_id)) - epoch_us(updated_at) > {STALE_HOURS} * 3600 * 1000000::BIGINT AS stale FROM c
), n AS (SELECT cluster_id, count(*) AS n_records, CAST(count(*) FILTER (stale) AS BIGINT) AS n_stale FROM s GROUP BY 1),
segments AS ({_first_sql("segment", _RECENT_SQL)}),
emails AS ({_first_sql("email", _TRUSTED_SQL)}),
names AS ({_first_sql("name", f"length(name) DESC, {_TRUSTED_SQL}")}),
m AS (SELECT s.*, coalesce(s.segment = g.segment, false) AS matches FROM s LEFT JOIN segments g ON s.cluster_id IS NOT DISTINCT FROM g.cluster_id),
balances AS ({_first_sql("balance", f"matches DESC, {_RECENT_SQL}", "m")}),
addresses AS (
  SELECT cluster_id, city, nation_id, CASE WHEN city IS NOT NULL OR nation_id IS NOT NULL THEN client_id END AS address_from FROM s
  QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY (city IS NOT NULL)::INT + (nation_id IS NOT NULL)::INT DESC, {_RECENT_SQL}, city NULLS FIRST, nation_id NULLS FIRST) = 1
)
SELECT n.cluster_id, n_records, n_stale, name, email, segment, city, nation_id, CAST(floor(100 * balance + 0.5) AS BIGINT) AS balance_cents,
       name_from, email_from, segment_from, balance_from, address_from
FROM n {" ".join(f"LEFT JOIN {t} ON n.cluster_id IS NOT DISTINCT FROM {t}.cluster_id" for t in ("segments", "emails", "names", "balances", "addresses"))}
"""

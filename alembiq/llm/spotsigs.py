"""Document fingerprints from spot signatures.

A spot is an anchor, one of a list of common words; its signature is the anchor and the chain of the
next CHAIN words that are not anchors, looked for within REACH words. The set of a text's signatures,
each as the first CODE hexadecimal digits of its MD5, sorted and joined, is its fingerprint. Common words fall evenly through running prose and hardly in lists and menus, so
the set follows the prose.

Likeness is the Jaccard coefficient of the sets that two fingerprints list. ``similar`` joins a table with itself: sets are
dealt into partitions by length, only sets whose lengths allow the threshold meet, and only through
the signatures that a pair above the threshold must share (the rarest ones of each set).

Defined results: a null text is empty; a text with words but no spot is signed by all chains of
CHAIN + 1 words in a row (all words, where there are fewer); a text without words has the empty set;
two empty sets are alike (1), an empty set and another are not (0); signatures count once a text;
repeated rows and equal texts have equal fingerprints; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACES, partitions, range_cuts, table, written

#: Common words of four languages (fixed values).
ANCHORS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "he", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "with",
    "auf", "das", "dem", "den", "der", "des", "die", "ein", "eine", "ist", "mit", "nicht", "sie", "und", "von", "zu",
    "dans", "de", "des", "du", "elle", "en", "est", "et", "il", "la", "le", "les", "par", "pour", "que", "qui", "sur", "un", "une",
    "al", "con", "del", "el", "las", "lo", "los", "por", "se", "su", "y",
)
CHAIN = 2
REACH = 6
#: Hexadecimal digits of a signature in a fingerprint.
CODE = 8
#: Marks that are cut off words, beside white space.
MARKS = ".,;:!?"


def _words(text: Column) -> Column:
    stripped = F.trim(F.lower(F.coalesce(text, F.lit(""))), F.lit(SPACES + MARKS))
    return F.filter(F.split(stripped, r"[\x20\x09-\x0D" + MARKS + "]+"), lambda x: x != "")


def _anchor(x: Column) -> Column:
    return x.isin(list(dict.fromkeys(ANCHORS)))


def _spots(w: Column) -> Column:
    """Anchor and chain at each anchor of the word array ``w``; nulls are left out."""

    def chain(x: Column, i: Column) -> Column:
        after = F.slice(F.filter(F.slice(w, i + 2, F.lit(REACH)), lambda y: ~_anchor(y)), 1, CHAIN)
        return F.when(_anchor(x), F.concat(F.array(x), after))

    chains = F.filter(F.transform(w, chain), lambda x: F.size(x) == CHAIN + 1)
    return F.transform(chains, lambda x: F.array_join(x, " "))


def _signatures(w: Column, spots: Column) -> Column:
    n = F.size(w)
    every = F.transform(F.sequence(F.lit(1), F.greatest(n - CHAIN, F.lit(1))), lambda i: F.array_join(F.slice(w, i, F.lit(CHAIN + 1)), " "))
    return F.sort_array(F.array_distinct(F.when(n == 0, F.array().cast("array<string>")).when(F.size(spots) > 0, spots).otherwise(every)))


def signed(df: DataFrame, texts: dict[str, Column]) -> DataFrame:
    """``df`` with the sorted distinct signatures of some texts, under the names given.

    Words and spots are columns of their own on the way, so that each is made once a row.
    """
    df = df.withColumns({f"_w_{k}": _words(c) for k, c in texts.items()})
    df = df.withColumns({f"_s_{k}": _spots(F.col(f"_w_{k}")) for k in texts})
    df = df.withColumns({k: _signatures(F.col(f"_w_{k}"), F.col(f"_s_{k}")) for k in texts})
    return df.drop(*[f"_{x}_{k}" for x in "ws" for k in texts])


def codes(sigs: Column) -> Column:
    """The elements of a fingerprint, sorted."""
    return F.sort_array(F.array_distinct(F.transform(sigs, lambda x: F.substring(F.md5(x.cast("binary")), 1, CODE))))


def elements(fingerprint: Column) -> Column:
    """The elements that a fingerprint lists, for ``likeness``."""
    return F.regexp_extract_all(fingerprint, F.lit(f".{{{CODE}}}"), F.lit(0))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard coefficient of two arrays of distinct elements."""
    both = F.size(F.array_intersect(a, b))
    any_ = F.size(a) + F.size(b) - both
    return F.when(any_ == 0, F.lit(1.0)).otherwise(both / any_)


def fingerprinted(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with signatures and fingerprint."""
    return signed(docs, {"signatures": F.col("text")}).withColumn("fingerprint", F.array_join(codes(F.col("signatures")), ""))


def similar(docs: DataFrame, threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Pairs of like fingerprints, and membership.

    Returns (pairs: fingerprint_a < fingerprint_b, likeness; members: doc_id, fingerprint), with the
    SHA-256 of all signatures for a fingerprint here. Documents with equal ones form one class, so copies are never
    expanded. A set of n signatures meets sets of threshold*n to n/threshold signatures, through its
    n - ceil(threshold*n) + 1 rarest ones; the exact coefficient decides.
    """
    whole = F.sha2(F.array_join("signatures", "\n"), 256)
    prints = written(signed(docs, {"signatures": F.col("text")}).select("doc_id", whole.alias("fingerprint"), F.transform("signatures", lambda s: F.xxhash64(s)).alias("s")), "spots")
    classes = written(prints.groupBy("fingerprint").agg(F.first("s").alias("s")).withColumn("n", F.size("s")).where("n > 0"), "spot-classes")
    spots = classes.select("fingerprint", "n", F.explode("s").alias("sig"))
    often = spots.groupBy("sig").agg(F.count("*").alias("df"))
    ranked = spots.join(often, "sig").groupBy("fingerprint", "n").agg(F.sort_array(F.collect_list(F.struct("df", "sig"))).alias("order"))
    rare = F.slice("order", F.lit(1), (F.col("n") - F.ceil(F.col("n") * threshold) + 1).cast("int"))
    keys = ranked.select("fingerprint", "n", F.explode(rare).alias("r")).select("fingerprint", "n", F.col("r.sig").alias("sig"))
    # Lengths are dealt into partitions whose bounds grow by 1/threshold, so partners lie in the same or the next one.
    part = F.floor(F.log(F.col("n").cast("double")) / math.log(1 / threshold) + 1e-9) if threshold < 1 else F.col("n").cast("long")
    keys = written(keys.withColumn("part", part), "spot-keys")
    near = keys.select(F.col("fingerprint").alias("other"), F.col("n").alias("m"), "sig", F.explode(F.array(F.col("part") - 1, F.col("part"), F.col("part") + 1)).alias("part"))
    fits = (F.col("fingerprint") < F.col("other")) & (F.least("n", "m") >= F.ceil(F.greatest("n", "m") * threshold))
    pairs = keys.join(near, ["sig", "part"]).where(fits).select("fingerprint", "other").distinct()
    a, b = classes.select("fingerprint", "s"), classes.select(F.col("fingerprint").alias("other"), F.col("s").alias("s2"))
    rated = pairs.join(a, "fingerprint").join(b, "other").select(F.col("fingerprint").alias("fingerprint_a"), F.col("other").alias("fingerprint_b"), likeness(F.col("s"), F.col("s2")).alias("likeness"))
    return rated.where(F.col("likeness") >= threshold), prints.select("doc_id", "fingerprint")


def with_next(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """doc_id, text, next_text: the text of the next row by descending doc_id (then text); after the last comes the first.

    Rows are dealt into ranges of doc_id, one a task, and ordered within them; each range also gets a copy of the
    first row of the range after it, so that its last row finds its successor there.
    """
    parts = parts or partitions(docs.sparkSession)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    cuts = range_cuts(docs, "doc_id", parts, 0.25 / parts)
    part = sum((F.coalesce(F.col("doc_id") > c, F.lit(False)).cast("int") for c in cuts), F.lit(0))
    firsts = rows.select("doc_id").groupBy(part.alias("part")).agg(F.max("doc_id").alias("first")).collect()  # one row a range
    order = [(r["part"], r["first"]) for r in sorted(firsts, key=lambda r: -r["part"])]
    rows = rows.withColumn("part", part).withColumn("borrowed", F.lit(False))
    if order:
        before = docs.sparkSession.createDataFrame([(order[i - 1][0], part_first[1]) for i, part_first in enumerate(order)], f"_to int, _first {docs.schema['doc_id'].dataType.simpleString()}")
        heads = rows.join(F.broadcast(before), F.col("doc_id").eqNullSafe(F.col("_first"))).groupBy("_to", "doc_id").agg(F.max("text").alias("text"))
        rows = rows.unionByName(heads.select("doc_id", "text", F.col("_to").alias("part"), F.lit(True).alias("borrowed")))
    rows = rows.repartitionById(len(cuts) + 1, F.col("part"))  # a range is a task; a hash of the range's number would put some together
    along = Window.partitionBy("part").orderBy("borrowed", F.col("doc_id").desc_nulls_last(), F.col("text").desc())
    return rows.withColumn("next_text", F.lead("text").over(along)).where(~F.col("borrowed")).select("doc_id", "text", "next_text")


def op9_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = with_next(table(spark, sf_dir, "documents"))
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    sets = signed(pairs.withColumn("n", n).withColumn("edited", edited), {"a": F.col("text"), "b": F.col("edited"), "c": F.col("next_text")})
    sets = sets.withColumn("edited_sha256", F.sha2("edited", 256)).withColumns({x: codes(F.col(x)) for x in "abc"})
    return sets.select("doc_id", F.col("n").cast("long").alias("n_chars"), "edited_sha256", F.array_join("a", "").alias("fingerprint"), F.array_join("b", "").alias("edited_fingerprint"), likeness(F.col("a"), F.col("b")).alias("near_edited"), likeness(F.col("a"), F.col("c")).alias("near_next"))


_ANCHOR_SQL = ", ".join(f"'{x}'" for x in dict.fromkeys(ANCHORS))
OP9_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (
  SELECT doc_id, text, coalesce(lead(text) OVER (ORDER BY doc_id DESC NULLS LAST, text DESC), first_value(text) OVER (ORDER BY doc_id DESC NULLS LAST, text DESC)) AS next_text
  FROM d
), e AS (
  SELECT doc_id, text, next_text, left(text, length(text) - length(text) // 2) || left(next_text, length(text) // 2) AS edited FROM n
), x AS (
  SELECT doc_id, 'a' AS which, text AS t FROM e UNION ALL SELECT doc_id, 'b', edited FROM e UNION ALL SELECT doc_id, 'c', next_text FROM e
), w AS (
  SELECT doc_id, which, regexp_extract_all(lower(t), '[^\x20\x09-\x0D{MARKS}]+') AS w FROM x
), k AS (
  SELECT doc_id, which, w, list_transform(w, lambda y, i: CASE WHEN y IN ({_ANCHOR_SQL}) THEN [y] || list_filter(w[i + 1:i + {REACH}], lambda z: z NOT IN ({_ANCHOR_SQL}))[1:{CHAIN}] END) AS c FROM w
), s AS (
  SELECT doc_id, which, w, [array_to_string(y, ' ') for y in c if y IS NOT NULL and len(y) = {CHAIN + 1}] AS s FROM k
), f AS (
  SELECT doc_id, which, CASE WHEN len(w) = 0 THEN [] WHEN len(s) > 0 THEN list_sort(list_distinct(s))
    ELSE list_sort(list_distinct([array_to_string(w[i:i + {CHAIN}], ' ') for i in range(1, greatest(len(w) - {CHAIN}, 1) + 1)])) END AS s FROM s
), g AS (
  SELECT doc_id, which, list_sort(list_distinct(list_transform(s, lambda y: md5(y)[1:{CODE}]))) AS s FROM f
), p AS (
  SELECT e.doc_id, length(e.text) AS n_chars, sha256(e.edited) AS edited_sha256, a.s AS a, b.s AS b, c.s AS c
  FROM e JOIN g a ON a.doc_id = e.doc_id AND a.which = 'a' JOIN g b ON b.doc_id = e.doc_id AND b.which = 'b' JOIN g c ON c.doc_id = e.doc_id AND c.which = 'c'
)
SELECT doc_id, n_chars, edited_sha256,
  coalesce(array_to_string(a, ''), '') AS fingerprint, coalesce(array_to_string(b, ''), '') AS edited_fingerprint,
  CASE WHEN len(a) + len(b) = 0 THEN 1.0 ELSE len(list_intersect(a, b))::DOUBLE / (len(a) + len(b) - len(list_intersect(a, b))) END AS near_edited,
  CASE WHEN len(a) + len(c) = 0 THEN 1.0 ELSE len(list_intersect(a, c))::DOUBLE / (len(a) + len(c) - len(list_intersect(a, c))) END AS near_next
FROM p
"""

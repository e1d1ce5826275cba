"""Benchmark decontamination by spaced-seed hashing.

Fixed masks select some positions of a token window and ignore the others, so a hash over the
selected tokens still agrees when an ignored one was substituted. Hashes of all benchmark windows
under all masks are joined with those of all document windows; each hit fixes an alignment, and every
window of the benchmark item that holds the hit is compared with the aligned document tokens.

The masks miss nothing that the comparison accepts: whichever 3 of 16 or 15, 2 of 10 to 14, or 1 of 5 to
9 tokens differ, some mask selects, at some position, tokens that all agree (tests/llm tries all cases).
Items of fewer than SPAN tokens have masks of four tokens, which are looked for only where there are such
items; of fewer than five tokens none can differ, and all are hashed.

Document tokens become an array of 64-bit hashes once; windows are exploded from it inside one
generated stage that also holds the join, so only hits leave it, each with the tokens around it. The benchmark's windows are
broadcast when their measured size is within BROADCAST_BYTES. Otherwise the documents' windows meet them
in a shuffled join by seed, position and document alone, and only the documents that are hit bring their tokens.

Defined results: tokens are maximal runs of letters and digits, lower-cased; null, empty or
token-free texts of either table match nothing; items of every length are looked for, down to a single token, and
``longest`` tells the tokens of the longest item that a document holds, so that a caller can weigh matches of a word or two (``shortest``
leaves out shorter items where that is wanted); rows that repeat a doc_id count as one document, and so do rows with a
null doc_id; rows that repeat an item_id count as items with one name; null item_ids are matched too
and listed nowhere; further columns are ignored. Empty tables give results without matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

#: Fixed masks: 1 positions are hashed, 0 positions ignored. Found by search; it met no fewer masks of six tokens that miss nothing.
MASKS = ("1111011", "11001000111", "111001011", "1011111")
#: Tokens of the shortest items for MASKS; and fixed masks for shorter items, with the lengths they are for.
SPAN = 11
SHORT_MASKS = {"1111": (4, 10), "11011": (5, 10), "10111": (5, 5), "11101": (5, 5)}
#: Tokens of the shortest items that are looked for: all.
SHORTEST = 1
#: Tokens of an item that are compared around a hit, and the share that must agree.
WINDOW = 16
AGREE = 0.8
#: Bytes of benchmark windows that are broadcast at most.
BROADCAST_BYTES = 128 << 20


def token_hashes(text: Column) -> Column:
    tokens = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")
    return F.transform(tokens, lambda x: F.xxhash64(x))


def _masked(tokens: Column, at: Column, mask: str) -> Column:
    """Hash of the tokens that the mask selects from position ``at`` (from 0) on, and of the mask."""
    return F.xxhash64(F.lit(int(mask, 2)), *[F.get(tokens, at + i) for i, c in enumerate(mask) if c == "1"])


def masks_of(n: int) -> list[str]:
    """The masks under which an item of ``n`` tokens is looked for."""
    if n >= SPAN:
        return list(MASKS)
    return [m for m, (least, most) in SHORT_MASKS.items() if least <= n <= most] or ["1" * n]


def benchmark_windows(benchmark: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """seed, mask, item_id, n_item (tokens of the item), lead (item tokens compared before the hit), near (the hashes compared: all windows that hold the hit)."""
    items = benchmark.select("item_id", token_hashes(F.col("text")).alias("u")).withColumn("n_item", F.size("u")).where(F.col("n_item") >= max(1, shortest))
    found = None
    for mask, lengths in all_masks(shortest).items():
        some = items.where(F.col("n_item").isin(lengths) if lengths else F.col("n_item") >= SPAN).withColumn("j", F.explode(F.sequence(F.lit(0), F.size("u") - len(mask))))
        first = F.greatest(F.lit(0), F.col("j") + len(mask) - WINDOW)
        near = F.slice("u", first + 1, F.col("j") + WINDOW - first)
        rows = some.select(_masked(F.col("u"), F.col("j"), mask).alias("seed"), F.lit(mask).alias("mask"), "item_id", "n_item", (F.col("j") - first).alias("lead"), near.alias("near"))
        found = rows if found is None else found.unionByName(rows)
    return found.distinct()


def all_masks(shortest: int = SHORTEST) -> dict[str, list[int]]:
    """Every mask with the lengths of the short items it is for; MASKS have an empty list."""
    out: dict[str, list[int]] = {m: [] for m in MASKS}
    for n in range(max(1, shortest), SPAN):
        for m in masks_of(n):
            out.setdefault(m, []).append(n)
    return out


def _cut(tokens: Column) -> Column:
    """The tokens of a document that a hit at ``i`` is compared with."""
    return F.slice(tokens, F.greatest(F.col("i") - F.col("lead"), F.lit(0)) + 1, F.lit(2 * WINDOW - 1))


def _hits(docs: DataFrame, windows: DataFrame, masks: list[str], broadcast: bool) -> DataFrame:
    """doc_id, item_id, n_item, near, cut (document tokens aligned with near) and missing (tokens of near before the document's first)."""
    seeds = lambda t: F.array(*[F.when(F.col("i") + len(m) <= F.size(t), _masked(t, F.col("i"), m)) for m in masks or ["1"]])
    tokens = docs.select("doc_id", token_hashes(F.col("text")).alias("t"))
    every = F.explode(F.when(F.size("t") > 0, F.sequence(F.lit(0), F.size("t") - 1)))
    missing = F.greatest(F.col("lead") - F.col("i"), F.lit(0)).alias("missing")
    if broadcast:
        hashed = tokens.withColumn("i", every).withColumn("seed", F.explode(seeds(F.col("t"))))
        return hashed.join(F.broadcast(windows), "seed").select("doc_id", "item_id", "n_item", "near", _cut(F.col("t")).alias("cut"), missing)
    # Rows alike in doc_id and tokens are one document to the result, so two hashes of both name them.
    named = tokens.withColumns({"row": F.xxhash64("doc_id", "t"), "row2": F.xxhash64(F.lit("row"), "t", "doc_id")})
    row = ["row", "row2"]
    hashed = named.withColumn("i", every).select(*row, "i", F.explode(seeds(F.col("t"))).alias("seed")).where("seed IS NOT NULL")
    hits = written(hashed.join(windows.select("seed").distinct(), "seed"), "benchmark-seeds")
    held = written(named.join(hits.select(*row).distinct(), row, "left_semi").dropDuplicates(row), "benchmark-held")
    met = hits.join(windows, "seed").join(held, row)
    return met.select("doc_id", "item_id", "n_item", "near", _cut(F.col("t")).alias("cut"), missing)


def contaminated(docs: DataFrame, benchmark: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """doc_id, n_items, item_ids (sorted), best (largest share of agreeing tokens), longest (tokens of the longest item held): one row a document that holds benchmark text."""
    windows = written(benchmark_windows(benchmark, shortest), "benchmark-windows")
    size, found = windows.agg(F.sum(F.size("near") * 8 + 80), F.collect_set("mask")).first()
    masks = [m for m in all_masks(shortest) if m in found]
    # Written, because the comparison would make the generated code of the stage above too long to be compiled.
    hits = written(_hits(docs, windows.drop("mask"), masks, (size or 0) <= BROADCAST_BYTES), "benchmark-hits")
    agree = F.transform("near", lambda x, k: F.coalesce(F.get("cut", k - F.col("missing")) == x, F.lit(False)).cast("int"))
    width = F.least(F.size("near"), F.lit(WINDOW))
    most = F.array_max(F.transform(F.sequence(F.lit(0), F.size("near") - width), lambda w: F.aggregate(F.slice("agree", w + 1, width), F.lit(0), lambda x, y: x + y)))
    rated = hits.withColumn("agree", agree).select("doc_id", "item_id", "n_item", (most / width).alias("share")).where(F.col("share") >= AGREE)
    each = rated.groupBy("doc_id", "item_id").agg(F.max("share").alias("share"), F.max("n_item").alias("n_item"))
    return each.groupBy("doc_id").agg(F.count("*").alias("n_items"), F.sort_array(F.collect_set("item_id")).alias("item_ids"), F.max("share").alias("best"), F.max("n_item").alias("longest"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark text."""
    found = written(contaminated(docs, benchmark, shortest).select(F.col("doc_id").alias("_leaked")), "leaked")
    return docs.join(found, docs["doc_id"].eqNullSafe(found["_leaked"]), "left_anti")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, contaminated, n_items, item_ids, best, longest (0 without a match)."""
    docs = table(spark, sf_dir, "documents")
    found = contaminated(docs, table(spark, sf_dir, "benchmark")).withColumnRenamed("doc_id", "_leaked")
    joined = docs.select("doc_id").join(found, F.col("doc_id").eqNullSafe(F.col("_leaked")), "left")
    return joined.select("doc_id", F.col("n_items").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).alias("n_items"), F.array_join(F.coalesce("item_ids", F.array().cast("array<bigint>")).cast("array<string>"), ",").alias("item_ids"), F.coalesce("best", F.lit(0.0)).alias("best"), F.coalesce("longest", F.lit(0)).alias("longest"))

"""Line deduplication over levelled sorted runs of line hashes.

A store holds runs: tables of line hashes, bucketed and sorted by hash, in levels. A new batch's
hashes are merge-joined with the runs: the anti-join gives lines not seen before, which enter the
store with the batch's largest doc_id as their keeper; lines seen before only add to the counts.
The batch then becomes a run of level 0, and whenever a level holds ``fanout`` runs they are
compacted into one run of the next level. Because runs share one bucketing, the joins read them in
order without shuffling them again. (Compaction reads the runs' files as plain Parquet: Spark 4.1
takes a union of bucketed tables for bucketed even where it then scans them otherwise, groups it in
place and leaves keys in several rows.)

Defined results: a null or empty text is one empty line; each row counts as a document of its own,
so rows that repeat a doc_id count separately and are kept or dropped alike; a null doc_id is less
than all others; keys shorter than ``min_chars`` code points are never dropped; an empty table gives
an empty result. Lines are compared by two independent 64-bit hashes. Other columns are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lower_ascii, partitions, range_cuts, remove, strip_spaces, table, work_path, written

KEY = ("h1", "h2")


def line_key(line: Column) -> Column:
    return lower_ascii(strip_spaces(line))


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _long_key(line: Column, min_chars: int) -> Column:
    """The key, or null where it is too short to count."""
    key = line_key(line)
    return F.when(F.char_length(key) >= min_chars, key)


def line_hashes(docs: DataFrame, min_chars: int) -> DataFrame:
    """doc_id, h1, h2: one row for each document and each distinct long key in it."""
    keys = F.array_distinct(F.array_compact(F.transform(split_lines(F.col("text")), lambda x: _long_key(x, min_chars))))
    lines = docs.select("doc_id", F.explode(keys).alias("key"))
    return lines.select("doc_id", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("line"), "key").alias("h2"))


class LineRuns:
    """Levelled runs of (h1, h2, keeper, n_docs, first), as bucketed and sorted tables in the shared folder.

    A key has one row with a keeper (``first``) in the run of the batch that brought it, and one
    row without in each later run that saw it again, until compaction merges them.
    """

    def __init__(self, spark: SparkSession, buckets: int | None = None, fanout: int = 2):
        self.spark, self.buckets, self.fanout = spark, buckets or partitions(spark), fanout
        self.levels: list[list[str]] = []
        self.name = f"alembiq_lines_{uuid.uuid4().hex[:12]}"
        self.paths: dict[str, str] = {}
        self.made = 0

    def _dealt(self, rows: DataFrame) -> DataFrame:
        """One task for each bucket, so that a bucket is one sorted file."""
        return rows.repartition(self.buckets, *KEY)

    def _write(self, rows: DataFrame) -> str:
        name = f"{self.name}_{self.made}"
        self.made += 1
        self.paths[name] = work_path(self.spark, "line-run")
        rows.write.bucketBy(self.buckets, *KEY).sortBy(*KEY).option("path", self.paths[name]).saveAsTable(name)
        return name

    def _forget(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        remove(self.spark, self.paths.pop(name))

    def _push(self, name: str, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) >= self.fanout:
            self._compact(range(level, level + 1), level + 1)

    def _compact(self, levels: range, to: int) -> None:
        names = [n for level in levels for n in self.levels[level]]
        merged = self._write(self._merged(names))
        for level in levels:
            self.levels[level] = []
        for n in names:
            self._forget(n)
        self._push(merged, to)

    def _merged(self, names: list[str]) -> DataFrame:
        runs = self.spark.read.schema(self.spark.table(names[0]).schema).parquet(*[self.paths[n] for n in names])
        return self._dealt(runs).groupBy(*KEY).agg(F.max("first").alias("first"), F.max("keeper").alias("keeper"), F.sum("n_docs").alias("n_docs"))

    def runs(self) -> list[str]:
        return [n for level in self.levels for n in level]

    def add(self, lines: DataFrame) -> DataFrame:
        """Add a batch (doc_id, h1, h2; distinct in a document). Returns the hashes no run had before, with their keeper."""
        batch = lines.groupBy(*KEY).agg(F.max("doc_id").alias("keeper"), F.count("*").alias("n_docs"))
        if not self.runs():
            fresh = written(batch.withColumn("first", F.lit(True)), "line-fresh")
            rows = fresh
        else:
            batch = written(batch, "line-batch")
            fresh, again = batch, None
            for n in self.runs():
                run = self.spark.table(n).where("first").select(*KEY)
                seen = fresh.join(run, list(KEY), "left_semi")
                again = seen if again is None else again.unionByName(seen)
                fresh = fresh.join(run, list(KEY), "left_anti")
            fresh = written(fresh.withColumn("first", F.lit(True)), "line-fresh")
            again = again.select(*KEY, F.lit(None).cast(batch.schema["keeper"].dataType).alias("keeper"), "n_docs", F.lit(False).alias("first"))
            rows = fresh.unionByName(again)
        name = self._write(self._dealt(rows))
        self._push(name, 0)
        return fresh.drop("first", "n_docs")

    def totals(self) -> DataFrame:
        """h1, h2, keeper, n_docs over all runs, which are compacted into one."""
        if not self.runs():
            raise ValueError("no batch was added")
        if len(self.runs()) > 1:
            self._compact(range(len(self.levels)), len(self.levels))
        return self.spark.table(self.runs()[0])

    def drop(self) -> None:
        for n in self.runs():
            self._forget(n)
        self.levels = []


def repeated_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, batches: int = 4) -> DataFrame:
    """h1, h2, keeper, n_docs of the keys found in at least ``min_docs`` documents, by batches of descending doc_id.

    Descending batches make a key's first holder its keeper, so a key's keeper never changes.
    """
    spark = docs.sparkSession
    cuts = range_cuts(docs, "doc_id", batches, 0.01)
    at = sum((F.coalesce(F.col("doc_id") > c, F.lit(False)).cast("int") for c in cuts), F.lit(0))
    lines = written(line_hashes(docs, min_chars).withColumn("batch", at), "line-hashes")
    runs = LineRuns(spark)
    for b in reversed(range(len(cuts) + 1)):
        runs.add(lines.where(F.col("batch") == b).drop("batch"))
    found = written(runs.totals().where(F.col("n_docs") >= min_docs).select(*KEY, "keeper", "n_docs"), "line-repeats")
    runs.drop()
    return lines.drop("batch"), found


#: Arrays that a document's dropped keys are dealt into.
DROP_PARTS = 64
#: Keys held by more than one in this many of all (document, key) rows are joined by broadcast; there are at most this many of them.
HOT = 10_000


def dropped_keys(lines: DataFrame, repeats: DataFrame) -> DataFrame:
    """doc_id, drops: the keys each document loses, in one array, or in DROP_PARTS by their first hash where they are more than that, so that a line is looked up among few.

    A key's holders are spread over all tasks that read them: keys held by more than 1/HOT of the
    rows are at most HOT keys and are broadcast; the others meet their holders by a merge join, where
    no key has more than that share.
    """
    least = max(1, lines.count() // HOT)
    hot = repeats.where(F.col("n_docs") > least)
    cold = repeats.where(F.col("n_docs") <= least)
    lost = ~F.col("doc_id").eqNullSafe(F.col("keeper"))
    by_hot = lines.join(F.broadcast(hot), list(KEY)).where(lost).select("doc_id", *KEY)
    by_cold = lines.join(cold, list(KEY)).where(lost).select("doc_id", *KEY)
    each = by_hot.unionByName(by_cold).groupBy("doc_id").agg(F.collect_set(F.struct(*KEY)).alias("keys"))
    parts = F.transform(F.sequence(F.lit(0), F.lit(DROP_PARTS - 1)), lambda i: F.filter("keys", lambda k: _drop_part(k["h1"], F.lit(DROP_PARTS)) == i))
    return each.select("doc_id", F.when(F.size("keys") > DROP_PARTS, parts).otherwise(F.array("keys")).alias("drops"))


def _drop_part(h1: Column, parts: Column) -> Column:
    return F.pmod(h1, parts).cast("int")


def _dropped(key: Column) -> Column:
    """Whether ``drops`` has the key; null keys are never dropped."""
    h1, h2 = F.xxhash64(key), F.xxhash64(F.lit("line"), key)
    return key.isNotNull() & F.array_contains(F.get("drops", _drop_part(h1, F.size("drops"))), F.struct(h1.alias("h1"), h2.alias("h2")))


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, batches: int = 4) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept (the text without the dropped lines)."""
    lines, repeats = repeated_lines(docs, min_chars, min_docs, batches)
    drops = dropped_keys(lines, repeats).withColumnRenamed("doc_id", "_drop_id")
    joined = docs.select("doc_id", "text").join(drops, F.col("doc_id").eqNullSafe(F.col("_drop_id")), "left")
    parts = joined.withColumn("_lines", split_lines(F.col("text")))
    keep = F.filter("_lines", lambda x: ~_dropped(_long_key(x, min_chars)))
    left = parts.withColumn("_kept", F.when(F.col("drops").isNull(), F.col("_lines")).otherwise(keep))
    n = F.size("_lines").cast("long")
    return left.select("doc_id", n.alias("n_lines"), (n - F.size("_kept")).alias("n_dropped"), F.array_join("_kept", "\n").alias("kept"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


OP2_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), l AS (
  SELECT row, doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS i FROM d
), k AS (
  SELECT row, doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l
), r AS (
  SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT row) >= 3
), m AS (
  SELECT k.row, k.doc_id, k.i, k.line, r.key IS NOT NULL AND r.keeper IS DISTINCT FROM k.doc_id AS lost FROM k LEFT JOIN r ON k.key = r.key AND length(k.key) >= 20
)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (lost) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT lost), '')) AS kept_sha256
FROM m GROUP BY row, doc_id
"""

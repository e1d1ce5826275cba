"""Near-duplicates of a wide radius: covering SimHash over parts of the shingle set, then an exact Jaccard check.

Texts of similarity 0.8 differ in about 10 bits of a 64-bit SimHash, and a covering of that radius needs
some 16,000 masks. So the covering is laid over the shingles instead of the bits: a mask keeps the shingles
whose hash falls into one of P parts, and every part has a SimHash of its own. Sets of similarity 0.8
differ in at most 2/9 of their mean size, so with more parts than that some part has no difference, and
its fingerprints collide. Sets of under ``EXACT`` shingles get that many parts; larger ones get the
least number for which a pair of similarity 0.8 is expected to collide in ``COLLISIONS`` parts or more
(so missed with a probability of about e^-7, less the more alike). The number of parts is a power of two, and a
set is also dealt into the parts of the largest set that it can resemble. The whole set's fingerprint
enters the covering tables of ``simhash`` as well, so all pairs within its radius meet too.

Tables hold distinct texts only. Whatever shares a table's bucket is compared by a sketch of parities:
each shingle flips one of at least twice as many bits as the set has shingles, so two sets differ in at
least as many shingles as their bits differ. A bucket returns a spanning forest of the pairs that the
sketch leaves possible, never all of them, and these are verified on whole sets; a bucket of which a
link fails is looked through again for other links between its components.

Parts may hold nothing but shingles that many texts share (a footer, a licence), and then unlike texts share a bucket. So the
texts of buckets of more than ``SMALL`` are entered anew, under the rarest n/5 + 1 of their shingles, of which similar
sets have one in common whatever the order of rarity is; it is counted over all these texts, in ``SLOTS`` slots.
What still shares a bucket of more than ``SMALL`` is mostly alike: all its texts are compared with one of them, and
only those that this does not link are dealt out, in pairs of blocks, against one another and the linked.

Defined results: shingles are of lower-cased ASCII words, a text of fewer words is one shingle; null,
empty and blank texts are copies of one another; a null doc_id ranks after all others; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import remove_written
from .common import few, partitions, released, text_batches, written
from .simhash import MASKS, _Forest, _shingle_hashes, components

SHINGLE = 5
#: The least similarity of a link, as a fraction.
SIMILARITY = (4, 5)
#: Sets below this size have more parts than a similar set can differ in.
EXACT = 64
#: Parts that a pair of the least similarity shares on average, at least.
COLLISIONS = 7.0
#: Texts of a bucket that are compared in one task; larger buckets are dealt out in pairs of half as large blocks.
SMALL = 2048
#: Slots in which shingles are counted, to rank them by rarity; a shingle's count is that of its slot.
SLOTS = 1 << 20
#: 64-bit words of a sketch at least.
WORDS = 16

_ROW = pa.schema([("key", pa.int64()), ("n", pa.int64()), ("sketch", pa.list_(pa.int64())), ("tables", pa.list_(pa.int64()))])


def shingle_set(text: str | None, k: int = SHINGLE) -> np.ndarray:
    """The distinct shingle hashes, sorted; 0 alone where there are no words."""
    found = np.unique(_shingle_hashes(text, k))
    return found if len(found) else np.zeros(1, np.uint64)


def n_parts(n: int) -> int:
    """Parts of a set of ``n`` shingles; it never falls as ``n`` grows."""
    num, den = SIMILARITY
    if n < EXACT:
        return 1 << (2 * n * (den - num) // (den + num)).bit_length()  # above the shingles that sets of this size can differ in
    p, union = n_parts(EXACT - 1), 2 * n * den / (den + num)
    while p * (num / den) ** (union / p) < COLLISIONS:
        p *= 2
    return p


def part_prints(found: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and SimHashes of the parts that hold a shingle of the set."""
    part = (found >> np.uint64(40)).astype(np.int64) & (parts - 1)
    by = np.argsort(part, kind="stable")
    part, found = part[by], found[by]
    cuts = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
    size = np.diff(np.concatenate((cuts, [len(part)])))
    bits = np.unpackbits(found.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    ones = np.add.reduceat(bits, cuts, axis=0, dtype=np.int32)
    prints = np.packbits(ones * 2 > size[:, None], axis=1).view(">u8").ravel().astype(np.uint64)
    return part[cuts], prints


def _mixed(x: np.ndarray, salt: np.ndarray | int) -> np.ndarray:
    """64-bit table keys of fingerprints and what they are fingerprints of."""
    z = x ^ (np.asarray(salt, np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


_MASK_KEYS = np.array(MASKS, np.uint64)


def tables(found: np.ndarray) -> np.ndarray:
    """The keys under which a set is entered: covering masks of the whole set's SimHash, and the parts' SimHashes."""
    _, whole = part_prints(found, 1)
    keys = [_mixed(_MASK_KEYS & whole, np.arange(1, len(MASKS) + 1))]
    n = len(found)
    for p in sorted({n_parts(n), n_parts(n * SIMILARITY[1] // SIMILARITY[0])}):
        at, prints = part_prints(found, p)
        keys.append(_mixed(prints, (np.uint64(p) << np.uint64(32)) + at.astype(np.uint64)))
    return np.unique(np.concatenate(keys))


def sketch(found: np.ndarray) -> np.ndarray:
    """Parities of the shingles' bins; of a power of two of 64-bit words, at least WORDS and two bits a shingle."""
    words = max(WORDS, 1 << ((2 * len(found) - 1) // 64).bit_length())
    bins = (found & np.uint64(64 * words - 1)).astype(np.intp)
    return np.packbits(np.bincount(bins, minlength=64 * words) & 1).view(np.int64)


def folded(rows: list[np.ndarray]) -> np.ndarray:
    """Sketches as rows of one matrix, all folded to the shortest."""
    width = min(map(len, rows))
    return np.stack([r if len(r) == width else np.bitwise_xor.reduce(r.reshape(-1, width), axis=0) for r in rows]).view(np.uint64)


def _possible(n: np.ndarray, m: np.ndarray, differ: np.ndarray) -> np.ndarray:
    """Whether sets of these sizes that differ in at least so many shingles can be similar."""
    num, den = SIMILARITY
    return (num + den) * differ <= (den - num) * (n + m)


def bucket_links(n: np.ndarray, sketches: np.ndarray, roots: np.ndarray | None = None, barred: set[tuple[int, int]] | None = None) -> list[tuple[int, int]]:
    """Links between members of a bucket, as pairs of their positions.

    Without ``roots`` a spanning forest of the possible pairs. With the members' components as
    ``roots``, every possible pair between different components that is not ``barred``.
    """
    k, forest, found = len(n), _Forest(len(n)), []
    root = np.arange(k) if roots is None else np.unique(roots, return_inverse=True)[1].astype(np.int64)
    for i in range(k - 1):
        other = np.flatnonzero(root[i + 1 :] != root[i]) + i + 1
        if not len(other):
            continue
        near = other[np.abs(n[other] - n[i]) * sum(SIMILARITY) <= (SIMILARITY[1] - SIMILARITY[0]) * (n[other] + n[i])]
        differ = np.bitwise_count(sketches[near] ^ sketches[i]).sum(axis=1, dtype=np.int64)
        for j in near[_possible(n[near], n[i], differ)].tolist():
            if roots is not None:
                if (i, j) not in barred:
                    found.append((i, j))
            elif root[i] != root[j]:
                found.append((i, j))
                root[root == root[j]] = root[i]
    return found


def _key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _slices(batches: Iterator[pa.RecordBatch], rows: int, chars: int) -> Iterator[pa.RecordBatch]:
    """The batches in parts of bounded length and text."""
    for b in batches:
        i = 0
        while i < b.num_rows:
            j, held = i, 0
            while j < b.num_rows and j - i < rows and held < chars:
                held += len(b.column("text")[j].as_py() or "")
                j += 1
            yield b.slice(i, j - i)
            i = j


def entered(texts: DataFrame, k: int = SHINGLE) -> DataFrame:
    """key, n (shingles), sketch and tables of distinct texts (columns key, text)."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches, 500, 1 << 20):
            sets = [shingle_set(t.as_py(), k) for t in part.column("text")]
            arrays = [part.column("key"), pa.array([len(s) for s in sets], pa.int64()), pa.array([sketch(s) for s in sets], pa.list_(pa.int64())), pa.array([tables(s).view(np.int64) for s in sets], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, schema=_ROW)

    text_batches(texts.sparkSession)
    rows = texts.select("key", F.col("text").cast("string").alias("text")).mapInArrow(released(of), "key long, n long, sketch array<long>, tables array<long>")
    return rows.dropDuplicates(["key"])


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows, sorted by g, in tables that cut no group."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        g = b.column("g").to_numpy()
        last = int(np.searchsorted(g, g[-1]))
        if held and (last or held[-1].column("g")[-1].as_py() != g[0]):
            # What is held is one group, which ends before the last group of this batch begins.
            yield pa.Table.from_batches([*held, b.slice(0, last)]).combine_chunks()
            held = []
        elif last:
            yield pa.Table.from_batches([b.slice(0, last)])
        held.append(b.slice(last))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _pair_links(pairs: np.ndarray, n: np.ndarray, flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Those of the ``pairs`` (positions of two rows) whose sketches, of one width, leave them possible."""
    width, out = np.diff(offsets), []
    for w in np.unique(width[pairs[:, 0]]).tolist():
        some = pairs[width[pairs[:, 0]] == w]
        x, y = (flat[offsets[some[:, k]][:, None] + np.arange(w)] for k in (0, 1))
        differ = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
        out.append(some[_possible(n[some[:, 0]], n[some[:, 1]], differ)])
    return np.concatenate(out)


def _bucket_links(rows: DataFrame, again: bool) -> DataFrame:
    """h, a, b: links of all groups ``g``; ``rows`` holds g, h, key, n, sketch and, if ``again``, root and bad."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_groups(batches):
            g, h, key, n = (t.column(c).to_numpy() for c in ("g", "h", "key", "n"))
            lists = t.column("sketch").combine_chunks()
            offsets, flat = lists.offsets.to_numpy().astype(np.int64), lists.values.to_numpy().view(np.uint64)
            starts = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
            sizes = np.diff(np.concatenate((starts, [len(g)])))
            plain = (sizes == 2) & (not again)
            width = np.diff(offsets)
            plain[plain] = width[starts[plain]] == width[starts[plain] + 1]
            out: list[tuple[int, int, int]] = []
            if plain.any():
                two = starts[plain]
                two = np.stack([two, two + 1], axis=1)
                two = _pair_links(np.take_along_axis(two, np.argsort(key[two], axis=1), axis=1), n, flat, offsets)
                out += zip(h[two[:, 0]].tolist(), key[two[:, 0]].tolist(), key[two[:, 1]].tolist())
            root = t.column("root").to_numpy() if again else None
            for s, e in zip(starts[~plain].tolist(), (starts + sizes)[~plain].tolist()):
                at = s + np.argsort(key[s:e], kind="stable")
                barred = None
                if again:
                    place = {v: i for i, v in enumerate(key[at].tolist())}
                    barred = {(place[v], place[w]) for v, i in zip(key[at].tolist(), at.tolist()) for w in t.column("bad")[i].as_py() or [] if w in place}
                links = bucket_links(n[at], folded([flat[offsets[i] : offsets[i + 1]] for i in at]), root[at] if again else None, barred)
                out += [(int(h[s]), int(key[at[i]]), int(key[at[j]])) for i, j in links]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["h", "a", "b"])

    dealt = rows.repartition(partitions(rows.sparkSession), "g").sortWithinPartitions("g")
    return dealt.mapInArrow(released(of), "h long, a long, b long")


def rarest(found: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The shingles of a set that come first by rarity, so many that two similar sets have one of them in common."""
    num, den = SIMILARITY
    by = np.lexsort((found, counts[(found >> np.uint64(20)) & np.uint64(SLOTS - 1)]))
    return found[by[: len(found) - -(-len(found) * num // den) + 1]]


def _refined(texts: DataFrame, keys: DataFrame, k: int) -> DataFrame:
    """h, key: the texts of ``keys`` entered under their rarest shingles."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.int64)
        for part in _slices(batches, 500, 1 << 20):
            for t in part.column("text"):
                np.add.at(total, (shingle_set(t.as_py(), k) >> np.uint64(20)) & np.uint64(SLOTS - 1), 1)
        at = np.flatnonzero(total)
        for i in range(0, len(at), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(at[i : i + (1 << 16)], pa.int32()), pa.array(total[at[i : i + (1 << 16)]], pa.int64())], ["slot", "n"])

    text_batches(texts.sparkSession)
    whole = texts.join(few(keys), "key", "left_semi").select("key", F.col("text").cast("string").alias("text"))
    counted = whole.select("text").mapInArrow(released(count), "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()  # SLOTS rows at most
    counts = np.zeros(SLOTS, np.int64)
    counts[counted.column("slot").to_numpy()] = counted.column("n").to_numpy()

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches, 500, 1 << 20):
            rows = [rarest(shingle_set(t.as_py(), k), counts).view(np.int64) for t in part.column("text")]
            yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(rows, pa.list_(pa.int64()))], ["key", "h"])

    return whole.mapInArrow(released(enter), "key long, h array<long>").dropDuplicates(["key"]).select(F.explode("h").alias("h"), "key")


def _starred(large: DataFrame) -> DataFrame:
    """h, a, b: in each bucket of ``large`` (h, key, n, sketch), links of one text with those that the sketch leaves possible."""
    num, den = SIMILARITY

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            n, m = t.column("n").to_numpy(), t.column("m").to_numpy()
            near = np.flatnonzero((np.abs(n - m) * (num + den) <= (den - num) * (n + m)) & (t.column("key").to_numpy() != t.column("a").to_numpy()))
            pairs = ((t.column("sketch")[i].values.to_numpy(), t.column("other")[i].values.to_numpy()) for i in near.tolist())
            differ = np.array([int(np.bitwise_count(np.bitwise_xor(*folded([x, y]))).sum()) for x, y in pairs], np.int64)
            yield t.take(near[_possible(n[near], m[near], differ)]).select(["h", "a", "key"])

    pivots = large.groupBy("h").agg(F.min(F.struct("key", "n", "sketch")).alias("p")).select("h", F.col("p.key").alias("a"), F.col("p.n").alias("m"), F.col("p.sketch").alias("other"))
    met = large.join(few(written(pivots, "near-pivots")), "h").select("h", "key", "n", "sketch", "a", "m", "other")
    return met.mapInArrow(released(of), "h long, a long, key long").withColumnRenamed("key", "b")


def _dealt(large: DataFrame, linked: DataFrame) -> DataFrame:
    """``large`` with the group g that compares a row: each pair of blocks of its bucket of which not both hold texts ``linked`` (h, key) to its pivot."""
    rows = large.join(linked.withColumn("near", F.lit(True)), ["h", "key"], "left").withColumn("near", F.coalesce("near", F.lit(False)))
    blocks = lambda n: F.ceil(n * 2 / SMALL).cast("int")
    sizes = written(rows.groupBy("h").agg(blocks(F.count_if(~F.col("near"))).alias("far_blocks"), blocks(F.count_if("near")).alias("near_blocks")), "near-blocks")
    rows = rows.join(few(sizes), "h").where("far_blocks > 0")
    own = lambda n: F.pmod(F.xxhash64("key"), F.greatest(F.lit(1), F.col(n))).cast("int")
    each = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    far, near = rows.where("NOT near").withColumn("own", own("far_blocks")), rows.where("near").withColumn("own", own("near_blocks"))
    among = far.withColumn("other", F.explode(each("far_blocks"))).withColumn("g", F.xxhash64("h", F.least("own", "other"), F.greatest("own", "other")))
    across = far.where("near_blocks > 0").withColumn("other", F.explode(each("near_blocks"))).withColumn("g", F.xxhash64("h", F.lit(-1), "own", "other"))
    linked = near.withColumn("other", F.explode(each("far_blocks"))).withColumn("g", F.xxhash64("h", F.lit(-1), "other", "own"))
    return among.unionByName(across).unionByName(linked).select("g", "h", "key", "n", "sketch")


def _both(pairs: DataFrame, of: DataFrame, column: str) -> DataFrame:
    """``pairs`` with the column of either side, as x and y."""
    left, right = (of.select(F.col("key").alias(k), F.col(column).alias(v)) for k, v in (("a", "x"), ("b", "y")))
    return pairs.join(left, "a").join(right, "b")


def _verified(pairs: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """``pairs`` (distinct a, b) with whether their whole sets are similar."""
    num, den = SIMILARITY

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches, 500, 1 << 20):
            sets = [shingle_set(t.as_py(), k).view(np.int64) for t in part.column("text")]
            yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(sets, pa.list_(pa.int64()))], ["key", "s"])

    pairs = written(pairs, "near-pairs")
    keys = written(pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key"))).distinct(), "near-keys")
    whole = texts.join(few(keys), "key", "left_semi").select("key", F.col("text").cast("string").alias("text")).dropDuplicates(["key"])
    sets = written(whole.mapInArrow(released(of), "key long, s array<long>"), "near-sets")
    met = _both(pairs, sets, "s").withColumn("both", F.size(F.array_intersect("x", "y")))
    similar = (num + den) * F.col("both") >= num * (F.size("x") + F.size("y"))
    found = written(met.select("a", "b", similar.alias("similar")), "near-verified", sets)
    remove_written(pairs, keys)
    return found


def links(texts: DataFrame, k: int = SHINGLE) -> DataFrame:
    """a, b: links enough to connect all texts (columns key, text) that similar pairs connect."""
    rows = written(entered(texts, k), "near-entered")
    keyed = rows.select("key", F.explode("tables").alias("h"))
    sizes = written(keyed.groupBy("h").agg(F.count("*").alias("size")).where("size > 1"), "near-sizes")
    shared = keyed.join(sizes, "h")
    crowded = sizes.where(F.col("size") > SMALL)
    if not crowded.isEmpty():
        keys = written(keyed.join(few(crowded), "h", "left_semi").select("key").distinct(), "near-crowded")
        anew = written(_refined(texts, keys, k), "near-rarest")
        again = anew.groupBy("h").agg(F.count("*").alias("size")).where("size > 1")
        shared = shared.where(F.col("size") <= SMALL).unionByName(anew.join(again, "h").select("h", "key", "size"))
    sketched = written(shared.join(rows.select("key", "n", "sketch"), "key").select("h", "key", "size", "n", "sketch"), "near-sketched")
    remove_written(rows, sizes)
    groups = sketched.where(F.col("size") <= SMALL).select(F.col("h").alias("g"), "h", "key", "n", "sketch")
    large, stars = sketched.where(F.col("size") > SMALL).select("h", "key", "n", "sketch"), None
    if not large.isEmpty():
        near = written(_starred(large), "near-stars")
        stars = _verified(near.select("a", "b").distinct(), texts, k)
        held = near.join(stars.where("similar"), ["a", "b"], "left_semi")
        linked = held.select("h", F.col("b").alias("key")).unionByName(held.select("h", F.col("a").alias("key")).distinct())
        groups = groups.unionByName(_dealt(large, linked))
    grouped = written(groups, "near-groups")
    first = written(_bucket_links(grouped, False), "near-links")
    tried = _verified(first.select("a", "b").distinct(), texts, k)
    found, failed = tried.where("similar").select("a", "b"), tried.where("NOT similar").select("a", "b")
    if stars is not None:
        found = found.unionByName(stars.where("similar").select("a", "b"))
    if failed.isEmpty():
        remove_written(sketched, grouped, first)
        return found
    # In buckets of which a link failed, every pair between components that is still possible is tried.
    buckets = first.join(failed, ["a", "b"], "left_semi").select("h").distinct()
    bad = failed.groupBy(F.col("a").alias("key")).agg(F.collect_list("b").alias("bad"))
    roots = components(found).select(F.col("node").alias("key"), "root")
    once = grouped.join(buckets, "h", "left_semi").join(roots, "key", "left").join(bad, "key", "left")
    more = _bucket_links(once.select("g", "h", "key", "n", "sketch", F.coalesce("root", "key").alias("root"), "bad"), True)
    more = written(more.select("a", "b").distinct(), "near-links")
    remove_written(sketched, grouped, first)
    return found.unionByName(_verified(more, texts, k).where("similar").select("a", "b"))


def deduplicated(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """One document of each component of similar texts, the one of smallest doc_id, with the columns of ``docs``.

    Rows without a doc_id are kept. Rows that repeat a kept doc_id with the same text are reduced to one.
    """
    texts = docs.select(_key(F.col("text")).alias("key"), "text")
    rows = docs.select(F.col("doc_id").alias("_copy"), _key(F.col("text")).alias("_key"))
    classes = written(rows.groupBy("_key").agg(F.min("_copy").alias("first")), "near-classes")
    roots = components(links(texts, k))
    of = written(classes.join(roots, F.col("_key") == F.col("node"), "left").select("_key", "first", F.coalesce("root", "_key").alias("root")), "near-roots")
    named = of.join(of.groupBy("root").agg(F.min("first").alias("component_id")), "root").select("_key", "component_id")
    dropped = written(rows.join(named, "_key").where("_copy <> component_id").select("_copy", "_key").distinct(), "near-dropped")
    kept = docs.join(few(dropped), (docs["doc_id"] == dropped["_copy"]) & (_key(docs["text"]) == dropped["_key"]), "left_anti")
    repeated = written(docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 AND doc_id IS NOT NULL").select(F.col("doc_id").alias("_copy")), "near-repeated")
    if repeated.isEmpty():
        return kept
    again = docs["doc_id"] == repeated["_copy"]
    return kept.join(repeated, again, "left_anti").unionByName(kept.join(repeated, again, "left_semi").dropDuplicates(["doc_id", "text"]))

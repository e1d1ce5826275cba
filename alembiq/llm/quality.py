"""Quality classification by co-training of two views.

The text view sees what is written: hashed frequencies of words and word pairs, of byte pairs and of character
classes, and how words are formed and repeated. The metadata view sees what is known of the page without reading it:
language, source, its size plain and compressed, and the number, lengths and repetition of its lines. Each view is a logistic regression. They start
from the labelled rows; then, for some rounds, each view labels the unlabelled documents it is surest of,
the surest good and the surest bad ones in proportion, and the *other* view is fitted on them, too.
All of this is cross-fitted: FOLDS pairs of views, each fitted without one part of the labelled rows, exchange side by side in
the same passes, so that after each round every labelled row has logits of views that never saw its label. These calibrate the views and
rate the round: a view keeps what it learned from the other only if this lowers its own loss by more than the standard error of
the difference, and goes back to what it was otherwise, so labels that mislead it, or help by chance, leave no trace while it
may go on teaching the other. Of the pairs so made the one of least loss together counts. A view of the result is the mean of its
folds' views, which is again one linear model. The score of a document is the mean of both calibrated logits, weighted by each view's calibration likelihood.

Labelled rows are a sample of at most MAX_LABELLED. Of the unlabelled ones every distinct text takes part:
their vectors are written once, a histogram of each view's logits over all of them gives the thresholds
of a round, and the rows beyond these are fitted on through sums of gradients, so the driver holds a
few numbers whatever the size. All pseudo-labels of a round together weigh PSEUDO of the labelled rows.

Defined results: null and empty texts have zero vectors in the text view; null lang and source are
categories of their own; labels of rows whose crc32(doc_id) mod 3 is 1 are never read; with labels of
one class or none, every score is the share of good labels (0.5 without labels); further columns
are ignored; repeated rows are scored alike; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from itertools import count, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, released, table, text_batches, written
from .learning import MAX_LABELLED, held_out, labelled_sample, logistic, sigmoid

PAIR_BINS = 256
#: Bins of words and of pairs of neighbouring words; Newton's method holds their products on the driver.
WORD_BINS = 512
#: Parts of the labelled rows, each left out of the fit of one pair of views.
FOLDS = 4
CATEGORY_BINS = 32
ROUNDS = 4
#: Share of the unlabelled texts that a view labels in the first round; as many more in each further one.
SURE = 0.05
#: Weight of all pseudo-labels of a round over that of all labelled rows, and steps by which they are fitted.
PSEUDO, STEPS = 0.5, 4
#: Logits are counted in bins of 1/SCALE between -HALF/SCALE and HALF/SCALE; a pseudo-label needs a calibrated one beyond LEAST.
SCALE, HALF, LEAST = 64, 2048, 2.0

_CLASS = np.zeros(256, np.intp)
for _i in range(256):
    _c = chr(_i)
    _CLASS[_i] = 0 if _i >= 128 else 1 if _c.islower() else 2 if _c.isupper() else 3 if _c.isdigit() else 4 if _c in SPACES else 5 + (_c in ".,;:") + 2 * (_c in "!?") + 3 * (_c in "|%$&*#@^~<>{}[]\\=+")
N_CLASS = 9
WORD_DIM, LAYOUT_DIM = 6, 10
TEXT_DIM = PAIR_BINS + N_CLASS + WORD_DIM + 2 * WORD_BINS
META_DIM = LAYOUT_DIM + 2 * CATEGORY_BINS


#: Characters of texts whose words are taken apart together; words that a worker remembers, and the characters of these, before it forgets them.
PART_CHARS, REMEMBERED, REMEMBERED_CHARS = 1 << 20, 1 << 17, 1 << 23
#: The bin of each pair of bytes, letters lower-cased.
_low = np.array([i + 32 if 65 <= i <= 90 else i for i in range(256)], np.uint32)
_PAIR = (((_low[:, None] * 31 + _low) * np.uint32(2654435761) >> 7) & (PAIR_BINS - 1)).astype(np.uint8).ravel()


#: Words of up to so many bytes, a space before them included, join another's CRC-32 by table.
LONGEST = 64


def _shifts() -> np.ndarray:
    """For each length and each place and value of a byte of a CRC-32, what it adds to the CRC-32 of a text so much longer: the sum is by exclusive or."""
    out = np.zeros((LONGEST + 1, 4, 256), np.uint32)
    for n in range(LONGEST + 1):
        zeros = bytes(n)
        for bit in range(32):
            at, step = divmod(bit, 8)
            out[n, at, 1 << step : 2 << step] = out[n, at, : 1 << step] ^ np.uint32(zlib.crc32(zeros, 1 << bit) ^ zlib.crc32(zeros))
    return out.ravel()


_SHIFTS = _shifts()


def _joined(first: np.ndarray, second: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-32 of pairs of texts from those of each and the second's bytes, at most LONGEST."""
    at = size << 10
    return second ^ _SHIFTS[at + (first & 255)] ^ _SHIFTS[at + 256 + (first >> 8 & 255)] ^ _SHIFTS[at + 512 + (first >> 16 & 255)] ^ _SHIFTS[at + 768 + (first >> 24)]


class Words:
    """What a worker remembers of words: CRC-32 of the lower-cased word, bytes and (up to LONGEST) CRC-32 of it after a space, characters, whether it begins with a capital and ends with a letter or digit."""

    def __init__(self):
        self.forget()

    def forget(self) -> None:
        self.number: defaultdict[str, int] = defaultdict(count().__next__)
        self.told = np.zeros((6, 0), np.int64)

    def look(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of words, and what is told of all numbers."""
        if self.told.shape[1] > REMEMBERED or self.told[3].sum() > REMEMBERED_CHARS:
            self.forget()
        before = len(self.number)
        number = np.fromiter(map(self.number.__getitem__, words), np.intp, len(words))
        new = list(islice(self.number, before, None))
        if new:
            low = " ".join(new).lower().encode("utf-8", "surrogatepass").split(b" ")
            crc, size, *rest = (np.fromiter(x, np.int64, len(new)) for x in (map(zlib.crc32, low), map(len, low), map(len, new), [w[0].isupper() for w in new], [w[-1].isalnum() for w in new]))
            spaced = _joined(np.int64(zlib.crc32(b" ")), crc, np.where(size < LONGEST, size, 0))
            self.told = np.hstack([self.told, [crc, size + 1, spaced, *rest]])
        return number, self.told


_words = Words()


def forget() -> None:
    """Forget what this process remembers of words."""
    _words.forget()


def text_views(texts: list[str | None]) -> np.ndarray:
    """A row for each text."""
    out = np.zeros((len(texts), TEXT_DIM), np.float32)
    at, chars = 0, 0
    for i, t in enumerate(texts):
        _byte_view(out[i], (t or "").encode("utf-8", "surrogatepass"))
        chars += len(t or "")
        if chars >= PART_CHARS or i == len(texts) - 1:
            _word_views(out[at : i + 1], [(x or "").split() for x in texts[at : i + 1]])
            at, chars = i + 1, 0
    return out


def _byte_view(out: np.ndarray, text: bytes) -> None:
    b = np.frombuffer(text, np.uint8)
    if len(b) > 1:
        for i in range(0, len(b) - 1, 1 << 20):
            part = b[i : i + (1 << 20) + 1]
            out[:PAIR_BINS] += np.bincount(_PAIR[part[:-1].astype(np.intp) << 8 | part[1:]], minlength=PAIR_BINS)
        out[:PAIR_BINS] = np.sqrt(out[:PAIR_BINS] / (len(b) - 1))
    if len(b):
        out[PAIR_BINS : PAIR_BINS + N_CLASS] = 4 * np.sqrt(np.bincount(_CLASS, np.bincount(b, minlength=256), N_CLASS) / len(b))


def _word_views(out: np.ndarray, texts: list[list[str]]) -> None:
    """What is seen of words, of all texts at once: Python meets each word once while it is remembered."""
    n = np.array([len(x) for x in texts])
    every = [w for x in texts for w in x]
    if not every:
        return
    number, told = _words.look(every)
    crc, size, spaced, chars, upper, alnum = told[:, number]
    doc = np.repeat(np.arange(len(texts)), n)
    summed = lambda x: np.bincount(doc, x, len(texts))
    some = np.nonzero(n)[0]
    distinct, many = np.array([len(set(texts[i])) for i in some]), n[some]
    pair = np.nonzero(doc[1:] == doc[:-1])[0]
    again = np.bincount(doc[pair[number[pair] == number[pair + 1]]], minlength=len(texts))
    shape = (distinct / many, distinct / many * np.log1p(many), summed(chars)[some] / many / 5, again[some] / many * 4, summed(upper)[some] / many, summed(alnum)[some] / many)
    out[some, PAIR_BINS + N_CLASS : PAIR_BINS + N_CLASS + WORD_DIM] = np.stack(shape, axis=1)
    _counted(out[:, -2 * WORD_BINS : -WORD_BINS], doc, crc)
    first, second = crc[pair], pair + 1
    long = size[second] > LONGEST
    both = _joined(first, spaced[second], np.where(long, 0, size[second]))
    for i in np.nonzero(long)[0].tolist():
        both[i] = zlib.crc32(f" {every[second[i]].lower()}".encode("utf-8", "surrogatepass"), int(first[i]))
    _counted(out[:, -WORD_BINS:], doc[pair], both)


def _counted(out: np.ndarray, doc: np.ndarray, crc: np.ndarray) -> None:
    """Square roots of the shares of terms in hashed bins, a row for each document."""
    counts = np.bincount(doc * WORD_BINS + crc % WORD_BINS, minlength=len(out) * WORD_BINS).reshape(len(out), WORD_BINS)
    out[:] = np.sqrt(counts / np.maximum(counts.sum(axis=1, keepdims=True), 1))


def metadata_view(text: str | None, lang: str | None, source: str | None) -> np.ndarray:
    rows = (text or "").split("\n")
    lines = list(map(len, rows))
    n, m = sum(lines), len(lines)
    plain = (text or "").encode("utf-8", "surrogatepass")
    packed = len(zlib.compress(plain, 1))
    out = np.zeros(META_DIM, np.float32)
    out[:LAYOUT_DIM] = (np.log1p(n) / 5, np.log1p(m) / 3, np.log1p(n / m) / 4, np.log1p(max(lines)) / 5, sum(x == 0 for x in lines) / m, sum(0 < x < 40 for x in lines) / m, np.log1p(packed) / 5, packed / (len(plain) + 20), np.log(packed / (len(plain) + 20)), len(set(rows)) / m)
    for k, v in enumerate((lang, source)):
        out[LAYOUT_DIM + k * CATEGORY_BINS + (zlib.crc32(v.encode("utf-8", "surrogatepass")) % (CATEGORY_BINS - 1) + 1 if v is not None else 0)] = 1
    return out


@dataclass
class View:
    """A standardised logistic regression with a calibration."""

    mean: np.ndarray
    scale: np.ndarray
    coef: np.ndarray
    slope: float = 1.0
    shift: float = 0.0
    weight: float = 1.0

    def logit(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.coef[:-1] + self.coef[-1]

    def calibrated(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.slope * self.logit(x) + self.shift, -12, 12)


@dataclass
class CoTrained:
    views: list[View] = field(default_factory=list)
    constant: float = 0.5
    #: The round that counts (0: before any exchange), and the loss of each round on rows that its views never saw.
    turn: int = 0
    losses: tuple[float, ...] = ()

    def score(self, xs: list[np.ndarray]) -> np.ndarray:
        if not self.views:
            return np.full(len(xs[0]), self.constant)
        total = sum(v.weight for v in self.views)
        return sigmoid(sum(v.weight * v.calibrated(x) for v, x in zip(self.views, xs)) / total)


def _fit(x: np.ndarray, y: np.ndarray) -> View:
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)
    return View(mean, scale, logistic((x - mean) / scale, y, ridge=RIDGE))


RIDGE = 5.0


def histograms(views: list[View], xs: list[np.ndarray]) -> np.ndarray:
    """How many rows have a logit in each bin, a row for each view."""
    bins = [np.clip(np.floor(v.logit(x) * SCALE), -HALF, HALF - 1).astype(np.int64) + HALF for v, x in zip(views, xs)]
    return np.stack([np.bincount(b, minlength=2 * HALF) for b in bins])


def surest(counts: np.ndarray, share: float, good: float, view: View) -> tuple[float, float]:
    """The logits of a view up to which rows are the surest bad ones and from which they are the surest good ones. Calibrated, they must lie beyond LEAST, so a view that says little labels nothing."""
    n = counts.sum()
    low = np.searchsorted(np.cumsum(counts), n * share * (1 - good), side="right") - HALF
    high = HALF - np.searchsorted(np.cumsum(counts[::-1]), n * share * good, side="right")
    if view.slope <= 0:
        return -np.inf, np.inf
    return min(low / SCALE, (-LEAST - view.shift) / view.slope), max(high / SCALE, (LEAST - view.shift) / view.slope)


def gradients(views: list[View], sure: list[View], cuts: list[tuple[float, float]], xs: list[np.ndarray]) -> list[np.ndarray]:
    """For each view, the gradient over the rows that the other of the ``sure`` views labels, and last the number of these."""
    out = []
    for k, (v, x) in enumerate(zip(views, xs)):
        low, high = cuts[1 - k]
        other = sure[1 - k].logit(xs[1 - k])
        taken = (other < low) | (other >= high)
        z = np.hstack([(x[taken] - v.mean) / v.scale, np.ones((int(taken.sum()), 1))])
        out.append(np.append(z.T @ (sigmoid(z @ v.coef) - (other[taken] >= high)), len(z)))
    return out


#: A pair of views that exchange, the pair as it was when it labelled, and the logits beyond which each of it labelled.
Job = tuple[list[View], list[View], list[tuple[float, float]]]


class Pool:
    """Unlabelled rows held as matrices, one for each view."""

    def __init__(self, xs: list[np.ndarray]):
        self.xs = xs

    def histograms(self, teams: list[list[View]]) -> np.ndarray:
        return np.stack([histograms(views, self.xs) for views in teams])

    def gradients(self, jobs: list[Job]) -> list[list[np.ndarray]]:
        return [gradients(*job, self.xs) for job in jobs]


class TablePool:
    """Unlabelled rows in a table (a, m: the vectors of both views as bytes)."""

    def __init__(self, rows: DataFrame):
        self.rows = rows

    def _summed(self, of: Callable[[list[np.ndarray]], np.ndarray], width: int) -> np.ndarray:
        """The sum of ``of`` over all rows: summed in each task, then in a few, then here."""

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(width)
            for b in batches:
                for i in range(0, b.num_rows, 500):
                    part = b.slice(i, 500)
                    total += of([np.frombuffer(b"".join(part.column(c).to_pylist()), np.float16).reshape(part.num_rows, -1).astype(np.float32) for c in ("a", "m")])
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["part"])

        def few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = sum((np.frombuffer(x, np.float64) for b in batches for x in b.column("part").to_pylist()), np.zeros(width))
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["part"])

        parts = self.rows.select("a", "m").mapInArrow(released(each), "part binary").repartition(8).mapInArrow(few, "part binary").collect()
        return sum((np.frombuffer(r["part"], np.float64) for r in parts), np.zeros(width))

    def histograms(self, teams: list[list[View]]) -> np.ndarray:
        return self._summed(lambda xs: Pool(xs).histograms(teams).ravel().astype(float), len(teams) * 4 * HALF).reshape(len(teams), 2, -1)

    def gradients(self, jobs: list[Job]) -> list[list[np.ndarray]]:
        widths = [len(v.coef) + 1 for views, _, _ in jobs for v in views]
        found = np.split(self._summed(lambda xs: np.concatenate([g for gs in Pool(xs).gradients(jobs) for g in gs]), sum(widths)), np.cumsum(widths)[:-1])
        return [found[i : i + 2] for i in range(0, len(found), 2)]


def folds(y: np.ndarray, most: int = FOLDS) -> np.ndarray:
    """The part that each labelled row belongs to: both classes in turn, and as many parts as the rarer class has rows at most."""
    n = min(most, int((y == 1).sum()), int((y == 0).sum()))
    out = np.zeros(len(y), int)
    for k in (0, 1):
        out[y == k] = np.arange((y == k).sum()) % n
    return out


def co_train(labelled: list[np.ndarray], y: np.ndarray, pool: Pool | TablePool, rounds: int = ROUNDS, sure: float = SURE) -> CoTrained:
    """Fit both views from labelled vectors (a matrix a view), in the order given, and a pool of unlabelled ones."""
    if len(y) < 10 or y.min() == y.max():
        return CoTrained(constant=float(y.mean()) if len(y) else 0.5)
    part = folds(y)
    fits = [part != k if part.max() else part == k for k in range(part.max() + 1)]
    teams = [[_fit(x[fit], y[fit]) for x in labelled] for fit in fits]
    best = _calibrated(teams, part, labelled, y)
    now, losses, turn, idle = best, [float(best[0].mean())], 0, 0
    curves: list[list[np.ndarray]] = []
    for at in range(1, rounds + 1):
        before = [[replace(v) for v in views] for views in teams]
        jobs = [(views, old, [surest(c, sure * at, float(y[fit].mean()), v) for c, v in zip(counts, views)]) for views, old, fit, counts in zip(teams, before, fits, pool.histograms(teams))]
        for _ in range(STEPS):
            given = pool.gradients(jobs)
            if not any(g[-1] for gs in given for g in gs):
                break
            for k, (views, fit) in enumerate(zip(teams, fits)):
                if len(curves) <= k:
                    curves.append([_curve(v, x[fit]) for v, x in zip(views, labelled)])
                for v, x, c, g in zip(views, labelled, curves[k], given[k]):
                    z, penalty = _standard(v, x[fit]), np.append(np.full(x.shape[1], RIDGE), 1e-6)
                    weight = PSEUDO * fit.sum() / max(1.0, g[-1])
                    v.coef = v.coef - c @ (z.T @ (sigmoid(z @ v.coef) - y[fit]) + penalty * v.coef + weight * g[:-1])
        taught = _calibrated(teams, part, labelled, y)
        gains = [a - b for a, b in zip(now[2], taught[2])]
        kept = [g.mean() > g.std() / math.sqrt(len(y)) for g in gains]
        for views, old in zip(teams, before):
            views[:] = [v if keep else o for v, o, keep in zip(views, old, kept)]
        now = taught if all(kept) else _calibrated(teams, part, labelled, y)
        losses.append(float(now[0].mean()))
        if losses[-1] < best[0].mean() - 1e-4:
            best, turn = now, at
        idle = 0 if any(kept) else idle + 1
        if idle == 2:
            break
    return CoTrained(best[1], turn=turn, losses=tuple(losses))


def _standard(v: View, x: np.ndarray) -> np.ndarray:
    return np.hstack([(x - v.mean) / v.scale, np.ones((len(x), 1))])


def _curve(v: View, x: np.ndarray) -> np.ndarray:
    """The inverse of a bound of the curvature, the pseudo-labelled rows taken to spread as the labelled ones: steps by it cannot overshoot."""
    z = _standard(v, x)
    return np.linalg.inv(z.T @ z / 4 * (1 + PSEUDO) + np.diag(np.append(np.full(x.shape[1], RIDGE), 1e-6)))


def _losses(p: np.ndarray, y: np.ndarray) -> np.ndarray:
    return -np.log(np.where(y == 1, p, 1 - p).clip(1e-6, 1))


def _calibrated(teams: list[list[View]], part: np.ndarray, xs: list[np.ndarray], y: np.ndarray) -> tuple[np.ndarray, list[View], list[np.ndarray]]:
    """Calibrate the views by the logits of rows that they were not fitted on; each row's loss by both together, the folds' mean views, and each row's loss by each view."""
    logits, means = [], []
    for view, x in enumerate(xs):
        z = np.zeros(len(y))
        for k, views in enumerate(teams):
            z[part == k] = views[view].logit(x[part == k])
        slope, shift = map(float, logistic(z[:, None], y, ridge=1.0))
        weight = 1 / max(0.01, float(_losses(sigmoid(np.clip(slope * z + shift, -12, 12)), y).mean()))
        for views in teams:
            v = views[view]
            v.slope, v.shift, v.weight = slope, shift, weight
        bare = [np.append(v[view].coef[:-1] / v[view].scale, v[view].coef[-1] - (v[view].mean / v[view].scale) @ v[view].coef[:-1]) for v in teams]
        means.append(View(np.zeros(x.shape[1]), np.ones(x.shape[1]), np.mean(bare, axis=0), slope, shift, weight))
        logits.append(np.clip(slope * z + shift, -12, 12))
    total = sum(v.weight for v in means)
    each = _losses(sigmoid(sum(v.weight * z for v, z in zip(means, logits)) / total), y)
    return each, means, [_losses(sigmoid(z), y) for z in logits]


def _vectors(b: pa.RecordBatch) -> list[np.ndarray]:
    text, lang, source = (b.column(c).to_pylist() for c in ("text", "lang", "source"))
    m = [metadata_view(*row) for row in zip(text, lang, source)]
    return [text_views(text), np.vstack(m) if m else np.zeros((0, META_DIM), np.float32)]


def _typed(docs: DataFrame, *more: str) -> DataFrame:
    text_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[F.col(c).cast("string").alias(c) for c in ("text", "lang", "source")], *more)


def unlabelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The vectors (a, m: 16-bit numbers as bytes) of every distinct text, language and source without a label.

    Texts stay where they are read: ids and keys tell which keys have no label, and only vectors meet these.
    """

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 500):
                part = b.slice(i, 500)
                yield pa.RecordBatch.from_arrays([part.column("key"), *[pa.array([x.tobytes() for x in v.astype(np.float16)], pa.binary()) for v in _vectors(part)]], ["key", "a", "m"])

    rows = _typed(docs).withColumn("key", F.xxhash64("text", "lang", "source"))
    known = labels.select(F.col("doc_id").cast("long").alias("known")).distinct()
    free = rows.select("doc_id", "key").join(known, F.col("doc_id") == F.col("known"), "left_anti").select("key").distinct()
    every = rows.select("key", "text", "lang", "source").mapInArrow(released(vectors, forget), "key long, a binary, m binary").dropDuplicates(["key"])
    return written(every.join(free, "key", "left_semi").drop("key"), "quality-vectors")


def fit(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED, rounds: int = ROUNDS) -> CoTrained:
    """Co-train on at most ``most`` labelled rows, whose vectors reach the driver, and on all unlabelled ones."""

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 500):
                part = b.slice(i, 500)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("y"), *[pa.array([x.tobytes() for x in v], pa.binary()) for v in _vectors(part)]], ["doc_id", "y", "a", "m"])

    sample = labelled_sample(docs, labels, "quality", ("text", "lang", "source"), most)
    got = sorted(sample.mapInArrow(released(vectors, forget), "doc_id long, y int, a binary, m binary").collect(), key=lambda r: (zlib.crc32(str(r["doc_id"]).encode()), r["doc_id"]))
    y = np.array([float(r["y"] > 0) for r in got])
    known = [np.vstack([np.frombuffer(r[c], np.float32) for r in got] or [np.zeros((0, d), np.float32)]) for c, d in (("a", TEXT_DIM), ("m", META_DIM))]
    if len(y) < 10 or y.min() == y.max():
        return co_train(known, y, Pool([x[:0] for x in known]))
    return co_train(known, y, TablePool(unlabelled(docs, labels)), rounds)


def scored(docs: DataFrame, model: CoTrained) -> DataFrame:
    """doc_id, score."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 1000):
                part = b.slice(i, 1000)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(model.score(_vectors(part)), pa.float64())], ["doc_id", "score"])

    return _typed(docs).mapInArrow(released(of, forget), "doc_id long, score double")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = scored(docs, fit(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

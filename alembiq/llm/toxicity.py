"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton over folded text.

Folding lower-cases, strips accents and invisible characters, maps letters of other scripts that look
like Latin ones, reads digits and signs next to letters as the letters they stand for, takes three or more of one letter for one, and joins words
spelt letter by letter. Words cut by a hyphen, a point or the like are looked up joined, too. The lexicon holds word beginnings with weights: seed words, and words and beginnings that
labelled documents show to be toxic. Exception phrases cover lexicon words that are harmless in them: fixed ones, and pairs of a
lexicon word and its neighbour that only other labelled documents hold. The sum of the weights
found, over the logarithm of the length, becomes a score through a logistic fit.

Learning counts, for each word beginning, the distinct pairs of neighbouring words it is seen between
in toxic and in other documents; so copies and near copies of a document count once. A beginning of SHORTEST to LONGEST letters, or
a word of any length as a whole, is kept where so many of its contexts could not be toxic by chance. Contexts are counted
in tables, so texts of any length take part, and for text with accents, which folding removes, as it stands, too.

Defined results: null and empty texts have no matches and the lowest score; labels of rows whose
crc32(doc_id) mod 3 is 1 are never read; without labels the seed lexicon and a fixed curve score;
repeated rows are scored alike; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import released, table, text_batches, written
from .learning import MAX_LABELLED, held_out, labelled_sample, logistic, sigmoid

#: Seed words (fixed values), each with this weight.
SEEDS = ("asshole", "bastard", "bitch", "disgusting", "dumbass", "idiot", "imbecile", "loser", "moron", "pathetic", "retard", "scum", "shithead", "stupid", "vermin", "worthless")
SEED_WEIGHT = 4.0
#: Phrases in which lexicon words are harmless (fixed values).
EXCEPTIONS = ("class clown", "clown fish", "pathetic fallacy", "pond scum", "sore loser rule", "trash bag", "trash bin", "trash can")
#: Letters that look like Latin ones (fixed values): Cyrillic, then Greek, Armenian and Cherokee.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "γ": "y", "ω": "w",
    "ց": "g", "հ": "h", "ո": "n", "օ": "o", "զ": "q", "ս": "u",
    "Ꭺ": "a", "Ᏼ": "b", "Ꮯ": "c", "Ꭰ": "d", "Ꭼ": "e", "Ꮐ": "g", "Ꮋ": "h", "Ꭻ": "j", "Ꮶ": "k", "Ꮮ": "l", "Ꮇ": "m", "Ꮲ": "p", "Ꭱ": "r", "Ꮪ": "s", "Ꭲ": "t", "Ꮩ": "v", "Ꮃ": "w", "Ꮍ": "y", "Ꮓ": "z",
}
#: Digits and signs that stand for letters (fixed values).
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "i"}
#: Shortest and longest word beginnings that are learned; words as a whole have any length.
SHORTEST, LONGEST = 4, 12
#: Contexts in toxic documents that a learned word has at least, and the share of these that it may have in others;
#: and the chance that any one word is learned that says nothing.
LEAST, MIXED, CHANCE = 4, 0.25, 0.002

_LETTER_NAME = re.compile(r"(?:LATIN|REGIONAL INDICATOR SYMBOL|NEGATIVE (?:CIRCLED|SQUARED) LATIN)(?: SMALL| CAPITAL)? LETTER(?: SMALL CAPITAL)? ([A-Z])(?: WITH .*)?")


def _named_letters() -> dict[str, str]:
    """Forms of Latin letters that normalising leaves as they are, by their names: small capitals, letters in boxes, letters with strokes and hooks."""
    found = ((chr(i), _LETTER_NAME.fullmatch(unicodedata.name(chr(i), ""))) for i in (*range(0x100, 0x2B0), *range(0x1D00, 0x1DC0), *range(0x2C60, 0x2C80), *range(0xA720, 0xA800), *range(0x1F130, 0x1F200)))
    return {c.lower(): m[1].lower() for c, m in found if m and not unicodedata.decomposition(c)}


_FOLD = str.maketrans(_named_letters() | {k.lower(): v for k, v in HOMOGLYPHS.items()})
_SIGNS = str.maketrans(SUBSTITUTES)
_SIGN_RUN = re.compile("[" + re.escape("".join(SUBSTITUTES)) + "]+")
#: An exclamation mark after a word ends it, and stands for no letter.
_END_SIGNS = str.maketrans({k: v for k, v in SUBSTITUTES.items() if k != "!"})
#: Words spelt letter by letter (with spaces, four letters or more), and what every text that holds one has.
_SPELT, _SPELT_PART = re.compile(r"(?<![^\W_])[a-z](?:(?:[.*_-][a-z]){2,}|(?: [a-z]){3,})(?![^\W_])"), re.compile("[.*_-][a-z][.*_-]| [a-z] [a-z] ")
#: Words cut by marks, and three or more of one letter.
_CUT, _CUT_PART = re.compile(r"(?<![^\W\d_])[^\W\d_]++(?:[.*_-][^\W\d_]++)+"), re.compile(r"[.*_-][^\W\d_]")
_STRETCHED, _TRIPLES = re.compile(r"([a-z])\1{2,}"), [chr(c) * 3 for c in range(97, 123)]
_HIDDEN = re.compile("[̀-ͯ­​-‏⁠﻿]+")
_NOT_WORD = re.compile(r"[\W_]+")
#: 1, i and l stand for each other.
_SAME = str.maketrans("l", "i")


def _letters(m: re.Match) -> str:
    """A run of signs as letters, if it stands next to one."""
    s, (a, b) = m.string, m.span()
    if b < len(s) and s[b].isalpha():
        return m[0].translate(_SIGNS)
    return m[0].translate(_END_SIGNS) if a and s[a - 1].isalpha() else m[0]


def folds(text: str | None) -> tuple[str, str | None]:
    """Folded words, each with a space before it and one space at the end: without accents, and with them (null if there is none)."""
    return _folded(text)[:2]


def _folded(text: str | None) -> tuple[str, str | None, list[str]]:
    """What ``folds`` gives, and the words cut by marks, folded, with their marks."""
    s = (text or "").lower()
    plain = s.isascii()
    if not plain:
        s = _HIDDEN.sub("", unicodedata.normalize("NFKC", s).lower()).translate(_FOLD)
    s = _SIGN_RUN.sub(_letters, s)
    if _SPELT_PART.search(s):
        s = _SPELT.sub(lambda m: m[0][::2], s)
    if any(x in s for x in _TRIPLES):
        s = _STRETCHED.sub(r"\1", s)
    cut = _CUT.findall(s) if _CUT_PART.search(s) else []
    s = " " + _NOT_WORD.sub(" ", s).strip().translate(_SAME) + " "
    if plain or s.isascii():
        return s, None, cut
    return _bare(s), s, [_bare(x) for x in cut]


def _bare(s: str) -> str:
    """Folded text without its accents."""
    return _HIDDEN.sub("", unicodedata.normalize("NFKD", s)).translate(_FOLD).translate(_SAME)


def fold(text: str | None) -> str:
    """Folded words without accents."""
    return folds(text)[0]


@dataclass(frozen=True)
class Lexicon:
    """Folded words with weights, exception phrases, and the curve that makes a score of the normalised sum.

    A word stands for all words that begin with it; with ``+`` at its end for longer ones only, and with
    a space at its end for itself alone. An exception phrase between spaces is folded already. Words with accents are looked for in text that keeps them.
    """

    words: tuple[tuple[str, float], ...]
    exceptions: tuple[str, ...] = EXCEPTIONS
    slope: float = 3.0
    intercept: float = -3.0

    def automata(self) -> tuple[ahocorasick.Automaton, ahocorasick.Automaton | None]:
        """For text without accents, and for text with them (none if no word has any)."""
        if self not in _automata:
            _automata.clear()
            found: list[dict[str, list]] = [{}, {}]
            for word, weight in self.words:
                longer = word.endswith("+")
                entry = found[not word.isascii()].setdefault(f" {word.removesuffix('+')}", [len(word) + 1 - longer, 0.0, 0.0])
                entry[1 + longer] = max(entry[1 + longer], weight)
            for phrase in self.exceptions:
                folded = phrase if phrase.startswith(" ") else fold(phrase)
                found[0][folded] = [len(folded), None, None]
            made = []
            for entries in found:
                a = ahocorasick.Automaton()
                for key, value in entries.items():
                    a.add_word(key, tuple(value))
                if entries:
                    a.make_automaton()
                made.append(a if entries else None)
            _automata[self] = tuple(made)
        return _automata[self]

    def strength(self, text: str | None) -> tuple[float, int]:
        """Sum of the weights over the logarithm of the length, and the number of matches."""
        plain, accented = self.automata()
        folded, kept, cut = _folded(text)
        weights = _matched(plain, folded)
        for word in cut:  # joined, where no piece is a match by itself
            joined = _matched(plain, " " + _NOT_WORD.sub("", word).translate(_SAME) + " ")
            if joined and not any(_matched(plain, f" {x} ") for x in _NOT_WORD.sub(" ", word).translate(_SAME).split()):
                weights += joined
        if accented is not None and kept is not None:
            weights += _matched(accented, kept)
        return sum(weights) / (1 + math.log1p(folded.count(" ") / 200)), len(weights)


def _matched(automaton: ahocorasick.Automaton | None, folded: str) -> list[float]:
    """The weight of each word that is found, the largest where several entries fit, and none inside an exception phrase."""
    if automaton is None:
        return []
    ends, spared = {}, []
    for end, (n, weight, longer) in automaton.iter(folded):
        start = end - n + 1
        if weight is None:
            spared.append((start, end))
            continue
        if longer > weight and folded[end + 1] != " ":
            weight = longer
        if weight:
            ends[start] = max(ends.get(start, 0.0), weight)
    at, out = 0, []
    for start, weight in sorted(ends.items()):
        while at < len(spared) and spared[at][1] <= start:
            at += 1
        if not (at < len(spared) and spared[at][0] <= start < spared[at][1]):
            out.append(weight)
    return out


_automata: dict[Lexicon, tuple] = {}


def contexts(text: str | None) -> set[tuple[str, int]]:
    """Each word, a space at its end, with the pair of its neighbours as a number.

    Words with accents are given without them and with them.
    """
    out = set()
    folded, kept = folds(text)
    for words in (folded, kept or ""):
        w = words.split()
        for before, word, after in zip(["", *w], w, [*w[1:], ""]):
            if words is folded or not word.isascii():
                out.add((f"{word} ", zlib.crc32(f"{before} {after}".encode())))
    return out


def learned_words(sample: DataFrame) -> dict[str, float]:
    """Words of toxic documents for a lexicon, with the logarithm of their odds as weight. ``sample``: text, y.

    The contexts of whole texts are counted in tables, for each word and for each beginning of longer
    words; the driver gets the counts of those that toxic documents hold far more often than chance
    allows. Of a beginning and its continuations the one that tells most is taken.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for text, y in zip(b.column("text"), b.column("y").to_pylist()):
                found = list(zip(*contexts(text.as_py())))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(found[0], pa.string()), pa.array(found[1], pa.int64()), pa.array([y > 0] * len(found[0]))], ["word", "context", "toxic"])

    n, n_toxic = sample.agg(F.count("*"), F.count_if(F.col("y") > 0)).first()
    if not n_toxic or n_toxic == n:
        return {}
    words = written(sample.select("text", "y").mapInArrow(released(of), "word string, context long, toxic boolean").distinct(), "toxic-contexts")
    # A beginning goes on, so a word itself is none.
    ends = F.least(F.char_length("word") - 2, F.lit(LONGEST))
    beginnings = F.transform(F.filter(F.sequence(F.lit(SHORTEST), F.greatest(ends, F.lit(SHORTEST))), lambda i: i <= ends), lambda i: F.concat(F.substring("word", F.lit(1), i), F.lit("+")))
    each = words.select("context", "toxic", F.explode(F.array_append(beginnings, F.col("word"))).alias("p"))
    counted = lambda rows: rows.distinct().groupBy("p").agg(F.count("*").alias("n"))
    seen = written(counted(each.where("toxic").select("p", "context")), "toxic-beginnings")
    share = max(0.02, min(0.5, n_toxic / n))
    wanted = seen.where(F.col("n") >= LEAST)
    clean = counted(each.where("NOT toxic").join(wanted.select("p"), "p", "left_semi").select("p", "context")).withColumnRenamed("n", "clean")
    both = wanted.join(clean, "p", "left").select("p", "n", F.coalesce("clean", F.lit(0)).alias("c"))
    tells = F.col("n") * F.log(F.col("n") / ((F.col("n") + F.col("c")) * share)) + F.when(F.col("c") > 0, F.col("c") * F.log(F.col("c") / ((F.col("n") + F.col("c")) * (1 - share)))).otherwise(0.0)
    limit = math.log(max(1, seen.count()) / CHANCE)
    found = both.withColumn("tells", tells).where((F.col("c") <= MIXED * F.col("n")) & (F.col("tells") >= limit)).collect()
    counts, out = {r["p"]: (r["n"], r["c"]) for r in found}, {}
    following: dict[str, list[str]] = {}  # by all letters but the last one
    for p in counts:
        following.setdefault(p[:-2], []).append(p)
    for r in sorted(found, key=lambda r: (-r["tells"], r["p"])):
        p, stem = r["p"], r["p"].rstrip("+ ")
        before = {stem[:i] + "+" for i in range(SHORTEST, len(stem) + (p != stem + "+"))}
        if before & out.keys() or stem in out or (p.endswith("+") and any(q.startswith(stem) and q != stem + " " for q in out)):
            continue
        # A longer beginning of nearly the same contexts stands for a shorter one, down to the word itself.
        whole = False
        while p.endswith("+") and (more := [q for q in following.get(p[:-1], []) if counts[q][0] >= 0.95 * counts[p][0]]):
            p, whole = more[0], more[0].endswith(" ")
        m, c = counts[p]
        out[p.rstrip() if whole else p] = math.log((m + 0.5) / (c + 0.5))
    # An accented word adds nothing to its own letters without accents.
    bare = lambda p: "".join(x for x in unicodedata.normalize("NFKD", p) if not unicodedata.combining(x))
    return {p: x for p, x in out.items() if p.isascii() or not any(bare(p).startswith(q.rstrip("+ ")) for q in out if q.isascii())}


def learned_exceptions(sample: DataFrame, lexicon: Lexicon) -> list[str]:
    """Pairs of a lexicon word and a neighbour that only other documents than toxic ones hold. ``sample``: text, y.

    Such a pair has at least LEAST contexts, more than so many matches of the lexicon would be clean by chance. Words the
    lexicon does not match, and pairs that it spares already, are left out, so the driver gets few.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain = lexicon.automata()[0]
        for b in batches:
            for text, y in zip(b.column("text"), b.column("y").to_pylist()):
                w = folds(text.as_py())[0].split()
                known = {x: bool(_matched(plain, f" {x} ")) for x in set(w)}
                found = set()
                for i, x in enumerate(w):
                    if known[x]:
                        for a in (i - 1, i):
                            pair = w[a : a + 2] if a >= 0 else []
                            if len(pair) == 2 and _matched(plain, f" {pair[0]} {pair[1]} "):
                                around = " ".join([*w[max(0, a - 1) : a], "|", *w[a + 2 : a + 3]])
                                found.add((f" {pair[0]} {pair[1]} ", zlib.crc32(around.encode())))
                if found:
                    phrases, around = zip(*sorted(found))
                    yield pa.RecordBatch.from_arrays([pa.array(phrases, pa.string()), pa.array(around, pa.int64()), pa.array([y > 0] * len(found))], ["phrase", "context", "toxic"])

    if not lexicon.words:
        return []
    seen = written(sample.select("text", "y").mapInArrow(released(of), "phrase string, context long, toxic boolean").distinct(), "toxic-phrases")
    n, toxic, kinds = seen.agg(F.count("*"), F.count_if("toxic"), F.approx_count_distinct("phrase")).first()
    if not n or toxic == n:
        return []
    least = max(LEAST, math.log(max(1, kinds) / CHANCE) / -math.log(max(1, n - toxic) / n)) if toxic else LEAST
    found = seen.groupBy("phrase").agg(F.count("*").alias("n"), F.count_if("toxic").alias("bad")).where((F.col("bad") == 0) & (F.col("n") >= least))
    return sorted(r["phrase"] for r in found.select("phrase").collect())


def fit(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> Lexicon:
    """The lexicon and score curve learned from at most ``most`` labelled documents, of whose whole texts counts and strengths reach the driver."""
    sample = written(labelled_sample(docs, labels, "toxic", most=most), "toxic-sample")
    words = {w.translate(_SAME): SEED_WEIGHT for w in SEEDS} | learned_words(sample)
    lexicon = Lexicon(tuple(sorted(words.items())))
    lexicon = Lexicon(lexicon.words, (*EXCEPTIONS, *learned_exceptions(sample, lexicon)))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("y"), pa.array([lexicon.strength(t.as_py())[0] for t in b.column("text")], pa.float64())], ["y", "strength"])

    got = sample.select("y", "text").mapInArrow(released(of), "y int, strength double").collect()  # at most ``most`` rows of two numbers
    y = np.array([r["y"] > 0 for r in got], bool)
    if y.all() or not y.any():
        return lexicon
    slope, intercept = logistic(np.array([[r["strength"]] for r in sorted(got)]), np.array([float(r["y"] > 0) for r in sorted(got)]), ridge=1e-3)
    return Lexicon(lexicon.words, lexicon.exceptions, float(slope), float(intercept))


def scored(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """doc_id, score, n_hits."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [lexicon.strength(t.as_py()) for t in b.column("text")]
            score = sigmoid(lexicon.slope * np.array([f[0] for f in found], float) + lexicon.intercept)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(score, pa.float64()), pa.array([f[1] for f in found], pa.int64())], ["doc_id", "score", "n_hits"])

    text_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(released(of), "doc_id long, score double, n_hits long")


def clean_documents(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, with their columns; one pass, no join."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(sigmoid(lexicon.slope * np.array([lexicon.strength(t)[0] for t in texts], float) + lexicon.intercept))

    text_batches(docs.sparkSession)
    return docs.where(score(F.col("text").cast("string")) < threshold)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = scored(docs, fit(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "n_hits")

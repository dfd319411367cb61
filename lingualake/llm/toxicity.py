"""Toxicity: a weighted lexicon matched by Aho-Corasick over folded text.

Folding lower-cases, drops accents and zero-width characters, maps look-alike letters of other
scripts and digits used as letters to one Latin class, and turns everything else into spaces. The
lexicon is learned from labelled rows: words, and word beginnings of MIN_STEM or more characters,
whose presence marks toxic documents; pairs of words in which an entry is harmless become
exception phrases, and hits inside one don't count. The weights of the hits are set against the
length of the text, and a logistic curve fitted on the same rows makes a score from 0 to 1.

Only a bounded sample of labelled rows is learned from (`max_rows`, chosen by a hash of the id);
every document is scored in one pass without a shuffle.

Edge cases: null and empty texts have no hits and get the score of a clean text; repeated rows are
scored each; rows without a label or with a null one teach nothing; without labelled rows of both
kinds every score is 0. Extra columns, whatever their names, are left out of the result.
"""

from __future__ import annotations

import math
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bounded_batches, discard, given_back, text_of, written

MIN_STEM, MAX_STEM = 4, 12

# Letters of other scripts that look like Latin ones.
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h", "ӏ": "l", "к": "k", "м": "m", "т": "t", "н": "h", "в": "b", "г": "r", "п": "n", "и": "u",
    "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "η": "n", "ω": "w", "γ": "y", "σ": "o", "μ": "u",
    "ı": "i", "ł": "l", "ø": "o", "đ": "d", "ħ": "h", "ß": "ss", "æ": "ae", "œ": "oe", "ſ": "s", "ɑ": "a", "ɡ": "g", "ɩ": "i", "ʟ": "l", "ᴏ": "o",
}
# Digits and signs that stand for letters.
SIGNS = {"0": "o", "1": "i", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "€": "e", "|": "i"}
#: l, i and 1 can't be told apart in folded text, so they share a letter.
SAME = {"l": "i"}


class Folding(dict):
    """Code points to folded strings, worked out when first met."""

    def __missing__(self, code: int) -> str:
        c = chr(code).lower()
        out = []
        for x in unicodedata.normalize("NFKD", LOOKALIKES.get(c, c)):
            x = LOOKALIKES.get(x, SIGNS.get(x, x))
            kind = unicodedata.category(x[0])
            if kind[0] == "M" or kind == "Cf":
                continue
            out.append("".join(SAME.get(y, y) for y in x) if kind[0] == "L" else " ")
        value = self[code] = "".join(out)
        return value


_FOLD = Folding()


def fold(text: str) -> str:
    """Folded words, each followed by a space, after a first space."""
    return f" {' '.join(text.translate(_FOLD).split())} "


@dataclass
class Lexicon:
    """Entries `word ` (whole words) and `word` (beginnings) with weights; phrases whose hits don't count; the curve."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: set[str] = field(default_factory=set)
    curve: tuple[float, ...] = ()

    def automaton(self):
        import ahocorasick

        a = ahocorasick.Automaton()
        for entry, w in self.weights.items():
            a.add_word(f" {entry}", (len(entry), w))
        for phrase in self.exceptions:
            if f" {phrase} " not in a:
                a.add_word(f" {phrase} ", (len(phrase), None))
        if len(a):
            a.make_automaton()
        return a


def hits(folded: str, automaton) -> list[tuple[int, float]]:
    """Places and weights of hits outside of exception phrases; at one place the heaviest entry counts."""
    found: dict[int, float] = {}
    free: list[tuple[int, int]] = []
    for end, (size, w) in automaton.iter(folded) if len(automaton) else ():
        if w is None:
            free.append((end - size, end))
        else:
            start = end - size + 1
            found[start] = max(w, found.get(start, w))
    # One sweep: hits and phrases in order of their beginnings, with how far the phrases met so far reach.
    free.sort()
    out, k, reach = [], 0, -1
    for p, w in sorted(found.items()):
        while k < len(free) and free[k][0] <= p:
            reach = max(reach, free[k][1])
            k += 1
        if p > reach:
            out.append((p, w))
    return out


def features(folded: str, automaton) -> tuple[float, float]:
    """The weight of the hits by length, and in all, both on a log scale."""
    total = sum(w for _, w in hits(folded, automaton))
    return math.log1p(1000 * total / max(1, folded.count(" ") - 1)), math.log1p(total)


def _entries(folded: str) -> set[str]:
    out = set()
    for w in set(folded.split()):
        out.add(f"{w} ")
        out.update(w[:n] for n in range(MIN_STEM, min(MAX_STEM, len(w)) + 1))
    return out


def _counted(key: str, what):
    """The weight of the rows of each label that hold each entry, summed in the task."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: list[dict[str, float]] = [defaultdict(float), defaultdict(float)]
        for b in batches:
            for text, toxic, weight in zip(*(b.column(c).to_pylist() for c in ("text", "toxic", "weight")), strict=True):
                for k in what(fold(text)):
                    n[toxic][k] += weight
        keys = list(n[0].keys() | n[1].keys())
        counts = [pa.array([x.get(k, 0.0) for k in keys], pa.float64()) for x in n]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *counts], [key, "n0", "n1"])

    return counted


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Newton's method with a small ridge, classes weighing the same."""
    x = np.column_stack([np.ones(len(x)), x])
    of = [max(1e-9, weight[y == k].sum()) for k in (0, 1)]
    share = weight * np.where(y == 1, 0.5 / of[1], 0.5 / of[0]) * weight.sum()
    b = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        g = x.T @ (share * (y - p)) - ridge * b
        h = (x * (share * p * (1 - p))[:, None]).T @ x + (ridge + 1e-9) * np.eye(len(b))
        b = b + np.linalg.solve(h, g)
    return b


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, min_weight: float = 3.0, min_sure: float = 2.0, min_share: float = 0.004) -> Lexicon:
    """Learn from labels (doc_id, toxic) and the texts of docs.

    max_rows: labelled rows that are learned from, about; it bounds what is broadcast and collected.
    min_weight: log odds from which an entry counts; min_sure: their lower bound; min_share: of the
    weight of toxic rows that must hold it. Every entry and phrase that passes is kept.
    """
    n = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.col("toxic").cast("long")), F.lit(0)).alias("t")).first()
    n1, n0 = int(n["t"]), int(n["n"]) - int(n["t"])
    if not n1 or not n0:
        return Lexicon()
    part = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) / 1_000_000
    share = F.when(F.col("toxic") == 1, F.lit(min(1.0, max_rows / 3 / n1))).otherwise(F.lit(min(1.0, max_rows * 2 / 3 / n0)))
    chosen = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").filter(part < share).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    # At most about max_rows rows of two numbers: the broadcast has this bound.
    sample = text_of(docs.filter("text IS NOT NULL"), "doc_id").join(F.broadcast(chosen), "doc_id").select("text", "toxic")
    # Near copies would count their rare words again and again: rows of one label that share their least word triple weigh
    # one row together. None is left out, and rows of different labels never share a weight.
    triple = F.expr("array_min(transform(sequence(0, greatest(0, size(w) - 3)), i -> xxhash64(slice(w, i + 1, 3))))")
    sample = sample.withColumn("w", F.split("text", " ")).withColumn("k", triple).drop("w")
    train = written(sample.withColumn("weight", 1 / F.count(F.lit(1)).over(Window.partitionBy("k", "toxic"))).drop("k"), "labelled")
    try:
        return _learned(train, min_weight, min_sure, min_share)
    finally:
        discard(train)


def _learned(train: DataFrame, min_weight: float, min_sure: float, min_share: float) -> Lexicon:
    """A lexicon from train (text, toxic, weight), a bounded sample."""
    bounded_batches(train.sparkSession)
    kinds = {r["toxic"]: r["n"] for r in train.groupBy("toxic").agg(F.sum("weight").alias("n")).collect()}
    n0, n1 = kinds.get(0, 0), kinds.get(1, 0)
    if not n0 or not n1:
        return Lexicon()
    counts = "n0 double, n1 double"
    least = max(3, math.ceil(min_share * n1)) - 1e-6
    toxic = train.filter("toxic = 1").mapInArrow(_counted("entry", _entries), f"entry string, {counts}")
    in_toxic = {r["entry"]: r["n1"] for r in toxic.groupBy("entry").agg(F.sum("n1").alias("n1")).filter(F.col("n1") >= least).orderBy("entry").collect()}
    known = set(in_toxic)
    clean = train.filter("toxic = 0").mapInArrow(_counted("entry", lambda t: _entries(t) & known), f"entry string, {counts}")
    in_clean = {r["entry"]: r["n0"] for r in clean.groupBy("entry").agg(F.sum("n0").alias("n0")).collect()}
    odds = {e: math.log((k + 0.5) / (n1 + 1)) - math.log((in_clean.get(e, 0) + 0.5) / (n0 + 1)) for e, k in in_toxic.items()}
    # What is left of the odds 1.64 standard errors below, so that a few rows prove nothing.
    sure = {e: odds[e] - 1.64 * math.sqrt(1 / (in_toxic[e] + 0.5) + 1 / (in_clean.get(e, 0) + 0.5)) for e in odds}
    good = {e for e in odds if odds[e] >= min_weight and sure[e] >= min_sure}
    # Of beginnings that the same documents hold the longest is kept: it says the same and errs less.
    longer = {e[:-1] for e in good if not e.endswith(" ") and e[:-1] in good and in_toxic[e] >= 0.97 * in_toxic[e[:-1]]}
    weights: dict[str, float] = {}
    for e in sorted(good - longer, key=lambda e: (len(e), e)):
        stems = [e[:i] for i in range(MIN_STEM, len(e)) if e[:i] in weights]
        if not any(weights[s] >= odds[e] - 0.7 for s in stems):
            weights[e] = odds[e]
    if not weights:
        return Lexicon()
    lexicon = Lexicon(weights)

    def pairs(folded: str) -> set[str]:
        at, words = 1, folded.split()  # folded text begins with a space
        starts = {}
        for i, w in enumerate(words):
            starts[at] = i
            at += len(w) + 1
        out = set()
        for p, _ in hits(folded, automaton):
            i = starts.get(p)
            if i is not None:
                out.update(" ".join(words[a : a + 2]) for a in (i - 1, i) if a >= 0 and a + 2 <= len(words))
        return out

    automaton = lexicon.automaton()
    phrases = train.mapInArrow(_counted("phrase", pairs), f"phrase string, {counts}").groupBy("phrase").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    lexicon.exceptions = {r["phrase"] for r in phrases.filter((F.col("n0") >= 3 - 1e-6) & (F.col("n0") / n0 > F.col("n1") / n1)).collect()}
    automaton = lexicon.automaton()

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [features(fold(t), automaton) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([v[0] for v in x], pa.float64()), pa.array([v[1] for v in x], pa.float64()), b.column("toxic"), b.column("weight")], ["a", "b", "toxic", "weight"])

    m = np.array([tuple(r) for r in train.mapInArrow(measured, "a double, b double, toxic int, weight double").collect()], dtype=float)
    curve = _logistic(m[:, :2], m[:, 2], m[:, 3])
    curve[0] = min(curve[0], -0.1)  # a text without hits is clean
    lexicon.curve = tuple(curve)
    return lexicon


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """docs (doc_id, text) to doc_id, n_words, n_hits, score; one pass, no shuffle."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for b in batches:
            words, n_hits, scores = [], [], []
            for text in b.column("text").to_pylist():
                folded = fold(text)
                found = hits(folded, automaton)
                total, n = sum(w for _, w in found), max(1, folded.count(" ") - 1)
                c = lexicon.curve
                z = c[0] + c[1] * math.log1p(1000 * total / n) + c[2] * math.log1p(total) if c else -math.inf
                words.append(len(folded.split()))
                n_hits.append(len(found))
                scores.append(1 / (1 + math.exp(-min(60.0, z))) if z > -700 else 0.0)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(words, pa.int64()), pa.array(n_hits, pa.int64()), pa.array(scores, pa.float64())], ["doc_id", "n_words", "n_hits", "score"])

    bounded_batches(docs.sparkSession)
    return text_of(docs, F.col("doc_id").cast("long").alias("doc_id")).mapInArrow(given_back(scored), "doc_id long, n_words long, n_hits long, score double")


def reject(spark: SparkSession, docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """docs without the rows that score `threshold` or more; columns and kept rows are unchanged."""
    lexicon = fit(docs, labels)
    columns = docs.columns

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        c = lexicon.curve
        at = columns.index("text")
        for b in batches:
            keep = []
            for text in b.column(at).to_pylist():
                f = features(fold(text or ""), automaton) if c else None
                keep.append(f is None or 1 / (1 + math.exp(-max(-60.0, min(60.0, c[0] + c[1] * f[0] + c[2] * f[1])))) < threshold)
            yield b.filter(pa.array(keep, pa.bool_()))

    bounded_batches(spark)
    return docs.mapInArrow(given_back(kept), docs.schema)

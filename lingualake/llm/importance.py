"""Importance resampling towards a target: hashed n-gram counts of both corpora give each document a weight, and the
documents with the highest weight plus Gumbel noise are drawn.

Long texts are the skew, so a text above `limit` bytes is cut at word boundaries into chunks that are dealt out as rows.
A chunk owns the features that start in it and carries the n - 1 words behind it, so that each feature is counted once
and none is lost at a cut. Each chunk becomes a sparse vector (bucket, count), which is written; the counts of all
chunks are summed to the corpus, then each chunk's weight is worked out and summed by document. Texts are read once.
What goes to every task are the gains, one number for each bucket.

The draw is a sort over all partitions, with ranks by the partitions' sizes; no task sees more than its share.

Edge cases: null and empty texts have no features and the weight 0; a word of any length is one word; repeated rows and
rows with one id are documents each, and noise goes by the id, so equal rows have equal scores; null ids are hashed as
an empty text and stand behind others among ties; extra columns are left out; an empty table has no rows, an empty
target gives all buckets the same start.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, given_back, numbered, pieces, written
from .licenses import words_of

BUCKETS, PERCENT, LEAST_WORDS, SEED, LIMIT = 10_000, 10, 20, 2024, 1 << 16

# What stands between words, as a character class, before letters are lower-cased.
GAP = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"

VECTOR = "row long, doc_id long, n_words long, n_features long, buckets array<int>, counts array<int>"


class Buckets(dict):
    """Features to buckets, with a bounded memory of features seen."""

    LIMIT = 300_000

    def __init__(self, n: int):
        super().__init__()
        self.n = n

    def __missing__(self, feature: str) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[feature] = zlib.crc32(feature.encode()) % self.n
        return value


def features_of(own: list[str], tail: list[str], n: int) -> list[str]:
    """Runs of 1 to n words that start in own; tail holds words behind it."""
    if n == 1:
        return own
    words = own + tail[: n - 1]
    return [" ".join(words[i : i + k]) for k in range(1, n + 1) for i in range(min(len(own), len(words) - k + 1))]


def vectors(docs: DataFrame, n: int = 1, buckets: int = BUCKETS, limit: int = LIMIT) -> DataFrame:
    """docs (doc_id, text) as a sparse vector for each chunk: row (a number of the document), doc_id, n_words, n_features, buckets, counts."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    short = rows.filter(F.octet_length("text") <= limit).select("row", "doc_id", F.col("text").alias("own"), F.lit("").alias("tail"))
    long = rows.filter(F.octet_length("text") > limit).select("row", "doc_id", F.explode(pieces(F.col("text"), GAP, limit, after=n - 1)).alias("c"))
    dealt = long.select("row", "doc_id", "c.piece", "c.own", "c.tail").repartition("row", "piece").drop("piece")

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket_of = Buckets(buckets)
        for b in batches:
            n_words, n_features, ends, at, many = [], [], [0], [], []
            for own, tail in zip(b.column("own").to_pylist(), b.column("tail").to_pylist(), strict=True):
                words = words_of(own)
                found = features_of(words, words_of(tail) if tail else [], n)
                counted = Counter(found)
                keys = np.fromiter(map(bucket_of.__getitem__, counted), np.int64, len(counted))
                sums = np.fromiter(counted.values(), np.int64, len(counted))
                order = np.argsort(keys, kind="stable")
                keys, sums = keys[order], sums[order]
                first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else keys
                at.append(keys[first])
                many.append(np.add.reduceat(sums, first) if len(first) else sums)
                ends.append(ends[-1] + len(first))
                n_words.append(len(words))
                n_features.append(len(found))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*x, np.empty(0, np.int64)]).astype(np.int32))) for x in (at, many)]
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_features, pa.int64()), *lists], ["row", "doc_id", "n_words", "n_features", "buckets", "counts"])

    bounded_batches(docs.sparkSession)
    return short.unionByName(dealt).mapInArrow(given_back(made), VECTOR)


def _flat(b: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    c = b.column(b.schema.get_field_index(name))
    return c.values.to_numpy(zero_copy_only=False), c.offsets.to_numpy()


def counts(found: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """Features of a corpus in each bucket: summed in the tasks, then over them; a number for each bucket."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            (keys, ends), (many, _) = _flat(b, "buckets"), _flat(b, "counts")
            part = slice(ends[0], ends[-1])
            total += np.bincount(keys[part], many[part], buckets).astype(np.int64)
        here = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(here, pa.int64()), pa.array(total[here], pa.int64())], ["bucket", "n"])

    rows = found.select("buckets", "counts").mapInArrow(summed, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = [0] * buckets
    for r in rows:
        out[r["bucket"]] = r["n"]
    return out


def gains(source: list[int], target: list[int]) -> list[int]:
    """What a feature of each bucket adds to a weight: a thousand times the log ratio of its smoothed shares, rounded down."""
    n, every, wanted = len(source), float(sum(source)), float(sum(target))
    return [math.floor(1000 * math.log((t + 1.0) * (every + n) / ((s + 1.0) * (wanted + n)))) for s, t in zip(source, target, strict=True)]


def weights(found: DataFrame, gain: list[int]) -> DataFrame:
    """Vectors to row, doc_id, n_words, n_features, weight: those of a document's chunks summed."""

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.array(gain, np.int64)
        for b in batches:
            (keys, ends), (many, _) = _flat(b, "buckets"), _flat(b, "counts")
            upto = np.concatenate(([0], np.cumsum(table[keys] * many)))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(4)), pa.array(upto[ends[1:]] - upto[ends[:-1]], pa.int64())], ["row", "doc_id", "n_words", "n_features", "weight"])

    each = found.mapInArrow(weighed, "row long, doc_id long, n_words long, n_features long, weight long")
    return each.groupBy("row").agg(F.first("doc_id").alias("doc_id"), *[F.sum(c).alias(c) for c in ("n_words", "n_features", "weight")])


def resample(docs: DataFrame, target: DataFrame, n: int = 1, buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, limit: int = LIMIT) -> DataFrame:
    """docs and target (text) to doc_id, n_words, n_features, weight, score, rank (from 1; null where not drawn)."""
    found = written(vectors(docs, n, buckets, limit), "feature-vectors")
    wanted = vectors(target.select(F.lit(None).alias("doc_id"), "text"), n, buckets, limit)
    rows = weights(found, gains(counts(found, buckets), counts(wanted, buckets)))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = rows.select("*", (F.col("weight") + noise).alias("score"), F.when(F.col("n_words") >= least_words, "long").otherwise("short").alias("kind"))
    placed = numbered(written(scored, "scores"), "kind", [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row")])
    drawn = (F.col("kind") == "long") & (F.col("at") < F.expr(f"{percent} * of div 100"))
    return placed.select("doc_id", "n_words", "n_features", "weight", "score", F.when(drawn, F.col("at") + 1).alias("rank"))

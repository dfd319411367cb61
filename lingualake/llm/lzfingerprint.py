"""Document fingerprints: minimum-hash signatures of Lempel-Ziv phrase sets.

A text is parsed from the left into phrases: each is the shortest string that isn't in the
dictionary yet, and joins it (LZ78). The set of phrases stands for what a compressor would learn of
the text; the likeness of two texts is the Jaccard similarity of their sets, estimated from the
SIGNATURE smallest hashes of each (exact for sets no larger). A fingerprint is those hashes in
ascending order, eight hexadecimal digits each.

To compare a document with the one of the next id, ids are cut into ranges, rows are dealt out by
range, and the first document of each range goes to the range before as well; texts cross the
network once. The edited text shares its beginning with the document, so the parse of that is used
for both.

Edge cases: a null or empty text has the empty fingerprint; two empty ones are alike (1), an empty
and another aren't (0). Rows with one doc_id are ordered by text; null ids come first. A single
document is its own next one. Extra columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, given_back, id_ranges, mix64, partitions_for, text_of

SIGNATURE = 128

_BASE = 0x9E3779B97F4A7C15
_POWERS = np.ones(1, np.uint64)
_INVERSE = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse mod 2**64, up to n."""
    global _POWERS, _INVERSE
    if len(_POWERS) <= n:
        size = max(1 << 12, 1 << n.bit_length())
        back = pow(_BASE, -1, 1 << 64)
        _POWERS = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(size, _BASE, np.uint64))), dtype=np.uint64)
        _INVERSE = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(size, back, np.uint64))), dtype=np.uint64)
    return _POWERS, _INVERSE


def parse(text: str, cuts: list[int] | None = None) -> list[int]:
    """Ends of the phrases of text, in order.

    cuts: ends of phrases already known at its beginning. Every beginning of a phrase is a phrase, so
    the length of a match is found by stepping from the last one's.
    """
    ends = list(cuts or ())
    known = {text[a:b] for a, b in zip([0, *ends], ends, strict=False)}
    at, n, size = ends[-1] if ends else 0, len(text), 1
    add, append = known.add, ends.append
    while at < n:
        end = at + size
        if text[at:end] in known:
            end += 1
            while end <= n and text[at:end] in known:
                end += 1
            if end > n:
                break  # the text ends inside a known phrase
        else:
            end -= 1
            while end > at and text[at:end] not in known:
                end -= 1
            end += 1
        if end > n:
            end = n
            if text[at:end] in known:
                break
        add(text[at:end])
        append(end)
        size = end - at
        at = end
    return ends


def hashes(text: str, ends: list[int]) -> np.ndarray:
    """The signature of the phrases of text: their smallest distinct 32-bit hashes."""
    if not ends:
        return np.empty(0, np.uint32)
    n = ends[-1]
    power, inverse = _powers(n)
    code = np.frombuffer(text[:n].encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(code * power[:n], dtype=np.uint64)))
    end = np.asarray(ends)
    start = np.concatenate(([0], end[:-1]))
    h = (mix64((total[end] - total[start]) * inverse[start]) >> np.uint64(32)).astype(np.uint32)
    return np.unique(h)[:SIGNATURE]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity from two signatures: what share of the smallest hashes of the union is in both."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    union = np.union1d(a, b)
    if len(a) >= SIGNATURE or len(b) >= SIGNATURE:
        union = union[:SIGNATURE]
    both = np.intersect1d(a, b, assume_unique=True)
    return float((both <= union[-1]).sum() / len(union))


def fingerprint(signature: np.ndarray) -> str:
    return signature.astype(">u4").tobytes().hex()


def fingerprints(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) to doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    texts = text_of(docs, F.col("doc_id").cast("long").alias("doc_id"))
    block, n = id_ranges(texts, partitions_for(docs))
    least = F.lit(-(1 << 63))
    dealt = texts.withColumn("key", F.coalesce("doc_id", least)).withColumn("block", block)
    # A row for each range: the number of ranges bounds what comes to the driver.
    firsts = dict(dealt.groupBy("block").agg(F.min("key").alias("key")).collect())
    order = sorted(firsts)
    before = {b: order[i - 1] for i, b in enumerate(order)}
    first = F.array(*[F.lit(firsts.get(b)).cast("long") for b in range(n)])
    to = F.array(*[F.lit(before.get(b)).cast("int") for b in range(n)])
    ahead = F.when(F.get(first, F.col("block")) == F.col("key"), F.get(to, F.col("block")))
    places = F.filter(F.array(F.struct(F.col("block").alias("block"), F.lit(0).alias("ahead")), F.struct(ahead.alias("block"), F.lit(1).alias("ahead"))), lambda x: x["block"].isNotNull())
    dealt = dealt.select("doc_id", "key", "text", F.explode(places).alias("at")).select("doc_id", "key", "text", "at.block", "at.ahead")
    dealt = dealt.repartitionById(n, F.col("block")).sortWithinPartitions("block", "ahead", "key", "text")
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None  # block, id, text, ends, signature of the row before
        for b in batches:
            out: list[list] = [[] for _ in names]
            for doc_id, text, block, look in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "block", "ahead")), strict=True):
                ends = parse(text)
                own = hashes(text, ends)
                if now is not None and now[0] == block:
                    for column, v in zip(out, _compared(*now[1:], text, own), strict=True):
                        column.append(v)
                now = None if look else (block, doc_id, text, ends, own)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names)

    bounded_batches(docs.sparkSession)
    return dealt.mapInArrow(given_back(made), "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def _compared(doc_id, text: str, ends: list[int], own: np.ndarray, following: str, next_own: np.ndarray) -> tuple:
    n = len(text)
    keep = n - n // 4
    edited = text[:keep] + following[: n // 4]
    common = int(np.searchsorted(ends, keep, "right"))
    other = hashes(edited, parse(edited, ends[:common]))
    return doc_id, n, hashlib.sha256(edited.encode()).hexdigest(), fingerprint(own), fingerprint(other), likeness(own, other), likeness(own, next_own)

"""Token ids in binary shards under Re-Pair grammar compression.

Documents are tokenised in ascending doc_id order and cut into shards of about SHARD tokens. In
each, rounds replace frequent pairs of neighbouring symbols by new symbols: a round counts all
pairs, takes the most frequent ones and replaces their occurrences from left to right, where two
overlap the earlier, until no pair occurs LEAST times. A rule's symbols come from earlier rounds, so
decoding expands round by round with array operations. Rules, the lengths of their expansions and
the place of every STEP-th symbol are stored, so a range of positions is decoded without the rest.

File format: Parquet rows (part, shard, doc_ids, lengths, payload), written by Spark to a path that
all machines reach. payload: b"RPG2", then little-endian unsigned 32-bit integers: number of
tokens, first symbol that is no token, bytes of a length (2 or 4), number of rounds, number of
places, rules by round, tokens before every STEP-th symbol; then the rules' lengths; then the rules
as pairs and the symbols of the shard, 16 bits each if all symbols fit, else 32.

Edge cases: a null or empty text is the end id alone; rows with one doc_id follow each other by
text; null ids come first; an empty table gives empty files; extra columns are left out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bounded_batches, given_back, partitions_for
from .tokens import ID_BYTES, encoder

MAGIC = b"RPG2"

#: Tokens of a shard, about; a longer document is a shard of its own.
SHARD = 1 << 20

PER_ROUND, LEAST = 3000, 8

#: Symbols from one stored place to the next.
STEP = 1024


#: Bits of a hash slot of a pair.
SLOTS = 18


def _slot(pairs: np.ndarray) -> np.ndarray:
    """A hash slot of each pair, from the upper bits of a product."""
    bits = pairs.dtype.itemsize * 8
    return (pairs * pairs.dtype.type(0x9E3779B97F4A7C15 >> (64 - bits) | 1)) >> pairs.dtype.type(bits - SLOTS)


def _lengths(symbols: np.ndarray, first: int, sizes: np.ndarray) -> np.ndarray:
    """Tokens that symbols stand for, given those of the rules."""
    out = np.ones(symbols.shape, np.int64)
    rule = symbols >= first
    out[rule] = sizes[symbols[rule] - first]
    return out


def compress(ids: np.ndarray, per_round: int = PER_ROUND, least: int = LEAST) -> bytes:
    """ids (unsigned, below 2**31) as a payload; ends when no pair occurs `least` (2 or more) times."""
    seq = np.array(ids, np.uint32)
    first = int(seq.max()) + 1 if len(seq) else 0
    top, rules, by_round, sizes = first, [], [], np.zeros(0, np.int64)
    while len(seq) > 1:  # every round shortens seq
        # Pairs take half the memory while all symbols fit 16 bits.
        kind, half = (np.uint32, 16) if top <= 1 << 16 else (np.uint64, 32)
        pairs = (seq[:-1].astype(kind) << kind(half)) | seq[1:]
        order = np.sort(pairs)
        edge = np.flatnonzero(np.concatenate(([True], order[1:] != order[:-1])))
        n = np.diff(np.append(edge, len(order)))
        often = np.flatnonzero(n >= least)
        if not len(often):
            break
        if len(often) > per_round:
            often = often[np.argsort(-n[often], kind="stable")[:per_round]]
        # Pairs are found by hash slots; of pairs in one slot the most frequent is taken, the others wait a round.
        often = often[np.argsort(-n[often], kind="stable")]
        slot = _slot(order[edge[often]])
        _, once = np.unique(slot, return_index=True)
        often = often[np.sort(once)]
        chosen = order[edge[often]]
        table = np.zeros(1 << SLOTS, np.int32)
        table[_slot(chosen)] = np.arange(len(chosen))
        at = table[_slot(pairs)]
        hit = np.flatnonzero(chosen[at] == pairs)
        # In a run of overlapping occurrences every other one is replaced, from the left.
        run = np.cumsum(np.concatenate(([True], np.diff(hit) != 1))) - 1
        begin = np.flatnonzero(np.concatenate(([True], np.diff(run) != 0)))
        hit = hit[(np.arange(len(hit)) - begin[run]) % 2 == 0]
        own = at[hit]
        used = np.bincount(own, minlength=len(chosen)) > 0
        seq[hit] = (top + np.cumsum(used) - 1).astype(np.uint32)[own]
        used = np.flatnonzero(used)
        keep = np.ones(len(seq), bool)
        keep[hit + 1] = False
        seq = seq[keep]
        rules.append(np.column_stack((chosen[used] >> kind(half), chosen[used] & kind((1 << half) - 1))).astype("<u4"))
        sizes = np.append(sizes, _lengths(rules[-1], first, sizes).sum(axis=1))
        by_round.append(len(used))
        top += len(used)
    width = "<u2" if top <= 1 << 16 else "<u4"
    ends = np.cumsum(_lengths(seq, first, sizes))
    places = (ends - _lengths(seq, first, sizes))[::STEP]
    size = 2 if sizes.max(initial=0) < 1 << 16 else 4
    head = np.array([len(ids), first, size, len(by_round), len(places), *by_round, *places], "<u4")
    return MAGIC + head.tobytes() + sizes.astype(f"<u{size}").tobytes() + b"".join(r.astype(width).tobytes() for r in rules) + seq.astype(width).tobytes()


class Shard:
    """A payload, ready to decode whole or in part."""

    def __init__(self, payload: bytes):
        if payload[:4] != MAGIC:
            raise ValueError("not a grammar shard")
        self.tokens, self.first, length, rounds, places = (int(x) for x in np.frombuffer(payload, "<u4", 5, 4))
        by_round = np.frombuffer(payload, "<u4", rounds, 24)
        #: Tokens before every STEP-th symbol.
        self.places = np.frombuffer(payload, "<u4", places, 24 + 4 * rounds).astype(np.int64)
        self.bounds = [self.first, *(self.first + np.cumsum(by_round, dtype=np.int64)).tolist()]
        width = "<u2" if self.bounds[-1] <= 1 << 16 else "<u4"
        n, at = self.bounds[-1] - self.first, 24 + 4 * (rounds + places)
        #: Tokens that each rule stands for.
        self.sizes = np.frombuffer(payload, f"<u{length}", n, at).astype(np.int64)
        at += n * length
        size = np.dtype(width).itemsize
        self.rules = np.frombuffer(payload, width, 2 * n, at).reshape(n, 2).astype(np.uint32)
        self.symbols = np.frombuffer(payload, width, offset=at + 2 * n * size).astype(np.uint32)

    def _expand(self, seq: np.ndarray) -> np.ndarray:
        for lo in reversed(self.bounds[:-1]):
            rule = seq >= lo
            if not rule.any():
                continue
            end = np.cumsum(1 + rule)
            out = np.empty(int(end[-1]), np.uint32)
            out[end - 1 - rule] = seq
            at = end[rule]
            pair = self.rules[seq[rule] - self.first]
            out[at - 2], out[at - 1] = pair[:, 0], pair[:, 1]
            seq = out
        return seq

    def decode(self) -> np.ndarray:
        return self._expand(self.symbols)

    def slice(self, start: int, stop: int) -> np.ndarray:
        """Tokens start to stop, expanding only the symbols that cover them."""
        start, stop = max(0, start), min(stop, self.tokens)
        if start >= stop:
            return np.empty(0, np.uint32)
        lo, hi = int(np.searchsorted(self.places, start, "right")) - 1, int(np.searchsorted(self.places, stop, "left"))
        near = self.symbols[lo * STEP : hi * STEP]
        ends = self.places[lo] + np.cumsum(_lengths(near, self.first, self.sizes))
        a, b = int(np.searchsorted(ends, start, "right")), int(np.searchsorted(ends, stop, "left"))
        before = int(ends[a - 1]) if a else int(self.places[lo])
        return self._expand(near[a : b + 1])[start - before : stop - before]


def write(docs: DataFrame, tokenizer: str, path: str, end_id: int = 2, shard: int = SHARD) -> None:
    """Tokenise docs (doc_id, text) and write the shards to path, a new folder."""
    names = ["part", "shard", "doc_ids", "lengths", "payload"]
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, code = TaskContext.get().partitionId(), encoder(tokenizer)
        doc_ids: list = []
        held: list[tuple[np.ndarray, np.ndarray]] = []  # ids of texts, and the number of each
        size = count = 0

        def flush() -> pa.RecordBatch:
            ids, lengths = (np.concatenate(x) for x in zip(*held, strict=True))
            columns = [[part], [count], [doc_ids], [lengths], [compress(ids)]]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        for b in batches:
            own, (ids, lengths) = b.column("doc_id").to_pylist(), code.encode(b.column("text"), end_id)
            ends = np.cumsum(lengths)
            x = at = 0
            while x < len(own):
                # The texts up to the one that makes the shard full.
                y = min(len(own), int(np.searchsorted(ends, at + shard - size)) + 1)
                upto = int(ends[y - 1])
                doc_ids += own[x:y]
                held.append((ids[at:upto], lengths[x:y]))
                size += upto - at
                x, at = y, upto
                if size >= shard:
                    yield flush()
                    doc_ids, held, size, count = [], [], 0, count + 1
        if held:
            yield flush()

    bounded_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    ordered = texts.repartitionByRange(partitions_for(docs), "doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(given_back(shards), "part long, shard long, doc_ids array<long>, lengths array<long>, payload binary").write.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The shards with `start`: tokens of all shards before one.

    Sums go over the tokens of the parts first (a row for each task that wrote), then within each.
    """
    files = spark.read.parquet(path).withColumn("tokens", F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x))
    parts = files.groupBy("part").agg(F.sum("tokens").alias("tokens"))
    before = parts.select("part", F.coalesce(F.sum("tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("part_start"))
    index = files.select("part", "shard", "tokens").withColumn("start", F.coalesce(F.sum("tokens").over(Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    index = index.join(before, "part").select("part", "shard", (F.col("part_start") + F.col("start")).alias("start"))
    return files.drop("tokens").join(index, ["part", "shard"])


def digest(shards: DataFrame) -> DataFrame:
    """What read() gives to a row for each document: doc_id, start, n_tokens, ids_crc32."""

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc_ids, lengths, payload, start in zip(*(b.column(c).to_pylist() for c in ("doc_ids", "lengths", "payload", "start")), strict=True):
                ids = Shard(payload).decode().astype("<u4").tobytes()
                ends = np.cumsum(lengths)
                crc = [zlib.crc32(ids[(e - n) * ID_BYTES : e * ID_BYTES]) for e, n in zip(ends.tolist(), lengths, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(start + ends - lengths, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    bounded_batches(shards.sparkSession)
    return shards.mapInArrow(given_back(decoded), "doc_id long, start long, n_tokens long, ids_crc32 long")

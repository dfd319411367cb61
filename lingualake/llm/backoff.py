"""Language-model scores by a weighted backoff automaton over smoothed n-grams.

The model is counted on all training texts and is as large as they are, so no task holds it. Texts are dealt out in blocks.
Each block names its own n-grams by hash and sends each once, with its count, to buckets by hash; a bucket sums the counts of all blocks and
tells each block the totals of what it sent, in the same order. So a frequent n-gram is one entry for each block. From
the totals a block builds the part of the automaton that its texts can reach:

* a state is a known n-gram of up to `order` - 1 words, and the empty one;
* an arc is a known n-gram: from the state of its first words by its last word, with the log probability
  (c(hw) + m P(w | h')) / (c(h) + m), h' being h without its first word and m a strength by length (a Dirichlet prior);
* the failure arc of h leads to h' with the log weight m / (c(h) + m), so an unseen follower gets just what the formula
  gives it at c(hw) = 0, and the followers of each state sum to 1;
* the empty state has c(w) / (N + V) for known words, and V / (N + V) for all unknown ones together.

One left-to-right traversal of each text carries the state, takes failure arcs until the word has an arc, and adds up.
A text starts behind a mark that stands before all texts and closes with an end, which counts as a token.

N-grams are 64-bit hashes of words, cut to the bits that a corpus of this size needs: 18 more than the number of its
bytes has, 48 at least and all 64 from 64 TB on, so that of millions of n-grams that aren't known one may pass for a known one.
Single words keep 64 bits.

Edge cases: null and empty texts have the end alone; a text above `limit` bytes is cut into pieces at word boundaries,
each with the words before it that a state can hold, and scored in several tasks, with the same result; repeated rows
and rows with one id are texts each; a null `train` is false; without training texts every token has probability 1;
extra columns are left out. docs should read alike each time, as tables and files do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, given_back, mix64, partitions_for, pieces, release, rolling

ORDER = 3

#: Strength of the shorter context, by the words of the longer one.
STRENGTHS = (1000.0, 8.0)

LIMIT, BLOCK_BYTES = 1 << 20, 8 << 20

#: Hashes of the mark before a text and of its end.
BEGIN, END = np.uint64(0x2545F4914F6CDD1D), np.uint64(0x9FB21C651E98DF25)

# White space between words.
GAP = r"\x20\x09-\x0D"

_IS_GAP = np.zeros(256, bool)
_IS_GAP[[0x20, *range(0x09, 0x0E)]] = True

_SPAN = 1 << 20
_POWERS = np.full(_SPAN + 1, 0xD6E8FEB86659FD93, np.uint64)
_POWERS[0] = 1
_POWERS = np.cumprod(_POWERS)


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of some bytes, and where they start.

    A word is a polynomial in its bytes mod 2**64, got from running sums over a span; a word longer than a span has a hash of its own kind.
    """
    import xxhash

    letters = np.frombuffer(data, np.uint8)
    inside = np.concatenate(([False], ~_IS_GAP[letters], [False]))
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edge[::2], edge[1::2]
    out, i = np.empty(len(starts), np.uint64), 0
    while i < len(starts):
        lo = int(starts[i])
        j = int(np.searchsorted(ends, lo + _SPAN, "right"))
        if j == i:
            out[i] = xxhash.xxh64_intdigest(data[lo : int(ends[i])])
            i += 1
            continue
        span = letters[lo : int(ends[j - 1])].astype(np.uint64) + np.uint64(1)
        sums = np.concatenate(([np.uint64(0)], np.cumsum(span * _POWERS[: len(span)])))
        a = starts[i:j] - lo
        out[i:j] = (sums[ends[i:j] - lo] - sums[a]) * _POWERS[_SPAN - a]
        i = j
    return mix64(out), starts


def packed(values: np.ndarray) -> bytes:
    """Integers as compressed planes of bytes: small ones cost little."""
    return pa.compress(np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes(), "zstd", asbytes=True)


def unpacked(body: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(body, 8 * n, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, n).T).view("<u8").reshape(n).astype(np.uint64)


class Grams:
    """The n-grams of a block of pieces: for each length the distinct hashes in order, their counts in training texts, and which one ends at each token."""

    def __init__(self, heads: list[str], owns: list[str], piece: np.ndarray, of: np.ndarray, train: np.ndarray, order: int, bits: int):
        lowered = [(h + " " + o).encode().lower() for h, o in zip(heads, owns, strict=True)]
        at = np.cumsum([0, *(len(x) + 1 for x in lowered)])
        words, starts = word_hashes(b"\n".join(lowered))
        del lowered
        n_words = np.diff(np.searchsorted(starts, at))
        n_head = np.fromiter((len(h.split()) for h in heads), np.int64, len(heads))
        begins, closes = n_head < order - 1, piece == of - 1
        if order == 1:
            begins = piece == 0
        size = n_words + begins + closes
        self.stops = np.cumsum(size)
        self.starts = self.stops - size
        self.heads = n_head + begins  # tokens of a piece that only lead to a state
        tokens = np.empty(int(size.sum()), np.uint64)
        before = np.cumsum(begins.astype(np.int64) + closes) - closes  # marks put in before a piece's words
        tokens[np.arange(len(words)) + np.repeat(before, n_words)] = words
        tokens[self.starts[begins]] = BEGIN
        tokens[self.stops[closes] - 1] = END
        inner = np.arange(len(tokens)) - np.repeat(self.starts, size)
        self.scored = inner >= np.repeat(self.heads, size)
        learned = np.repeat(train, size)
        first = np.repeat(begins & (piece == 0), size) & (inner == 0)
        self.order, self.grams, self.counts, self.at, self.samples = order, [], [], [], []
        for k in range(1, order + 1):
            here = np.flatnonzero(inner >= k - 1)
            values = rolling(tokens, k)[here - k + 1] if k > 1 else tokens
            if k > 1 and bits < 64:
                values = values >> np.uint64(64 - bits)
            distinct, sample, back = np.unique(values, return_index=True, return_inverse=True)
            counted = (self.scored | first if k == 1 else self.scored) & learned
            at = np.full(len(tokens), -1, np.int32)
            at[here] = back
            self.grams.append(distinct)
            self.counts.append(np.bincount(back, counted[here], len(distinct)).astype(np.uint64))
            self.at.append(at)
            self.samples.append(here[sample])


def sent(order: int, bits: int, grams: np.ndarray, counts: np.ndarray, buckets: int) -> Iterator[tuple[int, int, int, bytes, bytes]]:
    """Rows (bucket, order, n, grams, counts) for the sorted n-grams of one length."""
    width = bits if order > 1 else 64
    bucket = ((grams >> np.uint64(width - 32)) * np.uint64(buckets)) >> np.uint64(32)
    edge = np.flatnonzero(np.diff(bucket)) + 1
    for a, b in zip([0, *edge.tolist()], [*edge.tolist(), len(grams)], strict=True):
        if a < b:
            steps = np.diff(grams[a:b], prepend=np.uint64(0))
            yield int(bucket[a]), order, b - a, packed(steps), packed(counts[a:b])


_SENT = "bucket int, block int, order int, n int, grams binary, counts binary"
_TOLD = "block int, order int, bucket int, n int, counts binary"
_KINDS = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_()}


def _table(schema: str, rows: list[tuple]) -> pa.Table:
    names, kinds = zip(*(c.split() for c in schema.split(", ")), strict=True)
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.table([pa.array(c, _KINDS[k]) for c, k in zip(columns, kinds, strict=True)], names=list(names))


def _grams(block: pa.Table, order: int, bits: int) -> Grams:
    numbers = [block.column(c).to_numpy() for c in ("piece", "of", "train")]
    return Grams(block.column("head").to_pylist(), block.column("own").to_pylist(), *numbers, order, bits)


def _sent(order: int, bits: int, buckets: int):
    def made(key: tuple, block: pa.Table) -> pa.Table:
        g = _grams(block, order, bits)
        rows = [(r[0], key[0].as_py(), *r[1:]) for k in range(order) for r in sent(k + 1, bits, g.grams[k], g.counts[k], buckets)]
        del g, block
        release()
        return _table(_SENT, rows)

    return made


def _merged(block: pa.Table) -> Iterator[tuple[int, pa.Table, list[int], np.ndarray, np.ndarray]]:
    """For each length of a bucket's n-grams: its rows, their numbers of n-grams, which distinct one each is, and the totals."""
    orders = block.column("order").to_numpy()
    for k in np.unique(orders):
        part = block.filter(pa.array(orders == k))
        n = part.column("n").to_pylist()
        grams = np.concatenate([np.cumsum(unpacked(x, m)) for x, m in zip(part.column("grams").to_pylist(), n, strict=True)])
        counts = np.concatenate([unpacked(x, m) for x, m in zip(part.column("counts").to_pylist(), n, strict=True)])
        distinct, back = np.unique(grams, return_inverse=True)
        yield int(k), part, n, back, np.bincount(back, counts, len(distinct)).astype(np.uint64)


def _told(key: tuple, block: pa.Table) -> pa.Table:
    rows = []
    for k, part, n, back, totals in _merged(block):
        ends = np.cumsum(n)
        for b, a, z in zip(part.column("block").to_pylist(), ends - n, ends, strict=True):
            rows.append((b, k, key[0].as_py(), int(z - a), packed(totals[back[a:z]])))
    release()
    return _table(_TOLD, rows)


def _distinct(key: tuple, block: pa.Table) -> pa.Table:
    rows = []
    for _, _, _, _, totals in _merged(block):
        rows.append((int((totals > 0).sum()), int(totals.sum())))
    return _table("kinds long, n long", rows)


class Automaton:
    """The states and arcs that the n-grams of a block reach, with log10 weights; totals are the n-grams' counts in training."""

    def __init__(self, g: Grams, totals: list[np.ndarray], n: int, kinds: int, strengths: tuple[float, ...]):
        known = [t.astype(np.float64) for t in totals]
        unknown = kinds / (n + kinds) if n else 1.0
        p = np.where(known[0] > 0, known[0] / max(n + kinds, 1), unknown)
        self.top = np.where(known[0] > 0, 1, 0)[g.at[0]]
        self.arcs, self.fails = [np.log10(np.maximum(p, 1e-300))[g.at[0]]], []
        for k in range(1, g.order):
            m = strengths[k - 1]
            self.fails.append(np.log10(m / (known[k - 1] + m))[g.at[k - 1]])
            state, shorter = g.at[k - 1][g.samples[k] - 1], g.at[k - 1][g.samples[k]]
            p = (known[k] + m * p[shorter]) / (known[k - 1][state] + m)
            here = g.at[k] >= 0
            self.arcs.append(np.where(here, np.log10(p)[g.at[k]], 0.0))
            self.top[here & (known[k] > 0)[g.at[k]]] = k + 1

    def traverse(self, start: int, own: int, stop: int) -> float:
        """Log10 probability of the tokens from `own` on; those from `start` on lead to the state before them."""
        top = self.top[start:stop].tolist()
        arcs = [a[start:stop].tolist() for a in self.arcs]
        fails = [f[start:stop].tolist() for f in self.fails]
        longest = len(fails)
        state, total = 0, 0.0  # a state is named by its number of words: those before the token
        for i, t in enumerate(top):
            if i == own - start:
                total = 0.0
            while state >= t and state:
                total += fails[state - 1][i - 1]
                state -= 1
            total += arcs[state][i]
            if t:
                state = state + 1 if state < longest else longest
        return total if stop > own else 0.0


_SCORED = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _scored(order: int, bits: int, n: int, kinds: int, strengths: tuple[float, ...], alpha: float):
    def made(key: tuple, block: pa.Table, told: pa.Table) -> pa.Table:
        if not len(block):
            return _table(_SCORED, [])
        g = _grams(block, order, bits)
        told = told.sort_by([("order", "ascending"), ("bucket", "ascending")])
        totals = []
        for k in range(1, order + 1):
            part = told.filter(pa.compute.equal(told.column("order"), k))
            bodies = [unpacked(x, m) for x, m in zip(part.column("counts").to_pylist(), part.column("n").to_pylist(), strict=True)]
            totals.append(np.concatenate(bodies) if bodies else np.empty(0, np.uint64))
        del told
        counts = totals[0][g.at[0]].astype(np.float64)
        base = np.log10((counts + alpha) / (n + alpha * (kinds + 1)))
        machine = Automaton(g, totals, n, kinds, strengths)
        rows = []
        for row, doc_id, train, a, head, z in zip(block.column("row").to_pylist(), block.column("doc_id").to_pylist(), block.column("train").to_pylist(), g.starts.tolist(), g.heads.tolist(), g.stops.tolist(), strict=True):
            own = slice(a + head, z)
            rows.append((row, doc_id, not train, z - a - head, int((counts[own] > 0).sum()), float(base[own].sum()), machine.traverse(a, a + head, z)))
        del g, machine, block
        release()
        return _table(_SCORED, rows)

    return made


def training_size(docs: DataFrame, train: Column, buckets: int) -> tuple[int, int]:
    """Tokens of the training texts, ends included, and how many distinct ones there are: exact over all texts, words by 64 bits of hash."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, counts = np.empty(0, np.uint64), np.empty(0, np.uint64)
        for b in batches:
            texts = b.column("text").to_pylist()
            found = np.concatenate([word_hashes("\n".join(texts).encode().lower())[0], np.full(len(texts), END)])
            grams, back = np.unique(np.concatenate([grams, found]), return_inverse=True)
            counts = np.bincount(back, np.concatenate([counts, np.ones(len(found), np.uint64)]), len(grams)).astype(np.uint64)
        rows = [(r[0], 0, *r[1:]) for r in sent(1, 64, grams, counts, buckets)]
        yield from _table(_SENT, rows).to_batches(max_chunksize=1000)

    texts = docs.filter(train).select(F.coalesce("text", F.lit("")).alias("text"))
    bounded_batches(docs.sparkSession)
    sizes = texts.mapInArrow(given_back(counted), _SENT).groupBy("bucket").applyInArrow(_distinct, "kinds long, n long")
    found = sizes.agg(F.sum("n"), F.sum("kinds")).first()
    return found[0] or 0, found[1] or 0


def score(docs: DataFrame, train: Column, order: int = ORDER, strengths: tuple[float, ...] = STRENGTHS, alpha: float = 0.1, limit: int = LIMIT, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs (doc_id, text) to doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Texts where `train` holds are learned, all are scored. base_score is that of single words with `alpha` added.
    """
    if order < 1 or len(strengths) < order - 1 or any(m <= 0 for m in strengths):
        raise ValueError("the order must be at least 1, with a positive strength for each context")
    train = F.coalesce(train, F.lit(False))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = partitions_for(docs, block_bytes)
    bits = min(64, max(48, size.bit_length() + 18))
    n, kinds = training_size(docs, train, blocks)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), train.alias("train"), F.coalesce("text", F.lit("")).alias("text"))
    cut = rows.select("row", "doc_id", "train", F.explode(pieces(F.col("text"), GAP, limit, before=order - 1)).alias("p"))
    dealt = cut.select("row", "doc_id", "train", "p.piece", "p.of", "p.head", "p.own", F.pmod(F.xxhash64("row", "p.piece"), F.lit(blocks)).cast("int").alias("block")).groupBy("block")
    told = dealt.applyInArrow(_sent(order, bits, blocks), _SENT).groupBy("bucket").applyInArrow(_told, _TOLD)
    each = dealt.cogroup(told.groupBy("block")).applyInArrow(_scored(order, bits, n, kinds, strengths, alpha), _SCORED)
    sums = each.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("held_out").alias("held_out"), *[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")])
    return sums.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")

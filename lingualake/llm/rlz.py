"""Substring dedup by a join of hashed windows over blocks of documents; the windows found are chained into factors.

Documents are cut into blocks of ascending ids. A window is `width` consecutive words; those whose words also stand
earlier are found by the index below, and the words that they cover go. Runs of such windows with one source are told as factors
(start and length). This stands in for a relative Lempel-Ziv parse: no factor is extended word by word against a block.

The index over the blocks is built in two steps, so that text that stands once costs little. Every
window is named by its anchor, the least hash of the runs of ANCHOR words inside it: equal windows
have equal anchors. First the anchors of all blocks meet, and each block learns which of its own
stand elsewhere too. Then only windows with such anchors are indexed, by 96 bits of hash, and each
block learns the earliest source of those windows that aren't the first. In both steps a block
sends every hash once, however often it holds it, so copies and common passages are folded before
the shuffle and no task gathers more than one entry for each block and hash. The 96 bits come from one hash of 64 bits
for each word, so two words that share it are taken for one.

A block's texts are worked on in pieces of PIECE_BYTES: Arrow splits all texts of a piece and tells its distinct words
apart, and the windows of all its texts are a few array operations.

Edge cases: null and empty texts have no words; texts shorter than `width` words lose nothing; rows
with one doc_id are separate texts in the order of their text; null ids come first; extra columns
are kept by dedup() and left out by spans(). An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import id_ranges, mix64, partitions_for, rolling

WIDTH, ANCHOR = 20, 6

#: Bytes of text that are split and hashed at once. Texts aren't cut, so a longer one makes its piece longer.
PIECE_BYTES = 1 << 20

_MASK = np.uint64(0xFFFFFFFF)


def pieces(texts: pa.ChunkedArray) -> Iterator[pa.Array]:
    """The texts of a column in slices of about PIECE_BYTES."""
    for chunk in texts.chunks:
        if len(chunk):
            part = np.cumsum(pc.binary_length(chunk).to_numpy(zero_copy_only=False), dtype=np.int64) // PIECE_BYTES
            for _, a, b in _slices(part):
                yield chunk.slice(a, b - a)


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts one after another (bytes), and the bounds of each text among them."""
    lists = pc.ascii_split_whitespace(texts)
    words, bounds = lists.flatten().cast(pa.binary()), lists.offsets.to_numpy().astype(np.int64)
    bounds -= bounds[0]
    full = pc.binary_length(words).to_numpy() > 0
    if not full.all():
        # What stands before leading and behind trailing white space.
        bounds = np.concatenate(([0], np.cumsum(full)))[bounds]
        words = words.filter(pa.array(full))
    return words, bounds


def hashed(words: pa.Array) -> np.ndarray:
    """64 bits of hash of each word; a word that repeats is hashed once."""
    import xxhash

    coded = words.dictionary_encode()
    distinct = np.fromiter(map(xxhash.xxh64_intdigest, coded.dictionary.to_numpy(zero_copy_only=False)), np.uint64, len(coded.dictionary))
    return distinct[coded.indices.to_numpy()]


def _left(bounds: np.ndarray, width: int) -> np.ndarray:
    """For each word the words from it to its text's end, 0 in texts shorter than a window."""
    size = np.diff(bounds)
    end = np.where(size >= width, bounds[1:], 0)
    return np.maximum(np.repeat(end, size) - np.arange(bounds[-1]), 0)


def anchors(hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all runs of ANCHOR words, and of each window the least of those inside it."""
    size = min(ANCHOR, width)
    gram = least = rolling(hashes, size)
    have, want = 1, width - size + 1
    while have < want:
        step = min(have, want - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    return gram, least


def windows(hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each window of `width` words: 64 bits of hash, and 32 more."""
    first = rolling(hashes, width)
    return first, (rolling(mix64(hashes ^ np.uint64(0x5851F42D4C957F2D)), width) >> np.uint64(32)).astype(np.uint32)


def _bucket(h: np.ndarray, n: int) -> np.ndarray:
    """n buckets by the upper half of a hash, in the order of the hashes."""
    return (((h >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)).astype(np.int64)


def _slices(bucket: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Runs of a sorted array of buckets: bucket, start, stop."""
    if len(bucket):
        edge = np.flatnonzero(np.diff(bucket)) + 1
        for a, b in zip([0, *edge.tolist()], [*edge.tolist(), len(bucket)], strict=True):
            yield int(bucket[a]), a, b


def _sorted(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by both hashes, equal ones as they stand, and where a new key begins."""
    if not len(first):
        return np.empty(0, np.int64), np.empty(0, bool)
    order = np.argsort(first, kind="stable")
    a, b = first[order], second[order]
    same, other = a[1:] == a[:-1], b[1:] != b[:-1]
    if (same & other).any():
        # Two keys share the 64 bits: they may lie mixed.
        order = np.lexsort((second, first))
        a, b = first[order], second[order]
        same, other = a[1:] == a[:-1], b[1:] != b[:-1]
    return order, np.concatenate(([True], ~same | other))


def _batch(names: list[str], kinds: list, rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


_SENT = ["bucket", "block", "body"]
_SENT_KINDS = [pa.int32(), pa.int32(), pa.binary()]
_SENT_SCHEMA = "bucket int, block int, body binary"
_TOLD = ["block", "kind", "body"]
_TOLD_KINDS = [pa.int32(), pa.int32(), pa.binary()]
_TOLD_SCHEMA = "block int, kind int, body binary"

#: Kinds of what a block is told.
ANCHORS, SOURCES = 0, 1


class Block:
    """The windows of one block whose anchors stand elsewhere too, row by row in the order of ids."""

    def __init__(self, anchors: np.ndarray, width: int):
        self.anchors, self.width = anchors, width
        self.parts: list[tuple] = []
        self.rows = 0

    def add(self, texts: pa.Array) -> None:
        if len(self.anchors):
            words, bounds = split(texts)
            if len(words) >= self.width:
                self._add(hashed(words), bounds)
        self.rows += len(texts)

    def _add(self, hashes: np.ndarray, bounds: np.ndarray) -> None:
        _, anchor = anchors(hashes, self.width)
        # Neighbours share their anchor mostly, so each run of an anchor is looked up once.
        run = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
        at = np.searchsorted(self.anchors, anchor[run])
        at[at == len(self.anchors)] = 0
        held = np.repeat(self.anchors[at] == anchor[run], np.diff(np.append(run, len(anchor))))
        start = np.flatnonzero(held & (_left(bounds, self.width)[: len(anchor)] >= self.width))
        if len(start):
            first, second = windows(hashes, self.width)
            row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[start]
            place = ((row + self.rows) << 32 | (start - bounds[row])).astype(np.uint64)
            self.parts.append((first[start], second[start], place))

    def index(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Both hashes and the place (row << 32 | word) of all windows by hash, and which are the first of theirs."""
        if not self.parts:
            none = np.empty(0, np.uint64)
            return none, none.astype(np.uint32), none, none.astype(bool)
        # The places ascend, as rows and starts do.
        first, second, place = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order, begin = _sorted(first, second)
        return first[order], second[order], place[order], begin


def _ordered(block: pa.Table) -> pa.Table:
    """A block's documents by id and then text, as every step numbers them."""
    return block.sort_by([("key", "ascending"), ("text", "ascending")])


def _table(names: list[str], kinds: list, rows: list[tuple]) -> pa.Table:
    return pa.Table.from_batches([_batch(names, kinds, rows)])


def _anchors(n: int, width: int):
    def found(key: tuple, documents: pa.Table) -> pa.Table:
        """The distinct anchors of a block, with a mark on those that stand more than once in it."""
        runs, grams, block = [], [], key[0].as_py()
        size = min(ANCHOR, width)
        for texts in pieces(documents.column("text")):
            words, bounds = split(texts)
            if len(words) < width:
                continue
            gram, anchor = anchors(hashed(words), width)
            left = _left(bounds, width)
            anchor = anchor[left[: len(anchor)] >= width]
            if len(anchor):
                runs.append(anchor[np.concatenate(([True], anchor[1:] != anchor[:-1]))])
                grams.append(gram[left[: len(gram)] >= size])
        rows: list[tuple] = []
        if runs:
            own = np.unique(np.concatenate(runs))
            gram = np.sort(np.concatenate(grams))
            often = (np.searchsorted(gram, own, "right") - np.searchsorted(gram, own, "left")) > 1
            rows = [(q, block, own[a:b].tobytes() + np.packbits(often[a:b]).tobytes()) for q, a, b in _slices(_bucket(own, n))]
        return _table(_SENT, _SENT_KINDS, rows)

    return found


def _shared_anchors(bucket: pa.Table) -> pa.Table:
    """For each block its anchors of a bucket that stand in another block too, or twice in its own."""
    blocks, own, marks = [], [], []
    for block, body in zip(bucket.column("block").to_pylist(), bucket.column("body").to_pylist(), strict=True):
        k = len(body) * 8 // 65  # k anchors take 8 k bytes, and their marks k bits in whole bytes
        own.append(np.frombuffer(body, np.uint64, k))
        marks.append(np.unpackbits(np.frombuffer(body, np.uint8, offset=8 * k))[:k].astype(bool))
        blocks.append(block)
    anchor, mark = np.concatenate(own), np.concatenate(marks)
    order = np.argsort(anchor, kind="stable")
    a = anchor[order]
    same = a[1:] == a[:-1]
    again = np.zeros(len(a), bool)
    again[1:] |= same
    again[:-1] |= same
    keep = np.empty(len(a), bool)
    keep[order] = again
    keep |= mark
    at = 0
    rows = []
    for block, x in zip(blocks, own, strict=True):
        part = x[keep[at : at + len(x)]]
        at += len(x)
        if len(part):
            rows.append((block, ANCHORS, part.tobytes()))
    return _table(_TOLD, _TOLD_KINDS, rows)


def _bodies(told: pa.Table, kind: int) -> list[bytes]:
    return [x for k, x in zip(told.column("kind").to_pylist(), told.column("body").to_pylist(), strict=True) if k == kind]


def _block(documents: pa.Table, told: pa.Table, width: int) -> Block:
    """The index of a block's own windows, of documents in their order."""
    b = Block(np.sort(np.frombuffer(b"".join(_bodies(told, ANCHORS)), np.uint64)), width)
    for texts in pieces(documents.column("text")):
        b.add(texts)
    return b


def _indexed(n: int, width: int):
    def sent(key: tuple, documents: pa.Table, told: pa.Table) -> pa.Table:
        """The first window of every hash in a block, to the hash's bucket."""
        first, second, place, begin = _block(_ordered(documents), told, width).index()
        first, second, place, block = first[begin], second[begin], place[begin], key[0].as_py()
        return _table(_SENT, _SENT_KINDS, [(q, block, first[x:y].tobytes() + place[x:y].tobytes() + second[x:y].tobytes()) for q, x, y in _slices(_bucket(first, n))])

    return sent


def _earlier(bucket: pa.Table) -> pa.Table:
    """For each block its windows of a bucket that stand in an earlier block, with the earliest place."""
    parts = []
    for block, body in sorted(zip(bucket.column("block").to_pylist(), bucket.column("body").to_pylist(), strict=True), key=lambda x: x[0]):
        k = len(body) // 20
        parts.append((np.frombuffer(body, np.uint64, k), np.frombuffer(body, np.uint32, k, 16 * k), np.frombuffer(body, np.uint64, k, 8 * k), np.full(k, block, np.int32)))
    first, second, place, block = (np.concatenate(x) for x in zip(*parts, strict=True))
    order, begin = _sorted(first, second)
    head = np.flatnonzero(begin)[np.cumsum(begin) - 1]
    late = np.flatnonzero(~begin)
    to, own, source, source_block = block[order][late], place[order][late], place[order][head[late]], block[order][head[late]]
    by = np.argsort(to, kind="stable")
    rows = []
    for b, x, y in _slices(to[by].astype(np.int64)):
        s = by[x:y]
        rows.append((b, SOURCES, own[s].tobytes() + source[s].tobytes() + source_block[s].tobytes()))
    return _table(_TOLD, _TOLD_KINDS, rows)


def factors(sources: dict[str, np.ndarray], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Greedy factors (document, start, length) from the windows with an earlier source, in the order of documents and words.

    sources: document and word, and the block, row and word of the source. A factor goes on while the next window
    continues it in the source; the window over a boundary opens the next factor.
    """
    document, word, block, row, at = (sources[k] for k in ("document", "word", "block", "row", "at"))
    if not len(word):
        return document, word, word
    go = (np.diff(document) == 0) & (np.diff(word) == 1) & (np.diff(block) == 0) & (np.diff(row) == 0) & (np.diff(at) == 1)
    begin = np.flatnonzero(np.concatenate(([True], ~go)))
    end = np.append(begin[1:], len(word)) - 1
    return document[begin], word[begin], word[end] - word[begin] + width


def kept(bounds: np.ndarray, document: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Which words of texts with these bounds lie outside of all factors."""
    gone = np.zeros(bounds[-1] + 1, np.int64)
    np.add.at(gone, bounds[document] + start, 1)
    np.add.at(gone, bounds[document] + start + length, -1)
    return np.cumsum(gone[:-1]) == 0


def _factored(width: int, make, names: list[str], kinds: list):
    schema = pa.schema(list(zip(names, kinds, strict=True)))

    def made(key: tuple, documents: pa.Table, told: pa.Table) -> pa.Table:
        """make() of every piece of a block's documents: rows, counts of words before and after, kept words joined, factors."""
        documents, number = _ordered(documents), key[0].as_py()
        _, _, place, begin = _block(documents, told, width).index()
        own, source, source_block = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)], [np.empty(0, np.int32)]
        for body in _bodies(told, SOURCES):
            k = len(body) // 20
            own.append(np.frombuffer(body, np.uint64, k))
            source.append(np.frombuffer(body, np.uint64, k, 8 * k))
            source_block.append(np.frombuffer(body, np.int32, k, 16 * k))
        own, source, source_block = (np.concatenate(x) for x in (own, source, source_block))
        by = np.argsort(own, kind="stable")
        own, source, source_block = own[by], source[by], source_block[by]
        head = place[np.flatnonzero(begin)[np.cumsum(begin) - 1]] if len(place) else place
        # The earliest source: that of the block's first such window if there is one, else this window itself.
        at = np.searchsorted(own, head)
        at[at == len(own)] = 0
        far = own[at] == head if len(own) else np.zeros(len(head), bool)
        late = far | ~begin
        from_place = np.where(far, source[at] if len(own) else head, head)
        from_block = np.where(far, source_block[at] if len(own) else number, number)
        order = np.argsort(place[late], kind="stable")
        place, from_place, from_block = place[late][order], from_place[late][order], from_block[late][order]
        high = np.uint64(32)
        document, start, length = factors(
            {
                "document": (place >> high).astype(np.int64),
                "word": (place & _MASK).astype(np.int64),
                "block": from_block,
                "row": (from_place >> high).astype(np.int64),
                "at": (from_place & _MASK).astype(np.int64),
            },
            width,
        )
        done, parts = 0, []
        for texts in pieces(documents.column("text")):
            words, bounds = split(texts)
            a, b = np.searchsorted(document, (done, done + len(texts)))
            mine = document[a:b] - done
            keep = kept(bounds, mine, start[a:b], length[a:b])
            left = np.concatenate(([0], np.cumsum(keep)))[bounds]
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(left, pa.int32()), words.filter(pa.array(keep))), b" ")
            opens = np.searchsorted(mine, np.arange(len(texts) + 1))
            columns = make(documents.slice(done, len(texts)), np.diff(bounds), np.diff(left), joined, (opens, start[a:b], length[a:b]))
            parts.append(pa.Table.from_arrays([c.cast(k) for c, k in zip(columns, kinds, strict=True)], schema=schema))
            done += len(texts)
        return pa.concat_tables(parts) if parts else schema.empty_table()

    return made


def _run(docs: DataFrame, carried: list[str], width: int, make, names: list[str], kinds: list, schema: str) -> DataFrame:
    """docs: doc_id, text and the carried columns, whose names don't clash with those used here.

    The three steps over the blocks ask for the same exchange of the documents, which Spark makes once.
    """
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    n = partitions_for(docs)
    block, _ = id_ranges(docs, n)
    dealt = docs.select(block.cast("int").alias("block"), key.alias("key"), F.coalesce("text", F.lit("")).alias("text"), *carried).groupBy("block")
    shared = dealt.applyInArrow(_anchors(n, width), _SENT_SCHEMA).groupBy("bucket").applyInArrow(_shared_anchors, _TOLD_SCHEMA)
    indexed = dealt.cogroup(shared.groupBy("block")).applyInArrow(_indexed(n, width), _SENT_SCHEMA)
    told = shared.unionByName(indexed.groupBy("bucket").applyInArrow(_earlier, _TOLD_SCHEMA))
    return dealt.cogroup(told.groupBy("block")).applyInArrow(_factored(width, make, names, kinds), schema)


def spans(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """docs (doc_id, text) to doc_id, n_words, n_removed, kept_sha256, factors (start, length in words)."""
    names = ["doc_id", "n_words", "n_removed", "kept_sha256", "factors"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))]

    def make(rows: pa.Table, before: np.ndarray, after: np.ndarray, joined: pa.Array, found: tuple) -> list:
        opens, start, length = found
        digests = pa.array([hashlib.sha256(x).hexdigest() for x in joined.to_numpy(zero_copy_only=False)], kinds[3])
        both = pa.StructArray.from_arrays([pa.array(start, pa.int64()), pa.array(length, pa.int64())], ["start", "length"])
        return [rows.column("carried_id"), pa.array(before, kinds[1]), pa.array(before - after, kinds[2]), digests, pa.ListArray.from_arrays(pa.array(opens, pa.int32()), both)]

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("doc_id").cast("long").alias("carried_id"))
    return _run(plain, ["carried_id"], width, make, names, kinds, "doc_id long, n_words long, n_removed long, kept_sha256 string, factors array<struct<start: long, length: long>>")


def dedup(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """docs with the duplicate spans taken out of their texts; untouched texts and other columns stay as they are.

    n_chars, where there is one, follows the text.
    """
    names = docs.columns
    carried = F.struct(*[F.col(c) for c in names if c != "text"]).alias("carried_row")
    was_null = F.col("text").isNull().alias("carried_null")
    # Every field nullable, as what comes back from Python is.
    kind = StructType.fromDDL(f"carried {docs.select(carried).schema[0].dataType.simpleString()}")[0].dataType

    def make(rows: pa.Table, before: np.ndarray, after: np.ndarray, joined: pa.Array, found: tuple) -> list:
        changed = pa.array(before != after)
        text = pc.if_else(changed, joined.cast(pa.string()), rows.column("text").cast(pa.string()))
        return [rows.column("carried_row"), pc.if_else(rows.column("carried_null"), pa.scalar(None, pa.string()), text), changed]

    from pyspark.sql.pandas.types import to_arrow_type

    out = ["carried_row", "text", "changed"]
    plain = docs.select("doc_id", "text", carried, was_null)
    made = _run(plain, ["carried_row", "carried_null"], width, make, out, [to_arrow_type(kind), pa.string(), pa.bool_()], f"carried_row {kind.simpleString()}, text string, changed boolean")
    fresh = {"text": F.col("text")}
    if "n_chars" in names:
        fresh["n_chars"] = F.when(F.col("changed"), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("carried_row.n_chars"))
    return made.select(*[fresh.get(c, F.col(f"carried_row.`{c}`")).alias(c) for c in names])

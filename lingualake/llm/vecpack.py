"""Packing by vector bin packing: examples into sequences under limits on tokens, segments and loss-bearing tokens.

Within a task, documents are tokenised and packed in windows. The tokens at a document's head, its
prompt, bear no loss. A document longer than a sequence fills sequences of its own, each with as
much loss as is allowed and the rest of it from the prompt; what is left of it waits. A sequence is
filled from the waiting pieces: of those that fit, it takes the one whose demand has the largest dot
product with what is left of the sequence's limits, each dimension being a share of its limit. When
none fits whole, the one that fills most is cut and its rest goes back. Pieces alike in tokens and
loss stand in one stack, so a choice looks at kinds of pieces and not at each of them. A sequence
that can't be filled ends at a power of two, and so do the last ones of a task, so nothing is padded.

There is no shuffle. Sequence ids are the number of the task times 2**32 plus a count, so a task
that runs again gives the same ones.

Edge cases: a null or empty text is a document of the end id alone; repeated rows are documents of
their own; an empty table gives an empty result; extra columns are left out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, given_back
from .tokens import encoder


@dataclass(frozen=True)
class Limits:
    """Of a sequence: tokens (a power of two), documents' pieces, and tokens that bear loss."""

    tokens: int = 4096
    segments: int = 256
    loss: int = 3840


#: Tokens gathered before a window is packed.
WINDOW = 1 << 20

#: Of a document's tokens one in so many, at its head, is prompt where no column says how many are.
PROMPT_PART = 8


class Packer:
    """Takes documents as (key, tokens, tokens of the prompt); gives (key, start, length, loss, sequence, offset)."""

    def __init__(self, limits: Limits):
        self.limits = limits
        self.sequence = 0
        self.total = 0
        #: Kinds of waiting pieces (tokens, loss) and how many there are, and their stacks of (key, start).
        self.kind: dict[tuple[int, int], int] = {}
        self.tokens, self.loss, self.count = (np.zeros(64, np.int64) for _ in range(3))
        self.stacks: list[list[tuple]] = []

    def _wait(self, key, start: int, tokens: int, loss: int) -> None:
        k = self.kind.get((tokens, loss))
        if k is None:
            k = self.kind[tokens, loss] = len(self.stacks)
            self.stacks.append([])
            if k == len(self.count):
                self.tokens, self.loss, self.count = (np.concatenate((x, np.zeros_like(x))) for x in (self.tokens, self.loss, self.count))
            self.tokens[k], self.loss[k] = tokens, loss
        self.stacks[k].append((key, start))
        self.count[k] += 1
        self.total += tokens

    def _take(self, k: int) -> tuple:
        self.count[k] -= 1
        self.total -= int(self.tokens[k])
        return self.stacks[k].pop()

    def _sequence(self, pieces: list[tuple]) -> Iterator[tuple]:
        offset = 0
        for key, start, length, loss in pieces:
            yield key, start, length, loss, self.sequence, offset
            offset += length
        self.sequence += 1

    def add(self, key, tokens: int, prompt: int = 0) -> Iterator[tuple]:
        """The sequences that one document fills by itself; its rest waits."""
        size, most = self.limits.tokens, min(self.limits.loss, self.limits.tokens)
        prompt, at = min(prompt, tokens), 0
        spare, body = size - most, prompt
        while tokens - body >= most and prompt - at >= spare:
            if at + spare == body:
                pieces = [(key, at, size, most)]
            else:
                pieces = [(key, at, spare, 0)] * (spare > 0) + [(key, body, most, most)]
            if len(pieces) > self.limits.segments:
                break
            yield from self._sequence(pieces)
            at, body = at + spare, body + most
        while prompt - at >= size:
            yield from self._sequence([(key, at, size, 0)])
            at += size
        if body == prompt and at < tokens and tokens - at <= size and tokens - body <= most:
            self._wait(key, at, tokens - at, tokens - body)
            return
        if at < prompt:
            self._wait(key, at, prompt - at, 0)
        for x in range(body, tokens, most):
            n = min(most, tokens - x)
            self._wait(key, x, n, n)

    def pack(self, last: bool = False) -> Iterator[tuple]:
        """Pack what waits while it fills sequences; at the last call, all of it."""
        lim = self.limits
        while self.total >= (1 if last else lim.tokens):
            size = lim.tokens
            if self.total < size:
                size = 1 << (self.total.bit_length() - 1)  # the rest of a task goes out in powers of two
            inside: list[tuple] = []  # key, start, tokens, loss
            room, loss_room = size, lim.loss
            n = len(self.stacks)
            tokens, loss, count = self.tokens[:n], self.loss[:n], self.count[:n]
            while room and len(inside) < lim.segments:
                fit = np.flatnonzero((count > 0) & (tokens <= room) & (loss <= loss_room))
                if len(fit):
                    left = (room / lim.tokens**2, (lim.segments - len(inside)) / lim.segments**2, loss_room / lim.loss**2)
                    k = int(fit[np.argmax(tokens[fit] * left[0] + left[1] + loss[fit] * left[2])])
                    # With one kind to choose from, as many as fit at once.
                    many = 1 if len(fit) > 1 else min(int(count[k]), lim.segments - len(inside), room // int(tokens[k]), loss_room // int(loss[k]) if loss[k] else room)
                    t, s = int(tokens[k]), int(loss[k])
                    inside += [(*self._take(k), t, s) for _ in range(many)]
                    room, loss_room = room - many * t, loss_room - many * s
                    continue
                have = np.flatnonzero(count > 0)
                if not len(have):
                    break
                part = np.minimum(np.minimum(tokens[have] - loss[have] + loss_room, tokens[have]), room)
                k, take = int(have[np.argmax(part)]), int(part.max())
                if take <= 0:
                    break
                t, s = int(tokens[k]), int(loss[k])
                key, start = self._take(k)
                bears = max(0, take - (t - s))
                inside.append((key, start, take, bears))
                self._wait(key, start + take, t - take, s - bears)
                room, loss_room = room - take, loss_room - bears
                n = len(self.stacks)
                tokens, loss, count = self.tokens[:n], self.loss[:n], self.count[:n]
            if room and not last and size == lim.tokens and self.total < 2 * WINDOW:
                for key, start, t, s in inside:  # documents to come may fill it
                    self._wait(key, start, t, s)
                break
            used = size - room
            keep, done, pieces = 1 << (used.bit_length() - 1), 0, []
            for key, start, t, s in inside:
                take = min(t, keep - done)
                bears = max(0, take - (t - s))
                if take:
                    pieces.append((key, start, take, bears))
                    done += take
                if take < t:
                    self._wait(key, start + take, t - take, s - bears)
            yield from self._sequence(pieces)
        held = [(k, *piece, t, s) for (t, s), k in self.kind.items() for piece in self.stacks[k]]
        self.kind, self.stacks, self.total = {}, [], 0
        self.count[:] = 0
        for _, key, start, t, s in held:  # kinds without pieces are forgotten
            self._wait(key, start, t, s)

    def keys(self) -> set:
        """Documents of which pieces wait."""
        return {key for stack in self.stacks for key, _ in stack}


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, limits: Limits = Limits(), prompt: str | None = None, with_ids: bool = True) -> DataFrame:
    """docs (doc_id, text) to pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, loss and, with_ids, ids.

    tokenizer: path of the tokenizer's file, the same on all machines. prompt: a column with the number
    of tokens at a document's head that bear no loss; where it is null, and without one, the first
    1 / PROMPT_PART of the document's tokens. loss: loss-bearing tokens of the piece. ids: little-endian
    unsigned 32-bit integers.
    """
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss"] + ["ids"] * with_ids
    kinds = [pa.int64()] * 8 + [pa.binary()] * with_ids

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 32
        code, packer = encoder(tokenizer), Packer(limits)
        held: dict[int, tuple] = {}
        count = waiting = 0

        def rows(pieces) -> Iterator[pa.RecordBatch]:
            out: list[list] = [[] for _ in names]
            for key, start, length, loss, sequence, offset in pieces:
                doc_id, ids = held[key]
                own = ids[start : start + length].tobytes()
                values = (doc_id, start, length, zlib.crc32(own), len(ids), base + sequence, offset, loss, own)
                for column, v in zip(out, values, strict=False):
                    column.append(v)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names)

        for b in batches:
            ids, sizes = code.encode(b.column("text"), end_id)
            full: list[tuple] = []
            at = 0
            for doc_id, n, p in zip(b.column("doc_id").to_pylist(), sizes.tolist(), b.column("prompt").to_pylist(), strict=True):
                held[count] = (doc_id, ids[at : at + n].copy())
                full += packer.add(count, n, n // PROMPT_PART if p is None else max(0, p))
                at += n
                count += 1
            waiting += at
            yield from rows(full)
            if waiting >= WINDOW:
                yield from rows(packer.pack())
                held = {k: held[k] for k in packer.keys()}
                waiting = 0
        yield from rows(packer.pack(last=True))

    bounded_batches(docs.sparkSession)
    own = F.col(prompt).cast("long") if prompt else F.lit(None).cast("long")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), own.alias("prompt"))
    schema = ", ".join(f"{n} {'binary' if n == 'ids' else 'long'}" for n in names)
    return texts.mapInArrow(given_back(packed), schema)

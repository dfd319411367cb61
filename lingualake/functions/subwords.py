"""Subword tokenizers and batch embedders: token ids and vectors of whole texts, in Arrow batches.

A tokenizer is a file of the tokenizers library. The driver reads it and sends it with the plan, so that
workers need no shared folder. Batch embedders are registered by name: functions of a list of sequences of
token ids and their attention to a list of matrices, one row for each id.

Edge cases: null texts count as empty and have no tokens but special ones; rows without a sequence of ids have
no vectors; other columns than the ones named are left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: name -> function of (ids, attention) lists to matrices.
BATCH_EMBEDDERS: dict[str, Callable[[list[np.ndarray], list[np.ndarray]], list[np.ndarray]]] = {}


def batch_embedder(name: str):
    def put(f):
        BATCH_EMBEDDERS[name] = f
        return f

    return put


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", max_length: int | None = None, special: bool = True, pad: tuple[int, str] | None = None) -> DataFrame:
    """key, ids, tokens and attention of texts. Longer texts are cut to max_length tokens, special ones included, and
    with a pad (id, token) shorter ones are filled up to it with an attention of 0."""
    if pad is not None and max_length is None:
        raise ValueError("padding needs a length")
    body = Path(path).read_text(encoding="utf-8")
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        t = Tokenizer.from_str(body)
        t.no_padding()
        t.no_truncation()
        if max_length is not None:
            t.enable_truncation(max_length)
        if pad is not None:
            t.enable_padding(pad_id=pad[0], pad_token=pad[1], length=max_length)
        for b in batches:
            found = t.encode_batch(b.column("text").to_pylist(), add_special_tokens=special)
            columns = [b.column("key"), pa.array([e.ids for e in found], pa.list_(pa.int32())), pa.array([e.tokens for e in found], pa.list_(pa.string())), pa.array([e.attention_mask for e in found], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, ["key", "ids", "tokens", "attention"])

    return rows.mapInArrow(encoded, f"key {kind}, ids array<int>, tokens array<string>, attention array<int>").withColumnRenamed("key", key)


def ids_to_tokens(rows: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """rows with `tokens`, the vocabulary's entries of the ids; null for an id that it doesn't hold."""
    from tokenizers import Tokenizer

    vocabulary = Tokenizer.from_str(Path(path).read_text(encoding="utf-8")).get_vocab(with_added_tokens=True)
    entries = [""] * (max(vocabulary.values(), default=-1) + 1)
    held = np.zeros(len(entries), bool)
    for token, i in vocabulary.items():
        entries[i], held[i] = token, True

    @F.pandas_udf("array<string>")
    def tokens(lists):
        return lists.map(lambda x: None if x is None else [entries[i] if i is not None and 0 <= i < len(entries) and held[i] else None for i in x])

    return rows.withColumn("tokens", tokens(F.col(ids)))


def is_padding(token: Column, token_id: Column, attention: Column, pad: tuple[int, str] | None = None) -> Column:
    """Whether a token only fills up a sequence: no attention, or the pad's id or text. Unknown tokens are no padding."""
    out = attention == 0
    if pad is not None:
        out = out | (token_id == pad[0]) | (token == pad[1])
    return F.coalesce(out, F.lit(False))


def token_rows(encoded: DataFrame, key: str = "doc_id", pad: tuple[int, str] | None = None, unknown: str | None = None) -> DataFrame:
    """key, pos, token, token_id and is_unknown of the tokens that aren't padding; places count the whole sequence."""
    each = F.arrays_zip("tokens", "ids", "attention")
    rows = encoded.select(key, F.posexplode(each).alias("pos", "t")).select(key, "pos", F.col("t.tokens").alias("token"), F.col("t.ids").alias("token_id"), F.col("t.attention").alias("attention"))
    rows = rows.filter(~is_padding(F.col("token"), F.col("token_id"), F.col("attention"), pad)).drop("attention")
    return rows.withColumn("is_unknown", F.col("token") == unknown if unknown is not None else F.lit(False))


def embed(encoded: DataFrame, name: str, key: str = "doc_id", pad: tuple[int, str] | None = None, least: float = 1e-10) -> DataFrame:
    """key, pos, token, vec of encoded texts by a batch embedder, each token in the context of its sequence.

    Padding and vectors of a length below `least` are dropped; unknown tokens stay.
    """
    if name not in BATCH_EMBEDDERS:
        raise ValueError(f"no batch embedder named {name!r}; known: {', '.join(sorted(BATCH_EMBEDDERS))}")
    f = BATCH_EMBEDDERS[name]
    rows = encoded.select(F.col(key).alias("key"), "ids", "tokens", "attention").filter("ids IS NOT NULL")
    kind = rows.schema["key"].dataType.simpleString()

    def embedded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [np.array(x, np.int32) for x in b.column("ids").to_pylist()]
            matrices = f(ids, [np.array(x, np.int32) for x in b.column("attention").to_pylist()])
            vectors = [np.asarray(m, float).tolist() for m in matrices]
            columns = [*(b.column(c) for c in ("key", "ids", "tokens", "attention")), pa.array(vectors, pa.list_(pa.list_(pa.float64())))]
            yield pa.RecordBatch.from_arrays(columns, ["key", "ids", "tokens", "attention", "vecs"])

    made = rows.mapInArrow(embedded, f"key {kind}, ids array<int>, tokens array<string>, attention array<int>, vecs array<array<double>>")
    each = made.select("key", F.posexplode(F.arrays_zip("tokens", "ids", "attention", "vecs")).alias("pos", "t"))
    each = each.filter(~is_padding(F.col("t.tokens"), F.col("t.ids"), F.col("t.attention"), pad))
    size = F.aggregate("t.vecs", F.lit(0.0), lambda s, x: s + x * x)
    return each.filter(size >= least * least).select(F.col("key").alias(key), "pos", F.col("t.tokens").alias("token"), F.col("t.vecs").alias("vec"))


@batch_embedder("hash")
def hashed(ids: list[np.ndarray], attention: list[np.ndarray], dimensions: int = 16) -> list[np.ndarray]:
    """A stand-in without a model: a fixed vector of each id, half its own and half the mean of its sequence's."""
    out = []
    for x, a in zip(ids, attention, strict=True):
        seeds = (x[:, None].astype(np.uint64) + np.uint64(1)) * (np.arange(1, dimensions + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        own = (seeds >> np.uint64(32)).astype(float) / 2.0**31 - 1
        seen = own[a > 0]
        out.append((own + seen.mean(axis=0)) / 2 if len(seen) else own)
    return out

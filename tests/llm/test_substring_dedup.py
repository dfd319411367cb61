import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from lingualake.llm import rlz

from .fixtures import documents, rows


def brute(data, width):
    docs = sorted(((-(1 << 63) if i is None else i, t or "", i) for i, t, *_ in data), key=lambda x: x[:2])
    seen, out = set(), []
    for _, text, i in docs:
        words = text.encode().split()
        gone = set()
        for a in range(len(words) - width + 1):
            w = tuple(words[a : a + width])
            if w in seen:
                gone.update(range(a, a + width))
            seen.add(w)
        kept = [w for k, w in enumerate(words) if k not in gone]
        out.append((i, len(words), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("width", [20, 7])
def test_spans_match_brute_force(spark, width):
    got = rlz.spans(documents(spark, clash=True), width)
    assert sorted((tuple(r)[:4] for r in got.collect()), key=repr) == brute(rows(), width)


def test_factors_cover_what_is_removed(spark):
    for r in rlz.spans(documents(spark)).collect():
        covered = {w for f in r["factors"] for w in range(f["start"], f["start"] + f["length"])}
        assert len(covered) == r["n_removed"]
        assert all(f["length"] >= rlz.WIDTH for f in r["factors"])


def test_dedup_keeps_columns_and_untouched_texts(spark):
    docs = documents(spark, clash=True)
    got = rlz.dedup(docs)
    assert got.columns == docs.columns
    found = [r.asDict() for r in got.collect()]
    assert len(found) == docs.count()
    before = {(r["doc_id"], r["text"]) for r in docs.collect()}
    assert sum((r["doc_id"], r["text"]) in before for r in found) > len(found) / 2
    assert any(r["text"] is None for r in found)
    assert all(r["n_chars"] is None or r["n_chars"] == len(r["text"]) for r in found)


def test_empty_table(spark):
    assert rlz.spans(documents(spark, [])).count() == 0
    assert rlz.dedup(documents(spark, [])).count() == 0


def test_texts_of_a_block_are_hashed_together(monkeypatch):
    """Array operations go with the bytes of a block, not with its documents."""
    calls = []
    monkeypatch.setattr(rlz, "rolling", lambda *a, f=rlz.rolling: calls.append(1) or f(*a))
    texts = [" ".join(f"w{(i * j) % 97}" for j in range(60)) for i in range(400)]
    block = pa.table({"block": pa.array([0] * 400, pa.int32()), "key": pa.array(range(400), pa.int64()), "text": texts, "carried_id": pa.array(range(400), pa.int64())})
    sent = rlz._anchors(1, 20)((pa.scalar(0),), block)
    told = rlz._shared_anchors(sent)
    assert told.num_rows
    rlz._indexed(1, 20)((pa.scalar(0),), block, told)
    assert len(calls) < 20


def test_pieces_split_as_bytes_do(monkeypatch):
    monkeypatch.setattr(rlz, "PIECE_BYTES", 16)
    texts = ["", " a  b\n", "\t\x0b\x0c\r ", "c\x1cd \u00a0e\u2003f \x85", "x" * 99, "g\x00h i", "", "\u4e2d\u6587 \U0001f600"]
    column = pa.chunked_array([texts[:3], [], texts[3:]], pa.string())
    found, hashes = [], []
    parts = list(rlz.pieces(column))
    assert len(parts) > 2
    for part in parts:
        words, bounds = rlz.split(part)
        every = words.to_pylist()
        found += [every[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        hashes += rlz.hashed(words).tolist()
    assert found == [x.encode().split() for x in texts]
    assert len(set(hashes)) == len({w for x in found for w in x})


def test_sorted_tells_windows_that_share_64_bits_apart():
    first, second = np.array([5, 5, 1, 5, 1, 5], np.uint64), np.array([2, 1, 0, 2, 0, 1], np.uint32)
    order, begin = rlz._sorted(first, second)
    assert order.tolist() == [2, 4, 1, 5, 0, 3]
    assert begin.tolist() == [True, False, True, False, True, False]


def test_passages_repeat_across_pieces_of_a_block(spark):
    draw = random.Random(8)
    phrases = [" ".join(f"p{k}w{j}" for j in range(25)) for k in range(12)]
    data = []
    for i in range(48):
        long = chr(97 + i % 26) * (rlz.PIECE_BYTES // 5)
        data.append((i, "  ".join([long, *draw.sample(phrases, 2), f"tail {i}"])))
    docs = spark.createDataFrame(data, "doc_id long, text string")
    assert sorted((tuple(r)[:4] for r in rlz.spans(docs).collect()), key=repr) == brute(data, 20)

import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lingualake.llm import repair, vecpack
from lingualake.llm.common import shared_path
from lingualake.llm.tokens import Encoder, encoder
from lingualake.llm.vecpack import Limits, Packer

from .fixtures import documents, rows, texts

ODD = ["", "  ", " a", "a ", "a  b", "x\n y", "\n", "a\u00a0b", "it's  they're'S 'll", "<|endoftext|> a<|endoftext|>b <|endoftext|>", "a\t\tb \t c", "é ́x", "ΑΣ ΑΣ.", "123 45a6 !!?? '' ' s", "x\u3000 y", "\u0085 a"]
FILES = ["byte_bpe_50k.json", "word_bpe_49k.json"]


def ids_of(name, text):
    return np.asarray(Tokenizer.from_file(public_tokenizers.path(name)).encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@pytest.mark.parametrize("name", FILES)
def test_pieces_give_the_librarys_ids(name):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    all_texts = texts() + ODD
    want = [t.encode(x, add_special_tokens=False).ids for x in all_texts]
    e = Encoder(public_tokenizers.path(name))
    for end in (None, 2):
        ids, sizes = e.encode(all_texts, end)
        assert ids.tolist() == [i for x in want for i in [*x, *([2] if end else [])]]
        assert sizes.tolist() == [len(x) + bool(end) for x in want]
    assert len(e.encode([])[0]) == 0


@pytest.mark.parametrize("name", FILES)
def test_memory_of_words_is_bounded(name, monkeypatch):
    monkeypatch.setattr(Encoder, "LIMIT", 5)
    t, e = Tokenizer.from_file(public_tokenizers.path(name)), Encoder(public_tokenizers.path(name))
    for x in texts() + ODD:
        assert e.encode([x])[0].tolist() == t.encode(x, add_special_tokens=False).ids
        assert len(e.known) == len(e.size) <= 5


SIGNS = "ab Zé\u00e9İıß\u0301\n\t\r\u00a0\u3000.,!?$'s1²½ªǅДщ日\u200b\x00<|endoftext|>"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from(SIGNS) | st.characters(), max_size=40), min_size=1, max_size=6), st.sampled_from(FILES))
def test_any_text_gives_the_librarys_ids(some, name):
    e = encoder(public_tokenizers.path(name))
    some = [x.encode("utf-8", "replace").decode() for x in some]
    assert e.encode(some)[0].tolist() == [i for x in some for i in e.tokenizer.encode(x, add_special_tokens=False).ids]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 6) | st.integers(0, 60_000), max_size=400), st.integers(0, 400), st.integers(0, 400))
def test_grammar_round_trip(ids, a, b):
    a, b = min(a, b), max(a, b)
    shard = repair.Shard(repair.compress(np.array(ids, np.uint32), least=2))
    assert shard.decode().tolist() == ids
    assert shard.slice(a, b).tolist() == ids[a:b]


def test_token_files(spark):
    data = rows()
    path = shared_path(spark, "test-shards")
    repair.write(documents(spark, data, clash=True), public_tokenizers.path(FILES[0]), path, shard=5000)
    got = [tuple(r) for r in repair.digest(repair.read(spark, path)).collect()]
    at, want = 0, []
    for _, text, i in sorted(((-(1 << 63) if i is None else i, t or "", i) for i, t, *_ in data), key=lambda x: x[:2]):
        ids = ids_of(FILES[0], text) + (2).to_bytes(4, "little")
        want.append((i, at, len(ids) // 4, zlib.crc32(ids)))
        at += len(ids) // 4
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert spark.read.parquet(path).count() > 3


def test_no_documents(spark):
    path = shared_path(spark, "test-none")
    repair.write(documents(spark, []), public_tokenizers.path(FILES[0]), path)
    assert repair.digest(repair.read(spark, path)).count() == 0
    assert vecpack.pack(documents(spark, []), public_tokenizers.path(FILES[1])).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 300), st.integers(0, 40)), max_size=80), st.sampled_from([Limits(64, 4, 40), Limits(64, 64, 10), Limits(128, 3, 128), Limits(16, 2, 1)]))
def test_packing_keeps_all_limits(docs, limits):
    packer, out = Packer(limits), []
    for k, (n, prompt) in enumerate(docs):
        out += packer.add(k, n, prompt)
        if k % 25 == 24:
            out += packer.pack()
    out += packer.pack(last=True)
    covered, sequences = {}, {}
    for k, start, length, loss, sequence, offset in out:
        assert loss == max(0, start + length - max(start, docs[k][1]))
        covered.setdefault(k, []).append((start, length))
        sequences.setdefault(sequence, []).append((offset, length, loss))
    for k, (n, _) in enumerate(docs):
        at = 0
        for start, length in sorted(covered[k]):
            assert start == at and length > 0
            at += length
        assert at == n
    for own in sequences.values():
        at = 0
        for offset, length, _ in sorted(own):
            assert offset == at
            at += length
        assert at <= limits.tokens and (at == limits.tokens or at & (at - 1) == 0)
        assert len(own) <= limits.segments
        assert sum(loss for *_, loss in own) <= limits.loss


def test_each_choice_has_the_largest_dot_product():
    """Against a plain search over all waiting pieces, as long as nothing is cut."""
    rng = np.random.RandomState(3)
    limits = Limits(4096, 40, 3000)
    docs = [(int(n), int(n * rng.rand())) for n in rng.randint(1, 900, 400)]
    packer = Packer(limits)
    for k, (n, prompt) in enumerate(docs):
        assert not list(packer.add(k, n, prompt))
    got = {}
    for k, _, length, _, sequence, offset in packer.pack(last=True):
        got.setdefault(sequence, []).append((offset, k, length))
    left = {k: (n, n - p) for k, (n, p) in enumerate(docs)}
    room, loss_room, seats = limits.tokens, limits.loss, limits.segments
    for _, k, length in sorted(got[0]):
        fit = {j: d for j, d in left.items() if d[0] <= room and d[1] <= loss_room}
        if not fit or left[k][0] != length:
            break
        worth = lambda d: d[0] * room / 4096**2 + seats / 40**2 + d[1] * loss_room / 3000**2
        assert worth(left[k]) == pytest.approx(max(map(worth, fit.values())))
        room, loss_room, seats = room - left[k][0], loss_room - left[k][1], seats - 1
        del left[k]
    assert len(left) < 400 - 3


def test_a_hundred_thousand_short_pieces_take_little_time():
    packer, begun = Packer(Limits()), time.process_time()
    for k in range(100_000):
        list(packer.add(k, 1))
    out = list(packer.pack(last=True))
    assert sum(x[2] for x in out) == 100_000 and max(x[2] for x in out) == 1
    assert time.process_time() - begun < 5


def test_pack_query(spark):
    data = rows()
    got = vecpack.pack(documents(spark, data, clash=True), public_tokenizers.path(FILES[1])).collect()
    docs = {}
    for i, t, *_ in data:
        docs.setdefault(i, []).append(ids_of(FILES[1], t or "") + (2).to_bytes(4, "little"))
    assert sum(r["length"] for r in got) == sum(len(x) // 4 for v in docs.values() for x in v)
    for r in got:
        assert zlib.crc32(r["ids"]) == r["ids_crc32"]
        assert any(x[r["start"] * 4 : (r["start"] + r["length"]) * 4] == bytes(r["ids"]) and len(x) // 4 == r["doc_tokens"] for x in docs[r["doc_id"]])
    size = {}
    for r in got:
        size[r["sequence_id"]] = size.get(r["sequence_id"], 0) + r["length"]
    assert all(n <= 4096 and (n & (n - 1)) == 0 for n in size.values())
    loss = {}
    for r in got:
        loss[r["sequence_id"]] = loss.get(r["sequence_id"], 0) + r["loss"]
        assert r["loss"] == max(0, r["start"] + r["length"] - max(r["start"], r["doc_tokens"] // vecpack.PROMPT_PART))
    assert max(loss.values()) <= Limits().loss


def test_a_column_may_name_the_prompt(spark):
    docs = documents(spark).withColumn("asked", F.when(F.col("doc_id") % 2 == 0, F.lit(7)))
    for r in vecpack.pack(docs, public_tokenizers.path(FILES[1]), prompt="asked").collect():
        prompt = 7 if r["doc_id"] is not None and r["doc_id"] % 2 == 0 else r["doc_tokens"] // vecpack.PROMPT_PART
        assert r["loss"] == max(0, r["start"] + r["length"] - max(r["start"], prompt))


def test_grammar_goes_on_until_no_pair_is_frequent(monkeypatch):
    rng = np.random.RandomState(5)
    passage = rng.randint(0, 5000, 700)
    ids = np.concatenate([x for _ in range(20) for x in (passage, rng.randint(0, 5000, 150))] + [np.full(900, 7)]).astype(np.uint32)
    shard = repair.Shard(repair.compress(ids))
    pairs = (shard.symbols[:-1].astype(np.uint64) << np.uint64(32)) | shard.symbols[1:]
    assert np.unique(pairs, return_counts=True)[1].max() < repair.LEAST
    assert (shard.decode() == ids).all() and shard.sizes.max() > 32
    assert [len(shard._expand(np.array([shard.first + k], np.uint32))) for k in range(len(shard.sizes))] == shard.sizes.tolist()
    monkeypatch.setattr(repair, "STEP", 16)
    shard = repair.Shard(repair.compress(ids))
    looked, lengths = [], repair._lengths
    monkeypatch.setattr(repair, "_lengths", lambda symbols, *a: looked.append(len(symbols)) or lengths(symbols, *a))
    for a, b in [(0, 1), (0, len(ids)), (len(ids) - 1, len(ids) + 5), (5, 5), *(sorted(rng.randint(0, len(ids), 2)) for _ in range(300))]:
        looked.clear()
        assert (shard.slice(a, b) == ids[a:b]).all()
        assert sum(looked) <= max(0, b - a) + 2 * 16

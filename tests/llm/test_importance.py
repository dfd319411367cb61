import hashlib
import math
import zlib

from lingualake.llm import importance as I
from lingualake.llm.common import pieces
from lingualake.llm.licenses import words_of
from pyspark.sql import functions as F

from .fixtures import documents, rows


def runs(words, n):
    return [" ".join(words[i : i + k]) for k in range(1, n + 1) for i in range(len(words) - k + 1)]


def plain(data, target, n=1, buckets=I.BUCKETS):
    """Rows of the draw by loops over lists."""
    found = [(i, runs(words_of(t or ""), n), len(words_of(t or ""))) for i, t, *_ in data]
    place = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = [0] * buckets, [0] * buckets
    for _, fs, _ in found:
        for f in fs:
            s[place(f)] += 1
    for text in target:
        for f in runs(words_of(text or ""), n):
            t[place(f)] += 1
    gain = [math.floor(1000 * math.log((y + 1) * (sum(s) + buckets) / ((x + 1) * (sum(t) + buckets)))) for x, y in zip(s, t, strict=True)]
    out = []
    for i, fs, size in found:
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[place(f)] for f in fs)
        out.append([i, size, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    fit = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], math.inf if r[0] is None else r[0]))
    for k, r in enumerate(fit[: 10 * len(fit) // 100]):
        r[5] = k + 1
    return sorted(map(tuple, out), key=repr)


TARGET = ["abc the fed", "bad cafe head bad cafe", None, "", "gag bee"]


def drawn(spark, data, **more):
    target = spark.createDataFrame([(t,) for t in TARGET], "text string")
    return sorted(map(tuple, I.resample(documents(spark, data, clash=True), target, **more).collect()), key=repr)


def test_rows_match_loops(spark):
    got = drawn(spark, rows())
    assert got == plain(rows(), TARGET)
    assert sum(r[-1] is not None for r in got) == 10 * sum(r[1] >= 20 for r in got) // 100 > 0


def test_chunks_count_each_feature_once(spark):
    # Few buckets, texts of many chunks, features over the cuts, a word longer than a chunk.
    data = [*rows(n=20), (700, "x" * 500 + " tail of it " + "y" * 300, "en", "s", 1), (701, " \n" * 200, "en", "s", 1), (702, "--" + "Ä b;" * 150, "en", "s", 1)]
    assert drawn(spark, data, n=3, buckets=97, limit=100) == plain(data, TARGET, 3, 97)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert I.resample(none, none).count() == 0
    (one,) = I.resample(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), none).collect()
    assert one["rank"] is None and one["n_features"] == 2


def test_pieces_hold_all_words_and_their_neighbours(spark):
    text = " ".join(f"w{i}" for i in range(200)) + "  \t end" + "z" * 90
    df = spark.createDataFrame([(text,), ("short  text",), (None,), (" " * 90,)], "text string")
    got = [r["p"] for r in df.select(pieces(F.col("text"), r"\x20\x09-\x0D", 50, before=2, after=3).alias("p")).collect()]
    words, at = text.split(), 0
    for p in got[0]:
        own = p["own"].split()
        assert own == words[at : at + len(own)]
        assert p["head"].split() == words[max(at - 2, 0) : at] and p["tail"].split() == words[at + len(own) : at + len(own) + 3]
        at += len(own)
    assert at == len(words) and len(got[0]) == got[0][0]["of"] > 10
    assert [(p["own"], p["head"], p["tail"]) for p in got[1]] == [("short  text", "", "")] and len(got[3]) == 1

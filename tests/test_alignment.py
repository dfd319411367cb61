import itertools
import random

import numpy as np
from lingualake.functions import text as T
from lingualake.operators import alignment as A
from pyspark.sql import functions as F


def plain_best(e, tokens, blank=0):
    """The likeliest of all label sequences that read as the tokens."""
    best = -np.inf
    for path in itertools.product(range(e.shape[1]), repeat=len(e)):
        read = [x for i, x in enumerate(path) if x != blank and (i == 0 or path[i - 1] != x)]
        if read == tokens:
            best = max(best, sum(e[i, x] for i, x in enumerate(path)))
    return best


def test_alignment_is_the_likeliest_path():
    rng = np.random.RandomState(2)
    for _ in range(60):
        e = np.log(rng.dirichlet(np.ones(3), size=rng.randint(1, 8)))
        tokens = rng.randint(1, 3, size=rng.randint(1, 4)).tolist()
        want, got = plain_best(e, tokens), A.align(e, tokens)
        if want == -np.inf:
            assert got is None
            continue
        path = np.zeros(len(e), int)
        for t, (a, z) in zip(tokens, got, strict=True):
            path[a:z] = t
        assert all(x < y <= z for (x, y), (z, _) in zip(got, [*got[1:], (len(e), 0)], strict=True))
        assert abs(sum(e[i, x] for i, x in enumerate(path)) - want) < 1e-9
    assert A.align(np.zeros((0, 3)), [1]) is None and A.align(np.zeros((2, 3)), [1, 1]) is None


def test_word_times_and_fallback(spark):
    labels = "-ab'c"
    spoken = "--aab--cc-"
    rows = [("x", i, [0.0 if k == c else -9.0 for k in labels]) for i, c in enumerate(spoken)]
    rows += [("few", 0, [0.0] * 5)]
    e = spark.createDataFrame(rows, "file_id string, frame int, scores array<double>").repartition(3)
    texts = spark.createDataFrame([("x", "Äb, Ç!", 10.0), ("few", "abc", None), ("none", "ab", 0.0), ("zz", "7 !", 0.0)], "file_id string, transcript string, start_time double")
    got = sorted(tuple(r) for r in A.word_times(e, texts, "file_id", labels, 0.5).collect())
    assert got == [("x", 0, "ab", 11.0, 12.5), ("x", 1, "c", 13.5, 14.5)]
    heard = spark.createDataFrame([("x", 0, "no", 0.0, 1.0), ("few", 0, "abc", 0.0, 1.0)], "file_id string, word_idx int, word string, start_time double, end_time double")
    even = spark.createDataFrame([(k, 0, "even", 0.0, 1.0) for k in ("x", "few", "none")], heard.schema)
    all_ = A.with_fallback(A.word_times(e, texts, "file_id", labels, 0.5), heard, even, key="file_id")
    assert sorted((r["file_id"], r["word"]) for r in all_.collect()) == [("few", "abc"), ("none", "even"), ("x", "ab"), ("x", "c")]


def test_romanized_letters(spark):
    df = spark.createDataFrame([("Où ça? Straße, été — L’œuf Ảnh ñ 3",)], "t string")
    assert df.select(T.alignment_text("t")).first()[0] == "ou ca strasse ete l'oeuf anh n"


def plain_linked(v, clusters, threshold):
    """Mean distances over all pairs, worked out anew for each merge."""
    unit = [x / np.linalg.norm(x) if np.linalg.norm(x) else x for x in v]
    groups = [[i] for i in range(len(v))]
    while len(groups) > clusters:
        def far(pair):
            return round(float(np.mean([1 - unit[i] @ unit[j] for i in groups[pair[0]] for j in groups[pair[1]]])), 9)

        a, b = min(itertools.combinations(range(len(groups)), 2), key=lambda p: (far(p), groups[p[0]][0], groups[p[1]][0]))
        if threshold is not None and far((a, b)) > threshold:
            break
        groups[a] = sorted(groups[a] + groups[b])
        del groups[b]
        groups.sort()
    of = {i: k for k, g in enumerate(groups) for i in g}
    return [of[i] for i in range(len(v))]


def test_linkage_matches_plain_merging():
    rng = random.Random(4)
    for _ in range(40):
        n = rng.randint(1, 14)
        v = np.array([[rng.choice([0, 1, 2, -1]) + (0 if rng.random() < 0.5 else rng.random()) for _ in range(3)] for _ in range(n)], float)
        k = rng.randint(1, 4)
        assert A.linked(v, k).tolist() == plain_linked(v, k, None)
        assert A.linked(v, 1, 0.6).tolist() == plain_linked(v, 1, 0.6)


def test_diarized_segments(spark):
    a, b = [1.0, 0.0], [0.0, 1.0]
    rows = [("r", 0.0, 1.0, a), ("r", 1.0, 2.0, a), ("r", 2.0, 3.0, b), ("r", 5.0, 6.0, b), ("r", 6.0, 7.0, a), ("q", 0.0, 1.0, b), ("n", 0.0, 1.0, None)]
    s = spark.createDataFrame(rows, "file_id string, start double, end double, vec array<double>").repartition(3)
    got = sorted(tuple(r) for r in A.diarize(s, "file_id", 2, gap=0.5).collect())
    assert got == [("q", 0, 0.0, 1.0, "SPEAKER_00"), ("r", 0, 0.0, 2.0, "SPEAKER_00"), ("r", 1, 2.0, 3.0, "SPEAKER_01"), ("r", 2, 5.0, 6.0, "SPEAKER_01"), ("r", 3, 6.0, 7.0, "SPEAKER_00")]
    assert {r["speaker"] for r in A.diarize(s, "file_id", threshold=0.5).collect()} == {"SPEAKER_00", "SPEAKER_01"}
    assert A.diarize(s.filter(F.lit(False)), "file_id", 2).count() == 0


def test_linkage_memory_grows_with_the_vectors_only():
    import tracemalloc

    v = np.random.default_rng(5).normal(size=(6000, 8))
    tracemalloc.start()
    own = A.linked(v, 4)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sorted(set(own.tolist())) == [0, 1, 2, 3] and peak < 6000 * 6000 * 8 / 4


def test_ties_copies_and_zeros_merge_as_one_by_one():
    rng = np.random.default_rng(7)
    for _ in range(20):
        n = int(rng.integers(2, 16))
        v = rng.normal(size=(4, 3))[rng.integers(0, 4, n)] * rng.integers(0, 2, size=(n, 1))
        for k, most in ((1, None), (3, None), (1, 0.5), (2, 1.0)):
            assert A.linked(v, k, most).tolist() == plain_linked(v, k, most)
    assert A.linked(np.array([[1.0, np.nan], [1.0, 0.0], [1.0, 0.0]]), 1).tolist() == [0, 1, 2]


def test_long_recordings_merge_in_rounds(spark, monkeypatch):
    rng = np.random.default_rng(11)
    rows = [(k, float(i), i + 1.0, v) for k, n in (("a", 90), ("b", 40), ("c", 12), (None, 3)) for i, v in enumerate(rng.normal(size=(n, 4)).tolist())]
    rows += [("d", float(i), i + 1.0, [1.0, 0.0, 0.0, 0.0] if i % 3 else [0.0, 0.0, 0.0, float(i % 2)]) for i in range(50)]
    rows += [("e", float(i), i + 1.0, [1.0, float("nan") if i == 7 else 1.0, float(i), 0.0]) for i in range(20)]
    s = spark.createDataFrame(rows, "file_id string, start double, end double, vec array<double>").repartition(3)
    speakers = lambda **how: sorted(map(tuple, A.diarize(s, "file_id", **how).collect()), key=str)
    ways = ({"speakers": 3}, {"threshold": 0.5}, {"speakers": 4, "gap": 1.5})
    want = [speakers(**w) for w in ways]
    calls = []
    rounds = A.merged_in_rounds
    monkeypatch.setattr(A, "CELL", 16)
    monkeypatch.setattr(A, "merged_in_rounds", lambda *a: calls.append(a) or rounds(*a))
    assert [speakers(**w) for w in ways] == want and len(calls) == len(ways)
    merged = rounds(calls[0][0], "file_id").filter("into IS NOT NULL").groupBy("file_id").count().collect()
    assert {r["file_id"] for r in merged} == {"a", "b", "d"} and all(r["count"] > 10 for r in merged)

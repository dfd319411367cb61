import random

import numpy as np
import pytest
from lingualake.operators import acoustics as A
from pyspark.sql import functions as F

RATE = 8000
S = A.Settings()


def made(source, i):
    return 0.3 * np.sin(2 * np.pi * source * i / RATE) + 0.1 * np.sin(4 * np.pi * source * i / RATE)


@pytest.mark.parametrize("sizes", [[800] * 6 + [90], [1210, 640, 900, 333], [500], [241, 240, 500]])
def test_frames_of_made_samples_are_those_of_given_ones(spark, sizes):
    rng = random.Random(4)
    rows = [(k, i, RATE, rng.choice([0.0, 110.0, 233.3, 480.0]), n) for k in ("a", "b", "c") for i, n in enumerate(sizes)]
    blocks = spark.createDataFrame(rows, "k string, block int, rate int, source double, size int")
    given = A.overlapped(spark.createDataFrame([(k, i, r, made(x, np.arange(n)).tolist()) for k, i, r, x, n in rows], "k string, block int, rate int, samples array<double>"), "k")
    made_ones = A.neighbours(blocks, "k")
    for a, b in ((A.loudest(made_ones, "k", made=made), A.loudest(given, "k")), (A.frames(made_ones, "k", made=made), A.frames(given, "k"))):
        a, b = (sorted(map(tuple, x.collect())) for x in (a, b))
        assert len(a) == len(b) and [x[:1] for x in a] == [x[:1] for x in b]
        for x, y in zip(a, b, strict=True):
            for v, w in zip(x[1:], y[1:], strict=True):
                assert (v is None) == (w is None) and (v is None or np.allclose(v, w))
    assert A.frames(made_ones, "k", made=made).groupBy("k").agg(F.count("*"), F.min("frame"), F.max("frame")).distinct().count() == 3


def test_paths_of_many_pieces_are_those_of_each_alone():
    rng = random.Random(7)
    pieces = []
    for n in [1, 2, 9, 40, 5, 1, 30]:
        hz = [np.array([rng.uniform(80, 500) for _ in range(rng.choice([0, 0, 1, 3, 6]))]) for _ in range(n)]
        pieces.append((hz, [np.array([rng.random() for _ in h]) for h in hz], np.array([rng.choice([0.0, 0.01, 1.0]) for _ in range(n)]), rng.choice([0.0, 0.5, 1.0])))
    alone = [A.best_path(*p, S) for p in pieces]
    hz, strength = (np.concatenate([x for p in pieces for x in p[j]]) for j in (0, 1))
    counts = np.array([len(h) for p in pieces for h in p[0]])
    begin = np.cumsum([0, *(len(p[0]) for p in pieces)])[:-1]
    loudest = np.concatenate([np.full(len(p[0]), p[3]) for p in pieces])
    together = A.best_paths(hz, strength, counts, np.concatenate([p[2] for p in pieces]), loudest, begin, S)
    assert together.tolist() == np.concatenate(alone).tolist() and (together >= 0).any() and (together < 0).any()


def test_a_frame_of_no_numbers_is_unvoiced_and_the_path_goes_on():
    hz = [np.array([200.0, 100.0]), np.array([]), np.array([200.0]), np.array([210.0])]
    strength = [np.array([0.9, 0.5]), np.array([]), np.array([0.9]), np.array([0.9])]
    assert A.best_path(hz, strength, np.array([1.0, np.nan, 1.0, 1.0]), 1.0, S).tolist() == [0, -1, 0, 0]


def plain_cycles(x, period):
    marks = [int(np.argmax(x))]
    for way in (1, -1):
        at = marks[0]
        while True:
            lo, hi = sorted((at + way * round(0.8 * period), at + way * round(1.2 * period)))
            if lo < 0 or hi >= len(x):
                break
            at = lo + int(np.argmax(x[lo : hi + 1]))
            marks.append(at)
    places, tops = [], []
    for i in sorted(marks):
        d, top = 0.0, x[i]
        if 0 < i < len(x) - 1 and x[i - 1] - 2 * x[i] + x[i + 1] < 0:
            d = 0.5 * (x[i - 1] - x[i + 1]) / (x[i - 1] - 2 * x[i] + x[i + 1])
            top = x[i] - 0.25 * (x[i - 1] - x[i + 1]) * d
        places.append(i + d)
        tops.append(top)
    gaps, tops = np.diff(places), np.array(tops)
    if len(gaps) < 2 or (tops <= 0).any():
        return np.nan, np.nan
    return np.abs(np.diff(gaps)).mean() / gaps.mean(), np.abs(20 * np.log10(tops[1:] / tops[:-1])).mean()


def test_cycles_of_many_rows_are_those_of_each_alone():
    rng = np.random.RandomState(3)
    hz = np.concatenate([rng.uniform(75, 600, 60), [75.0, 600.0, 100.0]])
    rows = np.stack([0.3 * np.sin(2 * np.pi * f * np.arange(480) / RATE) + rng.choice([0.0, 0.02, 0.4]) * rng.randn(480) - rng.choice([0.0, 0.3]) for f in hz])
    rows[-1] = 0.0
    found = np.stack(A.cycles_of_rows(rows, RATE / hz), axis=1)
    plain = np.array([plain_cycles(x, RATE / f) for x, f in zip(rows, hz, strict=True)])
    assert np.allclose(found, plain, equal_nan=True) and 5 < np.isnan(plain[:, 0]).sum() < 60


def test_functionals_work_on_the_frames_once(spark):
    rows = [("a", k, v, 100.0 + k if v else None, 0.9) for k, v in enumerate([True, True, False, True, False, False, False, True])] + [("b", 0, False, None, None)]
    t = spark.createDataFrame([(k, n, hz, s) for k, n, _, hz, s in rows], "k string, frame long, hz double, strength double")
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    t = t.withColumns({c: F.col("frame") * 1.0 for c in (*A.SPECTRAL, *A.CYCLES)})
    found = {r["k"]: r for r in A.functionals(t.mapInArrow(counted, t.schema), "k").collect()}
    assert seen.value == len(rows)
    a, b = found["a"], found["b"]
    assert np.allclose([a["mean_voiced_segment_sec"], a["stddev_voiced_segment_sec"]], [0.04 / 3, np.std([0.02, 0.01, 0.01])])
    assert np.allclose([a["mean_unvoiced_segment_sec"], a["stddev_unvoiced_segment_sec"]], [0.02, 0.01])
    assert b["mean_voiced_segment_sec"] is None and np.isclose(b["mean_unvoiced_segment_sec"], 0.01) and b["f0_semitone_p50"] is None

import math
import random

import numpy as np
import pytest
from lingualake.operators import acoustics as A

RATE = 8000
S = A.Settings()


def blocks(spark, signals, size=4000):
    rows = [(k, i, RATE, x[a : a + size].tolist()) for k, x in signals.items() for i, a in enumerate(range(0, len(x), size))]
    return A.overlapped(spark.createDataFrame(rows, "file_id string, block int, rate int, samples array<double>"), "file_id")


def tone(hz, seconds=1.0):
    """A tone with overtones; hz is a number or a value for each sample."""
    hz = np.broadcast_to(np.asarray(hz, float), int(seconds * RATE))
    phase = 2 * np.pi * np.cumsum(hz) / RATE
    return 0.3 * np.sin(phase) + 0.15 * np.sin(2 * phase) + 0.1 * np.sin(3 * phase)


@pytest.fixture(scope="module")
def tracked(spark):
    glide = np.linspace(150, 300, RATE)
    signals = {"low": tone(110), "high": tone(440), "glide": tone(glide), "gap": np.concatenate([tone(200, 0.5), np.zeros(RATE // 2), tone(200, 0.5)]), "noise": np.random.RandomState(1).randn(RATE) * 0.2, "silence": np.zeros(RATE)}
    out = A.track(A.frames(blocks(spark, signals), "file_id"), "file_id").cache()
    out.count()
    return out


def contour(tracked, name):
    return {r["frame"]: r["hz"] for r in tracked.filter(f"file_id = '{name}'").collect()}


def test_tones_and_glides_within_a_semitone(tracked):
    for name, hz in (("low", lambda t: 110), ("high", lambda t: 440), ("glide", lambda t: 150 + 150 * t)):
        found = contour(tracked, name)
        assert sorted(found) == list(range(100))
        for k in range(5, 95):
            assert found[k] and abs(12 * math.log2(found[k] / hz(k / 100))) < 1, (name, k, found[k])
    gap = contour(tracked, "gap")
    assert all(gap[k] is None for k in range(55, 95)) and all(abs(gap[k] - 200) < 2 for k in [*range(5, 45), *range(105, 145)])
    assert all(x is None for x in contour(tracked, "silence").values())
    assert sum(x is not None for x in contour(tracked, "noise").values()) < 20


def test_blocks_are_as_good_as_the_whole(spark):
    x = {"a": tone(np.linspace(100, 200, 3 * RATE), 3.0)}
    one = A.frames(blocks(spark, x, 100_000), "file_id").orderBy("frame").collect()
    many = A.frames(blocks(spark, x, 1000), "file_id").orderBy("frame").collect()
    assert [r["frame"] for r in one] == [r["frame"] for r in many] == list(range(300))
    for a, b in zip(one, many, strict=True):
        assert np.allclose(a["hz"], b["hz"]) and np.allclose([a[c] for c in A.SPECTRAL], [b[c] for c in A.SPECTRAL])
    found = A.frames(blocks(spark, x), "file_id")
    whole = {r["frame"]: r["hz"] for r in A.track(found, "file_id").collect()}
    pieces = {r["frame"]: r["hz"] for r in A.track(found, "file_id", piece=50, overlap=20).collect()}
    assert whole == pieces and len(whole) == 300


def plain_path(hz, strength, peak, loudest, s):
    """Every path tried."""
    def walks(i):
        if i == len(hz):
            return [[]]
        return [[k, *rest] for k in [*range(len(hz[i])), -1] for rest in walks(i + 1)]

    def worth(path):
        total = 0.0
        for i, k in enumerate(path):
            total += strength[i][k] - s.octave_cost * np.log2(s.floor / hz[i][k]) if k >= 0 else s.voicing + max(0, 2 - peak[i] / loudest / (s.silence / (1 + s.voicing)))
            if i:
                p = path[i - 1]
                if (k < 0) != (p < 0):
                    total -= s.voicing_cost
                elif k >= 0:
                    total -= s.octave_jump_cost * abs(np.log2(hz[i][k] / hz[i - 1][p]))
        return total

    return max(worth(p) for p in walks(0)), worth


def test_path_is_the_best_of_all():
    rng = random.Random(5)
    for _ in range(20):
        n = 5
        hz = [np.array([rng.uniform(80, 500) for _ in range(rng.randint(0, 3))]) for _ in range(n)]
        strength = [np.array([rng.random() for _ in h]) for h in hz]
        peak = np.array([rng.choice([0.0, 0.01, 1.0]) for _ in range(n)])
        best, worth = plain_path(hz, strength, peak, 1.0, S)
        assert abs(worth(A.best_path(hz, strength, peak, 1.0, S).tolist()) - best) < 1e-9


def test_octave_jumps_are_removed():
    hz = [np.array([200.0, 100.0])] * 11
    strength = [np.array([0.9, 0.8])] * 5 + [np.array([0.85, 0.95])] + [np.array([0.9, 0.8])] * 5
    assert A.best_path(hz, strength, np.ones(11), 1.0, S).tolist() == [0] * 11


def test_functionals_against_numpy(spark, tracked):
    rows = {r["file_id"]: r for r in A.functionals(tracked, "file_id").collect()}
    assert abs(rows["low"]["f0_semitone_mean"] - 12 * math.log2(110 / 27.5)) < 0.1 and rows["silence"]["f0_semitone_mean"] is None
    own = sorted((r.asDict() for r in tracked.filter("file_id = 'gap'").collect()), key=lambda r: r["frame"])
    loud = np.array([r["loudness"] for r in own])
    smooth = np.array([loud[max(i - 1, 0) : i + 2].mean() for i in range(len(loud))])
    g = rows["gap"]
    assert math.isclose(g["loudness_mean"], smooth.mean()) and math.isclose(g["loudness_stddev_norm"], smooth.std() / smooth.mean()) and math.isclose(g["loudness_p80"], np.percentile(smooth, 80))
    voiced = np.array([r["hz"] is not None for r in own])
    edges = np.flatnonzero(np.diff(np.concatenate(([0], voiced, [0]))))
    long = (edges[1::2] - edges[::2]) * 0.01
    assert math.isclose(g["voiced_segments_per_sec"], len(long) / (0.01 * len(own))) and math.isclose(g["mean_voiced_segment_sec"], long.mean()) and math.isclose(g["stddev_voiced_segment_sec"], long.std(), abs_tol=1e-9)
    d = np.diff(smooth)
    assert math.isclose(g["loudness_rising_slope"], d[d > 0].mean() / 0.01)
    assert math.isclose(g["hammarberg_voiced_mean"], np.mean([r["hammarberg"] for r, v in zip(own, voiced, strict=True) if v]))
    assert math.isclose(g["sound_level_db"], 10 * math.log10(np.mean([r["rms"] ** 2 for r in own]) + 1e-12))


def test_cycles_of_known_signals():
    steady = tone(200, 0.06)
    jitter, shimmer = A.cycles(steady, 40)
    assert jitter < 0.005 and shimmer < 0.05
    # Periods of 38 and 42 samples in turn, the second of each pair at half the height.
    x = np.zeros(480)
    at, k = 10, 0
    while at < 470:
        x[at] = 1.0 if k % 2 == 0 else 0.5
        at, k = at + (38 if k % 2 == 0 else 42), k + 1
    jitter, shimmer = A.cycles(x, 40)
    assert abs(jitter - 0.1) < 0.01 and abs(shimmer - 20 * math.log10(2)) < 0.01
    assert np.isnan(A.cycles(np.zeros(480), 40)[0])


def test_spectral_values_of_a_tone():
    rows = np.stack([np.sin(2 * np.pi * 200 * np.arange(160) / RATE), np.sin(2 * np.pi * 3000 * np.arange(160) / RATE)])
    v = A.spectral(rows, RATE)
    assert np.allclose(v["rms"], np.sqrt(0.5), atol=1e-2)
    assert v["alpha_ratio"][0] < -20 < 20 < v["alpha_ratio"][1] and v["hammarberg"][0] > 20 > -20 > v["hammarberg"][1]
    assert np.allclose(v["zcr"], [2 * 200 / RATE, 2 * 3000 / RATE], atol=0.02)


def test_empty_table(spark):
    none = blocks(spark, {})
    assert A.functionals(A.track(A.frames(none, "file_id"), "file_id"), "file_id").count() == 0

import math
import random
import time

import numpy as np
from lingualake.operators import intonation as I
from pyspark.sql import functions as F

STEP, T = 0.01, I.Thresholds()


def contour(rng, n):
    """A wandering pitch with bends, sometimes level."""
    out, y, slope = [], rng.uniform(90, 250), 0.0
    for _ in range(n):
        if rng.random() < 0.15:
            slope = rng.choice([0.0, rng.uniform(-8, 8), rng.uniform(-2, 2)])
        y = min(400.0, max(70.0, y + slope))
        out.append(y)
    return np.array(out)


def st(x, y):
    return 12 * math.log2(x / y)


def glide(hz, a, b):
    part = list(hz[a : b + 1])
    hi, lo = max(part), min(part)
    far = st(hi, lo) if part.index(lo) <= part.index(hi) else st(lo, hi)
    seconds = (b - a) * STEP
    return far / seconds, abs(far / seconds) >= T.glissando / seconds**2


def cuts(hz, a, b):
    """Turning points inside a..b, by plain recursion."""
    if not glide(hz, a, b)[1]:
        return []
    gaps = [abs(hz[i] - (hz[a] + (hz[b] - hz[a]) * (i - a) / (b - a))) for i in range(a, b + 1)]
    k = a + gaps.index(max(gaps))
    if max(gaps) == 0 or abs(st(max(gaps), hz[a] + (hz[b] - hz[a]) * (k - a) / (b - a))) < 1:
        return []
    if (k - a) * STEP < T.segment - 1e-9 or (b - k) * STEP < T.segment - 1e-9:
        return []
    (g1, h1), (g2, h2) = glide(hz, a, k), glide(hz, k, b)
    if abs(g2 - g1) <= T.turn or not (h1 or h2):
        return []
    return [*cuts(hz, a, k), k, *cuts(hz, k, b)]


def test_segments_match_plain_recursion():
    rng, found = random.Random(2), 0
    for _ in range(300):
        hz = contour(rng, rng.randint(2, 60))
        got = I.tonal_segments(hz, 0, len(hz) - 1, STEP, T, T.glissando)
        assert got == [0, *cuts(hz, 0, len(hz) - 1), len(hz) - 1]
        found += len(got) > 2
    assert found > 50


def test_values_of_known_contours():
    flat = I.stylized(np.full(20, 200.0), 0, 19, STEP, T, T.glissando)
    assert (flat["dynamic"], flat["n_segments"], flat["trajectory"], flat["f0_start"], flat["f0_end"]) == (0, 1, 0, 200, 200)
    rise = I.stylized(np.linspace(100, 200, 21), 0, 20, STEP, T, T.glissando)
    assert rise["dynamic"] == 1 and math.isclose(rise["intra"], 12) and rise["points"] == [{"frame": 0, "hz": 100.0}, {"frame": 20, "hz": 200.0}]
    bell = I.stylized(np.concatenate([np.linspace(100, 180, 16), np.linspace(180, 100, 16)[1:]]), 0, 30, STEP, T, T.glissando)
    assert bell["n_segments"] == 2 and [p["frame"] for p in bell["points"]] == [0, 15, 30] and bell["dynamic"] == 1
    assert math.isclose(bell["intra_up"], st(180, 100)) and math.isclose(bell["intra_down"], -st(180, 100)) and math.isclose(bell["hipitch"], 180) and math.isclose(bell["trajectory"], 2 * st(180, 100))
    small = np.concatenate([np.linspace(100, 100.8, 10), np.linspace(100.8, 100, 10)])
    assert I.stylized(small, 0, 19, STEP, T, T.glissando)["f0_start"] == np.median(small)


def test_parts_that_are_voiced_and_unbroken():
    v = lambda s: I.voiced_part(np.array([c == "x" for c in s]))
    assert v("..xxxx..") == (2, 5) and v("xxxx.xx") == (0, 3) and v("xx.xxxx") == (3, 6) and v("x.x") is None and v("....") is None and v("") is None
    hz, db = np.array([100.0] * 6 + [210.0] * 3), np.zeros(9)
    assert I.unbroken_part(hz, db, 0, 8, 100, STEP, T) == (0, 5, True)
    assert I.unbroken_part(hz[::-1], db, 0, 8, 100, STEP, T) == (3, 8, True)
    assert I.unbroken_part(hz[::-1], np.array([9.0] * 3 + [0.0] * 6), 0, 8, 100, STEP, T) == (0, 2, True)
    assert I.unbroken_part(hz[:6], db, 0, 5, 100, STEP, T) == (0, 5, False)


def frames_of(spark, tracks):
    return spark.createDataFrame([(k, i, None if y is None else float(y), 60.0 + i % 3) for k, t in tracks.items() for i, y in enumerate(t)], "file_id string, frame int, hz double, db double")


def test_stylize_spreads_nuclei_over_spans(spark):
    rng = random.Random(4)
    tracks = {k: contour(rng, 400).tolist() for k in "ab"}
    tracks["a"][120:140] = [None] * 20
    tracks["b"][200:] = [2.2 * y for y in tracks["b"][200:]]
    nuclei = [(k, i, i * 40, i * 40 + 30) for k in "ab" for i in range(10)] + [("a", 10, 5000, 5010), ("c", 0, 0, 9)]
    n = spark.createDataFrame(nuclei, "file_id string, idx int, first int, last int")
    for span in (7, 100):
        got = {(r["file_id"], r["idx"]): r for r in I.stylize(frames_of(spark, tracks), n, "file_id", span=span).collect()}
        assert set(got) == {(k, i) for k, i, *_ in nuclei}
        before = {}
        for k, i, a, b in nuclei:
            r = got[k, i]
            hz = np.array([math.nan if y is None else y for y in tracks.get(k, [])[a : b + 1]])
            part = I.voiced_part(~np.isnan(hz)) if len(hz) else None
            if not part:
                assert not r["valid"] and r["f0_mean"] is None and r["inter"] is None
                continue
            middle = float(np.median([y for y in tracks[k] if y]))
            lo, hi, broken = I.unbroken_part(hz, np.array([60.0 + j % 3 for j in range(a, b + 1)]), *part, middle, STEP, T)
            want = I.stylized(hz, lo, hi, STEP, T, T.glissando)
            assert r["valid"] and (r["first_frame"], r["last_frame"], r["discontinuity"]) == (a + lo, a + hi, broken)
            assert all(math.isclose(r[c], want[c]) for c in I.VALUES) and [p["frame"] - a for p in r["points"]] == [p["frame"] for p in want["points"]]
            assert math.isclose(r["inter"], 12 * math.log2(want["f0_start"] / before[k]) if k in before else 0.0, abs_tol=1e-9)
            before[k] = math.floor(want["f0_end"])
        assert got["b", 4]["valid"] and not got["a", 10]["valid"] and not got["c", 0]["valid"]


def plain_dips(y, least, window):
    out, at, end = [], 0, len(y) - 1
    while at < end:
        last, depth = min(at + window, end), 0.0
        while True:
            top = max(range(at, last + 1), key=lambda i: (y[i], -i))
            best, place, h = 0.0, None, y[at]
            for i in range(at, top):
                if h - y[i] > best:
                    best, place = h - y[i], i
                h = max(h, y[i])
            h = y[last]
            for i in range(last, top, -1):
                if h - y[i] > best:
                    best, place = h - y[i], i
                h = max(h, y[i])
            if place is None or best < least:
                break
            last, depth = place, best
        if depth > least:
            out.append((last, depth))
        at = last
    return out


def test_dips_match_plain_search_and_long_curves_end():
    rng = random.Random(6)
    for _ in range(60):
        n = rng.randint(1, 300)
        y = np.cumsum([rng.uniform(-3, 3) for _ in range(n)])
        assert I.dips(y, 2.0, 75) == plain_dips(y.tolist(), 2.0, 75)
    x = np.arange(1_000_000)
    curve = 60 + 10 * np.sin(x / 9) + np.random.RandomState(1).randn(len(x))
    began = time.perf_counter()
    found = I.dips(curve, 3.0, 75)
    assert len(found) > 10_000 and time.perf_counter() - began < 60
    assert I.dips(np.array([np.nan, np.nan]), 1.0, 5) == [] and I.dips(np.empty(0), 1.0, 5) == []


def test_syllables_lie_between_dips(spark):
    y = [10 * math.sin(i / 8) + 0.01 * (i % 5) for i in range(200)]
    rows = spark.createDataFrame([("a", i, v) for i, v in enumerate(y)] + [("b", 0, None), ("c", 3, 1.0), ("d", 0, 2.0), ("d", 1, 3.0), ("d", 2, None), ("d", 3, 2.0), ("d", 4, 1.0)], "file_id string, frame int, db double")
    got = I.syllables(rows, "file_id", "db").orderBy("file_id", "idx").collect()
    a = [r for r in got if r["file_id"] == "a"]
    assert [r["first"] for r in a[1:]] == [r["last"] for r in a[:-1]] == [p for p, _ in plain_dips(y, 3.0, 75)] and len(a) > 2
    assert all(r["level"] == max(y[r["first"] : r["last"] + 1]) == y[r["peak"]] for r in a)
    for r in a:
        lo = hi = r["peak"]
        while lo > r["first"] and y[lo - 1] >= r["level"] - 3:
            lo -= 1
        while hi < r["last"] and y[hi + 1] >= r["level"] - 9:
            hi += 1
        assert (r["left"], r["right"]) == (lo, hi)
    assert a[-1]["dip"] is None and [tuple(r)[:5] for r in got if r["file_id"] != "a"] == [("c", 0, 3, 3, 3), ("d", 0, 0, 1, 1), ("d", 1, 3, 4, 3)]


def plain_terraces(hz, semitones, least):
    state, out = ("U" if hz[0] is None else "T"), []
    for i in range(len(hz) - 1):
        following = "U" if hz[i + 1] is None else "T" if state == "U" or abs(st(hz[i + 1], hz[i])) <= semitones else "S"
        if following != state:
            out.append([i, state])
            state = following
    out.append([len(hz) - 1, state])
    return [(at, "D" if k and s == "T" and (at - out[k - 1][0]) * STEP < least - 1e-9 else s) for k, (at, s) in enumerate(out)]


def plain_changes(hz, semitones):
    out, j = [], 0
    while j < len(hz) - 1:
        a = j
        j += 1
        while j < len(hz) - 1 and (hz[j] is None) == (hz[a] is None) and (hz[a] is None or abs(st(hz[j], hz[a])) <= semitones):
            j += 1
        out.append((a, j - 1, hz[a]))
    return out


def test_stretches_match_plain_loops(spark):
    rng = random.Random(8)
    tracks = {}
    for k in range(12):
        track = contour(rng, rng.randint(1, 90)).tolist()
        tracks[f"r{k}"] = [None if rng.random() < 0.1 else y for y in track]
    f = frames_of(spark, tracks)
    terraces, changes = {}, {}
    for r in I.pitch_terraces(f, "file_id", 0.5, 0.04).orderBy("last").collect():
        terraces.setdefault(r["file_id"], []).append((r["last"], r["kind"]))
    for r in I.pitch_changes(f, "file_id", 2.0).orderBy("idx").collect():
        changes.setdefault(r["file_id"], []).append((r["first"], r["last"], r["hz"]))
    for k, hz in tracks.items():
        assert terraces[k] == plain_terraces(hz, 0.5, 0.04)
        assert changes.get(k, []) == plain_changes(hz, 2.0)
    assert {kind for rows in terraces.values() for _, kind in rows} == {"U", "T", "S", "D"}


def test_empty_tables(spark):
    f = frames_of(spark, {})
    n = spark.createDataFrame([], "file_id string, idx int, first int, last int, before_pause boolean")
    assert [x.count() for x in (I.stylize(f, n, "file_id"), I.syllables(f, "file_id", "db"), I.pitch_changes(f, "file_id", 1.0), I.pitch_terraces(f, "file_id", 1.0, 0.1))] == [0, 0, 0, 0]
    assert f.filter(F.lit(True)).count() == 0

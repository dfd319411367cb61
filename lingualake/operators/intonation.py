"""Pitch contours made plain: tonal segments of nuclei, syllables between dips of loudness, and stretches of even pitch.

Input: frames (key, frame in order from 0, hz, null where unvoiced, and a level such as db), a frame being `step` seconds.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


@dataclass(frozen=True)
class Thresholds:
    """glissando: a movement of T seconds is heard from glissando / T^2 semitones a second on; before a pause from
    glissando_low. turn: least difference (semitones a second) of the slopes around a turning point. segment: least
    seconds of a tonal segment. jump: share of change between frames that breaks a contour. part: least seconds of
    what is kept beside a break. louder: dB by which an earlier part beats a later one."""

    glissando: float = 0.32
    glissando_low: float = 0.32
    turn: float = 30.0
    segment: float = 0.035
    jump: float = 0.3
    part: float = 0.01
    louder: float = 5.0


_EPS = 1e-9


def _st(high: float, low: float) -> float:
    return 12 * math.log2(high / low)


def voiced_part(voiced: np.ndarray) -> tuple[int, int] | None:
    """First and last place of the part of a nucleus that is voiced throughout: what is before a gap, unless what is behind it is longer."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], voiced.astype(np.int8), [0]))))
    runs = list(zip(edges[::2].tolist(), (edges[1::2] - 1).tolist(), strict=True))
    if not runs:
        return None
    a, b = runs[0][0], runs[-1][1]
    for first, last in runs:
        a = first
        gap = last + 1
        if last == b or gap - a >= b - gap:
            b = last
            break
    return (a, b) if b > a else None


def unbroken_part(hz: np.ndarray, db: np.ndarray, a: int, b: int, middle: float, step: float, t: Thresholds) -> tuple[int, int, bool]:
    """The part from a to b without jumps such as octave errors, and whether there was one.

    At each jump the part before it stays if it is louder, or half of the whole, or nearer to the median pitch; parts too
    short give way.
    """
    jumps = np.flatnonzero(np.abs(np.diff(hz[a : b + 1])) / np.minimum(hz[a:b], hz[a + 1 : b + 1]) > t.jump) + a + 1
    for k in jumps.tolist():
        left, right = (k - 1 - a) * step, (b - k) * step
        enough = left >= t.part - _EPS, right >= t.part - _EPS
        stays = enough[0]
        if all(enough):
            near = abs(hz[k - 1] - middle) < abs(hz[k] - middle)
            stays = db[a:k].mean() - db[k : b + 1].mean() >= t.louder or left >= 0.5 * (b - a) * step - _EPS or near
        if stays:
            return a, k - 1, True
        a = k
    return a, b, bool(len(jumps))


def movement(hz: np.ndarray, a: int, b: int, step: float, glissando: float) -> tuple[float, float, bool]:
    """Semitones between the extremes from a to b in the order of time, their rate, and whether that is heard."""
    part = hz[a : b + 1]
    low, high = int(part.argmin()), int(part.argmax())
    far = _st(part[high], part[low]) * (1 if low <= high else -1)
    long = (b - a) * step
    rate = far / long
    return far, rate, abs(rate) >= glissando / (long * long)


def turning_point(hz: np.ndarray, a: int, b: int) -> int | None:
    """The frame farthest from the line between both ends; none if all lie on it, or if its distance, as a pitch, is within a semitone of the line's pitch there."""
    fit = hz[a] + (hz[b] - hz[a]) / (b - a) * np.arange(b - a + 1)
    off = np.abs(hz[a : b + 1] - fit)
    k = int(off.argmax())
    if off[k] == 0 or abs(_st(off[k], fit[k])) < 1:
        return None
    return a + k


def tonal_segments(hz: np.ndarray, a: int, b: int, step: float, t: Thresholds, glissando: float) -> list[int]:
    """Bounds of the tonal segments from a to b: the contour is cut at its turning points, the most important first, then
    in the parts. A point counts if both parts are long enough, their slopes differ enough, and one of them is heard."""
    out, todo = [a], [(a, b)]
    while todo:
        lo, hi = todo.pop()
        k = turning_point(hz, lo, hi) if movement(hz, lo, hi, step, glissando)[2] else None
        if k is not None and min(k - lo, hi - k) * step >= t.segment - _EPS:
            _, g1, heard1 = movement(hz, lo, k, step, glissando)
            _, g2, heard2 = movement(hz, k, hi, step, glissando)
            if abs(g2 - g1) > t.turn and (heard1 or heard2):
                todo += [(k, hi), (lo, k)]  # the left part first
                continue
        out.append(hi)
    return out


def _peak(part: np.ndarray, sign: int) -> float:
    """Highest (or lowest) value of a part, on a parabola through its neighbours where it has two."""
    y = part * sign
    k = int(y.argmax())
    if 0 < k < len(y) - 1 and (bend := y[k - 1] - 2 * y[k] + y[k + 1]) < 0:
        return float(sign * (y[k] - (y[k - 1] - y[k + 1]) ** 2 / (8 * bend)))
    return float(part[k])


def stylized(hz: np.ndarray, a: int, b: int, step: float, t: Thresholds, glissando: float) -> dict:
    """Values of a nucleus from its frames a to b: pitches at its bounds and turning points, and what is heard between them.

    A first segment that isn't heard is level at its median pitch. A nucleus of one segment that rises and falls (or falls and rises) without
    either being heard isn't heard.
    """
    cuts = tonal_segments(hz, a, b, step, t, glissando)
    points, moves, heard_any = [], [], False
    for k, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False)):
        _, _, heard = movement(hz, lo, hi, step, glissando)
        if heard and len(cuts) == 2 and (m := turning_point(hz, lo, hi)) is not None and lo < m < hi:
            _, g1, heard1 = movement(hz, lo, m, step, glissando)
            _, g2, heard2 = movement(hz, m, hi, step, glissando)
            heard = heard1 or heard2 or g1 * g2 >= 0
        left, right = float(hz[lo]), float(hz[hi])
        if k == 0:
            if not heard:
                left = right = float(np.median(hz[lo : hi + 1]))
            points.append((lo, left))
        points.append((hi, right))
        if heard:
            heard_any = True
            moves.append(_st(right, left))
    up, down = sum(x for x in moves if x > 0), sum(x for x in moves if x < 0)
    own, tops = hz[a : b + 1], [y for _, y in points]
    return {
        "f0_start": points[0][1],
        "f0_end": points[-1][1],
        "f0_min": _peak(own, -1),
        "f0_max": _peak(own, 1),
        "f0_median": float(np.median(own)),
        "f0_mean": float(own.mean()),
        "lopitch": min(tops),
        "hipitch": max(tops),
        "dynamic": (-1 if abs(down) > up else 1) if heard_any else 0,
        "intra": up + down,
        "trajectory": up - down,
        "intra_up": up,
        "intra_down": down,
        "n_segments": len(cuts) - 1,
        "points": [{"frame": f, "hz": y} for f, y in points],
    }


VALUES = ("f0_start", "f0_end", "f0_min", "f0_max", "f0_median", "f0_mean", "lopitch", "hipitch", "intra", "trajectory", "intra_up", "intra_down")


def stylize(frames: DataFrame, nuclei: DataFrame, key: str, step: float = 0.01, thresholds: Thresholds = Thresholds(), span: int = 100) -> DataFrame:
    """nuclei (key, idx, first, last: frames, both held[, before_pause]) with their stylized pitch.

    valid is false for a nucleus without two voiced frames in a row; its values are null. first_frame and last_frame bound
    the part that was stylized, discontinuity tells of jumps in the rest. inter is the step (semitones) from the end of
    the valid nucleus before, its pitch rounded down to Hz, to the start of this one.

    Frames meet nuclei in spans of frames, so a recording of any length is spread; a nucleus comes together as one row.
    """
    t = thresholds
    n = nuclei.withColumn("low", F.coalesce(F.col("before_pause"), F.lit(False)) if "before_pause" in nuclei.columns else F.lit(False))
    n = n.select(key, F.col("idx").cast("long").alias("idx"), F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"), "low")
    wide = n.withColumn("span", F.explode(F.sequence(F.expr(f"first div {span}"), F.expr(f"last div {span}"))))
    f = frames.select(key, F.col("frame").cast("long").alias("frame"), F.col("hz").cast("double").alias("hz"), F.col("db").cast("double").alias("db"))
    f = f.withColumn("span", F.expr(f"frame div {span}"))
    met = wide.join(f, [key, "span"], "left").withColumn("row", F.when(F.col("frame").between(F.col("first"), F.col("last")), F.struct("frame", "hz", "db")))
    rows = met.groupBy(key, "idx", "first", "last", "low").agg(F.sort_array(F.collect_list("row")).alias("rows"))
    middle = f.filter("hz > 0").groupBy(key).agg(F.median("hz").alias("middle"))
    rows = rows.join(middle, key, "left")
    kind = f"{key} {frames.schema[key].dataType.simpleString()}"
    schema = f"{kind}, idx long, valid boolean, discontinuity boolean, first_frame long, last_frame long, " + ", ".join(f"{c} double" for c in VALUES) + ", level double, dynamic int, n_segments int, points array<struct<frame: long, hz: double>>"

    def made(batches):
        out_kinds = {"valid": pa.bool_(), "discontinuity": pa.bool_(), "idx": pa.int64(), "first_frame": pa.int64(), "last_frame": pa.int64(), "dynamic": pa.int32(), "n_segments": pa.int32(), "points": pa.list_(pa.struct([("frame", pa.int64()), ("hz", pa.float64())]))}
        names = [c.split()[0] for c in schema.split(", ")]
        names = [x for x in names if x != "hz:"]
        for b in batches:
            made_rows = []
            for k, idx, low, own, mid in zip(*(b.column(c).to_pylist() for c in (key, "idx", "low", "rows", "middle")), strict=True):
                row = dict.fromkeys(names) | {key: k, "idx": idx, "valid": False, "discontinuity": False}
                if own:
                    at = own[0]["frame"]
                    hz = np.full(own[-1]["frame"] - at + 1, np.nan)
                    db = np.full(len(hz), np.nan)
                    for r in own:
                        hz[r["frame"] - at] = r["hz"] if r["hz"] and r["hz"] > 0 else np.nan
                        db[r["frame"] - at] = r["db"] if r["db"] is not None else np.nan
                    part = voiced_part(~np.isnan(hz))
                    if part:
                        a, z, broken = unbroken_part(hz, db, *part, mid, step, t)
                        row["discontinuity"] = broken
                        if z > a:
                            row |= stylized(hz, a, z, step, t, t.glissando_low if low else t.glissando)
                            row |= {"valid": True, "first_frame": at + a, "last_frame": at + z, "level": None if np.isnan(db[a : z + 1]).all() else float(np.nanmax(db[a : z + 1]))}
                            row["points"] = [{"frame": at + p["frame"], "hz": p["hz"]} for p in row["points"]]
                made_rows.append(row)
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in made_rows], out_kinds.get(c, b.column(key).type if c == key else pa.float64())) for c in names], names)

    out = rows.mapInArrow(made, schema)
    w = Window.partitionBy(key, "valid").orderBy("idx")
    inter = 12 * F.log2(F.col("f0_start") / F.floor(F.lag("f0_end").over(w)))
    return out.withColumn("inter", F.when(F.col("valid"), F.coalesce(inter, F.lit(0.0))))


# Syllables from loudness.


def deepest_dip(y: np.ndarray, least: float) -> tuple[int, float] | None:
    """Place and depth of the deepest dip below the hull of a curve, which rises to its peak and falls behind it."""
    top = int(np.nanargmax(y))
    before = np.fmax.accumulate(y[:top]) - y[:top]
    behind = (np.fmax.accumulate(y[: top : -1]) - y[: top : -1])[::-1]
    best: tuple[int, float] = (-1, 0.0)
    if top and np.nanmax(before) > best[1]:
        best = int(np.nanargmax(before)), float(np.nanmax(before))
    if len(behind) and np.nanmax(behind) > best[1]:
        best = len(y) - 1 - int(np.nanargmax(behind[::-1])), float(np.nanmax(behind))
    return best if best[0] >= 0 and best[1] >= least else None


def dips(y: np.ndarray, least: float, window: int) -> list[tuple[int, float]]:
    """Places and depths of the dips that cut a curve: in a window from the last cut on, the deepest dip below the hull,
    then the deepest one before that, as long as there is one; the first of them is the next cut."""
    known = np.flatnonzero(~np.isnan(y))
    if not len(known):
        return []
    at, end, out = int(known[0]), int(known[-1]), []
    while at < end:
        last, depth = min(at + window, end), 0.0
        while last > at and not np.isnan(y[at : last + 1]).all() and (found := deepest_dip(y[at : last + 1], least)):
            if at + found[0] == last or found[0] == 0:
                break
            last, depth = at + found[0], found[1]
        if depth > least:
            out.append((last, depth))
        at = last
    return out


def around_peak(y: np.ndarray, a: int, z: int, top: int, left: float, right: float | None) -> tuple[int, int]:
    """First and last place from a to z around a peak before the level falls by more than `left` and `right` below it; without
    `right` by four fifths of the way down to the lowest level behind the peak, 3 at least."""
    if right is None:
        right = max(3.0, 0.8 * float(y[top] - np.nanmin(y[top : z + 1])))
    low = np.flatnonzero(y[a:top] < y[top] - left)
    behind = np.flatnonzero(y[top + 1 : z + 1] < y[top] - right)
    return (a + int(low[-1]) + 1 if len(low) else a), (top + int(behind[0]) if len(behind) else z)


def syllables(frames: DataFrame, key: str, value: str, least: float = 3.0, step: float = 0.01, window: float = 0.75, left: float = 3.0, right: float | None = 9.0) -> DataFrame:
    """Frames of each recording cut at the dips of a level: key, idx, first, last, peak (frames), level, left, right, dip.

    left and right bound the nucleus, which is what lies around the peak before the level falls by so much; dip is the
    depth of the cut at the syllable's end. The level is in dB or alike; where it is unknown (as in unvoiced frames, if they
    are left out) a syllable ends too. A recording is one task's, as each cut begins the search for the next.
    """
    names = [key, "idx", "first", "last", "peak", "left", "right", "level", "dip"]
    kind = frames.schema[key].dataType.simpleString()

    def cut(group: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("frame")
        frame = rows.column("frame").to_numpy()
        y = rows.column("y").to_numpy(zero_copy_only=False).astype(float)
        known = np.flatnonzero(np.diff(np.concatenate(([0], (~np.isnan(y)).astype(np.int8), [0]))))
        out: list[list] = [[] for _ in names[2:]]
        for begin, stop in zip(known[::2].tolist(), known[1::2].tolist(), strict=True):
            found = [(begin + p, depth) for p, depth in dips(y[begin:stop], least, max(1, round(window / step)))]
            edges = [begin, *(p for p, _ in found), stop - 1]
            for i, (a, z) in enumerate(zip(edges, edges[1:], strict=False)):
                p = a + int(np.nanargmax(y[a : z + 1]))
                lo, hi = around_peak(y, a, z, p, left, right)
                values = (*(int(frame[x]) for x in (a, z, p, lo, hi)), float(y[p]), found[i][1] if i < len(found) else None)
                for column, x in zip(out, values, strict=True):
                    column.append(x)
        size = len(out[0])
        kinds = [pa.int64()] * 5 + [pa.float64()] * 2
        return pa.table([pa.array([group[0].as_py()] * size, rows.schema.field(key).type), pa.array(range(size), pa.int64()), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], names=names)

    rows = frames.select(key, F.col("frame").cast("long").alias("frame"), F.col(value).cast("double").alias("y"))
    return rows.groupBy(key).applyInArrow(cut, f"{key} {kind}, idx long, first long, last long, peak long, left long, right long, level double, dip double")


# Stretches of even pitch.


def pitch_changes(frames: DataFrame, key: str, semitones: float) -> DataFrame:
    """Stretches of each recording: unvoiced ones, and voiced ones that end before the pitch is more than `semitones` from
    that of their first frame. key, idx, first, last, hz (of the first frame). The last frame ends the stretch before it
    unless it opens one of its own that nothing follows, which isn't told."""
    kind = frames.schema[key].dataType.simpleString()

    def cut(group: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("frame")
        frame = rows.column("frame").to_numpy()
        hz = rows.column("y").to_numpy(zero_copy_only=False).astype(float)
        voiced = ~np.isnan(hz)
        first, last, start = [], [], []
        at, end = 0, len(hz) - 1
        while at < end:
            k = at + 1
            if voiced[at]:
                while k < end and voiced[k] and abs(_st(hz[k], hz[at])) <= semitones:
                    k += 1
            else:
                while k < end and not voiced[k]:
                    k += 1
            first.append(int(frame[at]))
            last.append(int(frame[k - 1]))
            start.append(float(hz[at]) if voiced[at] else None)
            at = k
        n = len(first)
        return pa.table([pa.array([group[0].as_py()] * n, rows.schema.field(key).type), pa.array(range(n), pa.int64()), pa.array(first, pa.int64()), pa.array(last, pa.int64()), pa.array(start, pa.float64())], names=[key, "idx", "first", "last", "hz"])

    y = F.when(F.col("hz") > 0, F.col("hz").cast("double"))
    rows = frames.select(key, F.col("frame").cast("long").alias("frame"), y.alias("y"))
    return rows.groupBy(key).applyInArrow(cut, f"{key} {kind}, idx long, first long, last long, hz double")


def pitch_terraces(frames: DataFrame, key: str, semitones: float, least: float, step: float = 0.01) -> DataFrame:
    """Stretches of each recording by kind: U unvoiced, T terraces (no step above `semitones`), S slopes, and D, terraces
    shorter than `least` seconds. key, last (frame), kind.

    What a frame belongs to hangs on it and the one before alone: after an unvoiced one comes a terrace. So the kinds
    are a window's, and nothing is gathered.
    """
    w = Window.partitionBy(key).orderBy("frame")
    f = frames.select(key, F.col("frame").cast("long").alias("frame"), F.when(F.col("hz") > 0, F.col("hz").cast("double")).alias("hz"))
    f = f.withColumns({"before": F.lag("hz").over(w), "place": F.row_number().over(w)})
    far = F.abs(12 * F.log2(F.col("hz") / F.col("before"))) > semitones
    f = f.withColumn("kind", F.when(F.col("hz").isNull(), "U").when((F.col("place") > 1) & F.col("before").isNotNull() & far, "S").otherwise("T"))
    ends = f.withColumn("next", F.lead("kind").over(w)).filter("next IS NULL OR next <> kind")
    ends = ends.withColumn("previous", F.lag("frame").over(w))
    brief = (F.col("kind") == "T") & ((F.col("frame") - F.col("previous")) * step < least - _EPS)
    return ends.select(key, F.col("frame").alias("last"), F.when(brief, "D").otherwise(F.col("kind")).alias("kind"))

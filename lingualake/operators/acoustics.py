"""Frames of recordings: pitch candidates and a path through them, spectra, cycles, and functionals over all frames.

Recordings come as blocks of samples that overlap, so that each block is worked on alone and no task holds a recording:
key, rate, start (place of the first sample given), first and last (places of the block's own samples, last excluded),
samples. A frame stands every `step` seconds from 0 on and belongs to the block that owns its centre.

Pitch is found by autocorrelation: candidates are the peaks of a frame's autocorrelation over that of its window, with a
cost for low octaves; beside them stands being unvoiced. The path with the largest sum of strengths less the costs of
octave jumps and voicing changes is found for pieces of a recording that overlap, by dynamic programming.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


@dataclass(frozen=True)
class Settings:
    """How frames are made; the costs are those of the usual pitch analysis by autocorrelation."""

    step: float = 0.01
    floor: float = 75.0
    ceiling: float = 600.0
    candidates: int = 14
    silence: float = 0.03
    voicing: float = 0.45
    octave_cost: float = 0.01
    octave_jump_cost: float = 0.35
    voicing_cost: float = 0.14

    @property
    def reach(self) -> float:
        """Seconds around a frame's centre that any of its values needs."""
        return max(1.5 / self.floor, 0.03)


#: What a frame has beside its pitch: all from samples around its centre.
SPECTRAL = ("rms", "loudness", "zcr", "alpha_ratio", "hammarberg", "slope_0_500", "slope_500_1500", "mfcc1", "mfcc2", "mfcc3", "mfcc4")
CYCLES = ("jitter", "shimmer")


def overlapped(blocks: DataFrame, key: str, settings: Settings = Settings(), made: Callable[[Column], Column] | None = None) -> DataFrame:
    """Blocks (key, block in order, rate, samples) that don't overlap, with what their frames need of the blocks beside them.

    A block must be at least as long as the reach of a frame, but for a recording's last one. With `made`, blocks have a
    `source` and the number of samples it makes (`size`) instead: sources travel, samples are made where they are needed.
    A column `loudest` stays. Sources are few bytes and much work, so their partitions aren't put together.
    """
    if made:
        blocks = blocks.repartition(int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)
    w = Window.partitionBy(key).orderBy("block")
    halo = F.ceil(F.col("rate") * settings.reach).cast("int") + 1
    size = F.col("size") if made else F.size("samples")
    given = F.struct(F.col("source" if made else "samples").alias("x"))
    upto = F.coalesce(F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    more = [c for c in ("loudest",) if c in blocks.columns]
    b = blocks.select(key, "rate", *more, given.alias("own"), size.alias("size"), upto.alias("first"), F.lag(given).over(w).alias("before"), F.lead(given).over(w).alias("behind"), halo.alias("halo"))
    samples = lambda c: made(F.col(c)["x"]) if made else F.col(c)["x"]
    b = b.select(key, "rate", *more, "size", "first", "halo", samples("own").alias("samples"), *[F.when(F.col(c).isNotNull(), samples(c)).alias(c) for c in ("before", "behind")])
    none = F.array().cast(b.schema["samples"].dataType)
    head = F.coalesce(F.slice("before", F.greatest(F.size("before") - F.col("halo") + 1, F.lit(1)), F.col("halo")), none)
    tail = F.coalesce(F.slice("behind", F.lit(1), F.col("halo")), none)
    return b.select(key, "rate", *more, (F.col("first") - F.size(head)).alias("start"), "first", (F.col("first") + F.col("size")).alias("last"), F.concat(head, "samples", tail).alias("samples"))


def neighbours(blocks: DataFrame, key: str) -> DataFrame:
    """Blocks (key, block in order, rate, source, size) with source and size of the blocks beside them, for frames of samples `made` from them."""
    w = Window.partitionBy(key).orderBy("block")
    upto = F.coalesce(F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    beside = [f(c).over(w).alias(f"{c}_{n}") for n, f in (("before", F.lag), ("behind", F.lead)) for c in ("source", "size")]
    return blocks.select(key, "rate", upto.alias("first"), "source", "size", *beside).withColumn("last", F.col("first") + F.col("size"))


def windows_at(x: np.ndarray, centres: np.ndarray, size: int) -> np.ndarray:
    """A row of samples around each centre, zeros beyond the ends."""
    padded = np.concatenate((np.zeros(size), x, np.zeros(size)))
    return np.lib.stride_tricks.sliding_window_view(padded, size)[centres + size - size // 2]


def autocorrelation(rows: np.ndarray, lags: int) -> np.ndarray:
    """Autocorrelations of rows at lags 0 to lags - 1, by Fourier transforms."""
    n = 1 << int(np.ceil(np.log2(rows.shape[1] + lags)))
    return np.fft.irfft(np.abs(np.fft.rfft(rows, n, axis=1)) ** 2, n, axis=1)[:, :lags]


def candidates(rows: np.ndarray, rate: int, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The candidate pitches (Hz) of all rows of samples and their strengths, a row's strongest first, and where each row's begin and end."""
    size, lags = rows.shape[1], int(rate / s.floor) + 2
    window = np.hanning(size + 2)[1:-1]
    r = autocorrelation((rows - rows.mean(axis=1, keepdims=True)) * window, lags)
    own = autocorrelation(window[None, :], lags)[0]
    loud = r[:, 0] > 1e-12
    r = np.where(loud[:, None], r, 1.0) / np.where(loud, r[:, 0], 1.0)[:, None] / (own / own[0])
    a, b, c = r[:, :-2], r[:, 1:-1], r[:, 2:]
    peak = (b > a) & (b >= c) & (b > 0.5 * s.voicing) & loud[:, None]
    frame, lag = np.nonzero(peak)
    a, b, c = a[peak], b[peak], c[peak]
    shift = 0.5 * (a - c) / np.minimum(a - 2 * b + c, -1e-12)
    top = b - 0.25 * (a - c) * shift
    hz, top = rate / (lag + 1 + shift), np.where(top > 1, 1 / np.maximum(top, 1), top)
    fit = (hz >= s.floor) & (hz <= s.ceiling)
    frame, hz, top = frame[fit], hz[fit], top[fit]
    rank = np.lexsort((hz, -(top - s.octave_cost * np.log2(s.floor / hz)), frame))
    frame, hz, top = frame[rank], hz[rank], top[rank]
    best = np.arange(len(frame)) - np.searchsorted(frame, frame) < s.candidates
    return hz[best], top[best], np.searchsorted(frame[best], np.arange(len(rows) + 1))


def _mel_bands(rate: int, n: int, count: int = 26) -> np.ndarray:
    """Triangular bands, even on the mel scale from 20 Hz to 8 kHz or half the rate."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(20.0), mel(min(8000.0, rate / 2)), count + 2) / 2595) - 1)
    f = np.fft.rfftfreq(n, 1 / rate)
    lo, mid, hi = edges[:-2, None], edges[1:-1, None], edges[2:, None]
    return np.clip(np.minimum((f - lo) / (mid - lo), (hi - f) / (hi - mid)), 0, None)


def _slope(db: np.ndarray, f: np.ndarray, lo: float, hi: float) -> np.ndarray:
    """Slope (dB a Hz) of a line through each row's levels from lo to hi Hz."""
    inside = (f >= lo) & (f <= hi)
    if inside.sum() < 2:
        return np.full(len(db), np.nan)
    x = f[inside] - f[inside].mean()
    return db[:, inside] @ x / (x @ x)


def spectral(rows: np.ndarray, rate: int) -> dict[str, np.ndarray]:
    """Levels of rows of samples (a frame of 20 ms each) and of their spectra; ratios and slopes in dB."""
    n = 1 << int(np.ceil(np.log2(rows.shape[1])))
    power = np.abs(np.fft.rfft(rows * np.hamming(rows.shape[1]), n, axis=1)) ** 2 / rows.shape[1]
    f = np.fft.rfftfreq(n, 1 / rate)
    db = 10 * np.log10(power + 1e-12)
    band = lambda lo, hi: power[:, (f >= lo) & (f < hi)]
    level = lambda x: 10 * np.log10(x + 1e-12)
    mel = power @ _mel_bands(rate, n).T
    k = np.arange(mel.shape[1])
    cepstra = np.log(mel + 1e-10) @ np.cos(np.pi / len(k) * (k[:, None] + 0.5) * np.arange(1, 5)[None, :]) * np.sqrt(2 / len(k))
    top = lambda x: x.max(axis=1) if x.shape[1] else np.zeros(len(x))
    return {
        "rms": np.sqrt((rows * rows).mean(axis=1)),
        "loudness": (mel**0.33).sum(axis=1),
        "zcr": (np.diff(np.signbit(rows), axis=1) != 0).mean(axis=1),
        "alpha_ratio": level(band(1000, 5000).sum(axis=1)) - level(band(50, 1000).sum(axis=1)),
        "hammarberg": level(top(band(0, 2000))) - level(top(band(2000, 5000))),
        "slope_0_500": _slope(db, f, 0, 500),
        "slope_500_1500": _slope(db, f, 500, 1500),
        **{f"mfcc{i + 1}": cepstra[:, i] for i in range(4)},
    }


def cycles(x: np.ndarray, period: float) -> tuple[float, float]:
    """Jitter and shimmer of some samples with about this period (in samples)."""
    jitter, shimmer = cycles_of_rows(x[None, :], np.array([period], float))
    return float(jitter[0]), float(shimmer[0])


def cycles_of_rows(rows: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Jitter (share of the period) and shimmer (dB) of each row of samples with about its period (in samples).

    From the highest sample each next mark is the highest one a period away, give or take a fifth; between samples a
    parabola is laid through three of them. Fewer than three marks give nothing.
    """
    n, size = rows.shape
    near, far = np.rint(0.8 * period).astype(np.int64), np.rint(1.2 * period).astype(np.int64)
    span = far - near
    first = rows.argmax(axis=1)

    def walk(move: np.ndarray) -> list[np.ndarray]:
        """The next mark of each row, and the next one, until no row has any (-1: this row has none)."""
        found, live, at = [], np.arange(n), first
        while True:
            lo = at + move[live]
            inside = (lo >= 0) & (lo + span[live] < size)
            live, lo = live[inside], lo[inside]
            if not len(live):
                return found
            k = np.arange(span[live].max() + 1)
            heights = rows[live[:, None], np.minimum(lo[:, None] + k, size - 1)]
            at = lo + np.where(k <= span[live][:, None], heights, -np.inf).argmax(axis=1)
            found.append(np.full(n, -1))
            found[-1][live] = at

    marks = np.stack([*reversed(walk(-far)), first, *walk(near)], axis=1)
    given = marks >= 0
    each = np.arange(n)[:, None]
    a, b, c = (rows[each, np.clip(marks + i, 0, size - 1)] for i in (-1, 0, 1))
    bend = a - 2 * b + c
    d = np.where((marks > 0) & (marks < size - 1) & (bend < 0), 0.5 * (a - c) / np.where(bend < 0, bend, -1.0), 0.0)
    places, tops = marks + d, b - 0.25 * (a - c) * d
    gap, pair = given[:, 1:] & given[:, :-1], given[:, 2:] & given[:, :-2]
    gaps, count = np.diff(places, axis=1), np.maximum(gap.sum(axis=1), 2)
    fine = (gap.sum(axis=1) >= 2) & ~((tops <= 0) & given).any(axis=1)
    ratio = np.where(gap & fine[:, None], tops[:, 1:], 1.0) / np.where(gap & fine[:, None], tops[:, :-1], 1.0)
    mean = np.where(fine, np.where(gap, gaps, 0.0).sum(axis=1) / count, 1.0)
    jitter = np.where(pair, np.abs(np.diff(gaps, axis=1)), 0.0).sum(axis=1) / (count - 1) / mean
    shimmer = np.abs(20 * np.log10(ratio)).sum(axis=1) / count
    return np.where(fine, jitter, np.nan), np.where(fine, shimmer, np.nan)


#: What makes samples: from sources and places in their blocks (arrays that broadcast).
Made = Callable[[np.ndarray, np.ndarray], np.ndarray]

#: Samples that are worked on at once, in whole blocks.
AT_ONCE = 1 << 17


def _dealt(blocks: DataFrame, keys: Sequence[str], made: Made | None) -> DataFrame:
    """What frames need of blocks. Sources are few bytes and much work: they are dealt out evenly, those of one recording too, and aren't put together."""
    if not made:
        return blocks.select(*keys, "rate", "first", "last", "start", "samples")
    b = blocks.select(*keys, "rate", "first", "last", "source", "size", "source_before", "size_before", "source_behind", "size_behind")
    return b.repartition(int(b.sparkSession.conf.get("spark.sql.shuffle.partitions")), keys[0], "first")


def _given(b: pa.RecordBatch, rows: np.ndarray, pad: int) -> tuple[np.ndarray, np.ndarray]:
    """Samples of these blocks, one after the other with zeros between, and where each block's own ones begin."""
    own = [b.column("samples")[i].values.to_numpy(zero_copy_only=False) for i in rows.tolist()]
    begin = pad + np.cumsum([0, *(len(x) + pad for x in own)])
    flat = np.zeros(begin[-1])
    for x, i in zip(own, begin.tolist(), strict=False):
        flat[i : i + len(x)] = x
    head = (b.column(c).to_numpy()[rows] for c in ("first", "start"))
    return flat, begin[:-1] + np.subtract(*head)


def _made(b: pa.RecordBatch, rows: np.ndarray, pad: int, made: Made) -> tuple[np.ndarray, np.ndarray]:
    """As _given(), with samples made from sources; of the blocks beside a block there are as many as a frame needs."""
    size = b.column("size").to_numpy()[rows].astype(np.int64)
    flat = np.zeros((len(rows), 2 * pad + size.max(initial=0)))
    for of in ("_before", "", "_behind"):
        sizes = pc.fill_null(b.column(f"size{of}"), 0).to_numpy()[rows].astype(np.int64)
        sources = b.column(f"source{of}").to_numpy(zero_copy_only=False)[rows][:, None]
        for n, at in {*zip(sizes.tolist(), size.tolist(), strict=True)} - {(0, i) for i in size.tolist()}:
            alike = np.flatnonzero((sizes == n) & (size == at))
            lo, hi = (max(n - pad, 0), n) if of == "_before" else (0, n if of == "" else min(n, pad))
            to = pad - (hi - lo) if of == "_before" else pad if of == "" else pad + at
            flat[alike, to : to + hi - lo] = made(sources[alike], np.arange(lo, hi)[None, :])
    return flat.ravel(), np.arange(len(rows)) * flat.shape[1] + pad


def _places(b: pa.RecordBatch, s: Settings, made: Made | None) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of a batch, some at a time: rate, samples, and for each frame the row of its block, its number and its centre in the samples."""
    rates, first, last = (b.column(c).to_numpy().astype(np.int64) for c in ("rate", "first", "last"))
    for rate in np.unique(rates).tolist():
        pad = int(np.ceil(rate * s.reach)) + 1
        alike = np.flatnonzero(rates == rate)
        cut = np.cumsum(last[alike] - first[alike] + 2 * pad) // AT_ONCE
        for rows in np.split(alike, np.flatnonzero(np.diff(cut)) + 1):
            lo = np.ceil(np.round(first[rows] / (s.step * rate), 9)).astype(np.int64)
            n = np.maximum((last[rows] / (s.step * rate)).astype(np.int64) + 1 - lo, 0)
            block = np.repeat(np.arange(len(rows)), n)
            k = np.arange(len(block)) - np.repeat(np.cumsum(n) - n, n) + lo[block]
            centres = np.round(k * s.step * rate).astype(np.int64)
            own = (centres >= first[rows][block]) & (centres < last[rows][block])
            block, k, centres = block[own], k[own], centres[own]
            if len(k):
                x, begin = _made(b, rows, pad, made) if made else _given(b, rows, pad)
                yield rate, x, rows[block], k, centres - first[rows][block] + begin[block]


def _peaks(rows: np.ndarray) -> np.ndarray:
    mean = rows.mean(axis=1)
    return np.maximum(rows.max(axis=1) - mean, mean - rows.min(axis=1))


def loudest(blocks: DataFrame, key: str, settings: Settings = Settings(), made: Made | None = None) -> DataFrame:
    """key, loudest: the highest peak of a recording's frames. A pass over the samples that shuffles a row for each key and task."""
    s = settings

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            top = np.full(b.num_rows, np.nan)
            for rate, x, block, _, centres in _places(b, s, made):
                peaks = _peaks(windows_at(x, centres, int(round(3 / s.floor * rate))))
                begin = np.flatnonzero(np.diff(block, prepend=-1))
                top[block[begin]] = np.maximum.reduceat(peaks, begin)
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array(top, pa.float64(), from_pandas=True)], [key, "peak"])

    kind = blocks.schema[key].dataType.simpleString()
    return _dealt(blocks, (key,), made).mapInArrow(found, f"{key} {kind}, peak double").groupBy(key).agg(F.max("peak").alias("loudest"))


def frames(blocks: DataFrame, key: str, settings: Settings = Settings(), values: Sequence[str] = (*SPECTRAL, *CYCLES), made: Made | None = None) -> DataFrame:
    """Blocks to key, frame, peak, hz and strength (arrays: candidates), and the values of SPECTRAL and CYCLES, or those asked for.

    Blocks are those of overlapped(), or with `made` those of neighbours(). The frames of many short blocks are worked on together.
    """
    s = settings
    more = [c for c in ("loudest",) if c in blocks.columns]
    names = [key, *more, "frame", "peak", "hz", "strength", *values]

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rate, x, block, k, centres in _places(b, s, made):
                rows = windows_at(x, centres, int(round(3 / s.floor * rate)))
                hz, strength, edges = candidates(rows, rate, s)
                of: dict[str, np.ndarray] = {}
                if any(c in CYCLES for c in values):
                    some = np.flatnonzero(np.diff(edges))
                    of = {c: np.full(len(k), np.nan) for c in CYCLES}
                    near = windows_at(x, centres[some], max(2, int(round(0.06 * rate))))
                    for c, v in zip(CYCLES, cycles_of_rows(near, rate / hz[edges[some]]), strict=True):
                        of[c][some] = v
                if any(c in SPECTRAL for c in values):
                    of |= spectral(windows_at(x, centres, max(2, int(round(0.02 * rate)))), rate)
                columns = [b.column(c).take(pa.array(block)) for c in (key, *more)] + [pa.array(k), pa.array(_peaks(rows))]
                columns += [pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(v)) for v in (hz, strength)]
                columns += [pa.array(of[c], pa.float64(), from_pandas=True) for c in values]
                yield pa.RecordBatch.from_arrays(columns, names)

    kind = blocks.schema[key].dataType.simpleString()
    schema = ", ".join([f"{key} {kind}", *[f"{c} double" for c in more], "frame long, peak double, hz array<double>, strength array<double>", *[f"{c} double" for c in values]])
    return _dealt(blocks, (key, *more), made).mapInArrow(found, schema)


def best_path(hz: list[np.ndarray], strength: list[np.ndarray], peak: np.ndarray, loudest: float, s: Settings) -> np.ndarray:
    """For each frame the candidate on the best path; -1 is unvoiced."""
    n = np.array([len(h) for h in hz], np.int64)
    flat = [np.concatenate([np.empty(0), *x]) for x in (hz, strength)]
    return best_paths(*flat, n, np.asarray(peak, float), np.full(len(n), loudest, float), np.zeros(1, np.int64), s)


def best_paths(hz: np.ndarray, strength: np.ndarray, n: np.ndarray, peak: np.ndarray, loudest: np.ndarray, begin: np.ndarray, s: Settings) -> np.ndarray:
    """For each frame of some pieces the candidate on its piece's best path; -1 is unvoiced. All pieces go a frame on together.

    hz, strength: candidates of all frames; n: how many each frame has; begin: each piece's first frame. Being unvoiced is
    the stronger the quieter a frame is beside the loudest one of the recording.
    """
    scale = 0.01 / s.step
    jump, voicing = s.octave_jump_cost * scale, s.voicing_cost * scale
    # States: the candidates in order, places that a frame doesn't fill, then unvoiced.
    most = int(n.max(initial=0))
    frame = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(frame)) - np.repeat(np.cumsum(n) - n, n)
    log = np.zeros((len(n), most))
    log[frame, place] = np.log2(hz)
    own = np.full((len(n), most + 1), -np.inf)
    own[frame, place] = strength - s.octave_cost * np.log2(s.floor / hz)
    # A frame with samples that are no numbers has no candidates and counts as silent, so that the path goes on behind it.
    level = np.nan_to_num(peak / np.where(loudest == 0, 1.0, loudest))
    own[:, most] = s.voicing + np.maximum(0, 2 - level / (s.silence / (1 + s.voicing)))
    # Longest first: those that still run are always the first ones.
    long = np.diff(begin, append=len(n))
    rank = np.argsort(-long, kind="stable")
    begin, long = begin[rank], long[rank]
    running = np.searchsorted(-long, -np.arange(long.max(initial=0)), side="left").tolist()
    back = np.full(own.shape, most, np.int16)
    total = own[begin]
    for i, m in enumerate(running[1:], 1):
        at = begin[:m] + i
        before, given = total[:m], own[at]
        apart = before[:, :most, None] - jump * np.abs(log[at - 1][:, :, None] - log[at][:, None, :])
        from_candidate = before[:, :most] - voicing
        from_unvoiced = before[:, most] - voicing
        if most:
            to = apart.argmax(axis=1)
            reach = np.take_along_axis(apart, to[:, None, :], 1)[:, 0, :]
            other = from_unvoiced[:, None] > reach
            back[at, :most] = np.where(other, most, to)
            falls = from_candidate.argmax(axis=1)
            fallen = np.take_along_axis(from_candidate, falls[:, None], 1)[:, 0]
            stays = before[:, most] > fallen
            back[at, most] = np.where(stays, most, falls)
            total[:m, :most] = given[:, :most] + np.where(other, from_unvoiced[:, None], reach)
            total[:m, most] = given[:, most] + np.where(stays, before[:, most], fallen)
        else:
            total[:m] = before + given
    state = total.argmax(axis=1)
    out = np.empty(len(n), np.int64)
    for i in range(len(running) - 1, -1, -1):
        at = begin[: running[i]] + i
        out[at] = state[: running[i]]
        state[: running[i]] = back[at, out[at]]
    out[out == most] = -1
    return out


def track(found: DataFrame, key: str, settings: Settings = Settings(), piece: int = 6000, overlap: int = 300) -> DataFrame:
    """Frames with the pitch on the best path: hz (null where unvoiced) and strength in place of the candidates.

    The path is sought in pieces of so many frames, each with `overlap` more on both sides to settle in. Frames with a column
    `loudest` are shuffled once; without one it is found from all frames first.
    """
    s = settings
    own = F.expr(f"frame div {piece}")
    reach = F.sequence(F.expr(f"greatest(frame - {overlap}, 0) div {piece}"), F.expr(f"(frame + {overlap}) div {piece}"))
    rows = found.withColumn("own", own).withColumn("piece", F.explode(reach))
    if "loudest" not in found.columns:
        rows = rows.join(found.groupBy(key).agg(F.max("peak").alias("loudest")), key)
    keep = [c for c in found.columns if c not in ("hz", "strength", "peak", "loudest")]

    def solved(block: pa.Table, begin: np.ndarray) -> Iterator[pa.RecordBatch]:
        n = pc.list_value_length(block.column("hz")).to_numpy().astype(np.int64)
        flat = [pc.list_flatten(block.column(c)).to_numpy() for c in ("hz", "strength")]
        path = best_paths(*flat, n, block.column("peak").to_numpy(), block.column("loudest").to_numpy(), begin, s)
        chosen = pa.array(np.cumsum(n) - n + path, mask=path < 0)
        out = block.select(keep)
        for c, x in zip(("hz", "strength"), flat, strict=True):
            out = out.append_column(c, pa.array(x).take(chosen))
        yield from out.filter(pc.equal(block.column("own"), block.column("piece"))).to_batches()

    def pathed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by piece and frame; pieces that came whole are worked on together."""
        held, enough = [], AT_ONCE // 2
        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) >= enough:
                block = pa.Table.from_batches(held).combine_chunks()
                begin = _begins(block, (key, "piece"))
                if len(begin) > 1:
                    yield from solved(block.slice(0, begin[-1]).combine_chunks(), begin[:-1])
                held = block.slice(begin[-1]).to_batches()
                enough = max(AT_ONCE // 2, 2 * (block.num_rows - int(begin[-1])))
        if sum(x.num_rows for x in held):
            block = pa.Table.from_batches(held).combine_chunks()
            yield from solved(block, _begins(block, (key, "piece")))

    schema = ", ".join(f"{c} {found.schema[c].dataType.simpleString()}" for c in keep) + ", hz double, strength double"
    return rows.repartition(key, "piece").sortWithinPartitions(key, "piece", "frame").mapInArrow(pathed, schema)


def _begins(block: pa.Table, keys: Sequence[str]) -> np.ndarray:
    """The rows from which on a key is another than in the row before, the first one included."""
    new = np.zeros(block.num_rows - 1, bool)
    for c in keys:
        a, b = (block.column(c).slice(i, block.num_rows - 1) for i in (0, 1))
        new |= pc.fill_null(pc.not_equal(a, b), False).to_numpy() | (pc.is_null(a).to_numpy() != pc.is_null(b).to_numpy())
    return np.concatenate(([0], np.flatnonzero(new) + 1))


def _mean_and_spread(c: str | Column, name: str) -> list[Column]:
    c = F.col(c) if isinstance(c, str) else c
    return [F.avg(c).alias(f"{name}_mean"), F.when(F.avg(c) != 0, F.stddev_pop(c) / F.avg(c)).alias(f"{name}_stddev_norm")]


def functionals(tracked: DataFrame, key: str, settings: Settings = Settings()) -> DataFrame:
    """A row for each recording over all of its tracked frames.

    Pitch is in semitones above 27.5 Hz, over voiced frames; pitch and loudness are means of three frames; spectral
    values stand for voiced and unvoiced frames apart. mean and stddev_norm (spread over mean) of each, quantiles and
    range of pitch and loudness, the slopes of rising and falling loudness, loudness peaks and voiced stretches a
    second, lengths of voiced and unvoiced stretches, and the level of the whole.
    """
    w = Window.partitionBy(key).orderBy("frame")
    three = w.rowsBetween(-1, 1)
    voiced = F.col("hz").isNotNull()
    semitones = 12 * F.log2(F.col("hz") / 27.5)
    t = tracked.withColumns({"voiced": voiced, "st": F.when(voiced, F.avg(semitones).over(three)), "loud": F.avg("loudness").over(three)})
    t = t.withColumns({"hnr": F.when(voiced, 10 * F.log10(F.least("strength", F.lit(0.999999)) / (1 - F.least("strength", F.lit(0.999999))))), "rise": F.lead("loud").over(w) - F.col("loud"), "fell": F.col("loud") - F.lag("loud").over(w)})
    t = t.withColumn("turn", F.coalesce((F.col("voiced") != F.lag("voiced").over(w)).cast("int"), F.lit(1)))
    begun = F.last(F.when(F.col("turn") == 1, F.col("place")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    t = t.withColumn("place", F.row_number().over(w))
    t = t.withColumn("long", F.when(F.coalesce(F.lead("turn").over(w), F.lit(1)) == 1, (F.col("place") - begun + 1) * settings.step))
    of = lambda c: F.percentile(c, F.array(F.lit(0.2), F.lit(0.5), F.lit(0.8)))
    quantiles = lambda c, name: [of(c)[i].alias(f"{name}_p{q}") for i, q in enumerate((20, 50, 80))] + [(of(c)[2] - of(c)[0]).alias(f"{name}_range")]
    step = settings.step
    out = [F.count(F.lit(1)).alias("n_frames"), *_mean_and_spread("st", "f0_semitone"), *quantiles("st", "f0_semitone"), *_mean_and_spread("loud", "loudness"), *quantiles("loud", "loudness")]
    out += [F.avg(F.when(F.col("rise") > 0, F.col("rise") / step)).alias("loudness_rising_slope"), F.avg(F.when(F.col("rise") < 0, F.col("rise") / step)).alias("loudness_falling_slope")]
    out += [x for c in ("jitter", "shimmer", "hnr") for x in _mean_and_spread(F.when(F.col("voiced"), F.col(c)), c)]
    for c in ("alpha_ratio", "hammarberg", "slope_0_500", "slope_500_1500", "mfcc1", "mfcc2", "mfcc3", "mfcc4"):
        out += _mean_and_spread(F.when(F.col("voiced"), F.col(c)), f"{c}_voiced")
    out += [F.avg(F.when(~F.col("voiced"), F.col(c))).alias(f"{c}_unvoiced_mean") for c in ("alpha_ratio", "hammarberg", "slope_0_500", "slope_500_1500")]
    out += [F.avg("zcr").alias("zcr_mean"), (F.count_if((F.col("fell") > 0) & (F.col("rise") <= 0)) / (F.count(F.lit(1)) * step)).alias("loudness_peaks_per_sec")]
    out += [(F.count_if((F.col("turn") == 1) & F.col("voiced")) / (F.count(F.lit(1)) * step)).alias("voiced_segments_per_sec"), (10 * F.log10(F.avg(F.col("rms") * F.col("rms")) + 1e-12)).alias("sound_level_db")]
    out += [f(F.when(F.col("voiced") == v, F.col("long"))).alias(f"{n}_{'voiced' if v else 'unvoiced'}_segment_sec") for v in (True, False) for n, f in (("mean", F.avg), ("stddev", F.stddev_pop))]
    return t.groupBy(key).agg(*out)

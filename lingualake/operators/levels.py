"""Pitch levels of syllables: low, mid, high, bottom and top, found from movements inside nuclei, steps to the ones before,
the speaker's range, and then carried to neighbours.

A syllable has a shape (R and r rises, F and f falls, _ level, S sustained) and may have a level before it (L M H B T) and
one that its movement ends on behind it (,B or ,T). A turn of a speaker is worked on alone: no step looks beyond it.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Seconds back to the syllables that a step is measured from, and how many of them; seconds between syllables of a plateau.
CONTEXT, NEIGHBOURS, CLOSE = 0.5, 3, 0.2

#: Semitones within which two pitches are alike.
FLAT = 1.2

#: Seconds and semitones of a sustained syllable; seconds below which a level part beside others isn't told.
SUSTAIN, SUSTAIN_MOVE, SHORT = 0.25, 1.5, 0.07


def st(a: float, b: float) -> float:
    return 12 * math.log2(a / b)


@dataclass
class Range:
    """A speaker's pitch: Hz, and the number of nuclei it rests on."""

    bottom: float
    q1: float
    median: float
    q3: float
    top: float
    nuclei: int

    @property
    def semitones(self) -> float:
        return st(self.top, self.bottom)

    @property
    def steps(self) -> tuple[float, float]:
        """What counts as a large and as a medium step: less for narrow ranges."""
        for least, steps in ((8.5, (4.5, 3.0)), (7.0, (3.5, 2.5))):
            if self.semitones >= least:
                return steps
        return 3.2, 2.5


@dataclass
class Syllable:
    start: float
    end: float
    f0_start: float
    f0_end: float
    low: float
    high: float
    f0_min: float
    up: float
    down: float
    points: list[tuple[float, float]]
    hesitation: bool = False
    level: str = ""
    shape: str = ""
    tail: str = ""
    out: bool = field(default=False)

    @property
    def open(self) -> bool:
        """Without a level yet, and fit to get one."""
        return not self.out and not self.level and bool(self.shape)

    @property
    def label(self) -> str:
        if self.out:
            return ""
        text = self.level + self.shape + self.tail
        return self.level if self.level and text == self.level + "_" else "" if text == "_" else text


def shape_of(points: list[tuple[float, float]], large: float, medium: float) -> str:
    """Movements from point to point (seconds, Hz), like ones beside each other as one."""
    out = ""
    for (t1, y1), (t2, y2) in zip(points, points[1:], strict=False):
        move = st(y2, y1)
        if abs(move) >= medium:
            sign = "R" if move > 0 else "F"
            out += sign if abs(move) >= large else sign.lower()
        elif len(points) <= 2 or t2 - t1 >= SHORT:
            out += "_"
    for pattern, one in (("[Rr][Rr]", "R"), ("[Ff][Ff]", "F"), ("__+", "_")):
        out = re.sub(pattern, one, out)
    return out


class Turn:
    """The syllables of a turn in order, and the steps that give them levels."""

    def __init__(self, syllables: list[Syllable], own: Range):
        self.s, self.r = syllables, own
        self.large, self.medium = own.steps

    def shapes(self) -> None:
        for s in self.s:
            s.shape = shape_of(s.points, self.large, self.medium)
            if s.shape == "_" and s.end - s.start >= SUSTAIN and abs(s.down) < SUSTAIN_MOVE and s.up < SUSTAIN_MOVE:
                s.shape = "S"

    def extremes(self) -> None:
        """Bottom and top where a movement starts or ends there; pitches far out of the range say nothing."""
        r = self.r
        wide = r.semitones >= 11 and r.nuclei >= 200 and st(r.top, r.median) >= 8
        for s in self.s:
            if st(s.f0_min, r.bottom) <= -4 or st(s.high, r.top) >= 8:
                s.out = True
                continue
            if re.search("[Ff]_?$", s.shape) and s.f0_end <= r.bottom:
                s.tail = ",B"
            if s.shape[:1] in ("_", "R", "r") and s.shape and s.f0_start <= r.bottom:
                s.level = "B"
            if wide and s.f0_start >= r.top:
                s.level = "T" + s.level
            elif wide and re.search("[Rr_F]$", s.shape) and st(s.high, r.top) >= 2:
                s.tail += ",T"

    def before(self, i: int) -> Iterator[Syllable]:
        """Syllables before one, back to those that end too early."""
        for s in reversed(self.s[:i]):
            if self.s[i].start - s.end >= CONTEXT:
                return
            yield s

    def steps(self) -> None:
        """High or mid above the lowest of the syllables before, low below the highest."""
        r = self.r
        for i, s in enumerate(self.s):
            if not s.open:
                continue
            low, high, n = 1000.0, 0.0, 0
            for o in self.before(i):
                if not o.hesitation:
                    low = min(low, o.low) if o.low > r.bottom else low
                    high = max(high, o.high) if o.high < r.top else high
                    n += o.low > r.bottom and o.high < r.top
                if n == NEIGHBOURS:
                    break
            if not n:
                low = high = s.f0_start
            if low < r.bottom or high > r.top:
                continue
            rise = st(s.f0_start, low)
            if rise >= self.medium:
                s.level = "H" if rise >= self.large else "M"
            elif high >= r.bottom and st(s.f0_start, high) <= -self.large:
                s.level = "L"

    def inside(self) -> None:
        """Levels that follow from a syllable's own movement and the range."""
        r = self.r
        quarter = r.median + (r.top - r.median) / 2
        for i, s in enumerate(self.s):
            if not s.open:
                continue
            if re.match("[_r]*[RFrf]", s.shape):
                if re.match("[_r]*R", s.shape) and s.f0_start <= r.median + (r.top - r.median / 4):
                    s.level = "L" if s.f0_start <= r.median else "M"
                elif re.match("[_f]*F", s.shape) and s.f0_end <= r.bottom and s.f0_start < r.median:
                    s.level = "L"
                elif re.match("[_f]*F", s.shape) and s.f0_start >= quarter:
                    s.level = "H"
                elif s.shape[0] == "r":
                    last = next(self.before(i), None)
                    if last and last.level == "L" and 0 <= st(s.f0_start, last.f0_start) < self.medium:
                        s.level = "L"
                elif s.shape[0] == "_" and s.f0_start >= quarter:
                    s.level = "H"

    def carried(self, level: str, step: float, backward: bool) -> str:
        """The level of a syllable whose pitch lies `step` semitones below that of a neighbour with a level."""
        large, medium = self.large, self.medium
        rules = {
            "H": (("L", step >= large), ("H", abs(step) <= FLAT)),
            "M": (("L", step >= medium), ("H", step <= -medium), ("M", abs(step) <= FLAT)),
            "L": (("H", step <= -large), ("M", step <= -medium), ("L", abs(step) <= FLAT)),
            "B": (("L", backward and -large < step <= -medium),),
        }
        return next((to for to, holds in rules[level] if holds), "")

    def carry(self, backward: bool) -> None:
        """From each syllable with a level to the nearest one without that can be told from it, short of the next with one."""
        order = range(len(self.s) - 1, 0, -1) if backward else range(len(self.s) - 1)
        way = -1 if backward else 1
        for i in order:
            s = self.s[i]
            if s.hesitation or s.out or s.level not in ("H", "M", "L", "B"):
                continue
            j = i + way
            while 0 <= j < len(self.s):
                o = self.s[j]
                if (s.start - o.end if backward else o.start - s.end) >= CONTEXT or not o.open:
                    break
                o.level = self.carried(s.level, st(s.f0_start, o.f0_start), backward)
                if o.level:
                    break
                j += way

    def plateaus(self) -> None:
        """Three or more level syllables alike, close together: low if below the median, mid if not far above it."""
        r, i = self.r, 0
        while i < len(self.s):
            s, k, far = self.s[i], i + 1, False
            if s.open and not s.hesitation:
                while k < len(self.s) and self.s[k].start - self.s[k - 1].end <= CLOSE and self.s[k].open and self.s[k].shape == "_" and not self.s[k].tail:
                    far = abs(st(s.f0_start, self.s[k].f0_start)) > FLAT
                    if far:
                        break
                    k += 1
                if k - i >= 3:
                    if s.f0_start < r.median and st(s.f0_start, r.bottom) >= 1:
                        s.level = "L"
                    elif 1 <= st(s.f0_start, r.median) <= st(r.top, r.median) / 2:
                        s.level = "M"
            i = i + 1 if far else k

    def run(self) -> list[str]:
        for act in (self.shapes, self.extremes, self.steps, self.inside):
            act()
        self.carry(True)
        self.carry(False)
        self.plateaus()
        # What was carried carries on, until nothing changes: each round fills at least one more syllable.
        while True:
            open_before = sum(s.open for s in self.s)
            self.carry(False)
            if sum(s.open for s in self.s) == open_before:
                return [s.label for s in self.s]


def pitch_levels(nuclei: DataFrame, ranges: DataFrame, key: str, turn: str | None = None) -> DataFrame:
    """nuclei (key, idx, start, end, points and the pitches of intonation.stylize(), in seconds and Hz[, hesitation]) with a
    label: key, [turn,] idx, label. ranges: key, p02, p25, p50, p75, p98, n (of nuclei).

    Nuclei without a pitch, and speakers without a range, get no row. Points hold seconds and Hz.
    """
    keys = [key, *([turn] if turn else [])]
    hesitation = F.coalesce(F.col("hesitation"), F.lit(False)) if "hesitation" in nuclei.columns else F.lit(False)
    columns = ["start", "end", "f0_start", "f0_end", "lopitch", "hipitch", "f0_min", "intra_up", "intra_down"]
    limits = ["p02", "p25", "p50", "p75", "p98", "n"]
    rows = nuclei.filter("f0_start > 0 AND f0_end > 0").join(ranges.filter("p02 > 0 AND p98 > p02").select(key, *limits), key)
    rows = rows.select(*keys, F.col("idx").cast("long").alias("idx"), *[F.col(c).cast("double").alias(c) for c in columns], "points", hesitation.alias("hesitation"), *limits)

    def labelled(block: pa.Table) -> pa.Table:
        block = block.sort_by([("start", "ascending"), ("idx", "ascending")])
        values = zip(*(block.column(c).to_pylist() for c in columns), strict=True)
        points = [[tuple(p.values()) for p in x] for x in block.column("points").to_pylist()]
        own = Range(*(block.column(c)[0].as_py() for c in limits))
        syllables = [Syllable(*v, p, h) for v, p, h in zip(values, points, block.column("hesitation").to_pylist(), strict=True)]
        return block.select([*keys, "idx"]).append_column("label", pa.array(Turn(syllables, own).run(), pa.string()))

    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    return rows.groupBy(*keys).applyInArrow(labelled, f"{kinds}, idx long, label string")

"""Timing and pitch of syllables: pauses, rhythm, rates and speaker profiles.

Input: nuclei (key, idx, start, end[, pitch]) in seconds, idx in the order of time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PAUSE = 0.35

#: Semitones from the median beyond which a pitch is an outlier.
PITCH_BAND = 18.0


def semitones(hz: Column, base: Column | float) -> Column:
    b = base if isinstance(base, Column) else F.lit(base)
    return 12 * F.log2(hz / b)


def pauses(nuclei: DataFrame, key: str, least: float = PAUSE, length: DataFrame | None = None, rejected: DataFrame | None = None) -> DataFrame:
    """nuclei with before_pause, pause_dur and after_pause.

    A pause is a gap of `least` or more to the next nucleus, or to a rejected one (key, start) in the
    gap; the last nucleus pauses to the end of the signal (key, duration), where that is given.
    """
    w = Window.partitionBy(key).orderBy("idx")
    n = nuclei.withColumn("next_start", F.lead("start").over(w))
    if length is not None:
        n = n.join(length.select(key, "duration"), key, "left").withColumn("next_start", F.coalesce("next_start", "duration")).drop("duration")
    if rejected is not None:
        r = rejected.select(key, F.col("start").alias("r_start"))
        first = n.join(r, key).filter((F.col("r_start") >= F.col("end")) & (F.col("r_start") < F.col("next_start"))).groupBy(key, "idx").agg(F.min("r_start").alias("r_start"))
        n = n.join(first, [key, "idx"], "left").withColumn("next_start", F.coalesce("r_start", "next_start")).drop("r_start")
    gap = F.col("next_start") - F.col("end")
    n = n.withColumn("before_pause", F.coalesce(gap >= least, F.lit(False))).withColumn("pause_dur", F.when(F.col("before_pause"), gap).otherwise(0.0))
    return n.withColumn("after_pause", F.coalesce(F.lag("before_pause").over(w), F.lit(False))).drop("next_start")


def npvi(durations: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Normalised pairwise variability of durations in order; 0 for fewer than two."""
    w = Window.partitionBy(key).orderBy(*order)
    d = durations.select(key, F.col(value).cast("double").alias("d"), F.lag(F.col(value).cast("double")).over(w).alias("p"))
    term = F.when(F.col("p").isNotNull() & (F.col("p") + F.col("d") != 0), F.abs(F.col("p") - F.col("d")) / ((F.col("p") + F.col("d")) / 2))
    return d.groupBy(key).agg(F.coalesce(100 * F.sum(term) / F.nullif(F.count("p"), F.lit(0)), F.lit(0.0)).alias("npvi"))


def inter_onset(nuclei: DataFrame, key: str, least: float = PAUSE, speaker: str | None = None) -> DataFrame:
    """Time from each onset to the next; null before a pause or another speaker's turn."""
    w = Window.partitionBy(key).orderBy("idx")
    new_turn = (F.lead(speaker).over(w) != F.col(speaker)) if speaker else F.lit(False)
    following = F.lead("start").over(w)
    keep = (following - F.col("end") < least) & ~F.coalesce(new_turn, F.lit(False))
    return nuclei.withColumn("inter_onset", F.when(keep, following - F.col("start")))


def local_rate(nuclei: DataFrame, key: str, span_ms: int = 2000) -> DataFrame:
    """Nuclei a second in the span around each, over the time that the span covers from first start to last end."""
    at = F.round(F.col("start") * 1000).cast("long")
    n = nuclei.withColumn("at_ms", at)
    w = Window.partitionBy(key).orderBy("at_ms").rangeBetween(-span_ms, span_ms)
    time = F.max("end").over(w) - F.min("start").over(w)
    return n.withColumn("rate", F.when(time > 0, F.count(F.lit(1)).over(w) / time)).drop("at_ms")


def speech_profile(nuclei: DataFrame, key: str, least: float = PAUSE) -> DataFrame:
    """A row for each speaker: nuclei, speaking and pausing time and their shares, rates, durations, and pitch movements if there is a pitch."""
    p = pauses(nuclei, key, least).withColumn("dur", F.col("end") - F.col("start"))
    if "pitch" in nuclei.columns:
        w = Window.partitionBy(key).orderBy("idx")
        p = p.withColumn("move", F.when(F.col("pitch") > 0, semitones(F.col("pitch"), F.lag(F.when(F.col("pitch") > 0, F.col("pitch"))).over(w))))
    total = F.max("end") - F.min("start")
    pausing = F.sum("pause_dur")
    out = [
        F.count(F.lit(1)).alias("n_nuclei"),
        total.alias("total_time"),
        pausing.alias("pause_time"),
        (total - pausing).alias("phonation_time"),
        F.sum(F.col("before_pause").cast("int")).alias("n_pauses"),
        F.when(total > 0, 100 * pausing / total).alias("pause_percent"),
        F.when(total > 0, 100 * (total - pausing) / total).alias("phonation_percent"),
        F.when(total > 0, F.count(F.lit(1)) / total).alias("speech_rate"),
        F.when(total - pausing > 0, F.count(F.lit(1)) / (total - pausing)).alias("articulation_rate"),
        F.avg("dur").alias("mean_duration"),
        F.stddev_pop("dur").alias("sd_duration"),
    ]
    if "pitch" in nuclei.columns:
        out += [
            F.sum((F.col("move") >= 4).cast("int")).alias("rises"),
            F.sum((F.col("move") <= -4).cast("int")).alias("falls"),
            F.sum(F.abs("move")).alias("trajectory"),
        ]
    return p.groupBy(key).agg(*out)


def pitch_range(pitches: DataFrame, key: str, value: str, band: float = PITCH_BAND) -> DataFrame:
    """Quantiles, mean, spread and range of a speaker's pitch (Hz) without values more than `band` semitones from the median."""
    p = pitches.select(key, F.col(value).cast("double").alias("hz")).filter("hz > 0")
    middle = p.groupBy(key).agg(F.median("hz").alias("mid"))
    near = p.join(middle, key).filter(F.abs(semitones(F.col("hz"), F.col("mid"))) <= band)
    q = {"p02": 0.02, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p98": 0.98}
    out = near.groupBy(key).agg(*[F.percentile("hz", x).alias(n) for n, x in q.items()], F.avg("hz").alias("mean_hz"), F.stddev_pop("hz").alias("sd_hz"), F.count(F.lit(1)).alias("n"))
    return out.withColumn("range_semitones", semitones(F.col("p98"), F.col("p02")))


def intervals_at(points: DataFrame, intervals: DataFrame, key: str) -> DataFrame:
    """points (key, at, ...) with the label of the interval (key, start, end, label) that holds each; null outside of all."""
    tier = intervals.select(key, F.col("start").alias("from"), F.col("end").alias("to"), "label")
    w = Window.partitionBy(key).orderBy("t", "kind").rowsBetween(Window.unboundedPreceding, 0)
    marks = tier.select(key, F.col("from").alias("t"), F.lit(0).alias("kind"), F.struct("to", "label").alias("last"), F.lit(None).cast(points.select(F.struct("*")).schema[0].dataType).alias("row"))
    rows = points.select(key, F.col("at").alias("t"), F.lit(1).alias("kind"), F.lit(None).cast(marks.schema["last"].dataType).alias("last"), F.struct("*").alias("row"))
    # An as-of join: the interval that began last, if it goes on.
    held = marks.unionByName(rows).withColumn("last", F.last("last", ignorenulls=True).over(w)).filter("kind = 1")
    return held.select("row.*", F.when(F.col("last.to") > F.col("t"), F.col("last.label")).alias("label"))


def phone_durations(syllables: DataFrame, phones: DataFrame, key: str) -> DataFrame:
    """Onset, vowel and rhyme of syllables (key, idx, start, end) from phones (key, start, end, is_vowel) inside them.

    A phone belongs to the syllable that holds its start, if it ends there too.
    """
    tier = syllables.select(key, "start", "end", F.struct("idx", F.col("end").alias("till")).alias("label"))
    points = phones.select(key, F.col("start").alias("at"), F.col("end").alias("p_end"), "is_vowel")
    inside = intervals_at(points, tier, key).filter("is_vowel AND p_end <= label.till")
    v = inside.groupBy(key, F.col("label.idx").alias("idx")).agg(F.min("at").alias("v_start"), F.max("p_end").alias("v_end"))
    out = syllables.join(v, [key, "idx"], "left")
    return out.select(key, "idx", (F.col("v_start") - F.col("start")).alias("onset_dur"), (F.col("v_end") - F.col("v_start")).alias("vowel_dur"), (F.col("end") - F.col("v_start")).alias("rhyme_dur"))


def glissando(nuclei: DataFrame, threshold: float = 0.32) -> DataFrame:
    """nuclei (start, end, pitch_start, pitch_end in Hz) with the slope in semitones a second, and whether it is heard as a glide.

    A movement is heard when its rate is at least threshold / T^2, T being its duration.
    """
    t = F.col("end") - F.col("start")
    slope = F.when((t > 0) & (F.col("pitch_start") > 0) & (F.col("pitch_end") > 0), semitones(F.col("pitch_end"), F.col("pitch_start")) / t)
    n = nuclei.withColumn("slope", slope)
    return n.withColumn("is_glide", F.coalesce(F.abs("slope") >= threshold / (t * t), F.lit(False)))


def normalized_pitch(pitches: DataFrame, key: str, value: str, band: float = PITCH_BAND) -> DataFrame:
    """pitches with pitch_percent: the place in semitones inside the speaker's range, 0 at its 2nd and 100 at its 98th percentile."""
    r = pitch_range(pitches, key, value, band).select(key, "p02", "range_semitones")
    place = 100 * semitones(F.col(value).cast("double"), F.col("p02")) / F.col("range_semitones")
    joined = pitches.join(r, key, "left")
    return joined.withColumn("pitch_percent", F.when((F.col(value) > 0) & (F.col("range_semitones") > 0), place)).drop("p02", "range_semitones")


def hesitations(phones: DataFrame, least: float = 0.3) -> DataFrame:
    """Phones that last `least` or more with a level or slightly falling tone (intra, semitones)."""
    return phones.filter((F.col("end") - F.col("start") >= least) & (F.col("intra") > -3) & (F.col("intra") <= 0))

"""Words, speakers and utterances of timed transcripts."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from .segment import starts_after

UNKNOWN, ONLY = "UNKNOWN", "SPEAKER_0"


def interval_join(words: DataFrame, segments: DataFrame, key: str, bucket: float = 10.0) -> DataFrame:
    """Pairs of words (key, word_idx, start, end) and segments (key, seg_idx, start, end, speaker) that touch.

    Both sides are repeated for the time buckets they reach into and joined on them; a pair is kept
    in the bucket of its later start only, so long recordings don't meet themselves whole.
    """
    reach = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / bucket).cast("long"), F.floor(F.greatest(a, b) / bucket).cast("long")))
    w = words.withColumn("bucket", reach("start", "end"))
    s = segments.select(key, "seg_idx", "speaker", F.col("start").alias("seg_start"), F.col("end").alias("seg_end")).withColumn("bucket", reach("seg_start", "seg_end"))
    own = F.col("bucket") == F.floor(F.greatest("start", "seg_start") / bucket).cast("long")
    return w.join(s, [key, "bucket"]).filter((F.col("seg_start") < F.col("end")) & (F.col("seg_end") >= F.col("start")) & own).drop("bucket")


def word_speakers(words: DataFrame, segments: DataFrame, key: str, speakers: int | None = None, bucket: float = 10.0) -> DataFrame:
    """words with the speaker who overlaps each longest, ties to the one heard first; UNKNOWN where nobody does.

    A word that starts inside a segment counts there with its whole length. Without any segments at
    all and one speaker, all words are that speaker's.
    """
    inside = (F.col("seg_start") <= F.col("start")) & (F.col("start") < F.col("seg_end"))
    shared = F.greatest(F.lit(0.0), F.least("end", "seg_end") - F.greatest("start", "seg_start"))
    pairs = interval_join(words, segments, key, bucket).withColumn("overlap", F.when(inside, F.col("end") - F.col("start")).otherwise(shared))
    by = pairs.groupBy(key, "word_idx", "speaker").agg(F.sum("overlap").alias("overlap"), F.min("seg_idx").alias("seg_idx")).filter("overlap > 0")
    best = by.groupBy(key, "word_idx").agg(F.max_by("speaker", F.struct("overlap", -F.col("seg_idx"))).alias("speaker"))
    default = ONLY if speakers == 1 else UNKNOWN
    return words.join(best, [key, "word_idx"], "left").withColumn("speaker", F.coalesce("speaker", F.lit(default)))


def utterances(words: DataFrame, key: str) -> DataFrame:
    """key, utt_idx, text, start_time, end_time, speaker, confidence: words up to one that ends a sentence.

    The speaker of most words speaks, of equals the one heard first; confidence is their share.
    """
    u = words.withColumn("utt_idx", starts_after(F.col("word").rlike("[.?!]$"), [key], "word_idx"))
    n = u.groupBy(key, "utt_idx", "speaker").agg(F.count(F.lit(1)).alias("n"), F.min("word_idx").alias("first"))
    most = n.groupBy(key, "utt_idx").agg(F.max_by("speaker", F.struct("n", -F.col("first"))).alias("speaker"), F.max("n").alias("most"), F.sum("n").alias("total"))
    text = u.groupBy(key, "utt_idx").agg(F.sort_array(F.collect_list(F.struct("word_idx", "word"))).alias("rows"), F.min("start").alias("start_time"), F.max("end").alias("end_time"))
    return text.join(most, [key, "utt_idx"]).select(key, "utt_idx", F.array_join(F.transform("rows", lambda r: r["word"]), " ").alias("text"), "start_time", "end_time", "speaker", F.round(F.col("most") / F.col("total"), 2).alias("confidence"))


def transcript_text(utts: DataFrame, key: str, speakers: int = 2) -> DataFrame:
    """One text a recording: `SPEAKER: text` lines for several speakers, else the texts alone."""
    line = F.concat("speaker", F.lit(": "), "text") if speakers > 1 else F.col("text")
    rows = utts.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("utt_idx", line.alias("line")))).alias("rows"))
    return rows.select(key, F.array_join(F.transform("rows", lambda r: r["line"]), "\n" if speakers > 1 else " ").alias("text"))


def uniform_timings(chunks: DataFrame, key: str, duration: Column, start: Column | None = None) -> DataFrame:
    """Words of texts with equal shares of the duration, 0.2 s at least in all: key, word_idx, word, start_time, end_time."""
    length = F.greatest(duration.cast("double"), F.lit(0.2))
    base = start.cast("double") if start is not None else F.lit(0.0)
    rows = chunks.select(key, length.alias("d"), base.alias("s"), T.words("text").alias("words"))
    rows = rows.select(key, "d", "s", F.size("words").alias("n"), F.posexplode("words").alias("word_idx", "word"))
    share = F.col("d") / F.col("n")
    return rows.select(key, "word_idx", "word", (F.col("s") + F.col("word_idx") * share).alias("start_time"), (F.col("s") + (F.col("word_idx") + 1) * share).alias("end_time"))


def repair_timestamps(words: DataFrame, key: str, duration: str = "duration") -> DataFrame:
    """Words (key, word_idx, word, start_time, end_time, duration) with times that can be used.

    Rows without a word or without both times go. A missing start is the end of the word kept before; a
    missing end is 0.25 s later; times lie between 0 and the duration, and a word lasts 1 ms at least,
    those that can't go. One pass over a recording's words, as each repair rests on the one before.
    """
    usable = words.filter("word IS NOT NULL AND trim(word) <> '' AND (start_time IS NOT NULL OR end_time IS NOT NULL)")
    rows = usable.select(key, F.col("word_idx").cast("int").alias("word_idx"), F.trim("word").alias("word"), F.col("start_time").cast("double").alias("start_time"), F.col("end_time").cast("double").alias("end_time"), F.col(duration).cast("double").alias("most"))

    def repaired(block: pa.Table) -> pa.Table:
        block = block.sort_by([("word_idx", "ascending"), ("word", "ascending"), ("start_time", "ascending"), ("end_time", "ascending")])
        most = max((x for x in block.column("most").to_pylist() if x is not None), default=math.inf)
        kept, starts, ends, last = [], [], [], 0.0
        for i, (s, e) in enumerate(zip(block.column("start_time").to_pylist(), block.column("end_time").to_pylist(), strict=True)):
            s = last if s is None else s
            e = min(s + 0.25, most) if e is None else e
            s = max(s, 0.0)
            e = min(max(e, s + 1e-3), most)
            s = min(s, most)
            e = e if e > s else min(s + 1e-3, most)
            if e > s:
                kept.append(i)
                starts.append(s)
                ends.append(e)
                last = e
        return block.take(pa.array(kept, pa.int64())).select([key, "word_idx", "word"]).append_column("start_time", pa.array(starts, pa.float64())).append_column("end_time", pa.array(ends, pa.float64()))

    kind = rows.schema[key].dataType.simpleString()
    return rows.groupBy(key).applyInArrow(repaired, f"{key} {kind}, word_idx int, word string, start_time double, end_time double")


def combine_chunks(chunks: DataFrame, key: str) -> DataFrame:
    """Texts of a recording's chunks in order, as one."""
    rows = chunks.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("chunk_idx", "transcript"))).alias("rows"))
    return rows.select(key, F.array_join(F.transform("rows", lambda r: r["transcript"]), " ").alias("transcript"), F.size("rows").alias("n_chunks"))


def pending(files: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Files without both outputs: done has a row for each output (key, kind)."""
    both = done.groupBy(key).agg(F.count_distinct("kind").alias("kinds")).filter("kinds >= 2")
    return files.join(both, key, "left_anti")


def rms_gain(samples: DataFrame, key: str, value: str, target_db: float = -20.0) -> DataFrame:
    """Root mean square of a recording's samples and the gain that brings it to the target; 1 for silence."""
    rms = F.sqrt(F.avg(F.col(value) * F.col(value)))
    out = samples.groupBy(key).agg(rms.alias("rms"))
    return out.withColumn("gain", F.when(F.col("rms") > 0, 10 ** (target_db / 20) / F.col("rms")).otherwise(1.0))


def silences(frames: DataFrame, key: str, min_ms: int, threshold_db: float, frame_ms: int = 10) -> DataFrame:
    """Runs of quiet frames (key, frame, rms from 0 to 1) of min_ms or more: key, start_ms, end_ms; gaps and islands."""
    quiet = frames.filter(F.col("rms") <= 10 ** (threshold_db / 20))
    island = F.col("frame") - F.row_number().over(Window.partitionBy(key).orderBy("frame"))
    runs = quiet.withColumn("island", island).groupBy(key, "island").agg(F.min("frame").alias("a"), F.max("frame").alias("b"))
    runs = runs.select(key, (F.col("a") * frame_ms).alias("start_ms"), ((F.col("b") + 1) * frame_ms).alias("end_ms"))
    return runs.filter(F.col("end_ms") - F.col("start_ms") >= min_ms)

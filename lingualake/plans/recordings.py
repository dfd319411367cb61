"""Recordings to transcripts: words and speakers come from providers, the rest is joins and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import providers
from ..operators import acoustics, intonation, prosody, segment, speech
from ..operators import alignment as align
from ..sources import readers


def chunks(audio: DataFrame, min_silence_ms: int = 1000, threshold_db: float = -30.0, min_ms: int = 90_000, max_ms: int = 150_000) -> DataFrame:
    """Recordings of readers.read_wav() cut in their silences: file_id, idx, start_ms, end_ms."""
    frames = audio.select(F.col("path").alias("file_id"), F.explode("frames").alias("f")).select("file_id", "f.frame", "f.rms")
    quiet = speech.silences(frames, "file_id", min_silence_ms, threshold_db)
    lengths = audio.select(F.col("path").alias("file_id"), F.round(F.col("seconds") * 1000).cast("long").alias("length_ms"))
    return segment.merge_intervals(segment.interval_points(quiet, lengths), min_ms, max_ms)


def voice(files: DataFrame, offset: float = 0.0, duration: float | None = None, settings: acoustics.Settings = acoustics.Settings(), thresholds: intonation.Thresholds = intonation.Thresholds()) -> dict[str, DataFrame]:
    """PCM files (path, content) with what their signal tells: frames with pitch and level, functionals of each recording,
    syllables between dips of the level in voiced stretches, their nuclei with stylized pitch, and a profile of the nuclei.

    Frames are the one table that the others share; cache or write it where more than one of them is used.
    """
    step = settings.step
    samples = readers.read_samples(files, offset, duration, reach=settings.reach)
    frames = acoustics.track(acoustics.frames(samples, "path", settings), "path", settings)
    frames = frames.withColumn("db", 20 * F.log10(F.col("rms") / 2e-5 + 1e-12))
    syllables = intonation.syllables(frames.withColumn("db", F.when(F.col("hz").isNotNull(), F.col("db"))), "path", "db", step=step)
    spans = syllables.select("path", "idx", F.col("left").alias("first"), F.col("right").alias("last"))
    nuclei = intonation.stylize(frames, spans, "path", step, thresholds)
    timed = nuclei.filter("valid").select("path", "idx", (F.col("first_frame") * step).alias("start"), ((F.col("last_frame") + 1) * step).alias("end"), F.col("f0_median").alias("pitch"))
    return {"frames": frames, "functionals": acoustics.functionals(frames, "path", settings), "syllables": syllables, "nuclei": nuclei, "profile": prosody.speech_profile(timed, "path")}


def transcribe(files: DataFrame, asr: str, diarization: str | None = None, speakers: int = 1, done: DataFrame | None = None, alignment: str | None = None, texts: DataFrame | None = None) -> dict[str, DataFrame]:
    """Files (path) with words, utterances, texts and nested transcriptions, and those that have no words at all: failed.

    asr and alignment give path, word_idx, word, start, end; diarization gives path, seg_idx, start, end, speaker and is
    asked for with more than one speaker only. done: outputs that exist (path, kind); their files are left out. Where
    an alignment is asked for, its words are taken, and those of the recognition for files that it has none of; files
    without either get even times for the words of their text (texts: path, transcript, duration).
    """
    todo = speech.pending(files, done, "path") if done is not None else files
    words = providers.get("asr", asr)(todo).select("path", "word_idx", "word", "start", "end")
    if alignment:
        words = align.with_fallback(providers.get("alignment", alignment)(todo), words, key="path")
    if texts is not None:
        spoken = texts.join(todo.select("path"), "path", "left_semi").select("path", F.col("transcript").alias("text"), "duration")
        even = speech.uniform_timings(spoken, "path", F.col("duration")).withColumnsRenamed({"start_time": "start", "end_time": "end"})
        words = align.with_fallback(words, even, key="path")
    failed = todo.select("path").join(words.select("path").distinct(), "path", "left_anti")
    if speakers > 1 and diarization:
        segments = providers.get("diarization", diarization)(todo)
        words = speech.word_speakers(words, segments, "path", speakers)
    else:
        segments = None
        words = words.withColumn("speaker", F.lit(speech.ONLY if speakers == 1 else speech.UNKNOWN))
    utterances = speech.utterances(words, "path")
    spoken_texts = speech.transcript_text(utterances, "path", speakers)
    w = words.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("word_idx", "word", F.col("start").alias("start_time"), F.col("end").alias("end_time"), "speaker"))).alias("w"))
    w = w.select("path", F.transform("w", lambda x: x.dropFields("word_idx")).alias("all_words"))
    u = utterances.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("utt_idx", "text", "start_time", "end_time", "speaker", "confidence"))).alias("u"))
    u = u.select("path", F.transform("u", lambda x: x.dropFields("utt_idx")).alias("combined_utterances"))
    nested = todo.select("path").join(spoken_texts.withColumnRenamed("text", "transcript_text"), "path").join(w, "path").join(u, "path")
    if segments is not None:
        s = segments.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("start", "end", "speaker"))).alias("speaker_segments"))
        nested = nested.join(s, "path", "left")
    else:
        nested = nested.withColumn("speaker_segments", F.array().cast("array<struct<start: double, end: double, speaker: string>>"))
    nested = nested.withColumn("metadata", F.lit(None).cast("map<string,string>")).withColumnRenamed("path", "audio_file_path")
    return {"words": words, "utterances": utterances, "texts": spoken_texts, "transcriptions": nested, "failed": failed}

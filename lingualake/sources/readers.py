"""Readers of transcripts and recordings.

Plain text, JSON and tables go through Spark's own readers; packed formats are decoded in Arrow
batches from binaryFile rows, so any file system that Spark reads will do.
"""

from __future__ import annotations

import io
import re
import wave
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .entities import entity, file_name, is_hidden, parse_entities

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_text(data: bytes) -> str:
    """Paragraphs of a DOCX document, two line breaks between them; tabs and breaks as characters."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    out = []
    for p in root.iter(f"{_W}p"):
        line = []
        for x in p.iter():
            if x.tag == f"{_W}t":
                line.append(x.text or "")
            elif x.tag == f"{_W}tab":
                line.append("\t")
            elif x.tag in (f"{_W}br", f"{_W}cr"):
                line.append("\n")
        out.append("".join(line))
    return "\n\n".join(out).strip()


# RTF destinations whose content is no text.
_HIDDEN = frozenset("fonttbl colortbl stylesheet info pict object header footer headerl headerr footerl footerr listtable listoverridetable generator themedata colorschememapping latentstyles datastore xmlnstbl rsidtbl fldinst".split())
# RTF words that stand for characters.
_CHARACTERS = {"par": "\n", "line": "\n", "sect": "\n", "page": "\n", "tab": "\t", "cell": "|", "row": "\n", "emdash": "\u2014", "endash": "\u2013", "lquote": "\u2018", "rquote": "\u2019", "ldblquote": "\u201c", "rdblquote": "\u201d", "bullet": "\u2022", "~": "\u00a0", "_": "-", "emspace": "\u2003", "enspace": "\u2002"}
_TOKEN = re.compile(rb"\\([a-z]{1,32})(-?\d{1,10})?[ ]?|\\'([0-9a-fA-F]{2})|\\([^a-z])|([{}])|[\r\n]+|([^\\{}\r\n]+)")


def rtf_text(data: bytes) -> str:
    """Text of an RTF document; its declared code page decodes bytes, errors ignored."""
    page = re.search(rb"\\ansicpg(\d+)", data)
    code = f"cp{page[1].decode()}" if page else "cp1252"
    try:
        "".encode(code)
    except LookupError:
        code = "cp1252"
    out: list[str] = []
    held = bytearray()  # bytes of one run, as characters may take two
    stack: list[tuple[bool, int]] = []
    hidden, skip, uc = False, 0, 1

    def flush() -> None:
        if held:
            out.append(held.decode(code, "ignore"))
            held.clear()

    for m in _TOKEN.finditer(data):
        word, number, byte, sign, brace, text = m.groups()
        if brace:
            flush()
            if brace == b"{":
                stack.append((hidden, uc))
            elif stack:
                hidden, uc = stack.pop()
            skip = 0
        elif word:
            w = word.decode()
            if w in _HIDDEN:
                hidden = True
            elif w == "uc":
                uc = int(number or 1)
            elif w == "u" and number and not hidden:
                flush()
                out.append(chr(int(number) & 0xFFFF))
                skip = uc
            elif w in _CHARACTERS and not hidden:
                flush()
                out.append(_CHARACTERS[w])
        elif byte:
            if skip:
                skip -= 1
            elif not hidden:
                held += bytes([int(byte, 16)])
        elif sign:
            if sign == b"*":
                hidden = True
            elif not hidden:
                flush()
                s = sign.decode("latin-1")
                out.append("\n" if s in "\r\n" else _CHARACTERS.get(s, s))
        elif text and not hidden:
            flush() if skip else None
            held += text[skip:]
            skip = max(0, skip - len(text))
    flush()
    joined = "".join(out)
    return joined.encode("utf-16", "surrogatepass").decode("utf-16", "ignore")


def pdf_text(data: bytes) -> str:
    """Text of a PDF document's pages; needs the optional library pypdf."""
    try:
        from pypdf import PdfReader
    except ImportError as e:
        raise RuntimeError("reading PDF files needs pypdf") from e
    return "".join((p.extract_text() or "") + "\n" for p in PdfReader(io.BytesIO(data)).pages).strip()


DECODERS = {".txt": lambda b: b.decode("utf-8"), ".docx": docx_text, ".rtf": rtf_text, ".pdf": pdf_text}


def read_text(files: DataFrame) -> DataFrame:
    """Files (path, content, ...) with text and error: one is null. An unknown extension is an error of its row."""
    columns = [c for c in files.columns if c != "content"]
    schema = F.struct(*columns)
    kind = files.select(schema.alias("row")).schema[0].dataType

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, errors = [], []
            for path, data in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                ext = re.search(r"\.[^./]*$", path)
                try:
                    if not ext or ext[0].lower() not in DECODERS:
                        raise ValueError(f"unsupported file type {ext[0] if ext else ''!r}")
                    texts.append(DECODERS[ext[0].lower()](data))
                    errors.append(None)
                except Exception as e:  # one bad file doesn't stop a corpus: its row says why
                    texts.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(texts, pa.string()), pa.array(errors, pa.string())], ["row", "text", "error"])

    out = files.select("path", "content", schema.alias("row")).mapInArrow(decoded, f"row {kind.simpleString()}, text string, error string")
    return out.select("row.*", "text", "error")


def wav_info(data: bytes) -> tuple[int, int, float, np.ndarray]:
    """Rate, channels, seconds and samples (-1 to 1, channels averaged) of PCM audio."""
    with wave.open(io.BytesIO(data)) as w:
        rate, channels, width, n = w.getframerate(), w.getnchannels(), w.getsampwidth(), w.getnframes()
        raw = w.readframes(n)
    if width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] | (b[:, 1] << 8) | (b[:, 2] << 16)) << 8 >> 8) / 8388608.0
    elif width == 1:
        x = (np.frombuffer(raw, np.uint8).astype(float) - 128) / 128
    else:
        x = np.frombuffer(raw, f"<i{width}") / float(1 << (8 * width - 1))
    return rate, channels, n / rate, x.reshape(-1, channels).mean(axis=1)


def _frame_values(x: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Root mean square and share of zero crossings of each run of `size` samples; the last may be shorter."""
    starts = np.arange(0, len(x), size)
    if not len(starts):
        return np.empty(0), np.empty(0)
    long = np.diff(np.append(starts, len(x)))
    crossed = np.append(0, np.diff(np.signbit(x).astype(np.int64)) != 0)
    crossed[starts] = 0  # a crossing lies inside a run
    return np.sqrt(np.add.reduceat(x * x, starts) / long), np.add.reduceat(crossed, starts) / np.maximum(long - 1, 1)


def read_wav(files: DataFrame, offset: float = 0.0, duration: float | None = None, frame_ms: int = 10) -> DataFrame:
    """PCM files (path, content) as path, rate, channels, seconds, frames: root mean squares of short frames of the slice."""
    kind = pa.struct([("frame", pa.int64()), ("rms", pa.float64()), ("zcr", pa.float64())])

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, data in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                rate, channels, seconds, x = wav_info(data)
                x = x[int(offset * rate) : None if duration is None else int((offset + duration) * rate)]
                rms, zcr = _frame_values(x, max(1, rate * frame_ms // 1000))
                rows = pa.StructArray.from_arrays([pa.array(np.arange(len(rms))), pa.array(rms), pa.array(zcr)], fields=list(kind))
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([rate], pa.int32()), pa.array([channels], pa.int32()), pa.array([seconds]), pa.ListArray.from_arrays(pa.array([0, len(rms)], pa.int32()), rows)], ["path", "rate", "channels", "seconds", "frames"])

    return files.select("path", "content").mapInArrow(decoded, "path string, rate int, channels int, seconds double, frames array<struct<frame: long, rms: double, zcr: double>>")


def read_samples(files: DataFrame, offset: float = 0.0, duration: float | None = None, seconds: float = 10.0, reach: float = 0.1) -> DataFrame:
    """PCM files (path, content) as blocks of samples that overlap by `reach` seconds: path, rate, start, first, last, samples.

    A block owns the places from first to last (excluded); its samples begin at the place `start`. This is what the
    operators on frames take, so nothing has to be put together again.
    """

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, data in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                rate, _, _, x = wav_info(data)
                x = x[int(offset * rate) : None if duration is None else int((offset + duration) * rate)]
                size, halo = max(1, int(seconds * rate)), int(reach * rate) + 1
                for first in range(0, len(x), size):
                    last, start = min(first + size, len(x)), max(0, first - halo)
                    part = x[start : last + halo]
                    samples = pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), pa.array(part))
                    yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([rate], pa.int32()), *(pa.array([n], pa.int64()) for n in (start, first, last)), samples], ["path", "rate", "start", "first", "last", "samples"])

    return files.select("path", "content").mapInArrow(decoded, "path string, rate int, start long, first long, last long, samples array<double>")


def acoustic_functionals(audio: DataFrame) -> DataFrame:
    """A row of functionals for each recording of read_wav(): loudness and zero crossings over its frames."""
    f = audio.select("path", "seconds", F.explode("frames").alias("f"))
    return f.groupBy("path").agg(F.max("seconds").alias("recording_length"), F.avg("f.rms").alias("rms_mean"), F.stddev_pop("f.rms").alias("rms_std"), F.percentile("f.rms", 0.2).alias("rms_p20"), F.percentile("f.rms", 0.8).alias("rms_p80"), F.avg("f.zcr").alias("zcr_mean"), F.stddev_pop("f.zcr").alias("zcr_std"))


def write_wav(rate: int, samples) -> bytes:
    """Samples (-1 to 1) as 16-bit PCM."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(np.clip(np.round(np.asarray(samples, float) * 32767), -32768, 32767).astype("<i2").tobytes())
    return out.getvalue()


def normalized_wav(files: DataFrame, target_db: float = -20.0) -> DataFrame:
    """Files (path, content) with the content brought to the target loudness, as path, content."""

    def done(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for data in b.column("content").to_pylist():
                rate, _, _, x = wav_info(data)
                rms = float(np.sqrt((x * x).mean())) if len(x) else 0.0
                out.append(write_wav(rate, x * (10 ** (target_db / 20) / rms if rms else 1.0)))
            yield pa.RecordBatch.from_arrays([b.column("path"), pa.array(out, pa.binary())], ["path", "content"])

    return files.select("path", "content").mapInArrow(done, "path string, content binary")


# The nested form of a stored transcription.
TRANSCRIPTION = "audio_file_path string, metadata map<string,string>, transcript_text string, all_words array<struct<word: string, start_time: double, end_time: double, speaker: string>>, combined_utterances array<struct<text: string, start_time: double, end_time: double, speaker: string, confidence: double>>, speaker_segments array<struct<start: double, end: double, speaker: string>>"


def read_transcriptions(spark: SparkSession, path: str) -> DataFrame:
    """Stored transcriptions, one a file, with empty lists for what is missing."""
    df = spark.read.schema(TRANSCRIPTION).option("multiLine", True).json(path)
    lists = [f.name for f in df.schema if f.dataType.typeName() == "array"]
    return df.withColumns({c: F.coalesce(F.col(c), F.array().cast(df.schema[c].dataType)) for c in lists}).withColumn("transcript_text", F.coalesce("transcript_text", F.lit("")))


def transcript_documents(spark: SparkSession, derivatives: str, key: str | None = None, value: str | None = None) -> DataFrame:
    """Texts under derivatives/transcription named *_transcript.txt, without those whose key has another value."""
    d = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*_transcript.txt").text(f"{derivatives}/transcription").select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    d = d.withColumn("name", file_name(F.col("path"))).filter(~is_hidden("name")).withColumn("entities", parse_entities("name"))
    return d.filter(entity(key).isNull() | (entity(key) == value)) if key else d


def documents_of_transcripts(audio: DataFrame, transcripts: DataFrame) -> DataFrame:
    """Recordings (path) joined with their transcripts (path, text) by the stem of the file name."""
    stem = lambda c: F.regexp_replace(file_name(F.col(c)), r"(_transcript)?\.[^.]*$", "")
    t = transcripts.select(stem("path").alias("stem"), "text")
    return audio.withColumn("stem", stem("path")).join(t, "stem").withColumnRenamed("path", "origin")


def read_similarity_csv(spark: SparkSession, path: str) -> DataFrame:
    """Similarity tables written in sections: path, section_idx (from 0), metric, score; headers and blanks dropped."""
    # Whole files: the order of lines holds however large a file is.
    rows = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.posexplode(F.split("value", "\r?\n")).alias("n", "value"))
    w = Window.partitionBy("path").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    new = F.trim(F.replace("value", F.lit(","), F.lit(""))) == "New Section"
    rows = rows.withColumn("section_idx", F.sum(new.cast("int")).over(w))
    cells = F.split("value", ",")
    scored = rows.select("path", "section_idx", F.replace(F.get(cells, F.lit(0)), F.lit('"'), F.lit("")).alias("metric"), F.expr("try_cast(replace(get(split(value, ','), 1), '\"', '') as double)").alias("score"))
    return scored.filter(F.col("score").isNotNull() & ~F.isnan("score"))


def read_profile_tables(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated tables of a prosody tool."""
    return spark.read.option("sep", "\t").option("header", True).option("inferSchema", False).csv(path)

"""Segmentation: texts into sections, speaker turns, sentences and chunks.

Order is a column everywhere. Running sums over flags name the segments; keys never repeat across
documents, so each window holds one document.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..session import prepare

#: What may stand before a section title: 1. IV. a) A) 1) and the last three with a dot.
ENUMERATOR = r"(?:[0-9]+\.|[IVX]+\.|(?:[a-zA-Z]|[0-9]+)\)\.?)\s*"


def running(flag: Column, key: Sequence[str], order: str) -> Column:
    """How many flags stand at or before a row."""
    w = Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return F.sum(flag.cast("int")).over(w)


def starts_after(end: Column, key: Sequence[str], order: str) -> Column:
    """Number, from 0, of the segment of a row, segments ending with flagged rows."""
    w = Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(end.cast("int")).over(w), F.lit(0))


def document_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.select("doc_id", F.posexplode(T.lines(text)).alias("line_no", "line"))


def untitled_sections(docs: DataFrame, has_title: bool = False) -> DataFrame:
    """One section a document: its first line as the title and the rest, or all under a fixed title."""
    if not has_title:
        return docs.select("doc_id", F.lit("untitled section").alias("title"), T.strip("text").alias("content"))
    rows = T.lines("text")
    rest = F.array_join(F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))), "\n")
    return docs.select("doc_id", T.strip(F.get(rows, F.lit(0))).alias("title"), T.strip(rest).alias("content"))


def title_pattern(identifier: str) -> str:
    if not identifier:
        raise ValueError("titled sections need an identifier")
    return rf"^\s*(?:{ENUMERATOR})?{re.escape(identifier)}"


def titled_sections(docs: DataFrame, identifier: str) -> DataFrame:
    """Sections under lines that begin with the identifier: doc_id, section_idx (from 0), title, content.

    What stands before the first title is dropped. A repeated title keeps its first place and its last content.
    """
    prepare(docs.sparkSession)  # of equal keys a map keeps the first place and the last value
    pattern = title_pattern(identifier)

    def parts(rows: Column) -> Column:
        at = F.filter(F.sequence(F.lit(0), F.size(rows) - 1), lambda i: F.get(rows, i).rlike(pattern))
        return T.bound(at, lambda at: contents(rows, at))

    def contents(rows: Column, at: Column) -> Column:
        titles = F.transform(at, lambda i: T.strip(F.get(rows, i)))
        upto = lambda k: F.coalesce(F.get(at, k + 1), F.size(rows))
        return F.map_entries(F.map_from_arrays(titles, F.transform(at, lambda i, k: T.strip(F.array_join(F.slice(rows, i + 2, upto(k) - i - 1), "\n")))))

    # All in the row of the document: nothing is shuffled. Without the outer form a filter on the size would repeat the work.
    found = docs.select("doc_id", F.posexplode_outer(T.bound(T.lines("text"), parts)).alias("section_idx", "s"))
    return found.filter("section_idx IS NOT NULL").select("doc_id", "section_idx", F.col("s.key").alias("title"), F.col("s.value").alias("content"))


def section_problems(sections: DataFrame, docs: DataFrame, number: int | None = None) -> DataFrame:
    """Documents without sections, with another number of them, or with a blank one: doc_id, problem."""
    n = sections.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum((T.strip("content") == "").cast("int")).alias("blank"))
    d = docs.select("doc_id").join(n, "doc_id", "left")
    found = F.array(
        F.when(F.col("n").isNull(), F.lit("no section")),
        F.when(F.col("n") != number, F.lit("number of sections")) if number is not None else F.lit(None),
        F.when(F.col("blank") > 0, F.lit("blank section")),
    )
    return d.select("doc_id", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("problem"))


def section_info(sections: DataFrame) -> DataFrame:
    return sections.select("doc_id", "section_idx", "title", F.size(T.words("content")).alias("n_words"), F.when(F.col("content") == "", 0).otherwise(F.size(F.split("content", "\n"))).alias("n_lines"))


def protocol_segments(docs: DataFrame, protocol: dict[str, Sequence[str]], cutoff: int = 1, default: str = "default", text: str = "text") -> DataFrame:
    """Lines of docs (doc_id, text) with the protocol section they belong to: doc_id, line_no, line, section.

    Sections in the order of their numbers each begin at their first line with one of their terms
    (whole words, any case) after the last section's begin, if at least `cutoff` lines have one; lines
    take the last section that began. The begins are found in the row of the document, so nothing is shuffled.
    """
    d = docs.select("doc_id", T.lines(text).alias("rows")).filter(F.size("rows") > 0)
    last: Column = F.lit(-1)
    order = sorted(protocol, key=int)
    for i, k in enumerate(order):
        pattern = r"(?:^|[^\pL\pN_])(?:" + "|".join(re.escape(t.lower()) for t in protocol[k]) + r")(?:$|[^\pL\pN_])"
        d = d.withColumn("at", F.filter(F.sequence(F.lit(0), F.size("rows") - 1), lambda j: F.lower(F.get(F.col("rows"), j)).rlike(pattern)))  # noqa: B023
        d = d.withColumn("last", last)
        begin = F.when(F.size("at") >= cutoff, F.array_min(F.filter("at", lambda x: x > F.col("last"))))
        d = d.withColumn(f"begin_{i}", begin)
        last = F.coalesce(F.col(f"begin_{i}"), F.col("last"))
    begins = [f"begin_{i}" for i in range(len(order))]
    lines = d.select("doc_id", *begins, F.posexplode("rows").alias("line_no", "line"))
    section: Column = F.lit(default)
    for b, k in zip(begins, order, strict=True):  # they ascend, so a later one wins
        section = F.when(F.col("line_no") >= F.col(b), F.lit(k)).otherwise(section)
    return lines.select("doc_id", "line_no", "line", section.alias("section"))


TAG = r"(?U)^\s*(\w+)\s*:\s*(.*)$"


def speaker_blocks(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Lines of texts from one `tag:` at a line's begin to the next: key, block (from 1), tag, content; found in the row of the text."""

    def blocks(rows: Column, at: Column) -> Column:
        def block(i: Column, k: Column) -> Column:
            upto = F.coalesce(F.get(at, k + 1), F.size(rows))
            own = F.concat(F.array(F.regexp_extract(F.get(rows, i), TAG, 2)), F.slice(rows, i + 2, upto - i - 1))
            return F.struct((k + 1).cast("long").alias("block"), F.regexp_extract(F.get(rows, i), TAG, 1).alias("tag"), T.strip(F.array_join(own, "\n")).alias("content"))

        return F.transform(at, block)

    def parts(rows: Column) -> Column:
        at = F.filter(F.sequence(F.lit(0), F.size(rows) - 1), lambda i: F.get(rows, i).rlike(TAG))
        return T.bound(at, lambda at: blocks(rows, at))

    return docs.select(key, F.inline_outer(T.bound(T.lines(text), parts))).filter("block IS NOT NULL")


def speaker_filter(docs: DataFrame, tags: Sequence[str] | None, keep_tags: bool = False, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Turns of the given speakers: key, utt_idx (from 0), content.

    Without tags to look for, and for texts without any, the whole text is one turn; tagged texts
    without a turn of these speakers, and empty texts, have none.
    """
    if not tags or not any(t.strip() for t in tags):
        return docs.select(key, F.lit(0).alias("utt_idx"), F.col(text).alias("content"))
    blocks = speaker_blocks(docs, key, text)
    wanted = blocks.filter(F.lower("tag").isin(*[t.lower() for t in tags]))
    content = F.concat(F.col("tag"), F.lit(": "), F.col("content")) if keep_tags else F.col("content")
    place = Window.partitionBy(key).orderBy("block")
    found = wanted.select(key, (F.row_number().over(place) - 1).alias("utt_idx"), content.alias("content"))
    plain = docs.filter(T.strip(text) != "").join(blocks.select(key).distinct(), key, "left_anti")
    return found.unionByName(plain.select(key, F.lit(0).alias("utt_idx"), F.col(text).alias("content")))


def top_tags(rows: DataFrame, number: int = 2, exclude: Sequence[str] = (), key: str = "doc_id") -> DataFrame:
    """The most frequent tags at line begins of each document: key, rank, tag, n; ties by the tag."""
    tagged = rows.select(key, F.regexp_extract("line", r"(?U)^(\w+):", 1).alias("tag")).filter("tag <> ''")
    if exclude:
        tagged = tagged.filter(~F.col("tag").isin(*exclude))
    n = tagged.groupBy(key, "tag").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), "tag"))
    return n.withColumn("rank", rank).filter(F.col("rank") <= number).select(key, "rank", "tag", "n")


def words_and_tags(rows: DataFrame, investigator: str = "investigator") -> DataFrame:
    """Words of speakers' lines (doc_id, line_no, speaker, text, segment) with the tag i or s."""
    tag = F.when(F.col("speaker") == investigator, "i").otherwise("s")
    return rows.select("doc_id", "line_no", tag.alias("tag"), "segment", F.posexplode(T.words("text")).alias("word_no", "word"))


def sentence_index(tokens: DataFrame, key: Sequence[str], pos: str = "pos", token: str = "token", end: str = "[.!?]$") -> DataFrame:
    """tokens with `sentence`, from 0; a sentence ends with a token that matches `end`, what trails is the last one."""
    return tokens.withColumn("sentence", starts_after(F.col(token).rlike(end), list(key), pos))


def sentence_tokens(docs: DataFrame, words: Column, key: str = "doc_id", end: str = "[.!?]$") -> DataFrame:
    """key, pos (from 0), token, sentence (from 0) of each text's words, as sentence_index() numbers them.

    The places after end marks cut the words into slices in the row of the text: nothing is shuffled.
    """

    def rows_of(words: Column) -> Column:
        n = F.size(words)
        starts = F.filter(F.sequence(F.lit(1), n - 1), lambda j: F.get(words, j - 1).rlike(end))
        return T.bound(F.concat(F.array(F.lit(0)), F.when(n > 1, starts).otherwise(F.array().cast("array<int>"))), lambda starts: sliced(words, starts))

    def sliced(words: Column, starts: Column) -> Column:
        def slice_of(begin: Column, s: Column) -> Column:
            stop = F.coalesce(F.get(starts, s + 1), F.size(words))
            return F.transform(F.slice(words, begin + 1, stop - begin), lambda w, i: F.struct((begin + i).alias("pos"), w.alias("token"), s.cast("long").alias("sentence")))

        return F.flatten(F.transform(starts, slice_of))

    return docs.select(key, F.inline_outer(T.bound(words, rows_of))).filter("token IS NOT NULL")


def sentence_blocks(tokens: DataFrame, sources: DataFrame, key: str = "doc_id") -> DataFrame:
    """tokens (key, pos from 0, token) with `sentence`: by end marks, or where no token has one, contiguous blocks.

    The number of blocks is that of the sentences of the source text (key, text), if 2 or more; the
    first blocks take one more if it doesn't divide.
    """
    marked = sentence_index(tokens, [key])
    whole = Window.partitionBy(key)
    marked = marked.withColumn("has_end", F.max(F.col("token").rlike("[.!?]$").cast("int")).over(whole)).withColumn("n", F.count(F.lit(1)).over(whole))
    # A sentence of the source ends with marks before white space that more text follows.
    k = F.size(F.split(T.strip("text"), r"(?<=[.!?])\s+"))
    joined = marked.join(sources.select(key, k.alias("k")), key, "left")
    size, more = F.floor(F.col("n") / F.col("k")), F.col("n") % F.col("k")
    block = F.when(F.col("pos") < more * (size + 1), F.floor(F.col("pos") / (size + 1))).otherwise(more + F.floor((F.col("pos") - more * (size + 1)) / F.greatest(size, F.lit(1))))
    sentence = F.when(F.col("has_end") == 1, F.col("sentence")).when(F.col("k") >= 2, block).otherwise(0).cast("long")
    return joined.select(*tokens.columns, sentence.alias("sentence"))


def topic_chunks_by_sentence(docs: DataFrame, n_tokens: Column) -> DataFrame:
    """Sentences, with their end marks, and the tokens they are allotted by their share of the text's characters, in order until none is left.

    Returns doc_id, chunk (from 0), text, first_token, n_tokens. White space at sentence borders is in no share, so the
    last tokens of a text can be left over. A text without sentences is one.
    """
    # Marks with the white space after them end a sentence; a character no text holds marks the places.
    cut = F.split(F.regexp_replace("text", r"([.!?]+(?:\s+|$))", "$1\u0001"), "\u0001")
    found = F.filter(F.transform(cut, lambda x: T.strip(x)), lambda x: x != "")
    parts = T.bound(found, lambda p: F.when(F.size(p) > 0, p).otherwise(F.array("text")))
    # Counted before the rows are exploded, not again for each of them.
    rows = docs.select("doc_id", n_tokens.cast("long").alias("total"), F.length("text").alias("chars"), parts.alias("parts")).select("doc_id", "total", "chars", F.posexplode_outer("parts").alias("chunk", "text")).filter("chars > 0")
    whole = Window.partitionBy("doc_id")
    rows = rows.withColumn("share", F.greatest(F.lit(1), F.floor(F.col("total") * (F.length("text") / F.col("chars")))))
    upto = F.sum("share").over(whole.orderBy("chunk").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("first_token", upto - F.col("share")).filter("first_token < total")
    return rows.select("doc_id", "chunk", "text", "first_token", F.least("share", F.col("total") - F.col("first_token")).alias("n_tokens"))


def topic_chunks_fixed(docs: DataFrame, n_tokens: Column, size: int) -> DataFrame:
    """Every `size` tokens with the matching share of the text's characters; empty pieces are dropped."""
    d = docs.select("doc_id", "text", n_tokens.cast("long").alias("total")).filter("total > 0")
    d = d.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("total") - 1) / size))))
    first, last = F.col("chunk") * size, F.least((F.col("chunk") + 1) * size, F.col("total"))
    at = lambda t: F.floor(t * F.length("text") / F.col("total")).cast("int")
    piece = T.strip(F.substring(F.col("text"), at(first) + 1, at(last) - at(first)))
    return d.select("doc_id", "chunk", piece.alias("text"), first.alias("first_token"), (last - first).alias("n_tokens")).filter("text <> ''")


def context_chunks(tokens: DataFrame, chunk_size: int, overlap: int, pos: str = "pos") -> DataFrame:
    """tokens with the chunk that scores them, the place in it and the number of tokens before them there.

    Chunks of chunk_size tokens begin every chunk_size - overlap; the first token of a text isn't scored.
    """
    if not 0 < overlap < chunk_size:
        raise ValueError("the overlap must be at least 1 and below the chunk size")
    stride = chunk_size - overlap
    chunk = F.greatest(F.lit(0), F.floor((F.col(pos) - overlap) / stride)).cast("long")
    scored = F.col(pos) >= 1
    return tokens.withColumn("chunk_idx", F.when(scored, chunk)).withColumn("local_pos", F.when(scored, F.col(pos) - chunk * stride))


# Time intervals of recordings.


def interval_points(silences: DataFrame, lengths: DataFrame) -> DataFrame:
    """Recordings cut in the middle of their silences: file_id, idx, start_ms, end_ms.

    silences: file_id, start_ms, end_ms; lengths: file_id, length_ms.
    """
    middle = silences.select("file_id", F.floor((F.col("start_ms") + F.col("end_ms")) / 2).alias("at"))
    ends = lengths.select("file_id", F.explode(F.array(F.lit(0).cast("long"), F.col("length_ms").cast("long"))).alias("at"))
    w = Window.partitionBy("file_id").orderBy("at")
    cut = middle.unionByName(ends).select("file_id", (F.row_number().over(w) - 1).alias("idx"), F.col("at").alias("start_ms"), F.lead("at").over(w).alias("end_ms"))
    return cut.filter("end_ms IS NOT NULL")


def merge_intervals(intervals: DataFrame, min_ms: int, max_ms: int) -> DataFrame:
    """Adjacent intervals joined until they reach min_ms; those above max_ms split evenly: file_id, idx, start_ms, end_ms.

    The first interval always takes the second in; what is left at the end is kept as it is. A recording
    is cut by jumps: from a cut to the first end of an interval that lies min_ms or more behind it.
    """

    def merged(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("start_ms", "ascending"), ("end_ms", "ascending")])
        ends = rows.column("end_ms").to_numpy()
        cuts, k = [int(rows.column("start_ms")[0].as_py())], 1
        while (k := max(k, int(np.searchsorted(ends, cuts[-1] + min_ms)))) < len(ends):
            cuts.append(int(ends[k]))
            k += 1
        pieces = [_evenly(a, b, max_ms) for a, b in zip(cuts, cuts[1:], strict=False)]
        if ends[-1] > cuts[-1]:
            pieces.append(np.array([[cuts[-1], ends[-1]]]))
        found = np.concatenate(pieces) if pieces else np.zeros((0, 2), np.int64)
        file_id = pa.array([key[0].as_py()] * len(found), rows.schema.field("file_id").type)
        return pa.table({"file_id": file_id, "idx": pa.array(range(len(found)), pa.int32()), "start_ms": found[:, 0].astype(np.int64), "end_ms": found[:, 1].astype(np.int64)})

    rows = intervals.select("file_id", F.col("start_ms").cast("long").alias("start_ms"), F.col("end_ms").cast("long").alias("end_ms"))
    return rows.groupBy("file_id").applyInArrow(merged, f"file_id {rows.schema['file_id'].dataType.simpleString()}, idx int, start_ms long, end_ms long")


def _evenly(start: int, end: int, most: int) -> np.ndarray:
    """Rows of start and end: the interval itself, or as few equal parts (the last may be shorter) as keep to `most`."""
    if end - start <= most:
        return np.array([[start, end]])
    parts = -(-(end - start) // most)
    edges = start + np.arange(parts + 1) * -(-(end - start) // parts)
    return np.column_stack((edges[:-1], np.minimum(edges[1:], end)))


def chunk_length_problems(chunks: DataFrame, lengths: DataFrame, tolerance_ms: int = 1) -> DataFrame:
    """Recordings whose chunks don't add up to their length."""
    total = chunks.groupBy("file_id").agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("chunks_ms"))
    return lengths.join(total, "file_id", "left").filter(F.abs(F.col("length_ms") - F.coalesce("chunks_ms", F.lit(0))) > tolerance_ms)

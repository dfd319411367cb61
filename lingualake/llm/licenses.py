"""License scans: an exact set-similarity join of text blocks with license templates.

A block is a line of a document, or a passage of consecutive words that goes on over line breaks,
as hard-wrapped notices do: at most as many words as the template has, divided by `threshold`, on
lines none of which meets the template by itself. It meets a template when it holds at least
`threshold` of the template's distinct words. The words are put in one global order: those of no
template, then rarest first by the number of documents that hold them (counted over all documents;
ties by the word). By the prefix principle a block that meets a template shares one of the first
|T| - need + 1 words of the template in that order, need being the least overlap; so an index over
those few rare words finds all candidates. The length filter drops blocks with fewer than `need`
words of any template; the positional filter drops a candidate when, after the first word that both
have, either the template or the block has too few words left to reach `need`; what is left is
counted in full. A text goes through these filters as a whole first, and passages are looked for
with the templates that it meets. Nothing is approximate.

The base places are where the words of a phrase stand consecutively. Templates and phrases are a
fixed, small list, so what is sent to the executors is bounded.

Edge cases: null and empty texts have no words, no places and no labels; repeated rows are scanned
each; extra columns are left out; a very long line is one block; lines without words (blank ones,
comment marks) don't end a passage.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter
from collections.abc import Iterator
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, text_of

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

# Phrases whose words standing together give a label.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Usual wordings of license notices.
TEMPLATES = {
    "This work is licensed under the GNU General Public License, version 3.": "gpl-3.0",
    "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License": "gpl",
    "Licensed under the Apache License, Version 2.0.": "apache-2.0",
    "you may not use this file except in compliance with the License": "apache-2.0",
    "Released under the MIT License.": "mit",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files": "mit",
    "Licensed under CC BY-NC 4.0.": "cc-by-nc-4.0",
    "This work is licensed under a Creative Commons Attribution 4.0 International License": "cc-by-4.0",
    "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License": "cc-by-sa-4.0",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met": "bsd",
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0": "mpl-2.0",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted": "isc",
    "This is free and unencumbered software released into the public domain": "unlicense",
    "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License": "lgpl",
    "You should have received a copy of the GNU General Public License along with this program. If not, see": "gpl",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License": "agpl",
    "distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied": "apache-2.0",
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software": "mit",
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-3-clause",
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer": "bsd",
    "This program and the accompanying materials are made available under the terms of the Eclipse Public License": "epl",
    "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license": "bsl-1.0",
    "The origin of this software must not be misrepresented; you must not claim that you wrote the original software": "zlib",
    "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License": "cc-by-nc-4.0",
    "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License": "cc-by-nd-4.0",
    "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work": "cc0-1.0",
    "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed": "gpl",
}

THRESHOLD = 0.8

_LOWER = {c: c + 32 for c in range(65, 91)}


def words_of(text: str) -> list[str]:
    return WORD.findall(text.translate(_LOWER))


class Scanner:
    """Templates under the global order, with the index over their prefixes."""

    def __init__(self, order: dict[str, int], threshold: float = THRESHOLD, templates: dict[str, str] = TEMPLATES):
        self.index: dict[str, list[tuple[int, int]]] = {}
        self.templates = []
        self.spans: list[int] = []
        self.counted = 0  # candidates that passed all filters
        share = Fraction(str(threshold))
        every = {w for text in templates for w in words_of(text)}
        self.rank = {w: k for k, w in enumerate(sorted(every, key=lambda w: (order.get(w, 0), w)))}
        for text, label in templates.items():
            own = sorted(set(words_of(text)), key=self.rank.__getitem__)
            need = math.ceil(len(own) * share)
            for at, w in enumerate(own[: len(own) - need + 1]):
                self.index.setdefault(w, []).append((len(self.templates), at))
            self.templates.append((own, need, label))
            self.spans.append(int(len(words_of(text)) / share))
        self.rare, self.vocabulary = frozenset(self.index), frozenset(every)
        self.base = [(phrase.split(), label) for phrase, label in BASE.items()]

    def block(self, words: set[str]) -> list[tuple[int, float]]:
        """Templates that a block with these distinct words meets, with the share of their words in it."""
        if words.isdisjoint(self.rare):
            return []
        mine = sorted(words & self.vocabulary, key=self.rank.__getitem__)
        seen: set[int] = set()
        out = []
        for place, w in enumerate(mine):
            for t, at in self.index.get(w, ()):
                if t in seen:
                    continue
                seen.add(t)  # the first word of the order that both have
                own, need, _ = self.templates[t]
                if len(mine) >= need and min(len(own) - at, len(mine) - place) >= need:
                    self.counted += 1
                    both = sum(x in words for x in own)
                    if both >= need:
                        out.append((t, both / len(own)))
        return out

    def passages(self, t: int, lines: list[list[str]], alone: set[int]) -> list[tuple[int, float]]:
        """Passages over line breaks that meet template t, with the line they begin on and their share; of those that overlap the best."""
        own, need, _ = self.templates[t]
        wanted, span, at = set(own), self.spans[t], 0
        hits: list[tuple[int, int, str]] = []  # (place, line, word); places jump where a line meets t by itself
        for k, words in enumerate(lines):
            if k in alone:
                at += span
                continue
            hits += [(at + i, k, w) for i, w in enumerate(words) if w in wanted]
            at += len(words)
        met, inside, left = [], Counter(), 0
        for right, (place, k, w) in enumerate(hits):
            inside[w] += 1
            while hits[left][0] <= place - span:
                gone = hits[left][2]
                inside[gone] -= 1
                if not inside[gone]:
                    del inside[gone]
                left += 1
            if len(inside) >= need and hits[left][1] != k:
                met.append((-len(inside), right - left, left, right))
        # Those chosen don't overlap, so a new one is held against the two beside its place only.
        starts: list[int] = []
        out: list[tuple[int, int]] = []  # (last hit, words) of those chosen, in the order of their starts
        for n, _, a, b in sorted(met):
            k = bisect.bisect_left(starts, a)
            if (k == len(starts) or b < starts[k]) and (not k or out[k - 1][0] < a):
                starts.insert(k, a)
                out.insert(k, (b, -n))
        return [(hits[a][1], n / len(own)) for a, (_, n) in zip(starts, out, strict=True)]

    def scan(self, text: str) -> tuple[int, list[tuple[int, str]], list[tuple[int, str, float]]]:
        """Number of words; base places (word, label); blocks that meet a template (line, label, share)."""
        words = words_of(text)
        have = set(words)
        places = []
        for phrase, label in self.base:
            if have.issuperset(phrase):
                at = -1
                while True:
                    try:
                        at = words.index(phrase[0], at + 1)
                    except ValueError:
                        break
                    if words[at : at + len(phrase)] == phrase:
                        places.append((at, label))
        found = []
        whole = self.block(have)  # neither a line nor a passage can meet a template that the whole text doesn't
        if whole:
            lines = [words_of(line) for line in text.split("\n")]
            alone: dict[int, set[int]] = {}
            for k, line in enumerate(lines):
                for t, x in self.block(set(line)):
                    found.append((k, self.templates[t][2], x))
                    alone.setdefault(t, set()).add(k)
            for t, _ in whole:
                found += [(k, self.templates[t][2], x) for k, x in self.passages(t, lines, alone.get(t, set()))]
            found.sort(key=lambda x: x[0])
        return len(words), places, found


def global_order(docs: DataFrame, templates: dict[str, str] = TEMPLATES) -> dict[str, int]:
    """Documents that hold each word of the templates: a count over all documents, a row for each word at most."""
    wanted = frozenset(w for t in templates for w in words_of(t))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter = Counter()
        for b in batches:
            for text in b.column("text").to_pylist():
                n.update(wanted.intersection(words_of(text)))
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], ["word", "n"])

    bounded_batches(docs.sparkSession)
    rows = text_of(docs).mapInArrow(counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {r["word"]: r["n"] for r in rows}


def scan(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs (doc_id, text) to doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, blocks."""
    order = global_order(docs)
    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, blocks array<struct<line: long, label: string, share: double>>"

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Scanner(order, threshold)
        kind = pa.list_(pa.struct([("line", pa.int64()), ("label", pa.string()), ("share", pa.float64())]))
        for b in batches:
            rows: list[list] = [[] for _ in range(8)]
            for text in b.column("text").to_pylist():
                n, places, found = s.scan(text)
                starts = [p for p, _ in places]
                base = {x for _, x in places}
                values = (n, len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | {x for _, x, _ in found})), max([1.0 if places else 0.0, *(x for _, _, x in found)]), [{"line": k, "label": x, "share": v} for k, x, v in found])
                for r, v in zip(rows, values, strict=True):
                    r.append(v)
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), kind]
            names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "blocks"]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(r, k) for r, k in zip(rows, kinds, strict=True))], names)

    return text_of(docs, F.col("doc_id").cast("long").alias("doc_id")).mapInArrow(scanned, schema)

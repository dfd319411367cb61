"""Token ids of whole texts by a tokenizer file, with a memory of the words already met.

A text is cut at single spaces and line breaks. Neither tokenizer kind joins anything across a space
that stands before a visible character, so the ids of a text are those of its pieces, each with the
space before it; a line break between visible characters stands by itself. For tokenizers that keep
white space, a text holding a piece that is empty or has other white space at an end is encoded
whole by the library instead.

Texts come in batches: the distinct pieces of a batch are numbered by Arrow, a mark after a word is
cut off, what is left is looked up among the words met in the last batches or else encoded once, and
the ids of all texts are gathered by array operations. A new word of Latin letters goes to the
library's model as it is, other Latin pieces are cut by the tokenizer file's own pattern first, and
the rest goes through the library from its start. The memory is bounded: words not met for longest
are forgotten.
"""

from __future__ import annotations

import json
import os
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

ID_BYTES = 4

#: Letters below U+0250 whose lower case doesn't depend on a neighbour and is one letter; no normal form joins them.
LETTER = r"[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{12F}\x{131}-\x{24F}]"

#: From this code point on letters go through the library.
LATIN = "\u0250"

#: A word, and a word with a mark that either pattern cuts off by itself.
WORD, MARKED = f"^ ?{LETTER}+$", f"^ ?{LETTER}+[.,;:!?]$"

#: Pieces whose ids are gathered at once.
STEP = 1 << 18


def _byte_letters() -> dict[int, str]:
    """The letters that byte-level models use for bytes: printable ones stand for themselves, the others follow from 256."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


def _flat(lists: list[list[int] | None]) -> tuple[np.ndarray, np.ndarray]:
    """Lists end to end, and their lengths, -1 for None."""
    size = np.fromiter((-1 if x is None else len(x) for x in lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(x for x in lists if x), "<u4", int(np.maximum(size, 0).sum())), size


def _gathered(ids: np.ndarray, size: np.ndarray, code: np.ndarray) -> np.ndarray:
    """The ids of each code, end to end; those of code k are `size[k]` ones after those of the codes before it."""
    start, parts = np.cumsum(size) - size, []
    for x in range(0, len(code), STEP):
        part = code[x : x + STEP]
        n = size[part]
        end = np.cumsum(n)
        parts.append(ids[np.repeat(start[part] - end + n, n) + np.arange(end[-1])])
    return np.concatenate(parts) if parts else ids[:0]


class Encoder:
    """encode(texts) gives the ids of all texts as little-endian unsigned 32-bit integers, and how many each has."""

    #: Words kept from batch to batch.
    LIMIT = 300_000

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        cut = config.get("pre_tokenizer") or {}
        parts = cut.get("pretokenizers", [cut])
        # A pre-tokenizer that removes what its pattern leaves out drops white space.
        self.drops_space = parts[0].get("type") == "Split" and parts[0].get("behavior") == "Removed" and bool(parts[0].get("invert"))
        self.special = [t["content"] for t in config.get("added_tokens", [])]
        self.pattern = self._pattern(config, parts)
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        # Words met, in the order of their last use, with the ids of each end to end and their numbers.
        self.known, self.ids, self.size = pa.array([], pa.large_string()), np.zeros(0, "<u4"), np.zeros(0, np.int64)

    def _pattern(self, config: dict, parts: list[dict]):
        """The pattern that cuts words, if the file is of one of the two kinds whose steps are known here."""
        import public_tokenizers
        import regex

        normal = config.get("normalizer") or {}
        kinds = [n.get("type") for n in normal.get("normalizers", [])]
        if config.get("model", {}).get("type") != "BPE" or parts[-1].get("type") != "ByteLevel" or parts[-1].get("add_prefix_space"):
            return None
        if not normal and len(parts) == 1 and parts[0].get("use_regex", True):
            return regex.compile(public_tokenizers.PATTERN)
        if kinds == ["NFC", "Replace", "Lowercase"] and len(parts) == 2 and self.drops_space and not parts[1].get("use_regex", True):
            return regex.compile(parts[0]["pattern"]["Regex"])
        return None

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _word(self, word: str) -> list[int]:
        """The ids of a word as the pattern cuts it."""
        if word.isascii() and word.isprintable():  # stands for itself, but for the space
            letters = word.replace(" ", self.letters[0x20])
        else:
            letters = word.encode().decode("latin-1").translate(self.letters)
        return [t.id for t in self.model.tokenize(letters)]

    def _learned(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of new words and pieces, which begin with the space before them if there is one; -1 where the text around matters."""
        out: list = [None] * len(words)
        plain = pc.match_substring_regex(words, WORD).to_numpy(zero_copy_only=False) if self.pattern else np.zeros(len(words), bool)
        easy = words.filter(pa.array(plain))
        for i, w in zip(np.flatnonzero(plain).tolist(), (pc.utf8_lower(easy) if self.drops_space else easy).to_pylist(), strict=True):
            out[i] = self._word(w)
        other = []
        for i, w in zip(np.flatnonzero(~plain).tolist(), words.filter(pa.array(~plain)).to_pylist(), strict=True):
            if not self.drops_space:
                p = w[1:] if w[:1] in (" ", "\n") else w
                if not p or p[0].isspace() or p[-1].isspace():
                    continue
            if self.pattern is None or not (w.isascii() or max(w) < LATIN and "\u0130" not in w) or any(s in w for s in self.special):
                other.append(i)
            else:
                out[i] = [x for part in self.pattern.findall(w.lower() if self.drops_space else w) for x in self._word(part)]
        for i, ids in zip(other, self._whole([words[i].as_py() for i in other]), strict=True):
            out[i] = ids
        return _flat(out)

    def _found(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct words, end to end, and their numbers."""
        at = pc.index_in(words, value_set=self.known).fill_null(-1).to_numpy().astype(np.int64)
        new = at < 0
        ids, size = self._learned(words.filter(pa.array(new)))
        ids, size = np.concatenate((self.ids, ids)), np.concatenate((self.size, size))
        at[new] = len(self.known) + np.arange(new.sum())
        known = pa.concat_arrays([self.known, words.filter(pa.array(new))])
        # What is kept: the words of this batch, and of the others those used last.
        idle = np.ones(len(known), bool)
        idle[at] = False
        keep = np.concatenate((np.flatnonzero(idle), np.sort(at)))[-self.LIMIT :]
        own = np.maximum(size, 0)
        got = _gathered(ids, own, at), size[at]
        self.known, self.ids, self.size = known.take(pa.array(keep)), _gathered(ids, own, keep), size[keep]
        return got

    def _pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct pieces: a mark at the end of a word is a word of its own."""
        marked = pc.match_substring_regex(pieces, MARKED).to_numpy(zero_copy_only=False) if self.pattern else np.zeros(len(pieces), bool)
        main = pc.if_else(pa.array(marked), pc.utf8_slice_codeunits(pieces, 0, -1), pieces)
        marks = pc.utf8_slice_codeunits(pieces.filter(pa.array(marked)), -1)
        words = pa.concat_arrays([main.cast(pa.large_string()), marks.cast(pa.large_string())]).dictionary_encode()
        ids, size = self._found(words.dictionary)
        code = words.indices.to_numpy().astype(np.int64)
        first, mark = code[: len(pieces)], np.full(len(pieces), -1)
        mark[marked] = code[len(pieces) :]
        both = np.column_stack((first, mark)).ravel()
        total = size[first]
        total[marked] += size[mark[marked]]
        return _gathered(ids, np.maximum(size, 0), both[both >= 0]), total

    def encode(self, texts: pa.Array | list[str], end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """texts, without nulls, to the ids of all one after the other and the number of each; `end` follows each text's ids."""
        texts = pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string())
        tail = np.array([] if end is None else [end], "<u4")
        if not len(texts):
            return tail[:0], np.zeros(0, np.int64)
        # A text is one piece at least; a piece after a line break begins with it.
        cut = pc.split_pattern(pc.replace_substring(texts, "\n", " " if self.drops_space else " \n"), " ")
        bounds = cut.offsets.to_numpy().astype(np.int64) - cut.offsets[0].as_py()
        pieces = cut.flatten().dictionary_encode()
        code, own = pieces.indices.to_numpy().astype(np.int64), pieces.dictionary
        if not self.drops_space:
            heads = own.take(pa.array(code[bounds[:-1]])).dictionary_encode()
            code[bounds[:-1]] = heads.indices.to_numpy() + len(own)
            spaced = pc.if_else(pc.starts_with(own, "\n"), own, pc.binary_join_element_wise(pa.scalar("", pa.large_string()), own, pa.scalar(" ", pa.large_string())))
            own = pa.concat_arrays([spaced, heads.dictionary])
        ids, size = self._pieces(own)
        if end is not None:
            code = np.insert(code, bounds[1:], len(own))
            bounds = bounds + np.arange(len(bounds))
            ids, size = np.concatenate((ids, tail)), np.append(size, 1)
        whole = np.flatnonzero(np.add.reduceat(size[code] < 0, bounds[:-1], dtype=np.int64))
        size = np.maximum(size, 0)
        out = _gathered(ids, size, code)
        at = np.concatenate(([0], np.cumsum(size[code])))[bounds]
        length = np.diff(at)
        if not len(whole):
            return out, length
        parts, done = [], 0
        for i in whole.tolist():
            fresh = np.concatenate((np.array(self._whole([texts[i].as_py()])[0], "<u4"), tail))
            parts += [out[done : at[i]], fresh]
            done, length[i] = at[i + 1], len(fresh)
        return np.concatenate([*parts, out[done:]]), length


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each Python worker and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]

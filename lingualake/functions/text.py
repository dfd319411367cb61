"""Cleaning of texts and tokens as column expressions; everything stays in the JVM.

Regular expressions avoid what only one engine knows: no look-around, explicit character classes.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The 32 punctuation characters of ASCII.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

# Tokens that tokenizers add around texts.
SPECIAL_TOKENS = ("<s>", "</s>", "<pad>", "<unk>")

WORD_START = "▁"

# Wrongly decoded letters in model tokens and what they stand for.
MOJIBAKE = {"√§": "ä", "√º": "ü", "√∂": "ö", "√í": "í"}


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bound(value: Column, use) -> Column:
    """use(value), with the value worked out once: a name in a lambda isn't put in place of by what it stands for."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(c: Column | str) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(col(c), r"(?U)^\s+|\s+$", "")


def timestamp_pattern(example: str) -> str:
    """The pattern of a time stamp from an example: its digits stand for any digit."""
    if example is None:
        raise ValueError("removing time stamps needs an example of one")
    return "".join("[0-9]" if x.isdigit() else re.escape(x) for x in example)


def remove_timestamps(c: Column | str, example: str) -> Column:
    return F.regexp_replace(col(c), timestamp_pattern(example), "")


def remove_characters(c: Column | str, characters: str) -> Column:
    return F.translate(col(c), characters, "")


def remove_brackets(c: Column | str) -> Column:
    """Without (...), <...>, [...] and {...} inside a line, one kind after the other."""
    out = col(c)
    for left, right in (r"\(", r"\)"), ("<", ">"), (r"\[", r"\]"), (r"\{", r"\}"):
        out = F.regexp_replace(out, f"{left}[^\\n]*?{right}", "")
    return out


def remove_punctuation(c: Column | str) -> Column:
    return F.translate(col(c), PUNCTUATION, "")


def lowercase(c: Column | str) -> Column:
    return F.lower(col(c))


def each(f):
    """A text function on every element of an array."""
    return lambda c: F.transform(col(c), f)


def general(c: Column | str) -> Column:
    """Slashes out, white space before marks out, blank lines and runs of spaces made single."""
    out = F.replace(col(c), F.lit("/"), F.lit(""))
    out = F.regexp_replace(out, r"\s+([?.!,\"])", "$1")
    out = F.regexp_replace(out, r"\n\s*\n", "\n")
    out = F.replace(out, F.lit("\\"), F.lit(""))
    return F.regexp_replace(out, " +", " ")


def clean(c: Column | str, timestamp: str | None = None, characters: str = "", brackets: bool = False, punctuation: bool = False, lower: bool = False, tidy: bool = True) -> Column:
    """All cleaning steps that are asked for, in their fixed order."""
    out = col(c)
    if timestamp:
        out = remove_timestamps(out, timestamp)
    if characters:
        out = remove_characters(out, characters)
    if brackets:
        out = remove_brackets(out)
    if punctuation:
        out = remove_punctuation(out)
    if lower:
        out = lowercase(out)
    return strip(general(out) if tidy else out)


def remove_speaker_tags(c: Column | str, tags: Sequence[str]) -> Column:
    return F.regexp_replace(col(c), f"(?m)^(?:{'|'.join(map(re.escape, tags))}):\\s*", "")


# Word lists of fluency tasks.


def fluency_split(c: Column | str, splitter: str | None = None) -> Column:
    """Pieces between the splitter and commas, as they stand."""
    parts = F.split(col(c), re.escape(splitter)) if splitter else F.array(col(c))
    return F.flatten(F.transform(parts, lambda x: F.split(x, ",")))


def repeats(a: Column) -> Column:
    """How many elements repeat an earlier one."""
    return F.size(a) - F.size(F.array_distinct(a))


def hyphenated(a: Column) -> Column:
    return F.size(F.filter(a, lambda x: F.contains(x, F.lit("-"))))


def fluency_words(c: Column | str, splitter: str | None = None) -> Column:
    """Pieces without any white space, the empty ones dropped."""
    return F.filter(fluency_split(F.regexp_replace(col(c), r"\s+", ""), splitter), lambda x: x != "")


def fluency_clean(words: Column, hyphens: bool = True, duplicates: bool = True, lower: bool = False) -> Column:
    """The word list as a text: hyphens out, each word once in the order of first use."""
    out = words
    if hyphens:
        out = F.transform(out, lambda x: F.replace(x, F.lit("-"), F.lit("")))
    if duplicates:
        out = F.array_distinct(out)
    out = F.array_join(out, " ")
    return F.lower(out) if lower else out


# Tokens.


def words(c: Column | str) -> Column:
    """Runs without white space."""
    return F.filter(F.split(strip(c), r"\s+"), lambda x: x != "")


def clean_model_token(c: Column | str) -> Column:
    """A subword token as plain letters, digits and hyphens; null if only digits are left."""
    out = F.replace(col(c), F.lit(WORD_START), F.lit(""))
    for wrong, right in MOJIBAKE.items():
        out = F.replace(out, F.lit(wrong), F.lit(right))
    out = F.regexp_replace(F.regexp_replace(out, r"\[[^\n]*?\]", ""), r"\([^\n]*?\)", "")
    out = F.regexp_replace(out, "[^A-Za-z0-9À-ſ-]", "")
    return F.when(out.rlike("^[0-9]+$"), F.lit(None)).otherwise(out)


def clean_token(c: Column | str) -> Column:
    out = strip(c)
    return F.when(out == "", F.lit(None)).otherwise(out)


def clean_tokens(rows: DataFrame, token: str = "token", model: bool = False) -> DataFrame:
    """Rows with cleaned tokens, by the subword cleaner or the plain one; rows whose token is nothing are dropped."""
    cleaned = clean_model_token(token) if model else clean_token(token)
    return rows.withColumn(token, cleaned).filter(F.col(token).isNotNull())


def processed_text(tokens: Column, normalized: Column | None = None) -> Column:
    """Normal forms as a text where there are any, else the tokens."""
    own = tokens if normalized is None else F.when(F.size(normalized) > 0, normalized).otherwise(tokens)
    return F.array_join(own, " ")


def is_punctuation_token(c: Column | str) -> Column:
    core = strip(F.replace(col(c), F.lit(WORD_START), F.lit("")))
    return col(c).isin(*SPECIAL_TOKENS) | (F.translate(core, PUNCTUATION, "") == "")


def detokenize(tokens: Column) -> Column:
    """Text of subword tokens: a word start begins a new word unless only punctuation follows; starts inside a token stay."""

    def piece(t: Column) -> Column:
        core = F.regexp_replace(t, f"^{WORD_START}+", "")
        opens = F.startswith(t, F.lit(WORD_START)) & ~F.contains(F.lit(PUNCTUATION), core)
        return F.when(opens, F.concat(F.lit(" "), core)).otherwise(core)

    return strip(F.regexp_replace(F.array_join(F.transform(tokens, piece), ""), r"(?U)\s+", " "))


def _plain_latin() -> tuple[str, str]:
    """Letters with marks, and the bare letters they are made of."""
    found = {}
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        bare = unicodedata.normalize("NFKD", chr(code))
        if bare[0].isascii() and bare[0].isalpha() and all(unicodedata.combining(x) for x in bare[1:]):
            found[chr(code)] = bare[0]
    return "".join(found), "".join(found.values())


# Letters that are written with others.
SPELLED = {"ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "đ": "d", "ð": "d", "þ": "th", "ł": "l", "ı": "i", "’": "'"}


def romanized(c: Column | str) -> Column:
    """Latin letters without their marks, whether written as one character or with marks behind them."""
    marked, bare = _plain_latin()
    out = F.regexp_replace(F.translate(col(c), marked, bare), "[\u0300-\u036f]", "")
    for letter, others in SPELLED.items():
        out = F.replace(out, F.lit(letter), F.lit(others))
    return out


def alignment_text(c: Column | str) -> Column:
    """Lower-case plain Latin letters, apostrophes and single spaces, as aligners take them."""
    return strip(F.regexp_replace(F.regexp_replace(romanized(F.lower(col(c))), "[^a-z' ]", " "), " +", " "))


def lines(c: Column | str) -> Column:
    """Lines of a text by any line break; a break at the end opens no line."""
    out = F.regexp_replace(col(c), "\r\n|[\r\u000b\u000c\u001c-\u001e\u0085\u2028\u2029]", "\n")
    return F.split(F.regexp_replace(out, "\n$", ""), "\n")

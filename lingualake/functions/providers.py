"""Model providers: what turns tokens into vectors and lemmas, and recordings into words.

The built-in ones are deterministic stand-ins that need no model: they reproduce interfaces and
formulas, not model outputs. Others are registered by name with the same columns in and out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: name -> function of a token column and the number of dimensions, to an array of doubles.
EMBEDDERS: dict[str, Callable[[Column, int], Column]] = {}
#: name -> function of a token column to its normal form.
NORMALIZERS: dict[str, Callable[[Column], Column]] = {}
#: kind (asr, alignment, diarization, acoustic) -> name -> function of a files table to a table of results.
RECORDING: dict[str, dict[str, Callable[[DataFrame], DataFrame]]] = {k: {} for k in ("asr", "alignment", "diarization", "acoustic")}


def register(kind: str, name: str):
    def put(f):
        table = {"embedder": EMBEDDERS, "normalizer": NORMALIZERS}.get(kind)
        (table if table is not None else RECORDING[kind])[name] = f
        return f

    return put


def get(kind: str, name: str):
    table = {"embedder": EMBEDDERS, "normalizer": NORMALIZERS}.get(kind, RECORDING.get(kind))
    if table is None or name not in table:
        raise ValueError(f"no {kind} named {name!r}; known: {', '.join(sorted(table or ()))}")
    return table[name]


@register("embedder", "hash")
def hashed(token: Column, dimensions: int) -> Column:
    """Each dimension from -1 to 1 by the digest of the token and the dimension's number."""
    part = lambda k: F.conv(F.substring(F.md5(F.concat(token, F.lit("|"), k.cast("string")).cast("binary")), 1, 8), 16, 10).cast("double")
    return F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda k: part(k) / F.lit(2.0**31) - 1)


@register("embedder", "subword")
def subword(token: Column, dimensions: int) -> Column:
    """Mean of the hashed vectors of a token's character trigrams, its ends marked; unknown words get likely neighbours."""
    marked = F.concat(F.lit("<"), token, F.lit(">"))
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(marked) - 2, F.lit(1))), lambda i: F.substring(marked, i, F.lit(3)))
    vectors = F.transform(grams, lambda g: hashed(g, dimensions))
    zero = F.array_repeat(F.lit(0.0), dimensions)
    total = F.aggregate(vectors, zero, lambda a, v: F.zip_with(a, v, lambda x, y: x + y))
    return F.transform(total, lambda x: x / F.size(grams))


def lookup(tokens: DataFrame, vectors: DataFrame, token: str = "token") -> DataFrame:
    """tokens with `vec` from a vocabulary table (token, vec); tokens that aren't there are dropped."""
    return tokens.join(vectors.select(token, "vec"), token)


# Endings that the simple stemmer takes off, longest first.
ENDINGS = ("ungen", "heiten", "keiten", "ation", "ment", "ung", "heit", "keit", "ing", "ed", "en", "er", "es", "e", "n", "s")


@register("normalizer", "stem")
def stem(token: Column) -> Column:
    """Lower case without one usual ending, three letters left at least."""
    return F.regexp_replace(F.lower(token), f"(?<=.{{3}})(?:{'|'.join(ENDINGS)})$", "")


@register("normalizer", "identity")
def identity(token: Column) -> Column:
    return token


def precomputed(kind: str, name: str, path: str) -> None:
    """Register results that lie in a table as a provider: joined to the files by path."""

    def read(files: DataFrame) -> DataFrame:
        return files.sparkSession.read.parquet(path).join(files.select("path"), "path", "left_semi")

    RECORDING[kind][name] = read

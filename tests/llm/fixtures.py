"""Small tables with the edge cases: nulls, empty and long texts, ties, repeated rows, clashing extra columns."""

import random

from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])

#: Names that operators use inside.
CLASHES = ("key", "block", "tid", "size", "taken", "target", "head", "kind", "body", "carried_row", "bands", "copies", "at", "word", "_row", "_mix", "h")


def texts(seed: int = 0, n: int = 60) -> list[str]:
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(400)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(70))
    out = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 220))) for _ in range(n)]
    out += [out[0], out[0], out[1] + " tail", passage + "\n" + out[2], out[3] + "  " + passage, "spin " * 90]
    long = " ".join(rng.choice(vocabulary) for _ in range(3000))
    return [*out, long, long.replace(vocabulary[0], vocabulary[1]), "", " \n\t", "a", "Ünï çødé ñ", out[0].upper()]


def rows(seed: int = 0, n: int = 60) -> list[tuple]:
    t = texts(seed, n)
    out = [(i * 3, x, "en" if i % 3 else "de", None if i % 11 == 0 else f"src{i % 4}", len(x)) for i, x in enumerate(t)]
    out += [(6, None, None, None, None), out[5], out[5], (out[7][0], "another text with one id", "en", "src1", None), (None, "no id here", "en", "src2", 10)]
    random.Random(seed).shuffle(out)
    return out


def documents(spark, data=None, clash: bool = False):
    df = spark.createDataFrame(rows() if data is None else data, SCHEMA).repartition(3)
    if clash:
        from pyspark.sql import functions as F

        df = df.select("*", *[F.lit("x").alias(c) for c in CLASHES])
    return df

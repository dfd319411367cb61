"""Mixing sources to target weights by capped water-filling.

Sources share a budget by weight; a source stops at `epochs` times its own size and what it leaves
is shared out again by weight until no source is above. The final level has a closed form: with the
sources in ascending order of size by weight, the capped ones come first, so running sums over the
table of sources (one row each) give it without a loop. Whole repetitions of a source are taken of
every document; the fractional one takes documents in the order of a seeded hash of id and text
until the target is met, the last of them only in part. Sums over slices of the hash find the slice
that holds the cut; only its rows are sorted, the others are decided where they are read, by a join
with one row for each source, sent to all executors where these rows are small. So a hot source is
never in one task, and no text is shuffled but those of the cut slices in mixed_documents().

The sources themselves, a row of numbers for each, are sorted in one task.

Edge cases: null texts have size 0; null is a source of its own, the last; sources without words
get the target 0; rows equal in id and text stand in one place, and it doesn't matter which of them
the cut falls on. An empty table gives an empty result. Extra columns stay out of the decisions;
mixed_documents() carries them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import written

WORD = r"[^\x20\x09-\x0D]+"

#: Hex digits of the hash that name a slice of a source: 65536 slices.
SLICE = 4

#: Bytes of the rows of sources up to which they are sent to all executors.
BROADCAST_BYTES = 32 << 20


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_fill(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), epochs: int = 3, share: int = 1) -> DataFrame:
    """sizes (source, source_size) to source, source_size, target.

    Weights go to the sources in code point order, null last, repeating. share: times the sum of all
    sizes that the targets share. Whole numbers are kept up to the one division.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("k", F.row_number().over(order) - 1)
    ranked = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("k") % len(weights) + 1).cast("int")).cast("long"))
    fill = Window.orderBy((F.col("source_size") * 1.0 / F.col("weight")).asc(), F.col("k"))
    every = Window.partitionBy(F.lit(0))
    ranked = (
        ranked.withColumn("budget", share * F.sum("source_size").over(every))
        .withColumn("before", F.coalesce(F.sum(epochs * F.col("source_size")).over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("open", F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("capped", epochs * F.col("source_size") * F.col("open") <= (F.col("budget") - F.col("before")) * F.col("weight"))
        # Once a source isn't capped, none of the later ones is.
        .withColumn("capped", F.min("capped").over(fill.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("left", F.col("budget") - epochs * F.coalesce(F.sum(F.when(F.col("capped"), F.col("source_size"))).over(every), F.lit(0)))
        .withColumn("open", F.coalesce(F.sum(F.when(~F.col("capped"), F.col("weight"))).over(every), F.lit(0)))
    )
    target = F.when(F.col("capped"), (epochs * F.col("source_size")).cast("double")).otherwise((F.col("weight") * F.col("left")).cast("double") / F.col("open").cast("double"))
    return ranked.select("source", "source_size", target.alias("target"))


def placed(seed: int) -> Column:
    """Where a row of doc_id and text stands in the seeded order: hex digits of a hash of both."""
    key = F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    return F.md5(key.cast("binary"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), epochs: int = 3) -> DataFrame:
    """docs (source, size, place and whatever else) with source_size, target and taken: words to take of each row."""
    piece = F.substring("place", 1, SLICE)
    slices = docs.select("source", piece.alias("slice"), "size").groupBy("source", "slice").agg(F.sum("size").alias("size"))
    targets = water_fill(slices.groupBy("source").agg(F.sum("size").alias("source_size")), weights, epochs)
    targets = targets.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    targets = targets.withColumn("part", F.floor(F.col("target") + 0.5).cast("long") - F.col("whole") * F.col("source_size"))
    run = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, 0)
    after = slices.withColumn("upto", F.sum("size").over(run)).withColumnRenamed("source", "s")
    # One row for each source: the first slice whose end is above the fractional part holds the cut.
    above = F.col("upto") > F.col("part")
    cuts = written(
        after.join(targets, F.col("s").eqNullSafe(F.col("source")))
        .groupBy("source", "source_size", "target", "whole", "part")
        .agg(F.min(F.when(above, F.col("slice"))).alias("cut"), F.min(F.when(above, F.col("upto") - F.col("size"))).alias("before"))
        .select("source", F.struct("source_size", "target", "whole", "part", "cut", "before").alias("_mix"))
        .withColumnRenamed("source", "_of"),
        "mix",
    )
    # Usually there are few sources; a row for each goes to all executors where that is little, else the rows are dealt by source.
    size = cuts.agg(F.sum(F.coalesce(F.octet_length("_of"), F.lit(0)) + 100)).first()[0] or 0
    d = docs.join(F.broadcast(cuts) if size <= BROADCAST_BYTES else cuts, F.col("source").eqNullSafe(F.col("_of")))
    whole, cut_at = F.col("_mix.whole"), F.col("_mix.cut")
    at_cut = F.coalesce((piece == cut_at) & (F.col("size") > 0), F.lit(False))
    full = cut_at.isNull() | (piece < cut_at)
    even = d.filter(~at_cut).withColumn("taken", F.col("size") * (whole + full.cast("long")))
    order = Window.partitionBy("source").orderBy("place", "size").rowsBetween(Window.unboundedPreceding, -1)
    cut = d.filter(at_cut).withColumn("_at", F.col("_mix.before") + F.coalesce(F.sum("size").over(order), F.lit(0)))
    cut = cut.withColumn("taken", F.col("size") * whole + F.greatest(F.lit(0), F.least(F.col("size"), F.col("_mix.part") - F.col("_at")))).drop("_at")
    out = even.unionByName(cut)
    return out.withColumn("source_size", F.col("_mix.source_size")).withColumn("target", F.col("_mix.target")).drop("_mix", "_of")


def mixed(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), epochs: int = 3, seed: int = 0) -> DataFrame:
    """The decisions alone, a row for each document: doc_id, source, size, source_size, target, taken."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "text")
    d = d.select("doc_id", "source", n_words(F.col("text")).alias("size"), placed(seed).alias("place"))
    return mix(d, weights, epochs).select("doc_id", "source", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), epochs: int = 3, seed: int = 0) -> DataFrame:
    """The mix itself: every document as often as it is taken, a part of one as its first words; the columns of docs.

    A text without words counts nothing and is kept once. n_chars, where there is one, follows a cut text.
    """
    names = docs.columns
    d = docs.select("doc_id", "source", "text", F.struct(*names).alias("_row"))
    d = d.select("source", "_row", n_words(F.col("text")).alias("size"), placed(seed).alias("place"))
    d = mix(d, weights, epochs)
    copies = F.when(F.col("size") == 0, 1).otherwise(F.ceil(F.col("taken") / F.greatest(F.col("size"), F.lit(1)))).cast("int")
    d = d.withColumn("_copies", copies).filter("_copies > 0").withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    words = F.least(F.col("size"), F.col("taken") - (F.col("_i") - 1) * F.col("size")).cast("int")
    part = F.array_join(F.slice(F.regexp_extract_all(F.col("_row.text"), F.lit(f"({WORD})")), F.lit(1), F.greatest(words, F.lit(0))), " ")
    short = words < F.col("size")
    d = d.withColumn("_cut", F.when(short, part))
    fresh = {"text": F.coalesce(F.col("_cut"), F.col("_row.text"))}
    if "n_chars" in names:
        fresh["n_chars"] = F.coalesce(F.length("_cut").cast(docs.schema["n_chars"].dataType), F.col("_row.n_chars"))
    return d.select(*[fresh.get(n, F.col(f"_row.`{n}`")).alias(n) for n in names])

"""Similarity of token vectors: pairs, windows, sentences and their summaries.

Input: (key, pos, token, vec) with pos counting from 0 without gaps inside a key. Every pair inside a
window is computed once, by its lag, and then counted in all windows that hold it; only numbers
travel, vectors are joined on (key, position).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import vectors as V

#: Positions of a block where all pairs of a key are asked for.
BLOCK = 1024

#: Rows of a batch of pairs, and bytes of one that goes to a Python worker: a block or two.
ROWS, BYTES = 1 << 18, 4 << 20

#: Bins of similarities from -1 to 1 in which a median is looked for.
BINS = 1 << 14

METRICS = ("mean_of_window_means", "std_of_window_means", "mean_of_window_stds", "std_of_window_stds", "mean_of_window_medians")


def token_vectors(df: DataFrame, key: str, order: str, vector: str, token: Column | None = None) -> DataFrame:
    """key, pos, token, vec (doubles) and norm from rows with a vector."""
    w = Window.partitionBy(key).orderBy(order)
    vec = V.doubles(F.col(vector))
    out = df.select(F.col(key), (F.row_number().over(w) - 1).alias("pos"), (token if token is not None else F.col(order).cast("string")).alias("token"), vec.alias("vec"))
    return out.withColumn("norm", V.norm(F.col("vec")))


def drop_zero_vectors(vectors: DataFrame, least: float = 1e-10) -> DataFrame:
    return vectors.filter(F.col("norm") >= least)


def consecutive(vectors: DataFrame, key: str) -> DataFrame:
    """key, pos, similarity of each token to the one before."""
    w = Window.partitionBy(key).orderBy("pos")
    sim = V.cosine(F.lag("vec").over(w), F.col("vec"), F.lag("norm").over(w), F.col("norm"))
    return vectors.select(key, "pos", sim.alias("similarity")).filter("pos > 0")


def consecutive_mean(vectors: DataFrame, key: str) -> DataFrame:
    return consecutive(vectors, key).groupBy(key).agg(F.avg("similarity").alias("mean_similarity"), F.count("similarity").alias("n"))


def pairs(vectors: DataFrame, key: str, within: int | None = None) -> DataFrame:
    """key, i, j, sim of all pairs i < j, or of those less than `within` apart.

    With a bound, the left side is repeated once for each lag and joined by position; without one,
    blocks of BLOCK positions of a key meet, so a long text is many tasks and sends each row once for each block.
    """
    if within is None:
        return _block_rows(vectors, key, both=False)
    a = vectors.select(key, F.col("pos").alias("i"), F.col("vec").alias("va"), F.col("norm").alias("na"))
    b = vectors.select(key, F.col("pos").alias("j"), F.col("vec").alias("vb"), F.col("norm").alias("nb"))
    a = a.withColumn("lag", F.explode(F.sequence(F.lit(1), F.lit(max(1, within - 1))))).withColumn("j", F.col("i") + F.col("lag"))
    return a.join(b, [key, "j"]).select(key, "i", "j", V.cosine(F.col("va"), F.col("vb"), F.col("na"), F.col("nb")).alias("sim"))


def block_pairs(vectors: DataFrame, key: str, of_key: DataFrame | None = None) -> DataFrame:
    """Each two blocks of BLOCK positions of a key that meet, in one row: key, at_i, at_j (first positions), the vectors end to
    end (flat_i, flat_j) and their lengths (size_i, size_j). `of_key` adds columns by key; keys that it lacks are left out.

    The partitions are as many as for any shuffle: few bytes make much work here, so they aren't put together.
    """
    spark = vectors.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BYTES))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = vectors.groupBy(key, F.floor(F.col("pos") / BLOCK).alias("block")).agg(F.sort_array(F.collect_list(F.struct("pos", F.coalesce("vec", F.array().cast("array<double>")).alias("vec")))).alias("rows"))
    rows = rows.select(key, "block", F.get("rows", F.lit(0))["pos"].alias("at"), F.flatten(F.transform("rows", lambda r: r["vec"])).alias("flat"), F.transform("rows", lambda r: F.size(r["vec"])).alias("size"))
    of = vectors.groupBy(key).agg(F.max(F.floor(F.col("pos") / BLOCK)).alias("last_block"))
    of = of if of_key is None else of.join(of_key, key)
    a = rows.join(of, key).withColumn("block_j", F.explode(F.sequence("block", "last_block"))).drop("last_block", "block")
    a = a.withColumnsRenamed({c: f"{c}_i" for c in ("at", "flat", "size")}).repartition(n, key, "block_j")
    b = rows.select(key, F.col("block").alias("block_j"), *[F.col(c).alias(f"{c}_j") for c in ("at", "flat", "size")]).repartition(n, key, "block_j")
    return a.join(b, [key, "block_j"]).drop("block_j")


def _matrix_of(batch: pa.RecordBatch, k: int, side: str) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of one side as rows, filled up with zeros, and their lengths."""
    size = batch.column(f"size_{side}")[k].values.to_numpy()
    out = np.zeros((len(size), size.max(initial=0)))
    out[np.arange(out.shape[1]) < size[:, None]] = batch.column(f"flat_{side}")[k].values.to_numpy(zero_copy_only=False)
    return out, size


def _cosines(batch: pa.RecordBatch, k: int) -> tuple[int, int, np.ndarray, np.ndarray]:
    """First positions, cosines and which of them count: no zero vector, equal lengths."""
    (a, m), (b, n) = _matrix_of(batch, k, "i"), _matrix_of(batch, k, "j")
    wide = max(a.shape[1], b.shape[1])
    a, b = (np.pad(x, ((0, 0), (0, wide - x.shape[1]))) for x in (a, b))
    length = np.sqrt((a * a).sum(axis=1))[:, None] * np.sqrt((b * b).sum(axis=1))[None, :]
    there = ~(length <= 0) & (m[:, None] == n[None, :])
    with np.errstate(invalid="ignore", over="ignore"):
        sim = (a @ b.T) / np.where(there, length, 1.0)
    return batch.column("at_i")[k].as_py(), batch.column("at_j")[k].as_py(), sim, there


def _block_rows(vectors: DataFrame, key: str, both: bool) -> DataFrame:
    """key, i, j, sim of all pairs i < j; with `both` also those with i >= j, null where i = j."""
    kind, place = vectors.schema[key].dataType.simpleString(), vectors.schema["pos"].dataType.simpleString()

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = batch.schema.field("at_i").type
            for k in range(batch.num_rows):
                at_i, at_j, sim, there = _cosines(batch, k)
                same = at_i == at_j
                if same:
                    np.fill_diagonal(there, False)
                step = max(1, ROWS // sim.shape[1])
                for lo in range(0, len(sim), step):
                    x, ok = sim[lo : lo + step], there[lo : lo + step]
                    i, j = (y.ravel() for y in np.broadcast_arrays(np.arange(at_i + lo, at_i + lo + len(x))[:, None], np.arange(at_j, at_j + x.shape[1])[None, :]))
                    x, ok = x.ravel(), ok.ravel()
                    if same and not both:
                        x, ok, i, j = (y[i < j] for y in (x, ok, i, j))
                    own = pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(x), np.int32)), batch.column(key).slice(k, 1)).dictionary_decode()
                    for p, q in ((i, j), (j, i)) if both and not same else ((i, j),):
                        yield pa.RecordBatch.from_arrays([own, pa.array(p).cast(places), pa.array(q).cast(places), pa.array(x, mask=~ok)], [key, "i", "j", "sim"])

    return block_pairs(vectors, key).mapInArrow(made, f"{key} {kind}, i {place}, j {place}, sim double")


def matrix(vectors: DataFrame, key: str) -> DataFrame:
    """The full symmetric matrix as rows key, i, j, sim; null on the diagonal and for zero vectors."""
    return _block_rows(vectors, key, both=True)


def pair_statistics(p: DataFrame, by: Sequence[str], std: bool = True) -> DataFrame:
    """mean, std and median of the pairs of a group, each pair counting twice as in a symmetric matrix.

    std has one degree of freedom less than the doubled count; null if asked off or all values are equal.
    """
    m = F.count("sim")
    spread = F.sqrt(2 * m * F.var_pop("sim") / (2 * m - 1))
    differ = F.max("sim") > F.min("sim")
    value = F.when(differ, spread) if std else F.lit(None).cast("double")
    return p.groupBy(*by).agg(F.avg("sim").alias("mean"), value.alias("std"), F.median("sim").alias("median"))


def window_statistics(vectors: DataFrame, key: str, size: int) -> DataFrame:
    """Statistics of each window of `size` tokens: key, start (from 0), mean, std, median; all windows, also without pairs."""
    n = vectors.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    p = pairs(vectors, key, size).join(n, key)
    first, last = F.greatest(F.lit(0), F.col("j") - (size - 1)), F.least(F.col("i"), F.col("n") - size)
    p = p.filter(first <= last).select(key, "sim", F.explode(F.sequence(first.cast("long"), last.cast("long"))).alias("start"))
    return pair_statistics(p, [key, "start"], std=size > 2)


def summarise(windows: DataFrame, keys: DataFrame, key: str, size: int) -> DataFrame:
    """The five metrics of a key over its windows; a window without a mean makes the means null, so do too few tokens."""
    whole = F.count("mean") == F.count(F.lit(1))
    agg = windows.groupBy(key).agg(
        F.when(whole, F.avg("mean")).alias(METRICS[0]),
        F.when(whole, F.stddev_pop("mean")).alias(METRICS[1]),
        F.avg("std").alias(METRICS[2]),
        F.when(F.count("std") > 1, F.stddev_pop("std")).alias(METRICS[3]),
        F.when(F.count("median") == F.count(F.lit(1)), F.avg("median")).alias(METRICS[4]),
    )
    if size == 2:
        agg = agg.withColumns({m: F.lit(None).cast("double") for m in METRICS[1:4]})
    return keys.select(key).distinct().join(agg, key, "left")


def long_metrics(summary: DataFrame, key: str, digits: int | None = 6) -> DataFrame:
    """key, metric, score rows."""
    values = summary.select(key, *[(F.round(m, digits) if digits is not None else F.col(m)).alias(m) for m in METRICS])
    return values.unpivot(key, list(METRICS), "metric", "score")


def window_summary(vectors: DataFrame, key: str, size: int) -> DataFrame:
    return summarise(window_statistics(vectors, key, size), vectors, key, size)


def _counted(vectors: DataFrame, key: str, of_key: DataFrame | None = None) -> DataFrame:
    """Pairs of blocks to key, n, mean, m2 (squares about the mean), least, most, values, counts: of bins, or with `of_key` (key, lo, hi: bins) of the similarities in those."""
    whole = of_key is None

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                at_i, at_j, sim, there = _cosines(batch, k)
                x = sim[np.triu(there, 1) if at_i == at_j else there]
                if not len(x):
                    continue
                bins = np.clip(np.nan_to_num((x + 1) * (BINS / 2), nan=BINS), 0, BINS - 1).astype(np.int64)
                if whole:
                    count = np.bincount(bins)
                    values = np.flatnonzero(count)
                    count = count[values]
                else:
                    lo, hi = batch.column("lo")[k].as_py(), batch.column("hi")[k].as_py()
                    values, count = np.unique(x[(bins >= lo) & (bins <= hi)], return_counts=True)
                mean = x.mean()
                row = [len(x), mean, ((x - mean) ** 2).sum(), x.min(), x.max(), values.astype(float), count]
                yield pa.RecordBatch.from_arrays([batch.column(key).slice(k, 1), *[pa.array([y]) for y in row]], [key, "n", "mean", "m2", "least", "most", "values", "counts"])

    kind = vectors.schema[key].dataType.simpleString()
    return block_pairs(vectors, key, of_key).mapInArrow(made, f"{key} {kind}, n long, mean double, m2 double, least double, most double, values array<double>, counts array<long>")


def _middle(counted: DataFrame, key: str, ranks: DataFrame) -> DataFrame:
    """The values at the ranks `first` and `second` (key, first, second; from 0): key, lo, hi, and how many stand before lo."""
    each = counted.select(key, F.explode(F.arrays_zip("values", "counts")).alias("p")).groupBy(key, F.col("p.values").alias("value")).agg(F.sum("p.counts").alias("count"))
    upto = F.sum("count").over(Window.partitionBy(key).orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    at = each.withColumn("upto", upto).join(ranks, key)
    holds = lambda rank: F.min(F.when(F.col("upto") > F.col(rank), F.struct("value", (F.col("upto") - F.col("count")).alias("before"))))
    return at.groupBy(key).agg(holds("first").alias("lo"), holds("second").alias("hi")).select(key, F.col("lo.value").alias("lo"), F.col("hi.value").alias("hi"), F.col("lo.before").alias("before"))


def window_all(vectors: DataFrame, key: str) -> DataFrame:
    """Statistics over all pairs of a key; nulls for keys with fewer than two tokens.

    As pair_statistics() over pairs(), without a row for each pair: blocks send their moments and counts of bins; the bins
    that hold the two middle ranks are known then, and the blocks are gone through again for the similarities in those alone.
    """
    first = _counted(vectors, key)
    sums = first.groupBy(key).agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("mean"), F.min("least").alias("least"), F.max("most").alias("most"))
    shift = F.col("part") - F.col("mean")
    spread = first.select(key, F.col("n").alias("m"), F.col("mean").alias("part"), "m2").join(sums, key).groupBy(key).agg(F.sum(F.col("m2") + F.col("m") * shift * shift).alias("m2"))
    ranks = sums.select(key, F.expr("(n - 1) div 2").alias("first"), F.expr("n div 2").alias("second"))
    bins = _middle(first, key, ranks)
    inside = bins.join(ranks, key).select(key, (F.col("first") - F.col("before")).alias("first"), (F.col("second") - F.col("before")).alias("second"))
    middle = _middle(_counted(vectors, key, bins.drop("before")), key, inside)
    std = F.when(F.col("most") > F.col("least"), F.sqrt(2 * F.col("m2") / (2 * F.col("n") - 1)))
    stats = sums.join(spread, key).join(middle, key).select(key, "mean", std.alias("std"), ((F.col("lo") + F.col("hi")) / 2).alias("median"))
    return vectors.select(key).distinct().join(stats, key, "left")


def window_details(vectors: DataFrame, key: str, size: int) -> DataFrame:
    """Windows from 1 with their first and last token, their tokens as a text, and their statistics."""
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(0, size - 1)
    spans = vectors.select(key, F.col("pos").cast("long").alias("start"), F.collect_list("token").over(w).alias("tokens")).filter(F.size("tokens") == size)
    out = spans.join(window_statistics(vectors, key, size), [key, "start"], "left")
    return out.select(key, (F.col("start") + 1).alias("window_index"), F.get("tokens", F.lit(0)).alias("start_token"), F.get("tokens", F.lit(size - 1)).alias("end_token"), F.array_join("tokens", " ").alias("token_span"), "mean", "std", "median")


def tumbling(vectors: DataFrame, key: str, size: int, functions: dict[str, Callable[[str], Column]] | None = None) -> DataFrame:
    """Blocks of `size` tokens without overlap, each function over a block's pairs, then its mean over blocks.

    A block without a pair, as a single token at the end, makes the mean null.
    """
    functions = functions or {"mean": F.avg}
    inside = pairs(vectors, key, size).filter(F.floor(F.col("i") / size) == F.floor(F.col("j") / size))
    found = inside.groupBy(key, F.floor(F.col("i") / size).alias("block")).agg(*[f("sim").alias(n) for n, f in functions.items()])
    blocks = vectors.select(key, F.floor(F.col("pos") / size).alias("block")).distinct().join(found, [key, "block"], "left")
    return blocks.groupBy(key).agg(*[F.when(F.count(n) == F.count(F.lit(1)), F.avg(n)).alias(n) for n in functions])


def sentence_vectors(tokens: DataFrame, key: str) -> DataFrame:
    """Mean vectors of sentences: tokens (key, pos, token, vec, sentence) to key, pos (sentence from 0), token (text), vec, norm."""
    place = F.dense_rank().over(Window.partitionBy(key).orderBy("sentence")) - 1
    t = tokens.withColumn("place", place)
    found = t.groupBy(key, "place").agg(V.mean(F.col("vec")).alias("vec"), F.sort_array(F.collect_list(F.struct("pos", "token"))).alias("rows"))
    out = found.select(key, F.col("place").alias("pos"), F.array_join(F.transform("rows", lambda r: r["token"]), " ").alias("token"), "vec")
    return out.withColumn("norm", V.norm(F.col("vec")))


def sentence_summary(sentences: DataFrame, key: str) -> DataFrame:
    """The five metrics with the statistics over all pairs of sentences in the fields of means."""
    s = window_all(sentences, key)
    none = F.lit(None).cast("double")
    return s.select(key, F.col("mean").alias(METRICS[0]), none.alias(METRICS[1]), F.col("std").alias(METRICS[2]), none.alias(METRICS[3]), F.col("median").alias(METRICS[4]))


def sentence_details(sentences: DataFrame, key: str) -> DataFrame:
    """Pairs of sentences, from 1, with their texts; pairs without a similarity are left out."""
    p = pairs(sentences, key).filter("sim IS NOT NULL")
    t = sentences.select(key, "pos", "token")
    a = t.select(key, F.col("pos").alias("i"), F.col("token").alias("sentence_i_text"))
    b = t.select(key, F.col("pos").alias("j"), F.col("token").alias("sentence_j_text"))
    return p.join(a, [key, "i"]).join(b, [key, "j"]).select(key, (F.col("i") + 1).alias("sentence_i_index"), (F.col("j") + 1).alias("sentence_j_index"), "sentence_i_text", "sentence_j_text", F.col("sim").alias("similarity"))


def mean_pool(tokens: DataFrame, key: str, vector: str = "vec") -> DataFrame:
    """Mean vector of a key as rows key, dim, x; a key without vectors has none."""
    return pooled(tokens, key, vector).select(key, F.posexplode("vec").alias("dim", "x"))


def pooled(tokens: DataFrame, key: str, vector: str = "vec") -> DataFrame:
    """key, vec: the mean vector of a key. One row for each key and task is shuffled."""
    return tokens.filter(F.col(vector).isNotNull()).groupBy(key).agg(V.mean(F.col(vector)).alias("vec"))

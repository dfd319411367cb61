"""Distance of token order from randomness: permutation baselines and shortest paths."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import similarity as S

MODES = ("include0_includeN", "exclude0_includeN", "exclude0_excludeN")


def permutation(n: int, seed: int, mode: str = "include0_includeN") -> list[int]:
    """A shuffled order of n places; a mode may hold the first and the last in place."""
    if mode not in MODES:
        raise ValueError(f"unknown shuffle mode {mode!r}; known: {', '.join(MODES)}")
    head, tail = int(mode.startswith("exclude0")), int(mode.endswith("excludeN"))
    middle = list(range(head, n - tail))
    np.random.RandomState(seed).shuffle(middle)
    return [*range(head), *middle, *range(n - tail, n)]


def step_matrix(n: int, count: int, mode: str = MODES[0]) -> np.ndarray:
    """A row for each permutation 0 (as observed) to count - 1, whose seed is its number; a column for each pair of places i < j: 1 where they follow each other."""
    column = np.zeros((n, n), int)
    column[np.triu_indices(n, 1)] = np.arange(n * (n - 1) // 2)
    out = np.zeros((count, n * (n - 1) // 2))
    for p in range(count):
        order = np.array(permutation(n, p, mode) if p else range(n))
        out[p, column[np.minimum(order[:-1], order[1:]), np.maximum(order[:-1], order[1:])]] = 1
    return out


def first_places(tokens: DataFrame, key: str) -> DataFrame:
    """Tokens without repeats: a token keeps its first place and its last vector; places are numbered anew."""
    once = tokens.groupBy(key, "token").agg(F.min("pos").alias("first"), F.max_by("vec", "pos").alias("vec"), F.max_by("norm", "pos").alias("norm"))
    place = F.row_number().over(Window.partitionBy(key).orderBy("first")) - 1
    return once.select(key, place.alias("pos"), "token", "vec", "norm")


def windows(vectors: DataFrame, key: str, size: int = 8, count: int = 1000, mode: str = MODES[0]) -> DataFrame:
    """For each window (from 0) the mean distance of its pairs, and the mean step of the observed and of shuffled orders.

    A window's distances come together as one row, and the costs of all orders are one matrix product for a batch of
    windows: the permutations (count rows of size * (size - 1) / 2 numbers) are the same for all windows.
    """
    n = vectors.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    p = S.pairs(vectors, key, size).join(n, key)
    first, last = F.greatest(F.lit(0), F.col("j") - (size - 1)), F.least(F.col("i"), F.col("n") - size)
    p = p.filter(first <= last).withColumn("window_index", F.explode(F.sequence(first.cast("long"), last.cast("long"))))
    places = F.struct((F.col("i") - F.col("window_index")).alias("i"), (F.col("j") - F.col("window_index")).alias("j"), (1 - F.col("sim")).alias("dist"))
    rows = p.groupBy(key, "window_index").agg(F.transform(F.sort_array(F.collect_list(places)), lambda r: r["dist"]).alias("dists"))
    steps, wide = step_matrix(size, count, mode), size * (size - 1) // 2
    names = ["all_pairs_average", "actual_dist", "average_dist", "std_dist"]

    def costed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = np.array(b.column("dists").to_pylist(), float).reshape(-1, wide)
            known = ~np.isnan(d)
            d = np.where(known, d, 0.0)
            cost = d @ steps.T / (size - 1)
            cost[~known.any(axis=1)] = np.nan
            with np.errstate(all="ignore"):
                mean = np.where(known.any(axis=1), d.sum(axis=1) / known.sum(axis=1), np.nan)
            shuffled = cost[:, 1:]
            found = [mean, cost[:, 0], *((shuffled.mean(axis=1), shuffled.std(axis=1)) if count > 1 else (np.full(len(d), np.nan),) * 2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(x, pa.float64(), from_pandas=True) for x in found)], [key, "window_index", *names])

    kind = vectors.schema[key].dataType.simpleString()
    return rows.mapInArrow(costed, f"{key} {kind}, window_index long, " + ", ".join(f"{c} double" for c in names))


def path_length(d: np.ndarray, order: np.ndarray) -> float:
    return float(d[order[:-1], order[1:]].sum())


def short_path(d: np.ndarray) -> np.ndarray:
    """A short open path from place 0: nearest unvisited place next, then 2-opt; the observed order if that is shorter."""
    n = len(d)
    left = np.ones(n, bool)
    order = [0]
    left[0] = False
    while len(order) < n:
        rest = np.flatnonzero(left)
        order.append(int(rest[np.argmin(d[order[-1], rest])]))
        left[order[-1]] = False
    best = min((np.array(order), np.arange(n)), key=lambda o: path_length(d, o))
    better = True
    while better:
        better = False
        for a in range(1, n - 1):
            b = np.arange(a + 1, n)
            before, last = best[a - 1], best[b]
            after = np.append(best[a + 2 :], -1)
            edge = np.where(after >= 0, d[last, after], 0.0)
            new = np.where(after >= 0, d[best[a], after], 0.0)
            gain = d[before, best[a]] + edge - d[before, last] - new
            k = int(np.argmax(gain))
            if gain[k] > 1e-12:
                best[a : b[k] + 1] = best[a : b[k] + 1][::-1].copy()
                better = True
    return best


def local_divergence(order: np.ndarray, optimal: np.ndarray) -> float:
    """How far neighbours of an order lie apart on the optimal path."""
    place = np.empty(len(optimal), int)
    place[optimal] = np.arange(len(optimal))
    return float(np.abs(np.diff(place[order])).sum())


def z_score(x: float, values: np.ndarray) -> float:
    s = values.std() if len(values) else 0.0
    return float((x - values.mean()) / s) if s else 0.0


def divergence(vectors: DataFrame, key: str, max_tokens: int = 100, permutations: int = 1000, seed: int = 0) -> DataFrame:
    """Path metrics of a key's first max_tokens tokens against a short path and shuffled orders.

    A key's vectors come together in one task, at most max_tokens of them.
    """
    rows = vectors.filter(F.col("pos") < max_tokens).select(F.col(key).cast("string").alias("key"), "pos", "vec")
    names = ["key", "total_distance", "avg_distance", "global_divergence", "local_divergence", "global_div_z", "local_div_z", "optimal_path"]
    kinds = [pa.string(), *[pa.float64()] * 6, pa.list_(pa.int32())]

    def measured(group: pa.Table) -> pa.Table:
        group = group.sort_by("pos")
        k = group.column("key")[0].as_py()
        v = np.array(group.column("vec").to_pylist(), float)
        n = len(v)
        if n < 2:
            row = [k, *[0.0] * 6, list(range(n))]
        else:
            size = np.sqrt((v * v).sum(axis=1))
            with np.errstate(all="ignore"):
                d = 1 - (v @ v.T) / np.outer(size, size)
            d = np.nan_to_num(d, nan=1.0)
            np.fill_diagonal(d, 0)
            optimal, own = short_path(d), np.arange(n)
            total, best = path_length(d, own), path_length(d, optimal)
            rng = np.random.RandomState(seed)
            orders = [rng.permutation(n) for _ in range(permutations)]
            far = np.array([path_length(d, o) for o in orders]) - best
            near = np.array([local_divergence(o, optimal) for o in orders])
            local = local_divergence(own, optimal)
            row = [k, total, total / (n - 1), total - best, local, z_score(total - best, far), z_score(local, near), optimal.tolist()]
        return pa.Table.from_arrays([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], names)

    out = rows.groupBy("key").applyInArrow(measured, "key string, total_distance double, avg_distance double, global_divergence double, local_divergence double, global_div_z double, local_div_z double, optimal_path array<int>")
    return out.withColumn("key", F.col("key").cast(vectors.schema[key].dataType)).withColumnRenamed("key", key)

"""Exact top-k search by inner product in M-trees.

Vectors become integers (floor of `scale` times each component). With one more component,
sqrt(M^2 - |x|^2) for the stored vectors (M the largest length of the shard) and 0 for queries, the
order by inner product is the order by Euclidean distance: d^2 = |q|^2 + M^2 - 2 q.x. So each shard
of rows gets an M-tree over that metric: leaf pages hold vectors and their distance to the page's
pivot, routing pages hold pivots with covering radii and distances to their parent's pivot. A
query visits pages best first by the least distance that their radius allows; inside a page, the
stored distances rule entries out by the triangle inequality before any distance to them is
computed. The metric works on vectors divided by a power of two, the tree's and the query's own, which
leaves the order as it is and keeps squares finite. Bounds carry a margin for rounding and never rule
out ties; scores are exact integers, of any size.

Rows are dealt to shards by a hash of the id; equal vectors of a shard share an entry with their
ids in order, so copies cost nothing. A task holds the pages of one shard and reads a block of queries
as a stream; the blocks are large, so that a shard's pages are sent seldom: with a query for each 50
rows, n rows travel n / (50 BLOCK_ROWS) times as pages and n / (50 SHARD_ROWS) times as queries. k rows
leave for each query and shard.

Edge cases: rows without an id, null vectors and those with null or non-finite components take no
part; shorter vectors count as padded with zeros; scores
must fit 64 bits (else the query fails); ties go to the smaller id; a repeated id is a row
of its own, and a query skips all rows with its id; an empty table gives an empty result; extra
columns are left out.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bounded_batches, groups, runs

#: Rows of a shard and queries of a block.
SHARD_ROWS, BLOCK_ROWS = 8192, 32768

#: Entries of a page.
PAGE = 96

#: Relative margin of distance bounds.
MARGIN = 1e-9


def quantise(vectors: list[list[float]], scale: int) -> np.ndarray:
    """floor(scale * x) as a matrix, shorter vectors padded with zeros."""
    width = max(map(len, vectors), default=0)
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return np.floor(scale * out)


def _fit(m: np.ndarray, width: int) -> np.ndarray:
    if m.shape[-1] == width:
        return m
    out = np.zeros((*m.shape[:-1], width), m.dtype)
    out[..., : min(width, m.shape[-1])] = m[..., :width]
    return out


def _halvings(m: np.ndarray) -> int:
    """The power of two that brings all numbers to 1 at most."""
    return int(np.frexp(np.abs(m).max(initial=0))[1])


class MTree:
    """Pages of one shard; page 0 is the root, with its pivot at the end.

    A leaf: (True, parent distances, vectors, entry numbers). A routing page: (False, parent
    distances, radii, pivots, child pages). Pivots are divided by 2**halvings and have the extra component.
    """

    def __init__(self, pages: list[tuple], ids: list[list[int]], top: float, peak: float, halvings: int):
        self.pages, self.ids, self.top, self.peak, self.halvings = pages, ids, top, peak, halvings

    @property
    def head(self) -> tuple:
        """What there is beside the pages."""
        return self.ids, self.top, self.peak, self.halvings

    @classmethod
    def build(cls, ids: list[int], vectors: np.ndarray, page: int = PAGE, seed: int = 0) -> MTree:
        own, which = np.unique(vectors, axis=0, return_inverse=True) if len(vectors) else (vectors, np.empty(0, int))
        lists: list[list[int]] = [[] for _ in own]
        for i, e in sorted(zip(ids, which.ravel().tolist(), strict=True)):
            lists[e].append(i)
        halvings = _halvings(own)
        points = np.ldexp(own, -halvings)
        square = (points * points).sum(axis=1) if len(own) else np.empty(0)
        top = float(square.max(initial=0))
        points = np.column_stack((points, np.sqrt(np.maximum(0, top - square)))) if len(own) else points
        pages: list[tuple] = []
        rng = np.random.RandomState(seed)

        def make(members: np.ndarray, pivot: np.ndarray) -> int:
            number = len(pages)
            pages.append(())
            if len(members) <= page:
                pages[number] = (True, np.sqrt(((points[members] - pivot) ** 2).sum(axis=1)), own[members], members)
                return number
            k = min(page, -(-len(members) // page) + 1)
            centres = points[rng.choice(members, k, replace=False)]
            p = points[members]
            d = np.maximum(0, (p * p).sum(axis=1)[:, None] + (centres * centres).sum(axis=1) - 2 * p @ centres.T)
            near = d.argmin(axis=1)
            if (near == near[0]).all():
                near = np.arange(len(members)) % k
            radii, pivots, children = [], [], []
            for c in np.unique(near):
                part = members[near == c]
                radii.append(float(np.sqrt(((points[part] - centres[c]) ** 2).sum(axis=1)).max()))
                pivots.append(centres[c])
                children.append(make(part, centres[c]))
            q = np.array(pivots)
            pages[number] = (False, np.sqrt(((q - pivot) ** 2).sum(axis=1)), np.array(radii), q, np.array(children))
            return number

        if len(own):
            make(np.arange(len(own)), points.mean(axis=0))
            pages[0] = (*pages[0], points.mean(axis=0))
        return cls(pages, lists, top, float(np.abs(own).max(initial=0)), halvings)

    def search(self, query: np.ndarray, k: int, without: int | None = None) -> list[tuple[int, int]]:
        """The k best (score, id), larger scores and then smaller ids first; `without` is no answer."""
        if not self.pages:
            return []
        # Components that no stored vector has add nothing to a score.
        whole = _fit(query, len(self.pages[0][-1]) - 1)
        float_is_exact = self.peak * float(np.abs(whole).max(initial=0)) * max(1, len(whole)) < 1 << 52
        halvings = _halvings(whole)
        q = np.append(np.ldexp(whole, -halvings), 0.0)
        halvings += self.halvings
        square = float((q * q).sum())
        best: list[tuple[int, int]] = []
        margin = MARGIN * (square + self.top)
        slack = MARGIN * float(np.sqrt(square + self.top))

        def reach() -> float:
            """Distance within which an answer can still be, rounded up."""
            if len(best) < k:
                return np.inf
            score = float(np.ldexp(float(best[-1][0]), -halvings))
            return float(np.sqrt(max(0.0, square + self.top - 2 * score) + margin)) * (1 + MARGIN) + slack

        heap = [(0.0, 0, float(np.sqrt(((q - self.pages[0][-1]) ** 2).sum())))]
        while heap:
            least, number, to_pivot = heapq.heappop(heap)
            far = reach()
            if least > far:
                break
            node = self.pages[number]
            if node[0]:
                _, parent, vectors, members = node[:4]
                near = np.flatnonzero(np.abs(to_pivot - parent) <= far)
                if not len(near):
                    continue
                if float_is_exact:
                    scores = vectors[near] @ whole
                    if len(best) >= k:
                        good = scores >= best[-1][0]
                        near, scores = near[good], scores[good]
                    scored = [int(x) for x in scores]
                else:
                    scored = [sum(int(a) * int(b) for a, b in zip(v, whole, strict=True)) for v in vectors[near]]
                for j, score in zip(near.tolist(), scored, strict=True):
                    found = 0
                    for i in self.ids[members[j]]:
                        if i != without:
                            best.append((score, i))
                            found += 1
                            if found == k:
                                break
                best.sort(key=lambda x: (-x[0], x[1]))
                del best[k:]
            else:
                _, parent, radii, pivots, children = node[:5]
                near = np.flatnonzero(np.abs(to_pivot - parent) - radii <= far)
                d = np.sqrt(((pivots[near] - q) ** 2).sum(axis=1))
                for j, x in zip(near.tolist(), d.tolist(), strict=True):
                    bound = max(least, x - radii[j])
                    if bound <= far:
                        heapq.heappush(heap, (bound, int(children[j]), x))
        return best


def usable(id_column: str, vector: str) -> Column:
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return F.col(id_column).isNotNull() & v.isNotNull() & ~F.coalesce(bad, F.lit(True))


def top_k(rows: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """rows and queries (vec_id, embedding) to query_id, rank, vec_id, score."""
    spark = rows.sparkSession
    vector = F.transform("embedding", lambda x: x.cast("double")).alias("embedding")
    rows, queries = (x.filter(usable("vec_id", "embedding")).select(F.col("vec_id").cast("long").alias("vec_id"), vector) for x in (rows, queries))
    shards, blocks = (max(1, -(-x.count() // n)) for x, n in ((rows, shard_rows), (queries, block_rows)))

    def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (shard,), t in groups(batches, "shard"):
            ids, m = t.column("vec_id").to_pylist(), quantise(t.column("embedding").to_pylist(), scale)
            tree = MTree.build(ids, m)
            pages = [pickle.dumps(x) for x in (tree.head, *tree.pages)]
            n = len(pages)
            yield pa.RecordBatch.from_arrays([pa.array([shard] * n, pa.int32()), pa.array(range(n), pa.int64()), pa.array(pages, pa.binary())], ["shard", "page", "body"])

    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int"))
    pages = dealt.repartition(shards, "shard").sortWithinPartitions("shard", "vec_id").mapInArrow(built, "shard int, page long, body binary")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    none = F.lit(None)
    pages = pages.select("shard", every(blocks).alias("block"), F.lit(0).alias("kind"), F.col("page").alias("n"), "body", none.cast("array<double>").alias("embedding"))
    asked = queries.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("int"))
    asked = asked.select(every(shards).alias("shard"), "block", F.lit(1).alias("kind"), F.col("vec_id").alias("n"), none.cast("binary").alias("body"), "embedding")

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, now, bodies = None, None, []
        for (shard, block, kind), part in runs(batches, "shard", "block", "kind"):
            if (shard, block) != now:
                tree, now, bodies = None, (shard, block), []
            if kind == 0:
                bodies += [pickle.loads(x) for x in part.column("body").to_pylist()]
                continue
            if not bodies:  # a shard without rows
                continue
            tree = tree or MTree(bodies[1:], *bodies[0])
            out: list[tuple] = []
            for i, q in zip(part.column("n").to_pylist(), quantise(part.column("embedding").to_pylist(), scale), strict=True):
                out += [(i, other, s) for s, other in tree.search(q, k, i)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["query_id", "vec_id", "score"])

    bounded_batches(spark)
    both = pages.unionByName(asked).repartition(max(shards * blocks, 1), "shard", "block").sortWithinPartitions("shard", "block", "kind", "n")
    found = both.mapInArrow(searched, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

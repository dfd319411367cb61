import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lingualake.llm import mtree


def brute(data, k):
    rows = [(i, [math.floor(256 * x) for x in v]) for i, v in data if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, q in rows:
        if i % 50:
            continue
        scored = sorted(((-sum(a * b for a, b in zip(q, v, strict=False)), j) for j, v in rows if j != i))[:k]
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scored)]
    return sorted(out)


@pytest.mark.parametrize("clusters", [0, 5])
def test_matches_brute_force(spark, monkeypatch, clusters):
    monkeypatch.setattr(mtree, "PAGE", 12)
    rng = np.random.RandomState(clusters)
    centre = rng.randn(max(1, clusters), 8)
    data = [(i, ((centre[i % clusters] if clusters else 0) + 0.2 * rng.randn(8)).tolist()) for i in range(700)]
    same = data[3][1]
    data += [(700 + i, same) for i in range(60)]  # copies
    data += [(800, None), (850, [1.0, None, *[0.0] * 6]), (900, [float("nan"), *[0.0] * 7]), (950, [float("inf"), *[0.0] * 7]), (None, same), (1000, [0.0] * 8), (1050, same), (5, same)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>").withColumn("shard", F.lit("x"))
    floats = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    got = mtree.top_k(df, df.filter("vec_id % 50 = 0"), shard_rows=200, block_rows=5)
    want = brute(floats, 5)
    assert sorted(tuple(r) for r in got.collect()) == want


def test_few_and_large_numbers(spark):
    rows = [(0, [1e7, -3.0]), (1, [9e6, 5.0]), (50, [7.0, 1e7])]  # beyond exact floating point
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in mtree.top_k(df, df.filter("vec_id = 0")).collect())
    assert got == [(0, 1, 1, 2560000000 * 2304000000 - 768 * 1280), (0, 2, 50, 2560000000 * 1792 - 768 * 2560000000)]
    huge = spark.createDataFrame([(0, [0.0, 1.0]), (1, [1e200, 2.0]), (2, [-1e200, 3.0]), (3, [4.0, 0.5])], "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in mtree.top_k(huge, huge.filter("vec_id = 0")).collect())
    assert got == [(0, 1, 2, 256 * 768), (0, 2, 1, 256 * 512), (0, 3, 3, 256 * 128)]
    none = df.filter("vec_id < 0")
    assert mtree.top_k(none, none).count() == 0


def test_large_numbers_are_searched_in_the_tree():
    rng = np.random.RandomState(2)
    points = np.floor(2.0**28 * rng.randn(900, 6))  # products need more than 53 bits, some share a leading part
    points[::3] = points[0] + rng.randint(0, 3, (300, 6))
    tree = mtree.MTree.build(list(range(900)), points, page=20)
    whole = [[int(x) for x in v] for v in points]
    for i in range(0, 900, 37):
        want = sorted(((-sum(a * b for a, b in zip(whole[i], v, strict=True)), j) for j, v in enumerate(whole) if j != i))[:5]
        assert tree.search(points[i], 5, i) == [(-s, j) for s, j in want]


def test_pruning_computes_less():
    rng = np.random.RandomState(1)
    points = np.floor(256 * (rng.randn(40, 16)[np.arange(4000) % 40] + 0.01 * rng.randn(4000, 16)))
    tree = mtree.MTree.build(list(range(4000)), points, page=50)
    seen = []
    pages = tree.pages

    class Watched(list):
        def __getitem__(self, i):
            seen.append(i)
            return list.__getitem__(self, i)

    tree.pages = Watched(pages)
    tree.search(points[7], 5, 7)
    assert len(set(seen)) < len(pages) / 2

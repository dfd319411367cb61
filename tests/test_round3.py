"""What the third round's findings were about."""

import math

from lingualake.functions import vectors as V
from lingualake.operators import lm
from pyspark.sql import functions as F


def test_rounding_keeps_the_sign_of_zero(spark):
    rows = spark.createDataFrame([([-1e-7, 1e-7, -0.0, -0.1234567, 0.1234567, 0.0],)], "x array<double>")
    got = rows.select(F.transform("x", lambda x: V.rounded(x)).alias("x")).first()["x"]
    assert [(abs(v), math.copysign(1, v)) for v in got] == [(0, -1), (0, 1), (0, -1), (0.123457, -1), (0.123457, 1), (0, 1)]


def test_scores_of_arrays_shuffle_the_pairs_once(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        docs = spark.createDataFrame([(1, "a b a b. c"), (2, "a"), (3, ""), (4, "b a b a c. a b")], "k int, text string").withColumn("ws", F.expr("filter(split(text, ' '), x -> x <> '')"))
        scored = lm.bigram_scores_of(docs, ["k"], F.col("ws"))
        want = lm.bigram_scores(docs.select("k", F.posexplode("ws").alias("pos", "token")), ["k"])
        rounded = lambda df: sorted((r["k"], r["pos"], r["token"], round(r["logprob_actual"], 9), round(r["logprob_max"], 9), round(r["entropy"], 9), r["most_likely_token"]) for r in df.collect())
        assert rounded(scored) == rounded(want) and scored.count() == 10
        for df in (scored, lm.section_perplexity(scored, ["k"]), lm.sentence_perplexity(scored, "k", F.lit(1))):
            dealt = [x for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if "REPARTITION_BY_COL" in x]
            assert sum("ReusedExchange" not in x for x in dealt) == 1 and len(dealt) == 2
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_scored_table_has_a_row_for_every_token(spark, tmp_path):
    from lingualake.plans import catalogue

    spark.createDataFrame([(1, "a b a"), (2, "alone"), (3, " "), (4, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = {(r["doc_id"], r["pos"]): r for r in catalogue.queries()["bigram_scores"](spark, str(tmp_path)).collect()}
    assert sorted(rows) == [(1, 0), (1, 1), (1, 2), (2, 0)]
    assert rows[2, 0]["token"] == "alone" and rows[1, 0]["logprob_actual"] is None and rows[1, 1]["most_likely_token"] == "b"


def test_blocks_give_all_pairs_and_their_statistics(spark, monkeypatch):
    import numpy as np
    from lingualake.operators import similarity

    monkeypatch.setattr(similarity, "BLOCK", 4)
    rng = np.random.default_rng(3)
    rows = [(k, i, [0.0, 0.0, 0.0] if (k, i) == ("a", 2) else rng.normal(size=3).tolist()) for k, n in (("a", 11), ("b", 4), ("c", 1), ("d", 2)) for i in range(n)]
    rows += [("e", i, [1.0, 2.0, 2.0]) for i in range(6)]
    t = spark.createDataFrame(rows, "k string, pos int, vec array<double>").withColumn("norm", V.norm(F.col("vec"))).withColumn("token", F.lit("x"))
    sizes = {"a": 11, "b": 4, "c": 1, "d": 2, "e": 6}
    vec = {(k, i): np.array(v) for k, i, v in rows}
    cosine = lambda x, y: x @ y / np.sqrt((x @ x) * (y @ y)) if x.any() and y.any() else None
    got = {(r["k"], r["i"], r["j"]): r["sim"] for r in similarity.matrix(t, "k").collect()}
    want = {(k, i, j): None if i == j else cosine(vec[k, i], vec[k, j]) for k, n in sizes.items() for i in range(n) for j in range(n)}
    assert got.keys() == want.keys() and all((got[x] is None) == (want[x] is None) and (want[x] is None or math.isclose(got[x], want[x], abs_tol=1e-12)) for x in want)
    for r in similarity.window_all(t, "k").collect():
        s = np.array([want[r["k"], i, j] for i in range(sizes[r["k"]]) for j in range(i) if want[r["k"], i, j] is not None])
        if not len(s):
            assert r["mean"] is None and r["std"] is None and r["median"] is None
            continue
        assert math.isclose(r["mean"], s.mean(), abs_tol=1e-12) and math.isclose(r["median"], np.median(s), abs_tol=1e-12)
        if r["k"] in "ab":
            assert math.isclose(r["std"], np.sqrt(2 * len(s) * s.var() / (2 * len(s) - 1)), abs_tol=1e-12)
        if r["k"] in "de":
            assert r["std"] is None
    plan = similarity.window_all(t, "k")._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile" not in plan and "median" not in plan.split("Aggregate")[-1]


def test_sources_travel_in_place_of_samples(spark):
    from lingualake.operators import acoustics

    made = lambda x: F.transform(F.sequence(F.lit(0), F.lit(399)), lambda i: F.coalesce(x, F.lit(0.0)) * i)
    compact = spark.createDataFrame([("r", i, 4000, v, 400) for i, v in enumerate([1.0, None, 3.0])], "k string, block int, rate int, source double, size int")
    whole = compact.select("k", "block", "rate", made(F.col("source")).alias("samples"))
    lazy = acoustics.overlapped(compact, "k", made=made)
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(lazy) == rows(acoustics.overlapped(whole, "k"))
    found = acoustics.frames(lazy, "k")
    assert acoustics.loudest(lazy, "k").first()["loudest"] == found.agg(F.max("peak")).first()[0]

import numpy as np
import pytest
from pyspark.sql import functions as F

from lingualake.functions import vectors as V
from lingualake.operators import prosody, randomness, similarity, topics


def table(spark, groups):
    rows = [(k, i, f"t{i}", [float(x) for x in v]) for k, vs in groups.items() for i, v in enumerate(vs)]
    d = spark.createDataFrame(rows, "k string, pos int, token string, vec array<double>")
    return d.withColumn("norm", V.norm(F.col("vec")))


def cosines(v):
    v = np.asarray(v, float)
    n = np.sqrt((v * v).sum(axis=1))
    with np.errstate(all="ignore"):
        return v @ v.T / np.outer(n, n)


def naive(v, size):
    """Window statistics over full matrices, every pair twice."""
    c = cosines(v)
    out = []
    for s in range(len(v) - size + 1):
        m = c[s : s + size, s : s + size]
        x = m[~np.eye(size, dtype=bool)]
        x = x[np.isfinite(x)]
        out.append((x.mean(), x.std(ddof=1), np.median(x)))
    return np.array(out)


def test_doubled_pairs(spark):
    p = spark.createDataFrame([("a", 0.1), ("a", 0.2), ("a", 0.4)], "k string, sim double")
    r = similarity.pair_statistics(p, ["k"]).first()
    assert [round(r[c], 6) for c in ("mean", "std", "median")] == [0.233333, 0.136626, 0.2]


def test_windows_match_full_matrices(spark):
    rng = np.random.RandomState(2)
    groups = {"a": rng.randn(15, 5), "b": rng.randn(8, 5)}
    got = similarity.window_summary(table(spark, groups), "k", 8)
    for r in got.collect():
        w = naive(groups[r["k"]], 8)
        want = [w[:, 0].mean(), w[:, 0].std(), w[:, 1].mean(), w[:, 1].std() if len(w) > 1 else None, w[:, 2].mean()]
        for m, x in zip(similarity.METRICS, want, strict=True):
            assert (r[m] is None and x is None) or abs(r[m] - x) < 1e-9


def test_missing_values(spark):
    t = table(spark, {"zero": [[1, 0], [0, 0], [1, 1]], "two": [[1, 0], [1, 1], [0, 1]], "one": [[1, 2]]})
    got = {r["k"]: r for r in similarity.window_summary(t, "k", 2).collect()}
    assert all(got["zero"][m] is None for m in similarity.METRICS)
    assert got["two"]["mean_of_window_means"] == pytest.approx(np.sqrt(0.5))
    assert all(got["two"][m] is None for m in similarity.METRICS[1:4])
    assert all(got["one"][m] is None for m in similarity.METRICS)
    assert all(r[m] is None for r in similarity.window_summary(t, "k", 8).collect() for m in similarity.METRICS)
    tail = {r["k"]: r["mean"] for r in similarity.tumbling(t, "k", 2).collect()}
    assert tail["two"] is None


def test_sentences(spark):
    t = table(spark, {"a": [[1, 0], [0, 1], [1, 1], [2, 1]]}).withColumn("sentence", F.floor(F.col("pos") / 2))
    s = similarity.sentence_vectors(t, "k").orderBy("pos").collect()
    assert [(r["token"], r["vec"]) for r in s] == [("t0 t1", [0.5, 0.5]), ("t2 t3", [1.5, 1.0])]
    d = similarity.sentence_details(similarity.sentence_vectors(t, "k"), "k").collect()
    assert [(r["sentence_i_index"], r["sentence_j_index"]) for r in d] == [(1, 2)]


def test_permutations():
    for mode, head, tail in (("include0_includeN", 0, 0), ("exclude0_includeN", 1, 0), ("exclude0_excludeN", 1, 1)):
        p = randomness.permutation(8, 3, mode)
        assert sorted(p) == list(range(8))
        assert p[:head] == list(range(head)) and (not tail or p[-1] == 7)
    with pytest.raises(ValueError):
        randomness.permutation(8, 0, "other")


def test_randomness_matches_numpy(spark):
    rng = np.random.RandomState(5)
    v = rng.randn(9, 4)
    got = randomness.windows(table(spark, {"a": v}), "k", 5, 12).orderBy("window_index").collect()
    d = 1 - cosines(v)
    for s, r in enumerate(got):
        m = d[s : s + 5, s : s + 5]
        costs = [sum(m[a, b] for a, b in zip(o, o[1:], strict=False)) / 4 for o in [list(range(5)), *[randomness.permutation(5, p) for p in range(1, 12)]]]
        assert r["window_index"] == s
        assert np.allclose([r["all_pairs_average"], r["actual_dist"], r["average_dist"], r["std_dist"]], [m[np.triu_indices(5, 1)].mean(), costs[0], np.mean(costs[1:]), np.std(costs[1:])])


def test_repeated_tokens_collapse(spark):
    t = table(spark, {"a": [[1, 0], [0, 1], [1, 1]]}).withColumn("token", F.when(F.col("pos") == 1, "y").otherwise("x"))
    got = randomness.first_places(t, "k").orderBy("pos").collect()
    assert [(r["token"], r["vec"]) for r in got] == [("x", [1.0, 1.0]), ("y", [0.0, 1.0])]


def test_divergence(spark):
    rng = np.random.RandomState(1)
    got = {r["k"]: r for r in randomness.divergence(table(spark, {"a": rng.randn(12, 3), "b": [[1, 0]]}), "k", permutations=50).collect()}
    assert sorted(got["a"]["optimal_path"]) == list(range(12)) and got["a"]["optimal_path"][0] == 0
    assert got["a"]["global_divergence"] >= -1e-9
    assert got["b"]["total_distance"] == 0


def test_short_path_is_never_longer_than_observed():
    for seed in range(20):
        x = np.random.RandomState(seed).rand(15, 2)
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
        p = randomness.short_path(d)
        assert p[0] == 0 and sorted(p) == list(range(15))
        assert randomness.path_length(d, p) <= randomness.path_length(d, np.arange(15)) + 1e-9


def test_prosody(spark):
    d = spark.createDataFrame([("a", 0, 1.0), ("a", 1, 2.0), ("b", 0, 5.0)], "k string, idx int, dur double")
    assert {r["k"]: round(r["npvi"], 6) for r in prosody.npvi(d, "k", ["idx"], "dur").collect()} == {"a": 66.666667, "b": 0.0}
    n = spark.createDataFrame([("a", 0, 0.0, 0.2), ("a", 1, 0.6, 0.8), ("a", 2, 0.9, 1.0)], "k string, idx int, start double, end double")
    length = spark.createDataFrame([("a", 2.0)], "k string, duration double")
    rejected = spark.createDataFrame([("a", 0.3), ("a", 1.5)], "k string, start double")
    got = prosody.pauses(n, "k", length=length).orderBy("idx").collect()
    assert [(r["before_pause"], round(r["pause_dur"], 3), r["after_pause"]) for r in got] == [(True, 0.4, False), (False, 0, True), (True, 1.0, False)]
    got = prosody.pauses(n, "k", length=length, rejected=rejected).orderBy("idx").collect()
    assert [(r["before_pause"], round(r["pause_dur"], 3)) for r in got] == [(False, 0), (False, 0), (True, 0.5)]


def test_topics(spark):
    units = spark.createDataFrame([(i, [float(i % 2), 1.0 - i % 2]) for i in range(10)] + [(10, [9.0, 9.0])], "unit_id long, vec array<double>")
    got = topics.fit_topics(units, 3, min_topic_size=2)
    assert {r["topic_id"] for r in got.collect()} == {-1, 0, 1}
    assert got.filter("topic_id = -1").first()["unit_id"] == 10
    c = topics.as_vectors(topics.centroids(got), "topic_id")
    assert c.count() == 2
    k = topics.compare(c, spark.createDataFrame([("p", [1.0, 0.0]), ("q", [0.0, 1.0])], "predefined_topic string, vec array<double>"), top=1)
    assert k.filter("is_top_match").count() == 2


def test_all_pairs_meet_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK", 4)
    v = np.random.RandomState(4).randn(11, 3)
    t = table(spark, {"long": v, "short": v[:2], "one": v[:1]})
    got = {(r["k"], r["i"], r["j"]): r["sim"] for r in similarity.pairs(t, "k").collect()}
    c = cosines(v)
    assert len(got) == 55 + 1
    assert all(s == pytest.approx(c[i, j]) for (_, i, j), s in got.items())


def test_pooled_vectors(spark):
    t = table(spark, {"a": [[1, 0], [0, 4]], "b": [[2, 2]]}).unionByName(spark.createDataFrame([("c", 0, "t", None, None)], "k string, pos int, token string, vec array<double>, norm double"))
    assert {r["k"]: r["vec"] for r in similarity.pooled(t, "k").collect()} == {"a": [0.5, 2.0], "b": [2.0, 2.0]}
    assert sorted(tuple(r) for r in similarity.mean_pool(t, "k").collect()) == [("a", 0, 0.5), ("a", 1, 2.0), ("b", 0, 2.0), ("b", 1, 2.0)]


def test_hesitations_are_long_and_level(spark):
    from lingualake.operators import prosody

    rows = spark.createDataFrame([("a", 0.0, 0.3, 0.0), ("b", 0.0, 0.29, 0.0), ("c", 0.0, 0.5, -2.9), ("d", 0.0, 0.5, -3.0), ("e", 0.0, 0.5, 0.1), ("f", 0.0, 0.5, None)], "k string, start double, end double, intra double")
    assert sorted(r["k"] for r in prosody.hesitations(rows).collect()) == ["a", "c"]

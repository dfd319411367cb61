"""Readings that a table of ordinary texts can't tell apart."""

import math
import random
import time

import pytest
from lingualake.functions import text as T
from lingualake.operators import lm, segment, speech
from pyspark.sql import functions as F


def trimmed(spark, tokens, sequences):
    return spark.createDataFrame([(tokens,)], "t array<string>").select(lm.trim_artifacts(F.col("t"), sequences).alias("t")).first()["t"]


def peeled(tokens, sequences):
    plain = [[lm.plain_token(x) for x in s] for s in sorted(sequences, key=len, reverse=True) if s]
    tokens, more = list(tokens), True
    while more:
        more = False
        for s in plain:
            if [lm.plain_token(x) for x in tokens[-len(s) :]] == s:
                tokens, more = tokens[: -len(s)], True
                break
    return tokens


def test_trim_peels_from_the_end_longest_first(spark):
    assert trimmed(spark, ["x", "c", "a", "b"], [["a", "b"], ["c", "a"], ["b"]]) == ["x", "c"]
    assert trimmed(spark, ["x", '"▁<|end|>"'], [["▁<|end|>"]]) == ["x"]
    assert trimmed(spark, ["b", "b"], [["b"]]) == [] and trimmed(spark, ["b"], []) == ["b"] and trimmed(spark, [], [["b"]]) == []
    rng = random.Random(1)
    for _ in range(12):
        sequences = [[rng.choice("abc") for _ in range(rng.randint(1, 3))] for _ in range(3)]
        tokens = [rng.choice("abcx") for _ in range(rng.randint(0, 12))]
        assert trimmed(spark, tokens, sequences) == peeled(tokens, sequences)


def test_perplexity_counts_scored_tokens_only(spark):
    tokens = spark.createDataFrame([(1, i, t) for i, t in enumerate(["a", "b", "a", "b."])] + [(2, 0, "a")], "k int, pos int, token string")
    scores = lm.bigram_scores(tokens, ["k"])
    assert sorted(r["pos"] for r in scores.collect()) == [1, 2, 3]
    logs = [r["logprob_actual"] for r in scores.orderBy("pos").collect()]
    got = {r["k"]: r["perplexity"] for r in lm.section_perplexity(scores, ["k"], tokens.select("k").distinct()).collect()}
    assert got[2] is None and math.isclose(got[1], math.exp(-sum(logs) / 3))
    parts = {r["sentence_index"]: r["perplexity"] for r in lm.sentence_perplexity(scores, "k", F.lit(1)).collect()}
    assert set(parts) == {0, 1} and math.isclose(parts[0], math.exp(-logs[0])) and math.isclose(parts[1], math.exp(-sum(logs[1:]) / 2))


def test_sentence_chunks_keep_marks_and_share_by_the_whole_text(spark):
    docs = spark.createDataFrame([(1, "Go on!  And then? End"), (2, "..."), (3, ""), (4, "no marks here")], "doc_id int, text string")
    got = sorted(map(tuple, segment.topic_chunks_by_sentence(docs, F.lit(10)).collect()))
    # 6, 9 and 3 of 21 characters: 2, 4 and 1 tokens of ten.
    assert got == [(1, 0, "Go on!", 0, 2), (1, 1, "And then?", 2, 4), (1, 2, "End", 6, 1), (2, 0, "...", 0, 10), (4, 0, "no marks here", 0, 10)]


@pytest.mark.parametrize("repeated", [False, True])
def test_titled_sections_are_linear_in_lines(spark, repeated):
    text = "\n".join(f"{k}. Part {0 if repeated else k}\nline of {k}" for k in range(4000))
    docs = spark.createDataFrame([(1, text)], "doc_id int, text string")
    segment.titled_sections(docs, "Nothing").count()
    began = time.perf_counter()
    rows = segment.titled_sections(docs, "Part").collect()
    assert time.perf_counter() - began < 10
    assert len(rows) == 4000 and rows[17]["title"] == f"17. Part {0 if repeated else 17}" and rows[17]["content"] == "line of 17"
    same = segment.titled_sections(docs.withColumn("text", F.regexp_replace("text", r"(?m)^\d+\. ", "")), "Part").collect()
    assert len(same) == (1 if repeated else 4000) and same[-1]["content"] == "line of 3999"


def test_lines_are_split_once(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id int, text string")
    for df in (segment.titled_sections(docs, "Part"), segment.sentence_tokens(docs, T.words("text"))):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("split(") == 1


def test_detokenizer_keeps_starts_inside_tokens(spark):
    rows = spark.createDataFrame([(["▁a", "b▁c", "▁,", "▁\td", "", "▁▁e"],)], "t array<string>")
    assert rows.select(T.detokenize(F.col("t")).alias("x")).first()["x"] == "ab▁c, d e"


def test_repaired_times_follow_the_word_before(spark):
    words = [(1, 0, "a", None, 0.5, 3.0), (1, 1, "b", None, None, 3.0), (1, 2, "c", None, 0.4, 3.0), (1, 3, " d ", 2.0, None, 3.0), (1, 4, "e", 5.0, 6.0, 3.0), (1, 5, "f", -1.0, -2.0, 3.0), (2, 0, None, 0.0, 1.0, 3.0)]
    df = spark.createDataFrame(words, "k int, word_idx int, word string, start_time double, end_time double, duration double")
    got = [tuple(r) for r in speech.repair_timestamps(df, "k").orderBy("word_idx").collect()]
    assert got == [(1, 0, "a", 0.0, 0.5), (1, 2, "c", 0.5, 0.501), (1, 3, "d", 2.0, 2.25), (1, 5, "f", 0.0, 0.001)]

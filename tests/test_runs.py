"""Runs that follow their configuration, and results read back."""

import pytest
from lingualake import config
from lingualake.functions import providers
from lingualake.operators import aggregate
from lingualake.plans import catalogue, project, recordings
from lingualake.sources import sinks
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    root = tmp_path_factory.mktemp("talk")
    texts = {"01": "The dog ran. It was [loud] quick!\nThen a cat came. All was well.", "02": "One day we met. We sang a song together and danced."}
    for p, text in texts.items():
        d = root / "participants" / f"part-{p}" / "talk"
        d.mkdir(parents=True)
        (d / f"part-{p}_task-talk_acq-day_text.txt").write_text(text, encoding="utf-8")
    return root


def run(spark, root, **more):
    return project.run(spark, str(root), config.parse({"task_name": "talk", "cleaning": {"brackets": True}, **more}))


def test_steps_run_in_the_order_of_the_configuration(spark, root):
    def sections(**options):
        r = run(spark, root, pipeline_options=options)
        return {x["doc_id"]: x for x in r.tables["sections"].collect()}

    first = list(sections(clean_text=True, tokenize_text=True, normalize_text=True).values())
    later = list(sections(tokenize_text=True, clean_text=True).values())
    off = list(sections(clean_text=False, tokenize_text=True).values())
    assert all("[loud]" not in x["tokens"] for x in first) and any("[loud]" in x["tokens"] for x in later) and any("[loud]" in x["cleaned"] for x in off)
    assert all(len(x["normal_forms"]) == len(x["tokens"]) for x in first) and any("danc" in y for x in first for y in x["normal_forms"])
    assert all(y.islower() or not y.isalpha() for x in first for y in x["normal_forms"])
    with pytest.raises(config.ConfigError):
        run(spark, root, pipeline_options={"normalize_text": True, "tokenize_text": True})

    @project.step("shout")
    def shout(found, c):
        return found.withColumn("cleaned", F.upper("cleaned"))

    try:
        assert all(x["cleaned"].isupper() for x in sections(clean_text=True, shout=True).values())
    finally:
        del project.STEPS["shout"]
    with pytest.raises(config.ConfigError):
        config.parse({"pipeline_options": {"shout": True}})


def test_topics_of_sentences_and_chunks(spark, root):
    def units(unit, **more):
        r = run(spark, root, metrics_to_extract=["topic_modeling"], embeddings={"dimensions": 4}, topics={"nr_topics": 2, "chunk_text_units": unit, **more})
        return sorted(x["unit_id"].split("#")[1] for x in r.tables["topic_assignments"].collect())

    assert units("sentence") == ["0", "0", "1", "1", "2", "3"]
    assert units("fixed", chunk_size=6) == ["0", "0", "1", "1", "2"]
    assert units(20) == ["0", "0"]
    for bad in ("paragraph", "0", -3):
        with pytest.raises(config.ConfigError):
            config.parse({"topics": {"chunk_text_units": bad}})


def test_sentences_without_end_marks_come_from_the_text(spark, root):
    r = run(spark, root, metrics_to_extract=["embeddings"], embeddings={"dimensions": 4, "window_sizes": [2], "sentences": True, "remove_punctuation": True})
    pairs = [(x["sentence_i_index"], x["sentence_j_index"]) for x in r.tables["sentence_details"].collect()]
    # Four sentences of one text and two of the other, though no token ends with a mark.
    assert len(pairs) == 6 + 1


def test_stored_results_are_read_by_participant(spark, root, tmp_path):
    r = run(spark, root, metrics_to_extract=["embeddings", "logits", "perplexity"], embeddings={"dimensions": 4, "window_sizes": [2, 3], "sentences": True})
    out = str(tmp_path / "derivatives")
    project.write(r, out)
    assert {"similarity_summary", "sentence_details", "token_vectors"} <= set(sinks.stored(spark, out))
    every = sinks.read_results(spark, out)
    assert {"table", "part", "score", "similarity"} <= set(every.columns)
    assert {x["part"] for x in every.filter("table = 'similarity_summary'").select("part").distinct().collect()} == {"01", "02"}
    one = sinks.read_results(spark, out, ["similarity_summary", "sentence_details"], ["02"]).select("table", "part", "score")
    plan = one._jdf.queryExecution().executedPlan().toString()
    scans = [x for x in plan.splitlines() if "PartitionFilters" in x]
    assert len(scans) == 2 and all("part" in x.split("PartitionFilters: [")[1].split("]")[0] for x in scans) and "sentence_i_text" not in plan
    assert {(x["table"], x["part"]) for x in one.collect()} == {("similarity_summary", "02"), ("sentence_details", "02")}
    wide = {(x["part"], x["window"]): x["mean_of_window_means"] for x in aggregate.consolidated(sinks.read_results(spark, out, ["similarity_summary"])).collect()}
    assert set(wide) == {(p, w) for p in ("01", "02") for w in ("window-2", "window-3", "sentence")}
    want = {x["part"]: x["s"] for x in spark.read.parquet(f"{out}/metric=similarity_summary").filter("window = 'window-2' AND metric = 'mean_of_window_means'").groupBy("part").agg(F.avg("score").alias("s")).collect()}
    assert {f"{int(k):02}": round(v, 12) for k, v in want.items()} == {p: round(wide[p, "window-2"], 12) for p in ("01", "02")}
    with pytest.raises(ValueError):
        sinks.read_results(spark, out, ["nothing"])
    assert sinks.stored(spark, str(tmp_path / "nowhere")) == []


def test_consolidation_query_reads_what_was_written(spark):
    got = catalogue.queries()["stored_results"](spark, "/root/testdata/sf0.001")
    assert got.count() == 4 * 2


def test_words_fall_back_from_alignment_to_recognition_to_even_times(spark):
    heard = spark.createDataFrame([("a", 0, "Heard.", 0.0, 1.0), ("b", 0, "Heard.", 0.0, 1.0)], "path string, word_idx int, word string, start double, end double")
    placed = heard.filter("path = 'a'").withColumn("word", F.lit("placed"))
    providers.RECORDING["asr"]["t"] = lambda files: heard.join(files, "path", "left_semi")
    providers.RECORDING["alignment"]["t"] = lambda files: placed.join(files, "path", "left_semi")
    files = spark.createDataFrame([(x,) for x in "abcd"], "path string")
    texts = spark.createDataFrame([("b", "no", 1.0), ("c", "two words", 2.0), ("x", "other", 1.0)], "path string, transcript string, duration double")
    r = recordings.transcribe(files, "t", alignment="t", texts=texts)
    words = sorted((x["path"], x["word"], x["start"], x["end"]) for x in r["words"].collect())
    assert words == [("a", "placed", 0.0, 1.0), ("b", "Heard.", 0.0, 1.0), ("c", "two", 0.0, 1.0), ("c", "words", 1.0, 2.0)]
    assert [x["path"] for x in r["failed"].collect()] == ["d"]
    assert {x["path"] for x in recordings.transcribe(files, "t")["failed"].collect()} == {"c", "d"}

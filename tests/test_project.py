import io
import json
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from lingualake import config
from lingualake.plans import catalogue, project, recordings
from lingualake.sources import entities, readers, sinks
from lingualake.streaming import landing

RTF = rb"{\rtf1\ansi\ansicpg1252{\fonttbl\f0 Arial;}\f0 B: Gr\'fc\'dfe \u8364? \{x\}\par T: ja\line nein}"


def tree(tmp_path):
    root = tmp_path / "demo"
    for p, text in (("01", "dog;cat;dog"), ("02", "ant; bee; cow; elk")):
        d = root / "participants" / f"part-{p}" / "fluency"
        d.mkdir(parents=True)
        (d / f"part-{p}_task-fluency_cat-semantic_acq-animals_text.txt").write_text(text, encoding="utf-8")
        (d / f"part-{p}_task-other_acq-animals_text.txt").write_text("no")
        (d / "Thumbs.db").write_text("")
    (d / "part-02_task-fluency_acq-animals_text.xyz").write_text("?")
    (d / "part-02_task-fluency_acq-clothes_text.rtf").write_bytes(RTF)
    return root


def settings(**more):
    return config.parse({"task_name": "fluency", "corpus_key": "acq", "corpus_values": ["animals"], "fluency": {"word_splitter": ";"}, "document_information": ["fluency_word_count", "fluency_duplicate_count"], **more})


def test_project(spark, tmp_path):
    root = tree(tmp_path)
    c = settings(metrics_to_extract=["embeddings", "logits", "perplexity", "topic_modeling"], embeddings={"dimensions": 8, "window_sizes": [2, "all"], "sentences": True, "window_details": True}, randomness={"window_size": 3, "bootstrap": 5}, topics={"nr_topics": 2, "predefined_topics": ["pets at home"]}, perplexity={"calculate_sentence_perplexity": True})
    assert entities.check_layout(spark, str(root)).filter("severity = 'error'").count() == 0
    r = project.run(spark, str(root), c)
    d = r.tables["documents"].collect()
    assert len(d) == 3 and sum(x["error"] is not None for x in d) == 1
    info = {x["participant_id"]: (x["fluency_word_count"], x["fluency_duplicate_count"]) for x in r.tables["document_information"].collect()}
    assert info == {"01": (2, 1), "02": (4, 0)}
    written = project.write(r, str(root / "derivatives"))
    again = project.write(project.run(spark, str(root), c), str(root / "derivatives"))
    assert written == again
    s = spark.read.parquet(str(root / "derivatives" / "metric=similarity_summary"))
    assert s.count() == 2 * 3 * 5
    assert spark.read.parquet(str(root / "derivatives" / "metric=perplexity_section")).filter("perplexity > 0").count() == 2


def test_layout_errors(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        entities.check_layout(spark, str(tmp_path))


def test_config(tmp_path):
    (tmp_path / "a.yml").write_text("task_name: x\nlanguage: de\ncleaning: {brackets: true, odd: 1}\n")
    c = config.load(config.discover(tmp_path))
    assert c.cleaning.brackets and c.unknown == ["cleaning.odd", "language"]
    (tmp_path / "b.yaml").write_text("a: [")
    with pytest.raises(config.ConfigError):
        config.discover(tmp_path)
    with pytest.raises(config.ConfigError):
        config.load(tmp_path / "b.yaml")
    for bad in ({"metrics_to_extract": ["x"]}, {"input_file": "x"}, {"metrics_to_extract": ["perplexity"]}, {"pipeline_options": {"x": True}}):
        with pytest.raises(config.ConfigError):
            config.parse(bad)


def test_decoders():
    out = io.BytesIO()
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>Hällo</w:t><w:tab/><w:t>x</w:t></w:r></w:p><w:p><w:r><w:t>two</w:t></w:r></w:p></w:body></w:document>')
    assert readers.docx_text(out.getvalue()) == "Hällo\tx\n\ntwo"
    assert readers.rtf_text(RTF) == "B: Grüße € {x}\nT: ja\nnein"


def test_recordings(spark, tmp_path):
    t = np.arange(8000) / 8000
    (tmp_path / "a.wav").write_bytes(readers.write_wav(8000, (0.5 * np.sin(2 * np.pi * 100 * t)).tolist()))
    files = spark.read.format("binaryFile").load(str(tmp_path / "*.wav"))
    a = readers.read_wav(files).first()
    assert (a["rate"], a["channels"], a["seconds"], len(a["frames"])) == (8000, 1, 1.0, 100)
    f = readers.acoustic_functionals(readers.read_wav(files, offset=0.5)).first()
    assert abs(f["rms_mean"] - 0.5 / np.sqrt(2)) < 0.01
    n = readers.normalized_wav(files).first()["content"]
    x = np.array(readers.wav_info(bytes(n))[3])
    assert abs(np.sqrt((x * x).mean()) - 0.1) < 1e-3


def test_transcriptions_round_trip(spark, tmp_path):
    one = {"audio_file_path": "a.wav", "metadata": {"n": "1"}, "transcript_text": "hi", "combined_utterances": [{"text": "hi", "start_time": 0.0, "end_time": 1.0, "speaker": "A", "confidence": 1.0}]}
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(json.dumps(one, indent=4))
    d = readers.read_transcriptions(spark, str(tmp_path / "in"))
    assert d.first()["all_words"] == []
    sinks.write_transcriptions(d, str(tmp_path / "out"))
    assert readers.read_transcriptions(spark, str(tmp_path / "out")).first()["combined_utterances"][0]["text"] == "hi"


def test_section_csv(spark, tmp_path):
    (tmp_path / "s.csv").write_text("Metric,Similarity_Score\nm,0.5\nn,nan\n,\nNew Section,\nMetric,Similarity_Score\nm,0.25\n")
    got = readers.read_similarity_csv(spark, str(tmp_path / "s.csv")).collect()
    assert [(r["section_idx"], r["metric"], r["score"]) for r in got] == [(0, "m", 0.5), (1, "m", 0.25)]


def test_csv_sink(spark, tmp_path):
    d = spark.createDataFrame([("01", "a", [1.0, 2.0], [3, 4], 5)], "part string, token string, vec array<double>, optimal_path array<int>, n int")
    sinks.write_features(d, str(tmp_path), "embeddings", form="csv")
    r = spark.read.option("header", True).csv(str(tmp_path / "metric=embeddings")).first()
    assert (r["Dim_0"], r["Dim_1"], r["optimal_path"], r["n"]) == ("1.0", "2.0", "[3, 4]", "5.0")
    with pytest.raises(ValueError):
        sinks.write_features(d, str(tmp_path), "x", "ask")


def test_landing_stream(spark, tmp_path):
    rows = [("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 00:02:00"), ("a", "2024-01-01 00:20:00"), ("b", "2024-01-02 00:00:00")]
    d = spark.createDataFrame(rows, "k string, t string").select("k", F.to_timestamp("t").alias("ts"))
    d.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = landing.read(spark, str(tmp_path / "in"), d.schema)
    q = landing.write(landing.speech_runs(stream, "k"), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert {(r["k"], r["n_words"]) for r in got} >= {("a", 2), ("a", 1)}


def test_catalogue_is_consistent():
    assert set(catalogue.oracle_sql()) <= set(catalogue.queries())
    assert len(catalogue.queries()) > 70


def test_transcribe(spark, tmp_path):
    from lingualake.functions import providers
    from lingualake.plans import recordings

    words = [("a.wav", 0, "Hello", 0.0, 0.5), ("a.wav", 1, "there.", 0.5, 1.0), ("a.wav", 2, "Yes.", 1.5, 2.0), ("b.wav", 0, "No.", 0.0, 1.0)]
    spark.createDataFrame(words, "path string, word_idx int, word string, start double, end double").write.parquet(str(tmp_path / "words"))
    spark.createDataFrame([("a.wav", 0, 0.0, 1.1, "A"), ("a.wav", 1, 1.2, 3.0, "B")], "path string, seg_idx int, start double, end double, speaker string").write.parquet(str(tmp_path / "segments"))
    providers.precomputed("asr", "stored", str(tmp_path / "words"))
    providers.precomputed("diarization", "stored", str(tmp_path / "segments"))
    files = spark.createDataFrame([("a.wav",), ("b.wav",)], "path string")
    done = spark.createDataFrame([("b.wav", "json"), ("b.wav", "txt")], "path string, kind string")
    r = recordings.transcribe(files, "stored", "stored", speakers=2, done=done)
    assert r["texts"].first()["text"] == "A: Hello there.\nB: Yes."
    n = r["transcriptions"].collect()
    assert len(n) == 1 and len(n[0]["all_words"]) == 3 and [u["speaker"] for u in n[0]["combined_utterances"]] == ["A", "B"]
    sinks.write_transcriptions(r["transcriptions"], str(tmp_path / "out"))
    assert readers.read_transcriptions(spark, str(tmp_path / "out")).count() == 1
    with pytest.raises(ValueError):
        providers.get("asr", "nothing")


def test_chunks_of_recordings(spark):
    from lingualake.plans import recordings

    frames = [{"frame": i, "rms": 0.0 if 100 <= i < 220 or 400 <= i < 410 else 0.5, "zcr": 0.0} for i in range(600)]
    a = spark.createDataFrame([("a", 6.0, frames)], "path string, seconds double, frames array<struct<frame: long, rms: double, zcr: double>>")
    got = [(r["start_ms"], r["end_ms"]) for r in recordings.chunks(a, 1000, -30.0, 1000, 3000).orderBy("idx").collect()]
    assert got[0][0] == 0 and got[-1][1] == 6000 and all(x[1] == y[0] for x, y in zip(got, got[1:], strict=False))


def test_voice_of_a_recording(spark, tmp_path):
    rate, t = 8000, np.arange(8000 * 3) / 8000
    pitch = 120 + 30 * t
    x = np.sin(2 * np.pi * np.cumsum(pitch) / rate) * np.where((t * 2).astype(int) % 2 == 0, 0.5, 0.002)
    (tmp_path / "a.wav").write_bytes(readers.write_wav(rate, x))
    (tmp_path / "b.wav").write_bytes(readers.write_wav(rate, np.zeros(0)))
    files = spark.read.format("binaryFile").load(f"{tmp_path}/*.wav")
    blocks = readers.read_samples(files, seconds=0.7, reach=0.05).orderBy("first").collect()
    assert [(b["first"], b["last"]) for b in blocks] == [(i, min(i + 5600, 24000)) for i in range(0, 24000, 5600)]
    for b in blocks:
        assert b["start"] == max(0, b["first"] - 401) and np.allclose(b["samples"], x[b["start"] : b["last"] + 401], atol=1e-4)
    v = recordings.voice(files)
    nuclei = [r for r in v["nuclei"].orderBy("idx").collect() if r["valid"] and r["last_frame"] - r["first_frame"] > 20]
    assert len(nuclei) == 3 and v["syllables"].count() >= 3
    for k, r in enumerate(nuclei):
        # Half a second of tone from second k on.
        assert abs(r["first_frame"] / 100 - k) < 0.06 and abs(r["last_frame"] / 100 - k - 0.5) < 0.06
        assert abs(12 * np.log2(r["f0_median"] / (120 + 30 * (k + 0.25)))) < 0.5
    f = v["functionals"].collect()
    assert len(f) == 1 and f[0]["n_frames"] == 300 and f[0]["loudness_mean"] > 0
    assert v["profile"].first()["n_nuclei"] >= 3


def test_files_of_a_task_with_odd_letters(spark, tmp_path):
    d = tmp_path / "participants" / "part-01" / "text"
    d.mkdir(parents=True)
    for name in ("[x]", "x", "x{1}", "x1"):
        (d / f"part-01_task-{name}_text.txt").write_text("a")
    for task in ("[x]", "x", "x{1}"):
        assert [r["name"] for r in entities.scan(spark, str(tmp_path), task).collect()] == [f"part-01_task-{task}_text.txt"]

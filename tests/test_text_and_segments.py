import numpy as np
import pytest
from pyspark.sql import functions as F

from lingualake.functions import text as T
from lingualake.operators import lm, segment, speech
from lingualake.sources import entities


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first()["x"]


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_cleaning_steps(spark):
    assert one(spark, T.remove_timestamps("t", "#00:01:02-3#"), t="a #12:34:56-7# b #1:2#") == "a  b #1:2#"
    with pytest.raises(ValueError):
        T.timestamp_pattern(None)
    assert one(spark, T.remove_brackets("t"), t="a (b) <c> [d] {e} (f\ng)") == "a     (f\ng)"
    assert one(spark, T.general("t"), t="a / b , c  !\n \n\\d") == "a b, c!\nd"
    assert one(spark, T.strip("t"), t="\u00a0 \n a b\t\u2003") == "a b"
    assert one(spark, T.clean("t", brackets=True, punctuation=True, lower=True), t=" A (x) B, C! ") == "a b c"
    assert one(spark, T.remove_speaker_tags("t", ["A", "B"]), t="A: x\nB:  y\nC: z") == "x\ny\nC: z"


def test_fluency_lists(spark):
    w = T.fluency_words("t", ";")
    assert one(spark, T.repeats(w), t="a;b;a;a") == 2
    assert one(spark, T.fluency_clean(w), t="a;b;a;a") == "a b"
    assert one(spark, T.fluency_clean(w, lower=True), t="Ice-Bear; cat;;cat, dog") == "icebear cat dog"
    assert one(spark, T.repeats(T.fluency_split("t", ";")), t="a; a;;") == 1


@pytest.mark.parametrize("animals,n,repeated", [("hund; katze; maus; pferd; kuh; schaf; ziege; huhn; ente; gans; schwein; esel; löwe; tiger; bär; wolf; fuchs; hase; igel; reh; hirsch; elch", 22, 0), ("hund; katze; maus; hund", 4, 1)])
def test_document_counts(spark, animals, n, repeated):
    w = T.fluency_words("t", ";")
    assert (one(spark, F.size(w), t=animals), one(spark, T.repeats(w), t=animals)) == (n, repeated)


def test_tokens(spark):
    assert [one(spark, T.clean_model_token("t"), t=t) for t in ("▁Bär", "12", "▁(x)", "a_b", "[q]")] == ["Bär", None, "", "ab", ""]
    assert [one(spark, T.is_punctuation_token("t"), t=t) for t in ("▁", "<s>", "?!", "▁.", "a.")] == [True, True, True, True, False]
    assert one(spark, T.detokenize(F.split("t", " ")), t="▁Hal lo ▁, ▁Welt ▁!") == "Hallo, Welt!"


def test_titled_sections(spark):
    text = "lost\n1. Part: one\na\n\nPart: two\nb\n1. Part: one\nc"
    got = segment.titled_sections(docs(spark, text, "none"), "Part:").orderBy("section_idx").collect()
    assert [(r["section_idx"], r["title"], r["content"]) for r in got] == [(0, "1. Part: one", "c"), (1, "Part: two", "b")]
    marks = ["1.", "IV.", "a)", "B)", "12)", "a).", "B).", "1)."]
    lines = "\n".join(f"{m} Part: {k}\nbody {k}" for k, m in enumerate(marks)) + "\nL. Part: no\nM) x Part: no"
    got = segment.titled_sections(docs(spark, lines), "Part:").orderBy("section_idx").collect()
    assert [r["title"] for r in got] == [f"{m} Part: {k}" for k, m in enumerate(marks)]
    assert got[-1]["content"] == f"body {len(marks) - 1}\nL. Part: no\nM) x Part: no"
    problems = segment.section_problems(segment.titled_sections(docs(spark, text, "none", "Part: x"), "Part:"), docs(spark, text, "none", "Part: x"), 2).collect()
    assert {(r["doc_id"], r["problem"]) for r in problems} == {(1, "no section"), (2, "number of sections"), (2, "blank section")}
    with pytest.raises(ValueError):
        segment.title_pattern("")


def test_speakers(spark):
    d = docs(spark, "A: x\nmore: y z\n\nBär: b\nA: z", "plain text", "A: only", "")
    got = segment.speaker_filter(d, ["bär"]).collect()
    assert {(r["doc_id"], r["content"]) for r in got} == {(0, "b"), (1, "plain text")}
    assert {(r["doc_id"], r["content"]) for r in segment.speaker_filter(d, ["a"], keep_tags=True).collect()} == {(0, "A: x"), (0, "A: z"), (1, "plain text"), (2, "A: only")}
    assert segment.speaker_filter(d, None).count() == 4


def test_sentence_fallback(spark):
    t = spark.createDataFrame([(1, i, f"w{i}") for i in range(5)], "doc_id long, pos int, token string")
    src = spark.createDataFrame([(1, "One two. Three four five!")], "doc_id long, text string")
    got = [r["sentence"] for r in segment.sentence_blocks(t, src).orderBy("pos").collect()]
    assert got == [0, 0, 0, 1, 1]


def test_context_chunks_match_a_loop(spark):
    def loop(n, size, overlap):
        out, start, seen = {}, 0, 1
        while seen < n:
            for p in range(max(seen, start + (overlap if start else 1)), min(start + size, n)):
                out[p] = (start // (size - overlap), p - start)
                seen = p + 1
            start += size - overlap
        return out

    for n, size, overlap in ((300, 128, 64), (50, 7, 3), (40, 6, 1)):
        t = spark.createDataFrame([(i,) for i in range(n)], "pos int")
        got = {r["pos"]: (r["chunk_idx"], r["local_pos"]) for r in segment.context_chunks(t, size, overlap).collect() if r["pos"]}
        assert got == loop(n, size, overlap)
    with pytest.raises(ValueError):
        segment.context_chunks(t, 8, 0)


def test_merged_intervals_cover_and_keep_the_bounds(spark):
    rng = np.random.RandomState(0)
    points = {f: np.concatenate(([5], 5 + np.cumsum(rng.randint(1, 290 if f % 3 else 90, rng.randint(1, 14))))).tolist() for f in range(30)}
    rows = [(f, i, a, b) for f, p in points.items() for i, (a, b) in enumerate(zip(p, p[1:], strict=False))]
    least, most = 60, 100
    got = {f: [] for f in points}
    for r in segment.merge_intervals(spark.createDataFrame(rows, "file_id int, idx int, start_ms long, end_ms long"), least, most).orderBy("file_id", "idx").collect():
        got[r["file_id"]].append((r["start_ms"], r["end_ms"]))
    for f, p in points.items():
        pieces = got[f]
        assert pieces[0][0] == p[0] and pieces[-1][1] == p[-1]
        assert all(b == c for (_, b), (c, _) in zip(pieces, pieces[1:], strict=False))
        ends = set(p[2:]) or {p[-1]}  # the first interval is never alone
        # Cuts at given points; between two of them the pieces are even.
        begin, inside = p[0], []
        for a, b in pieces:
            inside.append(b - a)
            if b in ends and (sum(inside) <= most or len(set(inside[:-1])) <= 1 and inside[-1] <= inside[0]):
                whole = b - begin
                if b != p[-1]:
                    assert whole >= least
                # No cut was possible before.
                assert not any(begin + least <= e < b for e in ends)
                if b != p[-1] or whole >= least and len(inside) > 1:
                    assert len(inside) == max(1, -(-whole // most)) and max(inside) <= most
                begin, inside = b, []
        assert not inside


def test_timestamp_repair(spark):
    rows = [(1, 0, "a", None, 1.0, 3.0), (1, 1, " ", 1.0, 2.0, 3.0), (1, 2, "b", None, None, 3.0), (1, 3, "c", None, 2.0, 3.0), (1, 4, "d", 2.9, None, 3.0), (1, 5, "e", 5.0, 6.0, 3.0), (1, 6, "f", 2.0, 1.0, 3.0)]
    d = spark.createDataFrame(rows, "k int, word_idx int, word string, start_time double, end_time double, duration double")
    got = [(r["word"], round(r["start_time"], 4), round(r["end_time"], 4)) for r in speech.repair_timestamps(d, "k").orderBy("word_idx").collect()]
    assert got == [("a", 0.0, 1.0), ("c", 1.0, 2.0), ("d", 2.9, 3.0), ("f", 2.0, 2.001)]


def test_overlap_ties_and_utterances(spark):
    words = spark.createDataFrame([(1, 0, "one", 0.0, 1.0), (1, 1, "two.", 1.0, 2.0), (1, 2, "x", 2.0, 3.0), (1, 3, "y", 30.0, 31.0)], "f int, word_idx int, word string, start double, end double")
    segs = spark.createDataFrame([(1, 0, -1.0, 0.5, "B"), (1, 1, 0.2, 2.5, "A"), (1, 2, 2.5, 9.0, "C")], "f int, seg_idx int, start double, end double, speaker string")
    s = speech.word_speakers(words, segs, "f", bucket=0.7)
    assert [r["speaker"] for r in s.orderBy("word_idx").collect()] == ["B", "A", "A", "UNKNOWN"]
    u = speech.utterances(s, "f").orderBy("utt_idx").collect()
    assert [(r["text"], r["speaker"], r["confidence"]) for r in u] == [("one two.", "B", 0.5), ("x y", "A", 0.5)]
    none = speech.word_speakers(words, segs.limit(0), "f", speakers=1)
    assert {r["speaker"] for r in none.collect()} == {"SPEAKER_0"}


def test_language_model_helpers(spark):
    a = F.split("t", " ")
    assert one(spark, lm.trim_artifacts(a, [["x", "y"], ["y"]]), t="a y b x y y") == ["a", "y", "b"]
    assert one(spark, lm.prompt_length(a, [["b"], ["a", "b"], ["a"]]), t='"a" b c') == 2
    # Scored tokens begin at place 1: the first token of a text has no row.
    rows = [(1, i + 1, w, p) for i, (w, p) in enumerate([("there", -1.0), ("too.", -1.0), ("Yes", -2.0), (".", -1.0), ("So", -0.5), ("be", -0.5)])]
    s = spark.createDataFrame(rows, "k int, pos int, token string, logprob_actual double")
    got = {r["sentence_index"]: r["perplexity"] for r in lm.sentence_perplexity(s, "k").collect()}
    assert got[0] is None and set(got) == {0, 1, 2}
    assert abs(got[1] - np.exp(1)) < 1e-9 and abs(got[2] - np.exp(0.5)) < 1e-9
    assert abs(lm.section_perplexity(s, ["k"]).first()["perplexity"] - np.exp(6 / 6)) < 1e-9


def test_entities(spark):
    spark.conf.set("spark.sql.mapKeyDedupPolicy", "LAST_WIN")
    m = one(spark, entities.parse_entities("n"), n="part-01_task-a_x-1-2_task-b_text_other.tar.gz")
    assert m == {"part": "01", "task": "b", "x": "1-2", "suffix": "other.tar", "extension": ".gz"}
    assert [one(spark, entities.is_hidden("n"), n=n) for n in (".x", "Thumbs.db", "a.txt")] == [True, True, False]
    paths = [("p", "participants/part-01/t/part-01_x.txt"), ("q", "notes.txt"), ("r", "participants/x.txt")]
    v = entities.violations(spark.createDataFrame(paths, "project string, path string")).filter("severity = 'error'").collect()
    assert {(r["project"], r["rule"]) for r in v} == {("q", "participants folder is missing"), ("r", "no participant folder")}


def test_sentences_in_the_row_match_the_window(spark):
    d = docs(spark, "A b. C! d e", "", None, "one", "one.", ". . x", "no end here", "a? b? c?")
    t = d.select("doc_id", F.posexplode(T.words("text")).alias("pos", "token"))
    want = segment.sentence_index(t, ["doc_id"]).select("doc_id", "pos", "token", "sentence").collect()
    got = segment.sentence_tokens(d, T.words("text")).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and got


def test_scores_of_frequent_and_first_tokens(spark):
    rows = [("x", i, w) for i, w in enumerate("a b a c a b".split())] + [("y", 0, "a")]
    got = {(r["k"], r["pos"]): r for r in lm.bigram_scores(spark.createDataFrame(rows, "k string, pos int, token string"), ["k"]).collect()}
    assert sorted(got) == [("x", k) for k in range(1, 6)]
    assert got["x", 1]["logprob_actual"] == pytest.approx(np.log(3 / 6)) and got["x", 3]["logprob_actual"] == pytest.approx(np.log(2 / 6))
    assert got["x", 3]["most_likely_token"] == "b" and got["x", 2]["most_likely_token"] == "a"

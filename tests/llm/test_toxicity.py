import random
import time

import pytest

from lingualake.llm import toxicity as X

from .fixtures import documents


def corpus(n=600):
    rng = random.Random(4)
    calm = ["".join(rng.choice("aeioubdgklmnprst") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    bad, kind = ["vilely", "grubber", "nasti"], ["kill bugs", "grubber tool"]
    out, labels = [], []
    for i in range(n):
        words = [rng.choice(calm) for _ in range(rng.randint(20, 200))]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(rng.randint(1, 4)):
                words.insert(rng.randrange(len(words)), rng.choice(bad[:2]) if i % 2 else bad[2] + rng.choice(["ness", "er", "ly", "mo"]))
            if i % 2:
                words.insert(1, bad[1])
        elif i % 96 == 1:  # seldom and in one phrase only
            words.insert(3, kind[1])
        out.append((i, " ".join(words), "en", "s", 1))
        labels.append((i, int(toxic)))
    return out, labels


@pytest.fixture(scope="module")
def learned(spark):
    docs, labels = corpus()
    return X.fit(documents(spark, docs), spark.createDataFrame(labels, "doc_id long, toxic int").filter("doc_id % 4 <> 0"), max_rows=10_000)


def test_held_out_documents(spark, learned):
    docs, labels = corpus()
    got = {r["doc_id"]: r["score"] for r in X.score(documents(spark, docs, clash=True), learned).collect()}
    wrong = [i for i, toxic in labels if i % 4 == 0 and (got[i] >= 0.5) != bool(toxic)]
    assert len(wrong) <= 3
    assert all(0 <= s <= 1 for s in got.values())


def test_stems_and_exceptions_are_learned(learned):
    assert any(e.startswith("nasti"[:4].replace("l", "i")) for e in learned.weights)
    assert "grubber tooi" in learned.exceptions
    a = learned.automaton()
    assert not X.hits(X.fold("a grubber tool here"), a)
    assert X.hits(X.fold("a grubber here"), a)


def test_disguises_fold(learned):
    a = learned.automaton()
    for text in ("GRUBBER", "grubb3r", "gruьber".replace("ь", "b"), "grübber", "gru\u200bbber", "ɡrubbеr", "VILELY!", "v1lely"):
        assert X.hits(X.fold(text), a), text
    assert not X.hits(X.fold("ungrubber"), a)


def test_edge_rows(spark, learned):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (None, "grubber", "en", "s", 7), (3, "x " * 30_000 + "grubber grubber", "en", "s", 1)]
    got = X.score(documents(spark, rows), learned).collect()
    assert len(got) == 5
    assert all(r["score"] < 0.5 for r in got if r["doc_id"] in (1, 2))


def test_nothing_to_learn(spark):
    docs, labels = corpus(20)
    none = X.fit(documents(spark, docs), spark.createDataFrame([(1, None), (2, 0)], "doc_id long, toxic int"))
    assert not none.weights
    assert all(r["score"] == 0 for r in X.score(documents(spark, docs), none).collect())
    assert X.score(documents(spark, []), none).count() == 0


def test_reject_keeps_clean_rows_unchanged(spark):
    docs, labels = corpus()
    df = documents(spark, docs, clash=True)
    got = X.reject(spark, df, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert got.columns == df.columns
    assert {r["doc_id"] for r in got.collect()} == {i for i, toxic in labels if not toxic}


def test_hits_match_a_plain_search(learned):
    """Every entry looked for at every place, and every hit held against every exception phrase."""
    rng, a = random.Random(9), learned.automaton()
    words = ["grubber", "tool", "grubber tool", "vilely", "nastiness", "calm", "ungrubber", "kill", "bugs", "GRUBB3R", "grub"]
    for _ in range(200):
        text = X.fold(" ".join(rng.choice(words) for _ in range(rng.randint(0, 30))))
        found = {}
        for entry, w in learned.weights.items():
            for p in range(len(text)):
                if text.startswith(" " + entry, p):
                    found[p + 1] = max(w, found.get(p + 1, w))
        free = [(p, p + len(e) + 1) for e in learned.exceptions for p in range(len(text)) if text.startswith(f" {e} ", p)]
        assert X.hits(text, a) == [(p, w) for p, w in sorted(found.items()) if not any(x <= p <= y for x, y in free)]


def test_many_hits_take_linear_time(learned):
    text, begun = X.fold("a grubber tool and vilely " * 60_000), time.process_time()
    assert len(X.hits(text, learned.automaton())) == 60_000
    assert time.process_time() - begun < 5


def test_a_shared_passage_hides_no_label(spark):
    """Rows of both labels that hold one passage, least word triples in it, still teach their own words."""
    passage = " ".join(f"p{k}" for k in range(60))
    docs = [(i, f"{passage} {'vilely ' * 3 if i % 2 else 'kindly ' * 3} tail{i}", "en", "s", 1) for i in range(400)]
    lexicon = X.fit(documents(spark, docs), spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, toxic int"))
    got = {r["doc_id"]: r["score"] for r in X.score(documents(spark, docs), lexicon).collect()}
    assert not lexicon.weights or all((s >= 0.5) == (i % 2 == 1) for i, s in got.items())

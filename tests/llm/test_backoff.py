import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from lingualake.llm import backoff as B
from pyspark.sql import functions as F

from .fixtures import documents, rows

LOW = {c: c + 32 for c in range(65, 91)}


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))


def plain(data, learned, order=B.ORDER, strengths=B.STRENGTHS):
    """Scores by the formula, over dictionaries of whole n-grams."""
    texts = [("<begin>", *tokens(t), "<end>") for _, t, *_ in data]
    c = Counter()
    for t, yes in zip(texts, learned, strict=True):
        if yes:
            c[t[:1]] += 1
            for k in range(1, order + 1):
                c.update(t[i - k + 1 : i + 1] for i in range(1, len(t)) if i - k + 1 >= 0)
    words = {g: n for g, n in c.items() if len(g) == 1 and g != ("<begin>",)}
    n, kinds = sum(words.values()), len(words)

    def p(g):
        if len(g) == 1:
            return (c[g] or kinds) / (n + kinds) if n else 1.0
        m = strengths[len(g) - 2]
        return (c[g] + m * p(g[1:])) / (c[g[:-1]] + m)

    out = []
    for (i, *_), t, yes in zip(data, texts, learned, strict=True):
        score = sum(math.log10(p(t[max(0, at - order + 1) : at + 1])) for at in range(1, len(t)))
        base = sum(math.log10((c[(w,)] + 0.1) / (n + 0.1 * (kinds + 1))) for w in t[1:])
        out.append((i, not yes, len(t) - 1, sum(c[(w,)] > 0 for w in t[1:]), n, round(base, 6), round(score, 6)))
    return sorted(out, key=repr)


def scored(spark, data, train, **more):
    df = B.score(documents(spark, data, clash=True), train, **more)
    return sorted(map(tuple, df.withColumns({c: F.round(c, 6) for c in ("base_score", "score")}).collect()), key=repr)


def close(a, b):
    return len(a) == len(b) and all(x[:5] == y[:5] and abs(x[5] - y[5]) < 2e-6 and abs(x[6] - y[6]) < 2e-6 for x, y in zip(a, b, strict=True))


def test_automaton_gives_the_formula(spark):
    data = rows()
    learned = [i is not None and i % 2 == 0 for i, *_ in data]
    got = scored(spark, data, F.col("doc_id") % 2 == 0)
    assert close(got, plain(data, learned))
    held = [r for r in got if r[1] and r[2] > 20]
    assert sum(r[6] for r in held) > sum(r[5] for r in held)


def test_pieces_carry_the_state(spark):
    data = [*rows(n=15), (801, "q" * 300 + " ab " + "cd " * 60, "en", "s", 1), (802, None, "en", "s", 1)]
    learned = [i is not None and i % 2 == 1 for i, *_ in data]
    for order, strengths in ((1, ()), (2, (3.0,)), (4, (5.0, 2.0, 1.0))):
        got = scored(spark, data, F.col("doc_id") % 2 == 1, order=order, strengths=strengths, limit=120, block_bytes=3000)
        assert close(got, plain(data, learned, order, strengths))


def test_no_training_texts_and_no_rows(spark):
    assert [(r[4], r[5], r[6]) for r in scored(spark, [(1, "a b", "en", "s", 1)], F.lit(None).cast("boolean"))] == [(0, 0.0, 0.0)]
    assert scored(spark, [], F.lit(True)) == []
    with pytest.raises(ValueError):
        B.score(documents(spark, []), F.lit(True), strengths=(1.0,))


def test_followers_of_a_state_sum_to_one():
    texts = ["a b a c", "b a b", "a a"]
    probes = [f"{x} {y} {w}".strip() for x in "abc" for y in "abc" for w in ("a", "b", "c", "new", "")]
    every, train = texts + probes, np.arange(3 + len(probes)) < 3
    g = B.Grams([""] * len(every), every, np.zeros(len(every), np.int64), np.ones(len(every), np.int64), train, 3, 64)
    n = int((g.scored & np.repeat(train, g.stops - g.starts)).sum())
    machine = B.Automaton(g, g.counts, n, 4, (2.0, 1.0))  # four kinds: a, b, c and the end
    sums = Counter()
    for text, a in zip(probes, g.starts[3:].tolist(), strict=True):
        # The third token after the mark: a word or the end.
        sums[text[:3]] += 10 ** machine.traverse(a, a + 3, a + 4)
    assert len(sums) == 9 and all(abs(x - 1) < 1e-9 for x in sums.values())


def test_word_hashes_go_by_the_word_alone():
    rng = random.Random(3)
    words = ["".join(rng.choice("abé\x00ß") for _ in range(rng.randint(1, 9))) for _ in range(3000)] + ["a", "a\x00", "\x00a", "k" * (B._SPAN + 5), "k" * (B._SPAN + 5)]
    rng.shuffle(words)
    for gap in (" ", "\n\t "):
        data = gap.join(words).encode()
        hashes, starts = B.word_hashes(data)
        assert len(hashes) == len(words) and len(set(hashes.tolist())) == len(set(words))
        seen = dict(zip(words, hashes.tolist(), strict=True))
        assert [seen[w] for w in words] == hashes.tolist()
        assert data[starts[5] :].startswith(words[5].encode())
    assert len(B.word_hashes(b" \n")[0]) == 0

import hashlib
from collections import Counter

import numpy as np
import pytest

from lingualake.llm import ngramjoin as J

from .fixtures import documents, rows


def grams(text, n=5):
    w = text.lower().encode().split()
    k = min(n, len(w))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else frozenset()


def components(data, threshold=0.8):
    """Links of each row and the rows of each class, by comparing all pairs."""
    docs = [(i, (t or "").lower(), grams(t or "")) for i, t, *_ in data]
    n = len(docs)
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = Counter()
    for a in range(n):
        for b in range(a):
            same = docs[a][1] == docs[b][1]
            g, h = docs[a][2], docs[b][2]
            if same or (g and h and len(g & h) >= threshold * len(g | h) - 1e-9):
                links[a] += 1
                links[b] += 1
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    classes = {}
    for a in range(n):
        classes.setdefault(find(a), []).append(a)
    return links, list(classes.values())


def brute(data, threshold=0.8):
    """Rows of id, links and the least id of the class."""
    links, classes = components(data, threshold)
    out = []
    for own in classes:
        ids = [data[a][0] for a in own]
        least = None if set(ids) == {None} else min(x for x in ids if x is not None)
        out += [(data[a][0], links[a], least) for a in own]
    return sorted(out, key=repr)


def near_rows():
    base = rows(3, 20)
    words = [f"w{i}" for i in range(150)]
    copies = []
    for k in range(70):  # a large group of near copies
        w = list(words)
        w[k * 2 % 150] = f"x{k}"
        copies.append((1000 + k, " ".join(w), "en", "src0", 1))
    return base + copies


def test_links_and_classes_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(J, "BLOCK", 16)  # so that the group takes several blocks
    data = near_rows()
    got = J.join(documents(spark, data, clash=True)).select("doc_id", "n_links", "class_id").collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(data)


def test_dedup_keeps_one_of_each_class(spark):
    data = near_rows()
    docs = documents(spark, data, clash=True)
    got = J.dedup(docs)
    assert got.columns == docs.columns
    kept = [r["doc_id"] for r in got.collect()]
    # Of each class the least id, null before all; classes may share an id.
    want = [min((data[a][0] for a in own), key=lambda x: (x is not None, x or 0)) for own in components(data)[1]]
    assert sorted(kept, key=repr) == sorted(want, key=repr)


def test_blocks_and_slices_by_n_grams(spark, monkeypatch):
    monkeypatch.setattr(J, "BLOCK_GRAMS", 700)
    monkeypatch.setattr(J, "SLICE", 100)
    data = near_rows()
    got = J.join(documents(spark, data)).select("doc_id", "n_links", "class_id").collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(data)


def test_dedup_keeps_a_row_of_each_class_whatever_the_ids(spark):
    words = [f"w{i}" for i in range(60)]
    near = lambda k: " ".join([*words[:k], "x", *words[k + 1 :]])
    texts = [(None, "one text without id"), (None, "another without id"), (None, "ANOTHER without id"), (None, "a third without id"), (5, "text under five"), (5, "other text under five"), (5, "Text under five"), (7, near(0)), (None, near(59)), (8, "alone"), (9, None), (None, "")]
    data = [(i, t, "en", "s", 1) for i, t in texts]
    got = [(r["doc_id"], (r["text"] or "").lower()) for r in J.dedup(documents(spark, data, clash=True)).collect()]
    want = [(None, "one text without id"), (None, "another without id"), (None, "a third without id"), (5, "text under five"), (5, "other text under five"), (None, near(59)), (8, "alone"), (None, "")]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_bands_reach_the_recall():
    for threshold, recall in ((0.8, 0.9999), (0.6, 0.99), (0.9, 0.999)):
        bands, r = J.choose_bands(threshold, recall)
        assert 1 - (1 - threshold**r) ** bands >= recall


def test_similar_is_exact():
    rng = np.random.RandomState(0)
    sets = [np.unique(rng.randint(0, 60, rng.randint(1, 50))).astype(np.uint64) for _ in range(40)]
    got = J.similar(sets, 0.5)
    for a in range(40):
        for b in range(40):
            x, y = set(sets[a].tolist()), set(sets[b].tolist())
            assert got[a, b] == (a != b and len(x & y) >= 0.5 * len(x | y))


def test_empty_table(spark):
    assert J.join(documents(spark, [])).count() == 0
    assert J.dedup(documents(spark, [])).count() == 0


def test_digest_names_texts(spark):
    r = J.join(documents(spark, [(1, "A b", "en", "s", 3), (2, "a B", "en", "s", 3)])).collect()
    assert {x["tid"] for x in r} == {hashlib.md5(b"a b").hexdigest()}
    assert [x["class_id"] for x in r] == [1, 1]


@pytest.mark.parametrize("edges,want", [([("a", "b"), ("b", "c"), ("d", "e")], {"a": "a", "b": "a", "c": "a", "d": "d", "e": "d"}), ([(f"v{i:03}", f"v{i + 1:03}") for i in range(60)], {f"v{i:03}": "v000" for i in range(61)})])
def test_components(spark, edges, want):
    got = {r["a"]: r["root"] for r in J.connected(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == want

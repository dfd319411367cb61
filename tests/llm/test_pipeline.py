import collections

import corpus_pipeline
import public_tokenizers
from lingualake.llm import queries

from .fixtures import documents, rows

LABELS = "doc_id long, quality int, toxic int"


def staged(spark, docs, labels, folder):
    """The tables before the first and after every stage, as run() writes them."""
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{folder}/labels.parquet")
    tables = [spark.read.parquet(f"{folder}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, tables[-1], str(folder)).write.parquet(f"{folder}/after-{name}")
        tables.append(spark.read.parquet(f"{folder}/after-{name}"))
    return tables


def pairs(table):
    return sorted(((r["doc_id"], r["text"]) for r in table.select("doc_id", "text").collect()), key=repr)


def five_grams(text):
    w = (text or "").lower().encode().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def classes(texts):
    """A class of every text: equal ones in lower case, and what 0.8 or more of all five-grams joins; without words, none."""
    own = sorted({(t or "").lower() for t in texts})
    grams = {t: five_grams(t) for t in own}
    root = {t: t for t in own}

    def find(t):
        while root[t] != t:
            t = root[t]
        return t

    for i, a in enumerate(own):
        for b in own[:i]:
            x, y = grams[a], grams[b]
            if x and y and len(x & y) >= 0.8 * len(x | y):
                root[find(a)] = find(b)
    return {t: find(t) for t in own}


def without_repeats(docs, width=20):
    """The plain rule of the substring stage: words go that a window covers which starts earlier too."""
    seen, out = set(), []
    for doc_id, text in sorted(docs, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        w = (text or "").encode().split()
        gone = set()
        for i in range(len(w) - width + 1):
            key = tuple(w[i : i + width])
            gone.update(range(i, i + width) if key in seen else ())
            seen.add(key)
        out.append((doc_id, b" ".join(x for i, x in enumerate(w) if i not in gone).decode() if gone else text))
    return sorted(out, key=repr)


def targets(sizes):
    """Shares by weight, a source at a time set to three times its size, until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    left, open_, out = float(sum(sizes.values())), set(sizes), {}
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        above = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not above:
            return {**out, **share}
        for s in above:
            out[s] = 3.0 * sizes[s]
            left -= out[s]
        open_ -= above
    return out


def words(text):
    return len((text or "").encode().split())


def test_stages_match_plain_rules(spark, tmp_path):
    docs = documents(spark, clash=True)
    tables = staged(spark, docs, [(0, 1, 0), (3, 0, 1), (None, 1, 1), (6, None, None)], tmp_path)
    first, clean, single, cut, mixed, packed = tables
    assert all(t.columns == docs.columns for t in tables[:-1])
    assert pairs(clean) == pairs(first)  # two labelled rows reject nothing

    root, kept = classes([t for _, t in pairs(clean)]), pairs(single)
    assert not collections.Counter(kept) - collections.Counter(pairs(clean))
    assert collections.Counter(root[(t or "").lower()] for _, t in kept) == collections.Counter(set(root.values()))
    assert pairs(cut) == without_repeats(kept)

    sizes, taken, often = collections.Counter(), collections.Counter(), collections.Counter()
    for r in cut.select("source", "text").collect():
        sizes[r["source"]] += words(r["text"])
    for r in mixed.select("doc_id", "source", "text").collect():
        taken[r["source"]] += words(r["text"])
        often[r["doc_id"], r["text"]] += 1
    want = targets(sizes)
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes) and max(often.values()) <= 3

    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.encode_special_tokens = True
    ids = sum(len(t.encode(x or "", add_special_tokens=False).ids) + 1 for _, x in pairs(mixed))
    by = collections.defaultdict(list)
    for r in packed.collect():
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    assert sum(n for p in by.values() for _, n in p) == ids
    for p in by.values():
        assert [a for a, _ in sorted(p)] == [sum(n for _, n in sorted(p)[:i]) for i in range(len(p))] and sum(n for _, n in p) <= 4096


def test_nothing_and_only_nulls(spark, tmp_path):
    none = documents(spark).filter("false")
    (tmp_path / "none").mkdir()
    assert [t.count() for t in staged(spark, none, [], tmp_path / "none")] == [0] * 6
    nulls = documents(spark, [(None, None, None, None, None)] * 3)
    (tmp_path / "nulls").mkdir()
    got = staged(spark, nulls, [(None, None, None)], tmp_path / "nulls")
    assert [t.count() for t in got[:4]] == [3, 3, 1, 1]  # copies of one text; nothing to mix by
    assert got[5].count() == got[4].count() <= 3


def test_run_is_the_stages(spark, tmp_path):
    tables = staged(spark, documents(spark), [(0, 1, 0), (3, 0, 1)], tmp_path)
    names = ["doc_id", "start", "length", "ids_crc32"]
    own, whole = (sorted(map(repr, t.select(names).collect())) for t in (tables[-1], corpus_pipeline.run(spark, str(tmp_path))))
    assert own == whole and own


def test_queries_are_registered():
    names = queries.queries()
    assert [f"op{i}_" for i in range(1, 14)] == [f"op{i}_" for i in range(1, 14) if any(k.startswith(f"op{i}_") for k in names)]
    assert "pipeline" in names and set(queries.oracle_sql()) <= set(names)


def test_toxic_rows_go_and_clean_ones_stay(spark, tmp_path):
    import random

    rng = random.Random(7)
    plain = [f"word{k}" for k in range(300)]
    data, labels = [], []
    for i in range(400):
        toxic = i % 5 == 0
        w = [rng.choice(plain) for _ in range(30)]
        if toxic:
            for at in range(3, 30, 6):
                w[at] = rng.choice(["vileword", "nastyterm"])
        data.append((i, " ".join(w), "en", f"s{i % 3}", None))
        if i % 2 == 0:
            labels.append((i, 1, int(toxic)))
    docs = documents(spark, data)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    kept = corpus_pipeline.drop_toxic(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))
    # Unlabelled rows go and stay by the same rule.
    assert sorted(r["doc_id"] for r in kept.collect()) == [i for i in range(400) if i % 5]
    assert pairs(kept) == sorted(((i, t) for i, t, *_ in data if i % 5), key=repr)
    packed = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").distinct().collect()
    assert packed and all(r["doc_id"] % 5 for r in packed)

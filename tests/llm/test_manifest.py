import hashlib
import zlib

from lingualake.llm import merkle
from lingualake.llm.queries import op12_manifest
from pyspark.sql import functions as F

from .fixtures import SCHEMA, documents, rows


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def tree(leaves):
    """Levels of a tree, plainly."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
    return levels


def steps(levels, at):
    out = []
    for level in levels[:-1]:
        run = level[at // 8 * 8 : at // 8 * 8 + 8]
        out.append((at % 8, run[: at % 8] + run[at % 8 + 1 :]))
        at //= 8
    return out


def plain(data):
    """Rows of the manifest with tampered leaves folded, by loops over lists."""
    low = {c: c + 32 for c in range(65, 91)}
    groups = {}
    for i, text, lang, source, n in data:
        head = field(i) + field(source) + field(lang) + field(n)
        tampered = i is not None and zlib.crc32(str(i).encode()) % 3 == 0
        leaf = sha(head, field(text))
        groups.setdefault("" if lang is None else "=" + lang, []).append((-1 if i is None else i, leaf, i, sha(head, field(text.translate(low) if text is not None else None)) if tampered else leaf))
    names = sorted(groups, key=lambda x: x.encode())
    trees = {k: tree([x[1] for x in sorted(groups[k])]) for k in names}
    top = tree([trees[k][-1][0] for k in names])
    out = []
    for t, k in enumerate(names):
        for at, (_, leaf, i, h) in enumerate(sorted(groups[k])):
            path = steps(trees[k], at) + steps(top, t)
            for place, others in path:
                h = sha(*others[:place], h, *others[place:])
            out.append((i, leaf, trees[k][-1][0], top[-1][0], sha(*[x for _, o in path for x in o]), h, h == top[-1][0]))
    return out


def got(spark, tmp_path, df):
    df.write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    return sorted(map(tuple, op12_manifest(spark, str(tmp_path)).collect()), key=repr)


def test_rows_match_a_plain_tree(spark, tmp_path):
    data = [*rows(), (901, "No Lang", None, "s", 7), (902, "Ab", "", None, None), (903, None, "Ü", "s", None), *[(1000 + i, f"Text {i}", "xx", "s", i) for i in range(75)]]
    found = got(spark, tmp_path, documents(spark, data, clash=True))
    assert found == sorted(plain(data), key=repr)
    assert {r[-1] for r in found} == {True, False}


def test_many_trees_have_levels_above_them(spark, tmp_path):
    data = [(i, f"t{i}", f"l{i % 20:02}" if i % 21 else None, "s", 2) for i in range(60)]
    assert got(spark, tmp_path, spark.createDataFrame(data, SCHEMA)) == sorted(plain(data), key=repr)


def test_one_row_and_none(spark, tmp_path):
    data = [(3, "Alone", "en", "s", 5)]
    (one,) = got(spark, tmp_path, spark.createDataFrame(data, SCHEMA))
    assert one == plain(data)[0] and one[1] == one[2] == one[3] and one[4] == sha("")
    assert got(spark, tmp_path, spark.createDataFrame([], SCHEMA)) == []


def test_proofs_stand_alone(spark):
    data = [(i, f"text {i}", "en", "s", 3) for i in range(70)]
    m = merkle.manifest(spark.createDataFrame(data, SCHEMA))
    assert m.filter(merkle.folded(F.col("leaf"), F.col("proof")) != merkle.hexed(F.col("root"))).count() == 0
    assert [len(r["proof"]) for r in m.collect()] == [3] * 70
    other = merkle.digest(F.lit("something else"))
    assert m.filter(merkle.folded(other, F.col("proof")) == merkle.hexed(F.col("root"))).count() == 0

import numpy as np
import pytest

from lingualake.functions import subwords

PAD = (0, "[PAD]")


@pytest.fixture(scope="module")
def path(tmp_path_factory):
    """A word-level tokenizer with a fixed vocabulary and a begin mark; nothing is trained."""
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer(tokenizers.models.WordLevel({"[PAD]": 0, "[UNK]": 1, "[CLS]": 2, "a": 3, "b": 4, "c": 5}, unk_token="[UNK]"))
    t.pre_tokenizer = tokenizers.pre_tokenizers.Whitespace()
    t.post_processor = tokenizers.processors.TemplateProcessing(single="[CLS] $A", special_tokens=[("[CLS]", 2)])
    out = tmp_path_factory.mktemp("tokenizer") / "words.json"
    t.save(str(out))
    return str(out)


def texts(spark):
    return spark.createDataFrame([(1, "a b c a", "x"), (2, None, "y"), (3, "", "z"), (4, "c odd", "w")], "doc_id long, text string, ids string")


def rows(df):
    return {r["doc_id"]: (r["ids"], r["tokens"], r["attention"]) for r in df.collect()}


def test_ids_and_truncation(spark, path):
    got = rows(subwords.encode(texts(spark), path))
    assert got[1][0] == [2, 3, 4, 5, 3] and got[2][0] == got[3][0] == [2] and got[4][1] == ["[CLS]", "c", "[UNK]"]
    assert rows(subwords.encode(texts(spark), path, special=False))[2] == ([], [], [])
    cut = rows(subwords.encode(texts(spark), path, max_length=3))
    assert cut[1][0] == [2, 3, 4] and cut[4][0] == [2, 5, 1]
    none = texts(spark).filter("doc_id < 0")
    assert subwords.encode(none, path).count() == 0


def test_padding_goes_and_unknown_tokens_stay(spark, path):
    made = subwords.encode(texts(spark), path, max_length=4, pad=PAD)
    assert rows(made)[4] == ([2, 5, 1, 0], ["[CLS]", "c", "[UNK]", "[PAD]"], [1, 1, 1, 0])
    got = sorted((r["doc_id"], r["pos"], r["token"], r["is_unknown"]) for r in subwords.token_rows(made, pad=PAD, unknown="[UNK]").collect())
    assert got == [(1, 0, "[CLS]", False), (1, 1, "a", False), (1, 2, "b", False), (1, 3, "c", False), (2, 0, "[CLS]", False), (3, 0, "[CLS]", False), (4, 0, "[CLS]", False), (4, 1, "c", False), (4, 2, "[UNK]", True)]
    with pytest.raises(ValueError):
        subwords.encode(texts(spark), path, pad=PAD)


def test_ids_to_tokens(spark, path):
    df = spark.createDataFrame([([2, 3, 1],), ([],), (None,), ([99, -1, None],)], "ids array<int>")
    assert [r["tokens"] for r in subwords.ids_to_tokens(df, path).collect()] == [["[CLS]", "a", "[UNK]"], [], None, [None, None, None]]


def test_batch_embedders(spark, path):
    made = subwords.encode(texts(spark), path, max_length=4, pad=PAD)
    got = {(r["doc_id"], r["pos"]): r["vec"] for r in subwords.embed(made, "hash", pad=PAD).collect()}
    assert len(got) == 9 and all(len(v) == 16 for v in got.values())
    (want,) = subwords.hashed([np.array([2, 5, 1, 0])], [np.array([1, 1, 1, 0])])
    assert got[4, 1] == pytest.approx(want[1].tolist())
    assert got[1, 3] != pytest.approx(got[4, 1])  # one token in two contexts
    subwords.BATCH_EMBEDDERS["zero"] = lambda ids, attention: [np.zeros((len(x), 2)) for x in ids]
    assert subwords.embed(made, "zero").count() == 0
    with pytest.raises(ValueError):
        subwords.embed(made, "other")


def test_project_vectors(spark, path):
    from lingualake import config
    from lingualake.plans import project

    with pytest.raises(config.ConfigError):
        config.parse({"embeddings": {"tokenization_method": "other"}})
    with pytest.raises(config.ConfigError):
        config.parse({"embeddings": {"tokenization_method": "model"}})
    c = config.parse({"embeddings": {"tokenization_method": "model", "tokenizer": path, "max_length": 4}})
    toks = spark.createDataFrame([(1, 0, 0, "u", i, w) for i, w in enumerate("a b c a".split())], "doc_id long, section_idx int, utt_idx int, utt_key string, pos int, token string")
    got = project.embed(toks, c).orderBy("pos").collect()
    assert [(r["doc_id"], r["pos"], r["token"]) for r in got] == [(1, 0, "[CLS]"), (1, 1, "a"), (1, 2, "b"), (1, 3, "c")]

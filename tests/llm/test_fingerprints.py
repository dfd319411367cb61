import hashlib

from lingualake.llm import lzfingerprint as L

from .fixtures import documents, rows, texts


def naive(text):
    known, ends, w = set(), [], ""
    for i, c in enumerate(text):
        w += c
        if w not in known:
            known.add(w)
            ends.append(i + 1)
            w = ""
    return ends


def test_parse_matches_letter_by_letter():
    for t in [*texts(), "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "ab" * 30, "aab" * 9]:
        ends = naive(t)
        assert L.parse(t) == ends
        edited = t[: len(t) - len(t) // 4] + "zz top"
        common = sum(e <= len(t) - len(t) // 4 for e in ends)
        assert L.parse(edited, ends[:common]) == naive(edited)


def test_likeness_is_jaccard_for_small_sets():
    a, b = "the cat sat on the mat", "the cat sat on a mat"
    phrases = [{t[x:y] for x, y in zip([0, *naive(t)], naive(t), strict=False)} for t in (a, b)]
    got = L.likeness(*(L.hashes(t, L.parse(t)) for t in (a, b)))
    assert abs(got - len(phrases[0] & phrases[1]) / len(phrases[0] | phrases[1])) < 1e-9


def test_query_matches_a_plain_loop(spark):
    data = rows()
    docs = sorted(((-(1 << 63) if i is None else i, t or "", i) for i, t, *_ in data), key=lambda x: x[:2])
    want = []
    for k, (_, text, i) in enumerate(docs):
        following = docs[(k + 1) % len(docs)][1]
        edited = text[: len(text) - len(text) // 4] + following[: len(text) // 4]
        sign = [L.hashes(t, naive(t)) for t in (text, edited, following)]
        want.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), L.fingerprint(sign[0]), L.fingerprint(sign[1]), L.likeness(sign[0], sign[1]), L.likeness(sign[0], sign[2])))
    got = [tuple(r) for r in L.fingerprints(documents(spark, data, clash=True)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_few_and_no_rows(spark):
    assert L.fingerprints(documents(spark, [])).count() == 0
    (one,) = L.fingerprints(documents(spark, [(5, "abcdefgh", "en", "s", 8)])).collect()
    assert one["edited_sha256"] == hashlib.sha256(b"abcdefab").hexdigest() and one["near_next"] == 1.0

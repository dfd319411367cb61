"""The registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import backoff, importance, langid, licenses, lzfingerprint, merkle, mixing, mtree, ngramjoin, repair, rlz, toxicity, vecpack
from .common import shared_path, table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    lexicon = toxicity.fit(docs, labels.select("doc_id", "toxic").filter(~held_out))
    scored = toxicity.score(docs, lexicon)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_words", "n_hits")


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "pages"), langid.train(table(spark, sf_dir, "documents")))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).drop("blocks")


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lzfingerprint.fingerprints(table(spark, sf_dir, "documents"))


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return mtree.top_k(rows, rows.filter(F.col("vec_id") % 50 == 0))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "token-shards")
    repair.write(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), path)
    return repair.digest(repair.read(spark, path))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vecpack.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), with_ids=False)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rlz.spans(table(spark, sf_dir, "documents")).drop("factors")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.join(table(spark, sf_dir, "documents")).drop("tid")


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tampered = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 0
    text = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    seen = F.when(tampered, merkle.leaf(*[text if c == "text" else F.col(c) for c in merkle.FIELDS]))
    rows = merkle.manifest(docs, seen=seen)
    folded = merkle.folded(F.coalesce("seen", "leaf"), F.col("proof"))
    out = rows.select("doc_id", *[merkle.hexed(F.col(c)).alias(c) for c in ("leaf", "subroot", "root")], merkle.proof_digest(F.col("proof")).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op11_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(10)) != 0
    rows = backoff.score(table(spark, sf_dir, "documents"), train)
    return rows.withColumns({c: F.round(c, 6) for c in ("base_score", "score")})


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("n_words")


#: crc32 of a column `key` of text, as DuckDB has none: the table of 256 entries comes from its rule.
_CRC_SQL = """crc_table AS (
  SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS t FROM (SELECT unnest(range(256)) AS i)
), crcs AS (
  SELECT key, xor(list_reduce(list_transform(range(len(hex(encode(key))) // 2), lambda i: ('0x' || substr(hex(encode(key)), 2 * i + 1, 2))::BIGINT), lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1]), 4294967295), 4294967295) AS crc
  FROM (SELECT DISTINCT key FROM keys WHERE key IS NOT NULL), crc_table
)"""

OP12_SQL = f"""
WITH RECURSIVE keys AS (SELECT doc_id::VARCHAR AS key FROM documents), {_CRC_SQL}, d AS (
  SELECT doc_id, coalesce('=' || lang, '') AS tree, text, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low, coalesce(crc % 3 = 0, false) AS tampered,
    coalesce(octet_length(encode(doc_id::VARCHAR)) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-') || coalesce(octet_length(encode(lang)) || ':' || lang, '-') || coalesce(octet_length(encode(n_chars::VARCHAR)) || ':' || n_chars, '-') AS head
  FROM documents LEFT JOIN crcs ON key = doc_id::VARCHAR
), l AS (
  SELECT doc_id, tree, tampered, sha256(head || coalesce(octet_length(encode(text)) || ':' || text, '-')) AS leaf, sha256(head || coalesce(octet_length(encode(low)) || ':' || low, '-')) AS other FROM d
), p AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM l
), n AS (
  SELECT tree, 0 AS level, pos, leaf AS h, count(*) OVER (PARTITION BY tree) AS of FROM p
  UNION ALL
  SELECT tree, max(level) + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), (max(of) + 7) // 8 FROM n WHERE of > 1 GROUP BY tree, pos // 8
), tops AS (
  SELECT tree, level AS height, h, row_number() OVER (ORDER BY tree) - 1 AS pos FROM n WHERE of = 1
), f AS (
  SELECT 0 AS level, pos, h, count(*) OVER () AS of FROM tops
  UNION ALL
  SELECT max(level) + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), (max(of) + 7) // 8 FROM f WHERE of > 1 GROUP BY pos // 8
), runs AS (
  SELECT tree, level, pos // 8 AS run, list(h ORDER BY pos) AS hs FROM n WHERE of > 1 GROUP BY ALL
), tree_runs AS (
  SELECT level, pos // 8 AS run, list(h ORDER BY pos) AS hs FROM f WHERE of > 1 GROUP BY ALL
), steps AS (
  SELECT p.tree, p.pos, r.level, r.hs, (p.pos // power(8, r.level)::BIGINT % 8)::INT AS place FROM p JOIN runs r ON r.tree = p.tree AND r.run = p.pos // power(8, r.level + 1)::BIGINT
  UNION ALL
  SELECT p.tree, p.pos, t.height + r.level, r.hs, (t.pos // power(8, r.level)::BIGINT % 8)::INT FROM p JOIN tops t ON t.tree = p.tree JOIN tree_runs r ON r.run = t.pos // power(8, r.level + 1)::BIGINT
), sides AS (
  SELECT tree, pos, level, array_to_string(hs[1:place], '') AS a, array_to_string(hs[place + 2:], '') AS z FROM steps
), proofs AS (
  SELECT tree, pos, sha256(string_agg(a || z, '' ORDER BY level)) AS proof_sha256 FROM sides GROUP BY tree, pos
), up AS (
  SELECT tree, pos, 0 AS level, CASE WHEN tampered THEN other ELSE leaf END AS h FROM p
  UNION ALL
  SELECT up.tree, up.pos, up.level + 1, sha256(a || h || z) FROM up JOIN sides s ON s.tree = up.tree AND s.pos = up.pos AND s.level = up.level
), folds AS (
  SELECT tree, pos, arg_max(h, level) AS folded_root FROM up GROUP BY tree, pos
)
SELECT doc_id, leaf, tops.h AS subroot, root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM p JOIN tops ON tops.tree = p.tree LEFT JOIN proofs ON proofs.tree = p.tree AND proofs.pos = p.pos JOIN folds ON folds.tree = p.tree AND folds.pos = p.pos, (SELECT h AS root FROM f WHERE of = 1)
"""


OP11_SQL = rf"""
WITH keys AS (SELECT doc_id::VARCHAR AS key FROM documents), {_CRC_SQL}, d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(crc % 10 = 0, true) AS held_out, list_concat([' begin'], regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), [' end']) AS words
  FROM documents LEFT JOIN crcs ON key = doc_id::VARCHAR
), e AS (
  SELECT rid, doc_id, held_out, unnest(words) AS w, generate_subscripts(words, 1) - 1 AS pos FROM d
), t AS (
  SELECT *, lag(w, 1) OVER o AS v, lag(w, 2) OVER o AS u FROM e WINDOW o AS (PARTITION BY rid ORDER BY pos)
), c1 AS (
  SELECT w, count(*) AS n FROM t WHERE NOT held_out GROUP BY w
), c2 AS (
  SELECT v, w, count(*) AS n FROM t WHERE NOT held_out AND pos >= 1 GROUP BY v, w
), c3 AS (
  SELECT u, v, w, count(*) AS n FROM t WHERE NOT held_out AND pos >= 2 GROUP BY u, v, w
), z AS (
  SELECT coalesce(sum(n), 0)::DOUBLE AS total, count(*)::DOUBLE AS kinds FROM c1 WHERE w <> ' begin'
), p1 AS (
  SELECT t.*, coalesce(c1.n, 0) AS n, log10((coalesce(c1.n, 0) + 0.1) / (total + 0.1 * (kinds + 1))) AS base, CASE WHEN total = 0 THEN 1 ELSE coalesce(c1.n, kinds) / (total + kinds) END AS p, total
  FROM t LEFT JOIN c1 ON c1.w = t.w, z WHERE pos >= 1
), p2 AS (
  SELECT p1.* EXCLUDE (p), (coalesce(c2.n, 0) + {backoff.STRENGTHS[0]} * p) / (coalesce(x.n, 0) + {backoff.STRENGTHS[0]}) AS p FROM p1 LEFT JOIN c2 ON c2.v = p1.v AND c2.w = p1.w LEFT JOIN c1 x ON x.w = p1.v
), p3 AS (
  SELECT p2.* EXCLUDE (p), CASE WHEN pos >= 2 THEN (coalesce(c3.n, 0) + {backoff.STRENGTHS[1]} * p) / (coalesce(x.n, 0) + {backoff.STRENGTHS[1]}) ELSE p END AS p
  FROM p2 LEFT JOIN c3 ON c3.u = p2.u AND c3.v = p2.v AND c3.w = p2.w LEFT JOIN c2 x ON x.v = p2.u AND x.w = p2.v
)
SELECT doc_id, held_out, count(*) AS n_tokens, count(*) FILTER (WHERE n > 0) AS n_known, max(total)::BIGINT AS train_tokens, round(sum(base), 6) AS base_score, round(sum(log10(p)), 6) AS score FROM p3 GROUP BY rid, doc_id, held_out
"""

OP13_SQL = rf"""
WITH texts AS (
  SELECT row_number() OVER () AS rid, doc_id, text, true AS own FROM documents UNION ALL SELECT NULL, NULL, text, false FROM benchmark
), f AS (
  SELECT rid, doc_id, own, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM texts
), w AS (
  SELECT rid, own, unnest(words) AS key FROM f
), keys AS (SELECT key FROM w), {_CRC_SQL}, n AS (
  SELECT rid, own, crc % {importance.BUCKETS} AS bucket, count(*) AS n FROM w JOIN crcs USING (key) GROUP BY ALL
), b AS (
  SELECT bucket, coalesce(sum(n) FILTER (WHERE own), 0) AS s, coalesce(sum(n) FILTER (WHERE NOT own), 0) AS t FROM n GROUP BY bucket
), z AS (
  SELECT coalesce(sum(s), 0)::DOUBLE AS every, coalesce(sum(t), 0)::DOUBLE AS wanted FROM b
), g AS (
  SELECT bucket, floor(1000 * ln((t + 1.0::DOUBLE) * (every + {importance.BUCKETS}) / ((s + 1.0::DOUBLE) * (wanted + {importance.BUCKETS}))))::BIGINT AS gain FROM b, z
), x AS (
  SELECT rid, sum(n.n * gain)::BIGINT AS weight FROM n JOIN g USING (bucket) WHERE own GROUP BY rid
), r AS (
  SELECT f.rid, doc_id, len(words)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight, ('0x' || sha256('{importance.SEED}:' || coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT::DOUBLE AS h FROM f LEFT JOIN x ON x.rid = f.rid WHERE own
), y AS (
  SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296)))::BIGINT AS score FROM r
), k AS (
  SELECT *, n_features >= {importance.LEAST_WORDS} AS fit, row_number() OVER (PARTITION BY n_features >= {importance.LEAST_WORDS} ORDER BY score DESC, doc_id NULLS LAST) AS place, count(*) OVER (PARTITION BY n_features >= {importance.LEAST_WORDS}) AS of FROM y
)
SELECT doc_id, n_features, weight, score, CASE WHEN fit AND place <= {importance.PERCENT} * of // 100 THEN place END AS rank FROM k
"""


def _op3_sql() -> str:
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    words = lambda x: "[" + ", ".join(quote(w) for w in sorted(set(licenses.words_of(x)))) + "]"
    templates = ", ".join(f"({words(t)}, {quote(label)})" for t, label in licenses.TEMPLATES.items())
    phrases = ", ".join("([" + ", ".join(map(quote, p.split())) + f"], {quote(label)})" for p, label in licenses.BASE.items())
    split = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), w AS (SELECT doc_id, text, {split.format("text")} AS words FROM d),
phrases(words, label) AS (VALUES {phrases}), templates(words, label) AS (VALUES {templates}),
b AS (
  SELECT w.doc_id, p.label, unnest(list_filter(range(0, len(w.words) - len(p.words) + 1), lambda i: w.words[i + 1:i + len(p.words)] = p.words)) AS place FROM w, phrases p WHERE len(w.words) >= len(p.words)
), bs AS (
  SELECT doc_id, count(*) AS n, min(place) AS first, max(place) AS last, list_sort(list_distinct(list(label))) AS labels FROM b GROUP BY doc_id
), l AS (
  SELECT doc_id, list_distinct({split.format("line")}) AS words FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)
), m AS (
  SELECT doc_id, label, len(list_intersect(l.words, t.words)) / len(t.words)::DOUBLE AS share FROM l, templates t WHERE len(list_intersect(l.words, t.words)) * 10 >= 8 * len(t.words)
), ms AS (
  SELECT doc_id, list(DISTINCT label) AS labels, max(share) AS share FROM m GROUP BY doc_id
)
SELECT w.doc_id, len(w.words)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, first::BIGINT AS first_word, last::BIGINT AS last_word, coalesce(array_to_string(bs.labels, ','), '') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(bs.labels, []), coalesce(ms.labels, [])))), ',') AS labels, greatest(CASE WHEN n > 0 THEN 1.0 ELSE 0.0 END, coalesce(share, 0.0))::DOUBLE AS score
FROM w LEFT JOIN bs ON bs.doc_id = w.doc_id LEFT JOIN ms ON ms.doc_id = w.doc_id
"""


OP5_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS words FROM documents
), w AS (
  SELECT doc_id, unnest(range(0, greatest(len(words) - 19, 0))) AS pos, words FROM d
), k AS (
  SELECT doc_id, pos, row_number() OVER (PARTITION BY list_aggregate(words[pos + 1:pos + 20], 'string_agg', ' ') ORDER BY doc_id, pos) > 1 AS again FROM w
), g AS (
  SELECT doc_id, list(pos) AS starts FROM k WHERE again GROUP BY doc_id
), r AS (
  SELECT doc_id, list_distinct(flatten(list_transform(starts, lambda a: range(a, a + 20)))) AS gone FROM g
), u AS (
  SELECT doc_id, words, coalesce(gone, []) AS gone FROM d LEFT JOIN r USING (doc_id)
), p AS (
  SELECT doc_id, unnest(words) AS word, unnest(range(0, len(words))) AS pos FROM u
), q AS (
  SELECT p.doc_id, string_agg(word, ' ' ORDER BY p.pos) AS kept, count(*) AS n FROM p LEFT JOIN (SELECT doc_id, unnest(gone) AS pos FROM r) x ON x.doc_id = p.doc_id AND x.pos = p.pos
  WHERE x.pos IS NULL GROUP BY p.doc_id
)
SELECT d.doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN q ON q.doc_id = d.doc_id
"""

OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5('0:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS place
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), r AS (
  SELECT *, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight, row_number() OVER (ORDER BY source NULLS LAST) AS k FROM s
), f AS (
  SELECT *, sum(source_size) OVER () AS budget,
    coalesce(sum(3 * source_size) OVER (ORDER BY source_size * 1.0::DOUBLE / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used,
    sum(weight) OVER (ORDER BY source_size * 1.0::DOUBLE / weight, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight
  FROM r
), g AS (
  SELECT *, bool_and(3 * source_size * open_weight <= (budget - used) * weight) OVER (ORDER BY source_size * 1.0::DOUBLE / weight, k ROWS UNBOUNDED PRECEDING) AS capped FROM f
), t AS (
  SELECT source, source_size, CASE WHEN capped THEN (3 * source_size)::DOUBLE ELSE (weight * (budget - 3 * coalesce((SELECT sum(source_size) FROM g WHERE capped), 0)))::DOUBLE / (SELECT sum(weight) FROM g WHERE NOT capped)::DOUBLE END AS target
  FROM g
), u AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM t
), w AS (
  SELECT *, floor(target + 0.5)::BIGINT - whole * source_size AS part FROM u
), x AS (
  SELECT doc_id, size, source_size, target, whole, part,
    coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY place, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS at_word
  FROM d JOIN w ON d.source IS NOT DISTINCT FROM w.source
)
SELECT doc_id, size, source_size, target, (size * whole + greatest(0, least(size, part - at_word)))::BIGINT AS taken FROM x
"""


OP10_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, lower(coalesce(text, '')) AS text FROM documents
), t AS (
  SELECT text, min(doc_id) AS text_id, count(*) AS copies FROM d GROUP BY text
), w AS (
  SELECT text_id, copies, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM t
), g AS (
  SELECT DISTINCT text_id, list_aggregate(words[pos + 1:pos + least(5, len(words))], 'string_agg', ' ') AS gram FROM (SELECT text_id, words, unnest(range(0, greatest(len(words) - 4, least(len(words), 1)))) AS pos FROM w)
), n AS (
  SELECT text_id, count(*) AS size FROM g GROUP BY text_id
), p AS (
  SELECT a.text_id AS a, b.text_id AS b, count(*) AS shared FROM g a JOIN g b ON a.gram = b.gram AND a.text_id <> b.text_id GROUP BY ALL
), links AS (
  SELECT a, b FROM p JOIN n x ON x.text_id = a JOIN n y ON y.text_id = b WHERE shared * 10 >= 8 * (x.size + y.size - shared)
), reach(a, b) AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
), c AS (
  SELECT a AS text_id, least(a, min(b)) AS class_id FROM reach GROUP BY a
), k AS (
  SELECT l.a AS text_id, count(*) AS texts, sum(t.copies) AS docs FROM links l JOIN t ON t.text_id = l.b GROUP BY l.a
)
SELECT d.doc_id, t.text_id, coalesce(class_id, t.text_id) AS class_id, (coalesce(docs, 0) + copies - 1)::BIGINT AS n_links, coalesce(texts, 0)::BIGINT AS n_text_links
FROM d JOIN t ON t.text = d.text LEFT JOIN c ON c.text_id = t.text_id LEFT JOIN k ON k.text_id = t.text_id
"""


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_toxicity": op1_toxicity, "op2_language": op2_language, "op3_licenses": op3_licenses, "op4_fingerprints": op4_fingerprints, "op5_topk": op5_topk, "op6_token_files": op6_token_files, "op7_packing": op7_packing, "op8_substring_dedup": op8_substring_dedup, "op9_mixing": op9_mixing, "op10_ngram_join": op10_ngram_join, "op11_backoff": op11_backoff, "op12_manifest": op12_manifest, "op13_importance": op13_importance, "pipeline": pipeline}


def oracle_sql() -> dict[str, str]:
    return {"op3_licenses": _op3_sql(), "op5_topk": OP5_SQL, "op8_substring_dedup": OP8_SQL, "op9_mixing": OP9_SQL, "op10_ngram_join": OP10_SQL, "op11_backoff": OP11_SQL, "op12_manifest": OP12_SQL, "op13_importance": OP13_SQL}

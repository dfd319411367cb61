"""A Merkle manifest of a table: leaves, a tree for each group, a root over the trees, and a proof for each row.

Built bottom-up and proved top-down. Every level is a written table of nodes: runs of `FANOUT` consecutive nodes of a tree
become one node of the next level, which keeps its children's digests, until a tree has one node. The trees' roots, in
the order of their names, are the leaves of one more tree. Then the proofs come down: the children of a level join their
parents, and each child puts its siblings before the proof that the parent inherited. What is joined is a row for each
parent, so the long proofs travel for one node in eight, and no task sees more of a tree than its sorted share.

Digests are SHA-256 over hex text, kept as 32 bytes. A step of a proof is the child's place in its run and the digests of
the others, left to right.

Edge cases: a null field is `-`, others are their bytes' number, a colon and the value; a null tree name is a tree of its
own, before all others; null keys come first, rows with one key stand by their digests, repeated rows are leaves each; a
run of one node has a step without siblings; a lone leaf is its tree's root; an empty table has no rows. Extra columns
are no part of a leaf.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import numbered, written

FANOUT, BYTES = 8, 32

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def hexed(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def digest(text: Column) -> Column:
    """SHA-256 of a text or of bytes, as 32 bytes."""
    return F.unhex(F.sha2(text.cast("binary"), 256))


def leaf(*fields: Column) -> Column:
    """The digest of a row's fields."""
    def part(c: Column) -> Column:
        value = c.cast("string")
        return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))

    return digest(F.concat(*map(part, fields)))


def grow(nodes: DataFrame) -> list[DataFrame]:
    """Levels of trees from their leaves (tree, at, of, digest, ...) to a level where every tree has one node."""
    levels = [nodes]
    wide = nodes.agg(F.max("of")).first()[0] or 1
    while wide > 1:
        kids = F.aggregate(F.array_sort(F.collect_list(F.struct("at", "digest"))), F.lit(b""), lambda a, x: F.concat(a, x["digest"]))
        up = levels[-1].filter("of > 1").groupBy("tree", F.expr(f"at div {FANOUT}").alias("parent")).agg(F.expr(f"(max(of) + {FANOUT - 1}) div {FANOUT}").alias("of"), kids.alias("kids"))
        levels.append(written(up.select("tree", F.col("parent").alias("at"), "of", digest(hexed(F.col("kids"))).alias("digest"), "kids"), "manifest-level"))
        wide = -(-wide // FANOUT)
    return levels


def push(levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """The leaves of levels with what their tree's top has (tops: tree, proof, more columns), the proof longer by their own steps."""
    more = [c for c in tops.columns if c not in ("tree", "proof")]
    below = None
    for k, level in reversed(list(enumerate(levels))):
        own = [F.col(f"c.{c}") for c in level.columns]
        down = level.filter("of = 1").alias("c").join(tops.alias("t"), F.col("c.tree") == F.col("t.tree")).select(*own, F.col("t.proof").alias("proof"), *[F.col(f"t.{c}") for c in more])
        if below is not None:
            place = F.col("c.at") % FANOUT
            kids = F.col("p.kids")
            others = F.concat(F.substring(kids, F.lit(1), (place * BYTES).cast("int")), F.substring(kids, ((place + 1) * BYTES + 1).cast("int"), F.lit(FANOUT * BYTES)))
            step = F.struct(place.cast("int").alias("place"), others.alias("siblings"))
            met = level.filter("of > 1").alias("c").join(below.alias("p"), (F.col("c.tree") == F.col("p.tree")) & (F.expr(f"c.at div {FANOUT}") == F.col("p.at")))
            down = down.unionByName(met.select(*own, F.concat(F.array(step), F.col("p.proof")).alias("proof"), *[F.col(f"p.{c}") for c in more]))
        below = written(down.drop("digest"), "manifest-proofs") if k else down
    return below


PROOF = "array<struct<place: int, siblings: binary>>"


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, tree: str = "lang", key: str = "doc_id", **carried: Column) -> DataFrame:
    """docs to key, leaf, subroot, root (bytes), proof, and further columns of the row by name."""
    name = F.when(F.col(tree).isNull(), "").otherwise(F.concat(F.lit("="), F.col(tree).cast("string")))
    own = {f"_{c}": v for c, v in carried.items()}
    rows = written(docs.select(name.alias("tree"), F.col(key).alias("key"), leaf(*[F.col(c) for c in fields]).alias("digest"), *[v.alias(c) for c, v in own.items()]), "manifest-leaves")
    levels = grow(numbered(rows, "tree", [F.col("key").asc_nulls_first(), F.col("digest")]))
    roots = levels[0].filter("of = 1").select("tree", "digest")
    for level in levels[1:]:
        roots = roots.unionByName(level.filter("of = 1").select("tree", "digest"))
    forest = numbered(roots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest"), "tree", [F.col("name")])
    above = grow(forest)
    root = above[-1].filter("of = 1").select("tree", F.array().cast(PROOF).alias("proof"), F.col("digest").alias("root"))
    tops = written(push(above, root).select(F.col("name").alias("tree"), "proof", F.col("digest").alias("subroot"), "root"), "manifest-tops")
    return push(levels, tops).select(F.col("key").alias(key), F.col("digest").alias("leaf"), "subroot", "root", "proof", *[F.col(c).alias(c[1:]) for c in own])


def folded(leaf: Column, proof: Column) -> Column:
    """The root (hex) that a leaf's digest and a proof lead to."""
    def up(h: Column, step: Column) -> Column:
        left = F.substring(step["siblings"], F.lit(1), step["place"] * BYTES)
        right = F.substring(step["siblings"], step["place"] * BYTES + 1, F.lit(FANOUT * BYTES))
        return F.sha2(F.concat(hexed(left), h, hexed(right)).cast("binary"), 256)

    return F.aggregate(proof, hexed(leaf), up)


def proof_digest(proof: Column) -> Column:
    """SHA-256 (hex) of all digests of a proof, from the leaf's siblings up."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: hexed(s["siblings"])), "").cast("binary"), 256)

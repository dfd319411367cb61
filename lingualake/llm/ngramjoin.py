"""N-gram Jaccard join: MinHash banding finds candidates, full n-gram sets decide.

Texts are lower-cased and cut at ASCII white space; a text's n-grams are its runs of `n` words (one
run of all words for shorter texts). Copies of one text form one vertex at the start, so they are
never paired. Bands and rows are chosen for a target recall at the threshold. The signatures meet on
band hashes; texts that share one are joined into candidate groups by connected components, so
nothing is emitted for each pair of a bucket. Each group's n-gram sets then meet once, in blocks
against blocks for large groups, and the exact similarity of all pairs comes from products of
0/1 matrices. A task gives each text its number of links and one edge of a spanning forest; classes
are the connected components of the verified links.

Edge cases: null texts count as empty; texts without words are copies of equal texts and have no
other links (an empty text and one of spaces are two); rows equal in id and text are copies; rows
with one id and different texts are different documents; null ids take part and come first; an empty
table gives an empty result; dedup() keeps all columns whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, bounded_batches, discard, given_back, groups, mix64, rolling, written

N, THRESHOLD, RECALL = 5, 0.8, 0.9999

#: Texts and n-grams of a block in verification: a group of g blocks takes g^2 / 2 steps of two blocks each.
BLOCK, BLOCK_GRAMS = 512, 1 << 21

#: n-grams that are compared at once.
SLICE = 1 << 19


def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL, noise: float = 0.05) -> tuple[int, int]:
    """Bands and rows: the most rows, up to 8, for which few bands reach the recall at the threshold and
    pairs of a quarter of the threshold become candidates with a chance below `noise` where possible."""
    fitting = []
    for rows in range(1, 9):
        bands = int(np.ceil(np.log(1 - recall) / np.log(1 - threshold**rows)))
        fitting.append((1 - (1 - (threshold / 4) ** rows) ** bands >= noise, bands * rows, bands, rows))
    return min(fitting)[2:]


class Signatures:
    """Band hashes of n-gram sets."""

    def __init__(self, bands: int, rows: int, seed: int = 1):
        rng = np.random.RandomState(seed)
        draw = lambda: mix64(rng.randint(0, 1 << 31, bands * rows).astype(np.uint64) ^ (rng.randint(0, 1 << 31, bands * rows).astype(np.uint64) << np.uint64(31)))
        self.a, self.b = draw() | np.uint64(1), draw()
        self.bands, self.rows = bands, rows

    def of(self, grams: np.ndarray) -> np.ndarray:
        if not len(grams):
            return np.empty(0, np.int64)
        least = np.full(len(self.a), np.iinfo(np.uint64).max, np.uint64)
        for x in range(0, len(grams), 2048):
            part = grams[x : x + 2048]
            least = np.minimum(least, (self.a[:, None] * part[None, :] + self.b[:, None]).min(axis=1))
        table = least.reshape(self.bands, self.rows)
        out = mix64(np.arange(self.bands, dtype=np.uint64))
        for r in range(self.rows):
            out = mix64(out ^ table[:, r])
        return out.view(np.int64)


def grams_of(text: str, words: WordHashes, n: int = N) -> np.ndarray:
    """Distinct n-gram hashes of a lower-cased text, ascending."""
    h = words.of(text.encode().split())
    return np.unique(rolling(h, min(n, len(h)))) if len(h) else h


def connected(edges: DataFrame, name: str = "components") -> DataFrame:
    """Edges (a, b) of strings to (a, root): each vertex of an edge with the least of its component.

    Alternating large and small stars: every round sends each vertex's larger neighbours to its
    least one, then its smaller ones, until nothing changes; all neighbours are never in one row.
    """
    e = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    state = None
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.greatest("b", "m").alias("x"), F.col("m").alias("y"), "a")
        small = small.select("x", "y").unionByName(small.select(F.col("a").alias("x"), "y")).filter("x <> y").distinct()
        e, last = written(small.select(F.col("x").alias("a"), F.col("y").alias("b")), name), e
        discard(last)
        now = tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())
        if now == state:
            break
        state = now
    stars = e.select("a", F.col("b").alias("root"))
    return stars.unionByName(e.select(F.col("b").alias("a"), F.col("b").alias("root"))).distinct()


def _signed(n: int, bands: int, rows: int):
    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, words = Signatures(bands, rows), WordHashes()
        for b in batches:
            found, size = [], []
            for t in b.column("text"):
                grams = grams_of(t.as_py(), words, n)
                found.append(make.of(grams))
                size.append(len(grams))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("tid"), pa.array(found, pa.list_(pa.int64())), pa.array(size, pa.int64())], ["doc_id", "tid", "bands", "grams"])

    return signed


def _sets(n: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for b in batches:
            found = [grams_of(t, words, n).tobytes() for t in b.column("text").to_pylist()]
            at = b.schema.get_field_index("text")
            yield b.set_column(at, "text", pa.array(found, pa.binary()))

    return sets


def similar(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which pairs of ascending sets reach the threshold, as a symmetric matrix without its diagonal.

    The values are dealt into slices, so that what is worked on at once is about SLICE values however long the sets are.
    """
    size = np.array([len(s) for s in sets])
    both = np.zeros((len(sets), len(sets)), np.float32)
    slices = -(-int(size.sum()) // SLICE)
    edges = [int(k * 2**64 // slices) for k in range(1, slices)]
    ends = np.array([np.searchsorted(s, np.array(edges, np.uint64)) for s in sets], np.int64).reshape(len(sets), -1)
    ends = np.column_stack((np.zeros(len(sets), np.int64), ends, size))
    for k in range(slices):
        owner = np.repeat(np.arange(len(sets)), ends[:, k + 1] - ends[:, k])
        value, column = np.unique(np.concatenate([s[a:b] for s, a, b in zip(sets, ends[:, k], ends[:, k + 1], strict=True)]), return_inverse=True)
        shared = np.bincount(column, minlength=len(value)) > 1
        number = np.cumsum(shared) - 1
        keep = shared[column]
        owner, column = owner[keep], number[column[keep]]
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        step, n = 1024, int(shared.sum())
        for x in range(0, n, step):
            a, b = np.searchsorted(column, (x, x + step))
            m = np.zeros((len(sets), min(step, n - x)), np.float32)
            m[owner[a:b], column[a:b] - x] = 1
            both += m @ m.T  # whole numbers below 2**24 are exact
    union = size[:, None] + size[None, :] - both
    out = both >= threshold * union - 1e-6
    np.fill_diagonal(out, False)
    return out


def _verified(threshold: float):
    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each text and task that has links: their number in documents and in texts, and the least text of its tree."""
        for (_, i, j), t in groups(batches, "comp", "i", "j"):
            tids, copies, block = t.column("tid").to_pylist(), np.array(t.column("copies").to_pylist()), np.array(t.column("block").to_pylist())
            link = similar([np.frombuffer(x.as_buffer(), np.uint64) for x in t.column("text")], threshold)
            if i != j:
                link &= block[:, None] != block[None, :]
            root = list(range(len(tids)))

            def find(x: int) -> int:
                while root[x] != x:
                    root[x] = root[root[x]]
                    x = root[x]
                return x

            for x in range(len(tids)):
                for y in np.flatnonzero(link[x, :x]):
                    p, q = find(x), find(int(y))
                    if p != q:
                        root[max(p, q)] = min(p, q)
            have = np.flatnonzero(link.any(axis=1))
            if len(have):
                parents = [tids[find(int(x))] for x in have]
                docs, texts = link @ copies, link.sum(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array([tids[x] for x in have]), pa.array(parents), pa.array(docs[have], pa.int64()), pa.array(texts[have], pa.int64())], ["tid", "parent", "docs", "texts"])

    return verified


def _joined(docs: DataFrame, n: int, threshold: float, recall: float) -> DataFrame:
    """What join() gives, and root: the least tid of the class, which names it whatever the ids."""
    spark = docs.sparkSession
    bounded_batches(spark)
    bands, rows = choose_bands(threshold, recall)
    text = F.lower(F.coalesce("text", F.lit("")))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.md5(text.cast("binary")).alias("tid"))
    signed = written(base.mapInArrow(given_back(_signed(n, bands, rows)), "doc_id long, tid string, bands array<long>, grams long"), "signatures")
    # A vertex for each text; copies are folded here, before anything is paired.
    texts = written(signed.groupBy("tid").agg(F.min("doc_id").alias("text_id"), F.count(F.lit(1)).alias("copies"), F.any_value("bands").alias("bands"), F.max("grams").alias("grams")), "texts")
    held = texts.select("tid", F.explode("bands").alias("band"))
    met = held.groupBy("band").agg(F.min("tid").alias("b"), F.count(F.lit(1)).alias("k")).filter("k > 1").select("band", "b")
    candidates = connected(held.join(met, "band").select(F.col("tid").alias("a"), "b"), "candidates")
    member = candidates.join(texts.select(F.col("tid").alias("a"), "text_id", "copies", "grams"), "a")
    member = member.join(member.groupBy("root").agg(F.count(F.lit(1)).alias("size"), F.sum("grams").alias("grams_in_all")), "root")
    nb = F.greatest(F.ceil(F.col("size") / BLOCK), F.ceil(F.col("grams_in_all") / BLOCK_GRAMS)).cast("int")
    member = member.select(F.col("a").alias("tid"), "text_id", "copies", F.col("root").alias("comp"), nb.alias("nb"), F.pmod(F.xxhash64("a"), nb).cast("int").alias("block"))
    # The n-grams of the texts that are in a group, read from their first document.
    full = base.join(member, (base.doc_id.eqNullSafe(member.text_id)) & (base.tid == member.tid)).select(member.tid, "comp", "copies", "nb", "block", "text")
    full = full.dropDuplicates(["tid"]) if _repeated(signed) else full
    pairs = F.transform(F.sequence(F.lit(0), F.col("nb") - 1), lambda o: F.struct(F.least("block", o).alias("i"), F.greatest("block", o).alias("j")))
    full = full.mapInArrow(given_back(_sets(n)), "tid string, comp string, copies long, nb int, block int, text binary")
    full = full.withColumn("pair", F.explode(pairs)).select("comp", "pair.i", "pair.j", "tid", "copies", "block", "text")
    k = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    links = written(full.repartition(k, "comp", "i", "j").sortWithinPartitions("comp", "i", "j", "tid").mapInArrow(given_back(_verified(threshold)), "tid string, parent string, docs long, texts long"), "links")
    root = connected(links.select(F.col("tid").alias("a"), F.col("parent").alias("b")), "classes").withColumnRenamed("a", "tid")
    total = links.groupBy("tid").agg(F.sum("docs").alias("docs"), F.sum("texts").alias("links"))
    info = texts.select("tid", "text_id", "copies").join(total, "tid", "left").join(root, "tid", "left")
    info = info.withColumn("root", F.coalesce("root", "tid"))
    first = info.filter("links IS NOT NULL").groupBy("root").agg(F.min("text_id").alias("class_id"), F.max(F.col("text_id").isNull()).alias("no_id"))
    info = info.join(first, "root", "left")
    class_id = F.when(F.col("no_id"), F.lit(None)).otherwise(F.coalesce("class_id", "text_id"))
    info = info.select("tid", "root", "text_id", class_id.alias("class_id"), (F.coalesce("docs", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("links", F.lit(0)).alias("n_text_links"))
    return signed.select("doc_id", "tid").join(info, "tid").select("doc_id", "tid", "text_id", "class_id", "n_links", "n_text_links", "root")


def join(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """docs (doc_id, text) to a row for each: doc_id, tid (digest of its text), text_id (least id with that text),
    class_id (least id of its class), n_links (other documents that are similar, copies too) and n_text_links (other texts)."""
    return _joined(docs, n, threshold, recall).drop("root")


def _repeated(signed: DataFrame) -> bool:
    """Whether an id and text stand in more than one row."""
    return bool(signed.groupBy("doc_id", "tid").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").limit(1).count())


def dedup(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """docs with one document of each class: that of the least id (null first), and of its texts the least digest; columns
    unchanged. Classes are told apart by their root, as ids may be null or repeat."""
    found = written(_joined(docs, n, threshold, recall).select("doc_id", "tid", "root"), "near")
    keep = found.groupBy("root").agg(F.min(F.struct("doc_id", "tid")).alias("x")).select(F.col("x.doc_id").alias("_id"), F.col("x.tid").alias("_tid"))
    names = docs.columns
    digest = F.md5(F.lower(F.coalesce("text", F.lit(""))).cast("binary"))
    rows = docs.select(F.struct(*names).alias("_row"), F.col("doc_id").cast("long").alias("_doc_id"), digest.alias("_digest"))
    kept = rows.join(keep, F.col("_doc_id").eqNullSafe(F.col("_id")) & (F.col("_digest") == F.col("_tid")), "left_semi")
    kept = kept.dropDuplicates(["_doc_id", "_digest"]) if _repeated(found) else kept
    return kept.select("_row.*")

"""Words to times from frame emissions, and speakers of speech segments from their vectors.

Emissions are log probabilities of characters by frame, as acoustic models with a blank give them; where they come from is
a provider's business.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..functions import vectors as V
from ..session import dropped, stored


def align(emissions: np.ndarray, tokens: list[int], blank: int = 0) -> list[tuple[int, int]] | None:
    """First and last frame (excluded) of each token on the best path through frames x labels of log probabilities.

    A path stays on a token or a blank, or goes on to the next; between two equal tokens there must be a blank. None if
    there are too few frames. Ties stay where they are.
    """
    states = np.full(2 * len(tokens) + 1, blank)
    states[1::2] = tokens
    skips = np.zeros(len(states), bool)
    skips[3::2] = states[3::2] != states[1:-2:2]
    score = np.full(len(states), -np.inf)
    score[:2] = emissions[0, states[:2]] if len(emissions) else -np.inf
    moves = np.zeros((len(emissions), len(states)), np.int8)
    for i in range(1, len(emissions)):
        ways = np.full((3, len(states)), -np.inf)
        ways[0] = score
        ways[1, 1:] = score[:-1]
        ways[2, 2:] = np.where(skips[2:], score[:-2], -np.inf)
        moves[i] = ways.argmax(axis=0)
        score = ways.max(axis=0) + emissions[i, states]
    ends = [k for k in (len(states) - 1, len(states) - 2) if k >= 0]
    at = max(ends, key=lambda k: (score[k], k))
    if not len(emissions) or score[at] == -np.inf:
        return None
    first, last = [0] * len(tokens), [0] * len(tokens)
    for i in range(len(emissions) - 1, -1, -1):
        if at % 2:
            k = at // 2
            first[k] = i
            last[k] = max(last[k], i + 1)
        at -= int(moves[i, at])
    return list(zip(first, last, strict=True))


def word_times(emissions: DataFrame, transcripts: DataFrame, key: str, labels: str, seconds: float, blank: int = 0) -> DataFrame:
    """emissions (key, frame, scores: one for each of `labels`) and transcripts (key, transcript[, start_time]) to key, word_idx, word, start_time, end_time.

    Words are those of the romanised text, without characters that no label stands for; a frame lasts `seconds`. A key
    (a chunk of a recording) without emissions, words or a path has no rows, so that a caller can fall back.
    """
    base = F.coalesce(F.col("start_time"), F.lit(0.0)) if "start_time" in transcripts.columns else F.lit(0.0)
    words = transcripts.select(key, base.cast("double").alias("base"), T.words(T.alignment_text("transcript")).alias("words"))
    kind = f"{key} {words.schema[key].dataType.simpleString()}"
    place = {c: i for i, c in enumerate(labels) if i != blank}

    def aligned(group: tuple, frames: pa.Table, given: pa.Table) -> pa.Table:
        out: list[list] = [[] for _ in range(4)]
        if len(frames) and len(given):
            frames = frames.sort_by("frame")
            scores = np.array(frames.column("scores").to_pylist(), float)
            start = given.column("base")[0].as_py()
            spelled = [(w, [place[c] for c in w if c in place]) for w in given.column("words")[0].as_py() or []]
            spelled = [(w, t) for w, t in spelled if t]
            spans = align(scores, [x for _, t in spelled for x in t], blank) if spelled else None
            if spans:
                at = 0
                for k, (w, t) in enumerate(spelled):
                    for column, x in zip(out, (k, w, start + spans[at][0] * seconds, start + spans[at + len(t) - 1][1] * seconds), strict=True):
                        column.append(x)
                    at += len(t)
        keys = pa.array([group[0].as_py()] * len(out[0]), given.schema.field(key).type)
        return pa.table([keys, pa.array(out[0], pa.int32()), pa.array(out[1], pa.string()), pa.array(out[2], pa.float64()), pa.array(out[3], pa.float64())], names=[key, "word_idx", "word", "start_time", "end_time"])

    left = emissions.select(key, F.col("frame").cast("long").alias("frame"), F.transform("scores", lambda x: x.cast("double")).alias("scores"))
    return left.groupBy(key).cogroup(words.groupBy(key)).applyInArrow(aligned, f"{kind}, word_idx int, word string, start_time double, end_time double")


def with_fallback(best: DataFrame, *others: DataFrame, key: str) -> DataFrame:
    """The rows of the first table that has any for a key: alignments, then recognised words, then uniform times."""
    columns = best.columns
    for other in others:
        best = best.unionByName(other.select(*columns).join(best.select(key).distinct(), key, "left_anti"))
    return best


#: Segments of a recording above which many tasks look for the nearest, and clusters of a side of what one task gets.
CELL = 8192

#: Queries and candidates of which all distances are held at once.
TILE = (256, 1024)


def unit_vectors(vectors: np.ndarray) -> np.ndarray:
    size = np.sqrt((vectors * vectors).sum(axis=1))
    return vectors / np.where(size > 0, size, 1.0)[:, None]


def nearest(queries: np.ndarray, own: np.ndarray, means: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and distance of the nearest of the clusters with these mean unit vectors, for each query; the first of equal ones.

    The mean cosine distance of two clusters is 1 less the product of their means, so tiles of distances are made and dropped.
    own: a query's own index, or -1. base: 1, or inf for a cluster that is no candidate. Without candidates index and distance are 0 and inf.
    """
    near, far = np.zeros(len(queries), np.int64), np.full(len(queries), np.inf)
    for i in range(0, len(queries), TILE[0]):
        some = slice(i, i + TILE[0])
        for j in range(0, len(means), TILE[1]):
            tile = queries[some] @ means[j : j + TILE[1]].T
            np.subtract(base[j : j + TILE[1]], tile, out=tile)
            at = own[some] - j
            inside = np.flatnonzero((at >= 0) & (at < tile.shape[1]))
            tile[inside, at[inside]] = np.inf
            least = np.round(tile.min(axis=1), 12) + 0.0  # equal distances are equal
            closer = np.flatnonzero(least < far[some])
            far[i + closer] = least[closer]
            near[i + closer] = j + (np.round(tile[closer], 12) == least[closer, None]).argmax(axis=1)
    return near, far


def merged(sums: np.ndarray, count: np.ndarray, near: np.ndarray, far: np.ndarray, threshold: float | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The merges of clusters by average linkage, as (first, second, distance); the merged cluster stands at the first one.

    Clusters are sums of unit vectors and numbers of members, in the order of their first members; near (-1: not known) and far
    say which is the nearest. Two that are each other's nearest merge, as no later merge brings anything nearer to them (average linkage is
    reducible, ties by first members included). A cluster whose nearest has merged is searched anew once another waits for
    it. Memory grows with the clusters, not with their pairs.
    """
    ids, near, far = np.arange(len(sums)), near.copy(), far.copy()
    sums, count = sums.copy(), count.astype(float)
    means, base = sums / count[:, None], np.ones(len(sums))
    fresh = np.ones(len(sums), bool)
    out: list[tuple] = []
    left = len(sums)

    def search(which: np.ndarray) -> None:
        near[which], far[which] = nearest(means[which], which, means, base)

    while left > 1:
        alive = base == 1
        known = alive & (near >= 0)
        want = fresh.copy()
        want[near[known]] = True
        want &= alive & ~known
        fresh[:] = False
        asked = np.flatnonzero(want)
        search(asked)
        known |= want
        a = np.flatnonzero(known)
        a = a[(a < near[a]) & (near[near[a]] == a)]
        if threshold is not None:
            a = a[far[a] <= threshold]
        if not len(a):
            if len(asked):
                continue
            asked = np.flatnonzero(alive & ~known)
            if len(asked):
                search(asked)
                continue
            k = int(np.where(alive, far, np.inf).argmin())
            if threshold is not None and far[k] > threshold:
                break
            a = np.array([min(k, near[k])])  # three or more are as near to each other as numbers can tell
            b = np.array([max(k, near[k])])
            far[a] = far[k]
        else:
            b = near[a]
        out.append((ids[a], ids[b], far[a]))
        sums[a] += sums[b]
        count[a] += count[b]
        means[a] = sums[a] / count[a][:, None]
        base[b] = np.inf
        gone = np.zeros(len(ids), bool)
        gone[a] = gone[b] = True
        near[gone | ((near >= 0) & gone[near])] = -1
        fresh[a] = True
        left -= len(a)
        if left < 0.75 * len(ids):
            keep = base == 1
            place = np.append(np.cumsum(keep) - 1, -1)
            ids, near, far, sums, count, means, base, fresh = ids[keep], place[near[keep]], far[keep], sums[keep], count[keep], means[keep], base[keep], fresh[keep]
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))


def cut(n: int, first: np.ndarray, second: np.ndarray, far: np.ndarray, clusters: int, threshold: float | None = None) -> np.ndarray:
    """Clusters of n items when the nearest of these merges are done, down to `clusters` or up to `threshold`; numbered by first member."""
    order = np.lexsort((second, first, far))[: max(0, n - max(1, clusters))]
    if threshold is not None:
        order = order[far[order] <= threshold]
    into = np.arange(n)
    into[second[order]] = first[order]
    of = into.tolist()
    for i, k in enumerate(of):  # a cluster's first member stands before
        of[i] = of[k]
    return np.unique(of, return_inverse=True)[1]


def linked(vectors: np.ndarray, clusters: int, threshold: float | None = None) -> np.ndarray:
    """Clusters of vectors by average linkage of cosine distances, merged down to `clusters`, or while the least distance is at most
    `threshold`. Numbered by first member; of equal distances the pair with the earliest members merges. Nothing merges if a number isn't finite.
    """
    n = len(vectors)
    unit = unit_vectors(vectors)
    if not n or not np.isfinite(unit).all():
        return np.arange(n)
    _, at, of, count = np.unique(unit, axis=0, return_index=True, return_inverse=True, return_counts=True)
    of = at[of.ravel()]
    of[~unit.any(axis=1)] = np.flatnonzero(~unit.any(axis=1))  # vectors of zeros are 1 away from each other, too
    copies = np.flatnonzero(of != np.arange(n))
    own = np.flatnonzero(of == np.arange(n))
    count = np.bincount(of, minlength=n)[own]
    first, second, far = merged(unit[own] * count[:, None], count, np.full(len(own), -1), np.full(len(own), np.inf), threshold)
    return cut(n, np.append(of[copies], own[first]), np.append(copies, own[second]), np.append(np.zeros(len(copies)), far), clusters, threshold)


def matrix(column: pa.ChunkedArray, rows: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(rows, -1)


def nearest_of(state: DataFrame, key: str) -> DataFrame:
    """key, id, near and far of the clusters whose nearest isn't known: cells of queries and candidates meet, each in a task's memory."""
    sizes = state.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / CELL).cast("int").alias("cols"), F.ceil(F.count(F.when(F.col("near").isNull(), 1)) / CELL).cast("int").alias("rows")).filter("rows > 0")
    each = state.join(sizes, key)
    part = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int").alias(n[:3])
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias(n[:3])
    asked = each.filter("near IS NULL").select(key, "id", "n", "sum", part("rows"), spread("cols"))
    there = each.select(*[F.col(c).alias(c) for c in (key, "id", "n", "sum")], part("cols"), spread("rows"))
    kind = f"{key} {state.schema[key].dataType.simpleString()}"

    def searched(group: tuple, asked: pa.Table, there: pa.Table) -> pa.Table:
        ids, near, far = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        if len(asked) and len(there):
            there = there.sort_by("id")
            means = lambda t: matrix(t.column("sum"), len(t)) / t.column("n").to_numpy()[:, None]
            ids, others = asked.column("id").to_numpy(), there.column("id").to_numpy()
            at = np.minimum(np.searchsorted(others, ids), len(others) - 1)
            near, far = nearest(means(asked), np.where(others[at] == ids, at, -1), means(there), np.ones(len(there)))
            found = np.isfinite(far)
            ids, near, far = ids[found], others[near[found]], far[found]
        return pa.table([pa.array([group[0].as_py()] * len(ids), asked.schema.field(key).type), pa.array(ids), pa.array(near), pa.array(far)], names=[key, "id", "near", "far"])

    cells = asked.groupBy(key, "row", "col").cogroup(there.groupBy(key, "row", "col")).applyInArrow(searched, f"{kind}, id long, near long, far double")
    best = cells.groupBy(key, "id").agg(F.min(F.struct("far", "near")).alias("best"))
    return best.select(key, "id", F.col("best.near").alias("near"), F.col("best.far").alias("far"))


def merged_in_rounds(points: DataFrame, key: str, threshold: float | None = None) -> DataFrame:
    """points (key, id, sum: a unit vector) with the first merges done: key, id, into, n, sum, near, far.

    Either `into` names the cluster that took this one in, at the distance `far`, or the row is a cluster as `merged` takes it.
    Each round finds the nearest of all clusters whose nearest isn't known and merges those that are each other's. Rounds end once a
    task can do the next search of any key, or where few merge in one.
    """
    groups = points.filter(F.exists("sum", lambda x: x != 0)).groupBy(key, "sum").agg(F.min("id").alias("into"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    copies = stored(groups, "copies")
    gone = [stored(points.join(copies, [key, "sum"]).filter("id <> into").select(key, "id", "into", F.lit(0.0).alias("far")), "merged")]
    counts = copies.select(key, F.col("into").alias("id"), "n")
    living = points.join(gone[0].select(key, "id"), [key, "id"], "left_anti").join(counts, [key, "id"], "left").withColumn("n", F.coalesce("n", F.lit(1).cast("long")))
    state = stored(living.select(key, "id", "n", F.transform("sum", lambda x: x * F.col("n")).alias("sum"), F.lit(None).cast("long").alias("near"), F.lit(None).cast("double").alias("far")), "clusters")
    dropped(copies)
    while True:
        sizes = state.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("near").isNull(), 1)).alias("asked"))
        work, left = sizes.agg(F.max(F.col("n") * F.col("asked")), F.sum("n")).first()
        if not work or work <= CELL * CELL:
            break
        found = nearest_of(state, key).select(key, "id", F.col("near").alias("new"), F.col("far").alias("new_far"))
        full = stored(state.join(found, [key, "id"], "left").select(key, "id", "n", "sum", F.coalesce("near", "new").alias("near"), F.coalesce("far", "new_far").alias("far")), "clusters")
        back = full.select(key, F.col("id").alias("near"), F.col("near").alias("id"))
        pairs = full.select(key, "id", "near", "far").filter("id < near").join(back, [key, "id", "near"])
        if threshold is not None:
            pairs = pairs.filter(F.col("far") <= threshold)
        pairs = stored(pairs.select(key, F.col("near").alias("id"), F.col("id").alias("into"), "far"), "merged")
        gone.append(pairs)
        moved = full.join(pairs.select(key, "id", "into"), [key, "id"]).select(key, F.col("into").alias("id"), F.col("n").alias("more"), F.col("sum").alias("other"))
        touched = pairs.select(key, F.explode(F.array("id", "into")).alias("near"), F.lit(True).alias("touched"))
        rest = full.join(pairs.select(key, "id"), [key, "id"], "left_anti").join(moved, [key, "id"], "left").join(touched, [key, "near"], "left")
        same = F.col("more").isNull() & F.col("touched").isNull()
        total = F.when(F.col("more").isNull(), F.col("sum")).otherwise(F.zip_with("sum", "other", lambda x, y: x + y))
        last = state
        state = stored(rest.select(key, "id", (F.col("n") + F.coalesce("more", F.lit(0))).alias("n"), total.alias("sum"), F.when(same, F.col("near")).alias("near"), F.when(same, F.col("far")).alias("far")), "clusters")
        dropped(last, full)
        if pairs.count() < left / 20:
            break
    out = state.withColumn("into", F.lit(None).cast("long"))
    for df in gone:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def diarize(segments: DataFrame, key: str, speakers: int | None = None, threshold: float = 0.8, gap: float = 0.0) -> DataFrame:
    """segments (key, start, end, vec) with a speaker: SPEAKER_00 is the one heard first.

    With a number of speakers, segments merge down to it (or stay as many as they are); without, while the mean distance of two
    clusters is at most `threshold`. Segments of one speaker that follow each other within `gap` seconds become one.
    Long recordings are merged in rounds by many tasks; what is left, and the times, are one task's, whose memory grows with the segments.
    """
    rows = segments.filter("vec IS NOT NULL").select(key, F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"), F.transform("vec", lambda x: x.cast("double")).alias("vec"))
    kind = f"{key} {rows.schema[key].dataType.simpleString()}"
    most = None if speakers else threshold

    def clustered(group: tuple, block: pa.Table) -> pa.Table:
        if block.column("id").null_count:
            block = block.take(pa.array(np.lexsort((block.column("end").to_numpy(), block.column("start").to_numpy()))))
            own = linked(matrix(block.column("sum"), len(block)), speakers or 1, most)
        else:
            block = block.sort_by("id")
            ids = block.column("id").to_numpy()
            living = block.filter(block.column("into").is_null())
            gone = block.filter(block.column("into").is_valid())
            at, near = living.column("id").to_numpy(), living.column("near").fill_null(-1).to_numpy()
            first, second, far = merged(matrix(living.column("sum"), len(at)), living.column("n").to_numpy(), np.where(near < 0, -1, np.searchsorted(at, near)), living.column("far").fill_null(np.inf).to_numpy(), most)
            done = [gone.column(c).to_numpy() for c in ("into", "id", "far")]
            place = lambda a, b: np.searchsorted(ids, np.append(a, b))
            own = cut(len(ids), place(done[0], at[first]), place(done[1], at[second]), np.append(done[2], far), speakers or 1, most)
        out: list[list] = []
        for s, e, who in zip(block.column("start").to_pylist(), block.column("end").to_pylist(), own.tolist(), strict=True):
            if out and out[-1][2] == who and s - out[-1][1] <= gap:
                out[-1][1] = max(out[-1][1], e)
            else:
                out.append([s, e, who])
        starts, ends, who = zip(*out, strict=True)
        return pa.table([pa.array([group[0].as_py()] * len(out), block.schema.field(key).type), pa.array(range(len(out)), pa.int64()), pa.array(starts), pa.array(ends), pa.array([f"SPEAKER_{w:02}" for w in who])], names=[key, "seg_idx", "start", "end", "speaker"])

    # Bound to a name in a lambda, so that a row's norm is worked out once.
    unit = F.transform(F.array(V.norm(F.col("vec"))), lambda size: F.transform("vec", lambda x: x / F.when(size > 0, size).otherwise(1.0)))[0]
    odd = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    long = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.max(odd).alias("odd")).filter(F.col(key).isNotNull() & (F.col("n") > CELL) & ~F.col("odd")).select(key)
    none = lambda t: F.lit(None).cast(t)
    whole = lambda df: df.select(key, "start", "end", none("long").alias("id"), none("long").alias("into"), none("long").alias("n"), F.col("vec").alias("sum"), none("long").alias("near"), none("double").alias("far"))
    if long.isEmpty():
        nodes = whole(rows)
    else:
        long = stored(long, "long")
        by = Window.partitionBy(key).orderBy(F.asc_nulls_last("start"), F.asc_nulls_last("end"), "vec")
        points = rows.join(long, key, "left_semi").select(key, "start", "end", (F.row_number().over(by) - 1).cast("long").alias("id"), unit.alias("sum"))
        points = stored(points, "points")
        merges = merged_in_rounds(points.select(key, "id", "sum"), key, most)
        nodes = points.select(key, "id", "start", "end").join(merges, [key, "id"])
        nodes = whole(rows.join(long, key, "left_anti")).unionByName(nodes)
    return nodes.groupBy(key).applyInArrow(clustered, f"{kind}, seg_idx long, start double, end double, speaker string")

"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows and bytes of an Arrow batch that goes to a Python worker. Every operator asks for the same, so the order in which
#: plans are made and run doesn't matter.
ARROW_ROWS, ARROW_BYTES = 5000, 4 << 20

#: Bytes of document text that one task of a Python stage should get.
TASK_BYTES = 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local session takes a folder
    of its own, and a cluster is an error, as its machines share no temporary folder."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        conf = _LOCAL.setdefault("dir", tempfile.mkdtemp(prefix="lingualake-"))
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(conf)
    return conf.rstrip("/")


_LOCAL: dict[str, str] = {}


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete what written() made, once nothing reads it any more."""
    for df in tables:
        if df is not None:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.written_path)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def bounded_batches(spark: SparkSession) -> None:
    """Bound what a Python worker is sent at once, by rows and by bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def given_back(function):
    """A function for mapInArrow, after whose last batch memory that isn't used goes back to the system: workers wait for
    other stages, beside an executor's heap."""

    def mapped(batches):
        yield from function(batches)
        release()

    return mapped


def release() -> None:
    """Give free memory of this worker back to the system, where the C library can."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(df: DataFrame, *keep: str) -> DataFrame:
    """The kept columns and the text, null as empty."""
    return df.select(*keep, F.coalesce(F.col("text"), F.lit("")).alias("text"))


def partitions_for(df: DataFrame, per_task: int = TASK_BYTES) -> int:
    """Partitions for a shuffle of df's texts, from their size: grows with the input.

    The bytes are summed over all rows, as estimates from files know nothing of compression and those of joins are wild.
    """
    size = df.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // per_task))


_MIX = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """A fixed mixing of unsigned 64-bit integers (the splitmix64 finaliser)."""
    x = (x + _MIX).astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """Words (bytes) to unsigned 64-bit hashes, with a bounded memory of words seen."""

    LIMIT = 300_000

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def rolling(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of `width` consecutive items, mod 2**64; empty if there are fewer items.

    Horner's rule over the item hashes with an odd multiplier, doubled up: the hash of 2**k items
    comes from two of 2**(k-1), so the cost is a few array operations, not `width`.
    """
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out, done = None, 0
    block, size = hashes.astype(np.uint64), 1
    base = 0xD6E8FEB86659FD93
    rest = width
    while rest:
        if rest & 1:
            part = block[done : done + n]
            out = part.copy() if out is None else out * np.uint64(pow(base, size, 1 << 64)) + part
            done += size
        rest >>= 1
        if rest:
            block = block[:-size] * np.uint64(pow(base, size, 1 << 64)) + block[size:]
            size *= 2
    return mix64(out)


def runs(batches, *keys: str):
    """Runs of equal keys in each of the Arrow batches, as (key values, slice of the batch)."""
    for b in batches:
        rows = list(zip(*(b.column(b.schema.get_field_index(k)).to_pylist() for k in keys), strict=True))
        start = 0
        for i in range(1, len(rows) + 1):
            if i == len(rows) or rows[i] != rows[start]:
                yield rows[start], b.slice(start, i - start)
                start = i


def groups(batches, *keys: str):
    """Runs of equal keys in sorted Arrow batches, as (key values, table); a run may span batches."""
    import pyarrow as pa

    held: list = []
    now: tuple | None = None
    for key, part in runs(batches, *keys):
        if held and key != now:
            yield now, pa.Table.from_batches(held)
            held = []
        now = key
        held.append(part)
    if held:
        yield now, pa.Table.from_batches(held)


def id_ranges(docs: DataFrame, n: int, key: str = "doc_id") -> tuple:
    """Up to n ranges of ascending ids with about as many rows each, as an expression for the range's number.

    Null ids go to the first range. The cuts (n - 1 numbers) come from Spark's quantile sketch, whose
    steps grow with n; they are one constant of the plan, and the expression looks a row's range up by
    binary search over them.
    """
    shares = [i / n for i in range(1, n)]
    cuts = docs.agg(F.percentile_approx(F.col(key).cast("long"), shares or [0.5], max(10_000, 20 * n))).first()[0] if n > 1 else None
    cuts = sorted(set(cuts or ()))
    if not cuts:
        return F.lit(0), 1
    array = F.split(F.lit(",".join(map(str, cuts))), ",").cast("array<long>")
    steps = [1 << i for i in reversed(range(len(cuts).bit_length()))]

    def step(at, s):
        return F.when((at + s <= len(cuts)) & (F.get(array, at + s - 1) <= F.col(key).cast("long")), at + s).otherwise(at)

    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), step), len(cuts) + 1


def numbered(df: DataFrame, group: str, order: list[Column]) -> DataFrame:
    """df with `at` (long, from 0), a row's place in its group under the order, and `of`, the rows of its group.

    The group is a column without nulls. Rows are sorted over all partitions by range and written; a table with a row for
    each partition and group then says how many rows of a group stand before a partition. So a group of any size is
    numbered by many tasks. `order` should tell rows apart: equal ones go to one partition.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(n, F.col(group), *order).sortWithinPartitions(F.col(group), *order)
    rows = written(dealt.withColumn("_id", F.monotonically_increasing_id()), "numbered").withColumn("_part", F.shiftright("_id", 33))
    w = Window.partitionBy(group)
    parts = rows.groupBy(group, "_part").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(w.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(group, "_part", (before - F.col("_first")).alias("_shift"), F.sum("_n").over(w).alias("of"))
    return rows.join(parts, [group, "_part"]).select(*[F.col(f"`{c}`") for c in df.columns], (F.col("_id") + F.col("_shift")).alias("at"), "of")


def pieces(text: Column, gap: str, limit: int, before: int = 0, after: int = 0) -> Column:
    """A text as pieces for explode: piece (from 0), of (pieces of the text), head, own and tail (strings).

    A text of at most `limit` bytes is one piece as it is. A longer one has its gaps between words (`gap`: what a character
    class holds) made single spaces and is cut at gaps after `limit` characters or more; head and tail are the `before` last words before a
    piece and the `after` first ones behind it. A piece ends with a word, so a word longer than the limit stays whole.
    """
    plain = F.struct(F.lit(0).alias("piece"), F.lit(1).alias("of"), F.lit("").alias("head"), text.alias("own"), F.lit("").alias("tail"))
    spaced = F.trim(F.regexp_replace(text, f"[{gap}]+", " "))
    cut = F.transform(F.regexp_extract_all(spaced, F.lit(f"(?s).{{{limit}}}[^ ]*|.+"), F.lit(0)), lambda x: F.trim(x))
    # Nested, so that the text is cut once.
    cuts = F.filter(cut, lambda x: x != "")

    def made(p: Column) -> Column:
        def piece(own: Column, i: Column) -> Column:
            # Every piece has a word, so as many pieces as words are wanted do.
            back = F.split(F.array_join(F.slice(p, F.greatest(i - before + 1, F.lit(1)), F.least(i, F.lit(before))), " "), " ")
            head = F.array_join(F.slice(back, F.greatest(F.size(back) - before + 1, F.lit(1)), before), " ") if before else F.lit("")
            tail = F.array_join(F.slice(F.split(F.array_join(F.slice(p, i + 2, after), " "), " "), 1, after), " ") if after else F.lit("")
            return F.struct(i.alias("piece"), F.size(p).alias("of"), F.when(i > 0, head).otherwise("").alias("head"), own.alias("own"), tail.alias("tail"))

        return F.transform(p, piece)

    many = F.flatten(F.transform(F.array(cuts), made))
    return F.when((F.octet_length(text) <= limit) | (spaced == ""), F.array(plain)).otherwise(many)

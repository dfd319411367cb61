"""Sinks of feature tables: partitioned tables in place of files grown by appending.

A run overwrites the partitions it has and no others, so running again changes nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F

KEYS = ("metric", "part", "ses", "task")

MODES = {"skip": "ignore", "overwrite": "overwrite", "error": "errorifexists"}


def _writer(df: DataFrame, policy: str = "overwrite", by: Sequence[str] = ()) -> DataFrameWriter:
    if policy not in MODES:
        raise ValueError(f"unknown output policy {policy!r}; known: {', '.join(MODES)}")
    w = df.write.mode(MODES[policy]).option("partitionOverwriteMode", "dynamic")
    return w.partitionBy(*by) if by else w


def write_features(df: DataFrame, derivatives: str, metric: str, policy: str = "overwrite", form: str = "parquet") -> None:
    """A feature table under derivatives/metric=..., by participant, session and task where there are such columns.

    In CSV, vectors become Dim_0 ..., other arrays and maps text, whole numbers decimals, and all
    values are quoted in the tables of windows and sentences.
    """
    by = [k for k in KEYS if k != "metric" and k in df.columns]
    w = _writer(for_csv(df) if form == "csv" else df, policy, by)
    if form == "csv":
        w = w.option("header", True).option("quoteAll", metric.endswith(("details", "windows", "sentences"))).option("emptyValue", "")
    w.format(form).save(f"{derivatives}/metric={metric}")


def stored(spark: SparkSession, derivatives: str) -> list[str]:
    """Names of the tables under derivatives/metric=..., on any file system that Spark reads."""
    path = spark._jvm.org.apache.hadoop.fs.Path(derivatives)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = (s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory()) if fs.exists(path) else ()
    return sorted(n.removeprefix("metric=") for n in names if n.startswith("metric="))


def read_results(spark: SparkSession, derivatives: str, tables: Sequence[str] | None = None, participants: Sequence[str] | None = None, form: str = "parquet") -> DataFrame:
    """Stored feature tables as one: `table` and the columns of all of them, null where a table hasn't one.

    Participants are chosen by folder: others aren't read, nor are columns that nothing asks for. Tables without
    participants are left out where some are asked for. Tables that differ from run to run are merged.
    """
    found = [n for n in stored(spark, derivatives) if tables is None or n in tables]
    if not found:
        raise ValueError(f"no stored tables in {derivatives}" + (f" of {sorted(tables)}" if tables else ""))
    out = None
    for name in found:
        reader = spark.read.option("mergeSchema", True) if form == "parquet" else spark.read.option("header", True).option("inferSchema", True)
        # Participant 01 is no number: names of folders stay texts.
        inferred = spark.conf.get("spark.sql.sources.partitionColumnTypeInference.enabled")
        spark.conf.set("spark.sql.sources.partitionColumnTypeInference.enabled", "false")
        try:
            df = reader.format(form).load(f"{derivatives}/metric={name}")
        finally:
            spark.conf.set("spark.sql.sources.partitionColumnTypeInference.enabled", inferred)
        if participants is not None:
            if "part" not in df.columns:
                continue
            df = df.filter(F.col("part").cast("string").isin(*participants))
        df = df.select(F.lit(name).alias("table"), *[F.col(f"`{c}`").cast("string").alias(c) if c in KEYS else F.col(f"`{c}`") for c in df.columns])
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    if out is None:
        raise ValueError(f"none of {found} in {derivatives} has participants")
    return out


def for_csv(df: DataFrame, width: int | None = None) -> DataFrame:
    """Nested columns as flat ones: `vec` as Dim_0 to Dim_{width-1}, arrays as [1, 2], maps as key=value."""
    out = []
    for f in df.schema:
        kind = f.dataType.typeName()
        c = F.col(f"`{f.name}`")
        if f.name == "vec" and kind == "array":
            n = width if width is not None else df.agg(F.max(F.size("vec"))).first()[0] or 0
            out += [F.get("vec", F.lit(i)).alias(f"Dim_{i}") for i in range(n)]
        elif kind == "array":
            out.append(F.concat(F.lit("["), F.array_join(c.cast("array<string>"), ", "), F.lit("]")).alias(f.name))
        elif kind == "map":
            out.append(F.array_join(F.transform(F.map_entries(c), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ";").alias(f.name))
        elif kind in ("integer", "long", "short", "byte") and f.name not in KEYS and not f.name.endswith(("_id", "_idx", "_index")):
            out.append(c.cast("double").alias(f.name))
        else:
            out.append(c)
    return df.select(*out)


def matrix_wide(pairs: DataFrame, key: str, size: int) -> DataFrame:
    """Similarity rows (key, i, j, sim) as a matrix of `size` columns c0 ..., one row an i."""
    return pairs.groupBy(key, "i").pivot("j", list(range(size))).agg(F.first("sim")).withColumnsRenamed({str(j): f"c{j}" for j in range(size)})


def write_transcriptions(df: DataFrame, path: str, policy: str = "overwrite") -> None:
    """Nested transcriptions as JSON, without those that have nothing combined."""
    _writer(df.filter(F.size("combined_utterances") > 0), policy).json(path)


def write_transcripts(texts: DataFrame, path: str, key: str, policy: str = "overwrite") -> None:
    """Transcript texts (key, text), a folder for each key."""
    _writer(texts.select(key, "text"), policy, [key]).text(path)


def write_topics(tables: dict[str, DataFrame], derivatives: str) -> None:
    """assignments, keywords, info, comparisons, distributions under derivatives/topic-modeling."""
    for name, df in tables.items():
        _writer(for_csv(df)).option("header", True).csv(f"{derivatives}/topic-modeling/{name}")


def distribution_wide(distribution: DataFrame, key: str, topics: Sequence[int]) -> DataFrame:
    """Topic rows of each document as columns topic_<id>_count, _proportion and _avg_probability."""
    wide = distribution.groupBy(key).pivot("topic_id", list(topics)).agg(F.first("count").alias("count"), F.first("proportion").alias("proportion"), F.first("avg_probability").alias("avg_probability"))
    return wide.withColumnsRenamed({c: f"topic_{c}" for c in wide.columns if c != key})

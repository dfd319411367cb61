"""Participants' files: names with key-value entities, layouts, scans and filters."""

from __future__ import annotations

import re

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Names of files that systems leave behind, besides those with a leading dot.
HIDDEN = ("Thumbs.db", "desktop.ini")

AUDIO, TEXT = ("wav", "mp3", "flac", "ogg", "m4a"), ("txt", "rtf", "docx", "pdf")


def is_hidden(name: Column | str) -> Column:
    n = F.col(name) if isinstance(name, str) else name
    return F.startswith(n, F.lit(".")) | n.isin(*HIDDEN)


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def parse_entities(name: Column | str) -> Column:
    """Map of a file name's entities: parts `key-value` between underscores (the last of a key wins), a part
    without a hyphen as suffix (the last wins), and the extension with its dot.

    spark.sql.mapKeyDedupPolicy must be LAST_WIN (session.prepare).
    """
    n = F.col(name) if isinstance(name, str) else name
    dot = F.regexp_extract(n, r"^(.+?)(\.[^.]*)?$", 2)
    stem = F.regexp_extract(n, r"^(.+?)(\.[^.]*)?$", 1)
    parts = F.split(stem, "_")
    first = lambda x: F.regexp_extract(x, "^([^-]*)-(.*)$", 1)
    value = lambda x: F.regexp_extract(x, "^([^-]*)-(.*)$", 2)
    entries = F.transform(parts, lambda x: F.when(F.contains(x, F.lit("-")), F.struct(first(x).alias("key"), value(x).alias("value"))).otherwise(F.struct(F.lit("suffix").alias("key"), x.alias("value"))))
    end = F.when(dot != "", F.array(F.struct(F.lit("extension").alias("key"), dot.alias("value")))).otherwise(F.array().cast("array<struct<key: string, value: string>>"))
    return F.map_from_entries(F.concat(entries, end))


def entity(key: str, entities: str = "entities") -> Column:
    return F.element_at(F.col(entities), key)


def corpus_filter(docs: DataFrame, key: str, values: Sequence[str]) -> DataFrame:
    """Documents of the corpora `key`-value, with their corpus; those without the key match by any entity's value."""
    any_value = F.filter(F.array(*map(F.lit, values)), lambda v: F.exists(F.map_values("entities"), lambda x: x == v))
    own = F.coalesce(F.filter(F.array(entity(key)), lambda x: x.isin(*values)), F.array().cast("array<string>"))
    found = F.when(entity(key).isNotNull(), own).otherwise(any_value)
    return docs.withColumn("corpus", F.explode(found))


def lenient_filter(docs: DataFrame, key: str, value: str) -> DataFrame:
    """Documents except those with the key and another value."""
    return docs.filter(entity(key).isNull() | (entity(key) == value))


def typed(docs: DataFrame) -> DataFrame:
    """Documents (entities) with kind (text, audio or null), the usual entities as columns, and whether the task is a fluency one."""
    ext = F.lower(F.replace(entity("extension"), F.lit("."), F.lit("")))
    kind = F.when(ext.isin(*AUDIO), "audio").when(ext.isin(*TEXT), "text")
    keys = {"participant_id": "part", "session": "ses", "task": "task", "acquisition": "acq", "category": "cat", "run": "run"}
    return docs.withColumn("kind", kind).withColumns({c: entity(k) for c, k in keys.items()}).withColumn("fluency", F.coalesce(entity("cat") == "semantic", F.lit(False)))


def violations(paths: DataFrame) -> DataFrame:
    """Paths (project, path from its root) against the expected layout: project, rule, severity.

    Errors: no participants folder, no participant in it. Warnings: usual files and first folders that
    are missing, participants' files that don't follow the naming.
    """
    p = paths.withColumn("parts", F.split("path", "/"))
    top, second, last = F.get("parts", F.lit(0)), F.get("parts", F.lit(1)), F.element_at("parts", -1)
    inside = top == "participants"
    count = lambda c: F.coalesce(F.sum(c.cast("int")), F.lit(0))
    good = last.rlike(r"^part-[^_]+(_[^_]+)*\.[^.]+$")
    n = p.groupBy("project").agg(
        count(inside).alias("inside"),
        count(inside & (F.size("parts") > 2)).alias("people"),
        count(inside & (second == "part-01")).alias("first"),
        count(inside & F.array_contains("parts", "ses-01")).alias("session"),
        count(F.col("path") == "dataset_description.json").alias("description"),
        count(F.col("path") == "README").alias("readme"),
        count(F.col("path") == "CHANGES").alias("changes"),
        count(F.col("path") == "participants.tsv").alias("table"),
        count(inside & (F.size("parts") > 2) & ~good & ~is_hidden(last)).alias("named"),
    )
    rules = [("participants folder is missing", "error", F.col("inside") == 0), ("no participant folder", "error", (F.col("inside") > 0) & (F.col("people") == 0)), ("part-01 is missing", "warning", (F.col("people") > 0) & (F.col("first") == 0)), ("ses-01 is missing", "warning", (F.col("people") > 0) & (F.col("session") == 0)), ("dataset_description.json is missing", "warning", F.col("description") == 0), ("README is missing", "warning", F.col("readme") == 0), ("CHANGES is missing", "warning", F.col("changes") == 0), ("participants.tsv is missing", "warning", F.col("table") == 0), ("file name does not follow the pattern", "warning", F.col("named") > 0)]
    found = F.filter(F.array(*[F.when(c, F.struct(F.lit(r).alias("rule"), F.lit(s).alias("severity"))) for r, s, c in rules]), lambda x: x.isNotNull())
    return n.select("project", F.explode(found).alias("v")).select("project", "v.rule", "v.severity")


def scan(spark: SparkSession, root: str, task: str | None = None) -> DataFrame:
    """Files under root/participants: path, length, content, name, entities; with a task only files named for it are opened."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if task:
        reader = reader.option("pathGlobFilter", "*task-" + re.sub(r"([\\*?\[\]{}^,])", r"\\\1", task) + "*")
    files = reader.load(f"{root}/participants").select("path", "length", "content")
    files = files.withColumn("name", file_name(F.col("path"))).filter(~is_hidden("name"))
    files = files.withColumn("entities", parse_entities("name"))
    return files.filter(entity("task") == task) if task else files


def check_layout(spark: SparkSession, root: str) -> DataFrame:
    """violations() of one project tree; raises FileNotFoundError for the errors among them."""
    jvm = spark._jvm
    base = jvm.org.apache.hadoop.fs.Path(root)
    fs = base.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(jvm.org.apache.hadoop.fs.Path(f"{root}/participants")):
        raise FileNotFoundError(f"{root}/participants")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")
    at = F.expr(f"substring_index(path, '{base.getName()}/', -1)")
    found = violations(files.select(F.lit(root).alias("project"), at.alias("path")))
    if found.filter("severity = 'error'").limit(1).count():
        raise FileNotFoundError(f"no participant under {root}/participants")
    return found

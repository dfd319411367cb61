"""Streams over landing files: features that need no more than a window of time.

The batch operators cover whole corpora; here timed words arrive as files and speech runs (words
without a pause between them) leave as they close.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def read(spark: SparkSession, path: str, schema: StructType, form: str = "parquet", files: int = 100) -> DataFrame:
    return spark.readStream.format(form).schema(schema).option("maxFilesPerTrigger", files).load(path)


def speech_runs(words: DataFrame, key: str, ts: str = "ts", pause: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """key, start_time, end_time, n_words: sessions that a pause ends; words later than `late` are dropped."""
    t = words.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    runs = t.groupBy(key, F.session_window(ts, pause).alias("run")).agg(F.count(F.lit(1)).alias("n_words"))
    return runs.select(key, F.col("run.start").alias("start_time"), F.col("run.end").alias("end_time"), "n_words")


def rates(words: DataFrame, key: str, ts: str = "ts", window: str = "10 minutes", slide: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Words in sliding windows of time."""
    t = words.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    n = t.groupBy(key, F.window(ts, window, slide).alias("w")).agg(F.count(F.lit(1)).alias("n_words"))
    return n.select(key, F.col("w.start").alias("start_time"), F.col("w.end").alias("end_time"), "n_words")


def write(df: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append to Parquet; the checkpoint makes a restarted query go on where it was."""
    w = df.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start(path)

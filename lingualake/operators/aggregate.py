"""Aggregation of feature tables by participant, and document information."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .similarity import METRICS

#: Names under which a participant's mean window score is written.
AVERAGES = ("avg_per_window", "avg_per_sentence", "avg_per_response")


def participant_scores(summary: DataFrame, participant: str, family: str | None = None) -> DataFrame:
    """participant, metric, score: means over all of a participant's non-null scores, under their derived names.

    family: a column naming the feature family; sentence families get two names, others three.
    """
    by = [participant, "metric"] + ([family] if family else [])
    mean = summary.groupBy(*by).agg(F.avg("score").alias("score"))
    names = F.array(*map(F.lit, AVERAGES))
    if family:
        names = F.when(F.contains(family, F.lit("sentence")), F.slice(names, 2, 2)).otherwise(names)
    return mean.select(*by, F.explode(names).alias("aggregate"), "score")


def wide(scores: DataFrame, participant: str, metric: str = "metric", metrics: Sequence[str] | None = None) -> DataFrame:
    """One row a participant, one column a metric; naming the metrics spares a pass over the data."""
    return scores.groupBy(participant).pivot(metric, list(metrics) if metrics else None).agg(F.first("score"))


def consolidated(results: DataFrame) -> DataFrame:
    """Stored similarity scores (part, window, metric, score) as a row for each participant and family: window, and a column for each metric's mean."""
    means = results.filter("part IS NOT NULL AND window IS NOT NULL").groupBy("part", "window", "metric").agg(F.avg("score").alias("score"))
    return means.groupBy("part", "window").pivot("metric", list(METRICS)).agg(F.first("score"))


def document_information(docs: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The columns asked for, those that are there."""
    return docs.select(*[c for c in columns if c in docs.columns])


def last_section_word_count(tokens: DataFrame, key: str = "doc_id") -> DataFrame:
    """Tokens of the last section of each document: tokens are rows (key, section_idx, tokens array)."""
    return tokens.groupBy(key).agg(F.max_by(F.size("tokens"), "section_idx").alias("fluency_word_count"))

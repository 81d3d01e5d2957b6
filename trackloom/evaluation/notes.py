"""Notes (track_id, onset, pitch) and onsets against annotations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.evaluation import base
from trackloom.operators.onsets import combined

WINDOW = 0.025


def distinct_notes(notes: DataFrame) -> DataFrame:
    """Equal rows once, in order of onset."""
    return notes.dropDuplicates().sortWithinPartitions("onset")


def matches(detections: DataFrame, annotations: DataFrame, window: float = WINDOW, delay: float = 0.0) -> DataFrame:
    """Onset matching by pitch: (track_id, pitch, t, kind, error)."""
    t = lambda s, late: s.select("track_id", F.col("pitch").cast("double").alias("pitch"), (F.col("onset") + late).alias("t"))
    return base.matches(t(detections, delay), t(annotations, 0.0), window, "track_id", "pitch")


def evaluate(detections: DataFrame, annotations: DataFrame, window: float = WINDOW, delay: float = 0.0) -> DataFrame:
    """Counts, scores, mean and deviation of errors by track."""
    return base.with_errors(matches(detections, annotations, window, delay), "track_id")


def by_pitch(detections: DataFrame, annotations: DataFrame, window: float = WINDOW) -> DataFrame:
    return base.by_class(matches(detections, annotations, window), "pitch")


def evaluate_onsets(detections: DataFrame, annotations: DataFrame, window: float = WINDOW, combine: float = 0.0, delay: float = 0.0) -> DataFrame:
    """The same for events (track_id, t) without pitch; annotations within ``combine`` of each other become their mean."""
    a = combined(annotations, combine) if combine > 0 else annotations
    d = detections.withColumn("t", F.col("t") + delay) if delay else detections
    return base.with_errors(base.matches(d, a, window), "track_id")


def total(found: DataFrame) -> DataFrame:
    """All files' matches as one: summed counts, and the mean and deviation of all errors."""
    return base.with_errors(found)


def mean(scores: DataFrame) -> DataFrame:
    """Plain means of the files' scores."""
    return base.averaged(scores, *base.COUNTS, "precision", "recall", "fmeasure", "accuracy", "mean_error", "std_error")

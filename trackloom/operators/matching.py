"""Detections against annotations: nearest matches, errors and scores.

Nearest neighbours come from one union of both sides and two windows over it, never from a range join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def closest(detections: DataFrame, annotations: DataFrame) -> DataFrame:
    """For each detection (track_id, t) the nearest annotation; the later one on ties, null in tracks without any."""
    d = detections.select("track_id", "t", F.lit(None).cast("double").alias("a"), F.lit(1).alias("side"))
    a = annotations.select("track_id", "t", F.col("t").alias("a"), F.lit(0).alias("side"))
    both = Window.partitionBy("track_id")
    left = F.last("a", ignorenulls=True).over(both.orderBy("t", "side").rowsBetween(Window.unboundedPreceding, 0))
    right = F.first("a", ignorenulls=True).over(both.orderBy("t", F.desc("side")).rowsBetween(0, Window.unboundedFollowing))
    u = d.unionByName(a).withColumn("l", left).withColumn("r", right).where("side = 1")
    nearest = F.when(F.col("r").isNull() | (F.col("t") - F.col("l") < F.col("r") - F.col("t")), F.col("l")).otherwise(F.col("r"))
    return u.select("track_id", "t", nearest.alias("match")).withColumn("error", F.col("t") - F.col("match"))


def near(detections: DataFrame, annotations: DataFrame, within: float) -> DataFrame:
    return closest(detections, annotations).where(F.abs("error") <= within).select("track_id", "t")


def errors(detections: DataFrame, annotations: DataFrame) -> DataFrame:
    """Mean, mean absolute and standard deviation of the errors by track."""
    return closest(detections, annotations).groupBy("track_id").agg(F.avg("error").alias("mean_error"), F.avg(F.abs("error")).alias("mean_abs"), F.stddev_pop("error").alias("std_error"))


def sizes(detections: DataFrame, annotations: DataFrame) -> DataFrame:
    n = lambda df, c: df.groupBy("track_id").agg(F.count("*").alias(c))
    return n(detections, "nd").join(n(annotations, "na"), "track_id", "full").select("track_id", F.coalesce("nd", F.lit(0)).alias("nd"), F.coalesce("na", F.lit(0)).alias("na"))


def interval_accuracy(detections: DataFrame, annotations: DataFrame, tolerance: float) -> DataFrame:
    """Share of detections within tolerance times the annotations' median interval, over the larger count."""
    w = Window.partitionBy("track_id").orderBy("t")
    gap = annotations.withColumn("g", F.col("t") - F.lag("t").over(w)).groupBy("track_id").agg(F.median("g").alias("m"))
    ok = closest(detections, annotations).join(gap, "track_id").groupBy("track_id").agg(F.count_if(F.abs("error") <= tolerance * F.col("m")).alias("hits"))
    return sizes(detections, annotations).join(ok, "track_id", "left").select("track_id", (F.coalesce("hits", F.lit(0)) / F.greatest("nd", "na")).alias("pscore"))

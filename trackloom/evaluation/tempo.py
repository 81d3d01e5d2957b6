"""Tempo estimates (track_id, pos, tempo, strength) against annotated tempi of the same columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trackloom.evaluation import base

TOLERANCE = 0.04


def ranked(tempi: DataFrame) -> DataFrame:
    """pos by falling strength; equal ones keep their order."""
    w = Window.partitionBy("track_id").orderBy(F.desc("strength"), "pos")
    return tempi.withColumn("pos", F.row_number().over(w) - 1)


def judged(detections: DataFrame, annotations: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """(track_id, pscore, any, all): the strengths of annotations with a detection within the tolerance, and whether one or all have one.

    Strengths are divided by their sum, even where it is 0. No tempi on both sides score 1, on one side 0.
    """
    d = detections.groupBy("track_id").agg(F.collect_list("tempo").alias("_d"))
    w = Window.partitionBy("track_id")
    total = F.sum(F.coalesce("strength", F.lit(0.0))).over(w)
    a = annotations.withColumn("_w", F.when(total == 0, 1 / F.count("*").over(w)).otherwise(F.coalesce("strength", F.lit(0.0)) / total))
    j = a.join(d, "track_id", "full")
    ok = F.coalesce(F.exists("_d", lambda x: F.abs(1 - x / F.col("tempo")) <= tolerance), F.lit(False))
    return j.groupBy("track_id").agg(F.sum(F.when(ok, F.coalesce("_w", F.lit(0.0))).otherwise(0.0)).alias("pscore"), F.bool_or(ok).alias("any"), F.bool_and(ok).alias("all"))


def evaluate(detections: DataFrame, annotations: DataFrame, tolerance: float = TOLERANCE, double: bool = True, triple: bool = True, sort: bool = True, max_len: int | None = None) -> DataFrame:
    """judged() with acc1, whether the first detection fits the first annotation, and acc2, whether it fits it or two or three times faster or slower."""
    if sort:
        detections, annotations = ranked(detections), ranked(annotations)
    if max_len is not None:
        detections, annotations = (s.where(F.col("pos") < max_len) for s in (detections, annotations))
    first = lambda s: s.where("pos = 0")
    factors = [1.0, *([2.0, 0.5] if double else []), *([3.0, 1 / 3] if triple else [])]
    wide = first(annotations).withColumn("_f", F.explode(F.array(*map(F.lit, factors)))).withColumn("tempo", F.col("tempo") * F.col("_f")).withColumn("strength", F.lit(1.0)).drop("_f")
    out = judged(detections, annotations, tolerance)
    one = judged(first(detections), first(annotations), tolerance).select("track_id", F.col("any").alias("acc1"))
    two = judged(first(detections), wide, tolerance).select("track_id", F.col("any").alias("acc2"))
    return out.join(one, "track_id", "left").join(two, "track_id", "left")


def mean(scores: DataFrame) -> DataFrame:
    return base.averaged(scores, "pscore", "any", "all", "acc1", "acc2")

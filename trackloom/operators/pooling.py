"""Frames pooled by the beat that holds them: a running beat number over the union of both, no range join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trackloom.functions.vectors import norm


def in_beats(frames: DataFrame, beats: DataFrame, *columns: str) -> DataFrame:
    """frames (track_id, t, columns) with beat, from 0: the last beat (track_id, t) not later; what comes before the first beat belongs to it."""
    o = Window.partitionBy("track_id").orderBy("t")
    marks = beats.select("track_id", F.col("t").cast("double").alias("t"), (F.row_number().over(o) - 1).alias("_b"), F.lit(0).alias("_side"), *[F.lit(None).cast(dict(frames.dtypes)[c]).alias(c) for c in columns])
    rows = frames.select("track_id", F.col("t").cast("double").alias("t"), F.lit(None).cast("int").alias("_b"), F.lit(1).alias("_side"), *columns)
    w = Window.partitionBy("track_id").orderBy("t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    u = rows.unionByName(marks).withColumn("beat", F.last("_b", ignorenulls=True).over(w))
    return u.where("_side = 1").select("track_id", "t", F.coalesce("beat", F.lit(0)).cast("long").alias("beat"), *columns)


def median_by_beat(frames: DataFrame, beats: DataFrame, column: str = "x") -> DataFrame:
    """(track_id, beat, median): true medians; beats without a frame have no row."""
    return in_beats(frames, beats, column).groupBy("track_id", "beat").agg(F.median(F.col(column)).alias("median"))


def vectors_by_beat(frames: DataFrame, beats: DataFrame, column: str = "v", normed: bool = False) -> DataFrame:
    """(track_id, beat, v): the median of each dimension; normed: over its norm where that isn't almost 0."""
    long = in_beats(frames, beats, column).select("track_id", "beat", F.posexplode(column).alias("k", "x")).groupBy("track_id", "beat", "k").agg(F.median(F.col("x").cast("double")).alias("m"))
    g = long.groupBy("track_id", "beat").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "m"))), lambda x: x["m"]).alias("v"))
    return g.withColumn("v", F.when(norm("v") > 1e-10, F.transform("v", lambda x: x / norm("v"))).otherwise(F.col("v"))) if normed else g


def rms_by_beat(frames: DataFrame, beats: DataFrame, column: str = "x") -> DataFrame:
    """(track_id, beat, rms): every beat has a row, 0 without a frame."""
    o = Window.partitionBy("track_id").orderBy("t")
    all_beats = beats.select("track_id", (F.row_number().over(o) - 1).cast("long").alias("beat"))
    r = in_beats(frames, beats, column).groupBy("track_id", "beat").agg(F.sqrt(F.avg(F.col(column) * F.col(column))).alias("rms"))
    return all_beats.join(r, ["track_id", "beat"], "left").select("track_id", "beat", F.coalesce("rms", F.lit(0.0)).alias("rms"))


def over_maximum(df: DataFrame, column: str, name: str | None = None) -> DataFrame:
    """A column over its maximum in the track; unchanged where that is almost 0."""
    top = F.max(column).over(Window.partitionBy("track_id"))
    return df.withColumn(name or column, F.when(top > 1e-10, F.col(column) / top).otherwise(F.col(column)))


def is_near(beats: DataFrame, downbeats: DataFrame, within: float = 0.05) -> Column | DataFrame:
    """beats with downbeat: whether any downbeat lies less than ``within`` away; by the nearest one."""
    from trackloom.operators.matching import closest

    hits = closest(beats, downbeats).where(F.abs("error") < within).select("track_id", "t").distinct().withColumn("downbeat", F.lit(True))
    return beats.join(hits, ["track_id", "t"], "left").withColumn("downbeat", F.coalesce("downbeat", F.lit(False)))

"""Tables seen as tracks: ordered rows (track_id, idx, t, label, x), idx from 0 without gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_tracks(events: DataFrame) -> DataFrame:
    """One track per user; ties in time are ordered by the event's id."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return events.select(
        F.col("user_id").alias("track_id"), (F.row_number().over(w) - 1).cast("long").alias("idx"),
        (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"), F.col("event_type").alias("label"), F.col("value").alias("x"),
    )


def frames(vectors: DataFrame) -> DataFrame:
    """One track of feature vectors in long form (i, k, v)."""
    return vectors.select(F.col("vec_id").alias("i"), F.posexplode("embedding").alias("k", "v")).select("i", F.col("k").cast("long").alias("k"), F.col("v").cast("double").alias("v"))


def vector_tracks(vectors: DataFrame) -> DataFrame:
    """One track of frames per label of the vectors: (track_id, i, v), i from 0 in the order of vec_id."""
    w = Window.partitionBy("label").orderBy("vec_id")
    return vectors.select(F.col("label").cast("long").alias("track_id"), (F.row_number().over(w) - 1).cast("long").alias("i"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))


def spectrum_tracks(vectors: DataFrame) -> DataFrame:
    """The same seen as spectra (track_id, frame, m, phase): magnitudes are absolute values, phases three times the values."""
    v = vector_tracks(vectors)
    return v.select("track_id", F.col("i").alias("frame"), F.transform("v", lambda x: F.abs(x)).alias("m"), F.transform("v", lambda x: x * 3.0).alias("phase"))

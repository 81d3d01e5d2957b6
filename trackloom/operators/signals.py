"""Operators on sampled signals (track_id, idx, x): gain, mixing, trimming, smoothing, framing and levels.

Levels and scalings are windows or aggregates by track. Frames are made by sending each sample to the frames that hold it, so a
frame's row is complete in one task whatever the track's length.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.functions.vectors import dot
from trackloom.operators.sequence import in_order, whole


def normalize(s: DataFrame) -> DataFrame:
    """x over the track's greatest absolute value; silence stays silent."""
    top = F.max(F.abs("x")).over(whole())
    return s.withColumn("x", F.when(top > 0, F.col("x") / top).otherwise(F.col("x")))


def rescale(x: Column, bits: int) -> Column:
    """Signed integers of so many bits to [-1, 1]."""
    return x.cast("double") / float((1 << (bits - 1)) - 1)


def mono(channels: Column | str, channel: int | None = None) -> Column:
    """The mean of an array of channels, or one of them."""
    if channel is not None:
        return F.element_at(channels, channel + 1)
    return F.aggregate(F.transform(channels, lambda v: v.cast("double")), F.lit(0.0), lambda a, v: a + v) / F.size(channels)


def spread(x: Column, channels: int) -> Column:
    return F.array_repeat(x, channels)


def trim(s: DataFrame, where: str = "both") -> DataFrame:
    """Without leading (front) and trailing (back) zeros."""
    loud = F.when(F.col("x") != 0, F.col("idx"))
    j = s.withColumn("_lo", F.min(loud).over(whole())).withColumn("_hi", F.max(loud).over(whole()))
    keep = F.col("_lo").isNotNull()
    if where in ("front", "both"):
        keep = keep & (F.col("idx") >= F.col("_lo"))
    if where in ("back", "both"):
        keep = keep & (F.col("idx") <= F.col("_hi"))
    return j.where(keep).drop("_lo", "_hi")


def convolve(s: DataFrame, kernel, column: str = "x") -> DataFrame:
    """Convolution of the same length, centred as numpy centres it; zeros beyond the ends. One window over the track."""
    kernel = [float(k) for k in kernel]
    shift = (len(kernel) - 1) // 2
    out = F.lit(0.0)
    for k, w in enumerate(kernel):
        d = k - shift
        out = out + w * F.coalesce(F.col(column) if d == 0 else F.lag(column, d).over(in_order()), F.lit(0.0))
    return s.withColumn("smooth", out)


def hamming_smooth(s: DataFrame, size: int, column: str = "x") -> DataFrame:
    return convolve(s, np.hamming(size), column)


def resample(s: DataFrame, ratio: float) -> DataFrame:
    """Linear interpolation onto a grid of ratio samples for each one."""
    first, last = F.ceil(F.col("idx") * ratio), F.ceil((F.col("idx") + 1) * ratio) - 1
    none = F.expr("cast(array() as array<bigint>)")
    own = F.filter(F.array(first), lambda k: k == F.col("idx") * ratio)
    steps = F.when(F.col("_n").isNull(), own).otherwise(F.when(first <= last, F.sequence(first, last)).otherwise(none))
    j = s.withColumn("_n", F.lead("x").over(in_order())).withColumn("_k", F.explode(steps))
    rise = F.coalesce(F.col("_n") - F.col("x"), F.lit(0.0))
    return j.select("track_id", F.col("_k").cast("long").alias("idx"), (F.col("x") + rise * (F.col("_k") / ratio - F.col("idx"))).alias("x"))


def frame_shift(size: int, origin: str | int = "center") -> int:
    """Samples by which a frame lies earlier than centred on its reference sample."""
    if origin in ("center", "offline"):
        return 0
    if origin in ("left", "past", "online"):
        return int((size - 1) / 2)
    if origin in ("right", "future", "stream"):
        return int(-(size / 2))
    return int(origin)


def frames(s: DataFrame, size: int = 2048, hop: float = 441.0, origin: str | int = "center", end: str = "normal") -> DataFrame:
    """(track_id, frame, samples): frame k is centred on sample floor(k hop), zeros beyond the ends.

    end: normal gives ceil(n / hop) frames, extend floor(n / hop) + 1.
    """
    shift = size // 2 + frame_shift(size, origin)
    n = s.groupBy("track_id").agg((F.max("idx") + 1).alias("n"))
    count = F.ceil(F.col("n") / hop) if end == "normal" else F.floor(F.col("n") / hop) + 1
    grid = n.select("track_id", F.explode(F.sequence(F.lit(0).cast("long"), count.cast("long") - 1)).alias("frame"))
    # Frame k holds sample i at place i - floor(k hop) + shift; the frames near i are tried, each sample in at most size / hop + 2.
    low, high = F.floor((F.col("idx") - size + shift) / hop), F.ceil((F.col("idx") + shift + 1) / hop)
    j = s.withColumn("frame", F.explode(F.sequence(F.greatest(low, F.lit(0)).cast("long"), F.greatest(high, F.lit(0)).cast("long"))))
    j = j.withColumn("place", (F.col("idx") - F.floor(F.col("frame") * hop) + shift).cast("int")).where((F.col("place") >= 0) & (F.col("place") < size))
    got = j.groupBy("track_id", "frame").agg(F.map_from_entries(F.collect_list(F.struct("place", F.col("x").cast("double")))).alias("at"))
    samples = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda p: F.coalesce(F.try_element_at("at", p), F.lit(0.0)))
    return grid.join(got, ["track_id", "frame"], "left").select("track_id", "frame", F.when(F.col("at").isNull(), F.array_repeat(F.lit(0.0), size)).otherwise(samples).alias("samples"))


def segments(values: Column | str, size: int, hop: int, end: str = "cut") -> Column:
    """Consecutive slices of an array: cut drops a short rest, pad fills it with zeros."""
    v = F.col(values) if isinstance(values, str) else values
    n = F.size(v)
    count = F.when(n < size, 0).otherwise(F.floor((n - size) / hop) + 1) if end == "cut" else F.when(n == 0, 0).when(n <= size, 1).otherwise(F.ceil((n - size) / hop) + 1)
    empty = F.expr("cast(array() as array<int>)")
    starts = F.when(count > 0, F.sequence(F.lit(0), count.cast("int") - 1)).otherwise(empty)
    padded = F.concat(v, F.array_repeat(F.lit(0.0), size)) if end == "pad" else v
    return F.transform(starts, lambda k: F.slice(padded, k * hop + 1, F.lit(size)))


def energy(samples: Column | str) -> Column:
    return dot(samples, samples)


def root_mean_square(samples: Column | str) -> Column:
    return F.sqrt(energy(samples) / F.size(samples))


def sound_pressure(samples: Column | str, reference: float = 1.0) -> Column:
    """20 log10(rms / reference); the smallest double where all is silent."""
    rms = root_mean_square(samples)
    return F.when(rms > 0, 20 * F.log10(rms / reference)).otherwise(-1.7976931348623157e308)

"""Peaks of activations (track_id, idx, x) and the events made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.operators.sequence import in_order, whole
from trackloom.operators.signals import hamming_smooth


def peaks(b: DataFrame, threshold: float, smooth: int = 0, pre_avg: int = 0, post_avg: int = 0, pre_max: int = 1, post_max: int = 1) -> DataFrame:
    """Rows at or above moving average + threshold that equal the moving maximum of such rows and aren't 0; plateaus stay whole.

    Beyond the ends lie zeros, which count in the average.
    """
    if smooth:
        b = hamming_smooth(b, smooth).withColumn("x", F.col("smooth")).drop("smooth")
    limit = F.lit(float(threshold))
    if pre_avg + post_avg:
        limit = limit + F.sum("x").over(in_order().rowsBetween(-pre_avg, post_avg)) / (pre_avg + post_avg + 1)
    b = b.withColumn("_d", F.when(F.col("x") >= limit, F.col("x")).otherwise(0.0))
    if pre_max + post_max:
        w = in_order().rowsBetween(-pre_max, post_max)
        top = F.max("_d").over(w)
        # Where the window reaches over an end, a 0 lies in it.
        cut = (F.col("idx") < pre_max) | (F.col("idx") + post_max >= F.count("*").over(whole()))
        b = b.withColumn("_top", F.when(cut, F.greatest(top, F.lit(0.0))).otherwise(top)).where("_d = _top").drop("_top")
    return b.where("_d <> 0").drop("_d")


def frames_of(seconds: float, fps: float) -> int:
    return int(round(seconds * fps))


def onsets(b: DataFrame, fps: float = 100.0, threshold: float = 0.5, smooth: float = 0.0, pre_avg: float = 0.0, post_avg: float = 0.0, pre_max: float = 0.0, post_max: float = 0.0, combine: float = 0.03, delay: float = 0.0) -> DataFrame:
    """(track_id, t): picked peaks in seconds; those within ``combine`` behind a kept one go. All times in seconds."""
    sizes = [frames_of(s, fps) for s in (smooth, pre_avg, post_avg, pre_max, post_max)]
    events = peaks(b, threshold, *sizes).select("track_id", (F.col("idx") / fps + delay).alias("t"))
    return combined(events, combine, "left") if combine else events


def combined(events: DataFrame, delta: float, how: str = "mean", *keys: str) -> DataFrame:
    """Events (track_id, t) where neighbours at most delta apart become one: the first (left), the last (right) or their mean, which then is compared on.

    left and mean are folds over each track's sorted events with one open event and the finished ones collected in order;
    right needs only the gap to the next one.
    """
    keys = keys or ("track_id",)
    delta = delta + 1e-12
    if how == "right":
        from pyspark.sql.window import Window

        gap = F.lead("t").over(Window.partitionBy(*keys).orderBy("t")) - F.col("t")
        return events.select(*keys, "t").withColumn("_gap", gap).where(F.col("_gap").isNull() | (F.col("_gap") > delta)).drop("_gap")
    if how not in ("left", "mean"):
        raise ValueError("how must be mean, left or right")

    def work(key, pdf):
        import pandas as pd

        out: list[float] = []
        for t in sorted(pdf["t"]):
            if out and t - out[-1] <= delta:
                out[-1] = out[-1] if how == "left" else 0.5 * (out[-1] + t)
            else:
                out.append(t)
        return pd.DataFrame({**dict(zip(keys, key, strict=True)), "t": out})

    narrow = events.select(*keys, F.col("t").cast("double").alias("t"))
    return narrow.groupBy(*keys).applyInPandas(work, narrow.schema)


def merged(peaks_: DataFrame, width: float = 1.0) -> DataFrame:
    """Peaks (track_id, idx) where neighbours within width of a running mean become that mean, rounded half away from zero."""

    def work(key, pdf):
        import math

        import pandas as pd

        out, mean, n = [], None, 0
        for p in sorted(pdf["idx"]):
            if mean is not None and p - mean <= width:
                n += 1
                mean += (p - mean) / n
            else:
                if mean is not None:
                    out.append(math.floor(mean + 0.5))
                mean, n = float(p), 1
        if mean is not None:
            out.append(math.floor(mean + 0.5))
        return pd.DataFrame({"track_id": key[0], "idx": out})

    narrow = peaks_.select("track_id", F.col("idx").cast("long").alias("idx"))
    return narrow.groupBy("track_id").applyInPandas(work, narrow.schema)


def quantized(events: DataFrame, fps: float, length: int | None = None, shift: float = 0.0) -> DataFrame:
    """Distinct grid frames with an event; with a length, events from length - 0.5 frames on are left out."""
    t = F.col("t") if length is None else F.when(F.col("t") < (length - 0.5) / fps, F.col("t"))
    q = events.select("track_id", F.rint((t + shift) * fps).cast("long").alias("frame"))
    return q.where("frame is not null").distinct()


def quantized_notes(notes: DataFrame, fps: float, length: int | None = None, pitches: int | None = None) -> DataFrame:
    """(track_id, frame, pitch, velocity) of notes (onset, pitch, duration, velocity) on a grid, from onset to offset; later rows win."""
    first, last = F.rint(F.col("onset") * fps).cast("long"), F.rint((F.col("onset") + F.coalesce("duration", F.lit(0.0))) * fps).cast("long")
    g = notes.select("track_id", "onset", F.explode(F.sequence(first, last)).alias("frame"), F.col("pitch").cast("long").alias("pitch"), F.coalesce(F.col("velocity").cast("double"), F.lit(1.0)).alias("velocity"))
    if length is not None:
        g = g.where(F.col("frame") < length)
    if pitches is not None:
        g = g.where((F.col("pitch") >= 0) & (F.col("pitch") < pitches))
    return g.groupBy("track_id", "frame", "pitch").agg(F.max_by("velocity", F.struct("onset", "velocity")).alias("velocity"))


def expanded_notes(notes: DataFrame, duration: float = 0.6, velocity: float = 100.0) -> DataFrame:
    """Notes with duration and velocity, where those columns are missing."""
    out = notes if "duration" in notes.columns else notes.withColumn("duration", F.lit(duration))
    return out if "velocity" in notes.columns else out.withColumn("velocity", F.lit(velocity))


def beats_from_logits(beats: DataFrame, downbeats: DataFrame, fps: float = 50.0) -> tuple[DataFrame, DataFrame]:
    """Beat and downbeat times from logits (track_id, idx, x): peaks above 0 within 3 frames, merged; downbeats move to their nearest beat, the earlier on ties, once each."""
    from trackloom.operators.matching import closest
    from trackloom.operators.sequence import max_peaks

    times = lambda d: merged(max_peaks(d, 3, 0.0)).select("track_id", (F.col("idx") / fps).alias("t"))
    found = times(beats)
    mirrored = lambda d: d.select("track_id", (-F.col("t")).alias("t"))
    near = closest(mirrored(times(downbeats)), mirrored(found))
    return found, near.select("track_id", (-F.coalesce("match", "t")).alias("t")).distinct()

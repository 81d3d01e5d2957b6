"""Tempo from activations (track_id, idx, x): interval histograms (track_id, tau, strength) and the tempi they show."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trackloom.operators import sequence
from trackloom.operators.hmm import Model, bar_space, bar_transitions, beat_densities, beat_pointers, by_track

ALPHA, LOW_BPM, HIGH_BPM = 0.79, 40.0, 250.0


def tau_range(fps: float, low_bpm: float = LOW_BPM, high_bpm: float = HIGH_BPM) -> tuple[int, int]:
    """Shortest and longest interval in frames."""
    return int(np.floor(60 * fps / high_bpm)), int(np.ceil(60 * fps / low_bpm))


def histogram_acf(b: DataFrame, low: int, high: int) -> DataFrame:
    """Sum of abs(x[n] x[n - tau]) for each tau from low to high: one window, combined before the shuffle."""
    terms = F.array(*[F.struct(F.lit(k).cast("long").alias("tau"), F.abs(F.col("x") * F.lag("x", k).over(sequence.in_order())).alias("v")) for k in range(low, high + 1)])
    return b.select("track_id", terms.alias("terms")).select("track_id", F.explode("terms").alias("e")).groupBy("track_id", "e.tau").agg(F.coalesce(F.sum("e.v"), F.lit(0.0)).alias("strength"))


def comb_back(x: np.ndarray, tau: int, alpha: float) -> np.ndarray:
    """y[n] = x[n] + alpha y[n - tau], by rows of tau."""
    n = len(x)
    y = np.zeros((-(-n // tau), tau))
    y.ravel()[:n] = x
    for r in range(1, len(y)):
        y[r] += alpha * y[r - 1]
    return y.ravel()[:n]


def comb_bank(x: np.ndarray, taus, alphas, backward: bool = True) -> np.ndarray:
    """A column for each tau."""
    alphas = np.broadcast_to(np.asarray(alphas, float), (len(taus),))
    if backward:
        return np.stack([comb_back(x, int(t), a) for t, a in zip(taus, alphas, strict=True)], 1)
    return np.stack([x + a * np.concatenate([np.zeros(min(t, len(x))), x[: max(0, len(x) - t)]]) for t, a in zip(map(int, taus), alphas, strict=True)], 1)


def comb_filterbank(b: DataFrame, taus: list[int], alpha: float = ALPHA, backward: bool = True) -> DataFrame:
    """(track_id, idx, tau, y) of a bank of comb filters."""

    def kernel(_, pdf):
        y = comb_bank(pdf["x"].to_numpy(float), taus, alpha, backward)
        return {"idx": np.repeat(pdf["idx"].to_numpy(), len(taus)), "tau": np.tile(taus, len(pdf)), "y": y.ravel()}

    return by_track(b, kernel, "idx long, tau long, y double")


def histogram_comb(b: DataFrame, low: int, high: int, alpha: float = ALPHA) -> DataFrame:
    """Each row credits its strongest comb filters with their output."""
    taus = np.arange(low, high + 1)

    def kernel(_, pdf):
        y = comb_bank(pdf["x"].to_numpy(float), taus, alpha)
        return {"tau": taus, "strength": np.where(y == y.max(1, keepdims=True), y, 0).sum(0)}

    return by_track(b, kernel, "tau long, strength double")


def beat_model(fps: float, low_bpm: float = 55.0, high_bpm: float = 215.0, tempi: int | None = None, steadiness: float = 100.0, share: float = 16.0):
    """Space and model of beats at changing tempo."""
    space = bar_space(1, 60 * fps / high_bpm, 60 * fps / low_bpm, tempi)
    return space, Model(bar_transitions(space, steadiness), beat_pointers(space, share))


def histogram_states(b: DataFrame, fps: float, low_bpm: float = 55.0, high_bpm: float = 215.0, share: float = 16.0, **options) -> DataFrame:
    """Rows at each interval on the best path of a beat model."""
    space, model = beat_model(fps, low_bpm, high_bpm, share=share, **options)
    taus = np.unique(space.intervals)

    def kernel(_, pdf):
        path, _p = model.viterbi(beat_densities(pdf["x"].to_numpy(float), share))
        return {"tau": taus, "strength": np.bincount(space.intervals[path], minlength=taus[-1] + 1)[taus].astype(float)}

    return by_track(b, kernel, "tau long, strength double")


def histogram_classes(rows: DataFrame, low_bpm: float = LOW_BPM, high_bpm: float = HIGH_BPM, column: str = "classes") -> DataFrame:
    """(track_id, tau, strength) from a network's array of one strength for each whole bpm; tau is in bpm."""
    e = rows.select("track_id", F.posexplode(column).alias("tau", "strength"))
    return e.where((F.col("tau") >= low_bpm) & (F.col("tau") <= high_bpm)).select("track_id", F.col("tau").cast("long").alias("tau"), F.col("strength").cast("double").alias("strength"))


def smoothed(histogram: DataFrame, size: int) -> DataFrame:
    """Hamming smoothing over tau."""
    h = sequence_of(histogram)
    from trackloom.operators.signals import hamming_smooth

    return hamming_smooth(h, size, "strength").select("track_id", "tau", F.col("smooth").alias("strength")) if size > 1 else histogram


def sequence_of(histogram: DataFrame) -> DataFrame:
    return histogram.withColumn("idx", F.row_number().over(Window.partitionBy("track_id").orderBy("tau")) - 1)


def dominant(histogram: DataFrame) -> DataFrame:
    """The strongest tau, the smallest on ties."""
    return histogram.groupBy("track_id").agg(F.max_by("tau", F.struct("strength", -F.col("tau"))).alias("tau"))


def tempi(histogram: DataFrame, fps: float | None = None) -> DataFrame:
    """(track_id, pos, tempo, strength): local maxima of the histogram bent into a circle, strongest first, strengths adding up to 1.

    Of equal peaks the longer tau comes first. A track without a peak has one row with a null tempo and strength 0. Without fps tau is the tempo.
    """
    w = Window.partitionBy("track_id")
    o = w.orderBy("tau")
    first, last = F.first("strength").over(o.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), F.last("strength").over(o.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    up, down = F.coalesce(F.lag("strength").over(o), last), F.coalesce(F.lead("strength").over(o), first)
    tempo = 60.0 * fps / F.col("tau") if fps else F.col("tau").cast("double")
    p = histogram.withColumn("_p", (F.col("strength") > up) & (F.col("strength") > down)).where("_p")
    total = F.sum("strength").over(w)
    share = F.when(F.count("*").over(w) == 1, 1.0).otherwise(F.col("strength") / total)
    p = p.select("track_id", (F.row_number().over(w.orderBy(F.desc("strength"), F.desc("tau"))) - 1).alias("pos"), tempo.alias("tempo"), share.alias("strength"))
    none = histogram.select("track_id").distinct().join(p.select("track_id").distinct(), "track_id", "left_anti")
    return p.unionByName(none.select("track_id", F.lit(0).alias("pos"), F.lit(None).cast("double").alias("tempo"), F.lit(0.0).alias("strength")))


def interpolated(histogram: DataFrame, step: float = 0.01) -> DataFrame:
    """The histogram on a finer grid of tau, by parabolas through three neighbours."""

    def kernel(_, pdf):
        x, y = pdf["tau"].to_numpy(float), pdf["strength"].to_numpy(float)
        if len(x) < 3:
            return {"tau": x, "strength": y}
        fine = np.arange(x[0], x[-1], step)
        k = np.clip(np.round((fine - x[0]) / (x[1] - x[0])).astype(int), 1, len(x) - 2)
        t = (fine - x[k]) / (x[1] - x[0])
        a, b, c = y[k - 1], y[k], y[k + 1]
        return {"tau": fine, "strength": b + t * (c - a) / 2 + t * t * (a - 2 * b + c) / 2}

    return by_track(histogram, kernel, "tau double, strength double", "tau")


def estimate(b: DataFrame, fps: float, method: str = "comb", low_bpm: float = LOW_BPM, high_bpm: float = HIGH_BPM, act_smooth: float | None = 0.14, hist_smooth: int = 9, fine: bool = False, **options) -> DataFrame:
    """tempi() of a track's activations. method: comb, acf or states."""
    from trackloom.operators.signals import hamming_smooth

    low, high = tau_range(fps, low_bpm, high_bpm)
    if act_smooth is not None and method != "states":
        b = hamming_smooth(b, int(round(fps * act_smooth))).select("track_id", "idx", F.col("smooth").alias("x"))
    if method == "comb":
        h = histogram_comb(b, low, high, **options)
    elif method == "acf":
        h = histogram_acf(b, low, high)
    elif method == "states":
        h = histogram_states(b, fps, low_bpm, high_bpm, **options)
    else:
        raise ValueError("method must be comb, acf or states")
    h = smoothed(h, hist_smooth)
    return tempi(interpolated(h) if fine else h, fps)

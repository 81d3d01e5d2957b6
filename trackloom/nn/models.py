"""Networks on tracks, and the spectra that the reference models take as input.

The weights of trained models are not part of the library: every recogniser takes a network.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.functions import pitch
from trackloom.nn.layers import Layer, padded
from trackloom.operators import filterbanks, hmm, spectra
from trackloom.operators.signals import frames as framed


def predict(rows: DataFrame, network: Layer, column: str = "features", order: str = "frame", pad: int = 0) -> DataFrame:
    """(track_id, frame, y): the network over each track's frames in order; one worker holds one track. pad: first and last frame are repeated so often, for networks that shorten their input."""

    def kernel(_, pdf):
        x = np.array(pdf[column].tolist(), float)
        y = np.asarray(network(padded(x, pad) if pad else x))
        y = (y.reshape(len(y), -1) if y.ndim else y.reshape(1, 1))[: len(x)]
        return {order: pdf[order].to_numpy()[: len(y)], "y": list(y)}

    return hmm.by_track(rows, kernel, f"{order} long, y array<double>", order)


def log_spectrum(signal: DataFrame, sample_rate: float, size: int, fps: float, per_octave: int = 12, low: float = 30.0, high: float = 17_000.0, mul: float = 1.0, add: float = 1.0, unique: bool = True) -> DataFrame:
    """(track_id, frame, m): framed, transformed, filtered on a logarithmic scale, logged."""
    grid = pitch.bin_grid(size // 2, sample_rate)
    bank = filterbanks.log_bank(grid, per_octave, low, high, unique=unique)
    s = spectra.stft(framed(signal, size, sample_rate / fps))
    return s.select("track_id", "frame", filterbanks.logged(filterbanks.filtered(spectra.magnitude("re", "im"), bank), mul, add).alias("m"))


def multi_resolution(signal: DataFrame, sample_rate: float, fps: float, sizes=(1024, 2048, 4096), per_octave=(6, 6, 6), ratio: float = 0.5, mul: float = 1.0, add: float = 1.0) -> DataFrame:
    """(track_id, frame, features): log spectra of several frame sizes, each with its positive difference, side by side."""
    out = None
    for k, (size, bands) in enumerate(zip(sizes, per_octave, strict=True)):
        s = log_spectrum(signal, sample_rate, size, fps, bands, mul=mul, add=add)
        s = spectra.difference(s, frames=spectra.diff_frames(ratio, sample_rate / fps, size))
        s = s.select("track_id", "frame", F.concat("m", "d").alias(f"f{k}"))
        out = s if out is None else out.join(s, ["track_id", "frame"])
    return out.select("track_id", "frame", F.concat(*[f"f{k}" for k in range(len(sizes))]).alias("features"))


def beat_activations(signal: DataFrame, network: Layer, sample_rate: float = 44_100.0, fps: float = 100.0, online: bool = False) -> DataFrame:
    sizes, bands = ((2048,), (12,)) if online else ((1024, 2048, 4096), (6, 6, 6))
    return predict(multi_resolution(signal, sample_rate, fps, sizes, bands), network)


def downbeat_activations(signal: DataFrame, network: Layer, sample_rate: float = 44_100.0, fps: float = 100.0) -> DataFrame:
    """Beat and downbeat; the network's first output, neither, goes."""
    found = predict(multi_resolution(signal, sample_rate, fps, per_octave=(3, 6, 12)), network)
    return found.select("track_id", "frame", F.get("y", 1).alias("beat"), F.get("y", 2).alias("downbeat"))


def onset_activations(signal: DataFrame, network: Layer, sample_rate: float = 44_100.0, fps: float = 100.0, online: bool = False) -> DataFrame:
    sizes = (512, 1024, 2048) if online else (1024, 2048, 4096)
    return predict(multi_resolution(signal, sample_rate, fps, sizes, ratio=0.25, mul=5.0), network)


def note_activations(signal: DataFrame, network: Layer, sample_rate: float = 44_100.0, fps: float = 100.0) -> DataFrame:
    """One output for each of 88 keys."""
    return predict(multi_resolution(signal, sample_rate, fps, per_octave=(12, 12, 12), mul=5.0), network)


def convolutional_activations(signal: DataFrame, network: Layer, sample_rate: float, size: int, fps: float, per_octave: int, low: float, high: float, pad: int, add: float = 1.0) -> DataFrame:
    """A network over padded log spectra, as convolutional models of beats, chords, keys and notes take them."""
    s = log_spectrum(signal, sample_rate, size, fps, per_octave, low, high, add=add, unique=True)
    return predict(s.withColumnRenamed("m", "features"), network, pad=pad)


def chroma(signal: DataFrame, network: Layer, sample_rate: float = 44_100.0, fps: float = 10.0, low: float = 65.0, high: float = 2100.0, context: int = 15) -> DataFrame:
    """Network chroma from log spectra, each frame with its neighbours."""
    from pyspark.sql.window import Window

    s = log_spectrum(signal, sample_rate, 8192, fps, 24, low, high)
    half = context // 2
    w = Window.partitionBy("track_id").orderBy("frame")
    near = [F.coalesce(F.lag("m", -d).over(w) if d else F.col("m"), F.transform("m", lambda _: F.lit(0.0))) for d in range(-half, half + 1)]
    return predict(s.select("track_id", "frame", F.concat(*near).alias("features")), network)


def chords(features: DataFrame, field: hmm.Field, fps: float = 10.0, column: str = "y") -> DataFrame:
    """Chord segments from features decoded by a conditional random field."""
    from trackloom.evaluation.chords import majmin_labels

    rows = features.withColumnRenamed("frame", "idx")
    found = hmm.labelled(rows, field, column).withColumnRenamed("idx", "frame").withColumnRenamed("state", "target")
    return majmin_labels(found, fps)


def bar_activations(perc: DataFrame, harm: DataFrame, beats: DataFrame, perc_network: Layer, harm_network: Layer, fps: float = 100.0, parts: tuple[int, int] = (4, 2)) -> DataFrame:
    """(track_id, idx, t, x): how likely each beat is a downbeat, the mean of a network over percussive and one over harmonic beat features; null for the last."""
    from pyspark.sql.window import Window

    from trackloom.operators.tracking import beat_subdivisions

    sides = []
    for f, n, p in ((perc, perc_network, parts[0]), (harm, harm_network, parts[1])):
        b = beat_subdivisions(f, beats, fps, p).groupBy("track_id", "beat").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("part", "features"))), lambda x: x["features"])).alias("features"))
        sides.append(predict(b, n, order="beat").select("track_id", "beat", F.get("y", 0).alias("y")))
    both = sides[0].join(sides[1].withColumnRenamed("y", "y2"), ["track_id", "beat"]).select("track_id", F.col("beat").alias("idx"), ((F.col("y") + F.col("y2")) / 2).alias("x"))
    numbered = beats.select("track_id", "t", (F.row_number().over(Window.partitionBy("track_id").orderBy("t")) - 1).cast("long").alias("idx"))
    return numbered.join(both, ["track_id", "idx"], "left").select("track_id", "idx", "t", "x")

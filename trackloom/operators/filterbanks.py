"""Filterbanks: matrices of bins x bands, built on the driver from a scale, and applied to arrays of magnitudes.

A bank is small and fixed, so it goes into the plan as one constant array of (first bin, weights) and is applied by array
functions inside the JVM: a narrow step without join or shuffle. ``rows`` gives it as a dimension table for joins.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.functions import pitch
from trackloom.functions.vectors import dot


def triangle(start: int, centre: int, stop: int, norm: bool = False) -> tuple[int, np.ndarray]:
    """(first bin, weights): rises from start to 1 at the centre and falls to stop, which is outside."""
    if not start <= centre < stop:
        raise ValueError("the centre must lie between start and stop")
    w = np.concatenate([np.arange(centre - start) / max(1, centre - start), 1 - np.arange(stop - centre) / (stop - centre)])
    return start, w / w.sum() if norm else w


def box(start: int, stop: int, norm: bool = False) -> tuple[int, np.ndarray]:
    if start >= stop:
        raise ValueError("start must be smaller than stop")
    w = np.ones(stop - start)
    return start, w / w.sum() if norm else w


def bank(filters: list, bins: int) -> np.ndarray:
    """bins x bands; a band of several filters takes their maximum, and what reaches over the edges is cut off."""
    out = np.zeros((bins, len(filters)))
    for k, band in enumerate(filters):
        for start, w in band if isinstance(band, list) else [band]:
            low, high = max(start, 0), min(start + len(w), bins)
            out[low:high, k] = np.maximum(out[low:high, k], w[low - start : high - start])
    return out


def triangles(corners: np.ndarray, bins: int, norm: bool = True, overlap: bool = True) -> np.ndarray:
    """A triangle on each three consecutive corners; one bin where they are too close."""
    out = []
    for a, b, c in zip(corners, corners[1:], corners[2:], strict=False):
        if not overlap:
            a, c = (a + b) // 2, -(-(b + c) // 2)
        if c - a < 2:
            b, c = a, a + 1
        out.append(triangle(int(a), int(b), int(c), norm))
    if not out:
        raise ValueError("not enough bins for a filter")
    return bank(out, bins)


def mel_bank(grid, bands: int = 40, low: float = 20.0, high: float = 17_000.0, norm: bool = True, unique: bool = True) -> np.ndarray:
    return triangles(pitch.nearest_bins(pitch.mel_grid(bands + 2, low, high), grid, unique), len(grid), norm)


def log_bank(grid, per_octave: int = 12, low: float = 30.0, high: float = 17_000.0, reference: float = pitch.A4, norm: bool = True, unique: bool = True) -> np.ndarray:
    return triangles(pitch.nearest_bins(pitch.log_grid(per_octave, low, high, reference), grid, unique), len(grid), norm)


def bark_bank(grid, double: bool = False, low: float = 20.0, high: float = 15_500.0, norm: bool = True) -> np.ndarray:
    corners = pitch.nearest_bins(pitch.bark_grid(low, high, double), grid, unique=True)
    return bank([box(int(a), int(b), norm) for a, b in zip(corners, corners[1:], strict=False)], len(grid))


def crossover_bank(grid, crossovers, low: float = 30.0, high: float = 17_000.0, norm: bool = True) -> np.ndarray:
    """Boxes between the crossover frequencies; bands without a bin stay empty."""
    corners = pitch.nearest_bins([low, *crossovers, high], grid)
    out = np.zeros((len(grid), len(corners) - 1))
    for k, (a, b) in enumerate(zip(corners, corners[1:], strict=False)):
        out[a:b, k] = 1 / (b - a) if norm and b > a else 1
    return out


def pitch_class_bank(grid, classes: int = 12, low: float = 100.0, high: float = 5000.0, reference: float = pitch.A4) -> np.ndarray:
    """Each bin belongs to its nearest pitch class."""
    grid = np.asarray(grid, float)
    out = np.zeros((len(grid), classes))
    inside = np.flatnonzero((grid >= max(low, 1e-9)) & (grid <= high))
    out[inside, np.round(classes * np.log2(grid[inside] / reference)).astype(int) % classes] = 1
    return out


def harmonic_pitch_class_bank(grid, classes: int = 36, low: float = 100.0, high: float = 5000.0, reference: float = pitch.A4, window: float = 4) -> np.ndarray:
    """Each bin counts for the classes within half a window around it, by a squared cosine."""
    grid = np.asarray(grid, float)
    out = np.zeros((len(grid), classes))
    inside = np.flatnonzero((grid >= max(low, 1e-9)) & (grid <= high))
    place = classes * np.log2(grid[inside] / reference) % classes
    apart = (place[:, None] - np.arange(classes) + classes / 2) % classes - classes / 2
    out[inside] = np.where(np.abs(apart) < window / 2, np.cos(apart * np.pi / window) ** 2, 0)
    return out


def chroma_bank(grid, low: float = 30.0, high: float = 17_000.0, reference: float = pitch.A4) -> np.ndarray:
    """Semitone triangles folded into an octave, each class summing to 1."""
    semitones = log_bank(grid, 12, low, high, reference)
    out = np.zeros((len(grid), 12))
    for k in range(semitones.shape[1]):
        out[:, k % 12] += semitones[:, k]
    return out / np.maximum(out.sum(0), 1e-300)


def corners(weights: np.ndarray, grid) -> list[tuple[float, float, float]]:
    """Lowest, centre and highest frequency of each band."""
    out = []
    for w in weights.T:
        inside = np.flatnonzero(w)
        a, b = inside[0], inside[-1]
        centre = (a + b) // 2 if w[a] == w[b] else a + int(w[a:b].argmax())
        out.append((float(grid[a]), float(grid[centre]), float(grid[b])))
    return out


def rows(spark: SparkSession, weights: np.ndarray) -> DataFrame:
    """The bank as a dimension table (band, bin, weight) of its non-zero weights."""
    b, k = np.nonzero(weights)
    return spark.createDataFrame([(int(y), int(x), float(weights[x, y])) for x, y in zip(b, k, strict=True)], "band long, bin long, weight double")


def constant(weights: np.ndarray) -> Column:
    """array<struct<first, weights>>: each band from its first to its last non-zero bin."""
    out = []
    for w in weights.T:
        inside = np.flatnonzero(w)
        a, b = (inside[0], inside[-1] + 1) if len(inside) else (0, 1)
        out.append(F.struct(F.lit(int(a) + 1).alias("first"), F.array(*[F.lit(float(x)) for x in w[a:b]]).alias("w")))
    return F.array(*out)


def filtered(magnitudes: Column | str, weights: np.ndarray) -> Column:
    """The bands' sums of weighted magnitudes."""
    m = F.col(magnitudes) if isinstance(magnitudes, str) else magnitudes
    return F.transform(constant(weights), lambda b: dot(F.slice(m, b["first"], F.size(b["w"])), b["w"]))


def logged(values: Column | str, mul: float = 1.0, add: float = 1.0) -> Column:
    """log10(mul * x + add) of each."""
    return F.transform(values, lambda x: F.log10(mul * x.cast("double") + add))

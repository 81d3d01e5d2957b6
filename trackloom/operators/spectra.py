"""Spectra of frames (track_id, frame, samples) and functions on them.

The transform itself is a numpy kernel on Arrow batches, narrow over frames. All that follows is array functions on the rows
(track_id, frame, re, im / m / phase): differences look back with ``lag`` over the one partitioning by track.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trackloom.functions.pitch import A4, wrapped

EPSILON = float(np.spacing(1))


def stft(frames: DataFrame, window: str | None = "hann", fft_size: int | None = None, circular: bool = False, nyquist: bool = False, scale: float = 1.0) -> DataFrame:
    """(track_id, frame, re, im): the lower half of each frame's transform, zero-padded to fft_size.

    circular: the frame's middle is moved to the front first, so phases refer to it. scale divides integer samples.
    """
    schema = frames.select("track_id", "frame").withColumn("re", F.array(F.lit(0.0))).withColumn("im", F.array(F.lit(0.0))).schema
    shape = {"hann": np.hanning, "hamming": np.hamming, None: np.ones}[window]

    def work(batches):
        import pyarrow as pa

        for b in batches:
            if not b.num_rows:
                continue
            x = np.array(b.column(2).to_pylist(), float)
            n, size = x.shape[1], fft_size or x.shape[1]
            x = x * (shape(n) / scale)
            if circular:
                padded = np.zeros((len(x), max(size, n)))
                padded[:, : n - n // 2], padded[:, padded.shape[1] - n // 2 :] = x[:, n // 2 :], x[:, : n // 2]
                x = padded
            z = np.fft.rfft(x, size, axis=1)[:, : size // 2 + nyquist]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(list(p), pa.list_(pa.float64())) for p in (z.real, z.imag))], names=schema.names)

    return frames.select("track_id", "frame", "samples").mapInArrow(work, schema)


def magnitude(re: Column | str, im: Column | str) -> Column:
    return F.zip_with(re, im, lambda a, b: F.sqrt(a * a + b * b))


def phase(re: Column | str, im: Column | str) -> Column:
    return F.zip_with(re, im, lambda a, b: F.atan2(b, a))


def group_delay(phases: Column | str) -> Column:
    """Unwrapped difference of each bin's phase to the next one's; the last bin has 0."""
    p = F.col(phases) if isinstance(phases, str) else phases
    step = F.zip_with(p, F.slice(p, F.lit(2), F.size(p)), lambda a, b: F.when(b.isNull(), 0.0).otherwise(-unwrapped_step(b - a)))
    return step


def unwrapped_step(d: Column) -> Column:
    """The difference in (-pi, pi] that equals d but for whole turns, of d's sign at half a turn."""
    w = wrapped(d)
    w = F.when((w == -np.pi) & (d > 0), F.lit(np.pi)).otherwise(w)
    return F.when(F.abs(d) < np.pi, d).otherwise(w)


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


def mean(values: Column) -> Column:
    return total(values) / F.size(values)


def doubles(values: Column | str) -> Column:
    return F.transform(values, lambda x: x.cast("double"))


def in_frames():
    return Window.partitionBy("track_id").orderBy("frame")


def before(values: Column | str, frames: int = 1) -> Column:
    """The same array so many frames earlier; null at the start."""
    return F.lag(values, frames).over(in_frames())


def max_bins(values: Column | str, size: int) -> Column:
    """Moving maximum over size bins, cut off at the ends; of even sizes the longer half lies below."""
    low, high = size // 2, (size - 1) // 2
    v = F.col(values) if isinstance(values, str) else values
    return F.transform(v, lambda _, k: F.array_max(F.slice(v, F.greatest(k - low, F.lit(0)) + 1, F.least(k + high, F.size(v) - 1) - F.greatest(k - low, F.lit(0)) + 1)))


def difference(s: DataFrame, *, frames: int = 1, bins: int = 1, positive: bool = True, column: str = "m", name: str = "d") -> DataFrame:
    """m minus m so many frames earlier, that maximum-filtered over bins; the first frames have zeros."""
    past = before(max_bins(doubles(column), bins) if bins > 1 else doubles(column), frames)
    s = s.withColumn("_past", past)
    d = F.zip_with(doubles(column), "_past", lambda a, b: F.greatest(a - b, F.lit(0.0)) if positive else a - b)
    return s.withColumn(name, F.when(F.col("_past").isNull(), F.transform(column, lambda _: F.lit(0.0))).otherwise(d)).drop("_past")


def diff_frames(ratio: float, hop: float, size: int, window=np.hanning) -> int:
    """Frames apart at which windows have fallen to a ratio of their top; 1 at least."""
    w = np.asarray(window(size))
    below = size / 2 - int(np.argmax(w > ratio * w.max()))
    return int(max(1, round(below / hop)))


def bands(s: DataFrame, weights: np.ndarray, column: str = "m", name: str = "bands") -> DataFrame:
    from trackloom.operators.filterbanks import filtered

    return s.withColumn(name, filtered(column, weights))


def cepstrum(values: Column | str, n: int, coefficients: int) -> Column:
    from trackloom.functions.vectors import dct

    return dct(values, n, coefficients)


def chroma_fold(values: Column | str, per_class: int = 3) -> Column:
    """ln(1 + sum) of the bins of each pitch class, per_class bins a semitone."""
    return F.transform(F.sequence(F.lit(0), F.lit(11)), lambda c: F.log1p(total(F.filter(F.transform(values, lambda x, k: F.when(F.pmod(F.floor(k / per_class), F.lit(12)) == c, x.cast("double"))), lambda x: x.isNotNull()))))


def compressed_chroma(values: Column | str, lowest: int = 21, factor: float = 100.0, threshold: float = 0.001) -> Column:
    """Energies of semitones from note number ``lowest`` folded to 12 classes by log10(1 + C x), normed to 1; below the threshold all classes are equal."""
    own = lambda c: F.filter(F.transform(values, lambda x, k: F.when((k + lowest) % 12 == c, F.log10(factor * x.cast("double") + 1))), lambda x: x.isNotNull())
    folded = F.transform(F.sequence(F.lit(0), F.lit(11)), lambda c: total(own(c)))
    norm = F.sqrt(total(F.transform(folded, lambda x: x * x)))
    return F.transform(folded, lambda x: F.when(norm < threshold, 1 / np.sqrt(12)).otherwise(x / norm))


def tuning(s: DataFrame, grid, bins: int = 15, reference: float = A4) -> DataFrame:
    """Tuning frequency by track: magnitudes binned by their distance from the nearest semitone; the middle of the fullest bin.

    The grid's bin 0 Hz is left out; of equal bins the lowest wins.
    """
    grid = np.asarray(grid, float)
    place = np.zeros(len(grid))
    place[grid > 0] = 12 * np.log2(grid[grid > 0] / reference)
    deviation = place - np.round(place)
    edge = 0.5 + 0.5 / bins
    edges = np.linspace(-edge, edge, bins + 1)
    cell = np.clip(np.searchsorted(edges, deviation, side="right") - 1, 0, bins - 1)
    cells = F.array(*[F.lit(int(c) if f > 0 else -1) for c, f in zip(cell, grid, strict=True)])
    j = s.select("track_id", F.explode(F.arrays_zip(F.transform("m", lambda x: x.cast("double")).alias("m"), cells.alias("c"))).alias("z"))
    h = j.where("z.c >= 0").groupBy("track_id", F.col("z.c").alias("c")).agg(F.sum("z.m").alias("w"))
    best = h.groupBy("track_id").agg(F.max_by("c", F.struct("w", -F.col("c"))).alias("c"))
    middle = -edge + (F.col("c") + 0.5) * 2 * edge / bins
    return best.select("track_id", (reference * F.pow(F.lit(2.0), middle / 12)).alias("tuning"))


def mirrored_median(x: np.ndarray, size: int, axis: int) -> np.ndarray:
    """Moving median, the array mirrored at its ends; of even sizes the upper middle."""
    low, high = size // 2, (size - 1) // 2
    wide = np.pad(x, [(low, high) if k == axis else (0, 0) for k in range(x.ndim)], mode="symmetric")
    return np.sort(np.lib.stride_tricks.sliding_window_view(wide, size, axis), -1)[..., size // 2]


def harmonic_percussive(s: DataFrame, time: int = 15, frequency: int = 15, power: float | None = None) -> DataFrame:
    """(track_id, frame, harmonic, percussive): m masked by where its median over frames exceeds that over bins, and the other way.

    power: soft masks instead, of the medians' powers. A dense kernel over each track's frames.
    """

    def work(pdf):
        pdf = pdf.sort_values("frame")
        m = np.array(pdf["m"].tolist(), float)
        h, p = mirrored_median(m, time, 0), mirrored_median(m, frequency, 1)
        if power is None:
            first, second = h > p, p >= h
        else:
            h, p = h**power, p**power
            both = np.where(h + p > 0, h + p, 1)
            first, second = h / both, p / both
        out = pdf[["track_id", "frame"]].copy()
        out["harmonic"], out["percussive"] = list(m * first), list(m * second)
        return out

    schema = s.select("track_id", "frame").withColumn("harmonic", F.array(F.lit(0.0))).withColumn("percussive", F.array(F.lit(0.0))).schema
    return s.groupBy("track_id").applyInPandas(work, schema)


# --- onset functions: one value for each frame, every frame kept -----------------------------------------------------------------


def high_frequency_content(s: DataFrame) -> DataFrame:
    """Mean of magnitude times bin number."""
    return s.select("track_id", "frame", mean(F.transform("m", lambda x, k: x.cast("double") * k)).alias("y"))


def spectral_flux(s: DataFrame, frames: int = 1) -> DataFrame:
    return difference(s, frames=frames).select("track_id", "frame", total(F.col("d")).alias("y"))


def spectral_diff(s: DataFrame, frames: int = 1) -> DataFrame:
    return difference(s, frames=frames).select("track_id", "frame", total(F.transform("d", lambda x: x * x)).alias("y"))


def superflux(s: DataFrame, frames: int = 1, bins: int = 3) -> DataFrame:
    return difference(s, frames=frames, bins=bins).select("track_id", "frame", total(F.col("d")).alias("y"))


def modified_kullback_leibler(s: DataFrame, frames: int = 1, epsilon: float = EPSILON) -> DataFrame:
    """Mean of ln(1 + x / (earlier x + epsilon)); the first frames have 0."""
    j = s.withColumn("_past", before("m", frames))
    y = mean(F.zip_with(doubles("m"), "_past", lambda a, b: F.log1p(a / (b.cast("double") + epsilon))))
    return j.select("track_id", "frame", F.coalesce(y, F.lit(0.0)).alias("y"))


def correlation_diff(s: DataFrame, frames: int = 1, bins: int = 1, positive: bool = False) -> DataFrame:
    """Each frame minus the earlier one moved by up to ``bins`` bins to where both correlate best; zeros at the edge bins and in the first frames."""
    n = F.size("m")
    j = s.withColumn("_m", doubles("m")).withColumn("_past", before(doubles("m"), frames))

    def moved(k: int) -> Column:
        """The earlier frame read k bins higher."""
        return F.transform("_m", lambda _, i: F.coalesce(F.when((i + k >= 0) & (i + k < n), F.get("_past", i + k)), F.lit(0.0)))

    shifts = [0] + [x for k in range(1, bins + 1) for x in (k, -k)]
    scored = F.array(*[F.struct(total(F.zip_with("_m", moved(k), lambda a, b: a * b)).alias("c"), F.lit(-p).alias("p"), moved(k).alias("v")) for p, k in enumerate(shifts)])
    j = j.withColumn("_best", F.array_max(scored)["v"])
    value = F.zip_with("_m", "_best", lambda a, b: F.greatest(a - b, F.lit(0.0)) if positive else a - b)
    inner = F.transform(value, lambda x, k: F.when((k >= bins) & (k < n - bins), x).otherwise(0.0))
    return j.select("track_id", "frame", F.when(F.col("_past").isNull(), F.transform("_m", lambda _: F.lit(0.0))).otherwise(inner).alias("d"))


def with_phase_deviation(s: DataFrame) -> DataFrame:
    """deviation: the wrapped second difference of phase; the first two frames have zeros."""
    j = s.withColumn("_a", before("phase", 1)).withColumn("_b", before("phase", 2))
    second = F.zip_with(F.zip_with(doubles("phase"), "_a", lambda p, a: p - 2 * a), "_b", lambda x, b: wrapped(x + b))
    return j.withColumn("deviation", F.when(F.col("_b").isNull(), F.transform("phase", lambda _: F.lit(0.0))).otherwise(second)).drop("_a", "_b")


def phase_deviation(s: DataFrame) -> DataFrame:
    return with_phase_deviation(s).select("track_id", "frame", mean(F.transform("deviation", F.abs)).alias("y"))


def weighted_phase_deviation(s: DataFrame) -> DataFrame:
    return with_phase_deviation(s).select("track_id", "frame", mean(F.zip_with("deviation", "m", lambda d, m: F.abs(d * m.cast("double")))).alias("y"))


def normalized_weighted_phase_deviation(s: DataFrame, epsilon: float = EPSILON) -> DataFrame:
    j = with_phase_deviation(s)
    weighted = mean(F.zip_with("deviation", "m", lambda d, m: F.abs(d * m.cast("double"))))
    return j.select("track_id", "frame", (weighted / (mean(doubles("m")) + epsilon)).alias("y"))


def with_complex_deviation(s: DataFrame) -> DataFrame:
    """cd: distance of each bin from the value that the frame before foretells: its magnitude, its phase moved on by the last step."""
    j = s.withColumn("_m1", before(doubles("m"), 1)).withColumn("_p1", before(doubles("phase"), 1)).withColumn("_p2", before(doubles("phase"), 2))
    # A frame with one predecessor only has a target phase of 0.
    target = F.when(F.col("_p2").isNull(), F.transform("_p1", lambda _: F.lit(0.0))).otherwise(F.zip_with("_p1", "_p2", lambda a, b: 2 * a - b))
    j = j.withColumn("_t", target)
    cells = F.arrays_zip(doubles("m").alias("m"), doubles("phase").alias("p"), F.col("_m1"), F.col("_t"))
    dist = F.transform(cells, lambda c: F.sqrt(F.greatest(c["m"] * c["m"] + c["_m1"] * c["_m1"] - 2 * c["m"] * c["_m1"] * F.cos(c["p"] - c["_t"]), F.lit(0.0))))
    return j.withColumn("cd", F.when(F.col("_m1").isNull(), F.transform("m", lambda x: F.abs(x.cast("double")))).otherwise(dist)).drop("_m1", "_p1", "_p2", "_t")


def complex_domain(s: DataFrame) -> DataFrame:
    return with_complex_deviation(s).select("track_id", "frame", total(F.col("cd")).alias("y"))


def rectified_complex_domain(s: DataFrame, frames: int = 1) -> DataFrame:
    """Only bins that rise count."""
    j = difference(with_complex_deviation(s), frames=frames)
    return j.select("track_id", "frame", total(F.zip_with("cd", "d", lambda c, d: F.when(d > 0, c).otherwise(0.0))).alias("y"))


def complex_flux(s: DataFrame, frames: int = 1, bins: int = 3, temporal: int = 3) -> DataFrame:
    """Superflux damped by the local group delay: greatest over ``temporal`` frames, least over three bins, in units of half a turn."""
    j = s.withColumn("_g", F.transform(group_delay(doubles("phase")), lambda x: F.abs(x) / np.pi))
    low, high = temporal // 2, (temporal - 1) // 2
    near = F.collect_list("_g").over(in_frames().rowsBetween(-low, high))
    j = j.withColumn("_near", near)
    j = j.withColumn("_g", F.transform("_g", lambda _, k: F.array_max(F.transform("_near", lambda f: F.get(f, k)))))
    n = F.size("_g")
    mask = F.transform("_g", lambda _, k: F.array_min(F.slice("_g", F.greatest(k - 1, F.lit(0)) + 1, F.least(k + 1, n - 1) - F.greatest(k - 1, F.lit(0)) + 1)))
    j = difference(j.withColumn("_mask", mask), frames=frames, bins=bins)
    return j.select("track_id", "frame", total(F.zip_with("d", "_mask", lambda d, k: d * k)).alias("y"))


ONSET_FUNCTIONS = {
    f.__name__: f for f in (
        superflux, complex_flux, high_frequency_content, spectral_diff, spectral_flux, modified_kullback_leibler,
        phase_deviation, weighted_phase_deviation, normalized_weighted_phase_deviation, complex_domain, rectified_complex_domain,
    )
}


def onset_function(s: DataFrame, method: str = "spectral_flux", **options) -> DataFrame:
    """One of ONSET_FUNCTIONS by name."""
    if method not in ONSET_FUNCTIONS:
        raise ValueError(f"{method} is none of {', '.join(ONSET_FUNCTIONS)}")
    return ONSET_FUNCTIONS[method](s, **options)

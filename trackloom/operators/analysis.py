"""Whole analyses of tracks of beats: from features by beat to segments, jump candidates and the tables that playing needs.

Beats are rows (track_id, idx, t, rms, centroid, mfcc, chroma, downbeat), idx from 0 without gaps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trackloom.operators import filterbanks, graph, jumps, pooling, sequence, spectra, structure
from trackloom.sources.scratch import kept

CHROMA_WEIGHT, MFCC_WEIGHT, RMS_WEIGHT = 0.45, 0.52, 1.4
MU_FLOOR = 0.3


def feature(b: DataFrame, *columns: str) -> DataFrame:
    """(track_id, i, v): arrays of a beat as one."""
    return b.select("track_id", F.col("idx").alias("i"), structure.fused(b, *columns).alias("v"))


def cut_fade(b: DataFrame) -> DataFrame:
    """Beats up to where the track fades out."""
    kept = sequence.fade_cut(b.select("track_id", "idx", "t", F.col("rms").alias("x"))).select("track_id", "idx")
    return b.join(kept, ["track_id", "idx"], "left_semi")


def jump_edges(b: DataFrame, k: int = 10, lag: int = 8) -> DataFrame:
    """The similarity graph of z-scored features, each beat with its successors."""
    return graph.jump_graph(structure.lagged(structure.zscored(feature(b, "mfcc", "chroma")), lag), k)


def assembled(b: DataFrame, labels: DataFrame, edges: DataFrame, prune: bool = True) -> tuple[DataFrame, DataFrame]:
    """(beats, segments): beats with duration, bar position, label, segment, place in it, quartile, candidates, energy and novelty over their maxima.

    labels: (track_id, i, label, novelty); edges: candidates (track_id, src, dst, rank). prune: beats at the end that have none go.
    """
    j = b.join(labels.withColumnRenamed("i", "idx"), ["track_id", "idx"])
    rows, left = jumps.pruned(j, edges) if prune else (j, edges)
    rows = kept(sequence.quartiles(sequence.durations(sequence.with_runs(rows))), "rows")
    rows = pooling.over_maximum(pooling.over_maximum(rows, "rms", "energy"), "novelty")
    rows = jumps.nested(rows, left, "rank")
    out = rows.select("track_id", F.col("idx").alias("id"), F.col("t").alias("start"), "duration", "bar_position", F.col("label").alias("cluster"), F.col("run").alias("segment"), F.col("place").alias("intra_segment_index"), "quartile", "energy", "centroid", "novelty", F.col("candidates").alias("jump_candidates"))
    return out, sequence.run_segments(rows.select("track_id", "idx", "t", "label"))


def analyze(b: DataFrame, kernel: int = 64, sigma: float = 4.0, win: int = 16, alpha: float = 1.25, apart: int = 16, k: int = 10, lag: int = 8) -> tuple[DataFrame, DataFrame]:
    """The live analysis: fade cut, bars, segments between novelty peaks, similarity graph, candidates in phase, pruned tail."""
    b = kept(sequence.bar_positions(cut_fade(b), F.col("downbeat")), "beats")
    bars = b.select("track_id", "idx", "bar_position")
    labels = kept(structure.segment_by_novelty(feature(b, "mfcc", "chroma"), bars, kernel, sigma, win, alpha, apart), "labels")
    return assembled(b, labels, kept(jumps.from_graph(kept(jump_edges(b, k, lag), "graph"), bars), "candidates"))


def weighted_features(b: DataFrame) -> DataFrame:
    """Chroma, MFCC and the first MFCC, z-scored and weighted."""
    scaled = lambda c, w: F.transform(c, lambda x: x.cast("double") * w)
    z = structure.zscored(feature(b.withColumn("_first", F.slice("mfcc", 1, 1)), "chroma", "mfcc", "_first"))
    n, m = F.size("v"), 12
    parts = F.concat(scaled(F.slice("v", 1, m), CHROMA_WEIGHT), scaled(F.slice("v", F.lit(m + 1), n - m - 1), MFCC_WEIGHT), scaled(F.slice("v", n, F.lit(1)), RMS_WEIGHT))
    return z.withColumn("v", parts)


def filtered_recurrence(edges: DataFrame, frames: DataFrame) -> DataFrame:
    """Edges after the diagonal median filter, as wide as each track's densest diagonal asks for."""
    width = structure.diagonal_density(edges, frames).select("track_id", structure.filter_width(F.col("density")).alias("_w"))
    return structure.diagonal_median(edges, frames.select("track_id").join(width, "track_id"), F.col("_w"))


def analyze_spectral(b: DataFrame, strategy: str = "eigengap", k: int | None = None, smooth: int = 8) -> DataFrame:
    """(track_id, i, label, k): clusters of the graph of repetitions and path, its labels smoothed by a mode filter."""
    f = kept(weighted_features(b), "features")
    edges = kept(filtered_recurrence(kept(graph.recurrence(f), "recurrence"), f), "filtered")
    repetition = kept(structure.repetition_affinity(edges, feature(b, "chroma")), "repetition")
    path = kept(structure.path_affinity(feature(b, "mfcc")), "path")
    affinity = kept(structure.combined_affinity(path, repetition, structure.balance(path, repetition, MU_FLOOR)), "affinity")
    found = kept(structure.spectral_clusters(affinity, f, strategy, k), "clusters")
    smoothed = sequence.mode_filter(found.withColumnRenamed("i", "idx"), smooth // 2)
    return smoothed.select("track_id", F.col("idx").alias("i"), F.col("mode").alias("label"), "k")


def analyze_older(b: DataFrame, with_bars: bool = False) -> tuple[DataFrame, DataFrame]:
    """The older analyses: clusters by their own fitness scores, candidates by label, place and phase. with_bars: the second one."""
    b = kept(sequence.bar_positions(b, F.col("downbeat")), "beats")
    labels = analyze_spectral(b, "v2" if with_bars else "v1").withColumn("novelty", F.lit(0.0)).drop("k")
    cut = sequence.fade_cut_by_mean(b.select("track_id", "idx", F.col("rms").alias("x"))).select("track_id", "idx")
    b = b.join(cut, ["track_id", "idx"], "left_semi")
    labelled = kept(b.join(labels.withColumnRenamed("i", "idx"), ["track_id", "idx"]), "labelled")
    edges = kept(jumps.candidates_v2(labelled) if with_bars else jumps.candidates_v1(labelled), "candidates")
    return assembled(b, labels, edges.withColumn("rank", F.col("dst")), prune=False)


def similarity_report(edges: DataFrame, share: tuple[float, ...] = (0.5, 0.75, 0.85, 0.95), bins: int = 10) -> DataFrame:
    """(track_id, percentiles, histogram) of an edge table's similarities: discrete percentiles, and counts by tenths of [0, 1]."""
    p = edges.groupBy("track_id").agg(F.array(*[F.expr(f"percentile_disc({s}) within group (order by sim)") for s in share]).alias("percentiles"))
    cell = F.least(F.greatest(F.floor(F.col("sim") * bins), F.lit(0)), F.lit(bins - 1))
    h = edges.groupBy("track_id", cell.alias("b")).agg(F.count("*").alias("n")).groupBy("track_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("b", "n")))).alias("h"))
    counts = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long")), lambda k: F.coalesce(F.try_element_at("h", k), F.lit(0).cast("long")))
    return p.join(h, "track_id").select("track_id", "percentiles", counts.alias("histogram"))


def log_filtered(frames: DataFrame, bank) -> DataFrame:
    """(track_id, frame, features): filtered and logged magnitudes, beside half of what each has risen by."""
    s = spectra.stft(frames).select("track_id", "frame", filterbanks.logged(filterbanks.filtered(spectra.magnitude("re", "im"), bank)).alias("m"))
    d = spectra.difference(s)
    return d.select("track_id", "frame", F.concat("m", F.transform("d", lambda x: x * 0.5)).alias("features"))


def read_bank(spark, path: str):
    """A filterbank from a JSON file of rows of weights."""
    import numpy as np

    rows = spark.read.text(path, wholetext=True).select(F.from_json("value", "array<array<double>>").alias("w")).first()["w"]
    return np.array(rows)


def cuts(frames: DataFrame, size: int = 1500, border: int = 6) -> DataFrame:
    """(track_id, start, frame, at): the overlapping windows that a model is run on, with each frame's place in its window.

    Windows begin ``border`` before the track and stand size - 2 border apart; the last one ends border behind the track, if the track is longer than that.
    """
    step = size - 2 * border
    n = frames.groupBy("track_id").agg((F.max("frame") + 1).alias("n"))
    count = F.ceil(F.col("n") / step).cast("int")
    starts = F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.when((k == count - 1) & (F.col("n") > step), F.col("n") - size + border).otherwise(k * step - border))
    w = n.select("track_id", "n", F.explode(starts).alias("start"))
    inside = w.withColumn("frame", F.explode(F.sequence(F.greatest("start", F.lit(0)), F.least(F.col("start") + size, F.col("n")) - 1)))
    return inside.select("track_id", "start", "frame", (F.col("frame") - F.col("start")).cast("int").alias("at"))


def joined_cuts(outputs: DataFrame, size: int = 1500, border: int = 6) -> DataFrame:
    """(track_id, frame, value) of window outputs (track_id, start, frame, at, value): borders go, and where windows overlap the earlier one holds."""
    inner = outputs.where((F.col("at") >= border) & (F.col("at") < size - border))
    return inner.groupBy("track_id", "frame").agg(F.min_by("value", "start").alias("value"))


def sliding_transform(signal: DataFrame, sample_rate: float, low: float, per_octave: int, octaves: int, hop: int = 512) -> DataFrame:
    """(track_id, frame, m): magnitudes of a transform at constant quality, every ``hop`` samples.

    Each bin looks back as many samples as its quality times its period; the window is a Hann bell. A dense kernel of one track.
    """
    import numpy as np

    from trackloom.operators.hmm import by_track

    frequencies = low * 2.0 ** (np.arange(per_octave * octaves) / per_octave)
    quality = 1 / (2 ** (1 / per_octave) - 1)
    lengths = np.maximum(1, np.round(quality * sample_rate / frequencies)).astype(int)

    def kernel(_, pdf):
        x = pdf["x"].to_numpy(float)
        ends = np.arange(hop, len(x), hop)[: len(x) // hop]
        out = np.zeros((len(ends), len(frequencies)))
        wide = np.concatenate([np.zeros(lengths.max()), x])
        for k, (f, n) in enumerate(zip(frequencies, lengths, strict=True)):
            bell = np.hanning(n + 2)[1:-1]
            wave = bell / bell.sum() * np.exp(-2j * np.pi * f * np.arange(n) / sample_rate)
            at = ends + lengths.max() + 1 - n
            out[:, k] = [abs(wide[a : a + n] @ wave) for a in at]
        return {"frame": np.arange(len(ends)), "m": list(out)}

    return by_track(signal, kernel, "frame long, m array<double>")


def chunk_of(play: DataFrame, beats: DataFrame) -> DataFrame:
    """(track_id, step, first, last): the sample range that each step of a walk (track_id, step, beat) sends."""
    return play.join(beats.select("track_id", F.col("idx").alias("beat"), "first", "last"), ["track_id", "beat"]).select("track_id", "step", "first", "last")


def message(beat: Column, segment: Column, place: Column, length: Column, payload: Column) -> Column:
    """A broadcast frame: four little-endian 32-bit numbers before the payload."""
    number = lambda c: F.unhex(F.concat(*[F.lpad(F.hex(F.shiftright(c.cast("long"), 8 * k).bitwiseAND(F.lit(255))), 2, "0") for k in range(4)]))
    return F.concat(number(beat), number(segment), number(place), number(length), payload)


def last_command(commands: DataFrame) -> DataFrame:
    """(session, paused, stopped, decibel): the state that a session's commands (session, n, command, volume) leave; the last of each kind wins, and nothing counts behind a stop."""
    w = Window.partitionBy("session")
    c = commands.withColumn("_stop", F.min(F.when(F.col("command") == "stop", F.col("n"))).over(w)).where(F.col("_stop").isNull() | (F.col("n") <= F.col("_stop")))
    volume = F.max_by("volume", F.when(F.col("command") == "volume", F.col("n")))
    return c.groupBy("session").agg(
        F.coalesce(F.max_by(F.col("command") == "pause", F.when(F.col("command").isin("pause", "resume"), F.col("n"))), F.lit(False)).alias("paused"),
        F.bool_or(F.col("command") == "stop").alias("stopped"), F.when(volume <= 0.001, -80.0).otherwise(20 * F.log10(volume)).alias("decibel"),
    )

"""Operators along a track: runs, durations, filters, peaks, cuts. All rows carry (track_id, idx), which is a total order.

Every operator keeps the one partitioning by track, so a chain of them shuffles once. Nulls in x are skipped by the window
aggregates; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec


def in_order() -> WindowSpec:
    return whole().orderBy("idx")


def whole() -> WindowSpec:
    return Window.partitionBy("track_id")


def with_runs(b: DataFrame, label: str = "label") -> DataFrame:
    """Adds run (number of the run of equal labels) and place (position in it)."""
    changed = F.coalesce((F.col(label) != F.lag(label).over(in_order())).cast("long"), F.lit(0))
    out = b.withColumn("run", F.sum(changed).over(in_order()))
    return out.withColumn("place", (F.row_number().over(Window.partitionBy("track_id", "run").orderBy("idx")) - 1).cast("long"))


def run_segments(b: DataFrame) -> DataFrame:
    """One row per run; it ends where the next begins, the last one at its last row."""
    s = with_runs(b).groupBy("track_id", "run").agg(F.min("label").alias("label"), F.min("t").alias("start_time"), F.max("t").alias("last"), F.count("*").alias("n_beats"))
    w = Window.partitionBy("track_id").orderBy("run")
    return s.select("track_id", F.col("run").alias("segment"), "label", "start_time", F.coalesce(F.lead("start_time").over(w), F.col("last")).alias("end_time"), "n_beats")


def run_stats(b: DataFrame, drop_last: bool = False) -> DataFrame:
    """Runs, runs per label and shortest run of each track; drop_last leaves the last run out of the minimum (null if it is the only one)."""
    s = run_segments(b).withColumn("last", F.max("segment").over(whole()))
    size = F.when(F.col("segment") < F.col("last"), F.col("n_beats")) if drop_last else F.col("n_beats")
    return s.groupBy("track_id").agg(F.count("*").alias("runs"), (F.count("*") / F.countDistinct("label")).alias("ratio"), F.min(size).alias("shortest"))


def longest_run(b: DataFrame) -> DataFrame:
    """Length and first idx of the longest run, the first on ties."""
    s = with_runs(b).groupBy("track_id", "run").agg(F.count("*").alias("n"), F.min("idx").alias("first"))
    return s.groupBy("track_id").agg(F.max("n").alias("length"), F.max_by("first", F.struct("n", -F.col("first"))).alias("first"))


def durations(b: DataFrame) -> DataFrame:
    """Seconds to the next row; the last one has 0."""
    return b.withColumn("duration", F.coalesce(F.lead("t").over(in_order()) - F.col("t"), F.lit(0.0)))


def intervals(b: DataFrame) -> DataFrame:
    """Seconds since the row before; the first copies its successor."""
    return b.withColumn("interval", F.coalesce(F.col("t") - F.lag("t").over(in_order()), F.lead("t").over(in_order()) - F.col("t")))


def quartiles(b: DataFrame) -> DataFrame:
    return b.withColumn("quartile", F.floor(F.col("idx") / (F.count("*").over(whole()) / 4.0)))


def stream_time(b: DataFrame) -> DataFrame:
    """Seconds of all rows before."""
    return durations(b).withColumn("stream", F.coalesce(F.sum("duration").over(in_order().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))


def bar_positions(b: DataFrame, downbeat: Column, beats: int = 4) -> DataFrame:
    """Counts from 0 at each downbeat, modulo beats; the lead-in counts from 0."""
    bar = b.withColumn("bar", F.sum(downbeat.cast("long")).over(in_order()))
    place = F.row_number().over(Window.partitionBy("track_id", "bar").orderBy("idx")) - 1
    return bar.withColumn("bar_position", F.pmod(place, F.lit(beats)).cast("long"))


def upper_median(values: Column) -> Column:
    """Element n / 2 of the sorted list."""
    return F.element_at(F.sort_array(values), (F.size(values) / 2).cast("int") + 1)


def fade_cut(b: DataFrame, share: float = 0.4, floor: float = 0.05, least: int = 32, seconds: float = 60.0) -> DataFrame:
    """Up to the last row above max(share of the upper median, floor), if at least ``least`` rows stay; else all, and tracks shorter than ``seconds`` stay whole."""
    # Asked in falling order, the discrete percentile is the upper middle.
    m = b.groupBy("track_id").agg(F.expr("percentile_disc(0.5) within group (order by x desc)").alias("m"), (F.max("t") - F.min("t")).alias("long"))
    j = b.join(m, "track_id").withColumn("last", F.max(F.when(F.col("x") > F.greatest(share * F.col("m"), F.lit(floor)), F.col("idx"))).over(whole()))
    keep = (F.col("long") < seconds) | F.col("last").isNull() | (F.col("last") + 1 < least) | (F.col("idx") <= F.col("last"))
    return j.where(keep).drop("m", "last", "long")


def fade_cut_by_mean(b: DataFrame, share: float = 0.75) -> DataFrame:
    """Up to the last row at or above a share of the mean."""
    j = b.withColumn("mean", F.avg("x").over(whole()))
    return j.withColumn("last", F.max(F.when(F.col("x") >= share * F.col("mean"), F.col("idx"))).over(whole())).where("idx <= last").drop("mean", "last")


def crop(b: DataFrame, threshold: float) -> DataFrame:
    """From the first to the last row at or above the threshold."""
    hit = F.when(F.col("x") >= threshold, F.col("idx"))
    return b.withColumn("lo", F.min(hit).over(whole())).withColumn("hi", F.max(hit).over(whole())).where("idx between lo and hi").drop("lo", "hi")


def median_filter(b: DataFrame, half: int) -> DataFrame:
    """Upper median of the window cut off at the track's ends."""
    return b.withColumn("smooth", upper_median(F.collect_list("x").over(in_order().rowsBetween(-half, half))))


def mode_filter(b: DataFrame, radius: int) -> DataFrame:
    """Most frequent label around; on ties the row's own label, then the smallest."""
    near = F.collect_list("label").over(in_order().rowsBetween(-radius, radius))
    ranked = F.transform(F.array_distinct("near"), lambda v: F.struct((-F.size(F.filter("near", lambda y: y == v))).alias("n"), (v != F.col("label")).alias("other"), v.alias("v")))
    return b.withColumn("near", near).withColumn("mode", F.array_min(ranked)["v"]).drop("near")


def gaussian_smooth(b: DataFrame, sigma: float) -> DataFrame:
    """Kernel of radius ceil(3 sigma) that sums to 1, not renormalised at the ends."""
    radius = math.ceil(3 * sigma)
    kernel = [math.exp(-(d * d) / (2 * sigma * sigma)) for d in range(-radius, radius + 1)]
    out = F.lit(0.0)
    for d, k in zip(range(-radius, radius + 1), kernel, strict=True):
        out = out + F.lit(k / sum(kernel)) * F.coalesce(F.lag("x", -d).over(in_order()) if d else F.col("x"), F.lit(0.0))
    return b.withColumn("smooth", out)


def adaptive_peaks(b: DataFrame, win: int, alpha: float) -> DataFrame:
    """Rows above mean + alpha * deviation of [i - win, i + win) and above both neighbours, win away from the ends."""
    around = in_order().rowsBetween(-win, win - 1)
    j = b.withColumns({"limit": F.avg("x").over(around) + alpha * F.stddev_pop("x").over(around), "a": F.lag("x").over(in_order()), "z": F.lead("x").over(in_order()), "n": F.count("*").over(whole())})
    return j.where((F.col("idx") >= win) & (F.col("idx") < F.col("n") - win) & (F.col("x") > F.col("limit")) & (F.col("x") > F.col("a")) & (F.col("x") > F.col("z"))).select(*b.columns)


def lock_out(peaks: DataFrame, distance: int) -> DataFrame:
    """Keeps a peak if it lies at least distance behind the last kept one: a linear fold over each track's peaks."""

    def work(key, pdf):
        import pandas as pd

        kept: list[int] = []
        for i in sorted(pdf["idx"]):
            if not kept or i - kept[-1] >= distance:
                kept.append(i)
        return pd.DataFrame({"track_id": key[0], "idx": kept})

    narrow = peaks.select("track_id", "idx")
    return narrow.groupBy("track_id").applyInPandas(work, narrow.schema)


def max_peaks(b: DataFrame, radius: int, threshold: float) -> DataFrame:
    """Rows above the threshold with no larger value within the radius; plateaus are kept whole."""
    return b.withColumn("top", F.max("x").over(in_order().rowsBetween(-radius, radius))).where((F.col("x") > threshold) & (F.col("x") == F.col("top"))).drop("top")


def combine_right(b: DataFrame, delta: float) -> DataFrame:
    """Chains of rows at most delta apart become their last row."""
    return b.withColumn("gap", F.lead("t").over(in_order()) - F.col("t")).where(F.col("gap").isNull() | (F.col("gap") > delta)).drop("gap")


def quantize(b: DataFrame, seconds: float) -> DataFrame:
    """Distinct grid frames with an event; rounds half to even."""
    return b.select("track_id", F.rint(F.col("t") / seconds).cast("long").alias("frame")).distinct()


def comb_forward(b: DataFrame, tau: int, alpha: float) -> DataFrame:
    return b.withColumn("y", F.col("x") + alpha * F.coalesce(F.lag("x", tau).over(in_order()), F.lit(0.0)))


def comb_backward(b: DataFrame, tau: int, alpha: float) -> DataFrame:
    """y[n] = x[n] + alpha * y[n - tau]: a linear fold over each track's residues."""
    from trackloom.operators.hmm import by_track
    from trackloom.operators.tempo import comb_back

    return by_track(b.select("track_id", "idx", "x"), lambda _, pdf: {"idx": pdf["idx"].to_numpy(), "y": comb_back(pdf["x"].to_numpy(float), tau, alpha)}, "idx long, y double")


def autocorrelation(b: DataFrame, lags: int) -> DataFrame:
    """Sum of abs(x[n] x[n - tau]) by lag, without a self-join."""
    terms = F.array(*[F.struct(F.lit(k).cast("long").alias("tau"), F.abs(F.col("x") * F.lag("x", k).over(in_order())).alias("v")) for k in range(1, lags + 1)])
    return b.select("track_id", terms.alias("terms")).select("track_id", F.explode("terms").alias("e")).groupBy("track_id", "e.tau").agg(F.coalesce(F.sum("e.v"), F.lit(0.0)).alias("strength"))


def envelope(b: DataFrame, bins: int) -> DataFrame:
    """Root mean square of equal chunks over the loudest chunk; rows beyond bins * chunk are left out."""
    j = b.withColumn("size", F.floor(F.count("*").over(whole()) / bins)).where("size > 0").withColumn("bin", F.floor(F.col("idx") / F.col("size"))).where(F.col("bin") < bins)
    g = j.groupBy("track_id", "bin").agg(F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("rms"))
    return g.withColumn("level", F.col("rms") / F.max("rms").over(whole())).select("track_id", "bin", "level")


def jump_counts(b: DataFrame) -> DataFrame:
    """Rows of the same label in other runs."""
    r = with_runs(b)
    n = F.count("*").over(Window.partitionBy("track_id", "label")) - F.count("*").over(Window.partitionBy("track_id", "run"))
    return r.select("track_id", "idx", n.alias("jumps"))


def escape_fraction(b: DataFrame) -> DataFrame:
    """Share of runs whose label has another run."""
    s = run_segments(b).withColumn("more", F.count("*").over(Window.partitionBy("track_id", "label")) > 1)
    return s.groupBy("track_id").agg(F.avg(F.col("more").cast("double")).alias("fraction"))


def ring(b: DataFrame, size: int) -> DataFrame:
    """The last rows of each track; the group limit goes below the shuffle."""
    return b.withColumn("back", F.row_number().over(whole().orderBy(F.desc("idx")))).where(F.col("back") <= size).drop("back")


def chunks(b: DataFrame, size: int, border: int) -> DataFrame:
    """Overlapping windows of size rows, border on either side; where windows overlap the earlier one holds."""
    step = size - 2 * border
    return b.withColumn("chunk", F.when(F.col("idx") < size - border, 0).otherwise(F.floor((F.col("idx") - border) / step)).cast("long"))

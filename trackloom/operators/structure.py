"""Structure of a track of feature vectors (track_id, i, v): self-similarity, novelty, segments, recurrence graphs, spectral clustering.

i counts from 0 without gaps. Band and offset joins are equi joins on (track_id, i) after the offsets are exploded, so their size is
that of the band. Matrices over all pairs of a track exist as edge tables; eigenvectors and k-means are numpy kernels of one track.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trackloom.functions.vectors import distance, dot, norm
from trackloom.operators import sequence



def track():
    return Window.partitionBy("track_id")


def unit(v: Column | str) -> Column:
    """The vector over its norm; zeros stay."""
    n = norm(v)
    return F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n)).otherwise(F.transform(v, lambda x: x.cast("double")))


def fused(f: DataFrame, *columns: str) -> Column:
    """Several feature arrays as one."""
    return F.concat(*[F.transform(c, lambda x: x.cast("double")) for c in columns])


def zscored(f: DataFrame) -> DataFrame:
    """Every dimension less its mean over its deviation within the track; dimensions that hardly vary stay as they are."""
    long = f.select("track_id", F.posexplode("v").alias("k", "x")).groupBy("track_id", "k").agg(F.avg(F.col("x").cast("double")).alias("m"), F.stddev_pop(F.col("x").cast("double")).alias("s"))
    stats = long.groupBy("track_id").agg(F.array_sort(F.collect_list(F.struct("k", "m", "s"))).alias("_s"))
    z = F.zip_with("v", "_s", lambda x, s: F.when(s["s"] > 1e-6, (x.cast("double") - s["m"]) / s["s"]).otherwise(x.cast("double")))
    return f.join(stats, "track_id").withColumn("v", z).drop("_s")


def similarity(f: DataFrame, reach: int | None = None) -> DataFrame:
    """(track_id, i, j, s): dot products of pairs up to ``reach`` apart, or of all pairs of a track."""
    other = f.select("track_id", F.col("i").alias("j"), F.col("v").alias("w"))
    if reach is None:
        j = f.join(other, "track_id")
    else:
        j = f.withColumn("j", F.explode(F.sequence(F.greatest(F.col("i") - reach, F.lit(0)), F.col("i") + reach))).join(other, ["track_id", "j"])
    return j.select("track_id", "i", "j", dot("v", "w").alias("s"))


def checkerboard(size: int) -> np.ndarray:
    """A Gaussian of deviation size / 4 around size / 2, negative where one coordinate lies before the centre and the other doesn't.

    On the centre's own row and column a zero counts as negative if the product of its signs says so: 0 times a negative number is negative.
    """
    x = np.arange(size) - size / 2
    sign = np.where(np.signbit(x[:, None] * x[None]), -1.0, 1.0)
    return sign * np.exp(-(x[:, None] ** 2 + x[None] ** 2) / (2 * (size / 4) ** 2))


def novelty(f: DataFrame, size: int = 64) -> DataFrame:
    """(track_id, i, novelty): the self-similarity around each frame under a checkerboard kernel, 0 at least, and 0 where it doesn't fit.

    The kernel's entry for two offsets is the product of one factor for each (the centre counting as behind itself), so the score is the
    squared length of one weighted sum of vectors. Each frame is sent to the ``size`` frames around it; no pair is ever made.
    """
    half = size // 2
    o = F.col("o").cast("double")
    weight = F.when(F.col("o") < 0, -1.0).otherwise(1.0) * F.exp(-o * o / (2.0 * (size / 4) ** 2))
    sent = f.select("track_id", "i", "v").withColumn("o", F.explode(F.sequence(F.lit(-half), F.lit(size - half - 1))))
    sent = sent.select("track_id", (F.col("i") - F.col("o")).alias("i"), weight.alias("g"), F.posexplode("v").alias("k", "x"))
    sums = sent.groupBy("track_id", "i", "k").agg(F.sum(F.col("g") * F.col("x").cast("double")).alias("y"))
    scores = sums.groupBy("track_id", "i").agg(F.sum(F.col("y") * F.col("y")).alias("n"))
    frames = f.select("track_id", "i").withColumn("_n", F.count("*").over(track()))
    inside = (F.col("i") >= half) & (F.col("i") < F.col("_n") - half) & (F.col("i") - half + size <= F.col("_n"))
    return frames.join(scores, ["track_id", "i"], "left").select("track_id", "i", F.when(inside, F.col("n")).otherwise(0.0).alias("novelty"))


def lagged(f: DataFrame, lag: int) -> DataFrame:
    """Each vector with its lag - 1 successors as one; zeros behind the end."""
    o = track().orderBy("i")
    zeros = F.transform("v", lambda _: F.lit(0.0))
    return f.withColumn("v", F.concat(*[F.transform(F.coalesce(F.lead("v", k).over(o) if k else F.col("v"), zeros), lambda x: x.cast("double")) for k in range(lag)]))


def snapped(peaks: DataFrame, bars: DataFrame, reach: int = 4) -> DataFrame:
    """(track_id, peak, i): peaks (track_id, i) moved to the nearest row of bars (track_id, idx, bar_position) at position 0 within reach, the earlier on ties; repeats of the one before go."""
    near = peaks.select("track_id", F.col("i").alias("peak")).withColumn("idx", F.explode(F.sequence(F.greatest(F.col("peak") - reach, F.lit(0)), F.col("peak") + reach)))
    hit = near.join(bars.where("bar_position = 0").select("track_id", "idx"), ["track_id", "idx"], "left_semi")
    best = hit.groupBy("track_id", "peak").agg(F.min_by("idx", F.struct(F.abs(F.col("idx") - F.col("peak")), "idx")).alias("to"))
    j = peaks.select("track_id", F.col("i").alias("peak")).join(best, ["track_id", "peak"], "left").withColumn("i", F.coalesce("to", "peak"))
    last = F.lag("i").over(track().orderBy("peak"))
    return j.withColumn("_last", last).where(F.col("_last").isNull() | (F.col("_last") != F.col("i"))).select("track_id", "peak", "i")


def boundaries(peaks: DataFrame, frames: DataFrame) -> DataFrame:
    """(track_id, segment, start, stop) between 0, the peaks and the track's end."""
    ends = frames.groupBy("track_id").agg((F.max("i") + 1).alias("n"))
    cuts = peaks.select("track_id", "i").unionByName(ends.select("track_id", F.lit(0).cast("long").alias("i"))).distinct()
    o = track().orderBy("i")
    b = cuts.join(ends, "track_id").where("i < n").withColumn("stop", F.coalesce(F.lead("i").over(o), F.col("n")))
    return b.select("track_id", (F.row_number().over(o) - 1).alias("segment"), F.col("i").alias("start"), "stop")


def in_segments(frames: DataFrame, cuts: DataFrame) -> DataFrame:
    """frames with the segment that holds them: the running number of cuts, without a range join."""
    mark = cuts.select("track_id", F.col("start").alias("i"), F.col("segment").alias("_s"))
    j = frames.join(mark, ["track_id", "i"], "left")
    return j.withColumn("segment", F.last("_s", ignorenulls=True).over(track().orderBy("i").rowsBetween(Window.unboundedPreceding, 0))).drop("_s")


def segment_pooled(frames: DataFrame, column: str = "v") -> DataFrame:
    """(track_id, segment, median, std): by dimension, over the frames (track_id, segment, v) of a segment."""
    long = frames.select("track_id", "segment", F.posexplode(column).alias("k", "x")).groupBy("track_id", "segment", "k").agg(F.median(F.col("x").cast("double")).alias("m"), F.stddev_pop(F.col("x").cast("double")).alias("s"))
    g = long.groupBy("track_id", "segment").agg(F.array_sort(F.collect_list(F.struct("k", "m", "s"))).alias("a"))
    return g.select("track_id", "segment", F.transform("a", lambda x: x["m"]).alias("median"), F.transform("a", lambda x: x["s"]).alias("std"))


def band_sigma(f: DataFrame, reach: int = 50) -> DataFrame:
    """(track_id, sigma): the upper median of the distances of frames less than reach apart; 1 without any.

    percentile_disc counts from below and takes the lower middle, so it is asked from above.
    """
    other = f.select("track_id", F.col("i").alias("j"), F.col("v").alias("w"))
    near = f.withColumn("j", F.explode(F.sequence(F.col("i") + 1, F.col("i") + reach - 1))).join(other, ["track_id", "j"])
    d = near.select("track_id", distance("v", "w").alias("d"))
    s = d.groupBy("track_id").agg(F.expr("percentile_disc(0.5) within group (order by d desc)").alias("sigma"))
    return f.select("track_id").distinct().join(s, "track_id", "left").select("track_id", F.coalesce("sigma", F.lit(1.0)).alias("sigma"))


def segment_affinity(frames: DataFrame, sigma: DataFrame) -> DataFrame:
    """(track_id, a, b, affinity): mean Gaussian affinity of all pairs of different frames of two segments, both ways."""
    f = frames.join(sigma, "track_id").select("track_id", "i", "v", "segment", F.col("sigma").cast("double").alias("sigma"))
    kind = dict(f.dtypes)["segment"]

    def work(key, left, right):
        import pandas as pd

        width = float(left["sigma"].iloc[0])
        d = distances(matrix(left["v"]), matrix(right["w"]))
        with np.errstate(divide="ignore", invalid="ignore"):
            e = np.exp(-(d * d) / (width * width))
        apart = left["i"].to_numpy()[:, None] != right["j"].to_numpy()[None]
        known = apart & ~np.isnan(e)
        x, ka, a = members(left["segment"])
        y, kb, b = members(right["segment2"])
        total, n, all_ = x.T @ np.where(known, e, 0) @ y, x.T @ known @ y, x.T @ apart @ y
        p, q = np.nonzero(all_ > 0)
        return pd.DataFrame({"track_id": key[0], "a": ka[p], "b": kb[q], "s": total[p, q], "n": n[p, q].astype(np.int64)})

    parts = in_block_pairs(f, ["segment"], ["sigma"], work, f"a {kind}, b {kind}, s double, n long")
    return parts.groupBy("track_id", "a", "b").agg(F.try_divide(F.sum("s"), F.sum("n")).alias("affinity"))


def matrix(column) -> np.ndarray:
    """A column of vectors as rows; what is null counts as no number."""
    width = max((len(v) for v in column if v is not None), default=0)
    out = np.full((len(column), width), np.nan)
    for k, v in enumerate(column):
        if v is not None:
            out[k, : len(v)] = v
    return out


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of all rows by one product; those of pairs so near that the product's rounding would show are taken from differences."""
    size = (x * x).sum(1)[:, None] + (y * y).sum(1)[None]
    d2 = size - 2 * (x @ y.T)
    for i, j in pieces(*np.nonzero(d2 < 1e-4 * size)):
        d2[i, j] = ((x[i] - y[j]) ** 2).sum(1)
    return np.sqrt(np.maximum(d2, 0))


def pieces(i: np.ndarray, j: np.ndarray, size: int = 1 << 15):
    return ((i[a : a + size], j[a : a + size]) for a in range(0, len(i), size))


def members(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows x kinds with 1 where a row is of a kind, the kinds, each row's kind by number)."""
    import pandas as pd

    codes, kinds = pd.factorize(column, use_na_sentinel=False)
    return np.eye(len(kinds))[codes], np.asarray(kinds), codes


def in_block_pairs(frames: DataFrame, both: list[str], left_only: list[str], work, schema: str, block: int = 1024) -> DataFrame:
    """work(key, left, right) on every pair of blocks of a track's frames (track_id, i, v) and other columns.

    left has i, v and all columns; right has j, w and the columns of both with a 2 behind their names. A track of n frames sends each to
    n / block pairs on either side, and what work returns is all that leaves a pair; pairs of frames are never rows.
    """
    o = track().orderBy("i")
    v = frames.withColumn("_b", F.floor((F.row_number().over(o) - 1) / block)).withColumn("_nb", F.ceil(F.count("*").over(track()) / block))
    v = v.withColumn("_o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_nb") - 1)))
    left = v.select("track_id", "_b", "_o", "i", "v", *both, *left_only)
    right = v.select(F.col("track_id").alias("_t"), F.col("_o").alias("_qb"), F.col("_b").alias("_mb"), F.col("i").alias("j"), F.col("v").alias("w"), *[F.col(c).alias(f"{c}2") for c in both])
    kind = dict(frames.dtypes)["track_id"]
    return left.groupBy("track_id", "_b", "_o").cogroup(right.groupBy("_t", "_qb", "_mb")).applyInPandas(work, f"track_id {kind}, {schema}")


# --- recurrence graphs: edges (track_id, src, dst) -----------------------------------------------------------------------------------------


def with_squares(edges: DataFrame, f: DataFrame) -> DataFrame:
    """Edges with the squared distance d2 of their frames."""
    a = f.select("track_id", F.col("i").alias("src"), F.col("v").alias("_v"))
    b = f.select("track_id", F.col("i").alias("dst"), F.col("v").alias("_w"))
    d = distance("_v", "_w")
    return edges.join(a, ["track_id", "src"]).join(b, ["track_id", "dst"]).withColumn("d2", d * d).drop("_v", "_w")


def repetition_affinity(edges: DataFrame, f: DataFrame) -> DataFrame:
    """Edges with weight exp(-d2 / sigma2), sigma2 the upper median of d2 over src < dst, 1e-6 at least and 1 without edges."""
    e = with_squares(edges, f)
    s = e.where("src < dst").groupBy("track_id").agg(F.expr("percentile_disc(0.5) within group (order by d2 desc)").alias("_s"))
    j = e.join(s, "track_id", "left")
    return j.select("track_id", "src", "dst", F.exp(-F.col("d2") / F.greatest(F.coalesce("_s", F.lit(1.0)), F.lit(1e-6))).alias("weight"))


def path_affinity(f: DataFrame, least: float = 0.01) -> DataFrame:
    """(track_id, i, weight) of the step from each frame to the next: exp(-d2 / sigma2), ``least`` at least; sigma2 is the upper median, 1 where it is almost 0."""
    o = track().orderBy("i")
    d = distance("v", "_w")
    steps = f.withColumn("_w", F.lead("v").over(o)).where("_w is not null").select("track_id", "i", (d * d).alias("d2"))
    s = steps.groupBy("track_id").agg(F.expr("percentile_disc(0.5) within group (order by d2 desc)").alias("_s"))
    return steps.join(s, "track_id").select("track_id", "i", F.greatest(F.exp(-F.col("d2") / F.when(F.col("_s") < 1e-10, 1.0).otherwise(F.col("_s"))), F.lit(least)).alias("weight"))


def path_degrees(path: DataFrame) -> DataFrame:
    both = path.select("track_id", "i", "weight").unionByName(path.select("track_id", (F.col("i") + 1).alias("i"), "weight"))
    return both.groupBy("track_id", "i").agg(F.sum("weight").alias("degree"))


def edge_degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy("track_id", F.col("src").alias("i")).agg(F.sum("weight").alias("degree"))


def balance(path: DataFrame, repetition: DataFrame, floor: float | None = None) -> DataFrame:
    """(track_id, mu): <p, p + r> / |p + r|^2 of both degrees; 0.5 where that is almost 0. floor: mu at least."""
    j = path_degrees(path).withColumnRenamed("degree", "p").join(edge_degrees(repetition).withColumnRenamed("degree", "r"), ["track_id", "i"], "full")
    p, both = F.coalesce("p", F.lit(0.0)), F.coalesce("p", F.lit(0.0)) + F.coalesce("r", F.lit(0.0))
    g = j.groupBy("track_id").agg(F.sum(p * both).alias("a"), F.sum(both * both).alias("b"))
    mu = F.when(F.col("b") < 1e-10, 0.5).otherwise(F.col("a") / F.col("b"))
    return g.select("track_id", (F.greatest(mu, F.lit(floor)) if floor is not None else mu).alias("mu"))


def combined_affinity(path: DataFrame, repetition: DataFrame, mu: DataFrame) -> DataFrame:
    """Edges of mu times the repetitions plus 1 - mu times the path, both ways."""
    steps = path.select("track_id", F.col("i").alias("src"), (F.col("i") + 1).alias("dst"), "weight")
    back = steps.select("track_id", F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    m = F.col("mu")
    parts = repetition.join(mu, "track_id").withColumn("w", m * F.col("weight")).unionByName(steps.unionByName(back).join(mu, "track_id").withColumn("w", (1 - m) * F.col("weight")))
    return parts.groupBy("track_id", "src", "dst").agg(F.sum("w").alias("weight"))


def laplacian(affinity: DataFrame, frames: DataFrame) -> DataFrame:
    """(track_id, src, dst, value) of the symmetric normalised Laplacian: 1 on the diagonal, -w / sqrt(d d') elsewhere; frames without edges have 1 only."""
    degrees = edge_degrees(affinity)
    inverse = F.when(F.col("degree") > 1e-10, 1 / F.sqrt("degree")).otherwise(0.0)
    a = degrees.select("track_id", F.col("i").alias("src"), inverse.alias("_a"))
    b = degrees.select("track_id", F.col("i").alias("dst"), inverse.alias("_b"))
    off = affinity.where("src <> dst").join(a, ["track_id", "src"]).join(b, ["track_id", "dst"], "left")
    off = off.select("track_id", "src", "dst", (-F.col("weight") * F.col("_a") * F.coalesce("_b", F.lit(0.0))).alias("value"))
    return off.unionByName(frames.select("track_id", F.col("i").alias("src"), F.col("i").alias("dst"), F.lit(1.0).alias("value")))


def diagonal_density(edges: DataFrame, frames: DataFrame, low: int = 10, high: int = 200) -> DataFrame:
    """(track_id, density): the greatest share of a diagonal that has edges, over offsets from low to below the track's length and high; 0 without."""
    n = frames.groupBy("track_id").agg(F.count("*").alias("n"))
    near = edges.select("track_id", "src", "dst", (F.col("dst") - F.col("src")).alias("d")).where((F.col("d") >= low) & (F.col("d") < high))
    d = near.distinct().join(n, "track_id").where(F.col("d") < F.col("n"))
    each = d.groupBy("track_id", "d").agg((F.count("*") / (F.first("n") - F.col("d"))).alias("x")).groupBy("track_id").agg(F.max("x").alias("density"))
    return n.join(each, "track_id", "left").select("track_id", F.coalesce("density", F.lit(0.0)).alias("density"))


def filter_width(density: Column) -> Column:
    """Frames of the diagonal filter: wide where repetitions are dense."""
    return F.when(density >= 0.35, 17).when(density >= 0.20, 11).otherwise(7)


def diagonal_median(edges: DataFrame, frames: DataFrame, width: int | Column) -> DataFrame:
    """Edges after an upper-median filter along each diagonal; diagonals of fewer than three cells stay. width: a number, or one for each track of frames.

    A cell stays or comes up if more than half (of an even window: at least half) of its window has edges. Only cells near an edge can,
    whatever the size of the matrix. Diagonals are dealt to workers in bands of 512.
    """
    n = frames.groupBy("track_id").agg(F.count("*").alias("_n"), F.first(width if isinstance(width, Column) else F.lit(width)).cast("long").alias("_w"))
    e = edges.select("track_id", "src", "dst").join(n, "track_id").withColumn("_d", F.floor((F.col("dst") - F.col("src")) / 512))
    kind = dict(edges.dtypes)["track_id"]

    def work(key, pdf):
        import pandas as pd

        n, half = int(pdf["_n"].iloc[0]), int(pdf["_w"].iloc[0]) // 2
        src, dst = diagonal_kept(pdf["src"].to_numpy(), pdf["dst"].to_numpy(), n, half)
        return pd.DataFrame({"track_id": key[0], "src": src, "dst": dst})

    return e.groupBy("track_id", "_d").applyInPandas(work, f"track_id {kind}, src long, dst long")


def diagonal_kept(src: np.ndarray, dst: np.ndarray, n: int, half: int) -> tuple[np.ndarray, np.ndarray]:
    """The cells that diagonal_median leaves or adds, of the cells of some whole diagonals of n frames."""
    d = dst - src
    least, stride = d.min(), n + 2 * half + 2
    cells = np.unique((d - least) * stride + np.minimum(src, dst) + half)
    near = np.unique((cells[:, None] + np.arange(-half, half + 1)).ravel())
    count = np.searchsorted(cells, near + half, "right") - np.searchsorted(cells, near - half)
    of, place = near // stride + least, near % stride - half
    size = n - np.abs(of)
    seen = np.minimum(place + half, size - 1) - np.maximum(place - half, 0) + 1
    inside = (place >= 0) & (place < size) & (size >= 3) & (count >= seen - seen // 2)
    short = (size < 3) & np.isin(near, cells)
    kept = inside | short
    row = place[kept] + np.maximum(-of[kept], 0)
    return row, row + of[kept]


# --- clustering ------------------------------------------------------------------------------------------------------------------------------


def signed(vectors: np.ndarray) -> np.ndarray:
    """Vectors in columns, the greatest entry of each positive."""
    top = np.abs(vectors).argmax(0)
    return vectors * np.where(vectors[top, np.arange(vectors.shape[1])] < 0, -1, 1)


def eigen(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a symmetric matrix in rising order and its vectors in columns; a vector's greatest entry is positive."""
    values, vectors = np.linalg.eigh(matrix)
    return values, signed(vectors)


DENSE = 1200
PAIRS = 66
CORE, FILL, SHIFT = 3000, 1 << 22, 1e-5


def lowest(n: int, src: np.ndarray, dst: np.ndarray, value: np.ndarray, most: int = PAIRS) -> tuple[np.ndarray, np.ndarray]:
    """eigen() of a Laplacian's cells, of large ones the ``most`` lowest values only: more than any strategy reads.

    Matrices of up to DENSE rows are solved whole, larger ones by block Lanczos steps on the inverse, as a long path's values crowd at 0, or, where
    that fills up, on the sparse cells. What doesn't settle is solved whole.
    """
    if n > max(DENSE, 8 * most):
        cells = summed(n, np.concatenate([src, dst]), np.concatenate([dst, src]), np.concatenate([value, value]) / 2)
        basis = max(320, 3 * most)
        if (times := inverse(n, *cells)) is not None and (found := lanczos(n, times, most, basis=basis)) is not None:
            return SHIFT / found[0] - SHIFT, signed(found[1])
        if (found := lanczos(n, away(n, *cells), most, basis=basis)) is not None:
            return 2 - found[0], signed(found[1])
    m = np.zeros((n, n))
    m[src, dst] = value
    m += m.T.copy()
    m /= 2
    return eigen(m)


def summed(n: int, src: np.ndarray, dst: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cells in order, those of one place added up."""
    key, at = np.unique(src * n + dst, return_inverse=True)
    return key // n, key % n, np.bincount(at, value, len(key))


def away(n: int, src: np.ndarray, dst: np.ndarray, value: np.ndarray):
    """x -> 2 x - L x: the lowest values of L come first. Column by column, so that memory is that of the cells."""
    at = np.flatnonzero(np.diff(src, prepend=-1))
    rows = src[at]

    def times(x):
        out = 2 * x
        for k in range(x.shape[1]):
            out[rows, k] -= np.add.reduceat(value * x[dst, k], at)
        return out

    return times


def inverse(n: int, src: np.ndarray, dst: np.ndarray, value: np.ndarray):
    """x -> SHIFT (L + SHIFT)^-1 x of symmetric cells; None where L has values of -SHIFT or less, or more than CORE rows are left.

    Rows of few cells that don't touch each other are eliminated together, round by round; a path takes log n rounds. Rounds end where cells
    fill up, and the rows left then are inverted whole.
    """
    off = src != dst
    diagonal = np.bincount(src[~off], value[~off], n) + SHIFT
    a, b, w = src[off], dst[off], value[off]
    left, steps, draw = np.ones(n, bool), [], np.random.default_rng(0)
    while True:
        rows = np.flatnonzero(left)
        degree = np.bincount(a, minlength=n)
        if len(rows) <= 64 or len(a) > len(rows) ** 2 / 8:
            break
        rank = degree + draw.permutation(n) / n
        least = np.full(n, np.inf)
        np.minimum.at(least, a, rank[b])
        gone = left & (degree <= max(2 * degree[rows].min(), 2)) & (rank < least)
        own = gone[a]
        u, v, c = a[own], b[own], w[own]
        size = degree[u]
        if size.sum() > FILL or len(a) > FILL:
            break
        pivot = diagonal[gone]
        if not (pivot > 0).all():
            return None
        one = np.repeat(np.arange(len(u)), size)
        two = np.repeat(np.searchsorted(u, u), size) + np.arange(len(one)) - np.repeat(np.cumsum(size) - size, size)
        p, q, x = v[one], v[two], -c[one] * c[two] / diagonal[u[one]]
        steps.append((np.flatnonzero(gone), pivot[:, None], u, v, (c / diagonal[u])[:, None]))
        same = p == q
        diagonal += np.bincount(p[same], x[same], n)
        stay = ~(own | gone[b])
        a, b, w = summed(n, np.concatenate([a[stay], p[~same]]), np.concatenate([b[stay], q[~same]]), np.concatenate([w[stay], x[~same]]))
        left &= ~gone
    if len(rows) > CORE:
        return None
    place = np.cumsum(left) - 1
    core = np.diag(diagonal[rows])
    core[place[a], place[b]] = w
    try:
        np.linalg.cholesky(core)
    except np.linalg.LinAlgError:
        return None
    core = np.linalg.inv(core)
    core = (core + core.T) / 2
    plan = []
    for gone, pivot, u, v, c in steps:
        order = np.argsort(v, kind="stable")
        to, begin = np.unique(v[order], return_index=True)
        of, first = np.unique(u, return_index=True)
        plan.append((gone, pivot, v, c, of, first, u[order], c[order], to, begin))

    def times(x):
        x = SHIFT * x
        for *_, u, c, to, begin in plan:
            if len(u):
                x[to] -= np.add.reduceat(c * x[u], begin)
        x[rows] = core @ x[rows]
        for gone, pivot, v, c, of, first, *_ in reversed(plan):
            x[gone] /= pivot
            if len(v):
                x[of] -= np.add.reduceat(c * x[v], first)
        return x

    return times


def lanczos(n: int, times, most: int, width: int = 8, basis: int = 320, restarts: int = 60, tolerance: float = 1e-8):
    """(values, vectors) of the ``most`` greatest values of a symmetric x -> times(x), by block steps with thick restarts; None if they don't settle.

    Residuals go below the tolerance by half the value, which is the tolerance for L itself, and then a random block must find nothing new, as equal
    values can hide from a Krylov space.
    """

    def outside(x, q):
        for _ in range(2):
            x = x - q @ (q.T @ x)
        return np.linalg.qr(x)[0]

    draw = np.random.default_rng(0)
    q = outside(draw.normal(size=(n, width)), np.zeros((n, 0)))
    aq, settled = times(q), None
    for _ in range(restarts):
        while q.shape[1] < basis:
            new = outside(aq[:, -width:], q)
            new = outside(new, q)
            q, aq = np.concatenate([q, new], 1), np.concatenate([aq, times(new)], 1)
        t = q.T @ aq
        theta, y = np.linalg.eigh((t + t.T) / 2)
        y = y[:, ::-1][:, : most + 60]
        following = outside(aq[:, -width:], q)
        q, aq, theta = q @ y, aq @ y, theta[::-1][: most + 60]
        near = tolerance * theta[:most] / 2
        if (np.linalg.norm(aq[:, :most] - q[:, :most] * theta[:most], axis=0) < near).all():
            if settled is not None and (np.abs(settled - theta[:most]) < near).all():
                return theta[:most], q[:, :most]
            settled, following = theta[:most].copy(), draw.normal(size=(n, width))
        else:
            settled = None
        new = outside(outside(following, q), q)
        q, aq = np.concatenate([q, new], 1), np.concatenate([aq, times(new)], 1)
    return None


def embedding(vectors: np.ndarray, k: int) -> np.ndarray:
    """The first k vectors, each row over its norm; rows that are almost 0 become 0."""
    x = vectors[:, :k]
    n = np.sqrt((x * x).sum(1, keepdims=True))
    return np.where(n > 1e-10, x / np.where(n > 0, n, 1), 0)


def smooth_vectors(vectors: np.ndarray, width: int = 9) -> np.ndarray:
    """Upper median along the frames, the window cut off at the ends."""
    half = width // 2
    return np.stack([np.sort(vectors[max(0, i - half) : i + half + 1], 0)[len(vectors[max(0, i - half) : i + half + 1]) // 2] for i in range(len(vectors))])


def squares(x: np.ndarray, y: np.ndarray, own: np.ndarray | None = None) -> np.ndarray:
    """Squared distances of all rows by one product; what is within its rounding counts as 0. own: the squares of x, where they are known."""
    size = ((x * x).sum(1) if own is None else own)[:, None] + (y * y).sum(1)[None]
    d = x @ y.T
    d *= -2
    d += size
    size *= 1e-13
    np.copyto(d, 0, where=~(d > size))
    return d


def kmeans(x: np.ndarray, k: int, rounds: int = 300, starts: int = 10, seed: int = 0) -> np.ndarray:
    """Labels of the best of several seeded starts; centres are first drawn by their squared distance. Labels count in order of first appearance."""
    draw, best, out = np.random.default_rng(seed), np.inf, np.zeros(len(x), int)
    own, columns = (x * x).sum(1), np.ascontiguousarray(x.T)
    for _ in range(starts):
        centres = x[[draw.integers(len(x))]]
        near = squares(x, centres, own)[:, 0]
        while len(centres) < min(k, len(x)):
            total = near.sum()
            centres = np.concatenate([centres, x[[draw.choice(len(x), p=near / total) if total > 0 else draw.integers(len(x))]]])
            near = np.minimum(near, squares(x, centres[-1:], own)[:, 0])
        for _ in range(rounds):
            d = squares(x, centres, own)
            label = d.argmin(1)
            size = np.bincount(label, minlength=len(centres))[:, None]
            sums = np.stack([np.bincount(label, column, len(centres)) for column in columns], 1)
            new = np.where(size > 0, sums / np.maximum(size, 1), centres)
            if np.allclose(new, centres):
                break
            centres = new
        cost = d[np.arange(len(x)), label].sum()
        if cost < best - 1e-12:
            best, out = cost, label
    seen: dict[int, int] = {}
    return np.array([seen.setdefault(int(v), len(seen)) for v in out])


def silhouette_of(x: np.ndarray, labels: np.ndarray, singleton: float = 1.0) -> float:
    """Mean of (b - a) / max(a, b), a the mean distance within the cluster and b that to the nearest other one; singletons count as given."""
    kinds = np.unique(labels)
    if len(kinds) < 2:
        return 0.0
    own = np.searchsorted(kinds, labels)
    member = np.eye(len(kinds))[own]
    sums = np.concatenate([np.sqrt(squares(x[a : a + 512], x)) @ member for a in range(0, len(x), 512)])
    size = member.sum(0)
    rows = np.arange(len(x))
    a = np.where(size[own] > 1, sums[rows, own] / np.maximum(size[own] - 1, 1), 0)
    means = sums / size
    means[rows, own] = np.inf
    b = means.min(1)
    top = np.maximum(a, b)
    s = np.where(top > 0, (b - a) / np.where(top > 0, top, 1), 0)
    return float(np.where(size[own] > 1, s, singleton if singleton != 1.0 else np.where(top > 0, 1.0, 0.0)).mean())


def silhouette(f: DataFrame, label: str = "label") -> DataFrame:
    """(track_id, silhouette) of frames (track_id, i, v, label), pairs of frames taken in blocks; singletons score 1, null with one label."""
    kind = dict(f.dtypes)[label]

    def work(key, left, right):
        import pandas as pd

        d = distances(matrix(left["v"]), matrix(right["w"]))
        known = ~np.isnan(d)
        y, kinds, _ = members(right["b2"])
        total, n = np.where(known, d, 0) @ y, known @ y
        return pd.DataFrame({
            "track_id": key[0], "i": np.repeat(left["i"].to_numpy(), len(kinds)), "a": np.repeat(left["b"].to_numpy(), len(kinds)), "b": np.tile(kinds, len(left)),
            "s": np.where(n > 0, total, np.nan).ravel(), "n": np.tile(y.sum(0).astype(np.int64), len(left)),
        })

    parts = in_block_pairs(f.select("track_id", "i", "v", F.col(label).alias("b")), ["b"], [], work, f"i long, a {kind}, b {kind}, s double, n long")
    means = parts.groupBy("track_id", "i", "a", "b").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    own = F.col("a") == F.col("b")
    g = means.groupBy("track_id", "i").agg(
        F.max(F.when(own, F.when(F.col("n") > 1, F.col("s") / (F.col("n") - 1)).otherwise(0.0))).alias("x"), F.min(F.when(~own, F.col("s") / F.col("n"))).alias("y"),
    )
    top = F.greatest("x", "y")
    return g.groupBy("track_id").agg(F.avg(F.when(F.col("y").isNotNull(), F.when(top > 0, (F.col("y") - F.col("x")) / top).otherwise(0.0))).alias("silhouette"))


def runs_of(labels: np.ndarray) -> np.ndarray:
    """Lengths of the runs of equal labels."""
    cuts = np.flatnonzero(np.diff(labels)) + 1
    return np.diff(np.concatenate([[0], cuts, [len(labels)]]))


def jump_counts_of(labels: np.ndarray) -> np.ndarray:
    """For each place the places of its label in other runs."""
    run = np.cumsum(np.concatenate([[0], np.diff(labels) != 0]))
    return np.bincount(labels)[labels] - np.bincount(run)[run]


def escape_of(labels: np.ndarray) -> float:
    """The share of runs whose label has another run."""
    first = labels[np.concatenate([[True], np.diff(labels) != 0])]
    return float((np.bincount(first)[first] > 1).mean())


def eigengap(values: np.ndarray, low: int = 4, high: int = 32) -> int:
    """The k from low to below high with the greatest relative step from value k to the next; low without any."""
    best, k_best = 0.0, low
    for k in range(low, min(high, len(values) - 1)):
        gap = values[k + 1] - values[k]
        gap = gap / values[k] if values[k] > 1e-10 else gap
        if gap > best:
            best, k_best = gap, k
    return k_best


def v3_scores(x: np.ndarray, labels: np.ndarray, k: int) -> dict[str, float]:
    """Fitness of a clustering by strategy; -100 where a floor isn't reached."""
    s, sizes, jumps, escape = silhouette_of(x, labels), runs_of(labels), np.sort(jump_counts_of(labels)), escape_of(labels)
    ratio, median = len(sizes) / k, float(jumps[len(jumps) // 2])
    open_ = s >= 0.5 and escape >= 0.5 and median >= 4
    return {
        "legacy": k + 10 * s + ratio + min(int(sizes.min()), 8) if ratio >= 1.5 else -100.0, "balanced": 100 * s + median,
        "connectivity": escape * math.log(median) if open_ else -100.0, "max_k": float(k) if open_ else -100.0,
    }


def v1_score(x: np.ndarray, labels: np.ndarray, k: int) -> float:
    """k times silhouette times runs a label, a fifth less with runs of one beat; the last run doesn't count for that."""
    sizes = runs_of(labels)
    return k * silhouette_of(x, labels, 0.0) * len(sizes) / (labels.max() + 1) * (0.8 if len(sizes) > 1 and sizes[:-1].min() == 1 else 1)


def v2_score(x: np.ndarray, labels: np.ndarray, k: int) -> float:
    """k + 10 silhouettes + shortest run up to 8 + runs a label, where there are 3 and the silhouette exceeds 0.5; else 0."""
    sizes, s = runs_of(labels), silhouette_of(x, labels, 0.0)
    ratio = len(sizes) / (labels.max() + 1)
    return k + 10 * s + min(int(sizes[:-1].min()) if len(sizes) > 1 else 8, 8) + ratio if ratio >= 3 and s > 0.5 else 0.0


def clustered(values: np.ndarray, vectors: np.ndarray, strategy: str, k: int | None = None, high: int = 48) -> tuple[int, np.ndarray, list[tuple[int, float]]]:
    """(k, labels, score log). strategy: eigengap, legacy, balanced, connectivity, max_k (k from 3 to 32, first best), v1 and v2 (from high down, last best), v1_ratio."""
    n = len(vectors)
    label = lambda j: kmeans(embedding(vectors, j), j)
    if k is not None or strategy == "eigengap":
        k = min(k or eigengap(values), n)
        return k, label(k), []
    if strategy == "v1_ratio":
        tried = [(j, label(j)) for j in range(4, min(64, n), 2)]
        log = [(j, len(runs_of(x)) / j) for j, x in tried]
        cut = min(max(r for _, r in log), 4)
        k, labels = max((t for t, (_, r) in zip(tried, log, strict=True) if r >= cut), key=lambda t: t[0])
        return k, labels, log
    grid = range(min(high, n - 1), 2 if strategy == "v1" else 3, -1) if strategy in ("v1", "v2") else range(3, min(32, n - 1) + 1)
    score = {"v1": v1_score, "v2": v2_score}.get(strategy) or (lambda x, y, j: v3_scores(x, y, j)[strategy])
    best, k_best, labels, log = (0.0 if strategy in ("v1", "v2") else -np.inf), None, None, []
    for j in grid:
        x, y = embedding(vectors, j), label(j)
        s = score(x, y, j)
        log.append((j, s))
        if labels is None or (s >= best if strategy in ("v1", "v2") else s > best):
            best, k_best, labels = s, j, y
    return k_best, labels, log


def spread(rows: DataFrame) -> DataFrame:
    """Tracks dealt to all shuffle partitions: a count that is given isn't merged, and a small table can be much work. By ranges, as hashes put several of few tracks together."""
    return rows.repartitionByRange(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "track_id")


def spectral_clusters(affinity: DataFrame, frames: DataFrame, strategy: str = "eigengap", k: int | None = None, smooth: int | None = None) -> DataFrame:
    """(track_id, i, label, k) of affinity edges: eigenvectors of the Laplacian, automatic number of clusters, k-means.

    A kernel of one track: its edges, their fill, CORE^2 doubles at most and 320 vectors as long as the track; n^2 doubles only where it must be solved whole.
    """
    cells = spread(laplacian(affinity, frames))
    kind = dict(frames.dtypes)["track_id"]

    def work(key, pdf):
        import pandas as pd

        n = int(pdf["src"].max()) + 1
        values, vectors = lowest(n, *(pdf[c].to_numpy() for c in ("src", "dst", "value")), max(PAIRS, k or 0))
        if smooth:
            vectors = smooth_vectors(vectors, smooth)
        found, labels, _ = clustered(values, vectors, strategy, k)
        return pd.DataFrame({"track_id": key[0], "i": np.arange(n), "label": labels, "k": found})

    return cells.groupBy("track_id").applyInPandas(work, f"track_id {kind}, i long, label long, k long")


def cluster_scores(affinity: DataFrame, frames: DataFrame, strategy: str = "balanced") -> DataFrame:
    """(track_id, k, score) of every number of clusters that the strategy tries."""
    cells = spread(laplacian(affinity, frames))
    kind = dict(frames.dtypes)["track_id"]

    def work(key, pdf):
        import pandas as pd

        n = int(pdf["src"].max()) + 1
        log = clustered(*lowest(n, *(pdf[c].to_numpy() for c in ("src", "dst", "value"))), strategy)[2]
        return pd.DataFrame({"track_id": key[0], "k": [j for j, _ in log], "score": [s for _, s in log]})

    return cells.groupBy("track_id").applyInPandas(work, f"track_id {kind}, k long, score double")


def segment_by_novelty(f: DataFrame, bars: DataFrame, kernel: int = 64, sigma: float = 4.0, win: int = 16, alpha: float = 1.25, apart: int = 16) -> DataFrame:
    """(track_id, i, novelty, label): the track's segments between novelty peaks that were moved to downbeats; the label is the segment's number."""
    n = novelty(f.withColumn("v", unit("v")), kernel)
    curve = sequence.gaussian_smooth(n.select("track_id", F.col("i").alias("idx"), F.col("novelty").alias("x")), sigma)
    curve = curve.select("track_id", "idx", F.col("smooth").alias("x"))
    peaks = sequence.lock_out(sequence.adaptive_peaks(curve, win, alpha), apart).withColumnRenamed("idx", "i")
    cuts = boundaries(snapped(peaks, bars).select("track_id", "i"), f)
    found = in_segments(f.select("track_id", "i"), cuts)
    return found.join(curve.select("track_id", F.col("idx").alias("i"), F.col("x").alias("novelty")), ["track_id", "i"]).select("track_id", "i", "novelty", F.col("segment").alias("label"))

"""Beat metrics: everything is windows and aggregates over nearest matches, with any keys before the time."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trackloom.evaluation import base

SIGMA, TOLERANCE, BINS = 0.04, 0.175, 40
VARIANTS = ("same", "offbeat", "double", "half_even", "half_odd", "triple", "third_0", "third_1", "third_2")


def numbered(events: DataFrame, *keys: str) -> DataFrame:
    """Adds k, the place in time from 0, n, the number of events, and the gaps to the events before and after."""
    w = Window.partitionBy(*keys)
    o = w.orderBy("t")
    return events.select(*keys, F.col("t").cast("double").alias("t")).withColumns({
        "k": F.row_number().over(o) - 1, "n": F.count("*").over(w), "gap_before": F.col("t") - F.lag("t").over(o), "gap_after": F.lead("t").over(o) - F.col("t"),
    })


def nearest(side: DataFrame, other: DataFrame, *keys: str) -> DataFrame:
    """side's numbered events with the nearest event of the other side as a struct ``near`` (t, k, n, gaps); the later one on ties."""
    fields = ("t", "k", "n", "gap_before", "gap_after")
    as_struct = lambda d: F.struct(*fields)
    d = numbered(side, *keys).select(*keys, "t", as_struct(side).alias("own"), F.lit(None).cast("struct<t:double,k:int,n:bigint,gap_before:double,gap_after:double>").alias("a"), F.lit(1).alias("side"))
    a = numbered(other, *keys).select(*keys, "t", F.lit(None).cast("struct<t:double,k:int,n:bigint,gap_before:double,gap_after:double>").alias("own"), as_struct(other).alias("a"), F.lit(0).alias("side"))
    w = Window.partitionBy(*keys)
    left = F.last("a", ignorenulls=True).over(w.orderBy("t", "side").rowsBetween(Window.unboundedPreceding, 0))
    right = F.first("a", ignorenulls=True).over(w.orderBy("t", F.desc("side")).rowsBetween(0, Window.unboundedFollowing))
    u = d.unionByName(a).withColumn("l", left).withColumn("r", right).where("side = 1")
    near = F.when(F.col("r").isNull() | (F.col("t") - F.col("l.t") < F.col("r.t") - F.col("t")), F.col("l")).otherwise(F.col("r"))
    return u.select(*keys, "own.*", near.alias("near")).withColumn("error", F.col("t") - F.col("near.t"))


def relative(side: DataFrame, other: DataFrame, *keys: str) -> DataFrame:
    """nearest() with the error over the interval of the other side that it falls in; that of the inner neighbour at the ends."""
    before, after = F.coalesce("near.gap_before", "near.gap_after"), F.coalesce("near.gap_after", "near.gap_before")
    return nearest(side, other, *keys).withColumn("relative", F.col("error") / F.when(F.col("error") > 0, after).otherwise(before))


def sizes(detections: DataFrame, annotations: DataFrame, *keys: str) -> DataFrame:
    n = lambda d, c: d.groupBy(*keys).agg(F.count("*").alias(c))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return n(detections, "nd").join(n(annotations, "na"), list(keys), "full").select(*keys, zero("nd"), zero("na"))


def guarded(score: Column, none: float = 0.0) -> Column:
    """A score for files where both sides have events: 1 for none on either, none on one."""
    return F.when((F.col("nd") == 0) | (F.col("na") == 0), none).otherwise(score)


def cemgil(detections: DataFrame, annotations: DataFrame, sigma: float = SIGMA, *keys: str) -> DataFrame:
    """Sum of exp(-error^2 / 2 sigma^2) over the mean number of events."""
    keys = keys or ("track_id",)
    s = nearest(detections, annotations, *keys).groupBy(*keys).agg(F.sum(F.exp(-F.col("error") ** 2 / (2 * sigma**2))).alias("s"))
    j = sizes(detections, annotations, *keys).join(s, list(keys), "left")
    return j.select(*keys, guarded(F.coalesce("s", F.lit(0.0)) / ((F.col("nd") + F.col("na")) / 2)).alias("cemgil"))


def goto(detections: DataFrame, annotations: DataFrame, threshold: float = 0.175, sigma: float = 0.1, mu: float = 0.1) -> DataFrame:
    """1 if the longest run of correct detections covers a quarter of the annotations and its errors have a small mean and deviation, else 0; null with fewer than two annotations."""
    key = "track_id"
    errors = relative(detections, annotations, key).select(key, F.col("k").alias("d"), "relative")
    hit = nearest(annotations, detections, key).select(key, F.col("k").alias("a"), F.col("near.k").alias("d"))
    ok = hit.join(errors, [key, "d"]).where(F.abs("relative") <= threshold)
    w = Window.partitionBy(key).orderBy("a")
    # A run ends where the next annotation's detection isn't the next detection.
    new = F.coalesce((F.col("d") != F.lag("d").over(w) + 1).cast("long"), F.lit(1))
    runs = ok.withColumn("_new", new).withColumn("run", F.sum("_new").over(w)).groupBy(key, "run")
    runs = runs.agg(F.count("*").alias("n"), F.avg(F.abs("relative")).alias("mean"), F.stddev_pop("relative").alias("std"))
    best = runs.groupBy(key).agg(F.max_by(F.struct("n", "mean", "std"), F.struct("n", -F.col("run"))).alias("b"))
    j = sizes(detections, annotations, key).join(best, key, "left")
    good = (F.col("b.n") >= 0.25 * F.col("na")) & (F.col("b.mean") <= mu) & (F.col("b.std") <= sigma)
    score = guarded(F.coalesce(good, F.lit(False)).cast("double"))
    return j.select(key, F.when((F.col("na") < 2) & (F.col("nd") > 0), None).otherwise(score).alias("goto"))


def cml(detections: DataFrame, annotations: DataFrame, phase: float = TOLERANCE, tempo: float = TOLERANCE, *keys: str) -> DataFrame:
    """(cmlc, cmlt): longest run and number of detections that are right in phase and tempo, over the larger count; 0 with fewer than two events on a side."""
    keys = keys or ("track_id",)
    n = nearest(detections, annotations, *keys)
    own = F.coalesce("gap_before", "gap_after")
    theirs = F.coalesce("near.gap_before", "near.gap_after")
    right = (F.abs("error") <= theirs * phase) & (F.abs(1 - own / theirs) <= tempo)
    r = n.where(right & (F.col("n") >= 2) & (F.col("near.n") >= 2))
    w = Window.partitionBy(*keys).orderBy("k")
    runs = r.withColumn("run", F.col("k") - F.row_number().over(w)).groupBy(*keys, "run").agg(F.count("*").alias("c"))
    best = runs.groupBy(*keys).agg(F.max("c").alias("longest"), F.sum("c").alias("total"))
    j = sizes(detections, annotations, *keys).join(best, list(keys), "left")
    share = lambda c: guarded(F.coalesce(F.col(c), F.lit(0)) / F.greatest("nd", "na"))
    return j.select(*keys, share("longest").alias("cmlc"), share("total").alias("cmlt"))


def variations(events: DataFrame, names: tuple[str, ...] = VARIANTS) -> DataFrame:
    """(track_id, variant, t): the sequence itself, its offbeats, at double and triple tempo by linear interpolation, and every second and third event."""
    e = numbered(events, "track_id")
    part = lambda share: F.col("t") + F.col("gap_after") * share
    made = {
        "same": F.array("t"), "offbeat": F.array(part(0.5)), "double": F.array(F.col("t"), part(0.5)), "triple": F.array(F.col("t"), part(1 / 3), part(2 / 3)),
        "half_even": F.array(F.when(F.col("k") % 2 == 0, F.col("t"))), "half_odd": F.array(F.when(F.col("k") % 2 == 1, F.col("t"))),
        **{f"third_{r}": F.array(F.when(F.col("k") % 3 == r, F.col("t"))) for r in range(3)},
    }
    each = F.array(*[F.struct(F.lit(v).alias("variant"), made[v].alias("ts")) for v in names])
    out = e.select("track_id", F.explode(each).alias("v")).select("track_id", "v.variant", F.explode("v.ts").alias("t"))
    return out.where("t is not null")


def continuity(detections: DataFrame, annotations: DataFrame, phase: float = TOLERANCE, tempo: float = TOLERANCE) -> DataFrame:
    """cml, and the best over the annotations' variations (amlc, amlt) where cmlc is at most 0.5; both tolerances are used under their own names."""
    n = F.array(*map(F.lit, VARIANTS))
    many = detections.select("track_id", F.explode(n).alias("variant"), "t")
    found = cml(many, variations(annotations), phase, tempo, "track_id", "variant")
    main = F.col("variant") == "same"
    g = found.groupBy("track_id").agg(
        F.max(F.when(main, F.col("cmlc"))).alias("cmlc"), F.max(F.when(main, F.col("cmlt"))).alias("cmlt"), F.max("cmlc").alias("_c"), F.max("cmlt").alias("_t"),
    )
    g = sizes(detections, annotations, "track_id").join(g, "track_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    few = (F.col("nd") <= 1) | (F.col("na") <= 1)
    best = lambda a, b: F.when(few, 0.0).when(zero("cmlc") > 0.5, zero(a)).otherwise(zero(b))
    return g.select("track_id", *[F.when(few, 0.0).otherwise(zero(c)).alias(c) for c in ("cmlc", "cmlt")], best("cmlc", "_c").alias("amlc"), best("cmlt", "_t").alias("amlt"))


def error_histogram(side: DataFrame, other: DataFrame, bins: int = BINS) -> DataFrame:
    """(track_id, bin, n): relative errors folded into (-0.5, 0.5], bins centred on multiples of 1 / bins; the ends are one bin."""
    r = relative(side, other, "track_id").where("relative is not null")
    return r.groupBy("track_id", F.pmod(F.floor((F.col("relative") + 0.5) * bins + 0.5), F.lit(bins)).alias("bin")).agg(F.count("*").alias("n"))


def entropy_gain(histogram: DataFrame, bins: int = BINS, *by: str) -> DataFrame:
    """log2(bins) minus the histogram's entropy."""
    share = F.col("n") / F.sum("n").over(Window.partitionBy(*by))
    h = histogram.withColumn("_p", share)
    return h.groupBy(*by).agg((math.log2(bins) + F.sum(F.col("_p") * F.log2("_p"))).alias("gain"))


def information_gain(detections: DataFrame, annotations: DataFrame, bins: int = BINS) -> DataFrame:
    """The smaller gain of both directions; 0 with fewer than two events on a side."""
    one, two = (entropy_gain(error_histogram(a, b, bins), bins, "track_id") for a, b in ((detections, annotations), (annotations, detections)))
    j = sizes(detections, annotations, "track_id").join(one.withColumnRenamed("gain", "f"), "track_id", "left").join(two.withColumnRenamed("gain", "b"), "track_id", "left")
    few = (F.col("nd") <= 1) | (F.col("na") <= 1)
    return j.select("track_id", F.when(few, 0.0).otherwise(F.least("f", "b")).alias("information_gain"))


def global_information_gain(detections: DataFrame, annotations: DataFrame, bins: int = BINS) -> DataFrame:
    """The gain of all files' summed histograms, each file's of its worse direction."""
    both = [error_histogram(a, b, bins).withColumn("way", F.lit(w)) for w, (a, b) in enumerate(((detections, annotations), (annotations, detections)))]
    h = both[0].unionByName(both[1])
    gains = entropy_gain(h, bins, "track_id", "way")
    pick = gains.groupBy("track_id").agg(F.min_by("way", F.struct("gain", -F.col("way"))).alias("way"))
    total = h.join(pick, ["track_id", "way"]).groupBy("bin").agg(F.sum("n").alias("n"))
    p = F.col("n") / F.col("s")
    return total.crossJoin(F.broadcast(total.agg(F.sum("n").alias("s")))).agg((math.log2(bins) + F.sum(p * F.log2(p))).alias("global_information_gain"))


def evaluate(detections: DataFrame, annotations: DataFrame, window: float = 0.07, skip: float = 0.0) -> DataFrame:
    """All beat metrics by track; events up to ``skip`` seconds are left out."""
    from trackloom.operators.matching import interval_accuracy

    d, a = (s.where(F.col("t") > skip) if skip > 0 else s for s in (detections, annotations))
    found = base.with_errors(base.matches(d, a, window), "track_id").select("track_id", "fmeasure", "precision", "recall")
    for part in (interval_accuracy(d, a, 0.2), cemgil(d, a), goto(d, a), continuity(d, a), information_gain(d, a)):
        found = found.join(part, "track_id", "left")
    return found


def mean(scores: DataFrame) -> DataFrame:
    """Plain means of evaluate()'s metrics over files."""
    return base.averaged(scores, *[c for c in scores.columns if c != "track_id"])

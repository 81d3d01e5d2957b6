"""Jump candidates between the rows of a track, as edges (track_id, src, dst), and the tables that walks run on.

A row's candidates are those of the row after it (the last row's successor is the first), so jumping replaces the next step. All are
equi joins on the track and what must agree; the rest are filters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trackloom.operators import sequence



def track():
    return Window.partitionBy("track_id")


def with_next(b: DataFrame, *columns: str) -> DataFrame:
    """Columns of the next row as next_<name>, the first row's after the last."""
    o = track().orderBy("idx")
    whole = o.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return b.withColumns({f"next_{c}": F.coalesce(F.lead(c).over(o), F.first(c).over(whole)) for c in columns})


def from_graph(edges: DataFrame, bars: DataFrame, apart: int = 8) -> DataFrame:
    """Edges of a similarity graph (track_id, src, dst, rank): those of the next row whose target has the next row's bar position and lies at least ``apart`` from the row itself; rank as in the graph."""
    n = with_next(bars.select("track_id", "idx", "bar_position"), "idx", "bar_position")
    theirs = bars.select("track_id", F.col("idx").alias("dst"), F.col("bar_position").alias("_bar"))
    j = edges.select("track_id", F.col("src").alias("next_idx"), "dst", "rank").join(n, ["track_id", "next_idx"]).join(theirs, ["track_id", "dst"])
    return j.where((F.col("_bar") == F.col("next_bar_position")) & (F.abs(F.col("dst") - F.col("idx")) >= apart)).select("track_id", F.col("idx").alias("src"), "dst", "rank")


def by_cluster(b: DataFrame, phase: str = "phase", apart: int = 0, loop_start: int = 0) -> DataFrame:
    """Rows of the next row's label, place in its run and phase, of another run than the row's and not the next row itself.

    b: (track_id, idx, label, run, place, phase). apart: at least so far from the next row (older rule: 0, newer: 8).
    """
    n = with_next(b.select("track_id", "idx", "label", "run", "place", phase), "idx", "label", "place", phase)
    n = n.select("track_id", F.col("idx").alias("src"), F.col("run").alias("_run"), "next_idx", *[F.col(f"next_{c}").alias(c) for c in ("label", "place", phase)])
    to = b.where(F.col("idx") >= loop_start).select("track_id", F.col("idx").alias("dst"), F.col("run").alias("_to"), "label", "place", phase)
    j = n.join(to, ["track_id", "label", "place", phase]).where((F.col("_to") != F.col("_run")) & (F.col("dst") != F.col("next_idx")))
    if apart:
        j = j.where(F.abs(F.col("dst") - F.col("next_idx")) >= apart)
    return j.select("track_id", "src", "dst")


def candidates_v1(b: DataFrame, loop_start: int = 0) -> DataFrame:
    """Phase is the row's number modulo four."""
    return by_cluster(sequence.with_runs(b).withColumn("phase", F.col("idx") % 4), loop_start=loop_start)


def candidates_v2(bars: DataFrame) -> DataFrame:
    """Phase is the bar position, and targets lie more than seven rows from the next one."""
    return by_cluster(sequence.with_runs(bars).withColumn("phase", F.col("bar_position")), apart=8)


def last_jump(edges: DataFrame) -> DataFrame:
    """(track_id, last, target): the last row with candidates and the lowest of them: where a loop closes. Tracks without candidates have none."""
    return edges.groupBy("track_id").agg(F.max("src").alias("last"), F.min_by("dst", F.struct(-F.col("src"), "dst")).alias("target"))


def successors(b: DataFrame, edges: DataFrame) -> DataFrame:
    """(track_id, idx, next): the next row; the last row with candidates goes to the lowest one."""
    j = b.select("track_id", "idx").join(last_jump(edges), "track_id", "left")
    return j.select("track_id", "idx", F.when(F.col("idx") == F.col("last"), F.col("target")).otherwise(F.col("idx") + 1).alias("next"))


def outro(b: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows behind the last one with candidates; none where a track has no candidates."""
    return b.join(last_jump(edges).select("track_id", "last"), "track_id").where("idx > last").drop("last")


def first_match(b: DataFrame, loop_start: int = 0) -> DataFrame:
    """(track_id, next): where the last row goes on: the first row of its label and the following phase within the first half, else the loop's start."""
    n = b.withColumn("_n", F.count("*").over(track()))
    last = n.where("idx = _n - 1").select("track_id", F.col("label").alias("_l"), ((F.col("idx") + 1) % 4).alias("_p"))
    j = n.join(last, "track_id")
    ok = (F.col("label") == F.col("_l")) & (F.col("idx") % 4 == F.col("_p")) & (F.col("idx") <= 0.5 * F.col("_n")) & (F.col("idx") >= loop_start)
    return j.groupBy("track_id").agg(F.coalesce(F.min(F.when(ok, F.col("idx"))), F.lit(loop_start).cast("long")).alias("next"))


def pruned(b: DataFrame, edges: DataFrame, least: int = 32) -> tuple[DataFrame, DataFrame]:
    """Rows without those at the end that have no candidates, but ``least`` rows stay; and the edges between rows that are left."""
    last = edges.groupBy("track_id").agg(F.max("src").alias("_last"))
    n = b.groupBy("track_id").agg(F.max("idx").alias("_top")).join(last, "track_id", "left")
    size = n.select("track_id", F.greatest(F.coalesce(F.col("_last") + 1, F.lit(0)), F.least(F.col("_top") + 1, F.lit(least))).alias("_n"))
    rows = b.join(size, "track_id").where(F.col("idx") < F.col("_n")).drop("_n")
    kept = edges.join(size, "track_id").where((F.col("src") < F.col("_n")) & (F.col("dst") < F.col("_n"))).drop("_n")
    return rows, kept


def trimmed_segments(segments: DataFrame, end: DataFrame) -> DataFrame:
    """Segments cut at the end (track_id, end_time) of a pruned track; those that begin behind it go."""
    j = segments.join(end.select("track_id", F.col("end_time").alias("_end")), "track_id")
    return j.withColumn("end_time", F.least("end_time", "_end")).where("start_time < end_time").drop("_end")


def nested(b: DataFrame, edges: DataFrame, order: str = "dst") -> DataFrame:
    """b with its candidates as an array, ordered by a column of the edges."""
    g = edges.groupBy("track_id", F.col("src").alias("idx")).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, F.col("dst").alias("_d")))), lambda x: x["_d"]).alias("candidates"))
    return b.join(g, ["track_id", "idx"], "left").withColumn("candidates", F.coalesce("candidates", F.expr("cast(array() as array<bigint>)")))


def candidate_stats(b: DataFrame) -> DataFrame:
    """(track_id, mean, least, most, none, one, few, some, many): rows by their number of candidates: 0, 1, 2-5, 6-10 and more."""
    n = F.size("candidates")
    return b.groupBy("track_id").agg(
        F.avg(n).alias("mean"), F.min(n).alias("least"), F.max(n).alias("most"), F.count_if(n == 0).alias("none"), F.count_if(n == 1).alias("one"),
        F.count_if((n >= 2) & (n <= 5)).alias("few"), F.count_if((n >= 6) & (n <= 10)).alias("some"), F.count_if(n > 10).alias("many"),
    )


def furthest(b: DataFrame, edges: DataFrame) -> DataFrame:
    """(track_id, src, dst): of each row's candidates in another quarter of the track the farthest, the first on ties."""
    q = sequence.quartiles(b.select("track_id", "idx"))
    one, two = q.select("track_id", F.col("idx").alias("src"), F.col("quartile").alias("a")), q.select("track_id", F.col("idx").alias("dst"), F.col("quartile").alias("z"))
    j = edges.join(one, ["track_id", "src"]).join(two, ["track_id", "dst"]).where("a <> z")
    return j.groupBy("track_id", "src").agg(F.max_by("dst", F.struct(F.abs(F.col("dst") - F.col("src")), -F.col("dst"))).alias("dst"))


def tick_durations(play: DataFrame, beats: DataFrame, default: float = 0.5) -> DataFrame:
    """A walk (track_id, step, beat) with the seconds of each step and of all steps before."""
    d = sequence.durations(beats).select("track_id", F.col("idx").alias("beat"), "duration")
    j = play.join(d, ["track_id", "beat"], "left").withColumn("duration", F.coalesce("duration", F.lit(default)))
    before = track().orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    return j.withColumn("stream", F.coalesce(F.sum("duration").over(before), F.lit(0.0)))


def at_position(play: DataFrame, positions: DataFrame) -> DataFrame:
    """(track_id, position, step, beat): the step that sounds at each position: the last one whose stream time isn't later."""
    marks = play.select("track_id", F.col("stream").alias("t"), F.struct("step", "beat").alias("s"), F.lit(0).alias("side"))
    asked = positions.select("track_id", F.col("position").alias("t"), F.lit(None).cast("struct<step:bigint,beat:bigint>").alias("s"), F.lit(1).alias("side"))
    w = track().orderBy("t", "side").rowsBetween(Window.unboundedPreceding, 0)
    u = marks.withColumn("s", F.col("s").cast("struct<step:bigint,beat:bigint>")).unionByName(asked).withColumn("s", F.last("s", ignorenulls=True).over(w))
    return u.where("side = 1").select("track_id", F.col("t").alias("position"), "s.step", "s.beat")


def angles(b: DataFrame) -> DataFrame:
    """The place of each row on a circle, from the top: 2 pi t / duration - pi / 2."""
    import math

    total = F.max("t").over(track())
    return b.withColumn("angle", F.when(total > 0, F.col("t") / total * 2 * math.pi).otherwise(0.0) - math.pi / 2)

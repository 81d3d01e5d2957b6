"""Mixing sources to target weights: a time-varying curriculum.

Each source has a weight schedule over training time u in [0, 1]. Integrating the schedules gives each source's cumulative
token demand; what a source can give is limited to ``max_epochs`` times its size, and the excess goes to the others by weight.
A source's documents stand in a fixed pseudo-random order; inverting the cumulative demand at a document's place in it gives
the training time at which it is read, and documents are range-sorted by that position.

Documents are placed with prefix sums in two levels, over (source, bucket of the hash) first, so that a source with a third of
all rows is spread over as many tasks as there are buckets.

Defined results: a null text has size 0 and is taken 0 words; null is a source of its own, last; an empty table gives an empty
result; repeated rows count each and stand in the order of their content; a source of size 0 has target 0. Only the columns
named are read, whatever the others are called.
"""

from __future__ import annotations

from bisect import bisect_left
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trackloom.llm._common import materialize

WORDS = r"[^\x20\x09-\x0D]+"
BUCKETS = 1024
#: A power of two.
GRID = 256
#: Sources whose curves are broadcast, 2 KB each; more are joined by a shuffle.
MOST_SOURCES = 4096
#: A schedule: weights at equally spaced times; between them the weight is linear. One number is a constant weight.
Schedule = tuple[float, ...]


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def water_fill(sizes: list[int], weights: list[float], total: float, most: float) -> list[float]:
    """Shares of total by weight, stopped at most times each size; the excess is reshared by weight until none is above."""
    out, open_, left = [0.0] * len(sizes), [k for k in range(len(sizes)) if sizes[k] > 0 and weights[k] > 0], float(total)
    while open_:
        whole = sum(weights[k] for k in open_)
        over = [k for k in open_ if left * weights[k] / whole > most * sizes[k]]
        if not over:
            for k in open_:
                out[k] = left * weights[k] / whole
            break
        for k in over:
            out[k] = float(most * sizes[k])
        left -= sum(out[k] for k in over)
        open_ = [k for k in open_ if k not in over]
    return out


def at(schedule: Schedule, u: float) -> float:
    if len(schedule) == 1:
        return schedule[0]
    x = u * (len(schedule) - 1)
    i = min(int(x), len(schedule) - 2)
    return schedule[i] + (schedule[i + 1] - schedule[i]) * (x - i)


def demand(schedules: list[Schedule], targets: list[float], grid: int = GRID) -> list[list[float]]:
    """Cumulative demand of each source at grid + 1 times, as shares of its target: the integral of its part of the mix."""
    mids = [(i + 0.5) / grid for i in range(grid)]
    rates = [[at(s, u) * (t > 0) for u in mids] for s, t in zip(schedules, targets, strict=True)]
    whole = [sum(r[i] for r in rates) or 1.0 for i in range(grid)]
    out = []
    for r in rates:
        c = [0.0, *accumulate(x / w for x, w in zip(r, whole, strict=True))]
        out.append([x / c[-1] for x in c] if c[-1] else [i / grid for i in range(grid + 1)])
    return out


def invert(curve: list[float], share: float) -> float:
    """The time at which the cumulative demand reaches a share."""
    i = min(max(bisect_left(curve, share), 1), len(curve) - 1)
    low, high = curve[i - 1], curve[i]
    return (i - 1 + ((share - low) / (high - low) if high > low else 0.0)) / (len(curve) - 1)


def sizes_of(docs: DataFrame, *, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    """Narrow rows (id, source, size, order, bucket), written once: the text is read a single time."""
    order = F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col))
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"), order.alias("order"))
    return materialize(rows.withColumn("bucket", bucket_of(F.col("order"))), "mix")


def bucket_of(order: Column) -> Column:
    return F.pmod(F.shiftrightunsigned(order, 20), F.lit(BUCKETS)).cast("int")


def source_table(rows: DataFrame) -> list[tuple[str | None, int]]:
    """(source, size) by code point, null last: one row for each source."""
    found = {r[0]: r[1] for r in rows.groupBy("source").agg(F.sum("size")).collect()}
    return sorted(found.items(), key=lambda x: (x[0] is None, x[0] or ""))


def mix(docs: DataFrame, *, schedules: dict | None = None, total_share: float = 1.0, max_epochs: float = 3.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 17) -> DataFrame:
    """One row for each document: id, source, size, source_size, target, taken (words), copies (whole readings), position, and its place in the source's order.

    schedules: by source; without it sources weigh 1, 2, 3, repeating. A document is read ``taken / size`` times: all documents
    of a source equally often, those that come first in its order once more, and the one at the border in part; copies counts
    that part if it is at least half. positions has the training time of each of a document's readings, position that of the first; null if it is never read.
    """
    rows = sizes_of(docs, id_col=id_col, text_col=text_col, source_col=source_col, seed=seed)
    sources = source_table(rows)
    plans = [(schedules or {}).get(s, (float(k % 3 + 1),) if schedules is None else (0.0,)) for k, (s, _) in enumerate(sources)]
    weights = [sum(at(p, (i + 0.5) / GRID) for i in range(GRID)) / GRID for p in plans]
    total = total_share * sum(n for _, n in sources)
    targets = water_fill([n for _, n in sources], weights, total, max_epochs)
    curves = demand(plans, targets)
    # One row for each source, so its size is that of source_table().
    plan = docs.sparkSession.createDataFrame(
        [(s, n, t, c) for (s, n), t, c in zip(sources, targets, curves, strict=True)], "source string, source_size long, target double, curve array<double>"
    )
    buckets = rows.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    ahead = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.withColumn("ahead", F.coalesce(F.sum("n").over(ahead), F.lit(0)))
    within = Window.partitionBy("source", "bucket").orderBy("order", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0)))
    b = buckets.select(F.col("source").alias("s2"), F.col("bucket").alias("b2"), "ahead")
    placed = placed.join(b, placed["source"].eqNullSafe(b["s2"]) & (placed["bucket"] == b["b2"])).drop("s2", "b2")
    p = plan.withColumnRenamed("source", "s3")
    placed = placed.join(F.broadcast(p) if len(sources) <= MOST_SOURCES else p, placed["source"].eqNullSafe(F.col("s3"))).drop("s3")
    words = F.round("target").cast("long")
    full = F.when(F.col("source_size") > 0, F.floor(words / F.col("source_size"))).otherwise(0).cast("long")
    before = F.col("ahead") + F.col("inside")
    left = words - full * F.col("source_size") - before
    more = F.greatest(F.lit(0), F.least(F.col("size"), left))
    placed = placed.withColumn("taken", full * F.col("size") + more).withColumn("full", full).withColumn("copies", full + ((left > 0) & (2 * left >= F.col("size"))).cast("long"))
    grid = GRID

    def time_of(r: Column) -> Column:
        share = (before + r * F.col("source_size")) / F.col("target")
        # Bisection: how many of the curve's first values are smaller.
        jumps = F.array(*[F.lit(1 << k) for k in reversed(range(grid.bit_length() - 1))], F.lit(1))
        found = F.aggregate(jumps, F.lit(0), lambda a, s: F.when(F.element_at("curve", a + s) < share, a + s).otherwise(a))
        step = F.greatest(F.lit(1), found)
        low, high = F.element_at("curve", step), F.element_at("curve", step + 1)
        return (step - 1 + F.when(high > low, (share - low) / (high - low)).otherwise(0.0)) / grid

    times = F.transform(F.sequence(F.lit(0), (F.col("full") + (more > 0).cast("long") - 1).cast("int")), time_of)
    placed = placed.withColumn("positions", F.when(F.col("taken") > 0, times)).withColumn("position", F.element_at("positions", 1))
    return placed.select(F.col("id").alias(id_col), "source", "size", "source_size", "target", "taken", "copies", "position", "positions", "full", "bucket", "order")


def readings(mixed: DataFrame) -> DataFrame:
    """One row for each reading of a document, range-sorted by its position: reading from 0, position, and words, less than size where the border cuts it."""
    columns = [c for c in mixed.columns if c not in ("position", "positions")]
    rows = mixed.select(*columns, F.posexplode("positions").alias("reading", "position"))
    return ordered(rows.withColumn("words", F.least("size", F.col("taken") - F.col("reading") * F.col("size"))))


def ordered(mixed: DataFrame) -> DataFrame:
    """Range-sorted by training position; documents that are never read come first, spread by their place in the source."""
    keys = ["position", "order"]
    # Written first, for the ranges are found by a pass of their own.
    return materialize(mixed, "positions").repartitionByRange(*keys).sortWithinPartitions(*keys)


def apply_mix(docs: DataFrame, *, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """docs with each row as often as the mix reads it whole (``copies``); same columns.

    What a source reads once more is all of its order up to one border, so one row per source says it for all its documents,
    and their texts need no shuffle.
    """
    columns = docs.columns
    placed = mix(docs, seed=seed, id_col=id_col, text_col=text_col, source_col=source_col, **options)
    more = F.col("copies") > F.col("full")
    cuts = placed.groupBy(F.col("source").alias("_mix_source")).agg(F.max("full").alias("_mix_full"), F.max(F.when(more, F.struct("bucket", "order"))).alias("_mix_cut"))
    cuts = materialize(cuts, "cuts")
    order = F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col))
    place = F.struct(bucket_of(order).alias("bucket"), order.alias("order"))
    small = cuts.count() <= 100_000
    joined = docs.join(F.broadcast(cuts) if small else cuts, docs[source_col].cast("string").eqNullSafe(F.col("_mix_source")), "left")
    copies = F.coalesce(F.col("_mix_full") + F.coalesce((place <= F.col("_mix_cut")).cast("long"), F.lit(0)), F.lit(0))
    repeated = joined.withColumn("_mix_copy", F.explode(F.array_repeat(F.lit(1), copies.cast("int"))))
    return repeated.select(*[F.col(f"`{c}`") for c in columns])


def op1(spark, sf_dir) -> DataFrame:
    mixed = ordered(mix(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies", "position")

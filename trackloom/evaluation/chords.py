"""Chord labels and segmentations (track_id, start, end, label).

A chord is struct(root, bass, intervals): pitch classes from C, and the set of intervals over the root as twelve bits, bit 0 for the
unison. No chord (N) is root and bass -1 without intervals; an unknown chord (X) has -1 in place of each interval.
Labels are parsed in a vectorised function, each distinct one once; all else is column expressions.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Semitones of the letters from C and of the degrees of the major scale, and the shorthands of chord qualities.
LETTERS = {"C": 0, "D": 2, "E": 4, "F": 5, "G": 7, "A": 9, "B": 11}
DEGREES = (0, 2, 4, 5, 7, 9, 11)
QUALITIES = {
    "maj": "1,3,5", "min": "1,b3,5", "dim": "1,b3,b5", "aug": "1,3,#5", "maj7": "1,3,5,7", "min7": "1,b3,5,b7", "7": "1,3,5,b7", "5": "1,5", "1": "1",
    "dim7": "1,b3,b5,bb7", "hdim7": "1,b3,b5,b7", "minmaj7": "1,b3,5,7", "maj6": "1,3,5,6", "min6": "1,b3,5,6", "9": "1,3,5,b7,9", "maj9": "1,3,5,7,9",
    "min9": "1,b3,5,b7,9", "sus2": "1,2,5", "sus4": "1,4,5", "11": "1,3,5,b7,9,11", "min11": "1,b3,5,b7,9,11", "13": "1,3,5,b7,13", "maj13": "1,3,5,7,13", "min13": "1,b3,5,b7,13",
}
CHORD = "struct<root:int,bass:int,intervals:array<int>>"
NO_CHORD, UNKNOWN = (-1, -1, [0] * 12), (-1, -1, [-1] * 12)


def accidentals(marks: str) -> int:
    if set(marks) - set("b#"):
        raise ValueError(f"unknown modifier: {marks}")
    return marks.count("#") - marks.count("b")


def pitch_class(name: str) -> int:
    return (LETTERS[name[0]] + accidentals(name[1:])) % 12


def interval(name: str) -> int:
    marks, degree = re.fullmatch(r"([b#]*)([0-9]+)", name).groups()
    return (DEGREES[(int(degree) - 1) % 7] + accidentals(marks)) % 12


def interval_bits(names: str, base: list[int] | None = None) -> list[int]:
    """Bits of a list like ``1,b3,*5``; a starred interval is taken out."""
    bits = list(base or [0] * 12)
    for x in filter(None, (x.strip() for x in names.split(","))):
        bits[interval(x.lstrip("*"))] = int(x[0] != "*")
    return bits


def quality_bits(quality: str) -> list[int]:
    """Bits of a shorthand, of a list in brackets, or of a shorthand changed by a list."""
    name, _, more = quality.partition("(")
    return interval_bits(more.rstrip(")"), interval_bits(QUALITIES[name]) if name else None)


def parse(label: str) -> tuple[int, int, list[int]]:
    """root[:quality][/bass]; major where no quality is given. The bass counts among the intervals."""
    if label == "N":
        return NO_CHORD
    if label == "X":
        return UNKNOWN
    main, _, bass_name = label.partition("/")
    root, colon, quality = main.partition(":")
    bits, bass = quality_bits(quality if colon else "maj"), interval(bass_name) if bass_name else 0
    bits[bass] = 1
    return pitch_class(root), bass, bits


def parsed(label: Column | str) -> Column:
    """The chord of a label; each distinct label of a batch is parsed once."""

    @F.pandas_udf(CHORD)
    def work(labels):
        import pandas as pd

        known = {x: parse(x) for x in labels.dropna().unique()}
        return pd.DataFrame([known.get(x, (None, None, None)) for x in labels], columns=["root", "bass", "intervals"]).astype({"root": "Int32", "bass": "Int32"})

    return work(label)


def encode(segments: DataFrame) -> DataFrame:
    """segments with a chord in place of the label."""
    return segments.withColumn("chord", parsed("label")).drop("label")


def merge(segments: DataFrame, column: str = "chord") -> DataFrame:
    """Neighbours of one chord as one segment."""
    w = Window.partitionBy("track_id").orderBy("start")
    new = F.coalesce((~F.col(column).eqNullSafe(F.lag(column).over(w))).cast("long"), F.lit(1))
    runs = segments.withColumn("_run", F.sum(new).over(w))
    return runs.groupBy("track_id", "_run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.first(column).alias(column)).drop("_run")


def adjusted(detections: DataFrame, annotations: DataFrame) -> DataFrame:
    """Detections cut to the annotations' span, and filled up to it with no chord."""
    span = annotations.groupBy("track_id").agg(F.min("start").alias("_a"), F.max("end").alias("_b"))
    ends = detections.groupBy("track_id").agg(F.min("start").alias("_c"), F.max("end").alias("_d"))
    filler = F.struct(F.lit(-1).alias("root"), F.lit(-1).alias("bass"), F.array_repeat(F.lit(0), 12).alias("intervals")).cast(CHORD)
    inside = detections.join(span, "track_id").where((F.col("end") > F.col("_a")) & (F.col("start") < F.col("_b")))
    inside = inside.select("track_id", F.greatest("start", "_a").alias("start"), F.least("end", "_b").alias("end"), "chord")
    gaps = span.join(ends, "track_id").select("track_id", F.explode(F.array(F.struct(F.col("_a").alias("start"), F.col("_c").alias("end")), F.struct(F.col("_d").alias("start"), F.col("_b").alias("end")))).alias("g"))
    gaps = gaps.select("track_id", "g.start", "g.end", filler.alias("chord")).where("start < end")
    return inside.unionByName(gaps)


def pairs(detections: DataFrame, annotations: DataFrame) -> DataFrame:
    """Both sides cut at all boundaries: (track_id, start, duration, annotated, detected), each the chord that began last."""
    empty = F.lit(None).cast(CHORD)
    marks = [
        annotations.select("track_id", F.col("start").alias("t"), F.struct("chord").alias("a"), F.lit(None).cast(f"struct<chord:{CHORD}>").alias("d")),
        detections.select("track_id", F.col("start").alias("t"), F.lit(None).cast(f"struct<chord:{CHORD}>").alias("a"), F.struct("chord").alias("d")),
        *[s.select("track_id", F.col("end").alias("t"), F.lit(None).cast(f"struct<chord:{CHORD}>").alias("a"), F.lit(None).cast(f"struct<chord:{CHORD}>").alias("d")) for s in (annotations, detections)],
    ]
    u = marks[0]
    for m in marks[1:]:
        u = u.unionByName(m)
    u = u.groupBy("track_id", "t").agg(F.first("a", ignorenulls=True).alias("a"), F.first("d", ignorenulls=True).alias("d"))
    w = Window.partitionBy("track_id").orderBy("t")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    out = u.select(
        "track_id", F.col("t").alias("start"), (F.lead("t").over(w) - F.col("t")).alias("duration"),
        F.coalesce(F.last("a", ignorenulls=True).over(so_far)["chord"], empty).alias("annotated"), F.coalesce(F.last("d", ignorenulls=True).over(so_far)["chord"], empty).alias("detected"),
    )
    return out.where("duration is not null")


def has(bits: Column, k: int) -> Column:
    """Whether an interval is set; an unknown chord's count as set."""
    return F.get(bits, k) != 0


def bits(names: str) -> Column:
    return F.array(*map(F.lit, interval_bits(names)))


def chosen(rules: list[tuple[Column, Column]], default: Column) -> Column:
    """The value of the last rule that holds."""
    out = default
    for test, value in rules:
        out = F.when(test, value).otherwise(out)
    return out


def with_bass(chord: Column, intervals: Column, keep_bass: bool) -> Column:
    silent = F.forall(intervals, lambda x: x == 0)
    bass = F.when(silent, -1).otherwise(F.when(F.get(intervals, chord["bass"]) == 1, chord["bass"]).otherwise(0) if keep_bass else F.lit(0))
    return F.struct(chord["root"].alias("root"), bass.cast("int").alias("bass"), intervals.alias("intervals"))


def triad_bits(v: Column) -> Column:
    """The intervals without what lies beyond the triad: by third and fifth, else suspended, else a power chord or a single note."""
    silent = F.forall(v, lambda x: x == 0)
    third, major, fifth = has(v, 3), has(v, 4), has(v, 7)
    rules = [
        (~silent, bits("1")), (has(v, 0) & fifth, bits("1,5")), (~has(v, 5) & has(v, 2), bits("1,2,5")), (has(v, 5) & ~has(v, 2), bits("1,4,5")),
        (third, bits("1,b3,5")), (third & has(v, 8) & ~fifth, bits("1,b3,#5")), (third & has(v, 6) & ~fifth, bits("1,b3,b5")),
        (major, bits("1,3,5")), (major & has(v, 6) & ~fifth, bits("1,3,b5")), (major & has(v, 8) & ~fifth, bits("1,3,#5")),
    ]
    return chosen(rules, v)


def triad(chord: Column, keep_bass: bool = False) -> Column:
    return with_bass(chord, triad_bits(chord["intervals"]), keep_bass)


def tetrad(chord: Column, keep_bass: bool = False) -> Column:
    return with_bass(chord, tetrad_bits(chord["intervals"]), keep_bass)


def tetrad_bits(v: Column) -> Column:
    """The same for four notes: a triad's family with its sixth or seventh; of several the last rule holds: sixth, major seventh, minor seventh."""
    silent = F.forall(v, lambda x: x == 0)
    second, fourth, third, major, fifth = has(v, 2), has(v, 5), has(v, 3), has(v, 4), has(v, 7)
    sixth, top, seventh = has(v, 9), has(v, 11), has(v, 10)
    families = [
        (~fourth & second, "1,2,5", "6", "7", "b7"), (fourth & ~second, "1,4,5", "6", "7", "b7"), (third, "1,b3,5", "6", "7", "b7"),
        (third & ~fifth & has(v, 8), "1,b3,#5", None, "7", "b7"), (third & ~fifth & has(v, 6), "1,b3,b5", "bb7", None, "b7"),
        (major, "1,3,5", "6", "7", "b7"), (major & ~fifth & has(v, 6), "1,3,b5", None, "7", "b7"), (major & ~fifth & has(v, 8), "1,3,#5", None, "7", "b7"),
    ]
    rules = [(~silent, bits("1")), (has(v, 0) & fifth, bits("1,5"))]
    for test, notes, a, b, c in families:
        rules.append((test, bits(notes)))
        rules += [(test & more, bits(f"{notes},{name}")) for more, name in ((sixth, a), (top, b), (seventh, c)) if name]
    return chosen(rules, v)


def one_of(chord: Column, *qualities: str) -> Column:
    out = F.forall(chord["intervals"], lambda x: x == 0)
    for q in qualities:
        out = out | (chord["intervals"] == bits(QUALITIES[q]))
    return out


def is_majmin(chord: Column) -> Column:
    """Major, minor or no chord."""
    return one_of(chord, "maj", "min")


def is_seventh(chord: Column) -> Column:
    return one_of(chord, "maj", "min", "7", "min7", "maj7")


def same_root(a: Column, b: Column) -> Column:
    return (a["root"] == b["root"]).cast("double")


def same(a: Column, b: Column) -> Column:
    return ((a["root"] == b["root"]) & (a["bass"] == b["bass"]) & (a["intervals"] == b["intervals"])).cast("double")


def hamming(cut: DataFrame, by: DataFrame) -> DataFrame:
    """(track_id, distance): of each segment of ``cut`` what its longest piece between the boundaries of ``by`` leaves out, over the whole span."""
    a = cut.select("track_id", "start", "end")
    # Boundaries inside a segment join it by the segment that began last.
    w = Window.partitionBy("track_id").orderBy("t", "side").rowsBetween(Window.unboundedPreceding, 0)
    marks = by.select("track_id", F.explode(F.array("start", "end")).alias("t")).distinct().withColumn("side", F.lit(1)).withColumn("s", F.lit(None).cast("struct<start:double,end:double>"))
    own = a.select("track_id", F.col("start").alias("t"), F.lit(0).alias("side"), F.struct(F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end")).alias("s"))
    u = own.unionByName(marks.select("track_id", "t", "side", "s")).withColumn("s", F.last("s", ignorenulls=True).over(w))
    points = u.where("s is not null and t >= s.start and t < s.end").select("track_id", "s.start", "s.end", "t").distinct()
    seg = Window.partitionBy("track_id", "start").orderBy("t")
    gaps = points.withColumn("gap", F.coalesce(F.lead("t").over(seg), F.col("end")) - F.col("t"))
    lost = gaps.groupBy("track_id", "start", "end").agg((F.first("end") - F.first("start") - F.max("gap")).alias("lost"))
    return lost.groupBy("track_id").agg((F.sum("lost") / (F.max("end") - F.min("start"))).alias("distance"))


METRICS = ("root", "majmin", "majminbass", "sevenths", "seventhsbass")


def weighted(found: DataFrame, *by: str) -> DataFrame:
    """Duration-weighted scores of pairs(): equal roots, and equal triads and tetrads, without and with the bass, where the annotation is one of the chords that count; null where nothing does."""
    f = found
    for side in ("annotated", "detected"):
        f = f.withColumn(f"_{side}3", triad_bits(F.col(f"{side}.intervals"))).withColumn(f"_{side}4", tetrad_bits(F.col(f"{side}.intervals")))
    for k in (3, 4):
        f = f.withColumns({f"_{side}{k}": with_bass(F.col(side), F.col(f"_{side}{k}"), True) for side in ("annotated", "detected")})
    f = f.withColumn("_m", is_majmin(F.col("_annotated3"))).withColumn("_s", is_seventh(F.col("_annotated4")))
    root = F.col("annotated.root") == F.col("detected.root")
    equal = lambda k, field: F.col(f"_annotated{k}.{field}") == F.col(f"_detected{k}.{field}")
    triads, tetrads = root & equal(3, "intervals"), root & equal(4, "intervals")
    scores = {"root": (root, F.lit(True)), "majmin": (triads, F.col("_m")), "majminbass": (triads & equal(3, "bass"), F.col("_m")), "sevenths": (tetrads, F.col("_s")), "seventhsbass": (tetrads & equal(4, "bass"), F.col("_s"))}
    aggs = []
    for name, (right, counts) in scores.items():
        weight = F.when(counts, F.col("duration")).otherwise(0.0)
        aggs.append((F.sum(F.when(right, weight).otherwise(0.0)) / F.nullif(F.sum(weight), F.lit(0.0))).alias(name))
    return f.groupBy(*by).agg(*aggs, F.sum("duration").alias("length"))


def prepared(detections: DataFrame, annotations: DataFrame) -> tuple[DataFrame, DataFrame]:
    a = merge(encode(annotations))
    return merge(adjusted(encode(detections), a)), a


def evaluate(detections: DataFrame, annotations: DataFrame) -> DataFrame:
    """One row for each track: root, majmin, majminbass, sevenths, seventhsbass, over-, undersegmentation and the smaller of both."""
    d, a = prepared(detections, annotations)
    under = hamming(d, a).select("track_id", (1 - F.col("distance")).alias("undersegmentation"))
    over = hamming(a, d).select("track_id", (1 - F.col("distance")).alias("oversegmentation"))
    out = weighted(pairs(d, a), "track_id").join(under, "track_id").join(over, "track_id")
    return out.withColumn("segmentation", F.least("undersegmentation", "oversegmentation"))


def total(detections: DataFrame, annotations: DataFrame) -> DataFrame:
    """All tracks as one: scores over all durations, segmentations weighted by length."""
    d, a = prepared(detections, annotations)
    scores = weighted(pairs(d, a))
    each = evaluate(detections, annotations)
    seg = each.agg(*[(F.sum(F.col(c) * F.col("length")) / F.sum("length")).alias(c) for c in ("undersegmentation", "oversegmentation", "segmentation")])
    return scores.crossJoin(F.broadcast(seg))


def mean(scores: DataFrame) -> DataFrame:
    """Plain means over tracks."""
    return scores.agg(*[F.avg(c).alias(c) for c in (*METRICS, "undersegmentation", "oversegmentation", "segmentation")])


def majmin_labels(targets: DataFrame, fps: float, column: str = "target") -> DataFrame:
    """(track_id, start, end, label) of frame classes (track_id, frame, target): 0 to 11 major from A, then minor, 24 no chord."""
    names = ["A", "A#", "B", "C", "C#", "D", "D#", "E", "F", "F#", "G", "G#"]
    labels = F.array(*[F.lit(x) for x in [f"{n}:maj" for n in names] + [f"{n}:min" for n in names] + ["N"]])
    f = targets.select("track_id", (F.col("frame") / fps).alias("start"), ((F.col("frame") + 1) / fps).alias("end"), F.element_at(labels, F.col(column).cast("int") + 1).alias("chord"))
    return merge(f).select("track_id", "start", "end", F.col("chord").alias("label"))

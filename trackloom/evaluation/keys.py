"""Musical keys: labels to classes and scores of wrong keys by their kinship."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Note names and semitones, and the class names of key models.
SEMITONES = {"c": 0, "c#": 1, "db": 1, "d": 2, "d#": 3, "eb": 3, "e": 4, "f": 5, "f#": 6, "gb": 6, "g": 7, "g#": 8, "ab": 8, "a": 9, "a#": 10, "bb": 10, "b": 11, "cb": 11}
KEYS = (
    "A major", "Bb major", "B major", "C major", "Db major", "D major", "Eb major", "E major", "F major", "F# major", "G major", "Ab major",
    "A minor", "Bb minor", "B minor", "C minor", "C# minor", "D minor", "D# minor", "E minor", "F minor", "F# minor", "G minor", "G# minor",
)
KINDS = ("correct", "fifth", "relative", "parallel", "other")


def key_class(label: Column) -> Column:
    """0 to 11 for major keys from C, 12 to 23 for minor ones; null for other labels."""
    parts = F.split(F.trim(label), r"\s+")
    table = F.create_map(*[F.lit(x) for kv in SEMITONES.items() for x in kv])
    mode = F.when(F.get(parts, 1).isin("major", "maj"), 0).when(F.get(parts, 1).isin("minor", "min"), 12)
    return F.when(F.size(parts) == 2, F.try_element_at(table, F.lower(F.get(parts, 0))) + mode)


def kinship(detected: Column, annotated: Column, strict_fifth: bool = False) -> Column:
    """struct(score, kind): correct 1, a fifth off 0.5, relative 0.3, parallel 0.2, other 0. strict_fifth: only the fifth above counts."""
    step = F.pmod(detected % 12 - annotated % 12, F.lit(12))
    same = F.floor(detected / 12) == F.floor(annotated / 12)
    minor = annotated >= 12
    cases = [
        (same & (step == 0), 1.0, "correct"), (same & step.isin(*((7,) if strict_fifth else (7, 5))), 0.5, "fifth"),
        (~same & (step == F.when(minor, 3).otherwise(9)), 0.3, "relative"), (~same & (step == 0), 0.2, "parallel"),
    ]
    score, kind = F.when(detected.isNull() | annotated.isNull(), None), F.when(detected.isNull() | annotated.isNull(), None)
    for test, s, k in cases:
        score, kind = score.when(test, s), kind.when(test, k)
    return F.struct(score.otherwise(0.0).alias("score"), kind.otherwise("other").alias("kind"))


def evaluate(pairs: DataFrame, detected: str = "detected", annotated: str = "annotated", strict_fifth: bool = False) -> DataFrame:
    """pairs of labels with score and kind."""
    return pairs.withColumn("_k", kinship(key_class(F.col(detected)), key_class(F.col(annotated)), strict_fifth)).select(*pairs.columns, "_k.score", "_k.kind")


def mean(scores: DataFrame) -> DataFrame:
    """The share of each kind, and the mean score (weighted)."""
    return scores.agg(*[F.avg((F.col("kind") == k).cast("double")).alias(k) for k in KINDS], F.avg("score").alias("weighted"))


def label_of(prediction: Column | str) -> Column:
    """The name of the strongest of 24 classes, the first on ties."""
    p = F.col(prediction) if isinstance(prediction, str) else prediction
    return F.element_at(F.array(*map(F.lit, KEYS)), F.array_position(p, F.array_max(p)).cast("int"))

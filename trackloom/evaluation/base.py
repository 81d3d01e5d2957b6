"""Counts, scores and reports shared by the evaluations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trackloom.operators.matching import closest

COUNTS = ("tp", "fp", "tn", "fn")


def ratio(a: Column, b: Column, empty: float) -> Column:
    return F.when(b == 0, empty).otherwise(a / b)


def with_scores(counts: DataFrame) -> DataFrame:
    """Adds precision, recall, fmeasure and accuracy to tp, fp, tn, fn; empty denominators give 1, 1, 0 and 1."""
    tp, fp, tn, fn = (F.col(c) for c in COUNTS)
    out = counts.withColumn("precision", ratio(tp, tp + fp, 1.0)).withColumn("recall", ratio(tp, tp + fn, 1.0))
    p, r = F.col("precision"), F.col("recall")
    return out.withColumn("fmeasure", ratio(2 * p * r, p + r, 0.0)).withColumn("accuracy", ratio(tp + tn, tp + fp + tn + fn, 1.0))


def counted(flags: DataFrame, *by: str) -> DataFrame:
    """Counts of rows by what they are: a column ``kind`` of tp, fp, tn, fn; scores added."""
    aggs = [F.count_if(F.col("kind") == c).alias(c) for c in COUNTS]
    return with_scores(flags.groupBy(*by).agg(*aggs))


def by_class(flags: DataFrame, label: str = "label") -> DataFrame:
    """Scores for each class and for all (class null), in one aggregation of grouping sets."""
    aggs = [F.count_if(F.col("kind") == c).alias(c) for c in COUNTS]
    return with_scores(flags.groupingSets([[F.col(label)], []], label).agg(*aggs))


def pooled(counts: DataFrame) -> DataFrame:
    """Scores of the summed counts of all files."""
    return with_scores(counts.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTS]))


def averaged(scores: DataFrame, *metrics: str) -> DataFrame:
    """Plain means over files; null and NaN are left out."""
    return scores.agg(*[F.avg(F.nanvl(F.col(m).cast("double"), F.lit(None))).alias(m) for m in metrics])


def relative_errors(detections: DataFrame, annotations: DataFrame) -> DataFrame:
    """abs(1 - error / nearest annotation)."""
    return closest(detections, annotations).withColumn("relative", F.abs(1 - F.col("error") / F.col("match")))


def matches(detections: DataFrame, annotations: DataFrame, window: float, *keys: str) -> DataFrame:
    """Greedy one-to-one matching of the sorted events of both sides: rows (keys, t, kind, error), an annotation's t if it is missed.

    A fold over one group's two sorted lists, linear in their lengths; groups are files, or files and pitches.
    """
    keys = keys or ("track_id",)

    def work(key, d, a):
        import pandas as pd

        x, y = sorted(d["t"]), sorted(a["t"])
        i = j = 0
        out: list[tuple] = []
        while i < len(x) and j < len(y):
            if abs(x[i] - y[j]) <= window:
                out.append((x[i], "tp", x[i] - y[j]))
                i, j = i + 1, j + 1
            elif x[i] < y[j]:
                out.append((x[i], "fp", None))
                i += 1
            else:
                out.append((y[j], "fn", None))
                j += 1
        out += [(t, "fp", None) for t in x[i:]] + [(t, "fn", None) for t in y[j:]]
        found = pd.DataFrame(out, columns=["t", "kind", "error"]).astype({"error": "float64"})
        for k, v in reversed(list(zip(keys, key, strict=True))):
            found.insert(0, k, v)
        return found

    d, a = (s.select(*keys, F.col("t").cast("double").alias("t")) for s in (detections, annotations))
    schema = d.withColumn("kind", F.lit(None).cast("string")).withColumn("error", F.lit(None).cast("double")).schema
    renamed = a.toDF(*(f"a_{k}" for k in keys), "t")
    return d.groupBy(*keys).cogroup(renamed.groupBy(*(f"a_{k}" for k in keys))).applyInPandas(work, schema)


def with_errors(found: DataFrame, *by: str) -> DataFrame:
    """counted() with mean and deviation of the matches' errors; null without a match."""
    aggs = [F.count_if(F.col("kind") == c).alias(c) for c in COUNTS]
    return with_scores(found.groupBy(*by).agg(*aggs, F.avg("error").alias("mean_error"), F.stddev_pop("error").alias("std_error")))


def paired_files(detections: DataFrame, annotations: DataFrame, detection_suffix: str, annotation_suffix: str) -> DataFrame:
    """(stem, detection, annotation) of two lists of paths by their names without the suffixes; null where a side is missing."""

    def stems(df: DataFrame, suffix: str, name: str) -> DataFrame:
        base = F.element_at(F.split("path", "/"), -1)
        return df.where(F.endswith("path", F.lit(suffix))).select(F.substring(base, 1, F.length(base) - len(suffix)).alias("stem"), F.col("path").alias(name))

    return stems(detections, detection_suffix, "detection").join(stems(annotations, annotation_suffix, "annotation"), "stem", "full")


def report(scores: DataFrame, metrics: list[tuple[str, str]], name: str = "name", style: str = "text", digits: int = 3) -> DataFrame:
    """Lines of a report, numbers rounded half to even: a heading (n = 0) and one for each row in order of its name. style: text, csv or tex."""
    glue, end = {"text": ("  ", ""), "csv": (",", ""), "tex": (" & ", r"\\")}[style]
    values = [F.format_string(f"%.{digits}f", F.bround(F.col(m).cast("double"), digits)) for m, _ in metrics]
    if style == "text":
        values = [F.concat(F.lit(f"{label}: "), v) for v, (_, label) in zip(values, metrics, strict=True)]
    line = F.concat(F.concat_ws(glue, F.col(name).cast("string"), *values), F.lit(end))
    body = scores.select(F.row_number().over(Window.orderBy(name)).alias("n"), line.alias("line"))
    if style == "text":
        return body
    head = scores.sparkSession.createDataFrame([(0, glue.join(["Name", *(label for _, label in metrics)]) + end)], "n int, line string")
    return head.unionByName(body)


def mcnemar(pairs: DataFrame, a: str = "a", b: str = "b", significance: float = 0.01) -> DataFrame:
    """(better, p): whether test a (1) or b (-1) is significantly better, or neither (0); null with fewer than 25 differing cases."""
    import math

    @F.pandas_udf("double")
    def tail(x):
        # The upper tail of chi square with one degree of freedom.
        return x.map(lambda v: math.erfc(math.sqrt(v / 2)) if v == v else None)

    n = pairs.agg(F.count_if(F.col(a) > F.col(b)).alias("b"), F.count_if(F.col(a) < F.col(b)).alias("c"))
    stat = F.when(F.col("b") + F.col("c") >= 25, F.pow(F.col("b") - F.col("c"), F.lit(2)) / (F.col("b") + F.col("c")))
    n = n.withColumn("p", tail(stat))
    return n.select(F.when(F.col("p").isNull(), None).when(F.col("p") >= significance, 0).when(F.col("b") > F.col("c"), 1).otherwise(-1).alias("better"), "p")

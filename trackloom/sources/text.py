"""Text files of events, beats, notes, segments, keys and tempi: one row for each line, the track named after the file.

Readers take a path, folder or glob, split on white space and skip what follows ``#``. Writers make one file for each track
(``track_id=.../part``) in a folder, sorted by time within it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.sources.files import stem_of


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(track_id, fields) of the lines with content."""
    text = spark.read.text(path, recursiveFileLookup=True).select(stem_of(F.input_file_name()).alias("track_id"), F.trim(F.regexp_replace("value", "#.*$", "")).alias("line"))
    return text.where("line <> ''").select("track_id", F.split("line", r"\s+").alias("f"))


def field(k: int, kind: str = "double") -> Column:
    return F.get("f", k).try_cast(kind)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """(track_id, t): the first column."""
    return lines(spark, path).select("track_id", field(0).alias("t"))


def read_beats(spark: SparkSession, path: str, downbeats: bool = False) -> DataFrame:
    """(track_id, t, position); position is null where the file has one column. downbeats: those at position 1 only."""
    b = lines(spark, path).select("track_id", field(0).alias("t"), field(1).cast("long").alias("position"))
    return b.where("position = 1") if downbeats else b


def read_notes(spark: SparkSession, path: str) -> DataFrame:
    """(track_id, onset, pitch, duration, velocity); what is missing is null."""
    return lines(spark, path).select("track_id", field(0).alias("onset"), field(1).alias("pitch"), field(2).alias("duration"), field(3).alias("velocity"))


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """(track_id, start, end, label)."""
    return lines(spark, path).select("track_id", field(0).alias("start"), field(1).alias("end"), F.get("f", 2).alias("label"))


def read_key(spark: SparkSession, path: str) -> DataFrame:
    """(track_id, key): the whole file without white space around it."""
    text = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    return text.select(stem_of(F.input_file_name()).alias("track_id"), F.regexp_replace("value", r"^\s+|\s+$", "").alias("key"))


def read_tempo(spark: SparkSession, path: str, split: float = 1.0) -> DataFrame:
    """(track_id, pos, tempo, strength): values above ``split`` are tempi, the others their strengths.

    One strength too few is what the others leave to 1; without any, or with a sum of 0, all are equal. Files whose numbers don't
    fit together give no rows.
    """
    values = lines(spark, path).select("track_id", F.posexplode("f").alias("p", "v")).select("track_id", "p", F.col("v").try_cast("double").alias("v")).where("v is not null")
    g = values.groupBy("track_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "v"))), lambda x: x["v"]).alias("v"))
    g = g.select("track_id", F.filter("v", lambda x: x > split).alias("tempi"), F.filter("v", lambda x: x <= split).alias("s"))
    total = F.aggregate("s", F.lit(0.0), lambda a, x: a + x)
    s = F.when(F.size("tempi") - F.size("s") == 1, F.concat("s", F.array(1 - total))).otherwise(F.col("s"))
    s = F.when(total == 0, F.transform("tempi", lambda _: 1 / F.size("tempi"))).otherwise(s)
    g = g.withColumn("s", s).where((F.size("tempi") == F.size("s")) & ~F.exists("s", lambda x: x < 0))
    return g.select("track_id", F.posexplode(F.arrays_zip("tempi", "s")).alias("pos", "x")).select("track_id", "pos", F.col("x.tempi").alias("tempo"), F.col("x.s").alias("strength"))


def write_lines(df: DataFrame, path: str, order: str, line: Column, header: str | None = None) -> None:
    """One folder for each track with one text file, its lines in order."""
    rows = df.select("track_id", F.col(order).alias("_o"), line.alias("value"))
    if header is not None:
        first = df.select("track_id").distinct().select("track_id", F.lit(None).cast(dict(rows.dtypes)["_o"]).alias("_o"), F.lit(f"# {header}").alias("value"))
        rows = first.unionByName(rows)
    rows.repartition("track_id").sortWithinPartitions("track_id", F.col("_o").asc_nulls_first()).select("track_id", "value").write.mode("overwrite").partitionBy("track_id").text(path)


def joined(*formats: tuple[str, str], sep: str = "\t") -> Column:
    """Columns printed by formats, numbers rounded half to even; null columns are left out."""
    return F.concat_ws(sep, *[F.when(F.col(c).isNotNull(), F.format_string(f, printed(F.col(c), f))) for c, f in formats])


def printed(c: Column, form: str) -> Column:
    return c.cast("long") if form.endswith("d") else F.bround(c.cast("double"), int(form[2:-1])) if form.endswith("f") else c


def write_events(events: DataFrame, path: str, form: str = "%.3f", header: str | None = None) -> None:
    write_lines(events, path, "t", joined(("t", form)), header)


def write_beats(beats: DataFrame, path: str, downbeats: bool = False, header: str | None = None) -> None:
    """Time and, where there is one, position; downbeats: the times at position 1."""
    if downbeats:
        write_events(beats.where("position = 1"), path, header=header)
    else:
        write_lines(beats, path, "t", joined(("t", "%.3f"), *([("position", "%d")] if "position" in beats.columns else [])), header)


def write_notes(notes: DataFrame, path: str, header: str | None = None) -> None:
    forms = (("onset", "%.3f"), ("pitch", "%d"), ("duration", "%.3f"), ("velocity", "%d"))
    write_lines(notes, path, "onset", joined(*(f for f in forms if f[0] in notes.columns)), header)


def write_segments(segments: DataFrame, path: str, header: str | None = None) -> None:
    write_lines(segments, path, "start", joined(("start", "%.3f"), ("end", "%.3f"), ("label", "%s")), header)


def write_key(keys: DataFrame, path: str, header: str | None = None) -> None:
    write_lines(keys, path, "key", F.col("key"), header)


def tempo_lines(tempi: DataFrame, slower_first: bool = False) -> DataFrame:
    """(track_id, t1, t2, strength): the two first tempi and the first one's share; one alone has strength 1. slower_first: ordered by tempo."""
    two = tempi.where("pos < 2").groupBy("track_id").agg(F.array_sort(F.collect_list(F.struct("pos", "tempo", "strength"))).alias("a"))
    first, second = F.get("a", 0), F.get("a", 1)
    share = F.when(F.size("a") == 1, 1.0).otherwise(first["strength"] / (first["strength"] + second["strength"]))
    out = two.select("track_id", first["tempo"].alias("t1"), second["tempo"].alias("t2"), share.alias("strength"))
    if not slower_first:
        return out
    turn = F.col("t1") > F.col("t2")
    return out.select("track_id", F.when(turn, F.col("t2")).otherwise(F.col("t1")).alias("t1"), F.when(turn, F.col("t1")).otherwise(F.col("t2")).alias("t2"), F.when(turn, 1 - F.col("strength")).otherwise(F.col("strength")).alias("strength"))


def write_tempo(tempi: DataFrame, path: str, slower_first: bool = False, header: str | None = None) -> None:
    """One line: both tempi and the strength; nan where there is no second one."""
    t = tempo_lines(tempi, slower_first)
    number = lambda c: F.coalesce(F.when(F.col(c).isNotNull(), F.format_string("%.2f", F.bround(F.col(c), 2))), F.lit("nan"))
    write_lines(t, path, "t1", F.concat_ws("\t", *map(number, ("t1", "t2", "strength"))), header)


def write_activations(rows: DataFrame, path: str) -> None:
    """(track_id, idx, x, fps) as a table by track."""
    rows.repartition("track_id").sortWithinPartitions("track_id", "idx").write.mode("overwrite").partitionBy("track_id").parquet(path)


def read_activations(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)

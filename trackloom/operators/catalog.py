"""Operators on catalogs (source, artist, title): search, upsert, delete, order, title cleaning, cache misses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def search(catalog: DataFrame, words: str) -> DataFrame:
    return catalog.where(F.contains(F.lower(F.concat_ws(" ", "artist", "title")), F.lit(words.lower())))


def upsert(catalog: DataFrame, changes: DataFrame) -> DataFrame:
    """Rows of changes replace those of the same source or are added."""
    return catalog.join(changes.select("source"), "source", "left_anti").unionByName(changes)


def delete(catalog: DataFrame, sources: DataFrame) -> DataFrame:
    return catalog.join(sources.select("source").distinct(), "source", "left_anti")


def misses(requests: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """Requests that the cache has not."""
    return requests.join(cache.select(key).distinct(), key, "left_anti")


#: What may stand between artist and title, in the order in which it is tried; parts of messages of an outdated downloader.
SEPARATORS = (" - ", " \u2013 ", " \u2014 ", " | ", ": ", "-", "\u2013", "\u2014", "|", ":")
OUTDATED = ("403", "HTTP Error", "Unable to extract", "Sign in to confirm")


def clean_title(artist: Column, title: Column) -> Column:
    """Drops the artist in front, in either case, one separator and white space; the title stays as it is if it begins otherwise or no letter or digit is left."""
    rest = F.substring(title, F.length(artist) + 1, F.length(title))
    cut = rest
    for sep in reversed(SEPARATORS):
        cut = F.when(F.startswith(rest, F.lit(sep)), F.substring(rest, len(sep) + 1, F.length(rest))).otherwise(cut)
    cut = F.trim(cut)
    return F.when(F.startswith(F.lower(title), F.lower(artist)) & F.regexp_like(cut, F.lit(r"[\p{L}\p{N}]")), cut).otherwise(title)


def is_outdated(message: Column) -> Column:
    """Whether a download failed for reasons that a newer downloader may mend."""
    out = F.lit(False)
    for p in OUTDATED:
        out = out | F.contains(message, F.lit(p))
    return out


def present(catalog: DataFrame, sources: DataFrame) -> DataFrame:
    """The sources that the catalog has."""
    return sources.select("source").distinct().join(catalog.select("source"), "source", "left_semi")


def in_order(catalog: DataFrame) -> DataFrame:
    """place from 1 by artist and title in lower case, then source."""
    from pyspark.sql.window import Window

    return catalog.withColumn("place", F.row_number().over(Window.orderBy(F.lower("artist"), F.lower("title"), "source")))


def title_case(title: Column) -> Column:
    """Capitals on all words where the first letter is a small one."""
    return F.when(F.regexp_like(title, F.lit(r"^\p{Ll}")), F.initcap(title)).otherwise(title)


def clock(seconds: Column) -> Column:
    """hh:mm:ss of whole seconds."""
    s = F.floor(seconds).cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600).cast("long"), F.pmod(F.floor(s / 60), F.lit(60)).cast("long"), F.pmod(s, F.lit(60)))


def cache_key(url: Column) -> Column:
    return F.url_encode(url)


def display_title(title: Column, path: Column) -> Column:
    """The title, or the file's name where there is none."""
    from trackloom.sources.files import stem_of

    return F.coalesce(F.when(F.trim(title) != "", title), stem_of(path))


def next_ids(queue: DataFrame) -> DataFrame:
    """(device, id): the number that the device's next message gets."""
    return queue.groupBy("device").agg((F.coalesce(F.max("id"), F.lit(0)) + 1).alias("id"))


def save(catalog: DataFrame, path: str) -> None:
    """The whole catalog as JSON lines; replaces what was there."""
    catalog.write.mode("overwrite").json(path)


def load(spark, path: str, schema: str = "source string, artist string, title string") -> DataFrame:
    """The saved catalog; what is missing or can't be read gives no rows."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def read_through(requests: DataFrame, cache: DataFrame, key: str, compute, use_cache: bool = True) -> tuple[DataFrame, DataFrame]:
    """(all results, those that were computed): requests are looked up in the cache, what it lacks is computed; the second is what to store."""
    missing = misses(requests, cache, key) if use_cache else requests
    new = compute(missing)
    found = cache.join(requests.select(key).distinct(), key, "left_semi") if use_cache else cache.limit(0)
    return found.unionByName(new), new


def beat_map(beats: DataFrame) -> DataFrame:
    """(track_id, json): each track's beats as a JSON array of id, start and duration in whole milliseconds, segment, cluster and candidates."""
    ms = lambda c: F.rint(F.col(c) * 1000).cast("long")
    row = F.struct(F.col("idx").alias("id"), ms("start").alias("start"), ms("duration").alias("duration"), "segment", "cluster", "candidates")
    return beats.groupBy("track_id").agg(F.to_json(F.array_sort(F.collect_list(row))).alias("json"))


def read_beat_map(maps: DataFrame) -> DataFrame:
    """The beats of beat_map() again, times in seconds."""
    kind = "array<struct<id:bigint,start:bigint,duration:bigint,segment:bigint,cluster:string,candidates:array<bigint>>>"
    e = maps.select("track_id", F.explode(F.from_json("json", kind)).alias("b"))
    return e.select("track_id", F.col("b.id").alias("idx"), (F.col("b.start") / 1000).alias("start"), (F.col("b.duration") / 1000).alias("duration"), "b.segment", "b.cluster", "b.candidates")


def score_table(scores: DataFrame) -> DataFrame:
    """(track_id, k, line): cluster scores as fixed-width text."""
    return scores.select("track_id", "k", F.format_string("%-10d %-15.4f", "k", "score").alias("line"))


def maps(labelled: DataFrame, width: int = 50) -> DataFrame:
    """(track_id, line, text): one character a row in lines of ``width``: # and - by run in ``segments``, the label's number in base 36 and up in ``clusters``."""
    signs = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
    g = labelled.groupBy("track_id", F.floor(F.col("idx") / width).alias("line")).agg(F.array_sort(F.collect_list(F.struct("idx", "run", "number"))).alias("a"))
    draw = lambda f: F.array_join(F.transform("a", f), "")
    return g.select("track_id", "line", draw(lambda r: F.when(r["run"] % 2 == 0, "#").otherwise("-")).alias("segments"), draw(lambda r: F.substr(F.lit(signs), (r["number"] % len(signs) + 1).cast("int"), F.lit(1))).alias("clusters"))


def report(beats: DataFrame) -> DataFrame:
    """(track_id, text): length, beats, tempo and runs of a track in one line."""
    from trackloom.operators.sequence import run_segments

    runs = run_segments(beats).groupBy("track_id").agg(F.count("*").alias("runs"))
    g = beats.groupBy("track_id").agg((F.max("t") - F.min("t")).alias("long"), F.count("*").alias("n"))
    tempo = F.when(F.col("long") > 0, F.col("n") / F.col("long") * 60).otherwise(0.0)
    return g.join(runs, "track_id").select("track_id", F.format_string("duration %s, beats %d, tempo %.3f, segments %d", clock(F.col("long")), "n", tempo, "runs").alias("text"))

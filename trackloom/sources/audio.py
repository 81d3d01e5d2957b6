"""Wave files as tables of samples, and back. One file is one task; compressed formats need a decoder that the library doesn't have."""

from __future__ import annotations

import struct

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.sources.files import stem_of

INFO = "channels int, sample_rate int, bits int, samples long"


def parse_wave(data: bytes) -> tuple[int, int, np.ndarray]:
    """(sample rate, bits, samples x channels): 8 to 32 bit integers as integers, floats as they are."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("no wave file")
    at, form, body = 12, None, b""
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if name == b"fmt ":
            form = struct.unpack_from("<HHIIHH", data, at + 8)
            if form[0] == 0xFFFE:
                form = (struct.unpack_from("<H", data, at + 32)[0], *form[1:])
        elif name == b"data":
            body = data[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    if form is None:
        raise ValueError("no format in the file")
    kind, channels, rate, _, align, bits = form
    body = body[: len(body) - len(body) % align]
    if kind == 3:
        x = np.frombuffer(body, f"<f{bits // 8}").astype(float)
    elif kind != 1:
        raise ValueError("only plain integers and floats are read")
    elif bits == 8:
        x = np.frombuffer(body, np.uint8).astype(np.int64) - 128
    elif bits == 24:
        b = np.frombuffer(body, np.uint8).reshape(-1, 3).astype(np.int64)
        x = b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16
        x = x - ((x >> 23) << 24)
    else:
        x = np.frombuffer(body, f"<i{bits // 8}").astype(np.int64)
    return rate, bits if kind == 1 else 0, x.reshape(-1, channels)


def wave_bytes(samples: np.ndarray, rate: int, bits: int = 16) -> bytes:
    """A wave file of samples (x channels): integers as they are, if they fit, floats in [-1, 1] scaled and cut."""
    x = np.atleast_2d(np.asarray(samples).T).T
    if np.issubdtype(x.dtype, np.integer) and x.size and not -(1 << (bits - 1)) <= x.min() <= x.max() < 1 << (bits - 1):
        raise ValueError(f"samples do not fit {bits} bits")
    if np.issubdtype(x.dtype, np.floating):
        x = np.clip(np.rint(x * ((1 << (bits - 1)) - 1)), -(1 << (bits - 1)), (1 << (bits - 1)) - 1)
    x = x.astype("<i4")
    raw = x.view(np.uint8).reshape(*x.shape, 4)[..., : bits // 8].tobytes() if bits != 8 else (x + 128).astype(np.uint8).tobytes()
    align = x.shape[1] * bits // 8
    head = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, x.shape[1], rate, rate * align, align, bits)
    return struct.pack("<4sI4s", b"RIFF", 4 + len(head) + 8 + len(raw), b"WAVE") + head + struct.pack("<4sI", b"data", len(raw)) + raw


def binary(spark: SparkSession, path: str, pattern: str = "*.wav") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select(stem_of(F.col("path")).alias("track_id"), "content")


def wave_info(spark: SparkSession, path: str) -> DataFrame:
    """(track_id, channels, sample_rate, bits, samples); null for files that can't be read."""

    @F.pandas_udf(INFO)
    def look(content):
        import pandas as pd

        out = []
        for c in content:
            try:
                rate, bits, x = parse_wave(bytes(c))
                out.append((x.shape[1], rate, bits, len(x)))
            except (ValueError, struct.error):
                out.append((None,) * 4)
        return pd.DataFrame(out, columns=["channels", "sample_rate", "bits", "samples"]).astype({"channels": "Int32", "sample_rate": "Int32", "bits": "Int32", "samples": "Int64"})

    return binary(spark, path).select("track_id", look("content").alias("i")).select("track_id", "i.*")


def read_waves(spark: SparkSession, path: str, **options) -> DataFrame:
    return samples(binary(spark, path), **options)


def samples(files: DataFrame, mono: bool = True, start: float | None = None, stop: float | None = None, scaled: bool = True) -> DataFrame:
    """(track_id, idx, x, sample_rate): the mean of the channels, or x as an array of them; from start to stop seconds. Unreadable files give no rows."""
    kind = "double" if mono else "array<double>"

    def work(batches):
        import pyarrow as pa

        for b in batches:
            for track, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    rate, bits, x = parse_wave(content)
                except (ValueError, struct.error):
                    continue
                first = int((start or 0) * rate)
                x = x[first : int(stop * rate) if stop is not None else None].astype(float)
                x = x / ((1 << (bits - 1)) - 1) if scaled and bits else x
                for a in range(0, len(x), 1 << 16):
                    part = x[a : a + (1 << 16)]
                    value = pa.array(part.mean(1)) if mono else pa.array(list(part), pa.list_(pa.float64()))
                    n = len(part)
                    yield pa.RecordBatch.from_arrays([pa.array([track] * n), pa.array(np.arange(first + a, first + a + n)), value, pa.array([rate] * n, pa.int32())], names=["track_id", "idx", "x", "sample_rate"])

    return files.select("track_id", "content").mapInArrow(work, f"track_id string, idx long, x {kind}, sample_rate int")


def wave_files(signal: DataFrame, rate: int, bits: int = 16) -> DataFrame:
    """(track_id, content): one wave file of each track's samples (track_id, idx, x); integers are written as they are."""
    whole = dict(signal.dtypes)["x"].split("<")[-1].rstrip(">") in ("tinyint", "smallint", "int", "bigint")

    def work(key, pdf):
        import pandas as pd

        x = np.array(pdf.sort_values("idx")["x"].tolist(), np.int64 if whole else float)
        return pd.DataFrame({"track_id": [str(key[0])], "content": [wave_bytes(x, rate, bits)]})

    return signal.groupBy("track_id").applyInPandas(work, "track_id string, content binary")


def write_waves(signal: DataFrame, folder: str, rate: int, bits: int = 16) -> list[str]:
    """Writes <track>.wav files from the tasks, by rename; returns the tracks. folder: a uri that all tasks reach."""

    def work(batches):
        import uuid

        import pyarrow as pa
        import pyarrow.fs as fs

        for b in batches:
            for track, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                system, at = fs.FileSystem.from_uri(folder)
                system.create_dir(at, recursive=True)
                part = f"{at}/.{track}-{uuid.uuid4().hex}"
                with system.open_output_stream(part) as f:
                    f.write(content)
                system.move(part, f"{at}/{track}.wav")
            yield pa.RecordBatch.from_arrays([b.column(0)], names=["track_id"])

    return sorted(r["track_id"] for r in wave_files(signal, rate, bits).mapInArrow(work, "track_id string").collect())


def rendered(play, beats: DataFrame, signal: DataFrame, duration: float | None = None) -> DataFrame:
    """(track_id, idx, x): the beats' samples in the order of a walk (track_id, step, beat), up to ``duration`` seconds of average beats.

    beats: (track_id, idx, first, last, t) with sample ranges. One equi join by (track, beat), no walk is collected.
    """
    from pyspark.sql.window import Window

    if duration is not None:
        pace = beats.groupBy("track_id").agg((F.max("t") / F.count("*")).alias("_s"))
        play = play.join(F.broadcast(pace), "track_id").where(F.col("step") < F.floor(duration / F.col("_s"))).drop("_s")
    steps = play.join(beats.select("track_id", F.col("idx").alias("beat"), "first", "last"), ["track_id", "beat"])
    before = Window.partitionBy("track_id").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    steps = steps.withColumn("at", F.coalesce(F.sum(F.col("last") - F.col("first")).over(before), F.lit(0)))
    samples = signal.join(beats.select("track_id", F.col("idx").alias("beat"), "first", "last"), "track_id").where("idx >= first and idx < last").select("track_id", "beat", (F.col("idx") - F.col("first")).alias("o"), "x")
    return steps.join(samples, ["track_id", "beat"]).select("track_id", (F.col("at") + F.col("o")).alias("idx"), "x")

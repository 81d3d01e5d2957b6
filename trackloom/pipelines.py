"""Processing units: functions from DataFrame to DataFrame, in sequence, side by side, over files, in batches and on streams."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Step = Callable[[DataFrame], DataFrame]


class Sequential:
    """Steps one after the other; a list of steps that is itself a step. None stands for the identity."""

    def __init__(self, *steps: Step | None):
        self.steps = list(steps)

    def __call__(self, df: DataFrame) -> DataFrame:
        for s in self.steps:
            df = df.transform(s) if s else df
        return df

    def append(self, step: Step | None) -> None:
        self.steps.append(step)

    def extend(self, steps) -> None:
        self.steps.extend(steps)

    def insert(self, at: int, step: Step | None) -> None:
        self.steps.insert(at, step)

    def __len__(self) -> int:
        return len(self.steps)

    def __getitem__(self, at):
        return self.steps[at]


class Parallel(Sequential):
    """Steps on one input: a list of results. All are lazy, so Spark runs them as it runs any queries of one parent."""

    def __call__(self, df: DataFrame) -> list[DataFrame]:
        return [df.transform(s) if s else df for s in self.steps]


class Job:
    """read -> steps -> write: read makes a DataFrame of a session and a path, write (or several) takes the result and a path."""

    def __init__(self, read, steps: Step, *write):
        self.read, self.steps, self.write = read, steps, write

    def __call__(self, spark: SparkSession, source: str, *targets: str):
        out = self.steps(self.read(spark, source))
        return [w(out, t) for w, t in zip(self.write, targets, strict=True)] if targets else out


def run_batch(job: Job, spark: SparkSession, sources: list[str], folder: str, suffix: str = "", strip: bool = True) -> list[str]:
    """One output for each source, named after it. Files of one format are better read as one table with a track each."""
    out = []
    for s in sources:
        name = s.rsplit("/", 1)[-1]
        name = name.rsplit(".", 1)[0] if strip else name
        out.append(f"{folder.rstrip('/')}/{name}{suffix}")
        job(spark, s, out[-1])
    return out


class Switched:
    """A unit with an offline form over whole tables and an online form on streams; a streaming input takes the latter."""

    def __init__(self, offline: Step, online: Step):
        self.offline, self.online = offline, online

    def __call__(self, df: DataFrame) -> DataFrame:
        return df.transform(self.online if df.isStreaming else self.offline)


def run_online(step: Step, stream: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Starts a query that writes what the step makes of the stream, until all that is there has been read."""
    return stream.transform(step).writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def rolling(column: str, size: int):
    """The last ``size`` values up to each row, by track and idx, filled up with zeros in front."""
    from pyspark.sql import functions as F

    from trackloom.operators.sequence import in_order

    def step(df: DataFrame) -> DataFrame:
        near = F.collect_list(F.col(column).cast("double")).over(in_order().rowsBetween(-(size - 1), 0))
        return df.withColumn("buffer", F.concat(F.array_repeat(F.lit(0.0), F.lit(size) - F.size(near)), near))

    return step


def save_settings(name: str, settings: dict, path: str) -> None:
    """A unit's name and settings as JSON, which load_settings() reads; code is never stored."""
    with open(path, "w") as f:
        json.dump({"name": name, "settings": settings}, f)


def load_settings(path: str, known: dict[str, Callable]) -> Step:
    """The unit of that name among the known ones, with its settings bound."""
    with open(path) as f:
        d = json.load(f)
    return lambda df: known[d["name"]](df, **d["settings"])

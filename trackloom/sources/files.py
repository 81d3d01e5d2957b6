"""Lists of files: by suffix, below a folder to a depth, and matched with each other by name."""

from __future__ import annotations

import fnmatch
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def by_suffix(paths: list[str], suffix: str | list[str] | None) -> list[str]:
    if suffix is None:
        return list(paths)
    wanted = [suffix] if isinstance(suffix, str) else suffix
    return [p for s in wanted for p in fnmatch.filter(paths, f"*{s}")]


def below(folder: str, depth: int = 0) -> list[str]:
    """Files of a folder and of those up to ``depth`` levels down, sorted."""
    if not os.path.isdir(folder):
        raise OSError(f"{folder} is no folder")
    folder, out = folder.rstrip(os.sep), []
    for root, inner, names in os.walk(folder):
        out += [os.path.join(root, n) for n in names]
        if root.count(os.sep) - folder.count(os.sep) >= depth:
            inner.clear()
    return sorted(out)


def search(paths: str | list[str], suffix: str | list[str] | None = None, depth: int = 0) -> list[str]:
    """Files and the files of folders, each once, sorted."""
    found: set[str] = set()
    for p in [paths] if isinstance(paths, str) else paths:
        if os.path.isdir(p):
            found.update(below(p, depth))
        elif os.path.isfile(p):
            found.add(p)
        else:
            raise OSError(f"{p} does not exist")
    return sorted(by_suffix(sorted(found), suffix))


def without(name: str, suffix: str | None) -> str:
    return name[: -len(suffix)] if suffix and name.endswith(suffix) else name


def matching(name: str, paths: list[str], suffix: str | None = None, other_suffix: str | None = None, exactly: bool = True) -> list[str]:
    """Paths of the same name but for the suffixes; not exactly: also those that only end with it."""
    stem = os.path.basename(without(name, suffix))
    near = fnmatch.filter(paths, f"*{stem}*{other_suffix}" if other_suffix is not None else f"*{stem}")
    return [p for p in near if not exactly or os.path.basename(without(p, other_suffix)) == stem]


def listed(spark: SparkSession, path: str, pattern: str = "*", recursive: bool = False) -> DataFrame:
    """(path, length, modified) of files in any file system that Spark reads; contents aren't read."""
    r = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower())
    return r.load(path).select("path", "length", F.col("modificationTime").alias("modified"))


def stem_of(path):
    """The file's name without folder and last suffix, as a column."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")

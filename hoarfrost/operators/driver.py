"""A run of stages that are kept: what has changed, and what depends on it, is made anew, and a run that failed goes on where it stopped."""

from __future__ import annotations

import hashlib
import json
import logging
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Stage:
    """make gets the frames of the stages in after, by name, and the parameters. tables: paths that it reads besides. version: to be raised when make does something else."""

    name: str
    make: Callable[..., DataFrame]
    after: tuple[str, ...] = ()
    params: dict = field(default_factory=dict)
    tables: tuple[str, ...] = ()
    version: int = 1


def _fs(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def contents(spark: SparkSession, path: str) -> list:
    """Names, lengths and times of change of all files of a table."""
    where, fs = _fs(spark, path)
    if not fs.exists(where):
        raise FileNotFoundError(path)
    out, files = [], fs.listFiles(where, True)
    while files.hasNext():
        f = files.next()
        out.append([f.getPath().getName(), f.getLen(), f.getModificationTime()])
    return sorted(out)


def fingerprints(spark: SparkSession, stages: list[Stage]) -> dict[str, str]:
    """A stage's fingerprint changes with its parameters, its version, the files of its tables, and the fingerprints of the stages before it."""
    out: dict[str, str] = {}
    for s in stages:
        missing = [a for a in s.after if a not in out]
        if missing or s.name in out:
            raise ValueError(f"{s.name} comes twice, or before {missing}")
        said = [s.name, s.version, s.params, [out[a] for a in s.after], {t: contents(spark, t) for t in s.tables}]
        out[s.name] = hashlib.sha256(json.dumps(said, sort_keys=True, default=str).encode()).hexdigest()[:24]
    return out


def run(spark: SparkSession, folder: str, stages: list[Stage]) -> tuple[dict[str, DataFrame], list[dict]]:
    """The stages' frames, and what was done: stage, fingerprint, made (or kept) and seconds.

    A stage's table is in folder/name/fingerprint and counts once it is whole,
    by its success mark. When a stage has been made, its tables of other
    fingerprints go. An error stops the run; what was made stays.
    """
    marks, frames, done = fingerprints(spark, stages), {}, []
    for s in stages:
        path, began = f"{folder}/{s.name}/{marks[s.name]}", time.time()
        mark, fs = _fs(spark, f"{path}/_SUCCESS")
        made = not fs.exists(mark)
        if made:
            s.make(**{a: frames[a] for a in s.after}, **s.params).write.mode("overwrite").option("compression", "zstd").parquet(path)
            for other in fs.listStatus(mark.getParent().getParent()):
                if other.getPath().getName() != marks[s.name]:
                    fs.delete(other.getPath(), True)
        frames[s.name] = spark.read.parquet(path)
        done.append({"stage": s.name, "fingerprint": marks[s.name], "made": made, "seconds": round(time.time() - began, 3)})
        log.info("%s %s", s.name, "made" if made else "kept")
    return frames, done

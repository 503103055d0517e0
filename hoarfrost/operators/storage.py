"""Tables in between, kept in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir. Only in local mode a temporary one is made where none is set."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if path is None:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="hoarfrost-"))
        path = spark.sparkContext.getCheckpointDir()
    return path


#: Tables of the innermost scratch().
_tables: ContextVar[list | None] = ContextVar("tables", default=None)


#: All that written() wrote in this process and that is still there.
_there: set[str] = set()


def written(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """df, written as Parquet in the shared folder and read back: lineage ends here. Within scratch() it goes at the end, unless it is to be kept."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_at = path
    _there.add(path)
    if not keep and _tables.get() is not None:
        _tables.get().append(out)
    return out


def forget(df: DataFrame) -> None:
    """Delete what written() wrote, once nothing reads it any more. Deleting twice does nothing."""
    _delete(df.sparkSession, df._written_at)


def _delete(spark: SparkSession, where: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    _there.discard(where)


def close(spark: SparkSession) -> int:
    """Delete every table that written() left: to be called when no frame that the engine gave out is read any more. How many there were."""
    left = sorted(_there)
    for where in left:
        _delete(spark, where)
    return len(left)


@contextmanager
def scratch() -> Iterator[None]:
    """What written() writes within is deleted at the end: nothing that is read later may depend on it."""
    before = _tables.set([])
    try:
        yield
    finally:
        for df in _tables.get():
            forget(df)
        _tables.reset(before)

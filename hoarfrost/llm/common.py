"""What the text operators share: tables, shared storage and Arrow batches."""

from __future__ import annotations

import os
import re
import tempfile
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from hoarfrost.operators.storage import forget, scratch, shared_dir, written

__all__ = ["forget", "scratch", "shared_dir", "written"]

#: ASCII white space, as in the word rule [^\x20\x09-\x0D]+; bytes.split() splits on just these.
WHITE = b"\x20\x09\x0a\x0b\x0c\x0d"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of an Arrow batch: texts are long, and a batch is held by the JVM and by Python at once.
BATCH_ROWS = 1000
#: Rows and bytes of text of the slices that Python works on; a longer text is a slice of its own.
SLICE_ROWS, SLICE_BYTES = 512, 8 << 20


def ship(spark: SparkSession) -> None:
    """Make the session ready: short Arrow batches, and this package sent to the executors' Python, once a context, for clusters where it isn't installed.

    The batch size stays lowered in the session, since queries run after this
    returns; a size that is lower already is left alone.
    """
    conf = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(conf)) <= BATCH_ROWS:
        spark.conf.set(conf, str(BATCH_ROWS))
    sc = spark.sparkContext
    if getattr(sc, "_hoarfrost_shipped", False):
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="hoarfrost-"), "hoarfrost.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(package)))
    sc.addPyFile(path)
    sc._hoarfrost_shipped = True


def learnable(doc_id: Column) -> Column:
    """True for rows that may be learnt from: crc32(doc_id as text) mod 5 is not 0; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 != 0


def slices(batches: Iterator[pa.RecordBatch], text: str, rows: int = SLICE_ROWS, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of Arrow batches of at most rows rows and size bytes of the column text (one row at least), so that Python copies stay small whatever the texts' lengths."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = min(at + rows, max(at + 1, int(np.searchsorted(ends, before + size, "right"))))
            yield batch.slice(at, to - at)
            at = to


_SPACE = re.compile(rb"[\x20\x09-\x0D]")
#: Bytes of the blocks that long texts are read in.
BLOCK_BYTES = 1 << 20


def word_blocks(text: bytes, size: int = BLOCK_BYTES) -> Iterator[bytes]:
    """A text in blocks of some size bytes that end where words do; a longer word is in a longer block."""
    at = 0
    while at < len(text):
        found = _SPACE.search(text, at + size)
        to = found.end() if found else len(text)
        yield text[at:to]
        at = to


def short(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """Slices of at most rows rows, for batches without texts."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def named(name: str) -> Column:
    """The column of just that name, whatever signs it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def taken(docs: DataFrame, names: list[str]) -> DataFrame:
    return docs.select(*map(named, names))


def fresh(columns: list[str], *wanted: str) -> list[str]:
    """Names for columns in between: the wanted ones, lengthened until no column has them (case doesn't count)."""
    used = {c.lower() for c in columns}
    out = []
    for name in wanted:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def others(docs: DataFrame, *names: str) -> list[str]:
    """The columns besides those of these names (case doesn't count)."""
    left_out = {n.lower() for n in names}
    return [c for c in docs.columns if c.lower() not in left_out]


def schema_of(docs: DataFrame, names: list[str], more: str = "") -> StructType:
    """The types of some of docs' columns, and then those of a DDL string."""
    fields = {f.name: f for f in docs.schema.fields}
    return StructType([StructField(n, fields[n].dataType) for n in names] + (StructType.fromDDL(more).fields if more else []))


def mapped(docs: DataFrame, names: list[str], run, schema: StructType) -> DataFrame:
    """run over the Arrow batches of docs' columns names, in place. mapInArrow can't take names with dots or backticks, so it sees numbered ones and run the real ones."""
    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in run(b.rename_columns(names) for b in batches):
            yield out.rename_columns([f"c{k}" for k in range(out.num_columns)])

    rows = docs.select(*[named(n).alias(f"c{k}") for k, n in enumerate(names)])
    inner = StructType([StructField(f"c{k}", f.dataType) for k, f in enumerate(schema.fields)])
    return rows.mapInArrow(numbered, inner).toDF(*schema.names)


def utf8(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """A text column as UTF-8 bytes; null is empty."""
    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]


def arrow_schema(ddl: str) -> pa.Schema:
    """Arrow schema of a flat Spark DDL string."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(), "float": pa.float32()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in ddl.split(","))])


def made(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)

"""MinHash near-duplicates with circulant permutations, banding and exact Jaccard verification.

Shingles are hashed to PLACES places. A first permutation moves places about;
the second one, shifted by k, gives the k-th coordinate of a signature: the
least value that any place of the text gets. So two permutations make all
coordinates, and the values that a shingle gives to them lie behind each other
in the second permutation's table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, forget, fresh, made, named, schema_of, scratch, slices, utf8, written
from .near_copies import rooted, shingles

#: Least similarity in percent; coordinates of a band and bands: texts of similarity s share a band with probability 1 - (1 - s ** ROWS) ** BANDS, 0.9999995 at 0.85.
PERCENT, ROWS, BANDS = 85, 5, 25
#: Places that shingles are hashed to, a power of two.
PLACES = 1 << 20
#: Shingles whose values are held at once.
STEP = 2048


@cache
def permutations() -> tuple[np.ndarray, np.ndarray]:
    """The first permutation, and a row for each place it leads to: what the second one, shifted by 0, 1, ... ROWS * BANDS - 1, makes of it."""
    rng = np.random.default_rng(17)
    first, second = rng.permutation(PLACES), rng.permutation(PLACES).astype(np.uint32)
    return first, np.lib.stride_tricks.sliding_window_view(np.concatenate([second, second[: ROWS * BANDS - 1]]), ROWS * BANDS)


def signature(found: np.ndarray) -> np.ndarray:
    """The ROWS * BANDS coordinates of a set of 64-bit hashes that isn't empty."""
    first, shifted = permutations()
    places = first[found & np.uint64(PLACES - 1)]
    least = np.full(ROWS * BANDS, np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(places), STEP):
        least = np.minimum(least, shifted[places[at : at + STEP]].min(axis=0))
    return least


def bands(found: np.ndarray) -> np.ndarray:
    """The bands of a set of shingles as signed longs; an empty set has none."""
    if not len(found):
        return np.zeros(0, np.int64)
    rows = signature(found).astype("<u4").reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(r.tobytes(), k) for k, r in enumerate(rows)], np.uint64).view(np.int64)


def _marked(rows: DataFrame) -> DataFrame:
    """(id, key, text) -> (id, key, n, h, g, bands): the size of the text's set of shingles, a hash of the set in two halves, its bands. No shuffle."""
    tail = arrow_schema("n long, h long, g long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            sets = [shingles(t) for t in utf8(b, "text")]
            h = np.frombuffer(b"".join(xxhash.xxh128_digest(s.tobytes()) for s in sets), np.int64).reshape(-1, 2)
            columns = made(tail, [len(s) for s in sets], h[:, 0], h[:, 1]).columns
            keys = pa.array([bands(s) for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("key"), *columns, keys], names=["id", "key", *tail.names, "bands"])

    return rows.mapInArrow(run, schema_of(rows, ["id", "key"], "n long, h long, g long, bands array<long>"))


def near_duplicate_sets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): the size of each row's set of five-word shingles, and the smallest doc_id that it reaches by links.

    A-Z are lower-cased; fewer than five words are one shingle. Rows are linked
    if their sets share percent or more of their union, which the whole sets
    decide; pairs that meet come from bands of circulant MinHash, and within a
    band none is left out (see near_copies.rooted). Equal sets, known by 128
    bits, are one node, so copies make no pairs. Rows are grouped by hashes
    only; the texts of those that share a band move once, their sets two or
    three times.

    Null and empty texts and those without words have an empty set and are
    linked with nothing, not even each other: component_id is their own id.
    Null ids take part, but are the smallest only where there is no other. kept
    is true where component_id is the row's own id. Repeated rows are alike. An
    empty table gives an empty result; other columns are left out.
    """
    names = fresh([doc_id], "n_shingles", "component_id", "kept")
    kind = docs.schema[doc_id].dataType
    some = F.lit("" if kind.simpleString() == "string" else 0).cast(kind)  # ids without nulls, so that rows are joined by plain columns
    keyed = docs.select(named(doc_id).alias("id"), F.coalesce(named(doc_id), some).alias("row"), F.xxhash64(named(doc_id).isNull(), named(doc_id), named(text)).alias("key"), named(text).alias("text"))
    marks = written(_marked(keyed.select("id", "key", "text")), "marks")
    with scratch():
        first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("first")
        groups = marks.where("n > 0").groupBy("h", "g").agg(first, F.first("bands").alias("bands"))  # summed before the shuffle, whatever the number of copies
        nodes = groups.select("h", "g", "bands", F.col("first.id").alias("least"), F.coalesce("first.id", some).alias("row"), F.col("first.key").alias("key"))
        nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()).withColumn("fp", F.lit(0).cast("long")), "nodes")

        def texts_of(wanted: DataFrame) -> DataFrame:
            these = nodes.join(wanted, "node").select("node", "row", "key")
            # The join has dealt the rows by these columns, so that repeated rows go without another shuffle.
            return keyed.select("row", "key", "text").join(these, ["row", "key"]).dropDuplicates(["row", "key"]).select("node", "text")

        roots = written(rooted(nodes, None, texts_of, percent), "roots")
        linked = written(nodes.join(roots, "node").select("h", "g", "root", "least"), "linked")
        component = linked.groupBy("root").agg(F.min("least").alias("component"), F.count(F.lit(1)).alias("sets"))
        # Most sets are their own component; only the others differ from their own least id.
        of = linked.join(component.where("sets > 1"), "root", "left").select("h", "g", F.when(F.col("sets").isNull(), F.col("least")).otherwise(F.col("component")).alias("component"))
        of = written(of.select(F.col("h").alias("of_h"), F.col("g").alias("of_g"), "component"), "named", keep=True)
    out = marks.join(of, (F.col("h") == F.col("of_h")) & (F.col("g") == F.col("of_g")), "left")
    component = F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component"))
    return out.select(F.col("id").alias(doc_id), F.col("n").alias(names[0]), component.alias(names[1]), F.col("id").eqNullSafe(component).alias(names[2]))

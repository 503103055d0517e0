"""SimHash near-duplicates: pigeonhole blocks, verified distances, components."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, forget, fresh, made, named, schema_of, scratch, short, slices, taken, utf8, written
from .components import connected
from .near_copies import marked, rooted, shingle_hashes

BITS, DISTANCE = 64, 3
#: Largest bucket that goes to one task; larger ones are split by more blocks. Never below 2**12, see split().
BUCKET = 4096


def simhash(text: bytes, width: int = 3) -> int:
    """Fingerprint of a UTF-8 text: a bit is set if over half of its shingles' hashes have it.

    A-Z are lower-cased; shingles are width words, repeats included; a shorter
    text is one shingle, and a text without words has fingerprint zero.
    """
    return fingerprint(shingle_hashes(text, width))


def fingerprint(hashes: np.ndarray) -> int:
    """The bits that over half of some hashes have; zero for none."""
    if not len(hashes):
        return 0
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        block = hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, fp long): one row a row of docs; fp is the fingerprint as a signed long. No shuffle."""
    rows = docs.select(named(doc_id).alias("id"), named(text).alias("text"))
    schema = arrow_schema("fp long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            fp = np.array([simhash(t) for t in utf8(b, "text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("id"), *made(schema, fp).columns], names=["id", "fp"])

    return rows.mapInArrow(run, schema_of(rows, ["id"], "fp long"))


def _masks(free: int, blocks: int, chosen: int) -> list[int]:
    """Masks of the bits of free that chosen of its blocks cover, for every choice of blocks."""
    bits = [i for i in range(BITS) if free >> i & 1]
    parts = [sum(1 << int(i) for i in part) for part in np.array_split(np.array(bits), blocks)]
    return [sum(c) for c in combinations(parts, chosen)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def first_masks(distance: int = DISTANCE) -> list[int]:
    """Close pairs differ in at most distance of distance + 2 blocks, so they agree on two: one mask for each pair of blocks."""
    return _masks((1 << BITS) - 1, distance + 2, 2)


def split(keys: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Buckets (mask, key, fp) -> smaller ones: the bits that the bucket leaves free go into distance + 1 blocks, one of which close pairs share.

    A bucket holds each fingerprint once, so one with 12 free bits has 2**12 at
    most: splitting always ends below BUCKET, without a cap.
    """
    pick = None
    for mask in [r["mask"] for r in keys.select("mask").distinct().collect()]:  # masks come from a fixed tree, whatever the rows
        free = ((1 << BITS) - 1) & ~(mask & ((1 << BITS) - 1))
        more = F.array(*[F.lit(_signed((mask & ((1 << BITS) - 1)) | m)) for m in _masks(free, distance + 1, 1)])
        pick = F.when(F.col("mask") == mask, more) if pick is None else pick.when(F.col("mask") == mask, more)
    if pick is None:
        return keys
    finer = keys.select(F.explode(pick).alias("mask"), "fp")
    return finer.select("mask", F.col("mask").bitwiseAND(F.col("fp")).alias("key"), "fp")


def _forest(fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links of one bucket that connect what its close pairs connect: a spanning forest, found row block by row block."""
    label = np.arange(len(fps))
    out = []
    for i in range(len(fps) - 1):
        near = np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= distance) + i + 1
        while len(near := near[label[near] != label[i]]):
            out.append((i, int(near[0])))
            label[label == label[near[0]]] = label[i]
    return out


def close_links(fps: DataFrame, distance: int = DISTANCE, bucket: int = BUCKET) -> DataFrame:
    """Distinct fingerprints (fp) -> links (a, b) at distance bits or fewer that connect all that such links connect.

    Fingerprints meet in the buckets of first_masks. Buckets over the bound
    are split (see split) until none is left; then each bucket's pairs are
    compared within one task and only a spanning forest of the links comes out.
    """
    bucket = max(bucket, 1 << 12)
    keys = fps.select("fp", F.explode(F.array(*[F.lit(_signed(m)) for m in first_masks(distance)])).alias("mask"))
    keys = keys.select("mask", F.col("mask").bitwiseAND(F.col("fp")).alias("key"), "fp")
    small = None
    while True:
        large = written(keys.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > bucket).select("mask", "key"), "large")
        done = large.isEmpty()
        part = keys if done else keys.join(large, ["mask", "key"], "left_anti")
        small = part if small is None else small.unionByName(part)
        if done:
            break
        keys = written(split(keys.join(large, ["mask", "key"], "left_semi"), distance).distinct(), "buckets")
    groups = small.groupBy("mask", "key").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1).select("fps")  # at most bucket in each
    schema = arrow_schema("a long, b long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in short(batches):
            a, c = [], []
            for x in b.column(0):
                f = np.sort(x.values.to_numpy().view(np.uint64))
                for i, j in _forest(f, distance):
                    a.append(f[i])
                    c.append(f[j])
            yield made(schema, np.array(a, np.uint64).view(np.int64), np.array(c, np.uint64).view(np.int64))

    return groups.mapInArrow(run, "a long, b long").distinct()


def _rooted(marks: DataFrame, distance: int) -> DataFrame:
    """marks (fp) -> (fp, root): every distinct fingerprint and one that stands for its component."""
    nodes = written(marks.select("fp").distinct(), "nodes")
    roots = written(connected(close_links(nodes, distance)), "roots")
    return nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", distance: int = DISTANCE) -> DataFrame:
    """(doc_id, fp, component_id): the smallest doc_id that each row's fingerprint reaches by links of distance bits or fewer.

    Equal fingerprints are one node, so copies and repeated rows make no pairs.
    Null and empty texts have fingerprint zero and link like any other. Null
    ids take part but are never the smallest; a component of null ids only has
    a null id. An empty table gives an empty result; other columns are left out.
    """
    marks = written(fingerprints(docs, doc_id, text), "fingerprints")
    with scratch():
        rooted = written(_rooted(marks, distance).join(marks.groupBy("fp").agg(F.min("id").alias("least")), "fp"), "rooted")
        names = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
        of = written(rooted.join(names, "root").select(F.col("fp").alias("of"), "component_id"), "named", keep=True)
    return marks.join(of, F.col("fp") == F.col("of"), "left").select(F.col("id").alias(doc_id), "fp", "component_id")


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", distance: int = DISTANCE) -> DataFrame:
    """docs with one row of each component of near copies: that of the smallest id (a null id only where there is no other; of rows alike any one).

    Near copies share 0.8 or more of their five-word shingles; the pairs that
    are compared come from SimHash's blocks (fingerprints of the sets of
    shingles, distance bits) and from MinHash bands (see near_copies). Texts
    without words, nulls too, are copies of each other. An empty table gives an
    empty result; all columns stay. Only fingerprints, hashes and ids are
    compared and grouped; the texts are shuffled to get the shingles of those
    that may be near copies, and to keep the chosen rows, which are known by id
    and by a hash of id and text.
    """
    id_, key = fresh(docs.columns, "row_id", "row_key")
    kind = docs.schema[doc_id].dataType
    # Ids without nulls, so that rows are joined and grouped by the same columns; the hash tells null from what stands for it.
    some = F.lit("" if kind.simpleString() == "string" else 0).cast(kind)
    keyed = docs.withColumn(id_, F.coalesce(named(doc_id), some)).withColumn(key, F.xxhash64(named(doc_id).isNull(), named(doc_id), named(text)))
    rows = keyed.select(named(doc_id).alias("id"), named(key).alias("key"), named(text).alias("text"))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("first")
    known_by = F.coalesce("first.id", some).alias(id_), F.col("first.key").alias(key)
    with scratch():
        marks = written(marked(rows, fingerprint), "marks")
        groups = marks.groupBy("fp", "h").agg(first, F.first("bands").alias("bands"))  # summed before the shuffle, whatever the number of copies
        nodes = written(groups.withColumn("node", F.monotonically_increasing_id()), "nodes")
        forget(marks)

        def texts_of(wanted: DataFrame) -> DataFrame:
            these = written(nodes.join(wanted, "node").select("node", *known_by), "wanted")
            # The join has dealt the rows by these columns, so that repeated rows go without another shuffle.
            return keyed.select(named(id_), named(key), named(text).alias("text")).join(these, [id_, key]).dropDuplicates([id_, key]).select("node", "text")

        roots = rooted(nodes, _proposed(nodes, distance), texts_of)
        kept = nodes.join(roots, "node").groupBy("root").agg(F.min("first").alias("first"))
        kept = written(kept.select(*known_by), "kept", keep=True)
    return taken(keyed.join(kept, [id_, key], "left_semi").dropDuplicates([id_, key]), docs.columns)


def _proposed(nodes: DataFrame, distance: int) -> DataFrame:
    """nodes (node, fp) -> pairs (a, b) that connect all nodes at distance bits or fewer: those of one fingerprint with the first of them, and the first ones of close fingerprints."""
    firsts = written(nodes.groupBy("fp").agg(F.min("node").alias("rep")), "firsts")
    same = nodes.select("node", "fp").join(firsts, "fp").where("node != rep").select(F.col("node").alias("a"), F.col("rep").alias("b"))
    links = close_links(firsts.select("fp"), distance)
    of = lambda c: firsts.select(F.col("fp").alias(c), F.col("rep").alias("r" + c))
    return same.unionByName(links.join(of("a"), "a").join(of("b"), "b").select(F.col("ra").alias("a"), F.col("rb").alias("b")))


def hex_fingerprint(fp: Column) -> Column:
    """16 lowercase hex digits of a fingerprint kept as a signed long."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))

"""What filters take from each other: failure masks of five filters, duplicates found by sorting, and counters for every order of the filters."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, fresh, made, named, schema_of, short, slices, utf8, written

#: The filters by letter; bit k of a mask is the k-th of them.
FILTERS = "ABCDE"
DUPLICATE = 1 << FILTERS.index("E")
#: Bytes from which on a text's words are counted by Arrow, whose memory is some five bytes a byte.
LONG_TEXT = 1 << 20
_UPPER, _LATER, _SYMBOLS = bytes(range(65, 91)), bytes(range(0x80, 0xC0)), b"#$%&*|"


def word_counts(text: bytes) -> tuple[int, int]:
    """Words of a UTF-8 text, and different ones."""
    if len(text) < LONG_TEXT:
        words = text.split()
        return len(words), len(set(words))
    words = pc.split_pattern_regex(pa.array([text], pa.large_binary()), r"[\x20\x09-\x0D]+").flatten()
    words = words.filter(pc.greater(pc.binary_length(words), 0))
    return len(words), pc.count_distinct(words).as_py()


def own_failures(text: bytes) -> int:
    """Mask of the filters A to D that a text fails."""
    n, different = word_counts(text)
    upper, points = len(text) - len(text.translate(None, _UPPER)), len(text.translate(None, _LATER))
    symbols = len(text.translate(None, _SYMBOLS)) < len(text)
    return (n < 50) | (100 * different < 65 * n) << 1 | (100 * upper > 5 * points) << 2 | symbols << 3


def _masks(names: list[str]):
    """The task of failure_masks, over rows sorted by fp, text, id."""
    schema_tail = arrow_schema("mask int, n long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = None
        now, text, mask, least, first = None, None, 0, None, True
        waiting: dict[bytes, list] = {}  # of the fingerprint at hand: text -> its mask, its smallest id here, and that id's rows by part
        out: list[tuple] = []

        def settle(edge: bool) -> None:
            for t, (m, i, parts) in waiting.items():
                out.extend((i, p, m, n, t if edge else None) for p, n in parts.items())
            waiting.clear()

        def done() -> pa.RecordBatch:
            i, p, m, n, t = zip(*out)
            out.clear()
            tail = made(schema_tail, m, n)
            return pa.RecordBatch.from_arrays([pa.array(i, kinds[0]), pa.array(p, kinds[1]), *tail.columns, pa.array(t, pa.binary())], names=names)

        for b in slices(batches, "text"):
            kinds = b.column("id").type, b.column("part").type
            for fp, t, i, p in zip(b.column("fp").to_pylist(), utf8(b, "text"), b.column("id").to_pylist(), b.column("part").to_pylist()):
                if fp != now:
                    settle(first and now is not None)
                    first, now, text = first and now is None, fp, None
                if t != text:
                    text, mask, least = t, own_failures(t), None
                if i is None or least is not None and i > least:
                    out.append((i, p, mask | (DUPLICATE if i is not None else 0), 1, None))
                else:
                    least = i
                    waiting.setdefault(t, [mask, i, Counter()])[2][p] += 1
            if out:
                yield done()
        settle(True)
        if out:
            yield done()

    return run


def failure_masks(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """(doc_id, part, mask int, n long): which filters how many rows of an id, of a part, fail.

    A: under 50 words; B: under 65 % of the words are different; C: over 5 % of
    the signs are A-Z; D: a symbol of #$%&*|; E: a smaller id has the same text.

    Rows are ranged by fingerprint and id, so that a text that a third of all
    rows have is spread, and each task sorts by fingerprint, text and id: a row
    fails E if the one before it has its text and a smaller id, or fails E by
    it. Only texts with a task's first or last fingerprint may go on elsewhere:
    the rows of their smallest id here carry the text, and the smallest id of
    all tasks is found for these (two fingerprints a task) by a grouping. Equality is
    that of texts; texts never come to the driver, and move once.

    Null texts are empty, and so are null parts; null ids neither fail E nor
    make others fail it; rows of the same id don't either. Words of texts of any length are counted whole. An empty table gives
    an empty result; other columns are left out.
    """
    of, mask = fresh([doc_id], "part", "mask")
    rows = docs.select(named(doc_id).alias("id"), F.coalesce(named(text), F.lit("")).alias("text"), F.coalesce(named(part).cast("string"), F.lit("")).alias("part"))
    rows = rows.withColumn("fp", F.xxhash64("text")).withColumn("salt", F.monotonically_increasing_id())  # the salt spreads repeated rows
    dealt = rows.repartitionByRange("fp", "id", "salt").sortWithinPartitions("fp", "text", "id").select("fp", "text", "id", "part")
    names = ["id", "part", "mask", "n", "edge"]
    found = written(dealt.mapInArrow(_masks(names), schema_of(rows, ["id", "part"], "mask int, n long, edge binary")), "masks")
    edges = found.where("edge IS NOT NULL")
    least = edges.groupBy("edge").agg(F.min("id").alias("least"))
    open_ = edges.join(least, "edge").withColumn("mask", F.when(F.col("id") > F.col("least"), F.col("mask").bitwiseOR(F.lit(DUPLICATE))).otherwise(F.col("mask")))
    both = found.where("edge IS NULL").select("id", "part", "mask", "n").unionByName(open_.select("id", "part", "mask", "n"))
    return both.select(F.col("id").alias(doc_id), F.col("part").alias(of), F.col("mask").alias(mask), "n")


def orders() -> list[tuple[str, int, int, int]]:
    """(order, step, bits of the filters before, bit of the step's filter) for every order of the filters."""
    out = []
    for order in permutations(range(len(FILTERS))):
        before = 0
        for step, f in enumerate(order, 1):
            out.append(("".join(FILTERS[k] for k in order), step, before, 1 << f))
            before |= 1 << f
    return out


COUNTERS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
AUDIT = "filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTERS)


def weights() -> np.ndarray:
    """(steps of all orders, counters, 3 * masks): how often a row of a mask (all rows, good ones, toxic ones) counts."""
    steps, masks = orders(), np.arange(1 << len(FILTERS))
    fails = np.bitwise_count(masks)
    every = factorial(len(FILTERS))
    out = np.zeros((len(steps), len(COUNTERS), 3, len(masks)), np.int64)
    for k, (_, _, before, own) in enumerate(steps):
        hit, earlier = (masks & own) != 0, (masks & before) != 0
        out[k, 0, 0], out[k, 1, 0], out[k, 2, 0], out[k, 3, 0] = (masks & (before | own)) == 0, hit & ~earlier, hit & earlier, masks == own
        out[k, 4, 1] = out[k, 5, 2] = hit & ~earlier
        out[k, 6, 0] = np.where(hit, every // np.maximum(fails, 1), 0)  # each of the filters that a row fails comes first equally often
    return out.reshape(len(steps), len(COUNTERS), -1)


def interaction_audit(masks: DataFrame, labels: DataFrame, doc_id: str = "doc_id", quality: str = "quality", toxic: str = "toxic") -> DataFrame:
    """masks (of failure_masks) -> a row for every part, order of the filters and step, with AUDIT's columns.

    An id is good or toxic if any of its labels says 1; null labels and null
    ids say nothing. Counters add up, so rows are summed by part and mask (32
    at most a part) before anything is ordered: rows of one id are summed
    first, then joined with the labels, and no text moves. A part without rows
    isn't there, so no masks give no rows.
    """
    said = lambda c: F.max(F.coalesce(named(c) == 1, F.lit(False))).cast("long").alias(c)
    of = labels.where(named(doc_id).isNotNull()).groupBy(named(doc_id).alias("labelled")).agg(said(quality), said(toxic)).where((F.col(quality) + F.col(toxic)) > 0)
    rows = masks.groupBy(named(doc_id).alias("id"), "part", "mask").agg(F.sum("n").alias("n"))
    joined = rows.join(of, F.col("id") == F.col("labelled"), "left")
    marked = lambda c: F.sum(F.col("n") * F.coalesce(F.col(c), F.lit(0)))
    sums = joined.groupBy("part", "mask").agg(F.sum("n").alias("n"), marked(quality).alias("good"), marked(toxic).alias("toxic"))
    parts = sums.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("sums"))  # 32 at most
    schema = arrow_schema("part string, " + AUDIT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix, steps = weights(), orders()
        order, step = [s[0] for s in steps], np.array([s[1] for s in steps], np.int32)
        for b in short(batches, 64):
            for part, found in zip(b.column("part").to_pylist(), b.column("sums").to_pylist()):
                counts = np.zeros((3, 1 << len(FILTERS)), np.int64)
                for s in found:
                    counts[:, s["mask"]] = s["n"], s["good"], s["toxic"]
                got = matrix @ counts.ravel()
                yield made(schema, [part] * len(steps), order, step, *got.T)

    return parts.mapInArrow(run, "part string, " + AUDIT)

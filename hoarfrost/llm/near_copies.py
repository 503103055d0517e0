"""Near copies by Jaccard similarity, on top of SimHash.

Texts are sets of five-word shingles. SimHash's blocks propose the pairs that
differ in few bits. At similarity 0.8 texts differ in ten bits of 64 or so, and
blocks for so many (3,060 of 14 bits a text for a distance of 14) would be far
too many and too wide, so that MinHash bands propose the rest: a band is ROWS
minima of hashes, and texts of similarity s share one of BANDS bands with
probability 1 - (1 - s ** ROWS) ** BANDS: 0.998 at 0.8. A text and the first of
its band must be at most FAR bits apart to be compared (which holds for 0.99999
at 0.8). All links are found by the sets at last: nothing under PERCENT is linked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, made, slices, utf8, word_blocks, written
from .components import connected, rooted_by

SEED = 42
#: Words of a shingle, least similarity of near copies in percent, minima of a band, bands, most bits between near copies' fingerprints.
WIDTH, PERCENT, ROWS, BANDS, FAR = 5, 80, 6, 20, 22
#: Texts and bytes of sets of a block that a task compares.
BLOCK_ROWS, BLOCK_BYTES = 4096, 32 << 20

_RNG = np.random.default_rng(11)
_MUL = _RNG.integers(0, 1 << 63, (ROWS * BANDS, 1), np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 1 << 63, (ROWS * BANDS, 1), np.uint64)


def _windows(words: list[bytes], width: int) -> np.ndarray:
    """Hashes of the shingles of width words or more words."""
    joined = b" ".join(words)
    n = len(words) - width + 1
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[: n - 1].tolist()]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, (ends[width - 1 :] - 1).tolist())), np.uint64, n)


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """Hashes of a UTF-8 text's shingles of width words in order, repeats included; A-Z are lower-cased.

    A shorter text is one shingle; a text without words has none. A long text
    is cut into blocks of words, so that only its hashes are held at once.
    """
    out, words = [], []
    for block in word_blocks(text):
        words += block.lower().split()
        if len(words) >= width:
            out.append(_windows(words, width))
            words = words[len(words) - width + 1 :]
    if not out:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else [], np.uint64)
    return out[0] if len(out) == 1 else np.concatenate(out)


def shingles(text: bytes) -> np.ndarray:
    """The sorted set of a text's shingles as 64-bit hashes."""
    return np.unique(shingle_hashes(text, WIDTH))


def bands(found: np.ndarray) -> np.ndarray:
    """The BANDS bands of a set of shingles as signed longs; a text without words has none."""
    if not len(found):
        return np.zeros(0, np.int64)
    least = np.full((ROWS * BANDS, 1), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), 1 << 13):
        least = np.minimum(least, (found[at : at + (1 << 13)] * _MUL + _ADD).min(axis=1, keepdims=True))
    rows = least.astype("<u8").reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(r.tobytes(), k) for k, r in enumerate(rows)], np.uint64).view(np.int64)


def alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets share percent or more of their union; two empty ones are alike."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort()
    same = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * same >= percent * (len(both) - same)


def marked(rows: DataFrame, fingerprint) -> DataFrame:
    """(id, key, text) -> (id, key, fp, h, bands): the fingerprint of the text's set of shingles, a hash of the set and its bands. No shuffle.

    fp and h together stand for a set: unlike texts differ in both.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            sets = [shingles(t) for t in utf8(b, "text")]
            fp = np.array([fingerprint(s) for s in sets], np.uint64).view(np.int64)
            h = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
            keys = pa.array([bands(s) for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("key"), pa.array(fp), pa.array(h), keys], names=["id", "key", "fp", "h", "bands"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, key long, fp long, h long, bands array<long>")


def with_sets(texts: DataFrame) -> DataFrame:
    """(node, text), once a node -> (node, words): the text's set of shingles."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 128):
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array([shingles(t).astype("<u8").tobytes() for t in utf8(b, "text")], pa.binary())], names=["node", "words"])

    return texts.select("node", "text").mapInArrow(run, "node long, words binary")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets have a similarity of percent or more. b, which may stand in many pairs, is joined first."""
    schema = arrow_schema("a long, b long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "wa", 128):
            near = pa.array([alike(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8"), percent) for x, y in zip(b.column("wa").to_pylist(), b.column("wb").to_pylist())], pa.bool_())
            yield made(schema, b.column("a").filter(near), b.column("b").filter(near))

    one = pairs.join(sets.select(F.col("node").alias("b"), F.col("words").alias("wb")), "b")
    both = one.join(sets.select(F.col("node").alias("a"), F.col("words").alias("wa")), "a")
    return both.select("a", "b", "wa", "wb").mapInArrow(run, "a long, b long")


def forest_of(words: list[np.ndarray], root: np.ndarray, main: int, side: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links (i, j) of sets that connect all components which similar sets connect; the sets outside the component main are compared with all those of other components.

    An inverted index counts what a set shares with every other one at once.
    side: where both sides occur, only sets of different sides are compared.
    """
    size = np.array([len(w) for w in words])
    value = np.concatenate(words)
    owner = np.repeat(np.arange(len(words)), size)
    order = np.argsort(value, kind="stable")
    posted = owner[order]
    first = np.flatnonzero(np.append(True, value[order[1:]] != value[order[:-1]]))
    length = np.diff(np.append(first, len(value)))
    term = np.empty(len(value), np.int64)
    term[order] = np.repeat(np.arange(len(first)), length)
    begin = np.cumsum(size) - size
    label, both = root.copy(), side.min() != side.max()
    out = []
    for i in np.flatnonzero(root != main).tolist():
        terms = term[begin[i] : begin[i] + size[i]]
        n = length[terms]
        at = np.repeat(first[terms] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        same = np.bincount(posted[at], minlength=len(words))
        near = np.flatnonzero((100 * same >= percent * (size + size[i] - same)) & (label != label[i]) & ((side != side[i]) | (not both)))
        for j in near.tolist():
            if label[j] != label[i]:
                out.append((i, j))
                label[label == label[j]] = label[i]
    return out


def _compared(percent: int):
    def run(table: pa.Table) -> pa.Table:
        """Links of two blocks, or of one with itself."""
        table = table.sort_by("node")
        node = table.column("node").to_numpy()
        words = [np.frombuffer(w, "<u8") for w in table.column("words").to_pylist()]
        links = forest_of(words, table.column("root").to_numpy().copy(), table.column("main")[0].as_py(), table.column("side").to_numpy(), percent)
        return pa.table([[int(node[i]) for i, _ in links], [int(node[j]) for _, j in links]], schema=arrow_schema("a long, b long"))

    return run


def compared(left: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """left (node, root, main), once each -> links (a, b) of similar sets of one main and different components, enough to connect what they connect.

    main is the component that most of a band are in. Sets outside it are
    compared with those inside and with each other, those inside with nothing
    else: outsiders and insiders are dealt into blocks apart, of at most
    BLOCK_ROWS sets or BLOCK_BYTES, and a block of outsiders meets every other
    block in a task of its own, over an index of both. So with few outsiders a
    set of a large component moves once, however many there are and however
    many bands it shares with them. No pairs are emitted but links.
    """
    sized = left.withColumn("out", F.col("root") != F.col("main")).join(sets.select("node", F.octet_length("words").cast("long").alias("size")), "node")
    total = sized.groupBy("main", "out").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))
    blocks = F.greatest(F.lit(1), F.ceil(F.col("n") / BLOCK_ROWS), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int")
    of = total.groupBy("main").agg(F.max(F.when(F.col("out"), blocks)).alias("outs"), F.coalesce(F.max(F.when(~F.col("out"), blocks)), F.lit(0)).alias("ins"))
    dealt = sized.join(of, "main").withColumn("block", F.pmod(F.xxhash64("node"), F.when(F.col("out"), F.col("outs")).otherwise(F.col("ins"))).cast("int"))
    # A task is a block of outsiders and another block, insiders' ones counted on from outs.
    upto = lambda n: F.transform(F.array_repeat(F.lit(0), n), lambda _, k: k)
    task = lambda a, b, side: F.struct(a.alias("p"), b.alias("q"), F.lit(side).alias("side"))
    inside = F.transform(upto(F.col("outs")), lambda o: task(o, F.col("outs") + F.col("block"), 1))
    met = F.transform(upto(F.col("ins")), lambda i: task(F.col("block"), F.col("outs") + i, 0))
    others = F.transform(upto(F.col("outs")), lambda o: F.struct(F.least(o, "block").alias("p"), F.greatest(o, "block").alias("q"), (F.col("block") > o).cast("int").alias("side")))
    tasks = F.explode(F.when(F.col("out"), F.concat(met, others)).otherwise(inside))
    pairs = dealt.select("main", "node", "root", tasks.alias("t")).select("main", "node", "root", "t.*")
    return pairs.join(sets, "node").groupBy("main", "p", "q").applyInArrow(_compared(percent), "a long, b long").distinct()


def rooted(nodes: DataFrame, near: DataFrame | None, texts_of, percent: int = PERCENT, far: int = FAR) -> DataFrame:
    """nodes (node, fp, bands) -> (node, root): what links of near copies connect.

    near (a, b) are pairs that something else proposes (SimHash); texts_of
    gives (node, text), once each, for some nodes. First each text meets what is
    proposed and the first of all that share a band with it, then the first of
    each of its bands (where fingerprints are far bits apart at most). In bands
    that still hold several components, the texts outside the band's largest
    one are then compared with all those of other components. Pairs within a
    component need no look, so most of a large group of near copies takes a few
    comparisons a text, and no pair of a band is left out.
    """
    keys = nodes.select(F.explode("bands").alias("band"), "node", "fp")
    buckets = keys.groupBy("band").agg(F.min(F.struct("node", "fp")).alias("rep"), F.count(F.lit(1)).alias("n")).where("n > 1").select("band", "rep")
    shared = written(keys.join(buckets, "band").select("band", "node", "fp", "rep"), "shared")
    apart = F.bit_count(F.col("fp").bitwiseXOR(F.col("rep.fp")))
    star = shared.where((F.col("node") != F.col("rep.node")) & (apart <= far)).select(F.col("node").alias("a"), F.col("rep.node").alias("b"))
    star = written(star.distinct(), "star")
    first, ends = star.groupBy("a").agg(F.min("b").alias("b")), shared.select("node")
    if near is not None:
        near = written(near, "near")
        first, ends = first.unionByName(near).distinct(), ends.unionByName(near.select(F.explode(F.array("a", "b")).alias("node")))
    sets = written(with_sets(texts_of(ends.distinct())), "sets")
    links = verified(first, sets, percent)
    roots = written(_all_rooted(sets.select("node"), links), "roots")
    of = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias("r" + c))
    unlike = star.join(of("b"), "b").join(of("a"), "a").where("ra != rb").select("a", "b")
    roots = written(rooted_by(roots, verified(unlike, sets, percent)), "roots")
    own = shared.select("band", "node").join(roots, "node")
    parts = own.groupBy("band", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("band")  # summed before the shuffle
    mixed = parts.agg(F.max(F.struct("n", "root"))["root"].alias("main"), F.count(F.lit(1)).alias("parts")).where("parts > 1").select("band", "main")
    left = written(own.join(mixed, "band").select("node", "root", "main").distinct(), "mixed")
    roots = rooted_by(roots, compared(left, sets, percent)).withColumnRenamed("node", "linked")
    return nodes.join(roots, nodes["node"] == roots["linked"], "left").select("node", F.coalesce("root", "node").alias("root"))


def _all_rooted(nodes: DataFrame, links: DataFrame) -> DataFrame:
    roots = connected(links).withColumnRenamed("node", "linked")
    return nodes.join(roots, nodes["node"] == roots["linked"], "left").select("node", F.coalesce("root", "node").alias("root"))

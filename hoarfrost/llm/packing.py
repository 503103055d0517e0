"""Best-fit packing of token sequences, certified by lower bounds.

Pieces are dealt into partitions of a bounded number and packed by best-fit
decreasing. Dual-feasible functions give each partition a lower bound on its
bins, and so they do for all pieces together, from the counts of their lengths.
A packing that meets the common bound is certified and done. Else partitions
keep their full bins and put the pieces of all others into a common pool, which
is dealt anew and packed again; the new packing stands if it has fewer bins.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_bpe import Pieces, splitter
from .common import arrow_schema, fresh, made, mapped, named, others, schema_of, slices, taken, written

#: Pieces that one task packs, and rounds of repacking after the first.
PARTITION_PIECES, ROUNDS = 50_000, 2


def byte_signs() -> dict[int, str]:
    """The sign that stands for each byte in a byte-level vocabulary: printable Latin-1 ones for themselves, the others from code point 256 on, in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) if b in plain else chr(256 + others.index(b)) for b in range(256)}


@cache
def encoder(tokenizer_path: str, pattern: str):
    """text -> ids as little-endian bytes. The tokenizer splits by pattern and merges within pieces, so pieces are encoded once and kept.

    A plain byte-level tokenizer (no normalizer, no other pre-tokenizer) is
    asked through its model, which spares what encode() does about a text. A
    text that holds one of its added tokens (such as an end mark) is encoded
    whole by the tokenizer, which gives these ids of their own.
    """
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path)
    form = json.loads(tokenizer.to_str())
    added = "|".join(re.escape(t["content"]) for t in form["added_tokens"])
    special = re.compile(added, re.IGNORECASE if form["normalizer"] else 0).search if added else lambda text: None
    if form["normalizer"] is None and form["pre_tokenizer"]["type"] == "ByteLevel" and not form["pre_tokenizer"]["add_prefix_space"]:
        signs, merge = byte_signs(), tokenizer.model.tokenize
        encode = lambda piece: [t.id for t in merge(piece.encode().decode("latin-1").translate(signs))]
    else:
        encode = lambda piece: tokenizer.encode(piece, add_special_tokens=False).ids
    split, pieces = splitter(pattern), Pieces(encode, 350_000)

    def ids(text: str) -> bytes:
        if special(text):
            return np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(pieces.__getitem__, split(text)))

    return ids


def token_pieces(docs: DataFrame, tokenizer_path: str, pattern: str, size: int, end: int = 0, text: str = "text") -> DataFrame:
    """docs -> a row a piece: piece, start, length, ids_crc32 in place of text.

    A document is its ids and then the id end. Only one of over size ids is
    cut, into pieces of size; the first may be shorter. Null and empty texts
    are one piece, the id end. Repeated rows give pieces each, and an empty
    table none. No shuffle; extra columns stay, those named like the new ones
    are replaced.
    """
    new = "piece int, start long, length long, ids_crc32 long"
    rest = others(docs, text, *(x.split()[0] for x in new.split(", ")))
    schema, tail = arrow_schema(new), np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path, pattern)
        for b in slices(batches, text):
            row, piece, start, length, crc = [], [], [], [], []
            for i, t in enumerate(b.column(text).to_pylist()):
                ids = encode(t or "") + tail
                n = len(ids) // 4
                cuts = [0, *range(n % size or size, n, size), n]
                for k, (x, y) in enumerate(zip(cuts, cuts[1:])):
                    row.append(i)
                    piece.append(k)
                    start.append(x)
                    length.append(y - x)
                    crc.append(zlib.crc32(ids[4 * x : 4 * y]))
            own = made(schema, piece, start, length, crc)
            yield pa.RecordBatch.from_arrays([b.column(c).take(pa.array(row, pa.int64())) for c in rest] + own.columns, names=rest + schema.names)

    return mapped(docs, [*rest, text], run, schema_of(docs, rest, new))


def lower_bound(lengths: np.ndarray, size: int) -> int:
    """Bins that any packing of the lengths needs."""
    return counted_bound(np.bincount(lengths, minlength=size + 1), size)


def counted_bound(count: np.ndarray, size: int) -> int:
    """Bins that count[n] pieces of each length n need: the best of two families of dual-feasible functions, in integers.

    First: for a threshold t up to size / 2, lengths over size - t count as a
    whole bin, those under t as nothing. Second: for k, a length counts as the
    share floor((k + 1) * length / size) / k, or as itself where that is whole.
    """
    at = np.arange(size + 1)
    number, total = np.cumsum(count), np.cumsum(count * at)
    t = np.arange(1, size // 2 + 1)
    whole = number[size] - number[size - t]
    middle = total[size - t] - total[t - 1]
    best = max([int(-(-total[size] // size)), *(whole + -(-middle // size)).tolist()])
    for k in range(1, 33):
        scaled = (k + 1) * at
        share = np.where(scaled % size == 0, at * k, scaled // size * size)  # in units of 1 / (k * size)
        best = max(best, -(-int((share * count).sum()) // (k * size)))
    return best


def best_fit(lengths: list[int], size: int) -> tuple[list[int], list[int], list[int]]:
    """Best-fit decreasing: (bin, offset) of each length, and the room left in each bin.

    Bins wait in stacks by their room; the fullest that fits is the lowest set
    bit of a mask of stacks in use.
    """
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    bins, offsets = [0] * len(lengths), [0] * len(lengths)
    stacks: list[list[int]] = [[] for _ in range(size + 1)]
    room: list[int] = []
    used = 0
    for i in order:
        n = lengths[i]
        fits = used >> n
        if fits:
            r = n + (fits & -fits).bit_length() - 1
            b = stacks[r].pop()
            if not stacks[r]:
                used &= ~(1 << r)
        else:
            r, b = size, len(room)
            room.append(size)
        bins[i], offsets[i] = b, size - r
        room[b] = r = r - n
        stacks[r].append(b)
        used |= 1 << r
    return bins, offsets, room


def _packer(size: int):
    """A partition's pieces -> the same with bin, offset, gap (bins over the bound) and full (whether the bin has no room)."""

    def run(table: pa.Table) -> pa.Table:
        lengths = table.column("length").to_numpy()
        bins, offsets, room = best_fit(lengths.tolist(), size)
        gap = len(room) - lower_bound(lengths, size)
        full = np.array(room)[bins] == 0
        return pa.table(
            [table.column("slot"), table.column("row"), table.column("length"), pa.array(bins, pa.int64()), pa.array(offsets, pa.int64()), pa.array([gap] * len(bins), pa.int64()), pa.array(full)],
            names=["slot", "row", "length", "bin", "offset", "gap", "full"],
        )

    return run


PLACED = "slot long, row long, length long, bin long, offset long, gap long, full boolean"


def _pack(pieces: DataFrame, n: int, salt: int, size: int) -> DataFrame:
    slots = max(1, -(-n // PARTITION_PIECES))
    dealt = pieces.select(F.pmod(F.xxhash64("row", F.lit(salt)), F.lit(slots)).alias("slot"), "row", "length")
    return written(dealt.groupBy("slot").applyInArrow(_packer(size), PLACED), "packed")


def pack(pieces: DataFrame, size: int, length: str = "length", rounds: int = ROUNDS) -> DataFrame:
    """pieces with sequence_id and offset: sequences of size at most, as few as best-fit decreasing and its repacking find.

    Only row numbers and lengths are shuffled to be packed, PARTITION_PIECES a
    task or so. If the packing has more bins than the bound for all pieces,
    every bin with room goes to the pool, also those of partitions that meet
    their own bound: each of these has a last bin that is part-filled. A length
    that is null, under 1 or over size gets no sequence (nulls). Repeated rows
    are pieces of their own; of equal lengths the order of rows decides. An
    empty table gives an empty result; columns named like the new ones are
    replaced.
    """
    row, own = fresh(pieces.columns, "row_number", "placed_row")
    numbered = written(pieces.withColumn(row, F.monotonically_increasing_id()), "pieces")
    todo = numbered.select(named(row).alias("row"), named(length).cast("long").alias("length")).where(F.col("length").between(1, size))
    count = np.zeros(size + 1, np.int64)
    for r in todo.groupBy("length").count().collect():  # at most size rows
        count[r["length"]] = r["count"]
    bound, settled_bins = counted_bound(count, size), 0
    placed = None
    now = _pack(todo, int(count.sum()), 0, size)
    for k in range(rounds + 1):
        bins, open_, rest = now.agg(F.count_distinct("slot", "bin"), F.coalesce(F.sum((~F.col("full")).cast("long")), F.lit(0)), F.count_distinct(F.when(~F.col("full"), F.struct("slot", "bin")))).first()
        again = None
        if k < rounds and settled_bins + bins > bound:
            again = _pack(now.where(~F.col("full")).select("row", "length"), open_, k + 1, size)
            again = again if again.agg(F.count_distinct("slot", "bin")).first()[0] < rest else None
        kept = now.where("full") if again is not None else now
        part = kept.select(F.col("row").alias(own), "offset", F.struct(F.lit(k).alias("round"), "slot", "bin").alias("at"))
        placed = part if placed is None else placed.unionByName(part)
        if again is None:
            break
        now, settled_bins = again, settled_bins + bins - rest
    ids = placed.select(own, "offset", (F.shiftleft(F.col("at.round").cast("long"), 56) + F.shiftleft(F.col("at.slot"), 24) + F.col("at.bin")).alias("sequence_id"))
    rest = others(pieces, "sequence_id", "offset")
    joined = taken(numbered, [*rest, row]).join(ids, named(row) == F.col(own), "left")
    return taken(joined, [*rest, "sequence_id", "offset"])

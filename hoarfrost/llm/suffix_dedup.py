"""Repeated substrings across documents by bucket-pointer refinement of suffixes.

Suffixes are put into buckets by a q-gram; a bucket is refined by sorting its
suffixes on the buckets that the suffixes some bytes later are in, and the
pointers of the refined buckets are used at the next, doubled depth: 8, 16, 32
and at last the wanted 50 bytes. Suffixes that are alone in a bucket are done.
Buckets are refined by the bytes themselves, so what is found to be equal is.

Which suffixes meet is decided by hashes of 20 bytes, made of those of 1, 2, 4,
8 and 16. Of the 31 20-grams in a 50-byte string the one with the smallest hash
is its anchor; equal strings have equal anchors, so a string in two documents
has its anchor's bucket in both. Anchors (one in 16 positions) go to their
buckets; buckets of one document end there, and those of several are refined
over the strings that hang on their anchors, in the same bucket of the shuffle.
Hashes only bring strings together: a clash costs a look, nothing else.

Documents are dealt into groups of some megabytes by a hash of id and text. The
text is shuffled once for that and read three times (the same exchange). Within
a group a bucket is looked at once, whatever number of documents hold it: the
group sends one entry for each anchor bucket and each distinct run of strings
around an anchor. An anchor with more than HOT_RUNS entries is no bucket of one
task: its strings become rows of their own, and Spark finds the smallest
document of each by a grouped minimum (summed up before the shuffle) and a join
(whose skewed keys it splits).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import arrow_schema, named, others, schema_of, short, taken

Q, DEPTH = 20, 50
WINDOW = DEPTH - Q + 1
#: Bytes of text in a group of documents and in a block within it; anchors in a shuffle bucket; entries of an anchor that one task takes.
GROUP_BYTES, BLOCK, BUCKET_ANCHORS, HOT_RUNS = 4 << 20, 1 << 16, 1 << 18, 1 << 14
#: Runs whose strings are refined together (anchors aren't cut apart).
CHUNK_RUNS = 1 << 12
U = np.uint64
#: Fixed odd multipliers of the hashes' mixing.
MULTIPLIERS = (U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB), U(0x9E3779B97F4A7C15))
#: Ids above all others: for null ids.
NO_ID = (1 << 63) - 1


def _mixed(first: np.ndarray, later: np.ndarray) -> np.ndarray:
    x = first * MULTIPLIERS[0]
    x += later
    x ^= x >> U(29)
    x *= MULTIPLIERS[1]
    x ^= x >> U(32)
    return x


_SINGLE = _mixed(np.arange(256, dtype=U) + MULTIPLIERS[2], np.arange(256, dtype=U) * MULTIPLIERS[2])


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """The hash of the Q bytes from each position that has so many."""
    d1 = _SINGLE[data]
    d2 = _mixed(d1[:-1], d1[1:])
    d4 = _mixed(d2[:-2], d2[2:])
    d8 = _mixed(d4[:-4], d4[4:])
    d16 = _mixed(d8[:-8], d8[8:])
    return _mixed(d16[:-4], d4[16:])


def _words(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The eight bytes from each place of at on, as a number."""
    out = data[at].astype(U)
    for k in range(1, 8):
        out = (out << U(8)) | data[at + k]
    return out


def _pointers(keys: np.ndarray) -> np.ndarray:
    """Buckets of equal keys: each gets the place of its first member in sorted order."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    new = np.empty(len(k), bool)
    new[:1] = True
    np.not_equal(k[1:], k[:-1], out=new[1:])
    out = np.empty(len(k), np.int64)
    out[order] = np.maximum.accumulate(np.where(new, np.arange(len(k)), 0))
    return out


def _crowded(pointer: np.ndarray) -> np.ndarray:
    """The members of buckets of two and more."""
    return np.flatnonzero(np.bincount(pointer, minlength=len(pointer))[pointer] > 1)


def _refine(pointer: np.ndarray, members: np.ndarray, later: np.ndarray) -> None:
    """Refine the buckets of members (whole buckets) by sorting each on what its members have later; their pointers are brought up to date."""
    if later.dtype == U:
        order = np.lexsort((later, pointer[members]))
    else:  # pointers: both fit one number
        order = np.argsort(pointer[members] << 32 | later, kind="stable")
    own, key = pointer[members[order]], later[order]
    old = np.empty(len(own), bool)
    old[:1] = True
    np.not_equal(own[1:], own[:-1], out=old[1:])
    new = old.copy()
    new[1:] |= key[1:] != key[:-1]
    at = np.arange(len(own))
    pointer[members[order]] = own + np.maximum.accumulate(np.where(new, at, 0)) - np.maximum.accumulate(np.where(old, at, 0))


def equal_runs(data: np.ndarray, start: np.ndarray, count: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """Bucket pointers of runs: equal for runs of one bucket with as many strings and the same bytes.

    The runs' buckets are refined by the q-grams (eight bytes) at later and
    later offsets; runs that are alone drop out.
    """
    pointer = _pointers(bucket)
    members = _crowded(pointer)
    _refine(pointer, members, count[members])
    size = count + DEPTH - 1
    for offset in range(0, WINDOW + DEPTH - 1, 8):
        members = _crowded(pointer)
        if not len(members):
            break
        _refine(pointer, members, _words(data, start[members] + np.minimum(offset, size[members] - 8)))
    return pointer


def equal_strings(data: np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Bucket pointers of all strings of some runs, run by run: equal for the same DEPTH bytes.

    Every suffix of a run starts in the bucket of its first eight bytes; at
    each depth the buckets are refined by the pointers of the suffixes that
    many bytes later, which the depth before has left.
    """
    size = count + DEPTH - 1
    first = np.cumsum(size) - size
    nth = np.arange(size.sum()) - np.repeat(first, size)
    left = np.repeat(size, size) - nth
    at = np.repeat(start, size) + nth
    have = np.flatnonzero(left >= 8)
    pointer = np.full(len(at), -1, np.int64)
    pointer[have] = _pointers(_words(data, at[have]))
    for depth, step in ((16, 8), (32, 16), (DEPTH, DEPTH - 32)):
        have = np.flatnonzero(left >= depth)
        crowd = np.bincount(pointer[have], minlength=len(at)) > 1
        members = have[crowd[pointer[have]]]
        _refine(pointer, members, pointer[members + step])
    return pointer[left >= DEPTH]


def _lows(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every width neighbours."""
    n, have = len(x) - width + 1, 1
    while have < width:
        step = min(have, width - have)
        x = np.minimum(x[: len(x) - step], x[step:])
        have += step
    return x[:n]


class Strings:
    """The DEPTH-byte strings of some documents, hung on their anchors.

    Runs are what neighbouring strings of a document share: anchor key, start
    of the first string, count (31 at most).
    """

    def __init__(self, texts: list[bytes]):
        self.sizes = np.array([len(t) for t in texts], np.int64)
        self.offsets = np.cumsum(self.sizes) - self.sizes
        self.data = _bytes(b"".join(texts))
        parts = [(np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for offset, size in zip(self.offsets.tolist(), self.sizes.tolist()):
            for at in range(0, size - DEPTH + 1, BLOCK):
                parts.append(self._runs(offset + at, min(BLOCK, size - DEPTH + 1 - at)))
        self.key, self.start, self.count = (np.concatenate(x) for x in zip(*parts))
        self.doc = np.searchsorted(self.offsets, self.start, "right") - 1

    def _runs(self, at: int, n: int):
        dq = gram_hashes(self.data[at : at + n + DEPTH - 1])
        low = _lows(dq, WINDOW)
        new = np.empty(n, bool)
        new[0] = True
        np.not_equal(low[1:], low[:-1], out=new[1:])
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, n))
        if (count > WINDOW - 1).any():  # a q-gram that comes again: cut into runs of 31
            first = np.concatenate([np.arange(f, f + c, WINDOW) for f, c in zip(first.tolist(), count.tolist())])
            count = np.diff(np.append(first, n))
        return low[first], first + at, count


def _bytes(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint8) if raw else np.zeros(0, np.uint8)


def _sized(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _raw(blob: bytes) -> bytes:
    return pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)


def _ordered(table: pa.Table) -> tuple[pa.Table, list[bytes], np.ndarray]:
    """A group's rows in an order that doesn't depend on how they came, with texts and ids (null: NO_ID)."""
    table = table.sort_by([("doc_id", "ascending"), ("h", "ascending")])
    texts = [x or b"" for x in table.column("text").cast(pa.binary()).to_pylist()]
    return table, texts, table.column("doc_id").fill_null(NO_ID).to_numpy().astype(np.int64)


def _anchor_keys(s: Strings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct anchor keys, key number of each run, whether two of the group's documents have the key)."""
    keys, of = np.unique(s.key, return_inverse=True)
    low = np.full(len(keys), 1 << 62)
    high = np.full(len(keys), -1)
    np.minimum.at(low, of, s.doc)
    np.maximum.at(high, of, s.doc)
    return keys, of, low < high


def _by_bucket(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """bucket of each key, and for each bucket the numbers of its keys in order."""
    bucket = (keys % U(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    return bucket, [(int(bucket[part[0]]), part) for part in np.split(order, cuts) if len(part)]


ENTRY = arrow_schema("bucket long, g long, blob binary")
REPLY = arrow_schema("g long, bucket long, blob binary")
STRING = arrow_schema("w binary, g long, at long, id long")
#: Bytes of an anchor's key and of its number of entries (as a power of two) on the wire.
KEY_BYTES, COUNT_BYTES = 6, 1
HOT = np.uint32(1 << 31)


def _entries(s: Strings, of: np.ndarray, keys: int) -> np.ndarray:
    """About how many different runs each key has (by their ends); as a power of two, rounded up."""
    runs = np.bincount(of, minlength=keys)
    several = np.flatnonzero(runs[of] > 1)
    size = s.count[several] + DEPTH - 1
    look = np.unique(_mixed(_mixed(of[several].astype(U), _words(s.data, s.start[several])), _mixed(size.astype(U), _words(s.data, s.start[several] + size - 8))), return_index=True)[1]
    different = np.bincount(of[several[look]], minlength=keys)
    return np.ceil(np.log2(np.maximum(different, 1))).astype(np.uint8)


def _send_anchors(buckets: int):
    def run(table: pa.Table) -> pa.Table:
        table, texts, _ = _ordered(table)
        s = Strings(texts)
        keys, of, _ = _anchor_keys(s)
        g = table.column("g")[0].as_py()
        wire = np.zeros((len(keys), KEY_BYTES + COUNT_BYTES), np.uint8)
        wire[:, :KEY_BYTES] = (keys // U(buckets)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES]
        wire[:, KEY_BYTES] = _entries(s, of, len(keys))
        parts = _by_bucket(keys, buckets)[1]
        return pa.table([[b for b, _ in parts], [g] * len(parts), [wire[p].tobytes() for _, p in parts]], schema=ENTRY)

    return run


def _shared_anchors(hot_runs: int):
    def run(table: pa.Table) -> pa.Table:
        """Of each group's keys in this bucket the numbers of those that other groups have too, marked HOT where entries are many; and of its own if they are."""
        gs, blobs = table.column("g").to_pylist(), table.column("blob").to_pylist()
        width = KEY_BYTES + COUNT_BYTES
        sizes = [len(b) // width for b in blobs]
        wire = np.frombuffer(b"".join(blobs), np.uint8).reshape(-1, width)
        wide = np.zeros((len(wire), 8), np.uint8)
        wide[:, :KEY_BYTES] = wire[:, :KEY_BYTES]
        pointer = _pointers(wide.view("<u8").ravel())
        entries = np.bincount(pointer, np.exp2(wire[:, KEY_BYTES]), minlength=len(pointer))[pointer]
        hot = entries > hot_runs
        told = np.flatnonzero((np.bincount(pointer, minlength=len(pointer))[pointer] > 1) | hot)
        ends = np.cumsum(sizes)
        out = [(g, part, end - n) for g, part, end, n in zip(gs, np.split(told, np.searchsorted(told, ends[:-1])), ends.tolist(), sizes) if len(part)]
        bucket = table.column("bucket")[0].as_py()
        said = [((part - first).astype("<u4") | np.where(hot[part], HOT, np.uint32(0))).astype("<u4").tobytes() for _, part, first in out]
        return pa.table([[g for g, _, _ in out], [bucket] * len(out), said], schema=REPLY)

    return run


def _run_bytes(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    return data[np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())]


def _blob(kind: bytes, s: Strings, ids: np.ndarray, part: np.ndarray) -> bytes:
    """Runs on the wire: ids, places in the group, counts and bytes."""
    raw = [np.int64(len(part)).tobytes(), ids[s.doc[part]].astype("<i8").tobytes(), s.start[part].astype("<u4").tobytes(), s.count[part].astype(np.uint8).tobytes()]
    return kind + _sized(b"".join([*raw, _run_bytes(s.data, s.start[part], s.count[part] + DEPTH - 1).tobytes()]))


def _runs_of(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, bytes]:
    raw = _raw(blob[1:])
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    return np.frombuffer(raw, "<i8", n, 8), np.frombuffer(raw, "<u4", n, 8 + 8 * n), np.frombuffer(raw, np.uint8, n, 8 + 12 * n).astype(np.int64), raw[8 + 13 * n :]


def _send_strings(buckets: int):
    """The distinct runs of strings around the shared anchors, each with the smallest id that the group has it in."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return ENTRY.empty_table()
        left, texts, ids = _ordered(left)
        g = left.column("g")[0].as_py()
        s = Strings(texts)
        keys, of, shared = _anchor_keys(s)
        hot = np.zeros(len(keys), bool)
        bucket, parts = _by_bucket(keys, buckets)
        replies = dict(zip(right.column("bucket").to_pylist(), right.column("blob").to_pylist()))
        for b, part in parts:
            if b in replies:
                told = np.frombuffer(replies[b], "<u4")
                shared[part[told & ~HOT]] = True
                hot[part[told[told >= HOT] & ~HOT]] = True
        runs = np.flatnonzero(shared[of])
        if not len(runs):
            return ENTRY.empty_table()
        # Of runs with the same bytes those of the smallest id go on; the others' strings are found to be repeated here.
        pointer = equal_runs(s.data, s.start[runs], s.count[runs], of[runs])
        order = np.lexsort((ids[s.doc[runs]], pointer))
        own = pointer[order]
        head = np.append(True, own[1:] != own[:-1])
        order = runs[order]
        repeated = ids[s.doc[order]] > ids[s.doc[order[head]]][np.cumsum(head) - 1]
        later, sent = order[repeated], order[~repeated]
        rows = [(g % buckets, g, b"d" + _sized(s.start[later].astype("<u4").tobytes() + ((U(1) << s.count[later].astype(U)) - U(1)).astype("<u4").tobytes()))] if len(later) else []
        spread = sent[hot[of[sent]]]
        for at in range(0, len(spread), CHUNK_RUNS):
            rows.append((-1 - g, g, _blob(b"h", s, ids, spread[at : at + CHUNK_RUNS])))
        sent = sent[~hot[of[sent]]]
        at = bucket[of[sent]]
        order = np.argsort(at, kind="stable")
        sent = sent[order]
        for part in np.split(sent, np.flatnonzero(np.diff(at[order])) + 1):
            if len(part):
                rows.append((int(bucket[of[part[0]]]), g, _blob(b"s", s, ids, part)))
        return pa.table([list(x) for x in zip(*rows)], schema=ENTRY)

    return run


def _least_ids(data: np.ndarray, start: np.ndarray, count: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each run (row) and each of its strings the smallest id of any run that has the string."""
    key = np.concatenate([np.zeros(0, U), *(_anchors_of(data, start[i : i + CHUNK_RUNS], count[i : i + CHUNK_RUNS]) for i in range(0, len(start), CHUNK_RUNS))])
    pointer = equal_runs(data, start, count, key)
    first, of = np.unique(pointer, return_index=True, return_inverse=True)[1:]
    least = np.full(len(first), NO_ID)
    np.minimum.at(least, of, ids)
    low = np.repeat(least[:, None], WINDOW, axis=1)
    # Anchors with one run are done; the others' strings are refined.
    anchor = _pointers(key[first])
    crowd = _crowded(anchor)
    crowd = crowd[np.argsort(anchor[crowd], kind="stable")]
    cuts = np.flatnonzero(np.diff(anchor[crowd])) + 1
    cuts = np.append(cuts, len(crowd)) if len(crowd) else cuts
    at = 0
    while at < len(crowd):
        to = int(cuts[max(np.searchsorted(cuts, at, "right"), np.searchsorted(cuts, at + CHUNK_RUNS, "right") - 1)])
        part = crowd[at:to]
        n = count[first[part]]
        string = equal_strings(data, start[first[part]], n)
        lows = np.full(string.max() + 1, NO_ID)
        np.minimum.at(lows, string, np.repeat(least[part], n))
        nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        low[np.repeat(part, n), nth] = lows[string]
        at = to
    return low[of]


def _anchors_of(data: np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The anchor's hash of each run: the smallest of its Q-grams."""
    size = count + DEPTH - 1
    hashes = gram_hashes(_run_bytes(data, start, size))
    first = np.cumsum(size) - size
    n = size - Q + 1
    own = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
    return np.minimum.reduceat(hashes[own], np.cumsum(n) - n)


def _masks(low: np.ndarray, ids: np.ndarray, count: np.ndarray) -> np.ndarray:
    """A bit for each string that a smaller id has."""
    bits = (low < ids[:, None]) & (np.arange(WINDOW) < count[:, None])
    return (bits.astype(np.uint32) << np.arange(WINDOW, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)


def _repeated_strings(table: pa.Table) -> pa.Table:
    """For each run the strings (a bit each) that a smaller id has too."""
    out, runs, gs = [], [], []
    bucket = table.column("bucket")[0].as_py()
    for g, blob in zip(table.column("g").to_pylist(), table.column("blob").to_pylist()):
        if blob[:1] == b"d":
            out.append((g, _raw(blob[1:])))
        elif blob[:1] == b"s":
            runs.append(_runs_of(blob))
            gs.append(np.full(len(runs[-1][0]), g))
    if runs:
        ids, places, count = (np.concatenate([r[k] for r in runs]) for k in range(3))
        gs = np.concatenate(gs)
        size = count + DEPTH - 1
        mask = _masks(_least_ids(_bytes(b"".join(r[3] for r in runs)), np.cumsum(size) - size, count, ids), ids, count)
        found = np.flatnonzero(mask)
        found = found[np.argsort(gs[found], kind="stable")]
        for part in np.split(found, np.flatnonzero(np.diff(gs[found])) + 1):
            if len(part):
                out.append((int(gs[part[0]]), places[part].astype("<u4").tobytes() + mask[part].astype("<u4").tobytes()))
    return pa.table([[g for g, _ in out], [bucket] * len(out), [b for _, b in out]], schema=REPLY)


def _hot_strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The strings of hot anchors as rows: their bytes, group, place and id."""
    for batch in batches:
        for g, blob in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            if blob[:1] != b"h":
                continue
            ids, places, count, raw = _runs_of(blob)
            data = _bytes(raw)
            size = count + DEPTH - 1
            for at in range(0, len(ids), 512):
                n = count[at : at + 512]
                nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                start = np.repeat((np.cumsum(size) - size)[at : at + 512], n) + nth
                w = data[start[:, None] + np.arange(DEPTH)].tobytes()
                offsets = np.arange(0, len(w) + 1, DEPTH, dtype=np.int32)
                strings = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(w)])
                yield pa.RecordBatch.from_arrays([strings, pa.array(np.full(len(start), g)), pa.array(np.repeat(places[at : at + 512].astype(np.int64), n) + nth), pa.array(np.repeat(ids[at : at + 512], n))], schema=STRING)


def _hot_replies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Single repeated strings (g, at) as replies to their groups."""
    for batch in short(batches, 1 << 14):
        g, at = (batch.column(k).to_numpy() for k in (0, 1))
        order = np.argsort(g, kind="stable")
        parts = [p for p in np.split(order, np.flatnonzero(np.diff(g[order])) + 1) if len(p)]
        blobs = [at[p].astype("<u4").tobytes() + np.ones(len(p), "<u4").tobytes() for p in parts]
        yield pa.RecordBatch.from_arrays([pa.array([int(g[p[0]]) for p in parts], pa.int64()), pa.array([-1] * len(parts), pa.int64()), pa.array(blobs, pa.binary())], schema=REPLY)


def _cut(new: dict[str, str], decode: bool):
    """Each document with the bytes that its repeated strings cover taken out."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([("doc_id", pa.int64()), left.schema.field("more"), *arrow_schema(", ".join(f"{n} {k}" for n, k in new.items()))])
        if not left.num_rows:
            return schema.empty_table()
        left, texts, _ = _ordered(left)
        sizes = np.array([len(t) for t in texts], np.int64)
        offsets = np.cumsum(sizes) - sizes
        data = _bytes(b"".join(texts))
        edge = np.zeros(len(data) + 1, np.int64)
        for blob in right.column("blob").to_pylist():
            start, mask = np.frombuffer(blob, "<u4").reshape(2, -1)
            bits = (mask[:, None] >> np.arange(32, dtype=np.uint32)) & 1
            i, nth = np.nonzero(bits)
            at = start[i].astype(np.int64) + nth
            np.add.at(edge, at, 1)
            np.add.at(edge, at + DEPTH, -1)
        gone = np.cumsum(edge[:-1]) > 0
        kept, removed, spans = [], [], []
        for t, a, n in zip(texts, offsets.tolist(), sizes.tolist()):
            x = gone[a : a + n]
            k = int(np.count_nonzero(x))
            removed.append(k)
            spans.append(int(np.count_nonzero(x[1:] & ~x[:-1]) + x[0]) if k else 0)
            kept.append(data[a : a + n][~x].tobytes() if k else t)
        if decode:
            kept = [t.decode("utf-8", "ignore") for t in kept]
        return pa.table([left.column("doc_id"), left.column("more"), sizes, removed, spans, kept], schema=schema)

    return run


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", decode: bool = False) -> DataFrame:
    """docs with n_bytes, n_removed, n_spans and kept in place of text.

    kept is binary; with decode it is a string, without the bytes of characters
    that were cut through.

    A byte goes if a DEPTH-byte string that covers it starts in a document of a
    smaller id as well; strings are judged on the input, whatever else goes.
    Null texts are empty; null ids count as larger than all others; rows of the
    same id, repeated rows too, don't take from each other. An empty table gives
    an empty result. Extra columns stay; those named like the new ones are
    replaced. Ids must be whole numbers. A group holds whole documents, so a
    text must fit a task's memory some five times.
    """
    new = {"n_bytes": "long", "n_removed": "long", "n_spans": "long", "kept": "string" if decode else "binary"}
    rest = others(docs, text, *new)
    size = docs.agg(F.coalesce(F.sum(F.octet_length(named(text))), F.lit(0))).first()[0]
    groups, buckets = max(1, -(-size // GROUP_BYTES)), max(1, -(-size // (BUCKET_ANCHORS * WINDOW // 2)))
    more = [c for c in rest if c != doc_id]
    h = F.xxhash64(named(doc_id), named(text))
    dealt = docs.select(
        named(doc_id).cast("long").alias("doc_id"), named(text).alias("text"),
        F.struct(*map(named, more)).alias("more") if more else F.lit(None).cast("int").alias("more"), h.alias("h"), F.pmod(h, F.lit(groups)).alias("g"),
    ).repartition(F.col("g"))
    entry, reply = "bucket long, g long, blob binary", "g long, bucket long, blob binary"
    anchors = dealt.groupBy("g").applyInArrow(_send_anchors(buckets), entry)
    shared = anchors.groupBy("bucket").applyInArrow(_shared_anchors(HOT_RUNS), reply)
    strings = dealt.groupBy("g").cogroup(shared.groupBy("g")).applyInArrow(_send_strings(buckets), entry).repartition(F.col("bucket"))
    hot = strings.mapInArrow(_hot_strings, "w binary, g long, at long, id long")
    least = hot.groupBy("w").agg(F.min("id").alias("least"))
    single = hot.join(least, "w").where("id > least").select("g", "at").mapInArrow(_hot_replies, reply)
    repeats = strings.groupBy("bucket").applyInArrow(_repeated_strings, reply).unionByName(single)
    kinds = StructType([StructField("doc_id", LongType()), StructField("more", dealt.schema["more"].dataType), *schema_of(docs, [], ", ".join(f"{n} {k}" for n, k in new.items())).fields])
    out = dealt.groupBy("g").cogroup(repeats.groupBy("g")).applyInArrow(_cut(new, decode), kinds)
    kind = docs.schema[doc_id].dataType
    return taken(out.select(*[F.col("doc_id").cast(kind).alias(c) if c == doc_id else F.col("more").getField(c).alias(c) for c in rest], *new), [*rest, *new])

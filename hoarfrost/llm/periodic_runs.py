"""Periodic runs of words: names of power-of-two windows, and candidates on a grid extended by descending name levels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import mapped, others, schema_of, slices

#: Least words of a run.
LEAST = 12
#: Name levels that are kept: windows of 1 to 2**(LEVELS - 1) words; longer stretches are compared in several of the longest.
LEVELS = 11
#: Candidates that are looked at together.
CHUNK = 1 << 19


def name_levels(symbols: np.ndarray) -> list[np.ndarray]:
    """For each level k the names of the windows of 2**k symbols that start at each place: equal if and only if the windows are.

    A level is named by sorting pairs of names of the level before. A window
    that is nowhere else has a name below zero, and only the others go on to
    the next level; levels end where every window is the only one.
    """
    n = len(symbols)
    out: list[np.ndarray] = []
    at, key = np.arange(n), symbols
    while len(at) and len(out) < LEVELS:
        order = np.argsort(key)
        key = key[order]
        group = np.cumsum(np.append(False, key[1:] != key[:-1]), dtype=np.int32)
        shared = (np.bincount(group) > 1)[group]
        name = -1 - np.arange(n, dtype=np.int32)
        name[at[order[shared]]] = group[shared]
        width = 1 << len(out)
        out.append(name)
        at = np.flatnonzero(name[: n - width] >= 0) if width < n else np.zeros(0, np.int64)
        at = at[name[at + width] >= 0]
        key = name[at].astype(np.int64) * (int(group[-1]) + 1) + name[at + width]
    return out


def _common(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray, back: bool) -> np.ndarray:
    """How many symbols from i and j > i on (or, back, before them) are the same: the longest windows first, as often as they fit."""
    n = len(levels[0])
    out = np.zeros(len(i), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        name, width = levels[k], 1 << k
        going = np.arange(len(i))
        while len(going):
            a, b = (i[going] - out[going] - width, j[going] - out[going] - width) if back else (i[going] + out[going], j[going] + out[going])
            fits = (a >= 0) if back else (b < n)
            going, a, b = going[fits], a[fits], b[fits]
            going = going[name[a] == name[b]]
            out[going] += width
            if k < len(levels) - 1:
                break
    return out


def runs_of(symbols: np.ndarray, longest: int, least: int = LEAST) -> np.ndarray:
    """Rows (start, end, period) of all runs of some symbols, by start and period.

    A run is a stretch with its smallest period q, least and 2 * q long at
    least, that no neighbour extends. Its matches with itself q on cover a
    multiple of q, so candidates are the pairs (i, i + q) for multiples i of q:
    one is looked at if a window of half the needed matches before or behind it
    has the same name at both. Both directions are then extended by names.
    Pairs that give the same run again are left out: those whose predecessor
    matches up to them, and those within a run that is known by a divisor of q. longest: symbols of the longest stretch without a border.
    """
    levels = name_levels(symbols)
    n, found = len(symbols), [np.zeros((0, 3), np.int64)]
    of, periods = np.zeros(n, np.int32), [np.ones(1, np.int64)]  # the run each place is known to be in, 0 for none; the runs' periods
    q = 1
    while q <= longest // 2:
        need = lambda q: max(q, least - q)
        k = ((need(q) + 1) // 2).bit_length() - 1
        if k >= len(levels) and len(levels) < LEVELS:
            break  # no window of that width is there twice
        end = q + 1
        while end <= longest // 2 and end < 2 * q and min(((need(end) + 1) // 2).bit_length(), LEVELS) == min(k + 1, LEVELS):
            end += 1
        name, width = levels[min(k, len(levels) - 1)], 1 << min(k, len(levels) - 1)
        qs = np.arange(q, end)
        q = end
        begins = np.concatenate([[0], np.cumsum(np.maximum(0, -(-(n - qs) // qs)))])
        for lo in range(0, int(begins[-1]), CHUNK):
            place = np.arange(lo, min(lo + CHUNK, int(begins[-1])))
            which = np.searchsorted(begins, place, "right") - 1
            p = qs[which]
            i = (place - begins[which]) * p
            before = np.maximum(i - width, 0)
            look = (name[i] == name[i + p]) | ((i >= width) & (name[before] == name[before + p]))
            i, p = i[look], p[look]
            if k + 1 < len(levels):  # where all q symbols from the pair before on match, that pair gives the same run
                wide, span = levels[k + 1], 2 << k
                a, z = np.maximum(i - p, 0), np.maximum(i - p, i - span)
                new = ~((i >= p) & (wide[a] == wide[i]) & (wide[z] == wide[z + p]))
                i, p = i[new], p[new]
            known = of[i]
            if len(periods) > 1 or len(periods[0]) > 1:
                new = ~((known > 0) & (known == of[i + p]) & (p % np.concatenate(periods)[known] == 0))
                i, p = i[new], p[new]
            if not len(i):
                continue
            ahead, back = _common(levels, i, i + p, False), _common(levels, i, i + p, True)
            fits = ahead + back >= np.maximum(p, least - p)
            runs = np.stack([i[fits] - back[fits], i[fits] + p[fits] + ahead[fits], p[fits]], axis=1)
            runs = _least_periods(runs)
            count = 1 + sum(map(len, found))
            for r, (a, z, _) in enumerate(runs.tolist(), count):
                of[a:z] = r
            found.append(runs)
            periods.append(runs[:, 2])
    runs = _least_periods(np.concatenate(found))
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _least_periods(runs: np.ndarray) -> np.ndarray:
    """Each stretch once, with the smallest of its periods."""
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    first = np.ones(len(runs), bool)
    first[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)
    return runs[first]


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of binary texts behind each other (nulls have none), and where each text's begin, with the end of the last."""
    lists = pc.split_pattern_regex(pc.fill_null(texts, b""), r"[\x20\x09-\x0D]+")
    words = lists.flatten()
    some = pc.greater(pc.binary_length(words), 0)
    ends = np.concatenate([[0], np.cumsum(some.to_numpy(zero_copy_only=False))])
    offsets = lists.offsets.to_numpy()
    return words.filter(some), ends[offsets - offsets[0]]


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _found(texts: pa.Array, least: int) -> tuple[pa.Array, pa.Array, pa.Array]:
    """n_words, runs and collapsed of some texts."""
    words, begins = words_of(texts)
    counts = np.diff(begins)
    codes = words.dictionary_encode()
    owner = np.repeat(np.arange(len(counts)), counts)
    # A word of another document is another symbol, so nothing matches across documents.
    symbols = owner * (len(codes.dictionary) + 1) + codes.indices.to_numpy()
    runs = runs_of(symbols, int(counts.max(initial=0)), least)
    drop = np.zeros(len(symbols) + 1, np.int32)
    np.add.at(drop, runs[:, 0] + runs[:, 2], 1)
    np.add.at(drop, runs[:, 1], -1)
    keep = np.cumsum(drop)[:-1] == 0
    kept = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(keep)])[begins].astype(np.int32)), words.filter(pa.array(keep)))
    doc = owner[runs[:, 0]]
    rows = pa.StructArray.from_arrays([pa.array(x) for x in (runs[:, 0] - begins[doc], runs[:, 1] - runs[:, 0], runs[:, 2])], fields=list(RUN))
    lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(len(counts) + 1)).astype(np.int32)), rows)
    return pa.array(counts.astype(np.int64)), lists, pc.binary_join(kept, b" ").cast(pa.string())


def find_runs(docs: DataFrame, text: str = "text", least: int = LEAST) -> DataFrame:
    """docs with n_words long, runs (array of start, length, period, in words from 0, by start and period) and collapsed in place of text.

    A run is a stretch of words with smallest period q (words q apart are the
    same) and at least least and 2 * q words that no neighbour extends. In
    collapsed the words of any run behind its first q words are gone; the
    others are joined by one blank.

    Null and empty texts have no words and no runs, and collapsed is empty.
    Repeated rows have the same runs. Texts of any length are looked at whole,
    each within one task; memory is some 100 bytes a word. An empty table gives an empty
    result. Columns of those names are replaced. No shuffle.
    """
    new = {"n_words": "long", "runs": "array<struct<start:bigint,length:bigint,period:bigint>>", "collapsed": "string"}
    rest = others(docs, text, *new)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text):
            found = _found(b.column(text).cast(pa.binary()), least)
            yield pa.RecordBatch.from_arrays([b.column(c) for c in rest] + list(found), names=[*rest, *new])

    return mapped(docs, [*rest, text], run, schema_of(docs, rest, ", ".join(f"{c} {k}" for c, k in new.items())))

"""Byte-level BPE by prefix dynamic programming.

For every prefix of a byte string the table holds the one token that ends the
prefix's encoding. A prefix's last token is the one whose own start has a last
token that it can stand beside, i.e. no merge crosses their border. So the
table of a string is a prefix of the table of any longer string: bytes are
appended exactly by going on, and an edit keeps everything before it and, once
the tables agree again over a token's length, everything after it.
"""

from __future__ import annotations

import base64
import re
import sys
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import mapped, others, schema_of, slices

NEVER = 1 << 60


class Ranks:
    """A rank vocabulary, its merge tree and which tokens can stand side by side."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.size = max(ranks.values()) + 1
        self.bytes: list[bytes] = [b""] * self.size
        for token, rank in ranks.items():
            self.bytes[rank] = token
        self.longest = max(map(len, ranks))
        self.pair: dict[tuple[int, int], int] = {}
        #: Tokens along the right (left) edge of a token, each with the rank at which the next larger one swallows it.
        self.right: list[tuple] = [()] * self.size
        self.left: list[tuple] = [()] * self.size
        self.beside: dict[int, bool] = {}
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) > 1 and (parts := self._parts(token, rank)):
                a, b = parts
                self.pair[parts] = rank
                self.right[rank] = ((rank, NEVER), (b, rank), *self.right[b][1:])
                self.left[rank] = ((rank, NEVER), (a, rank), *self.left[a][1:])
            else:
                self.right[rank] = self.left[rank] = ((rank, NEVER),)

    def _parts(self, token: bytes, below: int) -> tuple[int, int] | None:
        """The two tokens that a token is merged from: what is left of it by the merges before its own."""
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best = min((self.ranks.get(parts[i] + parts[i + 1], NEVER), i) for i in range(len(parts) - 1))
            if best[0] >= below:
                return None
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return self.ranks[parts[0]], self.ranks[parts[1]]

    def fit(self, a: int, b: int) -> bool:
        """True if no merge crosses the border of a and b in their joined bytes.

        Two tokens x, y at the border merge at their pair's rank if both are
        still there then; at equal ranks the merge further left goes first.
        """
        key = a * self.size + b
        if (known := self.beside.get(key)) is None:
            pair = self.pair.get
            known = not any((r := pair((x, y), NEVER)) < until_x and r <= until_y and r < NEVER for x, until_x in self.right[a] for y, until_y in self.left[b])
            if len(self.beside) > 500_000:
                self.beside.clear()
            self.beside[key] = known
        return known

    def step(self, data: bytes, end: int, last: list[int]) -> int:
        """The last token of data[:end], given those of the shorter prefixes (last[k] is that of data[:k])."""
        get, fit = self.ranks.get, self.fit
        for start in range(max(0, end - self.longest), end):
            token = get(data[start:end])
            if token is not None and (start == 0 or fit(last[start], token)):
                return token
        raise ValueError("the vocabulary lacks a byte")

    def table(self, data: bytes) -> list[int]:
        """step() for every prefix, with what it looks up at hand."""
        get, known, fit, size, longest = self.ranks.get, self.beside.get, self.fit, self.size, self.longest
        last = [-1]
        for end in range(1, len(data) + 1):
            for start in range(end - longest if end > longest else 0, end):
                token = get(data[start:end])
                if token is not None:
                    if start == 0:
                        break
                    before = last[start]
                    fits = known(before * size + token)
                    if fits or fits is None and fit(before, token):
                        break
            else:
                raise ValueError("the vocabulary lacks a byte")
            last.append(token)
        return last

    def walk(self, last: list[int]) -> list[int]:
        """The tokens of an encoding, read backwards from its table."""
        out, at = [], len(last) - 1
        while at:
            out.append(last[at])
            at -= len(self.bytes[last[at]])
        return out[::-1]

    def encode(self, data: bytes) -> list[int]:
        """The ids of one piece (no pre-splitting)."""
        whole = self.ranks.get(data)
        return [whole] if whole is not None else self.walk(self.table(data))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


class PrefixTable:
    """A piece's table that grows by appends and is mended after edits."""

    def __init__(self, ranks: Ranks, data: bytes = b""):
        self.ranks, self.data, self.last = ranks, b"", [-1]
        self.steps = 0
        self.append(data)

    def append(self, more: bytes) -> None:
        self.data += more
        for end in range(len(self.last), len(self.data) + 1):
            self.last.append(self.ranks.step(self.data, end, self.last))
            self.steps += 1

    def replace(self, start: int, stop: int, new: bytes) -> None:
        """Put new in place of data[start:stop]; only prefixes near the edit are worked out again.

        A last token looks back over one token's length at most, so once as
        many entries past the edit equal the old ones, all later ones do.
        """
        old, shift = self.last, len(new) - (stop - start)
        self.data = self.data[:start] + new + self.data[stop:]
        self.last = old[: start + 1]
        same = 0
        for end in range(start + 1, len(self.data) + 1):
            if same > self.ranks.longest:
                self.last += old[end - shift :]
                return
            token = self.ranks.step(self.data, end, self.last)
            self.steps += 1
            self.last.append(token)
            same = same + 1 if end - shift > stop and old[end - shift] == token else 0

    def ids(self) -> list[int]:
        return self.ranks.walk(self.last)


@cache
def load_ranks(path: str) -> Ranks:
    with open(path, "rb") as f:
        return Ranks({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})


#: Letters and numbers of the first 256 code points (fixed values of Unicode).
LATIN_LETTERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
LATIN_NUMBERS = "0-9\xb2\xb3\xb9\xbc-\xbe"


def splitter(pattern: str):
    """findall of a pattern; texts of the first 256 code points go through an equal one with plain classes, which is faster."""
    every = regex.compile(pattern).findall
    # \s of both libraries is the same below 256 but for \x1c-\x1f, which only one counts; such texts go the general way.
    plain = re.compile(pattern.replace(r"[^\s\p{L}\p{N}]", rf"[^\s{LATIN_LETTERS}{LATIN_NUMBERS}]").replace(r"\p{L}", f"[{LATIN_LETTERS}]").replace(r"\p{N}", f"[{LATIN_NUMBERS}]"))
    odd = re.compile("[^\x00-\x1b\x20-\xff]").search

    def split(text: str) -> list[str]:
        return every(text) if odd(text) else plain.findall(text)

    return split


class Pieces(dict):
    """Piece of text -> its ids as little-endian unsigned 32-bit bytes.

    When it is full, its entries become the old ones and replace those; an old
    entry that is asked for comes back, so frequent pieces are never lost.
    """

    def __init__(self, encode, most: int = 250_000):
        super().__init__()
        self.encode, self.most, self.old = encode, most, {}

    def __missing__(self, piece: str) -> bytes:
        out = self.old.get(piece)
        if out is None:
            ids = array("I", self.encode(piece))
            if sys.byteorder == "big":
                ids.byteswap()
            out = ids.tobytes()
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[piece] = out
        return out


@cache
def encoder(ranks_path: str, pattern: str):
    """text -> ids as little-endian bytes, kept for the life of a Python worker."""
    encode = load_ranks(ranks_path).encode
    split, pieces = splitter(pattern), Pieces(lambda piece: encode(piece.encode()))
    return lambda text: b"".join(map(pieces.__getitem__, split(text)))


@cache
def decoder(ranks_path: str):
    """ids as little-endian bytes -> the bytes that they stand for. Needs the tokens only, not their merges."""
    with open(ranks_path, "rb") as f:
        ranks = {int(b): base64.b64decode(a) for a, b in map(bytes.split, f)}
    return lambda ids: b"".join(map(ranks.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encode_texts(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", decoded: bool = False) -> DataFrame:
    """docs with token_ids (binary, little-endian unsigned 32-bit) in place of text.

    Every match of pattern is encoded by itself, without special tokens. Null
    and empty texts have no ids. With decoded the ids are decoded in the same
    pass, into a column of that name (binary). Rows stay where they are: no
    shuffle; repeated rows give equal results, and an empty table an empty one.
    Columns named like the new ones are replaced. A text goes whole through one
    task, in slices with as many others as SLICE_BYTES hold.
    """
    new = ["token_ids", "decoded"] if decoded else ["token_ids"]
    rest = others(docs, text, *new)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, decode = encoder(ranks_path, pattern), decoder(ranks_path)
        for b in slices(batches, text, 128):
            ids = [encode(x or "") for x in b.column(text).to_pylist()]
            cols = [pa.array(ids, pa.binary()), *([pa.array(map(decode, ids), pa.binary())] if decoded else [])]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in rest] + cols, names=rest + new)

    return mapped(docs, [*rest, text], run, schema_of(docs, rest, ", ".join(f"{n} binary" for n in new)))


def decode_ids(tokens: DataFrame, ranks_path: str, ids: str = "token_ids") -> DataFrame:
    """tokens with decoded (binary) in place of the ids; null ids decode to nothing."""
    rest = others(tokens, ids, "decoded")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = decoder(ranks_path)
        for b in slices(batches, ids, 128):
            out = [decode(x or b"") for x in b.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in rest] + [pa.array(out, pa.binary())], names=[*rest, "decoded"])

    return mapped(tokens, [*rest, ids], run, schema_of(tokens, rest, "decoded binary"))

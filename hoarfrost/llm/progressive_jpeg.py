"""Media columns: bytes kept losslessly in the coefficients of progressive JPEGs.

A JPEG's samples are lossy, its quantised coefficients are not, so the unit of
storage is the coefficient: one byte of payload is one coefficient, 64 a block,
six blocks (four of luma, two of chroma) an MCU of 16 x 16 pixels.

Writing: the coefficients go out in spectral bands and two approximation steps.
Reading: scans of either kind add up in coefficient arrays, which are
inverse-transformed in numpy; chroma is upsampled and the result is a
full-resolution RGB tensor. The writer's Huffman codes are chosen so that code
and magnitude bits of any symbol have the same length together; the reader sees
that in a table and then reads a whole scan at once. Other tables, zero runs and
restarts are read symbol by symbol.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import mapped, others, schema_of, slices, utf8

UNIT = 192
#: Bytes of texts or media that are worked on together.
MEDIA_BYTES = 2 << 20
MCU_BLOCKS = 6
BANDS = ((1, 5), (6, 63))
#: Natural position (row * 8 + column) of each zigzag index: along the diagonals, up and down in turn.
ZIGZAG = np.array(sorted(range(64), key=lambda p: (p // 8 + p % 8, p % 8 if (p // 8 + p % 8) % 2 == 0 else p // 8)))

_x = np.arange(256, dtype=np.int64) - 128
#: Byte -> coefficient: none is below 2 in magnitude, so none is zero in the first approximation.
VALUE = np.where(_x >= 0, _x + 2, _x - 1)
BYTE = np.zeros(300, np.uint8)
BYTE[VALUE + 150] = np.arange(256)
del _x


def padded(text: bytes) -> bytes:
    """text with spaces up to a positive multiple of UNIT."""
    return text + b" " * (-len(text) % UNIT if text else UNIT)


def codes(lengths: list[tuple[int, int]]) -> dict[int, tuple[int, int]]:
    """Canonical Huffman codes: (symbol, length) in order of length -> {symbol: (code, length)}."""
    out, code, last = {}, 0, 0
    for symbol, n in lengths:
        code <<= n - last
        out[symbol], last = (code, n), n
        code += 1
    return out


#: Tables of the writer: sizes 8..0 of DC differences in 9 bits each, magnitudes included; sizes 7..1 of coefficients in 8; runs of blocks without news.
DC_TABLE = [(s, 9 - s) for s in range(8, -1, -1)]
AC_TABLE = [(s, 8 - s) for s in range(7, 0, -1)]
RUN_TABLE = [(n << 4, 4) for n in range(15)]


def _word(value: int, table: dict[int, tuple[int, int]]) -> int:
    """Code and magnitude bits of a value."""
    size = abs(value).bit_length()
    return table[size][0] << size | (value if value >= 0 else value + (1 << size) - 1)


_dc, _ac, _run = codes(DC_TABLE), codes(AC_TABLE), codes(RUN_TABLE)
DC_BITS = np.array([[_word(d, _dc) >> (8 - i) & 1 for i in range(9)] for d in range(-130, 131)], np.uint8)
AC_BYTE = np.array([_word(int(np.sign(v)) * (abs(int(v)) >> 1), _ac) for v in VALUE], np.uint8)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 255, marker, len(body) + 2) + body


def _dht(kind: int, table: list[tuple[int, int]]) -> bytes:
    return _segment(0xC4, bytes([kind]) + bytes(sum(n == k for _, n in table) for k in range(1, 17)) + bytes(s for s, _ in table))


_TABLES = _segment(0xDB, bytes([0]) + bytes([1] * 64)), _dht(0x00, DC_TABLE) + _dht(0x10, AC_TABLE) + _dht(0x11, RUN_TABLE)


def _sos(components: list[tuple[int, int]], band: tuple[int, int], high: int, low: int) -> bytes:
    return _segment(0xDA, bytes([len(components)]) + b"".join(bytes(c) for c in components) + bytes([*band, high << 4 | low]))


def _entropy(bits: np.ndarray) -> bytes:
    """Bits as bytes, filled up with ones, with a zero after each 255."""
    fill = -len(bits) % 8
    return np.packbits(np.append(bits, np.ones(fill, np.uint8)) if fill else bits).tobytes().replace(b"\xff", b"\xff\x00")


def _mcu_order(luma: np.ndarray, chroma: list[np.ndarray], wide: int) -> np.ndarray:
    """A value of each block -> (MCU, 6) in the order of an interleaved scan."""
    y = luma.reshape(-1, 2, wide, 2).transpose(0, 2, 1, 3).reshape(-1, 4)
    return np.concatenate([y, chroma[0][:, None], chroma[1][:, None]], axis=1)


def write_jpeg(payload: bytes) -> bytes:
    """payload (a positive multiple of UNIT) as a progressive JPEG with 4:2:0 chroma; the rest of the last MCUs holds spaces."""
    mcus = -(-len(payload) // (64 * MCU_BLOCKS))
    wide = min(mcus, 4095) if mcus > 4095 * 32 else min(mcus, 32)
    high = -(-mcus // wide)
    mcus = wide * high
    data = np.full(mcus * MCU_BLOCKS * 64, 32, np.uint8)
    data[: len(payload)] = np.frombuffer(payload, np.uint8)
    blocks = data.reshape(-1, 64)
    parts = blocks[: 4 * mcus], blocks[4 * mcus : 5 * mcus], blocks[5 * mcus :]
    out = [b"\xff\xd8", _segment(0xFE, b"payload %d" % len(payload)), _TABLES[0]]
    out += [_segment(0xC2, struct.pack(">BHHB", 8, 16 * high, 16 * wide, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])), _TABLES[1]]
    dc = [VALUE[p[:, 0]] for p in parts]
    first = _mcu_order(dc[0] >> 1, [dc[1] >> 1, dc[2] >> 1], wide)
    luma = np.diff(first[:, :4].ravel(), prepend=0).reshape(-1, 4)
    diffs = np.concatenate([luma, np.diff(first[:, 4:], axis=0, prepend=0)], axis=1)
    out += [_sos([(1, 0), (2, 0), (3, 0)], (0, 0), 0, 1), _entropy(DC_BITS[diffs.ravel() + 130].ravel())]
    for band in BANDS:
        for c, p in enumerate(parts, 1):
            out += [_sos([(c, 0)], band, 0, 1), AC_BYTE[p[:, band[0] : band[1] + 1]].tobytes().replace(b"\xff", b"\xff\x00")]
    out += [_sos([(1, 0), (2, 0), (3, 0)], (0, 0), 1, 0), _entropy((_mcu_order(dc[0], dc[1:], wide) & 1).astype(np.uint8).ravel())]
    for band in BANDS:
        for c, p in enumerate(parts, 1):
            bits, left, at = [], len(p), 0
            news = (VALUE_ODD[p[:, band[0] : band[1] + 1]]).reshape(len(p), -1)
            while left:
                n = min(left.bit_length() - 1, 14)
                run = min(left, (2 << n) - 1)
                head = _run[n << 4][0] << n | (run - (1 << n))
                bits += [np.array([head >> i & 1 for i in range(3 + n, -1, -1)], np.uint8), news[at : at + run].ravel()]
                left, at = left - run, at + run
            out += [_sos([(c, 1)], band, 1, 0), _entropy(np.concatenate(bits))]
    return b"".join([*out, b"\xff\xd9"])


VALUE_ODD = (np.abs(VALUE) & 1).astype(np.uint8)


class Table:
    """A Huffman table as a reader needs it."""

    def __init__(self, counts: bytes, symbols: bytes):
        lengths = [n for n in range(1, 17) for _ in range(counts[n - 1])]
        self.codes = {(n, code): s for s, (code, n) in codes(list(zip(symbols, lengths))).items()}
        widths = {n + (s & 15) for s, n in zip(symbols, lengths)}
        self.width = widths.pop() if len(widths) == 1 else 0
        self.runs = any(s >> 4 or not s & 15 for s in symbols)
        if self.width and self.width <= 16:
            #: Value of every word of code and magnitude bits.
            self.values = np.zeros(1 << self.width, np.int32)
            for s, n in zip(symbols, lengths):
                size = s & 15
                code = next(c for (k, c), t in self.codes.items() if k == n and t == s)
                extra = np.arange(1 << size)
                self.values[(code << size) + extra] = np.where(extra >> max(0, size - 1), extra, extra - (1 << size) + 1) if size else 0


@cache
def _table(counts: bytes, symbols: bytes) -> Table:
    return Table(counts, symbols)


class Bits:
    """Bits of an entropy-coded segment, one after the other."""

    def __init__(self, data: bytes):
        self.bits, self.at = np.unpackbits(np.frombuffer(data, np.uint8)), 0

    def one(self) -> int:
        self.at += 1
        return int(self.bits[self.at - 1]) if self.at <= len(self.bits) else 1

    def take(self, n: int) -> int:
        out = 0
        for _ in range(n):
            out = out << 1 | self.one()
        return out

    def symbol(self, table: Table) -> int:
        code = 0
        for n in range(1, 17):
            code = code << 1 | self.one()
            if (found := table.codes.get((n, code))) is not None:
                return found
        raise ValueError("no such Huffman code")

    def value(self, size: int) -> int:
        x = self.take(size)
        return x if not size or x >> (size - 1) else x - (1 << size) + 1


class Component:
    def __init__(self, ident: int, h: int, v: int, quant: int):
        self.ident, self.h, self.v, self.quant = ident, h, v, quant


class Image:
    """A progressive JPEG's coefficients (zigzag order), added up scan by scan."""

    def __init__(self, data: bytes):
        self.quants: dict[int, np.ndarray] = {}
        self.tables: dict[int, Table] = {}
        self.comment, self.restart = b"", 0
        self.serial = False
        at = 2
        if data[:2] != b"\xff\xd8":
            raise ValueError("not a JPEG")
        while True:
            marker, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
            if marker == 0xD9:
                return
            body, at = data[at + 4 : at + 2 + size], at + 2 + size
            if marker == 0xDB:
                while body:
                    n = 128 if body[0] >> 4 else 64
                    self.quants[body[0] & 15] = np.frombuffer(body[1 : n + 1], ">u2" if n == 128 else np.uint8).astype(np.float64)
                    body = body[n + 1 :]
            elif marker == 0xC4:
                while body:
                    n = sum(body[1:17])
                    self.tables[body[0]] = _table(body[1:17], body[17 : 17 + n])
                    body = body[17 + n :]
            elif marker == 0xC2:
                self._frame(body)
            elif marker in (0xC0, 0xC1, *range(0xC3, 0xD0)) and marker != 0xC8 and marker != 0xCC:
                raise ValueError("not a progressive JPEG")
            elif marker == 0xDD:
                self.restart = int.from_bytes(body, "big")
            elif marker == 0xFE:
                self.comment = body
            elif marker == 0xDA:
                end = _MARKER.search(data, at)
                self._scan(body, data[at : end.start()])
                at = end.start()

    def _frame(self, body: bytes) -> None:
        _, self.height, self.width, n = struct.unpack(">BHHB", body[:6])
        self.components = [Component(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
        self.h, self.v = max(c.h for c in self.components), max(c.v for c in self.components)
        self.wide, self.high = -(-self.width // (8 * self.h)), -(-self.height // (8 * self.v))
        for c in self.components:
            c.cols, c.rows = -(-self.width * c.h // (8 * self.h)), -(-self.height * c.v // (8 * self.v))
            c.blocks = np.zeros((self.high * c.v, self.wide * c.h, 64), np.int32)

    def _scan(self, body: bytes, data: bytes) -> None:
        n = body[0]
        parts = [(next(c for c in self.components if c.ident == body[1 + 2 * i]), body[2 + 2 * i]) for i in range(n)]
        first, last, high, low = body[1 + 2 * n], body[2 + 2 * n], body[3 + 2 * n] >> 4, body[3 + 2 * n] & 15
        if not self.restart:
            data = data.replace(b"\xff\x00", b"\xff")
            if not self.serial and self._at_once(parts, first, last, high, low, data):
                return
            pieces = [data]
        else:
            pieces = [x.replace(b"\xff\x00", b"\xff") for x in re.split(rb"\xff[\xd0-\xd7]", data)]
        self._one_by_one(parts, first, last, high, low, pieces)

    def _interleaved(self, c: Component) -> np.ndarray:
        """Row and column numbers of a component's blocks in MCU order: (MCU, h * v) flat block numbers."""
        at = np.arange(c.blocks.shape[0] * c.blocks.shape[1]).reshape(self.high, c.v, self.wide, c.h)
        return at.transpose(0, 2, 1, 3).reshape(self.high * self.wide, -1)

    def _order(self, parts) -> list[np.ndarray]:
        if len(parts) > 1:
            return [self._interleaved(c) for c, _ in parts]
        c = parts[0][0]
        return [(np.arange(c.rows)[:, None] * c.blocks.shape[1] + np.arange(c.cols)).reshape(-1, 1)]

    def _at_once(self, parts, first: int, last: int, high: int, low: int, data: bytes) -> bool:
        """Read a whole scan at once, if its form allows it."""
        raw = np.frombuffer(data, np.uint8)
        if first == 0:
            order = self._order(parts)
            per = [o.shape[1] for o in order]
            n = order[0].shape[0] * sum(per)
            if high:
                values = np.unpackbits(raw, count=n).astype(np.int32).reshape(-1, sum(per))
            else:
                tables = {self.tables[t >> 4] for _, t in parts}
                table = tables.pop()
                if tables or not table.width or table.width > 16:
                    return False
                words = np.unpackbits(raw, count=n * table.width).reshape(n, -1) @ (1 << np.arange(table.width - 1, -1, -1))
                values = table.values[words].reshape(-1, sum(per))
            at = 0
            for (c, _), o, k in zip(parts, order, per):
                flat, own = c.blocks.reshape(-1, 64), values[:, at : at + k].ravel()
                if high:
                    flat[o.ravel(), 0] |= own << low
                else:
                    flat[o.ravel(), 0] = np.cumsum(own) << low
                at += k
            return True
        c, t = parts[0]
        table = self.tables[16 + (t & 15)]
        band = c.blocks[: c.rows, : c.cols, first : last + 1]
        if not high:
            if table.width != 8 or table.runs:
                return False
            band[...] = table.values[raw[: band.size]].reshape(band.shape) * (1 << low)
            return True
        bits = Bits(data[:8])
        s = bits.symbol(table)
        if s & 15 or s >> 4 == 15 or (1 << (s >> 4)) + bits.take(s >> 4) < c.rows * c.cols:
            return False
        known = band != 0
        news = np.unpackbits(raw, count=bits.at + int(known.sum()))[bits.at :].astype(np.int32) << low
        old = band[known]
        band[known] = np.where(old > 0, old + news, old - news)
        return True

    def _one_by_one(self, parts, first: int, last: int, high: int, low: int, pieces: list[bytes]) -> None:
        orders = self._order(parts)
        units = len(orders[0])
        each = self.restart or units
        for k, piece in enumerate(pieces):
            bits, before, run = Bits(piece), [0] * len(parts), 0
            for unit in range(k * each, min(units, (k + 1) * each)):
                for i, ((c, t), order) in enumerate(zip(parts, orders)):
                    flat = c.blocks.reshape(-1, 64)
                    for b in order[unit].tolist():
                        if first == 0 and high:
                            flat[b, 0] |= bits.one() << low
                        elif first == 0:
                            before[i] += bits.value(bits.symbol(self.tables[t >> 4]))
                            flat[b, 0] = before[i] << low
                        else:
                            step = self._refine_band if high else self._first_band
                            run = step(flat[b], self.tables[16 + (t & 15)], first, last, low, bits, run)

    @staticmethod
    def _first_band(block: np.ndarray, table: Table, at: int, last: int, low: int, bits: Bits, run: int) -> int:
        if run:
            return run - 1
        while at <= last:
            s = bits.symbol(table)
            zeros, size = s >> 4, s & 15
            if size:
                at += zeros
                block[at] = bits.value(size) * (1 << low)
                at += 1
            elif zeros == 15:
                at += 16
            else:
                return (1 << zeros) + bits.take(zeros) - 1
        return 0

    @staticmethod
    def _refine_band(block: np.ndarray, table: Table, at: int, last: int, low: int, bits: Bits, run: int) -> int:
        def correct(k: int) -> None:
            if bits.one():
                block[k] += (1 << low) if block[k] > 0 else -(1 << low)

        if not run:
            while at <= last:
                s = bits.symbol(table)
                zeros, size = s >> 4, s & 15
                if not size and zeros < 15:
                    run = (1 << zeros) + bits.take(zeros)
                    break
                new = (1 if bits.one() else -1) * (1 << low) if size else 0
                while at <= last:
                    if block[at]:
                        correct(at)
                    elif zeros == 0:
                        if size:
                            block[at] = new
                        at += 1
                        break
                    else:
                        zeros -= 1
                    at += 1
            if not run:
                return 0
        for k in range(at, last + 1):
            if block[k]:
                correct(k)
        return run - 1

    def payload(self) -> bytes:
        """What write_jpeg stored: the bytes of the coefficients, block by block."""
        n = int(self.comment.split()[-1])
        flat = np.concatenate([c.blocks.reshape(-1) for c in self.components])[:n]
        return BYTE[flat + 150].tobytes()

    def _plane(self, c: Component, first: int, last: int) -> np.ndarray:
        """Samples of a component's rows of blocks, brought to full resolution."""
        blocks = c.blocks[first:last]
        rows, cols = blocks.shape[:2]
        x = (blocks.reshape(-1, 64) * self.quants[c.quant]) @ TRANSFORM
        x = np.clip(np.floor((x + 4096) / 8192) + 128, 0, 255).astype(np.int32)
        plane = x.reshape(rows, cols, 8, 8).transpose(0, 2, 1, 3).reshape(rows * 8, cols * 8)
        return np.repeat(np.repeat(plane, self.v // c.v, axis=0), self.h // c.h, axis=1)

    def rgb(self) -> np.ndarray:
        """Height x width x 3, uint8. The transform is exact in integers (held in doubles), so equal images give equal bytes; strips of some rows are transformed at a time."""
        out = np.empty((self.height, self.width, 3), np.uint8)
        step = 8 * self.v
        n = max(1, STRIP_PIXELS // (step * max(1, self.width)))
        for r in range(0, -(-self.height // step), n):
            a, b = r * step, min(self.height, (r + n) * step)
            planes = [self._plane(c, r * c.v, (r + n) * c.v)[: b - a, : self.width] for c in self.components]
            if len(planes) == 1:
                out[a:b] = planes[0][:, :, None]
                continue
            y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
            for k, add in enumerate((91881 * cr, -22554 * cb - 46802 * cr, 116130 * cb)):
                out[a:b, :, k] = np.clip(y + ((add + 32768) >> 16), 0, 255)
        return out


#: Pixels that are transformed together.
STRIP_PIXELS = 1 << 18


_MARKER = re.compile(rb"\xff[^\x00\xd0-\xd7]")


def _transform() -> np.ndarray:
    """Zigzag coefficient x pixel, scaled by 8192 and rounded."""
    k = np.arange(8)
    basis = np.where(k == 0, np.sqrt(0.5), 1)[:, None] / 2 * np.cos((2 * k[None, :] + 1) * k[:, None] * np.pi / 16)
    return np.round(8192 * np.einsum("ux,vy->uvxy", basis, basis).reshape(64, 64)[ZIGZAG])


TRANSFORM = _transform()


def store_media(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with media (binary: a progressive JPEG of the text's padded UTF-8) and n_bytes in place of text; null is empty.

    Equal texts give equal media, repeated rows too, and an empty table gives
    an empty result. Columns named like the new ones are replaced. Texts go
    through in slices of some megabytes, longer ones alone. No shuffle.
    """
    rest = others(docs, text, "media", "n_bytes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text, 128, MEDIA_BYTES):
            texts = utf8(b, text)
            yield pa.RecordBatch.from_arrays(
                [b.column(c) for c in rest] + [pa.array([write_jpeg(padded(t)) for t in texts], pa.binary()), pa.array(map(len, texts), pa.int64())], names=[*rest, "media", "n_bytes"],
            )

    return mapped(docs, [*rest, text], run, schema_of(docs, rest, "media binary, n_bytes long"))


def read_media(media: DataFrame, column: str = "media") -> DataFrame:
    """media with payload (binary), height, width and rgb (binary: the height x width x 3 tensor, row by row) added; null media gives nulls.

    Equal media give equal rows; an empty table gives an empty result. Columns
    named like the new ones are replaced. A tensor is twice its payload, so a
    payload of over 1 GB would pass the 2 GB that a cell can hold, in Spark as
    elsewhere; such texts must be cut first.
    """
    new = ["payload", "height", "width", "rgb"]
    rest = others(media, *new)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, column, 128, MEDIA_BYTES):
            images = [None if x is None else Image(x) for x in b.column(column).to_pylist()]
            cols = [[None if i is None else f(i) for i in images] for f in (Image.payload, lambda i: i.height, lambda i: i.width, lambda i: i.rgb().tobytes())]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in rest] + [pa.array(c, t) for c, t in zip(cols, (pa.binary(), pa.int32(), pa.int32(), pa.binary()))], names=rest + new)

    return mapped(media, rest, run, schema_of(media, rest, "payload binary, height int, width int, rgb binary"))

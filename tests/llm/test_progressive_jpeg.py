import random
import zlib

import numpy as np
import pytest

from hoarfrost.llm import progressive_jpeg as pj


@pytest.mark.parametrize("n", [0, 1, 191, 192, 193, 1000, 40_000, 192 * 2048 + 5])
def test_round_trip(n):
    data = pj.padded(random.Random(n).randbytes(n))
    assert len(data) % 192 == 0 and data
    jpeg = pj.write_jpeg(data)
    image = pj.Image(jpeg)
    assert image.payload() == data
    assert image.rgb().shape == (image.height, image.width, 3)


def test_serial_reader_agrees(monkeypatch):
    data = pj.padded(random.Random(3).randbytes(5000))
    fast = pj.Image(pj.write_jpeg(data))
    monkeypatch.setattr(pj.Image, "_at_once", lambda *a: False)
    slow = pj.Image(pj.write_jpeg(data))
    for a, b in zip(fast.components, slow.components):
        assert (a.blocks == b.blocks).all()


def test_zero_runs_and_new_coefficients():
    """A sparse grey image by hand: a zero run, runs of empty blocks, and a refinement that adds coefficients."""
    table = [(0x00, 2), (0x01, 2), (0x11, 3), (0x10, 3), (0xF0, 4), (0x21, 4)]
    c = pj.codes(table)
    word = lambda s: [int(x) for x in format(c[s][0], "0%db" % c[s][1])]
    dc = pj.codes([(0, 1), (1, 2)])
    dcw = lambda s: [int(x) for x in format(dc[s][0], "0%db" % dc[s][1])]
    seg = lambda bits: pj._entropy(np.array(bits, np.uint8))
    frame = pj._segment(0xC2, b"\x08\x00\x08\x00\x18\x01\x01\x11\x00")
    head = b"\xff\xd8" + pj._TABLES[0] + frame + pj._dht(0x00, [(0, 1), (1, 2)]) + pj._dht(0x10, table)
    scan = pj._sos([(1, 0)], (0, 0), 0, 0) + seg([*dcw(1), 1, *dcw(0), *dcw(1), 0])  # DC 1, 1, 0
    # Block 0: 16 zeros, one zero, 1 (at 18), end; blocks 1 and 2: nothing. Low bit follows.
    scan += pj._sos([(1, 0)], (1, 63), 0, 1) + seg([*word(0xF0), *word(0x11), 1, *word(0x00), *word(0x10), 0])
    # Refinement: block 0: one zero, then new -1 at 2; end of band, correcting 18. Block 1: new 1 at 3; both last ones end.
    scan += pj._sos([(1, 0)], (1, 63), 1, 0) + seg([*word(0x11), 0, *word(0x00), 1, *word(0x21), 1, *word(0x10), 0])
    blocks = pj.Image(head + scan + b"\xff\xd9").components[0].blocks[0]
    want = np.zeros((3, 64), int)
    want[:, 0] = [1, 1, 0]
    want[0, 2], want[0, 18], want[1, 3] = -1, 3, 1
    assert (blocks == want).all()


def test_inverse_transform():
    image = pj.Image(pj.write_jpeg(pj.padded(b"some text " * 100)))
    c = image.components[0]
    k = np.arange(8)
    basis = np.where(k == 0, np.sqrt(0.5), 1)[:, None] / 2 * np.cos((2 * k[None, :] + 1) * k[:, None] * np.pi / 16)
    natural = np.zeros(64)
    natural[pj.ZIGZAG] = c.blocks[0, 0]
    exact = np.clip(basis.T @ natural.reshape(8, 8) @ basis + 128, 0, 255)
    y = c.blocks[0, 0] @ pj.TRANSFORM
    assert np.abs(np.clip(np.floor((y + 4096) / 8192) + 128, 0, 255).reshape(8, 8) - exact).max() <= 1
    assert pj.ZIGZAG[:6].tolist() == [0, 1, 8, 16, 9, 2] and sorted(pj.ZIGZAG) == list(range(64))


def test_frame(spark):
    rows = [(1, None, 3), (None, "", 4), (2, "é" * 3000, 5), (2, "é" * 3000, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, height int")
    got = pj.read_media(pj.store_media(docs)).collect()
    assert len(got) == 4
    for r in got:
        text = {0: "", 6000: "é" * 3000}[r.n_bytes].encode()
        assert bytes(r.payload) == pj.padded(text) and zlib.crc32(r.media) and len(r.rgb) == r.height * r.width * 3
    assert pj.store_media(docs.limit(0)).count() == 0

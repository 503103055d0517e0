import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from hoarfrost.llm import packing

PATH = P.path("byte_bpe_50k.json")


def optimum(lengths, size):
    """Fewest bins, by trying every way."""
    best = [len(lengths)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + lengths[i] <= size:
                bins[k] += lengths[i]
                go(i + 1, bins)
                bins[k] -= lengths[i]
        go(i + 1, [*bins, lengths[i]])

    go(0, [])
    return best[0]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=8))
def test_bound_and_best_fit(lengths):
    best = optimum(sorted(lengths, reverse=True), 20)
    assert packing.lower_bound(np.array(lengths, int), 20) <= best
    bins, offsets, room = packing.best_fit(lengths, 20)
    assert len(room) >= best
    fill = defaultdict(list)
    for n, b, o in zip(lengths, bins, offsets):
        fill[b].append((o, n))
    for b, items in fill.items():
        at = 0
        for o, n in sorted(items):
            assert o == at
            at += n
        assert at + room[b] == 20


def test_bound_beats_the_sum():
    assert packing.lower_bound(np.array([11] * 10), 20) == 10
    assert packing.lower_bound(np.array([7, 7, 7, 7, 7, 7]), 20) == 3


def check(rows, size):
    fill = defaultdict(list)
    for r in rows:
        fill[r.sequence_id].append((r.offset, r.length))
    for items in fill.values():
        at = 0
        for o, n in sorted(items):
            assert o == at
            at += n
        assert at <= size
    return len(fill)


def test_repacking(spark, monkeypatch):
    monkeypatch.setattr(packing, "PARTITION_PIECES", 40)
    rng = random.Random(7)
    lengths = [rng.randrange(1, 100) for _ in range(900)]
    df = spark.createDataFrame([(i % 50, n) for i, n in enumerate(lengths)], "doc_id long, length long")
    rows = packing.pack(df, 100).collect()
    assert sorted((r.doc_id, r.length) for r in rows) == sorted((i % 50, n) for i, n in enumerate(lengths))
    once = packing.pack(df, 100, rounds=0).collect()
    assert packing.lower_bound(np.array(lengths), 100) <= check(rows, 100) <= check(once, 100)


def test_part_filled_bins_of_many_partitions(spark, monkeypatch):
    """Partitions that meet their own bounds still share their last bins."""
    monkeypatch.setattr(packing, "PARTITION_PIECES", 50)
    rng = random.Random(3)
    lengths = [rng.choice([1, 2, 3, 5, 8, 13, 21, 34, 55]) for _ in range(3000)]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "doc_id long, length long")
    assert check(packing.pack(df, 100, rounds=0).collect(), 100) > -(-sum(lengths) // 100) + 5
    assert check(packing.pack(df, 100).collect(), 100) <= -(-sum(lengths) // 100) + 4


def test_frame(spark):
    rng = random.Random(2)
    long = " ".join(rng.choice(["the", "café", "zx", "12", "'s"]) for _ in range(5000))
    texts = [(1, None), (2, ""), (2, ""), (None, "Some words"), (4, long), (5, "a b" * 200), (6, "hello <|endoftext|> world")]
    docs = spark.createDataFrame([(i, t, 0) for i, t in texts], "doc_id long, text string, offset int")
    pieces = packing.token_pieces(docs, PATH, P.PATTERN, 2048)
    assert "offset" in pieces.columns
    rows = packing.pack(pieces, 2048).collect()
    check(rows, 2048)
    t = Tokenizer.from_file(PATH)
    want = []
    for i, x in texts:
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 0]
        cuts = [0, *range(len(ids) % 2048 or 2048, len(ids), 2048), len(ids)]
        want += [(i or 0, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted((r.doc_id or 0, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    assert packing.pack(pieces.limit(0), 2048).count() == 0
    odd = spark.createDataFrame([(1, None), (2, 0), (3, 9), (4, 3)], "doc_id long, length long")
    assert {r.doc_id: r.offset for r in packing.pack(odd, 8).collect()} == {1: None, 2: None, 3: None, 4: 0}


BITS = st.one_of(st.sampled_from([*"theanding 's\n\té\x00<|>", "<|endoftext|>", " <|endoftext|>", "<|endoftext"]), st.characters(codec="utf-8"))


@settings(max_examples=300, deadline=None)
@given(st.lists(BITS, max_size=60).map("".join))
def test_ids_equal_the_tokenizer(text):
    t = test_ids_equal_the_tokenizer.t = getattr(test_ids_equal_the_tokenizer, "t", None) or Tokenizer.from_file(PATH)
    assert np.frombuffer(packing.encoder(PATH, P.PATTERN)(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids

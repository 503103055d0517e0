import random
from itertools import combinations

import numpy as np

from hoarfrost.llm import common, near_copies, simhash


def brute_set(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def similarity(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def brute_kept(rows):
    """ids of the smallest documents of the components of all pairs of similarity 0.8 or more."""
    sets = {i: brute_set(t) for i, t in rows}
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(sorted(sets), 2):
        if similarity(sets[a], sets[b]) >= 0.8:
            x, y = top(a), top(b)
            root[max(x, y)] = min(x, y)
    return sorted(i for i in root if root[i] == i)


def edited(rng, base, edits):
    out = list(base)
    for k in range(edits):
        out[rng.randrange(len(out))] = f"x{rng.randrange(10**9)}"
    return " ".join(out)


def test_recall_of_bands():
    """Pairs just over the least similarity against the derived share that has a band in common."""
    rng = random.Random(5)
    over, met, far = 0, 0, 0
    while over < 400:
        base = [f"w{rng.randrange(5000)}" for _ in range(200)]
        a, b = " ".join(base), edited(rng, base, rng.choice([3, 4]))
        s = similarity(brute_set(a), brute_set(b))
        if 0.8 <= s < 0.9:
            over += 1
            met += bool(set(near_copies.bands(near_copies.shingles(a.encode()))) & set(near_copies.bands(near_copies.shingles(b.encode()))))
            far += bin(simhash.simhash(a.encode()) ^ simhash.simhash(b.encode())).count("1") > 3
        assert all(near_copies.alike(near_copies.shingles(a.encode()), near_copies.shingles(b.encode()), p) == (100 * s >= p) for p in range(70, 100))
    assert met / over >= 0.99 and 1 - (1 - 0.8**near_copies.ROWS) ** near_copies.BANDS > 0.997
    assert far / over > 0.5  # what three bits of 64 would miss


def test_near_copies_go(spark):
    """Groups at all similarities, short copies, a large group, and passages in common, against all pairs."""
    rng = random.Random(6)
    rows = []
    for g in range(60):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([30, 100, 300]))]
        rows += [edited(rng, base, rng.choice([0, 1, 2, 4, 8])) for _ in range(4)]
    base = [f"w{rng.randrange(3000)}" for _ in range(400)]
    rows += [edited(rng, base, rng.choice([1, 6, 14])) for _ in range(80)]
    rows += [" ".join(base[:200]) + " " + " ".join(f"v{rng.randrange(9000)}" for _ in range(80)) for _ in range(60)]
    rows += ["", " ", "one two", "One  two", "one"]
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(r.doc_id for r in simhash.one_of_each(docs).collect())
    want = brute_kept(rows)
    assert len(want) < len(rows) - 60
    assert set(got) >= set(want) and len(got) <= len(want) + 2  # no pair under the least similarity; a missed one may stay


def test_forest_against_all_pairs():
    rng = random.Random(12)
    for both in (False, True):
        base = [rng.randrange(1 << 63) for _ in range(60)]
        sets = [np.unique(np.array(rng.sample(base, rng.choice([50, 55, 60])) + [rng.randrange(1 << 63) for _ in range(rng.choice([0, 2, 20]))], np.uint64)) for _ in range(80)]
        root = np.array([rng.choice([0, i]) for i in range(80)])
        side = np.array([rng.randrange(2) if both else 0 for _ in range(80)])
        links = near_copies.forest_of(sets, root, 0, side, 80)
        assert all(near_copies.alike(sets[i], sets[j], 80) and (not both or side[i] != side[j]) for i, j in links)

        def parts(pairs):
            label = root.tolist()
            for i, j in pairs:
                label = [label[i] if x == label[j] else x for x in label]
            return {tuple(k for k, x in enumerate(label) if x == v) for v in set(label)}

        every = [(i, j) for i, j in combinations(range(80), 2) if near_copies.alike(sets[i], sets[j], 80) and (not both or side[i] != side[j])]
        assert parts(links) == parts(every) and len(links) < len(every)


def test_large_bands_in_blocks(spark, monkeypatch):
    rng = random.Random(13)
    base = [f"w{rng.randrange(3000)}" for _ in range(200)]
    rows = list(enumerate(edited(rng, base, rng.choice([1, 3, 5, 8])) for _ in range(120)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_kept(rows)
    monkeypatch.setattr(near_copies, "BLOCK_ROWS", 7)
    got = sorted(r.doc_id for r in simhash.one_of_each(docs).collect())
    assert set(got) >= set(want) and len(got) <= len(want) + 2 and 10 < len(want) < 110


def test_each_set_of_a_large_family_moves_once(spark):
    """Few outsiders: a task gets all of them and a block of the others, whose sets aren't sent to each other; links as by all pairs."""
    rng = random.Random(14)
    shared = list(range(1000, 1060))
    words = {k: np.unique(np.array(shared + [k], np.uint64)) for k in range(200)} | {200 + k: np.unique(np.array([*shared[:55], 5000 + k], np.uint64)) for k in range(5)}
    sets = spark.createDataFrame([(k, bytearray(w.astype("<u8").tobytes())) for k, w in words.items()], "node long, words binary")
    left = spark.createDataFrame([(k, 0 if k < 200 else k, 0) for k in words], "node long, root long, main long")
    near_copies_rows, near_copies.BLOCK_ROWS = near_copies.BLOCK_ROWS, 16
    seen = []
    try:
        kept = near_copies._compared
        near_copies._compared = lambda percent: lambda t: __import__("pyarrow").table([t.column("node"), t.column("side").cast("int64")], names=["a", "b"])
        seen = [r.a for r in near_copies.compared(left, sets, 80).groupBy("a", "b").count().collect()]
        near_copies._compared = kept
        links = near_copies.compared(left, sets, 80).collect()
    finally:
        near_copies.BLOCK_ROWS, near_copies._compared = near_copies_rows, kept
    assert sorted(k for k in seen if k < 200) == list(range(200))
    roots = list(range(205))
    for r in links:
        a, b = (0 if r.a < 200 else r.a), (0 if r.b < 200 else r.b)
        roots = [roots[a] if x == roots[b] else x for x in roots]
    assert len({roots[0 if k < 200 else k] for k in words}) == 1


def test_long_texts_in_blocks(monkeypatch):
    rng = random.Random(15)
    text = " ".join("W%d" % rng.randrange(50) for _ in range(3000)).encode()
    for width in (1, 3, 5):
        want = near_copies.shingle_hashes(text, width)
        for size in (1, 10, 5000):
            monkeypatch.setattr(near_copies, "word_blocks", lambda t, size=size: common.word_blocks(t, size))
            assert (near_copies.shingle_hashes(text, width) == want).all()
            assert len(near_copies.shingle_hashes(b" a\n", width)) == 1 and not len(near_copies.shingle_hashes(b" \n \n", width))
    assert b"".join(common.word_blocks(text, 77)) == text

import random

import numpy as np
import xxhash

from hoarfrost.llm import components, simhash


def brute_fp(text):
    words = text.lower().encode() if text.isascii() else "".join(c.lower() if c < "\x80" else c for c in text).encode()
    words = words.split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hs) > len(hs))


def brute_components(fps):
    """ids -> smallest id reachable; fps: {id: fp}."""
    ids = sorted(fps)
    root = {i: i for i in ids}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for x in ids:
        for y in ids:
            if x < y and bin(fps[x] ^ fps[y]).count("1") <= 3:
                a, b = top(x), top(y)
                root[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}


def test_fingerprint():
    rng = random.Random(1)
    for n in [0, 1, 2, 3, 4, 7, 60, 3000]:
        text = " ".join(rng.choice(["The", "É", "ab", "Cat\t", "\n"]) + str(rng.randrange(40)) for _ in range(n))
        assert simhash.simhash(text.encode()) == brute_fp(text)


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(300)] + [(i, i + 1) for i in range(1000, 1300)] + [(5000, i) for i in range(5001, 5200)] + [(7, 7)]
    root = {}
    for a, b in links:
        if a != b:
            root.setdefault(a, a), root.setdefault(b, b)
    change = True
    while change:
        change = False
        for a, b in links:
            if a != b and root[a] != root[b]:
                root[a] = root[b] = min(root[a], root[b])
                change = True
    got = {r.node: r.root for r in components.connected(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == root
    assert components.connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_close_links_with_splitting(spark):
    """A dense ball of over BUCKET fingerprints in the same blocks, and random ones, against all pairs."""
    rng = random.Random(4)
    ball = {0xABCD000000000000 ^ (1 << a) ^ (1 << b) ^ (1 << c) for a in range(38) for b in range(a) for c in range(b)}
    ball = sorted(ball)[:5200]
    far = [rng.getrandbits(64) for _ in range(200)]
    far += [f ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for f in far[:100]]
    every = np.array(ball + far, np.uint64)
    df = spark.createDataFrame([(int(x),) for x in every.view(np.int64)], "fp long").distinct()
    links = simhash.close_links(df).collect()
    a = np.array([r.a for r in links], np.int64).view(np.uint64)
    b = np.array([r.b for r in links], np.int64).view(np.uint64)
    assert (np.bitwise_count(a ^ b) <= 3).all()
    # Components of the links equal components of all close pairs.
    index = {int(x): i for i, x in enumerate(np.unique(every))}
    u = np.unique(every)

    def label(pairs):
        lab = np.arange(len(u))
        changed = True
        while changed:
            changed = False
            for i, j in pairs:
                m = min(lab[i], lab[j])
                if lab[i] != m or lab[j] != m:
                    lab[lab == lab[i]] = m
                    lab[lab == lab[j]] = m
                    changed = True
        return lab.tolist()

    pairs = []
    for i in range(len(u)):
        pairs += [(i, int(j)) for j in np.flatnonzero(np.bitwise_count(u[i + 1 :] ^ u[i]) <= 3)[:40] + i + 1] if i >= 0 else []
    got = label([(index[int(x)], index[int(y)]) for x, y in zip(a, b)])
    parts = lambda lab: {tuple(k for k, v in enumerate(lab) if v == r) for r in set(lab) if lab.count(r) > 1}
    sparse = label(pairs)
    assert parts(got) >= {p for p in parts(sparse) if len(p) < 10} or parts(got) == parts(sparse)


def test_frame(spark):
    rng = random.Random(9)
    words = ["w%d" % i for i in range(300)]
    base = [rng.choice(words) for _ in range(400)]
    rows = [(10, None), (3, ""), (None, " \n"), (7, "Solo"), (8, "solo"), (8, "solo"), (20, " ".join(base)), (21, " ".join(base).upper())]
    for k in range(30):
        edit = list(base)
        edit[rng.randrange(400)] = "x%d" % k
        rows.append((100 + k, " ".join(edit)))
    rows += [(200 + k, " ".join(rng.choice(words) for _ in range(50))) for k in range(40)]
    docs = spark.createDataFrame([(i, t, "e") for i, t in rows], "doc_id long, text string, fp string")
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    fps = {}
    for i, t in rows:
        if i is not None:
            fps[i] = brute_fp(t or "")
    want = brute_components(fps)
    assert all(r.component_id == want[r.doc_id] for r in got if r.doc_id is not None)
    assert [r.component_id for r in got if r.doc_id is None] == [3]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    assert docs.sparkSession.range(1).select(simhash.hex_fingerprint(simhash.F.lit(255).cast("long"))).first()[0] == "00000000000000ff"

"""Signatures against their definition, and components of whole tables against all pairs."""

import random
import re
from itertools import combinations

import numpy as np

from hoarfrost.llm import circulant_minhash, near_copies

from .test_near_copies import edited, similarity

CLASHES = ["id", "key", "row", "n", "h", "g", "bands", "node", "fp", "least", "first", "component", "root", "a.b", "tick`s"]


def brute_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows, percent=85):
    """(size, smallest id reachable) of each row."""
    sets = [brute_set(t) for _, t in rows]
    label = list(range(len(rows)))
    by = {}
    for k, s in enumerate(sets):
        by.setdefault(frozenset(s), []).append(k)
    same = [(ks[0], k) for s, ks in by.items() if s for k in ks[1:]]
    near = [(by[x][0], by[y][0]) for x, y in combinations([s for s in by if s], 2) if 100 * len(x & y) >= percent * len(x | y)]
    for i, j in same + near:
        label = [label[i] if x == label[j] else x for x in label]
    ids = {}
    for k, x in enumerate(label):
        ids.setdefault(x, []).extend([] if rows[k][0] is None else [rows[k][0]])
    return [(len(s), min(ids[x], default=None) if s else i) for (i, _), s, x in zip(rows, sets, label)]


def test_signature_is_what_two_permutations_give():
    rng = np.random.default_rng(2)
    first, shifted = circulant_minhash.permutations()
    second = shifted[:, 0]
    assert sorted(first.tolist()) == sorted(second.tolist()) == list(range(circulant_minhash.PLACES))
    found = np.unique(rng.integers(0, 1 << 63, 5000).astype(np.uint64))
    got = circulant_minhash.signature(found)
    for k in (0, 1, 57, len(got) - 1):
        assert got[k] == second[(first[found % circulant_minhash.PLACES] + k) % circulant_minhash.PLACES].min()


def test_signature_tells_similarity_and_bands_meet():
    rng = random.Random(5)
    over, met, gaps = 0, 0, []
    while over < 400:
        base = [f"w{rng.randrange(5000)}" for _ in range(300)]
        a, b = " ".join(base), edited(rng, base, rng.choice([2, 3, 4]))
        s = similarity(brute_set(a), brute_set(b))
        x, y = (near_copies.shingles(t.encode()) for t in (a, b))
        gaps.append((circulant_minhash.signature(x) == circulant_minhash.signature(y)).mean() - s)
        if s >= 0.85:
            over += 1
            met += bool(set(circulant_minhash.bands(x)) & set(circulant_minhash.bands(y)))
    assert met == over and abs(np.mean(gaps)) < 0.01 and np.std(gaps) < 0.05
    assert 1 - (1 - 0.85**circulant_minhash.ROWS) ** circulant_minhash.BANDS > 0.999999


def test_components(spark):
    """Groups at all similarities, a large family with some outsiders, copies, short texts, repeated rows, nulls, clashing names."""
    rng = random.Random(6)
    texts = []
    for _ in range(50):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([8, 30, 100, 300]))]
        texts += [edited(rng, base, rng.choice([0, 1, 2, 4])) for _ in range(4)]
    base = [f"w{rng.randrange(3000)}" for _ in range(400)]
    texts += [edited(rng, base, rng.choice([1, 3, 6, 9])) for _ in range(80)] + [" ".join(base)] * 40
    texts += [" ".join(base[:200]) + " " + " ".join(f"v{rng.randrange(9000)}" for _ in range(80)) for _ in range(40)]
    texts += ["", " ", None, "one two", "One  two", "one", "É é", "é é", "x\x1cy z"]
    rng.shuffle(texts)
    rows = [(k + 5, t) for k, t in enumerate(texts)] + [(7, texts[2])] * 3 + [(None, texts[2]), (None, "only null"), (None, None), (2, texts[3])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).selectExpr("*", *[f"1 AS `{c.replace('`', '``')}`" for c in CLASHES])
    got = circulant_minhash.near_duplicate_sets(docs).collect()
    key = lambda r: tuple((x is None, x) for x in r)
    want = [(i, n, c, i == c) for (i, _), (n, c) in zip(rows, brute(rows))]
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert len({c for _, _, c, _ in want}) < len(rows) - 100
    assert circulant_minhash.near_duplicate_sets(docs.limit(0)).count() == 0

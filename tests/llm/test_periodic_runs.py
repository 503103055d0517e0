"""Runs of words against plain Python: all periods of small texts, levels that end early, chunks, long texts."""

import random

import numpy as np
import pyarrow as pa
import pytest

from hoarfrost.llm import periodic_runs, registry

CLASHES = ["runs_", "n", "a", "p", "g", "words", "a.b", "tick`s", "N_words"]


def brute(words, least=12):
    n, best = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i > start and i + q - start >= max(least, 2 * q):
                best.setdefault((start, i + q), q)
            i += 1
    return sorted((s, e - s, q) for (s, e), q in best.items())


def collapsed(words, runs):
    drop = {j for s, length, q in runs for j in range(s + q, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in drop)


def some_words(rng):
    ws = ["w%d" % rng.randrange(rng.choice([1, 2, 3, 8, 100])) for _ in range(rng.choice([0, 1, 5, 13, 30, 80, 200]))]
    if ws and rng.random() < 0.5:
        a, p = rng.randrange(len(ws)), 1 + rng.randrange(max(1, len(ws) // 3))
        ws = [w if i < a else ws[a + (i - a) % p] for i, w in enumerate(ws)]
    return ws


@pytest.mark.parametrize("levels,chunk", [(11, 1 << 19), (1, 50), (2, 7), (4, 1 << 19)])
def test_runs(monkeypatch, levels, chunk):
    monkeypatch.setattr(periodic_runs, "LEVELS", levels)
    monkeypatch.setattr(periodic_runs, "CHUNK", chunk)
    rng = random.Random(levels)
    for _ in range(250):
        docs, least = [some_words(rng) for _ in range(rng.choice([1, 3, 6]))], rng.choice([12, 12, 2, 5])
        n, runs, kept = periodic_runs._found(pa.array([" ".join(d).encode() for d in docs]), least)
        assert n.to_pylist() == [len(d) for d in docs]
        for d, x, y in zip(docs, runs.to_pylist(), kept.to_pylist()):
            want = brute(d, least)
            assert sorted((r["start"], r["length"], r["period"]) for r in x) == want and y == collapsed(d, want)


def test_names_are_equal_for_equal_windows():
    symbols = np.random.default_rng(1).integers(0, 3, 400)
    symbols[300:] = symbols[:100]
    for k, name in enumerate(periodic_runs.name_levels(symbols)):
        w = 1 << k
        windows = [tuple(symbols[i : i + w]) if i + w <= 400 else i for i in range(400)]
        first = {}
        for i, x in enumerate(windows):
            assert (name[first.setdefault(x, i)] == name[i]) and ((name[i] >= 0) == (windows.count(x) > 1))


def test_long_texts():
    """Millions of words: one word only, a long period, and no period, each in seconds."""
    for words, want in [(["a"] * 1_000_000, [(0, 1_000_000, 1)]), ([f"w{i % 70_001}" for i in range(400_000)], [(0, 400_000, 70_001)]), ([f"w{i}" for i in range(400_000)], [])]:
        _, runs, kept = periodic_runs._found(pa.array([" ".join(words).encode()]), 12)
        assert [tuple(r.values()) for r in runs[0].as_py()] == want and kept[0].as_py() == collapsed(words, want)


def test_rows(spark):
    """Nulls, empty texts, white space, repeated rows, extra columns, an empty table."""
    rng = random.Random(9)
    texts = [None, "", " \n\t", "é\x1cb\x85 " * 13, "a b " * 20, "A a " * 20, "\ta\x0b" * 12, *[" ".join(some_words(rng)) for _ in range(30)]]
    rows = [(i, t) for i, t in enumerate(texts)] + [(4, texts[4])] * 3 + [(None, texts[4])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).selectExpr("*", *[f"{k} AS `{c.replace('`', '``')}`" for k, c in enumerate(CLASHES)])
    out = periodic_runs.find_runs(docs)
    got = out.collect()
    assert len(got) == len(rows) and out.columns == ["doc_id", *[c for c in CLASHES if c != "N_words"], "n_words", "runs", "collapsed"]
    of = dict(rows)
    for r in got:
        words = [w.decode() for w in (of[r.doc_id] or "").encode().split()]
        want = brute(words)
        assert (r.n_words, sorted((x.start, x.length, x.period) for x in r.runs), r.collapsed) == (len(words), want, collapsed(words, want))
    assert periodic_runs.find_runs(docs.limit(0)).count() == 0
    odd = spark.createDataFrame([(10, None), (None, "a b"), (30, ""), (40, "x")], "doc_id long, text string")
    assert registry.replayed(odd).count() == 4

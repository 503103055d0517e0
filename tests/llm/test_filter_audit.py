"""Failure masks and counters of all orders against plain Python."""

import random
import re
from collections import Counter
from itertools import permutations

import pytest

from hoarfrost.llm import filter_audit

CLASHES = ["id", "part", "mask", "n", "fp", "salt", "edge", "least", "a.b", "tick`s"]


def brute_mask(i, text, rows):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    fails = [
        len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), bool(re.search(r"[#$%&*|]", text)),
        i is not None and any(t == text and j is not None and j < i for j, t, _ in rows),
    ]
    return {f for f, x in zip("ABCDE", fails) if x}


def brute(rows, labels):
    good, toxic = {i for i, q, _ in labels if q == 1} - {None}, {i for i, _, t in labels if t == 1} - {None}
    rows = [(i, t or "", p or "") for i, t, p in rows]
    docs = [(i, p, brute_mask(i, t, rows)) for i, t, p in rows]
    out = {}
    for part in {p for _, p, _ in docs}:
        shapley = Counter()
        for order in permutations("ABCDE"):
            left = [(i, m) for i, p, m in docs if p == part]
            for step, f in enumerate(order, 1):
                gone = [(i, m) for i, m in left if f in m]
                left = [(i, m) for i, m in left if f not in m]
                failing = [m for _, p, m in docs if p == part and f in m]
                shapley[f] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), len(failing) - len(gone), sum(m == {f} for m in failing), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)]
        for (p, order, step), x in out.items():
            if p == part:
                x.append(shapley[order[step - 1]])
    return out


def odd_rows():
    rng = random.Random(3)
    text = lambda n, k=300: " ".join("w%d" % rng.randrange(k) for _ in range(n))
    hot, twin = text(70), text(12) + " #1"
    rows = [(i, hot, ["a", "b", None][i % 3]) for i in range(100, 180)] + [(i, twin, "a") for i in range(1, 9)]
    rows += [(500, hot, "z")] * 5 + [(90, hot, "")] * 3 + [(None, hot, "a"), (None, None, None), (3, None, "c"), (2, "", "c"), (700, " \t\n", "c"), (701, "É" * 9 + " AB", "d"), (702, "x\x1cy\x85z " * 60, "d")]
    rows += [(1000 + i, text(rng.choice([20, 60, 90]), rng.choice([15, 80, 5000])) + rng.choice(["", " A|B", " CAPITALS" * 9]), rng.choice("ab")) for i in range(40)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i, _, _ in rows if rng.random() < 0.6] + [(None, 1, 1), (100, 1, 0), (100, 0, 1)]
    return rows, labels


@pytest.mark.parametrize("partitions", [1, 9])
def test_audit(spark, partitions):
    """Groups of copies over many tasks, repeated rows, nulls, clashing names."""
    rows, labels = odd_rows()
    random.Random(4).shuffle(rows)
    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
        docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5).selectExpr("*", *[f"1 AS `{c.replace('`', '``')}`" for c in CLASHES])
        masks = filter_audit.failure_masks(docs)
        texts = [(i, t or "", p or "") for i, t, p in rows]
        want = Counter((i, p, "".join(sorted(brute_mask(i, t, texts)))) for i, t, p in texts)
        got = Counter()
        for r in masks.collect():
            got[r.doc_id, r.part, "".join(f for k, f in enumerate("ABCDE") if r["mask"] >> k & 1)] += r.n
        assert got == want
        out = filter_audit.interaction_audit(masks, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
        assert {(r.part, r.filter_order, r.step): list(r)[3:] for r in out.collect()} == brute(rows, labels)
        assert out.count() == 120 * 5 * len({p for _, _, p in texts})
        none = filter_audit.failure_masks(docs.limit(0))
        assert filter_audit.interaction_audit(none, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0
    finally:
        for k, x in kept.items():
            spark.conf.set(k, x)


def test_long_texts_are_counted_whole():
    text = ("aa bb\tcc " * 200_000 + "last").encode()
    assert filter_audit.word_counts(text) == (600_001, 4)
    assert filter_audit.word_counts(b"x" * (3 << 20)) == (1, 1) and filter_audit.word_counts(b" \n" * (1 << 20)) == (0, 0)
    assert filter_audit.own_failures(text) == 0b0010

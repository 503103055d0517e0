import random

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from hoarfrost.llm import suffix_dedup


def brute(rows, depth=50):
    texts = [(suffix_dedup.NO_ID if i is None else i, (t or "").encode()) for i, t in rows]
    least = {}
    for i, t in texts:
        for k in range(len(t) - depth + 1):
            x = t[k : k + depth]
            least[x] = min(i, least.get(x, i))
    out = []
    for i, t in texts:
        gone = [False] * len(t)
        for k in range(len(t) - depth + 1):
            if least[t[k : k + depth]] < i:
                gone[k : k + depth] = [True] * depth
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(t), sum(gone), spans, bytes(c for c, g in zip(t, gone) if not g)))
    return sorted(out)


def made_rows(seed, n, ids):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["an", "th", "é", "or", "zu", "x"]) for _ in range(rng.randrange(1, 5)))
    text = lambda k: " ".join(word() for _ in range(k))
    shared = [text(k) for k in (8, 12, 20, 60, 9, 10, 11)]
    rows = []
    for i in ids[:n]:
        t = text(rng.randrange(60))
        for _ in range(rng.randrange(4)):
            x = rng.choice(shared)
            a = rng.randrange(len(x) // 2)
            cut = rng.randrange(len(t) + 1)
            t = t[:cut] + x[a : len(x) - rng.randrange(len(x) // 3)] + t[cut:]
        rows.append((i, t))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "k", k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, kept string, g int")


def got(df):
    return sorted((suffix_dedup.NO_ID if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in df.collect())


def test_against_brute_force(spark, monkeypatch):
    rng = random.Random(11)
    ids = list(range(-50, 250))
    rng.shuffle(ids)
    rows = made_rows(1, 260, ids)
    rows += [(1000, "ab" * 400), (1001, "b" + "ab" * 100), (1002, "a" * 300), (1003, "a" * 60), (1004, "a" * 49), (1005, None), (1006, ""), (None, "a" * 80), (None, "q" * 70), (1003, "a" * 60), (1003, rows[0][1] + "tail"), (2000, rows[5][1]), (2001, rows[5][1])]
    want = brute(rows)
    assert any(x[2] for x in want) and any(x[3] > 1 for x in want)
    for group, anchors in ((2000, 40), (1 << 22, 1 << 19)):
        monkeypatch.setattr(suffix_dedup, "GROUP_BYTES", group)
        monkeypatch.setattr(suffix_dedup, "BUCKET_ANCHORS", anchors)
        df = suffix_dedup.remove_repeats(frame(spark, rows))
        assert got(df) == want
        assert df.columns == ["doc_id", "g", "n_bytes", "n_removed", "n_spans", "kept"]


def test_blocks(monkeypatch, spark):
    monkeypatch.setattr(suffix_dedup, "BLOCK", 64)
    rows = made_rows(2, 40, list(range(40)))
    assert got(suffix_dedup.remove_repeats(frame(spark, rows))) == brute(rows)


def test_empty(spark):
    assert suffix_dedup.remove_repeats(frame(spark, [(1, "x")]).limit(0)).count() == 0
    assert got(suffix_dedup.remove_repeats(frame(spark, [(1, None), (2, "")]))) == [(1, 0, 0, 0, b""), (2, 0, 0, 0, b"")]


def test_hot_anchors(spark, monkeypatch):
    """Anchors of many entries go through Spark's grouping; the result is the same."""
    rng = random.Random(3)
    phrase = "and so it was that they went there"  # shorter than a string: every document has it in other company
    rows = made_rows(4, 60, list(range(60)))
    rows += [(100 + i, "%s %s %s" % (rng.randrange(10**9), phrase, rng.randrange(10**9))) for i in range(80)]
    rows += [(300 + i, rows[70][1] + " the same tail for all of these, whatever comes before it") for i in range(30)]
    want = brute(rows)
    for group in (1500, 1 << 22):
        monkeypatch.setattr(suffix_dedup, "GROUP_BYTES", group)
        for hot in (0, 4):
            monkeypatch.setattr(suffix_dedup, "HOT_RUNS", hot)
            assert got(suffix_dedup.remove_repeats(frame(spark, rows))) == want


def in_one_process(rows, groups, buckets, hot):
    """The operator's functions without Spark, so that they can be patched."""
    tables = {}
    for k, (i, t) in enumerate(rows):
        tables.setdefault(k % groups, []).append((i, t, k, k % groups))
    dealt = {g: pa.table(dict(zip(("doc_id", "text", "more", "h", "g"), (*map(list, list(zip(*x))[:2]), [None] * len(x), *map(list, list(zip(*x))[2:]))))) for g, x in tables.items()}
    by = lambda parts, key: {k: pa.concat_tables([p.filter(pa.compute.equal(p.column(key), k)) for p in parts]) for k in {k for p in parts for k in p.column(key).to_pylist()}}
    anchors = by([suffix_dedup._send_anchors(buckets)(t) for t in dealt.values()], "bucket")
    shared = by([suffix_dedup._shared_anchors(hot)(t) for t in anchors.values()], "g")
    strings = [suffix_dedup._send_strings(buckets)(t, shared.get(g, suffix_dedup.REPLY.empty_table())) for g, t in dealt.items()]
    replies = [suffix_dedup._repeated_strings(t) for t in by(strings, "bucket").values()]
    found = [b for t in strings for x in t.to_batches() for b in suffix_dedup._hot_strings([x])]
    least = {}
    for b in found:
        for r in b.to_pylist():
            least[r["w"]] = min(r["id"], least.get(r["w"], r["id"]))
    single = [b.filter(pa.array([r["id"] > least[r["w"]] for r in b.to_pylist()])).select(["g", "at"]) for b in found]
    replies += [pa.Table.from_batches([b]) for b in suffix_dedup._hot_replies(single)]
    replies = by(replies, "g")
    cut = suffix_dedup._cut({"n_bytes": "long", "n_removed": "long", "n_spans": "long", "kept": "binary"}, False)
    out = [cut(t, replies.get(g, suffix_dedup.REPLY.empty_table())) for g, t in dealt.items()]
    return sorted((suffix_dedup.NO_ID if r["doc_id"] is None else r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept"]) for t in out for r in t.to_pylist())


@pytest.mark.parametrize("values", [1, 3, 1 << 20])
def test_hashes_that_clash(monkeypatch, values):
    """Whatever hashes bring together, only equal bytes go."""
    rows = [(i, t) for i, t in made_rows(5, 50, list(range(50)))] + [(60, "x" * 200), (61, "x" * 70), (62, None)]
    real = suffix_dedup._mixed
    monkeypatch.setattr(suffix_dedup, "_mixed", lambda a, b: real(a, b) % np.uint64(values))
    monkeypatch.setattr(suffix_dedup, "BLOCK", 64)
    monkeypatch.setattr(suffix_dedup, "CHUNK_RUNS", 5)
    for groups, buckets, hot in ((1, 1, 1 << 14), (4, 3, 1 << 14), (4, 3, 2)):
        assert in_one_process(rows, groups, buckets, hot) == brute(rows)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 9), st.text(alphabet="ab", min_size=0, max_size=160)), min_size=1, max_size=8), st.integers(1, 4), st.sampled_from([0, 1 << 14]))
def test_random_texts(rows, groups, hot):
    assert in_one_process(rows, groups, 2, hot) == brute(rows)

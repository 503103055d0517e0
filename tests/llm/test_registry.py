"""The registered queries' digests against plain Python, and those with SQL against DuckDB."""

import base64
import hashlib
import os
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from hoarfrost.llm import quality_rules, registry

from .test_secret_scan import brute as brute_spans
from .test_url_filter import brute_rule

SMALL, SF = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def brute_stats(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(zip(words, words[1:], words[2:]))
    hit = {j for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)


def test_stats():
    for text in ["", " \n\t", "a b c a b c", "é é é é\né é\n\né é", "x y #*$", "a\nb\na\n a\na", "one two three " * 40, "a b c d\x1ce\x85f"]:
        assert quality_rules.text_stats(text.encode()) == brute_stats(text)


def test_host_rules(spark):
    good = " ".join("w%d" % i for i in range(60))
    rows = [(1, None, "a"), (2, "", "a"), (3, good, "a"), (4, good, None), (4, good, None), (None, "short", "b"), (6, good, "c")] + [(10 + i, good if i % 4 == 0 else "bad", "d") for i in range(40)]
    docs = spark.createDataFrame([(i, t, s, True, 0.1) for i, t, s in rows], "doc_id long, text string, source string, kept boolean, host_rate double")
    got = quality_rules.host_rules(docs).collect()
    assert len(got) == len(rows)
    fails = Counter()
    total = Counter()
    for _, t, s in rows:
        total[s] += 1
        fails[s] += t != good
    rates = np.array([fails[s] / total[s] for s in total])
    m = rates.mean()
    v = rates.var(ddof=1) - m * (1 - m) * np.mean([1 / n for n in total.values()])
    weight = max(m * (1 - m) / v - 1, 1) if v > 0 else 1.0
    for r in got:
        rate = (fails[r.source] + m * weight) / (total[r.source] + weight)
        assert abs(r.host_rate - rate) < 1e-9 and r.kept == (not r.base_failed and rate <= 0.5)
    assert {r.kept for r in got if r.source == "d"} == {False}
    assert quality_rules.host_rules(docs.limit(0)).count() == 0


@needs_data
@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_against_duckdb(spark, name):
    df = registry.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    rel = con.sql(registry.ORACLES[name])
    assert sorted(rel.columns) == cols
    want = sorted(con.sql(f"SELECT {', '.join(cols)} FROM rel").fetchall())
    assert sorted(tuple(r[c] for c in cols) for r in df.collect()) == want


@needs_data
def test_digests(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in registry.QUERIES["op3_byte_bpe"](spark, SMALL).collect():
        ids = lib.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(np.array(ids, "<u4").tobytes()), sha(texts[r.doc_id].encode()))
    for r in registry.QUERIES["op4_progressive_jpeg"](spark, SMALL).collect():
        b = texts[r.doc_id].encode()
        p = b + b" " * (-len(b) % 192 if b else 192)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(b), len(p), sha(p), zlib.crc32(p[-16:]))
    for r in registry.QUERIES["op7_trigram_secrets"](spark, SMALL).collect():
        want = brute_spans(texts[r.doc_id])
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == x for k, _, _ in want) for x in ("assign", "access", "hex"))
        assert r.base_sha256 == sha(joined.encode()) and set(joined.split(",")) <= set(r.spans.split(","))
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    for r in registry.QUERIES["op1_url_bayes"](spark, SMALL).collect():
        host, path, rule, verdict = brute_rule(urls[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule) and (verdict is None or r.verdict == verdict)
    assert {q.split("_")[0] for q in registry.QUERIES} == {f"op{n}" for n in range(1, 14)}

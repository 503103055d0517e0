import os
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from hoarfrost.llm import quality_model, secret_scan, simhash

from .test_near_copies import brute_kept
from .test_packing import check
from .test_suffix_dedup import brute

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_against_brute_force(spark, tmp_path):
    sf_dir = str(tmp_path)
    secret = F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.format_string(" token = abcdef%06d end", "doc_id"))).otherwise(F.col("text"))
    spark.read.parquet(f"{SF}/documents.parquet").withColumn("text", secret).write.parquet(f"{sf_dir}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{sf_dir}/labels.parquet")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = quality_model.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    good = [(i, t) for i, t in rows if model.score([t.encode()])[0] >= 0.3]
    assert 150 < len(good) < 200
    kept = set(brute_kept(good))
    single = [(i, t) for i, t in good if i in kept]
    assert len(single) < len(good)
    cut = [(x[0], x[4].decode("utf-8", "ignore")) for x in brute(single)]
    masked = [(i, secret_scan.redacted(t, secret_scan.find_spans([t.encode()])[0])) for i, t in cut]
    assert sum(a != b for a, b in zip(masked, cut)) > 10
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = []
    for i, x in masked:
        ids = [*t.encode(x, add_special_tokens=False).ids, 0]
        cuts = [0, *range(len(ids) % 2048 or 2048, len(ids), 2048), len(ids)]
        want += [(i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    check(got, 2048)


def test_odd_rows(spark):
    rows = [(None, None), (None, ""), (1, None), (2, "word " * 100), (2, "word " * 100), (None, "word " * 100), (3, "x" * 50_000)]
    docs = spark.createDataFrame([(i, t, None, None, None, 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, fp int")
    for empty in (False, True):
        at = docs.limit(0) if empty else docs
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, at, SF)
            n = out.count()
            assert n == 0 if empty else n > 0 or name == "quality classifier"
            if name != "best-fit packing":
                assert out.columns == docs.columns
    kept = sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in simhash.one_of_each(docs).collect())
    assert [(i, len(t)) for _, i, t in kept] == [(1, 0), (2, 500), (3, 50_000)]

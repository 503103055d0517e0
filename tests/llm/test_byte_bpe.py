import base64
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from hoarfrost.llm import byte_bpe

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("theanding 's've\n\t.,!é\x1c\x1f\x85\xa0 12²½"), st.characters(codec="utf-8")), max_size=80))
def test_equals_the_library(text):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    lib = test_equals_the_library.lib = getattr(test_equals_the_library, "lib", None) or tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    ids = np.frombuffer(byte_bpe.encoder(PATH, P.PATTERN)(text), "<u4").tolist()
    assert ids == lib.encode_ordinary(text)
    assert byte_bpe.load_ranks(PATH).decode(ids) == text.encode()


def test_long_pieces(library):
    rng = random.Random(3)
    ranks = byte_bpe.load_ranks(PATH)
    for data in ["a" * 5000, "".join(rng.choice("abcdefgeee") for _ in range(4000)), "-=" * 900]:
        assert ranks.encode(data.encode()) == library._encode_single_piece(data.encode())


def test_append_and_edit(library):
    ranks, rng = byte_bpe.load_ranks(PATH), random.Random(5)
    for _ in range(30):
        data = bytes(rng.choice(b"thenadigro") for _ in range(rng.randrange(1, 200)))
        t = byte_bpe.PrefixTable(ranks, data)
        t.append(b"ington")
        data += b"ington"
        i = rng.randrange(len(data))
        j = rng.randrange(i, len(data) + 1)
        new = bytes(rng.choice(b"thenadigro") for _ in range(rng.randrange(6)))
        t.replace(i, j, new)
        data = data[:i] + new + data[j:]
        assert t.data == data and t.last == ranks.table(data)
        if data:
            assert t.ids() == library._encode_single_piece(data) or ranks.ranks.get(data) is not None
    t = byte_bpe.PrefixTable(ranks, b"thenadigro" * 1000)
    before = t.steps
    t.replace(5000, 5003, b"xyz")
    assert t.steps - before < 500 and t.last == ranks.table(t.data)


def test_frame(spark):
    rows = [(1, None, 7), (2, "", 8), (None, "Some text", 9), (2, "", 8), (3, "é " * 3000, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, token_ids int")
    tokens = byte_bpe.encode_texts(docs, PATH, P.PATTERN)
    back = byte_bpe.decode_ids(tokens.withColumn("ids", tokens.token_ids), PATH, "ids").collect()
    assert sorted((r.doc_id or 0, bytes(r.decoded).decode()) for r in back) == sorted((i or 0, t or "") for i, t, _ in rows)
    assert byte_bpe.encode_texts(docs.limit(0), PATH, P.PATTERN).count() == 0
    once = byte_bpe.encode_texts(docs, PATH, P.PATTERN, decoded=True).collect()
    assert sorted((r.doc_id or 0, bytes(r.decoded).decode()) for r in once) == sorted((i or 0, t or "") for i, t, _ in rows)

import base64
import hashlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from linecdc.llm import byte_bpe as B

PATH = P.path("byte_bpe_multi_50k.tiktoken")
TEXTS = [None, "", "Hello world, hello  world", "  \n\n tabs\tand   spaces   ", "naïve 😀😀 日本語 don't I'll", "a" * 30_000,
         "<|endoftext|> 12345   x\x1c\x85y", "word " * 5000, "Hello world, hello  world"]


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("size", [B.BLOCK_CHARS, 10])
def test_digest_as_the_library(spark, reference, size):
    rows = [(i, t, "w0", 3) for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string, bucket int").repartition(2)
    got = {r["doc_id"]: r for r in B.digest(docs, PATH, P.PATTERN, size=size).collect()}
    assert len(got) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        ids = np.array(reference.encode_ordinary(t or ""), "<u4")
        assert got[i]["n_tokens"] == len(ids), t
        assert got[i]["ids_sha256"] == hashlib.sha256(ids.tobytes()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()


def test_round_trip_and_empty(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)] + [(None, "no id"), (2, TEXTS[2])], "doc_id long, text string")
    encoded = B.encode(docs, PATH, P.PATTERN)
    back = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"]) for r in B.decode(encoded, PATH).collect())
    assert back == sorted((i is None, i or 0, t or "") for i, t in [*enumerate(TEXTS), (None, "no id"), (2, TEXTS[2])])
    assert B.digest(docs.limit(0), PATH, P.PATTERN).collect() == []

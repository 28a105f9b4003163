import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from basewright.llm import bpe


@pytest.fixture(scope="module")
def both():
    own = bpe.codec(*bpe.default_vocabulary())
    return own, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ranks, special_tokens={})


def test_same_ids_as_the_library(both):
    own, library = both
    rnd = random.Random(5)
    texts = ["".join(rnd.choice("aab eé\n\t 1!ßthe日") for _ in range(rnd.randint(0, 300))) for _ in range(1500)]
    texts += ["", "a" * 4000, " " * 3000, "ab" * 1500, "\n" * 999, "<|endoftext|>", "\x00\x7f", "ééé" * 700]
    for x in texts:
        ids = own.encode(x)
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(x)
        assert own.decode(ids) == x.encode()


def test_compatible_is_what_merging_says(both):
    own, _ = both
    rnd = random.Random(6)
    tokens = rnd.sample(sorted(own.entry), 400)
    for a, b in zip(tokens[:200], tokens[200:], strict=True):
        assert own._compatible(a, b) == (bpe.merged(own.entry[a] + own.entry[b], own.ranks) == [a, b])


def test_digests_are_the_librarys(spark, both):
    _, library = both
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {x.doc_id: x.text or "" for x in docs.collect()}
    for got in bpe.digests(docs).collect():
        ids = np.array(library.encode_ordinary(texts[got.doc_id]), "<u4").tobytes()
        assert (got.n_tokens, got.ids_sha256, got.decoded_sha256) == (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(texts[got.doc_id].encode()).hexdigest())


def test_rows(spark, both):
    rows = [(1, "the the", "x"), (1, "the the", "x"), (None, None, "y"), (2, "", None)]
    got = bpe.digests(spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")).collect()
    assert sorted(((x.doc_id, x.n_tokens) for x in got), key=str) == [(1, 2), (1, 2), (2, 0), (None, 0)]
    assert bpe.digests(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    kept = bpe.encode_decode(spark.createDataFrame(rows, "doc_id long, text string, n_tokens string"), *bpe.default_vocabulary())
    assert [c for c, _ in kept.dtypes] == ["doc_id", "text", "n_tokens", "token_ids", "decoded"]

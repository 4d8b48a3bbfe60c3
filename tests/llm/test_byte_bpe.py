import base64
import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import types as T

from pressmill.llm import byte_bpe


def _ranks(name):
    with open(P.path(name), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@pytest.fixture(scope="module", params=["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"])
def pair(request):
    ranks = _ranks(request.param)
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return byte_bpe.ByteBPE(ranks, P.PATTERN), lib


def test_equals_library_on_varied_texts(pair):
    own, lib = pair
    rng = random.Random(3)
    alphabets = ["abcdefghij the", "0123456789 ", " \n\t\r  ", "éèüßñçœ ", "日本語中文한국어", "😀🏳️‍🌈👩‍👩‍👧",
                 "'s't're've'm'll'd ", "!?#$%&*()_-", "\x00\x1c\x1d\x1e\x1f\x85​ "]
    texts = ["", " ", "<|endoftext|>", "a", "aaaa" * 50, "don't  stop\n\n now", "x́y", "\U000e0100\U0001f9d1"]
    for _ in range(600):
        mix = "".join(rng.choice(rng.choice(alphabets)) for _ in range(rng.randint(1, 80)))
        texts.append(mix)
    for t in texts:
        ids = own.encode(t)
        assert ids == lib.encode_ordinary(t), repr(t)
        assert own.decode(ids) == t.encode()


def test_very_long_pre_tokens(pair):
    own, lib = pair
    rng = random.Random(5)
    for t in ["a" * 30_000, "".join(rng.choice("etaoin") for _ in range(20_000)), "=" * 5_000]:
        assert own.encode(t) == lib.encode_ordinary(t)


def test_many_pieces_share_one_queue(pair):
    own, lib = pair
    rng = random.Random(8)
    words = [" " + "".join(rng.choice("thesandionérg") for _ in range(rng.randint(1, 30))) for _ in range(3_000)]
    assert [list(x) for x in own.merge([w.encode() for w in words])] == [lib.encode_ordinary(w) for w in words]
    assert own.encode_batch(words) == [lib.encode_ordinary(w) for w in words]


def test_rank_lower_than_the_bucket_at_work():
    # joining b and c opens a pair of lower rank than their own: it goes before the next b, c
    ranks = {bytes([b]): 300 + b for b in range(256)}
    ranks |= {b"bc": 200, b"abc": 100, b"bcb": 50}
    own = byte_bpe.ByteBPE(ranks, r"\S+")
    lib = tiktoken.Encoding("own", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})
    for t in ["abcbc", "bcbc", "abcabcbcb", "bcbcbcbabc"]:
        assert own.encode(t) == lib.encode_ordinary(t)


def test_memory_is_bounded():
    own = byte_bpe.ByteBPE(_ranks("byte_bpe_50k.tiktoken"), P.PATTERN, memory=10)
    for i in range(100):
        own.encode(f"word{chr(97 + i % 26)} again")
        assert len(own.tokens) <= 13 and len(own.units) <= 13


def test_documents_nulls_and_clashing_columns(spark):
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                           T.StructField("ids", T.StringType()), T.StructField("n_tokens", T.StringType())])
    df = spark.createDataFrame([(1, None, "x", "y"), (None, "", "x", "y"), (2, "Hello  world", None, None),
                                (2, "Hello  world", None, None)], schema)
    rows = byte_bpe.token_digests(df).collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in rows) == [(0, 0), (1, 0), (2, 3), (2, 3)]
    assert {r.decoded_sha256 for r in rows} == {empty, hashlib.sha256(b"Hello  world").hexdigest()}
    ids = byte_bpe.encode_documents(df)
    back = byte_bpe.decode_ids(ids).collect()
    assert sorted(bytes(r.data) for r in back) == [b"", b"", b"Hello  world", b"Hello  world"]
    assert byte_bpe.token_digests(df.limit(0)).collect() == []


def test_query_against_library(spark):
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=_ranks("byte_bpe_50k.tiktoken"), special_tokens={})
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in byte_bpe.op1_byte_bpe(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = lib.encode_ordinary(d.text or "")
        r = got[d.doc_id]
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((d.text or "").encode()).hexdigest()

import hashlib
import struct

import public_tokenizers as P
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from factloom.llm import bpe

RAW = open(P.path("byte_bpe_50k.tiktoken"), "rb").read()
CODEC = bpe.Codec(bpe.read_ranks(RAW), P.PATTERN)
TRUE = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(RAW), special_tokens={})


def ids(text):
    return list(memoryview(CODEC.encode(text)).cast("I"))


def test_every_token_encodes_to_itself():
    assert all(CODEC.merged(b) == [i] for b, i in CODEC.ranks.items())


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(), st.text(alphabet="abtheins' \n1é", max_size=200)))
def test_same_as_library(text):
    assert ids(text) == TRUE.encode_ordinary(text)
    assert CODEC.decode(CODEC.encode(text)) == text.encode()


def test_long_pieces_join():
    for text in ("a" * 5000, "thequick" * 700, " " * 3000, "éà" * 2000, "=" * 777, "<|endoftext|>"):
        assert ids(text) == TRUE.encode_ordinary(text)


def test_query_cases(spark, tmp_path):
    rows = [(1, "Hello  world's\n\n x"), (2, None), (3, ""), (3, ""), (None, "b c"), (5, "x" * 100_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as ids", "2 as decoded")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = bpe.op7_byte_bpe(spark, str(tmp_path)).collect()
    want = []
    for i, t in rows:
        x = TRUE.encode_ordinary(t or "")
        want.append((i, len(x), hashlib.sha256(struct.pack(f"<{len(x)}I", *x)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    empty = df.limit(0)
    assert bpe.encode_decode(empty, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0

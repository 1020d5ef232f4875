import hashlib
import importlib

import public_tokenizers as P
import tiktoken

from factloom.llm import bpe, language, private
from factloom.llm.common import materialize
from tests.llm.test_minmax import brute


def test_stages_against_plain_versions(spark):
    pipeline = importlib.import_module("corpus_pipeline")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    odd = spark.createDataFrame([(900, None, None, "src1", None), (901, "", "en", None, 0), (902, "12 34", "de", "src2", 5), (3, docs.where("doc_id = 3").first()["text"], "fr", "src3", 2520)], docs.schema)
    docs = docs.unionByName(odd)
    columns = docs.columns
    model = language.learned(docs)
    kept = {}
    for name, stage in pipeline.STAGES[:4]:
        out = materialize(stage(spark, docs, None), "test")
        assert out.columns == columns, name
        kept[name], docs = out.collect(), out
    lang = kept["language ID"]
    assert {r["doc_id"] for r in lang} == {r["doc_id"] for r in lang if model.predict(r["text"])[0] != "und"} and not {900, 901, 902} & {r["doc_id"] for r in lang}
    assert len(lang) > 190
    rows = sorted((r["doc_id"], r["text"]) for r in lang)
    want = sorted({d for d, _, c in brute(rows, 5, 80) if d == c})
    assert sorted(r["doc_id"] for r in kept["MinHash near-dedup"]) == want
    texts = {r["doc_id"]: r["text"] for r in kept["MinHash near-dedup"]}
    for r in kept["PII"]:
        spans = private.base_spans(texts[r["doc_id"]])
        assert not private.base_spans(r["text"]) and (spans or "<found>" in r["text"] or r["text"] == texts[r["doc_id"]])
        assert r["n_chars"] == len(r["text"])
    once = {r["doc_id"]: r["text"] for r in kept["PII"]}
    taken = {}
    for r in kept["mixing sources to target weights"]:
        assert once[r["doc_id"]] == r["text"]
        taken[r["doc_id"]] = taken.get(r["doc_id"], 0) + 1
    assert max(taken.values()) <= 3
    real = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(open(P.path("byte_bpe_50k.tiktoken"), "rb").read()), special_tokens={})
    for r in pipeline.byte_bpe(spark, docs, None).collect():
        assert list(memoryview(bytes(r["ids"])).cast("I")) == real.encode_ordinary(once[r["doc_id"]])
        assert r["decoded_sha256"] == hashlib.sha256(once[r["doc_id"]].encode()).hexdigest()


def test_empty_table_and_more_columns(spark):
    pipeline = importlib.import_module("corpus_pipeline")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("*", "1 as n", "'x' as comp", "2 as row", "3 as size", "4 as t1")
    for start in (docs.limit(0), docs.where("doc_id < 40")):
        kept = start
        for name, stage in pipeline.STAGES[:4]:
            kept = materialize(stage(spark, kept, None), "test")
            assert kept.columns == docs.columns, name
        done = pipeline.byte_bpe(spark, kept, None)
        assert done.count() == kept.count() and (start.isEmpty() or done.count() > 10)

import math
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from factloom.llm import lm


def net(seed=0, k=40):
    n = lm.Network(np.append(np.arange(k, 0, -1), 7))
    r = np.random.default_rng(seed)
    n.w = {key: (v + r.normal(0, 0.5, v.shape)).astype(np.float64) for key, v in n.w.items()}
    return n


def test_probabilities_sum_to_one():
    n = net()
    h = np.random.default_rng(1).normal(size=(41, lm.HIDDEN))
    for i in range(3):
        assert np.exp(n.output(np.repeat(h[i : i + 1], 41, 0), np.arange(41))[0]).sum() == pytest.approx(1)


def test_scores_do_not_depend_on_the_batch():
    n, r = net(), np.random.default_rng(2)
    docs = [np.append(r.integers(1, 41, m), 0) for m in (0, 1, 5, 200, 33, 3)]
    together = n.score(docs, 0)
    for d, want in zip(docs, together):
        h, prev, total = np.zeros((1, lm.HIDDEN)), 0, 0.0
        for i in d:
            h = n.step(np.array([prev]), h)[0]
            total += n.output(h, np.array([i]))[0][0]
            prev = i
        assert want == pytest.approx(total)


def test_gradients_against_differences(monkeypatch):
    stream = np.random.default_rng(3).integers(0, 41, 32)
    monkeypatch.setattr(lm, "STEPS", 32)

    def loss(n):
        h, prev, total = np.zeros((1, lm.HIDDEN)), 0, 0.0
        for i in stream:
            h = n.step(np.array([prev]), h * (prev != 0))[0]
            total -= n.output(h, np.array([i]))[0][0]
            prev = i
        return total / len(stream)

    base, trained = net(), net()
    sums = {}
    trained.train(stream, 0, sums)
    r = np.random.default_rng(4)
    for key in base.w:
        for _ in range(4):
            at = tuple(r.integers(0, s) for s in base.w[key].shape)
            up, down = net(), net()
            up.w[key][at] += 1e-5
            down.w[key][at] -= 1e-5
            slope = (loss(up) - loss(down)) / 2e-5
            assert np.sqrt(max(0, sums[key][at] - 1e-8)) == pytest.approx(abs(slope), abs=1e-6)


def test_query_against_plain_counts(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(1001, None), (1002, ""), (None, "The zzzq"), (5, "repeat The"), (5, "repeat The")], "doc_id long, text string")
    docs = docs.unionByName(odd)
    docs.selectExpr("*", "1 as word", "2 as c", "3 as held_out").write.parquet(f"{tmp_path}/documents.parquet")
    got = lm.op8_recurrent_lm(spark, str(tmp_path)).collect()

    def tokens(t):
        return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [""]

    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    counts = Counter()
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    for i, t in rows:
        if not held(i):
            counts.update(tokens(t))
    n, v = sum(counts.values()), len(counts)
    want = sorted((str(i), held(i), len(x := tokens(t)), sum(counts[w] > 0 for w in x), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in x), 6)) for i, t in rows)
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    out = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)
    assert lm.scored(docs.limit(0), lm.fold(lm.F.col("doc_id"), 7) == 2).count() == 0


def test_training_reads_every_token(monkeypatch):
    for size in (1, 15, 17, 100, 1024 * 16 + 1, 1024 * 17 + 1023):
        n, stream, read = net(), np.random.default_rng(size).integers(0, 41, size), Counter()
        output = n.output
        monkeypatch.setattr(n, "output", lambda h, ids, learn=None: read.update(ids.tolist()) or output(h, ids, learn))  # noqa: B023
        n.train(stream, 0, {})
        assert read == Counter(stream.tolist())


def test_texts_of_several_batches_are_scored_together(monkeypatch):
    vocab = lm.Vocabulary([(lm.END, 9), ("a", 5), ("b", 4), ("c", 2)], 20, 4)
    weights = lm.Network(vocab.net_counts).flat()
    texts = ["a b a", None, "", "b zz c", "a " * 30, "zz", "c c A"]
    columns = lambda i, j: [pa.array(range(i, j), pa.int64()), pa.array([False] * (j - i)), pa.array(texts[i:j], pa.string())]
    one = [pa.RecordBatch.from_arrays(columns(i, i + 1), ["doc_id", "held_out", "text"]) for i in range(7)]
    got = list(lm.score_batches(one, vocab, weights))
    assert len(got) == 1 and got[0].column(0).to_pylist() == list(range(7)) and got[0].column(2).to_pylist() == [4, 1, 1, 4, 31, 2, 4]
    assert got[0].column(6).to_pylist() == [[], [], [], ["zz"], [], ["zz"], []]
    monkeypatch.setattr(lm, "TOGETHER", 30)
    parts = list(lm.score_batches(one, vocab, weights))
    assert [len(x) for x in parts] == [5, 2]
    assert np.allclose(np.concatenate([x.column(5) for x in parts]), got[0].column(5)) and list(lm.score_batches([], vocab, weights)) == []


def test_ids_and_classes_are_sorted_by_counting(monkeypatch):
    kinds, sort = [], np.argsort
    n, r = net(), np.random.default_rng(6)
    docs = [np.append(r.integers(1, 41, m), 0) for m in (9000, 5, 200)]
    monkeypatch.setattr(np, "argsort", lambda a, **more: kinds.append((a.dtype.itemsize, len(a))) or sort(a, **more))
    n.train(np.concatenate(docs), 0, {})
    n.score(docs, 0)
    assert kinds and all(size <= 2 for size, rows in kinds if rows > len(docs))
    numbers = r.integers(0, 70_000, 1000)
    for some in (numbers, numbers % 50, numbers[:0]):
        assert (lm.by_number(some) == sort(some, kind="stable")).all()


def test_ids_for_training_are_those_of_the_network():
    vocab = lm.Vocabulary([("a", 900_000), ("b", 50), ("c", 3), (lm.END, 7)], 1_000_000, 5)
    for text in (None, "", "A b c  zz", "b\na é"):
        assert vocab.network_ids(text).tolist() == vocab.for_network(vocab.ids(text)[1]).tolist()


def test_tokens_of_odd_texts():
    texts = ["", None, " ", "A b", " \tA\x0b\x0cb\r\n", "a\x1cb\x1d\x1e\x1f c", "a\x00b\x85c\xa0d\u3000e", "\u0130\u212aK \u00c9\U0001f600 Z", "zz  zz"]
    want = [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for t in texts]
    for i in range(len(texts)):  # slices, too
        words, sizes = lm.tokens(pa.array(texts, pa.string())[i:])
        assert words.to_pylist() == sum(want[i:], []) and sizes.tolist() == [len(w) for w in want[i:]]
    vocab = lm.Vocabulary([("zz", 9), ("a", 8), ("k", 3)], 20, 5)
    ids, sizes, _ = vocab.all_ids(pa.array(texts, pa.string()))
    known = {"zz": 0, "a": 1, "k": 2}
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [[known.get(w, -1) for w in t] + [vocab.end] for t in want]


def test_counting_and_ids_make_no_object_of_a_word(spark, monkeypatch):
    class Docs:
        select = groupBy = agg = lambda self, *_: self

        def mapInArrow(self, run, _):  # noqa: N802
            self.run = run
            return self

    docs = lm.token_counts(Docs())
    texts = [" ".join(f"word{i}" for i in range(k, k + 10_000)) for k in range(0, 100_000, 5000)] + [None]
    batches = [pa.RecordBatch.from_arrays([pa.array(texts[i : i + 4], pa.string())], ["text"]) for i in range(0, len(texts), 4)]
    for flush in (300_000, 7000):
        monkeypatch.setattr(lm, "_FLUSH", flush)
        tracemalloc.start()
        found = list(docs.run(batches))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 5_000_000
        sums = Counter()
        for batch in found:
            for word, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums[word] += c
        want = Counter(w for t in texts if t for w in t.split())
        assert sums == want + Counter({lm.END: len(texts)})

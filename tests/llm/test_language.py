import itertools
import zlib

import numpy as np

from factloom.llm import language as lang


def model():
    pieces = {"▁": (0.1, 0.2), "▁a": (0.2, 0.1), "a": (0.1, 0.3), "b": (0.2, 0.1), "ab": (0.3, 0.1), "▁ab": (0.1, 0.2)}
    return lang.Model(["x", "y"], np.log([0.5, 0.5]), pieces)


def brute(m, word):
    s = lang.MARK + word
    total = np.zeros(2)
    for cuts in itertools.product([0, 1], repeat=len(s) - 1):
        parts, last = [], 0
        for i, c in enumerate(cuts, 1):
            if c:
                parts.append(s[last:i])
                last = i
        parts.append(s[last:])
        p = np.ones(2)
        for x in parts:
            p = p * np.array(m.pieces.get(x) or ((lang.UNKNOWN,) * 2 if len(x) == 1 else (0.0, 0.0)))
        total += p
    return np.log(total)


def test_forward_sums_all_segmentations():
    m = model()
    for word in ("a", "b", "ab", "aba", "zab", "abab", "aéb"):
        assert np.allclose(m.forward(word), brute(m, word))
    words = ["a", "b", "ab", "aba", "zab", "abab", "aéb", "abzzabé"]
    assert np.allclose(m.forward_many(words), [m.forward(w) for w in words])


def test_words_step_through_the_pieces_together():
    m, asked = model(), []

    class Watched(dict):
        def get(self, *a):
            asked.append(a)
            return dict.get(self, *a)

    words = [a + b for a in ("a", "ab", "éb", "\U00020000a", "zz") for b in ("", "b", "ba", "aab" * 7)]
    want = [m.forward(w) for w in words]
    for name, v in vars(m).items():
        if isinstance(v, dict):
            setattr(m, name, Watched(v))
    assert np.allclose(m.forward_many(words), want) and not asked  # no look-up for each place of each word


def test_forward_survives_long_words():
    assert np.isfinite(model().forward("ab" * 20_000)).all()


def test_query_on_documents(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    more = spark.createDataFrame([(10**6, None, "en"), (10**6 + 1, "12 %", "de"), (10**6 + 2, "", None), (None, "the and of", None)], "doc_id long, text string, lang string")
    docs.select("doc_id", "text", "lang").unionByName(more).selectExpr("*", "0 as score", "'q' as lang_pred").write.parquet(f"{tmp_path}/documents.parquet")
    got = lang.op6_language_id(spark, str(tmp_path)).collect()
    true = {r["doc_id"]: r["lang"] for r in docs.collect()}
    assert len(got) == 204
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"] if r["doc_id"] is not None else "").encode()) % 5 == 0) and 0 <= r["score"] <= 1
    held = [r for r in got if r["held_out"] and r["doc_id"] in true]
    assert np.mean([r["lang_pred"] == true[r["doc_id"]] for r in held]) > 0.95
    assert all(r["lang_pred"] == "und" for r in got if r["doc_id"] in (10**6, 10**6 + 1, 10**6 + 2))


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert [r["lang_pred"] for r in lang.identify(docs, lang.learned(docs)).collect()] == ["und"]
    assert lang.identify(docs.limit(0), lang.learned(docs.limit(0))).count() == 0


def test_long_pieces_count():
    piece = "▁international"
    assert lang.usable(piece)
    model = lang.Model(["a", "b"], np.zeros(2), {piece: (0.25, 0.5), "▁": (0.1, 0.1)})
    want = np.log([0.25, 0.5])
    assert np.allclose(model.forward("international"), want) and np.allclose(model.forward_many(["international"])[0], want)


def test_memo_generations(monkeypatch):
    monkeypatch.setattr(lang, "_MEMO", 6)
    m, whole = model(), model()
    texts = [" ".join(w) for w in (["a", "ab", "aba"], ["a", "b" * 40, "zab"], ["ab", "abab", "bb", "ba"], ["aab", "a", "b" * 40, "bba"], ["a"] * 3, [chr(97 + i) for i in range(20)])]
    for t in [*texts, *texts[::-1]]:
        monkeypatch.setattr(lang, "_MEMO", 6)
        got = m.predict(t)
        monkeypatch.setattr(lang, "_MEMO", 10**6)
        assert got == whole.predict(t)
    assert len(m.row) <= 20

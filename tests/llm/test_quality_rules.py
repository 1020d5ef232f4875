import random
import re

import numpy as np

from factloom.llm import quality_rules as q


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    inside = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    failed = len(words) < 10 or 100 * len(inside) > 20 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(inside), failed


def test_base_against_brute_force(spark, tmp_path):
    r = random.Random(0)
    texts = [None, "", " \n\t", "a b c d e", "a b c d e a b c d e", "x " * 40, "a\nb\na\n\n\na \na"]
    texts += ["".join(r.choice(["a ", "b ", "c ", "\n", "# ", "é|", "\x0b"]) for _ in range(r.choice([20, 200]))) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "a b"), (3, "a b c d e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as kept", "1 as trusted")
    labels = spark.createDataFrame([(20, 1, 0), (20, 1, 0), (21, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    got = q.op2_quality_rules(spark, str(tmp_path)).collect()
    assert sorted([tuple(x)[:7] for x in got], key=str) == sorted([(i, *brute(t)) for i, t in rows], key=str)
    assert all(x["kept"] == (not x["base_failed"] and x["llr"] >= q.THRESHOLD) for x in got)
    assert q.judge(docs.limit(0), q.log_ratios(docs, labels.limit(0))).count() == 0


def test_ratio_tells_target_from_the_rest(spark):
    r = random.Random(1)
    good = [" ".join(r.choice("abcdefghijklm") * 3 for _ in range(30)) for _ in range(40)]
    bad = [" | ".join(r.choice("nopqrstuvwxyz") * 3 for _ in range(30)) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(good + bad)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(20)] + [(i, 0, 0) for i in range(40, 60)], "doc_id long, quality int, toxic int")
    kept = {x["doc_id"]: x["kept"] for x in q.judge(docs, q.log_ratios(docs, labels)).collect()}
    assert all(kept[i] for i in range(40)) and not any(kept[i] for i in range(40, 80))


def test_buckets_are_in_range():
    b = q.ngram_buckets([b"a", b"b", b"a"])
    assert len(b) == 5 and (b[:3] < q.BUCKETS).all() and (b[3:] >= q.BUCKETS).all() and np.unique(b[:3]).size == 2


def test_ratio_against_plain_counts(spark):
    r = random.Random(3)
    texts = [" ".join(r.choice(["Aa", "b", "c#", "dd", "é", "f"]) for _ in range(r.choice([0, 1, 2, 15, 60]))) for _ in range(50)]
    texts += [texts[3], None, "zz " * 50_000]
    labels = [(i, i % 3 == 0) for i in range(30)] + [(4, True), (4, False)]
    docs = spark.createDataFrame([*enumerate(texts), (3, texts[3])], "doc_id long, text string").selectExpr("*", "1 as raw", "2 as target")
    known = spark.createDataFrame([(i, int(good), 0) for i, good in labels], "doc_id long, quality int, toxic int")
    trusted = {i for i, good in labels if good}

    def grams(text):
        words = [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))]
        return [int(q.ngram_buckets([w])[0]) for w in words] + [int(q.ngram_buckets([a, b])[2]) for a, b in zip(words, words[1:])]

    raw, target = {}, {}
    for i, t in [*enumerate(texts), (3, texts[3])]:
        for g in grams(t):
            raw[g] = raw.get(g, 0) + 1
            target[g] = target.get(g, 0) + (i in trusted)
    all_raw, all_target = sum(raw.values()), sum(target.values())
    log = lambda g: np.log(q.LAMBDA * (target[g] / all_target) / (raw[g] / all_raw) + 1 - q.LAMBDA)
    for x in q.judge(docs, q.log_ratios(docs, known)).collect():
        found = grams(texts[x["doc_id"]])
        assert abs(x["llr"] - (np.mean([log(g) for g in found]) if found else 0)) < 1e-9
        assert x["kept"] == (not x["base_failed"] and x["llr"] >= q.THRESHOLD)

import hashlib
import random

import numpy as np
import zstandard

from factloom.llm import fingerprint as fp


def brute(points, k=fp.K, s=fp.S):
    inner = fp._grams(points, s)
    return [i for i in range(len(points) - k + 1) if min(w := inner[i : i + k - s + 1].tolist()) in (w[0], w[-1])]


def text(seed, n=3000):
    r = random.Random(seed)
    return "".join(r.choice("abcdefghij é\n") for _ in range(n))


def test_anchors_against_brute_force():
    for seed in range(5):
        points = fp.code_points(text(seed, 300))
        assert fp.anchors(points)[0].tolist() == brute(points)


def test_grams_depend_on_content_only():
    points = fp.code_points(text(1, 200))
    for n in (1, 2, 3, 7, 10, 20):
        whole = fp._grams(points, n)
        assert len(whole) == len(points) - n + 1
        assert all(fp._grams(points[i : i + n].copy(), n)[0] == whole[i] for i in range(0, 100, 13))


def test_likeness_follows_true_overlap():
    a = text(3)
    b = a[:2250] + text(4)[:750]
    x, y, z = (fp.sketch(fp.code_points(t)) for t in (a, b, text(5)))
    assert fp.likeness(x, x) == 1 and abs(fp.likeness(x, y) - 0.75) < 0.12 and fp.likeness(x, z) < 0.05
    nothing = np.empty(0, np.uint32)
    assert fp.likeness(nothing, x) == 0 and fp.likeness(nothing, nothing) == 1


def test_query_against_brute_force(spark, tmp_path):
    r = random.Random(0)
    rows = [(i * 3, text(i, r.choice([0, 1, 5, 30, 400, 900]))) for i in range(60)] + [(None, "first by order"), (7, None), (9, "tie"), (9, "tie"), (10**6, text(99, 50_000))]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as part", "2 as kind")
    df.repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(x) for x in fp.with_edits(spark.read.parquet(f"{tmp_path}/documents.parquet"), per_part=7).collect()), key=str)
    press = zstandard.ZstdCompressor(level=3).compress
    ordered = sorted([((-1 if i is None else i), i, t or "") for i, t in rows], key=lambda x: (x[0], press(x[2].encode())))
    want = []
    for k, (_, i, t) in enumerate(ordered):
        after = ordered[(k + 1) % len(ordered)][2]
        q = len(t) // 4
        edited = t[: len(t) - q] + after[:q]
        own, other, nxt = (fp.sketch(fp.code_points(x)) for x in (t, edited, after))
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), fp.as_text(own), fp.as_text(other), fp.likeness(own, other), fp.likeness(own, nxt)))
    assert got == sorted(want, key=str)
    assert fp.with_edits(df.limit(0)).count() == 0
    assert fp.with_edits(df.limit(1)).count() == 1
    assert fp.fingerprints(df).count() == len(rows)


def test_long_texts_keep_all_anchors():
    passage = text(20, 1000)
    a, b = (text(k, 50_000) + passage + text(k + 1, 49_000) for k in (21, 23))
    x, y, z = (fp.sketch(fp.code_points(t)) for t in (a, b, passage))
    assert 0.005 < fp.likeness(x, y) < 0.015
    p, q = fp.matches(z, x)
    assert len(p) == len(z) and (q - p == 50_000).all()
    assert len(x) == len(brute(fp.code_points(a)))
    for one in (x, z, x[:1], x[:0], np.array([5, (2**31 << 32) + 7], np.uint64)):
        assert fp.from_text(fp.as_text(one)).tolist() == one.tolist()


def test_repeated_anchors_count_as_often_as_both_have_them():
    x, y = (fp.sketch(fp.code_points("the same line again and again\n" * n)) for n in (10, 30))
    assert 0.4 < fp.likeness(x, y) < 0.6

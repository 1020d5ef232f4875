import math
import random

import numpy as np
from pyspark.sql import functions as F

from factloom.llm import quality_classifier as q


def test_logistic_finds_the_slope():
    r = np.random.default_rng(0)
    x = r.normal(size=(4000, 2))
    y = (r.random(4000) < 1 / (1 + np.exp(-(2 * x[:, 0] - 1)))).astype(float)
    mean, scale, w = q.logistic(x, y)
    assert abs(w[0] / scale[0] - 2) < 0.3 and abs(w[1]) < 0.2
    assert not q.logistic(x, np.ones(4000))[2].any()


def test_held_out_labels_and_cases(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", "source")
    odd = spark.createDataFrame([(5000, None, None, None), (5001, "", "en", "rare"), (None, "the and of", None, "src1"), (7, "x", "en", "src1"), (7, "x", "en", "src1")], "doc_id long, text string, lang string, source string")
    docs = docs.unionByName(odd)
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").distinct()
    train = labels.where("doc_id % 3 <> 0").unionByName(spark.createDataFrame([(None, 1, 0)], labels.schema))
    docs.selectExpr("*", "1 as score", "2 as host").write.parquet(f"{tmp_path}/documents.parquet")
    train.write.parquet(f"{tmp_path}/labels.parquet")
    got = q.op1_site_quality(spark, str(tmp_path)).toPandas()
    assert len(got) == 1005 and got.score.between(0, 1).all() and got.score.notna().all()
    held = got.merge(labels.where("doc_id % 3 = 0").toPandas(), on="doc_id")
    assert (held.kept == (held.quality == 1)).mean() > 0.93
    assert held[held.quality == 1].kept.mean() > 0.97
    assert q.classify(docs.limit(0), train, F.col("source"), F.col("lang")).count() == 0
    assert set(q.classify(docs.limit(3), train.limit(0), F.col("source"), F.col("lang")).toPandas().evidence.round(6)) == {0.5}


def test_sparse_sites_shrink(spark):
    rows = [(i, "a good text", "big", "big/a") for i in range(200)] + [(900, "a good text", "small", "small/a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, path string")
    labels = spark.createDataFrame([(i, int(i % 2), 0) for i in range(200)] + [(900, 0, 0)], "doc_id long, quality int, toxic int")
    got = q.classify(docs, labels, F.col("source"), F.col("path")).toPandas().set_index("doc_id")
    assert 0.05 < got.host_posterior[900] < got.host_posterior[3] and abs(got.path_posterior[3] - 0.5) < 0.05


def test_posteriors_against_plain_ones(spark):
    r = random.Random(2)
    rows, labels = [], []
    for i in range(400):
        host = r.choice(["a", "b", "c", None, ""])
        good = r.random() < {"a": 0.9, "b": 0.2}.get(host, 0.5)
        rows.append((i, " ".join(r.choice(["fine", "prose", "words"] if good else ["spam", "###", "buy"]) for _ in range(r.randint(0, 30))), host, r.choice(["x", "y", None])))
        if r.random() < 0.4:
            labels.append((i, int(good)))
    rows += [(7, "fine prose words", *rows[7][2:]), (None, "fine prose", "b", None), (401, None, "lone", "x"), (402, "word " * 60_000, "a", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, host string, path string").selectExpr("*", "1 as n", "2 as k", "3 as quality")
    known = spark.createDataFrame([*labels, (7, 0), (7, 1), (None, 1)], "doc_id long, quality long")
    got = q.classify(docs, known, q.F.col("host"), q.F.col("path"))
    with_sites = got.collect()
    assert len(with_sites) == len(rows)
    quality = dict(labels) | {7: 0}
    place = {}
    for i, _, host, path in rows:
        place.setdefault(i, []).append((host, path))
    units = [(x, (1.0, float(quality[x["doc_id"]])) if x["doc_id"] in quality else (q.SOFT, q.SOFT * x["evidence"])) for x in with_sites]
    at = lambda x: place[x["doc_id"]][0]
    paths, hosts = {}, {}
    for x, (n, k) in units:
        for d, key in ((paths, at(x)), (hosts, at(x)[0])):
            d[key] = [a + b for a, b in zip(d.get(key, [0, 0]), (n, k))]
    n, k = (sum(v[j] for v in hosts.values()) for j in (0, 1))
    top = min(max((k + 0.5) / (n + 1), 1e-3), 1 - 1e-3)

    def strength(sites):
        total = sum(a for a, _ in sites)
        spread = sum(a * (b / a - top) ** 2 for a, b in sites) / total
        between = max(spread - top * (1 - top) * len(sites) / total, 1e-4)
        return min(max(top * (1 - top) / between - 1, 2.0), 1e4)

    prior, inner = strength(list(hosts.values())), strength(list(paths.values()))
    for x, (n, k) in units:
        (hn, hk), (pn, pk) = hosts[at(x)[0]], paths[at(x)]
        host, host_less = (hk + prior * top) / (hn + prior), (hk - k + prior * top) / (hn - n + prior)
        path, path_less = (pk + inner * host) / (pn + inner), (pk - k + inner * host_less) / (pn - n + inner)
        odds = math.log(x["evidence"] / (1 - x["evidence"])) + math.log(path_less / (1 - path_less)) - math.log(top / (1 - top))
        assert abs(x["host_posterior"] - host) < 1e-9 and abs(x["path_posterior"] - path) < 1e-9
        assert abs(x["score"] - 1 / (1 + math.exp(-odds))) < 1e-9 and x["kept"] == (x["score"] >= q.KEEP)

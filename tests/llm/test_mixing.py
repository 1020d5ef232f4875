import random
import re

from factloom.llm import mixing


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(order)}
    total, full = sum(sizes.values()), {}
    while True:
        left = total - sum(full.values())
        open_ = {s: w for s, w in weight.items() if s not in full}
        target = {s: left * w / sum(open_.values()) for s, w in open_.items()}
        over = {s: 3 * sizes[s] for s, t in target.items() if t > 3 * sizes[s]}
        if not over:
            return full | target
        full |= over


def documents(spark, seed=0, n=3000):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        s = r.choice(["a"] * 20 + ["b", "c", "é", "Z", None])
        rows.append((i, None if i % 97 == 0 else " ".join("w" for _ in range(r.choice([0, 1, 5, 40, 41, 300]))), s))
    rows += [(5, "x y z", "b")] * 7 + [(None, "one two", "c"), (None, "one two", "c"), (n + 1, "", "empty"), (n + 2, "w " * 50_000, "b")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 as size", "2 as p")


def test_mix(spark, tmp_path):
    rows, df = documents(spark)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    first = mixing.op5_pivotal_mix(spark, str(tmp_path)).toPandas()
    again = mixing.op5_pivotal_mix(spark, str(tmp_path)).toPandas()
    key = list(first.columns)
    assert first.sort_values(key).reset_index(drop=True).equals(again.sort_values(key).reset_index(drop=True))
    assert len(first) == len(rows) and (first.taken <= 3 * first["size"]).all()
    sizes, longest = {}, {}
    for _, t, s in rows:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
        sizes[s] = sizes.get(s, 0) + n
        longest[s] = max(longest.get(s, 0), n)
    want = brute_targets(sizes)
    by_size = {(v, round(want[s], 6)): s for s, v in sizes.items()}
    for (size, target), part in first.groupby(["source_size", "target"]):
        s = by_size[size, round(target, 6)]
        assert abs(part.taken.sum() - target) <= longest[s] * 1.01, (s, target, part.taken.sum())


def test_no_rows_and_one_source(spark):
    _, df = documents(spark, n=10)
    assert mixing.mixed(df.limit(0)).count() == 0
    one = spark.createDataFrame([(1, "a b", "s"), (2, "c", "s")], "doc_id long, text string, source string")
    assert {(r["doc_id"], r["copies"]) for r in mixing.mixed(one).collect()} == {(1, 1), (2, 1)}


def test_each_expectation_is_kept(spark):
    from pyspark.sql import functions as F

    units = spark.range(20_000).select("id", F.lit("s").alias("source"), (F.col("id") % 7 + 1).alias("size"), F.lit(1).cast("long").alias("times"), F.lit(0).alias("base"), (F.col("id") % 5 * 0.2 + 0.1).alias("p")).withColumnRenamed("id", "doc_id")
    got = mixing.rounded(units).toPandas()
    for k, part in got.groupby(got.doc_id % 5):
        assert abs(part.p.mean() - (k * 0.2 + 0.1)) < 0.03
    assert abs((got.p * got["size"]).sum() - sum((i % 5 * 0.2 + 0.1) * (i % 7 + 1) for i in range(20_000))) <= 7

import random
import re

import numpy as np

from factloom.llm import minmax


def brute(rows, width, percent):
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())

    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        key = -(10**18) if d is None else d
        least[root(i)] = min(least.get(root(i), key), key)
    return [(d, len(s), None if (c := least[root(i)]) == -(10**18) else c) for i, ((d, _), s) in enumerate(zip(rows, sets))]


def corpus(seed, n=160):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(1, 6)))
    base = [[word() for _ in range(r.choice([4, 30, 120]))] for _ in range(12)]
    rows = []
    for i in range(n):
        w = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 2, 4, 7])):
            w[r.randrange(len(w))] = word()
        rows.append((1000 - i, " ".join(w).capitalize()))
    return rows + [(2000, None), (2001, ""), (2002, " \n"), (None, "one two"), (2003, "ONE two"), (2004, "x"), (990, rows[10][1])]


def key(x):
    return str(x)


def test_groups_against_brute_force(spark):
    for seed, width, percent in ((1, 3, 85), (2, 5, 80)):
        rows = corpus(seed)
        df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n", "2 as comp")
        got = sorted(map(tuple, minmax.groups(df, width, percent).collect()), key=key)
        assert got == sorted(brute(rows, width, percent), key=key)
    assert minmax.groups(df.limit(0)).count() == 0


def test_signature_estimates_similarity():
    r = np.random.default_rng(1)
    a = np.unique(r.integers(0, 2**63, 3000, dtype=np.uint64))
    b = np.unique(np.concatenate([a[:2400], r.integers(0, 2**63, 600, dtype=np.uint64)]))
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs((minmax.signature(a) == minmax.signature(b)).mean() - true) < 0.12


def test_bitmaps_lose_no_pair():
    r = np.random.default_rng(7)
    hashes = lambda n: r.integers(0, 2**63, n, dtype=np.uint64)
    sets = [np.unique(hashes(n)) for n in (1, 2, 40, 100, 127, 129, 700)]
    sets += [np.unique(np.concatenate([s[int(len(s) * cut) :], hashes(more)])) for s in sets for cut in (0.0, 0.05, 0.1, 0.2) for more in (0, 1, len(s) // 10)]
    sizes, bits = np.array([len(s) for s in sets]), [minmax.bitmap(s).tobytes() for s in sets]
    every = np.arange(len(sets))
    for percent in (80, 85):
        gap = minmax.gaps(sizes, bits, every, every, percent)
        for i in every:
            for j in every:
                unlike = len(np.setxor1d(sets[i], sets[j]))
                if np.isfinite(gap[i, j]):
                    assert gap[i, j] * (sizes[i] + sizes[j]) <= unlike + 1e-9
                else:
                    assert not minmax.linked(sets[i], sets[j], percent)


def test_blocks_lose_no_pair(spark, monkeypatch):
    monkeypatch.setattr(minmax, "CHUNK", 5)
    rows = [(i, t) for i, t in corpus(3) if t and i is not None]
    made = minmax.features(spark.createDataFrame(rows, "doc_id long, text string"), 3).dropDuplicates(["set_id"])
    made = minmax.materialize(made.withColumn("node", minmax.F.monotonically_increasing_id()), "test")
    met = made.select("node", minmax.F.explode("bands").alias("band"))
    sets = {r["node"]: minmax.shingle_set(dict(rows)[r["doc_id"]], 3) for r in made.collect()}
    bands: dict = {}
    for r in met.collect():
        bands.setdefault(r["band"], []).append(r["node"])
    for comp in (minmax.F.col("node"), minmax.F.col("node") % 9):
        comps = made.select("node", comp.alias("comp"))
        of = {r["node"]: r["comp"] for r in comps.collect()}
        cells = minmax._members(met, made, comps)
        found = {frozenset(p) for p in minmax.block_pairs(cells, 85, True).collect()}
        want = {frozenset((a, b)) for v in bands.values() for a in v for b in v if of[a] != of[b] and minmax.linked(sets[a], sets[b], 85)}
        assert want and want <= found
        near = {u: c for u, c in minmax.block_pairs(cells, 85, False).collect()}
        assert set(near) == {u for p in found for u in p} and all(frozenset(x) in found for x in near.items())


def test_null_and_repeated_ids(spark):
    words = "a b c d e f g h i j k l m n o p q r s t u v w x y z".split()
    a, b = " ".join(words * 4 + [f"w{i}" for i in range(60)]), " ".join(f"v{i}" for i in range(120))
    rows = [(None, a), (5, a + " extra"), (6, a + " extra more"), (7, b), (7, "another text altogether"), (8, b + " x"), (9, "another text altogether"), (None, "alone without id"), (None, None), (10, ""), (10, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, minmax.groups(df, 3, 85).collect()), key=key)
    assert got == sorted(brute(rows, 3, 85), key=key)
    assert {(d, c) for d, _, c in got} >= {(5, None), (6, None), (8, 7), (9, 7)}
    kept = sorted(map(tuple, minmax.deduplicated(df, 3, 85).collect()), key=key)
    assert kept == sorted([(None, a), (7, b), (7, "another text altogether"), (None, "alone without id"), (None, None), (10, ""), (10, "")], key=key)


def test_long_texts_and_large_groups(spark):
    r = random.Random(4)
    long = [f"w{r.randrange(5000)}" for _ in range(60_000)]
    rows = [(1, " ".join(long)), (2, " ".join(long[:59_000])), (3, " ".join(long[:30_000]))]
    base = [f"b{i}" for i in range(60)]
    for i in range(400):  # a large group whose members differ in a word or two
        w = list(base)
        for _ in range(2):
            w[r.randrange(60)] = f"x{r.randrange(40)}"
        rows.append((10 + i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, minmax.groups(df, 3, 85).collect()), key=key)
    assert got == sorted(brute(rows, 3, 85), key=key)


def test_rows_of_cells_grow_with_the_bucket(spark, monkeypatch):
    def cells(size):
        """Cells of one bucket of so many classes; a sixteenth of them are one component, the others alone."""
        node = minmax.F.col("id")
        rows = minmax.materialize(spark.range(size).select(node.alias("node"), minmax.F.when(node % 16 == 0, 0).otherwise(node).alias("comp"), minmax.F.lit(7).cast("long").alias("band"), minmax.F.lit(4).cast("long").alias("n"), minmax.F.unhex(minmax.F.lpad(minmax.F.hex("id"), 64, "0")).alias("bits")), "test")
        return minmax._members(rows, rows, rows)

    monkeypatch.setattr(minmax, "CHUNK", 8)
    monkeypatch.setattr(minmax, "PACK", 8)
    monkeypatch.setattr(minmax, "COPIES", 6)
    small, large = cells(400), cells(3200)
    assert small.count() < 800 and large.count() < 9 * small.count()
    for made, size in ((small, 400), (large, 3200)):
        met = made.where("a = b").select(minmax.F.explode("node").alias("node"))
        assert met.count() == met.distinct().count() and 15 * size // 16 <= met.count() <= size  # each class once in its own chunk
        chunks = made.select("a").union(made.select("b")).distinct().count()
        assert made.where("at = a or at = b").count() == made.count() and chunks <= 8
        times = made.select(minmax.F.explode("node").alias("node")).groupBy("node").count().agg(minmax.F.max("count")).first()[0]
        assert times <= 8
    every = {frozenset(p) for p in minmax.block_pairs(small, 10, True).collect()}
    by_hand = {frozenset((i, j)) for i in range(400) for j in range(i) if not (i % 16 == 0 and j % 16 == 0) and (i ^ j).bit_count() * 110 <= 90 * 8}
    assert every == by_hand
    near = {u: c for u, c in minmax.block_pairs(small, 10, False).collect()}
    assert all((u ^ c).bit_count() == min((u ^ v).bit_count() for p in by_hand if u in p for v in p if v != u) for u, c in near.items()) and set(near) == {u for p in by_hand for u in p}

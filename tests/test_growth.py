"""What joins on names and files shuffle: rows of their inputs, not the pairs that they make."""

import pytest
from pyspark.sql import functions as F

from factloom.operators import imports, resolve, structure


@pytest.fixture
def shuffled(spark):
    """Runs a table whole and returns how many rows its shuffles wrote."""
    jvm, store = spark.sparkContext._jvm, spark.sparkContext._jsc.sc().statusStore()

    def stages():
        found = store.stageList(jvm.java.util.ArrayList(), False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in (found.apply(i) for i in range(found.size()))}

    def run(df):
        before = stages()
        df.write.format("noop").mode("overwrite").save()
        return sum(n for k, n in stages().items() if k not in before)

    return run


N = 300


@pytest.fixture
def sites(spark):
    """Calls of one name from N lines of one file."""
    return spark.range(N).select(F.col("id").alias("key"), F.lit("f:a:run").alias("source_id"), F.lit("run").alias("target_name"), F.lit("a.ts").alias("file_path"), F.col("id").cast("int").alias("line"), F.when(F.col("id") % 3 == 0, "member").alias("call_form"), F.lit(False).alias("constructor"))


@pytest.fixture
def nodes(spark):
    """N functions of that name, two of them in the file of the calls, the last of all the only one exported."""
    path = F.when(F.col("id") < 2, "a.ts").otherwise(F.concat(F.lit("b"), F.col("id").cast("string"), F.lit(".ts")))
    return spark.range(N).select(F.concat(F.lit("n"), F.col("id").cast("string")).alias("id"), F.lit("function").alias("kind"), F.lit("run").alias("name"), path.alias("file_path"), F.col("id").cast("int").alias("start_line"), (F.col("id") == N - 1).alias("exported"))


def test_candidates_are_numbered_by_name(shuffled, sites, nodes):
    found = resolve.callable_candidates(sites, nodes, "key")
    assert shuffled(found) < 10 * N
    rows = found.where("key = 7").orderBy("rn").collect()
    assert [r["rn"] for r in rows] == list(range(1, N + 1)) and {(r["candidate_count"], r["same_file"]) for r in rows} == {(N, 2)}
    assert [r["target_id"] for r in rows[:3]] == ["n0", "n1", "n10"] and found.count() == N * N


def test_edges_are_chosen_before_pairing(shuffled, sites, nodes):
    found = resolve.chosen(sites, nodes, "key", 2)
    assert shuffled(found) < 10 * N
    rows = {(r["key"], r["target_id"], r["resolution"], r["truncated"], r["candidate_count"]) for r in found.where("key < 2").collect()}
    assert rows == {(0, "n0", "polymorphic", True, N), (0, "n1", "polymorphic", True, N), (1, "n0", "ambiguous_name", False, N)}
    own = nodes.where("id <> 'n1'")
    rows = resolve.chosen(sites.withColumn("file_path", F.lit("b7.ts")), own, "key").where("key = 1").collect()
    assert [(r["target_id"], r["resolution"], r["confidence"], r["t_path"]) for r in rows] == [("n7", "static", "static", "b7.ts")]


def test_bound_calls_in_one_pass(shuffled, sites, nodes):
    more = sites.unionByName(sites.limit(1).withColumns({"key": F.lit(N).cast("long"), "target_name": F.lit("gone")}))
    names = nodes.sparkSession.createDataFrame([("run",), ("gone",)], "name string")
    found = resolve.rebind(more, names, nodes, "key")
    assert shuffled(found) < 10 * N
    got = {(r["key"], r["target_id"], r["resolution"], r["confidence"], r["candidate_count"], r["truncated"]) for r in found.where(f"key in (1, {N})").collect()}
    assert got == {(1, "n0", "ambiguous_name", "heuristic", N, False), (N, "unresolved:gone", "unresolved", "unresolved", None, None)}
    assert found.count() == N // 3 * 32 + N // 3 * 2 + 1


def test_best_targets_are_found_by_name(shuffled, sites, nodes):
    found = resolve.best_targets(sites, nodes, "key")
    assert shuffled(found) < 10 * N
    assert "Window" not in found._jdf.queryExecution().executedPlan().toString()  # pairs were ranked by one
    assert {r["target_id"] for r in found.collect()} == {"n0"}
    away = sites.withColumn("file_path", F.when(F.col("key") < 2, "elsewhere.ts")).withColumn("target_name", F.when(F.col("key") == 2, "gone").otherwise("run"))
    got = {r["key"]: r["target_id"] for r in resolve.best_targets(away, nodes, "key").collect()}
    assert got[0] == got[1] == got[3] == f"n{N - 1}" and got[2] == "unresolved:gone" and len(got) == N


@pytest.fixture
def probed(spark):
    """N imports from as many files of one file, which resolves, and one that does not."""
    wanted = spark.range(N + 1).select(F.col("id").alias("key"), F.concat(F.lit("src/c"), F.col("id").cast("string"), F.lit(".ts")).alias("file_path"), F.when(F.col("id") == N, "./gone").otherwise("./b").alias("specifier"))
    return imports.probed(wanted, spark.createDataFrame([("src/b.ts",), ("src/b.tsx",)], "file_path string"), "key")


def test_named_imports_meet_the_best_of_a_name(shuffled, spark, probed, nodes):
    assert {(r["resolved"], r["n"]) for r in probed.groupBy("resolved").agg(F.count("*").alias("n")).collect()} == {("src/b.ts", N), (None, 1)}
    wanted = probed.withColumn("names", F.array(F.lit("run"), F.lit("gone")))
    found = imports.named(wanted, nodes, "key")
    assert shuffled(found) < 10 * N
    assert {(r["name"], r["target_id"]) for r in found.collect()} == {("run", "n0")} and found.count() == N
    own = nodes.withColumn("file_path", F.when(F.col("id") == "n9", "src/b.ts").otherwise(F.col("file_path")))
    hops = spark.createDataFrame([("src/b.ts", "n8")], "file_path string, target_id string")
    assert {r["target_id"] for r in imports.named(wanted, own, "key", hops).collect()} == {"n9"}
    assert {r["target_id"] for r in imports.named(wanted, nodes, "key", hops).collect()} == {"n8"}


def test_wildcard_joins_lists_of_a_file(spark, probed, nodes):
    shown = nodes.withColumn("file_path", F.lit("src/b.ts")).withColumn("exported", F.col("id") != "n0")
    found = imports.wildcard(probed, shown)
    assert found.count() == N * (N - 1) and found.select("key", "target_id").distinct().count() == N * (N - 1)
    assert "target_id" in found.columns and "collect_list" in found._jdf.queryExecution().executedPlan().toString()


def test_barrels_are_distinct_before_they_meet(shuffled, probed, nodes):
    shown = nodes.withColumn("file_path", F.lit("src/b.ts")).withColumn("exported", F.col("id") != "n0")
    twice = probed.select("file_path", "resolved").unionByName(probed.select("file_path", "resolved"))
    found = imports.barrels(twice, shown.unionByName(shown))
    assert shuffled(found) < 10 * N
    assert found.count() == N * (N - 1) and found.distinct().count() == N * (N - 1)
    listed = imports.barrels(probed.withColumn("names", F.array(F.lit("run"))), shown)
    assert listed.count() == N * N and set(listed.columns) >= {"file_path", "resolved", "target_id", "name"}


def test_endpoint_handlers_are_distinct_without_a_shuffle_of_pairs(shuffled, spark, nodes):
    ends = spark.range(N).select(F.col("id").cast("string").alias("id"), F.array(F.lit("run"), F.lit("go")).alias("handlers"))
    both = nodes.unionByName(nodes.where("id = 'n5'").withColumn("name", F.lit("go")))  # one node under two names
    found = structure.endpoint_handlers(ends.unionByName(ends), both.unionByName(nodes))
    assert shuffled(found) < 15 * N
    assert found.count() == N * N and found.distinct().count() == N * N


def test_enclosing_nodes_shrink_before_they_are_shuffled(shuffled, spark):
    outer = spark.range(N).select(F.concat(F.lit("c"), F.col("id").cast("string")).alias("id"), F.lit("class").alias("kind"), F.lit("C").alias("name"), F.lit("a.ts").alias("file_path"), F.col("id").cast("int").alias("start_line"), (2000 - F.col("id")).cast("int").alias("end_line"))
    spots = spark.range(N).select(F.col("id").alias("key"), F.lit("a.ts").alias("file_path"), F.lit(1000).alias("line"))
    last = f"c{N - 1}"
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        first = structure.first_enclosing(spots, outer, "key", ["class"])
        assert shuffled(first) < 25 * N
        assert {r["owner_id"] for r in first.collect()} == {"c0"} and first.count() == N
        none = spots.withColumn("file_path", F.when(F.col("key") == 1, "b.ts").otherwise("a.ts"))
        scope = structure.enclosing_scope(none, outer, "key")
        assert {(r["key"] == 1, r["source_id"]) for r in scope.collect()} == {(True, "file:b.ts"), (False, last)} and scope.count() == N
        assert "partial_min(o_name" in first._jdf.queryExecution().executedPlan().toString()  # pairs shrink in their own task
        assert "SortAggregate" not in first._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_an_index_is_built_without_a_shuffle(spark, shuffled):
    from factloom.operators import text

    rows = spark.createDataFrame([(i, "of the Éther of this" if i % 2 else None, "the of") for i in range(N)] + [(N, "", " - ")], "id long, a string, b string")
    made = text.index(rows, "id", ["a", "b"])
    assert shuffled(made.postings) == 0
    assert made.postings.count() == N // 2 * 7 + N // 2 * 2 + N + 1  # each row has one posting more, its end
    held = text.stored(made)
    assert {r["id"]: r["len"] for r in held.lengths.collect()} == {**{i: 7 if i % 2 else 2 for i in range(N)}, N: 0}
    assert held.stats.first()["n"] == N + 1
    assert {(r["id"], r["tf"]) for r in text.phrase_hits(held.postings, ["of", "th"], "id").collect()} == {(i, 2) for i in range(1, N, 2)}
    assert text.ranked(held, "ether", "id").count() == N // 2

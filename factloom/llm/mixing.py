"""Mixing sources to target weights by pivotal dependent rounding.

A source's target share gives each of its documents the same real number of copies. Its whole part is
taken outright; the fraction is rounded by pivoting: two documents with fractions p and q and sizes v and w
trade mass along (1/v, -1/w) until one fraction is 0 or 1, in a random direction whose odds keep both
expectations. p * v + q * w stays the same, so a source's taken words equal its target up to one document.

Documents are dealt into cells of about CELL of one source and size class; a cell folds its documents
through one carried residual and hands that on. Residuals meet in cells of the next level, up a tree whose
depth is logarithmic, until each source has one residual, which is rounded by its own probability. All of it
is DataFrame expressions; randomness is a hash of the documents that trade, so reruns agree.

Cases: a null text has size 0; documents of size 0 are never taken (no words, nothing to balance) and one
source with nothing but these has target 0; null is a source, after all others; repeated rows of one id
share one decision, weighed by their number, and each stays a row; null ids are rows of their own kind; an
empty table gives an empty table; columns besides id, text and source are ignored.

The water level needs one row per source in order: that summary, not the documents, goes through one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import WORD, materialize, table

WEIGHTS = (5, 2, 1)
MOST = 3
CELL = 64
SEED = 11


def measured(docs: DataFrame) -> DataFrame:
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"))


def targets(units: DataFrame, weights: tuple = WEIGHTS, most: int = MOST) -> DataFrame:
    """`source`, `source_size`, `target` from rows with `source` and `size`.

    Sources in order of how soon they reach `most` times their size; the first k are full where sharing the
    rest by weight leaves every later source below its bound.
    """
    sums = units.groupBy("source").agg(F.sum(F.col("size") * F.col("times")).cast("long").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weighed = sums.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (place % len(weights) + 1).cast("int")).cast("long"))
    full = (F.col("source_size") * most).cast("long")
    order = Window.orderBy((full / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    so_far = order.rowsBetween(Window.unboundedPreceding, -1)
    w = weighed.withColumn("all_size", F.sum("source_size").over(whole)).withColumn("all_weight", F.sum("weight").over(whole))
    w = w.withColumn("left", F.col("all_size") - F.coalesce(F.sum(full).over(so_far), F.lit(0)))
    w = w.withColumn("left_weight", F.col("all_weight") - F.coalesce(F.sum("weight").over(so_far), F.lit(0)))
    w = w.withColumn("open", full * F.col("left_weight") >= F.col("left") * F.col("weight"))
    # the first open source fixes the level that all later ones share
    w = w.withColumn("level", F.first(F.when(F.col("open"), F.struct("left", "left_weight")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    shared = F.col("level.left") * F.col("weight") / F.col("level.left_weight")
    return w.select("source", "source_size", F.when(F.col("level").isNull(), full.cast("double")).otherwise(shared.cast("double")).alias("target"))


def _draw(*parts):
    """A number from 0 to 1 that the parts fix."""
    return F.pmod(F.xxhash64(*parts, F.lit(SEED)), F.lit(1 << 53)).cast("double") / float(1 << 53)


def _trade(carry, unit):
    """(settled, carry) after two units trade; each is (doc_id, source, size, times, base, p)."""
    v, w = carry["size"] * carry["times"], unit["size"] * unit["times"]
    up = F.least((1 - carry["p"]) * v, unit["p"] * w)  # words that can move to the carried unit
    down = F.least(carry["p"] * v, (1 - unit["p"]) * w)
    move = F.when(_draw(carry["doc_id"], unit["doc_id"], carry["size"], unit["size"]) * (up + down) < down, up).otherwise(-down)
    p, q = carry["p"] + move / v, unit["p"] - move / w
    near = 1e-9
    snap = lambda x: F.when(x < near, F.lit(0.0)).when(x > 1 - near, F.lit(1.0)).otherwise(x)
    a, b = carry.withField("p", snap(p)), unit.withField("p", snap(q))
    done = (a["p"] == 0.0) | (a["p"] == 1.0)
    return F.when(done, F.struct(a.alias("s"), b.alias("c"))).otherwise(F.struct(b.alias("s"), a.alias("c")))


def _fold(cells: DataFrame) -> DataFrame:
    """Rows with `units` become rows with `settled` (an array) and `carry`."""
    first = F.element_at("units", 1)
    kind = cells.schema["units"].dataType.elementType.simpleString()

    def step(state, unit):
        traded = _trade(state["carry"], unit)
        return F.struct(F.concat(state["settled"], F.array(traded["s"])).alias("settled"), traded["c"].alias("carry"))

    state = F.struct(F.array().cast(f"array<{kind}>").alias("settled"), first.alias("carry"))
    return cells.select(F.aggregate(F.slice("units", 2, F.size("units")), state, step).alias("f")).select("f.settled", "f.carry")


def rounded(units: DataFrame, tag: str = "mix") -> DataFrame:
    """Units (doc_id, source, size, times, base, p) with 0 < p < 1 come back with p 0 or 1."""
    names = ["doc_id", "source", "size", "times", "base", "p"]
    unit = F.struct(*names)
    level, settled = 0, []
    dealt = units.select(*names, F.floor(F.log2(F.col("size").cast("double")) * 2).cast("int").alias("class"))
    keys = ["source", "class", "cell"]
    most = dealt.groupBy("source", "class").count().agg(F.max("count")).first()[0] or 0
    dealt = dealt.withColumn("cell", F.pmod(F.xxhash64("doc_id", "size"), F.lit(max(1, -(-most // CELL)))))
    while True:
        ordered = F.sort_array(F.collect_list(F.struct(F.col("size"), F.xxhash64("doc_id").alias("h"), unit.alias("u"))))
        folded = materialize(_fold(dealt.groupBy(*keys).agg(F.transform(ordered, lambda x: x["u"]).alias("units"))), f"{tag}-{level}")
        settled.append(folded.select(F.explode("settled").alias("u")).select("u.*"))
        left = folded.select("carry.*")
        closed = (F.col("p") == 0.0) | (F.col("p") == 1.0)
        settled.append(left.where(closed))
        left = materialize(left.where(~closed), f"{tag}-left-{level}")
        most = left.groupBy("source").count().agg(F.max("count")).first()[0] or 0
        if most <= 1:
            lone = F.when(_draw("doc_id", "size") < F.col("p"), F.lit(1.0)).otherwise(F.lit(0.0))
            settled.append(left.withColumn("p", lone))
            break
        level += 1
        dealt = left.withColumn("cell", F.pmod(F.xxhash64("doc_id", F.lit(level)), F.lit(max(1, -(-most // CELL)))))
        keys = ["source", "cell"]
    out = settled[0]
    for more in settled[1:]:
        out = out.unionByName(more)
    return out


def mixed(docs: DataFrame, weights: tuple = WEIGHTS, most: int = MOST) -> DataFrame:
    """`doc_id`, `source`, `size`, `times` (rows alike), `source_size`, `target` and `copies`."""
    units = materialize(measured(docs).groupBy("doc_id", "source", "size").agg(F.count("*").alias("times")), "units")
    goal = materialize(targets(units, weights, most), "targets")
    rows = units.join(goal.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    real = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = rows.withColumn("real", F.least(real, F.lit(float(most)))).withColumn("base", F.floor("real").cast("int")).withColumn("p", F.col("real") - F.col("base"))
    flat = F.col("size") == 0
    sure = flat | (F.col("p") < 1e-9) | (F.col("p") > 1 - 1e-9)
    fixed = rows.where(sure).select("doc_id", "source", "size", "times", F.when(flat, 0).otherwise(F.col("base") + F.round("p").cast("int")).alias("copies"))
    drawn = rounded(rows.where(~sure).select("doc_id", "source", "size", "times", "base", "p"))
    both = fixed.unionByName(drawn.select("doc_id", "source", "size", "times", (F.col("base") + F.col("p").cast("int")).alias("copies")))
    return both.join(goal.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")


def blended(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, each as often as the mix takes it.

    Decisions are as many as documents, so they are never broadcast: both sides are shuffled, at any size.
    """
    names = docs.columns
    take = materialize(mixed(docs).where("copies > 0").select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("size").alias("_size"), F.col("copies").alias("_copies")), "take")
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("source").eqNullSafe(F.col("_source")) & (size == F.col("_size"))
    return docs.join(take.hint("merge"), same).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*names)


def op5_pivotal_mix(spark, sf_dir: str) -> DataFrame:
    out = mixed(table(spark, sf_dir, "documents"))
    each = out.withColumn("one", F.explode(F.sequence(F.lit(1), F.col("times"))))
    return each.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"))

"""Call graphs: neighbourhoods, levels and shortest paths over static edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions.storage import discard, materialize
from factloom.operators.scan import static_only

VISITED = 5000


def static_calls(edges: DataFrame) -> DataFrame:
    return static_only(edges.where("kind = 'calls'"))


def real(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges both of whose ends are nodes."""
    end = nodes.select("id")
    out = edges.join(end.withColumnRenamed("id", "source_id"), "source_id", "left_semi")
    return out.join(end.withColumnRenamed("id", "target_id"), "target_id", "left_semi").select(edges.columns)


def frontier(edges: DataFrame, nodes: DataFrame, sources: DataFrame) -> DataFrame:
    """Static calls from the nodes of `sources` (id), both ends real, in edge order."""
    out = real(static_calls(edges).join(sources.select(F.col("id").alias("source_id")), "source_id", "left_semi"), nodes)
    return out.select("source_id", "target_id", "file_path", "line").orderBy("source_id", "target_id", "file_path", "line")


def levels(edges: DataFrame, nodes: DataFrame, start: str, depth: int | None = None, stop: str | None = None, most: int | None = VISITED) -> DataFrame:
    """Breadth first from start: a stored table of each node found (`id`), its `level` and `e`, the edge that found it.

    What has been found stays a table, a part for each level; the driver knows its size alone. With `most`, no
    more nodes than that are found, those of the smallest edges first.
    """
    hops = materialize(static_calls(edges).join(nodes.select(F.col("id").alias("target_id")), "target_id", "left_semi").select("source_id", "target_id", "file_path", "line"), "hops")
    edge = F.struct("source_id", "target_id", "file_path", "line")
    first = hops.sparkSession.range(1).select(F.lit(start).alias("id"), F.lit(0).alias("level"), F.lit(None).cast(hops.select(edge.alias("e")).schema["e"].dataType).alias("e"))
    parts = [materialize(first, "level-0")]
    found, size, level = parts[0], 1, 0
    while (depth is None or level < depth) and (most is None or size < most):
        if stop is not None and not parts[-1].where(F.col("id") == stop).isEmpty():
            break
        level += 1
        now = parts[-1].select(F.col("id").alias("source_id"))
        new = hops.join(now, "source_id", "left_semi").join(found.select(F.col("id").alias("target_id")), "target_id", "left_anti")
        best = new.groupBy(F.col("target_id").alias("id")).agg(F.min(edge).alias("e")).select("id", F.lit(level).alias("level"), "e")
        parts.append(materialize(best if most is None else best.orderBy("e").limit(most - size), f"level-{level}"))
        more = parts[-1].count()
        if not more:
            break
        size, found = size + more, found.unionByName(parts[-1])
    out = materialize(found, "levels")
    discard(hops, *parts)
    return out


def shortest_path(edges: DataFrame, nodes: DataFrame, start: str, goal: str, most: int | None = VISITED) -> list[dict] | None:
    """The edges from start to goal, none for the same node; None if there is no static path.

    The way back is one lookup for each edge of the path.
    """
    found = levels(edges, nodes, start, stop=goal, most=most)
    at = found.where(F.col("id") == goal).first()
    out = []
    while at is not None and at["e"] is not None:
        out.append(at["e"].asDict())
        at = found.where((F.col("id") == at["e"]["source_id"]) & (F.col("level") == at["level"] - 1)).first()
    discard(found)
    return None if at is None else out[::-1]


def neighbourhood(edges: DataFrame, nodes: DataFrame, node: str) -> DataFrame:
    """Calls and references from and to a node, both ends real: one tagged union, one job."""
    near = edges.where(F.col("kind").isin("calls", "references")).where((F.col("source_id") == node) | (F.col("target_id") == node))
    way = F.explode(F.array_compact(F.array(F.when(F.col("source_id") == node, "out"), F.when(F.col("target_id") == node, "in"))))
    return real(near, nodes).select("source_id", "target_id", "kind", "file_path", "line", way.alias("direction"))


def sections(near: DataFrame) -> DataFrame:
    """A neighbourhood as callers, callees and references both ways: `section`, `other`, `line`."""
    out = F.col("direction") == "out"
    section = F.when((F.col("kind") == "calls") & out, "callees").when(F.col("kind") == "calls", "callers").when(out, "references_out").otherwise("references_in")
    return near.select(section.alias("section"), F.when(out, F.col("target_id")).otherwise(F.col("source_id")).alias("other"), "line")


def tested(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """`id` of the test nodes with a static call on either side."""
    static, tests = static_calls(edges), nodes.where("is_test").select("id")
    by = lambda side: tests.join(static.select(F.col(side).alias("id")), "id", "left_semi")
    return by("source_id").unionByName(by("target_id")).distinct()


def related_tests(edges: DataFrame, nodes: DataFrame, node: str, name: str, file_path: str) -> DataFrame:
    """Test nodes with a static edge to or from the node, those with its name or in its file first."""
    static = static_only(edges)
    near = static.where(F.col("target_id") == node).select(F.col("source_id").alias("id")).unionByName(static.where(F.col("source_id") == node).select(F.col("target_id").alias("id")))
    tests = nodes.where("is_test").join(near.distinct(), "id", "left_semi").where(F.col("id") != node)
    return tests.withColumn("by_name", F.instr(F.lower("name"), name.lower()) > 0).withColumn("same_file", F.col("file_path") == file_path)

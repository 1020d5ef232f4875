"""Structure inside a file: nesting, scopes and duplicates. Ranges always meet within one file."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.names import BUILTIN_TYPES, CALLABLES, CONTAINERS, specificity
from factloom.functions.storage import dealt

#: Bin widths as powers of two; a range goes to the narrowest that is as long as itself, so it lies in two bins at most.
WIDTHS = range(3, 32, 3)


def first_of(df: DataFrame, key: list[str], *order) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def kind_dedup(captures: DataFrame) -> DataFrame:
    """Of captures that share file, name and first line, the most specific kind, then the first match."""
    return first_of(captures, ["file_path", "name", "start_line"], specificity(F.col("kind")).desc(), F.col("match_index"))


def _around(inner: DataFrame, outer: DataFrame, kinds: list[str], left: bool = False) -> DataFrame:
    """Pairs of a row and the nodes of the kinds whose lines cover it (outer columns start with o_).

    Rows meet by file and bin of lines, so what a large file costs follows from what covers what, not from the
    square of its nodes. With left, a row that nothing covers comes out once.
    """
    o = outer.where(F.col("kind").isin(kinds)).select(*[F.col(c).alias(f"o_{c}") for c in ("id", "name", "file_path", "start_line", "end_line")])
    width = F.lit(WIDTHS[-1])
    for w in reversed(WIDTHS[:-1]):
        width = F.when(F.col("o_end_line") - F.col("o_start_line") < 1 << w, w).otherwise(width)
    o = o.withColumn("o_width", width)
    first, last = (F.expr(f"shiftright(o_{c}, o_width)") for c in ("start_line", "end_line"))
    o = o.where("o_end_line >= o_start_line").withColumn("o_bin", F.explode(F.sequence(first, last)))
    bins = F.explode(F.array(*[F.struct(F.lit(w).alias("w"), F.shiftright("start_line", w).alias("b")) for w in WIDTHS]))
    spots = inner.withColumn("_at", bins)
    covers = (F.col("o_file_path") == F.col("file_path")) & (F.col("o_width") == F.col("_at.w")) & (F.col("o_bin") == F.col("_at.b"))
    covers = covers & (F.col("o_start_line") <= F.col("start_line")) & (F.col("o_end_line") >= F.col("end_line")) & (F.col("o_id") != F.col("id").cast("string"))
    met = spots.join(o, covers, "left" if left else "inner")
    if left:  # one unmatched row is enough
        met = met.where(F.col("o_id").isNotNull() | (F.col("_at.w") == WIDTHS[-1]))
    return met.drop("_at", "o_width", "o_bin")


def _first_around(inner: DataFrame, outer: DataFrame, kinds: list[str], order, left: bool = False) -> DataFrame:
    """Rows of inner (id, file_path, start_line, end_line), each with `o_id` of the first node around it, by order(start, end).

    Nodes are numbered in their file, so that the pairs of _around() shrink to the least number where they arise and
    are neither shuffled nor sorted.
    """
    o = outer.where(F.col("kind").isin(kinds))
    rank = F.row_number().over(Window.partitionBy("file_path").orderBy(*order(F.col("start_line"), F.col("end_line")), "id"))
    o = o.select("id", "file_path", "start_line", "end_line", "kind", rank.alias("name"))
    place = ["id", "file_path", "start_line", "end_line"]
    least = _around(inner.select(place), o, kinds, left).groupBy(place).agg(F.min("o_name").alias("_rank"))
    names = o.select(F.col("file_path"), F.col("name").alias("_rank"), F.col("id").alias("o_id"), F.col("start_line").alias("o_start_line"), F.col("end_line").alias("o_end_line"))
    found = least.join(names, ["file_path", "_rank"], "left" if left else "inner")
    ends = order(F.col("o_start_line"), F.col("o_end_line"))
    return first_of(found, ["id"], F.col("o_id").isNull(), *ends, "o_id")


def qualified_names(nodes: DataFrame) -> DataFrame:
    """`id`, `qualified_name` of methods and properties inside containers, outermost container first."""
    members = nodes.where(F.col("kind").isin("method", "property"))
    found = _around(members, nodes, CONTAINERS)
    span = F.col("o_end_line") - F.col("o_start_line")
    listed = F.sort_array(F.collect_list(F.struct((-span).alias("w"), F.col("o_start_line").alias("s"), F.col("o_id").alias("i"), F.col("o_name").alias("n"))))
    return found.groupBy("id", "name").agg(listed.alias("l")).select("id", F.concat_ws(".", F.transform("l", lambda x: x["n"]), F.col("name")).alias("qualified_name"))


def containment(nodes: DataFrame) -> DataFrame:
    """Edges from each method's tightest container (the one that starts last) to the method."""
    best = _first_around(nodes.where("kind = 'method'"), nodes, CONTAINERS, lambda start, end: [start.desc()])
    return best.select(F.col("o_id").alias("source_id"), F.col("id").alias("target_id"), F.lit("contains").alias("kind"), "file_path", F.col("start_line").alias("line"))


def enclosing_scope(sites: DataFrame, nodes: DataFrame, key: str) -> DataFrame:
    """`key`, `source_id` for sites (key, file_path, line): the shortest function, method or class around, else the file."""
    spots = sites.select(F.col(key).alias("id"), "file_path", F.col("line").alias("start_line"), F.col("line").alias("end_line"))
    best = _first_around(spots, nodes, [*CALLABLES, "class"], lambda start, end: [end - start, start], left=True)
    return best.select(F.col("id").alias(key), F.coalesce("o_id", F.concat(F.lit("file:"), "file_path")).alias("source_id"))


def first_enclosing(sites: DataFrame, nodes: DataFrame, key: str, kinds: list[str]) -> DataFrame:
    """`key`, `owner_id` of the first node (by line) of the kinds that covers the site."""
    spots = sites.select(F.col(key).alias("id"), "file_path", F.col("line").alias("start_line"), F.col("line").alias("end_line"))
    best = _first_around(spots, nodes, kinds, lambda start, end: [start])
    return best.select(F.col("id").alias(key), F.col("o_id").alias("owner_id"))


def top_level(nodes: DataFrame, scopes: DataFrame) -> DataFrame:
    """Without the variables inside another function or method of their file."""
    inside = _around(nodes.where("kind = 'variable'").select("id", "file_path", "start_line", "end_line"), scopes, CALLABLES)
    place = ["id", "file_path", "start_line", "end_line"]
    return nodes.join(inside.select(*place, F.lit("variable").alias("kind")).distinct(), [*place, "kind"], "left_anti").select(nodes.columns)


def endpoint_handlers(endpoints: DataFrame, nodes: DataFrame) -> DataFrame:
    """Heuristic references from endpoints (id, handlers) to every function or method of a handler's name.

    Endpoints and nodes come once each, with all their names, and a pair counts at the first name that they share, so
    the pairs are distinct without a shuffle of them.
    """
    handlers = F.array_distinct(F.flatten(F.collect_list(F.coalesce("handlers", F.array().cast("array<string>"))))).alias("_handlers")
    wanted = endpoints.groupBy(F.col("id").alias("source_id")).agg(handlers).withColumn("name", F.explode("_handlers"))
    named = nodes.where(F.col("kind").isin(CALLABLES)).groupBy(F.col("id").alias("target_id")).agg(F.collect_set("name").alias("_names"))
    met = dealt(wanted, "name").join(named.withColumn("name", F.explode("_names")), "name")
    once = (F.size("_names") == 1) | (F.size("_handlers") == 1) | (F.col("name") == F.array_min(F.array_intersect("_handlers", "_names")))
    return met.where(once).select("source_id", "target_id").withColumn("confidence", F.lit("heuristic"))


def type_references(mentions: DataFrame) -> DataFrame:
    """Mentions (target_name) of types that are not built in."""
    return mentions.where(~F.col("target_name").isin(sorted(BUILTIN_TYPES)))


def excerpt_lines(lines: DataFrame, most: int) -> DataFrame:
    """Whole lines (key, i, line) from the first on while their bytes, a newline each, stay within `most`."""
    so_far = F.sum(F.octet_length("line") + 1).over(Window.partitionBy("key").orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    return lines.withColumn("bytes_so_far", so_far).where(F.col("bytes_so_far") <= most)

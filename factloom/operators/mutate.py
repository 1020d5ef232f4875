"""Changes of fact tables as new tables: a snapshot is rewritten, never updated in place."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

EDGE_KEY = ["source_id", "target_id", "kind", "file_path", "line"]


def upsert(old: DataFrame, new: DataFrame, key: list[str], order: str | None = None) -> DataFrame:
    """old with new's rows in place of those with their key; of new rows alike, the last by `order` stands."""
    if order:
        last = F.row_number().over(Window.partitionBy(*key).orderBy(F.col(order).desc()))
        new = new.withColumn("_n", last).where("_n = 1").drop("_n", order)
    return old.join(new.select(*key), key, "left_anti").unionByName(new)


def delete_keep_incoming(edges: DataFrame, paths: DataFrame) -> DataFrame:
    """Without the edges that the files emit; edges from elsewhere stay."""
    return edges.join(paths.select("file_path"), "file_path", "left_anti")


def delete_incident(edges: DataFrame, nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """Without any edge from or to a node of the files."""
    gone = nodes.join(paths.select("file_path"), "file_path", "left_semi").select("id")
    out = edges.join(gone.withColumnRenamed("id", "source_id"), "source_id", "left_anti")
    return out.join(gone.withColumnRenamed("id", "target_id"), "target_id", "left_anti")


def replace_file(rows: DataFrame, paths: DataFrame, new: DataFrame) -> DataFrame:
    return delete_keep_incoming(rows, paths).unionByName(new)


def drop_resolved_imports(edges: DataFrame) -> DataFrame:
    return edges.where((F.col("kind") != "imports") | F.col("target_id").startswith("module:"))


def replace_occurrences(edges: DataFrame, gone: DataFrame, new: DataFrame) -> DataFrame:
    return upsert(edges.join(gone.select(*EDGE_KEY), EDGE_KEY, "left_anti"), new, EDGE_KEY)


def snapshot_states(old: DataFrame, new: DataFrame, key: str = "file_path") -> DataFrame:
    """Each path's state between two tables (key, content_hash): added, removed, changed or same."""
    a = old.select(F.col(key), F.col("content_hash").alias("_old"))
    b = new.select(F.col(key), F.col("content_hash").alias("_new"))
    state = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(F.col("_old") != F.col("_new"), "changed").otherwise("same")
    return a.join(b, key, "full_outer").select(key, state.alias("state"))


def vanished(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.join(new.select("file_path"), "file_path", "left_anti")


def changed_names(*tables: DataFrame) -> DataFrame:
    out = tables[0].select("name")
    for t in tables[1:]:
        out = out.unionByName(t.select("name"))
    return out.distinct()


def remove_files(edges: DataFrame, hashes: DataFrame, unresolved: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Edges, hashes and unresolved references without what the files hold; edges from elsewhere stay."""
    return delete_keep_incoming(edges, paths), vanished(hashes, paths), vanished(unresolved, paths)


def replace_unresolved(old: DataFrame, paths: DataFrame, new: DataFrame) -> DataFrame:
    """Unresolved references with those of the files replaced; rows alike count once."""
    return vanished(old, paths).unionByName(new).distinct()


def retained(old: DataFrame, paths: DataFrame, new: DataFrame) -> DataFrame:
    """What other files hold and what the files hold now, rows alike once."""
    return vanished(old, paths).unionByName(new.join(paths.select("file_path"), "file_path", "left_semi").select(old.columns)).distinct()


def exact_first(exact: DataFrame, more: DataFrame) -> DataFrame:
    """exact and those of more that it lacks, by id."""
    return exact.unionByName(more.join(exact.select("id"), "id", "left_anti").select(exact.columns))

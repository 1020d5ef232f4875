"""Scans, lookups and projections of fact tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.names import by_extension, in_path


def fingerprints(files: DataFrame) -> DataFrame:
    """files (file_path, text) with `content_hash` and `language`; other extensions go."""
    return files.select("file_path", F.sha2("text", 256).alias("content_hash"), by_extension(F.col("file_path")).alias("language")).where("language is not null")


def in_order(nodes: DataFrame) -> DataFrame:
    return nodes.orderBy("file_path", "start_line", *(["start_column"] if "start_column" in nodes.columns else []), "id")


def edges_in_order(edges: DataFrame) -> DataFrame:
    return edges.orderBy("source_id", "target_id", "kind", "file_path", "line")


def nodes_where(nodes: DataFrame, node_id: str | None = None, file_path: str | None = None, name: str | None = None, kind: str | None = None, prefix: str | None = None) -> DataFrame:
    """Nodes that meet all the conditions given."""
    out = nodes
    for column, value in (("id", node_id), ("file_path", file_path), ("name", name), ("kind", kind)):
        if value is not None:
            out = out.where(F.col(column) == value)
    return out.where(in_path(F.col("file_path"), prefix)) if prefix else out


def raw_imports(edges: DataFrame) -> DataFrame:
    return edges.where((F.col("kind") == "imports") & F.col("target_id").startswith("module:"))


def unresolved(edges: DataFrame) -> DataFrame:
    """(source_id, specifier, file_path, line) of the imports that are still specifiers."""
    return raw_imports(edges).select("source_id", F.expr("substring(target_id, 8)").alias("specifier"), "file_path", "line")


def excluded(nodes: DataFrame, names: list[str]) -> DataFrame:
    return nodes.where(~F.col("name").isin(names))


def hash_table(hashes: DataFrame) -> DataFrame:
    return hashes.select("file_path", "content_hash", "language")


def out_edges(edges: DataFrame, sources: DataFrame, kind: str | None = None) -> DataFrame:
    """Edges whose source is in `sources` (id)."""
    found = edges if kind is None else edges.where(F.col("kind") == kind)
    return found.join(sources.select(F.col("id").alias("source_id")), "source_id", "left_semi")


def in_edges(edges: DataFrame, targets: DataFrame, kind: str | None = None) -> DataFrame:
    found = edges if kind is None else edges.where(F.col("kind") == kind)
    return found.join(targets.select(F.col("id").alias("target_id")), "target_id", "left_semi")


def confidence_of(edges_props: Column) -> Column:
    return F.coalesce(edges_props, F.lit("static"))


def static_only(edges: DataFrame) -> DataFrame:
    """Edges that are not labelled heuristic; no label means static."""
    return edges.where(confidence_of(F.col("confidence")) != "heuristic")


def symbol_facts(nodes: DataFrame, hashes: DataFrame) -> DataFrame:
    """Nodes with the hash of their file, the extractor and the confidence of their kind."""
    kind = F.col("kind")
    python = (F.col("language") == "python") if "language" in nodes.columns else F.lit(False)
    extractor = F.when(kind == "endpoint", "route-pattern").when(kind == "heading", "markdown-heading").when(python, "python-ast").otherwise("declaration-pattern")
    confidence = F.when(kind == "endpoint", "heuristic").otherwise("static")
    hashed = hashes.select("file_path", F.col("content_hash").alias("source_hash"))
    return nodes.join(hashed, "file_path", "left").withColumn("extractor", extractor).withColumn("confidence", confidence)


def relationship_facts(edges: DataFrame, nodes: DataFrame, hashes: DataFrame) -> DataFrame:
    """Edges both of whose ends are nodes, with the ends' names and the hash of the edge's file."""
    end = lambda side: nodes.select(F.col("id").alias(f"{side}_id"), F.col("name").alias(f"{side}_name"), F.col("file_path").alias(f"{side}_path"))
    hashed = hashes.select("file_path", F.col("content_hash").alias("source_hash"))
    out = edges.join(end("source"), "source_id").join(end("target"), "target_id").join(hashed, "file_path", "left")
    return out.withColumn("confidence", confidence_of(F.col("confidence")))

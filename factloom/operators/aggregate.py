"""Counts and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def node_stats(nodes: DataFrame) -> DataFrame:
    return nodes.agg(F.count("*").alias("nodes"), F.count_distinct("file_path").alias("files"))


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return node_stats(nodes).crossJoin(edges.agg(F.count("*").alias("edges")))


def counted(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))


def by_language(nodes: DataFrame, hashes: DataFrame) -> DataFrame:
    """Nodes by the language of their file, `none` where it has no hash."""
    joined = nodes.select("file_path").join(hashes.select("file_path", "language"), "file_path", "left")
    return counted(joined.select(F.coalesce("language", F.lit("none")).alias("language")), "language")


# Language servers and the languages they read.
PROVIDERS = {"rust-analyzer": ["rust"], "typescript-language-server": ["typescript", "tsx", "javascript", "jsx"]}


def providers(nodes: DataFrame) -> DataFrame:
    """`provider` (null for languages without one), how many `languages` of its own there are, and `n`, their nodes."""
    provider = F.lit(None).cast("string")
    for name, languages in PROVIDERS.items():
        provider = F.when(F.col("language").isin(languages), name).otherwise(provider)
    by = counted(nodes, "language")
    return by.groupBy(provider.alias("provider")).agg(F.count("*").alias("languages"), F.sum("n").alias("n"))


def unresolved_report(refs: DataFrame, samples: int = 20) -> DataFrame:
    """The first `samples` references in order, each with the number of all and whether more follow."""
    top = refs.orderBy("file_path", "line", "specifier").limit(samples)
    return top.crossJoin(refs.agg(F.count("*").alias("total"))).withColumn("truncated", F.col("total") > samples)


def nearest_rank(df: DataFrame, key: str, value: str) -> DataFrame:
    """Smallest, median, 95th percentile (nearest rank) and largest value of each key."""
    at = lambda p: F.expr(f"percentile_disc({p}) within group (order by {value})")
    return df.groupBy(key).agg(F.min(value).alias("least"), at(0.5).alias("median"), at(0.95).alias("p95"), F.max(value).alias("most"))


def candidate_counts(sites: DataFrame, nodes: DataFrame, key: str) -> DataFrame:
    """How many functions and methods each call site's name has."""
    n = nodes.where(F.col("kind").isin("function", "method")).groupBy(F.col("name").alias("target_name")).agg(F.count("*").alias("candidate_count"))
    return sites.join(n, "target_name").select(key, "target_name", "candidate_count")


def report(nodes: DataFrame, edges: DataFrame, files: DataFrame, unresolved: DataFrame) -> DataFrame:
    """The counts of a repository as rows (`fact`, `label`, `n`)."""
    part = lambda df, fact, label: counted(df.select(F.col(label).alias("label")), "label").select(F.lit(fact).alias("fact"), "label", "n")
    lost = unresolved.agg(F.count("*").alias("n")).select(F.lit("unresolved").alias("fact"), F.lit("import").alias("label"), "n")
    return part(nodes, "symbols", "kind").unionByName(part(edges, "relationships", "kind")).unionByName(part(files, "files", "language")).unionByName(lost)

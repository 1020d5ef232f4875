"""Stored rows with a JSON envelope: reading them with loose fallbacks, and writing the envelope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.names import edge_kind_or, kind_or, language_or, truncated

BODY_BYTES = 4096


def json_text(envelope: Column, name: str) -> Column:
    """A string of the envelope; null for anything that isn't one, or where the envelope is no JSON."""
    value = F.variant_get(F.try_parse_json(envelope), f"$.{name}", "variant")
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))


def json_flag(envelope: Column, name: str) -> Column:
    value = F.variant_get(F.try_parse_json(envelope), f"$.{name}", "variant")
    return F.when(F.schema_of_variant(value) == "BOOLEAN", F.try_variant_get(value, "$", "boolean"))


def decoded_nodes(rows: DataFrame) -> DataFrame:
    """Rows (…, kind, language, metadata) with `body` and `exported` from the envelope; an unknown kind is a variable, an unknown language TypeScript."""
    out = rows.withColumn("body", json_text(F.col("metadata"), "body")).withColumn("exported", json_flag(F.col("metadata"), "exported"))
    return out.withColumn("kind", kind_or(F.col("kind"), "variable")).withColumn("language", language_or(F.col("language"), "typescript")).drop("metadata")


def decoded_edges(rows: DataFrame) -> DataFrame:
    """Rows (…, kind, file_path, line, properties); an empty path or line 0 comes from the envelope, an unknown kind is a reference."""
    envelope = F.col("properties")
    path = F.when(F.coalesce("file_path", F.lit("")) == "", F.coalesce(json_text(envelope, "filePath"), F.lit(""))).otherwise(F.col("file_path"))
    line = F.when(F.coalesce("line", F.lit(0)) == 0, F.coalesce(F.expr("try_cast(_line as int)"), F.lit(0))).otherwise(F.col("line"))
    out = rows.withColumn("_line", json_text(envelope, "line")).withColumn("file_path", path).withColumn("line", line)
    return out.withColumn("kind", edge_kind_or(F.col("kind"), "references")).withColumn("confidence", json_text(envelope, "confidence")).drop("_line", "properties")


def node_envelope(nodes: DataFrame) -> Column:
    """The JSON of a node's columns, body and export mark; the body within BODY_BYTES."""
    return F.to_json(F.struct(F.col("start_column").alias("startColumn"), F.col("end_column").alias("endColumn"), truncated(nodes["body"], BODY_BYTES).alias("body"), nodes["exported"].alias("exported")))


def edge_envelope(props: Column, path: Column, line: Column) -> Column:
    """The JSON of an edge's properties (a map of strings) with its place, which stands over a property of that name."""
    own = F.map_filter(F.coalesce(props, F.create_map().cast("map<string,string>")), lambda k, v: ~k.isin("filePath", "line"))
    return F.to_json(F.map_concat(own, F.create_map(F.lit("filePath"), path, F.lit("line"), line.cast("string"))))

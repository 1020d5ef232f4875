"""Markdown facts over exploded lines (file_path, i, line)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.names import anchor


def lines(files: DataFrame, key: str = "file_path") -> DataFrame:
    return files.select(key, F.posexplode(F.split("text", "\n")).alias("_p", "line")).select(key, (F.col("_p") + 1).cast("int").alias("i"), "line")


def headings(of_lines: DataFrame, key: str = "file_path") -> DataFrame:
    """(key, i, level, title): up to six #, white space, a title; nothing between fences."""
    trimmed = F.regexp_replace("line", r"^\s+", "")
    fence = trimmed.startswith("```") | trimmed.startswith("~~~")
    before = F.sum(fence.cast("int")).over(Window.partitionBy(key).orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    title = F.trim(F.regexp_replace(F.trim(F.regexp_extract(trimmed, r"^#{1,6}\s(.*)$", 1)), "#+$", ""))
    marked = of_lines.withColumn("_open", before % 2).withColumn("_fence", fence)
    out = marked.where(~F.col("_fence") & (F.col("_open") == 0)).select(key, "i", F.length(F.regexp_extract(trimmed, r"^(#{1,6})\s", 1)).alias("level"), title.alias("title"))
    return out.where("level > 0 and title <> ''")


def sections(heads: DataFrame, totals: DataFrame, key: str = "file_path") -> DataFrame:
    """heads (key, i, level) with `end_line`, the line before the next heading of its level or above, else the last (`n` of totals)."""
    w = Window.partitionBy(key).orderBy(F.desc("i")).rowsBetween(Window.unboundedPreceding, -1)
    end = F.lit(None).cast("int")
    for k in range(6, 0, -1):
        end = F.when(F.col("level") == k, F.min(F.when(F.col("level") <= k, F.col("i"))).over(w) - 1).otherwise(end)
    ends = heads.select(key, "i", "level", end.alias("_end"))
    return ends.join(totals, key).select(key, "i", "level", F.coalesce("_end", "n").alias("end_line"))


def parents(heads: DataFrame, key: str = "file_path") -> DataFrame:
    """heads with `parent_line`, the latest heading before with a smaller level."""
    w = Window.partitionBy(key).orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    best = F.lit(None).cast("int")
    for k in range(6, 0, -1):
        last = F.max(F.when(F.col("level") < k, F.col("i"))).over(w)
        best = F.when(F.col("level") == k, last).otherwise(best)
    return heads.withColumn("parent_line", best)


def anchors(heads: DataFrame, key: str = "file_path") -> DataFrame:
    """heads with `anchor`; a later one alike gets -1, -2 and so on."""
    base = heads.withColumn("_a", anchor(F.col("title")))
    n = F.row_number().over(Window.partitionBy(key, "_a").orderBy("i")) - 1
    return base.withColumn("anchor", F.when(n == 0, F.col("_a")).otherwise(F.concat_ws("-", "_a", n.cast("string")))).drop("_a")


def links(of_lines: DataFrame) -> DataFrame:
    """(file_path, i, target) of links to anchors, outside fences, inline code and images."""
    trimmed = F.regexp_replace("line", r"^\s+", "")
    fence = trimmed.startswith("```") | trimmed.startswith("~~~")
    opened = F.sum(fence.cast("int")).over(Window.partitionBy("file_path").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)) % 2
    plain = of_lines.withColumn("_o", opened).where(~fence & (F.col("_o") == 0)).withColumn("line", F.regexp_replace("line", "`[^`]*`", ""))
    found = F.explode(F.regexp_extract_all("line", F.lit(r"(?<!!)\[[^\]]*\]\(\s*<?#([^)>]*)>?\s*\)"), 1))
    return plain.select("file_path", "i", found.alias("t")).select("file_path", "i", anchor(F.col("t")).alias("target"))

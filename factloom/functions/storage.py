"""Tables in the folder that driver and executors share: where lineage ends, and what outlives a lost executor."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; only a local session (tests) may do without and gets a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not is_local(spark):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="factloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends there and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df by hash of the keys over all shuffle partitions, where a join makes many rows of few bytes.

    Adaptive execution would merge partitions that are small before the join and leave it to a few tasks.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def discard(*tables: DataFrame | None) -> None:
    """Deletes stored tables (None is passed over) that no later plan reads."""
    for df in tables:
        if df is not None:
            sc = df.sparkSession.sparkContext
            path = sc._jvm.org.apache.hadoop.fs.Path(df.stored_at)
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def _file_system(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file of any storage that Spark reads; None if there is none."""
    at, files = _file_system(spark, path)
    if not files.exists(at):
        return None
    stream = files.open(at)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small file beside its place and moves it there, so that readers see the old one or the new one whole."""
    jvm = spark.sparkContext._jvm
    spare, files = _file_system(spark, path + ".next")
    stream = files.create(spare, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    over = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    over[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(files.makeQualified(spare), files.makeQualified(jvm.org.apache.hadoop.fs.Path(path)), over)


def delete(spark: SparkSession, path: str) -> None:
    at, files = _file_system(spark, path)
    files.delete(at, True)


def is_local(spark: SparkSession) -> bool:
    """Whether driver and executors are one process, so that they share every folder."""
    return spark.sparkContext.master.split("[")[0] == "local"

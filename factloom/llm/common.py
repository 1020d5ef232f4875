"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.storage import discard, shared_dir
from factloom.functions.storage import materialize as _materialize

__all__ = ["BATCH", "WORD", "ascii_lower", "ascii_lower_col", "byte_words", "discard", "find_words", "fold", "give_back", "lower_byte_words", "materialize", "shared_dir", "sliced", "table", "text_batches", "tidy"]

#: Rows of an Arrow batch of whole texts, in place of Spark's default of 10,000.
BATCH = 2000
#: Bytes of a slice of an Arrow batch, from which Python objects are made at once.
SLICE = 2_000_000

#: A word: a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
find_words = re.compile(WORD).findall

_UPPER = {c: c + 32 for c in range(65, 91)}


def ascii_lower(text: str) -> str:
    """Lower-cases A-Z only."""
    return text.lower() if text.isascii() else text.translate(_UPPER)


def byte_words(text: str | None) -> list[bytes]:
    """The words as UTF-8: bytes split at just the six white-space characters."""
    return text.encode().split() if text else []


def lower_byte_words(text: str | None) -> list[bytes]:
    """The same with A-Z lower-cased, which is all that bytes lower-case."""
    return text.encode().lower().split() if text else []


def ascii_lower_col(column):
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def text_batches(spark: SparkSession) -> None:
    """Sees to it that workers get whole texts in small batches, unless the session has a bound of its own."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(BATCH))


def give_back() -> None:
    """Returns a worker's free memory to the system; for the end of a task, as workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def sliced(batches):
    """The batches in slices of about SLICE bytes, without a copy: what is made of their rows stays small, too."""
    for batch in batches:
        rows = max(1, batch.num_rows * SLICE // max(SLICE, batch.nbytes))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def tidy(run):
    """run, a generator over batches, and then give_back(), once all that run held is free."""

    def tidied(batches):
        yield from run(batches)
        give_back()

    return tidied


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    text_batches(df.sparkSession)
    return _materialize(df, tag)


def fold(column, modulus: int):
    """crc32 of the id as text, modulo `modulus`; a null id counts as the empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % modulus

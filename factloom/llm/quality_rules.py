"""Quality rules and a hashed n-gram log-likelihood ratio.

Words and pairs of neighbouring words are hashed into BUCKETS counters each. Two multinomials are counted,
one over the trusted target (documents that `labels` rates as good) and one over the whole raw corpus. A
document's verdict is the mean, over its n-grams, of log(LAMBDA * target / raw + 1 - LAMBDA), against a fixed
threshold; mixing the raw corpus into the target bounds what an n-gram that the target lacks can cost.

The target is a bounded sample: of the trusted ids the TRUSTED with the smallest hash, which also bounds
what is broadcast. Raw counts and verdicts cover every document.

Cases: a null text has no words and fails the base rules; so does an empty one; without any trusted document
the ratio is 0 for every n-gram; repeated rows and null ids are scored as rows of their own; an empty table
gives an empty table; columns besides id and text are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import byte_words, find_words, lower_byte_words, table

BUCKETS = 1 << 15
TRUSTED = 100_000
LAMBDA = 0.5
THRESHOLD = -0.07
SYMBOLS = "#*$%&|<>"
WHITE = " \t\n\v\f\r"
_MEMO = 300_000


class _Hashes(dict):
    def __missing__(self, word):
        if len(self) > _MEMO:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


_hashes = _Hashes()


def ngram_buckets(words: list[bytes]) -> np.ndarray:
    """A bucket for each word, then BUCKETS plus a bucket for each pair."""
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    bits = np.uint64(64 - (BUCKETS.bit_length() - 1))
    pairs = (h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]) * np.uint64(0xD6E8FEB86659FD93)
    return np.concatenate([h >> bits, (pairs >> bits) + np.uint64(BUCKETS)]).astype(np.int64)


def repeated_words(words: list[bytes], width: int = 5) -> int:
    """Words inside windows of `width` words that the text has twice or more."""
    n = len(words)
    if n <= width:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, n)
    two = np.unique(ids[:-1] * len(known) + ids[1:], return_inverse=True)[1]
    four = np.unique(two[:-2] * (two.max() + 1) + two[2:], return_inverse=True)[1]
    _, at, times = np.unique(four[:-1] * len(known) + ids[4:], return_inverse=True, return_counts=True)
    starts = np.flatnonzero(times[at] > 1)
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + width, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def duplicate_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if find_words(x)] if "\n" in text else []
    return len(lines) - len(set(lines))


def _trusted(labels: DataFrame, most: int) -> DataFrame:
    good = labels.where("quality = 1").select("doc_id").distinct()
    return good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).withColumn("trusted", F.lit(True))


def log_ratios(docs: DataFrame, labels: DataFrame, most: int = TRUSTED) -> np.ndarray:
    """log(LAMBDA * target / raw + 1 - LAMBDA) by bucket. Partial counts are arrays of fixed size."""
    rows = docs.select("doc_id", "text").join(F.broadcast(_trusted(labels, most)), "doc_id", "left").select("text", "trusted")

    def count(batches):
        raw, target = np.zeros(2 * BUCKETS, np.int64), np.zeros(2 * BUCKETS, np.int64)
        for batch in batches:
            for text, trusted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if words := lower_byte_words(text):
                    found = np.bincount(ngram_buckets(words), minlength=2 * BUCKETS)
                    raw += found
                    if trusted:
                        target += found
        used = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(raw[used]), pa.array(target[used])], ["bucket", "raw", "target"])

    sums = rows.mapInArrow(count, "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    raw, target = np.zeros(2 * BUCKETS), np.zeros(2 * BUCKETS)
    for bucket, r, t in sums.collect():  # at most 2 * BUCKETS rows
        raw[bucket], target[bucket] = r, t
    if not target.sum():
        return np.zeros(2 * BUCKETS)
    share = (target / target.sum()) / (np.maximum(raw, 1) / raw.sum())
    return np.log(LAMBDA * share + 1 - LAMBDA)


def judge(docs: DataFrame, ratios: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """Base measures, the ratio and the verdict of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(ratios)
    kinds = [("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("llr", pa.float64())]

    def run(batches):
        table = sent.value
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                text = text or ""
                words = byte_words(text)
                n, repeated = len(words), repeated_words(words)
                failed = n < 10 or 100 * repeated > 20 * n
                llr = float(table[ngram_buckets(lower_byte_words(text))].mean()) if n else 0.0
                out.append((n, len(text) - sum(map(text.count, WHITE)), sum(map(text.count, SYMBOLS)), duplicate_lines(text), repeated, failed, not failed and llr >= threshold, llr))
            columns = list(zip(*out)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, (_, t) in zip(columns, kinds))], ["doc_id", *(k for k, _ in kinds)])

    rows = docs.select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, llr double")


def op2_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return judge(docs, log_ratios(docs, table(spark, sf_dir, "labels")))

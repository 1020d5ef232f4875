"""Quality classification by hierarchical empirical Bayes.

A document's own evidence is a logistic model over four numbers: the mean log ratio of its hashed words under
good and bad labelled texts, its share of symbols, its share of repeated words and its length. Sites are
judged in two levels, host and path: good and total labels plus, at SOFT of a label each, the evidence of
unlabelled documents. The global prior is a Beta fitted by moments to the hosts' rates; a host's posterior
shrinks towards it, a path's posterior shrinks towards its host's, each by a strength fitted by moments, so
sparse sites say little. A document's score adds the log odds of its evidence and of its path, less those of the
global rate; there the document is left out of its path and host, so that neither its label nor its evidence
counts twice.

The classifier is fitted on a bounded sample, the LABELLED labelled ids with the smallest hash; sites, priors
and scores cover every document. Documents have no url here, so their host is `source` and their path
`source` and `lang`; `classify` takes any expressions.

Cases: a null or wordless text has the evidence of an empty one and is scored; null hosts and paths are sites
of their own, apart from empty ones; of rows that repeat a labelled id the one with the smallest measures is
fitted; without usable labels evidence is 0.5 for all; conflicting labels of an id count as one of
quality 0; repeated rows and null ids are rows of their own; an empty table gives an empty table; other
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import lower_byte_words, materialize, table
from factloom.llm.quality_rules import BUCKETS, SYMBOLS, ngram_buckets, repeated_words

LABELLED = 20_000
SOFT = 0.25
KEEP = 0.5
BROADCAST_SITES = 100_000


def word_ratios(docs: DataFrame, sample: DataFrame) -> np.ndarray:
    """log P(bucket | good) - log P(bucket | bad) of hashed words, from the labelled sample's whole texts."""
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("text", "quality")

    def run(batches):
        sums = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            for text, quality in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if words := lower_byte_words(text):
                    sums[quality] += np.bincount(ngram_buckets(words)[: len(words)], minlength=BUCKETS)
        used = np.flatnonzero(sums.sum(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(sums[0, used]), pa.array(sums[1, used])], ["bucket", "bad", "good"])

    sums = np.ones((2, BUCKETS))
    for bucket, bad, good in rows.mapInArrow(run, "bucket int, bad long, good long").groupBy("bucket").agg(F.sum("bad"), F.sum("good")).collect():  # BUCKETS rows at most
        sums[:, bucket] += bad, good
    share = np.log(sums / sums.sum(axis=1, keepdims=True))
    return share[1] - share[0]


def measures(docs: DataFrame, ratios: np.ndarray) -> DataFrame:
    """docs without text, with `ratio`, `symbols`, `repeats`, `length`."""
    sent = docs.sparkSession.sparkContext.broadcast(ratios)
    rest = [c for c in docs.columns if c != "text"]
    added = ["ratio", "symbols", "repeats", "length"]
    schema = docs.select(*rest, *[F.lit(0.0).alias(c) for c in added]).schema

    def run(batches):
        table = sent.value
        for batch in batches:
            out = []
            for text in batch.column(len(rest)).to_pylist():
                words = lower_byte_words(text)
                n = max(1, len(words))
                ratio = float(table[ngram_buckets(words)[: len(words)]].mean()) if words else 0.0
                out.append((ratio, sum(map((text or "").count, SYMBOLS)) / n, repeated_words(words) / n, float(np.log10(n))))
            columns = np.array(out).reshape(-1, 4).T
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(rest))), *map(pa.array, columns)], [*rest, *added])

    return docs.select(*rest, "text").mapInArrow(run, schema)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, scale, weights with the bias last) by Newton steps."""
    if not len(y) or y.min() == y.max():
        return np.zeros(x.shape[1]), np.ones(x.shape[1]), np.zeros(x.shape[1] + 1)
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    a = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w = np.zeros(a.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        hessian = (a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(w))
        w -= np.linalg.solve(hessian, a.T @ (p - y) + ridge * w)
    return mean, scale, w


def _log_odds(p):
    return F.log(p / (1 - p))


def _strength(rate, n, mean: float):
    """Aggregate: pseudo-counts of a Beta with this mean whose spread matches the sites' rates."""
    spread = F.sum(n * (rate - mean) * (rate - mean)) / F.sum(n)
    noise = F.lit(mean * (1 - mean)) * F.count("*") / F.sum(n)
    between = F.greatest(spread - noise, F.lit(1e-4))
    return F.least(F.greatest(F.lit(mean * (1 - mean)) / between - 1, F.lit(2.0)), F.lit(1e4))


def classify(docs: DataFrame, labels: DataFrame, host, path) -> DataFrame:
    """`doc_id`, `evidence`, `host_posterior`, `path_posterior`, `score`, `kept` of every row."""
    known = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    sample = materialize(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED), "labelled")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), host.cast("string").alias("host"), path.cast("string").alias("path"), "text")
    made = materialize(measures(rows, word_ratios(rows, sample)), "measures")
    names = ["ratio", "symbols", "repeats", "length"]
    fit = made.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "quality").agg(F.min(F.struct(*names)).alias("m")).select("m.*", "quality").orderBy(*names, "quality").toPandas()  # LABELLED rows at most
    mean, scale, w = logistic(fit[names].to_numpy(float), fit.quality.to_numpy(float))
    logit = F.lit(float(w[-1]))
    for k, name in enumerate(names):
        logit = logit + (F.col(name) - float(mean[k])) / float(scale[k]) * float(w[k])
    judged = made.join(known, "doc_id", "left").withColumn("evidence", 1 / (1 + F.exp(-F.greatest(F.least(logit, F.lit(20.0)), F.lit(-20.0)))))
    judged = materialize(judged.select("doc_id", "host", "path", "quality", "evidence"), "judged")
    weight = F.when(F.col("quality").isNull(), SOFT).otherwise(1.0)
    paths = materialize(judged.groupBy("host", "path").agg(F.sum(weight).alias("n"), F.sum(weight * F.coalesce(F.col("quality").cast("double"), F.col("evidence"))).alias("k")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("k").alias("host_k"))
    k, n = hosts.agg(F.coalesce(F.sum("host_k"), F.lit(0.0)), F.coalesce(F.sum("host_n"), F.lit(0.0))).first()
    top = min(max((k + 0.5) / (n + 1), 1e-3), 1 - 1e-3)
    prior = hosts.agg(_strength(F.col("host_k") / F.col("host_n"), F.col("host_n"), top)).first()[0] or 2.0
    inner = paths.agg(_strength(F.col("k") / F.col("n"), F.col("n"), top)).first()[0] or 2.0
    sites = paths.join(hosts.withColumnRenamed("host", "h"), F.col("host").eqNullSafe(F.col("h")))
    sites = materialize(sites.select("h", F.col("path").alias("q"), "n", "k", "host_n", "host_k"), "sites")
    small = sites.count() <= BROADCAST_SITES
    out = judged.join(F.broadcast(sites) if small else sites, F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("q")))
    own_n, own_k = weight, weight * F.coalesce(F.col("quality").cast("double"), F.col("evidence"))
    host_of = lambda n, k: (F.col("host_k") - k + prior * top) / (F.col("host_n") - n + prior)
    path_of = lambda n, k: (F.col("k") - k + inner * host_of(n, k)) / (F.col("n") - n + inner)
    out = out.withColumn("host_posterior", host_of(0, 0)).withColumn("path_posterior", path_of(0, 0))
    others = F.greatest(F.least(path_of(own_n, own_k), F.lit(1 - 1e-6)), F.lit(1e-6))
    score = 1 / (1 + F.exp(-(_log_odds(F.col("evidence")) + _log_odds(others) - float(np.log(top / (1 - top))))))
    return out.withColumn("score", score).select("doc_id", "evidence", "host_posterior", "path_posterior", "score", (F.col("score") >= KEEP).alias("kept"))


def op1_site_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return classify(docs, table(spark, sf_dir, "labels"), F.col("source"), F.to_json(F.struct("source", "lang")))

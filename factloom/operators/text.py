"""Full-text search over columns of a table: postings, prefix phrases, BM25 and the exact-name block before it."""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions.names import search_terms
from factloom.functions.storage import materialize

K1, B = 1.2, 0.75


def query_tokens(query: str) -> list[str]:
    return [w for w in re.split(r"[^\w]+", query) if w]


def phrases(query: str) -> list[list[str]]:
    """Each token as a phrase of index terms, whose last is a prefix. Underscores part terms."""
    import unicodedata

    plain = lambda t: "".join(c for c in unicodedata.normalize("NFD", t.lower()) if not unicodedata.combining(c))
    return [p for t in query_tokens(query) if (p := [w for w in re.split(r"[\W_]+", plain(t)) if w])]


def is_anchor(token: str) -> bool:
    """Whether a token looks like an identifier."""
    return "_" in token or any(c.isupper() for c in token)


def exact_names(query: str) -> list[str]:
    """Names to look for as they stand: the whole query, then its identifier-like tokens."""
    return list(dict.fromkeys([query.strip(), *(t for t in query_tokens(query) if is_anchor(t))]))


def postings(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, col, pos, term) for every term of the columns."""
    fields = F.array(*[F.struct(F.lit(i).alias("col"), search_terms(F.coalesce(F.col(c), F.lit(""))).alias("terms")) for i, c in enumerate(columns)])
    each = rows.select(key, F.explode(fields).alias("f"))
    return each.select(key, F.col("f.col").alias("col"), F.posexplode("f.terms").alias("pos", "term"))


#: The term of the posting that ends a row; its position is the row's number of terms. No search asks for it.
END = ""


class Index(NamedTuple):
    """An inverted index: `postings` (term, key, col, pos), each file sorted by term, `lengths` (key, len), `stats` (n, average)."""

    postings: DataFrame
    lengths: DataFrame
    stats: DataFrame


def index(rows: DataFrame, key: str, columns: list[str]) -> Index:
    """One pass and no shuffle: each partition is sorted by term, so that a stored index is read for the terms of a query alone."""
    terms = [f"_t{i}" for i in range(len(columns))]
    cut = rows.select(key, *[search_terms(F.coalesce(F.col(c), F.lit(""))).alias(t) for c, t in zip(columns, terms)])
    field = lambda col, terms, start: F.struct(F.lit(col).alias("col"), terms.alias("terms"), start.alias("start"))
    fields = [field(i, F.col(t), F.lit(0)) for i, t in enumerate(terms)]
    last = field(-1, F.array(F.lit(END)), sum((F.size(t) for t in terms), F.lit(0)))
    each = cut.select(key, F.explode(F.array(*fields, last)).alias("f"))
    posted = each.select(key, F.col("f.col").alias("col"), F.col("f.start").alias("start"), F.posexplode("f.terms").alias("pos", "term"))
    return _of(posted.select("term", key, "col", (F.col("start") + F.col("pos")).alias("pos")).sortWithinPartitions("term", key), key)


def _of(posted: DataFrame, key: str) -> Index:
    lengths = posted.where(F.col("term") == END).select(key, F.col("pos").cast("long").alias("len"))
    return Index(posted, lengths, lengths.agg(F.count("*").alias("n"), F.avg("len").alias("average")))


def stored(made: Index, store: Callable[[DataFrame, str], DataFrame] | None = None) -> Index:
    """The index with its postings as a table of the shared folder; with `store` each of its tables is stored by that."""
    posted = store(made.postings, "postings") if store else materialize(made.postings, "index-postings")
    out = _of(posted, made.lengths.columns[0])
    if store is None:
        return out
    lengths = store(out.lengths, "lengths")
    return Index(posted, lengths, store(out.stats, "stats"))


def phrase_hits(posted: DataFrame, phrase: list[str], key: str) -> DataFrame:
    """(key, tf) of the rows that have the phrase, its last term as a prefix. The first term prunes the rest."""
    last = len(phrase) - 1
    out = None
    for k, term in enumerate(phrase):
        fits = F.col("term").startswith(term) if k == last else F.col("term") == term
        at = posted.where(fits).select(key, "col", (F.col("pos") - k).alias("start"))
        out = at if out is None else out.join(at, [key, "col", "start"], "left_semi")
    return out.groupBy(key).agg(F.count("*").alias("tf"))


def ranked(found: Index, query: str, key: str) -> DataFrame:
    """(key, score) of rows that match every phrase; the smaller score is the better, rounded to 6 places."""
    wanted = phrases(query)
    out = None
    for k, phrase in enumerate(wanted):
        hits = phrase_hits(found.postings, phrase, key)
        df = hits.agg(F.count("*").alias("df"))
        idf = F.greatest(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
        weighed = hits.join(found.lengths, key).crossJoin(F.broadcast(found.stats.crossJoin(df)))
        part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("average")))
        one = weighed.select(key, part.alias(f"_s{k}"))
        out = one if out is None else out.join(one, key)
    if out is None:
        return found.lengths.select(key).limit(0).withColumn("score", F.lit(0.0))
    total = sum((F.col(f"_s{k}") for k in range(1, len(wanted))), F.col("_s0"))
    return out.select(key, F.round(-total, 6).alias("score"))


def exact(nodes: DataFrame, query: str) -> DataFrame:
    """Nodes that have one of the query's names, with `place`, the number of that name."""
    names = exact_names(query)
    place = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("name"))
    return nodes.where(F.col("name").isin(names)).select("*", F.lit(0).alias("block"), place.cast("double").alias("place"))


def search(nodes: DataFrame, found: Index, query: str) -> DataFrame:
    """nodes with `block` and `place`: names alike first, in the query's order, then the rest by rank."""
    first = exact(nodes, query)
    rest = nodes.join(ranked(found, query, "id"), "id").where(~F.col("name").isin(exact_names(query)))
    return first.unionByName(rest.withColumn("block", F.lit(1)).withColumnRenamed("score", "place").select(first.columns))


def term_counts(rows: DataFrame, key: str, column: str) -> DataFrame:
    """(term, df, tf) of one column."""
    terms = rows.select(key, F.explode(search_terms(F.col(column))).alias("term"))
    return terms.groupBy("term", key).agg(F.count("*").alias("n")).groupBy("term").agg(F.count("*").alias("df"), F.sum("n").alias("tf"))


"""Document fingerprints from closed syncmers.

A k-mer of code points is a closed syncmer when the smallest hash among its inner s-mers stands at its first
or last place. Whether a k-mer is chosen depends on that k-mer alone, so an edit changes only the anchors
that overlap it. The fingerprint keeps all chosen k-mers of a text with their positions, in order: base64 of
the varints of the steps from position to position, then of the upper four bytes of each hash. Two fingerprints
are matched by position: the first anchor of a hash in one meets the first of that hash in the other, the
second the second, and so on. Likeness is the Dice coefficient of the matches, 1 for equal fingerprints and 0
where one alone is empty; matches() gives the positions themselves.

Cases: a null text counts as empty and has the empty fingerprint; a text under K code points, or one
without a chosen k-mer, has one anchor, the whole text; rows with a null id come before all others; repeated
ids follow each other, ordered by the compressed text; the next document of the last is the first; an only row follows
itself; an empty table gives an empty table; only the columns named are read.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

K, S = 20, 10
#: Ranges of ids hold a given number of rows up to RANGES of them; further ones come where a range would hold more than MOST_PART.
RANGES, MOST_PART = 4000, 50_000
_MULT = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_LOW = np.uint64(2**32 - 1)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x *= _MIX
    return x ^ (x >> np.uint64(29))


def _grams(points: np.ndarray, n: int) -> np.ndarray:
    """A hash for each window of n code points, by doubling: O(log n) passes."""
    out, have = _mixed(points.astype(np.uint64) * _MULT + _MULT), 1
    whole, done, size = None, 0, out
    while True:
        if n & have:
            whole, done = (size, have) if whole is None else (_mixed(whole[: len(points) - n + 1] * _MULT + size[done : done + len(points) - n + 1]), done + have)
            whole = whole[: len(points) - n + 1]
        if have * 2 > n:
            return whole
        size = _mixed(size[: len(size) - have] * _MULT + size[have:])
        have *= 2


def _window_min(x: np.ndarray, n: int) -> np.ndarray:
    have = 1
    while have * 2 <= n:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (n - have)], x[n - have :]) if have < n else x


def anchors(points: np.ndarray, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the closed syncmers."""
    n = len(points)
    if n >= k:
        inner = _grams(points, s)
        least = _window_min(inner, k - s + 1)
        at = np.flatnonzero((inner[: len(least)] == least) | (inner[k - s :] == least))
        if len(at):
            return at, _grams(points, k)[at]
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    whole = hashlib.blake2b(points.tobytes(), digest_size=8).digest()
    return np.zeros(1, np.int64), np.frombuffer(whole, np.uint64)


def sketch(points: np.ndarray) -> np.ndarray:
    """All anchors in order of position: the position in the upper half, the hash's upper half in the lower."""
    at, hashes = anchors(points)
    return at.astype(np.uint64) << np.uint64(32) | hashes >> np.uint64(32)


def as_text(x: np.ndarray) -> str:
    steps = np.diff((x >> np.uint64(32)).astype(np.int64), prepend=0)
    parts = []
    for k in range(5):  # a step is below 2**35
        used = (steps >> 7 * k > 0) | (k == 0)
        more = steps >> 7 * (k + 1) > 0
        parts.append(np.where(used, (steps >> 7 * k) & 127 | more << 7, -1))
        if not more.any():
            break
    laid = np.stack(parts, axis=1).ravel()
    return base64.b64encode(laid[laid >= 0].astype(np.uint8).tobytes() + (x & _LOW).astype(">u4").tobytes()).decode()


def from_text(text: str) -> np.ndarray:
    """The inverse of as_text."""
    raw = np.frombuffer(base64.b64decode(text), np.uint8)
    n, at, steps = 0, 0, []
    while len(raw) - at > 4 * n:  # as many varints as there are hashes behind them
        step = shift = 0
        while True:
            byte = int(raw[at])
            at += 1
            step |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                break
        steps.append(step)
        n += 1
    return np.cumsum(np.array(steps, np.uint64), dtype=np.uint64) << np.uint64(32) | np.frombuffer(raw[at:].tobytes(), ">u4").astype(np.uint64)


def _keys(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and number of its occurrence as one ascending key each, and the anchors' places in x."""
    hashes = np.asarray(x, np.uint64) & _LOW
    order = np.argsort(hashes, kind="stable")
    hashes = hashes[order]
    first = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1])) if len(x) else np.empty(0, np.int64)
    nth = np.arange(len(x)) - np.repeat(first, np.diff(np.append(first, len(x))))
    return hashes << np.uint64(32) | nth.astype(np.uint64), order


def matches(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the anchors of a and of b that meet."""
    (x, i), (y, j) = _keys(a), _keys(b)
    _, p, q = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    return (a[i[p]] >> np.uint64(32)).astype(np.int64), (b[j[q]] >> np.uint64(32)).astype(np.int64)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    return 2 * len(np.intersect1d(_keys(a)[0], _keys(b)[0], assume_unique=True)) / (len(a) + len(b))


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`id_col` and `fingerprint` of every row: one pass, no shuffle."""
    rows = df.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = rows.select(id_col, F.lit("").alias("fingerprint")).schema

    def run(batches):
        for batch in batches:
            made = [as_text(sketch(code_points(t))) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.string())], [id_col, "fingerprint"])

    return rows.mapInArrow(run, schema)


def with_edits(df: DataFrame, per_part: int = 2000) -> DataFrame:
    """Every row beside its edited text's fingerprint and its likeness to that and to the next row.

    Rows are dealt into ranges of ids, and the first row of each range goes to the range before it, too:
    one shuffle of compressed texts, in which no task needs to know another's rows.
    """
    spark = df.sparkSession
    docs = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    low = -(2**63)
    place = F.coalesce("doc_id", F.lit(low))
    ids = docs.select(place.alias("place"))
    n = ids.count()
    parts = max(1, min(RANGES, -(-n // per_part)), -(-n // MOST_PART))
    cuts = ids.approxQuantile("place", [i / parts for i in range(1, parts)], 1 / (parts * 8)) if parts > 1 else []
    cuts = sorted({int(c) for c in cuts})
    edges = np.array(cuts, np.int64)

    def least(batches):
        for batch in batches:
            x = batch.column(0).to_numpy()
            part = np.searchsorted(edges, x, "right")
            used, at = np.unique(part, return_inverse=True)
            low_of = np.full(len(used), 2**63 - 1)
            np.minimum.at(low_of, at, x)
            yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(low_of)], ["part", "start"])

    found = ids.mapInArrow(least, "part int, start long").groupBy("part").agg(F.min("start").alias("start")).collect()  # one row a range
    starts = {r["part"]: r["start"] for r in found}
    used = sorted(starts)
    copies = {starts[used[(i + 1) % len(used)]]: p for i, p in enumerate(used)}
    tasks = max(1, len(used))
    # a number for each range whose hash is the range's own task
    hashed = spark.range(12 * tasks).groupBy(F.pmod(F.hash("id"), F.lit(tasks)).alias("task")).agg(F.min("id").alias("id")).collect()
    number = {r["task"]: r["id"] for r in hashed}
    deals = {p: number.get(i, p) for i, p in enumerate(used)}

    def deal(batches):
        press = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            places, texts = batch.column(2).to_numpy(), [press(t.encode()) for t in batch.column(1).to_pylist()]
            part = np.searchsorted(edges, places, "right").tolist()
            more = [i for i, x in enumerate(places.tolist()) if x in copies]
            to = [*part, *(copies[int(places[i])] for i in more)]
            take = pa.array([*range(len(part)), *more])
            kind = [0] * len(part) + [1] * len(more)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), pa.array(texts, pa.binary()).take(take), batch.column(2).take(take), pa.array(to, pa.int32()), pa.array(kind, pa.int32()), pa.array([deals[p] for p in to], pa.int64())],
                ["doc_id", "text", "place", "part", "kind", "deal"],
            )

    dealt = docs.select("doc_id", "text", place.alias("place"))
    packed = dealt.mapInArrow(deal, "doc_id long, text binary, place long, part int, kind int, deal long")
    laid = packed.repartition(tasks, "deal").sortWithinPartitions("part", "kind", "place", "text")
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def score(doc_id, points, own, following, next_own):
        quarter = len(points) // 4
        edited = np.concatenate([points[: len(points) - quarter], following[:quarter]]) if quarter else points
        other = own if not quarter else sketch(edited)
        digest = hashlib.sha256(edited.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")).hexdigest()
        return doc_id, len(points), digest, as_text(own), as_text(other), likeness(own, other), likeness(own, next_own)

    def run(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        held = None
        for batch in batches:
            out = []
            for doc_id, text, part, kind in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist()):
                if kind and (held is None or held[0] != part):
                    continue  # a later copy of the same border row
                points = code_points(unpack(text).decode())
                own = sketch(points)
                if held is not None:
                    out.append(score(*held[1:], points, own))
                held = None if kind else (part, doc_id, points, own)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()))], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return laid.mapInArrow(run, schema)


def op9_closed_syncmers(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, with both likenesses."""
    return with_edits(spark.read.parquet(f"{sf_dir}/documents.parquet"))

"""Near-duplicate groups by min-max hashing.

A document's set holds the hashes of its distinct word shingles. Every permutation of the hash space gives
two signature values, its minimum and its maximum over the set, so PERMS evaluations make 2 * PERMS values;
runs of ROWS values form BANDS band keys. Two sets at the similarity asked for share a band but with a
probability of (1 - s ** ROWS) ** BANDS: 7e-9 at 0.85, 3e-6 at 0.8.

1. Documents with equal sets form a class, the node of all that follows; its key is its number in a stored table.
2. Classes that share a band key meet in a bucket. Each class is held against the centres of its buckets, and
   the nearest that can be linked is confirmed. So a bucket costs comparisons in proportion to its members.
3. Buckets that still hold several components are searched in blocks: their classes are dealt into chunks of
   about CHUNK, or COPIES chunks if that is more, and each pair of chunks is a cell that one task scans. Chunks
   of the bucket's largest component never meet each other. Classes travel to cells in packs of about PACK, a
   row each, and none more than COPIES + 2 times, so rows grow with a bucket's size and not with its square. A
   class hands on its nearest class of another component only; a class without any is done, as components only
   grow. With the others rounds go on until one merges nothing, and a last one hands on all pairs that are left.

A cell tells apart what can be linked by parity bitmaps: bit i is the parity of the set's hashes that fall on
i, so two bitmaps differ in no more bits than the sets have unlike elements. Nothing that is linked is lost,
and what passes is confirmed on the two full sets. Components are found by label propagation with pointer
jumping over tables in the shared folder. A confirmed pair's centre is copied for every SALT partners.

Cases: a null or wordless text has the empty set, is linked with nothing and is a component by itself, in
every row; a text with fewer words than a shingle has one element, its whole sequence; rows are told apart by
id and text, so rows that repeat an id with another text are documents of their own, and rows that repeat
both fall together like other copies; null ids come before all others, and the id of a component with a
document without an id is null; an empty table gives an empty table; columns besides id and text are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import discard, lower_byte_words, materialize, sliced, table, tidy

PERMS, ROWS, BANDS = 80, 5, 32
SALT = 256
CHUNK = 256
#: Classes in a row that goes to a cell, and the chunks of a bucket of any size.
PACK, COPIES = 32, 32
#: Keys to broadcast at most; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
_MEMO = 150_000

_rng = np.random.default_rng(20240)
_A = _rng.integers(0, 2**63, PERMS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**63, PERMS, dtype=np.uint64)
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


class _Hashes(dict):
    def __missing__(self, word):
        if len(self) > _MEMO:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


_hashes = _Hashes()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _M2
    return x ^ (x >> np.uint64(29))


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    words = lower_byte_words(text)
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, n)
    used = min(n, width)
    out = np.full(n - used + 1, used, np.uint64)
    for i in range(used):
        out = _mix(out * _M1 + h[i : n - used + 1 + i])
    return np.unique(out)


def signature(hashes: np.ndarray) -> np.ndarray:
    """PERMS minima, then PERMS maxima."""
    low, high = np.full(PERMS, 2**64 - 1, np.uint64), np.zeros(PERMS, np.uint64)
    for i in range(0, len(hashes), 2048):
        x = np.multiply.outer(_A, hashes[i : i + 2048])
        x += _B[:, None]
        np.minimum(low, x.min(axis=1), out=low)
        np.maximum(high, x.max(axis=1), out=high)
    return np.concatenate([low, high])


def band_keys(sig: np.ndarray) -> np.ndarray:
    parts = sig.reshape(BANDS, ROWS)
    out = np.arange(BANDS, dtype=np.uint64)
    for i in range(ROWS):
        out = _mix(out * _M1 + parts[:, i])
    return out.view(np.int64)


def bitmap(hashes: np.ndarray) -> np.ndarray:
    """Parity bitmap of a set, as 64-bit words: the power of two from twice its size on, 256 bits at least."""
    bits = max(256, 1 << (2 * len(hashes) - 1).bit_length())
    odd = np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if not len(a) or not len(b):
        return False
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if 100 * len(small) < percent * len(large):
        return False
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    both = int((large[at] == small).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def unlike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits in which each bitmap of a (a row each) differs from each of b; the wider ones are folded first."""
    while a.shape[1] > b.shape[1]:
        a = a[:, : a.shape[1] // 2] ^ a[:, a.shape[1] // 2 :]
    while b.shape[1] > a.shape[1]:
        b = b[:, : b.shape[1] // 2] ^ b[:, b.shape[1] // 2 :]
    out = np.zeros((len(a), len(b)), np.int64)
    for k in range(a.shape[1]):
        out += np.bitwise_count(a[:, k, None] ^ b[None, :, k])
    return out


def gaps(sizes, bits: list[bytes], left: np.ndarray, right: np.ndarray, percent: int) -> np.ndarray:
    """Share of unlike bits for each pair of left and right; infinite for pairs that can't be linked."""
    out = np.full((len(left), len(right)), np.inf)
    width = np.array([len(b) for b in bits])
    for w in np.unique(width[left]):
        i = np.flatnonzero(width[left] == w)
        a = np.frombuffer(b"".join(bits[k] for k in left[i]), np.uint64).reshape(len(i), -1)
        for v in np.unique(width[right]):
            if not w // 4 < v < w * 4:
                continue  # sizes that far apart are below any similarity of a half or more
            j = np.flatnonzero(width[right] == v)
            b = np.frombuffer(b"".join(bits[k] for k in right[j]), np.uint64).reshape(len(j), -1)
            n, m = sizes[left[i]][:, None], sizes[right[j]][None, :]
            d = unlike(a, b)
            fits = (d * (100 + percent) <= (100 - percent) * (n + m)) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m))
            out[np.ix_(i, j)] = np.where(fits, d / (n + m), np.inf)
    return out


def _keyed(docs: DataFrame, *more) -> DataFrame:
    """A text's two hashes beside it; they stand for the text wherever rows must meet again."""
    return docs.select(*more, F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2"), "text")


def features(docs: DataFrame, width: int) -> DataFrame:
    """`doc_id`, `t1`, `t2`, `n`, `set_id`, `bands`, `bits` for every row; one pass."""

    def run(batches):
        for batch in sliced(batches):
            ns, ids, bands, bits = [], [], [], []
            for text in batch.column(3).to_pylist():
                s = shingle_set(text, width)
                ns.append(len(s))
                ids.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                bands.append(band_keys(signature(s)) if len(s) else np.empty(0, np.int64))
                bits.append(bitmap(s).tobytes() if len(s) else b"")
            ends = np.cumsum([0, *map(len, bands)]).astype(np.int32)
            flat = np.concatenate(bands) if bands else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(ns, pa.int64()), pa.array(ids, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), pa.array(bits, pa.binary())],
                ["doc_id", "t1", "t2", "n", "set_id", "bands", "bits"],
            )
        _hashes.clear()

    return _keyed(docs, "doc_id").mapInArrow(tidy(run), "doc_id long, t1 long, t2 long, n long, set_id binary, bands array<long>, bits binary")


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, z), the compressed text of each wanted (node, t1, t2)."""

    def run(batches):
        press = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([press((t or "").encode()) for t in batch.column("text").to_pylist()], pa.binary())], [*batch.schema.names[:-1], "z"])

    keyed = _keyed(docs)
    if wanted.count() <= BROADCAST_IDS:
        found = keyed.join(F.broadcast(wanted), ["t1", "t2"]).select("node", "text").mapInArrow(run, "node long, z binary")
    else:
        found = keyed.mapInArrow(run, "t1 long, t2 long, z binary").join(wanted, ["t1", "t2"]).select("node", "z")
    return found.dropDuplicates(["node"])


def confirmed(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (u, c) that are linked by their full sets. pairs must be a stored table."""
    centres = pairs.groupBy("c").agg(F.ceil(F.count("*") / SALT).alias("salts"))
    members = pairs.join(centres, "c").select(F.col("u").alias("node"), "c", F.pmod(F.xxhash64("u"), "salts").alias("salt"))
    sides = members.join(texts, "node").select("c", "salt", F.lit(1).alias("kind"), "node", "z").unionByName(
        centres.select(F.col("c").alias("node"), "c", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")).join(texts, "node").select("c", "salt", F.lit(0).alias("kind"), "node", "z")
    )

    def run(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        held, centre = None, None
        for batch in batches:
            out = []
            for c, salt, kind, node, z in zip(*(batch.column(i).to_pylist() for i in range(5))):
                s = shingle_set(unpack(z).decode(), width)
                if kind == 0:
                    held, centre = (c, salt), s
                elif held == (c, salt) and linked(centre, s, percent):
                    out.append((node, c))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], ["u", "v"])

    return sides.repartition("c", "salt").sortWithinPartitions("c", "salt", "kind").mapInArrow(run, "u long, v long")


def components(edges: DataFrame, tag: str = "labels") -> DataFrame:
    """(node, comp) for every node of a stored table of edges (u, v); comp is the smallest reachable node."""
    both = materialize(edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))), tag)
    labels = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("comp")), tag)
    while True:
        near = both.join(labels.select(F.col("node").alias("v"), "comp"), "v").groupBy("u").agg(F.min("comp").alias("m")).withColumnRenamed("u", "node")
        nearer = materialize(labels.join(near, "node").select("node", F.least("comp", "m").alias("comp"), F.col("comp").alias("was")), tag)
        jump = nearer.select(F.col("node").alias("comp"), F.col("comp").alias("up"))
        after = materialize(nearer.join(jump, "comp").select("node", F.col("up").alias("comp"), (F.col("up") != F.col("was")).alias("moved")), tag)
        discard(labels, nearer)
        labels = after
        if labels.where("moved").isEmpty():
            discard(both)
            return labels


def _merged(comp: DataFrame, links: DataFrame) -> DataFrame | None:
    """comp (node, comp) after more links (u, v) between its nodes; None if they change nothing."""
    name = lambda side: comp.select(F.col("node").alias(side), F.col("comp").alias(f"{side}_c"))
    between = materialize(links.join(name("u"), "u").join(name("v"), "v").where("u_c <> v_c").select(F.col("u_c").alias("u"), F.col("v_c").alias("v")).distinct(), "between")
    if between.isEmpty():
        discard(between)
        return None
    found = components(between)
    out = materialize(comp.join(found.select(F.col("node").alias("comp"), F.col("comp").alias("new")), "comp", "left").select("node", F.coalesce("new", "comp").alias("comp")), "comp")
    discard(between, found, comp)
    return out


def star_pairs(met: DataFrame, info: DataFrame, percent: int) -> DataFrame:
    """(u, c): each class with the nearest of its buckets' centres, if they can be linked."""
    pairs = met.where("node <> c").select(F.col("node").alias("u"), "c").distinct()
    side = lambda k: info.select(F.col("node").alias(k), F.col("n").alias(f"n_{k}"), F.col("bits").alias(f"bits_{k}"))
    near = 100 * F.least("n_u", "n_c") >= percent * F.greatest("n_u", "n_c")
    wide = pairs.join(side("u"), "u").join(side("c"), "c").where(near).select("u", "c", "n_u", "n_c", "bits_u", "bits_c")

    def run(batches):
        for batch in batches:
            gap = []
            for n, m, a, b in zip(*(batch.column(i).to_pylist() for i in range(2, 6))):
                d = int(unlike(np.frombuffer(a, np.uint64)[None], np.frombuffer(b, np.uint64)[None])[0, 0])
                gap.append(d / (n + m) if d * (100 + percent) <= (100 - percent) * (n + m) else None)
            found = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(gap, pa.float64())], ["u", "c", "gap"])
            yield found.filter(found.column("gap").is_valid())

    return wide.mapInArrow(run, "u long, c long, gap double").groupBy("u").agg(F.min_by("c", F.struct("gap", "c")).alias("c"))


def _members(met: DataFrame, info: DataFrame, comp: DataFrame) -> DataFrame:
    """A stored table (band, a, b, at, node, comp, n, bits): the cells (a, b) of chunks of the buckets with several
    components. A row is a pack of classes of chunk `at`; its last four columns are lists."""
    inside = met.select("band", "node").join(comp.select("node", "comp"), "node")
    sizes = inside.groupBy("band", "comp").agg(F.count("*").alias("k")).groupBy("band")
    sizes = sizes.agg(F.max_by("comp", F.struct("k", "comp")).alias("top"), F.max("k").alias("most"), F.sum("k").alias("all"), F.count("*").alias("comps")).where("comps > 1").drop("comps")
    whole = F.col("all") <= CHUNK
    chunk = F.greatest(F.lit(CHUNK), F.ceil(F.col("all") / COPIES))
    minor = F.when(whole, 1).otherwise(F.ceil((F.col("all") - F.col("most")) / chunk))
    major = F.when(whole, 0).otherwise(F.ceil(F.col("most") / chunk))
    packs = F.ceil(F.least("all", chunk) / PACK)
    sizes = materialize(sizes.select("band", "top", minor.cast("long").alias("minor"), major.cast("long").alias("major"), packs.cast("long").alias("packs")), "open")
    dealt = materialize(inside.join(sizes, "band"), "open-members")
    discard(sizes)
    low = (F.col("comp") != F.col("top")) | (F.col("major") == 0)
    place = F.when(low, F.pmod(F.xxhash64("node"), "minor")).otherwise(F.col("minor") + F.pmod(F.xxhash64("node"), F.greatest("major", F.lit(1))))
    rows = dealt.join(info.select("node", "n", "bits"), "node").select("band", "minor", "major", place.alias("at"), F.pmod(F.xxhash64(F.lit(1), "node"), "packs").alias("pack"), F.struct("node", "comp", "n", "bits").alias("row"))
    packed = rows.groupBy("band", "minor", "major", "at", "pack").agg(F.collect_list("row").alias("rows"))
    to = F.sequence(F.lit(0).cast("long"), F.when(F.col("at") < F.col("minor"), F.col("minor") + F.col("major")).otherwise(F.col("minor")) - 1)
    sent = packed.select("band", "at", F.explode(to).alias("to"), "rows")
    cells = materialize(sent.select("band", F.least("at", "to").alias("a"), F.greatest("at", "to").alias("b"), "at", "rows.node", "rows.comp", "rows.n", "rows.bits"), "cells")
    discard(dealt)
    return cells


def block_pairs(cells: DataFrame, percent: int, every: bool) -> DataFrame:
    """(u, c) of different components that can be linked: for each u the nearest in all its cells, or every pair."""
    step = CHUNK

    def search(cell: list[tuple]) -> list[tuple]:
        a, b = cell[0][1:3]
        at = np.repeat([r[3] for r in cell], [len(r[4]) for r in cell])
        nodes, comps, sizes = (np.concatenate([r[k] for r in cell]) for k in (4, 5, 6))
        bits = [x for r in cell for x in r[7]]
        comp = np.unique(comps, return_inverse=True)[1]
        lefts, rights = np.flatnonzero(at == a), np.flatnonzero(at == b)
        if comp.max() == 0 or not len(lefts) or not len(rights):
            return []
        found: list[tuple] = []
        best, partner = np.full(len(nodes), np.inf), np.zeros(len(nodes), np.int64)

        def nearer(side, near, gap):
            new = gap < best[side]
            best[side[new]], partner[side[new]] = gap[new], near[new]

        for i in range(0, len(lefts), step):
            for j in range(i if a == b else 0, len(rights), step):
                left, right = lefts[i : i + step], rights[j : j + step]
                apart = comp[left][:, None] != comp[right][None, :]
                if not apart.any():
                    continue
                gap = gaps(sizes, bits, left, right, percent)
                gap[~apart] = np.inf
                if every:
                    found += [(nodes[left[x]], nodes[right[y]], gap[x, y]) for x, y in np.argwhere(np.isfinite(gap)) if a != b or left[x] < right[y]]
                else:
                    nearer(left, right[gap.argmin(axis=1)], gap.min(axis=1))
                    nearer(right, left[gap.argmin(axis=0)], gap.min(axis=0))
        if not every:
            found = [(nodes[x], nodes[partner[x]], best[x]) for x in np.flatnonzero(np.isfinite(best))]
        return [(int(u), int(c), float(g)) for u, c, g in found]

    def run(batches):
        cell: list[tuple] = []
        for batch in batches:
            out = []
            for i, name in enumerate(zip(*(batch.column(k).to_pylist() for k in range(4)))):
                if cell and cell[0][:3] != name[:3]:
                    out += search(cell)
                    cell = []
                lists = [batch.column(k)[i].values for k in range(4, 8)]
                cell.append((*name, *(x.to_numpy().copy() for x in lists[:3]), lists[3].to_pylist()))
            yield _pairs(out)
        if cell:
            yield _pairs(search(cell))

    def _pairs(out):
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.float64())], ["u", "c", "gap"])

    found = cells.repartition("band", "a", "b").sortWithinPartitions("band", "a", "b", "at").mapInArrow(tidy(run), "u long, c long, gap double")
    if every:
        return found.select(F.greatest("u", "c").alias("u"), F.least("u", "c").alias("c")).distinct()
    return found.groupBy("u").agg(F.min_by("c", F.struct("gap", "c")).alias("c"))


def _linked_classes(docs: DataFrame, classes: DataFrame, width: int, percent: int) -> DataFrame | None:
    """(node, comp) of the classes that share a bucket with others."""
    banded = classes.select("node", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.min("node").alias("c"), F.max("node").alias("last")).where("c <> last").select("band", "c")
    met = materialize(banded.join(shared.hint("merge"), "band"), "met")  # buckets are as many as documents: never broadcast
    comp = materialize(met.select("node").distinct().withColumn("comp", F.col("node")), "nodes")
    if comp.isEmpty():
        return None
    info = materialize(classes.join(comp.select("node").hint("merge"), "node").select("node", "n", "bits", "t1", "t2"), "info")

    def confirm(pairs: DataFrame) -> DataFrame | None:
        """comp after the links among these pairs, or None."""
        ends = pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("c").alias("node"))).distinct()
        texts = materialize(_texts(docs, info.join(ends, "node").select("node", "t1", "t2")), "texts")
        links = materialize(confirmed(pairs, texts, width, percent), "links")
        out = _merged(comp, links)
        discard(texts, links)
        return out

    pairs = materialize(star_pairs(met, info, percent), "pairs")
    comp = confirm(pairs) or comp
    every, open_ = False, met
    while True:
        discard(pairs)
        cells = _members(open_, info, comp)
        pairs = materialize(block_pairs(cells, percent, every), "pairs")
        discard(cells)
        if pairs.isEmpty():
            break
        found = confirm(pairs)
        comp = found or comp
        if every:
            break
        every = found is None
        smaller = materialize(open_.join(pairs.select(F.col("u").alias("node")), "node", "left_semi"), "open")
        discard(open_)
        open_ = smaller
    discard(pairs, open_, info)
    return comp


def grouped(df: DataFrame, width: int, percent: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`doc_id`, `t1`, `t2`, `n` of every row and `head` (has_id, doc_id, t1, t2), the first document of its component."""
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    made = materialize(features(docs, width), "features")
    one = F.struct(F.col("doc_id").isNotNull().alias("has_id"), "doc_id", "t1", "t2")
    classes = made.where("n > 0").groupBy("set_id").agg(F.min(one).alias("head"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("bits").alias("bits"))
    classes = materialize(classes.select(F.monotonically_increasing_id().alias("node"), "set_id", "head", "n", "bands", "bits", "head.t1", "head.t2"), "classes")
    comp = _linked_classes(docs, classes, width, percent)
    heads = classes.select("node", "set_id", "head")
    if comp is not None:
        of = heads.join(comp, "node").select("node", "comp", "head")
        least = of.groupBy("comp").agg(F.min("head").alias("least"))
        heads = heads.join(of.join(least, "comp").select("node", "least"), "node", "left").select("set_id", F.coalesce("least", "head").alias("head"))
    heads = materialize(heads.select("set_id", "head"), "heads")
    out = made.select("doc_id", "t1", "t2", "n", "set_id").join(heads, "set_id", "left").select("doc_id", "t1", "t2", "n", F.coalesce("head", one).alias("head"))
    out = materialize(out, "grouped")
    discard(made, classes, comp, heads)
    return out


def groups(df: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`doc_id`, `n_shingles`, `component_id` for every row."""
    return grouped(df, width, percent, id_col, text_col).select("doc_id", F.col("n").alias("n_shingles"), F.col("head.doc_id").alias("component_id"))


def deduplicated(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, all columns, one of each component: its smallest id's, null before all others.

    Rows without words stay all. Up to BROADCAST_IDS keys of removed rows are broadcast, more are joined by
    a shuffle.
    """
    found = grouped(docs, width, percent)
    key = F.struct("doc_id", "t1", "t2")
    head = F.struct("head.doc_id", "head.t1", "head.t2")
    short = lambda df: df.select(F.col("doc_id").alias("_id"), F.col("t1").alias("_t1"), F.col("t2").alias("_t2"))
    gone = materialize(short(found.where(~key.eqNullSafe(head)).select("doc_id", "t1", "t2").distinct()), "gone")
    again = materialize(short(found.where((F.col("n") > 0) & key.eqNullSafe(head)).groupBy("doc_id", "t1", "t2").count().where("count > 1")), "again")

    def meet(df, side, how):
        same = df["doc_id"].cast("long").eqNullSafe(side["_id"]) & (F.xxhash64(df["text"]) == side["_t1"]) & (F.xxhash64(F.lit(1), df["text"]) == side["_t2"])
        return df.join(F.broadcast(side) if side.count() <= BROADCAST_IDS else side, same, how)

    kept = meet(docs, gone, "left_anti")
    if again.isEmpty():
        return kept
    copies = meet(kept, again, "left_semi").withColumn("_1", F.xxhash64("text")).withColumn("_2", F.xxhash64(F.lit(1), "text")).dropDuplicates(["doc_id", "_1", "_2"])
    return meet(kept, again, "left_anti").unionByName(copies.select(*docs.columns)).select(*docs.columns)


def op10_minmax_groups(spark, sf_dir: str) -> DataFrame:
    found = groups(table(spark, sf_dir, "documents"), width=3, percent=85)
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))

"""Byte-level BPE encoding and decoding by monoid tree reduction.

A text is a sequence of pattern matches. Each match is halved recursively down to leaves of at most
LEAF bytes; a leaf is encoded by lowest-rank merging and neighbours are joined by re-encoding a window
of tokens around their border. A sequence of tokens is the encoding of its bytes exactly when every
adjacent pair of tokens is the encoding of the pair's bytes, so a window may stop growing as soon as the
pairs at its two edges pass that test: everything outside is then provably final. Matches themselves are
encoded apart, so joining whole matches is plain concatenation; so is decoding.

Cases: a null text counts as empty; an empty text has no ids and decodes to no bytes; every input row
gives one output row, repeated rows included; an empty table gives an empty table; only the columns named
are read, so further columns can't clash.
"""

from __future__ import annotations

import base64
import struct
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import sliced, text_batches, tidy

LEAF = 16
#: Distinct matches that a worker remembers before it starts anew; a speed-up only.
MEMO = 100_000
#: The rank of a pair that is no token.
NONE = 1 << 60


class Codec:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.split = regex.compile(pattern).findall
        self.packed: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.pairs: dict[tuple[int, int], bool] = {}

    def merged(self, piece: bytes) -> list[int]:
        """Lowest rank first, leftmost on ties."""
        if len(piece) > 3 * LEAF:
            return self.merged_long(piece)
        parts, get = [piece[i : i + 1] for i in range(len(piece))], self.ranks.get
        pairs = [get(piece[i : i + 2], NONE) for i in range(len(piece) - 1)]
        while pairs and (best := min(pairs)) < NONE:
            at = pairs.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del pairs[at]
            if at < len(pairs):
                pairs[at] = get(parts[at] + parts[at + 1], NONE)
            if at:
                pairs[at - 1] = get(parts[at - 1] + parts[at], NONE)
        ranks = self.ranks
        return [ranks[p] for p in parts]

    def merged_long(self, piece: bytes) -> list[int]:
        """The same by a heap over a linked list, n log n."""
        ranks, n = self.ranks, len(piece)
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))
        alive = [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            _, i, stop = heappop(heap)
            if not alive[i] or (j := end[i]) >= n or end[j] != stop:
                continue
            alive[j], end[i] = False, stop
            if stop < n:
                before[stop] = i
                if (r := ranks.get(piece[i : end[stop]])) is not None:
                    heappush(heap, (r, i, end[stop]))
            if (h := before[i]) >= 0 and (r := ranks.get(piece[h:stop])) is not None:
                heappush(heap, (r, h, stop))
        return [ranks[piece[i : end[i]]] for i in range(n) if alive[i]]

    def stable(self, a: int, b: int) -> bool:
        """Whether the two tokens, side by side, are what their bytes encode to."""
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) > MEMO:
                self.pairs.clear()
            known = self.pairs[a, b] = self.merged(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return known

    def join(self, left: list[int], right: list[int]) -> list[int]:
        if not left or not right or self.stable(left[-1], right[0]):
            return left + right
        width = 1
        while True:
            i, j = max(0, len(left) - width), min(len(right), width)
            window = left[i:] + right[:j]
            middle = self.merged(b"".join(map(self.bytes_of.__getitem__, window)))
            if (i == 0 or self.stable(left[i - 1], middle[0])) and (j == len(right) or self.stable(middle[-1], right[j])):
                return left[:i] + middle + right[j:]
            width *= 2

    def encode_piece(self, piece: bytes) -> list[int]:
        if len(piece) <= LEAF:
            whole = self.ranks.get(piece)
            return self.merged(piece) if whole is None else [whole]
        half = len(piece) // 2
        return self.join(self.encode_piece(piece[:half]), self.encode_piece(piece[half:]))

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        memo, found = self.packed, self.split(text)
        new = set(found).difference(memo)
        if new and len(memo) > MEMO:
            self.before, self.packed = memo, {}
            memo = self.packed
            new = set(found)
        for piece in new:
            if (known := self.before.get(piece)) is None:
                ids = self.encode_piece(piece.encode())
                known = struct.pack(f"<{len(ids)}I", *ids)
            memo[piece] = known
        out = b"".join(map(memo.__getitem__, found))
        for piece in new:
            if len(piece) > 64:
                del memo[piece]
        return out

    def forget(self) -> None:
        """Empties the memos, which a worker would keep after its task."""
        self.packed, self.before = {}, {}
        self.pairs.clear()

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, memoryview(ids).cast("I")))


def read_ranks(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}


_codecs: dict[tuple[int, str], Codec] = {}


def codec_of(raw: bytes, pattern: str) -> Codec:
    """One codec per worker process and vocabulary."""
    key = (hash(raw), pattern)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(read_ranks(raw), pattern)
    return _codecs[key]


def coded_batches(batches, codec: Codec, id_col: str = "doc_id"):
    """A task's rows; what is made of a text lives no longer than its slice."""
    for batch in sliced(batches):
        ids = pa.array(map(codec.encode, batch.column(1).to_pylist()), pa.binary())
        decoded = pa.array((codec.decode(x.as_py()) for x in ids), pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), ids, decoded], [id_col, "ids", "decoded"])
    codec.forget()


def encode_decode(df: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`id_col`, `ids` (binary, little-endian unsigned 32-bit) and `decoded` (binary) for each row.

    The rank file (its size is fixed by the vocabulary, under 1 MB) is read by the driver and broadcast.
    Rows are independent: one pass, no shuffle.
    """
    text_batches(df.sparkSession)
    with open(vocabulary, "rb") as f:
        sent = df.sparkSession.sparkContext.broadcast(f.read())
    rows = df.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = rows.select(id_col).withColumns({"ids": F.lit(b""), "decoded": F.lit(b"")}).schema

    def run(batches):
        yield from coded_batches(batches, codec_of(sent.value, pattern), id_col)

    return rows.mapInArrow(tidy(run), schema)


def op7_byte_bpe(spark, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    """The contract's digests of every document's ids and decoded bytes."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    coded = encode_decode(docs, vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )

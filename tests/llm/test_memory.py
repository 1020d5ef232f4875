import tracemalloc

import public_tokenizers as P
import pyarrow as pa
import pytest

from factloom.llm import bpe, private
from factloom.llm.common import sliced

TEXTS = [f"{i} one two three four five six {i % 7} " * 300 for i in range(2000)]
CODEC = bpe.codec_of(open(P.path("byte_bpe_50k.tiktoken"), "rb").read(), P.PATTERN)
FOUND = pa.array([[{"s": 0, "e": 1}]] * len(TEXTS), pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())])))
BATCH = pa.RecordBatch.from_arrays([pa.array(range(len(TEXTS))), pa.array(TEXTS), FOUND], ["doc_id", "text", "_found"])



@pytest.mark.parametrize(
    "run, want",
    [
        (lambda batches: ((x.column(0), x.column(2)) for x in bpe.coded_batches((b.select(["doc_id", "text"]) for b in batches), CODEC)), lambda t: t.encode()),
        (lambda batches: ((x.column(0), x.column(1)) for x in private.masked_batches(batches, 1, ["doc_id", "text"])), lambda t: "<found>" + t[1:]),
    ],
    ids=["bpe", "mask"],
)
def test_objects_of_a_batch_stay_small(run, want):
    """Texts of 20 MB in one batch must not become Python objects all at once."""
    held, rows = 0, 0
    tracemalloc.start()
    try:
        for keys, values in run(iter([BATCH])):
            held = max(held, tracemalloc.get_traced_memory()[1])
            for key, value in zip(keys.to_pylist(), values.to_pylist()):
                assert (key, value) == (rows, want(TEXTS[rows]))
                rows += 1
    finally:
        tracemalloc.stop()
    assert rows == len(TEXTS)
    assert held < 16e6


def test_slices_are_the_batch():
    whole = BATCH.select(["doc_id", "text"])
    assert pa.Table.from_batches(sliced([whole])).equals(pa.Table.from_batches([whole]))
    assert max(x.nbytes for x in sliced([whole])) < 3e6
    assert [x.num_rows for x in sliced([whole.slice(0, 0), whole.slice(3, 2)])] == [2]
    wide = pa.RecordBatch.from_arrays([pa.array(["x" * 5_000_000] * 2)], ["text"])
    assert [x.num_rows for x in sliced([wide])] == [1, 1]

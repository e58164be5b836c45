"""What a worker holds at once."""

import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa

from meterspark.llm.packing import PieceEncoder
from meterspark.llm.suffixes import LENGTH, anchors
from meterspark.llm.texts import chunks


class _Tasks:
    """Stands for a DataFrame whose task function the test calls itself."""

    def mapInArrow(self, run, schema):  # noqa: N802
        return run


def _words(n: int, seed: int) -> list[str]:
    return ["".join(chr(97 + x) for x in row) for row in np.random.default_rng(seed).integers(0, 26, (n, 7)).tolist()]


def test_anchors_hold_little_of_a_batch():
    words = _words(400_000, 1)
    texts = [" ".join(words[i : i + 250]) for i in range(0, len(words), 250)]
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(len(texts)), pa.int64()), pa.array([t.encode() for t in texts], pa.binary())], ["id", "text"]
    )
    run = anchors(_Tasks(), LENGTH)
    assert sum(len(part) for part in run(iter([batch]))) > len(texts)
    tracemalloc.start()
    try:
        for _ in run(iter([batch])):
            pass
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 40 << 20  # 64 bytes of arrays for each of 2^18 bytes, and as much again


def test_remembered_pieces_take_few_bytes():
    encoder = PieceEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    words = _words(60_000, 2)
    whole = [next(chunks(pa.array([" ".join(words[i : i + 6_000])])))[2] for i in range(0, len(words), 6_000)]
    tracemalloc.start()
    try:
        ids = [encoder.encode(chunk)[0] for chunk in whole]
        held = tracemalloc.get_traced_memory()[0] - sum(x.nbytes for x in ids)
    finally:
        tracemalloc.stop()
    assert held < 80 * len(words)
    for chunk, got in zip(whole, ids, strict=True):
        again = encoder.encode(chunk)[0]
        assert np.array_equal(got, again)
        assert got.tolist() == encoder.encoding.encode_ordinary(chunk.data.tobytes().decode())

"""Packing of tokenised documents by minimum bin slack.

Every document is cut into full sequences and a remainder. The remainders of a window of documents
are packed by minimum bin slack: the largest remaining length opens a sequence, and a subset-sum
dynamic programme over a bitset of reachable fills picks, from the multiset of remaining lengths, the
one that comes closest to the capacity; the lengths' counts are backtracked from the bitsets. What the
last sequences of a window leave open is avoided by cutting their content at powers of two, where no
padding is needed.

Windows are bounded by tokens and never leave a task, so nothing is shuffled. Sequence numbers join
the task's partition and a running number.

Token ids are those of the ``tokenizers`` file given. Texts are cut at single spaces between other
characters, where this vocabulary's pattern never joins the two sides; each distinct piece is encoded
once and the ids are put together from them.

Defined results: a null or empty text is the end id alone; repeated rows are packed as often as they
stand; an empty table gives no rows. A single text longer than the window makes its own window.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterspark.llm.texts import Chunk, chunks, expand

CAPACITY = 2048
WINDOW_TOKENS = 1 << 20
# Bounds of a worker's memory: remembered pieces, and bytes of text encoded at once.
CACHE_PIECES = 500_000
CHUNK = 1 << 20
_PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
_SCHEMA = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("start", pa.int64()),
        ("length", pa.int64()),
        ("ids", pa.binary()),
        ("doc_tokens", pa.int64()),
        ("sequence_id", pa.int64()),
        ("offset", pa.int64()),
    ]
)


def byte_pair_ranks(path: str) -> dict[bytes, int]:
    """The vocabulary of a byte-level tokenizer file as bytes to ids; added tokens are left out.

    Such a file writes bytes as printable characters: those that are printable in Latin-1 as
    themselves, the others in order from code point 256.
    """
    with open(path, encoding="utf-8") as file:
        content = json.load(file)
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    added = {token["content"] for token in content.get("added_tokens", [])}
    return {
        bytes(byte_of[c] for c in token): rank
        for token, rank in content["model"]["vocab"].items()
        if token not in added
    }


class PieceEncoder:
    """Ids of distinct text pieces, remembered by hash up to a bounded number.

    The vocabulary and merge order are those of the ``tokenizers`` file; pieces are encoded with
    ``tiktoken``, which gives the same ids several times faster.
    """

    def __init__(self, path: str) -> None:
        import public_tokenizers
        import tiktoken

        self.encoding = tiktoken.Encoding(
            "pieces", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_pair_ranks(path), special_tokens={}
        )
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)  # sorted; start and count of a piece's ids stand beside
        self.start = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)
        self.flat = np.zeros(1 << 18, np.uint32)
        self.used = 0

    @staticmethod
    def _room(array: np.ndarray, size: int) -> np.ndarray:
        return array if len(array) >= size else np.r_[array, np.zeros(max(size, 2 * len(array)) - len(array), array.dtype)]

    def _learn(self, keys: np.ndarray, pieces: list[str]) -> None:
        ids = list(map(self.encoding.encode_ordinary, pieces))
        count = np.fromiter(map(len, ids), np.int64, len(ids))
        total = int(count.sum())
        self.flat = self._room(self.flat, self.used + total)
        self.flat[self.used : self.used + total] = np.fromiter(chain.from_iterable(ids), np.uint32, total)
        start = np.cumsum(count) - count + self.used
        self.used += total
        at = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, at, keys)
        self.start, self.count = np.insert(self.start, at, start), np.insert(self.count, at, count)

    def encode(self, chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a chunk one after the other, and the number of ids of each."""
        start = piece_starts(chunk)
        stop = np.r_[start[1:], len(chunk.data)].astype(np.int64)
        which, distinct = pd.factorize(chunk.span_hash(chunk.prefix(), start, stop))
        first = np.zeros(len(distinct), np.int64)
        first[which[::-1]] = np.arange(len(which))[::-1]
        order = np.argsort(distinct)
        keys = distinct[order]
        if len(self.keys) + len(keys) > CACHE_PIECES:
            self._clear()
        at = np.searchsorted(self.keys, keys)
        new = np.ones(len(keys), bool)
        inside = np.flatnonzero(at < len(self.keys))
        new[inside] = self.keys[at[inside]] != keys[inside]
        if new.any():
            data, own = chunk.data.tobytes(), first[order[new]]
            pieces = [data[a:b].decode() for a, b in zip(start[own].tolist(), stop[own].tolist(), strict=True)]
            self._learn(keys[new], pieces)
            at = np.searchsorted(self.keys, keys)
        place = np.empty(len(keys), np.int64)
        place[order] = at
        at = place[which]
        count = self.count[at]
        total = np.r_[0, np.cumsum(count)]
        edges = np.searchsorted(start, chunk.bounds)
        return self.flat[expand(self.start[at], count)], np.diff(total[edges])


def piece_starts(chunk: Chunk) -> np.ndarray:
    """Starts of pieces that can be encoded alone: texts' beginnings, and single spaces between
    characters that are no white space. Characters that may be wide white space are never cut at."""
    data = chunk.data
    if not len(data):
        return np.zeros(0, np.int64)
    cut = np.flatnonzero(data[1:-1] == 0x20) + 1 if len(data) > 2 else np.zeros(0, np.int64)

    def plain(b: np.ndarray) -> np.ndarray:
        return (b > 0x20) & (b != 0x7F)

    before, after = data[cut - 1], data[cut + 1]
    ok = plain(before) & plain(after)
    # Lead bytes of all wide white space; the character before may be up to three bytes long.
    two, three = data[np.maximum(cut - 2, 0)], data[np.maximum(cut - 3, 0)]
    ok &= ~((before >= 0x80) & ((two == 0xC2) | np.isin(three, (0xE1, 0xE2, 0xE3))))
    ok &= ~np.isin(after, (0xC2, 0xE1, 0xE2, 0xE3))
    nonempty = np.diff(chunk.bounds) > 0
    return np.unique(np.r_[chunk.bounds[:-1][nonempty], cut[ok]])


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """One encoder per worker and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]


def fill_closest(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The multiset of lengths with the largest sum up to ``capacity``, by bitset subset sums.

    Bit s of a layer tells that sum s can be reached. Counts are split into powers of two; layers are
    kept for backtracking. It stops at the first layer that reaches the capacity itself.
    """
    reach, layers, items = 1, [1], []
    mask = (1 << (capacity + 1)) - 1
    full = 1 << capacity
    for length in sorted(counts, reverse=True):
        left, take = min(counts[length], capacity // length), 1
        while left > 0 and not reach & full:
            take = min(take, left)
            reach |= (reach << (length * take)) & mask
            layers.append(reach)
            items.append((length, take))
            left -= take
            take *= 2
        if reach & full:
            break
    total = reach.bit_length() - 1
    chosen: dict[int, int] = {}
    for (length, take), before in zip(reversed(items), reversed(layers[:-1]), strict=True):
        if not before >> total & 1:
            chosen[length] = chosen.get(length, 0) + take
            total -= length * take
    return chosen


def pack_remainders(lengths: np.ndarray, capacity: int = CAPACITY) -> list[list[int]]:
    """Sequences as lists of positions in ``lengths``, by minimum bin slack."""
    waiting: dict[int, list[int]] = {}
    for position, length in enumerate(lengths.tolist()):
        waiting.setdefault(length, []).append(position)
    ordered = sorted(waiting)
    counts = {length: len(waiting[length]) for length in reversed(ordered)}
    out = []
    while ordered:
        largest = ordered[-1]
        counts[largest] -= 1
        if not counts[largest]:
            del counts[largest]
        chosen = fill_closest(counts, capacity - largest) if capacity > largest else {}
        sequence = [waiting[largest].pop()]
        for length, times in chosen.items():
            sequence += [waiting[length].pop() for _ in range(times)]
            counts[length] -= times
            if not counts[length]:
                del counts[length]
        ordered = [x for x in ordered if x in counts] if len(chosen) or largest not in counts else ordered
        out.append(sequence)
    return out


@dataclass
class _Window:
    """Documents whose pieces are placed together."""

    doc_ids: list
    ids: list[np.ndarray]
    tokens: int = 0

    def add(self, doc_id, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_id)
        self.ids.append(ids)
        self.tokens += len(ids)


def _cut_at_powers(fill: int, capacity: int) -> list[int]:
    """Sequence sizes for a fill: one padded sequence, or powers of two where padding would be over 1/64."""
    if capacity - fill <= capacity // 64:
        return [fill]
    return [1 << b for b in range(fill.bit_length() - 1, -1, -1) if fill >> b & 1]


def place(window: _Window, capacity: int, number: int) -> tuple[pa.RecordBatch, int]:
    """Pieces of a window and the next sequence number."""
    rows: list[tuple] = []
    lengths = np.array([len(x) for x in window.ids], np.int64)
    for doc, ids in enumerate(window.ids):
        for start in range(0, len(ids) - capacity + 1, capacity):
            rows.append((doc, start, capacity, number, 0))
            number += 1
    rest = lengths % capacity
    with_rest = np.flatnonzero(rest)
    for sequence in pack_remainders(rest[with_rest], capacity):
        docs = with_rest[sequence]
        sizes = _cut_at_powers(int(rest[docs].sum()), capacity)
        room, offset = sizes[0], 0
        for doc in docs.tolist():
            start, left = int(lengths[doc] - rest[doc]), int(rest[doc])
            while left:
                if offset == room:
                    sizes = sizes[1:]
                    room, offset, number = sizes[0], 0, number + 1
                length = min(left, room - offset)
                rows.append((doc, start, length, number, offset))
                start, left, offset = start + length, left - length, offset + length
        number += 1
    blobs = [window.ids[d][s : s + n].astype("<u4").tobytes() for d, s, n, _, _ in rows]
    batch = pa.RecordBatch.from_arrays(
        [
            pa.array([window.doc_ids[r[0]] for r in rows], pa.int64()),
            pa.array([r[1] for r in rows], pa.int64()),
            pa.array([r[2] for r in rows], pa.int64()),
            pa.array(blobs, pa.binary()),
            pa.array([int(lengths[r[0]]) for r in rows], pa.int64()),
            pa.array([r[3] for r in rows], pa.int64()),
            pa.array([r[4] for r in rows], pa.int64()),
        ],
        schema=_SCHEMA,
    )
    return batch, number


def pack(
    docs: DataFrame,
    tokenizer: str,
    end_id: int = 1,
    capacity: int = CAPACITY,
    window_tokens: int = WINDOW_TOKENS,
) -> DataFrame:
    """One row per piece; ``ids`` holds its token ids as little-endian unsigned 32-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode
        number = TaskContext.get().partitionId() << 33
        window = _Window([], [])
        for batch in batches:
            for first, stop, chunk in chunks(batch.column("text"), CHUNK):
                flat, counts = encode(chunk)
                names = batch.column("doc_id").slice(first, stop - first).to_pylist()
                ends = np.cumsum(counts)
                for doc_id, a, b in zip(names, ends - counts, ends, strict=True):
                    window.add(doc_id, np.r_[flat[a:b], np.uint32(end_id)])
                    if window.tokens >= window_tokens:
                        placed, number = place(window, capacity, number)
                        yield placed
                        window = _Window([], [])
        if window.ids:
            yield place(window, capacity, number)[0]

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _PIECES)


def op6_packing(spark, sf_dir: str) -> DataFrame:
    """Packs every document into sequences of at most 2048 tokens."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    pieces = pack(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )

"""Whole texts of an Arrow batch as byte arrays: words, prefix hashes, n-grams, runs.

A batch is cut into chunks of whole texts, about a mebibyte each, so that the arrays made from one
stay small; only a single text longer than that makes a chunk larger.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C55)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_CODE = np.random.default_rng(20240117).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit values over all bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class _Powers:
    """Powers of the hash base and of its inverse modulo 2^64, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            self.up = np.multiply.accumulate(np.r_[np.uint64(1), np.full(size - 1, _BASE)])
            self.down = np.multiply.accumulate(np.r_[np.uint64(1), np.full(size - 1, _INVERSE)])
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.zeros(0, np.uint8) if data is None else np.frombuffer(data, dtype=np.uint8)), offsets


def slices(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """(first row, row after the last) of consecutive rows of about ``limit`` bytes, at least one row each."""
    _, offsets = raw(column)
    row, rows = 0, len(offsets) - 1
    while row < rows:
        stop = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
        stop = min(max(stop, row + 1), rows)
        yield row, stop
        row = stop


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, Chunk]]:
    """Yields (first row, row after the last, chunk) over all rows of a column."""
    data, offsets = raw(column)
    for row, stop in slices(column, limit):
        yield row, stop, Chunk(data[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row])


class Chunk:
    """Consecutive texts: ``data`` holds their bytes, ``bounds`` where each begins and ends."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray) -> None:
        self.data = data
        self.bounds = bounds
        self.docs = len(bounds) - 1

    def lowered(self) -> Chunk:
        """A-Z as a-z."""
        return Chunk(_LOWER[self.data], self.bounds)

    def prefix(self) -> np.ndarray:
        """Prefix polynomial hashes modulo 2^64, one more than there are bytes."""
        up, _ = _POWERS.upto(len(self.data) + 1)
        h = np.zeros(len(self.data) + 1, dtype=np.uint64)
        np.cumsum(_BYTE_CODE[self.data] * up[:-1], out=h[1:])
        return h

    @staticmethod
    def span_hash(prefix: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Hash of the bytes of each span; equal bytes hash alike wherever they stand."""
        _, down = _POWERS.upto(len(prefix))
        return mix((prefix[stop] - prefix[start]) * down[start] + (stop - start).astype(np.uint64))

    @staticmethod
    def window_hash(prefix: np.ndarray, width: int) -> np.ndarray:
        """Hash of each run of ``width`` bytes, in order; the same as ``span_hash`` gives."""
        _, down = _POWERS.upto(len(prefix))
        h = prefix[width:] - prefix[:-width]
        h *= down[: len(h)]
        h += np.uint64(width)
        return mix(h)

    def doc_of(self, places: np.ndarray) -> np.ndarray:
        """The text each place falls into."""
        return np.searchsorted(self.bounds, places, side="right") - 1

    def spans(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Maximal runs of true bytes; a run never crosses from one text into the next."""
        if not len(inside):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        cuts = self.bounds[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < len(inside))]
        first[cuts] = inside[cuts]
        last[cuts - 1] = inside[cuts - 1]
        return np.flatnonzero(first), np.flatnonzero(last) + 1

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and texts of all words ``[^\\x20\\x09-\\x0D]+``."""
        start, stop = self.spans(~_SPACE[self.data])
        return start, stop, self.doc_of(start)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and texts of all non-empty ``\\n``-separated lines."""
        start, stop = self.spans(self.data != 0x0A)
        return start, stop, self.doc_of(start)

    def code_points(self) -> np.ndarray:
        """Running count of code points, one more than there are bytes."""
        return np.r_[0, np.cumsum((self.data & 0xC0) != 0x80)]


def ngrams(hashes: np.ndarray, docs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and hash of every run of ``n`` words that stays in one text."""
    if len(hashes) < n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    stop = len(hashes) - n + 1
    g = hashes[:stop].copy()
    for j in range(1, n):
        g = mix(g) + hashes[j : stop + j]
    first = np.flatnonzero(docs[:stop] == docs[n - 1 :])
    return first, mix(g[first] + np.uint64(n))


def repeated(keys: np.ndarray) -> np.ndarray:
    """True where a value stands more than once."""
    out = np.zeros(len(keys), dtype=bool)
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    same = s[1:] == s[:-1]
    hit = np.zeros(len(keys), dtype=bool)
    hit[1:] |= same
    hit[:-1] |= same
    out[order] = hit
    return out


def later(keys: np.ndarray) -> np.ndarray:
    """True where a value has stood before."""
    out = np.zeros(len(keys), dtype=bool)
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    out[order[1:]] = s[1:] == s[:-1]
    return out


def with_doc(hashes: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Hashes that only agree within one text."""
    return mix(hashes + docs.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def per_doc(docs: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    """Count, or sum of whole-number weights, for each of ``n`` texts."""
    out = np.bincount(docs, weights=weights, minlength=n)
    return out.astype(np.int64)


def covered(first: np.ndarray, length: int, size: int) -> np.ndarray:
    """True for each of ``size`` places that lies in a run of ``length`` from one of the firsts."""
    delta = np.zeros(size + 1, dtype=np.int32)
    delta[first] += 1
    ends = np.minimum(first + length, size)
    np.subtract.at(delta, ends, 1)
    return np.cumsum(delta[:-1]) > 0


def expand(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All indices of the given ranges, one range after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) - np.repeat(ends - lengths - starts, lengths)

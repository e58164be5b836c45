"""Removal of repeated byte strings over a whole corpus by a hash-compared suffix sort.

A byte is removed when a string of ``length`` bytes that covers it also starts earlier, in a document
with a smaller id or earlier in the same one.

1. Anchors. In every window of ``length`` bytes the ``ANCHOR``-byte string with the smallest hash is
   its anchor; equal windows have the same anchor at the same place, wherever they stand. About one
   place in 35 is an anchor. Its context is what all windows around it can reach.
2. Anchors are grouped by their bytes' hash. Within a group, all but the first occurrence of one whole
   context are repeats as a whole. Where a group holds different contexts, the first occurrence of
   each goes on to step 3; this reads sorted rows as a stream and holds none of them.
3. The suffixes of a group that start at its anchors are sorted: prefix polynomial hashes and binary
   search give the longest common extension of two suffixes, so a comparison in the mergesort takes
   logarithmic time, and many comparisons run at once in numpy. Neighbours in that order with a common
   extension of r bytes agree to the right of the anchor; the hash of the bytes left of it completes
   a window. The first occurrence of a window stays, later ones are compared byte by byte with it
   (collision verification) and removed. A group of more than ``GROUP_SUFFIXES`` contexts is never held:
   the windows that begin ``lo`` to ``hi`` bytes before the anchor agree in ``lo`` bytes left of it and
   ``length - hi`` from its first byte on, so the range of beginnings is halved and each half is grouped
   by the bytes its windows share, until a group is small or holds one window, which is read as a stream.
4. Removed ranges are joined with their documents, merged, and cut out.

Only hashes and places of anchors, and the contexts of step 3, are shuffled. Groups are distinct
contexts of one 32-byte string, so copies of one text, however many, add nothing to a sort.

Defined results: a null or empty text has no bytes; texts shorter than ``length`` lose nothing; rows
with the same id are ordered by a hash of their text, and rows equal in id and text count as one
document and get the same result; a null id sorts first. Columns named ``kept`` or ``removed`` are replaced by
the results, all others pass through whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from meterspark.llm.frames import apart, staged
from meterspark.llm.texts import Chunk, chunks, later, mix

LENGTH = 100
ANCHOR = 32
SEGMENT = 4 << 20
# Bounds of a worker's memory, where arrays take 8 bytes a byte of text: bytes of text at once, and contexts of small groups.
CHUNK = 1 << 18
BATCH_SUFFIXES = 5_000
GROUP_SUFFIXES = 50_000
_TAG_BITS, _PLACE_BITS = 32, 31
_NO_ID = -(1 << 63)


def places_code(tag: np.ndarray, place: np.ndarray) -> np.ndarray:
    """One sortable number of a text's tag and a place in it."""
    return (tag.astype(np.int64) << _PLACE_BITS) | place.astype(np.int64)


def text_tags(chunk: Chunk, prefix: np.ndarray) -> np.ndarray:
    """Hash bits of every text; they tell texts of one id apart."""
    whole = chunk.span_hash(prefix, chunk.bounds[:-1], chunk.bounds[1:])
    return (whole >> np.uint64(64 - _TAG_BITS)).astype(np.int64)


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of ``width`` values."""
    n = len(values) - width + 1
    pad = -len(values) % width
    blocks = np.r_[values, np.full(pad, values.max())].reshape(-1, width)
    forward = np.minimum.accumulate(blocks, axis=1).ravel()
    backward = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[:n], forward[width - 1 : width - 1 + n])


def anchor_places(chunk: Chunk, prefix: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of all anchors of the texts of a chunk, and the hashes of their bytes."""
    width = length - ANCHOR + 1
    if len(chunk.data) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    grams = chunk.window_hash(prefix, ANCHOR)
    places = []
    for low in range(0, len(grams) - width + 1, SEGMENT):  # positions fit the low bits of a key
        part = grams[low : low + SEGMENT + width - 1]
        bits = np.uint64(int(len(part)).bit_length())
        keys = ((mix(part) >> bits) << bits) | np.arange(len(part), dtype=np.uint64)
        least = _sliding_min(keys, width) & ((np.uint64(1) << bits) - np.uint64(1))
        window = np.arange(low, low + len(least))
        inside = chunk.doc_of(window) == chunk.doc_of(window + length - 1)
        places.append(np.unique(least[inside]).astype(np.int64) + low)
    places = np.unique(np.concatenate(places))
    return places, grams[places]


def _reach(chunk: Chunk, places: np.ndarray, docs: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """How far the context of an anchor goes to its left, and from its first byte to the right."""
    left = np.minimum(places - chunk.bounds[docs], length - ANCHOR)
    right = np.minimum(chunk.bounds[docs + 1] - places, length)
    return left, right


def anchors(docs: DataFrame, length: int) -> DataFrame:
    """(gram, context, id, code) of every anchor of (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            for first, stop, chunk in chunks(batch.column("text"), CHUNK):
                prefix = chunk.prefix()
                places, grams = anchor_places(chunk, prefix, length)
                doc = chunk.doc_of(places)
                left, right = _reach(chunk, places, doc, length)
                context = chunk.span_hash(prefix, places - left, places + right) + left.astype(np.uint64)
                code = places_code(text_tags(chunk, prefix)[doc], places - chunk.bounds[doc])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(grams.view(np.int64)),
                        pa.array(mix(context).view(np.int64)),
                        pa.array(ids[first:stop][doc].astype(np.int64)),
                        pa.array(code),
                    ],
                    ["gram", "context", "id", "code"],
                )

    return docs.mapInArrow(run, "gram long, context long, id long, code long")


def fresh_rows(columns: list[np.ndarray], last: tuple | None) -> np.ndarray:
    """True for rows of sorted columns that differ from the row before; ``last`` is the one before the first."""
    fresh = np.ones(len(columns[0]), bool)
    fresh[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    fresh[0] = last is None or any(c[0] != x for c, x in zip(columns, last, strict=True))
    return fresh


def classify(anchored: DataFrame) -> DataFrame:
    """(id, code, whole): repeats of a whole context, and first occurrences that need step 3.

    Rows come sorted, so anchors of rows equal in id and text stand side by side and count once; of the
    group that goes over the edge of a batch only its last row and the first occurrence that waits for a
    second context are kept.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None  # the row before
        waiting: tuple[int, int] | None = None  # id and code of a group's only first occurrence so far
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(c).to_numpy() for c in ("gram", "context", "id", "code")]
            before, once = last, fresh_rows(columns, last)
            last = tuple(c[-1] for c in columns)
            gram, context, ids, code = (c[once] for c in columns)
            if not len(gram):
                continue
            new_gram = np.r_[before is None or gram[0] != before[0], gram[1:] != gram[:-1]]
            new_context = new_gram | np.r_[before is None or context[0] != before[1], context[1:] != context[:-1]]
            out = [(ids[~new_context], code[~new_context], True)]
            firsts = np.flatnonzero(new_context)
            # A first occurrence matters if its group has another one.
            opens = new_gram[firsts]
            follows = np.r_[~opens[1:], False]
            needed = ~opens | follows
            out.append((ids[firsts[needed]], code[firsts[needed]], False))
            if waiting is not None and len(firsts) and not opens[0]:
                out.append((np.array([waiting[0]]), np.array([waiting[1]]), False))
            if len(firsts):
                at = firsts[-1]
                waiting = (int(ids[at]), int(code[at])) if opens[-1] else None
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([o[0] for o in out])),
                    pa.array(np.concatenate([o[1] for o in out])),
                    pa.array(np.concatenate([np.full(len(o[0]), o[2]) for o in out])),
                ],
                ["id", "code", "whole"],
            )

    ordered = anchored.repartition("gram").sortWithinPartitions("gram", "context", "id", "code")
    return ordered.mapInArrow(run, "id long, code long, whole boolean")


def contexts(marked: DataFrame, length: int) -> DataFrame:
    """(gram, id, code, left, bytes) for the places in ``firsts`` of (id, text, firsts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, firsts = batch.column("id").to_pylist(), batch.column("firsts")
            for first, stop, chunk in chunks(batch.column("text"), CHUNK):
                prefix = chunk.prefix()
                tags, data = text_tags(chunk, prefix), chunk.data.tobytes()
                rows: list[tuple] = []
                for row in range(first, stop):
                    codes = np.asarray(firsts[row].values)
                    codes = codes[codes >> _PLACE_BITS == tags[row - first]]
                    places = (codes & ((1 << _PLACE_BITS) - 1)) + chunk.bounds[row - first]
                    left, right = _reach(chunk, places, np.full(len(places), row - first), length)
                    grams = chunk.span_hash(prefix, places, places + ANCHOR).view(np.int64)
                    rows += [
                        (g, ids[row], c, lo, data[p - lo : p + hi])
                        for g, c, p, lo, hi in zip(*(x.tolist() for x in (grams, codes, places, left, right)), strict=True)
                    ]
                columns = list(zip(*rows, strict=True)) or [[]] * 5
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["gram", "id", "code", "left", "bytes"]
                )

    return marked.mapInArrow(run, "gram long, id long, code long, left int, bytes binary")


class Suffixes:
    """Suffixes of a byte array that start at given places and have given lengths."""

    def __init__(self, chunk: Chunk, start: np.ndarray, size: np.ndarray) -> None:
        self.data, self.prefix, self.start, self.size = chunk.data, chunk.prefix(), start, size
        self.chunk = chunk

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Longest common extension of suffixes x and y: binary search over equal prefix hashes."""
        a, b = self.start[x], self.start[y]
        low, high = np.zeros(len(x), np.int64), np.minimum(self.size[x], self.size[y])
        for _ in range(int(high.max(initial=0)).bit_length()):
            middle = (low + high + 1) >> 1
            equal = self.chunk.span_hash(self.prefix, a, a + middle) == self.chunk.span_hash(self.prefix, b, b + middle)
            low, high = np.where(equal, middle, low), np.where(equal, high, middle - 1)
        return low

    def less(self, x: np.ndarray, y: np.ndarray, or_equal: bool) -> np.ndarray:
        """Whether suffix x comes before suffix y."""
        n = self.common(x, y)
        ends_x, ends_y = n == self.size[x], n == self.size[y]
        last = len(self.data) - 1
        a, b = self.data[np.minimum(self.start[x] + n, last)], self.data[np.minimum(self.start[y] + n, last)]
        return np.where(ends_x, ~ends_y | or_equal, ~ends_y & (a < b))

    def sort(self, group: np.ndarray) -> np.ndarray:
        """Order of all suffixes within each group (groups are consecutive): a bottom-up mergesort.

        In each pass every suffix finds by binary search how many of the neighbouring run come before
        it; the searches of all suffixes run side by side.
        """
        n = len(group)
        order = np.arange(n)
        new = np.r_[True, group[1:] != group[:-1]]
        begin = np.flatnonzero(new)
        sizes = np.diff(np.r_[begin, n])
        base, total = np.repeat(begin, sizes), np.repeat(sizes, sizes)
        width = 1
        while width < sizes.max(initial=0):
            at = np.flatnonzero(total > width)
            local = at - base[at]
            run = local // width
            other = (run ^ 1) * width
            partner = base[at] + np.minimum(other, total[at])
            length = np.clip(total[at] - other, 0, width)
            mine, right = order[at], run % 2 == 1
            low, high = np.zeros(len(at), np.int64), length.copy()
            for _ in range(width.bit_length()):
                open_ = np.flatnonzero(low < high)
                middle = (low[open_] + high[open_]) >> 1
                found = order[partner[open_] + middle]
                strictly = self.less(found, mine[open_], False)
                ties = np.zeros(len(open_), bool)
                of_right = np.flatnonzero(right[open_] & ~strictly)
                ties[of_right] = self.less(found[of_right], mine[open_][of_right], True)
                before = strictly | ties
                low[open_] = np.where(before, middle + 1, low[open_])
                high[open_] = np.where(before, high[open_], middle)
            merged = order.copy()
            merged[base[at] + (run >> 1) * 2 * width + local - run * width + low] = mine
            order, width = merged, width * 2
        return order


def repeats(
    group: np.ndarray, left: np.ndarray, lo: np.ndarray, hi: np.ndarray, column: pa.Array, length: int
) -> tuple[np.ndarray, np.ndarray]:
    """For contexts in the order of their occurrence: bytes left of the anchor, and from its first byte
    to the right, that later windows cover; both 0 where no window repeats. Windows begin ``lo`` to ``hi``
    bytes before the anchor."""
    chunk = next(chunks(column, 1 << 62))[2]
    start = chunk.bounds[:-1] + left
    size = chunk.bounds[1:] - start
    suffixes = Suffixes(chunk, start, size)
    order = suffixes.sort(group)
    common = np.r_[0, suffixes.common(order[:-1], order[1:])]
    common[np.r_[True, group[order][1:] != group[order][:-1]]] = 0
    reach_left, reach_right = np.zeros(len(group), np.int64), np.zeros(len(group), np.int64)
    run = np.empty(len(group), np.int64)
    steps = np.arange(length)
    for o in range(int(lo.min(initial=length)), int(hi.max(initial=-1)) + 1):
        r = length - o
        run[order] = np.cumsum(common < r)
        valid = np.flatnonzero((left >= o) & (size >= r) & (lo <= o) & (o <= hi))
        if len(valid) < 2:
            continue
        before = chunk.span_hash(suffixes.prefix, start[valid] - o, start[valid])
        keys = mix(before + run[valid].astype(np.uint64))
        at = np.flatnonzero(later(keys))
        if not len(at):
            continue
        _, first, which = np.unique(keys, return_index=True, return_inverse=True)
        again, source = valid[at], valid[first[which[at]]]
        equal = np.ones(len(at), bool)
        for low in range(0, len(at), 1 << 13):
            part = slice(low, low + (1 << 13))
            a = chunk.data[(start[again[part]] - o)[:, None] + steps]
            equal[part] = (a == chunk.data[(start[source[part]] - o)[:, None] + steps]).all(axis=1)
        again = again[equal]
        reach_left[again] = o
        reach_right[again] = np.maximum(reach_right[again], r)
    return reach_left, reach_right


_FOUND = ("gram", "lo", "hi", "id", "code", "left", "bytes")
_SOLVED = "gram long, lo int, hi int, id long, code long, left int, right int, bytes binary"
_ARROW = pa.schema(
    [("gram", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("id", pa.int64()), ("code", pa.int64())]
    + [("left", pa.int32()), ("right", pa.int32()), ("bytes", pa.binary())]
)


def _solved(table: pa.Table, length: int) -> pa.RecordBatch:
    """Rows of whole groups whose windows repeat; ``bytes`` is null."""
    begin, *numbers = (table[c].to_numpy().astype(np.int64) for c in ("gram", "left", "lo", "hi"))
    left, right = repeats(begin, *numbers, table["bytes"].combine_chunks(), length)
    hit = np.flatnonzero(right)
    columns = [table[c].take(pa.array(hit)).combine_chunks() for c in ("gram", "lo", "hi", "id", "code")]
    columns += [pa.array(x[hit].astype(np.int32)) for x in (left, right)]
    return pa.RecordBatch.from_arrays([*columns, pa.nulls(len(hit), pa.binary())], schema=_ARROW)


def _unsolved(table: pa.Table) -> pa.RecordBatch:
    """Rows of a group too large to hold, as they came; ``right`` is null."""
    columns = [table[c].combine_chunks() for c in _FOUND]
    return pa.RecordBatch.from_arrays([*columns[:-1], pa.nulls(table.num_rows, pa.int32()), columns[-1]], schema=_ARROW)


def one_window(table: pa.Table, seen: set[bytes], length: int) -> pa.RecordBatch:
    """Later rows of a group that shares one window; ``seen`` keeps what came before."""
    o = table["lo"][0].as_py()
    again = np.zeros(table.num_rows, bool)
    for row, (left, body) in enumerate(zip(table["left"].to_pylist(), table["bytes"].to_pylist(), strict=True)):
        window = body[left - o : left - o + length]
        again[row] = window in seen
        seen.add(window)
    hit = table.filter(pa.array(again)).combine_chunks()
    n = hit.num_rows
    columns = [hit[c].combine_chunks() for c in ("gram", "lo", "hi", "id", "code")]
    columns += [pa.array(np.full(n, x, np.int32)) for x in (o, length - o)]
    return pa.RecordBatch.from_arrays([*columns, pa.nulls(n, pa.binary())], schema=_ARROW)


def _solve_groups(found: DataFrame, length: int, most: int) -> DataFrame:
    """Repeats of all groups of at most ``most`` contexts or of one window, and the contexts of all others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []  # whole groups, then the parts of the one that may go on
        rows = tail = 0  # rows held, and those of the last group
        last: tuple | None = None  # gram, id and code of the row before
        name = streamed = None  # the last group, and the one that is passed on and not held
        seen: set[bytes] = set()

        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(c).to_numpy() for c in ("gram", "id", "code")]
            once = fresh_rows(columns, last)  # rows equal in id and text give their contexts twice
            last = tuple(c[-1] for c in columns)
            table = pa.Table.from_batches([batch]).filter(pa.array(once)).combine_chunks()
            gram = table["gram"].to_numpy()
            if not len(gram):
                continue
            edges = np.r_[0, np.flatnonzero(gram[1:] != gram[:-1]) + 1, len(gram)]
            # The first and last group may go over the edges of a batch; small ones between stay together.
            alone = np.diff(edges) > most
            alone[[0, -1]] = True
            cuts = edges[np.r_[True, alone[1:] | alone[:-1], True]].tolist()
            for low, high in zip(cuts[:-1], cuts[1:], strict=True):
                piece, opens = table.slice(low, high - low), name is None or gram[low] != name
                name = gram[high - 1]
                if opens:
                    streamed, tail = None, 0
                    if rows >= BATCH_SUFFIXES:
                        yield _solved(pa.concat_tables(held), length)
                        held, rows = [], 0
                if streamed is None:
                    held.append(piece)
                    rows, tail = rows + piece.num_rows, tail + piece.num_rows
                    if tail <= most or gram[low] != name:  # small groups side by side
                        continue
                    both = pa.concat_tables(held)
                    held, piece = [both.slice(0, rows - tail)] if rows > tail else [], both.slice(rows - tail)
                    streamed, seen, rows = name, set(), rows - tail
                single = piece["lo"][0] == piece["hi"][0]
                yield one_window(piece, seen, length) if single else _unsolved(piece)
        if held:
            yield _solved(pa.concat_tables(held), length)

    ordered = found.select(*_FOUND).repartition("gram").sortWithinPartitions("gram", "id", "code")
    return ordered.mapInArrow(run, _SOLVED)


def halved(rows: DataFrame, length: int) -> DataFrame:
    """Contexts once for each half of their range of windows, grouped by the bytes these share."""
    middle = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
    halves = F.array(F.struct(F.col("lo"), middle.alias("hi")), F.struct((middle + 1).alias("lo"), F.col("hi")))
    rows = rows.select("id", "code", "left", "bytes", F.explode(halves).alias("half"))
    rows = rows.select("id", "code", "left", "bytes", "half.lo", "half.hi")
    rows = rows.where((F.col("left") >= F.col("lo")) & (F.length("bytes") - F.col("left") >= length - F.col("hi")))
    begin, size = F.col("left") - F.col("lo") + 1, F.col("lo") + length - F.col("hi")
    gram = F.xxhash64("lo", "hi", F.substring(F.col("bytes"), begin, size))
    return rows.withColumn("gram", gram)


def sorted_repeats(found: DataFrame, length: int, most: int = GROUP_SUFFIXES) -> DataFrame:
    """(id, code, left, right): what windows around a first occurrence repeat from other contexts."""
    left = found.withColumn("lo", F.lit(0)).withColumn("hi", F.lit(length - ANCHOR))
    parts = []
    while True:
        done = staged(_solve_groups(left, length, most), "suffixes")
        parts.append(done.where("right IS NOT NULL").select("id", "code", "left", "right"))
        left = done.where("right IS NULL")
        if left.isEmpty():
            break
        left = halved(left, length)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def merged_spans(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the union of ranges."""
    if not len(start):
        return start, stop
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(stop[order])
    opens = np.r_[True, start[1:] > reach[:-1]]
    return start[opens], reach[np.r_[opens[1:], True]]


def _whole_characters(body: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranges narrowed so that no character of several bytes is cut."""
    inner = np.r_[(body & 0xC0) == 0x80, False]
    for _ in range(3):
        start = start + inner[start]
        stop = stop - inner[stop]
    some = start < stop
    return start[some], stop[some]


def remove_repeats(
    docs: DataFrame, length: int = LENGTH, whole_characters: bool = False, most: int = GROUP_SUFFIXES
) -> DataFrame:
    """All columns of ``docs`` with ``kept`` (remaining bytes) and ``removed`` (array of start, stop).

    ``whole_characters`` keeps all bytes of a character of which some would stay; ``most`` contexts of one
    string are held at once.
    """
    docs, named = apart(docs.drop("kept", "removed"), "doc_id", "text")
    # Rows without an id come last and are told apart by 62 bits of their text's hash beside its tag.
    lacking = F.lit(_NO_ID) + F.shiftrightunsigned(F.xxhash64("text"), 2)
    key = F.coalesce(F.col("doc_id").cast("long"), lacking).alias("id")
    body = F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text")
    texts = docs.select(key, body)
    marks = classify(anchors(texts, length)).groupBy("id").agg(
        F.collect_list(F.when(F.col("whole"), F.col("code"))).alias("wholes"),
        F.collect_list(F.when(~F.col("whole"), F.col("code"))).alias("firsts"),
    )
    marks = staged(marks, "marks")
    first_marks = marks.where(F.size("firsts") > 0).select("id", "firsts")
    partly = sorted_repeats(contexts(texts.join(first_marks, "id"), length), length, most)
    partly = staged(
        partly.groupBy("id").agg(F.collect_list(F.struct("code", "left", "right")).alias("parts")), "parts"
    )
    passed = [c for c in docs.columns if c not in ("kept", "removed", "__id")]
    source = docs.select(*passed, key.alias("__id"))
    both = marks.select(F.col("id").alias("__id"), "wholes").join(partly.withColumnRenamed("id", "__id"), "__id", "full")
    joined = source.join(both, "__id", "left")
    span = StructType([StructField("start", LongType(), False), StructField("stop", LongType(), False)])
    schema = StructType(
        [
            *docs.select(*passed).schema.fields,
            StructField("kept", BinaryType(), False),
            StructField("removed", ArrayType(span, False), False),
        ]
    )
    low = (1 << _PLACE_BITS) - 1

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wholes, parts = batch.column("wholes"), batch.column("parts")
            for first, stop, chunk in chunks(batch.column("text"), CHUNK):
                tags, bodies, spans = text_tags(chunk, chunk.prefix()), [], []
                for row in range(first, stop):
                    tag, body = tags[row - first], chunk.data[chunk.bounds[row - first] : chunk.bounds[row - first + 1]]
                    code, left, right = (np.zeros(0, np.int64) for _ in range(3))
                    if wholes[row].is_valid:
                        code = np.asarray(wholes[row].values)
                        left, right = np.full(len(code), length - ANCHOR), np.full(len(code), length)
                    if parts[row].is_valid:
                        part = parts[row].values
                        code, left, right = (
                            np.r_[a, np.asarray(part.field(f), np.int64)]
                            for a, f in ((code, "code"), (left, "left"), (right, "right"))
                        )
                    mine = code >> _PLACE_BITS == tag
                    place = code[mine] & low
                    a, b = merged_spans(np.maximum(place - left[mine], 0), np.minimum(place + right[mine], len(body)))
                    if whole_characters:
                        a, b = _whole_characters(body, a, b)
                    edges = np.r_[0, np.c_[a, b].ravel(), len(body)]
                    bodies.append(b"".join(body[p:q].tobytes() for p, q in edges.reshape(-1, 2).tolist()))
                    spans.append([{"start": p, "stop": q} for p, q in zip(a.tolist(), b.tolist(), strict=True)])
                rows = batch.slice(first, stop - first)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(rows.column(c) for c in passed),
                        pa.array(bodies, pa.binary()),
                        pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))),
                    ],
                    [*passed, "kept", "removed"],
                )

    return joined.mapInArrow(cut, schema).select(*named, "kept", "removed")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What remains of every document without strings of 100 bytes that stand earlier."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    cut = remove_repeats(docs)
    lengths = F.transform("removed", lambda s: s["stop"] - s["start"])
    return cut.select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        F.aggregate(lengths, F.lit(0).cast("long"), lambda a, b: a + b).alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )

"""N-gram Jaccard join: size-banded tiles with hashed bitmap signatures.

Texts with one shingle set are one vertex from the start. The rest:

1. Bands and segments. Sizes are cut into bands so that sets which may link lie in one band or in
   neighbouring ones. For a band with sets of up to ``hi`` shingles, linked sets differ in at most d
   shingles; hashing shingles into more than d segments leaves some segment untouched. The contents of
   a set's segments are its keys, so linked sets share a key: no link is lost (see ``segment_keys``
   for empty segments). A key is a tile of sets of similar size that agree in one segment. There are spare
   segments, so each set leaves out its commonest keys: passages that many sets hold make no tiles of all of them.
2. Stars. Every set is compared with the leader of the tiles it shares most, by bitmaps and then exactly,
   by intersecting sorted arrays; in further rounds with leaders outside its component. That joins nearly all of a
   large group of near copies with a few comparisons a member.
3. Tiles. Tiles that still hold sets of different components are merged where they agree in band and
   smallest component, and searched by bitmap signatures: differing bits bound the symmetric difference
   from below and so the overlap from above. Short bitmaps tell which sets have a possible partner at
   all; these meet again with their texts. There, long bitmaps bound the overlap and sorted arrays are
   intersected, but only where no link found before joins the two components, so pairs never leave
   the task and a tile emits fewer links than it has rows. A large tile is split into blocks of bounded
   size, smaller for larger sets, compared block by block.
4. Components of all links.

Joins with texts or signatures are always merge joins: either side grows with the corpus.

Every pair that shares a key either already is in one component or is compared, so the result is
complete; tiles and copies are never expanded into pairs that leave a task.

Defined results: texts without words (null, empty, white space) have no shingles and are their own
component; fewer words than a shingle make one shingle; repeated rows get the same component; rows
with a null id take part, the smallest non-null id names the component (null where there is none).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meterspark.llm.components import connected_components, extend_components
from meterspark.llm.frames import staged
from meterspark.llm.texts import Chunk, chunks, expand, mix, ngrams

BLOCK = 2048
#: Shingles that a block of a tile may hold (8 bytes each, two blocks at a time); blocks of very large sets are smaller.
BLOCK_SHINGLES = 1 << 22
PART = 256
ROUNDS = 3
#: So many sets or more count as one number of sets that have a key.
MANY = 1 << 20
MIN_BITS, MAX_BITS = 256, 1 << 18
SHORT, LONG = 2, 32
BAND_BITS = 7
_SALT = np.uint64(0x2545F4914F6CDD1D)


class Bands:
    """Size bands [lo, hi], the largest allowed difference in each, and the number of segments."""

    def __init__(self, percent: int, largest: int = 1 << 40) -> None:
        self.percent = percent
        lows, low = [], 1
        while low <= largest:
            lows.append(low)
            low = max(low, low * 3 // 2) + 1
        self.low = np.array(lows, np.int64)
        high = self.high = np.r_[self.low[1:] - 1, low - 1]
        self.differ = 2 * high * (100 - percent) // (100 + percent)
        self.spare = 2 + self.differ // 12
        self.segments = self.differ + 1 + self.spare

    def views(self, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(set, band) for the bands in which each set has keys: its own, and the next where it may link up."""
        own = np.searchsorted(self.low, sizes, side="right") - 1
        up = 100 * sizes >= self.percent * self.low[own + 1]
        sets = np.r_[np.arange(len(sizes)), np.flatnonzero(up)]
        band = np.r_[own, own[up] + 1]
        able = self.differ[band] > 0  # else only equal sets link, and those are one vertex
        return sets[able], band[able]

    def unlike(self, sizes: np.ndarray, band: np.ndarray) -> np.ndarray:
        """The shingles in which sets of these sizes may differ at most from one they link with in the band."""
        largest = np.minimum(100 * sizes // self.percent, self.high[band])
        return np.minimum(self.differ[band], (sizes + largest) * (100 - self.percent) // (100 + self.percent))


def shingle_sets(chunk: Chunk, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts one after the other, and how many each text has."""
    chunk = chunk.lowered()
    start, stop, doc = chunk.words()
    words = chunk.span_hash(chunk.prefix(), start, stop)
    first, grams = ngrams(words, doc, size)
    docs, parts = doc[first], grams
    counts = np.bincount(doc, minlength=chunk.docs)
    for few in range(1, size):
        first, grams = ngrams(words, doc, few)
        short = counts[doc[first]] == few
        docs, parts = np.r_[docs, doc[first][short]], np.r_[parts, grams[short]]
    order = np.lexsort((parts, docs))
    docs, parts = docs[order], parts[order]
    new = np.ones(len(docs), bool)
    new[1:] = (docs[1:] != docs[:-1]) | (parts[1:] != parts[:-1])
    return parts[new], np.bincount(docs[new], minlength=chunk.docs)


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of consecutive groups of the given sizes, modulo 2^64."""
    total = np.r_[np.uint64(0), np.cumsum(values, dtype=np.uint64)]
    ends = np.cumsum(sizes)
    return total[ends] - total[ends - sizes]


def vertices(parts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """One number per set, equal for equal sets."""
    return mix(_sums(mix(parts ^ _SALT), sizes) + sizes.astype(np.uint64)).view(np.int64)


def segment_keys(parts: np.ndarray, sizes: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(set, key, spared) of all sets: hashes of what each of their segments holds, and how many of the
    set's keys of that band may be left out.

    A set that differs from each it links with in at most D shingles shares with them all of its segments but
    D. So of all segments in one order, the same for all sets, the first D + 1 of either set hold one that
    both share. The order is: filled segments, by how many sets have the key, then empty ones. A set with
    more than D + 1 filled segments may leave out the commonest; one with fewer also gives keys to its first
    empty segments.
    """
    sets, band = bands.views(sizes)
    begin = np.cumsum(sizes) - sizes
    length = sizes[sets]
    values = parts[expand(begin[sets], length)]
    view = np.repeat(np.arange(len(sets)), length)
    count = bands.segments[band]
    base = np.cumsum(count) - count
    place = base[view] + (mix(values + _SALT) % count[view].astype(np.uint64)).astype(np.int64)
    order = np.argsort(place, kind="stable")
    filled, sizes_in = np.unique(place[order], return_counts=True)
    content = _sums(mix(values[order]), sizes_in)
    owner = np.searchsorted(base, filled, side="right") - 1
    over = np.bincount(owner, minlength=len(sets)) - bands.unlike(length, band) - 1
    sparse = over < 0
    if sparse.any():
        every = expand(base[sparse], count[sparse])
        lacking = every[~np.isin(every, filled)]
        lacks = np.searchsorted(base, lacking, side="right") - 1
        lacking = lacking[np.arange(len(lacks)) - np.searchsorted(lacks, lacks) < -over[lacks]]
        filled, content = np.r_[filled, lacking], np.r_[content, np.zeros(len(lacking), np.uint64)]
        owner = np.searchsorted(base, filled, side="right") - 1
    of_key = band[owner].astype(np.uint64)
    name = (of_key << np.uint64(48)) + (filled - base[owner]).astype(np.uint64)
    keys = (mix(content + mix(name + np.uint64(1))) >> np.uint64(BAND_BITS)) | (of_key << np.uint64(64 - BAND_BITS))
    return sets[owner], keys.view(np.int64), np.maximum(over, 0)[owner]


def band_of_key(key: Column) -> Column:
    """The size band of a key, which its highest bits hold."""
    return F.shiftrightunsigned(key, 64 - BAND_BITS).cast("int")


def bitmaps(parts: np.ndarray, sizes: np.ndarray, per: int) -> list[bytes]:
    """A bitmap per set with ``per`` to twice as many bits for each shingle, as a power of two."""
    begin, out = np.cumsum(sizes) - sizes, []
    for a, n in zip(begin.tolist(), sizes.tolist(), strict=True):
        bits = min(max(MIN_BITS, 1 << (per * n - 1).bit_length()), MAX_BITS)
        flags = np.zeros(bits, np.uint8)
        flags[(mix(parts[a : a + n] ^ (_SALT << np.uint64(1))) & np.uint64(bits - 1)).astype(np.int64)] = 1
        out.append(np.packbits(flags, bitorder="little").tobytes())
    return out


def _folded(maps: list[bytes], words: int) -> np.ndarray:
    """Bitmaps as rows of so many 64-bit words, longer ones folded."""
    return np.stack([np.bitwise_or.reduce(np.frombuffer(m, np.uint64).reshape(-1, words), axis=0) for m in maps])


def _links(common, x, y, percent: int):
    """Whether an overlap reaches the similarity; whole numbers, so exact."""
    return 100 * common >= percent * (x + y - common)


def members(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, v, n, h): every row with its set, the set's size and a hash of its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, stop, chunk in chunks(batch.column("text")):
                parts, sizes = shingle_sets(chunk, size)
                ids, hashes = (batch.column(c).slice(first, stop - first) for c in ("doc_id", "h"))
                columns = [ids, pa.array(vertices(parts, sizes)), pa.array(sizes), hashes]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "v", "n", "h"])

    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
    return rows.mapInArrow(run, "doc_id long, v long, n long, h long")


def _whole_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """(key, v, spared) of sorted batches without repeats, the rows of one key together unless there are ``MANY`` or more."""
    held, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.stack([batch.column(c).to_numpy() for c in ("key", "v", "spared")])
        new = np.r_[last != tuple(rows[:2, 0]), (rows[:2, 1:] != rows[:2, :-1]).any(axis=0)]
        last, rows = tuple(rows[:2, -1]), rows[:, new]
        if not rows.size:
            continue
        cut = int(np.searchsorted(rows[0], rows[0, -1]))
        if cut:
            yield np.hstack([*held, rows[:, :cut]])
            held = []
        elif held and (held[0][0, 0] != rows[0, 0] or sum(h.shape[1] for h in held) >= MANY):
            yield np.hstack(held)
            held = []
        held.append(rows[:, cut:])
    if held:
        yield np.hstack(held)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, v, spared, sets) of keys that two or more sets have; sets is how many, ``MANY`` at most."""
    common = None
    for keys, v, spared in _whole_keys(batches):
        begin = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        sets = np.diff(np.r_[begin, len(keys)])
        sets = np.minimum(np.repeat(sets, sets), MANY)
        if keys[0] == common:
            sets[keys == common] = MANY
        common = keys[-1] if sets[-1] == MANY else None
        columns = [pa.array(c[sets > 1]) for c in (keys, v, spared, sets)]
        rows = pa.RecordBatch.from_arrays(columns, ["key", "v", "spared", "sets"])
        yield from (rows.slice(k, 1 << 16) for k in range(0, rows.num_rows, 1 << 16))


def shared_keys(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """(key, leader, v) for all keys that two or more sets have; the leader is the first of them.

    Keys are counted first, as a set leaves out its commonest ones (see ``segment_keys``): a passage that very
    many sets hold makes no tile of all of them unless it is most of what they hold.
    """
    bands = Bands(percent)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, chunk in chunks(batch.column("text")):
                parts, sizes = shingle_sets(chunk, size)
                v = vertices(parts, sizes)
                once = np.zeros(len(v), bool)
                once[np.unique(v, return_index=True)[1]] = True  # copies in one chunk give their keys once
                once &= sizes > 0
                begin = np.cumsum(sizes) - sizes
                kept = parts[expand(begin[once], sizes[once])]
                sets, keys, spared = segment_keys(kept, sizes[once], bands)
                columns = [pa.array(keys), pa.array(v[once][sets]), pa.array(spared)]
                yield pa.RecordBatch.from_arrays(columns, ["key", "v", "spared"])

    def lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, leader, last, alone = None, None, None, True
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, v = batch.column("key").to_numpy(), batch.column("v").to_numpy()
            new_key = np.r_[key is None or keys[0] != key, keys[1:] != keys[:-1]]
            other = new_key | np.r_[last is None or v[0] != last, v[1:] != v[:-1]]
            keys, v, new_key = keys[other], v[other], new_key[other]
            if not len(keys):
                continue
            first = np.maximum.accumulate(np.where(new_key, np.arange(len(keys)), -1))
            leaders = np.where(first >= 0, v[np.maximum(first, 0)], leader if leader is not None else 0)
            joined = ~new_key
            led = np.r_[joined[1:], False] & new_key  # a leader is listed with its first follower
            out = joined | led
            ahead = ([key], [leader], [leader]) if joined[0] and alone else ([], [], [])
            alone = bool(new_key[-1]) or (len(keys) == 1 and not joined[0])
            key, leader, last = keys[-1], leaders[-1], v[-1]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.r_[np.array(a, np.int64), b[out]].astype(np.int64))
                    for a, b in zip(ahead, (keys, leaders, v), strict=True)
                ],
                ["key", "leader", "v"],
            )

    emitted = docs.select("text").mapInArrow(emit, "key long, v long, spared long")
    ordered = emitted.repartition("key").sortWithinPartitions("key", "v")
    counted = ordered.mapInArrow(_counted, "key long, v long, spared long, sets long")
    commonest = Window.partitionBy("v", band_of_key(F.col("key"))).orderBy(F.desc("sets"), F.desc("key"))
    rare = counted.withColumn("place", F.row_number().over(commonest)).where("place > spared").select("key", "v")
    ordered = rare.repartition("key").sortWithinPartitions("key", "v")
    return ordered.mapInArrow(lead, "key long, leader long, v long")


def _room(a: np.ndarray, b: np.ndarray, x: int, y: int, percent: int) -> bool:
    """Whether the bitmaps of two sets of x and y shingles leave room for a link: the overlap's bound from above."""
    if len(a) != len(b):
        longer, words = (a, len(b)) if len(a) > len(b) else (b, len(a))
        folded = np.bitwise_or.reduce(longer.reshape(-1, words), axis=0)
        a, b = (folded, b) if longer is a else (a, folded)
    differ = int(np.bitwise_count(a ^ b).sum())
    return _links((x + y - differ) // 2, x, y, percent)


def exact_links(rows: DataFrame, size: int, percent: int) -> DataFrame:
    """(a, b) that link, from rows (star, part, follows, v, text): each follower is compared with its star.

    Bitmaps bound the overlap first; sorted arrays are intersected only where these leave room.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        star, of_star, of_map = None, None, None
        for batch in batches:
            stars, follows, v = (batch.column(c).to_pylist() for c in ("star", "follows", "v"))
            out: list[tuple[int, int]] = []
            for first, stop, chunk in chunks(batch.column("text")):
                parts, sizes = shingle_sets(chunk, size)
                ends = np.cumsum(sizes)
                maps = [np.frombuffer(m, np.uint64) for m in bitmaps(parts, sizes, LONG)]
                for row in range(first, stop):
                    own, own_map = parts[ends[row - first] - sizes[row - first] : ends[row - first]], maps[row - first]
                    if not follows[row]:
                        star, of_star, of_map = stars[row], own, own_map
                    elif star == stars[row] and _room(own_map, of_map, len(own), len(of_star), percent):
                        common = len(np.intersect1d(own, of_star, assume_unique=True))
                        if _links(common, len(own), len(of_star), percent):
                            out.append((star, v[row]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([o[i] for o in out], pa.int64()) for i in (0, 1)], ["a", "b"]
            )

    ordered = rows.repartition("star", "part").sortWithinPartitions("star", "part", "follows")
    return ordered.mapInArrow(run, "a long, b long")


def _star_rows(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Rows for ``exact_links`` from pairs (star, v): the star's text, then its followers'.

    A star with many followers is dealt out in parts of about ``PART`` of them, each with its text.
    """
    sizes = pairs.groupBy("star").agg(F.ceil(F.count("*") / PART).alias("parts"))
    dealt = pairs.join(sizes, "star").select("star", F.pmod(F.xxhash64("v"), "parts").alias("part"), "v")
    stars = dealt.select("star", "part", F.lit(0).alias("follows"), F.col("star").alias("v")).distinct()
    return stars.unionByName(dealt.select("star", "part", F.lit(1).alias("follows"), "v")).join(
        texts.hint("merge"), "v"
    )


def star_links(shared: DataFrame, texts: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Links found by comparing sets with leaders of their tiles, and their components (v, label).

    In each round every set is compared with one leader outside its component, the one it shares most
    tiles with and was not compared with before; so a round costs at most one comparison a set.
    """
    votes = staged(shared.where("v <> leader").groupBy("v", "leader").agg(F.count("*").alias("keys")), "votes")
    links = labels = tried = None
    for _ in range(ROUNDS):
        left = votes
        if labels is not None:
            of_v, of_leader = (labels.withColumnsRenamed({"v": k, "label": f"of_{k}"}) for k in ("v", "leader"))
            left = left.join(of_v, "v", "left").join(of_leader, "leader", "left")
            left = left.where(~F.coalesce("of_v", "v").eqNullSafe(F.coalesce("of_leader", "leader")))
            left = left.join(tried, ["v", "leader"], "left_anti")
        best = left.groupBy("v").agg(F.max_by("leader", F.struct("keys", "leader")).alias("star"))
        best = staged(best.select("star", "v"), "stars")
        found = staged(exact_links(_star_rows(best, texts), size, percent), "links")
        if found.isEmpty() and links is not None:
            break
        links = found if links is None else links.unionByName(found)
        now = best.select("v", F.col("star").alias("leader"))
        tried = now if tried is None else tried.unionByName(now)
        labels = connected_components(found) if labels is None else extend_components(labels, found)
    return links, labels


def open_tiles(shared: DataFrame, labels: DataFrame, bands: Bands) -> DataFrame:
    """(low, band, i, j, side, v, label): members of tiles with several components.

    Two near misses share many keys, and keys of one neighbourhood mostly have the same smallest
    component; so the open tiles of a band with that component in common become one tile, and a set
    travels once for all of them. A tile of more than ``BLOCK`` members (fewer of large sets) is split: every block meets
    every other in a tile of its own.
    """
    known = shared.select("key", "v").join(labels, "v", "left").select("key", "v", F.coalesce("label", "v").alias("label"))
    groups = known.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"))
    open_ = groups.where("low <> high").select("key", "low")
    rows = known.join(open_, "key").select("low", band_of_key(F.col("key")).alias("band"), "v", "label").distinct()
    rows = staged(rows, "open")
    largest = F.array(*(F.lit(int(v)) for v in np.clip(BLOCK_SHINGLES // bands.high, 16, BLOCK)))
    sizes = rows.groupBy("low", "band").agg(F.count("*").alias("rows"))
    sizes = sizes.select("low", "band", F.ceil(F.col("rows") / F.get(largest, F.col("band"))).cast("int").alias("blocks"))
    rows = rows.join(sizes, ["low", "band"]).withColumn("own", F.pmod(F.xxhash64("v"), "blocks").cast("int"))
    rows = rows.select("low", "band", "v", "label", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    return rows.select(
        "low",
        "band",
        F.least("own", "other").alias("i"),
        F.greatest("own", "other").alias("j"),
        (F.col("own") > F.col("other")).cast("int").alias("side"),
        "v",
        "label",
    )


def _near_in_tile(tile: pa.Table, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of a tile, of different components, whose bitmaps leave room for a link.

    Rows are taken in order of size, so each meets only those whose sizes allow a link, and bitmaps
    are folded no further than to the smallest of these.
    """
    same_block = tile["i"][0].as_py() == tile["j"][0].as_py()
    label, v, n, side = (tile[c].to_numpy() for c in ("label", "v", "n", "side"))
    order = np.argsort(n, kind="stable")
    label, v, n, side = label[order], v[order], n[order], side[order]
    maps = tile["bitmap"].to_pylist()
    maps = [maps[k] for k in order.tolist()]
    low = 0
    while low < len(n):
        words = len(maps[low]) // 8
        reach = int(np.searchsorted(n, 100 * n[low] // percent, side="right"))
        step = max(1, (1 << 21) // (words * max(1, reach - low)))
        high = min(low + step, int(np.searchsorted(n, n[low] + n[low] // 16, side="right")))
        stop = int(np.searchsorted(n, 100 * n[high - 1] // percent, side="right"))
        fold = _folded(maps[low:stop], words)
        differ = np.bitwise_count(fold[: high - low, None, :] ^ fold[None, :, :]).sum(axis=2, dtype=np.int64)
        total = n[low:high, None] + n[None, low:stop]
        fits = _links((total - differ) // 2, n[low:high, None], n[None, low:stop], percent)
        fits &= label[low:high, None] != label[None, low:stop]
        if not same_block:
            fits &= side[low:high, None] != side[None, low:stop]
        x, y = np.nonzero(fits)
        once = x < y  # rows before this step have met these already
        yield order[x[once] + low], order[y[once] + low]
        low = high


def _by_tile(rows: DataFrame, solve, schema: str) -> DataFrame:
    """Applies ``solve`` (a table of one tile to record batches) to all tiles of the rows."""
    tile = ["low", "band", "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            place = 0
            names = [batch.column(c).to_numpy() for c in tile]
            change = np.flatnonzero(np.any([x[1:] != x[:-1] for x in names], axis=0)) + 1 if batch.num_rows else []
            for edge in [*change, batch.num_rows]:
                piece = batch.slice(place, edge - place)
                place = edge
                if piece.num_rows and held and any(held[0].column(c)[0] != piece.column(c)[0] for c in tile):
                    yield from solve(pa.Table.from_batches(held))
                    held = []
                if piece.num_rows:
                    held.append(piece)
        if held:
            yield from solve(pa.Table.from_batches(held))

    return rows.repartition(*tile).sortWithinPartitions(*tile).mapInArrow(run, schema)


def near_rows(rows: DataFrame, percent: int) -> DataFrame:
    """Those rows of tiles that have a partner by their (short) bitmaps."""
    kept = ["low", "band", "i", "j", "side", "v", "label"]

    def solve(tile: pa.Table) -> Iterator[pa.RecordBatch]:
        near = np.zeros(tile.num_rows, bool)
        for x, y in _near_in_tile(tile, percent):
            near[x] = near[y] = True
        yield from tile.select(kept).filter(pa.array(near)).combine_chunks().to_batches()

    schema = "low long, band int, i int, j int, side int, v long, label long"
    return _by_tile(rows.select(*kept, "n", "bitmap"), solve, schema)


def tile_links(rows: DataFrame, size: int, percent: int) -> DataFrame:
    """(a, b) that link different components, from the rows of tiles with their texts.

    The task holds the tile's sorted shingle arrays. Pairs whose bitmaps leave room are intersected there, unless
    links found before already join their components; so a tile gives at most one link less than it has rows.
    """

    def solve(tile: pa.Table) -> Iterator[pa.RecordBatch]:
        arrays, maps = [], []
        for _, _, chunk in chunks(tile["text"]):
            parts, sizes = shingle_sets(chunk, size)
            arrays += np.split(parts, np.cumsum(sizes)[:-1])
            maps += bitmaps(parts, sizes, LONG)
        tile = tile.drop_columns(["text"]).append_column("n", pa.array([len(a) for a in arrays], pa.int64()))
        tile = tile.append_column("bitmap", pa.array(maps, pa.binary()))
        v = tile["v"].to_numpy()
        component = np.unique(tile["label"].to_numpy(), return_inverse=True)[1]
        found: list[tuple[int, int]] = []
        for xs, ys in _near_in_tile(tile, percent):
            for x, y in zip(xs.tolist(), ys.tolist()):
                if component[x] == component[y]:
                    continue
                common = len(np.intersect1d(arrays[x], arrays[y], assume_unique=True))
                if _links(common, len(arrays[x]), len(arrays[y]), percent):
                    component[component == component[y]] = component[x]
                    found.append((min(v[x], v[y]), max(v[x], v[y])))
        yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    return _by_tile(rows, solve, "a long, b long")


def signatures(texts: DataFrame, size: int, per: int) -> DataFrame:
    """(v, n, bitmap) of texts (v, text), with ``per`` bits or more for each shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, stop, chunk in chunks(batch.column("text")):
                parts, sizes = shingle_sets(chunk, size)
                v = batch.column("v").slice(first, stop - first)
                maps = pa.array(bitmaps(parts, sizes, per), pa.binary())
                yield pa.RecordBatch.from_arrays([v, pa.array(sizes), maps], ["v", "n", "bitmap"])

    return texts.mapInArrow(run, "v long, n long, bitmap binary")


def tiled(shared: DataFrame, labels: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """(a, b): links between components, found in tiles: short bitmaps tell which rows have a possible
    partner at all, and these meet again with their texts."""
    rows = open_tiles(shared, labels, Bands(percent))
    near = staged(near_rows(rows.join(signatures(texts, size, SHORT).hint("merge"), "v"), percent), "near")
    return tile_links(near.join(texts.hint("merge"), "v"), size, percent).distinct()


def links(docs: DataFrame, size: int, percent: int, of: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links between different sets, enough for all components, and those components (v, label)."""
    shared = staged(shared_keys(docs, size, percent), "shared")
    texts = staged(set_texts(docs, shared, of), "texts")
    near, labels = star_links(shared, texts, size, percent)
    more = staged(tiled(shared, labels, texts, size, percent), "links")
    if more.isEmpty():
        return near, labels
    return near.unionByName(more), extend_components(labels, more)


def set_texts(docs: DataFrame, shared: DataFrame, of: DataFrame) -> DataFrame:
    """(v, text): one text for every set with a shared key, that of its smallest row in ``row_order``.

    Rows are found by id and hash of their text, so null and repeated ids lead to the right text.
    """
    first = of.groupBy("v").agg(F.min(row_order()).alias("row"))
    wanted = staged(shared.select("v").distinct().join(first, "v").select("v", "row.*"), "wanted")
    keys = ["lacks_id", "id", "h"]
    rows = docs.select(*row_keys(F.xxhash64("text")), "text")
    return rows.join(wanted.hint("merge"), keys).dropDuplicates([*keys, "v"]).select("v", "text")


def row_keys(h: Column) -> list[Column]:
    """A row's id, null or not, and the hash of its text, as columns that never are null."""
    key = F.col("doc_id").cast("long")
    return [key.isNull().alias("lacks_id"), F.coalesce(key, F.lit(0)).alias("id"), h.alias("h")]


def row_order() -> Column:
    """Rows by id, null last, and by the hash of their text."""
    return F.struct(*row_keys(F.col("h")))


def labelled_sets(docs: DataFrame, shingle: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Members of ``docs``, and (v, low, label): every set with its smallest id and its component."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    every = staged(members(docs, shingle), "members")
    filled = every.where("n > 0")
    _, labels = links(docs, shingle, percent, filled)
    sets = filled.groupBy("v").agg(F.min("doc_id").alias("low"))
    return every, sets.join(labels, "v", "left").select("v", "low", F.coalesce("label", "v").alias("label"))


def jaccard_components(docs: DataFrame, shingle: int = 4, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id, set_id) of every row of ``docs``.

    ``percent`` is the least similarity in percent, ``shingle`` the words of a shingle.
    """
    every, sets = labelled_sets(docs, shingle, percent)
    names = sets.groupBy("label").agg(F.min("low").alias("component_id"))
    found = sets.join(names, "label").select("v", "component_id")
    own = F.when(F.col("n") > 0, F.col("v"))
    return (
        every.select("doc_id", F.col("n").alias("n_shingles"), own.alias("v"))
        .join(found, "v", "left")
        .select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.col("v").alias("set_id"))
    )


def keep_one(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each component, the smallest by id (null last) and hash of its text.

    Of rows equal in id and text one stays; rows without words are in no component and all stay.
    """
    every, sets = labelled_sets(docs, shingle, percent)
    rows = every.where("n > 0").join(sets, "v").groupBy("label").agg(F.min(row_order()).alias("row"))
    keys = ["lacks_id", "id", "h"]
    first = staged(rows.select("row.*").distinct(), "kept")
    has_words = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    whole = F.struct(*docs.columns).alias("whole")
    filled = docs.where(has_words).select(*row_keys(F.xxhash64("text")), whole)
    kept = filled.join(first, keys).dropDuplicates(keys).select("whole.*")
    return kept.unionByName(docs.where(~has_words))


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate component of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return jaccard_components(docs, 4, 85).select("doc_id", "n_shingles", "component_id")

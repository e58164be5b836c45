"""Conversation structure repair: the cheapest edits that make a conversation's roles legal.

Rows are judged (blank, duplicate, truncated), then kept, given another role, deleted or preceded by empty
rows so that the initials of the roles read ``(s?(ua)+)?``. Costs before a row depend on one of four places in
that pattern, so a row maps the four costs behind it to the four costs before it.

Rank-convergence parallel Viterbi. Rows are sorted by conversation and turn over range partitions and packed
into blocks of bounded length, one byte a row. A block falls into chunks that all start at once from a
speculative cost vector and run backwards; where the vector a chunk really gets differs from the one it used by
more than a constant, the chunk reruns, until a row is reached whose vector differs only by a constant: all
decisions before it stand. Between blocks, a conversation's vector passes over the driver, one small row a
block. The stitched decisions then drive the trace from the front, which takes the ASCII-least of the cheapest
edits. As a hash over a whole conversation is sequential, its texts pass through one task, as a sorted stream
that holds a few hundred rows at a time; everything before that cuts a long conversation over many tasks.

Defined results: null role, text, conversation and turn count as one space where rows are damaged, a null turn
comes before all turns, a null conversation is one conversation; rows of one turn are ordered by the MD5 of
role and text; rows equal in all are duplicates of the first; a role without characters cannot be kept; an
empty table gives an empty table; very long texts are only hashed and streamed; other columns are not read, so
their names cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from meterspark.llm.frames import staged

#: Costs of an edit; deleting is required for blank and duplicate rows.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
CHUNK_ROWS = 128
BLOCK_ROWS = 1 << 20
_READ_ROWS = 256
_SPACES = " \t\n\x0b\x0c\r"

# Places in the pattern: 0 nothing yet, 1 after s, 2 after u, 3 after a; 0 and 3 may end.
_NEXT = np.array([2, 2, 3, 2])  # the role that an inserted or changed row must take leads here
_KEPT = np.array([[1, -1, -1, -1], [2, 2, -1, 2], [-1, -1, 3, -1], [-1, -1, -1, -1]])  # by initial s, u, a, other
_END = np.array([0, 2 * INSERT, INSERT, 0], np.int64)
_NEVER = 1 << 40
# Bits of a row's code: two for the initial, then its fault.
_CUT, _BLANK, _AGAIN = 4, 8, 16
_ROLES = {0: "user", 1: "user", 2: "assistant", 3: "user"}


def _step(codes: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Costs before rows and the best edit's letter for each place, from the costs after the rows."""
    extra = np.where(codes & _CUT, TRUNCATED, 0)[:, None]
    gone = (codes & (_BLANK | _AGAIN) > 0)[:, None]
    target = _KEPT[codes & 3]
    keep = np.where(gone | (target < 0), _NEVER, np.take_along_axis(after, np.maximum(target, 0), 1) + extra)
    role = np.where(gone, _NEVER, after[:, _NEXT] + extra + REROLE)
    delete = after + DELETE
    cost = np.minimum(np.minimum(keep, role), delete)
    low = cost.copy()
    low[:, 2] = np.minimum(cost[:, 2], INSERT + cost[:, 3])
    low[:, 3] = np.minimum(cost[:, 3], INSERT + cost[:, 2])
    low[:, :2] = np.minimum(cost[:, :2], INSERT + low[:, 2:3])
    letters = np.full(low.shape, ord("R"), np.uint8)
    for letter, match in (("K", keep == low), ("I", low[:, _NEXT] + INSERT == low), ("D", delete == low)):
        letters[match] = ord(letter)  # the later of these is the less in ASCII
    return low, letters


def _squares(codes: np.ndarray, ends: np.ndarray, chunk: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows as one line a chunk; the last line is filled with rows that pass costs through."""
    lines = -(-len(codes) // chunk)
    real = np.zeros(lines * chunk, bool)
    real[: len(codes)] = True
    wide = [np.zeros(lines * chunk, a.dtype) for a in (codes, ends)]
    for target, values in zip(wide, (codes, ends)):
        target[: len(values)] = values
    return tuple(a.reshape(lines, chunk) for a in (*wide, real))


def decide(codes: np.ndarray, ends: np.ndarray, right: np.ndarray, chunk: int = CHUNK_ROWS) -> tuple[np.ndarray, np.ndarray, int]:
    """(letters by row and place, costs before the first row up to a constant, passes).

    ``ends`` marks the last row of a conversation; ``right`` are the costs behind the last row.
    """
    lined, stops, real = _squares(codes, ends, chunk)
    lines = len(lined)
    used = np.tile(_END, (lines, 1))
    used[-1] = right - right.min()
    vectors = np.full((lines, chunk, 4), -1, np.int64)
    letters = np.zeros((lines, chunk, 4), np.uint8)
    active, passes = np.arange(lines), 0
    while len(active):
        passes += 1
        after = used[active]
        for j in range(chunk - 1, -1, -1):
            after = np.where(stops[active, j, None], _END, after)
            before, best = _step(lined[active, j], after)
            before = np.where(real[active, j, None], before, after)
            before = before - before.min(axis=1, keepdims=True)
            letters[active, j] = best  # also where the vector stands: the row's edit depends on what follows it
            fresh = (before != vectors[active, j]).any(axis=1)
            active, after = active[fresh], before[fresh]
            if not len(active):
                break
            vectors[active, j] = after
        active = np.flatnonzero((vectors[1:, 0] != used[:-1]).any(axis=1))
        used[active] = vectors[active + 1, 0]
    return letters.reshape(-1, 4)[: len(codes)], vectors[0, 0], passes


def transfer(codes: np.ndarray, chunk: int = CHUNK_ROWS) -> np.ndarray:
    """What rows of one unfinished conversation do to any costs: entry [b, s] leads from s to b behind them."""
    lined, _, real = _squares(codes, np.zeros(len(codes), bool), chunk)
    basis = np.where(np.eye(4, dtype=bool), 0, _NEVER)
    lines = len(lined)
    costs = np.tile(basis, (lines, 1))
    for j in range(chunk - 1, -1, -1):
        before, _ = _step(np.repeat(lined[:, j], 4), costs)
        costs = np.minimum(np.where(np.repeat(real[:, j], 4)[:, None], before, costs), _NEVER)
    costs = costs.reshape(lines, 4, 4)
    whole = costs[-1]
    for line in costs[-2::-1]:
        whole = np.minimum((whole[:, :, None] + line[None, :, :]).min(axis=1), _NEVER)
    return whole


def trace(letters: bytes, codes: bytes, place: int, last: bool) -> tuple[str, int, int]:
    """(edits, place behind the rows, cost) from a place, with the letters of :func:`decide`."""
    out, cost, after_kept, forced = [], 0, (1, 2, 3), _NEXT.tolist()
    for i, code in enumerate(codes):
        while (letter := letters[4 * i + place]) == 73:  # I
            out.append("I")
            cost += INSERT
            place = forced[place]
        if letter == 68:  # D
            out.append("D")
            cost += DELETE
            continue
        cost += TRUNCATED if code & _CUT else 0
        if letter == 75:  # K
            out.append("K")
            place = after_kept[code & 3]
        else:
            out.append("R")
            cost += REROLE
            place = forced[place]
    while last and place in (1, 2):
        out.append("I")
        cost += INSERT
        place = forced[place]
    return "".join(out), place, cost


def damage(rows: DataFrame) -> DataFrame:
    """``rows`` (conv, turn, role, text) with the contract's damage; ``dropped`` rows keep only their conv."""
    conv, turn, role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv", "turn", "role", "text"))
    kind = F.crc32(F.concat_ws(":", conv, turn).cast("binary")) % 20
    rows = rows.select("conv", "turn", role.alias("role"), text.alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role"))
    times = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = rows.select("conv", "turn", role.alias("role"), text.alias("text"), (F.col("kind") == 0).alias("dropped"), F.explode(times).alias("copy"))
    return rows.drop("copy")


def _digest(role: Column, text: Column) -> Column:
    return F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")))


def judged(rows: DataFrame) -> DataFrame:
    """(conv, turn, digest, code): each row's initial and fault, without its text."""
    trimmed = F.rtrim(F.col("text"), F.lit(_SPACES))
    initial = F.substring("role", 1, 1)
    code = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    fault = F.when(trimmed == "", _BLANK).when(~F.substring(trimmed, -1, 1).isin(".", "!", "?"), _CUT).otherwise(0)
    return rows.where("not dropped").select("conv", "turn", _digest(F.col("role"), F.col("text")).alias("digest"), (code + fault).cast("int").alias("code"))


def with_repeats(rows: DataFrame) -> DataFrame:
    """Adds ``later``: role and text of a row of an earlier turn; null comes before every turn.

    Only digests of more than one turn are joined; of a digest, one row comes from each task.
    """
    turns = rows.groupBy("conv", "digest").agg(
        F.min("turn").alias("low"), F.max("turn").alias("high"), F.count("turn").alias("known"), F.count("*").alias("all")
    )
    unknown = F.col("known") < F.col("all")
    turns = turns.where((F.col("low") < F.col("high")) | (unknown & (F.col("known") > 0)))
    first = turns.select(F.col("conv").alias("of"), F.col("digest").alias("seen"), F.when(~unknown, F.col("low")).alias("first"), F.lit(True).alias("more"))
    joined = rows.join(first, F.col("conv").eqNullSafe(F.col("of")) & (F.col("digest") == F.col("seen")), "left")
    turn = F.col("turn")
    later = F.col("more") & turn.isNotNull() & (F.col("first").isNull() | (turn > F.col("first")))
    return joined.select("conv", "turn", "digest", "code", F.coalesce(later, F.lit(False)).alias("later"))


def _packed(block_rows: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sorted rows as blocks (part, no, convs, sizes, codes)."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, no = TaskContext.get().partitionId(), 0
        convs: list = []
        sizes: list[int] = []
        codes = bytearray()
        previous: tuple | None = None

        def block(kind: pa.DataType) -> pa.RecordBatch:
            columns = [pa.array([part], pa.int32()), pa.array([no], pa.int32()), pa.array([convs], pa.list_(kind))]
            columns += [pa.array([sizes], pa.list_(pa.int64())), pa.array([bytes(codes)], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["part", "no", "convs", "sizes", "codes"])

        kind = pa.int64()
        for rows in batches:
            kind = rows.column("conv").type
            columns = [rows.column(c).to_pylist() for c in ("conv", "turn", "digest", "code", "later")]
            for conv, turn, digest, code, later in zip(*columns):
                key = (conv, turn, digest)
                if (later or key == previous) and not code & _BLANK:
                    code = code & 3 | _AGAIN
                previous = key
                if sizes and convs[-1] == conv:
                    sizes[-1] += 1
                else:
                    convs.append(conv)
                    sizes.append(1)
                codes.append(code)
                if len(codes) >= block_rows:
                    yield block(kind)
                    convs, sizes, codes, no = [], [], bytearray(), no + 1
        if codes:
            yield block(kind)

    return pack


def blocks_of(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Judged rows sorted over range partitions of bounded length, packed into blocks."""
    spark = rows.sparkSession
    light = staged(rows, "judged")
    count = light.count()
    parts = max(-(-count // block_rows), min(spark.sparkContext.defaultParallelism, -(-count // 20_000)), 1)
    keys = ["conv", "turn", "digest"]
    conv = light.schema["conv"].dataType.simpleString()
    ranged = with_repeats(light).repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    return staged(ranged.mapInArrow(_packed(block_rows), f"part int, no int, convs array<{conv}>, sizes array<long>, codes binary"), "blocks")


def _summaries(chunk: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(part, no, first, last, single, initials, costs): what the neighbours of a block must know."""

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            costs, single, initials = [], [], []
            for sizes, raw_codes in zip(rows.column("sizes").to_pylist(), rows.column("codes").to_pylist()):
                codes = np.frombuffer(raw_codes, np.uint8)
                single.append(len(sizes) == 1)
                initials.append([int(codes[0] & 3), int(codes[-1] & 3)])
                if single[-1]:
                    costs.append(transfer(codes, chunk).ravel().tolist())
                else:
                    costs.append(decide(codes[: sizes[0]], np.zeros(sizes[0], bool), _END, chunk)[1].tolist())
            convs = rows.column("convs")
            ends = [pa.array([c[k].as_py() for c in convs], convs.type.value_type) for k in (0, -1)]
            columns = [rows.column("part"), rows.column("no"), *ends, pa.array(single), pa.array(initials), pa.array(costs)]
            yield pa.RecordBatch.from_arrays(columns, ["part", "no", "first", "last", "single", "initials", "costs"])

    return summarise


def _stitch(summaries: list) -> dict[tuple[int, int], tuple[list[int] | None, int | None]]:
    """For each block: the costs behind its last row if that conversation goes on, and the initial before its first."""
    out: dict = {}
    behind: np.ndarray | None = None
    for at in range(len(summaries) - 1, -1, -1):
        block = summaries[at]
        goes_on = at + 1 < len(summaries) and summaries[at + 1]["first"] == block["last"]
        right = behind if goes_on else None
        begun = at > 0 and summaries[at - 1]["last"] == block["first"]
        out[block["part"], block["no"]] = (None if right is None else right.tolist(), summaries[at - 1]["initials"][1] if begun else None)
        if block["single"]:
            own = np.array(block["costs"], np.int64).reshape(4, 4) + (_END if right is None else right)[:, None]
            behind = own.min(axis=0)
        else:
            behind = np.array(block["costs"], np.int64)
        behind = behind - behind.min()
    return out


def _pieces(borders: dict, chunk: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Edits and counts of each conversation's part in a block; four ways where it began in an earlier block."""
    names = ["part", "no", "seg", "conv", "start", "place", "edges", "audit", "blank", "duplicate", "truncated", "illegal", "cost"]
    legal = np.zeros((4, 4), bool)
    legal[[0, 1, 2], [1, 2, 1]] = True

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for row in range(len(rows)):
                part, no, convs, sizes, raw_codes = (rows.column(c)[row].as_py() for c in ("part", "no", "convs", "sizes", "codes"))
                right, before = borders[part, no]
                codes = np.frombuffer(raw_codes, np.uint8)
                stops = np.cumsum(sizes)
                ends = np.zeros(len(codes), bool)
                ends[stops - 1] = True
                ends[-1] = right is None
                letters = decide(codes, ends, _END if right is None else np.array(right), chunk)[0].tobytes()
                initial = codes & 3
                wrong = np.r_[before is not None and not legal[before or 0, initial[0]], ~legal[initial[:-1], initial[1:]]]
                wrong[stops[:-1]] = False
                counts = [np.add.reduceat(hit, stops - sizes, dtype=np.int64) for hit in (codes & _BLANK > 0, codes & _AGAIN > 0, codes & _CUT > 0, wrong)]
                out = []
                for seg, (conv, stop, size) in enumerate(zip(convs, stops.tolist(), sizes)):
                    begun, goes_on = seg == 0 and before is not None, seg == len(sizes) - 1 and right is not None
                    for place in range(4) if begun else (0,):
                        audit, at, cost = trace(letters[4 * (stop - size) : 4 * stop], raw_codes[stop - size : stop], place, not goes_on)
                        out.append((part, no, seg, conv, place, at, begun + 2 * goes_on, audit, *(int(c[seg]) for c in counts), cost))
                kinds = [pa.int32()] * 3 + [rows.column("convs").type.value_type] + [pa.int32()] * 3 + [pa.string()] + [pa.int64()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)

    return follow


def _chosen(edges: list) -> list[tuple[int, int, int]]:
    """(part, no, start) of each block whose first conversation began earlier; edges come in order."""
    out, place = [], 0
    for (part, no), group in groupby(edges, key=lambda e: (e["part"], e["no"])):
        after = place
        for edge in group:
            if edge["edges"] & 1 and edge["start"] == place:
                out.append((part, no, place))
            if edge["edges"] & 2 and (not edge["edges"] & 1 or edge["start"] == place):
                after = edge["place"]
        place = after
    return out


def edits(rows: DataFrame, chunk: int = CHUNK_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(conv, part, no, audit, blank, duplicate, truncated, illegal, cost): each conversation's edits, in parts."""
    spark = rows.sparkSession
    conv = rows.schema["conv"].dataType.simpleString()
    blocks = blocks_of(judged(rows), block_rows)
    schema = f"part int, no int, first {conv}, last {conv}, single boolean, initials array<long>, costs array<long>"
    borders = _stitch(blocks.mapInArrow(_summaries(chunk), schema).orderBy("part", "no").collect())  # one row a block
    schema = f"part int, no int, seg int, conv {conv}, start int, place int, edges int, audit string, blank long, duplicate long, truncated long, illegal long, cost long"
    pieces = staged(blocks.mapInArrow(_pieces(borders, chunk), schema), "pieces")
    edges = pieces.where("edges > 0").select("part", "no", "seg", "start", "place", "edges").orderBy("part", "no", "seg", "start").collect()
    chosen = spark.createDataFrame(_chosen(edges), "part int, no int, start int")  # one row a block
    return pieces.where("edges % 2 = 0").unionByName(pieces.where("edges % 2 = 1").join(chosen, ["part", "no", "start"], "left_semi")).drop("start", "seg", "place", "edges")


COUNTS = ["blank", "duplicate", "truncated", "illegal", "cost"]


def _repaired(kind: pa.DataType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One row a conversation, from its edits (kind 1) and then its rows (kind 2) in order."""
    names = ["conv_id", "gaps", *COUNTS, "audit", "repaired_sha256"]

    class Conversation:
        def __init__(self, conv) -> None:
            self.conv, self.audit, self.counts = conv, [], [0] * len(COUNTS)
            self.low = self.high = None
            self.turns, self.place, self.at, self.letters = 0, 0, 0, None
            self.hash, self.lines = hashlib.sha256(), 0

        def line(self, role: str, text: str) -> None:
            self.hash.update((b"\n" if self.lines else b"") + f"{role}:{text}".encode())
            self.lines += 1

        def inserts(self) -> None:
            while self.at < len(self.letters) and self.letters[self.at] == "I":
                self.line(_ROLES[self.place], "")
                self.place = int(_NEXT[self.place])
                self.at += 1

        def row(self, turn: int | None, role: str, text: str) -> None:
            if self.letters is None:
                self.letters = "".join(self.audit)
            if turn is not None and turn != self.high:
                self.turns += 1
                self.low = turn if self.low is None else self.low
                self.high = turn
            self.inserts()
            letter = self.letters[self.at]
            self.at += 1
            if letter == "K":
                self.line(role, text)
                self.place = int(_KEPT["sua".index(role[0]), self.place])
            elif letter == "R":
                self.line(_ROLES[self.place], text)
                self.place = int(_NEXT[self.place])

        def result(self) -> tuple:
            self.letters = self.letters or ""
            self.inserts()
            gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
            return (self.conv, gaps, *self.counts, self.letters, self.hash.hexdigest())

    def repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: Conversation | None = None
        done: list[tuple] = []
        types = [kind] + [pa.int64()] * (1 + len(COUNTS)) + [pa.string()] * 2

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), types)], names)

        for rows in (batch.slice(at, _READ_ROWS) for batch in batches for at in range(0, len(batch), _READ_ROWS)):
            columns = [rows.column(c).to_pylist() for c in ("conv", "kind", "turn", "role", "text", "counts")]
            for conv, what, turn, role, text, counts in zip(*columns):
                if now is None or now.conv != conv:
                    if now is not None:
                        done.append(now.result())
                    now = Conversation(conv)
                if what == 1:
                    now.audit.append(text)
                    now.counts = [a + b for a, b in zip(now.counts, counts)]
                elif what == 2:
                    now.row(turn, role, text)
            if len(done) >= 1000:
                yield batch()
                done = []
        if now is not None:
            done.append(now.result())
        if done:
            yield batch()

    return repair


def repair_conversations(
    rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", chunk: int = CHUNK_ROWS, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Damages ``rows`` as the contract says and returns one row a conversation with its repair."""
    rows = rows.select(*(F.col(c).alias(n) for n, c in (("conv", conv_id), ("turn", turn), ("role", role), ("text", text))))
    rows = damage(rows.withColumn("turn", F.col("turn").cast("long")))
    pieces = edits(rows, chunk, block_rows)
    none = F.lit(None)
    empty = [none.cast("int").alias("part"), none.cast("int").alias("no")]
    counts = F.array(*COUNTS)
    texts = rows.select(
        "conv",
        F.when(F.col("dropped"), 0).otherwise(2).alias("kind"),
        *empty,
        "turn",
        F.when(~F.col("dropped"), _digest(F.col("role"), F.col("text"))).alias("digest"),
        F.when(~F.col("dropped"), F.col("role")).alias("role"),
        F.when(~F.col("dropped"), F.col("text")).alias("text"),
        none.cast("array<bigint>").alias("counts"),
    )
    parts = pieces.select(
        "conv", F.lit(1).alias("kind"), "part", "no", none.cast("long").alias("turn"), none.cast("binary").alias("digest"), none.cast("string").alias("role"), F.col("audit").alias("text"), counts.alias("counts")
    )
    keys = ["conv", "kind", "part", "no", "turn", "digest"]
    stream = texts.unionByName(parts).repartition("conv").sortWithinPartitions(*keys).select("conv", "kind", "turn", "role", "text", "counts")
    conv = rows.schema["conv"].dataType
    schema = f"conv_id {conv.simpleString()}, gaps long, " + ", ".join(f"{c} long" for c in COUNTS) + ", audit string, repaired_sha256 string"
    return stream.mapInArrow(_repaired(to_arrow_type(conv)), schema).withColumnRenamed("conv_id", conv_id)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structure repair of every damaged conversation."""
    return repair_conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))

"""Token counts of whole texts under a subword model, without token ids.

A merge never joins two characters that no piece holds side by side, so a text falls into pre-tokens
whose piece counts add up to the text's. Each distinct pre-token is counted once for the whole corpus;
a document is a table of pre-token frequencies, joined to those counts and summed.

Pre-tokens in a large share of all frequencies (``common_share``) number at most ``1 / common_share``:
their counts are broadcast and summed where the text is read. All others are joined by a shuffle, so
no key of that join holds more than that share of the rows.

Defined results: a null or empty text has 0 bytes and 0 tokens; repeated rows and null ids each give
their own row; a very long text is read whole, a pre-token may be as long as its text; an empty table
gives an empty table; extra columns are not read, so their names cannot clash. ``docs`` must read alike
each time (a table), as rows are told apart by their place in it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from meterspark.llm.frames import staged
from meterspark.llm.texts import raw

MODEL = "piece_bpe_32k.model"
LIMIT = 4096
#: 1 / 2,000,000: at most two million pre-tokens are broadcast, whatever the corpus.
COMMON_SHARE = 5e-7
SPACE = "▁"
#: Protocol buffers merge a field that comes twice: the normaliser's "add a space in front" becomes false.
_NO_PREFIX = b"\x1a\x02\x18\x00"
_FLUSH = 500_000
_ROWS = 50_000
_WORDS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
_WORDS_LINES = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")


def _processor(model: bytes):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=model)


class Splitter:
    """Cuts normalised texts where the model's pieces allow no merge."""

    def __init__(self, model: bytes) -> None:
        whole, bare = _processor(model), _processor(model + _NO_PREFIX)
        if [whole.normalize(t) for t in ("", "b  A\n", " ")] != ["", f"{SPACE}b{SPACE * 2}A\n", SPACE * 2]:
            raise ValueError("the model must keep its input but for spaces and the one in front")
        if bare.normalize("b") != "b":
            raise ValueError("the model's space in front cannot be turned off")
        pieces = [bare.id_to_piece(i) for i in range(bare.vocab_size())]
        inner = [p.lstrip(SPACE) for p in pieces]
        if any(SPACE in p for p in inner):
            raise ValueError("pieces that go on after a space leave no pre-tokens to count")
        self.pattern = _WORDS if any("\n" in p and p != "\n" for p in pieces) else _WORDS_LINES

    def frequencies(self, text: str) -> Counter[str]:
        """How often each pre-token stands in a text."""
        return Counter(self.pattern.findall(SPACE + text.replace(" ", SPACE))) if text else Counter()


def _texts(column: pa.Array) -> Iterator[tuple[int, str]]:
    """Bytes and text of each row, decoded one at a time."""
    data, offsets = raw(column)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        yield b - a, data[a:b].tobytes().decode()


def pre_token_documents(model: bytes) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(token, docs): in how many texts of a part of the corpus each pre-token stands."""

    def batch(seen: Counter[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["token", "docs"]
        )

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter, seen, held = Splitter(model), Counter(), 0
        for rows in batches:
            for size, text in _texts(rows.column(0)):
                seen.update(splitter.frequencies(text).keys())
                held += size
                if len(seen) > _FLUSH or (held > 1 << 26 and len(seen) > _FLUSH // 4):
                    yield batch(seen)
                    seen, held = Counter(), 0
        yield batch(seen)

    return collect


def count_pieces(model: bytes) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds ``pieces`` to distinct pre-tokens."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bare = _processor(model + _NO_PREFIX)
        for rows in batches:
            pieces = [len(bare.encode(text)) for _, text in _texts(rows.column("token"))]
            yield rows.append_column("pieces", pa.array(pieces, pa.int64()))

    return count


def piece_table(docs: DataFrame, model: bytes, text: str = "text") -> DataFrame:
    """(token, docs, pieces) for every distinct pre-token of all texts; each is counted once."""
    parts = docs.select(F.col(text).alias("text")).mapInArrow(pre_token_documents(model), "token string, docs long")
    distinct = parts.groupBy("token").agg(F.sum("docs").alias("docs"))
    return distinct.mapInArrow(count_pieces(model), "token string, docs long, pieces long")


def token_counts(
    docs: DataFrame,
    model_path: str,
    limit: int = LIMIT,
    doc_id: str = "doc_id",
    text: str = "text",
    common_share: float = COMMON_SHARE,
) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row of ``docs``."""
    with open(model_path, "rb") as file:
        model = file.read()
    table = staged(piece_table(docs, model, text), "pieces")
    total = table.agg(F.sum("docs")).first()[0] or 0
    least = max(1, int(np.ceil(common_share * total)))
    common = {r.token: r.pieces for r in table.where(F.col("docs") >= least).toLocalIterator()}  # at most 1 / share
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter, known = Splitter(model), shared.value
        names = ["row", "doc_id", "n_bytes", "token", "n"]
        for rows in batches:
            out: list[tuple] = []
            for key, own_id, (size, body) in zip(rows.column(0).to_pylist(), rows.column(1), _texts(rows.column(2))):
                summed = 0
                for token, n in splitter.frequencies(body).items():
                    if (pieces := known.get(token)) is not None:
                        summed += n * pieces
                    else:
                        out.append((key, None, None, token, n))
                out.append((key, own_id.as_py(), size, None, summed))
                if len(out) > _ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    id_type = docs.schema[doc_id].dataType
    types = [pa.int64(), to_arrow_type(id_type), pa.int64(), pa.string(), pa.int64()]
    source = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    rows = source.mapInArrow(split, f"row long, doc_id {id_type.simpleString()}, n_bytes long, token string, n long")
    # A document's own row has no token: it joins nothing and is spread by its place instead of a null key.
    own = F.col("token").isNull()
    rows = rows.select("*", F.when(own, F.col("row").cast("string")).otherwise(F.col("token")).alias("key"), own.alias("own"))
    rare = table.where(F.col("docs") < least).select(F.col("token").alias("key"), F.lit(False).alias("own"), "pieces")
    summed = (
        rows.join(rare, ["key", "own"], "left")
        .groupBy("row")
        .agg(
            F.max("doc_id").alias("doc_id"),
            F.max("n_bytes").alias("n_bytes"),
            F.sum(F.when(F.col("own"), F.col("n")).otherwise(F.col("n") * F.col("pieces"))).alias("n_tokens"),
        )
    )
    return summed.select(F.col("doc_id").alias(doc_id), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return token_counts(docs, public_tokenizers.path(MODEL))

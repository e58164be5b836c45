"""Quality rules: repetition coverage of whole texts.

Rolling hashes of several n-gram lengths are computed in numpy over Arrow batches; the measure is the
share of a text's word characters that lie inside n-grams found twice or more, and inside repeated
lines. No row is shuffled: each text is judged by itself.

Defined results: a null or empty text has no words, so every count is 0 and it fails; repeated rows
and ties are judged alike; rows with null in other columns and extra columns pass through untouched,
columns named like a result are replaced by it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType

from meterspark.llm.frames import keep_columns
from meterspark.llm.texts import Chunk, chunks, covered, later, ngrams, per_doc, repeated, with_doc

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


@dataclass(frozen=True)
class RepetitionRules:
    """Largest allowed shares; n-gram shares are of word characters, line shares of text characters."""

    min_words: int = 50
    max_repeat_word_percent: int = 50
    duplicate_ngrams: dict[int, float] = field(default_factory=lambda: {5: 0.15, 7: 0.13, 10: 0.10})
    duplicate_lines: float = 0.30
    duplicate_line_chars: float = 0.20


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _line_measures(chunk: Chunk, prefix: np.ndarray, points: np.ndarray, word_start: np.ndarray):
    """Lines with a word: their number, the later copies among them, and those copies' characters."""
    start, stop, doc = chunk.lines()
    has_word = np.searchsorted(word_start, stop) > np.searchsorted(word_start, start)
    start, stop, doc = start[has_word], stop[has_word], doc[has_word]
    copies = later(with_doc(chunk.span_hash(prefix, start, stop), doc))
    chars = points[stop] - points[start]
    n = chunk.docs
    return per_doc(doc, n), per_doc(doc[copies], n), per_doc(doc[copies], n, chars[copies])


def measures(chunk: Chunk, rules: RepetitionRules) -> dict[str, np.ndarray]:
    """All counts and shares of the texts of a chunk."""
    n = chunk.docs
    points, prefix = chunk.code_points(), chunk.prefix()
    start, stop, doc = chunk.words()
    chars = points[stop] - points[start]
    hashes = chunk.span_hash(prefix, start, stop)
    out = {"n_words": per_doc(doc, n), "word_chars": per_doc(doc, n, chars)}
    out["n_symbols"] = per_doc(chunk.doc_of(np.flatnonzero(_SYMBOL[chunk.data])), n)

    def inside(length: int) -> np.ndarray:
        first, grams = ngrams(hashes, doc, length)
        return covered(first[repeated(with_doc(grams, doc[first]))], length, len(doc))

    out["n_repeat_words"] = per_doc(doc[inside(3)], n)
    lines, out["n_dup_lines"], line_chars = _line_measures(chunk, prefix, points, start)
    text_chars = points[chunk.bounds[1:]] - points[chunk.bounds[:-1]]
    out["dup_line_share"] = out["n_dup_lines"] / np.maximum(lines, 1)
    out["dup_line_char_share"] = line_chars / np.maximum(text_chars, 1)
    for length in rules.duplicate_ngrams:
        hit = inside(length)
        out[f"dup_{length}gram_share"] = per_doc(doc[hit], n, chars[hit]) / np.maximum(out["word_chars"], 1)
    return out


def repetition_rules(docs: DataFrame, rules: RepetitionRules | None = None, text: str = "text") -> DataFrame:
    """All columns of ``docs`` with counts, shares, ``base_failed`` and ``kept``."""
    rules = rules or RepetitionRules()
    shares = ["dup_line_share", "dup_line_char_share", *(f"dup_{n}gram_share" for n in rules.duplicate_ngrams)]
    added = [StructField(c, LongType(), False) for c in COUNTS]
    added += [StructField(c, DoubleType(), False) for c in shares]
    added += [StructField(c, BooleanType(), False) for c in ("base_failed", "kept")]
    source, passed = keep_columns(docs, text, [f.name for f in added])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, stop, chunk in chunks(batch.column("__text")):
                m = measures(chunk, rules)
                failed = (m["n_words"] < rules.min_words) | (
                    100 * m["n_repeat_words"] > rules.max_repeat_word_percent * m["n_words"]
                )
                bad = failed | (m["dup_line_share"] > rules.duplicate_lines)
                bad |= m["dup_line_char_share"] > rules.duplicate_line_chars
                for n, most in rules.duplicate_ngrams.items():
                    bad |= m[f"dup_{n}gram_share"] > most
                rows = batch.slice(first, stop - first)
                columns = [rows.column(c) for c in passed]
                columns += [pa.array(m[c]) for c in (*COUNTS, *shares)] + [pa.array(failed), pa.array(~bad)]
                yield pa.RecordBatch.from_arrays(columns, [*passed, *(f.name for f in added)])

    schema = StructType([*source.select(*passed).schema.fields, *added])
    return source.mapInArrow(judge, schema)


def op9_repetition_rules(spark, sf_dir: str) -> DataFrame:
    """Repetition coverage of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    judged = repetition_rules(docs)
    return judged.select("doc_id", *COUNTS, "base_failed", "kept", *[
        F.col(c) for c in judged.columns if c.endswith("_share")
    ])

"""Toxicity by a weighted lexicon: Aho-Corasick over folded text, normalised by length.

Folding lowers the text, maps homoglyphs and digit or sign substitutions to the letters they stand
for, drops zero-width characters and turns other signs into spaces. The lexicon holds whole words and
word beginnings with weights; it is learned from labelled rows as log-odds with a lower confidence
bound. Hits inside exception phrases do not count. Two measures of the weighted hits, their sum and
their density per 100 words, go into a logistic score.

Fitting uses at most ``max_labelled`` labelled rows, chosen by hash of the id: that many ids fit a
broadcast, and no text is shuffled. Counting terms and scoring run over whole texts in Spark tasks.

Defined results: null and empty texts have no hits and get the score of a text without hits; rows
without label are scored like others; labels that are null, or repeated with different values, are
left out of fitting; without any usable label the lexicon is empty and every score is 0.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from meterspark.llm.frames import apart, staged
from meterspark.llm.texts import slices

# Characters that look like a letter, and digits and signs used in its place.
HOMOGLYPHS = {
    "а": "a", "α": "a", "е": "e", "ε": "e", "о": "o", "ο": "o", "р": "p", "ρ": "p", "с": "c", "у": "y",
    "х": "x", "χ": "x", "і": "i", "ι": "i", "ј": "j", "ѕ": "s", "к": "k", "κ": "k", "м": "m", "т": "t",
    "τ": "t", "в": "b", "н": "h", "ԁ": "d", "ɡ": "g", "ո": "n", "ս": "u", "ν": "v", "ω": "w", "ı": "i",
}
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i"}
# Phrases in which a lexicon word is meant harmlessly.
EXCEPTIONS = ("trash can", "trash bag", "trash bin", "clown fish", "class clown", "idiot proof", "sore loser", "pond scum")


def _folding() -> dict[int, str | None]:
    table: dict[int, str | None] = {i: " " for i in range(128) if not chr(i).isalnum()}
    table |= {ord(k): v for k, v in HOMOGLYPHS.items()} | {ord(k): v for k, v in SUBSTITUTES.items() if k != "!"}
    table |= dict.fromkeys((0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, 0xAD))
    table |= {i: chr(i - 0xFEE0).lower() for i in (*range(0xFF21, 0xFF3B), *range(0xFF41, 0xFF5B))}
    table |= dict.fromkeys((0xA0, 0xBF, 0xA1, 0xAB, 0xBB, *range(0x2000, 0x200B), *range(0x2010, 0x2030)), " ")
    table[0x7C] = " "
    return table


FOLDING = _folding()


def fold(text: str) -> str:
    """Folded text with a space at either end; words are what stands between spaces."""
    return f" {text.lower().translate(FOLDING)} "


_HELD_TERMS = 100_000


@dataclass(frozen=True)
class Settings:
    """What the lexicon may hold; every bound is a model parameter."""

    max_labelled: int = 20_000
    max_terms: int = 1_000
    stem_lengths: tuple[int, ...] = (4, 5, 6)
    min_bound: float = 1.8
    min_toxic: int = 5


@dataclass(frozen=True)
class Model:
    """Terms with weights (`` word `` or `` beginning``), exception phrases, logistic coefficients."""

    terms: dict[str, float]
    exceptions: tuple[str, ...]
    coefficients: tuple[float, float, float]

    def automaton(self):
        import ahocorasick

        machine = ahocorasick.Automaton()
        for phrase in self.exceptions:
            words = " ".join(fold(phrase).split())
            machine.add_word(f" {words} ", (0.0, len(words) + 2, True))
        for term, weight in self.terms.items():
            machine.add_word(term, (weight, len(term), False))
        machine.make_automaton()
        return machine


def hits(machine, text: str) -> tuple[float, int]:
    """Sum of the weights of all hits outside exception phrases; number of words."""
    if not len(machine):
        return 0.0, text.count(" ")
    found, shielded = [], []
    for end, (weight, length, exception) in machine.iter(text):
        if exception:
            shielded.append((end - length + 1, end))
        else:
            found.append((end - length + 1, end, weight))
    if shielded:
        found = [f for f in found if not any(a <= f[0] and f[1] <= b for a, b in shielded)]
    best: dict[int, float] = {}
    for start, _, weight in found:  # a word counts once, with its heaviest term
        best[start] = max(best.get(start, weight), weight)
    return sum(best.values()), text.count(" ")


def measures(weight: float, words: int) -> tuple[float, float]:
    return float(np.log1p(weight)), float(np.log1p(100 * weight / max(words, 1)))


def _word_terms(word: str, lengths: tuple[int, ...]) -> list[str]:
    return [f" {word} ", *(f" {word[:n]}" for n in lengths if len(word) > n)]


def term_counts(labelled: DataFrame, settings: Settings) -> DataFrame:
    """(term, toxic, clean): number of labelled texts of either class with the term."""

    def counted(toxic: Counter, clean: Counter) -> pa.RecordBatch:
        terms = list(toxic | clean)
        columns = [pa.array(terms, pa.string())]
        columns += [pa.array([c[t] for t in terms], pa.int64()) for c in (toxic, clean)]
        return pa.RecordBatch.from_arrays(columns, ["term", "toxic", "clean"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_class = (Counter(), Counter())
        for batch in batches:
            for text, label in zip(batch.column("text"), batch.column("label").to_pylist(), strict=True):
                words = set(fold(text.as_py() or "").split())
                by_class[label].update({t for w in words for t in _word_terms(w, settings.stem_lengths)})
                if len(by_class[0]) + len(by_class[1]) > _HELD_TERMS:
                    yield counted(by_class[1], by_class[0])
                    by_class = (Counter(), Counter())
        yield counted(by_class[1], by_class[0])

    parts = labelled.mapInArrow(count, "term string, toxic long, clean long")
    return parts.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def choose_terms(counts: DataFrame, toxic: int, clean: int, settings: Settings) -> dict[str, float]:
    """The terms with the highest lower bound of their log-odds; of nested ones the more general."""
    a, b = F.col("toxic") + 0.5, F.col("clean") + 0.5
    odds = F.log(a / (toxic + 1.0)) - F.log(b / (clean + 1.0))
    bound = odds - 1.64 * F.sqrt(1 / a + 1 / b)
    found = (
        counts.where(F.col("toxic") >= settings.min_toxic)
        .withColumns({"weight": odds, "bound": bound})
        .where(F.col("bound") >= settings.min_bound)
        .orderBy(F.desc("bound"), F.desc(F.length("term")), "term")
        .limit(8 * settings.max_terms)
        .collect()
    )
    kept: dict[str, float] = {}
    for row in found:
        stems = (row.term[:n] for n in range(2, len(row.term)))
        if len(kept) < settings.max_terms and not any(s in kept for s in stems):
            kept[row.term] = row.weight
    return kept


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 0.05, rounds: int = 60) -> np.ndarray:
    """Newton steps for a penalised logistic regression with intercept."""
    x = np.c_[np.ones(len(x)), x]
    w = np.zeros(x.shape[1])
    ridge = np.diag([1e-6] + [penalty] * (x.shape[1] - 1))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, training: Column, settings: Settings | None = None) -> Model:
    """Model from the labelled rows for which ``training`` (over ``doc_id``) holds."""
    settings = settings or Settings()
    known = labels.where(training & F.col("toxic").isin(0, 1)).groupBy("doc_id")
    known = known.agg(F.min("toxic").alias("label"), F.max("toxic").alias("other")).where("label = other")
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(settings.max_labelled).select("doc_id", "label")
    # At most max_labelled rows of 12 bytes: a proven bound.
    labelled = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", F.col("label").cast("int"))
    # A text labelled both ways teaches nothing.
    by_text = labelled.where("text IS NOT NULL").groupBy("text").agg(F.min("label").alias("label"), F.max("label").alias("other"))
    labelled = staged(by_text.where("label = other").drop("other"), "labelled")
    sizes = {r.label: r.n for r in labelled.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return Model({}, EXCEPTIONS, (-30.0, 0.0, 0.0))
    terms = choose_terms(term_counts(labelled, settings), sizes[1], sizes[0], settings)
    bare = Model(terms, EXCEPTIONS, (0.0, 0.0, 0.0))
    rows = weigh(labelled, bare).collect()  # at most max_labelled rows
    measured = np.array([measures(r.weight, r.words) for r in rows])
    w = fit_logistic(measured, np.array([r.label for r in rows], float))
    return Model(terms, EXCEPTIONS, tuple(float(v) for v in w))


def weigh(labelled: DataFrame, model: Model) -> DataFrame:
    """(label, weight, words) of labelled texts: weighted hits and number of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = model.automaton()
        for batch in batches:
            found = [hits(machine, fold(t.as_py() or "")) for t in batch.column("text")]
            columns = [batch.column("label"), pa.array([f[0] for f in found], pa.float64())]
            columns.append(pa.array([f[1] for f in found], pa.int64()))
            yield pa.RecordBatch.from_arrays(columns, ["label", "weight", "words"])

    return labelled.mapInArrow(run, "label int, weight double, words long")


def score(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """All columns of ``docs`` with ``score`` (0 to 1) and ``predicted``; columns of these two names are replaced."""
    docs = docs.drop("score", "predicted")
    inner, named = apart(docs, "text")
    added = [StructField("score", DoubleType(), False), StructField("predicted", IntegerType(), False)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = model.automaton()
        bias, by_sum, by_density = model.coefficients
        for batch in batches:
            for first, stop in slices(batch.column("text")):
                rows = batch.slice(first, stop - first)
                found = np.array([measures(*hits(machine, fold(t.as_py() or ""))) for t in rows.column("text")]).reshape(-1, 2)
                z = np.clip(bias + found @ np.array([by_sum, by_density]), -500, 500)
                value = 1 / (1 + np.exp(-z)) if model.terms else np.zeros(len(found))
                columns = [*rows.columns, pa.array(value), pa.array((value >= threshold).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, [*rows.schema.names, "score", "predicted"])

    return inner.mapInArrow(run, StructType([*inner.schema.fields, *added])).select(*named, "score", "predicted")


def held_out() -> Column:
    """Rows never learned from: crc32 of the id as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from the rows that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~held_out())
    return score(docs.select("doc_id", "text", held_out().alias("held_out")), model).drop("text")

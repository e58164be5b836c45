"""Corpus pipeline: from raw documents to packed training sequences.

Each stage is a function of (spark, docs, sf_dir) that works on everything the one before kept and
returns a DataFrame; all but the last return the columns of ``documents``. ``run`` writes each stage's
rows to the shared folder and reads them back as the next stage's documents.

Null ids and texts, empty tables, repeated rows and extra columns follow the operators' definitions:
rows pass through unless a stage's decision removes them; extra columns, whatever their names, are kept
until packing. Very long texts are read whole, repeated rows and ties follow the operators.
"""

from __future__ import annotations

from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterspark.llm.decontaminate import decontaminate
from meterspark.llm.frames import apart, staged
from meterspark.llm.jaccard import keep_one
from meterspark.llm.packing import pack
from meterspark.llm.suffixes import remove_repeats
from meterspark.llm.toxicity import fit, held_out, score

TOKENIZER = "byte_bpe_50k.json"


def _apart(stage):
    """A stage that works on id and text while all other columns wait under names no operator has."""

    @wraps(stage)
    def run_apart(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        inner, named = apart(docs, "doc_id", "text")
        return stage(spark, inner, sf_dir).select(*named)

    return run_apart


@_apart
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents not predicted toxic; the lexicon learns from the labelled rows that are not held out."""
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~held_out())
    return score(docs, model).where("predicted = 0")


@_apart
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: five-word shingles, similarity of 0.8 or more."""
    return keep_one(docs, shingle=5, percent=80)


@_apart
def _cut(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = remove_repeats(docs, whole_characters=True)
    text = F.when(F.col("text").isNotNull(), F.col("kept").cast("string"))
    return cut.withColumn("text", text).drop("kept", "removed")


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without strings of 100 bytes that stand earlier; characters stay whole, null stays null."""
    cut = _cut(spark, docs, sf_dir)
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cut.select(docs.columns)


@_apart
def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens, with their token ids."""
    return pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("toxicity", drop_toxic),
    ("jaccard_join", drop_near_duplicates),
    ("suffix_dedup", cut_repeats),
    ("decontamination", drop_leaks),
    ("packing", pack_sequences),
]

#: SQL can express neither the learned lexicon nor packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

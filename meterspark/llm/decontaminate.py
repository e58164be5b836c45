"""Benchmark decontamination by spaced-seed hashing, with DataFrame functions only.

Texts become lower-case words without punctuation. Fixed masks select some of the words of a window
and ignore the others, so a seed survives substitutions at ignored places. The seeds of all positions
of all documents are joined with those of the benchmark; a hit fixes a diagonal (document position
minus item position), on which the words of item and document are compared once more: equal words
score 1, others -1, and the best run of the diagonal is the overlap. An item is leaked when that score
reaches ``min_score`` words, or ``item_share`` of the item where that is less.

The benchmark is the stated query set. Its seeds are broadcast in blocks of at most ``block_rows``
rows (24 bytes each), so a block's size is known; document positions are never shuffled, only hits,
aggregated by diagonal.

Defined results: null and empty texts have no words and are clean; items of fewer words than the
shortest mask are too short to be evidence and match nothing; repeated items match like one another,
repeated documents are all reported; an empty benchmark leaks nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterspark.llm.frames import staged

#: 1: the word at this place is hashed, 0: it is ignored.
MASKS = ("11011000111", "1110101011", "110010111")
_PUNCTUATION = "\t\n\x0b\x0c\r\u00a0.,;:!?\"'`()[]{}<>|/\\*#%&$~^_=+-\u2013\u2014\u2018\u2019\u201c\u201d\u00ab\u00bb\u2026"


def word_hashes(text: Column) -> Column:
    """Hashes of the words of a text, in order; an empty array where there is none."""
    plain = F.trim(F.translate(F.lower(text), _PUNCTUATION, " " * len(_PUNCTUATION)))
    words = F.when(F.length(plain) > 0, F.split(plain, " +")).otherwise(F.array().cast("array<string>"))
    return F.transform(words, lambda w: F.xxhash64(w))


def seeds(texts: DataFrame, keys: list[str], masks=MASKS) -> DataFrame:
    """(keys, place, seed) for every mask at every position; ``hashes`` holds the words' hashes."""
    span = max(map(len, masks))
    size = F.size("hashes")
    shifted = [F.slice("hashes", F.lit(j + 1), F.greatest(size - j, F.lit(0))) for j in range(span)]
    windows = texts.where(size >= min(map(len, masks))).select(
        *keys, F.posexplode(F.arrays_zip(*(c.alias(f"w{j}") for j, c in enumerate(shifted)))).alias("place", "w")
    )
    hashed = [
        F.when(
            F.col("w").getField(f"w{len(mask) - 1}").isNotNull(),
            F.xxhash64(F.lit(number), *(F.col("w").getField(f"w{j}") for j, bit in enumerate(mask) if bit == "1")),
        )
        for number, mask in enumerate(masks)
    ]
    return windows.select(*keys, "place", F.explode(F.array(*hashed)).alias("seed")).where("seed IS NOT NULL")


def _best_run(same: Column) -> Column:
    """Struct (best, stop) of the best-scoring run of a boolean array: 1 for true, -1 for false."""
    start = F.struct(F.lit(0).alias("best"), F.lit(0).alias("now"), F.lit(0).alias("at"), F.lit(0).alias("stop"))

    def step(acc: Column, equal: Column) -> Column:
        now = F.greatest(acc["now"] + F.when(equal, 1).otherwise(-1), F.lit(0))
        at = acc["at"] + 1
        return F.struct(
            F.greatest(acc["best"], now).alias("best"),
            now.alias("now"),
            at.alias("at"),
            F.when(now > acc["best"], at).otherwise(acc["stop"]).alias("stop"),
        )

    return F.aggregate(same, start, step)


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    min_score: int = 13,
    item_share: float = 0.6,
    block_rows: int = 1_000_000,
) -> DataFrame:
    """(doc_id, text_hash, item_id, score, matched, overlap, doc_word, item_words), a row per document and leaked item."""
    items = staged(
        benchmark.select(F.monotonically_increasing_id().alias("item"), "item_id", word_hashes(F.col("text")).alias("item_hashes")),
        "items",
    )
    item_seeds = staged(
        seeds(items.withColumnRenamed("item_hashes", "hashes"), ["item"]).withColumnRenamed("place", "item_place"), "seeds"
    )
    blocks = max(1, -(-item_seeds.count() // block_rows))
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    windows = seeds(texts.select("doc_id", "text_hash", word_hashes(F.col("text")).alias("hashes")), ["doc_id", "text_hash"])

    def found(block: int) -> DataFrame:
        part = item_seeds.where(F.pmod(F.xxhash64("seed"), F.lit(blocks)) == block)
        return windows.join(F.broadcast(part), "seed").select(
            "doc_id", "text_hash", "item", (F.col("place") - F.col("item_place")).alias("diagonal")
        )

    hits = reduce(DataFrame.unionByName, (found(b) for b in range(blocks)))
    hits = staged(hits.groupBy("doc_id", "text_hash", "item", "diagonal").agg(F.count("*").alias("hits")), "hits")
    hit = hits.withColumnRenamed("doc_id", "hit_id").join(items, "item")
    pairs = texts.withColumnRenamed("text_hash", "own_hash").join(
        hit, (F.col("own_hash") == F.col("text_hash")) & F.col("doc_id").eqNullSafe(F.col("hit_id"))
    )
    return _verified(pairs, min_score, item_share)


def _verified(pairs: DataFrame, min_score: int, item_share: float) -> DataFrame:
    in_doc = F.greatest(F.col("diagonal"), F.lit(0))
    in_item = F.greatest(-F.col("diagonal"), F.lit(0))
    words = F.size("item_hashes")
    pairs = pairs.withColumn("hashes", word_hashes(F.col("text")))
    same = F.zip_with(
        F.slice("hashes", in_doc + 1, words - in_item),
        F.slice("item_hashes", in_item + 1, words - in_item),
        lambda a, b: F.coalesce(a == b, F.lit(False)),
    )
    scored = pairs.select(
        "doc_id", "text_hash", "item_id", "diagonal", words.alias("item_words"), same.alias("same")
    ).withColumn("run", _best_run(F.col("same")))
    scored = scored.withColumns({"score": F.col("run.best"), "doc_word": in_doc})
    needed = F.least(F.lit(float(min_score)), F.col("item_words") * item_share)
    best = F.max(F.struct("score", "doc_word", F.size(F.filter("same", lambda x: x)).alias("matched"), F.size("same").alias("overlap")))
    return (
        scored.where(F.col("score") >= needed)
        .groupBy("doc_id", "text_hash", "item_id", "item_words")
        .agg(best.alias("best"))
        .select("doc_id", "text_hash", "item_id", "best.*", "item_words")
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs`` that leak no benchmark item, with their columns."""
    found = leaks(docs, benchmark, **settings)
    bad = staged(found.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct(), "leaking")
    return docs.join(
        bad, (F.xxhash64("text") == F.col("__hash")) & F.col("doc_id").eqNullSafe(F.col("__id")), "left_anti"
    )


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document and benchmark item it leaks; documents not listed are clean."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "item_id", "score", "matched", "overlap", "doc_word", "item_words")

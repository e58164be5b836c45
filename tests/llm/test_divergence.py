"""Source divergence against SQL over all terms and pairs."""

from __future__ import annotations

import random

import duckdb
import pytest

from meterspark.llm import divergence


def by_sql(frame):
    documents = frame.select("text", "lang", "source").toPandas()  # noqa: F841 - read by name
    return sorted(duckdb.sql(divergence.OP12_SQL).fetchall(), key=str)


def made(spark):
    rng = random.Random(1)
    texts = [None, "", "W " * 30_000] + [" ".join(rng.choices(["a", "B", "cé", "d1", "zz", "Q", "ß"], k=rng.randint(0, 6))) for _ in range(8)]
    rows = [(rng.choice(texts), rng.choice(["x", "y", None, "z"]), rng.choice(["s1", "s2", None, "", "ü"])) for _ in range(60)]
    rows += rows[:3] + [("only", "one", "q"), (None, "one", "r")]
    return spark.createDataFrame(rows, "text string, lang string, source string")


@pytest.mark.parametrize(("block", "parts"), [(1024, 1), (2, 5), (1, 3)])
def test_equals_sql_over_all_terms(spark, block, parts):
    frame = made(spark).repartition(parts)
    clashing = frame.selectExpr("*", "1 AS term", "2 AS place", "3 AS value", "4 AS n", "5 AS cells")
    got = divergence.source_divergence(clashing, block=block)
    assert sorted(map(tuple, got.collect()), key=str) == by_sql(frame)


def test_fewer_documents_keep_a_term(spark):
    frame = spark.createDataFrame([("a b a", "x", "p"), ("a", "x", "q")], "text string, lang string, source string")
    rows = divergence.source_divergence(frame, min_docs=2).collect()
    assert {r.item for r in rows if r.part == "term"} <= {"a"}
    assert len([r for r in rows if r.part == "pair"]) == 2


def test_no_rows(spark):
    assert divergence.source_divergence(made(spark).where("false")).collect() == []


def test_shares_are_exact_for_very_large_counts(spark):
    count, total = 10**15 + 1, 10**15 + 7
    frame = spark.createDataFrame([(count, total)], "count long, total long")
    assert frame.select(divergence._share(frame["count"], frame["total"])).first()[0] == 1 + 10**9 * (count + 1) // total

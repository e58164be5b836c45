"""Token counts against the library itself, on whole texts."""

from __future__ import annotations

import public_tokenizers
import pytest
import sentencepiece

from meterspark.llm import tokens

PATH = public_tokenizers.path(tokens.MODEL)
ROWS = [
    (1, ""), (2, None), (3, " "), (None, "a  b\n\nc ▁▁ d"), (3, " "), (4, "<s> </s>\t x\x00y <unk>"), (5, "word " * 30_000),
    (6, "x" * 5000 + " 🙂🙂①"), (7, "\n"), (8, "a\r\n b\n"), (9, " \n \n "), (10, "▁"), (None, "a  b\n\nc ▁▁ d"), (11, "ﬁ é　\xa0 ß"),
]


def whole(rows, limit):
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    return sorted(((i, len((t or "").encode()), n := len(library.encode(t or "")), n > limit) for i, t in rows), key=str)


@pytest.mark.parametrize("share", [2e-6, 0.2, 1.0])
def test_equals_the_library(spark, share):
    frame = spark.createDataFrame(ROWS, "doc_id long, text string").selectExpr("*", "'x' AS token", "1 AS row", "2 AS n_tokens")
    got = tokens.token_counts(frame, PATH, 100, common_share=share)
    assert sorted(map(tuple, got.collect()), key=str) == whole(ROWS, 100)


def test_no_rows(spark):
    assert tokens.token_counts(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []


def test_registered_query(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, tokens.op11_token_counts(spark, folder).collect()), key=str) == whole(rows, 4096)


def test_each_pre_token_is_counted_once(spark):
    frame = spark.createDataFrame(ROWS, "doc_id long, text string")
    with open(PATH, "rb") as file:
        table = tokens.piece_table(frame, file.read()).collect()
    assert len({r.token for r in table}) == len(table)
    assert {r.token: r.docs for r in table}["▁▁b"] == 2


def test_another_kind_of_model_is_refused(monkeypatch):
    class Folding:
        def normalize(self, text):
            return text.lower()

    monkeypatch.setattr(tokens, "_processor", lambda model: Folding())
    with pytest.raises(ValueError, match="keep its input"):
        tokens.Splitter(b"")

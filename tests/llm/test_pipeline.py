"""The whole pipeline against brute force on planted documents, and on an empty table."""

import collections
import random
import re

import public_tokenizers
import pytest

import corpus_pipeline

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def planted():
    """Documents, labels and benchmark items; what each document is for is its source."""
    r = random.Random(23)
    vocabulary = ["".join(r.choice("abdeiklmnorstu") for _ in range(r.randint(3, 8))) for _ in range(3000)]
    make = lambda n: [r.choice(vocabulary) for _ in range(n)]
    texts, labels = [], []
    for i in range(270):
        toxic = i % 3 == 0
        body = make(r.randint(30, 60))
        if toxic:
            body[10:10] = ["you", "m0ron", "and", "worthless", "idiot"]
        texts.append(("toxic" if toxic else "clean", " ".join(body)))
        labels.append((i, int(toxic)))
    items = [" ".join(make(n)) for n in (25, 40, 30)]
    texts += [("leak", " ".join([*make(20), item, *make(20)])) for item in items[:2]]
    base = make(150)
    for k in range(5):
        near = list(base)
        near[20 * k + 3] = f"odd{k}"
        texts.append(("near", " ".join(near)))
    texts += [("near", " ".join(base))] * 2
    passage = make(45)
    texts += [("shared", " ".join([*make(30), *passage, *make(30 + k)])) for k in range(4)]
    texts += [("odd", t) for t in (None, "", " \n ", "One", "x" * 9000)]
    rows = [(i, t, "en", kind, len(t or "")) for i, (kind, t) in enumerate(texts)]
    return rows, labels, items


def run(spark, folder, planted):
    rows, labels, items = planted
    tables = {
        "documents": spark.createDataFrame(rows, DOCS),
        "labels": spark.createDataFrame(labels, "doc_id long, toxic int"),
        "benchmark": spark.createDataFrame(list(enumerate(items)), "item_id long, text string"),
    }
    for name, frame in tables.items():
        frame.write.parquet(f"{folder}/{name}.parquet")
    return corpus_pipeline.run(spark, str(folder))


def without_near_copies(rows):
    """The first document of each component of links; 5-word shingles, 0.8."""
    sets, parent = [], list(range(len(rows)))
    for row in rows:
        w = WORD.findall((row[1] or "").lower())
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, left in enumerate(sets):
        for b in range(a):
            if left and sets[b] and 5 * len(left & sets[b]) >= 4 * len(left | sets[b]):
                p, q = root(a), root(b)
                parent[max(p, q)] = min(p, q)
    return [row for i, row in enumerate(rows) if root(i) == i]


def without_repeats(rows):
    """ASCII texts without the strings of 100 bytes that stand earlier; null stays null."""
    seen, out = set(), []
    for i, text, *rest in rows:
        body, gone = text or "", set()
        for at in range(len(body) - 99):
            window = body[at : at + 100]
            if window in seen:
                gone.update(range(at, at + 100))
            seen.add(window)
        kept = "".join(c for at, c in enumerate(body) if at not in gone)
        out.append((i, text if text is None else kept, *rest))
    return out


def test_planted_documents_come_out_as_by_brute_force(spark, planted, tmp_path):
    from tokenizers import Tokenizer

    rows = [row for row in planted[0] if row[3] != "toxic"]
    rows = without_repeats(without_near_copies(rows))
    expected = {row[0]: row[1] for row in rows if row[3] != "leak"}
    kinds = collections.Counter(row[3] for row in rows)
    assert (kinds["clean"], kinds["near"], kinds["shared"], kinds["odd"]) == (180, 1, 4, 5)

    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for p in run(spark, tmp_path / "tables", planted).collect():
        pieces[p.doc_id].append(p)
        sequences[p.sequence_id].append((p.offset, p.length))
    assert set(pieces) == set(expected)
    tokenizer = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.TOKENIZER))
    for doc, text in expected.items():
        own = sorted(pieces[doc], key=lambda p: p.start)
        ids = [int.from_bytes(p.ids[i : i + 4], "little") for p in own for i in range(0, len(p.ids), 4)]
        assert ids == [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        assert {p.doc_tokens for p in own} == {len(ids)}
    for places in sequences.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 2048


def test_no_documents(spark, planted, tmp_path):
    assert run(spark, tmp_path / "tables", ([], *planted[1:])).collect() == []


def test_stages_keep_the_columns(spark, planted, tmp_path):
    """All stages but the last return the columns they got, extra ones with the operators' names too."""
    folder = tmp_path / "tables"
    run(spark, folder, planted)
    docs = spark.read.parquet(f"{folder}/documents.parquet").selectExpr("*", "source AS kept", "lang AS score", "n_chars AS parts")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(folder)).columns == docs.columns

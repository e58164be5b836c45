"""Keys of the near-duplicate join where many texts hold the same passages."""

import collections
import random

import numpy as np
import pyarrow as pa
import pytest

from meterspark.llm import jaccard


def _maker(seed):
    r = random.Random(seed)
    return r, lambda n: ["".join(r.choices("abcdefghij", k=7)) for _ in range(n)]


def test_texts_with_one_passage_share_no_tile(spark):
    """Before, each of the passage's own segments was a tile of all texts."""
    _, make = _maker(1)
    passage = make(50)
    texts = [" ".join([*make(80), *passage, *make(80)]) for _ in range(150)]
    copies = [" ".join([*text.split()[:-3], *make(3)]) for text in texts[:5]]
    rows = jaccard.shared_keys(spark.createDataFrame([(t,) for t in texts + copies], "text string"), 5, 80).collect()
    tiles = collections.Counter(r.key for r in rows)
    assert max(tiles.values()) == 2 and len({r.v for r in rows}) < 20


@pytest.mark.parametrize(("size", "percent"), [(4, 85), (5, 80), (2, 60)])
def test_links_among_texts_made_of_common_passages(spark, size, percent):
    """No link goes with the keys left out, whatever share of a text is common and however small it is."""
    r, make = _maker(size)
    passages = [make(r.randint(5, 60)) for _ in range(6)]
    texts = []
    for _ in range(70):
        body = [w for p in r.sample(passages, r.randint(0, 4)) for w in p] + make(r.choice([0, 1, 6, 40, 120]))
        texts.append(body)
        for _ in range(r.randint(0, 3)):
            near = list(body)
            for _ in range(round(len(near) * r.uniform(0, 0.5 * (100 - percent) / 100 / size)) + r.randint(0, 1)):
                near[r.randrange(len(near)) if near else 0 : 1] = make(1)
            texts.append(near)
    sets = [{tuple(t[i : i + size]) for i in range(len(t) - size + 1)} or ({tuple(t)} if t else set()) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for b, y in enumerate(sets):
        for a, x in enumerate(sets[:b]):
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    frame = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    found = {x.doc_id: x.component_id for x in jaccard.jaccard_components(frame, size, percent).collect()}
    assert found == {i: find(i) for i in range(len(texts))}


@pytest.mark.parametrize("step", [1, 3, 1000])
def test_sets_of_a_key_are_counted_over_batches(monkeypatch, step):
    """Repeated rows count once, also where a key's rows are let go in parts."""
    monkeypatch.setattr(jaccard, "MANY", 8)
    r = random.Random(step)
    sizes = {k: r.choice([1, 1, 2, 3, 7, 8, 9, 40]) for k in range(-40, 40)}
    rows = sorted((k, v, k % 5) for k, n in sizes.items() for v in range(n) for _ in range(r.choice([1, 1, 2, 9])))
    table = pa.table({c: np.array([x[i] for x in rows], np.int64) for i, c in enumerate(("key", "v", "spared"))})
    got = [tuple(x.values()) for b in jaccard._counted(iter(table.to_batches(max_chunksize=step))) for x in b.to_pylist()]
    assert got == [(k, v, k % 5, min(n, 8)) for k, n in sizes.items() if n > 1 for v in range(n)]

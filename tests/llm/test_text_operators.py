"""Every text operator against a brute-force version, and on empty, null, repeated and odd rows."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from meterspark.llm import decontaminate, html, jaccard, lm, packing, rules, suffixes, toxicity, urls, warc
from meterspark.llm.components import connected_components, extend_components
from meterspark.llm.frames import fresh_path

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def words(text):
    return WORD.findall((text or "").encode().translate(LOWER))


@pytest.fixture(scope="module")
def texts():
    """(doc_id, text): invented texts with copies, near copies, shared passages and odd rows."""
    r = random.Random(5)
    vocabulary = ["".join(r.choice("abcdeéñ") for _ in range(r.randint(2, 7))) for _ in range(400)]
    make = lambda n: [r.choice(vocabulary) for _ in range(n)]
    passage, base = make(40), make(120)
    rows = []
    for i in range(60):
        body = make(r.randint(5, 150))
        if i % 4 == 0:
            body = list(base)
            for _ in range(r.randint(0, 9)):
                body[r.randrange(len(body))] = r.choice(vocabulary)
        if i % 5 == 0:
            body = body[:30] + passage + body[30:]
        rows.append((i, (" " if i % 3 else "\n").join(body)))
    rows += [(60, None), (61, ""), (62, " \n "), (63, "One"), (64, "one"), (65, "a b"), (66, rows[3][1]), (67, "x" * 3000)]
    rows += [(68, "# " * 60), (69, (" ".join(make(60)) + "\n") * 3)]
    return rows


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, f"s{i}") for i, t in texts], "doc_id long, text string, label string")


@pytest.fixture(params=[3, 10000], ids=["small_batches", "one_batch"])
def batches(spark, request):
    """Arrow batches of a few rows put group edges everywhere."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", request.param)
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def brute_components(texts, size, percent):
    sets = {}
    for d, t in texts:
        w = words(t)
        sets[d] = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} or ({tuple(w)} if w else set())
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            common = len(sets[a] & sets[b])
            if a < b and sets[a] and sets[b] and 100 * common >= percent * len(sets[a] | sets[b]):
                p, q = root(a), root(b)
                parent[max(p, q)] = min(p, q)
    return {d: (len(sets[d]), root(d)) for d in sets}


@pytest.mark.parametrize(("size", "percent"), [(4, 85), (5, 80), (3, 50)])
def test_jaccard_components(docs, texts, batches, size, percent):
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs, size, percent).collect()}
    assert found == brute_components(texts, size, percent)


def test_components_extend(spark):
    r = random.Random(11)
    edge = lambda k: [(r.randrange(300), r.randrange(300)) for _ in range(k)]
    first, second = edge(70), edge(120)
    frame = lambda pairs: spark.createDataFrame(pairs, "a long, b long")
    labels = connected_components(frame(first))
    every = {tuple(x) for x in connected_components(frame(first + second)).collect()}
    alone = {(a, a) for a, b in second if a == b}
    assert {tuple(x) for x in extend_components(labels, frame(second)).collect()} | alone == every | alone
    assert {tuple(x) for x in extend_components(labels, frame(second).limit(0)).collect()} == {tuple(x) for x in labels.collect()}


def test_jaccard_edges(spark, docs):
    assert jaccard.jaccard_components(docs.limit(0)).count() == 0
    twice = spark.createDataFrame([(1, "a b c d e"), (1, "a b c d e"), (None, "a b c d e"), (None, None)], "doc_id long, text string")
    assert [r.component_id for r in jaccard.jaccard_components(twice).where("n_shingles > 0").collect()] == [1, 1, 1]
    assert sorted(r.doc_id for r in jaccard.keep_one(docs).select("doc_id").collect())[:2] == [0, 1]


def test_null_and_repeated_ids_in_components(spark):
    base = [f"w{i}" for i in range(60)]
    a, b, c = (" ".join([*base[:60 - k], *(f"x{j}" for j in range(k))]) for k in (0, 8, 16))
    shuffled = " ".join(f"y{i}" for i in range(40))
    rows = [(1, a), (None, b), (2, c), (3, shuffled), (3, shuffled), (3, a), (None, "only null ids here at all"),
            (None, None), (None, None), (None, " "), (4, "")]
    frame = spark.createDataFrame([(*r, f"l{i}") for i, r in enumerate(rows)], "doc_id long, text string, label string")
    found = jaccard.jaccard_components(frame, 3, 70)
    # a and c are no link of their own: only the set of a row without an id joins them.
    assert {r.component_id for r in found.where("doc_id in (1, 2)").collect()} == {1}
    kept = jaccard.keep_one(frame, 3, 70)
    assert kept.columns == frame.columns
    expected = [rows[0], rows[3], rows[6], *rows[7:]]
    assert collections.Counter((r.doc_id, r.text) for r in kept.collect()) == collections.Counter(expected)


def brute_removed(texts, length):
    seen, out = set(), {}
    for d, t in texts:
        body = (t or "").encode()
        gone = bytearray(len(body))
        for i in range(len(body) - length + 1):
            if body[i : i + length] in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(body[i : i + length])
        kept = bytes(b for b, g in zip(body, gone, strict=True) if not g)
        out[d] = (sum(gone), len(re.findall(b"\1+", bytes(gone))), kept)
    return out


def test_repeated_strings(docs, texts, batches):
    found = {r.doc_id: (sum(s.stop - s.start for s in r.removed), len(r.removed), bytes(r.kept)) for r in suffixes.remove_repeats(docs).collect()}
    assert found == brute_removed(texts, 100)


def test_large_groups_are_split(docs, texts, batches):
    found = suffixes.remove_repeats(docs, most=2)
    assert {r.doc_id: bytes(r.kept) for r in found.collect()} == {d: kept for d, (_, _, kept) in brute_removed(texts, 100).items()}
    rows = [(7, 0, 68, i, 0, 68, bytes([65 + i % 2]) + b"y" * 167) for i in range(50)] + [(8, 5, 5, i, 0, 5, b"z" * 105) for i in range(30)]
    frame = docs.sparkSession.createDataFrame(rows, "gram long, lo int, hi int, id long, code long, left int, bytes binary")
    solved = suffixes._solve_groups(frame, 100, 10).collect()
    assert sorted(r.id for r in solved if r.right is None) == list(range(50))
    assert sorted((r.gram, r.id, r.left, r.right) for r in solved if r.right) == [(8, i, 5, 95) for i in range(1, 30)]


def test_repeats_keep_characters_and_odd_rows(spark, docs):
    cut = suffixes.remove_repeats(docs, whole_characters=True).select("label", F.col("kept").cast("string").alias("t"))
    assert all("�" not in r.t for r in cut.collect())
    assert suffixes.remove_repeats(docs.limit(0)).count() == 0
    same = spark.createDataFrame([(None, "q" * 50 + "z" * 80), (4, "q" * 50 + "z" * 80)], "doc_id long, text string")
    assert {r.doc_id: len(r.kept) for r in suffixes.remove_repeats(same).collect()} == {None: 130, 4: 0}


def test_rows_equal_in_id_and_text_are_one_document(spark, texts, batches):
    once = [*texts, (None, texts[0][1] + " tail")]
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    kept = lambda rows: collections.Counter((r.doc_id, r.text, bytes(r.kept)) for r in suffixes.remove_repeats(frame(rows)).collect())
    assert kept(once + once) == {row: 2 * n for row, n in kept(once).items()}
    assert kept([(None, "q" * 50 + "z" * 80)] * 2) == {(None, "q" * 50 + "z" * 80, b"q" * 50 + b"z" * 80): 2}


def test_suffix_order(spark):
    import numpy as np

    from meterspark.llm.texts import Chunk

    r = random.Random(1)
    data = bytes(r.choice(b"ab") for _ in range(400))
    start = np.array([r.randrange(300) for _ in range(90)])
    chunk = Chunk(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    group = np.repeat([1, 2, 3], [1, 60, 29])
    order = suffixes.Suffixes(chunk, start, np.full(90, 100)).sort(group)
    cut = [(int(group[i]), data[start[i] : start[i] + 100]) for i in order]
    assert cut == sorted(cut)


def test_toxicity_folds_and_learns(spark):
    assert toxicity.fold("M0rоn!") == " moron  "
    rows = [(i, f"clean words {i} here today" + (" you m0ron idiot" if i % 3 == 0 else "")) for i in range(300)]
    docs = spark.createDataFrame([*rows, (900, None), (901, "a trash can")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)] + [(900, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, ~toxicity.held_out())
    got = {r.doc_id: r.predicted for r in toxicity.score(docs, model).collect()}
    assert all(got[i] == int(i % 3 == 0) for i in range(300))
    assert got[900] == got[901] == 0
    empty = toxicity.fit(docs, labels.limit(0), ~toxicity.held_out())
    assert {r.score for r in toxicity.score(docs, empty).collect()} == {0.0}


def test_leaks(spark):
    r = random.Random(3)
    make = lambda n: [f"w{r.randrange(5000)}" for _ in range(n)]
    items = [make(n) for n in (14, 40, 60)]
    changed = [w if i % 9 else "other" for i, w in enumerate(items[1])]
    rows = [(0, " ".join(make(80))), (1, " ".join(make(20) + items[0] + make(9))), (2, "\n".join(make(5) + changed).upper()),
            (3, " ".join(items[2][25:] + make(30))), (4, None), (5, ""), (5, " ".join(items[0])), (6, " ".join(items[1][:6]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([*enumerate(" ".join(i) for i in items), (9, None), (10, "too short")], "item_id long, text string")
    found = {(x.doc_id, x.item_id) for x in decontaminate.leaks(docs, bench).collect()}
    assert found == {(1, 0), (2, 1), (3, 2), (5, 0)}
    assert {(x.doc_id, x.item_id) for x in decontaminate.leaks(docs, bench, block_rows=40).collect()} == found
    assert sorted(x.doc_id for x in decontaminate.decontaminate(docs, bench).collect()) == [0, 4, 5, 6]
    assert decontaminate.leaks(docs, bench.limit(0)).count() == 0


def test_main_text(spark):
    page = """<body><header>H</header><div class="cookie-notice">C</div><main><article><h1>T &amp; x</h1><p>a<b>b</b>c<p>d
     <i>e</i><br>f<ul><li>1<li>2</ul><div class="comments"><p>no</p></div></article></main><form><p>q</p></form>tail</body>"""
    assert html.main_text(page, frozenset()) == "T & x\n\nabc\n\nd e f\n\n1\n\n2"
    assert html.main_text("<p>a < b <p x='>'>t</p></div><!-- x", frozenset()) == "a < b\n\nt"
    rows = [(i, f"http://h.org/{i}", f"<div><p>Site line</p></div><div><p>own {i}</p></div>") for i in range(8)]
    rows += [(8, None, None), (9, "http://x.org", "")]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"own {i}" for i in range(8)} | {8: "", 9: ""}


def test_article_text_stays(spark):
    rows = [(i, f"http://h.org/{i}", "<article><div><p>same</p></div></article>") for i in range(6)]
    rows += [(10 + i, f"http://c.org/{i}", "<div><p>copy</p></div>") for i in range(6)]
    rows += [(20 + i, f"http://s.org/{i}", f"<article><section><p>Prose</p></section><p>{i}</p></article>") for i in range(6)]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: "same" for i in range(6)} | {10 + i: "copy" for i in range(6)} | {20 + i: f"Prose\n\n{i}" for i in range(6)}
    for name in ("layout has-sidebar", "no-sidebar"):
        assert html.main_text(f"<div class='{name}'><article><p>t</p></article><p>x</p></div>", frozenset()) == "t"
    page = "<main><p>t</p><div class='comments'><article><p>c</p></article></div></main><div class='ads'><p>a</p></div>"
    assert html.main_text(page, frozenset()) == "t"
    assert html.main_text("<p>t</p><div class='comments'><article class='comment'><p>c</p></article></div>", frozenset()) == "t"


def test_inline_adverts_go_and_unlucky_names_stay():
    text = lambda page: html.main_text(page, frozenset())
    assert text("<article><p>a <span class='ad'>BUY <b>N</b> <span>OW</span></span>b</p></article>") == "a b"
    assert text("<article><p>a <a class='advert' href='x'>BUY</a></p><p>c<span class=ad>open</p><p>d</p></article>") == "a\n\nc\n\nd"
    assert text("<p>a<span class='read'> b</span><img class='ad'> c <i hidden>x</i></p>") == "a b c"
    assert text("<p>a <span class='ad'>rest") == "a"
    assert text("<article><div class='related-work'><p>Prose</p><nav>n</nav></div></article>") == "Prose"
    assert text("<article><section id='search'><p>Prose</p></section></article><p>x</p>") == "Prose"
    assert text("<article><p>t</p><div class='related'><p>r</p></div></article>") == "t"


def test_packing_round_trip(docs, texts):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    odd = [(100, "a  b  c　 d  e \n\n f's 12 é à x"), (101, None)]
    more = docs.select("doc_id", "text").unionByName(docs.sparkSession.createDataFrame(odd, "doc_id long, text string"))
    pieces = packing.pack(more, path, capacity=256).collect()
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    for d, t in [*texts, *odd]:
        own = sorted(by_doc[d], key=lambda p: p.start)
        ids = [int.from_bytes(p.ids[i : i + 4], "little") for p in own for i in range(0, len(p.ids), 4)]
        assert ids == [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        assert [p.start for p in own] == [sum(q.length for q in own[:i]) for i in range(len(own))]
    for own in by_sequence.values():
        own.sort(key=lambda p: p.offset)
        assert [p.offset for p in own] == [sum(q.length for q in own[:i]) for i in range(len(own))]
        fill = sum(p.length for p in own)
        assert fill <= 256 and (256 - fill <= 4 or fill & (fill - 1) == 0)


def test_fill_closest():
    r = random.Random(2)
    for _ in range(50):
        counts = collections.Counter(r.randint(1, 40) for _ in range(r.randint(1, 9)))
        capacity = r.randint(1, 120)
        sums = {0}
        for x in counts.elements():
            sums |= {s + x for s in sums}
        chosen = packing.fill_closest(dict(counts), capacity)
        assert all(n <= counts[x] for x, n in chosen.items())
        assert sum(x * n for x, n in chosen.items()) == max(s for s in sums if s <= capacity)


def test_repeats_of_texts_without_an_id_or_with_one_id(spark):
    """Texts of one id are told apart by their own hashes, whatever short tags they share."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefghij", k=8))
    passage = " ".join(word() for _ in range(30))
    rows = [(None, f"{passage} {i} " + " ".join(word() for _ in range(40))) for i in range(30)]
    rows += [(7, f"{i} " + " ".join(word() for _ in range(40))) for i in range(300)] + [(7, passage), (7, passage)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS parts", "2 AS wholes", "'k' AS kept")
    got = suffixes.remove_repeats(frame).collect()
    assert sum(len(r.text) - len(r.kept) for r in got if r.doc_id == 7) == 2 * len(passage)
    lost = sorted(len(r.text) - len(r.kept) for r in got if r.doc_id is None)
    assert lost[0] == 0 and all(n >= len(passage) for n in lost[1:]) and {r.parts for r in got} == {1}


def test_a_tile_of_near_copies_emits_fewer_links_than_sets(spark):
    rng = random.Random(2)
    base = [f"w{i}" for i in range(200)]
    texts = [" ".join(w if rng.random() > 0.012 else f"x{rng.random()}" for w in base) for _ in range(60)]
    sets = [set(zip(*(t.split()[k:] for k in range(4)))) for t in texts]
    linked = lambda a, b: 100 * len(a & b) >= 85 * len(a | b)
    rows = [(1, 0, 0, 0, 0, v, v, t) for v, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "low long, band int, i int, j int, side int, v long, label long, text string")
    links = {tuple(r) for r in jaccard.tile_links(frame, 4, 85).collect()}
    assert all(linked(sets[a], sets[b]) for a, b in links) and 0 < len(links) < len(texts)
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        assert find(a) != find(b)
        parent[find(a)] = find(b)
    assert all(find(a) == find(b) for a in range(60) for b in range(a) if linked(sets[a], sets[b]))


def test_url_rules_and_propagation(spark):
    link = '<a href="http://bad.com/x">'
    rows = [(1, "http://A.Org/x?y", None), (2, "https://bad.com/de/1", ""), (3, "http://links.net/p#q", link), (4, None, None),
            (5, "no host", None), (6, "http://b.example.org/en/12", None), (7, "http://x.org", None), (8, "http://clean.net", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.url_filter(pages).collect()}
    assert got == {
        1: ("a.org", "/x", "org/", "allow"), 2: ("bad.com", "/de/1", "com/de/", "block"), 3: ("links.net", "/p", None, "block"),
        4: ("", "", None, "allow"), 5: ("", "", None, "allow"), 6: ("b.example.org", "/en/12", "example.org/en/1", "block"),
        7: ("x.org", "", None, "allow"), 8: ("clean.net", "", None, "allow"),
    }


def test_distrust_reaches_far_and_in_any_graph(spark):
    link = lambda host: f'<a href="http://{host}/x">'
    rows = [(0, "http://bad.com/de/1", ""), (1, "http://small.net/", link("bad.com"))]
    rows += [(2 + i, f"http://big.net/{i}", link("bad.com")) for i in range(2000)]
    rows += [(5000 + i, f"http://chain{i}.net/", link(f"chain{i - 1}.net" if i else "bad.com")) for i in range(16)]
    rows += [(9000, "http://clean.net/", link("other.net"))]
    judged = urls.url_filter(spark.createDataFrame(rows, "page_id long, url string, html string"))
    got = {r.page_id: r.verdict for r in judged.where("page_id < 2 or page_id >= 5000").collect()}
    assert got == {p: "block" for p in got if p != 9000} | {9000: "allow"}


def test_one_stray_link_does_not_clear_a_host(spark):
    links = "".join(f'<a href="http://h{i}.net/">' for i in range(1000)) + '<a href="http://spam.net/">'
    rows = [(1, "http://good.org/", links), (2, "http://spam.net/", '<a href="http://bad.com/">'), (3, "http://bad.com/de/", "")]
    judged = urls.url_filter(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.verdict for r in judged} == {1: "allow", 2: "block", 3: "block"}
    assert next(r.trust for r in judged if r.page_id == 2) < 0.001


def test_masses_equal_a_dense_pagerank(spark):
    rng = np.random.default_rng(8)
    n = 25
    weights = rng.integers(1, 4, (n, n)) * (rng.random((n, n)) < 0.12)
    weights[3] = weights[:, 5] = 0  # a host without links, and one nothing links to
    np.fill_diagonal(weights, 0)
    edges = [(f"h{a}", f"h{b}", int(weights[a, b])) for a, b in np.argwhere(weights)]
    seeds = [("trust", "h3", 1.0), ("trust", "h1", 0.25), ("distrust", "h2", 0.5), ("distrust", "h5", 1.0)]
    found = urls.propagate(
        spark.createDataFrame(edges, "source string, target string, links long"),
        spark.createDataFrame(seeds, "kind string, host string, mass double"),
        tolerance=1e-8,
    )
    got = {r.host: (r.trust, r.distrust) for r in found.collect()}
    for place, (kind, matrix) in enumerate((("trust", weights), ("distrust", weights.T))):
        start = np.zeros(n)
        for k, host, mass in seeds:
            start[int(host[1:])] += mass * (k == kind)
        start /= start.sum()
        out = matrix.sum(axis=1)
        rank = start.copy()
        for _ in range(300):
            sent = (rank / np.maximum(out, 1)) @ matrix
            rank = 0.15 * start + 0.85 * (sent + rank[out == 0].sum() * start)
        assert np.allclose([got.get(f"h{i}", (0, 0))[place] for i in range(n)], rank, atol=1e-6)


def test_language_model(docs, texts):
    train = [words(t) + [None] for d, t in texts if zlib.crc32(str(d).encode()) % 7 != 2]
    count = collections.Counter(w for t in train for w in t)
    n, v = sum(count.values()), len(count)
    model = lm.train(docs.where(~lm.held_out()), order=3)
    rows = {r.doc_id: r for r in lm.score(docs, model).collect()}
    for d, t in texts:
        own = words(t) + [None]
        assert (rows[d].n_tokens, rows[d].n_known) == (len(own), sum(count[w] > 0 for w in own))
        assert rows[d].train_tokens == n
        assert math.isclose(rows[d].base_score, sum(math.log10((count[w] + 1) / (n + v + 1)) for w in own), rel_tol=1e-9)
    held = [d for d, _ in texts if zlib.crc32(str(d).encode()) % 7 == 2 and rows[d].n_tokens > 20]
    assert sum(rows[d].score for d in held) > sum(rows[d].base_score for d in held)
    assert lm.score(docs.limit(0), model).count() == 0


def test_repetition_rules(docs, texts):
    for r in rules.repetition_rules(docs).collect():
        t = dict(texts)[r.doc_id] or ""
        own = [w.decode() for w in WORD.findall(t.encode())]
        triples = collections.Counter(zip(own, own[1:], own[2:], strict=False))
        inside = {i + j for i, x in enumerate(zip(own, own[1:], own[2:], strict=False)) if triples[x] > 1 for j in range(3)}
        seen, copies = set(), 0
        for line in t.split("\n"):
            copies += bool(WORD.search(line.encode())) and line in seen
            seen.add(line)
        symbols = len(re.findall(r"[#*$%&|<>]", t))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(own), sum(map(len, own)), symbols, copies, len(inside))
        assert r.base_failed == (len(own) < 50 or 2 * len(inside) > len(own))
        assert not (r.base_failed and r.kept)


def test_warc_round_trip(spark):
    big = "<p>é</p>" * 30
    rows = [(1, "http://a", big), (2, None, big), (3, "x\r\ny", None), (4, "u", "short"), (5, "u", "short"), (None, "n", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder = fresh_path(spark, "test-warc")
    warc.write_bundles(warc.mark_revisits(pages), folder, frame_bytes=500, bundle_bytes=800).collect()
    back = warc.read_bundles(spark, folder).collect()
    assert all(r.intact for r in back)
    got = {r.page_id: (r.url, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in back}
    digest = lambda h: hashlib.sha256((h or "").encode()).hexdigest()
    assert got == {
        p: (u and u.replace("\r\n", "%0D%0A"), "revisit" if h == big and p != 1 else "response", 1 if h == big and p != 1 else None, len((h or "").encode()), digest(h))
        for p, u, h in rows
    }
    head = warc.record_bytes(1, "http://a/é b?x=%20", b"", digest(""), None).split(b"\r\n\r\n")[0]
    assert b"\r\nWARC-Target-URI: http://a/%C3%A9%20b?x=%20\r\n" in head
    assert b"Target-URI" not in warc.record_bytes(1, None, b"", digest(""), None)
    bundle = warc.Bundle(50)
    for i in range(9):
        bundle.add(i, warc.record_bytes(i, "u", b"x" * i, digest("x" * i), None))
    assert warc.parse_record(warc.BundleReader(bundle.finish()).record(7))["payload"] == b"x" * 7

"""Source divergence audit: how far each source's term shares lie from other sources of its language.

The counts are those of a CountVectorizer per language with ``minDF`` and an unlimited vocabulary:
documents become sparse term counts, terms in fewer than ``min_docs`` documents of the language fall
away, and the documents of a group are summed like Summarizer sums vectors. CountVectorizer itself
gathers a vocabulary on the driver and broadcasts it, which grows with the corpus; here the vocabulary
stays a table with one row a (language, term), so nothing but Spark's shuffles holds it.

Shares are whole numbers in 10^-9, ``p = 1 + floor(10^9 (count + 1) / (N + V))``; a divergence is the sum of
``floor((p - q)^2 / q)`` over the language's V terms. Terms absent from a group all have its least share, so with
f(p, q) that term the sum over all V terms is

    V f(p0, q0) + sum over terms of g (f(p, q0) - f(p0, q0)) + sum over terms of h (f(p0, q) - f(p0, q0))
    + sum over terms of both (f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0))

The second and third sums are taken over distinct shares of a group. The last runs over terms in tasks, into
one square of sums per (language, block of sources, block of sources); pairs of one term never leave a task.

Defined results: null text, language and source count as the empty string; an empty text has no terms, and
a group without terms still has its pairs; equal values are ranked by the item's UTF-8 bytes; repeated rows
count as often as they stand; an empty table gives an empty one; a very long text is read whole; other
columns are not read, so their names cannot clash.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meterspark.llm.frames import staged
from meterspark.llm.texts import raw

SCALE = 1_000_000_000
MIN_DOCS = 3
TOP_TERMS = 200
#: Sources of one language are paired in squares of this many; a square of sums takes 8 MB.
BLOCK = 1024
#: A-Z as a-z, other ASCII but a-z as space: terms are the runs of what is left in UTF-8.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))
_FLUSH = 500_000


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs): sparse document vectors of a part of the corpus, summed by source."""
    names = ["lang", "source", "term", "n", "docs"]
    sums: dict[tuple[str, str], tuple[Counter[bytes], Counter[bytes]]] = defaultdict(lambda: (Counter(), Counter()))

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in sums.items():
            if not n:
                continue
            same = pa.array(np.zeros(len(n), np.int64))  # both counters saw their terms, not in one order
            columns = [pa.array([name], pa.string()).take(same) for name in (lang, source)]
            columns.append(pa.array(list(n), pa.binary()).cast(pa.string()))
            columns += [pa.array(np.fromiter(v, np.int64, len(n))) for v in (n.values(), map(docs.__getitem__, n))]
            yield pa.RecordBatch.from_arrays(columns, names)
        sums.clear()

    held = 0
    for rows in batches:
        data, offsets = raw(rows.column("text"))
        langs, sources = rows.column("lang").to_pylist(), rows.column("source").to_pylist()
        for i, group in enumerate(zip(langs, sources)):
            words = data[offsets[i] : offsets[i + 1]].tobytes().translate(_TERM_BYTES).split()
            n, docs = sums[group]
            before = len(n)
            n.update(words)
            docs.update(set(words))
            held += len(n) - before
            if held > _FLUSH:
                yield from flush()
                held = 0
    yield from flush()


def vocabulary(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, term, source, n, lang_n, lead): counts of kept terms by source; ``lead`` marks one row a term.

    Counts come from each part of the corpus once, already summed by source, and all of a term meet by
    (lang, term), where they are at most as many as the language has sources.
    """
    parts = docs.mapInArrow(_vectors, "lang string, source string, term string, n long, docs long")
    cells = parts.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")
    lead = F.row_number().over(term.orderBy("source")) == 1
    cells = cells.select("lang", "term", "source", "n", F.sum("docs").over(term).alias("docs"), F.sum("n").over(term).alias("lang_n"), lead.alias("lead"))
    return cells.where(F.col("docs") >= min_docs).drop("docs")


def _share(count: Column, total: Column) -> Column:
    """``1 + floor(10^9 (count + 1) / total)``, exactly; ``total`` is N + V. Very large counts take decimals."""
    short = F.call_function("div", F.lit(SCALE).cast("long") * (count + 1), total)
    scaled = F.lit(SCALE).cast("decimal(10,0)") * (count + 1).cast("decimal(20,0)")
    return F.when(count < 9_000_000_000, short).otherwise(F.call_function("div", scaled, total.cast("decimal(20,0)"))) + F.lit(1)


def _distance(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def group_table(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, source, place, groups, v, total, lang_total, least): every occurring group and its sums."""
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    langs = kept.groupBy("lang").agg(F.count_if("lead").alias("v"), F.sum("n").alias("lang_n"))
    groups = docs.select("lang", "source").distinct().join(own, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.na.fill(0, ["n", "v", "lang_n"]).withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1)
    groups = groups.withColumn("groups", F.count("*").over(Window.partitionBy("lang")))
    groups = groups.select("lang", "source", "place", "groups", "v", (F.col("n") + F.col("v")).alias("total"), (F.col("lang_n") + F.col("v")).alias("lang_total"))
    return groups.withColumn("least", F.when(F.col("v") > 0, _share(F.lit(0), F.col("total"))))


def _distances(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def _shared_terms(block: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(lang, a, b, value): the last sum of the module's formula, from terms sorted by square.

    A row is one source's place, share and least share in one term, in blocks i and j; a square
    holds sums for sources of i against j and, one layer below, of j against i.
    """

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: tuple[str, int, int] | None = None
        square = np.zeros(0, np.int64)

        def changes(rows: pa.RecordBatch) -> np.ndarray:
            """True between two rows of different terms or squares."""
            wrong = [pc.not_equal(rows.column(c)[1:], rows.column(c)[:-1]).to_numpy(zero_copy_only=False) for c in ("term", "lang", "i", "j")]
            return np.logical_or.reduce(wrong)

        def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Batches that end with a term's last row; a term has at most two blocks of sources in a square."""
            rest: pa.RecordBatch | None = None
            for rows in batches:
                rows = rows if rest is None else pa.concat_batches([rest, rows])
                cuts = np.flatnonzero(changes(rows))
                last = int(cuts[-1]) + 1 if len(cuts) else 0
                if last:
                    yield rows.slice(0, last)
                rest = rows.slice(last)
            if rest is not None and len(rest):
                yield rest

        def done() -> Iterator[pa.RecordBatch]:
            layer, a, b = np.nonzero(square.reshape(-1, block, block))
            if len(a):
                lang, i, j = at
                first, second = np.where(layer == 0, i, j), np.where(layer == 0, j, i)
                columns = [pa.array([lang] * len(a), pa.string()), pa.array(a + first * block), pa.array(b + second * block)]
                columns.append(pa.array(square.reshape(-1, block, block)[layer, a, b]))
                yield pa.RecordBatch.from_arrays(columns, ["lang", "a", "b", "value"])

        def add(place: np.ndarray, p: np.ndarray, p0: np.ndarray) -> None:
            """All ordered pairs of the sources of each row of equally long lists."""
            value = _distances(p[:, :, None], p[:, None, :]) - _distances(p[:, :, None], p0[:, None, :])
            value += _distances(p0[:, :, None], p0[:, None, :]) - _distances(p0[:, :, None], p[:, None, :])
            own, inside = place // block, place % block
            target = inside[:, :, None] * block + inside[:, None, :]
            if at[1] != at[2]:
                target = np.where(own[:, :, None] == at[1], target, target + block * block)
                apart = own[:, :, None] != own[:, None, :]
                target, value = target[apart], value[apart]
            np.add.at(square, target.ravel(), value.ravel())

        for rows in terms(batches):
            langs = rows.column("lang").to_pylist()
            i, j, place, p, p0 = (rows.column(c).to_numpy() for c in ("i", "j", "place", "p", "p0"))
            begins = np.r_[0, np.flatnonzero(changes(rows)) + 1]
            sizes = np.diff(np.r_[begins, len(langs)])
            keys = [(langs[k], int(i[k]), int(j[k])) for k in begins.tolist()]
            runs = [k for k in range(len(keys)) if not k or keys[k] != keys[k - 1]]
            for first, stop in zip(runs, [*runs[1:], len(keys)]):
                if keys[first] != at:
                    yield from done()
                    at = keys[first]
                    square = np.zeros((1 if at[1] == at[2] else 2) * block * block, np.int64)
                begin, size_of = begins[first:stop], sizes[first:stop]
                for size in np.unique(size_of[size_of > 1]).tolist():
                    members = begin[size_of == size, None] + np.arange(size)
                    step = max(1, (1 << 18) // (size * size))
                    for k in range(0, len(members), step):
                        m = members[k : k + step]
                        add(place[m], p[m], p0[m])
        yield from done()

    return sums


def shared_sums(cells: DataFrame, block: int = BLOCK) -> DataFrame:
    """(lang, a, b, value) over terms that both groups hold; a term meets a square once for its blocks.

    A source is copied to one square for each block of its language, which is one where a language has
    at most ``block`` sources.
    """
    own = F.floor(F.col("place") / block).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), F.col("last")), lambda k: F.struct(F.least(own, k).alias("i"), F.greatest(own, k).alias("j")))
    rows = cells.withColumn("last", F.floor((F.col("groups") - 1) / block).cast("int")).select("lang", "term", "place", "p", "p0", F.explode(blocks).alias("s"))
    rows = rows.select("lang", F.col("s.i").alias("i"), F.col("s.j").alias("j"), "term", "place", "p", "p0").repartition("lang", "term", "i", "j")
    return rows.sortWithinPartitions("lang", "i", "j", "term").mapInArrow(_shared_terms(block), "lang string, a long, b long, value long")


def pair_values(cells: DataFrame, groups: DataFrame, block: int = BLOCK) -> DataFrame:
    """(lang, a, b, value): divergence of group a from group b, for all pairs of a language's groups."""
    other = groups.select("lang", F.col("place").alias("b"), F.col("least").alias("q0"))
    base = groups.select("lang", F.col("place").alias("a"), F.col("least").alias("p0"), "v").join(other, "lang").where("a <> b")
    none = F.when(F.col("v") > 0, F.col("v") * _distance(F.col("p0"), F.col("q0"))).otherwise(0)
    parts = base.select("lang", "a", "b", none.cast("decimal(38,0)").alias("value"))

    equal = cells.groupBy("lang", F.col("place").alias("a"), "p", "p0").agg(F.count("*").alias("terms"))
    near = equal.join(other, "lang").where("a <> b")
    p, p0, q0, terms = (F.col(c) for c in ("p", "p0", "q0", "terms"))
    ahead = terms.cast("decimal(18,0)") * (_distance(p, q0) - _distance(p0, q0))
    back = terms.cast("decimal(18,0)") * (_distance(q0, p) - _distance(q0, p0))
    both = F.array(F.struct(F.col("a"), F.col("b"), ahead.alias("value")), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), back.alias("value")))
    single = near.select("lang", F.explode(both).alias("x")).select("lang", "x.a", "x.b", F.col("x.value").cast("decimal(38,0)").alias("value"))
    shared = shared_sums(cells, block).where("a <> b").select("lang", "a", "b", F.col("value").cast("decimal(38,0)").alias("value"))
    summed = parts.unionByName(single).unionByName(shared).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    return summed.withColumn("value", F.col("value").cast("long"))


def source_divergence(
    docs: DataFrame,
    min_docs: int = MIN_DOCS,
    top_terms: int = TOP_TERMS,
    block: int = BLOCK,
    text: str = "text",
    lang: str = "lang",
    source: str = "source",
) -> DataFrame:
    """(lang, source, part, item, value, rank): pairs of sources, and each source's leading terms."""
    columns = {"text": text, "lang": lang, "source": source}
    rows = docs.select(*(F.coalesce(F.col(old), F.lit("")).alias(new) for new, old in columns.items()))
    kept = staged(vocabulary(rows, min_docs), "terms")
    groups = staged(group_table(rows, kept), "groups")
    cells = kept.join(groups, ["lang", "source"])
    p, q = _share(F.col("n"), F.col("total")), _share(F.col("lang_n"), F.col("lang_total"))
    cells = cells.select("lang", "source", "term", "place", "groups", F.col("least").alias("p0"), p.alias("p"), q.alias("q"))

    def ranked(rows: DataFrame, part: str) -> DataFrame:
        order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
        return rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))

    names = groups.select("lang", F.col("place").alias("a"), "source")
    others = groups.select("lang", F.col("place").alias("b"), F.col("source").alias("item"))
    pairs = pair_values(cells, groups, block).join(names, ["lang", "a"]).join(others, ["lang", "b"])
    over = cells.where("p > q").select("lang", "source", F.col("term").alias("item"), _distance(F.col("p"), F.col("q")).alias("value"))
    leading = ranked(over, "term").where(F.col("rank") <= top_terms)
    return ranked(pairs, "pair").unionByName(leading)


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of all pairs of sources and leading terms of every source, over all documents."""
    return source_divergence(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP12_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents
), w AS (
  SELECT doc, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), langs AS (
  SELECT lang, term, count(*)::HUGEINT AS lang_n FROM w GROUP BY ALL HAVING count(DISTINCT doc) >= 3
), sizes AS (
  SELECT lang, count(*)::HUGEINT AS v, sum(lang_n)::HUGEINT AS total FROM langs GROUP BY lang
), cells AS (
  SELECT lang, source, term, count(*)::HUGEINT AS n FROM w SEMI JOIN langs USING (lang, term) GROUP BY ALL
), totals AS (
  SELECT lang, source, coalesce(sum(n), 0)::HUGEINT AS total
  FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN cells USING (lang, source) GROUP BY ALL
), shares AS (
  SELECT t.lang, t.source, l.term, coalesce(c.n, 0) AS n,
         1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (t.total + s.v) AS p,
         1 + (1000000000::HUGEINT * (l.lang_n + 1)) // (s.total + s.v) AS q
  FROM totals t JOIN langs l USING (lang) JOIN sizes s USING (lang) LEFT JOIN cells c USING (lang, source, term)
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p)::HUGEINT AS value
  FROM shares a JOIN shares b USING (lang, term) WHERE a.source <> b.source GROUP BY ALL
), found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0)::BIGINT AS value
  FROM totals a JOIN totals b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (((p - q) * (p - q)) // q)::BIGINT FROM shares WHERE n > 0 AND p > q
)
SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
FROM found QUALIFY part = 'pair' OR rank <= 200
"""

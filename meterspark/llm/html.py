"""Main text of web pages by site template removal.

Every page is parsed once to a list of text blocks and elements. An element's subtree hash covers its
tag, its text and its children. Spark counts in how many pages of a host each hash stands; subtrees
recurring across many pages of their host are that site's template and are deleted. Beside that,
elements whose tag, role or class says that they are no main text (menus, headers, footers, sidebars,
notices, adverts, forms, scripts, styles, reader comments) are left out, and where a page marks its
article, only the article counts. Paragraphs and headings inside a marked article are content: they
stay, however often a site repeats them or what stands around them. Names of classes say nothing about
an element around an article or main, unless it is inside one itself or the article has such a name too;
nor inside an article of which they would leave nothing. Inline elements named as adverts or hidden go up
to their end or to the next block.

Per host at most ``1 / share`` times the mean number of elements of its pages can recur in that share
of them, so the list of one host is bounded. The lists are written to the shared folder; Spark
broadcasts them where they are below its threshold and joins by host otherwise, where a hot host is
split by adaptive execution.

Defined results: null or empty html gives an empty text; white space inside a block is one space;
``<br>`` counts as white space; blocks without text vanish; unclosed and stray tags never fail; pages
without a host share the empty host. Pages of a host with equal html count as one for its templates.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from meterspark.llm.frames import keep_columns, staged
from meterspark.llm.urls import host_and_path

# Element kinds of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark math meter q rp rt ruby s "
    "samp small span strike strong sub sup svg time tt u var wbr".split()
)
RAW = "script|style|noscript|template|textarea|iframe|title"
DROPPED = frozenset(
    "nav header footer aside form button select dialog menu head script style noscript template textarea iframe "
    "object canvas svg audio video".split()
)
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre".split())
CONTENT_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt td th figcaption article main body".split())
# What an opening tag closes when it stands open.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
    "th": {"td", "th"}, "option": {"option"},
}
_CLOSE_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hr main menu nav ol p pre section table ul".split()
)
_DROPPED_NAME = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|notice|popup|modal|newsletter|"
    r"subscribe|sidebar|side|nav|navbar|navigation|menu|breadcrumbs?|header|masthead|footer|copyright|comments?|"
    r"disqus|replies|social|share|sharing|related|recommended|widget|toolbar|pagination|pager|login|signup|search)"
    r"(?:$|[\s_-])",
    re.I,
)
_ADVERT_NAME = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*)(?:$|[\s_-])", re.I)
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|$)|<({RAW})\b[^>]*>.*?(?:</\1\s*>|$)"
    r"|<[!?][^>]*>|<(/?)([a-zA-Z][\w:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)


class Element:
    """An open or closed element: what it is, and its growing content for the subtree hash."""

    __slots__ = ("article", "by_tag", "content", "dropped", "digest", "named", "own", "parent", "tag")

    def __init__(self, tag: str, parent: Element | None, dropped: bool, named: bool, article: bool) -> None:
        self.tag, self.parent, self.dropped, self.named, self.article = tag, parent, dropped, named, article
        self.by_tag = dropped  # later: by tag or role of itself or of an element around it
        self.own = False  # inside an article or main whose name is not a dropped one
        self.content: list[str] = []
        self.digest = 0

    def close(self) -> None:
        joined = f"{self.tag}\x00" + "\x01".join(self.content)
        self.digest = int.from_bytes(hashlib.blake2b(joined.encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)
        if self.parent is not None:
            self.parent.content.append(str(self.digest))
        self.content = []


def is_dropped(tag: str, attributes: str) -> bool:
    """Whether an element's tag or role says that it holds no main text."""
    if tag in DROPPED:
        return True
    if not attributes or tag in ("body", "html", "article", "main"):
        return False
    for found in _ATTRIBUTE.finditer(attributes):
        name, value = found[1].lower(), found[2] or found[3] or found[4] or ""
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return True
        if name == "role" and value.lower() in DROPPED_ROLES:
            return True
    return False


def has_dropped_name(tag: str, attributes: str) -> bool:
    """Whether an element's class or id says that it holds no main text."""
    return tag not in ("body", "html") and any(
        found[1].lower() in ("class", "id") and _DROPPED_NAME.search(found[2] or found[3] or found[4] or "")
        for found in _ATTRIBUTE.finditer(attributes)
    )


def is_advert(attributes: str) -> bool:
    """Whether an inline element's class or id has a part that names an advert, or it is hidden."""
    for found in _ATTRIBUTE.finditer(attributes):
        name, value = found[1].lower(), found[2] or found[3] or found[4] or ""
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return True
        if name in ("class", "id") and _ADVERT_NAME.search(value):
            return True
    return False


def parse(page: str) -> tuple[list[tuple[str, Element]], list[Element]]:
    """Text blocks in page order, each with its element, and all block elements."""
    root = Element("html", None, False, False, False)
    stack, elements, blocks = [root], [], []
    pieces: list[str] = []
    block: Element = root
    # An open inline advert: its tag and the piece it begins with; and how deep the same tag is nested in it.
    hidden: tuple[str, int] | None = None
    depth_inside = 0

    def flush() -> None:
        if pieces:
            text = " ".join(entities.unescape("".join(pieces)).split())
            if text:
                blocks.append((text, block))
                block.content.append(text)
            pieces.clear()

    def close_to(depth: int) -> None:
        while len(stack) > depth:
            stack.pop().close()

    at = 0
    for token in _TOKEN.finditer(page):
        if token.start() > at:
            if not pieces:
                block = stack[-1]
            pieces.append(page[at : token.start()])
        at = token.end()
        tag = (token[3] or "").lower()
        if not tag:
            continue
        if tag in INLINE:
            if hidden:
                if tag == hidden[0]:
                    depth_inside += -1 if token[2] else 0 if token[4].endswith("/") or tag in VOID else 1
                    if not depth_inside:
                        del pieces[hidden[1] :]
                        hidden = None
            elif tag in ("br", "wbr"):
                pieces.append(" " if tag == "br" else "")
            elif token[4] and not token[2] and not token[4].endswith("/") and tag not in VOID and is_advert(token[4]):
                hidden, depth_inside = (tag, len(pieces)), 1
            continue
        if hidden:  # a block ends what was left open
            del pieces[hidden[1] :]
            hidden = None
        flush()
        if token[2]:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == tag:
                    close_to(depth)
                    break
            continue
        if tag in _CLOSE_P and stack[-1].tag == "p":
            close_to(len(stack) - 1)
        while stack[-1].tag in CLOSES.get(tag, ()):
            close_to(len(stack) - 1)
        if tag in VOID or tag == "html":
            continue
        parent = stack[-1]
        marks = tag in ("article", "main")
        named = bool(token[4]) and has_dropped_name(tag, token[4])
        element = Element(tag, parent, is_dropped(tag, token[4]), named and not marks, parent.article or marks)
        own = marks and (tag == "main" or not named)
        element.own = parent.own or own
        if own:
            for above in stack:
                above.named &= above.article
        elements.append(element)
        if not token[4].endswith("/"):
            stack.append(element)
    if at < len(page):
        if not pieces:
            block = stack[-1]
        pieces.append(page[at:])
    if hidden:
        del pieces[hidden[1] :]
    flush()
    close_to(0)
    for element in elements:  # parents come first
        element.dropped |= element.named or element.parent.dropped
        element.by_tag |= element.parent.by_tag
    return blocks, elements


def removable(element: Element) -> bool:
    """Elements that template counts may delete; a marked article's own blocks are content."""
    return element.tag not in ("html", "body", "article", "main") and not (
        element.article and element.tag in CONTENT_BLOCKS
    )


def main_text(page: str, template: frozenset[int]) -> str:
    """Blocks outside dropped and template elements; of the article alone where one is marked.

    Where names of classes would leave nothing of a marked article, they do not count in it.
    """
    blocks, _ = parse(page)
    kept, marked = [], []
    unnamed = not any(element.article and not element.dropped for _, element in blocks)
    for text, element in blocks:
        if element.dropped and not (unnamed and element.own and not element.by_tag):
            continue
        above: Element | None = element
        prose = element.article and element.tag in PROSE
        while above is not None and not (above.digest in template and removable(above) and not (prose and above.article)):
            above = above.parent
        if above is None:
            kept.append(text)
            if element.article:
                marked.append(text)
    return "\n\n".join(marked or kept)


def site_templates(pages: DataFrame, min_pages: int = 5, share: float = 0.1) -> DataFrame:
    """(host, template): hashes of subtrees that stand in at least ``min_pages`` and ``share`` of a host's pages.

    Pages of a host with equal html count as one: each of n copies counts a subtree by 1 / n.
    """
    page = F.xxhash64("__text").alias("page")
    copies = pages.groupBy("host", page).agg(F.count("*").alias("copies"))
    copies = staged(copies, "copies")
    totals = copies.groupBy("host").agg(F.count("*").alias("all_pages"))
    several = copies.where("copies > 1")
    pages = pages.select("host", "__text", page).join(several, ["host", "page"], "left")

    def subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, digests, counts = [], [], []
            found: dict[tuple[str, int], float] = {}
            for host, page, copies in zip(*(batch.column(c) for c in ("host", "__text", "copies")), strict=True):
                name, weight = host.as_py(), 1 / (copies.as_py() or 1)
                _, elements = parse(page.as_py() or "")
                for digest in {e.digest for e in elements if not e.dropped and removable(e)}:
                    found[name, digest] = found.get((name, digest), 0.0) + weight
            for (name, digest), count in found.items():
                hosts.append(name)
                digests.append(digest)
                counts.append(count)
            yield pa.RecordBatch.from_arrays(
                [pa.array(hosts, pa.string()), pa.array(digests, pa.int64()), pa.array(counts, pa.float64())],
                ["host", "digest", "pages"],
            )

    counted = pages.select("host", "__text", "copies").mapInArrow(subtrees, "host string, digest long, pages double")
    whole = F.round(F.sum("pages")).alias("pages")
    counted = counted.groupBy("host", "digest").agg(whole).where(F.col("pages") >= min_pages)
    recurring = counted.join(totals, "host").where(F.col("pages") >= share * F.col("all_pages"))
    return staged(recurring.groupBy("host").agg(F.collect_list("digest").alias("template")), "templates")


def extract(pages: DataFrame, min_pages: int = 5, share: float = 0.1) -> DataFrame:
    """All columns of ``pages`` with ``text``, the main text."""
    source, passed = keep_columns(pages, "html", ["text"])
    host, _ = host_and_path(F.col("url"))
    source = source.withColumn("__host", F.coalesce(host, F.lit("")))
    templates = site_templates(source.select(F.col("__host").alias("host"), "__text"), min_pages, share)
    joined = source.join(templates.withColumnRenamed("host", "__host"), "__host", "left").drop("__host")
    schema = StructType([*source.select(*passed).schema.fields, StructField("text", StringType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for page, template in zip(batch.column("__text"), batch.column("template"), strict=True):
                found = frozenset(template.values.to_pylist()) if template.is_valid else frozenset()
                texts.append(main_text(page.as_py() or "", found))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in passed), pa.array(texts, pa.string())], [*passed, "text"])

    return joined.mapInArrow(run, schema)


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    found = extract(pages).select("page_id", "url", "text")
    return found.withColumn("n_chars", F.length("text").cast("long"))

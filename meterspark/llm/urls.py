"""URL filters: longest-rule verdicts, and link-graph propagation for hosts without a rule.

Only DataFrame functions. Links of all pages become weighted host edges, pre-aggregated before they
move. Trust is the personalised PageRank along links from the hosts whose pages rules allow, distrust the same
against links from the hosts whose pages rules block: a host hands on its mass by its links' shares, ``damping``
of it; the rest, and all mass of hosts without links, goes back to the seeds, whose shares sum to one. As mass that
goes back only scales all masses alike, the walk leaves it out and masses are scaled to sum to one in the end.
Rounds go on until the mass still under way is at most ``tolerance``. For a verdict, masses are related to the seeds: trust to the mass of an average seed, so one link
of a page with a thousand lends a thousandth; distrust for each link of the host to that for each link to a seed,
so it is about the share of the host's links that lead to blocked hosts, near ones first. A host is blocked when
its distrust ratio reaches ``floor`` and exceeds its trust ratio times ``margin``. Neither the size of the graph
nor how many other hosts link to the same place changes a ratio.

Defined results: a null url, or one without ``://``, has an empty host and path, fits no rule and is
allowed unless its (empty) host is distrusted, which links never reach; null html has no links;
repeated rows are judged alike and each of their links counts; ties between rules of equal length go
to block. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterspark.llm.frames import staged

#: (host, path, verdict)
DEFAULT_RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
_LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'>\s]+)"""


def ascii_lower(c: Column) -> Column:
    """A-Z as a-z; every other character as it is."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host after the first ``://`` up to ``/``, ``?``, ``#`` or the end, and the path after it."""
    place = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(place > 0, url.substr(place + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest.substr(F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return ascii_lower(host), path


def matching_rule(host: Column, path: Column, rules=DEFAULT_RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, else null. The rule list is a short parameter."""

    def fits(rule_host: str, rule_path: str) -> Column:
        return ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(rule_path)

    order = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[2] != "block"))
    found = F.lit(None)
    for rule_host, rule_path, verdict in reversed(order):
        pair = F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits(rule_host, rule_path), pair).otherwise(found)
    return found


def host_edges(pages: DataFrame) -> DataFrame:
    """(source, target, links) between different hosts, over all links of all pages."""
    links = pages.where(F.col("html").contains("//")).select(
        F.col("host").alias("source"),
        F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(_LINK), 1))).alias("link"),
    )
    links = links.select("source", ascii_lower("link").alias("target"))
    return links.where("source <> '' AND source <> target").groupBy("source", "target").agg(F.count("*").alias("links"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, tolerance: float = 1e-6) -> DataFrame:
    """(host, trust, distrust, trust_ratio, distrust_ratio) from ``seeds`` (kind, host, mass).

    One join of the mass under way and one aggregation a round over rows of either kind; every few rounds
    masses are written to the shared folder, so that a lost executor costs little.
    """
    walk = edges.select(F.lit("trust").alias("kind"), F.col("source").alias("host"), F.col("target").alias("to"), "links")
    back = edges.select(F.lit("distrust").alias("kind"), F.col("target").alias("host"), F.col("source").alias("to"), "links")
    both = walk.unionByName(back)
    degree = staged(both.groupBy("kind", "host").agg(F.sum("links").alias("degree")), "degrees")
    share = staged(
        both.join(degree, ["kind", "host"]).select("kind", "host", "to", (F.col("links") / F.col("degree")).alias("share")),
        "edges",
    )
    start = _scaled(seeds)
    if share.isEmpty():
        return _as_columns(start, degree, seeds)
    ranks, step = start.withColumn("change", F.col("mass")), 0
    while True:
        moved = ranks.where("change > 0").join(share, ["kind", "host"]).select(
            "kind", F.col("to").alias("host"), F.lit(0.0).alias("mass"), (F.col("change") * F.col("share") * damping).alias("change")
        )
        ranks = moved.unionByName(ranks.withColumn("change", F.lit(0.0))).groupBy("kind", "host").agg(
            (F.sum("mass") + F.sum("change")).alias("mass"), F.sum("change").alias("change")
        )
        step += 1
        if step % 4 == 0:
            ranks = staged(ranks, "ranks")
            under_way = ranks.groupBy("kind").agg(F.sum("change").alias("change"))
            if under_way.where(F.col("change") > tolerance).isEmpty():
                return _as_columns(_scaled(ranks), degree, seeds)


def _scaled(ranks: DataFrame) -> DataFrame:
    """(kind, host, mass) whose masses sum to one for each kind."""
    total = ranks.groupBy("kind").agg(F.sum("mass").alias("total"))  # two rows
    return ranks.join(total, "kind").select("kind", "host", (F.col("mass") / F.col("total")).alias("mass"))


def _as_columns(ranks: DataFrame, degree: DataFrame, seeds: DataFrame) -> DataFrame:
    """Masses and their ratios by host: trust in average seeds, distrust by the host's links over those of the seeds."""
    of_seeds = seeds.join(degree, ["kind", "host"], "left").groupBy("kind")
    of_seeds = of_seeds.agg(F.count("*").alias("seeds"), F.sum("degree").alias("seed_links"))  # two rows
    own = degree.where("kind = 'trust'").select("host", F.col("degree").alias("out"))
    rows = ranks.join(own, "host", "left").join(of_seeds, "kind")
    by_link = F.col("mass") * F.coalesce("seed_links", F.lit(0)) / F.coalesce("out", F.lit(1))
    ratio = F.when(F.col("kind") == "trust", F.col("mass") * F.col("seeds")).otherwise(by_link)
    value = lambda kind, of: F.sum(F.when(F.col("kind") == kind, of).otherwise(0.0))
    return rows.groupBy("host").agg(
        *(value(k, F.col("mass")).alias(k) for k in ("trust", "distrust")), *(value(k, ratio).alias(f"{k}_ratio") for k in ("trust", "distrust"))
    )


def url_filter(
    pages: DataFrame, rules=DEFAULT_RULES, tolerance: float = 1e-6, damping: float = 0.85, floor: float = 1e-3, margin: float = 1.0
) -> DataFrame:
    """All columns of ``pages`` with host, path, rule, verdict, trust and distrust.

    Masses are per host: a seed host starts with the share of its pages that rules allow or block.
    """
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict", "trust", "distrust")]
    host, path = host_and_path(F.col("url"))
    pages = pages.select(*kept, host.alias("host"), path.alias("path"))
    pages = pages.withColumn("found", matching_rule(F.col("host"), F.col("path"), rules))
    ruled = pages.where("host <> ''").groupBy("host").agg(
        F.count("*").alias("pages"),
        F.count(F.when(F.col("found.verdict") == "allow", 1)).alias("trust"),
        F.count(F.when(F.col("found.verdict") == "block", 1)).alias("distrust"),
    )
    seeds = staged(
        ruled.select(
            "host", F.explode(F.create_map(F.lit("trust"), F.col("trust") / F.col("pages"), F.lit("distrust"), F.col("distrust") / F.col("pages"))).alias("kind", "mass")
        ).where("mass > 0").select("kind", "host", "mass"),
        "seeds",
    )
    scores = staged(propagate(host_edges(pages), seeds, damping, tolerance), "hosts")
    judged = pages.join(scores, "host", "left")
    trust, distrust = (F.coalesce(F.col(c), F.lit(0.0)) for c in ("trust", "distrust"))
    for_it, against = (F.coalesce(F.col(f"{c}_ratio"), F.lit(0.0)) for c in ("trust", "distrust"))
    method = F.when((against >= floor) & (against > for_it * margin), "block").otherwise("allow")
    return judged.select(
        *kept,
        "host",
        "path",
        F.col("found.rule").alias("rule"),
        F.coalesce("found.verdict", method).alias("verdict"),
        trust.alias("trust"),
        distrust.alias("distrust"),
    )


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of every page's url."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return url_filter(pages).select("page_id", "host", "path", "rule", "verdict", "trust", "distrust")

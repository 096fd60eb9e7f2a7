"""The link graph: nodes, edges, and the crawl as a fixpoint over DataFrames."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteweave.functions.html import parse_pages
from siteweave.functions.urls import clean_url, link_type, resolve, resolved
from siteweave.operators.rounds import Rounds, Seen, shared_folder
from siteweave.operators.rules import Registry


def cut_lineage(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder that the session names; only where it names none, one is set."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def page_links(parsed: DataFrame, *, keep: tuple[str, ...] = ()) -> DataFrame:
    """(url, at, raw, href, path, link_type, error): links of each page in document order, resolved against the page.

    Columns of the page that are named in ``keep`` come first.
    """
    raw = parsed.select(*keep, "url", F.posexplode("p.hrefs").alias("at", "raw"))
    found = raw.withColumn("href", resolved(F.col("raw"), F.col("url")))
    return found.select(*keep, "url", "at", "raw", "href", F.try_parse_url("href", F.lit("PATH")).alias("path"), link_type(F.col("href"), F.col("url")).alias("link_type"), F.col("href").isNull().alias("error"))


def reachable(edges: DataFrame, seeds: DataFrame, *, rounds: Rounds | None = None) -> DataFrame:
    """(node, round): nodes that ``seeds`` (node) lead to over ``edges`` (src, dst), breadth first; cycles are harmless.

    Each round writes the nodes that are new in it, and nothing else.
    """
    rounds = rounds or Rounds(edges.sparkSession, name="reachable")
    seen, turn, wanted = Seen(rounds, ["node"]), 0, seeds
    while True:
        frontier = seen.fresh(turn, wanted)
        if frontier.isEmpty():
            return rounds.all(seen.table).select("node", "round")
        wanted = edges.join(frontier.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node"))
        turn += 1


@dataclass
class Round:
    """What a round of a crawl made: links (url, link_type) that its pages have, its pages and their results."""

    number: int
    links: DataFrame
    pages: DataFrame
    results: DataFrame


@dataclass
class Crawl:
    """nodes: url, link_type, error; edges: url, source_type, source_url; results: url, rule_id, passed; site_results."""

    nodes: DataFrame
    edges: DataFrame
    results: DataFrame
    site_results: DataFrame
    quarantine: DataFrame
    rounds: Rounds

    def total_pages(self) -> int:
        return self.nodes.count()

    def found_in(self) -> DataFrame:
        return self.edges.groupBy("url").agg(F.collect_set(F.struct("source_type", "source_url")).alias("found_in"))

    def progress(self) -> DataFrame:
        """(total_pages, completed_pages): internal nodes, and nodes with any result."""
        done = self.nodes.filter("error").select("url").unionByName(self.results.select("url")).unionByName(self.site_results.filter("url IS NOT NULL").select("url")).distinct()
        both = self.nodes.select((F.col("link_type") == "Internal").cast("long").alias("t"), F.lit(0).cast("long").alias("c")).unionByName(done.select(F.lit(0).cast("long").alias("t"), F.lit(1).cast("long").alias("c")))
        return both.agg(F.sum("t").alias("total_pages"), F.sum("c").alias("completed_pages"))


def crawl(spark: SparkSession, base_url: str, sitemap: DataFrame, fetch: Callable[[DataFrame], DataFrame], *, registry: Registry | None = None, max_rounds: int | None = None, strict: bool = False, folder: str | None = None, on_round: Callable[[Round], None] | None = None) -> Crawl:
    """Follows internal links from the root and the sitemap's URLs until there is nothing new.

    ``sitemap`` has a column url. ``fetch`` maps (url) to (url, html, status_code, error): the snapshot or the network.
    Links are resolved against their page, then classed against the site. Pages that can't be fetched are error nodes
    without results. Links that are no URL go to ``quarantine``; with ``strict`` they stop the crawl. Without a round, or
    from a base that is no URL and no sitemap, no page is fetched and the results are empty.

    A round writes its new URLs, pages, results and links to folders of their own and rewrites nothing. New URLs are told
    by a set of seen ones that is dealt over buckets. ``folder`` keeps these tables: a crawl that died goes on with the
    round that it was in when it is started again with the same folder. ``on_round`` is called after each round.
    """
    registry = registry or Registry.default()
    base, rounds = F.lit(base_url), Rounds(spark, folder, name="crawl")
    seen, turn = Seen(rounds, ["url"]), 0

    def keyed(df: DataFrame) -> DataFrame:
        made = df.withColumn("href", resolve("raw", base)).withColumn("link_type", link_type(F.col("href"), base))
        return made.withColumn("url", clean_url(F.col("href")))

    root = spark.range(1).select(base.alias("raw"), F.lit("Root").alias("source_type"), base.alias("source_url"))
    listed = sitemap.select(F.col("url").alias("raw"), F.lit("Sitemap").alias("source_type"), F.col("url").alias("source_url"))
    edges = rounds.add("edges", 0, lambda: keyed(root.unionByName(listed)))
    while max_rounds is None or turn < max_rounds:
        frontier = seen.fresh(turn, edges.filter("url IS NOT NULL AND link_type = 'Internal'").select("url"))
        if frontier.isEmpty():
            break
        pages = rounds.add("pages", turn, lambda: parse_pages(fetch(frontier)))  # noqa: B023
        results = rounds.add("results", turn, lambda: registry.analyze(pages.filter("NOT error").withColumn("site", base)).select("url", "rule_id", "passed"))  # noqa: B023
        out = page_links(pages.filter("NOT error")).select(F.col("href").alias("raw"), F.lit("Link").alias("source_type"), F.col("url").alias("source_url"))
        if strict and not out.filter("raw IS NULL").isEmpty():
            raise ValueError("a page has a link that is no URL")
        turn += 1
        edges = rounds.add("edges", turn, lambda: keyed(out))  # noqa: B023
        if on_round:
            on_round(Round(turn - 1, edges.filter("url IS NOT NULL").groupBy("url").agg(F.min("link_type").alias("link_type")), pages, results))
    every = rounds.all("edges")
    if "pages" in rounds.schemas:
        parsed, results = rounds.all("pages").drop("round"), rounds.all("results").drop("round")
    else:
        parsed = parse_pages(fetch(every.filter("url IS NOT NULL").select("url").limit(0)))
        results = registry.analyze(parsed.filter("NOT error").withColumn("site", base)).select("url", "rule_id", "passed")
    links = every.filter("url IS NOT NULL").select("url", "source_type", "source_url").distinct()
    nodes = every.filter("url IS NOT NULL").groupBy("url").agg(F.min("link_type").alias("link_type"))  # a URL has one type
    nodes = nodes.join(parsed.select("url", "error"), "url", "left").select(base.alias("site"), "url", "link_type", F.coalesce("error", F.lit(False)).alias("error"))
    pages = parsed.filter("NOT error").withColumn("site", base)
    site_results = registry.analyze_site(nodes, links, pages)
    # Only after the site rules were judged, what they name is led to from the root.
    named = site_results.filter("kind = 'Urls' AND url IS NOT NULL").select("url", F.lit("Link").alias("source_type"), base.alias("source_url"))
    return Crawl(nodes, links.unionByName(named).distinct(), results, site_results, every.filter("url IS NULL").select("source_type", "source_url"), rounds)


def snapshot_fetch(pages: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """Fetches from a table (url, html): its URLs are cleaned, and of equal ones the one with the smallest page_id counts."""
    status = F.col("status_code").cast("int") if "status_code" in pages.columns else F.lit(None).cast("int")
    order = "page_id" if "page_id" in pages.columns else "url"
    kept = pages.groupBy(clean_url(F.col("url")).alias("url")).agg(F.min_by(F.struct("html", status.alias("status_code")), order).alias("x")).select("url", "x.*")
    return lambda urls: urls.join(kept, "url", "left").withColumn("error", F.col("html").isNull())

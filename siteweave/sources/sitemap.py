"""Sitemaps: candidate addresses, locations in XML, and the fixpoint over sitemap indexes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteweave.functions.html import parse_pages
from siteweave.functions.urls import resolve
from siteweave.operators.rounds import Rounds, Seen

#: Where sitemaps are looked for if a site names none: fixed values.
WELL_KNOWN = ["/sitemap.xml", "/sitemap_index.xml", "/sitemap-index.xml", "/sitemap/sitemap.xml"]


#: Stands around a body to see that it is one element and nothing else.
_GUARD = "siteweave-guard"


def loc_urls(body: Column) -> Column:
    """The texts that begin loc elements of any namespace, in order; none of malformed XML, null of null.

    A body with a document type declaration counts as malformed: its entities are never looked up. The body is read
    twice in the JVM: ``from_xml`` says whether it is well-formed, so that ``xpath`` cannot fail on it.
    """
    bare = F.regexp_replace(body, r"\A\x{FEFF}?(?:<\?xml[ \t\r\n][^>]*\?>)?", "")
    wrapped = F.concat(F.lit(f"<{_GUARD}>"), bare, F.lit(f"</{_GUARD}>"))
    faults = F.from_xml(wrapped, "_corrupt_record string", {"mode": "PERMISSIVE"})["_corrupt_record"]
    whole = F.xpath_boolean(wrapped, F.lit(f"count(/{_GUARD}/*) = 1 and not(/{_GUARD}/text()[normalize-space()])"))
    texts = F.xpath(wrapped, F.lit("//*[local-name()='loc']/node()[1][self::text()]"))
    sound = ~bare.contains(_GUARD) & faults.isNull()
    none = F.array().cast("array<string>")
    return F.when(body.isNull(), None).when(sound, F.when(whole, texts).otherwise(none)).otherwise(none)


def is_index(body: Column) -> Column:
    return F.coalesce(body.contains("<sitemapindex"), F.lit(False))


def candidates(sites: DataFrame) -> DataFrame:
    """(site, url) from (site, sitemap): the address that the root page declares, or else the well-known ones."""
    known = F.array(*[F.lit(p) for p in WELL_KNOWN])
    return sites.select("site", F.explode(F.when(F.col("sitemap").isNotNull(), F.array("sitemap")).otherwise(known)).alias("raw")).select("site", resolve("raw", "site").alias("url")).filter("url IS NOT NULL")


def discover(sites: DataFrame, fetch: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(site, sitemap): the sitemap that each site's root page names, null if none; ``fetch`` maps (url) to (url, html)."""
    roots = fetch(sites.select(F.col("site").alias("url"))).select("url", "html")
    return sites.join(parse_pages(roots).select(F.col("url").alias("site"), F.col("p.sitemap").alias("sitemap")), "site", "left")


def bodies(fetch: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """What ``expand`` reads sitemaps by, from a fetch of pages: (site, url) to (site, url, body)."""

    def run(wanted: DataFrame) -> DataFrame:
        read = fetch(wanted.select("url").distinct()).select("url", F.col("html").alias("body"))
        return wanted.join(read, "url", "left").select("site", "url", "body")

    return run


def expand(start: DataFrame, fetch: Callable[[DataFrame], DataFrame], *, rounds: Rounds | None = None) -> DataFrame:
    """(site, url): all locations reached from the sitemaps ``start`` (site, url), children of an index included.

    ``fetch`` maps (site, url) to (site, url, body). A sitemap is read once, so cyclic indexes end; bodies that are missing
    or malformed list nothing. Each round writes what is new in it, and nothing else.
    """
    rounds = rounds or Rounds(start.sparkSession, name="sitemaps")
    seen, turn, wanted = Seen(rounds, ["site", "url"]), 0, start
    while True:
        frontier = seen.fresh(turn, wanted)
        if frontier.isEmpty():
            break
        read = rounds.add("listed", turn, lambda: fetch(frontier).select("site", is_index(F.col("body")).alias("index"), F.explode(loc_urls(F.col("body"))).alias("url")))  # noqa: B023
        wanted = read.filter("index").select("site", "url")
        turn += 1
    return start.select("site", "url").limit(0) if not turn else rounds.all("listed").select("site", "url").distinct()

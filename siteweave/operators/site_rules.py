"""Rules over whole sites: aggregates of descriptions, and pages that only a sitemap knows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteweave.operators.rules import Rule, SitePlugin


def uniqueness(pages: DataFrame, value: str, *, by: str = "site", least: float = 90.0) -> DataFrame:
    """By site: pages with a value, distinct values, and whether their share is at least ``least`` percent.

    A site without any value passes.
    """
    groups = pages.groupBy(by).agg(F.count(value).alias("total"), F.countDistinct(value).alias("distinct_values"))
    share = F.col("distinct_values") * 100.0 / F.when(F.col("total") > 0, F.col("total"))
    return groups.select(by, "total", "distinct_values", F.coalesce(share >= least, F.lit(True)).alias("passed"))


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that no source but a sitemap leads to. ``nodes``: url, ...; ``edges``: url, source_type, ..."""
    return nodes.join(edges.filter(F.col("source_type") != "Sitemap").select("url"), "url", "left_anti")


def result(frame: DataFrame, rule_id: str, passed: Column, kind: str, key: Column, url: Column) -> DataFrame:
    return frame.select("site", F.lit(rule_id).alias("rule_id"), passed.alias("passed"), F.lit(kind).alias("kind"), key.cast("string").alias("key"), url.alias("url"))


class DescriptionUniqueness(SitePlugin):
    name, description = "Meta Description Plugin", "Descriptions of a site differ"

    def rules(self) -> list[Rule]:
        return [Rule("meta_description_uniqueness", "Unique descriptions", self.name, "Warning", "SEO", "Nine in ten descriptions of a site differ", "Descriptions are unique", "Descriptions repeat", rule_type="Site")]

    def check(self, nodes: DataFrame, edges: DataFrame, parsed: DataFrame) -> DataFrame:
        """A site that passes has a row for each described page, with its description as key; one that fails has no url."""
        described = parsed.select("site", "url", F.col("p.description").alias("description"))
        verdicts = uniqueness(described, "description").select("site", "passed")
        rows = described.filter("description IS NOT NULL").join(verdicts.filter("passed"), "site")
        good = result(rows, "meta_description_uniqueness", F.lit(True), "Values", F.col("description"), F.col("url"))
        bad = result(verdicts.filter("NOT passed"), "meta_description_uniqueness", F.lit(False), "Empty", F.lit(None), F.lit(None).cast("string"))
        return good.unionByName(bad)


class OrphanedPages(SitePlugin):
    name, description = "OrphanedPage Plugin", "Pages that nothing links to"

    def rules(self) -> list[Rule]:
        return [Rule("orphaned_page.check", "Orphaned pages", self.name, "Warning", "SEO", "Every page of the sitemap is linked to", "There are no orphaned pages", "There are orphaned pages", rule_type="Site")]

    def check(self, nodes: DataFrame, edges: DataFrame, parsed: DataFrame) -> DataFrame:
        lost = orphans(nodes, edges)
        bad = result(lost, "orphaned_page.check", F.lit(False), "Urls", F.lit(None), F.col("url"))
        good = nodes.select("site").distinct().join(lost.select("site"), "site", "left_anti")
        return bad.unionByName(result(good, "orphaned_page.check", F.lit(True), "Urls", F.lit(None), F.lit(None).cast("string")))


def unknown_rule(rule_id: str, sites: DataFrame) -> DataFrame:
    """A rule that no plugin knows fails without rows of its own."""
    return result(sites.select("site").distinct(), rule_id, F.lit(False), "Empty", F.lit(None), F.lit(None).cast("string"))

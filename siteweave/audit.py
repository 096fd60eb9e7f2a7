"""One call from an address to stored results: sitemap, crawl, rules, store, events."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from siteweave.functions.urls import resolve_one
from siteweave.operators.graph import Crawl, Round, crawl
from siteweave.operators.rounds import shared_folder
from siteweave.operators.rules import Registry
from siteweave.operators.store import ResultStore
from siteweave.sources.fetch import http_fetch
from siteweave.sources.settings import CrawlSettings
from siteweave.sources.sitemap import bodies, candidates, discover, expand
from siteweave.streaming.events import END, round_events, run_event, site_events


@dataclass
class Audit:
    run: int
    crawl: Crawl


def base_url(typed: str) -> str:
    """What a user types as an address, as a URL: https unless it names a scheme. ``ValueError`` if it can't be one."""
    full = typed if typed.startswith(("http://", "https://")) else f"https://{typed}"
    found = resolve_one(full, full)
    if not typed.strip() or not found:
        raise ValueError(f"no address: {typed}")
    return found


def sitemap_urls(spark: SparkSession, base: str, fetch: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(url): what the site's sitemaps list, the one its root page names or else the well-known ones."""
    sites = spark.createDataFrame([(base,)], "site string")
    return expand(candidates(discover(sites, fetch)), bodies(fetch)).select("url")


def audit(spark: SparkSession, url: str, store: ResultStore, *, fetch: Callable[[DataFrame], DataFrame] | None = None, settings: CrawlSettings | None = None, registry: Registry | None = None, max_rounds: int | None = None, events: str | None = None, on_event: Callable[[dict], None] | None = None) -> Audit:
    """Audits a site and stores the run.

    Without ``fetch``, pages come over HTTP, at most as many at once and as fast as ``settings`` allow. The run is Pending
    until the crawl begins, Running, then Finished once all is stored, or Error if anything fails. ``on_event`` is called
    on the driver with AnalysisStart, SiteRunIdSet, AnalyzedPages after each round, and AnalysisFinished; ``events`` is a
    folder to which the events of single pages are appended round by round, so that a stream of ``read_events`` follows the
    run, then those of site rules and, after everything is stored, its end. If the folder fails before, nothing is stored.
    """
    settings, registry, base = settings or CrawlSettings(), registry or Registry.default(), base_url(url)
    fetch = fetch or http_fetch(concurrency=settings.max_concurrent_requests, delay_ms=settings.request_delay_ms, ledger=f"{shared_folder(spark)}/fetched-{uuid.uuid4().hex[:12]}")
    tell = on_event or (lambda event: None)
    tell({"kind": "AnalysisStart", "url": base})
    store.migrate()
    store.seed_rules(registry.dimension(spark))
    run = store.create_run(base)
    tell({"kind": "SiteRunIdSet", "site_run_id": run})
    keep = (lambda made: made.write.mode("append").parquet(events)) if events else (lambda made: None)
    try:
        keep(run_event(spark, run, "AnalysisStart", base, seq=-1))
        store.set_status(run, "Running")

        def told(done: Round) -> None:
            keep(round_events(done, run))
            tell({"kind": "AnalyzedPages", "site_run_id": run, "round": done.number})

        found = crawl(spark, base, sitemap_urls(spark, base, fetch), fetch, registry=registry, max_rounds=max_rounds, on_round=told)
        keep(site_events(found.site_results, run))
        total, done = found.progress().first()
        store.save_crawl(run, found)
    except BaseException:
        store.set_status(run, "Error")
        raise
    keep(run_event(spark, run, "AnalysisFinished", base, seq=END, total=total, completed=done))  # everything is stored by now
    tell({"kind": "AnalysisFinished", "site_run_id": run, "total_pages": total, "completed_pages": done})
    return Audit(run, found)

"""Progress events as a stream, with an idempotent sink into the result store."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siteweave.operators.graph import Round
from siteweave.operators.ledger import State
from siteweave.operators.store import ResultStore

EVENT = (
    T.StructType().add("seq", "long").add("site_run_id", "integer").add("kind", "string").add("url", "string").add("link_type", "string")
    .add("rule_id", "string").add("passed", "boolean").add("total_pages", "long").add("completed_pages", "long")
)


#: Where in a run's order what concerns the whole site comes: after all pages.
SITE, END = 1 << 40, (1 << 40) + 1


def _events(rows: DataFrame, run: int, kind: str, seq: int, **given: Column) -> DataFrame:
    made = {"seq": F.lit(seq), "site_run_id": F.lit(run), "kind": F.lit(kind), "url": F.col("url")} | given
    return rows.select(*[made.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in EVENT])


def crawl_events(nodes: DataFrame, results: DataFrame, run: int, *, total: int | None = None, completed: int | None = None, seq: int = 0) -> DataFrame:
    """FoundLink for each node, then AnalyzedPage for each result, with the crawl's counts where they are given."""
    counts = {"total_pages": F.lit(total), "completed_pages": F.lit(completed)}
    found = _events(nodes, run, "FoundLink", seq, link_type=F.col("link_type"), **counts)
    return found.unionByName(_events(results, run, "AnalyzedPage", seq + 1, rule_id=F.col("rule_id"), passed=F.col("passed"), **counts))


def round_events(done: Round, run: int) -> DataFrame:
    """Events of a round of a crawl: its pages and their links are found, then its pages analyzed; those that could not be
    fetched have an AnalyzedPage without a rule."""
    internal = done.pages.select("url", F.lit("Internal").alias("link_type"))
    failed = done.pages.filter("error").select("url", F.lit(None).cast("string").alias("rule_id"), F.lit(None).cast("boolean").alias("passed"))
    return crawl_events(internal.unionByName(done.links.select("url", "link_type")).distinct(), done.results.select("url", "rule_id", "passed").unionByName(failed), run, seq=2 * done.number)


def site_events(site_results: DataFrame, run: int) -> DataFrame:
    """AnalyzedSite for each page that a site rule names."""
    return _events(site_results.filter("url IS NOT NULL"), run, "AnalyzedSite", SITE, rule_id=F.col("rule_id"), passed=F.col("passed"))


def run_event(spark: SparkSession, run: int, kind: str, url: str, *, seq: int, total: int | None = None, completed: int | None = None) -> DataFrame:
    """An event of a whole run: AnalysisStart or AnalysisFinished."""
    return spark.createDataFrame([(seq, run, kind, url, None, None, None, total, completed)], EVENT)


def report_changes(store: ResultStore, base: State, runs: list[int], pages: DataFrame, results: DataFrame, batch: str) -> dict[str, DataFrame]:
    """What rows that come to the store change in the reports of their runs: signed counts, from old verdict to new."""
    old_pages = store.read("site_page", runs, state=base).select("site_run_id", "url")
    fresh = pages.join(old_pages, ["site_run_id", "url"], "left_anti")
    links = fresh.groupBy("site_run_id", "db_link_type").agg(F.count("*").alias("count"))
    old = store.read("page_rule_result", runs, state=base).select("site_run_id", "url", "rule_id", F.col("passed").alias("was"))
    rules = store.read("plugin_rule", state=base).select(F.col("id").alias("rule_id"), "category")  # a row for each rule of the registry
    both = results.select("site_run_id", "url", "rule_id", "passed").join(old, ["site_run_id", "url", "rule_id"], "left").join(F.broadcast(rules), "rule_id")
    was = lambda good: F.coalesce((F.col("was") == good).cast("long"), F.lit(0))
    is_ = lambda good: (F.col("passed") == good).cast("long")
    changed = both.groupBy("site_run_id", "category").agg(F.count_if(F.col("was").isNull()).alias("total"), F.sum(is_(True) - was(True)).alias("passed"), F.sum(is_(False) - was(False)).alias("failed"))
    named = F.lit(batch).alias("batch")
    return {"link_count": links.withColumn("batch", named), "category_count": changed.filter("total <> 0 OR passed <> 0 OR failed <> 0").withColumn("batch", named)}


def apply_batch(store: ResultStore, batch: DataFrame, number: int | None = None, *, name: str = "events") -> None:
    """Stores one batch of events and what it changes in the reports, in one commit; a run's status changes last.

    A batch whose ``number`` (under ``name``) is stored already changes nothing; without a number, doing it again leaves
    pages, results and reports as they are.
    """
    runs = [r[0] for r in batch.select("site_run_id").distinct().collect()]  # runs under way
    label = uuid.uuid4().hex[:12] if number is None else f"{name}-{number}"

    def work(base: State) -> bool:
        pages = store.page_rows(batch.filter("kind = 'FoundLink'").select("site_run_id", "url", "link_type", "seq"))
        results = store.result_rows(batch.filter("kind IN ('AnalyzedPage', 'AnalyzedSite') AND rule_id IS NOT NULL").select("site_run_id", "url", "rule_id", "passed", "seq"))
        tables = {"site_page": pages, "page_rule_result": results} | report_changes(store, base, runs, pages, results, label)
        alone = [(t, str(r)) for t in ("site_page", "page_rule_result") for r in runs]
        return store.add(tables, batch=None if number is None else (name, number), alone=alone, base=base)

    store.again(work)
    ends = {r.site_run_id: r.ended for r in batch.filter("kind IN ('AnalysisStart', 'AnalysisFinished')").groupBy("site_run_id").agg(F.bool_or(F.col("kind") == "AnalysisFinished").alias("ended")).collect()}
    for run, ended in ends.items():
        if ended or store.status(run) == "Pending":  # a start that comes again opens nothing
            store.set_status(run, "Finished" if ended else "Running")


def read_events(spark: SparkSession, path: str, *, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def sink(events: DataFrame, store: ResultStore, checkpoint: str, *, every: str | None = None):
    """Starts the upserting sink: over what is there, or every so often."""

    def handle(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            apply_batch(store, batch, number, name=checkpoint)
        finally:
            batch.unpersist()

    writer = events.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()

"""Reports over the result store. All take and return DataFrames; order is left to the caller unless a report is ordered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteweave.functions.urls import path

#: Runs that the history shows.
HISTORY = 10


def sites_with_runs(sites: DataFrame, runs: DataFrame) -> DataFrame:
    """A row for each site and run (null for a site without runs), with the time of the site's last run; epoch without one."""
    last = runs.groupBy("site_id").agg(F.max_by("created_at", "id").alias("last_site_run_at"))
    joined = sites.select(F.col("id").alias("site_id"), "url").join(runs.select("site_id", F.col("id").alias("run_id"), "status"), "site_id", "left")
    return joined.join(last, "site_id", "left").withColumn("last_site_run_at", F.coalesce("last_site_run_at", F.timestamp_seconds(F.lit(0))))


def by_id(table: DataFrame, number: int) -> DataFrame:
    return table.filter(F.col("id") == number)


def site_runs(runs: DataFrame, site_id: int) -> DataFrame:
    return runs.filter(F.col("site_id") == site_id)


def link_counts(pages: DataFrame, run: int | None = None, *, by: list[str] | None = None) -> DataFrame:
    pages = pages if run is None else pages.filter(F.col("site_run_id") == run)
    return pages.groupBy(*(by or []), "db_link_type").agg(F.count("url").alias("count"))


def link_counts_total(pages: DataFrame) -> DataFrame:
    """Link counts with a row Total."""
    return pages.rollup("db_link_type").agg(F.count("url").alias("count")).select(F.coalesce("db_link_type", F.lit("Total")).alias("db_link_type"), "count")


def link_display(counts: DataFrame) -> DataFrame:
    """Total, Internal and External, 0 where there are none."""
    domain = counts.sparkSession.createDataFrame([("Total",), ("Internal",), ("External",)], "db_link_type string")
    return domain.join(counts, "db_link_type", "left").withColumn("count", F.coalesce("count", F.lit(0)))


def _counts() -> list[Column]:
    return [F.count("*").alias("total"), F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed")]


def category_result(results: DataFrame, rules: DataFrame, *, by: list[str] | None = None) -> DataFrame:
    """Totals by category. The table of rules has one row for each rule of the registry, so it is handed to every task."""
    named = results.join(F.broadcast(rules.select(F.col("id").alias("rule_id"), "category")), "rule_id")
    return named.groupBy(*(by or []), "category").agg(*_counts())


def category_result_totals(results: DataFrame, rules: DataFrame) -> DataFrame:
    """Totals by category with the pass rate in percent, and a row Total."""
    named = results.join(F.broadcast(rules.select(F.col("id").alias("rule_id"), "category")), "rule_id")
    out = named.rollup("category").agg(*_counts()).withColumn("category", F.coalesce("category", F.lit("Total")))
    return out.withColumn("pass_rate", pass_rate())


def pass_rate() -> Column:
    return F.when(F.col("total") > 0, F.col("passed") * 100.0 / F.col("total")).otherwise(F.lit(0.0))


def last_runs(runs: DataFrame, depth: int) -> DataFrame:
    return runs.orderBy(F.desc("created_at"), F.desc("id")).limit(depth).select(F.col("id").alias("site_run_id"), "created_at")


def category_history(results: DataFrame, rules: DataFrame, runs: DataFrame, *, depth: int = HISTORY) -> DataFrame:
    """The last ``depth`` runs with their totals by category; a run without results stays, with a null category."""
    last = last_runs(runs, depth)
    totals = category_result(results.join(F.broadcast(last.select("site_run_id")), "site_run_id"), rules, by=["site_run_id"])
    return last.join(totals, "site_run_id", "left")


def kept_category_result(counts: DataFrame) -> DataFrame:
    """Totals by run and category from what batches changed in them (the table category_count)."""
    sums = counts.groupBy("site_run_id", "category").agg(*[F.sum(c).alias(c) for c in ("total", "passed", "failed")])
    return sums.filter("total > 0")


def kept_category_history(counts: DataFrame, runs: DataFrame, *, depth: int = HISTORY) -> DataFrame:
    """Like ``category_history``, from what batches changed."""
    last = last_runs(runs, depth)
    return last.join(kept_category_result(counts.join(F.broadcast(last.select("site_run_id")), "site_run_id")), "site_run_id", "left")


def kept_link_counts(counts: DataFrame) -> DataFrame:
    """Links by run and type from what batches changed in them (the table link_count)."""
    return counts.groupBy("site_run_id", "db_link_type").agg(F.sum("count").alias("count")).filter("count > 0")


def run_progress(parts: DataFrame) -> DataFrame:
    """(site_run_id, total_pages, completed_pages, started, finished, kind, url) from the parts of runs (run_progress)."""
    last = lambda c: F.max_by(c, "last_seq").alias(c)
    return parts.groupBy("site_run_id").agg(F.sum("total_pages").alias("total_pages"), F.sum("completed_pages").alias("completed_pages"), F.bool_or("started").alias("started"), F.bool_or("finished").alias("finished"), last("kind"), last("url"))


def pass_rate_chart(history: DataFrame) -> DataFrame:
    return history.select("site_run_id", F.date_format("created_at", "M/d").alias("label"), "category", pass_rate().alias("pass_rate"))


def category_detail(results: DataFrame, rules: DataFrame, passed: bool | None = None) -> DataFrame:
    """Results with their rule's texts, all or only those that passed or failed."""
    results = results if passed is None else results.filter(F.col("passed") == passed)
    message = F.when(F.col("passed"), F.col("passed_message")).otherwise(F.col("failed_message"))
    named = results.join(F.broadcast(rules.withColumnRenamed("id", "rule_id")), "rule_id")
    return named.select("rule_id", "name", "plugin_name", "passed", message.alias("message"), "severity", "category", F.col("url").alias("page_url"))


def issue_groups(detail: DataFrame) -> DataFrame:
    failed = detail.filter("NOT passed")
    return failed.groupBy("category", "name").agg(F.count("*").alias("count"), F.min("severity").alias("severity"), F.min("message").alias("message"))


def issues_flat(page_issues: DataFrame, site_issues: DataFrame) -> DataFrame:
    return page_issues.unionByName(site_issues).withColumn("pathname", path(F.col("page_url")))


def most_recent_run(runs: DataFrame) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("site_id").orderBy(F.desc("created_at"), F.desc("id")))
    return runs.withColumn("n", rank).filter("n = 1").drop("n")


def percent_fill(value: Column, top: Column) -> Column:
    """Rounded percent of a ring, at most 100."""
    return F.round(F.least(value / F.when(top != 0, top), F.lit(1.0)) * 100).cast("int")


def colour_band(share: Column) -> Column:
    return F.when(share < 0.5, "low").when(share < 0.9, "middle").otherwise("high")


def progress_latest(events: DataFrame) -> DataFrame:
    """The last event of each run."""
    return events.groupBy("site_run_id").agg(F.max_by(F.struct("kind", "url", "total_pages", "completed_pages"), "seq").alias("x")).select("site_run_id", "x.*")

"""Metrics from Lighthouse reports in JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names of metrics in a report: fixed values.
CATEGORIES = ["performance", "accessibility", "best-practices", "seo", "pwa"]
AUDITS = ["first-contentful-paint", "speed-index", "largest-contentful-paint", "interactive", "total-blocking-time", "cumulative-layout-shift"]


def _number(report: Column, where: str) -> Column:
    return F.coalesce(F.try_variant_get(report, where, "double"), F.lit(0.0))


def metrics(reports: DataFrame, *, column: str = "json") -> DataFrame:
    """Category scores times 100 and numeric values of audits; 0 where a report lacks them, or is null or no JSON.

    A report is parsed once, into a variant that all metrics are taken from.
    """
    report = free_column("report", reports.columns)
    held = reports.withColumn(report, F.try_parse_json(column))
    scores = [(_number(F.col(report), f"$.categories['{c}'].score") * 100).alias(c.replace("-", "_") + "_score") for c in CATEGORIES]
    values = [_number(F.col(report), f"$.audits['{a}'].numericValue").alias("time_to_interactive" if a == "interactive" else a.replace("-", "_")) for a in AUDITS]
    return held.select(*[c for c in reports.columns if c != column], *scores, *values)


def free_column(name: str, taken: list[str]) -> str:
    while name in taken:
        name = f"_{name}"
    return name

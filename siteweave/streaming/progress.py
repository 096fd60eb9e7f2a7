"""How far runs are, from their events, with state that survives restarts and counts nothing twice.

A run's pages are dealt over parts by their URL, so that a large run is no single task's. A part's state is what is known
of each of its URLs; counters change only where that changes, so events that come again, in whatever order, are harmless.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from siteweave.operators.store import ResultStore
from siteweave.schema import RUN_PROGRESS

#: Parts of a run.
PARTS = 16
FOUND, DONE = 1, 2
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_TOTALS = T.StructType().add("total", "long").add("done", "long").add("started", "boolean").add("finished", "boolean").add("seq", "long").add("kind", "string").add("url", "string")


class Progress(StatefulProcessor):
    """State of a part of a run: by URL what has happened to it, and the part's counters and last event."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.urls = handle.getMapState("urls", T.StructType().add("url", "string"), T.StructType().add("known", "integer"))
        self.totals = handle.getValueState("totals", _TOTALS)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.totals.get() if self.totals.exists() else None
        total, done, started, finished, seq, kind, url = held or (0, 0, False, False, -(1 << 62), None, None)
        for batch in rows:
            started = started or bool((batch.kind == "AnalysisStart").any())
            finished = finished or bool((batch.kind == "AnalysisFinished").any())
            last = batch.sort_values(["seq", "kind", "url"], na_position="first").iloc[-1]
            if (last.seq, last.kind, last.url or "") > (seq, kind or "", url or ""):
                seq, kind, url = int(last.seq), last.kind, last.url
            found = set(batch.url[(batch.kind == "FoundLink") & (batch.link_type == "Internal")])
            analyzed = set(batch.url[batch.kind.isin(["AnalyzedPage", "AnalyzedSite"])])
            for page in found | analyzed:
                was = self.urls.getValue((page,))[0] if self.urls.containsKey((page,)) else 0
                now = was | FOUND * (page in found) | DONE * (page in analyzed)
                if now != was:
                    self.urls.updateValue((page,), (now,))
                    total += (now & FOUND) - (was & FOUND)
                    done += (now & DONE) // DONE - (was & DONE) // DONE
        self.totals.update((total, done, started, finished, seq, kind, url))
        yield pd.DataFrame({"site_run_id": [key[0]], "part": [key[1]], "total_pages": [total], "completed_pages": [done], "started": [started], "finished": [finished], "last_seq": [seq], "kind": [kind], "url": [url]})

    def close(self) -> None:
        pass


def run_parts(events: DataFrame) -> DataFrame:
    """The parts of runs that events change, as they are after them. ``events`` is a stream."""
    part = F.pmod(F.xxhash64("url"), F.lit(PARTS)).cast("int")
    keyed = events.filter("site_run_id IS NOT NULL").withColumn("part", part)
    return keyed.groupBy("site_run_id", "part").transformWithStateInPandas(Progress(), RUN_PROGRESS, "Update", "None")


def follow(events: DataFrame, store: ResultStore, checkpoint: str, *, every: str | None = None):
    """Keeps the table run_progress of the store: over the events that are there, or every so often. The session must keep
    state in RocksDB (``spark.sql.streaming.stateStore.providerClass`` = ``PROVIDER``); it is set here."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)

    def handle(batch: DataFrame, number: int) -> None:
        store.add({"run_progress": batch}, batch=(checkpoint, number))

    writer = run_parts(events).writeStream.foreachBatch(handle).outputMode("update").option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def parts_of(events: DataFrame) -> DataFrame:
    """What ``run_parts`` comes to over all events of a table: the same by grouping."""
    page = F.col("kind").isin("AnalyzedPage", "AnalyzedSite")
    by_url = events.filter("site_run_id IS NOT NULL").groupBy("site_run_id", "url").agg(
        F.bool_or((F.col("kind") == "FoundLink") & F.coalesce(F.col("link_type") == "Internal", F.lit(False))).alias("found"), F.bool_or(page).alias("done"),
        F.bool_or(F.col("kind") == "AnalysisStart").alias("started"), F.bool_or(F.col("kind") == "AnalysisFinished").alias("finished"),
        F.max(F.struct("seq", "kind")).alias("last"),
    )
    last = F.max(F.struct("last.seq", "last.kind", F.coalesce("url", F.lit("")).alias("u"), "url"))
    return by_url.groupBy("site_run_id", F.pmod(F.xxhash64("url"), F.lit(PARTS)).cast("int").alias("part")).agg(
        F.count_if("found").alias("total_pages"), F.count_if("done").alias("completed_pages"), F.bool_or("started").alias("started"), F.bool_or("finished").alias("finished"), last.alias("x")
    ).select("site_run_id", "part", "total_pages", "completed_pages", "started", "finished", F.col("x.seq").alias("last_seq"), "x.kind", "x.url")

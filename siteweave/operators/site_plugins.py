"""Site plugins that add up over a site's pages: a state that pages update, that merges, and that is finished to a verdict.

``AggregatePlugin`` names its state as aggregate expressions; Spark updates it where pages lie and merges it after one
shuffle. ``FoldPlugin`` is for states that expressions can't say: plain Python, updated page by page in each task, merged
in two steps. A site that holds most of all pages is updated by all tasks in either, and nothing of a site's pages is
collected.
"""

from __future__ import annotations

import pickle
from abc import abstractmethod
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteweave.operators.rules import SitePlugin
from siteweave.operators.site_rules import result

#: States of a site that are merged at a time, and sites that a task holds.
FAN, HELD = 64, 1 << 16


class AggregatePlugin(SitePlugin):
    """A rule by aggregates over the site's parsed pages (columns site, url, p, ...)."""

    @abstractmethod
    def state(self) -> dict[str, Column]:
        """Aggregate expressions over pages, by name."""

    @abstractmethod
    def finish(self) -> Column:
        """Whether a site passes, from the state's columns."""

    def names(self, passed: bool) -> Column | None:
        """What a page is listed under in a site's verdict: a column of the page, null for pages that are not listed;
        None if such a verdict lists no pages."""
        return None

    def verdicts(self, parsed: DataFrame) -> DataFrame:
        """(site, the state's columns, passed)."""
        states = parsed.groupBy("site").agg(*[c.alias(k) for k, c in self.state().items()])
        return states.withColumn("passed", self.finish())

    def check(self, nodes: DataFrame, edges: DataFrame, parsed: DataFrame) -> DataFrame:
        rule, verdicts = self.rules()[0].id, self.verdicts(parsed).select("site", "passed")
        out = None
        for passed in (True, False):
            own, named = verdicts.filter(F.col("passed") == passed), self.names(passed)
            if named is None:
                rows = result(own, rule, F.lit(passed), "Empty", F.lit(None), F.lit(None).cast("string"))
            else:
                listed = parsed.select("site", "url", named.cast("string").alias("_key")).filter("_key IS NOT NULL").join(own.select("site"), "site")
                rows = result(listed, rule, F.lit(passed), "Values", F.col("_key"), F.col("url"))
            out = rows if out is None else out.unionByName(rows)
        return out


class FoldPlugin(SitePlugin):
    """A rule by a state in Python. ``columns`` are expressions over pages, by name; a page comes as a dict of them."""

    columns: dict[str, str] = {}

    @abstractmethod
    def zero(self) -> object: ...

    @abstractmethod
    def update(self, state, page: dict) -> object: ...

    @abstractmethod
    def merge(self, left, right) -> object: ...

    @abstractmethod
    def finish(self, state) -> bool: ...

    def states(self, parsed: DataFrame) -> DataFrame:
        """(site, state): the merged state of each site, pickled."""
        update, zero, merge, names = self.update, self.zero, self.merge, list(self.columns)

        def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[str, object] = {}
            part = TaskContext.get().partitionId() // FAN

            def flush() -> pa.RecordBatch:
                out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([part] * len(held), pa.int64()), pa.array([pickle.dumps(s) for s in held.values()], pa.binary())], ["site", "part", "state"])
                held.clear()
                return out

            for batch in batches:
                sites, pages = batch.column(0).to_pylist(), batch.select(names).to_pylist()
                for site, page in zip(sites, pages, strict=True):
                    held[site] = update(held[site] if site in held else zero(), page)
                if len(held) >= HELD:
                    yield flush()
            yield flush()

        def merged(keys: list[str]):
            def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                state, key = None, None
                for batch in rows:
                    for at, raw in enumerate(batch.column(batch.schema.get_field_index("state")).to_pylist()):
                        own = pickle.loads(raw)
                        state = own if key is None else merge(state, own)
                        key = key or [batch.column(batch.schema.get_field_index(k)).slice(at, 1) for k in keys]
                if key is not None:
                    yield pa.RecordBatch.from_arrays([*key, pa.array([pickle.dumps(state)], pa.binary())], [*keys, "state"])

            return run

        pages = parsed.select("site", *[F.expr(e).alias(k) for k, e in self.columns.items()])
        first = pages.mapInArrow(local, "site string, part long, state binary")
        second = first.groupBy("site", "part").applyInArrow(merged(["site", "part"]), "site string, part long, state binary")
        return second.groupBy("site").applyInArrow(merged(["site"]), "site string, state binary")

    def verdicts(self, parsed: DataFrame) -> DataFrame:
        """(site, passed)."""
        finish = self.finish

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([bool(finish(pickle.loads(s))) for s in batch.column(1).to_pylist()], pa.bool_())], ["site", "passed"])

        return self.states(parsed).mapInArrow(run, "site string, passed boolean")

    def check(self, nodes: DataFrame, edges: DataFrame, parsed: DataFrame) -> DataFrame:
        return result(self.verdicts(parsed), self.rules()[0].id, F.col("passed"), "Empty", F.lit(None), F.lit(None).cast("string"))

"""The result store: Parquet tables with keyed upserts, dealt over partitions by run.

A write adds one folder of rows to the partitions that it touches and is there once its commit is (``ledger``); nothing
else is written. Readers bring the folders of a partition together by key: a page's first link type and a rule's last
verdict hold. When FEW folders of a level have come together in a partition, they are merged into one of the next level,
so that a row is rewritten as often as the logarithm of the number of batches. Folders that no commit of late names any
more are deleted by ``expire``.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from siteweave.operators.ledger import Conflict, Ledger, State
from siteweave.operators.migrations import MIGRATIONS, Migration, from_stored, stored_schema, tables_after, to_stored
from siteweave.operators.rounds import Files, shared_folder
from siteweave.schema import RUN_STATUSES

#: Folders of one level that are merged.
FEW = 8
#: By table: its key, whether the last row of a key holds or the first, and the column that deals it over partitions.
KEYS = {
    "site": (["id"], True, None), "site_run": (["id"], True, None), "plugin_rule": (["id"], True, None),
    "site_page": (["site_run_id", "url"], False, "site_run_id"), "page_rule_result": (["site_run_id", "url", "rule_id"], True, "site_run_id"),
    "category_count": (["site_run_id", "category", "batch"], True, "site_run_id"), "link_count": (["site_run_id", "db_link_type", "batch"], True, "site_run_id"),
    "run_progress": (["site_run_id", "part"], True, "site_run_id"),
}


def upsert(rows: DataFrame, keys: list[str], seq: str, *, last: bool) -> DataFrame:
    """One row for each key: the first or the last by ``seq``. Rows of a key are cut down before they meet."""
    kept = F.struct(*[c for c in rows.columns if c not in keys])
    best = F.max_by(kept, seq) if last else F.min_by(kept, seq)
    return rows.groupBy(*keys).agg(best.alias("x")).select(*keys, "x.*")


def numbered(rows: DataFrame, order: Column, *, first: int = 1, column: str = "id") -> DataFrame:
    """``rows`` with whole numbers from ``first`` on in ``order``, without gaps.

    Rows are dealt over tasks by ranges of ``order`` and sorted in them; tasks count what they have, and each begins where
    those before it end. Only the counts, one for each task, go to the driver.
    """
    shared_folder(rows.sparkSession)
    place = F.monotonically_increasing_id()
    dealt = rows.repartitionByRange(order).sortWithinPartitions(order).checkpoint(eager=True).withColumn("_place", place)
    task = F.shiftright("_place", 33)
    starts, at = [], first
    for number, count in sorted(map(tuple, dealt.groupBy(task.alias("t")).count().collect())):
        starts.append((number, at))
        at += count
    begin = rows.sparkSession.createDataFrame(starts, "_task long, _start long")
    return dealt.join(F.broadcast(begin), task == F.col("_task")).withColumn(column, F.col("_start") + F.col("_place").bitwiseAND((1 << 33) - 1)).drop("_place", "_task", "_start")


def append_keyed(existing: DataFrame, incoming: DataFrame, key: str, order: Column) -> DataFrame:
    """``existing`` (id, key) with an id for each new key of ``incoming``, numbered on in ``order`` without gaps."""
    fresh = incoming.select(key).distinct().join(existing.select(key), key, "left_anti")
    top = existing.agg(F.max("id")).first()[0] or 0
    return existing.select("id", key).unionByName(numbered(fresh, order, first=top + 1).select(F.col("id").cast("int").alias("id"), key))


def site_rule_rows(results: DataFrame) -> DataFrame:
    """(url, rule_id, passed) from (rule_id, passed, kind, urls, values): one row for each URL, none for an empty context."""
    urls = F.when(F.col("kind") == "Urls", F.col("urls")).when(F.col("kind") == "Values", F.flatten(F.map_values("values")))
    return results.select(F.explode(urls).alias("url"), "rule_id", "passed")


def broken_references(child: DataFrame, column: str, parent: DataFrame) -> DataFrame:
    """Rows whose key the parent table lacks."""
    return child.join(parent.select(F.col("id").alias(column)), column, "left_anti")


def folder_of() -> Column:
    """The folder that a stored row was read from: names rise from commit to commit."""
    return F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/p=[^/]*/[^/]*$", 1)


def page_key() -> Column:
    """The stored id of a page of a run: the same wherever it is computed, so pages need no numbering."""
    return F.xxhash64("site_run_id", "url")


class ResultStore:
    """Tables under one folder. ``migrations`` are the steps that make them."""

    def __init__(self, spark: SparkSession, path: str, *, migrations: list[Migration] | None = None) -> None:
        self.spark, self.path, self.files = spark, path.rstrip("/"), Files(spark)
        self.ledger, self.migrations = Ledger(spark, self.path), migrations or MIGRATIONS

    @classmethod
    @contextmanager
    def ephemeral(cls, spark: SparkSession, **given) -> Iterator[ResultStore]:
        """A migrated store of its own in the shared folder, deleted at the end."""
        store = cls(spark, f"{shared_folder(spark)}/ephemeral-{uuid.uuid4().hex[:12]}", **given)
        try:
            store.migrate()
            yield store
        finally:
            store.files.delete(store.path)

    # migrations

    def up(self, steps: int | None = None) -> None:
        """Makes the next steps, or all that are left. Nothing is changed if one of them can't be made."""
        base = self.ledger.state()
        goal = min(len(self.migrations), base.migrations + (len(self.migrations) if steps is None else steps))
        tables_after(self.migrations, goal)
        if goal != base.migrations:
            self.ledger.commit({"migrations": goal}, base)

    def down(self, steps: int = 1) -> None:
        """Takes the last steps back. Rows of tables and columns that go are hidden, and there again after ``up``."""
        base = self.ledger.state()
        self.ledger.commit({"migrations": max(0, base.migrations - steps)}, base)

    def migrate(self) -> None:
        """Makes all steps that are left; if one fails, everything is dropped and made anew, as far as it can be."""
        try:
            self.up()
        except ValueError:
            base = self.ledger.state()
            gone = {t: {p: [[e[0] for e in held], []] for p, held in parts.items()} for t, parts in base.tables.items()}
            self.ledger.commit({"replace": gone, "migrations": self._goal()}, base)

    def applied(self) -> list[str]:
        """Names of the steps that hold."""
        return [m.name for m in self.migrations[: self.ledger.state().migrations]]

    def reset(self) -> None:
        """Empties all tables."""
        base = self.ledger.state()
        self.ledger.commit({"replace": {t: {p: [[e[0] for e in held], []] for p, held in parts.items()} for t, parts in base.tables.items()}}, base)

    # rows

    def _goal(self) -> int:
        """How many steps can be made."""
        goal = len(self.migrations)
        while goal:
            try:
                tables_after(self.migrations, goal)
                break
            except ValueError:
                goal -= 1
        return goal

    def _fields(self, table: str, state: State):
        found = tables_after(self.migrations, state.migrations)
        if table not in found:
            raise AnalysisException(f"there is no table {table} yet")
        return found[table]

    def _merged(self, table: str, state: State, parts: dict[str, list[list]]) -> DataFrame:
        """Rows of the named folders of partitions, one for each key."""
        fields, (keys, last, _) = self._fields(table, state), KEYS[table]
        schema, top = stored_schema(fields), f"{self.path}/{table}"
        single = [f"{top}/{held[0][0]}/p={p}" for p, held in parts.items() if len(held) == 1]
        several = [f"{top}/{e[0]}/p={p}" for p, held in parts.items() if len(held) > 1 for e in held]
        out = self.spark.read.schema(schema).parquet(*single) if single else self.spark.createDataFrame([], schema)
        if several:
            stored = {f.name: f.stored for f in fields}
            rows = self.spark.read.schema(schema).parquet(*several).withColumn("_folder", folder_of())
            out = out.unionByName(upsert(rows, [stored[k] for k in keys], "_folder", last=last).drop("_folder"))
        return out.select(*from_stored(out, fields))

    def read(self, table: str, runs: list[int] | None = None, *, state: State | None = None) -> DataFrame:
        """A table, or what it has of some runs: only their partitions are read. ``state`` is one to look back to."""
        state = state or self.ledger.state()
        parts = state.tables.get(table, {})
        return self._merged(table, state, parts if runs is None else {p: e for p, e in parts.items() if p in set(map(str, runs))})

    def _put(self, table: str, rows: DataFrame, state: State, name: str) -> dict[str, list[list]]:
        """Writes rows to a folder that no reader sees yet; what a commit adds."""
        fields, by = self._fields(table, state), KEYS[table][2]
        return self._write(table, to_stored(rows, fields), next((f.stored for f in fields if f.name == by), None), name)

    def _write(self, table: str, stored: DataFrame, by: str | None, name: str) -> dict[str, list[list]]:
        path = f"{self.path}/{table}/{name}"
        # Spark deals partitions over tasks by their size: a large run over several, many small ones to one.
        stored.withColumn("p", F.lit(0) if by is None else F.col(f"`{by}`")).hint("rebalance", "p").write.partitionBy("p").parquet(path)
        return {n[2:]: [[name, 0]] for n in self.files.names(path) if n.startswith("p=")}

    def add(self, tables: dict[str, DataFrame], *, batch: tuple[str, int] | None = None, alone: list[tuple[str, str]] | None = None, base: State | None = None) -> bool:
        """Adds rows to tables in one commit. A ``batch`` (name, number) that is there already changes nothing: False."""
        base = base or self.ledger.state()
        if batch and base.batches.get(batch[0], -1) >= batch[1]:
            return False
        name = f"{base.version + 1:010d}-{uuid.uuid4().hex[:12]}"
        added = {t: self._put(t, rows, base, name) for t, rows in tables.items()}
        change = {"add": added} | ({"batches": {batch[0]: batch[1]}} if batch else {})
        state = self.ledger.commit(change, base, alone=alone)
        for t, parts in added.items():
            self._tidy(t, parts, state)
        return True

    def _tidy(self, table: str, touched: dict, state: State) -> None:
        """Merges the last folders of touched partitions where FEW of them have one level."""
        due = {}
        for p in touched:
            held = state.tables.get(table, {}).get(p, [])
            tail = [e for e in held[-FEW:] if e[1] == held[-1][1]]
            if len(tail) == FEW:
                due[p] = held[-FEW:]
        if not due:
            return
        level = max(e[1] for held in due.values() for e in held) + 1
        name = f"{max(held[-1][0] for held in due.values())}.m{uuid.uuid4().hex[:6]}"
        keys, last, by = KEYS[table]
        stored = {f.name: f.stored for f in self._fields(table, state)}
        paths = [f"{self.path}/{table}/{e[0]}/p={p}" for p, held in due.items() for e in held]
        # Columns as the files have them: also those that are hidden now, or that a later program added.
        rows = self.spark.read.option("mergeSchema", "true").parquet(*paths).withColumn("_folder", folder_of())
        merged = self._write(table, upsert(rows, [stored[k] for k in keys], "_folder", last=last).drop("_folder"), stored[by] if by else None, name)
        change = {p: [[e[0] for e in held], [[name, level]] if p in merged else []] for p, held in due.items()}
        try:
            after = self.ledger.commit({"replace": {table: change}}, state)
        except Conflict:  # another writer has merged them
            return
        self._tidy(table, due, after)

    def expire(self, *, older_than: float = 86_400.0) -> int:
        """Deletes folders that the state does not name and that are older than so many seconds; how many."""
        state, gone, now = self.ledger.state(), 0, time.time()
        for t in self.files.names(self.path):
            if t.startswith("_"):
                continue
            held = {e[0] for parts in [state.tables.get(t, {})] for entries in parts.values() for e in entries}
            for name in self.files.names(f"{self.path}/{t}"):
                path = self.files.path(f"{self.path}/{t}/{name}")
                made = path.getFileSystem(self.files.conf).getFileStatus(path).getModificationTime() / 1000
                if name not in held and now - made >= older_than:
                    self.files.delete(f"{self.path}/{t}/{name}")
                    gone += 1
        return gone

    def bytes(self) -> int:
        """Bytes of all folders of rows, those included that nothing names any more."""
        return sum(self.files.size(f"{self.path}/{t}") for t in self.files.names(self.path) if not t.startswith("_"))

    def again(self, work: Callable[[State], object]):
        """Does small work over until no other writer gets in between."""
        while True:
            try:
                return work(self.ledger.state())
            except Conflict:
                continue

    # what the audit stores

    def seed_rules(self, dimension: DataFrame) -> None:
        """Inserts rules or renews them; ``enabled`` stays as it was."""
        old = self.read("plugin_rule").select("id", F.col("enabled").alias("was"), F.col("created_at").alias("made"))
        fresh = dimension.join(old, "id", "left").withColumns({"enabled": F.coalesce("was", "enabled"), "created_at": F.coalesce("made", F.current_timestamp()), "updated_at": F.current_timestamp()}).drop("was", "made")
        self.add({"plugin_rule": fresh})

    def upsert_site(self, url: str) -> int:
        def work(state: State) -> int:
            sites = self.read("site", state=state)
            row = sites.filter(F.col("url") == url).select("id").first()
            if row:
                return row[0]
            number = (sites.agg(F.max("id")).first()[0] or 0) + 1
            self.add({"site": self.spark.range(1).select(F.lit(number).alias("id"), F.lit("").alias("name"), F.lit(url).alias("url"), F.current_timestamp().alias("created_at"))}, alone=[("site", "0")], base=state)
            return number

        return self.again(work)

    def create_run(self, url: str) -> int:
        site = self.upsert_site(url)

        def work(state: State) -> int:
            number = (self.read("site_run", state=state).agg(F.max("id")).first()[0] or 0) + 1
            self.add({"site_run": self.spark.range(1).select(F.lit(number).alias("id"), F.lit(site).alias("site_id"), F.current_timestamp().alias("created_at"), F.lit("Pending").alias("status"))}, alone=[("site_run", "0")], base=state)
            return number

        return self.again(work)

    def status(self, run: int) -> str:
        row = self.read("site_run").filter(F.col("id") == run).select("status").first()
        if not row:
            raise KeyError(f"no run {run}")
        return row[0]

    def set_status(self, run: int, status: str) -> None:
        if status not in RUN_STATUSES:
            raise ValueError(f"no such status: {status}")
        own = self.read("site_run").filter(F.col("id") == run)
        if own.isEmpty():
            raise KeyError(f"no run {run}")
        self.add({"site_run": own.withColumn("status", F.lit(status))})

    def _runs(self) -> DataFrame:
        return self.read("site_run").select(F.col("id").alias("site_run_id"), "site_id")

    def page_rows(self, pages: DataFrame) -> DataFrame:
        """Rows of site_page from (site_run_id, url, link_type[, seq]); of equal pages the first by seq."""
        seq = F.col("seq").cast("long") if "seq" in pages.columns else F.lit(0).cast("long")
        first = upsert(pages.select("site_run_id", "url", F.col("link_type").alias("db_link_type"), seq.alias("seq")), ["site_run_id", "url"], "seq", last=False).drop("seq")
        return first.join(self._runs(), "site_run_id", "left").withColumns({"id": page_key(), "created_at": F.current_timestamp()})

    def result_rows(self, results: DataFrame) -> DataFrame:
        """Rows of page_rule_result from (site_run_id, url, rule_id, passed[, seq]); of equal ones the last by seq."""
        seq = F.col("seq").cast("long") if "seq" in results.columns else F.lit(0).cast("long")
        last = upsert(results.select("site_run_id", "url", "rule_id", "passed", seq.alias("seq")), ["site_run_id", "url", "rule_id"], "seq", last=True).drop("seq")
        return last.withColumns({"id": F.xxhash64("site_run_id", "url", "rule_id"), "site_page_id": page_key(), "created_at": F.current_timestamp()})

    def add_pages(self, run: int, pages: DataFrame) -> None:
        """``pages``: url, link_type[, seq]. A page's first link type stays."""
        self.add({"site_page": self.page_rows(pages.withColumn("site_run_id", F.lit(run)))})

    def add_results(self, run: int, results: DataFrame) -> None:
        """``results``: url, rule_id, passed[, seq]. The last verdict of a page and rule stays."""
        self.add({"page_rule_result": self.result_rows(results.withColumn("site_run_id", F.lit(run)))})

    def save_crawl(self, run: int, found) -> None:
        """Site rules first, then pages, all in one commit; the run is finished only after that."""
        site_rows = found.site_results.filter("url IS NOT NULL").select("url", "rule_id", "passed", F.lit(0).alias("seq"))
        pages = found.nodes.select(F.lit(run).alias("site_run_id"), "url", "link_type")
        results = site_rows.unionByName(found.results.withColumn("seq", F.lit(1))).withColumn("site_run_id", F.lit(run))
        self.add({"site_page": self.page_rows(pages), "page_rule_result": self.result_rows(results)})
        self.set_status(run, "Finished")

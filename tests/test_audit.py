import http.server
import threading

import pytest
from pyspark.sql import functions as F

from siteweave.audit import audit, base_url
from siteweave.operators import reports
from siteweave.operators.graph import snapshot_fetch
from siteweave.operators.rules import Registry
from siteweave.operators.store import ResultStore, broken_references
from siteweave.sources.settings import CrawlSettings
from siteweave.streaming import events as streams
from siteweave.streaming import progress


def serve(pages):
    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            body = pages.get(self.path)
            self.send_response(404 if body is None else 200)
            self.end_headers()
            self.wfile.write((body or "").replace("TOP", f"http://127.0.0.1:{self.server.server_port}").encode())

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    return server


def test_base_url():
    assert base_url("h.example") == "https://h.example/" and base_url("http://h.example/a") == "http://h.example/a"
    with pytest.raises(ValueError):
        base_url("")


@pytest.mark.parametrize("named", [True, False])
def test_audit_over_http(spark, tmp_path, named):
    link = "<link rel='sitemap' href='/maps.xml'>" if named else ""
    index = "<sitemapindex><sitemap><loc>TOP/child.xml</loc></sitemap></sitemapindex>"
    pages = {"/": f"<html lang=en><head>{link}<title>Home</title></head><a href='/a'>a</a></html>", "/a": "<title>A</title><a href='/gone'>x</a>", "/lone": "<title>L</title>", "/maps.xml" if named else "/sitemap.xml": index, "/child.xml": "<urlset><url><loc>TOP/lone</loc></url></urlset>"}
    server, told = serve(pages), []
    top, store = f"http://127.0.0.1:{server.server_port}/", ResultStore(spark, str(tmp_path / "store"))
    got = audit(spark, top, store, settings=CrawlSettings(max_concurrent_requests=2, request_delay_ms=0), events=str(tmp_path / "events"), on_event=told.append)
    server.shutdown()
    assert [e["kind"] for e in told if e["kind"] != "AnalyzedPages"] == ["AnalysisStart", "SiteRunIdSet", "AnalysisFinished"] and told[1]["site_run_id"] == got.run
    assert [e["round"] for e in told if e["kind"] == "AnalyzedPages"] == [0, 1, 2][: len(told) - 3] and len(told) > 4
    stored = {r.url.removeprefix(top): r for r in store.read("site_page").collect()}
    assert {"", "a", "lone", "gone", "child.xml"} <= set(stored) and all(r.site_id == 1 and r.id is not None for r in stored.values())
    run = store.read("site_run").first()
    assert (run.id, run.status) == (got.run, "Finished")
    results = store.read("page_rule_result")
    assert broken_references(results, "site_page_id", store.read("site_page")).isEmpty()
    assert results.select("id").distinct().count() == results.count()
    verdict = {(r.url.removeprefix(top), r.rule_id): r.passed for r in results.collect()}
    assert verdict["lone", "orphaned_page.check"] is False and verdict["", "axe.html_has_lang"] and not verdict["a", "axe.html_has_lang"]
    # the events alone give the same pages, and the last one has the counts
    again = ResultStore(spark, str(tmp_path / "again"))
    again.migrate()
    again.seed_rules(Registry.default().dimension(spark))
    assert again.create_run(top) == got.run
    streams.sink(streams.read_events(spark, str(tmp_path / "events")), again, str(tmp_path / "state")).awaitTermination()
    assert {r.url for r in again.read("site_page").collect()} == {r.url for r in store.read("site_page").collect()}
    same = lambda s: {(r.url, r.rule_id, r.passed) for r in s.read("page_rule_result").collect()}
    assert same(again) == same(store)  # site rules' rows too
    counted = {(r.category, r.total, r.passed) for r in reports.kept_category_result(again.read("category_count")).collect()}
    assert counted == {(r.category, r.total, r.passed) for r in reports.category_result(results, store.read("plugin_rule")).collect()}
    assert again.read("site_run").first().status == "Finished"
    last = spark.read.parquet(str(tmp_path / "events")).orderBy(F.desc("seq")).first()
    assert (last.kind, last.total_pages, last.completed_pages) == ("AnalysisFinished", told[-1]["total_pages"], told[-1]["completed_pages"])
    parts = reports.run_progress(progress.parts_of(spark.read.parquet(str(tmp_path / "events")))).first()
    assert (parts.total_pages, parts.completed_pages, parts.finished) == (last.total_pages, last.completed_pages, True)


def test_a_failed_audit_is_marked(spark, tmp_path):
    store = ResultStore(spark, str(tmp_path / "store"))

    def broken(urls):
        raise RuntimeError("no network")

    with pytest.raises(RuntimeError):
        audit(spark, "h.example", store, fetch=broken)
    assert store.read("site_run").first().status == "Error"


def test_a_failing_events_folder_stores_nothing(spark, tmp_path):
    store, pages = ResultStore(spark, str(tmp_path / "store")), spark.createDataFrame([("https://s.example/", "<title>t</title>")], "url string, html string")
    (tmp_path / "events").write_text("a file, not a folder")
    with pytest.raises(Exception, match="events"):
        audit(spark, "https://s.example/", store, fetch=snapshot_fetch(pages), events=str(tmp_path / "events"))
    assert store.read("site_run").first().status == "Error" and store.read("page_rule_result").isEmpty() and store.read("site_page").isEmpty()


def test_rules_keep_when_they_were_made(spark, tmp_path):
    store = ResultStore(spark, str(tmp_path / "store"))
    store.migrate()
    for _ in range(2):
        store.seed_rules(Registry.default().dimension(spark))
    rows = store.read("plugin_rule").collect()
    assert len(rows) == len({r.id for r in rows}) and all(r.created_at < r.updated_at for r in rows)

import gzip
import http.server
import threading

import pytest
from pyspark.sql import functions as F

from siteweave.functions.html import parse_pages
from siteweave.functions.urls import resolve_one, resolved
from siteweave.operators.graph import crawl, cut_lineage, reachable, snapshot_fetch
from siteweave.operators.rounds import Rounds
from siteweave.operators.store import ResultStore
from siteweave.sources.fetch import http_fetch
from siteweave.sources.lighthouse import metrics
from siteweave.sources.settings import SettingsStore
from siteweave.sources.sitemap import candidates, expand, loc_urls


def page(*links):
    return "<title>t</title><meta name=description content=same>" + "".join(f"<a href='{x}'>x</a>" for x in links)


def test_resolve():
    assert resolve_one("/b c?q=é#f", "https://H.example:443/a") == "https://h.example/b%20c?q=%C3%A9#f"
    assert resolve_one("../x/./y", "http://h.example/a/b/c") == "http://h.example/a/x/y"
    assert resolve_one("https://o.example", "http://h.example") == "https://o.example/"
    assert resolve_one("httpfoo/x", "http://h.example") is None
    assert resolve_one("mailto:a@b.c", "http://h.example") == "mailto:a@b.c"
    assert resolve_one(None, "http://h.example") is None


def test_plain_links_resolve_alike(spark):
    links = ["/a", "/a/b.html", "/", "//h.example/x", "/a//b", "/./a", "/a/../b", "/a/.", "/.well-known/x", "/a b", "/é", "/a?q", "/a#f", "a/b", "../x", "http://o.example/", "httpfoo", "mailto:a@b.c", "", None, "/a%20b", "/A_~-9.x", "\\a", "/a\n/b", "/a\n"]
    bases = ["http://h.example/x/y?z#w", "https://h.example", "https://H.example/", "http://h.example:80/", "http://h.example:8080/a", "http://127.0.0.1/", "ftp://h.example/", "httpfoo/x", None, "http://u:p@h.example/", "http://h.example#f", "https://bücher.example/"]
    rows = spark.createDataFrame([(a, b) for a in links for b in bases], "link string, base string")
    for r in rows.select("link", "base", resolved(F.col("link"), F.col("base")).alias("href")).collect():
        assert r.href == resolve_one(r.link, r.base), (r.link, r.base)


def test_named_fields(spark):
    pages = spark.createDataFrame([("u", "<title>t</title><a href=x>"), ("v", None)], "url string, html string")
    found = parse_pages(pages, fields=["hrefs", "title"])
    assert found.schema["p"].dataType.names == ["hrefs", "title"] and [r.p and tuple(r.p) for r in found.orderBy("url").collect()] == [(["x"], "t"), None]


def test_crawl(spark):
    top = "https://s.example"
    html = {"/": page("/page1", "/page2?x=1", "mailto:a@b.c", "https://o.example/"), "/page1": page("/page5"), "/page2": page("/page1"), "/page5": page("/page6"), "/page6": page("/", "httpfoo/x"), "/page3": page()}
    rows = spark.createDataFrame([(i, top + k, v) for i, (k, v) in enumerate(html.items())], "page_id long, url string, html string")
    sitemap = spark.createDataFrame([(f"{top}/page3",), (f"{top}/page1",), (f"{top}/gone",)], "url string")
    got = crawl(spark, top + "/", sitemap, snapshot_fetch(rows))
    nodes = {r.url: r for r in got.nodes.collect()}
    assert {u for u, r in nodes.items() if r.link_type == "Internal"} == {top + k for k in [*html, "/gone"]}
    assert nodes[f"{top}/gone"].error and nodes["https://o.example/"].link_type == "External" and nodes["mailto:a@b.c"].link_type == "Mailto"
    found = {r.url: {s.source_type for s in r.found_in} for r in got.found_in().collect()}
    assert found[f"{top}/page1"] == {"Sitemap", "Link"} and found[f"{top}/page3"] == {"Sitemap", "Link"}  # an orphan gains a link
    site = {(r.rule_id, r.passed, r.url) for r in got.site_results.collect()}
    assert ("meta_description_uniqueness", False, None) in site and ("orphaned_page.check", False, f"{top}/page3") in site
    assert got.quarantine.count() == 1 and got.results.filter(F.col("url") == f"{top}/gone").isEmpty()
    progress = got.progress().first()
    assert (progress.total_pages, progress.completed_pages) == (7, 7)


def test_store(spark, tmp_path):
    store = ResultStore(spark, str(tmp_path / "store"))
    store.migrate()
    store.migrate()
    run = store.create_run("https://a.example/")
    assert store.create_run("https://a.example/") == run + 1 and store.upsert_site("https://a.example/") == 1
    pages = spark.createDataFrame([("u", "Internal", 0), ("u", "External", 1)], "url string, link_type string, seq long")
    results = spark.createDataFrame([("u", "r", True, 0), ("u", "r", False, 1)], "url string, rule_id string, passed boolean, seq long")
    for _ in range(2):
        store.add_pages(run, pages)
        store.add_results(run, results)
    assert [r.db_link_type for r in store.read("site_page").collect()] == ["Internal"]
    assert [r.passed for r in store.read("page_rule_result").collect()] == [False]
    store.set_status(run, "Running")
    assert store.read("site_run").filter("id = 1").first().status == "Running"
    store.reset()
    assert store.read("site").isEmpty()


def test_reachable_on_a_cycle(spark):
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 0), (5, 6)], "src long, dst long")
    assert {(r.node, r.round) for r in reachable(edges, spark.createDataFrame([(0,)], "node long")).collect()} == {(0, 0), (1, 1), (2, 2)}


BODIES = {
    "<a><b>": [], "<u xmlns:i='x'><url><i:loc> y</i:loc></url></u>": [" y"], "<urlset><loc>p</loc></urlset>": ["p"], "": [], "not xml": [], "<urlset/>trailing": [], "<urlset/><b/>": [], "<a>&nope;</a>": [],
    "<a>&amp;<loc>x&amp;y</loc><loc><![CDATA[c&d]]></loc></a>": ["x&y", "c&d"], "<?xml version='1.0'?>\n<a><loc>z</loc></a><!-- ok -->\n": ["z"], "<a b=c><loc>1</loc></a>": [], "<loc>x</loc>": ["x"], "\ufeff<a><loc>bom</loc></a>": ["bom"],
    "<!DOCTYPE a [<!ENTITY e 'q'>]><a><loc>&e;</loc></a>": [], "<a><loc>x<b>y</b>z</loc><loc><b/>n</loc></a>": ["x"], "<a><loc/><loc></loc></a>": [], "<a>\x01<loc>c</loc></a>": [], "<a><loc>1</loc><!-- -- --></a>": [],
    "<a/></siteweave-guard><siteweave-guard>": [], "<a><siteweave-guard><loc>1</loc></siteweave-guard></a>": [], " \n<?xml version='1.0'?><a/>": [], "<a><loc>1</loc></a>&": [], "<a><loc>1</loc></a></b>": [],
}


def test_locations(spark):
    rows = spark.createDataFrame([(i, b) for i, b in enumerate([*BODIES, None])], "i int, body string")
    got = {r.i: r.urls for r in rows.select("i", loc_urls(F.col("body")).alias("urls")).collect()}
    assert {b: got[i] for i, b in enumerate(BODIES)} == BODIES and got[len(BODIES)] is None


def test_sitemap(spark, tmp_path):
    docs = {"s": "<sitemapindex><loc>t</loc><loc>s</loc><loc>gone</loc><loc>broken</loc></sitemapindex>", "t": "<urlset><loc>p</loc></urlset>", "broken": "<sitemapindex><loc>never</loc>"}
    table = spark.createDataFrame([("h", k, v) for k, v in docs.items()], "site string, url string, body string")
    rounds = Rounds(spark, str(tmp_path / "maps"))
    out = expand(table.filter("url = 's'"), lambda f: f.join(table, ["site", "url"], "left"), rounds=rounds)
    assert {r.url for r in out.collect()} == {"s", "t", "p", "gone", "broken"}
    assert rounds.all("seen").groupBy("url").count().filter("count > 1").isEmpty()
    sites = spark.createDataFrame([("https://h.example/", None), ("https://g.example/", "/m.xml")], "site string, sitemap string")
    assert candidates(sites).count() == 5
    assert expand(table.limit(0), lambda f: f.join(table, ["site", "url"], "left")).isEmpty()


def chain(spark, n, width):
    """A site whose pages stand in rows of ``width``, each linking to the next row's."""
    rows = [(f"https://c.example/{i}", "x" * 500 + "".join(f"<a href='/{j}'>n</a>" for j in range((i // width + 1) * width, (i // width + 2) * width) if j < n)) for i in range(n)]
    return snapshot_fetch(spark.createDataFrame(rows, "url string, html string"))


def test_bytes_grow_with_pages_not_with_rounds(spark, tmp_path):
    none, sizes = spark.createDataFrame([], "url string"), {}
    for name, n, width in (("short", 8, 4), ("long", 8, 1)):
        seeds = none if width == 1 else spark.createDataFrame([(f"https://c.example/{i}",) for i in range(width)], "url string")
        found = crawl(spark, "https://c.example/0", seeds, chain(spark, n, width), folder=str(tmp_path / name))
        assert found.nodes.count() == n
        rounds = found.rounds
        sizes[name] = {t: rounds.all(t).count() for t in ("pages", "seen", "results")}
        assert len(rounds.files.names(f"{rounds.folder}/pages")) == n // width
    assert sizes["short"] == sizes["long"]  # a page is written once, in whichever round


def test_a_crawl_goes_on_where_it_died(spark, tmp_path):
    none, asked = spark.createDataFrame([], "url string"), []
    fetch = chain(spark, 5, 1)

    def failing(limit):
        def run(urls):
            asked.append([r.url for r in urls.collect()])
            if len([a for a in asked if a]) > limit:
                raise RuntimeError("lost")
            return fetch(urls)

        return run

    with pytest.raises(RuntimeError):
        crawl(spark, "https://c.example/0", none, failing(2), folder=str(tmp_path / "c"))
    turns = []
    again = crawl(spark, "https://c.example/0", none, fetch, folder=str(tmp_path / "c"), on_round=lambda r: turns.append((r.number, r.pages.count())))
    assert again.nodes.count() == 5 and turns == [(i, 1) for i in range(5)] and again.results.select("url").distinct().count() == 5
    again.rounds.drop()
    assert not (tmp_path / "c").exists()


def test_fetch_and_settings(spark, tmp_path):
    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            body = {"/z": gzip.compress(b"zipped"), "/bad": gzip.compress(b"zipped" * 50)[:20]}.get(self.path, b"ok")
            self.send_response({"/r": 301, "/x": 404}.get(self.path, 200))
            if self.path == "/r":
                self.send_header("Location", "/")
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    top = f"http://127.0.0.1:{server.server_port}"
    rows = {r.url: r for r in http_fetch(concurrency=2)(spark.createDataFrame([(top + p,) for p in ("/", "/r", "/x", "/z", "/bad")], "url string")).collect()}
    server.shutdown()
    assert rows[top + "/"].html == "ok" and rows[top + "/r"].status_code == 301 and rows[top + "/x"].error
    assert rows[top + "/z"].html == "zipped" and rows[top + "/bad"].error
    store = SettingsStore(str(tmp_path / "s.json"))
    assert store.get() is None and store.update(request_delay_ms=5).request_delay_ms == 5 and store.get().max_concurrent_requests == 10
    report = spark.createDataFrame([('{"categories":{"seo":{"score":0.5}},"audits":{"interactive":{"numericValue":3.5}}}',)], "json string")
    row = metrics(report).first()
    assert (row.seo_score, row.time_to_interactive, row.pwa_score) == (50.0, 3.5, 0.0)


def test_a_crawl_without_pages(spark):
    none = spark.createDataFrame([], "url string")
    pages = spark.createDataFrame([("https://s.example/", page("/a"))], "url string, html string")
    for base, rounds in (("https://s.example/", 0), ("httpfoo/x", None)):
        found = crawl(spark, base, none, snapshot_fetch(pages), max_rounds=rounds)
        assert found.results.isEmpty() and found.nodes.count() == (1 if rounds == 0 else 0)


def test_no_site_rule_gives_no_row(spark):
    from siteweave.operators.rules import Registry, RuleConfig

    pages = spark.createDataFrame([("https://s.example/", page("/a"))], "url string, html string")
    found = crawl(spark, "https://s.example/", spark.createDataFrame([], "url string"), snapshot_fetch(pages), registry=Registry.default(RuleConfig({"title.has_title": True})))
    assert found.site_results.isEmpty() and not found.results.isEmpty()

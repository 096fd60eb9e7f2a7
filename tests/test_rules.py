"""One passing and one failing page for every rule, and the parser's odd cases."""

import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import types as T

from siteweave.functions import html
from siteweave.functions.html import parse, parse_pages
from siteweave.operators.rules import Axe, Registry, RuleConfig, Title

GOOD = """<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>Fine title</title><link rel="canonical" href="https://a.example/x">
<meta name="description" content="About"><meta name="viewport" content="width=device-width"></head><body><img src="i" alt="" srcset="i 2x"><button>Go</button>
<a href="/y">Y</a><iframe title="t"></iframe><div id="a" role="tab" aria-selected="true" tabindex="0"></div></body></html>"""
BAD = {
    "images.responsive": ("srcset=", "data-x="),
    "seo_basic.has_canonical_url": ('rel="canonical"', 'rel="Canonical"'),
    "seo_basic.canonical_url_matches_site": ("https://a.example/x", "/x"),
    "seo_basic.is_scrapeable": ("<meta charset", '<meta name="robots" content="noindex"><meta charset'),
    "seo_basic.has_valid_charset": ("<meta charset", "<meta data-charset"),
    "seo_basic.has_html_doctype": ("<!DOCTYPE", "<!doctype"),
    "title.has_title": ("<title>Fine title</title>", ""),
    "title.title_length": ("Fine title", "é" * 30),
    "meta_description.has_meta_description": ('content="About"', ""),
    "meta_description.description_length": ("About", "é" * 78),
    "axe.html_has_lang": (' lang="en"', ""),
    "axe.image_alt": (' alt=""', ""),
    "axe.meta_viewport": ("width=device-width", "maximum-scale=10"),
    "axe.document_title": ("<title>Fine title</title>", ""),
    "axe.button_name": ("Go", " \n"),
    "axe.link_name": (">Y</a>", "><img alt='Y'></a>"),
    "axe.form_field_labels": ("<button>", '<label for="f"></label><input id="f"><button>'),
    "axe.aria_valid_attr": ('id="a"', "aria-"),
    "axe.aria_required_attr": (' aria-selected="true"', ""),
    "axe.duplicate_id": ("<button>", '<button id="a">'),
    "axe.frame_title": ('<iframe title="t">', "<iframe>"),
    "axe.tabindex": ('tabindex="0"', 'tabindex="+5"'),
}


def test_every_rule_alone(spark):
    rows = [("good", GOOD, 200), ("request.redirects", GOOD, 301)]
    for rule, (old, new) in BAD.items():
        assert old in GOOD, rule
        rows.append((rule, GOOD.replace(old, new), None))
    pages = spark.createDataFrame([(k, "https://a.example/x", h, s) for k, h, s in rows], "k string, url string, html string, status_code int")
    found = Registry.default().analyze(parse_pages(pages), messages=True).toPandas()
    assert found[(found.k == "good") & ~found.passed].empty
    for rule in [*BAD, "request.redirects"]:
        own = found[(found.k == rule) & (found.rule_id == rule)]
        assert len(own) == 1 and not own.passed.iloc[0], rule


@pytest.mark.parametrize(("value", "passed"), [("+5", False), (" 5 ", True), ("5.5", True), ("99999999999", True), ("-1", True), ("x", True)])
def test_tabindex(spark, value, passed):
    pages = spark.createDataFrame([("u", f'<p tabindex="{value}">')], "url string, html string")
    row = Registry.default(RuleConfig({"axe.tabindex": True})).analyze(parse_pages(pages)).first()
    assert row.passed is passed


def test_parser():
    p = parse('<title>A &am B&amp</title><meta name=description content=a><meta name=description><meta property="og:og:title" content=x><noscript><img src=n></noscript><h2>b<i>c</i></h2><h1>a</h1>')
    assert p["title"] == "A &amp;am B&amp;" and p["description"] is None and dict(p["og_tags"]) == {"title": "x"}
    assert p["images"] == [] and [(h["tag"], h["text"]) for h in p["headings"]] == [("h1", "a"), ("h2", "b<i>c</i>")]
    assert parse(None) is None and parse("")["title"] is None


def test_registry(spark):
    registry = Registry.default()
    ids = [r.id for r in registry.rules()]
    assert len(ids) == len(set(ids)) == 25
    assert registry.dimension(spark).filter("category = 'SEO'").count() == 12
    registry.register(Axe(strict=False))
    assert len(registry.rules()) == 25
    with pytest.raises(ValueError):
        Registry().analyze(parse_pages(spark.createDataFrame([("u", "")], "url string, html string")))
    assert not RuleConfig().is_enabled("title.has_title")


def test_source_of_titles_and_headings():
    """What the SQL of titles and headings reads: the page's own characters, references as they are written."""
    p = parse('<!DOCTYPE html>\n<title>A &am "B&quot; &amp</title>\n<p>x\r\n<h2 class="&lt;">b\n<i>&c</i>&amp;<h1>the&am</h1>\n<h3>end &lt')
    assert (p["title"], p["title_source"]) == ('A &amp;am "B" &amp;', 'A &am "B&quot; &amp')
    assert [(h["tag"], h["text"], h["source"]) for h in p["headings"]] == [("h1", "the&amp;am", "the&am"), ("h2", "b\n<i>&amp;c</i>&amp;", "b\n<i>&c</i>&amp;"), ("h3", "end &lt;", "end &lt")]


@pytest.mark.parametrize(("source", "passed"), [(True, False), (False, True)])
def test_title_length_of_references(spark, source, passed):
    pages = spark.createDataFrame([("u", "<title>" + "&quot;" * 10 + "</title>")], "url string, html string")
    registry = Registry.default(RuleConfig({"title.title_length": True}))
    registry.register(Title(source=source))
    assert registry.analyze(parse_pages(pages)).first().passed is passed


def test_pages_are_parsed_a_bounded_part_at_a_time(monkeypatch):
    """What a task holds does not grow with the pages of a batch; rows stay whole and in order."""

    class Pages:
        columns, schema = ["html"], T.StructType().add("html", "string")
        drop = lambda self, *names: self
        mapInArrow = lambda self, run, schema: run

    def peak(held: int) -> tuple[int, list]:
        monkeypatch.setattr(html, "HELD", held)
        tracemalloc.start()
        sizes = [(len(b), b.column("html").to_pylist(), [p and len(p["hrefs"]) for p in b.column("p").to_pylist()]) for b in parse_pages(Pages())(iter([batch]))]
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return most, sizes

    texts = [None if k == 3 else "" if k == 4 else "<a href=x>y</a>" * (20_000 if k == 7 else 20) for k in range(1200)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["html"])
    (one,), parts = peak(1 << 40)[1], peak(1 << 16)[1]
    assert len(parts) > 20 and (1, [texts[7]], [20_000]) in parts
    assert [sum(x, []) for x in list(zip(*parts, strict=True))[1:]] == [*one[1:]] and one[1] == texts
    batch = batch.slice(8)
    assert peak(1 << 16)[0] * 3 < peak(1 << 40)[0]

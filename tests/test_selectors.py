"""The elements of pages and CSS selectors over them."""

import pytest
from pyspark.sql import functions as F

from siteweave.functions.elements import node_table, tree, with_elements
from siteweave.functions.html import parse_pages
from siteweave.functions.selectors import SelectorError, all_elements, first_element, select
from siteweave.operators.rules import PagePlugin, Registry, Rule, RuleConfig

PAGE = """<!DOCTYPE html><html LANG="en-GB"><head><title>T</title><meta name=robots content=noindex></head>
<body class="one two"><div id="top"><ul><li class="a first">1<li class="b">2<li>3</ul><p>x<p data-k="Abc-def">y</div>
<form><label for="n1">N</label><input id="n1"><input id="9"><input><textarea id="t"></textarea></form>
<table><tr><td>1<td>2<tr><td>3</table><p></p><a href="https://x.example/a.pdf">pdf</a><section><p><b>deep</b></section></body></html>"""
#: Selector, and the tags and ids or texts that it selects.
SELECTED = {
    "html": 1, "head > title": 1, "title head": 0, "body.one.two": 1, ".one.three": 0, "li": 3, "ul > li": 3, "ul > li.b": 1, "li + li": 2, "li ~ li": 2, "li.a ~ li": 2, "li.b + li": 1, "li.b ~ li.a": 0,
    "li:first-child": 1, "li:last-child": 1, "li:nth-child(2)": 1, "li:nth-child(odd)": 2, "li:nth-child(-n+2)": 2, "li:nth-child(n+3)": 1, "li:nth-child(2n)": 1, "#top p": 2, "#top > p + p": 1, "[data-k]": 1, "[data-k=Abc-def]": 1, "[data-k='abc-def' i]": 1,
    "[data-k=abc-def]": 0, "[data-k|=Abc]": 1, "[data-k^=Ab]": 1, "[data-k$=ef]": 1, "[data-k*='c-d']": 1, "[data-k^='']": 0, "[class~=first]": 1, "[class~='a first']": 0, "html[lang|=en]": 1, "table tr": 2, "table > tr": 0,
    "table > tbody > tr > td": 3, "input, textarea": 4, "input:not([id])": 1, "input:not([id], #n1)": 1, ":is(input, textarea):not(#n1)": 3, "p:empty": 1, ":root": 1, ":root > *": 2, "section b:only-child": 1, "a[href$='.pdf']": 1,
    "body * b": 1, "div ul li.first, section p": 2, " li , p ": 7, "LI.a": 1, "li.A": 0, "\\6c i": 3, "#\\39": 1, "l\\i": 3,
}


def rows(spark, *pages):
    return with_elements(spark.createDataFrame([(i, f"https://s.example/{i}", p) for i, p in enumerate(pages)], "page_id long, url string, html string"))


def test_selectors(spark):
    got = rows(spark, PAGE).select(*[F.size(all_elements(s)).alias(f"n{i}") for i, s in enumerate(SELECTED)]).first()
    assert {s: got[i] for i, s in enumerate(SELECTED)} == SELECTED


@pytest.mark.parametrize("bad", ["", " ", "li >", "> li", "li,,p", "li[", "li[]", "[a=]", "[a=1]", "a:unknown", "a::before", ":not(", ":not()", ":nth-child(x)", "a:nth-child(2", "a)", ".", "#", "..a", ".1", "a b:has(c)", "li > > p", "a{", ":not(a b)", "*a"])
def test_bad_selectors(bad):
    with pytest.raises(SelectorError):
        all_elements(bad, elements=F.lit(None))


def test_values_from_columns(spark):
    page = rows(spark, PAGE)
    found = page.select(F.transform(all_elements("input"), lambda e: F.size(all_elements("label[for=?]", e["attrs"]["id"]))).alias("n")).first().n
    assert found == [1, 0, 0]
    for selector, given in (("a[b=?]", 0), ("a", 1)):
        with pytest.raises(SelectorError):
            all_elements(selector, *[F.lit("x")] * given)


def test_first_and_all(spark):
    pages = rows(spark, PAGE, "", None, "just text", "<p>a<p>b")
    got = {r.page_id: r for r in pages.select("page_id", first_element("p").alias("p"), F.size(all_elements("body")).alias("n")).collect()}
    assert got[0].p.text == "x" and got[1].p is None and got[2].n in (None, -1) and got[3].p is None and got[4].p["last"] == got[4].p.pre
    assert [got[i].n for i in (0, 1, 3, 4)] == [1, 1, 1, 1]
    chosen = select(pages, "body > p")
    assert chosen.columns[:2] == ["page_id", "url"] and sorted(r.text for r in chosen.filter("page_id = 4").collect()) == ["a", "b"]


def test_tree_numbers(spark):
    nodes = tree(PAGE)
    for n in nodes:
        inside = [m["pre"] for m in nodes if n["pre"] in m["path"]]
        assert max(inside, default=n["pre"]) == n["last"] and inside == list(range(n["pre"] + 1, n["last"] + 1))
        assert n["parent"] == (n["path"] or [-1])[-1]
    assert node_table(rows(spark, PAGE)).count() == len(nodes)
    assert [n["tag"] for n in tree("<title>a</title>b")] == ["html", "head", "title", "body"]
    assert [n["tag"] for n in tree("<body><meta><script><p></script><p>")] == ["html", "head", "body", "meta", "script", "p"]
    assert [n["tag"] for n in tree("<head></head><link><p>")] == ["html", "head", "link", "body", "p"] and tree("<head></head><link>")[2]["parent"] == 1
    assert dict(tree("<body a=1><html b=2><body a=3 c=4>")[0]["attrs"]) == {"b": "2"}


class Navigation(PagePlugin):
    name, description = "Navigation", "An own plugin that asks by selector"

    def rules(self):
        return [Rule("own.navigation", "Navigation", self.name, "Info", "SEO", "Lists have three entries", "yes", "no", passed=lambda: F.size(all_elements("ul > li")) >= 3)]


def test_an_own_rule_asks_by_selector(spark):
    registry = Registry(RuleConfig({"own.navigation": True}))
    registry.register(Navigation())
    found = registry.analyze(parse_pages(rows(spark, PAGE, "<ul><li>1</ul>")))
    assert "elements" not in found.columns and {r.page_id: r.passed for r in found.collect()} == {0: True, 1: False}

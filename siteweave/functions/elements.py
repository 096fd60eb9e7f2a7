"""The elements of a page as an array of structs, in document order, with what is needed to walk the tree by number.

The tree is HTML's for what pages usually hold: html, head and body are there even if the page leaves them out, elements
without an end tag close where HTML closes them, table rows get a body. Markup that needs more repair (formatting that is
closed in the wrong order, text inside tables) stays nested as it is written.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from siteweave.functions.html import RAW, VOID

ELEMENT = (
    T.StructType().add("pre", "integer").add("last", "integer").add("parent", "integer").add("prev", "integer").add("nth", "integer").add("of", "integer")
    .add("path", T.ArrayType(T.IntegerType())).add("tag", "string").add("attrs", T.MapType(T.StringType(), T.StringType())).add("text", "string")
)
#: Elements that belong into the head while the body has not begun.
HEAD = {"base", "link", "meta", "title", "script", "style", "noscript", "template"}
BLOCKS = {"address", "article", "aside", "blockquote", "details", "dialog", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"}
#: By tag: the open elements that its start tag ends, and those that they are not looked for beyond.
_ROW, _CELL = {"tr", "td", "th"}, {"td", "th"}
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}), "tr": (_ROW, {"table"}), "td": (_CELL, {"tr", "table"}), "th": (_CELL, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", *_ROW}, {"table"}), "thead": ({"tbody", "thead", "tfoot", *_ROW}, {"table"}), "tfoot": ({"tbody", "thead", "tfoot", *_ROW}, {"table"}),
    "a": ({"a"}, {"td", "th", "table"}), "button": ({"button"}, {"td", "th", "table"}),
}


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.nodes: list[dict] = []
        self.open: list[int] = []
        self.children: list[list[int]] = []
        self.text: list[list[str]] = []
        self.body = False

    def _push(self, tag: str, attrs: dict[str, str]) -> None:
        at, parent = len(self.nodes), self.open[-1] if self.open else -1
        held = self.children[parent] if parent >= 0 else []
        self.nodes.append({"pre": at, "parent": parent, "prev": held[-1] if held else -1, "nth": len(held) + 1, "path": list(self.open), "tag": tag, "attrs": attrs})
        held.append(at)
        self.children.append([])
        self.text.append([])
        self.open.append(at)

    def _tags(self) -> list[str]:
        return [self.nodes[i]["tag"] for i in self.open]

    def _begin(self, inside_head: bool) -> None:
        """Opens html, then head or body, as far as they are not there yet."""
        if not self.nodes:
            self._push("html", {})
        if self.body:
            return
        if inside_head:
            if len(self.nodes) == 1:
                self._push("head", {})
            elif self._tags() == ["html"] and self.nodes[1]["tag"] == "head":
                self.open.append(1)  # after the head, but what belongs into it goes there
        else:
            if len(self.nodes) == 1:
                self._push("head", {})
            del self.open[1:]
            self._push("body", {})
            self.body = True

    def _end(self, tags: set[str], stop: set[str]) -> None:
        """Ends the outermost open element of ``tags`` that lies within the innermost of ``stop``."""
        found = None
        for i in range(len(self.open) - 1, 1, -1):
            tag = self.nodes[self.open[i]]["tag"]
            if tag in stop:
                break
            if tag in tags:
                found = i
        if found is not None:
            del self.open[found:]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        own: dict[str, str] = {}
        for k, v in attrs:
            own.setdefault(k, v or "")
        if tag in ("html", "body") or tag == "head" and self.nodes:
            if tag != "html":
                self._begin(tag == "head")
            elif not self.nodes:
                self._push("html", {})
            for node in self.nodes:
                if node["tag"] == tag:
                    node["attrs"] = own | node["attrs"]
                    break
            return
        if tag == "head":
            self._push("html", {})
            self._push("head", own)
            return
        self._begin(tag in HEAD)
        if tag in BLOCKS:
            self._end({"p"}, {"button", "table", "td", "th"})
        if tag in ENDS:
            self._end(*ENDS[tag])
        if tag == "tr" and self.open and self.nodes[self.open[-1]]["tag"] == "table":
            self._push("tbody", {})
        self._push(tag, own)
        if tag in VOID:
            self.open.pop()
        elif tag in RAW:
            self.set_cdata_mode(tag)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag in ("html", "body") or not self.open:
            return
        for i in range(len(self.open) - 1, 0, -1):
            if self.nodes[self.open[i]]["tag"] == tag:
                del self.open[i:]
                return

    def handle_data(self, data: str) -> None:
        if not self.cdata_elem and not self.body:
            if not data.strip():
                return
            self._begin(False)
        if self.open:
            self.text[self.open[-1]].append(data)

    def result(self) -> list[dict]:
        self._begin(True)
        self._begin(False)
        last = list(range(len(self.nodes)))
        for i in range(len(self.nodes) - 1, 0, -1):
            last[self.nodes[i]["parent"]] = max(last[self.nodes[i]["parent"]], last[i])
        for i, node in enumerate(self.nodes):
            parent = node["parent"]
            node |= {"last": last[i], "of": len(self.children[parent]) if parent >= 0 else 1, "text": "".join(self.text[i]), "attrs": list(node["attrs"].items())}
        return self.nodes


def tree(page: str | None) -> list[dict] | None:
    """A page's elements; None without HTML."""
    if page is None:
        return None
    parser = _Tree()
    parser.feed(page)
    parser.close()
    return parser.result()


def with_elements(pages: DataFrame, *, html: str = "html") -> DataFrame:
    """``pages`` with the column ``elements``; null where the page has no HTML.

    An element has its number in document order (``pre``), that of its last descendant, of its parent and of the element
    before it among its siblings (-1 for none), its place among them, the numbers of its ancestors from the root on,
    its tag and attributes in lower case, and its own text without that of elements inside it.
    """
    kept = pages.drop("elements")
    at, kind = kept.columns.index(html), to_arrow_type(T.ArrayType(ELEMENT))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one in range(0, len(batch), 64):  # trees are larger than their pages
                part = batch.slice(one, 64)
                found = pa.array([tree(h) for h in part.column(at).to_pylist()], kind)
                yield pa.RecordBatch.from_arrays([*part.columns, found], [*part.schema.names, "elements"])

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField("elements", T.ArrayType(ELEMENT))]))


def node_table(pages: DataFrame) -> DataFrame:
    """A row for each element of pages that have ``elements``: the page's other columns but html, and the element's."""
    kept = [F.col(f"`{c}`") for c in pages.columns if c not in ("html", "elements", "p")]
    return pages.select(*kept, F.explode("elements").alias("e")).select(*kept, "e.*")

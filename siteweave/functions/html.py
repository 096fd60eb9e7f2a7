"""HTML to typed columns, in one pass over each page.

Python's tokenizer is used; of the document tree only what rules need is kept: text inside links and buttons, inner HTML
of titles and headings, and their source as the page has it (references are neither resolved nor written anew). Elements whose content HTML takes as text (titles, scripts, noscript, ...) are read as text.
"""

from __future__ import annotations

import html as entities
from collections.abc import Iterator
from html.parser import HTMLParser
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from siteweave.schema import PARSED

RAW = {"title", "textarea", "noscript", "iframe", "noframes", "noembed", "xmp", "script", "style"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
LEVELS = ("h1", "h2", "h3", "h4", "h5", "h6")
#: Bytes of HTML that are read at once; a page counts as a kilobyte more than it has, for its row.
HELD = 1 << 20
#: White space that text is trimmed of.
BLANK = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def escape(text: str) -> str:
    """Text as it is written inside an element."""
    return text.replace("&", "&amp;").replace("\xa0", "&nbsp;").replace("<", "&lt;").replace(">", "&gt;")


class _Page(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: dict = {f.name: ([] if isinstance(f.dataType, T.ArrayType) else {} if isinstance(f.dataType, T.MapType) else None) for f in PARSED}
        self.out |= {"html_has_lang": False, "bare_aria": False}
        self.levels: dict[str, list[tuple[str, str]]] = {h: [] for h in LEVELS}
        self.open: list[tuple[str, list[str], bool]] = []  # links and buttons: tag, text so far, whether it has a label
        self.heading: tuple[str, list[str], int] | None = None  # tag, inner HTML so far, where its source begins
        self.page, self.lines = "", []
        self.title: list[str] | None = None
        self.framesets = 0
        self.seen_html = False

    def read(self, page: str) -> dict:
        self.page = page
        self.feed(page)
        self.close()
        return self.result()

    def _place(self) -> int:
        """Where the tag that is being handled begins."""
        line, column = self.getpos()
        if not self.lines:
            self.lines = [0, *accumulate(len(text) + 1 for text in self.page.split("\n"))]
        return self.lines[line - 1] + column

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a: dict[str, str] = {}
        for k, v in attrs:
            a.setdefault(k, v or "")  # the first of equal names counts
        out = self.out
        if tag == "html" and not self.seen_html:
            self.seen_html = True
            out["html_has_lang"] = "lang" in a
        elif tag == "title" and out["title"] is None and self.title is None:
            self.title = []
        elif tag == "link":
            self._link(a)
        elif tag == "meta":
            self._meta(a)
        elif tag == "img":
            out["images"].append({"src": a.get("src", ""), "alt": a.get("alt"), "srcset": a.get("srcset")})
        elif tag in ("a", "button"):
            self._close(tag)
            self.open.append((tag, [], "aria-label" in a or "aria-labelledby" in a))
            if tag == "a" and "href" in a:
                out["hrefs"].append(a["href"])
        elif tag in ("input", "select", "textarea"):
            out["fields"].append(a.get("id"))
        elif tag == "label" and "for" in a:
            out["label_for"].append(a["for"])
        elif tag == "frameset":
            self.framesets += 1
        if tag == "iframe" or tag == "frame" and self.framesets:
            out["frames"].append(a.get("title"))
        if tag in LEVELS:
            self._end_heading(self._place())
            self.heading = tag, [], self._place() + len(self.get_starttag_text() or "")
        elif self.heading:
            self.heading[1].append("<" + tag + "".join(f' {k}="{entities.escape(v)}"' for k, v in a.items()) + ">")
        if "id" in a:
            out["ids"].append(a["id"])
        if "tabindex" in a:
            out["tabindexes"].append(a["tabindex"])
        if "role" in a:
            out["roles"].append({"role": a["role"], "attrs": sorted(a)})
        if "aria-" in a:
            out["bare_aria"] = True
        if tag in RAW:
            self.set_cdata_mode(tag)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # a slash closes nothing in HTML

    def handle_endtag(self, tag: str) -> None:
        if tag == "title" and self.title is not None:
            self._end_title()
        elif tag in ("a", "button"):
            self._close(tag)
        elif tag == "frameset":
            self.framesets -= 1
        if tag in LEVELS:
            self._end_heading(self._place())
        elif self.heading and tag not in VOID:
            self.heading[1].append(f"</{tag}>")

    def handle_data(self, data: str) -> None:
        if self.title is not None:
            self.title.append(data)
        for _, text, _ in self.open:
            text.append(data)
        if self.heading:
            self.heading[1].append(data if self.cdata_elem else escape(data))

    def _link(self, a: dict[str, str]) -> None:
        out, rel = self.out, a.get("rel")
        column = {"canonical": "canonical", "sitemap": "sitemap", "icon": "favicon", "shortcut icon": "favicon", "manifest": "webmanifest"}.get(rel or "")
        if column:
            out[column] = a.get("href")  # the last one counts, also if it has none
        elif rel == "script" and "src" in a:
            out["scripts"].append(a["src"])
        elif rel == "stylesheet" and "href" in a:
            out["styles"].append(a["href"])

    def _meta(self, a: dict[str, str]) -> None:
        out, name, prop = self.out, a.get("name"), a.get("property", "")
        if name in ("description", "robots", "keywords", "viewport"):
            out[name] = a.get("content")
        elif name == "generator" and "content" in a:
            out["generators"].append(a["content"])
        if "charset" in a:
            out["charset"] = a["charset"]
        for prefix, column in (("og:", "og_tags"), ("twitter:", "twitter_tags")):
            if prop.startswith(prefix) and "content" in a:
                while prop.startswith(prefix):
                    prop = prop[len(prefix) :]
                out[column][prop] = a["content"]
                break

    def _close(self, tag: str) -> None:
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                _, text, labelled = self.open.pop(i)
                self.out["anchors" if tag == "a" else "buttons"].append({"text": "".join(text).strip(BLANK), "labelled": labelled})
                return

    def _end_title(self) -> None:
        self.out["title_source"] = "".join(self.title or [])
        self.out["title"] = escape(entities.unescape(self.out["title_source"]))
        self.title = None

    def _end_heading(self, end: int) -> None:
        if self.heading:
            tag, inner, begin = self.heading
            self.levels[tag].append(("".join(inner), self.page[begin:end]))
            self.heading = None

    def result(self) -> dict:
        while self.open:
            self._close(self.open[-1][0])
        if self.title is not None:
            self._end_title()
        self._end_heading(len(self.page))
        self.out["headings"] = [{"tag": h, "text": t, "source": s} for h in LEVELS for t, s in self.levels[h]]
        return self.out | {c: list(self.out[c].items()) for c in ("og_tags", "twitter_tags")}


def parse(page: str | None) -> dict | None:
    """The parsed struct of one page; None without HTML."""
    return None if page is None else _Page().read(page)


def slices(batch: pa.RecordBatch, html: int) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in runs of ``HELD`` bytes of the column ``html``, or a single page that has more.

    What is made of pages takes many times their size: only that of one run is held, whatever the batch has.
    """
    sizes = pc.binary_length(batch.column(html)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) + 1024
    ends, begin = np.cumsum(sizes), 0
    while begin < len(batch):
        end = int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + HELD, "right"))
        yield batch.slice(begin, max(end, begin + 1) - begin)
        begin = max(end, begin + 1)


def parse_pages(pages: DataFrame, *, html: str = "html", fields: list[str] | None = None) -> DataFrame:
    """``pages`` with the struct column ``p``. HTML is parsed once; everything else reads the struct.

    Who reads only some of the fields names them in ``fields``: no others are built into rows.
    """
    kept = pages.drop("p")
    shape = PARSED if fields is None else T.StructType([PARSED[f] for f in fields])
    at, kind = kept.columns.index(html), to_arrow_type(shape)

    def own(page: str | None) -> dict | None:
        found = parse(page)
        return found if found is None or fields is None else {f: found[f] for f in fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, at)):
            parsed = pa.array([own(h) for h in batch.column(at).to_pylist()], kind)
            yield pa.RecordBatch.from_arrays([*batch.columns, parsed], [*batch.schema.names, "p"])

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField("p", shape)]))

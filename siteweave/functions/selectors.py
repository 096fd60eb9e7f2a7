"""CSS selectors as column expressions over a page's ``elements``.

A selector is compiled to one boolean array for each step from left to right: an element matches if it passes the step's
tests and the step before holds for its parent, an ancestor, or a sibling before it. Ancestors are known by number, so a
step takes time in proportion to elements and depth, and nothing leaves the JVM.

Understood are types, ``*``, ``#id``, ``.class``, attributes with all operators and the flag ``i``, the combinators blank,
``>``, ``+`` and ``~``, lists, and ``:not()``, ``:is()``, ``:root``, ``:empty``, ``:first-child``, ``:last-child``,
``:only-child``, ``:nth-child()``. Anything else is a ``SelectorError``. ``?`` stands for a value that a column gives.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Test = Callable[[Column], Column]
_ESCAPE = r"\\(?:[0-9a-fA-F]{1,6}[ \t\n\r\f]?|[^0-9a-fA-F\n])"
_NAME = rf"(?:-?(?:[A-Za-z_]|[^\x00-\x7F]|{_ESCAPE})|--)(?:[\w-]|[^\x00-\x7F]|{_ESCAPE})*"
_TOKEN = re.compile(
    rf"""(?P<hash>\#(?:[\w-]|[^\x00-\x7F]|{_ESCAPE})+)|(?P<cls>\.{_NAME})|(?P<attr>\[\s*(?P<key>{_NAME})\s*(?:(?P<op>[~|^$*]?=)\s*(?P<value>\?|"[^"\n]*"|'[^'\n]*'|{_NAME})\s*(?P<flag>[iIsS]?)\s*)?\])"""
    rf"""|(?P<pseudo>:{_NAME})(?P<call>\()?|(?P<tag>{_NAME}|\*)"""
)
_BLANKS, _STEP = re.compile(r"[ \t\n\r\f]*"), re.compile(r"[ \t\n\r\f]*([>+~])[ \t\n\r\f]*|[ \t\n\r\f]+")
_NTH = re.compile(r"\s*(?:(?P<word>odd|even)|(?P<a>[+-]?\d*)n(?:\s*(?P<sign>[+-])\s*(?P<b>\d+))?|(?P<only>[+-]?\d+))\s*", re.I)
#: What CSS takes as a name; a value outside quotes must be one.
IDENTIFIER = r"^-?[A-Za-z_\x{80}-\x{10FFFF}][A-Za-z0-9_\x{80}-\x{10FFFF}-]*\z"


class SelectorError(ValueError):
    """The text is no selector, or one that is not understood."""


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _plain(name: str) -> str:
    return re.sub(r"\\(?:([0-9a-fA-F]{1,6})\s?|(.))", lambda m: m[2] or chr(int(m[1], 16)), name)


def attribute(e: Column, name: str) -> Column:
    return F.try_element_at(e["attrs"], F.lit(name))


def _all(tests: list[Test]) -> Test:
    return lambda e: reduce(lambda a, b: a & b, [t(e) for t in tests], F.lit(True))


def _attribute_test(key: str, op: str | None, value: str | Column, insensitive: bool) -> Test:
    def test(e: Column) -> Column:
        held = attribute(e, key)
        if op is None:
            return held.isNotNull()
        want = value if isinstance(value, Column) else F.lit(value)
        if insensitive:
            held, want = F.lower(held), F.lower(want)
        if op == "=":
            found = held == want
        elif op == "~=":
            found = F.array_contains(F.split(held, r"[ \t\n\r\f]+"), want) & ~want.rlike(r"[ \t\n\r\f]") & (want != "")
        elif op == "|=":
            found = (held == want) | F.startswith(held, F.concat(want, F.lit("-")))
        else:
            found = {"^=": F.startswith, "$=": F.endswith, "*=": F.contains}[op](held, want) & (want != "")
        return F.coalesce(found, F.lit(False))

    return test


def _nth(text: str) -> Test:
    m = _NTH.fullmatch(text)
    if not m:
        raise SelectorError(f"no place among children: {text}")
    if m["only"]:
        a, b = 0, int(m["only"])
    elif m["word"]:
        a, b = 2, int(m["word"].lower() == "odd")
    else:
        a = int(m["a"] + "1" if m["a"] in ("", "+", "-") else m["a"])
        b = int((m["sign"] or "") + (m["b"] or "0"))
    if a == 0:
        return lambda e: e["nth"] == b
    return lambda e: ((e["nth"] - b) % a == 0) & ((e["nth"] - b) / a >= 0)


class _Reader:
    def __init__(self, text: str, values: list[Column]) -> None:
        self.text, self.at, self.values = text, 0, values

    def skip(self) -> None:
        self.at = _BLANKS.match(self.text, self.at).end()

    def list(self, closed: bool) -> list[list[tuple[str, Test]]]:
        out = [self.steps()]
        while self.text[self.at : self.at + 1] == ",":
            self.at += 1
            out.append(self.steps())
        if closed:
            if self.text[self.at : self.at + 1] != ")":
                raise SelectorError(f"a bracket is open: {self.text}")
            self.at += 1
        elif self.at < len(self.text):
            raise SelectorError(f"not understood at {self.at}: {self.text}")
        return out

    def steps(self) -> list[tuple[str, Test]]:
        self.skip()
        out = [("", self.compound())]
        while True:
            m = _STEP.match(self.text, self.at)
            if not m or self.text[m.end() : m.end() + 1] in ("", ",", ")") and not m[1]:
                self.skip()
                return out
            self.at = m.end()
            out.append((m[1] or " ", self.compound()))

    def compound(self) -> Test:
        tests: list[Test] = []
        while m := _TOKEN.match(self.text, self.at):
            if m["tag"] and tests:
                raise SelectorError(f"a type comes first: {self.text}")
            self.at = m.end()
            tests.append(self.simple(m))
        if not tests:
            raise SelectorError(f"not understood at {self.at}: {self.text}")
        return _all(tests)

    def simple(self, m: re.Match) -> Test:
        if m["tag"]:
            return (lambda e: F.lit(True)) if m["tag"] == "*" else (lambda e, t=_plain(m["tag"]).lower(): e["tag"] == t)
        if m["hash"]:
            return _attribute_test("id", "=", _plain(m["hash"][1:]), False)
        if m["cls"]:
            return _attribute_test("class", "~=", _plain(m["cls"][1:]), False)
        if m["attr"]:
            value: str | Column = m["value"] or ""
            if value == "?":
                if not self.values:
                    raise SelectorError(f"a value is missing: {self.text}")
                value = self.values.pop(0)
            elif value[:1] in "\"'":
                value = value[1:-1]
            else:
                value = _plain(value)
            return _attribute_test(_plain(m["key"]).lower(), m["op"], value, (m["flag"] or "").lower() == "i")
        name = m["pseudo"][1:].lower()
        if m["call"]:
            return self.function(name)
        simple: dict[str, Test] = {
            "root": lambda e: e["parent"] < 0, "empty": lambda e: (e["last"] == e["pre"]) & (e["text"] == ""), "first-child": lambda e: e["nth"] == 1,
            "last-child": lambda e: e["nth"] == e["of"], "only-child": lambda e: e["of"] == 1,
        }
        if name not in simple:
            raise SelectorError(f"unknown: {m['pseudo']}")
        return simple[name]

    def function(self, name: str) -> Test:
        if name == "nth-child":
            end = self.text.find(")", self.at)
            if end < 0:
                raise SelectorError(f"a bracket is open: {self.text}")
            inner, self.at = self.text[self.at : end], end + 1
            return _nth(inner)
        if name not in ("not", "is"):
            raise SelectorError(f"unknown: :{name}()")
        chains = self.list(True)
        if any(len(c) > 1 for c in chains):
            raise SelectorError(f"no combinators inside :{name}(): {self.text}")
        tests = [c[0][1] for c in chains]
        either = lambda e: reduce(lambda a, b: a | b, [t(e) for t in tests])
        return (lambda e: ~either(e)) if name == "not" else either


def _linked(e: Column, how: str, before: Column, elements: Column) -> Column:
    held = lambda k: F.coalesce(F.get(before, k), F.lit(False))
    if how == ">":
        return held(e["parent"])
    if how == "+":
        return held(e["prev"])
    if how == " ":
        return F.exists(e["path"], held)
    earlier = F.filter(elements, lambda s: (s["parent"] == e["parent"]) & (s["pre"] < e["pre"]))
    return F.exists(earlier, lambda s: held(s["pre"]))


def matches(elements: Column, selector: str, *values: Column) -> Column:
    """An array of booleans: which of the elements the selector selects. ``SelectorError`` if it is none."""
    given = list(values)
    chains = _Reader(selector, given).list(False)
    if given:
        raise SelectorError(f"more values than places for them: {selector}")

    def step(state: Column, how: str, test: Test) -> Column:
        return _let(state, lambda before: F.transform(elements, lambda e: test(e) & _linked(e, how, before, elements)))

    def chain(steps: list[tuple[str, Test]]) -> Column:
        state = F.transform(elements, steps[0][1])
        for how, test in steps[1:]:
            state = step(state, how, test)
        return state

    return reduce(lambda a, b: F.zip_with(a, b, lambda x, y: x | y), map(chain, chains))


def all_elements(selector: str, *values: Column, elements: str | Column = "elements") -> Column:
    """The array of elements that a selector selects, in document order; null where there is no page."""
    own = F.col(elements) if isinstance(elements, str) else elements
    return _let(matches(own, selector, *values), lambda found: F.filter(own, lambda e: F.get(found, e["pre"])))


def first_element(selector: str, *values: Column, elements: str | Column = "elements") -> Column:
    """The first element that a selector selects, or null."""
    return F.get(all_elements(selector, *values, elements=elements), F.lit(0))


def select(pages: DataFrame, selector: str) -> DataFrame:
    """A row for each selected element of pages that have ``elements``: the page's other columns but html, and the element's."""
    kept = [F.col(f"`{c}`") for c in pages.columns if c not in ("html", "elements", "p")]
    return pages.select(*kept, F.explode(all_elements(selector)).alias("e")).select(*kept, "e.*")

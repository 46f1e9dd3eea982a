"""A small HTML tree with CSS selectors on the standard library, and what is read out of pages with it."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partmill.functions.urls import normalize

VOID = set("area base br col embed hr img input link meta param source track wbr".split())


class Element:
    """A tag with its attributes, parent and children (elements and texts)."""

    def __init__(self, tag: str, attributes: dict[str, str], parent: Element | None):
        self.tag, self.attributes, self.parent, self.children = tag, attributes, parent, []

    def walk(self) -> Iterator[Element]:
        """All elements below, in document order."""
        stack = [c for c in reversed(self.children) if isinstance(c, Element)]
        while stack:
            element = stack.pop()
            yield element
            stack += [c for c in reversed(element.children) if isinstance(c, Element)]

    def texts(self) -> Iterator[str]:
        stack: list = list(reversed(self.children))
        while stack:
            child = stack.pop()
            if isinstance(child, str):
                yield child
            elif child.tag not in ("script", "style"):
                stack += reversed(child.children)

    def text(self, between: str = "") -> str:
        """The texts below, each stripped, joined."""
        return between.join(t for t in (x.strip() for x in self.texts()) if t)

    def select(self, selector: str) -> list[Element]:
        return Index(self).select(selector)

    def select_one(self, selector: str) -> Element | None:
        return next(iter(self.select(selector)), None)


class Index:
    """A tree's elements in document order, by class, id and tag, from one walk; selectors look only at the elements that
    their last step can mean, below any element of the tree."""

    def __init__(self, root: Element):
        self.root, self.order, self.last = root, {}, {}
        self.by: dict[tuple[str, str], list[Element]] = {}
        for at, element in enumerate(root.walk()):
            self.order[id(element)] = at
            keys = {("tag", element.tag), ("tag", "*"), ("id", element.attributes.get("id", ""))} | {("class", c) for c in element.attributes.get("class", "").split()}
            for key in keys:
                self.by.setdefault(key, []).append(element)
            above = element
            while above is not None and above is not root:
                self.last[id(above)] = at
                above = above.parent

    def candidates(self, chain: Chain) -> list[Element]:
        _, tag, tests = chain.steps[-1]
        named = [("class", t[0]) for t in tests if t[0]] + [("id", t[1]) for t in tests if t[1]] + [("tag", tag)]
        return min((self.by.get(key, []) for key in named), key=len)

    def select(self, selector: str, below: Element | None = None) -> list[Element]:
        """The elements that a selector means, in document order; only those below an element if one is given."""
        inside = (lambda at: True) if below is None or below is self.root else (lambda at: self.order[id(below)] < at <= self.last[id(below)])
        found = {self.order[id(e)]: e for chain in chains(selector) for e in self.candidates(chain) if inside(self.order[id(e)]) and chain.fits(e)}
        return [found[at] for at in sorted(found)]


class Chain:
    """A selector without commas: tag, ``*``, ``.class``, ``#id``, ``[attr]``, ``[attr=value]``, descendant and ``>``."""

    STEP = re.compile(r"""\s*(>)?\s*([\w-]+|\*)?((?:\.[\w-]+|\#[\w-]+|\[\s*[\w-]+\s*(?:=\s*(?:"[^"]*"|'[^']*'|[^\]]*))?\])*)""")
    TEST = re.compile(r"""\.([\w-]+)|\#([\w-]+)|\[\s*([\w-]+)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\]]*)))?\]""")

    def __init__(self, selector: str):
        self.steps: list[tuple[bool, str, list[tuple]]] = []
        at, text = 0, selector.strip()
        while at < len(text):
            m = self.STEP.match(text, at)
            if not m or not (m[2] or m[3]):
                raise ValueError(f"selector not supported: {selector!r}")
            self.steps.append((m[1] is not None, (m[2] or "*").lower(), self.TEST.findall(m[3])))
            at = m.end()
        if not self.steps:
            raise ValueError("empty selector")

    @staticmethod
    def meets(element: Element, tag: str, tests: list[tuple]) -> bool:
        if tag not in ("*", element.tag):
            return False
        for name, ident, attribute, *values in tests:
            if name and name not in element.attributes.get("class", "").split():
                return False
            if ident and element.attributes.get("id") != ident:
                return False
            if attribute:
                have = element.attributes.get(attribute.lower())
                want = next((v for v in values if v), None)
                if have is None or want is not None and have != want.strip():
                    return False
        return True

    def fits(self, element: Element) -> bool:
        def climb(e: Element | None, i: int) -> bool:
            if i < 0:
                return True
            child = self.steps[i + 1][0]
            while e is not None:
                if self.meets(e, *self.steps[i][1:]) and climb(e.parent, i - 1):
                    return True
                if child:
                    return False
                e = e.parent
            return False

        return self.meets(element, *self.steps[-1][1:]) and climb(element.parent, len(self.steps) - 2)


@lru_cache(256)
def chains(selector: str) -> tuple[Chain, ...]:
    return tuple(Chain(part) for part in selector.split(","))


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Element("[document]", {}, None)

    def handle_starttag(self, tag, attrs):
        element = Element(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(element)
        if tag not in VOID:
            self.at = element

    def handle_startendtag(self, tag, attrs):
        self.at.children.append(Element(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag):
        e = self.at
        while e is not None and e.tag != tag:
            e = e.parent
        if e is not None and e.parent is not None:
            self.at = e.parent

    def handle_data(self, data):
        self.at.children.append(data)


def parse(html: str | None) -> Element:
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    return builder.root


#: The places of a part in its breadcrumb trail; all names beyond them are its series.
TRAIL = ("category", "subcategory")


def product_fields(page: Index, selectors: dict) -> Iterator[tuple[str, str, str]]:
    """(field, name, value) rows of what a page's selectors find: ``part_no``, ``crumb`` and ``attribute``."""
    for element in page.select(selectors["part_no"])[:1]:
        yield "part_no", "", element.text()
    for n, element in enumerate(page.select(selectors["breadcrumb"]) if selectors.get("breadcrumb") else ()):
        if n or element.text().lower() != "home":
            yield "crumb", "", element.text()
    spec = selectors.get("attributes") or {"row": ""}
    for row in page.select(spec["row"]) if spec["row"] else ():
        pair = [page.select(spec[side], row)[:1] for side in ("label", "value")]
        if all(pair) and (label := pair[0][0].text()):
            yield "attribute", label.rstrip(":").strip(), pair[1][0].text(" ")


def product_of(html: str | None, url: str, selectors: dict) -> dict | None:
    """The part of a product page; None if the selector of the number misses or is empty."""
    rows = list(product_fields(Index(parse(html)), selectors))
    numbers = [value for kind, _, value in rows if kind == "part_no" and value]
    if not numbers:
        return None
    trail = [value for kind, _, value in rows if kind == "crumb"]
    places = dict(zip(TRAIL, [*trail, *[""] * len(TRAIL)]))
    return {"part_no": numbers[0], "url": url, **places, "series": " / ".join(trail[len(TRAIL) :]), "attributes": {name: value for kind, name, value in rows if kind == "attribute"}}


def product_pages(pages: DataFrame, selectors: dict) -> DataFrame:
    """url, part_no, category, subcategory, series, attributes of the pages (url, html) that hold a product."""
    columns = ["url", "part_no", "category", "subcategory", "series", "attributes"]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [p for url, html in zip(pdf["url"], pdf["html"]) if (p := product_of(html, url, selectors))]
            yield pd.DataFrame([[p[c] for c in columns] for p in found], columns=columns)

    return pages.select("url", "html").mapInPandas(read, "url string, part_no string, category string, subcategory string, series string, attributes map<string,string>")


def page_links(pages: DataFrame, paging: str | None = None) -> DataFrame:
    """url, pos, href, target: the links of each page in order; ``target`` is null for other hosts."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for url, html in zip(pdf["url"], pdf["html"]):
                links = [e.attributes["href"] for e in parse(html).walk() if e.tag == "a" and "href" in e.attributes]
                rows += [(url, i, href, normalize(href, url, paging) if url else None) for i, href in enumerate(links)]
            yield pd.DataFrame(rows, columns=["url", "pos", "href", "target"])

    return pages.select("url", "html").mapInPandas(read, "url string, pos int, href string, target string")


def visible_titles(pages: DataFrame) -> DataFrame:
    """url, title of each page (url, html)."""
    return pages.select("url", F.trim(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)).alias("title"))

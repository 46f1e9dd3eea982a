"""Products and categories of a site's product API, page by page, and the search for each entry of a short list."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import count
from urllib.parse import quote

from partmill.errors import WebError
from partmill.functions.keys import plain_key
from partmill.sources.fetch import Fetcher

#: Products of a page; the API gives no more whatever it is asked for.
PAGE_SIZE = 64
#: Entries of a list up to which a site is searched for each of them instead of collected whole.
SEARCH_LIMIT = 500


def is_api(fetcher: Fetcher, base: str) -> bool:
    """Whether the site describes itself as the API's platform does."""
    try:
        found = fetcher.document(f"{base}/api/v1/websites/current?expand=languages%2Ccurrencies")
    except WebError:
        return False
    return isinstance(found, dict) and not {"id", "websiteId"}.isdisjoint(found)


def category_leaves(fetcher: Fetcher, base: str) -> list[tuple[str, list[str]]]:
    """(id, names from the root down) of the categories without children, in the tree's order."""
    tree = fetcher.document(f"{base}/api/v1/categories/?maxDepth=3&includeStartCategory=false")["categories"]
    stack, leaves = [(node, []) for node in reversed(tree)], []
    while stack:
        node, above = stack.pop()
        names, below = [*above, node["shortDescription"]], node.get("subCategories") or []
        stack += [(child, names) for child in reversed(below)]
        if not below:
            leaves.append((str(node["id"]), names))
    return leaves


def category_products(fetcher: Fetcher, base: str, category: str) -> Iterator[dict]:
    """The products of a category; the pages end with an empty one or the last that the answer announces."""
    for page in count(1):
        answer = fetcher.document(f"{base}/api/v2/products?categoryId={category}&page={page}&pageSize={PAGE_SIZE}&expand=attributes")
        products = answer.get("products") or []
        yield from products
        if not products or answer["pagination"]["numberOfPages"] <= page:
            return


def part_of(product: dict, names: list[str]) -> dict:
    """A product and the names above it as a part; values of one label are joined by ``, ``."""
    category, subcategory, *deeper = [*names, *[""] * (2 - len(names))]
    attributes = {t.get("label") or "": ", ".join(v.get("valueDisplay") or "" for v in t.get("attributeValues") or []) for t in product.get("attributeTypes") or []}
    return {"part_no": product["productNumber"], "category": category, "subcategory": subcategory, "series": " / ".join(deeper), "description": product.get("productTitle") or "", "attributes": attributes}


def category_collector(fetcher: Fetcher, base: str) -> tuple[list[str], Callable[[str], list[dict]]]:
    """(ids of the leaf categories, the function that collects one of them) for ``runs.run_units``."""
    names = dict(category_leaves(fetcher, base))
    return list(names), lambda unit: [part_of(p, names[unit]) for p in category_products(fetcher, base, unit)]


def search_collector(fetcher: Fetcher, base: str) -> Callable[[str], list[dict]]:
    """The function that collects the parts a search for one entry finds: those whose normalised number is the entry's.
    The trail of a segment is fetched once."""

    @lru_cache(None)
    def trail(segment: str) -> tuple[str, ...]:
        crumbs = fetcher.document(f"{base}/api/v1/catalogpages?path=%2Fproduct%2F{quote(segment)}").get("breadCrumbs") or []
        return tuple(c["text"] for c in crumbs if c.get("text") != "Home")

    def collect(raw: str) -> list[dict]:
        answer = fetcher.document(f"{base}/api/v2/products?search={quote(raw)}&expand=attributes&pageSize={PAGE_SIZE}")
        hits = [p for p in answer.get("products") or [] if plain_key(p["productNumber"]) == plain_key(raw)]
        return [part_of(p, list(trail(p["urlSegment"]))) for p in hits]

    return collect


def strategy(fetcher: Fetcher, base: str, entries: list[str] | None, resumed: bool = False) -> tuple[list[str], Callable[[str], list[dict]], bool]:
    """(units, collector, whether the site is searched): up to ``SEARCH_LIMIT`` entries of a run that resumes nothing are
    searched one by one; otherwise the site's categories are collected."""
    if entries and not resumed and len(entries) <= SEARCH_LIMIT:
        return entries, search_collector(fetcher, base), True
    return *category_collector(fetcher, base), False

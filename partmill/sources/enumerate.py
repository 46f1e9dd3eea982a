"""Product URLs of a site: sitemaps, link crawls with a page budget, site searches."""

from __future__ import annotations

from heapq import heappop, heappush
from itertools import count
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partmill.functions.urls import matches, next_page, normalize
from partmill.operators.match import keep_first, top_per_key


def sitemap_locations(sitemaps: DataFrame) -> DataFrame:
    """site, kind, child, loc: every ``loc`` of each sitemap (site, xml), whatever the namespace.

    ``kind`` is ``urlset`` or ``sitemapindex``.  Texts that don't start as XML are left out.
    """
    usable = sitemaps.where(F.col("xml").rlike(r"(?s)^\s*<.*>\s*$"))
    return usable.select("site", F.expr("xpath_string(xml, 'local-name(/*)')").alias("kind"), F.posexplode(F.expr("xpath(xml, '//*[local-name()=\"loc\"]/text()')")).alias("pos", "loc")).withColumn("loc", F.trim("loc"))


def sitemap_urls(sitemaps: DataFrame, pattern: str) -> DataFrame:
    """site, pos, loc of the product URLs of urlsets, the first of each URL."""
    found = sitemap_locations(sitemaps).where("kind = 'urlset' and loc <> ''").where(matches(F.col("loc"), pattern))
    return keep_first(found.select("site", "loc", "pos"), ["site", "loc"], ["pos"])


def sitemap_children(sitemaps: DataFrame) -> DataFrame:
    """site, pos, loc of the sitemaps that indexes name (one level)."""
    return sitemap_locations(sitemaps).where("kind = 'sitemapindex' and loc <> ''").select("site", "pos", "loc")


def robots_sitemap(text: str | None) -> str | None:
    """The first sitemap a robots file names."""
    for line in (text or "").splitlines():
        key, colon, value = line.partition(":")
        if colon and key.strip().lower() == "sitemap" and value.strip():
            return value.strip()
    return None


PRODUCT, CATEGORY = "product", "category"


def replay_crawl(start: list[str], links: dict[str, list[tuple[str, str]]], paging: str | None, budget: int) -> list[str]:
    """Product URLs in the order a serial crawl finds them.

    links: page -> (kind, target) in the page's order.  Every page to visit has a turn: start pages by their order, found
    categories after all known, the next page of a page that gave something new before all.  The least turn is visited
    next, up to ``budget`` pages; each page gets one turn and each product is found once.
    """
    turns = {url: turn for turn, url in enumerate(dict.fromkeys(start))}
    waiting = [(turn, url) for url, turn in turns.items()]
    later, sooner, found = count(len(waiting)), count(-1, -1), {}
    while waiting and budget > 0:
        _, url = heappop(waiting)
        budget -= 1
        known = len(found)
        for kind, target in links.get(url, ()):
            if kind == PRODUCT:
                found.setdefault(target, url)
            elif target not in turns:
                turns[target] = next(later)
                heappush(waiting, (turns[target], target))
        following = next_page(url, paging) if paging and len(found) > known else url
        if following not in turns:
            turns[following] = next(sooner)
            heappush(waiting, (turns[following], following))
    return list(found)


def crawl_urls(edges: DataFrame, starts: DataFrame, product: str, category: str | None = None, paging: str | None = None, budget: int = 10_000) -> DataFrame:
    """site, pos, url of the product pages that a crawl of each site finds.

    edges: site, url, pos, target (links extracted and normalised in parallel); starts: site, url, pos (their order).
    Links that are neither products nor categories are dropped before the queue is replayed: its order and budget can't
    be expressed set-based, so one task replays a site with its distinct links, which its page budget bounds in a real
    crawl.
    """
    kind = F.when(matches(F.col("target"), product), PRODUCT)
    if category:
        kind = kind.when(matches(F.col("target"), category), CATEGORY)
    typed = edges.where("target is not null").withColumn("kind", kind).where("kind is not null")
    first = typed.groupBy("site", "url", "kind", "target").agg(F.min("pos").alias("pos"))
    none = F.lit(None).cast("string")
    tagged = first.select("site", "url", "kind", "target", "pos").unionByName(starts.select("site", "url", none.alias("kind"), none.alias("target"), "pos"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ordered = pdf.sort_values("pos", kind="stable")
        links: dict[str, list[tuple[str, str]]] = {}
        for url, kind, target in ordered[ordered["target"].notna()][["url", "kind", "target"]].itertuples(index=False):
            links.setdefault(url, []).append((kind, target))
        found = replay_crawl(list(ordered[ordered["target"].isna()]["url"]), links, paging, budget)
        return pd.DataFrame({"site": pdf["site"].iloc[0], "pos": range(len(found)), "url": found})

    return tagged.groupBy("site").applyInPandas(run, "site string, pos long, url string")


def reachable_urls(edges: DataFrame, starts: DataFrame, product: str, category: str) -> DataFrame:
    """site, url of all product pages, by a set-based search without paging and budget: each round joins the frontier
    with the links and drops what was visited, until nothing new is reached."""
    from partmill.session import durable

    pages = durable(edges.where("target is not null").select("site", "url", "target").distinct())
    visited = frontier = durable(starts.select("site", "url").distinct())
    while not frontier.isEmpty():
        reached = pages.join(frontier, ["site", "url"]).select("site", F.col("target").alias("url")).where(matches(F.col("url"), category) & ~matches(F.col("url"), product)).distinct()
        frontier = durable(reached.join(visited, ["site", "url"], "left_anti"))
        visited = durable(visited.unionByName(frontier))
    return pages.join(visited, ["site", "url"]).select("site", F.col("target").alias("url")).where(matches(F.col("url"), product)).distinct()


def search_url(template: str, part_no: str) -> str:
    return template.format(query=quote(part_no))


def search_hits(links: DataFrame, pattern: str, most: int = 10) -> DataFrame:
    """search, pos, url: the first ``most`` distinct product links of each search's result page (search, pos, target)."""
    wanted = links.where("target is not null").where(matches(F.col("target"), pattern)).select("search", F.col("target").alias("url"), "pos")
    return top_per_key(keep_first(wanted, ["search", "url"], ["pos"]), "search", ["pos", "url"], most)


def start_urls(urls: list[str], base: str, paging: str | None = None) -> list[str]:
    return [u for u in (normalize(x, base, paging) for x in urls) if u]

"""A site's configuration when none is stored: what the site says about itself, a model's proposal, and a sample of its
product pages that must be readable before the proposal is used and kept."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import replace
from itertools import islice
from urllib.parse import urljoin

from partmill.errors import WebError
from partmill.sources import config as configs
from partmill.sources import site_api
from partmill.sources.config import SiteConfig
from partmill.sources.enumerate import robots_sitemap
from partmill.sources.fetch import Fetcher
from partmill.sources.html import parse, product_of
from partmill.sources.models import Model

#: Characters of a sitemap that the model sees, product pages of a sample, pages that a crawl for a sample visits, tries.
SITEMAP_SAMPLE, SAMPLE, SAMPLE_BUDGET, TRIES = 2000, 5, 20, 2
URLS_TASK = "Say how the product pages of a site are found. Answer with one JSON object: {\"product_url_example\", \"product_url_pattern\": a Python pattern for absolute URLs, \"category_link_pattern\" or null, \"pagination_param\" or null, \"search_url_template\" with {query} or null, \"strategy\": \"sitemap\" if the sitemap lists product pages, else \"category_crawl\"}."
SELECTORS_TASK = "Give CSS selectors for a product page. Answer with one JSON object: {\"part_no\", \"breadcrumb\" or null, \"attributes\": {\"row\", \"label\", \"value\"} or null}."


def site_sitemap(fetcher: Fetcher, base: str) -> tuple[str, str] | None:
    """(URL, text) of a site's sitemap: ``/sitemap.xml``, else the one that the robots file names."""
    home = base.rstrip("/")
    for locate in (lambda: f"{home}/sitemap.xml", lambda: robots_sitemap(fetcher.text(f"{home}/robots.txt"))):
        try:
            url = locate()
            if url:
                return url, fetcher.text(url)
        except WebError:
            continue
    return None


def propose(fetcher: Fetcher, model: Model, base: str, shorten: Callable[[str], str]) -> SiteConfig:
    """A configuration by the model's two answers: how pages are found, and how one of them is read."""
    sitemap = site_sitemap(fetcher, base)
    told = f"Sitemap {sitemap[0]}:\n{sitemap[1][:SITEMAP_SAMPLE]}" if sitemap else "No sitemap."
    urls = model.ask(URLS_TASK, f"{base}\n{told}\n\n{shorten(fetcher.page(base))}")
    try:
        example = shorten(fetcher.page(urls.get("product_url_example") or ""))
    except Exception as error:
        raise WebError("The structure of the site was not understood.") from error
    selectors = model.ask(SELECTORS_TASK, example)
    pattern = urls.get("product_url_pattern") or ""
    if sitemap and urls.get("strategy") == "sitemap":
        how = {"strategy": "sitemap", "sitemap_url": sitemap[0], "product_url_pattern": pattern}
    else:
        optional = {k: urls[k] for k in ("category_link_pattern", "pagination_param") if urls.get(k)}
        how = {"strategy": "category_crawl", "start_urls": [base], "product_link_pattern": pattern, **optional}
    found = SiteConfig("generic", how, selectors, urls.get("search_url_template"))
    if wrong := configs.problems(found):
        raise WebError(f"The structure of the site was not understood: {'; '.join(wrong)}.")
    return found


def sample(fetcher: Fetcher, config: SiteConfig, product_urls: Callable[[SiteConfig], Iterable[str]]) -> tuple[list[dict], list[str]]:
    """(parts of the first product pages, problems by ``config.sample_gate``); a crawl for them visits few pages."""
    urls = list(islice(product_urls(replace(config, page_budget=SAMPLE_BUDGET)), SAMPLE))
    texts = [fetcher.page(url) for url in urls]
    parts = [product_of(text, url, config.selectors) for url, text in zip(urls, texts)]
    return [p for p in parts if p], configs.sample_gate(parts, [parse(t).text(" ") for t in texts])


def still_valid(fetcher: Fetcher, base: str, config: SiteConfig) -> bool:
    """Whether the product that a stored configuration was checked with is still read the same; no probe is no objection."""
    try:
        if config.platform == "generic":
            return configs.probe_holds(config, lambda url: (product_of(fetcher.page(url), url, config.selectors) or {}).get("part_no"))
        return config.probe is None or fetcher.document(f"{base}/api/v2/products/{config.probe['product_id']}?expand=attributes").get("productNumber") == config.probe["part_no"]
    except WebError:
        return False


def site_config(fetcher: Fetcher, base: str, stored: dict | None, model_of: Callable[[], Model], product_urls: Callable[[SiteConfig], Iterable[str]], confirm: Callable[[list[dict]], bool], save: Callable[[dict], None], shorten: Callable[[str], str] = lambda text: text) -> SiteConfig:
    """The configuration to use for a site.

    A stored one while its probe holds; the API's if the site has it; else a proposal, made anew once if its sample has
    problems, confirmed with the sample's parts, and saved with the first of them as its probe.
    """
    known = SiteConfig.from_dict(stored) if stored is not None else None
    if known is not None and still_valid(fetcher, base, known):
        return known
    if site_api.is_api(fetcher, base):
        return SiteConfig("api")
    wrong: list[str] = []
    for _ in range(TRIES):
        found = propose(fetcher, model_of(), base, shorten)
        parts, wrong = sample(fetcher, found, product_urls)
        if not wrong:
            break
    else:
        raise WebError(f"The site can't be read reliably: {'; '.join(wrong)}.")
    if not confirm(parts):
        raise WebError("The sample was not confirmed.")
    if parts:
        found = replace(found, probe={"url": parts[0]["url"], "part_no": parts[0]["part_no"]})
    save(found.to_dict())
    return found

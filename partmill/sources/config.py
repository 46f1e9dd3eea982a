"""Site configurations: what they may hold and what is wrong with one."""

from __future__ import annotations

import dataclasses
import re
from dataclasses import dataclass, field


@dataclass
class SiteConfig:
    """How parts are found on a site and read from its pages."""

    platform: str
    enumeration: dict = field(default_factory=dict)
    selectors: dict = field(default_factory=dict)
    search_url_template: str | None = None
    probe: dict | None = None
    page_budget: int = 10_000

    def to_dict(self) -> dict:
        return dataclasses.asdict(self)

    @classmethod
    def from_dict(cls, values: dict) -> SiteConfig:
        """Unknown keys are ignored."""
        return cls(**{f.name: values[f.name] for f in dataclasses.fields(cls) if f.name in values})


def _text(value) -> bool:
    return isinstance(value, str) and bool(value.strip())


def _pattern_problem(name: str, value) -> list[str]:
    try:
        re.compile(value)
    except re.error as error:
        return [f"enumeration.{name}: the pattern does not compile ({error})"]
    return []


def problems(config: SiteConfig) -> list[str]:
    """Every problem of a generic configuration; other platforms need none of it."""
    if config.platform != "generic":
        return []
    out = []
    if not _text(config.selectors.get("part_no")):
        out.append("selectors.part_no: a selector is missing")
    rows = config.selectors.get("attributes")
    if rows is not None and not (isinstance(rows, dict) and all(k in rows for k in ("row", "label", "value"))):
        out.append("selectors.attributes: row, label and value are needed")
    how = config.enumeration
    required = {"sitemap": ["sitemap_url", "product_url_pattern"], "category_crawl": ["start_urls", "product_link_pattern"]}
    strategy = how.get("strategy")
    if strategy not in required:
        return [*out, f"enumeration.strategy: {strategy!r} is unknown; known are {', '.join(required)}"]
    for name in required[strategy]:
        value = how.get(name)
        if name == "start_urls":
            if not (isinstance(value, list) and value):
                out.append(f"enumeration.{name}: {strategy} needs at least one")
        elif not _text(value):
            out.append(f"enumeration.{name}: {strategy} needs a text")
        elif name.endswith("pattern"):
            out += _pattern_problem(name, value)
    if strategy == "category_crawl" and how.get("category_link_pattern") is not None:
        out += _pattern_problem("category_link_pattern", how["category_link_pattern"])
    return out


def probe_holds(config: SiteConfig, part_no_at) -> bool:
    """Whether the stored probe product still has its number; ``part_no_at`` looks a URL up.  No probe is no objection."""
    return config.probe is None or part_no_at(config.probe.get("url")) == config.probe.get("part_no")


def sample_gate(parsed: list[dict | None], texts: list[str], least: int = 3) -> list[str]:
    """Problems of a sample of parsed pages: too few parts, or numbers that don't show on their page."""
    found = [(p, t) for p, t in zip(parsed, texts) if p]
    out = []
    if not parsed:
        out.append("no product pages found")
    elif len(found) < min(least, len(parsed)):
        out.append(f"only {len(found)} of {len(parsed)} sample pages gave a part")
    squash = lambda s: "".join((s or "").split())
    out += [f"part number {p['part_no']} does not show on its page" for p, t in found if squash(p["part_no"]) not in squash(t)]
    return out


def resolve(stored: SiteConfig | None, usable, detect, discover, gate, confirm, attempts: int = 2) -> SiteConfig | None:
    """A configuration for a site: the stored one while usable, a detected platform, or a discovered one that passes the
    gate (tried ``attempts`` times) and is confirmed."""
    if stored is not None and usable(stored):
        return stored
    if detect():
        return SiteConfig(platform="api")
    for _ in range(attempts):
        config = discover()
        if config is not None and not problems(config) and not gate(config):
            return config if confirm(config) else None
    return None

"""URLs of one site: normal form, next page, Python-dialect pattern filters."""

from __future__ import annotations

import re
from urllib.parse import parse_qs, urlencode, urljoin, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize(href: str, base: str, paging: str | None = None) -> str | None:
    """``href`` resolved against ``base``; None if it leaves the host; fragment and query dropped but for all values of
    the paging parameter."""
    try:
        url, home = urlsplit(urljoin(base, href)), urlsplit(base)
    except ValueError:
        return None
    if url.netloc != home.netloc:
        return None
    kept = ""
    if paging:
        values = parse_qs(url.query, keep_blank_values=True).get(paging)
        kept = urlencode({paging: values}, doseq=True) if values else ""
    return urlunsplit((url.scheme, url.netloc, url.path, kept, ""))


def next_page(url: str, paging: str) -> str:
    """The URL with its paging parameter one higher (2 if there is none)."""
    parts = urlsplit(url)
    query = parse_qs(parts.query, keep_blank_values=True)
    query[paging] = [str(int(query.get(paging, ["1"])[0]) + 1)]
    return urlunsplit(parts._replace(query=urlencode(query, doseq=True)))


def normalize_url(href: Column, base: Column, paging: str | None = None) -> Column:
    """:func:`normalize` for columns, in Arrow batches; a null gives null."""

    def run(hrefs: pd.Series, bases: pd.Series) -> pd.Series:
        return pd.Series([normalize(h, b, paging) if h is not None and b is not None else None for h, b in zip(hrefs, bases)], dtype=object)

    return F.pandas_udf(run, "string")(href, base)


def matches(col: Column, pattern: str) -> Column:
    """``re.search`` with a Python pattern (site configurations hold such); a null gives false."""
    found = re.compile(pattern)

    def run(values: pd.Series) -> pd.Series:
        return pd.Series([v is not None and found.search(v) is not None for v in values], dtype=bool)

    return F.pandas_udf(run, "boolean")(col)

"""Keys of parts, sites and pages, and other small text functions, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from partmill.functions.text import WHITE, blank, squash, strip


def normalize_key(col: Column) -> Column:
    """Upper case, then only ``A-Z`` and ``0-9``; null gives ``""``."""
    return F.regexp_replace(F.upper(blank(col)), "[^A-Z0-9]", "")


def plain_key(text: str | None) -> str:
    """:func:`normalize_key` of one text."""
    return "".join(c for c in (text or "").upper() if c.isascii() and c.isalnum())


def domain_key(col: Column) -> Column:
    """A host as part of a file name: lower case, one leading ``www.`` dropped, odd characters as ``_``."""
    return F.regexp_replace(F.regexp_replace(F.lower(blank(col)), r"^www\.", ""), "[^a-z0-9.-]", "_")


def percent_encode(col: Column) -> Column:
    """Percent encoding that keeps ``/`` and ``~`` and writes blanks as ``%20``."""
    out = F.url_encode(blank(col))
    for old, new in (("+", "%20"), ("%2F", "/"), ("*", "%2A"), ("%7E", "~")):
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def authority(col: Column) -> Column:
    """Host and port of a URL in lower case; ``""`` if it has none."""
    return blank(F.lower(F.try_parse_url(col, F.lit("AUTHORITY"))))


def cell_text(col: Column) -> Column:
    """A numeric cell as text: whole numbers without a decimal point; null gives ``""``."""
    return blank(F.when(col == F.floor(col), col.cast("decimal(38,0)").cast("string")).otherwise(col.cast("string")))


def html_sample(col: Column, limit: int = 30_000) -> Column:
    """Page text for a sample: script and style blocks dropped, white space collapsed, cut, a torn tag's ``<`` dropped."""
    bare = F.regexp_replace(F.regexp_replace(blank(col), r"(?is)<script\b.*?</script>", ""), r"(?is)<style\b.*?</style>", "")
    return F.regexp_replace(F.left(F.regexp_replace(bare, WHITE, " "), F.lit(limit)), "<+$", "")


def is_blank_page(text: Column, least: int = 40) -> Column:
    """Fewer than ``least`` characters that are no white space."""
    return F.length(squash(text)) < least


def is_contents_page(text: Column, page_no: Column, pages: int = 15) -> Column:
    """A table of contents among the first pages: its heading, or ten lines that end in dots and a page number."""
    leaders = F.regexp_count(blank(text), F.lit(r"(?md)\.{5,}\s*\d+\s*$")) >= 10
    return (page_no <= pages) & (blank(text).rlike("(?i)table of contents") | leaders)


LINE_ENDS = r"\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085  ]"


def page_title(text: Column) -> Column:
    """The first line that is not blank, stripped; ``""`` if there is none."""
    lines = F.filter(F.transform(F.split(blank(text), LINE_ENDS), strip), lambda x: x != "")
    return blank(F.get(lines, F.lit(0)))


def is_digital(pages, mean: int = 200, sample: int = 20):
    """doc, is_digital: the mean length of the first pages of each document is at least ``mean``.

    pages: doc, page_no, text.  Documents whose pages are all beyond the sample are not digital.
    """
    first = F.when(F.col("page_no") <= sample, F.length(blank(F.col("text"))))
    return pages.groupBy("doc").agg(F.coalesce(F.avg(first) >= mean, F.lit(False)).alias("is_digital"))


def snapshot_age(fetched_at: Column, now: Column) -> Column:
    """``today``, ``yesterday`` or ``n days ago``."""
    days = F.date_diff(now, fetched_at)
    return F.when(days <= 0, "today").when(days == 1, "yesterday").otherwise(F.concat(days.cast("string"), F.lit(" days ago")))


def estimated_minutes(seconds: Column) -> Column:
    """Seconds as whole minutes, rounded up."""
    return F.ceil(seconds / 60).cast("bigint")

"""A whole run: pages or site units to a catalog, matched, merged with what was there, and stored.

Fetching, model calls and decisions are injected callables, so the runs work without a network.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partmill.errors import LLMError, PdfError, WebError
from partmill.functions.keys import is_contents_page, is_digital, plain_key
from partmill.operators import catalog, match, merge, pages as page_ops
from partmill.session import durable
from partmill.sources.store import Store

#: Parts that a run holds before it writes them.
HELD = 10_000
PART = "part_no string, category string, subcategory string, series string, description string, attributes map<string,string>, pos long"


@dataclass
class Result:
    """What a run gave."""

    parts: DataFrame
    report: DataFrame | None = None
    stopped_early: bool = False
    cache_hit: bool = False
    notices: list[str] = field(default_factory=list)


def filtered(parts: DataFrame, entries: DataFrame | None) -> tuple[DataFrame, DataFrame | None]:
    if entries is None:
        return parts, None
    report = match.match_report(entries, parts)
    return match.matched_parts(parts, report), report


def run_pages(
    spark: SparkSession,
    store: Store,
    key: str,
    pages: DataFrame,
    entries: DataFrame | None = None,
    sections_of: Callable[[str, int], Iterable[tuple]] | None = None,
    extractor: Callable[[str, int, str], dict] | None = None,
    cancelled: Callable[[], bool] = lambda: False,
    progress: Callable[[str, float], None] = lambda message, part: None,
    batch: int = 1000,
) -> Result:
    """One document's pages (page_no, text) to a catalog.

    A complete snapshot of the same content hash (``key``) is reused.  ``sections_of`` reads a table of contents (its
    text and the number of pages) into (ord, name, category, start_page, end_page) and is called only if there is one.
    Pages are read in batches of ``batch`` pages, each written before the next; when the run is cancelled or the model
    fails, what was read is kept as an incomplete snapshot; a failure before the first batch is an error.
    """
    stored = store.read("pages", key)
    if stored and stored[1].get("complete"):
        parts = stored[0]
        chosen, report = filtered(parts, entries)
        store.record_run(source=key, kind="pages", parts=parts.count(), cache_hit=True, stopped_early=False)
        return Result(chosen, report, cache_hit=True)
    tagged = pages.select(F.lit(key).alias("doc"), F.col("page_no").cast("int").alias("page_no"), "text")
    if not (digital := is_digital(tagged).first()) or not digital.is_digital:
        raise PdfError("The document has no text that can be read. Scanned documents are not supported.")
    total = tagged.count()
    contents = [r.text for r in tagged.where(is_contents_page(F.col("text"), F.col("page_no"))).orderBy("page_no").collect()]
    raw = list(sections_of("\n".join(contents), total)) if contents and sections_of else []
    sections = catalog.clean_sections(spark.createDataFrame([tuple(None if x is None else str(x) if i > 2 else x for i, x in enumerate(r)) for r in raw], "ord int, name string, category string, start_page string, end_page string"), total)
    last = tagged.agg(F.max("page_no")).first()[0] or 0
    results, notices = None, []
    for start in range(0, last + 1, batch):
        if cancelled():
            notices = [f"Cancelled after page {max(0, start - 1)} of {total}."]
            break
        progress(f"Pages from {max(1, start)} of {total}", start / (last + 1))
        try:
            read = durable(page_ops.page_results(tagged.where(F.col("page_no").between(start, start + batch - 1)), extractor, sections))
        except Exception as failure:
            if results is None or not is_model_failure(failure):
                raise
            notices = [f"Stopped after page {start - 1} of {total}: the model gave no answer."]
            break
        results = read if results is None else results.unionByName(read)
    if results is None:
        results = page_ops.page_results(tagged.limit(0))
    found = catalog.validate_catalog(results, tagged, sections)
    parts = durable(found.select("part_no", "category", "subcategory", "series", "description", F.map_from_arrays(F.array(), F.array()).cast("map<string,string>").alias("attributes"), F.col("sequence").alias("pos"), F.col("sequence")))
    store.write("pages", key, parts, complete=not notices)
    chosen, report = filtered(parts, entries)
    store.record_run(source=key, kind="pages", parts=parts.count(), cache_hit=False, stopped_early=bool(notices))
    return Result(chosen, report, stopped_early=bool(notices), notices=notices)


def is_model_failure(failure: Exception) -> bool:
    """Whether an error is the model's, on the driver or out of a worker."""
    return isinstance(failure, LLMError) or LLMError.__name__ in str(failure)


def run_units(
    spark: SparkSession,
    store: Store,
    site: str,
    units: list[str],
    collect: Callable[[str], list[dict]],
    entries: DataFrame | None = None,
    choose_cached: Callable[[dict], bool] = lambda info: True,
    cancelled: Callable[[], bool] = lambda: False,
    progress: Callable[[str, float], None] = lambda message, part: None,
) -> Result:
    """A site's units of work (categories or product pages), each collected whole by ``collect``, to a catalog.

    A complete snapshot is reused if ``choose_cached`` says so; an incomplete one is resumed: its finished units are
    skipped and its parts come first.  A unit that fails gives nothing; what was collected before is kept.  The
    collection stops early when it covers ``entries`` with this run's parts alone.
    """
    stored = store.read("site", site)
    if stored and stored[1].get("complete") and choose_cached(stored[1]):
        chosen, report = filtered(stored[0], entries)
        store.record_run(source=site, kind="site", parts=chosen.count(), cache_hit=True, stopped_early=False)
        return Result(chosen, report, cache_hit=True)
    resumed = stored is not None and not stored[1].get("complete")
    old = stored[0] if resumed else spark.createDataFrame([], PART)
    done = list(stored[1].get("progress", [])) if resumed else []
    left = [r.unit_key for r in merge.remaining_units(spark.createDataFrame([(u, i) for i, u in enumerate(units)], "unit_key string, i int"), spark.createDataFrame([(u,) for u in done], "unit_key string")).orderBy("i").collect()]
    wanted = None if entries is None else durable(entries.select(match.normalize_key(F.col("raw")).alias("k")).distinct())
    fields = [f.split()[0] for f in PART.split(", ")[:-1]]
    blank = lambda name: {} if name.startswith("attributes") else ""
    written, rows, taken = spark.createDataFrame([], PART), [], 0

    def write_held() -> None:
        """What was collected leaves the driver; a run holds the parts of some units only."""
        nonlocal written, rows, taken
        new = spark.createDataFrame([tuple(p.get(f) or blank(f) for f in fields) + (taken + i,) for i, p in enumerate(rows)], PART)
        written, taken, rows = written.unionByName(durable(new)), taken + len(rows), []

    open_keys = None if wanted is None else wanted.count()
    stopped, error = False, None
    for n, unit in enumerate(left):
        if cancelled():
            stopped = True
            break
        progress(unit, n / max(1, len(left)))
        try:
            got = collect(unit)
        except (WebError, LLMError) as failure:
            stopped, error = True, failure
            break
        rows += got
        done.append(unit)
        if len(rows) >= HELD:
            write_held()
        if open_keys and got:
            # only keys that are still wanted are asked for, whatever the length of the list
            keys = spark.createDataFrame([(k,) for k in sorted({plain_key(p["part_no"]) for p in got})], "k string")
            wanted = durable(wanted.join(keys, "k", "left_anti"))
            open_keys = wanted.count()
            if not open_keys:
                stopped = n + 1 < len(left)
                break
    if error is not None and not rows and not taken and not resumed:
        raise error
    write_held()
    parts = durable(merge.merge_keep_first(old, written).select(*written.columns))
    notices = drift(stored[0], parts) if stored and not resumed and not stopped else []
    store.write("site", site, parts, complete=not stopped, **({"progress": done} if stopped else {}))
    chosen, report = filtered(parts, entries)
    store.record_run(source=site, kind="site", parts=chosen.count(), cache_hit=False, stopped_early=stopped)
    return Result(chosen, report, stopped_early=stopped, notices=[*notices, *([str(error)] if error else [])])


def drift(old: DataFrame, new: DataFrame) -> list[str]:
    """What looks wrong about a new complete collection against the one before."""
    sizes = [df.agg(F.count("*").alias("n"), F.count_if(F.size("attributes") > 0).alias("a")).first() for df in (old, new)]
    out = []
    if sizes[1].n < 0.5 * sizes[0].n:
        out.append(f"The catalog shrank from {sizes[0].n} to {sizes[1].n} parts.")
    if sizes[0].n and sizes[0].a > 0.5 * sizes[0].n and sizes[1].a == 0:
        out.append("No part has attributes any more.")
    return out

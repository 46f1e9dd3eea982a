"""Parts of parsed pages into a checked catalog: on-page check, sections, keep-first, numbering, report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from partmill.functions.text import blank, squash
from partmill.operators.match import keep_first
from partmill.session import durable


def clean_sections(raw: DataFrame, total_pages: int) -> DataFrame:
    """ord, name, category, start_page, end_page of usable sections, by start page.

    raw: ord, name, category, start_page, end_page as text.  Starts that are no whole number or out of range are
    dropped; an end that is missing becomes the page before the next start, or the last page; ends are clamped.
    """
    start = F.col("start_page").try_cast("int")
    kept = raw.withColumn("start_page", start).where(F.col("start_page").between(1, total_pages))
    order = Window.orderBy("start_page", "ord")  # tens of sections, one row each
    end = F.coalesce(F.col("end_page").try_cast("int"), F.lead("start_page").over(order) - 1, F.lit(total_pages))
    return kept.select("ord", "name", "category", "start_page", F.least(end, F.lit(total_pages)).alias("end_page"))


def section_for_page(pages: DataFrame, sections: DataFrame, most: int = 10_000) -> DataFrame:
    """page_no, name, category of the first section (by ``ord``) that holds each page; null if none does.

    The sections of a document are few; they are broadcast only after their number was checked.
    """
    if sections.limit(most + 1).count() <= most:
        sections = F.broadcast(sections)
    hit = pages.select("page_no").distinct().join(sections, F.col("page_no").between(F.col("start_page"), F.col("end_page")), "left")
    return hit.groupBy("page_no").agg(F.min_by(F.struct("name", "category"), "ord").alias("s")).select("page_no", "s.name", "s.category")


def on_page(part_no: Column, squashed: Column) -> Column:
    """Whether the part number, without white space, stands in the page, without white space (``""`` always does)."""
    return F.contains(squashed, squash(part_no))


def checked_parts(results: DataFrame, pages: DataFrame) -> DataFrame:
    """page_no, idx, subcategory, part_no, series, description, is_on_page of the parts of pages that aren't skipped.

    results: page_no, subcategory, skipped, parts (array of idx, part_no, series, description); pages: page_no, text.  The
    parts are checked within their page's row, so a page's text is joined once and never copied to its parts.
    """
    joined = results.where("not skipped").select("page_no", "subcategory", "parts").join(pages.select("page_no", squash(F.col("text")).alias("squashed")), "page_no", "left")
    marked = F.transform("parts", lambda p: F.struct(p["idx"].alias("idx"), p["part_no"].alias("part_no"), p["series"].alias("series"), p["description"].alias("description"), F.coalesce(on_page(p["part_no"], F.col("squashed")), F.lit(False)).alias("is_on_page")))
    return joined.select("page_no", "subcategory", F.inline(marked)).select("page_no", "idx", "subcategory", "part_no", "series", "description", "is_on_page")


def first_parts(checked: DataFrame) -> DataFrame:
    """The first part of each number among those on their page (a partial aggregate, so a hot number is no hot task)."""
    return keep_first(checked.where("is_on_page").drop("is_on_page"), ["part_no"], ["page_no", "idx"])


def numbered(rows: DataFrame, page: str = "page_no", idx: str = "idx") -> DataFrame:
    """``sequence`` 1..N in the order of (page, idx), without a global window.

    The rows are range partitioned and sorted; a row's number is its place in its partition and the number of rows in
    the partitions before, of which there is one row for each partition.  A page that holds most rows is split as well.
    """
    order = [F.col(page), F.col(idx)]
    marked = durable(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("mark", F.monotonically_increasing_id()))
    part = F.shiftright("mark", 33)
    counts = marked.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = F.col("mark").bitwiseAND(F.lit((1 << 33) - 1))
    return marked.withColumn("part", part).join(F.broadcast(offsets), "part").withColumn("sequence", (F.col("offset") + inside + 1).cast("bigint")).drop("part", "mark", "offset")


def validate_catalog(results: DataFrame, pages: DataFrame, sections: DataFrame) -> DataFrame:
    """sequence, part_no, category, subcategory, series, description: parts on their page, first of each number."""
    kept = first_parts(checked_parts(results, pages))
    placed = numbered(kept).join(section_for_page(pages, sections), "page_no", "left")
    return placed.select("sequence", "page_no", "part_no", blank(F.col("category")).alias("category"), "subcategory", "series", "description")


def validation_report(results: DataFrame, pages: DataFrame) -> DataFrame:
    """One row: total_parts, pages_processed, pages_skipped, dropped, duplicates (counts).

    The lists behind the counts are tables: see :func:`dropped_parts` and :func:`duplicate_parts`.
    """
    numbers = checked_parts(results, pages).groupBy("part_no").agg(F.count_if("is_on_page").alias("held"), F.count_if(~F.col("is_on_page")).alias("missed"))
    some = F.coalesce(F.sum("held"), F.lit(0))
    total = F.count_if(F.col("held") > 0)
    counts = numbers.agg(total.alias("total_parts"), F.coalesce(F.sum("missed"), F.lit(0)).alias("dropped"), (some - total).alias("duplicates"))
    routes = results.agg(F.count_if(~F.col("skipped")).alias("pages_processed"), F.count_if("skipped").alias("pages_skipped"))
    return counts.crossJoin(routes)  # one row each


def dropped_parts(results: DataFrame, pages: DataFrame) -> DataFrame:
    return checked_parts(results, pages).where("not is_on_page").select("page_no", "idx", "part_no")


def duplicate_parts(results: DataFrame, pages: DataFrame) -> DataFrame:
    """One row for each repeated occurrence."""
    checked = checked_parts(results, pages)
    return checked.where("is_on_page").join(first_parts(checked).select("page_no", "idx"), ["page_no", "idx"], "left_anti").select("page_no", "idx", "part_no")

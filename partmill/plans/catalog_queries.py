"""Queries of the catalog operators over the test tables, each over its whole tables, and their SQL."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partmill.errors import WebError
from partmill.functions import keys, urls
from partmill.functions.text import blank, squash
from partmill.operators import catalog, match, merge, pages
from partmill.plans import runs
from partmill.sources import config, html, product_api, store, xlsx
from partmill.sources import enumerate as site_urls
from partmill.session import configure, ensure_checkpoint_dir
from partmill.streaming import incremental

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    """Registers a query and its SQL under the function's name."""

    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLE[function.__name__] = sql
        return function

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    configure(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- scalar functions -------------------------------------------------------------------------------------------

NORMAL = "regexp_replace(upper(replace(replace(coalesce({0}, ''), 'ß', 'ss'), 'ŉ', 'ʼn')), '[^A-Z0-9]', '', 'g')"
SPACE = r"[\s\x{1c}-\x{1f}\x{85}\x{0b}\p{Z}]"
BARE = rf"regexp_replace(coalesce(text, ''), '{SPACE}+', '', 'g')"


@query(f"SELECT entry_id, {NORMAL.format('raw')} AS norm_key FROM filter_entries")
def normalize_key(spark, sf_dir):
    return table(spark, sf_dir, "filter_entries").select("entry_id", keys.normalize_key(F.col("raw")).alias("norm_key"))


@query(f"SELECT doc_id, length({BARE}) AS n FROM documents")
def squash_length(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.length(squash(F.col("text"))).cast("bigint").alias("n"))


@query(f"SELECT doc_id FROM documents WHERE length({BARE}) < 40")
def blank_pages(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(keys.is_blank_page(F.col("text"))).select("doc_id")


@query("SELECT coalesce(source, '') AS doc, coalesce(avg(length(coalesce(text, ''))) FILTER (page_no <= 20) >= 200, false) AS is_digital FROM documents GROUP BY 1")
def digital_documents(spark, sf_dir):
    return keys.is_digital(table(spark, sf_dir, "documents").select(blank(F.col("source")).alias("doc"), "page_no", "text"))


def with_contents_lines(spark, sf_dir):
    """Pages with a table of contents before their text, by kind of their id: a title, ten or nine lines with dots, none."""
    lines = lambda n: F.array_join(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.concat(F.lit("Chapter "), F.lit("."), F.repeat(F.lit("."), 6), F.lit(" "), i.cast("string"))), "\n")
    kind = F.col("doc_id") % 4
    added = F.when(kind == 0, F.lit("Table of\tContents\nTABLE OF CONTENTS")).when(kind == 1, lines(10)).when(kind == 2, lines(9)).otherwise(F.lit("contents"))
    return table(spark, sf_dir, "documents").select("doc_id", "page_no", F.concat(added, F.lit("\n"), blank(F.col("text"))).alias("text"))


@query("SELECT doc_id FROM documents WHERE page_no <= 15 AND doc_id % 4 IN (0, 1)")
def contents_pages(spark, sf_dir):
    return with_contents_lines(spark, sf_dir).where(keys.is_contents_page(F.col("text"), F.col("page_no"))).select("doc_id")


@query(rf"SELECT doc_id, coalesce(list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '\r\n|[\n\r\x{{0b}}\x{{0c}}\x{{1c}}-\x{{1e}}\x{{85}}\x{{2028}}\x{{2029}}]'), lambda x: regexp_replace(x, '^{SPACE}+|{SPACE}+$', '', 'g')), lambda x: x <> '')[1], '') AS title FROM documents")
def page_titles(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", keys.page_title(F.col("text")).alias("title"))


@query("SELECT doc_id, sha256(coalesce(text, '')) AS sha256 FROM documents")
def content_hashes(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", store.content_hash(blank(F.col("text"))).alias("sha256"))


@query("SELECT rec_id, replace(url_encode(coalesce(part_no, '')), '%2F', '/') AS quoted FROM part_records")
def percent_encode(spark, sf_dir):
    return table(spark, sf_dir, "part_records").select("rec_id", keys.percent_encode(F.col("part_no")).alias("quoted"))


@query("SELECT s_suppkey, coalesce(CASE WHEN s_acctbal = floor(s_acctbal) THEN s_acctbal::BIGINT::VARCHAR ELSE s_acctbal::VARCHAR END, '') AS cell FROM supplier")
def cell_text(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_suppkey", keys.cell_text(F.col("s_acctbal")).alias("cell"))


@query("SELECT snapshot_id, CASE WHEN d <= 0 THEN 'today' WHEN d = 1 THEN 'yesterday' ELSE d || ' days ago' END AS age, ceil(crawl_seconds / 60)::BIGINT AS minutes FROM (SELECT *, date_diff('day', fetched_at::TIMESTAMP, TIMESTAMP '2026-01-01') AS d FROM web_snapshots)")
def snapshot_age(spark, sf_dir):
    now = F.lit("2026-01-01").cast("timestamp")
    return table(spark, sf_dir, "web_snapshots").select("snapshot_id", keys.snapshot_age(F.col("fetched_at"), now).alias("age"), keys.estimated_minutes(F.col("crawl_seconds")).alias("minutes"))


# ---- part lists against the list of references -------------------------------------------------------------------

REPORT_SQL = f"""
c AS (SELECT {NORMAL.format('part_no')} AS k, list_sort(list(DISTINCT part_no)) AS nos FROM (SELECT coalesce(ref_no, '') AS part_no FROM ref_parts) GROUP BY 1),
report AS (SELECT e.entry_id, coalesce(e.raw, '') AS filter_raw,
  CASE WHEN x.part_no IS NOT NULL THEN 'exact' WHEN len(c.nos) = 1 THEN 'normalized' WHEN len(c.nos) > 1 THEN 'collision' ELSE 'unmatched' END AS match_type,
  CASE WHEN x.part_no IS NOT NULL THEN [x.part_no] ELSE coalesce(c.nos, []) END AS nos
  FROM filter_entries e LEFT JOIN (SELECT DISTINCT coalesce(ref_no, '') AS part_no FROM ref_parts) x ON x.part_no = coalesce(e.raw, '') LEFT JOIN c ON c.k = {NORMAL.format('e.raw')})"""


def reference_catalog(spark, sf_dir):
    """The list as a catalog; its numbers are their own order."""
    return table(spark, sf_dir, "ref_parts").select(F.col("ref_no").alias("part_no"), F.col("ref_no").alias("pos"), "title")


def reported(spark, sf_dir):
    return match.match_report(table(spark, sf_dir, "filter_entries"), reference_catalog(spark, sf_dir))


@query(f"WITH {REPORT_SQL} SELECT entry_id, filter_raw, match_type, array_to_string(nos, ', ') AS matched_part_nos, CASE match_type WHEN 'collision' THEN len(nos) || ' {match.COLLISION}' ELSE '' END AS note FROM report")
def match_report(spark, sf_dir):
    return reported(spark, sf_dir).withColumn("matched_part_nos", F.array_join("matched_part_nos", ", "))


@query(f"WITH {REPORT_SQL} SELECT DISTINCT ref_no AS part_no, title FROM ref_parts WHERE ref_no IN (SELECT unnest(nos) FROM report)")
def matched_parts(spark, sf_dir):
    return match.matched_parts(reference_catalog(spark, sf_dir), reported(spark, sf_dir)).select("part_no", "title")


@query(f"WITH {REPORT_SQL} SELECT match_type, count(*) AS n FROM report GROUP BY 1")
def match_type_summary(spark, sf_dir):
    return match.summary(reported(spark, sf_dir))


@query(f"SELECT e.entry_id, r.ref_no AS part_no, min(r.n) AS pos FROM filter_entries e JOIN (SELECT ref_no, 0 AS n FROM ref_parts UNION ALL SELECT lower(ref_no), 1 FROM ref_parts UNION ALL SELECT ref_no, 2 FROM ref_parts) r ON {NORMAL.format('e.raw')} = {NORMAL.format('r.ref_no')} GROUP BY 1, 2")
def search_lookup(spark, sf_dir):
    listed = table(spark, sf_dir, "ref_parts").select(F.col("ref_no").alias("part_no"))
    answers = listed.withColumn("pos", F.lit(0)).unionByName(listed.select(F.lower("part_no").alias("part_no"), F.lit(1).alias("pos"))).unionByName(listed.withColumn("pos", F.lit(2)))
    return match.lookup(table(spark, sf_dir, "filter_entries"), answers).select("entry_id", "part_no", "pos")


COVERED_SQL = f"SELECT {{0}} AS entries, NOT EXISTS (SELECT 1 FROM filter_entries e WHERE {{1}} AND {NORMAL.format('e.raw')} NOT IN (SELECT {NORMAL.format('ref_no')} FROM ref_parts)) AS covered"
LISTED_SQL = f"{NORMAL.format('e.raw')} IN (SELECT {NORMAL.format('ref_no')} FROM ref_parts)"


@query(COVERED_SQL.format("'all'", "true") + " UNION ALL " + COVERED_SQL.format("'listed'", LISTED_SQL))
def early_stop_coverage(spark, sf_dir):
    """Whether the list covers all entries, and those that it lists."""
    wanted = table(spark, sf_dir, "filter_entries").select(keys.normalize_key(F.col("raw")).alias("k"))
    found = table(spark, sf_dir, "ref_parts").select(keys.normalize_key(F.col("ref_no")).alias("k"))
    rows = [("all", match.is_covered(wanted, found, "k")), ("listed", match.is_covered(wanted.join(found, "k", "left_semi"), found, "k"))]
    return spark.createDataFrame(rows, "entries string, covered boolean")


# ---- catalog pages ----------------------------------------------------------------------------------------------

PER_PAGE = 50


def catalog_parts(spark, sf_dir):
    """The rows of ``part`` as catalog lines: page, position, number."""
    return table(spark, sf_dir, "part").select(
        (F.floor(F.col("p_partkey") / PER_PAGE) + 1).cast("int").alias("page_no"), (F.col("p_partkey") % PER_PAGE).cast("int").alias("idx"), F.concat_ws("-", "p_brand", F.col("p_partkey").cast("string")).alias("part_no"), "p_type", "p_size"
    )


def catalog_pages(spark, sf_dir):
    """Page texts made of ``part``: a heading, a header and one line for each of at most 50 parts."""
    lines = catalog_parts(spark, sf_dir).select("page_no", "idx", F.concat_ws("  ", "part_no", "p_type", F.col("p_size").cast("string")).alias("line"))
    text = F.concat(F.lit("CATALOG PARTS\nPART No.  Type  Size\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "line"))), lambda x: x["line"]), "\n"))
    return lines.groupBy("page_no").agg(text.alias("text")).select(F.lit("catalog").alias("doc"), "page_no", "text")


@query(f"SELECT (p_partkey // {PER_PAGE} + 1)::INT AS page_no, (p_partkey % {PER_PAGE})::INT AS idx, p_brand || '-' || p_partkey AS part_no, 'CATALOG PARTS' AS series, 'Type: ' || p_type || ', Size: ' || p_size AS description FROM part")
def parse_tables_roundtrip(spark, sf_dir):
    return pages.parse_pages(catalog_pages(spark, sf_dir)).select("page_no", F.inline("parts"))


LAYOUTS = 6


def layout_pages(spark, sf_dir):
    """Pages made of ``part`` in six layouts by page number: labels on both sides, a description with a quantity, two parts
    in a line, a header without labels, rows with torn or missing numbers, and text without a table."""
    parts = catalog_parts(spark, sf_dir)
    size, kind = F.col("p_size").cast("string"), F.col("page_no") % LAYOUTS
    line = (
        F.when(kind == 0, F.concat_ws(" ", size, "part_no", "p_type"))
        .when(kind == 1, F.concat_ws(" ", "part_no", F.lit("new model of"), "p_type", size))
        .when(kind == 2, F.concat_ws(" ", "part_no", size, F.concat(F.lit("M-"), "part_no"), F.lit("x")))
        .when(kind == 3, F.col("part_no"))
        .when(kind == 4, F.when(F.col("idx") % 2 == 0, F.concat_ws(" ", F.lit("AB-"), size)).otherwise(F.concat_ws(" ", "p_type", size)))
        .otherwise(F.concat_ws(" ", F.lit("some plain words about parts of type"), "p_type"))
    )
    header = F.element_at(F.array(*[F.lit(t) for t in ("FITTINGS\nOF STEEL\nSize  PART No.  Type", "KITS\nPart No.\tDescription\tQty", "PAIRS\nPART No.  Size  PART No.  Size", "LIST\nPART No.", "ODD\nPART No.  Size", "TEXT")]), kind + 1)
    grouped = parts.select("page_no", "idx", kind.alias("kind"), header.alias("header"), line.alias("line")).groupBy("page_no", "kind", "header").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "line"))), lambda x: x["line"]), "\n").alias("lines"))
    return grouped.select(F.lit("layouts").alias("doc"), "page_no", F.concat_ws("\n", "header", "lines").alias("text"))


LAYOUT_SQL = f"""
p AS (SELECT (p_partkey // {PER_PAGE} + 1)::INT AS page_no, (p_partkey % {PER_PAGE})::INT AS i, p_brand || '-' || p_partkey AS part_no, p_type, p_size FROM part),
k AS (SELECT *, page_no % {LAYOUTS} AS kind, row_number() OVER (PARTITION BY page_no ORDER BY i)::INT - 1 AS n FROM p)"""


@query(f"""WITH {LAYOUT_SQL}
SELECT page_no, n AS idx, part_no, 'FITTINGS OF STEEL' AS series, 'Size: ' || p_size || ', Type: ' || p_type AS description FROM k WHERE kind = 0
UNION ALL SELECT page_no, n, part_no, 'KITS', 'new model of ' || p_type || ', Qty: ' || p_size FROM k WHERE kind = 1
UNION ALL SELECT page_no, 2 * n, part_no, 'PAIRS', 'Size: ' || p_size FROM k WHERE kind = 2
UNION ALL SELECT page_no, 2 * n + 1, 'M-' || part_no, 'PAIRS', 'Size: x' FROM k WHERE kind = 2""")
def parse_page_rows(spark, sf_dir):
    return pages.parse_pages(layout_pages(spark, sf_dir)).select("page_no", F.inline("parts"))


REASONS_SQL = f"""WITH {LAYOUT_SQL}, w AS (SELECT page_no, kind, count(*) AS lines, bool_or(i % 2 = 0) AS torn FROM k GROUP BY 1, 2),
reasons AS (SELECT page_no, '{pages.NOTHING}' AS reason FROM w WHERE kind = 3 AND 3 + lines >= 40 OR kind = 4 AND 4 + 2 * lines >= 40 OR kind = 5 AND 1 + 8 * lines >= 40
UNION ALL SELECT page_no, '{pages.SPACED}' FROM w WHERE kind = 4 AND torn UNION ALL SELECT page_no, '{pages.ODD}' FROM w WHERE kind = 4)"""


@query(REASONS_SQL + " SELECT page_no, reason FROM reasons")
def parse_page_reasons(spark, sf_dir):
    return pages.parse_pages(layout_pages(spark, sf_dir)).select("page_no", F.explode("reasons").alias("reason"))


@query(REASONS_SQL + " SELECT CASE WHEN page_no IN (SELECT page_no FROM reasons) THEN 'fallback' ELSE 'deterministic' END AS route, page_no IN (SELECT page_no FROM reasons) OR kind IN (3, 4, 5) AS skipped, count(*) AS n FROM w GROUP BY 1, 2")
def page_routing_counts(spark, sf_dir):
    return pages.page_results(layout_pages(spark, sf_dir)).groupBy("route", "skipped").agg(F.count("*").alias("n"))


def document_pages(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc"), "page_no", "text")


@query()
def parse_document_rows(spark, sf_dir):
    return pages.parse_pages(document_pages(spark, sf_dir)).select("doc", F.inline("parts"))


SECTIONS = [(0, "First", "Fittings", "1", "3"), (1, "Inner", "Inner fittings", "2", "2"), (2, "Second", "Valves", "4", None), (3, "Third", "Tools", "9", "10000000"), (4, "No page", "None", "x", "5"), (5, "Out", "None", "0", "5")]
SECTION_SQL = "sections(ord, name, category, s, e) AS (VALUES (0, 'First', 'Fittings', 1, 3), (1, 'Inner', 'Inner fittings', 2, 2), (2, 'Second', 'Valves', 4, 8), (3, 'Third', 'Tools', 9, (SELECT max(p_partkey) // 50 + 1 FROM part)))"
PLACED_SQL = "placed AS (SELECT page_no, arg_min(name, ord) AS name, arg_min(category, ord) AS category FROM (SELECT DISTINCT p_partkey // 50 + 1 AS page_no FROM part) p LEFT JOIN sections ON page_no BETWEEN s AND e GROUP BY 1)"


def sections(spark, sf_dir):
    raw = spark.createDataFrame(SECTIONS, "ord int, name string, category string, start_page string, end_page string")
    last = catalog_parts(spark, sf_dir).agg(F.max("page_no")).first()[0]
    return catalog.clean_sections(raw, last or 0)


@query(f"WITH {SECTION_SQL}, {PLACED_SQL} SELECT page_no::INT AS page_no, name, category FROM placed")
def section_for_page(spark, sf_dir):
    return catalog.section_for_page(catalog_pages(spark, sf_dir), sections(spark, sf_dir))


def doubtful_parts(spark, sf_dir):
    """The parts, with invented numbers and repeated rows among them."""
    rows = catalog_parts(spark, sf_dir).select("page_no", "idx", F.lit("CATALOG").alias("subcategory"), "part_no", F.lit("").alias("series"), F.col("p_type").alias("description"))
    invented = rows.where("idx = 0").select("page_no", F.lit(1000).alias("idx"), "subcategory", F.concat(F.lit("GHOST-"), F.col("page_no").cast("string")).alias("part_no"), "series", "description")
    repeated = rows.where("description = 'SMALL'").withColumn("idx", F.col("idx") + 2000)
    every = rows.unionByName(invented).unionByName(repeated)
    parts = F.array_sort(F.collect_list(F.struct("idx", "part_no", "series", "description")))
    return every.groupBy("page_no", "subcategory").agg(parts.alias("parts")).withColumn("skipped", F.lit(False))


@query(f"WITH {SECTION_SQL}, {PLACED_SQL} SELECT row_number() OVER (ORDER BY p_partkey) AS sequence, (p_partkey // 50 + 1)::INT AS page_no, p_brand || '-' || p_partkey AS part_no, coalesce(category, '') AS category, 'CATALOG' AS subcategory, '' AS series, p_type AS description FROM part JOIN placed ON page_no = p_partkey // 50 + 1")
def validate_catalog(spark, sf_dir):
    return catalog.validate_catalog(doubtful_parts(spark, sf_dir), catalog_pages(spark, sf_dir), sections(spark, sf_dir))


@query("SELECT count(*) AS total_parts, count(DISTINCT p_partkey // 50) AS dropped, count(*) FILTER (p_type = 'SMALL') AS duplicates, count(DISTINCT p_partkey // 50) AS pages_processed, 0::BIGINT AS pages_skipped FROM part")
def validation_report(spark, sf_dir):
    return catalog.validation_report(doubtful_parts(spark, sf_dir), catalog_pages(spark, sf_dir))


@query("SELECT DISTINCT (p_partkey // 50 + 1)::INT AS page_no, 1000 AS idx, 'GHOST-' || (p_partkey // 50 + 1) AS part_no FROM part")
def dropped_parts(spark, sf_dir):
    return catalog.dropped_parts(doubtful_parts(spark, sf_dir), catalog_pages(spark, sf_dir))


@query("SELECT (p_partkey // 50 + 1)::INT AS page_no, (p_partkey % 50 + 2000)::INT AS idx, p_brand || '-' || p_partkey AS part_no FROM part WHERE p_type = 'SMALL'")
def duplicate_parts(spark, sf_dir):
    return catalog.duplicate_parts(doubtful_parts(spark, sf_dir), catalog_pages(spark, sf_dir))


@query("SELECT doc_id, row_number() OVER (ORDER BY page_no, doc_id) AS sequence FROM documents WHERE page_no IS NOT NULL")
def sequence_numbers(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").where("page_no is not null").select("page_no", "doc_id")
    return catalog.numbered(rows, "page_no", "doc_id").select("doc_id", "sequence")


# ---- product API ------------------------------------------------------------------------------------------------

TREE_SQL = """
WITH RECURSIVE b AS (SELECT payload_id, body::JSON AS j FROM api_payloads WHERE kind = 'categories' AND json_valid(body)),
n AS (
  SELECT payload_id, (i - 1)::VARCHAR AS path, list[i] AS item, [coalesce(list[i]->>'$.shortDescription', '')] AS names FROM (SELECT payload_id, list, unnest(range(1, len(list) + 1)) AS i FROM (
    SELECT payload_id, CASE json_type(j->'$.categories') WHEN 'ARRAY' THEN json_extract(j, '$.categories[*]') WHEN 'OBJECT' THEN [j->'$.categories'] ELSE [] END AS list FROM b)) WHERE json_type(list[i]) = 'OBJECT'
  UNION ALL
  SELECT payload_id, path || '.' || (i - 1), list[i], list_append(names, coalesce(list[i]->>'$.shortDescription', '')) FROM (SELECT payload_id, path, names, list, unnest(range(1, len(list) + 1)) AS i FROM (
    SELECT payload_id, path, names, CASE json_type(item->'$.subCategories') WHEN 'ARRAY' THEN json_extract(item, '$.subCategories[*]') WHEN 'OBJECT' THEN [item->'$.subCategories'] ELSE [] END AS list FROM n)) WHERE json_type(list[i]) = 'OBJECT'),
leaves AS (SELECT * FROM n WHERE NOT EXISTS (SELECT 1 FROM n c WHERE c.payload_id = n.payload_id AND c.path LIKE n.path || '.%'))"""


@query(TREE_SQL + " SELECT payload_id, path AS node_path, array_to_string(names, ' > ') AS names FROM leaves")
def category_leaves(spark, sf_dir):
    return product_api.category_leaves(table(spark, sf_dir, "api_payloads")).select("payload_id", "node_path", F.array_join("names", " > ").alias("names"))


@query(TREE_SQL + ", k AS (SELECT payload_id, path, list_filter(names, lambda x: x <> 'Home') AS c FROM leaves) SELECT payload_id, path AS node_path, coalesce(c[1], '') AS category, coalesce(c[2], '') AS subcategory, array_to_string(c[3:], ' / ') AS series FROM k")
def breadcrumb_paths(spark, sf_dir):
    return product_api.category_leaves(table(spark, sf_dir, "api_payloads")).select("payload_id", "node_path", "category", "subcategory", "series")


LIST_SQL = "CASE json_type({0}) WHEN 'ARRAY' THEN json_extract({0}, '$[*]') WHEN 'OBJECT' THEN [{0}] ELSE [] END"


@query(
    f"""
WITH b AS (SELECT payload_id, kind, body::JSON AS j FROM api_payloads WHERE kind IN ('search', 'product_detail') AND json_valid(body)),
i AS (SELECT payload_id, pos, items[pos + 1] AS p FROM (SELECT payload_id, items, unnest(range(len(items))) AS pos FROM (SELECT payload_id, CASE kind WHEN 'search' THEN {LIST_SQL.format("(j->'$.products')")} ELSE [j] END AS items FROM b))),
a AS (SELECT payload_id, pos, p, n, types[n + 1] AS t FROM (SELECT *, unnest(range(len(types))) AS n FROM (SELECT payload_id, pos, p, {LIST_SQL.format("(p->'$.attributeTypes')")} AS types FROM i))),
v AS (SELECT payload_id, pos, n, coalesce(p->>'$.productNumber', '') AS part_no, coalesce(p->>'$.productTitle', '') AS title, coalesce(t->>'$.label', '') AS label,
  array_to_string(list_transform({LIST_SQL.format("(t->'$.attributeValues')")}, lambda x: coalesce(x->>'$.valueDisplay', '')), ', ') AS value FROM a)
SELECT payload_id, pos::INT AS pos, part_no, title, label, arg_max(value, n) AS value FROM v GROUP BY ALL"""
)
def product_json_to_parts(spark, sf_dir):
    found = product_api.products(table(spark, sf_dir, "api_payloads"))
    return found.select("payload_id", "pos", "part_no", "title", F.explode("attributes").alias("label", "value"))


# ---- workbook columns -------------------------------------------------------------------------------------------


@query("SELECT DISTINCT unnest(map_keys(attributes)) AS label FROM part_records")
def attribute_union(spark, sf_dir):
    labels = xlsx.attribute_labels(table(spark, sf_dir, "part_records").withColumn("pos", F.col("rec_id")))
    return spark.createDataFrame([(x,) for x in labels], "label string")


@query("SELECT rec_id, (SELECT string_agg(coalesce(attributes[display_label], ''), '|' ORDER BY display_label) FROM attribute_defs) AS cells FROM part_records")
def attribute_pivot(spark, sf_dir):
    labels = sorted(r.display_label for r in table(spark, sf_dir, "attribute_defs").collect())
    parts = table(spark, sf_dir, "part_records").withColumn("pos", F.col("rec_id"))
    wide = xlsx.pivoted(parts, labels)
    return wide.select(F.col("pos").alias("rec_id"), F.concat_ws("|", *[f"attr_{i}" for i in range(len(labels))]).alias("cells"))


# ---- sites ------------------------------------------------------------------------------------------------------

HOST_SQL = r"lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1))"


@query(f"SELECT coalesce({HOST_SQL}, '') AS host, count(*) AS n FROM part_records GROUP BY 1")
def host_counts(spark, sf_dir):
    return table(spark, sf_dir, "part_records").groupBy(keys.authority(F.col("url")).alias("host")).agg(F.count("*").alias("n"))


@query(f"SELECT DISTINCT regexp_replace(regexp_replace(coalesce({HOST_SQL}, ''), '^www\\.', ''), '[^a-z0-9.-]', '_', 'g') AS domain_key FROM part_records")
def domain_keys(spark, sf_dir):
    return table(spark, sf_dir, "part_records").select(keys.domain_key(keys.authority(F.col("url"))).alias("domain_key")).distinct()


#: Links of a page by kind of its id, and what they become: an absolute one with a fragment, a path, a neighbour, a
#: query only, another host, another port, repeated paging values.
LINKS = [("/p/1?page=3&ref=x#top", "{site}/p/1?page=3"), ("/a/b/", "{site}/a/b/"), ("?page=&q=1", "{url}?page="), ("//other.example/x", None), ("#part", "{url}"), ("/l?page=2&page=4&q=", "{site}/l?page=2&page=4"), ("http://[", None), ("mailto:a@b.example", None)]
LINK_SQL = " ".join(f"WHEN {i} THEN " + ("NULL" if to is None else "'" + to.replace("{site}", "' || site || '").replace("{url}", "' || url || '") + "'") for i, (_, to) in enumerate(LINKS))


@query(f"SELECT rec_id, CASE rec_id % {len(LINKS)} {LINK_SQL} END AS normal FROM (SELECT rec_id, url, regexp_extract(url, '^[a-z]+://[^/]+') AS site FROM part_records WHERE url IS NOT NULL)")
def url_normalize(spark, sf_dir):
    rows = table(spark, sf_dir, "part_records").where("url is not null")
    href = F.element_at(F.array(*[F.lit(link) for link, _ in LINKS]), (F.col("rec_id") % len(LINKS)).cast("int") + 1)
    return rows.select("rec_id", urls.normalize_url(href, F.col("url"), "page").alias("normal"))


def site_pages(spark, sf_dir):
    """A page for each document that has a URL, with links to itself, a listing and another host."""
    text = F.concat(F.lit('<html><head><script>var a = "<a href=x>";</script></head><body><a href="'), F.col("url"), F.lit('#top">top</a><a href="/list?page=2&amp;sort=up">list</a><a name="x">no link</a><a href="https://other.example/p/1">other</a><p>'), blank(F.col("text")), F.lit("</p></body></html>"))
    return table(spark, sf_dir, "documents").where("url is not null").select("url", text.alias("html"))


@query(r"""
SELECT url, pos, href, target FROM (SELECT url, regexp_extract(url, '^[a-z]+://[^/]+') AS site FROM documents WHERE url IS NOT NULL),
LATERAL (SELECT * FROM (VALUES (0, url || '#top', url), (1, '/list?page=2&sort=up', site || '/list?page=2'), (2, 'https://other.example/p/1', NULL)) v(pos, href, target))""")
def link_extract(spark, sf_dir):
    return html.page_links(site_pages(spark, sf_dir), "page")


@query(rf"SELECT url, left(regexp_replace(regexp_replace('<html><head></head><body><a href=\"' || url || '#top\">top</a><a href=\"/list?page=2&amp;sort=up\">list</a><a name=\"x\">no link</a><a href=\"https://other.example/p/1\">other</a><p>' || coalesce(text, '') || '</p></body></html>', '{SPACE}+', ' ', 'g'), '<+$', ''), 30000) AS sample FROM documents WHERE url IS NOT NULL".replace('\\"', '"'))
def html_sample(spark, sf_dir):
    return site_pages(spark, sf_dir).select("url", keys.html_sample(F.col("html")).alias("sample"))


SITE_SQL = rf"SELECT {HOST_SQL} || '-' || (doc_id // 1000) AS site, doc_id, url FROM documents WHERE url IS NOT NULL"


@query(f"SELECT site, url AS loc FROM ({SITE_SQL}) WHERE regexp_matches(url, '/(valves|flanges|strainers|hangers)/') GROUP BY 1, 2")
def sitemap_urls(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").where("url is not null").select(F.concat_ws("-", keys.authority(F.col("url")), F.floor(F.col("doc_id") / 1000).cast("string")).alias("site"), "doc_id", "url")
    entries = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "url"))), lambda x: F.concat(F.lit("<url><loc> "), x["url"], F.lit(" </loc></url>"))), "")
    maps = rows.groupBy("site").agg(F.concat(F.lit('<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'), entries, F.lit("</urlset>")).alias("xml"))
    return site_urls.sitemap_urls(maps, r"/(?P<group>valves|flanges|strainers|hangers)/").select("site", "loc")


@query("SELECT '/p/' || p_partkey AS url, p_brand || '-' || p_partkey AS part_no, p_type AS category, p_name AS subcategory, '' AS series, 'Brand' AS label, p_brand AS value FROM part UNION ALL SELECT '/p/' || p_partkey, p_brand || '-' || p_partkey, p_type, p_name, '', 'Size', 'no. ' || p_size FROM part")
def product_page_parse(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    key = F.col("p_partkey").cast("string")
    text = F.concat(
        F.lit("<html><nav class='breadcrumb'><a>Home</a><a>"), "p_type", F.lit("</a><a> "), "p_name", F.lit("</a></nav><h1 class='big sku'> "), "p_brand", F.lit("-"), key,
        F.lit("</h1><table class=specs><tr><th>Brand:</th><td>"), "p_brand", F.lit("</td></tr><tr><th>Size</th><td>no.<b>"), F.col("p_size").cast("string"), F.lit("</b></td></tr><tr><th></th><td>x</td></tr></table><br></html>"),
    )
    selectors = {"part_no": ".sku", "breadcrumb": ".breadcrumb > *", "attributes": {"row": ".specs tr", "label": "th", "value": "td"}}
    found = html.product_pages(part.select(F.concat(F.lit("/p/"), key).alias("url"), text.alias("html")), selectors)
    return found.select("url", "part_no", "category", "subcategory", "series", F.explode("attributes").alias("label", "value"))


@query("SELECT search, url, rank_in_key::INT AS rank_in_key FROM (SELECT *, row_number() OVER (PARTITION BY search ORDER BY pos, url) AS rank_in_key FROM (SELECT site AS search, url, min(pos) AS pos FROM part_records WHERE url IS NOT NULL AND contains(url, '/p/') GROUP BY 1, 2)) WHERE rank_in_key <= 10")
def search_hits_topk(spark, sf_dir):
    links = table(spark, sf_dir, "part_records").select(F.col("site").alias("search"), F.col("url").alias("target"), "pos")
    return site_urls.search_hits(links, r"/p/").select("search", "url", "rank_in_key")


def link_graph(spark, sf_dir):
    """A site for each region: its page links to its nations' pages, these to their customers' pages."""
    nation, customer = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    up = nation.select(F.col("n_regionkey").cast("string").alias("site"), F.concat(F.lit("/list/"), F.col("n_regionkey").cast("string")).alias("url"), F.col("n_nationkey").cast("int").alias("pos"), F.concat(F.lit("/group/"), F.col("n_nationkey").cast("string")).alias("target"))
    down = customer.join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_regionkey").cast("string").alias("site"), F.concat(F.lit("/group/"), F.col("n_nationkey").cast("string")).alias("url"), F.col("c_custkey").cast("int").alias("pos"), F.concat(F.lit("/p/"), F.col("c_custkey").cast("string")).alias("target"))
    starts = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("string").alias("site"), F.concat(F.lit("/list/"), F.col("r_regionkey").cast("string")).alias("url"), F.lit(1).alias("pos"))
    return up.unionByName(down), starts


@query("""
WITH n AS (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS rnk, count(*) OVER (PARTITION BY n_regionkey) AS nations FROM nation)
SELECT n_regionkey::VARCHAR AS site, row_number() OVER (PARTITION BY n_regionkey ORDER BY rnk = nations DESC, rnk, c_custkey) - 1 AS pos, '/p/' || c_custkey AS url FROM n JOIN customer ON c_nationkey = n_nationkey""")
def crawl_urls(spark, sf_dir):
    """Each region has two start pages: first its last nation's page, then its list."""
    edges, starts = link_graph(spark, sf_dir)
    first = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").cast("string").alias("site")).agg(F.concat(F.lit("/group/"), F.max("n_nationkey").cast("string")).alias("url")).withColumn("pos", F.lit(0))
    return site_urls.crawl_urls(edges, starts.unionByName(first), r"^/p/", r"^/group/")


@query("SELECT DISTINCT n_regionkey::VARCHAR AS site, '/p/' || c_custkey AS url FROM nation JOIN customer ON c_nationkey = n_nationkey")
def reachable_urls(spark, sf_dir):
    edges, starts = link_graph(spark, sf_dir)
    return site_urls.reachable_urls(edges, starts, r"^/p/", r"^/group/")


# ---- incremental collection -------------------------------------------------------------------------------------


@query("SELECT DISTINCT site AS unit_key FROM part_records WHERE site NOT IN (SELECT site FROM web_snapshots WHERE complete AND site IS NOT NULL)")
def resume_remaining(spark, sf_dir):
    units = table(spark, sf_dir, "part_records").select(F.col("site").alias("unit_key")).distinct()
    return merge.remaining_units(units, table(spark, sf_dir, "web_snapshots").where("complete").select(F.col("site").alias("unit_key")))


@query("SELECT part_no, pos, src_rank FROM (SELECT *, row_number() OVER (PARTITION BY part_no ORDER BY src_rank, pos) AS n FROM (SELECT coalesce(part_no, '') AS part_no, raw_id AS pos, 0 AS src_rank FROM raw_parts UNION ALL SELECT coalesce(part_no, ''), rec_id, 1 FROM part_records)) WHERE n = 1")
def merge_keep_first(spark, sf_dir):
    old = table(spark, sf_dir, "raw_parts").select(blank(F.col("part_no")).alias("part_no"), F.col("raw_id").alias("pos"))
    new = table(spark, sf_dir, "part_records").select(blank(F.col("part_no")).alias("part_no"), F.col("rec_id").alias("pos"))
    return merge.merge_keep_first(old, new).select("part_no", "pos", "src_rank")


@query("""
WITH s AS (SELECT snapshot_id, lag(snapshot_id) OVER (PARTITION BY coalesce(site, '') ORDER BY fetched_at, snapshot_id) AS prev_id FROM web_snapshots WHERE complete),
c AS (SELECT snapshot_id, count(*) AS n, count(*) FILTER (cardinality(attributes) > 0) AS a FROM snapshot_parts GROUP BY 1)
SELECT s.snapshot_id, coalesce(o.n, 0) AS old_parts, coalesce(c.n, 0) AS new_parts, coalesce(c.n, 0) < 0.5 * coalesce(o.n, 0) AS halved, coalesce(o.a, 0) > 0.5 * coalesce(o.n, 0) AND coalesce(c.a, 0) = 0 AS attributes_vanished
FROM s LEFT JOIN c ON c.snapshot_id = s.snapshot_id LEFT JOIN c o ON o.snapshot_id = s.prev_id WHERE prev_id IS NOT NULL""")
def drift_notices(spark, sf_dir):
    return merge.snapshot_drift(table(spark, sf_dir, "web_snapshots"), table(spark, sf_dir, "snapshot_parts"))


@query("SELECT greatest(0, (SELECT count(*) FROM part_records) - (SELECT count(*) FROM raw_parts)) AS added")
def added_count(spark, sf_dir):
    return merge.added_count(table(spark, sf_dir, "raw_parts"), table(spark, sf_dir, "part_records"))


def shared_folder(spark, name: str) -> str:
    """A new folder beside the checkpoints, which all executors can read."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


@query("SELECT event_type AS kind, count(*) AS parts, event_type = 'view' AS cache_hit, 'events' AS source FROM events GROUP BY 1")
def run_history(spark, sf_dir):
    """Every type of event recorded as a run by the store, and the history read back."""
    box = store.Store(spark, shared_folder(spark, "history"))
    for r in table(spark, sf_dir, "events").groupBy("event_type").count().orderBy("event_type").collect():
        box.record_run(source="events", kind=r.event_type, parts=r["count"], cache_hit=r.event_type == "view", stopped_early=False, id="given")
    return box.runs().where("id <> 'given' and timestamp is not null").select("kind", "parts", "cache_hit", "source")


@query("SELECT DISTINCT site, snapshot_id::BIGINT AS snapshot_id, n AS parts FROM (SELECT snapshot_id, site, complete, fetched_at, row_number() OVER (PARTITION BY site ORDER BY complete DESC, fetched_at DESC, snapshot_id DESC) AS rank FROM web_snapshots WHERE site <> '') JOIN (SELECT snapshot_id, count(*) AS n FROM snapshot_parts GROUP BY 1) USING (snapshot_id) WHERE rank = 1")
def stored_snapshots(spark, sf_dir):
    """Every site's last complete snapshot written to the store twice, a stale version first, and read back."""
    box, parts = store.Store(spark, shared_folder(spark, "store")), table(spark, sf_dir, "snapshot_parts")
    last = table(spark, sf_dir, "web_snapshots").where("site <> ''").groupBy("site").agg(F.max_by("snapshot_id", F.struct("complete", "fetched_at", "snapshot_id")).alias("snapshot_id"))
    all_parts = parts.join(last, "snapshot_id").select("site", "snapshot_id", "part_no")
    box.write("site", "all", all_parts.limit(0), complete=False)
    box.write("site", "all", all_parts, complete=True)
    rows, meta = box.read("site", "all")
    return rows.where(F.lit(meta["complete"])).groupBy("site", "snapshot_id").agg(F.count("*").alias("parts"))


@query("SELECT entry_id, trim(raw) AS raw FROM filter_entries WHERE regexp_full_match(raw, '[!-~]([ -~]*[!-~])?') AND NOT regexp_full_match(raw, '[0-9]+')")
def workbook_roundtrip(spark, sf_dir):
    """The requested lines written to a workbook with a row for each and read back by the data source ``part_list``."""
    lines = table(spark, sf_dir, "filter_entries").where(F.col("raw").rlike(r"^[!-~]([ -~]*[!-~])?$") & ~F.col("raw").rlike(r"^[0-9]+$")).select("entry_id", "raw")
    rows = lines.orderBy("entry_id").collect()  # a workbook is one file written by one program
    folder = tempfile.mkdtemp(prefix="partmill-workbook-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    xlsx.write_sheets(Path(folder) / "list.xlsx", {"Sheet1": ([["Qty", "Part No"], *([1, r.raw] for r in rows)], 1)})
    sheet = xlsx.load_filter_sheet(Path(folder) / "list.xlsx")
    return spark.createDataFrame([(rows[at - 2].entry_id, raw) for raw, at in sheet.entries], "entry_id long, raw string")


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 3) AS value FROM events GROUP BY 1, 2")
def windowed_events(spark, sf_dir):
    counts = incremental.windowed_counts(table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    return counts.withColumn("value", F.round("value", 3)).withColumn("start", F.col("start").cast("timestamp_ntz"))


# ---- whole runs -------------------------------------------------------------------------------------------------


@query(f"WITH {SECTION_SQL}, {PLACED_SQL} SELECT row_number() OVER (ORDER BY p_partkey) AS sequence, p_brand || '-' || p_partkey AS part_no, coalesce(category, '') AS category, 'CATALOG PARTS' AS subcategory, 'CATALOG PARTS' AS series, 'Type: ' || p_type || ', Size: ' || p_size AS description FROM part JOIN placed ON page_no = p_partkey // {PER_PAGE} + 1")
def page_run_catalog(spark, sf_dir):
    """A run over the catalog's pages with its sections, stored, and read back by a second run from the snapshot."""
    box = store.Store(spark, shared_folder(spark, "pages"))
    catalog_text = catalog_pages(spark, sf_dir).select("page_no", F.when(F.col("page_no") == 1, F.concat("text", F.lit("\n\nTABLE OF CONTENTS"))).otherwise(F.col("text")).alias("text"))
    read = lambda: runs.run_pages(spark, box, "catalog", catalog_text, sections_of=lambda text, total: SECTIONS)
    read()
    again = read()
    return again.parts.where(F.lit(again.cache_hit)).select("sequence", "part_no", "category", "subcategory", "series", "description")


@query("SELECT 'N-' || n_nationkey AS part_no, r_name AS category, n_name AS subcategory, true AS resumed FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT 'shared', (SELECT r_name FROM region ORDER BY r_regionkey LIMIT 1), '', true")
def site_run_parts(spark, sf_dir):
    """A run over regions as a site's units that fails at the third, and the run that resumes it."""
    box, failed = store.Store(spark, shared_folder(spark, "site")), []
    rows = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey")).select("n_regionkey", "r_name", "n_nationkey", "n_name").orderBy("n_nationkey").collect()  # a fixed table of 25 rows
    units = [str(k) for k in sorted({r.n_regionkey for r in rows})]

    def collect(unit: str) -> list[dict]:
        if unit == "2" and not failed:
            failed.append(unit)
            raise WebError("gone")
        own = [r for r in rows if str(r.n_regionkey) == unit]
        return [{"part_no": f"N-{r.n_nationkey}", "category": r.r_name, "subcategory": r.n_name} for r in own] + [{"part_no": "shared", "category": own[0].r_name}]

    first = runs.run_units(spark, box, "www.site.example", units, collect)
    second = runs.run_units(spark, box, "site.example", units, collect)
    return second.parts.select("part_no", "category", "subcategory", F.lit(first.stopped_early and not second.stopped_early).alias("resumed"))


@query("SELECT p_partkey, p_partkey % 6 AS problems FROM part WHERE p_partkey % 6 > 0")
def config_problems(spark, sf_dir):
    """How many things are wrong with configurations that lack or spoil more and more fields."""
    steps = [lambda c: c["selectors"].pop("part_no"), lambda c: c["selectors"].update(attributes={"row": "tr"}), lambda c: c["enumeration"].update(start_urls=[]), lambda c: c["enumeration"].update(product_link_pattern="("), lambda c: c["enumeration"].update(category_link_pattern="[")]

    def count(wanted: pd.Series) -> pd.Series:
        def wrong(n: int) -> int:
            values = {"platform": "generic", "enumeration": {"strategy": "category_crawl", "start_urls": ["u"], "product_link_pattern": "/p/"}, "selectors": {"part_no": ".sku"}, "not_known": 1}
            for step in steps[:n]:
                step(values)
            return len(config.problems(config.SiteConfig.from_dict(values)))

        return wanted.map(wrong)

    found = table(spark, sf_dir, "part").select("p_partkey", F.pandas_udf(count, "bigint")((F.col("p_partkey") % 6).cast("int")).alias("problems"))
    return found.where("problems > 0")


@query("SELECT attr_code AS part_no, display_label AS description, value_type AS kind FROM attribute_defs")
def written_workbook(spark, sf_dir):
    """The attribute definitions written as a catalog workbook with a column for an attribute, and its rows read back."""
    defs = table(spark, sf_dir, "attribute_defs")
    blanks = [F.lit("").alias(c) for c in ("category", "subcategory", "series")]
    parts = defs.select(F.col("attr_code").alias("part_no"), *blanks, F.col("display_label").alias("description"), F.create_map(F.lit("Kind"), F.col("value_type")).alias("attributes"), F.hash("attr_code").cast("long").alias("pos"))
    folder = tempfile.mkdtemp(prefix="partmill-workbook-")  # the driver's own, for the one file it writes and reads
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = xlsx.output_path(Path(folder), "definitions")
    xlsx.write_workbook(path, parts, "web")
    (_, header), *rows = xlsx.read_rows(path)
    at = {name: place for place, name in header.items()}
    places = [at[xlsx.WEB_COLUMNS[0]], at[xlsx.WEB_COLUMNS[4]], at["Kind"]]
    return spark.createDataFrame([tuple(str(row.get(i) or "") for i in places) for _, row in rows], "part_no string, description string, kind string")

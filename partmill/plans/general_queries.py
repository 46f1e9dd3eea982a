"""Queries p3, p4, p6 and p7 over the test tables, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partmill.operators import nested, snapshots, units, wide
from partmill.session import configure


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    defs = table(spark, sf_dir, "attribute_defs")
    detail = wide.filled_cells(wide.wide_table(wide.detail_rows(table(spark, sf_dir, "product_details")), defs), defs)
    record = wide.filled_cells(wide.wide_table(wide.record_rows(table(spark, sf_dir, "part_records")), defs), defs)
    return detail.select(F.lit("detail").alias("src"), "*").unionByName(record.select(F.lit("record").alias("src"), "*"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    raw, details = table(spark, sf_dir, "raw_parts"), table(spark, sf_dir, "product_details")
    defs = table(spark, sf_dir, "attribute_defs")
    known = units.learned_units(units.measured_texts(raw, details, defs))
    return units.raw_quantities(raw, known).unionByName(units.detail_quantities(details, defs, known))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    return nested.payload_nodes(table(spark, sf_dir, "api_payloads"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    return snapshots.snapshot_changes(table(spark, sf_dir, "web_snapshots"), table(spark, sf_dir, "snapshot_parts"))


QUERIES = {"p3_found": p3_found, "p4_found": p4_found, "p6_found": p6_found, "p7_found": p7_found}

PLAIN_SQL = r"lower(regexp_replace(upper(replace(coalesce({0}, ''), 'ß', 'ss')), '[^\p{{L}}\p{{N}}]', '', 'g'))"
#: Typed cells in SQL: the value stripped, its only number, and the readings of the four types.
P3_SQL = rf"""
WITH defs AS (SELECT attr_code, value_type, {PLAIN_SQL.format('label')} AS k FROM (SELECT attr_code, value_type, unnest(list_prepend(display_label, coalesce(other_labels, []))) AS label FROM attribute_defs) WHERE value_type IN ('integer', 'decimal', 'boolean', 'date')),
r AS (SELECT 'detail' AS src, coalesce(product_id, '') AS entity_key, label, value_display AS value, loaded_at, row_id FROM product_details
  UNION ALL SELECT 'record', rec_id::VARCHAR, e.key, e.value, loaded_at, rec_id FROM (SELECT rec_id, loaded_at, unnest(map_entries(attributes)) AS e FROM part_records)),
v AS (SELECT src, entity_key, attr_code, value_type, loaded_at, row_id, regexp_replace(coalesce(value, ''), '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g') AS s FROM r JOIN defs ON k = {PLAIN_SQL.format('r.label')}),
n AS (SELECT *, try_cast(replace(regexp_replace(regexp_extract(s, '^(?i:approx\.?\s*|up to\s*|[$€£¥~]\s*)*(\d{{1,3}}(?:,\d{{3}})+(?:\.\d+)?|\d+(?:[.,]\d+)?|[.,]\d+)[^\p{{N}}]*$', 1), ',(\d{{3}})($|[^\d])', '\1\2', 'g'), ',', '.') AS DECIMAL(30, 9)) AS num, lower(s) AS l FROM v),
c AS (SELECT *, CASE value_type
    WHEN 'integer' THEN CASE WHEN num = floor(num) THEN num::BIGINT::VARCHAR END
    WHEN 'decimal' THEN round(num, 3)::DECIMAL(28, 3)::VARCHAR
    WHEN 'boolean' THEN CASE WHEN l IN ('yes', 'y', 'true', 't', '1', 'x', '✓', '✔', '☑') THEN 'true' WHEN l IN ('no', 'n', 'false', 'f', '0') THEN 'false' END
    ELSE coalesce(try_strptime(s, ['%Y-%m-%d', '%Y/%m/%d', '%Y-%m-%dT%H:%M:%SZ']), CASE WHEN regexp_matches(s, '^\d{{8}}$') THEN try_strptime(s, '%Y%m%d') END, try_strptime(l, ['%d %b %Y', '%d-%b-%Y', '%B %d, %Y']))::DATE::VARCHAR END AS cell FROM n)
SELECT src, entity_key, attr_code, arg_max(cell, (loaded_at, row_id)) AS cell FROM c WHERE cell IS NOT NULL GROUP BY 1, 2, 3"""

ORACLE = {
    "p3_found": P3_SQL,
    "p7_found": """
WITH s AS (SELECT snapshot_id, lag(snapshot_id) OVER w AS prev_id FROM web_snapshots WHERE complete WINDOW w AS (PARTITION BY coalesce(site, '') ORDER BY fetched_at, snapshot_id)),
p AS (SELECT snapshot_id, coalesce(part_no, '') AS part_no, list_sort(list(DISTINCT row_text)) AS rows_ FROM (
  SELECT snapshot_id, part_no, to_json([coalesce(category, ''), coalesce(subcategory, ''), coalesce(series, ''), coalesce(description, '')])::VARCHAR
    || coalesce(to_json(list_sort(list_transform(map_entries(attributes), lambda e: [e.key, coalesce(e.value, '')])))::VARCHAR, '[]') AS row_text FROM snapshot_parts) GROUP BY 1, 2),
n AS (SELECT s.snapshot_id, part_no, rows_ FROM s JOIN p ON p.snapshot_id = s.snapshot_id WHERE prev_id IS NOT NULL),
o AS (SELECT s.snapshot_id, part_no, rows_ FROM s JOIN p ON p.snapshot_id = s.prev_id)
SELECT coalesce(n.snapshot_id, o.snapshot_id) AS snapshot_id, coalesce(n.part_no, o.part_no) AS part_no,
  CASE WHEN o.part_no IS NULL THEN 'added' WHEN n.part_no IS NULL THEN 'removed' ELSE 'changed' END AS change_kind
FROM n FULL OUTER JOIN o ON n.snapshot_id = o.snapshot_id AND n.part_no = o.part_no
WHERE o.part_no IS NULL OR n.part_no IS NULL OR n.rows_ <> o.rows_""",
    "p6_found": """
WITH RECURSIVE b AS (SELECT payload_id, kind, body::JSON AS j FROM api_payloads WHERE json_valid(body)),
n AS (
  SELECT payload_id, CASE kind WHEN 'categories' THEN 'category' ELSE 'product' END AS node_kind, '' AS parent_path, (i - 1)::VARCHAR AS node_path, list[i] AS item FROM (
    SELECT payload_id, kind, list, unnest(range(1, len(list) + 1)) AS i FROM (
      SELECT payload_id, kind, CASE kind WHEN 'product_detail' THEN [j] ELSE CASE json_type(a) WHEN 'ARRAY' THEN json_extract(a, '$[*]') WHEN 'OBJECT' THEN [a] ELSE [] END END AS list
      FROM (SELECT payload_id, kind, j, CASE kind WHEN 'categories' THEN j->'$.categories' WHEN 'search' THEN j->'$.products' END AS a FROM b)))
  WHERE json_type(list[i]) = 'OBJECT'
  UNION ALL
  SELECT payload_id, child, node_path, node_path || '.' || (i - 1), list[i] FROM (
    SELECT payload_id, child, node_path, list, unnest(range(1, len(list) + 1)) AS i FROM (
      SELECT payload_id, CASE node_kind WHEN 'category' THEN 'category' WHEN 'product' THEN 'attribute' ELSE 'value' END AS child, node_path,
        CASE json_type(a) WHEN 'ARRAY' THEN json_extract(a, '$[*]') WHEN 'OBJECT' THEN [a] ELSE [] END AS list
      FROM (SELECT payload_id, node_kind, node_path, CASE node_kind WHEN 'category' THEN item->'$.subCategories' WHEN 'product' THEN item->'$.attributeTypes' WHEN 'attribute' THEN item->'$.attributeValues' END AS a FROM n)))
  WHERE json_type(list[i]) = 'OBJECT')
SELECT payload_id, node_kind, parent_path, node_path,
  coalesce(CASE node_kind WHEN 'category' THEN item->>'$.shortDescription' WHEN 'product' THEN item->>'$.productNumber' WHEN 'attribute' THEN item->>'$.label' ELSE item->>'$.valueDisplay' END, '') AS node_text FROM n""",
}

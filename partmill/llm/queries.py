"""Queries p1, p2, p5, p8, p9 and p10 over the test tables, each over its whole tables and texts, and their SQL."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partmill.llm import canonical, copies, leakage, listings, residue, tokens
from partmill.session import configure

#: Folder of the public vocabularies; every executor must be able to read it.
TOKENIZERS = os.environ.get("PARTMILL_TOKENIZERS", "/opt/tokenizers")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    configure(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listings.listing_pairs(table(spark, sf_dir, "part_records"))


def p1_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listings.group_table(table(spark, sf_dir, "part_records"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    records, lines = table(spark, sf_dir, "part_records"), table(spark, sf_dir, "filter_entries")
    return copies.record_copies(records).unionByName(copies.line_copies(lines))


def p2_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    records, lines = table(spark, sf_dir, "part_records"), table(spark, sf_dir, "filter_entries")
    return copies.record_counts(records).select(F.lit("part_records").alias("tbl"), "*").unionByName(copies.line_counts(lines).select(F.lit("filter_entries").alias("tbl"), "*"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical.matches(table(spark, sf_dir, "filter_entries"), table(spark, sf_dir, "ref_parts"))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode(table(spark, sf_dir, "documents"), path=f"{TOKENIZERS}/byte_bpe_50k.tiktoken")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.residue(table(spark, sf_dir, "documents"))


QUERIES = {"p1_found": p1_found, "p1_groups": p1_groups, "p2_found": p2_found, "p2_counts": p2_counts, "p5_found": p5_found, "p8_ids": p8_ids, "p9_found": p9_found, "p10_found": p10_found}

PLAIN = r"regexp_replace(lower(upper(replace(replace(coalesce({0}, ''), 'ß', 'ss'), 'ſ', 's'))), '[^\p{{L}}\p{{N}}]', '', 'g')"
RECORD_GROUPS = rf"""
  SELECT rec_id AS id, concat_ws(chr(31), {PLAIN.format('part_no')}, {PLAIN.format('category')}, {PLAIN.format('subcategory')}, {PLAIN.format('series')},
    array_to_string(list_sort(list_filter(list_transform(regexp_split_to_array(coalesce(description, ''), '[,;|]'), lambda x: {PLAIN.format('x')}), lambda x: x <> '')), chr(30)),
    array_to_string(list_sort(list_filter(list_transform(coalesce(map_entries(attributes), []), lambda e: {PLAIN.format('e.key')} || '=' || {PLAIN.format('e.value')}), lambda x: x <> '=')), chr(30))) AS k
  FROM part_records"""
LINE_GROUPS = f"SELECT entry_id AS id, coalesce(sheet_id, '') || chr(31) || {PLAIN.format('normalized')} AS k FROM filter_entries WHERE {PLAIN.format('normalized')} <> ''"
ORACLE = {
    "p2_found": f"""
WITH r AS ({RECORD_GROUPS}), l AS ({LINE_GROUPS})
SELECT 'part_records' AS tbl, keep_id, id AS copy_id FROM (SELECT id, min(id) OVER (PARTITION BY k) AS keep_id FROM r) WHERE id <> keep_id
UNION ALL
SELECT 'filter_entries' AS tbl, keep_id, id AS copy_id FROM (SELECT id, min(id) OVER (PARTITION BY k) AS keep_id FROM l) WHERE id <> keep_id""",
    "p2_counts": f"""
WITH r AS ({RECORD_GROUPS}), l AS ({LINE_GROUPS})
SELECT 'part_records' AS tbl, min(id) AS keep_id, count(*) AS copies FROM r GROUP BY k
UNION ALL
SELECT 'filter_entries' AS tbl, min(id) AS keep_id, count(*) AS copies FROM l GROUP BY k""",
    "p9_found": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_items WHERE text IS NOT NULL),
dg AS (SELECT DISTINCT doc_id, array_to_string(w[p:p + 11], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS p FROM d WHERE len(w) >= 12)),
ig AS (SELECT DISTINCT item_id, array_to_string(w[p:p + 11], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS p FROM i WHERE len(w) >= 12))
SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)""",
}

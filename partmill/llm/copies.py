"""Duplicates hidden by formatting differences.

Method: byte-identical raw rows are collapsed first, with counts; only the distinct survivors are brought into
canonical form; they are grouped again on the full canonical text, summing the counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partmill.functions.text import blank, canonical_entries, canonical_fields, letters_digits
from partmill.session import durable

SEPARATOR = "\u001f"


def record_text() -> Column:
    """The canonical text of a part record: fields in letters and digits, the parts of the description and the entries
    of the attributes sorted, so that their order is lost."""
    plain = [letters_digits(F.col(c)) for c in ("part_no", "category", "subcategory", "series")]
    return F.concat_ws(SEPARATOR, *plain, F.array_join(canonical_fields(F.col("description")), "\u001e"), F.array_join(canonical_entries(F.col("attributes")), "\u001e"))


def record_key() -> Column:
    """The raw row as one text; rows with equal bytes in the compared fields have equal keys."""
    entries = F.coalesce(F.map_entries("attributes"), F.array().cast("array<struct<key:string,value:string>>"))
    return F.to_json(F.struct(*[blank(F.col(c)).alias(c) for c in ("part_no", "category", "subcategory", "series", "description")], entries.alias("e")))


def line_text() -> Column:
    """The canonical text of a requested line; null where ``normalized`` has no letter or digit."""
    text = letters_digits(F.col("normalized"))
    return F.when(text != "", F.concat_ws(SEPARATOR, blank(F.col("sheet_id")), text))


def line_key() -> Column:
    return F.concat_ws(SEPARATOR, blank(F.col("sheet_id")), F.coalesce(F.col("normalized"), F.lit("")))


def survivors(rows: DataFrame, key: Column, canonical: Column, columns: list[str], row_id: str) -> tuple[DataFrame, DataFrame]:
    """(raw groups, canonical groups).

    Raw groups: raw, keep_id, copies for each distinct raw row (SHA-256 of the bytes), and the SHA-256 of its full
    canonical text.  Canonical groups: canonical, keep_id, copies.  Both are partial aggregates, so a group that holds a third of all
    rows is reduced before the shuffle.
    """
    hashed = rows.select(F.sha2(key, 256).alias("raw"), F.col(row_id).alias("row_id"), *columns)
    raw = hashed.groupBy("raw").agg(F.min("row_id").alias("keep_id"), F.count("*").alias("copies"), *[F.any_value(c).alias(c) for c in columns])
    # the digest stands for the whole canonical text; the table is read for the groups and again for their members
    raw = durable(raw.select("raw", "keep_id", "copies", F.sha2(canonical, 256).alias("canonical")).where("canonical is not null"))
    groups = raw.groupBy("canonical").agg(F.min("keep_id").alias("keep_id"), F.sum("copies").alias("copies"))
    return raw, groups


def collapse(rows: DataFrame, key: Column, canonical: Column, columns: list[str], row_id: str) -> DataFrame:
    """keep_id, copies: one kept row for each group of copies and how many rows the group has."""
    return survivors(rows, key, canonical, columns, row_id)[1].select("keep_id", "copies")


def surplus(rows: DataFrame, key: Column, canonical: Column, columns: list[str], row_id: str) -> DataFrame:
    """keep_id, copy_id: each surplus copy with the smallest id of its group.

    Rows get their group through the distinct raw rows.  Both joins have one row for each key on one side and only
    groups of two or more there, so the side with hot keys can be split by the adaptive skew join.
    """
    raw, groups = survivors(rows, key, canonical, columns, row_id)
    # distinct raw rows of groups with more than one row, with the id that is kept
    kept = raw.select("raw", "canonical").join(groups.where("copies > 1").select("canonical", "keep_id"), "canonical").select("raw", "keep_id")
    copies = rows.select(F.sha2(key, 256).alias("raw"), F.col(row_id).alias("copy_id"))
    return copies.join(kept, "raw").where("copy_id <> keep_id").select("keep_id", "copy_id")


RECORD_COLUMNS = ["part_no", "category", "subcategory", "series", "description", "attributes"]
LINE_COLUMNS = ["sheet_id", "normalized"]


def record_copies(records: DataFrame) -> DataFrame:
    """tbl, keep_id, copy_id of ``part_records``.

    Null and ``""`` are the same; records whose compared fields are all empty are copies of each other; null maps and
    null values are empty; repeated ids give one row each only if they differ from the kept id; further columns don't
    matter; an empty table gives an empty one.
    """
    return surplus(records, record_key(), record_text(), RECORD_COLUMNS, "rec_id").select(F.lit("part_records").alias("tbl"), "keep_id", "copy_id")


def line_copies(lines: DataFrame) -> DataFrame:
    """tbl, keep_id, copy_id of ``filter_entries``: lines of one sheet; lines without letter or digit are never copies."""
    return surplus(lines, line_key(), line_text(), LINE_COLUMNS, "entry_id").select(F.lit("filter_entries").alias("tbl"), "keep_id", "copy_id")


def record_counts(records: DataFrame) -> DataFrame:
    """keep_id, copies of ``part_records``: one kept record for each group with its number of copies."""
    return collapse(records, record_key(), record_text(), RECORD_COLUMNS, "rec_id")


def line_counts(lines: DataFrame) -> DataFrame:
    """keep_id, copies of ``filter_entries``; lines without letter or digit stay by themselves and are not listed."""
    return collapse(lines, line_key(), line_text(), LINE_COLUMNS, "entry_id")

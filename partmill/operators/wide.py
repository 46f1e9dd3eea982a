"""Attribute-value rows into wide tables with typed columns.

Method: the rows are reduced to one usable value for each entity and attribute; the entity-by-attribute grid is
completed, with the values left in their places, as an array sorted by attribute position for each entity, and fixed
indices of the array are projected through a try cast of the column's type.  The grid is completed within the row of
its entity, so it is never shuffled, and an entity without usable values keeps a row of its own in the same reduction, so
the rows are read once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partmill.functions import values as V
from partmill.functions.text import blank, letters_digits, strip

TYPED = {"integer": V.as_integer, "decimal": V.as_decimal, "boolean": V.as_boolean, "date": V.as_date}
SQL_TYPE = {"integer": "bigint", "decimal": "decimal(28,3)", "boolean": "boolean", "date": "date"}


def attribute_columns(defs: DataFrame, most: int = 2000) -> list[dict]:
    """The wide table's columns in order: attr_code, value_type, labels in normal form.

    The definitions are the schema of the result and are read on the driver; more than ``most`` are refused, because a
    table of so many columns can't be planned.
    """
    rows = defs.select("attr_code", "display_label", "value_type", "other_labels").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} attribute definitions")
    out = []
    for row in sorted(rows, key=lambda r: (r.attr_code is None, r.attr_code)):
        labels = [row.display_label, *(row.other_labels or [])]
        out.append({"attr_code": row.attr_code, "value_type": row.value_type, "labels": [x for x in labels if x]})
    return out


#: Labels of all definitions up to which they are broadcast.
MOST_LABELS = 100_000


def label_positions(spark, columns: list[dict]) -> DataFrame:
    """label_key, attr_pos: the labels of the definitions as a table, marked for a broadcast if they are few."""
    rows = [(label, pos) for pos, c in enumerate(columns) for label in c["labels"]]
    labels = spark.createDataFrame(rows, "label string, attr_pos int")
    keyed = labels.select(letters_digits(F.col("label")).alias("label_key"), "attr_pos").where("label_key <> ''").groupBy("label_key").agg(F.min("attr_pos").alias("attr_pos"))
    return F.broadcast(keyed) if len(rows) <= MOST_LABELS else keyed


def typed_text(value: Column, columns: list[dict]) -> Column:
    """The value in the plain form of its attribute's type; null if it does not state one.  Text is stripped."""
    case = None
    for kind in {c["value_type"] for c in columns}:
        positions = [p for p, c in enumerate(columns) if c["value_type"] == kind]
        if kind in TYPED:
            out = TYPED[kind](value).cast("string")
        else:
            out = F.when(strip(value) != "", strip(value))
        match = F.col("attr_pos").isin(positions)
        case = F.when(match, out) if case is None else case.when(match, out)
    return case if case is not None else F.lit(None).cast("string")


#: Stands for no attribute, in the row that keeps an entity without usable values.
NO_ATTRIBUTE = -1


def usable_values(rows: DataFrame, columns: list[dict]) -> DataFrame:
    """entity_key, attr_pos, cell of the row that counts: latest ``loaded_at``, then largest ``row_id``, then value; and
    one row with ``NO_ATTRIBUTE`` for an entity's rows that state nothing usable.

    rows: entity_key, label, value, loaded_at, row_id, read once.  The reduction is a partially aggregated ``max``, so an
    entity or label that holds a third of all rows is reduced before the shuffle.
    """
    found = (
        rows.select("entity_key", letters_digits(F.col("label")).alias("label_key"), "value", "loaded_at", "row_id")
        .join(label_positions(rows.sparkSession, columns), "label_key", "left")
        # a member of an array made once, so that the reading is done once for each row
        .withColumn("cell", F.explode_outer(F.array(typed_text(F.col("value"), columns))))
    )
    usable = F.col("cell").isNotNull()
    place = F.when(usable, F.col("attr_pos")).otherwise(NO_ATTRIBUTE)
    return found.groupBy("entity_key", place.alias("attr_pos")).agg(F.max(F.when(usable, F.struct("loaded_at", "row_id", "cell"))).alias("best")).select("entity_key", "attr_pos", F.col("best.cell").alias("cell"))


def wide_table(rows: DataFrame, defs: DataFrame) -> DataFrame:
    """One row for each entity of ``rows`` with one typed column for each definition.

    Null and empty entity keys are one entity ``""``; values that don't state a value of their column's type are
    ignored; entities without any usable value have a row of nulls; empty rows give an empty table with all columns.
    Rows repeated or tied in time and id give the largest value, so the result doesn't depend on order.
    """
    columns = attribute_columns(defs)
    rows = rows.withColumn("entity_key", blank(F.col("entity_key")))
    # at most one value for each attribute, so the lists are bounded by the definitions
    lists = usable_values(rows, columns).groupBy("entity_key").agg(F.collect_list(F.when(F.col("attr_pos") != NO_ATTRIBUTE, F.struct("attr_pos", "cell"))).alias("filled"))
    grid = F.sequence(F.lit(0), F.lit(max(0, len(columns) - 1)))
    empty = F.transform(F.array_except(grid, F.col("filled.attr_pos")), lambda pos: F.struct(pos.alias("attr_pos"), F.lit(None).cast("string").alias("cell")))
    cells = lists.select("entity_key", F.transform(F.array_sort(F.concat("filled", empty)), lambda x: x["cell"]).alias("cells"))
    wide = []
    for pos, column in enumerate(columns):
        cell = F.get(F.col("cells"), F.lit(pos))
        wide.append(cell.try_cast(SQL_TYPE.get(column["value_type"], "string")).alias(column["attr_code"]))
    return cells.select("entity_key", *wide)


def filled_cells(wide: DataFrame, defs: DataFrame, kinds: tuple[str, ...] = ("integer", "decimal", "boolean", "date")) -> DataFrame:
    """entity_key, attr_code, cell of the filled cells of the columns of the given types."""
    pairs = [
        F.struct(F.lit(c["attr_code"]).alias("attr_code"), F.col(f"`{c['attr_code']}`").cast("string").alias("cell"))
        for c in attribute_columns(defs)
        if c["value_type"] in kinds
    ]
    if not pairs:
        pairs = [F.struct(F.lit("").alias("attr_code"), F.lit(None).cast("string").alias("cell"))]
    return wide.select("entity_key", F.explode(F.array(*pairs)).alias("c")).select("entity_key", "c.attr_code", "c.cell").where("cell is not null")


def detail_rows(details: DataFrame) -> DataFrame:
    """product_details in the form :func:`wide_table` takes."""
    return details.select(F.col("product_id").alias("entity_key"), "label", F.col("value_display").alias("value"), "loaded_at", "row_id")


def record_rows(records: DataFrame) -> DataFrame:
    """part_records in the form :func:`wide_table` takes: one row for each label; records without attributes keep one."""
    return records.select(
        F.col("rec_id").cast("string").alias("entity_key"), F.explode_outer("attributes").alias("label", "value"), "loaded_at", F.col("rec_id").alias("row_id")
    )

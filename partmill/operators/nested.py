"""Deeply nested JSON into flat tables that keep the link from child to parent.

Method: the merged schema of all documents is inferred level by level as a table of the fields that hold arrays of objects
(``merged_levels``), from the members of the level above; each array level is exploded into a child table that carries
its parent's key (document id and path) and the ordinal in the array, until a level is empty.  No field is named here but
in ``NAMES``, which says what the levels of this catalog's payloads are called; records of any other shape are flattened
by :func:`related` without it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partmill.functions.text import blank
from partmill.session import durable

# Fixed values: (kind of the parent, field) -> (kind of its members, their text field).
CATEGORY, PRODUCT, ATTRIBUTE, VALUE = ("category", "shortDescription"), ("product", "productNumber"), ("attribute", "label"), ("value", "valueDisplay")
NAMES = {("categories", "categories"): CATEGORY, ("category", "subCategories"): CATEGORY, ("search", "products"): PRODUCT, ("product", "attributeTypes"): ATTRIBUTE, ("attribute", "attributeValues"): VALUE}


def parsed(payloads: DataFrame, body: str = "body") -> DataFrame:
    """The payloads whose body is one complete JSON document, as VARIANT column ``doc``.

    The parser takes the first value of a text and leaves what follows; a body is taken as complete only if, wrapped
    in an array with a further member, it parses as well and has exactly two members.
    """
    text = blank(F.col(body))
    doc = F.try_parse_json(text)
    wrapped = F.try_parse_json(F.concat(F.lit("["), text, F.lit("\n,0]")))
    return payloads.withColumn("doc", doc).where(doc.isNotNull() & (F.size(F.try_variant_get(wrapped, "$", "array<variant>")) == 2))


def members(value: Column) -> Column:
    """The members of an array; an object in place of an array is its only member; anything else has none."""
    kind = F.schema_of_variant(value)
    return F.when(kind.startswith("ARRAY"), F.try_variant_get(value, "$", "array<variant>")).when(kind.startswith("OBJECT"), F.array(value))


def text_of(value: Column, name: str) -> Column:
    return blank(F.try_variant_get(value, f"$.{name}", "string"))


def is_level(value: Column) -> Column:
    """Whether a field's value is an array that may hold objects."""
    return F.schema_of_variant(value).rlike(r"^ARRAY<(OBJECT|VARIANT)")


def fields(parents: DataFrame) -> DataFrame:
    """``parents`` with key, value for each field of their objects."""
    return parents.lateralJoin(parents.sparkSession.tvf.variant_explode(F.col("item").outer())).drop("pos")


def merged_levels(nodes: DataFrame) -> DataFrame:
    """kind, field, parents: the merged schema's array levels as a table: which fields of which kind of node hold them."""
    return fields(nodes).where(is_level(F.col("value"))).groupBy("kind", F.col("key").alias("field")).agg(F.count("*").alias("parents"))


def chosen(pairs: dict, value: int, otherwise: Column | None = None) -> Column:
    """What ``pairs`` says about a node's kind and a field."""
    out = F.when(F.lit(False), F.lit(""))
    for (kind, field), to in pairs.items():
        out = out.when((F.col("kind") == kind) & (F.col("key") == field), F.lit(to[value]))
    return out if otherwise is None else out.otherwise(otherwise)


def children(parents: DataFrame, names: dict | None = None) -> DataFrame:
    """The child tables of all array levels of ``parents`` (payload_id, kind, node_path, names, item), one below the other:
    each row has its parent's path, its own with the ordinal, its kind and text, and the texts from the root down.

    With ``names`` only the levels named there are followed, an object in place of their array is its only member;
    without, every array of objects is a level and its field is its members' kind.
    """
    found = fields(parents)
    if names is None:
        found = found.where(is_level(F.col("value"))).select("*", F.col("key").alias("child"), F.lit(None).cast("string").alias("text_field"))
    else:
        found = found.select("*", chosen(names, 0).alias("child"), chosen(names, 1).alias("text_field")).where("child is not null")
    inner = found.select("payload_id", "child", "text_field", F.col("node_path").alias("parent_path"), F.col("names").alias("above"), F.posexplode(members(F.col("value"))).alias("pos", "item"))
    inner = inner.where(F.schema_of_variant("item").startswith("OBJECT"))
    text = F.lit("")
    for name in sorted({t for _, t in (names or {}).values()}):
        text = F.when(F.col("text_field") == name, text_of(F.col("item"), name)).otherwise(text)
    path = F.concat_ws(".", F.when(F.col("parent_path") != "", F.col("parent_path")), F.col("pos").cast("string"))
    placed = inner.select("payload_id", F.col("child").alias("kind"), "parent_path", path.alias("node_path"), text.alias("node_text"), "above", "item")
    return placed.select("payload_id", "kind", "parent_path", "node_path", "node_text", F.concat("above", F.array("node_text")).alias("names"), "item")


def related(roots: DataFrame, names: dict | None = None) -> DataFrame:
    """All nodes below ``roots`` (payload_id, kind, node_path, item): payload_id, kind, parent_path, node_path, node_text,
    names, item.

    Each level is written once to the shared checkpoint folder and read both for its rows and for the level below; the
    driver only asks whether a level is empty, so neither depth nor the number of fields is bounded by it.
    """
    level = roots.select("payload_id", "kind", "node_path", F.array().cast("array<string>").alias("names"), "item")
    out = None
    while True:
        level = durable(children(level, names))
        out = level if out is None else out.unionByName(level)
        if level.isEmpty():
            return out


def payload_tree(payloads: DataFrame) -> DataFrame:
    """payload_id, kind, parent_path, node_path, node_text, names, item of the nodes of each payload."""
    docs = parsed(payloads).select("payload_id", F.col("kind").alias("of"), F.col("doc").alias("item")).where(F.schema_of_variant("item").startswith("OBJECT"))
    detail = F.col("of") == "product_detail"
    roots = docs.where(F.col("of").isin("categories", "search", "product_detail")).select("payload_id", F.when(detail, "product").otherwise(F.col("of")).alias("kind"), F.when(detail, "0").otherwise("").alias("node_path"), "item", detail.alias("is_node"))
    roots = durable(roots)
    products = roots.where("is_node").select("payload_id", "kind", F.lit("").alias("parent_path"), "node_path", text_of(F.col("item"), PRODUCT[1]).alias("node_text"), F.array(text_of(F.col("item"), PRODUCT[1])).alias("names"), "item")
    return related(roots, NAMES).unionByName(products)


def payload_nodes(payloads: DataFrame) -> DataFrame:
    """payload_id, node_kind, parent_path, node_path, node_text: one row for each node of each payload.

    ``categories`` and ``search`` payloads start at their root array, ``product_detail`` at the root object, whose path
    is ``0``.  Bodies that are null, empty, broken or followed by more text give no rows; absent or null texts are
    ``""``; null members and members that are no objects are no nodes but keep their place in the count.
    Repeated payload ids repeat their rows; further columns don't matter; an empty table gives an empty one.
    """
    return payload_tree(payloads).select("payload_id", F.col("kind").alias("node_kind"), "parent_path", "node_path", "node_text")

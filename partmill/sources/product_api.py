"""Parts and categories out of product-API answers (JSON documents)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partmill.functions.text import blank
from partmill.operators.nested import members, parsed, payload_tree


def is_product_api(doc: Column) -> Column:
    """Whether an answer of the site's own description has an id, which tells the platform."""
    return F.try_variant_get(doc, "$.id", "string").isNotNull() | F.try_variant_get(doc, "$.websiteId", "string").isNotNull()


def breadcrumb_parts(crumbs: Column) -> tuple[Column, Column, Column]:
    """category, subcategory and the rest joined by `` / `` of an array of names without ``Home``."""
    kept = F.filter(crumbs, lambda x: x != "Home")
    return blank(F.get(kept, F.lit(0))), blank(F.get(kept, F.lit(1))), F.array_join(F.slice(kept, F.lit(3), F.greatest(F.size(kept) - 2, F.lit(0))), " / ")


def products(payloads: DataFrame) -> DataFrame:
    """payload_id, pos, part_no, title, labels, values: the products of search and detail answers.

    Values of one label are joined by ``, ``; of a repeated label the last counts (at the first one's place).
    """
    docs = parsed(payloads.where("kind in ('search', 'product_detail')"))
    item = docs.select("payload_id", F.posexplode(F.when(F.col("kind") == "search", members(F.try_variant_get("doc", "$.products", "variant"))).otherwise(F.array("doc"))).alias("pos", "p"))
    types = F.transform(
        F.coalesce(members(F.try_variant_get("p", "$.attributeTypes", "variant")), F.array().cast("array<variant>")),
        lambda t: F.struct(
            blank(F.try_variant_get(t, "$.label", "string")).alias("label"),
            F.array_join(F.transform(F.coalesce(members(F.try_variant_get(t, "$.attributeValues", "variant")), F.array().cast("array<variant>")), lambda v: blank(F.try_variant_get(v, "$.valueDisplay", "string"))), ", ").alias("value"),
        ),
    )
    return item.select(
        "payload_id", "pos", blank(F.try_variant_get("p", "$.productNumber", "string")).alias("part_no"), blank(F.try_variant_get("p", "$.productTitle", "string")).alias("title"), F.map_from_entries(types).alias("attributes")
    )


def category_leaves(payloads: DataFrame) -> DataFrame:
    """payload_id, node_path, names, category, subcategory, series: the categories without children of each tree, with
    the names from the root down."""
    nodes = payload_tree(payloads.where("kind = 'categories'"))
    # the names come down with the tree, and a node knows its children, so nothing is joined back
    below = F.coalesce(members(F.try_variant_get("item", "$.subCategories", "variant")), F.array().cast("array<variant>"))
    leaves = nodes.where(~F.exists(below, lambda x: F.schema_of_variant(x).startswith("OBJECT")))
    category, subcategory, series = breadcrumb_parts(F.col("names"))
    return leaves.select("payload_id", "node_path", "names", category.alias("category"), subcategory.alias("subcategory"), series.alias("series"))

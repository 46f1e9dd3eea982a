"""What changed between consecutive full snapshots.

Method: every row is reduced to a hash of its canonical form, the distinct hashes of one key to an order-free digest,
and the digests of a snapshot and its predecessor are compared by a full outer join on (snapshot, key).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from partmill.functions.text import blank

FIELDS = ("category", "subcategory", "series", "description")


def row_hash(fields: tuple[str, ...] = FIELDS, attributes: str = "attributes") -> Column:
    """SHA-256 of the fields, verbatim, and of the label-value pairs in sorted order.  Null and ``""`` are the same."""
    pairs = F.array_sort(F.transform(F.coalesce(F.map_entries(attributes), F.array().cast("array<struct<key:string,value:string>>")), lambda e: F.struct(blank(e["key"]).alias("k"), blank(e["value"]).alias("v"))))
    return F.sha2(F.to_json(F.struct(*[blank(F.col(f)).alias(f"f{i}") for i, f in enumerate(fields)], pairs.alias("a"))), 256)


def consecutive(snapshots: DataFrame) -> DataFrame:
    """snapshot_id, prev_id, next_id of the complete snapshots of each site, by ``fetched_at`` and then id.

    Only the snapshots' own small rows are sorted for each site, never their parts.
    """
    order = Window.partitionBy("site").orderBy("fetched_at", "snapshot_id")
    return (
        snapshots.where("complete")
        .select("snapshot_id", blank(F.col("site")).alias("site"), "fetched_at")
        .select("snapshot_id", F.lag("snapshot_id").over(order).alias("prev_id"), F.lead("snapshot_id").over(order).alias("next_id"))
    )


def key_digests(parts: DataFrame) -> DataFrame:
    """snapshot_id, part_no, digest: the set of distinct rows of each part number, without their order or number.

    The set is folded into its size and two sums over its members' hashes (partial aggregates); no list is collected,
    so a part number may be repeated in any number of rows.
    """
    distinct = parts.select("snapshot_id", blank(F.col("part_no")).alias("part_no"), row_hash().alias("h")).distinct()
    piece = lambda at: F.conv(F.substring("h", at, 15), 16, 10).cast("decimal(38,0)")
    return distinct.groupBy("snapshot_id", "part_no").agg(F.struct(F.count("*").alias("n"), F.sum(piece(1)).alias("a"), F.sum(piece(16)).alias("b"), F.sum(piece(31)).alias("c")).alias("digest"))


def snapshot_changes(snapshots: DataFrame, parts: DataFrame) -> DataFrame:
    """snapshot_id, part_no, change_kind (``added``, ``removed``, ``changed``) against the complete snapshot before.

    The first complete snapshot of a site has no rows; incomplete snapshots and parts of unknown snapshots are left
    out; a complete snapshot without parts removes all; a null part number is ``""``; a null or empty map is the same.
    Repeated rows, the order of labels and further columns don't matter.  Empty tables give an empty result.
    """
    order = consecutive(snapshots)
    digests = key_digests(parts.join(order.select("snapshot_id"), "snapshot_id", "left_semi"))
    linked = digests.join(order, "snapshot_id")
    new = linked.where("prev_id is not null").select("snapshot_id", "part_no", F.col("digest").alias("new"))
    old = linked.where("next_id is not null").select(F.col("next_id").alias("snapshot_id"), "part_no", F.col("digest").alias("old"))
    kind = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "changed")
    return new.join(old, ["snapshot_id", "part_no"], "full_outer").select("snapshot_id", "part_no", kind.alias("change_kind")).where("change_kind is not null")

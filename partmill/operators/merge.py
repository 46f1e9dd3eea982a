"""Incremental collection: resume, keep-first merge, early stop and drift between snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partmill.operators.match import keep_first
from partmill.operators.snapshots import consecutive


def remaining_units(units: DataFrame, progress: DataFrame, key: str = "unit_key") -> DataFrame:
    """Units of work that are not in the progress log."""
    return units.join(progress.select(key).distinct(), key, "left_anti")


def merge_keep_first(old: DataFrame, new: DataFrame, key: str = "part_no", pos: str = "pos") -> DataFrame:
    """Rows of ``old`` first, then those of ``new`` whose key is not there; the first row of each key counts."""
    both = old.withColumn("src_rank", F.lit(0)).unionByName(new.withColumn("src_rank", F.lit(1)))
    return keep_first(both, [key], ["src_rank", pos])


def snapshot_drift(snapshots: DataFrame, parts: DataFrame) -> DataFrame:
    """snapshot_id, old_parts, new_parts, halved, attributes_vanished: each complete snapshot against the one before.

    halved: fewer than half as many parts; attributes_vanished: more than half of the old parts had attributes and none
    of the new ones has.
    """
    order = consecutive(snapshots).where("prev_id is not null")
    counts = parts.groupBy("snapshot_id").agg(F.count("*").alias("n"), F.count_if(F.size(F.coalesce(F.map_keys("attributes"), F.array().cast("array<string>"))) > 0).alias("with_attributes"))
    old = counts.select(F.col("snapshot_id").alias("prev_id"), F.col("n").alias("old_n"), F.col("with_attributes").alias("old_with"))
    joined = order.join(counts, "snapshot_id", "left").join(old, "prev_id", "left").na.fill(0, ["n", "with_attributes", "old_n", "old_with"])
    return joined.select(
        "snapshot_id",
        F.col("old_n").alias("old_parts"),
        F.col("n").alias("new_parts"),
        (F.col("n") < 0.5 * F.col("old_n")).alias("halved"),
        ((F.col("old_with") > 0.5 * F.col("old_n")) & (F.col("with_attributes") == 0)).alias("attributes_vanished"),
    )


def added_count(before: DataFrame, after: DataFrame) -> DataFrame:
    """added: by how many rows ``after`` is longer, never below zero."""
    return before.agg(F.count("*").alias("a")).crossJoin(after.agg(F.count("*").alias("b"))).select(F.greatest(F.lit(0), F.col("b") - F.col("a")).alias("added"))

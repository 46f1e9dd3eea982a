"""A requested part list against a catalog: exact, then normalised keys, with collisions reported."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from partmill.functions.keys import normalize_key
from partmill.functions.text import blank

#: Behind the number of candidates in the note of a collision.
COLLISION = "different source part numbers normalize to the same value"


def keep_first(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by ``order``; a partial aggregate of the smallest row, not a window, so hot keys are
    reduced before the shuffle."""
    rest = [c for c in rows.columns if c not in keys and c not in order]
    best = rows.groupBy(*keys).agg(F.min_by(F.struct(*order, *rest), F.struct(*order)).alias("first"))
    return best.select(*keys, "first.*").select(*rows.columns)


def candidates(parts: DataFrame, keys: DataFrame) -> DataFrame:
    """norm_key, n, part_nos: the distinct part numbers of each wanted normalised key (norm_key) in first-seen order.

    Only keys that an entry asks for are listed, and the list is what the report's row holds.
    """
    first = parts.select(blank(F.col("part_no")).alias("part_no"), "pos").groupBy("part_no").agg(F.min("pos").alias("pos")).withColumn("norm_key", normalize_key(F.col("part_no")))
    wanted = first.join(keys.select("norm_key").distinct(), "norm_key", "left_semi")
    grouped = wanted.groupBy("norm_key").agg(F.array_sort(F.collect_list(F.struct("pos", "part_no"))).alias("c"))
    return grouped.select("norm_key", F.size("c").alias("n"), F.transform("c", lambda x: x["part_no"]).alias("part_nos"))


def match_report(entries: DataFrame, parts: DataFrame) -> DataFrame:
    """entry_id, filter_raw, match_type, matched_part_nos, note: one row for each entry.

    entries: entry_id, raw; parts: part_no, pos.  Two equi-joins, never one with OR: distinct texts of entries are
    matched once, then the entries take the result of their text.
    """
    texts = entries.select(blank(F.col("raw")).alias("raw")).distinct().withColumn("norm_key", normalize_key(F.col("raw")))
    exact = parts.select(blank(F.col("part_no")).alias("raw")).distinct().withColumn("is_exact", F.lit(True))
    marked = texts.join(exact, "raw", "left")
    joined = marked.join(candidates(parts, marked.where("is_exact is null")), "norm_key", "left")
    kind = F.when(F.col("is_exact"), "exact").when(F.col("n") == 1, "normalized").when(F.col("n") > 1, "collision").otherwise("unmatched")
    result = joined.select("raw", kind.alias("match_type"), F.when(F.col("is_exact"), F.array("raw")).otherwise(F.coalesce("part_nos", F.array().cast("array<string>"))).alias("matched_part_nos"))
    out = entries.select("entry_id", blank(F.col("raw")).alias("raw")).join(result, "raw")
    return out.select("entry_id", F.col("raw").alias("filter_raw"), "match_type", "matched_part_nos", F.when(F.col("match_type") == "collision", F.concat_ws(" ", F.size("matched_part_nos").cast("string"), F.lit(COLLISION))).otherwise("").alias("note"))


def summary(report: DataFrame) -> DataFrame:
    """match_type, n: how many entries were matched in each way."""
    return report.groupBy("match_type").agg(F.count("*").alias("n"))


def matched_parts(parts: DataFrame, report: DataFrame) -> DataFrame:
    """The parts whose number was matched, the first of each number, in source order of ``pos``."""
    wanted = report.select(F.explode("matched_part_nos").alias("part_no")).distinct()
    return keep_first(parts.join(wanted, "part_no", "left_semi"), ["part_no"], ["pos"])


def lookup(entries: DataFrame, hits: DataFrame) -> DataFrame:
    """Search hits whose normalised number equals the entry's (entry_id, raw; part_no, pos), the first of each number.

    Repeated hits are reduced before the join, so it gives no more rows than the result has.
    """
    first = keep_first(hits, ["part_no"], ["pos"]).withColumn("k", normalize_key(F.col("part_no")))
    return entries.select("entry_id", normalize_key(F.col("raw")).alias("k")).distinct().join(first, "k").drop("k")


def is_covered(wanted: DataFrame, found: DataFrame, key: str) -> bool:
    """Whether every wanted key was found, for stopping a collection early."""
    return wanted.select(key).join(found.select(key), key, "left_anti").isEmpty()


def top_per_key(rows: DataFrame, key: str, order: list[str], n: int) -> DataFrame:
    """The first ``n`` rows of each key (Spark limits the groups before the shuffle)."""
    return rows.withColumn("rank_in_key", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("rank_in_key") <= n)

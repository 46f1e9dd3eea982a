"""Pages that arrive over time: each finished batch is read, merged keep-first into the catalog and never read again.

The stream's checkpoint is the progress log: a second run on the same checkpoint takes only what is new, and a run that
was stopped goes on where it was.  The catalog is kept in versions, so a batch that is run again after a failure
replaces the version it had begun.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partmill.operators.match import keep_first
from partmill.operators.pages import parse_pages

PAGES = "doc string, page_no int, text string"
PARTS = "part_no string, doc string, series string, description string, pos long"


def page_parts(pages: DataFrame) -> DataFrame:
    """part_no, doc, series, description, pos (page and index in one number) of pages."""
    rows = parse_pages(pages).select("doc", "page_no", F.inline("parts"))
    return rows.select("part_no", "doc", "series", "description", (F.col("page_no").cast("long") * 1_000_000 + F.col("idx")).alias("pos"))


def catalog_version(spark: SparkSession, root: str, batch: int) -> DataFrame:
    """The catalog after a batch: what each batch up to it added; empty before the first."""
    if batch < 0:
        return spark.createDataFrame([], PARTS)
    return spark.read.schema(f"{PARTS}, batch long").parquet(f"{root}/catalog").where(F.col("batch") <= batch).drop("batch")


def merge_batch(root: str, progress: Callable[[str, float], None] | None = None) -> Callable[[DataFrame, int], None]:
    """The function for ``foreachBatch``: it writes the part numbers that are new in batch n, and nothing else, so n
    batches cost n times a batch; a batch that is run again overwrites what it wrote."""

    def run(batch: DataFrame, n: int) -> None:
        if progress:
            progress(f"batch {n}", -1.0)
        known = catalog_version(batch.sparkSession, root, n - 1).select("part_no")
        new = keep_first(page_parts(batch), ["part_no"], ["pos", "doc"]).join(known, "part_no", "left_anti")
        new.select("part_no", "doc", "series", "description", "pos").write.mode("overwrite").parquet(f"{root}/catalog/batch={n}")

    return run


def collect_available(spark: SparkSession, source: str, root: str, files_per_batch: int = 1000, progress: Callable[[str, float], None] | None = None):
    """Reads all page files (JSON lines) that arrived in ``source`` since the last run and returns the ended query."""
    pages = spark.readStream.schema(PAGES).option("maxFilesPerTrigger", files_per_batch).json(source)
    query = pages.writeStream.foreachBatch(merge_batch(root, progress)).option("checkpointLocation", f"{root}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def windowed_counts(events: DataFrame, delay: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events for each window and type of a stream or table; late rows beyond ``delay`` don't reopen a window."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value")).select("w.start", "event_type", "n", "value")

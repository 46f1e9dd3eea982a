"""Pages of binary documents: a distributed scan whose extractor of texts is injected."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partmill.sources.store import content_hash

UNREADABLE = "The document can't be read; it may be damaged or locked."


def document_pages(spark: SparkSession, path: str, texts_of: Callable[[bytes], list[str | None]]) -> DataFrame:
    """doc (SHA-256 of the content), path, page_no (from 1), text, error of the documents at ``path``.

    ``texts_of`` gives the text of each page; whatever it raises, the document has one row with page 0 and ``error``, so a
    damaged file ends no scan.  Files are read where their tasks run.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for doc, name, content in zip(pdf["doc"], pdf["path"], pdf["content"]):
                try:
                    rows = [(doc, name, n, text or "", None) for n, text in enumerate(texts_of(bytes(content)), 1)]
                except Exception:  # noqa: BLE001 - readers of documents fail in many ways
                    rows = [(doc, name, 0, None, UNREADABLE)]
                yield pd.DataFrame(rows, columns=["doc", "path", "page_no", "text", "error"], dtype=object)

    files = spark.read.format("binaryFile").load(path).select(content_hash(F.col("content")).alias("doc"), "path", "content")
    return files.mapInPandas(read, "doc string, path string, page_no int, text string, error string")

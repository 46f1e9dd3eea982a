"""Evaluation passages inside training text.

Method: MinHash containment search with size partitions, verified by exact shingle containment.  Query and domain sets
of very different sizes have a small Jaccard similarity even when one contains the other, so both sides are cut into
windows of one size class: every ``run`` consecutive words are a set of ``run - shingle + 1`` shingles of five words.
Within that class containment of a window equals Jaccard similarity one, and equal sets have equal MinHash values:
one hash function finds every contained window with certainty.  Consecutive windows mostly share their minimum, so only
changes of the minimum are kept (about two in nine positions).  Candidates are windows of equal MinHash; they are
verified by the exact text of the window.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partmill.session import durable

WORD = re.compile(r"[^\W_]+")
RUN, SHINGLE = 12, 5
#: Distinct MinHash values of the query side up to which they are sent to every worker (8 bytes each).
MOST_SENT = 4_000_000


def words_of(text: str | None) -> list[str]:
    """Unbroken runs of letters and digits of any script, case folded."""
    return [w.casefold() for w in WORD.findall(text or "")]


@lru_cache(1 << 18)
def word_hash(word: str) -> int:
    return xxhash.xxh64_intdigest(word)


def shingle_hashes(words: list[str], size: int = SHINGLE) -> np.ndarray:
    """A 64-bit hash of every ``size`` consecutive words."""
    h = np.fromiter(map(word_hash, words), np.uint64, len(words))
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(size):
            out = out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n]
        out ^= out >> np.uint64(31)  # the minimum needs well-mixed high bits
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(29)
    return out


def window_minima(words: list[str], run: int = RUN, size: int = SHINGLE) -> np.ndarray:
    """The MinHash of the shingles of every window of ``run`` words; as signed 64-bit values."""
    s = shingle_hashes(words, size)
    k = run - size + 1
    n = len(s) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    low = s[:n].copy()
    for i in range(1, k):
        np.minimum(low, s[i : i + n], out=low)
    return low.view(np.int64)


WINDOWS = "id long, minhash long, window string"


def windows(texts: DataFrame, run: int = RUN) -> DataFrame:
    """id, minhash, window: every distinct window of each text, with its words joined by blanks."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for key, text in zip(pdf["id"], pdf["text"]):
                words = words_of(text)
                rows += {(key, int(m), " ".join(words[i : i + run])) for i, m in enumerate(window_minima(words, run))}
            yield pd.DataFrame(rows, columns=["id", "minhash", "window"])

    return texts.mapInPandas(read, WINDOWS)


def document_minima(docs: DataFrame, run: int = RUN) -> DataFrame:
    """id, minhash: the distinct MinHash values of each document's windows, without their texts."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            minima = [np.unique(window_minima(words_of(text), run)) for text in pdf["text"]]
            yield pd.DataFrame({"id": np.repeat(pdf["id"].to_numpy(np.int64), [len(m) for m in minima]), "minhash": np.concatenate([np.zeros(0, np.int64), *minima])})

    return docs.mapInPandas(read, "id long, minhash long")


def positions_of(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Where ``values`` are among the sorted ``ordered``, by binary search."""
    if not len(values) or not len(ordered):
        return np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)
    return np.flatnonzero(ordered[at] == values)


def candidate_windows(docs: DataFrame, wanted: np.ndarray | None, run: int = RUN) -> DataFrame:
    """Windows of the documents whose MinHash is among ``wanted`` (sorted) or, if that is None, among the document's own
    ``wanted`` column.

    Documents of fewer than ``run`` words are a size class that can't contain a window and end here.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keys, found = [], []
            for key, text, own in zip(pdf["id"], pdf["text"], pdf["wanted"]):
                words = words_of(text)
                low = window_minima(words, run)
                for i in positions_of(low, wanted if wanted is not None else np.sort(np.asarray(own, np.int64))):
                    keys.append(key)
                    found.append(" ".join(words[i : i + run]))
            yield pd.DataFrame({"id": pd.Series(keys, dtype="int64"), "window": pd.Series(found, dtype="object")})

    if wanted is not None:
        docs = docs.withColumn("wanted", F.lit(None).cast("array<long>"))
    return docs.select("id", "text", "wanted").mapInPandas(read, "id long, window string")


def contained(docs: DataFrame, items: DataFrame, run: int = RUN, most: int = MOST_SENT) -> DataFrame:
    """doc_id, item_id of each document that contains ``run`` consecutive words of an item.

    docs: doc_id, text; items: item_id, text.  Null, empty and short texts have no windows; repeated rows give their
    pair once; texts may be of any length; further columns don't matter; empty tables give an empty result.
    The items' MinHash values are sent to the workers while there are at most ``most`` of them; beyond that, the values
    of the documents' windows, 8 bytes each, are joined with them first, and only the windows that match are read again.
    The items' windows are broadcast for the verification only if their rows, not just their values, are few.
    """
    queries = durable(windows(items.select(F.col("item_id").alias("id"), "text").where("text is not null"), run))
    texts = docs.select(F.col("doc_id").alias("id"), "text").where("text is not null")
    distinct = queries.select("minhash").distinct()
    sent = distinct.limit(most + 1).toPandas()["minhash"].to_numpy()
    if len(sent) <= most:
        found = candidate_windows(texts, np.sort(sent), run)
    else:
        hits = document_minima(texts, run).join(distinct, "minhash", "left_semi").groupBy("id").agg(F.collect_set("minhash").alias("wanted"))
        found = candidate_windows(texts.join(hits, "id"), None, run)
    # verified by the exact words
    side = queries.select(F.col("id").alias("item_id"), "window")
    side = F.broadcast(side) if side.limit(most // 20 + 1).count() <= most // 20 else side
    return found.select(F.col("id").alias("doc_id"), "window").join(side, "window").select("doc_id", "item_id").distinct()

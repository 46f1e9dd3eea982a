"""Encoding of a corpus with a public byte-level BPE vocabulary.

Method: pre-tokenisation without regular expressions.  A batch of texts is one array of code points; each gets a class
(letter, number, space, other white space, other); the boundaries follow from scans with associative functions over
these classes (a running maximum carries the start of a run, a backward running minimum its end).  The slices between
boundaries feed a cached pair merging; offsets are kept for decoding.

The pre-tokeniser's rule, in words: the contractions 's 't 're 've 'm 'll 'd; an optional blank and a run of letters,
of numbers, or of other signs; runs of white space, of which the last character before a sign is set apart (a blank
goes to the sign's slice).
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
OTHER, LETTER, NUMBER, WHITE, BLANK = 0, 1, 2, 3, 4
# Code points of white space, and the contractions.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
CONTRACTIONS = ["s", "t", "re", "ve", "m", "ll", "d"]
#: Characters of texts handled at once, so that a batch of very long texts doesn't need memory in proportion to itself.
BLOCK = 1 << 20


@lru_cache(1)
def classes() -> np.ndarray:
    """The class of every code point."""
    table = np.zeros(0x110000, np.uint8)
    for point in range(0x110000):
        major = unicodedata.category(chr(point))[0]
        if major == "L":
            table[point] = LETTER
        elif major == "N":
            table[point] = NUMBER
    table[WHITE_SPACE] = WHITE
    table[0x20] = BLANK
    return table


def boundaries(points: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
    """Which positions start a slice.  points: code points of all texts; text_starts: where each non-empty text begins."""
    n = len(points)
    kind = classes()[points]
    group = np.where(kind == BLANK, WHITE, kind)
    first = np.zeros(n, bool)
    first[text_starts] = True
    run = first.copy()  # a run of one group starts
    run[1:] |= group[1:] != group[:-1]
    index = np.arange(n)
    last = np.empty(n, bool)  # the last character of a run
    last[:-1] = run[1:]
    last[-1] = True
    text_end = np.empty(n, bool)
    text_end[:-1] = first[1:]
    text_end[-1] = True
    white = group == WHITE
    start = run.copy()
    # the last white character before a sign is set apart from the white space before it
    apart = white & last & ~text_end
    start |= apart
    # a blank set apart goes with the run behind it
    joined = np.zeros(n, bool)
    joined[1:] = apart[:-1] & (kind[:-1] == BLANK)
    start &= ~joined
    # contractions: a lone apostrophe that starts a slice, with letters behind it
    lone = np.flatnonzero((points == 0x27) & run & last & ~joined & ~text_end)
    if len(lone):
        begin = np.maximum.accumulate(np.where(run, index, 0))  # start of the run that holds a position
        end = np.empty(n, np.int64)  # position behind the run that holds a position
        end[::-1] = np.minimum.accumulate(np.where(last, index + 1, n)[::-1])
        a = points[np.minimum(lone + 1, n - 1)]
        b = points[np.minimum(lone + 2, n - 1)]
        length = end[np.minimum(lone + 1, n - 1)] - begin[np.minimum(lone + 1, n - 1)]
        size = np.zeros(len(lone), np.int64)
        for word in CONTRACTIONS:
            match = (a == ord(word[0])) & (length >= len(word))
            if len(word) == 2:
                match &= b == ord(word[1])
            size[match & (size == 0)] = len(word)
        found = size > 0
        at, size = lone[found], size[found]
        start[at + 1] = False
        behind = at + 1 + size
        behind = behind[behind < n]
        start[behind] = True  # what is left of the run; the start of the next run or text is one already, but for a joined one
        restart = behind[joined[behind]]
        start[restart] = True
    return start


class Merger:
    """Pair merging with a cache of slices; ``ranks``: bytes -> id, lower ids are merged first."""

    def __init__(self, ranks: dict[bytes, int], kept: int = 1 << 18):
        self.ranks, self.kept, self.cache = ranks, kept, {}

    def ids(self, piece: str) -> list[int]:
        found = self.cache.get(piece)
        if found is None:
            raw = piece.encode("utf-8", "surrogatepass")
            whole = self.ranks.get(raw)
            found = [whole] if whole is not None else self.merge(raw)
            if len(piece) <= 64:  # long slices hardly come again
                if len(self.cache) >= self.kept:
                    self.cache.clear()
                self.cache[piece] = found
        return found

    def merge(self, raw: bytes) -> list[int]:
        """Merges the pair of lowest rank, the leftmost first, until none is left; in n log n steps."""
        ranks, n = self.ranks, len(raw)
        following, before = list(range(1, n + 1)), list(range(-1, n - 1))
        parts: list[bytes | None] = [raw[i : i + 1] for i in range(n)]
        heap = [(r, i, raw[i : i + 2]) for i in range(n - 1) if (r := ranks.get(raw[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, pair = heapq.heappop(heap)
            left = parts[i]
            if left is None or (j := following[i]) >= n or left + parts[j] != pair or len(left) == len(pair):
                continue
            parts[i], parts[j] = pair, None
            following[i] = k = following[j]
            if k < n:
                before[k] = i
                if (r := ranks.get(pair + parts[k])) is not None:
                    heapq.heappush(heap, (r, i, pair + parts[k]))
            if (h := before[i]) >= 0 and (r := ranks.get(parts[h] + pair)) is not None:
                heapq.heappush(heap, (r, h, parts[h] + pair))
        return [ranks[p] for p in parts if p is not None]


@lru_cache(2)
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}


@lru_cache(2)
def merger(path: str) -> Merger:
    return Merger(load_ranks(path))


def encode_texts(texts: list[str], path: str = VOCABULARY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, number of ids of each text, start of each id's slice in its text in code points) of non-null texts."""
    merge = merger(path)
    cached, lookup = merge.cache, merge.ids
    all_ids: list[np.ndarray] = []
    counts = np.zeros(len(texts), np.int64)
    all_offsets: list[np.ndarray] = []
    i = 0
    while i < len(texts):
        block, size = [], 0
        first = i
        while i < len(texts) and (not block or size < BLOCK):
            block.append(texts[i])
            size += len(texts[i])
            i += 1
        joined = "".join(block)
        if not joined:
            continue
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.fromiter(map(len, block), np.int64, len(block))
        begins = np.concatenate([[0], np.cumsum(lengths)])
        starts = np.flatnonzero(boundaries(points, begins[:-1][lengths > 0]))
        cuts = starts.tolist()
        cuts.append(len(joined))
        pieces = [cached.get(p) or lookup(p) for p in map(joined.__getitem__, map(slice, cuts[:-1], cuts[1:]))]
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ids = np.fromiter((x for p in pieces for x in p), np.int32, int(sizes.sum()))
        of_text = np.searchsorted(begins, starts, side="right") - 1
        counts[first:i] = np.bincount(of_text, weights=sizes, minlength=len(block)).astype(np.int64)[: len(block)]
        all_ids.append(ids)
        all_offsets.append(np.repeat(starts - begins[of_text], sizes))
    none = [np.zeros(0, np.int32)]
    return np.concatenate(all_ids or none), counts, np.concatenate(all_offsets or none).astype(np.int32)


def encode(docs: DataFrame, text: str = "text", path: str = VOCABULARY, keep: tuple[str, ...] = ("doc_id",), offsets: bool = False) -> DataFrame:
    """``keep`` columns, ids ARRAY<INT>, and with ``offsets`` the start (in code points) of each id's slice.

    Every row of ``docs`` has one row: an empty list for null and empty texts, blank texts as they are, no special
    tokens (their strings are ordinary text), texts of any length.  Rows are independent: no shuffle, one pass.
    ``path`` is a rank file that every executor can read.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(len(keep))
            texts = [x or "" for x in column.to_pylist()]
            ids, counts, starts = encode_texts(texts, path)
            ends = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
            out = [batch.column(i) for i in range(len(keep))] + [pa.ListArray.from_arrays(ends, pa.array(ids, pa.int32()))]
            names = [*keep, "ids"]
            if offsets:
                out.append(pa.ListArray.from_arrays(ends, pa.array(starts, pa.int32())))
                names.append("offsets")
            yield pa.RecordBatch.from_arrays(out, names=names)

    wanted = docs.select(*keep, F.col(text).alias("text__"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in wanted.schema.fields[:-1]), "ids array<int>", *(["offsets array<int>"] if offsets else [])])
    return wanted.mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str = VOCABULARY, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and text: the bytes of the ids joined and read as UTF-8."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = {v: k for k, v in load_ranks(path).items()}
        for batch in batches:
            texts = [b"".join(map(tokens.__getitem__, ids or [])).decode("utf-8", "replace") for ids in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(texts, pa.string())], names=[*keep, "text"])

    wanted = encoded.select(*keep, "ids")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in wanted.schema.fields[:-1]), "text string"])
    return wanted.mapInArrow(run, schema)

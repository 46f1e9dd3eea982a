"""Slots of segment templates, induced from all documents, and the documents whose slots were never filled.

Segments with equal words before and after a gap share a template; what stands in the gap in the others are its fillers.
A gap with different words, different delimited names, or with numbers over several documents is a slot, and a segment
that has a delimited or underscored name, a default or nothing there was left unfilled.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partmill.session import durable

NAME = r"[A-Za-z][\w]*(?:[._\-][A-Za-z]\w*)*"
# Delimiters that nothing but a template uses, around a variable name.
STRONG = (
    rf"\{{\{{[\s#/&^>{{-]*(?P<a>{NAME})[^{{}}]*\}}\}}|\$\{{\s*(?P<b>{NAME})\s*\}}|#\{{\s*(?P<c>{NAME})\s*\}}|<%[=\-#]?\s*(?P<d>{NAME})[^%<>]*%>|\{{%-?\s*(?P<e>{NAME})[^%{{}}]*%\}}"
    rf"|%%\s?(?P<f>{NAME})\s?%%|@@\s?(?P<g>{NAME})\s?@@|\[\[\s*(?P<h>{NAME})\s*\]\]|(?<![A-Za-z0-9_])__(?P<i>[A-Za-z][A-Za-z0-9_.]*?)__(?![A-Za-z0-9_])|\$(?P<j>{NAME})\$"
    rf"|<your[ _-](?P<k>{NAME})>|\[your[ _-](?P<l>{NAME})\]|\[(?P<m>{NAME})(?: goes)? here\]|[<\[]insert[ _-](?P<n>{NAME})(?: here)?[>\]]|<(?P<o>{NAME})(?: goes) here>"
)
#: Different fillers, or documents with a number, that make a gap a slot.
LEAST_FILLERS = 3
#: Documents with a filler for each one with a default or nothing in the slot; what is more frequent was meant so.
FILLED_EACH = 10
#: Words of the template around a slot; fewer are enough before a colon at the line's end.
LEAST_FIXED = 3
#: Words of a filler.
MOST_FILLER = 3
#: Keys of gaps up to which they are sent to the workers (about 100 bytes each), so that other gaps are not even listed.
MOST_SENT = 200_000
MARK = rf"(?P<mark>{re.sub(r'[?]P<[a-o]>', '?:', STRONG)}|\[\s*{NAME}\s*\]|<\s*{NAME}\s*>|\{{\s*{NAME}\s*\}}|%{NAME}%|@{NAME}@)"
REST = (
    r"(?P<default>#?\bn/a\b|\b(?:tbd|tbc|tba|todo|null|none|nan|undefined|default|x{3,})\b|\?{2,}|_{2,}|-{2,})"
    r"|(?P<number>(?:\w[\w-]*)?\d(?:[\w.,/-]*\w)?)|(?P<name>[^\W_]+(?:_[^\W_]+)+)|(?P<word>\w[\w'’-]*)|(?P<other>[^\w\s])"
)
PIECE, PLAIN = re.compile(f"{MARK}|{REST}", re.I), re.compile(REST, re.I)
#: Characters without which a text has no delimited name.
DELIMITING = re.compile(r"[{}\[\]<>%@$#_]")


def template_of(segment: str) -> tuple[str, list[int]]:
    """(its pieces in lower case with numbers as ``#`` and ``¤`` before delimited names, the gaps between pieces in which a word seems to be missing)."""
    pieces, empty, end = [], [], 0
    for m in (PIECE if DELIMITING.search(segment) else PLAIN).finditer(segment):
        between = segment[end : m.start()]
        if pieces and (len(between) > 1 or between and m[0] in ".,;)"):
            empty.append(len(pieces))
        pieces.append("#" if m.lastgroup == "number" else ("¤" if m.lastgroup == "mark" else "") + re.sub(r"\s", "", m[0]).lower())
        end = m.end()
    return " ".join(pieces), empty


@lru_cache(1 << 16)
def kind_of_piece(piece: str) -> str:
    return "number" if piece == "#" else "mark" if piece.startswith("¤") else PIECE.fullmatch(piece).lastgroup


def halves(pieces: list[str]) -> tuple[list[int], list[int]]:
    """Hashes of the pieces before each place and of those from it on.  Other slots of the template, numbers and delimited
    names, are alike."""
    pieces = ["#" if p.startswith("¤") else p for p in pieces]
    before, after = [0], [0]
    for p in pieces:
        before.append(zlib.crc32(f"{p} ".encode(), before[-1]))
    for p in reversed(pieces):
        after.append(zlib.crc32(f"{p} ".encode(), after[-1]))
    return before, after[::-1]


class Wanted:
    """Keys of gaps that are looked for; None stands for all."""

    def __init__(self, keys: list[int] | None):
        self.keys = None if keys is None else frozenset(keys)
        self.starts = None if keys is None else frozenset(k + (1 << 63) >> 32 for k in keys)


ALL = Wanted(None)


def gaps(template: str, widths: range, wanted: Wanted = ALL, numbers: bool = False) -> Iterator[tuple[int, int, list[str], int]]:
    """(i, j, kinds of the pieces in the gap, key) of the gaps that have enough of a template around them; only those that
    are wanted, and only those that hold a number if ``numbers``."""
    pieces = template.split(" ")
    kinds = [kind_of_piece(p) for p in pieces]
    is_word = [k == "word" for k in kinds]
    words, n = sum(is_word), len(pieces)
    if words < LEAST_FIXED and ":" not in pieces:
        return
    before, after = halves(pieces)
    places = range(n + 1)
    if numbers:
        places = sorted({i for at, k in enumerate(kinds) if k == "number" for i in range(max(0, at - widths[-1] + 1), at + 1)})
    for i in places:
        if wanted.starts is not None and before[i] not in wanted.starts:
            continue
        inside = 0
        for j in range(i, min(n, i + widths[-1]) + 1):
            inside += j > i and is_word[j - 1]
            if j - i in widths and (words - inside >= LEAST_FIXED or (j == n and i > 1 and pieces[i - 1] == ":" and any(is_word[:i]))):
                key = (before[i] << 32 | after[j]) - (1 << 63)
                if wanted.keys is None or key in wanted.keys:
                    yield i, j, kinds[i:j], key


def few(keys: DataFrame) -> Wanted:
    """The keys themselves if they are few enough to be sent to the workers, else all."""
    sent = keys.limit(MOST_SENT + 1).collect()
    return Wanted([r.key for r in sent]) if len(sent) <= MOST_SENT else ALL


def fillers(numbers: bool, wanted: Wanted = ALL):
    """key, number, n, filler: what forms have in their gaps (words, numbers or a delimited name); only those with a number if
    ``numbers``."""

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for template, n in zip(pdf["template"], pdf["n"]):
                if numbers and "#" not in template:
                    continue
                pieces = template.split(" ")
                for i, j, kinds, key in gaps(template, range(1, MOST_FILLER + 1), wanted, numbers):
                    number = "number" in kinds
                    if all(k in ("word", "number") for k in kinds) and (number or not numbers) or kinds == ["mark"]:
                        out.append((key, number, n, zlib.crc32(" ".join(pieces[i:j]).encode())))
            yield pd.DataFrame(out, columns=["key", "number", "n", "filler"])

    return spread


def unfilled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """form, key, kind, n: gaps that hold a name, a default, or nothing where something seems to be missing."""
    for pdf in batches:
        out = []
        for form, template, empty, n in zip(pdf["form"], pdf["template"], pdf["empty"], pdf["n"]):
            at, last = set(empty), template.count(" ") + 1
            for i, j, kinds, key in gaps(template, range(0, 2)):
                if i < j and kinds[0] in ("mark", "name", "default"):
                    out.append((form, key, kinds[0], n))
                elif i == j and (i in at or (i == last and template.endswith(" :"))):
                    out.append((form, key, "nothing", n))
        yield pd.DataFrame(out, columns=["form", "key", "kind", "n"])


def without_number(wanted: Wanted):
    """The same for every gap with nothing in it: a number may be missing there.  Only within the template: at its ends
    a text cut off looks the same."""

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(form, key, "nothing", n) for form, template, n in zip(pdf["form"], pdf["template"], pdf["n"]) for last in [template.count(" ")] for i, _, _, key in gaps(template, range(0, 1), wanted) if 0 < i <= last]
            yield pd.DataFrame(out, columns=["form", "key", "kind", "n"])

    return probe


def unfilled_documents(parts: DataFrame) -> DataFrame:
    """doc_id of the documents (doc_id, template, empty; a row for each segment) that have an unfilled slot."""
    parts = parts.withColumn("form", F.xxhash64("template", "empty"))
    # a form's hash stands for it: a long segment has many gaps
    forms = parts.groupBy("form").agg(F.any_value("template").alias("template"), F.any_value("empty").alias("empty"), F.count("*").alias("n"))
    filler, probe = "key long, number boolean, n long, filler long", "form long, key long, kind string, n long"
    filled = F.sum("n").alias("filled")
    forms = durable(forms)
    numbers = durable(forms.mapInPandas(fillers(True), filler).groupBy("key").agg(filled).where(F.col("filled") >= LEAST_FILLERS).select("key"))
    probes = durable(forms.mapInPandas(unfilled, probe).unionByName(forms.mapInPandas(without_number(few(numbers)), probe).join(numbers, "key", "left_semi")).distinct())
    wanted = durable(probes.select("key").distinct())
    found = forms.mapInPandas(fillers(False, few(wanted)), filler).join(wanted, "key", "left_semi")
    slots = found.groupBy("key").agg(filled, F.count_distinct("filler").alias("fillers"), F.sum(F.when(F.col("number"), F.col("n")).otherwise(0)).alias("numbers"))
    slots = slots.where((F.col("fillers") >= LEAST_FILLERS) | (F.col("numbers") >= LEAST_FILLERS))
    kept = probes.groupBy("key", "kind").agg(F.sum("n").alias("open")).join(slots, "key").where(F.col("kind").isin("mark", "name") | (F.col("filled") >= FILLED_EACH * F.col("open"))).select("key", "kind")
    bad = probes.join(kept, ["key", "kind"]).select("form").distinct()
    return parts.join(bad, "form").select("doc_id")

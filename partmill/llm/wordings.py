"""The vocabulary of worded places, taught by the listings' own labels, and which wordings mean the same.

``vocabulary`` counts what stands behind which label.  ``same_wordings`` takes pairs of neighbours of a sorted
neighbourhood pass, which state the same series and size, and asks for each two wordings of a place how often they face
each other against how often they face themselves; wordings that do so alike are linked and clustered.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partmill.functions.text import blank, letters_digits
from partmill.llm.facets import LABELLED, LENGTH, LENGTHS, plain, tokens
from partmill.session import durable

#: Listings that must state a wording before it is part of the vocabulary.
LEAST_LISTINGS = 3
#: Part of a place's labelled statements that the vocabulary holds, and part of its statements without a label.
CLOSED, BARE = 0.9, 0.05
#: Statements of a place for each listing, and the part of the listings that state a place.
LEAST_STATED, FILLED = 0.25, 0.9
#: Wordings and labels up to which the vocabulary is sent to the workers; beyond, it is joined.
MOST_SENT = 200_000
#: How alike two wordings face each other and themselves: 1 for wordings chosen at will, near 0 for different things.
ALIKE = 0.3


def statements(listings: DataFrame) -> DataFrame:
    """label, phrase, n: how many listings state a phrase behind a label (``""`` for a field without one)."""
    fields = F.transform(F.split(blank(F.col("description")), "[,;|]"), lambda f: F.struct(F.regexp_extract(f, r"(?s)^\s*([^:=]{2,40}?)\s*[:=]\s*(.+)$", 1).alias("key"), F.coalesce(F.nullif(F.regexp_extract(f, r"(?s)^\s*([^:=]{2,40}?)\s*[:=]\s*(.+)$", 2), F.lit("")), f).alias("value")))
    entries = F.coalesce(F.map_entries("attributes"), F.array().cast("array<struct<key:string,value:string>>"))
    one = listings.select(F.explode(F.concat(entries, fields)).alias("e")).groupBy("e").agg(F.count("*").alias("n"))
    phrase = F.when(F.lower(F.col("e.value")).rlike(LENGTH), LENGTHS).otherwise(letters_digits(F.col("e.value")))
    stated = one.select(letters_digits(F.col("e.key")).alias("label"), phrase.alias("phrase"), "n").where(f"phrase = '{LENGTHS}' or phrase rlike '\\\\p{{L}}'")
    return stated.groupBy("label", "phrase").agg(F.sum("n").alias("n"))


def vocabulary(listings: DataFrame) -> tuple[DataFrame, list[str], str]:
    """(kind, term, place of each wording (kind ``phrase``) and label (``label``) of a place; the places; the size's).

    The place of a wording is named by the label that stands before it most; labels before the same wordings take the
    same name.  Places are those whose labelled statements are nearly all in the vocabulary (so names, prices and dates
    are none) and whose wordings stand without a label too (so yes/no marks are none).
    """
    stated = durable(statements(listings))
    n = listings.count()
    total = F.sum("n").alias("total")
    known = stated.groupBy("phrase").agg(total, F.max(F.when(F.col("label") != "", F.struct("n", "label"))).alias("most")).where(F.col("most").isNotNull() & (F.col("total") >= LEAST_LISTINGS)).select("phrase", F.col("most.label").alias("dominant"))
    behind = stated.where("label <> ''")
    pairs = behind.join(known, "phrase").groupBy("label", "dominant").agg(total)
    label_place = pairs.groupBy("label").agg(F.max_by("dominant", F.struct("total", "dominant")).alias("place"))
    by_place = behind.join(label_place, "label").join(known.select("phrase", F.lit(True).alias("is_known")), "phrase", "left")
    phrase_place = by_place.where("is_known").groupBy("phrase", "place").agg(total).groupBy("phrase").agg(F.max_by("place", F.struct("total", "place")).alias("place"))
    phrase_place = durable(phrase_place)
    closed = by_place.groupBy("place").agg((F.sum(F.when(F.col("is_known"), F.col("n")).otherwise(0)) / F.sum("n")).alias("closed"))
    without = stated.join(phrase_place, "phrase").groupBy("place").agg((F.sum(F.when(F.col("label") == "", F.col("n")).otherwise(0)) / F.sum("n")).alias("bare"), total)
    # a place has a quarter of a statement for each listing at least, so there are only few
    rows = closed.join(without, "place").where((F.col("closed") >= CLOSED) & (F.col("bare") >= BARE) & (F.col("total") >= LEAST_STATED * n)).select("place").collect()
    places = sorted(r.place for r in rows)
    size = phrase_place.where(F.col("phrase") == LENGTHS).select("place").first()
    size_place = size.place if size else ""
    wanted = F.col("place").isin([p for p in places if p != size_place])
    terms = phrase_place.where(wanted & (F.col("phrase") != LENGTHS)).select(F.lit("phrase").alias("kind"), F.col("phrase").alias("term"), "place")
    labels = label_place.where(wanted | (F.col("place") == size_place)).select(F.lit("label").alias("kind"), F.col("label").alias("term"), "place")
    return durable(terms.unionByName(labels)), [p for p in places if p != size_place], size_place


def own_terms(listings: DataFrame, terms: DataFrame) -> DataFrame:
    """raw, known: the terms of the vocabulary that a listing may hold (a join, for vocabularies too large to be sent)."""
    longest = terms.where("kind = 'phrase'").agg(F.max(F.length("term"))).first()[0] or 0

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for raw, series, description, entries in zip(pdf["raw"], pdf["series"], pdf["description"], pdf["entries"]):
                pairs = [(e["key"], e["value"]) for e in entries] if entries is not None else []
                found = {("label", plain(k)) for k, _ in pairs} | {("label", plain(m[1])) for f in re.split("[,;|]", description or "") if (m := LABELLED.match(f))}
                for text in (series, description, *(v for _, v in pairs)):
                    words = tokens(text or "")
                    for i in range(len(words)):
                        run = ""
                        for word in words[i:]:
                            run += word
                            if len(run) > longest:
                                break
                            found.add(("phrase", run))
                rows += [(raw, kind, term) for kind, term in sorted(found)]
            yield pd.DataFrame(rows, columns=["raw", "kind", "term"])

    held = listings.select("raw", "series", "description", F.map_entries("attributes").alias("entries")).mapInPandas(read, "raw string, kind string, term string")
    return held.join(terms, ["kind", "term"]).groupBy("raw").agg(F.collect_list(F.struct("kind", "term", "place")).alias("known"))


def contracted(counts: dict[tuple[str, str, str], int]) -> dict[tuple[str, str], str]:
    """(place, wording) -> cluster by the rounds of ``same_wordings``, for evidence that is held in memory."""
    of = {(place, w): w for place, p, q in counts for w in (p, q)}
    while True:
        scores: dict[tuple[str, str], tuple[float, str, str]] = {}
        for (place, p, q), n in counts.items():
            alike = n / 2 / math.sqrt((counts.get((place, p, p), 0) + 1) * (counts.get((place, q, q), 0) + 1))
            if p != q and alike >= ALIKE:
                for w in (p, q):
                    scores[place, w] = max(scores.get((place, w), (0.0, "", "")), (alike, p, q))
        gone = {(place, q): p for (place, w), (_, p, q) in scores.items() if w == p and scores.get((place, q), ("", "", ""))[1:] == (p, q)}
        if not gone:
            return of
        of = {(place, w): gone.get((place, c), c) for (place, w), c in of.items()}
        merged: Counter = Counter()
        for (place, p, q), n in counts.items():
            a, b = gone.get((place, p), p), gone.get((place, q), q)
            merged[place, min(a, b), max(a, b)] += n
        counts = merged


def same_wordings(evidence: DataFrame, most: int = MOST_SENT) -> DataFrame:
    """place, wording, cluster: wordings that mean the same, by correlation clustering.

    evidence: place, p, q (p <= q), n: how many neighbours with equal series and size state p and q.  Two wordings are
    alike by how often they face each other against how often they face themselves.  Edges are contracted greedily:
    in each round the pairs that are each other's most alike become one, and the evidence of their members is summed, so
    that a rare wording, whose own counts are chance, is judged by those of its like; it ends when no two are ``ALIKE``.
    The counts of pairs of wordings are contracted in memory up to ``most``, beyond that by joins, with the same result.
    """
    current = durable(evidence.groupBy("place", "p", "q").agg(F.sum("n").alias("n")))
    few = current.limit(most + 1).collect()
    if len(few) <= most:
        of = contracted({(r.place, r.p, r.q): r.n for r in few})
        return evidence.sparkSession.createDataFrame([(*k, c) for k, c in of.items()], "place string, wording string, cluster string")
    members = durable(current.select("place", F.explode(F.array("p", "q")).alias("wording")).distinct().withColumn("cluster", F.col("wording")))
    while True:
        own = current.where("p = q").select("place", F.col("p").alias("w"), F.col("n").alias("own"))
        met = current.where("p <> q")
        scored = met.join(own.select("place", F.col("w").alias("p"), F.col("own").alias("own_p")), ["place", "p"], "left").join(own.select("place", F.col("w").alias("q"), F.col("own").alias("own_q")), ["place", "q"], "left")
        # one more meeting of each with itself: small counts are no proof
        alike = F.col("n") / 2 / F.sqrt((F.coalesce("own_p", F.lit(0)) + 1) * (F.coalesce("own_q", F.lit(0)) + 1))
        scored = durable(scored.select("place", "p", "q", F.struct(alike.alias("alike"), F.least("p", "q").alias("x"), F.greatest("p", "q").alias("y")).alias("rank")).where(F.col("rank.alike") >= ALIKE))
        best = scored.select("place", F.explode(F.array("p", "q")).alias("w"), "rank").groupBy("place", "w").agg(F.max("rank").alias("rank"))
        pairs = best.groupBy("place", "rank").count().where("count = 2").select("place", F.col("rank.x").alias("cluster"), F.col("rank.y").alias("gone"))
        pairs = durable(pairs)
        if pairs.isEmpty():
            return members.select("place", "wording", "cluster")

        def renamed(table: DataFrame, column: str) -> DataFrame:
            to = pairs.select("place", F.col("gone").alias(column), F.col("cluster").alias("to"))
            return table.join(to, ["place", column], "left").withColumn(column, F.coalesce("to", column)).drop("to")

        members = durable(renamed(members, "cluster"))
        merged = renamed(renamed(current, "p"), "q")
        current = durable(merged.groupBy("place", F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q")).agg(F.sum("n").alias("n")))

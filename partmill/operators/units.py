"""Quantities recorded in different units, converted to one unit per kind.

A *source* is a spelling of a unit.  Entities are linked across sources in two ways: statements given twice
(``1/4 in (6.35 mm)``) are one entity in two sources, and a *context*, the attribute or the word before the number
(pressure, weight), measures one population, whose quantiles are entities that every source of the context states.
:func:`source_conversions` and :func:`population_conversions` estimate a robust scale and offset for each pair of
sources, snap them to known conversions and propagate them through the graph of sources.  The anchors of the graph are
one symbol for each unit; a spelling that too few values link takes its conversion from the list of known spellings.
:func:`stated_quantities` then reads every number with its unit out of text.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from fractions import Fraction

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partmill.functions.quantities import FIELDS, FRACTION_SIGNS, QUALIFIERS, SYMBOLS, Reader, known_units
from partmill.functions.text import blank, letters_digits
from partmill.operators.wide import attribute_columns
from partmill.session import durable

OUT = "row_id long, kind string, base_value long"
#: A scale within this part of a known one is snapped to it.
TOLERANCE = 0.004
#: Values of a context that a spelling must have to be compared with others by its quantiles, and these.
LEAST_VALUES, QUANTILES = 50, [0.1, 0.25, 0.5, 0.75, 0.9]
#: Mean distance of the quantiles (as logarithms, or parts of the interquartile range) that a link may have, and what a
#: spelling of n values may have besides, as a multiple of 1/sqrt(n); the next conversion must be this much farther.
NEAR, CHANCE, CLEAR = 0.06, 0.8, 2.0


def linked_pairs(measures: DataFrame, least: int = 3) -> DataFrame:
    """source_a, source_b, n, scale, offset, spread of every pair of sources with at least ``least`` common entities.

    measures: entity, source, value.  The values of an entity in one source are reduced to their median first, so an
    entity in s sources gives s(s-1)/2 pairs.  The scale is the ratio of the interquartile ranges, which does not depend
    on an offset; the offset is the rest at the median; where b is proportional to a, the median of the ratios is used.
    ``spread`` is the median deviation from the fit as a part of the median value.
    """
    one = durable(measures.where("value is not null").groupBy("entity", "source").agg(F.percentile_approx("value", 0.5).alias("value")))
    a, b = one.select("entity", F.col("source").alias("source_a"), F.col("value").alias("a")), one.select("entity", F.col("source").alias("source_b"), F.col("value").alias("b"))
    pairs = a.join(b, "entity").where("source_a < source_b")
    ratio = F.when(F.col("a") != 0, F.col("b") / F.col("a"))
    stats = pairs.groupBy("source_a", "source_b").agg(
        F.count("*").alias("n"),
        F.percentile_approx("a", [0.25, 0.5, 0.75]).alias("qa"),
        F.percentile_approx("b", [0.25, 0.5, 0.75]).alias("qb"),
        F.percentile_approx(ratio, [0.25, 0.5, 0.75]).alias("qr"),
    )
    proportional = (F.col("qr")[2] - F.col("qr")[0]) <= F.abs(F.col("qr")[1]) * 0.02
    slope = F.when(F.col("qa")[2] != F.col("qa")[0], (F.col("qb")[2] - F.col("qb")[0]) / (F.col("qa")[2] - F.col("qa")[0]))
    fit = stats.where(F.col("n") >= least).select("source_a", "source_b", "n", F.when(proportional, F.col("qr")[1]).otherwise(slope).alias("scale"), proportional.alias("p"), "qa", "qb")
    fit = fit.withColumn("offset", F.when(F.col("p"), F.lit(0.0)).otherwise(F.col("qb")[1] - F.col("scale") * F.col("qa")[1])).select("source_a", "source_b", "n", "scale", "offset")
    off = F.abs(F.col("b") - F.col("scale") * F.col("a") - F.col("offset")) / F.greatest(F.abs(F.col("b")), F.lit(1e-9))
    spread = pairs.join(fit, ["source_a", "source_b"]).groupBy("source_a", "source_b").agg(F.percentile_approx(off, 0.5).alias("spread"))
    return fit.join(spread, ["source_a", "source_b"])


def source_conversions(measures: DataFrame, anchors: dict[str, tuple[str, Fraction, Fraction]], least: int = 3) -> dict[str, tuple[str, Fraction, Fraction]]:
    """Source -> kind, scale, offset to the common unit, for the sources linked with an anchor, directly or through others.

    ``anchors`` are the known sources and, by their distinct conversions, what estimates are snapped to; a pair whose
    estimate is near no known conversion, or whose fit is loose, is no link.  The pairs stay a table; in each round the
    driver gets the sources that are linked with those known so far, one row for each.
    """
    edges = linked_pairs(measures, least).where((F.col("spread") < 0.02) & (F.col("scale") != 0))
    back = edges.select(F.col("source_b").alias("source_a"), F.col("source_a").alias("source_b"), "n", (1 / F.col("scale")).alias("scale"), (-F.col("offset") / F.col("scale")).alias("offset"))
    both = durable(edges.select("source_a", "source_b", "n", "scale", "offset").unionByName(back))
    known, out = sorted(set(anchors.values())), dict(anchors)
    new = dict(anchors)
    while new:
        have = both.sparkSession.createDataFrame([(s,) for s in sorted(out)], "source string")
        left = both.join(have.select(F.col("source").alias("source_b")), "source_b", "left_anti")
        fresh = both.sparkSession.createDataFrame([(s,) for s in sorted(new)], "source_a string")
        best = left.join(fresh, "source_a").groupBy("source_b").agg(F.max_by(F.struct("source_a", "scale", "offset"), F.struct("n", "source_a")).alias("e"))
        new = {}
        for r in best.select("source_b", "e.*").collect():  # b = scale * a + offset
            kind, to_scale, to_offset = out[r.source_a]
            want_scale, want_offset = float(to_scale) / r.scale, float(to_offset) - float(to_scale) * r.offset / r.scale
            near = [k for k in known if k[0] == kind and abs(float(k[1]) / want_scale - 1) < TOLERANCE and abs(float(k[2]) - want_offset) <= abs(float(k[1])) * 0.6]
            if near:
                new[r.source_b] = min(near, key=lambda k: abs(float(k[1]) / want_scale - 1))
        out |= new
    return out


DUAL = re.compile(r"(?P<a>[\d.,/\-½¼¾⅛⅜⅝⅞ ]*[\d½¼¾⅛⅜⅝⅞])\s*(?P<ua>[^\d()\s,;:=|][^\d(),;:=|]{0,24}?)\s*\(\s*(?P<b>[\d.,]*\d)\s*(?P<ub>[^\d()\s][^\d()]{0,24}?)\s*\)")


def double_statements(texts: DataFrame) -> DataFrame:
    """entity, source, value: the two numbers of each statement given twice, by the spelling of their unit."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader()

        def number(text: str) -> float | None:
            items = reader.items(text.strip() + " ")
            return float(items[0]["value"]) if len(items) == 1 else None

        for pdf in batches:
            rows = []
            for key, text in zip(pdf["entity"], pdf["text"]):
                for i, m in enumerate(DUAL.finditer(text)):
                    a, b = number(m["a"]), number(m["b"])
                    if a is not None and b is not None:
                        entity = f"{key}/{i}"
                        rows += [(entity, re.sub(r"\s+", " ", m["ua"].lower()), a), (entity, re.sub(r"\s+", " ", m["ub"].lower()), b)]
            yield pd.DataFrame(rows, columns=["entity", "source", "value"])

    return texts.where(F.col("text").contains("(")).mapInPandas(read, "entity string, source string, value double")


#: Qualifiers, but not the minute of a flow.
WITHOUT = re.compile(rf"(?<!/)(?<!/ )(?<!per ){QUALIFIERS.pattern}", re.I)
VALUE = re.compile(rf"^[^\d{FRACTION_SIGNS}]*?(?P<c>[^\W\d_]*)[\W_]*?(?P<v>[-−–]?(?:\d|[.{FRACTION_SIGNS}])(?:[\d.,/\-{FRACTION_SIGNS} ]*[\d{FRACTION_SIGNS}])?)\s*(?P<u>[^\d\s,;|()][^,;|()]{{0,39}})$")


def context_values(texts: DataFrame) -> DataFrame:
    """context, source, value: the numbers of fields that hold one number and a text behind it, by that text.

    texts: text, context (the attribute of a cell; null for free text, where it is the word before the number).
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader()
        for pdf in batches:
            rows = []
            for text, context in zip(pdf["text"], pdf["context"]):
                for field in FIELDS.split(text):
                    m = VALUE.match(WITHOUT.sub(" ", field).strip())
                    name = context or (m["c"].lower() if m else "")
                    items = reader.items(m["v"] + " ") if m and name else []
                    if len(items) == 1 and not items[0]["unit"] and not re.search(r"^\W*\d|\s\d|\d\s", m["u"]):
                        rows.append((name, re.sub(r"\s+", " ", m["u"].strip(" :").lower()), float(items[0]["value"])))
            yield pd.DataFrame(rows, columns=["context", "source", "value"])

    return texts.where(F.col("text").rlike(rf"[0-9{FRACTION_SIGNS}]")).select("text", "context").mapInPandas(read, "context string, source string, value double")


def distance(conversion: tuple[str, Fraction, Fraction], values: list[float], base: list[float]) -> float:
    """How far the quantiles of some values in a unit are from those of a population in the common unit."""
    there = [v * float(conversion[1]) + float(conversion[2]) for v in values]
    if conversion[0] == "temperature":
        return sum(abs(a - b) for a, b in zip(there, base)) / len(base) / max(1e-9, abs(base[-2] - base[1]))
    return sum(abs(math.log(max(a, 1e-9) / max(b, 1e-9))) for a, b in zip(there, base)) / len(base)


def population_conversions(values: DataFrame, anchors: dict[str, tuple[str, Fraction, Fraction]], conversions: list[tuple[str, Fraction, Fraction]]) -> dict[str, tuple[str, Fraction, Fraction]]:
    """Source -> kind, scale, offset, for the sources that state the same population as an anchor, directly or through
    others.

    values: context, source, value.  The quantiles of a source are compared with those of the most frequent known source
    of each conversion in its contexts (so the pairs grow with the sources, not with their square), through each of
    ``conversions``: the nearest is the snapped scale and offset of the pair.  A pair is a link if it is near and no other
    conversion is nearly as near; links of a source vote for its conversion with their number of values over the squared
    distance (two units whose values are of one size are near by chance, but not as near as two spellings of one unit), and
    two thirds of the votes must agree.  Sources linked in one round are known
    in the next.  The driver gets one row for each linked source.
    """
    spark = values.sparkSession
    of = durable(values.groupBy("context", "source").agg(F.count("*").alias("n"), F.percentile_approx("value", QUANTILES, 1000).alias("q")).where(F.col("n") >= LEAST_VALUES))
    schema = "source string, kind string, scale string, offset string, weight double"

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for source, n, q, kind, scale, offset, n_a, q_a in zip(*(pdf[c] for c in ("source", "n", "q", "kind", "scale", "offset", "n_a", "q_a"))):
                base = [v * float(Fraction(scale)) + float(Fraction(offset)) for v in q_a]
                found = sorted((distance(c, list(q), base), c) for c in conversions if c[0] == kind)
                allowed = NEAR + CHANCE / math.sqrt(min(n, n_a))
                if found and found[0][0] <= allowed and (len(found) < 2 or found[1][0] >= CLEAR * found[0][0]):
                    rows.append((source, kind, str(found[0][1][1]), str(found[0][1][2]), min(n, n_a) / (found[0][0] ** 2 + 1 / min(n, n_a))))
            yield pd.DataFrame(rows, columns=["source", "kind", "scale", "offset", "weight"])

    out = dict(anchors)
    while True:
        known = spark.createDataFrame([(s, k, str(a), str(b)) for s, (k, a, b) in sorted(out.items())], "source string, kind string, scale string, offset string")
        have = of.join(known, "source").groupBy("context", "kind", "scale", "offset").agg(F.max_by(F.struct("n", "q"), F.struct("n", "source")).alias("a")).select("context", "kind", "scale", "offset", F.col("a.n").alias("n_a"), F.col("a.q").alias("q_a"))
        pairs = of.join(known.select("source"), "source", "left_anti").join(have, "context")
        votes = pairs.mapInPandas(compare, schema).groupBy("source", "kind", "scale", "offset").agg(F.sum("weight").alias("weight"))
        linked = votes.groupBy("source").agg(F.max(F.struct("weight", "kind", "scale", "offset")).alias("b"), F.sum("weight").alias("all")).where("b.weight * 1.5 >= all").select("source", "b.*").collect()
        if not linked:
            return out
        out |= {r.source: (r.kind, Fraction(r.scale), Fraction(r.offset)) for r in linked}


def learned_units(texts: DataFrame, listed: dict[str, tuple[str, Fraction, Fraction]] | None = None, symbols: list[str] = SYMBOLS) -> dict[str, tuple[str, Fraction, Fraction]]:
    """Spelling -> kind, scale, offset: the symbols, the spellings that the graph of sources links with them, and those of
    the list that it doesn't reach.

    texts: entity, text, context.  Fewer than ``LEAST_VALUES`` values of a spelling in each context link nothing.
    """
    listed = known_units() if listed is None else listed
    anchors = {s: listed[s] for s in symbols if s in listed}
    conversions = sorted(set(known_units().values()))
    graph = population_conversions(context_values(texts), anchors, conversions)
    graph = source_conversions(double_statements(texts), graph)
    return {**listed, **graph}


def stated_quantities(rows: DataFrame, units: dict | None = None) -> DataFrame:
    """row_id, kind, base_value: one row for each distinct value that a row states.

    rows: row_id, text, and ``hint``: a text that gives the unit of bare numbers, with ``whole`` true if the text is
    such a number itself (a cell) and false if only numbers given as dimensions take the unit.
    Null or empty texts, texts without a unit, angles, threads, classes, counts and torques give no rows.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader(units)
        for pdf in batches:
            out = []
            for row_id, text, hint, whole in zip(pdf["row_id"], pdf["text"], pdf["hint"], pdf["whole"]):
                given = (reader.unit_of(hint) if whole else reader.series_unit(hint)) if hint else None
                out += [(row_id, kind, value) for kind, value in reader.read(text, given, bool(whole))]
            yield pd.DataFrame(out, columns=["row_id", "kind", "base_value"])

    wanted = rows.where(F.col("text").rlike(rf"[0-9{FRACTION_SIGNS}]")).select("row_id", "text", blank(F.col("hint")).alias("hint"), "whole")
    return wanted.mapInPandas(read, OUT)


def raw_quantities(raw: DataFrame, units: dict | None = None) -> DataFrame:
    """src, row_id, kind, base_value of ``raw_parts``; the series text may name the unit of the dimensions."""
    rows = raw.select(F.col("raw_id").alias("row_id"), F.col("description").alias("text"), F.col("series").alias("hint"), F.lit(False).alias("whole"))
    return stated_quantities(rows, units).select(F.lit("raw").alias("src"), "row_id", "kind", "base_value")


def quantity_labels(defs: DataFrame) -> DataFrame:
    """label_key, context: the labels of the attributes of type quantity in letters and digits."""
    return defs.where("value_type = 'quantity'").select(F.col("attr_code").alias("context"), F.explode(F.concat(F.array("display_label"), F.coalesce("other_labels", F.array().cast("array<string>")))).alias("label")).select(letters_digits(F.col("label")).alias("label_key"), "context").dropDuplicates(["label_key"])


def measured_texts(raw: DataFrame, details: DataFrame, defs: DataFrame) -> DataFrame:
    """entity, text, context of both tables, for :func:`learned_units`."""
    cells = details.select(F.concat(F.lit("d"), F.col("row_id").cast("string")).alias("entity"), F.col("value_display").alias("text"), letters_digits(F.col("label")).alias("label_key"))
    cells = cells.join(quantity_labels(defs), "label_key").select("entity", "text", "context")
    return raw.select(F.concat(F.lit("r"), F.col("raw_id").cast("string")).alias("entity"), F.col("description").alias("text"), F.lit(None).cast("string").alias("context")).unionByName(cells)


def detail_quantities(details: DataFrame, defs: DataFrame, units: dict | None = None) -> DataFrame:
    """src, row_id, kind, base_value of the rows of ``product_details`` whose label belongs to an attribute of type quantity."""
    normal = lambda s: "".join(c for c in s.upper().lower() if c.isalnum())
    columns = attribute_columns(defs)
    wanted = {normal(label) for c in columns if c["value_type"] == "quantity" for label in c["labels"]}
    others = {normal(label) for c in columns if c["value_type"] != "quantity" for label in c["labels"]}

    def split(labels: pd.Series) -> pd.DataFrame:
        reader, out = Reader(units), {}
        for label in labels.dropna().unique():
            base, hint = (label, "") if normal(label) in wanted else ("", "")
            if not base and normal(label) not in others:
                for pattern in reader.labels:
                    m = pattern.match(label)
                    if m and reader.unit_of(m["u"]) and normal(m["base"]) in wanted:
                        base, hint = label, m["u"]
                        break
            out[label] = (bool(base), hint)
        return pd.DataFrame([out.get(x, (False, "")) for x in labels], columns=["is_quantity", "hint"])

    label = F.pandas_udf(split, "is_quantity boolean, hint string")
    rows = (
        details.where(F.col("value_display").rlike(rf"[0-9{FRACTION_SIGNS}]"))
        .select("row_id", F.col("value_display").alias("text"), label("label").alias("l"))
        .where("l.is_quantity")
        .select("row_id", "text", F.col("l.hint").alias("hint"), F.lit(True).alias("whole"))
    )
    return stated_quantities(rows, units).select(F.lit("detail").alias("src"), "row_id", "kind", "base_value")

"""Product listings that describe the same item.

Method: multi-pass sorted neighbourhood with several normalised token orders, soft token alignment of the neighbours in
a sliding window, and correlation clustering of the links.

Listings are brought to normalised tokens: series word and number, size, and one wording for each worded place (kind,
material, connection) by a vocabulary that the listings teach (``wordings``); copies and listings with equal tokens are
one node, so a product that holds a third of all rows is a few rows in the sorts.  A first pass sorts the nodes by series
and size; windows of neighbours give the evidence which wordings mean the same, and the wordings are clustered.  Nodes
with their wordings replaced by clusters are sorted once for each place, each time with another place last; neighbours
that agree but for one place are compared by soft alignment: words one slip apart, glued words, a wording that one of
them has only among its other words, or, where neither has a known wording, the other words themselves, weighed by their
rarity.  Blocks that agree in all places but one and hold more nodes than a window are joined on these places too, so
that none of their links depends on the sort.  The links are clustered by pivots.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from partmill.llm import copies, wordings
from partmill.llm.clusters import correlation_clusters
from partmill.llm.facets import Facets
from partmill.llm.slips import deletions, within
from partmill.session import durable

#: Neighbours that each node is compared with in each pass.
WINDOW = 16
#: Rows of a sorted block that one call compares; its last ``WINDOW`` rows are repeated in the next block.
BLOCK = 4096
#: Worded places a listing must state, beside series and size, to be complete.
WORDED = 3
#: Part of the weight of two listings' other words that must align where neither has a known wording.
ALIGNED = 0.7
#: Listings with a word, as a part of all, beyond which the word tells nothing.
COMMON = 0.005
FIRST = ("series", "size")


def distinct_listings(records: DataFrame) -> DataFrame:
    """raw, canonical (digests) and the compared columns of each distinct raw listing (partial aggregates, hot copies first)."""
    cols = copies.RECORD_COLUMNS
    hashed = records.select(F.sha2(copies.record_key(), 256).alias("raw"), *cols)
    return hashed.groupBy("raw").agg(*[F.any_value(c).alias(c) for c in cols]).withColumn("canonical", F.sha2(copies.record_text(), 256))


def read_places(listings: DataFrame, terms: DataFrame, places: list[str], size_place: str, most: int = wordings.MOST_SENT) -> DataFrame:
    """raw, canonical, series, size, w0, w1, ... (the wordings of ``places``) and rest (the other words)."""
    sent = terms.limit(most + 1).collect()
    few = len(sent) <= most
    shared = ({t.term: t.place for t in sent if t.kind == "phrase"}, {t.term: t.place for t in sent if t.kind == "label"}) if few else ({}, {})
    columns = ["raw", "canonical", *FIRST, *(f"w{i}" for i in range(len(places))), "rest"]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        facets = Facets(*shared, size_place)
        for pdf in batches:
            out = []
            for raw, canonical, series, description, entries, known in zip(*(pdf[c] for c in ("raw", "canonical", "series", "description", "entries", "known"))):
                if not few:
                    own = known if known is not None else ()
                    facets = Facets(*({t["term"]: t["place"] for t in own if t["kind"] == k} for k in ("phrase", "label")), size_place)
                found, rest = facets.read(series, description, {e["key"]: e["value"] for e in entries} if entries is not None else {})
                out.append((raw, canonical, *(found.get(p, "") for p in (*FIRST, *places)), " ".join(sorted(set(rest)))))
            yield pd.DataFrame(out, columns=columns)

    wanted = listings.select("raw", "canonical", "series", "description", F.map_entries("attributes").alias("entries"))
    if few:
        wanted = wanted.withColumn("known", F.lit(None).cast("array<struct<kind:string,term:string,place:string>>"))
    else:
        wanted = wanted.join(wordings.own_terms(listings, terms), "raw", "left")
    return wanted.mapInPandas(read, ", ".join(f"{c} string" for c in columns))


def nodes(read: DataFrame, places: list[str]) -> DataFrame:
    """canonical -> places, rest, complete.  Copies share the reading of the best readable one."""
    filled = sum(((F.col(p) != "").cast("int") for p in places), F.lit(0))
    # of readings that are equally full the most frequent counts, then the one with the smaller size: a copy may have lost
    # its decimal point, not gained one
    small = -F.coalesce(F.col("size").try_cast("bigint"), F.lit(0))
    readings = read.groupBy("canonical", *places).agg(F.count("*").alias("n"), F.min("rest").alias("rest"))
    best = readings.groupBy("canonical").agg(F.max(F.struct(filled.alias("filled"), "n", small.alias("small"), *places, "rest")).alias("best")).select("canonical", "best.*")
    complete = (F.col("filled") == len(places)) & F.lit(len(places) >= len(FIRST) + WORDED)
    return best.select("canonical", *places, "rest", complete.alias("complete"))


def blocks(table: DataFrame, order: list[str], width: int, rows: int) -> DataFrame:
    """The rows of ``table`` sorted by ``order`` with their number ``at``, in blocks of ``rows`` rows; the last ``width``
    rows of each block stand in the next one too, so that every two rows within ``width`` share a block.

    Rows are range partitioned and sorted; a row's number is its place in its partition and the number of rows in the
    partitions before, of which there is one row for each partition.
    """
    sort = [F.col(c) for c in order]
    marked = durable(table.repartitionByRange(*sort).sortWithinPartitions(*sort).withColumn("mark", F.monotonically_increasing_id()))
    part = F.shiftright("mark", 33)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = marked.groupBy(part.alias("part")).count().select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    at = F.col("offset") + F.col("mark").bitwiseAND(F.lit((1 << 33) - 1))
    placed = marked.withColumn("part", part).join(offsets, "part").withColumn("at", at).drop("part", "mark", "offset")
    block = F.floor(F.col("at") / rows)
    own = F.array(block)
    return placed.withColumn("block", F.explode(F.when(F.col("at") % rows >= rows - width, F.array(block, block + 1)).otherwise(own)))


def slide(table: DataFrame, order: list[str], compare: Callable[[pd.DataFrame, np.ndarray, np.ndarray], pd.DataFrame], schema: str, width: int, rows: int = BLOCK) -> DataFrame:
    """What ``compare`` (frame, positions, positions of later neighbours) gives for all neighbours within ``width``."""
    rows = max(rows, 2 * width)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at", kind="stable").reset_index(drop=True)
        at, block = pdf["at"].to_numpy(), int(pdf["block"].iloc[0])
        i = np.concatenate([np.arange(max(0, len(pdf) - step)) for step in range(1, width + 1)])
        j = np.concatenate([np.arange(step, max(step, len(pdf))) for step in range(1, width + 1)])
        own = at[j] >= block * rows  # the rows repeated from the block before met each other there
        return compare(pdf, i[own], j[own])

    return blocks(table, order, width, rows).groupBy("block").applyInPandas(run, schema)


def wording_evidence(table: DataFrame, places: list[str], clusters: DataFrame | None = None, width: int = WINDOW) -> DataFrame:
    """place, p, q, n: how often neighbours with equal series and size state the wordings p and q (p <= q); with
    ``clusters`` (place, wording, cluster), only neighbours whose other wordings are of the same clusters."""
    worded = places[len(FIRST) :]
    tuples = table.where("series <> '' and size <> ''").select(*places).distinct()
    if clusters is None:
        tuples = tuples.withColumns({f"of_{p}": F.lit("") for p in worded})
    else:
        tuples = with_clusters(tuples.withColumns({f"raw_{p}": F.col(p) for p in worded}), places, clusters)
        tuples = tuples.select(*FIRST, *[F.col(f"raw_{p}").alias(p) for p in worded], *[F.col(p).alias(f"of_{p}") for p in worded])

    def compare(pdf: pd.DataFrame, i: np.ndarray, j: np.ndarray) -> pd.DataFrame:
        series, size = pdf["series"].to_numpy(), pdf["size"].to_numpy()
        near = (series[i] == series[j]) & (size[i] == size[j])
        i, j = i[near], j[near]
        of = {p: pdf[f"of_{p}"].to_numpy() for p in worded}
        apart = sum((of[p][i] != of[p][j]).astype(int) for p in worded) if worded else 0
        out = []
        for place in worded:
            words, others = pdf[place].to_numpy(), apart - (of[place][i] != of[place][j]) == 0
            met = Counter((min(a, b), max(a, b)) for a, b in zip(words[i][others], words[j][others]) if a and b)
            out += [(place, p, q, n) for (p, q), n in met.items()]
        return pd.DataFrame(out, columns=["place", "p", "q", "n"])

    return slide(tuples, [*FIRST, *(f"of_{p}" for p in worded), *worded], compare, "place string, p string, q string, n long", width)


def learned_wordings(table: DataFrame, places: list[str], width: int = WINDOW) -> DataFrame:
    """place, wording, cluster, learned in two passes: from all neighbours, then from those that agree in all other
    places by what the first pass learned."""
    first = wordings.same_wordings(wording_evidence(table, places, None, width))
    return wordings.same_wordings(wording_evidence(table, places, first, width))


def with_clusters(table: DataFrame, places: list[str], clusters: DataFrame) -> DataFrame:
    """``table`` with each wording replaced by its cluster."""
    for place in places[len(FIRST) :]:
        of = clusters.where(F.col("place") == place).select(F.col("wording").alias(place), F.col("cluster").alias("to"))
        table = table.join(of, place, "left").withColumn(place, F.coalesce("to", place)).drop("to")
    return table


def rare_words(table: DataFrame, total: int) -> DataFrame:
    """``table`` with ``rest`` reduced to its rare words and ``weights``, their inverse document frequency, in that order;
    complete nodes keep none."""
    words = table.select("canonical", F.explode(F.split("rest", " ")).alias("word")).where("word <> ''")
    known = words.groupBy("word").agg(F.count("*").alias("df")).where(F.col("df") <= max(20, COMMON * total))
    weight = F.round(F.log(F.lit(total + 1.0) / F.col("df")) + 1, 4)
    wanted = words.join(table.where("not complete").select("canonical"), "canonical", "left_semi")
    own = wanted.join(known.select("word", weight.alias("weight")), "word").groupBy("canonical").agg(F.array_sort(F.collect_list(F.struct("word", "weight"))).alias("w"))
    joined = table.drop("rest").join(own, "canonical", "left")
    none = F.array()
    return joined.withColumn("rest", F.array_join(F.coalesce("w.word", none.cast("array<string>")), " ")).withColumn("weights", F.coalesce("w.weight", none.cast("array<double>"))).drop("w")


def held(text: str, rest: str) -> bool:
    """Whether other words hold a wording in one run of letters, or with one slip in a word of more than four letters."""
    return text in rest.replace(" ", "") or any(len(text) > 4 and within(text, o, 1) for o in rest.split())


def slipped(x: str, y: str, place: str) -> bool:
    """Whether two values of a place may be one with a slip; numbers must agree."""
    if place == "size" or not x or not y:
        return False
    if [c for c in x if c.isdigit()] != [c for c in y if c.isdigit()]:
        return False
    a, b = ("".join(c for c in t if c.isalpha()) for t in (x, y))
    return min(len(a), len(b)) >= 6 and within(a, b, 1)


def overlap(a: str, wa: list[float], b: str, wb: list[float]) -> float:
    """The part of two word lists' weight that aligns: equal words, or longer ones one slip apart."""
    left, right = dict(zip(a.split(), wa)), dict(zip(b.split(), wb))
    total = sum(left.values()) + sum(right.values())
    shared = 0.0
    for x, w in left.items():
        y = x if x in right else next((y for y in right if min(len(x), len(y)) > 4 and x.isalpha() and within(x, y, 1)), None)
        if y is not None:
            shared += w + right.pop(y)
    return shared / total if total else 0.0


def aligned(a: dict, b: dict, places: list[str]) -> bool:
    """Whether two nodes align: every place agrees or differs by one slip, or is missing in one whose other words hold it,
    or is missing in both and their rare other words align."""
    unread = False
    for place in places:
        x, y = a[place], b[place]
        if x == y and x:
            continue
        if x and y:
            if not slipped(x, y, place):
                return False
        elif x or y:
            if not held(x or y, b["rest"] if x else a["rest"]):
                return False
        else:
            unread = True
    if unread or len(places) < len(FIRST) + WORDED:
        return overlap(a["rest"], a["weights"], b["rest"], b["weights"]) >= ALIGNED
    return True


def neighbour_links(table: DataFrame, order: list[str], places: list[str], width: int = WINDOW) -> DataFrame:
    """a, b: links found by one pass over the nodes sorted by ``order``."""

    def compare(pdf: pd.DataFrame, i: np.ndarray, j: np.ndarray) -> pd.DataFrame:
        values = np.stack([pdf[p].to_numpy() for p in places])
        codes, blank = np.stack([pd.factorize(v)[0] for v in values]), values == ""
        same, missing = codes[:, i] == codes[:, j], blank[:, i] | blank[:, j]
        # all places agree but for one that differs or is missing in one; those missing in both are left to the other words
        apart = (~same).sum(axis=0)
        likely = np.flatnonzero((apart <= 1) & ((apart == 1) | missing.any(axis=0) | (len(places) < len(FIRST) + WORDED)))
        rows = pdf[["node", *places, "rest", "weights"]].to_dict("records")
        found = {(rows[i[k]]["node"], rows[j[k]]["node"]) for k in likely if aligned(rows[i[k]], rows[j[k]], places)}
        return pd.DataFrame(sorted((min(p), max(p)) for p in found if p[0] != p[1]), columns=["a", "b"])

    return slide(table, [*order, "node"], compare, "a string, b string", width)


def block_links(table: DataFrame, places: list[str], width: int = WINDOW) -> DataFrame:
    """a, b: all links within blocks of more nodes than a window holds, by equi-joins on the places that agree."""

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = pdf.to_dict("records")
            found = {tuple(sorted((r["a"]["node"], r["b"]["node"]))) for r in rows if aligned(r["a"], r["b"], places)}
            yield pd.DataFrame(sorted(found), columns=["a", "b"])

    def spread(place: str):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                rows = [(node, form) for node, text in zip(pdf["node"], pdf[place]) for form in deletions("".join(c for c in text if c.isalpha()), 1)]
                yield pd.DataFrame(rows, columns=["node", "form"])

        return run

    row = F.struct("node", *places, "rest", "weights").alias("row")
    counts = None
    for place in places:
        others = [p for p in places if p != place]
        one = table.groupBy(*others).agg(F.count("*").alias("n")).where(F.col("n") > width + 1).select(F.lit(place).alias("open"), *[F.col(p) if p != place else F.lit(None).cast("string").alias(p) for p in places])
        counts = one if counts is None else counts.unionByName(one)
    large = durable(counts)
    pairs = table.where("false").select(row.alias("a"), row.alias("b"))
    for place in [r.open for r in large.select("open").distinct().collect()]:
        others = [p for p in places if p != place]
        inside = table.join(large.where(F.col("open") == place).select(*others), others, "left_semi")
        full, lack = inside.where(F.col(place) != ""), inside.where(F.col(place) == "")
        held_pairs = lack.where("rest <> ''").select(*others, row.alias("a")).join(full.select(*others, row.alias("b")), others)
        # wordings too short for a slip must stand in the other words as they are; this spares most pairs the alignment
        held_pairs = held_pairs.where((F.length(F.col(f"b.{place}")) > 4) | F.contains(F.replace(F.col("a.rest"), F.lit(" "), F.lit("")), F.col(f"b.{place}")))
        words = lack.select(*others, row.alias("row"), F.explode(F.split("rest", " ")).alias("word")).where("word <> ''")
        word_pairs = words.withColumnRenamed("row", "a").join(words.withColumnRenamed("row", "b"), [*others, "word"]).where("a.node < b.node")
        pairs = pairs.unionByName(held_pairs.select("a", "b")).unionByName(word_pairs.select("a", "b"))
        if place != "size":
            forms = full.select("node", *others, row.alias("row"), F.regexp_replace(place, "[^0-9]", "").alias("digits"))
            side = forms.join(full.select("node", place).mapInPandas(spread(place), "node string, form string"), "node").select(*others, "digits", "form", "row")
            slips = side.withColumnRenamed("row", "a").join(side.withColumnRenamed("row", "b"), [*others, "digits", "form"]).where("a.node < b.node")
            pairs = pairs.unionByName(slips.select("a", "b"))
    return pairs.mapInPandas(verify, "a string, b string").distinct()


def links(table: DataFrame, places: list[str], width: int = WINDOW) -> DataFrame:
    """a, b: the distinct links of all passes, each with another place last, and of the blocks beyond the window."""
    out = block_links(table, places, width)
    for i in range(len(places)):
        out = out.unionByName(neighbour_links(table, [*places[i:], *places[:i]], places, width))
    return durable(out.distinct())


def read_listings(records: DataFrame) -> tuple[DataFrame, DataFrame, list[str]]:
    """(raw -> canonical; canonical -> places, rest, complete; the places)."""
    listings = durable(distinct_listings(records))
    terms, places, size_place = wordings.vocabulary(listings)
    read = durable(read_places(listings, terms, places, size_place))
    names = [f"w{i}" for i in range(len(places))]
    total = read.count()
    # a place that many listings don't state is no part of the product
    stated = read.agg(*[F.count_if(F.col(c) != "").alias(c) for c in names]).first() if names and total else {}
    return read, nodes(read, [*FIRST, *(c for c in names if total and stated[c] >= wordings.FILLED * total)]), [*FIRST, *(c for c in names if total and stated[c] >= wordings.FILLED * total)]


def listing_groups(records: DataFrame, width: int = WINDOW) -> DataFrame:
    """rec_id, group_id: one row for each listing.

    Null and ``""`` are the same; null maps and values are empty; copies (by ``copies.record_text``) are always in one
    group; a listing that lacks a place is alone unless it is a copy or aligns with another; listings without any text
    are copies of each other.  A table too small to teach its wordings has only places that are read without them, and
    its listings are aligned by all their words.  Repeated ids have repeated rows; further columns don't matter; empty
    gives empty.
    """
    read, of_copy, places = read_listings(records)
    of_copy = durable(of_copy)
    clusters = learned_wordings(of_copy, places, width)
    plain = rare_words(with_clusters(of_copy, places, clusters), max(1, of_copy.count()))
    # listings with the same wordings, and incomplete ones with the same rare words beside them, are one node
    key = F.concat_ws("|", *places)
    lone = ~F.col("complete") & (F.col("rest") == "")
    node = F.when(F.col("complete"), key).when(lone, F.concat(F.lit("?"), F.col("canonical"))).otherwise(F.concat(F.lit("?"), F.sha2(F.concat_ws("|", key, F.col("rest")), 256)))
    plain = durable(plain.withColumn("node", node))
    table = durable(plain.groupBy("node").agg(*[F.any_value(c).alias(c) for c in (*places, "rest", "weights")]))
    found = correlation_clusters(links(table, places, width))
    grouped = plain.select("canonical", "node").join(found, "node", "left").select("canonical", F.coalesce("cluster", "node").alias("group_id"))
    of_raw = read.select("raw", "canonical").join(grouped, "canonical").select("raw", "group_id")
    return records.select(F.sha2(copies.record_key(), 256).alias("raw"), "rec_id").join(of_raw, "raw").select("rec_id", F.sha2("group_id", 256).alias("group_id"))


def group_table(records: DataFrame, width: int = WINDOW) -> DataFrame:
    """rec_id, group_id (the smallest rec_id of the group), links (how many other listings describe the same product)."""
    groups = durable(listing_groups(records, width))
    of = groups.groupBy("group_id").agg(F.min("rec_id").alias("first"), (F.count("*") - 1).alias("links"))
    return groups.join(of, "group_id").select("rec_id", F.col("first").alias("group_id"), "links")


def listing_pairs(records: DataFrame, width: int = WINDOW) -> DataFrame:
    """rec_a, rec_b (rec_a < rec_b): every pair of listings of one group, as the result's columns demand."""
    groups = durable(listing_groups(records, width))
    more = groups.groupBy("group_id").count().where("count > 1").select("group_id")
    left = groups.join(more, "group_id", "left_semi")
    a, b = left.select("group_id", F.col("rec_id").alias("rec_a")), left.select("group_id", F.col("rec_id").alias("rec_b"))
    return a.join(b, "group_id").where("rec_a < rec_b").select("rec_a", "rec_b")

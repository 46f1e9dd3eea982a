"""Free-entered values mapped to a canonical list.

Method: token-level repair.  Distinct runs of words of all entries are joined to the reference vocabulary (numbers, brand
names, series names) by edit distance; the repaired tokens are combined to complete entries of the list, which are
ranked by their slips and then by soft TF-IDF of all words; what is beyond two slips in all is reported as unmatched.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from partmill.functions.text import blank
from partmill.llm.slips import deletions, distance
from partmill.session import durable

MOST_SLIPS = 2
#: Forms of the vocabulary's terms up to which its index is built in every worker (about 400 bytes each); beyond, the join
#: is a shuffle.  And words of the list up to which their weights are sent; beyond, they are joined.
MOST_SENT, MOST_WORDS = 1_000_000, 200_000
WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    return [w.casefold() for w in WORD.findall(text or "")]


def vocabulary(refs: DataFrame) -> DataFrame:
    """term, role of the list: numbers in letters and digits, names of brands and of series in one piece."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = {("".join(words_of(x)), role) for column, role in (("ref_no", "number"), ("brand", "brand"), ("series", "series")) for x in pdf[column]}
            yield pd.DataFrame(sorted(r for r in rows if r[0]), columns=["term", "role"])

    return refs.select("ref_no", "brand", "series").mapInPandas(read, "term string, role string").distinct()


def runs(texts: DataFrame, shortest: int, longest: int) -> DataFrame:
    """raw, run: the distinct runs of words of each text whose length a term can have, in however many pieces."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for raw in pdf["raw"]:
                words, found = words_of(raw), set()
                for i in range(len(words)):
                    run = ""
                    for word in words[i : i + longest]:  # each has a character at least
                        run += word
                        if len(run) > longest:
                            break
                        if len(run) >= shortest:
                            found.add(run)
                rows += [(raw, run) for run in sorted(found)]
            yield pd.DataFrame(rows, columns=["raw", "run"])

    return texts.select("raw").mapInPandas(read, "raw string, run string")


@lru_cache(1)
def term_index(vocab: tuple[tuple[str, str], ...], most: int) -> tuple[dict[str, set[str]], dict[str, list[str]], set[int]]:
    """(form -> terms, term -> roles, lengths of terms); built once in each worker."""
    index, roles = defaultdict(set), defaultdict(list)
    for term, role in vocab:
        roles[term].append(role)
    for term in roles:
        for form in deletions(term, most):
            index[form].add(term)
    return dict(index), dict(roles), {len(t) for t in roles}


def repaired(tokens: DataFrame, terms: DataFrame, most: int = MOST_SLIPS, sent: int = MOST_SENT) -> DataFrame:
    """run, term, role, slips: every term at most ``most`` slips from a run.

    Two words so near share a form with up to ``most`` characters dropped, so the join is an equi-join on these forms
    and loses none.  The index of a vocabulary of at most ``sent`` forms goes to every worker, which looks them up;
    beyond that both sides' forms are exploded and shuffled.
    """
    length = F.length("term")
    forms_of = [F.lit(1), length, length * (length - 1) / 2][: most + 1]
    count = terms.agg(F.sum(sum(forms_of[1:], forms_of[0]))).first()[0] or 0
    if count <= sent:
        vocab = [(t.term, t.role) for t in terms.collect()]

        def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            index, roles, lengths = term_index(tuple(sorted(vocab)), most)
            for pdf in batches:
                rows = []
                for run in pdf["run"]:
                    if not any(len(run) + k in lengths for k in range(-most, most + 1)):
                        continue
                    near = set().union(*(index.get(form, ()) for form in deletions(run, most)))
                    for term in near:
                        slips = distance(run, term, most)
                        if slips <= most:
                            rows += [(run, term, role, slips) for role in roles[term]]
                yield pd.DataFrame(rows, columns=["run", "term", "role", "slips"])

        return tokens.mapInPandas(look, "run string, term string, role string, slips int")

    def forms(column: str):
        def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                rows = [(word, form) for word in pdf[column] for form in deletions(word, most)]
                yield pd.DataFrame(rows, columns=[column, "form"])

        return spread

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            slips = [distance(a, b, most) for a, b in zip(pdf["run"], pdf["term"])]
            yield pdf.assign(slips=slips)[[s <= most for s in slips]]

    left = tokens.mapInPandas(forms("run"), "run string, form string")
    right = terms.select("term").distinct().mapInPandas(forms("term"), "term string, form string")
    near = left.join(right, "form").select("run", "term").distinct().mapInPandas(verify, "run string, term string, slips int")
    return near.join(terms, "term").select("run", "term", "role", "slips")


def complete_entries(found: DataFrame, refs: DataFrame, most: int = MOST_SLIPS) -> DataFrame:
    """raw, ref_no, slips: items of the list that a text's repaired tokens make up, by number or by brand and series.

    found: raw, run, term, role, slips.  Only the least slips of each term of a text count, so a text of any length
    has at most one row for each term.
    """
    normal = F.pandas_udf(lambda s: s.map(lambda x: "".join(words_of(x))), "string")
    items = refs.select("ref_no", normal("ref_no").alias("number"), normal("brand").alias("brand"), normal("series").alias("series"))
    best = found.groupBy("raw", "term", "role").agg(F.min(F.struct("slips", "run")).alias("b")).select("raw", "term", "role", "b.slips", "b.run")
    by_number = best.where("role = 'number'").join(items, F.col("term") == F.col("number")).select("raw", "ref_no", "slips")
    brands = best.where("role = 'brand'").select("raw", F.col("term").alias("brand"), F.col("slips").alias("sb"), F.col("run").alias("rb"))
    series = best.where("role = 'series'").select("raw", F.col("term").alias("series"), F.col("slips").alias("ss"), F.col("run").alias("rs"))
    by_name = brands.join(series, "raw").where((F.col("sb") + F.col("ss") <= most) & (F.col("rb") != F.col("rs"))).join(items, ["brand", "series"]).select("raw", "ref_no", (F.col("sb") + F.col("ss")).alias("slips"))
    return by_number.unionByName(by_name).groupBy("raw", "ref_no").agg(F.min("slips").alias("slips"))


def word_lists(*columns: str) -> Column:
    """The distinct words of some texts, in Arrow batches."""
    return F.pandas_udf(lambda *texts: pd.Series([sorted({w for t in row for w in words_of(t)}) for row in zip(*texts)]), "array<string>")(*columns)


def word_weights(refs: DataFrame) -> DataFrame:
    """word, weight: inverse document frequency over the list's titles and numbers."""
    n = refs.count()
    return refs.select(F.explode(word_lists("ref_no", "brand", "series", "title")).alias("word")).groupBy("word").agg((F.log(F.lit(float(n + 1)) / F.count("*")) + 1).alias("weight"))


def soft_tfidf(a: list[str], b: list[str], weight: dict[str, float], unknown: float) -> float:
    """Soft TF-IDF of two lists of words: words at most one slip apart count, less than equal ones."""
    if not a or not b:
        return 0.0
    w = lambda x: weight.get(x, unknown)
    total = 0.0
    for x in set(a):
        near = [(1.0 if x == y else 0.8, y) for y in set(b) if x == y or (len(x) > 3 and distance(x, y, 1) <= 1)]
        if near:
            similarity, y = max(near)
            total += similarity * w(x) * w(y)
    return total / math.sqrt(sum(w(x) ** 2 for x in set(a)) * sum(w(y) ** 2 for y in set(b)))


def ranked(candidates: DataFrame, refs: DataFrame, weights: DataFrame, sent: int = MOST_WORDS) -> DataFrame:
    """raw, ref_no, slips, score of the candidates that come first for their text: fewest slips, then best soft TF-IDF.

    Items that are equal after normalisation tie and all stay, but for texts that hold one of their numbers verbatim.
    """
    listed = weights.limit(sent + 1).collect()
    weight = {r.word: r.weight for r in listed} if len(listed) <= sent else None
    unknown = weights.agg(F.max("weight")).first()[0] or 1.0

    def score(raw: pd.Series, ref_no: pd.Series, title: pd.Series, words: pd.Series, weighed: pd.Series) -> pd.DataFrame:
        scores, verbatim, number = [], [], []
        for text, ref, name, known, w in zip(raw, ref_no, title, words, weighed):
            its = weight if weight is not None else dict(zip(known, w)) if known is not None else {}
            scores.append(round(soft_tfidf(words_of(text), words_of(f"{ref} {name or ''}"), its, unknown), 9))
            verbatim.append(re.search(rf"(?<![^\W_]){re.escape(ref)}(?![^\W_])", text) is not None)
            number.append("".join(words_of(ref)))
        return pd.DataFrame({"score": scores, "verbatim": verbatim, "number": number})

    rate = F.pandas_udf(score, "score double, verbatim boolean, number string")
    least = candidates.withColumn("least", F.min("slips").over(Window.partitionBy("raw"))).where("slips = least")
    titled = least.join(refs.select("ref_no", "title"), "ref_no")
    if weight is not None:
        titled = titled.withColumns({"words": F.lit(None).cast("array<string>"), "weighed": F.lit(None).cast("array<double>")})
    else:
        # beyond the bound each candidate gets the weights of its own words by a join
        own = titled.select("raw", "ref_no", F.explode(word_lists("raw", "ref_no", "title")).alias("word")).join(weights, "word")
        own = own.groupBy("raw", "ref_no").agg(F.collect_list(F.struct("word", "weight")).alias("own")).select("raw", "ref_no", F.col("own.word").alias("words"), F.col("own.weight").alias("weighed"))
        titled = titled.join(own, ["raw", "ref_no"], "left")
    rated = titled.withColumn("r", rate("raw", "ref_no", "title", "words", "weighed")).select("raw", "ref_no", "slips", "r.*")
    # one score for items with equal numbers, so that spelling alone does not part them
    rated = rated.withColumn("score", F.max("score").over(Window.partitionBy("raw", "number"))).withColumn("exact", F.max("verbatim").over(Window.partitionBy("raw", "number")))
    rated = rated.where("verbatim or not exact").withColumn("best", F.max("score").over(Window.partitionBy("raw")))
    return rated.where("score = best").select("raw", "ref_no", "slips", "score")


def matches(entries: DataFrame, refs: DataFrame, most: int = MOST_SLIPS, sent: int = MOST_SENT) -> DataFrame:
    """entry_id, ref_no of every entry whose ``raw`` has an ASCII letter or digit; ``''`` if it means no item.

    Null, empty and blank ``raw`` give no row; equal texts are matched once; an empty list leaves every entry
    unmatched; items whose numbers are equal after normalisation give one row each unless one is written verbatim;
    texts of any length are read whole; repeated rows and further columns don't matter.
    """
    refs = refs.select(blank(F.col("ref_no")).alias("ref_no"), "brand", "series", "title").where("ref_no <> ''").groupBy("ref_no").agg(*[F.min(c).alias(c) for c in ("brand", "series", "title")])
    refs = durable(refs)
    wanted = entries.select("entry_id", "raw").where(F.col("raw").rlike("[A-Za-z0-9]"))
    terms = durable(vocabulary(refs))
    bounds = terms.agg(F.min(F.length("term")), F.max(F.length("term"))).first()
    shortest, longest = max(1, (bounds[0] or 1) - most), (bounds[1] or 0) + most
    # few bytes but much work for each text: as many tasks as cores, not as few as the bytes would need
    spark = entries.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    texts = durable(runs(wanted.select("raw").distinct().repartition(tasks, "raw"), shortest, longest))
    repairs = durable(repaired(texts.select("run").distinct().repartition(tasks, "run"), terms, most, sent))
    candidates = complete_entries(texts.join(repairs, "run"), refs, most)
    best = ranked(durable(candidates.repartition(tasks, "raw")), refs, word_weights(refs), min(sent, MOST_WORDS))
    return wanted.join(best.select("raw", "ref_no"), "raw", "left").select("entry_id", blank(F.col("ref_no")).alias("ref_no")).distinct()

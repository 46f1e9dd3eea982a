"""Template residue, filler, error pages and demands to allow scripts.

Method: records are cut into segments (sentences of lines) and segments that share a template are aligned over all
documents; slots are induced from what varies in them (``slots``).  A slot that retains a variable name, a default or
nothing marks its document, wherever it stands.  Names are induced from the corpus too: identifiers in unmistakable
template delimiters, counted over all documents, are variable names, and are then recognised in weaker delimiters.
Whole pages are templates as well: page templates that repeat with different slots and speak another language than the
catalog's pages, found by counting, teach a model what residue looks like, and it decides the pages that do not repeat
(``residue_pages``).  Well-known wordings of errors, filler and demands are further examples and decide by themselves,
for tables too small to teach anything.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partmill.llm import slots
from partmill.llm.slots import NAME
from partmill.session import durable

STRONG = re.compile(slots.STRONG, re.I)
#: Weaker delimiters, which catalog text may use as well; only induced names count in them.
WEAK = re.compile(rf"(?<!\[)\[\s*({NAME})\s*\](?!\])|(?<!<)<\s*({NAME})\s*>(?!>)|(?<!\{{)\{{\s*({NAME})\s*\}}(?!\}})|(?<!%)%({NAME})%(?!%)|(?<!@)@({NAME})@(?!@)")
#: Documents that must hold a name in strong delimiters before it counts in weaker ones.
LEAST_NAME = 2
#: Different texts that a page template must recur in to count as repeated.
LEAST_PAGE = 3
#: Part of the catalog pages up to which a word of theirs is foreign.
RARE = 0.001
#: Words that at least two catalog pages share, below which there is no language that a page could be foreign to.
LEAST_WORDS = 300
#: Part of a page's words that must be foreign if its template repeats, and if it doesn't.
SOMEWHAT, FOREIGN = 0.2, 0.6
#: Mean log odds from which a page is an example in the next round, and from which it is residue; rounds of fitting.
SURE, DECIDED, ROUNDS = 1.0, 1.5, 3

# Wording of the segments that stand for residue.
THING = r"(?:your (?:request|session|search|order)|(?:this|the|our)(?: [\w-]+){0,3}?|no results?|an? (?:[\w-]+ )?error)"
FAILED = r"(?:(?:is|are) (?:currently |temporarily )?(?:unavailable|not available|closed|down|offline)|(?:was|were|could|can|has|have|had)(?: not|n't| never) (?:be )?(?:been )?(?:found|loaded|located|shown|displayed|opened|read|processed|completed)|cannot be (?:shown|found|loaded|displayed|opened)|can't be (?:shown|found|loaded|displayed|opened)|(?:has|have) timed out|timed out|failed with|has failed|has expired|(?:has|have) been (?:removed|renamed|deleted|moved|blocked)|(?:is|has) no longer|does not exist|occurred|not found)"
DEMAND = r"(?:(?:please )?(?:enable|activate|allow|permit|accept|turn on|switch on|disable|deactivate|switch off|turn off|unblock)(?: [\w-]+){0,4}|switch (?:[\w-]+ ){1,3}(?:on|off)|turn (?:[\w-]+ ){1,3}(?:on|off))"
SCRIPT = r"(?:java ?script|js|scripts?|scripting|script blocker|active content|cookies?|browser|ad ?blocker|noscript)"
WHY = r"(?:to [\w' -]{2,40}|before [\w' -]{2,40}|for [\w' -]{2,40}|if [\w' -]{2,40})"
RESIDUE = [
    # failures
    rf"{THING} {FAILED}(?: [\w'#().-]+){{0,8}}",
    r"sorry[, ].{0,90}", r"oops(?: .{0,60})?", r"something went wrong.{0,40}", r"we are (?:looking into it|working on it|sorry).{0,40}",
    r"(?:http |error |erreur |fehler |status |code )*[1-5]\d\d(?: ?[:-])? ?(?:not found|internal server error|bad gateway.*|forbidden|unauthorized|service.*|gateway time-?out|page introuvable|seite nicht gefunden|pagina no encontrada|página no encontrada|error|moved.*|too many requests)(?: .{0,40})?",
    r"(?:http|error|erreur|fehler)(?: error| code| status)? ?[1-5]\d\d\b.{0,80}",
    r"page introuvable", r"(?:die )?seite (?:wurde )?nicht gefunden", r"p[aá]gina no encontrada", r"(?:der artikel|das produkt|die seite) ist nicht (?:mehr )?(?:verfügbar|vorhanden|erreichbar).{0,20}", r"(?:page|file|site|item|product|document|resource) not found",
    r"the page \S+ could not be .{3,40}", r"no results could be .{0,60}", r"access (?:is )?denied", r"(?:request|access|connection) (?:blocked|refused|rejected|reset)", r"permission denied",
    r"you (?:do not|don't) have (?:permission|access|the right).{0,60}", r"incident (?:number|id|no)?.{0,3}[\w-]{1,20}", r"(?:reference|ref|request|ray)(?: id| number| no)?[ :.#]{1,3}[0-9a-f-]{3,40}",
    r"too many requests", r"slow down and .{3,40}", r"(?:please )?(?:try again|retry|come back|check back|sign in|log in)(?: .{0,50})?", r"(?:please )?contact (?:the |our |your )(?:webmaster|administrator|site owner|help ?desk).{0,50}",
    r"(?:go )?back to (?:the |our )?(?:start|home|front|previous) ?page", r"your session (?:has )?(?:timed out|expired|ended).{0,30}",
    r"(?:fatal|parse|uncaught|unhandled|runtime|syntax|internal|server|database|unexpected|application|general)(?: \w+)? (?:error|exception)\b.{0,160}", r"stack ?trace.{0,20}", r"traceback \(most recent call last\).{0,20}", r"file \S+ line \d+.{0,80}", r"\w+(?:error|exception): .{0,100}", r"#?\d* ?\{?main\}?.{0,20}", r"(?:thrown )?(?:in|at) \S+(?:\.php|\.py|\.js|\.java|\.rb)\S*.{0,30}", r"warning: .{0,120} in \S+\.\w+ on line \d+",
    r"(?:site|page|shop|catalog|server|system)? ?(?:is )?(?:under|down for|closed for|in) (?:maintenance|construction)",
    # demands about scripts or the browser
    rf"(?:{WHY},? ?)?(?:you (?:must|need to|have to|should) )?{DEMAND}.{{0,60}}(?<=.){SCRIPT}?.{{0,40}}",
]
NOTICES = [
    rf"(?:this|the|our) [\w -]{{2,30}} (?:requires?|needs?) (?:[\w-]+ ){{0,2}}{SCRIPT}", rf"(?:\w+ and )?{SCRIPT} (?:is|are|must be|has to be|have to be|seems?|appears?)(?: to be)?(?: [\w-]+)* ?(?:disabled|off|blocked|required|allowed|enabled|needed|turned on|activated|not supported)(?: .{{0,60}})?",
    r"(?:your|this) browser (?:is|does|has|version|cannot|can't).{0,80}", r"some features (?:will|may|might) not .{0,20}", r"switch to a (?:current|newer|different|modern|supported) (?:version|browser).{0,50}", r"checking your browser.{0,60}", r"this (?:will|may|might) take a (?:few seconds|moment|while)", r"(?:please )?wait(?: while .{0,40})?", r"loading", r"redirecting.{0,30}",
    r"if nothing (?:appears|happens).{0,60}", rf"(?:{WHY} ?,? ?)?(?:it|this|java ?script|js|scripting) is required(?: .{{0,30}})?", rf"you need (?:to \w+ )?{SCRIPT}.{{0,60}}", r"veuillez (?:activer|autoriser|accepter).{0,80}", r"bitte (?:aktivieren|erlauben|schalten|laden|versuchen).{0,80}", r"(?:por favor,? )?(?:active|habilite|permita) (?:java ?script|las cookies|los scripts).{0,80}", r"(?:verify|confirm) (?:that )?you are (?:not a robot|human).{0,30}",
    # filler
    r"(?:sample|placeholder|dummy|default|example) (?:text|description|paragraph|content|copy|title|headline|caption|image|product)(?: (?:for|goes|here|of|used|only|text)\b.{0,40})?", r"(?:this|it) is (?:a |an |some |just )?(?:dummy|sample|placeholder|test|filler|example) .{0,50}", r"(?:\w+ )?(?:description|text|content|copy|details?|images?|picture|specification|data ?sheet) (?:is |are |will be )?(?:coming soon|to be (?:added|supplied|provided|announced|written|completed|defined)|to follow|pending|not (?:yet )?available|missing|under construction)(?: .{0,30})?",
    r"no (?:content|text|description|details?|information|data) (?:has|have|is|was|were)?(?: been)? ?(?:entered|added|provided|supplied|available|given|found|written)(?: .{0,40})?", r"(?:tbc|tbd|tba|todo|to do|n/a)(?:\b.{0,50})?", r"your (?:headline|text|title|content|caption|logo|image|description|subtitle|slogan|company name|product name)(?: goes)? here", r"(?:add|enter|type|insert|write|put|replace|edit) (?:a|an|your|the|this|some) (?:\w+ )?(?:caption|title|text|headline|description|heading|subtitle|picture|image|content|copy|paragraph)\b.{0,40}", r"(?:[\w-]+ ){1,4}goes here", r"click (?:here )?to (?:edit|add|enter).{0,40}", r"coming soon", r"under construction", r"untitled(?: \w+)?", r"(?:new|blank|empty) (?:page|document|post|item)",
]
SEGMENT = re.compile(rf"(?:{'|'.join([*RESIDUE[:-1], *NOTICES])})[\W_]*", re.I)
SCRIPT_DEMAND = re.compile(rf"(?:{WHY},? ?)?(?:you (?:must|need to|have to|should) )?{DEMAND}(?P<rest>.*)", re.I)
HAS_SCRIPT = re.compile(rf"\b{SCRIPT}\b", re.I)
# Words of the usual filler text.
LOREM = set("lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum".split())
KEYS = re.compile(r"(?:x{3,}|asdf\w*|qwer\w*|test|foo|bar|baz|blah|bla|abc|\d+|z{3,}|\.{3,})", re.I)
LINES = re.compile(r"[\r\n\x0b\x0c\x1c-\x1e\x85  ]+")
SENTENCES = re.compile(r"(?<=[.!?…])\s+")
NAVIGATION = re.compile(r"(?:home|start|main|menu|startseite|accueil|inicio)\b.*[>»/|›].*|[^.!?|]{1,40}(?:\s[|»›>·]\s[^.!?|]{1,40}){1,12}|(?:home|contact|cart|login|sitemap|imprint|privacy|back|next|top)", re.I)
COPYRIGHT = re.compile(r"(?:©|\(c\)|copyright)\s.{0,80}|.{0,40}all rights reserved.{0,20}", re.I)
#: Values that only catalog content states: numbers with a unit or a price.
CATALOG = re.compile(r"\d\s?(?:mm|cm|m|in|inch|inches|ft|psi|bars?|kpa|mpa|kg|g|lbs?|oz|gpm|l|degrees|°|stück|pi[eè]ces|piezas|pieces|pcs)\b|\d\s?[\"°€%]|[$€£]\s?\d|\d+/\d+", re.I)
HEADING_WORD = re.compile(r"[A-ZÀ-Þ0-9][\w'’&+./-]*$")


def clean(segment: str) -> str:
    text = unicodedata.normalize("NFKC", segment)
    text = "".join(c for c in text if unicodedata.category(c) != "Cf")
    return re.sub(r"\s+", " ", text).strip().strip("*_#>•▲✔🔧 \"'“”‘’`")


def is_filler(words: list[str]) -> bool:
    """Words of the usual filler text, runs of keys, or one phrase three times or more."""
    if not words:
        return False
    lorem = sum(w in LOREM for w in words)
    if len(words) >= 3 and lorem >= 0.7 * len(words):
        return True
    keys = sum(KEYS.fullmatch(w) is not None for w in words)
    if keys == len(words) and any(not w.isdecimal() for w in words) and len(words) >= 2:
        return True
    return any(n % p == 0 and words == words[:p] * (n // p) for n in [len(words)] for p in range(1, n // 3 + 1)) and len(words) >= 3


def kind_of(segment: str, whole_line: bool) -> str:
    """``residue``, ``beside`` (heading, navigation, copyright, nothing) or ``content``."""
    text = clean(segment)
    words = re.findall(r"[^\W_]+", text.lower())
    if not words:
        return "beside"
    if COPYRIGHT.fullmatch(text):
        return "beside"
    if SEGMENT.fullmatch(text) or is_filler(words):
        return "residue"
    demand = SCRIPT_DEMAND.fullmatch(text)
    if demand and len(words) <= 24 and HAS_SCRIPT.search(text):
        return "residue"
    if NAVIGATION.fullmatch(text):
        return "beside"
    if whole_line and len(words) <= 8 and text[-1] not in ".!?:;," and not re.search(r"\d{3,}|\d/\d|[a-z]-\d|\d-", text, re.I):
        plain = [w for w in text.split() if re.search(r"\w", w)]
        if plain and all(HEADING_WORD.match(w) or w.lower() in {"and", "of", "for", "the", "with", "in", "&"} for w in plain):
            return "beside"
    return "content"


def segments(text: str) -> Iterator[tuple[str, bool]]:
    for line in LINES.split(text):
        parts = [p for p in SENTENCES.split(line.strip()) if p]
        for part in parts:
            yield part, len(parts) == 1


def strong_names(text: str) -> set[str]:
    """Variable names in unmistakable delimiters."""
    return {m[m.lastgroup].lower() for m in STRONG.finditer(text)} if any(c in text for c in "{}[]<>%@_$#") else set()


def weak_names(text: str) -> set[str]:
    return {next(g for g in m.groups() if g).lower() for m in WEAK.finditer(text)} if any(c in text for c in "{}[]<>%@") else set()


def page(text: str, catalog: bool = False) -> tuple[bool, list[str]]:
    """(whether the page has nothing but segments of known residue wording beside headings, navigation and copyright lines,
    its segments beside these; none of a page with catalog values that has other segments)."""
    content, wording = [], True
    for segment, whole in segments(text):
        kind = kind_of(segment, whole)
        wording &= kind != "content"
        if catalog and not wording:
            return False, []
        if kind != "beside":
            content.append(segment)
    words = [w for s in content for w in re.findall(r"[^\W_]+", s.lower())]
    return bool(content) and (wording or is_filler(words)), content


def signs(docs: DataFrame) -> DataFrame:
    """Of every document doc_id, the delimited names ``strong`` and ``weak``, whether its ``wording`` is known residue, the
    templates of its segments (``parts``) and, if it states no catalog values, what stands beside headings, navigation and
    copyright lines (``content``) and its template (``page``, a hash)."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for doc_id, text, catalog in zip(pdf["doc_id"], pdf["text"], pdf["catalog"]):
                wording, kept = page(text, catalog)
                parts = {}
                for segment, _ in segments(text):
                    form, empty = slots.template_of(segment)
                    if form:
                        parts.setdefault((form, tuple(empty)), {"template": form, "empty": empty})
                out.append((doc_id, sorted(strong_names(text)), sorted(weak_names(text)), wording, "\n".join(kept), "\n".join(slots.template_of(s)[0] for s in kept), list(parts.values())))
            yield pd.DataFrame(out, columns=["doc_id", "strong", "weak", "wording", "content", "page", "parts"], dtype=object)

    schema = "doc_id long, strong array<string>, weak array<string>, wording boolean, content string, page string, parts array<struct<template: string, empty: array<int>>>"
    found = docs.where("text is not null").select("doc_id", "text", F.col("text").rlike(CATALOG.pattern).alias("catalog")).mapInPandas(read, schema)
    return found.withColumn("page", F.xxhash64("page"))


def features(rows: DataFrame, text: str) -> DataFrame:
    """``rows`` with feature, is_word for each distinct word and pair of neighbouring words of ``text`` (hashes; numbers and
    codes are ``#``)."""
    words = F.transform(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)")), lambda w: F.when(w.rlike(r"\p{N}"), "#").otherwise(w))
    # the words are a column of their own, so that they are not made again for each pair
    split = rows.withColumn("words", words)
    pairs = F.zip_with(F.col("words"), F.slice("words", F.lit(2), F.size("words")), lambda a, b: F.concat(a, F.lit(" "), b))
    hashes = lambda of, is_word: F.transform(F.array_distinct(of), lambda x: F.struct(F.xxhash64(x).alias("feature"), F.lit(is_word).alias("is_word")))
    both = F.concat(hashes(F.filter("words", lambda w: w != "#"), True), hashes(F.filter(pairs, lambda p: p.isNotNull()), False))
    return split.select(*[c for c in rows.columns if c != text], F.inline(both))


def residue_pages(docs: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, why of the pages that are residue as a whole: ``repeated``, ``foreign`` or ``model`` (the first that holds).

    Pages without catalog values are candidates.  A word is foreign if hardly any page with catalog values has it.  Pages
    of a template that repeats with different texts and has foreign words, pages of foreign words (error pages and
    filler of any language), and pages of known wording are examples; a naive Bayes model of words and pairs of words,
    fitted on them against all other pages and fitted again with what it found, decides the rest.
    """
    wanted = found.where("content <> ''").select(F.xxhash64("content").alias("text"), "content", "page", "wording")
    one = durable(wanted.groupBy("text").agg(F.any_value("content").alias("content"), F.any_value("page").alias("page"), F.bool_or("wording").alias("wording")))
    theirs = durable(features(one.select("text", "content"), "content"))
    catalog = docs.where(F.col("text").rlike(CATALOG.pattern))
    counted = features(catalog.select("text"), "text").groupBy("feature", "is_word").agg(F.count("*").alias("cat"))
    counted = durable(counted)
    pages = catalog.count()
    seen = counted.where("is_word").agg((F.count_if(F.col("cat") == 1) / F.sum("cat")).alias("once"), F.count_if(F.col("cat") > 1).alias("shared")).first()
    # the part of a catalog page's words that no other page has, by the words seen once
    unseen = seen.once if seen.shared >= LEAST_WORDS else 1.0
    theirs = durable(theirs.join(counted.select("feature", "cat"), "feature", "left").na.fill(0, ["cat"]))
    rare = max(1, RARE * pages)
    foreign = theirs.where("is_word").groupBy("text").agg(F.count("*").alias("words"), (F.count_if(F.col("cat") <= rare) / F.count("*")).alias("foreign"))
    repeated = one.groupBy("page").agg(F.count("*").alias("texts"))
    state = one.select("text", "page", "wording").join(repeated, "page").join(foreign, "text", "left").na.fill(0, ["words", "foreign"])
    is_repeated = (F.col("texts") >= LEAST_PAGE) & (F.col("foreign") >= max(SOMEWHAT, 2 * unseen))
    is_foreign = (F.col("words") >= 2) & (F.col("foreign") >= max(FOREIGN, 0.5 + unseen))
    state = durable(state.select("text", "wording", F.when(is_repeated, "repeated").when(is_foreign, "foreign").alias("why")))
    chosen = state.where("wording or why is not null").select("text")
    others = state.count()
    for _ in range(ROUNDS):
        sure = durable(chosen.distinct().withColumn("sure", F.lit(True)))
        n = sure.count()
        marked = theirs.join(sure, "text", "left")
        of = marked.groupBy("feature").agg(F.count_if("sure").alias("p"), (F.count_if(F.col("sure").isNull()) + F.max("cat")).alias("q")).where("p + q >= 2")
        odds = F.log((F.col("p") + 0.1) / (n + 1.0)) - F.log((F.col("q") + 0.1) / (pages + others - n + 1.0))
        scored = durable(theirs.join(of.select("feature", odds.alias("odds")), "feature").groupBy("text").agg(F.avg("odds").alias("score")))
        chosen = state.where("wording or why is not null").select("text").unionByName(scored.where(F.col("score") >= SURE).select("text"))
    last = state.join(scored, "text", "left").select("text", F.coalesce("why", F.when(F.col("score") >= DECIDED, "model")).alias("why")).where("why is not null")
    return found.where("content <> ''").select("doc_id", F.xxhash64("content").alias("text")).join(last, "text").select("doc_id", "why")


def reasons(docs: DataFrame) -> DataFrame:
    """doc_id, why: every reason for which a document is residue.

    ``slot``: an induced slot keeps a name, a default or nothing; ``name``: a name in delimiters that nothing else uses,
    or an induced name in weaker ones; ``repeated``, ``foreign``, ``model``: see :func:`residue_pages`; ``wording``: all
    its segments are of known wording.
    """
    found = durable(signs(docs))
    parts = found.select("doc_id", F.inline("parts"))
    names = found.select(F.explode("strong").alias("name")).groupBy("name").count().where(F.col("count") >= LEAST_NAME).select("name")
    weak = found.select("doc_id", F.explode("weak").alias("name")).join(names, "name").select("doc_id")
    named = found.where("size(strong) > 0").select("doc_id").unionByName(weak)
    unfilled = slots.unfilled_documents(parts)
    given = lambda df, why: df.select("doc_id", F.lit(why).alias("why"))
    return given(unfilled, "slot").unionByName(given(named, "name")).unionByName(residue_pages(docs, found)).unionByName(given(found.where("wording"), "wording")).distinct()


def residue(docs: DataFrame) -> DataFrame:
    """doc_id of the documents to exclude.

    Null, empty and blank texts are no cases; texts of any length are read whole; repeated ids give one row; further
    columns don't matter; an empty table gives an empty result.  In a table with few catalog pages nothing is foreign,
    and only placeholders, unfilled slots and known wordings are found.
    """
    return reasons(docs).select("doc_id").distinct()

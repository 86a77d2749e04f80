"""Rules, layout matching and the field catalog, on known answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import catalog as C
from tessera.operators import layout as L
from tessera.operators import rules as R
from tessera.plans.known import cases, known_rows, known_values, sql
from tessera.plans.registry import query
from tessera.plans.session import table

ROW = "field string, value string"
#: Reference rows of the queries; the operators take whole tables of them.
ZIPS = [("IN", "460", "479"), ("WI", "530", "532"), ("WI", "534", "549"), ("DC", "200", "200"), ("DC", "202", "205")]
LICENCES = [("WI", "^[A-Z][0-9]{13}$"), ("IN", "^[0-9]{10}$|^[A-Z][0-9]{9}$")]
_FIELDS = [
    [("Mail_State", "IN"), ("Mail_Zip", "53731"), ("EffectiveDate", "01/01/2024"), ("ExpirationDate", "01/01/2024"), ("Phone_A", "555-1234"), ("NAICCode", "1234")],
    [("Vehicle_Year_A", "1899"), ("Vehicle_Year_B", "2024"), ("Driver_DateOfBirth_A", "01/01/2015"), ("VIN_A", "1HGCM82633A004353"), ("VIN_B", "1HGCM82633A004352"), ("NAIC", "12345"), ("Fax", "1 (555) 123-4567")],
    [("Mail_State", "WI"), ("Mail_Zip", "53731-1234"), ("EffectiveDate", "01/01/2024"), ("ExpirationDate", "01/01/2025"), ("Driver_DateOfBirth_A", "01/01/1890"), ("VIN_A", "short"), ("Other", None)],
    [("Mail_State", "ZZ"), ("Mail_Zip", "99999"), ("EffectiveDate", "soon"), ("Phone_A", ""), ("Empty", None)],
]


def _rows(spark, sf_dir):
    return cases(spark, sf_dir, ROW, _FIELDS)


def _zips(spark):
    return spark.createDataFrame(ZIPS, "state string, low string, high string")


_WARN = [
    [("Mail_State", "state_zip"), ("EffectiveDate", "date_order"), ("Phone_A", "phone"), ("NAICCode", "naic")],
    [("Vehicle_Year_A", "vehicle_year"), ("Driver_DateOfBirth_A", "birth_date"), ("VIN_A", "vin")],
    [("Mail_State", "state_zip"), ("Driver_DateOfBirth_A", "birth_date")],
    [],
]
_WARN[2].remove(("Mail_State", "state_zip"))
known_rows("validation_fields", "X05: the seven warning rules.", ["field", "rule", "severity"], [[(f, r, "warning") for f, r in case] for case in _WARN], lambda spark, d: R.field_issues(_rows(spark, d), "2024-06-01", _zips(spark)))

_FORM = [
    [("Mail_StateCode_A", "IN"), ("Mail_ZipCode_A", "53731"), ("Policy_EffectiveDate", "2024-01-01"), ("Policy_ExpirationDate", "01/01/2023"), ("FEIN", "12-345678"), ("Phone_A", "555-1234")],
    [("VIN_A", "1HGCM82633A004353"), ("VIN_B", "short"), ("TaxId", "123456789"), ("Phone_A", "15551234567"), ("StartDate", "soon"), ("TaxId_B", "1234567890")],
    [("Driver_LicenseNumber_A", "123"), ("Driver_LicenseState_A", "WI"), ("Driver_LicenseNumber_B", "A123456789"), ("Driver_LicenseState_B", "IN"), ("Blank", " "), ("Fax", "(555) 123-4567")],
]
_ISSUES = [
    [("Mail_StateCode_A", "state_zip_consistency", "warning"), ("Policy_EffectiveDate", "date_ordering", "error"), ("FEIN", "fein_format", "error"), ("Phone_A", "phone_format", "info")],
    [("VIN_A", "vin_checksum", "error"), ("VIN_B", "vin_length", "error"), ("StartDate", "date_format", "error"), ("TaxId_B", "fein_format", "info")],
    [("Driver_LicenseNumber_A", "dl_format", "warning")],
]


def _form(spark, sf_dir):
    return cases(spark, sf_dir, ROW, _FORM)


def _form_issues(spark, sf_dir):
    return R.form_issues(_form(spark, sf_dir), _zips(spark), spark.createDataFrame(LICENCES, "state string, pattern string"))


known_rows("validation_form", "X06: the seven rules with severities.", ["field", "rule", "severity"], _ISSUES, _form_issues)
_FIXED = {"15551234567": "(555) 123-4567", "123456789": "12-3456789"}
known_rows("validation_corrected", "X06: corrected values.", ["field", "corrected"], [[(f, _FIXED.get(v, v)) for f, v in case] for case in _FORM], lambda spark, d: R.corrected(_form(spark, d)))
_WANTED = ["VIN_A", "Phone_A", "Driver_LicenseState_A"]
known_rows(
    "gap_status", "Z06, P19: wanted fields that are missing or invalid.", ["field", "status"],
    [[("VIN_A", "missing"), ("Phone_A", "ok"), ("Driver_LicenseState_A", "missing")], [("VIN_A", "invalid"), ("Phone_A", "ok"), ("Driver_LicenseState_A", "missing")], [("VIN_A", "missing"), ("Phone_A", "missing"), ("Driver_LicenseState_A", "ok")]],
    lambda spark, d: R.gaps(_form(spark, d), _form_issues(spark, d), spark.createDataFrame([(f,) for f in _WANTED], "field string")),
)

BLOCK = "page int, ord int, text string, x double, y double, x0 double, y0 double, x1 double, y1 double, confidence double"
ANCHORS = [(0, "AGENCY", 100.0, 100.0), (0, "CARRIER", 500.0, 100.0), (0, "Policy Number", 500.0, 200.0), (1, "DRIVERS", 100.0, 50.0)]
PLACES = [(0, "Producer", "text", 80.0, 130.0, 200.0, 160.0), (0, "Carrier", "text", 480.0, 130.0, 560.0, 160.0), (0, "Box", "checkbox", 300.0, 300.0, 320.0, 320.0), (0, "Vehicle_UsePercent_A", "text", 80.0, 400.0, 140.0, 420.0), (1, "Driver", "text", 90.0, 80.0, 200.0, 100.0)]


def _b(page, ord_, text, x, y, w=60.0, h=20.0, confidence=0.9):
    return (page, ord_, text, float(x), float(y), x - w / 2, y - h / 2, x + w / 2, y + h / 2, confidence)


_PAGES = [
    [_b(0, 0, "Agency", 110, 104), _b(0, 1, "Acme", 120, 150), _b(0, 2, "Ltd", 170, 150), _b(0, 3, "carrier:", 512, 106), _b(0, 4, "Zurich", 530, 150), _b(0, 5, "X", 318, 318), _b(0, 6, "John", 112, 412), _b(1, 0, "DRIVERS LIST", 100, 50), _b(1, 1, "Ann", 130, 90)],
    [_b(0, 0, "nothing known", 900, 900), _b(0, 1, "Solo", 150, 145), _b(0, 2, "50", 110, 410), _b(0, 3, "Edge", 500, 164, 60, 40)],
]


def _blocks(spark, sf_dir):
    return cases(spark, sf_dir, BLOCK, _PAGES)


def _anchors(spark):
    return spark.createDataFrame(ANCHORS, "page int, text string, x double, y double")


def _places(spark):
    return spark.createDataFrame(PLACES, "page int, field string, kind string, x0 double, y0 double, x1 double, y1 double")


known_rows("anchor_shift", "J01: two-way containment, nearest, median.", ["page", "dx", "dy"], [[(0, 11.0, 5.0), (1, 0.0, 0.0)], []], lambda spark, d: L.anchor_shift(_blocks(spark, d), _anchors(spark)), {"dx": "DOUBLE", "dy": "DOUBLE"})
known_rows("anchor_mean_shift", "J02: first block in order, mean over pages.", ["dx", "dy"], [[(22 / 3, 10 / 3)], []], lambda spark, d: L.mean_shift(_blocks(spark, d), _anchors(spark)), {"dx": "DOUBLE", "dy": "DOUBLE"})
known_rows("checkbox_markers", "J06.", ["field"], [[("Box",)], []], lambda spark, d: L.ticked_boxes(_blocks(spark, d), _places(spark).filter("kind = 'checkbox'")))
known_rows(
    "positional_match", "J36: shifted places, markers, containment, overlap and their confidence.", ["field", "value", "method", "confidence"],
    [[("Producer", "Acme Ltd", "positional_containment", 0.709), ("Carrier", "Zurich", "positional_containment", 0.709), ("Box", "1", "positional_checkbox", 0.659), ("Driver", "Ann", "positional_containment", 0.709)],
     [("Producer", "Solo", "positional_containment", 0.645), ("Vehicle_UsePercent_A", "50", "positional_containment", 0.645), ("Carrier", "Edge", "positional_iou", 0.595)]],
    lambda spark, d: L.positional(_blocks(spark, d), _places(spark), _anchors(spark)), {"confidence": "DOUBLE"},
)
known_rows("topmost_label", "T07.", ["label", "x", "y"], [[("agency", 110.0, 104.0), ("DRIVERS", 100.0, 50.0)], []], lambda spark, d: L.topmost(_blocks(spark, d), spark.createDataFrame([("agency", 0.0, 9999.0, 0.0, 9999.0), ("DRIVERS", 0.0, 9999.0, 0.0, 60.0)], "label string, x_min double, x_max double, y_min double, y_max double")), {"x": "DOUBLE", "y": "DOUBLE"})
known_rows(
    "below_label", "X04, T06: the best text below a label, else in a fixed region.", ["label", "text"], [[("agency", "Zurich")], [("agency", "Solo")]],
    lambda spark, d: L.below_label(_blocks(spark, d).filter("page = 0"), spark.createDataFrame([("agency", 0.0, 9999.0, 0.0, 9999.0)], "label string, x_min double, x_max double, y_min double, y_max double"), spark.createDataFrame([("agency", 100.0, 200.0, 100.0, 200.0)], "label string, a double, b double, c double, d double")),
)
known_rows(
    "interval_picks", "N14.", ["row", "amounts", "number", "naic", "policy"],
    [[(1, [1000, 12345], "12345", "12345", "AB-12345"), (2, [], None, None, None)], [(1, [7], "7", None, None)]],
    lambda spark, d: L.picks(cases(spark, d, "row int, ord int, text string, x double", [[(1, 0, "$1,000", 10.0), (1, 1, "12345", 20.0), (1, 2, "AB-12345", 30.0), (1, 3, "99", 500.0), (2, 0, "BA", 10.0)], [(1, 0, "0", 99.0), (1, 1, "7", 5.0), (1, 2, "x", 6.0)]]), 0.0, 98.0),
    {"amounts": "BIGINT[]"},
)
known_rows(
    "guided_pairs", "J09: strings met with blocks, nearest right, a value once.", ["n", "label_ord", "value_ord"],
    [[(0, 0, 1), (2, 3, 4)], [(0, 0, 1)]],
    lambda spark, d: L.guided_pairs(
        cases(spark, d, BLOCK, [[_b(0, 0, "Name:", 100, 100), _b(0, 1, "Acme Ltd", 200, 102), _b(0, 2, "Acme Ltd", 420, 100), _b(0, 3, "City", 100, 200), _b(0, 4, "Bonn", 180, 200), _b(0, 5, "Bonn", 180, 400)], [_b(0, 0, "Name", 100, 100), _b(0, 1, "Acme", 200, 100)]]),
        cases(spark, d, "n int, label string, value string", [[(0, "Name", "Acme Ltd"), (1, "Town", "Bonn"), (2, "City", "Bonn")], [(0, "name", "ACME"), (1, "name", "acme")]]),
    ),
)
_PREFILL = [("Insured_FullName", "text", "Enter the full name of the insured"), ("Policy_Number", "text", "Enter the policy number"), ("Policy_NumberIdentifier", "text", "Enter the policy number"), ("Total_PremiumAmount", "text", None), ("Smoker_Indicator", "checkbox", None)]
known_rows(
    "prefill_fields", "J12: labels to fields, longest name, guards, nothing twice.", ["field", "value", "basis"],
    [[("Policy_NumberIdentifier", "P1", "tooltip"), ("Policy_Number", "P2", "tooltip"), ("Insured_FullName", "Acme", "tooltip")], [("Total_PremiumAmount", "$5", "field_name"), ("Smoker_Indicator", "yes", "field_name")]],
    lambda spark, d: L.prefill(
        cases(spark, d, "n long, label string, value string", [[(0, "Policy Number:", "P1"), (1, "policy number", "P2"), (2, "policy number", "P3"), (3, "Full Name", "Acme"), (4, "zzz", "q")], [(0, "total premium", "abc"), (1, "total premium", "$5"), (2, "Smoker", "maybe"), (3, "smoker", "yes"), (4, "full name", "given")]]),
        spark.createDataFrame(_PREFILL, "field string, kind string, tooltip string"),
        cases(spark, d, "field string", [[("Other",)], [("Insured_FullName",)]]),
    ),
)
known_values("dark_share", "A18.", "k int", [(0, 1.0), (1, 0.0), (2, None), (3, 0.25)], lambda k: F.when(k == 0, L.dark_share(F.array_repeat(F.lit(0), 25), F.lit(5), F.lit(5))).when(k == 1, L.dark_share(F.array_repeat(F.lit(200), 25), F.lit(5), F.lit(5))).when(k == 3, L.dark_share(F.array(*map(F.lit, [9, 9, 9, 9, 9, 0, 200, 9, 9, 200, 200, 9, 9, 9, 9, 9])), F.lit(4), F.lit(4))), "DOUBLE")
known_values(
    "checkbox_decision", "A19.", "c string, r double, z double",
    [(None, 0.04, None, "Off"), (None, 0.07, None, None), ("1", 0.09, None, "Off"), ("Off", 0.30, None, "1"), ("1", 0.12, 0.02, "Off"), (None, 0.20, 0.25, "1"), ("Off", 0.20, 0.25, "1"), ("Off", 0.15, 0.15, "Off"), ("1", None, None, "1"), ("Off", 0.20, None, "Off")],
    L.box_decision,
)
known_values("consensus_confidence", "N08, P16.", "v string, t string, s boolean", [("Acme", "the ACME works", False, 1.0), ("zzz", "x", True, 1.0), ("ab", "x", False, 0.8), ("acme works inc", "acme only", False, 0.7), ("acme works", "works and acme", False, 0.9), ("nothing here", "x", False, 0.5), (" ", "x", False, 0.0), (None, "x", False, 0.0)], L.consensus, "DOUBLE")
known_values("strict_filter", "P16.", "v string, t string, s boolean", [("Acme", "acme", False, True), ("nothing", "x", False, False), ("nothing", "x", True, True), ("", "x", False, False)], lambda v, t, s: L.kept_by_consensus(L.consensus(v, t, s)), "BOOLEAN")
known_values("effective_confidence", "N09.", "e double, s double, b double", [(0.95, 0.9, 0.5, 0.8), (0.95, 0.9, 1.0, 0.95), (None, 0.9, 1.0, 0.9), (None, 0.9, 0.5, 0.675), (None, 0.8, None, 0.6), (0.7, 0.9, None, 0.7)], L.effective_confidence, "DOUBLE")
known_rows(
    "page_markdown", "F27.", ["page", "text"], [[(0, "Agency | carrier:\nAcme | Ltd | Zurich\nX\nJohn"), (1, "DRIVERS LIST\nAnn")], [(0, "Solo\nEdge\n50\nnothing known")]],
    lambda spark, d: L.as_text(_blocks(spark, d), 10),
)


@query("region_scaling", "SELECT p_partkey, p_size * 0.5::DOUBLE + 3 AS x0, p_size * 0.5::DOUBLE - 1 AS y0 FROM part")
def region_scaling(spark, sf_dir):
    """N04."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("x0"), F.col("p_size").cast("double").alias("y0"))
    return L.scaled(part, ["x0", "y0"], 0.5, 3.0, -1.0)


# --- the field catalog: parts are fields, brands are forms, types are categories ---------------------------------------


def _catalog(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    return p.select(
        F.col("p_brand").alias("form"), F.col("p_name").alias("field"), F.col("p_type").alias("category"), F.when(k % 3 == 0, "checkbox").otherwise("text").alias("kind"), F.when(k % 4 > 0, F.concat(F.lit("tip "), "p_name")).otherwise("").alias("tooltip"),
        F.get(F.array(*map(F.lit, ["", "Off", "7", "None", "x"])), (k % 5).cast("int")).alias("default_value"), F.when(k % 2 == 0, F.col("p_size").cast("double")).alias("x0"), (F.col("p_size") % 3).alias("page"), k.alias("k"),
    )


@query("positioned_fields", "SELECT p_name AS field, (p_size % 3)::INT AS page FROM part WHERE p_partkey % 2 = 0 AND p_size IS NOT NULL AND p_size % 3 = 1")
def positioned_fields(spark, sf_dir):
    """P01."""
    return C.positioned(_catalog(spark, sf_dir), 1).select("field", "page")


@query("catalog_names", "SELECT p_brand AS form, p_type AS category, list_sort(list(DISTINCT p_name)) AS fields FROM part GROUP BY 1, 2")
def catalog_names(spark, sf_dir):
    """P02."""
    return C.names_by(_catalog(spark, sf_dir), "form", "category")


@query("catalog_defaults", "SELECT p_name AS field, CASE p_partkey % 5 WHEN 2 THEN '7' ELSE 'x' END AS default_value FROM part WHERE p_partkey % 5 IN (2, 4)")
def catalog_defaults(spark, sf_dir):
    """Defaults that say something."""
    return C.with_default(_catalog(spark, sf_dir)).select("field", "default_value")


@query("catalog_tooltips", "SELECT p_name AS field, 'tip ' || p_name AS tooltip FROM part WHERE p_partkey % 4 > 0")
def catalog_tooltips(spark, sf_dir):
    """P03."""
    return C.tooltips(_catalog(spark, sf_dir))


@query("empty_form", "SELECT p_name AS field, CASE p_partkey % 5 WHEN 1 THEN 'Off' WHEN 2 THEN '7' WHEN 3 THEN 'None' WHEN 4 THEN 'x' END AS value FROM part")
def empty_form(spark, sf_dir):
    """P06, with defaults."""
    return C.empty_form(_catalog(spark, sf_dir), True)


@query(
    "mapping_coverage",
    """WITH m AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_quantity > 48), c AS (SELECT p_brand AS form, p_partkey % 3 = 0 AS box, m.l_partkey IS NOT NULL AS hit FROM part LEFT JOIN m ON l_partkey = p_partkey)
SELECT form, count(*) AS total_fields, count(*) FILTER (WHERE hit) AS mapped_fields, round(100.0::DOUBLE * count(*) FILTER (WHERE hit) / count(*), 1) AS coverage_pct, count(*) FILTER (WHERE NOT hit AND box) AS unmapped_checkboxes, count(*) FILTER (WHERE NOT hit AND NOT box) AS unmapped_text FROM c GROUP BY 1""",
)
def mapping_coverage(spark, sf_dir):
    """A08."""
    c = _catalog(spark, sf_dir).withColumn("field", F.col("k").cast("string"))
    hit = table(spark, sf_dir, "lineitem").filter("l_quantity > 48").select(F.col("l_partkey").alias("k")).distinct()
    return C.coverage(c.join(hit, "k").select("form", "field"), c)


@query("lob_threshold", "SELECT c_custkey AS doc, c_mktsegment AS lob, (c_custkey % 11) / 10.0::DOUBLE AS confidence FROM customer WHERE c_custkey % 11 >= 7 AND c_mktsegment IN ('BUILDING', 'MACHINERY')")
def lob_threshold(spark, sf_dir):
    """P14."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc"), F.col("c_mktsegment").alias("lob"), (F.col("c_custkey") % 11 / 10).alias("confidence"))
    return C.lobs_above(rows, spark.createDataFrame([("BUILDING",), ("MACHINERY",)], "lob string"))


_FORMS = [("AUTOMOBILE", "127"), ("AUTOMOBILE", "137"), ("BUILDING", "125"), ("MACHINERY", "125"), ("MACHINERY", "163"), ("HOUSEHOLD", "125")]


@query("form_list_union", f"WITH f(lob, form) AS (VALUES {', '.join('(' + ', '.join(map(sql, r)) + ')' for r in _FORMS)}) SELECT c_nationkey AS doc, list_sort(list(DISTINCT form)) AS forms FROM customer JOIN f ON lob = c_mktsegment GROUP BY 1")
def form_list_union(spark, sf_dir):
    """A nation's lines of business stand for a submission's."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("doc"), F.col("c_mktsegment").alias("lob"))
    return C.forms_for(rows, spark.createDataFrame(_FORMS, "lob string, form string"))


known_rows(
    "section_scope", "P20.", ["category", "text"], [[("all", "Agency\nAcme\nLtd\ncarrier:\nZurich\nX\nJohn"), ("drivers", "DRIVERS LIST"), ("names", "carrier:")], [("all", "nothing known\nSolo\n50\nEdge")]],
    lambda spark, d: C.section_text(_blocks(spark, d), spark.createDataFrame([("all", 0, None), ("all", 0, "acme"), ("drivers", 1, "drivers"), ("names", 0, "Carrier")], "category string, page int, keyword string")),
)


@query(
    "point_lookup",
    """WITH s AS (SELECT s_name AS key, min(s_suppkey)::VARCHAR AS d FROM supplier WHERE s_suppkey % 3 = 0 GROUP BY 1), n AS (SELECT s_name AS key, max(s_suppkey)::VARCHAR AS d FROM supplier WHERE s_suppkey % 2 = 0 GROUP BY 1)
SELECT DISTINCT s_name AS key, coalesce(s.d, n.d) AS document, CASE WHEN s.d IS NOT NULL THEN 'key' WHEN n.d IS NOT NULL THEN 'similar' END AS basis FROM supplier k LEFT JOIN s ON s.key = k.s_name LEFT JOIN n ON n.key = k.s_name""",
)
def point_lookup(spark, sf_dir):
    """By key, else the most similar row."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("key"), F.col("s_suppkey").cast("string").alias("document"), F.col("s_suppkey").alias("score"))
    return C.point_lookup(s, s.filter("score % 3 = 0"), s.filter("score % 2 = 0"))


@query(
    "focused_examples",
    """WITH e AS (SELECT DISTINCT l_orderkey, l_suppkey, l_linenumber, l_partkey FROM lineitem WHERE l_quantity > 40)
SELECT l_orderkey AS stem, l_suppkey % 3 AS page, list_sort(list(DISTINCT l_partkey)) AS fields FROM e WHERE l_orderkey % 2 = 0 GROUP BY 1, 2 HAVING count(DISTINCT l_partkey) >= 2""",
)
def focused_examples(spark, sf_dir):
    """Wrong fields of a document by page, from two on."""
    li = table(spark, sf_dir, "lineitem").filter("l_quantity > 40")
    errors = li.select(F.lit("f").alias("form"), F.col("l_orderkey").alias("stem"), (F.col("l_suppkey") % 3).alias("page"), F.col("l_partkey").alias("field"), F.lit("true").alias("expected"))
    docs = table(spark, sf_dir, "orders").filter("o_orderkey % 2 = 0").select(F.lit("f").alias("form"), F.col("o_orderkey").alias("stem"))
    return C.focused(errors, docs, "page", 2).select("stem", "page", "fields")


_JSON = [
    '{"Policy_Number": "P1", "Vehicle 1": {"Model Year": "2020", "Coverages": {"Liability#": "5", "list": [1]}}, "Driver 2": {"Name": "Ann"}, "tags": [1, 2], "none": null}',
    '{"a": {"b": {"c": "deep"}}, "Vehicle 14": {"VIN": "x"}, "n": 5}',
    '{}',
]
_FLAT = [
    [("Policy_Number", "Policy_Number", "P1"), ("Vehicle 1.Model Year", "Vehicle_Model_Year_A", "2020"), ("Vehicle 1.Coverages.Liability#", "Vehicle_Coverages_LiabilityNumber_A", "5"), ("Driver 2.Name", "Driver_Name_B", "Ann")],
    [("a.b.c", "a_b_c", "deep"), ("Vehicle 14.VIN", "Vehicle_VIN_14", "x"), ("n", "n", "5")],
    [],
]


def _flat(spark, sf_dir):
    return C.flatten(cases(spark, sf_dir, "json string", [[(j,)] for j in _JSON]))


known_rows("record_flatten", "M01: recursive, with letters for numbered objects.", ["path", "key", "value"], _FLAT, _flat)
known_rows("dotted_path", "M04.", ["value"], [[("2020",)], [], []], lambda spark, d: C.at_path(_flat(spark, d), "Vehicle 1.Model Year"))
known_values(
    "record_parse", "M05.", "j string",
    [('{"business": {"name": "Acme", "address": "5 Main"}, "drivers": [{"full_name": "Ann B Lee"}, {"full_name": "Bo", "last_name": "X"}]}', "Acme/5 Main/Ann-Lee,Bo-X"), ('{"business": {"name": "Acme"}, "drivers": null}', "Acme/"), ("{}", "")],
    lambda j: F.concat_ws("/", C.parse_record(j)["name"], C.parse_record(j)["line_one"], F.nullif(F.array_join(F.transform(C.parse_record(j)["drivers"], lambda d: F.concat_ws("-", d["first_name"], d["last_name"])), ","), F.lit("_"))),
)

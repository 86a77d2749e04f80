"""Widgets, layout rules and whole runs, on known answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import form_rules as R
from tessera.operators import widgets as W
from tessera.plans.form_views import LICENCES, _zips
from tessera.plans.known import cases, known_rows
from tessera.plans.mapping_views import _MAP

WIDGET = "page int, ord int, field string, kind string, tooltip string, value string, x0 double, y0 double, x1 double, y1 double, read_only boolean"
_WIDGETS = [
    [(0, 0, "Name_A", "text", "The name", " Bob ", 7.2, 14.4, 72.0, 28.8, False), (0, 1, "Box_Indicator", "checkbox", None, "Yes", 0.0, 0.0, 7.2, 7.2, False), (1, 0, "Name_A", "text", None, "Al", 0.0, 0.0, 9.0, 9.0, False), (1, 1, "Vehicle_Year_2", "text", None, "none", 1.0, 1.0, 1.0, 9.0, None)],
    [(0, 0, "Box_Indicator", "checkbox", None, "Off", 0.0, 0.0, 7.2, 7.2, False), (0, 1, "Form_Id", "text", None, "125", 0.0, 0.0, 9.0, 9.0, True), (0, 2, "", "text", None, "lost", 0.0, 0.0, 9.0, 9.0, False)],
    [(0, 0, "Name_A", "text", None, None, 0.0, 0.0, 9.0, 9.0, False)],
]
_VALUES = [[("Name_A", "Bob"), ("Box_Indicator", "Yes"), ("Vehicle_Year_2", "2020"), ("Gone", "x")], [("Box_Indicator", "x"), ("Form_Id", "9")], [("Gone", "x"), ("Gone_2", "y")]]


def _widgets(spark, sf_dir):
    return cases(spark, sf_dir, WIDGET, _WIDGETS)


def _said(spark, sf_dir):
    return cases(spark, sf_dir, "field string, value string", _VALUES)


known_rows("widget_values", "S05.", ["field", "value"], [[("Name_A", "Al"), ("Box_Indicator", "1")], [("Box_Indicator", "Off"), ("Form_Id", "125")], []], lambda s, d: W.widget_values(_widgets(s, d)))
known_rows(
    "widget_catalog", "S13, S14.", ["field", "page", "x0", "y0", "x1", "y1", "category", "suffix", "base_name", "default_value"],
    [
        [("Name_A", 0, 30.0, 60.0, 300.0, 120.0, "general", "_A", "Name", " Bob "), ("Box_Indicator", 0, 0.0, 0.0, 30.0, 30.0, "checkbox", None, None, "Yes"), ("Vehicle_Year_2", 1, 4.2, 4.2, 4.2, 37.5, "vehicle", "_2", "Vehicle_Year", "none")],
        [("Box_Indicator", 0, 0.0, 0.0, 30.0, 30.0, "checkbox", None, None, None), ("Form_Id", 0, 0.0, 0.0, 37.5, 37.5, "header", None, None, "125")],
        [("Name_A", 0, 0.0, 0.0, 37.5, 37.5, "general", "_A", "Name", None)],
    ],
    lambda s, d: W.widget_catalog(_widgets(s, d)), {c: "DOUBLE" for c in ("x0", "y0", "x1", "y1")},
)
known_rows("widget_sections", "S13.", ["page", "category", "fields"], [[(0, "general", ["Name_A"]), (0, "checkbox", ["Box_Indicator"]), (1, "vehicle", ["Vehicle_Year_2"])], [(0, "checkbox", ["Box_Indicator"]), (0, "header", ["Form_Id"])], [(0, "general", ["Name_A"])]], lambda s, d: W.sections(W.widget_catalog(_widgets(s, d))))
known_rows("fill_plan", "S15.", ["page", "ord", "field", "value"], [[(0, 0, "Name_A", "Bob"), (1, 0, "Name_A", "Bob"), (0, 1, "Box_Indicator", "True")], [(0, 0, "Box_Indicator", "False")], []], lambda s, d: W.fill_plan(_widgets(s, d), _said(s, d)))
known_rows("fill_counts", "S15.", ["filled", "skipped"], [[(3, 2)], [(1, 1)], [(0, 2)]], lambda s, d: W.fill_counts(_widgets(s, d), _said(s, d)))

_BLOCKS = [
    [(0, 0, "TOTAL:", 1600.0, 1300.0), (0, 1, "$", 1700.0, 1300.0), (0, 2, "$1,250.50", 1750.0, 1310.0), (0, 3, "9", 1760.0, 1500.0), (0, 4, "PRODUCT CODE", 900.0, 300.0), (0, 5, "Product Code", 900.0, 500.0), (0, 6, "CGL-12345", 920.0, 350.0)],
    [(0, 0, "QUOTE", 1400.0, 700.0), (0, 1, "X", 1450.0, 705.0), (0, 2, "BOUND", 1400.0, 800.0), (0, 3, "01/02/2024", 1500.0, 800.0), (0, 4, "x", 1600.0, 800.0), (0, 5, "QUOTE", 2000.0, 640.0), (1, 0, "RENEW", 1400.0, 700.0)],
    [(0, 0, "TOTAL", 100.0, 1300.0), (0, 1, "500", 200.0, 1300.0), (0, 2, None, 1400.0, 700.0)],
]
known_rows(
    "layout_rules", "X01: total, product code and status row.", ["field", "value"],
    [
        [("Policy_Total_EstimatedPremium", "1250.50"), ("Policy_ProductCode_A", "CGL-12345")],
        [("Policy_Status_QuoteIndicator_A", "true"), ("Policy_Status_BoundIndicator_A", "false"), ("Policy_Status_EffectiveDate_A", "01/02/2024")],
        [],
    ],
    lambda s, d: R.apply_rules(cases(s, d, "page int, ord int, text string, x double, y double", _BLOCKS), s.createDataFrame(R.FORM_125, R.RULE)),
)

_LIST = [
    [(3, 0, 10.0, "Ford"), (3, 1, 20.0, "Escort"), (3, 2, 110.0, "2001"), (5, 0, 110.0, " "), (7, 0, 15.0, "VW"), (9, 0, 15.0, "third")],
    [(1, 0, 500.0, "outside")],
]
known_rows("row_records", "X02, with two rows a form.", ["field", "value"], [[("Make_A", "Ford Escort"), ("Year_A", "2001"), ("Make_B", "VW")], []], lambda s, d: R.row_records(cases(s, d, "row int, ord int, x double, text string", _LIST), s.createDataFrame([("Make", 0.0, 99.0), ("Year", 100.0, 199.0)], "field string, x_min double, x_max double"), 2))

_FORM_PAIRS = [[(1, "Phone", "15551234567", 1, 5.0), (2, "VIN", "1HGCM82633A004353", 1, 5.0), (3, "Agency", " N/A ", 1, 5.0)], [(1, "Agency:", "City: Bonn", 1, 5.0), (2, "Phone", "", 1, 5.0)]]
_RUN_MAP = [("phone", 0, "Phone_A", 1, None, 0.9, 1), ("vin", 0, "VIN_A", 1, None, 0.9, 1)] + _MAP


def _run(spark, sf_dir):
    pairs = cases(spark, sf_dir, "ord int, label string, value string, page int, y double", _FORM_PAIRS)
    maps = spark.createDataFrame(_RUN_MAP, "label string, ord int, field string, page int, y_region string, confidence double, seen int")
    known = spark.createDataFrame([("Phone_A", "text", None, None), ("VIN_A", "text", None, None), ("Agency_A", "text", None, None)], "field string, kind string, default_value string, width double")
    wanted = spark.createDataFrame([("Phone_A",), ("VIN_A",), ("Agency_A",)], "field string")
    return R.form_run(pairs, maps, known, _zips(spark), spark.createDataFrame(LICENCES, "state string, pattern string"), wanted)


known_rows("form_run_status", "X11: lookup, normalising, correction, rules and gaps in a row.", ["field", "status"], [[("Phone_A", "ok"), ("VIN_A", "invalid"), ("Agency_A", "missing")], [("Phone_A", "missing"), ("VIN_A", "missing"), ("Agency_A", "ok")]], lambda s, d: _run(s, d)[2])

_SESSIONS = [
    [("m", 2, "second", None, None), ("m", 1, "first", None, None), ("t", 0, None, None, None), ("t", 0, None, None, None), ("v", 0, "x", "125", "Name"), ("v", 0, "", "125", "City"), ("c", 0, "Bonn", "125", "City"), ("c", 0, "lost", "127", "Name")],
    [("m", 1, None, None, None), ("t", 0, None, None, None), ("v", 0, "x", "125", "Name"), ("c", 0, "", "125", "Name")],
    [("m", 1, "not touched", None, None), ("v", 0, "x", "125", "Name")],
    [("t", 0, None, None, None)],
]


def _rerun(spark, sf_dir):
    rows = cases(spark, sf_dir, "what string, turn int, text string, form string, field string", _SESSIONS).withColumnRenamed("doc", "session")
    of = lambda what: rows.filter(F.col("what") == what)
    named = lambda what: of(what).select("session", "form", "field", F.col("text").alias("value"))
    out = R.rerun(of("m").select("session", "turn", "text"), of("t"), named("c"), named("v"), ["Name", "City"])
    return out.withColumnRenamed("session", "doc")


known_rows("session_rerun", "Z08.", ["text", "turns", "corrected", "status"], [[("first\nsecond", 2, 1, "complete")], [("", 1, 1, "awaiting_info")], [], [(None, 0, 0, "awaiting_info")]], _rerun)

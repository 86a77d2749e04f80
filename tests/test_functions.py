"""Edge values of the comparison, check and source functions."""

import json

import pytest
from pyspark.sql import functions as F

from tessera.functions import checks, compare, text
from tessera.sources import files


@pytest.mark.parametrize(
    ("field", "value", "want"),
    [
        ("InsuredIndicator", "☑", "true"),
        ("chkBox", "Off", "false"),
        ("GenderCode", "N", "n"),
        ("LossCode", "Yes", "true"),
        ("StartDate", "1-15-2024", "2024-01-15"),
        ("StartDate", "13/04/2022", "2022-04-13"),
        ("StartDate", "March 5, 1999", "1999-03-05"),
        ("StartDate", "01/02/70", "1970-01-02"),
        ("StartDate", "02/19/150", "02/19/150"),
        ("UpdateNote", "1-15-2024", "1-15-2024"),
        ("EffectiveTime", "9:30", "0930"),
        ("LimitAmount", "$1,000.00", "1000"),
        ("LimitAmount", "none", "none"),
        ("EmailAddress", "A @B com", "a@b.com"),
        ("AddressLineOne", "12 N. Main St.", "12 north main street"),
        ("Name", "  Bob ", "bob"),
        ("Name", None, ""),
    ],
)
def test_comparable(spark, field, value, want):
    df = spark.createDataFrame([(field, value)], "f string, v string")
    assert df.select(compare.comparable(F.col("v"), F.col("f")).alias("x")).first().x == want


@pytest.mark.parametrize(("a", "b", "want"), [("53731", "wi 53731", "matched"), ("y", "true", "matched"), ("abc", "abcd", "partial"), ("abc", "x", "wrong"), ("abc", "", "missing"), ("", "x", None)])
def test_status(spark, a, b, want):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert df.select(compare.status(F.col("a"), F.col("b")).alias("x")).first().x == want


def test_vin(spark):
    df = spark.createDataFrame([("1M8GDM9AXKP042788",), ("1M8GDM9A1KP042788",), ("SHORT",)], "v string")
    assert [r.x for r in df.select(checks.vin_valid(F.col("v")).alias("x")).collect()] == [True, False, False]


def test_fusion_ties(spark):
    from tessera.operators import fusion

    rows = [("f", "semantic", "A-1", 0.8, 2), ("f", "template", "B", 0.9, 1), ("f", "vision", "a1", 0.8, 3), ("g", "vision", " ", None, 1), ("g", "nowhere", "z", None, 2)]
    df = spark.createDataFrame(rows, "field string, source string, value string, confidence double, ord int")
    got = {r.field: (r.value, r.source, r.confidence, r.agreement) for r in fusion.fuse(fusion.weighted(df), ["field"]).collect()}
    assert got == {"f": ("B", "template", 0.9, 1), "g": ("z", "nowhere", 0.5, 1)}


def test_numbers_and_ticks(spark):
    df = spark.createDataFrame([("$4.2M", "x"), ("500k", None), ("n/a", "Off")], "n string, b string")
    assert [(r.n, r.b) for r in df.select(text.plain_number(F.col("n")).alias("n"), text.tick(F.col("b")).alias("b")).collect()] == [(4200000, "1"), (500000, "Off"), (None, "Off")]


def test_sources(spark, tmp_path):
    folder = tmp_path / "form_163"
    folder.mkdir()
    (folder / "doc_1.json").write_text(json.dumps({"Name": "Bob", "_meta": "x", "Nested": {"a": 1}, "Box": True}))
    got = {(r.doc_id, r.form, r.field, r.value) for r in files.ground_truth(spark, str(folder)).collect()}
    assert got == {("doc_1", "163", "Name", "Bob"), ("doc_1", "163", "Box", "true")}
    (tmp_path / "catalog.json").write_text(json.dumps({"form_number": "125", "fields": {"A": {"type": "text", "tooltip": "t", "category": None}}}))
    row = files.field_catalog(spark, str(tmp_path / "catalog.json")).first()
    assert (row.form, row.field, row.category, row.page) == ("125", "A", "general", 0)
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n{"a": 2}\n')
    (tmp_path / "b.jsonl").write_text(' {"a": 2}\n\n')
    assert files.merge_jsonl(spark, [str(tmp_path / "a.jsonl"), str(tmp_path / "b.jsonl")]).count() == 2


def test_points_on_edges(spark):
    from tessera.operators import spatial

    points = spark.createDataFrame([(1, 200, 200), (1, 199, 200), (1, 401, 400), (2, 200, 200)], "page int, x int, y int")
    regions = spark.createDataFrame([(1, "r", 200, 200, 400, 400)], "page int, field string, x_min int, y_min int, x_max int, y_max int")
    assert [(r.x, r.y) for r in spatial.points_in_regions(points, regions).collect()] == [(200, 200)]


def test_templates_and_label_maps(spark, tmp_path):
    box = {"page": 1, "x_min": 1, "y_min": 2, "x_max": 3, "y_max": 4}
    (tmp_path / "t.json").write_text(json.dumps({"form_type": "125", "regions": [{"field_name": "A", "field_type": "text", **box}]}))
    (tmp_path / "empty.json").write_text(json.dumps({"form_type": "127", "template_dpi": 200, "regions": []}))
    rows = [(r.form, r.dpi, r.field_name, r.x_max) for r in files.region_template(spark, str(tmp_path)).collect()]
    assert rows == [("125", 300, "A", 3.0)]
    maps = tmp_path / "maps"
    maps.mkdir()
    (maps / "m.json").write_text(json.dumps({"form_type": "125", "mappings": {"agency": [{"field_name": "A", "match_confidence": 0.9, "seen_count": 2}, {"field_name": "B"}], "none": []}}))
    found = {(r.label, r.field_name, r.match_confidence, r.seen_count) for r in files.label_map(spark, str(maps)).collect()}
    assert found == {("agency", "A", 0.9, 2), ("agency", "B", None, None)}


def test_bundles_and_stores(spark, tmp_path):
    rows = spark.createDataFrame([("a", "x", 1), ("b", "y", 2)], "id string, stage string, n int")
    files.write_bundle(rows, str(tmp_path / "out"))
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if p.is_dir()) == ["stage=x", "stage=y"]
    assert {(r.id, r.stage, r.n) for r in spark.read.json(str(tmp_path / "out")).collect()} == {("a", "x", 1), ("b", "y", 2)}
    new = spark.createDataFrame([("b", "z", 3), ("c", "y", 4)], rows.schema)
    assert {tuple(r) for r in files.upsert(rows, new, "id").collect()} == {("a", "x", 1), ("b", "z", 3), ("c", "y", 4)}
    assert [r.id for r in files.not_done(new, rows, "id").collect()] == ["c"]

"""Steps that must not grow faster than their tables."""

import datetime

from pyspark.sql import functions as F


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_days_are_told_without_a_failing_parser(spark):
    """A parser or a cast raises an exception for each text that is no day or number."""
    from tessera.functions.compare import iso_date, whole
    from tessera.functions.values import ocr_date, strict_date, us_date

    texts = ["02/29/2000", "2/29/1900", "2-29-2023", "2024-2-29", "4/31/2024", "12/31/9999", "0000-02-29", "13/1/2024", "1/5/69", "1/5/68", "", "soon", "1/0/2024", None]
    want = []
    for t in texts:
        y, m, d = {"02/29/2000": (2000, 2, 29), "2024-2-29": (2024, 2, 29), "12/31/9999": (9999, 12, 31), "1/5/69": (1969, 1, 5), "1/5/68": (2068, 1, 5)}.get(t, (None,) * 3)
        want.append(datetime.date(y, m, d) if y else None)
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts) if t != "0000-02-29"], "i int, t string")
    got = {r.i: r.d for r in rows.select("i", strict_date(F.col("t")).alias("d")).collect()}
    assert [got[i] for i in sorted(got)] == [w for t, w in zip(texts, want) if t != "0000-02-29"]
    assert spark.createDataFrame([("0000-02-29",)], "t string").select(strict_date(F.col("t")).cast("string")).first()[0] == "0000-02-29"
    for f in (strict_date, iso_date, us_date):
        assert "gettimestamp" not in plan(rows.select(f(F.col("t"))))
    assert plan(rows.select(ocr_date(F.col("t")))).count("gettimestamp") == 1  # written-out months, where the text has one
    numbers = spark.createDataFrame([(v,) for v in (" 12 ", "-3", "+4", "1.5", "", "x", "99999999999", None)], "t string")
    assert [r[0] for r in numbers.select(whole(F.col("t"))).collect()] == [12, -3, 4, None, None, None, None, None]


def test_known_cases_are_dealt_by_document(spark, data, monkeypatch):
    """A task's share stays the same however many documents there are."""
    from tessera.plans import form_views, known

    monkeypatch.setattr(known, "DOCS", 10)
    rows = known.cases(spark, data, "v string", [[("a",)], [("b",), (None,)]])
    docs = spark.read.parquet(f"{data}/customer.parquet").count()
    assert rows.rdd.getNumPartitions() == -(-docs // 10) > 4
    gaps = plan(form_views._form(spark, data).groupBy("doc").count())
    assert gaps.count("Exchange") == 1  # the deal by document serves the groups


def test_a_record_meets_its_catalog_without_a_shuffle_by_field(spark):
    from tessera.operators.normalise import normalise_record

    rows = spark.createDataFrame([(1, "City", "Bonn")], "doc long, field string, value string").repartition(4, "doc")
    catalog = spark.createDataFrame([("City", "text", None, None)], "field string, kind string, default_value string, width double")
    assert "hashpartitioning(field" not in plan(normalise_record(rows, catalog))


def most_joined(df) -> int:
    """The most rows that any join of df's plan gave, once run."""
    df.collect()
    most, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        p = todo.pop()
        kind = p.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(p.executedPlan())
        elif kind.endswith("QueryStageExec"):
            todo.append(p.plan())
        else:
            of = p.children()
            todo += [of.apply(i) for i in range(of.size())]
        if "Join" in kind:
            most = max(most, p.metrics().get("numOutputRows").get().value())
    return most


CROWD = 300


def crowd(spark):
    """CROWD points on three places of a page and CROWD regions of two shapes; the first holds two of the places."""
    places, shapes = [(10, 10), (15, 12), (500, 500)], [(0, 0, 40, 40), (480, 490, 520, 530)]
    points = spark.createDataFrame([(1, *places[i % 3], i, f"t{i:03d}") for i in range(CROWD)], "page int, x int, y int, ord long, text string")
    regions = spark.createDataFrame([(i, 1, *shapes[i % 2]) for i in range(CROWD)], "field int, page int, x_min int, y_min int, x_max int, y_max int")
    return points, regions


def test_crowded_regions_meet_places_and_shapes(spark):
    from tessera.operators import spatial as S

    points, regions = crowd(spark)
    held = S.totals_in_regions(S.dealt(points, 4), regions, [F.count("*").alias("n"), F.min("ord").alias("o")], [F.sum("n").alias("n"), F.min("o").alias("o")])
    assert {(r.field % 2, r.n, r.o) for r in held.collect()} == {(0, 200, 0), (1, 100, 2)} and held.count() == CROWD
    assert most_joined(held) == CROWD
    small = S.recover_small_fields(S.dealt(points, 4), regions)
    assert {(r.field % 2, r.text) for r in small.collect()} == {(0, "t001"), (1, "t002")} and small.count() == CROWD
    assert most_joined(small) == CROWD


def test_typed_regions_walk_the_points_of_a_cell(spark):
    from tessera.operators import spatial as S

    points, regions = crowd(spark)
    kinds = F.element_at(F.array(*map(F.lit, ["text", "number", "checkbox", "date", "other"])), (F.col("field") % 5 + 1).cast("int"))
    picked = S.typed_pick(S.dealt(points.withColumn("confidence", F.lit(1.0)), 4), regions.withColumn("field_type", kinds))
    got = {(r.field % 10, r.value) for r in picked.collect()}
    assert got == {(0, "t000"), (5, "t002"), (6, "000"), (1, "002"), (2, "Off"), (7, "Off"), (8, None), (3, None), (4, None), (9, None)}
    assert most_joined(picked) == CROWD
    mixed = spark.createDataFrame([(1, 5, 5, 2, "AB-12345 on 1/2/2024", 0.5), (1, 6, 6, 1, "12345", 0.9), (1, 7, 7, 3, " X ", 0.9), (1, 8, 8, 0, None, 0.9)], "page int, x int, y int, ord long, text string, confidence double")
    types = ["date", "naic", "policy_number", "checkbox", "text", "number"]
    box = spark.createDataFrame([(k, 1, 0, 0, 40, 40, k) for k in types], "field string, page int, x_min int, y_min int, x_max int, y_max int, field_type string")
    want = {"date": "1/2/2024", "naic": "12345", "policy_number": "12345", "checkbox": "1", "text": "AB-12345 on 1/2/2024", "number": "12345"}
    assert {r.field: r.value for r in S.typed_pick(S.dealt(mixed, 2), box).collect()} == want


def test_overlaps_meet_shapes(spark):
    from tessera.operators import spatial as S

    _, regions = crowd(spark)
    a, b = regions.withColumnRenamed("field", "a_id"), regions.withColumnRenamed("field", "b_id")
    best = S.best_overlaps(a, b)
    assert {(r.a_id % 2, r.b_id, r.iou) for r in best.collect()} == {(0, 0, 1.0), (1, 1, 1.0)} and best.count() == CROWD
    assert most_joined(best) == CROWD


def test_anchors_meet_places(spark):
    from tessera.operators import spatial as S

    anchors = spark.createDataFrame([(1, i, i % 2, 0) for i in range(CROWD)] + [(2, 0, 0, 0)], "page int, anchor int, x int, y int")
    blocks = spark.createDataFrame([(1, 3 + i % 2 * 9, 4) for i in range(CROWD)] + [(2, 499, 1)], "page int, x int, y int")
    shift = S.anchor_offsets(anchors, blocks, ["page"])
    assert shift.collect() == [(1, 2.5, 4.0, CROWD)]
    assert most_joined(shift) <= CROWD + 1


def test_texts_with_a_common_beginning_do_not_meet(spark):
    """A join by what all texts share grows with their square, and runs must not be broadcast by their texts' size."""
    from tessera.operators import labels

    left = spark.createDataFrame([(1, i, f"Supplier#{i:09d}") for i in range(0, 9000, 30)], "g int, id int, text string")
    right = spark.createDataFrame([(1, i, f"Customer#{i:09d}") for i in range(0, 9000, 20)], "g int, id int, text string")
    met = labels.match_candidates(left, right, "g")
    assert {(r.left_id, r.right_id) for r in met.filter(labels.value_score(F.col("left_text"), F.col("right_text")) > 0).collect()} == {(i, i) for i in range(0, 9000, 60)}
    assert most_joined(met) < 0.1 * 300 * 450
    same = labels.match_candidates(left, left.withColumn("id", -F.col("id")), "g")
    assert {(r.left_id, -r.right_id) for r in same.filter(labels.value_score(F.col("left_text"), F.col("right_text")) > 0).collect()} >= {(i, i) for i in range(0, 9000, 30)}
    keys = left.select(F.concat(F.upper("text"), F.lit(" ltd")).alias("key"))
    found = labels.reconcile_keys(keys, left.select(F.col("text").alias("name")), "key", "name")
    assert {(r.key, r.name, r.tier) for r in found.collect()} == {(f"SUPPLIER#{i:09d} ltd", f"Supplier#{i:09d}", 3) for i in range(0, 9000, 30)}
    assert most_joined(found) < 15 * 300


def test_runs_are_not_broadcast(spark, data):
    from tessera.plans import matching

    for name in ("value_match_candidates", "fuzzy_key_tiers"):
        for line in plan(getattr(matching, name)(spark, data)).splitlines():
            assert "BroadcastHashJoin" not in line or "run" not in line


def test_disjoint_runs_find_every_pair_within_edits(spark):
    import random

    from tessera.operators import labels

    rng = random.Random(3)

    def edited(t, k):
        for _ in range(k):
            i = rng.randrange(len(t) + 1)
            t = rng.choice([t[:i] + rng.choice("ab1") + t[i:], t[:i] + t[i + 1 :], t[:i] + rng.choice("ab1") + t[i + 1 :]])
        return t

    texts = ["".join(rng.choice("ab1") for _ in range(rng.randrange(1, 45))) for _ in range(120)]
    left = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "g int, id int, text string")
    right = spark.createDataFrame([(1, i, edited(t, rng.randrange(0, 7))) for i, t in enumerate(texts)], "g int, id int, text string")
    score = labels.value_score(F.col("left_text"), F.col("right_text"))
    mine = {(r.left_id, r.right_id) for r in labels.match_candidates(left, right, "g").filter(score > 0).collect()}
    every = left.select(F.col("id").alias("left_id"), F.col("text").alias("left_text")).crossJoin(right.select(F.col("id").alias("right_id"), F.col("text").alias("right_text")))
    assert mine == {(r.left_id, r.right_id) for r in every.filter((score > 0) & (F.trim("right_text") != "")).collect()}
    assert len(mine) > 60


def test_nearest_holds_the_scores_of_one_tile(monkeypatch):
    """However many queries and items a batch has; ties across tiles go to the lower id."""
    import tracemalloc

    import numpy as np
    import pandas as pd

    from tessera.operators import retrieval

    rng = np.random.default_rng(5)
    vectors = rng.integers(-2, 3, (4000, 8)).astype(float)
    vectors[7], vectors[9] = 0, np.nan
    names = rng.permutation(4000)
    batches = [pd.DataFrame({"item_id": names[a : a + 2000], "vector": list(vectors[a : a + 2000])}) for a in (0, 2000)]
    asked = rng.integers(-2, 3, (3000, 8)).astype(float) + 0.5
    ids = np.arange(3000) * 2
    for k, least in ((5, None), (1, 0.3), (3, 0.97)):
        tracemalloc.start()
        got = pd.concat(list(retrieval._scores(asked, ids, k, least)(iter(batches))))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 60e6  # 28 MB; when all of a batch was scored at once it was 200
        with np.errstate(invalid="ignore"):
            s = np.round((asked / np.linalg.norm(asked, axis=1, keepdims=True)) @ (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)).T, 6)
        for q in range(0, 3000, 97):
            best = sorted((-v, i) for v, i in zip(s[q], names) if np.isfinite(v) and (least is None or v >= least))[:k]
            mine = got[got.query_id == q * 2]
            assert sorted(zip(-mine.score, mine.item_id)) == best


def test_candidates_are_shuffled_once(spark, data, monkeypatch):
    """Dealt by part in shares of lines, which serves the groups by part."""
    from tessera.plans import scoring

    monkeypatch.setattr(scoring, "LINES", 500)
    lines = spark.read.parquet(f"{data}/lineitem.parquet").count()
    for query in (scoring.fuse_candidates, scoring.fusion_disagreements):
        p = plan(query(spark, data))
        assert p.count("Exchange hashpartitioning") == 1 and f", {-(-lines // 500)})" in p


def test_gaps_are_told_in_one_group(spark):
    from tessera.operators import rules

    rows = spark.createDataFrame([(1, "A", "x"), (1, "A", " "), (1, "B", " "), (1, "C", "y"), (2, "B", None)], "doc long, field string, value string")
    issues = spark.createDataFrame([(1, "C", "r", "error"), (1, "A", "r", "info"), (1, "B", "r", "error")], "doc long, field string, rule string, severity string")
    gaps = rules.gaps(rows, issues, spark.createDataFrame([("A",), ("B",), ("C",)], "field string"))
    assert sorted(map(tuple, gaps.collect())) == [(1, "A", "ok"), (1, "B", "missing"), (1, "C", "invalid"), (2, "A", "missing"), (2, "B", "missing"), (2, "C", "missing")]
    assert "SortMergeJoin" not in plan(gaps)

"""Every query of the engine against its SQL, and the ones without SQL against a model."""

import pytest
from pyspark.sql import functions as F

from tessera.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_agrees_with_sql(name, same):
    same(catalog.QUERIES[name], catalog.ORACLES[name])


def test_every_oracle_has_a_query():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_entry_without_llm(monkeypatch):
    """The entry module imports where the llm package is gone."""
    import importlib
    import sys

    import __spark_entry__

    real = importlib.import_module

    def gone(name, *a):
        if name.startswith("tessera.llm") or name == "corpus_pipeline":
            raise ModuleNotFoundError(f"No module named {name!r}", name="tessera.llm")
        return real(name, *a)

    monkeypatch.setattr(importlib, "import_module", gone)
    sys.modules.pop("__spark_entry__")
    fresh = real("__spark_entry__")
    assert not any(n.startswith("op") for n in fresh.queries())
    sys.modules["__spark_entry__"] = __spark_entry__


def test_greedy_assignment_model(spark, data):
    from tessera.plans.matching import _pairs, greedy_assignment

    pairs = [r.asDict() for r in _pairs(spark, data).collect()]
    want, used = set(), set()
    for p in sorted(pairs, key=lambda p: (p["nation"], -p["score"], p["s_suppkey"], p["c_custkey"])):
        a, b = ("s", p["nation"], p["s_suppkey"]), ("c", p["nation"], p["c_custkey"])
        if a not in used and b not in used:
            used |= {a, b}
            want.add((p["nation"], p["s_suppkey"], p["c_custkey"]))
    assert {(r.nation, r.s_suppkey, r.c_custkey) for r in greedy_assignment(spark, data).collect()} == want


def test_nearest_meets_queries_in_blocks(spark, data, monkeypatch):
    from tessera.operators import retrieval

    rows = spark.read.parquet(f"{data}/embeddings.parquet").select("vec_id", F.col("embedding").alias("vector"))
    asked, items = rows.filter("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id"), rows.withColumnRenamed("vec_id", "item_id")
    want = sorted(retrieval.nearest(asked, items, 3).collect())
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 4)
    got = retrieval.nearest(asked, items, 3)
    assert sorted(got.collect()) == want and len(want) == 3 * asked.count()
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    blocks = {r.query_id: r.b for r in asked.select("query_id", F.pmod(F.xxhash64("query_id"), F.lit(-(-asked.count() // 4))).alias("b")).collect()}
    assert plan.count("MapInPandas") == len(set(blocks.values())) > 1


def test_containment_at_any_position(spark):
    from tessera.plans.matching import holders

    long = "Some Passage of a benchmark"
    texts = [long, f"x\u201c{long}", f"a\u00a0{long}.", f"in({long})", f"pre{long}", "he said:Tiny one", "some passage of another", None, "", "\U0001f600" + long]
    items = [(1, long), (2, "tiny"), (3, None), (4, "\U0001f600s")]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    b = spark.createDataFrame(items, "item_id int, text string")
    want = {(i, k) for i, t in enumerate(texts) for k, x in items if t is not None and x is not None and x.lower() in t.lower()}
    assert {(r.doc_id, r.item_id) for r in holders(d, b).collect()} == want and len(want) == 8
    empty = holders(d, spark.createDataFrame([(9, "")], b.schema)).collect()
    assert {r.doc_id for r in empty} == set(range(len(texts))) - {7}
    assert holders(d, b.limit(0)).count() == 0


def test_nearest_right_model(spark, data):
    from tessera.plans.spatial_views import blocks, nearest_right_pairs

    pages = {}
    for r in blocks(spark, data).collect():
        pages.setdefault(r.page, []).append(r)
    want = set()
    for page, rows in pages.items():
        taken = set()
        for label in sorted((r for r in rows if r.ord % 2 == 1), key=lambda r: r.ord):
            near = [v for v in rows if v.ord % 2 == 0 and v.ord not in taken and abs(v.y - label.y) <= 30 and 0 < v.x - label.x <= 300]
            if near:
                best = min(near, key=lambda v: (v.x, v.ord))
                taken.add(best.ord)
                want.add((page, label.ord, best.ord))
    assert {(r.page, r.ord, r.value_ord) for r in nearest_right_pairs(spark, data).collect()} == want


def test_text_chunks_model(spark, data):
    from tessera.plans.matching import text_chunks

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    by_doc = {}
    for r in text_chunks(spark, data).collect():
        assert r.content == texts[r.doc_id][r.start : r.stop]
        by_doc.setdefault(r.doc_id, []).append((r.start, r.stop))
    for doc_id, spans in by_doc.items():
        spans.sort()
        assert spans[0][0] == 0 and spans[-1][1] == len(texts[doc_id])
        for (_, stop), (start, _) in zip(spans, spans[1:]):
            assert start == stop - 50
        assert all(0 < stop - start <= 500 for start, stop in spans)


def test_match_candidates_lose_no_scoring_pair(spark):
    """Every pair that value_score scores over 0, by brute force over texts of a small alphabet."""
    import numpy as np

    from tessera.operators import labels

    rng = np.random.default_rng(5)
    base = ["".join(rng.choice(list("abc01"), int(rng.integers(1, 24)))) for _ in range(40)]
    texts = []
    for t in base:
        for _ in range(3):
            x = list(t)
            for _ in range(int(rng.integers(0, 4))):
                i = int(rng.integers(0, len(x) + 1))
                x[i : i + int(rng.integers(0, 2))] = list(rng.choice(list("abc01"), int(rng.integers(0, 2))))
            a, b = sorted(rng.integers(0, len(t) + 1, 2))
            texts += ["".join(x), t[a:b]]
    rows = [(int(rng.integers(2)), i, t) for i, t in enumerate(texts)] + [(0, 9998, None), (1, 9999, "")]
    left, right = (spark.createDataFrame(r, "g int, id int, text string") for r in (rows[::2], rows[1::2]))
    score = labels.value_score(F.col("left_text"), F.col("right_text"))
    mine = labels.match_candidates(left, right, "g").select("left_id", "right_id", score.alias("s")).filter("s > 0").collect()
    every = left.select("g", F.col("id").alias("left_id"), F.col("text").alias("left_text")).join(right.select("g", F.col("id").alias("right_id"), F.col("text").alias("right_text")), "g")
    want = every.filter("left_text <> '' AND right_text <> ''").select("left_id", "right_id", score.alias("s")).filter("s > 0").collect()
    assert len(mine) == len(set(mine)) and set(mine) == set(want) and len(want) > 100


@pytest.mark.parametrize("size", [7, 10**6])
def test_numbered_in_buckets_equals_one_window(spark, size):
    from pyspark.sql import Window

    from tessera.operators.ordering import numbered

    rows = spark.range(300).select(F.when(F.col("id") % 10 > 0, F.col("id") % 2).alias("g"), (F.col("id") * 7919 % 53).alias("k"), "id").repartition(5)
    w = Window.partitionBy("g").orderBy("k", "id")
    want = rows.select("id", F.row_number().over(w).alias("position"), F.count("*").over(Window.partitionBy("g")).alias("group_size"), F.sum("id").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("used"))
    got = numbered(rows, ["g"], "k", ["id"], F.col("id"), size).select("id", "position", "group_size", "used")
    assert sorted(got.collect()) == sorted(want.collect())


@pytest.mark.parametrize("text", ["", "a", "x" * 1200, "word " * 400, "one. two! " * 90, "\n".join(["line of it"] * 120)])
def test_chunk_spans(text):
    from tessera.operators.retrieval import spans

    found = spans(text, 500, 50)
    assert "".join(text[a + (50 if i else 0) : b] for i, (a, b) in enumerate(found)) == text
    assert all(0 < b - a <= 500 for a, b in found)


def test_nearest_without_vectors(spark):
    from tessera.operators import retrieval

    q = spark.createDataFrame([(1, None), (2, [0.0, 1.0])], "query_id long, vector array<double>")
    items = spark.createDataFrame([(1, None), (2, [0.0, 0.0]), (3, [0.0, 2.0]), (4, [1.0, 0.0])], "item_id long, vector array<double>")
    assert sorted(retrieval.nearest(q, items, 5).collect()) == [(2, 3, 1.0, 1), (2, 4, 0.0, 2)]
    assert retrieval.nearest(q.limit(0), items, 5).count() == 0 == retrieval.nearest(q, items.limit(0), 5).count()


def test_field_state_goes_on_after_a_restart(spark, tmp_path):
    """Update mode: two runs over the same checkpoint, later rows and late ones too, give what one batch gives."""
    from tessera.streaming import state

    schema = "user_id long, event_id long, ts timestamp, value double"
    parts = [[(1, 1, "2024-01-01 00:00:00", 1.0), (2, 2, "2024-01-01 01:00:00", 2.0)], [(1, 3, "2024-01-02 00:00:00", 3.0), (3, 4, "2023-12-01 00:00:00", 4.0), (2, 5, "2023-12-31 00:00:00", 9.0)]]
    source, base = str(tmp_path / "in"), f"file://{tmp_path}/state"
    rows = []
    for part in parts:
        frame = spark.createDataFrame(part, "user_id long, event_id long, ts string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
        frame.write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        rows.append(sorted(tuple(r) for r in state.upsert_to_table(state.state_stream(stream, ["user_id"], F.lit(0)), ["user_id"], base).select("user_id", "event_id", "value", "updates").collect()))
    assert rows == [[(1, 1, 1.0, 1), (2, 2, 2.0, 1)], [(1, 3, 3.0, 2), (2, 2, 2.0, 2), (3, 4, 4.0, 1)]]


def test_closed_sessions_come_out_and_late_rows_do_not(spark, tmp_path):
    """Append mode: a session comes out once the watermark has passed it; what comes after that is dropped."""
    from tessera.streaming import state

    source = str(tmp_path / "in")
    for i, times in enumerate([["2024-01-01 00:00:00", "2024-01-01 00:30:00"], ["2024-01-01 12:00:00"], ["2024-01-01 13:30:00"], ["2024-01-01 00:10:00", "2024-01-02 12:00:00"]]):
        spark.createDataFrame([(1, t) for t in times], "user_id long, ts string").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.parquet(f"{source}/part={i}")
    stream = spark.readStream.schema("user_id long, ts timestamp, part int").option("maxFilesPerTrigger", 1).parquet(source)
    out = str(tmp_path / "out")
    query = state.session_stream(stream, "user_id", "ts").writeStream.outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).format("parquet").start(out)
    query.awaitTermination()
    assert [(str(r.started), r.events) for r in spark.read.parquet(out).orderBy("started").collect()] == [("2024-01-01 00:00:00", 2), ("2024-01-01 12:00:00", 1), ("2024-01-01 13:30:00", 1)]

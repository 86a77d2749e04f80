"""Page geometry over the driver tables: numeric columns stand for coordinates, orders for pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import spatial as S
from tessera.plans.registry import query
from tessera.plans.session import table

_POINTS = "pt AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (l_partkey % 5)::INT AS page, (l_extendedprice::BIGINT % 2550) AS x, ((l_partkey * 37 + l_suppkey * 11) % 3300) AS y FROM lineitem)"
_REGIONS = "rg AS (SELECT p_partkey AS field, (p_partkey % 5)::INT AS page, (p_partkey * 13) % 2400 AS x_min, (p_partkey * 29) % 3200 AS y_min, (p_partkey * 13) % 2400 + 20 + p_size AS x_max, (p_partkey * 29) % 3200 + 15 + p_size AS y_max FROM part)"


def points(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        (F.col("l_partkey") % 5).cast("int").alias("page"),
        (F.round("l_extendedprice").cast("long") % 2550).alias("x"),
        ((F.col("l_partkey") * 37 + F.col("l_suppkey") * 11) % 3300).alias("y"),
    )


def regions(spark, sf_dir):
    k = F.col("p_partkey")
    x, y = (k * 13) % 2400, (k * 29) % 3200
    return table(spark, sf_dir, "part").select(k.alias("field"), (k % 5).cast("int").alias("page"), x.alias("x_min"), y.alias("y_min"), (x + 20 + F.col("p_size")).alias("x_max"), (y + 15 + F.col("p_size")).alias("y_max"))


def _shares(spark, sf_dir, each=200_000):
    """Of about so many line items."""
    return -(-table(spark, sf_dir, "lineitem").count() // each) or 1


@query("point_in_region", f"WITH {_POINTS.replace('l_extendedprice::BIGINT', 'round(l_extendedprice)::BIGINT')}, {_REGIONS} SELECT field, count(*) AS blocks, min(l_orderkey) AS first_order FROM pt JOIN rg ON pt.page = rg.page AND x BETWEEN x_min AND x_max AND y BETWEEN y_min AND y_max GROUP BY 1")
def point_in_region(spark, sf_dir):
    first, again = [F.count("*").alias("blocks"), F.min("l_orderkey").alias("first_order")], [F.sum("blocks").alias("blocks"), F.min("first_order").alias("first_order")]
    held = S.totals_in_regions(S.dealt(points(spark, sf_dir), _shares(spark, sf_dir)), regions(spark, sf_dir), first, again)
    return held.groupBy("field").agg(*again)


@query(
    "iou_best",
    f"""WITH {_REGIONS}, m AS (SELECT a.field AS a_id, b.field AS b_id,
 greatest(0, least(a.x_max, b.x_max) - greatest(a.x_min, b.x_min)) * greatest(0, least(a.y_max, b.y_max) - greatest(a.y_min, b.y_min)) AS i,
 (a.x_max - a.x_min) * (a.y_max - a.y_min) + (b.x_max - b.x_min) * (b.y_max - b.y_min) AS s FROM rg a JOIN rg b ON a.page = b.page AND a.field % 2 = 0 AND b.field % 2 = 1),
r AS (SELECT a_id, b_id, round(i / (s - i), 6) AS iou FROM m WHERE i > 0), k AS (SELECT *, row_number() OVER (PARTITION BY a_id ORDER BY iou DESC, b_id) AS n FROM r WHERE iou >= 0.05)
SELECT a_id, b_id, iou FROM k WHERE n = 1""",
)
def iou_best(spark, sf_dir):
    boxes = regions(spark, sf_dir)
    a, b = (boxes.filter(F.col("field") % 2 == r).withColumnRenamed("field", n) for r, n in ((0, "a_id"), (1, "b_id")))
    return S.best_overlaps(a, b, 0.05)


@query(
    "anchor_offset",
    """WITH m AS (SELECT s_nationkey AS page, s_suppkey AS anchor, (c_custkey % 97 - s_suppkey % 89)::DOUBLE AS dx, (c_custkey % 53 - s_suppkey % 31)::DOUBLE AS dy FROM supplier JOIN customer ON s_nationkey = c_nationkey),
n AS (SELECT *, row_number() OVER (PARTITION BY page, anchor ORDER BY abs(dx) + abs(dy), dx, dy) AS k FROM m WHERE abs(dx) + abs(dy) < 500)
SELECT page, median(dx) AS dx, median(dy) AS dy, count(*) AS anchors FROM n WHERE k = 1 GROUP BY 1""",
)
def anchor_offset(spark, sf_dir):
    s, c = F.col("s_suppkey"), F.col("c_custkey")
    anchors = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("page"), s.alias("anchor"), (s % 89).alias("x"), (s % 31).alias("y"))
    return S.anchor_offsets(anchors, table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("page"), (c % 97).alias("x"), (c % 53).alias("y")), ["page"])


_BLOCKS = "b AS (SELECT l_orderkey AS page, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)::BIGINT AS ord, round(l_extendedprice)::BIGINT % 300 AS y, (l_partkey * 17) % 2550 AS x FROM lineitem)"


def blocks(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), F.row_number().over(w).cast("long").alias("ord"), (F.round("l_extendedprice").cast("long") % 300).alias("y"), ((F.col("l_partkey") * 17) % 2550).alias("x"))


@query("row_cluster_gap", f"WITH {_BLOCKS}, o AS (SELECT *, CASE WHEN y - lag(y) OVER w < 15 THEN 0 ELSE 1 END AS opens FROM b WINDOW w AS (PARTITION BY page ORDER BY y, x, ord)) SELECT page, ord, sum(opens) OVER (PARTITION BY page ORDER BY y, x, ord)::BIGINT AS row FROM o")
def row_cluster_gap(spark, sf_dir):
    return S.rows_by_previous(blocks(spark, sf_dir), ["page"], 15).select("page", "ord", "row")


@query(
    "row_cluster_mean",
    f"""WITH RECURSIVE {_BLOCKS}, s AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY y, ord) AS n FROM b),
w AS (SELECT page, ord, n, y::DOUBLE AS total, 1 AS k, 1 AS row FROM s WHERE n = 1
 UNION ALL SELECT s.page, s.ord, s.n, CASE WHEN abs(s.y - w.total / w.k) <= 25 THEN w.total + s.y ELSE s.y END, CASE WHEN abs(s.y - w.total / w.k) <= 25 THEN w.k + 1 ELSE 1 END,
 CASE WHEN abs(s.y - w.total / w.k) <= 25 THEN w.row ELSE w.row + 1 END FROM w JOIN s ON s.page = w.page AND s.n = w.n + 1)
SELECT page, ord, row FROM w""",
)
def row_cluster_mean(spark, sf_dir):
    return S.rows_by_mean(blocks(spark, sf_dir), ["page"], 25)


@query("bbox_union", f"WITH {_REGIONS} SELECT page, field % 10 AS grp, greatest(0, min(x_min) - 15) AS x_min, greatest(0, min(y_min) - 15) AS y_min, max(x_max) + 15 AS x_max, max(y_max) + 15 AS y_max, count(*) AS blocks FROM rg GROUP BY 1, 2")
def bbox_union(spark, sf_dir):
    return S.union_boxes(regions(spark, sf_dir).withColumn("grp", F.col("field") % 10), ["page", "grp"], 15)


@query(
    "table_cells",
    f"""WITH {_BLOCKS}, c AS (SELECT page, (y // 100)::BIGINT AS row, (x // 850)::BIGINT AS "column", y, x, ord FROM b)
SELECT page, row, "column", string_agg(ord::VARCHAR, ' ' ORDER BY y, x, ord) AS text FROM c GROUP BY 1, 2, 3""",
)
def table_cells(spark, sf_dir):
    b = blocks(spark, sf_dir).withColumn("text", F.col("ord").cast("string"))
    pages = b.select("page").distinct()
    rows = pages.select("page", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))).alias("row")).select("page", "row", (F.col("row") * 100).alias("top"), (F.col("row") * 100 + 99).alias("bottom"))
    columns = pages.select("page", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))).alias("column")).select("page", "column", (F.col("column") * 850).alias("left"), (F.col("column") * 850 + 849).alias("right"))
    return S.cells(rows, columns, b, ["page"], slack=0)


@query(
    "column_nearest",
    f"""WITH {_BLOCKS}, h(header, header_x) AS (VALUES ('a', 200), ('b', 900), ('c', 1000), ('d', 2200)),
m AS (SELECT page, ord, header, row_number() OVER (PARTITION BY page, ord ORDER BY abs(x - header_x), header) AS k FROM b CROSS JOIN h WHERE abs(x - header_x) < 150) SELECT page, ord, header FROM m WHERE k = 1""",
)
def column_nearest(spark, sf_dir):
    b = blocks(spark, sf_dir)
    headers = F.array(*[F.struct(F.lit(n).alias("header"), F.lit(x).alias("header_x")) for n, x in (("a", 200), ("b", 900), ("c", 1000), ("d", 2200))])
    return S.nearest_column(b, b.select("page").distinct().select("page", F.inline(headers)), ["page"])


@query(
    "asof_sections",
    """WITH a AS (SELECT user_id, ts, 'S' || min(event_id) AS section FROM events WHERE event_type = 'signup' GROUP BY 1, 2),
f AS (SELECT user_id, arg_min(section, ts) AS first_section FROM a GROUP BY 1), e AS (SELECT * FROM events WHERE event_type <> 'signup')
SELECT e.user_id, e.event_id AS ord, coalesce(a.section, f.first_section, 'full_page') AS section FROM e ASOF LEFT JOIN a ON e.user_id = a.user_id AND e.ts >= a.ts LEFT JOIN f ON f.user_id = e.user_id""",
)
def asof_sections(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumnRenamed("ts", "y")
    anchors = events.filter("event_type = 'signup'").groupBy("user_id", "y").agg(F.concat(F.lit("S"), F.min("event_id").cast("string")).alias("section"))
    found = S.asof_sections(events.filter("event_type <> 'signup'").withColumnRenamed("event_id", "ord"), anchors, ["user_id"])
    return found.select("user_id", "ord", "section")


@query("nearest_right_pairs")
def nearest_right_pairs(spark, sf_dir):
    return S.nearest_right(blocks(spark, sf_dir).withColumn("is_label", F.col("ord") % 2 == 1), "page")


@query(
    "row_cluster_midpoint",
    f"""WITH RECURSIVE {_BLOCKS}, s AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY y, ord) AS n FROM b),
w AS (SELECT page, ord, n, y::DOUBLE AS anchor, 1 AS row FROM s WHERE n = 1
 UNION ALL SELECT s.page, s.ord, s.n, CASE WHEN abs(s.y - w.anchor) <= 35 THEN (w.anchor + s.y) / 2 ELSE s.y END, CASE WHEN abs(s.y - w.anchor) <= 35 THEN w.row ELSE w.row + 1 END
 FROM w JOIN s ON s.page = w.page AND s.n = w.n + 1) SELECT page, ord, row FROM w""",
)
def row_cluster_midpoint(spark, sf_dir):
    return S.rows_by_midpoint(blocks(spark, sf_dir), ["page"])


@query(
    "column_cluster",
    f"""WITH RECURSIVE {_BLOCKS}, s AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY x, ord) AS n FROM b),
w AS (SELECT page, ord, n, x::DOUBLE AS seed, 1 AS col FROM s WHERE n = 1
 UNION ALL SELECT s.page, s.ord, s.n, CASE WHEN s.x - w.seed <= 40 THEN w.seed ELSE s.x END, CASE WHEN s.x - w.seed <= 40 THEN w.col ELSE w.col + 1 END
 FROM w JOIN s ON s.page = w.page AND s.n = w.n + 1),
c AS (SELECT *, count(*) OVER (PARTITION BY page, col) AS k FROM w) SELECT page, ord, col AS "column" FROM c WHERE k >= 2""",
)
def column_cluster(spark, sf_dir):
    return S.columns_by_seed(blocks(spark, sf_dir), ["page"])


_TEXTS = "tx AS (SELECT (l_partkey % 5)::INT AS page, (round(l_extendedprice)::BIGINT % 2550) AS x, ((l_partkey * 37 + l_suppkey * 11) % 3300) AS y, l_orderkey * 10 + l_linenumber AS ord, min(l_returnflag || ' ' || l_partkey || '/' || l_linenumber || '/2024') AS text FROM lineitem GROUP BY 1, 2, 3, 4)"


def texts(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        (F.col("l_partkey") % 5).cast("int").alias("page"),
        (F.round("l_extendedprice").cast("long") % 2550).alias("x"),
        ((F.col("l_partkey") * 37 + F.col("l_suppkey") * 11) % 3300).alias("y"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"),
        F.concat("l_returnflag", F.lit(" "), F.col("l_partkey").cast("string"), F.lit("/"), F.col("l_linenumber").cast("string"), F.lit("/2024")).alias("text"),
    )
    return S.dealt(rows, _shares(spark, sf_dir)).groupBy("page", "_cx", "_cy", "x", "y", "ord").agg(F.min("text").alias("text"))


@query(
    "template_region_pick",
    f"""WITH {_TEXTS}, {_REGIONS}, h AS (SELECT field, ['text','number','checkbox','date'][1 + field % 4] AS field_type, text, ord FROM tx JOIN rg ON tx.page = rg.page AND x BETWEEN x_min AND x_max AND y BETWEEN y_min AND y_max)
SELECT field, CASE field_type WHEN 'checkbox' THEN 'Off' WHEN 'text' THEN first(text ORDER BY length(text) DESC, ord)
 WHEN 'number' THEN first(regexp_replace(text, '[^0-9.]', '', 'g') ORDER BY ord)
 ELSE first(nullif(regexp_extract(text, '([0-9]{{1,2}}[/-][0-9]{{1,2}}[/-][0-9]{{2,4}})', 1), '') ORDER BY ord) FILTER (WHERE regexp_matches(text, '([0-9]{{1,2}}[/-][0-9]{{1,2}}[/-][0-9]{{2,4}})')) END AS value FROM h GROUP BY field, field_type""",
)
def template_region_pick(spark, sf_dir):
    kinds = F.get(F.array(*map(F.lit, ["text", "number", "checkbox", "date"])), (F.col("field") % 4).cast("int"))
    return S.typed_pick(texts(spark, sf_dir).withColumn("confidence", F.lit(1.0)), regions(spark, sf_dir).withColumn("field_type", kinds)).select("field", "value")


@query(
    "small_field_recovery",
    f"""WITH {_TEXTS}, {_REGIONS}, h AS (SELECT field, text, ord, round(sqrt(power(x - (x_min + x_max) / 2.0, 2) + power(y - (y_min + y_max) / 2.0, 2)), 6) AS d FROM tx JOIN rg ON tx.page = rg.page
 AND x BETWEEN x_min - 12 AND x_max + 12 AND y BETWEEN y_min - 12 AND y_max + 12 WHERE x_max - x_min < 60 AND length(text) <= 20)
SELECT field, first(text ORDER BY d, ord) AS text FROM h GROUP BY 1""",
)
def small_field_recovery(spark, sf_dir):
    return S.recover_small_fields(texts(spark, sf_dir), regions(spark, sf_dir), width=60)

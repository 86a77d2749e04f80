"""Nested records, tables and training examples over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import records as R
from tessera.operators import spatial as S
from tessera.plans.registry import query
from tessera.plans.session import table
from tessera.plans.spatial_views import _BLOCKS, blocks


@query(
    "entity_flatten",
    """WITH r AS (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i, o_orderstatus, o_orderpriority FROM orders)
SELECT o_custkey, 'Vehicle_' || i || '_' || unnest(['o_orderstatus','o_orderpriority']) AS field, unnest([o_orderstatus, o_orderpriority]) AS value FROM r WHERE i <= 4""",
)
def entity_flatten(spark, sf_dir):
    return R.indexed_fields(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderkey"], "Vehicle", ["o_orderstatus", "o_orderpriority"], 4)


@query("tolerant_json", "SELECT event_id, CASE WHEN event_id % 6 = 5 THEN NULL ELSE event_id::VARCHAR END AS value FROM events")
def tolerant_json(spark, sf_dir):
    """Each damage that the ladder mends, and one that it does not."""
    body = F.concat(F.lit('{"id": "'), F.col("event_id").cast("string"), F.lit('", "kind": "'), "event_type", F.lit('"'))
    k = F.col("event_id") % 6
    text = (
        F.when(k == 0, F.concat(body, F.lit("}")))
        .when(k == 1, F.concat(F.lit("```json\n"), body, F.lit("}\n```")))
        .when(k == 2, F.concat(F.lit("Here it is: "), body, F.lit("} as asked")))
        .when(k == 3, F.concat(body, F.lit(", }")))
        .when(k == 4, body)
        .otherwise(F.lit("no json"))
    )
    return table(spark, sf_dir, "events").select("event_id", F.try_element_at(R.tolerant_json(text), F.lit("id")).alias("value"))


@query("table_cell_access", "SELECT p_partkey, p_brand AS brand, CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE '' END AS kind FROM part")
def table_cell_access(spark, sf_dir):
    header = F.array(F.lit("Name"), F.lit("Brand"), F.lit("Kind"))
    cells = F.when(F.col("p_partkey") % 2 == 0, F.array("p_name", "p_brand", "p_type")).otherwise(F.array("p_name", "p_brand"))
    return table(spark, sf_dir, "part").select("p_partkey", R.cell(header, cells, "Brand").alias("brand"), R.cell(header, cells, "Kind").alias("kind"))


@query(
    "preference_pairs",
    """WITH l AS (SELECT l_orderkey AS doc, 'f' || l_linenumber AS field, max(l_partkey)::VARCHAR AS expected, (max(l_partkey) + CASE WHEN max(l_partkey) % 3 = 0 THEN 1 ELSE 0 END)::VARCHAR AS extracted FROM lineitem GROUP BY 1, 2),
j AS (SELECT doc, '{' || string_agg('"' || field || '":"' || expected || '"', ',' ORDER BY field) || '}' AS chosen, '{' || string_agg('"' || field || '":"' || extracted || '"', ',' ORDER BY field) || '}' AS rejected FROM l GROUP BY 1)
SELECT * FROM j WHERE chosen <> rejected""",
)
def preference_pairs(spark, sf_dir):
    most = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc"), F.concat(F.lit("f"), F.col("l_linenumber").cast("string")).alias("field")).agg(F.max("l_partkey").alias("p"))
    judged = most.select("doc", "field", F.col("p").cast("string").alias("expected"), (F.col("p") + F.when(F.col("p") % 3 == 0, 1).otherwise(0)).cast("string").alias("extracted"))
    return R.preference_pairs(judged, ["doc"])


@query(
    "row_cluster_median",
    f"""WITH RECURSIVE {_BLOCKS}, s AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY y, ord) AS n FROM b),
w AS (SELECT page, ord, n, [y::DOUBLE] AS ys, 1 AS row FROM s WHERE n = 1
 UNION ALL SELECT s.page, s.ord, s.n, CASE WHEN abs(s.y - list_median(w.ys)) <= 25 THEN list_append(w.ys, s.y::DOUBLE) ELSE [s.y::DOUBLE] END, CASE WHEN abs(s.y - list_median(w.ys)) <= 25 THEN w.row ELSE w.row + 1 END
 FROM w JOIN s ON s.page = w.page AND s.n = w.n + 1),
c AS (SELECT *, count(*) OVER (PARTITION BY page, row) AS k FROM w) SELECT page, ord, row FROM c WHERE k >= 2""",
)
def row_cluster_median(spark, sf_dir):
    return R.rows_by_median(blocks(spark, sf_dir), ["page"], 25, 2)


@query(
    "table_regions",
    f"""WITH {_BLOCKS}, o AS (SELECT *, CASE WHEN y - lag(y) OVER w < 30 THEN 0 ELSE 1 END AS opens FROM b WINDOW w AS (PARTITION BY page ORDER BY y, x, ord)),
r AS (SELECT *, sum(opens) OVER (PARTITION BY page ORDER BY y, x, ord) AS row FROM o), k AS (SELECT page, row, count(*) AS n, min(y) AS top, max(y) AS bottom FROM r GROUP BY 1, 2 HAVING count(*) >= 2)
SELECT page, count(*) AS rows, min(top) AS top, max(bottom) AS bottom FROM k GROUP BY 1 HAVING count(*) >= 2""",
)
def table_regions(spark, sf_dir):
    return R.table_regions(S.rows_by_previous(blocks(spark, sf_dir), ["page"], 30), ["page"], 2, 2)


@query(
    "state_reflection",
    """WITH n AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations), s AS (SELECT conv_id, back, 'f' || (turn % 3) AS field, 'v' || turn AS value FROM n WHERE back <= 5)
SELECT conv_id, field, first(value ORDER BY back) AS value FROM s GROUP BY 1, 2""",
)
def state_reflection(spark, sf_dir):
    text = F.concat(F.lit("ok save(f"), (F.col("turn") % 3).cast("string"), F.lit("='v"), F.col("turn").cast("string"), F.lit("') done"))
    return R.reflected_state(table(spark, sf_dir, "conversations").select("conv_id", "turn", text.alias("text")))

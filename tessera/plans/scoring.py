"""Fusion, routing and accuracy over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import compare as C
from tessera.operators import accuracy as A
from tessera.operators import fusion
from tessera.plans.registry import query
from tessera.plans.session import spread, table

#: Line items a task.
LINES = 200_000
SOURCES = ["acroform", "spatial", "template", "positional", "semantic", "label_value", "gap_fill"]
_SQL_SOURCES = "['" + "','".join(SOURCES) + "']"
_W = "[" + ",".join(str(fusion.SOURCE_WEIGHTS[s]) for s in SOURCES) + "]"
KINDS = ["text", "numeric", "date", "checkbox"]

_CANDIDATES = f"""c AS (
  SELECT l_partkey AS field, {_SQL_SOURCES}[l_linenumber] AS source, CAST(CAST(max(l_quantity) AS BIGINT) AS VARCHAR) AS value,
         l_orderkey * 10 + l_linenumber AS ord, {_W}[l_linenumber] AS w
  FROM lineitem GROUP BY l_partkey, l_orderkey, l_linenumber)"""

_FUSE = """g AS (
  SELECT field, value, max(w) AS top, count(*) AS members, min(ord) AS first,
         first(source ORDER BY w DESC, ord) AS source
  FROM c GROUP BY field, value
), s AS (SELECT *, round(least(1.0, top + 0.10 * (members - 1)), 6) AS score FROM g),
r AS (SELECT *, row_number() OVER (PARTITION BY field ORDER BY score DESC, first) AS k,
             sum(members) OVER (PARTITION BY field) AS candidates, count(*) OVER (PARTITION BY field) AS distinct_values FROM s),
f AS (SELECT field, value, source, round(score, 3) AS confidence, members AS agreement, candidates::BIGINT AS candidates, distinct_values FROM r WHERE k = 1)"""


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as candidate values of a part: the line number names the source. They are dealt by part in shares of
    LINES, which serves all later groups by part."""
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_quantity")
    rows = spread(lines, "l_partkey", LINES).groupBy("l_partkey", "l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("q"))
    return rows.select(
        F.col("l_partkey").alias("field"),
        F.get(F.array(*map(F.lit, SOURCES)), F.col("l_linenumber") - 1).alias("source"),
        F.col("q").cast("long").cast("string").alias("value"),
        F.lit(None).cast("double").alias("confidence"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"),
    )


def fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.fuse(fusion.weighted(candidates(spark, sf_dir)), ["field"])


@query("fuse_candidates", f"WITH {_CANDIDATES}, {_FUSE} SELECT * FROM f")
def fuse_candidates(spark, sf_dir):
    return fused(spark, sf_dir)


_TYPED = "CASE k.kind " + " ".join(f"WHEN '{k}' THEN [" + ",".join(str(fusion.TYPE_WEIGHTS[k].get(s, fusion.SOURCE_WEIGHTS[s])) for s in SOURCES) + "][l_linenumber]" for k in KINDS) + " END"


@query(
    "fuse_type_weights",
    f"""WITH k AS (SELECT p_partkey, ['text','numeric','date','checkbox'][1 + p_size % 4] AS kind FROM part),
c AS (SELECT l_partkey AS field, {_SQL_SOURCES}[l_linenumber] AS source, CAST(CAST(max(l_quantity) AS BIGINT) AS VARCHAR) AS value,
      l_orderkey * 10 + l_linenumber AS ord, any_value({_TYPED}) AS w
      FROM lineitem JOIN k ON p_partkey = l_partkey GROUP BY l_partkey, l_orderkey, l_linenumber), {_FUSE} SELECT * FROM f""",
)
def fuse_type_weights(spark, sf_dir):
    kinds = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("field"), F.get(F.array(*map(F.lit, KINDS)), F.col("p_size") % 4).alias("field_type"))
    return fusion.fuse(fusion.weighted(candidates(spark, sf_dir).join(kinds, "field"), by_type=True), ["field"])


@query("fusion_disagreements", f"WITH {_CANDIDATES} SELECT field, count(DISTINCT source) AS sources, count(DISTINCT value) AS values FROM c GROUP BY field HAVING count(DISTINCT source) >= 2 AND count(DISTINCT value) > 1")
def fusion_disagreements(spark, sf_dir):
    return fusion.disagreements(candidates(spark, sf_dir), ["field"])


@query("low_confidence", f"WITH {_CANDIDATES}, {_FUSE} SELECT field, value, confidence FROM f WHERE confidence < 1.0 ORDER BY confidence, field")
def low_confidence(spark, sf_dir):
    return fusion.review_manifest(fused(spark, sf_dir), 1.0).select("field", "value", "confidence").orderBy("confidence", "field")


@query("high_confidence_route", f"WITH {_CANDIDATES} SELECT DISTINCT field FROM c WHERE field NOT IN (SELECT field FROM c WHERE w >= 0.95 AND source IN ('acroform','spatial'))")
def high_confidence_route(spark, sf_dir):
    """Only fields that no trusted source fills go on to the expensive extractors."""
    weighted = fusion.weighted(candidates(spark, sf_dir))
    done = fusion.trusted(weighted, ["field"], 0.95, ["acroform", "spatial"])
    return weighted.select("field").distinct().join(done, "field", "left_anti")


@query(
    "review_manifest",
    f"""WITH {_CANDIDATES}, {_FUSE} SELECT floor(field / 100)::BIGINT AS batch, count(*) AS fields, count(*) FILTER (WHERE confidence < 1.0) AS to_review,
round(100.0 * count(*) FILTER (WHERE confidence < 1.0) / count(*), 1) AS review_rate FROM f GROUP BY 1""",
)
def review_rates(spark, sf_dir):
    """A15 summary: the review rate by batch of fields."""
    low = F.count_if(F.col("confidence") < 1.0)
    return fused(spark, sf_dir).groupBy(F.floor(F.col("field") / 100).alias("batch")).agg(F.count("*").alias("fields"), low.alias("to_review"), F.round(low * 100.0 / F.count("*"), 1).alias("review_rate"))


@query(
    "precedence_merge",
    """WITH u AS (
  SELECT o_custkey AS key, 0 AS priority, max(o_orderpriority) AS value FROM orders WHERE o_orderstatus = 'F' GROUP BY 1
  UNION ALL SELECT o_custkey, 1, max(o_orderpriority) FROM orders WHERE o_orderstatus = 'O' GROUP BY 1
  UNION ALL SELECT o_custkey, 2, max(o_orderpriority) FROM orders GROUP BY 1)
SELECT key, first(value ORDER BY priority) AS value, min(priority) AS priority FROM u GROUP BY key""",
)
def precedence_merge(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    part = lambda rows: rows.groupBy(F.col("o_custkey").alias("key")).agg(F.max("o_orderpriority").alias("value"))
    return fusion.merge_by_precedence([part(orders.filter("o_orderstatus = 'F'")), part(orders.filter("o_orderstatus = 'O'")), part(orders)], ["key"])


# --- accuracy: labels as the truth, rules on documents as the extraction --------------------------------------------

_JUDGED = """p AS (
  SELECT doc_id, source, lang, CASE WHEN n_chars < 60 THEN NULL WHEN n_chars < 400 THEN '0' WHEN lang = 'fr' THEN '1 of 1' ELSE '1' END AS extracted FROM documents
), j AS (
  SELECT p.doc_id, p.source, p.lang, CAST(l.quality AS VARCHAR) AS expected, p.extracted,
         CASE WHEN p.extracted IS NULL THEN 'missing' WHEN p.extracted = CAST(l.quality AS VARCHAR) THEN 'matched'
              WHEN p.extracted LIKE '%' || CAST(l.quality AS VARCHAR) || '%' THEN 'partial' ELSE 'wrong' END AS status
  FROM labels l JOIN p USING (doc_id))"""
_COUNTS = "count(*) AS total, count(*) FILTER (WHERE status = 'matched') AS matched, count(*) FILTER (WHERE status = 'partial') AS partial, count(*) FILTER (WHERE status = 'missing') AS missing, count(*) FILTER (WHERE status = 'wrong') AS wrong"
_RATES = "round((matched + 0.5 * partial) * 100.0 / total, 2) AS accuracy, round(matched * 100.0 / total, 2) AS exact_rate, round((total - missing) * 100.0 / total, 2) AS coverage"


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars")
    rule = F.when(F.col("n_chars") < 60, None).when(F.col("n_chars") < 400, "0").when(F.col("lang") == "fr", "1 of 1").otherwise("1")
    found = docs.select("doc_id", F.lit("quality").alias("field"), rule.alias("value"))
    truth = table(spark, sf_dir, "labels").select("doc_id", F.lit("quality").alias("field"), F.col("quality").cast("string").alias("value"))
    return A.compare_values(truth, found, ["doc_id"]).join(docs.select("doc_id", "source", "lang"), "doc_id")


@query("accuracy_report", f"WITH {_JUDGED}, n AS (SELECT lang, {_COUNTS} FROM j GROUP BY lang) SELECT *, {_RATES} FROM n")
def accuracy_report(spark, sf_dir):
    return A.accuracy(judged(spark, sf_dir), ["lang"])


@query("accuracy_micro_by_source", f"WITH {_JUDGED}, n AS (SELECT source, {_COUNTS} FROM j GROUP BY source) SELECT *, {_RATES} FROM n")
def accuracy_micro_by_source(spark, sf_dir):
    return A.accuracy(judged(spark, sf_dir), ["source"])


@query("accuracy_no_partial", f"WITH {_JUDGED}, n AS (SELECT lang, {_COUNTS} FROM j GROUP BY lang) SELECT lang, total, round(matched * 100.0 / total, 2) AS accuracy FROM n")
def accuracy_no_partial(spark, sf_dir):
    return A.accuracy(judged(spark, sf_dir), ["lang"], half_credit=False).select("lang", "total", "accuracy")


@query(
    "error_grouping_sets",
    f"WITH {_JUDGED} SELECT status, lang, source, count(*) AS errors FROM j WHERE status <> 'matched' GROUP BY GROUPING SETS ((status), (lang), (source), ())",
)
def error_grouping_sets(spark, sf_dir):
    """Every breakdown of the errors in one pass."""
    errors = judged(spark, sf_dir).filter("status <> 'matched'")
    s, lang, source = F.col("status"), F.col("lang"), F.col("source")
    return errors.groupingSets([[s], [lang], [source], []], s, lang, source).agg(F.count("*").alias("errors"))


@query("hard_example_ranking", f"WITH {_JUDGED} SELECT source, count(*) AS errors FROM j WHERE status <> 'matched' GROUP BY source ORDER BY errors DESC, source LIMIT 50")
def hard_example_ranking(spark, sf_dir):
    """The fifty hardest, ties by name; a top-k is the feature."""
    errors = judged(spark, sf_dir).filter("status <> 'matched'")
    return errors.groupBy("source").agg(F.count("*").alias("errors")).orderBy(F.desc("errors"), "source").limit(50)


@query(
    "config_grid",
    f"""WITH {_JUDGED}, n AS (SELECT source, lang, {_COUNTS} FROM j GROUP BY source, lang), r AS (SELECT *, {_RATES} FROM n)
SELECT source, max(accuracy) FILTER (WHERE lang = 'de') AS de, max(accuracy) FILTER (WHERE lang = 'en') AS en, max(accuracy) FILTER (WHERE lang = 'es') AS es,
       max(accuracy) FILTER (WHERE lang = 'fr') AS fr FROM r GROUP BY source""",
)
def config_grid(spark, sf_dir):
    """One row a configuration, one column a form."""
    return A.accuracy(judged(spark, sf_dir), ["source", "lang"]).groupBy("source").pivot("lang", ["de", "en", "es", "fr"]).agg(F.max("accuracy"))


# --- scalar comparison forms ----------------------------------------------------------------------------------------


@query(
    "date_normalise",
    """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS iso FROM orders""",
)
def date_normalise(spark, sf_dir):
    """Order dates written in five layouts (with days over 12 where the layout would be ambiguous) read back."""
    day = F.dayofmonth("o_orderdate")
    layouts = ["MM/dd/yyyy", "M-d-yyyy", "yyyy-MM-dd", "MMMM d, yyyy", "yyyy/MM/dd", "MMM d, yyyy"]
    text = F.lit("")
    for i, layout in enumerate(layouts):
        text = F.when(F.col("o_orderkey") % 7 == i, F.date_format("o_orderdate", layout)).otherwise(text)
    text = F.when((F.col("o_orderkey") % 7 == 6) & (day > 12), F.date_format("o_orderdate", "dd/MM/yyyy")).when(F.col("o_orderkey") % 7 == 6, F.date_format("o_orderdate", "'due 'MM/dd/yyyy")).otherwise(text)
    return table(spark, sf_dir, "orders").select("o_orderkey", C.iso_date(text).alias("iso"))


@query(
    "amount_normalise",
    """SELECT o_orderkey, CASE WHEN o_totalprice::DECIMAL(18,2) = floor(o_totalprice::DECIMAL(18,2)) THEN CAST(floor(o_totalprice::DECIMAL(18,2))::BIGINT AS VARCHAR)
ELSE CAST(o_totalprice::DECIMAL(18,2) AS VARCHAR) END AS amount FROM orders""",
)
def amount_normalise(spark, sf_dir):
    text = F.concat(F.lit(" $ "), F.format_number(F.col("o_totalprice").cast("decimal(18,2)"), 2), F.lit(" "))
    return table(spark, sf_dir, "orders").select("o_orderkey", C.amount(text).alias("amount"))


@query(
    "address_normalise",
    """SELECT s_suppkey, (s_suppkey % 90) || ' ' || ['north','south','east','west'][(1 + s_suppkey % 4)::INT] || ' main ' || ['street','avenue','boulevard','drive'][(1 + s_suppkey % 4)::INT] || ' suite ' || s_suppkey AS address FROM supplier""",
)
def address_normalise(spark, sf_dir):
    pick = lambda *words: F.get(F.array(*map(F.lit, words)), (F.col("s_suppkey") % 4).cast("int"))
    text = F.concat_ws(" ", (F.col("s_suppkey") % 90).cast("string"), pick("N.", "S", "e", "W."), F.lit("Main"), pick("St.", "Ave", "BLVD", "Dr."), F.lit("Ste."), F.col("s_suppkey").cast("string"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", C.expand_address(text).alias("address"))


@query(
    "noise_prefix_match",
    "SELECT c_custkey, CAST(c_custkey % 9 < 7 AS BOOLEAN) AS same FROM customer",
)
def noise_prefix_match(spark, sf_dir):
    """each kind of noise around a customer number of four digits, and two that are none."""
    value = F.lpad(F.col("c_custkey").cast("string"), 9, "4")
    k = F.col("c_custkey") % 9
    forms = [F.concat(F.lit("wi "), value), F.concat(F.lit("50 "), value), F.concat(F.lit("02/19/"), value), F.concat(F.lit("customer id: "), value), F.concat(value, F.lit(" | x")), F.concat(value, F.lit(" [z]")), F.concat(value, F.lit(" | y")), F.concat(value, F.lit("88")), F.concat(F.lit("wisc "), value)]
    found = F.lit("")
    for i, form in enumerate(forms):
        found = F.when(k == i, form).otherwise(found)
    return table(spark, sf_dir, "customer").select("c_custkey", C.noise_equal(value, found).alias("same"))


@query("yn_match", "SELECT c_custkey, c_custkey % 4 IN (0, 1) AS same FROM customer")
def yn_match(spark, sf_dir):
    k = F.col("c_custkey") % 4
    a = F.when(k == 0, "y").when(k == 1, "n").when(k == 2, "yes").otherwise("y")
    b = F.when(k == 0, "true").when(k == 1, "no").when(k == 2, "true").otherwise("no")
    return table(spark, sf_dir, "customer").select("c_custkey", C.same_answer(a, b).alias("same"))

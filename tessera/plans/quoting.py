"""Lines of business, carriers, quotes and validation rules over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import checks
from tessera.operators import rating
from tessera.plans.registry import query
from tessera.plans.session import table

LOBS = {"AUTOMOBILE": ["commercial_auto"], "BUILDING": ["commercial_property", "general_liability"], "FURNITURE": ["bop"], "HOUSEHOLD": ["general_liability", "workers_compensation"], "MACHINERY": ["commercial_auto", "workers_compensation", "umbrella"]}
STATES = ["TX", "CA", "NY", "FL", "IL", "PA", "OH", "GA", "NC", "MI", "NJ", "VA", "WA", "AZ", "MA", "CO", "TN", "IN", "MO", "MD", "NV", "UT", "KS", "ME", "VT"]
FORMS = {"commercial_auto": ["125", "127", "137"], "general_liability": ["125"], "workers_compensation": ["125", "130"], "commercial_property": ["125", "140"], "bop": ["125"], "umbrella": ["125", "163"]}


def _sql_list(values) -> str:
    return "[" + ",".join(f"'{v}'" for v in values) + "]"


def _case(column: str, d: dict, default: str = "") -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in d.items()) + (f" ELSE {default}" if default else "") + " END"


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders rolled up to a risk profile."""
    spent = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("spent"), F.round(F.sum(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")).otherwise(0.0)), 2).alias("lost"))
    lobs = F.create_map(*[x for k, v in LOBS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return (
        table(spark, sf_dir, "customer")
        .join(spent, F.col("c_custkey") == F.col("o_custkey"), "left")
        .select(
            "c_custkey",
            F.coalesce("n", F.lit(0)).alias("fleet_size"),
            (F.col("c_custkey") % 13).alias("years"),
            F.get(F.array(*map(F.lit, STATES)), F.col("c_nationkey")).alias("state"),
            F.coalesce("lost", F.lit(0.0)).alias("total_loss"),
            F.coalesce("spent", F.lit(0.0)).alias("prior_premium"),
            F.coalesce("spent", F.lit(0.0)).alias("revenue"),
            (F.col("c_custkey") % 7 * 50000.0 + 50000).alias("payroll"),
            (F.col("c_custkey") % 3 + 1).alias("locations"),
            F.coalesce(F.try_element_at(lobs, F.col("c_mktsegment")), F.array(F.lit("cyber"))).alias("lobs"),
        )
    )


_PROFILES = f"""o AS (SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS spent, round(sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 0 END), 2) AS lost FROM orders GROUP BY 1),
p AS (SELECT c_custkey, coalesce(n, 0) AS fleet_size, c_custkey % 13 AS years, {_sql_list(STATES)}[c_nationkey + 1] AS state, coalesce(lost, 0.0) AS total_loss,
  coalesce(spent, 0.0) AS prior_premium, coalesce(spent, 0.0) AS revenue, c_custkey % 7 * 50000.0 + 50000 AS payroll, c_custkey % 3 + 1 AS locations,
  {_case("c_mktsegment", {k: _sql_list(v) for k, v in LOBS.items()}, "['cyber']")} AS lobs,
  CASE WHEN coalesce(spent, 0.0) > 0 THEN coalesce(lost, 0.0) / spent ELSE 0.0 END AS loss_ratio
  FROM customer LEFT JOIN o ON c_custkey = o_custkey)"""
_RULES = "r(carrier_id, carrier_lobs, max_fleet, min_years, excluded, max_loss) AS (VALUES " + ", ".join(f"('{c}', {_sql_list(l)}, {f}, {y}, {_sql_list(e)}::VARCHAR[], {m})" for c, l, f, y, e, m in rating.CARRIERS) + ")"
_MATCH = f"""{_PROFILES}, {_RULES}, m AS (
  SELECT p.*, r.*, CASE WHEN NOT list_has_any(lobs, carrier_lobs) OR (max_fleet > 0 AND fleet_size > max_fleet) OR years < min_years OR list_contains(excluded, state) THEN 0.0
   ELSE round(0.90::DOUBLE * (CASE WHEN loss_ratio > max_loss AND prior_premium > 0 THEN 0.5 ELSE 1.0 END)::DOUBLE * (CASE WHEN list_has_all(carrier_lobs, lobs) THEN 1.0 ELSE 0.8 END)::DOUBLE, 2) END AS confidence FROM p CROSS JOIN r)"""
_RATED = f"""{_MATCH}, e AS (SELECT *, unnest(list_intersect(lobs, carrier_lobs)) AS lob FROM m WHERE confidence > 0),
x(carrier_id, lob, f) AS (VALUES {", ".join(f"('{c}', '{l}', {f})" for c, l, f in rating.CARRIER_FACTORS)}),
t AS (SELECT e.*, round(({_case("e.lob", rating.BASE_RATES, "2000")})::DOUBLE
  * (CASE e.lob WHEN 'commercial_auto' THEN greatest(fleet_size, 1) * (CASE WHEN greatest(fleet_size, 1) >= 50 THEN 0.80 WHEN fleet_size >= 20 THEN 0.85 WHEN fleet_size >= 10 THEN 0.90 WHEN fleet_size >= 5 THEN 0.95 ELSE 1.0 END)::DOUBLE
     WHEN 'general_liability' THEN greatest(revenue / 100000, 1.0) WHEN 'workers_compensation' THEN payroll / 100 WHEN 'commercial_property' THEN greatest(locations, 1) ELSE 1.0 END)::DOUBLE
  * ({_case("state", rating.TERRITORY, "1.0")})::DOUBLE
  * (CASE WHEN loss_ratio <= 0 THEN 0.85 WHEN loss_ratio <= 0.3 THEN 0.90 WHEN loss_ratio <= 0.5 THEN 1.0 WHEN loss_ratio <= 0.7 THEN 1.15 ELSE 1.30 END)::DOUBLE
  * (CASE WHEN greatest(years, 1) >= 10 THEN 0.85 WHEN years >= 5 THEN 0.90 WHEN years >= 3 THEN 0.95 ELSE 1.0 END)::DOUBLE
  * coalesce(x.f, 1.0)::DOUBLE, 2) AS premium FROM e LEFT JOIN x ON x.carrier_id = e.carrier_id AND x.lob = e.lob),
q AS (SELECT c_custkey, carrier_id, round(sum(premium), 2) AS total, count(*) AS lines FROM t GROUP BY 1, 2)"""


@query("carrier_match", f"WITH {_MATCH} SELECT c_custkey, carrier_id, confidence, confidence > 0 AS eligible FROM m")
def carrier_match(spark, sf_dir):
    return rating.match_carriers(profiles(spark, sf_dir)).select("c_custkey", "carrier_id", "confidence", "eligible")


def rated(spark, sf_dir) -> DataFrame:
    matched = rating.match_carriers(profiles(spark, sf_dir)).filter("eligible")
    return rating.premiums(matched.withColumn("lob", F.explode(F.array_intersect("lobs", "carrier_lobs"))))


@query("quote_premiums", f"WITH {_RATED} SELECT c_custkey, carrier_id, lob, round(premium, 0) AS premium FROM t")
def quote_premiums(spark, sf_dir):
    return rated(spark, sf_dir).select("c_custkey", "carrier_id", "lob", F.round("premium", 0).alias("premium"))


@query("quote_best", f"WITH {_RATED} SELECT c_custkey, first(carrier_id ORDER BY total, carrier_id) AS cheapest, first(carrier_id ORDER BY lines DESC, carrier_id) AS most_coverage, round(min(total), 0) AS least_total FROM q GROUP BY 1")
def quote_best(spark, sf_dir):
    best = rating.best_quotes(rating.quotes(rated(spark, sf_dir), ["c_custkey"]), ["c_custkey"])
    return best.withColumn("least_total", F.round("least_total", 0))


@query(
    "payment_options",
    f"""WITH {_RATED}, pl(plan, installments, fee) AS (VALUES ('annual', 1, 0.0), ('semi_annual', 2, 0.02), ('quarterly', 4, 0.04), ('monthly', 12, 0.08)),
w AS (SELECT c_custkey, carrier_id, round(total, 0) AS total FROM q)
SELECT c_custkey, carrier_id, plan, installments, round(round(total * (1 + fee::DOUBLE), 2) / installments, 2) AS installment FROM w CROSS JOIN pl""",
)
def payment_options(spark, sf_dir):
    """N11, on totals in whole units."""
    found = rating.quotes(rated(spark, sf_dir), ["c_custkey"]).withColumn("total", F.round("total", 0))
    return rating.payment_options(found).select("c_custkey", "carrier_id", "plan", "installments", "installment")


@query(
    "lob_form_assignment",
    f"""WITH l AS (SELECT c_custkey, unnest({_case("c_mktsegment", {k: _sql_list(v) for k, v in LOBS.items()}, "['cyber']")}) AS lob FROM customer),
f AS (SELECT c_custkey, lob, unnest({_case("lob", {k: _sql_list(v) for k, v in FORMS.items()}, "['125']")}) AS form FROM l)
SELECT c_custkey, form, string_agg(lob, ',' ORDER BY lob) AS lobs FROM f GROUP BY 1, 2""",
)
def lob_form_assignment(spark, sf_dir):
    """The forms of a customer's lines, each with the lines that ask for it."""
    lobs = profiles(spark, sf_dir).select("c_custkey", F.explode("lobs").alias("lob"))
    forms = F.create_map(*[x for k, v in FORMS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    each = lobs.withColumn("form", F.explode(F.coalesce(F.try_element_at(forms, F.col("lob")), F.array(F.lit("125")))))
    return each.groupBy("c_custkey", "form").agg(F.array_join(F.array_sort(F.collect_list("lob")), ",").alias("lobs"))


@query(
    "completeness_by_group",
    """SELECT c_nationkey, round(100.0 * avg((CASE WHEN c_name IS NOT NULL AND c_name <> '' THEN 1 ELSE 0 END + CASE WHEN c_acctbal > 0 THEN 1 ELSE 0 END
+ CASE WHEN c_mktsegment = 'BUILDING' THEN 0 ELSE 1 END) / 3.0), 1) AS completeness FROM customer GROUP BY 1""",
)
def completeness_by_group(spark, sf_dir):
    """The share of required fields present."""
    present = F.when(F.coalesce("c_name", F.lit("")) != "", 1).otherwise(0) + F.when(F.col("c_acctbal") > 0, 1).otherwise(0) + F.when(F.col("c_mktsegment") == "BUILDING", 0).otherwise(1)
    return table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.round(100.0 * F.avg(present / 3.0), 1).alias("completeness"))


_ISSUES = """i AS (
 SELECT l_orderkey AS doc, 'ship_date' AS field, 'date_order' AS rule, 'warning' AS severity FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_shipdate < o_orderdate
 UNION ALL SELECT l_orderkey, 'discount', 'range', 'error' FROM lineitem WHERE l_discount > 0.08
 UNION ALL SELECT l_orderkey, 'quantity', 'range', 'info' FROM lineitem WHERE l_quantity > 45
 UNION ALL SELECT o_orderkey, 'priority', 'format', 'error' FROM orders WHERE NOT regexp_matches(o_orderpriority, '^[1-3]-'))"""


def issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each rule a filter, all rules one long table."""
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    told = lambda rows, key, field, rule, severity: rows.select(F.col(key).alias("doc"), F.lit(field).alias("field"), F.lit(rule).alias("rule"), F.lit(severity).alias("severity"))
    late = lines.join(orders, F.col("o_orderkey") == F.col("l_orderkey")).filter("l_shipdate < o_orderdate")
    parts = [told(late, "l_orderkey", "ship_date", "date_order", "warning"), told(lines.filter("l_discount > 0.08"), "l_orderkey", "discount", "range", "error"), told(lines.filter("l_quantity > 45"), "l_orderkey", "quantity", "range", "info"), told(orders.filter(~F.col("o_orderpriority").rlike("^[1-3]-")), "o_orderkey", "priority", "format", "error")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("rule_issues", f"WITH {_ISSUES} SELECT doc, field, rule, severity, count(*) AS times FROM i GROUP BY ALL")
def rule_issues(spark, sf_dir):
    return issues(spark, sf_dir).groupBy("doc", "field", "rule", "severity").agg(F.count("*").alias("times"))


@query("rule_summary", f"WITH {_ISSUES} SELECT count(*) FILTER (WHERE severity = 'error') AS errors, count(*) FILTER (WHERE severity = 'warning') AS warnings, count(*) FILTER (WHERE severity = 'info') AS infos, count(DISTINCT field) AS fields_with_issues, count(DISTINCT doc) AS docs_with_issues FROM i")
def rule_summary(spark, sf_dir):
    """A10."""
    n = lambda s: F.count_if(F.col("severity") == s)
    return issues(spark, sf_dir).agg(n("error").alias("errors"), n("warning").alias("warnings"), n("info").alias("infos"), F.count_distinct("field").alias("fields_with_issues"), F.count_distinct("doc").alias("docs_with_issues"))


@query(
    "related_field",
    """SELECT a.ps AS part, first(b.p_partkey ORDER BY b.p_partkey) AS related FROM (SELECT p_partkey AS ps, p_brand, p_size FROM part) a
JOIN part b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.ps <> b.p_partkey GROUP BY 1""",
)
def related_field(spark, sf_dir):
    """The first other field with the same suffix (here brand) and keyword (here size)."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    # the lowest other key of a group is one of its two lowest
    lowest = part.groupBy("p_brand", "p_size").agg(F.min("p_partkey").alias("one"))
    second = part.join(lowest, ["p_brand", "p_size"]).groupBy("p_brand", "p_size", "one").agg(F.min(F.when(F.col("p_partkey") > F.col("one"), F.col("p_partkey"))).alias("two"))
    met = part.join(second, ["p_brand", "p_size"])
    return met.select(F.col("p_partkey").alias("part"), F.when(F.col("p_partkey") == F.col("one"), F.col("two")).otherwise(F.col("one")).alias("related")).filter("related IS NOT NULL")


_VIN = "'1' || chr((65 + k % 8)::INT) || lpad(k::VARCHAR, 6, '0') || substr('0123456789X', (1 + k % 11)::INT, 1) || lpad((k * 7 % 99999999)::VARCHAR, 8, '0')"
_VIN_VALUE = "(CASE substr(v, {i}, 1) " + " ".join(f"WHEN '{c}' THEN {n}" for c, n in checks.VIN_VALUES.items()) + " ELSE 0 END)"
_VIN_SUM = " + ".join(_VIN_VALUE.format(i=i) + f" * {w}" for i, w in enumerate(checks.VIN_WEIGHTS, 1))


@query("vin_checksum", f"WITH a AS (SELECT p_partkey AS k FROM part), b AS (SELECT k, {_VIN} AS v FROM a), s AS (SELECT k, v, ({_VIN_SUM}) % 11 AS m FROM b) SELECT k, v AS vin, substr(v, 9, 1) = (CASE WHEN m = 10 THEN 'X' ELSE m::VARCHAR END) AS valid FROM s")
def vin_checksum(spark, sf_dir):
    k = F.col("p_partkey")
    vin = F.concat(F.lit("1"), F.chr(65 + k % 8), F.lpad(k.cast("string"), 6, "0"), F.substr(F.lit("0123456789X"), (1 + k % 11).cast("int"), F.lit(1)), F.lpad((k * 7 % 99999999).cast("string"), 8, "0"))
    return table(spark, sf_dir, "part").select(k.alias("k"), vin.alias("vin")).withColumn("valid", checks.vin_valid(F.col("vin")))


@query("phone_normalise", "SELECT c_custkey, CASE WHEN c_custkey % 4 < 3 THEN '(' || substr(d, 1, 3) || ') ' || substr(d, 4, 3) || '-' || substr(d, 7, 4) END AS phone FROM (SELECT c_custkey, lpad((c_custkey + 2000000000)::VARCHAR, 10, '0') AS d FROM customer)")
def phone_normalise(spark, sf_dir):
    d = F.lpad((F.col("c_custkey") + 2000000000).cast("string"), 10, "0")
    k = F.col("c_custkey") % 4
    text = F.when(k == 0, F.concat(F.lit("+1 "), d)).when(k == 1, F.concat(F.substring(d, 1, 3), F.lit("."), F.substring(d, 4, 3), F.lit(" "), F.substring(d, 7, 4))).when(k == 2, d).otherwise(F.concat(d, F.lit(" x12")))
    return table(spark, sf_dir, "customer").select("c_custkey", checks.phone(text).alias("phone"))


@query("tax_id_normalise", "SELECT s_suppkey, CASE WHEN s_suppkey % 3 < 2 THEN substr(d, 1, 2) || '-' || substr(d, 3) END AS tax_id FROM (SELECT s_suppkey, lpad((s_suppkey * 7919)::VARCHAR, 9, '0') AS d FROM supplier)")
def tax_id_normalise(spark, sf_dir):
    d = F.lpad((F.col("s_suppkey") * 7919).cast("string"), 9, "0")
    k = F.col("s_suppkey") % 3
    text = F.when(k == 0, d).when(k == 1, F.concat(F.substring(d, 1, 2), F.lit(" - "), F.substring(d, 3, 7))).otherwise(F.substring(d, 1, 7))
    return table(spark, sf_dir, "supplier").select("s_suppkey", checks.tax_id(text).alias("tax_id"))


_GIVEN = "CASE event_type WHEN 'purchase' THEN 1.0 WHEN 'signup' THEN 0.95 WHEN 'click' THEN 0.90 WHEN 'view' THEN 0.70 ELSE 0.5 END"
_SCORE = f"round(least(1.0::DOUBLE, greatest(0.1::DOUBLE, ({_GIVEN})::DOUBLE + (CASE WHEN event_id % 3 = 0 THEN 0.10 ELSE 0.0 END)::DOUBLE - (CASE WHEN event_id % 5 = 0 THEN 0.30 ELSE 0.0 END)::DOUBLE)), 2)"


def _scored(spark, sf_dir) -> DataFrame:
    kinds = F.create_map(*[F.lit(x) for kv in {"purchase": "user_confirmed", "signup": "validated", "click": "user_stated", "view": "llm_inferred"}.items() for x in kv])
    events = table(spark, sf_dir, "events").withColumn("given", F.try_element_at(kinds, F.col("event_type")))
    return events.withColumn("confidence", checks.given_confidence(F.col("given"), F.col("event_id") % 3 == 0, F.col("event_id") % 5 == 0))


@query("confidence_score", f"WITH s AS (SELECT event_id, {_SCORE} AS confidence FROM events) SELECT *, CASE WHEN confidence >= 0.9 THEN 'high' WHEN confidence >= 0.7 THEN 'medium' WHEN confidence >= 0.5 THEN 'low' ELSE 'very_low' END AS band FROM s")
def confidence_score(spark, sf_dir):
    return _scored(spark, sf_dir).select("event_id", "confidence", checks.band(F.col("confidence")).alias("band"))


@query("review_route", f"WITH s AS (SELECT user_id, event_type, {_SCORE} AS confidence FROM events) SELECT user_id, count(*) FILTER (WHERE confidence < 0.7) AS flagged, CASE WHEN bool_or(confidence < 0.7 AND event_type = 'error') THEN 'required' WHEN bool_or(confidence < 0.7) THEN 'optional' ELSE 'none' END AS review FROM s GROUP BY 1")
def review_route(spark, sf_dir):
    """Review is required where a critical field is uncertain, optional where any is."""
    low = F.col("confidence") < 0.7
    route = F.when(F.bool_or(low & (F.col("event_type") == "error")), "required").when(F.bool_or(low), "optional").otherwise("none")
    return _scored(spark, sf_dir).groupBy("user_id").agg(F.count_if(low).alias("flagged"), route.alias("review"))

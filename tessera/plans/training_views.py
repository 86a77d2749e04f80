"""Full dialogue checks, message parsing and generators, on known answers and over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import training as T
from tessera.plans.known import cases, known_rows, known_values, sql
from tessera.plans.registry import query
from tessera.plans.session import table

MESSAGE = "turn int, role string, content string, tool string, field string, value string, status string"
_CONVERSATIONS = [
    [(0, "user", "my name is Acme Ltd", None, None, None, None), (1, "assistant", None, "save_field", "name", "Acme Ltd", None), (2, "tool", None, None, "name", None, "saved"), (3, "assistant", "Where? When? How?", None, None, None, None)],
    [(0, "user", "please change the city to Bonn", None, None, None, None), (1, "assistant", "fine", None, None, None, None), (2, "user", "ok", None, None, None, None), (3, "assistant", None, "save_field", "city", "Berlin", None), (4, "tool", None, None, "zip", None, "saved")],
    [(0, "user", "update it to 5", None, None, None, None), (1, "assistant", "yes", None, None, None, None), (2, "assistant", None, "save_field", "n", "5", None), (3, "tool", None, None, "n", None, "saved")],
]


def _messages(spark, sf_dir):
    return cases(spark, sf_dir, MESSAGE, _CONVERSATIONS).withColumnRenamed("doc", "conv_id")


def _doc(df):
    return df.withColumnRenamed("conv_id", "doc")


known_rows("behaviour_checks", "W13: questions and ignored corrections.", ["behaviour"], [[(0.85,)], [(0.85,)], [(1.0,)]], lambda spark, d: _doc(T.behaviour(_messages(spark, d))), {"behaviour": "DOUBLE"})
known_rows("grounded_saves", "W14: saved values that nobody said.", ["grounding"], [[(1.0,)], [(0.7,)], [(1.0,)]], lambda spark, d: _doc(T.grounding(_messages(spark, d))), {"grounding": "DOUBLE"})
known_rows("state_consistency", "W14: saves that nobody asked for.", ["consistency"], [[(1.0,)], [(0.75,)], [(1.0,)]], lambda spark, d: _doc(T.consistency(_messages(spark, d))), {"consistency": "DOUBLE"})


def _quality(spark, sf_dir):
    m = _messages(spark, sf_dir)
    ones = m.select("conv_id", F.lit(1.0)).distinct()
    return _doc(T.quality({"structure": ones, "phases": ones, "tools": ones, "behaviour": T.behaviour(m), "grounding": T.grounding(m), "length": T.consistency(m)})).select("doc", "quality", "band")


known_rows("dialogue_quality", "A16: the composite of all six scores.", ["quality", "band"], [[(0.9775, "accepted")], [(0.8925, "flagged")], [(1.0, "accepted")]], _quality, {"quality": "DOUBLE"})
known_values(
    "message_parse", "S19.", "t string",
    [("From: \"Ann Lee\" <a@b.com>\nSubject: Hi\n\nBody text", "email/Ann Lee/a@b.com/Hi/Subject: Hi\n\nBody text"), ("From: a@b.com\nTo: x\nhello", "email/-/a@b.com/-/hello"), ("Bob says: hello\n---\n there", "chat/Bob/-/-/hello\nthere"), ("  just text ", "raw/-/-/-/just text")],
    lambda t: F.concat_ws("/", *[F.coalesce(T.message(t)[c], F.lit("-")) for c in ("source_type", "sender_name", "sender_email", "subject", "body")]),
)
known_values("reflection_gate", "Z10.", "m string, n int", [("REVISION NEEDED: x", 0, "revise"), ("REVISION NEEDED", 1, "pass"), ("fine", 0, "pass"), (None, 0, "pass")], T.reflection)


@query("report_truncation", """WITH r AS (SELECT l_suppkey AS doc, CASE WHEN l_quantity > 25 THEN 'wrong' ELSE 'missing' END AS status, l_partkey AS field FROM (SELECT DISTINCT l_suppkey, l_partkey, l_quantity FROM lineitem)),
n AS (SELECT *, row_number() OVER (PARTITION BY doc, status ORDER BY field) AS rank, count(*) OVER (PARTITION BY doc, status) AS "all" FROM r) SELECT * FROM n WHERE rank <= 15""")
def report_truncation(spark, sf_dir):
    """Fifteen rows a report are the feature."""
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_quantity").distinct()
    return T.report(li.select(F.col("l_suppkey").alias("doc"), F.when(F.col("l_quantity") > 25, "wrong").otherwise("missing").alias("status"), F.col("l_partkey").alias("field")))


_PLAN = [("chat", 0, "greet", "assistant", "Hello", None), ("chat", 1, "ask", "assistant", "Your balance?", None), ("chat", 2, "ask", "user", "It is {balance}, {name}", "balance"), ("bulk", 0, "intake", "user", "{name}: {segment}, {balance}", None), ("bulk", 1, "review", "assistant", "Thanks {name} {other}", None)]


def _scenarios(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    style = F.when(F.col("c_custkey") % 2 == 0, "chat").otherwise("bulk")
    pair = lambda key, c: F.struct(F.lit(key).alias("k"), c.alias("v"))
    pairs = F.array(pair("name", F.col("c_name")), pair("segment", F.col("c_mktsegment")))
    balance = F.array(pair("balance", F.floor("c_acctbal").cast("string")))
    fields = F.when(F.col("c_custkey") % 3 > 0, F.concat(pairs, balance)).otherwise(pairs)
    return c.select(F.col("c_custkey").alias("scenario"), style.alias("style"), F.map_from_entries(fields).alias("fields"), (F.col("c_custkey") - 1).alias("position"))


def _skeletons(spark, sf_dir):
    return T.skeletons(_scenarios(spark, sf_dir), spark.createDataFrame(_PLAN, "style string, n int, phase string, role string, template string, needs string"))


_STYLE = f"""p(style, n, phase, role, template, needs) AS (VALUES {', '.join('(' + ', '.join(map(sql, r)) + ')' for r in _PLAN)}),
s AS (SELECT c_custkey AS scenario, CASE WHEN c_custkey % 2 = 0 THEN 'chat' ELSE 'bulk' END AS style, c_name, c_mktsegment, CASE WHEN c_custkey % 3 > 0 THEN floor(c_acctbal)::BIGINT::VARCHAR END AS balance FROM customer),
k AS (SELECT scenario, row_number() OVER (PARTITION BY scenario ORDER BY n) - 1 AS n, phase, role, CASE WHEN balance IS NULL THEN t ELSE replace(t, '{{balance}}', balance) END AS content FROM (SELECT *, replace(replace(template, '{{name}}', c_name), '{{segment}}', c_mktsegment) AS t FROM s JOIN p USING (style) WHERE needs IS NULL OR balance IS NOT NULL))"""


@query("turn_skeletons", f"WITH {_STYLE} SELECT scenario, n, phase, role FROM k")
def turn_skeletons(spark, sf_dir):
    """Turns by delivery style."""
    return _skeletons(spark, sf_dir).select("scenario", "n", "phase", "role")


@query("conversation_assembly", f"WITH {_STYLE} SELECT scenario, string_agg(role || ': ' || content, chr(10) ORDER BY n) AS text, count(*) AS turns FROM k GROUP BY 1")
def conversation_assembly(spark, sf_dir):
    """Scenarios, turns and fields as conversations."""
    found = T.assembled(_skeletons(spark, sf_dir))
    return found.select("scenario", F.array_join(F.transform("messages", lambda m: F.concat_ws(": ", m["role"], m["content"])), "\n").alias("text"), F.size("messages").cast("long").alias("turns"))


@query("tool_synthesis", """WITH a AS (SELECT user_id AS conv_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS n, CASE WHEN event_type = 'error' THEN 'validate_fields' ELSE 'save_field' END AS tool, event_type AS field FROM events),
b AS (SELECT *, (SELECT count(DISTINCT field) FROM a x WHERE x.conv_id = a.conv_id AND x.n <= a.n AND x.tool = 'save_field') AS saved FROM a)
SELECT conv_id, n * 2 + h AS n, CASE h WHEN 0 THEN 'assistant' ELSE 'tool' END AS role, tool, CASE WHEN h = 1 THEN CASE tool WHEN 'save_field' THEN 'saved' ELSE 'ok' END END AS status, saved FROM b, range(0, 2) t(h)""")
def tool_synthesis(spark, sf_dir):
    """Events stand for actions."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    actions = table(spark, sf_dir, "events").select(F.col("user_id").alias("conv_id"), n.alias("n"), F.when(F.col("event_type") == "error", "validate_fields").otherwise("save_field").alias("tool"), F.col("event_type").alias("field"), F.col("value").cast("string").alias("value"))
    return T.tool_rows(actions).select("conv_id", F.col("n").cast("long").alias("n"), "role", "tool", "status", F.col("saved").cast("long").alias("saved"))


_TEMPLATES = [(c, f"good {c} for {{name}}", f"bad {c} for {{name}}") for c in T.CATEGORIES]


@query("preference_categories", f"WITH t(i, category) AS (VALUES {', '.join(f'({i}, {sql(c)})' for i, c in enumerate(T.CATEGORIES))}), m AS (SELECT count(*) AS n FROM customer) SELECT category, j, c_custkey AS scenario, 'good ' || category || ' for ' || c_name AS chosen, 'bad ' || category || ' for ' || c_name AS rejected FROM t, range(0, 20) r(j), m JOIN customer ON c_custkey - 1 = (i * 20 + j) % n")
def preference_categories(spark, sf_dir):
    """Six categories of twenty pairs, cycling over the scenarios."""
    return T.preference_set(_scenarios(spark, sf_dir), 20, spark.createDataFrame(_TEMPLATES, "category string, chosen string, rejected string"))


@query("curriculum_phases", f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(sql, (n, 'data/' + f, e, r))) + ')' for n, f, e, r in T.PHASES)}) t(phase, path, epochs, rate)")
def curriculum_phases(spark, sf_dir):
    """X13."""
    return T.phases(spark, "data")

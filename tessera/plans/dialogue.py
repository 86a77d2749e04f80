"""Conversation checks, sessions and state over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import dialogue as D
from tessera.plans.registry import query
from tessera.plans.session import table


def turns(spark, sf_dir):
    return table(spark, sf_dir, "conversations")


_SEQ = """r AS (SELECT *, lag(role) OVER w AS before, row_number() OVER w AS n FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
q AS (SELECT conv_id, round(greatest(0.0, 1 - (count(*) FILTER (WHERE role = 'system' AND n > 1) + CASE WHEN bool_or(role = 'user' AND before = 'user') THEN 1 ELSE 0 END
 + count(*) FILTER (WHERE role NOT IN ('system','user','assistant','tool'))) * 0.2::DOUBLE), 6) AS score, count(*) AS turns FROM r GROUP BY 1)"""


@query("role_sequence", f"WITH {_SEQ} SELECT * FROM q")
def role_sequence(spark, sf_dir):
    return D.role_sequence(turns(spark, sf_dir))


_PHASE = """p AS (SELECT conv_id, turn, ((turn * 3 + conv_id) % 5)::BIGINT AS ph FROM conversations),
b AS (SELECT conv_id, ph < max(ph) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS back FROM p),
f AS (SELECT conv_id, count(*) FILTER (WHERE back) AS steps_back, round(greatest(0.0, 1 - count(*) FILTER (WHERE back) * 0.2::DOUBLE), 6) AS score FROM b GROUP BY 1)"""


@query("phase_monotonic", f"WITH {_PHASE} SELECT * FROM f")
def phase_monotonic(spark, sf_dir):
    return D.phase_monotonic(turns(spark, sf_dir), (F.col("turn") * 3 + F.col("conv_id")) % 5)


_ASKED = """a AS (SELECT conv_id, CASE WHEN role = 'assistant' THEN length(regexp_replace(text, '[^.]', '', 'g')) ELSE 0 END AS n FROM conversations),
k AS (SELECT conv_id, max(n) AS most_questions, CASE WHEN max(n) > 2 THEN 0.85 ELSE 1.0 END::DOUBLE AS score FROM a GROUP BY 1)"""


def _asked(spark, sf_dir):
    # the texts hold no question marks, so stops stand for them
    return D.question_count(turns(spark, sf_dir).withColumn("text", F.translate(F.replace("text", F.lit("?")), ".", "?")))


@query("question_count", f"WITH {_ASKED} SELECT * FROM k")
def question_count(spark, sf_dir):
    return _asked(spark, sf_dir)


_TOOLS = "t AS (SELECT conv_id, turn, ['ask','save','validate','confirm'][1 + ((conv_id * 5 + turn * 3) % 4)::INT] AS tool FROM conversations WHERE role = 'assistant')"
_ORDER = """o AS (SELECT conv_id, min(turn) FILTER (WHERE tool = 'ask') AS a, min(turn) FILTER (WHERE tool = 'save') AS s, min(turn) FILTER (WHERE tool = 'validate') AS v, min(turn) FILTER (WHERE tool = 'confirm') AS c FROM t GROUP BY 1),
g AS (SELECT conv_id, CASE WHEN a > s THEN 1 ELSE 0 END + CASE WHEN s > v THEN 1 ELSE 0 END + CASE WHEN v > c THEN 1 ELSE 0 END AS broken FROM o)"""


def _calls(spark, sf_dir):
    tool = F.get(F.array(*map(F.lit, ["ask", "save", "validate", "confirm"])), ((F.col("conv_id") * 5 + F.col("turn") * 3) % 4).cast("int"))
    return turns(spark, sf_dir).filter("role = 'assistant'").select("conv_id", "turn", tool.alias("tool"))


RULES = [("ask", "save"), ("save", "validate"), ("validate", "confirm")]


@query("tool_order", f"WITH {_TOOLS}, {_ORDER} SELECT *, round(greatest(0.0, 1 - broken * 0.25::DOUBLE), 6) AS score FROM g")
def tool_order(spark, sf_dir):
    return D.tool_order(_calls(spark, sf_dir), RULES)


@query("phantom_saves", f"WITH {_TOOLS}, m AS (SELECT *, min(turn) FILTER (WHERE tool = 'ask') OVER (PARTITION BY conv_id) AS asked FROM t) SELECT conv_id, count(*) AS phantoms FROM m WHERE tool = 'save' AND (asked IS NULL OR asked > turn) GROUP BY 1")
def phantom_saves(spark, sf_dir):
    return D.phantom_saves(_calls(spark, sf_dir), "ask", "save")


@query(
    "dialogue_quality_bands",
    f"""WITH {_SEQ}, {_PHASE}, {_ASKED}, {_TOOLS}, {_ORDER}, z AS (SELECT q.conv_id, round((q.score * 0.15::DOUBLE + f.score * 0.15::DOUBLE + (CASE WHEN broken IS NULL THEN 1.0 ELSE greatest(0.0, 1 - broken * 0.25::DOUBLE) END) * 0.25::DOUBLE + k.score * 0.15::DOUBLE) / 0.7::DOUBLE, 4) AS quality
FROM q JOIN f USING (conv_id) JOIN k USING (conv_id) LEFT JOIN g USING (conv_id))
SELECT conv_id, quality, CASE WHEN quality >= 0.95 THEN 'accepted' WHEN quality >= 0.85 THEN 'flagged' ELSE 'rejected' END AS band FROM z""",
)
def dialogue_quality_bands(spark, sf_dir):
    w = D.WEIGHTS
    parts = [role_sequence(spark, sf_dir), phase_monotonic(spark, sf_dir), tool_order(spark, sf_dir), _asked(spark, sf_dir)]
    return D.composite(parts, [w["structure"], w["phases"], w["tools"], w["behaviour"]])


@query(
    "turn_windows",
    """WITH n AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos FROM conversations)
SELECT conv_id, w AS window, count(*) AS turns, min(turn) AS first_turn FROM n, range(0, 20) t(w) WHERE pos >= w * 3 AND pos < w * 3 + 4 GROUP BY 1, 2""",
)
def turn_windows(spark, sf_dir):
    return D.turn_windows(turns(spark, sf_dir), 4, 1).groupBy("conv_id", "window").agg(F.count("*").alias("turns"), F.min("turn").alias("first_turn"))


@query(
    "history_compaction",
    """WITH n AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back, greatest(0, count(*) OVER (PARTITION BY conv_id) - 6) AS compacted FROM conversations)
SELECT conv_id, turn, role, compacted FROM n WHERE back <= 6""",
)
def history_compaction(spark, sf_dir):
    return D.recent(turns(spark, sf_dir).select("conv_id", "turn", "role"), 6)


@query("role_text_concat", "SELECT conv_id, role, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS content FROM conversations GROUP BY 1, 2")
def role_text_concat(spark, sf_dir):
    return D.role_texts(turns(spark, sf_dir))


_MSG = "CASE turn % 4 WHEN 0 THEN 'From: a@b' || chr(10) || 'Subject: x' || chr(10) || text WHEN 1 THEN 'Customer: ' || text ELSE text END"


@query(
    "message_source_type",
    f"""WITH m AS (SELECT conv_id, turn, lower(substr({_MSG}, 1, 500)) AS h FROM conversations)
SELECT conv_id, turn, CASE WHEN contains(h, 'from:')::INT + contains(h, 'to:')::INT + contains(h, 'subject:')::INT + contains(h, 'date:')::INT + contains(h, 'cc:')::INT >= 2 THEN 'email'
WHEN contains(h, 'user:') OR contains(h, 'agent:') OR contains(h, 'assistant:') OR contains(h, 'customer:') OR contains(h, '[chat]') THEN 'chat' ELSE 'raw' END AS kind FROM m""",
)
def message_source_type(spark, sf_dir):
    text = F.when(F.col("turn") % 4 == 0, F.concat(F.lit("From: a@b\nSubject: x\n"), "text")).when(F.col("turn") % 4 == 1, F.concat(F.lit("Customer: "), "text")).otherwise(F.col("text"))
    return turns(spark, sf_dir).select("conv_id", "turn", D.source_type(text).alias("kind"))


_SESSIONS = """n AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w > 3600000000 OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS session FROM n)"""


@query("session_timeout", f"WITH {_SESSIONS} SELECT user_id, session, epoch_us(min(ts)) AS started, epoch_us(max(ts)) AS ended, count(*) AS events FROM s GROUP BY 1, 2")
def session_timeout(spark, sf_dir):
    found = D.sessions(table(spark, sf_dir, "events"), "user_id", "ts", 3600)
    return found.withColumns({c: F.unix_micros(F.col(c).cast("timestamp")) for c in ("started", "ended")})


@query(
    "field_state_upsert",
    """WITH r AS (SELECT user_id, event_type, event_id, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id % 10 = 0 DESC, ts DESC, event_id DESC) AS n, count(*) OVER (PARTITION BY user_id, event_type) AS updates FROM events)
SELECT user_id, event_type, event_id, value, updates FROM r WHERE n = 1""",
)
def field_state_upsert(spark, sf_dir):
    """Every tenth event is a confirmed value, which later plain ones do not replace."""
    events = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "ts", "value")
    return D.field_state(events, ["user_id", "event_type"], F.col("event_id") % 10 == 0).drop("ts")


@query("state_prefix_summary", "SELECT substr(event_type, 1, 3) AS prefix, count(*) AS fields, (list(event_id ORDER BY event_id))[1:3] AS samples FROM events GROUP BY 1")
def state_prefix_summary(spark, sf_dir):
    """Three samples a group are the feature; kept by a bounded minimum, not by collecting the group."""
    events = table(spark, sf_dir, "events").select(F.substring("event_type", 1, 3).alias("prefix"), "event_id")
    from tessera.operators.retrieval import first_per_group

    samples = first_per_group(events, ["prefix"], ["event_id"], 3).groupBy("prefix").agg(F.array_sort(F.collect_list("event_id")).alias("samples"))
    return events.groupBy("prefix").agg(F.count("*").alias("fields")).join(samples, "prefix")


@query(
    "completeness_fixed_list",
    """WITH e AS (SELECT DISTINCT user_id, event_type FROM events WHERE value > 50), w(event_type) AS (VALUES ('view'), ('click'), ('purchase'), ('signup'), ('error'), ('refund'))
SELECT u.user_id, round(100.0 * count(e.event_type) / 6, 1) AS completeness, string_agg(w.event_type, ',' ORDER BY w.event_type) FILTER (WHERE e.event_type IS NULL) AS missing
FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN w LEFT JOIN e ON e.user_id = u.user_id AND e.event_type = w.event_type GROUP BY 1""",
)
def completeness_fixed_list(spark, sf_dir):
    """Filled fields against a fixed list of expected ones."""
    expected = F.array(*map(F.lit, sorted(["view", "click", "purchase", "signup", "error", "refund"])))
    have = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set(F.when(F.col("value") > 50, F.col("event_type"))).alias("have"))
    missing = F.array_except(expected, "have")
    return have.select("user_id", F.round((6 - F.size(missing)) * 100.0 / 6, 1).alias("completeness"), F.array_join(missing, ",").alias("missing"))

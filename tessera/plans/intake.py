"""Streaming state and message intake over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.plans.dialogue import _SESSIONS
from tessera.plans.registry import query
from tessera.plans.session import ship, table
from tessera.streaming import state


def _stream(spark, sf_dir, name):
    path = f"{sf_dir}/{name}.parquet"
    # a pattern, because a streaming source takes one file only through a pattern
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{sf_dir}/{name}.parque[t]")


@query("stream_sessions", f"WITH {_SESSIONS.replace('> 3600000000', '>= 3600000000')} SELECT user_id, epoch_us(min(ts)) AS started, epoch_us(max(ts)) AS ended, count(*) AS events FROM s GROUP BY user_id, session")
def stream_sessions(spark, sf_dir):
    """Z01 through Structured Streaming, all that is there now."""
    events = _stream(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    found = state.run_to_table(state.session_stream(events, "user_id", "ts"))
    return found.withColumns({c: F.unix_micros(c) for c in ("started", "ended")})


@query(
    "stream_state",
    """WITH r AS (SELECT user_id, event_type, event_id, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id % 10 = 0 DESC, ts DESC, event_id DESC) AS n, count(*) OVER (PARTITION BY user_id, event_type) AS updates FROM events)
SELECT user_id, event_type, event_id, value, updates FROM r WHERE n = 1""",
)
def stream_state(spark, sf_dir):
    """Z03 through Structured Streaming; equal to the batch result."""
    events = _stream(spark, sf_dir, "events").select("user_id", "event_type", "event_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    return state.upsert_to_table(state.state_stream(events, ["user_id", "event_type"], F.col("event_id") % 10 == 0), ["user_id", "event_type"]).drop("ts")


@query("message_accumulation", "SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS content, count(*) AS messages FROM conversations WHERE role = 'user' GROUP BY 1")
def message_accumulation(spark, sf_dir):
    """A session's user texts in order."""
    from tessera.operators.dialogue import role_texts

    users = table(spark, sf_dir, "conversations").filter("role = 'user'")
    counts = users.groupBy("conv_id").agg(F.count("*").alias("messages"))
    return role_texts(users).drop("role").join(counts, "conv_id")


@query(
    "phase_routing",
    """WITH c AS (SELECT conv_id, count(*) AS turns, count(*) FILTER (WHERE role = 'assistant') AS tool_rounds, count(DISTINCT length(text) % 12) AS confirmed FROM conversations GROUP BY 1)
SELECT conv_id, CASE WHEN turns >= 30 THEN 'complete' WHEN tool_rounds > 5 THEN 'pause' WHEN confirmed >= 5 THEN 'mapping' ELSE 'intake' END AS phase FROM c""",
)
def phase_routing(spark, sf_dir):
    """Routing by caps on state columns."""
    state_rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.count_if(F.col("role") == "assistant").alias("tool_rounds"), F.count_distinct(F.char_length("text") % 12).alias("confirmed"))
    phase = F.when(F.col("turns") >= 30, "complete").when(F.col("tool_rounds") > 5, "pause").when(F.col("confirmed") >= 5, "mapping").otherwise("intake")
    return state_rows.select("conv_id", phase.alias("phase"))


@query(
    "correction_application",
    """WITH f AS (SELECT doc_id, lang AS value FROM documents), c AS (SELECT doc_id, 'fixed' || quality AS value FROM labels WHERE toxic = 0)
SELECT f.doc_id, coalesce(c.value, f.value) AS value, c.value IS NOT NULL AS corrected FROM f LEFT JOIN c USING (doc_id)""",
)
def correction_application(spark, sf_dir):
    """Corrections overwrite values; the last write wins."""
    fields = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("value"))
    fixes = table(spark, sf_dir, "labels").filter("toxic = 0").select("doc_id", F.concat(F.lit("fixed"), F.col("quality").cast("string")).alias("fix"))
    return fields.join(fixes, "doc_id", "left").select("doc_id", F.coalesce("fix", "value").alias("value"), F.col("fix").isNotNull().alias("corrected"))


@query("model_adapter", "SELECT doc_id::VARCHAR AS doc_id, 'n_words' AS field, len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\f\\v]+'), lambda x: x <> ''))::VARCHAR AS value FROM documents")
def model_adapter(spark, sf_dir):
    """The adapter interface with a stub back end that counts words."""
    import pandas as pd

    from tessera.sources.adapters import FIELDS, run_adapter

    ship(spark)

    def make():
        def call(batch: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"doc_id": batch["doc_id"].astype(str), "field": "n_words", "value": [str(len(t.split())) for t in batch["text"]]})

        return call

    return run_adapter(table(spark, sf_dir, "documents").select("doc_id", "text"), make, FIELDS)

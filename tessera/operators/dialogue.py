"""Checks of conversations, session state and history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Weights of the quality composite, in the order of the checks.
WEIGHTS = {"structure": 0.15, "phases": 0.15, "tools": 0.25, "behaviour": 0.15, "grounding": 0.20, "length": 0.10}


def by_turn(*groups: str):
    return Window.partitionBy(*groups).orderBy("turn")


def penalty(count: Column, each: float) -> Column:
    return F.round(F.greatest(F.lit(0.0), 1 - count * each), 6)


def role_sequence(turns: DataFrame) -> DataFrame:
    """0.2 off for each fault: a system turn that is not first, two user turns running (once), an unknown role."""
    before = F.lag("role").over(by_turn("conv_id"))
    seen = turns.withColumns({"_before": before, "_n": F.row_number().over(by_turn("conv_id"))})
    late_system = F.count_if((F.col("role") == "system") & (F.col("_n") > 1))
    doubled = F.when(F.bool_or((F.col("role") == "user") & (F.col("_before") == "user")), 1).otherwise(0)
    unknown = F.count_if(~F.col("role").isin("system", "user", "assistant", "tool"))
    return seen.groupBy("conv_id").agg(penalty(late_system + doubled + unknown, 0.2).alias("score"), F.count("*").alias("turns"))


def phase_monotonic(turns: DataFrame, phase: Column) -> DataFrame:
    """0.2 off for each turn whose phase lies before the furthest phase so far."""
    marked = turns.withColumn("_phase", phase)
    furthest = F.max("_phase").over(by_turn("conv_id").rowsBetween(Window.unboundedPreceding, -1))
    back = marked.withColumn("_back", F.coalesce(F.col("_phase") < furthest, F.lit(False)))
    return back.groupBy("conv_id").agg(F.count_if("_back").alias("steps_back"), penalty(F.count_if("_back"), 0.2).alias("score"))


def question_count(turns: DataFrame, most: int = 2) -> DataFrame:
    """0.15 off once where an assistant turn asks more than the given number of questions."""
    asked = F.char_length("text") - F.char_length(F.replace("text", F.lit("?")))
    own = turns.withColumn("_asked", F.when(F.col("role") == "assistant", asked).otherwise(0))
    return own.groupBy("conv_id").agg(F.max("_asked").alias("most_questions"), F.when(F.max("_asked") > most, 0.85).otherwise(1.0).alias("score"))


def tool_order(calls: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """Calls (conv_id, turn, tool); 0.25 off for each rule (first, then) whose tools first occur the other way."""
    tools = sorted({t for rule in rules for t in rule})
    first = calls.groupBy("conv_id").agg(*[F.min(F.when(F.col("tool") == t, F.col("turn"))).alias(t) for t in tools])
    broken = sum((F.when(F.col(a) > F.col(b), 1).otherwise(0) for a, b in rules), F.lit(0))
    return first.select("conv_id", broken.alias("broken"), penalty(broken, 0.25).alias("score"))


def phantom_saves(calls: DataFrame, request: str, save: str) -> DataFrame:
    """Saves of a conversation that no earlier request precedes."""
    asked = F.min(F.when(F.col("tool") == request, F.col("turn"))).over(Window.partitionBy("conv_id"))
    return calls.withColumn("_asked", asked).filter((F.col("tool") == save) & (F.col("_asked").isNull() | (F.col("_asked") > F.col("turn")))).groupBy("conv_id").agg(F.count("*").alias("phantoms"))


def turn_windows(turns: DataFrame, size: int = 10, overlap: int = 2) -> DataFrame:
    """W15 by turn numbers: windows start every size - overlap turns; a turn is in each window that covers it.

    A turn lies in at most ceil(size / step) windows, so it is exploded into those and never joined."""
    step = size - overlap
    at = F.row_number().over(by_turn("conv_id")) - 1
    numbered = turns.withColumn("_at", at)
    last = F.floor(F.col("_at") / step)
    first = F.greatest(F.lit(0), F.ceil((F.col("_at") - size + 1) / step))
    return numbered.withColumn("window", F.explode(F.sequence(first, last))).drop("_at")


def recent(turns: DataFrame, keep: int) -> DataFrame:
    """The last turns of a conversation, with the number that was left out."""
    w = Window.partitionBy("conv_id")
    back = F.row_number().over(w.orderBy(F.desc("turn")))
    return turns.withColumns({"_back": back, "compacted": F.greatest(F.lit(0), F.count("*").over(w) - keep)}).filter(F.col("_back") <= keep).drop("_back")


def role_texts(turns: DataFrame, separator: str = "\n\n") -> DataFrame:
    """A role's texts of a conversation in turn order."""
    listed = turns.groupBy("conv_id", "role").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("_t"))
    return listed.select("conv_id", "role", F.array_join(F.transform("_t", lambda t: t["text"]), separator).alias("content"))


def sessions(events: DataFrame, user: str, ts: str, gap_seconds: int) -> DataFrame:
    """A session ends where the next event of its user is more than the gap later."""
    w = Window.partitionBy(user).orderBy(ts, "event_id")
    opens = F.coalesce((F.unix_micros(F.col(ts).cast("timestamp")) - F.lag(F.unix_micros(F.col(ts).cast("timestamp"))).over(w)) > gap_seconds * 1_000_000, F.lit(True))
    numbered = events.withColumn("_open", opens.cast("int")).withColumn("session", F.sum("_open").over(w))
    return numbered.groupBy(user, "session").agg(F.min(ts).alias("started"), F.max(ts).alias("ended"), F.count("*").alias("events"))


def field_state(updates: DataFrame, keys: list[str], rank: Column) -> DataFrame:
    """Of a key's updates the one of the highest rank (a confirmed value beats later plain ones), then the latest."""
    rest = [c for c in updates.columns if c not in keys]
    ordered = updates.withColumn("_rank", rank)
    return ordered.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("_rank", "ts", "event_id")).alias("_b"), F.count("*").alias("updates")).select(*keys, "_b.*", "updates")


def composite(scores: list[DataFrame], weights: list[float]) -> DataFrame:
    """The weighted sum of per-conversation scores and its band."""
    out = scores[0].select("conv_id", F.col("score").alias("s0"))
    for i, s in enumerate(scores[1:], 1):
        out = out.join(s.select("conv_id", F.col("score").alias(f"s{i}")), "conv_id", "left")
    total = sum((F.coalesce(f"s{i}", F.lit(1.0)) * w for i, w in enumerate(weights)), F.lit(0.0)) / sum(weights)
    quality = F.round(total, 4)
    return out.select("conv_id", quality.alias("quality"), F.when(quality >= 0.95, "accepted").when(quality >= 0.85, "flagged").otherwise("rejected").alias("band"))


def source_type(text: Column) -> Column:
    """mail by two header marks in the first 500 characters, else chat by a mark, else raw."""
    head = F.lower(F.substring(text, 1, 500))
    marks = sum((F.when(head.contains(m), 1).otherwise(0) for m in ("from:", "to:", "subject:", "date:", "cc:")), F.lit(0))
    chat = F.lit(False)
    for m in ("user:", "agent:", "assistant:", "customer:", "[chat]"):
        chat = chat | head.contains(m)
    return F.when(marks >= 2, "email").when(chat, "chat").otherwise("raw")

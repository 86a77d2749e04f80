"""Conversations for training: full quality checks, generators and curriculum (A16, W13, W14, W21, J39, F30, X09, X10, X12,
X13, T04, S19, Z10).

Messages are rows (conv_id, turn, role, content, tool, field, value, status): a call has tool and its arguments, a tool's
answer has status. Generators are joins of scenarios with small dimensions of templates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.compare import contains_any, let, strip
from tessera.operators.dialogue import WEIGHTS, penalty

# Words that ask for a correction, what marks a chat, and the training phases.
CHANGE_WORDS = "change correct update fix".split()
CHAT_MARKS = ["sent a message", "says:", "wrote:", "[message]", "chat transcript"]
PHASES = [("general", "train.jsonl", 2, 2e-4), ("hard", "hard_examples.jsonl", 2, 1e-4), ("error_specific", "error_examples.jsonl", 1, 5e-5)]
AGENT_PHASES = [("agent_foundation", "agent_train_phase1.jsonl", 2, 2e-4), ("agent_complex", "agent_train_phase2.jsonl", 2, 1e-4), ("agent_error_specific", "agent_train_phase3.jsonl", 1, 5e-5)]
CATEGORIES = ["address_hallucination", "quote_fabrication", "tool_ordering", "phase_inappropriate_tools", "multi_field_completeness", "confirmation_handling"]


def behaviour(messages: DataFrame) -> DataFrame:
    """0.15 off once where an assistant turn asks over two questions, and once where a user asks for a correction and
    the assistant's next turn, or the one after, saves nothing."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    asked = F.char_length("content") - F.char_length(F.replace("content", F.lit("?")))
    saves = F.coalesce(F.col("tool") == "save_field", F.lit(False))
    told = messages.groupBy("conv_id", "turn").agg(F.max("role").alias("role"), F.max(asked).alias("asked"), F.max("content").alias("content"), F.max(saves).alias("saves"))
    change = (F.col("role") == "user") & contains_any(F.lower("content"), CHANGE_WORDS)
    ignored = change & (F.lead("role").over(w) == "assistant") & ~F.coalesce(F.lead("saves").over(w), F.lit(False)) & ~F.coalesce(F.lead("saves", 2).over(w), F.lit(False))
    seen = told.withColumn("_ignored", F.coalesce(ignored, F.lit(False)))
    many = F.coalesce(F.max(F.when(F.col("role") == "assistant", F.col("asked"))) > 2, F.lit(False))
    return seen.groupBy("conv_id").agg(penalty(many.cast("int") + F.max("_ignored").cast("int"), 0.15).alias("behaviour"))


def grounding(messages: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """0.3 off for each saved value of three characters or more that neither the user's texts nor the tools' answers
    nor known (conv_id, text) hold."""
    texts = messages.filter(F.col("role").isin("user", "tool")).select("conv_id", F.lower("content").alias("_text"))
    if known is not None:
        texts = texts.unionByName(known.select("conv_id", F.lower("text").alias("_text")))
    saved = messages.filter((F.col("tool") == "save_field") & (F.col("role") == "assistant")).select("conv_id", "turn", "field", F.lower(strip(F.col("value"))).alias("_value"))
    checked = saved.filter(F.char_length("_value") > 2)
    held = checked.join(texts, "conv_id").filter(F.contains("_text", "_value")).select("conv_id", "turn", "field", "_value").distinct()
    lost = checked.join(held, ["conv_id", "turn", "field", "_value"], "left_anti").groupBy("conv_id").agg(F.count("*").alias("_n"))
    return messages.select("conv_id").distinct().join(lost, "conv_id", "left").select("conv_id", penalty(F.coalesce("_n", F.lit(0)), 0.3).alias("grounding"))


def consistency(messages: DataFrame) -> DataFrame:
    """0.25 off for each field that a tool says it saved and no call asked for."""
    asked = messages.filter((F.col("tool") == "save_field") & (F.col("role") == "assistant")).select("conv_id", "field").distinct()
    done = messages.filter((F.col("role") == "tool") & (F.col("status") == "saved") & (F.col("field") != "")).select("conv_id", "field").distinct()
    phantom = done.join(asked, ["conv_id", "field"], "left_anti").groupBy("conv_id").agg(F.count("*").alias("_n"))
    return messages.select("conv_id").distinct().join(phantom, "conv_id", "left").select("conv_id", penalty(F.coalesce("_n", F.lit(0)), 0.25).alias("consistency"))


def quality(scores: dict[str, DataFrame]) -> DataFrame:
    """The composite of all six scores (conv_id, score) by name, and its band."""
    out = None
    for name, df in scores.items():
        one = df.toDF("conv_id", name)
        out = one if out is None else out.join(one, "conv_id", "left")
    total = sum((F.coalesce(F.col(n), F.lit(1.0)) * WEIGHTS[n] for n in WEIGHTS), F.lit(0.0))
    q = out.withColumn("quality", F.round(total, 4))
    return q.withColumn("band", F.when(F.col("quality") >= 0.95, "accepted").when(F.col("quality") >= 0.85, "flagged").otherwise("rejected"))


def report(results: DataFrame, most: int = 15) -> DataFrame:
    """Of each document and status (wrong, missing) the first fields of the report, and how many there are."""
    w = Window.partitionBy("doc", "status")
    shown = results.filter(F.col("status").isin("wrong", "missing"))
    return shown.withColumn("rank", F.row_number().over(w.orderBy("field"))).withColumn("all", F.count("*").over(w)).filter(F.col("rank") <= most)


def message(c: Column) -> Column:
    """Struct of source_type, sender_name, sender_email, subject, body of a raw text.

    Two header names in the first 500 characters make an e-mail; its headers run to the first line that is none. Else a
    mark makes a chat, whose sender stands before says:, wrote: or a colon. Else it is raw.
    """

    def read(t: Column) -> Column:
        head = F.lower(F.substring(t, 1, 500))
        mail = sum((head.contains(h).cast("int") for h in ("from:", "subject:", "to:", "sent:")), F.lit(0)) >= 2
        chat = contains_any(head, CHAT_MARKS)
        top = r"(?i)^((?:\s*(?:From|To|Subject|Date|Sent):[^\n]*(?:\n|$))+)"
        line = lambda name: F.nullif(strip(F.regexp_extract(F.regexp_extract(t, top, 1), rf"(?im)^\s*{name}:\s*(.+)$", 1)), F.lit(""))
        sender, subject = line("From"), line("Subject")
        both = F.regexp_extract(sender, r"^(.+?)\s*<(.+?)>", 1)
        address = F.coalesce(F.nullif(F.regexp_extract(sender, r"<(.+?)>", 1), F.lit("")), F.nullif(F.regexp_extract(sender, r"[\w.+-]+@[\w-]+\.[\w.-]+", 0), F.lit("")))
        name = F.when(both != "", F.trim(both, F.lit('"'))).when(address.isNull(), sender)
        rest = strip(F.regexp_replace(t, top, ""))
        text = F.when(subject.isNotNull(), F.concat(F.lit("Subject: "), subject, F.lit("\n\n"), rest)).otherwise(rest)
        said = r"(?m)^\s*(.{1,49}?)(?:\s+says:|\s+wrote:|:\s)"
        speaker = F.nullif(strip(F.regexp_extract(t, said, 1)), F.lit(""))
        lines = F.filter(F.transform(F.split(F.regexp_replace(t, said, ""), "\n"), strip), lambda x: (x != "") & ~contains_any(F.lower(x), ["chat transcript", "[system]", "---"]))
        return F.struct(
            F.when(mail, "email").when(chat, "chat").otherwise("raw").alias("source_type"),
            F.when(mail, name).when(chat, speaker).alias("sender_name"),
            F.when(mail, address).alias("sender_email"),
            F.when(mail, subject).alias("subject"),
            F.when(mail, text).when(chat, F.array_join(lines, "\n")).otherwise(t).alias("body"),
        )

    return let(strip(c), read)


def skeletons(scenarios: DataFrame, plan: DataFrame) -> DataFrame:
    """Scenario, n, phase, role, template: the turns of a scenario by its style, in the plan's order (style, n, phase,
    role, template, needs); a turn that needs a field the scenario lacks is left out and the rest move up."""
    met = scenarios.join(F.broadcast(plan), "style").filter(F.col("needs").isNull() | F.array_contains(F.map_keys("fields"), F.col("needs")))
    w = Window.partitionBy("scenario").orderBy("n")
    return met.withColumn("n", F.row_number().over(w) - 1)


def rendered(template: Column, fields: Column) -> Column:
    """{name} in a template by the field's value; unknown names stay."""
    return F.aggregate(F.map_entries(fields), template, lambda t, e: F.replace(t, F.concat(F.lit("{"), e["key"], F.lit("}")), e["value"]))


def assembled(skeleton: DataFrame) -> DataFrame:
    """Scenario, messages: the rendered turns in order."""
    turn = F.struct("n", "role", rendered(F.col("template"), F.col("fields")).alias("content"))
    return skeleton.groupBy("scenario").agg(F.array_sort(F.collect_list(turn)).alias("messages"))


def tool_rows(actions: DataFrame) -> DataFrame:
    """Two rows, call and answer, for each action (conv_id, n, tool, field, value), with the fields saved so far."""
    w = Window.partitionBy("conv_id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    saved = F.size(F.collect_set(F.when(F.col("tool") == "save_field", F.col("field"))).over(w))
    state = actions.withColumn("saved", saved)
    call = F.struct(F.lit("assistant").alias("role"), F.lit(None).cast("string").alias("status"))
    answer = F.struct(F.lit("tool").alias("role"), F.when(F.col("tool") == "save_field", "saved").otherwise("ok").alias("status"))
    return state.select("conv_id", (F.col("n") * 2).alias("n2"), "tool", "field", "value", "saved", F.posexplode(F.array(call, answer)).alias("half", "r")).select("conv_id", (F.col("n2") + F.col("half")).alias("n"), "r.role", "tool", "field", "value", "r.status", "saved")


def preference_set(scenarios: DataFrame, per_category: int, templates: DataFrame) -> DataFrame:
    """Category, j, scenario, chosen, rejected: per_category pairs of each category, over scenarios numbered from 0
    (position) that each category enters where the last one left, cycling; texts from templates (category, chosen,
    rejected)."""
    spark, n = scenarios.sparkSession, scenarios.count()
    wanted = spark.range(len(CATEGORIES) * per_category).select(F.floor(F.col("id") / per_category).cast("int").alias("_c"), (F.col("id") % per_category).alias("j"))
    start = F.pmod(F.col("_c") * F.lit(per_category), F.lit(max(n, 1)))
    placed = wanted.withColumn("position", F.pmod(start + F.col("j"), F.lit(max(n, 1)))).withColumn("category", F.get(F.array(*map(F.lit, CATEGORIES)), F.col("_c")))
    met = placed.join(scenarios, "position").join(F.broadcast(templates), "category")
    return met.select("category", "j", "scenario", rendered(F.col("chosen"), F.col("fields")).alias("chosen"), rendered(F.col("rejected"), F.col("fields")).alias("rejected"))


def phases(spark, data_dir: str, agent: bool = False) -> DataFrame:
    """Phase, path, epochs, rate of the curriculum."""
    return spark.createDataFrame([(n, f"{data_dir}/{f}", e, r) for n, f, e, r in (AGENT_PHASES if agent else PHASES)], "phase string, path string, epochs int, rate double")


def reflection(last: Column, revisions: Column) -> Column:
    """Revise, once a turn at most, where the last message asks for it, else pass."""
    return F.when((revisions < 1) & F.coalesce(last.contains("REVISION NEEDED"), F.lit(False)), "revise").otherwise("pass")

"""Layout rules as rows, row records, and runs over whole forms and sessions.

A rule finds a label within bounds on its page, looks in a region beside it (or, without a label, in a fixed one) and picks
the first block there that is of the kind it asks for. A form's rules are a short table, which is broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.compare import strip
from tessera.functions.values import is_common_label
from tessera.operators.mapping import ranked_lookup
from tessera.operators.normalise import normalise_record
from tessera.operators.rules import corrected, form_issues, gaps

FAR = 99_999.0
RULE = "page int, field string, label string, x_min double, x_max double, y_min double, y_max double, leftmost boolean, dx0 double, dx1 double, dy0 double, dy1 double, keep_labels boolean, pick string"
# What ticks a cell; the rules of form 125's total, product code and status row.
TICKS = ["x", "1", "y", "yes", "$", "s", "✓", "check", "checked", "•", "■"]
_BAND = (1280.0, 2450.0, 620.0, 860.0)
FORM_125 = [
    (0, "Policy_Total_EstimatedPremium", "TOTAL", 1500.0, FAR, 1200.0, 1500.0, False, 50.0, 500.0, -30.0, 40.0, False, "amount"),
    (0, "Policy_ProductCode_A", "PRODUCT CODE", 0.0, FAR, 0.0, 600.0, False, -50.0, 400.0, 0.0, 80.0, True, "code"),
    (0, "Policy_Status_QuoteIndicator_A", "QUOTE", *_BAND, True, 15.0, 140.0, -40.0, 40.0, True, "mark"),
    (0, "Policy_Status_BoundIndicator_A", "BOUND", *_BAND, True, 15.0, 140.0, -40.0, 40.0, True, "mark"),
    (0, "Policy_Status_IssueIndicator_A", "ISSUE", *_BAND, True, 15.0, 140.0, -40.0, 40.0, True, "mark"),
    (0, "Policy_Status_CancelIndicator_A", "CANCEL", *_BAND, True, 15.0, 140.0, -40.0, 40.0, True, "mark"),
    (0, "Policy_Status_RenewIndicator_A", "RENEW", *_BAND, True, 15.0, 140.0, -40.0, 40.0, True, "mark"),
    (0, "Policy_Status_ChangeIndicator_A", "CHANGE", *_BAND, True, 15.0, 140.0, -40.0, 40.0, True, "mark"),
    (0, "Policy_Status_EffectiveDate_A", None, *_BAND, False, 0.0, 0.0, 0.0, 0.0, True, "date"),
]


def apply_rules(blocks: DataFrame, rules: DataFrame) -> DataFrame:
    """Doc, field, value of blocks (doc, page, ord, text, x, y). Of several labels the topmost counts, or the
    leftmost; of the blocks in the region the first by y, x and ord that suits the pick: date, amount (above 0, its
    digits), code, naic, text; mark says whether any block ticks, false where none does. A field without a label on the
    page or without a suitable block has no row."""
    r, t = F.broadcast(rules), strip(F.col("text"))
    within = F.col("x").between(F.col("x_min"), F.col("x_max")) & F.col("y").between(F.col("y_min"), F.col("y_max"))
    met = blocks.join(r.filter("label IS NOT NULL"), "page").filter(within & F.contains(F.lower("text"), F.lower("label")))
    order = F.struct(F.when(F.col("leftmost"), F.col("x")).otherwise(F.col("y")), "ord")
    places = met.groupBy("doc", "page", "field").agg(F.min_by(F.struct("x", "y", "dx0", "dx1", "dy0", "dy1", "keep_labels", "pick"), order).alias("_l")).select("doc", "page", "field", "_l.*")
    beside = places.select("doc", "page", "field", F.greatest(F.lit(0.0), F.col("x") + F.col("dx0")).alias("_x0"), (F.col("x") + F.col("dx1")).alias("_x1"), (F.col("y") + F.col("dy0")).alias("_y0"), (F.col("y") + F.col("dy1")).alias("_y1"), "keep_labels", "pick")
    fixed = blocks.select("doc", "page").distinct().join(r.filter("label IS NULL"), "page").select("doc", "page", "field", F.col("x_min").alias("_x0"), F.col("x_max").alias("_x1"), F.col("y_min").alias("_y0"), F.col("y_max").alias("_y1"), "keep_labels", "pick")
    regions = beside.unionByName(fixed)
    there = F.col("x").between(F.col("_x0"), F.col("_x1")) & F.col("y").between(F.col("_y0"), F.col("_y1")) & (t != "") & (F.col("keep_labels") | ~is_common_label(F.col("text")))
    hits = regions.join(blocks.select("doc", "page", "ord", "text", "x", "y"), ["doc", "page"], "left").withColumn("_in", there)
    plain = F.translate(t, ",$S", "")
    amount = F.when(plain.rlike(r"^\d+(\.\d*)?$") & (plain.try_cast("double") > 0), plain)
    code = F.when(~is_common_label(F.col("text")) & (t.rlike("(?i)^[A-Z0-9]+-[A-Z0-9]+$") | t.rlike("^[A-Za-z0-9-]{4,}$")), t)
    day = F.nullif(F.regexp_extract(t, r"\d{1,2}/\d{1,2}/\d{4}", 0), F.lit(""))
    pick = F.col("pick")
    found = F.when(pick == "date", day).when(pick == "amount", amount).when(pick == "code", code).when((pick == "naic") & t.rlike(r"^\d{5}$"), t).when(pick == "text", t)
    found = F.when(F.col("_in"), F.when(pick == "mark", F.when(F.lower(t).isin(TICKS), F.lit("true"))).otherwise(found))
    first = hits.groupBy("doc", "field", "pick").agg(F.min_by(found, F.when(found.isNotNull(), F.struct("y", "x", "ord"))).alias("value"))
    return first.select("doc", "field", F.when(pick == "mark", F.coalesce("value", F.lit("false"))).otherwise(F.col("value")).alias("value")).filter(F.col("value").isNotNull())


def row_records(rows: DataFrame, columns: DataFrame, most: int) -> DataFrame:
    """Doc, field, value of a list of rows (doc, row, ord, x, text): the texts within each column's x interval
    (field, x_min, x_max), joined, with a letter for the row; the form holds the first so many rows that say anything."""
    met = rows.filter(strip(F.col("text")) != "").join(F.broadcast(columns), F.col("x").between(F.col("x_min"), F.col("x_max")))
    words = F.transform(F.array_sort(F.collect_list(F.struct("x", "ord", strip(F.col("text")).alias("t")))), lambda s: s["t"])
    cells = met.groupBy("doc", "row", "field").agg(F.array_join(words, " ").alias("value"))
    numbered = cells.withColumn("_n", F.dense_rank().over(Window.partitionBy("doc").orderBy("row"))).filter(F.col("_n") <= most)
    letter = F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), F.col("_n"), F.lit(1))
    return numbered.select("doc", F.concat("field", F.lit("_"), letter).alias("field"), "value")


def form_run(pairs: DataFrame, label_map: DataFrame, catalog: DataFrame, zips: DataFrame, licences: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """X11: label pairs to a checked form: values (doc, field, value) looked up, normalised and corrected; the issues
    against them; the status of the wanted fields.

    A step reads its value many times over, so each step's value is settled by an aggregate on the key before the next
    one: the optimiser doesn't write the whole normaliser out at every use, and the parts share one shuffle."""
    settled = lambda rows: rows.groupBy("doc", "field").agg(F.min("value").alias("value"))
    looked_up = ranked_lookup(pairs, label_map).select("doc", "field", "value")
    record = settled(normalise_record(looked_up, catalog))
    values = settled(corrected(record).select("doc", "field", F.coalesce("corrected", "value").alias("value")))
    issues = form_issues(values, zips, licences)
    return values, issues, gaps(values, issues, wanted)


def rerun(messages: DataFrame, touched: DataFrame, corrections: DataFrame, values: DataFrame, critical: list[str]) -> DataFrame:
    """Session, text, turns, corrected, status of the touched sessions alone, recomputed whole: all their messages
    (session, turn, text) in order; corrections (session, form, field, value) that fall on a form that has values; the
    status awaiting_info while a critical field has no value on any form, else complete. A null message is empty; repeated
    rows of touched count once."""
    ids = touched.select("session").distinct()
    ours = lambda rows: rows.join(ids, "session", "left_semi")
    texts = ours(messages).groupBy("session").agg(F.array_sort(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("t")))).alias("_m"))
    held = ours(values)
    applied = ours(corrections).join(held.select("session", "form").distinct(), ["session", "form"], "left_semi")
    kept = held.join(applied.select("session", "form", "field").distinct(), ["session", "form", "field"], "left_anti")
    now = kept.select("session", "field", "value").unionByName(applied.select("session", "field", "value")).filter(strip(F.col("value")) != "")
    there = now.filter(F.col("field").isin(critical)).groupBy("session").agg(F.count_distinct("field").alias("_there"))
    counted = applied.groupBy("session").agg(F.count("*").alias("corrected"))
    joined = ids.join(texts, "session", "left").join(there, "session", "left").join(counted, "session", "left")
    status = F.when(F.coalesce("_there", F.lit(0)) < len(set(critical)), "awaiting_info").otherwise("complete")
    return joined.select("session", F.array_join(F.transform("_m", lambda m: m["t"]), "\n").alias("text"), F.coalesce(F.size("_m"), F.lit(0)).alias("turns"), F.coalesce("corrected", F.lit(0)).alias("corrected"), status.alias("status"))

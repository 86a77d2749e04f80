"""The field catalog."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.compare import strip, whole
from tessera.functions.text import key_form

# What an enriched tooltip says, and the training phases.
BOX_HINT, DATE_HINT, AMOUNT_HINT = " Return 1 if checked, Off if not.", " (MM/DD/YYYY).", " Use dollar amount."


def positioned(catalog: DataFrame, page: int | None = None) -> DataFrame:
    """Fields with a place, of one page where that is given."""
    placed = catalog.filter(F.col("x0").isNotNull())
    return placed if page is None else placed.filter(F.col("page") == page)


def names_by(catalog: DataFrame, *keys: str) -> DataFrame:
    """The sorted field names of each form, category or both."""
    return catalog.groupBy(*keys).agg(F.array_sort(F.collect_set("field")).alias("fields"))


def with_default(catalog: DataFrame) -> DataFrame:
    """Fields with a default that says something."""
    return catalog.filter(~F.col("default_value").isin("", "null", "Off", "None"))


def tooltips(catalog: DataFrame) -> DataFrame:
    """Field, tooltip where there is one."""
    return catalog.filter(F.col("tooltip") != "").select("field", "tooltip")


def empty_form(catalog: DataFrame, use_defaults: bool) -> DataFrame:
    """Every field with null, or with its default where defaults are used and there is one."""
    return catalog.select("field", (F.nullif("default_value", F.lit("")) if use_defaults else F.lit(None).cast("string")).alias("value"))


def enriched_tooltip(kind: Column, field: Column, tooltip: Column) -> Column:
    """A box's tooltip says what to return, a date's and an amount's in what form, where they do not say so yet."""
    tip = F.coalesce(tooltip, F.lit(""))
    low, name = F.lower(tip), F.lower(field)
    told = low.contains(BOX_HINT.strip().lower()) | (tip.contains("1") & low.contains("off"))
    box = F.when(told, tip).when(tip == "", F.lit("Checkbox." + BOX_HINT)).otherwise(F.concat(strip(tip), F.lit(BOX_HINT)))
    s = strip(tip)
    date = name.contains("date") & ~F.lower(s).contains("mm/dd/yyyy") & F.lower(s).contains("date")
    amount = ~date & (name.contains("amount") | name.contains("limit")) & ~F.lower(s).contains("dollar") & F.lower(s).contains("amount") & ~s.endswith(".")
    text = F.when(date & ~s.endswith(")."), F.concat(s, F.lit(DATE_HINT))).when(amount, F.concat(s, F.lit(AMOUNT_HINT))).otherwise(tip)
    return F.when(kind.isin("checkbox", "radio"), box).when(kind == "text", text).otherwise(tip)


def lobs_above(rows: DataFrame, known: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Doc, lob, confidence of known lines of business from the threshold on."""
    return rows.filter(F.col("confidence") >= threshold).join(F.broadcast(known.select("lob")), "lob", "left_semi").select("doc", "lob", "confidence")


def forms_for(rows: DataFrame, forms: DataFrame) -> DataFrame:
    """Doc, forms: the sorted distinct forms of all its lines (lob, form)."""
    return rows.join(F.broadcast(forms), "lob").groupBy("doc").agg(F.array_sort(F.collect_set("form")).alias("forms"))


def section_text(blocks: DataFrame, sections: DataFrame) -> DataFrame:
    """P20: doc, category, text: in order, the blocks on the pages of a category's sections (category, page, keyword) that
    hold the keyword; a null keyword takes the page whole."""
    met = blocks.join(F.broadcast(sections), "page").filter(F.col("keyword").isNull() | F.contains(F.upper("text"), F.upper("keyword")))
    one = met.groupBy("doc", "category", "page", "ord").agg(F.first("text").alias("text"))
    return one.groupBy("doc", "category").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "ord", "text"))), lambda s: s["text"]), "\n").alias("text"))


def coverage(mapped: DataFrame, catalog: DataFrame) -> DataFrame:
    """Per form: fields, mapped ones, their share in percent, unmapped boxes and others."""
    seen = mapped.select("form", "field").distinct().withColumn("_m", F.lit(1))
    met = catalog.select("form", "field", "kind").join(seen, ["form", "field"], "left")
    box = F.col("kind").isin("checkbox", "radio")
    return met.groupBy("form").agg(
        F.count("*").alias("total_fields"), F.count("_m").alias("mapped_fields"), F.round(100 * F.count("_m") / F.count("*"), 1).alias("coverage_pct"),
        F.count(F.when(F.col("_m").isNull() & box, 1)).alias("unmapped_checkboxes"), F.count(F.when(F.col("_m").isNull() & ~box, 1)).alias("unmapped_text"),
    )


def point_lookup(keys: DataFrame, exact: DataFrame, similar: DataFrame) -> DataFrame:
    """Key, document, basis: by equality of the key, else the most similar row (key, document, score)."""
    near = similar.groupBy("key").agg(F.max_by("document", F.struct("score", "document")).alias("_near"))
    met = keys.select("key").distinct().join(exact.groupBy("key").agg(F.min("document").alias("_exact")), "key", "left").join(near, "key", "left")
    return met.select("key", F.coalesce("_exact", "_near").alias("document"), F.when(F.col("_exact").isNotNull(), "key").when(F.col("_near").isNotNull(), "similar").alias("basis"))


def focused(errors: DataFrame, docs: DataFrame, by: str, least: int) -> DataFrame:
    """Form, doc and category or page, with the sorted wrong fields and their true values, from least errors on."""
    met = errors.join(docs, ["form", "stem"])
    grouped = met.groupBy("form", "stem", by).agg(F.array_sort(F.collect_set("field")).alias("fields"), F.map_from_entries(F.array_sort(F.collect_set(F.struct("field", "expected")))).alias("truth"))
    return grouped.filter(F.size("fields") >= least)


def difficulty(n_lobs: Column, style: Column, corrected: Column) -> Column:
    """Struct of difficulty and phase: several lines in bulk, mixed or with a correction are hard."""
    hard = (n_lobs > 1) & (style.isin("bulk_email", "mixed") | corrected)
    easy = (n_lobs <= 1) & (style == "conversational")
    return F.struct(F.when(hard, "hard").when(easy, "easy").otherwise("medium").alias("difficulty"), F.when(hard, 3).when(easy, 1).otherwise(2).alias("phase"))


def flatten(rows: DataFrame, depth: int = 4) -> DataFrame:
    """Doc, path, key, value of every scalar of a JSON text (doc, json), objects within objects to the depth; lists
    and nulls go. path has the names with dots; key joins them by underscores, and a vehicle or driver object's number
    comes as a letter (a number from the fourteenth on) at its end."""
    numbered = r"(?i)^(vehicle|driver)\s+(\d+)$"
    values = lambda text: F.from_json(text, "map<string,string>")
    top = rows.select("doc", F.explode(values(F.col("json"))).alias("name", "text"))
    n = whole(F.regexp_extract(F.trim("name"), numbered, 2))
    is_object = F.coalesce(F.col("text").startswith("{"), F.lit(False))
    group = is_object & n.isNotNull()
    key = F.when(group, F.initcap(F.regexp_extract(F.trim("name"), numbered, 1))).otherwise(F.col("name"))
    end = F.when(group, F.concat(F.lit("_"), F.when(n.between(1, 13), F.char(n + 64)).otherwise(n.cast("string")))).otherwise("")
    level = top.select("doc", F.col("name").alias("path"), key.alias("key"), end.alias("end"), "text")
    done = []
    for _ in range(depth):
        done.append(level.filter(F.col("text").isNotNull() & ~F.col("text").startswith("{") & ~F.col("text").startswith("[")))
        inner = level.filter(is_object).select("doc", "path", "key", "end", F.explode(values(F.col("text"))).alias("name", "text"))
        level = inner.select("doc", F.concat_ws(".", "path", "name").alias("path"), F.concat_ws("_", "key", key_form(F.col("name"))).alias("key"), "end", "text")
    return reduce(DataFrame.unionByName, done).select("doc", "path", F.concat(F.regexp_replace("key", "_+$", ""), F.col("end")).alias("key"), F.col("text").alias("value"))


def at_path(flat: DataFrame, path: Column | str) -> DataFrame:
    """Doc, value at a dotted path of a flattened record."""
    return flat.filter(F.col("path") == path).select("doc", "value")


RECORD = "business struct<name: string, address: string>, drivers array<struct<full_name: string, first_name: string, last_name: string>>"


def parse_record(json: Column) -> Column:
    """The record of a JSON text: missing lists are empty, first and last names fall back to parts of the full name."""
    record = F.from_json(json, RECORD)
    words = lambda d: F.filter(F.split(d["full_name"], r"\s+"), lambda w: w != "")
    drivers = F.transform(F.coalesce(record["drivers"], F.from_json(F.lit("[]"), "array<struct<full_name: string, first_name: string, last_name: string>>")), lambda d: F.struct(
        d["full_name"].alias("full_name"), F.coalesce(d["first_name"], F.get(words(d), F.lit(0))).alias("first_name"), F.coalesce(d["last_name"], F.when(F.size(words(d)) > 1, F.get(words(d), F.size(words(d)) - 1))).alias("last_name")))
    return F.struct(record["business"]["name"].alias("name"), record["business"]["address"].alias("line_one"), drivers.alias("drivers"))

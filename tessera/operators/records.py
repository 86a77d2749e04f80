"""Nested records, tolerant JSON, tables and training examples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def indexed_fields(rows: DataFrame, keys: list[str], order: list[str], prefix: str, fields: list[str], most: int) -> DataFrame:
    """The first rows of an entity's list as flat fields prefix_i_name; the cap is the form's own."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    each = rows.withColumn("_i", n).filter(F.col("_i") <= most)
    pairs = F.array(*[F.struct(F.concat(F.lit(f"{prefix}_"), F.col("_i").cast("string"), F.lit(f"_{f}")).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])
    return each.select(*keys, F.inline(pairs))


def tolerant_json(c: Column) -> Column:
    """M06 up to the repair tier: fences go; then the text, its braces' span, less trailing commas, with a closing
    brace added, is read, the first that parses; else an empty map."""
    bare = F.trim(F.regexp_replace(c, r"```(?:json)?", ""))
    span = F.nullif(F.regexp_extract(bare, r"(?s)(\{.*\})", 1), F.lit(""))
    comma = F.regexp_replace(F.coalesce(span, bare), r",\s*([}\]])", "$1")
    closed = F.concat(F.regexp_replace(bare, r"[,\s]+$", ""), F.lit("}"))
    read = lambda x: F.when(F.try_parse_json(x).isNotNull() & x.rlike(r"(?s)^\s*\{"), F.from_json(x, "map<string,string>"))
    return F.coalesce(read(bare), read(span), read(comma), read(closed), F.create_map().cast("map<string,string>"))


def cell(header: Column, cells: Column, name: str) -> Column:
    """The cell under a header; missing cells are empty."""
    return F.coalesce(F.try_element_at(F.map_from_arrays(header, F.transform(header, lambda h, i: F.coalesce(F.get(cells, i), F.lit("")))), F.lit(name)), F.lit(""))


def field_json(rows: DataFrame, keys: list[str], field: str, value: str, name: str) -> DataFrame:
    """A document's fields as one JSON object, keys sorted."""
    entries = F.array_sort(F.collect_list(F.struct(F.col(field).alias("k"), F.col(value).alias("v"))))
    return rows.groupBy(*keys).agg(F.to_json(F.map_from_entries(entries)).alias(name))


def preference_pairs(judged: DataFrame, keys: list[str]) -> DataFrame:
    """What was expected against what was extracted, where they differ."""
    chosen = field_json(judged, keys, "field", "expected", "chosen")
    return chosen.join(field_json(judged, keys, "field", "extracted", "rejected"), keys).filter("chosen <> rejected")


def rows_by_median(blocks: DataFrame, keys: list[str], tolerance: float, least: int = 3) -> DataFrame:
    """A block joins the open row while it lies within the tolerance of the median of that row; rows of fewer
    than the least number of blocks go. Blocks come by y, so a row's ys are sorted and the median is its middle."""
    entry = F.struct(F.col("y").cast("double").alias("y"), F.col("ord").cast("long").alias("ord"))
    zero = F.struct(F.array().cast("array<double>").alias("ys"), F.lit(0).alias("row"), F.array().cast("array<struct<ord:bigint,row:int>>").alias("out"))

    def step(s: Column, b: Column) -> Column:
        n = F.size(s["ys"])
        middle = (F.get(s["ys"], F.floor((n - 1) / 2).cast("int")) + F.get(s["ys"], F.floor(n / 2).cast("int"))) / 2
        on = F.coalesce(F.abs(b["y"] - middle) <= tolerance, F.lit(False))
        row = F.when(on, s["row"]).otherwise(s["row"] + 1)
        return F.struct(F.when(on, F.concat(s["ys"], F.array(b["y"]))).otherwise(F.array(b["y"])).alias("ys"), row.alias("row"), F.concat(s["out"], F.array(F.struct(b["ord"].alias("ord"), row.alias("row")))).alias("out"))

    pages = blocks.groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias("_b"))
    found = pages.select(*keys, F.inline(F.aggregate("_b", zero, step)["out"]))
    return found.withColumn("_n", F.count("*").over(Window.partitionBy(*keys, "row"))).filter(F.col("_n") >= least).drop("_n")


def table_regions(rows: DataFrame, keys: list[str], blocks: int = 3, lines: int = 3) -> DataFrame:
    """Pages on which enough rows have enough blocks, with the extent of those rows."""
    wide = rows.groupBy(*keys, "row").agg(F.count("*").alias("n"), F.min("y").alias("top"), F.max("y").alias("bottom")).filter(F.col("n") >= blocks)
    return wide.groupBy(*keys).agg(F.count("*").alias("rows"), F.min("top").alias("top"), F.max("bottom").alias("bottom")).filter(F.col("rows") >= lines)


def reflected_state(turns: DataFrame, keep: int = 5) -> DataFrame:
    """Saves written in the last turns of a conversation, save(field='value'); newer ones win."""
    back = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    late = turns.withColumn("_back", back).filter(F.col("_back") <= keep)
    names, values = (F.regexp_extract_all("text", F.lit(r"save\((\w+)='([^']*)'\)"), F.lit(g)) for g in (1, 2))
    each = late.select("conv_id", "_back", F.posexplode(F.arrays_zip(names.alias("field"), values.alias("value"))).alias("_at", "_s"))
    return each.groupBy("conv_id", F.col("_s.field").alias("field")).agg(F.min_by(F.col("_s.value"), F.struct("_back", -F.col("_at"))).alias("value"))

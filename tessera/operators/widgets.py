"""Form widgets, as a file back end reads or fills them.

Widgets are rows of doc, page, ord, field, kind, tooltip, value, x0, y0, x1, y1 (points, 72 an inch) and read_only. Reading
and writing the files is a back end's work (sources/adapters.py); what is taken from the widgets is said here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.compare import strip
from tessera.functions.text import suffix
from tessera.functions.values import category

#: What ticks a box of a form that is filled in.
FILLED_TICK = ["1", "True", "true", "Yes", "yes"]


def widget_values(widgets: DataFrame) -> DataFrame:
    """Doc, field, value: what a filled form holds. Boxes are Off or 1; empty, null and none are no values; of
    several widgets of a field the last one counts."""
    s = strip(F.col("value"))
    said = widgets.filter((F.col("field") != "") & ~F.lower(s).isin("", "null", "none"))
    value = F.when(F.col("kind") != "checkbox", s).when(F.lower(s) == "off", "Off").otherwise("1")
    return said.groupBy("doc", "field").agg(F.max_by(value, F.struct("page", "ord")).alias("value"))


def widget_catalog(widgets: DataFrame, dpi: int = 300) -> DataFrame:
    """A form's fields, the first widget of each name: page, kind, tooltip, place at the resolution to one
    decimal, category, suffix, base name and a default other than Off or empty."""
    one = widgets.filter(F.col("field") != "").groupBy("doc", "field").agg(F.min_by(F.struct("page", "kind", "tooltip", "value", "x0", "y0", "x1", "y1"), F.struct("page", "ord")).alias("_w"))
    end = suffix(F.col("field"))
    place = [F.bround(F.col(f"_w.{c}") * (dpi / 72.0), 1).alias(c) for c in ("x0", "y0", "x1", "y1")]
    default = F.when(~strip(F.col("_w.value")).isin("", "Off"), F.col("_w.value")).alias("default_value")
    return one.select("doc", "field", "_w.page", "_w.kind", "_w.tooltip", *place, category(F.col("field")).alias("category"), F.concat(F.lit("_"), end).alias("suffix"), F.regexp_replace(F.when(end.isNotNull(), F.col("field")), "_[^_]*$", "").alias("base_name"), default)


def sections(catalog: DataFrame) -> DataFrame:
    """Doc, page, category, fields: how the fields of a catalog lie together."""
    return catalog.groupBy("doc", "page", "category").agg(F.array_sort(F.collect_list("field")).alias("fields"))


def fill_plan(widgets: DataFrame, values: DataFrame) -> DataFrame:
    """Doc, page, ord, field, value: what goes into which widget. Widgets that are read-only or have no area stay
    as they are; a box gets True or False."""
    open_ = ~F.coalesce("read_only", F.lit(False)) & (F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0"))
    met = widgets.drop("value").filter(open_).join(values.select("doc", "field", F.col("value").alias("_v")), ["doc", "field"])
    said = F.when(F.col("kind") != "checkbox", F.col("_v")).when(F.col("_v").isin(FILLED_TICK), "True").otherwise("False")
    return met.select("doc", "page", "ord", "field", said.alias("value"))


def fill_counts(widgets: DataFrame, values: DataFrame) -> DataFrame:
    """Doc, filled, skipped: widgets filled; widgets left alone and values beyond those without a widget."""
    plan = fill_plan(widgets, values).groupBy("doc").agg(F.count("*").alias("filled"), F.count_distinct("field").alias("_fields"))
    met = widgets.join(values.select("doc", "field"), ["doc", "field"], "left_semi").groupBy("doc").agg(F.count("*").alias("_met"))
    said = values.groupBy("doc").agg(F.count_distinct("field").alias("_said"))
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    joined = said.join(met, "doc", "left").join(plan, "doc", "left").select("doc", n("filled").alias("filled"), (n("_met") - n("filled")).alias("_left"), n("_said").alias("_said"), n("_fields").alias("_fields"))
    lost = F.greatest(F.lit(0), F.col("_said") - F.col("_fields") - F.col("_left"))
    return joined.select("doc", "filled", (F.col("_left") + lost).alias("skipped"))

"""From labels and entities to form fields, and what is built from them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.compare import strip
from tessera.functions.values import y_region
from tessera.operators.labels import label_form
from tessera.operators.retrieval import nearest

#: Of a driver list with numbered fields, the first number, the fields a row and the rows a form has.
FIRST_NUMBER, ROW_WIDTH, MOST_ROWS = 15, 20, 24


def ranked_lookup(pairs: DataFrame, label_map: DataFrame) -> DataFrame:
    """Doc, field, value, confidence. Pairs (doc, ord, label, value, page, y) meet the map (label in its normal form,
    ord, field, page, y_region, confidence, seen) by label. Of several fields the one of the highest confidence times
    seen wins, times 1.2 on its page and 1.1 in its part of the page, the first in the map on ties; a field takes the
    first pair that reaches it. Labels of fewer than two characters and empty values are passed over."""
    asked = pairs.select("doc", F.col("ord").alias("_ord"), label_form(F.col("label")).alias("label"), strip(F.col("value")).alias("value"), F.col("page").alias("_page"), F.col("y").cast("double").alias("_y"))
    asked = asked.filter((F.char_length("label") >= 2) & (F.col("value") != ""))
    met = asked.join(label_map.select("label", "ord", "field", "page", "y_region", "confidence", F.coalesce("seen", F.lit(1)).alias("seen")), "label")
    here = F.when((F.col("_page") > 0) & (F.col("page") == F.col("_page")), 1.2).otherwise(1.0)
    near = F.when((F.col("_y") > 0) & (F.col("y_region") == y_region(F.col("_y"))), 1.1).otherwise(1.0)
    score = F.col("confidence") * F.col("seen") * here * near
    best = met.groupBy("doc", "_ord").agg(F.min_by(F.struct("field", "value", "confidence"), F.struct(-score, "ord")).alias("_b")).select("doc", "_ord", "_b.*")
    return best.groupBy("doc", "field").agg(F.min_by(F.struct("value", "confidence"), "_ord").alias("_b")).select("doc", "field", "_b.*")


def numbered_fields(rows: DataFrame, catalog: DataFrame, columns: dict[int, str], marital: str | None = None) -> DataFrame:
    """Doc, field, value of a list (doc, ord, ..) on a form whose fields are TextN[0], N counting on by row and
    column: column 0 is the row's number, columns says what the others hold. Rows beyond the form's, empty values and
    fields the catalog lacks go. The marital status has names of its own."""
    n = F.row_number().over(Window.partitionBy("doc").orderBy("ord")) - 1
    text = lambda c: strip(F.col(c).cast("string"))
    name = lambda column: F.concat(F.lit("Text"), (F.lit(FIRST_NUMBER + column) + ROW_WIDTH * F.col("_n")).cast("string"), F.lit("[0]"))
    cells = [F.struct(name(0).alias("field"), (F.col("_n") + 1).cast("string").alias("value"))]
    cells += [F.struct(name(at).alias("field"), text(c).alias("value")) for at, c in columns.items()]
    if marital:
        special = F.when(F.col("_n") == 0, "marital[0]").otherwise(F.concat(F.lit("maritalstatus"), F.col("_n").cast("string"), F.lit("[0]")))
        cells.append(F.struct(special.alias("field"), text(marital).alias("value")))
    each = rows.withColumn("_n", n).filter(F.col("_n") < MOST_ROWS).select("doc", F.inline(F.array(*cells)))
    return each.filter(F.col("value") != "").join(catalog.select("field"), "field", "left_semi").select("doc", "field", "value")


def static_fields(entities: DataFrame, forms: DataFrame, mapping: DataFrame, completed: Column, dated: list[str]) -> DataFrame:
    """Doc, form, field, value: entity values (doc, path, value) in the fields that the mapping (form, path, field)
    names, for the forms (doc, form) a document was given; dated forms also get the day of completion."""
    said = entities.filter(strip(F.col("value")) != "").join(mapping, "path").join(forms.distinct(), ["doc", "form"], "left_semi")
    day = forms.distinct().filter(F.col("form").isin(*dated)).select("doc", "form", F.lit("Form_CompletionDate_A").alias("field"), completed.alias("value"))
    return said.select("doc", "form", "field", "value").unionByName(day)


def pair_rows(pairs: DataFrame) -> DataFrame:
    """Pairs of structs (label, value: text, x, y) as flat rows."""
    return pairs.select("doc", strip(F.col("label.text")).alias("label"), strip(F.col("value.text")).alias("value"), "page", "confidence", F.col("label.y").alias("label_y"), F.col("value.y").alias("value_y"), F.col("label.x").alias("label_x"))


def flat_list(rows: DataFrame, items: str, prefix: str, fields: dict[str, str], optional: dict[str, str] | None = None) -> DataFrame:
    """Doc, field, value of an array of structs, prefix_i_name from 1 on; a field that is missing is empty, an
    optional one is left out."""
    each = rows.select("doc", F.posexplode(items).alias("_i", "_e"))
    name = lambda f: F.concat(F.lit(f"{prefix}_"), (F.col("_i") + 1).cast("string"), F.lit(f"_{f}"))
    value = lambda c: F.coalesce(F.col(f"_e.{c}").cast("string"), F.lit(""))
    cells = [F.struct(name(f).alias("field"), value(c).alias("value"), F.lit(True).alias("_must")) for f, c in fields.items()]
    cells += [F.struct(name(f).alias("field"), value(c).alias("value"), F.lit(False).alias("_must")) for f, c in (optional or {}).items()]
    return each.select("doc", F.inline(F.array(*cells))).filter(F.col("_must") | (F.col("value") != "")).drop("_must")


def search_all(queries: DataFrame, collections: dict[str, DataFrame], k: int) -> DataFrame:
    """Each query's k best of every collection, with the collection's name."""
    return reduce(DataFrame.unionByName, [nearest(queries, items, k).withColumn("collection", F.lit(name)) for name, items in collections.items()])


def markdown_pairs(pages: DataFrame) -> DataFrame:
    """Doc, part, line, cell, label, value of a page's Markdown. Part 0: of a run of table rows, the first row's cells
    over each later row's; a line that rules off ends the run. Elsewhere "label: value" of one line. Part 1: a line that
    ends in a colon with the line after it.

    Runs are islands of rows, so lines are told apart by the line before them: one sort by document, no walk."""
    cells = F.filter(F.transform(F.regexp_extract_all("line", F.lit(r"\|([^|]+)\|"), F.lit(1)), strip), lambda c: c != "")
    lines = pages.select("doc", F.posexplode(F.split("text", "\n")).alias("at_line", "line")).withColumn("cells", cells)
    kind = F.when(F.size("cells") < 2, "text").when(F.col("cells")[0].rlike(r"^[-:\s]+$"), "rule").otherwise("row")
    w = Window.partitionBy("doc").orderBy("at_line")
    seen = lines.withColumn("kind", kind).withColumns({"before": F.lag("kind").over(w), "after": F.lead("line").over(w)})
    opens = (F.col("kind") == "row") & (F.coalesce("before", F.lit("text")) != "row")
    seen = seen.withColumn("header", F.last(F.when(opens, F.col("cells")), ignorenulls=True).over(w))
    plain = lambda c: F.lower(F.regexp_replace(strip(c), r"\s+", " "))
    under = F.transform("header", lambda h, i: F.struct(h.alias("label"), F.get(F.col("cells"), i).alias("value")))
    table = F.when((F.col("kind") == "row") & ~opens, F.filter(under, lambda p: p["value"].isNotNull() & (plain(p["value"]) != plain(p["label"]))))
    label, value = strip(F.substring_index("line", ":", 1)), strip(F.regexp_extract("line", "(?s)^[^:]*:(.*)$", 1))
    beside = (F.col("kind") != "row") & ~((F.col("kind") == "rule") & (F.coalesce("before", F.lit("text")) == "row"))
    colon = F.when(beside & F.col("line").contains(":") & (F.char_length("line") < 200) & (label != "") & (value != "") & (F.char_length(label) < 80), F.array(F.struct(label.alias("label"), value.alias("value"))))
    s, following = strip(F.col("line")), strip(F.col("after"))
    below = s.endswith(":") & F.char_length(s).between(2, 100) & (following != "") & ~following.rlike("^[|#]")
    name = strip(F.regexp_replace(s, ":$", ""))
    next_line = F.when(below, F.array(F.struct(name.alias("label"), following.alias("value"))))
    parts = F.array(F.struct(F.lit(0).alias("part"), F.coalesce(table, colon).alias("found")), F.struct(F.lit(1).alias("part"), next_line.alias("found")))
    each = seen.select("doc", F.col("at_line").alias("line"), F.inline(parts))
    return each.select("doc", "part", "line", F.posexplode("found").alias("cell", "_p")).select("doc", "part", "line", "cell", "_p.label", "_p.value")


def page_examples(fields: DataFrame) -> DataFrame:
    """Doc, page, type, answer: a page's answers as JSON, whole (full_page), by category and for its boxes alone.
    Fields (doc, page, category, kind, field, value) without a value are left out, of boxes only where the example is
    not theirs: there they are false. Keys are sorted; a page without an answer gives no example."""
    box, ticked, off = F.col("kind") == "checkbox", F.col("value").isin("true", "1", "Yes"), F.col("value").isin("false", "Off", "0", "No")
    quoted = lambda c: F.expr(f"substring(to_json(array({c})), 2, char_length(to_json(array({c}))) - 2)")
    answer = F.when(box & ticked, "true").when(box & off, "false").when(F.col("value").isNotNull() & ~F.col("value").isin("", "Off"), quoted("value"))
    kinds = F.array(
        F.struct(F.lit("full_page").alias("type"), answer.alias("answer")),
        F.struct(F.concat(F.lit("category_"), F.coalesce("category", F.lit("general"))).alias("type"), answer.alias("answer")),
        F.struct(F.when(box, "checkbox").alias("type"), F.when(box, F.coalesce(answer, F.lit("false"))).alias("answer")),
    )
    each = fields.select("doc", "page", "field", quoted("field").alias("key"), F.inline(kinds)).filter("type IS NOT NULL AND answer IS NOT NULL")
    entries = F.transform(F.array_sort(F.collect_list(F.struct("field", "key", "answer"))), lambda e: F.concat(e["key"], F.lit(": "), e["answer"]))
    return each.groupBy("doc", "page", "type").agg(F.concat(F.lit("{"), F.array_join(entries, ", "), F.lit("}")).alias("answer"))

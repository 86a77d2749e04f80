"""Matching positioned blocks to a form's catalog.

Blocks have doc, page, ord, text, x, y (centres), x0, y0, x1, y1. Catalog rows (fields, anchors) are of one form; they meet
the blocks on page, so a block sees its page's catalog rows alone, and a document's blocks never see another document's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.compare import strip
from tessera.functions.values import invalid_for, is_common_label, match_basis, may_prefill
from tessera.functions.text import looks_like_label

# Texts that tick a box; confidence and its parts; shares of dark pixels.
MARKS = ["x", "1", "y", "yes", "$", "s", "checked", "✓", "✗"]
BASE, CONTAINED, TOP = 0.85, 0.05, 0.93
FAR, IOU = 500, 0.15
DARK, TICKED = 140, 0.22


def _meets(anchor: Column, text: Column) -> Column:
    return text.contains(anchor) | anchor.contains(text)


def anchor_shift(blocks: DataFrame, anchors: DataFrame) -> DataFrame:
    """Doc, page, dx, dy, the median shift over the page's anchors; an anchor meets the nearest block that holds its
    text or is held by it, within FAR."""
    a = anchors.select("page", F.upper(strip(F.col("text"))).alias("_anchor"), F.col("x").alias("_ax"), F.col("y").alias("_ay"))
    met = blocks.select("doc", "page", "ord", "x", "y", F.upper(strip(F.col("text"))).alias("_text")).join(F.broadcast(a), "page").filter(_meets(F.col("_anchor"), F.col("_text")))
    far = F.abs(F.col("x") - F.col("_ax")) + F.abs(F.col("y") - F.col("_ay"))
    best = met.withColumn("_far", far).filter(F.col("_far") < FAR).groupBy("doc", "page", "_anchor", "_ax", "_ay").agg(F.min_by(F.struct("x", "y"), F.struct("_far", "ord")).alias("_b"))
    return best.groupBy("doc", "page").agg(F.median(F.col("_b.x") - F.col("_ax")).alias("dx"), F.median(F.col("_b.y") - F.col("_ay")).alias("dy"))


def mean_shift(blocks: DataFrame, anchors: DataFrame) -> DataFrame:
    """Doc, dx, dy, the mean shift over all pages' anchors, each met by the first block in order."""
    a = anchors.select("page", F.lower("text").alias("_anchor"), F.col("x").alias("_ax"), F.col("y").alias("_ay"))
    met = blocks.select("doc", "page", "ord", "x", "y", F.lower(strip(F.col("text"))).alias("_text")).join(F.broadcast(a), "page").filter(_meets(F.col("_anchor"), F.col("_text")))
    first = met.groupBy("doc", "page", "_anchor", "_ax", "_ay").agg(F.min_by(F.struct("x", "y"), "ord").alias("_b"))
    return first.groupBy("doc").agg(F.avg(F.col("_b.x") - F.col("_ax")).alias("dx"), F.avg(F.col("_b.y") - F.col("_ay")).alias("dy"))


def ticked_boxes(blocks: DataFrame, boxes: DataFrame, margin: float = 5.0) -> DataFrame:
    """Doc, field of boxes (page, field, x0, y0, x1, y1) with a marker's centre in or at most margin beside them."""
    marks = blocks.filter(F.lower(strip(F.col("text"))).isin(MARKS)).select("doc", "page", "x", "y")
    near = F.col("x").between(F.col("x0") - margin, F.col("x1") + margin) & F.col("y").between(F.col("y0") - margin, F.col("y1") + margin)
    return marks.join(F.broadcast(boxes.select("page", "field", "x0", "y0", "x1", "y1")), "page").filter(near).select("doc", "field").distinct()


def dark_share(pixels: Column, width: Column, height: Column) -> Column:
    """Share of grey values under DARK inside a box's inset of a fifth; pixels run row by row. Null under 4 pixels a
    side or 2 inside."""
    ix, iy = (F.greatest(F.lit(1), F.floor(side * 0.2).cast("int")) for side in (width, height))
    inside = F.filter(pixels, lambda p, i: (i % width >= ix) & (i % width < width - ix) & (F.floor(i / width) >= iy) & (F.floor(i / width) < height - iy))
    share = F.size(F.filter(inside, lambda p: p < DARK)) / F.size(inside)
    return F.when((width >= 4) & (height >= 4) & (width - 2 * ix >= 2) & (height - 2 * iy >= 2), share)


def box_decision(current: Column, ratio: Column, zoom: Column) -> Column:
    """The box's value after the pixels: between 0.10 and 0.28 the mean with the zoomed share decides at 0.08 and
    0.20 (no zoom: as if clear), else under 0.05 an unknown box is Off, under 0.10 a tick goes, over 0.28 one is set."""
    mean = (ratio + zoom) / 2
    off = current.isin("Off", "false", "False")
    unsure = ratio.between(0.10, 0.28) & zoom.isNotNull()
    by_zoom = F.when((current.isNull() | (current == "1")) & (mean < 0.08), "Off").when((current.isNull() | off) & (mean > 0.20), "1").otherwise(current)
    clear = F.when(current.isNull() & (ratio < 0.05), "Off").when((current == "1") & (ratio < 0.10), "Off").when(off & (ratio > 0.28), "1").otherwise(current)
    return F.when(ratio.isNull(), current).when(unsure, by_zoom).otherwise(clear)


def guided_pairs(blocks: DataFrame, pairs: DataFrame, gap: int = 300) -> DataFrame:
    """Doc, n, label_ord, value_ord: pairs (doc, n, label, value) of strings met with blocks, the value right of the
    label within the gap, the smallest gap first; a value block is used once, by the pair that comes first.

    Candidates are found by joins on doc; only they, a few a pair, go to the greedy choice of a document.
    """
    form = lambda c: strip(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "))
    b = blocks.select("doc", "page", "ord", "y0", "y1", "x0", "x1", form(F.col("text")).alias("_t")).filter("_t <> ''")
    p = pairs.select("doc", "n", form(F.col("label")).alias("_l"), form(F.col("value")).alias("_v")).filter("_l <> '' AND _v <> ''")
    left = p.join(b, "doc").filter(_meets(F.col("_l"), F.col("_t"))).select("doc", "n", "page", F.col("ord").alias("label_ord"), F.col("x1").alias("_right"), F.col("y0").alias("_top"), F.col("y1").alias("_low"))
    right = p.join(b, "doc").filter(_meets(F.col("_v"), F.col("_t"))).select("doc", "n", "page", F.col("ord").alias("value_ord"), "x0", "y0", "y1")
    met = left.join(right, ["doc", "n", "page"]).withColumn("gap", F.col("x0") - F.col("_right"))
    met = met.filter(F.col("gap").between(0, gap) & (F.col("y0") <= F.col("_low")) & (F.col("y1") >= F.col("_top")))
    ordered = met.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("n", "gap", "label_ord", "value_ord"))).alias("all"))

    def take(done: Column, c: Column) -> Column:
        free = ~F.exists(done, lambda d: (d["n"] == c["n"]) | (d["value_ord"] == c["value_ord"]))
        return F.when(free, F.concat(done, F.array(c))).otherwise(done)

    empty = F.filter("all", lambda c: F.lit(False))
    return ordered.select("doc", F.inline(F.aggregate("all", empty, take))).select("doc", "n", "label_ord", "value_ord", "gap")


def prefill(pairs: DataFrame, catalog: DataFrame, given: DataFrame) -> DataFrame:
    """Doc, field, value, basis: pairs (doc, n, label, value) into the catalog's fields (field, kind, tooltip).

    A match holds at least the label or one of its words as a part of the field's name or tooltip, so the first three
    letters of these meet the catalog's runs of two and three letters by equality; what meets is verified. Of the fields
    a pair matches, the longest name wins (the lower name of equal ones); a field that given (doc, field) has or an
    earlier pair took is not filled again.
    """
    label = strip(F.regexp_replace(F.regexp_replace(F.lower("label"), r"[:#]", " "), r"\s+", " "))
    p = pairs.select("doc", "n", label.alias("_label"), strip(F.col("value")).alias("value")).filter("char_length(_label) >= 2 AND value <> ''")
    starts = F.transform(F.filter(F.array_append(F.split("_label", " "), F.col("_label")), lambda w: F.char_length(w) > 1), lambda w: F.substring(w, 1, 3))
    labels = p.select("_label").distinct().select("_label", F.explode(F.array_distinct(starts)).alias("_gram"))
    said = F.lower(F.concat_ws(" \n", F.translate("field", "_", " "), "tooltip"))
    runs = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(said) - n + 1, F.lit(1))), lambda i: F.substr(said, i, F.lit(n)))
    grams = catalog.select("field", "kind", "tooltip", F.explode(F.array_distinct(F.concat(runs(2), runs(3)))).alias("_gram"))
    basis = match_basis(F.col("_label"), F.col("field"), F.col("tooltip"))
    fits = labels.join(grams, "_gram").drop("_gram").distinct().withColumn("basis", basis).filter(F.col("basis").isNotNull())
    met = p.join(fits, "_label").join(given.select("doc", "field"), ["doc", "field"], "left_anti")
    ok = may_prefill(F.col("field"), F.col("kind"), F.col("tooltip"), F.col("_label"), F.col("value"))
    met = met.withColumn("_ok", ok).withColumn("_rank", F.struct(-F.char_length("field"), "field"))
    by_doc = met.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("n", "_rank", "field", "value", "basis", "_ok"))).alias("all"))

    def take(s: Column, c: Column) -> Column:
        """A pair takes its best field that is free; a value that the field does not allow spends the pair all the same."""
        free = (s["n"] != c["n"]) & ~F.exists(s["done"], lambda d: d["field"] == c["field"])
        done = F.when(free & c["_ok"], F.concat(s["done"], F.array(c))).otherwise(s["done"])
        return F.struct(F.when(free, c["n"]).otherwise(s["n"]).alias("n"), done.alias("done"))

    start = F.struct(F.lit(-1).cast("long").alias("n"), F.filter("all", lambda c: F.lit(False)).alias("done"))
    return by_doc.select("doc", F.inline(F.aggregate("all", start, take)["done"])).select("doc", "field", "value", "basis")


def positional(blocks: DataFrame, fields: DataFrame, anchors: DataFrame) -> DataFrame:
    """Doc, field, value, method, confidence of fields (page, field, kind, x0, y0, x1, y1) at their shifted places.

    Boxes are ticked by markers; text fields take the blocks whose centres they hold, in reading order, or else the block
    of the largest overlap from IOU on that is no label. Confidence is BASE scaled by how many pages found their anchors.
    """
    pages = blocks.groupBy("doc", "page").agg(F.collect_list(F.struct("ord", "text", "x", "y", "x0", "y0", "x1", "y1")).alias("_b"))  # a page's blocks go along with it, so they need no join
    n_anchors = anchors.count()
    shift = anchor_shift(blocks, anchors)
    moved = F.count_if((F.col("dx") != 0) | (F.col("dy") != 0)).over(Window.partitionBy("doc"))
    places = pages.join(shift, ["doc", "page"], "left").fillna({"dx": 0.0, "dy": 0.0}).withColumn("_n", moved)
    places = places.withColumn("_q", F.when(F.col("_n") > 0, F.least(F.lit(1.0), 0.7 + 0.3 * F.col("_n") / max(1, n_anchors))).otherwise(0.7 if n_anchors else 1.0))
    at = lambda c, d: (F.col(f"f.{c}") + F.col(d)).alias(f"_{c}")
    placed = places.join(F.broadcast(fields.alias("f")), "page").select("doc", "page", "_q", "f.field", "f.kind", at("x0", "dx"), at("x1", "dx"), at("y0", "dy"), at("y1", "dy"), "_b")
    met = placed.select(*[c for c in placed.columns if c != "_b"], F.inline("_b"))
    box = F.col("kind").isin("checkbox", "radio")
    inside = F.col("x").between(F.col("_x0"), F.col("_x1")) & F.col("y").between(F.col("_y0"), F.col("_y1"))
    near = F.col("x").between(F.col("_x0") - 5, F.col("_x1") + 5) & F.col("y").between(F.col("_y0") - 5, F.col("_y1") + 5)
    drift = (F.col("_x1") > F.col("_x0")) & (F.col("x1") - F.col("x0") > 3 * (F.col("_x1") - F.col("_x0")))
    width = F.least("_x1", "x1") - F.greatest("_x0", "x0")
    height = F.least("_y1", "y1") - F.greatest("_y0", "y0")
    common = F.when((width > 0) & (height > 0), width * height).otherwise(0.0)
    union = (F.col("_x1") - F.col("_x0")) * (F.col("_y1") - F.col("_y0")) + (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")) - common
    iou = F.when(union > 0, common / union).otherwise(0.0)
    text = strip(F.col("text"))
    met = met.filter(near | (common > 0)).withColumn("_iou", iou)
    held = F.when(~box & inside & ~drift & (text != ""), F.struct("y", "x", "ord", text.alias("text")))
    lap = F.when(~box & (iou >= IOU), text)
    seen = met.groupBy("doc", "field", "kind", "_q").agg(
        F.array_sort(F.collect_list(held)).alias("_held"), F.max_by(lap, F.when(lap.isNotNull(), F.struct(iou, -F.col("ord")))).alias("_lap"), F.max(box & near & F.lower(text).isin(MARKS)).alias("_mark")
    )
    joined = F.array_join(F.transform("_held", lambda h: h["text"]), " ")
    lap = F.when((F.col("_lap") != "") & ~looks_like_label(F.col("_lap")), F.col("_lap"))
    value = F.when(box, F.when(F.col("_mark"), "1")).when(joined != "", joined).otherwise(lap)
    method = F.when(box, "positional_checkbox").when(joined != "", "positional_containment").otherwise("positional_iou")
    bonus = F.when(method == "positional_containment", CONTAINED).otherwise(0.0)
    told = seen.withColumn("value", value).withColumn("method", method).filter(F.col("value").isNotNull() & (box | ~invalid_for(F.col("field"), F.col("value"))))
    return told.select("doc", "field", "value", "method", F.round(F.least(F.lit(TOP), F.lit(BASE) * F.col("_q") + bonus), 3).alias("confidence"))


def topmost(blocks: DataFrame, labels: DataFrame) -> DataFrame:
    """Doc, label, x, y of the topmost block (the first in order of equal ones) that holds each label's text within
    its bounds (label, x_min, x_max, y_min, y_max)."""
    met = blocks.join(F.broadcast(labels), F.col("x").between(F.col("x_min"), F.col("x_max")) & F.col("y").between(F.col("y_min"), F.col("y_max")) & F.contains(F.lower("text"), F.lower("label")))
    return met.groupBy("doc", "label").agg(F.min_by(F.struct("x", "y"), F.struct("y", "ord")).alias("_b")).select("doc", "label", "_b.x", "_b.y")


def below_label(blocks: DataFrame, labels: DataFrame, regions: DataFrame, y_offset: int = 20, y_range: int = 80) -> DataFrame:
    """Doc, label, text: the longest (then surest, then first) text below each label that is no common label.

    The region runs from 100 left of the label to 800 right of it, y_offset to y_offset + y_range below; where a document
    lacks the label, regions (label, x_min, x_max, y_min, y_max) gives it.
    """
    every = blocks.select("doc").distinct().join(F.broadcast(labels))
    found = every.join(topmost(blocks, labels).withColumnRenamed("x", "_lx").withColumnRenamed("y", "_ly"), ["doc", "label"], "left")
    r = found.select("doc", "label", "_lx", "_ly").join(F.broadcast(regions.toDF("label", "r0", "r1", "r2", "r3")), "label", "left")
    bounds = r.select("doc", "label", F.coalesce(F.greatest(F.lit(0), F.col("_lx") - 100), F.col("r0")).alias("_x0"), F.coalesce(F.col("_lx") + 800, F.col("r1")).alias("_x1"), F.coalesce(F.col("_ly") + y_offset, F.col("r2")).alias("_y0"), F.coalesce(F.col("_ly") + y_offset + y_range, F.col("r3")).alias("_y1"))
    met = bounds.join(blocks.select("doc", "ord", "x", "y", strip(F.col("text")).alias("text"), "confidence"), "doc")
    met = met.filter(F.col("x").between(F.col("_x0"), F.col("_x1")) & F.col("y").between(F.col("_y0"), F.col("_y1")) & (F.col("text") != "") & ~is_common_label(F.col("text")))
    return met.groupBy("doc", "label").agg(F.max_by("text", F.struct(F.char_length("text"), "confidence", -F.col("y"), -F.col("x"), -F.col("ord"))).alias("text"))


def picks(blocks: DataFrame, x_min: float, x_max: float) -> DataFrame:
    """Doc, row, amounts (whole numbers over 0 by x), number (the first run of digits), naic (five digits), policy
    (letters, a dash perhaps, five digits or more) in an x interval; blocks have a row."""
    t = strip(F.col("text"))
    plain = F.translate(t, ",$S", "")
    amount = F.when(~t.isin("$", "S", "5", "BA", "PER", "peR", "pER") & plain.rlike(r"^\d+(\.\d*)?$"), F.floor(plain.try_cast("double")).cast("long"))
    place = F.struct("x", "ord")
    inside = blocks.filter(F.col("x").between(x_min, x_max))
    first = lambda when: F.min_by(F.when(when, t), F.when(when, place))
    amounts = F.transform(F.array_sort(F.collect_list(F.when(amount > 0, F.struct("x", "ord", amount.alias("v"))))), lambda s: s["v"])
    return inside.groupBy("doc", "row").agg(amounts.alias("amounts"), first(t.rlike(r"^\d+$")).alias("number"), first(t.rlike(r"^\d{5}$")).alias("naic"), first(t.rlike(r"^[A-Z]{1,4}-?\d{5,}$")).alias("policy"))


def consensus(value: Column, page_text: Column, spatial: Column) -> Column:
    """How far a value is borne out by the text: 1.0 where found or placed, 0.9 or 0.7 by its words, 0.5, 0.8 short."""
    v, text = strip(F.lower(value)), F.lower(F.coalesce(page_text, F.lit("")))
    words = F.filter(F.split(v, r"\s+"), lambda w: F.char_length(w) > 2)
    hits = F.size(F.filter(words, lambda w: F.contains(text, w)))
    return F.when(F.coalesce(v, F.lit("")) == "", 0.0).when(spatial | text.contains(v), 1.0).when(F.char_length(v) <= 3, 0.8).when(hits == 0, 0.5).when(hits < F.size(words), 0.7).otherwise(0.9)


def kept_by_consensus(confidence: Column) -> Column:
    """Values that neither the text nor a place bears out go."""
    return ~confidence.isin(0.0, 0.5)


def effective_confidence(ensemble: Column, source: Column, bbox: Column) -> Column:
    """The ensemble's, at most 0.80 where the text bears out less than 0.7; without one the source's, scaled."""
    b = F.coalesce(bbox, F.lit(0.5))
    return F.round(F.coalesce(F.when(b < 0.7, F.when(ensemble > 0.80, 0.80).otherwise(ensemble)).otherwise(ensemble), source * (0.5 + 0.5 * b)), 3)


def scaled(df: DataFrame, columns: list[str], ratio: float, dx: float = 0.0, dy: float = 0.0) -> DataFrame:
    """Regions in another resolution, then moved."""
    return df.withColumns({c: F.col(c) * ratio + (dx if c.startswith("x") else dy) for c in columns})


def as_text(blocks: DataFrame, tolerance: int) -> DataFrame:
    """doc, page, text: a page's blocks row by row, cells parted by a bar, for a reader."""
    w = Window.partitionBy("doc", "page").orderBy("y", "x", "ord")
    opens = F.when(F.col("y") - F.lag("y").over(w) > tolerance, 1).otherwise(0)
    rows = blocks.withColumn("_new", opens).withColumn("_row", F.sum("_new").over(w))
    lines = rows.groupBy("doc", "page", "_row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "ord", "text"))), lambda s: s["text"]), " | ").alias("_line"))
    return lines.groupBy("doc", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_row", "_line"))), lambda s: s["_line"]), "\n").alias("text"))


def gap_regions(rows: DataFrame, gap: int = 45, padding: int = 15, least: int = 60) -> DataFrame:
    """Doc, page, region, x_min..y_max: rows (doc, page, y, x_min..y_max) and the page's width and height. A row more
    than the gap below the end of the row before it opens a region; regions are padded, those lower than the least go,
    the rest are cut at the page."""
    w = Window.partitionBy("doc", "page").orderBy("y", "y_min")
    end = F.lag("y_max").over(w)
    opens = F.coalesce((end >= 0) & (F.col("y_min") - end > gap), F.lit(False)).cast("int")
    placed = rows.withColumn("_open", opens).withColumn("region", F.sum("_open").over(w))
    edge = lambda f, c, by: (f(c) + by).alias(c)
    boxes = placed.groupBy("doc", "page", "region").agg(
        edge(F.min, "x_min", -padding), edge(F.min, "y_min", -padding), edge(F.max, "x_max", padding), edge(F.max, "y_max", padding), F.max("width").alias("width"), F.max("height").alias("height"),
    ).filter(F.col("y_max") - F.col("y_min") >= least)
    cut = boxes.select("doc", "page", "region", *[F.greatest(F.lit(0), c).alias(c) for c in ("x_min", "y_min")], F.least("x_max", "width").alias("x_max"), F.least("y_max", "height").alias("y_max"))
    return cut.filter("x_max > x_min AND y_max > y_min")


def tiles(pages: DataFrame, down: int = 2, across: int = 2) -> DataFrame:
    """Doc, page, row, col, x_min..y_max: a page (width, height) in a grid of tiles; the last of each takes the rest."""
    grid = pages.withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(down - 1)))).withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(across - 1))))
    step = lambda size, n: F.floor(F.col(size) / n)
    ends = lambda at, size, n: F.when(F.col(at) < n - 1, (F.col(at) + 1) * step(size, n)).otherwise(F.col(size))
    return grid.select("doc", "page", "row", "col", (F.col("col") * step("width", across)).alias("x_min"), (F.col("row") * step("height", down)).alias("y_min"), ends("col", "width", across).alias("x_max"), ends("row", "height", down).alias("y_max"))


def table_headers(rows: DataFrame, blocks: int = 3, lines: int = 3) -> DataFrame:
    """Doc, page, row: the first wide row of a page's table where all its blocks look like labels."""
    wide = rows.groupBy("doc", "page", "row").agg(F.count("*").alias("n"), F.bool_and(looks_like_label(F.col("text"))).alias("named")).filter(F.col("n") >= blocks)
    first = wide.groupBy("doc", "page").agg(F.count("*").alias("rows"), F.min_by(F.struct("row", "named"), "row").alias("_f")).filter(F.col("rows") >= lines)
    return first.filter("_f.named").select("doc", "page", "_f.row")

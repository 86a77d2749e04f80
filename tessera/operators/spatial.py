"""Positions on a page: range joins, clustering, as-of sections and reading order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.compare import let

CELL = 200
#: Edge of the cells in which small regions meet points: few points of a cell lie outside a region that touches it.
FINE = 32
BOX = ("x_min", "y_min", "x_max", "y_max")


def _tiles(regions: DataFrame, cell: int, prefix: str = "") -> DataFrame:
    """regions once for each grid cell (_cx, _cy) that they touch."""
    spans = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(prefix + lo) / cell), F.floor(F.col(prefix + hi) / cell)))
    return regions.withColumn("_cx", spans("x_min", "x_max")).withColumn("_cy", spans("y_min", "y_max"))


def dealt(points: DataFrame, parts: int, page: str = "page", cell: int = FINE) -> DataFrame:
    """points with their cell, dealt by it, so that what groups or meets them by cell needs no shuffle of its own."""
    placed = points.withColumns({"_cx": F.floor(F.col("x") / cell), "_cy": F.floor(F.col("y") / cell)})
    return placed.repartition(parts, page, "_cx", "_cy")


def _inside(x: Column, y: Column) -> Column:
    return x.between(F.col("x_min"), F.col("x_max")) & y.between(F.col("y_min"), F.col("y_max"))


def points_in_regions(points: DataFrame, regions: DataFrame, page: str = "page", cell: int = CELL) -> DataFrame:
    """Points (x, y) inside regions (x_min..y_max), bounds included.

    Regions are exploded into the grid cells they touch and meet points by an equi-join on page and cell. A point has
    one cell, so no pair comes twice, and a crowded page is dealt by cell.
    """
    tiles = _tiles(regions, cell)
    placed = points.withColumns({"_cx": F.floor(F.col("x") / cell), "_cy": F.floor(F.col("y") / cell)})
    return placed.join(tiles, [page, "_cx", "_cy"]).filter(_inside(F.col("x"), F.col("y"))).drop("_cx", "_cy")


def totals_in_regions(points: DataFrame, regions: DataFrame, first: list[Column], again: list[Column], page: str = "page") -> DataFrame:
    """Regions with what again makes, over the places inside, of what first makes of each place's points; regions
    without points go. points are dealt.

    Points of one place are summed before they meet regions, and regions of one shape meet them once: however many
    points and regions a page has, its pairs are bounded by its places and shapes.
    """
    shape = [page, *BOX]
    places = points.groupBy(page, "_cx", "_cy", "x", "y").agg(*first)
    met = places.join(_tiles(regions.select(*shape).distinct(), FINE), [page, "_cx", "_cy"]).filter(_inside(F.col("x"), F.col("y")))
    return regions.join(met.groupBy(*shape).agg(*again), shape)


def best_in_regions(points: DataFrame, regions: DataFrame, also: list[str], entry: list, pick: Callable[[Column], Column], best: Callable, page: str = "page") -> DataFrame:
    """Regions with _best, the best of what pick makes of the points inside (an array of x, y and entry; null
    where it has none) by cell; regions without one go. points are dealt.

    The points of a cell are one array, which each shape that touches the cell (regions alike in also too) walks. What is
    shuffled or sorted is a row for each shape and cell, not one for each point and region.
    """
    shape = [page, *BOX, *also]
    cells = points.groupBy(page, "_cx", "_cy").agg(F.collect_list(F.struct("x", "y", *entry)).alias("_p"))
    found = let(F.filter("_p", lambda p: _inside(p["x"], p["y"])), lambda f: F.when(F.size(f) > 0, pick(f)))
    met = _tiles(regions.select(*shape).distinct(), FINE).join(cells, [page, "_cx", "_cy"]).select(*shape, found.alias("_best"))
    return regions.join(met.groupBy(*shape).agg(best("_best").alias("_best")).filter("_best IS NOT NULL"), shape)


def iou(a: str, b: str) -> Column:
    """Intersection over union of two boxes whose columns carry the prefixes."""
    c = F.col
    w = F.greatest(F.lit(0), F.least(c(f"{a}x_max"), c(f"{b}x_max")) - F.greatest(c(f"{a}x_min"), c(f"{b}x_min")))
    h = F.greatest(F.lit(0), F.least(c(f"{a}y_max"), c(f"{b}y_max")) - F.greatest(c(f"{a}y_min"), c(f"{b}y_min")))
    area = lambda p: (c(f"{p}x_max") - c(f"{p}x_min")) * (c(f"{p}y_max") - c(f"{p}y_min"))
    union = area(a) + area(b) - w * h
    return F.when(union > 0, w * h / union).otherwise(0.0)


def best_overlaps(a: DataFrame, b: DataFrame, least: float = 0.15, cell: int = 2 * FINE) -> DataFrame:
    """For each box of a (a_id, page, x_min..) the box of b (b_id, ..) of the highest IoU, ties by id.

    Boxes of one shape have one answer, and of those of b the lowest id can win, so shapes meet, not boxes. Both sides are
    exploded into cells; a pair that shares several cells is kept only in the cell of the lower left corner of its
    intersection, so no distinct is needed.
    """
    shape = ["page", *BOX]

    def tiled(df: DataFrame, prefix: str, *rest: str) -> DataFrame:
        return _tiles(df.select("page", *rest, *[F.col(k).alias(prefix + k) for k in BOX]), cell, prefix)

    met = tiled(a.select(*shape).distinct(), "a_").join(tiled(b.groupBy(*shape).agg(F.min("b_id").alias("b_id")), "b_", "b_id"), ["page", "_cx", "_cy"])
    home = (F.floor(F.greatest("a_x_min", "b_x_min") / cell) == F.col("_cx")) & (F.floor(F.greatest("a_y_min", "b_y_min") / cell) == F.col("_cy"))
    scored = met.filter(home).withColumn("iou", F.round(iou("a_", "b_"), 6)).filter(F.col("iou") >= least)
    best = scored.groupBy("page", *[F.col(f"a_{k}").alias(k) for k in BOX]).agg(F.min_by(F.struct("b_id", "iou"), F.struct(-F.col("iou"), "b_id")).alias("_b"))
    won = a.join(best, shape).groupBy("a_id").agg(F.min_by("_b", F.struct(-F.col("_b.iou"), "_b.b_id")).alias("_b"))
    return won.select("a_id", "_b.b_id", "_b.iou")


def rows_by_previous(blocks: DataFrame, keys: list[str], tolerance: float) -> DataFrame:
    """A new row where y is the tolerance or more below the block before it; gaps and islands."""
    w = Window.partitionBy(*keys).orderBy("y", "x", "ord")
    opens = F.coalesce(F.abs(F.col("y") - F.lag("y").over(w)) >= tolerance, F.lit(True)).cast("int")
    return blocks.withColumn("_open", opens).withColumn("row", F.sum("_open").over(w)).drop("_open")


def rows_by_mean(blocks: DataFrame, keys: list[str], tolerance: float) -> DataFrame:
    """Blocks by y; one joins the open row while it lies within the tolerance of that row's running mean.

    The walk is sequential in a page, so it is a fold over the page's sorted blocks inside the engine.
    """
    entry = F.struct(F.col("y").cast("double").alias("y"), F.col("ord").alias("ord"))
    zero = F.struct(F.lit(0.0).alias("total"), F.lit(0).alias("n"), F.lit(0).alias("row"), F.array().cast("array<struct<ord:bigint,row:int>>").alias("out"))

    def step(s: Column, b: Column) -> Column:
        joins = (s["n"] > 0) & (F.abs(b["y"] - s["total"] / F.greatest(s["n"], F.lit(1))) <= tolerance)
        row = F.when(joins, s["row"]).otherwise(s["row"] + 1)
        return F.struct(
            (F.when(joins, s["total"]).otherwise(0.0) + b["y"]).alias("total"),
            (F.when(joins, s["n"]).otherwise(0) + 1).alias("n"),
            row.alias("row"),
            F.concat(s["out"], F.array(F.struct(b["ord"].cast("long").alias("ord"), row.alias("row")))).alias("out"),
        )

    pages = blocks.groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias("_b"))
    return pages.select(*keys, F.inline(F.aggregate("_b", zero, step)["out"]))


def union_boxes(blocks: DataFrame, keys: list[str], padding: int) -> DataFrame:
    """The box around a group's blocks, padded, clamped at zero."""
    low = lambda c: F.greatest(F.lit(0), F.min(c) - padding).alias(c)
    high = lambda c: (F.max(c) + padding).alias(c)
    return blocks.groupBy(*keys).agg(low("x_min"), low("y_min"), high("x_max"), high("y_max"), F.count("*").alias("blocks"))


def asof_sections(blocks: DataFrame, anchors: DataFrame, keys: list[str]) -> DataFrame:
    """The last anchor at or above a block; blocks above the first take the first; without anchors full_page.

    A union sorted once per page and a running last: linear, where a join on <= would pair every block and anchor.
    """
    both = blocks.select(*keys, "y", "ord", F.lit(None).cast("string").alias("section"), F.lit(1).alias("_kind")).unionByName(
        anchors.select(*keys, "y", F.lit(None).cast("long").alias("ord"), "section", F.lit(0).alias("_kind"))
    )
    w = Window.partitionBy(*keys).orderBy("y", "_kind", "section")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    above = F.last("section", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    first = F.first("section", ignorenulls=True).over(whole)
    return both.withColumn("section", F.coalesce(above, first, F.lit("full_page"))).filter("_kind = 1").drop("_kind")


def anchor_offsets(anchors: DataFrame, blocks: DataFrame, keys: list[str], parts: int = 64, slices: int = 16) -> DataFrame:
    """Anchors (keys, anchor, x, y) and blocks (keys, x, y): the shift to each anchor's nearest block under 500, ties by dx and dy, then
    the page's median shift.

    Places meet, not rows: anchors of one place have one nearest block. A page's places are some arrays (slices), which
    each of its anchors' places walks, so there is no row for each pair. Pages may be few and their places many, so the
    slices are dealt over a given number of tasks; by their bytes they would be one.
    """
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    spots = blocks.select(*keys, F.struct(x.alias("x"), y.alias("y")).alias("_b")).distinct()
    spots = spots.withColumn("_s", F.pmod(F.xxhash64("_b"), F.lit(slices)).cast("int")).repartition(parts, *keys, "_s").groupBy(*keys, "_s").agg(F.collect_list("_b").alias("_b"))
    placed = anchors.select(*keys, "anchor", x.alias("x"), y.alias("y")).filter("x IS NOT NULL AND y IS NOT NULL")

    def shift(b: Column) -> Column:
        dx, dy = b["x"] - F.col("x"), b["y"] - F.col("y")
        return F.when((F.abs(dx) + F.abs(dy)) < 500, F.struct((F.abs(dx) + F.abs(dy)).alias("d"), dx.alias("dx"), dy.alias("dy")))

    asking = placed.select(*keys, "x", "y").distinct().withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))).repartition(parts, *keys, "_s")
    nearest = asking.join(spots.hint("shuffle_hash"), [*keys, "_s"]).select(*keys, "x", "y", F.array_min(F.transform("_b", shift)).alias("_m"))
    nearest = nearest.groupBy(*keys, "x", "y").agg(F.min("_m").alias("_m"))
    near = placed.join(nearest, [*keys, "x", "y"]).groupBy(*keys, "anchor").agg(F.min("_m").alias("_m"))
    found = near.groupBy(*keys).agg(F.median("_m.dx").alias("dx"), F.median("_m.dy").alias("dy"), F.count("_m").alias("anchors"))
    return found.filter("anchors > 0")


def cells(rows: DataFrame, columns: DataFrame, blocks: DataFrame, keys: list[str], slack: int = 10) -> DataFrame:
    """Blocks into the cell of their table's row and column (both are a few per table), texts in reading order."""
    at_row = blocks.join(rows, keys).filter(F.col("y").between(F.col("top") - slack, F.col("bottom") + slack))
    at = at_row.join(columns, keys).filter(F.col("x").between(F.col("left") - slack, F.col("right") + slack))
    listed = at.groupBy(*keys, "row", "column").agg(F.array_sort(F.collect_list(F.struct("y", "x", "ord", "text"))).alias("_t"))
    return listed.select(*keys, "row", "column", F.array_join(F.transform("_t", lambda t: t["text"]), " ").alias("text"))


def nearest_column(values: DataFrame, headers: DataFrame, keys: list[str], most: float = 150) -> DataFrame:
    """The header of the nearest x within reach; headers are a few per page."""
    met = values.join(headers, keys).withColumn("_d", F.abs(F.col("x") - F.col("header_x"))).filter(F.col("_d") < most)
    return met.groupBy(*keys, "ord").agg(F.min_by("header", F.struct("_d", "header")).alias("header"))


def nearest_right(blocks: DataFrame, page: str, dy: float = 30, gap: float = 300) -> DataFrame:
    """Labels in input order each take the nearest free value to the right on their line.

    A value taken is gone, so the walk is sequential in a page: a fold over the page's labels inside the engine.
    """
    entry = F.struct("ord", "x", "y")
    pages = blocks.groupBy(page).agg(
        F.array_sort(F.collect_list(F.when(F.col("is_label"), entry))).alias("_labels"),
        F.array_sort(F.collect_list(F.when(~F.col("is_label"), F.struct("x", "ord", "y")))).alias("_values"),
    )
    zero = F.array().cast("array<struct<ord:bigint,value_ord:bigint>>")

    def step(out: Column, b: Column) -> Column:
        taken = F.transform(out, lambda o: o["value_ord"])
        free = F.filter("_values", lambda v: (F.abs(v["y"] - b["y"]) <= dy) & (v["x"] > b["x"]) & (v["x"] - b["x"] <= gap) & ~F.array_contains(taken, v["ord"]))
        hit = F.get(free, F.lit(0))
        return F.when(hit.isNull(), out).otherwise(F.concat(out, F.array(F.struct(b["ord"].cast("long").alias("ord"), hit["ord"].cast("long").alias("value_ord")))))

    return pages.select(page, F.inline(F.aggregate("_labels", zero, step)))


def typed_pick(points: DataFrame, regions: DataFrame) -> DataFrame:
    """Points (text, confidence, ord), dealt, in typed regions (field_type) give each field (region and type) that holds any a value.

    A date, a five-digit code and a policy number are searched in the texts in order; a checkbox is 1 where a mark
    stands and Off elsewhere; a number keeps its digits; a text is the longest, then the surest.
    """
    t, order = F.col("text"), -F.col("ord").cast("long")
    found = {
        "date": F.regexp_extract(t, r"([0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{2,4})", 1),
        "naic": F.regexp_extract(t, r"^\s*([0-9]{5})\s*$", 1),
        "policy_number": F.regexp_extract(t, r"([A-Z0-9][A-Z0-9-]{4,})", 1),
        "number": F.regexp_replace(t, r"[^0-9.]", ""),
    }
    told = {"text": F.when(t.isNotNull(), F.struct(F.char_length(t).alias("size"), F.coalesce(F.col("confidence").cast("double"), F.lit(float("-inf"))).alias("sure"), order.alias("order"), t.alias("value")))}
    for kind, c in {**{k: F.nullif(c, F.lit("")) for k, c in found.items()}, "checkbox": F.when(F.trim(F.lower(t)).isin("x", "☑", "☒", "✓", "✔", "1", "yes"), "1")}.items():
        told[kind] = F.when(c.isNotNull(), F.struct(F.lit(0).alias("size"), F.lit(0.0).alias("sure"), order.alias("order"), c.alias("value")))

    def pick(inside: Column) -> Column:
        """A region that holds points has a value, though it be null."""
        chosen = None
        for kind in told:
            hit = F.array_max(F.transform(inside, lambda p: p[kind]))  # noqa: B023
            chosen = F.when(F.col("field_type") == kind, hit) if chosen is None else chosen.when(F.col("field_type") == kind, hit)
        return F.struct(chosen.alias("hit"))

    won = best_in_regions(points.withColumns({f"_{k}": c for k, c in told.items()}), regions, ["field_type"], [F.col(f"_{k}").alias(k) for k in told], pick, F.max)
    value = F.max("_best")["hit"]["value"]
    return won.groupBy("field", "field_type").agg(F.when(F.col("field_type") == "checkbox", F.coalesce(value, F.lit("Off"))).otherwise(value).alias("value"))


def _fold_rows(blocks: DataFrame, keys: list[str], joins, update) -> DataFrame:
    """Rows by a sequential rule over a page's blocks sorted by y: joins(anchor, y) and update(anchor, y)."""
    entry = F.struct(F.col("y").cast("double").alias("y"), F.col("ord").cast("long").alias("ord"))
    zero = F.struct(F.lit(0.0).alias("anchor"), F.lit(0).alias("row"), F.array().cast("array<struct<ord:bigint,row:int>>").alias("out"))

    def step(s: Column, b: Column) -> Column:
        on = (s["row"] > 0) & joins(s["anchor"], b["y"])
        row = F.when(on, s["row"]).otherwise(s["row"] + 1)
        return F.struct(F.when(on, update(s["anchor"], b["y"])).otherwise(b["y"]).alias("anchor"), row.alias("row"), F.concat(s["out"], F.array(F.struct(b["ord"].alias("ord"), row.alias("row")))).alias("out"))

    pages = blocks.groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias("_b"))
    return pages.select(*keys, F.inline(F.aggregate("_b", zero, step)["out"]))


def rows_by_midpoint(blocks: DataFrame, keys: list[str], tolerance: float = 35) -> DataFrame:
    """The row's anchor moves half way to each block that joins it."""
    return _fold_rows(blocks, keys, lambda anchor, y: F.abs(y - anchor) <= tolerance, lambda anchor, y: (anchor + y) / 2)


def columns_by_seed(blocks: DataFrame, keys: list[str], tolerance: float = 40) -> DataFrame:
    """Blocks by x; one joins the open column while it lies within the tolerance of its first block. Columns of
    one block go."""
    found = _fold_rows(blocks.withColumn("y", F.col("x")), keys, lambda anchor, x: x - anchor <= tolerance, lambda anchor, x: anchor).withColumnRenamed("row", "column")
    return found.withColumn("_n", F.count("*").over(Window.partitionBy(*keys, "column"))).filter("_n >= 2").drop("_n")


def recover_small_fields(points: DataFrame, regions: DataFrame, width: float = 80, pad: float = 12, longest: int = 20) -> DataFrame:
    """Narrow regions, padded, take the block of at most so many characters whose centre is nearest. points are
    dealt."""
    small = regions.filter(F.col("x_max") - F.col("x_min") < width)
    grown = small.withColumns({"_x0": (F.col("x_min") + F.col("x_max")) / 2, "_y0": (F.col("y_min") + F.col("y_max")) / 2, "x_min": F.col("x_min") - pad, "y_min": F.col("y_min") - pad, "x_max": F.col("x_max") + pad, "y_max": F.col("y_max") + pad})
    far = lambda p: F.round(F.sqrt(F.pow(p["x"] - F.col("_x0"), 2) + F.pow(p["y"] - F.col("_y0"), 2)), 6)
    pick = lambda found: F.array_min(F.transform(found, lambda p: F.struct(far(p).alias("d"), p["ord"].alias("ord"), p["text"].alias("text"))))
    won = best_in_regions(points.filter(F.char_length("text") <= longest), grown, ["_x0", "_y0"], ["ord", "text"], pick, F.min)
    return won.groupBy("field").agg(F.min("_best")["text"].alias("text"))

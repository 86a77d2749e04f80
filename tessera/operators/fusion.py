"""Multi-source candidate fusion, routing and merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.compare import fusion_form

# Default trust by source, and by field type and source.
SOURCE_WEIGHTS = {
    "acroform": 0.99, "spatial": 0.95, "vlm_checkbox_crop": 0.80, "label_map": 0.92, "multimodal": 0.78,
    "positional_checkbox": 0.91, "template": 0.90, "vlm_ocr": 0.87, "vlm_extract": 0.60, "vision_checkbox": 0.85,
    "vision_driver": 0.82, "positional": 0.88, "semantic": 0.80, "label_value": 0.75, "vision": 0.70,
    "text_llm": 0.65, "gap_fill": 0.50,
}
_BOX = {
    "positional_checkbox": 0.88, "vlm_checkbox_crop": 0.87, "vision_checkbox": 0.90, "vlm_ocr": 0.88, "spatial": 0.85,
    "text_llm": 0.55, "positional": 0.88, "vlm_extract": 0.55, "label_value": 0.50, "semantic": 0.55, "gap_fill": 0.40,
}
TYPE_WEIGHTS = {
    "checkbox": _BOX,
    "radio": _BOX,
    "text": {
        "spatial": 0.95, "text_llm": 0.75, "vlm_ocr": 0.85, "vlm_extract": 0.60, "positional": 0.80, "label_value": 0.78,
        "semantic": 0.82, "gap_fill": 0.55, "template": 0.90, "label_map": 0.92,
    },
    "numeric": {
        "positional": 0.92, "template": 0.92, "spatial": 0.90, "vlm_extract": 0.60, "vlm_ocr": 0.83, "text_llm": 0.70,
        "label_value": 0.75, "semantic": 0.78, "gap_fill": 0.50,
    },
    "date": {
        "spatial": 0.93, "text_llm": 0.80, "vlm_extract": 0.60, "vlm_ocr": 0.83, "positional": 0.88, "label_value": 0.78,
        "semantic": 0.80, "gap_fill": 0.55, "template": 0.90,
    },
}
AGREEMENT = 0.10
UNKNOWN = 0.5


def _lookup(key: Column, table: dict[str, float]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def weighted(candidates: DataFrame, by_type: bool = False) -> DataFrame:
    """Candidates (.., source, value, confidence nullable, [field_type]) with a weight; blank values go."""
    base = F.coalesce("confidence", _lookup(F.col("source"), SOURCE_WEIGHTS), F.lit(UNKNOWN))
    if by_type:
        typed = None
        for kind, weights in TYPE_WEIGHTS.items():
            hit = (F.col("field_type") == kind, _lookup(F.col("source"), weights))
            typed = F.when(*hit) if typed is None else typed.when(*hit)
        base = F.coalesce(typed, base)
    return candidates.withColumn("weight", base).filter(F.trim(F.coalesce("value", F.lit(""))) != "")


def fuse(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """One row a key. Candidates have source, value, weight and ord (input order).

    Equal normal forms form groups that score max weight + 0.10 a further member, at most 1. The highest score wins,
    the earliest group on ties; its value is that of its heaviest, earliest member. Two partial aggregations on nested
    keys: the second needs no shuffle of candidates, only of groups.
    """
    groups = candidates.withColumn("norm", fusion_form(F.col("value"))).groupBy(*keys, "norm").agg(
        F.max("weight").alias("top"),
        F.count("*").alias("members"),
        F.min("ord").alias("first"),
        F.max_by(F.struct("value", "source"), F.struct("weight", -F.col("ord"))).alias("best"),
    )
    score = F.round(F.least(F.lit(1.0), F.col("top") + AGREEMENT * (F.col("members") - 1)), 6)
    scored = groups.withColumn("score", score)
    won = scored.groupBy(*keys).agg(
        F.max_by(F.struct("best", "score", "members"), F.struct("score", -F.col("first"))).alias("w"),
        F.sum("members").alias("candidates"),
        F.count("*").alias("distinct_values"),
    )
    return won.select(
        *keys,
        F.col("w.best.value").alias("value"),
        F.col("w.best.source").alias("source"),
        F.round("w.score", 3).alias("confidence"),
        F.col("w.members").alias("agreement"),
        "candidates",
        "distinct_values",
    )


def disagreements(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """Keys with two sources or more and more than one normal form. A key's are gathered as sets: two distinct counts
    would write every candidate twice and shuffle both."""
    several = lambda c: F.size(F.collect_set(c)).cast("long")
    return candidates.groupBy(*keys).agg(several("source").alias("sources"), several(fusion_form(F.col("value"))).alias("values")).filter("sources >= 2 AND values > 1")


def trusted(candidates: DataFrame, keys: list[str], threshold: float, sources: list[str]) -> DataFrame:
    """Keys that a trusted source fills with enough confidence."""
    return candidates.filter((F.col("weight") >= threshold) & F.col("source").isin(sources)).select(*keys).distinct()


def merge_by_precedence(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """The first part that has a key wins."""
    tagged = [p.withColumn("_rank", F.lit(i)) for i, p in enumerate(parts)]
    union = tagged[0]
    for p in tagged[1:]:
        union = union.unionByName(p)
    rest = [c for c in union.columns if c not in (*keys, "_rank")]
    best = union.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct("_rank", *rest)).alias("_best"), F.min("_rank").alias("priority"))
    return best.select(*keys, "_best.*", "priority")


def review_manifest(fused: DataFrame, threshold: float) -> DataFrame:
    """What needs review; sort by confidence where it is shown."""
    return fused.filter(F.col("confidence") < threshold)

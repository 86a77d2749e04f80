"""Ground-truth scoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.compare import comparable, status


def compare_values(expected: DataFrame, found: DataFrame, keys: list[str], noise: bool = True) -> DataFrame:
    """Expected (keys, field, value) left-joined to found; rows without an expected value go."""
    a = expected.select(*keys, "field", F.col("value").alias("expected"))
    b = found.select(*keys, "field", F.col("value").alias("extracted"))
    joined = a.join(b, [*keys, "field"], "left")
    # each form is a column of its own, so that the plan computes it once
    forms = joined.withColumns({"_e": comparable(F.col("expected"), F.col("field")), "_x": comparable(F.col("extracted"), F.col("field"))})
    judged = forms.withColumn("status", status(F.col("_e"), F.col("_x"), noise)).drop("_e", "_x")
    return judged.filter(F.col("status").isNotNull())


def share(part: Column, whole: Column, digits: int = 2) -> Column:
    return F.when(whole > 0, F.round(part * 100.0 / whole, digits)).otherwise(0.0)


def accuracy(judged: DataFrame, keys: list[str], half_credit: bool = True) -> DataFrame:
    """Counters and rates by key; A02 where the keys are coarser than documents."""
    n = {s: F.count_if(F.col("status") == s) for s in ("matched", "partial", "missing", "wrong")}
    counted = judged.groupBy(*keys).agg(F.count("*").alias("total"), *[c.alias(s) for s, c in n.items()])
    credit = F.col("matched") + (F.col("partial") * 0.5 if half_credit else 0)
    return counted.withColumns(
        {
            "accuracy": share(credit, F.col("total")),
            "exact_rate": share(F.col("matched"), F.col("total")),
            "coverage": share(F.col("total") - F.col("missing"), F.col("total")),
        }
    )

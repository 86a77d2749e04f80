"""Positions and running sums in groups that may be few and large.

A window over one group is one task. Here the order key, a number, is cut at quantiles of the whole table into buckets;
positions and sums are local to (group, bucket), and what lies before a bucket comes from a table of a row a bucket. No
task gets more than a bucket's share of a group, and equal keys stay together, so the order is that of one window.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that one window task may get; smaller tables stay in one bucket.
BUCKET = 1_000_000


def _bucket(rows: DataFrame, key: str, size: int) -> Column:
    n = -(-rows.count() // size)
    if n <= 1:
        return F.lit(0)
    cuts = sorted(set(rows.approxQuantile(key, [i / n for i in range(1, n)], 0.1 / n)))
    return F.coalesce(F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col(key))), F.lit(-1)) if len(cuts) < 64 else _found(cuts, key)


def _found(cuts: list[float], key: str) -> Column:
    """How many cuts lie below the key, by halving the list."""
    if not cuts:
        return F.lit(0)
    half = len(cuts) // 2
    return F.when(F.col(key) > cuts[half], half + 1 + _found(cuts[half + 1 :], key)).otherwise(_found(cuts[:half], key))


def numbered(rows: DataFrame, groups: list[str], key: str, ties: list[str], value: Column | None = None, size: int = BUCKET) -> DataFrame:
    """rows with position (from 1 in its group, by key and then ties), group_size, and, where a value is given, used, its
    running sum up to and with the row. The key is a number and not null."""
    kept = rows.withColumn("_b", _bucket(rows, key, size)).withColumn("_v", value if value is not None else F.lit(0))
    local = Window.partitionBy(*groups, "_b").orderBy(key, *ties)
    run = local.rowsBetween(Window.unboundedPreceding, 0)
    near = kept.withColumn("_n", F.row_number().over(local)).withColumn("_s", F.sum("_v").over(run))
    of_bucket = kept.groupBy(*groups, "_b").agg(F.count("*").alias("_c"), F.sum("_v").alias("_t"))
    whole = Window.partitionBy(*groups)
    before = whole.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = of_bucket.select(*groups, "_b", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_c0"), F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_t0"), F.sum("_c").over(whole).alias("group_size"))
    same = [near[c].eqNullSafe(starts[c]) for c in [*groups, "_b"]]
    met = near.join(starts, reduce(lambda a, b: a & b, same))
    out = met.select(*[near[c] for c in rows.columns], (F.col("_n") + F.col("_c0")).alias("position"), "group_size", *([(F.col("_s") + F.col("_t0")).alias("used")] if value is not None else []))
    return out

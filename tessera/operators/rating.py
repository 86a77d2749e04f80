"""Carrier appetite, rating and quotes (J20-J22, A12, A13, N10, N11), on small fixed dimensions that are broadcast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Carrier appetite, base rates, territory and carrier factors.
CARRIERS = [
    # id, lobs, largest fleet (0: none asked), least years, excluded states, largest loss ratio
    ("progressive_commercial", ["commercial_auto"], 50, 1, [], 0.75),
    ("hartford", ["commercial_auto", "general_liability", "workers_compensation", "bop"], 200, 2, [], 0.65),
    ("travelers", ["commercial_auto", "general_liability", "workers_compensation", "commercial_property", "umbrella"], 500, 3, [], 0.60),
    ("employers_mutual", ["workers_compensation", "commercial_auto", "general_liability"], 100, 3, ["CA", "NY", "FL"], 0.55),
    ("national_general", ["commercial_auto"], 25, 0, [], 0.80),
    ("berkshire_hathaway", ["general_liability", "workers_compensation", "bop", "commercial_property", "umbrella"], 0, 1, [], 0.65),
]
BASE_RATES = {"commercial_auto": 3500, "general_liability": 1200, "workers_compensation": 8, "commercial_property": 800, "bop": 2500, "umbrella": 1500, "cyber": 1200}
TERRITORY = {
    "TX": 1.00, "CA": 1.35, "NY": 1.30, "FL": 1.25, "IL": 1.10, "PA": 1.05, "OH": 1.00, "GA": 1.05, "NC": 0.95, "MI": 1.15,
    "NJ": 1.20, "VA": 0.95, "WA": 1.10, "AZ": 1.05, "MA": 1.15, "CO": 1.05, "TN": 0.95, "IN": 0.95, "MO": 1.00, "MD": 1.10,
}
CARRIER_FACTORS = [
    ("progressive_commercial", "commercial_auto", 0.90), ("hartford", "general_liability", 0.92), ("hartford", "workers_compensation", 0.95),
    ("travelers", "umbrella", 0.85), ("travelers", "commercial_auto", 0.95), ("employers_mutual", "workers_compensation", 0.88),
    ("national_general", "commercial_auto", 1.10), ("berkshire_hathaway", "general_liability", 0.90), ("berkshire_hathaway", "bop", 0.88),
]
PLANS = [("annual", 1, 0.0), ("semi_annual", 2, 0.02), ("quarterly", 4, 0.04), ("monthly", 12, 0.08)]


def carriers(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CARRIERS, "carrier_id string, carrier_lobs array<string>, max_fleet int, min_years int, excluded array<string>, max_loss double")


def with_loss_ratio(profiles: DataFrame) -> DataFrame:
    return profiles.withColumn("loss_ratio", F.when(F.col("prior_premium") > 0, F.col("total_loss") / F.col("prior_premium")).otherwise(0.0))


def match_carriers(profiles: DataFrame) -> DataFrame:
    """Profiles (fleet_size, years, state, total_loss, prior_premium, lobs) against six appetite rules.

    The rules are a stated set of fixed size, broadcast: each profile meets each rule once.
    """
    met = with_loss_ratio(profiles).join(F.broadcast(carriers(profiles.sparkSession)), F.lit(True))
    overlap = F.arrays_overlap("lobs", "carrier_lobs")
    barred = ((F.col("max_fleet") > 0) & (F.col("fleet_size") > F.col("max_fleet"))) | (F.col("years") < F.col("min_years")) | F.array_contains("excluded", F.col("state"))
    losses = F.when((F.col("loss_ratio") > F.col("max_loss")) & (F.col("prior_premium") > 0), 0.5).otherwise(1.0)
    partly = F.when(F.size(F.array_except("lobs", "carrier_lobs")) > 0, 0.8).otherwise(1.0)
    confidence = F.when(~overlap | barred, 0.0).otherwise(F.round(F.lit(0.90) * losses * partly, 2))
    return met.withColumns({"confidence": confidence, "eligible": confidence > 0})


def _steps(c: Column, steps: list[tuple[float, float]], last: float) -> Column:
    """The factor of the first bound that c reaches, from above."""
    out = None
    for bound, factor in steps:
        out = F.when(c >= bound, factor) if out is None else out.when(c >= bound, factor)
    return out.otherwise(last)


def premiums(profiles: DataFrame) -> DataFrame:
    """Profiles with carrier_id and lob to the yearly premium of each; rate tables are literal maps."""
    spark = profiles.sparkSession
    literal = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])
    base = F.coalesce(F.try_element_at(literal(BASE_RATES), F.col("lob")), F.lit(2000)).cast("double")
    years, fleet = F.greatest(F.col("years"), F.lit(1)), F.greatest(F.col("fleet_size"), F.lit(1))
    fleet_factor = _steps(fleet, [(50, 0.80), (20, 0.85), (10, 0.90), (5, 0.95)], 1.0)
    units = (
        F.when(F.col("lob") == "commercial_auto", fleet * fleet_factor)
        .when(F.col("lob") == "general_liability", F.greatest(F.col("revenue") / 100000, F.lit(1.0)))
        .when(F.col("lob") == "workers_compensation", F.col("payroll") / 100)
        .when(F.col("lob") == "commercial_property", F.greatest(F.col("locations"), F.lit(1)))
        .otherwise(1.0)
    )
    ratio = F.col("loss_ratio")
    experience = F.when(ratio <= 0, 0.85).when(ratio <= 0.3, 0.90).when(ratio <= 0.5, 1.0).when(ratio <= 0.7, 1.15).otherwise(1.30)
    maturity = _steps(years, [(10, 0.85), (5, 0.90), (3, 0.95)], 1.0)
    territory = F.coalesce(F.try_element_at(literal(TERRITORY), F.col("state")), F.lit(1.0))
    factors = spark.createDataFrame(CARRIER_FACTORS, "carrier_id string, lob string, carrier_factor double")
    rated = with_loss_ratio(profiles).join(F.broadcast(factors), ["carrier_id", "lob"], "left")
    return rated.withColumn("premium", F.round(base * units * territory * experience * maturity * F.coalesce("carrier_factor", F.lit(1.0)), 2))


def quotes(rated: DataFrame, keys: list[str]) -> DataFrame:
    """A carrier's total, and the number of lines it covers."""
    return rated.groupBy(*keys, "carrier_id").agg(F.round(F.sum("premium"), 2).alias("total"), F.count("*").alias("lines"))


def best_quotes(found: DataFrame, keys: list[str]) -> DataFrame:
    """The cheapest and the widest quote; ties by carrier name."""
    return found.groupBy(*keys).agg(
        F.min_by("carrier_id", F.struct("total", "carrier_id")).alias("cheapest"),
        F.min_by("carrier_id", F.struct(-F.col("lines"), "carrier_id")).alias("most_coverage"),
        F.min("total").alias("least_total"),
    )


def payment_options(found: DataFrame) -> DataFrame:
    """One row an instalment plan."""
    plans = F.array(*[F.struct(F.lit(p).alias("plan"), F.lit(n).alias("installments"), F.lit(fee).alias("fee")) for p, n, fee in PLANS])
    each = found.select("*", F.inline(plans))
    cost = F.round(F.col("total") * (1 + F.col("fee")), 2)
    return each.withColumn("total_cost", cost).withColumn("installment", F.round(F.col("total_cost") / F.col("installments"), 2)).drop("fee")

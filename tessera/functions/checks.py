"""Validation and repair of single values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Transliteration and weights of the 17-character identifier.
VIN_VALUES = dict(zip("ABCDEFGHJKLMNPRSTUVWXYZ0123456789", [1, 2, 3, 4, 5, 6, 7, 8, 1, 2, 3, 4, 5, 7, 9, 2, 3, 4, 5, 6, 7, 8, 9, 0, 1, 2, 3, 4, 5, 6, 7, 8, 9]))
VIN_WEIGHTS = [8, 7, 6, 5, 4, 3, 2, 10, 0, 9, 8, 7, 6, 5, 4, 3, 2]
# Trust by how a value was given.
GIVEN = {"user_confirmed": 1.0, "validated": 0.95, "user_stated": 0.90, "document_ocr": 0.85, "llm_inferred": 0.70, "default": 0.50}


def repair_vin(c: Column) -> Column:
    """letters that the code never has are read as digits."""
    return F.translate(F.upper(F.trim(c)), "IOQ", "100")


def vin_valid(c: Column) -> Column:
    """17 characters and a right check digit; characters without a value pass."""
    values = F.create_map(*[F.lit(x) for kv in VIN_VALUES.items() for x in kv])
    vin = F.upper(F.trim(c))
    total = F.aggregate(F.sequence(F.lit(1), F.lit(17)), F.lit(0), lambda s, i: s + F.coalesce(F.try_element_at(values, F.substr(vin, i, F.lit(1))), F.lit(0)) * F.element_at(F.array(*map(F.lit, VIN_WEIGHTS)), i))
    check = F.when(total % 11 == 10, "X").otherwise((total % 11).cast("string"))
    odd = vin.rlike("[^A-HJ-NPR-Z0-9]")
    return (F.char_length(vin) == 17) & (odd | (F.substring(vin, 9, 1) == check))


def phone(c: Column) -> Column:
    """Ten digits, or eleven with a leading one, as (ddd) ddd-dddd; else null."""
    digits = F.regexp_replace(c, "[^0-9]", "")
    ten = F.when(digits.rlike("^1[0-9]{10}$"), F.substring(digits, 2, 10)).when(F.char_length(digits) == 10, digits)
    return F.concat(F.lit("("), F.substring(ten, 1, 3), F.lit(") "), F.substring(ten, 4, 3), F.lit("-"), F.substring(ten, 7, 4))


def tax_id(c: Column) -> Column:
    """Nine digits as dd-ddddddd; else null."""
    digits = F.regexp_replace(c, "[^0-9]", "")
    return F.when(F.char_length(digits) == 9, F.concat(F.substring(digits, 1, 2), F.lit("-"), F.substring(digits, 3, 7)))


def given_confidence(source: Column, confirmed: Column, failed: Column) -> Column:
    """The source's trust, +0.10 where confirmed, -0.30 where validation failed, within 0.10 and 1.0."""
    base = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in GIVEN.items() for x in kv]), source), F.lit(0.5))
    raw = base + F.when(confirmed, 0.10).otherwise(0.0) - F.when(failed, 0.30).otherwise(0.0)
    return F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.10), raw)), 2)


def band(confidence: Column) -> Column:
    return F.when(confidence >= 0.90, "high").when(confidence >= 0.70, "medium").when(confidence >= 0.50, "low").otherwise("very_low")


def age_warns(born: Column, as_of: Column) -> Column:
    """An age under 15 or over 120 on a given day."""
    years = F.datediff(as_of, born) / 365.25
    return (years < 15) | (years > 120)

"""Validation rules over a long table (doc, field, value): X05 (warnings alone) and X06 (severities and corrected values).

Rules of one value are columns of one pass. Rules of two values meet rows of the same document and suffix or prefix by an
equality join, which moves only the rows of the two kinds. Where several rows would do, the lowest field name is taken.
zip_ranges (state, low, high: three-digit ZIP prefixes) and licence_patterns (state, pattern) are reference tables that
the caller gives; states that they lack are not checked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.checks import age_warns, phone, tax_id, vin_valid
from tessera.functions.compare import strip, whole
from tessera.functions.values import strict_date

EFFECTIVE, EXPIRATION = r"(?i)effective.*date|date.*effective|eff.*date", r"(?i)expiration.*date|date.*expir|exp.*date"


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, r"\D", "")


def _issue(rule: str, severity: str | Column, when: Column) -> Column:
    level = F.lit(severity) if isinstance(severity, str) else severity
    return F.when(when, F.struct(F.lit(rule).alias("rule"), level.alias("severity")))


def _inline(rows: DataFrame, issues: list[Column]) -> DataFrame:
    found = F.filter(F.array(*issues), lambda i: i.isNotNull())
    return rows.select("doc", "field", F.inline(found))


def _state_zip(states: DataFrame, zips: DataFrame, on: list[str], zip_ranges: DataFrame, rule: str) -> DataFrame:
    """states and zips have doc, field, value and the key columns; a state row takes the first ZIP row of its key."""
    first = zips.groupBy(*on).agg(F.min_by("value", "field").alias("_zip"))
    met = states.join(first, on).select("doc", "field", F.upper(strip("value")).alias("state"), F.substring(_digits(F.col("_zip")), 1, 3).alias("_prefix")).filter(F.char_length("_prefix") == 3)
    ranges = zip_ranges.groupBy("state").agg(F.collect_list(F.struct("low", "high")).alias("_ranges"))
    fits = F.exists("_ranges", lambda r: F.col("_prefix").between(r["low"], r["high"]))
    return met.join(ranges, "state").filter(~fits).select("doc", "field", F.lit(rule).alias("rule"), F.lit("warning").alias("severity"))


def field_issues(rows: DataFrame, as_of: str, zip_ranges: DataFrame) -> DataFrame:
    """Doc, field, rule, severity (always warning) on the day as_of."""
    v, name, day = strip(F.coalesce("value", F.lit(""))), F.lower("field"), F.lit(as_of).cast("date")
    d, n = _digits(v), F.char_length(_digits(v))
    year = whole(d)
    single = _inline(
        rows,
        [
            _issue("vehicle_year", "warning", name.rlike(r"vehicle.*year|year.*model|modelyear") & (n == 4) & ~year.between(1900, F.year(day) + 1)),
            _issue("birth_date", "warning", name.rlike(r"driver.*dob|driver.*birth|dob.*driver|dateofbirth") & F.coalesce(age_warns(strict_date(v), day), F.lit(False))),
            _issue("vin", "warning", name.rlike(r"vin|vehicle.*ident") & (F.char_length(v) == 17) & ~vin_valid(v)),
            _issue("phone", "warning", name.rlike(r"phone|fax|telephone|tel\b") & ~n.isin(0, 10, 11)),
            _issue("naic", "warning", name.rlike("naic") & ~n.isin(0, 5)),
        ],
    )
    dated = rows.withColumn("_day", strict_date(v)).filter(F.col("_day").isNotNull())
    starts = dated.filter(F.col("field").rlike(EFFECTIVE)).select("doc", "field", F.col("_day").alias("_start"))
    ends = dated.filter(F.col("field").rlike(EXPIRATION)).groupBy("doc").agg(F.min("_day").alias("_end"))
    order = starts.join(ends, "doc").filter("_start >= _end").select("doc", "field", F.lit("date_order").alias("rule"), F.lit("warning").alias("severity"))
    before = lambda mark: F.regexp_extract(name, rf"^(.*){mark}", 1)
    states = rows.filter(name.contains("state") & ~name.contains("zip")).withColumn("_key", before("state"))
    zips = rows.filter(name.contains("zip")).withColumn("_key", before("zip"))
    return single.unionByName(order).unionByName(_state_zip(states, zips, ["doc", "_key"], zip_ranges, "state_zip"))


def form_issues(rows: DataFrame, zip_ranges: DataFrame, licence_patterns: DataFrame) -> DataFrame:
    """Doc, field, rule, severity (error, warning, info)."""
    v = strip(F.col("value"))
    rows = rows.filter(v != "")
    name = F.lower("field")
    d, n = _digits(v), F.char_length(_digits(v))
    vin = F.upper(F.replace(v, F.lit(" "), F.lit("")))
    is_vin, is_tax = name.rlike("vin|vehicle.*ident"), name.rlike(r"fein|tax.*id|federal.*id|ein\b")
    single = _inline(
        rows,
        [
            _issue("vin_length", "error", is_vin & (F.char_length(vin) != 17)),
            _issue("vin_checksum", "error", is_vin & (F.char_length(vin) == 17) & ~vin_valid(vin)),
            _issue("fein_format", F.when(n < 9, "error").otherwise("info"), is_tax & (n > 0) & (n != 9)),
            _issue("date_format", "error", name.contains("date") & strict_date(v).isNull()),
            _issue("phone_format", "info", name.rlike(r"phone|fax|telephone|tel\b") & (n > 0) & phone(v).isNull()),
        ],
    )
    dated = rows.withColumn("_day", strict_date(v))
    starts = dated.filter(name.rlike("effective.*date|eff.*date") & F.col("_day").isNotNull()).select("doc", "field", F.col("_day").alias("_start"))
    ends = dated.filter(name.rlike("expiration.*date|exp.*date")).groupBy("doc").agg(F.min_by("_day", "field").alias("_end"))
    order = starts.join(ends, "doc").filter("_start >= _end").select("doc", "field", F.lit("date_ordering").alias("rule"), F.lit("error").alias("severity"))
    keyed = rows.withColumn("_key", F.regexp_extract("field", r"_([A-M]|\d+)$", 1))
    zips, states = keyed.filter(name.contains("zip")), keyed.filter(name.rlike("_state[_ ]|state_|statecode") & ~name.contains("zip"))
    places = _state_zip(states, zips, ["doc", "_key"], zip_ranges, "state_zip_consistency")
    licences = keyed.filter(name.rlike("license.*number|dl.*number|driver.*license") & ~name.contains("state"))
    of_state = keyed.filter(name.contains("state")).groupBy("doc", "_key").agg(F.min_by("value", "field").alias("state"))
    form = F.upper(F.translate(v, " -", ""))
    odd = licences.join(of_state, ["doc", "_key"]).join(licence_patterns, "state").filter(~F.regexp(form, F.col("pattern")))
    odd = odd.select("doc", "field", F.lit("dl_format").alias("rule"), F.lit("warning").alias("severity"))
    return single.unionByName(order).unionByName(places).unionByName(odd)


def corrected(rows: DataFrame) -> DataFrame:
    """Rows with corrected, the value with telephone and tax numbers put in form where they have the digits."""
    v, name = strip(F.col("value")), F.lower("field")
    tax = F.when(name.rlike(r"fein|tax.*id|federal.*id|ein\b"), tax_id(v))
    call = F.when(name.rlike(r"phone|fax|telephone|tel\b"), phone(v))
    return rows.withColumn("corrected", F.coalesce(call, tax, F.col("value")))


def gaps(rows: DataFrame, issues: DataFrame, wanted: DataFrame) -> DataFrame:
    """Doc, field, status of each wanted field: missing, invalid (an error stands against it) or ok."""
    held = rows.select("doc", F.when(strip(F.col("value")) != "", F.col("field")).alias("_held"), F.lit(None).cast("string").alias("_wrong"))
    wrong = issues.filter("severity = 'error'").select("doc", F.lit(None).cast("string").alias("_held"), F.col("field").alias("_wrong"))
    told = held.unionByName(wrong).groupBy("doc").agg(F.collect_set("_held").alias("_held"), F.collect_set("_wrong").alias("_wrong"))  # one group, not three joins whose sorts a task would hold together
    every = told.join(F.broadcast(wanted.select("field")))
    return every.select("doc", "field", F.when(~F.array_contains("_held", F.col("field")), "missing").when(F.array_contains("_wrong", F.col("field")), "invalid").otherwise("ok").alias("status"))

"""The composite normaliser of extracted values (F25, F26): a record is rows (doc, field, value) beside the field catalog.

Every pass is a column transform of the long table; a dropped value is null until the end, so the passes stay in one
stage. Only the split of a state from its ZIP needs another row of the same document: the new ZIP rows are met with the
record by an anti join on (doc, field).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.checks import repair_vin
from tessera.functions.compare import contains_any, let, real, strip, whole
from tessera.functions.values import AMOUNT_WORDS, clean_phone, clean_text, named, ocr_date, ocr_money, us_date, DATE_WORDS, MONEY_WORDS, PHONE_WORDS

# Codes of states, territories and provinces; what an instruction on the form starts with; ticking words.
STATES = (
    "AL AK AZ AR CA CO CT DE FL GA HI ID IL IN IA KS KY LA ME MD MA MI MN MS MO MT NE NV NH NJ NM NY NC ND OH OK OR PA RI SC "
    "SD TN TX UT VT VA WA WV WI WY DC PR VI GU AS MP AB BC MB NB NL NS NT NU ON PE QC SK YT"
).split()
INSTRUCTIONS = (
    r"(?i)^(enter\s+|type\s+or\s+print|if\s+(yes|applicable|any)|please\s+(enter|provide|list)|check\s+(if|box|all)|see\s+(attached|page|reverse)"
    r"|complete\s+(if|this|section)|describe\s+(the|any|all)|attach\s+(a|additional|copy)|list\s+(all|each|the))|^\(?\s*mm\s*/\s*dd\s*/\s*yyyy\s*\)?$|^\(?\s*hh\s*:?\s*mm\s*\)?$"
)
TICKS = ["true", "yes", "1", "on", "x", "checked", "y", "s"]
LONG_FIELDS = ["address", "remark", "description", "lineone", "linetwo", "fullname", "explanation"]
ADDRESS_FIELDS = ["address", "officeidentifier", "lineone", "cityname", "stateorprovincecode", "postalcode"]


def normalise_value(kind: Column, field: Column, value: Column) -> Column:
    """one value by the field's kind and name, null where it says nothing."""
    return let(strip(value), lambda s: _typed(kind, field, s))


def _typed(kind: Column, field: Column, s: Column) -> Column:
    plain = strip(F.regexp_replace(F.regexp_replace(s, "<[^>]+>", ""), r"(?i)^(?:Name|Address|City|State|ZIP|Phone|Fax|Email|Date|Code|No\.?|Number|#|NAIC|VIN|SSN|FEIN|DOB)\s*[:：]\s*", ""))
    typed = F.when(kind.isin("checkbox", "radio"), F.when(F.lower(s).isin("1", "true", "yes", "x", "checked", "on", "✓", "✔", "y", "s"), "1").otherwise("Off"))
    typed = typed.when(named(field, DATE_WORDS), us_date(plain)).when(named(field, MONEY_WORDS), ocr_money(plain)).when(named(field, PHONE_WORDS), clean_phone(plain)).otherwise(clean_text(plain))
    return F.when(~F.lower(s).isin("", "null", "none", "n/a", "na"), typed)


def _first_pass(kind: Column, name: Column, s: Column) -> Column:
    """By type: box, code flag, time, day, amount, address, identifier, mail, site, full name; else as it is."""
    low, digits = F.lower(s), F.regexp_replace(s, r"\D", "")
    box = kind.isin("checkbox", "radio") | name.contains("indicator") | name.startswith("chk")
    junk = s.rlike(r"^\d{3,}$") | s.rlike(r"^\d{1,2}/\d{1,2}/\d{4}")
    time = contains_any(name, ["effectivetime", "expirationtime"])
    a_day = s.rlike(r"^\d{1,2}/\d{1,2}/\d{4}") | (s.rlike("[/-]") & s.rlike(r"\d{4}"))
    money = F.regexp_replace(s, r"[^\d.]", "")
    commas = strip(F.replace(s, F.lit(";"), F.lit(",")))
    zip_digits = F.regexp_replace(commas, r"\D", "")
    mail = F.regexp_replace(F.regexp_replace(F.regexp_replace(s, r"\s+@", "@"), r"@\s+", "@"), r"(?i)[\s_](com|org|net|edu|gov|io)$", ".$1")
    site = reduce(lambda c, end: F.replace(c, F.lit(f" {end}"), F.lit(f".{end}")), ["com", "org", "net"], F.regexp_replace(s, "(?i)https?:II", "https://"))
    untyped = (
        F.when(contains_any(name, ADDRESS_FIELDS), F.when(name.contains("postalcode") & (F.char_length(zip_digits) >= 5), F.substring(zip_digits, 1, 5)).otherwise(commas))
        .when(name.contains("vinidentifier") & (F.char_length(s) >= 15), repair_vin(s))
        .when(name.contains("email") & s.contains("@"), mail)
        .when(name.contains("website") & low.contains("https"), site)
        .when(name.contains("fullname"), F.replace(s, F.lit(";"), F.lit(",")))
        .otherwise(s)
    )
    amount = F.when(contains_any(name, AMOUNT_WORDS) & ~name.contains("count") & (money != ""), money).otherwise(untyped)
    day = F.when(name.contains("date") & ~name.contains("update"), F.coalesce(ocr_date(s), amount)).otherwise(amount)
    timed = F.when(time & a_day, None).when(time & digits.rlike(r"^\d{1,4}$"), F.lpad(digits, 4, "0")).otherwise(day)
    flag = F.when(name.contains("code") & low.isin("y", "n", "yes", "no", "true", "false"), F.when(low.isin("y", "yes", "true"), "True").otherwise("False")).otherwise(timed)
    return F.when(box, F.when(~junk & low.isin(TICKS), "1").otherwise("Off")).otherwise(flag)


def _later_passes(kind: Column, name: Column, default: Column, width: Column) -> list:
    """The passes after the state and ZIP split, each a function of the value so far; null is dropped."""
    box = F.coalesce(kind.isin("checkbox", "radio"), F.lit(False)) | name.contains("indicator") | name.startswith("chk")
    digits = lambda v: F.regexp_replace(v, r"\D", "")
    limits = contains_any(name, ["limit", "deductible"])
    row_number = default.rlike(r"^\d+$") & (whole(default) <= 20)

    def from_default(v: Column) -> Column:
        far = F.coalesce((whole(v) > 20) | (F.abs(whole(v) - whole(default)) > 3), F.lit(True))
        wrong = ~F.replace(v, F.lit("."), F.lit("")).rlike(r"^\d+$") | F.when(name.contains("produceridentifier"), far).otherwise(F.char_length(v) > F.char_length(default) + 2)
        return F.when(F.coalesce(row_number & (v != default) & wrong, F.lit(False)), default).otherwise(v)

    def city(v: Column) -> Column:
        words = F.split(v, r"\s+")
        tail = F.regexp_extract(v, r"(?:^|\s)((?:\p{L}+\s+)*\p{L}+)$", 1)
        fits = v.rlike(r"^\d+\s+\w") & (F.size(words) >= 3) & (tail != "") & (F.size(F.split(tail, r"\s+")) <= 3)
        return F.when((name.contains("cityname") | (name.contains("city") & ~name.contains("address"))) & fits, F.regexp_replace(tail, r"\s+", " ")).otherwise(v)

    def money_ends(v: Column) -> Column:
        cut = strip(F.regexp_replace(F.regexp_replace(v, r"(?i)\s*\(?ACV\)?\s*$", ""), r"(?i)\s*Actual\s+Cash\s+Value\s*$", ""))
        return F.when(contains_any(name, ["limit", "deductible", "amount"]) & ~name.contains("count"), cut).when(~contains_any(name, AMOUNT_WORDS) & v.startswith("$"), strip(F.substr(v, F.lit(2)))).otherwise(v)

    def per_what(v: Column) -> Column:
        return F.when(limits, strip(F.regexp_replace(v, r"(?i)\s*\(?\s*per\s+(occurrence|accident|person|claim)\s*\)?\s*$", ""))).otherwise(v)

    def plausible(v: Column) -> Column:
        d, n = digits(v), F.char_length(digits(v))
        year = (name.contains("modelyear") | (name.contains("vehicle") & name.contains("year"))) & (d != "") & ((n != 4) | ~whole(d).between(1950, 2028))
        code = name.contains("postalcode") & n.between(1, 4) & ~v.rlike(r"(?i)^[A-Z]\d[A-Z]\s?\d[A-Z]\d$")
        share = name.contains("percent") & name.contains("use") & F.coalesce(~real(v).between(0, 100), F.lit(False))
        insurer = name.contains("naic") & ~name.contains("code") & (d != "") & (n != 5)
        call = contains_any(name, ["phone", "fax"]) & n.between(1, 6)
        return F.when(~(year | code | share | insurer | call), v)

    def bleed(v: Column) -> Column:
        room = F.greatest(F.floor(width / 6), F.lit(5))
        spills = (width > 0) & ~kind.isin("checkbox", "radio") & (F.char_length(v) > room * 2) & (F.char_length(v) > 30) & ~contains_any(name, LONG_FIELDS)
        first = F.get(F.split(v, r"\s+"), F.lit(0))
        state = name.contains("stateorprovincecode") & first.rlike(r"^\p{L}{2}$")
        short = contains_any(name, ["code", "type"]) & ~contains_any(name, ["naic", "policy", "number"]) & (F.char_length(first) <= 5)
        return F.when(F.coalesce(spills & state, F.lit(False)), F.upper(first)).when(F.coalesce(spills & short, F.lit(False)), first).otherwise(v)

    return [
        lambda v: F.when(contains_any(name, ["date", "time"]), v).otherwise(F.regexp_replace(v, r"^(?:[A-Z]{2}\s+)?\d{1,2}/\d{1,2}/(\d+\.?\d*)$", "$1")),
        lambda v: F.when(~name.contains("stateorprovincecode") | F.upper(strip(v)).isin(STATES), v),
        lambda v: F.when(~v.startswith("From GT:"), v),
        lambda v: F.when(v.rlike(r"^[Ii|][NnYy]$"), F.upper(F.substr(v, F.lit(2)))).when(v.startswith("In ") & (F.char_length(v) == 3), "N").otherwise(v),
        lambda v: F.when(~box & (kind == "text") & F.lower(v).isin("true", "false"), F.when(F.lower(v) == "true", "Y").otherwise("N")).otherwise(v),
        lambda v: F.when(~(v.rlike(r"^[A-Z][A-Z\s#$&/]+$") & (F.char_length(v) > 10) & contains_any(name, ["naicscode", "siccode", "naiscode"])), v),
        lambda v: F.when(contains_any(name, ["percent", "rate"]) & v.endswith("%"), strip(F.regexp_replace(v, "%$", ""))).otherwise(v),
        city,
        from_default,
        lambda v: F.when((F.char_length(v) < 8) | ~v.rlike(INSTRUCTIONS), v),
        money_ends,
        per_what,
        plausible,
        bleed,
    ]


def normalise_record(rows: DataFrame, catalog: DataFrame) -> DataFrame:
    """doc, field, value of what is left of rows (doc, field, value).

    catalog has field, kind (text, checkbox, radio), default_value and width; fields that it lacks have no kind. It is
    met by an equality join on field; being small, it goes to the rows, as a shuffle by field has few keys and large ones. Null, blank and N/A values go.
    """
    catalog = F.broadcast(catalog.select("field", "kind", "default_value", "width"))
    s = strip(F.col("value"))
    named_rows = rows.filter(~s.isin("", "null", "None", "N/A", "n/a") & F.col("value").isNotNull()).join(catalog, "field", "left")
    kind, name = F.coalesce("kind", F.lit("unknown")), F.lower("field")
    typed = named_rows.withColumn("value", let(strip(F.col("value")), lambda s: _first_pass(kind, name, s))).filter(F.col("value").isNotNull())
    both = r"^([A-Z]{2})\s+(\d{5}(?:-\d{4})?)$"
    is_both = F.lower("field").contains("stateorprovincecode") & F.col("value").rlike(both)
    split = typed.filter(is_both & F.col("field").contains("StateOrProvinceCode"))
    code = F.replace(F.col("field"), F.lit("StateOrProvinceCode"), F.lit("PostalCode"))
    codes = split.select("doc", code.alias("field"), F.regexp_extract("value", both, 2).alias("value")).join(typed.select("doc", "field"), ["doc", "field"], "left_anti")
    codes = codes.join(catalog, "field", "left")
    typed = typed.withColumn("value", F.when(is_both, F.regexp_extract("value", both, 1)).otherwise(F.col("value"))).unionByName(codes)
    value = reduce(let, _later_passes(kind, name, F.col("default_value"), F.col("width")), F.col("value"))
    return typed.withColumn("value", value).filter(F.col("value").isNotNull()).select("doc", "field", "value")

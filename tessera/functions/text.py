"""String functions of intake and extraction."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.compare import contains_any, let, real, strip

# Words that tick a box; scale words of informal numbers; what names an amount; what short labels also mean.
TICKED = ["1", "true", "yes", "on", "x", "y", "checked", "selected", "☑", "✓", "✔", "☒"]
SCALES = {"k": 1_000, "thousand": 1_000, "m": 1_000_000, "mil": 1_000_000, "million": 1_000_000}
MONEY_FIELDS = ["annual_payroll", "annual_revenue", "subcontractor_cost", "premium", "cost_new", "stated_amount", "amount"]
LABEL_ALIASES = {
    "agency": "insurance agency producer broker",
    "carrier": "insurance carrier insurer company",
    "naic code": "NAIC identification code insurer",
    "naic": "NAIC identification code",
    "named insured": "named insured applicant customer",
    "producer": "producer agent agency broker",
    "policy number": "policy number identifier",
    "effective date": "policy effective date start date",
    "expiration date": "policy expiration date end date",
    "date": "form completion date",
    "phone": "phone number telephone",
    "fax": "fax number facsimile",
    "email": "email address electronic mail",
    "address": "mailing address street",
    "city": "city name municipality",
    "state": "state province code",
    "zip": "zip code postal code",
    "premium": "premium amount dollar",
    "deductible": "deductible amount",
    "limit": "coverage limit amount",
    "driver": "driver operator person",
    "vehicle": "vehicle automobile car",
    "vin": "vehicle identification number VIN",
    "dob": "date of birth birthday",
    "license": "driver license number",
    "marital": "marital status married single",
    "sex": "sex gender male female",
    "underwriter": "underwriter person name",
}


def tick(c: Column) -> Column:
    """1 for the ticking words, Off for everything else, null too."""
    return F.when(F.lower(F.trim(c)).isin(TICKED), "1").otherwise("Off")


def plain_number(c: Column) -> Column:
    """500k, $4.2M or 1 mil as a whole number; null where there is none."""
    s = F.lower(F.regexp_replace(c, r"[\s,$]", ""))
    number = real(F.regexp_extract(s, r"^([0-9]+(?:\.[0-9]+)?)", 1))
    word = F.regexp_extract(s, r"^[0-9.]+([a-z]+)$", 1)
    scale = reduce(lambda rest, kv: F.when(word == kv[0], kv[1]).otherwise(rest), SCALES.items(), F.when(word == "", 1))
    return F.round(number * scale).cast("long")


def key_form(c: Column) -> Column:
    """Blanks and slashes to underscores, # signs to Number."""
    return F.regexp_replace(F.regexp_replace(F.trim(c), r"[\s/]+", "_"), "#+", "Number")


def strip_label(c: Column, labels: list[str]) -> Column:
    """tags go, then one leading label with its colon, then trailing underscores."""
    s = F.regexp_replace(c, "<[^>]*>", "")
    s = reduce(lambda acc, label: F.regexp_replace(acc, rf"(?i)^\s*{label}\s*:\s*", ""), labels, s)
    return F.regexp_replace(s, r"_+\s*$", "")


def compact_html(c: Column) -> Column:
    """scripts, styles and comments go, headings become ##, tags blanks, white space one blank."""
    s = F.regexp_replace(c, r"(?is)<(script|style)[^>]*>.*?</(?:script|style)>", " ")
    s = F.regexp_replace(F.regexp_replace(s, r"(?s)<!--.*?-->", " "), r"(?i)<h[1-6][^>]*>", " ## ")
    return F.trim(F.regexp_replace(F.regexp_replace(s, "<[^>]*>", " "), r"\s+", " "))


def suffix(c: Column) -> Column:
    """the last _A .. _M or _number of a name."""
    return F.nullif(F.regexp_extract(c, r"_([A-M]|[0-9]+)$", 1), F.lit(""))


def readable_name(c: Column) -> Column:
    """a field name as words: its one-letter suffix goes, capitals and underscores part words."""
    return F.trim(F.lower(F.replace(F.regexp_replace(F.regexp_replace(c, "_[A-Z]$", ""), "([a-z])([A-Z])", "$1 $2"), F.lit("_"), F.lit(" "))))


def with_alias(label: Column, aliases: dict[str, str] = LABEL_ALIASES) -> Column:
    """a label that is known, case and outer blanks aside, with what it also means behind it."""
    known = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])
    return F.coalesce(F.concat(label, F.lit(" "), F.try_element_at(known, F.lower(strip(label)))), label)


def canonical_key(key: Column, aliases: dict[str, str]) -> Column:
    """the name that the caller's alias table gives a key, else the key."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv]), key), key)


def money_text(field: Column, value: Column) -> Column:
    """amounts, told by the field's name or a leading $ sign, as plain digits; $4.2 million is 4200000, an all-zero
    fraction goes, and what is no number stays as it is but for outer blanks."""

    def read(v: Column) -> Column:
        scaled = real(F.replace(F.regexp_extract(v, r"(?i)^\$?([0-9,.]+)\s*(million|mil|m)$", 1), F.lit(","), F.lit("")))
        plain = strip(F.replace(F.ltrim(v, F.lit("$")), F.lit(","), F.lit("")))
        whole = F.regexp_extract(plain, r"^0*([0-9]+?)(?:\.0*)?$", 1)
        number = F.when(plain.rlike(r"^\.0+$"), "0").when(whole != "", whole).when(plain.rlike(r"^[0-9.]*[0-9][0-9.]*$"), plain)
        is_amount = contains_any(F.lower(field), MONEY_FIELDS) | (v.startswith("$") & v.rlike("[0-9]"))
        return F.when(is_amount, F.coalesce((scaled * 1_000_000).cast("decimal(38,0)").cast("string"), number, v)).otherwise(v)

    return let(strip(value), read)


def short_id(c: Column) -> Column:
    """The first eight hex digits of a content's SHA-256."""
    return F.substring(F.sha2(c, 256), 1, 8)


def snippet(text: Column, value: Column, around: int = 40) -> Column:
    """the value's first place with so many characters on both sides."""
    at = F.instr(text, value)
    start = F.greatest(F.lit(1), at - around)
    return F.when(at > 0, F.substr(text, start, F.char_length(value) + (at - start) + around))


def looks_like_label(c: Column) -> Column:
    """Ends with a colon, or is all capitals without a digit and has five letters or more."""
    letters = F.regexp_replace(c, "[^A-Za-z]", "")
    return c.rlike(r":\s*$") | ((F.char_length(letters) >= 5) & (letters == F.upper(letters)) & ~c.rlike("[0-9]"))


def acceptable_pair(label: Column, value: Column) -> Column:
    """A value that is no label itself, no lone symbol and not over 200 characters, under a label of 120 or less."""
    return ~value.rlike(r":\s*$") & ~value.rlike(r"^[^A-Za-z0-9]{1,2}$") & (F.char_length(value).between(1, 200)) & (F.char_length(label) <= 120)

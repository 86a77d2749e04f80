"""Repair and typing of extracted values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.compare import amount, contains_any, day_of, iso_date, let, levenshtein_ratio, strip, whole

# What names a kind of field, and what a label or an amount's label says.
DATE_WORDS = "date birth hired effective expiration completion".split()
PHONE_WORDS = "phone fax tel".split()
MONEY_WORDS = "amount limit premium deductible cost value price rate charge".split()
AMOUNT_WORDS = "premium amount limit deductible".split()
MATCHED_AMOUNTS = "amount limit premium deductible cost area revenue employee".split()
BOX_VALUES = "1 0 x s yes no off true false on y n".split()
NOT_AN_AMOUNT = ["partnership", "owner", "bus", "cell", "home", "members", "no of members", "phone", "fax", "percent", "percentage", "use", "employer", "driver"]
STREET_MARKS = ["MAIN ST", "MAIN STREET", " AVE ", " AVE.", "BLVD", "SUITE", "STE ", " ST ", " ST."]
COMMON_LABELS = [
    "agency", "carrier", "naic code", "naic", "code", "date", "policy number", "effective date", "expiration date",
    "named insured", "named insured(s)", "producer", "date (mmiddiyyyy)", "date (mm/dd/yyyy)", "company",
    "proposed eff date", "proposed exp date", "billing plan", "payment plan", "method of payment", "audit", "deposit",
    "premium", "minimum", "policy premium", "premium minimum", "applicant information section",
    "commercial insurance application", "business auto section", "agency customer id:", "agency customer id",
    "acord", "status of", "transaction", "underwriter", "underwriter office", "program code", "subcode",
    "name (first named insured) and mailing address (including zip+4)", "gl code", "sic", "naics", "fein or soc sec #",
    "coverages", "limits", "indicate lines of business", "company policy or program name",
]
#: Layouts of a calendar day, in the order in which they are tried.
DAY_LAYOUTS = ("M/d/yyyy", "M-d-yyyy", "yyyy-M-d", "M/d/yy", "M-d-yy")


def named(field: Column, words: list[str]) -> Column:
    """The field's name holds one of the words."""
    return contains_any(F.lower(field), words)


def is_common_label(c: Column) -> Column:
    """The text is a form's own label."""
    return F.lower(strip(c)).isin(COMMON_LABELS)


def looks_numeric(c: Column) -> Column:
    return F.translate(strip(c), "$, ", "").rlike(r"^\d+\.?\d*$")


def may_prefill(field: Column, kind: Column, tooltip: Column, label: Column, value: Column) -> Column:
    """A pair's value may go into the field; label is in lower case with single blanks."""
    name, tip = F.lower(field), F.lower(F.coalesce(tooltip, F.lit("")))
    box = ~kind.isin("checkbox", "radio") | F.lower(strip(value)).isin(BOX_VALUES)
    listed = F.arrays_overlap(F.split(label, r"\s+"), F.array(*map(F.lit, NOT_AN_AMOUNT))) | label.isin(NOT_AN_AMOUNT)
    amount = ~contains_any(name, AMOUNT_WORDS) | (~listed & looks_numeric(value))
    street = contains_any(F.upper(strip(value)), STREET_MARKS)
    return F.coalesce(box & amount & ~((name.contains("occupancy") | tip.contains("occupancy")) & street), F.lit(False))


def invalid_for(field: Column, value: Column) -> Column:
    """A round percentage in an identifier, or no whole number in a percentage."""
    v = strip(value)
    round_share = v.rlike(r"^\d+$") & v.try_cast("int").isin(10, 15, 20, 25, 30, 40, 50, 60, 70, 75, 80, 90, 100)
    return (field.contains("ProducerIdentifier") & round_share) | (field.contains("UsePercent") & (v != "") & ~v.rlike(r"^\d+$"))


def is_person_name(c: Column, cities: list[str]) -> Column:
    """One or more capitalised words that are no known city; a single word has two letters or more."""
    return c.rlike(r"^[A-Z][a-z]+(\s+[A-Z][a-z]+)*$") & ~F.lower(c).isin(cities)


def is_city_name(c: Column, cities: list[str], people: list[str]) -> Column:
    """A known city, or a capitalised word of six letters or more that is no common name."""
    return F.lower(c).isin(cities) | (c.rlike(r"^[A-Z][a-z]{5,}$") & ~F.lower(c).isin(people))


def strict_date(c: Column) -> Column:
    """The day that the first fitting layout reads, else null. Two-digit years from 69 on are of the 1900s."""
    return let(strip(c), _strict)


def _strict(s: Column) -> Column:
    def read(layout: str) -> Column:
        parts = {"M/d/yyyy": r"^(\d{1,2})/(\d{1,2})/(\d{4})$", "M-d-yyyy": r"^(\d{1,2})-(\d{1,2})-(\d{4})$", "yyyy-M-d": r"^(\d{4})-(\d{1,2})-(\d{1,2})$", "M/d/yy": r"^(\d{1,2})/(\d{1,2})/(\d{2})$", "M-d-yy": r"^(\d{1,2})-(\d{1,2})-(\d{2})$"}[layout]
        g = [whole(F.regexp_extract(s, parts, i)) for i in (1, 2, 3)]
        y, m, d = (g[0], g[1], g[2]) if layout.startswith("y") else (g[2], g[0], g[1])
        if not layout.endswith("yyyy") and not layout.startswith("y"):
            y = y + F.when(y >= 69, 1900).otherwise(2000)
        return day_of(y, m, d)

    return F.coalesce(*map(read, DAY_LAYOUTS))


_US = "MM/dd/yyyy"


def us_date(c: Column) -> Column:
    """As mm/dd/yyyy; what is so already passes, what no layout reads but starts like a day is put so part by part
    (two-digit years under 50 are of the 2000s), anything else stays."""

    def told(v: Column) -> Column:
        m = lambda i: F.regexp_extract(v, r"^(\d{1,2})[-./](\d{1,2})[-./](\d{2,4})", i)
        year = F.when(F.char_length(m(3)) == 2, F.concat(F.when(whole(m(3)) < 50, "20").otherwise("19"), m(3))).otherwise(m(3))
        parts = F.when(m(1) != "", F.concat_ws("/", F.lpad(m(1), 2, "0"), F.lpad(m(2), 2, "0"), year))
        return F.when(v.rlike(r"^\d{2}/\d{2}/\d{4}$"), v).otherwise(F.coalesce(F.date_format(strict_date(v), _US), parts, v))

    return let(c, told)


def ocr_date(c: Column) -> Column:
    """As mm/dd/yyyy after repair, else null: a state before the day, a Y or N after it, J or a bracket read for the
    month's zero, a doubled month digit, and a letter or bracket read for the year's last digit go."""
    s = F.regexp_replace(strip(c), r"^[A-Z]{1,2}\s+", "")
    s = F.regexp_replace(F.regexp_replace(s, r"\s*[|/\[\]]+\s*[YNyn]?\s*$", ""), r"\s*[YNyn]\s*$", "")
    s = F.regexp_replace(s, r"^[J)\]](\d)[/-](\d{1,2})[/-](\d{4}).*$", "0$1/$2/$3")

    def month(v: Column) -> Column:
        n = whole(F.regexp_extract(v, r"^(\d\d)[/-]\d{1,2}[/-]\d{4}", 1))
        return F.when((n > 12) & (n % 10 > 0), F.regexp_replace(v, r"^\d(\d)[/-](\d{1,2})[/-](\d{4}).*$", "0$1/$2/$3")).otherwise(v)

    def read(v: Column) -> Column:
        day_first = F.regexp_replace(v, r"^(\d{1,2})/(\d{1,2})/(\d{4})$", "$2/$1/$3")
        words = F.when(v.rlike(r"^\p{L}+ \d+, [+-]?\d+$"), F.try_to_timestamp(F.initcap(v), F.lit("MMMM d, yyyy")).cast("date"))
        inside = lambda i: F.regexp_extract(v, r"(\d{1,2})[/-](\d{1,2})[/-](\d{4})", i)
        ranged = whole(inside(1)).between(1, 12) & whole(inside(2)).between(1, 31)
        loose = F.when(ranged, F.concat_ws("/", F.lpad(inside(1), 2, "0"), F.lpad(inside(2), 2, "0"), inside(3)))
        return F.coalesce(*[F.date_format(d, _US) for d in (strict_date(v), strict_date(day_first), words)], loose)

    return let(F.regexp_replace(let(s, month), r"(\d{3})[ECec:;()\[\]]+\s*$", "$10"), read)


def first_date(c: Column) -> Column:
    """The first m/d/yyyy in the text."""
    return F.nullif(F.regexp_extract(c, r"\d{1,2}/\d{1,2}/\d{4}", 0), F.lit(""))


def clean_text(c: Column) -> Column:
    """single blanks, and one pair of quotes around the whole goes."""
    s = strip(F.regexp_replace(c, r"\s+", " "))
    return F.when(s.rlike(r"""^(".*"|'.*')$""") & (F.char_length(s) >= 2), F.substr(s, F.lit(2), F.char_length(s) - 2)).otherwise(s)


def clean_phone(c: Column) -> Column:
    """a leading PHONE:, TEL:, FAX: or the like goes."""
    return strip(F.regexp_replace(c, r"(?i)^(?:PHONE|TEL|FAX|TELEPHONE)\s*[#:]\s*", ""))


def ocr_money(c: Column) -> Column:
    """An amount without sign, comma and blank; O between digits is 0, l or I is 1; a whole number loses its fraction."""
    s = F.regexp_replace(F.regexp_replace(F.translate(c, "$, ", ""), r"(?<=\d)O(?=\d)", "0"), r"(?<=\d)[lI](?=\d)", "1")
    number = F.when(s.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)$"), s.try_cast("double"))
    whole = F.when(number == F.floor(number), number.cast("long").cast("string"))
    return F.coalesce(whole, number.cast("string"), s)


def safe_int(c: Column, default: int = 0) -> Column:
    """A whole number without comma, sign and blanks around it, else the default, 1.5 too."""
    s = strip(F.translate(c, ",$", ""))
    return F.coalesce(F.when(s.rlike(r"^[+-]?\d+$"), s.try_cast("long")), F.lit(default))


def safe_float(c: Column, default: float = 0.0) -> Column:
    """As safe_int for a number with a fraction; an M counts as six zeros, so 1.2M is 1.2."""
    s = strip(F.replace(F.translate(c, ",$", ""), F.lit("M"), F.lit("000000")))
    return F.coalesce(F.when(s.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), s.try_cast("double")), F.lit(default))


def y_region(y: Column) -> Column:
    """Thirds of the page from the top, and the rest."""
    return F.when((y >= 0) & (y < 600), "top").when((y >= 600) & (y < 1200), "upper_mid").when((y >= 1200) & (y < 1800), "lower_mid").otherwise("bottom")


# What tells a form, in the order in which it is tried.
FORM_MARKS = {"137": ["137", "vehicle schedule"], "127": ["127", "business auto"], "125": ["125", "commercial insurance", "commercial application"]}


def form_type(name: Column, text: Column) -> Column:
    """F16: the first form whose mark the file name or the text's first 2000 characters hold, else null."""
    seen = F.lower(F.concat(F.coalesce(name, F.lit("")), F.lit(" "), F.substring(F.coalesce(text, F.lit("")), 1, 2000)))
    return reduce(lambda rest, kv: F.when(contains_any(seen, kv[1]), kv[0]).otherwise(rest), reversed(FORM_MARKS.items()), F.lit(None).cast("string"))


# Spelled kinds of a business and their canonical names.
ENTITY_TYPES = {
    "corporation": "corporation", "partnership": "partnership", "llc": "llc", "limited liability": "llc",
    "limited liability company": "llc", "individual": "individual", "sole proprietor": "individual",
    "subchapter s": "subchapter_s", "s corporation": "subchapter_s", "s corp": "subchapter_s", "joint venture": "joint_venture",
}


def entity_type(c: Column, names: dict[str, str] = ENTITY_TYPES) -> Column:
    """the canonical name of a kind of business, - and _ being blanks; an unknown kind stays in lower case, an empty one is null."""
    form = F.lower(strip(F.translate(c, "-_", "  ")))
    found = reduce(lambda rest, kv: F.when(form == kv[0], kv[1]).otherwise(rest), names.items(), F.lit(None).cast("string"))
    return F.when(strip(c) != "", F.coalesce(found, F.lower(strip(c))))


# Symbols of ticked and open boxes.
TICKED_BOXES, OPEN_BOXES = "☑✓☒", "☐✗✘"


def box_states(text: Column) -> Column:
    """label to 1 or Off, from lines with a box symbol before the label; of equal labels the last counts."""
    found = F.regexp_extract_all(text, F.lit(rf"([{TICKED_BOXES}{OPEN_BOXES}])[ \t]*([^\n{TICKED_BOXES}{OPEN_BOXES}]+)"), F.lit(0))
    pairs = F.transform(found, lambda x: F.struct(F.rtrim(F.regexp_replace(F.substr(x, F.lit(2)), r"^[ \t]+", "")).alias("label"), F.when(F.instr(F.lit(TICKED_BOXES), F.substr(x, F.lit(1), F.lit(1))) > 0, "1").otherwise("Off").alias("state")))
    last = F.filter(pairs, lambda p, i: (p["label"] != "") & ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs) - i - 1, F.lit(0))), lambda q: q["label"] == p["label"]))
    return F.map_from_entries(last)


def boxes_as_text(text: Column) -> Column:
    """box symbols as [CHECKED] and [UNCHECKED]."""
    return F.regexp_replace(F.regexp_replace(text, f"[{TICKED_BOXES}]", "[CHECKED]"), f"[{OPEN_BOXES}]", "[UNCHECKED]")


# Name starts that give a field's category, in order.
CATEGORY_STARTS = {
    "vehicle": ["vehicle_"], "driver": ["driver_"], "policy": ["policy_"], "producer": ["producer_"], "insurer": ["insurer_"],
    "named_insured": ["namedinsured_", "named_insured_"], "header": ["form_"], "location": ["location"],
}


def category(field: Column) -> Column:
    """by how the name starts, then a checkbox by its words, then a commercial vehicle, else general."""
    name = F.lower(field)
    starts = lambda words: reduce(lambda a, b: a | b, [name.startswith(w) for w in words])
    rest = F.when(contains_any(name, ["indicator", "checkbox"]), "checkbox").when(starts(["commercialvehicle", "commercial_vehicle"]), "vehicle").otherwise("general")
    return reduce(lambda r, kv: F.when(starts(kv[1]), kv[0]).otherwise(r), reversed(CATEGORY_STARTS.items()), rest)


def affinity(label: Column, field: Column, tooltip: Column) -> Column:
    """how well a label names a field, by its tooltip (0.95, 0.90, 0.85), by its name (0.75, 0.70, 0.65), else 0.10."""
    norm = strip(F.regexp_replace(F.regexp_replace(F.lower(strip(label)), r"[:\-#]", " "), r"\s+", " "))
    return let(norm, lambda v: _affinity(v, field, tooltip))


def _affinity(norm: Column, field: Column, tooltip: Column) -> Column:
    words = F.filter(F.split(norm, " "), lambda w: F.char_length(w) > 1)
    tip, name = F.lower(F.coalesce(tooltip, F.lit(""))), F.lower(F.translate(field, "_", " "))
    first = F.get(words, F.lit(0))
    in_tip = F.size(F.filter(words, lambda w: (F.char_length(w) > 2) & F.contains(tip, w)))
    in_name = F.size(F.filter(words, lambda w: F.contains(name, w)))
    tips = (tip != "") & (F.char_length(norm) > 2)
    return (
        F.when(F.size(words) == 0, 0.10)
        .when(tips & tip.contains(norm), 0.95)
        .when(tips & (F.size(words) >= 2) & (in_tip >= 2), 0.90)
        .when(tips & (F.size(words) == 1) & tip.contains(first) & (F.char_length(first) > 4), 0.85)
        .when(name.contains(norm), 0.75)
        .when((F.size(words) >= 2) & (in_name >= 2), 0.70)
        .when(name.contains(first) & (F.char_length(first) > 4), 0.65)
        .otherwise(0.10)
    )


def match_basis(label: Column, field: Column, tooltip: Column) -> Column:
    """Tooltip or field_name, by which a label (lower case, single blanks) refers to the field, else null."""
    words = F.filter(F.split(label, " "), lambda w: F.char_length(w) > 1)
    tip, name = F.lower(F.coalesce(tooltip, F.lit(""))), F.lower(F.translate(field, "_", " "))
    first = F.get(words, F.lit(0))
    long_first = F.char_length(first) > 4
    in_tip = F.size(F.filter(words, lambda w: (F.char_length(w) > 2) & F.contains(tip, w)))
    in_name = F.size(F.filter(words, lambda w: F.contains(name, w)))
    by_tip = (tip != "") & (F.char_length(label) > 3) & (tip.contains(label) | ((F.size(words) >= 2) & (in_tip >= 2)) | ((F.size(words) == 1) & tip.contains(first) & long_first))
    generic = first.isin("indicator", "explanation", "description", "amount", "date", "code", "number", "name")
    by_name = name.contains(label) | ((F.size(words) >= 2) & (in_name >= 2)) | (~generic & name.contains(first) & long_first)
    return F.when(F.char_length(label) >= 3, F.when(by_tip, "tooltip").when(by_name, "field_name"))


def matching_form(value: Column, field: Column) -> Column:
    """a value as it is matched: a day, an amount or a phone number's digits by the field's name, else lower case;
    empty for null."""
    name, s = F.lower(F.coalesce(field, F.lit(""))), strip(F.coalesce(value, F.lit("")))
    typed = F.when(s == "", "").when(name.contains("date") & ~name.contains("update"), iso_date(s)).when(contains_any(name, MATCHED_AMOUNTS), amount(s))
    return typed.when(contains_any(name, ["phone", "fax"]), F.regexp_replace(s, "[^0-9]", "")).otherwise(F.lower(s))


def match_score(expected: Column, found: Column) -> Column:
    """F09 on matching forms: 1 equal, 0.95 equal digits (3 or more) or the same day, 0.80 containment of half or more of
    texts of 3 characters or more, else 0.85 of an edit ratio from 0.85 on; 0 where either is empty."""
    dx, dy = F.regexp_replace(expected, "[^0-9]", ""), F.regexp_replace(found, "[^0-9]", "")
    shorter, longer = F.least(F.char_length(expected), F.char_length(found)), F.greatest(F.char_length(expected), F.char_length(found))
    held = (shorter >= 3) & (expected.contains(found) | found.contains(expected)) & (shorter / longer >= 0.5)
    same_day = let(iso_date(expected), lambda day: day.rlike(r"[0-9]{4}-[0-9]{2}-[0-9]{2}") & (day == iso_date(found)))
    ratio = levenshtein_ratio(expected, found)
    scored = F.when(expected == found, 1.0).when((F.char_length(dx) >= 3) & (dx == dy), 0.95).when(same_day, 0.95).when(held, 0.80)
    return F.when((F.coalesce(expected, F.lit("")) == "") | (F.coalesce(found, F.lit("")) == ""), 0.0).otherwise(scored.when(ratio >= 0.85, F.round(ratio * 0.85, 6)).otherwise(0.0))

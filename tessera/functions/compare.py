"""Type-aware comparison of an expected and an extracted value, as Column expressions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Checkbox words and address abbreviations of the comparison.
TRUE_WORDS = "true 1 on yes x checked y s ☑ ✓ ✔ ☒ selected".split()
FALSE_WORDS = ["false", "0", "off", "no", "unchecked", "", "n", "☐", "□", "unselected", "none"]
ABBREVIATIONS = {
    "st": "street", "ave": "avenue", "blvd": "boulevard", "dr": "drive", "ln": "lane", "rd": "road",
    "ct": "court", "pl": "place", "pkwy": "parkway", "hwy": "highway", "ste": "suite", "apt": "apartment",
    "fl": "floor", "n": "north", "s": "south", "e": "east", "w": "west",
}
NON_CHECKBOX_CODES = "gender marital symbol province state type class".split()


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once a row, though f names it often: written out each time it would multiply."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def contains_any(c: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [c.contains(w) for w in words])


def whole(c: Column) -> Column:
    """The text as an int, else null. Only what looks like one is cast: a cast that fails raises an exception inside."""
    return F.when(c.rlike(r"^[\x00-\x20\x7f]*[+-]?\d+[\x00-\x20\x7f]*$"), c.try_cast("int"))


def real(c: Column) -> Column:
    """The text as a double, else null; texts that can't be one are not cast."""
    return F.when(c.rlike(r"(?i)\d|nan|inf"), c.try_cast("double"))


def day_of(year: Column, month: Column, day: Column) -> Column:
    """The calendar day of three whole numbers, else null.

    Told by arithmetic: a parser raises an exception for each text that is no day, which takes longer than all else here.
    """

    def told(p: Column) -> Column:
        y, m, d = p["y"], p["m"], p["d"]
        leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
        last = F.when(m == 2, F.when(leap, 29).otherwise(28)).when(m.isin(4, 6, 9, 11), 30).otherwise(31)
        return F.when(y.between(0, 9999) & m.between(1, 12) & (d >= 1) & (d <= last), F.make_date(y, m, d))

    return let(F.struct(year.cast("int").alias("y"), month.cast("int").alias("m"), day.cast("int").alias("d")), told)


def _ymd(year: Column, month: Column, day: Column) -> Column:
    """ISO text where the parts are a calendar day, else null."""
    return F.date_format(day_of(year, month, day), "yyyy-MM-dd")


def _part(c: Column, pattern: str, group: int) -> Column:
    return F.expr("try_cast(0 AS INT)") if pattern == "" else whole(F.regexp_extract(c, pattern, group))


MONTHS = "january february march april may june july august september october november december".split()


def _iso(s: Column) -> Column:
    mdy, ymd, short = r"^(\d{1,2})([/-])(\d{1,2})\2(\d{4})$", r"^(\d{4})([/-])(\d{1,2})\2(\d{1,2})$", r"^(\d{1,2})/(\d{1,2})/(\d{2})$"
    named = r"(?i)^([a-z]{3,9}) (\d{1,2}), (\d{4})$"
    word = F.lower(F.regexp_extract(s, named, 1))
    month = reduce(lambda rest, m: F.when((word == m[1]) | (word == m[1][:3]), m[0]).otherwise(rest), enumerate(MONTHS, 1), F.lit(None).cast("int"))
    two = _part(s, short, 3)
    inside = r"(\d{1,2})[/-](\d{1,2})[/-](\d{4})"
    m, d = _part(s, inside, 1), _part(s, inside, 2)
    loose = F.when(m.between(1, 12) & d.between(1, 31), F.concat_ws("-", whole(F.regexp_extract(s, inside, 3)).cast("string"), F.lpad(m.cast("string"), 2, "0"), F.lpad(d.cast("string"), 2, "0")))
    return F.coalesce(
        _ymd(_part(s, mdy, 4), _part(s, mdy, 1), _part(s, mdy, 3)),
        _ymd(_part(s, ymd, 1), _part(s, ymd, 3), _part(s, ymd, 4)),
        _ymd(_part(s, mdy, 4), _part(s, mdy, 3), _part(s, mdy, 1)),
        _ymd(_part(s, named, 3), month, _part(s, named, 2)),
        _ymd(F.when(two >= 69, two + 1900).otherwise(two + 2000), _part(s, short, 1), _part(s, short, 2)),
        loose,
        F.lower(s),
    )


def iso_date(c: Column) -> Column:
    """The first layout that gives a calendar day, else m/d/yyyy inside the text by range only, else lower case."""
    return let(strip(c), _iso)


def amount(c: Column) -> Column:
    """Digits and the point; an all-zero fraction goes."""
    digits = F.regexp_replace(strip(c), r"[^0-9.]", "")
    whole = F.when(digits.rlike(r"^[0-9]*\.0*$"), F.when(F.regexp_extract(digits, r"^([0-9]*)", 1) == "", "0").otherwise(F.regexp_extract(digits, r"^([0-9]*)", 1))).otherwise(digits)
    return F.when(whole != "", whole).otherwise(F.lower(strip(c)))


def expand_address(c: Column) -> Column:
    """stops at word ends go, then each abbreviation is written out, in order."""
    plain = F.regexp_replace(F.lower(strip(c)), r"\.(?=\s|$)", "")
    return reduce(lambda s, kv: F.regexp_replace(s, rf"\b{kv[0]}\b", kv[1]), ABBREVIATIONS.items(), plain)


def _email(c: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(c, r"\s+@", "@"), r"@\s+", "@")
    for end in ("com", "org", "net"):
        s = F.replace(F.replace(s, F.lit(f" {end}"), F.lit(f".{end}")), F.lit(f"_{end}"), F.lit(f".{end}"))
    return F.lower(s)


def comparable(value: Column, field: Column, is_checkbox: Column | None = None) -> Column:
    """the comparable form of a value, by what its field's name says; null is empty."""
    return F.coalesce(let(strip(value), lambda s: _comparable(s, F.lower(field), is_checkbox)), F.lit(""))


def _comparable(s: Column, name: Column, is_checkbox: Column | None) -> Column:
    low = F.lower(s)
    words = TRUE_WORDS + FALSE_WORDS
    checkbox = name.contains("indicator") | name.startswith("chk") | (name.contains("code") & low.isin(words) & ~contains_any(name, NON_CHECKBOX_CODES))
    if is_checkbox is not None:
        checkbox = checkbox | is_checkbox
    digits = F.regexp_replace(s, r"[^0-9]", "")
    return (
        F.when(checkbox, F.when(low.isin(TRUE_WORDS), "true").when(low.isin(FALSE_WORDS), "false").otherwise(low))
        .when(name.contains("date") & ~name.contains("update"), iso_date(s))
        .when(name.contains("effectivetime") | name.contains("expirationtime"), F.when(digits.rlike("^[0-9]{1,4}$"), F.lpad(digits, 4, "0")).otherwise(low))
        .when(contains_any(name, "amount limit premium deductible cost".split()) & ~name.contains("count"), amount(s))
        .when((name.contains("area") | name.contains("count")) & s.rlike(r"^[0-9,.\s]+$"), amount(s))
        .when(name.contains("email") & s.contains("@"), _email(s))
        .when(contains_any(name, "address lineone linetwo cityname".split()), expand_address(s))
        .otherwise(low)
    )


#: What may stand around a value that bled from a neighbour; group 1 is the value.
NOISE = (r"^[a-z]{1,2}\s+(.+)$", r"^[0-9]+\s+(.+)$", r"^[0-9]{1,2}/[0-9]{1,2}/(.+)$", r"^[a-z\s]+:\s*(.+)$", r"^(.+?)\s*[|/\[\]].+$", r"^[i|](.)$", r"^(.+?)\s*\|?\s*[yn]$")


def noise_equal(expected: Column, found: Column) -> Column:
    """found is expected with one known kind of noise around it."""
    hits = [strip(F.regexp_extract(found, p, 1)) == expected for p in NOISE]
    return (expected != "") & (F.char_length(found) > F.char_length(expected)) & reduce(lambda a, b: a | b, hits)


def same_answer(a: Column, b: Column) -> Column:
    """Y or N against a spelled boolean."""
    yes, no = ["y", "true", "yes"], ["n", "false", "no"]
    return ((a.isin(yes) & b.isin(yes)) | (a.isin(no) & b.isin(no))) & ((F.char_length(a) == 1) | (F.char_length(b) == 1))


def status(expected: Column, found: Column, noise: bool = True) -> Column:
    """J16 on comparable forms; null where nothing is expected."""
    near = found.contains(expected) | expected.contains(found)
    exact = (expected == found) | same_answer(expected, found)
    if noise:
        exact = exact | (near & (noise_equal(expected, found) | noise_equal(found, expected)))
    return F.when(expected == "", None).when(found == "", "missing").when(exact, "matched").when(near, "partial").otherwise("wrong")


def levenshtein_ratio(a: Column, b: Column) -> Column:
    """1 - distance / longer length; 0 where lengths differ by more than 15 percent."""
    longer = F.greatest(F.char_length(a), F.char_length(b))
    gap = F.abs(F.char_length(a) - F.char_length(b))
    return F.when(longer == 0, 1.0).when(gap > longer * 0.15, 0.0).otherwise(1 - F.levenshtein(a, b) / longer)


def fusion_form(c: Column) -> Column:
    """lower case, single blanks, no comma, dollar or hyphen."""
    return F.translate(F.regexp_replace(F.lower(strip(c)), r"\s+", " "), ",$-", "")

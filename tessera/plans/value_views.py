"""Value functions and the composite normaliser, on known answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import values as V
from tessera.functions.checks import age_warns, repair_vin
from tessera.operators.catalog import difficulty, enriched_tooltip
from tessera.operators.normalise import normalise_record, normalise_value
from tessera.plans.known import cases, known_rows, known_values

known_values("us_date", "D02.", "v string", [("01/15/2024", "01/15/2024"), ("1-15-2024", "01/15/2024"), ("1/5/49", "01/05/2049"), ("13.04.22", "13/04/2022"), ("2024-01-05", "01/05/2024"), ("soon", "soon"), (None, None), ("5.6.71", "05/06/1971")], V.us_date)
known_values(
    "ocr_date", "D03.", "v string",
    [("NC 04/01/2022", "04/01/2022"), ("04/01/2022 | N", "04/01/2022"), ("J4/01/2022", "04/01/2022"), (")2/11/2020", "02/11/2020"), ("13/04/2022", "03/04/2022"), ("04/01/201E", "04/01/2010"),
     ("March 5, 2021", "03/05/2021"), ("02-30-2021", "02/30/2021"), ("2021-03-05", "03/05/2021"), ("no day", None), ("", None), (None, None), ("20/04/2022", "20/04/2022")][:-1],
    V.ocr_date,
)
known_values("strict_date", "D04.", "v string", [("1/5/2024", "2024-01-05"), ("1-5-24", "2024-01-05"), ("12/31/69", "1969-12-31"), ("2024-2-30", None), ("2023-12-01", "2023-12-01"), ("13/04/2022", None), (" 02/29/2024 ", "2024-02-29"), (None, None)], lambda v: V.strict_date(v).cast("string"))
known_values("first_date", "D05.", "v string", [("from 1/5/2024 to 2/6/2025", "1/5/2024"), ("01/05/24", None), ("x12/31/2020y", "12/31/2020"), ("", None), (None, None)], V.first_date)
known_values("age_rule", "D06.", "v string", [("2010-01-02", True), ("2009-01-01", False), ("1903-12-30", True), ("1990-06-01", False), (None, None)], lambda v: age_warns(v.cast("date"), F.lit("2024-06-01").cast("date")), "BOOLEAN")
known_values("vin_repair", "F24.", "v string", [(" 1hgcm82633a0o4352 ", "1HGCM82633A004352"), ("IOQ", "100"), ("", ""), (None, None)], repair_vin)
known_values("text_cleanup", "F12.", "v string", [("  a \n b\t c ", "a b c"), ('"quoted"', "quoted"), ("'q'", "q"), ('"open', '"open'), ('"', '"'), ("", ""), (None, None)], V.clean_text)
known_values("phone_cleanup", "F12.", "v string", [("PHONE: 555 1234", "555 1234"), ("tel# 5", "5"), ("FAX 5", "FAX 5"), (" 1 ", "1"), (None, None)], V.clean_phone)
known_values("ocr_money", "F26: amounts.", "v string", [("$1,000.00", "1000"), ("$1 2O3", "1203"), ("4l5", "415"), ("12.5", "12.5"), ("S1,00O", "S100O"), ("", ""), (None, None)], V.ocr_money)
known_values("safe_int", "N02.", "v string", [("$1,234", 1234), ("1.5", 0), (" 12 ", 12), ("-3", -3), ("", 0), (None, 0)], V.safe_int, "BIGINT")
known_values("safe_float", "N02.", "v string", [("$1,234.5", 1234.5), ("1.2M", 1.2), ("2M", 2000000.0), ("x", 0.0), (None, 0.0)], V.safe_float, "DOUBLE")
known_values("y_region", "N05.", "v double", [(0.0, "top"), (599.9, "top"), (600.0, "upper_mid"), (1200.0, "lower_mid"), (1800.0, "bottom"), (-1.0, "bottom")], V.y_region)
known_values("form_type", "F16.", "name string, text string", [("ACORD_137.pdf", "127", "137"), ("x", "A Business Auto section", "127"), ("", "COMMERCIAL INSURANCE application", "125"), ("163.pdf", "163", None), (None, None, None), ("", "x" * 2000 + "127", None)], V.form_type)
known_values("entity_type", "F20.", "v string", [("S-Corp", "subchapter_s"), (" LLC ", "llc"), ("joint_venture", "joint_venture"), ("Trust", "trust"), ("  ", None), (None, None)], V.entity_type)
known_values("field_category", "F15.", "v string", [("Vehicle_Year_A", "vehicle"), ("Driver_Name", "driver"), ("NamedInsured_X", "named_insured"), ("Form_Date", "header"), ("LocationA", "location"), ("SomeIndicator", "checkbox"), ("CommercialVehicle_Indicator", "checkbox"), ("commercial_vehicle", "vehicle"), ("Other", "general"), (None, "general")], V.category)
known_values("checkbox_states", "F22.", "v string", [("☑ Yes\n☐ No", "No=Off,Yes=1"), ("a ✓ One ☐ Two", "One=1,Two=Off"), ("☐ Same\n☑ Same", "Same=1"), ("none", ""), ("☑ \n", "")], lambda v: F.array_join(F.array_sort(F.transform(F.map_entries(V.box_states(v)), lambda e: F.concat_ws("=", e["key"], e["value"]))), ","))
known_values("checkbox_text", "F22.", "v string", [("☑ a ☐ b", "[CHECKED] a [UNCHECKED] b"), ("✗✓", "[UNCHECKED][CHECKED]"), ("x", "x"), (None, None)], V.boxes_as_text)
known_values("field_kinds", "P18.", "v string", [("EffectiveDate", "date"), ("DateOfBirth", "date"), ("FaxNumber", "phone"), ("Telephone", "phone"), ("LimitAmount", "money"), ("RateCode", "money"), ("City", "none"), (None, "none")], lambda v: F.when(V.named(v, V.DATE_WORDS), "date").when(V.named(v, V.PHONE_WORDS), "phone").when(V.named(v, V.MONEY_WORDS), "money").otherwise("none"))
known_values("common_label", "P11.", "v string", [(" Agency ", True), ("NAIC CODE", True), ("Acme Agency", False), ("", False), (None, None)], V.is_common_label, "BOOLEAN")
known_values("invalid_for_field", "P13.", "f string, v string", [("Driver_ProducerIdentifier_A", " 100", True), ("Driver_ProducerIdentifier_A", "13", False), ("Vehicle_UsePercent_A", "John", True), ("Vehicle_UsePercent_A", "80", False), ("Vehicle_UsePercent_A", "", False), ("Other", "100", False)], V.invalid_for, "BOOLEAN")
known_values(
    "prefill_guard", "P12.", "f string, k string, t string, l string, v string",
    [("Ind", "checkbox", None, "x", "Yes", True), ("Ind", "checkbox", None, "x", "maybe", False), ("PolicyPremium", "text", None, "premium", "$1,200", True), ("PolicyPremium", "text", None, "premium", "abc", False),
     ("PolicyPremium", "text", None, "owner premium", "12", False), ("Occupancy", "text", None, "use", "12 Main St ", False), ("Other", "text", "Describe the occupancy", "use", "5 BLVD", False), ("Other", "text", None, "use", "5 BLVD", True), ("Limit", "text", None, "limit", None, False)],
    V.may_prefill, "BOOLEAN",
)
_CITIES, _PEOPLE = ["dallas", "new york"], ["robert"]
known_values("name_shapes", "P17.", "v string", [("John", "person"), ("Dallas", "city"), ("David French", "person"), ("New York", "city"), ("Springfield", "both"), ("Robert", "person"), ("JOHN", "none"), ("J", "none"), (None, "none")],
             lambda v: F.when(V.is_person_name(v, _CITIES) & V.is_city_name(v, _CITIES, _PEOPLE), "both").when(V.is_person_name(v, _CITIES), "person").when(V.is_city_name(v, _CITIES, _PEOPLE), "city").otherwise("none"))
known_values(
    "label_affinity", "F10.", "l string, f string, t string",
    [("Policy Number:", "PolicyNo", "Enter the policy number", 0.95), ("number of policy", "X", "policy has a number", 0.90), ("Underwriter-X", "X", "the underwriter", 0.85), ("Name", "Insured_Name", None, 0.75), ("full insured name", "Insured_Name", None, 0.70), ("insured x", "Insured_Name", None, 0.65), ("zzz", "Insured_Name", None, 0.10), ("", "a", None, 0.10)],
    V.affinity, "DOUBLE",
)
known_values("tooltip_enrichment", "P23.", "k string, f string, t string", [("checkbox", "A", "Tick it.", "Tick it. Return 1 if checked, Off if not."), ("radio", "A", None, "Checkbox. Return 1 if checked, Off if not."), ("checkbox", "A", "1 or Off", "1 or Off"), ("text", "StartDate", "The date", "The date (MM/DD/YYYY)."), ("text", "LimitAmount", "Enter amount", "Enter amount Use dollar amount."), ("text", "LimitAmount", "Enter amount.", "Enter amount."), ("text", "City", "A city", "A city")], enriched_tooltip)
known_values("difficulty", "N12.", "n int, s string, c boolean", [(2, "mixed", False, "hard3"), (2, "conversational", True, "hard3"), (1, "conversational", False, "easy1"), (1, "bulk_email", True, "medium2"), (2, "conversational", False, "medium2")], lambda n, s, c: F.concat(difficulty(n, s, c)["difficulty"], difficulty(n, s, c)["phase"].cast("string")))
known_values(
    "normalise_value", "F26.", "k string, f string, v string",
    [("checkbox", "A", "YES", "1"), ("radio", "A", "12/31/2020", "Off"), ("text", "StartDate", "Date: 1/5/2024", "01/05/2024"), ("text", "LimitAmount", "$1,000", "1000"), ("text", "Phone_A", "TEL: 555", "555"), ("text", "City", "City: <b>Bonn</b>  am Rhein", "Bonn am Rhein"), ("text", "City", "  N/A ", None), ("text", "City", None, None)],
    normalise_value,
)

_CATALOG = [
    ("Chk_A", "checkbox", None, None), ("Flag_A", "text", None, None), ("Driver_ProducerIdentifier_B", "text", "2", None), ("Status_Type", "text", None, 30.0),
    ("Mailing_StateOrProvinceCode_A", "text", None, 20.0), ("Row_No", "text", "3", None),
]
_RECORDS = [
    [("Chk_A", "Yes", "1"), ("SomeIndicator", "12/31/2020", "Off"), ("Flag_A", "true", "Y"), ("NoFaultCode", "y", "True"), ("EffectiveTime", "01/01/2020", None), ("ExpirationTime", "12:1", "0121"), ("EffectiveDate", "NC 04/01/2022", "04/01/2022")],
    [("Mailing_StateOrProvinceCode_A", "DC 20016", "DC"), ("Mailing_PostalCode_A", None, "20016"), ("Bad_StateOrProvinceCode", "ZZ", None), ("LimitAmount", "$1,000.50", "1000.50"), ("HiredCount", "02/19/150", "150"), ("UseCount", "WI 02/20/7", "7")],
    [("Note", "From GT: x", None), ("Short", "|N", "N"), ("Short2", "In ", "N"), ("NAICSCode", "FEIN OR SOC SEC #", None), ("UsePercent", "80%", "80"), ("UsePercent_B", "120%", None), ("X_CityName", "12 Main Road Bonn", "Main Road Bonn")],
    [("Driver_ProducerIdentifier_B", "31", "2"), ("Row_No", "abc", "3"), ("Help", "Enter Y for Yes", None), ("Deductible", "500 ACV", "500"), ("OtherValue", "$12", "12"), ("Each_Limit", "per accident 5", "5")],
    [("Vehicle_ModelYear_A", "1890", None), ("Vehicle_ModelYear_B", "2020", "2020"), ("X_PostalCode", "123", None), ("Insurer_NAIC", "1234", None), ("Phone_A", "12/3", None), ("Status_Type", "OPEN with a very long tail of words here", "OPEN"), ("Mail_Email", "adam @foo com", "adam@foo.com"), ("FullName", "Downs; Bruce", "Downs, Bruce")],
    [("A_VINIdentifier", "1hgcm82633ao04352", "1HGCM82633A004352"), ("WebSite", "https:IIx com", "https://x.com"), ("B_PostalCode", "12345-6789", "12345"), ("LineOne", "5 Main; Bonn", "5 Main, Bonn"), ("Empty", " N/A ", None), ("Null", None, None)],
]


def _records(spark, sf_dir):
    rows = cases(spark, sf_dir, "field string, value string", [[(f, v) for f, v, _ in case] for case in _RECORDS])
    return normalise_record(rows, spark.createDataFrame(_CATALOG, "field string, kind string, default_value string, width double"))


known_rows("normalise_record", "F25: the composite normaliser, each pass by a known case.", ["field", "value"], [[(f, out) for f, _, out in case if out is not None] for case in _RECORDS], _records)

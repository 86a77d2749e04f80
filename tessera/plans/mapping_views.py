"""Label maps, numbered and fixed fields, Markdown pairs, page geometry and examples, on known answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions import values as V
from tessera.operators import layout as L
from tessera.operators import mapping as M
from tessera.plans.known import cases, known_rows, known_values
from tessera.plans.registry import query
from tessera.plans.session import table
from tessera.sources.files import page_images, usable_cache

known_values("readable_name", "F14.", "v string", [("Producer_FullName_A", "producer full name"), ("VINNumber", "vinnumber"), ("aB_cD", "a b c d"), ("Name_AA", "name aa"), ("_A", ""), ("", ""), (None, None)], T.readable_name)
known_values("label_alias", "F17.", "v string", [("VIN", "VIN vehicle identification number VIN"), (" Named Insured ", " Named Insured  named insured applicant customer"), ("agency:", "agency:"), ("", ""), (None, None)], T.with_alias)
known_values("canonical_key", "F21: names; the alias table is the caller's.", "v string", [("business_city", "mailing_city"), ("num_employees", "employee_count"), ("Business_City", "Business_City"), ("", ""), (None, None)], lambda v: T.canonical_key(v, {"business_city": "mailing_city", "num_employees": "employee_count"}))
known_values(
    "money_text", "F21: amounts.", "f string, v string",
    [("annual_revenue", "$4.2 million", "4200000"), ("annual_revenue", "1.5M", "1500000"), ("x", "$1,850,000", "1850000"), ("x", "1,850", "1,850"), ("premium", "67,500.50", "67500.50"), ("Premium", "100.00", "100"), ("premium", "007", "7"),
     ("premium", ".0", "0"), ("premium", "1.2.3", "1.2.3"), ("premium", " unknown ", "unknown"), ("x", "$five", "$five"), ("premium", "2mil", "2000000"), ("x", None, None), ("premium", "", "")],
    T.money_text,
)
known_values(
    "matching_form", "F06.", "f string, v string",
    [("StartDate", "1/5/2024", "2024-01-05"), ("UpdateDate", "1/5/2024", "1/5/2024"), ("LimitAmount", "$1,000.00", "1000"), ("BuildingArea", "none", "none"), ("FaxNumber", "(555) 12-34", "5551234"), ("City", " Bonn ", "bonn"), (None, "X", "x"), ("City", "", ""), ("City", None, "")],
    lambda f, v: V.matching_form(v, f),
)
known_values(
    "match_score", "F09.", "a string, b string",
    [("bonn", "bonn", 1.0), ("(555) 12", "555-12", 0.95), ("2024-01-05", "1/5/2024", 0.95), ("march 5, 2021", "3/5/2021", 0.95), ("ab", "abc", 0.0), ("abc", "abcd", 0.80), ("abc", "abcdefg", 0.0), ("abcdefghij", "abcdefghix", 0.765), ("abcdefghij", "zbcdefghix", 0.0), ("", "", 0.0), ("a", None, 0.0)],
    V.match_score, "DOUBLE",
)

_MAP = [("agency", 0, "Agency_A", 1, "top", 0.9, 2), ("agency", 1, "Agency_B", 2, "top", 0.9, 2), ("agency", 2, "Agency_C", 2, "bottom", 0.9, 2), ("code", 0, "Code_A", 0, None, 0.7, 1), ("naic code", 0, "Code_A", 1, None, 0.8, 1), ("a", 0, "A", 1, None, 1.0, 9)]
_LOOKUPS = [
    [(1, "Agency:", "x", 0, 0), (2, "AGENCY", "y", 2, 0), (3, "agency", "z", 2, 1900)],
    [(1, "Agency", "x", 2, 1800), (2, "Code", " 1 ", 1, 5), (3, "NAIC#Code", "2", 1, 5), (4, "A", "v", 1, 1)],
    [(1, "Agency", " ", 1, 1), (2, None, "x", 1, 1), (3, "agency", "first", 1, 0), (4, "agency", "late", 1, 0)],
    [(1, "nothing", "x", 1, 1)],
]


def _lookup(spark, sf_dir):
    maps = spark.createDataFrame(_MAP, "label string, ord int, field string, page int, y_region string, confidence double, seen int")
    return M.ranked_lookup(cases(spark, sf_dir, "ord int, label string, value string, page int, y double", _LOOKUPS), maps)


known_rows(
    "label_map_ranked", "J11.", ["field", "value", "confidence"],
    [[("Agency_A", "x", 0.9), ("Agency_B", "y", 0.9), ("Agency_C", "z", 0.9)], [("Agency_C", "x", 0.9), ("Code_A", "1", 0.7)], [("Agency_A", "first", 0.9)], []],
    _lookup, {"confidence": "DOUBLE"},
)

_DRIVERS = [[(2, "Bo", " ", "M"), (1, "Al", "Ray", "S")], [(i, f"D{i:02d}", None, "M" if i == 1 else None) for i in range(30)], [(1, None, None, None)]]


def _numbered(spark, sf_dir):
    known = spark.createDataFrame([(f"Text{n}[0]",) for n in (15, 16, 18, 35, 36, 38, 475, 476, 495, 496)] + [("marital[0]",), ("maritalstatus1[0]",)], "field string")
    return M.numbered_fields(cases(spark, sf_dir, "ord int, first string, last string, m string", _DRIVERS), known, {1: "first", 3: "last"}, "m")


known_rows(
    "numbered_fields", "J25: at most 24 rows; numbers of one case end at 475.", ["field", "value"],
    [
        [("Text15[0]", "1"), ("Text16[0]", "Al"), ("Text18[0]", "Ray"), ("marital[0]", "S"), ("Text35[0]", "2"), ("Text36[0]", "Bo"), ("maritalstatus1[0]", "M")],
        [("Text15[0]", "1"), ("Text16[0]", "D00"), ("Text35[0]", "2"), ("Text36[0]", "D01"), ("maritalstatus1[0]", "M"), ("Text475[0]", "24"), ("Text476[0]", "D23")],
        [("Text15[0]", "1")],
    ],
    _numbered,
)

_ENTITIES = [[("business.name", "Acme"), ("policy.number", "")], [("business.name", "Bolt"), ("policy.number", "P1")], [("other", "x")]]


def _static(spark, sf_dir):
    said = cases(spark, sf_dir, "path string, value string", _ENTITIES)
    forms = said.select("doc", F.explode(F.array(F.lit("125"), F.lit("127"))).alias("form")).filter("doc % 3 <> 1 OR form = '125'")
    mapping = spark.createDataFrame([("125", "business.name", "Insured_A"), ("125", "policy.number", "Policy_A"), ("127", "business.name", "Name"), ("137", "business.name", "N")], "form string, path string, field string")
    return M.static_fields(said, forms, mapping, F.lit("01/02/2024"), ["125", "137"])


_DAY = ("125", "Form_CompletionDate_A", "01/02/2024")
known_rows("static_fields", "J26: the mapping is the caller's.", ["form", "field", "value"], [[("125", "Insured_A", "Acme"), ("127", "Name", "Acme"), _DAY], [("125", "Insured_A", "Bolt"), ("125", "Policy_A", "P1"), _DAY], [_DAY]], _static)

_PAIRS = [[(" Name: ", "Bob", 1, 0.9)], [("A", " ", 2, None), (None, "x", 1, 0.5)]]


def _pair_rows(spark, sf_dir):
    rows = cases(spark, sf_dir, "l string, v string, page int, confidence double", _PAIRS)
    return M.pair_rows(rows.select("doc", F.struct(F.col("l").alias("text"), F.lit(5).alias("x"), F.lit(7).alias("y")).alias("label"), F.struct(F.col("v").alias("text"), F.lit(9).alias("y")).alias("value"), "page", "confidence"))


known_rows("pair_rows", "M09.", ["label", "value", "page", "confidence", "label_y", "value_y", "label_x"], [[("Name:", "Bob", 1, 0.9, 7, 9, 5)], [("A", "", 2, None, 7, 9, 5), (None, "x", 1, 0.5, 7, 9, 5)]], _pair_rows, {"confidence": "DOUBLE"})


@query(
    "order_list_fields",
    """WITH r AS (SELECT o_custkey AS doc, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i, * FROM orders)
SELECT doc, 'loss_' || i || '_' || unnest(['date', 'amount']) AS field, unnest([strftime(o_orderdate, '%Y-%m-%d'), o_orderpriority]) AS value FROM r
UNION ALL SELECT doc, 'loss_' || i || '_status', o_orderstatus FROM r WHERE o_orderstatus <> 'O'""",
)
def order_list_fields(spark, sf_dir):
    """A customer's orders as an indexed list; one field is optional."""
    entry = F.struct("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), "o_orderpriority", F.nullif("o_orderstatus", F.lit("O")).alias("status"))
    lists = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("doc")).agg(F.array_sort(F.collect_list(entry)).alias("items"))
    return M.flat_list(lists, "items", "loss", {"date": "day", "amount": "o_orderpriority"}, {"status": "status"})


@query(
    "search_all",
    """WITH q AS (SELECT vec_id AS query_id, embedding AS v FROM embeddings WHERE vec_id % 50 = 0), s AS (
 SELECT query_id, vec_id AS item_id, CASE WHEN vec_id % 2 = 0 THEN 'even' ELSE 'odd' END AS collection, round(list_cosine_similarity(embedding::DOUBLE[], v::DOUBLE[]), 6) AS score FROM embeddings CROSS JOIN q),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, collection ORDER BY score DESC, item_id) AS rank FROM s) SELECT * FROM r WHERE rank <= 3""",
)
def search_all(spark, sf_dir):
    """Every vec_id divisible by 50 is asked, against all rows of two collections."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    items = rows.withColumnRenamed("vec_id", "item_id")
    return M.search_all(rows.filter("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id"), {"even": items.filter("item_id % 2 = 0"), "odd": items.filter("item_id % 2 <> 0")}, 3)


@query("collection_stats", "SELECT source, lang, count(*) AS documents, count(text) AS with_text, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY 1, 2")
def collection_stats(spark, sf_dir):
    """What each collection holds."""
    return table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count("*").alias("documents"), F.count("text").alias("with_text"), F.sum("n_chars").alias("chars"))


_PAGES = [
    ["Name: Bob\nCity:\nBonn\n# Head:\n# no"],
    ["| Make | x | Year | y | Vin |\n| VW | x | 2020 | y | V1 |\n| Make | x | 2021 | y |\n|:--|a|--|\nEnd: 1"],
    ["| A | x | B |\n|---|x|---|\n| 1 | x | 2 |\n| 3 | x | 4 |\nno colon"],
    [""],
]
known_rows(
    "markdown_pairs", "W08.", ["part", "line", "cell", "label", "value"],
    [
        [(0, 0, 0, "Name", "Bob"), (1, 1, 0, "City", "Bonn")],
        [(0, 1, 0, "Make", "VW"), (0, 1, 1, "Year", "2020"), (0, 1, 2, "Vin", "V1"), (0, 2, 0, "Year", "2021"), (0, 4, 0, "End", "1")],
        [(0, 3, 0, "1", "3"), (0, 3, 1, "2", "4")],
        [],
    ],
    lambda spark, sf_dir: M.markdown_pairs(cases(spark, sf_dir, "text string", [[(t,) for t in case] for case in _PAGES])),
)

_FIELDS = [
    [(0, "named_insured", "text", "Name", 'Bo "B"'), (0, "named_insured", "checkbox", "Ind", "Off"), (0, None, "text", "Other", None), (1, "x", "checkbox", "Tick", "Yes")],
    [(0, "x", "text", "Empty", "Off"), (0, "x", "checkbox", "Box", None)],
    [(0, "x", "text", "Empty", "")],
]
known_rows(
    "page_examples", "X08.", ["page", "type", "answer"],
    [
        [(0, "full_page", '{"Ind": false, "Name": "Bo \\"B\\""}'), (0, "category_named_insured", '{"Ind": false, "Name": "Bo \\"B\\""}'), (0, "checkbox", '{"Ind": false}'), (1, "full_page", '{"Tick": true}'), (1, "category_x", '{"Tick": true}'), (1, "checkbox", '{"Tick": true}')],
        [(0, "checkbox", '{"Box": false}')],
        [],
    ],
    lambda spark, sf_dir: M.page_examples(cases(spark, sf_dir, "page int, category string, kind string, field string, value string", _FIELDS)),
)

_ROWS = [
    [(1, 20, 10, 10, 90, 30), (1, 60, 20, 50, 80, 75), (1, 130, 10, 121, 95, 140)],
    [(1, 20, 0, 10, 190, 30), (2, 20, 10, 10, 90, 80), (2, 300, 10, 290, 90, 310)],
]
known_rows(
    "gap_regions", "W05: a gap of 46 parts, one of 45 does not; the last region of a page is under 60 high or cut at the page.", ["page", "region", "x_min", "y_min", "x_max", "y_max"],
    [[(1, 0, 0, 0, 100, 90)], [(2, 0, 0, 0, 100, 95)]],
    lambda spark, sf_dir: L.gap_regions(cases(spark, sf_dir, "page int, y int, x_min int, y_min int, x_max int, y_max int", _ROWS).withColumns({"width": F.lit(100), "height": F.lit(305)})),
)
known_rows(
    "page_tiles", "S22.", ["row", "col", "x_min", "y_min", "x_max", "y_max"],
    [[(0, 0, 0, 0, 50, 33), (0, 1, 50, 0, 101, 33), (1, 0, 0, 33, 50, 67), (1, 1, 50, 33, 101, 67)]],
    lambda spark, sf_dir: L.tiles(cases(spark, sf_dir, "page int, width int, height int", [[(1, 101, 67)]])),
)

_TABLES = [
    [(1, r, t) for r, t in [(0, "Title:"), (1, "Make:"), (1, "Year:"), (2, "VW"), (2, "2020"), (3, "Opel"), (3, "2021")]],
    [(1, r, t) for r, t in [(0, "Make:"), (0, "2019"), (1, "VW"), (1, "2020")]],
]
known_rows("table_headers", "W07, with smaller bounds.", ["page", "row"], [[(1, 1)], []], lambda spark, sf_dir: L.table_headers(cases(spark, sf_dir, "page int, row int, text string", _TABLES), 2, 2))

_CACHED = [[("image", 1), ("image", 2), ("text", 1), ("text", 2), ("blocks", 1), ("blocks", 2), ("blocks", 2)], [("image", 1), ("image", 2), ("text", 1), ("blocks", 1), ("blocks", 2)], [("image", 1)], [("text", 1), ("blocks", 1)]]
known_rows("usable_cache", "S10.", ["usable"], [[(True,)], [(False,)], [(False,)], [(False,)]], lambda spark, sf_dir: usable_cache(cases(spark, sf_dir, "kind string, page int", _CACHED)))

_IMAGES = [["a/s_page_1.png", "a/s_page_10.png", "a/s_page_2_clean.png", "a/t_page_1.png"], ["b/u_page_3.png", "b/readme.png"], ["c/s_page_1_clean.png"]]


def _images(spark, sf_dir):
    files = cases(spark, sf_dir, "path string", [[(p,) for p in case] for case in _IMAGES]).withColumn("folder", F.col("doc"))
    return page_images(files, files.select("folder", F.lit("s").alias("stem")).distinct()).withColumnRenamed("folder", "doc")


known_rows("page_images", "S24: a folder a customer.", ["stem", "page", "path"], [[("s", 1, "a/s_page_1.png"), ("s", 10, "a/s_page_10.png")], [("s", 3, "b/u_page_3.png")], []], _images)

"""Text, catalog and nested-record functions over the driver tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators.labels import label_form
from tessera.plans.registry import query
from tessera.plans.session import table


@query("html_compact", r"""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<(script|style)[^>]*>.*?</(script|style)>', ' ', 'gis'), '<!--.*?-->', ' ', 'gs'), '<h[1-6][^>]*>', ' ## ', 'gi'), '<[^>]*>', ' ', 'g'), '[ \t\n\r\f\v]+', ' ', 'g')) AS content FROM pages""")
def html_compact(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.compact_html(F.col("html")).alias("content"))


@query("html_table_pairs", r"""SELECT page_id, unnest(['Site','Path']) AS label, unnest([regexp_extract(url, '^https?://([^/]+)', 1), regexp_extract(url, '^https?://[^/]+(/[^?#]*)', 1)]) AS value FROM pages""")
def html_table_pairs(spark, sf_dir):
    """A table of header and cells built from each url, read back as header and value pairs."""
    site, path = F.regexp_extract("url", r"^https?://([^/]+)", 1), F.regexp_extract("url", r"^https?://[^/]+(/[^?#]*)", 1)
    built = F.concat(F.lit("<table><tr><th>Site</th><th>Path</th></tr><tr><td>"), site, F.lit("</td><td>"), path, F.lit("</td></tr></table>"))
    found = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract_all(built, F.lit("<th>(.*?)</th>"), F.lit(1)).alias("label"), F.regexp_extract_all(built, F.lit("<td>(.*?)</td>"), F.lit(1)).alias("value"))
    return found.select("page_id", F.inline(F.arrays_zip("label", "value")))


@query("label_colon_pairs", "SELECT doc_id, 'LANG' AS label, lang AS value FROM documents UNION ALL SELECT doc_id, 'SOURCE', source FROM documents")
def label_colon_pairs(spark, sf_dir):
    """W08: "label: value" on a line, and "label:" with the value on the next line, put before each text."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.split(F.concat(F.lit("LANG: "), "lang", F.lit("\nSOURCE:\n"), "source", F.lit("\n"), "text"), "\n").alias("l"))
    after = F.transform("l", lambda x, i: F.struct(x.alias("line"), F.coalesce(F.get("l", i + 1), F.lit("")).alias("next")))
    near = lines.select("doc_id", F.inline(F.filter(after, lambda s: s["line"].rlike(r"^[A-Za-z ]{1,40}:"))))
    label = F.regexp_extract("line", r"^([A-Za-z ]{1,40}):", 1)
    same = F.trim(F.regexp_extract("line", r"^[A-Za-z ]{1,40}:(.*)$", 1))
    return near.select("doc_id", label.alias("label"), F.when(same != "", same).otherwise(F.trim("next")).alias("value")).filter(T.acceptable_pair(F.col("label"), F.col("value")))


@query("checkbox_canonical", "SELECT n_nationkey, CASE WHEN n_nationkey % 6 IN (0, 1, 2) THEN '1' ELSE 'Off' END AS box FROM nation")
def checkbox_canonical(spark, sf_dir):
    words = F.array(*[F.lit(x) for x in (" Yes", "☑", "X", "no", "unchecked", None)])
    return table(spark, sf_dir, "nation").select("n_nationkey", T.tick(F.get(words, F.col("n_nationkey") % 6)).alias("box"))


@query("label_prefix_strip", "SELECT c_custkey, c_name AS value FROM customer")
def label_prefix_strip(spark, sf_dir):
    text = F.concat(F.get(F.array(*map(F.lit, ["NAME: ", "<b>Policy Number</b> : ", "phone:", ""])), (F.col("c_custkey") % 4).cast("int")), "c_name", F.lit("__"))
    return table(spark, sf_dir, "customer").select("c_custkey", T.strip_label(text, ["name", "policy number", "phone"]).alias("value"))


@query("informal_numbers", "SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN s_suppkey * 1000 WHEN 1 THEN s_suppkey * 1000000 WHEN 2 THEN s_suppkey * 1000000 + 500000 ELSE s_suppkey END AS amount FROM supplier")
def informal_numbers(spark, sf_dir):
    k = F.col("s_suppkey").cast("string")
    forms = F.array(F.concat(k, F.lit("k")), F.concat(k, F.lit(" mil")), F.concat(F.lit("$"), k, F.lit(".5M")), k)
    return table(spark, sf_dir, "supplier").select("s_suppkey", T.plain_number(F.get(forms, (F.col("s_suppkey") % 4).cast("int"))).alias("amount"))


@query("label_normalise", "SELECT DISTINCT p_brand, trim(regexp_replace(regexp_replace(lower(p_brand), '[:#-]', ' ', 'g'), '\\s+', ' ', 'g')) AS label FROM part")
def label_normalise(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_brand", label_form(F.col("p_brand")).alias("label")).distinct()


@query("key_normalise", "SELECT p_partkey, replace(p_name, ' ', '_') || '_' || 'Number' AS key FROM part")
def key_normalise(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.key_form(F.concat(F.lit(" "), "p_name", F.lit(" / ##"))).alias("key"))


@query("content_ids", "SELECT doc_id, substr(sha256(text), 1, 8) AS id FROM documents")
def content_ids(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.short_id(F.col("text")).alias("id"))


@query("value_snippet", "SELECT b.item_id, d.doc_id, substr(d.text, greatest(1, instr(d.text, b.text) - 40), length(b.text) + instr(d.text, b.text) - greatest(1, instr(d.text, b.text) - 40) + 40) AS snippet FROM documents d JOIN benchmark b ON instr(d.text, b.text) > 0")
def value_snippet(spark, sf_dir):
    """the place of a value in the text that holds it; the holders come from the blocked containment join."""
    from tessera.plans.matching import near_duplicate_contamination

    d = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("d"))
    b = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("b"))
    held = near_duplicate_contamination(spark, sf_dir).join(b, "item_id").join(d, "doc_id")
    return held.select("item_id", "doc_id", T.snippet(F.col("d"), F.col("b")).alias("snippet")).filter("snippet IS NOT NULL")


@query("catalog_summary", "SELECT p_brand AS category, count(*) AS fields, count(DISTINCT p_type) AS types FROM part GROUP BY 1 ORDER BY 1")
def catalog_summary(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("category")).agg(F.count("*").alias("fields"), F.count_distinct("p_type").alias("types")).orderBy("category")


@query("suffix_groups", "SELECT coalesce(nullif(regexp_extract(p_type || '_' || (p_partkey % 20)::VARCHAR, '_([A-M]|[0-9]+)$', 1), ''), 'NONE') AS suffix, count(*) AS fields, min(p_partkey) AS first_field FROM part GROUP BY 1")
def suffix_groups(spark, sf_dir):
    """A21."""
    name = F.concat("p_type", F.lit("_"), (F.col("p_partkey") % 20).cast("string"))
    return table(spark, sf_dir, "part").groupBy(F.coalesce(T.suffix(name), F.lit("NONE")).alias("suffix")).agg(F.count("*").alias("fields"), F.min("p_partkey").alias("first_field"))


@query("field_page_default", "SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, coalesce(p.p_size, 0) AS page, p.p_brand AS category FROM lineitem l LEFT JOIN (SELECT * FROM part WHERE p_partkey % 2 = 0) p ON p_partkey = l_partkey")
def field_page_default(spark, sf_dir):
    """A catalog lookup with a default page and no category where the field is unknown."""
    known = table(spark, sf_dir, "part").filter("p_partkey % 2 = 0").select(F.col("p_partkey").alias("l_partkey"), "p_size", F.col("p_brand").alias("category"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return rows.join(known, "l_partkey", "left").select("l_orderkey", "l_linenumber", "l_partkey", F.coalesce("p_size", F.lit(0)).alias("page"), "category")


@query("cross_scenarios", "SELECT n_nationkey, r_regionkey, ['low','mid','high'][(1 + (n_nationkey * 7 + r_regionkey * 3) % 3)::INT] AS size FROM nation CROSS JOIN region")
def cross_scenarios(spark, sf_dir):
    """Every nation in every region's scenario, with a choice by remainder; the product is what is asked for."""
    size = F.get(F.array(*map(F.lit, ["low", "mid", "high"])), ((F.col("n_nationkey") * 7 + F.col("r_regionkey") * 3) % 3).cast("int"))
    each = table(spark, sf_dir, "nation").select("n_nationkey").crossJoin(table(spark, sf_dir, "region").select("r_regionkey"))
    return each.select("n_nationkey", "r_regionkey", size.alias("size"))


@query("anchor_discovery", "WITH w AS (SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS line FROM documents) SELECT lang, line AS label, min(doc_id) AS first_doc, count(DISTINCT doc_id) AS docs FROM w WHERE starts_with(line, 'This work') OR starts_with(line, 'Licensed') GROUP BY 1, 2")
def anchor_discovery(spark, sf_dir):
    """Lines that start with a known label; of each its first page."""
    lines = table(spark, sf_dir, "documents").select("doc_id", "lang", F.explode(F.split("text", "\n")).alias("label"))
    known = F.col("label").startswith("This work") | F.col("label").startswith("Licensed")
    return lines.filter(known).groupBy("lang", "label").agg(F.min("doc_id").alias("first_doc"), F.count_distinct("doc_id").alias("docs"))


@query("nested_flatten", "SELECT event_id, json_extract_string(props, '$.' || k) AS value, k AS key FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events)")
def nested_flatten(spark, sf_dir):
    """A JSON text of unknown keys as one row a key."""
    props = F.from_json("props", "map<string,string>")
    return table(spark, sf_dir, "events").select("event_id", F.explode(props).alias("key", "value"))


@query("schema_expansion", "SELECT k AS key, count(*) AS seen, min(event_id) AS first_seen FROM (SELECT event_id, unnest(json_keys(props)) AS k FROM events) WHERE k NOT IN ('page') GROUP BY 1")
def schema_expansion(spark, sf_dir):
    """Keys that the data have and the schema lacks."""
    keys = table(spark, sf_dir, "events").select("event_id", F.explode(F.json_object_keys("props")).alias("key"))
    return keys.filter("key <> 'page'").groupBy("key").agg(F.count("*").alias("seen"), F.min("event_id").alias("first_seen"))


@query("label_predicates", "SELECT p_partkey, (p_partkey % 3 = 0) OR p_partkey % 3 = 1 AS is_label FROM part")
def label_predicates(spark, sf_dir):
    """P08-P10."""
    forms = F.array(F.lit("Policy no:"), F.lit("POLICY NUMBER"), F.lit("POLICY 12345"))
    return table(spark, sf_dir, "part").select("p_partkey", T.looks_like_label(F.get(forms, (F.col("p_partkey") % 3).cast("int"))).alias("is_label"))


@query("null_pruning", "SELECT o_orderkey, k AS field, v AS value FROM (SELECT o_orderkey, unnest(['status','priority','note']) AS k, unnest([o_orderstatus, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE 'N/A' END, '']) AS v FROM orders) WHERE lower(trim(v)) NOT IN ('', 'null', 'none', 'n/a')")
def null_pruning(spark, sf_dir):
    """Empty and null-like values go."""
    pairs = F.array(*[F.struct(F.lit(k).alias("field"), v.alias("value")) for k, v in (("status", F.col("o_orderstatus")), ("priority", F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")).otherwise("N/A")), ("note", F.lit("")))])
    each = table(spark, sf_dir, "orders").select("o_orderkey", F.inline(pairs))
    return each.filter(~F.lower(F.trim("value")).isin("", "null", "none", "n/a"))


@query("first_wins_dedup", "WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice) AS n FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey FROM r WHERE n = 1")
def first_wins_dedup(spark, sf_dir):
    """W09."""
    w = Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return table(spark, sf_dir, "lineitem").withColumn("n", F.row_number().over(w)).filter("n = 1").select("l_orderkey", "l_linenumber", "l_partkey")


@query("lob_set_operations", "WITH s AS (SELECT DISTINCT c_nationkey AS k FROM customer WHERE c_acctbal > 5000), t AS (SELECT DISTINCT s_nationkey AS k FROM supplier WHERE s_acctbal > 5000) SELECT k, 'both' AS side FROM (SELECT * FROM s INTERSECT SELECT * FROM t) UNION ALL SELECT k, 'first' FROM (SELECT * FROM s EXCEPT SELECT * FROM t)")
def lob_set_operations(spark, sf_dir):
    """U02."""
    s = table(spark, sf_dir, "customer").filter("c_acctbal > 5000").select(F.col("c_nationkey").alias("k"))
    t = table(spark, sf_dir, "supplier").filter("s_acctbal > 5000").select(F.col("s_nationkey").alias("k"))
    return s.intersect(t).withColumn("side", F.lit("both")).unionByName(s.exceptAll(s.intersectAll(t)).distinct().join(t, "k", "left_anti").withColumn("side", F.lit("first")))

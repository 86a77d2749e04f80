"""Label maps, value matching, retrieval and curation over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import labels, retrieval
from tessera.operators.ordering import numbered
from tessera.plans.registry import query
from tessera.plans.session import ship, table


@query("schema_semi_filter", "SELECT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 25)")
def schema_semi_filter(spark, sf_dir):
    """P04."""
    known = table(spark, sf_dir, "part").filter("p_size > 25").select(F.col("p_partkey").alias("l_partkey"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity").join(known, "l_partkey", "left_semi")


@query("schema_anti_unmapped", "SELECT p_partkey, p_name FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def schema_anti_unmapped(spark, sf_dir):
    """Catalog rows that nothing maps to."""
    mapped = table(spark, sf_dir, "lineitem").filter("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, sf_dir, "part").select("p_partkey", "p_name").join(mapped, "p_partkey", "left_anti")


@query("label_mode_aggregate", "WITH c AS (SELECT l_returnflag, l_linestatus, count(*) AS seen FROM lineitem GROUP BY 1, 2) SELECT l_returnflag, first(l_linestatus ORDER BY seen DESC, l_linestatus) AS l_linestatus, max(seen) AS seen FROM c GROUP BY 1")
def label_mode_aggregate(spark, sf_dir):
    return labels.label_map(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus")


@query(
    "label_map_lookup",
    """WITH c AS (SELECT p_type, p_brand, count(*) AS seen FROM part GROUP BY 1, 2), m AS (SELECT p_type, first(p_brand ORDER BY seen DESC, p_brand) AS brand FROM c GROUP BY 1)
SELECT p_partkey, brand FROM part JOIN m USING (p_type)""",
)
def label_map_lookup(spark, sf_dir):
    """Labels looked up in a map that was aggregated from the data; the map is small beside the rows."""
    part = table(spark, sf_dir, "part")
    best = labels.label_map(part, "p_type", "p_brand").select("p_type", F.col("p_brand").alias("brand"))
    return part.select("p_partkey", "p_type").join(best, "p_type").select("p_partkey", "brand")


_SCORE = """CASE WHEN x = y THEN 1.0 WHEN length(dx) >= 3 AND dx = dy THEN 0.95
 WHEN (contains(x, y) OR contains(y, x)) AND least(length(x), length(y)) / greatest(length(x), length(y)) >= 0.5 THEN 0.80
 WHEN abs(length(x) - length(y)) <= greatest(length(x), length(y)) * 0.15 AND 1 - levenshtein(x, y) / greatest(length(x), length(y)) >= 0.85 THEN round((1 - levenshtein(x, y) / greatest(length(x), length(y))) * 0.85, 6) ELSE 0.0 END"""
_PAIRS = f"""p AS (SELECT s_suppkey, c_custkey, s_nationkey AS nation, lower(trim(s_name)) AS x, lower(trim(c_name)) AS y, regexp_replace(s_name, '[^0-9]', '', 'g') AS dx, regexp_replace(c_name, '[^0-9]', '', 'g') AS dy
 FROM supplier JOIN customer ON s_nationkey = c_nationkey), v AS (SELECT s_suppkey, c_custkey, nation, ({_SCORE})::DOUBLE AS score FROM p)"""


def _pairs(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("text"))
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_custkey").alias("id"), F.col("c_name").alias("text"))
    met = labels.match_candidates(s, c, "nation")
    scored = met.select(F.col("left_id").alias("s_suppkey"), F.col("right_id").alias("c_custkey"), "nation", labels.value_score(F.col("left_text"), F.col("right_text")).alias("score"))
    return scored.filter("score > 0")


@query("value_match_candidates", f"WITH {_PAIRS} SELECT * FROM v WHERE score > 0")
def value_match_candidates(spark, sf_dir):
    """Names compared within a nation, the blocking key."""
    return _pairs(spark, sf_dir)


@query("greedy_assignment")
def greedy_assignment(spark, sf_dir):
    ship(spark)
    return labels.assign_one_to_one(_pairs(spark, sf_dir), "nation", "s_suppkey", "c_custkey", "score")


@query("near_duplicate_contamination", "SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains(lower(d.text), lower(b.text))")
def near_duplicate_contamination(spark, sf_dir):
    """J14, containment: documents that hold a benchmark text as it stands.

    Blocked by the text's first characters: what stands at each position of a document is looked up, so the join is an
    equi-join and not a product. A text of fewer characters than the key is looked up by all of them.
    """
    return holders(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def holders(documents, benchmark, key: int = 12):
    """doc_id, item_id: documents (doc_id, text) that hold a text of benchmark (item_id, text), in any case.

    A text that has a word start inside is looked up by the key's characters from there on: wherever the text stands, that
    is a word start of the document too, so only word starts are looked at. The others, short ones, are looked up by
    their first characters at every place, where there are any.
    """
    b = benchmark.select("item_id", F.lower("text").alias("b")).filter("b IS NOT NULL")
    inner = F.nullif(F.regexp_extract("b", rf"(?s)^.+?[^\p{{L}}\p{{N}}]([\p{{L}}\p{{N}}].{{{key - 1}}})", 1), F.lit(""))
    b = b.withColumn("inner", inner)
    long, short = b.filter("inner IS NOT NULL").select("item_id", "b", F.col("inner").alias("head")), b.filter("inner IS NULL").select("item_id", "b", F.substring("b", 1, key).alias("head"))
    d = documents.select("doc_id", F.lower("text").alias("d"))
    starts = F.regexp_extract_all("d", F.lit(rf"(?s)(?<![\p{{L}}\p{{N}}])(?=([\p{{L}}\p{{N}}].{{{key - 1}}}))"), F.lit(1))

    def met(items, places):
        heads = items.select("head").distinct()
        heads = F.broadcast(heads) if heads.count() <= 100_000 else heads
        each = d.select("doc_id", F.explode(F.array_distinct(places)).alias("head"))
        return each.join(heads, "head", "left_semi").join(items, "head").join(d, "doc_id").filter(F.col("d").contains(F.col("b"))).select("doc_id", "item_id")

    found = met(long, starts)
    sizes = [r[0] for r in short.select(F.char_length("head")).distinct().collect()]  # at most key + 1 of them
    if sizes:
        places = [F.regexp_extract_all("d", F.lit(rf"(?s)(?=(.{{{n}}}))"), F.lit(1)) for n in sorted(sizes) if n]
        places += [F.when(F.col("d").isNotNull(), F.array(F.lit("")))] if 0 in sizes else []
        found = found.unionByName(met(short, F.concat(*places)))
    return found.distinct()


@query("dedup_union", "SELECT text AS content FROM documents UNION SELECT text FROM benchmark")
def dedup_union(spark, sf_dir):
    """U01."""
    return labels.distinct_union([table(spark, sf_dir, t).select(F.col("text").alias("content")) for t in ("documents", "benchmark")])


@query("dedup_against_existing", "SELECT doc_id FROM documents WHERE doc_id % 2 = 1 AND text NOT IN (SELECT text FROM documents WHERE doc_id % 2 = 0)")
def dedup_against_existing(spark, sf_dir):
    """The odd half of the documents against the even half, which stands for an existing file."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return labels.not_yet_there(docs.filter("doc_id % 2 = 1"), docs.filter("doc_id % 2 = 0"), F.sha2("text", 256)).select("doc_id")


@query(
    "stratified_holdout",
    """WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY (doc_id * 7919) % 10007, doc_id) AS n, count(*) OVER (PARTITION BY lang) AS size FROM documents)
SELECT doc_id, lang, n <= greatest(1, floor(size * 0.1)) AS held_out FROM r""",
)
def stratified_holdout(spark, sf_dir):
    return retrieval.hold_out(table(spark, sf_dir, "documents").select("doc_id", "lang", ((F.col("doc_id") * 7919) % 10007).alias("key")), "lang", "key", ["doc_id"], 0.1).drop("key")


_KNN = """WITH q AS (SELECT vec_id AS query_id, embedding AS v FROM embeddings WHERE vec_id % 50 = 0), s AS (
 SELECT query_id, vec_id AS item_id, round(list_cosine_similarity(embedding::DOUBLE[], v::DOUBLE[]), 6) AS score FROM embeddings CROSS JOIN q),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM s {where})
SELECT * FROM r WHERE rank <= {k}"""


def _vectors(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    return rows.filter("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id"), rows.withColumnRenamed("vec_id", "item_id")


@query("knn_match", _KNN.format(where="", k=5))
def knn_match(spark, sf_dir):
    """Every vec_id divisible by 50 is asked, against all rows."""
    return retrieval.nearest(*_vectors(spark, sf_dir), 5)


@query("knn_threshold", _KNN.format(where="WHERE score >= 0.30", k=1))
def knn_threshold(spark, sf_dir):
    """The best match of each field where it is good enough."""
    return retrieval.nearest(*_vectors(spark, sf_dir), 1, 0.30)


@query("fewshot_retrieve", "WITH r AS (SELECT lang, source, doc_id, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS rank FROM documents WHERE n_chars < 2000) SELECT * FROM r WHERE rank <= 2")
def fewshot_retrieve(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").filter("n_chars < 2000").select("lang", "source", "doc_id")
    return retrieval.first_per_group(docs, ["lang", "source"], ["doc_id"], 2)


@query("context_budget", "WITH r AS (SELECT lang, source, doc_id, sum(n_chars) OVER (PARTITION BY lang, source ORDER BY doc_id ROWS UNBOUNDED PRECEDING)::BIGINT AS used FROM documents) SELECT * FROM r WHERE used <= 3000")
def context_budget(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("lang", "source", "doc_id", "n_chars")
    placed = numbered(docs, ["lang", "source"], "doc_id", [], F.col("n_chars"))
    return placed.filter("used <= 3000").select("lang", "source", "doc_id", "used")


@query("fixed_batches", "SELECT source, doc_id, ((row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 30)::BIGINT AS batch FROM documents")
def fixed_batches(spark, sf_dir):
    return retrieval.batches(table(spark, sf_dir, "documents").select("source", "doc_id"), ["source"], "doc_id", 30)


@query("ordered_split", "WITH r AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS n FROM documents) SELECT lang, doc_id, CASE WHEN n <= 40 THEN 0 WHEN n <= 60 THEN 1 ELSE 2 END AS part FROM r")
def ordered_split(spark, sf_dir):
    """Given sizes in order (40, 20), the remainder to the last part."""
    ranked = numbered(table(spark, sf_dir, "documents").select("lang", "doc_id"), ["lang"], "doc_id", [])
    return ranked.select("lang", "doc_id", F.when(F.col("position") <= 40, 0).when(F.col("position") <= 60, 1).otherwise(2).alias("part"))


@query("text_chunks")
def text_chunks(spark, sf_dir):
    return retrieval.chunks(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("regex_pattern_join", "SELECT p_partkey, CASE WHEN regexp_matches(p_name, '1$') THEN 'one' WHEN regexp_matches(p_name, '[2-4]') THEN 'low' WHEN regexp_matches(p_name, '[5-9]$') THEN 'high' END AS target FROM part")
def regex_pattern_join(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return part.select("p_partkey", labels.first_pattern(part, "p_name", [("1$", "one"), ("[2-4]", "low"), ("[5-9]$", "high")]).alias("target"))


@query(
    "suffix_index_join",
    """WITH e AS (SELECT o_custkey, list(o_orderkey ORDER BY o_orderkey) AS orders FROM orders GROUP BY 1)
SELECT o_custkey, ['A','B','C','D','E'][i] AS suffix, orders[i] AS value FROM e, range(1, 6) t(i) WHERE i <= len(orders)""",
)
def suffix_index_join(spark, sf_dir):
    """A suffix letter is the index into an entity's list."""
    five = retrieval.first_per_group(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], ["o_orderkey"], 5)
    return five.select("o_custkey", F.get(F.array(*map(F.lit, "ABCDE")), F.col("rank") - 1).alias("suffix"), F.col("o_orderkey").alias("value"))


@query("position_drift", "SELECT p_partkey AS field, (CASE WHEN p_partkey % 4 = 0 THEN 9 ELSE p_partkey % 4 END)::BIGINT AS shift, p_partkey % 10 = 0 AS page_differs FROM part WHERE p_partkey % 4 = 0 OR p_partkey % 10 = 0")
def position_drift(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    a = part.select(k.alias("field"), F.lit(1).alias("page"), (k % 500).alias("x"), (k % 300).alias("y"))
    b = part.select(k.alias("field"), F.when(k % 10 == 0, 2).otherwise(1).alias("page"), (k % 500 + F.when(k % 4 == 0, 9).otherwise(k % 4)).alias("x"), (k % 300).alias("y"))
    return labels.drifted(a, b, "field", ["x", "y"], 5)


@query("fallback_key_join", "SELECT s_suppkey, coalesce(a.n_name, b.n_name) AS nation FROM supplier LEFT JOIN nation a ON a.n_nationkey = s_nationkey AND s_suppkey % 2 = 0 LEFT JOIN nation b ON b.n_nationkey = s_nationkey")
def fallback_key_join(spark, sf_dir):
    """Half of the names are written with a blank tail, which only the trimmed key finds."""
    names = table(spark, sf_dir, "nation").select("n_name")
    rows = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    rows = rows.select("s_suppkey", F.when(F.col("s_suppkey") % 2 == 0, F.col("n_name")).otherwise(F.concat("n_name", F.lit("  "))).alias("name"))
    catalog = names.select(F.col("n_name").alias("name"), F.col("n_name").alias("nation"))
    return labels.with_fallback(rows, catalog, "name", F.trim("name"), "nation").select("s_suppkey", "nation")


@query(
    "fuzzy_key_tiers",
    """WITH a AS (SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN s_name WHEN 1 THEN upper(replace(s_name, '#', ' ')) WHEN 2 THEN s_name || ' ltd' ELSE 'zzz' || s_suppkey || 'qqqqqqqqqqqqqqqqqqqq' END AS key FROM supplier),
n AS (SELECT s_suppkey, key, regexp_replace(lower(key), '[^a-z0-9]', '', 'g') AS x FROM a), b AS (SELECT DISTINCT s_name AS name, regexp_replace(lower(s_name), '[^a-z0-9]', '', 'g') AS y FROM supplier),
t AS (SELECT s_suppkey, key, name, CASE WHEN key = name THEN 1 WHEN x = y THEN 2 WHEN (contains(x, y) OR contains(y, x)) AND least(length(x), length(y)) >= 5 AND least(length(x), length(y)) / greatest(length(x), length(y)) >= 0.6 THEN 3 END AS tier, abs(length(x) - length(y)) AS gap FROM n CROSS JOIN b)
SELECT key, first(name ORDER BY tier, gap, name) AS name, min(tier) AS tier FROM t WHERE tier IS NOT NULL GROUP BY key""",
)
def fuzzy_key_tiers(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey") % 4
    key = F.when(k == 0, F.col("s_name")).when(k == 1, F.upper(F.replace("s_name", F.lit("#"), F.lit(" ")))).when(k == 2, F.concat("s_name", F.lit(" ltd"))).otherwise(F.concat(F.lit("zzz"), F.col("s_suppkey").cast("string"), F.lit("qqqqqqqqqqqqqqqqqqqq")))
    return labels.reconcile_keys(s.select(key.alias("key")), s.select(F.col("s_name").alias("name")), "key", "name")


@query(
    "form_by_signature",
    """WITH f AS (SELECT DISTINCT l_suppkey AS doc, l_partkey AS field FROM lineitem), c AS (SELECT 'form' || (p_partkey % 3) AS form, p_partkey AS field FROM part),
s AS (SELECT doc, form, count(*) AS shared FROM f JOIN c USING (field) GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY shared DESC, form) AS n FROM s)
SELECT doc, form, shared FROM r WHERE n = 1 AND shared > 10""",
)
def form_by_signature(spark, sf_dir):
    fields = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("doc"), F.col("l_partkey").alias("field"))
    catalog = table(spark, sf_dir, "part").select(F.concat(F.lit("form"), (F.col("p_partkey") % 3).cast("string")).alias("form"), F.col("p_partkey").alias("field"))
    return labels.form_by_overlap(fields, catalog, "doc")


QUESTIONS = {"contact": ["view", "click"], "money": ["purchase", "signup", "view"], "faults": ["error", "click"]}


@query(
    "grouped_questions",
    """WITH m AS (SELECT user_id, list_filter(['view','click','purchase','signup','error'], lambda t: NOT list_contains(list(DISTINCT event_type) FILTER (WHERE value > 90), t)) AS fields FROM events GROUP BY 1),
q(rank, grp, f) AS (VALUES (0, 'contact', ['view','click']), (1, 'money', ['purchase','signup','view']), (2, 'faults', ['error','click']))
SELECT user_id, grp AS "group", len(list_intersect(fields, f)) AS missing FROM m CROSS JOIN q WHERE len(list_intersect(fields, f)) >= 2""",
)
def grouped_questions(spark, sf_dir):
    have = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set(F.when(F.col("value") > 90, F.col("event_type"))).alias("have"))
    every = F.array(*map(F.lit, ["view", "click", "purchase", "signup", "error"]))
    return labels.grouped_questions(have.select("user_id", F.array_except(every, "have").alias("fields")), QUESTIONS, "user_id")


@query(
    "context_retrieval",
    """WITH q AS (SELECT vec_id AS query_id, embedding AS v FROM embeddings WHERE vec_id % 50 = 0), s AS (
 SELECT query_id, vec_id AS item_id, label % 3 AS part, round(list_cosine_similarity(embedding::DOUBLE[], v::DOUBLE[]), 6) AS score FROM embeddings CROSS JOIN q),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, part ORDER BY score DESC, item_id) AS n FROM s),
u AS (SELECT query_id, item_id, score, (100 + item_id % 300)::BIGINT AS size FROM r WHERE n <= CASE part WHEN 0 THEN 5 ELSE 2 END),
b AS (SELECT *, sum(size) OVER (PARTITION BY query_id ORDER BY score DESC, item_id ROWS UNBOUNDED PRECEDING)::BIGINT AS used FROM u) SELECT query_id, item_id, score, used FROM b WHERE used <= 1500""",
)
def context_retrieval(spark, sf_dir):
    """The nearest of three collections (5, 2, 2), merged by distance, within 1500 characters."""
    queries, items = _vectors(spark, sf_dir)
    kinds = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), (F.col("label") % 3).alias("part"))
    parts = [retrieval.nearest(queries, items.join(kinds.filter(F.col("part") == p), "item_id", "left_semi"), k) for p, k in ((0, 5), (1, 2), (2, 2))]
    union = parts[0].unionByName(parts[1]).unionByName(parts[2]).withColumn("size", 100 + F.col("item_id") % 300)
    return retrieval.within_budget(union, ["query_id"], [F.desc("score"), "item_id"], F.col("size"), 1500).select("query_id", "item_id", "score", "used")

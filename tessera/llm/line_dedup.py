"""Line dedup by a log-template tree of fixed depth.

Every line is parsed down the tree: its token count, then its leading tokens, tokens with a digit being variable from the
start (<*>). A leaf whose lines agree well enough is a template. Whether a position is constant is decided within the
node, at every corpus size alike: one token holds at least CONSTANT of the documents there; every other position is a
variable field, and so is <*>. A node is a template where constants fill at least SIMILARITY of its positions; lines that
agree with it in so many positions belong to it, the others of the node go on by themselves. A node that is no template
is divided at the position with the fewest different tokens, up to DEPTH times. A line of fewer than five tokens has no
room for a variable word, so it forms a template with lines equal to it after masking alone.

Lines whose template occurs in MIN_DOCS documents or more are dropped, wherever they stand; the rest of a document is
joined again in order.

The texts are parsed once, into a written table; from then on hashes of lines move, and token hashes of the lines that
share a leaf, one row for equal lines however many documents hold them. Only documents with a line to drop are put
together again. Recurring line hashes are broadcast up to BROADCAST rows, else joined.

Defined results: null text is one empty line; lines of white space alone are kept and never counted; a document all of
whose lines are dropped has an empty text; null doc_ids count as one document; repeated rows come back once each and
count as one document; an empty table gives an empty result; extra columns are carried by drop_recurring(), whose
internal names start with an underscore.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialize, salts, table

MIN_DOCS = 3
LEADING = 3
SIMILARITY = 0.8
CONSTANT = 0.9
#: Levels below the leading tokens.
DEPTH = 5
#: Line hashes that are broadcast at most (about 40 MB).
BROADCAST = 1_000_000
FIELD = "<*>"


def _masked(text: Column) -> Column:
    """The text with blanks for all white space within lines and tokens with a digit as a variable field."""
    blank = F.when(text.rlike("[\t\r\x0b\x0c]"), F.regexp_replace(text, "[\t\r\x0b\x0c]", " ")).otherwise(text)
    return F.when(text.rlike("[0-9]"), F.regexp_replace(blank, "[^ \n0-9]*+[0-9][^ \n]*", FIELD)).otherwise(blank)


def _count(text: Column, character: str) -> Column:
    """How often the one-byte character stands in the text."""
    return F.octet_length(F.replace(text, F.lit(character), F.lit(character * 2))) - F.octet_length(text)


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with _hash: rows of one doc_id, null too, are told apart by their text."""
    return docs.withColumn("_hash", F.xxhash64(F.coalesce("text", F.lit(""))))


def _parsed(docs: DataFrame) -> DataFrame:
    """doc_id, _hash, spot, masked (the trimmed masked line, tokens being what stands between single blanks), line (its
    hash), n (tokens), leaf (token count and leading tokens)."""
    texts = _keyed(docs).select("doc_id", "_hash", _masked(F.coalesce("text", F.lit(""))).alias("masked"))
    lines = texts.select("doc_id", "_hash", F.posexplode(F.split("masked", "\n")).alias("spot", "masked"))
    lines = lines.withColumn("masked", F.trim("masked")).filter("masked <> ''")
    lines = lines.withColumn("n", _count(F.col("masked"), " ") + 1)
    return lines.withColumn("line", F.xxhash64("masked")).withColumn("leaf", F.xxhash64("n", F.substring_index("masked", " ", LEADING)))


def _sized(df: DataFrame) -> DataFrame:
    """The frame, to be broadcast where its rows are few enough."""
    return F.broadcast(df) if df.count() <= BROADCAST else df


def _level(rest: DataFrame, similarity: float) -> DataFrame:
    """rest (line, node, n, docs, tokens) with whole (the node is a template), own (the line belongs to it) and below
    (the node that the line goes on to)."""
    fields = rest.select("node", "n", "docs", F.posexplode("tokens").alias("spot", "token"))
    seen = fields.groupBy("node", "n", "spot", "token").agg(F.sum("docs").alias("w"), F.count("*").alias("lines"))
    spots = seen.groupBy("node", "n", "spot").agg(F.count("*").alias("different"), F.max(F.struct("w", "token")).alias("top"), F.sum("w").alias("w"), F.sum("lines").alias("lines"))
    ruled = F.col("top.w") >= CONSTANT * F.col("w")
    constant = F.when(ruled & F.col("top.token").isNotNull(), F.struct("spot", F.col("top.token").alias("token")))
    nodes = spots.groupBy("node", "n").agg(F.collect_list(constant).alias("constants"), F.min(F.when(~ruled, F.struct("different", "spot"))).alias("cut"), F.max("lines").alias("lines"), F.max("w").alias("w"))
    nodes = nodes.select("node", "constants", F.col("cut.spot").alias("cut"), "lines", "w", (F.size("constants") >= similarity * F.col("n")).alias("whole"))
    met = rest.join(materialize(nodes), "node").filter("lines > 1")  # a node of one line is a template of equal lines alone
    agree = F.size(F.filter("constants", lambda c: F.get("tokens", c["spot"]) == c["token"]))
    met = met.withColumn("own", F.col("whole") & (agree >= similarity * F.col("n")))
    return met.withColumn("below", F.when(F.col("whole"), F.xxhash64("node", F.lit("others"))).otherwise(F.xxhash64("node", "cut", F.get("tokens", F.col("cut")))))


def _templates(lines: DataFrame, similarity: float) -> DataFrame | None:
    """(line, template) of the lines (line, leaf, n, docs, tokens) that belong to a template of the tree."""
    found, rest = [], lines.withColumnRenamed("leaf", "node")
    for _ in range(DEPTH + 1):
        met = materialize(_level(rest, similarity))
        found.append(met.filter("own").select("line", F.col("node").alias("template")))
        rest = met.filter("NOT own").select("line", F.col("below").alias("node"), "n", "docs", "tokens")
        if rest.isEmpty():
            break
    return reduce(DataFrame.unionByName, found)


def _recurring(parsed: DataFrame, min_docs: int, similarity: float) -> DataFrame:
    pairs = parsed.groupBy("line", "leaf", "n", "doc_id").agg(F.lit(1).alias("_one"))
    lines = materialize(pairs.groupBy("line", "leaf", "n").agg(F.count("*").alias("docs")))
    exact = lines.filter(F.col("docs") >= min_docs).select("line")
    roomy = lines.filter(F.col("n") - 1 >= similarity * F.col("n"))
    shared = roomy.groupBy("leaf").agg(F.sum("docs").alias("d"), F.count("*").alias("c")).filter((F.col("d") >= min_docs) & (F.col("c") > 1)).select("leaf")
    open_lines = materialize(roomy.join(shared, "leaf", "left_semi"))
    texts = parsed.select("line", "masked").join(_sized(open_lines.select("line")), "line", "left_semi").dropDuplicates(["line"])
    tokens = F.transform(F.split("masked", " "), lambda t: F.when(t != FIELD, F.xxhash64(t)))
    made = materialize(open_lines.join(texts, "line").select("line", "leaf", "n", "docs", tokens.alias("tokens")))
    found = materialize(_templates(made, similarity))
    held = parsed.select("doc_id", "line").join(_sized(found), "line")
    part = F.pmod(F.xxhash64("doc_id"), F.lit(salts(parsed.sparkSession)))  # a template's documents fall to many tasks
    counted = held.groupBy("template", part.alias("part"), "doc_id").agg(F.lit(1).alias("_one")).groupBy("template", "part").agg(F.count("*").alias("docs"))
    wide = counted.groupBy("template").agg(F.sum("docs").alias("docs")).filter(F.col("docs") >= min_docs)
    general = found.join(_sized(materialize(wide.select("template"))), "template", "left_semi").select("line")
    return materialize(exact.unionByName(general).distinct())


def recurring(docs: DataFrame, min_docs: int = MIN_DOCS, similarity: float = SIMILARITY) -> DataFrame:
    """(line): hashes of masked lines whose template recurs in at least min_docs documents."""
    return _recurring(materialize(_parsed(docs.select("doc_id", "text"))), min_docs, similarity)


def drop_recurring(docs: DataFrame, min_docs: int = MIN_DOCS, similarity: float = SIMILARITY) -> DataFrame:
    """docs with their text less the recurring lines, and n_lines and n_dropped."""
    parsed = materialize(_parsed(docs.select("doc_id", "text")))
    found = _recurring(parsed, min_docs, similarity)
    hits = parsed.select("doc_id", "_hash", "spot", "line").join(_sized(found), "line", "left_semi")
    hits = hits.groupBy(F.col("doc_id").alias("_doc_id"), F.col("_hash").alias("_key")).agg(F.collect_set("spot").alias("_spots"))
    hits = materialize(hits)
    keyed = _keyed(docs)
    met = keyed.join(hits, keyed["doc_id"].eqNullSafe(hits["_doc_id"]) & (keyed["_hash"] == hits["_key"]), "left")
    lines = F.split("text", "\n")
    left = F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_spots")), lambda i: F.get(lines, i))
    text = F.when(F.col("_spots").isNotNull(), F.array_join(left, "\n")).otherwise(F.coalesce("text", F.lit("")))
    n_lines = (_count(F.coalesce("text", F.lit("")), "\n") + 1).cast("long")
    rest = [text.alias("text") if c == "text" else keyed[c] for c in docs.columns]
    return met.select(*rest, n_lines.alias("n_lines"), F.coalesce(F.size("_spots"), F.lit(0)).cast("long").alias("n_dropped"))


def op2_line_dedup(spark, sf_dir: str) -> DataFrame:
    return drop_recurring(table(spark, sf_dir, "documents").select("doc_id", "text"))

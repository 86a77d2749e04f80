"""Benchmark decontamination by spaced-seed hashing.

Texts become lower-case words. Fixed masks read five words of a short span and ignore the others, so a substituted
word hides a hit only where a mask reads it; the two masks also miss no passage in which every fifth word is replaced.
Hashes of all masks at all positions of a document meet those of the benchmark by an equality join; a hit names an
item and a diagonal (the shift between document and item). Each diagonal is then verified on the words themselves: a
document is contaminated where the aligned item agrees in at least 0.8 of its words, or where a run of at least
RUN words agrees in at least 0.8. The longest such run of a diagonal is found exactly; words at its ends may differ.

Seeds, items and keys of hit documents are broadcast only up to BROADCAST rows, else both sides shuffle. Only distinct
(document, item, diagonal) rows shuffle, combined map-side, and each is verified on its own; a document without a hit is
never verified. Items of fewer than eight words, which the masks do not fit in every place, have masks of their own.

Defined results: null or wordless texts never match; items of fewer than five words are matched whole; rows of one
doc_id, null too, are verified and kept each by its own text and share the doc_id's rows in contaminated(); items with a
null item_id are matched like any other and share the null item_id in contaminated(); repeated rows come back once each
from clean(); empty tables give no match; extra columns are carried by clean(), whose internal names start with an
underscore.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialize, table

#: Word positions that each mask reads.
MASKS = ((0, 1, 3, 5, 6), (0, 2, 3, 5, 7))
SIMILARITY = 0.8
#: Words that a segment needs for each word that differs: 1 / (1 - SIMILARITY).
PER_MISS = 5
#: Words of a partial run that count as an overlap, and the share of an item below which only such runs count.
RUN = 13
#: Items of this many words or more are found by MASKS, shorter ones by masks of their own length.
LONG = max(m[-1] for m in MASKS) + 1
#: Rows of seeds, items or document keys that are broadcast at most (about 40 MB).
BROADCAST = 1_000_000


def words(c: Column) -> Column:
    """Lower-case words: runs of letters and digits of any script."""
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _seeds(tokens: str, masks: dict[int, tuple[int, ...]]) -> Column:
    """For each mask an array of (mask, position, hash), one after the other."""

    def one(number: int, mask: tuple[int, ...]) -> Column:
        last = F.size(tokens) - 1 - mask[-1]
        spots = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
        return F.transform(spots, lambda i: F.struct(i.alias("spot"), F.xxhash64(F.lit(number), *[F.get(tokens, i + k) for k in mask]).alias("seed")))

    return F.concat(*[one(n, m) for n, m in masks.items()])


def _item_masks(n: int) -> tuple[tuple[int, ...], ...]:
    """Masks that miss no item of n words whose agreement is SIMILARITY: fewer than PER_MISS words are read whole, and up
    to the span of a fixed mask every way to leave out one word is a mask."""
    if n < PER_MISS:
        return (tuple(range(n)),)
    if n < LONG:
        return (tuple(range(n - 1)), *[tuple(k for k in range(n) if k != out) for out in range(1, n - 1)])
    return MASKS


def _items(benchmark: DataFrame) -> DataFrame:
    """item_id, item (its words), _item (a hash of both); one row each."""
    named = benchmark.select("item_id", words(F.col("text")).alias("item")).filter(F.size("item") > 0).distinct()
    return named.withColumn("_item", F.xxhash64("item_id", "item"))


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with _hash: rows of one doc_id, null too, are told apart by their text."""
    return docs.withColumn("_hash", F.xxhash64(F.coalesce("text", F.lit(""))))


def _sized(df: DataFrame, limit: int) -> DataFrame:
    """A written frame, to be broadcast where it has few enough rows."""
    return F.broadcast(df) if df.count() <= limit else df


def candidates(docs: DataFrame, items: DataFrame, broadcast: int = BROADCAST) -> DataFrame:
    """doc_id, _hash, _item, shift of every seed hit, distinct, as a written table."""
    length = F.least(F.size("item"), F.lit(LONG))
    lengths = sorted(r[0] for r in items.select(length.alias("n")).distinct().collect())  # LONG at most
    number = {m: i for i, m in enumerate(dict.fromkeys(m for n in lengths for m in _item_masks(n)))}
    if not number:
        number = {m: i for i, m in enumerate(MASKS)}
    seeds = [items.filter(length == n).select("_item", F.inline(_seeds("item", {number[m]: m for m in _item_masks(n)}))) for n in lengths]
    every = reduce(DataFrame.unionByName, seeds) if seeds else items.select("_item", F.lit(0).alias("spot"), F.lit(0).cast("long").alias("seed"))
    every = materialize(every.select("_item", F.col("spot").alias("at"), "seed").distinct())
    tokens = _keyed(docs).select("doc_id", "_hash", words(F.col("text")).alias("tokens")).filter(F.size("tokens") > 0)
    spots = tokens.select("doc_id", "_hash", F.inline(_seeds("tokens", {i: m for m, i in number.items()})))
    hits = spots.join(_sized(every, broadcast), "seed").select("doc_id", "_hash", "_item", (F.col("spot") - F.col("at")).alias("shift"))
    return materialize(hits.distinct())


def _let(value: Column, f) -> Column:
    """f of a value that is computed once, though f names it more often."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _longest(ends: Column) -> Column:
    """Words and equal words of the longest segment that agrees in at least SIMILARITY.

    ends: 0, the places of the words that differ, and the number of words plus 1. A longest segment fills the gap
    between two of them, number i and j: it has ends[j] - ends[i] - 1 words, of which j - i - 1 differ, so it agrees
    well enough where ends[i] - PER_MISS * i <= ends[j] - PER_MISS * j + PER_MISS - 1. Sorted by these two sides, each j
    comes after all i that it may pair with, of which the lowest is kept.
    """

    def side(stop: int) -> Column:
        return F.transform(ends, lambda z, i: F.struct((z - PER_MISS * i + stop * (PER_MISS - 1)).alias("key"), F.lit(stop).alias("stop"), z.alias("end"), i.alias("number")))

    def step(s: Column, e: Column) -> Column:
        start, stop = (e["stop"] == 0) & (e["end"] < s["end"]), e["stop"] == 1
        n = e["end"] - s["end"] - 1
        hit = n - (e["number"] - s["number"] - 1)
        longer = stop & ((n > s["best"]) | ((n == s["best"]) & (hit > s["best_hit"])))
        return F.struct(*[F.when(on, new).otherwise(s[old]).alias(old) for on, new, old in ((start, e["end"], "end"), (start, e["number"], "number"), (longer, n, "best"), (longer, hit, "best_hit"))])

    zero = F.lit(0)
    first = F.struct(F.lit(2**31 - 1).alias("end"), zero.alias("number"), zero.alias("best"), zero.alias("best_hit"))
    return F.aggregate(F.sort_array(F.concat(side(0), side(1))), first, step)


def _agreement(tokens: str, c: Column) -> Column:
    """Of one candidate: words aligned and equal, and the longest run that agrees in at least SIMILARITY."""
    first = F.greatest(-c["shift"], F.lit(0))
    item = F.slice(c["item"], first + 1, F.size(c["item"]))
    part = F.slice(F.col(tokens), F.greatest(c["shift"], F.lit(0)) + 1, F.size(item))
    same = F.zip_with(F.slice(item, F.lit(1), F.greatest(F.size(part), F.lit(0))), part, lambda a, b: a == b)

    def ends(e: Column) -> Column:
        misses = F.filter(F.transform(e, lambda x, i: F.when(~x, i + 1)), lambda i: i.isNotNull())
        return F.concat(F.array(F.lit(0)), misses, F.array(F.size(e) + 1))

    def told(z: Column) -> Column:
        equal = F.element_at(z, -1) - F.size(z) + 1
        return _let(_longest(z), lambda run: F.struct(c["item_id"].alias("item_id"), F.size(c["item"]).alias("item_words"), equal.alias("equal"), run["best"].alias("run"), run["best_hit"].alias("run_equal")))

    return _let(_let(same, ends), told)


def overlaps(docs: DataFrame, benchmark: DataFrame, broadcast: int = BROADCAST) -> DataFrame:
    """doc_id, _hash, item_id, item_words, equal, run, run_equal of every verified overlap of documents (doc_id, text).

    Candidates are verified one by one: a row holds one item, one shift and the document's words. Documents without a
    candidate are left out by their keys first.
    """
    items = materialize(_items(benchmark))
    found = candidates(docs, items, broadcast)
    same = lambda a, b: a["doc_id"].eqNullSafe(b["_doc_id"]) & (a["_hash"] == b["_key"])
    keys = materialize(found.select(F.col("doc_id").alias("_doc_id"), F.col("_hash").alias("_key")).distinct())
    keyed = _keyed(docs.select("doc_id", "text"))
    hit = keyed.join(_sized(keys, broadcast), same(keyed, keys), "left_semi").dropDuplicates(["doc_id", "_hash"])
    hit = hit.select(F.col("doc_id").alias("_doc_id"), F.col("_hash").alias("_key"), words(F.col("text")).alias("_tokens"))
    named = found.join(_sized(items, broadcast), "_item")
    met = named.join(hit, same(named, hit))
    told = met.select("doc_id", "_hash", _agreement("_tokens", F.struct("item_id", "item", "shift")).alias("_a"))
    good = (F.col("_a.equal") >= SIMILARITY * F.col("_a.item_words")) | (F.col("_a.run") >= RUN)
    return told.filter(good).select("doc_id", "_hash", "_a.*")


def clean(docs: DataFrame, benchmark: DataFrame, broadcast: int = BROADCAST) -> DataFrame:
    """The documents without an overlap, with all their columns; their texts do not shuffle while the keys of
    contaminated documents number at most broadcast."""
    bad = overlaps(docs, benchmark, broadcast)
    bad = materialize(bad.select(F.col("doc_id").alias("_doc_id"), F.col("_hash").alias("_key")).distinct())
    keyed = _keyed(docs)
    hit = keyed["doc_id"].eqNullSafe(bad["_doc_id"]) & (keyed["_hash"] == bad["_key"])
    return keyed.join(_sized(bad, broadcast), hit, "left_anti").select(*docs.columns)


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, item_words, equal_words, similarity, run_words: the best overlap of each pair."""
    best = overlaps(docs, benchmark).groupBy("doc_id", "item_id").agg(F.max(F.struct("equal", "run", "run_equal", "item_words")).alias("b"))
    return best.select("doc_id", "item_id", F.col("b.item_words").alias("item_words"), F.col("b.equal").alias("equal_words"), (F.col("b.equal") / F.col("b.item_words")).alias("similarity"), F.col("b.run").alias("run_words"))


def op4_decontaminate(spark, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))

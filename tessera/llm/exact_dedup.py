"""Exact dedup by two-pass Bloom filtering.

Pass 1 builds, per task, a saturating counting Bloom filter (0, 1, 2 or more per slot) over 64-bit text hashes and
merges the tasks' filters segment by segment. Pass 2 probes it: a row whose slots all count two or more is possibly
repeated and shuffles; every other row is certainly unique and passes straight through, without a shuffle.
False positives only shuffle in vain: groups are formed on SHA-256, so the result is exact.

The filter has 8 slots a row in each of 3 planes, up to a fixed bound (MAX_BITS), so what is broadcast is bounded;
beyond the bound it passes more rows to the shuffle (digests of about 50 bytes, not texts), never fewer.

Defined results: null text counts as empty. A null doc_id ranks below every other. Of repeated rows (same doc_id and
text) exactly one is kept. An empty table gives an empty result. Extra columns are carried by deduplicate() and
ignored by decisions(); internal names start with an underscore and do not clash with them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialize, salted_lookup, salts

PLANES = 3
#: Slots a plane as a power of two: 2**24 * 3 slots are 6 MB as bits, the most that is broadcast.
MAX_BITS = 24
SEGMENT = 1 << 16
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)


_PARTS = pa.schema([("segment", pa.int32()), ("grp", pa.int32()), ("once", pa.binary()), ("twice", pa.binary())])


def _slots(hashes: np.ndarray, bits: int) -> list[np.ndarray]:
    h = hashes.view(np.uint64)
    return [((h * m) >> np.uint64(64 - bits)).astype(np.int64) + (i << bits) for i, m in enumerate(_MULTIPLIERS)]


def _task_filters(bits: int):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        once = np.zeros(PLANES << bits, dtype=bool)
        twice = np.zeros(PLANES << bits, dtype=bool)
        for batch in batches:
            for slots in _slots(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), bits):
                found, counts = np.unique(slots, return_counts=True)
                twice[found[once[found] | (counts > 1)]] = True
                once[found] = True
        group = TaskContext.get().partitionId() // 64
        for start in range(0, len(once), SEGMENT):
            part = once[start : start + SEGMENT]
            if part.any():
                planes = [zlib.compress(np.packbits(x[start : start + SEGMENT]).tobytes(), 1) for x in (once, twice)]
                yield pa.RecordBatch.from_pydict({"segment": [start // SEGMENT], "grp": [group], "once": [planes[0]], "twice": [planes[1]]}, _PARTS)

    return build


def _merge(pdf: pd.DataFrame) -> pd.DataFrame:
    once = twice = None
    for a, b in zip(pdf["once"], pdf["twice"]):
        a, b = (np.frombuffer(zlib.decompress(x), dtype=np.uint8) for x in (a, b))
        once, twice = (a, b) if once is None else (once | a, twice | b | (once & a))
    return pd.DataFrame({"segment": [pdf["segment"].iloc[0]], "grp": [0], "once": [zlib.compress(once.tobytes(), 1)], "twice": [zlib.compress(twice.tobytes(), 1)]})


def repeat_filter(hashes: DataFrame, n: int):
    """Pass 1: the broadcast bit set of slots that two or more rows hit, as (bits, broadcast bytes).

    hashes has one long column. Task filters are merged by segment, first in groups of 64 tasks, then over the groups.
    """
    bits = int(np.clip(np.ceil(np.log2(max(n, 1) * 8)), 10, MAX_BITS))
    schema = "segment int, grp int, once binary, twice binary"
    parts = hashes.mapInArrow(_task_filters(bits), schema)
    parts = parts.groupBy("segment", "grp").applyInPandas(_merge, schema)
    parts = parts.groupBy("segment").applyInPandas(_merge, schema)
    packed = np.zeros((PLANES << bits) // 8, dtype=np.uint8)
    for row in parts.select("segment", "twice").toLocalIterator():
        block = np.frombuffer(zlib.decompress(row.twice), dtype=np.uint8)
        at = row.segment * (SEGMENT // 8)
        packed[at : at + len(block)] = block
    return bits, hashes.sparkSession.sparkContext.broadcast(packed.tobytes())


def maybe_repeated(filtered):
    """Pass 2: a vectorised predicate on the hash column."""
    bits, shared = filtered

    @F.pandas_udf("boolean")
    def probe(h: pd.Series) -> pd.Series:
        packed = np.frombuffer(shared.value, dtype=np.uint8)
        hit = np.ones(len(h), dtype=bool)
        for slots in _slots(h.to_numpy(dtype=np.int64), bits):
            hit &= (packed[slots >> 3] >> (7 - (slots & 7))) & 1 == 1
        return pd.Series(hit)

    return probe


def decisions(docs: DataFrame) -> DataFrame:
    """One row per document, dropped ones too: doc_id, keep_id, group_size, kept, text_sha256."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = materialize(docs.select("doc_id", F.xxhash64(text).alias("_h"), F.unhex(F.sha2(text, 256)).alias("_sha"), F.monotonically_increasing_id().alias("_row")))
    flagged = rows.withColumn("_maybe", maybe_repeated(repeat_filter(rows.select("_h"), rows.count()))("_h"))
    out = lambda keep, size, kept: ["doc_id", keep.alias("keep_id"), size.alias("group_size"), kept.alias("kept"), F.lower(F.hex("_sha")).alias("text_sha256")]
    solo = flagged.filter(~F.col("_maybe")).select(*out(F.col("doc_id"), F.lit(1).cast("long"), F.lit(True)))
    maybe = flagged.filter("_maybe").drop("_maybe", "_h")
    salt = F.pmod("_row", F.lit(salts(docs.sparkSession)))
    best = maybe.groupBy("_sha", salt.alias("_part")).agg(F.max(F.struct("doc_id", "_row")).alias("_best"), F.count("*").alias("_n"))
    best = best.groupBy("_sha").agg(F.max("_best").alias("_best"), F.sum("_n").alias("_n"))
    joined = salted_lookup(maybe, "_sha", best, F.col("_row"))
    return solo.unionByName(joined.select(*out(F.col("_best.doc_id"), F.col("_n"), F.col("_row") == F.col("_best._row"))))


def deduplicate(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns: of equal texts the row with the largest doc_id.

    Only possibly repeated rows shuffle; their groups collapse map-side, so a hot text sends one row per task.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    hashed = docs.withColumn("_h", F.xxhash64(text))
    filtered = repeat_filter(hashed.select("_h"), docs.count())
    flagged = hashed.withColumn("_maybe", maybe_repeated(filtered)("_h"))
    solo = flagged.filter(~F.col("_maybe")).select(*docs.columns)
    maybe = flagged.filter("_maybe").withColumn("_sha", F.unhex(F.sha2(text, 256)))
    ranked = F.struct("doc_id", *[c for c in docs.columns if c != "doc_id"])
    best = maybe.groupBy("_sha").agg(F.max_by(ranked, F.struct(F.col("doc_id").isNotNull(), "doc_id")).alias("_best"))
    return solo.unionByName(best.select("_best.*").select(*docs.columns))


def op9_exact_dedup(spark, sf_dir: str) -> DataFrame:
    from tessera.llm.common import table

    return decisions(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP9_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""

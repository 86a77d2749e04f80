"""SimHash near-dedup by deletion-variant signatures.

A 64-bit fingerprint is cut into three segments (22, 21 and 21 bits). Of two fingerprints at most 4 bits apart, at
least one segment differs by at most one bit, so both have a one-wildcard variant of it (the segment with one bit left
out) in common. Every distinct fingerprint is indexed under its 64 variants, equal variants meet by an equality
shuffle, and candidates are verified by the Hamming distance of the whole fingerprints. Links become components.

Equal fingerprints are one class before indexing, so copies never multiply candidates. A variant's bucket streams
through its task and yields spanning links only, never all pairs. A bucket above HOT members is dealt anew as pairs of
blocks of bounded size, so that no task gets it whole and no link is lost.

Defined results: null or white-space text has fingerprint zero and links like any other; texts of fewer words than
a shingle give one shingle of all words; component_id ignores null doc_ids unless a component has no other;
repeated rows come back once each; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialize, salted_lookup, salts, table, tidy
from tessera.llm.components import components

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_LOWER = bytes.maketrans(string.ascii_uppercase.encode(), string.ascii_lowercase.encode())
SHINGLE = 4
DISTANCE = 4
#: (first bit, bits) of the segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Members of a bucket that one task compares on its own; larger ones are dealt as pairs of blocks.
HOT = 32768
BLOCK = 16384


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The majority bit of the shingles' XXH64 (seed 42), unsigned; a tie is 0."""
    words = WORD.findall((text or "").encode("utf-8", "surrogatepass").translate(_LOWER))
    if not words:
        return 0
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    n = max(1, len(words) - shingle + 1)
    digest = xxhash.xxh64_intdigest
    last = ends[shingle - 1 :] if len(words) >= shingle else ends[-1:]
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 8192):
        spans = zip(starts[at : min(n, at + 8192)].tolist(), last[at : at + 8192].tolist())
        hashes = np.array([digest(joined[a:b], 42) for a, b in spans], dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n, bitorder="little").tobytes(), "little")


def _fingerprint_udf(shingle: int):
    @F.pandas_udf("long")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        try:
            for texts in batches:
                yield pd.Series(np.array([fingerprint(t, shingle) for t in texts], dtype=np.uint64).view(np.int64))
        finally:
            tidy()

    return of


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp), fp as a signed long. Documents go to Python one Arrow batch at a time."""
    return docs.select("doc_id", _fingerprint_udf(shingle)("text").alias("fp"))


def variants(classes: DataFrame) -> DataFrame:
    """(key, fp): 64 rows a fingerprint. A key holds the segment, the bit left out and the other bits."""
    keys = []
    for s, (first, bits) in enumerate(SEGMENTS):
        part = F.shiftrightunsigned("fp", first).bitwiseAND((1 << bits) - 1)
        for w in range(bits):
            keys.append(part.bitwiseAND(~(1 << w) & ((1 << bits) - 1)).bitwiseOR(F.lit((s * 32 + w) << 22)))
    return classes.select(F.explode(F.array(*keys)).alias("key"), "fp")


def _span(a: np.ndarray, b: np.ndarray, distance: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Links that span what is within the distance between a and b (the same array, or two blocks of a bucket)."""
    same = a is b
    labels = np.arange(len(a)) if same else np.arange(len(a) + len(b))
    right = labels if same else labels[len(a) :]
    us, vs = [], []
    for i in range(len(a)):
        near = np.bitwise_count(a[i] ^ b) <= distance
        near &= right != labels[i]
        hit = np.flatnonzero(near)
        if len(hit):
            found, first = np.unique(right[hit], return_index=True)
            us.append(np.full(len(first), a[i]))
            vs.append(b[hit[first]])
            labels[np.isin(labels, found)] = labels[i]
    return us, vs


def _bucket_links(distance: int, hot: int):
    """Over rows sorted by key: verified links (kind 0), or members of hot buckets (kind 1: key, number, fp)."""
    schema = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("c", pa.int64())])

    def rows(kind, a, b, c):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, dtype=np.int32)), pa.array(a), pa.array(b), pa.array(c)], schema=schema)

    def solve(keys: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Whole buckets. Small ones are compared at once by offset, the rest one by one."""
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        sizes = np.diff(np.r_[starts, len(keys)])
        us, vs = [], []
        small = np.repeat(sizes <= 48, sizes)
        k, f = keys[small], fps[small]
        for off in range(1, 48):
            if off >= len(k):
                break
            together = k[off:] == k[:-off]
            if not together.any():
                break
            near = np.flatnonzero(together)
            near = near[np.bitwise_count(f[near] ^ f[near + off]) <= distance]
            us.append(f[near])
            vs.append(f[near + off])
        for at, n in zip(starts[sizes > 48].tolist(), sizes[sizes > 48].tolist()):
            one = fps[at : at + n]
            for got, into in zip(_span(one, one, distance), (us, vs)):
                into.extend(got)
        if us and sum(map(len, us)):
            u, v = np.concatenate(us).view(np.int64), np.concatenate(vs).view(np.int64)
            yield rows(0, u, v, np.zeros_like(u))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps = np.empty(0, np.int64), np.empty(0, np.uint64)
        spilling, sent = None, 0
        for batch in batches:
            k = batch.column(0).to_numpy(zero_copy_only=False)
            f = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            if spilling is not None:
                n = int(np.searchsorted(k, spilling, side="right"))
                yield rows(1, k[:n], np.arange(sent, sent + n), f[:n].view(np.int64))
                sent += n
                k, f = k[n:], f[n:]
                if not len(k):
                    continue
                spilling = None
            keys, fps = np.concatenate([keys, k]), np.concatenate([fps, f])
            if not len(keys):
                continue
            cut = int(np.searchsorted(keys, keys[-1], side="left"))
            if cut:
                yield from solve(keys[:cut], fps[:cut])
                keys, fps = keys[cut:], fps[cut:]
            if len(keys) > hot:
                spilling, sent = int(keys[0]), len(keys)
                yield rows(1, keys, np.arange(sent), fps.view(np.int64))
                keys, fps = np.empty(0, np.int64), np.empty(0, np.uint64)
        if len(keys):
            yield from solve(keys, fps)

    return run


def _block_links(distance: int):
    def links(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0])
        fps, block = pdf["fp"].to_numpy().view(np.uint64), pdf["block"].to_numpy()
        a = fps[block == i]
        us, vs = _span(a, a if i == j else fps[block == j], distance)
        u, v = (np.concatenate(x).view(np.int64) if x else np.empty(0, np.int64) for x in (us, vs))
        return pd.DataFrame({"u": u, "v": v})

    return links


def links(classes: DataFrame, distance: int = DISTANCE, hot: int = HOT, block: int = BLOCK) -> DataFrame:
    """(u, v): links between distinct fingerprints that span every pair within the distance."""
    if distance > 2 * len(SEGMENTS) - 1:
        raise ValueError("the segments find pairs of at most 5 bits")
    sorted_ = variants(classes).repartition("key").sortWithinPartitions("key")
    found = materialize(sorted_.mapInArrow(_bucket_links(distance, hot), "kind int, a long, b long, c long"))
    out = found.filter("kind = 0").select(F.col("a").alias("u"), F.col("b").alias("v"))
    members = found.filter("kind = 1").select(F.col("a").alias("key"), F.floor(F.col("b") / block).alias("block"), F.col("c").alias("fp"))
    if members.isEmpty():
        return out
    last = members.groupBy("key").agg(F.max("block").alias("last"))
    pairs = members.join(last, "key").select("key", "block", "fp", F.explode(F.sequence(F.lit(0), "last")).alias("other"))
    pairs = pairs.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "fp")
    return out.unionByName(pairs.groupBy("key", "i", "j").applyInPandas(_block_links(distance), "u long, v long"))


def _components(marked: DataFrame, distance: int) -> DataFrame:
    """marked (with fp and _row) and its component_id and component_size."""
    classes = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count("*").alias("n")))
    roots = components(links(classes, distance)).withColumnRenamed("node", "fp")
    placed = classes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lows = placed.groupBy("root").agg(F.min("low").alias("component_id"), F.sum("n").alias("component_size"))
    lookup = salted_lookup(placed.select("fp", "root"), "root", lows, F.col("fp")).select("fp", "root", "component_id", "component_size")
    return salted_lookup(marked, "fp", lookup, F.col("_row"))


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, shingle: int = SHINGLE) -> DataFrame:
    """One row a document: doc_id, fp, component_id (the smallest doc_id reachable), component_size."""
    marked = materialize(fingerprints(docs, shingle).withColumn("_row", F.monotonically_increasing_id()))
    return _components(marked, distance).select("doc_id", "fp", "component_id", "component_size")


def keep_one(docs: DataFrame, distance: int = DISTANCE, shingle: int = SHINGLE) -> DataFrame:
    """The documents that stay, with all their columns: of each component the row with the smallest doc_id (a null
    doc_id last, repeated rows once). Texts are written once beside their fingerprints and shuffle once."""
    spark = docs.sparkSession
    stamped = materialize(docs.withColumn("_fp", _fingerprint_udf(shingle)("text")).withColumn("_row", F.monotonically_increasing_id()))
    placed = materialize(_components(stamped.select("doc_id", F.col("_fp").alias("fp"), "_row"), distance).select("doc_id", "root", "component_size", "_row"))
    shared = placed.filter("component_size > 1")
    rank = F.struct(F.col("doc_id").isNull(), "doc_id", "_row")
    keepers = shared.groupBy("root", F.pmod("_row", F.lit(salts(spark)))).agg(F.min(rank).alias("best")).groupBy("root").agg(F.min("best").alias("best"))
    dropped = shared.select("_row").join(keepers.select(F.col("best._row").alias("_row")), "_row", "left_anti")
    return stamped.join(dropped, "_row", "left_anti").select(*docs.columns)


def op6_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "component_size")

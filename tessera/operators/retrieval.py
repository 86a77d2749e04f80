"""Vector and budgeted retrieval, hold-out, batching and chunking."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.ordering import numbered

#: A query set of at most so many vectors is broadcast; a larger one is met in blocks of this size.
QUERY_BLOCK = 20_000
#: Items and queries of one matrix product: what a task holds of scores is their product, however many there are of either.
ITEM_TILE, QUERY_TILE = 512, 2_048


def _scores(matrix: np.ndarray, ids: np.ndarray, k: int, least: float | None):
    """Over batches of items: each query's k best of the partition, ties by item id."""
    unit = matrix / np.linalg.norm(matrix, axis=1, keepdims=True)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score, item = np.full((len(ids), k), -np.inf), np.full((len(ids), k), np.iinfo(np.int64).max)
        for batch in batches:
            for at in range(0, len(batch), ITEM_TILE):
                tile = batch.iloc[at : at + ITEM_TILE]
                items, names = np.array(tile["vector"].tolist(), dtype=np.float64), tile["item_id"].to_numpy()
                with np.errstate(invalid="ignore", divide="ignore"):
                    items /= np.linalg.norm(items, axis=1, keepdims=True)
                for q in range(0, len(ids), QUERY_TILE):
                    merge(score[q : q + QUERY_TILE], item[q : q + QUERY_TILE], unit[q : q + QUERY_TILE], items, names)
        query, rank = np.nonzero(score > -np.inf)
        for at in range(0, len(query), 100_000):
            q, r = query[at : at + 100_000], rank[at : at + 100_000]
            yield pd.DataFrame({"query_id": ids[q], "item_id": item[q, r], "score": score[q, r]})

    def merge(score: np.ndarray, item: np.ndarray, unit: np.ndarray, items: np.ndarray, names: np.ndarray) -> None:
        """score and item, a row a query, are each replaced by the best of themselves and of items."""
        with np.errstate(invalid="ignore"):
            s = np.round(unit @ items.T, 6)
        floor = score[:, -1:]
        good = np.isfinite(s) & ((s > floor) | ((s == floor) & (names < item[:, -1:])))
        if least is not None:
            good &= s >= least
        touched = np.nonzero(good.any(axis=1))[0]
        if not len(touched):
            return
        s = np.where(good[touched], s[touched], -np.inf)
        if s.shape[1] > k:  # of the tile only its k best can enter; ties at the floor stay
            s[s < np.partition(s, -k, axis=1)[:, -k, None]] = -np.inf
        row, column = np.nonzero(s > -np.inf)
        row = np.concatenate([np.repeat(np.arange(len(touched)), k), row])
        value, name = np.concatenate([score[touched].ravel(), s[s > -np.inf]]), np.concatenate([item[touched].ravel(), names[column]])
        order = np.lexsort((name, -value, row))
        row = row[order]
        first = np.concatenate([[True], row[1:] != row[:-1]])
        rank = np.arange(len(row)) - np.maximum.accumulate(np.where(first, np.arange(len(row)), 0))
        kept = order[rank < k]
        score[touched], item[touched] = value[kept].reshape(-1, k), name[kept].reshape(-1, k)

    return run


def nearest(queries: DataFrame, items: DataFrame, k: int, least: float | None = None) -> DataFrame:
    """Queries (query_id, vector) against items (item_id, vector): the k of highest cosine, ties by id.

    A stated query set meets all items: queries are gathered into blocks of at most QUERY_BLOCK, each broadcast as one
    matrix, and items stream past it in tiles as matrix products. A task keeps k rows a query and the scores of one tile,
    so what shuffles is tasks times k rows a query. Null vectors and those of length zero match nothing. The work is
    queries times items by nature; memory is bounded by the block.
    """
    spark = queries.sparkSession
    q = queries.filter(F.col("vector").isNotNull())
    n = max(1, -(-q.count() // QUERY_BLOCK))
    few = items.filter(F.col("vector").isNotNull()).select(F.col("item_id").cast("long"), "vector")
    found = []
    for block in range(n):
        rows = q.filter(F.pmod(F.xxhash64("query_id"), F.lit(n)) == block).select(F.col("query_id").cast("long"), "vector").collect()
        if rows:
            matrix, ids = np.array([r.vector for r in rows], dtype=np.float64), np.array([r.query_id for r in rows], dtype=np.int64)
            found.append(few.mapInPandas(_scores(matrix, ids, k, least), "query_id long, item_id long, score double"))
    scored = reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], "query_id long, item_id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "item_id")
    ranked = scored.withColumn("rank", F.row_number().over(w))
    return ranked.filter(F.col("rank") <= k).select("query_id", "item_id", "score", "rank")


def first_per_group(rows: DataFrame, groups: list[str], order: list, k: int) -> DataFrame:
    """The first k rows of each group; ranked per group, limited by Spark's window group limit before the shuffle."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*groups).orderBy(*order))).filter(F.col("rank") <= k)


def within_budget(rows: DataFrame, groups: list[str], order: list, size: Column, budget: int) -> DataFrame:
    """Rows in order while their running size stays within the budget; for groups that fit a task, as a query's
    neighbours do (ordering.numbered has running sums for larger ones)."""
    window = Window.partitionBy(*groups).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("used", F.sum(size).over(window)).filter(F.col("used") <= budget)


def hold_out(rows: DataFrame, stratum: str, key: str, ties: list[str], share: float) -> DataFrame:
    """Of each stratum the first max(1, floor(n * share)) rows by key and ties are held out."""
    placed = numbered(rows, [stratum], key, ties)
    return placed.withColumn("held_out", F.col("position") <= F.greatest(F.lit(1), F.floor(F.col("group_size") * share))).drop("position", "group_size")


def batches(rows: DataFrame, groups: list[str], key: str, size: int) -> DataFrame:
    """Consecutive batches of a fixed size within a group."""
    return numbered(rows, groups, key, []).withColumn("batch", F.floor((F.col("position") - 1) / size)).drop("position", "group_size")


def spans(text: str, size: int, overlap: int) -> list[tuple[int, int]]:
    """Start and stop of each chunk: it ends after the last separator past its half, where there is one."""
    out, at = [], 0
    while at < len(text):
        stop = len(text)
        if at + size < stop:
            last = max(text.rfind(c, at, at + size) for c in "\n.!?;, ") + 1 - at
            stop = at + (last if last > size // 2 else size)
        out.append((at, stop))
        at = len(text) if stop == len(text) else max(stop - overlap, at + 1)
    return out


def chunks(docs: DataFrame, size: int = 500, overlap: int = 50) -> DataFrame:
    """Docs (doc_id, text) as chunks of at most size characters that share overlap characters.

    The walk is sequential in a text but local to a row: a batch of texts goes to Python and comes back as chunks, in
    time linear in the text. Null and empty texts have none.
    """

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(i, n, a, b, t[a:b]) for i, t in zip(frame["doc_id"], frame["text"]) if t for n, (a, b) in enumerate(spans(t, size, overlap))]
            yield pd.DataFrame(rows, columns=["doc_id", "chunk", "start", "stop", "content"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(cut, f"doc_id {kind}, chunk int, start int, stop int, content string")

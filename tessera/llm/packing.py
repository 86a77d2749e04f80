"""Best-fit packing refined by swap-based local search.

Documents become token ids and are cut into pieces only where longer than a sequence. Full pieces are sequences of
their own, so at most one piece a document is left to place. Those are dealt into shards of bounded size; each shard
is packed best fit, longest first, and its underfull bins then trade pieces: a move, a one-for-one or a two-for-one
exchange is taken when it raises the sum of squared fills, until bins run empty or no trade helps. What remains
underfull in the shards is gathered, dealt into new shards and packed again. No task ever holds more than a shard.

Defined results: null text is empty and gives one piece holding the end id alone; repeated rows are packed once each;
a null doc_id is carried; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import bisect
import heapq
import re
import struct
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialize, table, tidy

LENGTH = 4096
END = 1
#: Pieces that one task packs at most, on average.
SHARD = 12_000
#: A bin with more room than this goes to the second round.
ROOM = 8
#: Chunks in each of the two generations of ids that a worker keeps.
KEPT = 280_000
#: Below U+0180 every letter is in normal form and, but for one, lower-cases to one letter.
_FOREIGN = re.compile("[\u0130\u0180-\U0010ffff]")
#: A last comma or stop of a chunk; the pre-tokeniser parts it from a letter or digit before it.
_MARK = re.compile(r"[,.](?=[ \n\t]|\Z)(?<=[^\W_].)")


class Encoder(dict):
    """Ids of whole texts as little-endian unsigned 32-bit bytes, equal to the library's for the whole text.

    The normaliser turns white space into one blank and the pre-tokeniser never crosses it, so blank-separated chunks
    encode alone as they do in the text; so do lower-cased words and their last comma or stop, where the alphabet is
    known to allow it. Each distinct chunk goes to the library once; the dict keeps what it gave, in two generations of
    bounded size.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.older: dict[str, bytes] = {}
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()

    def encode(self, text: str) -> bytes:
        if not _FOREIGN.search(text):
            text = _MARK.sub(r" \g<0>", text.lower())
        return b"".join(map(self.__getitem__, text.replace("\n", " ").replace("\t", " ").split(" ")))

    def __missing__(self, chunk: str) -> bytes:
        if len(self) > KEPT:
            self.older = dict(self)
            self.clear()
        ids = self.older.get(chunk)
        if ids is None:
            ids = struct.pack(f"<{len(found := self.tokenizer.encode(chunk, add_special_tokens=False).ids)}I", *found)
        self[chunk] = ids
        return ids


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Encoder(path)


_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("slot", pa.int64())])
_PIECES_SQL = "doc_id long, piece int, start long, length long, ids_crc32 long, slot long"


def _pieces(path: str, length: int, end: int):
    tail = np.array([end], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = encoder(path).encode
        slot = TaskContext.get().partitionId() * 7919
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode(text.as_py() or "") + tail
                total = len(ids) // 4
                for piece, start in enumerate(range(0, total, length)):
                    part = ids[4 * start : 4 * (start + length)]
                    rows.append((doc_id, piece, start, len(part) // 4, zlib.crc32(part), slot))
                slot += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), _PIECES)] if rows else [pa.array([], type=f.type) for f in _PIECES], schema=_PIECES)
        tidy()

    return run


def cut_pieces(docs: DataFrame, path: str, length: int = LENGTH, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and slot, a running number that deals rows evenly."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_pieces(path, length, end), _PIECES_SQL)


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Indices by bin: each item, longest first, goes to the open bin with the least room that takes it."""
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms: list[int] = []
    bins: list[list[int]] = []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        at = bisect.bisect_left(rooms, sizes[i])
        if at == len(rooms):
            b, room = len(bins), capacity
            bins.append([])
        else:
            room = rooms[at]
            b = by_room[room].pop()
            if not by_room[room]:
                del rooms[at]
        bins[b].append(i)
        room -= sizes[i]
        if room:
            if not by_room[room]:
                bisect.insort(rooms, room)
            by_room[room].append(b)
    return bins


def _sums(held: dict[int, list[int]], capacity: int) -> int:
    """Bit s is set where none, one or two pieces of the bin (size: its pieces) add up to s."""
    one = 0
    for size in held:
        one |= 1 << size
    sums = 1 | one
    for size, own in held.items():
        sums |= (one if len(own) > 1 else one & ~(1 << size)) << size
    return sums & ((1 << capacity) - 1)


def _best_trades(sums: int, there: int, room: int) -> tuple[int, dict[int, int]]:
    """The largest gain g <= room with a piece of size s in there and s - g in sums, and each such s with its s - g."""
    best, found = 0, {}
    if sums.bit_count() <= room:
        while sums:
            back = sums.bit_length() - 1
            sums ^= 1 << back
            size = (there & ((2 << (back + room)) - 1)).bit_length() - 1
            if size - back > best:
                best, found = size - back, {}
            if size - back == best:
                found[size] = back
    else:
        best, hits = room, (sums << room) & there
        while best and not hits:
            best -= 1
            hits = (sums << best) & there
        while best and hits:
            size = hits.bit_length() - 1
            hits ^= 1 << size
            found[size] = size - best
    return best, found


class _Givers:
    """Bins that may give, by the sizes of their pieces: a bit for each size there is and a heap of (fill, bin) each."""

    def __init__(self, held: list[dict[int, list[int]]], fill: list[int], bins: Iterable[int]):
        self.held, self.fill = held, fill
        self.inside: set[int] = set()
        self.count: dict[int, int] = {}
        self.heaps: dict[int, list[tuple[int, int]]] = {}
        self.bits = 0
        for b in bins:
            self.add(b)

    def add(self, b: int) -> None:
        self.inside.add(b)
        for size in self.held[b]:
            n = self.count.get(size, 0)
            self.count[size] = n + 1
            if not n:
                self.bits |= 1 << size
            heapq.heappush(self.heaps.setdefault(size, []), (self.fill[b], b))

    def drop(self, b: int) -> None:
        self.inside.discard(b)
        for size in self.held[b]:
            self.count[size] -= 1
            if not self.count[size]:
                self.bits ^= 1 << size

    def emptiest(self, size: int) -> tuple[int, int]:
        """(fill, bin) of the emptiest bin that holds the size; entries that no longer hold are thrown away."""
        heap = self.heaps[size]
        while (top := heap[0])[1] not in self.inside or self.fill[top[1]] != top[0] or size not in self.held[top[1]]:
            heapq.heappop(heap)
        return top


def improve(bins: list[list[int]], sizes: list[int], capacity: int) -> list[list[int]]:
    """Local search over all underfull bins; squared fill rises at every step, so it ends.

    The fuller bin of a pair (room r) receives: a piece that fits (move), or a piece that is larger than one, or than
    two, of its own by at most r (exchange). A sweep takes the bins from the fullest down; each takes the largest gain
    that any bin no fuller than itself offers, from the emptiest such bin, until none is left. Sizes are bits of whole
    numbers, so all pieces of all bins are looked at together. It ends with a sweep that finds no trade.
    """
    held: list[dict[int, list[int]]] = [{} for _ in bins]
    for b, own in enumerate(bins):
        for i in own:
            held[b].setdefault(sizes[i], []).append(i)
    fill = [sum(sizes[i] for i in b) for b in bins]
    while _sweep(held, fill, capacity):
        pass
    return [[i for own in h.values() for i in own] for h in held if h]


def _sweep(held: list[dict[int, list[int]]], fill: list[int], capacity: int) -> bool:
    loose = [b for b in range(len(held)) if held[b] and fill[b] < capacity]
    givers = _Givers(held, fill, loose)
    order = [(-fill[b], b) for b in loose]
    heapq.heapify(order)
    better = False
    seen: set[int] = set()  # bins that took all they could, at this level: they may still give to one as full
    level = capacity
    while order:
        at, taker = heapq.heappop(order)
        if taker not in givers.inside or fill[taker] != -at or taker in seen:
            continue
        if fill[taker] < level:
            for b in seen:
                givers.drop(b)
            seen, level = set(), fill[taker]
        givers.drop(taker)
        sums = _sums(held[taker], capacity)
        while fill[taker] < capacity:
            gain, found = _best_trades(sums, givers.bits, capacity - fill[taker])
            if not gain:
                break
            (_, giver), size = min((givers.emptiest(s), s) for s in found)
            givers.drop(giver)
            _exchange(held, taker, giver, size, found[size])
            fill[taker] += gain
            fill[giver] -= gain
            if held[giver]:
                givers.add(giver)
                heapq.heappush(order, (-fill[giver], giver))
            seen.discard(giver)
            sums = _sums(held[taker], capacity)
            better = True
        if fill[taker] == -at:
            givers.add(taker)
            seen.add(taker)
    return better


def _exchange(held: list[dict[int, list[int]]], taker: int, giver: int, size: int, back: int) -> None:
    """A piece of that size goes to the taker; none, one or two of its pieces, back in sum, return."""
    mine = held[taker]
    if not back:
        returned = []
    elif back in mine:
        returned = [back]
    else:
        one = next(s for s in mine if back - s in mine and (2 * s != back or len(mine[s]) > 1))
        returned = [one, back - one]
    moves = [(giver, taker, size)] + [(taker, giver, s) for s in returned]
    pieces = [(to, s, _take(held[of], s)) for of, to, s in moves]
    for to, s, i in pieces:
        held[to].setdefault(s, []).append(i)


def _take(held: dict[int, list[int]], size: int) -> int:
    i = held[size].pop()
    if not held[size]:
        del held[size]
    return i


_PLACED_SQL = "doc_id long, piece int, start long, length long, ids_crc32 long, slot long, sequence_id long, offset long, room long"


def _pack(length: int, tag: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece", "ids_crc32", "slot"], kind="stable").reset_index(drop=True)
        sizes = pdf["length"].tolist()
        bins = improve(best_fit(sizes, length), sizes, length)
        first = (int(pdf["shard"].iloc[0]) << 24) + tag
        order = np.fromiter((i for b in bins for i in b), dtype=np.int64, count=len(sizes))
        of = np.repeat(np.arange(len(bins)), [len(b) for b in bins])
        used = pdf["length"].to_numpy()[order]
        ends = np.cumsum(used)
        starts = np.r_[0, ends[:-1]]
        opens = np.r_[0, np.cumsum([len(b) for b in bins])[:-1]]
        fill = np.add.reduceat(used, opens)
        out = pdf.iloc[order][["doc_id", "piece", "start", "length", "ids_crc32", "slot"]].copy()
        out["sequence_id"] = first + of
        out["offset"] = starts - np.repeat(starts[opens], [len(b) for b in bins])
        out["room"] = length - fill[of]
        return out

    return run


def _round(pieces: DataFrame, n: int, length: int, tag: int, shard: int) -> DataFrame:
    shards = max(1, -(-n // shard))
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("slot", "doc_id", "piece"), F.lit(shards)))
    return dealt.repartition(shards, "shard").groupBy("shard").applyInPandas(_pack(length, tag), _PLACED_SQL)


def pack(docs: DataFrame, path: str, length: int = LENGTH, end: int = END, shard: int = SHARD) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = materialize(cut_pieces(docs, path, length, end))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    whole = pieces.filter(F.col("length") == length).withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    tails = pieces.filter(F.col("length") < length)
    first = materialize(_round(tails, tails.count(), length, 0, shard))
    done = first.filter(F.col("room") <= ROOM)
    left = first.filter(F.col("room") > ROOM)
    second = _round(left.select("doc_id", "piece", "start", "length", "ids_crc32", "slot"), left.count(), length, 1 << 23, shard)
    return whole.select(columns).unionByName(done.select(columns)).unionByName(second.select(columns))


def op1_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))

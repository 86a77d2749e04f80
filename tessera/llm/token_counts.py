"""Token counts of a byte-level BPE vocabulary by heap-and-linked-list merging.

A pre-token starts as its bytes' symbols in a doubly linked list. A heap holds the adjacent pairs that have a rank;
the lowest rank (leftmost first) is popped again and again, stale entries are skipped, the pair is joined and its new
neighbours are pushed. The count is the number of initial symbols less the merges: no identifier is ever emitted.

Each worker keeps the counts of pre-tokens that it has met, up to a fixed number. Special strings inside a text count
one token each, as the library's default has it.

Defined results: null counts as empty (0 bytes, 0 tokens); long texts are read whole; repeated rows come back once
each; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import json
import re as plain_re
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import table

LIMIT = 1024
#: Pre-tokens in each of the two generations of counts that a worker keeps.
KEPT = 600_000
#: Fixed value: the published pre-token pattern of the byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte: itself where printable, else the next free code point from 256."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


class Counter:
    """Counts the tokens of whole texts under one vocabulary file."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        merges = spec["model"]["merges"]
        self.ranks = {tuple(m.split(" ")) if isinstance(m, str) else tuple(m): i for i, m in enumerate(merges)}
        self.symbols = byte_symbols()
        special = [t["content"] for t in spec.get("added_tokens", [])]
        self.special = plain_re.compile("|".join(map(plain_re.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.find = regex.compile(PATTERN).findall
        self.kept: dict[str, int] = {}
        self.older: dict[str, int] = {}

    def pre_token(self, word: str) -> int:
        symbols = [self.symbols[b] for b in word.encode("utf-8", "surrogatepass")]
        n = len(symbols)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        ranks = self.ranks
        heap = [(r, i, symbols[i], symbols[i + 1]) for i in range(n - 1) if (r := ranks.get((symbols[i], symbols[i + 1]))) is not None]
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i]
            if j < 0 or symbols[i] != left or symbols[j] != right:
                continue
            symbols[i] = left + right
            symbols[j] = ""
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            after[j] = -1
            merges += 1
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (r := ranks.get((symbols[a], symbols[b]))) is not None:
                    heapq.heappush(heap, (r, a, symbols[a], symbols[b]))
        return n - merges

    def learn(self, words: list[str]) -> None:
        if len(self.kept) > KEPT:
            self.older, self.kept = self.kept, {}
        kept, older = self.kept, self.older
        for word in words:
            if word not in kept:
                kept[word] = older[word] if word in older else self.pre_token(word)

    def count(self, text: str) -> int:
        total = 0
        if self.special is not None and self.special.search(text):
            total += len(self.special.findall(text))
            parts = self.special.split(text)
        else:
            parts = (text,)
        kept = self.kept
        for part in parts:
            words = self.find(part)
            try:
                total += sum(map(kept.__getitem__, words))
            except KeyError:
                self.learn(words)
                kept = self.kept
                total += sum(map(kept.__getitem__, words))
        return total


@lru_cache(maxsize=4)
def counter(path: str) -> Counter:
    """One a worker and vocabulary."""
    return Counter(path)


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every document; row-local, no shuffle."""

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        of = counter(path).count
        return pd.Series([of(t) for t in texts], dtype="int64")

    text = F.coalesce(F.col("text"), F.lit(""))
    counted = docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), count(text).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op7_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))

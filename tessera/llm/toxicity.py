"""Toxicity: a convolutional text classifier trained in numpy.

A word is the sum of two hashed embeddings, of the whole lower-cased word and of its first letters. Filters of several
widths run over the words, each filter's maximum over the whole text is pooled (position-free, so a text's length is
unbounded), and a logistic layer gives a probability. Training is mini-batch Adam over every labelled row that may be
learnt, whole texts. Rows are dealt to shards of about SHARD rows by hashed doc_id. A few passes over the first shard
give a common start; in every round after that each shard is learnt from the current model, in Arrow batches on the
executors, and the local models are averaged, an embedding by how often each shard updated it. The driver holds only the
models (some MB, fixed size).

Thresholds are calibrated by language. Every labelled row is scored by a model that did not learn it (two folds by
hashed doc_id), and rows are counted by language and log odds in steps of 1/GRAIN; the language is told from the text
alone (share of common function words). The best F1 threshold of each language maps to 0.3 by a monotone rescaling of
the probability, so that one cut serves all; a language with fewer than OWN toxic rows shares the threshold of all.
Labels, lang, source and doc_id are never inputs of a score.

Defined results: null or wordless text is scored like any other, with all filters at zero; repeated rows score alike;
with no labelled rows of both classes every score is the prior; of labelled doc_ids with several texts the lowest text is
learnt, and a doc_id labelled both ways is toxic; an empty table gives an empty result; extra columns
are carried by reject() and ignored by scores().
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialize, release, table, tidy

#: Labelled rows that one local model learns in a round.
SHARD = 4096
#: Passes over the first shard alone, then over all shards.
WARM, ROUNDS = 3, 3
#: Steps of the log odds by which out-of-fold scores are counted.
GRAIN = 100
#: Toxic rows that a language needs for a threshold of its own.
OWN = 15
CUT = 0.3
BUCKETS, PREFIXES, WIDTH = 1 << 15, 1 << 13, 12
WIDTHS, FILTERS = (1, 2, 3), 12
#: Letters of the second embedding of a word: with four, held-out labelled rows are told better than with five.
PREFIX = 4
EPOCHS, BATCH_WORDS = WARM + ROUNDS, 24_000
RATE, DECAY = 0.02, 0.7
SEED = 7
#: A word's code is word bucket * _BASE + prefix bucket; the last row of either table is the padding word's.
_BASE = PREFIXES + 1
_PAD = BUCKETS * _BASE + PREFIXES
_WORD = re.compile(r"[^\W_]+")
#: Frequent function words by language.
FUNCTION_WORDS = {
    "en": "the of and to in is that for it with as on be at this are from",
    "de": "der die und das ist von mit den zu im ein eine nicht sich auch für auf",
    "fr": "le la les de et des un une est pour dans que qui sur avec pas du",
    "es": "el la los las de y que en un una por con para no se del al",
}
LANGUAGES = (*FUNCTION_WORDS, "other")
_BY_WORD: dict[str, np.ndarray] = {}
for _i, _l in enumerate(FUNCTION_WORDS):
    for _w in FUNCTION_WORDS[_l].split():
        _BY_WORD.setdefault(_w, np.zeros(len(FUNCTION_WORDS)))[_i] += 1.0


class Hasher:
    """Words to codes of (word bucket, prefix bucket), and the text's language, keeping the codes of words met."""

    KEPT = 150_000

    def __init__(self):
        self.kept: dict[str, int] = {}

    def code(self, word: str) -> int:
        crc = zlib.crc32
        return crc(word.encode()) % BUCKETS * _BASE + crc(b"^" + word[:PREFIX].encode()) % PREFIXES

    def codes(self, text: str | None) -> tuple[np.ndarray, int]:
        words = _WORD.findall((text or "").lower())
        kept = self.kept
        try:
            found = list(map(kept.__getitem__, words))
        except KeyError:
            if len(kept) > self.KEPT:
                kept.clear()
            for w in words:
                if w not in kept:
                    kept[w] = self.code(w)
            found = list(map(kept.__getitem__, words))
        votes = np.zeros(len(FUNCTION_WORDS))
        for w, n in Counter(filter(_BY_WORD.__contains__, words)).items():
            votes += n * _BY_WORD[w]
        language = int(votes.argmax()) if votes.any() else len(FUNCTION_WORDS)
        found += [_PAD] * (max(WIDTHS) - len(found))
        return np.array(found, dtype=np.int64), language


HASHER = Hasher()


def _fresh(rng: np.random.Generator) -> dict[str, np.ndarray]:
    p = {"word": rng.normal(0, 0.1, (BUCKETS + 1, WIDTH)), "prefix": rng.normal(0, 0.1, (PREFIXES + 1, WIDTH)), "out": rng.normal(0, 0.1, len(WIDTHS) * FILTERS), "bias": np.zeros(1)}
    p["conv"] = rng.normal(0, 0.3, (sum(WIDTHS), FILTERS, WIDTH))  # one slab a width and offset in the window
    p["shift"] = np.zeros((len(WIDTHS), FILTERS))
    p["word"][-1] = p["prefix"][-1] = 0  # the padding word
    return {k: v.astype(np.float32) for k, v in p.items()}


def _pooled(p: dict[str, np.ndarray], codes: np.ndarray, block: int = 8192) -> tuple[np.ndarray, np.ndarray]:
    """Each filter's maximum over the whole text (0 at least) and where it was, block by block.

    codes are padded to the largest width. Every word is projected once for each slab; a window's value is the sum of
    its words' projections.
    """
    best = np.zeros((len(WIDTHS), FILTERS), np.float32)
    where = np.full(best.shape, -1)
    stack = p["conv"].reshape(-1, WIDTH)
    every = np.arange(FILTERS)
    for at in range(0, len(codes), block):
        part = codes[at : at + block + max(WIDTHS) - 1]
        x = p["word"][part // _BASE] + p["prefix"][part % _BASE]
        r = (stack @ x.T).reshape(sum(WIDTHS), FILTERS, -1)
        slab = 0
        for i, w in enumerate(WIDTHS):
            n = min(block, len(part) - w + 1)
            if n > 0:
                z = r[slab, :, :n]
                for j in range(1, w):
                    z = z + r[slab + j, :, j : j + n]
                top = z.argmax(axis=1)
                value = z[every, top] + p["shift"][i]
                more = value > best[i]
                best[i] = np.where(more, value, best[i])
                where[i] = np.where(more, top + at, where[i])
            slab += w
    return best.ravel(), where


def _probability(p: dict[str, np.ndarray], codes: np.ndarray) -> float:
    z = float(_pooled(p, codes)[0] @ p["out"] + p["bias"][0])
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _start(mean: float, seed: int = SEED) -> dict[str, np.ndarray]:
    p = _fresh(np.random.default_rng(seed))
    p["bias"][0] = np.log(mean / (1 - mean))
    return p


class Learner:
    """Adam over mini-batches of about BATCH_WORDS words, from the parameters given; embeddings get sparse updates.

    mean is the share of label 1 among all rows to learn. steps holds how often each row of a parameter was updated.
    """

    def __init__(self, p: dict[str, np.ndarray], mean: float, rate: float = RATE):
        self.p = {k: v.copy() for k, v in p.items()}
        self.first, self.second = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
        self.steps = {k: np.zeros(len(v), np.float32) for k, v in p.items()}
        self.weight = min(4.0, 0.5 / mean)
        self.rate, self.step = rate, 0
        self.batch: list[tuple[np.ndarray, float]] = []
        self.words = 0

    def add(self, codes: np.ndarray, label: float) -> None:
        self.batch.append((codes, label))
        self.words += len(codes) + 300
        if self.words >= BATCH_WORDS:
            self.flush()

    def flush(self) -> None:
        """One update from the rows that wait."""
        if not self.batch:
            return
        p, first, second, rate = self.p, self.first, self.second, self.rate
        found = [_pooled(p, codes) for codes, _ in self.batch]
        pooled, where = np.stack([x for x, _ in found]), np.stack([x for _, x in found])
        labels = np.array([y for _, y in self.batch])
        q = 1 / (1 + np.exp(-np.clip(pooled @ p["out"] + p["bias"][0], -30, 30)))
        d = ((q - labels) * np.where(labels == 1, self.weight, 1.0) / len(labels)).astype(np.float32)
        back = np.where(where >= 0, d[:, None, None] * p["out"].reshape(where.shape[1:]), 0).astype(np.float32)
        grad = {"out": d @ pooled, "bias": d.sum(keepdims=True), "shift": back.sum(axis=0), "conv": np.zeros_like(p["conv"])}
        words = np.concatenate([codes for codes, _ in self.batch])
        starts = np.cumsum([0, *(len(codes) for codes, _ in self.batch)])[:-1, None]
        rows, parts, slab = [], [], 0
        for k, w in enumerate(WIDTHS):
            text, at = np.nonzero(where[:, k] >= 0)  # texts and filters
            g = back[text, k, at][:, None]
            for j in range(w):
                here = words[(starts + where[:, k])[text, at] + j]
                np.add.at(grad["conv"][slab + j], at, g * (p["word"][here // _BASE] + p["prefix"][here % _BASE]))
                rows.append(here)
                parts.append(g * p["conv"][slab + j, at])
            slab += w
        self.step += 1
        for k, g in grad.items():
            g = g + 1e-5 * p[k]
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            p[k] -= rate * (first[k] / (1 - 0.9**self.step)) / (np.sqrt(second[k] / (1 - 0.99**self.step)) + 1e-6)
            self.steps[k] += 1
        here, g = np.concatenate(rows), np.vstack(parts)
        for k, ids in (("word", here // _BASE), ("prefix", here % _BASE)):
            unique, back = np.unique(ids, return_inverse=True)
            total = np.zeros((len(unique), WIDTH), np.float32)
            np.add.at(total, back, g)
            first[k][unique] = 0.9 * first[k][unique] + 0.1 * total
            second[k][unique] = 0.99 * second[k][unique] + 0.01 * total * total
            p[k][unique] -= rate * first[k][unique] / (np.sqrt(second[k][unique]) + 1e-6)
            p[k][-1] = 0
            self.steps[k][unique] += 1
        self.batch, self.words = [], 0


def train(texts: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> dict[str, np.ndarray]:
    """Parameters from rows that are held in memory, in another order each epoch."""
    mean = float(labels.mean())
    learner, rng = Learner(_start(mean, seed), mean), np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(texts)):
            learner.add(texts[i], labels[i])
        learner.flush()
        learner.rate *= DECAY
    return learner.p


def _calibrate(scores: np.ndarray, toxic: np.ndarray, rows: np.ndarray, languages: np.ndarray) -> dict[int, float]:
    """The F1-best threshold by language; a language with few positives shares the threshold of all.

    Each entry is a score, with how many rows have it and how many of those are toxic.
    """

    def best(s: np.ndarray, y: np.ndarray, n: np.ndarray) -> float:
        order = np.argsort(-s, kind="stable")
        s, y, n = s[order], y[order], n[order]
        f1 = 2 * np.cumsum(y) / (np.cumsum(n) + y.sum())
        good = s[f1 >= f1.max() - 0.01]
        odds = np.log(good / (1 - good + 1e-9) + 1e-9)
        return float(np.clip(1 / (1 + np.exp(-(odds.min() + odds.max()) / 2)), 0.02, 0.98))

    whole = best(scores, toxic, rows)
    out = {}
    for i in range(len(LANGUAGES)):
        own = languages == i
        out[i] = best(scores[own], toxic[own], rows[own]) if toxic[own].sum() >= OWN else whole
    return out


def _rescale(q: float, threshold: float) -> float:
    """Monotone and piecewise linear from [0, 1] to [0, 1]; the threshold goes to CUT."""
    return q / threshold * CUT if q < threshold else CUT + (q - threshold) / (1 - threshold) * (1 - CUT)


def fit(sample: list[tuple[str | None, int]], seed: int = SEED) -> dict:
    """Model from (text, label) rows in memory: parameters and thresholds. Each half is scored by a model of the other half."""
    hasher = Hasher()
    coded = [hasher.codes(text) for text, _ in sample]
    labels = np.array([y for _, y in sample], dtype=np.float64)
    if len(labels) < 10 or labels.min() == labels.max():
        return {"prior": float(labels.mean()) if len(labels) else 0.0}
    codes, languages = [c for c, _ in coded], np.array([lang for _, lang in coded])
    p = train(codes, labels, seed=seed)
    fold = np.zeros(len(labels), dtype=int)
    for i, y in enumerate((0, 1)):  # either class falls into halves
        own = np.random.default_rng(seed + i).permutation(np.flatnonzero(labels == y))
        fold[own[::2]] = 1
    scores = np.empty(len(labels))
    for f in (0, 1):
        other = [i for i in range(len(labels)) if fold[i] != f]
        both = 0 < labels[other].sum() < len(other)
        of = train([codes[i] for i in other], labels[other], seed=seed) if both else p
        for i in np.flatnonzero(fold == f):
            scores[i] = _probability(of, codes[i])
    return {"p": p, "thresholds": _calibrate(scores, labels, np.ones(len(labels)), languages)}


def score_text(model: dict, text: str | None) -> float:
    if "prior" in model:
        return model["prior"]
    codes, language = HASHER.codes(text)
    return float(_rescale(_probability(model["p"], codes), model["thresholds"][language]))


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows whose labels are never learnt: crc32 of the id as text leaves 2 on division by 4."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


#: The models that are trained together: of all rows, and of those outside either fold.
_MODELS = (None, 0, 1)
_BLOCKS = 32


def _coded(docs: DataFrame, marked: DataFrame, shards: int) -> DataFrame:
    """Every labelled text once, as codes: fold, shard and order come from the doc_id. A file holds whole shards."""

    @F.pandas_udf("codes binary, language int")
    def code(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        try:
            for texts in batches:
                found = [HASHER.codes(t) for t in texts]
                yield pd.DataFrame({"codes": [c.astype(np.int32).tobytes() for c, _ in found], "language": [x for _, x in found]})
        finally:
            HASHER.kept.clear()
            tidy()

    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).filter(~held_out())
    rows = texts.join(marked, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic"))
    rows = rows.select("doc_id", "toxic", code("text").alias("_c")).select("doc_id", "toxic", "_c.*")
    hashed = lambda seed, n: F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(n)).cast("int")
    rows = rows.withColumns({"shard": hashed("shard", shards), "fold": hashed("fold", 2)})
    rows = rows.repartition(shards, "shard").sortWithinPartitions("shard", F.xxhash64("doc_id"), "doc_id")
    return materialize(rows.select("shard", "fold", "toxic", "language", "codes"))


def _blocks(learner: Learner) -> Iterator[bytes]:
    """The learner's parameters, each row times its number of updates, then these numbers; rows never updated are zero."""
    flat = [(v.reshape(len(v), -1) * learner.steps[k][:, None]).ravel() for k, v in learner.p.items()]
    flat += list(learner.steps.values())
    return (part.astype(np.float32).tobytes() for part in np.array_split(np.concatenate(flat), _BLOCKS))


def _merged(p: dict[str, np.ndarray], flat: np.ndarray) -> dict[str, np.ndarray]:
    """The mean of local models by their numbers of updates; a row that none has updated stays as it was."""
    at, sums, out = 0, {}, {}
    for k, v in p.items():
        sums[k] = flat[at : at + v.size].reshape(len(v), -1)
        at += v.size
    for k, v in p.items():
        steps = flat[at : at + len(v)][:, None]
        at += len(v)
        mean = sums[k] / np.maximum(steps, 1)
        out[k] = np.where(steps > 0, mean, v.reshape(len(v), -1)).reshape(v.shape).astype(np.float32)
    return out


def _round(coded: DataFrame, models: dict, means: dict, rate: float) -> dict:
    """One pass: each shard is learnt from the models given, and what the shards learnt is averaged on the executors."""
    spark = coded.sparkSession
    shared = spark.sparkContext.broadcast(pickle.dumps((models, means)))

    def learn(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        start, share = pickle.loads(shared.value)
        at, learners, total = None, {}, {}

        def end() -> None:
            for m, learner in learners.items():
                learner.flush()
                for i, block in enumerate(_blocks(learner)):
                    total[m, i] = total.get((m, i), 0) + np.frombuffer(block, np.float32).astype(np.float64)

        for frame in frames:
            for shard, fold, toxic, codes in zip(frame["shard"], frame["fold"], frame["toxic"], frame["codes"], strict=True):
                if shard != at:
                    end()
                    at, learners = shard, {m: Learner(start[m], share[m], rate) for m in start}
                row = np.frombuffer(codes, np.int32)
                for m, learner in learners.items():
                    if _MODELS[m] != fold:
                        learner.add(row, float(toxic))
        end()
        if total:
            yield pd.DataFrame([(m, i, at, v.astype(np.float32).tobytes()) for (m, i), v in total.items()], columns=["model", "block", "shard", "part"])
        learners.clear()
        tidy()

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for frame in frames:
            for m, i, part in zip(frame["model"], frame["block"], frame["part"], strict=True):
                total[m, i] = total.get((m, i), 0) + np.frombuffer(part, np.float32).astype(np.float64)
        if total:
            yield pd.DataFrame([(m, i, v.astype(np.float32).tobytes()) for (m, i), v in total.items()], columns=["model", "block", "part"])

    parts = coded.select("shard", "fold", "toxic", "codes").mapInPandas(learn, "model int, block int, shard int, part binary")
    parts = parts.repartition("model", "block").sortWithinPartitions("model", "block", "shard")
    sums = {(r.model, r.block): np.frombuffer(r.part, np.float32) for r in parts.select("model", "block", "part").mapInPandas(add, "model int, block int, part binary").collect()}
    shared.destroy()
    return {m: _merged(p, np.concatenate([sums[m, i] for i in range(_BLOCKS)])) if (m, 0) in sums else p for m, p in models.items()}


def _out_of_fold(coded: DataFrame, models: dict) -> list:
    """How many rows, and toxic ones, there are by language and step of the log odds, each scored by a model that did not learn it."""
    shared = coded.sparkSession.sparkContext.broadcast(pickle.dumps(models))

    @F.pandas_udf("int")
    def step(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        own = pickle.loads(shared.value)
        of = {f: own.get(_MODELS.index(f), own[0]) for f in (0, 1)}
        for folds, codes in batches:
            q = np.array([_probability(of[f], np.frombuffer(c, np.int32)) for f, c in zip(folds, codes, strict=True)])
            yield pd.Series(np.rint(np.log(q / (1 - q)) * GRAIN).astype(np.int32))

    scored = coded.select("language", "toxic", step("fold", "codes").alias("step"))
    return scored.groupBy("language", "step").agg(F.sum("toxic").alias("toxic"), F.count("*").alias("rows")).collect()


def train_from(docs: DataFrame, labels: DataFrame, shard: int = SHARD) -> dict:
    """Fit on every labelled row that may be learnt, in shards of about shard rows; thresholds count every one of them."""
    spark = docs.sparkSession
    known = labels.filter(~held_out() & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    marked = known.groupBy("doc_id").agg(F.max(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("toxic"))
    marks = marked.count()
    if not marks:
        return {"prior": 0.0}
    shards = -(-marks // shard)
    coded = _coded(docs, marked, shards)
    of = {(r.fold, r.toxic): r["count"] for r in coded.groupBy("fold", "toxic").count().collect()}
    rows, toxic = sum(of.values()), of.get((0, 1), 0) + of.get((1, 1), 0)
    if rows < 10 or toxic in (0, rows):
        release(spark, coded)
        return {"prior": toxic / rows if rows else 0.0, "rows": rows}
    models, means = {}, {}
    for m, fold in enumerate(_MODELS):
        n, y = (sum(v for (f, t), v in of.items() if f != fold and t >= least) for least in (0, 1))
        if 0 < y < n:
            models[m], means[m] = _start(y / n), y / n
    for i in range(WARM + ROUNDS):
        models = _round(coded.filter("shard = 0") if i < WARM and shards > 1 else coded, models, means, RATE * DECAY**i)
    counts = _out_of_fold(coded, models)
    release(spark, coded)
    column = lambda k: np.array([r[k] for r in counts], dtype=np.float64)
    thresholds = _calibrate(1 / (1 + np.exp(-column("step") / GRAIN)), column("toxic"), column("rows"), column("language"))
    return {"p": models[0], "thresholds": thresholds, "rows": rows, "calibrated": int(column("rows").sum())}


def scores(docs: DataFrame, model: dict, cut: float = CUT) -> DataFrame:
    """docs with score and predicted; the model (some MB, fixed size) is broadcast, nothing shuffles."""
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = pickle.loads(shared.value)
        try:
            for texts in batches:
                yield pd.Series([score_text(own, t) for t in texts], dtype="float64")
        finally:
            HASHER.kept.clear()
            tidy()

    scored = docs.withColumn("score", score("text"))
    return scored.withColumn("predicted", F.when(F.col("score") >= cut, 1).otherwise(0))


def reject(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not predicted toxic, with all their columns."""
    model = train_from(docs, labels)
    named = docs.select(F.struct(*docs.columns).alias("_doc"), "text")
    return scores(named, model).filter("predicted = 0").select("_doc.*")


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train_from(docs, table(spark, sf_dir, "labels"))
    return scores(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")

"""Toxicity scores by a factorization machine over hashed terms."""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from plumbline.llm.common import body, discard, held_out, small, small_batches, stored, table

#: Labelled documents of each class that are read at most, and bytes of their terms that reach the driver.
SAMPLE, TERM_BYTES = 6_000, 64 << 20
#: Hash buckets; documents of the sample that a bucket must occur in to have parameters (others weigh 0, as one never seen).
BUCKETS, LEAST = 1 << 18, 5
#: Factors, rows a step, passes with weights alone, then with factors at most, and passes without a gain on the rows kept
#: aside that end them.
FACTORS, BATCH, FIRST, PASSES, PATIENCE = 8, 128, 20, 20, 8
#: Scale of factors at their start, and of their steps against those of weights: a text has very many pairs.
START, SLOWER = 0.005, 0.15
THRESHOLD = 0.3
CACHE = 600_000

_TERM = re.compile(r"[^\W_]+")


def term_buckets(word: str) -> list[int]:
    """Of the word in lower case and of its stems, the first 4 and 5 letters of longer ones: inflected insults share a stem."""
    w = word.lower()
    return [zlib.crc32(t.encode("utf-8", "surrogatepass")) % BUCKETS for t in (w, *(f"{w[:k]}-" for k in (4, 5) if len(w) > k))]


@dataclass
class FactorizationMachine:
    """bias + sum of weights + sum over pairs of dot products of factors, over the buckets that a text has."""

    buckets: np.ndarray
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def margin(self, row: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
        """Of ``n`` texts; text ``row[i]`` has the bucket at place ``at[i]``, once."""
        total = lambda x: np.bincount(row, weights=x[at], minlength=n)
        squares = sum((total(f) ** 2 for f in self.factors.T), np.zeros(n))
        return self.bias + total(self.weights) + 0.5 * (squares - total((self.factors**2).sum(axis=1)))

    def probability(self, row: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(row, at, n), -30, 30)))


def fit_machine(found: list[np.ndarray], labels: np.ndarray, weight: np.ndarray, seed: int = 5, l1: float = 1e-3, l2: float = 2e-2, rate: float = 0.05, least: int = LEAST) -> FactorizationMachine:
    """AdaGrad on the weighted logistic loss; ``found`` has the distinct buckets of each text. A step touches only the buckets
    of its rows, so that all that occur in ``least`` texts have a weight (shrunk to 0 by ``l1`` where nothing speaks for one)
    and factors (by ``l2``). Weights are fitted first, then weights and factors; a tenth of the texts is kept aside, and the
    parameters that do best on it are returned."""
    n = len(found)
    every = np.concatenate([*found, np.zeros(0, "i4")]).astype("i4", copy=False)
    often = np.bincount(every, minlength=BUCKETS) >= least
    buckets, ok = np.flatnonzero(often), often[every]
    row = np.repeat(np.arange(n, dtype="i4"), [len(f) for f in found])[ok]
    place = (np.cumsum(often) - 1).astype("i4")[every[ok]]
    del every, ok
    rng = np.random.default_rng(seed)
    base = float(np.average(labels, weights=weight)) if n else 0.5
    bias, seen_bias = float(np.log(max(base, 1e-6) / max(1 - base, 1e-6))), 1e-4
    params = np.zeros((len(buckets), FACTORS + 1), "f4")  # a bucket's weight, then its factors
    seen = np.full(params.shape, 1e-4, "f4")
    weight = weight / weight.mean() if n else weight
    order, bounds = rng.permutation(n), np.searchsorted(row, np.arange(n + 1))
    aside, order = order[: n // 10], order[n // 10 :]
    ends = bounds[aside + 1] - bounds[aside]
    tests = (np.repeat(np.arange(len(aside)), ends), np.concatenate([place[bounds[r] : bounds[r + 1]] for r in aside] + [np.zeros(0, "i8")]), len(aside))
    made = lambda: FactorizationMachine(buckets, bias, params[:, 0].astype(float), params[:, 1:].astype(float))
    best, least_loss, idle = made(), math.inf, 0
    for turn in range(FIRST + PASSES if len(buckets) else 0):
        if turn == FIRST:  # factors of 0 have no gradient: until here there were none
            idle, bias, params[:, 0] = 0, best.bias, best.weights
            params[:, 1:], seen[:, 1:] = rng.normal(0, START, (len(buckets), FACTORS)), 1.0
        for k in rng.permutation(-(-len(order) // BATCH)):
            rows = order[k * BATCH : (k + 1) * BATCH]
            u, inv = np.unique(np.concatenate([place[bounds[r] : bounds[r + 1]] for r in rows]), return_inverse=True)
            x = np.zeros((len(rows), len(u)), "f4")
            x[np.repeat(np.arange(len(rows)), bounds[rows + 1] - bounds[rows]), inv] = 1
            p = params[u]
            v = p[:, 1:]
            out = x @ np.concatenate([p[:, :1] - 0.5 * (v * v).sum(axis=1, keepdims=True), v], axis=1)
            s = out[:, 1:]
            margin = bias + out[:, 0] + 0.5 * (s * s).sum(axis=1)
            g = ((1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels[rows]) * weight[rows]).astype("f4")
            seen_bias += float(g.sum()) ** 2
            bias -= rate * float(g.sum()) / seen_bias**0.5
            to = x.T @ np.concatenate([g[:, None], g[:, None] * s], axis=1)
            grad = np.concatenate([to[:, :1], to[:, 1:] - to[:, :1] * v + l2 * len(rows) * v], axis=1)
            seen[u] += grad * grad
            step = np.concatenate([[rate], np.full(FACTORS, rate * SLOWER)]) / np.sqrt(seen[u])
            p = p - step * grad
            p[:, 0] = np.sign(p[:, 0]) * np.maximum(np.abs(p[:, 0]) - step[:, 0] * l1 * len(rows), 0)
            params[u] = p
        now = made()
        hit = now.probability(*tests)
        loss = -float(np.sum(weight[aside] * np.log(np.where(labels[aside] > 0, hit, 1 - hit) + 1e-12)))
        idle = 0 if loss < least_loss else idle + 1
        if not idle:
            best, least_loss = now, loss
        if turn >= FIRST and idle >= PATIENCE:
            break
    return best


def _terms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A text's distinct buckets in order, as 32-bit numbers."""
    for x in batches:
        made = [np.sort(np.fromiter({b for w in set(_TERM.findall(t)) for b in term_buckets(w)}, "<i4")).tobytes() for t in x["body"]]
        yield pd.DataFrame({"label": x["label"], "digest": x["digest"], "terms": made})


def learn_toxicity(docs: DataFrame, labels: DataFrame, train: Column, sample: int = SAMPLE, term_bytes: int = TERM_BYTES, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> FactorizationMachine:
    """A machine from the labelled rows where ``train`` (over ``labels``) holds and label and text are not null.

    At most ``sample`` documents of each class are read, drawn by a digest of the id, then of id and text, and weighted to
    stand for their class; an id that is labelled repeatedly counts once, as toxic if any of its labels says so, and so do
    rows that repeat id and text. The driver gets the terms of the sample, four bytes each, in the order of the draw until
    a class has ``term_bytes``. Without labels every score is one half.
    """
    spark = docs.sparkSession
    marked = labels.filter(train & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max((F.col(label_col) > 0).cast("int")).alias("label"))
    marked = stored(marked, "toxic-labels")
    sizes = {r["label"]: r["count"] for r in marked.groupBy("label").count().collect()}  # two rows
    share = {k: min(1.0, sample / n) for k, n in sizes.items()}
    part = F.when(F.col("label") == 1, F.lit(share.get(1, 1.0))).otherwise(F.lit(share.get(0, 1.0)))
    chosen = stored(marked.filter(F.pmod(F.xxhash64("id", F.lit("toxic")), F.lit(1_000_000)) < part * 1_000_000), "toxic-chosen")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("text IS NOT NULL")
    rows = texts.join(small(chosen, chosen.count()), "id").select("label", body("text").alias("body"), F.xxhash64("id", "text").alias("digest"))
    with small_batches(spark):
        rows = stored(rows.mapInPandas(_terms, "label int, digest long, terms binary").dropDuplicates(["label", "digest"]), "toxic-terms")
    first = lambda *by: F.row_number().over(Window.partitionBy("label", *by).orderBy("digest"))
    drawn = rows.select("label", "digest", F.length("terms").alias("bytes"), F.pmod("digest", F.lit(16)).alias("cell"))
    drawn = drawn.withColumn("nth", first("cell")).filter(F.col("nth") <= sample).withColumn("nth", first()).filter(F.col("nth") <= sample)
    so_far = F.sum("bytes").over(Window.partitionBy("label").orderBy("digest").rowsBetween(Window.unboundedPreceding, 0))
    drawn = stored(drawn.withColumn("so_far", so_far).filter(F.col("so_far") <= term_bytes).select("label", "digest"), "toxic-drawn")
    found = rows.join(small(drawn, drawn.count()), ["label", "digest"]).select("label", "terms").toPandas()  # bounded by rows and bytes
    discard(marked, chosen, rows, drawn)
    found = found.sort_values(["terms", "label"])  # the same machine whatever order the rows come in
    y = found["label"].to_numpy(dtype=int)
    each = {k: sizes[k] / n for k, n in zip(*np.unique(y, return_counts=True))}
    return fit_machine([np.frombuffer(k, "<i4") for k in found["terms"]], y.astype(float), np.array([each[k] for k in y], float))


class _Places(dict):
    """Places of a word's buckets among those with parameters."""

    def __init__(self, at: dict[int, int]) -> None:
        self.at = at

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) > CACHE:
            self.clear()
        found = self[word] = tuple(self.at[b] for b in term_buckets(word) if b in self.at)
        return found


def _score(machine: FactorizationMachine) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        places = _Places({int(b): i for i, b in enumerate(machine.buckets)})
        for x in batches:
            found = [set(chain.from_iterable(map(places.__getitem__, set(_TERM.findall(text))))) for text in x["body"]]
            size = [len(f) for f in found]
            at = np.fromiter(chain.from_iterable(found), "i8", sum(size))
            yield pd.DataFrame({"id": x["id"], "score": machine.probability(np.repeat(np.arange(len(x)), size), at, len(x))})

    return run


def score_toxicity(docs: DataFrame, machine: FactorizationMachine, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, score, predicted. Null and empty texts have no term: the score of the bias alone. Ids
    may be null or repeat; other columns are not read; an empty table gives an empty result."""
    kind = docs.schema[id_col].dataType.simpleString()
    with small_batches(docs.sparkSession):
        found = stored(docs.select(F.col(id_col).cast("string").alias("id"), body(text_col).alias("body")).mapInPandas(_score(machine), "id string, score double"), "toxic-scores")
    return found.select(F.col("id").cast(kind).alias(id_col), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    machine = learn_toxicity(docs, table(spark, sf_dir, "labels"), ~held_out("doc_id", 4, 2))
    return score_toxicity(docs, machine).select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "score", "predicted")


SQL: dict[str, str] = {}

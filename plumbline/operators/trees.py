"""Regression trees over histograms: each level of a tree's nodes is one aggregation."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator, Mapping, Sequence
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from plumbline.operators.quantiles import exact_quantiles
from plumbline.session import ship
from plumbline.staging import discard, stored

#: Bins of a feature; the first is for nulls. Fixed values of the ranker: rounds, depth, least rows of a leaf, penalty, step.
BINS, ROUNDS, DEPTH, LEAST, PENALTY, STEP = 64, 200, 6, 200, 1.0, 0.1
QUANTILES = (0.2, 0.8)
#: Rows of a task, fewest and most on average; histograms that meet in a task; rounds after which what is left is stored, so that
#: plans stay short.
FEW, MANY, MEET, STORE = 50_000, 1_000_000, 512, 20


@dataclass
class Tree:
    """Splits by node (0 is the root, 2 k + 1 and 2 k + 2 are the children of k): feature and the last bin that goes left."""

    splits: dict[int, tuple[int, int]] = field(default_factory=dict)
    values: dict[int, float] = field(default_factory=dict)

    def node(self, bins: Sequence[Column]) -> Column:
        """The leaf of a row. An expression of as many branches as there are splits."""

        def at(k: int) -> Column:
            if k not in self.splits:
                return F.lit(k)
            f, t = self.splits[k]
            return F.when(bins[f] <= t, at(2 * k + 1)).otherwise(at(2 * k + 2))

        return at(0)

    def nodes(self, bins: Sequence[np.ndarray]) -> np.ndarray:
        """``node`` of many rows at once, a level a step."""
        codes, size = np.asarray(bins), 2 * max(self.splits, default=0) + 3
        n, child, start, last = codes.shape[1], np.arange(size), np.zeros(size, int), np.full(size, np.iinfo(codes.dtype).max, codes.dtype)
        for k, (f, t) in self.splits.items():
            child[k], start[k], last[k] = 2 * k + 1, f * n, t
        flat, rows, out = codes.ravel(), np.arange(n), np.zeros(n, int)
        for _ in range((size // 2).bit_length() if self.splits else 0):  # a leaf's rows stay
            out = child.take(out) + (flat.take(start.take(out) + rows) > last.take(out))
        return out

    def told(self, bins: Sequence[np.ndarray]) -> np.ndarray:
        """The value of each row's leaf."""
        values = np.full(max([*self.values, *self.splits]) * 2 + 3, np.nan)
        values[list(self.values)] = list(self.values.values())
        return values[self.nodes(bins)]


@dataclass
class Ranker:
    """Boosted trees of the mean, and each leaf's quantiles of what they leave in the last tree."""

    features: list[str]
    edges: list[list[float]]
    start: float
    step: float
    trees: list[Tree]
    quantiles: dict[int, list[float]]
    n_trials: int

    def means(self, bins: Sequence[np.ndarray]) -> np.ndarray:
        out = np.full(len(bins[0]), self.start)
        for t in self.trees:
            out = out + self.step * t.told(bins)
        return out

    def _found(self, columns: Sequence[str]) -> Column:
        """Mean and leaf of the last tree of a row's features."""

        def found(*xs: pd.Series) -> pd.DataFrame:
            bins = _codes(xs, self.edges)
            return pd.DataFrame({"mean": self.means(bins), "leaf": self.trees[-1].nodes(bins).astype("i4")})

        return F.pandas_udf(found, "mean double, leaf int")(*[F.col(c).cast("double") for c in columns])

    def predict(self, df: DataFrame, name: str = "ml_pred") -> DataFrame:
        """Adds ``name``, ``name``_lo and ``name``_hi; the ends never lie on the wrong side of the point."""
        ship(df.sparkSession)
        x = df.withColumn("_t", self._found(self.features))
        x = x.withColumns({name: F.col("_t.mean"), "_leaf": F.col("_t.leaf")})
        ends = F.create_map(*[y for k, q in self.quantiles.items() for y in (F.lit(k), F.array(*map(F.lit, q)))])
        x = x.withColumn("_q", F.element_at(ends, F.col("_leaf")))
        low, high = (F.col(name) + F.col("_q")[k] for k in range(2))
        return x.withColumns({f"{name}_lo": F.least(low, name), f"{name}_hi": F.greatest(high, name)}).drop("_t", "_leaf", "_q")

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame([(json.dumps(asdict(self)),)], "model string").coalesce(1).write.mode("overwrite").text(path)  # one row

    @staticmethod
    def load(spark: SparkSession, path: str) -> Ranker:
        d = json.loads(spark.read.text(path).first()[0])
        numbers = lambda m: {int(k): v for k, v in m.items()}
        trees = [Tree({k: tuple(v) for k, v in numbers(t["splits"]).items()}, numbers(t["values"])) for t in d["trees"]]
        return Ranker(**d | {"trees": trees, "quantiles": numbers(d["quantiles"])})


def _bins(x: pd.Series, edges: Sequence[float]) -> np.ndarray:
    """0 for null and what is no number, else 1 and the number of edges below the value."""
    v = x.to_numpy("f8", na_value=np.nan)
    return np.where(np.isnan(v), 0, 1 + np.searchsorted(np.asarray(edges, "f8"), v, side="left"))


def _codes(xs: Sequence[pd.Series], edges: Sequence[Sequence[float]]) -> np.ndarray:
    """Bins by feature and row, in bytes."""
    return np.stack([_bins(x, e) for x, e in zip(xs, edges)]).astype("u1")


def best_splits(hist: Mapping[int, np.ndarray], least: int, penalty: float) -> dict[int, tuple[int, int]]:
    """Of each node's histogram (feature, bin, (count, sum)) the split that lowers the squared error most; none that leaves a side
    fewer rows than ``least``, or that lowers it by nothing. Ties go to the first feature and bin."""
    out = {}
    for node, h in hist.items():
        left = h.cumsum(axis=1)[:, :-1]
        total = h.sum(axis=1)[0]
        right = total - left
        score = lambda s: s[..., 1] ** 2 / (s[..., 0] + penalty)
        gain = np.where((left[..., 0] >= least) & (right[..., 0] >= least), score(left) + score(right) - score(total), -np.inf)
        f, b = np.unravel_index(gain.argmax(), gain.shape)
        if gain[f, b] > 1e-12:
            out[node] = (int(f), int(b))
    return out


def _blocks(table: DataFrame, n_features: int, n: int) -> RDD:
    """A task's rows as one pair of arrays: bins by feature and row, and what the trees so far leave of each label."""

    def one(held: Iterable) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        pairs = [(np.frombuffer(r["codes"], "u1").reshape(n_features, -1), np.frombuffer(r["left"])) for r in held]
        if pairs:
            yield np.concatenate([c for c, _ in pairs], 1), np.concatenate([x for _, x in pairs])

    held = table.rdd
    cores = held.context.defaultParallelism
    tasks = min(-(-n // FEW), cores * -(-n // (cores * MANY)))  # whole waves
    return held.coalesce(tasks).mapPartitions(one)


def _left(blocks: RDD, tree: Tree, step: float) -> RDD:
    """The blocks with what ``tree`` leaves, too."""
    return blocks.map(lambda b: (b[0], b[1] - step * tree.told(b[0])))


def _grown(blocks: RDD, tree: Tree, nodes: Sequence[int], n_features: int, least: int, penalty: float) -> dict[int, tuple]:
    """Of each node its best split or None, and count and sum of what is left in each of the split's sides (without one, in the node).
    A task counts its rows by node, feature and bin in numpy; a node's histograms meet in one task, so that a row a node reaches the driver."""
    width = BINS + 1
    place = np.full(2 * max([*nodes, *tree.splits]) + 3, -1)
    place[list(nodes)] = np.arange(len(nodes))

    def counted(held: Iterable) -> Iterator[tuple[int, np.ndarray]]:
        for codes, left in held:
            at = place[tree.nodes(codes)]
            here = at >= 0
            if not here.all():
                at, left, codes = at[here], left[here], codes[:, here]
            size, cells = len(nodes) * width, at * width
            sums = [np.stack([np.bincount(cell, minlength=size), np.bincount(cell, left, size)], 1).reshape(-1, width, 2) for cell in (cells + c for c in codes)]
            for k, h in zip(nodes, np.stack(sums, 1)):
                if h[0, :, 0].any():
                    yield k, h

    def split(h: np.ndarray) -> tuple:
        best = best_splits({0: h}, least, penalty).get(0)
        sides = (h[0],) if best is None else (h[best[0], : best[1] + 1], h[best[0], best[1] + 1 :])
        return best, [tuple(map(float, x.sum(axis=0))) for x in sides]

    parts = min(len(nodes), -(-len(nodes) * blocks.getNumPartitions() // MEET))
    return dict(blocks.mapPartitions(counted).reduceByKey(np.add, parts).mapValues(split).collect())  # a row a node


def fit_ranker(
    df: DataFrame, features: Sequence[str], label: str, n_trials: int, rounds: int = ROUNDS, depth: int = DEPTH, least: int = LEAST, penalty: float = PENALTY, step: float = STEP, edges: Sequence[Sequence[float]] | None = None
) -> Ranker | None:
    """Boosted trees of ``label``, or None where there are fewer than 2 ``least`` rows (least squares then stand in).

    Rows need a label and some feature; a null feature is a bin of its own. Edges of the bins are approximate quantiles unless
    they are given. Each level of a tree is one aggregation by node, with sums by feature and bin in each task before the shuffle,
    so that rows are never gathered; the driver sees a row a node. Tasks keep a byte a feature and what the trees so far leave of
    the label, so that a level walks one tree however many there are. The quantiles are exact, of the residuals by the last
    tree's leaf.
    """
    if not 1 <= n_trials <= 50:
        raise ValueError("n_trials lies between 1 and 50")
    if not 0 < step <= 1 or rounds < 1 or depth < 1 or least < 1:
        raise ValueError("step lies in (0, 1]; rounds, depth and least rows are positive")
    some = F.coalesce(*[F.col(c).cast("double") for c in features]).isNotNull()
    xs = [f"x{k}" for k in range(len(features))]
    rows = df.filter(F.col(label).isNotNull() & some).select(*[F.col(c).cast("double").alias(x) for x, c in zip(xs, features)], F.col(label).cast("double").alias("y"))
    ship(df.sparkSession)
    rows = stored(rows, "ranker-rows")
    n, start = rows.agg(F.count(F.lit(1)), F.avg("y")).first()
    if n < 2 * least:
        return None
    if edges is None:
        marks = [i / BINS for i in range(1, BINS)]
        found = rows.agg(*[F.percentile_approx(x, marks, 10_000).alias(x) for x in xs]).first()
        edges = [sorted(set(found[x] or ())) for x in xs]
    if max(map(len, edges)) >= BINS:
        raise ValueError(f"a feature has fewer than {BINS} edges")
    out = Ranker(list(features), [list(map(float, e)) for e in edges], float(start), step, [], {}, n_trials)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in filter(len, batches):
            left = x["y"].to_numpy(zero_copy_only=False) - out.start
            codes = _codes([x[c].to_pandas() for c in xs], out.edges)
            yield pa.RecordBatch.from_pydict({"codes": [codes.tobytes()], "left": [left.tobytes()]}, schema=pa.schema({"codes": pa.binary(), "left": pa.binary()}))

    kind, spark, width = "codes binary, left binary", df.sparkSession, len(features)
    table, old = stored(rows.mapInArrow(packed, kind), "ranker-left"), None
    blocks = _blocks(table, width, n).persist(StorageLevel.MEMORY_AND_DISK)
    for k in range(rounds):
        tree, open_nodes = Tree(), [0]
        for _ in range(depth):
            found = _grown(blocks, tree, open_nodes, width, least, penalty)
            if old is not None:
                old = old.unpersist() and None  # the new blocks are held by now
            for node, (best, sides) in found.items():
                tree.values.pop(node, None)
                tree.splits |= {node: best} if best else {}
                tree.values |= {c: total / (m + penalty) for c, (m, total) in zip((2 * node + 1, 2 * node + 2) if best else (node,), sides)}
            open_nodes = sorted(c for node, (best, _) in found.items() if best for c in (2 * node + 1, 2 * node + 2))
            if not open_nodes:
                break
        out.trees.append(tree)
        if not tree.splits:
            break
        old, blocks = blocks, _left(blocks, tree, step).persist(StorageLevel.MEMORY_AND_DISK)
        if (k + 1) % STORE == 0 and k + 1 < rounds:
            done, table = table, stored(spark.createDataFrame(blocks.map(lambda b: (b[0].tobytes(), b[1].tobytes())), kind), "ranker-left")
            blocks.unpersist()
            old.unpersist()
            discard(done)
            old, blocks = None, _blocks(table, width, n).persist(StorageLevel.MEMORY_AND_DISK)
    for held in filter(None, (old, blocks)):
        held.unpersist()
    discard(table)
    left = rows.select(out._found(xs).alias("_t"), "y").select("_t.leaf", (F.col("y") - F.col("_t.mean")).alias("left"))
    out.quantiles = {r["leaf"]: list(r["quantiles"]) for r in exact_quantiles(left, "left", QUANTILES, ["leaf"]).collect()}  # a row a leaf
    return out

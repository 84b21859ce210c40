"""An inverted-list index of vectors: rows lie in the partition of the centroid that is nearest to them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, DataFrameWriter, SparkSession, Window, functions as F

from plumbline.operators.retrieval import DIGITS, _best
from plumbline.session import ship
from plumbline.staging import stored

#: Vectors that centroids are fitted on, at most, and steps of their fit; rows of a list that a task takes at once.
SAMPLE, STEPS, TILE, BLOCK = 20_000, 12, 2048, 256
#: Products of vectors and centroids that are held at once.
PRODUCTS = 1 << 22


def _units(rows: list | np.ndarray) -> np.ndarray:
    x = np.asarray([np.asarray(r, "f8") for r in rows])
    norm = np.sqrt((x * x).sum(axis=1))
    return x / np.where((norm > 0) & np.isfinite(norm), norm, 1.0)[:, None]


def _parts(x: np.ndarray, lists: int) -> list[np.ndarray]:
    """Rows whose products with all centroids are ``PRODUCTS`` numbers at most."""
    size = max(1, PRODUCTS // max(1, lists))
    return [x[i : i + size] for i in range(0, max(1, len(x)), size)]


def fit_centroids(rows: DataFrame, vector_col: str, lists: int, sample: int = SAMPLE, seed: int = 1) -> np.ndarray:
    """``lists`` unit vectors by spherical k-means on ``sample`` rows at most, drawn by a digest of the vector; empty lists keep
    their centroid. Only the sample reaches the driver: its rows times the dimension bound the bytes. Vectors of another length
    than most, or with nulls or numbers that are not finite, are no part of it; fewer different vectors make fewer lists."""
    v = F.transform(vector_col, lambda x: x.cast("double"))
    good = (F.size(vector_col) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    good_rows, digest = rows.filter(good).select(v.alias("v")), F.xxhash64(F.col("v").cast("string"), F.lit(seed))
    n = good_rows.agg(F.approx_count_distinct(digest)).first()[0]
    if n > 1.25 * sample:  # else each task would send so many rows to the driver: those whose digest is low are enough and few more
        good_rows = good_rows.filter(digest < int(2**64 * (1.25 * sample / n)) - 2**63)
    taken = good_rows.distinct().orderBy(digest, F.col("v")).limit(sample)
    found = [r["v"] for r in taken.collect()]
    if not found:
        return np.zeros((0, 0))
    size = np.bincount([len(v) for v in found]).argmax()
    x = _units([v for v in found if len(v) == size])
    pick = np.random.default_rng(seed).permutation(len(x))[:lists]
    centroids = x[pick]
    for _ in range(STEPS):
        own = np.concatenate([(part @ centroids.T).argmax(axis=1) for part in _parts(x, len(centroids))])
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, x)
        norm = np.sqrt((sums * sums).sum(axis=1))
        centroids = np.where(norm[:, None] > 0, sums / np.where(norm > 0, norm, 1.0)[:, None], centroids)
    return centroids


def _nearest(centroids: np.ndarray, n: int) -> Callable:
    def lists(vectors: pd.Series) -> pd.Series:
        out: list[list[int]] = [[-1]] * len(vectors)  # a list of its own for what has no place among the centroids
        good = [i for i, v in enumerate(vectors) if v is not None and len(centroids) and len(v) == centroids.shape[1]]
        for part in _parts(np.array(good, int), len(centroids)):
            near = np.nan_to_num(np.array([np.asarray(vectors.iloc[i], "f8") for i in part]).reshape(len(part), -1) @ centroids.T, nan=-2.0) if len(part) else np.zeros((0, 1))
            order = near.argmax(axis=1)[:, None] if n == 1 else np.argsort(-near, axis=1, kind="stable")[:, :n]
            for i, numbers in zip(part, order.tolist()):
                out[i] = numbers
        return pd.Series(out)

    return lists


def near_lists(centroids: np.ndarray, vector: Column, n: int = 1) -> Column:
    """The numbers of the ``n`` nearest centroids, nearest first; [-1] for a vector of another length or a null one."""
    return F.pandas_udf(_nearest(centroids, n), "array<int>")(vector)


class VectorIndex:
    """A folder: ``centroids`` (a row a list) and ``rows`` partitioned by list, with all columns of the table.

    Ids are not null. Rows of a list that has lost all are replaced by a mark, a row without an id, which readers leave out.
    """

    def __init__(self, spark: SparkSession, path: str, id_col: str = "chunk_id", doc_col: str = "doc_id", vector_col: str = "embedding"):
        self.spark, self.path, self.id, self.doc, self.vector = spark, path.rstrip("/"), id_col, doc_col, vector_col
        ship(spark)

    def build(self, rows: DataFrame, lists: int, sample: int = SAMPLE) -> VectorIndex:
        """All rows; centroids are fitted on a bounded sample of them."""
        c = fit_centroids(rows, self.vector, lists, sample)
        table = self.spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(c)], "list int, centroid array<double>")  # a row a list
        table.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/centroids")
        placed = self._placed(rows.filter(F.col(self.id).isNotNull()), c)
        self._by_list(placed.unionByName(self._marks(placed, [-1]))).mode("overwrite").parquet(f"{self.path}/rows")
        return self

    @staticmethod
    def _by_list(rows: DataFrame) -> DataFrameWriter:
        """Rows of a list meet before they are written: a file a list, more only where one is large, whatever the number of tasks. What
        a write reports of its files, and what each read lists, reaches the driver."""
        return rows.hint("rebalance", "list").write.partitionBy("list")

    def centroids(self) -> np.ndarray:
        found = self.spark.read.parquet(f"{self.path}/centroids").orderBy("list").collect()
        return np.array([r["centroid"] for r in found]) if found else np.zeros((0, 0))

    def _placed(self, rows: DataFrame, c: np.ndarray) -> DataFrame:
        return rows.withColumn("list", F.get(near_lists(c, F.col(self.vector)), F.lit(0)))

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows").filter(F.col(self.id).isNotNull())

    def count(self) -> int:
        return self.rows().count()

    def list_by_doc(self, doc_id: object) -> DataFrame:
        return self.rows().filter(F.col(self.doc) == doc_id).drop("list")

    def upsert(self, new: DataFrame) -> None:
        """Rows of ``new`` replace those of the same id, wherever these lie; of repeated ids in ``new`` one stays. Only lists that
        lose or gain a row are written."""
        one = Window.partitionBy(self.id).orderBy(F.hash(*[c for c in new.columns if c != self.id]))
        new = new.filter(F.col(self.id).isNotNull()).withColumn("_n", F.row_number().over(one)).filter("_n = 1").drop("_n")
        self._write(self._placed(new, self.centroids()), new.select(self.id))

    def delete_by_doc(self, docs: DataFrame) -> int:
        """Rows of the documents of ``docs`` go; how many went."""
        gone = self.rows().join(docs.select(self.doc).distinct(), self.doc, "left_semi").select(self.id)
        n = gone.count()
        if n:
            self._write(None, gone)
        return n

    def _marks(self, like: DataFrame, lists: list[int]) -> DataFrame:
        marks = self.spark.createDataFrame([(k,) for k in lists], "list int")
        return marks.select(*[F.col("list") if f.name == "list" else F.lit(None).cast(f.dataType).alias(f.name) for f in like.schema])

    def _write(self, new: DataFrame | None, gone: DataFrame) -> None:
        old = self.rows()
        touched = old.join(gone, self.id, "left_semi").select("list")
        if new is not None:
            touched = touched.unionAll(new.select("list"))
        lists = [r["list"] for r in touched.distinct().collect()]  # numbers of lists
        stay = old.filter(F.col("list").isin(lists)).join(gone, self.id, "left_anti")
        out = stay if new is None else stay.unionByName(new.select(*stay.columns))
        self._by_list(out.unionByName(self._marks(out, lists))).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(f"{self.path}/rows")

    def probes_for(self, k: int, recall: float = 0.93, sample: int = 200) -> int:
        """The least number of lists that a search must look into to find this part of the ``k`` best, as measured on ``sample`` rows at
        most (drawn by a digest of their ids) asked against all lists; a little more than the recall that is wanted leaves room
        for the sample's chance."""
        c = self.centroids()
        if not len(c):
            return 1
        q = self.rows().filter(F.size(self.vector) == c.shape[1]).orderBy(F.xxhash64(self.id), self.id).limit(sample)
        q = stored(q.select(F.col(self.id).cast("long").alias("query_id"), F.col(self.vector).alias("query")), "index-sample")
        found = self.search(q, k, len(c)).join(self.rows().select(F.col(self.id), "list"), self.id)
        place = F.transform("query", lambda x: x.cast("double"))
        order = q.select("query_id", F.posexplode(near_lists(c, place, len(c))).alias("place", "list"))
        n = {r["place"]: r["n"] for r in found.join(order, ["query_id", "list"]).groupBy("place").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a list
        total, run = sum(n.values()), 0
        for p in range(len(c)):
            run += n.get(p, 0)
            if run >= recall * total:
                return p + 1
        return len(c)

    def search(self, queries: DataFrame, k: int, probes: int, where: Column | None = None, query_id: str = "query_id", query_vector: str = "query") -> DataFrame:
        """query_id, id, score, nth: the ``k`` best by cosine of the rows in each query's ``probes`` nearest lists that pass
        ``where``; scores and ties as those of ``vector_top_each``. With as many probes as lists this is the exact answer for
        vectors of the centroids' length.

        Only partitions of the lists that some query asks for are read, and the filter stands below the scores. Queries of a list
        meet its rows in blocks and tiles, so that a list with very many rows is spread over tasks; each pair leaves k rows a query.
        Neither side is broadcast: queries are many and would all pass through the driver.
        """
        c = self.centroids()
        asked = queries.select(F.col(query_id).cast("long").alias("query"), F.transform(query_vector, lambda x: x.cast("double")).alias("v"))
        asked = asked.withColumn("list", F.explode(near_lists(c, F.col("v"), probes)))
        lists = [r["list"] for r in asked.select("list").distinct().collect()]  # numbers of lists
        rows = self.rows().filter(F.col("list").isin(lists))
        rows = rows if where is None else rows.filter(where)
        rows = rows.select("list", F.col(self.id).cast("long").alias("id"), F.transform(self.vector, lambda x: x.cast("double")).alias("v"))

        def packed(df: DataFrame, size: int, ids: str, vectors: str) -> DataFrame:
            n = df.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / size).alias("n"))
            cell = df.join(F.broadcast(n), "list").withColumn("cell", F.pmod(F.xxhash64(df.columns[0] if df.columns[0] != "list" else "id"), "n"))  # a row a list
            item = F.struct(F.col("id" if "id" in df.columns else "query").alias("id"), "v")
            return cell.groupBy("list", "cell").agg(F.collect_list(item).alias("x")).select("list", F.col("x.id").alias(ids), F.col("x.v").alias(vectors))

        pairs = packed(rows, TILE, "ids", "v").join(packed(asked, BLOCK, "queries", "q").hint("merge"), "list").drop("list")
        found = pairs.mapInPandas(_best(k), "query long, id long, score double")
        best = Window.partitionBy("query").orderBy(F.col("score").desc(), "id")
        found = found.withColumn("nth", F.row_number().over(best)).filter(F.col("nth") <= k)
        return found.select(F.col("query").alias(query_id), F.col("id").alias(self.id), F.round("score", DIGITS).alias("score"), "nth")


def matches(filters: dict) -> Column | None:
    """A filter of metadata: a value, a list of values, or bounds by {"$lte": ..., "$gte": ..., "$in": ...}; a value of None
    asks for nothing, a null in a row passes no filter. Dates bound whole days."""
    out: Column | None = None
    for name, wanted in filters.items():
        tests = []
        if isinstance(wanted, dict):
            for op, bound in wanted.items():
                c = F.col(name)
                if hasattr(bound, "year") and not hasattr(bound, "hour"):
                    c = F.to_date(c)
                tests.append(c <= F.lit(bound) if op == "$lte" else c >= F.lit(bound) if op == "$gte" else c.isin(list(bound)))
        elif isinstance(wanted, (list, tuple, set)):
            tests.append(F.col(name).isin(list(wanted)))
        elif wanted is not None:
            tests.append(F.col(name) == wanted)
        for t in tests:
            out = t if out is None else out & t
    return out

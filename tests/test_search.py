"""Searches for one query, and small functions, on known answers."""

import numpy as np
from pyspark.sql import functions as F

from plumbline.functions import expressions as X
from plumbline.operators import calendar as C, retrieval as R


def test_one_query_after_its_filter(spark):
    """Against all cosines in numpy; the filter stands before the ranking, a zero vector scores 0, ties go by id."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 6))
    x[7], x[9], x[11] = 0, x[8], x[8]
    chunks = spark.createDataFrame([(i, x[i].tolist(), "a" if i % 3 else "b") for i in range(300)], "id long, v array<double>, kind string")
    q = x[8] + 0.01
    score = np.array([0 if not v.any() else v @ q / np.linalg.norm(v) / np.linalg.norm(q) for v in x])
    for kind in (None, "a", "b", "none"):
        ids = [i for i in range(300) if kind is None or kind == ("a" if i % 3 else "b")]
        want = sorted(ids, key=lambda i: (-round(score[i], 12), i))[:10]
        found = R.vector_top(chunks, q.tolist(), 10, "id", "v", None if kind is None else F.col("kind") == kind).collect()
        assert [r.id for r in found] == want and np.allclose([r.score for r in found], score[want])


def test_fused_ranks(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2)], "id string, nth int")
    b = spark.createDataFrame([("y", 1), ("z", 2)], "id string, nth int")
    found = [(r.id, round(r.score, 9), r.n_lists) for r in R.fuse([a, b], "id", 2).collect()]
    assert found == [("y", round(1 / 62 + 1 / 61, 9), 2), ("x", round(1 / 61, 9), 1)]
    assert [r.id for r in R.fuse([a, b.limit(0)], "id", 5).collect()] == ["x", "y"]


def test_days_of_rebalances_and_costs(spark):
    days = spark.createDataFrame([(d,) for d in ("2024-01-02", "2024-01-04", "2024-01-09", "2024-02-01", "2024-02-29")], "d string").select(F.col("d").cast("date").alias("session"))
    first = lambda every: [str(r[0]) for r in C.rebalance_days(C.sessions(days, "session"), every).select("session").orderBy("session").collect()]
    assert first("month") == ["2024-01-02", "2024-02-01"]
    assert first("week") == ["2024-01-02", "2024-01-09", "2024-02-01", "2024-02-29"]
    assert spark.range(1).select(X.round_trip_bps(5.0, F.lit(10.0))).first()[0] == 30.0

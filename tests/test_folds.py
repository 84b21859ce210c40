"""Weights that move under a cap, and distances of samples, against plain loops."""

import bisect
import datetime as dt
import random

from pyspark.sql import functions as F

from plumbline.functions.expressions import bound
from plumbline.operators import backtest, models


def test_bound_values(spark):
    """Nested, and null where the value is."""
    x = spark.createDataFrame([(2,), (None,)], "v int")
    y = bound(F.col("v") + 1, lambda a: bound(a * a, lambda b: F.struct((b + a).alias("s"), F.transform(F.array(a, b), lambda e: e * b).alias("t"))))
    assert [(r.y.s, r.y.t) for r in x.select(y.alias("y")).collect()] == [(12, [27, 81]), (None, [None, None])]


def plain_weights(days, cap):
    held, out = {}, {}
    for day, want in sorted(days.items()):
        names = set(held) | set(want)
        moved = sum(abs(want.get(t, 0.0) - held.get(t, 0.0)) for t in names) / 2
        part = min(1.0, cap / moved) if moved > 0 else 1.0
        held = {t: w for t in names if (w := held.get(t, 0.0) + part * (want.get(t, 0.0) - held.get(t, 0.0))) > 1e-12}
        out |= {(day, t): (w, moved * part) for t, w in held.items()}
    return out


def test_weights_move_as_a_loop_says(spark):
    """Portfolios with many names, one that never changes, and one whose cap never binds."""
    r = random.Random(9)
    day = lambda i: dt.date(2024, 1, 1) + dt.timedelta(7 * i)
    books = {
        "many": {day(i): {t: 0.1 for t in r.sample(range(200), 10)} for i in range(30)},
        "still": {day(i): {1: 0.5, 2: 0.5} for i in range(4)},
        "slow": {day(i): {1: 0.5 - 0.01 * i, 2: 0.5 + 0.01 * i} for i in range(4)},
    }
    rows = [(b, d, t, w) for b, days in books.items() for d, want in days.items() for t, w in want.items()]
    target = spark.createDataFrame(rows, "book string, as_of date, ticker long, target double")
    for cap in (0.3, 1.0):
        found = {(x.book, x.as_of, x.ticker): (x.weight, x.turnover) for x in backtest.turnover_capped(target, cap, "book").collect()}
        plain = {(b, *k): v for b, days in books.items() for k, v in plain_weights(days, cap).items()}
        assert found.keys() == plain.keys()
        assert all(abs(found[k][0] - w) < 1e-9 and abs(found[k][1] - m) < 1e-9 for k, (w, m) in plain.items())
    assert backtest.turnover_capped(target.limit(0), 0.3, "book").count() == 0


def test_distances_of_samples(spark):
    """Ties within and between samples, nulls, one sample alone, no rows."""
    r = random.Random(3)
    rows = [(float(r.randrange(60)) if r.random() < 0.9 else None, r.random() < 0.4, r.gauss(0, 1)) for _ in range(3000)]
    rows = [(v, f, x + 0.2 * f) for v, f, x in rows]
    df = spark.createDataFrame(rows, "v double, first boolean, x double")
    for k, c in ((0, "v"), (2, "x")):
        a, b = (sorted(row[k] for row in rows if row[1] is f and row[k] is not None) for f in (True, False))
        want = max(abs(bisect.bisect_right(a, v) / len(a) - bisect.bisect_right(b, v) / len(b)) for v in a + b)
        got = models.ks_distance(df, c, "first").first()
        assert abs(got.ks - want) < 1e-12 and (got.n_first, got.n_second) == (len(a), len(b))
        assert abs(models.drifted(df, [c], "first").first().p_value - models.ks_p_value(want, len(a), len(b))) < 1e-9
    assert models.ks_distance(df.filter("first"), "x", "first").first().ks is None
    alone = models.drifted(df.limit(0), ["x"], "first").first()
    assert (alone.ks, alone.drifted) == (None, False)

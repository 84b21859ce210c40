"""Queries of models: volatilities, rankers, drift and proposed weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.operators import calendar as C, checks, models as M, outcomes as O, panel as P, quantiles as Q, scoring as S, trees
from plumbline.plans.adapter import dense, prices, query, r6, table
from plumbline.plans.market import COLS, FEATURES, features
from plumbline.staging import stored

_Y = "label"
_XS = ("ret_1w", "vol_13w")


def _labelled(spark: SparkSession, sf: str) -> DataFrame:
    return O.forward_returns(features(dense(spark, sf)), 4)


_LABELS = f"WITH {FEATURES}, l AS (SELECT *, CASE WHEN lead(open, 1) OVER w > 0 THEN lead(open, 5) OVER w / lead(open, 1) OVER w - 1 END AS label FROM features WINDOW w AS (PARTITION BY ticker ORDER BY session_idx))"


@query("ranker_predictions", _LABELS + """, r AS (SELECT * FROM l WHERE ret_1w IS NOT NULL AND label IS NOT NULL), f AS (SELECT regr_slope(label, ret_1w) AS b, regr_intercept(label, ret_1w) AS a FROM r), q AS (SELECT quantile_cont(label - a - b * ret_1w, 0.2) AS lo, quantile_cont(label - a - b * ret_1w, 0.8) AS hi FROM r, f)
  SELECT ticker, session, round(a + b * ret_1w, 5) AS pred, round(least(lo + a + b * ret_1w, a + b * ret_1w), 5) AS pred_lo, round(greatest(hi + a + b * ret_1w, a + b * ret_1w), 5) AS pred_hi FROM r, f, q""")
def ranker_predictions(spark: SparkSession, sf: str) -> DataFrame:
    x = _labelled(spark, sf).dropna(subset=["ret_1w", _Y])
    beta, ends = M.fit_ranker(x, ["ret_1w"], _Y, n_trials=1)
    p = x.select("ticker", "session", *M.with_interval(beta, ends))
    return p.select("ticker", "session", *[F.round(c, 5).alias(c) for c in ("pred", "pred_lo", "pred_hi")])


def walk_sql(xs: tuple[str, str], horizon: int, embargo: int, test: int, least: int, splits: int = 4) -> str:
    """CTEs up to ``ics`` (split_id, session, n, ic)."""
    gap = horizon + embargo
    a, b = xs
    sums = {"s00": "count(*)", "s01": f"sum({a})", "s02": f"sum({b})", "s11": f"sum({a} * {a})", "s12": f"sum({a} * {b})", "s22": f"sum({b} * {b})", "t0": "sum(label)", "t1": f"sum({a} * label)", "t2": f"sum({b} * label)"}
    m = ["(s00 + 1e-6)", "s01", "s02", "s01", "(s11 + 1e-6)", "s12", "s02", "s12", "(s22 + 1e-6)"]
    det = lambda c: f"({c[0]} * ({c[4]} * {c[8]} - {c[5]} * {c[7]}) - {c[1]} * ({c[3]} * {c[8]} - {c[5]} * {c[6]}) + {c[2]} * ({c[3]} * {c[7]} - {c[4]} * {c[6]}))"
    beta = [f"{det([f't{i // 3}' if i % 3 == k else c for i, c in enumerate(m)])} / {det(m)} AS b{k}" for k in range(3)]
    rank = lambda c: f"rank() OVER (PARTITION BY split_id, session ORDER BY {c}) + (count(*) OVER (PARTITION BY split_id, session, {c}) - 1) / 2.0"
    return f"""{_LABELS}, nn AS (SELECT *, count(*) OVER () AS nn FROM cal), sp AS (SELECT *, nn - (back + 1) * {test} AS start FROM nn, (SELECT unnest(range({splits})) AS back)),
      ro AS (SELECT * FROM (SELECT ({splits - 1} - back)::INT AS split_id, session, CASE WHEN session_idx >= start AND session_idx < start + {test} THEN 'test' WHEN session_idx < start - {gap} THEN 'train' END AS role FROM sp WHERE start - {gap} >= {least}) WHERE role IS NOT NULL),
      rw AS (SELECT split_id, role, l.* FROM l JOIN ro USING (session) WHERE {a} IS NOT NULL AND {b} IS NOT NULL AND label IS NOT NULL), sm AS (SELECT split_id, {", ".join(f"({e})::DOUBLE AS {n}" for n, e in sums.items())} FROM rw WHERE role = 'train' GROUP BY 1), bt AS (SELECT split_id, {", ".join(beta)} FROM sm),
      sc AS (SELECT split_id, session, b0 + b1 * {a} + b2 * {b} AS score, label FROM rw JOIN bt USING (split_id) WHERE role = 'test'), rk AS (SELECT split_id, session, {rank("score")} AS ra, {rank("label")} AS rb FROM sc),
      ics AS (SELECT split_id, session, count(*) AS n, corr(ra, rb) AS ic FROM rk GROUP BY 1, 2 HAVING count(*) >= 3)"""


@query("walk_forward_ic", walk_sql(_XS, 4, 5, 20, 60) + " SELECT split_id, session, n, round(ic, 6) AS ic FROM ics")
def walk_forward_ic(spark: SparkSession, sf: str) -> DataFrame:
    """Two features; the splits of ``walk_forward_splits``."""
    splits = C.purged_splits(C.sessions(prices(spark, sf), "session"), n_splits=4, horizon=4, embargo=5, test=20, min_train=60)
    return M.walk_forward_ic(_labelled(spark, sf), splits, _XS, _Y).withColumn("ic", r6("ic"))


@query("garch_volatility")
def garch_volatility(spark: SparkSession, sf: str) -> DataFrame:
    """Orders' values in the order of their keys, by five groups: series longer than a fit needs."""
    o = table(spark, sf, "orders").select((F.col("o_custkey") % 5).alias("series"), F.col("o_orderkey").alias("t"), ((F.col("o_totalprice") % 1000) / 20000 - 0.025).alias("r"))
    return M.garch(o, "series", "t", "r")


@query("garch_update", """WITH RECURSIVE o AS (SELECT o_custkey % 5 AS series, ((o_totalprice % 1000) / 20000 - 0.025) * 100 AS r, row_number() OVER (PARTITION BY o_custkey % 5 ORDER BY o_orderkey) AS i FROM orders), v AS (SELECT series, var_samp(r) AS v FROM o GROUP BY 1),
  f AS (SELECT series, 0::BIGINT AS i, v FROM v UNION ALL SELECT f.series, o.i, 0.1::DOUBLE + 0.05::DOUBLE * o.r * o.r + 0.9::DOUBLE * f.v FROM f JOIN o ON o.series = f.series AND o.i = f.i + 1)
  SELECT series, round(arg_max(v, i), 6) AS variance FROM f GROUP BY series""")
def garch_update(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select((F.col("o_custkey") % 5).alias("series"), F.col("o_orderkey").alias("t"), ((F.col("o_totalprice") % 1000) / 20000 - 0.025).alias("r"))
    fits = o.select("series").distinct().withColumns({"alpha": F.lit(0.05), "beta": F.lit(0.9), "omega": F.lit(0.1)})
    return M.garch_variance(o, fits, "series", "t", "r").withColumn("variance", r6("variance"))


_DRIFT = ("l_extendedprice", "l_quantity", "l_discount")
_KS = """SELECT '{0}' AS feature, max(d) AS ks, max(n)::BIGINT AS n_first, max(m)::BIGINT AS n_second FROM (SELECT abs(sum(a) OVER w / sum(a) OVER () - sum(b) OVER w / sum(b) OVER ()) AS d, sum(a) OVER () AS n, sum(b) OVER () AS m
  FROM (SELECT {0} AS v, count(*) FILTER (l_linenumber % 2 = 0) AS a, count(*) FILTER (l_linenumber % 2 <> 0) AS b FROM lineitem WHERE {0} IS NOT NULL GROUP BY 1) WINDOW w AS (ORDER BY v ROWS UNBOUNDED PRECEDING))"""


@query("feature_drift", f"""WITH k AS ({' UNION ALL '.join(_KS.format(c) for c in _DRIFT)}), e AS (SELECT *, sqrt(n_first::DOUBLE * n_second / (n_first + n_second)) AS e FROM k), x AS (SELECT *, (e + 0.12 + 0.11 / e) * ks AS x FROM e),
  p AS (SELECT *, CASE WHEN x > 0.2 THEN least(greatest(list_sum(list_transform(range(1, 30), lambda i: 2 * CASE WHEN i % 2 = 1 THEN 1 ELSE -1 END * exp(-2.0::DOUBLE * i * i * x * x))), 0), 1) ELSE 1 END AS p FROM x)
  SELECT feature, round(ks, 6) AS ks, n_first, n_second, round(p, 6) AS p_value, n_first >= 20 AND n_second >= 20 AND p < 0.01 AS drifted FROM p""")
def feature_drift(spark: SparkSession, sf: str) -> DataFrame:
    x = table(spark, sf, "lineitem").select((F.col("l_linenumber") % 2 == 0).alias("first"), *_DRIFT)
    return M.drifted(x, _DRIFT, "first").withColumns({"ks": r6("ks"), "p_value": r6("p_value")})


@query("group_excess", _LABELS + " SELECT count(*) AS n, round(corr(ret_4w, label), 5) AS correlation FROM l WHERE ret_4w IS NOT NULL AND label IS NOT NULL")
def group_excess(spark: SparkSession, sf: str) -> DataFrame:
    """Scores and outcomes of one ticker and session, as weights are fitted on."""
    x = _labelled(spark, sf)
    s, o = x.select("ticker", "session", "ret_4w"), x.select("ticker", "session", _Y)
    return s.join(o, ["ticker", "session"]).filter(f"ret_4w IS NOT NULL AND {_Y} IS NOT NULL").agg(F.count(F.lit(1)).alias("n"), F.round(F.corr("ret_4w", _Y), 5).alias("correlation"))


@query("exact_quantiles", "SELECT l_returnflag, l_linestatus, count(l_extendedprice) AS n, round(quantile_cont(l_extendedprice, 0.01), 6) AS q01, round(median(l_extendedprice), 6) AS q50, round(quantile_cont(l_extendedprice, 0.995), 6) AS q995 FROM lineitem GROUP BY 1, 2")
def exact_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    q = Q.exact_quantiles(table(spark, sf, "lineitem"), "l_extendedprice", (0.01, 0.5, 0.995), ["l_returnflag", "l_linestatus"])
    return q.select("l_returnflag", "l_linestatus", "n", *[r6(F.col("quantiles")[i]).alias(c) for i, c in enumerate(("q01", "q50", "q995"))])


@query("cross_section_cuts", """WITH m AS (SELECT l_linenumber, l_quantity * l_discount AS x, median(l_quantity * l_discount) OVER (PARTITION BY l_linenumber) AS m FROM lineitem)
  SELECT l_linenumber, count(x) AS n, round(max(m), 6) AS median, round(median(abs(x - m)), 6) AS mad, round(quantile_cont(x, 0.01), 6) AS low, round(quantile_cont(x, 0.99), 6) AS high FROM m GROUP BY 1""")
def cross_section_cuts(spark: SparkSession, sf: str) -> DataFrame:
    """Seven cross-sections, each a large part of all rows."""
    x = table(spark, sf, "lineitem").select("l_linenumber", (F.col("l_quantity") * F.col("l_discount")).alias("x"))
    return Q.robust_cuts(x, "x", ["l_linenumber"]).select("l_linenumber", "n", *[r6(c).alias(c) for c in ("median", "mad", "low", "high")])


@query("tree_ranker")
def tree_ranker(spark: SparkSession, sf: str) -> DataFrame:
    """Boosted trees of all features, as many and as deep as the ranker's fixed values say; points and ends of every labelled row."""
    x = stored(_labelled(spark, sf).filter(F.col(_Y).isNotNull()), "labelled")
    model = trees.fit_ranker(x, COLS, _Y, n_trials=1, least=50)
    if model is None:  # too few rows for two leaves
        beta, ends = M.fit_ranker(x, ["ret_1w"], _Y, n_trials=1)
        return x.select("ticker", "session", *M.with_interval(beta, ends, "ml_pred"))
    return model.predict(x).select("ticker", "session", *[r6(c).alias(c) for c in ("ml_pred", "ml_pred_lo", "ml_pred_hi")])


_CURRENT = {"momentum": 0.6, "lowvol": 0.4}


@query("weight_proposal", _LABELS + f""", x AS (SELECT coalesce(ret_4w, 0) AS a, coalesce(0 - vol_13w, 0) AS b, coalesce(label, 0) AS y, label FROM l), s AS (SELECT count(label) AS n, sum(a * a) + 1 AS aa, sum(a * b) AS ab, sum(b * b) + 1 AS bb, sum(a * y) AS ay, sum(b * y) AS byy FROM x),
  f AS (SELECT n, greatest((bb * ay - ab * byy) / (aa * bb - ab * ab), 0) AS m, greatest((aa * byy - ab * ay) / (aa * bb - ab * ab), 0) AS v FROM s), h AS (SELECT 'momentum' AS grp, {_CURRENT['momentum']}::DOUBLE AS old, m / (m + v) AS new FROM f WHERE n >= 100 AND m + v > 0 UNION ALL SELECT 'lowvol', {_CURRENT['lowvol']}::DOUBLE, v / (m + v) FROM f WHERE n >= 100 AND m + v > 0),
  p AS (SELECT grp, CASE WHEN abs(new - old) / 2 <= 0.10 THEN (old + new) / 2 ELSE 0.8::DOUBLE * old + 0.2::DOUBLE * new END AS w FROM h), o AS (SELECT grp, w / sum(w) OVER () AS weight FROM p)
  SELECT c.grp, c.current, round(weight, 6) AS weight FROM (VALUES ('momentum', {_CURRENT['momentum']}::DOUBLE), ('lowvol', {_CURRENT['lowvol']}::DOUBLE)) c(grp, current) LEFT JOIN o USING (grp)""")
def weight_proposal(spark: SparkSession, sf: str) -> DataFrame:
    """Weights of two groups, and new ones by their scores' part in what came of them; null where nothing is proposed."""
    x = _labelled(spark, sf).withColumn("calm", 0 - F.col("vol_13w"))
    found = M.propose_weights(x, {"momentum": "ret_4w", "lowvol": "calm"}, _Y, _CURRENT) or {}
    rows = [(g, w, found.get(g)) for g, w in _CURRENT.items()]  # a row a group
    return spark.createDataFrame(rows, "grp string, current double, weight double").withColumn("weight", r6("weight"))


_GUARDED = (*COLS, "rsi_like", "rank_in_session", "z_in_session", "leak")


@query("future_stability", " UNION ALL ".join(f"SELECT '{c}' AS feature, {str(c == 'leak').lower()} AS unstable" for c in _GUARDED))
def future_stability(spark: SparkSession, sf: str) -> DataFrame:
    """Whether a column of the past changes when extreme sessions follow: each feature, a mean of gains, a rank and a robust score of
    the session; and one that looks ahead, which must be found."""
    p = stored(prices(spark, sf), "bars")

    def compute(bars: DataFrame) -> DataFrame:
        x = features(P.dense(bars))
        gain = F.greatest(F.col("ret_1w"), F.lit(0.0))
        x = x.withColumns({"rsi_like": F.avg(gain).over(P.last(14)), "leak": F.lead("close").over(P.by_session()), "rank_in_session": S.rank_pct(F.col("ret_4w"), S.whole("session"))})
        return S.robust_z(x, ["ret_4w"], ["session"]).withColumnRenamed("ret_4w_z", "z_in_session").select("ticker", "session", *_GUARDED)

    return checks.unstable_columns(compute, p, "session", ["ticker", "session"], 28)

"""Semantics that the tables at hand do not show."""

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from plumbline.operators import advice, backtest, checks, features, fundamentals, macro, models, panel, pit, readers, retrieval, scoring, screener
from plumbline.sources import normalizers, sinks
from plumbline.streaming import ingest

D = dt.date


def test_only_what_was_known_is_visible(spark):
    rows = spark.createDataFrame([("a", D(2024, 5, 10), 1.0), ("a", D(2024, 7, 1), 2.0), ("a", None, 9.0)], "k string, filed date, v double")
    assert [r.v for r in pit.visible(rows, "filed", "2024-06-30").collect()] == [1.0]
    old, new = (pit.versions_as_of(rows, ["k"], "filed", d).collect()[0].v for d in ("2024-06-30", "2024-08-01"))
    assert (old, new) == (1.0, 2.0)


def test_interval_and_asof(spark):
    dim = spark.createDataFrame([("a", D(2020, 1, 1), D(2021, 1, 1)), ("a", D(2021, 1, 1), None)], "k string, valid_from date, valid_to date")
    assert pit.valid_at(dim, "2022-01-01").count() == 1
    left = spark.createDataFrame([("a", D(2024, 1, 5)), ("a", D(2023, 1, 1))], "k string, d date")
    right = spark.createDataFrame([("a", D(2024, 1, 1), 1.0), ("a", D(2024, 1, 4), 2.0)], "k string, d date, v double")
    assert sorted((r.d, r.v) for r in pit.asof_join(left, right, ["k"], "d", ["v"]).collect()) == [(D(2023, 1, 1), None), (D(2024, 1, 5), 2.0)]


def test_short_history_and_gaps_are_null(spark):
    rows = spark.createDataFrame([("a", D(2024, 1, 1), 10.0), ("a", D(2024, 1, 3), 11.0), ("b", D(2024, 1, 2), 5.0)], "ticker string, session date, close double")
    p = panel.trailing(panel.dense(rows), {"r": panel.simple_return("close"), "m": panel.rolling(F.avg, "close", 3, 2)})
    found = {(r.ticker, r.session_idx): (r.r, r.m) for r in p.collect()}
    assert len(found) == 6 and found["a", 2] == (None, 10.5) and found["b", 2] == (None, None)


def test_robust_z_keeps_the_rest_near_zero(spark):
    rows = spark.createDataFrame([("s", 15.0 + i / 100) for i in range(19)] + [("s", 10000.0)], "sector string, x double")
    z = [abs(r.x_z) for r in scoring.robust_z(rows, ["x"], ["sector"]).orderBy("x").collect()]
    assert max(z) <= 3.0 and np.mean(z[:19]) < 1.5


def test_capped_top(spark):
    rows = spark.createDataFrame([(1, "s" if i < 8 else f"t{i}", float(100 - i), i) for i in range(20)], "day int, sector string, score double, id int")
    found = scoring.capped_top(rows, ["day"], "sector", [F.desc("score"), F.col("id")], 3, 10).collect()
    assert len(found) == 10 and sum(r.sector == "s" for r in found) == 3


def test_screen_conditions(spark):
    rows = spark.createDataFrame([(1,), (2,), (None,)], "x int")
    count = lambda op, value=None: rows.filter(screener.condition("x", op, value)).count()
    assert [count("ne", 1), count("not_in", [1]), count("is_null"), count("between", [1, 2]), count("no such operator")] == [1, 1, 1, 2, 3]


def test_deflated_sharpe_falls_with_trials():
    found = [backtest.deflated_sharpe(0.1, t, 250) for t in (1, 10, 100)]
    assert found == sorted(found, reverse=True) and backtest.expected_max_sharpe(1, 1.0) == 0


def test_diebold_mariano():
    rng = np.random.default_rng(0)
    a, b = rng.normal(0, 1, 300), rng.normal(0, 2, 300)
    assert models.diebold_mariano(a, a)["p_value"] > 0.99 and models.diebold_mariano(a, b)["p_value"] < 0.01


def test_tables_stay_whole_in_chunks():
    text = "# Head\n\nSome prose here.\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\nMore prose."
    assert any("| a | b |" in c["text"] and "| 1 | 2 |" in c["text"] for c in retrieval.chunk_text(text))


def test_citations(spark):
    docs = spark.createDataFrame([("a", "Sales  rose by ten per cent over the year, in all."), ("b", None)], "doc_id string, text string")
    claims = [("a", "rose by ten"), ("a", "Sales rose by tin per cent over the year"), ("a", "profits fell hard"), ("b", "x"), ("c", "x"), ("a", "")]
    found = retrieval.verify_citations(spark.createDataFrame(claims, "doc_id string, quote string"), docs).collect()
    got = {(r.doc_id, r.quote): r.verdict for r in found}
    assert [got[c] for c in claims] == ["VERIFIED", "VERIFIED_FUZZY", "QUOTE_NOT_FOUND", "PAGE_NOT_FOUND", "DOC_NOT_FOUND", "VERIFIED"]


def test_index_and_visible_chunks(spark):
    schema = "chunk_id string, doc_id long, chunk_no int, section string, filed_at date, embedding array<float>"
    old = spark.createDataFrame([("1#0", 1, 0, "a", D(2024, 1, 1), [1.0]), ("2#0", 2, 0, "b", D(2024, 5, 1), [1.0])], schema)
    new = spark.createDataFrame([("1#0", 1, 0, "c", D(2024, 3, 1), [2.0]), ("1#1", 1, 1, "c", D(2024, 3, 1), None)], schema)
    index = retrieval.indexed(old, new)
    assert sorted((r.chunk_id, r.section) for r in index.collect()) == [("1#0", "c"), ("2#0", "b")]
    assert [r.chunk_id for r in retrieval.chunks_of(index, 1, "c").collect()] == ["1#0"]
    hits = spark.createDataFrame([("1#0", 0.5), ("2#0", 0.9)], "chunk_id string, score double")
    assert [r.chunk_id for r in retrieval.known_chunks(hits, index, "2024-04-01", k=5).collect()] == ["1#0"]


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    once = sinks.upsert(old, new, ["k"])
    assert sorted(map(tuple, once.collect())) == [(1, "a"), (2, "c"), (3, "d")] == sorted(map(tuple, sinks.upsert(once, new, ["k"]).collect()))


def test_upsert_of_repeated_keys(spark):
    old = spark.createDataFrame([(1, "a")], "k int, v string")
    new = spark.createDataFrame([(1, "b"), (1, "c")], "k int, v string")
    assert [tuple(r) for r in sinks.upsert(old, new, ["k"]).collect()] == [(1, "c")]
    assert [tuple(r) for r in sinks.upsert(old, new, ["k"], [F.col("v")]).collect()] == [(1, "b")]


def test_a_total_loss_stays(spark):
    rows = [(D(2024, m, 1), "a", 1.0, r, 0.0) for m, r in ((1, 0.1), (2, -1.0), (3, 0.1))]
    curve = backtest.equity(spark.createDataFrame(rows, "as_of date, ticker string, weight double, ret double, turnover double"), 0.0)
    assert [round(r.equity, 6) for r in curve.orderBy("as_of").collect()] == [1.1, 0.0, 0.0]
    d = backtest.deepest(curve).first()
    assert (d.max_drawdown, d.peak, d.trough, d.recovered) == (-1.0, D(2024, 1, 1), D(2024, 2, 1), None)


def test_first_allocation_is_capped(spark):
    t = spark.createDataFrame([(D(2024, 1, 1), "a", 1.0), (D(2024, 2, 1), "b", 1.0)], "as_of date, ticker string, target double")
    got = {(r.as_of, r.ticker): (round(r.weight, 6), round(r.turnover, 6)) for r in backtest.turnover_capped(t, 0.3).collect()}
    assert got == {(D(2024, 1, 1), "a"): (0.6, 0.3), (D(2024, 2, 1), "a"): (0.375, 0.3), (D(2024, 2, 1), "b"): (0.375, 0.3)}


def test_entry_is_the_next_session(spark):
    days = [D(2026, 8, d) for d in (17, 18, 19, 20, 21, 24, 25)]
    prices = spark.createDataFrame([("x", d, 200.0 if d == D(2026, 8, 21) else 100.0) for d in days], "ticker string, session date, open double")
    signals = spark.createDataFrame([(D(2026, 8, 20), "x", 1.0)], "session date, ticker string, score double")
    cal = prices.select("session")
    pos = backtest.position_returns(backtest.targets(signals, backtest.periods(signals, cal), 1), prices).first()
    assert (pos.entry, pos.entry_price) == (D(2026, 8, 21), 200.0)
    for bad in ({"fee_bps": -1.0}, {"n_trials": 0}, {"frequency": "quarterly"}, {"end": D(2026, 8, 18)}):
        kw = {"start": days[0], "end": days[-1], "fee_bps": 5.0, "slippage_bps": 10.0, "turnover_cap": 0.3, "n_trials": 1} | bad
        try:
            backtest.validate(signals, cal, **kw)
            raise AssertionError(bad)
        except ValueError:
            pass


def test_what_looks_ahead_is_found(spark):
    rows = [("a", D(2024, 1, d), float(d * d)) for d in range(1, 20)]
    df = spark.createDataFrame(rows, "k string, d date, v double")
    from pyspark.sql import Window

    w = Window.partitionBy("k").orderBy("d")
    past = lambda x: x.withColumn("f", F.col("v") - F.lag("v").over(w)).filter(F.col("d") <= F.lit(D(2024, 1, 19))).select("k", "d", "f")
    ahead = lambda x: x.withColumn("f", F.lead("v").over(w)).filter(F.col("d") <= F.lit(D(2024, 1, 19))).select("k", "d", "f")
    assert checks.unstable_rows(past, df, "d", 5).count() == 0 and checks.unstable_rows(ahead, df, "d", 5).count() == 1
    checks.register(spark)
    assert abs(spark.sql("SELECT t_quantile(0.975D, 10D)").first()[0] - 2.228) < 0.01


def test_statements_become_quarters(spark):
    rows = [("a", 2024, p, "cumulative" if p != "FY" else "annual", D(2024, 3 * i, 28), D(2024, 3 * i, 28), v) for i, (p, v) in enumerate((("Q1", 10.0), ("Q2", 25.0), ("FY", 70.0)), 1)]
    q = fundamentals.standalone_quarters(spark.createDataFrame(rows, "ticker string, fiscal_year int, fiscal_period string, period_type string, period_end date, filed_at date, revenue double"))
    assert {r.fiscal_period: r.revenue for r in q.collect()} == {"Q1": 10.0, "Q2": 15.0, "Q4": None}


def test_losses_have_no_multiple(spark):
    cols = ["net_income_ttm", "forecast_net_income", "total_equity", "revenue_ttm", "total_debt", "cash_and_equiv", "ebitda_ttm", "operating_cf_ttm", "capex_ttm", "dividend_per_share_ttm"]
    df = spark.createDataFrame([(100.0, 10.0, *[-5.0] * len(cols))], ", ".join(f"{c} double" for c in ("market_cap", "close", *cols)))
    v = fundamentals.valuation(df).first()
    assert v.per is None and v.pbr is None and v.psr is None and v.earnings_yield == -0.05


def test_technicals_by_hand(spark):
    rng = np.random.default_rng(3)
    close = [None if rng.random() < 0.1 else float(100 + rng.normal()) for _ in range(80)]
    rows = [(i, c, None if i == 0 or c is None or close[i - 1] is None else c - close[i - 1], 1.0) for i, c in enumerate(close)]
    df = spark.createDataFrame([(rows,)], "rows array<struct<i:int,x:double,move:double,range:double>>")
    got = df.select(features.technicals(F.col("rows")).alias("t")).first().t

    def ewm(x, alpha, least):
        mean, w, n, out = None, 1.0, 0, []
        for v in x:
            if mean is not None:
                w *= 1 - alpha
            if v is not None:
                mean, w, n = (v if mean is None else (w * mean + alpha * v) / (w + alpha)), 1.0, n + 1
            out.append(mean if n >= least else None)
        return out

    line = [None if a is None or b is None else a - b for a, b in zip(ewm(close, 2 / 13, 12), ewm(close, 2 / 27, 26))]
    signal = ewm(line, 2 / 10, 9)[-1]
    up, down = (ewm([None if m is None else max(s * m, 0.0) for _, _, m, _ in rows], 1 / 14, 14)[-1] for s in (1, -1))
    assert np.allclose([got.macd, got.macd_signal, got.rsi_14, got.atr_14], [line[-1], signal, 100 - 100 / (1 + up / down), 1.0])


def test_volatility_model(spark):
    rng = np.random.default_rng(5)
    h, r = 1.0, []
    for _ in range(1500):
        r.append(rng.normal() * h**0.5)
        h = 0.05 + 0.1 * r[-1] ** 2 + 0.85 * h
    fit = models.garch_fit(np.array(r) / 100)
    assert fit["quality"] == "ok" and 0.85 < fit["alpha"] + fit["beta"] < 0.997 and fit["ret_20d_lo"] < 0 < fit["ret_20d_hi"]
    assert models.garch_fit(np.array(r[:400]) / 100)["quality"] == "too_short"


def test_weights_move_little():
    old = {"a": 0.5, "b": 0.3, "c": 0.2}
    assert models.proposed_weights({"a": 1.0}, old, 99) is None and models.proposed_weights({"a": -1.0}, old, 200) is None
    new = models.proposed_weights({"a": 1.0, "b": 0.0, "c": -3.0}, old, 200)
    assert abs(sum(new.values()) - 1) < 1e-12 and new["a"] > new["b"] > new["c"] and abs(new["b"] / new["c"] - 0.24 / 0.1) < 1e-9


def test_autoregression_follows_a_trend():
    y = np.arange(100, dtype=float)
    at, low, high = macro.arx(y, None, 5)
    assert abs(at - 104) < 1e-6 and low <= at <= high


def test_vendor_payloads(spark, tmp_path):
    raw = spark.createDataFrame([("1", "2024-01-05", "10", None), ("2", None, "x", "5")], "Code string, Date string, C string, AdjC string")
    bar = normalizers.daily_bars(raw).collect()
    assert [(r.ticker, r.close, r.adj_close) for r in bar] == [("1", 10.0, 10.0)]
    try:
        normalizers.daily_bars(raw.drop("Date"))
        raise AssertionError
    except ValueError as e:
        assert "Date" in str(e)
    sinks.write_raw(raw, str(tmp_path / "raw"), "bars", "2024-01-05")
    sinks.write_raw(raw.limit(1), str(tmp_path / "raw"), "bars", "2024-01-06")
    assert sinks.read_raw(spark, str(tmp_path / "raw"), source="bars", since="2024-01-06").count() == 1 and sinks.raw_dates(spark, str(tmp_path / "raw")).count() == 2
    (tmp_path / "t.csv").write_text("ticker,shares\n7203,100\n,5\n6758,many\n")
    good, bad = sinks.read_csv(spark, str(tmp_path / "t.csv"), "ticker string, shares int", ["ticker", "shares"])
    assert [r.ticker for r in good.collect()] == ["7203"] and [(r.line, r.record) for r in bad.orderBy("line").collect()] == [(3, ",5"), (4, "6758,many")]
    nested = spark.createDataFrame([(1, ("x", 2))], "id int, held struct<quantity:string,n:int>")
    assert normalizers.sensitive_fields(nested) == ["held.quantity"]


def test_small_readers(spark):
    docs = spark.createDataFrame([("a", None), ("b", "own")], "doc_id string, text string")
    blobs = spark.createDataFrame([("a", "blob"), ("b", "other")], "doc_id string, text string")
    assert {r.doc_id: r.text for r in sinks.texts(docs, blobs).collect()} == {"a": "blob", "b": "own"}
    names = spark.createDataFrame([("a", None)], "doc_id string, name_local string")
    raw = spark.createDataFrame([("a", "Old", "2024-01-01"), ("a", "New", "2024-02-01")], "doc_id string, name string, dt string")
    assert sinks.named(names, raw).first().name_local == "New"
    assert sinks.lookback_days(30, D(2024, 1, 1), D(2024, 1, 3)) == 7 and sinks.lookback_days(30, None, D(2024, 1, 3)) == 30
    prices = spark.createDataFrame([("72030", D(2024, 1, 1), 1.0), ("72030", D(2024, 1, 2), 2.0)], "ticker string, session date, close double")
    assert [r.close for r in readers.price_range(prices, "7203", latest=1).collect()] == [2.0]
    runs = sinks.with_run_defaults(spark.createDataFrame([(None, 1)], "run_id string, n int"), {"status": "done"}).first()
    assert runs.run_id and runs.status == "done"
    good, bad = sinks.accepted(advice.invariants(_card(spark)).drop("violations"), F.array().cast("array<string>"))
    assert good.count() == 1 and bad.count() == 0
    frames = sinks.route({"t": spark.createDataFrame([(1, "b")], "k int, v string")}, {"t": (spark.createDataFrame([(1, "a")], "k int, v string"), ["k"])})
    assert frames["t"].first().v == "b"


def _card(spark):
    row = (1, "x" * 30, ["d"], ["c"], 0.0, 0.1, "t", "i", 0.5, 0.6, 30, "high")
    return spark.createDataFrame([row], "k int, bear_case string, source_doc_ids array<string>, citations array<string>, expected_ret_lo double, expected_ret_hi double, thesis string, invalidation string, conviction_score double, hit_rate_prior double, n_prior_samples int, conviction string")


def test_invariants_hold(spark):
    good = _card(spark)
    assert advice.invariants(good).first().violations == []
    bad = good.withColumns({"thesis": F.lit(" "), "citations": F.array().cast("array<string>"), "n_prior_samples": F.lit(3)})
    r = advice.invariants(bad).first()
    assert set(r.violations) == {"thesis", "citations"} and r.conviction == "low"


def test_stream_upserts_touch_their_buckets(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, t int")
    rows.write.parquet(str(tmp_path / "in"))
    table = str(tmp_path / "table")
    for _ in range(2):
        q = ingest.upsert_stream(ingest.file_stream(spark, str(tmp_path / "in"), rows.schema, 1), table, ["k"], [F.col("t").desc()], str(tmp_path / "cp"))
        q.awaitTermination(120)
        spark.createDataFrame([(2, "c", 2), (3, "d", 2)], rows.schema).write.mode("append").parquet(str(tmp_path / "in"))
    found = ingest.read_stream_table(spark, table, spark.read.option("basePath", table).parquet(table).schema)
    assert {r.k for r in found.collect()} >= {1, 2}


def test_lake_round_trip(spark, tmp_path):
    sinks.write_lake(spark.createDataFrame([("JP", 1), ("US", 2)], "market string, v int"), str(tmp_path / "lake"), ["market"])
    assert [r.v for r in sinks.read_lake(spark, str(tmp_path / "lake"), ["v", "market"], [("market", "=", "US")]).collect()] == [2]


def test_stream_of_files(spark, tmp_path):
    at = dt.datetime(2024, 1, 1)
    rows = spark.createDataFrame([(at + dt.timedelta(minutes=m), "a", 1.0) for m in (0, 1, 61)], "ts timestamp, k string, v double")
    rows.write.parquet(str(tmp_path / "in"))
    stream = ingest.file_stream(spark, str(tmp_path / "in"), rows.schema)
    out = ingest.tumbling(stream, "ts", "1 hour", "10 minutes", ["k"], [F.count(F.lit(1)).alias("n")])
    q = out.writeStream.format("memory").queryName("tumbled").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(r.n for r in spark.table("tumbled").collect()) == [1, 2]

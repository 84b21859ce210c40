"""Functions with known answers."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from plumbline.functions import expressions as X
from plumbline.operators import advice, calendar as C, macro, models, pit, readers, scoring
from plumbline.sources import normalizers, sinks
from plumbline.streaming import ingest

D = dt.date


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{k}") for k, c in enumerate(cols)]).first()


def test_lake_of_tables(spark, tmp_path):
    lake = str(tmp_path / "lake")
    assert sinks.lake_tables(spark, lake) == [] and not sinks.lake_exists(spark, lake) and not sinks.lake_drop(spark, lake)
    sinks.export({"a": spark.range(5), "b": spark.range(0)}, lake)
    assert sinks.lake_tables(spark, lake) == ["a", "b"] and spark.read.parquet(f"{lake}/a").count() == 5
    used = sinks.lake_usage(spark, f"{lake}/a").first()
    assert used.files >= 1 and used.bytes > 0 and sinks.lake_usage(spark, f"{lake}/none").first().files == 0
    assert sinks.lake_drop(spark, f"{lake}/a") and sinks.lake_tables(spark, lake) == ["b"]


def test_texts_by_id(spark, tmp_path):
    folder = str(tmp_path / "texts")
    sinks.write_texts(spark.createDataFrame([("a", "one\nline"), ("b", ""), ("c", None)], "doc_id string, text string"), folder)
    sinks.write_texts(spark.createDataFrame([("z", "later")], "doc_id string, text string"), folder)
    assert [tuple(r) for r in sinks.read_texts(spark, folder, "a").collect()] == [("a", "one\nline")]
    assert {r.doc_id for r in sinks.read_texts(spark, folder).collect()} >= {"z"} and sinks.read_texts(spark, folder, "none").count() == 0


def test_rows_of_any_kind(spark):
    df = spark.createDataFrame([("1.5", float("nan"), "2024-01-05T23:30:00-05:00", " ", 1), ("x", float("inf"), "2024-01-05", "NaN", 2)], "a string, b double, d string, e string, extra int")
    got = sinks.coerced(df, {"a": "double", "b": "double", "d": "date", "e": "double", "none": "string"}).collect()
    assert [tuple(r) for r in got] == [(1.5, None, D(2024, 1, 6), None, None), (None, None, D(2024, 1, 5), None, None)]


def test_summaries_need_citations(spark):
    good = spark.createDataFrame([("a", ["c"])], "doc_id string, citations array<string>")
    assert sinks.with_citations(good).count() == 1
    for bad in ([], None):
        with pytest.raises(Exception, match="no citations: b"):
            sinks.with_citations(spark.createDataFrame([("b", bad)], good.schema)).collect()


def test_plans_of_the_vendor():
    assert sinks.research_cutoff(D(2024, 6, 30), "free") == D(2024, 4, 7) and sinks.research_cutoff(D(2024, 6, 30), "light") == D(2024, 6, 30)


def test_schema_drift_is_named(spark):
    df = spark.createDataFrame([(1,)], "a int")
    assert normalizers.required(df, "a", ("b", "a")) is df
    with pytest.raises(ValueError, match="b.*'c', 'd'"):
        normalizers.required(df, "b", ("c", "d"))


def test_leaks_and_inputs(spark):
    rows = spark.createDataFrame([("a", D(2024, 5, 1)), ("b", D(2024, 7, 1))], "k string, filed date")
    assert pit.leaks(rows, "filed", "2024-06-30") and not pit.leaks(pit.visible(rows, "filed", "2024-06-30"), "filed", "2024-06-30")
    got = readers.inputs({"f": (rows, ["valid_from", "filed"]), "late": (rows.filter("k = 'b'"), ["filed"]), "timeless": (rows, ["x"])}, "2024-06-30")
    assert list(got) == ["f"] and [r.k for r in got["f"].collect()] == ["a"]


def test_weights_add_up():
    good = {"momentum": {"a": 0.7, "b": 0.3}}
    assert scoring.checked_weights(good["momentum"]) == good["momentum"]
    with pytest.raises(ValueError):
        scoring.checked_weights({"a": 0.7, "b": 0.2})


def test_rankers_are_kept(spark, tmp_path):
    models.save_ranker(spark, str(tmp_path / "m"), {"intercept": 1.0, "x": -2.0}, (-0.5, 0.25))
    assert models.load_ranker(spark, str(tmp_path / "m")) == ({"intercept": 1.0, "x": -2.0}, (-0.5, 0.25))


def test_intervals_and_walks(spark):
    low, high = advice.rescaled_interval(F.lit(1.0), F.lit(1.0 - 1.959963985), F.lit(1.0 + 1.959963985))
    r = one(spark, low, high, *models.random_walk(F.lit(100.0), F.lit(2.0), 4))
    assert abs(r.c0 - (1 - 1.281551566)) < 1e-6 and abs(r.c1 - (1 + 1.281551566)) < 1e-6 and r.c2 == 100.0 and abs(r.c4 - r.c2 - 1.959963985 * 4) < 1e-6 and r.c3 + r.c4 == 200.0
    walk = spark.createDataFrame([("w", 1.0, 0.5, 1.5, "x")], "model_id string, point double, low double, high double, extra string")
    assert [tuple(r) for r in macro.bundle([walk, walk.drop("extra")]).collect()] == [("w", 1.0, 0.5, 1.5)] * 2


def test_small_expressions(spark):
    lit = F.lit
    assert one(spark, X.clean_name(lit("7203"), lit("7203")), X.clean_name(lit(" Toyota "), lit("7203")), X.first_name(lit("7203"), lit("<NA>"), lit("Toyota")), X.first_name(lit("7203"), lit("none"))) == (None, "Toyota", "Toyota", "7203")
    assert one(spark, X.split_list(lit(" a,,b ,")), X.split_list(lit(None).cast("string"))) == (["a", "b"], [])
    assert one(spark, X.without_suffix(lit("7203.T")), X.symbol_market(lit("7203.T"), {".T": "JP"}, "US"), X.exchange_suffix(lit("Tokyo"), (("tokyo", ".T"),))) == ("7203", "JP", ".T")
    assert one(spark, normalizers.masked(lit("http://u:p@h/?token=abc&x=1")), X.model_cost(lit(1e6), lit(5e5), lit(3.0), lit(15.0))) == ("http://***:***@h/?token=***&x=1", 10.5)
    assert one(spark, scoring.overlay(lit(50.0), lit(1.0), lit(None).cast("double")), scoring.overlay(lit(95.0), lit(1.0), lit(1.0)), scoring.overlay(lit(50.0), lit(None).cast("double"), lit(1.0))) == (56.0, 100.0, 50.0)
    assert one(spark, C.range_start(lit("3m"), lit("2024-06-30").cast("date")), C.range_start(lit("?"), lit("2024-06-30").cast("date"))) == (D(2024, 3, 29), D(2023, 7, 1))
    at = lambda t: lit(t).cast("timestamp")
    assert one(spark, C.session_as_of(at("2024-01-05 09:29:00"), "JP"), C.session_as_of(at("2024-01-05 09:30:00"), "JP"), C.session_as_of(at("2024-01-05 20:59:00"), "US"), C.session_as_of(at("2024-01-05 21:00:00"), "US")) == (D(2024, 1, 4), D(2024, 1, 5), D(2024, 1, 4), D(2024, 1, 5))
    assert abs(X.t_quantile(0.975, 30) - 2.0423) < 1e-3
    cdf = one(spark, *[X.t_cdf(lit(x), df) for x, df in ((2.2281, 10), (-1.0, 1), (0.0, 5), (1.96, 1000))])
    assert all(abs(a - b) < 1e-4 for a, b in zip(cdf, (0.975, 0.25, 0.5, 0.97486)))


def test_shifted_sessions(spark):
    cal = spark.createDataFrame([(D(2024, 1, d), k) for k, d in enumerate((4, 5, 9))], "session date, session_idx int")
    assert {r.session: r.other for r in C.shifted(cal, 1).collect()} == {D(2024, 1, 4): D(2024, 1, 5), D(2024, 1, 5): D(2024, 1, 9), D(2024, 1, 9): None}


def test_long_facts_and_arrays(spark):
    f = spark.createDataFrame([(1, "B", 2.0, D(2024, 1, 1)), (1, "A", 5.0, D(2024, 2, 1)), (1, "A", 4.0, D(2024, 1, 1)), (1, "Z", 9.0, D(2024, 1, 1)), (2, "B", None, D(2024, 1, 1)), (2, "C", 7.0, D(2024, 1, 1))], "k int, tag string, value double, filed date")
    assert {r.k: (r.x, r.y) for r in normalizers.facts_wide(f, {"x": ("A", "B"), "y": ("C",)}, ["k"]).collect()} == {1: (4.0, None), 2: (None, 7.0)}
    p = spark.createDataFrame([("c", [1, 2], ["x"])], "c string, a array<int>, b array<string>")
    assert [tuple(r) for r in normalizers.parallel_rows(p, ["a", "b"], ["c"]).collect()] == [("c", 1, "x"), ("c", 2, None)]
    o = spark.createDataFrame([("s", "2024-01-01", "2024-02-01", "2024-03-01", "1.5"), ("s", "2024-01-02", None, "2024-03-01", ".")], "series_id string, date string, realtime_start string, fetched_at string, value string")
    assert [(r.vintage_date, r.value) for r in normalizers.observations(o, True).collect()] == [(D(2024, 2, 1), 1.5), (D(2024, 3, 1), None)]
    assert [r.vintage_date for r in normalizers.observations(o, False).collect()] == [D(2024, 1, 1), D(2024, 1, 2)]


def test_benchmark_excess_and_regime_words(spark):
    assert one(spark, *[macro.correlation_level(F.lit(x).cast("double")) for x in (0.5, 0.25, 0.3, None)]) == ("high", "low", "normal", None)
    df = spark.createDataFrame([(0.3, 0.1), (0.3, None)], "v double, b double").withColumn("x", scoring.benchmark_excess("v", "b"))
    assert [r.x and round(r.x, 6) for r in df.collect()] == [0.2, None]
    few = spark.createDataFrame([(D(2024, 1, 1) + dt.timedelta(days=i), 100.0 + i % 3) for i in range(24)], "d date, v double")
    assert macro.volatility_regime(few, "d", "v").first().level == "unknown"
    assert macro.volatility_regime(few.union(few.limit(1).select(F.lit(D(2024, 3, 1)), F.lit(90.0))), "d", "v").first().level == "high"


def test_sliding_windows_and_first_sight(spark, tmp_path):
    at = dt.datetime(2024, 1, 1)
    rows = spark.createDataFrame([(at + dt.timedelta(minutes=m), k, 1.0) for m, k in ((0, "a"), (40, "a"), (50, "b"), (45, "a"))], "ts timestamp, k string, v double")
    rows.write.parquet(str(tmp_path / "in"))
    stream = ingest.file_stream(spark, str(tmp_path / "in"), rows.schema)
    runs = {"slid": ingest.sliding(stream, "ts", "1 hour", "30 minutes", "10 minutes", [], [F.count(F.lit(1)).alias("n")]), "gaps": ingest.sessions(stream, "ts", "20 minutes", "10 minutes", ["k"], [F.count(F.lit(1)).alias("n")]), "seen": ingest.first_seen(stream, "ts", "1 hour", ["k"])}
    for name, out in runs.items():
        mode = "append" if name == "seen" else "complete"
        out.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"cp-{name}")).trigger(availableNow=True).start().awaitTermination(120)
    assert sorted(r.n for r in spark.table("slid").collect()) == [1, 3, 4]
    assert sorted((r.k, r.n) for r in spark.table("gaps").collect()) == [("a", 1), ("a", 2), ("b", 1)]
    assert sorted(r.k for r in spark.table("seen").collect()) == ["a", "b"]


def test_envelopes_are_replayed_in_order(spark, tmp_path):
    folder = str(tmp_path / "raw")
    assert sinks.replay(spark, folder).collect() == []
    page = lambda *p: spark.createDataFrame([(k, f'{{"page": {k}}}') for k in p], "k int, payload string").repartition(3)
    assert sinks.write_envelopes(page(1, 2, 3), folder, "vendor", "bars", "2024-01-05", "2024-01-05T18:00:00Z", ["k"]) == 3
    assert sinks.write_envelopes(page(4), folder, "vendor", "bars", "2024-01-05", "2024-01-05T19:00:00Z", ["k"]) == 4
    sinks.write_envelopes(page(5).withColumn("request", F.lit("?p=5")), folder, "vendor", "bars", "2024-01-06", "2024-01-06T18:00:00Z", ["k"])
    got = sinks.replay(spark, folder, "vendor").collect()
    assert [(str(r.dt), r.seq, r.payload) for r in got] == [*(("2024-01-05", k, f'{{"page": {k}}}') for k in range(1, 5)), ("2024-01-06", 1, '{"page": 5}')] and got[-1].request == "?p=5"
    assert sinks.replay(spark, folder, since="2024-01-06").count() == 1 and sinks.replay(spark, folder, endpoint="none").count() == 0

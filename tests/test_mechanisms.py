"""Joins of similar texts, indexed vectors, trees, exact quantiles, sliced joins, chunks, citations and backtests against plain versions."""

import datetime as dt
import difflib
import random
import re

import numpy as np
import pytest
from pyspark.sql import Window, functions as F

from plumbline import catalog
from plumbline.functions.expressions import deepest_drawdown
from plumbline.operators import backtest, checks, macro, models, panel, pit, quantiles, retrieval, similarity, trees
from plumbline.operators.vector_index import VectorIndex, matches
from plumbline.plans import text as T
from plumbline.sources import normalizers

D = dt.date


# Similar texts and lessons


def words(r, n):
    return "".join(r.choice("abcdeäü漢 ") for _ in range(n))


def edited(r, text, k):
    x = list(text)
    for _ in range(k):
        i = r.randrange(len(x) + 1)
        x[i : i + r.randrange(2)] = r.choice(["", "z", "ab"])
    return "".join(x)


@pytest.mark.parametrize("least", [0.7, 0.85, 0.95])
def test_similar_texts_lose_no_pair(spark, least):
    r = random.Random(int(100 * least))
    base = [words(r, n) for n in (0, 1, 2, 3, 5, 7, 8, 9, 10, 11, 12, 14, 20, 40, 80) for _ in range(3)]
    left = base + [edited(r, b, r.randrange(5)) for b in base]
    right = [edited(r, b, r.randrange(4)) for b in base] + ["", "a", "aaaaaaaa", "aaaaaaaaaaa"]
    frame = lambda x: spark.createDataFrame([*enumerate(x), (len(x), None)], "id long, text string")
    found = {(p.a, p.b): p.ratio for p in similarity.similar_texts(frame(left), frame(right), least).collect()}
    plain = {}
    for i, a in enumerate([*left, ""]):
        for j, b in enumerate([*right, ""]):
            ratio = difflib.SequenceMatcher(None, a, b).ratio()
            if ratio >= least:
                plain[i, j] = ratio
    assert found == plain and len(plain) >= 40
    with pytest.raises(ValueError):
        similarity.similar_texts(frame(left), frame(right), 0.6)


def test_lessons_are_a_double_loop(spark, small):
    """Over the whole table of the query; all four decisions occur."""
    old, new = T.lessons(spark, small)
    got = {r.lesson_id: (r.decision, r.memory_id) for r in similarity.lesson_updates(old, new).collect()}
    memories = sorted(old.filter("is_active").collect(), key=lambda m: m.memory_id)
    want = {}
    for lesson in new.collect():
        best, ratio = None, 0.0
        for m in memories:
            x = difflib.SequenceMatcher(None, m.text, lesson.text).ratio()
            if x > ratio:
                best, ratio = m, x
        if lesson.n_observations < 10:
            want[lesson.lesson_id] = ("refused", None)
        elif ratio < 0.85:
            want[lesson.lesson_id] = ("added", None)
        else:
            want[lesson.lesson_id] = ("superseded" if lesson.n_observations > best.n_observations else "known", best.memory_id)
    assert got == want and {d for d, _ in want.values()} >= {"refused", "added", "superseded"}


def test_memories_after_an_update(spark):
    schema = "memory_id string, text string, n_observations long, is_active boolean, hit_rate_before double, hit_rate_after double, use_count long"
    old = spark.createDataFrame([("M1", "buy the dip in falling markets", 12, True, 0.6, 0.54, 20), ("M2", "earnings beat drifts upward", 30, True, 0.6, 0.5, 19), ("M3", "earnings beat drifts upwards", 5, False, None, None, 50)], schema)
    new = spark.createDataFrame([("L1", "buy the dips in falling markets", 15), ("L2", "earnings beat drifts upward!", 10), ("L3", "something else altogether here", 10), ("L4", "too few cases", 9), ("L5", "unknown cases", None)], "lesson_id string, text string, n_observations long")
    made = similarity.lesson_updates(old, new)
    assert {r.lesson_id: r.decision for r in made.collect()} == {"L1": "superseded", "L2": "known", "L3": "added", "L4": "refused", "L5": "refused"}
    assert [r.memory_id for r in similarity.forgotten(old).collect()] == ["M1"]
    after = {r.memory_id: (r.text, r.n_observations, r.is_active) for r in similarity.updated_memories(old, new, made).collect()}
    assert after["M1"] == ("buy the dips in falling markets", 15, False) and after["L3"][2] and len(after) == 4 and after["M2"][1] == 30


# Vectors behind an index


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(20, 16))
    rows = [(i, i // 4, "JP" if i % 3 else "US", (centers[i % 20] + 0.4 * rng.normal(size=16)).tolist()) for i in range(1200)]
    rows += [(2000, 900, "JP", None), (2001, 900, "JP", [0.0] * 16), (2002, 901, None, [1.0])]
    return spark.createDataFrame(rows, "chunk_id long, doc_id long, market string, embedding array<double>").cache()


def test_index_recall_filter_and_exact_form(spark, vectors, tmp_path):
    index = VectorIndex(spark, str(tmp_path / "index")).build(vectors, 24)
    assert index.count() == vectors.count()
    q = vectors.filter("chunk_id % 20 = 0 AND embedding IS NOT NULL AND chunk_id < 2000")
    asked = q.select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("query"))
    key = lambda df: {(r.query_id, r.nth): (r.chunk_id, round(r.score, 6)) for r in df.collect()}
    exact = key(retrieval.vector_top_each(vectors, q, 10, "chunk_id", "embedding"))
    near = key(index.search(asked, 10, index.probes_for(10)))
    assert index.probes_for(10) < 24
    hits = sum(len({near.get((i, k), (None,))[0] for k in range(1, 11)} & {exact[i, k][0] for k in range(1, 11)}) for i in {i for i, _ in exact})
    assert hits / len(exact) >= 0.9 and len(near) == len(exact)
    where = matches({"market": "JP", "doc_id": {"$gte": 20, "$lte": 200}, "chunk_id": None})
    behind = key(retrieval.vector_top_each(vectors.filter(where), q, 10, "chunk_id", "embedding"))
    assert key(index.search(asked, 10, 24, where)) == behind and len(behind) == len(exact)


def test_index_of_the_query_finds_nine_of_ten(spark, small):
    exact = {(r.query_id, r.vec_id) for r in catalog.QUERIES["vector_search"](spark, "/root/testdata/sf0.01").collect()}
    near = {(r.query_id, r.vec_id) for r in catalog.QUERIES["vector_search_indexed"](spark, "/root/testdata/sf0.01").collect()}
    assert len(exact & near) / len(exact) >= 0.9


def test_index_upserts_and_deletes(spark, vectors, tmp_path):
    index = VectorIndex(spark, str(tmp_path / "index")).build(vectors.filter("chunk_id < 100"), 5)
    far = vectors.filter("chunk_id IN (3, 4)").withColumn("embedding", F.transform("embedding", lambda x: -x))
    index.upsert(far.unionAll(vectors.filter("chunk_id = 500")).unionAll(far))
    assert index.count() == 101
    assert {r.chunk_id: r.embedding for r in index.rows().filter("chunk_id IN (3, 4)").collect()} == {r.chunk_id: r.embedding for r in far.collect()}
    assert index.delete_by_doc(spark.createDataFrame([(0,), (125,), (777,)], "doc_id long")) == 5
    assert index.count() == 96 and index.list_by_doc(0).count() == 0 and index.list_by_doc(1).count() == 4
    assert index.delete_by_doc(vectors.select("doc_id")) == 96 and index.count() == 0
    empty = VectorIndex(spark, str(tmp_path / "empty")).build(vectors.limit(0), 5)
    assert empty.count() == 0 and empty.search(vectors.limit(2).select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("query")), 3, 2).collect() == []


# Trees, quantiles, weights


def test_trees_are_numpy_on_the_same_bins(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(3000, 3))
    y = np.where(x[:, 0] > 0.3, 2.0, -1.0) * (x[:, 1] < 0.5) + 0.1 * rng.normal(size=3000)
    x[rng.random(3000) < 0.1, 2] = np.nan
    rows = [(i, *[None if np.isnan(v) else float(v) for v in x[i]], float(y[i])) for i in range(3000)]
    df = spark.createDataFrame(rows, "ticker long, a double, b double, c double, y double")
    edges = [np.quantile(x[:, k][~np.isnan(x[:, k])], np.linspace(0, 1, 17)[1:-1]).tolist() for k in range(3)]
    model = trees.fit_ranker(df, ["a", "b", "c"], "y", n_trials=3, rounds=4, depth=3, least=100, edges=edges)

    bins = np.stack([np.where(np.isnan(x[:, k]), 0, 1 + np.searchsorted(edges[k], np.nan_to_num(x[:, k]), side="left")) for k in range(3)], 1)
    pred = np.full(3000, y.mean())
    for _ in range(4):
        left, leaf, values = y - pred, np.zeros(3000, int), {}

        def grow(at, node, level):
            best = (1e-12, None)
            g, n = left[at].sum(), len(at)
            for f in range(3) if level < 3 else ():
                for t in range(16):
                    low = bins[at, f] <= t
                    a, b = left[at][low], left[at][~low]
                    if min(len(a), len(b)) >= 100:
                        gain = a.sum() ** 2 / (len(a) + 1) + b.sum() ** 2 / (len(b) + 1) - g**2 / (n + 1)
                        if gain > best[0] + 1e-9:
                            best = (gain, (f, t, low))
            if best[1] is None:
                leaf[at] = node
                values[node] = g / (n + 1)
                return
            f, t, low = best[1]
            grow(at[low], 2 * node + 1, level + 1)
            grow(at[~low], 2 * node + 2, level + 1)

        grow(np.arange(3000), 0, 0)
        pred = pred + 0.1 * np.array([values[k] for k in leaf])
    ends = {k: np.quantile((y - pred)[leaf == k], [0.2, 0.8]) for k in values}
    found = {r.ticker: (r.ml_pred, r.ml_pred_lo, r.ml_pred_hi) for r in model.predict(df).collect()}
    got = np.array([found[i] for i in range(3000)])
    low, high = (pred + np.array([ends[k][e] for k in leaf]) for e in range(2))
    assert np.allclose(got, np.stack([pred, np.minimum(low, pred), np.maximum(high, pred)], 1))
    assert len(model.trees) == 4 and all(t.splits for t in model.trees)


def test_tree_ranker_refuses_and_returns(spark, tmp_path):
    df = spark.createDataFrame([(float(i % 17), float(i % 17 > 8), 1.0) for i in range(120)] + [(None, 5.0, None), (1.0, None, 1.0)], "a double, y double, one double")
    assert trees.fit_ranker(df, ["a"], "y", n_trials=1, least=61) is None
    with pytest.raises(ValueError):
        trees.fit_ranker(df, ["a"], "y", n_trials=51)
    model = trees.fit_ranker(df, ["a", "one"], "y", n_trials=1, rounds=2, least=20)
    model.save(spark, str(tmp_path / "model"))
    again = trees.Ranker.load(spark, str(tmp_path / "model"))
    assert again == model and again.predict(df).filter("ml_pred_lo > ml_pred OR ml_pred > ml_pred_hi OR ml_pred IS NULL").count() == 0


def test_quantiles_of_any_group(spark):
    r = random.Random(2)
    rows = [(r.choice(["a", None]), None if r.random() < 0.1 else r.choice([1.0, 1.0, r.random(), -0.5])) for _ in range(2000)] + [("one", 3.0), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(6)
    ps = [0.0, 0.01, 0.33, 0.5, 0.8, 0.999, 1.0]
    want = {x.k: (x.n, x.q) for x in df.groupBy("k").agg(F.count("v").alias("n"), F.percentile("v", F.array(*map(F.lit, ps))).alias("q")).collect() if x.n}
    got = {x.k: (x.n, x.quantiles) for x in quantiles.exact_quantiles(df, "v", ps, ["k"]).collect()}
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and np.allclose(got[k][1], want[k][1], atol=1e-12) for k in want)
    whole = quantiles.robust_cuts(df, "v").first()
    values = np.array([v for _, v in rows if v is not None])
    assert np.allclose([whole.median, whole.mad, whole.low, whole.high], [np.median(values), np.median(abs(values - np.median(values))), *np.quantile(values, [0.01, 0.99])])
    assert quantiles.exact_quantiles(df.limit(0), "v", ps).collect() == []


def test_proposed_weights_from_data(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(150, 2))
    y = 0.5 * x[:, 0] - 0.2 * x[:, 1]
    df = spark.createDataFrame([(float(a), None if i == 3 else float(b), float(c)) for i, ((a, b), c) in enumerate(zip(x, y))], "a double, b double, y double")
    x[3, 1] = 0.0
    beta = np.clip(np.linalg.solve(x.T @ x + np.eye(2), x.T @ y), 0, None)
    assert beta[1] == 0
    current = {"value": 0.55, "growth": 0.45}
    new = models.propose_weights(df, {"value": "a", "growth": "b"}, "y", current)
    raw = {"value": 0.8 * 0.55 + 0.2, "growth": 0.8 * 0.45}
    assert all(abs(new[k] - raw[k] / sum(raw.values())) < 1e-12 for k in raw)
    assert models.propose_weights(df.limit(99), {"value": "a", "growth": "b"}, "y", current) is None


# Series and panels


def test_sliced_asof_join_is_the_plain_one(spark):
    r = random.Random(6)
    left = spark.createDataFrame([(r.choice(["hot", "hot", "hot", "b", None]), r.randrange(300), i) for i in range(800)], "k string, t int, i int").repartition(5)
    right = spark.createDataFrame([(r.choice(["hot", "hot", "b", "c", None]), r.randrange(300), float(i), i) for i in range(300)], "k string, t int, v double, tie int").repartition(3)
    key = lambda df: sorted(map(str, df.collect()))
    plain, sliced = (f(left, right, ["k"], "t", ["v"], "tie") for f in (pit.asof_join, pit.asof_join_sliced))
    assert key(plain) == key(sliced) and sliced.filter("v IS NULL").count() < 200
    assert pit.asof_join_sliced(left.limit(0), right, ["k"], "t", ["v"], "tie").collect() == []
    assert pit.asof_join_sliced(left, right.limit(0), ["k"], "t", ["v"], "tie").filter("v IS NULL").count() == 800


@pytest.mark.parametrize("n", [1, 2, 5, 8, 13])
def test_joined_drawdowns_are_those_of_whole_windows(spark, n):
    r = random.Random(n)
    rows = [(t, i, None if r.random() < 0.2 else r.choice([-1.0, 5.0, 10 * r.random()]) if t == "x" else 100 * r.random()) for t in "xy" for i in range(40)]
    df = spark.createDataFrame(rows, "ticker string, session_idx int, close double")
    known = df.withColumn("p", F.when(F.col("close") > 0, F.col("close")))
    w = panel.last(n)
    want = known.withColumn("d", deepest_drawdown(F.collect_list(F.struct(F.col("p").alias("x"))).over(w)["x"]))
    got = panel.trailing_drawdown(df, "close", n, "d")
    key = lambda x: {(r.ticker, r.session_idx): r.d for r in x.collect()}
    a, b = key(got), key(want)
    assert a.keys() == b.keys() and all((a[k] is None) == (b[k] is None) and (a[k] is None or abs(a[k] - b[k]) < 1e-12) for k in a)


def test_variance_is_the_recurrence(spark):
    rng = np.random.default_rng(3)
    r = {"a": rng.normal(0, 0.01, 2500), "b": rng.normal(0, 0.02, 7)}
    df = spark.createDataFrame([(k, i, float(v)) for k, x in r.items() for i, v in enumerate(x)], "s string, t int, r double")
    fits = spark.createDataFrame([("a", 0.08, 0.97, 0.02), ("b", 0.1, 0.5, 0.3)], "s string, alpha double, beta double, omega double")
    got = {x.s: x.variance for x in models.garch_variance(df, fits, "s", "t", "r").collect()}
    for s, alpha, beta, omega in fits.collect():
        x = 100 * r[s]
        v = x.var(ddof=1)
        for y in x:
            v = omega + alpha * y * y + beta * v
        assert abs(got[s] - v) < 1e-9


def test_rolling_regressions_are_refits(spark):
    rng = np.random.default_rng(9)
    n = 90
    level, x = np.exp(np.cumsum(0.01 * rng.normal(size=n))) * 100, rng.normal(size=n)
    days = [D(2024, 1, 1) + dt.timedelta(days=i) for i in range(n)]
    df = spark.createDataFrame([("a", d, float(v), float(e)) for d, v, e in zip(days, level, x)] + [("b", d, float(v), 1.0) for d, v in zip(days, level)], "s string, d date, v double, x double")
    for exog in ("x", None):
        got = {(r.s, r.origin): r for r in macro.rolling_forecasts(df, "d", "v", exog, 5, 10, 60, ["s"]).collect()}
        assert len(got) == 20
        for i in range(n - 15, n - 5):
            want = macro.arx(np.log(level[: i + 1]), x[: i + 1] if exog else None, 5)[0]
            r = got["a", str(days[i])]
            assert abs(r.model - np.exp(want)) < 1e-6 and abs(r.walk - level[i]) < 1e-9 and abs(r.actual - level[i + 5]) < 1e-9
            flat = macro.arx(np.log(level[: i + 1]), None, 5)[0]
            assert abs(got["b", str(days[i])].model - np.exp(flat)) < 1e-6  # a constant says nothing


def test_backtests_of_several_portfolios(spark):
    r = random.Random(8)
    rows = [(p, D(2024, m, 1), t, 0.5, r.uniform(-0.2, 0.2), 0.1, D(2024, m, 20)) for p in "ab" for m in range(1, 10) for t in "xy"]
    pos = spark.createDataFrame(rows, "p string, as_of date, ticker string, weight double, ret double, turnover double, exit date")
    levels = spark.createDataFrame([(D(2024, m, 20), 100.0 + m) for m in range(1, 10)], "session date, level double")
    both = backtest.equity(pos, 10.0, "p")
    m = {x.p: x for x in backtest.metrics(both, pos, 200, backtest.benchmark_returns(both, levels, pos, "p"), ["p"]).collect()}
    deep = {x.p: x for x in backtest.deepest(both, "p").collect()}
    for p in "ab":
        one = pos.filter(F.col("p") == p).drop("p")
        curve = backtest.equity(one, 10.0)
        want = backtest.metrics(curve, one, 200, backtest.benchmark_returns(curve, levels, one)).first().asDict()
        assert all(m[p][k] == v or abs(m[p][k] - v) < 1e-12 for k, v in want.items())
        assert deep[p].max_drawdown == backtest.deepest(curve).first().max_drawdown


def test_backtest_reads_its_tables_once(spark, small):
    """What the metrics are made of are small stored tables: six scans at most, and none of the lines."""
    plan = catalog.QUERIES["backtest_metrics"](spark, small)._jdf.queryExecution().executedPlan().toString()
    initial = plan.split("Initial Plan")[-1]
    assert initial.count("FileScan parquet") <= 6 and "lineitem" not in initial


def test_features_read_their_lines_once(spark, small):
    for name in ("price_features", "daily_features"):
        plan = catalog.QUERIES[name](spark, small)._jdf.queryExecution().analyzed().toString()
        assert "l_extendedprice" not in plan


def test_leaks_are_found_by_column(spark):
    df = spark.createDataFrame([(k, D(2024, 1, d), float(d * d)) for k in "ab" for d in range(1, 15)], "k string, d date, v double")
    w = Window.partitionBy("k").orderBy("d")
    compute = lambda x: x.withColumns({"past": F.col("v") - F.lag("v").over(w), "ahead": F.lead("v").over(w), "whole": F.avg("v").over(Window.partitionBy("k"))}).drop("v")
    assert {r.feature: r.unstable for r in checks.unstable_columns(compute, df, "d", ["k", "d"], 5).collect()} == {"past": False, "ahead": True, "whole": True}


# Chunks, citations, guards


def plain_chunks(text, most, overlap):
    """Line by line, as the rules are told."""
    found, buf, table = [], [], False

    def flush():
        joined = "\n".join(buf).strip()
        if joined:
            found.append(joined)
        buf.clear()

    for line in text.strip().replace("\r\n", "\n").split("\n"):
        bar = "|" in line or re.match(r"\s*[-+]{3}", line)
        if bar and not table or table and not bar:
            flush()
        table = bool(bar)
        if not bar and not line.strip():
            flush()
        else:
            buf.append(line)
    flush()
    size = lambda t: max(1, (len(t) + 1) // 2)
    out, section, now = [], "other", []
    for b in found:
        name = retrieval.heading(b)
        if name:
            if now:
                out.append((section, "\n\n".join(now).strip()))
            section, now = name, []
            continue
        parts = [b]
        if size(b) > most and "|" not in b:
            parts, run = [], ""
            for s in [x.strip() for x in b.replace("。", "。\0").split("\0") if x.strip()]:
                if run and size(run + s) > most:
                    parts.append(run)
                    run = s
                else:
                    run += s
            parts.append(run)
        for p in parts:
            if now and sum(map(size, now)) + size(p) > most:
                out.append((section, "\n\n".join(now).strip()))
                keep, got = [], 0
                while now and got < max(overlap, 1):
                    keep.insert(0, now.pop())
                    got += size(keep[0])
                now = keep
            now.append(p)
    if now:
        out.append((section, "\n\n".join(now).strip()))
    return out


def test_chunks_of_whole_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    found: dict = {}
    for r in retrieval.chunks(docs, most=60, overlap=12).orderBy("doc_id", "chunk_no").collect():
        found.setdefault(r.doc_id, []).append((r.section, r.text))
    for d in docs.collect():
        assert found.get(d.doc_id, []) == plain_chunks(d.text or "", 60, 12)


def test_chunk_rules():
    text = "Item 7 Management's Discussion\n\n売上は増えた。" + "あ" * 30 + "。" + "い" * 30 + "。終わり。\n\n| a | b |\n---\n| 1 | 2 |\nafter the table\n\n# 今後の見通し\n\nnext year"
    got = [(c["section"], c["text"]) for c in retrieval.chunk_text(text, 20, 5)]
    assert got == plain_chunks(text, 20, 5)
    assert got[-1] == ("outlook", "next year") and {s for s, _ in got} == {"mdna", "outlook"}
    assert any("| a | b |\n---\n| 1 | 2 |" in t for _, t in got) and retrieval.chunk_text(None) == retrieval.chunk_text("  \n ") == []
    assert retrieval.heading("第1章 事業等のリスク") == "risk_factors" and retrieval.heading("a sentence。") is None and retrieval.heading("## x\nmore") == "other"


def test_chunks_by_sql(spark):
    checks.register(spark)
    rows = spark.sql("SELECT * FROM chunks(TABLE(SELECT 7L AS doc_id, 'one\\n\\ntwo' AS text UNION ALL SELECT 8L, CAST(NULL AS STRING)))").collect()
    assert [(r.doc_id, r.chunk_no, r.section, r.text) for r in rows] == [("7", 0, "other", "one\n\ntwo")]


def test_sessions_keep_their_settings(spark, small):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    for name in ("vector_search", "document_chunks"):
        catalog.QUERIES[name](spark, small)
    assert spark.conf.get(key) == before


def scanned_verdict(quote, source, least=0.9):
    q, s = retrieval._flat(quote), retrieval._flat(source)
    if q in s:
        return "VERIFIED"
    width = max(len(q), 8)
    for i in range(0, max(1, len(s) - width + 1), max(1, width // 4)):
        if difflib.SequenceMatcher(None, s[i : i + width], q, autojunk=False).ratio() >= least:
            return "VERIFIED_FUZZY"
    return "QUOTE_NOT_FOUND"


def test_citations_are_those_of_the_scan():
    r, kinds = random.Random(3), set()
    for _ in range(400):
        source = words(r, r.randrange(0, 120))
        i = r.randrange(len(source) + 1)
        quote = edited(r, source[i : i + r.randrange(1, 50)], r.randrange(4))
        want = scanned_verdict(quote, source)
        kinds.add(want)
        assert retrieval.citation_verdict(quote, source) == want
    assert len(kinds) == 3


def test_citation_query_has_all_verdicts(spark, small):
    found = {r.verdict for r in catalog.QUERIES["citation_checks"](spark, small).collect()}
    assert found >= {"VERIFIED", "VERIFIED_FUZZY", "QUOTE_NOT_FOUND", "DOC_NOT_FOUND"}


def test_guards_and_ids(spark):
    nested = spark.createDataFrame([(1, ("x", 2), [(3.0,)], {"a": (1,)})], "id int, portfolio struct<Shares:string,n:int>, positions array<struct<avg_cost:double>>, m map<string,struct<cash:int>>")
    assert normalizers.sensitive_fields(nested) == ["portfolio.Shares", "positions[].avg_cost", "m{}.cash"]
    texts = ['{"a": [{"QTY": 1}, {"b": {"nisa" : 2}}]}', '{"cash_flow": 1, "x": "cash: 1"}', None, "not json", r'{"a\"cash": 1}']
    found = spark.createDataFrame([(t,) for t in texts], "t string").select(normalizers.sensitive_keys(F.col("t")).alias("k")).collect()
    assert [r.k for r in found] == [["nisa", "qty"], [], [], [], []]
    p = spark.createDataFrame([(1, "first"), (99999, "x"), (100001, "x"), (100009, None), (None, "決算短信")], "seq long, title string")
    ids = {r.doc_id: r.doc_type for r in normalizers.disclosures(p, "2024-01-05").collect()}
    assert set(ids) == {f"tdnet:20240105-{k}" for k in ("0001", "99999", "100001", "100009", "0000")} and ids["tdnet:20240105-0000"] == "earnings_flash"
    v = spark.createDataFrame([("a", 30.0, 1.26), ("b", 10.0, None), ("c", None, 0.0)], "ticker string, market_value double, unrealized_pnl_pct double")
    assert {r.ticker: tuple(r)[1:] for r in normalizers.redacted_positions(v).collect()} == {"a": (75.0, 1.3), "b": (25.0, 0.0), "c": (0.0, 0.0)}

"""Work that stays in proportion where texts are long, copies many and ties open."""

import datetime as dt
import difflib
import inspect
import random
import time

import numpy as np
from pyspark.sql import Window, functions as F

from plumbline import catalog, staging
from plumbline.operators import checks, readers, retrieval, similarity, trees
from plumbline.operators.vector_index import VectorIndex


def prose(r, n):
    return " ".join("".join(r.choice(("th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha")) for _ in range(r.randrange(1, 4))) for _ in range(n))


def test_long_quotes_are_told_in_little_time():
    """Windows of another text share nearly all characters and most pairs with the quote; each took difflib tenths of a second."""
    r = random.Random(1)
    source, quote = prose(r, 9000), prose(r, 350)
    start = time.monotonic()
    assert retrieval.citation_verdict(quote, source) == "QUOTE_NOT_FOUND"
    at = source.index(" ", 20_000)
    near = source[at : at + 1600]
    assert retrieval.citation_verdict("#" + near[:700] + "#" + near[701:], source) in ("VERIFIED_FUZZY", "QUOTE_NOT_FOUND")
    assert time.monotonic() - start < 4


def test_likeness_is_that_of_difflib():
    r, kinds = random.Random(2), set()
    for n in (0, 1, 30, 200, 500):
        for _ in range(12):
            a = prose(r, n)[: r.choice((64, 200, 500, 1500))]
            b = list(a)
            for _ in range(r.randrange(1 + len(b) // 12)):
                i, j = r.randrange(len(b) + 1), r.randrange(1, 6)
                b[i : i + r.randrange(j)] = b[j : j + r.randrange(j)]
            b = "".join(b)
            m = difflib.SequenceMatcher(None, a, b, autojunk=False)
            for least in (0.8, 0.9, 0.97):
                kinds.add(want := m.ratio() >= least)
                assert retrieval._resembles(a, b, least) == want
            if a and b:
                assert retrieval._longest(a, b) == tuple(m.find_longest_match())
    assert kinds == {True, False}


def test_copies_of_lessons_are_compared_once(spark, monkeypatch):
    """Copies on both sides pair texts, not rows, and each lesson still has what a double loop finds."""
    texts = ["large ring LARGE Brand#1", "large ring LARGE Brand#12", "hot bolt SMALL Brand#3", "cold plate MEDIUM Brand#21", None]
    old = [(k, texts[k % 5], 5 * (k % 4), k % 3 != 0) for k in range(60)]
    new = [(1000 + k, (texts[0], "large ring LARGE Brand#13", "hot bolts SMALL Brand#3", "nothing like it", None, "")[k % 6], 8 + k % 9) for k in range(60)]
    seen = []
    whole = similarity.similar_texts
    monkeypatch.setattr(similarity, "similar_texts", lambda *a: seen.append(found := whole(*a)) or found)
    old_df = spark.createDataFrame(old, "memory_id long, text string, n_observations long, is_active boolean")
    made = similarity.lesson_updates(old_df, spark.createDataFrame(new, "lesson_id long, text string, n_observations long"))
    got = {r.lesson_id: (r.decision, r.memory_id, r.ratio) for r in made.collect()}
    want = {}
    for i, text, n in new:
        ratios = [(-difflib.SequenceMatcher(None, t or "", text or "").ratio(), m, k) for m, t, k, active in old if active]
        ratio, memory, k = min(ratios)
        want[i] = ("refused", None, None) if n < 10 else ("added", None, None) if -ratio < 0.85 else ("superseded" if n > k else "known", memory, -ratio)
    assert got == want and {d for d, _, _ in want.values()} >= {"refused", "added", "superseded"}
    assert seen[0].count() <= 25


def test_long_equal_lessons_have_ratio_1(spark):
    """Though difflib passes over frequent characters of long texts."""
    for text in ("a" * 300, "ab" * 150 + "c", prose(random.Random(3), 200)):
        assert difflib.SequenceMatcher(None, text, text).ratio() == 1
    old = spark.createDataFrame([(1, "a" * 300, 1, True), (2, "b" * 50, 1, True)], "memory_id long, text string, n_observations long, is_active boolean")
    new = spark.createDataFrame([(7, "a" * 300, 20), (8, "b" * 50, 20)], "lesson_id long, text string, n_observations long")
    assert {r.lesson_id: (r.memory_id, r.ratio) for r in similarity.lesson_updates(old, new).collect()} == {7: (1, 1.0), 8: (2, 1.0)}


def test_stability_stores_and_joins_nothing(spark):
    """Rows that go or come, values that turn null and signs of 0 by column, from sums alone: no table is stored for it."""
    rows = [(k, dt.date(2024, 1, d), float(d % 3), 0.0) for k in "ab" for d in range(1, 15)]
    df = spark.createDataFrame(rows, "k string, d date, v double, zero double")
    whole = Window.partitionBy("k")

    def compute(x):
        last = F.max("d").over(whole)
        return x.select("k", "d", "v", (F.col("zero") * F.when(last > F.lit("2024-01-14").cast("date"), -1.0).otherwise(1.0)).alias("sign"), F.when(last <= F.lit("2024-01-14").cast("date"), 1).alias("nulled"))

    made = len(staging._made)
    found = checks.unstable_columns(compute, df, "d", ["k", "d"], 5)
    assert "FullOuter" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert {r.feature: r.unstable for r in found.collect()} == {"v": False, "sign": False, "nulled": True}
    gone = lambda x: compute(x).withColumn("last", F.max("d").over(whole)).filter("d < last OR k = 'a'").drop("last")
    assert all(r.unstable for r in checks.unstable_columns(gone, df, "d", ["k", "d"], 5).collect())
    assert len(staging._made) == made


def test_a_list_is_a_file_whatever_the_tasks(spark, tmp_path):
    rows = spark.createDataFrame([(i, i, [float(i % 7), 1.0, float(i % 5)]) for i in range(600)], "chunk_id long, doc_id long, embedding array<double>").repartition(6)
    index = VectorIndex(spark, str(tmp_path / "index")).build(rows, 12)
    assert len(list((tmp_path / "index/rows").rglob("*.parquet"))) <= 13 and index.count() == 600


def test_tied_codes_are_chosen_alike_in_any_partitions(spark):
    rows = [("1003", "JP", f"name {i % 7}", f"sector{'x' * (i % 9)}", dt.date(2024, 1, 1)) for i in range(63)] + [("10030", "JP", None, "y", dt.date(2024, 1, 1))]
    df = spark.createDataFrame(rows, "ticker string, market string, name string, sector string, valid_from date").withColumns({"score": F.length("sector"), "rec_id": F.col("ticker")})
    one, many = set(), set()
    for r in (df.coalesce(1), df.orderBy(F.desc("name"), "sector").coalesce(1), df.orderBy(F.desc("sector")).repartition(5)):
        one.add(tuple(readers.resolve_all(r).first()))
        many.add(tuple(readers.cards_by_issuer(r.filter("length(ticker) = 4").drop("rec_id"), r.filter("length(ticker) = 5")).first()))
    assert len(one) == len(many) == 1 and next(iter(one))[2] == "name 0"


def test_trees_walk_many_rows_at_once(spark):
    """The walk in numpy ends in the leaves of the expression, and a prediction's plan repeats no bin for each branch."""
    tree = trees.Tree({0: (0, 3), 1: (1, 0), 2: (0, 7), 5: (1, 2)}, {k: float(k) for k in (3, 4, 6, 11, 12)})
    rows = [(a, b) for a in range(10) for b in range(5)]
    want = [r[0] for r in spark.createDataFrame(rows, "a int, b int").select(tree.node([F.col("a"), F.col("b")])).collect()]
    assert tree.nodes([np.array(x) for x in zip(*rows)]).tolist() == want and set(want) == set(tree.values)
    model = trees.Ranker(["a", "b"], [[float(i) for i in range(63)]] * 2, 0.5, 0.1, [tree], {k: [-1.0, 1.0] for k in tree.values}, 1)
    plan = model.predict(spark.createDataFrame(rows, "a int, b int"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("CASE WHEN") < 20


def test_the_ranker_query_grows_all_its_trees(spark, small, monkeypatch):
    """No argument of the query leaves it a few shallow trees: 200 rounds of depth 6, as in the source."""
    asked, real = {}, inspect.signature(trees.fit_ranker)

    def fit(*args, **named):
        call = real.bind(*args, **named)
        call.apply_defaults()
        asked.update(call.arguments)

    monkeypatch.setattr(trees, "fit_ranker", fit)
    assert catalog.QUERIES["tree_ranker"](spark, small).count()
    assert asked["rounds"] >= 200 and asked["depth"] >= 6 and 1 - (1 - asked["step"]) ** asked["rounds"] > 0.99


def test_trees_go_on_from_what_is_stored(spark, monkeypatch):
    """Rounds beyond those after which what is left is stored, by tasks of few rows, are the rounds of a plain loop; what was stored goes."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(2000, 2))
    y = np.sign(x[:, 0]) + x[:, 1] ** 2
    df = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y)], "a double, b double, y double").repartition(5)
    edges = [np.linspace(-2, 2, 31).tolist()] * 2
    monkeypatch.setattr(trees, "FEW", 300)
    fits = []
    for store in (2, 50):
        monkeypatch.setattr(trees, "STORE", store)
        made = len(staging._made)
        fits.append(trees.fit_ranker(df, ["a", "b"], "y", n_trials=1, rounds=7, depth=3, least=50, edges=edges))
        assert not [p for p in staging._made[made:] if "ranker-left" in p]
    assert [t.splits for t in fits[0].trees] == [t.splits for t in fits[1].trees] and len(fits[0].trees) == 7
    bins = np.stack([1 + np.searchsorted(e, x[:, k]) for k, e in enumerate(edges)])
    left = y - y.mean()
    for t in fits[0].trees:
        leaf = t.nodes(bins)
        for k in t.values:
            assert np.isclose(t.values[k], left[leaf == k].sum() / ((leaf == k).sum() + 1))
        left = left - 0.1 * t.told(bins)
    assert np.allclose(y - left, fits[0].means(bins))

"""Mixes of rows whose ids do not tell them apart."""

import random

import pytest
from pyspark.sql import functions as F

from plumbline.llm.common import running
from plumbline.llm.mixing import mix_sources


def rows_of(kind):
    r = random.Random(5)
    ids = {"null": lambda i: None, "one": lambda i: 7, "few": lambda i: i % 5, "own": lambda i: i}[kind]
    return [(ids(i), " ".join(["w"] * r.randrange(12)) + f" t{r.randrange(300)}" if i % 9 else None, f"s{i % 3}") for i in range(600)]


@pytest.mark.parametrize("kind", ["null", "one", "few", "own"])
def test_reruns_agree_in_any_order(spark, kind):
    """The same rows in two orders and partitionings; ids null, all the same, repeated, and distinct."""
    rows = rows_of(kind)
    again = rows[:]
    random.Random(9).shuffle(again)
    frame = lambda x, n: spark.createDataFrame(x, "doc_id long, text string, source string").repartition(n)
    found = [sorted(map(str, mix_sources(frame(x, n)).collect())) for x, n in ((rows, 3), (again, 11))]
    assert found[0] == found[1] and len(found[0]) == 600
    total = mix_sources(frame(rows, 3)).groupBy("target", "source_size").agg(F.sum("taken").alias("taken"), F.max("size").alias("most")).collect()
    assert all(abs(t.taken - t.target) <= 2 * t.most + 1 for t in total)


def test_many_sources_of_any_size(spark):
    """More sources than partitions, some of them without words."""
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 != 3, F.repeat(F.lit("w "), (F.col("id") % 40).cast("int"))).alias("text"), (F.col("id") % 97).cast("string").alias("source"))
    x = mix_sources(docs).collect()
    assert len(x) == 400 and all(r.taken <= 3 * r.size and r.target <= 3 * r.source_size for r in x)
    targets = {(r.source_size, r.target) for r in x}
    assert abs(sum(r.taken for r in x) - sum(r.size for r in x)) <= 1 and len(targets) > 50


def test_running_sums(spark):
    r = random.Random(1)
    rows = [(r.randrange(50), i, r.randrange(9)) for i in range(500)]
    got = {(x.a, x.b): (x.nth, x.s) for x in running(spark.createDataFrame(rows, "a int, b int, v int").repartition(7), ["a", "b"], {"s": F.col("v")}, "test").collect()}
    total = 0
    for n, (a, b, v) in enumerate(sorted(rows), 1):
        total += v
        assert got[a, b] == (n, total)

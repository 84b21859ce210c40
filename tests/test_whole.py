"""Queries that take all rows and whole texts."""

from plumbline import catalog
from plumbline.sources import normalizers
from pyspark.sql import functions as F


def test_all_incoming_rows_are_upserted(spark, small, duck):
    changed = {r.c_custkey for r in catalog.QUERIES["upsert_orders"](spark, small).collect()}
    assert changed == {k for (k,) in duck.execute("SELECT c_custkey FROM customer UNION SELECT o_custkey FROM orders").fetchall()}
    cards = catalog.QUERIES["feed"](spark, small).agg(F.sum("cards")).first()[0]
    assert cards == duck.execute("SELECT count(*) FROM orders").fetchone()[0]


def test_titles_are_read_to_their_end(spark):
    texts = ["x" * 100 + " 自己株式の取得", "x" * 200 + "\n株式分割", "業績予想の上方修正", "nothing", None]
    found = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").select("doc_id", normalizers.title_type(F.col("text")).alias("t")).orderBy("doc_id").collect()
    assert [r.t for r in found] == ["buyback", "stock_split", "guidance_revision", "other_disclosure", "other_disclosure"]


def test_every_twentieth_vector_is_a_query(spark, small, duck):
    want = {k for (k,) in duck.execute("SELECT vec_id FROM embeddings WHERE vec_id % 20 = 0").fetchall()}
    for name in ("vector_search", "hybrid_search"):
        n = {r.query_id: r["count"] for r in catalog.QUERIES[name](spark, small).groupBy("query_id").count().collect()}
        assert set(n) == want and set(n.values()) == {10}

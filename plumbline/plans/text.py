"""Queries of lessons, vectors behind filters, citations and sensitive fields."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.operators import retrieval as R, similarity as S
from plumbline.operators.vector_index import VectorIndex, matches
from plumbline.plans.adapter import query, r6, table
from plumbline.sources import normalizers as N
from plumbline.staging import stored, work_dir

#: Parts described in words: nine of ten are memories, some of them inactive, the others lessons; observations are their sizes.
_LESSON_TEXT = ("p_name", "p_type", "p_brand")


def lessons(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    k = F.col("p_partkey")
    p = table(spark, sf, "part").select(k.alias("k"), F.concat_ws(" ", *_LESSON_TEXT).alias("text"), F.col("p_size").cast("long").alias("n_observations"))
    old = p.filter("k % 10 <> 0").select(
        F.col("k").alias("memory_id"), "text", "n_observations", (F.col("k") % 7 != 0).alias("is_active"),
        ((F.col("k") % 10) / 10).alias("hit_rate_before"), ((F.col("k") % 9) / 10).alias("hit_rate_after"), (F.col("k") % 40).alias("use_count"),
    )
    return old, p.filter("k % 10 = 0").select(F.col("k").alias("lesson_id"), "text", "n_observations")


@query("lesson_updates")
def lesson_updates(spark: SparkSession, sf: str) -> DataFrame:
    """What becomes of each new lesson beside the most similar active memory."""
    return S.lesson_updates(*lessons(spark, sf)).withColumn("ratio", r6("ratio"))


@query("forgotten_lessons", "SELECT p_partkey AS memory_id FROM part WHERE p_partkey % 10 <> 0 AND p_partkey % 9 / 10.0::DOUBLE < p_partkey % 10 / 10.0::DOUBLE - 0.05::DOUBLE AND p_partkey % 40 >= 20")
def forgotten_lessons(spark: SparkSession, sf: str) -> DataFrame:
    return S.forgotten(lessons(spark, sf)[0])


@query("vector_search_filtered", """SELECT query_id, vec_id, round(s, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS nth
  FROM (SELECT q.vec_id AS query_id, e.vec_id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 9) AS s FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0 AND e.label IN (1, 2, 3) AND e.vec_id >= 10) QUALIFY nth <= 10""")
def vector_search_filtered(spark: SparkSession, sf: str) -> DataFrame:
    """The exact form behind a filter of metadata: every twentieth vector against all that pass."""
    e = table(spark, sf, "embeddings")
    passing = e.filter(matches({"label": {"$in": [1, 2, 3]}, "vec_id": {"$gte": 10}}))
    return R.vector_top_each(passing, e.filter("vec_id % 20 = 0"), 10, "vec_id", "embedding").withColumn("score", r6("score"))


#: Rows of a list on average; beyond 65,536 rows lists grow as well as their number, by the square root of the rows.
LIST_ROWS, LISTS_ROOT = 64, 4


def index(spark: SparkSession, sf: str) -> VectorIndex:
    e = table(spark, sf, "embeddings").select(F.col("vec_id"), F.col("label").alias("doc"), "embedding")
    n = e.count()
    lists = max(4, min(n // LIST_ROWS, int(LISTS_ROOT * n**0.5)))
    return VectorIndex(spark, f"{work_dir(spark)}/vectors-{uuid.uuid4().hex}", "vec_id", "doc", "embedding").build(e, lists)


@query("vector_search_indexed")
def vector_search_indexed(spark: SparkSession, sf: str) -> DataFrame:
    """Every twentieth vector against the lists that are nearest to it, as many as a recall of 0.9 takes."""
    made = index(spark, sf)
    q = table(spark, sf, "embeddings").filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return made.search(q, 10, made.probes_for(10)).withColumn("score", r6("score"))


@query("sensitive_events", """SELECT event_id, array_to_string(list_sort(list_distinct(list_filter(['quantity', 'cash', 'shares'], lambda k: CASE event_id % 4 WHEN 0 THEN k = 'quantity' WHEN 1 THEN k IN ('cash', 'shares') ELSE false END))), ',') AS keys FROM events""")
def sensitive_events(spark: SparkSession, sf: str) -> DataFrame:
    """Payloads that tell quantities or balances at some depth; percentages and ordinary keys may pass."""
    i = F.col("event_id") % 4
    payload = F.when(i == 0, '{"portfolio": {"Quantity" : 3, "weight_pct": 2}}').when(i == 1, '[{"a": {"cash": 1}}, {"SHARES": 4}]').when(i == 2, '{"cash_flow": 1, "note": "cash: shares"}').otherwise(F.col("props"))
    return table(spark, sf, "events").select("event_id", F.array_join(N.sensitive_keys(payload), ",").alias("keys"))


@query("redacted_portfolio", """WITH v AS (SELECT o_custkey, o_orderpriority, sum(o_totalprice) AS mv, avg(o_totalprice) / 10000 AS pnl FROM orders GROUP BY ALL) SELECT o_custkey, o_orderpriority AS ticker, round(mv / sum(mv) OVER (PARTITION BY o_custkey) * 100, 1) AS weight_pct, round(pnl, 1) AS unrealized_pnl_pct FROM v""")
def redacted_portfolio(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "orders").groupBy("o_custkey", F.col("o_orderpriority").alias("ticker")).agg(F.sum("o_totalprice").alias("market_value"), (F.avg("o_totalprice") / 10000).alias("unrealized_pnl_pct"))
    return N.redacted_positions(v, "o_custkey")


@query("citation_checks")
def citation_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Each document's longest line as a quote: from itself, with two characters changed, from the next document, and from none."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    longest = F.array_max(F.transform(F.split("text", "\n"), lambda x: F.struct(F.length(x).alias("n"), x.alias("line"))))["line"]
    k = F.col("doc_id") % 4
    changed = F.overlay(F.overlay("line", F.lit("#"), 3), F.lit("#"), 9)
    claims = docs.select(F.col("doc_id").alias("claim_id"), "doc_id", longest.alias("line"))
    claims = claims.select("claim_id", F.when(k == 2, F.col("doc_id") + 1).when(k == 3, -1 - F.col("doc_id")).otherwise(F.col("doc_id")).alias("doc_id"), F.when(k == 1, changed).otherwise(F.col("line")).alias("quote"))
    return R.verify_citations(stored(claims, "claims"), docs).select("claim_id", "doc_id", "verdict")

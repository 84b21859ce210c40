"""Every operator over odd rows and over an empty table: a row for each row, whatever it holds."""

import pytest
from pyspark.sql import functions as F

from plumbline.llm import embedding_dedup, exact_dedup, html_text, language_id, mixing, packing, secret_scan, sharding, simhash, toxicity


def _languages(docs):
    return language_id.identify_languages(docs, language_id.learn_languages(docs, F.lit(True)))


def _toxic(docs):
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"), "text")
    return toxicity.score_toxicity(docs, toxicity.learn_toxicity(docs, labels, F.lit(True)))


OPERATORS = {
    "languages": _languages,
    "exact": exact_dedup.exact_dedup,
    "simhash": simhash.simhash_groups,
    "secrets": lambda d: secret_scan.find_secrets(d, secret_scan.learn_secrets(d)),
    "mixing": mixing.mix_sources,
    "sharding": sharding.shard_by_bytes,
    "toxicity": _toxic,
    "html": lambda d: html_text.extract_text(d, "doc_id", "source", "text"),
    "vectors": lambda d: embedding_dedup.embedding_groups(d.withColumn("vec", F.when(F.col("doc_id") > 2, F.array(F.col("doc_id").cast("float"), F.lit(1.0).cast("float")))), id_col="doc_id", vector_col="vec", group_col="source"),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(name, odd, none):
    found = OPERATORS[name](odd).collect()
    assert len(found) == odd.count()
    assert OPERATORS[name](none).collect() == []


def test_odd_pieces(odd, none):
    found = packing.pack(odd).toPandas()
    assert (found.piece == 0).sum() == odd.count() and packing.pack(none).collect() == []


def test_results_on_odd_rows(odd):
    exact = exact_dedup.exact_dedup(odd)
    sums = exact.groupBy("text_sha256").agg(F.sum(F.col("kept").cast("int")).alias("kept"), F.count(F.lit(1)).alias("n"), F.first("group_size").alias("g")).collect()
    assert all(r.kept == 1 and r.n == r.g for r in sums)
    blank = [r for r in simhash.simhash_groups(odd).collect() if set(r.fp) == {0}]
    assert {r.component_id for r in blank} == {0} and len(blank) == 5
    assert {r.lang_pred for r in _languages(odd).filter("doc_id IN (0, 1, 2)").collect()} == {"und"}
    assert all(r.taken <= 3 * r.size for r in mixing.mix_sources(odd).collect())


@pytest.mark.parametrize("stage", range(5))
def test_stages_on_odd_rows(stage, odd, none, spark, small):
    """Rows of a stage are rows that it was given; an empty table stays empty, with the columns of documents."""
    import corpus_pipeline as P

    name, run = P.STAGES[stage]
    docs = odd.select(*P.DOCUMENT_COLUMNS)
    found = run(spark, docs, small).collect()
    assert run(spark, none.select(*P.DOCUMENT_COLUMNS), small).collect() == []
    if stage == 4:
        assert sum(r.piece == 0 for r in found) == odd.count()
        return
    given = [tuple(map(str, r)) for r in docs.collect()]
    assert found and all(tuple(map(str, r)) in given for r in found)
    texts = lambda rows: {r.text for r in rows}
    letters = {t for t in texts(docs.collect()) if any(c.isalpha() for c in t or "")}
    if name == "language_id":
        assert texts(found) == letters
    if name == "exact_dedup":
        assert len(found) == len({t or "" for t in texts(docs.collect())})
    if name == "simhash":
        assert letters <= texts(found)
    if name == "mixing":
        assert texts(found) <= texts(docs.collect())

"""From raw documents to packed sequences: five stages, each over all rows that the one before it kept.

Each row has its own fate, whatever its id: rows are told apart by id and text, and decisions are joined on both. Null ids
come last where the smallest id stays. In every stage a null text counts as empty, nulls in other columns change nothing,
columns besides those of documents are not read, and an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from plumbline.llm.common import DOCUMENT_COLUMNS, body, discard, keep, scratch, stored, table
from plumbline.llm.exact_dedup import exact_dedup
from plumbline.llm.language_id import UNKNOWN, identify_languages, learn_languages
from plumbline.llm.mixing import mix_sources
from plumbline.llm.near_dedup import near_copies
from plumbline.llm.packing import pack

#: A document stays if its main language has at least this part of its letters.
MAIN_LANGUAGE = 1 / 3


def _key(sha: Column) -> Column:
    """Tells rows with another id or another text apart; a null text counts as empty."""
    return F.sha2(F.concat(F.coalesce(F.concat(F.lit("="), F.col("doc_id").cast("string")), F.lit("")), F.lit("\n"), sha), 256)


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(*DOCUMENT_COLUMNS, _key(F.sha2(body("text"), 256)).alias("key"))


def _repeated(docs: DataFrame) -> bool:
    """Whether rows repeat both id and text."""
    return docs.groupBy("key").count().filter("count > 1").limit(1).count() > 0


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` without the keys of ``gone``, a stored table: Spark knows its size and broadcasts it only if it is small."""
    gone = stored(gone.select(F.col("key").alias("gone")).distinct(), "gone")
    return docs.join(gone, F.col("key") == F.col("gone"), "left_anti")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or without a main language, go: null, empty and blank texts, too. Rows that repeat stay repeated."""
    rows = _keyed(docs)
    found = identify_languages(rows, learn_languages(docs, F.lit(True)), id_col="key")
    return _without(rows, found.filter((F.col("lang_pred") == UNKNOWN) | (F.col("score") < MAIN_LANGUAGE))).select(*DOCUMENT_COLUMNS)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the smallest id stays, once; null and empty texts are equal."""
    found = stored(exact_dedup(docs), "exact-verdicts")
    again = ~F.col("kept") & F.col("doc_id").eqNullSafe(F.col("keep_id"))
    repeated = found.filter(again).limit(1).count() > 0
    out = _without(_keyed(docs), found.filter(~F.col("kept") & ~again).select(_key(F.col("text_sha256")).alias("key")))
    return (out.dropDuplicates(["key"]) if repeated else out).select(*DOCUMENT_COLUMNS)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near duplicates (sets of five-word shingles, Jaccard similarity 0.8 or more) the document with the smallest id stays.
    A text of fewer than five words is one shingle; texts without words are equal; of rows that repeat one stays."""
    rows = _keyed(docs)
    if _repeated(rows):
        rows = rows.dropDuplicates(["key"])
    return _without(rows, near_copies(rows, width=5, similarity=0.8)).select(*DOCUMENT_COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document appears as often as the mix takes it, wholly or in part; documents that it does not take go, as do those
    without words. A null source is a source."""
    rows = _keyed(docs)
    if _repeated(rows):  # rows that agree in all these columns are interchangeable
        nth = F.row_number().over(Window.partitionBy("key").orderBy("source", "lang", "n_chars", "text"))
        rows = stored(rows.withColumn("key", F.concat_ws(":", "key", nth)), "mix-rows")
    taken = mix_sources(rows, id_col="key").filter("taken > 0").select(F.col("key").alias("id"), F.ceil(F.col("taken") / F.col("size")).cast("int").alias("times"))
    out = rows.join(taken, F.col("key") == F.col("id"))
    return out.withColumn("turn", F.explode(F.sequence(F.lit(1), "times"))).select(*DOCUMENT_COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences of 2048 tokens; an empty text is its separator alone."""
    return pack(docs)


STAGES = [
    ("language_id", language_stage),
    ("exact_dedup", exact_stage),
    ("simhash", near_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*DOCUMENT_COLUMNS)
    before = None
    for name, stage in STAGES[:-1]:
        with scratch(spark):  # what a stage stores on its way goes with it
            docs = keep(stored(stage(spark, docs, sf_dir), f"stage-{name}"))
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)


#: Random hashes and models: SQL cannot express the stages; tests compare them with brute force.
ORACLE_SQL = None

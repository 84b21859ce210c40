"""Line dedup: two Bloom filters find lines that may repeat; only these shuffle and are confirmed by their whole text."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.llm.common import body, keep, scratch, stored, table
from plumbline.session import ship

SPACES = b" \t\n\x0b\x0c\r"
LATER = bytes(range(0x80, 0xC0))  # bytes that continue a code point
#: Hashes that a pair of filters takes on average, bits a hash, bits set a hash.
PER_FILTER, BITS, PROBES = 1 << 20, 12, 4
#: All twice-seen filters together have at most so many bytes: what the driver and each worker hold.
FILTER_BYTES = 64 << 20
#: Hashes that a task of the first pass gathers before it merges equal ones.
GATHERED = 1 << 21


def keys_of(data: bytes, least: int) -> list[tuple[bytes, int]]:
    """The keys (stripped, A-Z lower-cased) of ``least`` code points or more and the numbers of their lines."""
    out = []
    for k, line in enumerate(data.lower().split(b"\n")):  # bytes.lower changes A-Z only
        key = line.strip(SPACES)
        if len(key) >= least and (key.isascii() or len(key.translate(None, LATER)) >= least):
            out.append((key, k))
    return out


def probes(h: np.ndarray, size: int | np.ndarray) -> list[np.ndarray]:
    """Places of each 64-bit hash in a filter of ``size`` bits."""
    x = h.view("u8")
    a, b = (x ^ x >> np.uint64(33)) * np.uint64(0xFF51AFD7ED558CCD), (x ^ x >> np.uint64(29)) * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1)
    return [((a + np.uint64(i) * b) >> np.uint64(20)) % np.asarray(size, "u8") for i in range(PROBES)]


def _hashes(least: int) -> Callable:
    """Texts to (h, many): equal hashes of what a task has gathered merge, so that a frequent line leaves a task a few times."""

    def merged(found: list[np.ndarray]) -> pa.RecordBatch:
        h, n = np.unique(np.concatenate(found), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(h), pa.array(n > 1)], ["h", "many"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, n = [], 0
        for x in batches:
            for data in x["body"]:
                keys = {key for key, _ in keys_of(data.as_py(), least)}
                found.append(np.fromiter(map(xxhash.xxh64_intdigest, keys), "u8", len(keys)).view("i8"))
                n += len(keys)
                if n >= GATHERED:
                    yield merged(found)
                    found, n = [], 0
        if n:
            yield merged(found)

    return run


def _filters(parts: int, once_bits: int, twice_bits: int) -> Callable:
    """(h, many) to (part, bits of its twice-seen filter). A task holds the two filters of its parts and streams the rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for x in batches:
            all_h, all_many = x["h"].to_numpy(zero_copy_only=False), x["many"].to_numpy(zero_copy_only=False)
            of = all_h % parts
            for part in np.unique(of).tolist():
                once, twice = filters.setdefault(part, (np.zeros(once_bits, bool), np.zeros(twice_bits, bool)))
                h, at, n = np.unique(all_h[of == part], return_inverse=True, return_counts=True)
                many = n > 1
                np.logical_or.at(many, at, all_many[of == part])
                places = probes(h, once_bits)
                again = h[many | np.logical_and.reduce([once[p] for p in places])]
                for p in places:
                    once[p] = True
                for p in probes(again, twice_bits):
                    twice[p] = True
        for part, (_, twice) in filters.items():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([np.packbits(twice).tobytes()], pa.binary())], ["part", "bits"])

    return run


def _suspects(twice: Any, parts: int, twice_bits: int, least: int) -> Callable:
    """Texts to a row for each of their keys that the filters may have seen twice: id, mark, key, its line numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(twice.value, "u1")
        for x in batches:
            rows, keys, lines = [], [], []
            for i, data in enumerate(x["body"]):
                found: dict[bytes, list[int]] = {}
                for key, k in keys_of(data.as_py(), least):
                    found.setdefault(key, []).append(k)
                rows += [i] * len(found)
                keys += found
                lines += found.values()
            h = np.fromiter(map(xxhash.xxh64_intdigest, keys), "u8", len(keys)).view("i8")
            start = (h % parts).astype("u8") * np.uint64(twice_bits)
            seen = np.ones(len(h), bool)
            for p in probes(h, twice_bits):
                at = start + p
                seen &= (bits[at >> np.uint64(3)] >> (7 - (at & np.uint64(7))).astype("u1") & 1).astype(bool)
            hit = np.flatnonzero(seen)
            row = pa.array(np.asarray(rows, "i8")[hit])
            columns = [x["id"].take(row), x["mark"].take(row), pa.array([keys[i] for i in hit], pa.binary()), pa.array([lines[i] for i in hit], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "mark", "key", "at"])

    return run


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for x in batches:
        total, dropped, kept = [], [], []
        for data, gone in zip(x["body"], x["gone"]):
            data, gone = data.as_py(), set(gone.as_py() or ())
            n = data.count(b"\n") + 1
            total.append(n)
            dropped.append(len(gone))
            kept.append(b"\n".join(line for k, line in enumerate(data.split(b"\n")) if k not in gone) if gone else data)
        yield pa.RecordBatch.from_arrays([x["id"], pa.array(total, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.binary())], ["id", "n_lines", "n_dropped", "kept"])


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 20, least_docs: int = 3, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """One row per row of ``docs``: id, n_lines (before dropping), n_dropped, kept (the text that is left).

    A line's key is the line without white space at its ends, A-Z lower-cased. Keys of ``least_chars`` code points or more
    that at least ``least_docs`` rows hold lose all their lines but those of the largest id (all rows that have it; a null
    id is the smallest). A key counts once a row, however often the row repeats it. Null and empty texts have one empty line.

    1. Each task turns its texts into 64-bit hashes of keys and merges equal ones. 2. Hashes, not lines, are dealt out by
    hash; each part has two Bloom filters of ``BITS`` bits a hash, once seen and twice seen. 3. The twice-seen filters,
    ``filter_bytes`` in all at most, go to every task of a second scan, which lets pass only keys that may repeat. 4. These
    are grouped by their whole text, which confirms them and finds the id that stays. 5. Line numbers to drop meet the texts.

    The bound on filters costs no line: with some 45 million different lines that repeat the filters have 12 bits for each; with
    more, more lines that do not repeat are taken along to the exact step. Frequent keys are aggregated before the shuffle, and the join that brings a frequent
    key's decision to its rows has a plain shuffle on both sides, which adaptive execution splits. ``least_docs`` is 2 or more.
    Other columns of ``docs`` are not read; an empty table gives an empty result. Rows that agree in id and text get
    the same result.
    """
    if least_docs < 2 or least_chars < 1:
        raise ValueError("a repeated line stands in two documents at least, and has a character")
    spark = docs.sparkSession
    ship(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), body(text_col).alias("body")).select("id", F.xxhash64("body").alias("mark"), F.col("body").cast("binary").alias("body"))
    with scratch(spark):
        hashes = stored(texts.select("body").mapInArrow(_hashes(least_chars), "h long, many boolean"), "line-hashes")
        n = hashes.count()
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // PER_FILTER))
        once_bits = max(1 << 10, BITS * n // parts)
        twice_bits = max(64, min(once_bits, 8 * filter_bytes // parts) // 64 * 64)
        made = hashes.repartition(parts, F.pmod("h", F.lit(parts)).alias("part")).mapInArrow(_filters(parts, once_bits, twice_bits), "part long, bits binary")
        bits = bytearray(parts * twice_bits // 8)
        for r in made.toLocalIterator():  # filter_bytes at most
            bits[r["part"] * twice_bits // 8 : (r["part"] + 1) * twice_bits // 8] = r["bits"]
        twice = spark.sparkContext.broadcast(bytes(bits))
        suspects = stored(texts.mapInArrow(_suspects(twice, parts, twice_bits, least_chars), f"id {kind}, mark long, key binary, at array<int>"), "line-suspects")
        twice.destroy()
        repeats = suspects.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("keep_id")).filter(F.col("n") >= least_docs).select("key", "keep_id")
        repeats = stored(repeats, "line-repeats")
        drops = suspects.join(repeats, "key").filter(~F.col("id").eqNullSafe(F.col("keep_id"))).select("id", "mark", "at").distinct()
        drops = stored(drops.groupBy("id", "mark").agg(F.flatten(F.collect_list("at")).alias("gone")), "line-drops")  # a text's own lines
        same = F.col("t.id").eqNullSafe(F.col("d.id")) & (F.col("t.mark") == F.col("d.mark"))
        rows = texts.alias("t").join(drops.alias("d"), same, "left").select("t.id", "t.body", "d.gone")
        out = rows.mapInArrow(_without, f"id {kind}, n_lines long, n_dropped long, kept binary")
        out = keep(stored(out.select("id", "n_lines", "n_dropped", F.col("kept").cast("string").alias("kept")), "line-kept"))
    return out.withColumnRenamed("id", id_col)


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


SQL = {
    "op13_line_dedup": r"""
        WITH l AS (SELECT rowid AS r, doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i FROM (SELECT row_number() OVER () AS rowid, * FROM documents)),
        k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
        d AS (SELECT key, max(doc_id) AS keep_id FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT r) >= 3),
        j AS (SELECT k.*, d.key IS NOT NULL AND k.doc_id IS DISTINCT FROM d.keep_id AS gone FROM k LEFT JOIN d ON k.key = d.key)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM j GROUP BY r, doc_id
    """,
}

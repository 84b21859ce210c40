"""Fill-in-the-middle transformation by bit-parallel cuts in big integers."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from plumbline.llm.common import body, stored, table
from plumbline.session import ship

SENTINELS = ("<P>", "<S>", "<M>")
SPACES = b" \t\n\x0b\x0c\r"
#: Byte classes as binary digits: bytes that are no space, and bytes that begin a code point.
SOLID = bytes(0x30 if b in SPACES else 0x31 for b in range(256))
FIRST = bytes(0x30 if 0x80 <= b < 0xC0 else 0x31 for b in range(256))


def mask(data: bytes, classes: bytes) -> int:
    """An integer whose bit i tells whether byte i belongs to the class."""
    return int(data.translate(classes)[::-1] or b"0", 2)


def token_ends(data: bytes) -> int:
    """Bit i is set where a token ends with byte i: a solid byte before a space or the end, or a space that is last."""
    solid = mask(data, SOLID)
    ends = solid & ~(solid >> 1)
    return ends | 1 << len(data) - 1 if data[-1:] and data[-1] in SPACES else ends


def ranked(bits: int, width: int, rank: int) -> int:
    """The place of the set bit of that rank (from 0): halves whose bits are counted, again and again."""
    at = 0
    while width > 1:
        half = width >> 1
        low = bits & (1 << half) - 1
        n = low.bit_count()
        if rank < n:
            bits, width = low, half
        else:
            bits, width, rank, at = bits >> half, width - half, rank - n, at + half
    return at


def cuts(data: bytes, ends: int, first: int, second: int) -> tuple[int, int]:
    """Byte offsets after the two numbers of tokens."""
    after = lambda k: ranked(ends, len(data), k - 1) + 1 if k else 0
    return after(min(first, second)), after(max(first, second))


def _transform(rate: int, spm: int, sentinels: tuple[str, str, str]) -> Callable:
    p, s, m = (x.encode() for x in sentinels)

    def one(data: bytes, h1: int, h2: int, h3: int, h4: int) -> tuple:
        ends = token_ends(data)
        n = ends.bit_count()
        if not data or h3 % 100 >= rate or p in data or s in data or m in data:
            return n, "plain", None, None, data
        a, b = cuts(data, ends, h1 % (n + 1), h2 % (n + 1))
        first = mask(data, FIRST)
        head, both = (first & (1 << a) - 1).bit_count(), (first & (1 << b) - 1).bit_count()
        prefix, middle, suffix = data[:a], data[a:b], data[b:]
        if h4 % 100 < spm:
            return n, "spm", head, both - head, b"".join((s, suffix, p, prefix, m, middle))
        return n, "psm", head, both - head, b"".join((p, prefix, s, suffix, m, middle))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            found = [one(t.as_py(), *h) for t, *h in zip(x["body"], *(x[f"h{k}"].to_pylist() for k in range(1, 5)))]
            n, form, head, middle, out = zip(*found) if found else [()] * 5
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([x["id"], *(pa.array(c, k) for c, k in zip((n, form, head, middle, out), kinds))], ["id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return run


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: int = 50, spm: int = 80, seed: int = 42, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """One row per row of ``docs``: id, n, form, prefix_chars, middle_chars, output.

    A token is a run of solid characters with the white space before it; white space at the end is a token of its own, and
    ``n`` counts them. Four numbers from the digest of seed and id decide: two cut the text after whole tokens, the third
    keeps ``100 - rate`` per cent of the texts plain, the fourth makes ``spm`` per cent of the others
    suffix-prefix-middle and the rest prefix-suffix-middle. Texts that are empty or hold a sentinel stay plain; a null
    text counts as empty, a null id as the empty text. Rows that repeat an id are cut by the same numbers. Parts may be empty.

    Whole texts are cut, one after the other, in Arrow batches of bounded bytes; a text needs memory for a few copies of
    itself. There is no shuffle. Other columns of ``docs`` are not read; an empty table gives an empty result.
    """
    if not 0 <= rate <= 100 or not 0 <= spm <= 100 or len({*sentinels, ""}) != 4:
        raise ValueError("rate and spm are per cent; the sentinels are three different texts")
    ship(docs.sparkSession)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"), 256)
    numbers = [F.conv(F.substring("digest", 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]
    rows = docs.select(F.col(id_col).alias("id"), body(text_col).cast("binary").alias("body"), digest.alias("digest")).select("id", "body", *numbers)
    kind = docs.schema[id_col].dataType.simpleString()
    found = rows.mapInArrow(_transform(rate, spm, tuple(sentinels)), f"id {kind}, n long, form string, prefix_chars long, middle_chars long, output binary")
    return found.select(F.col("id").alias(id_col), "n", "form", "prefix_chars", "middle_chars", F.col("output").cast("string").alias("output"))


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that ``fill_in_middle`` cut: no part holds a sentinel, so that splitting at them is exact."""
    parts = F.split(output, "|".join(map(re.escape, sentinels)), -1)  # nothing, then the parts as they stand
    joined = F.when(form == "psm", F.concat(parts[1], parts[3], parts[2])).when(form == "spm", F.concat(parts[2], parts[3], parts[1]))
    return F.when(form == "plain", output).otherwise(joined)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fill_in_middle(table(spark, sf_dir, "documents"))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return stored(
        found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256")), "middle"
    )


SQL = {
    "op12_fill_in_middle": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS x FROM documents),
        h AS (SELECT *, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS w, ('0x' || x[1:8])::UBIGINT::BIGINT AS h1, ('0x' || x[9:16])::UBIGINT::BIGINT AS h2,
                ('0x' || x[17:24])::UBIGINT::BIGINT AS h3, ('0x' || x[25:32])::UBIGINT::BIGINT AS h4 FROM d),
        c AS (SELECT *, len(w) AS n, least(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS a, greatest(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS b,
                CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM h),
        p AS (SELECT *, array_to_string(w[1:a], '') AS prefix, array_to_string(w[a + 1:b], '') AS middle, array_to_string(w[b + 1:], '') AS suffix FROM c)
        SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle)::BIGINT END AS middle_chars,
          sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
          sha256(t) AS restored_sha256 FROM p
    """,
}

"""Best-fit packing of tokenised documents by length patterns."""

from __future__ import annotations

import functools
import re
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from plumbline.llm.common import body, salt, salts_for, small_batches, stored, table

CAPACITY = 2048
SEPARATOR = 0
#: Cached words in a Python worker; the cache starts anew beyond that.
CACHE = 800_000
#: Lengths beyond this many distinct rests are not enumerated as partners; more patterns fit the histogram no better.
PARTNERS = 24
ROUNDS = 300

# Within these letters lower case is the same in any library, and none composes with a neighbour.
_PLAIN = re.compile(r"[!-~À-ÖØ-öø-įı-ňŊ-ž]+")
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|[0-9]|(?:[^\w\s]|_)+")
_ODD_SPACE = re.compile(r"[\x1c-\x1f\x85]")


# Byte-level alphabets write a byte as a printable character: itself, or one from 256 on.
_PRINTED = {b: chr(b) for b in (*range(33, 127), *range(161, 173), *range(174, 256))}
_PRINTED |= {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in _PRINTED)}
_LETTERS = {c: "".join(_PRINTED[b] for b in chr(c).encode()) for c in range(0x180)}


class _Words(dict):
    """Token ids, as bytes, of a stretch of text without white space. The tokenizer lower-cases, drops white space and never
    looks across it; what its patterns split is tokenised by the vocabulary's merges alone."""

    def __init__(self, tokenizer) -> None:
        self.encode, self.merge, self.pieces = tokenizer.encode, tokenizer.model.tokenize, {}

    def ids(self, text: str) -> bytes:
        return np.array(self.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, word: str) -> bytes:
        if len(self) > CACHE or len(self.pieces) > CACHE:
            self.clear()
            self.pieces.clear()
        if _PLAIN.fullmatch(word) and "<|" not in word:
            out = []
            for piece in _PIECES.findall(word.lower()):
                if (got := self.pieces.get(piece)) is None:
                    got = self.pieces[piece] = array("I", [t.id for t in self.merge(piece.translate(_LETTERS))]).tobytes()
                out.append(got)
            found = b"".join(out)
        else:
            found = self.ids(word)
        if len(word) <= 64:
            self[word] = found
        return found


@functools.lru_cache(maxsize=2)
def _words(tokenizer_path: str) -> _Words:
    """One for all tasks of a Python worker."""
    from tokenizers import Tokenizer

    return _Words(Tokenizer.from_file(tokenizer_path))


def _pieces(tokenizer_path: str, capacity: int) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = _words(tokenizer_path)
        for x in batches:
            out: dict[str, list] = {k: [] for k in ("id", "piece", "start", "length", "ids_crc32")}
            for i, text in zip(x["id"], x["body"]):
                ids = (words.ids(text) if _ODD_SPACE.search(text) else b"".join(map(words.__getitem__, text.split()))) + SEPARATOR.to_bytes(4, "little")
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    for name, v in zip(out, (i, k, at // 4, len(part) // 4, zlib.crc32(part))):
                        out[name].append(v)
            yield pd.DataFrame(out)

    return run


def patterns_of(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[int, ...]]:
    """Patterns of one to four lengths that occur: a longest one, each of the best-fitting partners, and best fits for the rest."""
    have = np.flatnonzero(counts)
    fit = np.zeros(capacity + 1, "int64")  # the largest length that occurs and fits
    fit[have] = have
    fit = np.maximum.accumulate(fit)
    found = set()
    for a in have.tolist():
        partners = have[np.searchsorted(have, min(a, capacity - a), side="right") - 1 :: -1][:PARTNERS] if a < capacity and have[0] <= min(a, capacity - a) else ()
        spread = have[have <= min(a, capacity - a)]
        more = spread[np.linspace(0, len(spread) - 1, min(PARTNERS, len(spread))).astype(int)] if len(spread) else ()
        found.add((a,))
        for b in {*map(int, partners), *map(int, more)}:
            p, rest = [a, b], capacity - a - b
            while rest > 0 and len(p) < 4 and (c := int(fit[rest])):
                p.append(c)
                rest -= c
            found.add(tuple(sorted(p, reverse=True)))
    return sorted(found)


def fitted(patterns: list[tuple[int, ...]], counts: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """Non-negative least squares: repeat counts x with A x near the histogram, by multiplicative steps; patterns that leave
    capacity unused are fitted only after the full ones."""
    width = max(map(len, patterns), default=1)
    at = np.array([p + (0,) * (width - len(p)) for p in patterns], "int64").reshape(-1, width)
    target = counts.astype(float)
    total = np.zeros(len(patterns))
    for full in (at.sum(axis=1) == capacity, at.sum(axis=1) >= capacity * 0.98):
        rows = at[full]
        if not len(rows) or target.sum() <= 0:
            continue
        up = lambda v: np.where(rows > 0, v[rows], 0.0).sum(axis=1)
        x = np.full(len(rows), target.sum() / len(rows))
        want = up(target)
        for _ in range(ROUNDS):
            made = np.bincount(rows.ravel(), weights=np.repeat(x, width), minlength=capacity + 1)
            made[0] = 0
            x *= want / np.maximum(up(made), 1e-12)
        total[full] += x
        made = np.bincount(rows.ravel(), weights=np.repeat(x, width), minlength=capacity + 1)
        made[0] = 0
        target = np.maximum(target - made, 0)
    return total


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(pattern, repeats) that use up the histogram ``counts`` (by length, 0 to capacity) exactly."""
    left, out = counts.astype("int64").copy(), []

    def use(p: tuple[int, ...], n: int) -> None:
        if n > 0:
            out.append((p, int(n)))
            for v in p:
                left[v] -= n

    use((capacity,), left[capacity])
    patterns = patterns_of(left, capacity)
    x = fitted(patterns, left, capacity) if patterns else []
    for k in np.argsort(-np.asarray(x), kind="stable"):
        p = patterns[k]
        use(p, min([int(round(x[k])), *(int(left[v]) // p.count(v) for v in set(p))]))
    # residuals by best fit, longest first; sequences with like contents are handled together
    free: dict[int, dict[tuple[int, ...], int]] = {}
    for v in range(capacity, 0, -1):
        n = int(left[v])
        while n:
            rest = next((r for r in sorted(free) if r >= v and free[r]), None)
            if rest is None:
                k = min(capacity // v, n)
                p, took = (v,) * k, n // k
                free.setdefault(capacity - k * v, {}).setdefault(p, 0)
                free[capacity - k * v][p] += took
                n -= took * k
                continue
            p, had = next(iter(free[rest].items()))
            took = min(n, had)
            free[rest][p] -= took
            if not free[rest][p]:
                del free[rest][p]
            if not free[rest]:
                del free[rest]
            free.setdefault(rest - v, {}).setdefault((*p, v), 0)
            free[rest - v][*p, v] += took
            n -= took
    out += [(p, n) for group in free.values() for p, n in group.items() if n]
    return out


def slots(made: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """For each length the pieces numbered from ``low`` (up to the next row's) go to sequences from ``sequence`` at ``offset``."""
    low: dict[int, int] = {}
    rows, sequence = [], 0
    for p, n in made:
        offset = 0
        for v in p:
            rows.append((v, low.get(v, 0), sequence, offset))
            low[v] = low.get(v, 0) + n
            offset += v
        sequence += n
    table = np.array(sorted(rows), "int64").reshape(-1, 4)
    return dict(zip(("length", "low", "sequence", "offset"), table.T))


def _placed(found: dict[str, np.ndarray]) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = found["length"] * (1 << 44) + found["low"]
        for x in batches:
            if len(x):
                k = np.searchsorted(key, x["length"].to_numpy() * (1 << 44) + x["number"].to_numpy(), side="right") - 1
                x["sequence_id"], x["offset"] = found["sequence"][k] + x["number"].to_numpy() - found["low"][k], found["offset"][k]
                yield x.drop(columns="number")

    return run


def pack(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its text's token ids and a separator; only longer ones are cut, into pieces of ``capacity``. Lengths
    are counted, patterns of up to four lengths that fill a sequence are fitted to the histogram by non-negative least
    squares, rounded, and the residual lengths packed by best fit. The histogram and the plan have a size bounded by
    ``capacity``, whatever the corpus; pieces of a length are numbered by cells of a salt, so that a length that very
    many documents share is no hot key. A null text is empty: one separator. Ids may be null or repeat; an empty table
    gives an empty result.
    """
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("word_bpe_49k.json")
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    schema = "id string, piece int, start long, length long, ids_crc32 long"
    rows = docs.select(F.col(id_col).cast("string").alias("id"), body(text_col).alias("body"))
    salts = salts_for(rows.count())
    with small_batches(spark):
        rows = rows.mapInPandas(_pieces(tokenizer_path, capacity), schema)
        rows = stored(rows.select("*", salt(F.monotonically_increasing_id(), salts=salts).alias("salt")), "pack-pieces")
    cells = rows.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    counts = np.zeros(capacity + 1, "int64")
    for x in cells.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most ``capacity`` rows
        counts[x["length"]] = x["n"]
    earlier = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("length", "salt", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("ahead"))
    nth = F.row_number().over(Window.partitionBy("length", "salt").orderBy("id", "piece", "ids_crc32"))
    rows = rows.select("*", nth.alias("nth")).join(cells, ["length", "salt"])
    rows = rows.select("id", "piece", "start", "length", "ids_crc32", (F.col("ahead") + F.col("nth") - 1).alias("number"))
    placed = rows.mapInPandas(_placed(slots(plan(counts, capacity))), f"{schema}, sequence_id long, offset long")
    return placed.withColumn("id", F.col("id").cast(kind)).withColumnRenamed("id", id_col)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


SQL: dict[str, str] = {}

"""Vector and keyword search, fusion, chunks and citations."""

from __future__ import annotations

import difflib
import functools
import itertools
import re
import unicodedata
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window, functions as F

from plumbline.functions.expressions import cosine
from plumbline.session import ship

# The constant of rank fusion, and what counts as a term.
RRF = 60
#: Cosines that differ beyond so many places only by the order of summation are ties.
DIGITS = 9
TERM = r"[0-9A-Za-z一-龥ぁ-んァ-ン]{2,}"


def vector_top(chunks: DataFrame, query: Sequence[float], k: int, id_col: str, vector_col: str, where: Column | None = None) -> DataFrame:
    """The ``k`` rows nearest by cosine after the metadata filter; ties by id. Spark keeps k rows a partition."""
    q = F.array(*[F.lit(float(x)) for x in query])
    rows = chunks if where is None else chunks.filter(where)
    return rows.select(id_col, cosine(F.col(vector_col), q).alias("score")).orderBy(F.col("score").desc(), F.col(id_col)).limit(k)


def _best(k: int) -> Callable:
    def unit(rows: list) -> np.ndarray:
        x = np.array([np.asarray(r, "f8") for r in rows])
        with np.errstate(all="ignore"):
            x = x / np.sqrt((x * x).sum(axis=1))[:, None]
        return np.where(np.isfinite(x).all(axis=1)[:, None], x, 0.0)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            for queries, ids, q, v in zip(x["queries"], x["ids"], x["q"], x["v"]):
                size = [len(r) for r in v]
                score = np.zeros((len(q), len(v)))
                for n in set(size) & {len(r) for r in q} - {0}:  # vectors of other lengths score 0
                    a, b = [i for i, r in enumerate(q) if len(r) == n], [i for i, m in enumerate(size) if m == n]
                    score[np.ix_(a, b)] = unit([q[i] for i in a]) @ unit([v[i] for i in b]).T
                score = score.round(DIGITS) + 0.0
                order = np.lexsort((np.broadcast_to(ids, score.shape), -score))[:, :k]
                yield pd.DataFrame({"query": np.repeat(queries, order.shape[1]), "id": np.asarray(ids)[order.ravel()], "score": np.take_along_axis(score, order, 1).ravel()})

    return run


def vector_top_each(chunks: DataFrame, queries: DataFrame, k: int, id_col: str, vector_col: str, block: int = 256, tile: int = 2048) -> DataFrame:
    """For each row of ``queries`` (the same columns, integer ids) the ``k`` rows of ``chunks`` nearest by cosine: query_id, id,
    score, nth. Scores are rounded to ``DIGITS`` places, ties by id; ``cosine`` says when a score is 0.

    Blocks of queries meet tiles of rows in numpy; a pair leaves k rows a query, and these are ranked once more. All queries
    are compared with all rows; ``vector_index`` compares them with the lists that they are near to. Spark bounds the bytes
    of an Arrow batch, so that no setting of the session is touched.
    """
    ship(chunks.sparkSession)

    def packed(df: DataFrame, size: int, ids: str, vectors: str) -> DataFrame:
        n = max(1, -(-df.count() // size))
        x = F.struct(F.col(id_col).cast("long").alias("id"), F.coalesce(F.transform(vector_col, lambda v: v.cast("double")), F.array().cast("array<double>")).alias("v"))
        return df.groupBy(F.pmod(F.xxhash64(id_col), F.lit(n)).alias("cell")).agg(F.collect_list(x).alias("x")).select(F.col("x.id").alias(ids), F.col("x.v").alias(vectors))

    pairs = packed(chunks, tile, "ids", "v").crossJoin(packed(queries, block, "queries", "q"))
    found = pairs.mapInPandas(_best(k), "query long, id long, score double")
    w = Window.partitionBy("query").orderBy(F.col("score").desc(), "id")
    found = found.select("*", F.row_number().over(w).alias("nth")).filter(F.col("nth") <= k)
    return found.select(F.col("query").alias("query_id"), F.col("id").alias(id_col), "score", "nth")


def terms(text: str, most: int = 8) -> list[str]:
    return [x.lower() for x in re.findall(TERM, text)][:most]


def keyword_top(docs: DataFrame, query: str, k: int, id_col: str, text_col: str, newest: Column, recent: int = 80, least: int = 20, snippet: int = 1200) -> DataFrame:
    """Of the ``recent`` newest texts of ``least`` characters or more, those that hold any term; score 1 / rank by newness."""
    found = terms(query)
    rows = docs.filter(F.length(text_col) >= least).orderBy(newest.desc(), F.col(id_col)).limit(recent)
    rows = rows.filter(F.exists(F.array(*map(F.lit, found)), lambda t: F.lower(text_col).contains(t))) if found else rows.limit(0)
    w = Window.orderBy(newest.desc(), F.col(id_col))
    return rows.select(id_col, F.left(F.col(text_col), F.lit(snippet)).alias("snippet"), F.row_number().over(w).alias("nth")).filter(F.col("nth") <= k).select(id_col, "snippet", "nth", (1 / F.col("nth")).alias("score"))


def fuse(ranked: Sequence[DataFrame], id_col: str, k: int, constant: int = RRF) -> DataFrame:
    """Reciprocal rank fusion of tables with ``id_col`` and ``nth``."""
    rows = ranked[0].select(id_col, "nth")
    for r in ranked[1:]:
        rows = rows.unionByName(r.select(id_col, "nth"))
    return rows.groupBy(id_col).agg(F.sum(1 / (constant + F.col("nth"))).alias("score"), F.count(F.lit(1)).alias("n_lists")).orderBy(F.col("score").desc(), F.col(id_col)).limit(k)


def fuse_each(ranked: Sequence[DataFrame], id_col: str, k: int, constant: int = RRF) -> DataFrame:
    """``fuse`` for each ``query_id`` of tables with ``query_id``, ``id_col`` and ``nth``."""
    rows = ranked[0].select("query_id", id_col, "nth")
    for r in ranked[1:]:
        rows = rows.unionByName(r.select("query_id", id_col, "nth"))
    rows = rows.groupBy("query_id", id_col).agg(F.round(F.sum(1 / (constant + F.col("nth"))), DIGITS).alias("score"), F.count(F.lit(1)).alias("n_lists"))
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col(id_col))
    return rows.select("*", F.row_number().over(w).alias("nth")).filter(F.col("nth") <= k)


def token_estimate(text: str) -> int:
    return max(1, (len(text) + 1) // 2)


# What a heading's words make of its section, in this order, and what begins a heading.
SECTIONS = (
    (r"事業等のリスク|Item\s*1A|Risk Factors", "risk_factors"),
    (r"経営者による財政状態|Item\s*7|MD&A|Management'?s Discussion", "mdna"),
    (r"業績等の概要|経営成績|Results of Operations", "results"),
    (r"今後の見通し|次期の業績予想|Outlook|Guidance", "outlook"),
    (r"財務諸表|Financial Statements", "financials"),
    (r"重要な会計上の見積り|Critical Accounting", "accounting_estimates"),
)
HEADING = r"^(?:#{1,3}\s+|[第]?[0-9一二三四五六七八九十]+[章節条項]\s*|Item\s+[0-9]+[A-Z]?\.?\s+)"
LONGEST_HEADING, OTHER = 40, "other"
_SECTIONS = [(re.compile(x, re.IGNORECASE), name) for x, name in SECTIONS]
_HEADING, _RULE, _SENTENCE = re.compile(HEADING, re.IGNORECASE), re.compile(r"\s*[-+]{3,}"), re.compile(r"(?<=。)")


def section_of(text: str) -> str:
    """The section that the first 800 characters name."""
    return next((name for x, name in _SECTIONS if x.search(text[:800])), OTHER)


def _kind(line: str) -> str:
    return "table" if "|" in line or _RULE.match(line) else "text" if line.strip() else ""


def blocks(text: str) -> list[str]:
    """Runs of lines of one kind: tables (a line with a bar or one that begins with a rule) and paragraphs between blank lines."""
    runs = ("\n".join(lines).strip() for kind, lines in itertools.groupby(text.replace("\r\n", "\n").split("\n"), _kind) if kind)
    return [r for r in runs if r]


def heading(block: str) -> str | None:
    """The section that a block begins if its first line is a heading: short, no sentence, marked or named as one."""
    line = block.splitlines()[0]
    if len(line) > LONGEST_HEADING or "。" in line or not (_HEADING.search(line) or section_of(line) != OTHER):
        return None
    return section_of(line)


def pieces(block: str, most: int) -> list[str]:
    """The block itself, or if it is a paragraph of more tokens its sentences, as many to a piece as fit. No sentence is cut."""
    if "|" in block or token_estimate(block) <= most:
        return [block]
    out: list[str] = []
    for sentence in filter(None, map(str.strip, _SENTENCE.split(block))):
        if out and token_estimate(out[-1] + sentence) <= most:
            out[-1] += sentence
        else:
            out.append(sentence)
    return out or [block]


def _tail(parts: list[str], overlap: int) -> list[str]:
    """The last parts, as few as have ``overlap`` tokens together."""
    sums = itertools.accumulate(token_estimate(p) for p in reversed(parts))
    n = next((k for k, total in enumerate(sums, 1) if total >= overlap), len(parts))
    return parts[-n:]


def chunk_text(text: str | None, most: int = 1000, overlap: int = 150) -> list[dict]:
    """section and text of each chunk: pieces of one section up to ``most`` tokens, blank lines between. A heading starts a
    section and is no part of its text; a chunk begins with the tail of the one before it in its section, which may
    take it beyond ``most``, and so may a piece that cannot be cut."""
    out: list[dict] = []
    section, now = OTHER, []

    def close() -> None:
        if now:
            out.append({"section": section, "text": "\n\n".join(now).strip()})

    for block in blocks((text or "").strip()):
        name = heading(block)
        if name is not None:
            close()
            section, now = name, []
            continue
        for piece in pieces(block, most):
            if now and sum(map(token_estimate, now)) + token_estimate(piece) > most:
                close()
                now = _tail(now, overlap)
            now.append(piece)
    close()
    return out


class Chunks:
    """The table function ``chunks(TABLE(...))``: a row of doc_id and text makes its chunks' rows."""

    def eval(self, row: Row) -> Iterator[tuple]:
        for k, c in enumerate(chunk_text(row["text"])):
            yield str(row["doc_id"]), k, c["section"], c["text"], token_estimate(c["text"])


def register_chunks(spark: SparkSession, name: str = "chunks") -> None:
    """``SELECT * FROM chunks(TABLE(SELECT doc_id, text FROM ...))``, in Arrow batches."""
    ship(spark)
    spark.udtf.register(name, F.udtf(Chunks, returnType="doc_id string, chunk_no int, section string, text string, n_tokens int", useArrow=True))


def chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = 1000, overlap: int = 150) -> DataFrame:
    """id, chunk_no, chunk_id (``id#no``), section, text, n_tokens. Whole texts; blank and null ones have no chunks."""
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            yield pd.DataFrame(
                [(i, k, c["section"], c["text"], token_estimate(c["text"])) for i, t in zip(x["id"], x["body"]) for k, c in enumerate(chunk_text(t, most, overlap))],
                columns=["id", "chunk_no", "section", "text", "n_tokens"],
            )

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("body")).mapInPandas(run, f"id {kind}, chunk_no int, section string, text string, n_tokens int")
    return rows.select(F.col("id").alias(id_col), "chunk_no", F.concat_ws("#", "id", "chunk_no").alias("chunk_id"), "section", "text", "n_tokens")


def _flat(text: str | None) -> str:
    return re.sub(r"\s+", "", unicodedata.normalize("NFKC", text or ""))


def citation_verdict(quote: str | None, source: str | None, least: float = 0.9) -> str:
    """VERIFIED, VERIFIED_FUZZY (a window of the source resembles the quote), PAGE_NOT_FOUND (no text) or QUOTE_NOT_FOUND. An
    empty quote is in any text."""
    if source is None:
        return "PAGE_NOT_FOUND"
    q, s = _flat(quote), _flat(source)
    if q in s:
        return "VERIFIED"
    width = max(len(q), 8)
    for i in _windows(s, q, width, max(1, width // 4), least):
        if _resembles(s[i : i + width], q, least):
            return "VERIFIED_FUZZY"
    return "QUOTE_NOT_FOUND"


#: Numbers that a step on windows holds at once; pieces of up to so many characters are left to difflib's search.
CELLS, PIECE = 1 << 22, 64
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "u4")


def _gram_codes(x: np.ndarray, q: int) -> np.ndarray:
    """A number for the ``q`` characters from each place on. Different grams may share one: shared grams are only overstated."""
    out = np.zeros(max(0, len(x) - q + 1), "u8")
    for k in range(q):
        out = out * _BASE + x[k : k + len(out)]
    return out


def _fewest(m: np.ndarray, size: np.ndarray, q: int) -> np.ndarray:
    """Grams that two texts share if ``m`` of their ``size`` characters match on either side: matched ones stand in blocks with an
    unmatched character between, so that there are at most size - 2 m + 1 blocks, and each lacks q - 1 grams of its length."""
    return m - (q - 1) * (size - 2 * m + 1)


def _windows(s: str, q: str, width: int, step: int, least: float) -> list[int]:
    """The starts of the windows of ``s`` whose ratio with ``q`` can be ``least``, those that share most with it first.

    A ratio of r means r (n + k) / 2 matched characters, and so a least number of common grams of one to four characters,
    counted with repeats. Each is told for many windows at once, in time in proportion to the source.
    """
    x, y = _codes(s).astype("u8"), _codes(q).astype("u8")
    starts = np.arange(0, max(1, len(x) - width + 1), step)
    surplus = np.zeros(len(starts))
    for n in (1, 2, 3, 4):
        xs, (known, most) = _gram_codes(x, n), np.unique(_gram_codes(y, n), return_counts=True)
        if not len(known):
            break
        place = np.minimum(np.searchsorted(known, xs), len(known) - 1)
        place = np.append(np.where(known[place] == xs, place, len(known)), len(known))  # what the quote has not is counted apart
        stay, over, at_once = [], [], max(1, CELLS // (width + len(known)))
        for part in np.split(starts, range(at_once, len(starts), at_once)):
            size = np.minimum(part + width, len(x)) - part + len(y)
            cells = place[np.minimum(part[:, None] + np.arange(max(0, width - n + 1)), len(xs))] + (len(known) + 1) * np.arange(len(part))[:, None]
            counts = np.bincount(cells.ravel(), minlength=len(part) * (len(known) + 1)).reshape(len(part), -1)[:, :-1]
            more = np.minimum(counts, most).sum(axis=1) - _fewest(np.ceil(least * size / 2 - 1e-9), size, n)
            stay.append(part[more >= 0])
            over.append(more[more >= 0])
        starts, surplus = np.concatenate(stay), np.concatenate(over)
        if not len(starts):
            break
    return starts[np.argsort(-surplus, kind="stable")].tolist()


@functools.lru_cache(maxsize=1)
def _places(text: str) -> dict[str, int]:
    """Of each character its places as the bits of an integer; windows of one quote ask one after another."""
    x = _codes(text)
    return {chr(c): int.from_bytes(np.packbits(x == c, bitorder="little").tobytes(), "little") for c in np.unique(x).tolist()}


def _common(a: str, b: str, need: int) -> bool:
    """Whether a common subsequence can have ``need`` characters: what a ratio matches is one. A row of the table is an integer."""
    places, n = _places(b), len(b)
    whole = row = (1 << n) - 1
    for i, c in enumerate(a, 1):
        u = row & places.get(c, 0)
        row = (row + u) | (row - u)
        if not i & 63:
            row &= whole
            if n - row.bit_count() + len(a) - i < need:
                return False
    return n - (row & whole).bit_count() >= need


def _longest(a: str, b: str) -> tuple[int, int, int]:
    """``SequenceMatcher.find_longest_match`` without junk: the first longest common piece in ``a``, and its first place in ``b``.

    A common piece of a length has ones of every smaller length, so the length is found by halving; codes of all pieces of a
    length are differences of running sums. Codes only propose: the pieces themselves are compared.
    """
    n = max(len(a), len(b)) + 1
    power = np.cumprod(np.full(n, _BASE))
    sums = [np.concatenate([np.zeros(1, "u8"), np.cumsum(_codes(t) * power[: len(t)])]) for t in (a, b)]

    def pieces_of(k: int, size: int) -> np.ndarray:
        at = np.arange(len(sums[k]) - size)
        return (sums[k][size:] - sums[k][:-size]) * power[n - 1 - at]

    def first(size: int) -> tuple[int, int] | None:
        x, y = pieces_of(0, size), pieces_of(1, size)
        for i in np.flatnonzero(np.isin(x, y)).tolist():
            piece = a[i : i + size]
            j = b.find(piece)
            if j >= 0:
                return i, j
        return None

    low, high, found = 0, min(len(a), len(b)), (0, 0)
    while low < high:
        mid = (low + high + 1) // 2
        at = first(mid)
        if at is None:
            high = mid - 1
        else:
            low, found = mid, at
    return *found, low


def _resembles(a: str, b: str, least: float) -> bool:
    """Whether ``difflib.SequenceMatcher(None, a, b, autojunk=False).ratio()`` is ``least`` or more.

    Longest common pieces first, then what is left and right of them, as there; each count is weighed against what is still
    needed and what the remaining pieces could give at most, so that most windows are told by few pieces.
    """
    total = len(a) + len(b)
    if not total:
        return True
    need = max(0, int(least * total / 2) - 1)
    while 2.0 * need / total < least:
        need += 1
    if not _common(a, b, need):
        return False
    matched, most, rest = 0, min(len(a), len(b)), [(a, b)]
    while rest and matched < need <= matched + most:
        x, y = rest.pop()
        most -= min(len(x), len(y))
        if min(len(x), len(y)) <= PIECE:
            matched += sum(k for _, _, k in difflib.SequenceMatcher(None, x, y, autojunk=False).get_matching_blocks())
            continue
        i, j, k = _longest(x, y)
        if not k:
            continue
        matched += k
        for part in ((x[:i], y[:j]), (x[i + k :], y[j + k :])):
            if part[0] and part[1]:
                rest.append(part)
                most += min(len(part[0]), len(part[1]))
        rest.sort(key=lambda p: min(len(p[0]), len(p[1])))
    return matched >= need


def _verdicts(quotes: pd.Series, sources: pd.Series) -> pd.Series:
    return pd.Series([citation_verdict(q, s) for q, s in zip(quotes, sources)], dtype=object)


def verify_citations(claims: DataFrame, docs: DataFrame, quote_col: str = "quote", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Adds verdict: DOC_NOT_FOUND, PAGE_NOT_FOUND, VERIFIED, VERIFIED_FUZZY or QUOTE_NOT_FOUND."""
    ship(claims.sparkSession)
    verdict = F.pandas_udf(_verdicts, "string")
    known = docs.select(F.col(id_col), F.col(text_col).alias("_text"), F.lit(True).alias("_known"))
    x = claims.join(known, id_col, "left")
    return x.withColumn("verdict", F.when(F.col("_known").isNull(), "DOC_NOT_FOUND").otherwise(verdict(quote_col, "_text"))).drop("_text", "_known")


def known_chunks(hits: DataFrame, chunks: DataFrame, as_of: str | None = None, filed_after: str | None = None, k: int | None = None) -> DataFrame:
    """Fused hits whose chunk was filed at ``as_of`` or before and not before ``filed_after``; of them the first ``k``."""
    x = hits.join(chunks.select("chunk_id", "filed_at"), "chunk_id")
    if as_of is not None:
        x = x.filter(F.to_date("filed_at") <= F.lit(as_of).cast("date"))
    if filed_after is not None:
        x = x.filter(F.to_date("filed_at") >= F.lit(filed_after).cast("date"))
    x = x.orderBy(F.col("score").desc(), "chunk_id")
    return x if k is None else x.limit(k)


def indexed(stored: DataFrame, new: DataFrame) -> DataFrame:
    """The index without the old chunks of the documents of ``new``, and the new chunks that have a vector."""
    docs = new.select("doc_id").distinct()
    return stored.join(docs, "doc_id", "left_anti").unionByName(new.filter("embedding IS NOT NULL").select(*stored.columns))


def chunks_of(stored: DataFrame, doc_id, section: str | None = None) -> DataFrame:
    rows = stored.filter(F.col("doc_id") == doc_id)
    return (rows if section is None else rows.filter(F.col("section") == section)).orderBy("chunk_no")

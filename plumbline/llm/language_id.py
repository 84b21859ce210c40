"""Language identification: script ranges, word scores and a Viterbi path over the words."""

from __future__ import annotations

import bisect
import math
import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from plumbline.llm.common import body, held_out, small_batches, stored, table

UNKNOWN = "und"
#: At most about so many training documents a language; all if there are fewer.
SAMPLE = 2_000
#: Times that a word or trigram must occur in a language's sample to be in the model; others score as unseen ones.
LEAST = 5
#: Cost, in nats, of another language at the next word, and of a language that a word's script rules out.
SWITCH, RULED_OUT = 8.0, 30.0
#: Scores (words times languages) that paths are found for at once; a longer document has a pass of its own.
CELLS = 1 << 21
#: Words whose scores a Python worker keeps; it starts anew beyond that. Words scored at once.
CACHE, BLOCK = 600_000, 20_000

def _ranges(points: list[int]) -> str:
    """A character class of code points in order."""
    out, first = [], None
    for a, b in zip(points, [*points[1:], -1]):
        first = a if first is None else first
        if b != a + 1:
            out.append(f"{re.escape(chr(first))}-{re.escape(chr(a))}")
            first = None
    return "".join(out)


#: Letters and the marks that combine with them: a mark ends no word.
_MARKS = _ranges([i for i in range(0x300, sys.maxunicode + 1) if unicodedata.category(chr(i))[0] == "M"])
_WORD = re.compile(rf"[^\W\d_]+(?:[{_MARKS}]+[^\W\d_]*)*")
# Numbers that ``re`` takes for letters (superscripts, fractions, Roman numerals) become blanks, one for one.
_NUMBERS = {i: " " for i in range(sys.maxunicode + 1) if (c := chr(i)).isnumeric() and not c.isalpha() and not c.isdecimal()}


def find_words(text: str) -> tuple[str, list[str]]:
    """Runs of letters and marks, of any length, and the text in which they stand at their places."""
    words = _WORD.findall(text)
    if not words or "".join(words).isalpha():
        return text, words
    text = text.translate(_NUMBERS)
    return text, _WORD.findall(text)


#: First code points of scripts, in order; letters before the first count as Latin.
_SCRIPTS = ((0x370, "Greek"), (0x400, "Cyrillic"), (0x530, "Armenian"), (0x590, "Hebrew"), (0x600, "Arabic"), (0x900, "Indic"), (0xE00, "Thai"), (0xE80, "other"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "other"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "other"), (0x3040, "Kana"), (0x3130, "Hangul"), (0x3400, "Han"), (0xA000, "other"), (0xAC00, "Hangul"), (0xF900, "Han"), (0xFB00, "other"))
_STARTS = [x for x, _ in _SCRIPTS]
_FIRST = chr(_STARTS[0])


def script(word: str) -> str:
    """The script of most letters of a word."""
    if max(word) < _FIRST:
        return "Latin"
    found = Counter(_SCRIPTS[k - 1][1] if (k := bisect.bisect_right(_STARTS, ord(c))) else "Latin" for c in word)
    return max(sorted(found), key=found.__getitem__)


def _trigrams(word: str) -> list[str]:
    w = f"^{word}$"
    return [w[i : i + 3] for i in range(len(w) - 2)]


@dataclass
class LanguageModel:
    """Log-probabilities of words and trigrams and the scripts in use, a column a language; its size is bounded by SAMPLE.
    The dictionaries give rows of the arrays, whose last rows hold for items that they lack."""

    languages: list[str]
    words: dict[str, int]
    word_logs: np.ndarray
    trigrams: dict[str, int]
    trigram_logs: np.ndarray
    scripts: dict[str, int]
    in_use: np.ndarray

    def score(self, words: list[str]) -> np.ndarray:
        """Log posterior of each language given one word in lower case, under equal priors; 0 for all if nothing is known."""
        parts = np.fromiter((self.trigrams.get(t, -1) for w in words for t in _trigrams(w)), "i8")
        starts = np.cumsum([0, *map(len, words)])[:-1]  # a word has as many trigrams as letters
        s = self.word_logs[[self.words.get(w, -1) for w in words]] + 0.5 * np.add.reduceat(self.trigram_logs[parts], starts)
        allowed = self.in_use[[self.scripts.get(script(w), -1) for w in words]]
        s = np.where(allowed, s, s.max(axis=1, keepdims=True) - RULED_OUT)
        s -= s.max(axis=1, keepdims=True)
        s = np.maximum(s - np.log(np.exp(s).sum(axis=1, keepdims=True)), -RULED_OUT)
        return np.where(allowed.any(axis=1, keepdims=True), s, 0.0)


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for x in batches:
        found: Counter = Counter()
        for lang, text in zip(x["lang"], x["body"]):
            for word, n in Counter(find_words(text.lower())[1]).items():
                found[lang, "word", word] += n
                found[lang, "script", script(word)] += n * len(word)
                for t in _trigrams(word):
                    found[lang, "trigram", t] += n
        if found:
            yield pd.DataFrame([(*k, n) for k, n in found.items()], columns=["lang", "kind", "item", "n"])


def learn_languages(docs: DataFrame, train: Column, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """A model from the rows where ``train`` holds and text and language are not null.

    At most about ``sample`` documents a language are read, chosen by a digest of id and text; their counts are summed by
    Spark and bounded by the sample when they reach the driver.
    """
    known = docs.filter(train & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = {r[0]: r[1] for r in known.groupBy(F.col(lang_col).cast("string")).count().collect()}  # one row a language
    parts = [x for lang, n in sizes.items() for x in (F.lit(lang), F.lit(min(1.0, sample / n)))]
    if not parts:
        return LanguageModel([], {}, np.zeros((1, 0)), {}, np.zeros((1, 0)), {}, np.zeros((1, 0), bool))
    lang = F.col(lang_col).cast("string")
    known = known.filter(F.pmod(F.xxhash64(F.col(id_col), F.col(text_col), F.lit("languages")), F.lit(1_000_000)) < F.create_map(*parts)[lang] * 1_000_000)
    with small_batches(docs.sparkSession):
        counts = known.select(lang.alias("lang"), body(text_col).alias("body")).mapInPandas(_counts, "lang string, kind string, item string, n long")
        counts = counts.groupBy("lang", "kind", "item").agg(F.sum("n").alias("n")).filter(f"kind = 'script' OR n >= {LEAST}")
        rows = counts.toPandas().sort_values(["kind", "item", "lang"])
    languages = sorted(sizes)
    at = {x: i for i, x in enumerate(languages)}
    found: dict[str, dict[str, np.ndarray]] = {"word": {}, "trigram": {}, "script": {}}
    for lang_, kind, item, n in rows[["lang", "kind", "item", "n"]].itertuples(index=False):
        found[kind].setdefault(item, np.zeros(len(languages)))[at[lang_]] = n

    def logs(counts: dict[str, np.ndarray]) -> tuple[dict[str, int], np.ndarray]:
        n = np.array([*counts.values(), np.zeros(len(languages))])
        return {k: i for i, k in enumerate(counts)}, np.log((n + 0.5) / (n.sum(axis=0) + 0.5 * len(n)))

    letters = np.array([*found["script"].values(), np.zeros(len(languages))])
    in_use = (letters >= 0.01 * letters.sum(axis=0)) & (letters > 0)
    return LanguageModel(languages, *logs(found["word"]), *logs(found["trigram"]), {k: i for i, k in enumerate(found["script"])}, in_use)


class _Index(dict):
    """Row of the score matrix by word."""

    def __init__(self, model: LanguageModel) -> None:
        self.model, self.lower, self.used = model, {}, 0
        self.scores = np.zeros((1024, len(model.languages)), "f4")

    def add(self, texts: list[list[str]]) -> None:
        """Scores the words that are new, all at once."""
        if len(self) > CACHE:
            self.clear()
            self.lower.clear()
            self.used, self.scores = 0, self.scores[:1024].copy()
        new = {w: w.lower() for w in set().union(*texts).difference(self)}
        keys = list(set(new.values()).difference(self.lower))
        end = self.used + len(keys)
        if end > len(self.scores):
            self.scores = np.concatenate([self.scores, np.zeros((max(end - len(self.scores), len(self.scores)), self.scores.shape[1]), "f4")])
        for at in range(0, len(keys), BLOCK):
            part = keys[at : at + BLOCK]
            self.scores[self.used + at : self.used + at + len(part)] = self.model.score(part)
        self.lower.update(zip(keys, range(self.used, end)))
        self.used = end
        self.update((w, self.lower[key]) for w, key in new.items())


def one_label(scores: np.ndarray, switch: float) -> int | None:
    """The label that a document's best path keeps from end to end, if that is certain without a search: it has the
    largest sum of all, and no run of words gains more than half a change costs by another label, whereas a path of m runs of
    other labels, m above 1, has m - 1 changes at least."""
    k = int(scores.sum(axis=0, dtype=float).argmax())
    gain = np.cumsum(scores - scores[:, k : k + 1], axis=0, dtype=float)
    low = np.minimum(np.minimum.accumulate(gain, axis=0), 0)
    low[1:], low[0] = low[:-1].copy(), 0
    return k if (gain - low).max() <= switch / 2 else None


def best_paths(scores: np.ndarray, lengths: list[int], switch: float = SWITCH) -> list[np.ndarray]:
    """The best label of each word of each document: ``scores`` has one row a word, documents end to end."""
    ends = np.cumsum(lengths)
    sure = [one_label(scores[e - n : e], switch) if n else None for e, n in zip(ends, lengths)]
    rest = [i for i, (k, n) in enumerate(zip(sure, lengths)) if k is None and n]
    searched = _viterbi([scores[ends[i] - lengths[i] : ends[i]] for i in rest], switch)
    out = [np.full(n, k or 0, "u2") for k, n in zip(sure, lengths)]
    for i, path in zip(rest, searched):
        out[i] = path
    return out


def _viterbi(docs: list[np.ndarray], switch: float) -> list[np.ndarray]:
    """One pass over all documents at once, longest first, so that those still running stand in front. A step into a label
    either stays in it or comes from the best of all: one label a step and one bit a label are kept."""
    if not docs:
        return []
    scores, lengths = np.concatenate(docs), np.array([len(d) for d in docs])
    starts = np.cumsum(lengths) - lengths
    order = np.argsort(-lengths, kind="stable")
    start, running = starts[order], lengths[order]
    longest = int(running[0])
    alive = np.searchsorted(-running, -np.arange(longest), side="left")  # documents of more than t words
    stayed, came = np.zeros(scores.shape, bool), np.zeros(len(scores), "u2")
    last, here = np.zeros(len(lengths), int), scores[start].copy()
    for t in range(1, longest):
        n = alive[t]
        at = start[:n] + t
        if n < alive[t - 1]:
            last[n : alive[t - 1]] = here[n : alive[t - 1]].argmax(axis=1)
        h = here[:n]
        top = h.argmax(axis=1)
        best = h[np.arange(n), top][:, None] - switch
        came[at], stayed[at] = top, h >= best
        here[:n] = np.maximum(h, best) + scores[at]
    last[: alive[-1]] = here[: alive[-1]].argmax(axis=1)
    out, now = np.zeros(len(scores), "u2"), last
    for t in range(longest - 1, -1, -1):
        n = alive[t]
        at = start[:n] + t
        out[at] = now[:n]
        if t:
            now[:n] = np.where(stayed[at, now[:n]], now[:n], came[at])
    return np.split(out, starts[1:])


def _labelled(model: LanguageModel, index: _Index, switch: float, ids: list, texts: list[str], words: list[list[str]]) -> pd.DataFrame:
    names, out = model.languages, []
    index.add(words)
    places = np.concatenate([np.fromiter(map(index.__getitem__, w), "i8", len(w)) for w in words])
    paths = best_paths(index.scores[places], [len(w) for w in words], switch)
    for i, text, w, path in zip(ids, texts, words, paths):
        if not len(path):
            out.append((i, UNKNOWN, 0.0, []))
            continue
        letters = np.bincount(path, weights=np.fromiter(map(len, w), "i8", len(w)), minlength=len(names))
        firsts = [0, *(np.flatnonzero(np.diff(path.astype(int))) + 1).tolist()]
        begin = set(firsts)
        starts = [0] if len(firsts) == 1 else [m.start() for k, m in enumerate(_WORD.finditer(text)) if k in begin]
        starts[0] = 0
        spans = [{"start": a, "end": b, "lang": names[path[k]]} for a, b, k in zip(starts, [*starts[1:], len(text)], firsts)]
        best = int(letters.argmax())
        out.append((i, names[best], float(letters[best] / letters.sum()), spans))
    return pd.DataFrame(out, columns=["id", "lang_pred", "score", "spans"])


def _identify(model: LanguageModel, switch: float) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = _Index(model)
        ids, texts, words, cells = [], [], [], 0
        for x in batches:
            for i, text in zip(x["id"], x["body"]):
                text, found = find_words(text) if model.languages else (text, [])
                ids.append(i)
                texts.append(text)
                words.append(found)
                cells += len(found) * len(model.languages) + 64
                if cells >= CELLS:
                    yield _labelled(model, index, switch, ids, texts, words)
                    ids, texts, words, cells = [], [], [], 0
        if ids:
            yield _labelled(model, index, switch, ids, texts, words)

    return run


def identify_languages(docs: DataFrame, model: LanguageModel, switch: float = SWITCH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, lang_pred, score, spans (array of start, end, lang in code points).

    A word's script narrows the languages; its score is the log posterior by word and letter trigrams; Viterbi with a
    penalty for every change labels the words (where sums alone show that it never changes, without a search), and runs of one label are spans that cover the text. The language with
    most letters is the document's, its part of the letters the score. A text that is null, empty or has no letter gives
    ``und``, score 0 and no spans, and so does any text if nothing was learned.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).cast("string").alias("id"), body(text_col).alias("body"))
    with small_batches(docs.sparkSession):
        found = stored(rows.mapInPandas(_identify(model, switch), "id string, lang_pred string, score double, spans array<struct<start: int, end: int, lang: string>>"), "languages")
    return found.withColumn("id", F.col("id").cast(kind)).withColumnRenamed("id", id_col)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn_languages(docs, ~held_out("doc_id", 3, 1))
    return identify_languages(docs, model).select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))


SQL: dict[str, str] = {}

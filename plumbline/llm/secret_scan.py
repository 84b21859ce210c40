"""Secret scans by grammar inference: probabilistic automata learned from credentials score all candidates."""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from plumbline.llm.common import body, salt, small_batches, stored, table

KINDS = ("assign", "access", "hex")
LIKE = {k: f"like_{k}" for k in KINDS}
_ORDER = {k: i for i, k in enumerate((*KINDS, *LIKE.values()))}
#: Documents read to learn, about, and credentials of a kind and plain candidates that an automaton is learned from, at most.
SAMPLE, EXAMPLES = 20_000, 300
#: Significance of the test that keeps two states apart; log-likelihood ratio, in nats, that makes a candidate a span.
ALPHA, RATIO = 0.05, 12.0
_UNSEEN = math.log(1e-5)

_ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
# A run of 24 or more is the same match as a maximal run that has 24 or more; likewise 20 after AKIA.
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
#: Characters of the shortest candidate, unless a caller says otherwise: shorter words carry little format.
SHORTEST = 16


@functools.cache
def _candidate(shortest: int) -> re.Pattern:
    return re.compile(rf"[A-Za-z0-9+/_=-]{{{shortest},}}")


_CANDIDATE = _candidate(SHORTEST)
_CLASSES = (("0123456789", "d"), ("abcdef", "h"), ("ghijklmnopqrstuvwxyz", "l"), ("ABCDEF", "H"), ("GHIJKLMNOPQRSTUVWXYZ", "U"), ("+/", "s"), ("_-", "m"), (".", "p"), ("=", "e"))
_CLASS = str.maketrans({c: k for cs, k in _CLASSES for c in cs})


def base_spans(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, credential) of the base patterns, in order."""
    found = [(m.start(), m.end(), "assign", m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), m.end(), "access", m[0]) for m in _ACCESS.finditer(text)]
    found += [(m.start(), m.end(), "hex", m[0]) for m in _HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[0], _ORDER[x[2]]))


def candidates(text: str, taken: list[tuple[int, int, str, str]], shortest: int = SHORTEST) -> list[tuple[int, int]]:
    """Runs of ``shortest`` or more credential characters that touch no base span; ``taken`` is in order of starts."""
    out, k, reach = [], 0, 0  # the furthest end of the base spans that start before the run's end
    for m in _candidate(shortest).finditer(text):
        a, b = m.span()
        while k < len(taken) and taken[k][0] < b:
            reach = max(reach, taken[k][1])
            k += 1
        if reach <= a:
            out.append((a, b))
    return out


@dataclass
class Automaton:
    """States with counts; ``next[s][symbol] = [state, count]``."""

    next: list[dict[str, list[int]]] = field(default_factory=lambda: [{}])
    ends: list[int] = field(default_factory=lambda: [0])
    total: list[int] = field(default_factory=lambda: [0])

    def add(self, word: str, n: int = 1) -> None:
        s = 0
        self.total[0] += n
        for c in word:
            if c not in self.next[s]:
                self.next[s][c] = [len(self.next), 0]
                self.next.append({})
                self.ends.append(0)
                self.total.append(0)
            self.next[s][c][1] += n
            s = self.next[s][c][0]
            self.total[s] += n
        self.ends[s] += n

    def likelihood(self, word: str) -> float:
        """Log-likelihood; a symbol without a transition costs a fixed amount and leaves the state as it is."""
        s, out = 0, 0.0
        for c in word:
            if (t := self.next[s].get(c)) is None:
                out += _UNSEEN
            else:
                out += math.log(t[1] / self.total[s])
                s = t[0]
        return out + (math.log(self.ends[s] / self.total[s]) if self.ends[s] else _UNSEEN)


def infer(words: Iterable[tuple[str, int]], alpha: float = ALPHA) -> Automaton:
    """A prefix tree of the (word, count) pairs whose states are merged, in breadth-first order, where a Hoeffding bound cannot tell their
    ends and transitions apart, all the way down."""
    a = Automaton()
    for w, n in sorted(words):
        a.add(w, n)
    limit = math.sqrt(0.5 * math.log(2 / alpha))

    def differ(f1: int, n1: int, f2: int, n2: int) -> bool:
        return abs(f1 / n1 - f2 / n2) > limit * (n1**-0.5 + n2**-0.5)

    def compatible(p: int, q: int) -> bool:
        todo = [(p, q)]
        while todo:
            p, q = todo.pop()
            if p == q:
                continue
            n, m = a.total[p], a.total[q]
            if differ(a.ends[p], n, a.ends[q], m):
                return False
            for c in a.next[p].keys() | a.next[q].keys():
                x, y = a.next[p].get(c), a.next[q].get(c)
                if differ(x[1] if x else 0, n, y[1] if y else 0, m):
                    return False
                if x and y:
                    todo.append((x[0], y[0]))
        return True

    def fold(p: int, q: int) -> None:
        """Adds the tree below q to p."""
        todo = [(p, q)]
        while todo:
            p, q = todo.pop()
            a.ends[p] += a.ends[q]
            a.total[p] += a.total[q]
            for c, (s, n) in a.next[q].items():
                if c in a.next[p]:
                    a.next[p][c][1] += n
                    todo.append((a.next[p][c][0], s))
                else:
                    a.next[p][c] = [s, n]

    kept = [0]
    while True:
        fringe = next(((p, c) for p in kept for c in sorted(a.next[p]) if a.next[p][c][0] not in kept), None)
        if fringe is None:
            return a
        p, c = fringe
        q = a.next[p][c][0]
        for r in kept:
            if compatible(r, q):
                a.next[p][c][0] = r
                fold(r, q)
                break
        else:
            kept.append(q)


@dataclass
class SecretModel:
    automata: dict[str, Automaton]
    plain: Automaton
    shortest: int = SHORTEST

    def kind(self, word: str, ratio: float) -> str | None:
        """The kind whose format makes the word likelier than plain text does by the ratio; None if none does."""
        w = word.translate(_CLASS)
        scores = {k: a.likelihood(w) for k, a in self.automata.items()}
        best = max(scores, key=scores.__getitem__, default=None)
        plain = max(self.plain.likelihood(w), self.plain.likelihood(word.lower().translate(_CLASS)))  # a shouted word is a word
        return best if best and scores[best] - plain >= ratio else None


def _examples(shortest: int) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            out = []
            for text in x["body"]:
                base = base_spans(text)
                out += [(kind, word.translate(_CLASS)) for *_, kind, word in base]
                out += [("plain", text[a:b].translate(_CLASS)) for a, b in candidates(text, base, shortest)]
            yield pd.DataFrame(out, columns=["kind", "form"])

    return run


def learn_secrets(docs: DataFrame, sample: int = SAMPLE, examples: int = EXAMPLES, shortest: int = SHORTEST, id_col: str = "doc_id", text_col: str = "text") -> SecretModel:
    """Automata from the credentials that the base patterns label and one from the remaining candidates.

    About ``sample`` documents are read, chosen by a digest of id and text (rows that repeat both count once), and of each
    kind ``examples`` forms at most, the most frequent ones, then by a digest. Candidates have ``shortest`` characters or more.
    Credentials are strings of character classes. Kinds without credentials have no automaton.
    """
    share = sample / max(1, docs.count())
    rows = docs.select(F.col(id_col).alias("id"), body(text_col).alias("body"))
    rows = rows.filter(F.pmod(F.xxhash64("id", "body", F.lit("secrets")), F.lit(1_000_000)) < min(1.0, share) * 1_000_000).distinct()
    with small_batches(docs.sparkSession):
        rows = rows.select("body").mapInPandas(_examples(shortest), "kind string, form string")
        rows = stored(rows.groupBy("kind", "form").agg(F.count(F.lit(1)).alias("n")), "secret-forms")  # bounded by the sample
    few = lambda *by: F.row_number().over(Window.partitionBy("kind", *by).orderBy(F.desc("n"), F.xxhash64("form"), "form"))
    rows = rows.select("*", salt("form", salts=16).alias("salt")).select("*", few("salt").alias("nth")).filter(F.col("nth") <= examples)
    found = rows.select("kind", "form", "n", few().alias("nth")).filter(F.col("nth") <= examples).collect()  # bounded by kinds and examples
    forms: dict[str, list[tuple[str, int]]] = {}
    for r in found:
        forms.setdefault(r["kind"], []).append((r["form"], r["n"]))
    plain = infer(forms.pop("plain", []))
    return SecretModel({k: infer(v) for k, v in sorted(forms.items())}, plain, shortest)


def _scan(model: SecretModel, ratio: float) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo: dict[str, str | None] = {}
        for x in batches:
            out = []
            for i, text in zip(x["id"], x["body"]):
                base = base_spans(text)
                spans = [{"start": a, "end": b, "kind": k} for a, b, k, _ in base]
                for a, b in candidates(text, base, model.shortest):
                    word = text[a:b]
                    if word not in memo:
                        if len(memo) > 100_000:
                            memo.clear()
                        memo[word] = model.kind(word, ratio)
                    if memo[word]:
                        spans.append({"start": a, "end": b, "kind": LIKE[memo[word]]})
                out.append((i, sorted(spans, key=lambda s: (s["start"], _ORDER[s["kind"]]))))
            yield pd.DataFrame(out, columns=["id", "spans"])

    return run


def find_secrets(docs: DataFrame, model: SecretModel, ratio: float = RATIO, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, spans (array of start, end, kind in code points, end exclusive).

    Base kinds are ``assign``, ``access`` and ``hex``; the automata add ``like_assign``, ``like_access`` and ``like_hex`` for
    runs of credential characters outside base spans whose format is likelier, by ``ratio`` nats, than plain text. Null
    and empty texts have no spans.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).cast("string").alias("id"), body(text_col).alias("body"))
    with small_batches(docs.sparkSession):
        found = stored(rows.mapInPandas(_scan(model, ratio), "id string, spans array<struct<start: int, end: int, kind: string>>"), "secret-spans")
    return found.select(F.col("id").cast(kind).alias(id_col), "spans")


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = find_secrets(docs, learn_secrets(docs))
    written = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"].isin(*KINDS))
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in KINDS],
        F.sha2(written(base).cast("binary"), 256).alias("base_sha256"),
        written(F.col("spans")).alias("spans"),
    )


SQL: dict[str, str] = {}

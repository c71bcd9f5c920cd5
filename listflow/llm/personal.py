"""Personal data: fixed patterns, and a skip-chain conditional random field that adds what they miss.

Patterns with checks (Luhn, sizes) find e-mail addresses, IP addresses, card and
phone numbers. The field then labels words. Only a word with a digit or an @ can
be part of personal data, so the chains of a document are its runs of such words,
joined by transition scores. Words that are alike, however far apart in the
document, are joined by skip edges: the same digits or address, or the same last
seven digits. An edge rewards equal kinds at both ends. Sum-product messages go
round these loops until they settle, so one clear occurrence carries the unclear
ones: a number without its prefix, or two cards that a pattern reads as one.

The field is fitted here to what the patterns find in a bounded sample of
documents, by gradient ascent with the messages' own marginals. Documents in which
a pattern reads several words with ten digits or more as one number and drops it,
or finds only one of two words that are alike, are left out of the fit, as nobody
knows their labels; they are what the field is for. Everything else reads whole
texts, each document by itself.
"""

from __future__ import annotations

import pickle
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate
from dataclasses import dataclass, field as member

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from listflow.llm.common import chunks, small_batches, text_bytes

KINDS = ("email", "ip", "card", "phone")
#: Documents with a digit or an @ to fit on.
SAMPLE = 20_000
#: The labels: none, address, IP address, and first or later word of a card or phone number.
LABELS = ("o", "email", "ip", "card", "card+", "phone", "phone+")
KIND_OF = np.array([-1, 0, 1, 2, 2, 3, 3])
FIRST_OF, LATER_OF = np.array([1, 2, 3, 5]), np.array([1, 2, 4, 6])
NEVER = -30.0
#: Edges whose messages are worked out at a time.
EDGES = 16_384
#: Most digits of a card or phone number of several words, by kind.
LONGEST = {2: 19, 3: 15}

_ANY = re.compile(r"[0-9@]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# No shorter or later start in a run of digits can match where its first fails.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORD = re.compile(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+")
_GAP = re.compile(r"[\x20\x09-\x0D]+")
_CORE = re.compile(r"[A-Za-z0-9+(]")
_DOTTED = re.compile(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}")
_NUMBER = re.compile(r"[0-9().+-]*")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    floor, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            floor = domain.end()
            yield start, floor
        at = text.find("@", max(at + 1, floor))


def matches(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]]]:
    """Spans (start, kind, end) that the patterns find and the checks pass, in order; and those that the checks drop."""
    kept, dropped = [(s, 0, e) for s, e in _emails(text)], []
    for m in _IP.finditer(text):
        parts = [p.lstrip("0") for p in m[0].split(".")]
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
            kept.append((m.start(), 1, m.end()))
        else:
            dropped.append(m.span())
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            kept.append((m.start(), 2, m.end()))
        else:
            dropped.append(m.span())
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                kept.append((m.start(), 3, m.end()))
            else:
                dropped.append(m.span())
    return sorted(kept), dropped


_SIZES = (1, 3, 4, 5, 7, 8, 10, 12, 14, 20)
_CLASSES = ("address", "dotted", "digits", "number", "mixed", "other")
_MARKS = ("plus", "bracket", "hyphen", "point", "luhn", "quoted", "before", "after", "wide")
_N_SHAPES = len(_CLASSES) * (len(_SIZES) + 1)
FEATURES = 1 + _N_SHAPES + len(_CLASSES) + len(_SIZES) + 1 + len(_MARKS)
#: Features that a word has at most; the rest of its row points at one without weight.
WIDTH = 4 + len(_MARKS)


@dataclass
class Words:
    """Words of documents that can be personal data, laid end to end."""

    start: list[int] = member(default_factory=list)
    end: list[int] = member(default_factory=list)
    run: list[int] = member(default_factory=list)
    features: list[list[int]] = member(default_factory=list)
    skips: list[tuple[int, int, int]] = member(default_factory=list)

    def add(self, text: str) -> None:
        """The words of one more document."""
        last, seen = -1, {}
        first = len(self.start)
        for m in _WORD.finditer(text):
            word = m[0]
            core = _CORE.search(word)
            a, b = core.start() if core else 0, len(word)
            while b > a + 1 and not (word[b - 1].isalnum() or word[b - 1] == ")"):
                b -= 1
            joined = last >= 0 and _GAP.fullmatch(text, last, m.start()) is not None
            last = m.end()
            i = len(self.start)
            self.run.append(self.run[-1] if joined else i)
            self.start.append(m.start() + a)
            self.end.append(m.start() + b)
            body = word[a:b]
            digits = _NOT_DIGIT.sub("", body)
            self.features.append(self._shape(word, body, digits, joined))
            if joined:
                self.features[-2].append(1 + _N_SHAPES + len(_CLASSES) + len(_SIZES) + 1 + _MARKS.index("after"))
            if "@" in body:
                keys = [(0, body.lower())]
            else:
                keys = [(0, digits)] * (len(digits) >= 4) + [(1, digits[-7:])] * (len(digits) >= 7)
            tied = -1
            for kind, key in keys:
                before = seen.get((kind, key), -1)
                if before >= first and before != tied:
                    self.skips.append((before, i, kind))
                    tied = before
                seen[kind, key] = i

    @staticmethod
    def _shape(word: str, body: str, digits: str, joined: bool) -> list[int]:
        n = int(np.searchsorted(_SIZES, len(digits), side="right"))
        if "@" in body:
            kind = 0
        elif _DOTTED.fullmatch(body):
            kind = 1
        elif len(digits) == len(body):
            kind = 2
        elif _NUMBER.fullmatch(body):
            kind = 3
        else:
            kind = 4 if any(c.isalpha() for c in body) else 5
        marks = (body.startswith("+"), "(" in body, "-" in body, "." in body, kind == 2 and 14 <= len(digits) <= 19 and luhn(digits), '"' in word or "=" in word, joined, False, not body.isascii())
        at = 1 + _N_SHAPES
        out = [0, 1 + kind * (len(_SIZES) + 1) + n, at + kind, at + len(_CLASSES) + n]
        at += len(_CLASSES) + len(_SIZES) + 1
        return out + [at + k for k, m in enumerate(marks) if m]

    def labels(self, first: int, kept: list[tuple[int, int, int]]) -> list[int]:
        """The labels of the words from ``first`` on that follow from spans of the patterns."""
        out, at = [], 0
        for i in range(first, len(self.start)):
            while at < len(kept) and kept[at][2] <= self.start[i]:
                at += 1
            own = next((k for k in kept[at:] if k[0] < self.end[i] and self.start[i] < k[2]), None) if at < len(kept) and kept[at][0] < self.end[i] else None
            if own is None:
                out.append(0)
            else:
                later = i > first and self.run[i] == self.run[i - 1] and own[0] < self.end[i - 1]
                out.append(int((LATER_OF if later else FIRST_OF)[own[1]]))
        return out


class Graph:
    """Nodes, chains and skip edges, both ways, as arrays; messages go along them."""

    def __init__(self, words: Words):
        n = len(words.start)
        self.rows = np.full((n, WIDTH), FEATURES, np.int64)
        for i, f in enumerate(words.features):
            self.rows[i, : len(f)] = f
        run = np.array(words.run, np.int64)
        later = np.flatnonzero(run[1:] == run[:-1]) + 1 if n else np.zeros(0, np.int64)
        skips = np.array(words.skips, np.int64).reshape(-1, 3)
        self.chains, self.skip_kind = len(later), skips[:, 2]
        self.kind = np.concatenate((np.zeros(len(later), np.int64), 1 + skips[:, 2]))
        self.a = np.concatenate((later - 1, skips[:, 0]))
        self.b = np.concatenate((later, skips[:, 1]))
        self.opens = np.ones(n, bool)
        self.opens[later] = False
        self.into_a, self.into_b = np.zeros((len(self.a), len(LABELS))), np.zeros((len(self.a), len(LABELS)))

    def scores(self, model: Field) -> np.ndarray:
        unary = np.vstack([model.weights, np.zeros(len(LABELS))])[self.rows].sum(axis=1)
        unary[self.opens] += np.where(np.isin(np.arange(len(LABELS)), (4, 6)), NEVER, 0.0)
        return unary

    def pairs(self, model: Field) -> np.ndarray:
        """The scores of two labels for each kind of edge: in a chain, and the two kinds of skips."""
        return np.stack([model.steps + FORBIDDEN, *(reward * ALIKE for reward in model.skips)])

    def belief(self, unary: np.ndarray) -> np.ndarray:
        total = unary.copy()
        np.add.at(total, self.a, self.into_a)
        np.add.at(total, self.b, self.into_b)
        return total

    def pass_messages(self, unary: np.ndarray, pair: np.ndarray, rounds: int, tolerance: float = 1e-4) -> np.ndarray:
        """Sum-product messages, damped, until they settle; the beliefs in logarithms. Edges are taken ``EDGES`` at a time."""
        total = self.belief(unary)
        for _ in range(rounds if len(self.a) else 0):
            change = 0.0
            for i in range(0, len(self.a), EDGES):
                some = slice(i, i + EDGES)
                between, old_a, old_b = pair[self.kind[some]], self.into_a[some], self.into_b[some]
                to_b = _log_sum((total[self.a[some]] - old_a)[:, :, None] + between, 1)
                to_a = _log_sum((total[self.b[some]] - old_b)[:, None, :] + between, 2)
                to_a, to_b = (0.5 * old + 0.5 * (new - new.max(axis=1, keepdims=True)) for old, new in ((old_a, to_a), (old_b, to_b)))
                change = max(change, np.abs(to_a - old_a).max(), np.abs(to_b - old_b).max())
                self.into_a[some], self.into_b[some] = to_a, to_b
            total = self.belief(unary)
            if change < tolerance:
                break
        return total


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def _normal(x: np.ndarray) -> np.ndarray:
    p = np.exp(x - x.max(axis=tuple(range(1, x.ndim)), keepdims=True))
    return p / p.sum(axis=tuple(range(1, x.ndim)), keepdims=True)


#: A later word of a number follows its first or another later one.
FORBIDDEN = np.zeros((len(LABELS), len(LABELS)))
FORBIDDEN[:, 4] = FORBIDDEN[:, 6] = NEVER
FORBIDDEN[3:5, 4] = FORBIDDEN[5:7, 6] = 0.0
#: Whether two labels are of one kind.
ALIKE = (KIND_OF[:, None] == KIND_OF[None, :]).astype(float)


@dataclass(frozen=True)
class Field:
    """Scores of features and transitions for each label, and the reward of equal kinds for the two kinds of skip edges."""

    weights: np.ndarray
    steps: np.ndarray
    skips: np.ndarray


def no_field() -> Field:
    """Labels nothing; used where the patterns find nothing to fit to."""
    weights = np.zeros((FEATURES, len(LABELS)))
    weights[0, 0] = 10.0
    return Field(weights, np.zeros((len(LABELS),) * 2), np.zeros(2))


def fit(words: Words, labels: np.ndarray, rounds: int = 120, rate: float = 0.15, decay: float = 2e-4) -> Field:
    """Fit to labelled words; messages are kept from round to round, so few are needed in each."""
    graph, n = Graph(words), max(1, len(labels))
    truth = np.eye(len(LABELS))[labels]
    params = [np.zeros((FEATURES, len(LABELS))), np.zeros((len(LABELS),) * 2), np.ones(2)]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    c = graph.chains
    real = np.eye(len(LABELS))[labels[graph.a[:c]]].T @ np.eye(len(LABELS))[labels[graph.b[:c]]]
    agreed = ALIKE[labels[graph.a[c:]], labels[graph.b[c:]]]
    # common shapes must not drown the rare ones
    weight = 1.0 / np.sqrt(np.maximum(np.bincount(labels, minlength=len(LABELS)), 1) / n)[labels]
    weight /= weight.mean()
    for step in range(1, rounds + 1):
        model = Field(*params)
        unary, pair = graph.scores(model), graph.pairs(model)
        total = graph.pass_messages(unary, pair, 3)
        both = _normal((total[graph.a] - graph.into_a)[:, :, None] + pair[graph.kind] + (total[graph.b] - graph.into_b)[:, None, :])
        error = (truth - _normal(total)) * weight[:, None]
        first = np.zeros((FEATURES + 1, len(LABELS)))
        np.add.at(first, graph.rows.ravel(), np.repeat(error, WIDTH, axis=0))
        alike = agreed - (both[c:] * ALIKE).sum(axis=(1, 2))
        skips = np.bincount(graph.skip_kind, weights=alike, minlength=2)
        grads = [first[:FEATURES] / n - decay * params[0], (real - both[:c].sum(axis=0)) / n - decay * params[1], skips / n - decay * (params[2] - 1.0)]
        for j, g in enumerate(grads):
            m[j], v[j] = 0.9 * m[j] + 0.1 * g, 0.999 * v[j] + 0.001 * g * g
            params[j] = params[j] + rate * (m[j] / (1 - 0.9**step)) / (np.sqrt(v[j] / (1 - 0.999**step)) + 1e-8)
    return Field(*params)


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text in text_bytes(batch.column(0)):
            text = text.decode()
            kept, dropped = matches(text)
            words = Words()
            words.add(text)
            unknown = any(bisect_left(words.start, t) - bisect_right(words.end, s) > 1 and sum(map(str.isdigit, text[s:t])) >= 10 for s, t in dropped)
            labels = words.labels(0, kept)
            unknown |= any((labels[a] > 0) != (labels[b] > 0) for a, b, _ in words.skips)
            out.append(None if unknown else pickle.dumps((words.run, words.features, words.skips, labels)))
        yield pa.record_batch([pa.array(out, pa.binary())], names=["words"])


def fit_field(docs: DataFrame, text: str = "text", sample: int = SAMPLE) -> Field:
    """Fit a field to what the patterns find in at most ``sample`` documents with a digit or an @.

    They are chosen by a hash of their text, so reruns agree, and equal texts count
    once. The driver gets the shapes of their words, no text.
    """
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(text).cast("string").alias("text")).where(F.col("text").rlike("[0-9@]")).withColumn("h", F.xxhash64("text"))
    limit = texts.select("h").distinct().orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    if limit is None:
        return no_field()
    found = texts.where(F.col("h") <= limit).dropDuplicates(["h"]).select("text").mapInArrow(_sampled, "words binary").where("words is not null").collect()
    words, labels = Words(), []
    for row in sorted(bytes(r.words) for r in found):
        run, features, skips, own = pickle.loads(row)
        at = len(words.run)
        words.run += [at + r for r in run]
        words.features += features
        words.skips += [(at + a, at + b, k) for a, b, k in skips]
        labels += own
    words.start = words.end = [0] * len(words.run)
    if not any(labels):
        return no_field()
    return fit(words, np.array(labels))


def _added(text: str, words: Words, belief: np.ndarray, first: int, last: int, kept: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans of the words from ``first`` to ``last`` that overlap none of the patterns'."""
    out: list[list[int]] = []
    for i in range(first, last):
        p = belief[i]
        x = int(p.argmax())
        kind = int(KIND_OF[x])
        goes_on = x in (4, 6) and out and out[-1][3] == i - 1 and out[-1][1] == kind and words.run[i] == words.run[i - 1]
        if goes_on and sum(map(str.isdigit, text[out[-1][0] : words.end[i]])) <= LONGEST[kind]:
            out[-1][2:] = [words.end[i], i]
            continue
        if x in (4, 6):
            # too long for one number, so another begins here, perhaps of another kind
            p = np.where(np.isin(np.arange(len(LABELS)), (4, 6)), 0.0, p)
            p, x = p / p.sum(), int(p.argmax())
            kind = int(KIND_OF[x])
        if kind >= 0 and p[KIND_OF == kind].sum() >= 0.5:
            out.append([words.start[i], kind, words.end[i], i])
    spans = []
    starts, reach = [s for s, _, _ in kept], list(accumulate((e for _, _, e in kept), max))
    for a, kind, b, _ in out:
        while a < b and not (text[a].isalnum() or kind == 3 and text[a] in "+("):
            a += 1
        while b > a and not text[b - 1].isalnum():
            b -= 1
        earlier = bisect_left(starts, b)
        if a < b and not (earlier and reach[earlier - 1] > a):
            spans.append((a, kind, b))
    return spans


def find_personal(docs: DataFrame, model: Field, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: ``doc_id``, and ``base`` and ``spans``, lists of ``kind``, ``start`` and ``end``.

    ``base`` has what the patterns find, ``spans`` that and what the field adds,
    by start and then by kind in the order of ``KINDS``. Places count code points,
    ends are exclusive. A span that the field adds overlaps none of the base. A null
    or empty text has no spans. Each row is a document: ids may be null or
    repeated. An empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def told(spans: list[tuple[int, int, int]]) -> list[dict]:
        return [{"kind": KINDS[k], "start": a, "end": b} for a, k, b in spans]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = text_bytes(batch.column(1))
            for begin, end in chunks(raw):
                words, parts = Words(), []
                for t in raw[begin:end]:
                    t = t.decode()
                    first, kept = len(words.start), []
                    if _ANY.search(t):
                        kept, _ = matches(t)
                        words.add(t)
                    parts.append((t, first, len(words.start), kept))
                graph = Graph(words)
                belief = _normal(graph.pass_messages(graph.scores(model), graph.pairs(model), 100)) if words.start else np.zeros((0, len(LABELS)))
                spans = [sorted(kept + _added(t, words, belief, x, y, kept)) if y > x else kept for t, x, y, kept in parts]
                yield pa.record_batch([batch.column(0).slice(begin, end - begin), pa.array([told(p[3]) for p in parts], kind), pa.array([told(s) for s in spans], kind)], names=["doc_id", "base", "spans"])

    shape = "array<struct<kind:string,start:long,end:long>>"
    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"doc_id long, base {shape}, spans {shape}")


def digests(found: DataFrame) -> DataFrame:
    """Counts by kind and digests of what ``find_personal`` returns."""

    def listed(spans: str):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, KINDS), F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"))

"""Quality rules: a linear-chain conditional random field labels the lines of a text.

Each line is content or boilerplate. Its features are shares of symbols,
capitals, digits and repeated words and the like; Viterbi decoding finds the
best sequence of labels, and a text stays when enough of its words stand in
content lines. Fixed rules on the whole text reject it before that.

The field is fitted here, by gradient ascent on its log-likelihood, on a bounded
sample of labelled texts (``SAMPLE`` of each class by the hash of their id). Only
texts are labelled, so a line takes the label of its text; texts are read whole,
in runs of ``RUN`` lines. Runs of a good and a bad text joined, in either order,
show the field where the label changes, so that it can find boilerplate within a
text and the share of content decides. Everything else reads whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from listflow.llm.common import Words, chunks, small_batches, text_bytes

SAMPLE = 1000
#: Lines of a labelled text that the fit takes as one sequence.
RUN = 32
#: Least share of words in content lines.
SHARE = 0.5
FEATURES = ("bias", "symbols", "exclamations", "capitals", "digits", "words", "word_length", "echoes", "repeats", "duplicate", "sentence_end", "empty")
#: Brings shares that are small even in junk to the range of the others.
SCALE = np.array([1, 10, 10, 2, 5, 1, 1, 5, 3, 1, 1, 1], float)


def _class(chars: bytes) -> np.ndarray:
    out = np.zeros(256, np.int64)
    out[list(chars)] = 1
    return out


_SYMBOL = _class(b"#*$%&|<>")
_UPPER = _class(bytes(range(65, 91)))
_LETTER = _UPPER + _class(bytes(range(97, 123)))
_DIGIT = _class(bytes(range(48, 58)))
_POINT = np.ones(256, np.int64)
_POINT[0x80:0xC0] = 0
_END = _class(b".!?:;\"")


@dataclass(frozen=True)
class Field:
    """Scores of a line's features for the label content, and of the first label and each step (0 boilerplate, 1 content)."""

    weights: tuple[float, ...]
    start: tuple[float, float]
    steps: tuple[tuple[float, float], tuple[float, float]]


#: Used where the labels do not have both classes.
PRIOR = Field((2.0, -4.0, -2.0, -2.0, -1.0, 0.0, 0.0, -1.0, -1.0, -0.5, 0.5, 0.0), (0.0, 0.0), ((1.0, -1.0), (-1.0, 1.0)))


class Lines:
    """Features and labels of the lines of several texts, and the fixed counts of each text."""

    def __init__(self, texts: list[bytes]):
        w = Words(texts)
        b, n_texts = w.bytes, len(texts)
        stop = np.flatnonzero(b == 10)
        start = np.concatenate(([0], stop[:-1] + 1)) if len(stop) else np.zeros(0, np.int64)
        self.first = np.searchsorted(start, w.text_start)
        self.count = np.diff(self.first)
        text_of = np.repeat(np.arange(n_texts), self.count)

        def per_line(flags: np.ndarray) -> np.ndarray:
            return np.add.reduceat(flags, start) if len(start) else np.zeros(0, np.int64)

        line_of_word = np.searchsorted(start, w.start, side="right") - 1
        self.words = np.bincount(line_of_word, minlength=len(start))
        size = w.end - w.start
        points = np.concatenate(([0], np.cumsum(_POINT[b])))
        word_points = points[w.end] - points[w.start]
        symbols = per_line(_SYMBOL[b])
        repeated = self._repeated(w)
        echo = np.zeros(len(w.hash), bool)
        echo[1:] = (w.hash[1:] == w.hash[:-1]) & (line_of_word[1:] == line_of_word[:-1])

        duplicate = np.zeros(len(start), bool)
        for i in range(n_texts):
            seen: set[bytes] = set()
            for k in range(self.first[i], self.first[i + 1]):
                if self.words[k]:
                    line = w.data[start[k] : stop[k]]
                    duplicate[k] = line in seen
                    seen.add(line)

        chars = np.bincount(line_of_word, weights=size, minlength=len(start))
        some, letters = np.maximum(chars, 1), np.maximum(per_line(_LETTER[b]), 1)
        words = np.maximum(self.words, 1)
        last = np.zeros(len(start), np.int64)
        last[line_of_word] = _END[b[w.end - 1]]
        self.features = np.stack(
            [
                np.ones(len(start)),
                symbols / some,
                per_line((b == 33).astype(np.int64)) / some,
                per_line(_UPPER[b]) / letters,
                per_line(_DIGIT[b]) / some,
                np.log1p(self.words) / 4,
                np.minimum(chars / words / 10, 3),
                np.bincount(line_of_word, weights=echo, minlength=len(start)) / words,
                np.bincount(line_of_word, weights=repeated, minlength=len(start)) / words,
                duplicate,
                last,
                self.words == 0,
            ],
            axis=1,
        ) * SCALE

        def per_text(values: np.ndarray) -> np.ndarray:
            return np.bincount(text_of, weights=values, minlength=n_texts).astype(np.int64)

        self.n_words = w.count
        self.word_chars = np.bincount(w.text, weights=word_points, minlength=n_texts).astype(np.int64)
        self.n_symbols, self.n_dup_lines = per_text(symbols), per_text(duplicate)
        self.n_repeat_words = np.bincount(w.text, weights=repeated, minlength=n_texts).astype(np.int64)
        self.base_failed = (self.n_words < 10) | (100 * self.n_repeat_words > 20 * self.n_words)

    @staticmethod
    def _repeated(w: Words, n: int = 5) -> np.ndarray:
        """Words in n-word windows that occur more than once in their text."""
        inside = w.inside(n)
        at = np.flatnonzero(inside)
        key = w.shingles(n)[at] ^ ((w.text[at].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
        _, group, sizes = np.unique(key, return_inverse=True, return_counts=True)
        again = at[sizes[group] > 1]
        cover = np.zeros(len(w.hash) + 1, np.int64)
        np.add.at(cover, again, 1)
        np.add.at(cover, again + n, -1)
        return np.cumsum(cover)[:-1] > 0

    def content(self, field: Field) -> np.ndarray:
        return viterbi(self.features @ np.array(field.weights), self.first[:-1], self.count, field)

    def verdict(self, field: Field, share: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Labels of lines, the share of words in content lines, and whether the text stays."""
        labels = self.content(field)
        text_of = np.repeat(np.arange(len(self.count)), self.count)
        held = np.bincount(text_of, weights=self.words * labels, minlength=len(self.count)) / np.maximum(self.n_words, 1)
        return labels, held, ~self.base_failed & (held >= share)


def viterbi(score: np.ndarray, first: np.ndarray, count: np.ndarray, field: Field) -> np.ndarray:
    """Best labels of the lines of each text; ``score`` is each line's for content. All texts advance together."""
    order = np.argsort(-count, kind="stable")
    first, count = first[order], count[order]
    labels = np.zeros(len(score), bool)
    longest = int(count[0]) if len(count) else 0
    active = np.searchsorted(-count, -np.arange(longest), side="left")
    (s00, s01), (s10, s11) = field.steps
    back: list[tuple[np.ndarray, np.ndarray]] = []
    d0 = d1 = np.zeros(0)
    ends = []
    for t in range(longest):
        k = active[t]
        e = score[first[:k] + t]
        if t == 0:
            d0, d1 = np.full(k, field.start[0]), field.start[1] + e
            back.append((np.zeros(k, bool), np.zeros(k, bool)))
        else:
            ends.append((d0[k:], d1[k:]))
            from_0, from_1 = d1[:k] + s10 > d0[:k] + s00, d1[:k] + s11 > d0[:k] + s01
            d0, d1 = np.where(from_0, d1[:k] + s10, d0[:k] + s00), np.where(from_1, d1[:k] + s11, d0[:k] + s01) + e
            back.append((from_0, from_1))
    ends.append((d0, d1))
    now = np.zeros(0, bool)
    for t in range(longest - 1, -1, -1):
        e0, e1 = ends[t]
        now = np.concatenate((now, e1 > e0))
        labels[first[: active[t]] + t] = now
        now = np.where(now, back[t][1], back[t][0])
    return labels


def fit(features: list[np.ndarray], content: Sequence[bool | np.ndarray], weights: np.ndarray | None = None, rounds: int = 300, rate: float = 0.2, decay: float = 1e-5, enough: float = 0.005) -> Field:
    """Fit the field to sequences of labelled lines: exact gradients by forward and backward sums.

    ``content`` is one label for all lines of a sequence, or one for each. Without
    ``weights``, those of either single label weigh as much in all. It ends
    when ten rounds gain less than ``enough`` of what is left to gain.
    """
    count = np.array([len(f) for f in features])
    order = np.argsort(-count, kind="stable")
    count = count[order]
    n, longest = len(count), int(count[0])
    x, truth = np.concatenate([features[k] for k in order]), np.zeros((n, longest))
    for i, k in enumerate(order):
        truth[i, : count[i]] = content[k]
    real = np.arange(longest)[None, :] < count[:, None]
    inner = real[:, 1:]
    active = (count[:, None] > np.arange(longest)).sum(axis=0).tolist()
    of_line, of_step = np.nonzero(real)[0], np.nonzero(inner)[0]
    if weights is None:
        y = truth[:, 0].astype(int)
        weights = (n / 2 / np.maximum(np.bincount(y, minlength=2), 1)[y])[np.argsort(order)]
    weight = weights[order] / (weights[order] * count).sum()
    label = truth.astype(int)
    seen = np.zeros((2, 2))
    np.add.at(seen, (label[:, :-1][inner], label[:, 1:][inner]), weight[of_step])
    truth, opens = truth[real], np.cumsum(count) - count
    params = np.zeros(len(FEATURES) + 6)
    m, v = np.zeros_like(params), np.zeros_like(params)
    reached: list[float] = []

    for step in range(1, rounds + 1):
        w, start, steps = params[: len(FEATURES)], params[-6:-4], params[-4:].reshape(2, 2)
        emit = np.zeros((n, longest, 2))
        emit[real, 1] = score = x @ w
        ahead, behind = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
        ahead[:, 0] = start + emit[:, 0]
        for t in range(1, longest):
            k = active[t]
            before = ahead[:k, t - 1]
            ahead[:k, t] = np.logaddexp(before[:, :1] + steps[0], before[:, 1:] + steps[1]) + emit[:k, t]
        for t in range(longest - 2, -1, -1):
            k = active[t + 1]
            after = emit[:k, t + 1] + behind[:k, t + 1]
            behind[:k, t] = np.logaddexp(after[:, :1] + steps[:, 0], after[:, 1:] + steps[:, 1])
        total = np.logaddexp.reduce(ahead[np.arange(n), count - 1], axis=1)
        single = np.exp(ahead[real] + behind[real] - total[of_line, None])
        pair = np.exp(ahead[:, :-1][inner][:, :, None] + steps + (emit + behind)[:, 1:][inner][:, None, :] - total[of_step, None, None])
        right = (weight * (start[label[:, 0]] - total)).sum() + (weight[of_line] * score * truth).sum() + (seen * steps).sum()
        reached.append(float(right))
        if step > 10 and reached[-1] - reached[-11] < enough * -reached[-1]:
            break
        grad = np.zeros_like(params)
        grad[: len(FEATURES)] = (weight[of_line] * (truth - single[:, 1])) @ x
        grad[-6:-4] = weight @ (np.eye(2)[label[:, 0]] - single[opens])
        grad[-4:] = (seen - np.tensordot(weight[of_step], pair, 1)).ravel()
        grad -= decay * params
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        params = params + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    steps = params[-4:].reshape(2, 2)
    return Field(tuple(params[: len(FEATURES)].tolist()), tuple(params[-6:-4].tolist()), tuple(tuple(r) for r in steps.tolist()))


def _sampled_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        texts = text_bytes(batch.column(1))
        for begin, end in chunks(texts):
            lines = Lines(texts[begin:end])
            out += [lines.features[a:b].astype("<f4").tobytes() for a, b in zip(lines.first, lines.first[1:])]
        yield pa.record_batch([batch.column(0), pa.array(out, pa.binary())], names=["good", "features"])


def training_runs(good: list[np.ndarray], bad: list[np.ndarray], run: int = RUN) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Sequences, labels of their lines and weights: runs of good texts, of bad ones, and of both joined."""
    good, bad = ([t[i : i + run] for t in side for i in range(0, len(t), run)] for side in (good, bad))
    joined = [pair[:: 1 - k % 2 * 2] for k, pair in enumerate(zip(good, bad))]
    sequences = good + bad + [np.concatenate(p) for p in joined]
    labels = [np.ones(len(t)) for t in good] + [np.zeros(len(t)) for t in bad]
    labels += [np.concatenate([np.full(len(t), float(k % 2 == at)) for at, t in enumerate(p)]) for k, p in enumerate(joined)]
    return sequences, labels, np.repeat([1 / len(good), 1 / len(bad), 1 / len(joined)], [len(good), len(bad), len(joined)])


def fit_field(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE, run: int = RUN) -> Field:
    """Fit a field on at most ``sample`` labelled texts of each class, each read whole.

    Without labelled texts of both classes it is ``PRIOR``. Null labels, ids and
    texts are left out. Of several texts with one id, the first in order counts; an id
    with both labels counts as good. At most ``2 * sample`` ids are broadcast, and
    as many tables of features come to the driver.
    """
    small_batches(docs.sparkSession)
    known = labels.select(F.col(id_column).alias("id"), (F.col(label) == 1).alias("good")).where("id is not null and good is not null").groupBy("id").agg(F.max("good").alias("good"))
    known = known.withColumn("order", F.xxhash64("id"))
    chosen = None
    for good in (False, True):
        part = known.where(F.col("good") == good).orderBy("order", "id").limit(sample).select("id", "good")
        chosen = part if chosen is None else chosen.union(part)
    texts = docs.select(F.col(id_column).alias("id"), F.col(text).cast("string").alias("text")).where("text is not null")
    found = texts.join(F.broadcast(chosen), "id").groupBy("id").agg(F.min("text").alias("text"), F.first("good").alias("good"))
    rows = sorted((r.good, bytes(r.features)) for r in found.select("good", "text").mapInArrow(_sampled_lines, "good boolean, features binary").collect())
    sides = [[np.frombuffer(f, "<f4").reshape(-1, len(FEATURES)).astype(float) for good, f in rows if good == side] for side in (True, False)]
    if not all(sides):
        return PRIOR
    return fit(*training_runs(*sides, run))


def quality(docs: DataFrame, field: Field, id_column: str = "doc_id", text: str = "text", share: float = SHARE) -> DataFrame:
    """Per row of ``docs``: the counts, ``base_failed``, ``kept``, ``content_share`` and a letter per line (c or b).

    A null text counts as empty: no words, so the base rules fail it. An id is
    passed on as it is, null or repeated. An empty table gives no rows.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_bytes(batch.column(1))
            for begin, end in chunks(texts):
                x = Lines(texts[begin:end])
                labels, held, kept = x.verdict(field, share)
                letters = np.where(labels, "c", "b")
                marks = ["".join(letters[x.first[i] : x.first[i + 1]]) for i in range(end - begin)]
                counts = [pa.array(a, pa.int64()) for a in (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words)]
                yield pa.record_batch([batch.column(0).slice(begin, end - begin), *counts, pa.array(x.base_failed), pa.array(kept), pa.array(held), pa.array(marks)], schema=out)

    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    schema = T.StructType([T.StructField("doc_id", T.LongType())] + [T.StructField(c, T.LongType()) for c in counts] + [T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType()), T.StructField("content_share", T.DoubleType()), T.StructField("lines", T.StringType())])
    out = pa.schema([("doc_id", pa.int64())] + [(c, pa.int64()) for c in counts] + [("base_failed", pa.bool_()), ("kept", pa.bool_()), ("content_share", pa.float64()), ("lines", pa.string())])
    return docs.select(F.col(id_column).cast("long"), F.col(text).cast("string")).mapInArrow(run, schema)


def keep_content(docs: DataFrame, field: Field, text: str = "text", share: float = SHARE) -> DataFrame:
    """The rows of ``docs`` that stay, unchanged, with all their columns."""
    small_batches(docs.sparkSession)
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_bytes(batch.column(place))
            kept = [Lines(texts[a:b]).verdict(field, share)[2] for a, b in chunks(texts)]
            if kept:
                yield batch.filter(pa.array(np.concatenate(kept)))

    return docs.mapInArrow(run, docs.schema)

"""Cross-tokenizer alignment by interval coalescing.

Tokens of both tokenizers are byte intervals of a space and the text. All of
them, sorted by start, are walked once with the running maximum of their ends:
where a start reaches it, both sides end together and a new group begins. Within
a group, every token of A is linked with each token of B whose bytes it shares.
Many texts are laid end to end and aligned at once.

What a link is worth needs the whole corpus: in how many documents its pair of
ids is linked, and whether that is the most for its id of A. Texts are encoded
once. Each task cuts its documents into blocks, writes a row per document whose
links point into the distinct pairs of its block, and a row per block with those
pairs and how many of its documents hold each. Pairs are summed over all blocks,
sent back to the blocks that asked, and there meet the documents' links. So only
distinct pairs of blocks cross the network besides the documents' packed links,
and no table of pairs has to fit one machine.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from listflow.llm.common import chunks, small_batches, staged, text_bytes

#: Links of a block, unless one document has more.
BLOCK = 1 << 20
#: Bytes of text aligned at once, unless one text is longer.
STEP = 1 << 19
#: Distinct pieces of text whose ids a worker holds; beyond it, it starts over.
HELD_PIECES = 500_000
#: Texts of these characters alone are cut by the pattern here; classes of all others are left to the tokenizer.
_PLAIN = regex.compile(r"[\t\n\r -~\xa1-ɏ]*+")


class ByteLevel:
    """Ids and their bytes for a byte-level BPE; special tokens in a text are plain text."""

    #: The pattern of a byte-level pre-tokenizer that has none of its own.
    CUT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        spec = json.loads(self.tokenizer.to_str())
        before = spec["pre_tokenizer"] or {}
        self.known = spec["normalizer"] is None and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before["add_prefix_space"]
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        self.letters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        back = {c: b for b, c in self.letters.items()}
        self.bytes = [b""] * self.tokenizer.get_vocab_size()
        for token, i in self.tokenizer.get_vocab().items():
            self.bytes[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        self.pieces: dict[str, list[int]] = {}

    def _piece(self, piece: str) -> list[int]:
        if len(self.pieces) >= HELD_PIECES:
            self.pieces.clear()
        seen = piece.encode().decode("latin-1").translate(self.letters)
        ids = self.pieces[piece] = [t.id for t in self.model.tokenize(seen)]
        return ids

    def encode(self, texts: list[str]) -> Iterator[list[int]]:
        for text in texts:
            if self.known and _PLAIN.fullmatch(text):
                held, ids = self.pieces, []
                for piece in self.CUT.findall(text):
                    ids += held.get(piece) or self._piece(piece)
                yield ids
            else:
                yield self.tokenizer.encode(text, add_special_tokens=False).ids


class Pieces:
    """Ids and their bytes for a sentence-piece model with byte fallback."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        names = [self.model.id_to_piece(i) for i in range(n)]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]

    def encode(self, texts: list[str]) -> Iterator[list[int]]:
        yield from self.model.encode(texts, num_threads=1)


@lru_cache(maxsize=2)
def _encoders(a_path: str, b_path: str) -> tuple[ByteLevel, Pieces]:
    return ByteLevel(a_path), Pieces(b_path)


@lru_cache(maxsize=4)
def _spelled(ids: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of ``,id`` for each id, padded with zeros, and their numbers."""
    words = [b",%d" % i for i in range(ids)]
    size = np.fromiter(map(len, words), np.int64, ids)
    width = int(size.max(initial=1))
    return np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(ids, width), size


class Aligned:
    """Groups and links of several texts that both tokenizers cover byte by byte.

    ``a`` and ``b`` are the ids of all texts in turn, ``first_a`` and ``first_b``
    where each text's begin.
    """

    def __init__(self, a: list[list[int]], b: list[list[int]], a_bytes: list[bytes], b_bytes: list[bytes]):
        self.first_a, self.first_b = (np.concatenate(([0], np.cumsum(np.fromiter(map(len, x), np.int64, len(x))))) for x in (a, b))
        self.a, self.b = (np.concatenate([np.zeros(0, np.int64), *(np.array(i, np.int64) for i in x)]) for x in (a, b))
        size_a, size_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (a_bytes, b_bytes))
        self.end_a, self.end_b = np.cumsum(size_a[self.a]), np.cumsum(size_b[self.b])
        self.start_a, self.start_b = self.end_a - size_a[self.a], self.end_b - size_b[self.b]
        self.most = max(len(a_bytes), len(b_bytes))
        n = len(self.a)
        side = np.concatenate((np.zeros(n, np.int8), np.ones(len(self.b), np.int8)))
        start = np.concatenate((self.start_a, self.start_b))
        order = np.lexsort((side, start))
        reach = np.maximum.accumulate(np.concatenate((self.end_a, self.end_b))[order])
        new = np.ones(len(order), bool)
        new[1:] = start[order][1:] >= reach[:-1]
        group = np.empty(len(order), np.int64)
        group[order] = np.cumsum(new) - 1
        self.group_a, self.group_b = group[:n], group[n:]
        self.groups = int(new.sum())
        self.n_groups = np.diff(np.append(self.group_a, self.groups)[self.first_a])

    def spelled(self) -> list[bytes]:
        """Per text, ``a1,a2|b1;a3|b2,b3``: ids of A and B of each group in turn."""
        shown, size = _spelled(self.most)
        count_a, count_b = np.bincount(self.group_a, minlength=self.groups), np.bincount(self.group_b, minlength=self.groups)
        before_a, before_b = np.cumsum(count_a), np.cumsum(count_b) - count_b
        at_a, at_b = np.arange(len(self.a)) + before_b[self.group_a], np.arange(len(self.b)) + before_a[self.group_b]
        ids = np.empty(len(self.a) + len(self.b), np.int64)
        ids[at_a], ids[at_b] = self.a, self.b
        mark = np.full(len(ids), ord(","), np.uint8)
        mark[at_a[np.flatnonzero(np.diff(self.group_a, prepend=-1))]] = ord(";")
        mark[at_b[np.flatnonzero(np.diff(self.group_b, prepend=-1))]] = ord("|")
        letters = shown[ids]
        letters[:, 0] = mark
        flat = letters.ravel()
        text = flat[flat != 0].tobytes()
        to = np.concatenate(([0], np.cumsum(size[ids])))[self.first_a + self.first_b]
        # what stands before a text's first group belongs to none
        return [text[x + 1 : y] for x, y in zip(to[:-1].tolist(), to[1:].tolist())]

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Per text and distinct pair of linked ids: the pair as ``a << 32 | b``, and its links; where each text's begin; links of each text."""
        first = np.searchsorted(self.end_b, self.start_a, side="right")
        count = np.searchsorted(self.start_b, self.end_a, side="left") - first
        to = np.cumsum(count)
        total = int(to[-1]) if len(to) else 0
        other = np.arange(total) + np.repeat(first - (to - count), count)
        pair = np.repeat(self.a << 32, count) | self.b[other]
        texts = len(self.first_a) - 1
        edge = np.concatenate(([0], to))[self.first_a]
        pairs, times, begins = [], [], [0]
        for x, y in zip(edge[:-1].tolist(), edge[1:].tolist()):
            own = np.sort(pair[x:y])
            at = np.flatnonzero(np.diff(own, prepend=-1))
            pairs.append(own[at])
            times.append(np.diff(at, append=len(own)))
            begins.append(begins[-1] + len(at))
        empty = np.zeros(0, np.int64)
        return np.concatenate([empty, *pairs]), np.concatenate([empty, *times]), np.array(begins), np.diff(edge) if texts else empty


def aligned(texts: list[bytes], a_path: str, b_path: str) -> tuple[np.ndarray, Aligned]:
    """Which texts have tokens, and the alignment of those."""
    a_side, b_side = _encoders(a_path, b_path)
    spaced = [b" " + t for t in texts]
    some = [i for i, t in enumerate(texts) if t]
    words = [texts[i].decode() for i in some]
    a = list(a_side.encode([f" {w}" for w in words]))
    b = list(b_side.encode(words)) if words else []
    whole = [spaced[i] == b"".join(map(a_side.bytes.__getitem__, x)) == b"".join(map(b_side.bytes.__getitem__, y)) for i, x, y in zip(some, a, b)]
    kept = np.array([i for i, w in zip(some, whole) if w], np.int64)
    return kept, Aligned([x for x, w in zip(a, whole) if w], [y for y, w in zip(b, whole) if w], a_side.bytes, b_side.bytes)


_FIELDS = [("block", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups", pa.string()), ("n_pairs", pa.int64()), ("links", pa.binary()), ("pairs", pa.list_(pa.int64())), ("held", pa.list_(pa.int64()))]
_STAGED = "block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, n_pairs long, links binary, pairs array<long>, held array<long>"


class _Block:
    """Documents of one block, until their pairs are numbered."""

    def __init__(self, number: int):
        self.number, self.size, self.rows, self.pairs, self.times = number, 0, [], [], []

    def batches(self) -> Iterator[pa.RecordBatch]:
        pairs, place, held = np.unique(np.concatenate([np.zeros(0, np.int64), *self.pairs]), return_inverse=True, return_counts=True)
        at, out, size = 0, [], 0
        for row, times in zip(self.rows, self.times):
            own = place[at : at + len(times)]
            at += len(times)
            packed = np.concatenate((np.diff(own, prepend=0), times)).astype("<u4").tobytes()
            out.append((self.number, *row, len(times), pa.compress(packed, "zstd", asbytes=True) if packed else b"", None, None))
            size += len(out[-1][8]) + len(row[5])
            if size > 1 << 22:
                yield self._batch(out)
                out, size = [], 0
        out.append((self.number, *[None] * 8, pairs, held))
        yield self._batch(out)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, f[1]) for c, f in zip(zip(*rows), _FIELDS)], schema=pa.schema(_FIELDS))


def _align(a_path: str, b_path: str, digest: bool, block_links: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        block = _Block((context.partitionId() if context else 0) << 33)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), text_bytes(batch.column(1))
            for begin, end in chunks(texts, STEP):
                kept, x = aligned(texts[begin:end], a_path, b_path)
                pairs, times, first, n_links = x.links()
                spelled = x.spelled()
                place = dict(zip(kept.tolist(), range(len(kept))))
                for i in range(end - begin):
                    k = place.get(i)
                    if k is None:
                        row, own = (ids[begin + i], 0, 0, 0, 0, ""), slice(0, 0)
                    else:
                        groups = hashlib.sha256(spelled[k]).hexdigest() if digest else spelled[k].decode()
                        sizes = (int(x.first_a[k + 1] - x.first_a[k]), int(x.first_b[k + 1] - x.first_b[k]), int(x.n_groups[k]), int(n_links[k]))
                        row, own = (ids[begin + i], *sizes, groups), slice(first[k], first[k + 1])
                    block.rows.append(row)
                    block.pairs.append(pairs[own])
                    block.times.append(times[own])
                    block.size += row[4]
                    if block.size >= block_links:
                        yield from block.batches()
                        block = _Block(block.number + 1)
        if block.rows:
            yield from block.batches()

    return run


def _valued(docs: pa.Table, pairs: pa.Table) -> pa.Table:
    """Documents of one block with the counts of its pairs."""
    count, best = np.zeros(pairs.num_rows, np.int64), np.zeros(pairs.num_rows, bool)
    at = pairs.column("place").to_numpy()
    count[at], best[at] = pairs.column("n").to_numpy(), pairs.column("best").to_numpy(zero_copy_only=False)
    n_best, count_sum = [], []
    for packed, n in zip(docs.column("links").to_pylist(), docs.column("n_pairs").to_pylist()):
        both = np.frombuffer(pa.decompress(packed, 8 * n, "zstd", asbytes=True), "<u4").astype(np.int64) if n else np.zeros(0, np.int64)
        place, times = np.cumsum(both[:n]), both[n:]
        n_best.append(int(times[best[place]].sum()))
        count_sum.append(int((times * count[place]).sum()))
    kept = docs.select(["doc_id", "n_a", "n_b", "n_groups", "n_links"])
    return kept.append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(count_sum, pa.int64())).append_column("groups", docs.column("groups"))


def align_tokens(docs: DataFrame, a_path: str, b_path: str, id_column: str = "doc_id", text: str = "text", digest: bool = False, block_links: int = BLOCK) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``, ``count_sum`` and ``groups``.

    A (a byte-level BPE) reads a space and the text, B (a sentence-piece model
    that adds the space) the text. ``groups`` spells the ids of each group,
    ``a1,a2|b1;a3|b2,b3``, or with ``digest`` is the SHA-256 of that in hex.
    ``n_best`` counts the links whose pair of ids stands in as many documents as
    any pair of its id of A, ``count_sum`` adds up these numbers over all links.
    A null or empty text, and one whose joined token bytes on either side differ
    from the space and the text, has no tokens: zeros and an empty string. Each
    row is a document, so ids may be null or repeated. An empty table gives no
    rows. Both files must be on every executor.
    """
    small_batches(docs.sparkSession)
    plain = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    done = staged(plain.mapInArrow(_align(a_path, b_path, digest, block_links), _STAGED), "aligned")
    wanted = done.where("pairs is not null").select("block", F.posexplode(F.arrays_zip("pairs", "held")).alias("place", "of")).select("block", "place", F.col("of.pairs").alias("pair"), F.col("of.held").alias("held"))
    counts = wanted.groupBy("pair").agg(F.sum("held").alias("n")).withColumn("a", F.shiftright("pair", 32))
    counts = staged(counts, "pairs")
    top = counts.groupBy("a").agg(F.max("n").alias("top"))
    counts = counts.join(top, "a").select("pair", "n", (F.col("n") == F.col("top")).alias("best"))
    told = wanted.join(counts, "pair").select(F.col("block").alias("block"), "place", "n", "best")
    rows = done.where("pairs is null").drop("pairs", "held")
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"
    return rows.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(_valued, schema)

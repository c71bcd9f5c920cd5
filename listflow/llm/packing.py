"""Best-fit packing: token pieces go online into a fixed number of open sequences.

Each task reads its part of the documents once, encodes them and places every
piece as it comes: into the open sequence with the least free space that still
holds it, found as the lowest set bit, from the piece's length on, of a bitset
keyed by free space. When all places are open, the fullest sequence closes
first. So a task's memory is the pieces of the open bins and one batch.

What a task leaves open at its end, at most ``OPEN`` sequences, is packed once
more: the sequences are dealt to groups of bounded size, in which the same best
fit places their pieces anew, the longest first. So the number of sequences hardly
depends on how many tasks the documents came in.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F, types as T

from listflow.llm.common import Words, chunks, small_batches, staged, text_bytes

#: Open sequences of a task.
OPEN = 1024
#: Tokens of a group in which the sequences that tasks left open are packed again.
GROUP_TOKENS = 1 << 20
#: Distinct words whose ids a worker holds, and two fifths as many pieces of words; beyond it, it starts over.
HELD_WORDS = 1_000_000


#: Words for which lower case and pieces can be found here: no marks to join, no white space but the plain kind, no İ.
_PLAIN = regex.compile(r"[!-~\xa1-\u012f\u0131-\u024f]+")


class WordEncoder:
    """Ids of whole texts, as little-endian 32-bit numbers, for a byte-level BPE that drops white space.

    No token reaches across white space there, so a text's ids are those of its
    words in turn, and a word that was met before needs no encoding. Words are
    found by their hashes for many texts at once; each distinct one is looked up
    once. A new plain word is cut by the tokenizer's own pattern, and its model
    encodes the pieces, most of which are known; any other word goes to the
    tokenizer as a whole.
    """

    def __init__(self, path: str, held: int = HELD_WORDS):
        from tokenizers import Tokenizer

        self.held = held
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        spec = json.loads(self.tokenizer.to_str())
        self.special = [t["content"] for t in spec["added_tokens"]]
        split = next((p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"), None)
        self.cut = regex.compile(split).findall if split else None
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        self.letters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        self.words: dict[bytes, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _piece(self, piece: str) -> bytes:
        found = self.pieces.get(piece)
        if found is None:
            seen = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)
            found = array("I", [t.id for t in self.model.tokenize(seen)]).tobytes()
            if len(self.pieces) >= 2 * self.held // 5:
                self.pieces.clear()
            self.pieces[piece] = found
        return found

    def _new(self, word: bytes) -> bytes:
        text = word.decode()
        if self.cut is None or not _PLAIN.fullmatch(text) or any(s in text for s in self.special):
            return self._whole(text)
        text = text.lower()
        if text.isalpha():
            return self._piece(text)
        return b"".join([self._piece(p) for p in self.cut(text)])

    def encode(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        for begin, end in chunks(texts, 2 << 20):
            w = Words(texts[begin:end])
            _, example, which = np.unique(w.hash, return_index=True, return_inverse=True)
            if len(self.words) > self.held:
                self.words.clear()
            held, found, data = self.words, [], w.data
            for a, b in zip(w.start[example].tolist(), w.end[example].tolist()):
                word = data[a:b]
                ids = held.get(word)
                if ids is None:
                    ids = held[word] = self._new(word)
                found.append(ids)
            flat = np.frombuffer(b"".join(found), "<u4")
            size = np.fromiter(map(len, found), np.int64, len(found)) // 4
            first = np.cumsum(size) - size
            length = size[which]
            to = np.cumsum(length)
            ids = flat[np.repeat(first[which] - (to - length), length) + np.arange(to[-1] if len(to) else 0)]
            edge = np.concatenate(([0], to))[w.first]
            for i in range(end - begin):
                yield ids[edge[i] : edge[i + 1]]


@lru_cache(maxsize=2)
def encoder(path: str, held: int = HELD_WORDS) -> WordEncoder:
    return WordEncoder(path, held)


class BestFit:
    """Online best fit over at most ``most`` open bins of ``size``."""

    def __init__(self, size: int, most: int):
        self.size, self.most = size, most
        self.bins: list[list[int]] = [[] for _ in range(size + 1)]
        self.free, self.open, self.made = 0, 0, 0
        #: Bins that have closed, until the caller clears it.
        self.closed: list[int] = []

    def _put(self, number: int, free: int) -> None:
        if not free:
            self.closed.append(number)
        else:
            self.bins[free].append(number)
            self.free |= 1 << free
            self.open += 1

    def _take(self, free: int) -> int:
        number = self.bins[free].pop()
        if not self.bins[free]:
            self.free &= ~(1 << free)
        self.open -= 1
        return number

    def place(self, length: int) -> tuple[int, int]:
        """The bin for a piece and its offset there."""
        fit = self.free >> length
        if fit:
            free = length + (fit & -fit).bit_length() - 1
            number = self._take(free)
        else:
            if self.open >= self.most:
                self.closed.append(self._take((self.free & -self.free).bit_length() - 1))
            number, free = self.made, self.size
            self.made += 1
        self._put(number, free - length)
        return number, self.size - free


def pack(docs: DataFrame, tokenizer: str, id_column: str = "doc_id", text: str = "text", size: int = 4096, end_id: int = 1, most_open: int = OPEN, held_words: int = HELD_WORDS) -> DataFrame:
    """One row per piece: ``doc_id``, ``piece``, ``start``, ``length``, ``ids``, ``sequence_id`` and ``offset``.

    A document is its ids and then ``end_id``; a null or empty text is ``end_id``
    alone. One of more than ``size`` tokens is cut into pieces of that size, the
    last of which may be shorter. ``ids`` are little-endian 32-bit numbers.
    Pieces fill a sequence without gaps from 0 on. Null or repeated ids are passed
    on; each row is packed by itself. An empty table gives no rows. ``tokenizer``
    is the file of one that drops white space; it must be on every executor.
    """
    small_batches(docs.sparkSession)
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("sequence_id", pa.int64()), ("offset", pa.int64())]
    done = pa.schema(fields)
    first = done.append(pa.field("closed", pa.bool_()))
    last = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        base = (context.partitionId() if context else 0) << 33
        bins = BestFit(size, most_open)
        words = encoder(tokenizer, held_words)
        held: dict[int, list[tuple]] = {}
        out: list[tuple] = []
        tokens = 0
        for batch in batches:
            for doc, ids in zip(batch.column(0).to_pylist(), words.encode(text_bytes(batch.column(1)))):
                ids = ids.tobytes() + last
                n = len(ids) // 4
                for piece, start in enumerate(range(0, n, size)):
                    length = min(size, n - start)
                    number, offset = bins.place(length)
                    held.setdefault(number, []).append((doc, piece, start, length, ids[4 * start : 4 * (start + length)], base + number, offset, True))
                    for closed in bins.closed:
                        out += held.pop(closed)
                        tokens += size
                    bins.closed.clear()
                    if tokens > 1 << 20:
                        yield _batch(out, first)
                        out, tokens = [], 0
        for rows in held.values():
            out += [(*row[:-1], False) for row in rows]
            tokens += size
            if tokens > 1 << 20:
                yield _batch(out, first)
                out, tokens = [], 0
        yield _batch(out, first)

    def again(table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(table.column(f).to_pylist() for f in done.names)), key=lambda r: (-r[3], str(r[0]), r[1], r[4]))
        bins = BestFit(size, len(rows))
        base = (1 << 62) + (table.column("grp")[0].as_py() << 33)
        out = []
        for row in rows:
            number, offset = bins.place(row[3])
            out.append((*row[:5], base + number, offset))
        return pa.Table.from_batches([_batch(out, done)])

    types = [T.LongType(), T.IntegerType(), T.LongType(), T.LongType(), T.BinaryType(), T.LongType(), T.LongType()]
    shape = T.StructType([T.StructField(f[0], t) for f, t in zip(fields, types)])
    plain = docs.select(F.col(id_column).cast("long"), F.col(text).cast("string"))
    pieces = staged(plain.mapInArrow(run, T.StructType([*shape.fields, T.StructField("closed", T.BooleanType())])), "pieces")
    left = pieces.where("not closed")
    tokens = left.agg(F.sum("length")).first()[0]
    closed = pieces.where("closed").drop("closed")
    if not tokens:
        return closed
    group = F.pmod(F.xxhash64("sequence_id"), F.lit(-(-tokens // GROUP_TOKENS))).cast("long")
    return closed.union(left.withColumn("grp", group).drop("closed").groupBy("grp").applyInArrow(again, shape))


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(schema)
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

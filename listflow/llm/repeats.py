"""Substring dedup: fixed-block anchors, probed with every rolling window, extended to exact repeats.

A repeat of ``window`` words holds, wherever it stands, one whole block of
``(window + 1) // 2`` words that starts at a multiple of that size in its text.
So the blocks of all texts are the references, and every rolling window of a
block's size is a probe:

1. Texts are dealt to groups. A group sends each distinct probe once, with flags
   for "is a reference" and "occurs again in this group", as packed arrays to the
   part of the hash space it falls in. A common passage thus costs one entry per
   group and hash, not one per copy.
2. A part sends back to the groups the hashes that occur more than once and are
   a reference somewhere: the anchors.
3. A group extends each anchor: the windows of full length around it go, again
   packed and once per group, to their part of the hash space, which sends back
   those that start at more than one place. Neighbouring ones merge to maximal
   exact repeats.
4. Words under such a window are removed.

The texts cross the network once; the three steps that read them share that
exchange. Windows are compared by hashes of 63 bits and the part's number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from listflow.llm.common import Words, chunks, groups_for, hidden, mixed, small_batches, spread_rows, text_bytes, windows

#: Words of a group of texts, and probes of a part of the hash space.
GROUP, PART = 400_000, 2_000_000
LEAST = 64
_V30, _S34, _OTHER = np.uint64((1 << 30) - 1), np.uint64(34), np.uint64(0x5851F42D4C957F2D)


def _hashed(texts: list[bytes]) -> Iterator[Words]:
    for begin, end in chunks(texts):
        yield Words(texts[begin:end])


def _probes(w: Words, size: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the rolling windows of ``size`` words, and their part and 30 hash bits in one number."""
    at = np.flatnonzero(w.inside(size))
    h = windows(w.hash, size)[at]
    return at, ((h >> _S34) % np.uint64(parts) << np.uint64(30)) | (h & _V30)


def _full(w: Words, size: int, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whether a window of full length starts here, its part, and its hash with a spare low bit."""
    inside = w.inside(size)
    h = windows(w.hash, size)
    return inside, mixed(h ^ _OTHER) % np.uint64(parts), h & ~np.uint64(1)


def _packed(part: np.ndarray, entries: np.ndarray, group: int) -> pa.Table:
    """Rows (part, group, bytes) from entries in the order of their parts."""
    at = np.flatnonzero(np.diff(part, prepend=-1))
    to = np.append(at[1:], len(part))
    return pa.table({"part": pa.array(part[at], pa.int32()), "grp": pa.array(np.full(len(at), group), pa.int32()), "entries": pa.array([entries[a:b].tobytes() for a, b in zip(at, to)], pa.binary())})


def _send_probes(size: int, parts: int, place: int):
    def run(table: pa.Table) -> pa.Table:
        keys, aligned = [np.zeros(0, np.uint64)], [np.zeros(0, bool)]
        for w in _hashed(text_bytes(table.column(1 + place).combine_chunks())):
            at, key = _probes(w, size, parts)
            keys.append(key)
            aligned.append((at - w.first[w.text[at]]) % size == 0)
        key, mark = np.concatenate(keys), np.concatenate(aligned)
        order = np.argsort(key)
        key, mark = key[order], mark[order]
        at = np.flatnonzero(np.diff(key, prepend=np.uint64(1 << 63)))
        if not len(at):
            return _packed(np.zeros(0, np.int64), np.zeros(0, np.uint32), 0)
        again = np.diff(np.append(at, len(key))) > 1
        entry = ((key[at] & _V30) << np.uint64(2)) | (np.maximum.reduceat(mark, at).astype(np.uint64) << np.uint64(1)) | again
        return _packed((key[at] >> np.uint64(30)).astype(np.int64), entry.astype("<u4"), table.column(0)[0].as_py())

    return run


def _repeated(table: pa.Table, kind: str, flag_bits: int, anchors: bool) -> pa.Table:
    """Of the entries of one part, those found more than once (and, for anchors, a reference), sent back to each group that has them."""
    rows = [np.frombuffer(x, kind) for x in table.column("entries").to_pylist()]
    row = np.repeat(np.arange(len(rows)), [len(x) for x in rows])
    entry = np.concatenate(rows)
    order = np.argsort(entry, kind="stable")
    entry, row = entry[order], row[order]
    value = entry >> entry.dtype.type(flag_bits)
    at = np.flatnonzero(np.concatenate(([True], value[1:] != value[:-1])))
    flags = np.bitwise_or.reduceat(entry, at)
    size = np.diff(np.append(at, len(entry)))
    hit = (size > 1) | (flags & 1 > 0)
    if anchors:
        hit &= flags & 2 > 0
    keep = np.repeat(hit, size)
    value, row = value[keep], row[keep]
    order = np.argsort(row, kind="stable")
    value, row = value[order], row[order]
    first = np.flatnonzero(np.diff(row, prepend=-1))
    last = np.append(first[1:], len(row))
    part, group = table.column("part").to_pylist(), table.column("grp").to_pylist()
    back = [int(row[a]) for a in first]
    return pa.table({"grp": pa.array([group[r] for r in back], pa.int32()), "part": pa.array([part[r] for r in back], pa.int32()), "entries": pa.array([value[a:b].tobytes() for a, b in zip(first, last)], pa.binary())})


def _received(table: pa.Table, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """All values sent back to a group, sorted, and the part of each."""
    rows = [np.frombuffer(x, kind) for x in table.column("entries").to_pylist()]
    if not rows:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    part = np.repeat(np.array(table.column("part").to_pylist(), np.uint64), [len(x) for x in rows])
    value = np.concatenate(rows).astype(np.uint64)
    order = np.lexsort((part, value))
    return value[order], part[order]


def _among(sorted_values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(len(wanted), bool)
    at = np.searchsorted(sorted_values, wanted)
    at[at == len(sorted_values)] = 0
    return sorted_values[at] == wanted


def _send_windows(size: int, window: int, parts: int, place: int):
    def run(table: pa.Table, back: pa.Table) -> pa.Table:
        value, part = _received(back, "<u4")
        anchors = np.sort((part << np.uint64(30)) | value)
        out_part, out = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
        texts = text_bytes(table.column(1 + place).combine_chunks()) if table.num_rows and len(anchors) else []
        for w in _hashed(texts):
            at, key = _probes(w, size, parts)
            hit = at[_among(anchors, key)]
            near = np.zeros(len(w.hash) + 1, np.int64)
            np.add.at(near, np.maximum(hit - (window - size), 0), 1)
            np.add.at(near, hit + 1, -1)
            inside, own_part, h = _full(w, window, parts)
            start = np.flatnonzero((np.cumsum(near)[: len(inside)] > 0) & inside)
            out_part.append(own_part[start])
            out.append(h[start])
        part, h = np.concatenate(out_part), np.concatenate(out)
        order = np.lexsort((h, part))
        part, h = part[order], h[order]
        if not len(h):
            return _packed(np.zeros(0, np.int64), h, 0)
        at = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (part[1:] != part[:-1]))))
        again = np.diff(np.append(at, len(h))) > 1
        return _packed(part[at].astype(np.int64), h[at] | again.astype(np.uint64), table.column(0)[0].as_py())

    return run


def _cut(w: Words, i: int, gone: np.ndarray) -> str:
    """The text without its words in ``gone``: each run goes with the gap behind it."""
    at, to = w.text_start[i], w.text_start[i + 1] - 1
    first, last = w.first[i], w.first[i + 1]
    edge = np.flatnonzero(np.diff(gone[first:last].astype(np.int8), prepend=0, append=0))
    kept, begin = [], at
    for a, b in zip(edge[0::2], edge[1::2]):
        kept.append(w.data[begin : w.start[first + a]])
        begin = w.start[first + b] if first + b < last else to
    kept.append(w.data[begin:to])
    return b"".join(kept).decode()


def _remove(window: int, parts: int, place: int, out: str):
    def run(table: pa.Table, back: pa.Table) -> pa.Table:
        value, part = _received(back, "<u8")
        value = value << np.uint64(1)
        column = table.column(1 + place)
        new, n_words, n_removed, spans = [], [], [], []
        raw = column.combine_chunks()
        texts = text_bytes(raw) if table.num_rows else []
        for w in _hashed(texts):
            inside, own_part, h = _full(w, window, parts)
            start = np.flatnonzero(inside)
            if len(value):
                at = np.searchsorted(value, h[start])
                at[at == len(value)] = 0
                found = value[at] == h[start]
                # equal values of several parts are possible, if hardly likely
                while (later := found & (part[at] != own_part[start]) & (np.append(value, 0)[at + 1] == h[start])).any():
                    at[later] += 1
                start = start[found & (part[at] == own_part[start])]
            else:
                start = start[:0]
            cover = np.zeros(len(w.hash) + 1, np.int64)
            cover[start] += 1
            cover[start + window] -= 1
            gone = np.cumsum(cover)[:-1] > 0
            removed = np.bincount(w.text, weights=gone, minlength=len(w.count)).astype(np.int64)
            for i in range(len(w.count)):
                a, b = w.first[i], w.first[i + 1]
                n_words.append(int(b - a))
                n_removed.append(int(removed[i]))
                new.append(_cut(w, i, gone) if removed[i] else w.data[w.text_start[i] : w.text_start[i + 1] - 1].decode())
                edge = np.flatnonzero(np.diff(gone[a:b].astype(np.int8), prepend=0, append=0)) if removed[i] else []
                spans.append([{"start": int(s), "end": int(e)} for s, e in zip(edge[0::2], edge[1::2])])
        text = pa.array([None if null else t for t, null in zip(new, raw.is_null().to_pylist())] if table.num_rows else [], pa.string())
        kind = pa.struct([("n_words", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])
        told = pa.StructArray.from_arrays([pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(spans, kind[2].type)], fields=list(kind))
        result = table.set_column(1 + place, table.schema.field(1 + place).name, text)
        return result.append_column(out, told).drop_columns([table.schema.names[0]])

    return run


def remove_repeats(docs: DataFrame, text: str = "text", window: int = 35, out: str = "repeats") -> DataFrame:
    """``docs`` without the words under a window of ``window`` words that starts anywhere else too.

    Every copy goes, the first included; windows are those of the input. White
    space between kept words stays. A struct column ``out`` tells ``n_words``,
    ``n_removed`` and the removed ``spans`` as word places; a column of that name
    in ``docs`` is replaced. A null text stays null and has no words; texts shorter
    than a window lose nothing; a repeated row is a repeat of its texts. An empty
    table gives no rows. Other columns pass through.
    """
    small_batches(docs.sparkSession)
    docs = docs.drop(*[c for c in docs.columns if c.lower() == out.lower()])
    size = (window + 1) // 2
    groups, parts = groups_for(docs, text, (GROUP, PART), LEAST)
    name, place = hidden(docs, "group"), docs.columns.index(text)
    plain = docs.withColumn(text, F.col(text).cast("string"))
    # copies of a row are numbered, so they spread over groups as other rows do
    dealt = spread_rows(plain, name).select(F.pmod(name, F.lit(groups)).cast("int").alias(name), *plain.columns)

    def texts():
        # the same plan each time, so that its exchange runs once
        return dealt.groupBy(name)

    packed, back = "part int, grp int, entries binary", "grp int, part int, entries binary"
    probes = texts().applyInArrow(_send_probes(size, parts, place), packed)
    anchors = probes.groupBy("part").applyInArrow(lambda t: _repeated(t, "<u4", 2, True), back)
    near = texts().cogroup(anchors.groupBy("grp")).applyInArrow(_send_windows(size, window, parts, place), packed)
    found = near.groupBy("part").applyInArrow(lambda t: _repeated(t, "<u8", 1, False), back)
    told = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])))])
    schema = T.StructType([*plain.schema.fields, T.StructField(out, told)])
    return texts().cogroup(found.groupBy("grp")).applyInArrow(_remove(window, parts, place, out), schema)

"""Token counts by offset-mapped attribution.

Each document is encoded once, whole: its fields one after the other, each with
a line end behind it. Byte-level tokens cover the document without gaps, so
their lengths give the span of each, in characters. An interval join of the
sorted token spans with the sorted spans of fields or sections then gives each
token to a section. A token that crosses a boundary goes by an explicit rule:

``start``     to the section that holds its first character;
``majority``  to the section that holds most of its bytes, the earlier on a tie;
``split``     to all of them, each by its share of the bytes.

Tokens are attributed by bytes; spans are told in characters.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from listflow.llm.common import small_batches, text_bytes

RULES = ("start", "majority", "split")


@lru_cache(maxsize=2)
def _encoding(path: str, pattern: str):
    """The encoder of a rank file, and the number of bytes of each token."""
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    size = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        size[rank] = len(token)
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), size


def attribute(token_end: np.ndarray, section_start: np.ndarray, section_end: np.ndarray, rule: str) -> np.ndarray:
    """Tokens of each section. Tokens cover everything from 0 on; sections are sorted and touch, and some may be empty.

    An empty section gets none.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    token_start = np.concatenate(([0], token_end[:-1])) if len(token_end) else token_end
    # the last section that starts at or before the token and is not empty
    full = np.flatnonzero(section_end > section_start)
    out = np.zeros(len(section_start))
    if not len(full) or not len(token_end):
        return out
    start, end = section_start[full], section_end[full]
    first = np.searchsorted(end, token_start, side="right")
    last = np.searchsorted(start, token_end, side="left") - 1
    if rule == "start":
        return np.bincount(full[first], minlength=len(out)).astype(float)
    inside = first == last
    out += np.bincount(full[first[inside]], minlength=len(out))
    for k in np.flatnonzero(~inside):
        here = np.arange(first[k], last[k] + 1)
        part = np.minimum(end[here], token_end[k]) - np.maximum(start[here], token_start[k])
        if rule == "majority":
            out[full[here[int(np.argmax(part))]]] += 1
        else:
            out[full[here]] += part / part.sum()
    return out


def _sections(fields: list[bytes], mark: bytes) -> tuple[list[int], list[int], np.ndarray, np.ndarray]:
    """Field numbers, section numbers within the field, and byte spans; a mark belongs to the section it ends."""
    field, section, start, end, at = [], [], [], [], 0
    for i, value in enumerate(fields):
        whole = value + b"\n"
        cuts = [0]
        if mark:
            found = value.find(mark)
            while found >= 0:
                cuts.append(found + len(mark))
                found = value.find(mark, found + len(mark))
        cuts.append(len(whole))
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            field.append(i)
            section.append(k)
            start.append(at + a)
            end.append(at + b)
        at += len(whole)
    return field, section, np.array(start, np.int64), np.array(end, np.int64)


def token_counts(docs: DataFrame, fields: Sequence[str], ranks: str, pattern: str, mark: str = "\n", rule: str = "majority", id_column: str = "doc_id") -> DataFrame:
    """One row per section of each field: ``doc_id``, ``field``, ``section``, ``start``, ``end`` (characters) and ``n_tokens``.

    Sections of a field end with ``mark``; without a mark each field is one. A
    null field is empty: one section that holds only the line end behind it. So
    the counts of a row add up to the tokens of its whole document. Rows with a
    null or repeated id are counted by themselves. An empty table gives no rows.
    ``ranks`` is a byte-level rank file that every executor has.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    small_batches(docs.sparkSession)
    names, by = list(fields), mark.encode()
    arrow = pa.schema([("doc_id", pa.int64()), ("field", pa.string()), ("section", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("n_tokens", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, size = _encoding(ranks, pattern)
        for batch in batches:
            columns = [text_bytes(batch.column(1 + i)) for i in range(len(names))]
            ids = batch.column(0).to_pylist()
            parts: list[tuple] = []
            rows = 0
            for k, doc in enumerate(ids):
                values = [c[k] for c in columns]
                whole = b"".join(v + b"\n" for v in values)
                data = np.frombuffer(whole, np.uint8)
                token_end = np.cumsum(size[np.array(encoding.encode_ordinary(whole.decode()), np.int64)])
                field, section, start, end = _sections(values, by)
                points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
                parts.append((doc, field, section, points[start], points[end], attribute(token_end, start, end, rule)))
                rows += len(field)
                if rows > 50_000:
                    yield _batch(parts, names, arrow)
                    parts, rows = [], 0
            yield _batch(parts, names, arrow)

    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("field", T.StringType()), T.StructField("section", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("n_tokens", T.DoubleType())])
    return docs.select(F.col(id_column).cast("long").alias("id"), *[F.col(n).cast("string").alias(f"f{i}") for i, n in enumerate(names)]).mapInArrow(run, schema)


def _batch(parts: list[tuple], names: list[str], schema: pa.Schema) -> pa.RecordBatch:
    if not parts:
        return pa.record_batch([pa.array([], t) for t in schema.types], schema=schema)
    field = pa.DictionaryArray.from_arrays(pa.array([i for p in parts for i in p[1]], pa.int32()), pa.array(names)).cast(pa.string())
    size = [len(p[1]) for p in parts]
    ids = pa.array([p[0] for p in parts], pa.int64()).take(pa.array(np.repeat(np.arange(len(parts)), size)))
    section = pa.array([i for p in parts for i in p[2]], pa.int32())
    return pa.record_batch([ids, field, section, *[pa.array(np.concatenate([p[i] for p in parts])) for i in (3, 4, 5)]], schema=schema)

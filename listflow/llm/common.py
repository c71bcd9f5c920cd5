"""Shared parts: reading tables, staging in the shared folder, and words as arrays of hashes.

Words are maximal runs of bytes other than space and U+0009 to U+000D. A whole
Arrow batch is hashed at once: texts are laid end to end with a separator, and
numpy finds words, their hashes and the text that each belongs to.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from listflow.session import shared_dir

#: Bytes of text that one step of array work takes at most, unless one text is longer.
CHUNK_BYTES = 1 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xFF51AFD7ED558CCD)
_S29, _S32 = np.uint64(29), np.uint64(32)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds: texts can be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


#: Tables written by ``staged`` in this process that have not been dropped.
_WRITTEN: list[str] = []


def staged(df: DataFrame, purpose: str) -> DataFrame:
    """Write a result that several steps read to the shared folder and read it back.

    The copy outlives lost executors and cuts lineage. It stays until
    ``drop_staged`` or the owner of ``spark.checkpoint.dir`` removes it.
    """
    path = shared_dir(df.sparkSession, f"llm-{purpose}")
    _WRITTEN.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_staged(spark: SparkSession, since: int, keep: int = 1) -> None:
    """Remove the tables staged after the first ``since``, but for the last ``keep``.

    Only right when nothing that is still to be read depends on them.
    """
    gone = _WRITTEN[since : len(_WRITTEN) - keep]
    del _WRITTEN[since : len(_WRITTEN) - keep]
    for path in gone:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def staged_so_far() -> int:
    return len(_WRITTEN)


def hidden(df: DataFrame, stem: str) -> str:
    """A column name that the frame does not have yet, in any case."""
    taken = {c.lower() for c in df.columns}
    name = f"_{stem}"
    while name.lower() in taken:
        name = f"_{name}"
    return name


#: Copies of one row that are made in one go.
COPIES = 1000


def _holds_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(_holds_map(f.dataType) for f in kind.fields)
    return isinstance(kind, T.MapType) or isinstance(kind, T.ArrayType) and _holds_map(kind.elementType)


def spread_rows(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with a hash ``name`` that differs from row to row, also where rows are wholly alike.

    Rows that occur once are only hashed. Of those that occur several times, one
    stands for all: it is written out as often as it was counted, with a number
    in its hash. So copies spread as other rows do, the same way in every run.
    """
    by = [F.to_json(F.struct(f.name)) if _holds_map(f.dataType) else F.col(f.name) for f in docs.schema]
    hashed = docs.withColumn(name, F.xxhash64(*by))
    of = hidden(hashed, "of")
    several = staged(hashed.groupBy(name).agg(F.count("*").alias("n")).where("n > 1").select(F.col(name).alias("h"), "n"), "several")
    if not several.take(1):
        return hashed
    once = hashed.join(several.select(F.col("h").alias(of)), F.col(name) == F.col(of), "left_anti")
    held = [f"c{k}" for k in range(len(docs.columns))]
    alike = hashed.select(F.col(name).alias("key"), *[F.col(c).alias(k) for c, k in zip(docs.columns, held)]).join(several, F.col("key") == F.col("h"))
    one = alike.groupBy("h").agg(F.first("n").alias("n"), *[F.first(k).alias(k) for k in held])
    runs = one.withColumn("run", F.explode(F.expr(f"sequence(0, (n - 1) div {COPIES})"))).repartition("h", "run")
    copies = runs.withColumn("number", F.explode(F.expr(f"sequence(run * {COPIES}, least(n, (run + 1) * {COPIES}) - 1)")))
    return once.union(copies.select(*[F.col(k).alias(c) for c, k in zip(docs.columns, held)], F.xxhash64("h", "number").alias(name)))


def mixed(x: np.ndarray) -> np.ndarray:
    """Finish a 64-bit hash: every input bit reaches every output bit."""
    x = x ^ (x >> _S32)
    x *= _M3
    x ^= x >> _S29
    x *= _M2
    x ^= x >> _S32
    return x


class Words:
    """Words of several texts: ``hash``, ``text`` (index), ``start``/``end`` (bytes) and ``first`` (per text)."""

    def __init__(self, texts: list[bytes], lower: bool = False):
        self.data = b"\n".join(texts) + b"\n"
        sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        self.text_start = np.concatenate(([0], np.cumsum(sizes)))
        b = np.frombuffer(self.data, np.uint8)
        if lower:
            b = np.where((b >= 65) & (b <= 90), b + 32, b).astype(np.uint8)
        self.bytes = b
        gap = _SPACE[b]
        edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
        if len(b) and not gap[0]:
            edge = np.concatenate(([0], edge))
        self.start, self.end = edge[0::2], edge[1::2]
        letters = b[~gap].astype(np.uint64)
        size = self.end - self.start
        begin = np.cumsum(size) - size
        place = (np.arange(len(letters), dtype=np.int64) - np.repeat(begin, size)).astype(np.uint64)
        x = letters * _M1 + (place + np.uint64(1)) * _M2
        x ^= x >> _S29
        x *= _M3
        x ^= x >> _S32
        total = np.add.reduceat(x, begin) if len(begin) else np.zeros(0, np.uint64)
        self.hash = mixed(total + size.astype(np.uint64) * _M1)
        self.first = np.searchsorted(self.start, self.text_start)
        self.count = np.diff(self.first)
        self.text = np.repeat(np.arange(len(texts)), self.count)

    def shingles(self, n: int) -> np.ndarray:
        """Hash of the n words from each word on; only meaningful where they share a text."""
        h = self.hash
        if len(h) < n:
            return np.zeros(0, np.uint64)
        out = np.zeros(len(h) - n + 1, np.uint64)
        for j in range(n):
            out += h[j : len(h) - n + 1 + j] * factor(j)
        return mixed(out)

    def inside(self, n: int) -> np.ndarray:
        """Whether the n words from each position on are of one text."""
        if len(self.text) < n:
            return np.zeros(0, bool)
        return self.text[: len(self.text) - n + 1] == self.text[n - 1 :]


def factor(j: int) -> np.uint64:
    """The odd multiplier of the j-th word of a shingle."""
    return np.uint64((pow(0xBF58476D1CE4E5B9, j + 1, 1 << 64) | 1) & ((1 << 64) - 1))


_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64, and of its inverse."""
    if len(_POWERS.get("up", ())) < n:
        base, size = 0xD6E8FEB86659FD93, max(n, 1 << 16)
        for key, a in (("up", base), ("down", pow(base, -1, 1 << 64))):
            p = np.ones(size, np.uint64)
            filled = 1
            while filled < size:
                more = min(filled, size - filled)
                p[filled : filled + more] = p[:more] * np.uint64(pow(a, filled, 1 << 64))
                filled += more
            _POWERS[key] = p
    return _POWERS["up"][:n], _POWERS["down"][:n]


def windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive entries in time independent of n, by running sums."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    up, down = _powers(len(hashes))
    run = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes * up, dtype=np.uint64)))
    return mixed((run[n:] - run[:-n]) * down[: len(hashes) - n + 1])


def chunks(texts: list[bytes], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Index ranges of neighbouring texts of about ``limit`` bytes together."""
    begin, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield begin, i
            begin, size = i, 0
        size += len(t) + 1
    if begin < len(texts):
        yield begin, len(texts)


def text_bytes(column) -> list[bytes]:
    """An Arrow string column as UTF-8; null is empty."""
    import pyarrow as pa

    return [b"" if t is None else t for t in column.cast(pa.binary()).to_pylist()]


def groups_for(docs: DataFrame, text: str, per_group: Sequence[int], least: int = 1) -> list[int]:
    """Numbers of groups that hold about so many words each, from the bytes of all texts."""
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return [max(least, -(-size // (6 * n))) for n in per_group]

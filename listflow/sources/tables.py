"""Table snapshots and change logs on plain Parquet.

A snapshot version and a change batch are each one folder written in overwrite
mode under a number the caller chooses, so a write that is repeated after a lost
executor or a replayed batch ends in the same state.
"""

from __future__ import annotations

import threading
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from listflow.operators.lifecycle import latest_per_key
from listflow.session import shared_dir


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None, schema: T.StructType | None = None) -> DataFrame:
    """Scan with only the named columns."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    df = reader.parquet(path)
    return df.select(*columns) if columns else df


def with_month(df: DataFrame, ts: str = "posted_date", name: str = "posted_month") -> DataFrame:
    return df.withColumn(name, F.date_format(ts, "yyyy-MM"))


def staged(df: DataFrame, purpose: str = "staged") -> DataFrame:
    """Write rows to the shared folder once and read them back.

    For a costly input with several readers. The written table also cuts the
    lineage, so a lost executor repeats a read and not the work before it.
    """
    path = shared_dir(df.sparkSession, purpose)
    getattr(_SCRATCH, "paths", []).append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Per thread, as streams run in threads of their own: what ``staged`` has written since ``scratch`` was entered.
_SCRATCH = threading.local()


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Remove at its end what ``staged`` writes inside: for work that is done when it is left, as a batch of a stream."""
    outer, _SCRATCH.paths = getattr(_SCRATCH, "paths", None), []
    try:
        yield
    finally:
        for path in _SCRATCH.paths:
            drop_path(spark, path)
        if outer is None:
            del _SCRATCH.paths
        else:
            _SCRATCH.paths = outer


def write_snapshot(df: DataFrame, base: str, version: int, partition_by: tuple[str, ...] = ("is_active",)) -> str:
    """Write one whole version. Readers keep the earlier one until told otherwise."""
    path = f"{base}/version={version}"
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a folder, wherever the table is kept."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def logged_batches(spark: SparkSession, log: str) -> list[int]:
    """The numbers of the batches that a log holds, in order."""
    place = spark._jvm.org.apache.hadoop.fs.Path(log)
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in fs.listStatus(place)] if fs.exists(place) else []
    return sorted(int(n.removeprefix("batch=")) for n in names if n.startswith("batch="))


class BatchState:
    """A small table that each batch of a stream replaces, kept as one folder per batch.

    Batch ``n`` reads what the batch before it wrote and writes its own folder.
    Older ones go, so disk and reads stay those of two states, and a replayed
    batch finds the state that it found the first time.
    """

    def __init__(self, spark: SparkSession, path: str, schema: "T.StructType | str"):
        self.spark, self.path, self.schema = spark, path, schema

    def before(self, batch: int) -> DataFrame:
        earlier = [b for b in logged_batches(self.spark, self.path) if b < batch]
        if not earlier:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/batch={earlier[-1]}")

    def write(self, df: DataFrame, batch: int) -> DataFrame:
        write_changes(df, self.path, batch)
        for old in [b for b in logged_batches(self.spark, self.path) if b < batch][:-1]:
            drop_path(self.spark, f"{self.path}/batch={old}")
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/batch={batch}")


def append_rows(df: DataFrame, path: str, batch: int) -> None:
    """Add a batch of rows as a folder of its own; writing it again replaces it, so a retry doubles nothing."""
    df.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def write_changes(df: DataFrame, log: str, batch: int) -> None:
    """Write one batch of changed rows; writing it again replaces it."""
    df.write.mode("overwrite").parquet(f"{log}/batch={batch}")


def read_changes(spark: SparkSession, log: str, before: int | None = None, schema: "T.StructType | str | None" = None) -> DataFrame:
    """All logged rows with their ``batch``, optionally of earlier batches only."""
    df = (spark.read.schema(schema) if schema is not None else spark.read).parquet(log)
    return df if before is None else df.where(F.col("batch") < before)


def current_rows(log: DataFrame, key: str, only_keys: DataFrame | None = None, order: Column | None = None) -> DataFrame:
    """Latest state of each key.

    With ``only_keys`` (a batch's keys) the log is reduced to them before the
    window, so one batch does not pay for the whole table.
    """
    if only_keys is not None:
        log = log.join(only_keys.select(key).distinct(), key, "left_semi")
    return latest_per_key(log, [key], [order if order is not None else F.desc("batch")]).drop("batch")


class MergeLog:
    """A table as a base and the batches of changes since, both cut by a hash of the key.

    A batch reads only the folders of its own keys' buckets. After
    ``compact_every`` batches the current rows become a new base; the base before
    it and the changes since that stay until the next one, so that a replayed batch
    finds what it found, and all older folders go. So disk holds two bases and
    the changes of at most twice ``compact_every`` batches, whatever has run.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: str = "dedup_hash", buckets: int = 64, compact_every: int = 8):
        self.spark, self.path, self.schema, self.key = spark, path, schema, key
        self.buckets, self.compact_every = buckets, compact_every

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _write(self, df: DataFrame, kind: str, batch: int) -> None:
        """A bucket is one file while it is small; a large one is written by as many tasks as its size asks for."""
        rows = df.select(*self.schema.names).withColumn("bucket", self._bucket())
        rows.hint("rebalance", F.col("bucket")).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{kind}/batch={batch}")

    def start(self, df: DataFrame) -> None:
        """The table before any batch."""
        self._write(df, "base", -1)

    def write(self, df: DataFrame, batch: int) -> None:
        """The changed rows of a batch; writing it again replaces it. Compacts when it is time."""
        self._write(df, "changes", batch)
        bases = self._bases(batch)
        newest = bases[-1] if bases else None
        since = [b for b in logged_batches(self.spark, f"{self.path}/changes") if (newest is None or b > newest) and b <= batch]
        if len(since) >= self.compact_every:
            self._write(self.current(batch + 1), "base", batch)
            for kind in ("base", "changes"):
                # with changes, those that the base before this one holds
                for old in logged_batches(self.spark, f"{self.path}/{kind}"):
                    if newest is not None and (old < newest if kind == "base" else old <= newest):
                        drop_path(self.spark, f"{self.path}/{kind}/batch={old}")

    def _bases(self, before: int) -> list[int]:
        return [b for b in logged_batches(self.spark, f"{self.path}/base") if b < before]

    def read(self, before: int, buckets: list[int] | None = None) -> DataFrame:
        """All versions of the rows of ``buckets``, with their ``batch``, of batches before the given one."""
        shape = T.StructType([*self.schema.fields, T.StructField("bucket", T.IntegerType())])
        bases = self._bases(before)
        newest = bases[-1] if bases else None
        parts = []
        if newest is not None:
            parts.append(self.spark.read.schema(shape).parquet(f"{self.path}/base/batch={newest}").withColumn("batch", F.lit(newest).cast("long")))
        for b in logged_batches(self.spark, f"{self.path}/changes"):
            if b < before and (newest is None or b > newest):
                parts.append(self.spark.read.schema(shape).parquet(f"{self.path}/changes/batch={b}").withColumn("batch", F.lit(b).cast("long")))
        if not parts:
            parts = [self.spark.createDataFrame([], shape).withColumn("batch", F.lit(0).cast("long"))]
        if buckets is not None:
            parts = [p.where(F.col("bucket").isin(buckets)) for p in parts]
        rows = parts[0]
        for p in parts[1:]:
            rows = rows.unionByName(p)
        return rows.drop("bucket")

    def current(self, before: int = 1 << 62) -> DataFrame:
        """The latest state of every key."""
        return latest_per_key(self.read(before), [self.key], [F.desc("batch")]).drop("batch")

    def stored(self, keys: DataFrame, batch: int, small: bool = False) -> DataFrame:
        """The latest state before a batch of its keys, from their buckets alone."""
        buckets = sorted(r[0] for r in keys.select(self._bucket()).distinct().collect())  # at most ``buckets``
        return current_rows(self.read(batch, buckets), self.key, F.broadcast(keys) if small else keys)

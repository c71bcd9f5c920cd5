"""Structured Streaming jobs over landed files.

Every job is a batch function applied to a stream. Sinks are ``foreachBatch``
writes numbered by batch id, so a replayed batch overwrites its own output.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from listflow.operators.lifecycle import expire, latest_per_key
from listflow.operators.matching import MAX_BROADCAST_ROWS, is_small
from listflow.operators.upsert import upsert
from listflow.session import shared_dir
from listflow.sources.feeds import Feed, load_feed
from listflow.sources.tables import MergeLog, current_rows, read_changes, scratch, staged, write_changes


def landed_files(
    spark: SparkSession, path: str, schema: "T.StructType | str", fmt: str = "json",
    files_per_batch: int | None = None, name_filter: str | None = None,
) -> DataFrame:
    """A stream of the files that land in a folder."""
    reader = spark.readStream.schema(schema).format(fmt)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", str(files_per_batch))
    if name_filter:
        reader = reader.option("pathGlobFilter", name_filter)
    return reader.load(path)


def landed_feed(spark: SparkSession, path: str, feed: Feed, as_of, files_per_batch: int | None = None) -> DataFrame:
    """Incremental ingest of one feed: the batch normalizer on a stream of payload lines."""
    lines = landed_files(spark, path, "value string", "text", files_per_batch)
    return load_feed(lines.withColumnRenamed("value", "payload"), feed, "payload", as_of)


def event_time(df: DataFrame, ts: str) -> DataFrame:
    """Watermarks need a timestamp with zone; plain ones are read as UTC."""
    return df.withColumn(ts, F.col(ts).cast("timestamp"))


def distinct_within(df: DataFrame, keys: list[str], ts: str, delay: str) -> DataFrame:
    """Drop repeated keys; the state of a key is kept for the delay only."""
    return event_time(df, ts).withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def seen_times(df: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """First and last sight of each key."""
    return event_time(df, ts).groupBy(*keys).agg(F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen"))


def window_counts(df: DataFrame, ts: str, width: str = "10 minutes", delay: str = "1 day") -> DataFrame:
    """Rows per tumbling window."""
    counts = event_time(df, ts).withWatermark(ts, delay).groupBy(F.window(ts, width)).agg(F.count("*").alias("n"))
    return counts.select(F.col("window.start").alias("window_start"), "n")


def late_rows(df: DataFrame, ts: str, watermark) -> DataFrame:
    """Batch side count of rows older than a watermark."""
    return df.agg(F.count_if(F.col(ts).cast("timestamp") < F.lit(watermark).cast("timestamp")).alias("n_late"))


def run_available(
    stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append",
) -> None:
    """Process everything that has landed, in batches, then stop."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
    query = writer.foreachBatch(handle).trigger(availableNow=True).start()
    query.awaitTermination()


def drain(stream: DataFrame, mode: str = "append", later: Sequence[Callable[[], None]] = ()) -> DataFrame:
    """Run a stream to its end into a change log and return the log.

    Each of ``later`` lands more files; the stream then runs on from where it was.
    """
    spark = stream.sparkSession
    log, checkpoint = shared_dir(spark, "log"), shared_dir(spark, "checkpoint")
    schema = T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])
    for land in (None, *later):
        if land:
            land()
        run_available(stream, lambda df, batch: write_changes(df, log, batch), checkpoint, mode)
    return spark.read.schema(schema).parquet(log)


def drain_latest(stream: DataFrame, keys: list[str], later: Sequence[Callable[[], None]] = ()) -> DataFrame:
    """Run an updating aggregate to its end and return the last state of each key."""
    return latest_per_key(drain(stream, "update", later), keys, [F.desc("batch")]).drop("batch")


def drain_seen(stream: DataFrame, keys: list[str], ts: str, later: Sequence[Callable[[], None]] = ()) -> DataFrame:
    """First and last sight of each key over all micro-batches.

    Each micro-batch adds its own minima and maxima to a log, and the log is
    aggregated; no state is kept for any key between batches.
    """
    spark = stream.sparkSession
    log, checkpoint = shared_dir(spark, "log"), shared_dir(spark, "checkpoint")
    for land in (None, *later):
        if land:
            land()
        run_available(stream, lambda df, batch: write_changes(seen_times(df, keys, ts), log, batch), checkpoint)
    return read_changes(spark, log).groupBy(*keys).agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))


def upsert_handler(
    spark: SparkSession, log: str, as_of, policy: str = "merge", key: str = "dedup_hash", order: str = "seq",
    max_broadcast: int = MAX_BROADCAST_ROWS,
) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` handler that upserts into a change log.

    Batch 0 of the log is the starting table, stream batch ``n`` is log batch
    ``n + 1``. Only earlier batches are read, so a replay gives the same rows.
    A batch costs one scan of the log reduced to the batch's keys.
    """

    def handle(df: DataFrame, batch: int) -> None:
        with scratch(spark):
            # Written once: the batch is read for its size, its keys and its rows.
            df = staged(df, "micro-batch")
            small = is_small(df, max_broadcast)
            keys = df.select(key).distinct()
            log_rows = read_changes(spark, log, before=batch + 1)
            stored = current_rows(log_rows, key, F.broadcast(keys) if small else keys)
            write_changes(upsert(stored, df, as_of, policy, key, order, small_batch=small, only_changes=True), log, batch + 1)

    return handle


def merge_handler(log: MergeLog, as_of, policy: str = "merge", order: str = "seq", max_broadcast: int = MAX_BROADCAST_ROWS) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` handler that upserts into a bucketed merge log.

    A batch reads the buckets of its own keys, and what it staged goes when it is
    written, so a stream of any length costs a batch what its buckets cost.
    """

    def handle(df: DataFrame, batch: int) -> None:
        with scratch(log.spark):
            df = staged(df.where(F.col(log.key).isNotNull()), "micro-batch")
            small = is_small(df, max_broadcast)
            stored = log.stored(df.select(log.key).distinct(), batch, small)
            log.write(upsert(stored, df, as_of, policy, log.key, order, small_batch=small, only_changes=True), batch)

    return handle


def compact(spark: SparkSession, log: str, target: str, key: str = "dedup_hash", as_of=None) -> str:
    """Write the current state as batch 0 of a new log; ``as_of`` also expires old rows."""
    rows = current_rows(read_changes(spark, log), key)
    write_changes(expire(rows, as_of) if as_of is not None else rows, target, 0)
    return target

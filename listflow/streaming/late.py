"""Rows behind the watermark, counted instead of lost.

Spark's own operators drop such rows and tell only how many partial aggregates
they were. Here each batch is split before anything is kept of it: the
watermark of a batch is the latest time of all earlier ones less the delay. What
is behind it goes to a log of its own, the rest is counted.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from listflow.sources.tables import BatchState, read_changes, write_changes
from listflow.streaming.jobs import event_time


def _split(df: DataFrame, ts: str, delay: str, seen) -> DataFrame:
    behind = F.lit(False) if seen is None else F.coalesce(F.col(ts) < F.lit(seen).cast("timestamp") - F.expr(f"INTERVAL {delay}"), F.lit(False))
    return df.withColumn("late", behind)


def _seen(clock: BatchState, batch: int):
    row = clock.before(batch).first()
    return row.at if row else None


def _of_batch(spark: SparkSession, log: str, batch: int) -> DataFrame:
    return read_changes(spark, log).where(F.col("batch") == batch)


def _advance(clock: BatchState, batch: int, times: DataFrame):
    """Write the latest time so far and return it."""
    return clock.write(clock.before(batch).union(times).agg(F.max("at").alias("at")), batch).first().at


def windows_with_late(spark: SparkSession, folder: str, ts: str, width: str = "10 minutes", delay: str = "1 day") -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` handler that counts rows per window, those on time and those behind the watermark.

    Every row that lands is in one of the two counts, so their sum is what has
    landed; rows without a time are late in no window. A batch adds its own counts
    to a log under its number, so a replay doubles nothing, and no state is kept
    but the latest time.
    """
    clock = BatchState(spark, f"{folder}/clock", "at timestamp")

    def handle(df: DataFrame, batch: int) -> None:
        marked = _split(event_time(df, ts), ts, delay, _seen(clock, batch))
        counts = marked.groupBy(F.window(ts, width)).agg(F.count_if(~F.col("late")).alias("n"), F.count_if("late").alias("n_late"), F.max(ts).alias("at"))
        write_changes(counts.select(F.col("window.start").alias("window_start"), "n", "n_late", "at"), f"{folder}/counts", batch)
        _advance(clock, batch, _of_batch(spark, f"{folder}/counts", batch).select("at"))

    return handle


def read_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Counts per window over all batches."""
    return read_changes(spark, f"{folder}/counts").groupBy("window_start").agg(F.sum("n").alias("n"), F.sum("n_late").alias("n_late"))


def distinct_with_late(spark: SparkSession, folder: str, keys: list[str], ts: str, delay: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` handler that keeps the first row of each key on time, and writes late rows to a log.

    Keys seen within the delay are a state that each batch replaces; a key that
    was last seen before the watermark is forgotten, as its rows would be late.
    """
    clock = BatchState(spark, f"{folder}/clock", "at timestamp")
    held: dict[str, BatchState] = {}

    def handle(df: DataFrame, batch: int) -> None:
        fields = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
        state = held.setdefault("seen", BatchState(spark, f"{folder}/seen", f"{fields}, last_at timestamp"))
        write_changes(_split(event_time(df, ts), ts, delay, _seen(clock, batch)), f"{folder}/landed", batch)
        rows = _of_batch(spark, f"{folder}/landed", batch)
        on_time, known = rows.where("not late"), state.before(batch)
        first = on_time.groupBy(*keys).agg(F.min(ts).alias("first_at"), F.max(ts).alias("last_at"))
        fresh = first.join(known, _same(first, known, keys), "left_anti")
        write_changes(fresh.select(*keys, "first_at"), f"{folder}/distinct", batch)
        at = _advance(clock, batch, rows.select(F.col(ts).alias("at")))
        both = known.union(first.select(*keys, "last_at")).groupBy(*keys).agg(F.max("last_at").alias("last_at"))
        keep = both if at is None else both.where(F.col("last_at") >= F.lit(at).cast("timestamp") - F.expr(f"INTERVAL {delay}"))
        state.write(keep, batch)

    return handle


def _same(a: DataFrame, b: DataFrame, keys: list[str]):
    out = F.lit(True)
    for k in keys:
        out = out & a[k].eqNullSafe(b[k])
    return out


def late_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Per batch: rows that landed, rows on time and late rows."""
    return read_changes(spark, f"{folder}/landed").groupBy("batch").agg(F.count("*").alias("n_landed"), F.count_if(~F.col("late")).alias("n_kept"), F.count_if("late").alias("n_late"))

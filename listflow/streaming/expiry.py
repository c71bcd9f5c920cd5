"""Expiry by timers in event time: a key lapses when no row of it came for some days."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from listflow.functions import fixed_values as fv
from listflow.functions.dates import DAY_MICROS
from listflow.streaming.jobs import event_time


#: Groups of keys that hold one state together.
BUCKETS = 4_096


def lapses(df: DataFrame, key: str, ts: str, days: int = fv.EXPIRY_DAYS, delay: str = "1 day", buckets: int = BUCKETS) -> DataFrame:
    """One row ``(key, last_seen, expired_at)`` for each time that ``days`` pass after a key's last row.

    A live key's last time is held, with a timer ``days`` after it. A new row
    renews the timer. When the watermark passes it, the key is reported and
    forgotten, so state is held for the live keys only. Where the next row comes
    later than the timer in the same batch, the lapse between is reported too, so
    the result does not depend on how rows fall into batches. Rows without a key or
    time and rows behind the watermark are left out. Keys of one hash bucket share
    a state and the earliest timer of them, and are worked on together: a batch
    calls Python once for each bucket, not for each key.
    """
    rows = event_time(df, ts).where(F.col(key).isNotNull() & F.col(ts).isNotNull()).select(key, F.col(ts).alias("at")).withWatermark("at", delay)
    rows = rows.withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(buckets)))
    out = T.StructType([df.schema[key], T.StructField("last_seen", T.TimestampType()), T.StructField("expired_at", T.TimestampType())])
    held = T.StructType([T.StructField("keys", T.ArrayType(df.schema[key].dataType)), T.StructField("last", T.ArrayType(T.LongType()))])
    span = days * DAY_MICROS

    def told(keys: np.ndarray, times: np.ndarray) -> pd.DataFrame:
        last, due = (t.astype("datetime64[us]").astype("datetime64[ns]") for t in (times, times + span))
        return pd.DataFrame({key: keys, "last_seen": last, "expired_at": due})

    def run(_, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        parts = [pd.DataFrame({"key": list(state.get[0]), "at": np.array(state.get[1], np.int64)})] if state.exists else []
        if not state.hasTimedOut:
            parts += [pd.DataFrame({"key": b[key], "at": b["at"].to_numpy().astype("datetime64[us]").astype(np.int64)}) for b in batches]
        seen = pd.concat(parts, ignore_index=True)
        number, names = pd.factorize(seen["key"])
        order = np.lexsort((seen["at"].to_numpy(), number))
        number, at = number[order], seen["at"].to_numpy()[order]
        final = np.append(number[1:] != number[:-1], True)
        gap = np.append(np.diff(at) > span, False) & ~final
        watermark = state.getCurrentWatermarkMs()
        due = (at + span) // 1000
        lapsed = final & (due < watermark) if watermark > 0 else np.zeros(len(at), bool)
        alive = final & ~lapsed
        if alive.any():
            state.update((np.asarray(names)[number[alive]].tolist(), at[alive].tolist()))
            state.setTimeoutTimestamp(max(int(due[alive].min()), watermark + 1))
        elif state.exists:
            state.remove()
        if (gap | lapsed).any():
            yield told(np.asarray(names)[number[gap | lapsed]], at[gap | lapsed])

    return rows.groupBy("_bucket").applyInPandasWithState(run, out, held, "append", GroupStateTimeout.EventTimeTimeout)

"""Streaming jobs over the event and order files, run to their end."""

from __future__ import annotations

from pyspark.sql import functions as F


from listflow.session import shared_dir
from listflow.sources import feeds as S
from listflow.sources.tables import MergeLog, append_rows, current_rows, read_changes, write_changes
from listflow.streaming import digests as D, expiry as X, jobs as J, late as L
from listflow.suite.keys import MERGE_SIDES, _EXPIRE, _sides
from listflow.suite.people import _ALERT_ON, _ALERTS_SQL, _alerts as stored_alerts
from listflow.suite.registry import query, ts_col, ts_text
from listflow.suite.views import LISTINGS_AS_OF, listings, table


def _event_stream(spark, sf):
    """The events land in time order, week by week: the first is there, the others come later."""
    events, landing = table(spark, sf, "events"), shared_dir(spark, "landing")
    week = F.floor(F.date_format("ts", "D").cast("int") / 7)
    weeks = [r.w for r in events.select(week.alias("w")).distinct().orderBy("w").collect()]  # at most 53

    def landed(w):
        return lambda: events.where(week == w).write.mode("append").parquet(landing)

    first, *later = [landed(w) for w in weeks]
    first()
    return J.landed_files(spark, landing, events.schema, "parquet"), later


@query(
    "stream_distinct_keys", "T-2 T-6",
    "SELECT user_id, event_type, count(*) AS n FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY 1, 2",
)
def stream_distinct_keys(spark, sf):
    """Each user and event type once: the delay is longer than the data's span."""
    events, later = _event_stream(spark, sf)
    rows = J.distinct_within(events, ["user_id", "event_type"], "ts", "60 days")
    return J.drain(rows.select("user_id", "event_type"), later=later).groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


@query(
    "stream_seen_times", "T-4",
    f"SELECT user_id, {ts_text('min(ts)')} AS first_seen, {ts_text('max(ts)')} AS last_seen FROM events GROUP BY 1",
)
def stream_seen_times(spark, sf):
    events, later = _event_stream(spark, sf)
    out = J.drain_seen(events, ["user_id"], "ts", later)
    return out.select("user_id", ts_col("first_seen"), ts_col("last_seen"))


@query(
    "stream_window_counts", "T-7",
    f"SELECT {ts_text('time_bucket(INTERVAL 10 MINUTE, ts)')} AS window_start, count(*) AS n FROM events GROUP BY 1",
)
def stream_window_counts(spark, sf):
    events, later = _event_stream(spark, sf)
    out = J.drain_latest(J.window_counts(events, "ts"), ["window_start"], later)
    return out.select(ts_col("window_start"), "n")


@query("late_event_count", "T-6", "SELECT count(*) AS n_late FROM events WHERE ts < TIMESTAMP '2024-01-10'")
def late_event_count(spark, sf):
    return J.late_rows(table(spark, sf, "events"), "ts", "2024-01-10 00:00:00")


@query(
    "stream_feed_ingest", "T-1 S-7 P-7",
    f"SELECT event_type AS title, user_id AS company_name, {ts_text('ts')} AS posted_date FROM events",
)
def stream_feed_ingest(spark, sf):
    """The events land as payload files of a feed and go through its normalizer as a stream."""
    landing = shared_dir(spark, "landing")
    record = F.struct(
        F.col("event_type").alias("role"), F.col("user_id").cast("string").alias("company_name"),
        F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("date_posted"),
    )
    events = table(spark, sf, "events").select(F.to_json(F.struct(F.array(record).alias("results"))).alias("value"))
    events.write.text(landing)
    rows = J.landed_feed(spark, landing, S.FEEDS["Findwork"], LISTINGS_AS_OF)
    out = J.drain(rows.select("title", "company_name", "posted_date"))
    return out.select("title", F.col("company_name").cast("bigint").alias("company_name"), ts_col("posted_date"))


@query(
    "stream_upsert_merge", "T-3 U-1 U-4 S-23",
    MERGE_SIDES
    + """SELECT coalesce(s.dedup_hash, n.dedup_hash) AS dedup_hash, coalesce(s.salary_min, n.salary_min) AS salary_min,
    coalesce(s.is_active, n.is_active) AS is_active FROM s FULL JOIN n ON s.dedup_hash = n.dedup_hash""",
)
def stream_upsert_merge(spark, sf):
    """Incoming rows land in files and are merged into a change log, batch by batch."""
    stored, incoming = _sides(spark, sf)
    log, landing, checkpoint = (shared_dir(spark, p) for p in ("log", "landing", "checkpoint"))
    write_changes(stored, log, 0)
    handler = J.upsert_handler(spark, log, LISTINGS_AS_OF)
    middle = (incoming.agg(F.max("seq").alias("m")).first().m or 0) // 2
    # The earlier half lands and is processed, then the later half.
    for half in (incoming.where(F.col("seq") <= middle), incoming.where(F.col("seq") > middle)):
        half.write.mode("append").parquet(landing)
        J.run_available(J.landed_files(spark, landing, incoming.schema, "parquet"), handler, checkpoint)
    return current_rows(read_changes(spark, log), "dedup_hash").select("dedup_hash", "salary_min", "is_active")


@query(
    "stream_merge_buckets", "T-3 U-1 U-4 S-23",
    MERGE_SIDES
    + """SELECT coalesce(s.dedup_hash, n.dedup_hash) AS dedup_hash, coalesce(s.salary_min, n.salary_min) AS salary_min,
    coalesce(s.is_active, n.is_active) AS is_active FROM s FULL JOIN n ON s.dedup_hash = n.dedup_hash""",
)
def stream_merge_buckets(spark, sf):
    """The same merge into a log cut by key buckets, over five landings with a compaction in between."""
    stored, incoming = _sides(spark, sf)
    path, landing, checkpoint = (shared_dir(spark, p) for p in ("merge", "landing", "checkpoint"))
    log = MergeLog(spark, path, stored.schema, buckets=8, compact_every=3)
    log.start(stored)
    step = (incoming.agg(F.max("seq").alias("m")).first().m or 0) // 5 + 1
    for n in range(5):
        incoming.where(F.expr(f"seq div {step} = {n}")).write.mode("append").parquet(landing)
        J.run_available(J.landed_files(spark, landing, incoming.schema, "parquet"), J.merge_handler(log, LISTINGS_AS_OF), checkpoint)
    return log.current().select("dedup_hash", "salary_min", "is_active")


@query("append_batches", "S-20", "SELECT event_id % 3 AS batch, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def append_batches(spark, sf):
    """Batches of rows are added to a table; one is written twice, as after a retry."""
    events, path = table(spark, sf, "events"), shared_dir(spark, "appended")
    for batch in (0, 1, 1, 2):
        append_rows(events.where(F.col("event_id") % 3 == batch), path, batch)
    return read_changes(spark, path).groupBy("batch", "event_type").agg(F.count("*").alias("n"))


@query(
    "stream_expiry", "T-5 L-1",
    f"""SELECT CAST(id AS VARCHAR) AS dedup_hash, CASE WHEN coalesce({_EXPIRE}, false) THEN false ELSE is_active END AS is_active,
        CASE WHEN coalesce({_EXPIRE}, false) THEN {ts_text(f"TIMESTAMP '{LISTINGS_AS_OF}'")} ELSE {ts_text('posted_date')} END AS changed FROM listings""",
)
def stream_expiry(spark, sf):
    """Listings land in files, two to a micro-batch; compaction of their log expires the old ones."""
    rows = listings(spark, sf).select(F.col("id").cast("string").alias("dedup_hash"), F.col("id").alias("seq"), "is_active", "posted_date", F.col("posted_date").alias("updated_at"))
    log, landing, checkpoint, compacted = (shared_dir(spark, p) for p in ("log", "landing", "checkpoint", "compacted"))
    rows.repartition(6, "dedup_hash").write.parquet(landing)
    stream = J.landed_files(spark, landing, rows.schema, "parquet", files_per_batch=2)
    J.run_available(stream, lambda df, batch: write_changes(df.drop("seq"), log, batch), checkpoint)
    J.compact(spark, log, compacted, as_of=LISTINGS_AS_OF)
    return read_changes(spark, compacted).select("dedup_hash", "is_active", ts_col("updated_at", "changed"))


# ------------------------------------------------------------------ late rows
# Every eleventh event lands with the week three weeks later, every fifth of the rest with the next one.
_LATE_BY = "CASE WHEN event_id % 11 = 0 THEN 3 WHEN event_id % 5 = 0 THEN 1 ELSE 0 END"


def _late_stream(spark, sf):
    """The events, week by week, some of them in a later week's landing."""
    events, landing = table(spark, sf, "events"), shared_dir(spark, "landing")
    part = F.floor(F.date_format("ts", "D").cast("int") / 7) + F.expr(_LATE_BY)
    parts = [r.w for r in events.select(part.alias("w")).distinct().orderBy("w").collect()]  # at most 56
    return events, landing, [(events.where(part == w)) for w in parts]


_LANDED = f"""e AS (SELECT *, dayofyear(ts) // 7 + {_LATE_BY} AS landing FROM events),
  w AS (SELECT landing, max(max(ts)) OVER (ORDER BY landing ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 10 DAY AS mark FROM e GROUP BY landing),
  m AS (SELECT e.*, coalesce(ts < mark, false) AS late FROM e JOIN w USING (landing))"""


@query(
    "stream_late_windows", "T-7 T-6",
    f"""WITH {_LANDED} SELECT {ts_text('time_bucket(INTERVAL 1 HOUR, ts)')} AS window_start, count(*) FILTER (WHERE NOT late) AS n, count(*) FILTER (WHERE late) AS n_late
        FROM m GROUP BY 1""",
)
def stream_late_windows(spark, sf):
    """Hourly counts of events on time and of those behind a watermark of ten days."""
    events, landing, parts = _late_stream(spark, sf)
    folder, checkpoint = shared_dir(spark, "late"), shared_dir(spark, "checkpoint")
    handle = L.windows_with_late(spark, folder, "ts", "1 hour", "10 days")
    for part in parts:
        part.write.mode("append").parquet(landing)
        J.run_available(J.landed_files(spark, landing, events.schema, "parquet"), handle, checkpoint)
    return L.read_windows(spark, folder).select(ts_col("window_start"), "n", "n_late")


@query(
    "stream_late_counts", "T-6 T-2",
    f"""WITH {_LANDED} SELECT dense_rank() OVER (ORDER BY landing) - 1 AS batch, count(*) AS n_landed, count(*) FILTER (WHERE NOT late) AS n_kept, count(*) FILTER (WHERE late) AS n_late
        FROM m GROUP BY landing""",
)
def stream_late_counts(spark, sf):
    """What became of the rows of each landing, where keys are kept once within ten days."""
    events, landing, parts = _late_stream(spark, sf)
    folder, checkpoint = shared_dir(spark, "late"), shared_dir(spark, "checkpoint")
    handle = L.distinct_with_late(spark, folder, ["user_id", "event_type"], "ts", "10 days")
    for part in parts:
        part.write.mode("append").parquet(landing)
        J.run_available(J.landed_files(spark, landing, events.schema, "parquet"), handle, checkpoint)
    return L.late_counts(spark, folder)


# ------------------------------------------------------------------ timers
@query(
    "stream_lapses", "T-5 T-4",
    f"""WITH o AS (SELECT o_custkey, o_orderdate::TIMESTAMP AS seen, lead(o_orderdate::TIMESTAMP) OVER (PARTITION BY o_custkey ORDER BY o_orderdate) AS next_at,
          max(o_orderdate::TIMESTAMP) OVER () AS latest FROM orders)
        SELECT o_custkey, {ts_text('seen')} AS last_seen, {ts_text('seen + INTERVAL 45 DAY')} AS expired_at FROM o
        WHERE CASE WHEN next_at IS NULL THEN seen + INTERVAL 45 DAY < latest - INTERVAL 1 DAY ELSE next_at > seen + INTERVAL 45 DAY END""",
)
def stream_lapses(spark, sf):
    """Customers whose last order is 45 days past, by timers, over three landings in time order."""
    orders, landing = table(spark, sf, "orders").select("o_custkey", "o_orderdate"), shared_dir(spark, "landing")
    third = F.when(F.col("o_orderdate") < F.lit("1997-03-10").cast("timestamp"), 0).when(F.col("o_orderdate") < F.lit("1999-05-20").cast("timestamp"), 1).otherwise(2)
    landed = lambda n: lambda: orders.where(third == n).write.mode("append").parquet(landing)
    landed(0)()
    stream = X.lapses(J.landed_files(spark, landing, orders.schema, "parquet"), "o_custkey", "o_orderdate")
    out = J.drain(stream, later=[landed(1), landed(2)])
    return out.select("o_custkey", ts_col("last_seen"), ts_col("expired_at"))


# ------------------------------------------------------------------ alert digests
_DIGEST_PARTS = [f"{LISTINGS_AS_OF}'::TIMESTAMP - INTERVAL '{d} DAY" for d in (9, 8, 6, 4, 2, 1)]
_FREQUENCY = ["realtime", "daily", "weekly", None]
_DIGEST_SQL = f"""WITH RECURSIVE {_ALERTS_SQL}, c AS (SELECT l.*, coalesce((created_at >= '{_DIGEST_PARTS[0]}')::INT + {' + '.join(f"(created_at >= '{p}')::INT" for p in _DIGEST_PARTS[1:])}, 0) AS landing FROM listings l),
  t AS (SELECT landing, row_number() OVER (ORDER BY landing) AS step, max(max(created_at)) OVER (ORDER BY landing) AS clock FROM c GROUP BY landing),
  l AS (SELECT c.*, step, clock FROM c JOIN t USING (landing)),
  m AS MATERIALIZED (SELECT alert_id, a.user_id, a.frequency, l.id, step FROM a JOIN l ON {_ALERT_ON.format(as_of='l.clock')}),
  n AS MATERIALIZED (SELECT alert_id, frequency, step, count(*) AS n FROM m GROUP BY ALL),
  k AS MATERIALIZED (SELECT a.alert_id, a.frequency, t.step, t.clock, coalesce(n.n, 0) AS n FROM (SELECT DISTINCT alert_id, frequency FROM n) a CROSS JOIN t LEFT JOIN n ON n.alert_id = a.alert_id AND n.step = t.step),
  s AS (SELECT alert_id, 0::BIGINT AS step, NULL::TIMESTAMP AS last, 0::HUGEINT AS held, NULL::TIMESTAMP AS fired_at, 0::HUGEINT AS sent FROM (SELECT DISTINCT alert_id FROM k)
    UNION ALL SELECT alert_id, step, CASE WHEN fires THEN clock ELSE last END, CASE WHEN fires THEN 0 ELSE held END, CASE WHEN fires THEN clock END, CASE WHEN fires THEN held ELSE 0 END FROM (
      SELECT k.alert_id, k.step, s.last, s.held + k.n AS held, k.clock, s.held + k.n > 0 AND (s.last IS NULL OR k.clock >= s.last + to_days(CASE k.frequency WHEN 'realtime' THEN 0 WHEN 'weekly' THEN 7 ELSE 1 END)) AS fires
      FROM s JOIN k ON k.alert_id = s.alert_id AND k.step = s.step + 1))
  SELECT alert_id::VARCHAR AS alert_id, {ts_text('fired_at')} AS fired_at, sent::BIGINT AS n FROM s WHERE fired_at IS NOT NULL"""


@query("stream_alert_digests", "T-8", _DIGEST_SQL)
def stream_alert_digests(spark, sf):
    """Listings land in seven parts, undated ones in the first; alerts of every frequency send what has waited for them."""
    landing, folder, checkpoint = (shared_dir(spark, p) for p in ("landing", "digests", "checkpoint"))
    words = ", ".join("null" if f is None else f"'{f}'" for f in _FREQUENCY)
    stored = stored_alerts(spark, sf).withColumn("frequency", F.expr(f"element_at(array({words}), cast(id % 4 as int) + 1)")).withColumn("last_triggered_at", F.lit(None).cast("timestamp"))
    rows = listings(spark, sf)
    part = sum(((F.col("created_at") >= F.expr(f"TIMESTAMP '{LISTINGS_AS_OF}' - INTERVAL {d} DAY")).cast("int") for d in (9, 8, 6, 4, 2, 1)), F.lit(0))
    handle = D.digest_handler(spark, folder, lambda: stored)
    for n in range(7):
        rows.where(F.coalesce(part, F.lit(0)) == n).write.mode("append").parquet(landing)
        J.run_available(J.landed_files(spark, landing, rows.schema, "parquet"), handle, checkpoint)
    return D.read_digests(spark, folder, counted=True).groupBy("alert_id", ts_col("fired_at")).agg(F.sum("n").alias("n"))

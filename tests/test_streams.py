"""Streams by hand: replayed batches, late rows, timers and alert clocks."""

from __future__ import annotations

from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from listflow.schemas import ALERTS, LISTINGS
from listflow.session import shared_dir
from listflow.sources.tables import BatchState, logged_batches, read_changes
from listflow.streaming import digests as D, expiry as X, jobs as J, late as L

DAY = timedelta(days=1)
START = datetime(2024, 1, 1)


def test_batch_state_is_replaced_and_replayed(spark):
    state = BatchState(spark, shared_dir(spark, "state"), "n long")
    assert state.before(0).count() == 0
    for batch in range(6):
        before = [r.n for r in state.before(batch).collect()]
        assert before == ([batch - 1] if batch else [])
        for _ in range(2):  # a replay finds the same state and leaves the same
            assert [r.n for r in state.before(batch).collect()] == before
            state.write(spark.createDataFrame([(batch,)], "n long"), batch)
    assert logged_batches(spark, state.path) == [4, 5]


def landings():
    """Per landing, (key, day): the third and fifth hold rows behind a watermark of three days."""
    return [[("a", 0), ("a", 1), ("b", 2)], [("a", 5), ("c", 3)], [("a", 1), ("b", 9), ("d", 4)], [("b", 10), (None, None)], [("a", 2), ("e", 6.9), ("e", 7), ("c", 8)]]


def frame(spark, rows):
    return spark.createDataFrame([(k, START + d * DAY if d is not None else None) for k, d in rows], "k string, ts timestamp")


def test_late_rows_are_counted_and_the_rest_kept(spark):
    folder = shared_dir(spark, "late")
    windows, distinct = L.windows_with_late(spark, f"{folder}/w", "ts", "1 day", "3 days"), L.distinct_with_late(spark, f"{folder}/d", ["k"], "ts", "3 days")
    latest, late, on_time, seen, fresh = None, [], [], {}, []
    for batch, rows in enumerate(landings()):
        for _ in range(2):  # replayed
            windows(frame(spark, rows), batch)
            distinct(frame(spark, rows), batch)
        behind = [r for r in rows if latest is not None and r[1] is not None and r[1] < latest - 3]
        late += behind
        kept = [r for r in rows if r not in behind]
        on_time += kept
        for k in {k for k, _ in kept}:
            if k not in seen:
                fresh.append((batch, k))
            days = [d for x, d in kept if x == k and d is not None]
            seen[k] = max([*days, *([seen[k]] if seen.get(k) is not None else [])], default=None)
        latest = max([d for _, d in rows if d is not None] + ([latest] if latest is not None else []), default=None)
        seen = {k: d for k, d in seen.items() if d is not None and d >= latest - 3}
    got = L.read_windows(spark, f"{folder}/w").collect()
    assert sum(r.n + r.n_late for r in got) == sum(d is not None for rows in landings() for _, d in rows)
    assert {((r.window_start - START) // DAY, r.n, r.n_late) for r in got} == {(day, sum(int(d) == day for _, d in on_time if d is not None), sum(int(d) == day for _, d in late)) for day in {int(d) for rows in landings() for _, d in rows if d is not None}}
    counts = {r.batch: (r.n_landed, r.n_kept, r.n_late) for r in L.late_counts(spark, f"{folder}/d").collect()}
    assert {b: c[0] for b, c in counts.items()} == {b: len(rows) for b, rows in enumerate(landings())}
    assert all(a == b + c for a, b, c in counts.values()) and sum(c[2] for c in counts.values()) == len(late) == 3
    rows = read_changes(spark, f"{folder}/d/distinct").select("batch", "k").collect()
    assert sorted(((r.batch, r.k) for r in rows), key=str) == sorted(fresh, key=str)


def run_lapses(spark, parts, days=10):
    """The stream over parts, and the rows of state after each."""
    landing, log, checkpoint = (shared_dir(spark, p) for p in ("landing", "log", "checkpoint"))
    held = []
    for part in parts:
        frame(spark, part).coalesce(1).write.mode("append").parquet(landing)
        stream = X.lapses(J.landed_files(spark, landing, "k string, ts timestamp", "parquet"), "k", "ts", days, "0 seconds")
        query = stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(lambda df, b: J.write_changes(df, log, b)).trigger(availableNow=True).start()
        query.awaitTermination()
        held.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
    return {(r.k, (r.last_seen - START) / DAY, (r.expired_at - START) / DAY) for r in read_changes(spark, log).collect()}, held


def test_keys_lapse_by_timer_and_leave_the_state(spark):
    rows = [("a", 0), ("b", 1), ("c", 2), ("a", 5), ("b", 6), ("d", 14), ("c", 20), ("d", 21), ("a", 40), ("x", 41), ("x", 60)]
    want = {("a", 5.0, 15.0), ("b", 6.0, 16.0), ("c", 2.0, 12.0), ("c", 20.0, 30.0), ("d", 21.0, 31.0), ("a", 40.0, 50.0), ("x", 41.0, 51.0)}
    one, _ = run_lapses(spark, [rows])
    several, held = run_lapses(spark, [rows[:3], rows[3:6], rows[6:8], rows[8:10], rows[10:], [(None, 61), ("y", None)]])
    assert several == want == one
    assert max(held) >= 3 and held[-1] == 1  # only x is alive


def test_keys_of_a_bucket_lapse_each_by_its_own_time(spark, monkeypatch):
    rows = [("a", 0), ("b", 1), ("c", 2), ("a", 5), ("b", 6), ("d", 14), ("c", 20), ("d", 21), ("a", 40), ("x", 41), ("x", 60)]
    want, _ = run_lapses(spark, [rows])
    whole = X.lapses
    monkeypatch.setattr(X, "lapses", lambda *a: whole(*a, buckets=1))
    got, held = run_lapses(spark, [rows[:3], rows[3:6], rows[6:8], rows[8:10], rows[10:]])
    assert got == want and max(held) == 1


def listing(i, day, **more):
    values = {"id": str(i), "title": f"Data Engineer {i}", "company_name": "Acme", "created_at": START + day * DAY, "posted_date": START + day * DAY, **more}
    return tuple(values.get(f.name) for f in LISTINGS)


def alert(i, frequency, active=True, last=None, **filters):
    from listflow.schemas import ALERT_FILTERS

    f = tuple(filters.get(x.name) for x in ALERT_FILTERS)
    values = {"id": str(i), "user_id": f"u{i}", "frequency": frequency, "is_active": active, "filters": f, "last_triggered_at": last}
    return tuple(values.get(x.name) for x in ALERTS)


def test_alerts_fire_by_their_clocks(spark):
    stored = [alert("now", "realtime"), alert("day", "daily"), alert("week", "weekly", last=START - 6 * DAY), alert("odd", None), alert("off", "realtime", active=False), alert("none", "realtime", q="zebra"), alert("acme", "daily", q="acme")]
    later = [*stored[1:], alert("new", "daily")]
    folder = shared_dir(spark, "digests")
    current = {"rows": stored}
    handle = D.digest_handler(spark, folder, lambda: spark.createDataFrame(current["rows"], ALERTS))
    batches = [[listing(1, 0)], [listing(2, 0.5), listing(3, 0.6)], [listing(4, 1.0)], [], [listing(5, 1.2)], [listing(6, 1.7)]]
    for batch, rows in enumerate(batches):
        if batch == 4:
            current["rows"] = later
        for _ in range(2):  # a replay gives the same digests
            handle(spark.createDataFrame(rows, LISTINGS), batch)
    got = {}
    for r in D.read_digests(spark, folder).collect():
        got.setdefault((r.alert_id, round((r.fired_at - START) / DAY, 1)), set()).add(r.listing)
    assert got == {
        ("now", 0.0): {"1"}, ("now", 0.6): {"2", "3"}, ("now", 1.0): {"4"},
        ("day", 0.0): {"1"}, ("day", 1.0): {"2", "3", "4"}, ("odd", 0.0): {"1"}, ("odd", 1.0): {"2", "3", "4"},
        ("acme", 0.0): {"1"}, ("acme", 1.0): {"2", "3", "4"}, ("week", 1.0): {"1", "2", "3", "4"}, ("new", 1.2): {"5"},
    }
    clocks = {r.alert_id: r.last_triggered_at for r in D.triggered(spark, folder).collect()}
    assert clocks["week"] == START + DAY and clocks["none"] is None and "now" not in clocks and "off" not in clocks
    # the folder holds two states and no landed copies, however many batches have run
    assert all(len(logged_batches(spark, f"{folder}/{name}")) == 2 for name in ("clock", "fired", "waiting"))
    assert not list(Path(folder.removeprefix("file:")).parent.glob("alert-batch-*"))


def test_a_batch_is_matched_once(spark, monkeypatch):
    """Digests and waiting rows read the written matches; only their writing evaluates the match."""
    from listflow.streaming import digests

    seen, whole = spark.sparkContext.accumulator(0), digests.match_alerts
    count = F.udf(lambda i: seen.add(1) or i, "string").asNondeterministic()
    monkeypatch.setattr(digests, "match_alerts", lambda *a: whole(*a).withColumn("id", count("id")))
    folder = shared_dir(spark, "digests")
    handle = D.digest_handler(spark, folder, lambda: spark.createDataFrame([alert("day", "daily"), alert("now", "realtime")], ALERTS))
    handle(spark.createDataFrame([listing(i, 0) for i in range(5)], LISTINGS), 0)
    assert D.read_digests(spark, folder).count() == 10 and seen.value == 10
    assert not list(Path(folder.removeprefix("file:")).parent.glob("alert-batch-*"))


def test_digests_are_kept_by_what_alerts_share(spark):
    """Matches of alerts alike are written once; a digest keeps what its alert asked for when the listings came."""
    folder = shared_dir(spark, "digests")
    weekly = [alert(f"w{i}", "weekly", last=START - 6 * DAY, q="engineer") for i in range(60)]
    moved = [alert(f"w{i}", "weekly", last=START - 6 * DAY, q="7") for i in range(60)]
    now = [alert(f"n{i}", "realtime", q=("engineer", "zebra")[i % 2]) for i in range(40)]
    current = {"rows": [*weekly, weekly[0], *now]}
    handle = D.digest_handler(spark, folder, lambda: spark.createDataFrame(current["rows"], ALERTS))
    for batch, rows in enumerate([[*(listing(i, 0) for i in range(20)), listing(3, 0)], [listing(i, 1) for i in range(27, 30)]]):
        if batch:
            current["rows"] = [*moved, moved[0], *now]
        for _ in range(2):  # replayed
            handle(spark.createDataFrame(rows, LISTINGS), batch)
    got = D.read_digests(spark, folder).groupBy("alert_id", "batch").agg(F.sort_array(F.collect_list(F.col("listing").cast("int"))).alias("l")).collect()
    first, last = sorted([*range(20), 3]), [27, 28, 29]
    want = {(f"n{i}", b): l for i in range(0, 40, 2) for b, l in enumerate((first, last))} | {(f"w{i}", 1): [*first, 27] for i in range(1, 60)} | {("w0", 1): sorted([*first, 27] * 2)}
    assert {(r.alert_id, r.batch): r.l for r in got} == want
    sums = D.read_digests(spark, folder, counted=True).groupBy("alert_id", "batch").agg(F.sum("n").alias("n")).collect()
    assert {(r.alert_id, r.batch): r.n for r in sums} == {k: len(v) for k, v in want.items()}
    # two sorts of alerts, then two: rows of listings and of alerts, not of their pairs
    assert read_changes(spark, f"{folder}/matches").count() == 2 * 21 + 3 + 1
    assert read_changes(spark, f"{folder}/digests").count() == 20 + 20 + 2 * 61 and read_changes(spark, f"{folder}/fired").where("batch = 1").count() == 100


def test_the_stream_digests_as_its_handler_does(spark):
    landing, folder, checkpoint = (shared_dir(spark, p) for p in ("landing", "digests", "checkpoint"))
    handle = D.digest_handler(spark, folder, lambda: spark.createDataFrame([alert("day", "daily")], ALERTS))
    for n, day in enumerate((0, 0.5, 1.5)):
        spark.createDataFrame([listing(n, day)], LISTINGS).write.mode("append").parquet(landing)
        J.run_available(J.landed_files(spark, landing, LISTINGS, "parquet"), handle, checkpoint)
    got = D.read_digests(spark, folder).groupBy("fired_at").agg(F.sort_array(F.collect_list("listing")).alias("l")).collect()
    assert sorted(((r.fired_at - START) / DAY, r.l) for r in got) == [(0.0, ["0"]), (1.5, ["1", "2"])]


def test_the_digest_query_reads_all_alerts_and_listings(spark, tmp_path):
    """Alerts of any balance below the bound are in use, and listings without a date land too."""
    import duckdb

    from listflow.suite import ORACLES, QUERIES

    customers = [(1, 1, -600.0), (21, 1, 0.0), (41, 1, 1400.0), (61, 1, 1600.0), (2, 1, None), (40, 1, 700.0)]
    spark.createDataFrame([(k, n, "HOUSEHOLD", b) for k, n, b in customers], "c_custkey long, c_nationkey long, c_mktsegment string, c_acctbal double").coalesce(1).write.parquet(f"{tmp_path}/sf/customer.parquet")
    dates = [datetime(2001, 7, 1), datetime(2001, 7, 25), datetime(2001, 7, 30), datetime(2001, 8, 1, 12), None, None]
    spark.createDataFrame([(i + 1, 5, "O", 100.0, d, "1-URGENT") for i, d in enumerate(dates)], "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string").coalesce(1).write.parquet(f"{tmp_path}/sf/orders.parquet")
    got = {(r.alert_id, r.fired_at): r.n for r in QUERIES["stream_alert_digests"](spark, f"{tmp_path}/sf").collect()}
    con = duckdb.connect()
    for t in ("customer", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/sf/{t}.parquet/*.parquet')")
    rel = con.sql(ORACLES["stream_alert_digests"])
    place = [rel.columns.index(c) for c in ("alert_id", "fired_at", "n")]
    assert got == {(a, f): n for a, f, n in ([r[i] for i in place] for r in rel.fetchall())}
    sent = {a: sum(n for (x, _), n in got.items() if x == a) for a, _ in got}
    # a balance below 0 asks for listings of the last month, which undated ones are not
    assert (sent["21"], sent["41"], sent["1"]) == (6, 6, 4) and "61" not in sent and "2" not in sent


@pytest.mark.parametrize("rows", [[], [("a", 0)]])
def test_empty_and_single_landings(spark, rows):
    folder = shared_dir(spark, "late")
    L.windows_with_late(spark, folder, "ts", "1 day", "3 days")(frame(spark, rows), 0)
    assert [(r.n, r.n_late) for r in L.read_windows(spark, folder).collect()] == [(1, 0)] * len(rows)

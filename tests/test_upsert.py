from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from listflow.operators import upsert as U

NOW = "2024-01-02 00:00:00"
FIELDS = "dedup_hash string, id string, city string, pay double, flag boolean, tags array<string>, source_platforms array<string>, is_active boolean, created_at timestamp, updated_at timestamp"
NEW = "dedup_hash string, seq long, city string, pay double, flag boolean, tags array<string>, source_platforms array<string>, is_active boolean"


def test_vectors_are_one_value(spark):
    old = spark.createDataFrame([("a", [0.9, 0.1, 0.5], ["x"]), ("b", None, None), ("c", [], ["x"])], "dedup_hash string, v array<float>, tags array<string>")
    new = spark.createDataFrame([("a", 1, [0.2, 0.1, 0.7], ["w"]), ("b", 1, [0.3, 0.1], ["w"]), ("b", 2, [0.1, 0.3], ["v"]), ("c", 1, [0.5, 0.25], None)], "dedup_hash string, seq long, v array<float>, tags array<string>")
    for small in (False, True):
        got = {r.dedup_hash: ([round(x, 3) for x in r.v], r.tags) for r in U.upsert(old, new, NOW, small_batch=small).collect()}
        assert got == {"a": ([0.9, 0.1, 0.5], ["w", "x"]), "b": ([0.3, 0.1], ["v", "w"]), "c": ([0.5, 0.25], ["x"])}


def blank(v) -> bool:
    return v is None or (isinstance(v, str) and not v.strip()) or (isinstance(v, list) and not v)


def merge_model(stored: dict, rows: list[dict]) -> dict:
    """One row after another, as plain Python."""
    state = dict(stored)
    for new in rows:
        key = new["dedup_hash"]
        values = {k: v for k, v in new.items() if k not in ("dedup_hash", "seq")}
        if key not in state:
            state[key] = {"id": None, **values, "created": NOW, "updated": NOW}
            continue
        old = state[key]
        for k, v in values.items():
            if k == "source_platforms":
                old[k] = sorted(set(old[k] or []) | set(v or []))
            elif v is None:
                continue
            elif blank(old[k]) and not blank(v):
                old[k] = v
            elif isinstance(old[k], list) and isinstance(v, list):
                old[k] = sorted(set(old[k] + v))
        old["updated"] = NOW
    return state


def random_rows(rng: random.Random, n: int, keys: int) -> list[tuple]:
    def pick(*xs):
        return rng.choice(xs)

    return [
        (
            f"k{0 if rng.random() < 0.35 else rng.randrange(keys)}", i, pick(None, "", "  ", "Pune", "Delhi"), pick(None, 0.0, 5.0), pick(None, True, False),
            pick(None, [], ["a"], ["b", "a"], ["c"]), pick([], ["S1"], ["S2", "S1"]), pick(True, False),
        )
        for i in range(n)
    ]


def stored_rows(rng: random.Random, keys: int) -> list[tuple]:
    out = []
    for i in range(0, keys, 2):
        r = random_rows(rng, 1, 1)[0]
        out.append((f"k{i}", f"id{i}", r[2], r[3], r[4], r[5], sorted(set(r[6])), r[7], None, None))
    return out


@pytest.mark.parametrize("small", [False, True])
@pytest.mark.parametrize("seed", [1, 2])
def test_merge_equals_row_by_row(spark, small, seed):
    rng = random.Random(seed)
    old, new = stored_rows(rng, 12), random_rows(rng, 80, 16)
    result = U.upsert(spark.createDataFrame(old, FIELDS), spark.createDataFrame(new, NEW), NOW, small_batch=small)
    cols = ["id", "city", "pay", "flag", "tags", "source_platforms", "is_active"]
    got = {r.dedup_hash: {c: r[c] for c in cols} for r in result.collect()}
    model = {r[0]: dict(zip([*cols, "updated"], [*r[1:8], None])) for r in old}
    names = ["dedup_hash", "seq", "city", "pay", "flag", "tags", "source_platforms", "is_active"]
    want = merge_model(model, [dict(zip(names, r)) for r in new])
    assert set(got) == set(want)
    for key, row in want.items():
        for col in cols:
            a, b = got[key][col], row[col]
            if isinstance(b, list):
                a, b = sorted(a or []), sorted(b)
            elif col == "city" and blank(a) and blank(b):
                continue
            assert a == b, (key, col)


@pytest.mark.parametrize("policy", ["merge", "touch", "overwrite"])
def test_plans_agree_and_keys_stay_unique(spark, policy):
    rng = random.Random(5)
    stored = spark.createDataFrame(stored_rows(rng, 12), FIELDS)
    incoming = spark.createDataFrame(random_rows(rng, 60, 16), NEW)
    big = U.upsert(stored, incoming, NOW, policy, with_action=True)
    small = U.upsert(stored, incoming, NOW, policy, with_action=True, small_batch=True)
    as_set = lambda df: {str(r) for r in df.collect()}
    assert as_set(big) == as_set(small)
    assert big.count() == big.select("dedup_hash").distinct().count()
    for flag in (False, True):
        changed = U.upsert(stored, incoming, NOW, policy, with_action=True, small_batch=flag, only_changes=True)
        assert as_set(changed) == as_set(big.where("action <> 'kept'"))


def test_merge_is_idempotent_and_never_blanks(spark):
    rng = random.Random(9)
    stored = spark.createDataFrame(stored_rows(rng, 12), FIELDS)
    incoming = spark.createDataFrame(random_rows(rng, 60, 16), NEW)
    first = U.upsert(stored, incoming, NOW)
    second = U.upsert(first, incoming, NOW)
    drop = ["updated_at"]
    rows = lambda df: {str(r) for r in df.drop(*drop).withColumns({c: F.array_sort(c) for c in ("tags", "source_platforms")}).collect()}
    assert rows(first) == rows(second)
    before = {r.dedup_hash: r for r in stored.collect()}
    for r in first.collect():
        old = before.get(r.dedup_hash)
        if old is not None:
            assert blank(old.city) or r.city == old.city
            assert old.pay is None or r.pay == old.pay


def test_insert_unique(spark):
    stored = spark.createDataFrame([("u", "a")], "user string, job string")
    rows = spark.createDataFrame([(1, "u", "a"), (2, "u", "b"), (3, "u", "b"), (4, "v", "a")], "id int, user string, job string")
    got = {r.id: r.accepted for r in U.mark_unique(stored, rows, ["user", "job"], [F.col("id")]).collect()}
    assert got == {1: False, 2: True, 3: False, 4: True}


def test_update_and_delete_keep_null_conditions(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, x string")
    assert {r.id for r in U.delete_where(df, F.col("x") == "a").collect()} == {2}
    assert {(r.id, r.x) for r in U.update_where(df, F.col("x") == "a", {"x": F.lit("b")}).collect()} == {(1, "b"), (2, None)}


# ------------------------------------------------------------------ merge log
def merge_rows(spark, rows):
    return spark.createDataFrame(rows, "dedup_hash string, location_city string, salary_min double, seq int")


def test_merge_log_reads_its_buckets_and_keeps_disk_bounded(spark):
    from pathlib import Path

    from listflow.session import shared_dir
    from listflow.sources.tables import MergeLog, logged_batches
    from listflow.streaming.jobs import merge_handler

    schema = merge_rows(spark, []).drop("seq").schema
    path = shared_dir(spark, "merge")
    log = MergeLog(spark, path, schema, buckets=16, compact_every=4)
    log.start(merge_rows(spark, [(f"k{i}", None, None, 0) for i in range(40)]).drop("seq"))
    handle = merge_handler(log, "2024-01-01 00:00:00")
    want = {f"k{i}": (None, None) for i in range(40)}
    staged_before = {p.name for p in Path(path.removeprefix("file:")).parent.iterdir()}
    most = 0
    for batch in range(50):
        rows = [(f"k{batch % 45}", None if batch % 3 else f"c{batch}", float(batch), 0), (f"k{(7 * batch) % 45}", f"d{batch}", None, 1)]
        for _ in range(2 if batch % 5 == 0 else 1):  # some are replayed
            handle(merge_rows(spark, rows), batch)
        for k, city, salary, _ in rows:
            have = want.get(k, (None, None))
            want[k] = (have[0] if have[0] is not None else city, have[1] if have[1] is not None else salary)
        most = max(most, len(logged_batches(spark, f"{path}/changes")))
        assert len(logged_batches(spark, f"{path}/base")) <= 2
    got = {r.dedup_hash: (r.location_city, r.salary_min) for r in log.current().collect()}
    assert got == want and most <= 8
    assert {p.name for p in Path(path.removeprefix("file:")).parent.iterdir()} == staged_before
    # a batch of one key reads one bucket of each folder
    one = log.stored(merge_rows(spark, [("k3", None, None, 0)]).select("dedup_hash"), 50)
    text = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [(bucket" in text or "PartitionFilters: [isnotnull(bucket" in text or "PartitionFilters: [bucket" in text
    assert [r.dedup_hash for r in one.collect()] == ["k3"]
    files = log.read(50, [0]).inputFiles()
    assert files and all("bucket=0/" in f for f in log.read(50, [0]).where("dedup_hash is not null").select(F.input_file_name()).distinct().toPandas().iloc[:, 0] if f)


def test_scratch_removes_what_is_staged_inside(spark):
    from pathlib import Path

    from listflow.sources.tables import scratch, staged

    def place(df):
        return Path(df.inputFiles()[0].removeprefix("file://")).parent

    with scratch(spark):
        outer = place(staged(spark.range(3)))
        with scratch(spark):
            inner = place(staged(spark.range(3)))
        assert outer.exists() and not inner.exists()
    assert not outer.exists() and place(staged(spark.range(3))).exists()


def test_merge_log_writes_a_large_bucket_in_several_tasks(spark, tmp_path):
    """A bucket is cut by its size, so few buckets do not leave a large table to few tasks; nothing of the log is read through Python."""
    from listflow.sources.tables import MergeLog

    rows = spark.range(0, 20_000, numPartitions=8).select(F.sha2(F.col("id").cast("string"), 256).alias("dedup_hash"), F.col("id").alias("v"))
    log = MergeLog(spark, str(tmp_path / "log"), rows.schema, buckets=1)
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(size)
    spark.conf.set(size, "128k")
    try:
        log.start(rows)
    finally:
        spark.conf.set(size, before)
    stored = spark.read.parquet(str(tmp_path / "log" / "base" / "batch=-1"))
    assert stored.select(F.input_file_name()).distinct().count() > 1
    assert log.current().select("v").distinct().count() == log.current().count() == 20_000
    assert "ExistingRDD" not in log.current()._jdf.queryExecution().toString()

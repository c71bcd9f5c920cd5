"""Hard negatives against brute force, and what the length buckets leave out."""

from __future__ import annotations

import math
import random

import duckdb
import numpy as np
import pytest

from listflow.llm.common import table
from listflow.llm.negatives import LengthBucket, mine_negatives
from listflow.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.01"


def brute(rows, every, low=80, scale=256):
    ok = [(i, v, c) for i, v, c in rows if i is not None and v is not None and c is not None and all(x is not None and math.isfinite(x) for x in v)]
    ok = [(i, [math.floor(x * scale) for x in v], c) for i, v, c in ok]
    ok = [r for r in ok if sum(x * x for x in r[1]) < 2**62]
    out = []
    for k, (i, v, c) in enumerate(ok):
        if i % every:
            continue
        scored = [(-sum(x * y for x, y in zip(v, w)), j, d) for m, (j, w, d) in enumerate(ok) if m != k and len(w) == len(v)]
        for s, j, _ in sorted(x for x in scored if x[2] == c)[:5]:
            band = sorted((t, m) for t, m, d in scored if d != c and low * -s <= 100 * -t <= 100 * -s)
            out += [(i, j, rank, m, -s, -t) for rank, (t, m) in enumerate(band[:5], 1)]
    return sorted(out)


def clustered(rng, n, width=8):
    centres = rng.normal(size=(6, width)) * 0.7
    at = rng.integers(0, 6, n)
    return (centres[at] + 0.1 * rng.normal(size=(n, width))) * rng.choice([0.5, 1, 1, 3], n)[:, None], at


@pytest.mark.parametrize("block", [8192, 40, 7])
def test_negatives_equal_brute_force(spark, block):
    rng = np.random.default_rng(5)
    v, at = clustered(rng, 220)
    label = [str(rng.integers(0, 3)) if rng.random() < 0.6 else str(a) for a in at]
    rows = [(i, [float(x) for x in y], c) for i, (y, c) in enumerate(zip(v, label))]
    same = rows[30][1]
    rows += [(1000 + i, same, "0") for i in range(20)] + [(1100 + i, same, "1") for i in range(20)]
    rows += [(20, same, "0"), (20, same, "0"), rows[40], rows[40], rows[40]]
    rows += [(None, same, "0"), (2, None, "0"), (10, same, None), (10, [*same[:7], float("nan")], "0"), (10, [*same[:7], float("inf")], "1"), (10, [None] * 8, "1")]
    rows += [(2000, [1e30] * 8, "0"), (2010, [3e6] * 8, "0"), (2011, [2.9e6] * 8, "1"), (2012, [2.8e6] * 8, "0"), (2020, [], "0"), (2021, [], "0"), (2022, [], "1"), (2030, [0.0] * 8, "0"), (2040, [1.0, 2.0], "0"), (2041, [1.0, 2.0], "0"), (2042, [1.0, 1.9], "1")]
    random.Random(1).shuffle(rows)
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string").selectExpr("*", "1 as id", "2 as Norm", "3 as anchor")
    got = mine_negatives(frame, every=10, rows_per_block=block)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = brute(rows, 10)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 300
    assert mine_negatives(frame.limit(0)).count() == 0
    assert mine_negatives(frame.where("vec_id % 10 <> 0"), every=10).count() == 0


def test_ranges_keep_every_hit_and_leave_out_most_on_clusters():
    rng = np.random.default_rng(3)
    v, _ = clustered(rng, 600, 16)
    v = np.floor(256 * v[np.argsort(np.linalg.norm(v, axis=1))][-300:]).astype(np.int64)
    norm = np.sqrt((v * v).sum(axis=1).astype(float))
    bucket, left = LengthBucket(v, norm), 0
    for i in range(0, 300, 5):
        score = v @ v[i]
        least = float(np.sort(score)[-12])
        found = bucket.candidates(v[i].astype(float), norm[i], least)
        hits = set(np.flatnonzero(score >= least).tolist())
        assert found is None or hits <= set(found.tolist())
        left += len(v) if found is None else len(found)
    assert left < 0.5 * 60 * len(v)
    assert len(bucket.candidates(v[0].astype(float), norm[0], 2 * norm[0] * bucket.longest)) == 0


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.1"])
def test_query_equals_its_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    found = con.sql(ORACLES["op11_hard_negatives"])
    frame = QUERIES["op11_hard_negatives"](spark, sf)
    assert frame.columns == list(found.columns)
    want = sorted(found.fetchall())
    assert sorted(map(tuple, frame.collect())) == want and len(want) > 10


def test_negatives_of_the_test_table(spark):
    rows = [(r.vec_id, r.embedding, None if r.label is None else (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label) for r in table(spark, SF, "embeddings").collect()]
    assert sorted(map(tuple, QUERIES["op11_hard_negatives"](spark, SF).collect())) == brute(rows, 100)

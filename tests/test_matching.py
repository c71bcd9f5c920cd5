"""Containment joins, shared tags and nearest rows against plain versions."""

from __future__ import annotations

import random
import re
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from listflow.operators import lsh, matching, ranking as R, similarity as V
from listflow.suite import QUERIES
from listflow.suite.people import JUNIOR, PERSON
from listflow.suite.views import LISTINGS_AS_OF, listings, table

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("bound", [0, 10_000])
def test_terms_in_texts(spark, bound):
    rng = random.Random(4)
    letters = "abÄß .%_"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(30))) for _ in range(150)] + ["", None, "ab", "ABAB", "the visa ing", "x" * 5000 + "visa"]
    terms = ["".join(rng.choice(letters) for _ in range(rng.randrange(7))) for _ in range(60)] + ["", None, "a", "AB", "visa", "ing", "nowhere at all", "İ"]
    got = matching.substring_matches(spark.createDataFrame([(t,) for t in texts], "text string"), "text", spark.createDataFrame([(t,) for t in terms], "term string"), "term", bound)
    want = {(t, x) for t in texts if t is not None for x in terms if x and x.lower() in t.lower()}
    assert sorted(map(tuple, got.collect())) == sorted(want)
    nothing = spark.createDataFrame([], "term string")
    assert matching.substring_matches(spark.createDataFrame([("a",)], "text string"), "text", nothing, "term", 0).count() == 0 if bound else True


def test_a_term_is_indexed_under_its_rarest_piece(spark):
    texts = spark.createDataFrame([(f"common words here {i}",) for i in range(50)] + [("common zebra words",)], "_low string")
    terms = spark.createDataFrame([("common zebra",), ("common",)], "_key string")
    found = matching._piece_candidates(texts, terms).groupBy("_key").count().collect()
    assert {r["_key"]: r["count"] for r in found} == {"common zebra": 1, "common": 51}


@pytest.mark.parametrize("least", [1, 2, 4])
@pytest.mark.parametrize("block", [3, 4096])
def test_rows_that_share_at_least_so_many_tags(spark, least, block):
    rng = random.Random(least)
    tags = lambda: rng.choice([None, [], ["Hot"], None]) if rng.random() < 0.1 else ["hot "] * 2 + [f"t{int(rng.random() ** 2 * 12)}" for _ in range(rng.randrange(7))] + [None]
    left, right = [(i, tags()) for i in range(60)], [(100 + i, tags()) for i in range(50)]
    frames = [spark.createDataFrame(rows, f"{name} long, t array<string>") for rows, name in ((left, "a"), (right, "b"))]
    clean = lambda t: {x.strip().lower() for x in t or [] if x is not None}
    want = sorted((i, j, len(clean(x) & clean(y))) for i, x in left for j, y in right if len(clean(x) & clean(y)) >= least)
    got = matching.overlaps_of_at_least(frames[0], "a", "t", frames[1], "b", "t", least, block)
    assert sorted(map(tuple, got.collect())) == want and want


def test_common_tags_are_hardly_met(spark):
    """Candidates do not grow with the square of the hottest tag: all rows have it, pairs share two others."""
    rows = [(i, ["hot", "warm", f"p{i // 2}", f"q{i // 2}"]) for i in range(400)]
    df = spark.createDataFrame(rows, "a long, t array<string>")
    pairs = matching.overlaps_of_at_least(df, "a", "t", df.withColumnRenamed("a", "b"), "b", "t", 3)
    assert pairs.where("a < b").count() == 200
    single = df.select("a", F.explode("t").alias("tag"))
    freq = {r.tag: r["count"] for r in single.groupBy("tag").count().collect()}
    assert sum(min(freq[t] for t in sorted(x, key=lambda t: (freq[t], t))[:2]) for _, x in rows) <= 4 * len(rows)


@pytest.mark.parametrize("least", [2, 3])
@pytest.mark.parametrize("common", [0, 8, 30, 1_000])
def test_common_tags_complete_the_pairs(spark, least, common):
    rng = random.Random(common + least)
    rows = [(i, list({f"t{int(rng.random() ** 3 * 15)}" for _ in range(rng.randrange(7))})) for i in range(50)] + [(None, ["t0", "t1", "t2"])]
    df = spark.createDataFrame(rows, "a long, t array<string>")
    want = {(i, j, len(set(x) & set(y))) for i, x in rows for j, y in rows if len(set(x) & set(y)) >= least}
    for ordered in (False, True):
        got = matching.overlaps_of_at_least(df, "a", "t", df.withColumnRenamed("a", "b"), "b", "t", least, 4, ordered, common).collect()
        assert len(got) == len(set(map(tuple, got)))
        assert set(map(tuple, got)) == {w for w in want if not ordered or None not in w and w[0] < w[1]}


def test_counts_of_shared_tags_are_dealt_out(spark, monkeypatch):
    """One input partition, few tags: the pairs are still counted in as many tasks as they ask for."""
    monkeypatch.setattr(matching, "TASK_MEETINGS", 1_000)
    left = spark.createDataFrame([(f"b{i}", [f"w{j}" for j in range(20)]) for i in range(5)], "b string, t array<string>")
    right = spark.range(2_000).coalesce(1).select(F.col("id").alias("a"), F.array(F.concat(F.lit("w"), F.col("id") % 20), F.lit("w0")).alias("t"))
    found = matching.overlap_counts(left, "b", "t", right, "a", "t")
    assert {(r.shared, r["count"]) for r in found.groupBy("shared").count().collect()} == {(1, 500), (2, 9_500)}
    assert found.groupBy(F.spark_partition_id()).count().count() >= 15


@pytest.mark.parametrize("broadcast", [0, 10_000])
def test_lists_of_a_hot_tag_are_dealt_out(spark, monkeypatch, broadcast):
    """A few tags hold all rows: their ids are gathered, and their lists meet, in as many tasks as rows and meetings ask for."""
    monkeypatch.setattr(matching, "TASK_MEETINGS", 1_000)
    monkeypatch.setattr(matching, "GATHERED_ROWS", 200)
    monkeypatch.setattr(matching, "MAX_BROADCAST_ROWS", broadcast)
    left = spark.createDataFrame([(f"b{i}", ["x", "y"] if i % 2 else ["y", "z"]) for i in range(5)], "b string, t array<string>")
    right = spark.range(2_000).coalesce(1).select(F.col("id").alias("a"), F.array(F.lit("y"), F.when(F.col("id") % 2 == 0, F.lit("x"))).alias("t"))
    found = matching.overlap_counts(left, "b", "t", right, "a", "t", block=100)
    want = {(f"b{i}", a, 2 if i % 2 and a % 2 == 0 else 1) for i in range(5) for a in range(2_000)}
    rows = found.collect()
    assert set(map(tuple, rows)) == want and len(rows) == len(want)
    plan = re.sub(r"#\d+L?", "", found._jdf.queryExecution().optimizedPlan().toString())
    # meetings: x 2 * 1,000 and y 5 * 2,000; rows of both sides: 7 and 3,000
    assert plan.count("RepartitionByExpression [tag, left, right], 16") == 2
    assert "RepartitionByExpression [tag, right], 16" in plan and "RepartitionByExpression [tag, left], 1" in plan


def recall(exact, approximate):
    want = {(r.query_id, r.vec_id) for r in exact}
    return len(want & {(r.query_id, r.vec_id) for r in approximate}) / len(want)


def test_recall_of_the_hash_tables(spark):
    exact, near = (QUERIES[n](spark, SF).collect() for n in ("vector_top_many", "vector_top_many_hashed"))
    assert recall(exact, near) >= 0.9
    again = {(r.query_id, r.vec_id): r.similarity for r in exact}
    assert all(again[k] == s for k, s in ((((r.query_id, r.vec_id)), r.similarity) for r in near) if k in again)


def test_many_bits_find_clusters_and_compare_little(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(60, 32))
    v = centres[rng.integers(0, 60, 1200)] + 0.15 * rng.normal(size=(1200, 32))
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "vec_id long, embedding array<float>")
    odd = spark.createDataFrame([(5000, None), (5001, [1.0, None]), (5002, [1.0, 0.5]), (5003, [1.0, 0.6]), (5004, [0.0] * 32)], "vec_id long, embedding array<float>")
    df = df.union(odd)
    queries = df.where("vec_id % 4 = 0 or vec_id > 5000").withColumnRenamed("vec_id", "query_id")
    clean = "vec_id not in (5000, 5001, 5002, 5003)"
    exact = V.top_similar_many(df.where(clean), queries.where(clean.replace("vec_id", "query_id")), 5, 0.5, key="vec_id").collect()
    for block in (1024, 20):
        near = lsh.top_similar_hashed(df, queries, 5, 0.5, key="vec_id", tables=8, bits=10, block_rows=block).collect()
        assert recall(exact, near) >= 0.9
        assert {(r.query_id, r.vec_id) for r in near if r.query_id > 5000} == {(5002, 5003), (5003, 5002)}
    side = np.einsum("nw,tbw->ntb", v, lsh.planes(32, 8, 10)) > 0
    bucket = (side * (1 << np.arange(10))).sum(axis=2)
    met = sum(int((np.bincount(bucket[:, t]) ** 2).sum()) for t in range(8))
    assert met < 0.4 * len(v) ** 2


def test_products_stay_small():
    """However many rows a block has, a product of the vectors is one tile, and the best are those of all pairs."""
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(1_300, 4)), rng.normal(size=(30_000, 4))
    tracemalloc.start()
    a, b, s = V._best_pairs(x, y, 5, 0.9, None, None)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16e6  # a product of 1,024 x 8,192 alone has 33 MB
    cosine = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ (y / np.linalg.norm(y, axis=1, keepdims=True)).T
    order = np.argsort(-cosine, axis=1, kind="stable")[:, :5]
    assert a.tolist() == np.repeat(np.arange(1_300), 5).tolist() and b.tolist() == order.ravel().tolist()
    assert np.allclose(s, np.take_along_axis(cosine, order, 1).ravel())


def test_copies_of_a_vector_and_bounded_sends(spark, monkeypatch):
    """Ties among copies go to the smaller id in blocks of any size, and a row is sent no more often than the grid is wide."""
    rng = np.random.default_rng(2)
    v = rng.normal(size=(4, 8))
    rows = [(i, [float(x) for x in v[i % 4]]) for i in range(120)] + [(900, None), (901, [0.0] * 8), (902, [1.0, 2.0]), (903, [2.0, 4.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    queries = df.withColumnRenamed("vec_id", "query_id")
    monkeypatch.setattr(V, "GRID", 3)
    for block in (1_024, 5):
        got = V.top_similar_many(df, queries, 5, 0.9, key="vec_id", block_rows=block).collect()
        want = {(q, j, n + 1) for q in range(120) for n, j in enumerate([j for j in range(q % 4, 120, 4) if j != q][:5])} | {(902, 903, 1), (903, 902, 1)}
        assert {(r.query_id, r.vec_id, r["rank"]) for r in got} == want and len(got) == len(want)

    def sent(*_):
        def run(left, right):
            import pyarrow as pa

            return pa.table({"qid": left["qid"], "rid": left["qid"], "similarity": pa.array([1.0] * len(left))})

        return run

    monkeypatch.setattr(V, "block_top", sent)
    assert V.top_similar_many(df, queries, 900, 0.9, key="vec_id", block_rows=1).count() == 3 * 123


def test_hash_tables_meet_in_buckets_or_in_the_grid(spark, monkeypatch):
    df = table(spark, "/root/testdata/sf0.001", "embeddings")
    queries = df.withColumnRenamed("vec_id", "query_id")
    found = []
    for share in (0.0, 99.0):
        monkeypatch.setattr(lsh, "GRID_FROM", share)
        near = lsh.top_similar_hashed(df, queries, 5, 0.0, key="vec_id", tables=5, bits=3, block_rows=16)
        found.append(sorted((r.query_id, r["rank"], r.vec_id, round(r.similarity, 9)) for r in near.collect()))
    assert found[0] == found[1] and found[0]


def test_passes_and_blocks_of_people_give_each_ones_ranking(spark):
    df = listings(spark, "/root/testdata/sf0.001")
    people = [(f"{n}{i}", p.skills, level, p.domain, p.words, p.past_title_words) for i in range(6) for n, p in (("a", PERSON), ("b", JUNIOR)) for level in (p.level, None, "odd")][:30]
    people = [(f"{k}", *p[1:]) for k, p in enumerate(people)]
    frame = spark.createDataFrame(people, "candidate_id string, skills array<string>, level string, domain string, words array<string>, past_title_words array<string>")
    rank = lambda **more: sorted((r.candidate_id, r.match_score, r.id) for r in R.rank_for_resumes(df, frame, LISTINGS_AS_OF, days=3650, limit=7, **more).collect())
    whole = rank()
    assert rank(max_bytes=900, block=2) == whole and len({c for c, _, _ in whole}) == len(people)
    assert R.rank_for_resumes(df, frame.limit(0), LISTINGS_AS_OF).count() == 0


def test_similar_rows_from_sql(spark):
    rows = table(spark, "/root/testdata/sf0.001", "embeddings")
    rows.createOrReplaceTempView("some_rows")
    V.register_similar_rows(spark, "close_rows", "some_rows", "vec_id", "embedding")
    query = rows.where("vec_id = 3").first().embedding
    for exclude, limit in ((None, 4), (3, 6)):
        want = V.top_similar(rows, list(query), limit, 0.1, exclude, key="vec_id").select("vec_id", "similarity").collect()
        said = "null" if exclude is None else exclude
        got = spark.sql(f"SELECT r.* FROM (SELECT embedding, {limit} AS n FROM some_rows WHERE vec_id = 3) q, LATERAL close_rows(q.embedding, 0.1D, q.n, {said}) r").collect()
        assert [(r.vec_id, round(r.similarity, 9)) for r in sorted(got, key=lambda r: (-r.similarity, r.vec_id))] == [(r.vec_id, round(r.similarity, 9)) for r in want]

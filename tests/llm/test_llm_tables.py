"""URL rules, shards, nearest neighbours, mixing, and the pipeline."""

from __future__ import annotations

import collections
import importlib
import random
import subprocess
import sys
from pathlib import Path

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from listflow.llm import mixing, shards, url_rules
from listflow.llm.ann import Router, balanced_parts, fit_router, nearest, nearest_neighbours
from listflow.llm.common import staged, table
from listflow.llm.quality import fit_field, quality
from listflow.llm.queries import ORACLES, QUERIES, URL_RULES
from test_llm_pairs import brute_components, brute_repeats, words_of
from test_llm_texts import check_packing, plain_counts

SF = "/root/testdata/sf0.01"
NATIVE = ("op5_url_filters", "op7_extendible_shards")


def in_duckdb(sql, sf=SF):
    con = duckdb.connect()
    for name in ("documents", "embeddings", "pages"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    found = con.sql(sql)
    return found.columns, found.fetchall()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    frame = QUERIES[name](spark, SF)
    columns, rows = in_duckdb(ORACLES[name])
    assert sorted(columns) == sorted(frame.columns)
    want = [tuple(r[columns.index(c)] for c in frame.columns) for r in rows]
    assert sorted(map(tuple, frame.collect()), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("name", NATIVE)
def test_native_plans_hold_no_python(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))


# ---------------------------------------------------------------------- URLs
def brute_url(url, rules, default):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    raw = rest
    for c in "/?#":
        raw = raw.split(c)[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in raw)
    path = rest[len(raw) :].split("?")[0].split("#")[0]
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith(f".{h}")) and path.startswith(p)]
    best = max(fits, key=lambda f: (f[0], f[1], f[3] == "block")) if fits else (0, 0, None, default)
    return host, path, best[2], best[3]


@pytest.mark.parametrize("points", [url_rules.POINTS, 3])
def test_urls_equal_brute_force(spark, monkeypatch, points):
    monkeypatch.setattr(url_rules, "POINTS", points)
    rules = URL_RULES + [("com", "/e", "block"), ("m.example.com", "/en/a", "block"), ("m.example.com", "/en/a", "allow"), ("example.com", "/en/ab", "allow"), ("x-y.com", "", "block"), ("com.", "/", "block"), ("b.a.com", "/", "allow"), ("a.com", "/b/", "block")]
    urls = [None, "", "no scheme", "http://", "http://COM/", "http://com", "https://Example.com/en/x?y#z", "a://b://example.com/en/", "http://www.example.com/en/", "http://wwwexample.com/en/", "http://m.example.com/en/abc", "http://q.m.example.com/en/ab"]
    urls += ["http://n.net/es/1", "http://net/fr/", "http://x.net/de/", "http://x-y.com#f", "http://z.x-y.com?q", "http://com./", "http://a.com./", "http://ÉX.example.com/en/é", "http://.com/", "http://b.a.com/b/", "http://a.com/b/", "http://example.com:80/en/", "http://example.com/e"]
    rng = random.Random(6)
    urls += ["http://" + ".".join(rng.choice(["a", "b", "m", "www", "example", "com", "net", ""]) for _ in range(rng.randrange(1, 5))) + rng.choice(["/", "/en/", "/e", "/b/c", "", "/es/?x", "/en/abc"]) for _ in range(200)]
    rows = [(i, u) for i, u in enumerate(urls)] + [(1, urls[8]), (None, urls[8])]
    frame = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "1 as host", "2 as rule", "3 as grp")
    given = spark.createDataFrame([*rules, (None, "/", "block"), ("com", None, "block")], "host string, path string, verdict string")
    got = url_rules.judge_urls(frame, given, default="allow").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(i, *brute_url(u, rules, "allow")) for i, u in rows], key=str)
    assert url_rules.judge_urls(frame.limit(0), given).count() == 0
    assert {r.verdict for r in url_rules.judge_urls(frame, given.limit(0), default="block").collect()} == {"block"}


# -------------------------------------------------------------------- shards
@pytest.mark.parametrize("limit", [1, 40, 1000, 10**9])
def test_shards_hold_the_limit(spark, monkeypatch, limit):
    monkeypatch.setattr(shards, "SPARE", 0)
    rng = random.Random(8)
    rows = [(i, "t" * rng.randrange(60)) for i in range(60)] + [(5, "copy")] * 70 + [(None, None), (None, None), (7, ""), (8, "é" * 3000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n_bytes", "2 as cell", "3 as h")
    got = shards.extendible_shards(frame, limit).collect()
    assert collections.Counter((r.doc_id, r.n_bytes) for r in got) == collections.Counter((i, len((t or "").encode())) for i, t in rows)
    held = collections.defaultdict(list)
    for r in got:
        held[r.shard].append(r)
        assert r.depth == len(r.shard)
    names = sorted(held)
    for name, members in held.items():
        size = sum(r.n_bytes for r in members)
        assert {(r.shard_bytes, r.shard_rows) for r in members} == {(size, len(members))}
        assert size <= limit or len(members) == 1
        # what it was split from was too large, and no shard lies in another
        if name:
            above = [r for n in names if n.startswith(name[:-1]) for r in held[n]]
            assert sum(r.n_bytes for r in above) > limit and len(above) > 1
        assert not any(other != name and other.startswith(name) for other in names)
    assert shards.extendible_shards(frame.limit(0), limit).count() == 0


# ---------------------------------------------------------------- neighbours
def test_balanced_parts_follow_the_graph():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(4, 8)) * 5
    x = np.concatenate([c + rng.normal(size=(64, 8)) for c in centres])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    part = balanced_parts(nearest(x, x, 6, np.arange(len(x))), 4)
    assert np.bincount(part).tolist() == [64] * 4
    assert sum(np.bincount(part[64 * k : 64 * k + 64]).max() for k in range(4)) >= 0.9 * 256


def test_router_finds_clustered_neighbours_in_few_parts():
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(32, 16))
    x = centres[rng.integers(0, 32, 2400)] + 0.2 * rng.normal(size=(2400, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    router = fit_router(x[:2000])
    assert isinstance(router, Router) and router.parts == 8 and router.probes < 8
    true, home, route = nearest(x[2000:], x, 5), router.route(x, 1)[:, 0], router.route(x[2000:], router.probes)
    assert np.mean([home[j] in r for t, r in zip(true, route) for j in t]) >= 0.9


def test_recall_on_the_test_table(spark):
    sf = "/root/testdata/sf0.1"
    x = {r.vec_id: np.array(r.embedding, float) for r in table(spark, sf, "embeddings").collect()}
    ids = np.array(sorted(x))
    m = np.stack([x[i] for i in ids])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    got = collections.defaultdict(list)
    for r in QUERIES["op6_learned_partitions"](spark, sf).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    hits = 0
    asked = [i for i in ids if i % 50 == 0]
    for i in asked:
        s = m @ m[np.searchsorted(ids, i)]
        s[ids == i] = -2
        best = ids[np.lexsort((ids, -s))[:5]]
        mine = sorted(got[i])
        assert [r for r, _, _ in mine] == [1, 2, 3, 4, 5]
        assert all(abs(v - s[np.searchsorted(ids, j)]) < 1e-12 for _, j, v in mine)
        hits += len(set(best) & {j for _, j, _ in mine})
    assert set(got) == set(asked) and hits >= 0.9 * 5 * len(asked)


def test_odd_vectors_and_ties(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (50, [1.0, 0.0]), (100, [0.0, 0.0]), (150, None), (200, [nan, 1.0]), (250, [None, 1.0]), (300, [inf, 1.0]), (350, [1.0]), (None, [1.0, 0.0])]
    rows += [(1000 + i, [1.0, 0.0]) for i in range(1, 30)] + [(3, [0.0, 1.0]), (3, [0.0, 1.0]), (4, [-1.0, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as id", "2 as v", "3 as part")
    got = nearest_neighbours(frame).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == [(q, k + 1, i, 1.0) for q, ids in ((0, [50, 1001, 1002, 1003, 1004]), (50, [0, 1001, 1002, 1003, 1004])) for k, i in enumerate(ids)]
    few = nearest_neighbours(frame.where("vec_id in (0, 3, 4)")).collect()
    assert sorted((r.rank, r.vec_id, r.score) for r in few) == [(1, 3, 0.0), (2, 4, -1.0)]
    assert nearest_neighbours(frame.limit(0)).count() == 0 and nearest_neighbours(frame.where("vec_id = 150")).count() == 0


def test_other_widths_and_repeated_ids_take_part(spark):
    rows = [(50 * i, [1.0, 0.01 * i, 0.0]) for i in range(12)] + [(50, [0.0, 1.0, 0.0]), (50, [0.0, 1.0, 0.0])]
    rows += [(100, [1.0, 1.0]), (101, [1.0, 0.9]), (102, [0.5, 0.1]), (150, [2.0])]
    got = collections.defaultdict(list)
    for r in nearest_neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    want = collections.defaultdict(list)
    distinct = list(dict.fromkeys((i, tuple(v)) for i, v in rows))
    cos = lambda x, y: float(np.dot(x, y) / np.sqrt(np.dot(x, x)) / np.sqrt(np.dot(y, y)))
    for i, v in distinct:
        if i % 50 == 0:
            near = sorted((-cos(v, w), j) for j, w in distinct if (j, w) != (i, v) and len(w) == len(v))
            want[i] += [(k, j, -s) for k, (s, j) in enumerate(near[:5], 1)]
    assert {i: sorted((k, j, round(s, 12)) for k, j, s in x) for i, x in got.items()} == {i: sorted((k, j, round(s, 12)) for k, j, s in x) for i, x in want.items() if x}


def test_a_query_in_a_small_part_goes_on_to_others(spark, monkeypatch):
    router = Router((np.eye(2), np.zeros(2), np.eye(2), np.zeros(2)), 2, 1)
    monkeypatch.setattr("listflow.llm.ann.fit_router", lambda vectors: router)
    rows = [(i, [1.0, i / 1000]) for i in range(3)] + [(i, [i / 1000, 1.0]) for i in range(3, 30)]
    got = nearest_neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r.query_id for r in got} == {0} and sorted(r["rank"] for r in got) == [1, 2, 3, 4, 5]


# -------------------------------------------------------------------- mixing
def brute_targets(sizes, share=1.5, most=2, weights=(3, 1, 2)):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, full = share * sum(sizes.values()), set()
    while True:
        rest = [s for s in names if s not in full]
        if not rest:
            return {s: most * sizes[s] for s in names}
        level = (total - sum(most * sizes[s] for s in full)) / sum(weight[s] for s in rest)
        more = {s for s in rest if level * weight[s] > most * sizes[s]}
        if not more:
            return {s: most * sizes[s] if s in full else level * weight[s] for s in names}
        full |= more


def check_mix(rows, docs):
    sizes, largest = collections.Counter(), collections.Counter()
    for _, source, text in docs:
        n = len((text or "").encode().split())
        sizes[source] += n
        largest[source] = max(largest[source], n)
    targets, taken, sources = brute_targets(sizes), collections.Counter(), {i: s for i, s, _ in docs}
    for r in rows:
        s = sources[r.doc_id]
        assert r.source_size == sizes[s] and abs(r.target - targets[s]) <= 1e-9 * max(1, targets[s])
        assert r.taken in (0, r.size, 2 * r.size)
        taken[s] += r.taken
    for s in sizes:
        assert abs(taken[s] - targets[s]) <= largest[s] / 2 + 1e-6, (s, taken[s], targets[s])


def test_mix_of_odd_rows(spark):
    rng = random.Random(5)
    docs = [(i, rng.choice(["a", "b", "b", "b", "é", "", None]), "w " * rng.randrange(30)) for i in range(400)]
    docs += [(1000, "only", "x " * 500), (1001, "empty", None), (1002, "empty", ""), (1003, None, None), (1004, "b", "y " * 4000)]
    frame = spark.createDataFrame(docs, "doc_id long, source string, text string").selectExpr("*", "1 as shard", "2 as h", "3 as block", "4 as draws")
    got = mixing.mix_counts(frame, shards=5).collect()
    assert sorted(r.doc_id for r in got) == sorted(i for i, _, _ in docs)
    check_mix(got, docs)
    assert sorted(map(str, mixing.mix_counts(frame, shards=5).collect())) == sorted(map(str, got))
    out = mixing.mix(frame, shards=5)
    assert out.columns == ["doc_id", "source", "text", "h", "block", "draws", "shard"]
    drawn = collections.Counter((r.doc_id, r.shard) for r in out.collect())
    assert drawn == collections.Counter((r.doc_id, s) for r in got for s in r.shards)
    assert mixing.mix_counts(frame.limit(0)).count() == 0 and mixing.mix(frame.limit(0)).count() == 0
    alike = spark.createDataFrame([(1, "a", "x y")] * 9 + [(None, "b", "z")], "doc_id long, source string, text string")
    assert mixing.mix_counts(alike).count() == 10


@pytest.mark.parametrize("extra", [0, 7])
def test_repeated_rows_are_drawn_each_for_itself(spark, extra):
    docs = [(1, "a", "w " * 10)] * 100 + [(2 + i, "a", "v " * 10) for i in range(extra)] + [(None, "b", "z " * 3)] * (5 * extra)
    frame = spark.createDataFrame(docs, "doc_id long, source string, text string").selectExpr("*", "map('a', 1) as kind")
    got = mixing.mix_counts(frame).collect()
    check_mix(got, docs)
    if not extra:
        assert {r.target for r in got} == {1500.0} and abs(sum(r.taken for r in got) - 1500) <= 5
    drawn = collections.Counter(r.doc_id for r in mixing.mix(frame).collect())
    assert drawn == collections.Counter(i for r in got for i in [r.doc_id] * len(r.shards))
    assert sorted(map(str, mixing.mix_counts(frame.repartition(7)).collect())) == sorted(map(str, got))


def test_tree_splits_quotas_exactly():
    quotas = np.array([100, 1, 0, 37])
    leaves = np.stack([mixing.shard_quotas(quotas, 7, k, seed=3) for k in range(7)])
    assert (leaves.sum(axis=0) == quotas).all() and (leaves >= 0).all()
    assert leaves.sum(axis=1).max() - leaves.sum(axis=1).min() <= 3
    assert (leaves[2] == mixing.shard_quotas(quotas, 7, 2, seed=3)).all()


def test_groups_of_sources_are_split_within_their_margins():
    quotas, margins = np.array([100, 1, 0, 37, 64]), np.array([40, 41, 40, 40, 41])
    leaves = mixing.split_within(quotas, margins, 3, 2)
    assert (leaves.sum(axis=0) == quotas).all() and (leaves.sum(axis=1) == margins).all() and (leaves >= 0).all()
    assert (leaves == mixing.split_within(quotas, margins, 3, 2)).all()


def test_mix_of_many_sources(spark, monkeypatch):
    monkeypatch.setattr(mixing, "GROUP", 16)
    rng = random.Random(2)
    docs = [(i, None if i % 97 == 0 else f"host{rng.randrange(150):03}", "w " * rng.randrange(60)) for i in range(1500)]
    frame = spark.createDataFrame(docs, "doc_id long, source string, text string")
    got = mixing.mix_counts(frame, shards=7).collect()
    check_mix(got, docs)
    assert sorted(map(str, mixing.mix_counts(frame.repartition(5), shards=7).collect())) == sorted(map(str, got))
    held = collections.Counter(s for r in got for s in r.shards)
    assert set(held) == set(range(7))


def test_mix_of_the_test_table(spark):
    docs = [(r.doc_id, r.source, r.text) for r in table(spark, SF, "documents").collect()]
    got = QUERIES["op10_mix_sources"](spark, SF).collect()
    assert len(got) == len(docs)
    check_mix(got, docs)


# ------------------------------------------------------------------ pipeline
def plain_stage(name, spark, before, after):
    """Compare a stage's rows with a plain version of it; texts as (doc_id, text)."""
    rows = [(r.doc_id, r.text) for r in before]
    if name == "quality rules":
        field = fit_field(table(spark, SF, "documents"), table(spark, SF, "labels"))
        verdict = quality(spark.createDataFrame([(k, t) for k, (_, t) in enumerate(rows)], "doc_id long, text string"), field).collect()
        assert all(r.kept == (not plain_counts(rows[r.doc_id][1])[5] and r.content_share >= 0.5) for r in verdict)
        assert sorted(map(tuple, after)) == sorted(tuple(before[r.doc_id]) for r in verdict if r.kept)
    elif name == "MinHash near-dedup":
        _, component = brute_components(rows, 5)
        assert sorted(map(tuple, after)) == sorted(tuple(r) for r, c in zip(before, component) if r.doc_id == c)
    elif name == "substring dedup":
        want = [(i, kept) for i, n, gone, kept in brute_repeats(rows, 35) if not gone or gone < n]
        assert sorted((r.doc_id, " ".join(words_of(r.text))) for r in after) == sorted(want)
        assert all(r.n_chars == len(r.text) for r in after)
    elif name == "mixing sources to target weights":
        sizes, most, taken = (collections.Counter() for _ in range(3))
        for r in before:
            sizes[r.source] += len(words_of(r.text))
            most[r.source] = max(most[r.source], len(words_of(r.text)))
        for r in after:
            taken[r.source] += len(words_of(r.text))
        targets = brute_targets(sizes)
        assert all(abs(taken[s] - targets[s]) <= most[s] / 2 + 1e-6 for s in sizes)
        assert set(map(tuple, after)) <= set(map(tuple, before)) and max(collections.Counter(map(tuple, after)).values()) <= 2
    else:
        made, tokens = check_packing(after, rows, 4096)
        assert made <= 1.03 * tokens / 4096


def test_each_stage_equals_a_plain_version(spark):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before, docs = docs, staged(stage(spark, docs, SF), "test-stage")
        if k < 4:
            assert docs.columns == columns
        plain_stage(name, spark, before.collect(), docs.collect())
    assert not {r.doc_id for r in docs.select("doc_id").distinct().collect()} & {r.doc_id for r in table(spark, SF, "labels").where("quality = 0").collect()}


def test_pipeline_on_odd_and_empty_tables(spark, tmp_path):
    table(spark, SF, "labels").write.parquet(f"{tmp_path}/labels.parquet")
    odd = table(spark, SF, "documents").limit(40).unionByName(spark.createDataFrame([(None, None, None, None, None), (1, "a " * 50, "en", None, 3), (1, "a " * 50, "en", None, 3), (None, "b c " * 90, None, "s", None)], "doc_id long, text string, lang string, source string, n_chars long"))
    for frame in (odd, odd.limit(0)):
        docs = frame.selectExpr("*", "1 as id", "'x' as shard", "array(1) as repeats_", "map('a', 1) as kind")
        for name, stage in corpus_pipeline.STAGES:
            docs = staged(stage(spark, docs, str(tmp_path)), "odd-stage")
        docs.count()


def test_nothing_else_imports_the_package():
    root = Path(corpus_pipeline.__file__).parent
    for path in (root / "listflow").rglob("*.py"):
        if "llm" not in path.parts:
            assert "listflow.llm" not in path.read_text() and "corpus_pipeline" not in path.read_text()
    entry = importlib.import_module("__spark_entry__")
    assert {"pipeline", *QUERIES} <= set(entry.queries())
    code = "import sys, importlib.abc\nclass No(importlib.abc.MetaPathFinder):\n    def find_spec(self, name, *a):\n        if name.startswith('listflow.llm') or name == 'corpus_pipeline':\n            raise ModuleNotFoundError(name, name=name)\nsys.meta_path.insert(0, No())\nimport __spark_entry__ as e\nassert 'pipeline' not in e.queries() and not any(k.startswith('op1_') for k in e.queries()) and len(e.queries()) > 100"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)


def test_run_leaves_only_its_result(spark):
    from listflow.llm import common

    before = list(common._WRITTEN)
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    left = [p for p in common._WRITTEN if p not in before]
    assert len(left) == 1 and rows.count() > 0
    assert Path(left[0].removeprefix("file:")).is_dir() and not list(Path(left[0]).parent.glob("llm-quality-*"))

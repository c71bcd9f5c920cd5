"""Approximate nearest neighbours by learned partitions.

The neighbour graph of a sample is cut into balanced parts, and a small
classifier learns to tell a vector's part from the parts of its neighbours. It
then files every row under its most probable part and routes each query to the
several most probable ones, where exact cosines decide. How many parts a query
needs is calibrated on sampled vectors that the classifier has not seen.

Fitting reads at most ``SAMPLE`` vectors, chosen by the hash of their ids, on
the driver. All else is joins: queries and rows of a part meet in blocks of
bounded size, each block keeps the best per query, and a ranking per query
merges them. Of equal vectors, only the ``top + 1`` smallest ids can be among
the ``top`` nearest of anything, so the others leave before the join.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from listflow.llm.common import small_batches, staged

#: Vectors to fit on; each part has about ``PART_SAMPLE`` of them.
SAMPLE, PART_SAMPLE = 8192, 128
NEIGHBOURS, HIDDEN = 10, 128
#: Recall to reach on the calibration vectors, of which there are at most ``CALIBRATION``.
RECALL, CALIBRATION = 0.95, 400
#: Rows and queries of a block.
ROWS, QUERIES = 8192, 1024


@dataclass(frozen=True)
class Router:
    """A classifier with one hidden layer, and the number of parts to search."""

    weights: tuple[np.ndarray, ...]
    parts: int
    probes: int

    def scores(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.weights
        return np.maximum(x @ w1 + b1, 0) @ w2 + b2

    def route(self, x: np.ndarray, n: int) -> np.ndarray:
        """The n most probable parts of each vector, ties to the lower number."""
        return np.argsort(-self.scores(x), axis=1, kind="stable")[:, :n]


def nearest(x: np.ndarray, y: np.ndarray, k: int, skip: np.ndarray | None = None) -> np.ndarray:
    """Indices of the k rows of y of largest inner product with each row of x; ``skip`` is a row of y to leave out for each."""
    out = np.zeros((len(x), k), np.int64)
    for a in range(0, len(x), 1024):
        s = x[a : a + 1024] @ y.T
        if skip is not None:
            s[np.arange(len(s)), skip[a : a + 1024]] = -np.inf
        out[a : a + 1024] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(neighbours: np.ndarray, parts: int, seed: int = 5) -> np.ndarray:
    """A part for each node of a neighbour graph: halved again and again, each time along its slowest mode, then mended by swaps."""
    n, k = neighbours.shape
    a, b = np.repeat(np.arange(n), k), neighbours.ravel()
    source, target = np.concatenate((a, b)), np.concatenate((b, a))
    part = np.zeros(n, np.int64)
    rng = np.random.default_rng(seed)
    groups = 1
    while groups < parts:
        inner = part[source] == part[target]
        s, t = source[inner], target[inner]
        degree = np.maximum(np.bincount(s, minlength=n), 1)
        size = np.maximum(np.bincount(part, minlength=groups), 1)
        mass = np.maximum(np.bincount(part, weights=degree, minlength=groups), 1)
        v = rng.standard_normal(n)
        for _ in range(60):
            v = v - (np.bincount(part, weights=v * degree, minlength=groups) / mass)[part]
            v = 0.5 * v + 0.5 * np.bincount(s, weights=v[t], minlength=n) / degree
            v = v / np.sqrt((np.bincount(part, weights=v * v, minlength=groups) / size)[part] + 1e-30)
        order = np.lexsort((v, part))
        first = np.searchsorted(part[order], np.arange(groups))
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n) - first[part[order]]
        side = (rank >= size[part] // 2).astype(np.int64)
        for _ in range(4):
            # gain of changing sides; of each group, as many change from either side
            away = np.bincount(s, weights=side[s] != side[t], minlength=n)
            gain = 2 * away - np.bincount(s, minlength=n)
            for g in range(groups):
                mine = np.flatnonzero(part == g)
                zero, one = mine[side[mine] == 0], mine[side[mine] == 1]
                zero, one = zero[np.argsort(-gain[zero], kind="stable")], one[np.argsort(-gain[one], kind="stable")]
                m = min(len(zero), len(one))
                m = int((gain[zero[:m]] + gain[one[:m]] > 2).sum()) // 2
                side[zero[:m]], side[one[:m]] = 1, 0
        part, groups = 2 * part + side, 2 * groups
    return part


def fit_router(vectors: np.ndarray, seed: int = 11, rounds: int = 60) -> Router:
    """Fit to unit vectors. A sample too small to cut has one part."""
    n, width = vectors.shape
    parts = 1 << max(0, int(np.log2(max(1, n // PART_SAMPLE))))
    if parts == 1:
        return Router((np.zeros((width, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1)), 1, 1)
    held = min(CALIBRATION, n // 8)
    fit, test = vectors[held:], vectors[:held]
    around = nearest(fit, fit, NEIGHBOURS, np.arange(len(fit)))
    part = balanced_parts(around, parts)
    goal = np.zeros((len(fit), parts))
    np.add.at(goal, (np.arange(len(fit)), part), 1.0)
    np.add.at(goal, (np.repeat(np.arange(len(fit)), NEIGHBOURS), part[around].ravel()), 1.0)
    goal /= goal.sum(axis=1, keepdims=True)
    rng = np.random.default_rng(seed)
    params = [rng.standard_normal((width, HIDDEN)) * np.sqrt(2 / width) * 2, np.zeros(HIDDEN), rng.standard_normal((HIDDEN, parts)) * np.sqrt(1 / HIDDEN), np.zeros(parts)]
    m, v, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for r in range(rounds):
        order = rng.permutation(len(fit))
        for i in range(0, len(order), 256):
            at = order[i : i + 256]
            x = fit[at]
            h = np.maximum(x @ params[0] + params[1], 0)
            z = h @ params[2] + params[3]
            z = np.exp(z - z.max(axis=1, keepdims=True))
            d = (z / z.sum(axis=1, keepdims=True) - goal[at]) / len(at)
            dh = (d @ params[2].T) * (h > 0)
            grads = [x.T @ dh, dh.sum(0), h.T @ d, d.sum(0)]
            step += 1
            for j, g in enumerate(grads):
                m[j], v[j] = 0.9 * m[j] + 0.1 * g, 0.999 * v[j] + 0.001 * g * g
                params[j] = params[j] - 0.004 * (1 - r / rounds) * (m[j] / (1 - 0.9**step)) / (np.sqrt(v[j] / (1 - 0.999**step)) + 1e-8)
    router = Router(tuple(params), parts, parts)
    true = nearest(test, fit, 5)
    home = router.route(fit, 1)[:, 0]
    order = router.route(test, parts)
    place = np.argsort(order, axis=1)
    needed = np.sort(place[np.arange(held)[:, None], home[true]].ravel())
    probes = int(needed[int(np.ceil(RECALL * len(needed))) - 1]) + 1
    return Router(tuple(params), parts, probes)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _filed(router: Router, probes: int):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                route = router.route(_unit(_matrix(batch.column(1))), probes)
                yield pa.record_batch([batch.column(0), batch.column(1), pa.array(list(route.astype(np.int32)), pa.list_(pa.int32()))], names=["id", "v", "parts"])

    return run


def _asked(router: Router, held: np.ndarray, top: int):
    """The parts that a query searches: ``router.probes`` at least, more until they hold ``top`` rows besides those of its own id."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                route = router.route(_unit(_matrix(batch.column(1))), router.parts)
                short = np.cumsum(held[route], axis=1) < top + batch.column(2).to_numpy()[:, None]
                probes = np.minimum(np.maximum(short.sum(axis=1) + 1, router.probes), router.parts)
                yield pa.record_batch([batch.column(0), batch.column(1), pa.array([r[:n] for r, n in zip(route.astype(np.int32), probes)], pa.list_(pa.int32()))], names=["id", "v", "parts"])

    return run


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosine of each pair of rows, by the same sums whatever stands around them, so that equal vectors tie."""
    dot = np.einsum("ij,ij->i", x, y)
    return dot / (np.sqrt(np.einsum("ij,ij->i", x, x)) * np.sqrt(np.einsum("ij,ij->i", y, y)))


def _best(top: int):
    """The top of one block of rows for one block of queries."""

    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        out: list[np.ndarray] = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        if queries.num_rows and rows.num_rows:
            q, v = _matrix(queries.column("v")), _matrix(rows.column("v"))
            q_id, v_id = queries.column("id").to_numpy(), rows.column("id").to_numpy()
            near = _unit(q) @ _unit(v).T
            # the query's own row; one with its id and another vector is a candidate
            a, b = np.nonzero(q_id[:, None] == v_id[None, :])
            own = (q[a] == v[b]).all(axis=1)
            near[a[own], b[own]] = -np.inf
            k = min(top, near.shape[1])
            least = -np.partition(-near, k - 1, axis=1)[:, k - 1] - 1e-9
            a, b = np.nonzero((near >= least[:, None]) & np.isfinite(near))
            score = cosines(q[a], v[b])
            order = np.lexsort((v_id[b], -score, a))
            a, b, score = a[order], b[order], score[order]
            first = np.searchsorted(a, a)
            keep = np.arange(len(a)) - first < top
            out = [q_id[a[keep]], queries.column("h").to_numpy()[a[keep]], v_id[b[keep]], score[keep]]
        return pa.table({name: pa.array(column) for name, column in zip(("query_id", "h", "vec_id", "score"), out)})

    return run


def _usable(vectors: DataFrame, id_column: str, vector: str) -> DataFrame:
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists("v", lambda x: x != 0)
    return vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull()).where(finite & some)


def nearest_neighbours(vectors: DataFrame, every: int = 50, top: int = 5, id_column: str = "vec_id", vector: str = "embedding", sample: int = SAMPLE) -> DataFrame:
    """For each row whose id is divisible by ``every``: ``query_id``, ``rank`` (from 1), ``vec_id`` and ``score``, the cosine.

    A row is no candidate of its own. Equal scores go by the smaller id. A vector
    that is null, zero or has a null or non-finite component takes no part, nor
    does one without an id. Rows with the same id and vector count once; with the
    same id and other vectors each asks for itself and is a candidate of the others.
    Only vectors of one width have a cosine: the most common one is searched by
    learned parts, every other as one part, whole. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    usable = _usable(vectors, id_column, vector)
    usable = usable.distinct()
    common = usable.groupBy(F.size("v").alias("w")).count().orderBy(F.desc("count"), "w").first()
    width = common.w if common else 0
    # equal vectors: the smallest ids suffice; a limit per group applies below the shuffle
    rank = F.row_number().over(W.partitionBy("v").orderBy("id"))
    rows = staged(usable.withColumn("copy", rank).where(F.col("copy") <= top + 1).select("id", "v"), "vectors")
    usual, unusual = F.size("v") == width, -F.size("v")
    chosen = rows.where(usual).orderBy(F.xxhash64("id"), "id").limit(sample).toArrow()
    if not chosen.num_rows:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    router = fit_router(_unit(_matrix(chosen.column("v"))))

    filed = "id long, v array<double>, parts array<int>"
    indexed = rows.where(usual).mapInArrow(_filed(router, 1), filed).select("id", "v", F.col("parts")[0].alias("part"))
    indexed = staged(indexed.union(rows.where(~usual).select("id", "v", unusual)), "index")
    # one row per part, of which there are at most sample / PART_SAMPLE
    held = np.zeros(router.parts, np.int64)
    for part, n in indexed.where("part >= 0").groupBy("part").count().collect():
        held[part] = n
    queries = usable.where(F.col("id") % every == 0)
    queries = queries.join(queries.groupBy("id").agg(F.count("*").alias("own")), "id").select("id", "v", "own")
    asked = queries.where(usual).mapInArrow(_asked(router, held, top), filed).select("id", "v", F.explode("parts").alias("part"))
    asked = asked.union(queries.where(~usual).select("id", "v", unusual))
    sizes = indexed.groupBy("part").agg(F.ceil(F.count("*") / ROWS).cast("int").alias("blocks"))
    n_queries = asked.groupBy("part").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("query_blocks"))
    blocks = F.broadcast(sizes.join(n_queries, "part"))
    own = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = asked.join(blocks, "part").select(F.col("part").alias("part"), own("query_blocks").alias("query_block"), all_of("blocks").alias("block"), "id", "v", F.xxhash64("v").alias("h"))
    right = indexed.join(blocks, "part").select(F.col("part").alias("part"), all_of("query_blocks").alias("query_block"), own("blocks").alias("block"), "id", "v")
    by = ("part", "query_block", "block")
    found = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(_best(top), "query_id long, h long, vec_id long, score double")
    order = F.row_number().over(W.partitionBy("query_id", "h").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", order).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")

"""Hard-negative mining: exact inner-product search by length buckets and coordinate pruning.

Vectors are rounded down to integers, so scores are exact. Rows stand in buckets
of similar length, each cut into blocks of bounded size by a hash of their ids.
A block keeps, for every coordinate of its rows' directions, a sorted list. To
find the rows that score at least a threshold with an anchor:

1. A bucket whose longest row cannot reach it is not visited at all.
2. Else the threshold, divided by both lengths, is a least cosine. The angle
   between the anchor and each axis then bounds the angle between a candidate
   and that axis, so each of the anchor's largest coordinates (its focus) gives a
   range of feasible values, a run of that coordinate's list.
3. The candidates of the shortest run that also lie in the other ranges are
   verified exactly. Anchors that no range narrows are multiplied with the whole
   block at once.

Positives come first: the block of the longest rows of each label gives every
anchor a threshold, the score of its last positive there, with which it visits
the label's other blocks. The lower end of the band below its positives is the
threshold for negatives. Anchors and rows meet in blocks of bounded size, each
keeps its best, and rankings per anchor merge them. Work is that of all anchors
with all rows, less what the bounds save: much on clustered vectors or lengths
that differ, little on directions that are spread evenly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from listflow.llm.common import small_batches, staged

#: Rows and anchors of a block.
ROWS, ANCHORS = 8192, 1024
#: Coordinates of an anchor whose ranges are intersected, and the most buckets of lengths.
FOCUS, BUCKETS = 4, 64
#: Scores that fit a double exactly.
EXACT = 1 << 53


class LengthBucket:
    """Rows of similar length, with a sorted list of the values of each coordinate of their directions."""

    def __init__(self, v: np.ndarray, norm: np.ndarray):
        self.v, self.floats, self.norm = v, v.astype(np.float64), norm
        self.longest = float(norm.max(initial=0.0))
        self.unit = self.floats / np.where(norm > 0, norm, 1)[:, None]
        self.order = np.argsort(self.unit, axis=0, kind="stable")
        self.lists = np.take_along_axis(self.unit, self.order, axis=0)

    def candidates(self, anchor: np.ndarray, norm: float, least: float | None) -> np.ndarray | None:
        """Rows that can score ``least`` with the anchor; None for all of them."""
        if least is None or least <= 0:
            return None
        if norm * self.longest * (1 + 1e-9) < least:
            return np.zeros(0, np.int64)
        cosine = least / (norm * self.longest) * (1 - 1e-9)
        own = anchor / norm
        focus = np.argsort(-np.abs(own), kind="stable")[:FOCUS]
        from_axis, spread = np.arccos(np.clip(own[focus], -1, 1)), np.arccos(min(cosine, 1.0))
        low = np.cos(np.minimum(from_axis + spread, np.pi)) - 1e-9
        high = np.cos(np.maximum(from_axis - spread, 0)) + 1e-9
        begin = [int(np.searchsorted(self.lists[:, f], x, side="left")) for f, x in zip(focus, low)]
        end = [int(np.searchsorted(self.lists[:, f], x, side="right")) for f, x in zip(focus, high)]
        shortest = int(np.argmin(np.subtract(end, begin)))
        if end[shortest] - begin[shortest] == len(self.v):
            return None
        found = self.order[begin[shortest] : end[shortest], focus[shortest]]
        for k, f in enumerate(focus):
            if k != shortest:
                value = self.unit[found, f]
                found = found[(value >= low[k]) & (value <= high[k])]
        return found

    def scores(self, anchors: np.ndarray, norms: np.ndarray, least: list[float | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each anchor, in no set order: its number, candidates and their exact scores."""
        exact = float(norms.max(initial=0.0)) * self.longest < EXACT
        whole = []
        floats = anchors.astype(np.float64)
        for i, limit in enumerate(least):
            found = self.candidates(floats[i], float(norms[i]), limit)
            if found is None or 2 * len(found) > len(self.v):
                whole.append(i)
            elif len(found):
                yield i, found, (self.floats[found] @ floats[i]).astype(np.int64) if exact else self.v[found] @ anchors[i]
        everything = np.arange(len(self.v))
        for k in range(0, len(whole), 128):
            some = whole[k : k + 128]
            scored = (floats[some] @ self.floats.T).astype(np.int64) if exact else anchors[some] @ self.v.T
            for i, s in zip(some, scored):
                yield i, everything, s


def _integers(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


def _first(score: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Places of the n largest scores, ties to the smaller id."""
    if len(score) > 4 * n:
        least = -np.partition(-score, n - 1)[n - 1]
        some = np.flatnonzero(score >= least)
        return some[np.lexsort((ids[some], -score[some]))[:n]]
    return np.lexsort((ids, -score))[:n]


def _own(ids: np.ndarray, rows: np.ndarray, found: np.ndarray, own_id: int, own: np.ndarray) -> int | None:
    """The place among ``found`` of a row that is the anchor's own."""
    for k in np.flatnonzero(ids[found] == own_id):
        if (rows[found[k]] == own).all():
            return int(k)
    return None


def _positives(n: int):
    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(3)]
        if anchors.num_rows and rows.num_rows:
            v, ids = _integers(rows.column("v")), rows.column("id").to_numpy()
            bucket = LengthBucket(v, rows.column("norm").to_numpy())
            a, key, own_id = _integers(anchors.column("v")), anchors.column("anchor").to_numpy(), anchors.column("id").to_numpy()
            for i, found, score in bucket.scores(a, anchors.column("norm").to_numpy(), anchors.column("least").to_pylist()):
                own = _own(ids, v, found, own_id[i], a[i])
                if own is not None:
                    found, score = np.delete(found, own), np.delete(score, own)
                best = _first(score, ids[found], n)
                for column, values in zip(out, (np.full(len(best), key[i]), ids[found[best]], score[best])):
                    column.append(values)
        return pa.table({name: pa.array(np.concatenate(c), pa.int64()) for name, c in zip(("anchor", "positive_id", "positive_score"), out)})

    return run


_FOUND = ("anchor", "number", "negative_id", "negative_score")


def _negatives(n: int):
    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in _FOUND]
        if anchors.num_rows and rows.num_rows:
            v, ids = _integers(rows.column("v")), rows.column("id").to_numpy()
            labels = np.unique(np.array(rows.column("label").to_pylist() + anchors.column("label").to_pylist()), return_inverse=True)[1]
            label, own_label = labels[: len(ids)], labels[len(ids) :]
            bucket = LengthBucket(v, rows.column("norm").to_numpy())
            a, key, bands = _integers(anchors.column("v")), anchors.column("anchor").to_numpy(), anchors.column("bands").to_pylist()
            for i, found, score in bucket.scores(a, anchors.column("norm").to_numpy(), anchors.column("least").to_pylist()):
                ok = (label[found] != own_label[i]) & (score >= min(b["low"] for b in bands[i])) & (score <= max(b["high"] for b in bands[i]))
                found, score = found[ok], score[ok]
                for band in bands[i]:
                    at = np.flatnonzero((score >= band["low"]) & (score <= band["high"]))
                    best = at[_first(score[at], ids[found[at]], n)]
                    for column, values in zip(out, (np.full(len(best), key[i]), np.full(len(best), band["number"]), ids[found[best]], score[best])):
                        column.append(values)
        return pa.table({name: pa.array(np.concatenate(c), pa.int64()) for name, c in zip(_FOUND, out)})

    return run


def _usable(vectors: DataFrame, id_column: str, vector: str, label: str, scale: int) -> DataFrame:
    """Rows that take part: ``id``, ``label``, ``width``, ``v`` (integers) and ``norm``."""
    plain = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(label).cast("string").alias("label"), F.col(vector).cast("array<double>").alias("v"))
    some = plain.where("id is not null and label is not null and v is not null").where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    whole = some.withColumn("v", F.transform("v", lambda x: F.floor(x * F.lit(float(scale))))).withColumn("width", F.size("v"))
    squares = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    whole = whole.withColumn("norm", F.sqrt(squares)).where(F.col("norm") < 2.0**31)
    # a vector of no components has the score of a zero
    return whole.withColumn("v", F.when(F.col("width") > 0, F.col("v")).otherwise(F.array(F.lit(0).cast("long"))))


def _spread(key: str, n: str):
    return F.pmod(F.xxhash64(key), F.col(n)).cast("int")


def _fresh(*names: str):
    """Columns under ids of their own: both sides of a co-group come from the same tables."""
    return [F.col(c).alias(c) for c in names]


def _each(n: str):
    return F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias(n[:-1])


def mine_negatives(vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 5, low: int = 80, scale: int = 256, id_column: str = "vec_id", vector: str = "embedding", label: str = "label", rows_per_block: int = ROWS) -> DataFrame:
    """Per anchor and positive, its hardest negatives: ``anchor_id``, ``positive_id``, ``rank``, ``negative_id`` and both scores.

    A component x counts as floor(``scale`` * x); a score is the inner product
    of two rows. Anchors are rows whose id is divisible by ``every``; their
    positives the ``positives`` best other rows of their label; negatives the
    ``negatives`` best rows of other labels that score at least ``low`` hundredths
    of the positive's score and no more than it. Ties go to the smaller id.

    Rows with a null id, label or vector or a null or non-finite component take
    no part, nor those whose inner product with themselves is 2**62 or more, as
    no long holds it. Vectors of different widths have no score. Repeated rows are
    rows: each repeated anchor returns its rows again, and a copy of an anchor can
    be its positive. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    usable = staged(_usable(vectors, id_column, vector, label, scale), "usable")
    # of equal rows of a label, only the smallest ids can be among the best
    copy = F.row_number().over(W.partitionBy("label", "v", "width").orderBy("id"))
    kept = usable.withColumn("copy", copy).where(F.col("copy") <= max(positives + 1, negatives)).drop("copy")
    n, cuts = kept.agg(F.count("*"), F.percentile_approx("norm", [k / BUCKETS for k in range(1, BUCKETS)], 1000)).first()
    step = max(1, BUCKETS // max(1, -(-n // rows_per_block)))
    cuts = sorted(set((cuts or [])[step - 1 :: step]))
    bucket = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col("norm"))) if cuts else F.lit(0)
    rows = staged(kept.withColumn("bucket", bucket), "rows")
    anchors = usable.where(F.col("id") % every == 0).groupBy("id", "label", "width", "v").agg(F.count("*").alias("copies"), F.min("norm").alias("norm"))
    anchors = staged(anchors.withColumn("anchor", F.monotonically_increasing_id()), "anchors")

    # positives: the longest rows of each label first, then what can still reach the last of those
    cells = rows.join(anchors.select("width", "label").distinct(), ["width", "label"], "left_semi").groupBy("width", "label", "bucket")
    cells = cells.agg(F.ceil(F.count("*") / rows_per_block).cast("int").alias("blocks"), F.max("norm").alias("longest"))
    cells = cells.withColumn("top", F.max("bucket").over(W.partitionBy("width", "label")))
    groups = anchors.groupBy("width", "label").agg(F.ceil(F.count("*") / ANCHORS).cast("int").alias("sides"))
    cells = staged(cells.join(groups, ["width", "label"]), "cells")
    by = ("width", "label", "bucket", "block", "side")
    placed = rows.join(cells.select("width", "label", "bucket", "blocks", "sides", "top"), ["width", "label", "bucket"])
    placed = placed.select(*_fresh("width", "label", "bucket", "top", "id", "v", "norm"), _spread("id", "blocks").alias("block"), _each("sides"))
    seeds = (F.col("bucket") == F.col("top")) & (F.col("block") == 0)
    asked = anchors.join(cells, ["width", "label"]).select(*_fresh("width", "label", "bucket", "top", "longest", "anchor", "id", "v", "norm"), _each("blocks"), _spread("anchor", "sides").alias("side"))
    shape = "anchor long, positive_id long, positive_score long"

    def meet(left: DataFrame, right: DataFrame) -> DataFrame:
        return staged(left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(_positives(positives), shape), "positives")

    first = meet(asked.where(seeds).withColumn("least", F.lit(None).cast("double")), placed.where(seeds))
    last = first.groupBy("anchor").agg(F.count("*").alias("n"), F.min("positive_score").cast("double").alias("least"))
    again = asked.where(~seeds).join(last, "anchor", "left").withColumn("least", F.when(F.col("n") >= positives, F.col("least"))).drop("n")
    again = again.where("least is null or least <= norm * longest * (1 + 1e-9)")
    found = first.union(meet(again, placed.where(~seeds)))
    order = F.row_number().over(W.partitionBy("anchor").orderBy(F.desc("positive_score"), "positive_id"))
    chosen = staged(found.withColumn("number", order).where(F.col("number") <= positives), "chosen")

    # negatives: the bands below the positives; a negative score has an empty one
    least = F.expr(f"{low} * (positive_score div 100) + ceil({low} * (positive_score % 100) / 100)").cast("long")
    bands = chosen.where("positive_score >= 0").groupBy("anchor").agg(F.collect_list(F.struct(F.col("number").cast("long").alias("number"), least.alias("low"), F.col("positive_score").alias("high"))).alias("bands"), F.min(least).cast("double").alias("least"))
    wanted = anchors.join(bands, "anchor")
    layers = rows.groupBy("width", "bucket").agg(F.ceil(F.count("*") / rows_per_block).cast("int").alias("blocks"), F.max("norm").alias("longest"))
    sides = wanted.groupBy("width").agg(F.ceil(F.count("*") / ANCHORS).cast("int").alias("sides"))
    layers = staged(layers.join(sides, "width"), "layers")
    near = wanted.join(layers, "width").where("least <= norm * longest * (1 + 1e-9)")
    left = near.select(*_fresh("width", "bucket", "anchor", "label", "v", "norm", "least", "bands"), _each("blocks"), _spread("anchor", "sides").alias("side"))
    right = rows.join(layers.select("width", "bucket", "blocks", "sides"), ["width", "bucket"]).select(*_fresh("width", "bucket", "id", "label", "v", "norm"), _spread("id", "blocks").alias("block"), _each("sides"))
    at = ("width", "bucket", "block", "side")
    met = left.groupBy(*at).cogroup(right.groupBy(*at)).applyInArrow(_negatives(negatives), "anchor long, number long, negative_id long, negative_score long")
    rank = F.row_number().over(W.partitionBy("anchor", "number").orderBy(F.desc("negative_score"), "negative_id"))
    best = met.withColumn("rank", rank).where(F.col("rank") <= negatives)
    told = best.join(chosen.withColumn("number", F.col("number").cast("long")), ["anchor", "number"]).join(anchors.select("anchor", F.col("id").alias("anchor_id"), "copies"), "anchor")
    told = told.withColumn("again", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return told.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def oracle(every: int = 100, low: int = 80) -> str:
    """SQL for the bound query, pair by pair."""
    return f"""
    WITH base AS (
      SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
             list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
      FROM embeddings
      WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    pairs AS (
      SELECT a.r, a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS alike, list_inner_product(a.v, b.v)::BIGINT AS score
      FROM base a JOIN base b ON a.r <> b.r WHERE a.vec_id % {every} = 0),
    positives AS (
      SELECT r, anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS k
      FROM pairs WHERE alike QUALIFY k <= 5)
    SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, n.vec_id AS negative_id, p.positive_score, n.score AS negative_score
    FROM positives p JOIN pairs n ON n.r = p.r AND NOT n.alike
      AND {low} * p.positive_score <= 100 * n.score AND n.score <= p.positive_score
    WINDOW w AS (PARTITION BY p.r, p.k ORDER BY n.score DESC, n.vec_id)
    QUALIFY row_number() OVER w <= 5"""

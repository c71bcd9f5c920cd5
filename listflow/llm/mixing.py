"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Each source is cut into blocks by a hash of its rows. A source's target, in
words, fixes which blocks it gives: whole rounds of all of them, then the first
of a permutation, then rows of one more block, so that what is taken is within
half a row of the target. The numbers of drawn blocks are the quotas at the root
of a tree over the output shards. Each node splits its quotas between its two
halves by one draw from the multivariate hypergeometric distribution, seeded by
the node, so every shard can find its own quotas alone and reruns agree. A
source's permuted draws are then dealt to the shards in disjoint runs, and each
shard is put in random order by itself.

Sources can be many, as with one per web host. Their order comes from a range
shuffle, the level up to which weights fill them from rounds of one aggregate, and
the tree splits groups of ``GROUP`` neighbouring sources first, then each group's
sources by themselves within the margins that it got, which is the same
distribution. So no task holds more than a group, or one number per group.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from listflow.llm.common import hidden, spread_rows, staged

BLOCKS = 1024
#: Sources whose quotas one task splits.
GROUP = 4096
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shard_quotas(quotas: np.ndarray, shards: int, shard: int, seed: int) -> np.ndarray:
    """The quotas of one leaf of the splitting tree."""
    low, high = 0, shards
    while high - low > 1:
        middle = (low + high) // 2
        draws = int(quotas.sum()) * (middle - low) // (high - low)
        left = np.random.default_rng([seed, low, high]).multivariate_hypergeometric(quotas, draws, method="marginals")
        quotas, low, high = (left, low, middle) if shard < middle else (quotas - left, middle, high)
    return quotas


def split_within(quotas: np.ndarray, margins: np.ndarray, seed: int, group: int, low: int = 0) -> np.ndarray:
    """Quotas by shard (rows) of one group of sources, where each shard's sum is given: the same tree below the group's margins."""
    if len(margins) == 1:
        return quotas[None, :]
    middle = len(margins) // 2
    rng = np.random.default_rng([seed, group, low, low + len(margins)])
    left = rng.multivariate_hypergeometric(quotas, int(margins[:middle].sum()), method="marginals")
    return np.concatenate((split_within(left, margins[:middle], seed, group, low), split_within(quotas - left, margins[middle:], seed, group, low + middle)))


def _group_margins(shards: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, quotas in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = shard_quotas(np.array([q["n"] for q in quotas], np.int64), shards, shard, seed)
                yield pa.record_batch([pa.array([shard] * len(own), pa.int32()), pa.array([q["grp"] for q in quotas], pa.int64()), pa.array(own, pa.int64())], names=["shard", "grp", "n"])

    return run


def _group_leaves(shards: int, seed: int):
    def run(quotas: pa.Table, margins: pa.Table) -> pa.Table:
        quotas, margins = quotas.sort_by("rank"), margins.sort_by("shard")
        rank, n = quotas.column("rank").to_numpy(), quotas.column("n").to_numpy()
        split = split_within(n, margins.column("n").to_numpy(), seed, int(quotas.column("grp")[0].as_py()))
        return pa.table({"shard": pa.array(np.repeat(np.arange(shards, dtype=np.int32), len(rank))), "rank": pa.array(np.tile(rank, shards)), "n": pa.array(split.ravel())})

    return run


def _source_targets(rows: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """``source``, ``rank``, ``source_size`` and ``target``: by weight, none above ``most`` times its size."""
    w = F.array(*[F.lit(float(x)) for x in weights])
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    # ranges of the order, numbered by what stands before them; written so that the numbers stay
    in_order = F.col("source").asc_nulls_last()
    ranges = staged(sizes.repartitionByRange(in_order).withColumn("part", F.spark_partition_id()), "mix-order")
    before = ranges.groupBy("part").agg(F.count("*").alias("held"))
    before = before.select("part", F.coalesce(F.sum("held").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    s = ranges.withColumn("place", F.row_number().over(W.partitionBy("part").orderBy(in_order))).join(before, "part")
    s = s.withColumn("rank", F.col("before") + F.col("place") - 1)
    s = s.withColumn("weight", F.get(w, (F.col("rank") % len(weights)).cast("int"))).withColumn("most", most * F.col("source_size"))
    s = staged(s.select("source", "rank", "source_size", "weight", "most"), "mix-ranked")
    # what the sources at their limit leave is shared anew by weight, until it lifts no other one to its limit
    total = s.agg(F.sum("source_size")).first()[0] or 0
    level, full = None, F.lit(False)
    while True:
        left = s.agg(F.sum(F.when(full, F.col("most")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight"))), F.count_if(full)).first()
        held = left[2]
        level = (share * total - left[0]) / left[1] if left[1] else None
        if level is None:
            break
        full = full | (F.lit(level) * F.col("weight") > F.col("most"))
        if s.where(full).count() == held:
            break
    target = F.col("most") if level is None else F.when(full, F.col("most")).otherwise(F.lit(level) * F.col("weight"))
    return s.select("source", "rank", "source_size", target.alias("target"))


def _position(epoch: Column, seed: int) -> Column:
    """A row's place in its block in one round."""
    return F.xxhash64("h", epoch, F.lit(seed))


def mix_plan(rows: DataFrame, shards: int, weights: Sequence[float], share: float, most: int, seed: int) -> DataFrame:
    """Per source and block: its source's sizes, and the draws (round, shard, and the last place taken where only part is)."""
    sources = staged(_source_targets(rows, weights, share, float(most)), "mix-sources")
    blocks = rows.groupBy("source", "block").agg(F.sum("size").alias("words"))
    b, s = blocks, sources.withColumnRenamed("source", "of")
    b = b.join(s, b["source"].eqNullSafe(s["of"])).drop("of")
    b = b.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(most - 1))))
    quota = F.least(F.greatest(F.col("target") - F.col("epoch") * F.col("source_size"), F.lit(0.0)), F.col("source_size").cast("double"))
    by = W.partitionBy("rank", "epoch").orderBy(F.xxhash64("rank", "block", "epoch", F.lit(seed)), "block")
    b = b.withColumn("quota", quota).withColumn("before", F.coalesce(F.sum("words").over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    # an empty block goes along with those before it, so that every round of a full source holds every row
    drawn = (F.col("quota") > 0) & (F.col("before") < F.col("quota")) | (F.col("quota") >= F.col("source_size")) & (F.col("target") > 0)
    b = staged(b.withColumn("drawn", drawn).withColumn("part", F.col("drawn") & (F.col("before") + F.col("words") > F.col("quota"))).withColumn("missing", F.col("quota") - F.col("before")), "mix-blocks")

    ends = b.where("part").select(F.col("source").alias("of"), F.col("block").alias("in"), "epoch", "missing")
    cut = rows.join(ends, rows["source"].eqNullSafe(ends["of"]) & (rows["block"] == ends["in"]))
    cut = cut.withColumn("place", _position(F.col("epoch"), seed))
    middle = F.sum("size").over(W.partitionBy("source", "epoch").orderBy("place").rangeBetween(W.unboundedPreceding, 0)) - F.col("size") / 2
    last = cut.withColumn("middle", middle).where("middle <= missing").groupBy("source", "block", "epoch").agg(F.max("place").alias("last"))
    last = last.select(F.col("source").alias("of"), F.col("block").alias("in"), F.col("epoch").alias("at"), "last")

    turn = W.partitionBy("rank").orderBy("epoch", F.xxhash64("rank", "block", "epoch", F.lit(seed)), "block")
    draws = b.where("drawn").withColumn("ordinal", F.row_number().over(turn).cast("long") - 1)
    quotas = draws.groupBy("rank").agg(F.count("*").alias("n")).withColumn("grp", F.expr(f"rank div {GROUP}"))
    groups = quotas.groupBy("grp").agg(F.sum("n").alias("n")).agg(F.sort_array(F.collect_list(F.struct("grp", "n"))).alias("quotas"))
    margins = groups.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "quotas").repartition("shard").mapInArrow(_group_margins(shards, seed), "shard int, grp long, n long")
    own = quotas.select(F.col("grp").alias("grp"), F.col("rank").alias("rank"), F.col("n").alias("n"))
    leaves = own.groupBy("grp").cogroup(margins.groupBy("grp")).applyInArrow(_group_leaves(shards, seed), "shard int, rank long, n long")
    run = W.partitionBy("rank").orderBy("shard")
    dealt = leaves.withColumn("to", F.sum("n").over(run)).where("n > 0").select("shard", "rank", F.explode(F.sequence(F.col("to") - F.col("n"), F.col("to") - 1)).alias("ordinal"))
    draws = draws.join(dealt, ["rank", "ordinal"]).join(last, draws["source"].eqNullSafe(last["of"]) & (draws["block"] == last["in"]) & (draws["epoch"] == last["at"]), "left")
    # part of a block with no place taken gives nothing
    draws = draws.where("not part or last is not null")
    taken = draws.groupBy("rank", "block").agg(F.collect_list(F.struct("epoch", "shard", F.when(F.col("part"), F.col("last")).alias("last"))).alias("draws"))
    whole = b.where("epoch = 0").select("source", "rank", "block", "source_size", "target")
    return whole.join(taken, ["rank", "block"], "left").select("source", "block", "source_size", "target", F.coalesce("draws", F.array().cast("array<struct<epoch:int,shard:int,last:bigint>>")).alias("draws"))


def _rows(spread: DataFrame, name: str, id_column: str, source: str, text: str) -> DataFrame:
    return spread.select(F.col(id_column).alias("doc_id"), F.col(source).cast("string").alias("source"), word_count(text).alias("size"), F.col(name).alias("h"), F.pmod(name, F.lit(BLOCKS)).cast("int").alias("block"))


def _with_draws(rows: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    p = plan.select(F.col("source").alias("of"), F.col("block").alias("in"), "source_size", "target", F.col("draws").alias("all"))
    met = rows.join(p, rows["source"].eqNullSafe(p["of"]) & (rows["block"] == p["in"])).drop("of", "in")
    mine = F.filter("all", lambda d: d["last"].isNull() | (F.xxhash64("h", d["epoch"], F.lit(seed)) <= d["last"]))
    return met.withColumn("draws", mine).drop("all")


def mix_counts(docs: DataFrame, shards: int = 64, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: int = 2, seed: int = 7, id_column: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """Per row: ``doc_id``, ``size``, ``source_size``, ``target``, ``taken`` and its shards.

    Sources in code point order, null last, weigh as ``weights`` in turn and
    share ``share`` times all words; none gets more than ``most`` times its own.
    A null or empty text has no words and nothing is taken of it. Rows that are
    wholly alike are numbered and drawn each for itself. An empty table gives no rows.
    """
    name = hidden(docs, "row")
    kept = docs.drop(*[c for c in docs.columns if c.lower() == "shard"])
    rows = staged(_rows(spread_rows(kept, name), name, id_column, source, text), "mix-rows")
    drawn = _with_draws(rows, mix_plan(rows, shards, weights, share, most, seed), seed)
    return drawn.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("draws")).alias("taken"), F.transform("draws", lambda d: d["shard"]).alias("shards"))


def mix(docs: DataFrame, shards: int = 64, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: int = 2, seed: int = 7, id_column: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """The mix itself: rows of ``docs``, each as often as drawn, with its shard, in random order within the shard.

    The added column ``shard`` replaces one of that name. See ``mix_counts``.
    """
    kept = docs.drop(*[c for c in docs.columns if c.lower() == "shard"])
    name, row = hidden(kept, "hash"), hidden(kept, "row")
    spread = spread_rows(kept, name)
    rows = staged(_rows(spread, name, id_column, source, text), "mix-rows")
    plan = mix_plan(rows, shards, weights, share, most, seed)
    full = spread.select(F.struct(*kept.columns).alias(row), F.col(source).cast("string").alias("source"), F.col(name).alias("h"), F.pmod(name, F.lit(BLOCKS)).cast("int").alias("block"))
    drawn = _with_draws(full, plan, seed).withColumn("draw", F.explode("draws"))
    placed = drawn.select(row, F.col("draw.shard").alias("shard"), F.xxhash64("h", "draw.epoch", "draw.shard", F.lit(seed + 1)).alias("place"))
    return placed.repartition(shards, "shard").sortWithinPartitions("shard", "place").select(f"{row}.*", "shard")

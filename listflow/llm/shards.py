"""Sharding by extendible hashing, with DataFrame operations only.

A directory of hash prefixes grows where it must: a bucket above the byte limit
splits on the next bit of its rows' hashes, all others stay as they are. The
sizes of all prefixes up to some depth come from one aggregate over cells of
that depth; a bucket is a shard if it fits and the bucket above it does not.
Cells that are still too large are taken deeper by a few bits, alone.

Rows that are alike in id and text are counted first and hashed with the number
of the copy, so copies spread over shards as other rows do.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from listflow.llm.common import staged

BITS = 60
#: Bits beyond those that even splitting would take, and bits of each later round.
SPARE, MORE = 4, 8


def hashed_rows(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``copy``, ``n_bytes`` and a hash of ``BITS`` bits per row."""
    rows = docs.select(F.col(id_column).alias("doc_id"), F.coalesce(F.octet_length(F.col(text).cast("string")), F.lit(0)).cast("long").alias("n_bytes"), F.coalesce(F.md5(F.col(text).cast("string").cast("binary")), F.lit("")).alias("digest"))
    alike = rows.groupBy("doc_id", "n_bytes", "digest").agg(F.count("*").alias("n"))
    copies = alike.select("doc_id", "n_bytes", "digest", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("copy"))
    key = F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "digest", F.col("copy").cast("string"))
    h = F.conv(F.substring(F.md5(key.cast("binary")), 1, BITS // 4), 16, 10).cast("long")
    return copies.select("doc_id", "copy", "n_bytes", h.alias("h"))


def extendible_shards(docs: DataFrame, limit: int = 128 << 20, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``doc_id``, ``copy``, ``n_bytes``, ``shard`` (its bits), ``depth``, ``shard_bytes`` and ``shard_rows``.

    No shard has more than ``limit`` bytes unless it is one row, or rows whose
    hashes agree in all bits. A null text has no bytes. Rows alike in id and text
    are told apart by ``copy`` (from 1). With few bytes there is one shard, named
    by no bits. An empty table gives no rows.
    """
    left = staged(hashed_rows(docs, id_column, text), "shard-rows")
    total = left.agg(F.sum("n_bytes")).first()[0] or 0
    done = None
    low, high = 0, min(BITS, max(0, math.ceil(math.log2(max(total, 1) / limit))) + SPARE)
    while True:
        cell = F.shiftright("h", BITS - high)
        cells = left.groupBy(cell.alias("cell")).agg(F.sum("n_bytes").alias("b"), F.count("*").alias("n"))
        above = cells.select("cell", "b", "n", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("depth"))
        prefix = F.expr(f"shiftright(cell, {high} - depth)")
        buckets = above.groupBy("depth", prefix.alias("prefix")).agg(F.sum("b").alias("shard_bytes"), F.sum("n").alias("shard_rows"))
        fits = (F.col("shard_bytes") <= limit) | (F.col("shard_rows") == 1) | (F.col("depth") == BITS)
        buckets = staged(buckets.withColumn("fits", fits), "buckets")
        large = buckets.where("not fits").select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("parent"))
        shards = buckets.where("fits").withColumn("parent", F.shiftright("prefix", 1))
        shards = shards.where(F.col("depth") == low).unionByName(shards.where(F.col("depth") > low).join(large, ["depth", "parent"], "left_semi"))
        of_cell = above.select("cell", "depth", prefix.alias("prefix")).join(shards.select("depth", "prefix", "shard_bytes", "shard_rows"), ["depth", "prefix"])
        bits = F.when(F.col("depth") == 0, "").otherwise(F.lpad(F.bin("prefix"), F.col("depth").cast("int"), F.lit("0")))
        mine = left.withColumn("cell", cell).join(of_cell, "cell").select("doc_id", "copy", "n_bytes", bits.alias("shard"), F.col("depth").cast("int").alias("depth"), "shard_bytes", "shard_rows")
        done = mine if done is None else done.unionByName(mine)
        over = buckets.where(~F.col("fits") & (F.col("depth") == high)).select(F.col("prefix").alias("cell"))
        if not over.take(1):
            return done
        left = staged(left.withColumn("cell", cell).join(over, "cell", "left_semi").drop("cell"), "shard-rows")
        low, high = high + 1, min(BITS, high + MORE)


def oracle(limit: int) -> str:
    """The same by sizes of all prefixes of all rows."""
    return f"""
    WITH r AS (SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes, coalesce(md5(text), '') AS digest FROM documents),
    c AS (SELECT *, row_number() OVER (PARTITION BY doc_id, n_bytes, digest) AS copy FROM r),
    h AS (SELECT doc_id, copy, n_bytes, ('0x' || substr(md5(concat_ws('|', coalesce(doc_id::VARCHAR, ''), digest, copy::VARCHAR)), 1, {BITS // 4}))::BIGINT AS h FROM c),
    b AS (SELECT d, h >> ({BITS} - d) AS prefix, sum(n_bytes)::BIGINT AS shard_bytes, count(*) AS shard_rows FROM h, (SELECT unnest(range({BITS + 1}))::INT AS d) GROUP BY 1, 2),
    f AS (SELECT h.doc_id, h.copy, h.n_bytes, h.h, min(d) AS depth FROM h JOIN b ON b.prefix = h.h >> ({BITS} - d) AND (shard_bytes <= {limit} OR shard_rows = 1 OR d = {BITS}) GROUP BY ALL)
    SELECT f.doc_id, f.copy, f.n_bytes, CASE WHEN depth = 0 THEN '' ELSE lpad(bin(prefix), depth, '0') END AS shard, depth, shard_bytes, shard_rows
    FROM f JOIN b ON b.d = f.depth AND b.prefix = f.h >> ({BITS} - f.depth)
    """

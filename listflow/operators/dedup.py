"""Dedup keys, first-seen rows and per-key counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from listflow.functions.text import key_hash
from listflow.operators.matching import top_per_group


def add_key(
    df: DataFrame,
    parts: tuple[str, ...] = ("company_name", "title", "location_city"),
    raw: tuple[str, ...] = (),
    day: str | None = None,
    name: str = "dedup_hash",
) -> DataFrame:
    """Add the dedup key.

    The default has no date, so a listing that is posted again keeps its key
    (an empty fourth part stands for the date). ``day`` adds the posted day,
    ``raw`` adds parts such as the URL without normalization.
    """
    cols = [F.col(p) for p in parts]
    if day is not None:
        cols.append(F.date_format(F.col(day), "yyyy-MM-dd"))
    elif not raw:
        cols.append(F.lit(""))
    return df.withColumn(name, key_hash(*cols, raw=tuple(F.col(r) for r in raw)))


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    return top_per_group(df, keys, order, 1)


def duplicates_per_key(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows and surplus rows per key; counted before the shuffle."""
    n = F.count("*")
    return df.groupBy(*keys).agg(n.alias("n_rows"), (n - 1).alias("n_duplicates"))


def union_sources(df: DataFrame, keys: list[str], source: str, name: str = "n_sources") -> DataFrame:
    """Number of distinct sources per key.

    ``(key, source)`` pairs are reduced first, so a hot key moves one row per
    source and task.
    """
    return df.select(*keys, source).distinct().groupBy(*keys).agg(F.count(source).alias(name))


def with_key_summary(df: DataFrame, keys: list[str], order: list[str], source: str) -> DataFrame:
    """First row of each key (lowest ``order``) with the key's row, duplicate and source counts.

    One pass: each ``(key, source)`` is reduced to its first row and a count
    before the shuffle, then the sources of a key are combined.
    """
    rest = [c for c in df.columns if c not in (*keys, *order, source)]
    if len(order) == 1 and not rest:
        # A plain minimum keeps the hash aggregate; a struct needs a sorted one.
        per_source = df.groupBy(*keys, source).agg(F.count("*").alias("_n"), F.min(order[0]).alias("_first"))
        per_key = per_source.groupBy(*keys).agg(
            F.min("_first").alias(order[0]), F.sum("_n").alias("n_rows"), F.count(source).alias("n_sources")
        )
        return per_key.withColumn("n_duplicates", F.col("n_rows") - 1)
    row = F.struct(*order, *rest)
    per_source = df.groupBy(*keys, source).agg(F.count("*").alias("_n"), F.min(row).alias("_row"))
    per_key = per_source.groupBy(*keys).agg(
        F.sum("_n").alias("n_rows"), F.count(source).alias("n_sources"), F.min("_row").alias("_row")
    )
    return per_key.select(*keys, "_row.*", "n_rows", "n_sources", (F.col("n_rows") - 1).alias("n_duplicates"))


def unseen_links(df: DataFrame, page: str, href: str, pos: str) -> DataFrame:
    """First use of each link on a page; empty links are dropped."""
    filled = df.where(F.coalesce(F.col(href), F.lit("")) != "")
    return top_per_group(filled, [page, href], [F.col(pos)], 1)

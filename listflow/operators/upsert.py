"""Upserts by key: ``(stored, incoming, as_of) -> new snapshot``.

Policies

* ``merge``      stored values win, blanks are filled, lists are united
* ``touch``      a match only renews ``updated_at``, ``last_seen_at``, ``is_active``
* ``overwrite``  supplied values replace stored ones

Incoming rows are folded to one per key first. Scalars fold with ``min_by`` and
lists with ``collect_set`` over distinct elements, both of which combine before
the shuffle, so a key with very many incoming rows costs no single task.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F, types as T

from listflow.functions.dates import as_timestamp
from listflow.functions.text import strip
from listflow.operators.matching import is_small

#: Rows of a folded batch that may be broadcast, if their bytes allow it.
MAX_BATCH_ROWS = 100_000
KEEP = ("id", "created_at")


def _arrays(df: DataFrame, cols: list[str]) -> list[str]:
    """The lists of tags, which are united. Other arrays, such as vectors, are one value like a scalar."""
    kinds = {f.name: f.dataType for f in df.schema}
    return [c for c in cols if isinstance(kinds[c], T.ArrayType) and isinstance(kinds[c].elementType, T.StringType)]


def _is_string(df: DataFrame, col: str) -> bool:
    return isinstance(df.schema[col].dataType, T.StringType)


def _filled(df: DataFrame, col: str) -> Column:
    """Not null, not blank text, not an empty list. False and 0 are values."""
    c = F.col(col)
    if isinstance(df.schema[col].dataType, T.ArrayType):
        return c.isNotNull() & (F.size(c) > 0)
    if _is_string(df, col):
        return c.isNotNull() & (strip(c) != "")
    return c.isNotNull()


def _list_or_set(first: Column, united: Column, lists: Column) -> Column:
    """One list alone stays as it is; two or more become one sorted set."""
    return F.when(lists > 1, united).otherwise(first)


def _elements(name: str) -> Column:
    """A list column as an array of ``(list name, element)``."""
    values = F.coalesce(F.col(name), F.array().cast("array<string>"))
    return F.transform(values, lambda x: F.struct(F.lit(name).alias("list"), x.cast("string").alias("element")))


def fold_incoming(incoming: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key: first filled value of each scalar, union of each list."""
    cols = [c for c in incoming.columns if c not in (key, order)]
    lists = _arrays(incoming, cols)
    aggs = []
    for c in cols:
        first = F.min_by(c, F.when(_filled(incoming, c), F.col(order)))
        aggs.append(F.coalesce(first, F.min_by(c, order)).alias(c))
        if c in lists:
            aggs.append(F.count(c).alias(f"_n_{c}"))
    folded = incoming.groupBy(key).agg(*aggs, F.count("*").alias("_batch_rows"))
    if not lists:
        return folded
    elements = F.concat(*[_elements(c) for c in lists])
    sets = (
        incoming.select(key, F.explode(elements).alias("_e"))
        .select(key, "_e.list", "_e.element")
        .distinct()
        .groupBy(key)
        .agg(
            *[
                F.array_sort(F.collect_set(F.when(F.col("list") == c, F.col("element")))).alias(f"_set_{c}")
                for c in lists
            ]
        )
    )
    joined = folded.join(sets, key, "left")
    for c in lists:
        united = _list_or_set(F.col(c), F.coalesce(F.col(f"_set_{c}"), F.col(c)), F.col(f"_n_{c}"))
        joined = joined.withColumn(c, united)
    return joined.drop(*[f"_set_{c}" for c in lists], *[f"_n_{c}" for c in lists])


def _merged(c: str, stored: DataFrame, lists: list[str], sources: str) -> Column:
    s, n = F.col(f"s.{c}"), F.col(f"n.{c}")
    if c in lists:
        empty = F.array().cast(stored.schema[c].dataType)
        union = F.array_sort(F.array_union(F.coalesce(s, empty), F.coalesce(n, empty)))
        if c == sources:
            return union
        both = s.isNotNull() & n.isNotNull() & (F.size(s) > 0)
        return F.when(both, union).otherwise(
            F.when(F.coalesce(F.size(s), F.lit(0)) > 0, s).otherwise(F.coalesce(n, s))
        )
    if _is_string(stored, c):
        # A filled new value replaces a blank; two blanks leave the stored one.
        use_new = (F.coalesce(strip(s), F.lit("")) == "") & (F.coalesce(strip(n), F.lit("")) != "")
        return F.when(use_new, n).otherwise(s)
    if isinstance(stored.schema[c].dataType, T.ArrayType):
        return F.when(F.size(s) > 0, s).otherwise(F.coalesce(n, s))
    return F.coalesce(s, n)


def _matched_columns(
    policy: str, stored: DataFrame, shared: list[str], key: str, now: Column, sources: str
) -> dict[str, Column]:
    lists = _arrays(stored, [c for c in shared if c != key])
    out: dict[str, Column] = {}
    for c in stored.columns:
        s = F.col(f"s.{c}")
        if c == key or c not in shared or (policy != "overwrite" and c in KEEP):
            out[c] = s
        elif policy == "merge":
            out[c] = _merged(c, stored, lists, sources)
        elif policy == "overwrite":
            out[c] = F.coalesce(F.col(f"n.{c}"), s)
        else:
            out[c] = s
    renewed = {"merge": ["updated_at"], "touch": ["updated_at", "last_seen_at"], "overwrite": []}[policy]
    for c in renewed:
        if c in out:
            out[c] = now
    if policy == "touch" and "is_active" in out:
        out["is_active"] = F.lit(True)
    return out


def _inserted_columns(policy: str, stored: DataFrame, shared: list[str], key: str, now: Column) -> dict[str, Column]:
    out = {
        f.name: F.col(f"n.{f.name}") if f.name in shared or f.name == key else F.lit(None).cast(f.dataType)
        for f in stored.schema
    }
    stamps = {
        "merge": ["created_at", "updated_at"],
        "touch": ["last_seen_at"],
        "overwrite": ["created_at", "updated_at"],
    }[policy]
    for c in stamps:
        if c in out:
            out[c] = F.coalesce(out[c], now) if policy == "overwrite" else now
    if policy == "touch":
        # Created and updated times come with the row when the feed supplies them.
        for c in ("created_at", "updated_at"):
            if c in out:
                out[c] = F.coalesce(out[c], now)
        if "is_active" in out:
            again = F.col("n._batch_rows") > 1
            out["is_active"] = F.when(again, F.lit(True)).otherwise(out["is_active"])
    return out


def fold_for_policy(incoming: DataFrame, policy: str, key: str, order: str) -> DataFrame:
    """Fold a batch as the policy would apply its rows one after another."""
    if policy == "merge":
        return fold_incoming(incoming, key, order)
    cols = [c for c in incoming.columns if c not in (key, order)]
    if policy == "touch":
        first = F.min_by(F.struct(*cols), F.col(order)).alias("_row")
        folded = incoming.groupBy(key).agg(first, F.count("*").alias("_batch_rows"))
        return folded.select(key, "_row.*", "_batch_rows")
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in cols]
    return incoming.groupBy(key).agg(*last, F.count("*").alias("_batch_rows"))


def upsert(
    stored: DataFrame,
    incoming: DataFrame,
    as_of: "Column | datetime | str",
    policy: str = "merge",
    key: str = "dedup_hash",
    order: str = "seq",
    sources: str = "source_platforms",
    small_batch: bool = False,
    with_action: bool = False,
    only_changes: bool = False,
) -> DataFrame:
    """The new snapshot: every stored row, changed where matched, plus the new rows.

    ``stored`` has one row per key. ``incoming`` may have many, in the order of
    ``order``. With ``small_batch`` the folded batch is written once to the shared
    folder and measured there; if its rows and bytes are few it is broadcast and
    the stored table is not shuffled. Otherwise both sides meet in one full outer
    join on the key. The results are equal.
    ``with_action`` adds ``action``: inserted, updated or kept. ``only_changes``
    leaves the kept rows out, for a change log instead of a new snapshot.
    """
    now = as_timestamp(as_of)
    batch = fold_for_policy(incoming.where(F.col(key).isNotNull()), policy, key, order)
    if small_batch:
        from listflow.sources.tables import staged

        batch = staged(batch, "folded")
        small_batch = is_small(batch, MAX_BATCH_ROWS)
    shared = [c for c in batch.columns if c in stored.columns]
    matched = _matched_columns(policy, stored, shared, key, now, sources)
    inserted = _inserted_columns(policy, stored, shared, key, now)
    s, n = stored.alias("s"), batch.alias("n")
    on = F.col(f"s.{key}") == F.col(f"n.{key}")

    if not small_batch:
        both = s.join(n, on, "right_outer" if only_changes else "full_outer")
        is_new, is_kept = F.col(f"s.{key}").isNull(), F.col(f"n.{key}").isNull()
        cols = [
            F.when(is_kept, F.col(f"s.{c}")).when(is_new, inserted[c]).otherwise(matched[c]).alias(c)
            for c in stored.columns
        ]
        action = F.when(is_kept, "kept").when(is_new, "inserted").otherwise("updated")
        return both.select(*cols, *([action.alias("action")] if with_action else []))

    renewed = s.join(F.broadcast(n), on, "inner" if only_changes else "left")
    is_kept = F.col(f"n.{key}").isNull()
    old_rows = renewed.select(
        *[F.when(is_kept, F.col(f"s.{c}")).otherwise(matched[c]).alias(c) for c in stored.columns],
        *([F.when(is_kept, "kept").otherwise("updated").alias("action")] if with_action else []),
    )
    # Keys of the batch that are stored: one narrow scan, again no shuffle of it.
    known = stored.select(key).join(F.broadcast(batch.select(key)), key, "left_semi")
    fresh = batch.join(known, key, "left_anti").alias("n")
    new_rows = fresh.select(
        *[inserted[c].alias(c) for c in stored.columns],
        *([F.lit("inserted").alias("action")] if with_action else []),
    )
    return old_rows.unionByName(new_rows)


def upsert_counts(result: DataFrame) -> DataFrame:
    """Rows per action of an :func:`upsert` made with ``with_action``."""
    return result.groupBy("action").agg(F.count("*").alias("n"))


def update_where(df: DataFrame, condition: Column, values: dict[str, Column]) -> DataFrame:
    """Set columns where the condition is true; null counts as false."""
    hit = F.coalesce(condition, F.lit(False))
    return df.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in values.items()})


def delete_where(df: DataFrame, condition: Column) -> DataFrame:
    """Drop rows where the condition is true; null keeps the row."""
    return df.where(~F.coalesce(condition, F.lit(False)))


def mark_unique(stored: DataFrame, incoming: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Incoming rows with ``accepted``: the key is free and this is its first row.

    ``order`` must be unique within a key. A key with very many rows is reduced
    before the shuffle and its join is left to the skew handling.
    """
    order_key = F.struct(*order)
    first = incoming.groupBy(*keys).agg(F.min(order_key).alias("_first"))
    taken = stored.select(*keys).distinct().withColumn("_taken", F.lit(True))
    marked = incoming.join(first.join(taken, keys, "left"), keys)
    ok = F.col("_taken").isNull() & (order_key == F.col("_first"))
    return marked.select(*incoming.columns, ok.alias("accepted"))

"""Stored alerts: which new listings fit which saved filters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from listflow.functions import fixed_values as fv
from listflow.functions.dates import as_timestamp
from listflow.functions.rules import lookup
from listflow.operators.matching import is_small

EQUAL = [
    "remote_type", "experience_level", "job_type", "company_type", "vc_backer",
    "visa_sponsorship", "relocation_support",
]
MAX_BROADCAST_FILTERS = 20_000
#: Alerts up to which those of a filter are looked up in memory; beyond, they are joined by a shuffle.
MAX_BROADCAST_ALERTS, MAX_BROADCAST_ALERT_BYTES = 2_000_000, 256 << 20
#: Pairs of alerts and listings, fitting or not, that one task answers for.
TASK_PAIRS = 1 << 26
#: Pairs of filters and listings that one task tests at most.
TASK_TESTS = 1 << 30
MAX_TASKS = 20_000
#: From so many alerts a filter on, a filter's pairs are made from blocks of its listings.
BLOCK_ALERTS = 8
#: Listings, fitting or not, from which a block is gathered at most.
BLOCK_LISTINGS = 16_384
#: Listings of a block through which one alert goes before the next one does.
CHUNK = 256
#: What a filter asks of a listing besides its key.
READS = [
    *EQUAL, "title", "company_name", "description", "location_city", "location_country",
    "salary_min", "salary_max", "tech_stack", "source_platforms", "posted_date",
]
_LOWER = ["title", "company_name", "description", "location_city", "location_country"]


def _set(col: Column) -> Column:
    return F.coalesce(F.nullif(col.cast("string"), F.lit("")), F.lit(None).cast("string"))


def _key(value_of, mask: int) -> Column:
    used = [f for i, f in enumerate(EQUAL) if mask >> i & 1]
    return F.concat_ws("\x1f", F.lit(str(mask)), *[value_of(f) for f in used])


def _mask() -> Column:
    bits = [F.when(_set(F.col(f"f.{c}")).isNotNull(), 1 << i).otherwise(0) for i, c in enumerate(EQUAL)]
    return reduce(lambda a, b: a + b, bits)


def _terms(filters: DataFrame) -> DataFrame:
    """What the tests ask of a filter, worked out once for each; null where it is unset."""
    place, period = F.col("f.location"), F.col("f.posted_within")
    days = F.coalesce(
        lookup(period, {k: str(v) for k, v in fv.POSTED_WITHIN_DAYS.items()}).cast("int"),
        F.lit(fv.POSTED_WITHIN_DEFAULT_DAYS),
    )
    tags = F.coalesce(F.col("f.tech_stack"), F.array().cast("array<string>"))
    return filters.withColumns({
        "_q": F.lower(_set(F.col("f.q"))), "_place": F.lower(_set(place)), "_alias": lookup(F.lower(place), fv.LOCATION_ALIASES),
        "_tags": F.when(F.size(tags) > 0, tags), "_source": _set(F.col("f.source")),
        "_days": F.when(_set(period).isNotNull(), days),
    })


def _lowered(listings: DataFrame) -> DataFrame:
    return listings.withColumns({f"_lower_{c}": F.lower(F.col(c)) for c in _LOWER})


def _residual(as_of) -> Column:
    """The filters that are not equalities, the cheap ones first; an unset one passes."""

    def inside(column: str, term: str) -> Column:
        return F.coalesce(F.contains(F.col(f"_lower_{column}"), F.col(term)), F.lit(False))

    low, high = F.col("f.salary_min"), F.col("f.salary_max")
    tests = [
        F.coalesce(low, F.lit(0.0)).eqNullSafe(0.0) | (F.col("salary_min") >= low),
        F.coalesce(high, F.lit(0.0)).eqNullSafe(0.0) | (F.col("salary_max") <= high),
        F.col("_days").isNull() | (F.col("posted_date") >= as_timestamp(as_of) - F.make_dt_interval(days=F.col("_days"))),
        F.col("_source").isNull() | F.array_contains(F.col("source_platforms"), F.col("_source")),
        F.col("_tags").isNull() | (F.size(F.array_except("_tags", F.col("tech_stack"))) == 0),
        F.col("_place").isNull() | inside("location_city", "_place") | inside("location_country", "_place")
        | F.coalesce(F.col("location_country") == F.col("_alias"), F.lit(False)),
        F.col("_q").isNull() | inside("title", "_q") | inside("company_name", "_q") | inside("description", "_q"),
    ]
    return reduce(lambda a, b: a & b, tests)


def match_alerts(listings: DataFrame, alerts: DataFrame, as_of, key: str = "id", max_broadcast: int = MAX_BROADCAST_FILTERS) -> DataFrame:
    """Pairs ``(alert_id, user_id, listing)`` of active alerts and the listings that fit.

    Alerts with equal filters are matched once; a listing goes on with the short
    number of a filter, its place among all as text, not with the filter. The equality facets of a filter
    become a hash-join key, and a listing is expanded to the facet combinations
    in use (at most 2^7), so no pair is formed that differs in one of them.

    Where many alerts share a filter, its listings are gathered in blocks, and
    each alert goes through a block: what crosses the network grows with the
    filters, and pairs written in this order take a fraction of the bytes, as an
    alert stands in a run and the same few listings come again with the next.
    """
    live = alerts.where("is_active").select(F.col("id").alias("alert_id"), "user_id", F.col("filters").alias("f"))
    filters = live.groupBy("f").agg(F.count("*").alias("_owners")).withColumn("_mask", _mask())
    masks, n_filters, n_alerts = filters.agg(F.sort_array(F.collect_set("_mask")), F.count("*"), F.sum("_owners")).first()
    if not masks:
        return live.select("alert_id", "user_id").limit(0).join(listings.select(key).limit(0), F.lit(False))
    filter_key = reduce(
        lambda acc, m: acc.when(F.col("_mask") == m, _key(lambda f: _set(F.col(f"f.{f}")), m)),
        masks[1:],
        F.when(F.col("_mask") == masks[0], _key(lambda f: _set(F.col(f"f.{f}")), masks[0])),
    )
    keyed = filters.withColumn("_key", filter_key)
    listing_keys = F.array(
        *[
            F.when(
                reduce(
                    lambda a, b: a & b,
                    [F.col(f).isNotNull() for i, f in enumerate(EQUAL) if m >> i & 1],
                    F.lit(True),
                ),
                _key(lambda f: F.col(f).cast("string"), m),
            )
            for m in masks
        ]
    )

    def spread(rows: DataFrame) -> DataFrame:
        return _lowered(rows).withColumn("_key", F.explode(F.array_compact(listing_keys)))

    if is_small(keyed, max_broadcast):
        # The filters are few here, so one task may number them; equal numbers on every run.
        numbered = keyed.withColumn("_filter", F.row_number().over(Window.orderBy(F.to_json("f"))))
        numbers = numbered.select("_filter", F.to_json("f").alias("_text"))
        owners = live.withColumn("_text", F.to_json("f")).join(F.broadcast(numbers), "_text").select("_filter", "alert_id", "user_id")
        if is_small(owners, MAX_BROADCAST_ALERTS, MAX_BROADCAST_ALERT_BYTES):
            owners = F.broadcast(owners)
        parts = listings.groupBy(F.spark_partition_id()).count()
        n_listings, most = (n or 0 for n in parts.agg(F.sum("count"), F.max("count")).first())
        if most * n_filters > TASK_TESTS:
            # Tests grow with the product of both tables, so they and not the input's partitions say how many tasks make them.
            listings = listings.repartition(min(-(-n_listings * n_filters // TASK_TESTS), MAX_TASKS), key)
        hits = spread(listings).join(F.broadcast(_terms(numbered)), "_key").where(_residual(as_of))
        if n_alerts >= BLOCK_ALERTS * n_filters:
            # As many blocks and tasks as the pairs ask for, so that no block of a filter that most alerts share is too much for one.
            blocks = F.greatest(F.lit(-(-n_listings // BLOCK_LISTINGS)), F.ceil(F.lit(float(n_listings)) * F.col("_owners") / TASK_PAIRS))
            tasks = max(1, min(-(-n_listings * n_alerts // TASK_PAIRS), MAX_TASKS))
            hits = hits.select(key, "_filter", F.pmod(F.xxhash64(key), F.greatest(blocks, F.lit(1))).alias("_block"))
            gathered = hits.repartition(tasks, "_filter", "_block").groupBy("_filter", "_block").agg(F.collect_list(F.struct(key)).alias("_all"))
            starts = F.sequence(F.lit(1), F.size("_all"), F.lit(CHUNK))
            gathered = gathered.select("_filter", F.explode(F.transform(starts, lambda i: F.slice("_all", i, CHUNK))).alias("_listings"))
            return gathered.join(owners, "_filter").select("alert_id", "user_id", F.inline("_listings"))
        hits = hits.select(key, "_filter")
    else:
        # Filters without an equality facet fit every listing's empty key. They
        # go in broadcast blocks; the rest is a shuffled hash or merge join.
        keys, keyed = spread(listings), _terms(keyed)
        wide = keyed.where("_mask = 0")
        blocks = -(-wide.count() // max_broadcast)
        parts = [keys.join(keyed.where("_mask > 0"), "_key").where(_residual(as_of))]
        for b in range(blocks):
            block = wide.where(F.pmod(F.xxhash64("f"), F.lit(blocks)) == b)
            parts.append(keys.join(F.broadcast(block), "_key").where(_residual(as_of)))
        hits = reduce(DataFrame.unionByName, parts).select(key, F.to_json("f").alias("_filter"))
        owners = live.select("alert_id", "user_id", F.to_json("f").alias("_filter"))
    return hits.join(owners, "_filter").select("alert_id", "user_id", key)

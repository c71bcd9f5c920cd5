"""The package's whole jobs, composed from the operators."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from listflow.functions import classify as C, fixed_values as fv
from listflow.functions.dates import as_timestamp, parse_date
from listflow.functions.rules import lookup, term_array
from listflow.functions.text import first_sentence, flat_text, strip, text_or_empty
from listflow.operators.dedup import add_key, first_per_key
from listflow.operators.enrich import with_ats, with_bulk_ats
from listflow.operators.lifecycle import expire, recover
from listflow.operators.quality import insert_verdict
from listflow.operators.search import SearchParams, search_page
from listflow.operators.upsert import upsert
from listflow.schemas import LISTINGS, align_to_schema
from listflow.sources.boards import OTHER_SOURCES, REGIONAL_SOURCES, html_board_rows, json_board_rows, source_rank
from listflow.sources.feeds import FEEDS, enrich, load_feed, normalize_records, parse_with_errors, read_sources, union_feeds
from listflow.sources.tables import staged


def _with_arrival(parts: list[tuple[int, DataFrame]]) -> DataFrame:
    """The union of enriched rows that have a title, with a unique ``seq``."""
    rows = union_feeds(parts).where(F.coalesce(F.col("title"), F.lit("")) != "")
    # Arrival order: source priority, then the content itself, so it is stable. Rows that tie are alike in every column.
    shown = [F.to_json(F.struct(F.col(c))) for c in sorted(rows.columns) if c != "source_rank"]
    seq = F.struct("source_rank", F.coalesce("apply_url", F.lit("")), F.xxhash64(F.coalesce("description", F.lit(""))), F.sha2(F.concat(*shown), 256))
    return rows.withColumn("seq", seq)


def ingest_feeds(payloads: dict[str, DataFrame], as_of) -> DataFrame:
    """Union of all feeds' enriched rows in priority order, with a unique ``seq``.

    ``payloads`` maps a feed name to a DataFrame of payload text with the
    column ``payload``. Rows without a title are dropped.
    """
    return _with_arrival([(rank, load_feed(payloads[n], f, "payload", as_of)) for rank, (n, f) in enumerate(FEEDS.items()) if n in payloads])


def ingest_with_errors(payloads: dict[str, DataFrame], as_of) -> tuple[DataFrame, DataFrame]:
    """The rows of ``ingest_feeds``, and the unreadable payloads as ``source, record``, both of one parse.

    Parsing is the costly part, so each feed's records and errors are written once.
    """
    parts, errors = [], []
    for rank, (name, feed) in enumerate(FEEDS.items()):
        if name in payloads:
            both = staged(parse_with_errors(payloads[name], feed, "payload"), "parsed")
            records = both.where("error is null").select("record.*")
            parts.append((rank, enrich(normalize_records(records, feed, as_of))))
            errors.append(both.where("error is not null").select(F.lit(name).alias("source"), F.col("error").alias("record")))
    return _with_arrival(parts), reduce(DataFrame.union, errors)


@dataclass(frozen=True)
class Cycle:
    """One ingest cycle: the new snapshot, unreadable payloads, sources that could not be read, and counts of all of it."""

    snapshot: DataFrame
    errors: DataFrame
    failed: DataFrame
    report: DataFrame


def ingest_cycle(stored: DataFrame, paths: dict[str, str], as_of, small_batch: bool = False, whole_files: bool = False) -> Cycle:
    """Read all sources that can be read, and merge what they give into the stored listings.

    ``report`` has ``source, action, n``: per source how many rows were found,
    payloads unreadable and reads failed, and for the whole cycle (source ``all``)
    how many listings were inserted, updated and kept.
    """
    payloads, failed = read_sources(stored.sparkSession, paths, whole_files)
    failed = failed.where(F.col("source").isin(list(FEEDS)))
    target = align_to_schema(stored, LISTINGS)
    lost = failed.groupBy("source").agg(F.lit("failed").alias("action"), F.count("*").alias("n"))
    if not set(payloads) & set(FEEDS):
        none = failed.limit(0).select("source", F.col("reason").alias("record"))
        return Cycle(target, none, failed, lost)
    rows, errors = ingest_with_errors(payloads, as_of)
    known = [f for f in LISTINGS if f.name in rows.columns]
    rows = staged(rows.select("source_rank", *[F.col(f.name).cast(f.dataType).alias(f.name) for f in known], "seq"), "batch")
    merged = staged(upsert(target, rows.drop("source_rank"), as_of, "merge", small_batch=small_batch, with_action=True), "merged")
    names = F.element_at(F.array(*[F.lit(n) for n in FEEDS]), F.col("source_rank") + 1)
    found = rows.groupBy(names.alias("source")).agg(F.lit("found").alias("action"), F.count("*").alias("n"))
    bad = errors.groupBy("source").agg(F.lit("unreadable").alias("action"), F.count("*").alias("n"))
    changed = merged.groupBy("action").agg(F.count("*").alias("n")).select(F.lit("all").alias("source"), "action", "n")
    return Cycle(merged.drop("action"), errors, failed, reduce(DataFrame.unionByName, [found, bad, lost, changed]))


def refresh_listings(stored: DataFrame, payloads: dict[str, DataFrame], as_of, small_batch: bool = False) -> DataFrame:
    """New snapshot after one ingest cycle under the merge policy.

    The normalized batch is written once: the upsert reads it several times, each
    time only the columns it needs, and parsing is the costly part.
    """
    batch = ingest_feeds(payloads, as_of)
    known = [f for f in LISTINGS if f.name in batch.columns]
    rows = staged(batch.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in known], "seq"), "batch")
    return upsert(align_to_schema(stored, LISTINGS), rows, as_of, "merge", small_batch=small_batch)


def refresh_from_boards(
    stored: DataFrame, as_of, items: DataFrame | None = None, pages: DataFrame | None = None, small_batch: bool = False,
) -> DataFrame:
    """New snapshot after one board cycle: a known listing is only seen again.

    ``items`` are the raw items of JSON boards with ``page``, ``pages`` the HTML
    pages ``(page, source, html)``. Regional boards come first, then the others,
    each in page order.
    """
    parts = []
    if items is not None:
        parts.append(json_board_rows(items, as_of, ("page",)))
    if pages is not None:
        parts.append(html_board_rows(pages, "page", "html", "source", as_of))
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    ranks = lookup(F.col("source"), {s: str(source_rank(s)) for s in REGIONAL_SOURCES + OTHER_SOURCES}).cast("int")
    rows = rows.where(F.col("title") != "").withColumn("seq", F.struct(ranks.alias("rank"), "page", "pos"))
    known = [f for f in LISTINGS if f.name in rows.columns]
    rows = staged(rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in known], "seq"), "boards")
    return upsert(align_to_schema(stored, LISTINGS), rows, as_of, "touch", small_batch=small_batch)


def bulk_rows(df: DataFrame, source: str, as_of, shown: int | None = None) -> DataFrame:
    """Bulk builder: inline enrichment and region check of home-country rows.

    Reads ``title, company, url, city, description, posted_text, salary_min,
    salary_max, is_remote``; the currency is ``currency`` or the rupee. The whole
    description is judged; the shown one is its first sentence, whole or cut to
    ``shown`` characters.
    """
    have = set(df.columns)
    title, company = strip(text_or_empty(F.col("title"))), strip(text_or_empty(F.col("company")))
    text = flat_text(F.col("description"))
    city = F.coalesce(F.nullif(F.col("city"), F.lit("")), F.lit("India"))
    guessed = C.remote_from_text(F.concat_ws(" ", title, city, text), fv.BULK_HYBRID_WORDS)
    if "is_remote" in have:
        guessed = F.when(F.coalesce(F.col("is_remote"), F.lit(False)), "remote").otherwise(
            C.remote_from_text(F.concat_ws(" ", title, text), fv.BULK_HYBRID_WORDS)
        )
    currency = F.coalesce(F.col("currency"), F.lit("INR")) if "currency" in have else F.lit("INR")
    rows = df.withColumns({"_t": title, "_c": company, "_d": text, "_city": city})
    rows = rows.select(
        *[c for c in ("seq",) if c in have],
        F.col("_t").alias("title"),
        F.col("_c").alias("company_name"),
        F.col("_city").alias("location_city"),
        F.lit("India").alias("location_country"),
        F.col("url").alias("apply_url"),
        first_sentence(F.col("description"), shown).alias("description"),
        F.col("_d"),
        parse_date(F.col("posted_text")).alias("posted_date"),
        F.array(F.lit(source)).alias("source_platforms"),
        guessed.alias("remote_type"),
        C.experience_level(F.col("_t")).alias("experience_level"),
        C.job_type(F.col("_t"), F.col("_d")).alias("job_type"),
        C.bulk_company_type(F.col("_c"), F.col("_d")).alias("company_type"),
        C.mentions(F.col("_d"), fv.BULK_VISA).alias("visa_sponsorship"),
        C.mentions(F.col("_d"), fv.BULK_RELOCATION).alias("relocation_support"),
        "salary_min",
        "salary_max",
        currency.alias("salary_currency"),
    )
    filled = (F.col("title") != "") & (F.col("company_name") != "") & (text_or_empty(F.col("apply_url")) != "")
    ok = C.home_region_ok(F.col("title"), F.col("salary_currency"), F.col("_d"))
    return rows.where(filled & ok).drop("_d")


def bulk_insert_rows(rows: DataFrame, as_of, order: str = "seq") -> DataFrame:
    """Valid bulk rows with key, stamps and ATS label; the first row of each key."""
    ok = rows.where(insert_verdict(F.col("title"), F.col("company_name"), F.col("apply_url")) == "ok")
    keyed = add_key(ok, raw=("apply_url",))
    first = first_per_key(keyed, ["dedup_hash"], [F.asc(order)])
    now = as_timestamp(as_of)
    return with_bulk_ats(first).withColumns(
        {
            "is_active": F.lit(True),
            "created_at": now,
            "updated_at": now,
            "posted_date": F.coalesce(F.col("posted_date"), now),
        }
    )


def load_bulk(stored: DataFrame, rows: DataFrame, as_of, small_batch: bool = False) -> DataFrame:
    """New snapshot after a bulk load: supplied values replace stored ones."""
    batch = bulk_insert_rows(rows, as_of)
    known = [f for f in LISTINGS if f.name in batch.columns]
    batch = staged(batch.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in known], "seq"), "bulk")
    return upsert(align_to_schema(stored, LISTINGS), batch, as_of, "overwrite", small_batch=small_batch)


def startup_maintenance(df: DataFrame, as_of) -> DataFrame:
    """Recover first, then expire: the first takes the young rows, the second the old."""
    return df.transform(recover, as_of).transform(expire, as_of)


def search_with_ats(df: DataFrame, params: dict, as_of, **paging) -> DataFrame:
    """A search page with the ATS label of each shown row."""
    page = search_page(df, SearchParams.from_dict(params), as_of, **paging)
    return with_ats(page)


def query_grid(queries: DataFrame, places: DataFrame, seed: int, per_class: int = 3, places_per_class: int = 2) -> DataFrame:
    """Sampled query and place pairs: a few of each class on both sides.

    Both inputs are ``(name, is_home)``. The order is a seeded hash, so a run can
    be repeated. At most ``2 * per_class`` by ``2 * places_per_class`` pairs.
    """
    from listflow.operators.matching import top_per_group

    def pick(df: DataFrame, k: int) -> DataFrame:
        order = [F.sha2(F.concat_ws("|", F.col("name"), F.lit(str(seed))), 256), F.asc("name")]
        return top_per_group(df, ["is_home"], order, k)

    # The sampled places are a handful by construction, so they become a literal.
    names = [r.name for r in pick(places, places_per_class).select("name").orderBy("name").collect()]
    if not names:
        return pick(queries, per_class).select(F.col("name").alias("query"), F.col("name").alias("place")).limit(0)
    return pick(queries, per_class).select(F.col("name").alias("query"), F.explode(term_array(names)).alias("place"))

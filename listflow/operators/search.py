"""Faceted search: predicates, the featured tier, sorting and paging."""

from __future__ import annotations

from dataclasses import dataclass, fields
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from listflow.functions import fixed_values as fv
from listflow.functions.dates import days_before, is_new
from listflow.functions.text import contains_text

FACETS = ("remote_type", "experience_level", "job_type", "company_type", "vc_backer")
FLAGS = ("visa_sponsorship", "relocation_support")
# The featured tier checks fewer filters than the regular rows by default.
FEATURED_FILTERS = {
    "q", "location", "remote_type", "experience_level", "job_type", "visa_sponsorship",
    "relocation_support", "company_type",
}


@dataclass(frozen=True)
class SearchParams:
    """Search parameters. Empty values are not applied."""

    q: str | None = None
    location: str | None = None
    remote_type: str | None = None
    experience_level: str | None = None
    job_type: str | None = None
    salary_min: float | None = None
    salary_max: float | None = None
    visa_sponsorship: bool | None = None
    relocation_support: bool | None = None
    company_type: str | None = None
    vc_backer: str | None = None
    tech_stack: str | None = None
    source: str | None = None
    posted_within: str | None = None

    @classmethod
    def from_dict(cls, values: dict) -> "SearchParams":
        """Drop empty and unknown parameters."""
        known = {f.name for f in fields(cls)}
        return cls(**{k: v for k, v in values.items() if k in known and v not in (None, "")})

    def supplied(self) -> set[str]:
        return {f.name for f in fields(self) if getattr(self, f.name) not in (None, "")}


def keyword(q: str, columns: tuple[str, ...] = ("title", "company_name", "description")) -> Column:
    """The term, taken literally, occurs in one of the columns in any case."""
    return reduce(lambda a, b: a | b, [contains_text(F.col(c), q) for c in columns])


def at_location(location: str, city: str = "location_city", country: str = "location_country") -> Column:
    hit = contains_text(F.col(city), location) | contains_text(F.col(country), location)
    alias = fv.LOCATION_ALIASES.get(location.lower())
    return hit | (F.col(country) == alias) if alias else hit


def has_all_tags(tags: "str | list[str]", column: str = "tech_stack") -> Column:
    """The list holds every tag, case counts; a null list fails."""
    wanted = [t.strip() for t in tags.split(",")] if isinstance(tags, str) else list(tags)
    return F.size(F.array_except(F.array(*[F.lit(t) for t in wanted]), F.col(column))) == 0


def has_tag(tag: str, column: str = "source_platforms") -> Column:
    return F.array_contains(F.col(column), tag)


def posted_within(period: str, as_of, column: str = "posted_date") -> Column:
    days = fv.POSTED_WITHIN_DAYS.get(period, fv.POSTED_WITHIN_DEFAULT_DAYS)
    return F.col(column) >= days_before(as_of, days)


def unexpired(as_of, days: int = fv.EXPIRY_DAYS) -> Column:
    """Active and young enough; a listing without a date is out."""
    return F.col("is_active") & (F.col("posted_date") >= days_before(as_of, days))


def is_featured() -> Column:
    return F.col("is_featured") == F.lit(True)


def not_featured() -> Column:
    """``<> true``, which also drops nulls."""
    return F.col("is_featured") != F.lit(True)


def predicates(params: SearchParams, as_of, only: set[str] | None = None) -> list[Column]:
    """One predicate per supplied parameter; a salary bound of 0 is not applied."""
    use = params.supplied() & (only or params.supplied())
    out: list[Column] = []
    if "q" in use:
        out.append(keyword(params.q))
    if "location" in use:
        out.append(at_location(params.location))
    out += [F.col(f) == getattr(params, f) for f in FACETS if f in use]
    out += [F.col(f) == F.lit(getattr(params, f)) for f in FLAGS if f in use]
    if "salary_min" in use and params.salary_min:
        out.append(F.col("salary_min") >= params.salary_min)
    if "salary_max" in use and params.salary_max:
        out.append(F.col("salary_max") <= params.salary_max)
    if "tech_stack" in use:
        out.append(has_all_tags(params.tech_stack))
    if "source" in use:
        out.append(has_tag(params.source))
    if "posted_within" in use:
        out.append(posted_within(params.posted_within, as_of))
    return out


def where_all(df: DataFrame, conditions: list[Column]) -> DataFrame:
    return reduce(lambda d, c: d.where(c), conditions, df)


def regular_rows(df: DataFrame, params: SearchParams, as_of) -> DataFrame:
    return where_all(df, [unexpired(as_of), not_featured(), *predicates(params, as_of)])


def featured_rows(df: DataFrame, params: SearchParams, as_of, all_filters: bool = False) -> DataFrame:
    only = None if all_filters else FEATURED_FILTERS
    return where_all(df, [unexpired(as_of), is_featured(), *predicates(params, as_of, only)])


def sort_keys(sort_by: str = "created_at", descending: bool = True, tie: str = "id") -> list[Column]:
    """Nulls first when descending and last when ascending, ties by id."""
    main = F.desc_nulls_first(sort_by) if descending else F.asc_nulls_last(sort_by)
    return [main, F.asc(tie)]


def page_of(df: DataFrame, order: list[Column], page: int, per_page: int) -> DataFrame:
    """Offset paging. Its cost grows with the page number; see :func:`page_after`."""
    ordered = df.orderBy(*order)
    skip = (page - 1) * per_page
    return (ordered.offset(skip) if skip else ordered).limit(per_page)


def build_page_index(df: DataFrame, path: str, order: list[Column], ranges: int) -> None:
    """Write ``df`` as about ``ranges`` runs of the sort order, and how many rows stand before each.

    One range shuffle and one sort, made once for any number of pages. The counts
    have a row per range.
    """
    placed = df.repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumn("page_range", F.spark_partition_id())
    placed.write.partitionBy("page_range").parquet(f"{path}/rows")
    counts = df.sparkSession.read.parquet(f"{path}/rows").groupBy("page_range").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("page_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts.withColumn("before", before).coalesce(1).write.parquet(f"{path}/counts")


def page_from_index(spark: SparkSession, path: str, order: list[Column], page: int, per_page: int, schema: T.StructType) -> DataFrame:
    """Any page of an index: the ranges that it touches are read, one or two as a rule, whatever its number."""
    begin, end = (page - 1) * per_page, page * per_page
    touched = spark.read.parquet(f"{path}/counts").where((F.col("before") < end) & (F.col("before") + F.col("n") > begin)).orderBy("before").collect()
    rows = spark.read.schema(T.StructType([*schema.fields, T.StructField("page_range", T.IntegerType())])).parquet(f"{path}/rows")
    rows = rows.where(F.col("page_range").isin([r.page_range for r in touched])).drop("page_range").orderBy(*order)
    return rows.offset(begin - touched[0].before).limit(per_page) if touched else rows.limit(0)


def page_after(
    df: DataFrame, per_page: int, cursor: tuple | None = None, sort_by: str = "created_at", tie: str = "id"
) -> DataFrame:
    """Keyset paging, newest first: the rows after the last ``(sort value, id)`` seen.

    The cursor is a plain filter, so any page costs one scan and a top-k.
    Rows without a sort value come first, as in :func:`sort_keys`.
    """
    if cursor is not None:
        value, last_id = cursor
        s, i = F.col(sort_by), F.col(tie)
        if value is None:
            after = s.isNotNull() | (i > F.lit(last_id))
        else:
            v = F.lit(value).cast(df.schema[sort_by].dataType)
            after = (s < v) | ((s == v) & (i > F.lit(last_id)))
        df = df.where(after)
    return df.orderBy(*sort_keys(sort_by, True, tie)).limit(per_page)


def search_page(
    df: DataFrame,
    params: SearchParams,
    as_of,
    page: int = 1,
    per_page: int = 20,
    sort_by: str = "created_at",
    descending: bool = True,
    featured_limit: int | None = None,
    all_filters: bool = False,
) -> DataFrame:
    """Featured rows before the page of regular rows.

    All featured rows stand on page 1. With ``featured_limit`` it has that many
    of them and each later page as many more, so that every row that
    ``search_totals`` counts stands on one page.

    Adds ``tier`` (0 featured, 1 regular), ``position`` within the tier, ``_is_new`` and ``_is_featured``.
    Both tiers are top-k plans; nothing but their rows reaches the union.
    """
    def placed(rows: DataFrame, tier: int, order: list[Column]) -> DataFrame:
        # The input is at most one page, so this window never sees more.
        position = F.row_number().over(Window.partitionBy(F.lit(tier)).orderBy(*order))
        return rows.withColumn("tier", F.lit(tier)).withColumn("position", position)

    order = sort_keys(sort_by, descending)
    regular = placed(page_of(regular_rows(df, params, as_of), order, page, per_page), 1, order)
    regular = regular.withColumn("_is_new", is_new(F.col("created_at"), as_of)).withColumn("_is_featured", F.lit(False))
    if page != 1 and featured_limit is None:
        return regular
    top_order = sort_keys("created_at", True)
    featured = featured_rows(df, params, as_of, all_filters)
    if featured_limit is not None:
        featured = page_of(featured, top_order, page, featured_limit)
    top = placed(featured, 0, top_order).withColumn("_is_new", F.lit(False)).withColumn("_is_featured", F.lit(True))
    # The two tiers exclude each other by their predicate.
    return top.unionByName(regular).orderBy("tier", "position")


def search_totals(
    df: DataFrame, params: SearchParams, as_of, per_page: int = 20, featured_limit: int | None = None,
    all_filters: bool = False,
) -> DataFrame:
    """One row ``(total, total_pages)``: regular and featured rows, or at most ``featured_limit`` of the latter, in one scan."""
    only = None if all_filters else FEATURED_FILTERS

    def all_of(conditions: list[Column]) -> Column:
        return reduce(lambda a, b: a & b, conditions, F.lit(True))

    regular = all_of([not_featured(), *predicates(params, as_of)])
    featured = all_of([is_featured(), *predicates(params, as_of, only)])
    counts = df.where(unexpired(as_of)).agg(
        F.count_if(regular).alias("regular"),
        (F.count_if(featured) if featured_limit is None else F.least(F.count_if(featured), F.lit(featured_limit))).alias("featured"),
    )
    total = F.col("regular") + F.col("featured")
    return counts.select(total.alias("total"), F.ceil(total / per_page).alias("total_pages"))


def without(df: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose key is not among the ids."""
    return df.join(ids.select(key).distinct(), key, "left_anti")


def only(df: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return df.join(ids.select(key).distinct(), key, "left_semi")


def flag_members(df: DataFrame, ids: DataFrame, key: str, name: str) -> DataFrame:
    """Add a boolean telling whether the key is among the ids."""
    marks = ids.select(key).distinct().withColumn("_mark", F.lit(True))
    return df.join(marks, key, "left").withColumn(name, F.col("_mark").isNotNull()).drop("_mark")


def list_companies(
    df: DataFrame, q: str | None = None, company_type: str | None = None, vc_backer: str | None = None,
    page: int | None = None, per_page: int = 20, order: tuple[str, ...] = ("id",),
) -> DataFrame:
    """Companies that fit, all of them or one page in ``order``."""
    conditions = []
    if q:
        conditions.append(contains_text(F.col("name"), q))
    if company_type:
        conditions.append(F.col("company_type") == company_type)
    if vc_backer:
        conditions.append(has_tag(vc_backer, "vc_backers"))
    found = where_all(df, conditions)
    return found if page is None else page_of(found, [F.asc(c) for c in order], page, per_page)


def company_total(df: DataFrame, q: str | None = None, company_type: str | None = None, vc_backer: str | None = None) -> DataFrame:
    """One row ``(total)``: companies that fit, on all pages."""
    return list_companies(df, q, company_type, vc_backer).agg(F.count("*").alias("total"))


def company_profile(companies: DataFrame, listings: DataFrame, slug: str, limit: int = 50) -> DataFrame:
    """The company of a slug beside each of its ``limit`` newest active listings.

    A listing belongs to it when its company name contains the company's.
    ``job_count`` is the number of listings shown. A company without any has one
    row of nulls; an unknown slug, or one that several companies bear, is an error.
    """
    from listflow.operators.matching import one_row

    company = one_row(companies.select("slug", "name"), F.col("slug") == slug)
    jobs = listings.where(F.col("is_active") & contains_text(F.col("company_name"), company.name))
    order = [F.desc_nulls_first("posted_date"), F.asc("id")]
    # The count is over the rows shown, at most ``limit``.
    shown = jobs.orderBy(*order).limit(limit).withColumn("job_count", F.count("*").over(Window.partitionBy("is_active")))
    one = companies.where(F.col("slug") == slug).select(F.col("slug").alias("company_slug"), F.col("name").alias("profile_name"))
    return one.join(shown.withColumn("company_slug", F.lit(slug)), "company_slug", "left").withColumn("job_count", F.coalesce("job_count", F.lit(0)))

"""API feeds: landed JSON payloads to canonical listing columns.

A feed is ``(name, envelope schema, path to the records, normalizer)``. Payloads
are read with the explicit schema; a payload that does not parse is kept for the
error table and contributes no rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from listflow.functions import classify as C
from listflow.functions.dates import days_before, parse_date, relative_date
from listflow.functions.extract import compensation_range
from listflow.functions.text import strip
from listflow.operators.dedup import add_key
from listflow.operators.enrich import with_company_kind, with_perks


@dataclass(frozen=True)
class Feed:
    name: str
    record: str  # fields of one record
    root: tuple[str, ...]  # path from the payload to the list of records; () = the payload is the list
    normalize: Callable[[DataFrame, object], DataFrame]
    prepare: Callable[[DataFrame, object], DataFrame] | None = None


def _text(name: str, default: str = "") -> Column:
    return F.coalesce(F.col(name), F.lit(default))


def _base(source: str, **columns: Column) -> list[Column]:
    fixed = {"source_platforms": F.array(F.lit(source)), "is_active": F.lit(True)}
    return [c.alias(n) for n, c in {**columns, **fixed}.items()]


def normalize_jsearch(df: DataFrame, as_of=None) -> DataFrame:
    def highlights(name: str) -> Column:
        return F.coalesce(F.col(f"job_highlights.{name}"), F.array().cast("array<string>"))

    return df.select(
        *_base(
            "JSearch",
            title=_text("job_title"),
            company_name=_text("employer_name"),
            company_logo_url=F.col("employer_logo"),
            company_industry=F.col("employer_company_type"),
            location_city=F.col("job_city"),
            location_country=F.col("job_country"),
            remote_type=C.remote_from_flag(F.col("job_is_remote")),
            salary_min=F.col("job_min_salary"),
            salary_max=F.col("job_max_salary"),
            salary_currency=_text("job_salary_currency", "USD"),
            salary_period=_text("job_salary_period", "yearly"),
            job_type=C.normalize_job_type(F.col("job_employment_type")),
            description=F.col("job_description"),
            requirements=highlights("Qualifications"),
            responsibilities=highlights("Responsibilities"),
            benefits=highlights("Benefits"),
            apply_url=F.col("job_apply_link"),
            posted_date=parse_date(F.col("job_posted_at_datetime_utc")),
            expiry_date=parse_date(F.col("job_offer_expiration_datetime_utc")),
        )
    )


def normalize_serpapi(df: DataFrame, as_of) -> DataFrame:
    return df.select(
        *_base(
            "SerpApi",
            title=_text("title"),
            company_name=_text("company_name"),
            location_city=F.col("location"),
            description=F.col("description"),
            salary_min=F.col("detected_extensions.salary_from"),
            salary_max=F.col("detected_extensions.salary_to"),
            job_type=C.normalize_job_type(F.col("detected_extensions.schedule_type")),
            posted_date=relative_date(F.col("detected_extensions.posted_at"), as_of),
            apply_url=F.try_element_at(F.col("apply_options"), F.lit(1))["link"],
        )
    )


def normalize_adzuna(df: DataFrame, as_of=None) -> DataFrame:
    area = F.col("location.area")
    coords = F.struct(F.col("latitude").alias("lat"), F.col("longitude").alias("lng"))
    return df.select(
        *_base(
            "Adzuna",
            title=_text("title"),
            company_name=F.coalesce(F.col("company.display_name"), F.lit("Unknown")),
            location_city=F.try_element_at(area, F.lit(-1)),
            location_country=F.try_element_at(area, F.lit(1)),
            location_coords=F.when(F.col("latitude") != 0, coords),
            salary_min=F.col("salary_min"),
            salary_max=F.col("salary_max"),
            salary_currency=F.lit("GBP"),
            description=F.col("description"),
            apply_url=F.col("redirect_url"),
            posted_date=parse_date(F.col("created")),
            job_type=C.normalize_job_type(F.col("contract_type")),
        )
    )


def normalize_theirstack(df: DataFrame, as_of=None) -> DataFrame:
    return df.select(
        *_base(
            "TheirStack",
            title=_text("job_title"),
            company_name=_text("company_name"),
            company_logo_url=F.col("company_logo"),
            company_size=F.col("company_num_employees"),
            location_city=F.col("location"),
            location_country=F.col("country"),
            remote_type=C.remote_from_flag(F.col("remote")),
            tech_stack=F.coalesce(F.col("technologies"), F.array().cast("array<string>")),
            description=F.col("description"),
            apply_url=F.col("url"),
            posted_date=parse_date(F.col("date_posted")),
        )
    )


def _last_month(df: DataFrame, as_of) -> DataFrame:
    """The feed serves the last 30 days only."""
    return df.where(parse_date(F.col("date_posted")) >= days_before(as_of, 30))


def normalize_apify(df: DataFrame, as_of=None) -> DataFrame:
    def either(a: str, b: str, default: str | None = "") -> Column:
        return F.coalesce(F.col(a), F.col(b), F.lit(default))

    return df.select(
        *_base(
            "Apify",
            title=either("title", "jobTitle"),
            company_name=either("company", "companyName"),
            company_logo_url=F.col("companyLogo"),
            location_city=either("location", "jobLocation"),
            salary_min=F.col("salaryMin"),
            salary_max=F.col("salaryMax"),
            description=either("description", "jobDescription"),
            apply_url=either("url", "jobUrl"),
            posted_date=parse_date(either("postedAt", "datePosted", None)),
        )
    )


def normalize_themuse(df: DataFrame, as_of=None) -> DataFrame:
    first_location = F.try_element_at(F.col("locations"), F.lit(1))["name"]
    return df.select(
        *_base(
            "The Muse",
            title=_text("name"),
            company_name=F.coalesce(F.col("company.name"), F.lit("")),
            location_city=F.coalesce(first_location, F.lit("")),
            experience_level=C.feed_level(F.try_element_at(F.col("levels"), F.lit(1))["name"]),
            job_type=C.normalize_job_type(F.col("type")),
            description=_text("contents"),
            apply_url=F.col("refs.landing_page"),
            posted_date=parse_date(F.col("publication_date")),
        )
    )


def normalize_findwork(df: DataFrame, as_of=None) -> DataFrame:
    return df.select(
        *_base(
            "Findwork",
            title=_text("role"),
            company_name=_text("company_name"),
            company_logo_url=F.col("logo"),
            location_city=F.col("location"),
            remote_type=C.remote_from_flag(F.col("remote")),
            tech_stack=F.coalesce(F.col("keywords"), F.array().cast("array<string>")),
            description=F.col("text"),
            apply_url=F.col("url"),
            posted_date=parse_date(F.col("date_posted")),
        )
    )


def normalize_yc(df: DataFrame, as_of=None) -> DataFrame:
    return df.select(
        *_base(
            "YC",
            title=_text("title"),
            company_name=_text("company_name"),
            company_logo_url=F.col("company_logo"),
            company_type=F.lit("vc_backed"),
            vc_backer=strip(F.concat(F.lit("YC "), _text("batch"))),
            location_city=F.col("location"),
            remote_type=C.remote_from_flag(F.col("remote")),
            salary_min=F.col("salary_min"),
            salary_max=F.col("salary_max"),
            experience_level=F.col("experience"),
            description=F.col("description"),
            apply_url=F.col("url"),
            posted_date=parse_date(F.col("posted_at")),
        )
    )


def _yc_names(df: DataFrame, as_of=None) -> DataFrame:
    return df.withColumnsRenamed(
        {"company_logo_url": "company_logo", "experience_level": "experience", "created_at": "posted_at"}
    )


def normalize_wellfound(df: DataFrame, as_of=None) -> DataFrame:
    return df.select(
        *_base(
            "Wellfound",
            title=_text("title"),
            company_name=F.coalesce(F.col("company_name"), F.col("startup.name"), F.lit("")),
            company_logo_url=F.col("company_logo"),
            company_type=F.lit("startup"),
            location_city=F.col("location"),
            remote_type=C.remote_from_flag(F.col("remote")),
            salary_min=F.col("salary_min"),
            salary_max=F.col("salary_max"),
            description=F.col("description"),
            apply_url=F.col("url"),
            tech_stack=F.coalesce(F.col("skills"), F.array().cast("array<string>")),
        )
    )


def _wellfound_fields(df: DataFrame, as_of=None) -> DataFrame:
    """Flatten tag names, read the compensation text, complete the link."""
    pay = compensation_range(F.coalesce(F.col("compensation"), F.lit("")))
    return df.withColumns(
        {
            "company_name": F.coalesce(F.col("startup.name"), F.lit("")),
            "company_logo": F.col("startup.logoUrl"),
            "location": F.lit(""),
            "salary_min": pay["min"],
            "salary_max": pay["max"],
            "url": F.concat(F.lit("https://wellfound.com/jobs/"), _text("url")),
            "skills": F.transform(F.col("skills"), lambda s: F.coalesce(s["name"], F.lit(""))),
        }
    )


def normalize_linkedin(df: DataFrame, as_of=None) -> DataFrame:
    return df.select(
        *_base(
            "LinkedIn",
            title=_text("title"),
            company_name=_text("companyName"),
            company_logo_url=F.col("companyLogo"),
            location_city=_text("location"),
            salary_min=F.col("salaryMin"),
            salary_max=F.col("salaryMax"),
            description=_text("description"),
            apply_url=F.coalesce(F.col("url"), F.col("applyUrl"), F.lit("")),
            posted_date=parse_date(F.col("postedAt")),
            easy_apply=F.coalesce(F.col("easyApply"), F.lit(False)),
        )
    )


FEEDS: dict[str, Feed] = {
    f.name: f
    for f in [
        Feed(
            "JSearch",
            "job_title: string, employer_name: string, employer_logo: string, employer_company_type: string,"
            " job_city: string, job_country: string, job_is_remote: boolean, job_min_salary: double,"
            " job_max_salary: double, job_salary_currency: string, job_salary_period: string,"
            " job_employment_type: string, job_description: string,"
            " job_highlights: struct<Qualifications: array<string>, Responsibilities: array<string>,"
            " Benefits: array<string>>, job_apply_link: string, job_posted_at_datetime_utc: string,"
            " job_offer_expiration_datetime_utc: string",
            ("data",), normalize_jsearch,
        ),
        Feed(
            "SerpApi",
            "title: string, company_name: string, location: string, description: string,"
            " detected_extensions: struct<salary_from: double, salary_to: double, schedule_type: string,"
            " posted_at: string>, apply_options: array<struct<link: string>>",
            ("jobs_results",), normalize_serpapi,
        ),
        Feed(
            "Adzuna",
            "title: string, company: struct<display_name: string>,"
            " location: struct<area: array<string>, display_name: string>, latitude: double,"
            " longitude: double, salary_min: double, salary_max: double, description: string,"
            " redirect_url: string, created: string, contract_type: string",
            ("results",), normalize_adzuna,
        ),
        Feed(
            "TheirStack",
            "job_title: string, company_name: string, company_logo: string, company_num_employees: string,"
            " location: string, country: string, remote: boolean, technologies: array<string>,"
            " description: string, url: string, date_posted: string",
            ("data",), normalize_theirstack, prepare=_last_month,
        ),
        Feed(
            "Apify",
            "title: string, jobTitle: string, company: string, companyName: string, companyLogo: string,"
            " location: string, jobLocation: string, salaryMin: double, salaryMax: double,"
            " description: string, jobDescription: string, url: string, jobUrl: string, postedAt: string,"
            " datePosted: string",
            (), normalize_apify,
        ),
        Feed(
            "The Muse",
            "name: string, company: struct<name: string>, locations: array<struct<name: string>>,"
            " levels: array<struct<name: string>>, type: string, contents: string,"
            " refs: struct<landing_page: string>, publication_date: string",
            ("results",), normalize_themuse,
        ),
        Feed(
            "Findwork",
            "role: string, company_name: string, logo: string, location: string, remote: boolean,"
            " keywords: array<string>, text: string, url: string, date_posted: string",
            ("results",), normalize_findwork,
        ),
        Feed(
            "YC",
            "title: string, company_name: string, company_logo_url: string, batch: string,"
            " location: string, remote: boolean, salary_min: double, salary_max: double,"
            " experience_level: string, description: string, url: string, created_at: string",
            ("results", "hits"), normalize_yc, prepare=_yc_names,
        ),
        Feed(
            "Wellfound",
            "id: string, title: string, description: string, url: string, remote: boolean,"
            " compensation: string, startup: struct<name: string, logoUrl: string, companySize: string>,"
            " skills: array<struct<name: string>>",
            ("data", "talent", "jobListings", "results"), normalize_wellfound, prepare=_wellfound_fields,
        ),
        Feed(
            "LinkedIn",
            "title: string, companyName: string, companyLogo: string, location: string, salaryMin: double,"
            " salaryMax: double, description: string, url: string, applyUrl: string, postedAt: string,"
            " easyApply: boolean",
            (), normalize_linkedin,
        ),
    ]
}


def payload_ddl(feed: Feed) -> str:
    """Schema of one payload."""
    ddl = f"array<struct<{feed.record}>>"
    for name in reversed(feed.root):
        ddl = f"struct<{name}: {ddl}>" if name != "results" or feed.root[-1] != "hits" else f"struct<results: array<{ddl}>>"
    return ddl


def _records(feed: Feed, payload: Column) -> Column:
    """The list of records; a list on the way contributes its first element."""
    if feed.root[-1:] == ("hits",):
        rows = F.try_element_at(payload["results"], F.lit(1))["hits"]
    else:
        rows = reduce(lambda c, name: c[name], feed.root, payload)
    return rows


def parse_payloads(df: DataFrame, feed: Feed, payload: str, keep: tuple[str, ...] = (), limit: int | None = None) -> DataFrame:
    """Records of JSON text payloads, one row each; bad payloads give no rows.

    All records, or the first ``limit`` of each payload.
    """
    parsed = df.withColumn("_payload", F.from_json(payload, payload_ddl(feed)))
    records = _records(feed, F.col("_payload"))
    rows = parsed.select(*keep, F.explode(F.slice(records, 1, limit) if limit is not None else records).alias("_r"))
    return rows.select(*keep, "_r.*")


def _unreadable(feed: Feed, payload: str) -> Column:
    """Text that is no JSON of the expected shape; an absent or null list is none of that.

    A payload that is a struct reports bad values in its corrupt record column.
    """
    text = F.col(payload)
    if feed.root:
        ddl = payload_ddl(feed)
        parsed = F.from_json(text, f"{ddl[:-1]}, _corrupt: string>", {"columnNameOfCorruptRecord": "_corrupt"})
        return text.isNotNull() & (parsed.isNull() | parsed["_corrupt"].isNotNull())
    # A list at the top has no place for the mark: wrap it.
    parsed = F.from_json(F.concat(F.lit('{"_list":'), text, F.lit("}")), f"struct<_list: {payload_ddl(feed)}, _corrupt: string>", {"columnNameOfCorruptRecord": "_corrupt"})
    return text.isNotNull() & (parsed.isNull() | parsed["_corrupt"].isNotNull())


def bad_payloads(df: DataFrame, feed: Feed, payload: str) -> DataFrame:
    """The error table: payloads that are not JSON of the expected shape, or hold values of another type."""
    return df.where(_unreadable(feed, payload)).select(F.lit(feed.name).alias("source"), F.col(payload).alias("record"))


def parse_with_errors(df: DataFrame, feed: Feed, payload: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Records and unreadable payloads of one parse: ``keep``, ``record`` (a struct) and ``error`` (the payload's text).

    A row holds a record or an error. Records are those of ``parse_payloads``, errors
    those of ``bad_payloads``; a payload with bad values in it gives both. Only an
    object in place of a list at the top is no record here.
    """
    text, mark = F.col(payload), {"columnNameOfCorruptRecord": "_corrupt"}
    if feed.root:
        parsed = F.from_json(text, f"{payload_ddl(feed)[:-1]}, _corrupt: string>", mark)
    else:
        # A list at the top has no place for the mark: wrap it.
        parsed = F.from_json(F.concat(F.lit('{"_list":'), text, F.lit("}")), f"struct<_list: {payload_ddl(feed)}, _corrupt: string>", mark)
    rows = df.select(*keep, text.alias("_text"), parsed.alias("_parsed"))
    records = _records(feed, F.col("_parsed")) if feed.root else F.col("_parsed._list")
    kind = f"array<struct<record: struct<{feed.record}>, error: string>>"
    found = F.transform(records, lambda r: F.struct(r.alias("record"), F.lit(None).cast("string").alias("error")))
    bad = F.col("_text").isNotNull() & (F.col("_parsed").isNull() | F.col("_parsed._corrupt").isNotNull())
    # no record has the shape of the records, and is told from a null record by its error
    error = F.when(bad, F.array(F.struct(F.lit(None).cast(f"struct<{feed.record}>").alias("record"), F.col("_text").alias("error"))))
    nothing = F.array().cast(kind)
    return rows.select(*keep, F.explode(F.concat(F.coalesce(found, nothing), F.coalesce(error, nothing))).alias("_e")).select(*keep, "_e.record", "_e.error")


def read_sources(spark: SparkSession, paths: dict[str, str], whole_files: bool = False) -> tuple[dict[str, DataFrame], DataFrame]:
    """Landed payloads of each source, and the sources that could not be read: ``source, reason``.

    A source whose folder is absent or unreadable contributes nothing and does not
    stop the others.
    """
    payloads, failed = {}, []
    for source, path in paths.items():
        try:
            payloads[source] = read_payloads(spark, path, whole_files)
        except AnalysisException as why:
            failed.append((source, why.getCondition() or "UNKNOWN"))
    return payloads, spark.createDataFrame(failed, "source string, reason string")


def read_payloads(spark: SparkSession, path: str, whole_files: bool = False) -> DataFrame:
    """Landed payloads as text: one per line, or one per file."""
    reader = spark.read.option("wholetext", str(whole_files).lower())
    return reader.text(path).select(F.col("value").alias("payload"))


def normalize_records(df: DataFrame, feed: Feed, as_of) -> DataFrame:
    prepared = feed.prepare(df, as_of) if feed.prepare else df
    return feed.normalize(prepared, as_of)


def enrich(df: DataFrame) -> DataFrame:
    """Dedup key with the posted day, company type, backer, stealth and perk flags."""
    if "posted_date" not in df.columns:
        df = df.withColumn("posted_date", F.lit(None).cast("timestamp"))
    return with_perks(with_company_kind(add_key(df, day="posted_date")))


def load_feed(df: DataFrame, feed: Feed, payload: str, as_of) -> DataFrame:
    """Payload text to enriched canonical rows of one feed."""
    return enrich(normalize_records(parse_payloads(df, feed, payload), feed, as_of))


def union_feeds(parts: list[tuple[int, DataFrame]]) -> DataFrame:
    """Bag union of sources with their priority as ``source_rank``."""
    ranked = [df.withColumn("source_rank", F.lit(rank)) for rank, df in parts]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), ranked)


#: List and record of a bulk source's payload.
BULK_RECORDS = {
    "Adzuna-IN": (
        "results",
        "title: string, company: struct<display_name: string>, location: struct<display_name: string, area: array<string>>,"
        " redirect_url: string, description: string, created: string, salary_min: double, salary_max: double",
    ),
    "JSearch": (
        "data",
        "job_title: string, employer_name: string, job_apply_link: string, job_city: string, job_description: string,"
        " job_is_remote: boolean, job_posted_at_datetime_utc: string, job_min_salary: double, job_max_salary: double,"
        " job_salary_currency: string",
    ),
}


def bulk_payload_rows(df: DataFrame, source: str, payload: str = "payload", keep: tuple[str, ...] = ()) -> DataFrame:
    """Records of bulk payloads in the columns that ``plans.jobs.bulk_rows`` reads.

    The city is the last of a place's areas, else the place's name.
    """
    root, record = BULK_RECORDS[source]
    parsed = F.from_json(payload, f"struct<{root}: array<struct<{record}>>>")
    r = df.select(*keep, F.explode(parsed[root]).alias("_r"))
    if source == "JSearch":
        names = {
            "title": "job_title", "company": "employer_name", "url": "job_apply_link", "city": "job_city", "description": "job_description",
            "posted_text": "job_posted_at_datetime_utc", "salary_min": "job_min_salary", "salary_max": "job_max_salary",
            "is_remote": "job_is_remote", "currency": "job_salary_currency",
        }
        return r.select(*keep, *[F.col(f"_r.{field}").alias(name) for name, field in names.items()])
    areas = F.col("_r.location.area")
    city = F.when(F.size(areas) > 0, F.element_at(areas, -1)).otherwise(F.col("_r.location.display_name"))
    names = {"title": "title", "company": "company.display_name", "url": "redirect_url", "description": "description", "posted_text": "created", "salary_min": "salary_min", "salary_max": "salary_max"}
    return r.select(*keep, *[F.col(f"_r.{field}").alias(name) for name, field in names.items()], city.alias("city"))

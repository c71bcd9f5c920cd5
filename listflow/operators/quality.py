"""Row quality: verdicts with a reason, clean-up before insert, star rating."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from listflow.functions import classify as C, fixed_values as fv
from listflow.functions.dates import age_days
from listflow.functions.rules import has_any, starts_with_any
from listflow.functions.text import strip, text_or_empty


def insert_verdict(title: Column, company: Column, url: Column) -> Column:
    """``ok`` or the reason a bulk row is refused."""
    t, c, u = text_or_empty(title), text_or_empty(company), text_or_empty(url)
    return (
        F.when((t == "") | (c == "") | (u == ""), "missing field")
        .when(F.length(t) < 5, "title too short")
        .when(~F.startswith(u, F.lit("http")), "invalid apply_url")
        .when(has_any(F.lower(t), fv.BULK_NON_TECH), "non-tech job")
        .otherwise("ok")
    )


def _basic_verdict(title: Column, company: Column, url: Column, non_tech: list[str]) -> Column:
    t, c, u = (strip(text_or_empty(x)) for x in (title, company, url))
    low = F.lower(t)
    return (
        F.when(F.length(t) < 5, "title too short")
        .when(F.length(c) < 2, "company name too short")
        .when(~F.startswith(u, F.lit("http")), "invalid apply_url")
        .when(starts_with_any(low, fv.FAKE_PREFIXES), "fake/test job")
        .when(has_any(low, non_tech), "non-tech job")
    )


def quality_verdict(
    title: Column, company: Column, url: Column, country: Column, currency: Column, description: Column
) -> Column:
    """``ok`` or the first failing rule of the full check."""
    low = F.lower(strip(text_or_empty(title)))
    abroad = C.is_home_country(country) & ~C.home_region_ok(title, currency, description)
    return F.coalesce(
        _basic_verdict(title, company, url, fv.NON_TECH),
        F.when(low.isin(fv.GENERIC_TITLES), "generic/spam title"),
        F.when(abroad, "location mismatch: foreign signals in title"),
        F.lit("ok"),
    )


def corrected_level(title: Column, stored: Column) -> Column:
    """A filled level that disagrees with the title is replaced; a blank one stays."""
    return F.when(F.coalesce(stored, F.lit("")) != "", C.experience_level(strip(title))).otherwise(stored)


def recoverable(title: Column, company: Column, url: Column) -> Column:
    """Whether an inactive listing may come back."""
    return _basic_verdict(title, company, url, fv.RECOVERY_NON_TECH).isNull()


def sanitize(df: DataFrame) -> DataFrame:
    """Clean-up before insert: level, region, country name, job type, remote type."""
    abroad = C.is_home_country(F.col("location_country")) & ~C.home_region_ok(
        F.col("title"), F.col("salary_currency"), F.col("description")
    )
    return df.withColumns(
        {
            "experience_level": C.experience_level(F.col("title")),
            "location_city": F.when(~abroad, F.col("location_city")),
            "location_country": F.when(~abroad, C.country_name(F.col("location_country"))),
            "job_type": C.clean_job_type(F.col("job_type")),
            "remote_type": C.keep_valid_remote(F.col("remote_type")),
        }
    )


def reject_counts(df: DataFrame, verdict: Column) -> DataFrame:
    return df.groupBy(verdict.alias("reason")).agg(F.count("*").alias("n"))


def star_rating(as_of, names: dict[str, str] | None = None) -> Column:
    """Struct ``(stars, raw_score, reasons)`` from completeness, trust and age.

    ``names`` maps a listing column to the column to read instead.
    """

    def col(name: str) -> Column:
        return F.col((names or {}).get(name, name))

    days = age_days(col("posted_date"), as_of)

    def filled_number(c: Column) -> Column:
        return F.coalesce(c != 0, F.lit(False))

    signals = [
        (filled_number(col("salary_min")) | filled_number(col("salary_max")), "1.0", "Salary disclosed"),
        (~text_or_empty(col("company_name")).isin(fv.PLACEHOLDER_COMPANIES), "0.5", "Named company"),
        (F.size(col("tech_stack")) >= 2, "1.0", "Tech stack listed"),
        (F.length(col("description")) > 100, "0.5", "Detailed description"),
        (F.contains(col("apply_url"), F.lit("http")), "0.5", "Direct apply link"),
        (col("company_type") == "vc_backed", "0.5", "VC-backed"),
        (col("visa_sponsorship"), "0.3", "Visa sponsorship"),
        (F.size(col("source_platforms")) >= 2, "0.5", "Multi-source verified"),
        (days <= 1, "1.0", "Posted today"),
        ((days > 1) & (days <= 3), "0.7", "Posted this week"),
        ((days > 3) & (days <= 7), "0.3", "Recent"),
    ]
    zero = F.lit("0.0").cast("decimal(4,1)")
    points = [F.when(hit, F.lit(p).cast("decimal(4,1)")).otherwise(zero) for hit, p, _ in signals]
    total = points[0]
    for p in points[1:]:
        total = (total + p).cast("decimal(4,1)")
    stars = F.least(F.lit(5), F.greatest(F.lit(1), F.bround(total, 0).cast("int")))
    reasons = F.array_compact(F.array(*[F.when(hit, F.lit(why)) for hit, _, why in signals]))
    return F.struct(stars.alias("stars"), total.cast("double").alias("raw_score"), reasons.alias("reasons"))

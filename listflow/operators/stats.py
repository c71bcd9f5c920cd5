"""Counts and breakdowns, each in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from listflow.functions import fixed_values as fv
from listflow.functions.dates import days_before
from listflow.functions.rules import found_terms
from listflow.functions.text import strip, text_or_empty
from listflow.operators.search import unexpired


def dashboard(df: DataFrame, as_of) -> DataFrame:
    """Eight conditional counts over active, unexpired listings in one scan."""
    return df.where(unexpired(as_of)).agg(
        F.count("*").alias("total_jobs"),
        F.count_if(F.col("remote_type") == "remote").alias("remote_jobs"),
        F.count_if(F.col("company_type") == "vc_backed").alias("vc_backed_jobs"),
        F.count_if(F.col("is_stealth")).alias("stealth_jobs"),
        F.count_if(F.col("company_type") == "big_tech").alias("big_tech_jobs"),
        F.count_if(F.col("visa_sponsorship")).alias("visa_jobs"),
        F.count_if(F.col("relocation_support")).alias("relo_jobs"),
        F.count_if(F.col("is_featured")).alias("featured_jobs"),
    )


def breakdown(df: DataFrame, domains: dict[str, list[str]]) -> DataFrame:
    """Rows per value of each domain, values without rows included.

    ``domains`` maps a column to its values. One global aggregate of counters
    and an unpivot of its single row: no grouping shuffle, no join for zeros.
    """
    cells = [(c, v) for c, values in domains.items() for v in values]
    counts = df.agg(*[F.count_if(F.col(c) == v).alias(f"n{i}") for i, (c, v) in enumerate(cells)])
    rows = F.array(
        *[
            F.struct(F.lit(c).alias("facet"), F.lit(v).alias("value"), F.col(f"n{i}").alias("n"))
            for i, (c, v) in enumerate(cells)
        ]
    )
    return counts.select(F.inline(rows))


def region_breakdown(df: DataFrame, region: Column) -> DataFrame:
    """Active listings of a region by level, job type and remote type."""
    return breakdown(
        df.where(F.col("is_active") & region),
        {
            "experience_level": fv.EXPERIENCE_LEVELS,
            "job_type": fv.JOB_TYPES,
            "remote_type": fv.REMOTE_TYPES,
        },
    )


def trending_terms(
    df: DataFrame, as_of, days: int = fv.TRENDING_DAYS, limit: int = 20,
    title_terms: list[str] = fv.TRENDING_TITLE_TERMS,
) -> DataFrame:
    """Most frequent tags and title terms of recent active listings.

    Every recent listing counts. Ties go by the term.
    """
    tags = F.transform(
        F.coalesce(F.col("tech_stack"), F.array().cast("array<string>")), lambda t: strip(F.lower(t))
    )
    tags = F.filter(tags, lambda t: F.length(t) > 1)
    titles = found_terms(F.lower(text_or_empty(F.col("title"))), title_terms)
    recent = df.where(F.col("is_active") & (F.col("posted_date") >= days_before(as_of, days)))
    return (
        recent.select(F.explode(F.concat(tags, titles)).alias("keyword"))
        .groupBy("keyword")
        .agg(F.count("*").alias("count"))
        .orderBy(F.desc("count"), "keyword")
        .limit(limit)
    )


def count_by_source(df: DataFrame, sources: str = "source_platforms") -> DataFrame:
    return df.select(F.explode(sources).alias("source")).groupBy("source").agg(F.count("*").alias("n"))


def as_map(counts: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """A small count table as one map, keys in order."""
    entries = F.array_sort(F.collect_list(F.struct(F.col(key), F.col(value))))
    return counts.where(F.col(key).isNotNull()).agg(F.map_from_entries(entries).alias(name))


def tier_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("match_tier").agg(F.count("*").alias("n"), F.count_if("is_new").alias("n_new"))


def active_counts(df: DataFrame) -> DataFrame:
    return df.agg(F.count_if("is_active").alias("active"), F.count_if(~F.col("is_active")).alias("inactive"))


def progress(count: Column, target: int) -> Column:
    """Whole per cent of a target."""
    return F.floor(count * 100 / F.lit(max(target, 1)))


def load_report(df: DataFrame, action: str = "action", reason: str = "reason") -> DataFrame:
    return df.groupBy(action, reason).agg(F.count("*").alias("n"))


def new_per_window(df: DataFrame, ts: str, width: str = "10 minutes") -> DataFrame:
    """Rows per tumbling window."""
    windows = df.groupBy(F.window(F.col(ts).cast("timestamp"), width)).agg(F.count("*").alias("n"))
    return windows.select(F.col("window.start").alias("window_start"), "n")

"""Set-based update jobs over the listing table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from listflow.functions import classify as C, fixed_values as fv
from listflow.functions.dates import as_timestamp, days_before
from listflow.functions.text import text_or_empty
from listflow.operators.quality import recoverable
from listflow.operators.upsert import update_where


def expire(df: DataFrame, as_of, days: int = fv.EXPIRY_DAYS) -> DataFrame:
    """Deactivate active listings posted before the cut-off; no date never expires."""
    old = F.col("is_active") & (F.col("posted_date") < days_before(as_of, days))
    return update_where(df, old, {"is_active": F.lit(False), "updated_at": as_timestamp(as_of)})


def recover(df: DataFrame, as_of, days: int = fv.EXPIRY_DAYS) -> DataFrame:
    """Reactivate valid inactive listings that are young enough, and classify them again."""
    hit = (
        ~F.col("is_active")
        & (F.col("posted_date") >= days_before(as_of, days))
        & recoverable(F.col("title"), F.col("company_name"), F.col("apply_url"))
    )
    values = {
        "experience_level": C.recovery_level(F.col("title")),
        "job_type": C.job_type(F.col("title")),
        "remote_type": C.clamp_remote(F.col("remote_type")),
        "updated_at": as_timestamp(as_of),
        "is_active": F.lit(True),
    }
    return update_where(df, hit, values)


def recategorize(df: DataFrame, as_of) -> DataFrame:
    """Correct active listings whose level or remote type is wrong or whose job type is blank."""
    level = C.recovery_level(F.col("title"))
    remote = C.clamp_remote(F.col("remote_type"))
    wrong = F.col("is_active") & (
        ~F.col("experience_level").eqNullSafe(level)
        | ~F.col("remote_type").eqNullSafe(remote)
        | (text_or_empty(F.col("job_type")) == "")
    )
    values = {
        "experience_level": level,
        "job_type": C.job_type(F.col("title")),
        "remote_type": remote,
        "updated_at": as_timestamp(as_of),
    }
    return update_where(df, wrong, values)


def in_home_region(country: Column) -> Column:
    return F.contains(F.lower(country), F.lit("india")) | (country == "IN")


def reactivate_region(df: DataFrame, as_of) -> DataFrame:
    """Reactivate home-region listings without a foreign sign in title or currency."""
    ok = C.home_region_ok(F.col("title"), F.col("salary_currency"), F.lit(""))
    hit = ~F.col("is_active") & in_home_region(F.col("location_country")) & ok
    values = {
        "experience_level": C.experience_level(F.col("title")),
        "updated_at": as_timestamp(as_of),
        "is_active": F.lit(True),
    }
    return update_where(df, hit, values)


def changes(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Rows whose active flag a job changed, by direction."""
    b = before.select(key, F.col("is_active").alias("was"))
    a = after.select(key, F.col("is_active").alias("now"))
    moved = b.join(a, key).where(~F.col("was").eqNullSafe(F.col("now")))
    return moved.groupBy("was", "now").agg(F.count("*").alias("n"))


def one_default(df: DataFrame, user: str, newest: list[Column], flag: str = "is_default") -> DataFrame:
    """Only a user's newest row carries the flag.

    One aggregate per user and a join instead of a window over whole users, so
    no task has to sort a very large user.
    """
    top = df.groupBy(user).agg(F.max(F.struct(*newest)).alias("_top"))
    joined = df.join(top, user)
    return joined.withColumn(flag, F.struct(*newest) == F.col("_top")).drop("_top")


def drop_failed(df: DataFrame, retry: DataFrame, keys: list[str]) -> DataFrame:
    """Remove failed or status-less applications of the pairs that are tried again."""
    stale = F.coalesce(F.col("status") == "failed", F.lit(True))
    marks = retry.select(*keys).distinct().withColumn("_retry", F.lit(True))
    marked = df.join(marks, keys, "left")
    return marked.where(~(F.col("_retry").isNotNull() & stale)).drop("_retry")


def patch(df: DataFrame, updates: DataFrame, key: str, columns: list[str], as_of=None) -> DataFrame:
    """Overwrite only with supplied non-empty values."""
    new = updates.select(key, F.lit(True).alias("_hit"), *[F.col(c).alias(f"_new_{c}") for c in columns])
    joined = df.join(new, key, "left")
    values = {c: F.coalesce(F.nullif(F.col(f"_new_{c}"), F.lit("")), F.col(c)) for c in columns}
    if as_of is not None and "updated_at" in df.columns:
        values["updated_at"] = F.when(F.col("_hit"), as_timestamp(as_of)).otherwise(F.col("updated_at"))
    return joined.withColumns(values).select(*df.columns)


def latest_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Current state of a change log: the last row of each key."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")

"""Per-user tables: saved listings, applications, profiles and résumés."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from listflow.functions.text import blank_to_null, first_name, last_name
from listflow.operators.matching import top_per_group


def tenant_view(df: DataFrame, user_id: object, column: str = "user_id") -> DataFrame:
    """Only the rows of one user; every per-user read goes through this."""
    return df.where(F.col(column) == F.lit(user_id))


def newest_first(df: DataFrame, ts: str, tie: str = "id") -> DataFrame:
    return df.orderBy(F.desc(ts), F.asc(tie))


def with_listing(actions: DataFrame, listings: DataFrame, job: str = "job_id", key: str = "id") -> DataFrame:
    """Left join with the listing embedded as the struct ``jobs`` (null when it is gone).

    The listing side has unique keys, so a listing that very many users saved
    is split by the skew handling of the join.
    """
    packed = listings.select(F.col(key).alias(job), F.struct(*listings.columns).alias("jobs"))
    return actions.join(packed, job, "left")


def page_per_user(df: DataFrame, user: str, order: list[Column], page: int = 1, per_page: int = 20) -> DataFrame:
    """One page of each user's rows."""
    ranked = top_per_group(df, [user], order, page * per_page, rank="position")
    return ranked.where(F.col("position") > (page - 1) * per_page)


def listings_only(joined: DataFrame) -> DataFrame:
    """The listings of joined rows, rows without one dropped."""
    return joined.where(F.col("jobs").isNotNull()).select("jobs.*")


def direct_applications(df: DataFrame) -> DataFrame:
    """Applications made in the app; a missing method is dropped as well."""
    return df.where(F.col("apply_method") != "external")


def shown_applications(df: DataFrame) -> DataFrame:
    """Applications that did not fail."""
    return df.where(~F.coalesce(F.col("status") == "failed", F.lit(False)))


def cascade(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Children whose parent still exists."""
    keys = parents.select(F.col(parent_key).alias(child_key)).distinct()
    return children.join(keys, child_key, "left_semi")


def with_default_resume(users: DataFrame, resumes: DataFrame, user: str = "user_id", newest: list[Column] | None = None) -> DataFrame:
    """Add the URL and name of each user's default résumé, null without one."""
    order = newest or [F.desc("uploaded_at"), F.asc("id")]
    default = top_per_group(resumes.where("is_default"), [user], order, 1)
    picked = default.select(user, F.col("file_url").alias("resume_url"), F.col("file_name").alias("resume_filename"))
    return users.join(picked, user, "left")


def fill_from_profile(forms: DataFrame, profiles: DataFrame, user: str, columns: dict[str, str]) -> DataFrame:
    """Blank form values come from the profile; ``columns`` maps form to profile column."""
    saved = profiles.select(F.col(user), *[F.col(p).alias(f"_saved_{f}") for f, p in columns.items()])
    joined = forms.join(saved, user, "left")
    filled = {f: F.coalesce(blank_to_null(F.col(f)), F.col(f"_saved_{f}"), F.lit("")) for f in columns}
    return joined.withColumns(filled).select(*forms.columns)


def form_prefill(profiles: DataFrame) -> DataFrame:
    """First and last name and the plain fields of an application form."""
    name = F.col("full_name")
    plain = ["email", "phone", "linkedin_url", "portfolio_url", "location"]
    return profiles.select(
        "id",
        first_name(name).alias("first_name"),
        last_name(name).alias("last_name"),
        F.coalesce(name, F.lit("")).alias("name"),
        *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in plain],
        F.coalesce(F.col("current_company"), F.lit("")).alias("org"),
        F.coalesce(F.col("cover_letter_default"), F.lit("")).alias("cover_letter"),
    )


def new_profiles(users: DataFrame, profiles: DataFrame, meta: str = "raw_user_meta_data") -> DataFrame:
    """Profiles to append for users that have none; the name falls back to the e-mail."""
    derived = users.select(
        "id", "email", F.coalesce(F.get_json_object(meta, "$.full_name"), F.col("email")).alias("full_name")
    )
    return derived.join(profiles.select("id"), "id", "left_anti")

"""Table schemas and the projection that aligns a DataFrame to one."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

_TYPES = {
    "string": T.StringType(),
    "boolean": T.BooleanType(),
    "double": T.DoubleType(),
    "money": T.DecimalType(18, 2),
    "rating": T.DecimalType(3, 2),
    "int": T.IntegerType(),
    "long": T.LongType(),
    "timestamp": T.TimestampType(),
    "strings": T.ArrayType(T.StringType()),
    "floats": T.ArrayType(T.FloatType()),
}


def table_schema(**columns: str) -> T.StructType:
    """``table_schema(string="id title", boolean="is_active")``; order is by group."""
    return T.StructType(
        [T.StructField(name, _TYPES[kind]) for kind, names in columns.items() for name in names.split()]
    )


LISTINGS = table_schema(
    string=(
        "id dedup_hash title company_name company_logo_url company_size company_industry"
        " company_type vc_backer funding_stage location_city location_country remote_type"
        " work_authorization salary_currency salary_period experience_level job_type"
        " description apply_url ats_detected direct_apply_ats ats_job_id ats_board_token"
    ),
    money="salary_min salary_max",
    int="years_experience_min years_experience_max",
    boolean=(
        "visa_sponsorship relocation_support easy_apply is_stealth is_active is_featured"
        " direct_apply_supported"
    ),
    strings=(
        "responsibilities requirements benefits skills_required skills_preferred tech_stack"
        " source_platforms"
    ),
    timestamp="posted_date expiry_date created_at updated_at last_seen_at",
    floats="embedding",
)
COMPANIES = table_schema(
    string=(
        "id name slug logo_url description industry company_type size headquarters"
        " website_url careers_url funding_stage total_funding"
    ),
    int="founded_year",
    strings="vc_backers",
    rating="glassdoor_rating",
    boolean="is_stealth",
    timestamp="created_at updated_at",
)
PROFILES = table_schema(
    string=(
        "id full_name email avatar_url resume_url preferences phone linkedin_url"
        " portfolio_url cover_letter_default location current_company"
    ),
    floats="resume_embedding",
    timestamp="created_at updated_at",
)
SAVED = table_schema(string="id user_id job_id", timestamp="created_at")
APPLICATIONS = table_schema(
    string=(
        "id user_id job_id status notes apply_method ats_response resume_used"
        " cover_letter_used submission_steps"
    ),
    timestamp="applied_at",
)
ALERT_FILTERS = table_schema(
    string=(
        "q location remote_type experience_level job_type company_type vc_backer source"
        " posted_within"
    ),
    double="salary_min salary_max",
    boolean="visa_sponsorship relocation_support",
    strings="tech_stack",
)
ALERTS = T.StructType(
    table_schema(string="id user_id name frequency", boolean="is_active").fields
    + [T.StructField("filters", ALERT_FILTERS)]
    + table_schema(timestamp="last_triggered_at created_at").fields
)
RESUMES = table_schema(
    string="id user_id file_name file_url", int="file_size", boolean="is_default", timestamp="uploaded_at",
)
LISTING_ARRAYS = [f.name for f in LISTINGS if f.dataType == _TYPES["strings"]]


def align_to_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Keep the schema's columns in its order, cast, and fill missing ones with null."""
    have = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema
        ]
    )


def ranking_columns() -> list[str]:
    """The projection that ranking reads; nothing else is scanned."""
    return (
        "id title company_name company_logo_url location_city location_country remote_type"
        " salary_min salary_max salary_currency experience_level job_type description"
        " tech_stack apply_url visa_sponsorship relocation_support source_platforms"
        " posted_date is_featured vc_backer company_type"
    ).split()

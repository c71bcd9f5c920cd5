"""Enrichment of whole rows where one classification feeds several columns.

Each result that is used more than once gets a projection of its own, so the
rule table behind it is evaluated once per row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from listflow.functions import classify as C, fixed_values as fv


def with_ats(df: DataFrame, company: str = "company_name", url: str = "apply_url", name: str = "ats_detected") -> DataFrame:
    """Add the ATS label from URL, company and subdomain."""
    df = df.withColumns({"_by_url": C.ats_from_url(F.col(url)), "_by_company": C.ats_from_company(F.col(company))})
    return df.withColumn(name, C.ats_label(F.col("_by_url"), F.col("_by_company"), F.col(url))).drop("_by_url", "_by_company")


def with_bulk_ats(df: DataFrame, company: str = "company_name", url: str = "apply_url", name: str = "ats_detected") -> DataFrame:
    return df.withColumn(name, C.bulk_ats_label(C.ats_from_url(F.col(url)), F.col(company)))


def with_direct_apply(df: DataFrame, ats: str = "ats_detected", url: str = "apply_url") -> DataFrame:
    """Add the supported provider and the ids in the URL, null when unsupported."""
    info = df.withColumn("_direct", C.direct_apply(F.col(ats), F.col(url)))
    fields = ("direct_apply_supported", "direct_apply_ats", "ats_board_token", "ats_job_id")
    return info.withColumns({f: F.col(f"_direct.{f}") for f in fields}).drop("_direct")


def with_company_kind(df: DataFrame, company: str = "company_name") -> DataFrame:
    """Fill blank company type, backer and stealth flag from the name."""
    df = _with_missing(df, company_type="string", vc_backer="string", is_stealth="boolean")
    filled = C.fill_company_kind(F.col("_kind"), F.col("company_type"), F.col("vc_backer"), F.col("is_stealth"))
    df = df.withColumn("_kind", C.company_kind(F.col(company))).withColumn("_filled", filled)
    fields = ("company_type", "vc_backer", "is_stealth")
    return df.withColumns({f: F.col(f"_filled.{f}") for f in fields}).drop("_kind", "_filled")


def with_perks(df: DataFrame, title: str = "title", description: str = "description") -> DataFrame:
    """Raise the visa and relocation flags when title or description mention them."""
    df = _with_missing(df, visa_sponsorship="boolean", relocation_support="boolean")
    df = df.withColumn("_text", C.lowered(F.col(title), F.col(description)))
    flags = {
        "visa_sponsorship": C.raise_flag(F.col("visa_sponsorship"), F.col("_text"), fv.PERK_VISA),
        "relocation_support": C.raise_flag(F.col("relocation_support"), F.col("_text"), fv.PERK_RELOCATION),
    }
    return df.withColumns(flags).drop("_text")


def _with_missing(df: DataFrame, **columns: str) -> DataFrame:
    missing = {n: F.lit(None).cast(kind) for n, kind in columns.items() if n not in df.columns}
    return df.withColumns(missing) if missing else df

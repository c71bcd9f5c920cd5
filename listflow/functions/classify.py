"""Classifiers over listing columns, all built on the ordered rules."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from listflow.functions import fixed_values as fv
from listflow.functions.rules import (
    classify, first_match, found_terms, has_any, has_word, let, lookup, term_array,
)
from listflow.functions.text import WS, WORD_CHARS, plain_spaces, strip, text_or_empty


def lowered(*cols: Column) -> Column:
    """The columns joined by a space, in lower case, nulls as empty text."""
    return F.lower(F.concat_ws(" ", *[text_or_empty(c) for c in cols]))


# ------------------------------------------------------------ company type
def company_kind(name: Column) -> Column:
    """Struct ``(company_type, vc_backer, is_stealth)`` from a company name."""
    def kind(label: str, hidden: bool = False) -> Column:
        return F.struct(
            F.lit(label).alias("company_type"), F.lit(None).cast("string").alias("vc_backer"),
            F.lit(hidden).alias("is_stealth"),
        )

    def backed(backer: Column) -> Column:
        label = F.when(backer.isNotNull(), "vc_backed").otherwise("other")
        return F.struct(label.alias("company_type"), backer.alias("vc_backer"), F.lit(False).alias("is_stealth"))

    def tiers(text: Column) -> Column:
        stealth = F.rlike(text, F.lit("|".join(f"(?:{p})" for p in fv.STEALTH_PATTERNS)))
        # A name that is itself part of a known name counts too.
        big = F.exists(term_array(fv.BIG_TECH), lambda c: F.contains(text, c) | F.contains(c, text))
        return (
            F.when(stealth, kind("stealth", hidden=True))
            .when(big, kind("big_tech"))
            .otherwise(let(classify(text, fv.VC_PORTFOLIOS), backed))
        )

    named = F.coalesce(name, F.lit("")) != ""
    return F.when(named, let(strip(F.lower(name)), tiers)).otherwise(kind("other"))


def fill_company_kind(found: Column, company_type: Column, vc_backer: Column, is_stealth: Column) -> Column:
    """A :func:`company_kind` result used only where the stored values are blank or false."""
    return F.struct(
        F.coalesce(F.nullif(company_type, F.lit("")), found["company_type"]).alias("company_type"),
        F.coalesce(F.nullif(vc_backer, F.lit("")), found["vc_backer"]).alias("vc_backer"),
        (F.coalesce(is_stealth, F.lit(False)) | found["is_stealth"]).alias("is_stealth"),
    )


def bulk_company_type(name: Column, description: Column) -> Column:
    company, text = F.lower(text_or_empty(name)), F.lower(text_or_empty(description))
    return first_match(
        [
            ("big_tech", has_any(company, fv.BULK_BIG_TECH)),
            ("stealth", company.contains("stealth")),
            ("vc_backed", has_any(text, fv.BULK_FUNDING_PHRASES)),
        ],
        "startup",
    )


def employee_estimate(company_type: Column) -> Column:
    return F.coalesce(lookup(company_type, fv.EMPLOYEE_ESTIMATES), F.lit(fv.EMPLOYEE_ESTIMATE_DEFAULT))


# ------------------------------------------------------------ perks
def raise_flag(flag: Column, text: Column, phrases: list[str]) -> Column:
    """Keep a true flag; otherwise true when the lower-case text has a phrase; never lowers."""
    return F.when(F.coalesce(flag, F.lit(False)) | has_any(text, phrases), F.lit(True)).otherwise(flag)


def mentions(text: Column, phrases: list[str]) -> Column:
    return let(F.lower(text_or_empty(text)), lambda x: has_any(x, phrases))


# ------------------------------------------------------------ level and job type
def _abbreviated(text: Column, short: str) -> Column:
    return F.rlike(text, F.lit(rf"(?<![{WORD_CHARS}]){short}(?:\.?{WS}|$)"))


def experience_level(title: Column) -> Column:
    """Whole-word level of a title: intern, principal, staff, lead, senior, junior, else mid."""
    text = strip(F.lower(text_or_empty(title)))
    cases = []
    for level, words in fv.LEVEL_WORDS:
        hit = has_word(text, words)
        if level in fv.LEVEL_ABBREVIATIONS:
            hit = hit | _abbreviated(text, fv.LEVEL_ABBREVIATIONS[level])
        cases.append((level, hit))
    return first_match(cases, fv.DEFAULT_LEVEL)


def recovery_level(title: Column) -> Column:
    """The recovery job's rule set: fewer words, abbreviations only before white space."""
    text = strip(F.lower(text_or_empty(title)))
    cases = []
    for level, words in fv.RECOVERY_LEVEL_WORDS:
        hit = has_word(text, words)
        if level in fv.LEVEL_ABBREVIATIONS:
            short = fv.LEVEL_ABBREVIATIONS[level]
            hit = hit | F.rlike(text, F.lit(rf"(?<![{WORD_CHARS}]){short}\.?{WS}"))
        cases.append((level, hit))
    return first_match(cases, fv.DEFAULT_LEVEL)


def page_level(title: Column) -> Column:
    """Substring rule set of the page feeds."""
    return classify(F.lower(text_or_empty(title)), fv.PAGE_LEVEL_TERMS, fv.DEFAULT_LEVEL)


def job_type(*texts: Column) -> Column:
    return classify(lowered(*texts), fv.JOB_TYPE_TERMS, fv.DEFAULT_JOB_TYPE)


def normalize_job_type(raw: Column) -> Column:
    """Known synonyms map; other values pass through; blank is null."""
    raw = F.nullif(raw, F.lit(""))
    return F.coalesce(lookup(F.lower(raw), fv.JOB_TYPE_SYNONYMS), raw)


def clean_job_type(raw: Column) -> Column:
    """Pre-insert clean-up: lower, strip, map, and full-time when blank."""
    text = strip(F.lower(text_or_empty(raw)))
    mapped = F.coalesce(lookup(text, fv.JOB_TYPE_CLEANUP), text)
    return F.coalesce(F.nullif(mapped, F.lit("")), F.lit(fv.DEFAULT_JOB_TYPE))


def feed_level(level: Column) -> Column:
    return lookup(F.lower(level), fv.FEED_LEVEL_NAMES)


def title_domain(title: Column) -> Column:
    return classify(F.lower(text_or_empty(title)), fv.TITLE_DOMAINS, fv.DEFAULT_TITLE_DOMAIN)


# ------------------------------------------------------------ place and remote
def remote_from_text(text: Column, hybrid_words: list[str] = fv.PAGE_HYBRID_WORDS) -> Column:

    def run(t: Column) -> Column:
        return (
            F.when(has_any(t, fv.REMOTE_WORDS), F.when(has_any(t, hybrid_words), "hybrid").otherwise("remote"))
            .when(t.contains("hybrid"), "hybrid")
            .otherwise("onsite")
        )

    return let(F.lower(text_or_empty(text)), run)


def remote_from_flag(flag: Column) -> Column:
    return F.when(F.coalesce(flag, F.lit(False)), "remote").otherwise("onsite")


def clamp_remote(value: Column) -> Column:
    """Recovery: the lower-case value when it is in the domain, else onsite."""
    text = strip(F.lower(text_or_empty(value)))
    return F.when(text.isin(fv.REMOTE_TYPES), text).otherwise("onsite")


def keep_valid_remote(value: Column) -> Column:
    """Pre-insert: a valid value is kept as written, else onsite."""
    text = strip(F.lower(text_or_empty(value)))
    return F.when(text.isin(fv.REMOTE_TYPES), value).otherwise("onsite")


def country_name(country: Column) -> Column:
    """Two-letter codes become names; other values are kept."""
    return F.coalesce(lookup(strip(F.lower(country)), fv.COUNTRY_NAMES), country)


def feed_country_code(location: Column) -> Column:
    """Country endpoint of a feed: first name contained in the location, default us."""
    rules = [(code, [name]) for name, code in fv.FEED_COUNTRY_CODES]
    return classify(F.lower(text_or_empty(location)), rules, "us")


def feed_category(query: Column) -> Column:
    rules = [(category, [word]) for word, category in fv.FEED_CATEGORIES]
    return classify(F.lower(text_or_empty(query)), rules)


def is_home_country(country: Column) -> Column:
    return F.coalesce(F.lower(country).isin("india", "in"), F.lit(False))


def home_region_ok(title: Column, currency: Column, description: Column, window: int | None = None) -> Column:
    """False when the title, the currency or the description shows a foreign listing.

    The whole description counts, or its first ``window`` characters.
    """
    t, d = F.lower(text_or_empty(title)), F.lower(text_or_empty(description))
    return ~(
        has_word(t, fv.FOREIGN_COUNTRIES + fv.FOREIGN_CITIES)
        | F.lower(text_or_empty(currency)).isin(fv.FOREIGN_CURRENCIES)
        | F.rlike(plain_spaces(d if window is None else F.left(d, F.lit(window))), F.lit(fv.FOREIGN_SALARY_PATTERN))
    )


# ------------------------------------------------------------ ATS
def ats_from_url(url: Column) -> Column:
    return classify(F.lower(url), fv.ATS_URL_RULES)


def ats_from_company(name: Column) -> Column:
    """Exact name first, then the first known name contained in it."""
    text = strip(F.lower(name))
    return F.coalesce(ats_of_exact_name(text), classify(text, fv.ATS_COMPANY_RULES))


def ats_label(by_url: Column, by_company: Column, url: Column) -> Column:
    """URL, company and subdomain evidence combined; never null.

    Takes the results of :func:`ats_from_url` and :func:`ats_from_company`, so
    that a caller can compute each once; see ``operators.enrich.with_ats``.
    """
    return F.coalesce(
        F.when(by_url.isin(fv.ATS_AGGREGATORS), by_company),
        by_url,
        by_company,
        classify(F.lower(url), fv.ATS_SUBDOMAIN_RULES),
        F.lit(fv.ATS_UNKNOWN),
    )


def ats_of_exact_name(name: Column) -> Column:
    exact = {term: label for label, terms in fv.ATS_COMPANY_RULES for term in terms}
    return lookup(name, exact)


def bulk_ats_label(by_url: Column, name: Column) -> Column:
    """URL evidence, else the exact company name, else unknown."""
    return F.coalesce(by_url, ats_of_exact_name(F.lower(name)), F.lit(fv.ATS_UNKNOWN))


def ats_ids(provider: str, url: Column) -> Column:
    """Struct ``(board, job)`` from a provider's URL; null when no pattern fits."""
    patterns = dict(fv.ATS_ID_PATTERNS)[provider]
    cases = None
    for p in patterns:
        board = F.regexp_extract(url, f"(?i){p}", 1)
        ids = F.struct(board.alias("board"), F.regexp_extract(url, f"(?i){p}", 2).alias("job"))
        hit = F.rlike(url, F.lit(f"(?i){p}"))
        cases = F.when(hit, ids) if cases is None else cases.when(hit, ids)
    return cases


def direct_apply(ats: Column, url: Column) -> Column:
    """Struct with the supported provider and its ids; null when unsupported."""
    out = None
    for provider in fv.DIRECT_APPLY_PROVIDERS:
        ids = ats_ids(provider, url)
        info = F.struct(
            F.lit(True).alias("direct_apply_supported"),
            F.lit(provider.lower()).alias("direct_apply_ats"),
            ids["board"].alias("ats_board_token"),
            ids["job"].alias("ats_job_id"),
        )
        hit = F.contains(F.lower(ats), F.lit(provider.lower()))
        out = F.when(hit, info) if out is None else out.when(hit, info)
    return out


def is_aggregator_url(url: Column) -> Column:
    return has_any(F.lower(text_or_empty(url)), fv.AGGREGATOR_URL_TERMS)


def has_direct_apply(direct_apply_ats: Column) -> Column:
    return has_any(F.lower(text_or_empty(direct_apply_ats)), ["greenhouse", "lever"])


# ------------------------------------------------------------ candidates
def candidate_level(parsed_level: Column, resume_text: Column, years: Column) -> Column:
    """A valid parsed level, else words of the résumé, else years of experience."""
    parsed = strip(F.lower(text_or_empty(parsed_level)))
    text = F.lower(text_or_empty(resume_text))
    years = F.coalesce(years.cast("double"), F.lit(0.0))
    by_years = first_match([(lv, years <= top) for lv, top in fv.RESUME_LEVEL_YEARS], fv.RESUME_LEVEL_DEFAULT)
    return F.coalesce(
        F.when(parsed.isin(fv.RESUME_LEVELS), parsed),
        classify(text, fv.RESUME_LEVEL_TERMS),
        by_years,
    )


def skill_domain(skills: Column, text: Column) -> Column:
    """Domain with most keywords in the text or the skills; the first of equals; at least 2."""
    default = F.struct(F.lit(fv.SKILL_DOMAIN_MIN - 1).alias("n"), F.lit(1).alias("r"), F.lit(fv.SKILL_DOMAIN_DEFAULT).alias("name"))

    def run(t: Column) -> Column:
        scored = []
        for rank, (name, words) in enumerate(fv.SKILL_DOMAINS):
            hit = F.filter(term_array(words), lambda w: F.contains(t, w) | F.coalesce(F.array_contains(skills, w), F.lit(False)))
            # The lower rank wins among equal counts.
            scored.append(F.struct(F.size(hit).alias("n"), F.lit(-rank).alias("r"), F.lit(name).alias("name")))
        return F.array_max(F.array(default, *scored))["name"]

    return let(F.lower(text_or_empty(text)), run)


def text_skills(text: Column) -> Column:
    return found_terms(F.lower(text_or_empty(text)), fv.KNOWN_SKILLS)


def tier(score: Column, tiers: list[tuple[str, int]] = fv.MATCH_TIERS) -> Column:
    return first_match([(name, score >= low) for name, low in tiers], fv.TIER_DEFAULT)


def tier_or_stored(stored: Column, score: Column) -> Column:
    """A stored tier, else one from the score by the wider UI steps."""
    return F.coalesce(F.nullif(stored, F.lit("")), tier(score, fv.UI_TIERS))

"""Rule classifiers, text extraction, dates and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from listflow.functions import classify as C, dates as D, extract as X, fixed_values as fv, text as T
from listflow.functions.rules import lookup
from listflow.operators import dedup, enrich, matching
from listflow.sources.boards import page_links, usable_titles
from listflow.suite.keys import TITLE, sql_clamp, sql_job_type, sql_level, sql_recovery_level
from listflow.suite.registry import (
    WS, any_of, case, equals_any, list_col, matches, query, rule_case, trim_ws, ts_col, value_map,
)
from listflow.suite.views import EVENTS_AS_OF, LISTINGS_AS_OF, lit, listings, postings, table, texts

NAME = "lower(company_name)"
TEXT = "lower(coalesce(description, ''))"


# ------------------------------------------------------------------ companies
def sql_kind() -> tuple[str, str]:
    stealth = matches(NAME, "|".join(f"({p})" for p in fv.STEALTH_PATTERNS))
    big = "(" + " OR ".join(f"contains({NAME}, {lit(c)}) OR contains({lit(c)}, {NAME})" for c in fv.BIG_TECH) + ")"
    backer = rule_case(NAME, fv.VC_PORTFOLIOS)
    kind = case(
        [("other", "coalesce(company_name, '') = ''"), ("stealth", stealth), ("big_tech", big), ("vc_backed", f"{backer} IS NOT NULL")],
        "other",
    )
    return kind, f"CASE WHEN {kind} = 'vc_backed' THEN {backer} END"


KIND, BACKER = sql_kind()


@query(
    "company_kinds", "C-1 C-2",
    f"""SELECT id, {KIND} AS kind, {BACKER} AS backer, coalesce(nullif(company_type, ''), {KIND}) AS company_type,
        coalesce(nullif(vc_backer, ''), {BACKER}) AS vc_backer, coalesce(is_stealth, false) OR {KIND} = 'stealth' AS is_stealth FROM listings""",
)
def company_kinds(spark, sf):
    df = listings(spark, sf).withColumn("_k", C.company_kind(F.col("company_name")))
    df = df.select("*", F.col("_k.company_type").alias("kind"), F.col("_k.vc_backer").alias("backer"))
    return enrich.with_company_kind(df).select("id", "kind", "backer", "company_type", "vc_backer", "is_stealth")


@query(
    "bulk_company_types", "C-4 C-21",
    f"""WITH b AS (SELECT id, {case([('big_tech', any_of(NAME, fv.BULK_BIG_TECH)), ('stealth', f"contains({NAME}, 'stealth')"),
        ('vc_backed', any_of(TEXT, fv.BULK_FUNDING_PHRASES))], 'startup')} AS company_type FROM postings)
        SELECT id, company_type, {value_map('company_type', fv.EMPLOYEE_ESTIMATES, lit(fv.EMPLOYEE_ESTIMATE_DEFAULT))} AS employees FROM b""",
)
def bulk_company_types(spark, sf):
    df = postings(spark, sf).select("id", C.bulk_company_type(F.col("company_name"), F.col("description")).alias("company_type"))
    return df.withColumn("employees", C.employee_estimate(F.col("company_type")))


BOTH = f"(lower(title) || ' ' || {TEXT})"


@query(
    "perk_flags", "C-3",
    f"""SELECT id, CASE WHEN coalesce(visa_sponsorship, false) OR {any_of(BOTH, fv.PERK_VISA)} THEN true ELSE visa_sponsorship END AS visa_sponsorship,
        CASE WHEN coalesce(relocation_support, false) OR {any_of(BOTH, fv.PERK_RELOCATION)} THEN true ELSE relocation_support END AS relocation_support FROM listings""",
)
def perk_flags(spark, sf):
    return enrich.with_perks(listings(spark, sf)).select("id", "visa_sponsorship", "relocation_support")


@query(
    "perk_mentions", "C-12",
    f"""SELECT id, {any_of(TEXT, fv.PAGE_VISA)} AS page_visa, {any_of(TEXT, fv.PAGE_RELOCATION)} AS page_relocation,
        {any_of(TEXT, fv.BULK_VISA)} AS bulk_visa, {any_of(TEXT, fv.BULK_RELOCATION)} AS bulk_relocation FROM listings
        UNION ALL SELECT -1 - id, {any_of(TEXT, fv.PAGE_VISA)}, {any_of(TEXT, fv.PAGE_RELOCATION)},
        {any_of(TEXT, fv.BULK_VISA)}, {any_of(TEXT, fv.BULK_RELOCATION)} FROM postings""",
)
def perk_mentions(spark, sf):
    def flags(df, key):
        d = F.col("description")
        return df.select(
            key.alias("id"), C.mentions(d, fv.PAGE_VISA).alias("page_visa"), C.mentions(d, fv.PAGE_RELOCATION).alias("page_relocation"),
            C.mentions(d, fv.BULK_VISA).alias("bulk_visa"), C.mentions(d, fv.BULK_RELOCATION).alias("bulk_relocation"),
        )

    return flags(listings(spark, sf), F.col("id")).unionAll(flags(postings(spark, sf), -1 - F.col("id")))


# ------------------------------------------------------------------ levels, types, domains
@query(
    "experience_levels", "C-5 C-6 C-7 F-0",
    f"""SELECT id, {sql_level(TITLE)} AS level, {sql_recovery_level(TITLE)} AS recovery_level,
        {rule_case(TITLE, fv.PAGE_LEVEL_TERMS, 'mid')} AS page_level FROM listings""",
)
def experience_levels(spark, sf):
    t = F.col("title")
    return listings(spark, sf).select(
        "id", C.experience_level(t).alias("level"), C.recovery_level(t).alias("recovery_level"), C.page_level(t).alias("page_level")
    )


@query(
    "job_types", "C-8 X-3",
    f"""SELECT id, {sql_job_type(BOTH)} AS from_text,
        coalesce({value_map("lower(nullif(job_type, ''))", fv.JOB_TYPE_SYNONYMS)}, nullif(job_type, '')) AS synonym FROM listings""",
)
def job_types(spark, sf):
    return listings(spark, sf).select(
        "id", C.job_type(F.col("title"), F.col("description")).alias("from_text"),
        C.normalize_job_type(F.col("job_type")).alias("synonym"),
    )


@query("title_domains", "C-9", f"SELECT id, {rule_case(TITLE, fv.TITLE_DOMAINS, 'Software Engineering')} AS domain FROM listings")
def title_domains(spark, sf):
    return listings(spark, sf).select("id", C.title_domain(F.col("title")).alias("domain"))


def sql_remote(t: str, hybrid: list[str]) -> str:
    far = any_of(t, fv.REMOTE_WORDS)
    return case([("hybrid", f"{far} AND {any_of(t, hybrid)}"), ("remote", far), ("hybrid", f"contains({t}, 'hybrid')")], "onsite")


@query(
    "remote_types", "C-10 C-11",
    f"""SELECT id, {sql_remote(BOTH, fv.PAGE_HYBRID_WORDS)} AS page_remote, {sql_remote(BOTH, ['hybrid'])} AS bulk_remote,
        {sql_clamp('remote_type')} AS clamped, CASE WHEN visa_sponsorship THEN 'remote' ELSE 'onsite' END AS from_flag FROM listings""",
)
def remote_types(spark, sf):
    both = F.concat_ws(" ", F.col("title"), F.coalesce(F.col("description"), F.lit("")))
    return listings(spark, sf).select(
        "id", C.remote_from_text(both).alias("page_remote"), C.remote_from_text(both, fv.BULK_HYBRID_WORDS).alias("bulk_remote"),
        C.clamp_remote(F.col("remote_type")).alias("clamped"), C.remote_from_flag(F.col("visa_sponsorship")).alias("from_flag"),
    )


# ------------------------------------------------------------------ ATS
URL = "lower(apply_url)"
ATS_URL = rule_case(URL, fv.ATS_URL_RULES)
_EXACT = {t: label for label, terms in fv.ATS_COMPANY_RULES for t in terms}
ATS_COMPANY = f"coalesce({value_map(f'trim({NAME})', _EXACT)}, {rule_case(NAME, fv.ATS_COMPANY_RULES)})"
ATS = f"""coalesce(CASE WHEN {equals_any(ATS_URL, fv.ATS_AGGREGATORS)} THEN {ATS_COMPANY} END, {ATS_URL}, {ATS_COMPANY},
  {rule_case(URL, fv.ATS_SUBDOMAIN_RULES)}, 'Unknown ATS')"""


@query(
    "ats_labels", "C-13 C-14 C-15 C-16",
    f"""SELECT id, {ATS_URL} AS by_url, {ATS_COMPANY} AS by_company, {ATS} AS ats_detected,
        coalesce({ATS_URL}, {value_map(NAME, _EXACT)}, 'Unknown ATS') AS bulk_label FROM listings""",
)
def ats_labels(spark, sf):
    n, u = F.col("company_name"), F.col("apply_url")
    df = listings(spark, sf).select("id", "company_name", "apply_url", C.ats_from_url(u).alias("by_url"), C.ats_from_company(n).alias("by_company"))
    return df.select(
        "id", "by_url", "by_company", C.ats_label(F.col("by_url"), F.col("by_company"), u).alias("ats_detected"),
        C.bulk_ats_label(F.col("by_url"), n).alias("bulk_label"),
    )


@query(
    "ats_labels_pages", "C-13 C-15",
    f"SELECT page_id, {rule_case('lower(url)', fv.ATS_URL_RULES)} AS by_url FROM pages",
)
def ats_labels_pages(spark, sf):
    return table(spark, sf, "pages").select("page_id", C.ats_from_url(F.col("url")).alias("by_url"))


def _sql_ids(provider: str, group: int) -> str:
    patterns = dict(fv.ATS_ID_PATTERNS)[provider]
    whens = " ".join(
        f"WHEN {matches('apply_url', '(?i)' + p)} THEN regexp_extract(apply_url, {lit('(?i)' + p)}, {group})" for p in patterns
    )
    return f"CASE {whens} END"


_PROVIDERS = [p for p, _ in fv.ATS_ID_PATTERNS]


@query(
    "ats_url_ids", "X-16",
    "SELECT id, " + ", ".join(
        f"{_sql_ids(p, 1)} AS {p.lower().replace(' ', '_')}_board, {_sql_ids(p, 2)} AS {p.lower().replace(' ', '_')}_job" for p in _PROVIDERS
    ) + " FROM listings",
)
def ats_url_ids(spark, sf):
    cols = []
    for p in _PROVIDERS:
        ids, name = C.ats_ids(p, F.col("apply_url")), p.lower().replace(" ", "_")
        cols += [ids["board"].alias(f"{name}_board"), ids["job"].alias(f"{name}_job")]
    return listings(spark, sf).select("id", *cols)


@query(
    "direct_apply_support", "C-17 C-22",
    f"""WITH a AS (SELECT *, {ATS} AS ats FROM listings), d AS (SELECT *, CASE WHEN contains(lower(ats), 'greenhouse') THEN 'greenhouse'
        WHEN contains(lower(ats), 'lever') THEN 'lever' END AS direct_apply_ats FROM a)
        SELECT id, direct_apply_ats, coalesce(direct_apply_ats IS NOT NULL, false) AS supported,
        CASE direct_apply_ats WHEN 'greenhouse' THEN {_sql_ids('Greenhouse', 1)} WHEN 'lever' THEN {_sql_ids('Lever', 1)} END AS ats_board_token,
        CASE direct_apply_ats WHEN 'greenhouse' THEN {_sql_ids('Greenhouse', 2)} WHEN 'lever' THEN {_sql_ids('Lever', 2)} END AS ats_job_id,
        {any_of(URL, fv.AGGREGATOR_URL_TERMS)} AS is_aggregator FROM d""",
)
def direct_apply_support(spark, sf):
    df = enrich.with_direct_apply(enrich.with_ats(listings(spark, sf)))
    return df.select(
        "id", "direct_apply_ats", C.has_direct_apply(F.col("direct_apply_ats")).alias("supported"),
        "ats_board_token", "ats_job_id", C.is_aggregator_url(F.col("apply_url")).alias("is_aggregator"),
    )


# ------------------------------------------------------------------ candidates
YEARS = "CAST(salary_min / 5000 AS DOUBLE)"
_SKILLS = "[" + ", ".join(f"CASE WHEN contains({TEXT}, {lit(s)}) THEN {lit(s)} END" for s in fv.KNOWN_SKILLS) + "]"


def sql_domain(t: str, skills: str) -> str:
    counts = [
        "(" + " + ".join(f"CASE WHEN contains({t}, {lit(w)}) OR coalesce(list_contains({skills}, {lit(w)}), false) THEN 1 ELSE 0 END" for w in words) + ")"
        for _, words in fv.SKILL_DOMAINS
    ]
    best = f"greatest({', '.join(counts)})"
    return case([("general", f"{best} < 2")] + [(n, f"{c} = {best}") for (n, _), c in zip(fv.SKILL_DOMAINS, counts)], "general")


@query(
    "candidate_levels", "C-18",
    f"""SELECT id, coalesce(CASE WHEN lower(trim(experience_level)) IN ('intern', 'junior', 'mid', 'senior', 'staff') THEN lower(trim(experience_level)) END,
        {rule_case(TEXT, fv.RESUME_LEVEL_TERMS)},
        CASE WHEN coalesce({YEARS}, 0) <= 1 THEN 'junior' WHEN coalesce({YEARS}, 0) <= 4 THEN 'mid' WHEN coalesce({YEARS}, 0) <= 8 THEN 'senior' ELSE 'staff' END) AS level
        FROM postings""",
)
def candidate_levels(spark, sf):
    level = C.candidate_level(F.col("experience_level"), F.col("description"), F.col("salary_min") / 5000)
    return postings(spark, sf).select("id", level.alias("level"))


@query(
    "text_skills", "X-17 C-19 O-2",
    f"""WITH k AS (SELECT id, description, list_filter({_SKILLS}, lambda x: x IS NOT NULL) AS skills FROM postings)
        SELECT id, array_to_string(skills, '|') AS skills, {sql_domain(TEXT, 'skills')} AS domain FROM k""",
)
def text_skills(spark, sf):
    df = postings(spark, sf).select("id", "description", C.text_skills(F.col("description")).alias("found"))
    return df.select("id", list_col("found", "skills"), C.skill_domain(F.col("found"), F.col("description")).alias("domain"))


# ------------------------------------------------------------------ rule tables and containment joins
@query(
    "rule_table_labels", "F-0",
    """WITH r AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS pattern FROM part), t AS (SELECT DISTINCT p_name FROM part)
       SELECT p_name, min(upper(pattern)) AS label FROM t JOIN r ON contains(lower(p_name), lower(pattern)) GROUP BY p_name""",
)
def rule_table_labels(spark, sf):
    part = table(spark, sf, "part")
    rules = part.select(F.substring_index("p_name", " ", 1).alias("pattern")).distinct()
    rules = rules.select("pattern", F.upper("pattern").alias("label"), F.upper("pattern").alias("rank"))
    return matching.first_matching_term(part, "p_name", rules)


@query(
    "name_contains_term", "J-3 F-0",
    """WITH terms AS (SELECT DISTINCT right(s_name, 5) AS term FROM supplier)
       SELECT c_name, term FROM customer JOIN terms ON contains(lower(c_name), lower(term))""",
)
def name_contains_term(spark, sf):
    terms = table(spark, sf, "supplier").select(F.right("s_name", F.lit(5)).alias("term"))
    # A bound below the table's size, so the join on term pieces runs.
    return matching.substring_matches(table(spark, sf, "customer"), "c_name", terms, "term", max_broadcast_terms=5)


@query(
    "newest_per_company", "J-3 W-1",
    """WITH companies AS (SELECT DISTINCT split_part(company_name, ' ', 1) AS name FROM listings WHERE company_name <> '')
       SELECT name, rank, id FROM (SELECT c.name, l.id, row_number() OVER (PARTITION BY c.name ORDER BY l.posted_date DESC NULLS FIRST, l.id) AS rank
       FROM listings l JOIN companies c ON contains(lower(l.company_name), lower(c.name)) WHERE l.is_active) WHERE rank <= 50""",
)
def newest_per_company(spark, sf):
    df = listings(spark, sf).select("id", "company_name", "posted_date", "is_active")
    companies = df.where("company_name <> ''").select(F.substring_index("company_name", " ", 1).alias("name"))
    order = [F.desc_nulls_first("posted_date"), F.asc("id")]
    out = matching.newest_per_match(df.where("is_active"), "company_name", companies, "name", order, 50)
    return out.select("name", "rank", "id")


# ------------------------------------------------------------------ sentences, salaries, dates
_NO_TAGS = "regexp_replace(text, '<[^>]+>', '', 'g')"
_FLAT = f"trim(regexp_replace({trim_ws(_NO_TAGS)}, '[{WS}]+', ' ', 'g'))"


@query(
    "first_sentences", "X-1 X-18",
    f"""SELECT doc_id, left(coalesce(nullif(regexp_extract({_FLAT}, '^(.+?[.!?]) ', 1), ''), {_FLAT}), 300) AS sentence,
        left(coalesce(nullif(regexp_extract({_FLAT}, '^(.+?[.!?]) ', 1), ''), {_FLAT}), 500) AS long_sentence, left(text, 40) AS preview FROM documents""",
)
def first_sentences(spark, sf):
    t = F.col("text")
    return texts(spark, sf).select(
        "doc_id", T.first_sentence(t).alias("sentence"), T.first_sentence(t, 500).alias("long_sentence"), T.truncate(t, 40).alias("preview")
    )


# Texts with the range each states; the oracle has these values and no pattern.
PAY = [
    ("$100k - $200k", 100_000, 200_000), ("$100,000-$200,000", 100_000, 200_000), ("120k–150k", 120_000, 150_000), ("$30-50/hr", 30_000, 50_000),
    ("none", None, None), ("", None, None), ("from $90K to $110K now", 90_000, 110_000), ("$1,500 to 2,500", 1_500, 2_500),
    ("$\u00a0100k\u00a0-\u2009$200k", 100_000, 200_000), ("80\u3000k\u00a0to 95 k", 80_000, 95_000), (f"{'long text ' * 90}$70k-$75k", 70_000, 75_000),
]
_PAY_SPARK = f"element_at(array({', '.join(lit(p) for p, _, _ in PAY)}), cast(o_orderkey % {len(PAY)} as int) + 1) || ' ' || o_orderpriority"


def _sql_pay(place: int) -> str:
    return f"([{', '.join('NULL' if p[place] is None else str(p[place]) for p in PAY)}])[(o_orderkey % {len(PAY)}) + 1]::DOUBLE"


def _sql_found_pay(group: int) -> str:
    patterns = [p.replace(r"\s", f"[{WS}]") for p in fv.SALARY_PATTERNS]
    whens = " ".join(f"WHEN {matches('t', p)} THEN TRY_CAST(replace(regexp_extract(t, {lit(p)}, {group}), ',', '') AS DOUBLE)" for p in patterns)
    value = f"(CASE {whens} END)"
    return f"CASE WHEN {value} < 1000 THEN {value} * 1000 ELSE {value} END"


@query(
    "salary_ranges", "X-2",
    f"SELECT o_orderkey, {_sql_pay(1)} AS low, {_sql_pay(2)} AS high FROM orders",
)
def salary_ranges(spark, sf):
    df = table(spark, sf, "orders").selectExpr("o_orderkey", f"{_PAY_SPARK} AS t").withColumn("_r", X.salary_range(F.col("t")))
    return df.select("o_orderkey", F.col("_r.min").alias("low"), F.col("_r.max").alias("high"))


@query(
    "salary_ranges_documents", "X-2",
    f"WITH p AS (SELECT doc_id, text AS t FROM documents) SELECT doc_id, {_sql_found_pay(1)} AS low, {_sql_found_pay(2)} AS high FROM p",
)
def salary_ranges_documents(spark, sf):
    df = texts(spark, sf).select("doc_id", X.salary_range(F.col("text")).alias("_r"))
    return df.select("doc_id", F.col("_r.min").alias("low"), F.col("_r.max").alias("high"))


@query(
    "compensation_ranges", "X-15",
    """WITH c AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN '$' || (o_orderkey % 90) || 'k-$' || (o_orderkey % 90 + 20) || 'k'
         WHEN 1 THEN '$1,000 - $2,000' WHEN 2 THEN 'a-b' ELSE '90k' END AS t FROM orders),
       p AS (SELECT o_orderkey, t, replace(replace(replace(t, '$', ''), 'k', '000'), ',', '') AS s FROM c),
       n AS (SELECT o_orderkey, t, TRY_CAST(trim(split_part(s, '-', 1)) AS DOUBLE) AS a, TRY_CAST(trim(split_part(s, '-', 2)) AS DOUBLE) AS b FROM p)
       SELECT o_orderkey, CASE WHEN contains(t, '-') THEN a END AS low, CASE WHEN contains(t, '-') AND a IS NOT NULL THEN b END AS high FROM n""",
)
def compensation_ranges(spark, sf):
    df = table(spark, sf, "orders").selectExpr(
        "o_orderkey",
        "CASE o_orderkey % 4 WHEN 0 THEN '$' || (o_orderkey % 90) || 'k-$' || (o_orderkey % 90 + 20) || 'k'"
        " WHEN 1 THEN '$1,000 - $2,000' WHEN 2 THEN 'a-b' ELSE '90k' END AS t",
    ).withColumn("_r", X.compensation_range(F.col("t")))
    return df.select("o_orderkey", F.col("_r.min").alias("low"), F.col("_r.max").alias("high"))


@query(
    "parsed_dates", "X-4",
    """SELECT event_id, CASE event_id % 6 WHEN 5 THEN NULL WHEN 3 THEN strftime(ts, '%Y-%m-%d 00:00:00') WHEN 4 THEN strftime(ts, '%Y-%m-%d 00:00:00')
       ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS parsed FROM events""",
)
def parsed_dates(spark, sf):
    ts = F.col("ts").cast("timestamp")
    forms = ["yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'", "yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd", "dd/MM/yyyy"]
    text = F.lit("not a date")
    for i, form in enumerate(forms):
        text = F.when(F.col("event_id") % 6 == i, F.date_format(ts, form)).otherwise(text)
    df = table(spark, sf, "events").select("event_id", D.parse_date(text).alias("parsed"))
    return df.select("event_id", ts_col("parsed"))


@query(
    "relative_dates", "X-9",
    f"""SELECT event_id, CASE event_id % 5 WHEN 0 THEN strftime(TIMESTAMP '{EVENTS_AS_OF}' - to_hours(user_id), '%Y-%m-%d %H:%M:%S')
        WHEN 1 THEN strftime(TIMESTAMP '{EVENTS_AS_OF}' - to_hours(24 * user_id), '%Y-%m-%d %H:%M:%S')
        WHEN 2 THEN strftime(TIMESTAMP '{EVENTS_AS_OF}' - to_hours(168 * user_id), '%Y-%m-%d %H:%M:%S')
        WHEN 3 THEN strftime(TIMESTAMP '{EVENTS_AS_OF}' - to_hours(720 * user_id), '%Y-%m-%d %H:%M:%S') END AS posted FROM events""",
)
def relative_dates(spark, sf):
    unit = "element_at(array('hours ago', 'Days ago', ' weeks ago', 'month ago', 'yesterday'), cast(event_id % 5 as int) + 1)"
    gap = "CASE event_id % 3 WHEN 0 THEN '\u00a0' WHEN 1 THEN ' \t' ELSE ' ' END"
    text = f"CASE WHEN event_id % 5 = 4 THEN 'yesterday' ELSE concat('Posted ', user_id, {gap}, {unit}) END"
    df = table(spark, sf, "events").selectExpr("event_id", f"{text} AS t")
    return df.select("event_id", D.relative_date(F.col("t"), EVENTS_AS_OF).alias("posted")).select("event_id", ts_col("posted"))


def sql_days(ts: str, as_of: str) -> str:
    return f"CAST(floor((epoch_us(TIMESTAMP '{as_of}') - epoch_us({ts})) / 86400000000.0) AS BIGINT)"


_DAYS = sql_days("ts", "2024-01-20 12:00:00")


@query(
    "event_ages", "X-10 L-9 P-16",
    f"""SELECT event_id, {_DAYS} AS days_old, CASE WHEN {_DAYS} <= 1 THEN 'le_1' WHEN {_DAYS} <= 3 THEN 'le_3' WHEN {_DAYS} <= 7 THEN 'le_7'
        WHEN {_DAYS} <= 14 THEN 'le_14' WHEN ts < TIMESTAMP '2024-01-20 12:00:00' - INTERVAL 16 DAY THEN 'stale' ELSE 'older' END AS freshness,
        ts > TIMESTAMP '2024-01-20 12:00:00' - INTERVAL 10 MINUTE AS is_new FROM events""",
)
def event_ages(spark, sf):
    as_of, ts = "2024-01-20 12:00:00", F.col("ts").cast("timestamp")
    return table(spark, sf, "events").select(
        "event_id", D.age_days(ts, as_of).alias("days_old"), D.freshness(ts, as_of, expiry_days=16).alias("freshness"), D.is_new(ts, as_of).alias("is_new")
    )


def _sql_age_label(ts: str, as_of: str) -> str:
    def unit(n: int) -> str:
        return f"CAST(floor((epoch_us(TIMESTAMP '{as_of}') - epoch_us({ts})) / {n * 1000000}.0) AS BIGINT)"

    m, h, d, w = unit(60), unit(3600), unit(86400), unit(604800)
    return (
        f"CASE WHEN {ts} IS NULL THEN '' WHEN {m} < 60 THEN {m} || 'm ago' WHEN {h} < 24 THEN {h} || 'h ago' WHEN {d} < 7 THEN {d} || 'd ago'"
        f" WHEN {w} < 5 THEN {w} || 'w ago' ELSE strftime({ts}, '%-m/%-d/%Y') END"
    )


def _sql_money(v: str) -> str:
    return f"(CASE WHEN salary_currency = 'INR' THEN '₹' ELSE '$' END || CASE WHEN {v} >= 1000 THEN CAST(CAST(floor({v} / 1000 + 0.5) AS BIGINT) AS VARCHAR) || 'K' ELSE CAST(CAST({v} AS BIGINT) AS VARCHAR) END)"


_HAS = {c: f"coalesce({c}, 0) <> 0" for c in ("salary_min", "salary_max")}


@query(
    "card_labels", "X-12 X-13 X-14",
    f"""SELECT id, CASE WHEN {_HAS['salary_min']} AND {_HAS['salary_max']} THEN {_sql_money('salary_min')} || ' – ' || {_sql_money('salary_max')}
        WHEN {_HAS['salary_min']} THEN {_sql_money('salary_min')} || '+' WHEN {_HAS['salary_max']} THEN 'Up to ' || {_sql_money('salary_max')} ELSE 'Competitive' END AS salary,
        {_sql_age_label('posted_date', LISTINGS_AS_OF)} AS age,
        CASE WHEN company_name = '' THEN '??' ELSE left(upper(array_to_string(list_transform(string_split(company_name, ' '), lambda w: left(w, 1)), '')), 2) END AS initials,
        regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug FROM listings""",
)
def card_labels(spark, sf):
    return listings(spark, sf).select(
        "id", T.salary_label(F.col("salary_min"), F.col("salary_max"), F.col("salary_currency")).alias("salary"),
        D.age_label(F.col("posted_date"), LISTINGS_AS_OF).alias("age"), T.initials(F.col("company_name")).alias("initials"),
        T.slugify(F.col("title")).alias("slug"),
    )


@query(
    "event_age_labels", "X-13", f"SELECT event_id, {_sql_age_label('ts', '2024-01-30 12:00:00')} AS age FROM events",
)
def event_age_labels(spark, sf):
    return table(spark, sf, "events").select("event_id", D.age_label(F.col("ts").cast("timestamp"), "2024-01-30 12:00:00").alias("age"))


@query(
    "name_parts", "X-25",
    """SELECT id, split_part(title, ' ', 1) AS first_name, CASE WHEN contains(title, ' ') THEN substr(title, strpos(title, ' ') + 1) ELSE '' END AS last_name FROM listings""",
)
def name_parts(spark, sf):
    return listings(spark, sf).select("id", T.first_name(F.col("title")).alias("first_name"), T.last_name(F.col("title")).alias("last_name"))


@query(
    "place_lookups", "X-5 X-6 X-7 X-11 S-3 S-6 F-2",
    f"""WITH p AS (SELECT id, title, location_country, coalesce(location_city, '') || ', Region, ' || coalesce(location_country, '') AS place FROM listings)
        SELECT id, nullif(trim(split_part(place, ',', 1)), '') AS city, nullif(trim(regexp_extract(place, '[^,]*$')), '') AS country,
        {value_map('lower(location_country)', fv.COUNTRY_NAMES, 'location_country')} AS country_name,
        {value_map('lower(location_country)', fv.LOCATION_ALIASES)} AS alias,
        {rule_case('lower(place)', [(c, [n]) for n, c in fv.FEED_COUNTRY_CODES], 'us')} AS feed_code,
        {rule_case('lower(title)', [(c, [n]) for n, c in fv.FEED_CATEGORIES])} AS feed_category FROM p""",
)
def place_lookups(spark, sf):
    place = F.concat_ws(", ", T.text_or_empty(F.col("location_city")), F.lit("Region"), T.text_or_empty(F.col("location_country")))
    df = listings(spark, sf).withColumn("place", place)
    return df.select(
        "id", T.split_city(F.col("place")).alias("city"), T.split_country(F.col("place")).alias("country"),
        C.country_name(F.col("location_country")).alias("country_name"),
        lookup(F.lower("location_country"), fv.LOCATION_ALIASES).alias("alias"),
        C.feed_country_code(F.col("place")).alias("feed_code"), C.feed_category(F.col("title")).alias("feed_category"),
    )


@query(
    "fenced_json_fields", "X-24",
    "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
)
def fenced_json_fields(spark, sf):
    wrapped = F.when(F.col("event_type") == "click", F.concat(F.lit("Here:\n```json\n"), "props", F.lit("\n```\nDone")))
    wrapped = wrapped.when(F.col("event_type") == "view", F.concat(F.lit("```"), "props", F.lit("```"))).otherwise(F.col("props"))
    df = table(spark, sf, "events").select("event_id", F.from_json(T.fenced_json(wrapped), "k bigint").alias("_j"))
    return df.select("event_id", "_j.k")


@query(
    "resume_files_ok", "X-26",
    """SELECT doc_id, lang IN ('en', 'fr') AND n_chars * 1000 <= 5 * 1024 * 1024 AS ok FROM documents""",
)
def resume_files_ok(spark, sf):
    ext = "CASE lang WHEN 'en' THEN '.PDF' WHEN 'fr' THEN '.docx' WHEN 'de' THEN '.txt' ELSE '' END"
    df = table(spark, sf, "documents").selectExpr("doc_id", f"concat(source, '/cv', {ext}) AS path", "n_chars * 1000 AS length")
    return df.select("doc_id", T.resume_file_ok(F.col("path"), F.col("length"), fv.RESUME_EXTENSIONS, fv.RESUME_MAX_BYTES).alias("ok"))


@query(
    "tag_previews", "X-19 X-8",
    """WITH t AS (SELECT page_id, list_distinct(list_sort(regexp_extract_all(html, 'href="([^"]*)"', 1))) AS tags FROM pages)
       SELECT page_id, array_to_string(list_sort(tags)[1:5], '|') AS shown, greatest(len(tags) - 5, 0)::BIGINT AS more, list_sort(tags)[1] AS first FROM t""",
)
def tag_previews(spark, sf):
    tags = F.array_sort(F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))))
    df = table(spark, sf, "pages").select("page_id", tags.alias("tags"))
    return df.select(
        "page_id", list_col(F.slice("tags", 1, 5), "shown"), F.greatest(F.size("tags") - 5, F.lit(0)).alias("more"),
        F.try_element_at("tags", F.lit(1)).alias("first"),
    )


# ------------------------------------------------------------------ HTML
_ANCHOR = r'(?is)<a\s[^>]*?href="([^"]*)"[^>]*>(.*?)</a>'


def _sql_inner(e: str) -> str:
    e = f"regexp_replace({e}, '<[^>]+>', '', 'g')"
    for name, char in X.ENTITIES:
        e = f"replace({e}, {lit(name)}, {lit(char)})"
    return trim_ws(e)


_LINKS = f"""WITH a AS (SELECT page_id, url, regexp_extract_all(html, {lit(_ANCHOR)}, 1) AS hrefs, regexp_extract_all(html, {lit(_ANCHOR)}, 2) AS labels FROM pages),
  l AS (SELECT page_id, url, unnest(range(len(hrefs))) AS pos, unnest(hrefs) AS href, unnest(labels) AS raw FROM a),
  links AS (SELECT page_id, pos, href, {_sql_inner('raw')} AS label,
    CASE WHEN href LIKE '/%' THEN regexp_extract(url, '^(https?://[^/?#]+)', 1) || href ELSE href END AS link FROM l)"""


@query("page_link_rows", "X-20 X-22 S-12", f"{_LINKS} SELECT page_id, pos, href, label, link FROM links")
def page_link_rows(spark, sf):
    return page_links(table(spark, sf, "pages"), "page_id", "url", "html").select("page_id", "pos", "href", "label", "link")


@query(
    "page_first_links", "D-7 W-2 W-3 X-23",
    f"""{_LINKS} SELECT page_id, pos, href FROM (SELECT *, row_number() OVER (PARTITION BY page_id, href ORDER BY pos) AS rn FROM links WHERE href <> '')
        WHERE rn = 1 AND length(label) >= 4""",
)
def page_first_links(spark, sf):
    found = page_links(table(spark, sf, "pages"), "page_id", "url", "html")
    return usable_titles(dedup.unseen_links(found, "page_id", "href", "pos")).select("page_id", "pos", "href")


def _sql_element(tag: str) -> str:
    pattern = rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>"
    return f"nullif({_sql_inner(f'regexp_extract(html, {lit(pattern)}, 1)')}, '')"


@query(
    "page_heads", "X-21",
    f"SELECT page_id, coalesce({_sql_element('h2')}, {_sql_element('h1')}, {_sql_element('title')}, 'Untitled') AS head FROM pages",
)
def page_heads(spark, sf):
    return table(spark, sf, "pages").select("page_id", X.first_element_text(F.col("html"), ["h2", "h1", "title"], "Untitled").alias("head"))

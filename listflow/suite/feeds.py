"""API feeds, JSON boards and HTML boards over payloads made from the tables.

Every order, document or page row is written as the JSON or HTML that a source
would land, then read, parsed and normalized like a landed one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from listflow.functions import fixed_values as fv
from listflow.operators.stats import load_report
from listflow.plans.jobs import bulk_insert_rows, bulk_rows, ingest_cycle
from listflow.schemas import LISTINGS, align_to_schema
from listflow.session import shared_dir
from listflow.sources import boards as B, feeds as S
from listflow.suite.keys import sql_job_type, sql_level, sql_region_ok
from listflow.suite.registry import any_of, case, key_sha, list_col, list_text, query, rule_case, ts_col, ts_text, value_map
from listflow.suite.views import LISTINGS_AS_OF, lit, listings, postings, table
from listflow.suite.words import _FLAT, sql_remote

AS_OF = f"TIMESTAMP '{LISTINGS_AS_OF}'"
_DAY = "date_format(created_at, \"yyyy-MM-dd'T'HH:mm:ss'Z'\")"
_SQL_POSTED = ts_text("created_at")


def _payloads(spark, sf, record: str, wrap: str) -> DataFrame:
    """One payload per listing: ``record`` inside the feed's envelope, as JSON text."""
    df = listings(spark, sf).selectExpr("*", f"{record} AS r")
    return df.selectExpr("id", f"to_json({wrap}) AS payload")


def _normalized(spark, sf, feed: str, record: str, wrap: str) -> DataFrame:
    f = S.FEEDS[feed]
    parsed = S.parse_payloads(_payloads(spark, sf, record, wrap), f, "payload", keep=())
    return S.normalize_records(parsed, f, LISTINGS_AS_OF)


_KNOWN_TYPE = value_map("lower(nullif(job_type, ''))", fv.JOB_TYPE_SYNONYMS)
_TYPE = f"coalesce({_KNOWN_TYPE}, nullif(job_type, ''))"
_FLAG = "CASE WHEN visa_sponsorship THEN 'remote' ELSE 'onsite' END"


@query(
    "feed_jsearch", "S-0 S-1 P-1",
    f"""SELECT title, company_name, location_city, location_country, {_FLAG} AS remote_type, salary_min, coalesce(salary_currency, 'USD') AS salary_currency,
        'yearly' AS salary_period, {_TYPE} AS job_type, description, coalesce(array_to_string(tech_stack, '|'), '') AS requirements, '' AS benefits,
        apply_url, {_SQL_POSTED} AS posted_date, 'JSearch' AS source_platforms FROM listings""",
)
def feed_jsearch(spark, sf):
    record = f"""named_struct('job_title', title, 'employer_name', company_name, 'job_city', location_city, 'job_country', location_country,
      'job_is_remote', visa_sponsorship, 'job_min_salary', salary_min, 'job_salary_currency', salary_currency, 'job_employment_type', job_type,
      'job_description', description, 'job_highlights', named_struct('Qualifications', tech_stack), 'job_apply_link', apply_url,
      'job_posted_at_datetime_utc', {_DAY})"""
    df = _normalized(spark, sf, "JSearch", record, "named_struct('data', array(r))")
    return df.select(
        "title", "company_name", "location_city", "location_country", "remote_type", "salary_min", "salary_currency", "salary_period",
        "job_type", "description", list_col("requirements"), list_col("benefits"), "apply_url", ts_col("posted_date"), list_col("source_platforms"),
    )


@query(
    "feed_serpapi", "S-2 P-2 X-8 X-9",
    f"""SELECT title, company_name, location_city, description, salary_min, salary_max, {_TYPE} AS job_type,
        strftime({AS_OF} - to_days(CAST(id % 90 AS INTEGER)), '%Y-%m-%d %H:%M:%S') AS posted_date, apply_url FROM listings""",
)
def feed_serpapi(spark, sf):
    record = """named_struct('title', title, 'company_name', company_name, 'location', location_city, 'description', description,
      'detected_extensions', named_struct('salary_from', salary_min, 'salary_to', salary_max, 'schedule_type', job_type,
        'posted_at', concat(id % 90, ' days ago')),
      'apply_options', array(named_struct('link', apply_url), named_struct('link', 'second')))"""
    df = _normalized(spark, sf, "SerpApi", record, "named_struct('jobs_results', array(r))")
    return df.select("title", "company_name", "location_city", "description", "salary_min", "salary_max", "job_type", ts_col("posted_date"), "apply_url")


@query(
    "feed_adzuna", "S-3 P-3 S-14",
    f"""SELECT title, CASE WHEN company_name = 'X' THEN 'Unknown' ELSE company_name END AS company_name, location_city, location_country,
        CASE WHEN id % 7 <> 0 THEN CAST(id % 7 AS DOUBLE) END AS lat, salary_min, salary_max, 'GBP' AS salary_currency, {_TYPE} AS job_type, {_SQL_POSTED} AS posted_date FROM listings""",
)
def feed_adzuna(spark, sf):
    record = f"""named_struct('title', title, 'company', CASE WHEN company_name <> 'X' THEN named_struct('display_name', company_name) END,
      'location', named_struct('area', array(location_country, 'Middle', location_city)), 'latitude', cast(id % 7 as double), 'longitude', 1.5D,
      'salary_min', salary_min, 'salary_max', salary_max, 'created', {_DAY}, 'contract_type', job_type)"""
    df = _normalized(spark, sf, "Adzuna", record, "named_struct('results', array(r))")
    return df.select(
        "title", "company_name", "location_city", "location_country", F.col("location_coords.lat").alias("lat"), "salary_min", "salary_max",
        "salary_currency", "job_type", ts_col("posted_date"),
    )


@query(
    "feed_theirstack", "S-4 P-4",
    f"""SELECT title, company_name, location_city, location_country, {_FLAG} AS remote_type, coalesce(array_to_string(tech_stack, '|'), '') AS tech_stack,
        {_SQL_POSTED} AS posted_date FROM listings WHERE created_at >= {AS_OF} - INTERVAL 30 DAY""",
)
def feed_theirstack(spark, sf):
    record = f"""named_struct('job_title', title, 'company_name', company_name, 'location', location_city, 'country', location_country,
      'remote', visa_sponsorship, 'technologies', tech_stack, 'date_posted', {_DAY})"""
    df = _normalized(spark, sf, "TheirStack", record, "named_struct('data', array(r))")
    return df.select("title", "company_name", "location_city", "location_country", "remote_type", list_col("tech_stack"), ts_col("posted_date"))


@query(
    "feed_apify", "S-5 P-5",
    f"SELECT title, company_name, coalesce(location_city, '') AS location_city, salary_min, apply_url, {_SQL_POSTED} AS posted_date FROM listings",
)
def feed_apify(spark, sf):
    record = f"""named_struct('title', CASE WHEN id % 2 = 0 THEN title END, 'jobTitle', title, 'companyName', company_name, 'jobLocation', location_city,
      'salaryMin', salary_min, 'jobUrl', apply_url, 'datePosted', {_DAY})"""
    df = _normalized(spark, sf, "Apify", record, "array(r)")
    return df.select("title", "company_name", "location_city", "salary_min", "apply_url", ts_col("posted_date"))


_MUSE = ["Entry Level", "Mid Level", "Senior Level", "management", "Internship", "Other"]


@query(
    "feed_themuse", "S-6 P-6 X-11",
    f"""SELECT title, company_name, coalesce(location_city, '') AS location_city, (['junior', 'mid', 'senior', 'lead', 'intern', NULL])[(id % 6) + 1] AS experience_level,
        {_TYPE} AS job_type, coalesce(description, '') AS description, apply_url, {_SQL_POSTED} AS posted_date FROM listings""",
)
def feed_themuse(spark, sf):
    level = f"element_at(array({', '.join(lit(m) for m in _MUSE)}), cast(id % 6 as int) + 1)"
    record = f"""named_struct('name', title, 'company', named_struct('name', company_name), 'locations', array(named_struct('name', location_city)),
      'levels', array(named_struct('name', {level})), 'type', job_type, 'contents', description, 'refs', named_struct('landing_page', apply_url),
      'publication_date', {_DAY})"""
    df = _normalized(spark, sf, "The Muse", record, "named_struct('results', array(r))")
    return df.select("title", "company_name", "location_city", "experience_level", "job_type", "description", "apply_url", ts_col("posted_date"))


@query(
    "feed_findwork", "S-7 P-7",
    f"SELECT title, company_name, {_FLAG} AS remote_type, coalesce(array_to_string(tech_stack, '|'), '') AS tech_stack, description, {_SQL_POSTED} AS posted_date FROM listings",
)
def feed_findwork(spark, sf):
    record = f"""named_struct('role', title, 'company_name', company_name, 'remote', visa_sponsorship, 'keywords', tech_stack, 'text', description,
      'date_posted', {_DAY})"""
    df = _normalized(spark, sf, "Findwork", record, "named_struct('results', array(r))")
    return df.select("title", "company_name", "remote_type", list_col("tech_stack"), "description", ts_col("posted_date"))


@query(
    "feed_yc", "S-8 P-8",
    f"""SELECT title, company_name, 'vc_backed' AS company_type, CASE WHEN id % 3 = 0 THEN 'YC' ELSE 'YC W' || (id % 3) END AS vc_backer, {_FLAG} AS remote_type,
        experience_level, {_SQL_POSTED} AS posted_date FROM listings""",
)
def feed_yc(spark, sf):
    record = f"""named_struct('title', title, 'company_name', company_name, 'batch', CASE WHEN id % 3 <> 0 THEN concat('W', id % 3) END,
      'remote', visa_sponsorship, 'experience_level', experience_level, 'created_at', {_DAY})"""
    df = _normalized(spark, sf, "YC", record, "named_struct('results', array(named_struct('hits', array(r))))")
    return df.select("title", "company_name", "company_type", "vc_backer", "remote_type", "experience_level", ts_col("posted_date"))


@query(
    "feed_wellfound", "S-9 P-9 X-15",
    """SELECT title, coalesce(company_name, '') AS company_name, 'startup' AS company_type, CASE WHEN id % 2 = 0 THEN CAST(id % 90 * 1000 AS DOUBLE) END AS salary_min,
       CASE WHEN id % 2 = 0 THEN CAST((id % 90 + 10) * 1000 AS DOUBLE) END AS salary_max, 'https://wellfound.com/jobs/' || id AS apply_url,
       coalesce(array_to_string(tech_stack, '|'), '') AS tech_stack FROM listings""",
)
def feed_wellfound(spark, sf):
    record = """named_struct('title', title, 'url', cast(id as string), 'startup', named_struct('name', company_name),
      'compensation', CASE WHEN id % 2 = 0 THEN concat('$', id % 90, 'k - $', id % 90 + 10, 'k') ELSE 'open' END,
      'skills', transform(tech_stack, t -> named_struct('name', t)))"""
    wrap = "named_struct('data', named_struct('talent', named_struct('jobListings', named_struct('results', array(r)))))"
    df = _normalized(spark, sf, "Wellfound", record, wrap)
    return df.select("title", "company_name", "company_type", "salary_min", "salary_max", "apply_url", list_col("tech_stack"))


# Payloads with several records take a fixed span of listing ids, so that none can
# grow with the table.
SPAN = 40


@query(
    "feed_linkedin", "S-10 P-10",
    f"SELECT o_orderkey // {SPAN} AS page, o_orderkey AS title, coalesce(o_orderstatus = 'O', false) AS easy_apply FROM orders",
)
def feed_linkedin(spark, sf):
    record = F.struct(F.col("o_orderkey").alias("title"), (F.col("o_orderstatus") == "O").alias("easyApply"))
    df = table(spark, sf, "orders").groupBy(F.expr(f"o_orderkey div {SPAN}").alias("page"))
    df = df.agg(F.array_sort(F.collect_list(record)).alias("r")).select("page", F.to_json("r").alias("payload"))
    parsed = S.parse_payloads(df, S.FEEDS["LinkedIn"], "payload", keep=("page",))
    return parsed.select("page", F.col("title").cast("bigint").alias("title"), F.coalesce("easyApply", F.lit(False)).alias("easy_apply"))


@query(
    "feed_union_enriched", "S-16 S-17 O-1 D-3 C-2 C-3 P-12 E2",
    f"""WITH u AS (SELECT 0 AS source_rank, title, company_name, location_city, created_at AS posted, description, 'Findwork' AS source FROM listings
          UNION ALL SELECT 1, title, company_name, location_city, NULL, description, 'Wellfound' FROM listings)
        SELECT source_rank::BIGINT AS source_rank, source AS source_platforms, count(*) AS n,
          count(DISTINCT {key_sha('company_name', 'title', "CASE source WHEN 'Wellfound' THEN '' ELSE location_city END", "coalesce(strftime(posted, '%Y-%m-%d'), '')")}) AS n_keys,
          count(*) FILTER (WHERE {any_of("lower(title || ' ' || coalesce(description, ''))", fv.PERK_VISA)}) AS n_visa,
          count(*) FILTER (WHERE source = 'Wellfound') AS n_startup FROM u GROUP BY 1, 2""",
)
def feed_union_enriched(spark, sf):
    findwork = """named_struct('role', title, 'company_name', company_name, 'location', location_city, 'text', description, 'date_posted', {d})"""
    well = "named_struct('title', title, 'description', description, 'startup', named_struct('name', company_name))"
    a = _payloads(spark, sf, findwork.format(d=_DAY), "named_struct('results', array(r))")
    wrap = "named_struct('data', named_struct('talent', named_struct('jobListings', named_struct('results', array(r)))))"
    b = listings(spark, sf).selectExpr("*", f"{well} AS r").selectExpr("id", f"to_json({wrap}) AS payload")
    parts = [
        (rank, S.load_feed(df, S.FEEDS[name], "payload", LISTINGS_AS_OF)) for rank, (name, df) in enumerate([("Findwork", a), ("Wellfound", b)])
    ]
    rows = S.union_feeds(parts)
    aligned = align_to_schema(rows, LISTINGS).columns
    rows = rows.select("source_rank", *[c for c in aligned if c in rows.columns])
    return rows.groupBy("source_rank", list_col("source_platforms")).agg(
        F.count("*").alias("n"), F.count_distinct("dedup_hash").alias("n_keys"), F.count_if("visa_sponsorship").alias("n_visa"),
        F.count_if(F.col("company_type") == "startup").alias("n_startup"),
    )


@query(
    "bad_payloads", "S-17 A-8",
    "SELECT 'Findwork' AS action, 'not readable' AS reason, count(*) AS n FROM documents WHERE lang = 'de' GROUP BY 1, 2",
)
def bad_payloads(spark, sf):
    """Documents in one language are cut text, the others are payloads; the former go to the error table."""
    good = F.to_json(F.struct(F.array(F.struct(F.col("text").alias("role"))).alias("results")))
    payload = F.when(F.col("lang") == "de", F.concat(F.lit("{"), "text")).otherwise(good)
    df = table(spark, sf, "documents").select("doc_id", payload.alias("payload"))
    bad = S.bad_payloads(df, S.FEEDS["Findwork"], "payload")
    return load_report(bad.select(F.col("source").alias("action"), F.lit("not readable").alias("reason")))


# ------------------------------------------------------------------ bulk rows
_SENT = "trim(regexp_replace(regexp_replace(coalesce(description, ''), '<[^>]+>', '', 'g'), '[ \\t\\n]+', ' ', 'g'))"
_BULK = f"""b AS (SELECT id AS seq, trim(title) AS title, trim(company_name) AS company_name, coalesce(nullif(location_city, ''), 'India') AS city, apply_url,
   {_SENT} AS d, left(coalesce(nullif(regexp_extract({_SENT}, '^(.+?[.!?]) ', 1), ''), {_SENT}), 500) AS shown, salary_min FROM listings),
  k AS (SELECT * FROM b WHERE title <> '' AND company_name <> '' AND apply_url <> '' AND {sql_region_ok('lower(title)', "'INR'", 'd')})"""


@query(
    "bulk_rows", "P-13 P-14 C-4 C-5 C-8 C-10 C-12 F-12",
    f"""WITH {_BULK} SELECT seq, title, city AS location_city, shown AS description, {sql_remote("lower(title || ' ' || city || ' ' || d)", ['hybrid'])} AS remote_type,
        {sql_level('lower(title)')} AS experience_level, {sql_job_type("lower(title || ' ' || d)")} AS job_type,
        {case([('big_tech', any_of('lower(company_name)', fv.BULK_BIG_TECH)), ('stealth', "contains(lower(company_name), 'stealth')"),
               ('vc_backed', any_of('lower(d)', fv.BULK_FUNDING_PHRASES))], 'startup')} AS company_type,
        {any_of('lower(d)', fv.BULK_VISA)} AS visa_sponsorship, 'INR' AS salary_currency FROM k""",
)
def run_bulk_rows(spark, sf):
    return bulk_rows(_bulk_input(spark, sf), "Adzuna-IN", LISTINGS_AS_OF, shown=500).select(
        "seq", "title", "location_city", "description", "remote_type", "experience_level", "job_type", "company_type", "visa_sponsorship", "salary_currency"
    )


def _bulk_input(spark, sf):
    return listings(spark, sf).selectExpr(
        "id AS seq", "title", "company_name AS company", "apply_url AS url", "location_city AS city", "description",
        f"{_DAY} AS posted_text", "salary_min", "salary_max",
    )


_CYCLE_KEY = key_sha("company", "title", "''", raw=["''"])


@query(
    "ingest_cycle_report", "S-17 A-8 S-0",
    f"""WITH f AS (SELECT 'Findwork' AS source, lang = 'de' AS bad, text AS title, source AS company FROM documents WHERE doc_id % 2 = 0
          UNION ALL SELECT 'JSearch', lang = 'fr', text, lang FROM documents WHERE doc_id % 2 = 1),
        ok AS (SELECT source, title, company FROM f WHERE NOT bad AND title <> '')
        SELECT source, 'found' AS action, count(*) AS n FROM ok GROUP BY 1 UNION ALL SELECT source, 'unreadable', count(*) FROM f WHERE bad GROUP BY 1
        UNION ALL SELECT 'Apify', 'failed', 1 UNION ALL SELECT 'all', 'inserted', count(DISTINCT {_CYCLE_KEY}) FROM ok""",
)
def ingest_cycle_report(spark, sf):
    """Half of the documents land as payloads of one feed and half of another, some of them cut; a third feed's folder is not there."""
    docs = table(spark, sf, "documents")
    places = {name: shared_dir(spark, f"landed-{name.lower()}") for name in ("Findwork", "JSearch", "Apify")}
    for rest, name, bad, root, title, company in ((0, "Findwork", "de", "results", "role", "source"), (1, "JSearch", "fr", "data", "job_title", "lang")):
        employer = {"role": "company_name", "job_title": "employer_name"}[title]
        record = F.struct(F.col("text").alias(title), F.col(company).alias(employer))
        payload = F.when(F.col("lang") == bad, F.concat(F.lit("{"), F.translate("text", "\n\r", "  "))).otherwise(F.to_json(F.struct(F.array(record).alias(root))))
        docs.where(F.col("doc_id") % 2 == rest).select(payload.alias("value")).write.text(places[name])
    stored = spark.createDataFrame([], LISTINGS)
    return ingest_cycle(stored, places, LISTINGS_AS_OF).report


_WHOLE_FLAT = _FLAT.replace("(text,", "(description,")


@query(
    "bulk_rows_whole", "P-14 X-1",
    f"""WITH d AS (SELECT id AS seq, trim(title) AS title, trim(company_name) AS company_name, apply_url, {_WHOLE_FLAT} AS d FROM postings)
        SELECT seq, title, coalesce(nullif(regexp_extract(d, '^(.+?[.!?]) ', 1), ''), d) AS description FROM d
        WHERE title <> '' AND company_name <> '' AND apply_url <> '' AND {sql_region_ok('lower(title)', "'INR'", 'd')}""",
)
def bulk_rows_whole(spark, sf):
    """Documents as bulk rows, their first sentences whole."""
    rows = postings(spark, sf).selectExpr(
        "id AS seq", "title", "company_name AS company", "apply_url AS url", "location_city AS city", "description", "cast(null as string) AS posted_text", "salary_min", "salary_max",
    )
    return bulk_rows(rows, "Adzuna-IN", LISTINGS_AS_OF).select("seq", "title", "description")


@query(
    "bulk_insert_rows", "D-5 D-6 F-10 C-16 U-3",
    f"""WITH {_BULK}, v AS (SELECT *, {key_sha('company_name', 'title', 'city', raw=['apply_url'])} AS dedup_hash FROM k
          WHERE length(title) >= 5 AND apply_url LIKE 'http%' AND NOT {any_of('lower(title)', fv.BULK_NON_TECH)})
        SELECT dedup_hash, min(seq) AS seq FROM v GROUP BY 1""",
)
def run_bulk_insert_rows(spark, sf):
    rows = bulk_rows(_bulk_input(spark, sf), "JSearch", LISTINGS_AS_OF)
    return bulk_insert_rows(rows, LISTINGS_AS_OF).select("dedup_hash", "seq")


def _bulk_payload_sql(city: str, currency: str, remote: str) -> str:
    return f"""WITH b AS (SELECT *, trim(title) AS t, trim(company_name) AS c, coalesce(nullif({city}, ''), 'India') AS city, {_SENT} AS d FROM listings),
      k AS (SELECT *, {currency} AS currency FROM b WHERE t <> '' AND c <> '' AND apply_url <> '')
      SELECT id AS seq, t AS title, c AS company_name, city AS location_city, {remote} AS remote_type, currency AS salary_currency, salary_min, salary_max,
        {_SQL_POSTED} AS posted_date FROM k WHERE {sql_region_ok('lower(t)', 'currency', 'd')}"""


def _bulk_payload_rows(spark, sf, source: str, record: str) -> DataFrame:
    root = S.BULK_RECORDS[source][0]
    landed = listings(spark, sf).selectExpr("id AS seq", "*", f"{record} AS r").selectExpr("seq", f"to_json(named_struct('{root}', array(r))) AS payload")
    rows = bulk_rows(S.bulk_payload_rows(landed, source, keep=("seq",)), source, LISTINGS_AS_OF)
    return rows.select("seq", "title", "company_name", "location_city", "remote_type", "salary_currency", "salary_min", "salary_max", ts_col("posted_date"))


@query(
    "bulk_payloads_adzuna", "S-14 P-13",
    _bulk_payload_sql("CASE id % 3 WHEN 0 THEN location_city ELSE location_country END", "'INR'", sql_remote("lower(t || ' ' || city || ' ' || d)", ["hybrid"])),
)
def bulk_payloads_adzuna(spark, sf):
    """Places with areas, with an empty list of them, and with a name only."""
    record = f"""named_struct('redirect_url', apply_url, 'title', title, 'company', named_struct('display_name', company_name),
      'location', named_struct('display_name', location_country, 'area', CASE id % 3 WHEN 0 THEN array('India', location_city) WHEN 1 THEN cast(array() as array<string>) END),
      'description', description, 'created', {_DAY}, 'salary_min', salary_min, 'salary_max', salary_max)"""
    return _bulk_payload_rows(spark, sf, "Adzuna-IN", record)


@query(
    "bulk_payloads_jsearch", "S-15 P-14",
    _bulk_payload_sql(
        "location_city", "coalesce(salary_currency, 'INR')", f"CASE WHEN visa_sponsorship THEN 'remote' ELSE {sql_remote('lower(t || chr(32) || d)', ['hybrid'])} END"
    ),
)
def bulk_payloads_jsearch(spark, sf):
    record = f"""named_struct('job_apply_link', apply_url, 'job_title', title, 'employer_name', company_name, 'job_city', location_city, 'job_description', description,
      'job_is_remote', visa_sponsorship, 'job_posted_at_datetime_utc', {_DAY}, 'job_min_salary', salary_min, 'job_max_salary', salary_max, 'job_salary_currency', salary_currency)"""
    return _bulk_payload_rows(spark, sf, "JSearch", record)


# ------------------------------------------------------------------ boards
# One payload per span of listings; the spans belong to the boards in turn. One source
# wraps its list in a list of results; the others name it at the top, or not at all.
_LIST_NAMES = {"Arbeitnow": "data", "RemoteOK": "", "Adzuna-IN": "results", "Adzuna-IN-Junior": "results"}
_BOARD_NAMES = [b.source for b in B.JSON_BOARDS]


def _board_payload(board: B.JsonBoard):
    fields = {
        board.title: "title", "description": "description", "url": "apply_url", "publication_date": "posted", "pubDate": "posted",
        "date": "posted", "created": "posted", "tags": "tech_stack", "remote": "visa_sponsorship", "salary_min": "salary_min",
        "candidate_required_location": "place", "jobGeo": "place", "jobExcerpt": "description", "redirect_url": "apply_url",
    }
    names = [f.split(":")[0].strip() for f in board.record.split(",")]
    parts = []
    for n in names:
        if n in ("company", "location") and f"{n}: struct" in board.record:
            parts.append(f"'{n}', named_struct('display_name', {'x.company_name' if n == 'company' else 'x.place'})")
        elif n in ("company", "company_name", "companyName"):
            parts.append(f"'{n}', x.company_name")
        elif n == "location":
            parts.append("'location', x.place")
        elif n in fields:
            parts.append(f"'{n}', x.{fields[n]}")
    items = F.expr(f"transform(items, x -> named_struct({', '.join(parts)}))")
    if board.skip:
        items = F.concat(F.slice(items, 1, 1), items)
    if board.source == "YC-WATS":
        return F.to_json(F.struct(F.array(F.struct(items.alias("hits"))).alias("results")))
    name = _LIST_NAMES.get(board.source, "jobs")
    return F.to_json(F.struct(items.alias(name))) if name else F.to_json(items)


def _board_pages(spark, sf) -> DataFrame:
    names = ", ".join(lit(n) for n in _BOARD_NAMES)
    pages = _items_per_page(spark, sf).withColumn("source", F.expr(f"element_at(array({names}), cast(page % {len(_BOARD_NAMES)} as int) + 1)"))
    payload = F.coalesce(*[F.when(F.col("source") == b.source, _board_payload(b)) for b in B.JSON_BOARDS])
    return pages.select("page", "source", payload.alias("payload"))


def _items_per_page(spark, sf) -> DataFrame:
    """The listings of each span of ids."""
    df = listings(spark, sf).selectExpr(
        "*", "concat(coalesce(location_city, 'Nowhere'), ', ', coalesce(location_country, '')) AS place", f"{_DAY} AS posted"
    )
    item = F.struct("id", "title", "company_name", "description", "apply_url", "tech_stack", "visa_sponsorship", "salary_min", "place", "posted")
    return df.groupBy(F.expr(f"id div {SPAN}").alias("page")).agg(F.array_sort(F.collect_list(item)).alias("items"))


_CITY = "nullif(trim(coalesce(location_city, 'Nowhere')), '')"


@query(
    "json_board_rows", "S-11 S-13 S-16 P-11 P-13 W-3 D-4",
    f"WITH n AS (SELECT *, id // {SPAN} AS page, id % {SPAN} AS pos FROM listings) "
    + " UNION ALL ".join(
        f"""SELECT {B.source_rank(b.source)}::BIGINT AS source_rank, page, pos, {lit(b.source)} AS source, title,
        {key_sha('company_name', 'title', f"coalesce({_CITY}, '')", "''")} AS dedup_hash, {_CITY} AS location_city,
        {lit(b.overrides['experience_level']) if 'experience_level' in b.overrides else rule_case('lower(title)', fv.PAGE_LEVEL_TERMS, 'mid')} AS experience_level,
        {lit(b.overrides['remote_type']) if 'remote_type' in b.overrides else
         (sql_remote("lower(title || ' ' || coalesce(description, '') || '  ')", fv.PAGE_HYBRID_WORDS) if b.remote == '' else
          (lit('remote') if b.remote == 'remote' else ("CASE WHEN visa_sponsorship THEN 'remote' ELSE 'onsite' END" if b.remote == 'flag' else
           "CASE WHEN visa_sponsorship THEN 'remote' ELSE " + sql_remote("lower(title || ' ' || coalesce(description, '') || '  ')", fv.PAGE_HYBRID_WORDS) + " END")))} AS remote_type,
        {lit(b.overrides.get('company_type', 'startup'))} AS company_type,
        {list_text("CASE WHEN len(tech_stack) > 0 THEN tech_stack END") if b.tags == 'tags' else 'CAST(NULL AS VARCHAR)'} AS tech_stack,
        {_SQL_POSTED if b.posted else ts_text(AS_OF)} AS posted_date,
        {"CASE WHEN true THEN 'INR' END" if b.always_currency else ("CASE WHEN coalesce(salary_min, 0) <> 0 THEN 'INR' ELSE 'USD' END" if b.salary_currency == 'INR' else "'USD'")} AS salary_currency
        FROM n WHERE page % {len(B.JSON_BOARDS)} = {i} {"AND title <> '' AND company_name <> ''" if b.need_title_company else ''}"""
        for i, b in enumerate(B.JSON_BOARDS)
    ),
)
def json_board_rows(spark, sf):
    items = B.json_board_items(_board_pages(spark, sf), "payload", keep=("page",))
    ranks = value_map("source", {b.source: str(B.source_rank(b.source)) for b in B.JSON_BOARDS})
    items = items.withColumn("source_rank", F.expr(ranks).cast("int"))
    out = B.json_board_rows(items, LISTINGS_AS_OF, ("source_rank", "page"))
    return out.select(
        "source_rank", "page", "pos", list_col("source_platforms", "source"), "title", "dedup_hash", "location_city", "experience_level",
        "remote_type", "company_type", list_col("tech_stack"), ts_col("posted_date"), "salary_currency",
    )


# One HTML page per eight orders, a card per order, cards nested in divs. Two
# neighbours share a link.
CARDS = 8
_BOARDS = list(B.HTML_BOARDS)


def _card_pages(spark, sf) -> DataFrame:
    ref, board = F.expr("o_orderkey div 2"), F.expr(f"(o_orderkey div {CARDS}) % {len(_BOARDS)}")
    card = F.concat(
        F.lit('<div class="job-card listjob"><div class="top"><h3 class="title"> Role &amp; '), F.col("o_orderkey"),
        F.lit(' Engineer<br></h3><span class="company">'), F.when(F.col("o_orderstatus") != "F", F.concat(F.lit("Maker "), "o_custkey")).otherwise(""),
        F.lit("</span></div>"),
        F.when(F.col("o_totalprice") > 90000, F.concat(F.lit('<span class="location">City '), "o_custkey", F.lit(", India</span>"))).otherwise(""),
        F.lit('<a href="'), F.when(ref % 3 == 0, F.lit("https://x.example/")).when(board == 0, "/companies/").otherwise("/job/"), ref, F.lit('">Apply</a></div>'),
    )
    df = table(spark, sf, "orders").select("o_orderkey", card.alias("card"))
    df = df.groupBy(F.expr(f"o_orderkey div {CARDS}").alias("page_id")).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "card"))).alias("cards"))
    body = F.array_join(F.transform("cards", lambda c: c["card"]), "\n")
    return df.select("page_id", F.concat(F.lit('<html><body><ul><li>Jobs<p><div id="main">'), body, F.lit("</body>")).alias("html"))


_CARDS = f"""d AS (SELECT o_orderkey // {CARDS} AS page_id, o_orderkey % {CARDS} AS pos, 'Role & ' || o_orderkey || ' Engineer' AS title,
    CASE WHEN o_orderstatus <> 'F' THEN 'Maker ' || o_custkey ELSE '' END AS company, CASE WHEN o_totalprice > 90000 THEN 'City ' || o_custkey || ', India' END AS place,
    CASE WHEN (o_orderkey // 2) % 3 = 0 THEN 'https://x.example/' WHEN (o_orderkey // {CARDS}) % {len(_BOARDS)} = 0 THEN '/companies/' ELSE '/job/' END || (o_orderkey // 2) AS href
    FROM orders)"""


def _by_board(value) -> str:
    """A board constant as CASE over the source."""
    return "CASE source " + " ".join(f"WHEN {lit(b.source)} THEN {lit(str(value(b)))}" for b in _BOARDS) + " END"


# The rules of two boards fit only the links themselves, so their titles are the link texts.
_LINK_BOARDS = "('YC-Jobs', 'Karkidi')"
_HTML_SQL = f"""WITH {_CARDS}, t AS (SELECT *, ([{', '.join(lit(b.source) for b in _BOARDS)}])[(page_id % {len(_BOARDS)}) + 1] AS source FROM d),
  s AS (SELECT page_id, pos, href, source, CASE WHEN source IN {_LINK_BOARDS} THEN 'Apply' ELSE title END AS title, CASE WHEN source IN {_LINK_BOARDS} THEN '' ELSE company END AS company,
    CASE WHEN source NOT IN ('YC-Jobs', 'Karkidi', 'Simplify') THEN place END AS place FROM t WHERE source NOT IN {_LINK_BOARDS} OR href LIKE '/%'),
  k AS (SELECT *, {_by_board(lambda b: b.unique_links)} AS unique_links, {_by_board(lambda b: b.need_company)} AS need_company,
    coalesce(nullif(company, ''), {_by_board(lambda b: b.default_company)}) AS named, coalesce(place, {_by_board(lambda b: b.default_location)}) AS located,
    {_by_board(lambda b: b.origin)} AS origin, {_by_board(lambda b: b.absolute_only)} AS absolute_only FROM s
    QUALIFY unique_links = 'False' OR row_number() OVER (PARTITION BY page_id, href ORDER BY pos) = 1)
  SELECT source, page_id, title, named AS company_name, split_part(located, ',', 1) AS location_city,
    CASE WHEN contains(located, ',') THEN trim(regexp_extract(located, '[^,]*$')) END AS location_country,
    CASE WHEN href LIKE 'http%' THEN href WHEN absolute_only <> '' THEN absolute_only ELSE origin || href END AS apply_url,
    title || ' at ' || named AS description, {_by_board(lambda b: b.overrides.get('experience_level', 'mid'))} AS experience_level,
    {_by_board(lambda b: b.overrides.get('remote_type', b.remote_hint or 'onsite'))} AS remote_type, source = 'MigrateMate' AS visa_sponsorship,
    CASE source WHEN 'AI-Jobs' THEN 'AI|Machine Learning' WHEN 'Karkidi' THEN 'AI|Machine Learning|Data Science' END AS tech_stack
  FROM k WHERE need_company = 'False' OR company <> ''"""


@query("html_board_rows", "S-12 S-13 X-20 X-21 X-22 X-23 D-7 P-11 P-13 W-3", _HTML_SQL)
def html_board_rows(spark, sf):
    """Every page belongs to one of the boards."""
    names = ", ".join(lit(b.source) for b in _BOARDS)
    pages = _card_pages(spark, sf).withColumn("source", F.expr(f"element_at(array({names}), cast(page_id % {len(_BOARDS)} as int) + 1)"))
    rows = B.html_board_rows(pages, "page_id", "html", "source", LISTINGS_AS_OF)
    return rows.select(
        "source", "page_id", "title", "company_name", "location_city", "location_country", "apply_url", "description",
        "experience_level", "remote_type", "visa_sponsorship", list_col("tech_stack"),
    )

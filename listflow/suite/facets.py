"""Faceted search, paging, counts and breakdowns."""

from __future__ import annotations

from pyspark.sql import functions as F

from listflow.functions import fixed_values as fv
from listflow.operators import search as S, stats
from listflow.operators.lifecycle import in_home_region
from listflow.operators.matching import one_row
from listflow.plans.jobs import query_grid, search_with_ats
from listflow.session import shared_dir
from listflow.suite.registry import query, ts_col, ts_text
from listflow.suite.views import EVENTS_AS_OF, LISTINGS_AS_OF, POSTINGS_AS_OF, lit, listings, postings, table
from listflow.suite.words import ATS

AS_OF = f"TIMESTAMP '{LISTINGS_AS_OF}'"
OPEN = f"is_active AND posted_date >= {AS_OF} - INTERVAL 45 DAY"
# Wide enough that a page has rows: the search looks back over all years.
YEARS = 3650
OPEN_YEARS = f"is_active AND posted_date >= {AS_OF} - INTERVAL {YEARS} DAY"


# ------------------------------------------------------------------ predicates
@query(
    "search_keyword", "F-1",
    """SELECT id FROM listings WHERE title ILIKE '%data%' OR company_name ILIKE '%data%' OR description ILIKE '%data%'""",
)
def search_keyword(spark, sf):
    return listings(spark, sf).where(S.keyword("Data")).select("id")


@query(
    "search_literal_signs", "F-1",
    "SELECT doc_id FROM documents WHERE contains(lower(text), '%') OR contains(lower(text), '_a')",
)
def search_literal_signs(spark, sf):
    """Percent and underscore are plain characters, not wildcards."""
    df = table(spark, sf, "documents")
    return df.where(S.keyword("%", ("text",)) | S.keyword("_A", ("text",))).select("doc_id")


@query("search_whole_texts", "F-1", "SELECT doc_id FROM documents WHERE contains(lower(text), 'the of')")
def search_whole_texts(spark, sf):
    return table(spark, sf, "documents").where(S.keyword("THE of", ("text",))).select("doc_id")


@query(
    "search_location", "F-2",
    """SELECT id FROM listings WHERE contains(lower(location_city), 'india') OR contains(lower(location_country), 'india') OR location_country = 'IN'""",
)
def search_location(spark, sf):
    return listings(spark, sf).where(S.at_location("India")).select("id")


_PARAMS = dict(
    remote_type="remote", experience_level="senior", job_type="contract", visa_sponsorship=True, salary_min=1000.0, salary_max=0, q="",
)


@query(
    "search_facets", "F-3 F-4 F-18",
    "SELECT id FROM listings WHERE remote_type = 'remote' AND experience_level = 'senior' AND visa_sponsorship = true AND job_type = 'contract' AND salary_min >= 1000",
)
def search_facets(spark, sf):
    params = S.SearchParams.from_dict(_PARAMS)
    return S.where_all(listings(spark, sf), S.predicates(params, LISTINGS_AS_OF)).select("id")


@query(
    "search_company_facets", "F-3 F-4",
    """SELECT id FROM listings WHERE company_type = 'startup' AND vc_backer = 'YC' AND relocation_support = true AND salary_max <= 200000""",
)
def search_company_facets(spark, sf):
    params = S.SearchParams(company_type="startup", vc_backer="YC", relocation_support=True, salary_max=200000)
    return S.where_all(listings(spark, sf), S.predicates(params, LISTINGS_AS_OF)).select("id")


@query(
    "search_tags", "F-5 F-6",
    "SELECT id, list_contains(source_platforms, 'Adzuna') AS from_adzuna FROM listings WHERE list_has_all(tech_stack, ['Python', 'SQL'])",
)
def search_tags(spark, sf):
    df = listings(spark, sf).where(S.has_all_tags("Python, SQL"))
    return df.select("id", S.has_tag("Adzuna").alias("from_adzuna"))


def _since(days: int) -> str:
    return f"coalesce(posted_date >= TIMESTAMP '{POSTINGS_AS_OF}' - INTERVAL {days} DAY, false)"


@query(
    "search_posted_within", "F-7",
    f"SELECT id, {_since(1)} AS day, {_since(7)} AS week, {_since(30)} AS month, {_since(30)} AS other FROM postings",
)
def search_posted_within(spark, sf):
    def flag(period: str):
        return F.coalesce(S.posted_within(period, POSTINGS_AS_OF), F.lit(False))

    return postings(spark, sf).select("id", flag("24h").alias("day"), flag("week").alias("week"), flag("month").alias("month"), flag("year").alias("other"))


@query(
    "search_unexpired_tiers", "F-8 F-9",
    f"""SELECT id, coalesce(is_featured = true, false) AS featured, coalesce(is_featured <> true, false) AS regular FROM listings WHERE {OPEN}""",
)
def search_unexpired_tiers(spark, sf):
    df = listings(spark, sf).where(S.unexpired(LISTINGS_AS_OF))
    return df.select("id", F.coalesce(S.is_featured(), F.lit(False)).alias("featured"), F.coalesce(S.not_featured(), F.lit(False)).alias("regular"))


@query(
    "company_list", "F-16",
    """SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_name ILIKE '%9%' AND c_mktsegment = 'BUILDING' ORDER BY 1""",
)
def company_list(spark, sf):
    df = table(spark, sf, "customer").selectExpr(
        "c_custkey AS id", "c_name AS name", "c_mktsegment AS company_type", "array(c_mktsegment) AS vc_backers"
    )
    return S.list_companies(df, "9", "BUILDING", "BUILDING").select("id", "name")


def _companies(spark, sf):
    return table(spark, sf, "customer").selectExpr("c_custkey AS id", "c_name AS name", "c_mktsegment AS company_type", "array(c_mktsegment) AS vc_backers")


@query("company_page", "F-16 G-4", "SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_name ILIKE '%9%' ORDER BY 1 LIMIT 20 OFFSET 40")
def company_page(spark, sf):
    return S.list_companies(_companies(spark, sf), "9", page=3).select("id", "name")


@query("company_total", "F-16 A-2", "SELECT count(*) AS total FROM customer WHERE c_name ILIKE '%9%' AND c_mktsegment = 'BUILDING'")
def company_total(spark, sf):
    return S.company_total(_companies(spark, sf), "9", "BUILDING")


@query(
    "company_profile", "F-16 J-3",
    """SELECT 'google-india' AS company_slug, id, company_name, count(*) OVER () AS job_count FROM
       (SELECT * FROM listings WHERE is_active AND company_name ILIKE '%google india%' ORDER BY posted_date DESC NULLS FIRST, id LIMIT 50)""",
)
def company_profile(spark, sf):
    """Every company name of the listings has a page of its own."""
    df = listings(spark, sf)
    companies = df.select(F.col("company_name").alias("name")).distinct().withColumn("slug", F.replace(F.lower("name"), F.lit(" "), F.lit("-")))
    return S.company_profile(companies, df, "google-india").select("company_slug", "id", "company_name", "job_count")


# ------------------------------------------------------------------ sorting and paging
@query(
    "sorted_nulls_first", "G-1 H-2",
    "SELECT id, row_number() OVER (ORDER BY salary_min DESC NULLS FIRST, id) AS position FROM listings QUALIFY position <= 100",
)
def sorted_nulls_first(spark, sf):
    from pyspark.sql import Window

    top = listings(spark, sf).select("id", "salary_min").orderBy(*S.sort_keys("salary_min")).limit(100)
    # The window sees the 100 rows of the page only.
    return top.withColumn("position", F.row_number().over(Window.orderBy(*S.sort_keys("salary_min")))).select("id", "position")


@query(
    "page_by_offset", "G-2",
    "SELECT id FROM listings ORDER BY salary_max ASC NULLS LAST, id LIMIT 25 OFFSET 50",
)
def page_by_offset(spark, sf):
    df = listings(spark, sf).select("id", "salary_max")
    return S.page_of(df, S.sort_keys("salary_max", False), 3, 25).select("id")


@query(
    "page_by_index", "G-2",
    "SELECT id, n // 20 + 1 AS page FROM (SELECT id, row_number() OVER (ORDER BY salary_max DESC NULLS FIRST, id) - 1 AS n FROM listings) WHERE n // 20 + 1 IN (1, 7, 700)",
)
def page_by_index(spark, sf):
    """Pages near and far by one index; each reads the ranges of its own rows."""
    df, path, order = listings(spark, sf).select("id", "salary_max"), shared_dir(spark, "pages"), S.sort_keys("salary_max")
    S.build_page_index(df, path, order, 16)
    pages = [S.page_from_index(spark, path, order, n, 20, df.schema).select("id", F.lit(n).alias("page")) for n in (1, 7, 700)]
    return pages[0].union(pages[1]).union(pages[2])


@query(
    "page_by_cursor", "G-8",
    """SELECT id, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at FROM listings
       WHERE created_at < TIMESTAMP '2000-01-01' OR (created_at = TIMESTAMP '2000-01-01' AND id > 5) ORDER BY listings.created_at DESC, id LIMIT 50""",
)
def page_by_cursor(spark, sf):
    df = listings(spark, sf).select("id", "created_at")
    return S.page_after(df, 50, ("2000-01-01 00:00:00", 5)).select("id", ts_col("created_at"))


def _page_sql(regular: str, featured: str, page: int, per_page: int) -> str:
    reg = f"""SELECT *, 1 AS tier, row_number() OVER (ORDER BY created_at DESC NULLS FIRST, id) AS n FROM listings
      WHERE {OPEN} AND is_featured <> true AND {regular} QUALIFY n > {(page - 1) * per_page} AND n <= {page * per_page}"""
    feat = f"""SELECT *, 0 AS tier, row_number() OVER (ORDER BY created_at DESC NULLS FIRST, id) AS n FROM listings
      WHERE {OPEN} AND is_featured = true AND {featured} QUALIFY n <= 50"""
    rows = f"(({feat}) UNION ALL ({reg}))" if page == 1 else f"({reg})"
    return f"""SELECT id, tier::BIGINT AS tier, {ATS} AS ats_detected,
      tier = 1 AND created_at > {AS_OF} - INTERVAL 10 MINUTE AS _is_new FROM {rows}"""


@query(
    "search_first_page", "G-3 G-5 H-4 P-16 C-16 E1 F-1 O-3",
    _page_sql("salary_min >= 1000", "true", 1, 20),
)
def search_first_page(spark, sf):
    out = search_with_ats(listings(spark, sf), {"salary_min": 1000.0}, LISTINGS_AS_OF, page=1, per_page=20, featured_limit=50)
    return out.select("id", "tier", "ats_detected", "_is_new")


@query("search_later_page", "G-2 G-3 G-4", _page_sql("remote_type = 'remote'", "true", 2, 10))
def search_later_page(spark, sf):
    out = search_with_ats(listings(spark, sf), {"remote_type": "remote", "q": ""}, LISTINGS_AS_OF, page=2, per_page=10)
    return out.select("id", "tier", "ats_detected", "_is_new")


@query(
    "search_featured_pages", "G-3 G-4",
    f"""WITH r AS (SELECT id, is_featured = true AS top, row_number() OVER (PARTITION BY is_featured = true ORDER BY created_at DESC NULLS FIRST, id) AS n
        FROM listings WHERE {OPEN} AND (is_featured = true OR is_featured <> true AND salary_min >= 1000))
      SELECT page, id, CASE WHEN top THEN 0 ELSE 1 END::BIGINT AS tier FROM r, (VALUES (1::BIGINT), (2::BIGINT), (3::BIGINT)) p(page)
      WHERE CASE WHEN top THEN n > (page - 1) * 15 AND n <= page * 15 ELSE n > (page - 1) * 20 AND n <= page * 20 END""",
)
def search_featured_pages(spark, sf):
    """Featured rows beyond the first page's stand on the pages after it."""
    df, params = listings(spark, sf), S.SearchParams(salary_min=1000.0)
    pages = [S.search_page(df, params, LISTINGS_AS_OF, page=n, featured_limit=15).select(F.lit(n).alias("page"), "id", "tier") for n in (1, 2, 3)]
    return pages[0].union(pages[1]).union(pages[2])


@query(
    "search_totals", "G-4 A-2 X-27",
    f"""WITH c AS (SELECT count(*) FILTER (WHERE is_featured <> true AND salary_min >= 1000) + count(*) FILTER (WHERE is_featured) AS total
        FROM listings WHERE {OPEN}) SELECT total, CAST(ceil(total / 20.0) AS BIGINT) AS total_pages FROM c""",
)
def search_totals(spark, sf):
    return S.search_totals(listings(spark, sf), S.SearchParams(salary_min=1000.0), LISTINGS_AS_OF)


@query(
    "regular_minus_featured", "J-5 O-3",
    "SELECT id FROM listings WHERE is_active AND id NOT IN (SELECT id FROM listings WHERE is_featured)",
)
def regular_minus_featured(spark, sf):
    df = listings(spark, sf)
    return S.without(df.where("is_active").select("id"), df.where("is_featured"))


@query(
    "saved_flags", "J-6",
    """SELECT c_custkey AS user_id, c_custkey IN (SELECT user_id FROM events WHERE event_type = 'purchase') AS is_saved FROM customer""",
)
def saved_flags(spark, sf):
    users = table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"))
    return S.flag_members(users, table(spark, sf, "events").where("event_type = 'purchase'"), "user_id", "is_saved")


@query(
    "saved_only", "J-6",
    "SELECT c_custkey AS user_id FROM customer WHERE c_custkey IN (SELECT user_id FROM events WHERE event_type = 'signup')",
)
def saved_only(spark, sf):
    users = table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"))
    return S.only(users, table(spark, sf, "events").where("event_type = 'signup'"), "user_id")


@query("single_listing", "S-19", "SELECT id, title, company_name FROM listings WHERE id = 17")
def single_listing(spark, sf):
    df = listings(spark, sf).select("id", "title", "company_name")
    row = one_row(df, F.col("id") == 17)
    return df.where(F.col("id") == F.lit(row.id))


@query(
    "query_place_grid", "J-14 G-6",
    """WITH t AS (SELECT DISTINCT title AS name, contains(title, 'Engineer') AS is_home FROM listings),
       q AS (SELECT name FROM t QUALIFY row_number() OVER (PARTITION BY is_home ORDER BY sha256(name || '|7'), name) <= 3),
       p AS (SELECT n_name AS place FROM nation QUALIFY row_number() OVER (PARTITION BY n_regionkey = 0 ORDER BY sha256(n_name || '|7'), n_name) <= 2)
       SELECT q.name AS query, place FROM q, p""",
)
def query_place_grid(spark, sf):
    """Sampled titles and nations."""
    titles = listings(spark, sf).select(F.col("title").alias("name")).distinct()
    titles = titles.withColumn("is_home", F.contains("name", F.lit("Engineer")))
    places = table(spark, sf, "nation").select(F.col("n_name").alias("name"), (F.col("n_regionkey") == 0).alias("is_home"))
    return query_grid(titles, places, seed=7)


# ------------------------------------------------------------------ counts
@query(
    "dashboard_counts", "A-1",
    f"""SELECT count(*) AS total_jobs, count(*) FILTER (WHERE remote_type = 'remote') AS remote_jobs, count(*) FILTER (WHERE company_type = 'vc_backed') AS vc_backed_jobs,
        count(*) FILTER (WHERE is_stealth) AS stealth_jobs, count(*) FILTER (WHERE company_type = 'big_tech') AS big_tech_jobs,
        count(*) FILTER (WHERE visa_sponsorship) AS visa_jobs, count(*) FILTER (WHERE relocation_support) AS relo_jobs,
        count(*) FILTER (WHERE is_featured) AS featured_jobs FROM listings WHERE {OPEN}""",
)
def dashboard_counts(spark, sf):
    return stats.dashboard(listings(spark, sf), LISTINGS_AS_OF)


_DOMAINS = {"experience_level": fv.EXPERIENCE_LEVELS, "job_type": fv.JOB_TYPES, "remote_type": fv.REMOTE_TYPES}


@query(
    "region_breakdown", "A-3 A-7",
    "WITH home AS (SELECT * FROM listings WHERE is_active AND (contains(lower(location_country), 'india') OR location_country = 'IN')) "
    + " UNION ALL ".join(
        f"SELECT '{facet}' AS facet, {lit(v)} AS value, count(*) FILTER (WHERE {facet} = {lit(v)}) AS n,"
        f" CAST(count(*) FILTER (WHERE {facet} = {lit(v)}) * 100 // 10000 AS BIGINT) AS percent FROM home"
        for facet, values in _DOMAINS.items() for v in values
    ),
)
def region_breakdown(spark, sf):
    out = stats.region_breakdown(listings(spark, sf), in_home_region(F.col("location_country")))
    return out.withColumn("percent", stats.progress(F.col("n"), 10_000))


@query(
    "counts_by_source", "A-4",
    "SELECT source, count(*) AS n FROM (SELECT unnest(source_platforms) AS source FROM postings) GROUP BY source",
)
def counts_by_source(spark, sf):
    return stats.count_by_source(postings(spark, sf))


@query(
    "counts_by_level_map", "A-4",
    """SELECT array_to_string(list(experience_level || '=' || n ORDER BY experience_level), ',') AS counts FROM
       (SELECT experience_level, count(*) AS n FROM listings WHERE experience_level IS NOT NULL GROUP BY 1)""",
)
def counts_by_level_map(spark, sf):
    counts = listings(spark, sf).groupBy("experience_level").agg(F.count("*").alias("n"))
    df = stats.as_map(counts, "experience_level", "n", "m")
    pairs = F.transform(F.map_entries("m"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return df.select(F.array_join(pairs, ",").alias("counts"))


_TITLE_TERMS = "[" + ", ".join(f"CASE WHEN contains(lower(title), '{t}') THEN '{t}' END" for t in fv.TRENDING_TITLE_TERMS) + "]"


def _trending_sql(view: str, as_of: str, days: int) -> str:
    return f"""WITH r AS (SELECT * FROM {view} WHERE is_active AND posted_date >= TIMESTAMP '{as_of}' - INTERVAL {days} DAY),
      k AS (SELECT lower(trim(t)) AS keyword FROM (SELECT unnest(tech_stack) AS t FROM r) WHERE length(trim(t)) > 1
        UNION ALL SELECT k FROM (SELECT unnest({_TITLE_TERMS}) AS k FROM r) WHERE k IS NOT NULL)
      SELECT keyword, count(*) AS count FROM k GROUP BY keyword ORDER BY count DESC, keyword LIMIT 20"""


@query("trending_terms", "A-5", _trending_sql("listings", LISTINGS_AS_OF, YEARS))
def trending_terms(spark, sf):
    return stats.trending_terms(listings(spark, sf), LISTINGS_AS_OF, days=YEARS)


@query("trending_terms_week", "A-5", _trending_sql("postings", POSTINGS_AS_OF, 7))
def trending_terms_week(spark, sf):
    return stats.trending_terms(postings(spark, sf), POSTINGS_AS_OF)


@query(
    "active_counts", "A-10", "SELECT count(*) FILTER (WHERE is_active) AS active, count(*) FILTER (WHERE NOT is_active) AS inactive FROM listings",
)
def active_counts(spark, sf):
    return stats.active_counts(listings(spark, sf))


@query(
    "load_report", "A-8",
    """SELECT event_type AS action, CASE WHEN value < 5 THEN 'low' ELSE 'ok' END AS reason, count(*) AS n FROM events GROUP BY 1, 2""",
)
def load_report(spark, sf):
    df = table(spark, sf, "events").selectExpr("event_type AS action", "CASE WHEN value < 5 THEN 'low' ELSE 'ok' END AS reason")
    return stats.load_report(df)


@query(
    "new_per_window", "T-7",
    f"SELECT {ts_text('time_bucket(INTERVAL 10 MINUTE, ts)')} AS window_start, count(*) AS n FROM events GROUP BY 1",
)
def new_per_window(spark, sf):
    return stats.new_per_window(table(spark, sf, "events"), "ts").select(ts_col("window_start"), "n")


@query(
    "recent_event_types", "F-7 A-10",
    f"SELECT event_type, count(*) AS n FROM events WHERE ts >= TIMESTAMP '{EVENTS_AS_OF}' - INTERVAL 7 DAY GROUP BY 1",
)
def recent_event_types(spark, sf):
    df = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return df.where(S.posted_within("week", EVENTS_AS_OF, "ts")).groupBy("event_type").agg(F.count("*").alias("n"))

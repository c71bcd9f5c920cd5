"""Per-user tables, ranking, nearest vectors and alerts."""

from __future__ import annotations

from pyspark.sql import functions as F

from listflow.functions import fixed_values as fv
from listflow.functions.classify import tier_or_stored
from listflow.operators import accounts as A, alerts, ranking as R, similarity as V, stats
from listflow.operators.lifecycle import one_default
from listflow.operators.lsh import planes, top_similar_hashed
from listflow.operators.matching import one_row, overlap_counts, overlaps_of_at_least, top_per_group
from listflow.schemas import ranking_columns
from listflow.suite.keys import sql_stars
from listflow.suite.registry import any_of, case, list_col, query
from listflow.suite.views import LISTINGS_AS_OF, POSTINGS_AS_OF, lit, listings, postings, table
from listflow.suite.words import TEXT, sql_days, sql_domain

AS_OF = f"TIMESTAMP '{LISTINGS_AS_OF}'"


# ------------------------------------------------------------------ accounts
# Saves: one per line item, of the order (listing) by the supplier (user).
def _saves(spark, sf):
    return table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("user_id"), F.col("l_partkey").alias("job_id"), F.col("l_shipdate").cast("timestamp").alias("created_at"),
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"),
    )


_SAVES = "(SELECT l_suppkey AS user_id, l_partkey AS job_id, l_shipdate AS created_at, l_orderkey || '-' || l_linenumber AS id FROM lineitem)"


@query(
    "saved_page_per_user", "J-1 W-1 P-17",
    f"""SELECT user_id, position, s.id, p_name, p_brand FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id) AS position
        FROM {_SAVES}) s LEFT JOIN part ON job_id = p_partkey WHERE position > 20 AND position <= 40""",
)
def saved_page_per_user(spark, sf):
    parts = table(spark, sf, "part").select("p_partkey", "p_name", "p_brand")
    page = A.page_per_user(_saves(spark, sf), "user_id", [F.desc("created_at"), F.asc("id")], page=2)
    joined = A.with_listing(page, parts, "job_id", "p_partkey")
    return joined.select("user_id", "position", "id", "jobs.p_name", "jobs.p_brand")


@query(
    "saved_by_one_user", "J-1 J-2 F-19 S-25",
    f"SELECT id, job_id, p_name FROM {_SAVES} LEFT JOIN part ON job_id = p_partkey WHERE user_id = 3",
)
def saved_by_one_user(spark, sf):
    mine = A.newest_first(A.tenant_view(_saves(spark, sf), 3), "created_at")
    parts = table(spark, sf, "part").select("p_partkey", "p_name")
    return A.with_listing(mine, parts, "job_id", "p_partkey").select("id", "job_id", "jobs.p_name")


@query(
    "listings_of_saves", "P-17 J-2",
    """SELECT o_orderkey AS id, o_orderpriority AS title FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'F'""",
)
def listings_of_saves(spark, sf):
    jobs = table(spark, sf, "orders").where("o_orderstatus <> 'F'").selectExpr("o_orderkey AS id", "o_orderpriority AS title")
    saves = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("job_id"))
    return A.listings_only(A.with_listing(saves, jobs))


_METHOD = "CASE o_orderpriority WHEN '1-URGENT' THEN 'external' WHEN '5-LOW' THEN NULL ELSE 'direct' END"
_APP_STATUS = "CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'applied' END"


@query(
    "direct_applications", "F-17 J-2",
    f"""SELECT o_orderkey AS id FROM orders WHERE {_METHOD} <> 'external' AND NOT coalesce({_APP_STATUS} = 'failed', false)""",
)
def direct_applications(spark, sf):
    df = table(spark, sf, "orders").selectExpr("o_orderkey AS id", f"{_METHOD} AS apply_method", f"{_APP_STATUS} AS status")
    return A.shown_applications(A.direct_applications(df)).select("id")


@query(
    "cascade_orphans", "J-10",
    "SELECT event_id FROM events WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0)",
)
def cascade_orphans(spark, sf):
    users = table(spark, sf, "customer").where("c_acctbal >= 0")
    return A.cascade(table(spark, sf, "events"), users, "user_id", "c_custkey").select("event_id")


@query(
    "default_resumes", "J-12 W-1 L-6",
    """SELECT c_custkey AS user_id, resume_url, resume_filename FROM customer LEFT JOIN
       (SELECT o_custkey, 'file://' || o_orderkey AS resume_url, o_orderpriority AS resume_filename FROM orders
        QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1) ON c_custkey = o_custkey""",
)
def default_resumes(spark, sf):
    resumes = table(spark, sf, "orders").selectExpr(
        "o_orderkey AS id", "o_custkey AS user_id", "concat('file://', o_orderkey) AS file_url", "o_orderpriority AS file_name",
        "cast(o_orderdate as timestamp) AS uploaded_at",
    )
    marked = one_default(resumes, "user_id", [F.col("uploaded_at"), F.col("id")])
    users = table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"))
    return A.with_default_resume(users, marked)


_FORM = "SELECT s_suppkey AS user_id, CASE WHEN s_acctbal < 4000 THEN '  ' ELSE s_name END AS full_name, CAST(NULL AS VARCHAR) AS phone FROM supplier"


@query(
    "form_filled_from_profile", "J-13",
    f"""SELECT f.user_id, coalesce(nullif(CASE WHEN trim(full_name) <> '' THEN full_name END, ''), c_name, '') AS full_name, coalesce(c_mktsegment, '') AS phone
        FROM ({_FORM}) f LEFT JOIN customer ON f.user_id = c_custkey""",
)
def form_filled_from_profile(spark, sf):
    forms = table(spark, sf, "supplier").selectExpr(
        "s_suppkey AS user_id", "CASE WHEN s_acctbal < 4000 THEN '  ' ELSE s_name END AS full_name", "cast(null as string) AS phone"
    )
    profiles = table(spark, sf, "customer").selectExpr("c_custkey AS user_id", "c_name", "c_mktsegment")
    return A.fill_from_profile(forms, profiles, "user_id", {"full_name": "c_name", "phone": "c_mktsegment"})


@query(
    "form_prefill", "J-13 X-25",
    """SELECT p_partkey AS id, split_part(p_name, ' ', 1) AS first_name, CASE WHEN contains(p_name, ' ') THEN substr(p_name, strpos(p_name, ' ') + 1) ELSE '' END AS last_name,
       p_name AS name, p_brand AS email, coalesce(CASE WHEN p_size > 20 THEN p_type END, '') AS org FROM part""",
)
def form_prefill(spark, sf):
    profiles = table(spark, sf, "part").selectExpr(
        "p_partkey AS id", "p_name AS full_name", "p_brand AS email", "CASE WHEN p_size > 20 THEN p_type END AS current_company",
        *[f"cast(null as string) AS {c}" for c in ("phone", "linkedin_url", "portfolio_url", "location", "cover_letter_default")],
    )
    return A.form_prefill(profiles).select("id", "first_name", "last_name", "name", "email", "org")


@query(
    "new_user_profiles", "S-24",
    """SELECT c_custkey AS id, c_name || '@example.org' AS email, CASE WHEN c_acctbal > 0 THEN c_mktsegment ELSE c_name || '@example.org' END AS full_name
       FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)""",
)
def new_user_profiles(spark, sf):
    users = table(spark, sf, "customer").selectExpr(
        "c_custkey AS id", "concat(c_name, '@example.org') AS email",
        "CASE WHEN c_acctbal > 0 THEN to_json(named_struct('full_name', c_mktsegment)) ELSE '{}' END AS raw_user_meta_data",
    )
    return A.new_profiles(users, table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id")))


@query(
    "shared_tags", "J-7",
    """WITH w AS (SELECT DISTINCT p_partkey, lower(unnest(string_split(p_name, ' '))) AS tag FROM part),
       b AS (SELECT DISTINCT p_brand, lower(unnest(string_split(p_name, ' '))) AS tag FROM part)
       SELECT p_brand, p_partkey, count(*) AS shared FROM w JOIN b USING (tag) GROUP BY 1, 2""",
)
def shared_tags(spark, sf):
    part = table(spark, sf, "part")
    rows = part.select("p_partkey", F.split("p_name", " ").alias("tags"))
    brands = part.select("p_brand", F.explode(F.split("p_name", " ")).alias("t")).distinct()
    brands = brands.groupBy("p_brand").agg(F.collect_set("t").alias("tags"))
    return overlap_counts(brands, "p_brand", "tags", rows, "p_partkey", "tags").select("p_brand", "p_partkey", "shared")


@query(
    "shared_tags_at_least", "J-7",
    """WITH t AS (SELECT DISTINCT o_custkey AS id, l_partkey AS part FROM orders JOIN lineitem ON l_orderkey = o_orderkey)
       SELECT a.id AS left_id, b.id AS right_id, count(*) AS shared FROM t a JOIN t b ON a.part = b.part AND a.id < b.id GROUP BY 1, 2 HAVING count(*) >= 4""",
)
def shared_tags_at_least(spark, sf):
    """Customers who ordered at least four of the same parts; a small block, so that common parts are met in several."""
    orders, lines = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    bought = orders.join(lines, orders.o_orderkey == lines.l_orderkey).groupBy("o_custkey").agg(F.collect_set(F.col("l_partkey").cast("string")).alias("tags"))
    return overlaps_of_at_least(bought.withColumnRenamed("o_custkey", "left_id"), "left_id", "tags", bought.withColumnRenamed("o_custkey", "right_id"), "right_id", "tags", 4, block=16, ordered=True)


@query(
    "newest_orders_per_customer", "W-1 W-4",
    "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rank FROM orders QUALIFY rank <= 3",
)
def newest_orders_per_customer(spark, sf):
    df = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return top_per_group(df, ["o_custkey"], [F.desc("o_orderdate"), F.asc("o_orderkey")], 3, rank="rank").drop("o_orderdate")


# ------------------------------------------------------------------ keyword ranking
KEYWORDS = ["Python", "data engineer", "SQL", "remote ", "the"]
FACETS = {"experience_level": "senior", "remote_type": "remote", "job_type": "contract"}
_WORDS = [k.lower().strip() for k in KEYWORDS]


def sql_keyword_scores(view: str, as_of: str, words: list[str], facets: dict[str, str]) -> str:
    """Oracle of the keyword scores; columns of the listing stay available."""
    text = f"(lower(title) || ' ' || {TEXT} || ' ' || lower(coalesce(company_name, '')) || ' ' || coalesce(lower(array_to_string(tech_stack, ' ')), ''))"
    hits = " + ".join(f"CASE WHEN contains(full_text, {lit(w)}) THEN 1 ELSE 0 END + CASE WHEN contains(lower(title), {lit(w)}) THEN 1 ELSE 0 END" for w in words)
    days = sql_days("posted_date", as_of)
    stars = sql_stars(f"TIMESTAMP '{as_of}'")["stars"]
    facet = " + ".join(f"CASE WHEN {f} = {lit(v)} THEN {fv.FACET_BONUS[f]} ELSE 0 END" for f, v in facets.items()) or "0"
    single = [w for w in dict.fromkeys(words) if " " not in w]
    tokens = "list_filter([" + ", ".join(f"CASE WHEN list_contains(regexp_split_to_array(full_text, '\\s+'), {lit(w)}) THEN {lit(w)} END" for w in single) + "], lambda x: x IS NOT NULL)"
    loose = "list_filter([" + ", ".join(f"CASE WHEN contains(full_text, {lit(w)}) THEN {lit(w)} END" for w in dict.fromkeys(words)) + "], lambda x: x IS NOT NULL)"
    return f"""t AS (SELECT *, {text} AS full_text FROM {view}),
      p AS (SELECT *, least(50, ({hits}) * {50 // max(len(words), 1)})::BIGINT AS keyword_score,
        (CASE WHEN posted_date IS NULL THEN 0 WHEN {days} <= 1 THEN 25 WHEN {days} <= 3 THEN 20 WHEN {days} <= 7 THEN 15 WHEN {days} <= 14 THEN 8 ELSE 2 END)::BIGINT AS recency_score,
        {stars} * 3 AS quality_score, ({facet})::BIGINT AS facet_score, coalesce({days}, 999) AS days_old, coalesce({days} <= 3, false) AS is_new,
        {tokens} AS tokens, {loose} AS loose FROM t),
      scored AS (SELECT *, least(100, keyword_score + recency_score + quality_score + facet_score) AS match_score,
        {case([(n, f"keyword_score + recency_score + quality_score + facet_score >= {low}") for n, low in fv.MATCH_TIERS], 'weak')} AS match_tier,
        array_to_string(list_sort(CASE WHEN len(tokens) > 0 THEN tokens ELSE loose END), '|') AS matched_keywords FROM p)"""


_SCORE_COLUMNS = "id, match_score, keyword_score, recency_score, quality_score, match_tier, matched_keywords, is_new, days_old"


def _score_columns(df):
    return df.select(
        "id", "match_score", "keyword_score", "recency_score", "quality_score", "match_tier", list_col("matched_keywords"), "is_new", "days_old"
    )


@query("keyword_scores", "R-2", f"WITH {sql_keyword_scores('listings', LISTINGS_AS_OF, _WORDS, FACETS)} SELECT {_SCORE_COLUMNS} FROM scored")
def keyword_scores(spark, sf):
    return _score_columns(R.keyword_scores(listings(spark, sf), KEYWORDS, FACETS, LISTINGS_AS_OF))


@query("keyword_scores_postings", "R-2", f"WITH {sql_keyword_scores('postings', POSTINGS_AS_OF, _WORDS, {})} SELECT {_SCORE_COLUMNS} FROM scored")
def keyword_scores_postings(spark, sf):
    return _score_columns(R.keyword_scores(postings(spark, sf), KEYWORDS, {}, POSTINGS_AS_OF))


_RANKED = f"""WITH c AS (SELECT * FROM postings WHERE is_active AND posted_date >= TIMESTAMP '{POSTINGS_AS_OF}' - INTERVAL 21 DAY),
  {sql_keyword_scores('c', POSTINGS_AS_OF, _WORDS, {})},
  ranked AS (SELECT * FROM scored WHERE match_score >= 15 ORDER BY match_score DESC, is_new DESC, days_old, id LIMIT 30)"""


@query("keyword_ranking", "R-3 F-15 G-5 W-4 P-15", f"{_RANKED} SELECT {_SCORE_COLUMNS} FROM ranked")
def keyword_ranking(spark, sf):
    df = postings(spark, sf)
    df = df.select("is_active", *[c for c in ranking_columns() if c in df.columns])
    return _score_columns(R.rank_by_keywords(df, KEYWORDS, POSTINGS_AS_OF))


@query(
    "keyword_ranking_newest", "G-7 R-3",
    _RANKED.replace("INTERVAL 21 DAY)", "INTERVAL 21 DAY ORDER BY posted_date DESC, id LIMIT 200)") + f" SELECT {_SCORE_COLUMNS} FROM ranked",
)
def keyword_ranking_newest(spark, sf):
    """Only the newest 200 candidates are scored."""
    return _score_columns(R.rank_by_keywords(postings(spark, sf), KEYWORDS, POSTINGS_AS_OF, newest_only=200))


@query("keyword_tier_counts", "A-6 R-3", f"{_RANKED} SELECT match_tier, count(*) AS n, count(*) FILTER (WHERE is_new) AS n_new FROM ranked GROUP BY 1")
def keyword_tier_counts(spark, sf):
    return stats.tier_counts(R.rank_by_keywords(postings(spark, sf), KEYWORDS, POSTINGS_AS_OF))


@query(
    "ui_tiers", "R-6",
    """SELECT doc_id, CASE WHEN quality = 1 THEN 'strong' WHEN doc_id % 101 >= 80 THEN 'perfect' WHEN doc_id % 101 >= 60 THEN 'strong'
       WHEN doc_id % 101 >= 40 THEN 'good' ELSE 'weak' END AS tier FROM labels""",
)
def ui_tiers(spark, sf):
    stored = F.when(F.col("quality") == 1, "strong").otherwise("")
    return table(spark, sf, "labels").select("doc_id", tier_or_stored(stored, F.col("doc_id") % 101).alias("tier"))


# ------------------------------------------------------------------ résumé ranking
PERSON = R.Candidate(
    skills=["docker", "machine learning", "pandas", "python", "r", "sql"], level="mid", domain="data",
    words=["python", "engineer", "data", "learning", "machine", "worked"], past_title_words=["engineer", "developer", "data"],
)
JUNIOR = R.Candidate(skills=["react", "css"], level="junior", domain="frontend", words=["frontend", "developer"], past_title_words=[])


def _sql_list(values: list[str]) -> str:
    return "CAST([" + ", ".join(lit(v) for v in values) + "] AS VARCHAR[])"


def sql_resume(view: str, as_of: str, p: R.Candidate, days: int, limit: int, hits: str = "[1:10]", misses: str = "[1:5]") -> str:
    skills = _sql_list(p.skills)
    allowed = ", ".join(lit(v) for v in fv.LEVELS_ALLOWED[p.level])
    level = "lower(trim(coalesce(experience_level, '')))"
    conditions = [f"{level} IN ({allowed}, '')"]
    if p.level in ("intern", "junior"):
        conditions += [f"NOT {any_of('lower(title)', fv.SENIOR_TITLE_TERMS)}", f"NOT {any_of(TEXT, fv.LONG_EXPERIENCE_TERMS)}"]
    if len(p.skills) >= 3:
        conditions.append(f"NOT {any_of('lower(title)', fv.RANK_NON_TECH)}")
    in_desc = "list_filter(" + skills + f", lambda s: contains({TEXT}, s))"
    tech = "list_distinct(list_transform(coalesce(tech_stack, CAST([] AS VARCHAR[])), lambda t: lower(t)))"
    words = "list_distinct(list_filter(regexp_split_to_array(lower(title), '\\s+'), lambda w: length(w) > 3))"
    bonus = case([(str(b), f"lv = {lit(j)}") for j, b in fv.LEVEL_BONUS[p.level].items()], "0")
    domain = sql_domain(f"(lower(title) || ' ' || {TEXT})", "tech")
    return f"""WITH f AS (SELECT *, {level} AS lv, {in_desc} AS in_desc, {tech} AS tech, {words} AS tw FROM {view}
        WHERE is_active AND posted_date >= TIMESTAMP '{as_of}' - INTERVAL {days} DAY AND {' AND '.join(conditions)}),
      g AS (SELECT *, CASE WHEN len(tech) > 0 THEN list_filter({skills}, lambda s: list_contains(tech, s)) ELSE in_desc END AS hit,
        CASE WHEN len(tech) > 0 THEN list_filter(tech, lambda t: NOT list_contains({skills}, t)) ELSE CAST([] AS VARCHAR[]) END AS miss,
        CAST({bonus} AS BIGINT) AS bonus, {domain} AS dom FROM f),
      h AS (SELECT *, CASE WHEN len(tech) > 0 THEN CAST(round_even(len(hit) / len(tech) * 40, 0) AS BIGINT) ELSE least(20, len(hit) * 4) END AS skill_score,
        least(10, len(list_intersect(tw, {_sql_list(p.past_title_words)})) * 5) + least(10, len(list_intersect(tw, {_sql_list(p.words)})) * 2) AS title_score,
        greatest(0, least(20, bonus + 10)) AS level_score,
        CAST(CASE WHEN dom = {lit(p.domain)} THEN 10 WHEN dom = 'general' OR {lit(p.domain)} = 'general' THEN 5 ELSE 0 END AS BIGINT) AS domain_score,
        least(10, len(in_desc) * 2) AS description_score FROM g),
      i AS (SELECT *, skill_score + title_score + level_score + domain_score + description_score AS match_score,
        array_to_string(list_filter([CASE WHEN len(hit) > 0 THEN len(hit) || ' matching skills' END, CASE WHEN bonus >= 10 THEN 'great level fit' END,
          CASE WHEN domain_score >= 8 THEN {lit(p.domain + ' domain')} END], lambda x: x IS NOT NULL), ' · ') AS why FROM h)
      SELECT id, match_score, skill_score, title_score, level_score, domain_score, description_score,
        {case([(n, f"match_score >= {low}") for n, low in fv.MATCH_TIERS], 'weak')} AS match_tier, CASE WHEN why = '' THEN 'some relevance found' ELSE why END AS match_reasoning,
        array_to_string(list_sort(hit){hits}, '|') AS matching_skills, array_to_string(list_sort(miss){misses}, '|') AS missing_skills,
        lv = {lit(p.level)} AS level_match FROM i ORDER BY match_score DESC, posted_date DESC, id LIMIT {limit}"""


def _resume_columns(df):
    scores = [f"{c}_score" for c in ("match", "skill", "title", "level", "domain", "description")]
    return df.select("id", *scores, "match_tier", "match_reasoning", list_col("matching_skills"), list_col("missing_skills"), "level_match")


#: Skills shown of each kind.
SHOWN = {"matched_limit": 10, "missing_limit": 5}


@query("resume_ranking", "R-4 R-5 F-14 J-7 J-8 X-19", sql_resume("postings", POSTINGS_AS_OF, PERSON, 30, 20))
def resume_ranking(spark, sf):
    return _resume_columns(R.rank_for_resume(postings(spark, sf), PERSON, POSTINGS_AS_OF, **SHOWN))


@query("resume_ranking_all", "R-4 F-14", sql_resume("listings", LISTINGS_AS_OF, PERSON, 3650, 1_000_000_000))
def resume_ranking_all(spark, sf):
    """Scores of every compatible listing, not only the best."""
    df = listings(spark, sf).where("is_active and posted_date is not null")
    return _resume_columns(R.resume_scores(R.compatible(df, PERSON), PERSON, **SHOWN))


@query("resume_ranking_junior", "R-4 R-5 F-14", sql_resume("listings", LISTINGS_AS_OF, JUNIOR, 3650, 20))
def resume_ranking_junior(spark, sf):
    return _resume_columns(R.rank_for_resume(listings(spark, sf), JUNIOR, LISTINGS_AS_OF, days=3650, **SHOWN))


@query("resume_ranking_whole", "R-4 X-19", sql_resume("postings", POSTINGS_AS_OF, PERSON, 3650, 1_000_000_000, "", ""))
def resume_ranking_whole(spark, sf):
    """Every compatible document with all its matching and missing skills, as without limits."""
    return _resume_columns(R.resume_scores(R.compatible(postings(spark, sf).where("is_active"), PERSON), PERSON))


@query(
    "resume_ranking_people", "J-8 R-5",
    f"SELECT 'a' AS candidate_id, id, match_score FROM ({sql_resume('listings', LISTINGS_AS_OF, PERSON, 3650, 20)}) UNION ALL"
    f" SELECT 'b', id, match_score FROM ({sql_resume('listings', LISTINGS_AS_OF, JUNIOR, 3650, 20)})",
)
def resume_ranking_people(spark, sf):
    rows = [(n, p.skills, p.level, p.domain, p.words, p.past_title_words) for n, p in (("a", PERSON), ("b", JUNIOR))]
    people = spark.createDataFrame(rows, "candidate_id string, skills array<string>, level string, domain string, words array<string>, past_title_words array<string>")
    return R.rank_for_resumes(listings(spark, sf), people, LISTINGS_AS_OF, days=3650).select("candidate_id", "id", "match_score")


# ------------------------------------------------------------------ vectors
_COS = "list_cosine_similarity(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))"


def _vector_sql(threshold: float, limit: int, exclude: bool) -> str:
    s = _COS.format(a="e.embedding", b="q.embedding")
    return f"""SELECT e.vec_id, round({s}, 6) AS similarity FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q
      WHERE {s} > {threshold} {'AND e.vec_id <> 0' if exclude else ''} ORDER BY {s} DESC, vec_id LIMIT {limit}"""


def _similarity(df):
    return df.select("vec_id", F.round("similarity", 6).alias("similarity"))


@query("vector_top", "V-1 V-3 J-9", _vector_sql(0.1, 10, False))
def vector_top(spark, sf):
    df = table(spark, sf, "embeddings")
    wanted = one_row(df.select("vec_id", "embedding"), F.col("vec_id") == 0)
    return _similarity(V.top_similar(df, list(wanted.embedding), 10, 0.1, key="vec_id"))


@query("vector_similar_to", "V-2 J-9", _vector_sql(0.05, 5, True))
def vector_similar_to(spark, sf):
    return _similarity(V.similar_to(table(spark, sf, "embeddings"), 0, 5, 0.05, key="vec_id"))


@query(
    "vector_top_many", "V-4 W-1",
    f"""SELECT query_id, vec_id, round(s, 6) AS similarity, rank FROM (SELECT q.vec_id AS query_id, e.vec_id, {_COS.format(a='e.embedding', b='q.embedding')} AS s,
        row_number() OVER (PARTITION BY q.vec_id ORDER BY s DESC, e.vec_id) AS rank FROM embeddings e JOIN embeddings q ON e.vec_id <> q.vec_id
        WHERE s > 0.2) WHERE rank <= 5""",
)
def vector_top_many(spark, sf):
    df = table(spark, sf, "embeddings")
    queries = df.select(F.col("vec_id").alias("query_id"), "embedding")
    out = V.top_similar_many(df, queries, 5, 0.2, key="vec_id")
    return out.select("query_id", "vec_id", F.round("similarity", 6).alias("similarity"), "rank")


#: Tables and bits of the approximate form: the test vectors' neighbours are some 60 degrees apart.
HASH_TABLES, HASH_BITS = 18, 4


def _hash_sql(width: int = 64) -> str:
    """Buckets of all vectors, from the same hyperplanes."""
    sides = [f"({t}, {b}, [{', '.join(str(int(x)) for x in plane)}])" for t, bits in enumerate(planes(width, HASH_TABLES, HASH_BITS)) for b, plane in enumerate(bits)]
    return f"""s AS (SELECT vec_id, tab, sum(CASE WHEN list_dot_product(CAST(embedding AS DOUBLE[]), CAST(plane AS DOUBLE[])) > 0 THEN 1 << bit ELSE 0 END) AS bucket
      FROM embeddings, (VALUES {', '.join(sides)}) p(tab, bit, plane) GROUP BY 1, 2)"""


@query(
    "vector_top_many_hashed", "V-4",
    f"""WITH {_hash_sql()}, c AS (SELECT DISTINCT a.vec_id AS query_id, b.vec_id FROM s a JOIN s b ON a.tab = b.tab AND a.bucket = b.bucket AND a.vec_id <> b.vec_id)
      SELECT query_id, vec_id, round(s, 6) AS similarity, rank FROM (SELECT c.query_id, c.vec_id, {_COS.format(a='e.embedding', b='q.embedding')} AS s,
        row_number() OVER (PARTITION BY c.query_id ORDER BY s DESC, c.vec_id) AS rank FROM c JOIN embeddings e USING (vec_id) JOIN embeddings q ON q.vec_id = c.query_id
        WHERE s > 0.2) WHERE rank <= 5""",
)
def vector_top_many_hashed(spark, sf):
    df = table(spark, sf, "embeddings")
    queries = df.select(F.col("vec_id").alias("query_id"), "embedding")
    out = top_similar_hashed(df, queries, 5, 0.2, key="vec_id", tables=HASH_TABLES, bits=HASH_BITS)
    return out.select("query_id", "vec_id", F.round("similarity", 6).alias("similarity"), "rank")


@query("vector_top_function", "V-1 J-9", _vector_sql(0.1, 10, True))
def vector_top_function(spark, sf):
    """The search called from SQL, its limit an argument like the others."""
    table(spark, sf, "embeddings").createOrReplaceTempView("embeddings")
    V.register_similar_rows(spark, "similar_rows", "embeddings", "vec_id", "embedding")
    return spark.sql(
        """SELECT vec_id, round(similarity, 6) AS similarity
           FROM similar_rows((SELECT embedding FROM embeddings WHERE vec_id = 0), 0.1D, (SELECT CAST(count(*) AS INT) FROM embeddings WHERE vec_id < 10), 0)"""
    )


# ------------------------------------------------------------------ alerts
# Stored alerts: one per customer, with filters that follow from the row.
_ALERT_SPARK = {
    "q": "element_at(array('engineer', '', 'Data', null, 'zebra'), cast(c_custkey % 5 as int) + 1)",
    "location": "element_at(array('india', null, 'uk', ''), cast(c_custkey % 4 as int) + 1)",
    "remote_type": "element_at(array('remote', null, 'hybrid', 'onsite', ''), cast(c_nationkey % 5 as int) + 1)",
    "experience_level": "element_at(array('junior', null, 'senior'), cast(c_nationkey % 3 as int) + 1)",
    "company_type": "CASE WHEN c_mktsegment = 'BUILDING' THEN 'startup' END",
    "salary_min": "CASE WHEN c_mktsegment = 'MACHINERY' THEN 50000.0D ELSE 0.0D END",
    "posted_within": "CASE WHEN c_acctbal < 0 THEN 'month' END",
    "tech_stack": "CASE WHEN c_nationkey % 7 = 0 THEN array('Python') END",
    "source": "CASE WHEN c_nationkey % 6 = 0 THEN 'Adzuna' END",
}
_ALERT_DUCK = {
    k: v.replace("element_at(array(", "(([").replace("), cast(", "]))[(").replace(" as int) + 1)", ") + 1]").replace("0D", "0").replace("array('Python')", "['Python']")
    for k, v in _ALERT_SPARK.items()
}


def _unset(name: str) -> str:
    return f"coalesce(CAST(a.{name} AS VARCHAR), '') = ''"


_ALERTS_SQL = f"a AS (SELECT c_custkey AS alert_id, c_nationkey AS user_id, {', '.join(f'{e} AS {n}' for n, e in _ALERT_DUCK.items())}, ['realtime', 'daily', 'weekly', NULL][c_custkey % 4 + 1] AS frequency FROM customer WHERE c_acctbal < 1500)"
#: Whether a listing ``l`` fits an alert ``a``.
_ALERT_ON = f"""({_unset('remote_type')} OR l.remote_type = a.remote_type) AND ({_unset('experience_level')} OR l.experience_level = a.experience_level)
   AND ({_unset('company_type')} OR l.company_type = a.company_type) AND (a.salary_min = 0 OR l.salary_min >= a.salary_min)
   AND ({_unset('q')} OR contains(lower(l.title), lower(a.q)) OR contains(lower(l.company_name), lower(a.q)) OR contains(lower(l.description), lower(a.q)))
   AND ({_unset('location')} OR contains(lower(l.location_city), a.location) OR contains(lower(l.location_country), a.location)
     OR l.location_country = CASE a.location WHEN 'india' THEN 'IN' WHEN 'uk' THEN 'GB' END)
   AND (a.tech_stack IS NULL OR list_has_all(l.tech_stack, a.tech_stack)) AND ({_unset('source')} OR list_contains(l.source_platforms, a.source))
   AND ({_unset('posted_within')} OR l.posted_date >= {{as_of}} - INTERVAL 30 DAY)"""
_ALERT_SQL = f"""WITH {_ALERTS_SQL},
  l AS (SELECT * FROM listings WHERE is_active AND posted_date >= {AS_OF} - INTERVAL 45 DAY)
  SELECT alert_id, a.user_id::BIGINT AS user_id, l.id FROM a JOIN l ON {_ALERT_ON.format(as_of=AS_OF)}"""


def _alerts(spark, sf):
    from listflow.schemas import ALERT_FILTERS

    fields = ", ".join(
        f"'{f.name}', {_ALERT_SPARK.get(f.name, f'cast(null as {f.dataType.simpleString()})')}" for f in ALERT_FILTERS
    )
    return table(spark, sf, "customer").selectExpr(
        "c_custkey AS id", "c_nationkey AS user_id", "c_acctbal < 1500 AS is_active", f"named_struct({fields}) AS filters"
    )


@query("alert_matches", "T-8 F-1 F-2 F-5 F-6 F-7", _ALERT_SQL)
def alert_matches(spark, sf):
    fresh = listings(spark, sf).where("is_active").where(F.col("posted_date") >= F.lit(LISTINGS_AS_OF).cast("timestamp") - F.expr("interval 45 days"))
    return alerts.match_alerts(fresh, _alerts(spark, sf), LISTINGS_AS_OF)


@query("alert_matches_large", "T-8", _ALERT_SQL)
def alert_matches_large(spark, sf):
    """The plan for more filters than fit a broadcast: shuffled joins and blocks."""
    fresh = listings(spark, sf).where("is_active").where(F.col("posted_date") >= F.lit(LISTINGS_AS_OF).cast("timestamp") - F.expr("interval 45 days"))
    return alerts.match_alerts(fresh, _alerts(spark, sf), LISTINGS_AS_OF, max_broadcast=50)

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from listflow.operators import alerts, dedup, lifecycle, matching, ranking, search, similarity, stats
from listflow.operators.accounts import cascade, fill_from_profile, with_default_resume
from listflow.schemas import ALERT_FILTERS, LISTINGS, align_to_schema

AS_OF = "2024-03-01 00:00:00"


# ------------------------------------------------------------------ matching
@pytest.mark.parametrize("bound", [0, 1000])
def test_substring_matches_equal_brute_force(spark, bound):
    rng = random.Random(3)
    letters = "abAB é"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(0, 14))) for _ in range(60)] + ["", None, "ab"]
    terms = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 7))) for _ in range(40)] + ["", None]
    t = spark.createDataFrame([(x,) for x in texts], "text string")
    p = spark.createDataFrame([(x,) for x in terms], "term string")
    got = {(r.text, r.term) for r in matching.substring_matches(t, "text", p, "term", bound).collect()}
    want = {(x, y) for x in texts if x is not None for y in terms if y and y.lower() in x.lower()}
    assert got == want


def test_newest_per_match_is_exact_with_a_hot_text(spark):
    rng = random.Random(4)
    rows = [(i, "Acme India" if rng.random() < 0.5 else rng.choice(["Acme", "Zed", "India Zed"]), rng.randrange(30)) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, name string, day int")
    terms = spark.createDataFrame([("acme",), ("india",), ("zed",)], "term string")
    got = matching.newest_per_match(df, "name", terms, "term", [F.desc("day"), F.asc("id")], limit=7)
    got = {(r.term, r.rank): r.id for r in got.collect()}
    for term in ("acme", "india", "zed"):
        best = sorted((r for r in rows if term in r[1].lower()), key=lambda r: (-r[2], r[0]))[:7]
        assert [got[(term, i + 1)] for i in range(7)] == [r[0] for r in best]


def test_one_row(spark):
    df = spark.range(3)
    assert matching.one_row(df, F.col("id") == 1).id == 1
    for condition in (F.col("id") > 5, F.col("id") < 2):
        with pytest.raises(LookupError):
            matching.one_row(df, condition)


def test_first_per_key_follows_arrival_order(spark):
    rows = [("a", 2, "late"), ("a", 1, "early"), ("b", 3, "only")]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "k string, seq int, v string")
        got = {r.k: r.v for r in dedup.first_per_key(df, ["k"], [F.asc("seq")]).collect()}
        assert got == {"a": "early", "b": "only"}


def test_large_top_k_equals_the_small_plan(spark):
    df = spark.range(3000).select("id", (F.col("id") % 3 == 0).cast("string").alias("k"))
    want = {r.id for r in matching.top_per_group(df, ["k"], [F.desc("id")], 900).collect()}
    spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", "100")
    try:
        got = matching.top_per_group(df, ["k"], [F.desc("id")], 900, rank="n")
        assert {r.id for r in got.collect()} == want
        assert "_salt" not in got.columns and got.where("n = 1").count() == 2
    finally:
        spark.conf.unset("spark.sql.optimizer.windowGroupLimitThreshold")


def test_key_summary_with_more_columns(spark):
    rows = [("a", 2, "x", "s1"), ("a", 1, "y", "s2"), ("a", 3, "z", "s1"), ("b", 4, "w", "s1")]
    df = spark.createDataFrame(rows, "k string, seq int, v string, src string")
    got = {r.k: (r.seq, r.v, r.n_rows, r.n_sources, r.n_duplicates) for r in dedup.with_key_summary(df, ["k"], ["seq"], "src").collect()}
    assert got == {"a": (1, "y", 3, 2, 2), "b": (4, "w", 1, 1, 0)}
    short = dedup.with_key_summary(df.drop("v"), ["k"], ["seq"], "src")
    assert {(r.k, r.seq, r.n_rows, r.n_sources) for r in short.collect()} == {("a", 1, 3, 2), ("b", 4, 1, 1)}


# ------------------------------------------------------------------ search
def listings(spark, rows):
    return spark.createDataFrame(
        rows, "id int, title string, company_name string, description string, location_city string, location_country string,"
        " is_active boolean, is_featured boolean, posted_date string, created_at string, salary_min double, tech_stack array<string>"
    ).withColumns({c: F.col(c).cast("timestamp") for c in ("posted_date", "created_at")})


def row(i, **kw):
    base = dict(
        title="Dev", company_name="Acme", description="d", city="Pune", country="IN", active=True, featured=False, posted="2024-02-20 00:00:00",
        created=f"2024-02-20 00:00:{i % 60:02d}", pay=None, tags=None,
    )
    base.update(kw)
    return (
        i, base["title"], base["company_name"], base["description"], base["city"], base["country"], base["active"], base["featured"],
        base["posted"], base["created"], base["pay"], base["tags"],
    )


def ids(df):
    return [r.id for r in df.collect()]


def test_keyword_takes_signs_literally(spark):
    df = listings(spark, [row(1, title="100% remote"), row(2, title="100 remote"), row(3, title="a_b"), row(4, title="axb")])
    assert ids(df.where(search.keyword("100%"))) == [1]
    assert ids(df.where(search.keyword("A_B"))) == [3]


def test_tags_and_nulls(spark):
    df = listings(spark, [row(1, tags=["Go", "SQL"]), row(2, tags=["go"]), row(3), row(4, tags=[])])
    assert ids(df.where(search.has_all_tags("Go, SQL"))) == [1]
    assert ids(df.where(search.has_all_tags([]))) == [1, 2, 4]


def test_cutoff_is_inclusive_and_null_dates_drop(spark):
    rows = [row(1, posted=None), row(2, posted="2024-01-16 00:00:00"), row(3, posted="2024-01-15 23:59:59.999999"), row(4, active=False)]
    df = listings(spark, rows)
    assert ids(df.where(search.unexpired(AS_OF))) == [2]
    after = {r.id: r.is_active for r in lifecycle.expire(df.withColumn("updated_at", F.col("created_at")), AS_OF).collect()}
    assert after == {1: True, 2: True, 3: False, 4: False}


def test_featured_nulls_are_in_no_tier(spark):
    df = listings(spark, [row(1, featured=None), row(2, featured=True), row(3)])
    page = search.search_page(df, search.SearchParams(), AS_OF)
    assert [(r.id, r.tier) for r in page.collect()] == [(2, 0), (3, 1)]
    assert tuple(search.search_totals(df, search.SearchParams(), AS_OF).first()) == (2, 1)


def test_featured_tier_ignores_some_filters(spark):
    df = listings(spark, [row(1, featured=True, pay=1.0), row(2, pay=1.0), row(3, pay=9.0)])
    params = search.SearchParams(salary_min=5.0)
    assert ids(search.search_page(df, params, AS_OF)) == [1, 3]
    assert ids(search.search_page(df, params, AS_OF, all_filters=True)) == [3]


def test_pages_cover_every_row_once(spark):
    df = listings(spark, [row(i, created=None if i % 7 == 0 else f"2024-02-20 00:00:{i % 5:02d}") for i in range(43)])
    order = search.sort_keys("created_at")
    everything = ids(df.orderBy(*order))
    assert sum((ids(search.page_of(df, order, p, 10)) for p in range(1, 7)), []) == everything
    seen, cursor = [], None
    while True:
        rows = search.page_after(df, 10, cursor).collect()
        if not rows:
            break
        seen += [r.id for r in rows]
        cursor = (str(rows[-1].created_at) if rows[-1].created_at else None, rows[-1].id)
    assert seen == everything


def test_search_params_drop_empty():
    params = search.SearchParams.from_dict({"q": "", "remote_type": "remote", "visa_sponsorship": False, "page": 3, "source": None})
    assert params.supplied() == {"remote_type", "visa_sponsorship"}


def test_breakdown_shows_zero_rows(spark):
    df = spark.createDataFrame([("a",), ("a",), (None,)], "x string")
    assert {(r.value, r.n) for r in stats.breakdown(df, {"x": ["a", "b"]}).collect()} == {("a", 2), ("b", 0)}


# ------------------------------------------------------------------ ranking
def test_keyword_scores_edges(spark):
    df = listings(
        spark, [row(1, title="Python Dev", description="python python"), row(2, title="x", description="c pythonic", posted=None), row(3, title="none")]
    ).withColumns({c: F.lit(None).cast("string") for c in ("apply_url", "company_type", "experience_level", "remote_type", "job_type")})
    df = df.withColumns({"salary_max": F.lit(0.0), "visa_sponsorship": F.lit(False), "source_platforms": F.array(F.lit("s"))})
    got = {r.id: r for r in ranking.keyword_scores(df, ["Python", " python ", "  "], {}, AS_OF).collect()}
    assert got[1].keyword_score == 50 and got[1].matched_keywords == ["python"]
    assert got[2].keyword_score == 50 and got[2].matched_keywords == ["python"]
    assert got[2].recency_score == 0 and got[2].days_old == 999 and not got[2].is_new
    assert got[3].keyword_score == 0 and got[3].matched_keywords == []
    many = ranking.keyword_scores(df, [f"k{i}" for i in range(59)] + ["python"], {}, AS_OF)
    assert {r.keyword_score for r in many.collect()} == {0}


def test_candidate_features(spark):
    df = spark.createDataFrame(
        [("Senior engineer. Docker, Kubernetes and terraform.", ["Python "], None, 3.0, [("Acme", "Platform Engineer", "2y")])],
        "resume_text string, skills array<string>, experience_level string, experience_years double,"
        " work_history array<struct<company:string,title:string,duration:string>>",
    )
    person = ranking.candidate_of(df)
    assert person.level == "senior" and person.domain == "devops"
    assert {"python", "docker", "kubernetes", "terraform"} <= set(person.skills)
    assert set(person.past_title_words) == {"platform", "engineer"}


# ------------------------------------------------------------------ vectors
def test_vector_search_equals_numpy(spark):
    rng = np.random.default_rng(1)
    m = rng.normal(size=(60, 8)).astype(np.float32)
    m[7] = 0
    m[9] = m[3]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(m)] + [(99, None)]
    df = spark.createDataFrame(rows, "id int, embedding array<float>").repartition(3)
    unit = m.astype(np.float64)
    with np.errstate(invalid="ignore"):
        unit = unit / np.linalg.norm(unit, axis=1, keepdims=True)
    sims = unit @ unit.T

    def best(q, k, low):
        ok = [i for i in range(60) if i != q and sims[q, i] > low]
        return sorted(ok, key=lambda i: (-round(sims[q, i], 9), i))[:k]

    assert ids(similarity.similar_to(df, 3, 5, 0.1)) == best(3, 5, 0.1)
    assert ids(similarity.similar_to(df, 7, 5, 0.1)) == []
    assert ids(similarity.similar_to(df, 99, 5, 0.1)) == []
    queries = df.select(F.col("id").alias("query_id"), "embedding")
    for block in (1000, 7):
        got = similarity.top_similar_many(df, queries, 4, 0.2, block_rows=block).collect()
        found = {}
        for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
            found.setdefault(r.query_id, []).append(r.id)
        assert found == {q: b for q in range(60) if (b := best(q, 4, 0.2))}


# ------------------------------------------------------------------ alerts and accounts
def test_alert_match_equals_brute_force(spark):
    rng = random.Random(8)
    pick = rng.choice
    names = [f.name for f in ALERT_FILTERS]
    rows = [
        (i, pick(["Data Engineer", "Chef"]), "Acme", pick([None, "python"]), "Pune", pick(["IN", "US", None]), pick(["remote", None]), pick(["mid", "senior"]),
         "full-time", "startup", "YC", True, pick([True, None]), pick([None, 10.0, 99.0]), 50.0, pick([["Go"], None, ["Go", "SQL"]]), ["S1"])
        for i in range(40)
    ]
    cols = "id int, title string, company_name string, description string, location_city string, location_country string, remote_type string, experience_level string, job_type string, company_type string, vc_backer string, visa_sponsorship boolean, relocation_support boolean, salary_min double, salary_max double, tech_stack array<string>, source_platforms array<string>"
    df = spark.createDataFrame(rows, cols).withColumn("posted_date", F.lit("2024-02-28").cast("timestamp"))
    filters = []
    for _ in range(30):
        f = dict.fromkeys(names)
        f.update(q=pick([None, "", "data", "PYTHON"]), location=pick([None, "india", "pune", "usa"]), remote_type=pick([None, "remote", ""]),
                 experience_level=pick([None, "mid"]), salary_min=pick([None, 0.0, 50.0]), tech_stack=pick([None, [], ["Go"], ["SQL", "Go"]]),
                 relocation_support=pick([None, True]), source=pick([None, "S1", "S2"]))
        filters.append(f)
    stored = spark.createDataFrame(
        [(i, i % 3, i % 10 != 9, tuple(f[n] for n in names)) for i, f in enumerate(filters)],
        f"id int, user_id int, is_active boolean, filters {ALERT_FILTERS.simpleString()}",
    )
    alias = {"india": "IN", "usa": "US"}

    def fits(f, r):
        title, company, text, city, country = (str(x or "").lower() for x in r[1:6])
        q, place = (f["q"] or "").lower(), (f["location"] or "").lower()
        return (
            (not q or q in title or q in company or q in text)
            and (not place or place in city or place in country or (alias.get(place) is not None and r[5] == alias[place]))
            and (not f["remote_type"] or r[6] == f["remote_type"]) and (not f["experience_level"] or r[7] == f["experience_level"])
            and (f["relocation_support"] is None or r[12] == f["relocation_support"])
            and (not f["salary_min"] or (r[13] is not None and r[13] >= f["salary_min"]))
            and (not f["tech_stack"] or (r[15] is not None and set(f["tech_stack"]) <= set(r[15])))
            and (not f["source"] or f["source"] in r[16])
        )

    want = {(i, r[0]) for i, f in enumerate(filters) if i % 10 != 9 for r in rows if fits(f, r)}
    for bound in (1000, 3):
        got = alerts.match_alerts(df, stored, AS_OF, max_broadcast=bound)
        assert {(r.alert_id, r.id) for r in got.collect()} == want
        assert got.count() == len(want)


def test_alert_pairs_are_dealt_out(spark, monkeypatch):
    """One partition of listings and many alerts of few filters: the pairs come from as many tasks as they need."""
    monkeypatch.setattr(alerts, "TASK_PAIRS", 500)
    cols = "id int, title string, company_name string, description string, location_city string, location_country string, remote_type string, experience_level string, job_type string, company_type string, vc_backer string, visa_sponsorship boolean, relocation_support boolean, salary_min double, salary_max double, tech_stack array<string>, source_platforms array<string>, posted_date timestamp"
    df = spark.createDataFrame([(i, "Data Engineer" if i % 2 else "Chef", *[None] * 16) for i in range(100)], cols).coalesce(1)
    names = [f.name for f in ALERT_FILTERS]
    filters = [tuple({"q": q}.get(n) for n in names) for q in ("data", "chef", None)]
    stored = spark.createDataFrame([(i, i % 7, True, filters[i % 3]) for i in range(90)], f"id int, user_id int, is_active boolean, filters {ALERT_FILTERS.simpleString()}")
    for bound in (2_000_000, 5):
        monkeypatch.setattr(alerts, "MAX_BROADCAST_ALERTS", bound)
        got = alerts.match_alerts(df, stored, AS_OF)
        want = {(a, a % 7, i) for a in range(90) for i in range(100) if a % 3 == 2 or (a % 3 == 0) == bool(i % 2)}
        rows = got.withColumn("task", F.spark_partition_id()).collect()
        assert {(r.alert_id, r.user_id, r.id) for r in rows} == want and len(rows) == len(want) == 6_000
        assert bound < 100 or len({r.task for r in rows}) > 6


def test_alert_pairs_come_in_runs(spark):
    """Where alerts share a filter, one stands in a run over a block of listings; repeated and null keys keep their rows."""
    from collections import Counter

    cols = "id int, title string, company_name string, description string, location_city string, location_country string, remote_type string, experience_level string, job_type string, company_type string, vc_backer string, visa_sponsorship boolean, relocation_support boolean, salary_min double, salary_max double, tech_stack array<string>, source_platforms array<string>, posted_date timestamp"
    ids = [*range(600), 7, 7, None, None]
    df = spark.createDataFrame([(i, "Data Engineer" if (i or 0) % 3 else "Chef", *[None] * 16) for i in ids], cols)
    names = [f.name for f in ALERT_FILTERS]
    filters = [tuple({"q": q}.get(n) for n in names) for q in ("data", None)]
    stored = spark.createDataFrame([(a, a % 7, a != 5, filters[a % 2]) for a in range(40)] + [(3, 9, True, filters[0])], f"id int, user_id int, is_active boolean, filters {ALERT_FILTERS.simpleString()}")
    want = Counter((a, u, i) for a, u, q in [(a, a % 7, a % 2 == 0) for a in range(40) if a != 5] + [(3, 9, True)] for i in ids if not q or (i or 0) % 3)
    rows = alerts.match_alerts(df, stored, AS_OF).collect()
    assert Counter((r.alert_id, r.user_id, r.id) for r in rows) == want
    assert 50 * sum(a.alert_id != b.alert_id for a, b in zip(rows, rows[1:])) < len(rows)


def test_accounts(spark):
    users = spark.createDataFrame([(1,), (2,)], "user_id int")
    resumes = spark.createDataFrame(
        [(1, 1, "u1", "a.pdf", True, 5), (2, 1, "u2", "b.pdf", False, 9)],
        "id int, user_id int, file_url string, file_name string, is_default boolean, uploaded_at int",
    )
    assert {(r.user_id, r.resume_url) for r in with_default_resume(users, resumes).collect()} == {(1, "u1"), (2, None)}
    forms = spark.createDataFrame([(1, " ", "x"), (3, None, "")], "user_id int, phone string, city string")
    profiles = spark.createDataFrame([(1, "555", "Pune")], "user_id int, tel string, town string")
    got = fill_from_profile(forms, profiles, "user_id", {"phone": "tel", "city": "town"})
    assert {tuple(r) for r in got.collect()} == {(1, "555", "x"), (3, "", "")}
    assert cascade(resumes, users.where("user_id = 2"), "user_id", "user_id").count() == 0


def test_align_to_schema(spark):
    out = align_to_schema(spark.createDataFrame([("t", 5, "x")], "title string, salary_min int, other string"), LISTINGS)
    assert out.schema == LISTINGS.__class__([f for f in LISTINGS]) or [f.name for f in out.schema] == [f.name for f in LISTINGS]
    assert out.first().salary_min == 5 and "other" not in out.columns


def test_candidates_of_a_table_rank_as_each_alone(spark):
    from listflow.suite.people import JUNIOR, PERSON
    from listflow.suite.views import LISTINGS_AS_OF, listings

    df = listings(spark, "/root/testdata/sf0.001")
    rows = [(f"{n}{i}", p.skills, p.level, p.domain, p.words, p.past_title_words) for i in range(3) for n, p in (("a", PERSON), ("b", JUNIOR))]
    people = spark.createDataFrame(rows, "candidate_id string, skills array<string>, level string, domain string, words array<string>, past_title_words array<string>")
    for block in (64, 2):
        many = ranking.rank_for_resumes(df, people, LISTINGS_AS_OF, days=3650, limit=7, block=block)
        # one scan of the listings, however many the candidates
        assert many._jdf.queryExecution().executedPlan().toString().count("FileScan parquet") == 1
        got = {}
        for r in many.collect():
            got.setdefault(r.candidate_id, []).append((-r.match_score, r.id, r.match_reasoning))
        for n, p in (("a", PERSON), ("b", JUNIOR)):
            alone = sorted((-r.match_score, r.id, r.match_reasoning) for r in ranking.rank_for_resume(df, p, LISTINGS_AS_OF, days=3650, limit=7).collect())
            assert all(sorted(got[f"{n}{i}"]) == alone for i in range(3))
    assert ranking.rank_for_resumes(df, people.limit(0), LISTINGS_AS_OF).count() == 0


def test_company_pages(spark):
    companies = spark.createDataFrame([(1, "acme", "Acme"), (2, "none", "Nobody"), (3, "twice", "A"), (4, "twice", "B")], "id long, slug string, name string")
    jobs = spark.createDataFrame([(i, "ACME Labs" if i % 2 else "Other", i != 5, f"2024-01-0{i}") for i in range(1, 8)], "id long, company_name string, is_active boolean, d string").withColumn("posted_date", F.to_timestamp("d"))
    got = search.company_profile(companies, jobs, "acme", limit=2).collect()
    assert sorted((r.id, r.job_count) for r in got) == [(3, 2), (7, 2)]
    assert [(r.id, r.job_count) for r in search.company_profile(companies, jobs, "none").collect()] == [(None, 0)]
    for slug in ("missing", "twice"):
        with pytest.raises(LookupError):
            search.company_profile(companies, jobs, slug)
    assert [r.id for r in search.list_companies(companies, page=2, per_page=3).collect()] == [4]
    assert search.company_total(companies, "a").first().total == 2


@pytest.mark.parametrize("descending", [True, False])
def test_pages_by_index_equal_offset_pages(spark, tmp_path, descending):
    rows = [(i, None if i % 13 == 0 else float(i * 7919 % 101)) for i in range(1200)]
    df = spark.createDataFrame(rows, "id int, v double").repartition(5)
    order, path = search.sort_keys("v", descending), str(tmp_path / "pages")
    search.build_page_index(df, path, order, 12)
    for page, per_page in ((1, 10), (7, 10), (120, 10), (121, 10), (10_000, 1), (1, 5000), (3, 333), (900, 1)):
        want = [tuple(r) for r in search.page_of(df, order, page, per_page).collect()]
        got = search.page_from_index(spark, path, order, page, per_page, df.schema)
        assert [tuple(r) for r in got.collect()] == want
    far = search.page_from_index(spark, path, order, 900, 1, df.schema)
    assert len(far.inputFiles()) > 5 and "PartitionFilters: [(page_range" in (text := far._jdf.queryExecution().executedPlan().toString()) or "PartitionFilters: [isnotnull(page_range" in text
    assert far.select(F.input_file_name()).distinct().count() == 1


def test_pages_beyond_a_limit_hold_the_other_featured_rows(spark):
    from listflow.suite.views import listings as order_listings

    df = order_listings(spark, "/root/testdata/sf0.001")
    params, seen = search.SearchParams(), []
    totals = search.search_totals(df, params, "2001-08-02 00:00:00", per_page=20).first()
    for page in range(1, totals.total_pages + 1):
        seen += [(r.tier, r.id) for r in search.search_page(df, params, "2001-08-02 00:00:00", page=page, featured_limit=7).collect()]
    assert len(seen) == len(set(seen)) == totals.total
    whole = [r.id for r in search.search_page(df, params, "2001-08-02 00:00:00").where("tier = 0").collect()]
    assert whole == [i for t, i in seen if t == 0]

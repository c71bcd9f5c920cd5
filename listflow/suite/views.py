"""Listing-shaped views over the driver tables, for Spark and for the SQL oracle.

The tables hold no job listings, so two views give their rows the listing
columns: ``listings`` has one row per order, ``postings`` one per document with
its whole text. Every value follows from the row's own key and columns, so both
views grow with their table. The oracle builds the same views in its own SQL.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

LISTINGS_AS_OF = "2001-08-02 00:00:00"
POSTINGS_AS_OF = "2024-03-01 00:00:00"
EVENTS_AS_OF = "2024-01-31 00:00:00"

LEVEL_WORDS = ["Senior ", "Junior ", "Lead ", "Staff ", "Principal ", "Intern ", "Sr. ", "Head of ", "", "Associate ", "test "]
ROLES = [
    "Software Engineer", "Data Engineer", "Product Manager", "Frontend Developer", "DevOps Engineer",
    "Sales Engineer", "Machine Learning Engineer", "Internal Tools Developer", "Security Analyst", "Job",
    "iOS Developer", "Python Developer", "Web3 Engineer",
]
SUFFIXES = ["", " - UK", " (Germany)", "", " (Remote)", ", London", ""]
COMPANIES = [
    "Google India", "Stripe Inc", "Stealth Startup", "Acme Corp", "Infosys Limited", "", "Vercel",
    "Databricks", "Confidential Company", "Swiggy", "Tata Elxsi", "LTIMindtree", "Grafana Labs", "X",
    "Indian Startup", "Nubank SA", "Accenture",
]
CITIES = ["Bangalore", "Mumbai", "London", "Berlin", "", "New York", None, "Pune", "Toronto"]
COUNTRIES = ["India", "IN", "GB", "Germany", "", "US", None, "india", "Canada"]
REMOTE = ["remote", "hybrid", "onsite", None, "Remote "]
LEVELS = ["junior", "mid", "senior", "staff", "lead", "", None, "intern"]
TYPES = ["full-time", "contract", "part_time", "", None, "internship", "Full Time"]
KINDS = ["startup", "vc_backed", "big_tech", "stealth", "", None]
BACKERS = ["YC", "a16z", None, "", "Sequoia"]
CURRENCIES = ["USD", "INR", "INR", "USD", "EUR", "INR", None, "USD", "GBP", "INR"]
TAGS = ["Python", "React", "SQL", "Docker", "AWS", "Java", "go", " Rust ", "Spark", "kubernetes", "C", "NLP"]
URLS = [
    "https://boards.greenhouse.io/acme/jobs/", "https://jobs.lever.co/acme/", "https://www.adzuna.com/land/",
    "https://acme.wd5.myworkdayjobs.com/", "https://careers.acme.com/", "ftp://files/",
    "https://acme.recruiterbox.com/", "https://in.linkedin.com/jobs/", "https://acme.bamboohr.com/careers/",
    "https://apply.workable.com/acme/j/", "https://example.org/", "", "https://jobs.ashbyhq.com/acme/",
    "https://JOBS.LEVER.CO/acme/", "https://acme.breezy.hr/p/", "https://acme.recruitee.com/o/",
    "https://jobs.smartrecruiters.com/Acme/", "https://zoho.com/x/recruit/", "https://clever.com/",
]
TEXTS = [
    "We offer visa sponsorship and a relocation package. Join us.", "Series A startup. Pays $100k - $200k. Apply now",
    "Python and SQL with Docker! 5+ years needed.", "Remote, work from home. <b>Great</b> team. Machine learning with pandas",
    "Hybrid role on a contract basis", "Salary € 50 per hour. Part time", "", None,
    "Pays €\u00a050 an hour", "A plain text that goes on for a while. " * 15 + "It pays £ 40 and offers visa sponsorship",
]


def lit(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


class Dialect:
    """The few places where the two SQL dialects differ."""

    def __init__(self, spark: bool):
        self.spark = spark

    def pick(self, words: list[str | None], key: str) -> str:
        items = ", ".join(lit(w) for w in words)
        if self.spark:
            return f"element_at(array({items}), cast(({key}) % {len(words)} as int) + 1)"
        return f"([{items}])[(({key}) % {len(words)}) + 1]"

    def div(self, a: str, b: int) -> str:
        return f"({a} div {b})" if self.spark else f"({a} // {b})"

    def array(self, *items: str) -> str:
        inner = ", ".join(items)
        if not items:
            return "cast(array() as array<string>)" if self.spark else "CAST([] AS VARCHAR[])"
        return f"array({inner})" if self.spark else f"[{inner}]"

    def plus_minutes(self, ts: str, n: str) -> str:
        if self.spark:
            return f"{ts} + make_dt_interval(0, 0, cast({n} as int), 0)"
        return f"{ts} + to_minutes(CAST({n} AS BIGINT))"

    def ts(self, expr: str) -> str:
        return f"cast({expr} as timestamp)"


def _common(d: Dialect, k: str, c: str) -> dict[str, str]:
    tag = lambda e: d.pick(TAGS, e)
    return {
        "title": f"concat({d.pick(LEVEL_WORDS, k)}, {d.pick(ROLES, k)}, {d.pick(SUFFIXES, k)})",
        "company_name": d.pick(COMPANIES, c),
        "location_city": d.pick(CITIES, k),
        "location_country": d.pick(COUNTRIES, k),
        "remote_type": d.pick(REMOTE, k),
        "experience_level": d.pick(LEVELS, k),
        "job_type": d.pick(TYPES, k),
        "company_type": d.pick(KINDS, c),
        "vc_backer": d.pick(BACKERS, c),
        "visa_sponsorship": f"case {k} % 3 when 0 then true when 1 then false end",
        "relocation_support": f"case {c} % 3 when 0 then true when 1 then false end",
        "salary_currency": d.pick(CURRENCIES, k),
        "tech_stack": (
            f"case when {k} % 5 = 0 then null when {k} % 5 = 1 then {d.array()}"
            f" else {d.array(tag(k), tag(d.div(k, 7)), tag(d.div(k, 5)))} end"
        ),
        "apply_url": f"case when {k} % 19 = 11 then '' else concat({d.pick(URLS, k)}, cast({k} as string)) end"
        if d.spark
        else f"case when {k} % 19 = 11 then '' else concat({d.pick(URLS, k)}, CAST({k} AS VARCHAR)) end",
        "is_stealth": f"{c} % 17 = 2",
    }


def listings_columns(d: Dialect) -> dict[str, str]:
    k, c = "o_orderkey", "o_custkey"
    return {
        "id": k,
        "user_id": c,
        **_common(d, k, c),
        "description": f"{d.pick(TEXTS, k)} || ' ' || o_orderpriority",
        "salary_min": f"case when {k} % 4 = 0 then null when {k} % 4 = 1 then cast(0 as double) else cast(floor(o_totalprice / 3) as double) end",
        "salary_max": f"case when {k} % 6 = 0 then null else cast(floor(o_totalprice / 2) as double) end",
        "source_platforms": (
            f"case {k} % 3 when 0 then {d.array(lit('JSearch'), lit('Adzuna'))}"
            f" when 1 then {d.array(lit('Adzuna'))} else {d.array(lit('LinkedIn'))} end"
        ),
        "posted_date": f"case when {k} % 50 = 0 then null else {d.ts('o_orderdate')} end",
        "created_at": d.plus_minutes(d.ts("o_orderdate"), f"{k} % 1440"),
        "updated_at": d.ts("o_orderdate"),
        "is_active": "o_orderstatus <> 'F'",
        "is_featured": "case o_orderpriority when '1-URGENT' then true when '5-LOW' then null else false end",
    }


def postings_columns(d: Dialect) -> dict[str, str]:
    k = "doc_id"
    day = f"({k} % 60)"
    as_of = f"timestamp '{POSTINGS_AS_OF}'" if d.spark else f"TIMESTAMP '{POSTINGS_AS_OF}'"
    posted = d.plus_minutes(as_of, f"(-1440 * {day} - 300)")
    return {
        "id": k,
        **_common(d, k, d.div(k, 3)),
        "description": "text",
        "lang": "lang",
        "salary_min": f"case when {k} % 4 = 0 then null else cast(n_chars * 10 as double) end",
        "salary_max": f"case when {k} % 6 = 0 then null else cast(n_chars * 20 as double) end",
        "source_platforms": f"case when {k} % 2 = 0 then {d.array('source')} else {d.array('source', lit('Adzuna'))} end",
        "posted_date": posted,
        "created_at": posted,
        "is_active": f"{k} % 10 <> 0",
        "is_featured": f"case when {k} % 25 = 0 then true when {k} % 25 = 1 then null else false end",
    }


def _select(columns: dict[str, str], table: str) -> str:
    return "SELECT " + ", ".join(f"{e} AS {n}" for n, e in columns.items()) + f" FROM {table}"


@lru_cache
def oracle_views() -> dict[str, str]:
    d = Dialect(spark=False)
    return {
        "listings": _select(listings_columns(d), "orders"),
        "postings": _select(postings_columns(d), "documents"),
    }


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def texts(spark: SparkSession, sf: str) -> DataFrame:
    """The documents."""
    return table(spark, sf, "documents")


def listings(spark: SparkSession, sf: str) -> DataFrame:
    columns = listings_columns(Dialect(spark=True))
    return table(spark, sf, "orders").selectExpr(*[f"{e} AS {n}" for n, e in columns.items()])


def postings(spark: SparkSession, sf: str) -> DataFrame:
    columns = postings_columns(Dialect(spark=True))
    return texts(spark, sf).selectExpr(*[f"{e} AS {n}" for n, e in columns.items()])

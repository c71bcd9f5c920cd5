from __future__ import annotations

import hashlib
import re
from datetime import datetime

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from listflow.functions import classify as C, dates as D, extract as X, text as T
from listflow.functions.rules import classify, has_any, lookup

c = F.col


def plain_key(s: str | None) -> str:
    return re.sub(r"\s+", " ", re.sub(r"[^a-z0-9\s]", "", (s or "").lower().strip()))


SAMPLES = [None, "", "  ", "Acme, Inc.", "ACME   Inc", " trailing ! ", "Ünï-cödé Straße", "a\t\nb c d", "x_y-z", "İstanbul K"]


def test_key_text_and_hash(spark):
    rows = [(i, s) for i, s in enumerate(SAMPLES)]
    df = spark.createDataFrame(rows, "i int, s string")
    got = {r.i: r for r in df.select("i", T.normalize_key(c("s")).alias("k"), T.key_hash(c("s"), F.lit("x"), raw=(F.lit("U"),)).alias("h")).collect()}
    for i, s in rows:
        assert got[i].k == plain_key(s)
        assert got[i].h == hashlib.sha256(f"{plain_key(s)}|x|U".encode()).hexdigest()


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(codec="utf-8", exclude_characters="İ"), max_size=30), min_size=1, max_size=40))
def test_key_text_property(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, s string")
    got = {r.i: r.k for r in df.select("i", T.normalize_key(c("s")).alias("k")).collect()}
    for i, s in enumerate(texts):
        # Only case mappings newer than one side's Unicode tables could differ; ASCII results do not.
        assert got[i] == plain_key(s)


@pytest.mark.parametrize(
    "text, expected",
    [
        (None, ""), ("<p>Hello  world. More</p>", "Hello world."), ("No end", "No end"), ("A.b c! d", "A.b c!"),
        ("Line one\nline two? yes ", "Line one line two?"), ("x" * 400, "x" * 300), (". . a", ". ."),
    ],
)
def test_first_sentence(one, text, expected):
    assert one(T.first_sentence(c("t")), t=text) == expected


@pytest.mark.parametrize(
    "text, expected",
    [
        ("$100k - $200k", (100000.0, 200000.0)), ("$100,000-$200,000", (100000.0, 200000.0)), ("120k–150k", (120000.0, 150000.0)),
        ("$30-50/hr", (30000.0, 50000.0)), ("none", None), ("", None),
    ],
)
def test_salary_range(one, text, expected):
    got = one(X.salary_range(c("t")), t=text)
    assert (tuple(got) if got else None) == expected


@pytest.mark.parametrize(
    "text, expected",
    [
        ("2024-03-05T06:07:08.5Z", datetime(2024, 3, 5, 6, 7, 8, 500000)), ("2024-03-05T06:07:08.123456Z", datetime(2024, 3, 5, 6, 7, 8, 123456)),
        ("2024-03-05T06:07:08Z", datetime(2024, 3, 5, 6, 7, 8)), ("2024-03-05T06:07:08", datetime(2024, 3, 5, 6, 7, 8)),
        ("2024-03-05", datetime(2024, 3, 5)), ("05/03/2024", datetime(2024, 3, 5)), ("2024-13-05", None), ("soon", None), ("", None),
    ],
)
def test_parse_date(one, text, expected):
    got = one(F.date_format(D.parse_date(c("t")), "yyyy-MM-dd HH:mm:ss.SSSSSS"), t=text)
    assert got == (expected.strftime("%Y-%m-%d %H:%M:%S.%f") if expected else None)


def test_relative_date_and_age(one):
    as_of = "2024-03-31 12:00:00"

    def text(e, **kw):
        return one(F.date_format(e, "yyyy-MM-dd HH:mm"), **kw)

    assert text(D.relative_date(c("t"), as_of), t="3 Days ago") == "2024-03-28 12:00"
    assert text(D.relative_date(c("t"), as_of), t="1 month ago") == "2024-03-01 12:00"
    assert text(D.relative_date(c("t"), as_of), t="yesterday") is None
    assert one(D.age_days(c("t").cast("timestamp"), as_of), t="2024-03-30 13:00:00") == 0
    assert one(D.age_days(c("t").cast("timestamp"), as_of), t="2024-04-01 00:00:00") == -1


def test_relative_date_of_a_large_number(one):
    """A count that no date reaches is null and does not end the job."""
    when = lambda t: one(F.date_format(D.relative_date(c("t"), "2024-01-31 00:00:00"), "yyyy-MM-dd"), t=t)
    assert [when(f"{2_147_483_647} {u} ago") for u in ("days", "weeks", "months")] == [None] * 3
    assert when("3000000 months ago") is None and when("99999999999 days ago") is None
    assert when("24700 months ago") == "-0005-04-18"


@pytest.mark.parametrize(
    "title, level",
    [
        ("Internal Tools Engineer", "mid"), ("Lead Intern", "intern"), ("Sr. Engineer", "senior"), ("Engineer Sr", "senior"),
        ("Head of  Data", "staff"), ("co-op student", "intern"), ("Jr Dev", "junior"), ("Principal Staff", "principal"), (None, "mid"),
        ("éintern", "mid"), ("New grad", "junior"), ("Team-Lead", "lead"),
    ],
)
def test_experience_level(one, title, level):
    assert one(C.experience_level(c("t")), t=title) == level


@pytest.mark.parametrize(
    "title, currency, text, ok",
    [
        ("Engineer - UK", "INR", "", False), ("Engineer (Germany)", "INR", "", False), ("Duke Analyst", "INR", "", True),
        ("Engineer", "EUR", "", False), ("Engineer", None, "x" * 488 + " € 50", False), ("Engineer", None, "x" * 510 + "€ 50", False),
        ("New York lead", None, None, False), ("Engineer", "usd", None, True),
    ],
)
def test_home_region(one, title, currency, text, ok):
    assert one(C.home_region_ok(c("t"), c("u"), c("d")), t=title, u=currency, d=text) is ok


@pytest.mark.parametrize(
    "name, kind, backer, stealth",
    [
        ("Stealth Startup", "stealth", None, True), ("Google LLC", "big_tech", None, False), ("goo", "big_tech", None, False),
        ("Stripe", "vc_backed", "YC", False), ("Grafana Labs", "vc_backed", "Lightspeed", False), ("", "other", None, False),
        (None, "other", None, False), ("  ", "big_tech", None, False), ("Zebra Foods", "other", None, False),
    ],
)
def test_company_kind(one, name, kind, backer, stealth):
    assert tuple(one(C.company_kind(c("n")), n=name)) == (kind, backer, stealth)


@pytest.mark.parametrize(
    "company, url, label",
    [
        ("Infosys Ltd", "https://www.adzuna.com/x", "Infosys Careers"), ("Zebra", "https://www.adzuna.com/x", "Adzuna"),
        ("Google", "https://jobs.lever.co/x/1", "Lever"), ("ltimindtree", None, "LTIMindtree Careers"), ("LTIMindtree Ltd", "", "Mindtree Careers"),
        (None, "https://acme.recruiterbox.com/1", "Recruiterbox"), (None, None, "Unknown ATS"), ("", "https://wd3.myworkdayjobs.test/x", "Workday"),
        ("", "https://zoho.com/a/recruit", "Zoho Recruit"), ("", "https://careers.acme.in/x", "Company Career Page"),
    ],
)
def test_ats(spark, company, url, label):
    from listflow.operators.enrich import with_ats

    df = spark.createDataFrame([(company, url)], "company_name string, apply_url string")
    assert with_ats(df).first().ats_detected == label


def test_direct_apply(one):
    got = one(C.direct_apply(c("a"), c("u")), a="Greenhouse", u="https://boards-api.greenhouse.io/v1/boards/acme/jobs/12")
    assert (got.direct_apply_ats, got.ats_board_token, got.ats_job_id) == ("greenhouse", "acme", "12")
    assert one(C.direct_apply(c("a"), c("u")), a="Lever", u="https://redirect/x").ats_job_id is None
    assert one(C.direct_apply(c("a"), c("u")), a="Workday", u="x") is None


def test_labels(one):
    assert one(T.salary_label(c("a"), c("b"), c("u")), a=1500.0, b=2500.0, u="INR") == "₹2K – ₹3K"
    assert one(T.salary_label(c("a"), c("b"), c("u")), a=0.0, b=900.5, u=None) == "Up to $900.5"
    assert one(T.initials(c("n")), n="ada  lovelace king") == "AL"
    assert one(T.slugify(c("n")), n="--Hello, World!--") == "-hello-world-".strip("-")
    assert one(T.last_name(c("n")), n="Ada King Lovelace") == "King Lovelace"
    assert one(T.last_name(c("n")), n="Ada") == ""
    assert one(T.fenced_json(c("n")), n='x\n```json\n{"a":1}\n```\nmore') == '{"a":1}'


def test_rules_quote_and_order(one, spark):
    rules = [("a", ["it's", "back\\slash"]), ("b", [r"re:^x\d+$"]), ("c", ["x"])]
    for text, label in [("say it's", "a"), ("back\\slash", "a"), ("x12", "b"), ("xyz", "c"), ("none", "z"), ("", "z")]:
        assert one(classify(c("t"), rules, "z"), t=text) == label
    assert one(has_any(c("t"), [f"w{i}" for i in range(20)]), t="has w13 in it") is True
    assert one(lookup(c("t"), {"a'b": "1"}), t="a'b") == "1"


def test_every_kind_of_white_space_counts(one):
    from listflow.functions import dates as D, extract as X

    assert one(X.salary_range(c("t"))["min"], t="$\u00a0100k - $200k") == 100000.0
    assert one(C.home_region_ok(c("t"), F.lit("INR"), c("d")), t="Dev", d="pays €\u00a050") is False
    assert one(C.home_region_ok(c("t"), F.lit("INR"), c("d")), t="Dev", d="x " * 400 + "£ 7") is False
    assert one(C.home_region_ok(c("t"), F.lit("INR"), c("d"), window=500), t="Dev", d="x " * 400 + "£ 7") is True
    assert str(one(D.relative_date(c("t"), "2024-01-10 00:00:00"), t="3\u00a0days ago")) == "2024-01-07 00:00:00"
    assert one(T.first_sentence(c("t"), None), t="w" * 900) == "w" * 900


def test_skill_domain_ties_and_minimum(one):
    skills = F.array().cast("array<string>")
    assert one(C.skill_domain(skills, c("t")), t="react and css with django and flask") == "frontend"
    assert one(C.skill_domain(skills, c("t")), t="docker only") == "general"

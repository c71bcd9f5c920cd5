from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from listflow.plans.jobs import bulk_insert_rows, bulk_rows, ingest_cycle, ingest_feeds, refresh_listings
from listflow.schemas import LISTINGS
from listflow.sources import boards as B, feeds as S, tables as tb

AS_OF = "2024-03-01 00:00:00"


def payloads(spark, *records):
    return spark.createDataFrame([(r if isinstance(r, str) else json.dumps(r),) for r in records], "payload string")


def feed(spark, name, *records):
    f = S.FEEDS[name]
    return S.normalize_records(S.parse_payloads(payloads(spark, *records), f, "payload"), f, AS_OF)


def test_jsearch_defaults(spark):
    r = feed(spark, "JSearch", {"data": [{"job_title": "Dev", "job_is_remote": True, "job_employment_type": "FULLTIME"}]}).first()
    assert (r.title, r.company_name, r.remote_type, r.salary_currency, r.salary_period, r.job_type) == ("Dev", "", "remote", "USD", "yearly", "full-time")
    assert r.requirements == [] and r.source_platforms == ["JSearch"] and r.is_active


def test_adzuna_area_and_coordinates(spark):
    rec = {"title": "Dev", "location": {"area": ["UK", "South", "London"]}, "latitude": 51.5, "longitude": 0.1, "contract_type": "odd"}
    r = feed(spark, "Adzuna", {"results": [rec, {"title": "x", "latitude": 0}]}).collect()
    assert (r[0].location_city, r[0].location_country, r[0].company_name, r[0].job_type) == ("London", "UK", "Unknown", "odd")
    assert r[0].location_coords.lat == 51.5 and r[1].location_coords is None and r[1].location_city is None


def test_linkedin_takes_all_and_bad_payloads_are_kept_aside(spark):
    good = [{"title": f"t{i}"} for i in range(40)]
    f = S.FEEDS["LinkedIn"]
    df = payloads(spark, good, "{cut off", "12")
    assert S.parse_payloads(df, f, "payload").count() == 40
    assert S.parse_payloads(df, f, "payload", limit=25).count() == 25
    bad = S.bad_payloads(df, f, "payload").collect()
    assert {r.record for r in bad} == {"{cut off", "12"} and {r.source for r in bad} == {"LinkedIn"}


def test_an_absent_list_is_no_error_and_a_wrong_type_is_one(spark):
    good = ['{"results": null}', "{}", '{"results": []}', '{"results": [{"role": "Dev", "extra": 1}]}']
    bad = ['{"results": [{"role": 5, "remote": "yes"}]}', '{"results": [{"role": "x"}', "text"]
    got = S.bad_payloads(payloads(spark, *good, *bad), S.FEEDS["Findwork"], "payload").collect()
    assert {r.record for r in got} == set(bad)


def test_wats_list_lies_under_the_first_result(spark):
    rows = json_rows(spark, "YC-WATS", {"results": [{"hits": [{"title": "Dev", "company_name": "A", "batch": "W21"}, {"title": "Ops", "company_name": "B"}]}, {"hits": [{"title": "No"}]}]})
    assert [(r.title, r.vc_backer) for r in rows] == [("Dev", "YC W21"), ("Ops", "YC")]


def test_wellfound_compensation_and_link(spark):
    rec = {"title": "Dev", "url": "abc", "compensation": "$90k - $120k", "startup": {"name": "Acme"}, "skills": [{"name": "Go"}, {}]}
    r = feed(spark, "Wellfound", {"data": {"talent": {"jobListings": {"results": [rec]}}}}).first()
    assert (r.company_name, r.salary_min, r.salary_max, r.apply_url, r.tech_stack) == ("Acme", 90000.0, 120000.0, "https://wellfound.com/jobs/abc", ["Go", ""])


def test_landed_files_whole_cycle(spark, tmp_path):
    lines = [json.dumps({"results": [{"role": "Data Dev", "company_name": "Stripe", "location": "Pune", "text": "visa sponsor", "date_posted": "2024-02-01"}]})]
    (tmp_path / "findwork.jsonl").write_text("\n".join(lines * 2))
    landed = {"Findwork": S.read_payloads(spark, str(tmp_path / "findwork.jsonl"))}
    rows = ingest_feeds(landed, AS_OF)
    assert rows.count() == 2 and rows.first().visa_sponsorship and rows.first().vc_backer == "YC"
    empty = spark.createDataFrame([], LISTINGS)
    first = refresh_listings(empty, landed, AS_OF)
    assert first.count() == 1 and first.first().source_platforms == ["Findwork"]
    again = refresh_listings(first, landed, "2024-03-02 00:00:00", small_batch=True).first()
    assert str(again.created_at) == "2024-03-01 00:00:00" and str(again.updated_at) == "2024-03-02 00:00:00"


def test_bulk_rows(spark):
    rows = [
        (1, " Senior Dev ", "Acme", "http://x/1", None, "Remote. Series A here", None, 5.0, None),
        (2, "Senior Dev", "ACME!", "http://x/1", "India", "other", None, 5.0, None),
        (3, "Dev - UK", "Acme", "http://x/2", "Pune", "", None, None, None),
        (4, "Sales Dev", "Acme", "http://x/3", "Pune", "", None, None, None),
        (5, "Dev", "", "http://x/4", "Pune", "", None, None, None),
    ]
    df = spark.createDataFrame(rows, "seq int, title string, company string, url string, city string, description string, posted_text string, salary_min double, salary_max double")
    got = bulk_rows(df, "Adzuna-IN", AS_OF)
    assert {r.seq for r in got.collect()} == {1, 2, 4}
    kept = bulk_insert_rows(got, AS_OF).collect()
    assert [(r.seq, r.company_type, r.remote_type, r.location_city) for r in kept] == [(1, "vc_backed", "remote", "India")]


def test_bulk_rows_with_remote_flag_and_currency(spark):
    rows = [(1, "Dev", "Acme", "http://x/1", "Pune", "hybrid", True, "USD"), (2, "Dev two", "Acme", "http://x/2", "remote city", "", None, None), (3, "Dev", "A", "http://x/3", "", "", False, "EUR")]
    df = spark.createDataFrame(rows, "seq int, title string, company string, url string, city string, description string, is_remote boolean, currency string")
    df = df.withColumns({"posted_text": F.lit("2024-02-01"), "salary_min": F.lit(1.0), "salary_max": F.lit(2.0)})
    got = {r.seq: r for r in bulk_rows(df, "JSearch", AS_OF).collect()}
    assert set(got) == {1, 2}  # a foreign currency is a foreign listing
    assert got[1].remote_type == "remote" and got[1].salary_currency == "USD"
    assert got[2].remote_type == "onsite" and got[2].salary_currency == "INR"


# ------------------------------------------------------------------ boards
def board(name):
    return next(b for b in B.HTML_BOARDS + B.JSON_BOARDS if b.source == name)


def json_rows(spark, name, payload):
    b = board(name)
    return B.json_board_rows(B.json_board_items(payloads(spark, payload).withColumn("source", F.lit(b.source)), "payload"), AS_OF).orderBy("pos").collect()


def test_remoteok_skips_the_first_item_and_takes_all(spark):
    items = [{"legal": "x"}] + [{"position": f"Dev {i}", "company": "Acme", "location": "", "tags": ["a"] * 12} for i in range(70)]
    rows = json_rows(spark, "RemoteOK", items)
    assert len(rows) == 70 and rows[0].title == "Dev 0" and rows[0].location_city == "Remote" and len(rows[0].tech_stack) == 12
    few = B.json_board_rows(B.json_board_items(payloads(spark, items).withColumn("board", F.lit("RemoteOK")), "payload", "board", limit=60, tag_limit=10), AS_OF).collect()
    assert len(few) == 60 and {len(r.tech_stack) for r in few} == {10}


def test_adzuna_india_currency(spark):
    items = {"results": [{"title": "Dev", "company": {"display_name": "A"}, "salary_min": 5}, {"title": "Dev", "company": {"display_name": "A"}}, {"title": ""}]}
    rows = json_rows(spark, "Adzuna-IN", items)
    assert [(r.salary_min, r.salary_currency) for r in rows] == [(5.0, "INR"), (None, "USD")]
    rows = json_rows(spark, "Adzuna-IN-Junior", items)
    assert [(r.salary_currency, r.experience_level, r.remote_type) for r in rows] == [("INR", "junior", "onsite")] * 2


def html_rows(spark, name, *pages):
    df = spark.createDataFrame([(i, p, name) for i, p in enumerate(pages)], "page_id int, html string, source string")
    return B.html_board_rows(df, "page_id", "html", "source", AS_OF).orderBy("page_id", "pos").collect()


def test_nested_cards_and_fallbacks(spark):
    page = """<div class="job-list"><article><h2>Rust <b>Dev</b></h2><div class="org">Acme</div><a href="/j/1">go</a></article>
      <article><h3>ML</h3></article><div class="card"><h4 class="x">Go &amp; SQL dev</h4><span class="loc">Oslo, Norway</span>
      <span class="pay">$100k - $120k</span><a href="https://y.example/2">x</a></div>"""
    rows = html_rows(spark, "ArcDev", page)
    # The outer list is a card of its own: its first title is the first article's.
    assert [r.title for r in rows] == ["RustDev", "RustDev", "Go & SQL dev"]
    last = rows[-1]
    assert (last.location_city, last.location_country, last.salary_min, last.apply_url) == ("Oslo", "Norway", 100000.0, "https://y.example/2")
    assert (rows[1].company_name, rows[1].apply_url, rows[1].remote_type) == ("Acme", "https://arc.dev/j/1", "remote")


def test_unique_links_and_skips(spark):
    cards = "".join(f'<a class="listheader" href="/view/{i // 2}"><span class="headline">Job {i}</span></a>' for i in range(100))
    rows = html_rows(spark, "HasJob", cards + "<a class=listheader>none</a>", "", None)
    assert len(rows) == 50 and len(B.page_cards(cards, board("HasJob"), 40)) == 40
    assert rows[0].company_name == "Indian Company" and rows[0].apply_url == "https://hasjob.co/view/0"


def test_cards_lie_within_their_ancestors(spark):
    job = '<div class="listjob"><span class="headline">Job {}</span><a href="/v/{}">x</a></div>'
    page = job.format("out", 0) + f'<div id="main"><p>{job.format("in", 1)}</p></div><div class="col-auto">{job.format("too", 2)}</div>'
    assert [r.title for r in html_rows(spark, "HasJob", page)] == ["Job in", "Job too"]
    card = '<div class="x-internship"><h3>Analyst {}</h3><a href="/i/{}">x</a></div>'
    page = card.format("out", 0) + f'<div class="container-fluid"><div class="internship_list_container">{card.format("in", 1)}</div></div>'
    # the container's own class holds the word too, but it does not lie in itself
    assert [r.title for r in html_rows(spark, "Internshala", page)] == ["Analyst in"]


def test_fallback_cards_and_deep_nesting(spark):
    rows = html_rows(spark, "HasJob", "<p>" * 5000 + '<a href="/view/9"> Data Engineer </a><script>var x="<a href=/view/8>no</a>"</script>')
    assert [r.title for r in rows] == ["Data Engineer"]


def test_forced_values(spark):
    page = '<div class="job"><h3>Python dev</h3><a href="/x">x</a></div>'
    migrate = html_rows(spark, "MigrateMate", page)[0]
    assert migrate.visa_sponsorship and migrate.company_name == "Visa Sponsor Company" and migrate.apply_url == "https://migratemate.co/x"
    naukri = html_rows(spark, "Naukri-Startups", page)[0]
    assert naukri.apply_url == "https://www.naukri.com/startup-jobs" and naukri.remote_type == "onsite"
    assert html_rows(spark, "Web3-DS", page) == []


def test_board_cycle_touches_known_listings(spark):
    from listflow.plans.jobs import refresh_from_boards

    empty = spark.createDataFrame([], LISTINGS)
    payload = payloads(spark, {"data": [{"title": "Python dev", "company_name": "Acme", "location": "Pune"}, {"title": "", "company_name": "Acme"}]})
    items = B.json_board_items(payload.withColumns({"page": F.lit(0), "source": F.lit("Arbeitnow")}), "payload", keep=("page",))
    page = '<div class="job"><h3>Python dev</h3><span class="company">ACME</span><span class="location">Pune</span><a href="/x">x</a></div>'
    pages = spark.createDataFrame([(0, "CutShort", page), (1, "ArcDev", page.replace("Python", "Rust"))], "page int, source string, html string")
    first = refresh_from_boards(empty, AS_OF, items, pages)
    got = {r.title: r for r in first.collect()}
    # The regional board comes first and the two boards share a key.
    assert set(got) == {"Python dev", "Rust dev"} and got["Python dev"].source_platforms == ["CutShort"]
    later = "2024-03-05 00:00:00"
    stale = first.withColumn("is_active", F.lit(False))
    for small in (False, True):
        again = {r.title: r for r in refresh_from_boards(stale, later, items, small_batch=small).collect()}
        assert (again["Python dev"].is_active, again["Rust dev"].is_active) == (True, False)
        assert str(again["Python dev"].last_seen_at) == later and str(again["Rust dev"].last_seen_at) == AS_OF
        assert again["Python dev"].source_platforms == ["CutShort"]


def test_bulk_load_overwrites(spark):
    from listflow.plans.jobs import load_bulk

    cols = "seq int, title string, company string, url string, city string, description string, posted_text string, salary_min double, salary_max double"
    one = bulk_rows(spark.createDataFrame([(1, "Dev one", "Acme", "http://x/1", "Pune", "a", "2024-02-01", 5.0, 9.0)], cols), "Adzuna-IN", AS_OF)
    two = bulk_rows(spark.createDataFrame([(1, "Dev one", "Acme", "http://x/1", "Pune", "remote", None, None, 7.0)], cols), "JSearch", "2024-03-02 00:00:00")
    first = load_bulk(spark.createDataFrame([], LISTINGS), one, AS_OF)
    r = load_bulk(first, two, "2024-03-02 00:00:00").collect()
    assert len(r) == 1 and r[0].remote_type == "remote" and float(r[0].salary_min) == 5.0 and float(r[0].salary_max) == 7.0
    assert r[0].source_platforms == ["JSearch"] and str(r[0].created_at) == "2024-03-02 00:00:00"


# ------------------------------------------------------------------ tables
def test_change_log_current_rows(spark, tmp_path):
    log = str(tmp_path / "log")
    for batch, rows in enumerate([[("a", 1), ("b", 1)], [("a", 2)], [("c", 3)]]):
        tb.write_changes(spark.createDataFrame(rows, "k string, v int"), log, batch)
    tb.write_changes(spark.createDataFrame([("c", 4)], "k string, v int"), log, 2)  # a repeated batch replaces itself
    assert {tuple(r) for r in tb.current_rows(tb.read_changes(spark, log), "k").collect()} == {("a", 2), ("b", 1), ("c", 4)}
    keys = spark.createDataFrame([("a",)], "k string")
    assert [tuple(r) for r in tb.current_rows(tb.read_changes(spark, log, before=1), "k", keys).collect()] == [("a", 1)]


def test_snapshot_layout(spark, tmp_path):
    df = tb.with_month(spark.createDataFrame([(1, True, "2024-02-03")], "id int, is_active boolean, d string").withColumn("posted_date", F.to_timestamp("d")))
    path = tb.write_snapshot(df, str(tmp_path), 3, ("is_active", "posted_month"))
    assert path.endswith("version=3")
    assert tb.read_table(spark, path, ["id", "posted_month"]).first().posted_month == "2024-02"


def test_a_repeated_append_adds_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    for batch in (0, 1, 1):
        tb.append_rows(spark.range(10), path, batch)
    assert tb.read_table(spark, path).count() == 20


# ------------------------------------------------------------------ streams
@pytest.mark.parametrize("splits", [1, 3])
def test_stream_upsert_equals_batch(spark, tmp_path, splits):
    from listflow.operators.upsert import upsert
    from listflow.streaming import jobs as J

    rng = random.Random(splits)
    stored = spark.createDataFrame([(f"k{i}", None, ["s"], None) for i in range(5)], "dedup_hash string, city string, source_platforms array<string>, updated_at timestamp")
    rows = [(f"k{rng.randrange(9)}", i, rng.choice(["", "Pune", "Oslo"]), [rng.choice("abc")]) for i in range(60)]
    incoming = spark.createDataFrame(rows, "dedup_hash string, seq int, city string, source_platforms array<string>")
    log, landing = str(tmp_path / "log"), str(tmp_path / "in")
    tb.write_changes(stored, log, 0)
    step = -(-60 // splits)
    for n in range(splits):
        incoming.where(F.floor(F.col("seq") / step) == n).coalesce(1).write.mode("append").parquet(landing)
    handler = J.upsert_handler(spark, log, AS_OF)
    seen = []

    def twice(df, batch):  # a batch that is delivered again must not change the result
        handler(df, batch)
        handler(df, batch)
        seen.append(batch)

    stream = J.landed_files(spark, landing, incoming.schema, "parquet", files_per_batch=1)
    J.run_available(stream, twice, str(tmp_path / "checkpoint"))
    assert len(seen) >= splits
    got = {(r.dedup_hash, r.city, tuple(sorted(r.source_platforms))) for r in tb.current_rows(tb.read_changes(spark, log), "dedup_hash").collect()}
    want = {(r.dedup_hash, r.city, tuple(sorted(r.source_platforms))) for r in upsert(stored, incoming, AS_OF).collect()}
    assert {(k, c or None, s) for k, c, s in got} == {(k, c or None, s) for k, c, s in want}
    J.compact(spark, log, str(tmp_path / "compact"))
    assert tb.read_changes(spark, str(tmp_path / "compact")).count() == len(got)


def test_compaction_expires_old_rows(spark, tmp_path):
    from listflow.streaming import jobs as J

    log = str(tmp_path / "log")
    rows = spark.createDataFrame([("a", True, "2023-01-01"), ("b", True, "2024-02-20"), ("c", True, None)], "dedup_hash string, is_active boolean, d string")
    rows = rows.withColumns({"posted_date": F.col("d").cast("timestamp"), "updated_at": F.lit(None).cast("timestamp")}).drop("d")
    tb.write_changes(rows, log, 0)
    target = J.compact(spark, log, str(tmp_path / "new"), as_of=AS_OF)
    got = {r.dedup_hash: r.is_active for r in tb.read_changes(spark, target).collect()}
    assert got == {"a": False, "b": True, "c": True}


def test_shared_dir_follows_the_session(spark):
    from listflow.session import shared_dir

    assert shared_dir(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))


@pytest.mark.parametrize("name", sorted(S.FEEDS))
def test_rows_and_errors_of_one_parse(spark, name):
    """Every feed: the records and errors of one parse are those of the two that were read apart."""
    feed = S.FEEDS[name]
    whole = spark.range(3).select(F.from_json(F.lit("{}"), f"struct<{feed.record}>").alias("r"))
    fields = [f.name for f in whole.schema["r"].dataType.fields][:2]
    record = "{" + ", ".join(f'"{f}": "v"' for f in fields) + "}"
    inner = f"[{record}, {record}]"
    payload = inner
    for step in reversed(feed.root):
        payload = '{"%s": %s}' % (step, payload if step != "results" or feed.root[-1] != "hits" else f"[{payload}]")
    texts = [payload, "{", "", "null", "[]", "{}", "no json", None, payload[:-1], payload.replace('"v"', "5"), payload.replace('"v"', "[1]"), payload.replace('"v"', "{}")]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, payload string")
    both = S.parse_with_errors(df, feed, "payload", ("id",))
    assert both._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1
    rows = S.parse_payloads(df, feed, "payload", ("id",))
    # an empty object in place of a list at the top is no record here, and one of nulls there
    some = lambda r: any(v is not None for v in r[1:]) or feed.root
    assert sorted(map(str, both.where("error is null").select("id", "record.*").collect())) == sorted(str(r) for r in rows.collect() if some(r))
    assert sorted(r.error for r in both.where("error is not null").collect()) == sorted(r.record for r in S.bad_payloads(df, feed, "payload").collect())


def test_a_cycle_records_what_it_could_not_read(spark, tmp_path):
    lines = {"Findwork": ['{"results": [{"role": "Dev one", "company_name": "A"}, {"role": "", "company_name": "B"}]}', "{broken"], "JSearch": ['{"data": [{"job_title": "Dev one", "employer_name": "A"}]}']}
    for name, rows in lines.items():
        spark.createDataFrame([(r,) for r in rows], "value string").coalesce(1).write.text(str(tmp_path / name))
    paths = {n: str(tmp_path / n) for n in ("Findwork", "JSearch", "Adzuna")}
    empty = spark.createDataFrame([], LISTINGS)
    first = ingest_cycle(empty, paths, AS_OF)
    told = lambda c: {(r.source, r.action): r.n for r in c.report.collect()}
    assert told(first) == {("Findwork", "found"): 1, ("JSearch", "found"): 1, ("Findwork", "unreadable"): 1, ("Adzuna", "failed"): 1, ("all", "inserted"): 1}
    assert [tuple(r) for r in first.errors.collect()] == [("Findwork", "{broken")]
    assert [(r.source, r.reason) for r in first.failed.collect()] == [("Adzuna", "PATH_NOT_FOUND")]
    again = ingest_cycle(first.snapshot, paths, "2024-03-02 00:00:00", small_batch=True)
    assert told(again)["all", "updated"] == 1 and again.snapshot.count() == 1
    nothing = ingest_cycle(first.snapshot, {"Adzuna": paths["Adzuna"]}, AS_OF)
    assert told(nothing) == {("Adzuna", "failed"): 1} and nothing.snapshot.count() == 1 and nothing.errors.count() == 0


def test_plain_and_other_markup_read_alike():
    """A page gives the same cards whether its tags are plain, and looked up, or left to the parser."""
    job = '<div class="job"{}><h3>Dev {}<br{}> &amp; Ops</h3><span class="org">Acme</span><a href="/j/{}">x</a></div>'
    plain = "".join(job.format("", i, "", i) for i in range(3))
    want = [(i, f"/j/{i}", f"Dev {i}& Ops", "Acme", None, None) for i in range(3)]
    assert B.page_cards(plain, board("ArcDev")) == want
    assert B.page_cards("".join(job.format(" hidden", i, "/", i) for i in range(3)), board("ArcDev")) == want
    raw = "<!DOCTYPE html><script>if (a<b) '<div class=\"job\"><h3>no</h3></div>'</script><!-- <div class=job> -->"
    for page in (raw + plain, plain + raw, f"<p class='a>b'>{plain}", f"1 < 2{plain}", f"{plain}<div", plain.replace("<h3>", "<H3 >")):
        assert B.page_cards(page, board("ArcDev")) == want


def test_elements_of_a_page_are_visited_once(monkeypatch):
    """Cards nested in cards: the tests of tag and classes are made per kind of element, the texts are looked up by place."""
    asked = []
    kind = B.Pick.fits_kind
    monkeypatch.setattr(B.Pick, "fits_kind", lambda self, *a: asked.append(a) or kind(self, *a))
    page = "".join(f'<div class="job"><a href="/j/{i}">Post {i}</a>' for i in range(400))
    cards = B.page_cards(page, board("ArcDev"))
    assert len(cards) == 400 and cards[-1][:2] == (399, "/j/399") and len(asked) < 100

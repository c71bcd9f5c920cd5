"""Keys, first-seen rows, upserts, lifecycle jobs and row quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from listflow.functions import fixed_values as fv
from listflow.functions.text import key_hash, normalize_key
from listflow.operators import dedup, lifecycle, quality, upsert as up
from listflow.plans.jobs import startup_maintenance
from listflow.suite.registry import (
    WS, any_of, case, equals_any, key_sha, key_text, list_col, list_text, query, rule_case, trim_ws, ts_col, ts_text,
    value_map, word, matches,
)
from listflow.suite.views import LISTINGS_AS_OF, POSTINGS_AS_OF, listings, postings, table, texts

AS_OF = f"TIMESTAMP '{LISTINGS_AS_OF}'"


# ------------------------------------------------------------------ keys
@query(
    "dedup_latest", "S-18 D-1 D-2 D-6 A-9",
    f"""SELECT min(doc_id) AS doc_id, dedup_hash, count(*) AS n_rows,
        count(DISTINCT source) AS n_sources, count(*) - 1 AS n_duplicates
        FROM (SELECT doc_id, source, {key_sha('text')} AS dedup_hash FROM documents) GROUP BY dedup_hash""",
)
def dedup_latest(spark: SparkSession, sf: str) -> DataFrame:
    docs = texts(spark, sf).select("doc_id", "source", key_hash(F.col("text")).alias("dedup_hash"))
    out = dedup.with_key_summary(docs, ["dedup_hash"], ["doc_id"], "source")
    return out.select("doc_id", "dedup_hash", "n_rows", "n_sources", "n_duplicates")


@query("normalized_key_text", "D-1", f"SELECT doc_id, {key_text('text')} AS normalized FROM documents")
def normalized_key_text(spark, sf):
    return texts(spark, sf).select("doc_id", normalize_key(F.col("text")).alias("normalized"))


@query(
    "dedup_key_variants", "D-2 D-3 D-4 D-5",
    f"""SELECT id, {key_sha('company_name', 'title', 'location_city', "''")} AS key_no_date,
        {key_sha('company_name', 'title', 'location_city', "coalesce(strftime(posted_date, '%Y-%m-%d'), '')")} AS key_day,
        {key_sha('company_name', 'title', 'location_city', raw=['apply_url'])} AS key_url FROM listings""",
)
def dedup_key_variants(spark, sf):
    df = dedup.add_key(listings(spark, sf), name="key_no_date")
    df = dedup.add_key(df, day="posted_date", name="key_day")
    return dedup.add_key(df, raw=("apply_url",), name="key_url").select("id", "key_no_date", "key_day", "key_url")


@query(
    "first_seen_rows", "D-6 W-2",
    f"""SELECT id, dedup_hash FROM (SELECT id, dedup_hash, row_number() OVER (PARTITION BY dedup_hash ORDER BY created_at, id) AS rn
        FROM (SELECT *, {key_sha('company_name', 'title', 'location_city', "''")} AS dedup_hash FROM listings)) WHERE rn = 1""",
)
def first_seen_rows(spark, sf):
    df = dedup.add_key(listings(spark, sf)).select("id", "dedup_hash", "created_at")
    return dedup.first_per_key(df, ["dedup_hash"], [F.asc("created_at"), F.asc("id")]).select("id", "dedup_hash")


@query(
    "duplicates_per_title", "D-6",
    "SELECT title, count(*) AS n_rows, count(*) - 1 AS n_duplicates FROM listings GROUP BY title",
)
def duplicates_per_title(spark, sf):
    return dedup.duplicates_per_key(listings(spark, sf), ["title"])


@query(
    "sources_per_company", "A-9 O-2",
    """SELECT company_name, count(DISTINCT s) AS n_sources FROM (SELECT company_name, unnest(source_platforms) AS s FROM listings)
       GROUP BY company_name""",
)
def sources_per_company(spark, sf):
    rows = listings(spark, sf).select("company_name", F.explode("source_platforms").alias("s"))
    return dedup.union_sources(rows, ["company_name"], "s")


# ------------------------------------------------------------------ upserts
# Stored: each user's first inactive listing. Incoming: every active listing.
COLUMNS = ["location_city", "salary_min", "visa_sponsorship", "tech_stack", "source_platforms", "is_active"]


def _sides(spark, sf) -> tuple[DataFrame, DataFrame]:
    df = listings(spark, sf).withColumn("dedup_hash", F.col("user_id").cast("string"))
    df = df.withColumn("last_seen_at", F.col("created_at"))
    keep = ["dedup_hash", "id", *COLUMNS, "created_at", "updated_at", "last_seen_at"]
    stored = dedup.first_per_key(df.where("not is_active"), ["dedup_hash"], [F.asc("id")]).select(*keep)
    incoming = df.where("is_active").select("dedup_hash", F.col("id").alias("seq"), *COLUMNS)
    return stored, incoming


def _show(df: DataFrame) -> DataFrame:
    return df.select(
        "dedup_hash", "id", "location_city", "salary_min", "visa_sponsorship", list_col("tech_stack"),
        list_col("source_platforms"), "is_active", ts_col("created_at"), ts_col("updated_at"),
        ts_col("last_seen_at"), "action",
    )


_SIDES = """WITH base AS (SELECT *, CAST(user_id AS VARCHAR) AS dedup_hash, created_at AS last_seen_at FROM listings),
  s AS (SELECT * FROM base WHERE NOT is_active QUALIFY row_number() OVER (PARTITION BY dedup_hash ORDER BY id) = 1),
  i AS (SELECT *, id AS seq FROM base WHERE is_active),"""


def _sql_filled(c: str) -> str:
    return f"{c} IS NOT NULL AND {trim_ws(c)} <> ''"


def _sql_fold_list(c: str) -> str:
    return f"""CASE WHEN count({c}) > 1 THEN list_sort(list_distinct(flatten(list({c}) FILTER (WHERE {c} IS NOT NULL))))
      ELSE coalesce(first({c} ORDER BY seq) FILTER (WHERE len({c}) > 0), first({c} ORDER BY seq)) END AS {c}"""


def _sql_output(cols: dict[str, str]) -> str:
    base = {"dedup_hash": "coalesce(s.dedup_hash, n.dedup_hash)", "id": "s.id", **cols}
    kind = "CASE WHEN n.dedup_hash IS NULL THEN 'kept' WHEN s.dedup_hash IS NULL THEN 'inserted' ELSE 'updated' END"
    return (
        "SELECT " + ", ".join(f"{e} AS {n}" for n, e in base.items())
        + f", {kind} AS action FROM s FULL JOIN n ON s.dedup_hash = n.dedup_hash"
    )


_NEW, _KEPT = "s.dedup_hash IS NULL", "n.dedup_hash IS NULL"
_NOW = ts_text(AS_OF)


def _sql_merge_list(c: str, always: bool) -> str:
    both = f"list_sort(list_distinct(list_concat(coalesce(s.{c}, []), coalesce(n.{c}, []))))"
    some = f"CASE WHEN len(s.{c}) > 0 THEN s.{c} ELSE coalesce(n.{c}, s.{c}) END"
    merged = both if always else f"CASE WHEN len(s.{c}) > 0 AND n.{c} IS NOT NULL THEN {both} ELSE {some} END"
    return list_text(f"CASE WHEN {_NEW} THEN n.{c} WHEN {_KEPT} THEN s.{c} ELSE {merged} END")


MERGE_SIDES = (
    _SIDES
    + f""" n AS (SELECT dedup_hash,
      coalesce(first(location_city ORDER BY seq) FILTER (WHERE {_sql_filled('location_city')}), first(location_city ORDER BY seq)) AS location_city,
      first(salary_min ORDER BY seq) FILTER (WHERE salary_min IS NOT NULL) AS salary_min,
      first(visa_sponsorship ORDER BY seq) FILTER (WHERE visa_sponsorship IS NOT NULL) AS visa_sponsorship,
      {_sql_fold_list('tech_stack')}, {_sql_fold_list('source_platforms')}, first(is_active ORDER BY seq) AS is_active
      FROM i GROUP BY dedup_hash) """
)
MERGE_SQL = (
    MERGE_SIDES
    + _sql_output(
        {
            "location_city": f"CASE WHEN {_NEW} THEN n.location_city WHEN {_KEPT} THEN s.location_city"
            " WHEN coalesce(s.location_city, '') = '' AND coalesce(n.location_city, '') <> '' THEN n.location_city ELSE s.location_city END",
            "salary_min": "coalesce(s.salary_min, n.salary_min)",
            "visa_sponsorship": "coalesce(s.visa_sponsorship, n.visa_sponsorship)",
            "tech_stack": _sql_merge_list("tech_stack", False),
            "source_platforms": _sql_merge_list("source_platforms", True),
            "is_active": "coalesce(s.is_active, n.is_active)",
            "created_at": f"CASE WHEN {_NEW} THEN {_NOW} ELSE {ts_text('s.created_at')} END",
            "updated_at": f"CASE WHEN {_KEPT} THEN {ts_text('s.updated_at')} ELSE {_NOW} END",
            "last_seen_at": ts_text("s.last_seen_at"),
        }
    )
)


@query("upsert_merge", "U-1 U-4 J-4 S-21 D-6", MERGE_SQL)
def upsert_merge(spark, sf):
    stored, incoming = _sides(spark, sf)
    return _show(up.upsert(stored, incoming, LISTINGS_AS_OF, "merge", with_action=True))


@query("upsert_merge_small_batch", "U-1 U-4 J-4", MERGE_SQL)
def upsert_merge_small_batch(spark, sf):
    """The same upsert; the folded batch is broadcast when its rows and bytes are few."""
    stored, incoming = _sides(spark, sf)
    return _show(up.upsert(stored, incoming, LISTINGS_AS_OF, "merge", small_batch=True, with_action=True))


def _first_row(c: str) -> str:
    return f"first({c} ORDER BY seq) AS {c}"


_PLAIN = ["location_city", "salary_min", "visa_sponsorship", "tech_stack", "source_platforms", "is_active"]


@query(
    "upsert_touch", "U-2 J-4",
    _SIDES
    + f" n AS (SELECT dedup_hash, {', '.join(_first_row(c) for c in _PLAIN)} FROM i GROUP BY dedup_hash) "
    + _sql_output(
        {
            **{c: f"CASE WHEN {_NEW} THEN n.{c} ELSE s.{c} END" for c in ("location_city", "salary_min", "visa_sponsorship")},
            **{c: list_text(f"CASE WHEN {_NEW} THEN n.{c} ELSE s.{c} END") for c in ("tech_stack", "source_platforms")},
            "is_active": f"CASE WHEN {_KEPT} THEN s.is_active ELSE true END",
            "created_at": f"CASE WHEN {_NEW} THEN {_NOW} ELSE {ts_text('s.created_at')} END",
            "updated_at": f"CASE WHEN {_KEPT} THEN {ts_text('s.updated_at')} ELSE {_NOW} END",
            "last_seen_at": f"CASE WHEN {_KEPT} THEN {ts_text('s.last_seen_at')} ELSE {_NOW} END",
        }
    ),
)
def upsert_touch(spark, sf):
    stored, incoming = _sides(spark, sf)
    return _show(up.upsert(stored, incoming, LISTINGS_AS_OF, "touch", with_action=True))


def _last(c: str) -> str:
    return f"last({c} ORDER BY seq) FILTER (WHERE {c} IS NOT NULL) AS {c}"


@query(
    "upsert_overwrite", "U-3 S-23",
    _SIDES
    + f" n AS (SELECT dedup_hash, {', '.join(_last(c) for c in _PLAIN)} FROM i GROUP BY dedup_hash) "
    + _sql_output(
        {
            **{c: f"coalesce(n.{c}, s.{c})" for c in ("location_city", "salary_min", "visa_sponsorship", "is_active")},
            **{c: list_text(f"coalesce(n.{c}, s.{c})") for c in ("tech_stack", "source_platforms")},
            "created_at": f"CASE WHEN {_NEW} THEN {_NOW} ELSE {ts_text('s.created_at')} END",
            "updated_at": f"CASE WHEN {_NEW} THEN {_NOW} ELSE {ts_text('s.updated_at')} END",
            "last_seen_at": ts_text("s.last_seen_at"),
        }
    ),
)
def upsert_overwrite(spark, sf):
    stored, incoming = _sides(spark, sf)
    return _show(up.upsert(stored, incoming, LISTINGS_AS_OF, "overwrite", with_action=True))


@query(
    "upsert_report", "A-8 U-4",
    _SIDES
    + """ n AS (SELECT DISTINCT dedup_hash FROM i)
    SELECT CASE WHEN n.dedup_hash IS NULL THEN 'kept' WHEN s.dedup_hash IS NULL THEN 'inserted' ELSE 'updated' END AS action,
    count(*) AS n FROM s FULL JOIN n ON s.dedup_hash = n.dedup_hash GROUP BY 1""",
)
def upsert_report(spark, sf):
    stored, incoming = _sides(spark, sf)
    return up.upsert_counts(up.upsert(stored, incoming, LISTINGS_AS_OF, "touch", with_action=True))


@query(
    "update_where", "S-21",
    f"""SELECT id, CASE WHEN salary_currency = 'INR' THEN 'onsite' ELSE remote_type END AS remote_type,
        CASE WHEN salary_currency = 'INR' THEN {_NOW} ELSE {ts_text('updated_at')} END AS updated_at FROM listings""",
)
def update_where(spark, sf):
    hit = F.col("salary_currency") == "INR"
    values = {"remote_type": F.lit("onsite"), "updated_at": F.lit(LISTINGS_AS_OF).cast("timestamp")}
    return up.update_where(listings(spark, sf), hit, values).select("id", "remote_type", ts_col("updated_at"))


@query("delete_where", "S-22", "SELECT id FROM listings WHERE NOT coalesce(salary_currency = 'INR', false)")
def delete_where(spark, sf):
    return up.delete_where(listings(spark, sf), F.col("salary_currency") == "INR").select("id")


@query(
    "insert_unique_pairs", "J-11 S-20",
    """WITH stored AS (SELECT DISTINCT user_id, job_type FROM listings WHERE is_featured),
    ranked AS (SELECT id, user_id, job_type, row_number() OVER (PARTITION BY user_id, job_type ORDER BY id) AS rn
      FROM listings WHERE NOT is_featured AND job_type IS NOT NULL)
    SELECT id, CASE WHEN rn = 1 AND s.user_id IS NULL THEN 'appended' ELSE 'rejected' END AS outcome
    FROM ranked r LEFT JOIN stored s ON r.user_id = s.user_id AND r.job_type = s.job_type""",
)
def insert_unique_pairs(spark, sf):
    df = listings(spark, sf).where("job_type is not null").select("id", "user_id", "job_type", "is_featured")
    stored = df.where("is_featured")
    marked = up.mark_unique(stored, df.where("not is_featured"), ["user_id", "job_type"], [F.col("id")])
    return marked.select("id", F.when(F.col("accepted"), "appended").otherwise("rejected").alias("outcome"))


# ------------------------------------------------------------------ lifecycle
CUTOFF = f"({AS_OF} - INTERVAL 45 DAY)"
TITLE = "lower(title)"


def sql_recovery_level(t: str) -> str:
    rules = []
    for level, words in fv.RECOVERY_LEVEL_WORDS:
        cond = word(t, [w.replace(r"\s", "[ \\t\\n]").replace("[[ \\t\\n]-]", "[ -]") for w in words])
        if level == "senior":
            cond += " OR " + matches(t, r"(^|[^\p{L}\p{N}_])sr\.?[ \t\n]")
        if level == "junior":
            cond += " OR " + matches(t, r"(^|[^\p{L}\p{N}_])jr\.?[ \t\n]")
        rules.append((level, f"({cond})"))
    return case(rules, "mid")


def sql_job_type(t: str) -> str:
    return rule_case(
        t,
        [("internship", ["intern", "trainee"]), ("freelance", ["freelance"]), ("contract", ["contract"]),
         ("part-time", ["part-time", "part time"])],
        "full-time",
    )


def sql_clamp(c: str) -> str:
    low = f"lower(trim(coalesce({c}, '')))"
    return f"CASE WHEN {low} IN ('remote', 'hybrid', 'onsite') THEN {low} ELSE 'onsite' END"


def sql_recoverable() -> str:
    t = "trim(title)"
    return (
        f"(length({t}) >= 5 AND length(trim(coalesce(company_name, ''))) >= 2 AND coalesce(apply_url, '') LIKE 'http%'"
        f" AND NOT {any_of(TITLE, fv.RECOVERY_NON_TECH)} AND NOT ("
        + " OR ".join(f"{TITLE} LIKE '{p}%'" for p in fv.FAKE_PREFIXES) + "))"
    )


def _life(df: DataFrame) -> DataFrame:
    return df.select("id", "is_active", "experience_level", "job_type", "remote_type", ts_col("updated_at"))


def _sql_life(hit: str, active: str, level: str, jt: str, remote: str) -> str:
    def pick(new: str, old: str) -> str:
        return f"CASE WHEN coalesce({hit}, false) THEN {new} ELSE {old} END"

    return f"""SELECT id, {pick(active, 'is_active')} AS is_active, {pick(level, 'experience_level')} AS experience_level,
      {pick(jt, 'job_type')} AS job_type, {pick(remote, 'remote_type')} AS remote_type,
      {pick(_NOW, ts_text('updated_at'))} AS updated_at FROM listings"""


_EXPIRE = f"(is_active AND posted_date < {CUTOFF})"
_RECOVER = f"(NOT is_active AND posted_date >= {CUTOFF} AND {sql_recoverable()})"


@query("expire_old", "L-1", _sql_life(_EXPIRE, "false", "experience_level", "job_type", "remote_type"))
def expire_old(spark, sf):
    return _life(lifecycle.expire(listings(spark, sf), LISTINGS_AS_OF))


@query("recover_valid", "L-2 F-13 C-7 C-8 C-11", _sql_life(_RECOVER, "true", sql_recovery_level(TITLE), sql_job_type(TITLE), sql_clamp("remote_type")))
def recover_valid(spark, sf):
    return _life(lifecycle.recover(listings(spark, sf), LISTINGS_AS_OF))


@query(
    "recategorize_active", "L-3 C-7",
    _sql_life(
        f"(is_active AND (experience_level IS DISTINCT FROM {sql_recovery_level(TITLE)} OR remote_type IS DISTINCT FROM"
        f" ({sql_clamp('remote_type')}) OR coalesce(job_type, '') = ''))",
        "is_active", sql_recovery_level(TITLE), sql_job_type(TITLE), sql_clamp("remote_type"),
    ),
)
def recategorize_active(spark, sf):
    return _life(lifecycle.recategorize(listings(spark, sf), LISTINGS_AS_OF))


def sql_level(t: str) -> str:
    rules = []
    for level, words in fv.LEVEL_WORDS:
        cond = word(t, [w.replace(r"\s", " ") for w in words])
        if level in ("senior", "junior"):
            short = {"senior": "sr", "junior": "jr"}[level]
            cond += " OR " + matches(t, rf"(^|[^\p{{L}}\p{{N}}_]){short}(\.?[ \t\n]|$)")
        rules.append((level, f"({cond})"))
    return case(rules, "mid")


def sql_region_ok(t: str, currency: str, text: str) -> str:
    return (
        f"NOT ({word(t, fv.FOREIGN_COUNTRIES + fv.FOREIGN_CITIES)} OR "
        f"{equals_any(f'lower(coalesce({currency}, chr(32)))', fv.FOREIGN_CURRENCIES)} OR "
        f"{matches(f'lower(coalesce({text}, chr(32)))', f'[£€][{WS}]*[0-9]')})"
    )


@query(
    "reactivate_region", "L-4 F-12 C-5",
    _sql_life(
        f"(NOT is_active AND (contains(lower(location_country), 'india') OR location_country = 'IN') AND {sql_region_ok(TITLE, 'salary_currency', chr(39) * 2)})",
        "true", sql_level(TITLE), "job_type", "remote_type",
    ),
)
def reactivate_region(spark, sf):
    return _life(lifecycle.reactivate_region(listings(spark, sf), LISTINGS_AS_OF))


@query(
    "startup_maintenance", "L-5",
    f"""SELECT id, CASE WHEN coalesce({_RECOVER}, false) THEN true WHEN coalesce({_EXPIRE}, false) THEN false ELSE is_active END AS is_active FROM listings""",
)
def run_startup_maintenance(spark, sf):
    return startup_maintenance(listings(spark, sf), LISTINGS_AS_OF).select("id", "is_active")


@query(
    "maintenance_counts", "L-1 L-2 A-10",
    f"""SELECT is_active AS was, NOT is_active AS now, count(*) AS n FROM listings
        WHERE coalesce({_RECOVER}, false) OR coalesce({_EXPIRE}, false) GROUP BY 1, 2""",
)
def maintenance_counts(spark, sf):
    before = listings(spark, sf)
    return lifecycle.changes(before, startup_maintenance(before, LISTINGS_AS_OF), "id")


@query(
    "one_default_per_user", "L-6 J-12",
    "SELECT id, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) = 1 AS is_default FROM listings",
)
def one_default_per_user(spark, sf):
    df = listings(spark, sf).select("id", "user_id", "created_at")
    return lifecycle.one_default(df, "user_id", [F.col("created_at"), F.col("id")]).select("id", "is_default")


_STATUS = "CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'applied' END"


@query(
    "drop_failed_applications", "L-7 S-22",
    f"""SELECT o_orderkey AS id, o_custkey AS user_id, {_STATUS} AS status FROM orders
        WHERE NOT (o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') AND coalesce({_STATUS} = 'failed', true))""",
)
def drop_failed_applications(spark, sf):
    orders = table(spark, sf, "orders")
    apps = orders.selectExpr("o_orderkey AS id", "o_custkey AS user_id", f"{_STATUS} AS status")
    retry = orders.where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("user_id"))
    return lifecycle.drop_failed(apps, retry, ["user_id"]).select("id", "user_id", "status")


@query(
    "patch_profiles", "L-8",
    """SELECT c_custkey AS id, coalesce(nullif(CASE WHEN s_acctbal < 3000 THEN '' ELSE s_name END, ''), c_name) AS full_name,
       coalesce(CASE WHEN s_nationkey < 12 THEN 'phone ' || s_nationkey END, c_mktsegment) AS phone
       FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey""",
)
def patch_profiles(spark, sf):
    profiles = table(spark, sf, "customer").selectExpr("c_custkey AS id", "c_name AS full_name", "c_mktsegment AS phone")
    new = table(spark, sf, "supplier").selectExpr(
        "s_suppkey AS id", "CASE WHEN s_acctbal < 3000 THEN '' ELSE s_name END AS full_name",
        "CASE WHEN s_nationkey < 12 THEN 'phone ' || s_nationkey END AS phone",
    )
    return lifecycle.patch(profiles, new, "id", ["full_name", "phone"])


# ------------------------------------------------------------------ quality
_INSERT = case(
    [
        ("missing field", "title = '' OR coalesce(company_name, '') = '' OR coalesce(apply_url, '') = ''"),
        ("title too short", "length(title) < 5"),
        ("invalid apply_url", "apply_url NOT LIKE 'http%'"),
        ("non-tech job", any_of(TITLE, fv.BULK_NON_TECH)),
    ],
    "ok",
)


@query("insert_rejects", "F-10 A-8", f"SELECT {_INSERT} AS reason, count(*) AS n FROM listings GROUP BY 1")
def insert_rejects(spark, sf):
    verdict = quality.insert_verdict(F.col("title"), F.col("company_name"), F.col("apply_url"))
    return quality.reject_counts(listings(spark, sf), verdict)


def sql_quality() -> str:
    return case(
        [
            ("title too short", "length(trim(title)) < 5"),
            ("company name too short", "length(trim(coalesce(company_name, ''))) < 2"),
            ("invalid apply_url", "coalesce(apply_url, '') NOT LIKE 'http%'"),
            ("fake/test job", "(" + " OR ".join(f"{TITLE} LIKE '{p}%'" for p in fv.FAKE_PREFIXES) + ")"),
            ("non-tech job", any_of(TITLE, fv.NON_TECH)),
            ("generic/spam title", equals_any(TITLE, fv.GENERIC_TITLES)),
            (
                "location mismatch: foreign signals in title",
                f"lower(location_country) IN ('india', 'in') AND NOT ({sql_region_ok(TITLE, 'salary_currency', 'description')})",
            ),
        ],
        "ok",
    )


_LEVEL_FIX = f"CASE WHEN coalesce(experience_level, '') <> '' THEN {sql_level(TITLE)} ELSE experience_level END"


@query("quality_verdicts", "F-11 F-12 C-5", f"SELECT id, {sql_quality()} AS reason, {_LEVEL_FIX} AS experience_level FROM listings")
def quality_verdicts(spark, sf):
    cols = [F.col(c) for c in ("title", "company_name", "apply_url", "location_country", "salary_currency", "description")]
    return listings(spark, sf).select(
        "id", quality.quality_verdict(*cols).alias("reason"),
        quality.corrected_level(F.col("title"), F.col("experience_level")).alias("experience_level"),
    )


@query("quality_verdict_counts", "F-11 A-8", f"SELECT {sql_quality()} AS reason, count(*) AS n FROM postings GROUP BY 1")
def quality_verdict_counts(spark, sf):
    cols = [F.col(c) for c in ("title", "company_name", "apply_url", "location_country", "salary_currency", "description")]
    return quality.reject_counts(postings(spark, sf), quality.quality_verdict(*cols))


_ABROAD = f"(coalesce(lower(location_country) IN ('india', 'in'), false) AND NOT ({sql_region_ok(TITLE, 'salary_currency', 'description')}))"
_CLEAN_TYPE = f"coalesce(nullif({value_map('lower(trim(job_type))', fv.JOB_TYPE_CLEANUP, 'lower(trim(job_type))')}, ''), 'full-time')"


@query(
    "sanitized_rows", "C-20 X-5 X-3",
    f"""SELECT id, {sql_level(TITLE)} AS experience_level, CASE WHEN NOT {_ABROAD} THEN location_city END AS location_city,
        CASE WHEN NOT {_ABROAD} THEN {value_map('lower(location_country)', fv.COUNTRY_NAMES, 'location_country')} END AS location_country,
        {_CLEAN_TYPE} AS job_type,
        CASE WHEN lower(trim(remote_type)) IN ('remote', 'hybrid', 'onsite') THEN remote_type ELSE 'onsite' END AS remote_type FROM listings""",
)
def sanitized_rows(spark, sf):
    out = quality.sanitize(listings(spark, sf))
    return out.select("id", "experience_level", "location_city", "location_country", "job_type", "remote_type")


def sql_stars(as_of: str) -> dict[str, str]:
    days = f"floor((epoch_us({as_of}) - epoch_us(posted_date)) / 86400000000.0)"
    signals = [
        ("coalesce(salary_min, 0) <> 0 OR coalesce(salary_max, 0) <> 0", 10, "Salary disclosed"),
        ("coalesce(company_name, '') NOT IN ('', 'Indian Company', 'Indian Startup', 'AI Company')", 5, "Named company"),
        ("len(tech_stack) >= 2", 10, "Tech stack listed"),
        ("length(description) > 100", 5, "Detailed description"),
        ("contains(apply_url, 'http')", 5, "Direct apply link"),
        ("company_type = 'vc_backed'", 5, "VC-backed"),
        ("visa_sponsorship", 3, "Visa sponsorship"),
        ("len(source_platforms) >= 2", 5, "Multi-source verified"),
        (f"{days} <= 1", 10, "Posted today"),
        (f"{days} > 1 AND {days} <= 3", 7, "Posted this week"),
        (f"{days} > 3 AND {days} <= 7", 3, "Recent"),
    ]
    tenths = "(" + " + ".join(f"CASE WHEN {c} THEN {p} ELSE 0 END" for c, p, _ in signals) + ")"
    whole, rest = f"({tenths} // 10)", f"({tenths} % 10)"
    rounded = f"({whole} + CASE WHEN {rest} > 5 OR ({rest} = 5 AND {whole} % 2 = 1) THEN 1 ELSE 0 END)"
    reasons = "[" + ", ".join(f"CASE WHEN {c} THEN '{why}' END" for c, _, why in signals) + "]"
    return {
        "stars": f"CAST(least(5, greatest(1, {rounded})) AS BIGINT)",
        "raw_score": f"{tenths} / 10.0::DOUBLE",
        "reasons": f"array_to_string(list_filter({reasons}, lambda x: x IS NOT NULL), '|')",
    }


def _stars_query(view: str, as_of: str) -> str:
    s = sql_stars(f"TIMESTAMP '{as_of}'")
    return f"SELECT id, {s['stars']} AS stars, {s['raw_score']} AS raw_score, {s['reasons']} AS reasons FROM {view}"


def _stars(df: DataFrame, as_of: str) -> DataFrame:
    rated = df.withColumn("_r", quality.star_rating(as_of))
    return rated.select("id", "_r.stars", "_r.raw_score", list_col(F.col("_r.reasons"), "reasons"))


@query("star_ratings", "R-1 X-27", _stars_query("listings", LISTINGS_AS_OF))
def star_ratings(spark, sf):
    return _stars(listings(spark, sf), LISTINGS_AS_OF)


@query("star_ratings_postings", "R-1", _stars_query("postings", POSTINGS_AS_OF))
def star_ratings_postings(spark, sf):
    return _stars(postings(spark, sf), POSTINGS_AS_OF)

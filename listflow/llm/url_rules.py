"""URL filters: a sort-merge range join with a stack of nested rules, by DataFrame operations only.

A host read backwards, label by label with a dot behind each, makes a key under
which a rule's host and all its subdomains are one interval; paths are such keys
already. In a sweep over sorted rule starts and points, the rules active at a
point are those on the stack of the last start before it that are prefixes of
the point. A rule's stack is known beforehand: the rules that are prefixes of
it. So a sweep is a window that carries the last stack forward.

Distinct hosts are swept against rule hosts, then distinct (rule host, path)
against the paths of that host. A group (top label, or rule host) with many
points is dealt to several windows, each with all rules of the group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from listflow.llm.common import staged

#: Points of one sweep.
POINTS = 100_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: str | Column) -> Column:
    """What stands between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, A-Z in lower case."""
    return F.translate(_raw_host(url), UPPER, LOWER)


def _rest(url: str | Column) -> Column:
    url = F.col(url) if isinstance(url, str) else url
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url))).otherwise("")


def _raw_host(url: str | Column) -> Column:
    return F.regexp_extract(_rest(url), "^[^/?#]*", 0)


def url_path(url: str | Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    rest = _rest(url)
    return F.regexp_extract(F.substring(rest, F.length(_raw_host(url)) + F.lit(1), F.length(rest)), "^[^?#]*", 0)


def host_key(host: str | Column) -> Column:
    """Labels in reverse, a dot behind each."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


def _sweep(points: DataFrame, rules: DataFrame) -> DataFrame:
    """For each point (``grp``, ``key``) the keys of the rules of its group that are prefixes of it, shortest first; points without any are left out.

    Rules (``grp``, ``key``, ``stack``) bear the keys of the rules they lie in, themselves included.
    """
    parts = points.groupBy("grp").agg(F.ceil(F.count("*") / POINTS).cast("int").alias("parts"))
    dealt = points.join(parts, "grp").select("grp", F.pmod(F.xxhash64("key"), "parts").cast("int").alias("part"), "key", F.lit(1).alias("kind"), F.lit(None).cast("array<string>").alias("stack"))
    starts = rules.join(parts, "grp").select("grp", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "key", F.lit(0).alias("kind"), "stack")
    order = W.partitionBy("grp", "part").orderBy("key", "kind").rowsBetween(W.unboundedPreceding, 0)
    swept = dealt.unionByName(starts).withColumn("stack", F.last("stack", ignorenulls=True).over(order)).where("kind = 1")
    active = F.filter("stack", lambda k: F.startswith(F.col("key"), k))
    return swept.select("grp", "key", active.alias("active")).where(F.size("active") > 0)


def _stacked(rules: DataFrame, prefixes: Column) -> DataFrame:
    """Rules (``grp``, ``key``) with their stacks, from all prefixes a rule's key may have."""
    above = rules.select("grp", F.col("key").alias("inner"), F.explode(prefixes).alias("key"))
    return above.join(rules, ["grp", "key"]).groupBy("grp", "inner").agg(F.sort_array(F.collect_set("key")).alias("stack")).select("grp", F.col("inner").alias("key"), "stack")


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", id_column: str = "page_id", url: str = "url") -> DataFrame:
    """Per row of ``pages``: ``page_id``, ``host``, ``path``, ``rule`` and ``verdict``.

    ``rules`` has ``host``, ``path`` and ``verdict`` (allow or block). A rule fits
    its host and all subdomains if the path starts with its own; the longest rule
    wins, of equal ones that with the longer host. Without a rule, or a host, the
    verdict is ``default``. Rules listed with both verdicts block. A null rule
    host or path is no rule. Null ids and repeated rows are judged like others.
    """
    known = rules.where("host is not null and path is not null").groupBy(host_key("host").alias("host"), "path").agg(F.max("verdict").alias("verdict"), F.first("host").alias("plain"))
    known = staged(known, "url-rules")
    seen = pages.select(F.col(id_column).alias("page_id"), url_host(url).alias("host"), url_path(url).alias("path"))
    points = seen.select("host", "path").distinct()
    hosts = points.where("host <> ''").select("host").distinct().withColumn("key", host_key("host"))

    top = lambda key: F.substring_index(key, ".", 1)
    rule_hosts = known.select(top("host").alias("grp"), F.col("host").alias("key")).distinct()
    labels = F.transform(F.sequence(F.lit(1), F.size(F.split("key", r"\.", -1)) - 1), lambda n: F.concat(F.call_function("substring_index", F.col("key"), F.lit("."), n), F.lit(".")))
    chains = _sweep(hosts.select(top("key").alias("grp"), "key"), _stacked(rule_hosts, labels))
    chains = hosts.join(chains.select("key", "active"), "key").select("host", F.explode("active").alias("grp"))

    met = staged(points.join(chains, "host").select("host", "grp", F.col("path").alias("key")), "url-points")
    paths = known.select(F.col("host").alias("grp"), F.col("path").alias("key"))
    characters = F.transform(F.sequence(F.lit(0), F.length("key")), lambda n: F.substring(F.col("key"), F.lit(1), n))
    found = _sweep(met.select("grp", "key").distinct(), _stacked(paths, characters)).select("grp", "key", F.element_at("active", -1).alias("path"))
    found = found.join(known.withColumnRenamed("host", "grp"), ["grp", "path"])
    ruled = met.join(found, ["grp", "key"]).groupBy("host", F.col("key").alias("path")).agg(
        F.max_by(F.struct(F.concat(F.col("plain"), F.col("path")).alias("rule"), "verdict"), F.struct(F.length("plain") + F.length("path"), F.length("plain"), "plain")).alias("best")
    )
    out = seen.join(ruled, ["host", "path"], "left")
    return out.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def oracle(rules: list[tuple[str, str, str]], default: str = "allow") -> str:
    values = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in rules)
    return f"""
    WITH r(rh, rp, v) AS (VALUES {values}),
    u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
    s AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM u),
    k AS (SELECT page_id, translate(raw, '{UPPER}', '{LOWER}') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM s)
    SELECT page_id, host, path,
      (SELECT arg_max(rh || rp, 1000 * length(rh || rp) + length(rh)) FROM r WHERE (host = rh OR host LIKE '%.' || rh) AND starts_with(path, rp)) AS rule,
      coalesce((SELECT arg_max(v, 1000 * length(rh || rp) + length(rh)) FROM r WHERE (host = rh OR host LIKE '%.' || rh) AND starts_with(path, rp)), '{default}') AS verdict
    FROM k
    """

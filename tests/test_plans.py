"""The physical plans that the design relies on."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from listflow.operators import dedup, matching, ranking as R, search, stats, upsert as U
from listflow.suite import QUERIES
from listflow.suite.views import listings

SF = "/root/testdata/sf0.001"
PYTHON_NODES = ("ArrowEvalPython", "BatchEvalPython", "MapInPandas", "FlatMapGroupsInPandas")
# Vector blocks and nested HTML cards are the two places that use pandas batches.
PANDAS_QUERIES = {"vector_top_many", "vector_top_many_hashed", "html_board_rows"}
STREAMS = {n for n in QUERIES if n.startswith("stream_")}


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in PANDAS_QUERIES | STREAMS])
def test_no_python_and_no_cross_join(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert not any(node in text for node in PYTHON_NODES)
    assert "CartesianProduct" not in text
    if "BroadcastNestedLoopJoin" in text:  # only containment joins, behind a size check
        assert "Contains(" in text


def test_filters_and_columns_reach_the_scan(spark, tmp_path):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    path = str(tmp_path / "jobs")
    listings(spark, SF).write.partitionBy("is_active").parquet(path)
    df = spark.read.parquet(path)
    params = search.SearchParams(remote_type="remote", salary_min=5.0)
    text = plan(search.where_all(df, [search.unexpired("2001-08-02 00:00:00"), *search.predicates(params, "2001-08-02 00:00:00")]).select("id"))
    assert "PartitionFilters: [isnotnull(is_active" in text
    for part in ("EqualTo(remote_type,remote)", "GreaterThanOrEqual(salary_min,5.0)", "GreaterThanOrEqual(posted_date"):
        assert part in text
    schema = text.split("ReadSchema: ")[1]
    assert "description" not in schema and "tech_stack" not in schema


def test_top_per_group_limits_below_the_shuffle(spark):
    text = plan(dedup.first_per_key(listings(spark, SF).select("id", "title"), ["title"], [F.asc("id")]))
    assert text.count("WindowGroupLimit") == 2
    assert text.index("Exchange") < text.rindex("WindowGroupLimit")


def test_pages_are_top_k(spark):
    df = listings(spark, SF)
    for page in (search.page_of(df, search.sort_keys(), 3, 10), search.page_after(df, 10)):
        assert "TakeOrderedAndProject" in plan(page)


def test_breakdown_is_one_global_aggregate(spark):
    text = plan(stats.region_breakdown(listings(spark, SF), F.lit(True)))
    assert text.count("Exchange") == 1 and "SinglePartition" in text


def test_small_batch_upsert_does_not_shuffle_the_stored_table(spark, tmp_path):
    df = listings(spark, SF).select(F.col("id").cast("string").alias("dedup_hash"), "location_city", "salary_min", "updated_at")
    path = str(tmp_path / "stored")
    df.write.parquet(path)
    stored = spark.read.parquet(path)
    incoming = df.limit(5).withColumn("seq", F.lit(1))
    text = plan(U.upsert(stored, incoming, "2024-01-01", small_batch=True))
    assert "SortMergeJoin" not in text and "ShuffledHashJoin" not in text
    assert "FullOuter" not in text


def test_dedup_combines_before_the_shuffle(spark):
    text = plan(dedup.duplicates_per_key(listings(spark, SF), ["title"]))
    assert "partial_count" in text


def test_ranking_for_many_people_moves_no_listing(spark):
    """With broadcasting by size off, as for a large table, listings cross no exchange before they are cut to the best."""
    people = spark.createDataFrame([("a", ["python"], "senior", "data", ["data"], ["engineer"])], "candidate_id string, skills array<string>, level string, domain string, words array<string>, past_title_words array<string>")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(R.rank_for_resumes(listings(spark, SF), people, "2001-08-02 00:00:00", days=3650))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" not in text and "BroadcastHashJoin" in text
    # from the scan upwards, the first exchange stands above a limit per candidate
    scan = text[: text.index("Scan parquet")]
    assert scan.rindex("WindowGroupLimit") > scan.rindex("Exchange hashpartitioning(candidate_id")


def test_large_term_tables_send_pieces_not_texts(spark):
    texts = listings(spark, SF).select("description")
    terms = spark.range(50).selectExpr("concat('visa ', id) AS term")
    found = matching._piece_candidates(texts.selectExpr("lower(description) AS _low").distinct(), terms.selectExpr("term AS _key").distinct())
    pieces = [line for line in plan(found).splitlines() if "Exchange hashpartitioning(_piece" in line]
    assert pieces
    for line in plan(found).splitlines():
        # what is dealt by pieces has no text with it
        if "Generate explode" in line and "_low" in line:
            assert "[_hash" in line or "_low#" in line
    below = plan(found).split("Exchange hashpartitioning(_piece")[1:]
    assert all("_low" not in part.splitlines()[1].split("Project [")[-1].split("]")[0].split(" AS ")[-1] for part in below if "Project [" in part.splitlines()[1])


def test_size_checks(spark):
    assert matching.is_small(spark.range(5), 5) and not matching.is_small(spark.range(6), 5)
    wide = spark.range(3).withColumn("text", F.expr("repeat('x', 1000)"))
    assert matching.is_small(wide, 5, max_bytes=4000) and not matching.is_small(wide, 5, max_bytes=2000)

"""The operators bound to the test tables, one query each, with oracle SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from listflow.llm import negatives, personal, shards, url_rules
from listflow.llm.alignment import align_tokens
from listflow.llm.ann import nearest_neighbours
from listflow.llm.chat import format_chat, read_back
from listflow.llm.common import table
from listflow.llm.mixing import mix_counts
from listflow.llm.near_dup import near_duplicates
from listflow.llm.packing import pack
from listflow.llm.quality import fit_field, quality
from listflow.llm.repeats import remove_repeats
from listflow.llm.token_counts import token_counts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=4, percent=80)


@query
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality(docs, fit_field(docs, table(spark, sf_dir, "labels"))).drop("lines")


@query
def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    spaced = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", " "))
    return done.select("doc_id", "repeats.n_words", "repeats.n_removed", F.sha2(spaced, 256).alias("kept_sha256"))


@query
def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


@query
def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_counts(table(spark, sf_dir, "documents")).drop("shards")


@query
def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as tokenizers

    docs = table(spark, sf_dir, "documents")
    return token_counts(docs, ("source", "lang", "text"), tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN)


#: Fixed values of the contract: host, path and verdict of each rule.
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


@query
def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = ", ".join(str(r) for r in URL_RULES)
    return url_rules.judge_urls(table(spark, sf_dir, "pages"), spark.sql(f"SELECT * FROM VALUES {rules} AS t(host, path, verdict)"))


ORACLES["op5_url_filters"] = url_rules.oracle(URL_RULES)

#: Small against the default of 128 MiB, so that the test tables have many shards.
SHARD_BYTES = 1 << 20


@query
def op7_extendible_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.extendible_shards(table(spark, sf_dir, "documents"), SHARD_BYTES)


ORACLES["op7_extendible_shards"] = shards.oracle(SHARD_BYTES)

SAMPLE_TURN = "\\### Assistant: </turn> ok"


@query
def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(SAMPLE_TURN).alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return read_back(format_chat(rows))


@query
def op6_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(table(spark, sf_dir, "embeddings"))


@query
def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as tokenizers

    docs = table(spark, sf_dir, "documents")
    done = align_tokens(docs, tokenizers.path("byte_bpe_50k.json"), tokenizers.path("piece_bpe_32k.model"), digest=True)
    return done.withColumnRenamed("groups", "groups_sha256")


@query
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return negatives.mine_negatives(rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))))


ORACLES["op11_hard_negatives"] = negatives.oracle()


@query
def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return personal.digests(personal.find_personal(docs, personal.fit_field(docs)))

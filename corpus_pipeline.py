"""A training corpus from ``documents``, in five stages, each of which reads what the one before it wrote.

``STAGES`` holds names and functions of (spark, docs, sf_dir). All but the last
return the columns of ``docs``. A stage holds no state but what it returns, so a
lost run can start again at any stage's table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from listflow.llm.common import drop_staged, staged, staged_so_far, table
from listflow.llm.mixing import mix
from listflow.llm.near_dup import one_of_each
from listflow.llm.packing import pack
from listflow.llm.quality import fit_field, keep_content
from listflow.llm.repeats import remove_repeats

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that pass the fixed rules and are mostly content; null and near-empty texts go."""
    return keep_content(docs, fit_field(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates, once; rows without an id stay."""
    return one_of_each(docs, words=5, percent=80)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 35 words or more that occur elsewhere; texts of nothing else go."""
    done = remove_repeats(docs).where("repeats.n_removed = 0 or repeats.n_removed < repeats.n_words").drop("repeats")
    return done.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else done


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of each source as often as its weight wants, shuffled within shards."""
    return mix(docs).select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces placed in sequences of at most 4096 tokens; fewer words are held, as other stages' workers are still there."""
    return pack(docs, TOKENIZER, held_words=500_000)


STAGES = [
    ("quality rules", quality_rules),
    ("MinHash near-dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", best_fit_packing),
]

#: A fitted field, hashes and a tokenizer have no SQL; tests compare each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table. Once a stage is written, what it and those before it staged goes."""
    docs, since = table(spark, sf_dir, "documents"), staged_so_far()
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name.split()[0].lower())
        drop_staged(spark, since)
    return docs

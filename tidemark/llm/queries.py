"""The corpus queries that __spark_entry__.py registers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, toxicity
from .common import table
from .decontaminate import contaminated
from .exact_dedup import exact_dedup
from .mixing import mix_sources
from .ngram_lm import lm_scores
from .pii import KINDS, find_pii, span_digest
from .secret_scan import labelled_findings, scan_secrets, train_forest
from .simhash import simhash_components
from .url_rules import judge_urls, rules_table

#: (verdict, host, path) of op6: fixed values.
URL_RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


#: The conversation that op8 adds: fixed values.
EXTRA_CONVERSATION = [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]


def id_fold(folds: int, fold: int) -> Column:
    """True for rows whose crc32(doc_id as text) leaves `fold` when divided by `folds`."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % folds == fold


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), toxicity.training_fold())
    scored = toxicity.toxicity_scores(docs, model)
    return scored.withColumn("held_out", id_fold(4, 2)).select("doc_id", "held_out", "score", "predicted", "near_ids", "near_cosines")


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents"))
    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = '{k}')) as long) AS n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(span_digest(F.col("base")), 256).alias("base_sha256"), span_digest(F.concat("base", "added")).alias("spans"))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op6_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    judged = judge_urls(pages, rules_table(spark, URL_RULES))
    return judged.select("page_id", F.col("url_host").alias("host"), F.col("url_path").alias("path"), F.col("url_rule").alias("rule"), F.col("url_verdict").alias("verdict"))


def op7_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"), ~id_fold(5, 1))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame(EXTRA_CONVERSATION, "conv_id long, turn long, role string, text string")
    turns = chat.format_turns(rows.unionByName(extra))
    return chat.read_back(turns).withColumnRenamed("conv", "conv_id")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"), keep="max")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"), train_forest(labelled_findings(spark)))


QUERIES = {
    f.__name__: f
    for f in (
        op1_benchmark_decontamination, op2_toxicity, op3_simhash_near_dedup, op4_pii, op5_mix_sources, op6_url_rules, op7_lm_scores, op8_chat_format, op9_exact_dedup, op10_secret_scan,
    )
}

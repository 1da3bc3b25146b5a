"""The corpus operators as named queries over the synthetic tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, decontaminate, exact_dedup, filter_audit, hard_negatives, language_id, line_dedup, mixing, ngram_jaccard, secrets, substring_dedup, toxicity, url_filter

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    host = F.when(F.instr("url", "://") > 0, url_filter.host_of(F.col("url")))
    return line_dedup.site_line_dedup(pages, "page_id", host, line_dedup.html_lines(F.col("html")))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.report(table(spark, sf_dir, "documents"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.report(table(spark, sf_dir, "documents"), k=3, num=90, den=100)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.report(table(spark, sf_dir, "conversations"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    relabelled = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(vectors.withColumn("label", relabelled.cast("int")), F.col("vec_id") % 100 == 0)


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.report(table(spark, sf_dir, "documents"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_language_id,
        op2_url_filter,
        op3_line_dedup,
        op4_exact_dedup,
        op5_secrets,
        op6_mixing,
        op7_ngram_jaccard,
        op8_toxicity,
        op9_decontamination,
        op10_chat_format,
        op11_hard_negatives,
        op12_substring_dedup,
        op13_filter_audit,
    )
}

SQL: dict[str, str] = {
    "op2_url_filter": url_filter.REPORT_SQL,
    "op3_line_dedup": line_dedup.REPORT_SQL,
    "op4_exact_dedup": exact_dedup.REPORT_SQL,
    "op6_mixing": mixing.MIX_SQL.format(own="doc_id", docs="documents"),
    "op10_chat_format": chat_format.REPORT_SQL,
    "op11_hard_negatives": hard_negatives.MINE_SQL,
    "op12_substring_dedup": substring_dedup.REPORT_SQL,
    "op13_filter_audit": filter_audit.REPORT_SQL,
}

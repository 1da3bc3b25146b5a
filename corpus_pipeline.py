"""The corpus pipeline: toxicity, exact and near deduplication, decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; all but the last return the columns of documents. The last
adds size, source_size, target and taken, the number of words that the mix takes of a row.

Defined cases are those of the operators: a null or empty text is never toxic nor near another, null equals empty for the exact copies, null ids
stay and are never preferred, repeated rows are copies, ties go to the smaller locator, very long texts are judged whole, an empty table gives an
empty result, and further columns pass through (but names that the last stage adds replace equal ones, in any case).
"""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession

from rankloom.llm import _common, decontaminate, exact_dedup, mixing, ngram_jaccard, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.filter_documents(docs, _table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.filter_documents(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_jaccard.filter_documents(docs, k=5, num=80, den=100)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.filter_documents(docs, _table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs, keep_columns=True)


#: The tables that the last stage staged, by thread and folder: runs in two threads, or over two folders, don't touch each other's.
_own: dict[tuple[int, str], list[str]] = {}


def _stage(function):
    """The stage before has been written, so the tables that it staged can go; those of other callers stay."""

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        run = threading.get_ident(), sf_dir
        _common.release(spark, _own.pop(run, []))
        before = _common.staged(spark)
        out = function(spark, docs, sf_dir)
        _own[run] = sorted(_common.staged(spark) - before)
        return out

    return run_stage


STAGES = [
    ("toxicity", _stage(drop_toxic)),
    ("exact_dedup", _stage(drop_copies)),
    ("ngram_jaccard", _stage(drop_near_copies)),
    ("decontamination", _stage(drop_contaminated)),
    ("mixing", _stage(mix_sources)),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written as Parquet to the shared folder and read again. What the last one reads stays until `_common.release(spark)`."""
    docs = _table(spark, sf_dir, "documents")
    before: list[str] = []
    for k, (name, function) in enumerate(STAGES):
        out = function(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        path = _common.new_path(spark, f"pipeline-{name}")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        _common.release(spark, before)
        before = [path]
    return docs

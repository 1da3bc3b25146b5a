"""Audits of a suite and of a run: rules as rows of a table, evaluated together in one scan, with a sample of what breaks each; and reported metrics against recomputed ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scoring

#: (check, what breaks it). Each holds for a row by itself.
Rules = list[tuple[str, Column]]

BENCHMARKS = ("fever", "hotpotqa", "natural_questions")


def run_rules() -> Rules:
    """What a scored case of a run may not be."""
    return [
        ("benchmark_known", ~F.col("benchmark_id").isin(*BENCHMARKS)),
        ("zero_fail_closed", F.coalesce("fail_closed", F.lit(True))),
        ("joint_has_evidence", F.col("joint_correct") & ~F.coalesce("evidence_complete", F.lit(False))),
        ("joint_is_answered", F.col("joint_correct") & F.coalesce("fail_closed", F.lit(True))),
        ("precision_is_a_share", ~F.col("citation_precision").between(0, 1)),
        ("recall_is_a_share", ~F.col("citation_recall").between(0, 1)),
    ]


def suite_rules() -> Rules:
    """What a normalised case of a suite may not be."""
    return [
        ("id_present", F.coalesce(F.trim("id"), F.lit("")) == ""),
        ("query_present", F.coalesce(F.trim("query"), F.lit("")) == ""),
        ("benchmark_known", ~F.coalesce(F.col("benchmark_id").isin(*BENCHMARKS), F.lit(False))),
        ("documents_single", F.size(F.array_distinct(F.col("documents.id"))) < F.size("documents")),
        ("evidence_in_documents", F.exists("supporting_evidence", lambda e: ~F.array_contains(F.col("documents.id"), e["document_id"]))),
        ("answerable_has_evidence", (F.col("gold.answerability") == "answerable") & (F.size("supporting_evidence") == 0)),
        ("unanswerable_has_none", (F.col("gold.answerability") == "unanswerable") & (F.size("supporting_evidence") > 0)),
        ("provenance_present", ~F.coalesce(F.col("provenance.source_record_sha256").rlike("^[0-9a-f]{64}$"), F.lit(False))),
    ]


def broken(rows: DataFrame, key: str, rules: Rules, sample: int = 3) -> DataFrame:
    """(check, n, sample) of every rule, broken or not: how many rows break it, and the keys of a few of them, drawn by hash.

    One scan evaluates all rules; only rows that break one go on. A condition that is null is not broken.
    """
    codes = F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(code)) for code, bad in rules]))
    hits = rows.select(F.col(key).cast("string").alias("k"), F.explode(codes).alias("check"))
    drawn = hits.withColumn("r", F.row_number().over(Window.partitionBy("check").orderBy(F.xxhash64("k"), "k"))).where(F.col("r") <= sample)
    samples = drawn.groupBy("check").agg(F.sort_array(F.collect_list(F.struct("r", "k")))["k"].alias("sample"))  # `sample` keys a check
    counts = hits.groupBy("check").agg(F.count("*").alias("n")).join(samples, "check")
    return _all([code for code, _ in rules], counts, rows)


def _all(codes: list[str], counts: DataFrame, rows: DataFrame) -> DataFrame:
    every = rows.sparkSession.createDataFrame([(c,) for c in codes], "check string")
    return every.join(counts, "check", "left").select("check", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.coalesce("sample", F.array().cast("array<string>")).alias("sample"))


def repeated(rows: DataFrame, key: str, check: str = "ids_unique", sample: int = 3) -> DataFrame:
    """(check, n, sample): keys that stand more than once."""
    more = rows.groupBy(F.col(key).cast("string").alias("k")).agg(F.count("*").alias("c")).where("c > 1")
    first = more.orderBy("k").limit(sample).agg(F.sort_array(F.collect_list("k")).alias("sample"))
    return more.agg(F.count("*").alias("n")).crossJoin(F.broadcast(first)).select(F.lit(check).alias("check"), "n", "sample")  # one row each


def miscounted(rows: DataFrame, targets: DataFrame, by: str = "benchmark_id", check: str = "counts_exact") -> DataFrame:
    """(check, n, sample): groups whose number of rows is not the target's (by, target); a group on one side only counts too."""
    have = rows.groupBy(by).agg(F.count("*").alias("have"))
    off = have.join(targets.select(by, "target"), by, "full_outer").where(~F.col("have").eqNullSafe(F.col("target").cast("long")))
    return off.agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.col(by).cast("string"))).alias("sample")).select(F.lit(check).alias("check"), "n", "sample")  # a row a group


def by_metric(aggregates: DataFrame) -> DataFrame:
    """(benchmark_id, metric, value) of aggregates with a column a metric."""
    names = [c for c in aggregates.columns if c != "benchmark_id"]
    wide = aggregates.select("benchmark_id", *[F.col(c).cast("double").alias(c) for c in names])
    return wide.unpivot("benchmark_id", names, "metric", "value")


def differing(reported: DataFrame, recomputed: DataFrame, slack: float = 1e-9, check: str = "metrics_recompute") -> DataFrame:
    """(check, n, sample): metrics (benchmark_id, metric, value) that a report has otherwise than the rows give them, or that one side lacks."""
    side = lambda r, v: r.select("benchmark_id", "metric", F.col("value").alias(v), F.lit(True).alias(f"has_{v}"))
    both = side(reported, "a").join(side(recomputed, "b"), ["benchmark_id", "metric"], "full_outer")
    same = F.col("has_a") & F.col("has_b") & (F.col("a").eqNullSafe(F.col("b")) | F.coalesce(F.abs(F.col("a") - F.col("b")) <= slack, F.lit(False)))
    off = both.where(~F.coalesce(same, F.lit(False)))
    return off.agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.concat_ws(": ", "benchmark_id", "metric"))).alias("sample")).select(F.lit(check).alias("check"), "n", "sample")  # a row a metric


def run_audit(cases: DataFrame, reported: DataFrame, targets: DataFrame, macro_floor: float = 0.60) -> DataFrame:
    """(check, n, sample, ok) of a run's scored cases against its report (benchmark_id, metric, value) and the suite's targets (benchmark_id, target): each case by itself, ids, counts, all metrics
    computed again, and the macro rate."""
    again = scoring.aggregate(cases)
    low = again.where((F.col("benchmark_id") == "macro") & ~F.coalesce(F.col("joint_correct") >= macro_floor, F.lit(False)))
    gate = low.agg(F.count("*").alias("n")).select(F.lit("macro_gate").alias("check"), "n", F.array().cast("array<string>").alias("sample"))
    parts = [broken(cases, "case_id", run_rules()), repeated(cases, "case_id"), miscounted(cases, targets), differing(reported, by_metric(again)), gate]
    return _checked(parts)


def suite_audit(cases: DataFrame, targets: DataFrame) -> DataFrame:
    """(check, n, sample, ok) of a suite's normalised cases."""
    return _checked([broken(cases, "id", suite_rules()), repeated(cases, "id"), miscounted(cases, targets)])


def _checked(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("ok", F.col("n") == 0)

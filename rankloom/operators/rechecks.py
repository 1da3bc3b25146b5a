"""Results that are checked again: each round is a version, whose changes (old, new, reason) are kept, so any version can be made from the first.

A round's proposals meet the results in one join by case; only what differs is written to the log. A version is the first results with, for each case, its last change up to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lifecycle import ensure

#: What a result is, beside its case.
VALUE = ("prediction", "citation_ids")


def _value(prefix: str = "") -> Column:
    return F.struct(*[F.col(prefix + c).alias(c) for c in VALUE])


def keeps_citations(before: Column, after: Column) -> Column:
    """Whether a proposal adds citations only: nothing that was cited is taken away, the prediction stays."""
    return before["prediction"].eqNullSafe(after["prediction"]) & (F.size(F.array_except(before["citation_ids"], after["citation_ids"])) == 0)


def changes(results: DataFrame, proposals: DataFrame, version: int, allowed=None) -> DataFrame:
    """The log rows (version, case_id, before, after, reason) of a round.

    results: (case_id, prediction, citation_ids); proposals: the same with valid and reason, at most one a case. Proposals that are not valid, say what stands already, or that `allowed` (of before and
    after) forbids, change nothing; one for a case without a result is an error.
    """
    rows = proposals.where("valid").select("case_id", "reason", _value().alias("after")).join(results.select("case_id", _value().alias("before")), "case_id", "left")
    rows = ensure(rows, F.col("before").isNotNull(), "a proposal for a case without a result").where(~F.col("before").eqNullSafe(F.col("after")))
    rows = rows if allowed is None else rows.where(allowed(F.col("before"), F.col("after")))
    return rows.select(F.lit(version).alias("version"), "case_id", "before", "after", "reason")


def replayed(first: DataFrame, log: DataFrame, version: int | None = None) -> DataFrame:
    """(case_id, prediction, citation_ids, version): the results as they were after a version (unset: the last); version 0 is the first."""
    upto = log if version is None else log.where(F.col("version") <= version)
    last = upto.groupBy("case_id").agg(F.max_by("after", "version").alias("now"), F.max("version").alias("version"))
    rows = first.select("case_id", _value().alias("own")).join(last, "case_id", "left").withColumn("now", F.coalesce("now", "own"))
    return rows.select("case_id", *[F.col(f"now.{c}").alias(c) for c in VALUE], F.coalesce("version", F.lit(0)).alias("version"))


def log_faults(first: DataFrame, log: DataFrame) -> DataFrame:
    """(case_id, version) of changes whose `before` is not what the change before it, or the first result, left."""
    start = first.select("case_id", F.lit(0).alias("version"), _value().alias("after"), F.lit(None).cast(log.schema["before"].dataType).alias("before"))
    steps = start.unionByName(log.select("case_id", "version", "after", "before"))
    own = F.sort_array(F.collect_list(F.struct("version", "before", "after")))  # a case's changes, one a round
    broken = F.filter(F.transform(F.col("s"), lambda x, i: F.struct(x["version"].alias("version"), ((i > 0) & ~x["before"].eqNullSafe(F.get("s", i - 1)["after"])).alias("bad"))), lambda x: x["bad"])
    return steps.groupBy("case_id").agg(own.alias("s")).select("case_id", F.explode(broken).alias("b")).select("case_id", "b.version")

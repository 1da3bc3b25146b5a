"""Structured cases: what a ranking covers of gold headings and claims, citation policies, evidence retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats


def claim_coverage(claims: DataFrame, ranking: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """(k, case_id, claim_coverage, complete): a claim (case_id, claim_id, heading) is covered when all its headings are among the first k of (case_id, heading, rank)."""
    got = claims.distinct().join(ranking.groupBy("case_id", "heading").agg(F.min("rank").alias("rank")), ["case_id", "heading"], "left")
    k = F.explode(F.array(*[F.lit(x) for x in ks])).alias("k")
    claim = got.select("case_id", "claim_id", F.coalesce(F.col("rank"), F.lit(1 << 30)).alias("rank"), k).groupBy("k", "case_id", "claim_id").agg(F.bool_and(F.col("rank") <= F.col("k")).alias("covered"))
    return claim.groupBy("k", "case_id").agg(F.avg(F.col("covered").cast("double")).alias("claim_coverage"), F.bool_and("covered").alias("complete"))


def distinct_prefix(ranking: DataFrame, k: int) -> DataFrame:
    """(query_id, raw_needed): how many raw hits hold k distinct headings; null if there are fewer."""
    w = Window.partitionBy("query_id").orderBy("rank")
    first = F.row_number().over(Window.partitionBy("query_id", "heading").orderBy("rank")) == 1
    rows = ranking.withColumn("first", first.cast("int")).withColumn("seen", F.sum("first").over(w))
    return rows.groupBy("query_id").agg(F.min(F.when(F.col("seen") >= k, F.col("rank"))).alias("raw_needed"))


def agreement_union(primary: DataFrame, other: DataFrame) -> DataFrame:
    """(case_id, answer, citations): the primary run's, with the other run's citations added where both answer alike."""
    both = primary.select("case_id", "answer", "citations").join(other.select("case_id", F.col("answer").alias("o"), F.col("citations").alias("oc")), "case_id", "left")
    return both.select("case_id", "answer", F.when(F.col("answer").eqNullSafe(F.col("o")), F.array_union("citations", F.coalesce("oc", F.array().cast("array<string>")))).otherwise(F.col("citations")).alias("citations"))


def best_pair(scored: DataFrame) -> DataFrame:
    """(case_id, left, right, score): of each case's documents (case_id, document_id, position, score) the two whose scores sum highest; ties to earlier positions.

    The two come from a top-2: no pairs are made.
    """
    w = Window.partitionBy("case_id").orderBy(F.desc("score"), "position")
    two = scored.withColumn("r", F.row_number().over(w)).where("r <= 2")
    pair = F.sort_array(F.collect_list(F.struct("position", "document_id")))
    rows = two.groupBy("case_id").agg(pair.alias("p"), F.sum("score").alias("score")).where(F.size("p") == 2)
    return rows.select("case_id", F.get("p", F.lit(0))["document_id"].alias("left"), F.get("p", F.lit(1))["document_id"].alias("right"), "score")


def abstain_below(rows: DataFrame, score: Column, threshold: float, sentinel: str) -> DataFrame:
    """Predictions under the threshold, or without a score, become the sentinel and lose their citations."""
    low = F.coalesce(score < threshold, F.lit(True))
    return rows.withColumn("prediction", F.when(low, sentinel).otherwise(F.col("prediction"))).withColumn("citations", F.when(low, F.array().cast("array<string>")).otherwise(F.col("citations")))


#: The labels of a fact check, as everywhere else.
SUPPORTS, REFUTES, NO_INFO = "supports", "refutes", "not_enough_info"


def nli_decision(rows: DataFrame, least: float = 0.75, ratio: float = 20.0) -> DataFrame:
    """(case_id, label, citations) of sentence scores (case_id, document_id, entail, contradict): the stronger side if it reaches `least`, citing what is within a factor of its best."""
    best = rows.groupBy("case_id").agg(F.max("entail").alias("e"), F.max("contradict").alias("c"))
    side = F.when(F.greatest("e", "c") < least, NO_INFO).when(F.col("e") >= F.col("c"), SUPPORTS).otherwise(REFUTES)
    joined = rows.join(best.withColumn("label", side), "case_id")
    own = F.when(F.col("label") == SUPPORTS, F.col("entail")).when(F.col("label") == REFUTES, F.col("contradict"))
    cite = F.when(own >= F.greatest("e", "c") / ratio, F.col("document_id"))
    return joined.groupBy("case_id", "label").agg(F.array_sort(F.collect_set(cite)).alias("citations"))


def retention(spans: DataFrame, contexts: DataFrame) -> DataFrame:
    """(n, any_retained, complete_retained) of gold spans (case_id, evidence_set, text) in compressed contexts (case_id, context): a set is retained when all its spans stand in the context."""
    held = spans.join(contexts, "case_id", "left").groupBy("case_id", "evidence_set").agg(F.bool_or(F.coalesce(F.col("context").contains(F.col("text")), F.lit(False))).alias("some"), F.bool_and(F.coalesce(F.col("context").contains(F.col("text")), F.lit(False))).alias("whole"))
    case = held.groupBy("case_id").agg(F.bool_or("some").alias("some"), F.bool_or("whole").alias("whole"))
    return case.agg(F.count("*").alias("n"), stats.rate(F.count_if("some"), F.count("*")).alias("any_retained"), stats.rate(F.count_if("whole"), F.count("*")).alias("complete_retained"))


def last_valid_attempt(attempts: DataFrame) -> DataFrame:
    """Of each custom id's attempts (custom_id, attempt, valid, output) the last valid one, else the last."""
    return attempts.groupBy("custom_id").agg(F.max_by(F.struct(*attempts.columns), F.struct("valid", "attempt")).alias("row")).select("row.*")

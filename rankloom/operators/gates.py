"""Gates: whether a candidate may take a baseline's place. Reports meet as small (metric, value) tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import stats
from . import metrics

ORDER = ("PROMOTE", "NEEDS_REVIEW", "REJECT")
#: Float slack, what a macro rate must gain, and what a benchmark may lose.
SLACK, MACRO_GAIN, JOINT_LOSS, PRECISION_LOSS = 1e-12, 0.01, 0.02, 0.03
#: The least exact match and F1 of a reader.
READER_LEAST = 0.85
#: The lanes whose cases may not be lost.
HARD_RETRIEVAL = ("all_recall", "evidence_recall")


def same_identity(baseline: dict, candidate: dict, fields: tuple[str, ...]) -> None:
    """Two reports may be compared only if they agree on these fields."""
    apart = [f for f in fields if baseline.get(f) != candidate.get(f)]
    if apart:
        raise ValueError(f"the reports differ in {', '.join(apart)}")


def verdicts(baseline: DataFrame, candidate: DataFrame, tolerance: Column, hard: tuple[str, ...] = (), digits: int | None = None) -> DataFrame:
    """(metric, baseline, candidate, delta, decision) for each metric that the baseline has: a fall within the tolerance (a column, of `metric` if need be) is fine; beyond it a hard metric
    rejects, a soft one needs review up to twice the tolerance and rejects beyond; a metric that is missing rejects."""
    both = baseline.where("value IS NOT NULL").select("metric", F.col("value").alias("baseline")).join(candidate.select("metric", F.col("value").alias("candidate")), "metric", "left")
    delta = F.col("candidate") - F.col("baseline")
    both = both.withColumn("delta", delta if digits is None else F.round(delta, digits)).withColumn("__t", tolerance)
    strict = F.col("metric").isin(*hard) if hard else F.lit(False)
    d, t = F.col("delta"), F.col("__t")
    decision = F.when(F.col("candidate").isNull(), ORDER[2]).when(d >= -t, ORDER[0]).when(strict, ORDER[2]).when(d >= -2 * t, ORDER[1]).otherwise(ORDER[2])
    return both.withColumn("decision", decision).drop("__t")


def worst(decisions: DataFrame) -> DataFrame:
    """(decision): the worst of all; without any, nothing speaks against it."""
    rank = F.array_position(F.array(*map(F.lit, ORDER)), F.col("decision"))
    return decisions.agg(F.coalesce(F.max(rank), F.lit(1)).alias("r")).select(F.element_at(F.array(*map(F.lit, ORDER)), F.col("r").cast("int")).alias("decision"))


def golden_gate(baseline: DataFrame, candidate: DataFrame, n_answerable: int | None, n: int | None, hard: tuple[str, ...], tolerance: float = 0.05) -> DataFrame:
    """The gate of the golden set: one case and a half of a metric's lane is always within the tolerance; `abstention` has the lane of the other cases."""
    lane = {True: (n - n_answerable) if n and n_answerable else None, False: n_answerable}
    width = {k: max(tolerance, 1.5 / v) if v else tolerance for k, v in lane.items()}
    return verdicts(baseline, candidate, F.when(F.col("metric") == "abstention", width[True]).otherwise(width[False]), hard, digits=3)


def retrieval_gate(baseline: DataFrame, candidate: DataFrame, tolerance: float = 0.005) -> DataFrame:
    """The gate of retrieval runs; both must have every metric."""
    out = verdicts(baseline, candidate, F.lit(tolerance), HARD_RETRIEVAL)
    return out.where(F.when(F.col("candidate").isNotNull(), F.lit(True)).otherwise(F.raise_error(F.lit("a metric is missing"))))


def structured_gate(baseline: DataFrame, candidate: DataFrame, hard: dict[str, str], safety: tuple[str, ...], eligible: bool) -> DataFrame:
    """(decision, wins, losses, unchanged, reasons) of two structured runs (id, lane, case_pass, action_correct, and the columns of `hard`, a metric's name to its column).

    The runs must have the same cases. A safety lane that loses passes or right actions rejects, and so does a hard mean that falls.
    """
    cols = ["case_pass", "action_correct", *hard.values()]
    left, right = (r.select(F.col("id").alias("id"), F.col("lane").alias(f"{p}lane"), *[F.col(c).cast("double").alias(p + c) for c in dict.fromkeys(cols)]) for r, p in ((baseline, "b_"), (candidate, "c_")))
    both = left.join(right, "id", "full_outer").where(F.when(F.col("b_lane").eqNullSafe(F.col("c_lane")), F.lit(True)).otherwise(F.raise_error(F.lit("the runs' cases or lanes differ"))))
    fell = lambda c, lane: F.sum(F.when(F.col("b_lane") == lane, F.coalesce("c_" + c, F.lit(0.0)) - F.coalesce("b_" + c, F.lit(0.0)))) < 0
    reasons = [F.when(fell(c, lane), F.lit(f"{lane}: {c}")) for lane in safety for c in ("case_pass", "action_correct")]
    reasons += [F.when(F.round(F.avg("c_" + c) - F.avg("b_" + c), 6) < 0, F.lit(m)) for m, c in hard.items()]
    got = both.agg(F.count_if((F.col("b_case_pass") == 0) & (F.col("c_case_pass") == 1)).alias("wins"), F.count_if((F.col("b_case_pass") == 1) & (F.col("c_case_pass") == 0)).alias("losses"), F.count("*").alias("n"), F.array_compact(F.array(*reasons)).alias("reasons"))
    decision = F.when(F.size("reasons") > 0, "REJECT").otherwise("PROMOTE" if eligible else "DEVELOPMENT_REVIEW")
    return got.select(decision.alias("decision"), "wins", "losses", (F.col("n") - F.col("wins") - F.col("losses")).alias("unchanged"), "reasons")


def paired_by_benchmark(baseline: DataFrame, candidate: DataFrame, ok: str = "joint_correct") -> DataFrame:
    """(benchmark_id, wins, losses, unchanged, p_value) of two runs (case_id, benchmark_id, ok), and a row `all`; the runs must have the same cases."""
    left, right = baseline.select("case_id", "benchmark_id", F.col(ok).alias("l")), candidate.select("case_id", F.col(ok).alias("r"))
    both = left.join(right, "case_id", "full_outer").where(F.when(F.col("l").isNotNull() & F.col("r").isNotNull(), F.lit(True)).otherwise(F.raise_error(F.lit("the runs' cases differ"))))
    both = both.withColumn("benchmark_id", F.explode(F.array("benchmark_id", F.lit("all"))))
    got = both.groupBy("benchmark_id").agg(F.count("*").alias("n"), F.count_if(F.col("r") & ~F.col("l")).alias("wins"), F.count_if(F.col("l") & ~F.col("r")).alias("losses"))
    return got.select("benchmark_id", "wins", "losses", (F.col("n") - F.col("wins") - F.col("losses")).alias("unchanged"), stats.mcnemar_p(F.col("wins"), F.col("losses")).alias("p_value"))


def end_to_end_gate(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """(decision, macro_delta, reasons) of two aggregates (see `scoring.aggregate`): the macro joint rate must gain MACRO_GAIN, no benchmark may lose JOINT_LOSS of its joint rate or PRECISION_LOSS of
    its citation precision, and no more cases may fail closed."""
    side = lambda r, p: r.select("benchmark_id", *[F.col(c).alias(p + c) for c in ("joint_correct", "citation_precision", "fail_closed_count")])
    both = side(baseline, "b_").join(side(candidate, "c_"), "benchmark_id")
    rise = lambda c: F.col("c_" + c) - F.col("b_" + c)
    single = F.col("benchmark_id") != "macro"
    lost = lambda c, by: F.collect_set(F.when(single & (rise(c) < -by - SLACK), F.concat("benchmark_id", F.lit(f": {c}"))))
    macro = F.max(F.when(~single, rise("joint_correct")))
    got = both.agg(macro.alias("macro_delta"), lost("joint_correct", JOINT_LOSS).alias("j"), lost("citation_precision", PRECISION_LOSS).alias("p"), F.sum(F.when(single, rise("fail_closed_count"))).alias("f"))
    rest = F.array_compact(F.array(F.when(F.col("f") > 0, "fail_closed"), F.when(~F.coalesce(F.col("macro_delta") >= MACRO_GAIN - SLACK, F.lit(False)), "macro: joint_correct")))
    got = got.withColumn("reasons", F.array_sort(F.concat("j", "p", rest)))
    return got.select(F.when(F.size("reasons") > 0, "REJECT").otherwise("PROMOTE").alias("decision"), "macro_delta", "reasons")


def reader_gate(rows: DataFrame) -> DataFrame:
    """(passes, exact, f1) of scored cases (answer_exact_match, answer_f1, fail_closed): both means at READER_LEAST, and none failed closed."""
    got = rows.agg(F.avg("answer_exact_match").alias("exact"), F.avg("answer_f1").alias("f1"), F.count_if("fail_closed").alias("failed"))
    ok = (F.col("exact") >= READER_LEAST) & (F.col("f1") >= READER_LEAST) & (F.col("failed") == 0)
    return got.select(F.coalesce(ok, F.lit(False)).alias("passes"), "exact", "f1")


def reproducible(expected: DataFrame, actual: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """(metric, expected, actual, ok): whether each metric comes out as before, within the tolerance."""
    both = expected.select("metric", F.col("value").alias("expected")).join(actual.select("metric", F.col("value").alias("actual")), "metric", "left")
    return both.withColumn("ok", F.coalesce(F.abs(F.col("actual") - F.col("expected")) <= tolerance, F.lit(False)))


def service_parity(offline: DataFrame, service: DataFrame, expected: DataFrame) -> DataFrame:
    """(question, ok): whether a question's ids (question, ids) are the same in order offline, in the service and as expected."""
    rows = expected.select("question", F.col("ids").alias("e")).join(offline.select("question", F.col("ids").alias("o")), "question", "left").join(service.select("question", F.col("ids").alias("s")), "question", "left")
    return rows.select("question", (F.col("e").eqNullSafe(F.col("o")) & F.col("e").eqNullSafe(F.col("s"))).alias("ok"))


def promoted_on_window(selected: DataFrame, baseline: DataFrame, development: DataFrame, most: float = 0.05) -> DataFrame:
    """(promote, wins, losses, p_value): on cases (case_id, joint_correct, fail_closed) that share none with the development window, more wins than losses, a p of at most `most`, nothing failed closed."""
    seen = selected.join(development.select("case_id"), "case_id", "left_semi").agg(F.count("*").alias("shared"))
    t = metrics.transitions(baseline.select("case_id", "joint_correct"), selected.select("case_id", "joint_correct"), "case_id", "joint_correct")
    failed = selected.agg(F.count_if("fail_closed").alias("failed"))
    rows = t.crossJoin(F.broadcast(seen)).crossJoin(F.broadcast(failed))  # one row each
    rows = rows.where(F.when(F.col("shared") == 0, F.lit(True)).otherwise(F.raise_error(F.lit("the windows share cases"))))
    return rows.select(((F.col("wins") > F.col("losses")) & (F.col("p_value") <= most) & (F.col("failed") == 0)).alias("promote"), "wins", "losses", "p_value")

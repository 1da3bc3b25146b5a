"""Retrieval, answer and citation metrics."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import stats
from ..functions.text import SENTINEL, casefold, normalize_answer
from ..staging import staged

def running(by: DataFrame, key: Column, sums: list[str], group: list[str] | None = None) -> DataFrame:
    """`by`, a row for each distinct key (and group), with the running sums up to and with each row as `upto_*`: sorted by ranges, whose totals are added up apart, so
    no task holds all keys."""
    group = group or []
    # as many ranges as the input's size asks for: adaptive execution merges small ones
    rows = staged(by.withColumn("__k", key).repartitionByRange(*group, "__k").withColumn("__p", F.spark_partition_id()), "ranges")
    before = Window.partitionBy(*group).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*group, "__p").agg(*[F.sum(c).alias(f"__{c}") for c in sums])  # a row a range and group
    starts = totals.select(*group, "__p", *[F.coalesce(F.sum(f"__{c}").over(before), F.lit(0)).alias(f"__{c}") for c in sums])
    within = Window.partitionBy(*group, "__p").orderBy("__k").rowsBetween(Window.unboundedPreceding, 0)
    starts = starts.select(*[F.col(g).alias(f"__g{i}") for i, g in enumerate(group)], F.col("__p").alias("__range"), *[f"__{c}" for c in sums])
    out = rows.select("*", *[F.sum(c).over(within).alias(f"upto_{c}") for c in sums]).join(starts, _same(group))
    return out.select(*by.columns, *[(F.col(f"upto_{c}") + F.col(f"__{c}")).alias(f"upto_{c}") for c in sums])


def numbered(rows: DataFrame, order: Column, name: str, group: list[str] | None = None) -> DataFrame:
    """The rows with their place in an order (within a group), from 0, as a running count over ranges: no task holds the whole order."""
    out = running(rows.withColumn("__one", F.lit(1)), order, ["__one"], group)
    return out.withColumn(name, F.col("upto___one") - 1).drop("__one", "upto___one")


def _same(group: list[str]) -> Column:
    on = F.col("__p") == F.col("__range")
    for i, g in enumerate(group):
        on = on & F.col(g).eqNullSafe(F.col(f"__g{i}"))
    return on


def retrieval_at_k(ranking: DataFrame, gold: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """(k, n, any_recall, all_recall, evidence_recall, mrr) over queries with gold. Gold: (query_id, doc_id)."""
    hits = gold.distinct().join(ranking.select("query_id", "doc_id", "rank"), ["query_id", "doc_id"], "left")
    k = F.explode(F.array(*[F.lit(x) for x in ks])).alias("k")
    found = F.col("rank") <= F.col("k")
    case = hits.select("query_id", "rank", k).groupBy("k", "query_id").agg(F.count_if(found).alias("hits"), F.count("*").alias("gold"), F.min(F.when(found, F.col("rank"))).alias("first"))
    return case.groupBy("k").agg(
        F.count("*").alias("n"), F.avg((F.col("hits") > 0).cast("double")).alias("any_recall"), F.avg((F.col("hits") == F.col("gold")).cast("double")).alias("all_recall"),
        F.avg(F.col("hits") / F.col("gold")).alias("evidence_recall"), F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))).alias("mrr"),
    )


def retrieval_of_marked(ranking: DataFrame, gold: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """As `retrieval_at_k`, of rankings (query_id, rank, relevant) and gold counts (query_id, gold): for gold sets that would be too large as rows."""
    k = F.explode(F.array(*[F.lit(x) for x in ks])).alias("k")
    good = ranking.where("relevant").select("query_id", "rank", k).where("rank <= k").groupBy("k", "query_id").agg(F.count("*").alias("hits"), F.min("rank").alias("first"))
    case = gold.where("gold > 0").select("query_id", "gold", k).join(good, ["k", "query_id"], "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
    return case.groupBy("k").agg(
        F.count("*").alias("n"), F.avg((F.col("hits") > 0).cast("double")).alias("any_recall"), F.avg((F.col("hits") == F.col("gold")).cast("double")).alias("all_recall"),
        F.avg(F.col("hits") / F.col("gold")).alias("evidence_recall"), F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))).alias("mrr"),
    )


@F.pandas_udf(T.IntegerType())
def counted_overlap(p: pd.Series, g: pd.Series) -> pd.Series:
    """How many words two arrays share as multisets: each pair by one count of its words (column functions have no map that counts)."""
    return pd.Series([sum((Counter(x) & Counter(y)).values()) for x, y in zip(p, g, strict=True)], dtype="int32")


def answer_scores(rows: DataFrame, prediction: str, golds: str, keys: list[str]) -> DataFrame:
    """(*keys, exact, f1): the best of a prediction's scores over an array of gold answers, by normalised words as multisets. Without golds both are 1 for the
    sentinel and else 0.

    Words are counted by key, so a long text costs its words and not their square.
    """
    some = rows.select(*keys, F.coalesce(prediction, F.lit("")).alias("__p"), F.explode_outer(golds).alias("__g"), F.coalesce(F.size(golds), F.lit(0)).alias("__n"))
    some = some.select(*keys, "__n", "__p", normalize_answer(F.col("__p")).alias("p"), normalize_answer(F.col("__g")).alias("g"))
    words = lambda c: F.filter(F.split(c, " "), lambda w: w != "")
    some = some.withColumn("pw", words(F.col("p"))).withColumn("gw", words(F.col("g")))
    p, g = F.size("pw"), F.size("gw")
    common = counted_overlap(F.col("pw"), F.col("gw"))
    f1 = F.when((p == 0) | (g == 0), (p == g).cast("double")).when(common == 0, 0.0).otherwise(2.0 * common / (p + g))
    sentinel = (casefold(F.regexp_replace("__p", r"(?U)^\s+|\s+$", "")) == SENTINEL.casefold()).cast("double")
    some = some.select(*keys, F.when(F.col("__n") > 0, (F.col("p") == F.col("g")).cast("double")).otherwise(sentinel).alias("e"), F.when(F.col("__n") > 0, f1).otherwise(sentinel).alias("f"))
    return some.groupBy(*keys).agg(F.max("e").alias("exact"), F.max("f").alias("f1"))


def citation_metrics(cited: Column, gold: Column) -> tuple[Column, Column]:
    """Precision (null without citations) and recall (null without gold) of two id arrays."""
    both = F.size(F.array_intersect(cited, gold))
    return stats.rate(both, F.size(F.array_distinct(cited))), stats.rate(both, F.size(F.array_distinct(gold)))


def subset(inner: Column, outer: Column) -> Column:
    return F.size(F.array_except(inner, outer)) == 0


def any_set_complete(sets: Column, cited: Column) -> Column:
    """Whether one of several evidence sets is cited whole."""
    return F.exists(sets, lambda s: F.size(F.array_except(s, cited)) == 0)


def auc(rows: DataFrame, score: str, positive: Column) -> DataFrame:
    """(auc): the share of (positive, negative) pairs in order, ties half, by sums over distinct scores: no pairs are made. Null without both kinds."""
    by = rows.where(F.col(score).isNotNull()).groupBy(F.col(score).alias("s")).agg(F.count_if(positive).alias("p"), F.count_if(~positive).alias("q"))
    run = running(by, F.col("s"), ["q"])
    parts = run.select("p", "q", (F.col("p") * (F.col("upto_q") - F.col("q") / 2.0)).alias("won"))
    return parts.agg(stats.rate(F.sum("won"), F.sum("p") * F.sum("q")).alias("auc"))


def risk_coverage(rows: DataFrame, score: str, answerable: Column, one_kind: bool = False) -> DataFrame:
    """One row a threshold: null (nothing answered) and each distinct score. Answered rows and their share, the share of them that no answer exists for
    (selective risk, 0 if none is answered), false answers and refusals with rates and 95 % intervals. Rows of one kind only are an error; if `one_kind`, they
    are not, and a rate over no rows is NaN, its interval NaN to 1."""
    by = rows.groupBy(F.col(score).alias("threshold")).agg(F.count("*").alias("n"), F.count_if(answerable).alias("a"))
    run = running(by, -F.col("threshold"), ["n", "a"]).select(F.col("threshold").cast("double").alias("threshold"), F.col("upto_n").alias("n"), F.col("upto_a").alias("a"))
    total = staged(rows.agg(F.count("*").alias("tn"), F.count_if(answerable).alias("ta")), "totals")
    none = total.select(F.lit(None).cast("double").alias("threshold"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("a"))
    both = (F.col("ta") > 0) & (F.col("tn") > F.col("ta"))
    out = run.unionByName(none).crossJoin(F.broadcast(total))  # one row
    if not one_kind:
        out = out.where(F.when(both, F.lit(True)).otherwise(F.raise_error(F.lit("answerable and unanswerable rows are needed"))))
    wrong, refused, bad = F.col("n") - F.col("a"), F.col("ta") - F.col("a"), F.col("tn") - F.col("ta")
    (a_low, a_high), (r_low, r_high) = stats.wilson(wrong, bad), stats.wilson(refused, F.col("ta"))
    known = lambda value, empty=float("nan"): F.coalesce(value, F.lit(empty))
    return out.select(
        "threshold", F.col("n").alias("answered_cases"), known(stats.rate(F.col("n"), F.col("tn"))).alias("coverage"), known(stats.rate(wrong, F.col("n")), 0.0).alias("selective_risk"),
        wrong.alias("false_answer_count"), known(stats.rate(wrong, bad)).alias("false_answer_rate"), known(a_low).alias("false_answer_low"), known(a_high, 1.0).alias("false_answer_high"),
        refused.alias("false_refusal_count"), known(stats.rate(refused, F.col("ta"))).alias("false_refusal_rate"), known(r_low).alias("false_refusal_low"), known(r_high, 1.0).alias("false_refusal_high"),
    )


def operating_point(curve: DataFrame, max_false_answer_rate: float, max_false_refusal_rate: float) -> DataFrame:
    """The feasible row with the largest coverage; ties to the smaller false answer rate, then the higher threshold, null the highest. None, if no row is feasible."""
    ok = curve.where((F.col("false_answer_rate") <= max_false_answer_rate) & (F.col("false_refusal_rate") <= max_false_refusal_rate))
    return ok.orderBy(F.desc("coverage"), "false_answer_rate", F.desc_nulls_first("threshold")).limit(1)


def macro(rows: DataFrame, group: str, metrics: list[str]) -> DataFrame:
    """Means by group and `macro`, the plain mean of these, and `micro`, over all rows. Nulls are left out of means."""
    by = rows.groupBy(F.col(group).alias("slice")).agg(*[F.avg(m).alias(m) for m in metrics])
    top = by.agg(*[F.avg(m).alias(m) for m in metrics]).select(F.lit("macro").alias("slice"), *metrics)
    micro = rows.agg(*[F.avg(m).alias(m) for m in metrics]).select(F.lit("micro").alias("slice"), *metrics)
    return by.unionByName(top).unionByName(micro)


def nearest_rank_percentiles(rows: DataFrame, value: str, fractions: tuple[float, ...], by: list[str] | None = None) -> DataFrame:
    """([by,] fraction, value): the element at round((n - 1) * fraction), halves to even. Ranks are found by counts over distinct values."""
    by = by or []
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("v")).agg(F.count("*").alias("n"))
    run = running(counts, F.col("v"), ["n"], by or None)
    total = rows.groupBy(*by).agg(F.count(value).alias("total"))
    want = total.select(*by, F.explode(F.array(*[F.lit(float(f)) for f in fractions])).alias("fraction"), "total").withColumn("at", F.bround((F.col("total") - 1) * F.col("fraction"), 0).cast("long"))
    here = (F.col("at") >= F.col("upto_n") - F.col("n")) & (F.col("at") < F.col("upto_n"))
    both = run.join(want, by).where(here) if by else run.join(F.broadcast(want), here)  # a row a fraction
    return both.select(*by, "fraction", F.col("v").alias("value"))


def linear_percentiles(rows: DataFrame, value: str, fractions: tuple[float, ...], by: list[str]) -> DataFrame:
    """(*by, fraction, value): interpolated between the two elements round (n - 1) * fraction, in each group."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("v")).agg(F.count("*").alias("n"))
    run = running(counts, F.col("v"), ["n"], by)
    total = rows.groupBy(*by).agg(F.count(value).alias("total"))
    at = (F.col("total") - 1) * F.col("fraction")
    both = run.join(total, by).withColumn("fraction", F.explode(F.array(*[F.lit(float(f)) for f in fractions]))).withColumn("low", F.floor(at)).withColumn("high", F.ceil(at))
    holds = lambda place: (F.col(place) >= F.col("upto_n") - F.col("n")) & (F.col(place) < F.col("upto_n"))
    ends = both.where(holds("low") | holds("high")).groupBy(*by, "fraction", (at - F.col("low")).alias("share"))
    ends = ends.agg(F.max(F.when(holds("low"), F.col("v"))).alias("a"), F.max(F.when(holds("high"), F.col("v"))).alias("b"))
    return ends.select(*by, "fraction", (F.col("a") + F.col("share") * (F.col("b") - F.col("a"))).alias("value"))


def transitions(left: DataFrame, right: DataFrame, key: str, ok: str) -> DataFrame:
    """(n, wins, losses, unchanged, p) of two runs over the same keys; a key in one run only is an error."""
    both = left.select(F.col(key).alias("k"), F.col(ok).alias("l")).join(right.select(F.col(key).alias("k"), F.col(ok).alias("r")), "k", "full_outer")
    gap = F.assert_true(F.col("l").isNotNull() & F.col("r").isNotNull(), F.lit("the runs' keys differ"))
    both = both.withColumn("gap", gap).where(F.col("gap").isNull())
    counts = both.agg(F.count("*").alias("n"), F.count_if(F.col("r") & ~F.col("l")).alias("wins"), F.count_if(F.col("l") & ~F.col("r")).alias("losses"))
    return counts.select("n", "wins", "losses", (F.col("n") - F.col("wins") - F.col("losses")).alias("unchanged"), stats.mcnemar_p(F.col("wins"), F.col("losses")).alias("p_value"))

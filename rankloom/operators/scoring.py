"""End-to-end scoring of cases: work items, fail-closed results, answers and evidence, means by benchmark and over benchmarks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import stats
from ..functions.text import SENTINEL, casefold, composed, normalize_answer
from . import metrics

#: The label of an abstention, and the benchmarks with rules of their own.
NO_INFO, FEVER, NQ = "not_enough_info", "fever", "natural_questions"
_IDS = "array<string>"


def expected_action(answerability: Column, reason: Column) -> Column:
    """What a case calls for: an answer, or the abstention that its reason names."""
    return F.when(answerability == "answerable", "answer").otherwise(reason)


def evaluation_id(benchmark: Column, document_id: Column, title: Column) -> Column:
    """The id that evidence is compared by: FEVER's pages go by their composed titles."""
    return F.when(benchmark == FEVER, composed(F.replace(title, F.lit(" "), F.lit("_")))).otherwise(document_id)


def gold_sets(votes: DataFrame) -> DataFrame:
    """(case_id, gold_evidence_sets) of (case_id, vote, document_id): the distinct sets of documents that single votes name, in order of votes."""
    sets = votes.where("document_id IS NOT NULL").groupBy("case_id", "vote").agg(F.array_sort(F.collect_set("document_id")).alias("s"))
    first = sets.groupBy("case_id", "s").agg(F.min("vote").alias("vote"))
    return first.groupBy("case_id").agg(F.sort_array(F.collect_list(F.struct("vote", "s")))["s"].alias("gold_evidence_sets"))


def work_items(cases: DataFrame, ranked: DataFrame, support: DataFrame, votes: DataFrame) -> DataFrame:
    """Cases (case_id, benchmark_id, query, answers, label, answerability) with their ranked contexts (case_id, document_id, title, text, rank) as D1, D2, ...,
    gold documents (case_id, document_id) and gold sets."""
    one = F.struct("rank", "document_id", "title", "text")
    context = ranked.groupBy("case_id").agg(F.sort_array(F.collect_list(one)).alias("c"))
    named = F.transform("c", lambda c, i: F.struct(F.concat(F.lit("D"), (i + 1).cast("string")).alias("citation_id"), c["document_id"].alias("document_id"), c["title"].alias("title"), c["text"].alias("text")))
    context = context.select("case_id", named.alias("contexts"))
    gold = support.groupBy("case_id").agg(F.array_sort(F.collect_set("document_id")).alias("gold_document_ids"))
    out = cases.join(context, "case_id", "left").join(gold, "case_id", "left").join(gold_sets(votes), "case_id", "left")
    none = F.array().cast(_IDS)
    out = out.withColumn("gold_document_ids", F.coalesce("gold_document_ids", none)).withColumn("gold_evidence_sets", F.coalesce("gold_evidence_sets", F.array().cast("array<array<string>>")))
    return out.withColumn("retrieved_document_ids", F.coalesce(F.col("contexts")["document_id"], none))


def case_results(work: DataFrame, results: DataFrame) -> DataFrame:
    """A row for each work item: what was predicted, and whether it, its citations and its evidence are right.

    A case without a result (case_id, prediction, citation_ids) fails closed: it abstains and cites nothing. A citation that the case was not given is an error.
    """
    said = results.select("case_id", F.regexp_replace("prediction", r"(?U)^\s+|\s+$", "").alias("__p"), F.col("citation_ids").alias("__c"), F.lit(True).alias("__r"))
    rows = work.join(said, "case_id", "left")
    fever = F.col("benchmark_id") == FEVER
    rows = rows.withColumn("fail_closed", F.col("__r").isNull()).withColumn("prediction", F.coalesce("__p", F.when(fever, NO_INFO).otherwise(SENTINEL)))
    given = F.map_from_entries(F.transform("contexts", lambda c: F.struct(c["citation_id"], c["document_id"])))
    ids = F.coalesce("__c", F.array().cast(_IDS))
    known = F.when(F.size(F.array_except(ids, F.coalesce(F.col("contexts")["citation_id"], F.array().cast(_IDS)))) > 0, F.raise_error(F.lit("a citation that the case was not given")).cast(_IDS)).otherwise(ids)
    rows = rows.withColumn("cited_document_ids", F.array_sort(F.array_distinct(F.coalesce(F.transform(known, lambda i: given[i]), F.array().cast(_IDS)))))
    cited, gold, got, sets = (F.col(c) for c in ("cited_document_ids", "gold_document_ids", "retrieved_document_ids", "gold_evidence_sets"))
    some = F.size(gold) > 0
    precision, recall = metrics.citation_metrics(cited, gold)
    rows = rows.withColumns({
        "retrieval_any_gold": F.when(some, F.arrays_overlap(gold, got)), "retrieval_complete_gold": F.when(some, metrics.subset(gold, got)),
        "citation_precision": precision, "citation_recall": recall,
    })
    label = casefold(F.col("prediction"))
    union = ~some | metrics.subset(gold, cited)
    voted = (F.col("benchmark_id") == NQ) & some
    claimed = F.when(label == NO_INFO, (F.col("label") == NO_INFO) & (F.size(cited) == 0)).otherwise(metrics.any_set_complete(sets, cited))
    rows = rows.withColumns({
        "label_correct": F.when(fever, F.coalesce(label == F.col("label"), F.lit(False))),
        "evidence_complete": F.when(fever, F.coalesce(claimed, F.lit(False))).when(voted, metrics.any_set_complete(sets, cited)).otherwise(union),
        "legacy_union_evidence_complete": F.when(~fever, union),
        "retrieval_any_complete_evidence_set": F.when(~fever, F.when(voted, metrics.any_set_complete(sets, got)).otherwise(F.col("retrieval_complete_gold"))),
        "answerability_correct": F.when(~fever, (label == SENTINEL.casefold()) == (F.col("answerability") == "unanswerable")),
    })
    answers = metrics.answer_scores(rows.where(~fever), "prediction", "answers", ["case_id"]).toDF("case_id", "answer_exact_match", "answer_f1")
    rows = rows.join(answers, "case_id", "left")
    exact = F.col("answer_exact_match") > 0
    rows = rows.withColumn("joint_correct", F.when(fever, F.col("label_correct")).otherwise(exact) & F.col("evidence_complete"))
    rows = rows.withColumn("legacy_union_joint_correct", F.when(~fever, exact & F.col("legacy_union_evidence_complete")))
    return rows.select("case_id", "benchmark_id", "prediction", "fail_closed", *CASE_METRICS, "cited_document_ids")


CASE_METRICS = (
    "retrieval_any_gold", "retrieval_complete_gold", "citation_precision", "citation_recall", "label_correct", "answer_exact_match", "answer_f1", "answerability_correct",
    "retrieval_any_complete_evidence_set", "evidence_complete", "legacy_union_evidence_complete", "joint_correct", "legacy_union_joint_correct",
)


def aggregate(rows: DataFrame) -> DataFrame:
    """Means by benchmark over the cases that have a value, and `macro`: all cases, and the plain mean of the benchmarks' joint rates."""
    by = rows.groupBy("benchmark_id").agg(F.count("*").alias("case_count"), F.count_if("fail_closed").alias("fail_closed_count"), *[F.avg(F.col(m).cast("double")).alias(m) for m in CASE_METRICS])
    names = [c for c in by.columns if c not in ("benchmark_id", "case_count", "joint_correct")]
    macro = by.agg(F.sum("case_count").alias("case_count"), F.avg("joint_correct").alias("joint_correct"))
    return by.unionByName(macro.select(F.lit("macro").alias("benchmark_id"), "case_count", "joint_correct", *[F.lit(None).cast(by.schema[c].dataType).alias(c) for c in names]))


def consistency(runs: DataFrame, primary: str, unite: bool = False) -> DataFrame:
    """(case_id, prediction, citation_ids, votes, n_runs) of (case_id, run, prediction, citation_ids): runs are grouped by normalised answer; the primary run's wording of the
    answer that more than half of them give, or, where it is not among them, that of the first run by name; without a majority the primary run's. `unite`: with the citations of all that agree."""
    r = runs.withColumn("norm", normalize_answer(F.col("prediction"))).withColumn("other", (F.col("run") != primary).cast("int"))
    one = F.struct("other", "run", "prediction", "citation_ids")
    groups = r.groupBy("case_id", "norm").agg(F.count("*").alias("votes"), F.min(one).alias("own"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("citation_ids")))).alias("united"))
    n = r.groupBy("case_id").agg(F.count("*").alias("n_runs"))
    main = r.where("other = 0").select("case_id", F.col("norm").alias("pn"))
    rows = groups.join(n, "case_id").join(main, "case_id")
    chosen = rows.where((F.col("votes") * 2 > F.col("n_runs")) | (F.col("norm") == F.col("pn"))).groupBy("case_id").agg(F.max_by(F.struct("own", "united", "votes", "n_runs"), F.struct((F.col("votes") * 2 > F.col("n_runs")).alias("m"), "votes")).alias("b"))
    ids = F.col("b.united") if unite else F.col("b.own.citation_ids")
    return chosen.select("case_id", F.col("b.own.prediction").alias("prediction"), ids.alias("citation_ids"), F.col("b.votes").alias("votes"), F.col("b.n_runs").alias("n_runs"))


def composed_report(reports: dict[str, DataFrame], route: dict[str, str]) -> DataFrame:
    """Each benchmark's cases from the report that it is routed to; a case that two of them give is an error."""
    parts = None
    for benchmark, name in route.items():
        one = reports[name].where(F.col("benchmark_id") == benchmark)
        parts = one if parts is None else parts.unionByName(one)
    twice = parts.groupBy("case_id").agg(F.count("*").alias("__n"))
    return parts.join(twice, "case_id").where(F.when(F.col("__n") == 1, F.lit(True)).otherwise(F.raise_error(F.lit("a case stands in two reports")))).drop("__n")


def action_policy(items: DataFrame, by: str | None = None) -> DataFrame:
    """([by,] counts and rates) of (expected_action, actual_action, contract_valid): an answer that breaks its contract is not delivered."""
    delivered = F.when(F.coalesce("contract_valid", F.lit(False)), F.col("actual_action")).otherwise("invalid_failclosed")
    wants, answered = F.col("expected_action") == "answer", F.col("delivered_action") == "answer"
    rows = items.withColumn("delivered_action", delivered)
    if by:
        rows = rows.where(F.col(by).isNotNull())
    out = rows.groupBy(*([by] if by else [])).agg(
        F.count("*").alias("case_count"), F.count_if(wants).alias("answerable_count"), F.count_if(~wants).alias("unanswerable_count"), F.count_if("contract_valid").alias("contract_valid_count"),
        F.count_if(F.col("delivered_action").eqNullSafe(F.col("expected_action"))).alias("action_correct_count"), F.count_if(~wants & answered).alias("false_answer_count"), F.count_if(wants & ~answered).alias("false_refusal_count"),
    )
    fa, fr = (F.col("false_answer_count"), F.col("unanswerable_count")), (F.col("false_refusal_count"), F.col("answerable_count"))
    out = out.withColumn("action_accuracy", stats.rate(F.col("action_correct_count"), F.col("case_count"))).withColumn("false_answer_rate", stats.rate(*fa)).withColumn("false_refusal_rate", stats.rate(*fr))
    return out.withColumn("false_answer_95ci", F.array(*stats.wilson(*fa))).withColumn("false_refusal_95ci", F.array(*stats.wilson(*fr)))


def passes_policy(overall: DataFrame, max_false_answer_rate: float, max_false_refusal_rate: float) -> DataFrame:
    """(passes): whether both rates exist and keep their limits."""
    ok = (F.col("false_answer_rate") <= max_false_answer_rate) & (F.col("false_refusal_rate") <= max_false_refusal_rate)
    return overall.select(F.coalesce(ok, F.lit(False)).alias("passes"))


#: Ratios of a structured run: name to (sum of this, over this).
RATIOS = {
    "contract_valid_rate": ("contract_valid", None), "action_accuracy": ("action_correct", None), "citation_existence_precision": ("valid_citation_count", "citation_count"),
    "claim_valid_citation_coverage": ("claims_with_valid_citations", "citation_claim_count"), "generated_claim_support_rate": ("supported_claim_count", "generated_claim_count"),
    "required_claim_coverage_rate": ("covered_required_claim_count", "required_claim_count"), "retrieval_required_claim_coverage": ("retrieval_covered_required_claim_count", "retrieval_required_claim_count"),
}


def structured_summary(items: DataFrame, by: str | None = None) -> DataFrame:
    """([by,] case_count, ratios of sums, pass rate, failures) of structured cases; nulls are left out, and a ratio over nothing is null. Four digits."""
    number = lambda c: F.coalesce(F.sum(F.col(c).cast("double")), F.lit(0.0))
    ratios = [F.round(F.try_divide(number(a), F.count("*").cast("double") if b is None else number(b)), 4).alias(n) for n, (a, b) in RATIOS.items() if a in items.columns and (b is None or b in items.columns)]
    rows = items.where(F.col(by).isNotNull()) if by else items
    passed = F.round(F.avg(F.col("case_pass").cast("double")), 4).alias("end_to_end_case_pass_rate")
    return rows.groupBy(*([by] if by else [])).agg(F.count("*").alias("case_count"), *ratios, passed, F.count_if(~F.col("case_pass")).alias("failure_count"))


def failures(items: DataFrame) -> DataFrame:
    """(id) of the cases that did not pass, in order."""
    return items.where(F.col("case_pass") == F.lit(False)).select("id").orderBy("id")


def retrieval_diagnostics(cases: DataFrame) -> DataFrame:
    """Of (case_id, gold, retrieved, claims: array of arrays of ids): whether any and all gold was retrieved, and how many claims have all of theirs."""
    gold, got = F.col("gold"), F.col("retrieved")
    covered = F.size(F.filter("claims", lambda c: F.size(F.array_except(c, got)) == 0))
    return cases.where(F.size("gold") > 0).select("case_id", F.arrays_overlap(gold, got).alias("retrieval_any_gold_evidence"), metrics.subset(gold, got).alias("retrieval_complete_gold_evidence"), F.size("claims").alias("retrieval_required_claim_count"), covered.alias("retrieval_covered_required_claim_count"))

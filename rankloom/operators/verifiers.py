"""Verifiers: features of a reader's or an entailment model's candidates, what a learned score makes of them, and the choice of model and threshold.

`raw` rows are (case_id, query, candidates: an array of structs in the model's order); `baseline` rows are (case_id, prediction, cited_document_ids, ...), one a case. A case's
candidates are few by contract; every join is on the case. A case without candidates keeps its row, with zeros.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import stats
from ..functions.text import SENTINEL, alnum_tokens, casefold, normalize_answer, squeeze
from . import metrics
from .scoring import NO_INFO
from .selectors import GRID, share

#: The least relation that gives a label, a reader's least score and lead over an empty answer, the score from which the learned verifier abstains.
LABEL_THRESHOLD = 0.75
READER_SCORE, READER_LEAD = 0.02, -0.9
VERIFIER_THRESHOLD = 0.48
#: The labels of the relations, the first words that tell kinds of questions apart, the names of the features in their order.
RELATIONS = (("entailment", "supports"), ("contradiction", "refutes"))
QUESTION_TYPES = "what who when where which how is are did does was were".split()
EVIDENCE_FEATURES = (
    "inverse_rank rank entailment contradiction neutral relation top relation_to_top cited label_agrees is_supports is_refutes query_in_title query_in_text title_words text_words"
).split()
ACTION_FEATURES = (
    "max_nonempty_score max_empty_score nonempty_minus_empty top_two_nonempty_gap nonempty_to_empty_ratio max_baseline_answer_match_score baseline_answer_match_count "
    "nonempty_candidate_count largest_candidate_answer_consensus baseline_citation_count baseline_prediction_token_count baseline_prediction_character_count question_token_count "
    "baseline_prediction_in_question"
).split() + [f"question_type_{w}" for w in QUESTION_TYPES]
VERIFIER_FEATURES = (
    "max_nonempty_score second_nonempty_score max_empty_score second_empty_score max_nonempty_minus_max_empty nonempty_count empty_count mean_nonempty_score mean_empty_score "
    "baseline_prediction_token_count baseline_prediction_character_count reader_prediction_token_count reader_exactly_agrees reader_substring_agrees reader_document_was_cited "
    "baseline_citation_count"
).split()


def answered(prediction: Column) -> Column:
    return casefold(prediction) != SENTINEL.casefold()


def _vector(names: list[str], values: dict[str, Column]) -> Column:
    return F.array(*[F.coalesce(values[n].cast("double"), F.lit(0.0)) for n in names]).alias("features")


def _words(text: Column) -> Column:
    return F.size(F.filter(F.split(squeeze(text), " "), lambda w: w != ""))


# Evidence of claims


def labelled(raw: DataFrame, threshold: float = LABEL_THRESHOLD) -> DataFrame:
    """`raw` with `label`, `relation` (the field it comes from, null without a label) and `top`, the strongest relation of any candidate. Equal ones support."""
    best = [F.coalesce(F.array_max(F.col("candidates")[field]).cast("double"), F.lit(0.0)) for field, _ in RELATIONS]
    top = F.greatest(*best)
    first = best[0] >= best[1]
    name = lambda part: F.when(top < threshold, F.lit(NO_INFO if part else None)).when(first, RELATIONS[0][part]).otherwise(RELATIONS[1][part])
    return raw.withColumns({"label": name(1), "relation": name(0), "top": top})


def evidence_features(raw: DataFrame, work: DataFrame, baseline: DataFrame) -> DataFrame:
    """(case_id, document_id, rank, features) of each candidate (document_id, entailment, contradiction, neutral), whose title and text are those of the work item's contexts."""
    said = baseline.select("case_id", F.col("prediction").alias("__said"), F.col("cited_document_ids").alias("__cited"))
    rows = labelled(raw).join(work.select("case_id", "contexts"), "case_id").join(said, "case_id")
    rows = rows.select("case_id", "query", "label", "relation", "top", "__said", "__cited", "contexts", F.posexplode("candidates").alias("__pos", "c"))
    rows = rows.withColumn("x", F.get(F.filter("contexts", lambda x: x["document_id"] == F.col("c.document_id")), F.lit(0)))
    rows = rows.withColumns({"q": alnum_tokens(F.col("query")), "tt": alnum_tokens(F.col("x.title")), "dt": alnum_tokens(F.col("x.text")), "rank": F.col("__pos") + 1})
    stand, against = F.col("c.entailment"), F.col("c.contradiction")
    relation = F.when(F.col("relation") == RELATIONS[0][0], stand).when(F.col("relation") == RELATIONS[1][0], against).otherwise(F.greatest(stand, against))
    values = {
        "inverse_rank": 1 / F.col("rank"), "rank": F.col("rank"), "entailment": stand, "contradiction": against, "neutral": F.col("c.neutral"), "relation": relation, "top": F.col("top"),
        "relation_to_top": relation / F.greatest(F.col("top"), F.lit(1e-9)), "cited": F.array_contains("__cited", F.col("c.document_id")), "label_agrees": F.col("label") == F.col("__said"),
        "is_supports": F.col("label") == RELATIONS[0][1], "is_refutes": F.col("label") == RELATIONS[1][1], "query_in_title": share(F.col("tt"), F.col("q")),
        "query_in_text": share(F.col("dt"), F.col("q")), "title_words": F.size("tt"), "text_words": F.size("dt"),
    }
    return rows.select("case_id", F.col("c.document_id").alias("document_id"), "rank", _vector(EVIDENCE_FEATURES, values))


def evidence_selection(raw: DataFrame, baseline: DataFrame, scored: DataFrame, threshold: float) -> DataFrame:
    """(case_id, prediction, cited_document_ids, citation_precision, citation_recall, label_correct, evidence_complete, joint_correct) of cases (with gold_label, gold_document_ids,
    gold_evidence_sets) and scored candidates (case_id, document_id, rank, probability).

    A labelled case cites what the baseline cites under the same label and the candidates that reach the threshold; if these are none, the likeliest, the first of equals.
    """
    docs = scored.groupBy("case_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("probability")).alias("least"), "rank", "document_id"))).alias("__d"))
    said = baseline.select("case_id", F.col("prediction").alias("__said"), F.col("cited_document_ids").alias("__cited"))
    rows = labelled(raw).join(said, "case_id").join(docs, "case_id", "left")
    none = F.array().cast("array<string>")
    likely = F.coalesce(F.filter("__d", lambda x: x["least"] <= -threshold)["document_id"], none)
    both = F.array_union(F.when(F.col("label") == F.col("__said"), F.col("__cited")).otherwise(none), likely)
    best = F.coalesce(F.slice(F.col("__d")["document_id"], 1, 1), none)
    cited = F.when(F.col("label") == NO_INFO, none).when(F.size(both) > 0, F.array_sort(both)).otherwise(best)
    rows = rows.withColumn("cited_document_ids", cited).withColumn("label_correct", F.col("label").eqNullSafe(F.col("gold_label")))
    precision, recall = metrics.citation_metrics(F.col("cited_document_ids"), F.col("gold_document_ids"))
    whole = F.when(F.col("label") == NO_INFO, F.col("label_correct")).otherwise(F.coalesce(metrics.any_set_complete(F.col("gold_evidence_sets"), F.col("cited_document_ids")), F.lit(False)))
    rows = rows.withColumn("evidence_complete", whole)
    return rows.select("case_id", F.col("label").alias("prediction"), "cited_document_ids", precision.alias("citation_precision"), recall.alias("citation_recall"), "label_correct", "evidence_complete", (F.col("label_correct") & F.col("evidence_complete")).alias("joint_correct"))


# Answers of a reader


def _reader(raw: DataFrame, baseline: DataFrame) -> DataFrame:
    """A row a case: scores of full and of empty answers, best first, the full answers' normal forms, the best full answer, and the baseline's prediction.

    Candidates are exploded, since normal forms can't be taken inside an array; they are pre-aggregated by nothing but their case.
    """
    rows = raw.select("case_id", "query", F.posexplode_outer("candidates").alias("__pos", "c"))
    rows = rows.withColumn("__full", F.coalesce(F.col("c.answer") != "", F.lit(False))).withColumn("__norm", normalize_answer(F.col("c.answer"))).withColumn("__score", F.col("c.score").cast("double"))
    full, empty = F.col("__full"), ~F.col("__full") & F.col("c").isNotNull()
    by = rows.groupBy("case_id").agg(
        F.any_value("query").alias("query"),
        F.sort_array(F.collect_list(F.when(full, F.col("__score"))), asc=False).alias("full"),
        F.sort_array(F.collect_list(F.when(empty, F.col("__score"))), asc=False).alias("empty"),
        F.collect_list(F.when(full, F.struct(F.col("__norm").alias("norm"), F.col("__score").alias("score")))).alias("answers"),
        F.max_by(F.when(full, F.struct(F.col("__norm").alias("norm"), F.col("c.document_id").alias("document_id"))), F.when(full, F.struct("__score", -F.col("__pos")))).alias("best"),
    )
    said = baseline.select("case_id", "prediction", F.col("cited_document_ids").alias("cited"))
    return by.join(said, "case_id").withColumn("norm", normalize_answer(F.col("prediction")))


def _nth(scores: str, n: int) -> Column:
    return F.coalesce(F.get(scores, F.lit(n)), F.lit(0.0))


def action_features(raw: DataFrame, baseline: DataFrame) -> DataFrame:
    """(case_id, features) of cases with candidates (document_id, answer, score): what a choice between keeping the baseline's answer and abstaining learns from."""
    first = F.regexp_extract(casefold(F.col("query")), r"^([a-z0-9]+)", 1)
    same = F.filter("answers", lambda a: a["norm"] == F.col("norm"))
    alike = F.transform(F.array_distinct(F.col("answers")["norm"]), lambda n: F.size(F.filter("answers", lambda a: a["norm"] == n)))
    rows = _reader(raw, baseline).withColumn("asked", normalize_answer(F.col("query")))
    full, empty = _nth("full", 0), _nth("empty", 0)
    values = {
        "max_nonempty_score": full, "max_empty_score": empty, "nonempty_minus_empty": full - empty, "top_two_nonempty_gap": F.when(F.size("full") > 1, full - _nth("full", 1)).otherwise(full),
        "nonempty_to_empty_ratio": full / (empty + 1e-4), "max_baseline_answer_match_score": F.array_max(same["score"]), "baseline_answer_match_count": F.size(same),
        "nonempty_candidate_count": F.size("answers"), "largest_candidate_answer_consensus": F.array_max(alike), "baseline_citation_count": F.size("cited"),
        "baseline_prediction_token_count": _words(F.col("norm")), "baseline_prediction_character_count": F.length("prediction"), "question_token_count": _words(F.col("query")),
        "baseline_prediction_in_question": F.col("asked").contains(F.col("norm")),
    } | {f"question_type_{w}": first == w for w in QUESTION_TYPES}
    return rows.select("case_id", _vector(ACTION_FEATURES, values))


def verifier_features(raw: DataFrame, baseline: DataFrame) -> DataFrame:
    """(case_id, features) of the same cases, with the reader's best full answer, the first of equals."""
    rows = _reader(raw, baseline).withColumn("read", F.coalesce("best.norm", F.lit("")))
    some = F.col("read") != ""
    mean = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x) / F.greatest(F.size(c), F.lit(1))
    values = {
        "max_nonempty_score": _nth("full", 0), "second_nonempty_score": _nth("full", 1), "max_empty_score": _nth("empty", 0), "second_empty_score": _nth("empty", 1),
        "max_nonempty_minus_max_empty": _nth("full", 0) - _nth("empty", 0), "nonempty_count": F.size("full"), "empty_count": F.size("empty"), "mean_nonempty_score": mean("full"),
        "mean_empty_score": mean("empty"), "baseline_prediction_token_count": _words(F.col("norm")), "baseline_prediction_character_count": F.length("norm"),
        "reader_prediction_token_count": _words(F.col("read")), "reader_exactly_agrees": some & (F.col("read") == F.col("norm")),
        "reader_substring_agrees": some & (F.col("norm").contains(F.col("read")) | F.col("read").contains(F.col("norm"))),
        "reader_document_was_cited": F.array_contains("cited", F.coalesce("best.document_id", F.lit(""))), "baseline_citation_count": F.size("cited"),
    }
    return rows.select("case_id", _vector(VERIFIER_FEATURES, values))


def action_label(prediction: Column, joint_correct: Column, answerability: Column) -> Column:
    """1 where only an abstention would be right, 0 where only the answer is, else null: such cases teach nothing."""
    out = answerability == "unanswerable"
    return F.when(answered(prediction) & (joint_correct != out), out.cast("int"))


def abstention_utility(joint_correct: Column, answerability: Column) -> Column:
    """1 for an abstention that is called for, -1 for one that costs a right answer, else 0."""
    return F.when(answerability == "unanswerable", 1).when(joint_correct, -1).otherwise(0)


def unsure(raw: DataFrame, least: float = READER_SCORE, lead: float = READER_LEAD) -> DataFrame:
    """(case_id, abstain): whether the best full answer misses its least score, or its lead over the best empty one."""
    best = lambda keep: F.coalesce(F.array_max(F.filter("candidates", keep)["score"]).cast("double"), F.lit(0.0))
    is_full = lambda c: F.coalesce(c["answer"] != "", F.lit(False))
    full, empty = best(is_full), best(lambda c: ~is_full(c))
    return raw.select("case_id", ((full < least) | (full - empty < lead)).alias("abstain"))


def abstained(results: DataFrame, decisions: DataFrame) -> DataFrame:
    """Results (case_id, prediction, citation_ids) in which the answered cases of `decisions` (case_id, abstain) abstain and cite nothing; `scoring.case_results` scores them. Others stay."""
    rows = results.select("case_id", "prediction", "citation_ids").join(decisions.select("case_id", "abstain"), "case_id", "left")
    gives_up = F.coalesce(F.col("abstain") & answered(F.col("prediction")), F.lit(False))
    return rows.select("case_id", F.when(gives_up, SENTINEL).otherwise(F.col("prediction")).alias("prediction"), F.when(gives_up, F.array().cast("array<string>")).otherwise(F.col("citation_ids")).alias("citation_ids"))


def action_sweep(cases: DataFrame, thresholds: tuple[float, ...] = GRID) -> DataFrame:
    """(model, threshold, case_count, joint_correct_rate, abstention_count, wins, losses, p_value) of (model, case_id, prediction, probability, kept_correct, abstention_correct):
    an answered case abstains from the threshold on, one without a probability never."""
    rows = cases.withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds))))
    gives_up = F.coalesce((F.col("probability") >= F.col("threshold")) & answered(F.col("prediction")), F.lit(False))
    rows = rows.withColumn("__up", gives_up).withColumn("__ok", F.when(F.col("__up"), F.col("abstention_correct")).otherwise(F.col("kept_correct")))
    by = rows.groupBy("model", "threshold").agg(
        F.count("*").alias("case_count"), F.count_if("__ok").alias("__right"), F.count_if("__up").alias("abstention_count"),
        F.count_if(F.col("__ok") & ~F.col("kept_correct")).alias("wins"), F.count_if(~F.col("__ok") & F.col("kept_correct")).alias("losses"),
    )
    return by.select("model", "threshold", "case_count", stats.rate(F.col("__right"), F.col("case_count")).alias("joint_correct_rate"), "abstention_count", "wins", "losses", stats.mcnemar_p(F.col("wins"), F.col("losses")).alias("p_value"))


def chosen_model(swept: DataFrame, models: list[str]) -> DataFrame:
    """The best row of a sweep: the best joint rate, then the fewest losses, the fewest abstentions, the earlier model of `models`, the lowest threshold."""
    order = F.array_position(F.array(*map(F.lit, models)), F.col("model"))
    return swept.where(order > 0).orderBy(F.desc("joint_correct_rate"), "losses", "abstention_count", order, "threshold").limit(1)

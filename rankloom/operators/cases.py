"""Evaluation cases: migration, review, derivation, audits of their integrity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import evidence_cluster, question_tokens
from .corpus import near_pairs
from .lifecycle import ensure, unique
from .metrics import numbered
from .sampling import stratified

#: The reasons that each abstention allows, the first one being its default; the lanes and states of migrated cases; the nearness that two questions may not reach.
ACTION_REASONS = {
    "abstain_absent": ("absent_from_corpus", "subjective"),
    "clarify_ambiguous": ("ambiguous", "malformed"),
    "abstain_conflict": ("conflicting_sources",),
    "abstain_obsolete": ("obsolete_only",),
    "abstain_unauthorized": ("unauthorized",),
    "reject_injection": ("prompt_injection",),
}
SCORES = ("score", "rank", "judge_score")
MOST_ALIKE = 0.75
_NONE = "array<string>"


def migrate(records: DataFrame, version: str) -> DataFrame:
    """Old cases (id, question, answerable, relevant, answer, raw: the line that they came from) in the new form. Nothing is lost: the line is kept with its digest."""
    yes = F.col("answerable")
    pick = lambda a, b: F.when(yes, a).otherwise(b)
    documents = F.array_sort(F.array_distinct(F.transform("relevant", lambda e: F.substring_index(e, "::", 1))))
    claim = F.struct(F.lit("c1").alias("id"), F.col("answer").alias("text"), F.col("relevant").alias("evidence_ids"), F.lit("legacy_unatomized").alias("status"))
    return records.select(
        F.concat(F.lit("v1-"), "id").alias("id"), F.lit(version).alias("dataset_version"), F.lit("dev").alias("split"), pick("legacy_v1_answerable", "legacy_v1_unanswerable").alias("lane"), "question",
        pick("answerable", "unanswerable").alias("answerability"), pick("answer", "abstain_absent").alias("answer_action"), F.col("answer").alias("reference_answer"),
        F.filter(F.array(claim), lambda c: yes).alias("required_claims"), F.col("relevant").alias("acceptable_evidence"), F.array().cast(_NONE).alias("distractor_evidence"),
        pick("legacy_heading", "none").alias("evidence_granularity"), pick(F.lit(1), F.lit(0)).alias("reasoning_hops"), F.concat(F.lit("legacy-v1-intent::"), "id").alias("intent_family_id"),
        evidence_cluster(yes, F.col("id"), F.col("relevant")).alias("evidence_cluster_id"), F.concat(F.array(F.lit("legacy_v1"), F.lit("human_authored")), documents).alias("tags"),
        F.when(~yes, "absent_from_corpus").alias("unanswerable_reason"), F.lit("migrated_pending_v2_review").alias("review_status"), F.sha2("raw", 256).alias("source_record_sha256"), "raw",
    )


def migration_drift(cases: DataFrame, records: DataFrame) -> DataFrame:
    """(id) of records that their migrated cases do not give back, or that have none."""
    back = cases.select(F.substring("id", 4, 1 << 20).alias("id"), F.struct("question", F.col("reference_answer").alias("answer"), F.col("acceptable_evidence").alias("relevant"), (F.col("answerability") == "answerable").alias("answerable")).alias("b"))
    own = records.select("id", F.struct("question", "answer", "relevant", "answerable").alias("o"))
    return own.join(back, "id", "full_outer").where(~F.col("b").eqNullSafe(F.col("o"))).select("id")


def unanswerable_reason(action: Column, current: Column) -> Column:
    """The reason of an abstention: the current one if its action allows it, else the action's default; null for an answer. An unknown action is an error."""
    allowed = F.create_map(*[x for a, r in ACTION_REASONS.items() for x in (F.lit(a), F.array(*map(F.lit, r)))])[action]
    known = F.when(allowed.isNull(), F.raise_error(F.concat(F.lit("unsupported action "), action))).otherwise(allowed)
    return F.when(action != "answer", F.when(F.coalesce(F.array_contains(known, current), F.lit(False)), current).otherwise(F.get(known, F.lit(0))))


def reviewed(cases: DataFrame, decisions: DataFrame) -> DataFrame:
    """Cases (id, question, answer_action, reference_answer, acceptable_evidence, unanswerable_reason, tags) as reviewers left them: a decision's (case_id, decision, the same fields) values that are there
    stand before the case's, tags are united, hops are counted from the evidence's headings."""
    d = decisions.select(F.col("case_id").alias("id"), "decision", *[F.col(c).alias(f"d_{c}") for c in ("question", "answer_action", "reference_answer", "acceptable_evidence", "tags")])
    rows = cases.join(d, "id", "left")
    over = {c: F.coalesce(f"d_{c}", c) for c in ("question", "answer_action", "reference_answer", "acceptable_evidence")}
    rows = rows.withColumns(over).withColumn("unanswerable_reason", unanswerable_reason(F.col("answer_action"), F.col("unanswerable_reason")))
    tags = F.array_sort(F.array_union("tags", F.coalesce("d_tags", F.array().cast(_NONE))))
    hops = F.size(F.array_distinct(F.transform("acceptable_evidence", lambda e: F.substring_index(e, "::span-", 1))))
    status = F.when(F.col("decision") == "approve", "approved").when(F.col("decision").isNotNull(), F.col("decision")).otherwise("pending")
    return rows.withColumns({"tags": tags, "reasoning_hops": hops, "review_status": status}).drop("decision", *[f"d_{c}" for c in (*over, "tags")])


def eligible(cases: DataFrame, lanes: list[str], limit: int | None = None) -> DataFrame:
    """Approved cases of these lanes, in order of id; `limit` for a pilot run."""
    rows = cases.where(F.col("lane").isin(lanes) & (F.col("review_status") == "approved")).orderBy("id")
    return rows if limit is None else rows.limit(limit)


def redundant_evidence(cases: DataFrame) -> DataFrame:
    """Cases (id, acceptable_evidence, required_claims with evidence_ids) whose evidence holds that of their claims, in order, and `added`, what was not there before."""
    claimed = F.flatten(F.col("required_claims")["evidence_ids"])
    return cases.withColumn("added", F.array_except(claimed, "acceptable_evidence")).withColumn("acceptable_evidence", F.array_union("acceptable_evidence", claimed))


def derived(cases: DataFrame, specs: DataFrame) -> DataFrame:
    """New cases from specs (source_id, new_id, question, lane, answer_action): a copy of the source with these fields in their place; a spec without a source is an error."""
    s = specs.select(F.col("source_id").alias("id"), F.col("new_id"), *[F.col(c).alias(f"n_{c}") for c in ("question", "lane", "answer_action")])
    rows = s.join(cases.withColumn("__there", F.lit(True)), "id", "left")
    rows = ensure(rows, F.col("__there"), "a spec without a source").drop("__there").withColumn("derived_from", F.col("id")).withColumn("id", F.col("new_id"))
    return rows.withColumns({c: F.coalesce(f"n_{c}", c) for c in ("question", "lane", "answer_action")}).drop("new_id", "n_question", "n_lane", "n_answer_action")


def question_manifest(cases: DataFrame, normalized: DataFrame, order: str) -> DataFrame:
    """The normalised cases (id, ...) that a run's cases (case_id, order) name, in the run's order; one that is missing is an error."""
    rows = cases.select(F.col("case_id").alias("id"), order).join(normalized.withColumn("__there", F.lit(True)), "id", "left")
    return ensure(rows, F.col("__there"), "a case is not among the normalised ones").drop("__there").orderBy(order)


def blind(sources: DataFrame) -> DataFrame:
    """What a reviewer sees of sources: no scores, no ranks."""
    return sources.drop(*SCORES)


def wire_ids(batch: DataFrame, by: str, order: str) -> DataFrame:
    """A batch's cases under the names C1, C2, ... in their order."""
    return batch.withColumn("wire_id", F.concat(F.lit("C"), F.row_number().over(Window.partitionBy(by).orderBy(order)).cast("string")))


def spot_audit(cases: DataFrame, stratum: Column, targets: dict[str, int], seed: str) -> DataFrame:
    """A stratified sample of normalised cases with what an auditor needs: evidence with its documents' titles, and the votes on answerability counted."""
    rows = stratified(cases, stratum, targets, "id", seed)
    title = F.map_from_entries(F.transform("documents", lambda d: F.struct(d["id"], d["title"])))
    shown = F.transform("supporting_evidence", lambda e: F.struct(title[e["document_id"]].alias("document_title"), e["sentence_index"].alias("sentence_index"), e["text"].alias("text")))
    says = lambda v: F.size(F.filter("annotation_votes", lambda x: x["answerability"] == v))
    return rows.select(F.concat(F.lit("public-audit:"), "id").alias("audit_id"), "benchmark_id", "stratum", F.col("id").alias("case_id"), "query", shown.alias("supporting_evidence"), F.size("annotation_votes").alias("vote_count"), says("answerable").alias("answerable_votes"), says("unanswerable").alias("unanswerable_votes"), F.lit("pending").alias("review_status"))


def coverage_matrix(headings: DataFrame, cases: DataFrame, lanes: list[str], least: int = 3) -> tuple[DataFrame, DataFrame]:
    """(by heading: cases that link it, approved ones, and spans; by lane: approved cases and how many are wanting to `least`) of headings (document_id, heading_key) and cases (id, lane, review_status, acceptable_evidence)."""
    linked = cases.select("id", "review_status", F.explode("acceptable_evidence").alias("e")).select("id", "review_status", F.substring_index("e", "::span-", 1).alias("heading_key"), F.col("e").contains("::span-").alias("span"))
    counts = linked.groupBy("heading_key").agg(F.count_distinct("id").alias("linked"), F.count_distinct(F.when(F.col("review_status") == "approved", F.col("id"))).alias("approved"), F.count_distinct(F.when(F.col("span"), F.col("id"))).alias("with_span"))
    by_heading = headings.join(counts, "heading_key", "left").fillna(0, ["linked", "approved", "with_span"])
    every = cases.sparkSession.createDataFrame([(x,) for x in lanes], "lane string")
    have = cases.where("review_status = 'approved'").groupBy("lane").agg(F.count("*").alias("approved"))
    gaps = every.join(have, "lane", "left").fillna(0, ["approved"]).withColumn("gap", F.greatest(F.lit(0), least - F.col("approved")))
    return by_heading, gaps


def inventory(cases: DataFrame) -> DataFrame:
    """(review_status, cases, intents, clusters) and whether all are approved, for the gate that freezes a dataset."""
    rows = cases.groupBy("review_status").agg(F.count("*").alias("cases"), F.count_distinct("intent_family_id").alias("intents"), F.count_distinct("evidence_cluster_id").alias("clusters"))
    return rows.withColumn("ready", F.min((F.col("review_status") == "approved").cast("int")).over(Window.partitionBy()) == 1)  # a row a status


def document_labels(cases: DataFrame) -> DataFrame:
    """(document, n): how often the cases' evidence names each document."""
    return cases.select(F.explode("acceptable_evidence").alias("e")).groupBy(F.substring_index("e", "::", 1).alias("document")).agg(F.count("*").alias("n"))


def integrity_faults(cases: DataFrame, known_evidence: DataFrame) -> DataFrame:
    """(id, rule) for each rule that a case breaks: evidence that is also a distractor, claims beyond the evidence, unknown evidence, an action without its reason or with one that it does not allow, an approval without reviewers."""
    claimed = F.flatten(F.col("required_claims")["evidence_ids"])
    reason = F.create_map(*[x for a, r in ACTION_REASONS.items() for x in (F.lit(a), F.array(*map(F.lit, r)))])[F.col("answer_action")]
    answers = F.col("answer_action") == "answer"
    rules = {
        "acceptable_distractor": F.arrays_overlap("acceptable_evidence", "distractor_evidence"),
        "claim_beyond_evidence": F.size(F.array_except(claimed, "acceptable_evidence")) > 0,
        "answer_without_claims": answers & (F.size("required_claims") == 0),
        "reason_on_answer": answers & F.col("unanswerable_reason").isNotNull(),
        "reason_not_allowed": ~answers & ~F.coalesce(F.array_contains(reason, F.col("unanswerable_reason")), F.lit(False)),
        "approved_without_reviewer": (F.col("review_status") == "approved") & (F.size("reviewers") == 0),
    }
    broken = F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in rules.items()]))
    own = cases.select("id", F.explode(broken).alias("rule"))
    used = cases.select("id", F.explode(F.array_union("acceptable_evidence", "distractor_evidence")).alias("evidence_id"))
    unknown = used.join(known_evidence.select("evidence_id"), "evidence_id", "left_anti").select("id", F.lit("unknown_evidence").alias("rule")).distinct()
    return own.unionByName(unknown)


def dataset_faults(cases: DataFrame) -> DataFrame:
    """(rule, n): ids and questions that come twice, and supersessions that name a case that is not there."""
    twice = lambda c, rule: cases.groupBy(c).count().where("count > 1").agg(F.count("*").alias("n")).select(F.lit(rule).alias("rule"), "n")
    named = cases.where("supersedes IS NOT NULL").select(F.col("supersedes").alias("id"))
    lost = named.join(cases.select("id"), "id", "left_anti").agg(F.count("*").alias("n")).select(F.lit("supersedes_unknown").alias("rule"), "n")
    return twice("id", "duplicate_id").unionByName(twice(F.lower("question"), "duplicate_question")).unionByName(lost)


def normalized_faults(cases: DataFrame) -> DataFrame:
    """(rule, n) of normalised cases: ids twice, evidence of documents that are not there, evidence whose text is not the sentence's, unanswerable cases with evidence."""
    sentence = F.map_from_entries(F.transform("documents", lambda d: F.struct(d["id"], d["sentences"])))
    dangling = F.exists("supporting_evidence", lambda e: sentence[e["document_id"]].isNull())
    drift = F.exists("supporting_evidence", lambda e: ~F.get(sentence[e["document_id"]], e["sentence_index"]).eqNullSafe(e["text"]))
    twice = cases.groupBy("id").count().where("count > 1").agg(F.count("*").alias("n")).select(F.lit("duplicate_id").alias("rule"), "n")
    rest = cases.agg(F.count_if(dangling).alias("dangling_evidence"), F.count_if(~dangling & drift).alias("text_drift"), F.count_if((F.col("gold.answerability") == "unanswerable") & (F.size("supporting_evidence") > 0)).alias("unanswerable_with_evidence"))
    return twice.unionByName(rest.unpivot([], ["dangling_evidence", "text_drift", "unanswerable_with_evidence"], "rule", "n"))


def multi_hop_faults(cases: DataFrame, known_intents: DataFrame) -> DataFrame:
    """(id, rule) of multi-hop candidates: two headings and two spans at least, an intent that is new and single."""
    heads = F.size(F.array_distinct(F.transform("acceptable_evidence", lambda e: F.substring_index(e, "::span-", 1))))
    spans = F.size(F.filter("acceptable_evidence", lambda e: e.contains("::span-")))
    own = cases.select("id", F.explode(F.array_compact(F.array(F.when(heads < 2, F.lit("one_hop")), F.when(spans < 2, F.lit("few_spans"))))).alias("rule"))
    old = cases.join(known_intents.select("intent_family_id"), "intent_family_id", "left_semi").select("id", F.lit("known_intent").alias("rule"))
    again = cases.groupBy("intent_family_id").agg(F.count("*").alias("n"), F.max("id").alias("id")).where("n > 1").select("id", F.lit("repeated_intent").alias("rule"))
    return own.unionByName(old).unionByName(again)


def overlap_audit(cases: DataFrame, most: float = MOST_ALIKE, top: int = 5) -> DataFrame:
    """(a, b, jaccard, passes): the questions most alike, and whether they stay under the limit."""
    alike = near_pairs(cases, "id", question_tokens(F.col("question")), 0.2)
    return alike.orderBy(F.desc("jaccard"), "a", "b").limit(top).withColumn("passes", F.col("jaccard") < most)


def packets(cases: DataFrame, order: str, size: int) -> DataFrame:
    """Cases in review packets of so many, in order."""
    return numbered(cases, F.col(order), "__place").withColumn("packet", F.floor(F.col("__place") / size)).drop("__place")


def calibration_labels(decisions: DataFrame, tasks: DataFrame) -> DataFrame:
    """(task_id, human): the latest decision (task_id, decision, at) on each task; a task without one is an error."""
    last = decisions.groupBy("task_id").agg(F.max_by("decision", "at").alias("human"))
    return ensure(unique(tasks.select("task_id"), "task_id", "a task comes twice").join(last, "task_id", "left"), F.col("human").isNotNull(), "a task has no decision")


def judge_tasks(answers: DataFrame, required: DataFrame) -> DataFrame:
    """(case_id, task_id, task_type, claim_text): a support task for each claim of an answered case (case_id, claims: array of text) and a coverage task for each required one (case_id, claims)."""
    make = lambda rows, kind, p: rows.select("case_id", F.posexplode("claims").alias("i", "claim_text")).select("case_id", F.concat("case_id", F.lit(f"::{p}"), (F.col("i") + 1).cast("string")).alias("task_id"), F.lit(kind).alias("task_type"), "claim_text")
    own = make(answers, "generated_claim_support", "g")
    return own.unionByName(make(required.join(answers.select("case_id"), "case_id", "left_semi"), "required_claim_coverage", "r"))

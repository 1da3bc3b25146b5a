"""Named queries on end-to-end scoring, judges and gates, with their DuckDB SQL.

Items stand for cases: a third of them for each benchmark. `labels` are a person's and judges' decisions on documents.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import gates, judging, scoring
from .catalogue import _BM25, _GOLD, _WORDS, _bm25_ranks, _gold, _lexical, _wilson_sql, named, table

_NAMES = "CASE item_id % 3 WHEN 0 THEN 'hotpotqa' WHEN 1 THEN 'natural_questions' ELSE 'fever' END"
_SCORED = f"""{_BM25}, {_GOLD},
gd AS (SELECT query_id, list_sort(list(doc_id::VARCHAR)) AS gold FROM gold GROUP BY query_id),
tp AS (SELECT query_id, list(doc_id::VARCHAR ORDER BY rank) AS got FROM bmr WHERE rank <= 4 GROUP BY query_id),
w0 AS (SELECT item_id AS case_id, {_NAMES} AS benchmark_id, text AS a, coalesce(gold, []) AS gold, coalesce(got, []) AS got FROM benchmark LEFT JOIN gd ON gd.query_id = item_id LEFT JOIN tp ON tp.query_id = item_id),
w1 AS (SELECT *, len(gold) > 0 AS has_gold, case_id % 5 = 4 AS fail_closed, CASE WHEN case_id % 5 = 4 THEN CASE benchmark_id WHEN 'fever' THEN 'not_enough_info' ELSE '{tx.SENTINEL}' END
   WHEN benchmark_id = 'fever' THEN CASE case_id % 4 WHEN 0 THEN 'supports' WHEN 1 THEN 'Not_enough_info' ELSE 'refutes' END
   ELSE CASE case_id % 4 WHEN 0 THEN '{tx.SENTINEL}' WHEN 1 THEN trim('The ' || a || '.') ELSE trim(a || ' and more') END END AS prediction,
   CASE WHEN case_id % 5 = 4 OR case_id % 4 = 0 THEN [] ELSE got[1:2] END AS cited FROM w0),
w2 AS (SELECT *, benchmark_id = 'fever' AS fv, lower(prediction) AS lp, len(list_intersect(cited, gold)) AS both_, {_WORDS.format("prediction")} AS pw, {_WORDS.format("a")} AS gw FROM w1),
w3 AS (SELECT *, coalesce(list_sum(list_transform(list_distinct(pw), lambda x: least(len(list_filter(pw, lambda y: y = x)), len(list_filter(gw, lambda y: y = x))))), 0)::DOUBLE AS k,
   NOT has_gold OR list_has_all(cited, gold) AS uni, len(list_intersect(gold, cited)) > 0 AS any_cited, len(list_intersect(gold, got)) > 0 AS any_got FROM w2),
w4 AS (SELECT case_id, benchmark_id, prediction, fail_closed, CASE WHEN has_gold THEN any_got END AS retrieval_any_gold, CASE WHEN has_gold THEN list_has_all(got, gold) END AS retrieval_complete_gold,
   both_ / nullif(len(cited), 0)::DOUBLE AS citation_precision, both_ / nullif(len(gold), 0)::DOUBLE AS citation_recall,
   CASE WHEN fv THEN lp = CASE WHEN has_gold THEN 'supports' ELSE 'not_enough_info' END END AS label_correct,
   CASE WHEN fv THEN NULL WHEN has_gold THEN (pw = gw)::INT::DOUBLE ELSE (lp = '{tx.SENTINEL.lower()}')::INT::DOUBLE END AS answer_exact_match,
   CASE WHEN fv THEN NULL WHEN NOT has_gold THEN (lp = '{tx.SENTINEL.lower()}')::INT::DOUBLE WHEN len(pw) = 0 OR len(gw) = 0 THEN (len(pw) = len(gw))::INT::DOUBLE ELSE 2 * k / (len(pw) + len(gw)) END AS answer_f1,
   CASE WHEN fv THEN NULL ELSE (lp = '{tx.SENTINEL.lower()}') = NOT has_gold END AS answerability_correct,
   CASE WHEN fv THEN NULL WHEN benchmark_id = 'natural_questions' AND has_gold THEN any_got WHEN has_gold THEN list_has_all(got, gold) END AS retrieval_any_complete_evidence_set,
   CASE WHEN fv THEN CASE WHEN lp = 'not_enough_info' THEN NOT has_gold AND len(cited) = 0 ELSE any_cited END WHEN benchmark_id = 'natural_questions' AND has_gold THEN any_cited ELSE uni END AS evidence_complete,
   CASE WHEN fv THEN NULL ELSE uni END AS legacy_union_evidence_complete, fv FROM w3),
scored AS (SELECT * EXCLUDE (fv), CASE WHEN fv THEN label_correct ELSE answer_exact_match > 0 END AND evidence_complete AS joint_correct, CASE WHEN fv THEN NULL ELSE answer_exact_match > 0 AND legacy_union_evidence_complete END AS legacy_union_joint_correct FROM w4)"""


def _scored(spark, d):
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("case_id"), F.when(F.col("item_id") % 3 == 0, "hotpotqa").when(F.col("item_id") % 3 == 1, "natural_questions").otherwise("fever").alias("benchmark_id"), F.col("text").alias("query"), F.col("text").alias("a"))
    found = _lexical(spark, d)
    gold = _gold(spark, d, found).select(F.col("query_id").alias("case_id"), F.col("doc_id").cast("string").alias("document_id"))
    has = gold.select("case_id").distinct().withColumn("some", F.lit(True))
    items = items.join(has, "case_id", "left").withColumn("some", F.coalesce("some", F.lit(False)))
    cases = items.select("case_id", "benchmark_id", "query", F.when(F.col("some"), F.array("a")).otherwise(F.array().cast("array<string>")).alias("answers"), F.when(F.col("some"), "supports").otherwise("not_enough_info").alias("label"), F.when(F.col("some"), "answerable").otherwise("unanswerable").alias("answerability"))
    ranked = _bm25_ranks(found, 4).select(F.col("query_id").alias("case_id"), F.col("doc_id").cast("string").alias("document_id"), F.lit("").alias("title"), F.lit("").alias("text"), "rank")
    work = scoring.work_items(cases, ranked, gold, gold.withColumn("vote", F.col("document_id")))
    c, fever = F.col("case_id"), F.col("benchmark_id") == "fever"
    label = F.when(c % 4 == 0, "supports").when(c % 4 == 1, "Not_enough_info").otherwise("refutes")
    said = F.when(c % 4 == 0, tx.SENTINEL).when(c % 4 == 1, F.concat(F.lit("The "), "a", F.lit("."))).otherwise(F.concat("a", F.lit(" and more")))
    results = items.where("case_id % 5 <> 4").select("case_id", F.when(fever, label).otherwise(said).alias("prediction"), F.when(c % 4 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("D1"), F.lit("D2"))).alias("citation_ids"))
    return scoring.case_results(work, results)


@named(f"WITH {_SCORED} SELECT case_id, prediction, fail_closed, " + ", ".join(m if m not in ("citation_precision", "citation_recall", "answer_f1") else f"round({m}, 9) AS {m}" for m in scoring.CASE_METRICS) + " FROM scored")
def case_scoring(spark, d):
    """Each item as a case: prediction, citations and evidence against gold; a fifth of them without a result."""
    rounded = [F.round(m, 9).alias(m) if m in ("citation_precision", "citation_recall", "answer_f1") else F.col(m) for m in scoring.CASE_METRICS]
    return _scored(spark, d).select("case_id", "prediction", "fail_closed", *rounded)


@named(f"""WITH {_SCORED}, b AS (SELECT benchmark_id, count(*) AS case_count, count(*) FILTER (WHERE fail_closed) AS fail_closed_count, {", ".join(f"avg({m}::INT::DOUBLE) AS {m}" if m not in ("citation_precision", "citation_recall", "answer_f1", "answer_exact_match") else f"avg({m}) AS {m}" for m in scoring.CASE_METRICS)} FROM scored GROUP BY benchmark_id)
SELECT benchmark_id, case_count, fail_closed_count, round(joint_correct, 9) AS joint_correct, round(answer_f1, 9) AS answer_f1, round(citation_precision, 9) AS citation_precision, round(label_correct, 9) AS label_correct FROM b
UNION ALL SELECT 'macro', sum(case_count)::BIGINT, NULL, round(avg(joint_correct), 9), NULL, NULL, NULL FROM b""")
def macro_joint(spark, d):
    """Means by benchmark, and over benchmarks."""
    out = scoring.aggregate(_scored(spark, d))
    return out.select("benchmark_id", "case_count", "fail_closed_count", *[F.round(c, 9).alias(c) for c in ("joint_correct", "answer_f1", "citation_precision", "label_correct")])


_ITEMS = "it AS (SELECT doc_id, 'lane-' || doc_id % 3 AS lane, CASE quality WHEN 1 THEN 'answer' ELSE 'abstain_absent' END AS expected, CASE WHEN doc_id % 11 = 0 THEN 'invalid_failclosed' WHEN toxic = 0 THEN 'answer' ELSE 'abstain_absent' END AS got, doc_id % 11 <> 0 AS ok FROM labels)"
_FA95, _FR95 = _wilson_sql("fa", "un"), _wilson_sql("fr", "an")


@named(f"""WITH {_ITEMS}, l AS (SELECT lane, * EXCLUDE (lane) FROM it UNION ALL SELECT 'all', * EXCLUDE (lane) FROM it),
c AS (SELECT lane, count(*) AS n, count(*) FILTER (WHERE expected = 'answer') AS an, count(*) FILTER (WHERE expected <> 'answer') AS un, count(*) FILTER (WHERE ok) AS valid, count(*) FILTER (WHERE got = expected) AS correct,
  count(*) FILTER (WHERE expected <> 'answer' AND got = 'answer') AS fa, count(*) FILTER (WHERE expected = 'answer' AND got <> 'answer') AS fr FROM l GROUP BY lane)
SELECT lane, n AS case_count, valid AS contract_valid_count, correct AS action_correct_count, fa AS false_answer_count, fr AS false_refusal_count, round(fa / nullif(un, 0)::DOUBLE, 9) AS false_answer_rate, round({_FA95[0]}, 9) AS false_answer_low, round({_FA95[1]}, 9) AS false_answer_high,
  round(fr / nullif(an, 0)::DOUBLE, 9) AS false_refusal_rate, round({_FR95[0]}, 9) AS false_refusal_low, round({_FR95[1]}, 9) AS false_refusal_high FROM c""")
def action_policy_metrics(spark, d):
    """Answers and abstentions against what was expected, overall and by lane."""
    q = F.when(F.col("quality") == 1, "answer").otherwise("abstain_absent")
    items = table(spark, d, "labels").select(F.concat(F.lit("lane-"), (F.col("doc_id") % 3).cast("string")).alias("lane"), q.alias("expected_action"), F.when(F.col("toxic") == 0, "answer").otherwise("abstain_absent").alias("actual_action"), (F.col("doc_id") % 11 != 0).alias("contract_valid"))
    both = scoring.action_policy(items).withColumn("lane", F.lit("all")).unionByName(scoring.action_policy(items, "lane"))
    ends = [F.round(F.get(f"{c}_95ci", F.lit(i)), 9).alias(f"{c}_{end}") for c in ("false_answer", "false_refusal") for i, end in enumerate(("low", "high"))]
    return both.select("lane", "case_count", "contract_valid_count", "action_correct_count", "false_answer_count", "false_refusal_count", F.round("false_answer_rate", 9).alias("false_answer_rate"), F.round("false_refusal_rate", 9).alias("false_refusal_rate"), *ends)


_TASKS = """t AS (SELECT doc_id AS task_id, doc_id // 4 AS group_id, CASE WHEN doc_id // 4 % 2 = 0 THEN 'generated_claim_support' ELSE 'required_claim_coverage' END AS kind, CASE WHEN doc_id % 5 = 0 THEN 'high' ELSE 'low' END AS severity, quality, toxic FROM labels),
k AS (SELECT *, CASE WHEN kind = 'generated_claim_support' THEN 'supported' ELSE 'covered' END AS yes, CASE WHEN kind = 'generated_claim_support' THEN 'unsupported' ELSE 'missing' END AS no_ FROM t),
v AS (SELECT *, CASE WHEN quality = 1 THEN yes ELSE no_ END AS human, CASE WHEN group_id % 7 = 0 THEN NULL WHEN toxic = 0 THEN yes ELSE no_ END AS p, CASE WHEN group_id % 9 = 0 THEN NULL WHEN task_id % 3 > 0 THEN yes ELSE no_ END AS s, CASE WHEN group_id % 4 = 0 THEN NULL WHEN task_id % 5 > 0 THEN yes ELSE no_ END AS a0 FROM k),
n AS (SELECT *, max((p IS DISTINCT FROM s OR p IS NULL OR s IS NULL)::INT) OVER (PARTITION BY group_id) = 1 AS third FROM v),
c AS (SELECT *, CASE WHEN third THEN a0 END AS a FROM n),
e AS (SELECT *, coalesce(p = s, false) AS agree, a IS NULL OR (a = yes AND NOT coalesce(p = a, false) AND NOT coalesce(s = a, false)) AS bad FROM c),
pr AS (SELECT task_id, severity, human, yes, CASE WHEN agree THEN p WHEN bad THEN no_ ELSE a END AS decision, NOT agree AND bad AS fail_closed, CASE WHEN third THEN CASE WHEN group_id % 4 = 0 THEN 4 ELSE 3 END ELSE 2 END AS n_consulted FROM e)"""


def _cascade(spark, d):
    i, g = F.col("doc_id"), F.floor(F.col("doc_id") / 4).cast("long")
    kind = F.when(g % 2 == 0, "generated_claim_support").otherwise("required_claim_coverage")
    t = table(spark, d, "labels").select(i.alias("task_id"), g.alias("group_id"), kind.alias("task_type"), F.lit("c").alias("case_id"), F.lit("l").alias("lane"), F.when(i % 5 == 0, "high").otherwise("low").alias("severity"), "quality", "toxic")
    yes, no = judging.accept_of(F.col("task_type")), judging.fallback_of(F.col("task_type"))
    parts = None
    for name, accepts, gap in (("first", F.col("toxic") == 0, 7), ("second", F.col("task_id") % 3 > 0, 9), ("third", F.col("task_id") % 5 > 0, 4), ("last", F.lit(None).cast("boolean"), 1)):
        v = F.collect_list(F.struct("task_id", F.when(accepts, yes).otherwise(no).alias("decision")))
        one = t.groupBy("group_id").agg(v.alias("verdicts")).select(F.lit(name).alias("profile"), "group_id", (F.col("group_id") % gap != 0).alias("valid"), "verdicts")
        parts = one if parts is None else parts.unionByName(one)
    human = t.select("task_id", F.when(F.col("quality") == 1, yes).otherwise(no).alias("human"))
    return judging.simulate(t.drop("quality", "toxic"), parts, "disagreement", "first", "second", "third", "last"), human


@named(f"WITH {_TASKS} SELECT task_id, decision, fail_closed, n_consulted FROM pr")
def cascade_simulation(spark, d):
    """A second judge always, a third where the two are not one on a whole group, the last where the third gave nothing."""
    return _cascade(spark, d)[0].select("task_id", "decision", "fail_closed", F.size("consulted").alias("n_consulted"))


@named(f"""WITH {_TASKS}, sl AS (SELECT unnest(['all', 'severity=' || severity]) AS slice, * FROM pr),
m AS (SELECT slice, count(*)::DOUBLE AS n, count(*) FILTER (WHERE human = decision) AS same, count(*) FILTER (WHERE decision = yes AND human <> yes) AS fa, count(*) FILTER (WHERE human = yes AND decision <> yes) AS fr, count(*) FILTER (WHERE fail_closed) AS fc FROM sl GROUP BY slice),
h AS (SELECT slice, human AS label, count(*) AS c FROM sl GROUP BY ALL), dd AS (SELECT slice, decision AS label, count(*) AS c FROM sl GROUP BY ALL),
x AS (SELECT h.slice, sum(h.c * dd.c)::DOUBLE AS both_ FROM h JOIN dd ON h.slice = dd.slice AND h.label = dd.label GROUP BY h.slice)
SELECT slice, n::BIGINT AS task_count, round(same / n, 9) AS exact_agreement, round((same / n - both_ / (n * n)) / (1 - both_ / (n * n)), 9) AS cohen_kappa, fa AS false_accept_count, fr AS false_reject_count, fc AS fail_closed_count FROM m JOIN x USING (slice)""")
def cascade_score(spark, d):
    """The cascade against a person, overall and by severity."""
    out = judging.score(*_cascade(spark, d), ["severity"])
    return out.select("slice", "task_count", F.round("exact_agreement", 9).alias("exact_agreement"), F.round("cohen_kappa", 9).alias("cohen_kappa"), "false_accept_count", "false_reject_count", "fail_closed_count")


@named(f"""WITH {_SCORED}, g AS (SELECT *, evidence_complete AS r FROM scored), x AS (SELECT unnest([benchmark_id, 'all']) AS benchmark_id, joint_correct AS l, r FROM g)
SELECT benchmark_id, count(*) FILTER (WHERE r AND NOT l) AS wins, count(*) FILTER (WHERE l AND NOT r) AS losses, count(*) FILTER (WHERE l = r) AS unchanged FROM x GROUP BY benchmark_id""")
def paired_by_benchmark(spark, d):
    """Cases whose evidence alone is complete against those that are right jointly, by benchmark."""
    rows = _scored(spark, d)
    return gates.paired_by_benchmark(rows.select("case_id", "benchmark_id", "joint_correct"), rows.select("case_id", "benchmark_id", F.col("evidence_complete").alias("joint_correct"))).drop("p_value")

"""Features and choices over candidates, and the bake-off of judges, against plain Python on small random inputs."""

import math
import random
import re
import statistics

import pytest
from pyspark.sql import functions as F

from rankloom.functions.text import SENTINEL
from rankloom.operators import judging, scoring, selectors, verifiers

WORDS = ["red", "dog", "The", "an", "cat", "Straße", "one-two", "9"]


def plain_norm(text):
    text = re.sub(r"[!-/:-@\[-`{-~]", "", (text or "").casefold())
    return " ".join(re.sub(r"\b(a|an|the)\b", " ", text).split())


def phrase(rng, least, most):
    return " ".join(rng.choice(WORDS) for _ in range(rng.randint(least, most)))


READER = "case_id string, query string, candidates array<struct<document_id: string, answer: string, score: double>>"
BASELINE = "case_id string, prediction string, cited_document_ids array<string>"


@pytest.fixture(scope="module")
def reader():
    rng = random.Random(5)
    raw, base = [], []
    for i in range(60):
        some = [(f"d{j}", phrase(rng, 1, 2) if rng.random() < 0.7 else "", rng.choice([0.1, 0.25, 0.5, 0.75])) for j in range(rng.randint(0, 5))]
        raw.append((f"c{i:02}", rng.choice(["What ", "is ", "¿", ""]) + phrase(rng, 0, 5), some))
        base.append((f"c{i:02}", phrase(rng, 1, 2) if rng.random() < 0.8 else SENTINEL, [f"d{j}" for j in range(rng.randint(0, 3))]))
    return raw, base


def parts(candidates):
    return [c for c in candidates if c[1]], [c for c in candidates if not c[1]]


def at(scores, n):
    scores = sorted(scores, reverse=True)
    return scores[n] if n < len(scores) else 0.0


def test_action_features_equal_a_plain_count(spark, reader):
    raw, base = reader
    found = {r.case_id: dict(zip(verifiers.ACTION_FEATURES, r.features, strict=True)) for r in verifiers.action_features(spark.createDataFrame(raw, READER), spark.createDataFrame(base, BASELINE)).collect()}
    assert len(verifiers.ACTION_FEATURES) == 26 and len(found) == len(raw)
    for (case, query, candidates), (_, said, cited) in zip(raw, base, strict=True):
        f, (full, empty) = found[case], parts(candidates)
        top, none = at([c[2] for c in full], 0), at([c[2] for c in empty], 0)
        norms, own = [plain_norm(c[1]) for c in full], plain_norm(said)
        same = [c[2] for c, n in zip(full, norms, strict=True) if n == own]
        assert (f["max_nonempty_score"], f["max_empty_score"], f["nonempty_minus_empty"]) == (top, none, top - none)
        assert f["top_two_nonempty_gap"] == (top - at([c[2] for c in full], 1) if len(full) > 1 else top) and f["nonempty_to_empty_ratio"] == pytest.approx(top / (none + 1e-4))
        assert (f["max_baseline_answer_match_score"], f["baseline_answer_match_count"]) == (max(same, default=0), len(same))
        assert (f["nonempty_candidate_count"], f["largest_candidate_answer_consensus"]) == (len(full), max([norms.count(n) for n in norms], default=0))
        assert (f["baseline_citation_count"], f["baseline_prediction_token_count"], f["baseline_prediction_character_count"]) == (len(cited), len(own.split()), len(said))
        assert f["question_token_count"] == len(query.split()) and f["baseline_prediction_in_question"] == (own in plain_norm(query))
        kinds = [w for w in verifiers.QUESTION_TYPES if f[f"question_type_{w}"]]
        assert kinds == [w for w in verifiers.QUESTION_TYPES if re.match(rf"{w}(?![a-z0-9])", query.casefold())]


def test_verifier_features_equal_a_plain_count(spark, reader):
    raw, base = reader
    found = {r.case_id: dict(zip(verifiers.VERIFIER_FEATURES, r.features, strict=True)) for r in verifiers.verifier_features(spark.createDataFrame(raw, READER), spark.createDataFrame(base, BASELINE)).collect()}
    for (case, _, candidates), (_, said, cited) in zip(raw, base, strict=True):
        f, (full, empty) = found[case], parts(candidates)
        best = min(full, key=lambda c: -c[2]) if full else ("", "", 0.0)
        read, own = plain_norm(best[1]), plain_norm(said)
        for name, side in (("nonempty", full), ("empty", empty)):
            scores = [c[2] for c in side]
            assert (f[f"max_{name}_score"], f[f"second_{name}_score"], f[f"{name}_count"]) == (at(scores, 0), at(scores, 1), len(scores))
            assert f[f"mean_{name}_score"] == pytest.approx(statistics.mean(scores) if scores else 0)
        assert (f["baseline_prediction_token_count"], f["baseline_prediction_character_count"], f["reader_prediction_token_count"]) == (len(own.split()), len(own), len(read.split()))
        assert f["reader_exactly_agrees"] == (read != "" and read == own) and f["reader_substring_agrees"] == (read != "" and (read in own or own in read))
        assert (f["reader_document_was_cited"], f["baseline_citation_count"]) == (best[0] in cited, len(cited))


def test_abstentions(spark, reader):
    raw, _ = reader
    unsure = {r.case_id: r.abstain for r in verifiers.unsure(spark.createDataFrame(raw, READER), 0.3, -0.2).collect()}
    for case, _, candidates in raw:
        top, none = (at([c[2] for c in side], 0) for side in parts(candidates))
        assert unsure[case] == (top < 0.3 or top - none < -0.2)
    results = spark.createDataFrame([("a", "x", ["D1"]), ("b", SENTINEL.lower(), []), ("c", "y", ["D2"])], "case_id string, prediction string, citation_ids array<string>")
    out = {r.case_id: (r.prediction, r.citation_ids) for r in verifiers.abstained(results, spark.createDataFrame([("a", True), ("b", True)], "case_id string, abstain boolean")).collect()}
    assert out == {"a": (SENTINEL, []), "b": (SENTINEL.lower(), []), "c": ("y", ["D2"])}
    rows = spark.createDataFrame([("x", True, "unanswerable"), ("x", True, "answerable"), ("x", False, "unanswerable"), (SENTINEL, False, "unanswerable")], "p string, ok boolean, a string")
    labels = rows.select(verifiers.action_label(F.col("p"), F.col("ok"), F.col("a")).alias("l"), verifiers.abstention_utility(F.col("ok"), F.col("a")).alias("u")).collect()
    assert [r.l for r in labels] == [None, 0, 1, None] and [r.u for r in labels] == [1, -1, 1, 1]


def test_sweep_and_choice_of_a_model(spark):
    cases = [("m", "1", "x", 0.9, False, True), ("m", "2", "x", 0.6, True, False), ("m", "3", SENTINEL, 0.99, False, False), ("m", "4", "x", None, True, True), ("n", "1", "x", 0.9, False, True), ("n", "2", "x", 0.1, True, False), ("n", "3", SENTINEL, 0.99, False, False), ("n", "4", "x", 0.2, True, True)]
    df = spark.createDataFrame(cases, "model string, case_id string, prediction string, probability double, kept_correct boolean, abstention_correct boolean")
    swept = verifiers.action_sweep(df, (0.15, 0.5, 0.7))
    got = {(r.model, r.threshold): (r.joint_correct_rate, r.abstention_count, r.wins, r.losses) for r in swept.collect()}
    assert got[("m", 0.5)] == (0.5, 2, 1, 1) and got[("m", 0.7)] == (0.75, 1, 1, 0) and got[("n", 0.15)] == (0.75, 2, 1, 0) and got[("n", 0.5)] == (0.75, 1, 1, 0)
    pick = verifiers.chosen_model(swept, ["n", "m"]).first()
    assert (pick.model, pick.threshold) == ("n", 0.5) and verifiers.chosen_model(swept, ["m", "n"]).first().model == "m"


NLI = "case_id string, query string, candidates array<struct<document_id: string, entailment: double, contradiction: double, neutral: double>>, gold_label string, gold_document_ids array<string>, gold_evidence_sets array<array<string>>"


def test_evidence_of_claims(spark):
    raw = spark.createDataFrame(
        [
            ("a", "red dog", [("d1", 0.9, 0.0, 0.1), ("d2", 0.45, 0.2, 0.35)], "supports", ["d1", "d2"], [["d1"], ["d2", "d3"]]), ("b", "red dog", [("d1", 0.8, 0.8, 0.0)], "refutes", ["d1"], [["d1"]]),
            ("c", "cat", [("d1", 0.2, 0.7, 0.1)], "not_enough_info", [], []), ("d", "cat", [], "supports", ["d9"], [["d9"]]), ("e", "cat", [("d1", 0.1, 0.9, 0.0), ("d2", 0.0, 0.3, 0.7)], "refutes", ["d2"], [["d2"]]),
        ],
        NLI,
    )
    contexts = [("d1", "Red Dog", "the red dog ran"), ("d2", "Cat", "a cat")]
    work = spark.createDataFrame([(c, contexts) for c in "abcde"], "case_id string, contexts array<struct<document_id: string, title: string, text: string>>")
    base = spark.createDataFrame([("a", "supports", ["d3"]), ("b", "refutes", ["d1"]), ("c", "not_enough_info", []), ("d", "supports", ["d9"]), ("e", "supports", ["d2"])], BASELINE)
    f = {(r.case_id, r.document_id): dict(zip(verifiers.EVIDENCE_FEATURES, r.features, strict=True)) for r in verifiers.evidence_features(raw, work, base).collect()}
    assert set(f) == {("a", "d1"), ("a", "d2"), ("b", "d1"), ("c", "d1"), ("e", "d1"), ("e", "d2")} and len(verifiers.EVIDENCE_FEATURES) == 16
    d2 = f["a", "d2"]
    assert (d2["inverse_rank"], d2["rank"], d2["relation"], d2["top"], d2["relation_to_top"], d2["cited"], d2["label_agrees"], d2["is_supports"], d2["is_refutes"]) == (0.5, 2, 0.45, 0.9, 0.5, 0, 1, 1, 0)
    assert f["a", "d1"]["query_in_title"] == 1 and f["a", "d1"]["text_words"] == 4 and f["b", "d1"]["is_supports"] == 1 and f["b", "d1"]["label_agrees"] == 0
    assert f["c", "d1"]["relation"] == 0.7 and f["c", "d1"]["is_refutes"] == 0 and f["e", "d2"]["relation"] == pytest.approx(0.3) and f["e", "d1"]["is_refutes"] == 1
    scored = spark.createDataFrame([("a", "d1", 1, 0.4), ("a", "d2", 2, 0.8), ("b", "d1", 1, 0.1), ("c", "d1", 1, 0.9), ("e", "d1", 1, 0.3), ("e", "d2", 2, 0.3)], "case_id string, document_id string, rank int, probability double")
    out = {r.case_id: r for r in verifiers.evidence_selection(raw, base, scored, 0.5).collect()}
    assert {c: (r.prediction, r.cited_document_ids) for c, r in out.items()} == {"a": ("supports", ["d2", "d3"]), "b": ("supports", ["d1"]), "c": ("not_enough_info", []), "d": ("not_enough_info", []), "e": ("refutes", ["d1"])}
    assert out["a"].joint_correct and out["a"].citation_precision == 0.5 and not out["b"].joint_correct and out["b"].evidence_complete and out["c"].joint_correct and out["c"].citation_precision is None
    assert not out["d"].joint_correct and not out["d"].evidence_complete and out["e"].label_correct and not out["e"].joint_correct
    assert scoring.NO_INFO == "not_enough_info" and verifiers.evidence_selection(raw.limit(0), base, scored, 0.5).count() == 0


@pytest.mark.parametrize("family", ["random_forest", "gradient_boosting"])
def test_families_of_models(spark, family, monkeypatch):
    small = {"random_forest": lambda m: m.setNumTrees(10), "gradient_boosting": lambda m: m.setMaxIter(5)}[family]
    grown = selectors.FAMILIES[family]
    monkeypatch.setitem(selectors.FAMILIES, family, lambda: small(grown()))
    rng = random.Random(2)
    rows = [(f"c{i}", [rng.gauss(2.0 * (i % 4 == 0), 0.6), rng.random()], int(i % 4 == 0)) for i in range(200)]
    scored = selectors.out_of_fold(spark.createDataFrame(rows, "case_id string, features array<double>, label int"), "case_id", folds=2, family=family, balanced=True)
    assert scored.count() == 200 and scored.agg(F.avg(((F.col("probability") > 0.5) == (F.col("label") == 1)).cast("int"))).first()[0] > 0.8


TASK = "struct<task_id: string, case_id: string, task_type: string, lane: string, severity: string>"
CALL = "struct<latency_ms: double, cost: double, usage: map<string, double>>"
RECORD = f"profile string, group_id string, valid boolean, tasks array<{TASK}>, verdicts array<struct<task_id: string, decision: string>>, calls array<{CALL}>, retry_history array<struct<valid: boolean, calls: array<{CALL}>>>"


def test_bakeoff(spark):
    rng = random.Random(3)
    kinds = {judging.SUPPORT_TASK: judging.SUPPORT_STATUSES, "required_claim_coverage": judging.COVERAGE_STATUSES}
    human, records = {}, []
    for profile in ("p", "q"):
        for g in range(30):
            kind = rng.choice(list(kinds))
            tasks = [(f"t{g}-{k}", f"c{g}", kind, "l", rng.choice(["low", "high", "critical"])) for k in range(rng.randint(1, 3))]
            for t in tasks:
                human.setdefault(t[0], None)
            call = lambda: (rng.choice([None, 10.0, 20.0, 35.5]), rng.choice([None, 0.25, 0.5]) if profile == "p" else None, {"in": float(rng.randint(1, 9))})
            valid = rng.random() < 0.85
            verdicts = [(t[0], rng.choice(kinds[kind])) for t in tasks if rng.random() < 0.9] if valid else []
            retries = [(rng.random() < 0.5, [call()])] if rng.random() < 0.3 else rng.choice([[], None])
            records.append((profile, f"g{g}", valid, tasks, verdicts, [call() for _ in range(rng.randint(0, 2))], retries))
    support = {t[0] for r in records for t in r[3] if t[2] == judging.SUPPORT_TASK}
    both = {t[0] for r in records for t in r[3] if t[2] != judging.SUPPORT_TASK}
    human = {t: rng.choice(judging.SUPPORT_STATUSES if t in support and t not in both else judging.COVERAGE_STATUSES) for t in human}
    found = {r.profile: r for r in judging.bakeoff(spark.createDataFrame(records, RECORD), spark.createDataFrame(list(human.items()), "task_id string, human string")).collect()}
    for profile, r in found.items():
        mine = [x for x in records if x[0] == profile]
        tasks = [(t, dict(x[4]).get(t[0])) for x in mine for t in x[3]]
        pairs = [(t, human[t[0]], d) for t, d in tasks if d is not None]
        yes = lambda t: "supported" if t[2] == judging.SUPPORT_TASK else "covered"
        accepts = [t for t, h, d in pairs if d == yes(t) != h]
        assert (r.task_count, r.valid_task_count, r.false_accept_count) == (len(tasks), len(pairs), len(accepts)) and r.false_reject_count == sum(h == yes(t) != d for t, h, d in pairs)
        assert r.severe_false_accept_count == sum(t[4] in judging.SEVERE for t in accepts) and r.disagreement_count == sum(h != d for _, h, d in pairs)
        assert r.exact_agreement == pytest.approx(sum(h == d for _, h, d in pairs) / len(pairs)) and r.validity_rate == pytest.approx(len(pairs) / len(tasks))
        assert r.first_pass_valid_task_count == sum(len(x[3]) for x in mine if (x[6][0][0] if x[6] else x[2])) and r.retried_group_count == sum(bool(x[6]) for x in mine)
        calls, before = [c for x in mine for c in x[5]], [c for x in mine for a in x[6] or [] for c in a[1]]
        ms = sorted(c[0] for c in calls if c[0] is not None)
        assert [r.latency_p50, r.latency_p95, r.latency_p99] == [ms[round((len(ms) - 1) * q)] for q in (0.5, 0.95, 0.99)] and r.latency_mean == pytest.approx(statistics.mean(ms))
        assert (r.call_count, r.call_count_with_retries, r.usage_totals) == (len(calls), len(calls + before), {"in": sum(c[2]["in"] for c in calls)})
        cost = lambda cs: sum(c[1] for c in cs if c[1] is not None) if any(c[1] is not None for c in cs) else None
        assert r.reported_cost == cost(calls) and r.reported_cost_with_retries == cost(calls + before)
        assert r.all_valid == (len(tasks) == len(pairs)) and not r.enough_agreement and not math.isnan(r.cohen_kappa)
    assert found["q"].reported_cost is None
    with pytest.raises(Exception, match="no person"):
        judging.bakeoff(spark.createDataFrame(records, RECORD), spark.createDataFrame([], "task_id string, human string")).collect()

"""Case scoring, judges, gates, batch life cycles, cases and selectors against small hand-made inputs."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from rankloom.functions.text import SENTINEL
from rankloom.operators import cases, gates, judging, lifecycle, ranking, scoring, selectors


def got(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.select(*cols).collect()), key=str)


WORK = "case_id string, benchmark_id string, query string, answers array<string>, label string, answerability string"


def work(spark, *rows):
    c = spark.createDataFrame([(i, b, "q", a, lab, ans) for i, b, a, lab, ans, *_ in rows], WORK)
    ranked = spark.createDataFrame([(r[0], d, "t", "x", k) for r in rows for k, d in enumerate(r[5], 1)], "case_id string, document_id string, title string, text string, rank int")
    votes = [(r[0], v, d) for r in rows for v, s in enumerate(r[6]) for d in s]
    votes = spark.createDataFrame(votes, "case_id string, vote int, document_id string")
    return scoring.work_items(c, ranked, votes.select("case_id", "document_id"), votes)


def test_cases_are_scored_by_their_benchmarks_rules(spark):
    w = work(
        spark, ("nq", "natural_questions", ["Paris"], None, "answerable", ["d1", "d9"], [["d1"], ["d2"]]), ("hp", "hotpotqa", ["x"], None, "answerable", ["d1", "d2"], [["d1", "d2"]]),
        ("f1", "fever", [], "supports", "answerable", ["p1", "p2"], [["p1"], ["p2", "p3"]]), ("f2", "fever", [], "not_enough_info", "unanswerable", ["p1"], []), ("no", "natural_questions", [], None, "unanswerable", ["d1"], []), ("gone", "fever", [], "not_enough_info", "unanswerable", [], []),
    )
    said = spark.createDataFrame([("nq", " The Paris. ", ["D1"]), ("hp", "x", ["D1"]), ("f1", "SUPPORTS", ["D1"]), ("f2", "not_enough_info", ["D1"]), ("no", SENTINEL, [])], "case_id string, prediction string, citation_ids array<string>")
    rows = {r.case_id: r for r in scoring.case_results(w, said).collect()}
    nq, hp = rows["nq"], rows["hp"]
    assert nq.joint_correct and not nq.legacy_union_joint_correct and nq.answer_f1 == 1.0 and nq.retrieval_any_complete_evidence_set and not nq.retrieval_complete_gold and (nq.citation_precision, nq.citation_recall) == (1.0, 0.5)
    assert not hp.joint_correct and hp.answer_exact_match == 1.0 and not hp.evidence_complete and hp.retrieval_complete_gold
    assert rows["f1"].joint_correct and rows["f1"].answer_f1 is None and not rows["f2"].joint_correct and rows["f2"].label_correct
    assert rows["no"].joint_correct and rows["no"].answerability_correct and rows["no"].retrieval_any_gold is None
    assert rows["gone"].fail_closed and rows["gone"].prediction == "not_enough_info" and rows["gone"].joint_correct
    m = {r.benchmark_id: r for r in scoring.aggregate(scoring.case_results(w, said)).collect()}
    assert m["macro"].case_count == 6 and m["macro"].joint_correct == pytest.approx((1 + 0 + 2 / 3) / 3) and m["fever"].fail_closed_count == 1
    with pytest.raises(Exception, match="not given"):
        scoring.case_results(w, said.limit(0).union(spark.createDataFrame([("nq", "x", ["D7"])], said.schema))).collect()


def test_consistency_and_routes(spark):
    runs = spark.createDataFrame([("a", "p", "The Cat", ["D1"]), ("a", "q", "dog", ["D2"]), ("a", "r", "Dog.", ["D3"]), ("b", "p", "x", ["D1"]), ("b", "q", "y", []), ("b", "r", "z", [])], "case_id string, run string, prediction string, citation_ids array<string>")
    assert got(scoring.consistency(runs, "p"), "case_id", "prediction", "citation_ids", "votes") == [("a", "dog", ["D2"], 2), ("b", "x", ["D1"], 1)]
    assert got(scoring.consistency(runs, "p", unite=True), "case_id", "citation_ids")[0] == ("a", ["D2", "D3"])
    one = spark.createDataFrame([("a", "hotpotqa"), ("b", "fever")], "case_id string, benchmark_id string")
    assert got(scoring.composed_report({"x": one, "y": one}, {"hotpotqa": "x", "fever": "y"}), "case_id") == [("a",), ("b",)]
    with pytest.raises(Exception, match="two reports"):
        scoring.composed_report({"x": one, "y": one.withColumn("benchmark_id", F.lit("fever"))}, {"hotpotqa": "x", "fever": "y"}).collect()


def test_action_policy(spark):
    items = spark.createDataFrame([("1", "l", "answer", "answer", True), ("2", "l", "answer", "abstain_absent", True), ("3", "l", "abstain_absent", "answer", True), ("4", None, "abstain_absent", "answer", False)], "id string, lane string, expected_action string, actual_action string, contract_valid boolean")
    r = scoring.action_policy(items).first()
    assert (r.case_count, r.false_answer_count, r.false_refusal_count, r.action_correct_count, r.false_answer_rate) == (4, 1, 1, 1, 0.5) and 0 < r.false_answer_95ci[0] < 0.5
    assert got(scoring.action_policy(items, "lane"), "lane", "case_count", "false_answer_rate") == [("l", 3, 1.0)]
    assert scoring.passes_policy(scoring.action_policy(items), 0.5, 0.5).first().passes and not scoring.passes_policy(scoring.action_policy(items.where("expected_action = 'answer'")), 1.0, 1.0).first().passes


def test_structured_summary_and_diagnostics(spark):
    items = spark.createDataFrame([("a", "l", True, True, 2, 1, True), ("b", "l", True, False, 0, 0, False), ("c", "m", False, False, 2, 2, None)], "id string, lane string, contract_valid boolean, action_correct boolean, citation_count int, valid_citation_count int, case_pass boolean")
    r = scoring.structured_summary(items).first()
    assert (r.contract_valid_rate, r.citation_existence_precision, r.end_to_end_case_pass_rate, r.failure_count) == (0.6667, 0.75, 0.5, 1) and got(scoring.failures(items), "id") == [("b",)]
    assert got(scoring.structured_summary(items, "lane"), "lane", "case_count", "end_to_end_case_pass_rate") == [("l", 2, 0.5), ("m", 1, None)]
    c = spark.createDataFrame([("a", ["x", "y"], ["x"], [["x"], ["x", "y"]])], "case_id string, gold array<string>, retrieved array<string>, claims array<array<string>>")
    d = scoring.retrieval_diagnostics(c).first()
    assert d.retrieval_any_gold_evidence and not d.retrieval_complete_gold_evidence and (d.retrieval_required_claim_count, d.retrieval_covered_required_claim_count) == (2, 1)


def test_support_and_coverage_verdicts(spark):
    claims = [{"text": "It waits 20 seconds.", "citation_ids": ["S1"]}, {"text": "It is not safe.", "citation_ids": ["S2"]}]
    sources = {"S1": "it waits about 20 seconds here", "S2": "it is never safe"}
    v = lambda i, status, evidence, **kw: {"generated_claim_id": i, "status": status, "evidence": evidence, "rationale": "r"} | kw
    judged = lambda *vs: {"schema_version": "1.0.0", "claim_verdicts": list(vs)}
    one, two = v("g1", "supported", [{"citation_id": "S1", "quote": "about 20"}]), v("g2", "supported", [{"citation_id": "S2", "quote": "never"}])
    texts = lambda m: json.dumps([{"citation_id": k, "text": t} for k, t in m.items()])
    changed = {"S1": "it waits 5 seconds, about 20", "S2": "it is safe"}
    again, always = [{"citation_id": "S1", "quote": "about 20"}] * 2, [{"citation_id": "S2", "quote": "always"}]
    runs = [
        (judged(one, two), sources, [], 2),
        (judged(two, one), sources, ["uncited_evidence", "uncited_evidence", "id_order"], 0),
        (judged(one, v("g2", "unsupported", [], rationale=" ")), sources, ["rationale"], 0),
        (judged(one, v("g2", "supported", always)), changed, ["exact_anchor_missing", "quote_not_found", "explicit_negation_missing"], 0),
        (judged(v("g1", "supported", []), v("g2", "maybe", None)), sources, ["evidence_required", "status", "evidence_type"], 0),
        (judged(v("g1", "supported", again), v("g2", "unsupported", always, more=1)), sources, ["duplicate_evidence", "verdict_fields", "unsupported_with_evidence", "quote_not_found"], 0),
        (judged(v("g1", "contradicted", [{"citation_id": "S1", "quote": " "}, 3]), 7), sources, ["evidence_fields", "empty_quote", "verdict_type", "id_order"], 0),
        ({"schema_version": "2", "claim_verdicts": 1, "x": 2}, sources, ["fields", "schema_version", "verdicts_type", "id_order"], 0),
        ([], sources, ["root_type"], 0),
    ]
    d = spark.createDataFrame([(n, json.dumps(j), json.dumps(claims), texts(o)) for n, (j, o, *_) in enumerate(runs)], "n int, j string, c string, o string")
    got = {r.n: r.s for r in d.select("n", judging.support(F.col("j"), F.col("c"), F.col("o")).alias("s")).collect()}
    assert [(sorted(got[n].codes), got[n].accepted, got[n].valid) for n in range(len(runs))] == [(sorted(codes), good, not codes) for *_, codes, good in runs]
    c = lambda i, status, links, **kw: {"required_claim_id": i, "status": status, "generated_claim_ids": links, "rationale": "r"} | kw
    covered = lambda *vs: {"schema_version": "1.0.0", "required_claim_verdicts": list(vs)}
    need, have = ["waits 20 seconds", "not safe"], [x["text"] for x in claims]
    runs = [
        (covered(c("r1", "covered", ["g1"]), c("r2", "missing", [])), [], 1),
        (covered(c("r1", "covered", ["g2"]), c("r2", "covered", ["g1", "g1", "g9"])), ["coverage_exact_anchor_missing", "duplicate_generated_claim_id", "unknown_generated_claim_id"], 0),
        (covered(c("r1", "missing", ["g1"]), c("r2", "contradicted", [])), ["missing_with_links", "verdict_without_links"], 0),
        (covered(c("r1", "covered", "g1")), ["generated_claim_ids_type", "verdict_without_links", "coverage_exact_anchor_missing", "id_order"], 0),
        (covered(c("r1", "covered", ["g1"]), c("r2", "covered", ["g1"])), ["coverage_explicit_negation_missing"], 0),
    ]
    d = spark.createDataFrame([(n, json.dumps(j), need, have) for n, (j, *_) in enumerate(runs)], "n int, j string, need array<string>, have array<string>")
    got = {r.n: r.s for r in d.select("n", judging.coverage(F.col("j"), F.col("need"), F.col("have")).alias("s")).collect()}
    assert [(sorted(got[n].codes), got[n].accepted) for n in range(len(runs))] == [(sorted(codes), good) for _, codes, good in runs]
    row = (json.dumps(judged(one, two)), json.dumps(claims), json.dumps([{"citation_id": k, "text": t} for k, t in sources.items()]), json.dumps(covered(c("r1", "covered", ["g1"]))), need[:1], have)
    d = spark.createDataFrame([row], "s string, c string, o string, k string, need array<string>, have array<string>").select(judging.support(F.col("s"), F.col("c"), F.col("o")).alias("s"), judging.coverage(F.col("k"), F.col("need"), F.col("have")).alias("k"))
    r = d.withColumn("p", judging.claim_level_pass(F.lit(True), F.col("s"), F.col("k"))).first()
    assert r.p and (r.s.accepted, r.s.rate, r.k.claims) == (2, 1.0, 1)


def test_agreement_of_people_and_judges(spark):
    ddl = "case_id string, lane string, claim_id string, status string, answer_sha256 string"
    human = spark.createDataFrame([("a", "s", "c1", "supported", "h"), ("a", "s", "c2", "unsupported", "h"), ("a", "s", "c3", "supported", "h"), ("a", "k", "r1", "missing", "h"), ("b", "s", "c1", "supported", "h"), ("c", "s", "c1", "supported", "h")], ddl)
    judge = spark.createDataFrame([("a", "s", "c1", "supported", "h"), ("a", "s", "c2", "supported", "h"), ("a", "k", "r1", "covered", "h"), ("b", "s", "c1", "supported", "other")], ddl)
    summary, apart, unmatched = judging.agreement(human, judge)
    assert got(summary, "lane", "n", "exact_agreement", "false_accept_count") == [("k", 1, 0.0, 1), ("s", 2, 0.5, 1)]
    assert got(apart, "claim_id", "kind") == [("c2", "label_disagreement"), ("c3", "missing_judge_verdict"), ("r1", "label_disagreement")]
    assert got(unmatched, "case_id", "problem") == [("b", "answer_hash_mismatch"), ("c", "missing_judgment")]
    pairs = [(random.Random(i).choice("xyz"), random.Random(i + 50).choice("xyz")) for i in range(40)]
    r = judging.kappa_of(spark.createDataFrame(pairs, "l string, r string"), "l", "r").first()
    p = sum(a == b for a, b in pairs) / 40
    e = sum(sum(a == x for a, _ in pairs) * sum(b == x for _, b in pairs) for x in "xyz") / 1600
    assert r.exact_agreement == pytest.approx(p) and r.cohen_kappa == pytest.approx((p - e) / (1 - e))
    assert judging.kappa_of(spark.createDataFrame([("x", "x")] * 3, "l string, r string"), "l", "r").first().cohen_kappa == 1.0
    assert got(judging.confusion(spark.createDataFrame([("x", "y")], "l string, r string"), "l", "r"), "cell", "n") == [("human=x|judge=y", 1)]


def plain_cascade(mode, tasks, votes, rate):
    """One group at a time, by dictionaries."""
    out = {}
    for g in {t[0] for t in tasks}:
        own = [t for t in tasks if t[0] == g]
        v = {k: votes.get((k, g), {}) for k in "psam"}
        yes, no = (lambda t: "supported" if t[2] == judging.SUPPORT_TASK else "covered"), (lambda t: "unsupported" if t[2] == judging.SUPPORT_TASK else "missing")
        bucket = int(hashlib.sha256(g.encode()).hexdigest()[:8], 16) / 0xFFFFFFFF
        second = {"single": False, "full_panel": True, "disagreement": True, "primary_failure": not v["p"] or any(v["p"].get(t[1]) != yes(t) for t in own), "severity_sample": any(t[3] == "high" for t in own) or bucket < rate or not v["p"]}[mode]
        third = mode == "full_panel" or (second and (not v["p"] or not v["s"] or any(v["p"].get(t[1]) != v["s"].get(t[1]) for t in own)))
        last = mode == "full_panel" or (third and not v["a"])
        for t in own:
            p, s = v["p"].get(t[1]), v["s"].get(t[1])
            if not second:
                out[t[1]] = (p or no(t), p is None)
                continue
            c = (v["a"].get(t[1]) if third else None) or (v["m"].get(t[1]) if last else None)
            if p is not None and p == s:
                out[t[1]] = (p, False)
            elif c is None or (c == yes(t) and c not in (p, s)):
                out[t[1]] = (no(t), True)
            else:
                out[t[1]] = (c, False)
    return out


@pytest.mark.parametrize("mode", ["single", "full_panel", "disagreement", "primary_failure", "severity_sample"])
def test_cascades_equal_a_plain_loop(spark, mode):
    rng = random.Random(5)
    tasks, votes, records = [], {}, []
    for i in range(40):
        kind = rng.choice([judging.SUPPORT_TASK, "required_claim_coverage"])
        own = [(f"g{i}", f"g{i}t{j}", kind, rng.choice(["high", "low", "low"])) for j in range(rng.randrange(1, 4))]
        tasks += own
        for k in "psam":
            if rng.random() < 0.1:
                continue
            valid = rng.random() < 0.85
            said = {t[1]: rng.choice(["supported", "unsupported"] if kind == judging.SUPPORT_TASK else ["covered", "missing"]) for t in own if rng.random() < 0.95}
            records.append((k, f"g{i}", valid, list(said.items())))
            if valid:
                votes[k, f"g{i}"] = said
    t = spark.createDataFrame([(g, i, "c", k, "lane", s) for g, i, k, s in tasks], "group_id string, task_id string, case_id string, task_type string, lane string, severity string")
    r = spark.createDataFrame(records, "profile string, group_id string, valid boolean, verdicts array<struct<task_id: string, decision: string>>")
    out = judging.simulate(t, r, mode, "p", "s", "a", "m", 0.3).collect()
    assert {x.task_id: (x.decision, x.fail_closed) for x in out} == plain_cascade(mode, tasks, votes, 0.3)


def test_scores_overrides_and_consensus(spark):
    p = spark.createDataFrame([("1", "generated_claim_support", "supported", False, "high"), ("2", "generated_claim_support", "unsupported", True, "low"), ("3", "required_claim_coverage", "covered", False, "low")], "task_id string, task_type string, decision string, fail_closed boolean, severity string")
    human = spark.createDataFrame([("1", "unsupported"), ("2", "supported"), ("3", "covered")], "task_id string, human string")
    rows = {r.slice: r for r in judging.score(p, human, ["severity"]).collect()}
    assert (rows["all"].false_accept_count, rows["all"].severe_false_accept_count, rows["all"].false_reject_count, rows["all"].fail_closed_count) == (1, 1, 1, 1) and rows["severity=low"].task_count == 2
    o = spark.createDataFrame([("1", "unsupported", "supported")], "task_id string, original string, adjudicated string")
    assert got(judging.override(human, o), "task_id", "human") == [("1", "supported"), ("2", "supported"), ("3", "covered")]
    with pytest.raises(Exception, match="drifted"):
        judging.override(human, o.withColumn("original", F.lit("covered"))).collect()
    votes = spark.createDataFrame([(t, f, d) for t, ds in (("1", "sss"), ("2", "ssu")) for f, d in zip("xyz", ds)] + [("1", "x", "s")], "task_id string, family string, decision string")
    assert got(judging.family_consensus(votes, human), "task_id", "consensus") == [("1", "s")]
    tasks = p.withColumn("group_id", F.col("task_id"))
    rec = lambda valid: [("l", "1", True, [("1", "supported")]), ("r", "1", valid, [("1", "supported")]), ("l", "2", True, [("2", "supported")]), ("r", "2", True, [("2", "supported")])]
    ddl = "profile string, group_id string, valid boolean, verdicts array<struct<task_id: string, decision: string>>"
    records = spark.createDataFrame(rec(False), ddl)
    assert got(judging.expand(tasks, records, "r"), "task_id", "decision", "fail_closed") == [("1", "unsupported", True), ("2", "supported", False), ("3", "missing", True)]
    assert not judging.provider_parity(records, "l", "r", human).first().passes and judging.provider_parity(spark.createDataFrame(rec(True), ddl), "l", "r", human).first().passes
    assert got(judging.invalid_groups(records), "profile", "group_id") == [("r", "1")]
    calls = spark.createDataFrame([("p", "1", 0.5, 100.0), ("s", "1", 1.0, 50.0)], "profile string, group_id string, cost double, latency_ms double")
    done = spark.createDataFrame([("1", ["p", "s"]), ("2", ["p"])], "group_id string, consulted array<string>")
    assert tuple(judging.cascade_operation(done, calls).first()) == (3, 1.5, 75.0)


def values(spark, **kw):
    return spark.createDataFrame(list(kw.items()), "metric string, value double")


def test_gates(spark):
    base, cand = values(spark, all_recall=0.9, mrr=0.8, abstention=1.0), values(spark, all_recall=0.89, mrr=0.73, abstention=0.91)
    decisions = {r.metric: r.decision for r in gates.golden_gate(base, cand, 40, 50, ("all_recall",)).collect()}
    assert decisions == {"all_recall": "PROMOTE", "mrr": "NEEDS_REVIEW", "abstention": "PROMOTE"}
    assert gates.worst(gates.golden_gate(base, cand.where("metric <> 'mrr'"), 40, 50, ())).first().decision == "REJECT"
    assert {r.metric: r.decision for r in gates.retrieval_gate(base, cand).collect()} == {"all_recall": "REJECT", "mrr": "REJECT", "abstention": "REJECT"}
    with pytest.raises(Exception, match="missing"):
        gates.retrieval_gate(base, cand.where("metric = 'mrr'")).collect()
    with pytest.raises(ValueError):
        gates.same_identity({"a": 1, "b": 2}, {"a": 1, "b": 3}, ("a", "b"))
    ddl = "id string, lane string, case_pass boolean, action_correct boolean, valid boolean"
    left = spark.createDataFrame([("1", "safe", True, True, True), ("2", "safe", False, True, True), ("3", "x", True, True, False)], ddl)
    right = spark.createDataFrame([("1", "safe", False, True, True), ("2", "safe", True, False, True), ("3", "x", True, True, True)], ddl)
    r = gates.structured_gate(left, right, {"contract": "valid"}, ("safe",), True).first()
    assert (r.decision, r.wins, r.losses, r.unchanged, r.reasons) == ("REJECT", 1, 1, 1, ["safe: action_correct"])
    assert gates.structured_gate(left, left, {"contract": "valid"}, ("safe",), False).first().decision == "DEVELOPMENT_REVIEW" and gates.structured_gate(right, left, {"contract": "valid"}, (), True).first().reasons == ["contract"]
    ddl = "benchmark_id string, joint_correct double, citation_precision double, fail_closed_count long"
    b = spark.createDataFrame([("nq", 0.5, 0.8, 1), ("fever", 0.6, None, 0), ("macro", 0.55, None, None)], ddl)
    good = spark.createDataFrame([("nq", 0.52, 0.77, 1), ("fever", 0.6, None, 0), ("macro", 0.56, None, None)], ddl)
    bad = spark.createDataFrame([("nq", 0.47, 0.76, 2), ("fever", 0.6, None, 0), ("macro", 0.535, None, None)], ddl)
    assert gates.end_to_end_gate(b, good).first().decision == "PROMOTE"
    assert gates.end_to_end_gate(b, bad).first().reasons == ["fail_closed", "macro: joint_correct", "nq: citation_precision", "nq: joint_correct"]
    runs = [spark.createDataFrame([(str(i), "nq" if i < 6 else "fever", ok(i), False) for i in range(12)], "case_id string, benchmark_id string, joint_correct boolean, fail_closed boolean") for ok in (lambda i: i < 2, lambda i: i > 0)]
    rows = {r.benchmark_id: r for r in gates.paired_by_benchmark(*runs).collect()}
    assert (rows["all"].wins, rows["all"].losses, rows["all"].unchanged, rows["nq"].wins) == (10, 1, 1, 4)
    w = gates.promoted_on_window(runs[1], runs[0], spark.createDataFrame([("99",)], "case_id string")).first()
    assert w.promote and w.p_value < 0.05
    with pytest.raises(Exception, match="share cases"):
        gates.promoted_on_window(runs[1], runs[0], runs[0]).collect()
    assert gates.reader_gate(spark.createDataFrame([(1.0, 0.9, False), (0.8, 0.9, False)], "answer_exact_match double, answer_f1 double, fail_closed boolean")).first().passes
    assert got(gates.reproducible(base, cand), "metric", "ok") == [("abstention", False), ("all_recall", True), ("mrr", False)]
    q = spark.createDataFrame([("q", ["a", "b"]), ("r", ["a"])], "question string, ids array<string>")
    assert got(gates.service_parity(q, q.where("question = 'q'"), q), "question", "ok") == [("q", True), ("r", False)]


def test_batches_over_their_life(spark):
    req = [("f", "a", "POST", "/v1", "m", 1), ("f", "b", "POST", "/v1", "m", 2)]
    ddl = "file string, custom_id string, method string, url string, model string, n int"
    assert got(lifecycle.sharded(spark.createDataFrame(req, ddl), "n", F.lit(150_000_000), F.lit(1)), "n", "shard") == [(1, 0), (2, 1)]
    for bad, match in ((("f", "a", "POST", "/v1", "m", 3), "twice"), (("f", "c", "GET", "/v1", "m", 3), "invalid"), (("f", "c", "POST", "/v2", "m", 3), "mixes")):
        with pytest.raises(Exception, match=match):
            lifecycle.checked_requests(spark.createDataFrame([*req, bad], ddl)).collect()
    out = spark.createDataFrame([("a", "x")], "custom_id string, body string")
    assert got(lifecycle.indexed(out, out.withColumn("custom_id", F.lit("b"))), "custom_id", "source") == [("a", "output"), ("b", "error")]
    with pytest.raises(Exception, match="comes twice"):
        lifecycle.indexed(out, out).collect()
    body = json.dumps({"status": "completed", "output": [{"type": "reasoning"}, {"type": "message", "content": [{"type": "output_text", "text": "a"}, {"type": "refusal", "text": "z"}, {"type": "output_text", "text": "b"}]}]})
    assert spark.createDataFrame([(body,)], "b string").select(lifecycle.output_text(F.col("b")).alias("t")).first().t == "ab"
    with pytest.raises(Exception, match="no output text"):
        spark.createDataFrame([('{"output": []}',)], "b string").select(lifecycle.output_text(F.col("b"))).collect()
    requests = spark.createDataFrame([("a",), ("b",), ("c",)], "custom_id string")
    attempts = spark.createDataFrame([("a", 1, True, "x"), ("a", 2, False, "y"), ("b", 1, False, "z")], "custom_id string, attempt int, valid boolean, output string")
    final = lifecycle.final_attempts(requests, attempts)
    assert got(final, "custom_id", "output", "valid", "attempts") == [("a", "x", True, 2), ("b", "z", False, 1), ("c", None, False, 0)] and got(lifecycle.to_retry(final), "custom_id") == [("b",), ("c",)]
    with pytest.raises(Exception, match="unknown custom_id"):
        lifecycle.final_attempts(requests.where("custom_id = 'a'"), attempts).collect()
    batches = spark.createDataFrame([("1", 0), ("2", 1), ("3", 2)], "batch_id string, place int")
    log = spark.createDataFrame([("1", 0, False, "run"), ("1", 1, True, "run"), ("2", 2, False, "run")], "batch_id string, sequence int, valid boolean, identity string")
    assert got(lifecycle.pending(batches, log, "run"), "batch_id") == [("3",)] and got(lifecycle.pending(batches, log, "run", True), "batch_id") == [("2",), ("3",)]
    with pytest.raises(Exception, match="another run"):
        lifecycle.pending(batches, log, "else").collect()
    assert [r.batch_id for r in lifecycle.in_order(log.dropDuplicates(["batch_id"]), batches.where("place < 2"), "place").collect()] == ["1", "2"]
    assert got(lifecycle.replayed(log, "batch_id", "sequence"), "batch_id", "valid") == [("1", True), ("2", False)]


def test_ledgers(spark):
    new = spark.createDataFrame([(2, "accessed", "p"), (1, "ledger_initialized", "q")], "at int, event_type string, purpose string")
    links = lifecycle.chained(new)
    rows = links.collect()
    assert [r.sequence for r in rows] == [0, 1] and rows[1].previous_event_sha256 == rows[0].event_sha256
    more = lifecycle.chained(new.where("at = 2"), 2, rows[1].event_sha256)
    whole = spark.createDataFrame(rows + more.collect(), links.schema)
    assert tuple(lifecycle.ledger_faults(whole).first()) == (3, 0, 0, 0, 0)
    forged = whole.withColumn("purpose", F.when(F.col("sequence") == 1, "else").otherwise(F.col("purpose")))
    assert lifecycle.ledger_faults(forged).first().broken_digests == 1
    assert lifecycle.ledger_faults(whole.where("sequence > 0")).first().asDict() == {"n": 2, "broken_sequence": 2, "broken_links": 1, "broken_digests": 0, "bad_start": 1}


def test_cases(spark):
    old = spark.createDataFrame([("1", "who?", True, ["d::h", "c::x"], "me", '{"id": 1}'), ("2", "why?", False, [], None, "{}")], "id string, question string, answerable boolean, relevant array<string>, answer string, raw string")
    new = cases.migrate(old, "v2")
    r = {x.id: x for x in new.collect()}
    assert r["v1-1"].tags == ["legacy_v1", "human_authored", "c", "d"] and r["v1-1"].required_claims[0].evidence_ids == ["d::h", "c::x"] and r["v1-2"].required_claims == [] and r["v1-2"].unanswerable_reason == "absent_from_corpus"
    assert cases.migration_drift(new, old).count() == 0 and got(cases.migration_drift(new.where("id = 'v1-1'").withColumn("question", F.lit("x")), old), "id") == [("1",), ("2",)]
    reason = lambda a, c: spark.range(1).select(cases.unanswerable_reason(F.lit(a), F.lit(c).cast("string")).alias("r")).first().r
    assert (reason("answer", "subjective"), reason("abstain_absent", "subjective"), reason("clarify_ambiguous", "subjective"), reason("reject_injection", None)) == (None, "subjective", "ambiguous", "prompt_injection")
    with pytest.raises(Exception, match="unsupported"):
        reason("else", None)
    d = spark.createDataFrame([("v1-1", "approve", None, None, "you", ["d::h::span-1", "d::i::span-2"], ["new"])], "case_id string, decision string, question string, answer_action string, reference_answer string, acceptable_evidence array<string>, tags array<string>")
    x = cases.reviewed(new, d).where("id = 'v1-1'").first()
    assert (x.question, x.reference_answer, x.reasoning_hops, x.review_status) == ("who?", "you", 2, "approved") and "new" in x.tags
    done = cases.reviewed(new, d)
    assert got(cases.eligible(done, ["legacy_v1_answerable"]), "id") == [("v1-1",)]
    e = spark.createDataFrame([("a", ["x"], [("c1", ["y", "x"])])], "id string, acceptable_evidence array<string>, required_claims array<struct<id: string, evidence_ids: array<string>>>")
    assert got(cases.redundant_evidence(e), "acceptable_evidence", "added") == [(["x", "y"], ["y"])]
    specs = spark.createDataFrame([("v1-1", "adv-1", "ignore this", "adv", None)], "source_id string, new_id string, question string, lane string, answer_action string")
    made = cases.derived(new, specs).first()
    assert (made.id, made.derived_from, made.question, made.answer_action) == ("adv-1", "v1-1", "ignore this", "answer")
    with pytest.raises(Exception, match="without a source"):
        cases.derived(new.limit(0), specs).collect()
    run = spark.createDataFrame([("v1-2", 0), ("v1-1", 1)], "case_id string, place int")
    assert [q.id for q in cases.question_manifest(run, new, "place").collect()] == ["v1-2", "v1-1"]
    assert cases.blind(spark.createDataFrame([(1, 0.5)], "id int, score double")).columns == ["id"]
    assert got(cases.wire_ids(run.withColumn("b", F.lit(1)), "b", "place"), "case_id", "wire_id") == [("v1-1", "C2"), ("v1-2", "C1")]
    heads = spark.createDataFrame([("d", "d::h"), ("d", "d::z")], "document_id string, heading_key string")
    by, gaps = cases.coverage_matrix(heads, done, ["legacy_v1_answerable", "other"], 3)
    assert got(by, "heading_key", "linked", "approved", "with_span") == [("d::h", 1, 1, 1), ("d::z", 0, 0, 0)] and got(gaps, "lane", "gap") == [("legacy_v1_answerable", 2), ("other", 3)]
    assert got(cases.inventory(done), "review_status", "cases", "ready") == [("approved", 1, False), ("pending", 1, False)] and got(cases.document_labels(done), "document", "n") == [("d", 2)]
    bad = new.withColumn("reviewers", F.array().cast("array<string>")).withColumn("review_status", F.lit("approved")).withColumn("distractor_evidence", F.expr("array('d::h')"))
    assert got(cases.integrity_faults(bad, spark.createDataFrame([("d::h",)], "evidence_id string")), "id", "rule") == [("v1-1", "acceptable_distractor"), ("v1-1", "approved_without_reviewer"), ("v1-1", "unknown_evidence"), ("v1-2", "approved_without_reviewer")]
    s = spark.createDataFrame([("a", "Q one two", None), ("b", "q One two", "gone")], "id string, question string, supersedes string")
    assert got(cases.dataset_faults(s), "rule", "n") == [("duplicate_id", 0), ("duplicate_question", 1), ("supersedes_unknown", 1)]
    audit = cases.overlap_audit(s).first()
    assert (audit.a, audit.b, audit.jaccard, audit.passes) == ("a", "b", 1.0, False)
    assert got(cases.packets(s, "id", 1), "id", "packet") == [("a", 0), ("b", 1)]
    hops = spark.createDataFrame([("m", ["d::a::span-1", "d::b::span-2"], "i1"), ("n", ["d::a::span-1"], "i2")], "id string, acceptable_evidence array<string>, intent_family_id string")
    assert got(cases.multi_hop_faults(hops, spark.createDataFrame([("i1",)], "intent_family_id string")), "id", "rule") == [("m", "known_intent"), ("n", "few_spans"), ("n", "one_hop")]
    dec = spark.createDataFrame([("t", "x", 1), ("t", "y", 2)], "task_id string, decision string, at int")
    assert got(cases.calibration_labels(dec, dec.select("task_id").distinct()), "task_id", "human") == [("t", "y")]
    claims = spark.createDataFrame([("a", ["x", "y"])], "case_id string, claims array<string>")
    assert got(cases.judge_tasks(claims, claims), "task_id") == [("a::g1",), ("a::g2",), ("a::r1",), ("a::r2",)]


def test_normalized_faults_and_spot_audit(spark):
    ddl = "id string, benchmark_id string, query string, gold struct<answerability: string>, documents array<struct<id: string, title: string, sentences: array<string>>>, supporting_evidence array<struct<document_id: string, sentence_index: int, text: string>>, annotation_votes array<struct<answerability: string>>"
    doc = [("d", "T", ["s0", "s1"])]
    rows = [("a", "nq", "q", ("answerable",), doc, [("d", 1, "s1")], [("answerable",), ("unanswerable",)]), ("b", "nq", "q", ("unanswerable",), doc, [("d", 1, "else")], []), ("b", "nq", "q", ("answerable",), doc, [("gone", 0, "s0")], [])]
    c = spark.createDataFrame(rows, ddl)
    assert got(cases.normalized_faults(c), "rule", "n") == [("dangling_evidence", 1), ("duplicate_id", 1), ("text_drift", 1), ("unanswerable_with_evidence", 1)]
    r = cases.spot_audit(c.where("id = 'a'"), F.col("gold.answerability"), {"answerable": 1}, "s:").first()
    assert r.supporting_evidence[0].document_title == "T" and (r.vote_count, r.answerable_votes, r.unanswerable_votes) == (2, 1, 1)


def test_places_in_an_order_and_task_groups(spark):
    from rankloom.operators import metrics

    rng = random.Random(8)
    rows = [(i, rng.choice("ab"), rng.random()) for i in range(200)]
    d = spark.createDataFrame(rows, "i int, g string, x double").repartition(5)
    whole = sorted(rows, key=lambda r: r[2])
    assert set(got(metrics.numbered(d, F.col("x"), "n"), "i", "n")) == {(r[0], n) for n, r in enumerate(whole)}
    parts = [(r[0], n) for g in "ab" for n, r in enumerate(r for r in whole if r[1] == g)]
    assert set(got(metrics.numbered(d, F.col("x"), "n", ["g"]), "i", "n")) == set(parts)
    tasks = spark.createDataFrame([(3, "b", "s"), (1, "a", "s"), (2, "a", "c"), (4, "a", "s"), (5, "b", "s")], "at int, case_id string, task_type string")
    assert got(judging.task_groups(tasks, "at"), "at", "group_no") == [(1, 1), (2, 2), (3, 3), (4, 1), (5, 3)]


def test_selectors(spark):
    w = spark.createDataFrame([("a", "big red dog", [("D1", "d1", "Red Dog", "the red dog ran"), ("D2", "d2", "Cat", "a cat and the dog")])], "case_id string, query string, contexts array<struct<citation_id: string, document_id: string, title: string, text: string>>")
    run = lambda p, c: spark.createDataFrame([("a", p, c)], "case_id string, prediction string, cited_document_ids array<string>")
    f = {r.document_id: dict(zip(selectors.FEATURES, r.features, strict=True)) for r in selectors.document_features(w, run("Red dog.", ["d1"]), run("red dog", ["d1", "d2"])).collect()}
    assert f["d1"]["title_in_query"] == pytest.approx(2 / 3) and f["d1"]["answer_stands"] == 1 and f["d1"]["cited_both"] == 1 and f["d1"]["title_elsewhere"] == 0.5 and f["d1"]["answers_agree"] == 1
    assert f["d2"]["inverse_rank"] == 0.5 and f["d2"]["cited_first"] == 0 and f["d2"]["cited_second"] == 1 and f["d2"]["answer_in_text"] == 0.5 and f["d2"]["text_words"] == 5
    rng = random.Random(1)
    rows = [(f"c{i}", [rng.gauss(2.0 * (i % 2), 1.0), rng.random()], i % 2) for i in range(200)]
    d = spark.createDataFrame(rows, "case_id string, features array<double>, label int")
    scored = selectors.out_of_fold(d, "case_id")
    assert scored.count() == 200 and scored.agg(F.avg(((F.col("probability") > 0.5) == (F.col("label") == 1)).cast("int"))).first()[0] > 0.75
    p = spark.createDataFrame([([1.0, 2.0],)], "features array<double>").select(selectors.logistic(F.col("features"), [1.0, -1.0], 0.5).alias("p")).first().p
    assert p == pytest.approx(1 / (1 + 2.718281828 ** 0.5))
    assert selectors.out_of_fold(d.withColumn("label", F.lit(1)), "case_id").agg(F.min("probability")).first()[0] == 1.0
    c = spark.createDataFrame([("a", True, ["d1"], ["d1"], ["d1", "d2"], True), ("b", False, ["e1"], ["e2"], ["e1", "e2"], True)], "case_id string, agree boolean, first array<string>, second array<string>, gold array<string>, exact boolean")
    docs = spark.createDataFrame([("a", "d2", 0.6), ("a", "d3", 0.3), ("b", "e2", 0.9)], "case_id string, document_id string, probability double")
    s = selectors.sweep(selectors.selections(c, docs, (0.2, 0.5, 0.7)))
    assert got(s, "threshold", "joint_correct_rate", "citation_recall", "added_document_count") == [(0.2, 0.5, 0.75, 2), (0.5, 0.5, 0.75, 1), (0.7, 0.0, 0.5, 0)]
    assert selectors.chosen_threshold(s).first().threshold == 0.5 and selectors.chosen_threshold(s, 1.1).count() == 0 and selectors.best_by(s, [F.desc("threshold")]).first().threshold == 0.7
    few = spark.createDataFrame([("a", "x", 0, 0.5), ("a", "y", 1, 0.25), ("a", "z", 2, 0.125)], "case_id string, document_id string, position int, score double")
    assert got(selectors.pairs(few), "left", "right", "score") == [("x", "y", 0.75), ("x", "z", 0.625), ("y", "z", 0.375)]
    route = lambda x: spark.createDataFrame([("a", x, ["d"])], "case_id string, answer string, citations array<string>")
    prob = spark.createDataFrame([("a", 0.7)], "case_id string, probability double")
    assert [selectors.routed(route("x"), route("y"), prob, t).first().answer for t in (0.63, 0.8)] == ["y", "x"]


def plain_compress(query, sentences, budget):
    import re

    if len(" ".join(sentences)) <= budget:
        return " ".join(sentences)
    words = set(re.findall(r"\w+", query.casefold()))
    scores = [round(sum(1 + len(w) / 20 for w in words & set(re.findall(r"\w+", s.casefold()))), 9) for s in sentences]
    best = sorted(range(len(sentences)), key=lambda i: (-scores[i], i))[:12]
    out, used = [], 0
    for i in sorted({j for b in best for j in (b - 1, b, b + 1) if 0 <= j < len(sentences)}):
        piece = f"[{i}] {sentences[i]}"
        if not out or used + len(piece) + 1 <= budget:
            out.append(piece)
            used += len(piece) + 1
    return " ".join(out)[:budget]


def test_compression(spark):
    rng = random.Random(7)
    rows = []
    for i in range(60):
        text = [" ".join(rng.choice("alpha beta gamma delta eps zeta".split()) for _ in range(rng.randrange(1, 12))) + "." for _ in range(rng.randrange(2, 40))]
        rows.append((i, "alpha zeta", text, [rng.random() for _ in text]))
    rows.append((99, "alpha", ["x" * 900, "alpha"], [0.1, 0.9]))
    d = spark.createDataFrame(rows, "id int, q string, s array<string>, v array<double>")
    assert {r.id: r.text for r in ranking.compress(d, "q", "s", 200, ["id"]).collect()} == {i: plain_compress(q, s, 200) for i, q, s, _ in rows}
    by_score = {r.id: r.text for r in ranking.compress(d, "q", "s", 200, ["id"], scores="v").collect()}
    for i, _, s, v in rows:
        order = sorted(range(len(s)), key=lambda k: (-round(v[k], 9), k))
        take = dict.fromkeys(j for b in order[:12] for j in (b, b - 1, b + 1) if 0 <= j < len(s))
        held, used = [], 0
        for j in take:
            cost = len(f"[{j}] {s[j]}") + bool(held)
            if used + cost <= 200:
                held.append(j)
                used += cost
        want = " ".join(f"[{j}] {s[j]}" for j in sorted(held)) if held else f"[{order[0]}] {s[order[0]]}"[:200]
        assert by_score[i] == want
    with pytest.raises(ValueError):
        ranking.compress(d, "q", "s", 0, ["id"])


def test_two_stage_candidates(spark):
    docs = spark.createDataFrame([("a", "Ada Lovelace", "wrote notes"), ("b", "Engine", "the analytical engine machine notes"), ("c", "Other", "analytical machine only"), ("d", "None", "nothing here")], "id string, title string, body string")
    q = spark.createDataFrame([(1, "Did Ada Lovelace see the analytical engine machine?"), (2, "of")], "qid int, text string")
    run = lambda k: [r.doc_id for r in ranking.two_stage(docs, "id", F.col("title"), F.col("body"), q, "qid", F.col("text"), k).where("query_id = 1").orderBy("rank").collect()]
    assert run(3) == ["a"]
    q = spark.createDataFrame([(1, "Ada Lovelace analytical engine machine notes"), (2, "analytical engine machine")], "qid int, text string")
    got_ = {(r.query_id, r.doc_id) for r in ranking.two_stage(docs, "id", F.col("title"), F.col("body"), q, "qid", F.col("text"), 3).collect()}
    assert got_ == {(1, "a"), (2, "b"), (2, "c")}


def test_dense_blocks_equal_a_plain_loop(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(ranking, "QUERY_BLOCK", 3)
    rng = np.random.default_rng(3)
    v = rng.integers(-2, 3, (90, 4)).astype(float)
    d = spark.createDataFrame([(i, x.tolist(), i % 7) for i, x in enumerate(v)], "doc_id int, vector array<float>, label int")
    q = d.where("doc_id % 11 = 0").select(F.col("doc_id").alias("query_id"), F.col("vector").alias("query"))
    top = ranking.dense_top_k(q, d, 5, ["label"]).collect()
    first = ranking.dense_first_ranks(q, d, "label").collect()
    for i in range(0, 90, 11):
        order = sorted((j for j in range(90) if j != i), key=lambda j: (-float(v[i] @ v[j]), j))
        assert [r.doc_id for r in sorted((r for r in top if r.query_id == i), key=lambda r: r.rank)] == order[:5]
        assert {r.label: r.rank for r in first if r.query_id == i} == {g: 1 + next(n for n, j in enumerate(order) if j % 7 == g) for g in range(7)}
    assert ranking.dense_top_k(q.limit(0), d, 5).count() == 0 and ranking.dense_first_ranks(q.limit(0), d, "label").count() == 0


def test_blocks_of_a_document(spark):
    from rankloom.operators import corpus

    text = "intro line\n\n# One\npara a\npara b\n- item 1\n  more\n- item 2\nafter\n\n## Two\n```\n# code\n\n```\n> quote\n\n| a | b |\n|---|---|\n<!-- gone -->\n\n- item 1\n  more\n# One\npara a\npara b\n"
    d = spark.createDataFrame([("doc", text)], "id string, text string")
    rows = corpus.blocks(d, "id", F.col("text")).orderBy("block").collect()
    assert [(r.block_type, r.start_line, r.end_line, "/".join(r.heading_path)) for r in rows] == [
        ("prose", 1, 1, "intro"), ("heading", 3, 3, "One"), ("prose", 4, 5, "One"), ("list", 6, 7, "One"), ("list", 8, 8, "One"), ("prose", 9, 9, "One"), ("heading", 11, 11, "One/Two"), ("code", 12, 15, "One/Two"), ("quote", 16, 16, "One/Two"),
        ("table", 18, 20, "One/Two"), ("list", 22, 23, "One/Two"), ("heading", 24, 24, "One"), ("prose", 25, 26, "One"),
    ]
    ids = [r.evidence_id for r in rows]
    assert len(set(ids)) == len(ids) and ids[12] == ids[2] + "-2" and ids[11] == ids[1] + "-2"
    assert got(corpus.heading_keys(d, "id", F.col("text")), "heading_key") == [("doc::one",), ("doc::two",)]
    assert corpus.catalogue(d, "id", F.col("text"), F.lit("retired"), F.lit(True)).count() == 0

"""Audits: every rule fails on a fixture made for it. Rechecks: a replay equals plain Python at every version."""

import random

import pytest
from pyspark.sql import functions as F

from rankloom.operators import audits, rechecks, scoring

METRICS = ", ".join(f"{m} {'double' if m in ('citation_precision', 'citation_recall', 'answer_exact_match', 'answer_f1') else 'boolean'}" for m in scoring.CASE_METRICS)
CASE = f"case_id string, benchmark_id string, prediction string, fail_closed boolean, {METRICS}"


def scored(i, benchmark="hotpotqa", **kw):
    fine = dict.fromkeys(scoring.CASE_METRICS, True) | dict.fromkeys(("citation_precision", "citation_recall", "answer_exact_match", "answer_f1"), 1.0)
    row = {"case_id": f"c{i}", "benchmark_id": benchmark, "prediction": "x", "fail_closed": False} | fine | kw
    return tuple(row[k] for k in ("case_id", "benchmark_id", "prediction", "fail_closed", *scoring.CASE_METRICS))


def test_every_check_of_a_run_fails_on_its_fixture(spark):
    good = [scored(i, b) for b, at in (("hotpotqa", 0), ("fever", 100), ("natural_questions", 200)) for i in range(at, at + 6)]
    targets = spark.createDataFrame([("hotpotqa", 6), ("fever", 6), ("natural_questions", 6)], "benchmark_id string, target int")

    def faults(rows, report=None, goal=targets, floor=0.6):
        df = spark.createDataFrame(rows, CASE)
        report = audits.by_metric(scoring.aggregate(df)) if report is None else report
        out = {r.check: r for r in audits.run_audit(df, report, goal, floor).collect()}
        assert all(r.ok == (r.n == 0) for r in out.values()) and len(out) == 10
        return {k: (r.n, r.sample) for k, r in out.items() if not r.ok}

    changed = lambda *new: new_rows(good, new)

    def new_rows(rows, new):
        by = {r[0]: r for r in new}
        return [by.get(r[0], r) for r in rows]

    assert faults(good) == {}
    assert faults(changed(scored(3, citation_precision=1.5))) == {"precision_is_a_share": (1, ["c3"])}
    assert faults(changed(scored(3, citation_recall=-0.1), scored(4, citation_recall=None))) == {"recall_is_a_share": (1, ["c3"])}
    assert faults(changed(scored(3, evidence_complete=False))) == {"joint_has_evidence": (1, ["c3"])}
    assert faults(changed(scored(3, fail_closed=True, joint_correct=False))) == {"zero_fail_closed": (1, ["c3"])}
    assert faults(changed(scored(3, fail_closed=True))) == {"zero_fail_closed": (1, ["c3"]), "joint_is_answered": (1, ["c3"])}
    assert faults([*good[1:], good[5]]) == {"ids_unique": (1, ["c5"])}
    assert faults(good[1:]) == {"counts_exact": (1, ["hotpotqa"])}
    assert faults(changed(scored(3, "other"))) == {"benchmark_known": (1, ["c3"]), "counts_exact": (2, ["hotpotqa", "other"])}
    report = audits.by_metric(scoring.aggregate(spark.createDataFrame(good, CASE)))
    off = report.withColumn("value", F.when((F.col("benchmark_id") == "fever") & (F.col("metric") == "answer_f1"), 0.5).otherwise(F.col("value")))
    assert faults(good, off) == {"metrics_recompute": (1, ["fever: answer_f1"])}
    assert faults(good, report.where("benchmark_id <> 'macro' OR metric <> 'joint_correct'"))["metrics_recompute"] == (1, ["macro: joint_correct"])
    assert faults(good, floor=1.1) == {"macro_gate": (1, [])}
    many = audits.broken(spark.createDataFrame(changed(*[scored(i, citation_precision=2.0) for i in range(6)]), CASE), "case_id", audits.run_rules()).where("n > 0").first()
    assert many.n == 6 and len(many.sample) == 3 and set(many.sample) <= {f"c{i}" for i in range(6)}


DOC = "struct<id: string, title: string>"
NORMAL = f"id string, benchmark_id string, query string, gold struct<answerability: string>, documents array<{DOC}>, supporting_evidence array<struct<document_id: string, sentence_index: int>>, provenance struct<source_record_sha256: string>"


def test_every_check_of_a_suite_fails_on_its_fixture(spark):
    def case(i, benchmark="fever", query="q", gold="answerable", docs=("a", "b"), evidence=("a",), sha="0" * 64):
        return (i, benchmark, query, (gold,), [(d, "t") for d in docs], [(d, 0) for d in evidence], (sha,))

    targets = spark.createDataFrame([("fever", 3)], "benchmark_id string, target int")
    good = [case("x"), case("y"), case("z", gold="unanswerable", evidence=())]

    def faults(*rows):
        return {r.check: r.sample for r in audits.suite_audit(spark.createDataFrame([*rows, *good][:3] if len(rows) < 4 else rows, NORMAL), targets).where("not ok").collect()}

    assert faults() == {}
    for rule, row in {
        "query_present": case("w", query=" "), "documents_single": case("w", docs=("a", "a")), "evidence_in_documents": case("w", evidence=("a", "gone")), "answerable_has_evidence": case("w", evidence=()),
        "unanswerable_has_none": case("w", gold="unanswerable"), "provenance_present": case("w", sha="0"),
    }.items():
        assert faults(row) == {rule: ["w"]}
    assert faults(case(" ")) == {"id_present": [" "]}
    assert faults(case("w", benchmark="squad")) == {"benchmark_known": ["w"], "counts_exact": ["fever", "squad"]}
    assert faults(case("x"), case("x")) == {"ids_unique": ["x"]}
    assert faults(*[case(f"n{i}") for i in range(4)]) == {"counts_exact": ["fever"]}


VALUE = "prediction string, citation_ids array<string>"


def test_replays_equal_plain_python(spark):
    rng = random.Random(5)
    state = {f"c{i}": (f"p{i}", ["d1"]) for i in range(30)}
    first = spark.createDataFrame([(k, *v) for k, v in state.items()], f"case_id string, {VALUE}")
    versions, log, now = [dict(state)], None, first
    for version in range(1, 5):
        proposals = []
        for k in rng.sample(sorted(state), 12):
            p, c = state[k]
            new = rng.choice([(p, c), (p, [*c, f"e{version}"]), (p + "'", c), (p, [])])
            proposals.append((k, rng.random() < 0.8, rng.choice(["recheck", "completion"]), *new))
        df = spark.createDataFrame(proposals, f"case_id string, valid boolean, reason string, {VALUE}")
        allowed = rechecks.keeps_citations if version == 3 else None
        log_rows = rechecks.changes(now, df, version, allowed)
        rows = log_rows.collect()
        for k, valid, reason, p, c in proposals:
            old = state[k]
            takes = valid and (p, c) != old and (version != 3 or (p == old[0] and set(old[1]) <= set(c)))
            assert [(r.before.prediction, r.after.prediction, r.after.citation_ids, r.reason) for r in rows if r.case_id == k] == ([(old[0], p, c, reason)] if takes else [])
            if takes:
                state[k] = (p, c)
        versions.append(dict(state))
        kept = spark.createDataFrame(rows, log_rows.schema)
        log = kept if log is None else log.unionByName(kept)
        now = rechecks.replayed(first, log)
    for version, want in enumerate(versions):
        got = {r.case_id: (r.prediction, r.citation_ids) for r in rechecks.replayed(first, log, version).collect()}
        assert got == want
    assert rechecks.log_faults(first, log).count() == 0
    torn = log.where("version <> 2")
    assert {r.case_id for r in rechecks.log_faults(first, torn).collect()} <= {r.case_id for r in log.where("version > 2").collect()}
    with pytest.raises(Exception, match="without a result"):
        rechecks.changes(first, spark.createDataFrame([("gone", True, "r", "p", ["d"])], f"case_id string, valid boolean, reason string, {VALUE}"), 1).collect()

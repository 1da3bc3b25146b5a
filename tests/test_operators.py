import json
import random

import pytest
from pyspark.sql import functions as F

from rankloom.functions.text import tokens
from rankloom.operators import contracts, corpus, metrics, policy, provider, ranking, sampling
from rankloom.staging import staged


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.select(*cols).collect())


def test_rrf_ties_go_to_the_smaller_id_and_weights_move_them(spark):
    a = spark.createDataFrame([(0, "a", 1), (0, "b", 2)], "query_id int, doc_id string, rank int")
    b = spark.createDataFrame([(0, "b", 1), (0, "a", 2)], "query_id int, doc_id string, rank int")
    for weights, want in ((None, ["a", "b"]), ([1.0, 3.0], ["b", "a"])):
        got = ranking.top_k(ranking.reciprocal_rank_fusion([a, b], weights), 2).orderBy("rank").collect()
        assert [r.doc_id for r in got] == want
    for bad in ([1.0], [0.0, 0.0], [-1.0, 2.0]):
        with pytest.raises(ValueError):
            ranking.reciprocal_rank_fusion([a, b], bad)
    with pytest.raises(ValueError):
        ranking.top_k(a, 0)


def test_bm25_equals_a_plain_loop(spark):
    import math

    rng = random.Random(5)
    docs = [(i, " ".join(rng.choice("alpha beta gamma delta eps zeta".split()) for _ in range(rng.randrange(1, 12)))) for i in range(40)]
    query = "alpha zeta alpha"
    d = spark.createDataFrame(docs, "doc_id int, text string")
    q = ranking.query_terms(spark.createDataFrame([(1, query)], "id int, t string"), "id", F.col("t"))
    got = {r.doc_id: r.score for r in ranking.bm25_scores(d, "doc_id", F.col("text"), q).collect()}
    words = {i: t.split() for i, t in docs}
    avg = sum(map(len, words.values())) / len(words)
    for i, w in words.items():
        s = 0.0
        for t in ("alpha", "zeta"):
            tf, df = w.count(t), sum(t in x for x in words.values())
            s += math.log(1 + (len(docs) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / avg))
        assert got.get(i, 0.0) == pytest.approx(s)


def test_metrics_at_k_of_two_gold_documents(spark):
    r = spark.createDataFrame([(0, "d1", 1), (0, "d2", 2)], "query_id int, doc_id string, rank int")
    g = spark.createDataFrame([(0, "d1"), (0, "d2")], "query_id int, doc_id string")
    got = {x.k: (x.any_recall, x.all_recall, x.evidence_recall, x.mrr) for x in metrics.retrieval_at_k(r, g, (1, 2)).collect()}
    assert got == {1: (1.0, 0.0, 0.5, 1.0), 2: (1.0, 1.0, 1.0, 1.0)}


def test_distinct_groups_take_the_first_of_each(spark):
    s = spark.createDataFrame([(0, "a0", "a", 1.0), (0, "a1", "a", 0.99), (0, "b0", "b", 0.8)], "query_id int, doc_id string, heading string, score double")
    assert [r.doc_id for r in ranking.top_k(s, 2).orderBy("rank").collect()] == ["a0", "a1"]
    assert [r.doc_id for r in ranking.top_k_distinct(s, 2, "heading").orderBy("rank").collect()] == ["a0", "b0"]


def test_auc_and_curve(spark):
    data = [("a1", True, 0.9), ("a2", True, 0.8), ("u1", False, 0.7), ("u2", False, 0.6)]
    r = spark.createDataFrame(data, "id string, ok boolean, score double")
    assert metrics.auc(r, "score", F.col("ok")).first().auc == 1.0
    curve = metrics.risk_coverage(r, "score", F.col("ok"))
    rows_ = curve.orderBy(F.desc_nulls_first("threshold")).collect()
    assert (rows_[0].threshold, rows_[0].coverage, rows_[0].selective_risk) == (None, 0.0, 0.0) and rows_[-1].coverage == 1.0 and rows_[-1].selective_risk == 0.5
    best = metrics.operating_point(curve, 0.0, 0.0).first()
    assert (best.threshold, best.coverage, best.false_answer_count, best.false_refusal_count) == (0.8, 0.5, 0, 0)
    mixed = spark.createDataFrame([("a", True, 0.5), ("u", False, 0.9)], "id string, ok boolean, score double")
    assert metrics.operating_point(metrics.risk_coverage(mixed, "score", F.col("ok")), 0.0, 0.0).count() == 0
    with pytest.raises(Exception, match="are needed"):
        metrics.risk_coverage(mixed.where("ok"), "score", F.col("ok")).collect()


def test_running_sums_and_percentiles_equal_plain_python(spark, monkeypatch):
    import random
    import statistics

    monkeypatch.setattr(metrics, "staged", lambda df, tag: staged(df.repartitionByRange(5, "__k").withColumn("__p", F.spark_partition_id()), tag))  # several ranges, however small
    rng = random.Random(4)
    data = [(rng.choice("ab"), rng.choice([rng.random(), 0.5, -1.0])) for _ in range(300)] + [("a", None), ("c", 7.0)]
    r = spark.createDataFrame(data, "g string, v double")
    values = sorted(v for _, v in data if v is not None)
    got = {x.fraction: x.value for x in metrics.nearest_rank_percentiles(r, "v", (0.0, 0.3, 0.5, 1.0)).collect()}
    assert got == {f: values[round((len(values) - 1) * f)] for f in (0.0, 0.3, 0.5, 1.0)}
    got = {(x.g, x.fraction): x.value for x in metrics.linear_percentiles(r, "v", (0.5, 0.95), ["g"]).collect()}
    for g in "abc":
        own = sorted(v for k, v in data if k == g and v is not None)
        assert got[g, 0.5] == pytest.approx(statistics.median(own))
        at = (len(own) - 1) * 0.95
        low = own[int(at)]
        assert got[g, 0.95] == pytest.approx(low + (at - int(at)) * (own[min(int(at) + 1, len(own) - 1)] - low))
    pos, neg = [v for g, v in data if g == "a" and v is not None], [v for g, v in data if g != "a"]
    won = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))
    assert metrics.auc(r, "v", F.col("g") == "a").first().auc == pytest.approx(won)


def test_answer_scores(spark):
    rows_ = [(1, "The Paris.", ["Rome", "Paris"]), (2, "b c", ["a b d"]), (3, "", [""]), (4, " __unanswerable__ ", []), (5, "x", []), (6, "x x y", ["x y y", "z"]), (7, "\ufb01ne É", ["fine e\u0301"])]
    r = spark.createDataFrame(rows_, "id int, p string, g array<string>")
    got = {x.id: (x.exact, x.f1) for x in metrics.answer_scores(r, "p", "g", ["id"]).collect()}
    assert got[1] == (1, 1.0) and got[3] == (1, 1.0) and got[2] == (0, pytest.approx(0.5)) and got[4] == (1, 1) and got[5] == (0, 0) and got[6] == (0, pytest.approx(2 / 3)) and got[7] == (1, 1.0)


def test_evidence_sets(spark):
    r = spark.range(1).select(metrics.any_set_complete(F.expr("array(array('d1'), array('d2'))"), F.expr("array('d1')")).alias("any"), metrics.subset(F.expr("array('d1', 'd2')"), F.expr("array('d1')")).alias("all")).first()
    assert r.any and not r.all


def test_transitions_need_the_same_keys(spark):
    a = spark.createDataFrame([(1, True), (2, False)], "k int, ok boolean")
    b = spark.createDataFrame([(1, True), (2, True)], "k int, ok boolean")
    t = metrics.transitions(a, b, "k", "ok").first()
    assert (t.n, t.wins, t.losses, t.unchanged) == (2, 1, 0, 1)
    with pytest.raises(Exception, match="keys differ"):
        metrics.transitions(a, b.where("k = 1"), "k", "ok").collect()


def test_samples_do_not_depend_on_order_and_windows_are_disjoint(spark):
    r = spark.range(200).withColumnRenamed("id", "doc")
    one = rows(sampling.hash_sample(r, 20, "doc"), "doc")
    assert one == rows(sampling.hash_sample(r.orderBy(F.desc("doc")), 20, "doc"), "doc")
    w = [set(rows(sampling.hash_window(r, o, 30, "doc", "s:"), "doc")) for o in (0, 30)]
    assert not w[0] & w[1] and len(w[0] | w[1]) == 60
    split = {x["partition"]: x["count"] for x in sampling.holdout(r, "doc", "c:").groupBy("partition").count().collect()}
    assert split == {"confirmation": 40, "development": 160}


def test_sections_respect_fences(spark):
    text = "intro\n# One\nbody\n```\n# not a heading\n```\n<!-- gone -->\n## Two ##\nmore"
    d = spark.createDataFrame([("doc", text)], "id string, text string")
    got = rows(corpus.sections(d, "id", F.col("text")), "heading", "heading_key", "text")
    assert got == [("One", "doc::one", "body\n```\n# not a heading\n```"), ("Two ##", "doc::two", "more"), ("intro", "doc::intro", "intro")]


def test_hash_chain(spark):
    e = spark.createDataFrame([("l", 0, None, "a"), ("l", 1, "a", "b"), ("l", 3, "x", "c")], "ledger string, seq int, prev string, h string")
    got = corpus.hash_chain(e, "ledger", "seq", "prev", "h").first()
    assert (got.n, got.broken_sequence, got.broken_links) == (3, 1, 1)


def test_contract_violations(spark):
    def answer(**kw):
        base = {"schema_version": "1.0.0", "action": "answer", "response": None, "claims": [{"id": "c1", "text": "x", "citation_ids": ["S1"]}]}
        return json.dumps(base | kw)

    claim = lambda i, c, **kw: {"id": i, "text": "x", "citation_ids": c} | kw
    cases = {
        answer(): [],
        "```json\n{}\n```": ["root_type"],
        "[1]": ["root_type"],
        answer(claims=[claim("c1", ["S9"])]): ["nonexistent_citation"],
        answer(claims=[claim("c1", [])]): ["uncited_claim"],
        answer(claims=[claim("c2", ["S1"]), claim("c2", ["S1", "S1"])]): ["claim_order", "duplicate_claim_id", "duplicate_citation"],
        answer(action="abstain_absent", response="no"): ["nonanswer_with_claims"],
        answer(action="abstain_conflict", claims=[], response=" "): ["nonanswer_response"],
        answer(action="reject_injection", claims=[], response="no"): ["unsupported_action"],
        answer(action="abstain", claims=[]): ["action"],
        answer(extra=1, response="yes"): ["extra_fields", "answer_response"],
        answer(claims="c1"): ["claims_type", "answer_without_claims"],
        answer(claims=[3, claim("c2", ["s2"], more=1), claim("x", [1], text=" ")]): ["claim_type", "claim_fields", "citation_format", "claim_id", "claim_order", "claim_text", "citation_format", "duplicate_citation", "nonexistent_citation", "nonexistent_citation"],
        "{}": ["missing_fields", "schema_version", "action", "claims_type"],
    }
    allowed = F.array(*[F.lit(a) for a in contracts.ACTIONS if a != "reject_injection"])
    d = spark.createDataFrame([(k,) for k in cases], "raw string").withColumn("v", contracts.violations(F.col("raw"), F.expr("array('S1','S2')"), allowed))
    assert {r.raw: r.v for r in d.collect()} == cases


def test_citation_metrics_parsing_and_rendering(spark):
    two = json.dumps({"schema_version": "1.0.0", "action": "answer", "response": None, "claims": [{"id": "c1", "text": " a ", "citation_ids": ["S1", "S9"]}, {"id": "c2", "text": "b.", "citation_ids": []}]})
    no = json.dumps({"schema_version": "1.0.0", "action": "abstain_absent", "response": " none ", "claims": []})
    d = spark.createDataFrame([(two,), (no,), ("x",)], "raw string")
    r = d.select(contracts.validate(F.col("raw"), F.expr("array('S1')")).alias("v"), contracts.render(contracts.parse(F.col("raw"))).alias("t")).collect()
    v = r[0].v
    assert (v.claim_count, v.citation_count, v.valid_citation_count, v.citation_existence_precision, v.claim_citation_coverage, v.claim_valid_citation_coverage) == (2, 2, 1, 0.5, 0.5, 0.5)
    assert [x.t for x in r] == ["a b.", "none", ""] and not r[2].v.valid
    c = spark.createDataFrame([(1, 2, "b", "k::b", "B", "tb", 0.5), (1, 1, None, "k::a", "A", "ta", 0.9)], "q int, rank int, id string, heading_key string, heading string, text string, score double")
    got = contracts.context_sources(c, "q", "rank").select("sources", contracts.format_sources(F.col("sources")).alias("t")).first()
    assert got.t == "[S1] (A)\nta\n\n[S2] (B)\ntb" and [s.chunk_id for s in got.sources] == ["k::a", "b"]
    schema = contracts.response_format(["S2", "S1"], ["answer"])["json_schema"]["schema"]
    assert schema["properties"]["claims"]["items"]["properties"]["citation_ids"]["items"]["enum"] == ["S1", "S2"] and schema["required"] == list(contracts.FIELDS)
    assert "pattern" in contracts.response_format([], ["answer"])["json_schema"]["schema"]["properties"]["claims"]["items"]["properties"]["citation_ids"]["items"]


def test_provider_output_is_read_and_checked(spark):
    r = lambda i, p="x", c=("D1",): {"case_id": i, "prediction": p, "citation_ids": list(c)}
    good = json.dumps({"results": [r("c1"), r("c2")]}, separators=(",", ":"))
    two, fever = [("c1", "hotpotqa", ["D1", "D2"]), ("c2", "hotpotqa", ["D1", "D2"])], [("c1", "fever", ["D1", "D2"]), ("c2", "fever", ["D1", "D2"])]
    runs = [
        (good, two, [], None, []),
        (f" ```json\n{good}\n```", two, ["stripped_markdown_fence"], None, []),
        (good + "`", two, ["stripped_trailing_backtick"], None, []),
        (good[:-1], two, ["restored_missing_root_closer"], None, []),
        (good + "}", two, ["stripped_extra_trailing_closer"], None, []),
        (json.dumps([r("c1"), r("c2")]), two, ["wrapped_results_array"], None, []),
        (json.dumps(r("c1")), two[:1], ["wrapped_single_result"], None, []),
        ("Sure: " + good, two, [], "invalid_json", ["invalid_json"]),
        (good + " done", two, [], "invalid_json", ["invalid_json"]),
        (None, two, [], "invalid_json", ["invalid_json"]),
        ('{"results": []}', two, [], None, ["result_count"]),
        (json.dumps({"results": [r("c1", "maybe", ["D9"]), r("c1", "not_enough_info")]}), fever, [], None, ["c1: citations", "c1: label", "c2: order", "c2: abstention_cites"]),
        (json.dumps({"results": [{"case_id": "c1"}, r("c2", " ", ["D1", "D1"])]}), two, [], None, ["c1: fields", "c2: empty_prediction", "c2: citations"]),
    ]
    d = spark.createDataFrame([(n, raw, b) for n, (raw, b, *_) in enumerate(runs)], "n int, raw string, batch array<struct<case_id:string,benchmark_id:string,citation_ids:array<string>>>")
    out = {x.n: x.repaired for x in provider.audited(d, "raw", "batch").collect()}
    assert [(out[n].events, out[n].error, out[n].violations) for n in range(len(runs))] == [(e, error, v) for _, _, e, error, v in runs]
    assert json.loads(out[1].value) == json.loads(good) and out[7].value is None


def test_only_whole_texts_are_json(spark):
    texts = ["{}", " [1] ", "{}}", "{} x", '1,"end"]', "", "1", None, "{}] {", '"a"']
    d = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "n int, t string")
    assert sorted(r.n for r in d.where(contracts.json_value(F.col("t")).isNotNull()).collect()) == [0, 1, 6, 9]


def test_majority_gate_and_shards(spark):
    v = spark.createDataFrame([(1, "p", "x"), (1, "q", "y"), (1, "r", "y"), (2, "p", "x"), (2, "q", "y"), (2, "r", "z")], "case int, run string, answer string")
    assert rows(policy.majority(v, "case", "run", "answer", "p"), "case", "answer") == [(1, "y"), (2, "x")]
    b = spark.createDataFrame([("hard", 1.0), ("soft", 0.5), ("gone", 0.1)], "metric string, value double")
    c = spark.createDataFrame([("hard", 0.9), ("soft", 0.42)], "metric string, value double")
    g = policy.gate(b, c, {"hard": 0.05, "soft": 0.05, "gone": 0.05}, ("hard",))
    assert rows(g, "metric", "decision") == [("gone", "REJECT"), ("hard", "REJECT"), ("soft", "NEEDS_REVIEW")] and policy.worst(g).first().decision == "REJECT"
    r = spark.createDataFrame([("f", i, s) for i, s in enumerate((5, 5, 5, 12, 1, 1, 1, 1))] + [("g", 0, 9)], "file string, n int, size int")
    assert rows(policy.shards(r, "n", F.col("size"), 3, 12, "file"), "file", "n", "shard") == [("f", 0, 0), ("f", 1, 0), ("f", 2, 1), ("f", 3, 2), ("f", 4, 3), ("f", 5, 3), ("f", 6, 3), ("f", 7, 4), ("g", 0, 0)]
    assert rows(policy.shards(r.where("n > 3"), "n", F.col("size"), 9, 12, "file", F.lit(5), 10), "n", "shard") == [(4, 0), (5, 0), (6, 1), (7, 1)]
    with pytest.raises(Exception, match="over a limit"):
        policy.shards(r, "n", F.col("size"), 3, 11, "file").collect()


def test_resolve_fails_closed(spark):
    r = lambda a, b, c: spark.range(1).select(policy.resolve(*[F.lit(x).cast("string") for x in (a, b, c)]).alias("d")).first().d
    assert [r("accept", "accept", None), r("accept", "reject", "accept"), r("accept", "reject", None), r("reject", None, "accept")] == ["accept", "accept", "fail_closed", "fail_closed"]


def test_near_pairs_come_from_shared_tokens(spark):
    d = spark.createDataFrame([(1, "a b c"), (2, "a b d"), (3, "x y")], "id int, t string")
    assert rows(corpus.near_pairs(d, "id", F.array_distinct(tokens(F.col("t"))), 0.4), "a", "b", "jaccard") == [(1, 2, 0.5)]

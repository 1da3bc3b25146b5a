from pyspark.sql import functions as F

from rankloom.functions import anchors
from rankloom.functions import text as tx
from rankloom.operators import evidence
from rankloom.plans.catalogue import QUERIES


def test_claims_need_all_their_headings(spark):
    claims = spark.createDataFrame([("c", "1", "a"), ("c", "2", "b")], "case_id string, claim_id string, heading string")
    ranking = spark.createDataFrame([("c", "a", 1), ("c", "x", 2), ("c", "b", 3)], "case_id string, heading string, rank int")
    got = {r.k: (r.claim_coverage, r.complete) for r in evidence.claim_coverage(claims, ranking, (2, 3)).collect()}
    assert got == {2: (0.5, False), 3: (1.0, True)}


def test_prefix_pair_union_and_abstention(spark):
    r = spark.createDataFrame([(1, "a", 1), (1, "a", 2), (1, "b", 3)], "query_id int, heading string, rank int")
    assert evidence.distinct_prefix(r, 2).first().raw_needed == 3 and evidence.distinct_prefix(r, 3).first().raw_needed is None
    s = spark.createDataFrame([("c", "d0", 0, 0.1), ("c", "d1", 1, 0.9), ("c", "d2", 2, 0.5), ("e", "d", 0, 1.0)], "case_id string, document_id string, position int, score double")
    assert [(x.left, x.right) for x in evidence.best_pair(s).collect()] == [("d1", "d2")]
    run = lambda a, c: spark.createDataFrame([("c", a, c)], "case_id string, answer string, citations array<string>")
    assert evidence.agreement_union(run("x", ["1"]), run("x", ["2"])).first().citations == ["1", "2"]
    assert evidence.agreement_union(run("x", ["1"]), run("y", ["2"])).first().citations == ["1"]
    p = spark.createDataFrame([(0.9, "a", ["1"]), (0.1, "b", ["1"]), (None, "c", ["1"])], "s double, prediction string, citations array<string>")
    assert [(x.prediction, x.citations) for x in evidence.abstain_below(p, F.col("s"), 0.36, "none").collect()] == [("a", ["1"]), ("none", []), ("none", [])]


def test_nli_retention_and_attempts(spark):
    n = spark.createDataFrame([("a", "d1", 0.9, 0.1), ("a", "d2", 0.01, 0.2), ("b", "d1", 0.3, 0.4)], "case_id string, document_id string, entail double, contradict double")
    assert sorted((x.case_id, x.label, tuple(x.citations)) for x in evidence.nli_decision(n).collect()) == [("a", "supports", ("d1",)), ("b", "not_enough_info", ())]
    spans = spark.createDataFrame([("a", 0, "x y"), ("a", 0, "gone"), ("b", 0, "z")], "case_id string, evidence_set int, text string")
    ctx = spark.createDataFrame([("a", "w x y"), ("b", "z")], "case_id string, context string")
    r = evidence.retention(spans, ctx).first()
    assert (r.n, r.any_retained, r.complete_retained) == (2, 1.0, 0.5)
    t = spark.createDataFrame([("i", 1, True, "a"), ("i", 2, False, "b"), ("j", 1, False, "c"), ("j", 2, False, "d")], "custom_id string, attempt int, valid boolean, output string")
    assert sorted((x.custom_id, x.output) for x in evidence.last_valid_attempt(t).collect()) == [("i", "a"), ("j", "d")]


def test_anchors(spark):
    text = "See https://x.example/a1. Set `Max Retries` to $3 in conf/app.yml, 20 failed requests, twice 1.5% `2`"
    runs = [
        (text, "", ["https://x.example/a1", "max retries", "2", "conf/app.yml", "3", "20", "1.5%", "<numeric-unit:20:request>", "<quantity:twice>"], None),
        ("20 failed requests", "requests of about 20", None, []),
        ("20 requests", "20 of the many other requests", None, ["<numeric-unit:20:request>"]),
        ("limit 7, twice", "limit 8, two times", None, ["7"]),
        ("once", "never", ["<quantity:once>"], ["<quantity:once>"]),
        (None, "x", [], []),
        ("a/b/https://y.example/1", "https://y.example/1", ["https://y.example/1"], []),  # a path that runs into an address is none
        ("1.5.2 a/2b #9 `x/1`", None, ["x/1", "a/2b", "1.5.2", "9"], ["x/1", "a/2b", "1.5.2", "9"]),
        ("costs $5 (5)", "5", ["5"], []),
        ("2 hosts", "with hosts at most 2", ["2", "<numeric-unit:2:host>"], []),
    ]
    d = spark.createDataFrame([(n, a, b) for n, (a, b, *_) in enumerate(runs)], "n int, a string, b string")
    got = {r.n: r for r in d.select("n", anchors.exact_anchors(F.col("a")).alias("x"), anchors.missing_anchors(F.col("a"), F.col("b")).alias("m")).collect()}
    for n, (_, _, exact, missing) in enumerate(runs):
        assert exact is None or got[n].x == exact
        assert missing is None or got[n].m == missing
    lost = tx.loses_negation(F.col("a"), F.col("b"))
    assert spark.createDataFrame([("limit 7, do not", "limit 8")], "a string, b string").select(lost.alias("n")).first().n


def test_distinct_prefix_length_looks_beyond_sixty_vectors(spark, tmp_path):
    rows = [(0, [1.0, 0.0], 0)] + [(i, [1.0 - i / 1000, 0.0], i % 4) for i in range(1, 80)] + [(80, [0.1, 0.0], 4)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert [tuple(r) for r in QUERIES["distinct_prefix_length"](spark, str(tmp_path)).collect()] == [(0, 80)]

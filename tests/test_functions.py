import math
import random

import pytest
from pyspark.sql import functions as F

from rankloom.functions import stats
from rankloom.functions import text as tx


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_tokens_fold_and_keep_unicode_words(spark):
    assert one(spark, tx.tokens(F.lit("Straße, ÉTÉ_1 don't")).alias("t")).t == ["strasse", "été_1", "don", "t"]


def test_slug_and_heading_key(spark):
    r = one(spark, tx.slug(F.lit("  Hello, World! ")).alias("a"), tx.heading_key(F.lit("doc"), F.lit("A & B")).alias("b"))
    assert (r.a, r.b) == ("hello-world", "doc::a-b")


def test_fts_terms_fall_back_to_words(spark):
    r = one(spark, tx.fts_terms(F.lit("What is the cooldown of the breaker")).alias("a"), tx.fts_terms(F.lit("is it to be")).alias("b"))
    assert r.a == ["what", "cooldown", "breaker"] and r.b == ["is", "it", "to", "be"]


def test_normalize_answer(spark):
    assert one(spark, tx.normalize_answer(F.lit("The  Paris.")).alias("a")).a == "paris"


def test_windows_cover_the_tail(spark):
    for n in (1, 180, 181, 320, 321, 1000):
        words = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: i.cast("string"))
        got = [[int(x) for x in w.words] for w in one(spark, tx.word_windows(words).alias("w")).w]
        want, at = [], 0
        while True:
            want.append(list(range(at + 1, min(n, at + 180) + 1)))
            if at + 180 >= n:
                break
            at += 140
        assert got == want


def test_semver_and_edit(spark):
    r = one(spark, (tx.semver_key(F.lit("1.2.0-rc1")) < tx.semver_key(F.lit("1.2.0"))).alias("a"), tx.one_edit_apart(F.lit("d1"), F.lit("d12")).alias("b"), tx.judge_integer(F.lit("score: 14 of 20")).alias("c"))
    assert r.a and r.b and r.c == 10


def test_wilson_upper_of_no_failures(spark):
    r = one(spark, stats.wilson(F.lit(0), F.lit(10))[1].alias("u"), stats.wilson(F.lit(0), F.lit(0))[0].alias("none"))
    assert 0.27 < r.u < 0.28 and r.none is None


def test_kappa_and_mcnemar(spark):
    r = one(spark, stats.kappa(F.lit(3), F.lit(0), F.lit(0), F.lit(0)).alias("k"), stats.mcnemar_p(F.lit(7), F.lit(1)).alias("p"), stats.mcnemar_p(F.lit(0), F.lit(0)).alias("one"))
    exact = 2 * sum(math.comb(8, i) for i in range(2)) / 2**8
    assert r.k == 1.0 and r.one == 1.0 and r.p == pytest.approx(exact)
    random.seed(1)


def test_casefold_equals_python(spark):
    texts = ["Straße ΣΊΣΥΦΟΣ ς", "ﬁﬂ ŉ ΐ ᾳ İ K Å µ ẞ", "plain ASCII Text", "ǰ Ꭰ ꭰ ϑ", ""]
    got = [r.f for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(tx.casefold(F.col("t")).alias("f")).collect()]
    assert got == [t.casefold() for t in texts]


def test_titles_expressions_and_ids(spark):
    r = one(spark, tx.title_candidates(F.lit("Ada's  old-House")).alias("t"), tx.fts_expression(F.expr("""array('a', 'b"c')"""), "AND").alias("e"), tx.namespaced_ids("g", F.lit(2)).alias("n"), tx.namespaced_ids("g", F.lit(0)).alias("z"))
    assert r.t == sorted(["Ada", "Ada_old", "Ada_old_House", "old", "old_House", "House"]) and r.e == '"a" AND "b""c"' and (r.n, r.z) == (["g1", "g2"], [])
    r = one(spark, tx.stable_custom_id(F.lit("x")).alias("c"), tx.evidence_cluster(F.lit(True), F.lit("i"), F.expr("array('b', 'a')")).alias("k"), tx.evidence_cluster(F.lit(False), F.lit("i"), F.expr("array('b')")).alias("u"))
    import hashlib

    assert r.c == "rag-" + hashlib.sha256(b"x").hexdigest()[:24] and r.k == "legacy-v1-evidence::" + hashlib.sha256(b'["a","b"]').hexdigest()[:16] and r.u == "legacy-v1-unanswerable::i"


def test_timestamps_blocks_and_answers(spark):
    r = one(spark, tx.utc_timestamp(F.lit("2024-01-02T03:04:05")).alias("a"), tx.utc_timestamp(F.lit("2024-01-02T03:04:05.5+02:00")).alias("b"), tx.trimmed_block(F.lit("\n a  \nb\t\n\n")).alias("t"), tx.find_answer(F.lit("The Big big Cat"), F.expr("array('cat', 'BIG', 'big big', '')")).alias("f"), tx.find_answer(F.lit("x"), F.expr("array('y')")).alias("n"))
    assert (r.a, r.b) == ("2024-01-02T03:04:05Z", "2024-01-02T01:04:05.500000Z") and r.t == "a\nb" and (r.f.start, r.f.answer) == (4, "Big") and r.n is None


def test_small_text_functions(spark):
    import hashlib

    digest = hashlib.sha256(b"a\nb").hexdigest()
    r = one(spark, tx.matches_checkout(F.lit("a\r\nb"), F.lit(digest)).alias("m"), tx.canonical_sha256({"b": F.lit(1), "a": F.lit(None).cast("string")}).alias("c"), tx.is_abstention(F.lit("Not Enough Information here")).alias("i"), tx.percent(F.lit(0.1234)).alias("p"), tx.percent(F.lit(None).cast("double")).alias("q"), tx.alnum_tokens(F.lit("A-b a 1")).alias("t"), tx.normalized_text(F.lit(" E\u0301  X\n")).alias("n"))
    assert r.m and r.c == hashlib.sha256(b'{"a":null,"b":1}').hexdigest() and r.i and (r.p, r.q) == ("12.3%", "n/a") and r.t == ["a", "b", "1"] and r.n == "é x"
    s = one(spark, tx.sentences(F.expr("array('One. Two!', ' ')")).alias("a"), tx.sentences(F.expr("array('One. Two!', 'x')")).alias("b"), tx.sentences(F.lit(["A? B\rC"])).alias("c"))
    assert s.a == ["One.", "Two!"] and s.b == ["One. Two!", "x"] and s.c == ["A?", "B", "C"]
    assert one(spark, stats.wilson_upper(F.lit(0), F.lit(10)).alias("u")).u == pytest.approx(0.2130, abs=1e-3)

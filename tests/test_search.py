"""Inverted blocks, stems, full-text ranking and bounded candidates against plain loops, published examples and SQLite's full-text engine."""

import math
import random
import sqlite3
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.functions import stems
from rankloom.operators import bounded, inverted, ranking

#: Examples that the algorithm was published with.
EXAMPLES = """caresses caress ponies poni ties ti cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing conflated conflat troubled troubl sized size hopping hop tanned tan
falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky relational relat conditional condit rational ration valenci valenc digitizer digit conformabli conform radicalli radic
differentli differ vileli vile analogousli analog vietnamization vietnam predication predic operator oper feudalism feudal decisiveness decis hopefulness hope callousness callous formaliti formal
sensitiviti sensit sensibiliti sensibl triplicate triplic formative form formalize formal electriciti electr electrical electr hopeful hope goodness good revival reviv allowance allow inference infer
airliner airlin adjustable adjust defensible defens irritant irrit replacement replac adjustment adjust dependent depend adoption adopt homologou homolog communism commun activate activ
angulariti angular homologous homolog effective effect bowdlerize bowdler probate probat rate rate cease ceas controll control roll roll""".split()
WORDS = ["run", "running", "runs", "cat", "cats", "Zürich", "strasse", "STRASSE", "Straße", "hope", "hopeful", "of", "the", "no_go", "alpha", "beta", "gamma", "42", "x"]


@pytest.mark.parametrize(("word", "stem"), list(zip(EXAMPLES[::2], EXAMPLES[1::2], strict=True)))
def test_published_stems(word, stem):
    assert stems.porter(word) == stem


def test_stems_and_query_terms():
    assert stems.analysed("Running the_cats, ZÜRICH's 42 élèves") == ["run", "the", "cat", "zurich", "s", "42", "elev"]
    assert stems.query_terms("The of it") == ["the", "of", "it"] and stems.query_terms("Runs, running: the runs") == ["runs", "running"]
    assert stems.query_stems("Runs, running: the runs") == ["run", "run"]  # terms with one stem count each


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(4)
    texts = [" ".join(rng.choice(WORDS) for _ in range(rng.choice([0, 1, 4, 30]))) for _ in range(130)] + ["cat", "cat", "cat"]
    return [(i, f"s{i % 3}", t) for i, t in enumerate(texts)], [(0, "cats running"), (1, "the x 42"), (2, "absent"), (3, ""), (4, " ".join(WORDS)), (5, "cat"), (6, "Straße")]


def plain_bm25(texts, query):
    words = [inverted.ANALYSERS["words"](t) for t in texts]
    mean = max(sum(map(len, words)) / len(words), 1.0)
    out = {}
    for term in dict.fromkeys(inverted.ANALYSERS["words"](query)):
        df = sum(term in w for w in words)
        for k, w in enumerate(words):
            if tf := w.count(term):
                out[k] = out.get(k, 0) + math.log(1 + (len(texts) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / mean))
    return out


def ranked(scores):
    return sorted(scores, key=lambda k: (-round(scores[k], 9), k))


def built(spark, docs, queries, **options):
    d = spark.createDataFrame(docs, "id long, source string, text string")
    terms = inverted.term_rows(spark.createDataFrame(queries, "q long, text string"), "q", F.col("text"))
    return inverted.index(d.repartition(3), "id", [(F.col("text"), 1.0)], terms, **options), terms


def test_search_equals_a_plain_ranking(spark, corpus):
    docs, queries = corpus
    found, terms = built(spark, docs, queries, part="source")
    for k in (1, 3, 200):
        got = sorted(((r.query_id, r["rank"], r.doc_id, pytest.approx(r.score), r.part) for r in inverted.search(found, terms, k).collect()), key=lambda x: x[:2])
        want = []
        for q, text in queries:
            s = plain_bm25([t for *_, t in docs], text)
            want += [(q, n, i, s[i], f"s{i % 3}") for n, i in enumerate(ranked(s)[:k], 1)]
        assert got == sorted(want)
    parts = {(r.query_id, r.part, r.doc_id) for r in inverted.search(found, terms, 1, per_part=True).collect()}
    s = plain_bm25([t for *_, t in docs], "cats running")
    assert {p for p in parts if p[0] == 0} == {(0, f"s{m}", next(i for i in ranked(s) if i % 3 == m)) for m in range(3)}
    counts = {(r.query_id, r.doc_id): r.score for r in inverted.search(found, terms, 500, "tf").collect()}
    assert counts[5, 130] == 1 and all(v == sum(inverted.ANALYSERS["words"](docs[i][2]).count(w) for w in set(inverted.ANALYSERS["words"](queries[q][1]))) for (q, i), v in counts.items())


def test_counts_within_parts(spark, corpus):
    docs, queries = corpus
    found, terms = built(spark, docs, queries, part="source", own_counts=True)
    got = {(r.part, r.doc_id): pytest.approx(r.score) for r in inverted.search(found, terms, 100, per_part=True).where("query_id = 0").collect()}
    want = {}
    for m in range(3):
        mine = [(i, t) for i, _, t in docs if i % 3 == m]
        want |= {(f"s{m}", mine[k][0]): v for k, v in plain_bm25([t for _, t in mine], "cats running").items()}
    assert got == want


def test_blocks_are_skipped(monkeypatch):
    """A block whose largest weights can't reach the k-th score is not scored; one that could tie is."""
    import pyarrow as pa

    block = lambda i, w: {"block": i, "part": None, "ids": [10 * i, 10 * i + 1], "lengths": [1, 1], "terms": ["a"], "starts": [0, 2], "at": [0, 1], "tf": [1.0, 1.0], "w": w, "most": [max(w)]}
    scored = []
    plain = inverted._scores
    monkeypatch.setattr(inverted, "_scores", lambda row, weight, local: scored.append(max(weight)) or plain(row, weight, local))
    row = type("Row", (), {"query_id": 7, "terms": ["a"]})
    run = inverted._searcher(inverted.Asked([row]), 2, "bm25", False, ["query_id", "doc_id", "part", "score"], [pa.int64(), pa.int64(), pa.string(), pa.float64()])
    batch = pa.RecordBatch.from_pylist([block(1, [5.0, 4.0]), block(2, [1.0, 3.9]), block(0, [4.0, 0.5])])
    out = [b.to_pylist() for b in run(iter([batch]))][0]
    assert scored == [5.0, 4.0] and [(r["doc_id"], r["score"]) for r in out] == [(10, 5.0), (0, 4.0)]


def test_whole_rankings_are_fused_exactly(spark, corpus):
    docs, queries = corpus
    found, terms = built(spark, docs, queries)
    for weights, constant, depth in (([1.0, 1.0], 60, 2), ([0.25, 1.0], 10, 4), ([1.0, 0.0], 1, 1)):
        got = {}
        for r in inverted.fused(found, terms, 5, weights, constant, depth=depth).collect():
            got.setdefault(r.query_id, []).append((r["rank"], r.doc_id))
        for q, text in queries:
            first = plain_bm25([t for *_, t in docs], text)
            asked = set(inverted.ANALYSERS["words"](text))
            second = {k: sum(w in asked for w in inverted.ANALYSERS["words"](t)) for k, (*_, t) in enumerate(docs)}
            total = Counter()
            for scores, weight in zip((first, {k: v for k, v in second.items() if v}), weights, strict=True):
                for n, i in enumerate(ranked(scores), 1):
                    total[i] += weight / (constant + n)
            assert [i for _, i in sorted(got.get(q, []))] == ranked(total)[:5]


def test_documents_with_all_terms_or_all_but_one(spark, corpus):
    docs, queries = corpus
    found, terms = built(spark, docs, queries)
    got = {(r.query_id, r.doc_id): r.missing for r in inverted.having(found, terms, 1).collect()}
    want = {}
    for q, text in queries:
        asked = set(inverted.ANALYSERS["words"](text))
        for i, _, t in docs:
            have = asked & set(inverted.ANALYSERS["words"](t))
            if have and len(asked) - len(have) <= 1:
                want[q, i] = len(asked) - len(have)
    assert got == want


def test_index_without_rows(spark):
    found, terms = built(spark, [], [(1, "a")])
    assert inverted.search(found, terms, 3).count() == 0
    found, terms = built(spark, [(1, "s", None), (None, None, "a a")], [])
    assert inverted.search(found, terms, 3).count() == 0
    with pytest.raises(ValueError):
        inverted.search(found, terms, 0)


def engine():
    try:
        c = sqlite3.connect(":memory:")
        c.execute("CREATE VIRTUAL TABLE pages USING fts5(page_id UNINDEXED, title, text, tokenize='porter unicode61')")
    except sqlite3.OperationalError:
        pytest.skip("SQLite without full-text search")
    return c


def test_full_text_ranking_equals_sqlite(spark):
    rng = random.Random(8)
    c = engine()
    pages = [(f"p{i:03}", " ".join(rng.choice(WORDS) for _ in range(rng.randrange(4))), " ".join(rng.choice(WORDS) for _ in range(rng.randrange(1, 40)))) for i in range(120)]
    pages = [(i, a.replace("no_go", "go"), b.replace("no_go", "go")) for i, a, b in pages]  # a term with an underscore is a phrase there
    c.executemany("INSERT INTO pages VALUES (?, ?, ?)", pages)
    queries = [(0, "running cats in zurich"), (1, "hopeful hope alpha"), (2, "of the"), (3, "gamma")]
    terms = inverted.term_rows(spark.createDataFrame(queries, "q long, text string"), "q", F.col("text"), "query_stems")
    found = inverted.index(spark.createDataFrame(pages, "id string, title string, text string"), "id", [(F.col("title"), 3.0), (F.col("text"), 1.0)], terms, analyser="stems", floor=True)
    got = {}
    for r in inverted.search(found, terms, 200).collect():
        got.setdefault(r.query_id, []).append((r.doc_id, pytest.approx(r.score, abs=1e-8)))
    for q, text in queries:
        match = " OR ".join(f'"{t}"' for t in stems.query_terms(text))
        want = [(i, -s) for i, s in c.execute("SELECT page_id, bm25(pages, 0.0, 3.0, 1.0) AS s FROM pages WHERE pages MATCH ?", (match,))]
        assert sorted(got.get(q, []), key=lambda x: x[0]) == sorted(want)


def test_two_stages_by_stems(spark):
    """Titles are found without their words being asked for, strict hits before relaxed ones, which come in while there are fewer than k."""
    pages = [("Big_Cats", "Big Cats", "nothing else here"), ("a", "Other", "hunting lions sleep"), ("b", "Other", "lion hunted in the savanna, lions slept"), ("c", "Other", "a savanna"), ("d", "Other", "lions hunt savannas")]
    d = spark.createDataFrame(pages, "id string, title string, text string")
    q = spark.createDataFrame([(1, "Do Big Cats hunt lions"), (2, "lion savanna hunts"), (3, "")], "q long, text string")
    got = {}
    for r in ranking.two_stage(d, "id", F.col("title"), F.col("text"), q, "q", F.col("text"), 3, stemmed=True).orderBy("rank").collect():
        got.setdefault(r.query_id, []).append(r.doc_id)
    assert set(got[2]) == {"b", "d", "a"} and "Big_Cats" in got[1] and 3 not in got
    assert {r.doc_id for r in ranking.two_stage(d, "id", F.col("title"), F.col("text"), q, "q", F.col("text"), 2, stemmed=True).where("query_id = 2").collect()} == {"b", "d"}


# bounded candidates


def case(i, benchmark, query, vector, docs):
    return (i, benchmark, query, vector, [(a, b, c, v) for a, b, c, v in docs])


CASES = "id long, benchmark string, query string, vector array<double>, docs array<struct<id: string, title: string, text: string, vector: array<double>>>"


def test_bounded_candidates(spark):
    docs = [("b", "Other", "unrelated words", [0.0, 1.0]), ("a", "Gateway", "circuit breaker cooldown", [0.6, 0.8]), ("c", "Other", "unrelated words", [1.0, 0.0])]
    rows = [case(1, "hotpotqa", "circuit breaker", [1.0, 0.0], docs), case(2, "natural_questions", "none of them", [0.0, 1.0], docs), case(3, "hotpotqa", "x", [1.0, 0.0], [])]
    df = spark.createDataFrame(rows, CASES)
    by = lambda mode, k=3: {i: [r.doc_id for r in sorted(got, key=lambda r: r["rank"])] for i in (1, 2, 3) if (got := [r for r in bounded.rank(df, "id", "query", "docs", k, mode, "vector", F.col("benchmark")).collect() if r.query_id == i])}
    assert by("lexical") == {1: ["a", "b", "c"], 2: ["a", "b", "c"]}  # documents without a word are kept, ties go by id
    assert by("dense") == {1: ["c", "a", "b"], 2: ["b", "a", "c"]}
    assert by("weighted_hybrid") == {1: ["c", "a", "b"], 2: ["b", "a", "c"]}
    assert by("dense", 1) == {1: ["c"], 2: ["b"]}
    for mode, k in (("dense", 0), ("other", 1)):
        with pytest.raises(ValueError):
            bounded.rank(df, "id", "query", "docs", k, mode, "vector")
    with pytest.raises(ValueError):
        bounded.Fusion(0, 1.0, 1.0)
    with pytest.raises(Exception, match="no fusion is stated"):
        bounded.rank(df.withColumn("benchmark", F.lit("fever")), "id", "query", "docs", 1, "weighted_hybrid", "vector", F.col("benchmark")).collect()


def test_bounded_fusion_equals_plain_sums(spark):
    rng = random.Random(3)
    rows = []
    for i in range(30):
        docs = [(f"d{k}", "", " ".join(rng.choice(WORDS) for _ in range(9)), [rng.gauss(0, 1) for _ in range(4)]) for k in range(rng.randrange(1, 12))]
        rows.append(case(i, rng.choice(["hotpotqa", "natural_questions"]), " ".join(rng.sample(WORDS, 3)), [rng.gauss(0, 1) for _ in range(4)], docs))
    got = {}
    for r in bounded.rank(spark.createDataFrame(rows, CASES), "id", "query", "docs", 5, "weighted_hybrid", "vector", F.col("benchmark")).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.doc_id))
    for i, benchmark, query, vector, docs in rows:
        lexical = plain_bm25([t for *_, t, _ in docs], query)
        orders = [ranked({k: lexical.get(k, 0.0) for k in range(len(docs))}), ranked({k: float(np.dot(d[3], vector)) for k, d in enumerate(docs)})]
        by_id = lambda order, s: sorted(order, key=lambda k: (-round(s[k], 9), docs[k][0]))
        orders = [by_id(orders[0], {k: lexical.get(k, 0.0) for k in range(len(docs))}), by_id(orders[1], {k: float(np.dot(d[3], vector)) for k, d in enumerate(docs)})]
        f, total = bounded.FUSIONS[benchmark], Counter()
        for order, weight in zip(orders, (f.lexical, f.dense), strict=True):
            for n, k in enumerate(order, 1):
                total[k] += weight / (f.constant + n)
        assert [d for _, d in sorted(got[i])] == [docs[k][0] for k in by_id(total, total)[:5]]

"""Hard negatives, passages and the audit of filters against plain loops on small fixtures and edge cases."""

import hashlib
import math
import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.llm import filter_audit, hard_negatives, substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# hard negatives


def plain_negatives(rows, positives=5, negatives=10, low=30, high=90, is_anchor=lambda i: i % 10 == 0):
    used = []
    for i, label, v in rows:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) and math.isfinite(256.0 * x) for x in v):
            used.append((i, label, [math.floor(256.0 * x) for x in v]))
    score = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    anchors = {}
    for i, label, v in used:
        if is_anchor(i):
            anchors[i] = min(anchors.get(i, (label, v)), (label, v))
    for i, (label, v) in anchors.items():
        others = sorted((-score(v, w), j, m) for j, m, w in used if j != i)
        for p, pid, _ in [x for x in others if x[2] == label][:positives]:
            hits = [x for x in others if x[2] != label and -low * p <= -100 * x[0] <= -high * p][:negatives]
            out += [(i, pid, r + 1, n, -p, -s) for r, (s, n, _) in enumerate(hits)]
    return sorted(out)


def mined(spark, rows, **options):
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").withColumn("score", F.lit("clash")).withColumn("rank", F.lit(1)).withColumn("list", F.lit(0.5))
    return sorted(map(tuple, hard_negatives.mine(df, F.col("vec_id") % 10 == 0, **options).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()))


def vector_rows(rng, n, width=6, labels=4):
    centres = rng.normal(size=(labels, width))
    of = rng.integers(labels, size=n)
    v = centres[of] + rng.normal(size=(n, width))
    return [(i, int(of[i]), (v[i] / np.linalg.norm(v[i])).tolist()) for i in range(n)]


@pytest.mark.parametrize("options", [{}, {"lists": 5, "part": 7, "block": 3, "probe": 1}, {"lists": 1, "probe": 1, "part": 11}])
def test_hard_negatives_equal_all_pairs(spark, options):
    rng = np.random.default_rng(3)
    rows = vector_rows(rng, 150)
    rows += [(1000 + i, 1, rows[0][2]) for i in range(60)]  # a vector that a quarter of all rows have: ties go by id
    rows += [(2000, None, rows[1][2]), (2010, 1, None), (2020, 1, [0.5, None]), (2030, 1, [float("nan")]), (2040, 1, [float("inf"), 1.0]), (2050, 1, [1e306]), (None, 2, rows[3][2])]
    rows += [(2060, 1, []), (2070, 2, [0.9]), (2080, 3, [0.1] * 9), (2090, 2, [0.0] * 6), (2100, 0, [-x for x in rows[0][2]]), rows[10], rows[20], (30, 3, rows[40][2])]
    order = list(range(len(rows)))
    random.Random(1).shuffle(order)
    assert mined(spark, [rows[i] for i in order], **options) == plain_negatives(rows)


def test_hard_negatives_of_large_numbers(spark):
    rng = np.random.default_rng(5)
    rows = [(i, i % 3, [float(x) for x in rng.integers(-(1 << 21), 1 << 21, 4)]) for i in range(60)]  # inner products beyond 2 ** 53
    assert mined(spark, rows) == plain_negatives(rows)


def test_hard_negatives_without_rows(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(10, None, [1.0])]) == []
    assert mined(spark, [(10, 1, [1.0]), (11, 2, [0.5])]) == []  # an anchor without positives


def test_lists_are_skipped_and_bounds_hold():
    rng = np.random.default_rng(7)
    rows = np.floor(256 * np.array([r[2] for r in vector_rows(rng, 400)]))
    centres = hard_negatives.fit(rows, 8)
    near = ((rows[:, None] - centres) ** 2).sum(2).argmin(1)
    radii = np.array([np.sqrt(((rows[near == k] - centres[k]) ** 2).sum(1)).max(initial=0) for k in range(len(centres))])
    for q in rows[:20]:
        exact, spread = rows @ q, np.linalg.norm(q) * radii[near]
        assert (exact <= centres[near] @ q + spread + 1e-6).all() and (exact >= centres[near] @ q - spread - 1e-6).all()


# passages


def plain_passages(rows, window):
    firsts, out = {}, []
    texts = [(i, WORD.findall(t or "")) for i, t in rows]
    for i, w in texts:
        if i is not None:
            for a in range(len(w) - window + 1):
                key = tuple(w[a : a + window])
                firsts[key] = min(firsts.get(key, i), i)
    for i, w in texts:
        gone = set()
        if i is not None:
            for a in range(len(w) - window + 1):
                if firsts[tuple(w[a : a + window])] < i:
                    gone |= set(range(a, a + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((str(i), len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def passages(spark, rows, **options):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit("clash")).withColumn("anchor", F.lit(1)).withColumn("Spans", F.lit(2))
    return sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.report(df, **options).collect())


def copied_texts(rng, n, vocabulary, lengths):
    texts = []
    for _ in range(n):
        t = [rng.choice(vocabulary) for _ in range(rng.choice(lengths))]
        for _ in range(rng.randrange(3)):
            if texts and (s := rng.choice(texts)):
                a = rng.randrange(len(s))
                k = rng.randrange(len(t) + 1)
                t[k:k] = s[a : a + rng.choice([3, 6, 49, 50, 51, 120])]
        texts.append(t)
    return texts


@pytest.mark.parametrize(("window", "anchor"), [(50, 16), (6, 2), (5, 1), (4, 4), (7, 3)])
def test_passages_equal_all_windows(spark, window, anchor):
    rng = random.Random(window)
    small = ["a", "b", "ab", "ä", "A"]
    large = [f"w{i}" for i in range(500)]
    texts = copied_texts(rng, 60, large, [0, 1, 30, 80, 200]) + copied_texts(rng, 25, small, [3, 20, 60]) + [["x"] * 300, ["x"] * 120, ["a", "b"] * 90, ["b", "a"] * 70]
    rows = [(i, rng.choice([" ", "\t", "  \n"]).join(t)) for i, t in enumerate(texts)]
    rows += [(500, None), (501, ""), (502, " \x0b\x0c"), (None, rows[3][1]), (None, "x " * 200), (7, rows[9][1]), rows[5], rows[5], (-4, rows[20][1]), (900, " ".join(rng.choice(large) for _ in range(20_000)))]
    rows += [(901, rows[-1][1] + " end"), (902, " ".join(large[:80]))]
    rng.shuffle(rows)
    assert passages(spark, rows, window=window, anchor=anchor) == plain_passages(rows, window)


def test_passage_that_many_documents_share(spark):
    """A third of all documents have it; what stands around it is their own."""
    rng = random.Random(2)
    line = [f"p{i}" for i in range(70)]
    rows = [(i, " ".join([*(f"q{rng.randrange(9999)}" for _ in range(30)), *(line if i % 3 == 0 else line[:45]), *(f"q{rng.randrange(9999)}" for _ in range(30))])) for i in range(120)]
    got = passages(spark, rows)
    assert got == plain_passages(rows, 50) and Counter(r[2] for r in got) == {0: 81, 70: 39}


def test_factors_and_texts(spark):
    words = [f"w{i}" for i in range(200)]
    df = spark.createDataFrame([(1, " ".join(words)), (2, "new " + " ".join(words[20:90]) + " words " + " ".join(words[:60]))], "doc_id long, text string")
    got = {r.doc_id: r for r in substring_dedup.parse(df).collect()}
    assert got[1].factors == [] and got[1].kept == " ".join(words)
    assert [tuple(f) for f in got[2].factors] == [(1, 71), (72, 132)] and got[2].kept == "new words"
    assert substring_dedup.factors([(5, 9), (0, 3), (3, 5), (20, 22), (6, 7)]) == [(0, 9), (20, 22)]


def test_passages_without_rows(spark):
    assert passages(spark, []) == []


# audit of filters


def plain_audit(docs, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    first = {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    rows = []
    for i, t, lang in docs:
        t = t or ""
        w = WORD.findall(t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t), "D": any(c in t for c in "#$%&*|"), "E": i is not None and i > first[t]}
        rows.append((lang or "", {k for k, v in fails.items() if v}, i in good, i in toxic))
    out = []
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        shapley = Counter()
        steps = []
        for order in permutations("ABCDE"):
            for k, f in enumerate(order):
                before = set(order[:k])
                gone = [r for r in mine if f in r[1] and not r[1] & before]
                shapley[f] += len(gone)
                steps.append((f, [part, "".join(order), k + 1, sum(not r[1] & {*before, f} for r in mine), len(gone), sum(f in r[1] for r in mine) - len(gone), sum(r[1] == {f} for r in mine), sum(r[2] for r in gone), sum(r[3] for r in gone)]))
        out += [(*row, shapley[f]) for f, row in steps]
    return sorted(out)


def audited(spark, docs, labels):
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumn("n", F.lit("clash")).withColumn("Good", F.lit(1)).withColumn("A", F.lit(1))
    l = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("lang", F.lit("clash"))
    return sorted(map(tuple, filter_audit.report(d, l).collect()))


def test_audit_equals_every_order(spark):
    rng = random.Random(9)
    texts = [" ".join(rng.choice(["Alpha", "beta", "GAMMA", "né", "del|ta", "x", *(f"w{k}" for k in range(300))]) for _ in range(rng.choice([0, 5, 199, 200, 260]))) for _ in range(40)]
    texts += ["word " * 400, "W " * 250, " ".join(f"u{i}" for i in range(30_000)), "A" * 3 + "é" * 97, "A" * 4 + "é" * 96, "", "\x0b", "a b"]
    docs = [(i, rng.choice(texts), rng.choice(["en", "de", None, ""])) for i in range(150)] + [(1000 + i, texts[0], "en") for i in range(70)]  # copies: a third of all
    docs += [(None, texts[0], "en"), (None, None, None), (5, None, "en"), (5, "", "de"), (5, "", "de"), docs[3], docs[3], (-7, texts[0], "fr")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 1100, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1), (99_999, 1, 1)]
    rng.shuffle(docs)
    assert audited(spark, docs, labels) == plain_audit(docs, labels)


def test_audit_without_rows(spark):
    assert audited(spark, [], [(1, 1, 1)]) == []
    assert audited(spark, [(1, None, None)], []) == plain_audit([(1, None, None)], [])

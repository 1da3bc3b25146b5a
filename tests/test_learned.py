"""Stratified folds, extremely randomised trees, and pairs and routes of citations, against plain Python."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.operators import pair_routes, random_trees, selectors
from rankloom.operators.random_trees import Growth, Tree


def test_folds_are_exact_strata(spark):
    rng = random.Random(6)
    rows = [(f"c{i}", y) for i in range(203) for y in [rng.choice([0, 0, 0, 1, None])] for _ in range(rng.randrange(1, 4))] + [("m", 0), ("m", 1)]
    d = spark.createDataFrame(rows, "case_id string, label int")
    for folds in (2, 5):
        got = {r.case_id: r.fold for r in selectors.stratified_folds(d, "case_id", folds=folds).collect()}
        assert got == {r.case_id: r.fold for r in selectors.stratified_folds(d.repartition(7), "case_id", folds=folds).collect()}
        label = {}
        for k, y in rows:
            label[k] = y if label.get(k) is None else max(label[k], y if y is not None else label[k])
        assert set(got) == set(label)
        for of in [*[[k for k in label if label[k] == y] for y in (0, 1, None)], list(label)]:
            n = Counter(got[k] for k in of)
            assert max(n.values()) - min(n[f] for f in range(folds)) <= 1
    other = {r.case_id: r.fold for r in selectors.stratified_folds(d, "case_id", seed=7).collect()}
    assert other != {r.case_id: r.fold for r in selectors.stratified_folds(d, "case_id").collect()}


def plain_forest(x, y, g):
    weights = random_trees.weights_of(g, int((y == 0).sum()), int((y == 1).sum()))
    forest = []
    for t in range(g.trees):
        tree = Tree()

        def split(node, rows, depth, tree=tree, t=t):
            n1 = int(y[rows].sum())
            n0 = len(rows) - n1
            if depth < g.depth and n0 and n1 and len(rows) >= 2 * g.leaf:
                cuts = random_trees.drawn(g, t, node, x[rows].min(axis=0), x[rows].max(axis=0))
                left = [(int((~y[rows].astype(bool) & (x[rows, f] <= c)).sum()), int((y[rows].astype(bool) & (x[rows, f] <= c)).sum())) for f, c in cuts]
                if found := random_trees.best(g, weights, (n0, n1), cuts, left):
                    tree.splits[node] = found
                    f, c = found
                    split(2 * node, rows[x[rows, f] <= c], depth + 1)
                    split(2 * node + 1, rows[x[rows, f] > c], depth + 1)
                    return
            tree.leaves[node] = random_trees.share_of(weights, n0, n1)

        split(1, np.arange(len(x)), 0)
        forest.append(tree)
    return forest


@pytest.mark.parametrize("g", [Growth(trees=6, depth=4, leaf=3, share=0.7, seed=1), Growth(trees=3, depth=1, leaf=40, balanced=False), Growth(trees=2, depth=0)])
def test_trees_equal_a_plain_grower(spark, g):
    rng = np.random.default_rng(4)
    y = rng.integers(0, 2, 160)
    x = np.column_stack([rng.normal(y * 2.0), rng.integers(0, 3, 160), np.ones(160), rng.normal(size=160)])
    d = spark.createDataFrame([(i, r.tolist(), int(v)) for i, (r, v) in enumerate(zip(x, y, strict=True))], "id long, features array<double>, label int")
    want = plain_forest(x, y, g)
    for parts in (1, 5):
        grown = random_trees.grow(d.repartition(parts), g)
        assert [(t.splits, t.leaves) for t in grown] == [(t.splits, t.leaves) for t in want]
    got = {r.id: r.probability for r in random_trees.score(d, grown).collect()}
    assert [got[i] for i in range(160)] == pytest.approx(random_trees.probability(want, x).tolist())
    if g.depth == 4:
        assert np.mean((np.array([got[i] for i in range(160)]) > 0.5) == (y == 1)) > 0.8


def test_trees_without_rows_or_choice(spark):
    d = spark.createDataFrame([], "features array<double>, label int")
    empty = random_trees.grow(d, Growth(trees=2))
    assert random_trees.score(d, empty).count() == 0 and random_trees.probability(empty, np.zeros((3, 2))).tolist() == [0, 0, 0]
    same = random_trees.grow(spark.createDataFrame([([1.0], 1)] * 9, "features array<double>, label int"), Growth(trees=1))
    assert same[0].splits == {} and same[0].leaves == {1: 1.0}


def test_extra_trees_out_of_fold(spark, monkeypatch):
    monkeypatch.setitem(selectors.GROWN, "extra_trees", Growth(trees=8, depth=4, leaf=3))
    rng = random.Random(2)
    rows = [(f"c{i}", [rng.gauss(2.0 * (i % 4 == 0), 0.6), rng.random()], int(i % 4 == 0)) for i in range(160)] + [("u", [2.0, 0.5], None)]
    scored = selectors.out_of_fold(spark.createDataFrame(rows, "case_id string, features array<double>, label int"), "case_id", folds=2, family="extra_trees", balanced=True)
    got = {r.case_id: r for r in scored.collect()}
    assert len(got) == 161 and got["u"].probability > 0.5  # scored, not learned from
    assert np.mean([(r.probability > 0.5) == (r.label == 1) for r in got.values() if r.label is not None]) > 0.8


# pairs and routes

WORDS = "paris london older first river tower bridge built both city born".split()


def normal(t):
    return " ".join(w for w in re.sub(r"[^\w\s]", "", t.lower()).split() if w not in ("a", "an", "the"))


def tokens(t):
    return set(re.findall(r"[a-z0-9]+", t.lower()))


def share(part, of):
    return len(part & of) / max(1, len(of))


def plain_pair(query, one, two, docs, i, j):
    q, a = tokens(query), tokens(one[0])
    out = []
    for (k, d), (_, o) in (((i, docs[i]), (j, docs[j])), ((j, docs[j]), (i, docs[i]))):
        title, text = tokens(d[1]), tokens(d[2])
        out += [1 / (k + 1), k + 1, share(title, q), share(text, q), share(text, a), normal(one[0]) in normal(d[2]), d[0] in one[1], d[0] in two[1], share(tokens(o[2]), title), normal(d[1]) in normal(o[2])]
    pair, c1, c2 = {docs[i][0], docs[j][0]}, set(one[1]), set(two[1])
    compares = bool({"both", "older", "younger", "first", "earlier", "later", "more", "less"} & q)
    return [float(v) for v in (*out, normal(one[0]) == normal(two[0]), len(pair & c1), len(pair & c2), c1 <= pair, c2 <= pair, bool(pair & c1), bool(pair & c2), i == 0, compares)]


def plain_route(query, one, two, docs, probability, margin):
    def side(run):
        a, cited = tokens(run[0]), [d for d in docs if d[0] in run[1]]
        holds = lambda ds: sum(normal(run[0]) in normal(d[2]) for d in ds)
        return [len(run[0]), len(a), len(set(run[1])), holds(docs), holds(cited), sum(share(tokens(d[2]), a) for d in cited) / max(1, len(cited))]

    a, b = normal(one[0]), normal(two[0])
    compares = bool({"both", "older", "younger", "first", "earlier", "later", "more", "less"} & tokens(query))
    return [float(v) for v in (a == b, a in b or b in a, len(set(one[1]) & set(two[1])), probability, margin, compares, *side(one), *side(two))]


@pytest.fixture(scope="module")
def suite(spark):
    rng = random.Random(12)
    say = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    cases = {}
    for c in range(60):
        docs = [(f"d{k}", say(rng.randrange(3)), say(rng.randrange(1, 9)) + rng.choice(["", ".", " The"])) for k in range(rng.randrange(1, 6))]
        gold = sorted(rng.sample([d[0] for d in docs], min(2, len(docs))))
        cite = lambda docs=docs, gold=gold: sorted(set(gold)) if rng.random() < 0.5 else sorted(rng.sample([d[0] for d in docs], rng.randrange(len(docs) + 1)))
        first = (say(rng.randrange(3)), cite(), rng.random() < 0.7)
        second = (first[0] if rng.random() < 0.5 else say(2), cite(), rng.random() < 0.7)
        cases[f"c{c:02}"] = (say(4), docs, first, second, (first[0], cite(), first[2]), gold)
    work = spark.createDataFrame([(c, q, docs) for c, (q, docs, *_) in cases.items()], "case_id string, query string, contexts array<struct<document_id: string, title: string, text: string>>")
    run = lambda k: spark.createDataFrame([(c, r[k][0], r[k][1], r[k][2], r[k][2] and set(r[5]) <= set(r[k][1])) for c, r in cases.items()], "case_id string, prediction string, cited_document_ids array<string>, exact boolean, joint_correct boolean")
    gold = spark.createDataFrame([(c, r[5]) for c, r in cases.items()], "case_id string, gold array<string>")
    return cases, work, run(2), run(3), run(4), gold


def test_features_of_pairs_and_routes(spark, suite):
    cases, work, first, second, _, _ = suite
    got = defaultdict(dict)
    for r in pair_routes.pair_features(work, first, second).collect():
        got[r.case_id][r.left, r.right] = (r.left_id, r.right_id, r.features)
    assert len(pair_routes.PAIR_FEATURES) == 29 and len(pair_routes.ROUTE_FEATURES) == 18
    for c, (q, docs, one, two, *_) in cases.items():
        want = {(i, j): (docs[i][0], docs[j][0], pytest.approx(plain_pair(q, one, two, docs, i, j))) for i in range(len(docs)) for j in range(i + 1, len(docs))}
        assert got[c] == want
    rng = random.Random(1)
    sure = {c: (rng.random(), rng.random()) for c in cases if c != "c00"}
    tops = spark.createDataFrame([(c, ["x", "y"], *v) for c, v in sure.items()], "case_id string, pair array<string>, probability double, margin double")
    for r in pair_routes.route_features(work, first, second, tops).collect():
        q, docs, one, two, *_ = cases[r.case_id]
        assert r.features == pytest.approx(plain_route(q, one, two, docs, *sure.get(r.case_id, (0.0, 0.0))))


def test_top_pairs_and_what_they_change(spark):
    rows = [("a", 0, 1, "x", "y", 0.5), ("a", 0, 2, "x", "z", 0.75), ("a", 1, 2, "y", "z", 0.75), ("b", 0, 1, "u", "v", 0.1), ("c", 0, 1, "k", "l", 0.9), ("d", 0, 1, "m", "n", 0.9)]
    tops = pair_routes.top_pairs(spark.createDataFrame(rows, "case_id string, left int, right int, left_id string, right_id string, probability double"))
    assert sorted((r.case_id, r.pair, r.probability, r.margin) for r in tops.collect()) == [("a", ["x", "z"], 0.75, 0.0), ("b", ["u", "v"], 0.1, 0.1), ("c", ["k", "l"], 0.9, 0.9), ("d", ["m", "n"], 0.9, 0.9)]
    base = spark.createDataFrame([("a", ["x", "q"]), ("b", ["u"]), ("c", ["k"]), ("d", ["q"]), ("e", ["w"])], "case_id string, cited_document_ids array<string>")
    agree = spark.createDataFrame([("a", True, True), ("b", True, True), ("c", False, True), ("d", True, True), ("e", True, False)], "case_id string, agree boolean, exact boolean")
    gold = spark.createDataFrame([("a", ["x", "z"]), ("b", ["u"]), ("c", ["k", "l"]), ("d", ["m", "n"]), ("e", ["w"])], "case_id string, gold array<string>")
    got = {r.case_id: (r.cited, r.evidence_complete, r.joint_correct, r.citation_recall) for r in pair_routes.cited_pairs(base, tops, agree, gold).collect()}
    # a: taken; b: not probable enough; c: answers differ; d: nothing cited is in it; e: no pair
    assert got == {"a": (["x", "z"], True, True, 1.0), "b": (["u"], True, True, 1.0), "c": (["k"], False, False, 0.5), "d": (["q"], False, False, 0.0), "e": (["w"], True, False, 1.0)}
    told = pair_routes.route_labels(spark.createDataFrame([("a", True), ("b", False), ("c", True)], "case_id string, joint_correct boolean"), spark.createDataFrame([("a", False), ("b", True), ("c", True)], "case_id string, joint_correct boolean"))
    assert sorted(map(tuple, told.collect())) == [("a", 0), ("b", 1)]


def test_both_levels_are_decided_out_of_fold(spark, suite, monkeypatch):
    cases, work, first, second, base, gold = suite
    monkeypatch.setitem(selectors.GROWN, "extra_trees", Growth(trees=4, depth=3, leaf=3))
    got = {r.case_id: r for r in pair_routes.decided(work, base, first, second, gold, folds=2, pair_family="extra_trees", route_family="extra_trees").collect()}
    assert set(got) == set(cases)
    for c, (_, docs, one, two, policy, good) in cases.items():
        r = got[c]
        if r.route == "second":
            assert r.route_probability >= 0.63 and r.cited == sorted(set(two[1])) and r.joint_correct == (two[2] and set(good) <= set(two[1]))
        else:
            assert r.route_probability < 0.63 and r.joint_correct == (one[2] and set(good) <= set(r.cited))
            assert r.cited == sorted(set(policy[1])) or (normal(one[0]) == normal(two[0]) and r.pair_probability >= 0.15 and set(r.cited) & set(policy[1]))
        assert (r.pair_probability is None) == (len(docs) < 2)

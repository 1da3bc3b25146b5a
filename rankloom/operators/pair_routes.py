"""Two levels of learned citation: which pair of a case's documents is cited, then whose route is taken, each scored out of fold.

A case's contexts are few by contract, so its pairs are made within its own row: no document meets another case's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats
from ..functions.text import alnum_tokens, normalize_answer
from .selectors import out_of_fold, share

#: The words of a comparing question, and the probabilities from which a pair and a route are taken.
COMPARING = ["both", "older", "younger", "first", "earlier", "later", "more", "less"]
PAIR_THRESHOLD, ROUTE_THRESHOLD = 0.15, 0.63
#: The features of a side of a pair, of a pair as a whole, of a case's routes, and of one route.
SIDE = ["inverse_rank", "rank", "title_in_query", "text_in_query", "answer_in_text", "answer_stands", "cited_first", "cited_second", "title_elsewhere", "title_stands_elsewhere"]
WHOLE = ["answers_agree", "first_cited", "second_cited", "first_within", "second_within", "first_meets", "second_meets", "has_top", "comparing"]
PAIR_FEATURES = [f"left_{f}" for f in SIDE] + [f"right_{f}" for f in SIDE] + WHOLE
ROUTE = ["answer_length", "answer_words", "citations", "contexts_with_answer", "citations_with_answer", "answer_in_citations"]
ROUTE_FEATURES = ["answers_agree", "answer_within", "citations_shared", "pair_probability", "pair_margin", "comparing"] + [f"first_{f}" for f in ROUTE] + [f"second_{f}" for f in ROUTE]


def _number(c: Column) -> Column:
    return c.cast("double")


def _read(work: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """A row a case: the question's and answers' words, both runs' citations, and its documents with their words."""
    side = lambda r, p: r.select("case_id", F.coalesce("prediction", F.lit("")).alias(f"{p}p"), F.array_distinct("cited_document_ids").alias(f"{p}c"))
    rows = work.select("case_id", "query", "contexts").join(side(first, "a"), "case_id").join(side(second, "b"), "case_id")
    head = rows.select("case_id", alnum_tokens(F.col("query")).alias("q"), *[x for p in "ab" for x in (F.col(f"{p}p"), F.col(f"{p}c"), alnum_tokens(F.col(f"{p}p")).alias(f"{p}t"), normalize_answer(F.col(f"{p}p")).alias(f"{p}n"))])
    docs = rows.select("case_id", F.posexplode("contexts").alias("pos", "c")).select(
        "case_id", "pos", F.col("c.document_id").alias("id"), alnum_tokens(F.col("c.title")).alias("title"), alnum_tokens(F.col("c.text")).alias("words"),
        normalize_answer(F.col("c.title")).alias("plain_title"), normalize_answer(F.col("c.text")).alias("plain"),
    )
    docs = docs.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("pos", "id", "title", "words", "plain_title", "plain"))).alias("docs"))
    return head.join(docs, "case_id", "left")


def _side(x: Column, other: Column) -> list[Column]:
    rank = _number(x["pos"] + 1)
    return [
        1 / rank, rank, share(x["title"], F.col("q")), share(x["words"], F.col("q")), share(x["words"], F.col("at")), _number(x["plain"].contains(F.col("an"))),
        _number(F.array_contains("ac", x["id"])), _number(F.array_contains("bc", x["id"])), share(other["words"], x["title"]), _number(other["plain"].contains(x["plain_title"])),
    ]


def pair_features(work: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """(case_id, left, right, left_id, right_id, features) of every two contexts of a work item (case_id, query, contexts: array of document_id, title, text), the better ranked one left, given two
    runs (case_id, prediction, cited_document_ids)."""

    def whole(x: Column, y: Column) -> list[Column]:
        pair = F.array(x["id"], y["id"])
        within = lambda c: F.size(F.array_intersect(F.col(c), pair))
        return [
            _number(F.col("an") == F.col("bn")), _number(within("ac")), _number(within("bc")), _number(within("ac") == F.size("ac")), _number(within("bc") == F.size("bc")),
            _number(within("ac") > 0), _number(within("bc") > 0), _number(x["pos"] == 0), _number(F.arrays_overlap(F.array(*map(F.lit, COMPARING)), F.col("q"))),
        ]

    one = lambda x, y: F.struct(x["pos"].alias("left"), y["pos"].alias("right"), x["id"].alias("left_id"), y["id"].alias("right_id"), F.array(*_side(x, y), *_side(y, x), *whole(x, y)).alias("features"))
    pairs = F.flatten(F.transform("docs", lambda x: F.transform(F.filter("docs", lambda y: y["pos"] > x["pos"]), lambda y: one(x, y))))
    return _read(work, first, second).select("case_id", F.explode(pairs).alias("p")).select("case_id", "p.*")


def top_pairs(scored: DataFrame) -> DataFrame:
    """(case_id, pair, probability, margin): each case's most probable pair, the first of equal ones, and how far the next is behind; a lone pair's margin is its own probability."""
    order = Window.partitionBy("case_id").orderBy(F.desc("probability"), "left", "right")
    rows = scored.withColumn("n", F.row_number().over(order)).where("n <= 2")
    second = F.max(F.when(F.col("n") == 2, F.col("probability")))
    best = rows.groupBy("case_id").agg(F.max(F.when(F.col("n") == 1, F.col("probability"))).alias("probability"), second.alias("next"), F.max(F.when(F.col("n") == 1, F.array("left_id", "right_id"))).alias("pair"))
    return best.select("case_id", "pair", "probability", (F.col("probability") - F.coalesce("next", F.lit(0.0))).alias("margin"))


def cited_pairs(base: DataFrame, tops: DataFrame, agree: DataFrame, gold: DataFrame, threshold: float = PAIR_THRESHOLD) -> DataFrame:
    """(case_id, cited, citation_precision, citation_recall, evidence_complete, joint_correct) of a policy's citations (case_id, cited_document_ids) with the top pair in their place.

    A pair is taken where both runs' answers agree (case_id, agree, exact), its probability reaches the threshold and it holds a document that was cited. Gold: (case_id, gold: array of ids).
    """
    rows = base.select("case_id", F.array_distinct("cited_document_ids").alias("old")).join(tops, "case_id", "left").join(agree.select("case_id", "agree", "exact"), "case_id").join(gold, "case_id")
    takes = F.col("agree") & (F.col("probability") >= threshold) & F.arrays_overlap("pair", "old")
    rows = rows.withColumn("cited", F.array_sort(F.when(F.coalesce(takes, F.lit(False)), F.array_distinct("pair")).otherwise(F.col("old"))))
    both, whole = F.size(F.array_intersect("cited", "gold")), F.size(F.array_except("gold", "cited")) == 0
    rates = [stats.rate(both, F.size("cited")).alias("citation_precision"), stats.rate(both, F.size("gold")).alias("citation_recall")]
    return rows.select("case_id", "cited", *rates, whole.alias("evidence_complete"), (F.col("exact") & whole).alias("joint_correct"))


def route_features(work: DataFrame, first: DataFrame, second: DataFrame, tops: DataFrame) -> DataFrame:
    """(case_id, features): how the two runs' answers and citations stand to one another and to the contexts, and how sure the pair is."""

    def route(p: str) -> list[Column]:
        words, plain, cites = F.col(f"{p}t"), F.col(f"{p}n"), F.col(f"{p}c")
        docs = F.coalesce(F.col("docs"), F.array().cast(rows.schema["docs"].dataType))
        mine = F.filter(docs, lambda d: F.array_contains(cites, d["id"]))
        holding = lambda of: _number(F.size(F.filter(of, lambda d: d["plain"].contains(plain))))
        shares = F.aggregate(F.transform(mine, lambda d: share(d["words"], words)), F.lit(0.0), lambda acc, x: acc + x)
        return [_number(F.length(f"{p}p")), _number(F.size(words)), _number(F.size(cites)), holding(docs), holding(mine), shares / F.greatest(F.size(mine), F.lit(1))]

    rows = _read(work, first, second).join(tops.select("case_id", "probability", "margin"), "case_id", "left")
    a, b = F.col("an"), F.col("bn")
    head = [
        _number(a == b), _number(b.contains(a) | a.contains(b)), _number(F.size(F.array_intersect("ac", "bc"))), F.coalesce("probability", F.lit(0.0)), F.coalesce("margin", F.lit(0.0)),
        _number(F.arrays_overlap(F.array(*map(F.lit, COMPARING)), F.col("q"))),
    ]
    return rows.select("case_id", F.array(*head, *route("a"), *route("b")).alias("features"))


def route_labels(pairs_joint: DataFrame, other_joint: DataFrame) -> DataFrame:
    """(case_id, label) of the cases that tell the routes apart: 1 where only the other run is right, 0 where only the pairs are; both: (case_id, joint_correct)."""
    rows = pairs_joint.select("case_id", F.col("joint_correct").alias("p")).join(other_joint.select("case_id", F.col("joint_correct").alias("o")), "case_id")
    return rows.where(F.col("p") != F.col("o")).select("case_id", F.col("o").cast("int").alias("label"))


def decided(work: DataFrame, base: DataFrame, first: DataFrame, second: DataFrame, gold: DataFrame, folds: int = 5, pair_family: str = "gradient_boosting", route_family: str = "random_forest", pair_threshold: float = PAIR_THRESHOLD, route_threshold: float = ROUTE_THRESHOLD) -> DataFrame:
    """(case_id, route, cited, joint_correct, pair_probability, route_probability): both levels, learned and scored out of fold.

    base, first and second: runs (case_id, prediction, cited_document_ids, exact, joint_correct); gold: (case_id, gold). The second level learns from the cases where the first level's
    pairs and the second run differ in being right; of the others it scores all, by a model of a fold they are not in.
    """
    pairs = pair_features(work, first, second).join(gold, "case_id")
    pairs = pairs.withColumn("label", ((F.size("gold") == 2) & (F.size(F.array_except("gold", F.array("left_id", "right_id"))) == 0)).cast("int")).drop("gold")
    scored = out_of_fold(pairs, "case_id", folds=folds, family=pair_family)
    tops = top_pairs(scored)
    norm = lambda r, p: r.select("case_id", normalize_answer(F.coalesce("prediction", F.lit(""))).alias(p), F.col("exact").alias(f"{p}e"))
    agree = norm(first, "a").join(norm(second, "b"), "case_id").select("case_id", (F.col("a") == F.col("b")).alias("agree"), F.col("ae").alias("exact"))
    by_pairs = cited_pairs(base, tops, agree, gold, pair_threshold)
    told = route_labels(by_pairs, second)
    features = route_features(work, first, second, tops)
    routes = out_of_fold(features.join(told, "case_id", "left"), "case_id", folds=folds, family=route_family, balanced=True).select("case_id", F.col("probability").alias("route_probability"))
    other = second.select("case_id", F.array_sort(F.array_distinct("cited_document_ids")).alias("other_cited"), F.col("joint_correct").alias("other_joint"))
    rows = by_pairs.join(other, "case_id").join(routes, "case_id").join(tops.select("case_id", F.col("probability").alias("pair_probability")), "case_id", "left")
    takes = F.col("route_probability") >= route_threshold
    return rows.select(
        "case_id", F.when(takes, "second").otherwise("pairs").alias("route"), F.when(takes, F.col("other_cited")).otherwise(F.col("cited")).alias("cited"),
        F.when(takes, F.col("other_joint")).otherwise(F.col("joint_correct")).alias("joint_correct"), "pair_probability", "route_probability",
    )

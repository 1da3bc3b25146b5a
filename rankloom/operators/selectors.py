"""Learned selectors: features of candidate documents, out-of-fold scores, thresholds chosen on them, and the decisions they lead to."""

from __future__ import annotations

from dataclasses import replace

from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import stats
from ..functions.text import alnum_tokens, normalize_answer
from ..staging import staged
from . import random_trees
from .metrics import running

#: The thresholds of a sweep, the least citation precision of a selector, and the features of a candidate document.
GRID = tuple(i / 100.0 for i in range(5, 96))
PRECISION_FLOOR = 0.94
FEATURES = (
    "inverse_rank rank title_in_query text_in_query answer_in_text answer_stands cited_first cited_second cited_both answers_agree title_elsewhere title_words text_words"
).split()


def share(part: Column, of: Column) -> Column:
    """How much of a set of words another one has; the share of nothing is 0."""
    return F.size(F.array_intersect(part, of)) / F.greatest(F.size(of), F.lit(1))


def document_features(work: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """(case_id, document_id, rank, features) of each context of work items (case_id, query, contexts), given two runs (case_id, prediction, cited_document_ids).

    The words elsewhere are those of the case's other contexts, which are one row's array: nothing is joined but the runs.
    """
    side = lambda r, p: r.select("case_id", F.col("prediction").alias(f"{p}p"), F.col("cited_document_ids").alias(f"{p}c"))
    rows = work.join(side(first, "a"), "case_id").join(side(second, "b"), "case_id")
    rows = rows.withColumn("agree", (normalize_answer(F.col("ap")) == normalize_answer(F.col("bp"))).cast("double")).withColumn("np", normalize_answer(F.col("ap")))
    rows = rows.select("case_id", "agree", "np", "ac", "bc", alnum_tokens(F.col("query")).alias("q"), alnum_tokens(F.col("ap")).alias("a"), F.col("contexts").alias("all"), F.posexplode("contexts").alias("pos", "c"))
    others = F.array_join(F.transform(F.filter("all", lambda x: x["document_id"] != F.col("c.document_id")), lambda x: x["text"]), " ")
    rows = rows.withColumns({"tt": alnum_tokens(F.col("c.title")), "dt": alnum_tokens(F.col("c.text")), "ot": alnum_tokens(others), "nd": normalize_answer(F.col("c.text"))})
    rank = (F.col("pos") + 1).cast("double")
    one, two = F.array_contains("ac", F.col("c.document_id")), F.array_contains("bc", F.col("c.document_id"))
    values = [1 / rank, rank, share(F.col("tt"), F.col("q")), share(F.col("dt"), F.col("q")), share(F.col("dt"), F.col("a")), F.col("nd").contains(F.col("np")).cast("double"), one.cast("double"), two.cast("double"), (one & two).cast("double"), F.col("agree"), share(F.col("ot"), F.col("tt")), F.size("tt").cast("double"), F.size("dt").cast("double")]
    return rows.select("case_id", F.col("c.document_id").alias("document_id"), (F.col("pos") + 1).alias("rank"), F.array(*values).alias("features"))


def logistic(features: Column, weights: list[float], bias: float) -> Column:
    """The probability of a linear model, its score held to 700 either way."""
    z = F.aggregate(F.zip_with(features, F.array(*map(F.lit, weights)), lambda x, w: x * w), F.lit(float(bias)), lambda acc, x: acc + x)
    return 1 / (1 + F.exp(-F.greatest(F.lit(-700.0), F.least(F.lit(700.0), z))))


def stratified_folds(rows: DataFrame, key: str, label: str = "label", folds: int = 5, seed: int = 42) -> DataFrame:
    """(key, fold): exact strata. Of each label the keys go to the folds in turn, in an order drawn by hash, and a label begins where the one before it ended, so a label's and all keys' numbers
    differ by one at most between folds. A key is one unit, whose label is the largest of its rows (null: a stratum of its own).

    The turn is a running count over ranges of the order, so no task holds a label whole.
    """
    one = rows.groupBy(F.col(key).alias("__key")).agg(F.max(label).alias("__label")).withColumn("one", F.lit(1))
    one = staged(one.withColumn("__at", F.struct(F.coalesce(F.col("__label").cast("double"), F.lit(-1.0)), F.sha2(F.concat(F.lit(f"{seed}:"), F.col("__key").cast("string")), 256))), "strata")
    return running(one, F.col("__at"), ["one"]).select(F.col("__key").alias(key), F.pmod(F.col("upto_one") - 1, F.lit(folds)).cast("int").alias("fold"))


#: Families of models and how each is grown; those of trees differ from run to run only by their seed.
FAMILIES = {
    "logistic_regression": lambda: LogisticRegression(regParam=0.01),
    "random_forest": lambda: RandomForestClassifier(numTrees=200, maxDepth=8, minInstancesPerNode=5, featureSubsetStrategy="0.8", seed=42),
    "gradient_boosting": lambda: GBTClassifier(maxIter=100, maxDepth=3, minInstancesPerNode=5, seed=42),
}
#: The family that MLlib doesn't have.
GROWN = {"extra_trees": random_trees.Growth(trees=100, depth=10, leaf=4, share=0.9)}


def out_of_fold(rows: DataFrame, key: str, label: str = "label", folds: int = 5, family: str = "logistic_regression", balanced: bool = False) -> DataFrame:
    """The rows (with `features`, an array, and a label 0 or 1) and `probability`, from a model that has seen no row of the same key's fold. A fold whose others have one label only gets that label's share.
    Folds are strata of the label. Rows without a label are scored, but not learned from. `balanced`: both labels weigh the same in training."""
    kept = rows.columns
    data = staged(rows.join(stratified_folds(rows, key, label, folds).withColumnRenamed("fold", "__fold"), key), "folds")
    data = data.withColumn("__x", array_to_vector("features")).withColumn("__y", F.col(label).cast("double"))
    out = None
    for f in range(folds):
        train, rest = data.where((F.col("__fold") != f) & F.col("__y").isNotNull()), data.where(F.col("__fold") == f)
        rate = train.agg(F.avg("__y").alias("r")).first().r
        if rate is None or rate in (0.0, 1.0):
            one = rest.select(*kept, F.lit(float(rate or 0.0)).alias("probability"))
        elif family in GROWN:
            growth = replace(GROWN[family], balanced=balanced)
            one = random_trees.score(rest.select(*kept), random_trees.grow(train.select("features", F.col("__y").alias("label")), growth))
        else:
            weight = F.when(F.col("__y") == 1.0, 0.5 / rate).otherwise(0.5 / (1.0 - rate)) if balanced else F.lit(1.0)
            model = FAMILIES[family]().setFeaturesCol("__x").setLabelCol("__y").setProbabilityCol("__p").setRawPredictionCol("__raw").setPredictionCol("__guess").setWeightCol("__w").fit(train.withColumn("__w", weight))
            one = model.transform(rest.drop("__y")).select(*kept, F.get(vector_to_array("__p"), F.lit(1)).alias("probability"))
        out = one if out is None else out.unionByName(one)
    return out


def selections(cases: DataFrame, scored: DataFrame, thresholds: tuple[float, ...] = GRID) -> DataFrame:
    """(threshold, case_id, selected, joint_correct, citation_precision, citation_recall, added) of cases (case_id, agree, first, second, gold: arrays of ids, exact) and scored documents.

    A case keeps the first run's citations; where the runs' answers agree it adds the second's and the documents whose probability reaches the threshold.
    """
    docs = scored.groupBy("case_id").agg(F.collect_list(F.struct("document_id", "probability")).alias("d"))
    rows = cases.join(docs, "case_id", "left").withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds))))
    more = F.coalesce(F.transform(F.filter("d", lambda x: x["probability"] >= F.col("threshold")), lambda x: x["document_id"]), F.array().cast("array<string>"))
    chosen = F.when(F.col("agree"), F.array_union(F.array_union("first", "second"), more)).otherwise(F.array_distinct("first"))
    rows = rows.withColumn("selected", F.array_sort(chosen))
    both = F.size(F.array_intersect("selected", "gold"))
    whole = F.size(F.array_except("gold", "selected")) == 0
    return rows.select("threshold", "case_id", "selected", (F.col("exact") & whole).alias("joint_correct"), stats.rate(both, F.size("selected")).alias("citation_precision"), stats.rate(both, F.size("gold")).alias("citation_recall"), F.size(F.array_except("selected", F.array_union("first", "second"))).alias("added"))


def sweep(selected: DataFrame) -> DataFrame:
    """Means by threshold; cases without citations or gold are left out of theirs."""
    return selected.groupBy("threshold").agg(F.avg(F.col("joint_correct").cast("double")).alias("joint_correct_rate"), F.avg("citation_precision").alias("citation_precision"), F.avg("citation_recall").alias("citation_recall"), F.sum("added").alias("added_document_count"))


def chosen_threshold(swept: DataFrame, floor: float = PRECISION_FLOOR, least: float = GRID[0]) -> DataFrame:
    """The row with the best joint rate, then recall, then the lowest threshold, of those that keep the precision floor; none if there are none."""
    return swept.where((F.col("citation_precision") >= floor) & (F.col("threshold") >= least)).orderBy(F.desc("joint_correct_rate"), F.desc("citation_recall"), "threshold").limit(1)


def best_by(swept: DataFrame, order: list[Column]) -> DataFrame:
    """The first row in an order of columns: a model's and threshold's choice among several."""
    return swept.orderBy(*order).limit(1)


def pairs(scored: DataFrame) -> DataFrame:
    """(case_id, left, right, score): every two documents of a case (case_id, document_id, position, score), the earlier one first; a case's candidates are few by contract."""
    docs = scored.groupBy("case_id").agg(F.sort_array(F.collect_list(F.struct("position", "document_id", "score"))).alias("d"))
    both = F.flatten(F.transform("d", lambda x, i: F.transform(F.slice("d", i + 2, F.size("d")), lambda y: F.struct(x["document_id"].alias("left"), y["document_id"].alias("right"), (x["score"] + y["score"]).alias("score")))))
    return docs.select("case_id", F.explode(both).alias("p")).select("case_id", "p.*")


def routed(first: DataFrame, second: DataFrame, route: DataFrame, threshold: float) -> DataFrame:
    """(case_id, answer, citations): the second route's where the two differ and the route's probability (case_id, probability) reaches the threshold, else the first's."""
    rows = first.select("case_id", F.struct("answer", "citations").alias("a")).join(second.select("case_id", F.struct("answer", "citations").alias("b")), "case_id").join(route, "case_id", "left")
    other = ~F.col("a").eqNullSafe(F.col("b")) & F.coalesce(F.col("probability") >= threshold, F.lit(False))
    return rows.select("case_id", F.when(other, F.col("b")).otherwise(F.col("a")).alias("x")).select("case_id", "x.*")

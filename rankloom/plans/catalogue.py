"""Named queries over the driver tables, each with the DuckDB SQL it must equal.

`benchmark` items stand for queries, `documents` for the corpus; an item's gold documents are those whose text contains it. A tenth of the embeddings'
labels stand for relevance. `labels` are two raters.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import stats
from ..functions import text as tx
from ..operators import inverted, metrics, policy, ranking, sampling
from ..staging import staged

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def named(sql: str | None = None, name: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql is not None:
            SQL[name or f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# SQL pieces that several queries share
_TOK = r"regexp_extract_all(replace(lower(coalesce({0}, '')), 'ß', 'ss'), '[\pL\pN_]+')"
_BM25 = f"""
dw AS (SELECT doc_id, source, {_TOK.format("text")} AS ws FROM documents),
dt AS (SELECT doc_id, source, len(ws) AS dl, unnest(ws) AS term FROM dw),
tf AS (SELECT doc_id, source, dl, term, count(*) AS tf FROM dt GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
st AS (SELECT count(*) AS n_docs, avg(len(ws)) AS avg_dl FROM dw),
qt AS (SELECT DISTINCT item_id AS query_id, unnest({_TOK.format("text")}) AS term FROM benchmark),
bm AS (SELECT query_id, tf.doc_id, any_value(source) AS source, sum(ln(1 + (n_docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE
         / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / greatest(avg_dl, 1.0::DOUBLE)))) AS score
       FROM qt JOIN tf USING (term) JOIN df USING (term), st GROUP BY query_id, tf.doc_id),
bmr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM bm)"""
_GOLD = "gold AS (SELECT item_id AS query_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"
_DENSE = """
qv AS (SELECT vec_id AS query_id, label AS ql, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 100 = 0),
de AS (SELECT query_id, ql, vec_id AS doc_id, label, list_dot_product(q, embedding::DOUBLE[]) AS score FROM qv, embeddings WHERE vec_id <> query_id),
der AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM de)"""
_RMETRICS = """
h AS (SELECT k, gold.query_id, count(*) FILTER (WHERE rank <= k) AS hits, count(*) AS gold, min(rank) FILTER (WHERE rank <= k) AS first
      FROM (SELECT unnest([{ks}]) AS k), gold LEFT JOIN r ON gold.query_id = r.query_id AND gold.doc_id = r.doc_id GROUP BY ALL)
SELECT k, count(*) AS n, avg((hits > 0)::INT) AS any_recall, avg((hits = gold)::INT) AS all_recall, avg(hits / gold) AS evidence_recall, avg(coalesce(1.0::DOUBLE / first, 0)) AS mrr
FROM h GROUP BY k"""
_WORDS = r"list_filter(regexp_split_to_array(regexp_replace(replace(lower(coalesce({0}, '')), 'ß', 'ss'), '[!-/:-@\[-`{{-~]', '', 'g'), '\s+'), lambda x: x NOT IN ('', 'a', 'an', 'the'))"


class Lexical(NamedTuple):
    """An index of the documents with the items' words, a block of one source each, and the items' terms."""

    index: inverted.Index
    terms: DataFrame


def _lexical(spark: SparkSession, d: str) -> Lexical:
    """Written once: one scan of the texts serves all that a query makes of it."""
    terms = staged(inverted.term_rows(table(spark, d, "benchmark"), "item_id", F.col("text")), "terms")
    return Lexical(inverted.index(table(spark, d, "documents"), "doc_id", [(F.col("text"), 1.0)], terms, part="source"), terms)


def _gold(spark: SparkSession, d: str, found: Lexical) -> DataFrame:
    """Documents that contain an item word for word.

    Such a document has each of the item's inner words as a word; only documents that have them all are searched. Items of two words or less have no inner
    word; they are a stated query set against all rows.
    """
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("passage"))
    docs = table(spark, d, "documents").select("doc_id", "text")
    inner = found.terms.where("inner")
    near = staged(inverted.having(found.index, inner).select("query_id", "doc_id").join(items, "query_id"), "near-gold")
    gold = docs.join(near, "doc_id").where(F.col("text").contains(F.col("passage"))).select("query_id", "doc_id")
    short = items.join(inner, "query_id", "left_anti")
    if not short.isEmpty():
        gold = gold.unionByName(docs.join(short, F.col("text").contains(F.col("passage"))).select("query_id", "doc_id"))
    return staged(gold, "gold")


def _bm25_ranks(found: Lexical, k: int) -> DataFrame:
    return inverted.search(found.index, found.terms, k).withColumnRenamed("part", "source")


def _tf_ranks(found: Lexical, k: int) -> DataFrame:
    """A second lexical ranking: plain counts of query terms."""
    return inverted.search(found.index, found.terms, k, "tf").withColumnRenamed("part", "source")


def _vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The stated queries, every vector whose id is divisible by 100, and all vectors."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"), "label")
    return v.where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), F.col("vector").alias("query"), F.col("label").alias("ql")), v


def _dense_ranks(spark: SparkSession, d: str, k: int) -> DataFrame:
    """(query_id, ql, doc_id, label, score, rank)."""
    q, v = _vectors(spark, d)
    return ranking.dense_top_k(q, v, k, ["label"]).join(q.select("query_id", "ql"), "query_id")


# rankings


@named(f"WITH {_BM25} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM bmr WHERE rank <= 5")
def bm25_topk_global(spark, d):
    return _bm25_ranks(_lexical(spark, d), 5).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@named(f"""WITH {_BM25.replace("df AS (SELECT term, count(*) AS df FROM tf GROUP BY term)", "df AS (SELECT source, term, count(*) AS df FROM tf GROUP BY ALL)").replace("st AS (SELECT count(*) AS n_docs, avg(len(ws)) AS avg_dl FROM dw)", "st AS (SELECT source, count(*) AS n_docs, avg(len(ws)) AS avg_dl FROM dw GROUP BY source)").replace("JOIN df USING (term), st GROUP BY", "JOIN df ON df.term = tf.term AND df.source = tf.source JOIN st ON st.source = tf.source GROUP BY").replace("any_value(source)", "any_value(tf.source)")},
al AS (SELECT item_id AS query_id, source, doc_id, coalesce(bm.score, 0) AS score FROM benchmark, documents LEFT JOIN bm ON bm.doc_id = documents.doc_id AND bm.query_id = item_id),
rr AS (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY round(score, 9) DESC, doc_id) AS rank FROM al)
SELECT query_id, source, doc_id, round(score, 6) AS score, rank FROM rr WHERE rank <= 2""".replace("source, doc_id, coalesce", "documents.source, documents.doc_id, coalesce"))
def bm25_topk_per_source(spark, d):
    """Ranks within each source as candidate set; documents without a query term rank last and are kept."""
    docs, items = table(spark, d, "documents"), table(spark, d, "benchmark")
    terms = staged(inverted.term_rows(items, "item_id", F.col("text")), "terms")
    found = inverted.index(docs, "doc_id", [(F.col("text"), 1.0)], terms, part="source", own_counts=True)
    scores = inverted.search(found, terms, 4, per_part=True).withColumnRenamed("part", "source").drop("rank")
    # of documents without a query term only the first two of a source can be ranked: add those
    blank = docs.select("source", "doc_id").withColumn("n", F.row_number().over(Window.partitionBy("source").orderBy("doc_id")))
    spare = scores.groupBy("query_id", "source").agg(F.count("*").alias("have"))
    need = items.select(F.col("item_id").alias("query_id")).join(docs.select("source").distinct(), F.lit(True)).join(spare, ["query_id", "source"], "left").where("coalesce(have, 0) < 2")
    fill = need.join(blank.where("n <= 4"), "source").select("query_id", "source", "doc_id").join(scores.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti").withColumn("score", F.lit(0.0))
    both = scores.select("query_id", "source", "doc_id", "score").unionByName(fill)
    return ranking.top_k(both, 2, ["query_id", "source"]).select("query_id", "source", "doc_id", F.round("score", 6).alias("score"), "rank")


@named(f"""WITH pg AS (SELECT page_id AS doc_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_replace(html, '<[^>]*>', ' ', 'g') AS body FROM pages),
pw AS (SELECT doc_id, {_TOK.format("title")} AS tw, {_TOK.format("body")} AS bw FROM pg),
tl AS (SELECT count(*) AS n_docs, avg(len(tw)) AS avt, avg(len(bw)) AS avb FROM pw),
un AS (SELECT doc_id, len(tw) AS lt, len(bw) AS lb, unnest(tw) AS term, 1 AS t, 0 AS b FROM pw UNION ALL SELECT doc_id, len(tw), len(bw), unnest(bw), 0, 1 FROM pw),
tf AS (SELECT doc_id, term, lt, lb, sum(t) AS tt, sum(b) AS tb FROM un GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
qt AS (SELECT DISTINCT item_id AS query_id, unnest({_TOK.format("text")}) AS term FROM benchmark),
wt AS (SELECT query_id, doc_id, df, n_docs, 3.0::DOUBLE * tt / (0.25::DOUBLE + 0.75::DOUBLE * lt / greatest(avt, 1)) + tb / (0.25::DOUBLE + 0.75::DOUBLE * lb / greatest(avb, 1)) AS w FROM qt JOIN tf USING (term) JOIN df USING (term), tl),
sc AS (SELECT query_id, doc_id, sum(ln(1 + (n_docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * w * 2.2::DOUBLE / (w + 1.2::DOUBLE)) AS score FROM wt GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM sc)
SELECT query_id, doc_id, round(score, 6) AS score, rank FROM r WHERE rank <= 3""")
def bm25_field_weighted(spark, d):
    """Titles of pages weigh three times their bodies."""
    pages = table(spark, d, "pages").select(F.col("page_id").alias("doc_id"), tx.tokens(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("tw"), tx.tokens(F.regexp_replace("html", "<[^>]*>", " ")).alias("bw"))
    terms = ranking.query_terms(table(spark, d, "benchmark"), "item_id", F.col("text"))
    lengths = pages.agg(F.count("*").alias("n_docs"), F.greatest(F.avg(F.size("tw")), F.lit(1.0)).alias("at"), F.greatest(F.avg(F.size("bw")), F.lit(1.0)).alias("ab"))
    both = F.concat(F.transform("tw", lambda w: F.struct(w.alias("term"), F.lit(1).alias("t"), F.lit(0).alias("b"))), F.transform("bw", lambda w: F.struct(w.alias("term"), F.lit(0).alias("t"), F.lit(1).alias("b"))))
    hits = pages.select("doc_id", F.size("tw").alias("lt"), F.size("bw").alias("lb"), F.explode(both).alias("x")).select("doc_id", "lt", "lb", "x.*").join(terms.select("term").distinct(), "term", "left_semi")
    tf = hits.groupBy("doc_id", "lt", "lb", "term").agg(F.sum("t").alias("tt"), F.sum("b").alias("tb"))
    df = tf.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(lengths))  # one row
    w = 3.0 * F.col("tt") / (0.25 + 0.75 * F.col("lt") / F.col("at")) + F.col("tb") / (0.25 + 0.75 * F.col("lb") / F.col("ab"))
    s = tf.join(df, "term").withColumn("w", w).select("term", "doc_id", (F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)) * F.col("w") * 2.2 / (F.col("w") + 1.2)).alias("s"))
    scores = terms.join(s, "term").groupBy("query_id", "doc_id").agg(F.sum("s").alias("score"))
    return ranking.top_k(scores, 3).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@named(f"WITH {_DENSE} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM der WHERE rank <= 10")
def dense_topk(spark, d):
    return _dense_ranks(spark, d, 10).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@named("SELECT count(*) AS n, count(DISTINCT vec_id) AS n_ids, count(*) FILTER (WHERE len(embedding) <> 64) AS bad_width, count(*) FILTER (WHERE abs(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) - 1) > 0.0001) AS not_unit FROM embeddings")
def dense_unit_norm_check(spark, d):
    v = table(spark, d, "embeddings")
    norm = F.sqrt(ranking.dot(F.col("embedding"), F.col("embedding")))
    return v.agg(F.count("*").alias("n"), F.countDistinct("vec_id").alias("n_ids"), F.count_if(F.size("embedding") != 64).alias("bad_width"), F.count_if(F.abs(norm - 1) > 0.0001).alias("not_unit"))


_TFR = "tfs AS (SELECT query_id, tf.doc_id, sum(tf) AS score FROM qt JOIN tf USING (term) GROUP BY ALL), tfr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM tfs)"


def _fused_sql(w1: float, w2: float, c: int) -> str:
    return f"""WITH {_BM25}, {_TFR},
u AS (SELECT query_id, doc_id, {w1}::DOUBLE / ({c} + rank) AS p FROM bmr UNION ALL SELECT query_id, doc_id, {w2}::DOUBLE / ({c} + rank) FROM tfr),
f AS (SELECT query_id, doc_id, sum(p) AS score FROM u GROUP BY ALL), fr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM f)
SELECT query_id, doc_id, round(score, 9) AS score, rank FROM fr WHERE rank <= 8"""


def _fused(spark, d, weights, c):
    found = _lexical(spark, d)
    return inverted.fused(found.index, found.terms, 8, weights, c).select("query_id", "doc_id", F.round("score", 9).alias("score"), "rank")


@named(_fused_sql(1.0, 1.0, 60))
def rrf_fusion(spark, d):
    return _fused(spark, d, [1.0, 1.0], 60)


@named(_fused_sql(0.25, 1.0, 10))
def rrf_weighted(spark, d):
    return _fused(spark, d, [0.25, 1.0], 10)


@named(f"""WITH {_BM25}, b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY round(score, 9) DESC, doc_id) AS g FROM bm) WHERE g = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM b) SELECT query_id, source, doc_id, rank FROM r WHERE rank <= 4""")
def topk_distinct_group(spark, d):
    found = _lexical(spark, d)
    best = inverted.search(found.index, found.terms, 1, per_part=True).withColumnRenamed("part", "source").drop("rank")
    return ranking.top_k_distinct(best, 4, "source").select("query_id", "source", "doc_id", "rank")


@named(f"WITH {_BM25}, {_GOLD}, r AS (SELECT * FROM bmr), " + _RMETRICS.format(ks="1, 2, 5, 10"))
def recall_mrr_at_k(spark, d):
    found = _lexical(spark, d)
    return metrics.retrieval_at_k(_bm25_ranks(found, 10), _gold(spark, d, found), (1, 2, 5, 10))


@named(f"WITH {_DENSE}, gold AS (SELECT query_id, doc_id FROM de WHERE label = ql), r AS (SELECT * FROM der), " + _RMETRICS.format(ks="1, 5, 10, 20"))
def recall_mrr_at_k_dense(spark, d):
    q, v = _vectors(spark, d)
    sizes = v.groupBy(F.col("label").alias("ql")).agg(F.count("*").alias("size"))
    gold = q.join(sizes, "ql").select("query_id", (F.col("size") - 1).alias("gold"))  # its label's vectors but itself
    ranks = _dense_ranks(spark, d, 20).select("query_id", "rank", (F.col("label") == F.col("ql")).alias("relevant"))
    return metrics.retrieval_of_marked(ranks, gold, (1, 5, 10, 20))


@named(f"""WITH {_DENSE}, t AS (SELECT * FROM der WHERE rank <= 10)
SELECT query_id, round(max(score), 6) AS top1, round(max(score) - max(score) FILTER (WHERE rank = 2), 6) AS margin, round(avg(score), 6) AS mean, round(min(score), 6) AS lowest, round(stddev_pop(score), 6) AS sigma, count(DISTINCT label) AS n_labels FROM t GROUP BY query_id""")
def confidence_features(spark, d):
    t = _dense_ranks(spark, d, 10)
    return t.groupBy("query_id").agg(F.round(F.max("score"), 6).alias("top1"), F.round(F.max("score") - F.max(F.when(F.col("rank") == 2, F.col("score"))), 6).alias("margin"), F.round(F.avg("score"), 6).alias("mean"), F.round(F.min("score"), 6).alias("lowest"), F.round(F.stddev_pop("score"), 6).alias("sigma"), F.countDistinct("label").alias("n_labels"))


# two-stage retrieval


def _two_stage_sql(k: int, limit: int = 100) -> str:
    """Candidates by title, all eight longest terms, and these but one while fewer than k are found; then BM25 within a query's candidates."""
    stops = ", ".join(f"'{w}'" for w in tx.STOPWORDS)
    score = "ln(1 + (n_docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / greatest(avg_dl, 1.0::DOUBLE)))"
    return rf"""WITH pg AS (SELECT page_id AS doc_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_replace(html, '<[^>]*>', ' ', 'g') AS body FROM pages),
al AS (SELECT doc_id, title, {_TOK.format("title || ' ' || body")} AS ws FROM pg),
q0 AS (SELECT item_id AS query_id, text, {_TOK.format("text")} AS ws FROM benchmark),
q1 AS (SELECT *, list_distinct(list_filter(ws, lambda w: length(w) > 2 AND w NOT IN ({stops}))) AS kept FROM q0),
q AS (SELECT query_id, text, ws, CASE WHEN len(kept) > 0 THEN kept ELSE ws[1:8] END AS terms FROM q1 WHERE len(ws) > 0),
fo AS (SELECT query_id, list_slice(list_sort(list_transform(terms, lambda w: {{'n': -length(w), 'w': w}})), 1, 8) AS f FROM q),
fp AS (SELECT query_id, len(f) AS need, unnest(f).w AS term, unnest(range(0, len(f))) AS place FROM fo),
dt AS (SELECT doc_id, len(ws) AS dl, unnest(ws) AS term FROM al), tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM dt GROUP BY ALL),
qt AS (SELECT DISTINCT query_id, unnest(ws) AS term FROM q),
g1 AS (SELECT count(*) AS n_docs, avg(len(ws)) AS avg_dl FROM al), gd AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
gs AS (SELECT query_id, doc_id, sum({score}) AS score FROM qt JOIN tf USING (term) JOIN gd USING (term), g1 GROUP BY ALL),
ha AS (SELECT query_id, doc_id, need, count(*) AS n, list(place) AS places FROM fp JOIN tf USING (term) GROUP BY ALL),
st AS (SELECT query_id, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS r FROM ha JOIN gs USING (query_id, doc_id) WHERE n = need) WHERE r <= {limit}),
tw AS (SELECT query_id, list_transform(regexp_extract_all(text, '[\pL\pN]+(?:[''’][\pL\pN]+)?'), lambda w: regexp_replace(w, '(?i)[''’]s$', '')) AS tws FROM q),
tc AS (SELECT DISTINCT query_id, nfc_normalize(array_to_string(tws[i : i + n - 1], '_')) AS name FROM tw, range(1, 2000) a(i), range(1, 7) b(n) WHERE i + n - 1 <= len(tws)),
na AS (SELECT DISTINCT query_id, doc_id FROM tc JOIN al ON name = replace(nfc_normalize(title), ' ', '_') WHERE title <> ''),
fi AS (SELECT * FROM st UNION SELECT * FROM na),
sh AS (SELECT q.query_id, count(doc_id) AS have FROM q LEFT JOIN fi USING (query_id) GROUP BY ALL HAVING count(doc_id) < {k}),
ex AS (SELECT ha.query_id, doc_id, have, p AS leaves FROM ha JOIN sh USING (query_id), range(0, 8) t(p) WHERE need > 2 AND p < need AND (n = need OR (n = need - 1 AND NOT list_contains(places, p)))),
rl AS (SELECT * FROM (SELECT ex.*, row_number() OVER (PARTITION BY ex.query_id, leaves ORDER BY round(score, 9) DESC, doc_id) AS r FROM ex JOIN gs USING (query_id, doc_id)) WHERE r <= {limit}),
fr AS (SELECT query_id, have, doc_id, min(leaves) AS leaves FROM rl WHERE (query_id, doc_id) NOT IN (SELECT (query_id, doc_id) FROM fi) GROUP BY ALL),
fb AS (SELECT *, have + count(*) OVER (PARTITION BY query_id ORDER BY leaves RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM fr),
ca AS (SELECT * FROM fi UNION SELECT query_id, doc_id FROM fb WHERE before < {k}),
le AS (SELECT query_id, count(*) AS n_docs, avg(len(ws)) AS avg_dl FROM ca JOIN al USING (doc_id) GROUP BY query_id),
ct AS (SELECT ca.query_id, tf.* FROM ca JOIN tf USING (doc_id) JOIN qt ON qt.query_id = ca.query_id AND qt.term = tf.term),
cd AS (SELECT query_id, term, count(*) AS df FROM ct GROUP BY ALL),
sc AS (SELECT ct.query_id, doc_id, sum({score}) AS score FROM ct JOIN cd USING (query_id, term) JOIN le USING (query_id) GROUP BY ALL),
rk AS (SELECT ca.query_id, ca.doc_id, coalesce(score, 0) AS score, row_number() OVER (PARTITION BY ca.query_id ORDER BY round(coalesce(score, 0), 9) DESC, ca.doc_id) AS rank FROM ca LEFT JOIN sc USING (query_id, doc_id))
SELECT query_id, doc_id, round(score, 6) AS score, rank FROM rk WHERE rank <= {k}"""


@named(_two_stage_sql(5))
def two_stage_tiers(spark, d):
    """Pages by title, by the longest terms and by these but one."""
    title, body = F.regexp_extract("html", "<title>([^<]*)</title>", 1), F.regexp_replace("html", "<[^>]*>", " ")
    got = ranking.two_stage(table(spark, d, "pages"), "page_id", title, body, table(spark, d, "benchmark"), "item_id", F.col("text"), 5)
    return got.select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


# selective answering


def _answerable_top1(spark, d):
    """Each item's best score and whether it has gold, written once."""
    found = _lexical(spark, d)
    best = _bm25_ranks(found, 1).select("query_id", F.round("score", 6).alias("score"))
    gold = _gold(spark, d, found).select("query_id").distinct().withColumn("answerable", F.lit(True))
    return staged(best.join(gold, "query_id", "left").select("query_id", "score", F.coalesce("answerable", F.lit(False)).alias("answerable")), "top1")


_TOP1 = f"{_BM25}, {_GOLD}, t1 AS (SELECT query_id, round(score, 6) AS score, query_id IN (SELECT query_id FROM gold) AS answerable FROM bmr WHERE rank = 1)"


def _wilson_sql(k: str, n: str) -> tuple[str, str]:
    z, p = "1.959963984540054::DOUBLE", f"({k} / {n}::DOUBLE)"
    middle, half = f"({p} + {z} * {z} / (2 * {n}::DOUBLE)) / (1 + {z} * {z} / {n})", f"{z} / (1 + {z} * {z} / {n}) * sqrt({p} * (1 - {p}) / {n} + {z} * {z} / (4 * {n}::DOUBLE * {n}))"
    return f"greatest(0, {middle} - {half})", f"least(1, {middle} + {half})"


_FA, _FR = _wilson_sql("(n - a)", "(tn - ta)"), _wilson_sql("(ta - a)", "ta")
_CURVE = f"""cv AS (SELECT score AS threshold, count(*) AS n, count(*) FILTER (WHERE answerable) AS a FROM t1 GROUP BY score),
tt AS (SELECT count(*) AS tn, count(*) FILTER (WHERE answerable) AS ta FROM t1),
rn AS (SELECT threshold, CAST(sum(n) OVER o AS BIGINT) AS n, CAST(sum(a) OVER o AS BIGINT) AS a FROM cv WINDOW o AS (ORDER BY threshold DESC) UNION ALL SELECT NULL, 0, 0),
curve AS (SELECT threshold, n AS answered_cases, n / tn AS coverage, coalesce((n - a) / nullif(n, 0), 0) AS selective_risk, n - a AS false_answer_count, (n - a) / (tn - ta) AS false_answer_rate, {_FA[0]} AS false_answer_low, {_FA[1]} AS false_answer_high,
  ta - a AS false_refusal_count, (ta - a) / ta AS false_refusal_rate, {_FR[0]} AS false_refusal_low, {_FR[1]} AS false_refusal_high FROM rn, tt)"""


@named(f"WITH {_TOP1}, {_CURVE} SELECT * FROM curve")
def risk_coverage_curve(spark, d):
    """Also over items that all have gold, or none: large corpora hold every passage."""
    return metrics.risk_coverage(_answerable_top1(spark, d), "score", F.col("answerable"), one_kind=True)


@named(f"WITH {_TOP1}, {_CURVE} SELECT * FROM curve WHERE false_answer_rate <= 0.5 AND false_refusal_rate <= 0.6 ORDER BY coverage DESC, false_answer_rate, threshold DESC NULLS FIRST LIMIT 1")
def select_operating_point(spark, d):
    """Over items that all have gold, or none, no threshold is feasible: a rate over no rows is below no limit."""
    return metrics.operating_point(metrics.risk_coverage(_answerable_top1(spark, d), "score", F.col("answerable"), one_kind=True), 0.5, 0.6)


_DL = "dl AS (SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"


def _labelled(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars").join(table(spark, d, "labels"), "doc_id")


@named(f"WITH {_DL}, r AS (SELECT n_chars, quality, rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2.0 AS rk FROM dl) SELECT round((sum(rk) FILTER (WHERE quality = 1) - count(*) FILTER (WHERE quality = 1) * (count(*) FILTER (WHERE quality = 1) + 1) / 2.0) / (count(*) FILTER (WHERE quality = 1) * count(*) FILTER (WHERE quality <> 1)), 9) AS auc FROM r")
def answerability_auc(spark, d):
    return metrics.auc(_labelled(spark, d), "n_chars", F.col("quality") == 1).select(F.round("auc", 9).alias("auc"))


@named(f"""WITH {_DL}, c AS (SELECT lang, count(*) AS n, sum(quality)::DOUBLE AS s FROM dl GROUP BY lang), z AS (SELECT *, s / n AS p, 1.959963984540054::DOUBLE AS z, n::DOUBLE AS m FROM c)
SELECT lang, n, round(p, 9) AS rate, round(greatest(0, (p + z * z / (2 * m)) / (1 + z * z / m) - z / (1 + z * z / m) * sqrt(p * (1 - p) / m + z * z / (4 * m * m))), 9) AS low,
  round(least(1, (p + z * z / (2 * m)) / (1 + z * z / m) + z / (1 + z * z / m) * sqrt(p * (1 - p) / m + z * z / (4 * m * m))), 9) AS high FROM z""")
def wilson_by_lang(spark, d):
    c = _labelled(spark, d).groupBy("lang").agg(F.count("*").alias("n"), F.sum("quality").alias("s"))
    low, high = stats.wilson(F.col("s"), F.col("n"))
    return c.select("lang", "n", F.round(stats.rate(F.col("s"), F.col("n")), 9).alias("rate"), F.round(low, 9).alias("low"), F.round(high, 9).alias("high"))


@named("""WITH c AS (SELECT count(*)::DOUBLE AS n, count(*) FILTER (WHERE quality = 1 AND toxic = 1)::DOUBLE AS a, count(*) FILTER (WHERE quality = 1 AND toxic <> 1)::DOUBLE AS b, count(*) FILTER (WHERE quality <> 1 AND toxic = 1)::DOUBLE AS c, count(*) FILTER (WHERE quality <> 1 AND toxic <> 1)::DOUBLE AS d FROM labels)
SELECT CAST(n AS BIGINT) AS n, (a + d) / n AS observed, round(((a + d) / n - ((a + b) * (a + c) + (d + c) * (d + b)) / (n * n)) / (1 - ((a + b) * (a + c) + (d + c) * (d + b)) / (n * n)), 9) AS kappa FROM c""")
def cohen_kappa(spark, d):
    q, t = F.col("quality") == 1, F.col("toxic") == 1
    c = table(spark, d, "labels").agg(F.count_if(q & t).alias("a"), F.count_if(q & ~t).alias("b"), F.count_if(~q & t).alias("c"), F.count_if(~q & ~t).alias("d"))
    n = F.col("a") + F.col("b") + F.col("c") + F.col("d")
    return c.select(n.alias("n"), stats.rate(F.col("a") + F.col("d"), n).alias("observed"), F.round(stats.kappa(F.col("a"), F.col("b"), F.col("c"), F.col("d")), 9).alias("kappa"))


@named("SELECT quality, toxic, count(*) AS n FROM labels GROUP BY quality, toxic")
def confusion_matrix(spark, d):
    return table(spark, d, "labels").groupBy("quality", "toxic").agg(F.count("*").alias("n"))


_TWO = f"{_BM25}, {_TFR}, {_GOLD}, q AS (SELECT DISTINCT query_id FROM gold), w AS (SELECT query_id, (query_id, (SELECT doc_id FROM tfr WHERE rank = 1 AND tfr.query_id = q.query_id)) IN (SELECT (query_id, doc_id) FROM gold) AS l, (query_id, (SELECT doc_id FROM bmr WHERE rank = 1 AND bmr.query_id = q.query_id)) IN (SELECT (query_id, doc_id) FROM gold) AS r FROM q)"


def _first_is_gold(ranks, gold):
    first = ranks.where("rank = 1").select("query_id", "doc_id")
    hits = first.join(gold, ["query_id", "doc_id"], "left_semi").select("query_id", F.lit(True).alias("hit"))
    return gold.select("query_id").distinct().join(hits, "query_id", "left").select("query_id", F.coalesce("hit", F.lit(False)).alias("ok"))


def _lchoose_sql(n: str, k: str) -> str:
    return f"lgamma({n} + 1) - lgamma({k} + 1) - lgamma({n} - {k} + 1)"


@named(f"""WITH {_TWO}, c AS (SELECT count(*) AS n, count(*) FILTER (WHERE r AND NOT l) AS wins, count(*) FILTER (WHERE l AND NOT r) AS losses FROM w)
SELECT n, wins, losses, n - wins - losses AS unchanged, round(CASE WHEN wins + losses = 0 THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(range(0, least(wins, losses) + 1), lambda i: exp({_lchoose_sql("(wins + losses)", "i")} - (wins + losses) * ln(2))))) END, 9) AS p_value FROM c""")
def paired_transitions(spark, d):
    found = _lexical(spark, d)
    gold = _gold(spark, d, found)
    out = metrics.transitions(_first_is_gold(_tf_ranks(found, 1), gold), _first_is_gold(_bm25_ranks(found, 1), gold), "query_id", "ok")
    return out.withColumn("p_value", F.round("p_value", 9))


@named(f"""WITH {_DL}, g AS (SELECT lang AS slice, avg(quality) AS quality, avg(toxic) AS toxic FROM dl GROUP BY lang)
SELECT slice, round(quality, 9) AS quality, round(toxic, 9) AS toxic FROM (SELECT * FROM g UNION ALL SELECT 'macro', avg(quality), avg(toxic) FROM g UNION ALL SELECT 'micro', avg(quality), avg(toxic) FROM dl)""")
def macro_vs_micro(spark, d):
    m = metrics.macro(_labelled(spark, d), "lang", ["quality", "toxic"])
    return m.select("slice", F.round("quality", 9).alias("quality"), F.round("toxic", 9).alias("toxic"))


@named(f"""WITH {_BM25}, {_TFR}, {_GOLD},
m AS (SELECT 'baseline' AS run, query_id, rank, doc_id FROM tfr WHERE rank <= 10 UNION ALL SELECT 'candidate', query_id, rank, doc_id FROM bmr WHERE rank <= 10),
c AS (SELECT run, g.query_id, count(m.doc_id) AS hits, count(*) AS n FROM (SELECT DISTINCT run FROM m) CROSS JOIN gold g LEFT JOIN m USING (run, query_id, doc_id) GROUP BY ALL),
a AS (SELECT run, avg((hits = n)::INT) AS all_recall, avg(hits / n) AS evidence_recall FROM c GROUP BY run),
u AS (UNPIVOT a ON all_recall, evidence_recall INTO NAME metric VALUE v)
SELECT metric, round(b.v, 9) AS baseline, round(k.v, 9) AS candidate, CASE WHEN k.v < b.v - 0.005::DOUBLE THEN 'REJECT' ELSE 'PROMOTE' END AS decision
FROM u b JOIN u k USING (metric) WHERE b.run = 'baseline' AND k.run = 'candidate'""")
def gate_decision(spark, d):
    """Guard metrics may fall by 0.005 at most."""
    found = _lexical(spark, d)
    gold = _gold(spark, d, found)
    runs = [metrics.retrieval_at_k(ranks, gold, (10,)).select(F.explode(F.create_map(F.lit("all_recall"), "all_recall", F.lit("evidence_recall"), "evidence_recall")).alias("metric", "value")) for ranks in (_tf_ranks(found, 10), _bm25_ranks(found, 10))]
    out = policy.gate(runs[0], runs[1], {"all_recall": 0.005, "evidence_recall": 0.005}, ("all_recall", "evidence_recall"))
    return out.select("metric", F.round("baseline", 9).alias("baseline"), F.round("candidate", 9).alias("candidate"), "decision")


@named(f"""WITH p AS (SELECT u.conv_id, u.turn, {_WORDS.format("a.text")} AS pw, {_WORDS.format("u.text")} AS gw FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant'),
c AS (SELECT *, coalesce(list_sum(list_transform(list_distinct(pw), lambda x: least(len(list_filter(pw, lambda y: y = x)), len(list_filter(gw, lambda y: y = x))))), 0)::DOUBLE AS k FROM p)
SELECT conv_id, turn, (pw = gw)::INT AS exact, round(CASE WHEN len(pw) = 0 AND len(gw) = 0 THEN 1.0 WHEN k = 0 THEN 0.0 ELSE 2 * (k / len(pw)) * (k / len(gw)) / (k / len(pw) + k / len(gw)) END, 9) AS f1 FROM c""")
def answer_em_f1(spark, d):
    """Each assistant turn as the prediction of the user turn before it."""
    c = table(spark, d, "conversations")
    u = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("gold"))
    a = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("prediction"))
    pairs = u.join(a, ["conv_id", "turn"]).withColumn("golds", F.array("gold"))
    return metrics.answer_scores(pairs, "prediction", "golds", ["conv_id", "turn"]).select("conv_id", "turn", F.col("exact").cast("int").alias("exact"), F.round("f1", 9).alias("f1"))


@named(f"""WITH {_BM25}, {_GOLD}, c AS (SELECT query_id, list(doc_id) AS cited FROM bmr WHERE rank <= 4 GROUP BY query_id), g AS (SELECT query_id, list(doc_id) AS gold FROM gold GROUP BY query_id)
SELECT query_id, coalesce(len(list_intersect(cited, gold)), 0) / nullif(len(cited), 0) AS precision, len(list_intersect(cited, gold)) / nullif(len(gold), 0) AS recall, coalesce(list_has_all(cited, gold), false) AS complete,
  coalesce(len(list_intersect(cited, gold)) > 0, false) AS any_set FROM c LEFT JOIN g USING (query_id)""")
def citation_set_metrics(spark, d):
    """The first four documents as citations; each gold document is an evidence set of its own for `any_set`."""
    found = _lexical(spark, d)
    c = _bm25_ranks(found, 4).groupBy("query_id").agg(F.collect_list("doc_id").alias("cited"))
    g = _gold(spark, d, found).groupBy("query_id").agg(F.collect_list("doc_id").alias("gold"))
    both = c.join(g, "query_id", "left").withColumn("gold", F.coalesce("gold", F.array().cast("array<bigint>")))
    precision, recall = metrics.citation_metrics(F.col("cited"), F.col("gold"))
    sets = F.transform("gold", lambda x: F.array(x))
    return both.select("query_id", precision.alias("precision"), recall.alias("recall"), ((F.size("gold") > 0) & metrics.subset(F.col("gold"), F.col("cited"))).alias("complete"), metrics.any_set_complete(sets, F.col("cited")).alias("any_set"))


# samples


@named("SELECT doc_id FROM documents ORDER BY sha256(doc_id::VARCHAR), doc_id LIMIT 50")
def hash_sample(spark, d):
    return sampling.hash_sample(table(spark, d, "documents").select("doc_id"), 50, "doc_id")


@named("SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256('pilot:' || doc_id), doc_id) AS r FROM documents) WHERE r > 10 AND r <= 30")
def hash_window(spark, d):
    return sampling.hash_window(table(spark, d, "documents").select("doc_id", "lang"), 10, 20, "doc_id", "pilot:", ["lang"])


@named("SELECT stratum, doc_id, place FROM (SELECT lang AS stratum, doc_id, row_number() OVER (PARTITION BY lang ORDER BY sha256('audit:' || lang || ':' || doc_id), doc_id) AS place FROM documents) WHERE place <= CASE stratum WHEN 'en' THEN 8 WHEN 'de' THEN 4 WHEN 'fr' THEN 10 WHEN 'es' THEN 6 ELSE 0 END")
def stratified_sample(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang")
    return sampling.stratified(docs, F.col("lang"), {"en": 8, "de": 4, "fr": 10, "es": 6}, "doc_id", "audit:").select("stratum", "doc_id", "place")


@named("SELECT doc_id FROM documents WHERE ('0x' || substr(sha256(doc_id::VARCHAR), 1, 8))::BIGINT / 4294967295.0 < 0.1")
def hash_rate_sample(spark, d):
    return table(spark, d, "documents").select("doc_id").where(sampling.hash_rate(F.col("doc_id"), 0.1))


@named("""WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY sha256('confirmation:' || doc_id), doc_id) AS r, count(*) OVER () AS n FROM documents)
SELECT doc_id, CASE WHEN r <= greatest(1, round_even(0.2::DOUBLE * n, 0)) THEN 'confirmation' ELSE 'development' END AS partition FROM r""")
def holdout_split(spark, d):
    return sampling.holdout(table(spark, d, "documents").select("doc_id"), "doc_id", "confirmation:")


from . import corpus_queries, evaluation_queries, record_queries, search_queries  # noqa: E402, F401  (register their queries)

"""Named queries on full-text search by stems and on rankings of a case's own documents, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import stems
from ..functions import text as tx
from ..operators import bounded, inverted, metrics, ranking
from ..staging import staged
from .catalogue import _RMETRICS, _TOK, named, table

_STOPS = ", ".join(f"'{w}'" for w in tx.STOPWORDS)
_PARTS = r"regexp_extract_all(strip_accents(lower({0})), '[\pL\pN]+')"


def _ctes(steps: list[tuple[str, str]]) -> str:
    return ",\n".join(f"{name} AS ({sql})" for name, sql in steps)


# titles weigh three times; terms of a query are its words over two letters that are no stop words, or else its first eight words
_STEMMED = rf"""pg AS (SELECT page_id AS doc_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_replace(html, '<[^>]*>', ' ', 'g') AS body FROM pages),
pw AS (SELECT *, {_PARTS.format("title")} AS tw, {_PARTS.format("body")} AS bw FROM pg),
q0 AS (SELECT item_id AS query_id, text, {_TOK.format("text")} AS ws FROM benchmark),
q1 AS (SELECT *, list_distinct(list_filter(ws, lambda w: length(w) > 2 AND w NOT IN ({_STOPS}))) AS kept FROM q0),
q AS (SELECT query_id, text, ws, CASE WHEN len(kept) > 0 THEN kept ELSE ws[1:8] END AS terms FROM q1 WHERE len(ws) > 0),
words AS (SELECT DISTINCT term FROM (SELECT unnest(tw) AS term FROM pw UNION ALL SELECT unnest(bw) FROM pw UNION ALL SELECT unnest({_PARTS.format("array_to_string(ws, ' ')")}) FROM q)),
{_ctes(stems.sql("words"))},
ln AS (SELECT doc_id, len(tw) + len(bw) AS dl FROM pw), la AS (SELECT count(*) AS n_docs, avg(dl) AS avg_dl FROM ln),
sf AS (SELECT doc_id, stem, sum(w) AS tf FROM (SELECT doc_id, unnest(tw) AS term, 3.0::DOUBLE AS w FROM pw UNION ALL SELECT doc_id, unnest(bw), 1.0 FROM pw) JOIN stems USING (term) GROUP BY ALL),
sd AS (SELECT stem, count(*) AS df FROM sf GROUP BY stem),
sw AS (SELECT doc_id, stem, greatest(ln((n_docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)), 0.000001::DOUBLE) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / greatest(avg_dl, 1.0::DOUBLE))) AS w
       FROM sf JOIN sd USING (stem) JOIN ln USING (doc_id), la)"""


def _pages(spark, d):
    return table(spark, d, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_replace("html", "<[^>]*>", " ").alias("body"))


@named(rf"""WITH {_STEMMED}, qs AS (SELECT query_id, unnest({_PARTS.format("array_to_string(terms, ' ')")}) AS term FROM q),
sc AS (SELECT query_id, doc_id, sum(w) AS score FROM qs JOIN stems USING (term) JOIN sw USING (stem) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM sc)
SELECT query_id, doc_id, round(score, 6) AS score, rank FROM r WHERE rank <= 10""")
def fts_rank(spark, d):
    """Pages by the stems of an item's terms, any of which may be there."""
    terms = staged(inverted.term_rows(table(spark, d, "benchmark"), "item_id", F.col("text"), "query_stems"), "terms")
    found = inverted.index(_pages(spark, d), "page_id", [(F.col("title"), 3.0), (F.col("body"), 1.0)], terms, analyser="stems", floor=True)
    return inverted.search(found, terms, 10).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


def _two_stage_sql(k: int, limit: int = 100) -> str:
    local = "ln(1 + (n_docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / greatest(avg_dl, 1.0::DOUBLE)))"
    return rf"""WITH {_STEMMED},
fo AS (SELECT query_id, list_slice(list_sort(list_transform(terms, lambda w: {{'n': -length(w), 'w': w}})), 1, 8) AS f FROM q),
fp AS (SELECT query_id, len(f) AS need, unnest(f).w AS word, unnest(range(0, len(f))) AS place FROM fo),
fs AS (SELECT query_id, need, place, stem FROM fp JOIN stems ON stems.term = ({_PARTS.format("word")})[1]),
hp AS (SELECT query_id, doc_id, need, place, w FROM fs JOIN sw USING (stem)),
ha AS (SELECT query_id, doc_id, need, count(*) AS n, sum(w) AS score FROM hp GROUP BY ALL HAVING count(*) >= need - 1),
st AS (SELECT query_id, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS r FROM ha WHERE n = need) WHERE r <= {limit}),
tw AS (SELECT query_id, list_transform(regexp_extract_all(text, '[\pL\pN]+(?:[''’][\pL\pN]+)?'), lambda w: regexp_replace(w, '(?i)[''’]s$', '')) AS tws FROM q),
tc AS (SELECT DISTINCT query_id, nfc_normalize(array_to_string(tws[i : i + n - 1], '_')) AS name FROM tw, range(1, 2000) a(i), range(1, 7) b(n) WHERE i + n - 1 <= len(tws)),
na AS (SELECT DISTINCT query_id, doc_id FROM tc JOIN pg ON name = replace(nfc_normalize(title), ' ', '_') WHERE title <> ''),
fi AS (SELECT * FROM st UNION SELECT * FROM na),
sh AS (SELECT q.query_id, count(doc_id) AS have FROM q LEFT JOIN fi USING (query_id) GROUP BY ALL HAVING count(doc_id) < {k}),
ex AS (SELECT ha.query_id, ha.doc_id, have, p AS leaves, ha.score - coalesce(hp.w, 0) AS score FROM ha JOIN sh USING (query_id) CROSS JOIN range(0, 8) t(p)
       LEFT JOIN hp ON hp.query_id = ha.query_id AND hp.doc_id = ha.doc_id AND hp.place = p WHERE ha.need > 2 AND p < ha.need AND (n = ha.need OR hp.w IS NULL)),
rl AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, leaves ORDER BY round(score, 9) DESC, doc_id) AS r FROM ex) WHERE r <= {limit}),
fr AS (SELECT query_id, have, doc_id, min(leaves) AS leaves FROM rl WHERE (query_id, doc_id) NOT IN (SELECT (query_id, doc_id) FROM fi) GROUP BY ALL),
fb AS (SELECT *, have + count(*) OVER (PARTITION BY query_id ORDER BY leaves RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM fr),
ca AS (SELECT * FROM fi UNION SELECT query_id, doc_id FROM fb WHERE before < {k}),
al AS (SELECT doc_id, {_TOK.format("title || ' ' || body")} AS ws FROM pg),
dt AS (SELECT doc_id, len(ws) AS dl, unnest(ws) AS term FROM al), tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM dt GROUP BY ALL),
qt AS (SELECT DISTINCT query_id, unnest(ws) AS term FROM q),
le AS (SELECT query_id, count(*) AS n_docs, avg(len(ws)) AS avg_dl FROM ca JOIN al USING (doc_id) GROUP BY query_id),
ct AS (SELECT ca.query_id, tf.* FROM ca JOIN tf USING (doc_id) JOIN qt ON qt.query_id = ca.query_id AND qt.term = tf.term),
cd AS (SELECT query_id, term, count(*) AS df FROM ct GROUP BY ALL),
sc AS (SELECT ct.query_id, doc_id, sum({local}) AS score FROM ct JOIN cd USING (query_id, term) JOIN le USING (query_id) GROUP BY ALL),
rk AS (SELECT ca.query_id, ca.doc_id, coalesce(score, 0) AS score, row_number() OVER (PARTITION BY ca.query_id ORDER BY round(coalesce(score, 0), 9) DESC, ca.doc_id) AS rank FROM ca LEFT JOIN sc USING (query_id, doc_id))
SELECT query_id, doc_id, round(score, 6) AS score, rank FROM rk WHERE rank <= {k}"""


@named(_two_stage_sql(5))
def two_stage_stemmed(spark, d):
    """Pages by title, by the stems of the longest terms and of these but one, ordered within 100 with titles weighing three times, then ranked by words."""
    got = ranking.two_stage(_pages(spark, d), "page_id", F.col("title"), F.col("body"), table(spark, d, "benchmark"), "item_id", F.col("text"), 5, stemmed=True)
    return got.select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


# a case is 25 vectors that follow one another, with their documents; its question is an item, the items in turn, and the item's vector the one of its id

_CASES = rf"""nb AS (SELECT count(*) AS n FROM benchmark),
cd AS (SELECT vec_id // 25 AS case_id, vec_id AS doc_id, e.label, e.embedding::DOUBLE[] AS v, coalesce(d.text, '') AS text FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id),
cs AS (SELECT case_id, b.text AS query, q.embedding::DOUBLE[] AS qv, q.label AS ql FROM (SELECT DISTINCT case_id FROM cd), nb, benchmark b, embeddings q WHERE b.item_id = case_id % n AND q.vec_id = b.item_id),
cw AS (SELECT cd.*, {_TOK.format("text")} AS ws FROM cd), cl AS (SELECT case_id, count(*) AS n_docs, avg(len(ws)) AS avg_dl FROM cw GROUP BY case_id),
ctf AS (SELECT case_id, doc_id, dl, term, count(*) AS tf FROM (SELECT case_id, doc_id, len(ws) AS dl, unnest(ws) AS term FROM cw) GROUP BY ALL),
cdf AS (SELECT case_id, term, count(*) AS df FROM ctf GROUP BY ALL),
cq AS (SELECT DISTINCT case_id, unnest({_TOK.format("query")}) AS term FROM cs),
cb AS (SELECT case_id, doc_id, sum(ln(1 + (n_docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / greatest(avg_dl, 1.0::DOUBLE)))) AS s
       FROM ctf JOIN cq USING (case_id, term) JOIN cdf USING (case_id, term) JOIN cl USING (case_id) GROUP BY ALL),
ca AS (SELECT cd.case_id, cd.doc_id, label, ql, coalesce(s, 0) AS lexical, list_dot_product(v, qv) AS dense FROM cd JOIN cs USING (case_id) LEFT JOIN cb USING (case_id, doc_id)),
cr AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY round(lexical, 9) DESC, doc_id) AS lr, row_number() OVER (PARTITION BY case_id ORDER BY round(dense, 9) DESC, doc_id) AS dr FROM ca),
ch AS (SELECT *, 0.25::DOUBLE / (c + lr) + 1.0::DOUBLE / (c + dr) AS hybrid FROM (SELECT *, CASE case_id % 2 WHEN 0 THEN 10 ELSE 30 END AS c FROM cr)),
hr AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY round(hybrid, 9) DESC, doc_id) AS hr FROM ch)"""


def _cases(spark, d):
    """(case_id, benchmark_id, query, vector, label, documents): 25 documents a case at most."""
    items = table(spark, d, "benchmark")
    vectors = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vector"), "label")
    docs = vectors.join(table(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), F.coalesce("text", F.lit("")).alias("text")), "vec_id")
    one = F.struct(F.col("vec_id").alias("id"), F.lit("").alias("title"), "text", "vector")
    cases = docs.groupBy(F.expr("vec_id div 25").alias("case_id")).agg(F.sort_array(F.collect_list(one)).alias("documents"))
    asked = items.join(vectors, F.col("item_id") == F.col("vec_id")).select("item_id", F.col("text").alias("query"), "vector", "label")
    n = items.agg(F.count("*").alias("n"))
    cases = cases.crossJoin(F.broadcast(n)).withColumn("item_id", F.col("case_id") % F.col("n"))  # one row
    return cases.join(asked, "item_id").withColumn("benchmark_id", F.when(F.col("case_id") % 2 == 0, "hotpotqa").otherwise("natural_questions"))


@named(f"WITH {_CASES} SELECT case_id AS query_id, doc_id, round(dense, 6) AS score, dr AS rank FROM hr WHERE dr <= 4")
def bounded_dense(spark, d):
    """A case's own documents by vector."""
    return bounded.rank(_cases(spark, d), "case_id", "query", "documents", 4, "dense", "vector").withColumn("score", F.round("score", 6))


@named(f"WITH {_CASES} SELECT case_id AS query_id, doc_id, round(lexical, 6) AS score, lr AS rank FROM hr WHERE lr <= 4")
def bounded_lexical(spark, d):
    """A case's own documents by words counted within the case; documents without a word of the question are kept."""
    return bounded.rank(_cases(spark, d), "case_id", "query", "documents", 4, "lexical").withColumn("score", F.round("score", 6))


@named(f"WITH {_CASES} SELECT case_id AS query_id, doc_id, round(hybrid, 9) AS score, hr AS rank FROM hr WHERE hr <= 4")
def bounded_hybrid(spark, d):
    """Words and vectors over the same documents, fused by the case's benchmark."""
    got = bounded.rank(_cases(spark, d), "case_id", "query", "documents", 4, "weighted_hybrid", "vector", F.col("benchmark_id"))
    return got.withColumn("score", F.round("score", 9))


_RATES = ("any_recall", "all_recall", "evidence_recall", "mrr")
_HYBRID = f"WITH {_CASES}, gold AS (SELECT case_id AS query_id, doc_id FROM hr WHERE label = ql), r AS (SELECT case_id AS query_id, doc_id, hr AS rank FROM hr WHERE hr <= 8), " + _RMETRICS.format(ks="1, 2, 4, 8")


@named(f"SELECT k, n, {', '.join(f'round({c}, 9) AS {c}' for c in _RATES)} FROM ({_HYBRID})")
def hybrid_retrieval_run(spark, d):
    """Recall and MRR of the fused ranking; gold: a case's documents with the label of its question. Cases without gold are left out."""
    cases = staged(_cases(spark, d), "cases")
    labels = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("label").alias("own"))
    pool = cases.select(F.col("case_id").alias("query_id"), F.col("label"), F.explode("documents.id").alias("doc_id"))
    gold = pool.join(labels, "doc_id").where("own = label").select("query_id", "doc_id")
    ranked = bounded.rank(cases, "case_id", "query", "documents", 8, "weighted_hybrid", "vector", F.col("benchmark_id"))
    return metrics.retrieval_at_k(ranked, gold, (1, 2, 4, 8)).select("k", "n", *[F.round(c, 9).alias(c) for c in _RATES])

"""Rankings: every one has (query_id, doc_id, score, rank), ranked by rounded score, then id."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type

from ..functions import stems
from ..functions.text import composed, fts_terms, sentences, title_candidates, tokens
from ..staging import spread, staged
from . import inverted

K1, B = 1.2, 0.75


def top_k(scored: DataFrame, k: int, by: list[str] | None = None, score: str = "score", key: str = "doc_id") -> DataFrame:
    """The first k of each group by (-score, id). Sums of floats vary in their last digits with the order of adding, hence the rounding."""
    if k < 1:
        raise ValueError("k must be at least 1")
    w = Window.partitionBy(*(by or ["query_id"])).orderBy(F.desc(F.round(score, 9)), key)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def query_terms(queries: DataFrame, id_col: str, text: Column) -> DataFrame:
    """(query_id, term, inner): distinct terms of each query; inner: neither its first nor its last word only."""
    words = queries.select(F.col(id_col).alias("query_id"), tokens(text).alias("w"))
    inner = F.slice("w", 2, F.greatest(F.size("w") - 2, F.lit(0)))
    return words.select("query_id", F.explode(F.array_distinct("w")).alias("term"), inner.alias("i")).select("query_id", "term", F.array_contains("i", F.col("term")).alias("inner"))


def postings(docs: DataFrame, id_col: str, text: Column, terms: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """(doc_id, *keep, dl, term, tf), written once: a row for each document and query term in it, and one with a null term for the document itself.

    Texts are read and cut into words once. Terms that no query has are dropped before the first shuffle, and a task sums what it has of a document.
    """
    keep = keep or []
    asked = staged(terms.select("term").distinct(), "terms").select("term", F.lit(True).alias("asked"))
    words = spread(docs.select(F.col(id_col).alias("doc_id"), *keep, text.alias("__text"))).select("doc_id", *keep, F.concat(tokens(F.col("__text")), F.array(F.lit(None).cast("string"))).alias("words"))
    rows = words.select("doc_id", *keep, (F.size("words") - 1).alias("dl"), F.explode_outer("words").alias("term")).join(asked, "term", "left").where("asked OR term IS NULL")
    return staged(rows.groupBy("doc_id", *keep, "dl", "term").agg(F.count("*").alias("tf")), "postings")


def lexical(posted: DataFrame, terms: DataFrame, group: str | None = None, k1: float = K1, b: float = B, keep: list[str] | None = None) -> DataFrame:
    """(query_id, [group,] doc_id, *keep, score, tf, inner) of documents with a query term: BM25, the sum of counts, and how many inner terms there are. Counts are within `group` if given."""
    on, keep = [group] if group else [], [c for c in keep or [] if c != group]
    lengths = posted.where("term IS NULL").groupBy(*on).agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avg_dl"))
    tf = posted.where("term IS NOT NULL")
    df = tf.groupBy(*on, "term").agg(F.count("*").alias("df"))
    stats = df.join(lengths, on) if group else df.crossJoin(F.broadcast(lengths))  # one row
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.greatest(F.col("avg_dl"), F.lit(1.0))))
    weighted = tf.join(stats, [*on, "term"]).select(*on, *keep, "term", "doc_id", "tf", weight.alias("w"))
    sums = terms.join(weighted, "term").groupBy("query_id", *on, *keep, "doc_id")
    return sums.agg(F.sum("w").alias("score"), F.sum("tf").alias("tf"), F.count_if("inner").alias("inner"))


def bm25_scores(docs: DataFrame, id_col: str, text: Column, terms: DataFrame, group: str | None = None, k1: float = K1, b: float = B) -> DataFrame:
    """(query_id, [group,] doc_id, score) of documents with a query term."""
    return lexical(postings(docs, id_col, text, terms, [group] if group else None), terms, group, k1, b).drop("tf", "inner")


def dot(a: Column, b: Column) -> Column:
    """The dot product in double."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


#: Query vectors that meet all others in one pass.
QUERY_BLOCK = 4096


def query_blocks(queries: DataFrame) -> Iterator[tuple[list, np.ndarray]]:
    """(query_id, query) rows as blocks of ids and a matrix; the driver holds one block at a time."""
    ids, rows = [], []
    for r in queries.select("query_id", "query").toLocalIterator():
        ids.append(r.query_id)
        rows.append(r.query)
        if len(ids) == QUERY_BLOCK:
            yield ids, np.array(rows, np.float64)
            ids, rows = [], []
    if ids:
        yield ids, np.array(rows, np.float64)


def dense_batches(batches: Iterator[pa.RecordBatch], matrix: np.ndarray) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Each batch whose first two columns are doc_id and vector, in pieces, with its (queries, rows) scores rounded to nine digits."""
    for whole in batches:
        for at in range(0, whole.num_rows, 1024):
            batch = whole.slice(at, 1024)
            vectors = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
            yield batch, np.round(matrix @ vectors.T, 9)


def _ids(column: pa.Array) -> np.ndarray:
    """Ids as an array that sorts: of numbers or of text."""
    ids = column.to_numpy(zero_copy_only=False)
    return ids.astype(str) if ids.dtype == object else ids


def dense_top_k(queries: DataFrame, vectors: DataFrame, k: int, keep: list[str] | None = None, own: bool = False) -> DataFrame:
    """(query_id, doc_id, *keep, score, rank) of a stated set of queries (query_id, query) over all vectors (doc_id, vector, *keep).

    Queries come in blocks of bounded size; a block meets each Arrow batch as one matrix product, which passes on the first k of each query only. A block's result is written when there
    is a next one, so a plan never holds more than one block. `own`: whether a vector may be found for the query with its id.
    """
    keep, parts, last = keep or [], None, None
    v = vectors.select("doc_id", "vector", *keep)
    schema = T.StructType([T.StructField("query_id", queries.schema["query_id"].dataType), *[v.schema[c] for c in ("doc_id", *keep)], T.StructField("score", T.DoubleType())])
    id_type = to_arrow_type(queries.schema["query_id"].dataType)
    for ids, matrix in query_blocks(queries):
        names = np.array(ids)

        def run(batches: Iterator[pa.RecordBatch], names: np.ndarray = names, matrix: np.ndarray = matrix) -> Iterator[pa.RecordBatch]:
            for batch, scores in dense_batches(batches, matrix):
                doc = _ids(batch.column(0))
                if not own:
                    scores[names[:, None] == doc[None, :]] = -np.inf
                order = np.lexsort((np.broadcast_to(doc, scores.shape), -scores), axis=1)[:, :k]
                q, at = np.repeat(np.arange(len(names)), order.shape[1]), order.ravel()
                ok = np.isfinite(scores[q, at])
                q, at = q[ok], at[ok]
                cols = [batch.column(0).take(pa.array(at)), *[batch.column(2 + i).take(pa.array(at)) for i in range(len(keep))]]
                yield pa.RecordBatch.from_arrays([pa.array(names[q]).cast(id_type), *cols, pa.array(scores[q, at])], names=schema.names)

        if last is not None:  # a further block: the one before is written, and its matrix can go
            one = staged(top_k(last, k), "dense")
            parts = one if parts is None else parts.unionByName(one)
        last = v.mapInArrow(run, schema)
    last = top_k(vectors.sparkSession.createDataFrame([], schema) if last is None else last, k)
    return last if parts is None else parts.unionByName(last)


def dense_first_ranks(queries: DataFrame, vectors: DataFrame, group: str) -> DataFrame:
    """(query_id, group, rank): where in a query's whole ranking of the other vectors the first of each group stands.

    Two passes: the best vector of each group, then how many vectors come before it; ranks of all vectors are never written.
    """
    v = vectors.select("doc_id", "vector", group)
    id_type, group_type = v.schema["doc_id"].dataType, v.schema[group].dataType
    best_schema = T.StructType([T.StructField("query_id", queries.schema["query_id"].dataType), T.StructField(group, group_type), T.StructField("score", T.DoubleType()), T.StructField("doc_id", id_type)])
    count_schema = T.StructType([best_schema["query_id"], best_schema[group], T.StructField("n", T.LongType())])
    query_type, out = to_arrow_type(queries.schema["query_id"].dataType), None
    for ids, matrix in query_blocks(queries):
        names = np.array(ids)

        def best(batches: Iterator[pa.RecordBatch], names: np.ndarray = names, matrix: np.ndarray = matrix) -> Iterator[pa.RecordBatch]:
            for batch, scores in dense_batches(batches, matrix):
                doc, of = _ids(batch.column(0)), _ids(batch.column(2))
                scores[names[:, None] == doc[None, :]] = -np.inf
                for g in np.unique(of):
                    at = np.flatnonzero(of == g)
                    at = at[np.argsort(doc[at], kind="stable")]
                    first = at[np.argmax(scores[:, at], axis=1)]
                    top = scores[np.arange(len(names)), first]
                    ok = np.isfinite(top)
                    yield pa.RecordBatch.from_arrays([pa.array(names[ok]).cast(query_type), batch.column(2).take(pa.array(first[ok])), pa.array(top[ok]), batch.column(0).take(pa.array(first[ok]))], names=best_schema.names)

        rows = v.mapInArrow(best, best_schema).groupBy("query_id", group).agg(F.min_by(F.struct("score", "doc_id"), F.struct(-F.col("score"), "doc_id")).alias("b"))
        firsts = staged(rows.select("query_id", group, "b.score", "b.doc_id"), "firsts")
        place = {q: i for i, q in enumerate(ids)}
        for piece in _pieces(firsts):
            keys = [(r.query_id, r[group]) for r in piece]
            which = np.array([place[q] for q, _ in keys], np.int64)
            top, doc_at = np.array([r.score for r in piece]), np.array([r.doc_id for r in piece])
            counted = staged(_places(v, group, names, matrix, keys, which, top, doc_at, count_schema), "places")
            out = counted if out is None else out.unionByName(counted)
    if out is None:
        return vectors.sparkSession.createDataFrame([], T.StructType([best_schema["query_id"], best_schema[group], T.StructField("rank", T.IntegerType())]))
    return out


#: Rows of queries and groups whose vectors are counted in one pass.
FIRSTS = 500_000


def _pieces(rows: DataFrame) -> Iterator[list]:
    held: list = []
    for r in rows.toLocalIterator():
        held.append(r)
        if len(held) == FIRSTS:
            yield held
            held = []
    if held:
        yield held


def _places(v: DataFrame, group: str, names: np.ndarray, matrix: np.ndarray, keys: list, which: np.ndarray, top: np.ndarray, doc_at: np.ndarray, schema: T.StructType) -> DataFrame:
    """(query_id, group, rank): how many vectors come before each of some stated ones, and one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(keys), np.int64)
        for batch, scores in dense_batches(batches, matrix):
            doc = _ids(batch.column(0))
            scores[names[:, None] == doc[None, :]] = -np.inf
            for at in range(0, len(keys), 1024):
                s, t, d = scores[which[at : at + 1024]], top[at : at + 1024, None], doc_at[at : at + 1024, None]
                n[at : at + 1024] += ((s > t) | ((s == t) & (doc[None, :] < d))).sum(1)
        yield pa.RecordBatch.from_pylist([{"query_id": q, group: g, "n": int(c)} for (q, g), c in zip(keys, n, strict=True)], schema=to_arrow_schema(schema))

    return v.mapInArrow(run, schema).groupBy("query_id", group).agg((F.sum("n") + 1).cast("int").alias("rank"))


def reciprocal_rank_fusion(rankings: list[DataFrame], weights: list[float] | None = None, constant: int = 60) -> DataFrame:
    """(query_id, doc_id, score): the weighted sum of 1 / (constant + rank) over rankings."""
    weights = weights or [1.0] * len(rankings)
    if len(weights) != len(rankings) or min(weights) < 0 or max(weights) <= 0:
        raise ValueError("a weight of at least 0 for each ranking, one above 0")
    parts = [r.select("query_id", "doc_id", (F.lit(float(w)) / (constant + F.col("rank"))).alias("part")) for r, w in zip(rankings, weights, strict=True)]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole.groupBy("query_id", "doc_id").agg(F.sum("part").alias("score"))


def top_k_distinct(scored: DataFrame, k: int, group: str) -> DataFrame:
    """The best document of each group, then the first k of these."""
    best = top_k(scored, 1, ["query_id", group]).drop("rank")
    return top_k(best, k)


def compress(rows: DataFrame, query: str, stored: str, max_chars: int, keys: list[str], scores: str | None = None, seeds: int = 12, radius: int = 1) -> DataFrame:
    """(*keys, text): each document (an array of stored sentences) cut to `max_chars` for its query.

    Without `scores`, by words shared with the query: a document that fits is kept whole; else the best sentences and their neighbours are taken in order of
    place while the budget holds. With `scores`, an array of a number a sentence: seeds in order of score and their neighbours by distance, as long as each fits; if none
    does, the beginning of the best. A document is one row, so nothing is shuffled.
    """
    if max_chars < 1:
        raise ValueError("max_chars must be at least 1")
    all_ = F.transform(sentences(F.col(stored)), lambda x, i: F.struct(i.alias("pos"), x.alias("s"), F.concat(F.lit("["), i.cast("string"), F.lit("] "), x).alias("piece")))
    terms = F.array_distinct(tokens(F.col(query)))
    shared = lambda x: F.aggregate(F.array_intersect(F.array_distinct(tokens(x)), terms), F.lit(0.0), lambda acc, w: acc + 1 + F.length(w) / 20.0)
    doc = rows.select(*keys, query, *([scores] if scores else []), all_.alias("__all"))
    score = (lambda x: F.get(F.col(scores), x["pos"])) if scores else (lambda x: shared(x["s"]))
    doc = doc.withColumn("__ranked", F.array_sort(F.transform("__all", lambda x: F.struct((-F.round(score(x), 9)).alias("order"), x["pos"].alias("pos")))))
    seed = F.transform(F.slice("__ranked", 1, seeds), lambda x: x["pos"])
    start = F.struct(F.lit(0).alias("n"), F.array().cast("array<int>").alias("kept"))
    size = lambda i: F.length(F.get(F.col("__all"), i)["piece"])

    def take(acc: Column, i: Column, cost: Column, fits: Column) -> Column:
        return F.when(fits, F.struct((acc["n"] + cost).cast("int").alias("n"), F.array_append(acc["kept"], i).alias("kept"))).otherwise(acc)

    near = F.flatten(F.transform(seed, lambda p: F.sequence(p - radius, p + radius)))
    inside = lambda arr: F.array_distinct(F.filter(arr, lambda i: (i >= 0) & (i < F.size("__all"))))
    if scores is None:
        chosen = F.array_sort(inside(near))
        fold = F.aggregate(chosen, start, lambda acc, i: take(acc, i, size(i) + 1, (F.size(acc["kept"]) == 0) | (acc["n"] + size(i) + 1 <= max_chars)))
    else:
        # a seed, then its neighbours, the left one first at each distance; a sentence keeps its first place in this order
        steps = [0, *[d * sign for d in range(1, radius + 1) for sign in (-1, 1)]]
        chosen = inside(F.flatten(F.transform(seed, lambda p: F.array(*[p + d for d in steps]))))
        cost = lambda acc, i: size(i) + (F.size(acc["kept"]) > 0).cast("int")
        fold = F.aggregate(chosen, start, lambda acc, i: take(acc, i, cost(acc, i), acc["n"] + cost(acc, i) <= max_chars))
    doc = doc.withColumn("__kept", F.array_sort(fold["kept"]))
    text = F.substring(F.array_join(F.transform("__kept", lambda i: F.get(F.col("__all"), i)["piece"]), " "), 1, max_chars) if scores is None else F.array_join(F.transform("__kept", lambda i: F.get(F.col("__all"), i)["piece"]), " ")
    if scores is None:
        whole = F.array_join(F.transform("__all", lambda x: x["s"]), " ")
        text = F.when(F.length(whole) <= max_chars, whole).otherwise(text)
    else:
        best = F.get(F.col("__all"), F.get(F.col("__ranked"), F.lit(0))["pos"])["piece"]
        text = F.when(F.size("__all") == 0, "").when(F.size("__kept") == 0, F.substring(best, 1, max_chars)).otherwise(text)
    return doc.select(*keys, text.alias("text"))


def two_stage(docs: DataFrame, id_col: str, title: Column, text: Column, queries: DataFrame, query_id: str, query: Column, k: int, limit: int = 100, focus: int = 8, stemmed: bool = False) -> DataFrame:
    """(query_id, doc_id, score, rank): documents named by title, or with all of a query's longest terms, ranked by BM25 within these candidates.

    Candidates are documents whose title, its blanks as underscores, is a run of words of the query; the best `limit` documents with all of the `focus` longest terms; and,
    while a query of three terms or more has fewer than k, the best `limit` with all of these but one, the first left out first. They are found by words and ordered by
    the BM25 of all of the query's words; or, `stemmed`, found by stems, titles weighing three times, and ordered by the BM25 of the terms asked for. A query's candidates, at most
    (focus + 1) x limit and those named, are ranked by BM25 over the words of titles and texts with counts among the candidates. Documents are scored only if they have all, or all but one, of the longest terms.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(title, F.lit("")).alias("title"), F.coalesce(text, F.lit("")).alias("text"))
    q = staged(queries.select(F.col(query_id).alias("query_id"), query.alias("q"), fts_terms(query).alias("terms"), title_candidates(query).alias("names")), "queries").where(F.size("terms") > 0)
    longest = F.slice(F.array_sort(F.transform("terms", lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))), 1, focus)
    asked = staged(q.select("query_id", F.posexplode(longest["w"]).alias("place", "term"), F.size(longest).alias("need")), "focused")
    focused = asked.withColumn("term", F.get(stems.stem("term"), F.lit(0))) if stemmed else asked
    terms = staged(inverted.term_rows(q, "query_id", F.col("q")), "terms")
    both = F.concat_ws(" ", "title", "text")
    words = inverted.index(d, "doc_id", [(both, 1.0)], terms)
    found = inverted.index(d, "doc_id", [(F.col("title"), 3.0), (F.col("text"), 1.0)], focused, analyser="stems", floor=True) if stemmed else words
    by_title = d.select("doc_id", F.translate(composed(F.col("title")), " ", "_").alias("name")).where("name <> ''")
    named = q.select("query_id", F.explode("names").alias("name")).join(by_title, "name").select("query_id", "doc_id").distinct()
    need = asked.select("query_id", "need").distinct()
    near = inverted.having(found, focused, 1).join(need, "query_id").withColumn("score", F.aggregate("weights", F.lit(0.0), lambda acc, w: acc + w))
    if not stemmed:
        near = near.drop("score").join(inverted.of_documents(words, terms, near).select("query_id", "doc_id", "score"), ["query_id", "doc_id"])
    near = staged(near, "near")
    # a document with all terms is a hit of every relaxed expression too
    strict = staged(top_k(near.where("missing = 0"), limit).select("query_id", "doc_id"), "strict")
    first = strict.unionByName(named).distinct()
    short = q.select("query_id").join(first.groupBy("query_id").agg(F.count("*").alias("have")), "query_id", "left").where(F.coalesce("have", F.lit(0)) < k).select("query_id", F.coalesce("have", F.lit(0)).alias("have"))
    each = F.posexplode("weights").alias("leaves", "w")
    relaxed = near.where("need > 2").join(short, "query_id").select("query_id", "doc_id", "score", "have", "missing", each).where("missing = 0 OR w = 0")
    relaxed = top_k(relaxed.withColumn("score", F.col("score") - F.col("w")) if stemmed else relaxed, limit, ["query_id", "leaves"])
    fresh = relaxed.join(first, ["query_id", "doc_id"], "left_anti").groupBy("query_id", "have", "doc_id").agg(F.min("leaves").alias("leaves"))
    by_tier = Window.partitionBy("query_id").orderBy("leaves").rangeBetween(Window.unboundedPreceding, -1)
    # an expression is asked while those before it have left fewer than k
    fresh = fresh.withColumn("before", F.col("have") + F.count("*").over(by_tier)).where(F.col("before") < k).select("query_id", "doc_id")
    candidates = staged(first.unionByName(fresh).distinct(), "candidates")
    counts = inverted.of_documents(words, terms, candidates, "tf")  # of every candidate, also those without a term
    lengths = counts.groupBy("query_id").agg(F.count("*").alias("n_docs"), F.avg("length").alias("avg_dl"))
    tf = counts.select("query_id", "doc_id", F.col("length").alias("dl"), F.posexplode("weights").alias("place", "tf")).where("tf > 0")
    df = tf.groupBy("query_id", "place").agg(F.count("*").alias("df")).join(lengths, "query_id")
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.greatest(F.col("avg_dl"), F.lit(1.0))))
    scores = tf.join(df, ["query_id", "place"]).groupBy("query_id", "doc_id").agg(F.sum(weight).alias("s"))
    return top_k(candidates.join(scores, ["query_id", "doc_id"], "left").select("query_id", "doc_id", F.coalesce("s", F.lit(0.0)).alias("score")), k)

"""Inverted blocks: a lexical index whose blocks are scored whole, and skipped when their largest weights can't reach a query's k-th score.

A block holds the postings of some hundred documents: terms, where each term's postings begin, and for each posting the document's place, its count and its
weight. Blocks are cut where the texts are read, so texts and postings are never shuffled by term. Only a number a block and term (its documents) is summed, for document frequencies.
A search sends a bounded piece of the stated queries to all tasks. A task goes through its blocks with a running first k of each query; a query skips a block
if the sum of its terms' largest weights there is strictly below its k-th score. What a task passes on is k rows a query, however many documents share a word with it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import stems
from ..staging import spread, staged

K1, B = 1.2, 0.75
#: Documents and postings of a block; asked terms that are sent to all tasks, beyond which blocks hold all their terms; queries of a pass.
BLOCK_DOCS, BLOCK_POSTINGS, ASKED, QUERY_BLOCK = 512, 1 << 19, 500_000, 4096
_WORDS = re.compile(r"\w+")
#: How texts and queries become terms; "query_stems" is the query's side of "stems", where terms with one stem count each.
ANALYSERS: dict[str, Callable[[str], list[str]]] = {"words": lambda text: _WORDS.findall(text.casefold()), "stems": stems.analysed, "query_stems": stems.query_stems}

_POSTINGS = "terms array<string>, starts array<int>, at array<int>, tf array<float>"


@dataclass
class Index:
    """Weighted blocks (block, part, ids, lengths, terms, starts, at, tf, w, most) and the analyser that made them."""

    blocks: DataFrame
    analyser: str
    id_type: T.DataType
    part_type: T.DataType


def term_rows(queries: DataFrame, id_col: str, text: Column, analyser: str = "words") -> DataFrame:
    """(query_id, term, place, inner) of each query's distinct terms (all of them by "query_stems"); inner: among its words but the first and the last."""
    analyse, once = ANALYSERS[analyser], analyser != "query_stems"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for i, text in enumerate(batch["text"].to_pylist()):
                words = analyse(text or "")
                inner = set(words[1:-1])
                rows += [(i, w, k, w in inner) for k, w in enumerate(dict.fromkeys(words) if once else words)]
            own, term, place, inner = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch["query_id"].take(pa.array(own, pa.int32())), pa.array(term, pa.string()), pa.array(place, pa.int32()), pa.array(inner, pa.bool_())], ["query_id", "term", "place", "inner"])

    rows = queries.select(F.col(id_col).alias("query_id"), text.alias("text"))
    return rows.mapInArrow(run, T.StructType([rows.schema["query_id"], T.StructField("term", T.StringType()), T.StructField("place", T.IntegerType()), T.StructField("inner", T.BooleanType())]))


def _cutter(analyser: str, weights: list[float], asked: frozenset | None):
    """Documents (id, part, one text a field) as blocks of one part each."""
    analyse = ANALYSERS[analyser]

    def block(part, docs: list) -> dict:
        postings: dict[str, tuple[list, list]] = {}
        for k, (_, _, counts) in enumerate(docs):
            for term, n in counts.items():
                at, tf = postings.setdefault(term, ([], []))
                at.append(k)
                tf.append(n)
        terms = sorted(postings)
        starts = np.cumsum([0, *(len(postings[t][0]) for t in terms)])
        flat = lambda i: [x for t in terms for x in postings[t][i]]
        return {"part": part, "ids": [d[0] for d in docs], "lengths": [d[1] for d in docs], "terms": terms, "starts": starts.tolist(), "at": flat(0), "tf": flat(1)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        schema = None
        for batch in batches:
            schema = schema or pa.schema(
                [("part", batch.schema.field("part").type), ("ids", pa.list_(batch.schema.field("id").type)), ("lengths", pa.list_(pa.int32())), ("terms", pa.list_(pa.string()))]
                + [("starts", pa.list_(pa.int32())), ("at", pa.list_(pa.int32())), ("tf", pa.list_(pa.float32()))]
            )
            fields = [batch[f"f{i}"].to_pylist() for i in range(len(weights))]
            for row, (own, part) in enumerate(zip(batch["id"].to_pylist(), batch["part"].to_pylist(), strict=True)):
                counts: Counter = Counter()
                length = 0
                for texts, weight in zip(fields, weights, strict=True):
                    words = analyse(texts[row] or "")
                    length += len(words)
                    for term, n in Counter(words).items():
                        if asked is None or term in asked:
                            counts[term] += n * weight
                docs = held.setdefault(part, [0, []])
                docs[0] += len(counts)
                docs[1].append((own, length, counts))
                if len(docs[1]) >= BLOCK_DOCS or docs[0] >= BLOCK_POSTINGS:
                    yield pa.RecordBatch.from_pylist([block(part, held.pop(part)[1])], schema=schema)
        for part in list(held):
            yield pa.RecordBatch.from_pylist([block(part, held.pop(part)[1])], schema=schema)

    return run


def _weigher(k1: float, b: float, floor: bool):
    """Blocks with each term's document frequency and the lengths' mean get weights and each term's largest weight. `floor`: the idf of full-text engines, held above 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                n, df = r.pop("n_docs"), np.array(r.pop("df"), np.float64)
                mean = max(r.pop("avg_dl"), 1.0)
                idf = np.maximum(np.log((n - df + 0.5) / (df + 0.5)), 1e-6) if floor else np.log(1 + (n - df + 0.5) / (df + 0.5))
                tf, dl = np.array(r["tf"], np.float64), np.array(r["lengths"], np.float64)[np.array(r["at"], np.int64)]
                starts = np.array(r["starts"], np.int64)
                w = np.repeat(idf, np.diff(starts)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / mean))
                rows.append(r | {"w": w, "most": np.maximum.reduceat(w, starts[:-1]) if len(df) else w})
            names = [*rows[0]] if rows else []
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([batch.schema.field(c) if c in batch.schema.names else pa.field(c, pa.list_(pa.float64())) for c in names]))

    return run


def index(docs: DataFrame, id_col: str, fields: list[tuple[Column, float]], terms: DataFrame | None = None, part: str | None = None, own_counts: bool = False, analyser: str = "words", floor: bool = False) -> Index:
    """An index of weighted fields. `terms`: only these are held. `part`: a column that a block has one value of; `own_counts`: whether documents are counted within it."""
    spark = docs.sparkSession
    asked = None
    if terms is not None:
        asked_rows = staged(terms.select("term").distinct(), "terms")
        if asked_rows.count() <= ASKED:
            asked = frozenset(r.term for r in asked_rows.toLocalIterator())
    part_column = F.col(part) if part else F.lit(None).cast("string")
    rows = spread(docs.select(F.col(id_col).alias("id"), part_column.alias("part"), *[c.alias(f"f{i}") for i, (c, _) in enumerate(fields)]))
    id_type, part_type = rows.schema["id"].dataType, rows.schema["part"].dataType
    schema = T.StructType([T.StructField("part", part_type), T.StructField("ids", T.ArrayType(id_type)), T.StructField("lengths", T.ArrayType(T.IntegerType())), *T.StructType.fromDDL(_POSTINGS)])
    cut = rows.mapInArrow(_cutter(analyser, [w for _, w in fields], asked), schema).withColumn("block", F.monotonically_increasing_id())
    cut = staged(cut, "blocks")
    on = ["part"] if own_counts else []
    same = lambda a, b: [F.col(f"{a}.part").eqNullSafe(F.col(f"{b}.part"))] if own_counts else []
    long_sum = F.aggregate("lengths", F.lit(0).cast("long"), lambda acc, x: acc + x)
    lengths = cut.groupBy(*on).agg(F.sum(F.size("ids")).alias("n_docs"), (F.sum(long_sum) / F.sum(F.size("ids"))).alias("avg_dl"))
    counts = cut.select("block", "part", F.posexplode("terms").alias("k", "term"), "starts").select("block", "part", "k", "term", (F.get("starts", F.col("k") + 1) - F.get("starts", F.col("k"))).alias("n"))
    df = counts.groupBy(*on, "term").agg(F.sum("n").alias("df"))
    met = counts.alias("c").join(df.alias("d"), [F.col("c.term") == F.col("d.term"), *same("c", "d")])
    of_block = met.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("c.k", "d.df")))["df"].alias("df"))  # a block's own terms
    full = cut.join(of_block, "block", "left").withColumn("df", F.coalesce("df", F.array().cast("array<long>")))
    full = full.alias("c").join(lengths.alias("l"), same("c", "l")).select("c.*", "l.n_docs", "l.avg_dl") if own_counts else full.crossJoin(F.broadcast(lengths))  # one row
    out = T.StructType([cut.schema["block"], *schema, *T.StructType.fromDDL("w array<double>, most array<double>")])
    weighted = full.select("block", *schema.names, "df", "n_docs", "avg_dl").mapInArrow(_weigher(K1, B, floor), out)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "8")  # a row is a block
    try:
        return Index(staged(weighted, "index"), analyser, id_type, part_type)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


class Asked:
    """A piece of the queries: their ids, and which terms each has."""

    def __init__(self, rows: list):
        self.ids = [r.query_id for r in rows]
        self.names = sorted({t for r in rows for t in r.terms})
        place = {t: i for i, t in enumerate(self.names)}
        self.query = np.repeat(np.arange(len(rows)), [len(r.terms) for r in rows])
        self.term = np.array([place[t] for r in rows for t in r.terms], np.int64)
        self.bounds = np.searchsorted(self.query, np.arange(len(rows) + 1))
        self.place = place
        self.asked_docs = [getattr(r, "docs", None) for r in rows]

    def local(self, terms: list[str]) -> np.ndarray:
        """For each pair of query and term, where the block has the term, or -1."""
        where = np.full(len(self.names) + 1, -1, np.int64)
        for k, t in enumerate(terms):
            where[self.place.get(t, -1)] = k
        where[-1] = -1
        return where[self.term]


def pieces(queries: DataFrame) -> Iterator[Asked]:
    """(query_id, terms array, ...) as pieces of bounded size; the driver holds one at a time."""
    rows: list = []
    for r in queries.toLocalIterator():
        rows.append(r)
        if len(rows) == QUERY_BLOCK:
            yield Asked(rows)
            rows = []
    if rows:
        yield Asked(rows)


def by_query(terms: DataFrame, *more: str) -> DataFrame:
    """(query_id, terms) of term rows."""
    return terms.groupBy("query_id", *more).agg(F.sort_array(F.collect_list(F.struct("place", "term")))["term"].alias("terms"))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            one = {c: batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("starts", "at", "tf", "w", "most")}
            yield one | {"terms": batch.column("terms")[i].values.to_pylist(), "part": batch.column("part")[i].as_py(), "ids": batch.column("ids")[i].values, "lengths": batch.column("lengths")[i].values}


def _scores(row: dict, weight: np.ndarray, local: np.ndarray) -> np.ndarray:
    """The sums of a query's terms for all documents of a block; -inf for those without any."""
    spans = [slice(row["starts"][k], row["starts"][k + 1]) for k in local]
    at = np.concatenate([row["at"][s] for s in spans])
    total = np.bincount(at, np.concatenate([weight[s] for s in spans]), len(row["ids"]))
    return np.where(np.bincount(at, minlength=len(row["ids"])) > 0, total, -np.inf)


def _weights(row: dict, weight: np.ndarray, local: np.ndarray) -> np.ndarray:
    """A query's terms by documents of a block, 0 where a document lacks a term."""
    out = np.zeros((len(local), len(row["ids"])))
    for i, t in enumerate(local.tolist()):
        if t >= 0:
            span = slice(row["starts"][t], row["starts"][t + 1])
            out[i, row["at"][span]] = weight[span]
    return out


def _ids(column: pa.Array) -> np.ndarray:
    ids = column.to_numpy(zero_copy_only=False)
    return ids.astype(str) if ids.dtype == object else ids


def _first_of(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -np.round(scores, 9)))[:k]


def _searcher(asked: Asked, k: int, by: str, per_part: bool, names: list[str], types: list[pa.DataType]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict = {}  # (query, part) to its scores and ids so far
        for row in _rows(batches):
            weight = row["w"] if by == "bm25" else row["tf"]
            most = row["most"] if by == "bm25" else np.maximum.reduceat(weight, row["starts"][:-1]) if len(row["terms"]) else weight
            local, ids = asked.local(row["terms"]), _ids(row["ids"])
            there = local >= 0
            bound = np.bincount(asked.query[there], most[local[there]], len(asked.ids)) + 1e-8
            part = row["part"]
            for q in np.flatnonzero(np.bincount(asked.query[there], minlength=len(asked.ids))).tolist():
                held = best.get((q, part if per_part else None))
                kth = np.round(held[0][k - 1], 9) if held is not None and len(held[0]) >= k else -np.inf
                if bound[q] < kth:
                    continue  # no document of the block can be among the first k
                mine = local[asked.bounds[q] : asked.bounds[q + 1]]
                s = _scores(row, weight, mine[mine >= 0])
                keep = np.flatnonzero((s > -np.inf) & (np.round(s, 9) >= kth))
                if not len(keep):
                    continue
                parts = np.full(len(keep), part, object)
                s, d, p = (np.concatenate(x) for x in zip(held or ((), (), ()), (s[keep], ids[keep], parts), strict=True)) if held is not None else (s[keep], ids[keep], parts)
                order = _first_of(s, d, k)
                best[q, part if per_part else None] = s[order], d[order], p[order]
        if best:
            query = np.repeat([q for q, _ in best], [len(v[0]) for v in best.values()])
            cols = [pa.array([asked.ids[q] for q in query], types[0]), pa.array(np.concatenate([v[1] for v in best.values()])).cast(types[1]), pa.array(np.concatenate([v[2] for v in best.values()]).tolist(), types[2])]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(np.concatenate([v[0] for v in best.values()]))], names)

    return run


def _over(found: Index, queries: DataFrame, schema: T.StructType, job: Callable[[Asked], Callable], tag: str) -> DataFrame:
    """What a job makes of each piece of the queries, written piece by piece."""
    spark, out = found.blocks.sparkSession, None
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "8")
    try:
        for asked in pieces(queries):
            one = staged(found.blocks.mapInArrow(job(asked), schema), tag)
            out = one if out is None else out.unionByName(one)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    return spark.createDataFrame([], schema) if out is None else out


def _types(schema: T.StructType) -> tuple[list[str], list[pa.DataType]]:
    return schema.names, [to_arrow_type(f.dataType) for f in schema]


def search(found: Index, terms: DataFrame, k: int, by: str = "bm25", per_part: bool = False) -> DataFrame:
    """Ranked by score rounded to nine digits, then id: (query_id, doc_id, part, score, rank) of each query's first k documents with a term of it, or of its first k of each part. `by`: "bm25", or "tf" for plain counts."""
    if k < 1:
        raise ValueError("k must be at least 1")
    queries = by_query(terms)
    schema = T.StructType([queries.schema["query_id"], T.StructField("doc_id", found.id_type), T.StructField("part", found.part_type), T.StructField("score", T.DoubleType())])
    rows = _over(found, queries, schema, lambda asked: _searcher(asked, k, by, per_part, *_types(schema)), "found")
    order = Window.partitionBy("query_id", *(["part"] if per_part else [])).orderBy(F.desc(F.round("score", 9)), "doc_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def having(found: Index, terms: DataFrame, lacking: int = 0) -> DataFrame:
    """(query_id, doc_id, weights, missing) of documents that have all of a query's terms, or all but `lacking`: each term's weight in order of place, 0 where it is missing, and how many are."""
    queries = by_query(terms)
    schema = T.StructType([queries.schema["query_id"], T.StructField("doc_id", found.id_type), T.StructField("weights", T.ArrayType(T.DoubleType())), T.StructField("missing", T.IntegerType())])

    def job(asked: Asked):
        names, types = _types(schema)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for row in _rows(batches):
                local = asked.local(row["terms"])
                need = np.diff(asked.bounds)
                have = np.bincount(asked.query[local >= 0], minlength=len(need))
                out: list[tuple] = []
                for q in np.flatnonzero((have >= need - lacking) & (have > 0)).tolist():
                    w = _weights(row, row["w"], local[asked.bounds[q] : asked.bounds[q + 1]])
                    missing = (w == 0).sum(axis=0)
                    out += [(q, d, w[:, d].tolist(), missing[d]) for d in np.flatnonzero((missing <= lacking) & (missing < len(w))).tolist()]
                if out:
                    q, d, w, m = zip(*out, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array([asked.ids[i] for i in q], types[0]), row["ids"].take(pa.array(d)), pa.array(w, types[2]), pa.array(m, types[3])], names)

        return run

    return _over(found, queries, schema, job, "having")


def of_documents(found: Index, terms: DataFrame, wanted: DataFrame, by: str = "bm25") -> DataFrame:
    """(query_id, doc_id, length, score, weights) of wanted (query_id, doc_id) pairs: the query's sum and its terms' weights in order of place, by "bm25" or as counts ("tf"), 0 where a term is missing."""
    listed = wanted.groupBy("query_id").agg(F.collect_set("doc_id").alias("docs"))  # stated documents of a query
    queries = by_query(terms).join(listed, "query_id")
    schema = T.StructType([queries.schema["query_id"], T.StructField("doc_id", found.id_type), T.StructField("length", T.IntegerType()), T.StructField("score", T.DoubleType()), T.StructField("weights", T.ArrayType(T.DoubleType()))])

    def job(asked: Asked):
        names, types = _types(schema)
        of_doc: dict = {}
        for q, docs in enumerate(asked.asked_docs):
            for i in docs:
                of_doc.setdefault(i, []).append(q)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for row in _rows(batches):
                local, docs_of = asked.local(row["terms"]), {}
                for d, i in enumerate(row["ids"].to_pylist()):
                    for q in of_doc.get(i, ()):
                        docs_of.setdefault(q, []).append(d)
                out: list[tuple] = []
                for q, docs in docs_of.items():
                    w = _weights(row, row["w"] if by == "bm25" else row["tf"], local[asked.bounds[q] : asked.bounds[q + 1]])
                    out += [(q, d, row["lengths"][d].as_py(), float(w[:, d].sum()), w[:, d].tolist()) for d in docs]
                if out:
                    q, d, n, t, w = zip(*out, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array([asked.ids[i] for i in q], types[0]), row["ids"].take(pa.array(d)), pa.array(n, types[2]), pa.array(t), pa.array(w, types[4])], names)

        return run

    return _over(found, queries, schema, job, "documents")


def ranks(found: Index, terms: DataFrame, wanted: DataFrame, by: str = "bm25") -> DataFrame:
    """(query_id, doc_id, rank) of wanted (query_id, doc_id, score) documents in the whole ranking; documents without a query term have none.

    A pass counts the documents before each wanted one; the ranking itself is never written.
    """
    listed = wanted.groupBy("query_id").agg(F.collect_list(F.struct("score", "doc_id")).alias("docs"))  # stated documents of a query
    queries = by_query(terms).join(listed, "query_id")
    schema = T.StructType([queries.schema["query_id"], T.StructField("doc_id", found.id_type), T.StructField("n", T.LongType())])

    def job(asked: Asked):
        names, types = _types(schema)
        firsts = []
        for docs in asked.asked_docs:
            ids = _ids(pa.array([d.doc_id for d in docs], types[1]))
            firsts.append((np.round(np.array([d.score for d in docs]), 9), ids))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n = [np.zeros(len(s), np.int64) for s, _ in firsts]
            for row in _rows(batches):
                weight = row["w"] if by == "bm25" else row["tf"]
                local, ids = asked.local(row["terms"]), _ids(row["ids"])
                for q in np.flatnonzero(np.bincount(asked.query[local >= 0], minlength=len(asked.ids))).tolist():
                    mine = local[asked.bounds[q] : asked.bounds[q + 1]]
                    s = np.round(_scores(row, weight, mine[mine >= 0]), 9)
                    top, own = firsts[q]
                    near = s >= top.min()
                    n[q] += ((s[near] > top[:, None]) | ((s[near] == top[:, None]) & (ids[near] < own[:, None]))).sum(axis=1)
            query = np.repeat(np.arange(len(firsts)), [len(s) for s, _ in firsts])
            if len(query):
                yield pa.RecordBatch.from_arrays([pa.array([asked.ids[q] for q in query], types[0]), pa.array(np.concatenate([d for _, d in firsts])).cast(types[1]), pa.array(np.concatenate(n))], names)

        return run

    counted = _over(found, queries, schema, job, "ranks")
    return counted.groupBy("query_id", "doc_id").agg((F.sum("n") + 1).cast("int").alias("rank"))


def fused(found: Index, terms: DataFrame, k: int, weights: list[float], constant: int, kinds: tuple[str, ...] = ("bm25", "tf"), depth: int = 64) -> DataFrame:
    """(query_id, doc_id, score) of the first k by reciprocal-rank fusion of whole rankings of the same index.

    A document beyond the first `depth` of every ranking scores at most the sum of weight / (constant + depth + 1). Where a query's k-th fused score
    is not above that, the depth is doubled for all; ranks of the candidates are exact at every depth.
    """
    queries = terms.select("query_id").distinct().count()
    while True:
        tops = [staged(search(found, terms, depth, by), "depth") for by in kinds]
        candidates = tops[0].select("query_id", "doc_id")
        for t in tops[1:]:
            candidates = candidates.unionByName(t.select("query_id", "doc_id"))
        candidates = staged(candidates.distinct(), "fused-candidates")
        total = None
        for top, by, weight in zip(tops, kinds, weights, strict=True):
            other = candidates.join(top.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")
            deeper = ranks(found, terms, of_documents(found, terms, other, by).select("query_id", "doc_id", "score"), by)
            part = top.select("query_id", "doc_id", "rank").unionByName(deeper).select("query_id", "doc_id", (F.lit(float(weight)) / (constant + F.col("rank"))).alias("p"))
            total = part if total is None else total.unionByName(part)
        order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "doc_id")
        out = total.groupBy("query_id", "doc_id").agg(F.sum("p").alias("score")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        out = staged(out, "fused")
        rest = sum(weights) / (constant + depth + 1)
        # settled: the k-th is above what is left, or every ranking ended before the depth
        ended = tops[0].groupBy("query_id").agg(F.max("rank").alias("r"))
        for t in tops[1:]:
            ended = ended.unionByName(t.groupBy("query_id").agg(F.max("rank").alias("r")))
        ended = ended.groupBy("query_id").agg((F.max("r") < depth).alias("ended"))
        kth = out.groupBy("query_id").agg(F.max(F.when(F.col("rank") == k, F.col("score"))).alias("kth"))
        open_ = ended.join(kth, "query_id", "left").where(~F.col("ended") & ~(F.coalesce("kth", F.lit(-1.0)) > rest + 1e-9))
        if not queries or open_.isEmpty():
            return out
        depth *= 2

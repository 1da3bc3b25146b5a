"""Rankings of a case's own documents: by words, by vectors, or by both fused with a constant and weights of the case's benchmark.

A case is a row with its documents in an array, so a case's documents never meet another's: no join, no shuffle, and a pair of case and document that is not a candidate
is never made. Words are counted within the case.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .inverted import ANALYSERS, K1, B

MODES = ("lexical", "dense", "weighted_hybrid")


@dataclass(frozen=True)
class Fusion:
    """How two rankings of a case are fused: sum of weight / (constant + rank)."""

    constant: int
    lexical: float
    dense: float

    def __post_init__(self):
        if self.constant < 1 or min(self.lexical, self.dense) < 0 or max(self.lexical, self.dense) <= 0:
            raise ValueError("a constant of at least 1, weights of at least 0 and one above")


#: The fusion of each benchmark that has bounded candidates.
FUSIONS = {"hotpotqa": Fusion(10, 0.25, 1.0), "natural_questions": Fusion(30, 0.25, 1.0)}


def lexical_scores(query: str, texts: list[str]) -> np.ndarray:
    """BM25 of each text, with counts among these texts only; a text without a query term scores 0."""
    analyse = ANALYSERS["words"]
    terms = list(dict.fromkeys(analyse(query)))
    place = {t: i for i, t in enumerate(terms)}
    tf, lengths = np.zeros((len(texts), len(terms))), np.zeros(len(texts))
    for row, text in enumerate(texts):
        counts = Counter(analyse(text))
        lengths[row] = counts.total()
        for t in counts.keys() & place.keys():
            tf[row, place[t]] = counts[t]
    df = (tf > 0).sum(axis=0)
    idf = np.log(1 + (len(texts) - df + 0.5) / (df + 0.5))
    norm = 1 - B + B * lengths / max(lengths.mean() if len(texts) else 1.0, 1.0)
    return (idf * tf * (K1 + 1) / (tf + K1 * norm[:, None])).sum(axis=1)


def _ranks(scores: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Each document's rank by (-score rounded to nine digits, id), from 1."""
    out = np.empty(len(scores), np.int64)
    out[np.lexsort((ids, -np.round(scores, 9)))] = np.arange(1, len(scores) + 1)
    return out


def _case(mode: str, benchmark: str, query: str, vector: list | None, docs: list[dict], k: int, fusions: dict[str, Fusion]) -> list[tuple]:
    """(id, score, rank) of a case's first k documents."""
    if not docs:
        return []
    ids = np.array([d["id"] for d in docs])
    scores = lexical = dense = None
    if mode != "dense":
        lexical = lexical_scores(query or "", [f"{d['title'] or ''} {d['text'] or ''}" for d in docs])
    if mode != "lexical":
        dense = np.array([d["vector"] for d in docs], np.float64) @ np.array(vector, np.float64)
    if mode == "weighted_hybrid":
        if benchmark not in fusions:
            raise ValueError(f"no fusion is stated for {benchmark}")
        f = fusions[benchmark]
        scores = f.lexical / (f.constant + _ranks(lexical, ids)) + f.dense / (f.constant + _ranks(dense, ids))
    else:
        scores = lexical if dense is None else dense
    ranks = _ranks(scores, ids)
    return [(docs[i]["id"], float(scores[i]), int(ranks[i])) for i in np.argsort(ranks)[:k]]


def rank(cases: DataFrame, case_id: str, query: str, documents: str, k: int, mode: str, vector: str | None = None, benchmark: Column | None = None, fusions: dict[str, Fusion] = FUSIONS) -> DataFrame:
    """(query_id, doc_id, score, rank) of each case's first k documents; `documents`: an array of (id, title, text[, vector]). A case without documents has no rows."""
    if k < 1:
        raise ValueError("k must be at least 1")
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode}")
    benchmark = F.lit(None).cast("string") if benchmark is None else benchmark
    rows = cases.select(F.col(case_id).alias("case"), F.col(query).alias("query"), F.col(vector).alias("vector") if vector else F.lit(None).alias("vector"), F.col(documents).alias("docs"), benchmark.alias("benchmark"))
    id_type = rows.schema["docs"].dataType.elementType["id"].dataType
    schema = T.StructType([T.StructField("query_id", rows.schema["case"].dataType), T.StructField("doc_id", id_type), T.StructField("score", T.DoubleType()), T.StructField("rank", T.IntegerType())])
    inner, own = to_arrow_type(id_type), to_arrow_type(rows.schema["case"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[], [], [], []]
            for r in batch.to_pylist():
                for i, score, place in _case(mode, r["benchmark"], r["query"], r["vector"], r["docs"] or [], k, fusions):
                    for c, v in zip(cols, (r["case"], i, score, place), strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], own), pa.array(cols[1], inner), pa.array(cols[2], pa.float64()), pa.array(cols[3], pa.int32())], schema.names)

    return rows.mapInArrow(run, schema)

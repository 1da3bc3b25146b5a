"""Toxicity by a chain of linear classifiers.

Categories are predicted in order. The model of each sees which of its chosen tokens (words and beginnings of words) a text has and the probabilities of the categories
before it; in training these are out-of-fold, from models whose tokens and weights come from texts of other folds only. The models are fitted on a bounded sample of
labelled texts (`max_labels`), drawn by hash; tokens are counted in Spark, and of those in `least_texts` sampled texts and with a chi-square of `least_chi2` the
`max_tokens` with the largest are chosen a category and fold, so the driver holds max_labels rows of the chosen tokens at most. Judging is map-only over whole texts.

Defined cases: a null or empty text has no tokens and gets the models' base rates; a very long one is judged whole. Rows of labels that are null in a category don't count
for it; of several label rows for an id the largest value counts, of several texts the first in order. Without labels, or with one class only, a category's probability is its base
rate (0 without labels). Ids that are null are judged and not learned from. Tokens that tie in chi-square are taken by hash. An empty table has an empty result. Further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels
from ._common import Stage, pick, small_batches, tidy
from .decontaminate import _Filter

FOLDS = 5
#: Beginnings of tokens, in bytes, that are tokens too: they stand for inflected forms.
PREFIXES = (4, 5, 6)


def _tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all tokens and of their beginnings, and the text that each is from."""
    data, offsets = kernels.text_buffers(column)
    h, start, end, at = kernels.words(data, offsets, ends=kernels.TOKEN_ENDS)
    text = np.repeat(np.arange(len(column)), np.diff(at))
    hashes, texts = [h], [text]
    for p, which in kernels.prefixes(data, start, end, PREFIXES):
        hashes.append(p)
        texts.append(text[which])
    return np.concatenate(hashes), np.concatenate(texts)


def _distinct(h: np.ndarray, text: np.ndarray, n: int) -> list[np.ndarray]:
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    h, text = h[first], text[first]
    return np.split(h, np.searchsorted(text, np.arange(1, n))) if n else []


@dataclass
class Link:
    """One category's model: weights of tokens and of the earlier categories' probabilities."""

    name: str
    tokens: np.ndarray
    weights: np.ndarray
    bias: float = -30.0


@dataclass
class Chain:
    links: list[Link] = field(default_factory=list)

    def predict(self, column: pa.Array) -> np.ndarray:
        """(texts, categories) probabilities."""
        h, owner = _tokens(column)
        out = np.zeros((len(column), len(self.links)))
        for c, link in enumerate(self.links):
            hit = _Filter(link.tokens).find(h)
            text, token = owner[hit], np.searchsorted(link.tokens, h[hit])
            once = np.unique(text * (len(link.tokens) + 1) + token)
            text, token = once // (len(link.tokens) + 1), once % (len(link.tokens) + 1)
            z = link.bias + np.bincount(text, link.weights[token], len(column)) + out[:, :c] @ link.weights[len(link.tokens) :]
            out[:, c] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return out


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, steps: int = 25) -> np.ndarray:
    """Weights, the bias last, by Newton's method."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + penalty * w
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty), gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, categories: dict[str, tuple[str, int]], id_col: str = "doc_id", text_col: str = "text", max_labels: int = 20_000, max_tokens: int = 256, least_chi2: float = 20.0, least_texts: int = 4) -> Chain:
    """A chain over `categories`: name to (column of `labels`, value that means yes), in order."""
    spark = docs.sparkSession
    small_batches(spark)
    stage = Stage(spark, "toxicity")
    u = F.conv(F.substring(F.md5(F.col("id").cast("string")), 1, 8), 16, 10).cast("double") / float(1 << 32)
    known = labels.select(pick(labels, id_col).alias("id"), *[(pick(labels, col) == yes).cast("double").alias(f"y{c}") for c, (col, yes) in enumerate(categories.values())]).where("id is not null")
    total = known.count()
    ys = [f"y{c}" for c in range(len(categories))]
    drawn = known.withColumn("u", u).where(F.col("u") < 1.1 * max_labels / max(total, 1)).groupBy("id", "u").agg(*[F.max(y).alias(y) for y in ys]).orderBy("u", "id").limit(max_labels)
    # at most max_labels ids and labels, whatever the input; one text an id
    texts = docs.select(pick(docs, id_col).alias("id"), pick(docs, text_col).cast("string").alias("text")).join(F.broadcast(drawn), "id").groupBy("id", *ys).agg(F.min("text").alias("text"))
    sample = stage.write("sample", _token_sets(texts, ys))
    links: list[Link] = []
    if sample.isEmpty():
        return Chain([Link(c, np.zeros(0, np.uint64), np.zeros(k)) for k, c in enumerate(categories)])
    chosen = _choose(sample, ys, max_tokens, least_chi2, least_texts)
    every = np.unique(np.concatenate(list(chosen.values())))
    rows = _matrix_rows(sample, every, ys).collect()  # max_labels rows of the chosen tokens' places
    stage.drop("sample")
    rows.sort(key=lambda r: (r.fold, r.mark, r.at))
    full = np.zeros((len(rows), len(every)), bool)
    for i, r in enumerate(rows):
        full[i, r.at] = True
    fold = np.array([r.fold for r in rows])
    earlier = np.zeros((len(rows), 0))
    for c, name in enumerate(categories):
        y = np.array([np.nan if r[ys[c]] is None else r[ys[c]] for r in rows])
        there = ~np.isnan(y)

        def seen_by(f: int, earlier: np.ndarray = earlier, c: int = c) -> np.ndarray:
            return np.hstack([full[:, np.searchsorted(every, chosen[c, f])].astype(float), earlier])

        if there.sum() == 0 or y[there].min() == y[there].max():
            rate = float(np.clip(y[there].mean() if there.any() else 0.0, 1e-13, 1 - 1e-13))
            links.append(Link(name, chosen[c, FOLDS], np.zeros(len(chosen[c, FOLDS]) + c), float(np.log(rate / (1 - rate)))))
            earlier = np.hstack([earlier, np.full((len(rows), 1), rate)])
            continue
        unseen = np.full(len(rows), y[there].mean())
        for f in range(FOLDS):
            train, rest = there & (fold != f), fold == f
            if train.any() and y[train].min() < y[train].max():
                x = seen_by(f)
                w = logistic(x[train], y[train])
                unseen[rest] = 1 / (1 + np.exp(-np.clip(x[rest] @ w[:-1] + w[-1], -30, 30)))
        w = logistic(seen_by(FOLDS)[there], y[there])
        links.append(Link(name, chosen[c, FOLDS], w[:-1], float(w[-1])))
        earlier = np.hstack([earlier, unseen[:, None]])
    return Chain(links)


def _token_sets(texts: DataFrame, ys: list[str]) -> DataFrame:
    """(fold, mark, labels, tokens): a text's distinct token hashes."""
    rows = texts.select(F.pmod(F.crc32(F.col("id").cast("string").cast("binary")), F.lit(FOLDS)).cast("int").alias("fold"), F.md5(F.col("id").cast("string")).alias("mark"), *ys, "text")
    schema = T.StructType([*[f for f in rows.schema if f.name != "text"], T.StructField("tokens", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [s.view(np.int64) for s in _distinct(*_tokens(batch.column(batch.num_columns - 1)), batch.num_rows)]
            flat = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *[len(s) for s in sets]]).astype(np.int32)), pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], flat], names=[*batch.schema.names[:-1], "tokens"])

    return rows.mapInArrow(tidy(run), schema)


def _choose(sample: DataFrame, ys: list[str], most: int, least_chi2: float, least_texts: int) -> dict[tuple[int, int], np.ndarray]:
    """By category and fold, sorted, the tokens whose presence depends most on the label in the texts outside that fold (fold FOLDS: in all)."""
    sets = [(c, f) for c in range(len(ys)) for f in range(FOLDS + 1)]

    def sums(extra: list) -> list:
        """Labelled rows and positives of each set."""
        return [F.coalesce(F.sum(F.when(F.col("fold") != f, v)), F.lit(0.0)).alias(f"{kind}{c}_{f}") for c, f in sets for kind, v in (("n", F.col(ys[c]).isNotNull().cast("double")), ("p", F.col(ys[c])))] + extra

    whole = sample.agg(*sums([])).first()
    counts = sample.select("fold", *ys, F.explode("tokens").alias("token")).groupBy("token").agg(*sums([]))
    found = []
    for c, f in sets:
        n, pos, k, p = whole[f"n{c}_{f}"], whole[f"p{c}_{f}"], F.col(f"n{c}_{f}"), F.col(f"p{c}_{f}")
        chi2 = F.lit(n) * F.pow(p * (F.lit(n - pos) - (k - p)) - (k - p) * (F.lit(pos) - p), F.lit(2.0)) / (k * (n - k + 1e-9) * F.lit(max(pos * (n - pos), 1e-9)))
        found.append(F.when(k >= least_texts, F.struct(F.lit(c).alias("c"), F.lit(f).alias("f"), chi2.alias("chi2"))))
    ranked = counts.select("token", F.explode(F.array(*found)).alias("s")).select("token", "s.*").where(F.col("chi2") >= least_chi2)
    top = ranked.withColumn("r", F.row_number().over(Window.partitionBy("c", "f").orderBy(F.desc("chi2"), "token"))).where(F.col("r") <= most).collect()
    of: dict[tuple[int, int], list[int]] = {s: [] for s in sets}
    for r in top:
        of[r.c, r.f].append(r.token)
    return {s: np.unique(np.array(t, np.int64).view(np.uint64)) for s, t in of.items()}


def _matrix_rows(sample: DataFrame, every: np.ndarray, ys: list[str]) -> DataFrame:
    schema = T.StructType([*[f for f in sample.schema if f.name != "tokens"], T.StructField("at", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for v in batch.column(batch.num_columns - 1):
                t = v.values.to_numpy().view(np.uint64)
                at = np.searchsorted(every, t)
                found.append(at[every[np.minimum(at, len(every) - 1)] == t].tolist() if len(every) else [])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.list_(pa.int32()))], names=[*batch.schema.names[:-1], "at"])

    return sample.mapInArrow(tidy(run), schema)


def judge(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, keep_columns: bool = False) -> DataFrame:
    """id, a probability for each category and `toxic`, whether the last one reaches the threshold.

    With `keep_columns` instead the input's rows whose text is not toxic.
    """
    small_batches(docs.sparkSession)
    probs = [f"p_{link.name}" for link in chain.links]
    text = pick(docs, text_col).cast("string")
    if keep_columns:
        kept = docs.select(text.alias("__rl_text"), *[pick(docs, c) for c in docs.columns])
        schema = docs.schema
    else:
        kept = docs.select(text.alias("__rl_text"), pick(docs, id_col).alias(id_col))
        schema = T.StructType([kept.schema[id_col], *[T.StructField(p, T.DoubleType()) for p in probs], T.StructField("toxic", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = chain.predict(batch.column(0))
            toxic = p[:, -1] >= threshold
            if keep_columns:
                yield pa.RecordBatch.from_arrays(batch.columns[1:], names=batch.schema.names[1:]).filter(pa.array(~toxic))
            else:
                yield pa.RecordBatch.from_arrays([batch.column(1), *[pa.array(p[:, c]) for c in range(p.shape[1])], pa.array(toxic)], names=schema.names)

    return kept.mapInArrow(tidy(run), schema)


#: The chain over the synthetic labels: whether a text is of low quality, then whether it is toxic.
CATEGORIES = {"low_quality": ("quality", 0), "toxic": ("toxic", 1)}


def report(docs: DataFrame, labels: DataFrame, **columns: str) -> DataFrame:
    return judge(docs, fit(docs, labels, CATEGORIES, **columns), **columns)


def filter_documents(docs: DataFrame, labels: DataFrame, **columns: str) -> DataFrame:
    """`docs` without the rows that the chain calls toxic."""
    return judge(docs, fit(docs, labels, CATEGORIES, **columns), keep_columns=True, **columns)

"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment of words.

The benchmark is a stated set of items, taken in blocks of a bounded number of n-grams; one pass over the corpus for each block, each text by itself.
A text's words are aligned with an item (match 2, mismatch -1, gap -1) where enough of the item's word pairs stand near one another, and
the item is reported where the local score reaches `threshold` of the item's own score. How many pairs are enough, and how near, follows
from the threshold and the costs alone (see `Items`): a range left out can't reach the threshold, so the result is that of
aligning every text with every item, whatever the size of the corpus and however often an item or a pair stands in it.

Candidates come from an item's rarest seeds only: an alignment that reaches the threshold holds `least` of an item's g seeds, so one of any g - least + 1 of them is among these; the rarest are those
that the fewest places of the benchmark share, which is what a hit costs. The other seeds are looked up for candidates alone. How rare a seed is changes what is looked up, not what is found.

Seeds that lie on near diagonals share one window, so a text costs as much as its seeds span. A text of any length is hashed whole.

Defined cases: null or empty texts and items have no seeds. An item of fewer than `k` words is one seed as a whole sequence and must be found
word for word. Repeated items are aligned each. A text row that repeats is reported for each row. Further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels
from ._common import LOCATOR, Stage, pick, settled, small_batches, tidy, with_locator

MATCH, MISMATCH, GAP = 2, -1, -1
#: n-grams of one benchmark block: what is sent to every task is at most about 24 bytes for each.
BLOCK_GRAMS = 200_000
#: Words of the corpus whose seeds are looked up at once.
PIECE = 16_384
#: Places of items that the seeds of such a piece can have before it is halved.
PAIRS = 1_000_000


def smith_waterman(item: np.ndarray, window: np.ndarray) -> tuple[int, int]:
    """The best local score of two sequences of word hashes, and where in the window it ends.

    Row by row; within a row a gap costs GAP a step, so the running maximum of score plus distance gives it at once.
    """
    m = len(window)
    if not m or not len(item):
        return 0, 0
    ramp = np.arange(m, dtype=np.int32) * -GAP
    row = np.zeros(m + 1, np.int32)
    best, end = 0, 0
    for w in item:
        diagonal = row[:-1] + np.where(window == w, MATCH, MISMATCH).astype(np.int32)
        up = np.maximum(np.maximum(diagonal, row[1:] + GAP), 0)
        across = np.maximum.accumulate(up + ramp) - ramp
        row[1:] = np.maximum(up, across)
        k = int(row[1:].argmax())
        if row[k + 1] > best:
            best, end = int(row[k + 1]), k
    return best, end


class Items:
    """A block of benchmark items with the sorted seeds and the (item, place) pairs of each.

    What an alignment of an item of n words must hold to score `need`: it has m <= n matches, and each gap or mismatch that parts two runs of them costs one
    at least, so it has need - m - 1 pairs of neighbouring matches or more. `least` of these are sure: an item's word pairs are its seeds where this
    is one or more, else its single words, of which need / MATCH must match.
    """

    def __init__(self, ids: list, texts: list[str], k: int, threshold: float):
        self.ids, self.k = ids, k
        data, offsets = kernels.text_buffers(pa.array(texts, pa.string()))
        h, _, _, at = kernels.words(data, offsets)
        self.words = [h[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
        size = np.diff(at)
        self.need = np.maximum(np.ceil(MATCH * size * threshold - 1e-6).astype(np.int64), 1)
        self.reach = (MATCH * size - self.need) // -GAP  # words that an alignment can have between the item's, and how far its seeds' begins lie apart
        self.size = size
        pairs = self.need - size - 1
        self.least = np.where(pairs > 0, pairs, -(-self.need // MATCH))
        self.short = [i for i, n in enumerate(size) if 0 < n < k]
        long = [i for i, n in enumerate(size) if n >= k]
        self.seeds = [s for s in (self._seeds([i for i in long if (pairs[i] > 0) == (length == 2)], length) for length in (1, 2)) if len(s[0].grams)]

    def _seeds(self, of: list[int], length: int) -> tuple[_Seeds, _Seeds]:
        """The rarest seeds of each item, as many as it takes for one of them to be in every alignment, and the others."""
        grams = [kernels.ngrams(self.words[i], length) for i in of]
        size = np.array([len(g) for g in grams], np.int64)
        all_grams = np.concatenate([*grams, np.zeros(0, np.uint64)])
        item, place = np.repeat(np.array(of, np.int64), size), np.concatenate([*map(np.arange, size), np.zeros(0, np.int64)]).astype(np.int64)
        _, which, shared = np.unique(all_grams, return_inverse=True, return_counts=True)
        order = np.lexsort((place, all_grams, shared[which], np.repeat(np.arange(len(of)), size)))
        rank = np.arange(len(order)) - np.repeat(np.cumsum(size) - size, size)
        keep = rank < np.maximum(np.repeat(size, size) - self.least[item] + 1, 1)
        rare, rest = order[keep], order[~keep]
        return tuple(_Seeds(length, all_grams[x], item[x], place[x], len(self.ids)) for x in (rare, rest))


class _Seeds:
    """Some n-grams of items with the item and place of each: sorted by n-gram, and by item with the number of its n-gram among the distinct ones."""

    def __init__(self, length: int, grams: np.ndarray, item: np.ndarray, place: np.ndarray, n_items: int):
        self.length = length
        order = np.argsort(grams, kind="stable")
        self.grams, self.item, self.place = grams[order], item[order], place[order]
        self.distinct = np.unique(self.grams)
        by_item = np.argsort(self.item, kind="stable")
        self.own_gram, self.own_place = np.searchsorted(self.distinct, self.grams[by_item]), self.place[by_item]
        self.own_start = np.searchsorted(self.item[by_item], np.arange(n_items + 1))


def _isin(sorted_values: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(len(x), bool)
    at = np.searchsorted(sorted_values, x)
    return sorted_values[np.minimum(at, len(sorted_values) - 1)] == x


def _spans(sorted_values: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each value begins among sorted ones, and how often it stands there."""
    left = np.searchsorted(sorted_values, x, "left")
    return left, np.searchsorted(sorted_values, x, "right") - left


def _each(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The places of runs that begin at `start` and are n long, one after another."""
    return np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum())


class _Filter:
    """A cheap first test: a bit for each value of the low bits."""

    def __init__(self, values: np.ndarray, bits: int = 20):
        self.values, self.mask = values, np.uint64((1 << bits) - 1)
        self.table = np.zeros(1 << bits, bool)
        self.table[values & self.mask] = True

    def find(self, x: np.ndarray) -> np.ndarray:
        maybe = np.flatnonzero(self.table[x & self.mask])
        return maybe[_isin(self.values, x[maybe])]


def _short_places(text: np.ndarray, item: np.ndarray) -> np.ndarray:
    """Where a sequence shorter than the n-gram stands in a text."""
    n = len(text) - len(item) + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    same = np.ones(n, bool)
    for i, w in enumerate(item):
        same &= text[i : i + n] == w
    return np.flatnonzero(same)


def _ranges(at: np.ndarray, overlap: int) -> Iterator[tuple[int, int]]:
    """Word ranges of about PIECE words: whole texts, or overlapping pieces of a long one."""
    first = 0
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - first <= PIECE:
            continue
        if a > first:
            yield first, a
        first = a
        while b - first > PIECE + overlap:
            yield first, first + PIECE + overlap
            first += PIECE
    if at[-1] > first:
        yield first, int(at[-1])


def _windows(h: np.ndarray, at: np.ndarray, a: int, b: int, items: Items, tests: list[tuple[_Filter, _Filter]]) -> Iterator[tuple[int, int, int, int, int]]:
    """(text, item, from, to, seeds): the word ranges in a..b that hold an item's least number of seeds and whose item would begin near one another.

    All seeds of an alignment that reaches the threshold begin within the item's reach, so it lies in one range.
    """
    found, overlap, total = [], int((items.size + items.reach).max(initial=0)), 0
    can_halve = b - a > 2 * overlap + 2

    def places(grams: np.ndarray, seeds: _Seeds, test: _Filter) -> tuple[np.ndarray, np.ndarray]:
        """Where seeds stand that don't reach over a text's end, and in which text."""
        hit = test.find(grams)
        text = np.searchsorted(at, hit + a, "right") - 1
        inside = hit + a + seeds.length <= at[text + 1]
        return hit[inside], text[inside]

    for (rare, rest), (rare_test, rest_test) in zip(items.seeds, tests, strict=True):
        grams = kernels.ngrams(h[a:b], rare.length)
        hit, text = places(grams, rare, rare_test)
        left, n = _spans(rare.grams, grams[hit])
        total += int(n.sum())
        if total > PAIRS and can_halve:
            break
        pair = _each(left, n)
        text, item = np.repeat(text, n), rare.item[pair]
        found.append((text, item, rare.place[pair], np.repeat(hit + a, n) - rare.place[pair]))
        # the other seeds of the items that a text may hold
        asked = np.unique(text * len(items.ids) + item)
        text, item = asked // len(items.ids), asked % len(items.ids)
        n = rest.own_start[item + 1] - rest.own_start[item]
        total += int(n.sum())
        if total > PAIRS and can_halve:
            break
        own = _each(rest.own_start[item], n)
        text, item = np.repeat(text, n), np.repeat(item, n)
        hit, of = places(grams, rest, rest_test) if len(own) else (own, own)
        key = of * len(rest.distinct) + np.searchsorted(rest.distinct, grams[hit])
        order = np.argsort(key, kind="stable")
        left, n = _spans(key[order], text * len(rest.distinct) + rest.own_gram[own])
        total += int(n.sum())
        if total > PAIRS and can_halve:
            break
        place = np.repeat(rest.own_place[own], n)
        found.append((np.repeat(text, n), np.repeat(item, n), place, hit[order[_each(left, n)]] + a - place))
    if total > PAIRS and can_halve:  # frequent pairs: two overlapping halves
        half = (a + b - overlap) // 2
        yield from _windows(h, at, a, half + overlap, items, tests)
        yield from _windows(h, at, half, b, items, tests)
        return
    if not found:
        return
    text, item, place, begin = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((begin, item, text))
    text, item, place, begin = text[order], item[order], place[order], begin[order]
    first = np.arange(len(order))
    last = first + items.least[item] - 1
    first, last = first[last < len(order)], last[last < len(order)]
    near = (text[first] == text[last]) & (item[first] == item[last]) & (begin[last] - begin[first] <= items.reach[item[first]])
    first, last = first[near], last[near]
    if not len(first):
        return
    t, i = text[first], item[first]
    lo = np.maximum(begin[last] - items.reach[i], np.maximum(at[t], a))
    hi = np.minimum(begin[first] + items.size[i] + items.reach[i], np.minimum(at[t + 1], b))
    new = np.flatnonzero(np.concatenate([[True], (t[1:] != t[:-1]) | (i[1:] != i[:-1]) | (lo[1:] > hi[:-1])]))
    end = np.append(new[1:], len(first)) - 1
    for x, y in zip(new.tolist(), end.tolist(), strict=True):
        yield int(t[x]), int(i[x]), int(lo[x]), int(hi[y]), len(np.unique(place[first[x] : last[y] + 1]))


def _aligned(rows: DataFrame, items: Items, id_type: T.DataType, item_type: T.DataType) -> DataFrame:
    schema = T.StructType([T.StructField("loc", T.StringType()), T.StructField("id", id_type), T.StructField("item", item_type), T.StructField("score", T.DoubleType()), T.StructField("start_word", T.LongType()), T.StructField("end_word", T.LongType())])

    overlap = int((items.size + items.reach).max(initial=0))

    def align(h: np.ndarray, at: np.ndarray, tests: list[tuple[_Filter, _Filter]]) -> Iterator[tuple[int, int, float, int, int]]:
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for piece in _ranges(at, overlap):
            for r, i, a, b, seeds in _windows(h, at, *piece, items, tests):
                words, need, size = items.words[i], int(items.need[i]), int(items.size[i])
                step = 8 * size + 4096
                for lo in range(a, b, step):  # long runs of seeds go in overlapping pieces
                    window = h[lo : min(b, lo + step + size + int(items.reach[i]))]
                    same = int(_isin(np.sort(window), words).sum())
                    if MATCH * same < need or (need > size + 1 and same + seeds + 1 < need):
                        continue
                    score, end = smith_waterman(words, window)
                    if score >= need:
                        lo_ = lo - int(at[r])
                        best[r, i] = max(best.get((r, i), (0, 0, 0)), (score, lo_, lo_ + end + 1))
        for (r, i), (score, lo, end) in best.items():
            size = int(items.size[i])
            yield r, i, score / (MATCH * size), max(lo, end - size), end
        for i in items.short:
            for r in range(len(at) - 1):
                for p in _short_places(h[at[r] : at[r + 1]], items.words[i])[:1].tolist():
                    yield r, i, 1.0, p, p + len(items.words[i])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests = [(_Filter(rare.distinct), _Filter(rest.distinct)) for rare, rest in items.seeds]
        for batch in batches:
            data, offsets = kernels.text_buffers(batch.column(2))
            h, _, _, at = kernels.words(data, offsets)
            found = list(align(h, at, tests))
            take = pa.array([f[0] for f in found], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array([items.ids[f[1]] for f in found], item_arrow), *[pa.array([f[c] for f in found], t) for c, t in ((2, pa.float64()), (3, pa.int64()), (4, pa.int64()))]], names=["loc", "id", "item", "score", "start_word", "end_word"])

    from pyspark.sql.pandas.types import to_arrow_type

    item_arrow = to_arrow_type(item_type)
    return rows.select("loc", "id", "text").mapInArrow(tidy(run), schema)


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, k: int, threshold: float) -> Iterator[Items]:
    """The benchmark in blocks, read one partition after another: a block is all that the driver holds."""
    ids, texts, grams = [], [], 0
    for r in benchmark.select(pick(benchmark, item_col).alias("i"), pick(benchmark, text_col).cast("string").alias("t")).toLocalIterator():
        n = len((r.t or "").encode().split())
        if ids and grams + n > BLOCK_GRAMS:
            yield Items(ids, texts, k, threshold)
            ids, texts, grams = [], [], 0
        ids.append(r.i)
        texts.append(r.t or "")
        grams += n
    if ids:
        yield Items(ids, texts, k, threshold)


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", k: int = 4, threshold: float = 0.6) -> DataFrame:
    """A row for each text and item that it holds: locator, id, item, score (1: word for word), and its place in words."""
    spark = docs.sparkSession
    small_batches(spark)
    stage = Stage(spark, "decontaminate")
    key = pick(docs, id_col)
    placed = with_locator(docs, [key.alias("id"), pick(docs, text_col).cast("string").alias("text")], stage).withColumnRenamed(LOCATOR, "loc")
    item_type = benchmark.schema[item_col].dataType
    out = None
    for b, items in enumerate(_blocks(benchmark, item_col, item_text_col, k, threshold)):
        got = stage.write(f"found-{b}", _aligned(placed, items, key_type(docs, id_col), item_type))
        out = got if out is None else out.unionByName(got)
    if out is None:
        schema = T.StructType([T.StructField("loc", T.StringType()), T.StructField("id", key_type(docs, id_col)), T.StructField("item", item_type), T.StructField("score", T.DoubleType()), T.StructField("start_word", T.LongType()), T.StructField("end_word", T.LongType())])
        out = spark.createDataFrame([], schema)
    return out


def key_type(docs: DataFrame, id_col: str) -> T.DataType:
    return docs.schema[id_col].dataType


def report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", item_col: str = "item_id", **how) -> DataFrame:
    """id, item, score and place of each contaminated text."""
    found = contaminated(docs, benchmark, id_col=id_col, item_col=item_col, **how)
    return found.select(F.col("id").alias(id_col), F.col("item").alias(item_col), F.round("score", 6).alias("score"), "start_word", "end_word")


def filter_documents(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """`docs` without the rows that hold a benchmark item."""
    docs = settled(docs)
    found = contaminated(docs, benchmark, **how).select(F.col("loc").alias(LOCATOR)).distinct()
    placed = with_locator(docs)
    return placed.join(found, LOCATOR, "left_anti").select(*[pick(placed, c) for c in docs.columns])

"""Hard negatives for every anchor and positive: inverted lists of k-means with their radii, visited by the Cauchy-Schwarz bound.

Vectors are quantised to whole numbers (floor(256 x)), so scores are exact. k-means is fitted on a bounded sample; then every row goes to the list of its nearest centroid, and a list
keeps its radius, the largest distance of a member to the centroid. By Cauchy-Schwarz a member x scores at most q.c + |q| r and at least q.c - |q| r with anchor q.
A search has score windows, one for positives (open) and one for each positive (its negatives'): lists whose bounds lie outside all windows are skipped; an anchor visits
its PROBE lists of the largest bound first; the k-th score found there then stops all lists whose bound is strictly below it. Those that are left are visited, so results are exact.

How it is spread: rows are packed where they are read into parts of PART rows of one list at most, so vectors are shuffled as parts, never as rows; anchors are packed into blocks
by the list they visit; block and part meet by their list in an equi-join that adaptive execution splits where a list holds much of the table, and each pair is
one matrix product whose first k for each anchor go on. The driver holds the sample, the centroids and a radius and size for each list. A table of anchors is never sent to all tasks.

Defined cases: rows with a null label, vector or id, or a component that is null, not finite or so large that its 256-fold is not, take no part. Vectors of different lengths are
compared as if the shorter ended in zeros; an empty vector scores 0. Repeated rows of an id stay as they are, but none of them is a positive or negative of their own id, and an id
is an anchor once (by its smallest label, then vector). Equal scores go by the smaller id. Scores beyond 64 bits are held at its ends.
An anchor without positives, or a positive without negatives, has no rows. Empty input, empty result. Further columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import Stage, pick, small_batches, tidy

#: Inverted lists; rows that k-means is fitted on, those of the smallest hashes; its rounds.
LISTS, SAMPLE, ROUNDS = 64, 16_384, 10
#: Rows in a part of a list; anchors in a block; lists that an anchor visits before the k-th score is known.
PART, BLOCK, PROBE = 4096, 512, 4
SCALE = 256.0
_END = (1 << 63) - 1
_PACKED = "list int, n int, width int, kind string, ids binary, labels binary, mat binary"


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The quantised vectors of a list column, ended by zeros where they are shorter, and which rows take part."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.asarray(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), np.int64)
    flat = np.asarray(column.flatten().cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False))
    row = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out = np.zeros((len(sizes), int(sizes.max(initial=0))))
    with np.errstate(over="ignore", invalid="ignore"):
        out[row, at] = np.floor(flat * SCALE)
    used = np.asarray(column.is_valid().to_numpy(zero_copy_only=False), bool) & np.isfinite(out).all(axis=1)
    return out, used


def _wide(m: np.ndarray, width: int) -> np.ndarray:
    return m if m.shape[1] >= width else np.pad(m, ((0, 0), (0, width - m.shape[1])))


def _pack(m: np.ndarray) -> tuple[str, bytes]:
    most = np.abs(m).max(initial=0)
    kind = "<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<f8"
    return kind, m.astype(kind).tobytes()


def _unpack(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    m = np.frombuffer(row["mat"], row["kind"]).reshape(row["n"], row["width"]).astype(np.float64)
    return np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["labels"], "<i8"), m


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products."""
    width = max(a.shape[1], b.shape[1])
    a, b = _wide(a, width), _wide(b, width)
    if np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * max(width, 1) < 2.0**53:
        return (a @ b.T).astype(np.int64)
    whole = lambda m: np.array([[int(x) for x in r] for r in m], object).reshape(m.shape)
    return np.clip(whole(a) @ whole(b).T, -_END, _END).astype(np.int64)


def fit(sample: np.ndarray, lists: int = LISTS, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids of k-means that starts from rows spread over the sample."""
    sample = np.unique(sample, axis=0) if len(sample) else sample
    centres = sample[np.linspace(0, len(sample) - 1, min(lists, len(sample))).astype(int)] if len(sample) else np.zeros((1, 0))
    for _ in range(rounds if len(sample) else 0):
        near = _distances(sample, centres).argmin(axis=1)
        n = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def _distances(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    width = max(rows.shape[1], centres.shape[1])
    rows, centres = _wide(rows, width), _wide(centres, width)
    return np.maximum((rows**2).sum(1)[:, None] - 2 * (rows @ centres.T) + (centres**2).sum(1), 0)


def _reader(lists: np.ndarray, part: int):
    """Rows of id, label and vector as parts of the list of their nearest centroid, each with its radius."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def emit(k: int) -> pa.RecordBatch:
            ids, labels, mats = zip(*held.pop(k), strict=True)
            width = max(m.shape[1] for m in mats)
            m = np.concatenate([_wide(x, width) for x in mats])
            width = max(width, lists.shape[1])
            # by differences and not by squares of sums: a radius must not come out too small
            far = np.sqrt(((_wide(m, width) - _wide(lists[k : k + 1], width)) ** 2).sum(1)).max()
            kind, mat = _pack(m)
            row = {"list": k, "n": len(m), "width": m.shape[1], "kind": kind, "ids": np.concatenate(ids).tobytes(), "labels": np.concatenate(labels).tobytes(), "mat": mat, "radius": float(far) * (1 + 1e-9)}
            return pa.RecordBatch.from_pylist([row], schema=PARTS)

        for batch in batches:
            m, used = _matrix(batch["vector"])
            ids, labels = (np.asarray(batch[c])[used].astype("<i8") for c in ("id", "label"))
            m = m[used]
            near = _distances(m, lists).argmin(axis=1)
            for k in np.unique(near).tolist():
                mine = np.flatnonzero(near == k)
                for a in range(0, len(mine), part):
                    piece = mine[a : a + part]
                    if sum(len(x[0]) for x in held.get(k, [])) + len(piece) > part:
                        yield emit(k)
                    held.setdefault(k, []).append((ids[piece], labels[piece], m[piece]))
        for k in sorted(held):
            yield emit(k)

    return run


PARTS = pa.schema([("list", pa.int32()), ("n", pa.int32()), ("width", pa.int32()), ("kind", pa.string()), ("ids", pa.binary()), ("labels", pa.binary()), ("mat", pa.binary()), ("radius", pa.float64())])
BLOCKS = pa.schema([("list", pa.int32()), *[(f"a_{f.name}", f.type) for f in list(PARTS)[1:-1]], ("lows", pa.binary()), ("highs", pa.binary())])


def _windows(scores: list[int] | None, kth: list[int | None] | None, low: int, high: int, count: int) -> np.ndarray:
    """Rows of lower end, upper end and the lower end raised to the k-th score known; windows that an anchor doesn't have are empty."""
    out = np.full((count, 3), _END, dtype=np.int64)
    out[:, 1] = -_END
    for j, s in enumerate([None] if scores is None else scores):
        lo, hi = (-_END, _END) if s is None else (-(-low * s // 100), high * s // 100)
        known = kth[j] if kth else None
        out[j] = lo, hi, lo if known is None else max(lo, known)
    return out


def _router(centres: np.ndarray, radii: np.ndarray, low: int, high: int, count: int, first: bool, block: int, probe: int):
    """Anchors with the scores that make their windows, as blocks for each list that they visit: first their `probe` best, then what the k-th score leaves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def emit(k: int) -> pa.RecordBatch:
            ids, labels, rows, windows = zip(*held.pop(k), strict=True)
            width = max(len(r) for r in rows)
            kind, mat = _pack(np.array([np.pad(r, (0, width - len(r))) for r in rows]).reshape(len(rows), width))
            w = np.array(windows)
            row = {"list": k, "a_n": len(rows), "a_width": width, "a_kind": kind, "a_ids": np.array(ids, "<i8").tobytes(), "a_labels": np.array(labels, "<i8").tobytes(), "a_mat": mat}
            return pa.RecordBatch.from_pylist([row | {"lows": w[:, :, 2].astype("<i8").tobytes(), "highs": w[:, :, 1].astype("<i8").tobytes()}], schema=BLOCKS)

        for batch in batches:
            m, _ = _matrix(batch["vector"])
            width = max(m.shape[1], centres.shape[1])
            to = _wide(m, width) @ _wide(centres, width).T
            spread = np.sqrt((m**2).sum(1))[:, None] * radii
            slack = 1e-9 * (np.abs(to) + spread) + 1e-6
            most, least = to + spread + slack, to - spread - slack
            scores = batch["scores"].to_pylist() if "scores" in batch.schema.names else [None] * len(m)
            kth = batch["kth"].to_pylist() if "kth" in batch.schema.names else [None] * len(m)
            for i, (own, label) in enumerate(zip(batch["id"].to_pylist(), batch["label"].to_pylist(), strict=True)):
                w = _windows(scores[i], kth[i], low, high, count)
                meets = lambda lo, i=i, w=w: ((most[i][:, None] >= w[:, lo]) & (least[i][:, None] <= w[:, 1])).any(axis=1) & (radii >= 0)
                inside = np.flatnonzero(meets(0))
                order = inside[np.argsort(-most[i][inside], kind="stable")]
                visit = order[:probe] if first else order[probe:][meets(2)[order[probe:]]]
                for k in visit.tolist():
                    held.setdefault(k, []).append((own, label, m[i], w))
                    if len(held[k]) >= block:
                        yield emit(k)
        for k in sorted(held):
            yield emit(k)

    return run


FOUND = pa.schema([("anchor", pa.int64()), ("window", pa.int32()), ("score", pa.int64()), ("id", pa.int64())])


def _visitor(same: bool, keep: int, count: int):
    """Pairs of a block of anchors and a part: for each anchor and window the part's first `keep` rows."""

    def visit(row: dict) -> pa.RecordBatch:
        ids, labels, m = _unpack(row)
        a_ids, a_labels, a = _unpack({k[2:]: v for k, v in row.items() if k.startswith("a_")})
        lows, highs = (np.frombuffer(row[c], "<i8").reshape(len(a_ids), count) for c in ("lows", "highs"))
        scores = _scores(a, m)
        fit_in = (a_labels[:, None] == labels if same else a_labels[:, None] != labels) & (a_ids[:, None] != ids)
        rows, cols = np.nonzero(fit_in & (scores >= lows.min(1)[:, None]) & (scores <= highs.max(1)[:, None]))
        got = scores[rows, cols]
        out = []
        for j in range(count):
            mine = np.flatnonzero((got >= lows[rows, j]) & (got <= highs[rows, j]))
            order = mine[np.lexsort((ids[cols[mine]], -got[mine], rows[mine]))]
            r = rows[order]
            rank = np.arange(len(r)) - np.searchsorted(r, r, "left")
            order = order[rank < keep]
            out.append((a_ids[rows[order]], np.full(len(order), j, np.int32), got[order], ids[cols[order]]))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], schema=FOUND)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield visit(batch.slice(i, 1).to_pylist()[0])

    return run


def _first(found: DataFrame, keep: int) -> DataFrame:
    order = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)


def _by_window(first: DataFrame, keep: int) -> DataFrame:
    """anchor and the array of its windows' k-th scores, null where fewer were found."""
    kth = first.where(F.col("rank") == keep).select("anchor", F.struct("window", "score").alias("s"))
    return kth.groupBy("anchor").agg(F.map_from_entries(F.collect_list("s")).alias("known"))


def mine(vectors: DataFrame, is_anchor: Column, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, lists: int = LISTS, part: int = PART, block: int = BLOCK, probe: int = PROBE) -> DataFrame:
    """For each anchor and each of its first `positives` rows of the same label, the first `negatives` rows of other labels that score low to high percent of the positive.

    The other arguments change how it is done, not what is found.
    """
    spark, stage = vectors.sparkSession, Stage(vectors.sparkSession, "negatives")
    rows = vectors.select(pick(vectors, id_col).cast("long").alias("id"), pick(vectors, label_col).cast("long").alias("label"), pick(vectors, vector_col).alias("vector"), is_anchor.alias("anchor"))
    rows = rows.where("id is not null and label is not null and vector is not null")
    drawn = rows.select("vector", F.xxhash64("id").alias("h")).orderBy("h").limit(SAMPLE).select("vector").toArrow()
    sample, used = _matrix(drawn["vector"])
    centres = fit(sample[used], lists)
    small_batches(spark, part)
    parts = stage.write("lists", rows.select("id", "label", "vector").mapInArrow(tidy(_reader(centres, part)), _PACKED + ", radius double"))
    radii = np.full(len(centres), -1.0)
    for r in parts.groupBy("list").agg(F.max("radius").alias("radius")).collect():  # LISTS rows at most
        radii[r["list"]] = r["radius"]
    finite = "forall(vector, x -> x is not null and x * 256 between -1.7976931348623157e308 and 1.7976931348623157e308)"
    one = rows.where("anchor").where(finite).groupBy("id").agg(F.min(F.struct("label", "vector")).alias("r"))
    anchors = stage.write("anchors", one.select("id", "r.label", F.expr("transform(r.vector, x -> cast(x as double))").alias("vector")))

    def search(name: str, wanted: DataFrame, same: bool, keep: int, count: int) -> DataFrame:
        """(anchor, window, score, id, rank) of the first `keep` of each window, in two rounds of visits."""

        def visits(asked: DataFrame, first: bool) -> DataFrame:
            small_batches(spark, block)
            blocks = stage.write(f"{name}-blocks-{first}", asked.mapInArrow(tidy(_router(centres, radii, low, high, count, first, block, probe)), spark_schema(BLOCKS)))
            small_batches(spark, 4)
            pairs = blocks.join(parts.drop("radius"), "list")
            found = pairs.mapInArrow(tidy(_visitor(same, keep, count)), spark_schema(FOUND))
            return stage.write(f"{name}-{first}", _first(found, keep).drop("rank"))

        found = visits(wanted, True)
        known = _by_window(_first(found, keep), keep)
        kth = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda j: F.try_element_at("known", j))
        asked = wanted.join(known, F.col("id") == F.col("anchor"), "left").withColumn("kth", F.when(F.col("known").isNotNull(), kth)).drop("anchor", "known")
        out = stage.write(f"{name}-all", _first(found.unionByName(visits(asked, False)), keep))
        stage.drop(f"{name}-True", f"{name}-False", f"{name}-blocks-True", f"{name}-blocks-False")
        return out

    best = search("positives", anchors, True, positives, 1)
    by_anchor = best.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("rank", "score", "id"))).alias("p"))
    wanted = anchors.join(by_anchor.withColumnRenamed("anchor", "of"), F.col("id") == F.col("of")).select("id", "label", "vector", F.col("p.score").alias("scores"), F.col("p.id").alias("positives"))
    wanted = stage.write("wanted", wanted)
    hard = search("negatives", wanted.drop("positives"), False, negatives, positives)
    named = wanted.select(F.col("id").alias("anchor"), F.posexplode(F.arrays_zip("positives", "scores")).alias("window", "p"))
    out = hard.join(named, ["anchor", "window"])
    return out.select(F.col("anchor").alias("anchor_id"), F.col("p.positives").alias("positive_id"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), F.col("p.scores").alias("positive_score"), F.col("score").alias("negative_score"))


def spark_schema(schema: pa.Schema) -> str:
    names = {"int32": "int", "int64": "long", "string": "string", "binary": "binary", "double": "double"}
    return ", ".join(f"{f.name} {names[str(f.type)]}" for f in schema)


MINE_SQL = r"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, o.vec_id AS other, a.label = o.label AS same, list_dot_product(a.q, o.q)::BIGINT AS score
  FROM v a, v o WHERE a.vec_id % 100 = 0 AND a.vec_id <> o.vec_id),
positives AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER w)::INT AS rank, other AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) QUALIFY row_number() OVER w <= 10
"""

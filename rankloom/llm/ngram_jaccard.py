"""N-gram Jaccard join: classes of texts whose shingle sets are near.

Sets are sorted arrays of 64-bit shingle hashes; texts with the same set are one node. Sizes fall into bands, and two sets of a
band (or of adjoining ones) that reach the threshold differ in at most d elements. A band cuts sets by hash range into somewhat more than d parts, so at
most d parts of such a pair are not identical: with all parts put in one order, the first d + 1 of either set hold one that both have. The digests of these
first parts, with the band, name the tiles where sets meet. Parts of many elements come first, parts that very many sets share (`_frequent`) last, so
that a passage in very many texts makes a large tile only for sets that have little else.

In a tile every member is screened against the least one, and the nearest of these is counted; tiles whose members then still lie in several
components are dealt into blocks of bounded size, and the blocks' pairs of different components are screened. A screen compares hashed bitmaps, as wide as
their sets are large: bits that differ bound the difference from below, hence the overlap from above. What is left is counted exactly on the sorted arrays. Links
go to components.

No pair that reaches the threshold between nodes of different components is left out, no group goes to one task whole, and links
within a component need not all be made: the result is each row's component.

Defined cases: null and empty texts, and texts of white space only, have no shingles and are linked with nothing. Fewer words than a shingle make one
shingle. Rows that repeat (whole rows, ids, texts) are one node, with the least id as class. Very long texts are one set each, whole. An empty table has an
empty result. Further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels
from ._common import LOCATOR, Stage, may_be_in, pick, settled, small_batches, tidy, with_locator
from .components import components
from .exact_dedup import drop_rows

BLOCK = 512
#: Keys that a task gathers before it sums or sends them.
GATHER = 1 << 21
#: How many parts may be known as frequent. They only change the order of parts, not what is found.
FREQUENT = 1 << 16
#: Widths of bitmaps, as powers of two of bits.
NARROW, WIDE = 6, 16


class Bands:
    """Size bands for a threshold num / den, the parts of each, and the tiles of a set."""

    def __init__(self, num: int, den: int, steps: int = 4, top: int = 1 << 40):
        self.num, self.den = num, den
        starts = [1]
        while starts[-1] < top:
            end = starts[-1]
            for _ in range(steps):
                end = end * den // num
            starts.append(end + 1)
        self.starts = np.array(starts, np.int64)
        self._edges: dict[int, np.ndarray] = {}

    def _differ(self, total: int) -> int:
        """In how many elements two sets of so many together may differ."""
        return total * (self.den - self.num) // (self.den + self.num)

    def _parts(self, s: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each band where a partner of a sorted set can be met: d, and of all parts the keys and numbers of elements."""
        n = len(s)
        band = int(np.searchsorted(self.starts, n, "right")) - 1
        largest = n * self.den // self.num
        mixed = None
        for b in (band, band + 1):
            # the larger set of a pair is in band b, so its size is at least the band's start
            if b > band and largest < self.starts[b]:
                break
            last = int(self.starts[b + 1]) - 1
            differ = self._differ(n + min(last, largest))
            if differ == 0:
                continue  # only equal sets reach the threshold
            most = self._differ(2 * last)
            if b not in self._edges:
                parts = most + most // 6 + 2
                self._edges[b] = (np.arange(1, parts, dtype=object) * (1 << 64) // parts).astype(np.uint64)
            edge = self._edges[b]
            if mixed is None:
                mixed = np.concatenate((np.zeros(1, np.uint64), np.cumsum(kernels.mix(s))))
            at = np.concatenate(([0], np.searchsorted(s, edge), [n]))
            ids = np.arange(len(edge) + 1, dtype=np.uint64) + np.uint64(b << 40)
            yield differ, kernels.mix(kernels.mix(np.diff(mixed[at]) + np.uint64(0x632BE59BD9B4E019)) + kernels.mix(ids)), np.diff(at)

    def every(self, s: np.ndarray) -> np.ndarray:
        """The keys of all parts that hold elements."""
        return np.concatenate([np.zeros(0, np.uint64), *[key[size > 0] for _, key, size in self._parts(s)]])

    def tiles(self, s: np.ndarray, frequent: np.ndarray) -> np.ndarray:
        """The keys of the first d + 1 parts; `frequent` (sorted) come after all others, then those with few elements."""
        out = [np.zeros(0, np.uint64)]
        for differ, key, size in self._parts(s):
            late = 15 - np.minimum(size, 15).astype(np.uint64)
            if len(frequent):
                late += np.uint64(16) * (frequent[np.minimum(np.searchsorted(frequent, key), len(frequent) - 1)] == key)
            rank = (late << np.uint64(59)) | (key >> np.uint64(5))
            out.append(key[np.argpartition(rank, differ)[: differ + 1]])
        return np.concatenate(out)

    def near(self, overlap: np.ndarray, total: np.ndarray) -> np.ndarray:
        """Whether overlap / (total - overlap) reaches the threshold; total: the sum of both sizes."""
        return overlap * self.den >= self.num * (total - overlap)


def set_hash(s: np.ndarray) -> int:
    """A node's name, equal for equal sets."""
    h = kernels.mix(np.array([kernels.mix(s).sum(dtype=np.uint64), np.bitwise_xor.reduce(s * np.uint64(0x9FB21C651E98DF25)), np.uint64(len(s))], np.uint64))
    return int(kernels.mix(h * np.array([3, 5, 7], np.uint64)).sum(dtype=np.uint64).astype(np.int64))


def bitmap(s: np.ndarray) -> bytes:
    """A bit for each element's hash, eight bits an element at least, as far as widths go."""
    width = 1 << max(NARROW, min(WIDE, (8 * len(s) - 1).bit_length()))
    bits = np.zeros(width, np.uint8)
    bits[(s * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(20)) & np.uint64(width - 1)] = 1
    return np.packbits(bits).tobytes()


def _folded(bits: list[bytes], size: int) -> np.ndarray:
    """Bitmaps of `size` bytes, or more that are folded to it, as rows of 64-bit words."""
    whole = np.frombuffer(b"".join(bits), np.uint64).reshape(len(bits), -1, size // 8)
    return np.bitwise_or.reduce(whole, axis=1)


def bits_that_differ(x: list[bytes], y: list[bytes]) -> np.ndarray:
    """Pair by pair, how many bits differ in the width of the narrower bitmap."""
    out = np.zeros(len(x), np.int64)
    wx, wy = np.array([len(v) for v in x], np.int64), np.array([len(v) for v in y], np.int64)
    for a, b in {*zip(wx.tolist(), wy.tolist(), strict=True)}:
        at = np.flatnonzero((wx == a) & (wy == b))
        w = min(a, b)
        out[at] = np.bitwise_count(_folded([x[i] for i in at], w) ^ _folded([y[i] for i in at], w)).sum(1, dtype=np.int64)
    return out


def _fresh_sets(texts: pa.Array, k: int, seen: set[int]) -> Iterator[tuple[int | None, np.ndarray, bool]]:
    """(node, set, whether this task meets it for the first time) of each text."""
    for s in kernels.shingle_sets(texts, k):
        name = set_hash(s) if len(s) else None
        fresh = name is not None and name not in seen
        if fresh:
            seen.add(name)
        yield name, s, fresh


def _text_pass(rows: DataFrame, k: int, bands: Bands) -> DataFrame:
    """Rows of two kinds. 0: a text (loc, id, a = node, b = size, bits where the task first meets the node). 1: the part with key a, b times in a task."""
    schema = T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("loc", T.StringType()), T.StructField("id", rows.schema["id"].dataType), T.StructField("bits", T.BinaryType())])
    names = [f.name for f in schema]

    def often(keys: list[np.ndarray], id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
        key, n = np.unique(np.concatenate(keys), return_counts=True) if keys else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        key, n = key[n > 2].view(np.int64), n[n > 2]
        for i in range(0, len(key), 65536):
            m = len(key[i : i + 65536])
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(m, np.int32)), pa.array(key[i : i + m]), pa.array(n[i : i + m]), pa.nulls(m, pa.string()), pa.nulls(m, id_type), pa.nulls(m, pa.binary())], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        keys, held, id_type = [], 0, None
        for batch in batches:
            id_type = batch.column(1).type
            found, sizes, bits = [], [], []
            for name, s, fresh in _fresh_sets(batch.column(2), k, seen):
                found.append(name)
                sizes.append(len(s))
                bits.append(bitmap(s) if fresh else None)
                if fresh:
                    keys.append(bands.every(s))
                    held += len(keys[-1])
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(batch.num_rows, np.int32)), pa.array(found, pa.int64()), pa.array(sizes, pa.int64()), batch.column(0), batch.column(1), pa.array(bits, pa.binary())], names=names)
            if held > GATHER:
                yield from often(keys, id_type)
                keys, held = [], 0
        yield from often(keys, id_type)

    return rows.select("loc", "id", "text").mapInArrow(tidy(run), schema)


def _frequent(found: DataFrame) -> np.ndarray:
    """The keys of the parts that most sets share, sorted: those of more than a block of sets, FREQUENT at most."""
    sums = found.where("kind = 1").groupBy("a").agg(F.sum("b").alias("n")).where(F.col("n") > BLOCK)
    top = sums.orderBy(F.desc("n"), "a").limit(FREQUENT).select("a").collect()  # 8 bytes each
    return np.sort(np.array([r.a for r in top], np.int64).view(np.uint64))


_MET = "kind int, key long, a long, b long"


def _met(kind: int, key: np.ndarray, a: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(a), 65536):
        m = len(a[i : i + 65536])
        yield pa.RecordBatch.from_arrays([pa.array(np.full(m, kind, np.int32)), pa.array(key[i : i + m]), pa.array(a[i : i + m]), pa.array(b[i : i + m])], names=["kind", "key", "a", "b"])


def _tile_pass(rows: DataFrame, k: int, bands: Bands, frequent: np.ndarray) -> DataFrame:
    """Rows of three kinds. 1: an edge a to b. 2: node a is the least that this task has seen in tile `key`, b the number of nodes seen
    there. 3: node a, another one, lies in tile b. Of kinds 1 and 3 the `key` only spreads them."""

    def flush(keys: list[np.ndarray], nodes: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if not keys:
            return
        key, node = np.concatenate(keys), np.concatenate(nodes)
        order = np.lexsort((node, key))
        key, node = key[order], node[order]
        lead = np.concatenate(([True], key[1:] != key[:-1]))
        least = node[lead][np.cumsum(lead) - 1]
        tied = ~lead & (node != least)
        count = np.diff(np.append(np.flatnonzero(lead), len(key)))
        edges = np.unique(np.stack([node[tied], least[tied]], 1), axis=0) if tied.any() else np.zeros((0, 2), np.int64)
        yield from _met(1, _spread(edges[:, 0], edges[:, 1]), edges[:, 0], edges[:, 1])
        yield from _met(2, key[lead], node[lead], count)
        yield from _met(3, _spread(node[tied], key[tied]), node[tied], key[tied])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        keys, nodes, held = [], [], 0
        for batch in batches:
            for name, s, fresh in _fresh_sets(batch.column(0), k, seen):
                if fresh:
                    got = bands.tiles(s, frequent).view(np.int64)
                    keys.append(got)
                    nodes.append(np.full(len(got), name, np.int64))
                    held += len(got)
            if held > GATHER:
                yield from flush(keys, nodes)
                keys, nodes, held = [], [], 0
        yield from flush(keys, nodes)

    return rows.select("text").mapInArrow(tidy(run), _MET)


def _spread(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return kernels.mix(x.view(np.uint64) * np.uint64(31) + y.view(np.uint64)).view(np.int64) if len(x) else np.zeros(0, np.int64)


def _lead_tiles(sent: DataFrame) -> DataFrame:
    """Kinds 1 and 3 pass; of kind 2, in each tile the nodes become edges to the least one, and members (kind 3) if there are several."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile = least = None
        told = True  # whether the tile's least node is out as a member
        for batch in batches:
            tiles = batch.column(0).to_numpy() == 2
            other = batch.filter(pa.array(~tiles))
            if other.num_rows:
                yield other
            if not tiles.any():
                continue
            own = batch.filter(pa.array(tiles))
            key, node, count = (own.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3))
            goes_on = tile is not None and key[0] == tile
            if goes_on and not told:
                yield from _met(3, np.zeros(1, np.int64), np.array([least], np.int64), np.array([tile], np.int64))
                told = True
            lead = np.concatenate(([not goes_on], key[1:] != key[:-1]))
            leads = np.concatenate((np.array([least if least is not None else 0], np.int64), node[lead]))[np.cumsum(lead)]
            followed = np.append(key[1:] == key[:-1], False)
            member = ~lead | followed | (count > 1)
            tied = node != leads
            yield from _met(1, key[tied], node[tied], leads[tied])
            yield from _met(3, key[member], node[member], key[member])
            if lead[-1]:
                told = bool(member[-1])
            elif lead.any():
                told = True
            tile, least = int(key[-1]), int(leads[-1])

    return sent.repartition("key").sortWithinPartitions("key", "a").mapInArrow(tidy(run), _MET).select("kind", "a", "b")


def _screen(pairs: DataFrame, bands: Bands) -> DataFrame:
    """(a, b, an, bn, abits, bbits) to the (a, b, differ) that the bitmaps let reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, an, bn = (batch.column(i).to_numpy() for i in range(4))
            differ = bits_that_differ(batch.column(4).to_pylist(), batch.column(5).to_pylist())
            overlap = np.minimum((an + bn - differ) // 2, np.minimum(an, bn))
            ok = bands.near(overlap, an + bn)
            yield pa.RecordBatch.from_arrays([pa.array(a[ok]), pa.array(b[ok]), pa.array(differ[ok])], names=["a", "b", "differ"])

    return pairs.select("a", "b", "an", "bn", "abits", "bbits").mapInArrow(tidy(run), "a long, b long, differ long")


def _verified(pairs: DataFrame, nodes: DataFrame, placed: DataFrame, k: int, bands: Bands, stage: Stage, name: str) -> DataFrame:
    """Those pairs (a, b) that reach the threshold, by the sorted arrays of their texts, which are read again for these nodes only.

    The texts of all a of one b meet b's, in parts of about BLOCK members; each member's text is sent once a pair and b's once a part. A hashed bitmap keeps all other texts in their scan.
    """
    parts = pairs.groupBy("b").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    members = pairs.join(parts, "b").select("b", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("role"), F.col("a").alias("node"))
    heads = parts.select("b", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("role"), F.col("b").alias("node"))
    sent = stage.write(f"sent-{name}", members.unionByName(heads).join(nodes.select("node", "loc"), "node").select("loc", "b", "part", "role", "node"))
    texts = may_be_in(placed.select("loc", "text"), "loc", sent, stage, f"filter-{name}").where("__may").drop("__may")
    sent = texts.join(sent, "loc").select("b", "part", "role", "node", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = np.zeros(0, np.uint64)
        for batch in batches:
            keep = []
            for role, s in zip(batch.column(2).to_pylist(), kernels.shingle_sets(batch.column(4), k), strict=True):
                if role == 0:
                    head = s
                    keep.append(False)
                else:
                    at = np.searchsorted(head, s)
                    overlap = int((head[np.minimum(at, len(head) - 1)] == s).sum())
                    keep.append(bool(bands.near(overlap, len(head) + len(s))))
            ok = batch.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([ok.column(3), ok.column(0)], names=["a", "b"])

    links = stage.write(f"links-{name}", sent.repartition("b", "part").sortWithinPartitions("b", "part", "role").mapInArrow(tidy(run), "a long, b long"))
    stage.drop(f"sent-{name}", f"filter-{name}")
    return links


def _across(pairs: DataFrame, comps: DataFrame) -> DataFrame:
    """Those pairs whose nodes lie in different components."""
    ca, cb = comps.toDF("a", "ca"), comps.toDF("b", "cb")
    both = pairs.join(ca, "a", "left").join(cb, "b", "left")
    return both.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).drop("ca", "cb")


def _open_members(members: DataFrame, comps: DataFrame) -> DataFrame:
    """(key, node, comp, blocks) of the tiles which their least member did not settle; of tiles with the same members only one."""
    rows = members.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    tiles = rows.groupBy("key").agg(F.count("*").alias("m"), F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.bit_xor(F.xxhash64("node")).alias("x"))
    # three members at least: the pairs with the least one are known
    tiles = tiles.where("m > 2 and c0 < c1").groupBy("m", "c0", "c1", "x").agg(F.min("key").alias("key"))
    return rows.join(tiles.select("key", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks")), "key").select("key", "node", "comp", "blocks")


def _open_pairs(open_rows: DataFrame, nodes: DataFrame, bands: Bands, nearest: bool) -> DataFrame:
    """Pairs of different components that meet in an open tile, after the bitmap screen.

    `nearest`: of each node in each block's tile only the nearest partner; a first round of these leaves few components for the whole second one.
    """
    rows = open_rows.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).join(nodes.select("node", "n", "bits"), "node")
    dealt = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "comp", "n", "bits")

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        own, i, j = table.column("own").to_numpy(), table.column("i")[0].as_py(), table.column("j")[0].as_py()
        node, comp, n, bits = table.column("node").to_numpy(), table.column("comp").to_numpy(), table.column("n").to_numpy(), table.column("bits").to_pylist()
        left = np.flatnonzero(own == i)
        right = np.flatnonzero(own == j)
        found = [np.zeros((0, 3), np.int64)]
        short = np.zeros((len(bits), min(map(len, bits)) // 8), np.uint64)
        sizes = np.array([len(v) for v in bits])
        for w in np.unique(sizes):
            at = np.flatnonzero(sizes == w)
            short[at] = _folded([bits[x] for x in at], 8 * short.shape[1])
        step = max(1, (1 << 22) // max(1, len(right) * short.shape[1]))
        for at in range(0, len(left), step):
            l = left[at : at + step]
            total = n[l][:, None] + n[right][None, :]
            differ = np.bitwise_count(short[l][:, None, :] ^ short[right][None, :, :]).sum(2, dtype=np.int64)
            overlap = np.minimum((total - differ) // 2, np.minimum(n[l][:, None], n[right][None, :]))
            ok = bands.near(overlap, total) & (comp[l][:, None] != comp[right][None, :])
            x, y = np.nonzero(ok)
            differ = bits_that_differ([bits[p] for p in l[x]], [bits[p] for p in right[y]])
            ok = bands.near((total[x, y] - differ) // 2, total[x, y])
            x, y, differ = x[ok], y[ok], differ[ok]
            if nearest:
                order = np.lexsort((y, differ, x))
                x, y, differ = x[order], y[order], differ[order]
                first = np.ones(len(x), bool)
                first[1:] = x[1:] != x[:-1]
                x, y, differ = x[first], y[first], differ[first]
            found.append(np.stack([node[l[x]], node[right[y]], differ], 1))
        both = np.concatenate(found)
        both = np.unique(np.stack([both[:, :2].max(1), both[:, :2].min(1), both[:, 2]], 1), axis=0)
        return pa.table({"a": pa.array(both[:, 0]), "b": pa.array(both[:, 1]), "differ": pa.array(both[:, 2])})

    return dealt.groupBy("key", "i", "j").applyInArrow(run, "a long, b long, differ long").distinct()


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """A row for each input row: its locator, id, n_shingles, node (the set's hash) and comp (null: linked with nothing)."""
    spark = docs.sparkSession
    small_batches(spark)
    stage, bands = Stage(spark, "jaccard"), Bands(num, den)
    placed = with_locator(docs, [pick(docs, id_col).alias("id"), pick(docs, text_col).cast("string").alias("text")], stage).withColumnRenamed(LOCATOR, "loc")
    found = stage.write("texts", _text_pass(placed, k, bands))
    met = stage.write("met", _lead_tiles(_tile_pass(placed, k, bands, _frequent(found))))
    texts = found.where("kind = 0").select("loc", "id", F.col("a").alias("node"), F.col("b").alias("n"))
    pairs = stage.write("pairs", met.where("kind = 1").select("a", "b").distinct())
    if pairs.isEmpty():
        stage.drop("met", "pairs")
        return texts.withColumn("comp", F.col("node"))
    cited = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    named = found.where("kind = 0").select(F.col("a").alias("node"), "loc", F.col("b").alias("n"), "bits").join(cited, "node", "left_semi")
    nodes = stage.write("nodes", named.groupBy("node").agg(F.min("loc").alias("loc"), F.max("n").alias("n"), F.max("bits").alias("bits")))
    small = nodes.select("node", "n", "bits")
    screened = stage.write("screened", _screen(pairs.join(small.toDF("a", "an", "abits"), "a").join(small.toDF("b", "bn", "bbits"), "b"), bands))
    stage.drop("pairs")
    # most nodes belong where their nearest least member does: that link first, and of the others those that components leave open
    known = stage.write("best", screened.groupBy("a").agg(F.min_by("b", F.struct("differ", "b")).alias("b")))
    links = _verified(known, nodes, placed, k, bands, stage, "best")
    comps = stage.write("comps", components(links, stage, "first"))
    stage.drop("links-best")
    open_rows = stage.write("open-rows", _open_members(met.where("kind = 3").select(F.col("b").alias("key"), F.col("a").alias("node")).distinct(), comps))
    left = stage.write("left", _across(screened.join(known, ["a", "b"], "left_anti"), comps))
    stage.drop("met", "screened")
    for name, nearest in (("near", True), ("open", False)):
        if not nearest:
            open_rows = _open_members(open_rows.select("key", "node"), comps)
        both = _open_pairs(open_rows, nodes, bands, nearest).unionByName(left)
        both = _across(both, comps).distinct().join(known, ["a", "b"], "left_anti")
        if nearest:  # two partners a node here, all that are still apart in the second round
            both = both.withColumn("r", F.row_number().over(Window.partitionBy("a").orderBy("differ", "b"))).where("r <= 2")
        more = stage.write(f"more-{name}", both.select("a", "b"))
        if more.isEmpty():  # a nearest partner may be one that was counted before, so the whole round still comes
            continue
        late = _verified(more, nodes, placed, k, bands, stage, name)
        if not late.isEmpty():
            both = late.union(comps.where("node <> comp").select(F.col("node").alias("a"), F.col("comp").alias("b")))
            comps = stage.write(f"comps-{name}", components(both, stage, name))
        stage.drop(f"links-{name}")
        known = known.union(more)
    stage.drop("nodes", "best", "left", "open-rows", "more-near", "more-open")
    return texts.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))


def report(docs: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """id, n_shingles, component_id (the least id reachable by links)."""
    rows = classes(docs, id_col=id_col, **how)
    least = rows.where("comp is not null").groupBy("comp").agg(F.min("id").alias("least"))
    out = rows.join(least, "comp", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), F.coalesce("least", "id").alias("component_id"))


def filter_documents(docs: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """One row of each component: the one with the least id, then locator. Rows without words stay."""
    docs = settled(docs)
    rows = classes(docs, id_col=id_col, **how)
    order = F.struct(F.col("id").isNull().alias("none"), "id", "loc")
    first = rows.where("comp is not null").groupBy("comp").agg(F.min(order)["loc"].alias("first"), F.count("*").alias("m")).where("m > 1")
    dropped = rows.join(first.select("comp", "first"), "comp").where(F.col("loc") != F.col("first")).select(F.col("loc").alias(LOCATOR))
    return drop_rows(docs, dropped, Stage(docs.sparkSession, "jaccard-rows"))

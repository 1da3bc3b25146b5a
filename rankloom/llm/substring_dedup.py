"""Passages that an earlier document already holds, by relative Lempel-Ziv parsing against blocks that the texts themselves delimit.

Every document is both reference and input. A text's windows of `window` words are cut into blocks: a block is a longest run of consecutive windows whose smallest hash of
`anchor` words (their anchor) is the same, so equal passages are cut alike wherever they stand. The index holds every block once, with the first document (by id) that has it.
A document is then parsed from left to right: a block that an earlier document has is copied whole, and blocks that follow one another make one factor, as long as
it can be; all else are literals. A factor ends inside a block where document and reference part; the two blocks then share their anchor and differ in the rest. Such blocks, and
only these, are looked up window by window, once for each different block, so that the factor's boundary is found to the word. A block spans `window` words at least, so every factor is long enough.

What is shuffled: a row a block (about one for 18 words), summed by anchor; of anchors with several documents, the blocks; of anchors with several blocks, the windows of each
block's first owner; and the texts of documents that are looked up by window or lose words (hashed bitmaps of bounded size keep the others in their scan). An anchor, block or window that a third of all documents
share is summed before it is shuffled and met in joins that adaptive execution splits; no group is gathered but a document's own spans.

Words and blocks are compared by 64-bit hashes, a block or window always by two together (its anchor's and its own).

Defined cases: a null text has no words; a text shorter than a window keeps all its words. Texts are read whole. Repeated rows of an id are judged each; an equal id is not
smaller, so they do not cut one another. A row with a null id neither loses words nor takes them from others. Words may repeat within a document: only other documents count. Empty input, empty
result. Further columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import LOCATOR, Stage, clean_text, may_be_in, pick, settled, small_batches, tidy, with_locator
from .kernels import mix, ngrams, text_buffers, words

WINDOW, ANCHOR = 50, 16
_STEP = np.uint64(0x9E3779B97F4A7C15)


class Blocks:
    """The windows of a batch of texts, their hashes, and the blocks that they make."""

    def __init__(self, texts: pa.Array, window: int, anchor: int):
        hashes, _, _, self.at = words(*text_buffers(texts), lower=False)
        grams = ngrams(hashes, anchor)
        most = max(len(hashes) - window + 1, 0)  # windows, also those that reach over a text's end
        span = window - anchor + 1
        low, reach = grams, 1
        while reach * 2 <= span:  # the smallest of the next 1, 2, 4, ... hashes
            low = np.minimum(low[:-reach], low[reach:])
            reach *= 2
        self.low = np.minimum(low[:most], low[span - reach : span - reach + most])
        self.hash = np.zeros(most, np.uint64)
        for i, start in enumerate([*range(0, span, anchor), span - 1]):  # from the hashes of `anchor` words that cover the window
            self.hash = mix(self.hash * _STEP + grams[start : start + most] + np.uint64(i))
        text = np.searchsorted(self.at, np.arange(most), "right") - 1
        whole = np.arange(most) + window <= self.at[text + 1]
        first = np.zeros(most, bool)
        if most:
            first[0] = True
            first[1:] = (self.low[1:] != self.low[:-1]) | (text[1:] != text[:-1]) | (whole[1:] != whole[:-1])
        begin = np.flatnonzero(first)
        size = np.diff(np.append(begin, most))
        within = np.arange(most, dtype=np.int64) - np.repeat(begin, size)
        mixed = mix(self.hash + within.astype(np.uint64) * _STEP)
        block = np.add.reduceat(mixed, begin) if len(begin) else np.zeros(0, np.uint64)
        keep = whole[begin]
        self.begin, self.size, self.block = begin[keep], size[keep], mix(block[keep] + size[keep].astype(np.uint64))
        self.text = text[self.begin]


def _block_rows(window: int, anchor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b = Blocks(batch["text"], window, anchor)
            own = pa.array(b.text)
            columns = [b.low[b.begin].view(np.int64), b.block.view(np.int64), b.begin - b.at[b.text], b.size.astype(np.int32)]
            yield pa.RecordBatch.from_arrays([batch["id"].take(own), batch["row"].take(own), *map(pa.array, columns)], ["id", "row", "anchor", "block", "start", "size"])

    return run


def _window_rows(window: int, anchor: int):
    """The windows of the asked blocks of a text, each a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b = Blocks(batch["text"], window, anchor)
            asked = batch["asked"]
            sizes = np.diff(np.asarray(asked.offsets))
            of = np.repeat(np.arange(batch.num_rows), sizes)
            ask = asked.flatten()
            start, size = (np.asarray(ask.field(c)).astype(np.int64) for c in ("start", "size"))
            place = np.repeat(start + b.at[of], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            of = np.repeat(of, size)
            own = pa.array(of)
            columns = [b.low[place].view(np.int64), b.hash[place].view(np.int64), place - b.at[of]]
            yield pa.RecordBatch.from_arrays([batch["id"].take(own), batch["row"].take(own), *map(pa.array, columns)], ["id", "row", "anchor", "hash", "start"])

    return run


def factors(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The greedy parse: copies that touch or overlap, from left to right, are one factor."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], b)
        else:
            out.append((a, b))
    return out


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    for batch in batches:
        data, offsets = text_buffers(batch["text"])
        raw, ends = memoryview(np.ascontiguousarray(data)), offsets.tolist()
        counts, texts, found = [], [], []
        for a, b, spans in zip(ends, ends[1:], batch["spans"].to_pylist(), strict=False):
            own = bytes(raw[a:b]).split()  # at ASCII white space
            cut = factors([(s["start"], s["stop"]) for s in spans or ()])
            counts.append(len(own))
            for start, stop in reversed(cut):
                del own[start:stop]
            texts.append(b" ".join(own))
            found.append([{"start": x, "stop": y} for x, y in cut])
        removed = [sum(s["stop"] - s["start"] for s in f) for f in found]
        yield pa.RecordBatch.from_arrays([batch["id"], pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(found, kind)], ["id", "n_words", "n_removed", "kept", "factors"])


def parse(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """For each row: its id, n_words, n_removed, kept (the words that are left, one space between) and factors (start and stop of each passage taken out, in words)."""
    spark, stage = docs.sparkSession, Stage(docs.sparkSession, "passages")
    docs = settled(docs)
    small_batches(spark)
    placed = with_locator(docs, [pick(docs, id_col).alias("id"), clean_text(pick(docs, text_col)).alias("text")]).select("id", F.xxhash64(LOCATOR).alias("row"), "text")
    kind = dict(placed.dtypes)["id"]
    named = placed.where("id is not null")
    blocks = stage.write("blocks", named.mapInArrow(tidy(_block_rows(window, anchor)), f"id {kind}, row long, anchor long, block long, start long, size int"))
    several = stage.write("anchors", blocks.groupBy("anchor").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a < b").select("anchor"))
    shared = may_be_in(blocks, "anchor", several, stage, "anchor-filter").where("__may").drop("__may").join(several, "anchor")
    shared = stage.write("shared", shared)
    stage.drop("blocks", "anchors", "anchor-filter")
    index = stage.write("index", shared.groupBy("anchor", "block").agg(F.min("id").alias("first")))  # every block once, with its first owner
    # written: only joins of two plain shuffles are split where a key is hot
    parted = stage.write("contested", index.groupBy("anchor").agg(F.min("first").alias("a"), F.max("first").alias("b")).where("a < b").select("anchor", F.lit(True).alias("parted")))
    index = stage.write("parted", index.join(parted, "anchor", "left").select("anchor", "block", "first", F.coalesce("parted", F.lit(False)).alias("parted")))
    looked = stage.write("looked", shared.join(index, ["anchor", "block"]).where("id > first or parted").select("id", "row", "start", "size", (F.col("id") > F.col("first")).alias("copied")))
    stage.drop("shared", "index", "contested", "parted")
    copied = looked.where("copied").select("id", "row", "start", (F.col("start") + F.col("size") + (window - 1)).alias("stop"))
    asked = stage.write("asked", looked.where("not copied").groupBy("id", "row").agg(F.collect_list(F.struct("start", "size")).alias("asked")))  # a document's own blocks
    texts = may_be_in(named, "row", asked.select("row"), stage, "asked-filter").where("__may").drop("__may").join(asked, ["id", "row"])
    windows = stage.write("windows", texts.mapInArrow(tidy(_window_rows(window, anchor)), f"id {kind}, row long, anchor long, hash long, start long"))
    stage.drop("asked", "asked-filter")
    firsts = stage.write("firsts", windows.groupBy("anchor", "hash").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last"))
    edges = windows.join(firsts, ["anchor", "hash"]).where("id > first").select("id", "row", "start", (F.col("start") + window).alias("stop"))
    spans = stage.write("spans", copied.unionByName(edges).groupBy("id", "row").agg(F.collect_list(F.struct("start", "stop")).alias("spans")))
    stage.drop("looked", "windows", "firsts")
    rows = may_be_in(placed, "row", spans.select("row"), stage, "span-filter")
    cut = rows.where("__may").drop("__may").join(spans, ["id", "row"], "left")
    rest = rows.where("not __may").drop("__may").withColumn("spans", F.lit(None).cast(dict(spans.dtypes)["spans"]))
    schema = f"id {kind}, n_words long, n_removed long, kept string, factors array<struct<start: long, stop: long>>"
    return cut.unionByName(rest).mapInArrow(tidy(_parsed), schema).withColumnRenamed("id", id_col)


def report(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    return parse(docs, id_col, **options).select(id_col, "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


REPORT_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
places AS (SELECT rid, doc_id, words, unnest(generate_series(1, len(words) - 49)) AS i FROM d),
windows AS (SELECT rid, doc_id, i, md5(array_to_string(words[i:i + 49], ' ')) AS h FROM places),
firsts AS (SELECT h, min(doc_id) AS f, max(doc_id) AS l FROM windows GROUP BY h HAVING f < l),
covered AS (SELECT DISTINCT rid, unnest(generate_series(i, i + 49)) AS p FROM windows JOIN firsts USING (h) WHERE doc_id > f),
each AS (SELECT rid, unnest(generate_series(1, len(words))) AS p, unnest(words) AS word FROM d),
kept AS (SELECT rid, string_agg(word, ' ' ORDER BY p) AS body, count(*) AS n FROM each ANTI JOIN covered USING (rid, p) GROUP BY rid)
SELECT doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(body, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (rid)
"""

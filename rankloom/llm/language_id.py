"""Language identification by compression: the language whose dictionary shrinks a text most.

`fit` draws a bounded sample of labelled texts and makes one zstandard raw-content dictionary a language. `predict`
compresses each whole text, block by block, against every dictionary and takes the smallest sum; a narrow margin
to the runner-up is marked as rejected. Map-only: no row meets another.

Defined cases: a text that is null or has no letter is `und` with score 0, as is any text if no language was learned.
Equal sums go to the first language by name. An id that is null is neither learned from nor held out. Repeated rows are judged
one by one; an empty table has an empty result; further columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import pick, small_batches, tidy

UNKNOWN = "und"


def held_out(id_column: Column, folds: int = 5) -> Column:
    """Whether a row belongs to the fold that is never learned from."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % folds == 0, F.lit(False))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs_per_lang: int = 400, snippet: int = 600) -> dict[str, bytes]:
    """A dictionary a language: of `docs_per_lang` texts drawn by hash (all, where there are fewer) a window of `snippet` characters each, whole, anywhere in the text by another hash."""
    key, text, lang = pick(docs, id_col), pick(docs, text_col), pick(docs, lang_col).cast("string")
    usable = lang.isNotNull() & key.isNotNull() & ~held_out(key) & text.rlike(r"\p{L}")
    rows = docs.where(usable).select(key.cast("string").alias("k"), text.cast("string").alias("t"), lang.alias("l"))
    counts = {r.l: r.n for r in rows.groupBy("l").agg(F.count("*").alias("n")).collect()}  # a row a language
    if not counts:
        return {}
    hashed = lambda at: F.conv(F.substring(F.md5("k"), at, 8), 16, 10).cast("double") / float(1 << 32)
    u, place = hashed(1), hashed(9)  # whether a text is drawn says nothing of where its window lies
    rate = F.create_map(*[F.lit(x) for l, n in counts.items() for x in (l, min(1.0, 1.5 * docs_per_lang / n))])
    start = F.floor(place * F.greatest(F.length("t") - snippet, F.lit(0))).cast("int") + 1
    drawn = rows.where(u < rate[F.col("l")]).select("l", u.alias("u"), "k", F.substring("t", start, F.lit(snippet)).alias("s"))
    parts: dict[str, list[bytes]] = {}
    for r in sorted(drawn.collect(), key=lambda r: (r.l, r.u, r.k, r.s)):  # languages x 1.5 docs_per_lang windows, bounded by the parameters
        parts.setdefault(r.l, []).append(r.s.encode())
    return {l: b"\n".join(p[:docs_per_lang]) for l, p in sorted(parts.items())}


class Classifier:
    """Compressed sizes of a text against each dictionary."""

    def __init__(self, dictionaries: dict[str, bytes], level: int = 3, block: int = 4096):
        import zstandard as z

        self.block, self.coders = block, []
        for name, raw in sorted(dictionaries.items()):
            d = z.ZstdCompressionDict(raw or b"\n", dict_type=z.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            self.coders.append((name, z.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress))

    def sizes(self, text: bytes) -> list[tuple[int, str]]:
        blocks = [text[i : i + self.block] for i in range(0, len(text), self.block)]
        return [(sum(len(f(b)) for b in blocks), name) for name, f in self.coders]

    def best(self, text: bytes) -> tuple[str, float]:
        """The language and the margin to the runner-up as a share of its size."""
        ranked = sorted(self.sizes(text))
        if not ranked:
            return UNKNOWN, 0.0
        next_best = ranked[1][0] if len(ranked) > 1 else max(ranked[0][0], len(text))
        return ranked[0][1], max(0.0, 1.0 - ranked[0][0] / next_best)


def predict(docs: DataFrame, dictionaries: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text", min_margin: float = 0.01, folds: int = 5) -> DataFrame:
    """id, held_out, lang_pred, score (the margin, 0 to 1), rejected (whether the margin is under `min_margin`)."""
    small_batches(docs.sparkSession)
    key, text = pick(docs, id_col), pick(docs, text_col).cast("string")
    rows = docs.select(key.alias(id_col), held_out(key, folds).alias("held_out"), F.when(text.rlike(r"\p{L}"), text).alias("__text"))
    schema = T.StructType([rows.schema[id_col], T.StructField("held_out", T.BooleanType()), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Classifier(dictionaries)
        for batch in batches:
            found = [model.best(t.as_buffer().to_pybytes()) if t.is_valid else (UNKNOWN, 0.0) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array([f[1] < min_margin or f[0] == UNKNOWN for f in found], pa.bool_())], names=[id_col, "held_out", "lang_pred", "score", "rejected"])

    return rows.mapInArrow(tidy(judge), schema)


def identify(docs: DataFrame, **columns: str) -> DataFrame:
    """Learn from the folds that are not held out and judge every row."""
    return predict(docs, fit(docs, **columns), **{k: v for k, v in columns.items() if k != "lang_col"})

"""Secret scanning with multipart linking.

Base spans are credentials that stand on their own. The method adds what is only suspicious by itself: an opaque token or an endpoint.
Within a scope (so many characters round it) such a weak candidate is reported if a complementary part lies there: an opaque token
beside an access identifier or an endpoint, an endpoint beside a secret. Candidates and parts are joined as intervals
of one text, by bisection in sorted starts and ends, so a text with many parts costs n log n and emits no pairs. Map-only.

Defined cases: a null text is empty and has no spans. Spans are in code points, end exclusive; equal starts are ordered by kind as listed
in KINDS, then by end. A very long text is scanned whole. Repeated rows are scanned one by one; an empty table has an empty result; further columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ._common import pick, small_batches, tidy

KINDS = ("assign", "access", "hex", "opaque", "endpoint")
BASE = KINDS[:3]
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_OPAQUE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
_ENDPOINT = re.compile(r"(?:https?|s3|postgres|mysql|mongodb|redis|amqp)://[^\s\"'<>]{3,}", re.A)
_DIGIT, _UPPER, _LOWER = re.compile(r"[0-9]"), re.compile(r"[A-Z]"), re.compile(r"[a-z]")

Span = tuple[int, int, str]


def base_spans(text: str) -> list[Span]:
    found = [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    found += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text)]
    return found + [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]


def _near(starts: list[int], ends: list[int], a: int, b: int, scope: int) -> bool:
    """Whether of spans with these starts and ends, each sorted, one begins at b to `scope` after it or ends at a to `scope` before it."""
    k, j = bisect_left(starts, b), bisect_left(ends, a - scope)
    return (k < len(starts) and starts[k] <= b + scope) or (j < len(ends) and ends[j] <= a)


def _merged(spans: list[Span]) -> tuple[list[int], list[int]]:
    """Starts and ends of the disjoint intervals that spans cover."""
    starts, ends = [], []
    for a, b, _ in sorted(spans):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def linked_spans(text: str, base: list[Span], scope: int = 400) -> list[Span]:
    """Weak candidates with a complementary part in their scope."""
    endpoints = [(m.start(), m.end(), "endpoint") for m in _ENDPOINT.finditer(text)]
    identifiers = [s for s in base if s[2] == "access"]
    secrets = [s for s in base if s[2] != "access"]
    if not endpoints and not identifiers:
        return []
    starts, ends = _merged(base + endpoints)
    opaque = []
    for m in _OPAQUE.finditer(text):
        a, b = m.span()
        w = m.group()
        if not (_DIGIT.search(w) and (_UPPER.search(w) or _LOWER.search(w))):
            continue
        k = bisect_left(starts, b)  # the last interval that begins before b is the one that reaches furthest
        if not k or ends[k - 1] <= a:
            opaque.append((a, b, "opaque"))

    def join(candidates: list[Span], parts: list[Span]) -> list[Span]:
        at, to = sorted(p[0] for p in parts), sorted(p[1] for p in parts)
        return [c for c in candidates if _near(at, to, c[0], c[1], scope)]

    linked = join(opaque, identifiers + endpoints)
    return linked + join(endpoints, secrets + linked)


def listed(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1])))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = 400) -> DataFrame:
    """A row for each text: counts of the base kinds, the base spans' digest, all spans."""
    small_batches(docs.sparkSession)
    rows = docs.select(pick(docs, id_col).alias(id_col), pick(docs, text_col).cast("string").alias("__text"))
    names = ["n_assign", "n_access", "n_hex"]
    schema = T.StructType([rows.schema[id_col], *[T.StructField(n, T.LongType()) for n in names], T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, spans = [[], [], []], [], []
            for t in batch.column(1):
                text = t.as_py() or ""
                base = base_spans(text)
                for c, kind in zip(counts, BASE, strict=True):
                    c.append(sum(s[2] == kind for s in base))
                digests.append(hashlib.sha256(listed(base).encode()).hexdigest())
                spans.append(listed(base + linked_spans(text, base, scope)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in counts], pa.array(digests, pa.string()), pa.array(spans, pa.string())], names=[id_col, *names, "base_sha256", "spans"])

    return rows.mapInArrow(tidy(run), schema)

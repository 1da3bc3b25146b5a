"""Unicode forms, which Spark SQL lacks: Arrow-batched."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, StringType


@pandas_udf(StringType())
def nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


@pandas_udf(StringType())
def nfkd(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else unicodedata.normalize("NFKD", t))


_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)?")


@pandas_udf(ArrayType(StringType()))
def word_runs(s: pd.Series, most: pd.Series) -> pd.Series:
    """The composed runs of up to so many words, joined by underscores, each once and in order."""

    def runs(text: str | None, n: int) -> list[str]:
        words = [re.sub(r"['’]s$", "", w, flags=re.I) for w in _WORD.findall(text or "")]
        return sorted({unicodedata.normalize("NFC", "_".join(words[i:j])) for i in range(len(words)) for j in range(i + 1, min(i + n, len(words)) + 1)})

    return pd.Series([runs(t, n) for t, n in zip(s, most, strict=True)], dtype=object)

"""Sequence similarity: the share of matching blocks, which no built-in function gives (an edit distance is another measure)."""

from __future__ import annotations

import re
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructType

WORDS = re.compile(r"\w+")


def ratio(a: str | None, b: str | None) -> float:
    """0 for an empty side, 1 for texts equal but for case and outer blanks, otherwise the matching-blocks ratio."""
    if not a or not b:
        return 0.0
    if a.lower().strip() == b.lower().strip():
        return 1.0
    return SequenceMatcher(None, a, b).ratio()


@F.pandas_udf(DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    cache: dict = {}
    return pd.Series([cache[p] if p in cache else cache.setdefault(p, ratio(*p)) for p in zip(a, b)], dtype="float64")


BEST = StructType().add("word", StringType()).add("score", DoubleType()).add("position", IntegerType())


@F.pandas_udf(BEST)
def best_word(texts: pd.Series, terms: pd.Series, least: pd.Series) -> pd.DataFrame:
    """The first word (or run of as many words as the term has) of greatest similarity of at least ``least``; nulls if none."""
    out, cache = [], {}
    for text, term, floor in zip(texts, terms, least):
        best = (None, None, None)
        if text and term:
            spans = [m.span() for m in WORDS.finditer(text)]
            n = max(1, len(WORDS.findall(term)))
            for k in range(len(spans) - n + 1):
                lo, word = spans[k][0], text[spans[k][0] : spans[k + n - 1][1]]
                score = cache.get((term, word))
                if score is None:
                    score = cache[(term, word)] = ratio(term, word)
                if score >= floor and (best[1] is None or score > best[1]):
                    best = (word, score, lo)
        out.append(best)
        if len(cache) > 100_000:
            cache.clear()
    return pd.DataFrame(out, columns=["word", "score", "position"]).astype({"position": "Int32"})

"""Splitting oversized items at natural boundaries.

Tokens are runs of non-blank characters. The boundary after each token has a strength: paragraph end over line end over
sentence end over clause end over any blank; line ends inside fenced code or between the rows of a table bind a little
tighter than other line ends. A sparse table over the strengths answers range-maximum queries in constant time: for each piece the
strongest boundary in the window of permissible lengths is taken, the rightmost of equals, and the next piece starts
``overlap`` tokens before it. A piece is the text from its first to its last token, so blanks inside it stay as they are.

Defined results: null content has no pieces, content without tokens gives one empty piece of 0 tokens, content within the
limit one piece that is the content itself; very long texts take n log n time and memory of a few numbers a token;
existing columns named like the new ones are left out of the result unless they are keys.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(r"\S+")
SENTENCE_END = re.compile(r"[.!?。…]['\")\]”’*_]*$")
CLAUSE_END = re.compile(r"[,;:]['\")\]”’*_]*$")
PARAGRAPH, LINE, TIGHT_LINE, SENTENCE, CLAUSE, BLANK = 5, 4, 2, 3, 1, 0
NEW_COLUMNS = ["piece_no", "content", "token_count", "start_char", "end_char", "has_overlap", "n_pieces"]


def token_spans(text: str) -> np.ndarray:
    """Start and end of each token, as an array of two columns."""
    return np.array([m.span() for m in TOKEN.finditer(text)], dtype=np.int64).reshape(-1, 2)


def boundary_strengths(text: str, spans: np.ndarray) -> np.ndarray:
    """The strength of the boundary after each token."""
    out = np.zeros(len(spans), dtype=np.int8)
    fenced = False
    for i, (a, b) in enumerate(spans):
        word = text[a:b]
        if word.startswith("```"):
            fenced = not fenced
        gap = text[b : spans[i + 1][0]] if i + 1 < len(spans) else "\n\n"
        breaks = len(re.findall(r"\r\n|\r|\n", gap))
        nxt = text[spans[i + 1][0]] if i + 1 < len(spans) else ""
        if breaks:
            tight = fenced or (word[-1] == "|" and nxt == "|" and breaks == 1)
            out[i] = TIGHT_LINE if tight else PARAGRAPH if breaks > 1 else LINE
        elif SENTENCE_END.search(word):
            out[i] = SENTENCE
        elif CLAUSE_END.search(word):
            out[i] = CLAUSE
    return out


class RangeMax:
    """Sparse table: the place of the rightmost greatest value in any range, in constant time."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        self.key = values.astype(np.int64) * (n + 1) + np.arange(n)  # of equal strengths the rightmost is greater
        self.rows = [self.key]
        width = 1
        while 2 * width <= n:
            last = self.rows[-1]
            self.rows.append(np.maximum(last[:-width], last[width:]))
            width *= 2
        self.n = n

    def argmax(self, lo: int, hi: int) -> int:
        """Over lo..hi, both included."""
        k = (hi - lo + 1).bit_length() - 1
        return int(max(self.rows[k][lo], self.rows[k][hi - (1 << k) + 1]) % (self.n + 1))


def cut_points(strengths: np.ndarray, limit: int, overlap: int, shortest: int) -> list[tuple[int, int]]:
    """First and last-plus-one token of each piece."""
    n = len(strengths)
    if n <= limit:
        return [(0, n)]
    index = RangeMax(strengths)
    out, start = [], 0
    while n - start > limit:
        end = index.argmax(start + shortest - 1, start + limit - 1) + 1
        out.append((start, end))
        start = end - overlap
    out.append((start, n))
    return out


def split_text(text: str, limit: int = 220, overlap: int = 30) -> list[tuple[int, str, int, int, int, bool]]:
    """(piece number, text, tokens, first character, last character plus one, whether it repeats the piece before)."""
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be from 0 to below the limit")
    spans = token_spans(text)
    if len(spans) <= limit:
        return [(0, text, len(spans), 0, len(text), False)]
    shortest = max(overlap + 1, limit // 2)
    out = []
    for k, (a, b) in enumerate(cut_points(boundary_strengths(text, spans), limit, overlap, shortest)):
        lo = 0 if k == 0 else int(spans[a][0])
        hi = len(text) if b == len(spans) else int(spans[b - 1][1])
        out.append((k, text[lo:hi], b - a, lo, hi, k > 0 and overlap > 0))
    return out


def split_items(df: DataFrame, keys: list[str], content: str, limit: int = 220, overlap: int = 30) -> DataFrame:
    """The ordered pieces of every item: keys, piece_no, content, token_count, start_char, end_char, has_overlap, n_pieces."""
    kind = "array<struct<piece_no:int,content:string,token_count:int,start_char:int,end_char:int,has_overlap:boolean>>"

    @F.pandas_udf(kind)
    def pieces(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([[] if t is None else [dict(zip(NEW_COLUMNS, p)) for p in split_text(t, limit, overlap)] for t in texts])

    made = df.select(*keys, pieces(F.col(content)).alias("_pieces"))
    return made.select(*keys, F.size("_pieces").alias("n_pieces"), F.inline("_pieces"))

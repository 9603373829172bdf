"""Evaluation texts leaking into training text.

The training side is cut into shards. In each shard the words of its documents form one long array of word numbers,
with separators between documents, and a suffix array over it is built by prefix doubling until all suffixes are told
apart, or are equal for as many words as the longest item has. Every suffix of every test item is looked up by
binary search, all at once, which gives its longest verbatim match in the shard; the documents of all places that hold
at least ``min_words`` words of it are reported with the place and length of their longest match.

A training word that occurs in no item cannot be part of a match, so runs of fewer than ``min_words`` words known from the
items are left out of the array; that loses no match. The items are held-out evaluation sets; they are collected only after a
check of their size, and beyond ``max_item_bytes`` they are handled in slices, each against all shards.

Words are runs of letters and digits after normalization of composition, width and case, with tags, entities and
invisible characters removed. Defined results: null texts hold nothing, items shorter than ``min_words`` cannot leak, repeated
rows give one result row for each document and item.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Of any length if it begins with an attribute that has a value; other signs of less and greater may stand around prose.
LONG = r"\s+(?:[\w:@.-]+\s*=|(?:[\w:@.-]+\s+){1,4}[\w:@.-]+\s*=\s*[\"'])[^<>]*"
INLINE = re.compile(rf"</?(?:a|abbr|b|big|code|em|font|i|mark|s|small|span|strong|sub|sup|tt|u)(?:\s[^<>]{{0,200}}|{LONG})?/?>", re.I)
TAG = re.compile(rf"</?[A-Za-z][^<>]{{0,200}}>|<[A-Za-z][\w:-]*{LONG}>|<!--.*?-->", re.S)
WORD = re.compile(r"[^\W_]+")
ENTITY = re.compile(r"&(?:#\d+|#x[0-9a-fA-F]+|[a-zA-Z]+);")
INVISIBLE = re.compile("[\u00ad\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufeff]")


def words_of(text: str) -> list[str]:
    """The words of a text in their common form."""
    if "<" in text:
        text = TAG.sub(" ", INLINE.sub("", text))
    if "&" in text:
        text = ENTITY.sub(lambda m: html.unescape(m.group()), text)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", INVISIBLE.sub("", text))
    return WORD.findall(text.lower())


def suffix_array(a: np.ndarray, depth: int) -> np.ndarray:
    """Start places in the order of their suffixes, compared over ``depth`` numbers at least; by prefix doubling."""
    n = len(a)
    order = np.argsort(a, kind="stable")
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.concatenate(([0], np.cumsum(a[order][1:] != a[order][:-1])))
    width = 1
    while width < depth and rank[order[-1]] < n - 1:
        second = np.full(n, -1, dtype=np.int64)
        if width < n:
            second[:-width] = rank[width:]
        key = rank * (n + 1) + second + 1
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.concatenate(([0], np.cumsum(sorted_key[1:] != sorted_key[:-1])))
        width *= 2
    return order


def narrow(a: np.ndarray, sa: np.ndarray, lo: np.ndarray, hi: np.ndarray, depth: int, want: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each query the part of its range lo..hi of the suffix array whose number at ``depth`` equals ``want``."""
    padded = np.append(a, -1)

    def bound(left: np.ndarray, right: np.ndarray, strict: bool) -> np.ndarray:
        left, right = left.copy(), right.copy()
        while (open_ := left < right).any():
            mid = (left + right) // 2
            value = padded[np.minimum(sa[np.minimum(mid, len(sa) - 1)] + depth, len(a))]
            go = (value <= want) if strict else (value < want)
            left = np.where(open_ & go, mid + 1, left)
            right = np.where(open_ & ~go, mid, right)
        return left

    first = bound(lo, hi, False)
    return first, bound(first, hi, True)


def longest_matches(a: np.ndarray, sa: np.ndarray, queries: np.ndarray, item_end: np.ndarray, at_least: int):
    """(query place, place in ``a``, length) of every place that shares at least ``at_least`` numbers with a query suffix.

    ``queries`` is one array of all items' numbers, ``item_end`` the end of the item at each place. All suffixes are searched together.
    """
    live = np.flatnonzero(item_end - np.arange(len(queries)) >= at_least)
    lo, hi = np.zeros(len(live), dtype=np.int64), np.full(len(live), len(sa), dtype=np.int64)
    for depth in range(at_least):
        lo, hi = narrow(a, sa, lo, hi, depth, queries[live + depth])
        keep = lo < hi
        live, lo, hi = live[keep], lo[keep], hi[keep]
        if not len(live):
            return np.empty((0, 3), dtype=np.int64)
    q = np.repeat(live, hi - lo)
    places = sa[np.repeat(lo, hi - lo) + (np.arange(len(q)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo))]
    length = np.full(len(q), at_least, dtype=np.int64)
    grow = np.arange(len(q))
    while len(grow):
        qa, pa = q[grow] + length[grow], places[grow] + length[grow]
        inside = (qa < item_end[q[grow]]) & (pa < len(a))
        grow = grow[inside]
        same = queries[q[grow] + length[grow]] == a[places[grow] + length[grow]]
        grow = grow[same]
        length[grow] += 1
    return np.stack([q, places, length], axis=1)


class Items:
    """The words of the test items as numbers, one after another."""

    def __init__(self, rows: list[tuple[int, str]], min_words: int):
        self.number: dict[str, int] = {}
        self.ids, ends, flat, owner = [], [], [], []
        for item_id, text in rows:
            words = words_of(text or "")
            if len(words) < min_words:
                continue
            flat += [self.number.setdefault(w, len(self.number)) for w in words]
            owner += [len(self.ids)] * len(words)
            ends += [len(flat)] * len(words)
            self.ids.append(item_id)
        self.flat, self.ends, self.owner = np.array(flat, dtype=np.int64), np.array(ends, dtype=np.int64), np.array(owner, dtype=np.int64)
        self.longest = max((int(x) for x in np.bincount(self.owner)), default=0)


def known_runs(words: list[str], number: dict[str, int], min_words: int) -> list[tuple[int, np.ndarray]]:
    """(place, numbers) of the runs of at least ``min_words`` words that occur in the items."""
    ids = np.fromiter((number.get(w, -1) for w in words), dtype=np.int64, count=len(words))
    known = np.concatenate(([0], (ids >= 0).astype(np.int8), [0]))
    step = np.flatnonzero(np.diff(known))
    return [(int(s), ids[s:e]) for s, e in zip(step[::2], step[1::2]) if e - s >= min_words]


def shard_matches(docs: list, texts: list[str | None], items: Items, min_words: int) -> list[tuple]:
    """(document, item, place in the document, place in the item, words) of the longest match of each document and item."""
    parts, starts, owners, size, gap = [], [], [], 0, len(items.number)
    for k, text in enumerate(texts):
        if not text:
            continue
        for place, run in known_runs(words_of(text), items.number, min_words):
            starts.append((size, place))
            owners.append(k)
            parts += [run, np.array([gap], dtype=np.int64)]
            gap += 1  # a separator of its own after each run
            size += len(run) + 1
    if not parts or not items.ids:
        return []
    a = np.concatenate(parts)
    found = longest_matches(a, suffix_array(a, items.longest), items.flat, items.ends, min_words)
    if not len(found):
        return []
    base = np.array([s for s, _ in starts])
    run_no = np.searchsorted(base, found[:, 1], side="right") - 1
    table = pd.DataFrame(
        {
            "doc": np.array(owners)[run_no],
            "item": items.owner[found[:, 0]],
            "at": found[:, 1] - base[run_no] + np.array([p for _, p in starts])[run_no],
            "item_at": found[:, 0] - np.searchsorted(items.owner, items.owner[found[:, 0]]),
            "words": found[:, 2],
        }
    )
    table = table.sort_values(["doc", "item", "words", "at", "item_at"], ascending=[True, True, False, True, True], kind="stable").drop_duplicates(["doc", "item"])
    return [(docs[d], items.ids[i], int(p), int(ip), int(w)) for d, i, p, ip, w in table.itertuples(index=False)]


def find_leaks(
    corpus: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str,
    min_words: int = 15, shard_chars: int = 1 << 24, max_item_bytes: int = 1 << 26,
) -> DataFrame:
    """(doc_id, item_id, doc_word, item_word, n_words): the longest verbatim match of every document and item that share ``min_words`` words in a row."""
    test = items.select(F.col(item_id).alias("i"), F.col(item_text).alias("t")).where("t is not null").distinct()
    total = test.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    slices = -(-total // max_item_bytes) or 1
    kinds = {f.name: f.dataType.simpleString() for f in corpus.schema}, {f.name: f.dataType.simpleString() for f in items.schema}
    schema = f"doc_id {kinds[0][doc_id]}, item_id {kinds[1][item_id]}, doc_word long, item_word long, n_words long"
    out = None
    for k in range(slices):
        part = test if slices == 1 else test.where(F.pmod(F.xxhash64("t"), F.lit(slices)) == k)
        shared = corpus.sparkSession.sparkContext.broadcast(Items([(r.i, r.t) for r in part.collect()], min_words))

        def search(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            docs: list = []
            texts: list = []
            held = 0
            names = ["doc_id", "item_id", "doc_word", "item_word", "n_words"]
            for pdf in batches:
                for d, t in zip(pdf["d"], pdf["t"]):
                    docs.append(d)
                    texts.append(t)
                    held += len(t)
                    if held >= shard_chars:
                        yield pd.DataFrame(shard_matches(docs, texts, shared.value, min_words), columns=names)
                        docs, texts, held = [], [], 0
            yield pd.DataFrame(shard_matches(docs, texts, shared.value, min_words), columns=names)

        found = corpus.select(F.col(doc_id).alias("d"), F.col(text).alias("t")).where("t is not null").mapInPandas(search, schema)
        out = found if out is None else out.unionByName(found)
    return out.groupBy("doc_id", "item_id").agg(F.max_by(F.struct("doc_word", "item_word", "n_words"), "n_words").alias("m")).select("doc_id", "item_id", "m.*")


def remove_leaks(corpus: DataFrame, doc_id: str, leaks: DataFrame) -> DataFrame:
    """The corpus without the documents named in ``leaks``."""
    return corpus.join(leaks.select(F.col("doc_id").alias(doc_id)).distinct(), doc_id, "left_anti")

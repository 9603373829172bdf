"""Pairs of sentences that translate each other, in documents that are rough translations.

Texts are read once: every sentence becomes a list of packed numbers, one a word, and all later steps work on these
lists, for many documents at a time. A word of the source language is its whole form without a plural sign, a word of
the target language its whole form without particles and the closing sign of a predicate; both are numbered by hashing
into ``BUCKETS`` buckets. Figures and names have no number; they stand for themselves.

Expectation and maximization run over all documents. A task adds up the expected counts of its documents by table cell,
no count is too small, and the cells meet in one aggregation. The table is sparse: what a word explains with less than
``LEAST`` is left out after all counts are added up, so a word has at most 1 / LEAST entries each way and the table that
all tasks get is bounded by 2 * BUCKETS / LEAST entries. In the first round a pair of sentences counts by the figures
and names that both hold and by its place; later rounds add what the table says.

Competitive linking then accepts pairs of sentences that are the best of both their sentences, over and over: a link's
gain is what the two explain of each other's words that no accepted link explains. So a sentence may be linked again
(merged and split sentences) as far as a good part of it is still unexplained, links may cross, and sentences without
enough gain stay unlinked.

Defined results: null or empty texts have no pairs; a piece without one of the closing signs, or that ends in three dots,
has no number and no pair; repeated rows give equal pairs, equal gains are decided by the lower sentence numbers; long
texts are compared in slices of their source sentences, and of a slice only what can still be linked is kept.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, fields
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BUCKETS = 1 << 16  # word numbers of each language; 0 is a figure or name
LEAST = 0.03  # least probability that the table keeps
ACCEPT, AGAIN = 0.35, 0.35
"""Least gain of a link: of two sentences not yet linked, and where one is."""
BACKGROUND = 1e-3  # weight of a pair of words that the table does not know
BLOCK_WORDS, SLICE_CELLS = 40_000, 40_000_000  # words of the documents read at a time; word pairs looked at in a slice

END = re.compile(r"[.!?\n](?:(?<=\n)|(?=\s)|\Z)")
LATIN, MARKS = "A-Za-zªºÀ-ÖØ-öø-ɏḀ-ỿⱠ-Ɀ", "̀-ͯ"
WORD = re.compile(rf"[{LATIN}][{LATIN}{MARKS}\d-]*|\d+(?:[.,]\d+)*|[Ͱ-Ͽἀ-῿Ѐ-ԯ]+|[ァ-ヿㇰ-ㇿ]+|[가-힣ᄀ-ᇿㄱ-ㆎ]+|[一-鿿㐀-䶿]+")
TARGET_LETTER = re.compile("[가-힣ᄀ-ᇿㄱ-ㆎ一-鿿㐀-䶿]")
# Korean particles after nouns, and the closing signs of predicates.
PARTICLES = "으로부터 에게서 에서는 에서도 에서의 으로는 으로도 으로의 이라는 에서 에게 까지 부터 처럼 보다 마다 으로 이나 에는 에도 와의 과의 로는 로도 라는 은 는 이 가 을 를 의 에 로 와 과 도 만"
CLOSING = "습니다 다"
STEM = re.compile(rf"(?<=..)(?:{'|'.join((PARTICLES + ' ' + CLOSING).split())})$")


def pieces(text: str) -> list[str]:
    """The numbered sentences of a text."""
    out, start = [], 0
    for end in [*(m.end() for m in END.finditer(text)), len(text)]:
        piece = text[start:end].strip()
        if piece and piece[-1] in ".!?" and not piece.endswith("..."):
            out.append(piece)
        start = end
    return out


def source_word(word: str) -> str:
    return word[:-1] if len(word) > 3 and word[-1] == "s" and word[-2] != "s" else word


def target_word(word: str) -> str:
    return STEM.sub("", word)


class Numbers(dict):
    """The packed numbers of the words between two blanks: of each what it stands for as itself, and its number in the table."""

    def __init__(self, source: bool):
        super().__init__()
        self.source = source

    def of(self, word: str) -> int:
        figure, low = word[0].isdigit(), word.lower()
        name = not TARGET_LETTER.match(word) and not (word.islower() and word.isascii())
        fixed = figure or (name and (not self.source or any(c.isupper() or c.isdigit() for c in word[1:])))
        own = word.replace(",", "").rstrip(".") if figure else low
        bucket = 0 if fixed else 1 + zlib.crc32((source_word(low) if self.source else target_word(low)).encode()) % (BUCKETS - 1)
        return (zlib.crc32(own.encode()) >> 1) << 32 | bucket

    def __missing__(self, token: str) -> list[int]:
        if len(self) > 500_000:  # only a store of what was worked out
            self.clear()
        found = self[token] = [self.of(w) for w in WORD.findall(token)]
        return found


class Tokens(dict):
    """The numbers of what stands between two blanks in some texts: its words, and whether it closes a sentence."""

    def __init__(self, numbers: Numbers):
        super().__init__()
        self.numbers = numbers
        self.words: list[list[int]] = [[]]
        self.closes = [2]  # number 0 is the end of a line; 1 closes a sentence with a number, 2 one without

    def __missing__(self, token: str) -> int:
        found = self[token] = len(self.words)
        self.words.append(self.numbers[token])
        self.closes.append(0 if token[-1] not in ".!?" else 2 if token.endswith("...") else 1)
        return found


def packed(flat: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Some numbers of each row as bytes, which Spark hands on as they are."""
    offsets = np.concatenate([[0], np.cumsum(sizes * flat.itemsize)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(flat))])


def unpacked(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, offset of each row) of packed rows."""
    _, offsets, flat = column.buffers()
    wide = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    offsets = np.frombuffer(offsets, dtype=wide)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if flat is None or not len(column):
        return np.empty(0, dtype=kind), np.zeros(len(column) + 1, dtype=np.int64)
    flat = np.frombuffer(flat, dtype=np.uint8)[offsets[0] : offsets[-1]].view(kind)
    return flat, (offsets - offsets[0]) // flat.itemsize


def read_texts(texts: pa.Array, numbers: Numbers) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(packed words, words of each sentence, words of each text, sentences of each text); sentences are those of ``pieces``."""
    tokens = Tokens(numbers)
    number_of = tokens.__getitem__
    found: list[int] = []
    sizes = []
    for text in texts.to_pylist():
        before = len(found)
        for line in (text or "").split("\n"):
            found.extend(map(number_of, line.split()))
            found.append(0)
        sizes.append(len(found) - before)
    n_words = np.fromiter(map(len, tokens.words), np.int64, len(tokens.words))
    flat = np.fromiter(chain.from_iterable(tokens.words), np.int64, int(n_words.sum()))
    token = np.fromiter(found, np.int64, len(found))
    text_of = np.repeat(np.arange(len(sizes)), sizes)
    closes = np.array(tokens.closes, dtype=np.int8)[token]
    ends = np.flatnonzero(closes)
    numbered = closes[ends] == 1
    # of each token: the sentence without a number that it is in goes out
    token = token[np.repeat(numbered, np.diff(ends, prepend=-1))]
    n = n_words[token]
    words = flat[spans((np.cumsum(n_words) - n_words)[token], n)]
    before = np.concatenate([[0], np.cumsum(n)])
    last = np.flatnonzero(np.array(tokens.closes, dtype=np.int8)[token] == 1) + 1
    lengths = np.diff(before[last], prepend=0)
    text_of = text_of[ends[numbered]]
    n_texts = len(sizes)
    return words, lengths.astype(np.int32), np.bincount(text_of, lengths, minlength=n_texts).astype(np.int64), np.bincount(text_of, minlength=n_texts)


def read_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words as numbers: what they stand for, counted from 0 in each document, and their numbers in the table."""
    numbers = Numbers(True), Numbers(False)
    for batch in batches:
        keys = [c for c in batch.schema.names if c not in ("_source", "_target")]
        sides = [read_texts(batch.column(c), n) for c, n in zip(("_source", "_target"), numbers)]
        docs = np.concatenate([np.repeat(np.arange(batch.num_rows), side[2]) for side in sides])
        words = np.concatenate([side[0] for side in sides])
        values, own = np.unique(docs << 32 | words >> 32, return_inverse=True)
        distinct = np.bincount(values >> 32, minlength=batch.num_rows)
        words = (own - (np.cumsum(distinct) - distinct)[docs]) << 32 | (words & 0xFFFFFFFF)
        columns = [batch.column(k) for k in keys] + [pa.array(distinct.astype(np.int32))]
        for flat, side in zip(np.split(words, [len(sides[0][0])]), sides):
            columns += [packed(flat, side[2]), packed(side[1], side[3])]
        yield pa.RecordBatch.from_arrays(columns, names=[*keys, *READ])


READ = ["_n", "_s", "_sn", "_t", "_tn"]


def spans(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each start, one after the other."""
    before = np.cumsum(counts) - counts
    return np.repeat(starts - before, counts) + np.arange(int(counts.sum()))


def compact(index: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray]:
    """(slot of each entry, value of each slot) of the distinct values below ``total``."""
    if total <= 8 * len(index) + 10_000:
        seen = np.zeros(total, dtype=bool)
        seen[index] = True
        return (np.cumsum(seen) - 1)[index], np.flatnonzero(seen)
    values, slots = np.unique(index, return_inverse=True)
    return slots, values


def totals(index: np.ndarray, weights: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray]:
    """(value, sum of its weights) of the distinct values below ``total``, in order; weights are above 0."""
    if total <= 8 * len(index) + 10_000:
        sums = np.bincount(index, weights, minlength=total)
        values = np.flatnonzero(sums > 0)
        return values, sums[values]
    slots, values = compact(index, total)
    return values, np.bincount(slots, weights, minlength=len(values))


def ordered(values: np.ndarray) -> np.ndarray:
    """The order of values from 0; equal ones stay in theirs."""
    return np.argsort(values.astype(np.uint16) if values.max(initial=0) < 1 << 16 else values, kind="stable")


class Places:
    """Where each of some codes below ``total`` occurs."""

    def __init__(self, items: np.ndarray, codes: np.ndarray, total: int):
        by_code = np.argsort(codes.astype(np.int32) if total < 1 << 31 else codes)
        self.order = items[by_code]
        self.dense = total <= 8 * len(codes) + 4_000_000
        if self.dense:
            self.counts = np.bincount(codes, minlength=total)
            self.starts = np.cumsum(self.counts) - self.counts
        else:
            self.sorted = codes[by_code]

    def find(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first place in ``order``, number of places) of each code."""
        if self.dense:
            return self.starts[codes], self.counts[codes]
        lo = np.searchsorted(self.sorted, codes, "left")
        return lo, np.searchsorted(self.sorted, codes, "right") - lo


@dataclass
class Items:
    """What the words of some documents stand for, each once a document."""

    own: np.ndarray
    number: np.ndarray
    local: np.ndarray
    where: np.ndarray
    often: np.ndarray  # by ``own``
    vocabulary: np.ndarray
    n_own: int
    n_sentences: np.ndarray


class Side:
    """All words of one language of some documents: what they stand for, their numbers, sentences and documents."""

    def __init__(self, words: np.ndarray, lengths: np.ndarray, sentences: np.ndarray, distinct: np.ndarray):
        self.n_sentences = sentences  # of each document
        self.length = lengths  # of each sentence
        self.doc = np.repeat(np.arange(len(sentences)), sentences)  # of each sentence
        self.first = np.cumsum(sentences) - sentences  # sentence of each document
        self.start = np.cumsum(lengths) - lengths  # word of each sentence
        self.sentence = np.repeat(np.arange(len(lengths)), lengths)  # of each word
        self.where = self.doc[self.sentence]  # document of each word
        self.number = words & 0xFFFFFFFF
        self.known = np.flatnonzero(self.number > 0)
        # what the words stand for, over both sides of all documents, and how often that occurs on this side
        self.n_own = int(distinct.sum())
        self.own = (words >> 32) + (np.cumsum(distinct) - distinct)[self.where]
        self.often = np.bincount(self.own, minlength=self.n_own)
        seen = np.zeros(BUCKETS, dtype=bool)
        seen[self.number] = True
        self.vocabulary = np.flatnonzero(seen)
        self.local = (np.cumsum(seen) - 1)[self.number]
        # equal words of a document are one item
        self.item, values = compact(2 * self.own + (self.number > 0), 2 * self.n_own)
        each = np.zeros((3, len(values)), dtype=np.int64)
        for to, of in zip(each, (self.number, self.local, self.where)):
            to[self.item] = of
        self.items = Items(values >> 1, *each, self.often, self.vocabulary, self.n_own, self.n_sentences)
        # of each document
        self.n_items, self.n_words = np.bincount(each[2], minlength=len(sentences)), np.bincount(self.where, minlength=len(sentences))
        self.first_item, self.first_word = np.cumsum(self.n_items) - self.n_items, np.cumsum(self.n_words) - self.n_words

    def words_of(self, sentences: np.ndarray) -> np.ndarray:
        return spans(self.start[sentences], self.length[sentences])


@dataclass
class Table:
    """Entries of the translation table, by source word: what is kept of either way."""

    forth: tuple[np.ndarray, ...]  # (first entry and number of entries of each source word; target word, its probability)
    back: np.ndarray  # probability of the source word
    both: np.ndarray  # probability for the next counts
    code: np.ndarray

    @classmethod
    def of(cls, s: np.ndarray, t: np.ndarray, forth: np.ndarray, back: np.ndarray) -> Table:
        kept = np.flatnonzero((forth >= LEAST) | (back >= LEAST))
        kept = kept[np.lexsort((t[kept], s[kept]))]
        s, t, forth, back = s[kept], t[kept], forth[kept], back[kept]
        counts = np.bincount(s, minlength=BUCKETS)
        least = lambda p: np.where(p >= LEAST, p, 0.0).astype(np.float32)
        return cls((np.cumsum(counts) - counts, counts, t, least(forth)), least(back), np.sqrt(forth * back).astype(np.float32), s * BUCKETS + t)


def documents(side: Side | Items, words: np.ndarray) -> np.ndarray:
    """A bit for each document that holds a word, by word of the vocabulary."""
    holds = np.zeros((len(side.vocabulary), len(side.n_sentences)), dtype=bool)
    holds[side.local[words], side.where[words]] = True
    return np.packbits(holds, axis=1)


def common(in_a: np.ndarray, a: np.ndarray, in_b: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the pair, document) of the documents that hold both words of pairs of words."""
    width = in_a.shape[1]
    step = max(1, 16_000_000 // max(1, width))
    pairs, docs = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)]
    for first in range(0, len(a), step):
        bits = (in_a[a[first : first + step]] & in_b[b[first : first + step]]).ravel()
        some = np.flatnonzero(bits != 0)
        bit = np.flatnonzero(np.unpackbits(bits[some]).view(bool))
        pair = some // width
        at = bit >> 3
        pairs.append((pair + first)[at])
        docs.append(bit + ((some - pair * width - np.arange(len(some))) * 8)[at])
    return np.concatenate(pairs), np.concatenate(docs)


Matches = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def matches(a: Side | Items, of_a: np.ndarray, b: Side | Items, of_b: np.ndarray, rows: tuple[np.ndarray, ...] | None) -> Matches:
    """(word of a, word of b, probability, entry of the table or -1) of the words that explain each other, by word of a.

    Equal figures, names and words explain each other, the less the more often they occur in the document.
    """
    equal = Places(of_b, b.own[of_b], b.n_own)
    start, n = equal.find(a.own[of_a])
    own = a.own[of_a]
    share = np.where(n > 0, 1.0 / np.sqrt(a.often[own] * np.maximum(1, b.often[own])), 0.0)
    hit = np.flatnonzero(share >= LEAST / 3)
    n = n[hit]
    at_a, at_b, p = np.repeat(of_a[hit], n), equal.order[spans(start[hit], n)], np.repeat(share[hit], n).astype(np.float32)
    if rows is None:
        return at_a, at_b, p, np.full(len(p), -1)
    starts, counts, other, prob = rows
    # only what occurs in these documents at all; looked up once for each word of the vocabulary
    local = np.full(BUCKETS, -1)
    local[b.vocabulary] = np.arange(len(b.vocabulary))
    n = counts[a.vocabulary]
    entry, owner = spans(starts[a.vocabulary], n), np.repeat(np.arange(len(a.vocabulary)), n)
    asked = local[other[entry]]
    some = np.flatnonzero(asked >= 0)
    entry, owner, asked = entry[some], owner[some], asked[some]
    n_docs = len(b.n_sentences)
    known, named = of_a[a.number[of_a] > 0], of_b[b.number[of_b] > 0]
    of, doc = common(documents(a, known), owner, documents(b, named), asked)
    here, there = (Places(k, x.local[k] * n_docs + x.where[k], len(x.vocabulary) * n_docs) for x, k in ((a, known), (b, named)))
    start, n = here.find(owner[of] * n_docs + doc)
    word, of, doc = here.order[spans(start, n)], np.repeat(of, n), np.repeat(doc, n)
    start, n = there.find(asked[of] * n_docs + doc)
    entry = entry[np.repeat(of, n)]
    found = np.repeat(word, n), there.order[spans(start, n)], prob[entry], entry
    at_a = np.concatenate([at_a, found[0]])
    by_word = ordered(at_a)
    return at_a[by_word], *(np.concatenate(x)[by_word] for x in zip((at_b, p, np.full(len(p), -1)), found[1:]))


@dataclass
class Lists:
    """The items that each item of one side explains (``own`` is in order), with their probability and that for the next counts."""

    starts: np.ndarray
    counts: np.ndarray
    other: np.ndarray
    p: np.ndarray
    both: np.ndarray | None

    @classmethod
    def of(cls, own: np.ndarray, other: np.ndarray, p: np.ndarray, both: np.ndarray | None, total: int) -> Lists:
        counts = np.bincount(own, minlength=total)
        return cls(np.cumsum(counts) - counts, counts, other, p, both)


def item_lists(s: Side, t: Side, table: Table | None) -> tuple[Lists, Lists]:
    """What items explain each other in their documents, by source item and by target item."""
    n, m = len(s.items.own), len(t.items.own)
    a, b, forth, entry = matches(s.items, np.arange(n), t.items, np.arange(m), table and table.forth)
    back, both = forth, np.zeros_like(forth)
    if table and len(table.code):
        # an entry -1 takes the value that is put last
        back, both = np.append(table.back, np.float32(0))[entry], np.append(table.both, np.float32(0))[entry]
        equal = np.flatnonzero(entry < 0)
        back[equal] = forth[equal]
    by_target = ordered(b)
    return Lists.of(a, b, forth, both, n), Lists.of(b[by_target], a[by_target], back[by_target], None, m)


class Rows:
    """How much some sentences explain of every item of the other side of their documents; a row is a sentence.

    Words count with ``weight``; of the other side only the items ``asked`` for have a column.
    """

    def __init__(self, a: Side, sentences: np.ndarray, b: Side, lists: Lists, weight: np.ndarray | None = None, asked: np.ndarray | None = None):
        self.item, first, width = b.item, b.first_item, b.n_items
        if asked is not None:
            column = np.cumsum(asked) - 1
            self.item, width = column[b.item], np.bincount(b.items.where[asked], minlength=len(width))
            first = np.cumsum(width) - width
        doc = a.doc[sentences]
        end = np.cumsum(width[doc])
        self.shift = end - width[doc] - first[doc]  # of each row, to what its columns are added
        words = a.words_of(sentences)
        item = a.item[words]
        n = lists.counts[item]
        entry = spans(lists.starts[item], n)
        at, shift = lists.other[entry], np.repeat(np.repeat(self.shift, a.length[sentences]), n)
        share = None if weight is None else np.repeat(weight[words], n)
        if asked is not None:
            some = np.flatnonzero(asked[at])
            entry, at, shift = entry[some], column[at[some]], shift[some]
            share = None if share is None else share[some]
        self.entry, self.cell, self.share, self.size = entry, at + shift, share, int(end[-1]) if len(end) else 0
        self.sum(lists.p)

    def sum(self, p: np.ndarray) -> None:
        share = p[self.entry] if self.share is None else p[self.entry] * self.share
        self.sums = np.bincount(self.cell, share, minlength=self.size)

    def at(self, rows: np.ndarray, words: np.ndarray) -> np.ndarray:
        """How much a row explains of some words of the other side: row and word, pair by pair."""
        return self.sums[self.shift[rows] + self.item[words]]


@dataclass
class Cells:
    """Pairs of sentences with what they explain of each other; ``target`` and ``source`` have a value for each word of each sentence."""

    s: np.ndarray
    t: np.ndarray
    gain: np.ndarray
    target: np.ndarray
    source: np.ndarray


def compare_slice(s: Side, t: Side, lists: tuple[Lists, Lists], lo: int, hi: int, keep, counting: bool) -> Cells:
    """The pairs of the source sentences from ``lo`` to ``hi`` with sentences of their documents that ``keep`` chooses."""
    sentences = np.arange(lo, hi)
    doc = s.doc[lo:hi]
    others = np.arange(t.first[doc[0]], t.first[doc[-1]] + t.n_sentences[doc[-1]])
    begin, end = s.start[lo], s.start[hi - 1] + s.length[hi - 1]
    asked = None
    if hi - lo < len(s.length):
        asked = np.zeros(len(s.items.own), dtype=bool)
        asked[s.item[begin:end]] = True
    forth, back = Rows(s, sentences, t, lists[0]), Rows(t, others, s, lists[1], asked=asked)
    np.minimum(1.0, forth.sums, out=forth.sums)
    np.minimum(1.0, back.sums, out=back.sums)
    width = t.n_sentences[doc]  # cells of a source sentence
    base = np.cumsum(width) - width
    total = int(width.sum())
    # every source sentence with every target word of its document, and the other way round
    asked_of = np.flatnonzero(lists[1].counts[t.item] > 0)  # words that nothing explains add nothing
    n_own = np.bincount(t.where[asked_of], minlength=len(t.n_sentences))
    n = n_own[doc]
    words = asked_of[spans((np.cumsum(n_own) - n_own)[doc], n)]
    to_target = np.bincount(np.repeat(base - t.first[doc], n) + t.sentence[words], forth.sums[np.repeat(forth.shift, n) + t.item[words]], minlength=total)
    asked_of = begin + np.flatnonzero(lists[0].counts[s.item[begin:end]] > 0)
    n_own = np.bincount(s.where[asked_of], minlength=len(s.n_sentences))
    other_doc = t.doc[others]
    n = n_own[other_doc]
    words = asked_of[spans((np.cumsum(n_own) - n_own)[other_doc], n)]
    cell = base[s.sentence[words] - lo] + np.repeat(others - t.first[other_doc], n)
    to_source = np.bincount(cell, back.sums[np.repeat(back.shift, n) + back.item[words]], minlength=total)
    some = np.flatnonzero((to_target > 0) & (to_source > 0))
    i, j = np.repeat(sentences, width)[some], spans(t.first[doc], width)[some]
    found = Cells(i, j, np.sqrt(to_target[some] / np.maximum(1, t.length[j]) * (to_source[some] / np.maximum(1, s.length[i]))), np.empty(0), np.empty(0))
    kept = np.flatnonzero(keep(found))
    i, j = i[kept], j[kept]
    if counting:
        forth.sum(lists[0].both)
    target = forth.at(np.repeat(i - lo, t.length[j]), t.words_of(j))
    source = np.empty(0) if counting else back.at(np.repeat(j - others[0], s.length[i]), s.words_of(i))
    return Cells(i, j, found.gain[kept], target, source)


def compare(s: Side, t: Side, lists: tuple[Lists, Lists], keep, counting: bool = False) -> Cells:
    """The pairs of sentences that ``keep`` (of one slice's pairs) chooses.

    Their words have what the other sentence explains of them, or (``counting``) its probabilities for the next counts.
    """
    words = np.cumsum(s.length.astype(np.int64) * np.maximum(1, t.n_words)[s.doc])
    ends = np.append(np.flatnonzero(np.diff(words // SLICE_CELLS)) + 1, len(words))
    parts = [compare_slice(s, t, lists, lo, hi, keep, counting) for lo, hi in zip([0, *ends[:-1].tolist()], ends.tolist())]
    return parts[0] if len(parts) == 1 else Cells(*(np.concatenate([getattr(x, f.name) for x in parts]) for f in fields(Cells)))


def place(s: Side, t: Side, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How far apart two sentences stand in their texts, as a share of these."""
    doc = s.doc[i]
    return np.abs((i - s.first[doc] + 0.5) / s.n_sentences[doc] - (j - t.first[doc] + 0.5) / t.n_sentences[doc])


def greatest(values: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n)
    np.maximum.at(out, at, values)
    return out


def expected_counts(s: Side, t: Side, table: Table | None) -> tuple[np.ndarray, np.ndarray]:
    """(cell of the table, expected count) of some documents."""

    def weight(cells: Cells) -> np.ndarray:
        far = place(s, t, cells.s, cells.t) * np.maximum(s.n_sentences, t.n_sentences)[s.doc[cells.s]]
        return np.minimum(1.0, (cells.gain / 0.35) ** 2) * np.exp(-far / 4)

    def keep(cells: Cells) -> np.ndarray:
        w = weight(cells)
        return (w > 0) & (w >= 0.5 * greatest(w, cells.s, len(s.length))[cells.s])

    cells = compare(s, t, item_lists(s, t, table), keep, counting=True)
    w = weight(cells)
    best = np.flatnonzero(w >= 0.5 * greatest(w, cells.t, len(t.length))[cells.t])
    w, i, j = w[best], cells.s[best], cells.t[best]

    # source words with a number, by sentence
    s_words = s.known
    s_count = np.bincount(s.sentence[s_words], minlength=len(s.length))
    s_first = np.cumsum(s_count) - s_count

    # a column is a pair of sentences and a target word with a number; its entries are the source words
    number = np.full(len(cells.s), -1)
    number[best] = np.arange(len(best))
    column_pair, column_word = np.repeat(number, t.length[cells.t]), t.words_of(cells.t)
    some = np.flatnonzero((column_pair >= 0) & (t.number[column_word] > 0))
    column_pair, column_word = column_pair[some], column_word[some]
    height = s_count[i][column_pair]
    weights = BACKGROUND * height + cells.target[some] if table else height
    total = np.bincount(column_word, weights * w[column_pair], minlength=len(t.number))
    mass = np.minimum(1.0, greatest(w, j, len(t.length)))[t.sentence]
    # of each column: the weight of its pair, and what makes the shares of its word add up to its mass
    scale = w[column_pair] * (mass / np.where(total > 0, total, 1.0))[column_word]
    width = len(t.vocabulary)
    local, column_local = s.local[s_words] * width, t.local[column_word]
    codes, counts = [], []
    # a bounded number of entries at a time; a pair of words has the same probability in all of them
    part = np.cumsum(height) // 4_000_000
    for k in np.unique(part):
        columns = np.flatnonzero(part == k)
        h = height[columns]
        at = local[spans(s_first[i][column_pair[columns]], h)] + np.repeat(column_local[columns], h)
        values, sums = totals(at, np.repeat(scale[columns], h), len(s.vocabulary) * width)
        code = s.vocabulary[values // width] * BUCKETS + t.vocabulary[values % width]
        if table:
            prob = np.full(len(code), BACKGROUND)
            place_of = np.searchsorted(code, table.code)
            hit = np.flatnonzero(np.append(code, -1)[place_of] == table.code)
            prob[place_of[hit]] += table.both[hit]
            sums = sums * prob
        codes.append(code)
        counts.append(sums)
    return (np.concatenate(codes), np.concatenate(counts)) if codes else (np.empty(0, dtype=np.int64), np.empty(0))


def blocks(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, Side, Side]]:
    """(rows, source side, target side) of some documents at a time; documents without words on a side are left out."""

    (s, so), (sn, sno), (t, to), (tn, tno) = (unpacked(batch.column(name), kind) for name, kind in zip(READ[1:], (np.int64, np.int32) * 2))
    distinct = batch.column("_n").to_numpy().astype(np.int64)
    some = np.flatnonzero((np.diff(so) > 0) & (np.diff(to) > 0))
    block = np.cumsum(np.diff(so)[some] + np.diff(to)[some]) // BLOCK_WORDS
    for number in np.unique(block):
        rows = some[block == number]
        side = lambda x, xo, n, no, rows=rows: Side(x[spans(xo[rows], np.diff(xo)[rows])], n[spans(no[rows], np.diff(no)[rows])].astype(np.int64), np.diff(no)[rows], distinct[rows])
        yield rows, side(s, so, sn, sno), side(t, to, tn, tno)


def merged(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    code = np.concatenate(codes)
    s = code // BUCKETS
    (at_s, s), (at_t, t) = compact(s, BUCKETS), compact(code - s * BUCKETS, BUCKETS)
    values, sums = totals(at_s * len(t) + at_t, np.concatenate(counts), len(s) * len(t))
    at_s = values // max(1, len(t))
    return s[at_s] * BUCKETS + t[values - at_s * len(t)], sums


def count_partition(table: Table | None, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Expected counts of a partition, added up before they are shuffled; what grows beyond a bound goes out before."""
    codes: list[np.ndarray] = []
    counts: list[np.ndarray] = []
    waiting = 0

    def out() -> pa.RecordBatch:
        values, sums = merged(codes, counts)
        return pa.RecordBatch.from_arrays([pa.array((values // BUCKETS).astype(np.int32)), pa.array((values % BUCKETS).astype(np.int32)), pa.array(sums)], names=["s", "t", "n"])

    for batch in batches:
        for _, s, t in blocks(batch):
            c, n = expected_counts(s, t, table)
            codes.append(c)
            counts.append(n)
            waiting += len(c)
            if waiting > 4_000_000:
                c, n = merged(codes, counts)
                codes, counts, waiting = [c], [n], len(c)
                if waiting > 2_000_000:
                    yield out()
                    codes, counts, waiting = [], [], 0
    if codes:
        yield out()


def estimate_table(pairs: DataFrame, rounds: int = 3) -> Table:
    """Expectation-maximization over all documents; a round is one job whose result is bounded by BUCKETS and LEAST."""
    table = None
    words = pairs.select(*READ)
    for _ in range(max(1, rounds)):
        shared = pairs.sparkSession.sparkContext.broadcast(table)
        cells = words.mapInArrow(lambda it, shared=shared: count_partition(shared.value, it), "s int, t int, n double")
        # a task gives a cell once, so cells are added up only after they are shuffled, and by the word that is asked for next
        cells = cells.repartition("s").groupBy("s", "t").agg(F.sum("n").alias("n"))
        # seldom seen words give no certainty
        cells = cells.select("s", "t", (F.col("n") / (F.sum("n").over(W.partitionBy("s")) + 1)).alias("forth"), (F.col("n") / (F.sum("n").over(W.partitionBy("t")) + 1)).alias("back"))
        found = cells.where((F.col("forth") >= LEAST) | (F.col("back") >= LEAST)).toPandas()
        table = Table.of(found["s"].to_numpy(np.int64), found["t"].to_numpy(np.int64), found["forth"].to_numpy(float), found["back"].to_numpy(float))
        shared.unpersist()
    return table


def link(s: Side, t: Side, table: Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Competitive linking: (source sentence, target sentence, gain), numbered over all documents of the block."""
    lists = item_lists(s, t, table)
    # what is left of a sentence counts as a third of it at least, so a gain below a third of the least is never enough
    cells = compare(s, t, lists, lambda c: c.gain >= min(ACCEPT, AGAIN) / 3)
    i, j, gain = cells.s, cells.t, cells.gain.copy()
    near = 1.0 - 0.05 * place(s, t, i, j)  # only to choose among equals
    free_s, free_t = np.ones(len(s.number)), np.ones(len(t.number))
    linked_s, linked_t = np.zeros(len(s.length), dtype=bool), np.zeros(len(t.length), dtype=bool)
    taken = np.zeros(len(i), dtype=bool)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    first_value = [np.cumsum(n) - n for n in (s.length[i], t.length[j])]

    def left(k: np.ndarray) -> np.ndarray:
        """The gain of some cells in words that no accepted link explains, of at least a third of either sentence."""
        sums = []
        for a, of_a, free_a, b, of_b, free_b, by in ((s, i[k], free_s, t, j[k], free_t, lists[0]), (t, j[k], free_t, s, i[k], free_s, lists[1])):
            row, sentences = compact(of_a, len(a.length))
            words, n = b.words_of(of_b), b.length[of_b]
            free = free_b[words]
            explains = np.minimum(1.0, Rows(a, sentences, b, by, free_a).at(np.repeat(row, n), words)) * free
            cell = np.repeat(np.arange(len(k)), n)
            sums.append(np.bincount(cell, explains, minlength=len(k)) / np.maximum(np.bincount(cell, free, minlength=len(k)), n / 3))
        return np.sqrt(sums[0] * sums[1])

    while True:
        some = linked_s[i] | linked_t[j]
        able = ~taken & (gain >= np.where(some, AGAIN, ACCEPT)) & ~(linked_s[i] & linked_t[j])
        if not able.any():
            break
        able = np.flatnonzero(able)
        of_s, of_t = i[able], j[able]
        rank = np.empty(len(able), dtype=np.int64)
        rank[np.lexsort((of_t, of_s, -np.round(gain[able] * near[able], 9)))] = np.arange(len(able), 0, -1)
        first_s, first_t = np.zeros(len(s.length), dtype=np.int64), np.zeros(len(t.length), dtype=np.int64)
        np.maximum.at(first_s, of_s, rank)
        np.maximum.at(first_t, of_t, rank)
        now = able[(first_s[of_s] == rank) & (first_t[of_t] == rank)]
        out.append((i[now], j[now], gain[now]))
        taken[now] = True
        linked_s[i[now]] = linked_t[j[now]] = True
        changed_s, changed_t = np.zeros(len(s.length), dtype=bool), np.zeros(len(t.length), dtype=bool)
        changed_s[i[now]] = changed_t[j[now]] = True
        for side, of, free, first, explains in ((s, i[now], free_s, first_value[0], cells.source), (t, j[now], free_t, first_value[1], cells.target)):
            free[side.words_of(of)] *= 1.0 - explains[spans(first[now], side.length[of])]
        # only where the words of a sentence changed; a bounded size of rows at a time
        again = np.flatnonzero((linked_s[i] ^ linked_t[j]) & (changed_s[i] | changed_t[j]))
        part = np.cumsum((s.n_items + t.n_items)[s.doc[i[again]]]) // 4_000_000
        for number in np.unique(part):
            k = again[part == number]
            gain[k] = left(k)
    if not out:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0)
    return tuple(np.concatenate(x) for x in zip(*out))


def link_partition(table: Table, keys: list[str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, s, t in blocks(batch):
            i, j, gain = link(s, t, table)
            doc = s.doc[i]
            chosen = pa.array(rows[doc])
            numbers = [pa.array((i - s.first[doc]).astype(np.int32)), pa.array((j - t.first[doc]).astype(np.int32)), pa.array(gain)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(chosen) for k in keys), *numbers], names=[*keys, "source_no", "target_no", "score"])


def align_sentences(df: DataFrame, keys: list[str], source: str, target: str, rounds: int = 3, keep=lambda df: df) -> DataFrame:
    """(keys, source_no, target_no, score) of the sentences of ``source`` and ``target`` that translate each other."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema)
    texts = df.select(*keys, F.col(source).alias("_source"), F.col(target).alias("_target")).where("_source <> '' and _target <> ''")
    pairs = keep(texts.mapInArrow(read_pairs, f"{kinds}, _n int, _s binary, _sn binary, _t binary, _tn binary"))
    shared = df.sparkSession.sparkContext.broadcast(estimate_table(pairs, rounds))
    return pairs.mapInArrow(lambda it: link_partition(shared.value, keys, it), f"{kinds}, source_no int, target_no int, score double")

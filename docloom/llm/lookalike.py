"""Visually identical text with different characters.

``canonical_text`` brings text to one form in three steps:

1. compatibility normalization that keeps the look: composed letters (NFC), ordinary width, single letters for
   ligatures, ordinary blank and hyphen. Raised and lowered digits, circled or styled letters look different and stay.
2. deletion of characters that show nothing (Unicode's default-ignorable and format characters). Joiners stay where
   they change the picture: between letters of joining scripts and between pictographs.
3. for each token that mixes alphabets or could be read in several, a lattice with a column per character, in it the
   character and its look-alikes in other alphabets. Viterbi finds the best path under character bigrams of each
   alphabet, counted over the whole corpus, with a penalty for a change of alphabet inside the token.

Defined results: null stays null and is never a case, the empty text stays empty; a token of one Greek letter is a
symbol and stays; very long texts are handled token by token in linear time; repeated rows give equal results.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Letters of other alphabets and the basic Latin letter of the same look.
LOOK_ALIKES = {
    "Cyrillic": "аa еe оo рp сc уy хx іi јj ѕs һh ԁd ԛq ԝw ѵv АA ВB ЕE КK МM НH ОO РP СC ТT УY ХX ІI ЈJ ЅS ԚQ ԜW ӀI",
    "Greek": "οo νv ρp ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX",
    "Armenian": "օo ոn սu հh ցg յj զq ՕO ՏS ԼL ՍU",
    "Latin": "ɡg ɑa ᴏo",
}
TO_LATIN = {pair[0]: pair[1] for row in LOOK_ALIKES.values() for pair in row.split()}
FROM_LATIN: dict[str, list[str]] = {}
for _script, _row in LOOK_ALIKES.items():
    if _script != "Latin":
        for _pair in _row.split():
            FROM_LATIN.setdefault(_pair[1], []).append(_pair[0])

SCRIPTS = ("Latin", "Cyrillic", "Greek", "Armenian")
SCRIPT_RE = {s: regex.compile(rf"\p{{Script={s}}}") for s in SCRIPTS}
TOKEN = regex.compile(r"(?:[\p{Script=Latin}\p{Script=Cyrillic}\p{Script=Greek}\p{Script=Armenian}]\p{M}*)+")
PLAIN = regex.compile(r"[\x20-\x7e가-힣]*")
IGNORABLE = regex.compile(r"[\p{Default_Ignorable_Code_Point}\p{Cf}]")
JOINERS = "\u200c\u200d"
JOINING = regex.compile(
    r"[\p{Extended_Pictographic}\p{Script=Arabic}\p{Script=Syriac}\p{Script=Devanagari}\p{Script=Bengali}\p{Script=Tamil}"
    r"\p{Script=Telugu}\p{Script=Kannada}\p{Script=Malayalam}\p{Script=Sinhala}\p{Script=Gujarati}\p{Script=Gurmukhi}\ufe0f]"
)
HYPHENS = "‐‑﹣－"
SWITCH = -14.0
"""Log penalty of a change of alphabet inside a token."""


@lru_cache(maxsize=70_000)
def fold_char(ch: str) -> str:
    """The plainer text of the same look, without regard to the characters around it."""
    if ch in HYPHENS:
        return "-"
    if unicodedata.category(ch) == "Zs":
        return " "
    kind, _, rest = unicodedata.decomposition(ch).partition(" ")
    if kind in ("<wide>", "<narrow>"):
        return unicodedata.normalize("NFKC", ch)
    if kind == "<compat>" and ("ﬀ" <= ch <= "ﬆ" or "Ⅰ" <= ch <= "ⅿ" or ch in "ĲĳǇǈǉǊǋǌ"):
        return unicodedata.normalize("NFKC", ch)
    return ch


def drop_ignorable(text: str) -> str:
    def keep(m: regex.Match) -> str:
        if m.group() in JOINERS or m.group() == "\ufe0f":
            before, after = text[: m.start()][-1:], text[m.end() :][:1]
            if JOINING.fullmatch(before) and (JOINING.fullmatch(after) or m.group() == "\ufe0f"):
                return m.group()
        return ""

    return IGNORABLE.sub(keep, text)


def normalize(text: str) -> str:
    """Steps 1 and 2."""
    if PLAIN.fullmatch(text):
        return text
    return unicodedata.normalize("NFC", "".join(map(fold_char, drop_ignorable(unicodedata.normalize("NFC", text)))))


@lru_cache(maxsize=70_000)
def script_of(ch: str) -> str:
    return next((s for s in SCRIPTS if SCRIPT_RE[s].match(ch)), "")


@lru_cache(maxsize=70_000)
def candidates(ch: str) -> tuple[tuple[str, str], ...]:
    """The character and its look-alikes, each with its alphabet; a letter with marks has those of its base letter."""
    base, marks = unicodedata.normalize("NFD", ch)[:1], unicodedata.normalize("NFD", ch)[1:]
    out = [ch]
    latin = TO_LATIN.get(base)
    if latin:
        out.append(unicodedata.normalize("NFC", latin + marks))
        out += [unicodedata.normalize("NFC", x + marks) for x in FROM_LATIN.get(latin, []) if x != base]
    elif base in FROM_LATIN:
        out += [unicodedata.normalize("NFC", x + marks) for x in FROM_LATIN[base]]
    return tuple((c, script_of(c)) for c in out if c == ch or len(c) == 1)


def is_evidence(token: str) -> str:
    """The alphabet of a token that can only be written in it, or basic Latin letters alone; else ''."""
    if token.isascii():
        return "Latin"
    own = {script_of(c) for c in token if not unicodedata.combining(c)}
    if len(own) != 1 or any(c in TO_LATIN and script_of(c) == "Latin" for c in token):
        return ""
    script = own.pop()
    return script if script == "Latin" or any(len(candidates(c)) == 1 for c in token) else ""


def count_ngrams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Bigram counts of a partition, added up before they are shuffled."""
    n: Counter = Counter()
    for pdf in batches:
        for text, times in pdf["value"].dropna().value_counts().items():
            for m in TOKEN.finditer(normalize(text)):
                if script := is_evidence(m.group()):
                    word = "^" + m.group() + "$"
                    for pair in zip(word, word[1:]):
                        n[(script, *pair)] += times
    yield pd.DataFrame([(*k, v) for k, v in n.items()], columns=["script", "a", "b", "n"])


class ScriptModel:
    """Bigram log probabilities for each alphabet. Its size is bounded by the letters of four alphabets."""

    def __init__(self, rows: list[tuple[str, str, str, int]]):
        self.pair: Counter = Counter()
        self.first: Counter = Counter()
        self.tokens: Counter = Counter()
        for script, a, b, n in rows:
            self.pair[(script, a, b)] += n
            self.first[(script, a)] += n
            if a == "^":
                self.tokens[script] += n
        self.cache: dict[str, str] = {}

    def step(self, script: str, a: str, b: str) -> float:
        return math.log((self.pair[(script, a, b)] + 0.05) / (self.first[(script, a)] + 0.05 * 200))

    def best(self, token: str) -> str:
        """Viterbi over the token's lattice."""
        if len(token) == 1 and script_of(token) == "Greek":
            return token
        found = self.cache.get(token)
        if found is not None:
            return found
        columns = [candidates(c) for c in token]
        if all(len(col) == 1 for col in columns) or token.isascii():
            return token
        total = sum(self.tokens.values()) + 1
        layer: dict[tuple[str, str], tuple[float, tuple]] = {}
        for i, col in enumerate(columns):
            new = {}
            for ch, script in col:
                if not script:  # a combining mark belongs to the letter before it
                    new |= {k: (s, (ch, path)) for k, (s, path) in layer.items()} or {("", ""): (0.0, (ch, None))}
                    continue
                plain = 0.0 if ch.isascii() or ch == token[i] else -1.0
                if script == "Latin" and ch in TO_LATIN:
                    plain -= 6.0
                start = math.log((self.tokens[script] + 0.5) / total) + self.step(script, "^", ch)
                options = [(start, None)] if not layer else []
                for (prev, s0), (score, path) in layer.items():
                    options.append((score + (self.step(script, prev, ch) if s0 == script else SWITCH + start), path))
                score, path = max(options, key=lambda x: x[0])
                new[(ch, script)] = (score + plain, (ch, path))
            layer = new
        score, path = max(((s + (self.step(k[1], k[0], "$") if k[1] else 0.0), p) for k, (s, p) in layer.items()), key=lambda x: x[0])
        out = []
        while path:
            out.append(path[0])
            path = path[1]
        found = unicodedata.normalize("NFC", "".join(reversed(out)))
        if len(self.cache) < 200_000:
            self.cache[token] = found
        return found

    def canonical(self, text: str | None) -> str | None:
        if text is None or PLAIN.fullmatch(text):
            return text
        return unicodedata.normalize("NFC", TOKEN.sub(lambda m: self.best(m.group()), normalize(text)))


def train(df: DataFrame, value: str) -> ScriptModel:
    """Count the bigrams of the column over all rows; the collected table is bounded by the alphabets, not by the data."""
    counts = (
        df.select(F.col(value).cast("string").alias("value"))
        .where("value is not null")
        .mapInPandas(count_ngrams, "script string, a string, b string, n long")
        .groupBy("script", "a", "b")
        .agg(F.sum("n").alias("n"))
    )
    return ScriptModel([(r.script, r.a, r.b, r.n) for r in counts.collect()])


def canonical_column(df: DataFrame, value: str, model: ScriptModel | None = None) -> Column:
    """A column with the canonical form of ``value``; trains the model on ``df`` when none is given."""
    shared = df.sparkSession.sparkContext.broadcast(model or train(df, value))

    @F.pandas_udf("string")
    def canonical(texts: pd.Series) -> pd.Series:
        forms = shared.value
        return texts.map(forms.canonical, na_action="ignore")

    return canonical(F.col(value).cast("string"))


def canonical_text(df: DataFrame, value: str, output: str = "canonical", model: ScriptModel | None = None) -> DataFrame:
    """``df`` with the column ``output``: the one consistent form of ``value``."""
    return df.withColumn(output, canonical_column(df, value, model))

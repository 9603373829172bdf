"""Records whose text was cut at a field limit or in transfer.

No labels are needed. From values that end as whole texts do, positives are made by cutting them at random places,
a part of them as if a field limit had been there, and negatives by ending them at one of their own line ends or by
writing their last sentence without its closing stop. A hashed logistic regression over closing characters, the
form of the last line, open brackets and marks, and the length left to the source's limit is fitted on them, and
then scores every record.

The fit uses at most ``sample_rows`` records (those with the smallest hash), the documented bound; of these only hashed
features come to the driver. Lengths, limits and scores cover all records.

Defined results: null and empty texts get no score and are no case; a text of any length is scored from its last
characters and counts over the whole of it; without a single whole text to learn from, nothing is found; a null source
is a source of its own.
"""

from __future__ import annotations

import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 15
STOP = re.compile(r"[.!?。]['\")\]”’]*$")
CUT_SIGN = re.compile(r"(?:\s*(?:\.{2,}|…|\[\s*(?:\.{2,}|…)\s*\]|\(\s*(?:\.{2,}|…)\s*\)))+\s*$")
MARKED = re.compile(r"\s*(?:[-*•]\s|\d+[.)]\s|#+\s|\||>|\$\$|[—\[(\"]|\*\*).{0,80}$")


def shape(text: str) -> str:
    """Character classes of a text: runs of Hangul, of lower and upper case letters, single digits, other characters as they are."""
    text = re.sub(r"[가-힣]+", "H", text)
    text = re.sub(r"[a-z]+", "a", text)
    return re.sub(r"\d", "0", re.sub(r"[A-Z]+", "A", text))


def features(text: str, chars_left: int, bytes_left: int) -> list[str]:
    """What the end of a text tells. ``chars_left``, ``bytes_left``: to the longest value of its source."""
    body = text.rstrip("\r\n")
    lines = body.rsplit("\n", 2)
    last = lines[-1]
    words = last.split()
    word = words[-1] if words else ""
    core = re.sub(r"\d", "0", word)
    form = shape(last[-40:])
    kind = re.match(r"\s*(?:[-*•]|\d+[.)]|#+|\||>|\$\$|—|\[|\(|\"|\*\*)?", last).group().strip()
    kind = "1." if kind[:1].isdigit() else kind
    stop = "stop" if STOP.search(body) and not CUT_SIGN.search(body) else "sign" if CUT_SIGN.search(body) else "open"
    same = lambda mark: body.count(mark) % 2
    near = "c0" if chars_left == 0 else "b3" if bytes_left <= 3 else "far"
    # the pipes of a table's row against the row before it
    pipes = last.count("|") - lines[-2].count("|") if kind == "|" and len(lines) > 1 and lines[-2].lstrip().startswith("|") else 0
    out = [
        f"stop:{stop}",
        f"kind:{kind}",
        f"end1:{kind}:{body[-1:]}",
        f"end2:{body[-2:]}",
        f"end3:{re.sub(r'[0-9]', '0', body[-3:])}",
        f"end4:{re.sub(r'[0-9]', '0', body[-4:])}",
        f"word:{kind}:{core}",
        f"two:{kind}:{re.sub(r'[0-9]', '0', ' '.join(words[-2:]))}" if kind else "prose",
        f"line:{re.sub(r'[0-9]', '0', last)}" if len(last) < 40 else "long",
        f"form:{kind}:{form}" if kind else f"form:{form[-6:]}",
        f"blank:{text[-1:] in ' 	'}",
        f"dollar:{body.count('$$') % 2}{body.replace('$$', '').count('$') % 2}",
        f"fence:{body.count('```') % 2}",
        f"bracket:{last.count('(') - last.count(')') > 0}{last.count('[') - last.count(']') > 0}{last.count('{') - last.count('}') > 0}",
        f"quote:{same(chr(34))}{body.count('**') % 2}",
        f"pipes:{pipes < 0}{last.rstrip().endswith('|') if kind == '|' else ''}",
        f"near:{near}",
        f"near:{near}:{stop}",
        f"broken:{body.endswith(chr(0xFFFD))}",
    ]
    return out


def vector(text: str, chars_left: int, bytes_left: int) -> list[int]:
    return [zlib.crc32(f.encode()) & ((1 << BITS) - 1) for f in features(text, chars_left, bytes_left)]


def is_whole(text: str) -> bool:
    """Whether a value ends as whole texts do: with a closing stop or in a marked line, and without a sign of a cut.

    A few of the marked lines are cut themselves; the cuts made inside such lines outnumber them in the fit.
    """
    last = text[text.rfind("\n") + 1 :]
    if text.count("$$") % 2 or last.count("(") > last.count(")") or last.count("**") % 2 or last.startswith("|") and not last.rstrip().endswith("|"):
        return False
    return bool(STOP.search(text) or MARKED.match(last)) and not CUT_SIGN.search(text)


def examples(text: str, chars_left: int, bytes_left: int, rng: random.Random) -> list[tuple[str, int, int, int]]:
    """(text, characters left, bytes left, label) made of one whole value."""
    out = [(text, chars_left, bytes_left, 0)] * 2
    ends = [m.start() for m in re.finditer(r"\n", text)]
    for e in rng.sample(ends, min(3, len(ends))):
        out.append((text[:e].rstrip(), chars_left + len(text) - e, 1 << 20, 0))
    if text.endswith("."):
        out.append((text.rstrip("."), chars_left, bytes_left, 0))
    nominal = re.sub(r"습니다\.$", "음", text)
    nominal = re.sub(r"(?<=[가-힣])다\.$", "음", nominal) if nominal == text else nominal
    if nominal != text:
        out.append((nominal, chars_left, bytes_left, 0))
    sentence_ends = {m.end() for m in re.finditer(r"[.!?。](?=\s|$)", text)}
    near_end = {e + d for e in sentence_ends for d in (-1, 0, 1)} | {e + d for e in [*ends, len(text)] for d in (0, 1)}
    free = [i for i in range(max(1, len(text) // 4), len(text)) if i not in near_end]
    # half of the cuts fall inside marked lines (lists, tables, formulas, headings), as they are short
    starts = [0, *(e + 1 for e in ends)]
    marked = [i for s, e in zip(starts, [*ends, len(text)]) if MARKED.match(text[s:e]) for i in range(s + 2, e) if i not in near_end]
    for k in range(4):
        if not free:
            break
        i = rng.choice(marked if marked and k % 2 else free)
        sign = rng.choice(["", "", "", "…", "...", " [...]", " …", "\N{REPLACEMENT CHARACTER}"])
        limit = rng.random() < 0.3
        out.append((text[:i] + sign, 0 if limit else chars_left + len(text) - i, 0 if limit else 1 << 20, 1))
    return out


class Scorer:
    """The fitted model: 2^BITS weights and a bias."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    def score(self, text: str, chars_left: int, bytes_left: int) -> float:
        z = self.bias + float(self.weights[vector(text, chars_left, bytes_left)].sum())
        return float(1 / (1 + np.exp(-max(-30.0, min(30.0, z)))))


def fit(x: np.ndarray, y: np.ndarray, seed: int = 7, epochs: int = 6) -> Scorer:
    """Logistic regression by AdaGrad over examples: hashed features of each, and whether it is cut."""
    if not len(y):
        return Scorer(np.zeros(1 << BITS), -30.0)
    w, bias = np.zeros(1 << BITS), 0.0
    g, gb = np.full(1 << BITS, 1e-6), 1e-6
    order = np.arange(len(y))
    shuffle = np.random.default_rng(seed)
    for _ in range(epochs):
        shuffle.shuffle(order)
        for i in range(0, len(order), 256):
            at = order[i : i + 256]
            p = 1 / (1 + np.exp(-np.clip(w[x[at]].sum(axis=1) + bias, -30, 30)))
            err = p - y[at]
            grad = np.bincount(x[at].ravel(), weights=np.repeat(err, x.shape[1]), minlength=1 << BITS) / len(at)
            seen = np.unique(x[at])
            step = grad[seen] + 1e-5 * w[seen]
            g[seen] += step**2
            w[seen] -= 0.3 * step / np.sqrt(g[seen])
            gb += err.mean() ** 2
            bias -= 0.3 * err.mean() / np.sqrt(gb)
    return Scorer(w, bias)


def make_examples(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Features and labels of the examples that whole values give; a value's own hash seeds its cuts. Texts stay in their tasks."""
    for pdf in batches:
        rows = []
        for text, seed, chars, octets in zip(pdf["_text"], pdf["_seed"], pdf["_chars_left"], pdf["_bytes_left"]):
            if is_whole(text):
                rows += [(seed, k, vector(t, c, b), label) for k, (t, c, b, label) in enumerate(examples(text, chars, octets, random.Random(int(seed))))]
        yield pd.DataFrame(rows, columns=["seed", "k", "x", "y"])


def score_truncation(df: DataFrame, keys: list[str], text: str, source: str, sample_rows: int = 6000, keep=lambda df: df) -> DataFrame:
    """(keys, source, p_cut) of every record with a non-empty text. ``keep`` should write down a table that is read several times."""
    rows = df.select(*keys, F.col(source).alias("_source"), F.col(text).alias("_text")).where("_text <> ''")
    rows = keep(rows.withColumns({"_chars": F.length("_text"), "_bytes": F.octet_length("_text"), "_seed": F.xxhash64("_text")}))
    limits = rows.groupBy("_source").agg(F.max("_chars").alias("_max_chars"), F.max("_bytes").alias("_max_bytes"))
    limits = limits.withColumnRenamed("_source", "_of")
    rows = rows.join(limits, F.col("_source").eqNullSafe(F.col("_of")), "left").drop("_of")
    rows = rows.withColumns({"_chars_left": F.col("_max_chars") - F.col("_chars"), "_bytes_left": F.col("_max_bytes") - F.col("_bytes")})
    stop = F.col("_text").rlike(r"[.!?。]$")
    part = lambda cond: rows.where(cond).orderBy("_seed", "_text").limit(sample_rows // 2).select("_text", "_seed", "_chars_left", "_bytes_left")
    sample = part(stop).unionByName(part(~stop & F.regexp_substr("_text", F.lit(r"[^\n]*$")).rlike(r"^\s*[-*•#|>$—\[(\"0-9]")))
    made = sample.mapInPandas(make_examples, "seed long, k int, x array<int>, y int").toPandas().sort_values(["seed", "k"], kind="stable")
    scorer = fit(np.array(made["x"].tolist(), dtype=np.int32), made["y"].to_numpy(float))
    shared = df.sparkSession.sparkContext.broadcast(scorer)

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = shared.value
        for texts, chars, octets in batches:
            yield pd.Series([model.score(*x) for x in zip(texts, chars, octets)], dtype="float64")

    return rows.select(*keys, F.col("_source").alias(source), score("_text", "_chars_left", "_bytes_left").alias("p_cut"))


def truncation_rates(scored: DataFrame, source: str, threshold: float = 0.5) -> DataFrame:
    """Records, cut records and their share of each source."""
    return scored.groupBy(source).agg(
        F.count("*").alias("n_records"),
        F.count_if(F.col("p_cut") >= threshold).alias("n_cut"),
        F.round(F.avg((F.col("p_cut") >= threshold).cast("double")), 6).alias("share_cut"),
    )

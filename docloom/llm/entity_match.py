"""Matching records of two tables that share no key.

Each record is a node joined to its attributes (title, authors) and these to tokens: letter sequences, hashed to a fixed
number of buckets, so that the vocabulary has a proven bound. Random walks go from a record through its attributes' tokens,
over a shared token to another record and on through its tokens. Skip-gram vectors of the tokens are trained on all walks.
An attribute's vector is the sum of its tokens' vectors, weighted by rarity and centred.

Blocking: an accepted pair is alike by the rules below, so it shares a part of its title together with a name, with a half of
a name, with a second name or with a year where names are missing, or the identifier (``record_keys``). Rows of keys carry
a sketch of the title's letter sequences; a pair whose second title holds more foreign sequences than two slips can make is
dropped in the join, so pairs that meet by a common beginning cost neither disk nor comparisons. What a record sends is
bounded by its names and does not grow with the number of records. (Tables of hyperplanes, ``block_keys`` and
``candidate_pairs``, are kept for vectors at hand; ``match_records`` does not use them, as the tables that a given recall
needs grow with the input.) The pairs that are left are compared exactly: titles with one slip, cut ends or a part left out,
names in any order, initials and slips; words that mark a follow-up part works. Of several works the best stays. The
confidence is the cosine, calibrated by a logistic fit on a bounded sample of the compared pairs (``sample_pairs``).

Defined results: a record without a title or with a null key matches nothing; a missing author list or year neither helps nor
hurts except that an equal title then needs a fitting year or identifier; copies of a record match alike.
"""

from __future__ import annotations

import itertools
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.llm.common import free_shuffles, spread

BUCKETS = 1 << 13  # of tokens, for each attribute
DIM = 48
LIKE_TITLE, LIKE_AUTHORS, LIKE_BOTH = 0.85, 0.4, 0.4
"""Least cosines of a candidate: of the titles alone, or of the authors and of the titles with them."""
BUCKET_ROWS, BITS = 720, 8  # rows meant for a bucket; the hash length up to which the given numbers of tables are enough
EXACT = 1 << 60  # keys from here on are of equal titles and identifiers
BEGINNING, MIDDLE, HALF, SHORT = 16, 12, 24, 34  # letters of keys: ends, what follows the beginning, ends with little else; titles that need shorter ends
FOREIGN = (10, 10, 10, 5, 5, 5, 10, 10)  # letter sequences that the second title may hold alone, of each kind of keys: what two slips change at most, or one
SLICE_PAIRS = 2  # pairs for each record that are compared at a time
SHARED = 4  # strongest directions that are taken out of the vectors
FOLLOW_UP = re.compile(r"\b(?:revisited|reloaded|reconsidered|continued|part (?:[ivx]+|[1-9]|one|two|three)|(?:a )?(?:second|third|closer|further|new) look(?: at \S+)?|[ivx]{2,4}|follow up|addendum|erratum)\b")
GREEK = {"alpha": "α", "beta": "β", "gamma": "γ", "delta": "δ", "epsilon": "ε", "theta": "θ", "lambda": "λ", "mu": "μ", "pi": "π", "sigma": "σ", "tau": "τ", "phi": "φ", "psi": "ψ", "omega": "ω"}


def plain(text: str) -> str:
    """Lower case without marks, tags, formulas' signs and notes in brackets."""
    text = re.sub(r"</?[A-Za-z][^<>]*>", "", text)
    text = re.sub(r"\$\s*\\?(\w+)\s*\$|\\(\w+)\b", lambda m: GREEK.get((m[1] or m[2]).lower(), m[1] or m[2]), text)
    text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).lower()
    text = re.sub(r"\[(?:preprint|in press|accepted|draft|poster|abstract)\]|\((?:extended abstract|preprint|extended version|short paper|poster|full version|draft)\)", " ", text)
    return text.replace("&amp;", "and").replace("&", " and ")


def title_form(title: str) -> tuple[str, str, bool]:
    """(words, letters only, whether a sign says that it was cut)."""
    text = plain(title).strip()
    note = re.search(r"[\[(]([^\[\]()]{1,24})[\])]?[\s*…]*$", text)
    letters = re.sub(r"[\W_]+", "", note[1]) if note else ""
    if letters and any(starts_with(full, letters) is not None or one_slip(full, letters) for full in ("extendedabstract", "preprint")):
        text = text[: note.start()]
    cut = bool(re.search(r"(?:…|\.\.\.)[\s*]*$", text))
    text = re.sub(r"[\s*]+$", "", re.sub(r"(?:…|\.{3})[\s*]*$", "", text))
    words = re.sub(r"[^\w:]+", " ", text.replace("-", "").replace("—", " ")).replace(":", " : ")
    words = re.sub(r"\s+", " ", words).strip(" :")
    return words, re.sub(r"[\W_]+", "", words), cut


def name_form(name: str) -> tuple[list[str], list[str], str]:
    """(whole names, initials, likely family name)."""
    text = plain(name)
    family_first = "," in text
    parts = [p for p in re.split(r"[\s,.]+", text) if p]
    whole, initials = [p for p in parts if len(p) > 1], [p for p in parts if len(p) == 1]
    family = (whole[0] if family_first or (parts and len(parts[-1]) == 1) else whole[-1]) if whole else ""
    return whole, initials, family


def one_slip(a: str, b: str) -> bool:
    """Equal, or apart by one letter or two exchanged neighbours."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i:] or a[i:] == b[i + 1 :] or a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])


def two_slips(a: str, b: str) -> bool:
    """Whether two slips at most turn one word into the other."""
    forms = {a[:i] + a[i + 1 :] for i in range(len(a))} | {a[:i] + a[i + 1] + a[i] + a[i + 2 :] for i in range(len(a) - 1)}
    forms |= {a[:i] + c + a[i + d :] for i in range(len(a)) for c in set(b) for d in (0, 1)}
    return any(one_slip(f, b) for f in forms)


def starts_with(a: str, b: str) -> int | None:
    """How much of ``a`` its beginning ``b`` covers, with at most one slip; None if it is no beginning."""
    if a.startswith(b):
        return len(b)
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    if i >= len(b) - 1:
        return min(len(a), len(b))
    for da, db, ok in ((1, 0, True), (0, 1, True), (1, 1, True), (2, 2, a[i : i + 2] == b[i : i + 2][::-1])):
        if ok and a[i + da :].startswith(b[i + db :]):
            return i + da + len(b) - i - db
    return None


def title_relation(a: tuple[str, str, bool], b: tuple[str, str, bool]) -> int:
    """3 the same, 2 the second is the first's beginning or its part before or after a colon, 0 different works."""
    if not a[1] or not b[1]:
        return 0
    if one_slip(a[1], b[1]):
        return 3 if bool(FOLLOW_UP.search(a[0])) == bool(FOLLOW_UP.search(b[0])) or a[1] == b[1] else 0
    if len(a[1]) > 30 and abs(len(a[1]) - len(b[1])) <= 2 and few_slips(a[0], b[0]):
        return 3
    if len(b[1]) >= 12 and len(b[1]) < len(a[1]):
        covered = starts_with(a[1], b[1])
        if covered is None and cut_with_slips(a[0], b[0]):
            covered = len(b[1])
        if covered is not None and not b[2] and FOLLOW_UP.search(rest_of(a[0], covered)):
            return 0
        if covered is not None:
            return 2
        if " : " in a[0]:
            tail = re.sub(r"[\W_]+", "", a[0].split(" : ", 1)[1])
            if one_slip(tail, b[1]) or (b[2] and starts_with(tail, b[1]) is not None):
                return 2
    return 0


def rest_of(words: str, covered: int) -> str:
    """The words after the first ``covered`` letters, from the end of the word in which they end."""
    seen = 0
    for i, c in enumerate(words):
        if seen >= covered and not c.isalnum():
            return words[i:]
        seen += c.isalnum()
    return ""


def slips(x: list[str], y: list[str]) -> int:
    """Words that are one slip apart; a great number when any two differ by more."""
    n = 0
    for p, q in zip(x, y):
        if p != q:
            if min(len(p), len(q)) < 3 or not one_slip(p, q):
                return 99
            n += 1
    return n


def few_slips(a: str, b: str) -> bool:
    """The same number of words, each equal or one slip apart, at most two of them unequal."""
    x, y = a.replace(" : ", " ").split(), b.replace(" : ", " ").split()
    return len(x) == len(y) and slips(x, y) <= 2


def cut_with_slips(a: str, b: str) -> bool:
    """The second is the first's beginning, its last word perhaps cut, with at most two words one slip apart."""
    x, y = a.replace(" : ", " ").split(), b.replace(" : ", " ").split()
    return 3 < len(y) <= len(x) and x[len(y) - 1].startswith(y[-1]) and slips(x[: len(y) - 1], y[:-1]) <= 2


def same_person(a: tuple[list[str], list[str], str], b: tuple[list[str], list[str], str]) -> bool:
    free = list(a[0])
    for name in b[0]:
        hit = next((x for x in free if x == name), None) or next((x for x in free if len(name) > 3 and one_slip(x, name)), None)
        if hit is None:
            return False
        free.remove(hit)
    if not b[0]:
        return False
    if len(b[0]) == 1 and b[1] and free:
        return any(x[0] == i for x in free for i in b[1]) or any(i in a[1] for i in b[1])
    return True


def author_agreement(a: list, b: list) -> float | None:
    """Share of the second list's persons that the first holds; None without names."""
    b = [x for x in b if x[0] and x[0] not in (["et", "al"], ["others"], ["and", "others"])]
    if not a or not b:
        return None
    return sum(any(same_person(x, y) for x in a) for y in b) / len(b)


def base_id(text: str | None) -> str | None:
    """An identifier without prefix, version and address."""
    m = re.search(r"(\d{4})\.?(\d{4,5})(?:v\d+)?\s*$", text or "")
    return f"{m[1]}.{m[2]}" if m else None


Form = tuple[tuple[str, str, bool], list[tuple[list[str], list[str], str]], int | None, str | None]
"""Title form, name forms, year and base identifier of a record, as ``compare`` takes them."""


def packed_form(title: str | None, names: list, ref: str | None) -> str:
    """All forms of a record in one text, so that they are made once and not for every pair."""
    words, letters, cut = title_form(title) if title else ("", "", False)
    people = [name_form(x) for x in names]
    # these two separators are blanks, at which names are split, so no name holds them
    shown = "\x1e".join(f"{' '.join(w)}\x1f{' '.join(i)}\x1f{f}" for w, i, f in people)
    return "\n".join([words, letters, "1" if cut else "", shown, base_id(ref) or ""])


def read_form(text: str, year: int | None) -> Form:
    words, letters, cut, shown, ref = text.split("\n")
    people = [tuple(x.split("\x1f")) for x in shown.split("\x1e")] if shown else []
    return (words, letters, bool(cut)), [(w.split(), i.split(), f) for w, i, f in people], year, ref or None


def tokens(letters: str, families: list[str]) -> tuple[list[int], list[int]]:
    """Token buckets of the title's letters and of the authors' family names."""
    grams = {letters[i : i + 4] for i in range(max(0, len(letters) - 3))}
    t = [zlib.crc32(g.encode()) % BUCKETS for g in grams]
    people: list[int] = []
    for k, family in enumerate(families):
        if family and family not in ("al", "others"):
            marked = f"^{family}$"
            grams = {marked[i : i + 3] for i in range(len(marked) - 2)} | {marked}
            people += [zlib.crc32(g.encode()) % BUCKETS + BUCKETS for g in grams] * (2 if k == 0 else 1)
    return sorted(t), people


def exact_keys(letters: str, own_id: str | None) -> list[int]:
    """Bucket of the normalised title and bucket of the base identifier."""
    return [EXACT * k + zlib.crc32(x.encode()) for k, x in ((1, letters), (2, own_id)) if x]


def tokenized(df: DataFrame) -> DataFrame:
    """``df`` (rid, title, authors, ref) with the columns t and a, its tokens, exact, its keys, and form."""

    @F.pandas_udf("struct<t:array<int>,a:array<int>,exact:array<long>,form:string>")
    def of(titles: pd.Series, authors: pd.Series, refs: pd.Series) -> pd.DataFrame:
        forms = [packed_form(t, [] if a is None else [x for x in a if x], r) for t, a, r in zip(titles, authors, refs)]
        read = [read_form(f, None) for f in forms]
        made = [tokens(title[1], [n[2] for n in names]) for title, names, _, _ in read]
        return pd.DataFrame({"t": [m[0] for m in made], "a": [m[1] for m in made], "exact": [exact_keys(r[0][1], r[3]) for r in read], "form": forms})

    return df.withColumn("_k", of("title", "authors", "ref")).select("*", "_k.t", "_k.a", "_k.exact", "_k.form").drop("_k")


def random_walks(records: DataFrame, length: int = 10) -> DataFrame:
    """A walk for each record: tokens of its attributes, a shared token, and tokens of the next record that holds it."""
    r = records.select("rid", "t", "a").where("size(t) > 0")
    order = lambda c: F.slice(F.transform(F.array_sort(F.transform(c, lambda x: F.struct(F.hash(x, F.col("rid")).alias("h"), x.alias("x")))), lambda s: s.x), 1, length)
    r = r.withColumns({"own": F.concat(order(F.col("t")), order(F.col("a")))})
    r = r.withColumn("via", F.element_at("own", F.pmod(F.xxhash64("rid"), F.size("own")).cast("int") + 1))
    # a token may be shared by a third of all rows: its records are walked in groups of bounded size
    groups = F.pmod(F.xxhash64("rid", F.lit(3)), F.greatest(F.lit(1), F.lit(records.count() // 5000)))
    next_own = F.lead("own").over(W.partitionBy("via", groups).orderBy(F.xxhash64("rid", F.lit(5)), "rid"))
    r = r.withColumn("walk", F.concat("own", F.when(next_own.isNotNull(), F.concat(F.array("via"), next_own)).otherwise(F.array().cast("array<int>"))))
    return r.select(F.transform("walk", lambda x: x.cast("string")).alias("walk"))


def train_vectors(records: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Token vectors by skip-gram over all walks, and the tokens' weights; both bounded by the number of buckets."""
    from pyspark.ml.feature import Word2Vec

    parts = min(8, records.sparkSession.sparkContext.defaultParallelism)
    model = Word2Vec(vectorSize=DIM, windowSize=3, minCount=0, maxIter=1, numPartitions=parts, stepSize=0.05, seed=5, inputCol="walk", outputCol="v").fit(random_walks(records))
    # an own direction of each token keeps tokens apart that walks always meet together
    own = np.random.default_rng(5).normal(size=(2 * BUCKETS, DIM)).astype(np.float32)
    own /= np.linalg.norm(own, axis=1, keepdims=True)
    vectors = own.copy()
    for word, vector in model.getVectors().collect():
        vectors[int(word)] = vector.toArray()
    seen = records.select(F.explode(F.array_distinct(F.concat("t", "a"))).alias("k")).groupBy("k").count().collect()
    total = records.count()
    often, weights = np.zeros(2 * BUCKETS), np.ones(2 * BUCKETS, dtype=np.float32)
    for k, n in seen:
        often[k], weights[k] = n, np.log(1 + total / n)
    for part in (slice(0, BUCKETS), slice(BUCKETS, 2 * BUCKETS)):
        v = vectors[part] / np.maximum(1e-9, np.linalg.norm(vectors[part], axis=1, keepdims=True))
        v = 0.5 * v + own[part]
        # what all records share would add up in their sums: the mean and the strongest directions are taken out
        w = (often[part] * weights[part])[:, None]
        v = v - (w * v).sum(axis=0) / max(1e-9, w.sum())
        _, axes = np.linalg.eigh((w * weights[part][:, None] * v).T @ v)
        strong = axes[:, -SHARED:]
        vectors[part] = v - (v @ strong) @ strong.T
    return vectors, weights


def attribute_vectors(texts: pd.Series, vectors: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Unit vectors of token lists."""
    out = np.zeros((len(texts), DIM), dtype=np.float32)
    for i, k in enumerate(texts):
        if len(k):
            out[i] = weights[k] @ vectors[k]
    return out


def table_counts(tables: tuple[int, int], bits: int) -> tuple[int, int]:
    """So many tables that pairs of the least cosines share a bucket of ``bits`` as often as one of BITS in ``tables``.

    Pairs that are more alike lose less by longer hashes, so they meet at least as often too.
    """
    meet = lambda cosine: 1 - np.arccos(cosine) / np.pi
    more = [np.log1p(-(p**BITS)) / np.log1p(-(p**bits)) for p in (meet(LIKE_BOTH), meet(LIKE_AUTHORS))]
    return tuple(int(np.ceil(n * max(1.0, x))) for n, x in zip(tables, more))


def block_keys(records: DataFrame, vectors: np.ndarray, weights: np.ndarray, tables: tuple[int, int], bits: int) -> DataFrame:
    """(rid, side, vt, va, keys): quantized unit vectors, the bucket of each table and the exact keys."""
    sc = records.sparkSession.sparkContext
    planes = np.random.default_rng(17).normal(size=(sum(tables), bits, DIM)).astype(np.float32)
    shared = sc.broadcast((vectors, weights, planes))
    kind = records.schema["rid"].dataType.simpleString()

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v, w, p = shared.value
        for pdf in batches:
            vt, va = attribute_vectors(pdf["t"], v, w), attribute_vectors(pdf["a"], v, w)
            keys = []
            for k in range(len(p)):
                x = vt if k < tables[0] else va
                code = ((x @ p[k].T) > 0) @ (1 << np.arange(bits))
                code = np.where(np.abs(x).sum(axis=1) > 0, code + (k << 32), -1)
                keys.append(code)
            unit = lambda x: np.round(127 * x / np.maximum(1e-9, np.linalg.norm(x, axis=1, keepdims=True))).astype(np.int8)
            yield pd.DataFrame(
                {"rid": pdf["rid"], "side": pdf["side"], "vt": [x.tobytes() for x in unit(vt)], "va": [x.tobytes() for x in unit(va)], "keys": [[*(y for y in x if y >= 0), *e] for x, e in zip(np.array(keys).T.tolist(), pdf["exact"])]}
            )

    return records.select("rid", "side", "t", "a", "exact").mapInPandas(make, f"rid {kind}, side int, vt binary, va binary, keys array<long>")


def compare_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs of each block with enough cosine, all pairs of exact keys; rows come sorted by block, and one block is held at a time."""

    names = ["ra", "rb", "cos_title", "cos_authors"]

    def pairs(rows: list[tuple], exact: bool) -> list[tuple]:
        a, b = [r for r in rows if r[0] == 0], [r for r in rows if r[0] == 1]
        if not a or not b:
            return []
        read = lambda side, k: np.frombuffer(b"".join(r[k] for r in side), dtype=np.int8).reshape(-1, DIM).astype(np.float32) / 127
        ct, ca = read(a, 2) @ read(b, 2).T, read(a, 3) @ read(b, 3).T
        i, j = np.nonzero(exact | (ct >= LIKE_TITLE) | ((ca >= LIKE_AUTHORS) & (ct >= LIKE_BOTH)))
        return [(a[x][1], b[y][1], t, u) for x, y, t, u in zip(i, j, ct[i, j].tolist(), ca[i, j].tolist())]

    now, rows = None, []
    for pdf in batches:
        found = []
        for key, block, side, rid, vt, va in zip(pdf["key"], pdf["block"], pdf["side"], pdf["rid"], pdf["vt"], pdf["va"]):
            if (key, block) != now:
                found += pairs(rows, now[0] >= EXACT) if rows else []
                now, rows = (key, block), []
            rows.append((side, rid, vt, va))
        yield pd.DataFrame(found, columns=names)
    yield pd.DataFrame(pairs(rows, now[0] >= EXACT) if rows else [], columns=names)


def candidate_pairs(keyed: DataFrame, keep, block_rows: int = 2000) -> DataFrame:
    """(ra, rb, cos_title, cos_authors) of the pairs that share a bucket and have enough cosine, or share an exact key."""
    kind = keyed.schema["rid"].dataType.simpleString()
    sizes = keyed.select("side", F.explode("keys").alias("key")).groupBy("key").agg(F.count_if(F.col("side") == 0).alias("na"), F.count_if(F.col("side") == 1).alias("nb"))
    hot = sizes.where((F.col("na") > block_rows) | (F.col("nb") > block_rows)).select(
        "key", F.ceil(F.col("na") / block_rows).cast("int").alias("ga"), F.ceil(F.col("nb") / block_rows).cast("int").alias("gb")
    ).where("ga > 0 and gb > 0")
    # at most one bucket in ``block_rows`` rows is hot; they are counted before they are sent to all tasks
    hot = keep(hot)
    hot = F.broadcast(hot) if hot.count() <= 50_000 else hot
    rows = keyed.select("rid", "side", "vt", "va", F.explode("keys").alias("key")).join(hot, "key", "left").fillna(1, ["ga", "gb"])
    own = F.pmod(F.xxhash64("rid", F.lit(23)), F.when(F.col("side") == 0, F.col("ga")).otherwise(F.col("gb"))).cast("int")
    others = F.sequence(F.lit(0), F.when(F.col("side") == 0, F.col("gb")).otherwise(F.col("ga")) - 1)
    rows = rows.withColumn("own", own).select("key", "side", "rid", "vt", "va", "gb", "own", F.explode(others).alias("other"))
    block = F.when(F.col("side") == 0, F.col("own") * F.col("gb") + F.col("other")).otherwise(F.col("other") * F.col("gb") + F.col("own"))
    n = max(rows.sparkSession.sparkContext.defaultParallelism * 2, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    blocks = rows.select("key", block.alias("block"), "side", "rid", "vt", "va").repartition(n, "key", "block").sortWithinPartitions("key", "block")
    found = blocks.mapInPandas(compare_blocks, f"ra {kind}, rb {kind}, cos_title double, cos_authors double")
    return found.groupBy("ra", "rb").agg(F.max("cos_title").alias("cos_title"), F.max("cos_authors").alias("cos_authors"))


def half_names(name: str) -> set[str]:
    """Parts of a name; two names that are one slip apart share one."""
    found = {name} | {name[:i] + name[i + 1 :] for i in range(len(name))} if len(name) <= 5 else set()
    if 5 <= len(name) <= 7:
        found |= {f"^{name[:2]}", f"{name[-2:]}$"}
    if len(name) >= 7:
        found |= {f"^{name[:3]}", f"{name[-3:]}$"}
    return found


def record_keys(form: Form, side: int, kind: int) -> set[str]:
    """What a record meets others by: beginnings (0), ends (1) and the middle (2) of its title with a person, beginnings (3) and ends (4)
    with a half of a person's name, both with that of a name alone (5); two names and the identifier (1); parts of its title with the
    year where names are missing (6); the beginning of a short title, that may be cut, in two parts with a person (7).

    A left person holds all names of the right one, so of the left side every whole name counts, of the right mostly the likely family name.
    """
    (words, letters, _), people, year, ref = form
    people = [p for p in people if p[0] and p[0] not in (["et", "al"], ["others"], ["and", "others"])]
    titles = [letters]
    if side == 0 and " : " in words:
        titles.append(re.sub(r"[\W_]+", "", words.split(" : ", 1)[1]))
    middles = lambda moved: {f"m{t[BEGINNING + d : BEGINNING + MIDDLE + d]}" for t in titles for d in moved if len(t) >= BEGINNING + MIDDLE + d}
    end = lambda n, at: f"{n}<{letters[:n]}" if at == 0 else f"{n}>{letters[-n:]}"
    # shorter ends where one slip could touch both
    sizes = [HALF, *(k for k, least, most in ((20, 41, 51), (16, 33, 43), (8, 0, 35)) if least <= len(letters) <= most)]
    if kind == 6:
        if year is None:
            return set()
        # one side without names meets the other in its own space of keys, and sends the years beside its own and moved middles
        ends = {end(k, at) for k in sizes for at in (0, 1)}
        found = {f"{side}{year}{e}" for e in ends | middles((0,))}
        return found if people else found | {f"{1 - side}{year + d}{e}" for d in (-1, 0, 1) for e in ends | middles(range(-2, 3))}

    def persons(parts) -> Iterator[str]:
        """Parts of a name with each first letter of the other names; a name alone has none, as the left side's family names too."""
        for whole, initials, family in people:
            for name in whole if kind == 1 or (side == 0 and kind in (0, 2, 7)) else [family]:
                free = [w for w in whole if w != name]
                others = {w[0] for w in free} | set(initials)
                if kind == 1:
                    others |= {f"{w[-1]}$" for w in free}  # where a slip is in the first letter
                alone = not others or (side == 0 and name == family)
                with_ = [] if kind == 5 else [*others]
                if alone and kind not in (3, 4):
                    with_.append("")
                yield from (f"{part}.{x}" for x in with_ for part in parts(name))

    if kind == 7:
        if side == 1 and len(letters) >= BEGINNING + MIDDLE + 2:
            return set()
        half = BEGINNING // 2
        ends = {f"<{t[:half]}" for t in titles} | {f"m{t[half + d : BEGINNING + d]}" for t in titles for d in ((0,) if side == 0 else range(-2, 3)) if len(t) >= BEGINNING + d}
        return {f"{p}|{e}" for p in persons(lambda name: (name,)) for e in ends}
    if kind >= 3:
        ends = [end(k, at) for k in sizes for at in ((kind - 3,) if kind < 5 else (0, 1))]
        return {f"{p}|{e}" for p in persons(half_names) for e in ends}
    if kind == 2:
        ends = middles((0,) if side == 0 else range(-2, 3))  # slips before the middle move it
    else:
        ends = {f"<{t[:BEGINNING]}" for t in titles} if kind == 0 else {end(BEGINNING, 1)}
        if len(letters) <= SHORT:
            ends.add(end(BEGINNING // 2, kind))
    found = {f"{p}|{e}" for p in persons(lambda name: (name,)) for e in ends}
    if kind == 1:
        families = list(dict.fromkeys(p[2] for p in people if p[2]))
        pairs = itertools.combinations(sorted(families), 2) if side == 0 else [sorted(families[:2])] if len(families) > 1 else []
        found |= {f"{x}&{y}" for x, y in pairs}
        if ref:
            found.add(f"#{ref}")
    return found


def sketches(t: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Two words of bits of each title's letter sequences."""
    sizes = np.array([len(x) for x in t], dtype=np.int64)
    out = np.zeros((2, len(t)), dtype=np.uint64)
    if sizes.sum():
        flat, row = np.concatenate(t.to_numpy()).astype(np.uint64), np.repeat(np.arange(len(t)), sizes)
        for k in (0, 1):
            some = (flat >> np.uint64(6)) & np.uint64(1) == k
            np.bitwise_or.at(out[k], row[some], np.uint64(1) << (flat[some] & np.uint64(63)))
    return out[0].view(np.int64), out[1].view(np.int64)


def key_rows(records: DataFrame, side: int, kind: int) -> DataFrame:
    """(key, rid, s0, s1) of one side's records: hashed keys and the sketch."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keys = [record_keys(read_form(f, None if y is None or y != y else int(y)), side, kind) for f, y in zip(pdf["form"], pdf["year"])]
            at = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
            flat = np.array(list(itertools.chain.from_iterable(keys)), dtype=object)
            hashed = pd.util.hash_array(flat, categorize=False).view(np.int64) if len(flat) else np.empty(0, dtype=np.int64)
            s0, s1 = sketches(pdf["t"])
            yield pd.DataFrame({"key": hashed, "rid": pdf["rid"].to_numpy()[at], "s0": s0[at], "s1": s1[at]})

    return records.where(F.col("side") == side).select("rid", "year", "t", "form").mapInPandas(make, "key long, rid long, s0 long, s1 long")


def key_pairs(records: DataFrame, keep) -> DataFrame:
    """(ra, rb) of the records that share a key and whose titles can be alike; a kind of keys is shuffled at a time."""
    found = None
    for kind, most in enumerate(FOREIGN):
        a, b = (key_rows(records, side, kind).toDF("key", name, f"{name}0", f"{name}1") for side, name in ((0, "ra"), (1, "rb")))
        foreign = lambda x, y: sum(F.bit_count(F.col(f"{x}{k}").bitwiseAND(F.bitwise_not(f"{y}{k}"))) for k in (0, 1))
        alike = foreign("rb", "ra") <= most
        if kind == 6:  # without names only equal titles match, so neither holds more than the other
            alike &= foreign("ra", "rb") <= most
        pairs = keep(a.join(b.hint("merge"), "key").where(alike).select("ra", "rb").distinct())
        found = pairs if found is None else found.unionByName(pairs)
    return found.distinct()


def compare(a: Form, b: Form) -> tuple[int, float, int, int, bool]:
    """(title relation, author agreement or -1, years apart or -1, equal identifiers, accepted) of two records.

    Of titles that tell of different works the authors are not compared.
    """
    relation = title_relation(a[0], b[0])
    apart = -1 if a[2] is None or b[2] is None else abs(a[2] - b[2])
    equal_id = int(a[3] is not None and a[3] == b[3])
    slip = None
    if relation == 0:
        # one long word with two slips, by the same people at the same time
        x, y = a[0][0].replace(" : ", " ").split(), b[0][0].replace(" : ", " ").split()
        odd = [(p, q) for p, q in zip(x, y) if p != q] if len(x) == len(y) else []
        if not (len(odd) == 1 and len(odd[0][0]) >= 8 and 0 <= apart <= 1):
            return 0, -1.0, apart, equal_id, False
        slip = odd[0]
    agree = author_agreement(a[1], b[1])
    if relation == 3:
        ok = agree >= 0.5 if agree is not None else equal_id or 0 <= apart <= 1
    elif relation == 2:
        ok = agree is not None and agree >= 0.75 and (apart <= 2 or equal_id == 1)
    else:
        ok = agree is not None and agree >= 0.75 and two_slips(*slip)
        relation = 1 if ok else 0
    return relation, -1.0 if agree is None else agree, apart, equal_id, bool(ok)


def match_records(left: DataFrame, right: DataFrame, sample_pairs: int = 20_000, keep=lambda df: df) -> DataFrame:
    """(left_id, right_id, confidence) of the records that describe the same work.

    left: id, work (versions of a work share it), title, authors, year. right: id, title, authors, year, ref (an
    identifier that may name the left work, wrong in places).
    """
    spark = left.sparkSession
    a = left.where("id is not null and title is not null").select("id", F.lit(0).alias("side"), "title", "authors", "year", F.coalesce("work", "id").alias("ref"))
    b = right.where("id is not null and title is not null").select("id", F.lit(1).alias("side"), "title", "authors", "year", "ref")
    # numbers made from the keys stand for them, so that two runs over the same rows make the same walks and blocks
    records = spread(a.unionByName(b), "side", "id").dropDuplicates(["side", "id"]).withColumn("rid", F.xxhash64("side", "id"))
    records = tokenized(records.sortWithinPartitions("rid")).withColumn("people", F.coalesce(F.size("authors") > 0, F.lit(False)))
    records = keep(records.select("rid", "side", "id", "year", "ref", "people", "t", "a", "form"))
    n = records.count()
    if not n:
        return spark.createDataFrame([], "left_id string, right_id string, confidence double")
    shared = spark.sparkContext.broadcast(train_vectors(records))
    free_shuffles(spark)
    pairs = keep(key_pairs(records, keep))
    side = lambda name: records.select(F.col("rid").alias(name), F.col("form").alias(f"{name}_form"), F.col("year").alias(f"{name}_year"), F.col("ref").alias(f"{name}_ref"), F.col("people").alias(f"{name}_people"))
    slices = 1 + pairs.count() // (SLICE_PAIRS * n)

    def rerank(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache: dict = {}
        vectors, weights = shared.value

        def unit(buckets: list[int]) -> np.ndarray:
            v = weights[buckets] @ vectors[buckets] if buckets else np.zeros(DIM, dtype=np.float32)
            return v / max(1e-9, float(np.sqrt(v @ v)))

        def form(key: int, text: str, year) -> tuple[Form, np.ndarray, np.ndarray]:
            found = cache.get(key)
            if found is None:
                if len(cache) > 50_000:
                    cache.clear()
                read = read_form(text, None if year is None or year != year else int(year))
                t, people = tokens(read[0][1], [p[2] for p in read[1]])
                found = cache[key] = read, unit(t), unit(people)
            return found

        for pdf in batches:
            out = []
            for ra, fa, ya, rb, fb, yb, people in zip(pdf["ra"].tolist(), pdf["ra_form"], pdf["ra_year"].tolist(), pdf["rb"].tolist(), pdf["rb_form"], pdf["rb_year"].tolist(), pdf["rb_people"].tolist()):
                x, y = form(ra, fa, ya), form(rb, fb, yb)
                title = float(x[1] @ y[1])
                out.append((0.5 * title + 0.5 * float(x[2] @ y[2]) if people else title, *compare(x[0], y[0])))
            made = pd.DataFrame(out, columns=["cosine", "relation", "agree", "apart", "same_id", "ok"])
            yield pd.concat([pdf[["ra", "rb"]].reset_index(drop=True), pdf["ra_ref"].rename("work").reset_index(drop=True), made], axis=1)

    # the forms of so many pairs are on the disk at a time; all pairs are compared
    judged = None
    for k in range(slices):
        some = pairs.where(F.pmod(F.xxhash64("rb", F.lit(29)), F.lit(slices)) == k)
        both = some.join(side("ra").drop("ra_people"), "ra").join(side("rb").drop("rb_ref"), "rb")
        part = keep(both.mapInPandas(rerank, "ra long, rb long, work string, cosine double, relation int, agree double, apart int, same_id int, ok boolean"))
        judged = part if judged is None else judged.unionByName(part)
    slope, offset = calibrate(judged.orderBy(F.xxhash64("ra", "rb")).limit(sample_pairs).select("cosine", "ok").toPandas())
    # of the works that fit a record of the right side only the best stays
    rank = F.struct("relation", "agree", "same_id", (-F.when(F.col("apart") < 0, 1).otherwise(F.col("apart"))).alias("near"), "cosine", "work")
    best = judged.where("ok").groupBy("rb").agg(F.max_by(F.struct("work", "cosine"), rank).alias("m")).select("rb", "m.work", "m.cosine")
    versions = records.where("side = 0").select(F.col("id").alias("left_id"), F.col("ref").alias("work"))
    names = records.where("side = 1").select(F.col("id").alias("right_id"), F.col("rid").alias("rb"))
    confidence = F.round(1 / (1 + F.exp(-(F.col("cosine") * slope + offset))), 6)
    return best.join(names, "rb").join(versions, "work").select("left_id", "right_id", confidence.alias("confidence"))


def calibrate(sample: pd.DataFrame) -> tuple[float, float]:
    """Slope and offset of the logistic curve of acceptance over the cosine, by Newton steps with a small prior."""
    x, y = sample["cosine"].to_numpy(float), sample["ok"].to_numpy(float)
    beta = np.array([0.0, 0.0])
    design = np.stack([x, np.ones_like(x)], axis=1)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        hessian = (design * (p * (1 - p))[:, None]).T @ design + np.eye(2) * 1e-3
        beta = beta + np.linalg.solve(hessian, design.T @ (y - p) - 1e-3 * beta)
    return float(beta[0]), float(beta[1])

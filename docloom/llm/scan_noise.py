"""Repair of text from scanned pages.

Furniture. The outermost lines of each page are compared with each other, with the title and the author names by fuzzy
matching of their letters; page numbers must follow the pages in sequence, in Arabic or Roman figures. Lines that stand at
page edges of several documents, but for one word and their digits, and not inside pages, are furniture too.

Line-end breaks. A word broken at a line end (over page edges and furniture as well) is rejoined when the corpus knows
the joined word better than the compound with its hyphen; a compound that the corpus knows keeps the hyphen.

Misread words. From every distinct word the words it may have been are made by a small table of confusions; when the
corpus has one of them far more often, the word is a misreading of it. The vocabulary, the candidates and the
occurrences meet in joins on words, so nothing of the vocabulary's size is sent to the driver or to all tasks.

Defined results: null texts have no lines; a text without page marks is one page; a section without its document is read
as one page of its own; lines in sections get the findings of the document's line they repeat; repeated rows count once.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.llm.common import spread

PAGE = re.compile(r"^\[PAGE \d+\]\s*$")
# What a recogniser makes of letters; read form and true form.
CONFUSIONS = [pair.split(">") for pair in "c>e 1>i 1>l 0>o 5>s 9>g 8>b 6>b b>h h>li cl>d d>cl rn>m m>rn ii>u vv>w rm>nn f>e o>a j>i".split()]
SKELETON = [("rn", "m"), ("vv", "w"), ("ii", "u"), ("cl", "d"), ("1", "l"), ("i", "l"), ("j", "l"), ("0", "o"), ("5", "s"), ("8", "b"), ("6", "b"), ("h", "b"), ("9", "g"), ("c", "e"), ("f", "e"), ("a", "o")]
HYPHEN_END = r"[\p{L}\p{N}] ?[-‐‑¬\x{AD}] ?$"
BREAK = r"^(.*?)\s?[-‐‑¬\x{AD}]\s*$"
EDGE_STRIP = r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$"
ROMAN = re.compile(r"[ivxlc]+")


def skeleton(text: str) -> str:
    """Letters and digits of a line, alike for what is easily confused."""
    text = "".join(ch for ch in text.lower() if ch.isalnum())
    for read, true in SKELETON:
        text = text.replace(read, true)
    return text


@lru_cache(maxsize=500_000)
def word_forms(word: str) -> tuple[str, str]:
    """The form of a word in a line's keys, and that with its letters hidden."""
    form = "#" if sum(map(str.isdigit, word)) * 2 > sum(map(str.isalnum, word)) else skeleton(word) or word
    return form, re.sub(r"[^\W_]+", "*", form, count=1)


def distance_within(a: str, b: str, most: int) -> bool:
    """Whether the edit distance is at most ``most``; only cells that near the diagonal are worked out."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > most:
        return False
    far = most + 1
    row = [j if j <= most else far for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        lo, hi = max(1, i - most), min(len(b), i + most)
        new = [far] * (len(b) + 1)
        new[0] = i if i <= most else far
        for j in range(lo, hi + 1):
            new[j] = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != b[j - 1]))
        if min(new[lo - 1 : hi + 1]) > most:
            return False
        row = new
    return row[-1] <= most


def slips_allowed(a: int, b: int) -> int:
    """The edit distance up to which two forms of these lengths are alike."""
    return max(a, b) // 8 + (min(a, b) > 3)


def alike(a: str, b: str) -> bool:
    return bool(a) and bool(b) and distance_within(a, b, slips_allowed(len(a), len(b)))


def with_partner(forms: dict[str, set[int]]) -> set[str]:
    """The forms that stand on two pages, or are alike to a form on another page.

    Of two forms with k slips one has at least one of k + 1 pieces of the other at nearly the same place. So forms are
    looked up by their pieces, and not compared with all others.
    """
    out = {f for f, pages in forms.items() if len(pages) > 1}
    places: dict[int, dict[str, list[tuple[int, str]]]] = {}
    for form, pages in forms.items():
        if form in out:
            continue
        n = len(form)
        longest = next(m for m in range(n + n // 7 + 2, n - 1, -1) if m - n <= slips_allowed(n, m))
        k = slips_allowed(n, longest)
        size = max(1, n // (k + 1))
        if size not in places:
            places[size] = {}
            for f in forms:
                for at in range(len(f) - size + 1):
                    places[size].setdefault(f[at : at + size], []).append((at, f))
        near = {f for piece in range(k + 1) for at, f in places[size].get(form[piece * size : (piece + 1) * size], ()) if abs(at - piece * size) <= k and f != form}
        if any(forms[f] != pages and alike(form, f) for f in near):
            out.add(form)
    return out


def roman(n: int) -> str:
    out = ""
    for value, sign in ((100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")):
        out += sign * (n // value)
        n %= value
    return out


def roman_value(text: str) -> int | None:
    return next((n for n in range(1, 200) if roman(n) == text), None) if ROMAN.fullmatch(text) else None


NUMBER_LINE = re.compile(
    r"^\W*(?:page|p\.|pg\.)?\s*(?P<a>\w{1,9})(?:\s*(?:of|/)\s*(?P<of>\w{1,4}))?\W*$|^\W*(?P<b>\w{1,9})(?:\s*[|·•]\s+|\s{2,})[^\W\d][^=]*$|^[^\W\d][^=]*(?:\s[|·•]\s*|\s{2,})(?P<c>\w{1,9})$", re.I
)
WITH_NUMBER = re.compile(r"^\W*\w{1,9}(?:\s*[|·•]\s+|\s{2,})(?=[^\W\d])|(?<=\w)\W*(?:\s[|·•]\s*|\s{2,})\w{1,9}$")
DIGIT_LIKE = str.maketrans("lIi|OoSsBZgqG", "1111005582996")


def number_readings(line: str) -> list[tuple[str, int]]:
    """(style, value) that a line may have as a page number."""
    m = NUMBER_LINE.match(line.strip())
    if not m or len(line) > 90:
        return []
    token = m["a"] or m["b"] or m["c"]
    whole = bool(m["of"]) or line.strip().lower().startswith("page")
    out = []
    digits = token.translate(DIGIT_LIKE)
    if digits.isdigit() and (token.isdigit() or len(token) <= 4) and len(digits) <= 4:
        out.append(("page" if whole else "digits", int(digits)))
    low = token.lower().replace("1", "l" if token[:1] == "1" and len(token) > 1 and token[1:2] in "xvi" and "x" in token else "i").replace("|", "i")
    for form in {low, low.replace("j", "i"), low.replace("y", "v")}:
        value = roman_value(form)
        if value:
            out.append(("roman", value))
    return out


class Layout:
    """The lines of a text with their pages."""

    def __init__(self, raw: str):
        self.lines = raw.split("\n")
        self.page, page = [], -1
        self.pages: list[list[int]] = []
        for k, line in enumerate(self.lines):
            if PAGE.match(line):
                page += 1
                self.pages.append([])
                self.page.append(-1)
                continue
            if page < 0:
                page = 0
                self.pages.append([])
            self.page.append(page)
            if line.strip():
                self.pages[page].append(k)
        self.numbers = self.page_numbers()

    def page_numbers(self) -> set[int]:
        """Lines that are page numbers: outermost lines whose values follow the pages."""
        votes: Counter = Counter()
        readings: dict[int, list[tuple[str, int, int]]] = {}
        for p, rows in enumerate(self.pages):
            for where, k in {("top", rows[0]), ("end", rows[-1])} if rows else ():
                if where == "top" and p == 0 and len(self.pages) > 1:
                    continue
                for style, value in number_readings(self.lines[k]):
                    readings.setdefault(k, []).append((where, style, value - p))
        for found in readings.values():
            votes.update(set(found))
        kept = {key for key, n in votes.items() if n >= 2 or key[1] == "page" or (key[2] == 1 and key[1] in ("digits", "roman"))}
        return {k for k, found in readings.items() if kept & set(found)}

    def outer(self, known: set[int]) -> list[tuple[int, str]]:
        """(line, 'top' or 'end') of the outermost lines of each page beside ``known`` ones."""
        out = []
        for p, rows in enumerate(self.pages):
            inner = [k for k in rows if k not in known]
            if inner and p > 0:
                out.append((inner[0], "top"))
            if len(inner) > 1:
                out.append((inner[-1], "end"))
        return out

    def front(self) -> tuple[str, list[str]]:
        """Skeletons of the title, and of the running forms of the author names."""
        head = []
        for k in self.pages[0][:5] if self.pages else []:
            if re.match(r"\W*abstract\b", self.lines[k], re.I):
                break
            head.append(self.lines[k])
        title = skeleton(" ".join(head))
        names = []
        for line in head[1:4]:
            last = [re.sub(r"[*†‡\d]+", "", a).split()[-1] for a in re.split(r",|\band\b|&", line) if a.split() and re.sub(r"[*†‡\d]+", "", a).split()]
            if last:
                names += [last[0], f"{last[0]} et al", " and ".join(last[:2]), " and ".join(last), " ".join(last)]
        return title, [skeleton(n) for n in names]

    def repeated_edges(self) -> tuple[dict[int, bool], set[int]]:
        """(outermost lines that repeat the title or author names (True), or an outermost line of another page (False); all outermost lines).

        What is found is taken off the page and the lines under it are looked at in turn, so headers may have several lines.
        """
        title, names = self.front()
        out: dict[int, bool] = {}
        edges: set[int] = set()
        seen: set[int] = set()
        while True:
            outer = self.outer(self.numbers | set(out))
            new = [(k, w) for k, w in outer if k not in seen]
            if not new:
                return out, edges
            edges |= edges or {k for k, _ in outer}
            seen |= {k for k, _ in new}
            before = len(out)
            forms = {k: skeleton(re.sub(r"\d", "", self.lines[k])) or skeleton(self.lines[k]) for k, _ in outer}
            pages: dict[str, dict[str, set[int]]] = {"top": {}, "end": {}}
            for k, w in outer:
                if len(forms[k]) >= 4:
                    pages[w].setdefault(forms[k], set()).add(self.page[k])
            repeated = {w: with_partner(p) for w, p in pages.items()}
            for k, w in new:
                line = self.lines[k].strip()
                for whole in {skeleton(line), skeleton(WITH_NUMBER.sub("", line))}:
                    if self.page[k] > 0 and len(whole) >= 4 and (any(alike(whole, title[: len(whole) + d]) for d in (0, 1, -1)) or any(alike(whole, n) for n in names)):
                        out[k] = True
                if k not in out and forms[k] in repeated[w]:
                    out[k] = False
            if len(out) == before:
                return out, edges


def edge_keys(line: str) -> list[tuple[int, int]]:
    """(hash, hidden words) of the line with its numbers hidden and letters folded that are easily confused, and of that with one more word hidden."""
    words = re.sub(r"(?<=[^\W\d][.,])(?=[^\W\d])", " ", line.lower()).split()
    if not words:
        return []
    pairs = [word_forms(w) for w in words]
    words = [form for form, _ in pairs]
    whole = " ".join(words)
    forms = {whole: whole.count("*")}
    if 2 <= len(words) <= 9:
        for i in range(len(words)):
            form = " ".join([*words[:i], pairs[i][1], *words[i + 1 :]])
            forms.setdefault(form, form.count("*"))
    return [(xxhash.xxh64_intdigest(f) - (1 << 63), n) for f, n in forms.items()]


def parse_documents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row for each line that is not blank or a page mark: document, part, line, text, state and the keys of its forms.

    state: 2 page number or title or names, 1 repeated at an edge of this document, 0 at an edge, -1 inside a page.
    """
    for pdf in batches:
        rows = []
        for doc, part, raw in zip(pdf["doc"], pdf["part"], pdf["raw"]):
            layout = Layout(raw)
            repeated, edges = layout.repeated_edges()
            for k, line in enumerate(layout.lines):
                if layout.page[k] >= 0 and line.strip():
                    state = 2 if k in layout.numbers or repeated.get(k) else 1 if k in repeated else 0 if k in edges else -1
                    rows.append((doc, part, k, line, state, edge_keys(line)))
            if len(rows) > 20_000:
                yield pd.DataFrame(rows, columns=["doc", "part", "line_no", "line", "state", "keys"])
                rows = []
        yield pd.DataFrame(rows, columns=["doc", "part", "line_no", "line", "state", "keys"])


def variants(word: str) -> list[str]:
    """What a recogniser may have read as ``word``: one confusion undone, or several of digits."""
    out = set()
    level = {word}
    for _ in range(3 if re.search(r"\d", word) else 1):
        level = {w[:i] + true + w[i + len(read) :] for w in level for read, true in CONFUSIONS for i in range(len(w)) if w.startswith(read, i)}
        out |= level
    return sorted(v for v in out if v != word and not re.search(r"\d", v))


def word_variants(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for word, n in zip(pdf["word"], pdf["n"]):
            letters = sum(c.isalpha() for c in word)
            digit = letters < len(word.replace("-", ""))
            if 2 <= len(word) <= 40 and (letters >= 1 if digit else letters >= 3) and not (digit and letters < 2 and len(word) > 2):
                rows += [(word, n, digit, v) for v in variants(word)]
        yield pd.DataFrame(rows, columns=["word", "n", "digit", "variant"])


class PageNoise:
    """The findings over a table of documents, and of sections that repeat their lines.

    documents: doc, raw. sections: doc, part, raw (or None). Attributes: ``furniture``, ``corrections`` and ``findings``
    (doc, line_no, noise_kind, read, true) of documents, ``places`` of section lines. What several steps read is written once.
    """

    def __init__(self, documents: DataFrame, sections: DataFrame | None, keep):
        docs = documents.where("raw is not null").distinct().withColumn("part", F.lit(-1))
        if sections is not None:
            lone = sections.where("raw is not null").distinct().join(docs.select("doc").distinct(), "doc", "left_anti")
            docs = docs.unionByName(lone.select("doc", "raw", "part"))
        kind = documents.schema["doc"].dataType.simpleString()
        self.docs, self.sections = docs, sections
        docs = spread(docs, "doc", "part")
        lines = keep(docs.mapInPandas(parse_documents, f"doc {kind}, part int, line_no int, line string, state int, keys array<struct<key:long,hidden:int>>"))
        # forms of edge lines, and how often these stand at edges and inside pages
        edge = lines.where("state in (0, 1)").select("doc", "part", "line_no", "line", "state", F.inline("keys"))
        seen = lines.select((F.col("state") < 0).alias("inside"), F.explode("keys.key").alias("key")).groupBy("key").agg(F.count_if(~F.col("inside")).alias("at_edges"), F.count_if("inside").alias("inside")).where("at_edges > 0")
        known = edge.join(seen, "key").groupBy("doc", "part", "line_no").agg(
            F.first("line").alias("line"), F.first("state").alias("state"),
            F.max((F.col("at_edges") >= 3) & (F.col("inside") * 10 <= F.col("at_edges"))).alias("common"), F.min_by("inside", "hidden").alias("seen_inside"),
        )
        found = known.where("common or (state = 1 and seen_inside = 0)").select("doc", "part", "line_no", "line")
        self.furniture = keep(found.unionByName(lines.where("state = 2").select("doc", "part", "line_no", "line")))
        off = self.furniture.groupBy("doc", "part").agg(F.collect_set("line_no").alias("off"))
        body = lines.select("doc", "part", "line_no", "line").join(off, ["doc", "part"], "left")
        self.body = keep(self._words_and_breaks(body.where("off is null or not array_contains(off, line_no)").drop("off")))
        self.findings = self._findings(keep)

    @staticmethod
    def _words_and_breaks(body: DataFrame) -> DataFrame:
        """(doc, part, line_no, whole, cut) of text lines: their whole words, and the word that is broken at their end."""
        in_text = W.partitionBy("doc", "part").orderBy("line_no")
        body = body.withColumns({"next": F.lead("line").over(in_text), "next_no": F.lead("line_no").over(in_text), "before": F.lag("line").over(in_text)})
        broken = lambda c: F.col(c).rlike(HYPHEN_END)
        tokens = F.split(F.trim(F.regexp_replace("line", r"\s+", " ")), " ")
        body = body.withColumns({"breaks": F.coalesce(broken("line") & F.col("next").isNotNull(), F.lit(False)), "continues": F.coalesce(broken("before"), F.lit(False)), "tokens": tokens})
        # the parts of a broken word are words only together
        last = F.when(F.col("breaks"), F.size("tokens") - F.when(F.col("line").rlike(r" [-‐‑¬\x{AD}]\s*$"), 2).otherwise(1)).otherwise(F.size("tokens"))
        first = F.when(F.col("continues"), 2).otherwise(1)
        whole = F.slice("tokens", first, F.greatest(F.lit(0), last - first + 1))
        left = F.regexp_extract(F.regexp_extract("line", BREAK, 1), r"(\S+)$", 1)
        right = F.regexp_extract(F.ltrim("next"), r"^(\S+)", 1)
        cut = F.struct("next_no", left.alias("left"), right.alias("right"), F.regexp_extract("line", r"([-‐‑¬\x{AD}])\s*$", 1).alias("sign"))
        return body.select("doc", "part", "line_no", whole.alias("whole"), F.when(F.col("breaks"), cut).alias("cut"))

    def _findings(self, keep) -> DataFrame:
        clean = lambda c: F.regexp_replace(F.lower(c), EDGE_STRIP, "")
        words = self.body.select("doc", "part", "line_no", F.explode("whole").alias("token")).select("doc", "part", "line_no", "token", clean(F.col("token")).alias("word")).where("word <> ''")
        # equal tokens are cleaned once
        tokens = self.body.select(F.explode("whole").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
        vocabulary = keep(tokens.select(clean(F.col("token")).alias("word"), "n").where("word <> ''").groupBy("word").agg(F.sum("n").alias("n")))

        cuts = self.body.where("cut is not null").select("doc", "part", "line_no", "cut.*")
        cuts = cuts.withColumns({"joined": clean(F.concat("left", "right")), "compound": clean(F.concat_ws("-", "left", "right"))})
        count_of = lambda name: vocabulary.select(F.col("word").alias(name), F.col("n").alias(f"n_{name}"))
        cuts = cuts.join(count_of("joined"), "joined", "left").join(count_of("compound"), "compound", "left").fillna(0, ["n_joined", "n_compound"])
        # neither known: names and numbers keep their hyphen, other words were broken
        unknown = ~F.col("right").rlike(r"^[\p{Lu}\p{N}]") & ~F.col("left").rlike(r"\p{N}$")
        rejoin = F.col("sign").isin("¬", "­") | F.when((F.col("n_joined") == 0) & (F.col("n_compound") == 0), unknown).otherwise(F.col("n_joined") >= F.col("n_compound"))
        cuts = keep(cuts.withColumn("rejoin", rejoin))

        # misread: distinct words against the vocabulary, broken words as the joined word
        asked = vocabulary.unionByName(
            cuts.where("n_joined = 0 and n_compound = 0").select(F.explode(F.array("joined", "compound")).alias("word"), F.lit(1).cast("long").alias("n"))
        ).groupBy("word").agg(F.sum("n").alias("n"))
        made = asked.mapInPandas(word_variants, "word string, n long, digit boolean, variant string")
        made = made.join(vocabulary.select(F.col("word").alias("variant"), F.col("n").alias("n_variant")), "variant")
        likely = (F.col("n_variant") >= 3) & (F.col("n_variant") >= F.col("n") * F.when(F.col("digit"), 3).otherwise(10))
        self.corrections = keep(made.where(likely).groupBy("word").agg(F.max_by("variant", F.struct("n_variant", "variant")).alias("true")))
        # their number is measured: up to a bound they go to all tasks, beyond it words meet them in a join
        few = self.corrections.count() <= 200_000
        corrections = F.broadcast(self.corrections) if few else self.corrections

        wrong = words.join(corrections, "word").select("doc", "part", "line_no", F.lit("misread").alias("noise_kind"), F.col("token").alias("read"), "true")
        split_wrong = (
            cuts.where("n_joined = 0 and n_compound = 0")
            .withColumn("word", F.explode(F.array("joined", "compound")))
            .join(corrections, "word")
            .select("doc", "part", "line_no", "next_no", "left", "right", "word", "true")
        )
        parts = split_wrong.withColumns({"l": F.lower("left"), "at": F.length("left")})
        on_first = ~F.col("true").startswith(F.col("l"))
        on_next = ~F.expr("right(true, length(regexp_replace(lower(right), '[^\\\\p{L}\\\\p{N}-]+$', ''))) = regexp_replace(lower(right), '[^\\\\p{L}\\\\p{N}-]+$', '')")
        split_rows = parts.select(
            "doc", "part", F.explode(F.array(F.when(on_first, F.col("line_no")), F.when(on_next, F.col("next_no")))).alias("line_no"),
            F.lit("misread").alias("noise_kind"), F.concat_ws(" ", "left", "right").alias("read"), "true",
        ).where("line_no is not null")
        rejoined = F.coalesce("true", F.col("joined"))
        hyphens = (
            cuts.where("rejoin").join(corrections.withColumnRenamed("word", "joined"), "joined", "left")
            .select("doc", "part", "line_no", F.lit("hyphen").alias("noise_kind"), F.concat_ws(" ", "left", "right").alias("read"), rejoined.alias("true"))
        )
        edges = self.furniture.select("doc", "part", "line_no", F.lit("furniture").alias("noise_kind"), F.col("line").alias("read"), F.lit("").alias("true"))
        return keep(edges.unionByName(hyphens).unionByName(wrong).unionByName(split_rows))

    def places(self) -> DataFrame:
        """(doc, part, part_line, line_no): which line of the document each section line repeats."""
        kind = self.docs.schema["doc"].dataType.simpleString()
        parts = self.sections.where("raw is not null").distinct().groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("part", "raw"))).alias("parts"))
        both = self.docs.where("part = -1").select("doc", "raw").join(parts, "doc")

        def align(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                rows = []
                for doc, raw, own in zip(pdf["doc"], pdf["raw"], pdf["parts"]):
                    lines = raw.split("\n")
                    where: dict[str, list[int]] = {}
                    for k, line in enumerate(lines):
                        where.setdefault(line, []).append(k)
                    at = 0
                    for piece in own:
                        for j, line in enumerate(piece["raw"].split("\n")):
                            if not line.strip():
                                continue
                            k = next((x for x in where.get(line, []) if x >= at), None)
                            if k is not None:
                                rows.append((doc, piece["part"], j, k))
                                at = k + 1
                yield pd.DataFrame(rows, columns=["doc", "part", "part_line", "line_no"])

        return both.mapInPandas(align, f"doc {kind}, part int, part_line int, line_no int")

    def all_findings(self) -> DataFrame:
        """(doc, part, line_no, noise_kind, read, true) of documents (part -1) and sections."""
        if self.sections is None:
            return self.findings
        own = self.findings.where("part = -1").drop("part")
        moved = self.places().join(own, ["doc", "line_no"]).select("doc", "part", F.col("part_line").alias("line_no"), "noise_kind", "read", "true")
        return self.findings.unionByName(moved)

    def repaired(self) -> DataFrame:
        """(doc, part, text): continuous paragraphs of documents and sections."""
        found = self.all_findings().groupBy("doc", "part").agg(F.collect_list(F.struct("line_no", "noise_kind", "read", "true")).alias("found"))
        texts = self.docs.where("part = -1").select("doc", "part", "raw")
        if self.sections is not None:
            texts = texts.unionByName(self.sections.where("raw is not null").distinct().select("doc", "part", "raw"))
        kind = self.docs.schema["doc"].dataType.simpleString()

        def mend(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                out = [(d, p, repair(r, [] if f is None else list(f))) for d, p, r, f in zip(pdf["doc"], pdf["part"], pdf["raw"], pdf["found"])]
                yield pd.DataFrame(out, columns=["doc", "part", "text"])

        return texts.join(found, ["doc", "part"], "left").mapInPandas(mend, f"doc {kind}, part int, text string")


def like_case(true: str, read: str) -> str:
    core = re.sub(r"^\W+|\W+$", "", read)
    if core.isupper() and len(core) > 1:
        return true.upper()
    return true[:1].upper() + true[1:] if core[:1].isupper() else true


def mended(now: str, line: str, broken: list[tuple[str, str]]) -> str:
    """``now`` and the line that goes on in its last word, with the word put right if it was misread.

    ``broken``: (both parts with a space between, the word in its true form).
    """
    for read, true in broken:
        left, _, right = read.partition(" ")
        head = re.sub(r"[-‐‑]$", "", now)
        if not head.endswith(left) or not line.startswith(right):
            continue
        whole = now[len(head) - len(left) :] + right
        core = re.sub(r"^[\W_]+|[\W_]+$", "", whole)
        if core.lower() != true:
            return now[: len(head) - len(left)] + whole.replace(core, like_case(true, core), 1) + line[len(right) :]
    return now + line


def repair(raw: str, found: list) -> str:
    """The text without furniture, with words rejoined and misread words put right, in paragraphs."""
    by_line: dict[int, dict[str, list]] = {}
    for f in found:
        by_line.setdefault(f["line_no"], {}).setdefault(f["noise_kind"], []).append((f["read"], f["true"]))
    paragraphs, now, glue = [], "", False
    broken: list[tuple[str, str]] = []
    lines = raw.split("\n")
    for k, line in enumerate(lines):
        own = by_line.get(k, {})
        if "furniture" in own or PAGE.match(line):
            continue
        line = line.strip()
        if not line:
            edge = any(PAGE.match(x) or "furniture" in by_line.get(j, {}) for j, x in list(enumerate(lines))[max(0, k - 2) : k + 3])
            if not edge and now and not glue:
                paragraphs.append(now)
                now = ""
            continue
        for read, true in own.get("misread", []):
            if read and " " not in read:
                core = re.sub(r"^[\W_]+|[\W_]+$", "", read)
                line = line.replace(core, like_case(true, core), 1)
        split = [x for x in own.get("misread", []) if x[0] and " " in x[0]]
        now = mended(now, line, broken + split) if glue else f"{now} {line}".strip()
        broken = own.get("hyphen", []) + split
        glue = False
        if "hyphen" in own:
            now, glue = re.sub(r"\s?[-‐‑¬­]\s*$", "", now), True
        elif re.search(r"\w[-‐‑]$", now):
            glue = True
        elif len(line) < 40 and not re.search(r"[.,;:!?]$", line) and now == line:
            paragraphs.append(now)
            now = ""
    return "\n\n".join([*paragraphs, now] if now else paragraphs)

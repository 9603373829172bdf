"""Small cases, edges and brute-force comparisons of the corpus operators."""

import random
import re
import time

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from docloom.llm.common import cut_lineage
from docloom.llm import contamination as C
from docloom.llm import entity_match as X
from docloom.llm import lookalike as L
from docloom.llm import packing as P
from docloom.llm import residue as R
from docloom.llm import scan_noise as N
from docloom.llm import sentence_align as A
from docloom.llm import splitting as S
from docloom.llm import truncation as U


keep = cut_lineage


# 1 look-alikes


def test_canonical_text(spark):
    plain = ["tidal prompt", "folded anchor", "x² margin", "조석 프롬프트", "Kovač prompt", "Жидкий filter", "β-probe", "アンカー window", "é-beam", "top₃ voter"] * 30
    odd = {
        "tidаl prοmpt": "tidal prompt", "ｆｏｌｄｅｄ　ａｎｃｈｏｒ": "folded anchor", "х² margin": "x² margin", "조​석 프롬프트": "조석 프롬프트",
        "Kovač prompt": "Kovač prompt", "Жидкий filter": None, "anchored ﬁlter": "anchored filter", "a‑b": "a-b", "조": "조",
    }
    rows = [(i, v, "x") for i, v in enumerate([*plain, *odd, None, ""])]
    df = spark.createDataFrame(rows, "id long, value string, canonical string")
    got = {r.value: r.canonical for r in L.canonical_text(df, "value").collect()}
    assert all(got[v] == v for v in plain)
    assert all(got[a] == b for a, b in odd.items() if b)
    assert got[None] is None and got[""] == ""
    long = "tidаl " * 20_000
    assert L.train(df, "value").canonical(long) == "tidal " * 20_000
    assert L.canonical_text(df.limit(0), "value").count() == 0


def test_joiners_stay_where_they_show():
    assert L.drop_ignorable("👩‍👩") == "👩‍👩" and L.drop_ignorable("a‍b") == "ab"


# 2 truncation


def sentences(rng, n):
    names = ["Alpha", "Betano", "Gamik", "Delor"]
    forms = ["{}의 오차를 {}% 줄였다.", "{} 자료는 {}개 묶음으로 나뉘었다.", "그림 {}은 {}의 방식을 보였다.", "표본 {}개로 {}을 조정하였습니다."]
    return " ".join(rng.choice(forms).format(rng.choice(names), rng.randint(1, 99)) for _ in range(n))


def test_truncation(spark):
    rng = random.Random(1)
    whole = [sentences(rng, rng.randint(3, 8)) for _ in range(700)]
    whole = [t + "\n- 재현율: 5%d.%d" % (i % 10, i % 7) if i % 5 == 0 else t for i, t in enumerate(whole)]
    cut = [t[: rng.randint(30, len(t) - 8)] for t in whole[:150]]
    cut = [t if not re.search(r"[.다]$", t) else t + " 그" for t in cut]
    rows = [(i, t, "a" if i % 3 else None, 0) for i, t in enumerate(whole + cut)] + [(9998, None, "a", 0), (9999, "", "a", 0)]
    df = spark.createDataFrame(rows, "id long, text string, source string, p_cut int")
    p = {r.id: r.p_cut for r in U.score_truncation(df, ["id"], "text", "source").collect()}
    assert set(p) == set(range(len(whole + cut)))
    assert np.mean([p[i] < 0.5 for i in range(len(whole))]) > 0.97
    assert np.mean([p[i] >= 0.5 for i in range(len(whole), len(p))]) > 0.9
    rates = U.truncation_rates(U.score_truncation(df, ["id"], "text", "source"), "source").collect()
    assert {r.source for r in rates} == {"a", None} and sum(r.n_records for r in rates) == len(p)
    assert U.score_truncation(df.limit(0), ["id"], "text", "source").count() == 0


# 3 splitting


def test_range_maximum():
    rng = np.random.default_rng(1)
    for n in (1, 2, 7, 64, 100):
        v = rng.integers(0, 4, n)
        index = S.RangeMax(v)
        for _ in range(50):
            lo = int(rng.integers(0, n))
            hi = int(rng.integers(lo, n))
            best = max(range(lo, hi + 1), key=lambda i: (v[i], i))
            assert index.argmax(lo, hi) == best


def test_split(spark):
    rng = random.Random(2)
    text = "".join(f"w{i}" + rng.choice([" ", " ", ". ", "\n", "\n\n", ", ", "\r\n"]) for i in range(3000))
    pieces = S.split_text(text)
    tokens = text.split()
    seen = 0
    for k, (no, piece, n, lo, hi, overlap) in enumerate(pieces):
        assert no == k and n == len(piece.split()) <= 220 and overlap == (k > 0) and text[lo:hi] == piece
        own = piece.split()
        if k:
            assert own[:30] == pieces[k - 1][1].split()[-30:]
            own = own[30:]
        assert tokens[seen : seen + len(own)] == own
        seen += len(own)
    assert seen == len(tokens)
    df = spark.createDataFrame([(1, text, 7), (2, "a b", 7), (3, "", 7), (4, None, 7), (1, text, 7)], "id long, content string, token_count int")
    rows = S.split_items(df.distinct(), ["id"], "content").collect()
    assert {r.id for r in rows} == {1, 2, 3} and sum(r.id == 1 for r in rows) == len(pieces)
    assert [r.content for r in rows if r.id == 2] == ["a b"]
    assert S.split_items(df.limit(0), ["id"], "content").count() == 0


# 4 scan noise


def paper(words):
    body = ["The learning rate of the common filter follows the router.", "We observe the learning of common words in the archive.", "Another common filter was used in the learning of words."]
    pages = []
    for p in range(3):
        lines = ["Smith et al."] if p else ["A Study of Common Filters", "J. Smith, K. Jones", "Abstract"]
        lines += [body[(p + k) % 3] for k in range(6)]
        if p == 1:
            lines += ["We use a " + words[0] + " and a com-", "mon router of the well-", "known " + words[1] + " here."]
        lines += [str(p + 1)]
        pages.append(f"[PAGE {p + 1}]\n" + "\n".join(lines))
    return "\n\n".join(pages)


def test_scan_noise(spark):
    known = "A well-known filter. The well-known router is common. A well-known archive.\n" * 3
    docs = [(1, paper(["fi1ter", "cornmon"])), (2, paper(["filter", "common"])), (3, known), (4, None), (1, paper(["fi1ter", "cornmon"]))]
    section = paper(["fi1ter", "cornmon"]).split("[PAGE 2]\n")[1].split("\n\n[PAGE 3]")[0]
    noise = N.PageNoise(spark.createDataFrame(docs, "doc long, raw string"), spark.createDataFrame([(1, 0, section), (9, 0, "lone 1ine"), (1, 1, None)], "doc long, part int, raw string"), keep)
    found = noise.all_findings().select("doc", "part", "line_no", "noise_kind").distinct().collect()
    lines = paper(["fi1ter", "cornmon"]).split("\n")
    kinds = lambda d, p, k, src: sorted(src[r.line_no] for r in found if r.doc == d and r.part == p and r.noise_kind == k)
    assert kinds(1, -1, "furniture", lines) == ["1", "2", "3", "Smith et al.", "Smith et al."]
    assert kinds(1, -1, "hyphen", lines) == ["We use a fi1ter and a com-"]
    assert kinds(1, -1, "misread", lines) == ["We use a fi1ter and a com-", "known cornmon here."]
    assert kinds(1, 0, "furniture", section.split("\n")) == ["2", "Smith et al."]
    assert kinds(3, -1, "hyphen", known.split("\n")) == [] and not [r for r in found if r.doc in (3, 9)]
    text = {(r.doc, r.part): r.text for r in noise.repaired().collect()}
    assert "We use a filter and a common router of the well-known common here." in text[(1, -1)]
    empty = N.PageNoise(spark.createDataFrame([], "doc long, raw string"), None, keep)
    assert empty.all_findings().count() == 0


def test_headers_of_two_lines_and_many_pages():
    rng = random.Random(6)
    words = [chr(97 + rng.randrange(26)) * 2 + str(k) + chr(97 + rng.randrange(26)) for k in range(400)]
    line = lambda: " ".join(rng.choice(words) for _ in range(9))
    pages = [f"[PAGE {p + 1}]\n" + "\n".join(["Annual Report of the Archive", "Volume on Rivers and Lakes", *[line() for _ in range(20)], str(p + 1)]) for p in range(300)]
    layout = N.Layout("\n".join(pages))
    repeated, edges = layout.repeated_edges()
    found = {layout.lines[k] for k in repeated}
    assert found == {"Annual Report of the Archive", "Volume on Rivers and Lakes"} and len(repeated) == 2 * 299
    assert len(layout.numbers) == 300


def test_alike_forms_are_found_without_comparing_all():
    rng = random.Random(7)
    base = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(4, 60))) for _ in range(150)]
    forms = {f: {k} for k, f in enumerate(base)}
    for k, f in enumerate(base[::3]):
        g = list(f)
        for _ in range(rng.randint(1, 1 + len(f) // 8)):
            at = rng.randrange(len(g))
            g[at : at + 1] = rng.choice([[], ["x"], [g[at], "x"]]) if len(g) > 4 else ["x"]
        forms.setdefault("".join(g), set()).add(1000 + k)
    want = {f for f, p in forms.items() if len(p) > 1 or any(N.alike(f, g) and forms[g] != p for g in forms if g != f)}
    assert N.with_partner(forms) == want


def test_misread_word_over_a_line_end_is_repaired(spark):
    known = "The common filter works. A well-known filter is common.\n" * 12
    broken = "[PAGE 1]\nWe used the fi1-\nter, as the cornm-\non one of a wel1-\nknown kind does in all of the cases that were seen."
    noise = N.PageNoise(spark.createDataFrame([(1, broken), (2, known)], "doc long, raw string"), None, keep)
    text = {r.doc: r.text for r in noise.repaired().collect()}[1]
    assert "We used the filter, as the common one of a well-known kind" in text


# 5 record matching


def test_title_and_names():
    f = X.title_form
    assert X.title_relation(f("Guided Probes for Table Reading"), f("<i>Guided</i> Probes for Tabel Reading [preprint]")) == 3
    assert X.title_relation(f("Guided Probes for Table Reading Revisited"), f("Guided Probes for Table Reading")) == 0
    assert X.title_relation(f("Guided Probes for Table Reading"), f("Guided Probes for Tab…")) == 2
    assert X.title_relation(f("Guided Probes for Table Reading"), f("Muted Probes for Table Reading")) == 0
    name = X.name_form
    assert X.same_person(name("Vis Takhio"), name("Takhio, Vis A.")) and X.same_person(name("Gör Pugand"), name("PUGAND G"))
    assert not X.same_person(name("Vis Takhio"), name("Vas Pugand")) and not X.same_person(name("Vis Takhio"), name("A. Takhio"))


def test_match_records(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(2, 4)))
    left, right, truth = [], [], set()
    for i in range(300):
        title, people = " ".join(word() for _ in range(7)).title(), [f"{word().title()} {word().title()}" for _ in range(2)]
        left.append((f"L{i}", f"L{i}", title, people, 2000 + i % 20))
        if i % 2:
            short = [f"{p.split()[0][0]}. {p.split()[1]}" for p in people]
            right.append((f"R{i}", title.upper() + " [preprint]", short, 2000 + i % 20, None))
            truth.add((f"L{i}", f"R{i}"))
    right += [("null", None, None, None, None), ("other", left[0][2], ["Xu Wholly", "Yo Different"], 1990, None)]
    a = spark.createDataFrame(left + [("nul", "nul", None, None, None)], "id string, work string, title string, authors array<string>, year int")
    b = spark.createDataFrame(right, "id string, title string, authors array<string>, year int, ref string")
    found = X.match_records(a, b, keep=keep).collect()
    pairs = {(r.left_id, r.right_id) for r in found}
    assert pairs <= truth and len(pairs) > 0.97 * len(truth)
    assert all(0 <= r.confidence <= 1 for r in found)
    assert X.match_records(a.limit(0), b.limit(0), keep=keep).count() == 0


def test_recall_does_not_fall_with_size():
    for cosine in (X.LIKE_BOTH, 0.7, X.LIKE_TITLE):
        p = 1 - np.arccos(cosine) / np.pi
        found = lambda bits: [1 - (1 - p**bits) ** n for n in X.table_counts((12, 8), bits)]
        assert all(x >= y - 1e-9 for bits in range(4, 24) for x, y in zip(found(bits), found(X.BITS)))
    assert X.table_counts((12, 8), 5) == (12, 8)


def test_equal_titles_and_identifiers_always_meet(spark):
    rows = [(0, 0, "Guided Probes", ["A Bo"], "2101.00001v2"), (1, 1, "<b>GUIDED</b> probes [preprint]", None, None), (2, 1, "Quite Other Words", ["C Do"], "arXiv:2101.00001"), (3, 1, "Kite", None, "none")]
    records = X.tokenized(spark.createDataFrame(rows, "rid long, side int, title string, authors array<string>, ref string"))
    rng = np.random.default_rng(1)
    keyed = X.block_keys(records, rng.normal(size=(2 * X.BUCKETS, X.DIM)).astype(np.float32), np.ones(2 * X.BUCKETS, dtype=np.float32), (1, 1), 30)
    assert {(r.ra, r.rb) for r in X.candidate_pairs(keyed, keep).collect()} == {(0, 1), (0, 2)}


def test_hot_bucket_is_cut_into_blocks(spark):
    v = np.zeros(X.DIM, dtype=np.int8)
    v[0] = 127
    rows = [(i, i % 2, v.tobytes(), v.tobytes(), [5]) for i in range(60)]
    keyed = spark.createDataFrame(rows, "rid long, side int, vt binary, va binary, keys array<long>")
    assert X.candidate_pairs(keyed, keep, block_rows=7).count() == 30 * 30


# 6 sentences


def test_pieces():
    assert A.pieces("One. Two 3.5 ok!\nno sign\nCut off...\nLast?") == ["One.", "Two 3.5 ok!", "Last?"]
    assert A.pieces("") == []


def test_alignment(spark):
    rng = random.Random(4)
    nouns = {"filter": "필터", "router": "라우터", "window": "창문", "bridge": "다리", "memory": "기억", "ladder": "사다리"}
    forms = [("The {} grows by {} points.", "{}는 {}점 늘었다."), ("We train the {} on {} pages.", "우리는 {}를 {}쪽으로 학습했다."), ("Without the {} it fails {} times.", "{}가 없으면 {}번 실패한다.")]
    rows, truth = [], {}
    for i in range(400):
        pairs = []
        for _ in range(rng.randint(3, 6)):
            (e, k), n, x = rng.choice(forms), rng.choice(list(nouns)), rng.randint(10, 999)
            pairs.append((e.format(n, x), k.format(nouns[n], x)))
        order = list(range(len(pairs)))
        rng.shuffle(order)
        rows.append((i, " ".join(p[0] for p in pairs), " ".join(pairs[j][1] for j in order)))
        truth[i] = {(j, order.index(j)) for j in order}
    rows += [(900, None, "x."), (901, "x.", ""), (902, "no end", "끝 없음")]
    df = spark.createDataFrame(rows, "id long, s string, t string")
    found = A.align_sentences(df, ["id"], "s", "t", keep=keep).collect()
    got = {(r.id, r.source_no, r.target_no) for r in found}
    want = {(i, *p) for i, t in truth.items() for p in t}
    assert len(got & want) > 0.95 * len(want) and len(got - want) < 0.05 * len(want)
    assert A.align_sentences(df.limit(0), ["id"], "s", "t", keep=keep).count() == 0


def test_alignment_of_long_texts_in_slices(monkeypatch):
    """A text of 20,000 words: the same links in one slice and in many."""
    import pyarrow as pa

    rng = random.Random(5)
    forms = [(" ".join(f"e{k}{c}" for c in "abcdefghijk").translate(str.maketrans("0123456789", "lmnopqrstu")) + " {}.", " ".join(chr(0xAC00 + 40 * k + 3 * j) * 2 for j in range(9)) + " {}.") for k in range(60)]
    english, korean = [], []
    for _ in range(1700):
        (e, k), n = rng.choice(forms), rng.randint(10, 99_999)
        english.append(e.format(n))
        korean.append(k.format(n))
    batch = pa.RecordBatch.from_pydict({"id": [1, 2], "_source": [" ".join(english), "A b."], "_target": [" ".join(korean), "가 나."]})
    assert len(" ".join(english).split()) >= 18_000
    read = next(A.read_pairs(iter([batch])))

    def links():
        table = None
        for _ in range(2):
            (_, s, t), = list(A.blocks(read))[:1]
            codes, n = A.merged(*zip(A.expected_counts(s, t, table)))
            a, b = codes // A.BUCKETS, codes % A.BUCKETS
            sums = np.bincount(a, n), np.bincount(b, n)
            table = A.Table.of(a, b, n / (sums[0][a] + 1), n / (sums[1][b] + 1))
        i, j, _ = A.link(s, t, table)
        return set(zip(i.tolist(), j.tolist()))

    whole = links()
    monkeypatch.setattr(A, "SLICE_CELLS", 3_000_000)
    assert links() == whole and len(whole & {(i, i) for i in range(1700)}) > 1650


def test_table_entries_are_looked_up_once_a_word(monkeypatch):
    # 20 table entries of each of 3 words that come 200 times; the other text holds one of the entries
    one = np.array([1])
    numbers = np.tile([5, 6, 7], 200)
    s = A.Side(numbers | np.arange(600) << 32, np.array([600]), one, np.array([601]))
    t = A.Side(np.array([40 | 600 << 32]), one, one, np.array([601]))
    own, other = np.repeat([5, 6, 7], 20), np.tile(np.arange(40, 60), 3)
    p = np.linspace(0.1, 0.9, 60)
    rows = A.Table.of(own, other, p, p).forth
    made = []
    spans = A.spans
    monkeypatch.setattr(A, "spans", lambda starts, counts: made.append(int(counts.sum())) or spans(starts, counts))
    at, word, prob, _ = A.matches(s, np.arange(600), t, np.array([0]), rows)
    assert at.tolist() == list(range(600)) and not word.any()
    assert np.allclose(prob, np.tile(p[other == 40], 200))
    assert max(made) <= 600, "entries that no text holds were repeated for every word"


def test_equal_words_are_compared_once(monkeypatch):
    # 200 equal words on either side: one pair of items, not 40,000 pairs of words
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"id": [1], "_source": [" ".join(["filter"] * 200) + "."], "_target": [" ".join(["필터"] * 200) + "."]})
    (_, s, t), = A.blocks(next(A.read_pairs(iter([batch]))))
    table = A.Table.of(s.number[:1], t.number[:1], np.array([0.9]), np.array([0.4]))
    made = []
    spans = A.spans
    monkeypatch.setattr(A, "spans", lambda starts, counts: made.append(int(counts.sum())) or spans(starts, counts))
    i, j, gain = A.link(s, t, table)
    assert i.tolist() == [0] == j.tolist() and gain.tolist() == [1.0]
    assert max(made) <= 200, "every word was compared with every equal word"


def test_texts_are_read_as_pieces():
    import pyarrow as pa

    rng = random.Random(8)
    signs = ["a", "B", "가", "나다", "3", "1,000", ".", "!", "?", "...", "\n", " ", " ", "\t", "\u3000", "\x85", "-", "x.y", "。"]
    texts = [None, "", *["".join(rng.choice(signs) for _ in range(rng.randint(0, 40))) for _ in range(2000)]]
    for source in (True, False):
        numbers = A.Numbers(source)
        words, lengths, n_words, n_sentences = A.read_texts(pa.array(texts), numbers)
        want = [[[n for token in piece.split() for n in numbers[token]] for piece in A.pieces(text or "")] for text in texts]
        assert words.tolist() == [n for text in want for piece in text for n in piece]
        assert lengths.tolist() == [len(piece) for text in want for piece in text]
        assert n_words.tolist() == [sum(map(len, text)) for text in want] and n_sentences.tolist() == list(map(len, want))


def test_packed_rows():
    for sizes in ([], [0], [2, 0, 3], [0, 0]):
        sizes = np.array(sizes, dtype=np.int64)
        for kind in (np.int64, np.int32):
            flat = np.arange(sizes.sum(), dtype=kind)
            got, offsets = A.unpacked(A.packed(flat, sizes), kind)
            assert got.tolist() == flat.tolist() and got.dtype == kind and np.diff(offsets).tolist() == sizes.tolist()
    cut = A.packed(np.arange(5), np.array([2, 0, 3])).slice(1)
    assert [x.tolist() for x in A.unpacked(cut, np.int64)] == [[2, 3, 4], [0, 0, 3]]


def test_words_are_told_apart():
    source, target = A.Numbers(True), A.Numbers(False)
    number = lambda n, w: n[w][0] & 0xFFFFFFFF
    assert len({number(source, w) for w in ("translation", "transla", "translator")}) == 3 and number(source, "filters") == number(source, "filter")
    assert number(target, "비교하였습니다") == number(target, "비교하였다") != number(target, "비용") and number(target, "필터를") == number(target, "필터의")
    assert number(source, "128") == 0 == number(target, "Vome-XL")


# 7 packing


def test_pack():
    rng = random.Random(5)
    for n, top in ((0, 9), (1, 5000), (500, 2600), (2000, 400), (300, 1000)):
        sizes = [rng.randint(0, top) for _ in range(n)]
        rows = P.pack(sizes, 1000)
        bins, got = {}, {}
        for k, part, at, size, b in rows:
            bins[b] = bins.get(b, 0) + size
            got[k] = got.get(k, 0) + size
            assert at == part * 1000
        assert [got.get(k, 0) for k in range(n)] == sizes and all(v <= 1000 for v in bins.values())
        assert all(sum(1 for r in rows if r[0] == k) == 1 for k in range(n) if sizes[k] <= 1000)
    small = [rng.randint(1, 300) for _ in range(5000)]
    assert len({r[4] for r in P.pack(small, 1000)}) <= sum(small) / 1000 * 1.01 + 1


def test_pack_items(spark):
    rows = [(i, "word " * (i % 50), 1) for i in range(300)] + [(900, None, 1), (901, "x " * 5000, 1), (1, "word " * 1, 1)]
    df = spark.createDataFrame(rows, "id long, text string, shard int")
    got = P.pack_items(df, "id", "text", 256, shard_items=100).collect()
    assert {r.item_id for r in got} == set(range(300)) | {901}
    used = {}
    for r in got:
        used[(r.shard, r.bin_no)] = used.get((r.shard, r.bin_no), 0) + r.n_tokens
    assert max(used.values()) <= 256
    assert P.pack_items(df.limit(0), "id", "text").count() == 0


# 8 leaks


def test_suffix_array():
    rng = np.random.default_rng(6)
    for n in (1, 2, 30, 200):
        a = rng.integers(0, 3, n)
        want = sorted(range(n), key=lambda i: list(a[i:]))
        assert list(C.suffix_array(a, n + 1)) == want


def test_leaks_against_brute_force(spark):
    rng = random.Random(7)
    vocab = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(40))) for i in range(6)]
    docs = []
    for d in range(200):
        words = [rng.choice(vocab + ["zz"]) for _ in range(rng.randint(0, 60))]
        if d % 3 == 0:
            src, n = rng.choice(items)[1].split(), rng.randint(5, 30)
            at = rng.randint(0, 40 - n)
            words[5:5] = [("<b>" + w.upper() + "</b>,\n") if rng.random() < 0.3 else w for w in src[at : at + n]]
        docs.append((d, " ".join(words)))
    docs += [(900, None), (901, ""), (0, docs[0][1])]

    def longest(x, y):
        best = 0
        for i in range(len(x)):
            for j in range(len(y)):
                n = 0
                while i + n < len(x) and j + n < len(y) and x[i + n] == y[j + n]:
                    n += 1
                best = max(best, n)
        return best

    want = {}
    for d, t in docs:
        for i, u in items:
            n = longest(C.words_of(t or ""), C.words_of(u))
            if n >= 8:
                want[(d, i)] = n
    corpus = spark.createDataFrame(docs, "d long, t string")
    bench = spark.createDataFrame([*items, (50, None), (51, "too short")], "i long, t string")
    got = {(r.doc_id, r.item_id): r.n_words for r in C.find_leaks(corpus, "d", "t", bench, "i", "t", 8, shard_chars=2000).collect()}
    assert got == want and len(want) > 20
    sliced = C.find_leaks(corpus, "d", "t", bench, "i", "t", 8, max_item_bytes=300)
    assert {(r.doc_id, r.item_id): r.n_words for r in sliced.collect()} == want
    assert C.remove_leaks(corpus, "d", sliced).select("d").distinct().count() == 202 - len({d for d, _ in want})
    assert C.find_leaks(corpus.limit(0), "d", "t", bench.limit(0), "i", "t").count() == 0


def test_words():
    link = '<a class="x" href="https://reading.room/' + "a/b-" * 500 + '">word</a>s <img alt="one two" src="data:' + "A+" * 500 + '"/>here'
    assert C.words_of(link) == ["words", "here"]
    assert C.words_of("x <y and " + "so on " * 60 + "z> w") == ["x", "y", "and", *["so", "on"] * 60, "z", "w"]
    assert C.words_of("The <em>caf</em>é, NA­ÌVE&amp;x café １２") == ["the", "café", "naìve", "x", "café", "12"]


# 9 residue


def test_residue(spark):
    bad = ["Dear {{name}}, hello.", "Title: ${paper_title}", "x __AUTHOR_LIST__ y", "See [INSERT DATE] there.", "404 Not Found", "Please enable JavaScript to view this paper.", "Lorem ipsum dolor sit amet.", "TBD TBD TBD", "이 페이지를 보려면 자바스크립트를 켜야 합니다.", "<html><head><title>502 Bad Gateway</title></head><body><p>502 Bad Gateway</p></body></html>", "Some words unheard of\nGo back\nCopyright the reading room"]
    good = ["A prompt such as `Use {{text}}` was used.", "```\nrender('{{ x }}')\n```\nText here follows.", "The symbol $\\mathbf{{w}}_{{i}}$ and \\frac{{a}}{{b}} mean much.", 'We saw "404 Not Found" on 12 pages and dropped them, as the crawl was repeated and its pages were compared with the archive by hand.', "Filler in the style of lorem ipsum was used to test the layout. The method was trained on many pages of prose and it worked well for all.", "", None, "A set {a, b} and x_{i} in math.", "The placeholder {{title}} is replaced by the title."]
    bad += ["Dear {first name}, we met.", "Dear [Recipient Name], we write.", "Hello %USER_NAME%!", "Hi {{ name | default('x') }} there.", "Hi ${name:-World}."]
    good += ["In this tutorial, we greet people.\nHello {{name}}!", "It grew by 30% and 40%.", "See [Author Name](http://x).", "title = {Deep Learning for Text}"]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(bad + good)], "id long, text string, residue_kind int").drop("residue_kind")
    got = {r.id: r.residue_kind for r in R.find_residue(df, "text").collect()}
    assert [t for i, t in enumerate(bad) if got[i] is None] == []
    assert [t for i, t in enumerate(good, len(bad)) if got[i] is not None] == []
    assert R.residue_kind("A sentence about filters. " * 20_000) is None


def test_residue_without_known_words():
    found = ["Please try again in 30 seconds.", "429: too many attempts", "Operation timed out.", "Expired link.", "Service is down.", "test test test", "Home | Papers | Terms | About\nThe viewer has closed."]
    assert [t for t in found if R.residue_kind(t) is None] == []
    assert min(map(len, R.TRIGGERS)) >= 2


def test_frames_without_rows():
    assert len(pd.concat(list(L.count_ngrams(iter([]))))) == 0


def test_record_forms_are_packed_without_loss():
    names = ["Nedain B. Jaiclos", "Smith, J.", "et al.", "李", "A; B, C"]
    text = X.packed_form("A Two-Pass\nBenchmark: Speech [preprint]", names, "arXiv:2301.00234v2")
    title, people, year, ref = X.read_form(text, 2020)
    assert title == X.title_form("A Two-Pass\nBenchmark: Speech [preprint]") and (year, ref) == (2020, "2301.00234")
    assert people == [X.name_form(n) for n in names]
    assert X.read_form(X.packed_form(None, [], None), None) == (("", "", False), [], None, None)


def test_tables_are_written_in_the_shared_folder(spark):
    made = keep(spark.range(5))
    assert spark.conf.get("spark.checkpoint.dir").removeprefix("file:") in made.inputFiles()[0] and made.count() == 5


def test_accepted_pairs_share_a_key():
    rng = random.Random(11)
    word = lambda n: "".join(rng.choice("bdfgklmnprstvz") + rng.choice("aeiou") for _ in range(n))

    def slip(w: str) -> str:
        i = rng.randrange(1, len(w) - 1)
        return rng.choice([w[:i] + w[i + 1 :], w[:i] + "x" + w[i:], w[:i] + "x" + w[i + 1 :], w[: i - 1] + w[i] + w[i - 1] + w[i + 1 :]])

    kinds = range(len(X.FOREIGN))
    sketch = lambda form: X.sketches(pd.Series([X.tokens(form[0][1], [])[0]]))
    seen = 0
    for _ in range(600):
        words = [word(rng.randint(2, 4)) for _ in range(rng.randint(4, 9))]
        names = [(word(2), word(rng.randint(2, 4))) for _ in range(rng.randint(1, 4))]
        k, how = rng.randrange(len(words)), rng.randrange(5)
        other = [slip(w) if i == k and how else w for i, w in enumerate(words)]
        title = " ".join(other) if how != 2 else " ".join(other)[: -rng.randint(1, 5)] + "..."
        people = [f"{a[0]}. {slip(b) if how in (3, 4) else b}" for a, b in names] if how != 1 else []
        a = X.read_form(X.packed_form(" ".join(words), [" ".join(n) for n in names], None), 2020)
        b = X.read_form(X.packed_form(title, people, None), 2021)
        if not X.compare(a, b)[4] or (how == 2 and k == len(words) - 1):
            continue
        seen += 1
        met = [m for m in kinds if X.record_keys(a, 0, m) & X.record_keys(b, 1, m)]
        foreign = sum(int(y[0] & ~x[0]).bit_count() if y[0] & ~x[0] >= 0 else (int(y[0] & ~x[0]) + (1 << 64)).bit_count() for x, y in zip(sketch(a), sketch(b)))
        assert met and foreign <= max(X.FOREIGN[m] for m in met), (a, b)
    assert seen > 400


def test_what_a_table_shuffled_is_not_left_on_the_disk(spark):
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: set(filter(lambda x: "shuffle_" in x, manager.getAllFiles().mkString("\n").split("\n")))
    before = files()
    made = cut_lineage(spark.range(1000).repartition(3).groupBy((F.col("id") % 7).alias("k")).count())
    for _ in range(50):
        if not files() - before:
            break
        time.sleep(0.2)
    assert not files() - before
    assert sorted(r["count"] for r in made.collect()) == [142] * 1 + [143] * 6
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == "false"

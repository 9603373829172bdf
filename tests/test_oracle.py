"""Every query with SQL gives the SQL's rows over whole tables."""

import os
import re
from collections import Counter
from difflib import SequenceMatcher

import duckdb
import pytest

from docloom.plans import queries
from docloom.plans import registry as Q

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    if not os.path.isdir(DATA):
        pytest.skip("no test tables here")
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'").fetchall()
    return con


def plain(v):
    if isinstance(v, list):
        return [plain(x) for x in v]
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_same_rows(spark, db, name):
    df = Q.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted([tuple(plain(r[c]) for c in columns) for r in df.collect()], key=str)
    cur = db.execute(Q.SQL[name])
    names = [c[0] for c in cur.description]
    want = sorted([tuple(plain(r[names.index(c)]) for c in columns) for r in cur.fetchall()], key=str)
    assert columns == sorted(names)
    assert got == want


# Queries that SQL can not state, against plain loops over the whole tables


def rows_of(db, sql):
    return db.execute(sql).fetchall()


def ratio(a, b):
    if not a or not b:
        return 0.0
    return 1.0 if a.lower().strip() == b.lower().strip() else SequenceMatcher(None, a, b).ratio()


def best(text, term, least):
    spans, n, found = [m.span() for m in re.finditer(r"\w+", text or "")], max(1, len(re.findall(r"\w+", term))), (None, None, None)
    for k in range(len(spans) - n + 1):
        word = text[spans[k][0] : spans[k + n - 1][1]]
        score = ratio(term, word)
        if score >= least and (found[1] is None or score > found[1]):
            found = (word, score, spans[k][0])
    return found


def test_every_other_query_has_a_test():
    tested = {"q_similarity", "q_fuzzy_best", "q_validate_fuzzy", "q_sentence_chunks", "q_line_changes", "q_merge_changes", "q_inferred_terms", "q_change_summary", "q_diff_report", "q_changes_text"}
    assert set(Q.QUERIES) - set(Q.SQL) == tested


def test_similarity_of_all_rows(spark, db):
    want = {i: round(ratio(a, b), 6) for i, a, b in rows_of(db, "SELECT DISTINCT id, old_target_text, new_target_text FROM term_changes")}
    assert {r.id: r.score for r in Q.QUERIES["q_similarity"](spark, DATA).collect()} == want


def test_best_words_of_all_rows(spark, db):
    rows = rows_of(db, f"SELECT validation_id, source_text, expected_target, content, translated_text FROM {queries.V}")
    want = {i: best(t, e, 0.6) for i, _, e, _, t in rows}
    got = {r.validation_id: (r.word, r.score, r.position) for r in Q.QUERIES["q_fuzzy_best"](spark, DATA).collect()}
    assert got == {i: (w, None if s is None else round(s, 6), p) for i, (w, s, p) in want.items()}
    states = {}
    for i, s, e, c, t in rows:
        word, score, place = best(t, e, 0.7)
        if s.lower() not in c.lower() or e.lower() in t.lower():
            states[i] = "matched"
        else:
            states[i] = "missing" if score is None else "similar" if score >= 0.8 else "mismatched"
    assert {r.validation_id: r.found_status for r in Q.QUERIES["q_validate_fuzzy"](spark, DATA).collect()} == states


def test_sentence_chunks_of_all_documents(spark, db):
    want = set()
    for doc, text in rows_of(db, "SELECT doc_id, text FROM documents"):
        words = [w for w in re.split(r"[ \t\n\x0b\f\r]+", text) if w]
        for k, at in enumerate([0] if len(words) <= 200 else range(0, len(words), 170)):
            if at and at - 170 + 200 >= len(words):
                continue
            piece, cut = " ".join(words[at : at + 200]), None
            if at + 200 < len(words):
                cut = len(piece)
                for ending in (". ", "! ", "? ", ".\n", "!\n", "?\n"):
                    last = piece.rfind(ending)
                    if 0 < last < cut:
                        cut = last + 2
                piece = piece[:cut].rstrip(" ") if cut > len(piece) * 0.5 else piece
            want.add((doc, k, piece))
    assert {(r.doc_id, r.chunk_index, r.content) for r in Q.QUERIES["q_sentence_chunks"](spark, DATA).collect()} == want


def test_line_changes_of_all_documents(spark, db):
    lines, merged = set(), set()
    for doc, old in rows_of(db, "SELECT doc_id, text FROM documents"):
        new = old.replace("tidal", "solar").replace("조석", "태양")
        if new == old:
            continue
        x, y, seq = old.split("\n"), new.split("\n"), []
        for op, i1, i2, j1, j2 in SequenceMatcher(None, x, y, autojunk=False).get_opcodes():
            if op != "equal":
                seq += [("removed", x[i], None, j1 + 1) for i in range(i1, i2)] + [("added", None, y[j], j + 1) for j in range(j1, j2)]
        lines |= {(doc, n, *row) for n, row in enumerate(seq)}
        n = 0
        while n < len(seq):
            if n + 1 < len(seq) and (seq[n][0], seq[n + 1][0]) == ("removed", "added") and ratio(seq[n][1], seq[n + 1][2]) >= 0.6:
                merged.add((doc, n, "modified", seq[n][1], seq[n + 1][2], seq[n + 1][3]))
                n += 2
            else:
                merged.add((doc, n, *seq[n]))
                n += 1
    shape = lambda name: {(r.doc_id, r.seq, r.change_type, r.old_text, r.new_text, r.line_no) for r in Q.QUERIES[name](spark, DATA).collect()}
    assert shape("q_line_changes") == lines and shape("q_merge_changes") == merged
    counts = Counter((m[0], m[2]) for m in merged)
    for r in Q.QUERIES["q_change_summary"](spark, DATA).collect():
        assert (r.n_added, r.n_removed, r.n_modified) == tuple(counts[r.doc_id, t] for t in ("added", "removed", "modified"))
    terms = {}
    for source, target in rows_of(db, "SELECT source_text, target_text FROM terminology WHERE target_text <> '' ORDER BY source_text"):
        terms[target] = source
    want = set()
    for doc, n, kind, old, new, _ in merged:
        for target, source in terms.items() if kind == "modified" else ():
            word = next((w for w in re.findall("[가-힣]+", new) if len(w) >= 2 and w != target), None)
            if target in old and target not in new and word:
                want.add((f"{doc}-{n}-{source}", source, word))
    assert {(r.key, r.source_text, r.new_target) for r in Q.QUERIES["q_inferred_terms"](spark, DATA).collect()} == want
    assert {r.doc_id for r in Q.QUERIES["q_diff_report"](spark, DATA).collect()} == {m[0] for m in merged} == {r.doc_id for r in Q.QUERIES["q_changes_text"](spark, DATA).collect()}

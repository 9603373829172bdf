"""Small exact cases and edges."""

from difflib import SequenceMatcher

from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.functions.similarity import best_word, ratio
from docloom.operators import documents as D
from docloom.operators import enrich as E
from docloom.operators import feedback as B
from docloom.operators import terms as M
from docloom.plans import pipeline
from docloom.sources import io as S


def value(spark, column, **literals):
    return spark.range(1).select(column.alias("v")).first().v


def test_clean_text(spark):
    c = lambda s: value(spark, T.clean_text(F.lit(s)))
    assert c("transfor-\nmer") == "transformer"
    assert "[PAGE" not in c("[PAGE 1]\nSome text\n[PAGE 2]\nMore text")
    assert c("") == "" and c(" a  b \n\n\n\nc ") == "a b \n\nc"


def test_sections_and_pages(spark):
    text = "[PAGE 1]\nTitle line of the paper\nAbstract\nOne.\n[PAGE 2]\nIntroduction\nTwo.\n"
    rows = D.sections(spark.createDataFrame([(1, text), (2, "no headers here"), (3, None)], "k long, t string"), "k", "t").orderBy("k", "section_ord").collect()
    assert [(r.k, r.title, r.content, r.page_start, r.page_end) for r in rows] == [
        (1, "Abstract", "One.", 1, 2), (1, "Introduction", "Two.", 2, 2), (2, "Main Content", "no headers here", 1, 1)
    ]
    kept = D.sections(spark.createDataFrame([(1, text)], "k long, t string"), "k", "t", keep_preamble=True)
    assert kept.where("title = 'Main Content'").count() == 1


def test_drop_references_and_title(spark):
    df = spark.createDataFrame([("Abstract",), ("References",), ("My Bibliography",), (None,)], "title string")
    assert {r.title for r in D.drop_references(df).collect()} == {"Abstract", None}
    assert value(spark, D.document_title(F.lit("[PAGE 1]\nshort\nA longer title line\n"))) == "A longer title line"
    assert value(spark, D.document_title(F.lit("x"))) == "Unknown"


def test_token_chunks(spark):
    words = " ".join(f"w{i}" for i in range(1450))
    df = spark.createDataFrame([(1, words), (2, "a b"), (3, ""), (4, None)], "k long, t string")
    rows = D.token_chunks(df, ["k"], "t", 800, 100).orderBy("k", "chunk_index").collect()
    assert [(r.k, r.chunk_index, r.token_count, r.has_overlap) for r in rows] == [(1, 0, 800, False), (1, 1, 750, True), (1, 2, 50, True), (2, 0, 2, False)]
    assert D.token_chunks(df, ["k"], "t", 800, 100, drop_contained_tail=True).where("k = 1").count() == 2
    assert D.token_chunks(df, ["k"], "t", 10, 10).where("k = 2").count() == 1


def test_sentence_boundary(spark):
    def plain(text):
        best = len(text)
        for e in T.SENTENCE_ENDINGS:
            at = text.rfind(e)
            if 0 < at < best:
                best = at + len(e)
        return best

    for text in ("No sentence boundary here", "One. Two! Three", "A? B.\nC. D", "", ". x"):
        assert value(spark, T.sentence_boundary(F.lit(text))) == plain(text)


def test_chunk_summary(spark):
    rows = [("Intro", 10, False, []), ("Intro", 15, True, []), ("Method", 20, False, ["t"])]
    r = D.chunk_summary(spark.createDataFrame(rows, "section_title string, token_count int, has_overlap boolean, tables array<string>"), []).first()
    assert (r.total_chunks, r.total_tokens, r.avg_tokens, r.n_sections, r.n_overlap, r.n_tables) == (3, 45, 15, 2, 1, 1)


def test_match_terms_both_ways(spark):
    terms = spark.createDataFrame([("1", "Transformer", "트랜스포머", 10), ("2", "attention", "어텐션", 5), ("3", "model", "모델", 3), ("4", "", "x", 1), ("5", "ai", "인공지능", 1)], "id string, source_text string, target_text string, usage_count int")
    texts = spark.createDataFrame([(1, "The transformer uses attention, attention and paid time."), (2, None), (3, "")], "k long, t string")
    want = {("Transformer", 1), ("attention", 2), ("ai", 1)}
    for limit in (1 << 20, 0):
        found = M.match_terms(texts, ["k"], "t", terms, broadcast_bytes=limit)
        assert {(r.source_text, r.match_count) for r in found.collect()} == want
    assert M.match_terms(texts, ["k"], "t", terms, word_boundary=True).where("source_text = 'ai'").count() == 0
    assert [r.source_text for r in M.top_terms(M.match_terms(texts, ["k"], "t", terms), ["k"], 2).orderBy("rank").collect()] == ["Transformer", "attention"]
    assert M.match_terms(texts.limit(0), ["k"], "t", terms.limit(0)).count() == 0


def test_similarity_and_validation(spark):
    assert round(ratio("셀프 어텐션", "셀프어텐션"), 4) == 0.9091 and round(ratio("신경망", "인공신경망"), 2) == 0.75
    assert ratio("", "x") == 0.0 and ratio(" A", "a ") == 1.0 and ratio(None, "x") == 0.0
    assert ratio("abcd", "bcde") == SequenceMatcher(None, "abcd", "bcde").ratio()
    rows = [("Transformer", "트랜스포머", "a transformer", "트랜스포머 모델"), ("attention", "어텐션", "attention here", "주의 기법"), ("loss", "손실", "no such term", "x"), ("net", "인공신경망", "a net", "신경망은 좋다"), (None, None, None, None)]
    df = spark.createDataFrame(rows, "s string, e string, o string, t string")
    got = [(r.found_status, r.found_position) for r in M.validate(df, "s", "e", "o", "t", 0.8, 0.6).collect()]
    assert got == [("matched", 0), ("missing", -1), ("matched", -1), ("mismatched", 0), ("matched", -1)]
    r = spark.range(1).select(best_word(F.lit("신경망은 학습"), F.lit("신경망"), F.lit(0.5)).alias("b")).first().b
    assert r.word == "신경망은" and r.position == 0


def test_correction(spark):
    assert value(spark, T.replace_first(F.lit("인공신경망은 학습합니다."), F.lit("인공신경망"), F.lit("신경망"))) == "신경망은 학습합니다."
    assert value(spark, T.replace_first(F.lit("aa"), F.lit("a"), F.lit("\\1"))) == "\\1a"
    assert value(spark, T.replace_first(F.lit("aa"), F.lit("x"), F.lit("y"))) == "aa"


def test_ids_and_routes(spark):
    got = [value(spark, T.arxiv_id(F.lit(x))) for x in ("1706.03762", "https://arxiv.org/abs/2301.00234", "https://arxiv.org/pdf/1706.03762v2.pdf", "invalid_url")]
    assert got == ["1706.03762", "2301.00234", "1706.03762v2", None]
    assert value(spark, T.message_domain(F.lit("a vision paper"))) == "CV" and value(spark, T.message_domain(F.lit("이 언어 논문 번역해줘"))) == "NLP"
    assert value(spark, T.message_domain(F.lit("a url"))) == "RL" and value(spark, T.message_domain(F.lit("a paper"))) == "General"
    assert [value(spark, T.source_type(F.lit(x))) for x in ("http://x", "2301.00234", "2301.00234v1", "a.pdf")] == ["url", "arxiv_id", "file", "file"]
    assert value(spark, T.fetch_kind(F.lit("2301.00234v1"))) == "arxiv_id"


def test_markdown_table(spark):
    cells = lambda rows: F.array(*[F.array(*map(F.lit, r)) for r in rows])
    got = value(spark, T.markdown_table(cells([["A", "B"], ["1", "2", "3"], ["4"]]), F.lit("[TABLE Page 1, #1]")))
    assert got == "[TABLE Page 1, #1]\n| A | B |\n|---|---|\n| 1 | 2 |\n| 4 |  |"
    assert value(spark, T.markdown_table(cells([["A"]]))) == ""


def test_line_changes(spark):
    rows = [(1, "Line 1\nLine 2", "Line 1\nLine 2\nLine 3"), (2, "a\nb\nc", "a\nc"), (3, "same", "same"), (4, "the attention model works\nz", "the focus model works\nz"), (5, "a\n---\nb", "a\nb"), (6, None, "new")]
    df = spark.createDataFrame(rows, "k long, a string, b string")
    got = {(r.k, r.change_type, r.old_text, r.new_text) for r in B.merge_changes(B.line_changes(df, "k", "a", "b"), "k", 0.5).collect()}
    assert got == {(1, "added", None, "Line 3"), (2, "removed", "b", None), (4, "modified", "the attention model works", "the focus model works"), (5, "removed", "---", None), (6, "added", None, "new")}


def test_plan(spark):
    terms = spark.createDataFrame([("t1", "attention", "어텐션"), ("t2", "self attention", "셀프 어텐션")], "id string, source_text string, target_text string")
    changes = spark.createDataFrame([("a", "attention", "주의", 0.9), ("b", "brand new", "새", 0.9), ("c", "attention", "x", 0.3)], "key string, source_text string, new_target string, confidence double")
    plan = B.sync_plan(changes, terms, "key")
    assert {(r.key, r.action, r.term_id) for r in plan.collect()} == {("a", "update_term", "t1"), ("a", "log_change", "t1"), ("b", "add_term", None), ("b", "log_change", None), ("c", "skip", "t1")}
    after = {(r.source_text, r.target_text) for r in B.apply_plan(terms, plan).collect()}
    assert after == {("attention", "주의"), ("self attention", "셀프 어텐션"), ("brand new", "새")}


def test_changed_files(spark):
    files = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3"), ("d", "4")], "path string, hash string")
    known = spark.createDataFrame([("a", "1"), ("b", "x"), ("c", None)], "path string, hash string")
    assert {(r.path, r.is_new) for r in B.changed_files(files, known).collect()} == {("b", False), ("d", True)}


def test_enrich(spark):
    def call(text):
        if "bad" in text:
            raise ValueError("bad text")
        if "flaky" in text:
            raise RuntimeError("down")
        return text.upper()

    df = spark.createDataFrame([(1, "ok"), (2, "bad"), (3, "flaky")], "k long, t string")
    got = {(r.k, r.output, r.status, r.retry_count) for r in E.enrich(df, ["k"], ["t"], call, attempts=3, delay=0.001).collect()}
    assert got == {(1, "OK", "completed", 0), (2, None, "failed", 0), (3, None, "failed", 2)}
    stop = spark.createDataFrame([(1, 0, "completed"), (1, 1, "failed"), (1, 2, "completed"), (2, 0, "completed")], "k long, i int, status string")
    assert E.until_first_failure(stop, "k", "i").count() == 3


def test_tables(spark, tmp_path):
    raw = spark.createDataFrame([("a", "b", "3"), ("", "x", "1"), ("c", None, "2")], "source_text string, target_text string, usage_count string")
    made = S.normalize_terms(raw).collect()
    assert [(r.source_text, r.domain, r.confidence, r.usage_count) for r in made] == [("a", "General", 1.0, 3)]
    S.write_terms(S.normalize_terms(raw), str(tmp_path / "t.csv"), "csv")
    assert S.read_terms(spark, str(tmp_path / "t.csv")).count() == 1
    old = spark.createDataFrame([("a", "x"), ("b", "y")], "k string, v string")
    new = spark.createDataFrame([("b", None), ("c", "z")], "k string, v string")
    assert {(r.k, r.v) for r in S.upsert(old, new, ["k"]).collect()} == {("a", "x"), ("b", "y"), ("c", "z")}
    (tmp_path / "x.pdf").write_bytes(b"%PDF-1.4 x")
    (tmp_path / "y.pdf").write_bytes(b"nothing")
    assert S.read_pdf_bytes(spark, str(tmp_path / "*.pdf")).count() == 1
    pages = value(spark, S.pages_to_text(F.array(F.lit("p"), F.lit(None).cast("string"))))
    assert pages == "[PAGE 1]\np\n\n[PAGE 2]\n"


def test_whole_dataflow(spark):
    papers = spark.createDataFrame([(1, "[PAGE 1]\nA title of some length\nAbstract\nWe use atten-\ntion.\nReferences\n[1] x\n")], "k long, raw string")
    terms = spark.createDataFrame([("1", "attention", "어텐션", 1)], "id string, source_text string, target_text string, usage_count int")
    seen = lambda text, prompt, hint: f"{text.upper()} <{prompt}> <{hint}>"
    r = pipeline.translate_documents(papers, "k", "raw", terms, seen).first()
    assert "## 초록\n\nWE USE ATTENTION. <- attention → 어텐션> <Paper: A title of some length | Section: Abstract>" in r.markdown
    assert r.markdown.startswith("# A title of some length\n\n> **원제**: A title of some length\n\n---") and "| 총 청크 수 | 1 |" in r.markdown
    assert "| attention | 어텐션 |" in r.markdown and "| 용어 매칭률 | 100.00 |" in r.markdown and r.filename == "paper_a-title-of-some-length"
    # a call that fails adds nothing, and its terms are not checked
    def broken(text, prompt, hint):
        raise ValueError("no")

    r = pipeline.translate_documents(papers, "k", "raw", terms, broken).first()
    assert "## 초록\n\n\n\n---" in r.markdown and "| 용어 매칭률 | N/A |" in r.markdown


def test_correction_in_the_dataflow(spark):
    done = spark.createDataFrame([(1, 0, "the attention", "그 어텐숀 과 어텐숀", "completed"), (1, 1, "the attention", None, "failed")], "k long, chunk_index int, content string, output string, status string")
    ranked = spark.createDataFrame([(1, 0, 1, "attention", "어텐션"), (1, 1, 1, "attention", "어텐션")], "k long, chunk_index int, rank int, source_text string, target_text string")
    texts, checks = pipeline.postprocess(done, ranked, "k", threshold=0.9, least=0.5)
    assert {(r.chunk_index, r.text) for r in texts.collect()} == {(0, "그 어텐션 과 어텐숀"), (1, "")}
    assert [(r.found_status, r.found_text, r.corrected) for r in checks.collect()] == [("mismatched", "어텐숀", True)]
    texts, checks = pipeline.postprocess(done, ranked, "k", threshold=0.9, least=0.5, auto_correct=False)
    assert {r.text for r in texts.collect()} == {"그 어텐숀 과 어텐숀", ""} and not checks.first().corrected


def test_stream_of_files(spark, tmp_path):
    from docloom.streaming.changes import watch_documents

    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.md").write_text("hello")
    seen = []
    known = lambda: spark.createDataFrame([], "path string, hash string")
    watch_documents(spark, str(folder), known, lambda df, n: seen.extend(df.collect()), str(tmp_path / "cp")).awaitTermination(60)
    assert len(seen) == 1 and seen[0].is_new


def test_inferred_terms_reads_the_whole_dictionary(spark, monkeypatch):
    from docloom.plans import queries as Q

    seen = []
    monkeypatch.setattr(Q, "q_merge_changes", lambda s, d: None)
    monkeypatch.setattr(Q, "read", lambda s, d, name, *c: spark.createDataFrame([("tide", "조석"), ("sun", "태양")], "source_text string, target_text string"))

    def infer(changes, terms):
        seen.extend(r.source_text for r in terms.collect())
        return spark.createDataFrame([], "doc_id long, seq int, source_text string, new_target string, confidence double")

    monkeypatch.setattr(Q.B, "inferred_terms", infer)
    assert Q.inferred(spark, "").count() == 0 and sorted(seen) == ["sun", "tide"]

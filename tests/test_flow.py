"""Routing, reports, stored tables and hooks, with values worked out by hand."""

import datetime
import time

import pytest
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import documents as D
from docloom.operators import feedback as B
from docloom.operators import reports as R
from docloom.operators import routing as G
from docloom.operators import terms as M
from docloom.plans import hooks
from docloom.sources import papers as P
from docloom.sources import store


def value(spark, c):
    return spark.range(1).select(c.alias("v")).first().v


def test_names(spark):
    name = lambda t, i: value(spark, T.filename(F.lit(t), "20250101", F.lit(i)))
    assert name("A Study of X!", "2301.00234") == "20250101_a-study-of-x_230100234"
    assert name("A Study of X!", None) == "20250101_a-study-of-x"
    titles = {"2.1 Related Work": "2.관련 연구", "1. Introduction": "1. 서론", "Methodology": "방법", "Other": "Other", "3  Results": "3  결과"}
    for title, korean in titles.items():
        assert value(spark, T.section_title(F.lit(title))) == korean
    headers = {"1 Introduction": "Introduction", "2.1 The Method": "The Method", "1. Introduction": None, "## Notes": "Notes", "Results": "Results", "methods": "methods", "We use it.": None, "": None}
    for line, title in headers.items():
        assert value(spark, T.chunk_header(F.lit(line))) == title


def test_matching_ways_agree(spark):
    texts = spark.createDataFrame([(1, "aaaa Abab ab"), (2, ""), (3, None), (4, "İx ab")], "k long, t string")
    terms = spark.createDataFrame([("1", "aa"), ("2", "ABAB"), ("3", "b"), ("4", "aa"), ("5", ""), ("6", "zzz")], "id string, source_text string")
    small = {(r.k, r.id, r.match_count) for r in M.match_terms(texts, ["k"], "t", terms).collect()}
    large = {(r.k, r.id, r.match_count) for r in M.match_terms(texts, ["k"], "t", terms, broadcast_bytes=0).collect()}
    assert small == large == {(1, "1", 2), (1, "4", 2), (1, "2", 1), (1, "3", 3), (4, "3", 1)}
    assert M.match_terms(texts, ["k"], "t", terms.limit(0)).count() == 0
    whole = {(r.k, r.id) for r in M.match_terms(texts, ["k"], "t", spark.createDataFrame([("7", "ab")], "id string, source_text string"), word_boundary=True).collect()}
    assert whole == {(1, "7"), (4, "7")}


def test_places(spark):
    got = value(spark, M.places(F.lit("Ab.c aB.c x"), F.lit("ab.C")))
    assert [(p.start, p.end) for p in got] == [(0, 4), (5, 9)] and value(spark, M.places(F.lit("x"), F.lit("y"))) == []


def test_known_term_without_pairs_of_all(spark):
    terms = spark.createDataFrame([("1", "deep learning", "심층 학습"), ("2", "learning", "학습"), ("3", "x", "y"), ("4", None, None)], "id string, source_text string, target_text string")
    rows = spark.createDataFrame([("a", "Learning"), ("b", "학습"), ("c", "none"), ("d", "x"), ("e", None), ("f", "")], "key string, w string")
    got = {r.key: r.term_id for r in B.known_term(rows, terms, "key", "w").collect()}
    assert got == {"a": "2", "b": "2", "c": None, "d": "3", "e": None, "f": None}
    assert "NestedLoop" not in B.known_term(rows, terms, "key", "w")._jdf.queryExecution().toString()


def test_routing(spark):
    rows = [(1, 1, "x"), (1, 2, "see https://arxiv.org/abs/2301.00234v2 for vision"), (2, 1, "2301.00235 please"), (3, 1, "hello"), (4, 1, None)]
    messages = spark.createDataFrame(rows, "k long, turn int, content string")
    results = spark.createDataFrame([("2301.00234", True, "/o", "T", None, None)], "request_source string, success boolean, output_path string, title string, error_code string, error_message string")
    got = {r.k: r for r in G.route(messages, "k", ["turn"], results).collect()}
    assert (got[1].request_source, got[1].domain, got[1].success) == ("2301.00234", "CV", True) and got[1].reply.endswith("**논문**: T\n**출력 파일**: /o")
    assert got[2].success is False and "NO_RESULT" in got[2].reply and got[3].reply is None and got[4].reply is None
    kept = G.parse_sources(messages.withColumn("domain", F.lit("RL")))
    assert {r.domain for r in kept.collect()} == {"RL"}
    error = lambda s, d, e: value(spark, G.request_error(F.lit(s), F.lit(d), F.lit(e)))
    assert [error(" ", "NLP", True), error("a.pdf", "NLP", False), error("http://x", "Law", False), error("2301.00234", "RL", False)] == ["no_source", "no_file", "unknown_domain", None]


def test_papers(spark):
    assert P.retry_wait(0) == 5 and P.retry_wait(2) == 15 and P.retry_wait(0, 30) == 30
    assert P.year_range(2020, None, 2025) == "2020-2025" and P.year_range(None, 2021, 2025) == "-2021" and P.year_range(None, None, 2025) is None
    assert P.query_text("llm", ["cs.CL", "cs.AI"]) == "(llm) AND (cat:cs.CL OR cat:cs.AI)" and P.query_text("", ["cs.CL"]) == "cat:cs.CL"
    assert P.check_arguments("arxiv", "x") == [] and len(P.check_arguments("web", None, page=0, per_page=101)) == 4
    papers = spark.createDataFrame([("1", "Parsing C++ code", None), ("2", "other", "a.b")], "arxiv_id string, title string, abstract string")
    assert [r.arxiv_id for r in P.search_papers(papers, ["C++"]).collect()] == ["1"] and [r.arxiv_id for r in P.search_papers(papers, ["PARSING"]).collect()] == ["1"]
    assert P.search_papers(papers, ["a?b"]).count() == 0


def test_store(spark, tmp_path):
    now = F.lit(datetime.datetime(2025, 1, 1))
    old = spark.createDataFrame([("1", "failed", "e", "h")], "id string, status string, error_message string, current_md_hash string")
    changes = spark.createDataFrame([("1", "completed", "")], "id string, status string, error_message string")
    assert tuple(store.set_status(old, changes, now).first()) == ("1", "completed", "e", "h")
    log = store.new_changes(spark.createDataFrame([("s", "a", "b", 1)], "source_text string, old_target string, new_target string, other int"), now).first()
    assert (log.change_type, log.detected_from, log.old_target_text, log.new_target_text) == ("update", "user_feedback", "a", "b")
    assert store.new_translations(spark.createDataFrame([("t", "p")], "paper_title string, output_path string"), now).first().status == "in_progress"
    terms = spark.createDataFrame([("100% sure", "a"), ("100 sure", "b")], "source_text string, id string").withColumn("target_text", F.lit(None).cast("string")).withColumn("domain", F.lit("General"))
    assert [r.id for r in store.search_terms(terms, "100%").collect()] == ["a"]
    assert store.is_reachable(terms) and not store.is_reachable(spark.range(1).select(F.raise_error(F.lit("gone")).alias("x")))
    (tmp_path / "1.sql").write_text("CREATE OR REPLACE TEMP VIEW one AS SELECT 1 AS a; SELECT * FROM one;")
    (tmp_path / "2.sql").write_text("SELECT nothing FROM nowhere")
    (tmp_path / "3.sql").write_text("SELECT 1")
    done = store.run_migrations(spark, str(tmp_path))
    assert done[0] == ("1.sql", None) and done[1][0] == "2.sql" and done[1][1] and len(done) == 2


def test_changes(spark):
    rows = [(1, 0, "modified", "old line", "new line", 3), (1, 1, "removed", "gone", None, 5), (1, 2, "added", None, "come", 6)]
    changes = spark.createDataFrame(rows, "k long, seq int, change_type string, old_text string, new_text string, line_no int")
    assert B.changes_text(changes, "k").first().diff == "- 기존: old line\n+ 변경: new line\n- 삭제: gone\n+ 추가: come"
    assert tuple(B.change_summary(changes, "k").first()) == (1, 3, 1, 1, 1)
    report = B.diff_report(changes, "k", first=1).first().report
    assert report == "## 3\n1. [modified] 3\n   - old line...\n   + new line...\n   ... 2"
    terms = spark.createDataFrame([("a", "낡은", 1), ("b", "낡은", 2)], "source_text string, target_text string, ord int")
    line = spark.createDataFrame([(1, 0, "modified", "낡은 말", "새로운 말", 1)], changes.schema)
    got = B.inferred_terms(line, terms).first()
    assert (got.source_text, got.new_target) == ("b", "새로운")


def test_summaries(spark):
    checks = spark.createDataFrame([(1, 0, "s", "v1", "a", "b", None, "missing", False), (1, 0, "s", "v2", "c", "d", "x", "mismatched", True), (1, 1, "s", "v3", "e", "f", "f", "matched", False)], "k long, chunk_index int, section_title string, validation_id string, source_text string, expected_target string, actual_target string, status string, corrected boolean")
    report = R.correction_report(checks, "k").first().report
    assert "- 매칭률: 33.33%" in report and "### 청크 0 (s)\n\n- ❌ **a**: 예상 'b', 실제 '(없음)'\n- ⚠️ **c**: 예상 'd', 실제 'x' ✅ 교정됨" in report and "청크 1" not in report
    estimate = R.token_estimate(spark.createDataFrame([(1, "a b", "c d e")], "k long, p string, t string"), ["k"], F.col("p"), F.col("t")).first()
    assert (estimate.input_tokens, estimate.output_tokens, estimate.seconds) == (15, 22, 2.0)
    assert value(spark, T.percent(F.lit(12.34))) == "12.3%" and value(spark, T.percent(F.lit(None))) == "N/A"


def test_hooks(spark, tmp_path):
    (tmp_path / "s.json").write_text('{"max_tokens": 100, "unknown": 1}')
    s = hooks.Settings.load(str(tmp_path / "s.json"), {"DOCLOOM_OVERLAP": "7", "DOCLOOM_VALIDATE": "no"})
    assert (s.max_tokens, s.overlap, s.validate, s.strategy) == (100, 7, False, "hybrid")
    heard = []
    df = hooks.run_steps(spark.range(3), {"twice": lambda d: d.union(d)}, lambda n, st: heard.append((n, st)))
    seen, counts = hooks.observed(df.withColumn("status", F.lit("failed")), "n")
    seen.collect()
    assert heard == [("twice", "completed")] and counts.get == {"n_rows": 6, "n_failed": 6}
    with pytest.raises(ValueError):
        hooks.run_steps(df, {"bad": lambda d: (_ for _ in ()).throw(ValueError("x"))}, lambda n, st: heard.append((n, st)))
    assert heard[-1] == ("bad", "failed")
    plan = spark.createDataFrame([("update_term",)], "action string")
    assert hooks.sync(plan.limit(0), dict)["state"] == "nothing" and hooks.sync(plan, dict, dry_run=True)["state"] == "preview"
    assert hooks.sync(plan, dict)["state"] == "declined" and hooks.sync(plan, lambda p: {"n": p.count()}, confirm=lambda p: True) == {"success": True, "error": None, "state": "applied", "n": 1}
    runner = hooks.Runner(spark, 2)
    a, b = runner.submit(lambda: {"n": spark.range(5).count()}), runner.submit(lambda: 1 / 0)
    assert runner.result(a)["n"] == 5 and runner.result(b)["error"] == "division by zero"
    assert runner.status(a) == "completed" and runner.status(b) == "failed" and runner.status("x") == "unknown"
    slow = runner.submit(lambda: {"n": spark.range(100).repartition(100).select(F.udf(lambda x: time.sleep(1) or x, "long")("id")).count(), "rows": len(spark.range(2000).repartition(4).select(F.udf(lambda x: time.sleep(0.1) or x, "long")("id").alias("x")).collect())})
    time.sleep(2)
    runner.cancel(slow)
    assert not runner.result(slow)["success"]
    runner.shutdown()


def test_tables_and_whole_text_chunks(spark):
    chunks = spark.createDataFrame([(1, 0), (1, 1), (2, 0)], "k long, section_index int")
    tables = spark.createDataFrame([(1, ["t"])], "k long, tables array<string>")
    assert {(r.k, r.section_index, tuple(r.tables)) for r in D.first_tables(chunks, tables, ["k"]).collect()} == {(1, 0, ("t",)), (1, 1, ()), (2, 0, ())}
    made = D.whole_chunks(spark.createDataFrame([(1, "a b c d")], "k long, t string"), "k", "t", 3, 1).orderBy("chunk_index").collect()
    assert [(r.content, r.start_char, r.end_char) for r in made] == [("a b c", 0, 5), ("c d", 5, 8)]


def test_files_of_their_own(spark, tmp_path):
    from docloom.sources import io

    df = spark.createDataFrame([("a", "글"), ("b", None), (None, "x")], "n string, t string")
    rows = {r.filename: r for r in io.write_named(df, str(tmp_path / "out"), "n", "t").collect()}
    assert (tmp_path / "out" / "a.md").read_text() == "글" and rows["a"].content_length == 1 and set(rows) == {"a", "b"}
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["a.md", "b.md"]
    again = {(r.path.rsplit("/", 1)[1], r.text) for r in io.read_markdown(spark, str(tmp_path / "out")).collect()}
    assert ("a.md", "글") in again

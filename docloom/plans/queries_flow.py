"""Queries of routing, summaries, reports, rendering and the whole dataflow, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import documents as D
from docloom.operators import feedback as B
from docloom.operators import reports as R
from docloom.operators import routing as G
from docloom.operators import terms as M
from docloom.plans import pipeline
from docloom.plans.hooks import Settings
from docloom.plans.queries import ASSEMBLE, C, CHUNK, CLEAN, LINES, PLAN, SECTIONS, TITLED, TOK, TOPK, V, P, chunk_texts, checks, edited, papers, plan, query, ranked_terms, read, translated

# Messages

DOMAIN = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(content), '{w}')" for w in words) + f" THEN '{name}'" for name, words in T.DOMAIN_WORDS.items()) + " ELSE 'General' END"
MESSAGES = "(SELECT DISTINCT arxiv_id, CASE WHEN length(title) % 3 = 0 THEN 'https://arxiv.org/abs/' || arxiv_id || ' ' || title WHEN length(title) % 3 = 1 THEN arxiv_id || ' ' || title ELSE title END AS content FROM arxiv_papers)"
PARSED = rf"""WITH m AS (SELECT arxiv_id AS k, content, contains(content, 'arxiv.org') OR starts_with(content, 'http') AS a FROM {MESSAGES}),
  p AS (SELECT k, content, CASE WHEN a THEN nullif(regexp_extract(content, '(https?://\S+)', 1), '') END AS url, {DOMAIN} AS domain, a FROM m),
  s AS (SELECT k, content, url, domain, nullif(regexp_extract(CASE WHEN a THEN url ELSE content END, '(\d{{4}}\.\d{{4,5}})', 1), '') AS found FROM p)"""


def messages(spark, d):
    rows = read(spark, d, "arxiv_papers", "arxiv_id", "title")
    n = F.length("title") % 3
    content = F.when(n == 0, F.concat(F.lit("https://arxiv.org/abs/"), "arxiv_id", F.lit(" "), "title")).when(n == 1, F.concat_ws(" ", "arxiv_id", "title")).otherwise(F.col("title"))
    return rows.select(F.col("arxiv_id").alias("k"), content.alias("content"), F.lit(1).alias("turn")).distinct()


@query(PARSED + " SELECT k, url, found AS arxiv_id, domain, url IS NOT NULL OR found IS NOT NULL AS wanted FROM s")
def q_route(spark, d):
    return G.parse_sources(messages(spark, d)).select("k", "url", "arxiv_id", "domain", "wanted")


RESULTS = "(SELECT found AS src, count(*) > 1 AS success, '/out/' || found AS output_path, min(content) AS title FROM s WHERE found IS NOT NULL GROUP BY 1)"


@query(PARSED + f""", r AS {RESULTS}, j AS (SELECT s.k, coalesce(found, url) AS src, s.domain, coalesce(r.success, false) AS success, r.output_path, r.title, CASE WHEN r.src IS NULL THEN 'NO_RESULT' END AS code FROM s LEFT JOIN r ON r.src = coalesce(s.found, s.url))
  SELECT k, src AS request_source, domain, CASE WHEN src IS NOT NULL THEN success END AS success, CASE WHEN src IS NULL THEN NULL WHEN success THEN '번역이 완료되었습니다!' || chr(10) || chr(10) || '**논문**: ' || coalesce(title, '제목 없음') || chr(10) || '**출력 파일**: ' || coalesce(output_path, '')
  ELSE '번역에 실패했습니다.' || chr(10) || chr(10) || '**오류 코드**: ' || coalesce(code, 'UNKNOWN') || chr(10) || '**오류 메시지**: 알 수 없는 오류' END AS reply FROM j""")
def q_route_replies(spark, d):
    """The whole way of a message: source, request, result, reply."""
    asked = G.requests_of(G.parse_sources(messages(spark, d)))
    results = asked.where("arxiv_id is not null").groupBy(F.col("arxiv_id").alias("request_source")).agg((F.count("*") > 1).alias("success"), F.min("content").alias("title"))
    none = F.lit(None).cast("string")
    results = results.withColumns({"output_path": F.concat(F.lit("/out/"), "request_source"), "error_code": none, "error_message": none})
    return G.route(messages(spark, d), "k", ["turn"], results)


@query("""SELECT DISTINCT paper_doc_id, CASE WHEN source_path LIKE 'http%' THEN 'url' WHEN regexp_matches(translate(source_path, './', ''), '^[0-9]+$') THEN 'arxiv_id' ELSE 'file' END AS source_type,
  CASE WHEN trim(coalesce(source_path, '')) = '' THEN 'no_source' WHEN NOT source_path LIKE 'http%' AND NOT regexp_matches(translate(source_path, './', ''), '^[0-9]+$') AND total_pages IS NULL THEN 'no_file' WHEN title = 'Unknown' THEN 'unknown_domain' END AS error FROM parsed_papers""")
def q_request_errors(spark, d):
    rows = read(spark, d, "parsed_papers", "paper_doc_id", "source_path", "total_pages", "title")
    domain = F.when(F.col("title") == "Unknown", "History").otherwise("NLP")
    error = G.request_error(F.col("source_path"), domain, F.col("total_pages").isNotNull())
    return rows.select("paper_doc_id", T.source_type(F.col("source_path")).alias("source_type"), error.alias("error")).distinct()


@query("SELECT user_id, list_sort(list(DISTINCT event_type)) AS completed, CAST(count(DISTINCT event_type) / 8.0 * 100 AS DOUBLE) AS percent FROM events GROUP BY 1")
def q_progress(spark, d):
    return G.progress(read(spark, d, "events", "user_id", "event_type").withColumnRenamed("event_type", "node"), "user_id")


REQUESTS = "(SELECT DISTINCT CAST(paper_doc_id AS VARCHAR) AS request_id, source_path AS request_source, CASE WHEN total_pages IS NULL THEN 'running' WHEN title = 'Unknown' THEN 'failed' ELSE 'completed' END AS status FROM parsed_papers)"


def requests(spark, d):
    rows = read(spark, d, "parsed_papers", "paper_doc_id", "source_path", "total_pages", "title")
    status = F.when(F.col("total_pages").isNull(), "running").when(F.col("title") == "Unknown", "failed").otherwise("completed")
    return rows.select(F.col("paper_doc_id").cast("string").alias("request_id"), F.col("source_path").alias("request_source"), status.alias("status")).distinct()


@query(f"SELECT request_id, status, status IN ('pending', 'running') AS is_running FROM {REQUESTS} WHERE request_id = (SELECT CAST(min(paper_doc_id) AS VARCHAR) FROM parsed_papers WHERE total_pages IS NULL)")
def q_request_status(spark, d):
    asked = spark.read.parquet(f"{d}/parsed_papers.parquet").where("total_pages is null").agg(F.min("paper_doc_id").cast("string")).first()[0]
    return G.status_of(requests(spark, d), asked)


@query(f"SELECT request_id, request_source, status, CASE WHEN request_source LIKE 'http%' THEN 'url' WHEN regexp_matches(translate(request_source, './', ''), '^[0-9]+$') THEN 'arxiv_id' ELSE 'file' END AS source_type, '2025-01-01T00:00:00' AS created_at FROM {REQUESTS}")
def q_request_rows(spark, d):
    return G.request_row(requests(spark, d), F.lit("2025-01-01 00:00:00").cast("timestamp_ntz"))


@query("SELECT DISTINCT arxiv_id, 'https://arxiv.org/pdf/' || arxiv_id || '.pdf' AS url FROM arxiv_papers")
def q_pdf_url(spark, d):
    rows = read(spark, d, "arxiv_papers", "arxiv_id")
    return rows.select("arxiv_id", T.pdf_url(T.arxiv_id(F.concat(F.lit("https://arxiv.org/abs/"), "arxiv_id"))).alias("url"))


@query("""WITH r AS (SELECT r_regionkey, list(n_name ORDER BY n_nationkey) AS n FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1)
  SELECT r_regionkey, ['| name |' || chr(10) || '|---|' || chr(10) || array_to_string(list_transform(n, lambda x: '| ' || x || ' |'), chr(10))] AS tables FROM r""")
def q_markdown_tables(spark, d):
    """Two tables a row, one of them with a head alone, which is left out."""
    nation = spark.read.parquet(f"{d}/nation.parquet")
    row = F.struct("n_nationkey", F.array("n_name").alias("cells"))
    rows = nation.groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.transform(F.array_sort(F.collect_list(row)), lambda x: x.cells).alias("cells"))
    head = F.array(F.array(F.lit("name")))
    return rows.select("r_regionkey", T.markdown_tables(F.array(F.concat(head, "cells"), head)).alias("tables"))


# Summaries


@query(f"""WITH m AS ({TOPK}), n AS (SELECT translation_id, chunk_index, count(*) AS n FROM m GROUP BY 1, 2), c AS (SELECT DISTINCT translation_id, chunk_index FROM chunks),
  t AS (SELECT translation_id, count(*) AS a, count(n) AS b, coalesce(sum(n), 0) AS s FROM c LEFT JOIN n USING (translation_id, chunk_index) GROUP BY 1), f AS (SELECT translation_id, source_text, min({{'c': chunk_index, 'r': rank}}) AS met FROM m GROUP BY 1, 2),
  u AS (SELECT translation_id, count(*) AS u, (list(source_text ORDER BY met, source_text))[1:10] AS top FROM f GROUP BY 1)
  SELECT translation_id, CAST(a AS BIGINT) AS total_chunks, CAST(b AS BIGINT) AS chunks_with_terms, CAST(s AS BIGINT) AS total_matches, CAST(coalesce(u, 0) AS BIGINT) AS unique_terms, coalesce(top, []) AS top_terms FROM t LEFT JOIN u USING (translation_id)""")
def q_matching_summary(spark, d):
    return R.matching_summary(chunk_texts(spark, d), ranked_terms(spark, d), CHUNK, "translation_id")


N = f"len({TOK})"


@query(f"""WITH e AS (SELECT translation_id, CAST(count(*) AS BIGINT) AS c, CAST(sum({N.format("coalesce(section_title, '')")} + {N.format('content')} + 10) AS BIGINT) AS i FROM (SELECT DISTINCT translation_id, chunk_index, section_title, content FROM chunks) GROUP BY 1)
  SELECT translation_id, c AS total_chunks, i AS input_tokens, CAST(floor(i * 1.5) AS BIGINT) AS output_tokens, CAST(c * 2.0 AS DOUBLE) AS seconds FROM e""")
def q_token_estimate(spark, d):
    rows = read(spark, d, "chunks", *CHUNK, "section_title", "content")
    return R.token_estimate(rows, ["translation_id"], F.coalesce("section_title", F.lit("")), F.col("content"))


@query(f"""SELECT lang, CAST(sum(4 + {N.format("coalesce(source, '')")} + {N.format('text')}) + 2 AS BIGINT) AS tokens FROM documents GROUP BY 1""")
def q_message_tokens(spark, d):
    return R.message_tokens(read(spark, d, "documents", "doc_id", "lang", "source", "text"), ["lang"], ["source", "text"])


@query(PLAN + " SELECT CAST(count(*) FILTER (action = 'update_term') AS BIGINT) AS update_term, CAST(count(*) FILTER (action = 'add_term') AS BIGINT) AS add_term, CAST(count(*) FILTER (action = 'skip') AS BIGINT) AS skip FROM p")
def q_action_counts(spark, d):
    return R.action_counts(plan(spark, d), ["update_term", "add_term", "skip"])


APPLIED = PLAN + """, a2 AS (SELECT substr(key, 1, 1) AS file, CAST(count(*) FILTER (action = 'update_term') AS BIGINT) AS terms_updated, CAST(count(*) FILTER (action = 'add_term') AS BIGINT) AS terms_added,
  CAST(count(*) FILTER (action = 'log_change') AS BIGINT) AS changes_logged, bool_or(action = 'update_hash') AS hash_updated FROM p GROUP BY 1)"""


@query(APPLIED + " SELECT * FROM a2")
def q_applied_counts(spark, d):
    return B.applied_counts(plan(spark, d).withColumn("file", F.substring("key", 1, 1)), ["file"])


@query(APPLIED + """ SELECT CAST(count(*) AS BIGINT) AS total_files, CAST(count(*) FILTER (terms_updated > 0) AS BIGINT) AS success, CAST(count(*) FILTER (NOT terms_updated > 0) AS BIGINT) AS failed, CAST(sum(terms_updated) AS BIGINT) AS terms_updated,
  CAST(sum(terms_added) AS BIGINT) AS terms_added, CAST(sum(changes_logged) AS BIGINT) AS changes_logged FROM a2""")
def q_sync_summary(spark, d):
    return B.sync_summary(q_applied_counts(spark, d).withColumn("success", F.col("terms_updated") > 0))


@query(PLAN + """, c2 AS (SELECT action, count(*) AS n FROM p GROUP BY 1), w AS (SELECT action, source_text, new_target, row_number() OVER (PARTITION BY action ORDER BY source_text, new_target) AS o FROM p),
  b AS (SELECT action, string_agg('  • ' || source_text || ' → ' || coalesce(new_target, ''), chr(10) ORDER BY o) AS body FROM w WHERE o <= 5 GROUP BY 1)
  SELECT action, action || ' (' || n || ')' || chr(10) || body || CASE WHEN n > 5 THEN chr(10) || '  ... ' || (n - 5) ELSE '' END AS text FROM b JOIN c2 USING (action)""")
def q_preview_text(spark, d):
    return B.preview_text(B.plan_preview(plan(spark, d)))


@query()
def q_change_summary(spark, d):
    """Counts of line changes by type; tested against a plain loop."""
    return B.change_summary(B.merge_changes(B.line_changes(edited(spark, d), "doc_id", "text", "edited"), "doc_id"), "doc_id")


@query()
def q_diff_report(spark, d):
    return B.diff_report(B.merge_changes(B.line_changes(edited(spark, d), "doc_id", "text", "edited"), "doc_id"), "doc_id")


@query()
def q_changes_text(spark, d):
    return B.changes_text(B.merge_changes(B.line_changes(edited(spark, d), "doc_id", "text", "edited"), "doc_id"), "doc_id")


TV = "(SELECT DISTINCT * FROM term_validations)"


@query(f"""WITH n AS (SELECT translation_id, chunk_index, count(*) FILTER (status = 'missing') AS m, count(*) FILTER (status = 'mismatched') AS x, count(*) FILTER (corrected) AS c FROM {TV} GROUP BY 1, 2), t AS (SELECT DISTINCT translation_id, chunk_index, status FROM translated_chunks)
  SELECT translation_id, chunk_index, status AS chunk_status, CAST(CASE WHEN status = 'completed' THEN coalesce(m, 0) ELSE 0 END AS BIGINT) AS missing_terms, CAST(CASE WHEN status = 'completed' THEN coalesce(x, 0) ELSE 0 END AS BIGINT) AS mismatched_terms,
  CAST(CASE WHEN status = 'completed' THEN coalesce(c, 0) ELSE 0 END AS BIGINT) AS corrections FROM t LEFT JOIN n USING (translation_id, chunk_index)""")
def q_check_chunks(spark, d):
    chunks = read(spark, d, "translated_chunks", *CHUNK, "status").withColumnRenamed("status", "chunk_status")
    return M.check_chunks(read(spark, d, "term_validations", "validation_id", *CHUNK, "status", "corrected"), chunks, CHUNK)


@query(f"""SELECT CAST(count(*) AS BIGINT) AS n_checks, CAST(count(*) FILTER (status = 'matched') AS BIGINT) AS n_matched, CAST(count(*) FILTER (status = 'similar') AS BIGINT) AS n_similar, CAST(count(*) FILTER (status = 'mismatched') AS BIGINT) AS n_mismatched, CAST(count(*) FILTER (status = 'missing') AS BIGINT) AS n_missing,
  CAST(count(*) FILTER (corrected) AS BIGINT) AS n_corrected, round(count(*) FILTER (corrected) * 100.0 / count(*), 2) AS correction_rate, round(count(*) FILTER (status IN ('matched', 'similar')) * 100.0 / count(*), 2) AS match_rate FROM {TV}""")
def q_check_totals(spark, d):
    return M.status_summary(read(spark, d, "term_validations", "validation_id", "status", "corrected"), [])


@query("""WITH k AS (SELECT translation_id, 'chunks' AS s FROM (SELECT DISTINCT translation_id, chunk_index FROM chunks) UNION ALL SELECT translation_id, 'translated' FROM (SELECT DISTINCT translation_id, chunk_index FROM translated_chunks) UNION ALL SELECT translation_id, 'checks' FROM (SELECT DISTINCT translation_id, validation_id FROM term_validations))
  SELECT translation_id, CAST(count(*) FILTER (s = 'chunks') AS BIGINT) AS chunks, CAST(count(*) FILTER (s = 'translated') AS BIGINT) AS translated, CAST(count(*) FILTER (s = 'checks') AS BIGINT) AS checks FROM k GROUP BY 1""")
def q_stage_counts(spark, d):
    stages = {"chunks": read(spark, d, "chunks", *CHUNK), "translated": read(spark, d, "translated_chunks", *CHUNK), "checks": read(spark, d, "term_validations", "translation_id", "validation_id")}
    return R.stage_counts("translation_id", stages)


@query(f"""WITH v AS (SELECT DISTINCT v.*, c.section_title FROM {TV} v JOIN (SELECT DISTINCT translation_id, chunk_index, section_title FROM chunks) c USING (translation_id, chunk_index)),
  h AS (SELECT translation_id, '# 용어 교정 보고서' || chr(10) || chr(10) || '## 요약' || chr(10) || chr(10) || '- 검사 용어: ' || count(*) || chr(10) || '- 매칭 성공: ' || count(*) FILTER (status = 'matched') || chr(10) || '- 유사 매칭: ' || count(*) FILTER (status = 'similar') || chr(10) || '- 누락 용어: ' || count(*) FILTER (status = 'missing')
   || chr(10) || '- 불일치 용어: ' || count(*) FILTER (status = 'mismatched') || chr(10) || '- 교정 횟수: ' || count(*) FILTER (corrected) || chr(10) || '- 매칭률: ' || CAST(CAST(round(count(*) FILTER (status IN ('matched', 'similar')) * 100 / count(*), 2) AS DECIMAL(5, 2)) AS VARCHAR) || '%' || chr(10) || chr(10) || '## 상세 내역' || chr(10) AS head FROM v GROUP BY 1),
  p AS (SELECT translation_id, chunk_index, '### 청크 ' || chunk_index || ' (' || coalesce(min(section_title), '') || ')' || chr(10) || chr(10) || string_agg('- ' || CASE WHEN status = 'missing' THEN '❌' ELSE '⚠️' END || ' **' || source_text || '**: 예상 ''' || expected_target || ''', 실제 ''' || coalesce(nullif(actual_target, ''), '(없음)') || '''' || CASE WHEN corrected THEN ' ✅ 교정됨' ELSE '' END, chr(10) ORDER BY validation_id) || chr(10) AS part
   FROM v WHERE status IN ('missing', 'mismatched') GROUP BY 1, 2), b AS (SELECT translation_id, string_agg(part, chr(10) ORDER BY chunk_index) AS body FROM p GROUP BY 1)
  SELECT translation_id, concat_ws(chr(10), head, body) AS report FROM h LEFT JOIN b USING (translation_id)""")
def q_correction_report(spark, d):
    rows = read(spark, d, "term_validations").join(read(spark, d, "chunks", *CHUNK, "section_title"), CHUNK)
    return R.correction_report(rows, "translation_id")


@query(f"""SELECT validation_id, list_transform(range(0, len(string_split(lower(translated_text), lower(expected_target))) - 1), lambda i: CAST(list_sum(list_transform(string_split(lower(translated_text), lower(expected_target))[1 : i + 1], lambda x: length(x))) + i * length(expected_target) AS INT)) AS starts FROM {V} WHERE expected_target <> ''""")
def q_term_places(spark, d):
    rows = checks(spark, d).where("expected_target <> ''")
    return rows.select("validation_id", F.transform(M.places(F.col("translated_text"), F.col("expected_target")), lambda p: p["start"]).alias("starts"))


@query(f"""WITH m AS ({TOPK}), g AS (SELECT translation_id, chunk_index, string_agg('- ' || source_text || ' → ' || target_text || CASE WHEN domain <> '' THEN ' (' || domain || ')' ELSE '' END, chr(10) ORDER BY rank) AS prompt FROM m JOIN (SELECT id, domain FROM terminology) USING (id) GROUP BY 1, 2)
  SELECT c.translation_id, c.chunk_index, 'Translate.' || CASE WHEN prompt <> '' THEN chr(10) || '## 용어집' || chr(10) || prompt ELSE '' END || CASE WHEN section_title <> '' THEN chr(10) || '## 컨텍스트' || chr(10) || section_title ELSE '' END AS system
  FROM (SELECT DISTINCT translation_id, chunk_index, section_title FROM chunks) c LEFT JOIN g USING (translation_id, chunk_index)""")
def q_system_prompt(spark, d):
    prompts = M.term_prompt(ranked_terms(spark, d), CHUNK, "domain")
    rows = read(spark, d, "chunks", *CHUNK, "section_title").join(prompts, CHUNK, "left")
    return rows.select(*CHUNK, T.system_prompt("Translate.", F.col("prompt"), F.col("section_title")).alias("system"))


@query("""SELECT DISTINCT id, CASE WHEN change_type = 'delete' THEN 'failed' ELSE new_target_text END AS analysis FROM term_changes WHERE new_target_text IS NOT NULL""")
def q_json_object(spark, d):
    """A reply as an object, with another where it is no JSON."""
    rows = read(spark, d, "term_changes", "id", "new_target_text", "change_type").where("new_target_text is not null")
    reply = F.when(F.col("change_type") == "delete", "no json at all").otherwise(F.to_json(F.struct(F.col("new_target_text").alias("analysis"))))
    parsed = F.from_json(reply, "analysis string")["analysis"]
    return rows.select("id", F.coalesce(parsed, F.lit("failed")).alias("analysis")).distinct()


# Documents


NAMED = "|".join(T.CHUNK_HEADER_NAMES)
STRIPPED = r"regexp_replace(line, '^\s+|\s+$', '', 'g')"


@query(rf"""WITH l AS (SELECT paper_doc_id, line, CAST(coalesce(sum(length(line) + 1) OVER (PARTITION BY paper_doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS line_start FROM ({LINES})),
  t AS (SELECT paper_doc_id, line_start, nullif(regexp_replace(coalesce(nullif(regexp_extract({STRIPPED}, '(?i)^(\d+(?:\.\d+)*)\s+([A-Z][^.!?\n]{{2,}}?)$', 2), ''), nullif(regexp_extract({STRIPPED}, '(?i)^((?:{NAMED}))\s*$', 1), ''), nullif(regexp_extract({STRIPPED}, '^#+\s+(.+)$', 1), '')), '^\s+|\s+$', '', 'g'), '') AS title FROM l)
  SELECT * FROM t WHERE title IS NOT NULL""")
def q_chunk_headers(spark, d):
    return D.chunk_headers(papers(spark, d), "paper_doc_id", "raw_text")


@query(f"""WITH t AS (SELECT paper_doc_id, {TOK.format('raw_text')} AS t FROM {P}), s AS (SELECT paper_doc_id, t, unnest(CASE WHEN len(t) <= 300 THEN [0] ELSE range(0, len(t), 250) END) AS s FROM t WHERE len(t) > 0),
  c AS (SELECT paper_doc_id, CAST(s // 250 AS INT) AS chunk_index, array_to_string(t[s + 1 : s + 300], ' ') AS content, CAST(least(300, len(t) - s) AS INT) AS token_count, s > 0 AS has_overlap FROM s),
  o AS (SELECT *, CAST(coalesce(sum(length(content)) OVER (PARTITION BY paper_doc_id ORDER BY chunk_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_char FROM c)
  SELECT paper_doc_id, chunk_index, 'Full Document' AS section_title, chunk_index AS section_index, content, token_count, start_char, CAST(start_char + length(content) AS BIGINT) AS end_char, has_overlap FROM o""")
def q_whole_chunks(spark, d):
    return D.whole_chunks(papers(spark, d), "paper_doc_id", "raw_text", 300, 50)


@query(f"""WITH x AS (SELECT DISTINCT paper_doc_id, section_ord, title, content FROM parsed_sections), o AS (SELECT *, CAST(coalesce(sum(length(content)) OVER (PARTITION BY paper_doc_id ORDER BY section_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_char FROM x)
  SELECT paper_doc_id, CAST(row_number() OVER (PARTITION BY paper_doc_id ORDER BY section_ord) - 1 AS INT) AS chunk_index, title AS section_title, CAST({N.format('content')} AS INT) AS token_count, start_char, CAST(start_char + length(content) AS BIGINT) AS end_char FROM o""")
def q_whole_sections(spark, d):
    parts = read(spark, d, "parsed_sections", "paper_doc_id", "section_ord", "title", "content")
    return D.section_chunks(parts, "paper_doc_id", "section").select("paper_doc_id", "chunk_index", "section_title", "token_count", "start_char", "end_char")


@query("SELECT DISTINCT translation_id, chunk_index, section_index, CASE WHEN section_index = 0 THEN ['t' || chunk_index] ELSE [] END AS tables FROM chunks")
def q_first_tables(spark, d):
    rows = read(spark, d, "chunks", *CHUNK, "section_index")
    tables = rows.select(*CHUNK, F.array(F.concat(F.lit("t"), F.col("chunk_index").cast("string"))).alias("tables"))
    return D.first_tables(rows, tables, CHUNK)


@query(rf"""SELECT paper_doc_id, coalesce(list_filter(list_transform(string_split(raw_text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: length(x) > 10 AND NOT starts_with(x, '['))[1], 'Unknown') AS title,
  CAST(len(regexp_extract_all(raw_text, '\[PAGE \d+\]')) AS INT) AS total_pages FROM {P}""")
def q_heads(spark, d):
    return pipeline.heads(papers(spark, d), "paper_doc_id", "raw_text").drop("arxiv_id")


BODY = ASSEMBLE + f""", r AS (SELECT *, row_number() OVER (PARTITION BY translation_id ORDER BY f, section_title NULLS FIRST) AS o FROM g),
  m AS (SELECT translation_id, string_agg('## ' || coalesce({TITLED}, '') || chr(10) || chr(10) || content, chr(10) || chr(10) ORDER BY o) AS body FROM r GROUP BY 1)"""
NN = "chr(10) || chr(10)"


@query(BODY + f""" SELECT translation_id, '# Paper ' || translation_id || {NN} || '> 번역일: 2025-01-01' || {NN} || '---' || {NN} || body || {NN} || '---' || {NN} || '*end*' AS markdown FROM m""")
def q_render_simple(spark, d):
    rows = D.assemble(translated(spark, d), "translation_id")
    head = rows.select("translation_id").distinct().select("translation_id", F.concat(F.lit("Paper "), "translation_id").alias("title"), F.lit(None).cast("string").alias("arxiv_id"), F.lit("2025-01-01").alias("translated_date"))
    return D.render_simple(rows, head, "translation_id", "*end*").select("translation_id", "markdown")


@query(BODY + f""", v AS (SELECT translation_id, source_text, arg_min(expected_target, {{'c': chunk_index, 'v': validation_id}}) AS t, min({{'c': chunk_index, 'v': validation_id}}) AS a FROM {TV} GROUP BY 1, 2),
  w AS (SELECT *, row_number() OVER (PARTITION BY translation_id ORDER BY a, source_text) AS o FROM v), u AS (SELECT translation_id, string_agg('| ' || coalesce(source_text, '') || ' | ' || coalesce(t, '') || ' |', chr(10) ORDER BY o) FILTER (o <= 20) AS t, count(*) AS n FROM w GROUP BY 1)
  SELECT translation_id, concat_ws({NN}, '# 논문 ' || translation_id, '> **원제**: Paper ' || translation_id || chr(10) || '> **저자**: A, B' || chr(10) || '> **번역일**: 2025-01-01' || chr(10) || '> **분야**: NLP', '---', '## 초록 (Abstract)' || {NN} || 'About.' || {NN} || '---', body, '---',
  '## 번역 정보' || {NN} || '| 항목 | 값 |' || chr(10) || '|------|-----|' || chr(10) || '| 원본 페이지 | 3 |' || chr(10) || '| 총 청크 수 | N/A |' || chr(10) || '| 번역 토큰 | N/A |' || chr(10) || '| 용어 매칭률 | N/A |',
  CASE WHEN n > 0 THEN '### 사용된 전문용어' || {NN} || '| 원문 | 번역 |' || chr(10) || '|------|------|' || chr(10) || u.t || CASE WHEN n > 20 THEN chr(10) || '| ... | (' || (n - 20) || '개 더) |' ELSE '' END END) AS markdown FROM m LEFT JOIN u USING (translation_id)""")
def q_render_full(spark, d):
    rows = D.assemble(translated(spark, d), "translation_id")
    none = lambda kind: F.lit(None).cast(kind)
    head = rows.select("translation_id").distinct().select(
        "translation_id", F.concat(F.lit("Paper "), "translation_id").alias("title"), F.concat(F.lit("논문 "), "translation_id").alias("title_ko"), none("string").alias("arxiv_id"), F.array(F.lit("A"), F.lit("B")).alias("authors"), F.lit("2025-01-01").alias("translated_date"),
        F.lit("NLP").alias("domain"), F.lit("About.").alias("abstract"), F.lit(3).alias("total_pages"), none("long").alias("total_chunks"), none("long").alias("total_tokens"), none("double").alias("match_rate"),
    )
    checked = read(spark, d, "term_validations", *CHUNK, "validation_id", "source_text", F.col("expected_target").alias("target_text"))
    used = M.terms_used(checked, "translation_id", ["chunk_index", "validation_id"])
    return D.render_full(rows, head, used, "translation_id").select("translation_id", "markdown")


# The whole dataflow


def stub(text: str, prompt: str, hint: str) -> str:
    """A call that needs no service: what it was given, in order."""
    return f"{hint}\n{text}\n{prompt}"


@query(SECTIONS + rf""", sec AS (SELECT paper_doc_id, section_ord, title, {CLEAN.format('content')} AS content FROM r WHERE NOT (lower(title) LIKE '%reference%' OR lower(title) LIKE '%bibliography%')),
  tk AS (SELECT *, {TOK.format('content')} AS t FROM sec), st AS (SELECT *, unnest(CASE WHEN len(t) <= 120 THEN [0] ELSE range(0, len(t), 100) END) AS s FROM tk WHERE len(t) > 0),
  ch AS (SELECT paper_doc_id, title AS section_title, s // 100 AS section_index, array_to_string(t[s + 1 : s + 120], ' ') AS content, row_number() OVER (PARTITION BY paper_doc_id ORDER BY section_ord, s) - 1 AS chunk_index FROM st),
  mt AS (SELECT paper_doc_id, chunk_index, t.id, t.source_text, t.target_text, t.usage_count, (length(lower(content)) - length(replace(lower(content), lower(source_text), ''))) // length(lower(source_text)) AS n FROM ch JOIN terminology t ON contains(lower(content), lower(source_text))),
  rk AS (SELECT *, row_number() OVER (PARTITION BY paper_doc_id, chunk_index ORDER BY usage_count DESC NULLS LAST, n DESC, source_text, id) AS rank FROM mt), pr AS (SELECT paper_doc_id, chunk_index, string_agg('- ' || source_text || ' → ' || target_text, chr(10) ORDER BY rank) AS prompt FROM rk WHERE rank <= 5 GROUP BY 1, 2),
  ti AS (SELECT paper_doc_id, coalesce(list_filter(list_transform(string_split(raw_text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: length(x) > 10 AND NOT starts_with(x, '['))[1], 'Unknown') AS title FROM {P}),
  ou AS (SELECT ch.paper_doc_id, ch.chunk_index, section_title, concat_ws(' | ', 'Paper: ' || ti.title, CASE WHEN section_title <> '' AND section_title <> 'Main Content' THEN 'Section: ' || section_title END, CASE WHEN section_index > 0 THEN 'Part ' || (section_index + 1) END) || chr(10) || content || chr(10) || coalesce(prompt, '') AS out
   FROM ch LEFT JOIN pr USING (paper_doc_id, chunk_index) JOIN ti USING (paper_doc_id)),
  gr AS (SELECT paper_doc_id, section_title, min(chunk_index) AS f, string_agg(out, {NN} ORDER BY chunk_index) AS content FROM ou GROUP BY 1, 2)
  SELECT paper_doc_id, string_agg('## ' || coalesce({TITLED}, '') || {NN} || content, {NN} ORDER BY f, section_title) AS body FROM gr GROUP BY 1""")
def q_translate_documents(spark, d):
    """The whole dataflow with a call that needs no service; of each result the body between head and figures."""
    settings = Settings(max_tokens=120, overlap=20, term_limit=5, retry_delay=0.0)
    made = pipeline.translate_documents(papers(spark, d), "paper_doc_id", "raw_text", read(spark, d, "terminology"), stub, settings, fuzzy=False)
    body = F.regexp_extract("markdown", r"(?s)^.*?\n\n---\n\n(## .*)\n\n---\n\n## 번역 정보", 1)
    return made.select("paper_doc_id", body.alias("body"))

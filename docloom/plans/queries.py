"""Queries of the document and term operators over the project's tables, with SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.functions.similarity import best_word, similarity
from docloom.operators import documents as D
from docloom.operators import enrich as E
from docloom.operators import feedback as B
from docloom.operators import terms as M
from docloom.plans import pipeline
from docloom.sources import io as S
from docloom.sources import papers as PAPERS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
CHUNK = ["translation_id", "chunk_index"]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


UNIQUE = ("documents", "benchmark", "terminology", "events")


def read(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A table without repeated rows; tables with a unique key, if that is read, are not shuffled for it."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    df = df.select(*columns) if columns else df
    return df if name in UNIQUE and (not columns or columns[0] in ("doc_id", "id", "item_id", "event_id", "user_id")) else df.distinct()


def chunk_texts(spark, d):
    return read(spark, d, "chunks", *CHUNK, "content")


def all_terms(spark, d):
    return read(spark, d, "terminology")


C = "(SELECT DISTINCT translation_id, chunk_index, content FROM chunks)"
MATCH = f"""SELECT c.translation_id, c.chunk_index, t.id, t.source_text, t.target_text, t.usage_count,
  CAST((length(lower(content)) - length(replace(lower(content), lower(source_text), ''))) // length(lower(source_text)) AS BIGINT) AS match_count
  FROM {C} c JOIN terminology t ON contains(lower(content), lower(source_text))"""


# Terms in texts


@query(f"SELECT translation_id, chunk_index, source_text FROM ({MATCH.replace('terminology t', "(SELECT * FROM terminology WHERE domain = 'NLP') t")})")
def q_terms_of_domain(spark, d):
    terms = read(spark, d, "terminology").where("domain = 'NLP'")
    return M.match_terms(chunk_texts(spark, d), CHUNK, "content", terms).select(*CHUNK, "source_text")


@query(f"SELECT translation_id, chunk_index, source_text, match_count FROM ({MATCH})")
def q_term_match(spark, d):
    return M.match_terms(chunk_texts(spark, d), CHUNK, "content", all_terms(spark, d)).select(*CHUNK, "source_text", "match_count")


@query(f"SELECT translation_id, chunk_index, source_text, match_count FROM ({MATCH})")
def q_term_match_large(spark, d):
    """The same through the join on letters, the way of dictionaries beyond the broadcast limit."""
    found = M.match_terms(chunk_texts(spark, d), CHUNK, "content", all_terms(spark, d), broadcast_bytes=0)
    return found.select(*CHUNK, "source_text", "match_count")


TOPK = f"""SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY translation_id, chunk_index
  ORDER BY usage_count DESC NULLS LAST, match_count DESC, source_text, id) AS INT) AS rank FROM ({MATCH})) WHERE rank <= 3"""


def ranked_terms(spark, d):
    found = M.match_terms(chunk_texts(spark, d), CHUNK, "content", all_terms(spark, d))
    return M.top_terms(found, CHUNK, 3)


@query(f"SELECT translation_id, chunk_index, source_text, match_count, rank FROM ({TOPK})")
def q_term_topk(spark, d):
    return ranked_terms(spark, d).select(*CHUNK, "source_text", "match_count", "rank")


@query(f"""SELECT translation_id, chunk_index, source_text FROM {C} c JOIN (SELECT * FROM terminology
  ORDER BY usage_count DESC NULLS FIRST, source_text, id LIMIT 50) t ON contains(lower(content), lower(source_text))""")
def q_match_limit_then_filter(spark, d):
    top = M.first_by_usage(read(spark, d, "terminology"), 50)
    return M.match_terms(chunk_texts(spark, d), CHUNK, "content", top).select(*CHUNK, "source_text")


@query(f"""WITH m AS ({TOPK}), g AS (SELECT DISTINCT id, translation_id, source_text, new_target_text AS target_text, created_at FROM term_changes WHERE new_target_text IS NOT NULL AND translation_id IS NOT NULL),
  e AS (SELECT translation_id, source_text, target_text, CAST(row_number() OVER (PARTITION BY translation_id ORDER BY created_at, id) AS INT) AS ord FROM g), x AS (SELECT c.translation_id, c.chunk_index, e.* EXCLUDE (translation_id) FROM {C} c JOIN e USING (translation_id)),
  n AS (SELECT x.* FROM x WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.translation_id = x.translation_id AND m.chunk_index = x.chunk_index AND lower(m.source_text) = lower(x.source_text))),
  u AS (SELECT translation_id, chunk_index, source_text, target_text, 0 AS kind, rank AS ord FROM m UNION ALL SELECT translation_id, chunk_index, source_text, target_text, 1, ord FROM n)
  SELECT translation_id, chunk_index, source_text, target_text, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY translation_id, chunk_index ORDER BY kind, ord, source_text) AS INT) AS rank FROM u) WHERE rank <= 5""")
def q_extra_terms(spark, d):
    from pyspark.sql import Window as W

    log = read(spark, d, "term_changes", "id", "translation_id", "source_text", F.col("new_target_text").alias("target_text"), "created_at").where("target_text is not null and translation_id is not null")
    log = log.select("translation_id", "source_text", "target_text", F.row_number().over(W.partitionBy("translation_id").orderBy("created_at", "id")).alias("ord"))
    return M.extra_terms(chunk_texts(spark, d), ranked_terms(spark, d), log, CHUNK, ["translation_id"], 3, 5).select(*CHUNK, "source_text", "target_text", "rank")


@query("""WITH c AS (SELECT translation_id, string_agg(content, ' ' ORDER BY chunk_index, content) AS content FROM (SELECT DISTINCT translation_id, chunk_index, content FROM chunks) GROUP BY 1)
  SELECT translation_id, source_text FROM c JOIN terminology t ON contains(lower(content), lower(source_text))""")
def q_doc_level_match(spark, d):
    whole = chunk_texts(spark, d).groupBy("translation_id").agg(D.join_ordered("content", ["chunk_index"], " ").alias("content"))
    return M.match_terms(whole, ["translation_id"], "content", all_terms(spark, d)).select("translation_id", "source_text")


@query(f"""SELECT translation_id, chunk_index, string_agg('- ' || source_text || ' → ' || target_text, chr(10) ORDER BY rank) AS prompt FROM ({TOPK}) GROUP BY 1, 2""")
def q_term_prompt(spark, d):
    return M.term_prompt(ranked_terms(spark, d), CHUNK)


@query("""SELECT DISTINCT translation_id, chunk_index, section_index, concat_ws(' | ', CASE WHEN section_title <> '' AND section_title <> 'Main Content' THEN 'Section: ' || section_title END,
  CASE WHEN section_index > 0 THEN 'Part ' || (section_index + 1) END) AS hint FROM chunks""")
def q_context_hint(spark, d):
    rows = read(spark, d, "chunks", *CHUNK, "section_title", "section_index")
    return rows.select(*CHUNK, "section_index", D.context_hint(F.lit(""), F.col("section_title"), F.col("section_index")).alias("hint")).distinct()


# Catalog


@query("SELECT id, source_text, target_text FROM terminology WHERE source_text ILIKE '%prompt%' OR target_text ILIKE '%프롬프트%'")
def q_search_terms(spark, d):
    return read(spark, d, "terminology").where(F.col("source_text").ilike("%prompt%") | F.col("target_text").ilike("%프롬프트%")).select("id", "source_text", "target_text")


@query("SELECT id, source_text, usage_count FROM terminology WHERE domain = 'General' AND mapping_type = 'phrase' ORDER BY usage_count DESC NULLS FIRST, source_text, id LIMIT 20")
def q_filter_order_limit(spark, d):
    rows = read(spark, d, "terminology").where("domain = 'General' and mapping_type = 'phrase'")
    return M.first_by_usage(rows, 20).select("id", "source_text", "usage_count")


@query("SELECT source_text, domain, target_text FROM terminology WHERE source_text = 'tidal prompt'")
def q_point_lookup(spark, d):
    return read(spark, d, "terminology").where("source_text = 'tidal prompt'").select("source_text", "domain", "target_text")


@query("SELECT DISTINCT id, change_type, created_at FROM term_changes ORDER BY created_at DESC, id LIMIT 100")
def q_newest_changes(spark, d):
    return read(spark, d, "term_changes", "id", "change_type", "created_at").orderBy(F.desc("created_at"), "id").limit(100)


@query("""WITH t AS (SELECT DISTINCT id, created_at, terminology_id FROM term_changes WHERE terminology_id IS NOT NULL)
  SELECT terminology_id, id, CAST(row_number() OVER (PARTITION BY terminology_id ORDER BY created_at DESC, id) AS INT) AS place FROM t""")
def q_change_history(spark, d):
    from pyspark.sql import Window as W

    rows = read(spark, d, "term_changes", "id", "created_at", "terminology_id").where("terminology_id is not null")
    return rows.select("terminology_id", "id", F.row_number().over(W.partitionBy("terminology_id").orderBy(F.desc("created_at"), "id")).alias("place"))


@query("SELECT domain, CAST(count(*) AS BIGINT) AS n FROM terminology GROUP BY 1")
def q_terms_per_domain(spark, d):
    return read(spark, d, "terminology").groupBy("domain").agg(F.count("*").alias("n"))


@query("""WITH p AS (SELECT *, CAST(row_number() OVER (ORDER BY usage_count DESC NULLS LAST, id) AS BIGINT) AS n FROM terminology)
  SELECT id, source_text, CAST(ceil((SELECT count(*) FROM terminology) / 25.0) AS BIGINT) AS pages FROM p WHERE n BETWEEN 51 AND 75""")
def q_page(spark, d):
    rows = read(spark, d, "terminology")
    pages = -(-rows.count() // 25)
    return rows.orderBy(F.desc_nulls_last("usage_count"), "id").offset(50).limit(25).select("id", "source_text", F.lit(pages).cast("long").alias("pages"))


@query("""WITH n AS (SELECT terminology_id, count(*) AS n FROM (SELECT DISTINCT id, terminology_id FROM term_changes) GROUP BY 1)
  SELECT t.id, CAST(t.usage_count + coalesce(n.n, 0) AS BIGINT) AS usage_count FROM terminology t LEFT JOIN n ON n.terminology_id = t.id""")
def q_usage_increment(spark, d):
    used = read(spark, d, "term_changes", "id", "terminology_id").select(F.col("terminology_id").alias("id"))
    return S.increment(read(spark, d, "terminology"), "id", "usage_count", used).select("id", F.col("usage_count").cast("long"))


UPSERT = """WITH c AS (SELECT source_text, max(new_target_text) AS target_text FROM term_changes WHERE change_type <> 'delete' AND new_target_text IS NOT NULL GROUP BY 1),
  n AS (SELECT source_text, 'General' AS domain, target_text FROM c)"""


@query(UPSERT + """ SELECT t.id, coalesce(n.source_text, t.source_text) AS source_text, coalesce(n.domain, t.domain) AS domain, coalesce(n.target_text, t.target_text) AS target_text, t.usage_count, t.mapping_type
  FROM terminology t FULL JOIN n ON n.source_text = t.source_text AND n.domain = t.domain""")
def q_upsert(spark, d):
    new = read(spark, d, "term_changes").where("change_type <> 'delete' and new_target_text is not null").groupBy("source_text").agg(F.max("new_target_text").alias("target_text"))
    return S.upsert(read(spark, d, "terminology"), new.withColumn("domain", F.lit("General")), ["source_text", "domain"]).select("id", "source_text", "domain", "target_text", "usage_count", "mapping_type")


@query("""WITH u AS (SELECT terminology_id AS id, max(new_target_text) AS target_text FROM term_changes WHERE change_type = 'update' AND terminology_id IS NOT NULL GROUP BY 1)
  SELECT t.id, t.source_text, coalesce(u.target_text, t.target_text) AS target_text, t.usage_count FROM terminology t LEFT JOIN u USING (id)""")
def q_update_whitelist(spark, d):
    changes = read(spark, d, "term_changes").where("change_type = 'update' and terminology_id is not null")
    changes = changes.groupBy(F.col("terminology_id").alias("id")).agg(F.max("new_target_text").alias("target_text"), F.lit(0).alias("usage_count"))
    allowed = ["target_text", "mapping_type", "domain", "confidence", "is_user_defined"]
    return S.update_columns(read(spark, d, "terminology"), "id", changes, allowed).select("id", "source_text", "target_text", "usage_count")


GONE = "(SELECT translation_id FROM translated_chunks WHERE status = 'failed' GROUP BY 1)"


@query(f"SELECT DISTINCT translation_id, chunk_index FROM chunks WHERE translation_id NOT IN {GONE}")
def q_delete_cascade(spark, d):
    gone = read(spark, d, "translated_chunks").where("status = 'failed'").select("translation_id").distinct()
    return S.delete_keys(read(spark, d, "chunks", *CHUNK), "translation_id", gone)


@query(f"SELECT DISTINCT id, CASE WHEN translation_id NOT IN {GONE} THEN translation_id END AS translation_id FROM term_changes")
def q_delete_set_null(spark, d):
    gone = read(spark, d, "translated_chunks").where("status = 'failed'").select("translation_id").distinct()
    return S.null_references(read(spark, d, "term_changes", "id", "translation_id"), "translation_id", gone)


@query("""SELECT source_text, domain, r.target_text, CASE WHEN k.id IS NULL THEN 'add' ELSE 'skip' END AS action FROM
  (SELECT DISTINCT source_text, new_target_text AS target_text, 'General' AS domain FROM term_changes WHERE source_text <> '' AND new_target_text <> '') r
  LEFT JOIN terminology k USING (source_text, domain)""")
def q_import_actions(spark, d):
    raw = read(spark, d, "term_changes").select("source_text", F.col("new_target_text").alias("target_text")).distinct()
    return S.import_actions(S.normalize_terms(raw), read(spark, d, "terminology"), overwrite=False).select("source_text", "domain", "target_text", "action")


# Documents


P = "(SELECT DISTINCT paper_doc_id, raw_text FROM parsed_papers)"


def papers(spark, d):
    return read(spark, d, "parsed_papers", "paper_doc_id", "raw_text")


CLEAN = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({}, ' +', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '\[PAGE \d+\]\s*', '', 'g'), '-\s*\n\s*', '', 'g'), '^\s+|\s+$', '', 'g')"


@query(f"SELECT paper_doc_id, {CLEAN.format('raw_text')} AS cleaned FROM {P}")
def q_clean_text(spark, d):
    return papers(spark, d).select("paper_doc_id", T.clean_text(F.col("raw_text")).alias("cleaned"))


LINES = f"SELECT paper_doc_id, CAST(n AS INT) AS line_no, line FROM (SELECT paper_doc_id, unnest(string_split(raw_text, chr(10))) AS line, generate_subscripts(string_split(raw_text, chr(10)), 1) - 1 AS n FROM {P})"


@query(f"""SELECT paper_doc_id, line_no, line, CAST(coalesce(sum(length(line) + 1) OVER (PARTITION BY paper_doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS line_start FROM ({LINES})""")
def q_line_offsets(spark, d):
    return D.lines(papers(spark, d), "paper_doc_id", "raw_text")


NAMES = "|".join(T.HEADER_NAMES)
SECTIONS = rf"""WITH l AS ({LINES}), h AS (SELECT *, regexp_matches(regexp_replace(line, '^\s+|\s+$', '', 'g'), '(?i)^(\d+\.?\s*)?({NAMES})s?\s*$')
   OR regexp_matches(regexp_replace(line, '^\s+|\s+$', '', 'g'), '(?i)^\d+\.\s+[A-Z][A-Z\s]+$') AS header, TRY_CAST(nullif(regexp_extract(line, '^\s*\[PAGE (\d+)\]', 1), '') AS INT) AS mark FROM l),
  s AS (SELECT *, sum(CAST(header AS INT)) OVER w AS sid, coalesce(last_value(mark IGNORE NULLS) OVER w, 1) AS page FROM h WINDOW w AS (PARTITION BY paper_doc_id ORDER BY line_no)),
  k AS (SELECT *, max(sid) OVER (PARTITION BY paper_doc_id) AS headers FROM s WHERE mark IS NULL),
  g AS (SELECT paper_doc_id, sid, coalesce(regexp_replace(max(CASE WHEN header THEN line END), '^\s+|\s+$', '', 'g'), 'Main Content') AS title,
   regexp_replace(coalesce(string_agg(CASE WHEN NOT header THEN line END, chr(10) ORDER BY line_no), ''), '^\s+|\s+$', '', 'g') AS content, min(page) AS page_start, max(page) AS last_page
   FROM k WHERE sid > 0 OR headers = 0 GROUP BY 1, 2),
  r AS (SELECT paper_doc_id, CAST(row_number() OVER w - 1 AS INT) AS section_ord, title, content, page_start, coalesce(lead(page_start) OVER w, last_page) AS page_end FROM g WINDOW w AS (PARTITION BY paper_doc_id ORDER BY sid))"""


@query(SECTIONS + " SELECT * FROM r")
def q_sections(spark, d):
    return D.sections(papers(spark, d), "paper_doc_id", "raw_text")


@query(SECTIONS + " SELECT paper_doc_id, section_ord, title FROM r WHERE NOT (lower(title) LIKE '%reference%' OR lower(title) LIKE '%bibliography%')")
def q_drop_references(spark, d):
    return D.drop_references(D.sections(papers(spark, d), "paper_doc_id", "raw_text")).select("paper_doc_id", "section_ord", "title")


@query(rf"""SELECT paper_doc_id, coalesce(list_filter(list_transform(string_split(raw_text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: length(x) > 10 AND NOT starts_with(x, '['))[1], 'Unknown') AS title FROM {P}""")
def q_title(spark, d):
    return papers(spark, d).select("paper_doc_id", D.document_title(F.col("raw_text")).alias("title"))


@query("""WITH s AS (SELECT DISTINCT paper_doc_id, section_ord, content FROM parsed_sections), m AS (SELECT paper_doc_id, list(content ORDER BY section_ord) AS pages FROM s GROUP BY 1)
  SELECT paper_doc_id, array_to_string(list_transform(pages, lambda p, i: '[PAGE ' || i || ']' || chr(10) || coalesce(p, '')), chr(10) || chr(10)) AS raw_text FROM m""")
def q_pages_to_text(spark, d):
    rows = read(spark, d, "parsed_sections", "paper_doc_id", "section_ord", "content")
    pages = F.transform(F.array_sort(F.collect_list(F.struct("section_ord", "content"))), lambda x: x.content)
    return rows.groupBy("paper_doc_id").agg(pages.alias("pages")).select("paper_doc_id", S.pages_to_text(F.col("pages")).alias("raw_text"))


TOK = r"list_filter(regexp_split_to_array({}, '\s+'), lambda x: x <> '')"
CHUNKS = f"""WITH t AS (SELECT doc_id, {TOK.format('text')} AS t FROM (SELECT DISTINCT doc_id, text FROM documents)), s AS (SELECT doc_id, t, unnest(CASE WHEN len(t) <= 200 THEN [0] ELSE range(0, len(t), 170) END) AS s FROM t WHERE len(t) > 0)
  SELECT doc_id, CAST(s // 170 AS INT) AS chunk_index, array_to_string(t[s + 1 : s + 200], ' ') AS content, CAST(least(200, len(t) - s) AS INT) AS token_count, s > 0 AS has_overlap FROM s"""


@query(CHUNKS)
def q_token_chunks(spark, d):
    return D.token_chunks(read(spark, d, "documents", "doc_id", "text"), ["doc_id"], "text", 200, 30)


@query()
def q_sentence_chunks(spark, d):
    return D.token_chunks(read(spark, d, "documents", "doc_id", "text"), ["doc_id"], "text", 200, 30, cut_sentences=True, drop_contained_tail=True)


def _cut(x: str) -> str:
    """Nested cases for the sentence boundary, an ending at a time."""
    best = f"length({x})"
    for ending in T.SENTENCE_ENDINGS:
        e = f"'{ending[0]}' || chr({ord(ending[1])})"
        at = f"(length({x}) - strpos(reverse({x}), chr({ord(ending[1])}) || '{ending[0]}') - 1)"
        best = f"(SELECT CASE WHEN contains({x}, {e}) AND {at} > 0 AND {at} < b THEN {at} + 2 ELSE b END FROM (SELECT {best} AS b))"
    return best


@query(f"SELECT doc_id, CAST({_cut('text')} AS BIGINT) AS boundary FROM (SELECT DISTINCT doc_id, text FROM documents)")
def q_sentence_boundary(spark, d):
    return read(spark, d, "documents", "doc_id", "text").select("doc_id", T.sentence_boundary(F.col("text")).cast("long").alias("boundary"))


@query(f"""WITH x AS (SELECT DISTINCT paper_doc_id, section_ord, title, content FROM parsed_sections), t AS (SELECT *, {TOK.format('content')} AS t FROM x),
  s AS (SELECT *, unnest(CASE WHEN len(t) <= 120 THEN [0] ELSE range(0, len(t), 100) END) AS s FROM t WHERE len(t) > 0),
  c AS (SELECT paper_doc_id, section_ord, title AS section_title, CAST(s // 100 AS INT) AS section_index, array_to_string(t[s + 1 : s + 120], ' ') AS content, CAST(least(120, len(t) - s) AS INT) AS token_count, s > 0 AS has_overlap FROM s),
  o AS (SELECT *, length(content) - CASE WHEN has_overlap THEN CAST(floor(length(content) * 20 / token_count) AS BIGINT) ELSE 0 END AS own FROM c)
  SELECT paper_doc_id, CAST(row_number() OVER w - 1 AS INT) AS chunk_index, section_title, section_index, content, token_count, CAST(coalesce(sum(own) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_char,
  CAST(coalesce(sum(own) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(content) AS BIGINT) AS end_char, has_overlap FROM o WINDOW w AS (PARTITION BY paper_doc_id ORDER BY section_ord, section_index)""")
def q_section_chunks(spark, d):
    parts = read(spark, d, "parsed_sections", "paper_doc_id", "section_ord", "title", "content")
    return D.section_chunks(parts, "paper_doc_id", "hybrid", 120, 20)


@query("""SELECT translation_id, CAST(count(*) AS BIGINT) AS total_chunks, CAST(coalesce(sum(token_count), 0) AS BIGINT) AS total_tokens, CAST(coalesce(floor(sum(token_count) / count(*)), 0) AS BIGINT) AS avg_tokens,
  CAST(count(DISTINCT section_title) AS BIGINT) AS n_sections, CAST(count(*) FILTER (has_overlap) AS BIGINT) AS n_overlap, CAST(coalesce(sum(len(tables)), 0) AS BIGINT) AS n_tables FROM (SELECT DISTINCT * FROM chunks) GROUP BY 1""")
def q_chunk_summary(spark, d):
    return D.chunk_summary(read(spark, d, "chunks"), ["translation_id"])


_LATER = r"lower(regexp_replace(section_title, '^\d+\.?\s*', ''))"
_KNOWN = "coalesce(" + ", ".join(f"CASE WHEN contains({_LATER}, '{a}') THEN '{b}' END" for a, b in T.SECTION_TITLES.items()) + ")"
ASSEMBLE = """WITH c AS (SELECT DISTINCT c.translation_id, c.chunk_index, section_title, t.translated_text AS text FROM (SELECT DISTINCT * FROM chunks) c JOIN (SELECT DISTINCT * FROM translated_chunks) t USING (translation_id, chunk_index)),
  g AS (SELECT translation_id, section_title, min(chunk_index) AS f, string_agg(text, chr(10) || chr(10) ORDER BY chunk_index) AS content FROM c GROUP BY 1, 2)"""


def translated(spark, d):
    return read(spark, d, "chunks", *CHUNK, "section_title").join(read(spark, d, "translated_chunks", *CHUNK, F.col("translated_text").alias("text")), CHUNK)


@query(ASSEMBLE + " SELECT translation_id, section_title, CAST(row_number() OVER (PARTITION BY translation_id ORDER BY f, section_title NULLS FIRST) - 1 AS INT) AS section_ord, content FROM g")
def q_assemble(spark, d):
    return D.assemble(translated(spark, d), "translation_id").drop("title_ko", "tables")


TITLED = f"CASE WHEN {_KNOWN} IS NULL THEN section_title ELSE regexp_extract(section_title, '^(\\d+\\.?\\s*)', 1) || {_KNOWN} END"


@query(ASSEMBLE + f""", r AS (SELECT *, row_number() OVER (PARTITION BY translation_id ORDER BY f, section_title NULLS FIRST) AS o FROM g),
  m AS (SELECT translation_id, string_agg('## ' || coalesce({TITLED}, '') || chr(10) || chr(10) || content, chr(10) || chr(10) ORDER BY o) AS markdown FROM r GROUP BY 1)
  SELECT translation_id, markdown, md5(markdown) AS md5_hash, CAST(length(markdown) AS BIGINT) AS content_length FROM m""")
def q_render(spark, d):
    return D.render(D.assemble(translated(spark, d), "translation_id"), "translation_id")


@query("SELECT DISTINCT doc_id, md5(text) AS hash FROM documents")
def q_text_hash(spark, d):
    return read(spark, d, "documents", "doc_id", "text").select("doc_id", F.md5("text").alias("hash"))


@query(r"""WITH s AS (SELECT DISTINCT arxiv_id, lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(title, '[^\p{L}\p{N}_\s-]', '', 'g'), '\s+', '-', 'g'), '-+', '-', 'g'), '^-+|-+$', '', 'g')) AS slug FROM arxiv_papers)
  SELECT arxiv_id, slug, regexp_replace(regexp_replace(regexp_replace('20250101_' || substr(slug, 1, 50) || '_' || arxiv_id, '[^\p{L}\p{N}_-]', '', 'g'), '_+', '_', 'g'), '^_+|_+$', '', 'g') AS filename FROM s""")
def q_slug_filename(spark, d):
    rows = read(spark, d, "arxiv_papers", "arxiv_id", "title")
    return rows.select("arxiv_id", T.slug(F.col("title")).alias("slug"), T.filename(F.col("title"), "20250101", F.col("arxiv_id")).alias("filename")).distinct()


@query(rf"""SELECT section_title, CASE WHEN {_KNOWN} IS NULL THEN section_title ELSE regexp_extract(section_title, '^(\d+\.?\s*)', 1) || {_KNOWN} END AS title_ko FROM (SELECT DISTINCT section_title FROM chunks)""")
def q_title_map(spark, d):
    return read(spark, d, "chunks", "section_title").select("section_title", T.section_title(F.col("section_title")).alias("title_ko"))


@query("""WITH r AS (SELECT r_regionkey, [['nation', 'key']] || list([n_name, CAST(n_nationkey AS VARCHAR)] ORDER BY n_nationkey) AS cells FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1)
  SELECT r_regionkey, '| nation | key |' || chr(10) || '|---|---|' || chr(10) || array_to_string(list_transform(cells[2:], lambda x: '| ' || x[1] || ' | ' || x[2] || ' |'), chr(10)) AS markdown FROM r""")
def q_table_markdown(spark, d):
    nation = spark.read.parquet(f"{d}/nation.parquet")
    row = F.struct("n_nationkey", F.array("n_name", F.col("n_nationkey").cast("string")).alias("cells"))
    rows = nation.groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.transform(F.array_sort(F.collect_list(row)), lambda x: x.cells).alias("cells"))
    cells = F.concat(F.array(F.array(F.lit("nation"), F.lit("key"))), F.col("cells"))
    return rows.select("r_regionkey", T.markdown_table(cells).alias("markdown"))


# Validation


V = """(SELECT DISTINCT validation_id, v.source_text, expected_target, content, translated_text FROM (SELECT DISTINCT * FROM term_validations) v
  JOIN (SELECT DISTINCT translation_id, chunk_index, content FROM chunks) c USING (translation_id, chunk_index) JOIN (SELECT DISTINCT translation_id, chunk_index, translated_text FROM translated_chunks) t USING (translation_id, chunk_index))"""


def checks(spark, d):
    rows = read(spark, d, "term_validations", "validation_id", *CHUNK, "source_text", "expected_target")
    return rows.join(chunk_texts(spark, d), CHUNK).join(read(spark, d, "translated_chunks", *CHUNK, "translated_text"), CHUNK)


@query(f"""SELECT validation_id, CASE WHEN NOT contains(lower(content), lower(source_text)) OR contains(lower(translated_text), lower(expected_target)) THEN 'matched' ELSE 'missing' END AS found_status,
  CAST(CASE WHEN NOT contains(lower(content), lower(source_text)) THEN -1 ELSE strpos(lower(translated_text), lower(expected_target)) - 1 END AS BIGINT) AS found_position FROM {V}""")
def q_validate_exact(spark, d):
    found = M.validate(checks(spark, d), "source_text", "expected_target", "content", "translated_text", fuzzy=False)
    return found.select("validation_id", "found_status", "found_position")


@query()
def q_validate_fuzzy(spark, d):
    """With similar words (from 0.8) and mismatched ones (from 0.7); tested against a plain loop."""
    found = M.validate(checks(spark, d), "source_text", "expected_target", "content", "translated_text", 0.8, 0.7)
    return found.select("validation_id", "found_status", "found_text", F.round("found_similarity", 6).alias("found_similarity"), "found_position")


@query("""SELECT translation_id, CAST(count(*) AS BIGINT) AS n_checks, CAST(count(*) FILTER (status = 'matched') AS BIGINT) AS n_matched, CAST(count(*) FILTER (status = 'similar') AS BIGINT) AS n_similar,
  CAST(count(*) FILTER (status = 'mismatched') AS BIGINT) AS n_mismatched, CAST(count(*) FILTER (status = 'missing') AS BIGINT) AS n_missing, round(count(*) FILTER (status IN ('matched', 'similar')) * 100.0 / count(*), 2) AS match_rate FROM (SELECT DISTINCT validation_id, translation_id, status FROM term_validations) GROUP BY 1""")
def q_match_rate(spark, d):
    return M.status_summary(read(spark, d, "term_validations", "validation_id", "translation_id", "status"), ["translation_id"])


@query("SELECT DISTINCT validation_id, translation_id, source_text FROM term_validations WHERE status = 'missing'")
def q_missing_terms(spark, d):
    return read(spark, d, "term_validations", "validation_id", "translation_id", "source_text", "status").where("status = 'missing'").drop("status")


@query()
def q_similarity(spark, d):
    """Similarity of old and new targets."""
    rows = read(spark, d, "term_changes", "id", "old_target_text", "new_target_text")
    return rows.select("id", F.round(similarity("old_target_text", "new_target_text"), 6).alias("score"))


@query()
def q_fuzzy_best(spark, d):
    rows = checks(spark, d).withColumn("b", best_word("translated_text", "expected_target", F.lit(0.6)))
    return rows.select("validation_id", "b.word", F.round("b.score", 6).alias("score"), "b.position")


@query("""SELECT DISTINCT id, CASE WHEN strpos(source_text, ' ') > 0 THEN substr(source_text, 1, strpos(source_text, ' ') - 1) || '_' || substr(source_text, strpos(source_text, ' ') + 1) ELSE source_text END AS corrected FROM term_changes""")
def q_replace_first(spark, d):
    return read(spark, d, "term_changes", "id", "source_text").select("id", T.replace_first(F.col("source_text"), F.lit(" "), F.lit("_")).alias("corrected")).distinct()


@query(f"""SELECT validation_id, CASE WHEN strpos(translated_text, expected_target) > 0 THEN substr(translated_text, 1, strpos(translated_text, expected_target) - 1) || '[' || expected_target || ']' || substr(translated_text, strpos(translated_text, expected_target) + length(expected_target)) ELSE translated_text END AS corrected FROM {V}""")
def q_correct_terms(spark, d):
    change = F.array(F.struct(F.col("expected_target").alias("old"), F.concat(F.lit("["), F.col("expected_target"), F.lit("]")).alias("new")))
    return checks(spark, d).select("validation_id", M.correct(F.col("translated_text"), change).alias("corrected"))


@query("""WITH v AS (SELECT DISTINCT translation_id, chunk_index, validation_id, source_text, expected_target FROM term_validations),
  g AS (SELECT translation_id, source_text, min({'c': chunk_index, 'v': validation_id}) AS a, arg_min(expected_target, {'c': chunk_index, 'v': validation_id}) AS target_text FROM v GROUP BY 1, 2)
  SELECT translation_id, source_text, target_text, CAST(row_number() OVER (PARTITION BY translation_id ORDER BY a, source_text) - 1 AS INT) AS ord FROM g""")
def q_terms_used(spark, d):
    rows = read(spark, d, "term_validations", *CHUNK, "validation_id", "source_text", F.col("expected_target").alias("target_text"))
    return M.terms_used(rows, "translation_id", ["chunk_index", "validation_id"])


# Enrichment


@query("""SELECT source_name, CAST(count(*) AS BIGINT) AS n_rows, CAST(count(*) FILTER (status = 'completed') AS BIGINT) AS n_completed, CAST(count(*) FILTER (status = 'failed') AS BIGINT) AS n_failed, CAST(coalesce(sum(input_tokens), 0) AS BIGINT) AS input_tokens,
  CAST(coalesce(sum(output_tokens), 0) AS BIGINT) AS output_tokens, round(count(*) FILTER (status = 'completed') * 100.0 / count(*), 2) AS success_rate, round(sum(CAST(round(translation_time * 1000000) AS BIGINT)) FILTER (status = 'completed') / nullif(count(translation_time) FILTER (status = 'completed'), 0) / 1000000, 4) AS avg_seconds FROM (SELECT DISTINCT * FROM translated_chunks) GROUP BY 1""")
def q_call_summary(spark, d):
    return E.call_summary(read(spark, d, "translated_chunks", *CHUNK, "source_name", "status", "input_tokens", "output_tokens", "translation_time", "translated_at", "ingested_at", "retry_count"), ["source_name"])


@query("""WITH t AS (SELECT DISTINCT translation_id, chunk_index, status FROM translated_chunks), f AS (SELECT *, min(CASE WHEN status = 'failed' THEN chunk_index END) OVER (PARTITION BY translation_id) AS f FROM t)
  SELECT translation_id, chunk_index, status FROM f WHERE f IS NULL OR chunk_index <= f""")
def q_stop_on_error(spark, d):
    return E.until_first_failure(read(spark, d, "translated_chunks", *CHUNK, "status"), "translation_id", "chunk_index")


def _reverse(text: str) -> str:
    if not text.isascii():
        raise ValueError("not plain")
    return text[::-1]


@query(r"""SELECT id, CASE WHEN regexp_full_match(source_text, '[\x00-\x7F]*') THEN reverse(source_text) END AS output, CASE WHEN regexp_full_match(source_text, '[\x00-\x7F]*') THEN 'completed' ELSE 'failed' END AS status,
  CASE WHEN regexp_full_match(source_text, '[\x00-\x7F]*') THEN NULL ELSE 'not plain' END AS error_message FROM (SELECT DISTINCT id, source_text FROM term_changes)""")
def q_enrich_stub(spark, d):
    done = E.enrich(read(spark, d, "term_changes", "id", "source_text"), ["id"], ["source_text"], _reverse)
    return done.select("id", "output", "status", "error_message")


# Feedback


@query("SELECT DISTINCT id FROM term_changes WHERE old_target_text <> new_target_text")
def q_changed_hash(spark, d):
    return read(spark, d, "term_changes", "id", "old_target_text", "new_target_text").where(B.differs("old_target_text", "new_target_text")).select("id")


FILES = "f AS (SELECT DISTINCT source_path AS path, md5(raw_text) AS hash FROM parsed_papers), k AS (SELECT DISTINCT source_path AS path, CASE WHEN total_pages IS NOT NULL THEN md5(raw_text || CASE WHEN total_pages > 3 THEN 'x' ELSE '' END) END AS hash FROM parsed_papers WHERE title <> 'Unknown')"


@query(f"WITH {FILES} SELECT f.path, f.hash, k.path IS NULL AS is_new FROM f LEFT JOIN k ON f.path = k.path WHERE k.path IS NULL OR (k.hash IS NOT NULL AND k.hash <> f.hash)")
def q_changed_files(spark, d):
    rows = read(spark, d, "parsed_papers", "source_path", "raw_text", "title", "total_pages")
    files = rows.select(F.col("source_path").alias("path"), F.md5("raw_text").alias("hash")).distinct()
    stored = F.when(F.col("total_pages").isNotNull(), F.md5(F.concat("raw_text", F.when(F.col("total_pages") > 3, "x").otherwise(""))))
    known = rows.where("title <> 'Unknown'").select(F.col("source_path").alias("path"), stored.alias("hash")).distinct()
    return B.changed_files(files, known)


EDIT = "replace(replace(text, 'tidal', 'solar'), '조석', '태양')"


def edited(spark, d):
    rows = read(spark, d, "documents", "doc_id", "text")
    new = F.replace(F.replace("text", F.lit("tidal"), F.lit("solar")), F.lit("조석"), F.lit("태양"))
    return rows.withColumn("edited", new)


@query(f"""WITH e AS (SELECT DISTINCT doc_id, text, {EDIT} AS edited FROM documents), l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, -1 AS n FROM e UNION ALL SELECT doc_id, unnest(string_split(edited, chr(10))), 1 FROM e),
  g AS (SELECT doc_id, line, sum(n) AS n FROM l GROUP BY 1, 2 HAVING sum(n) <> 0) SELECT doc_id, line, CAST(greatest(-n, 0) AS BIGINT) AS n_removed, CAST(greatest(n, 0) AS BIGINT) AS n_added FROM g""")
def q_line_multiset(spark, d):
    return B.line_multiset_changes(edited(spark, d), "doc_id", "text", "edited")


@query()
def q_line_changes(spark, d):
    return B.line_changes(edited(spark, d), "doc_id", "text", "edited")


@query()
def q_merge_changes(spark, d):
    return B.merge_changes(B.line_changes(edited(spark, d), "doc_id", "text", "edited"), "doc_id")


def inferred(spark, d):
    found = B.inferred_terms(q_merge_changes(spark, d), read(spark, d, "terminology"))
    return found.select(F.concat_ws("-", F.col("doc_id").cast("string"), F.col("seq").cast("string"), "source_text").alias("key"), "source_text", "new_target", "confidence").distinct()


@query()
def q_inferred_terms(spark, d):
    return inferred(spark, d)


PLAN = """WITH c AS (SELECT DISTINCT id AS key, source_text, new_target_text AS new_target, CASE change_type WHEN 'add' THEN 0.9 WHEN 'update' THEN 0.8 ELSE 0.3 END AS confidence FROM term_changes WHERE new_target_text IS NOT NULL),
  t AS (SELECT id AS term_id, lower(source_text) AS s, lower(target_text) AS t FROM terminology),
  j AS (SELECT c.*, term_id, row_number() OVER (PARTITION BY key ORDER BY CASE WHEN s = lower(source_text) THEN 0 ELSE 1 END, length(s), s, term_id) AS n FROM c LEFT JOIN t ON contains(s, lower(source_text)) OR contains(t, lower(source_text))),
  a AS (SELECT *, CASE WHEN confidence < 0.7 THEN 'skip' WHEN term_id IS NULL THEN 'add_term' ELSE 'update_term' END AS main FROM j WHERE n = 1),
  p AS (SELECT key, source_text, new_target, term_id, unnest(CASE WHEN main = 'skip' THEN [main] ELSE [main, 'log_change'] END) AS action FROM a)"""


def plan(spark, d):
    rows = read(spark, d, "term_changes", "id", "source_text", "new_target_text", "change_type").where("new_target_text is not null")
    sure = F.when(F.col("change_type") == "add", 0.9).when(F.col("change_type") == "update", 0.8).otherwise(0.3)
    changes = rows.select(F.col("id").alias("key"), "source_text", F.col("new_target_text").alias("new_target"), sure.alias("confidence"))
    return B.sync_plan(changes, read(spark, d, "terminology"), "key")


@query(PLAN + " SELECT key, action, term_id FROM p")
def q_sync_plan(spark, d):
    return plan(spark, d).select("key", "action", "term_id")


@query(PLAN + """ SELECT * FROM (SELECT action, CAST(count(*) OVER (PARTITION BY action) AS BIGINT) AS n_items, CAST(row_number() OVER (PARTITION BY action ORDER BY source_text, new_target) AS INT) AS place, source_text, new_target FROM p) WHERE place <= 5""")
def q_plan_preview(spark, d):
    return B.plan_preview(plan(spark, d))


@query(PLAN + """, l AS (SELECT term_id, max(new_target) AS t FROM p WHERE action = 'update_term' GROUP BY 1), n AS (SELECT source_text, max(new_target) AS target_text FROM p WHERE action = 'add_term' GROUP BY 1)
  SELECT id, source_text, coalesce(l.t, target_text) AS target_text, domain FROM terminology LEFT JOIN l ON l.term_id = id UNION ALL SELECT md5(source_text || chr(1) || 'General'), source_text, target_text, 'General' FROM n""")
def q_apply_plan(spark, d):
    return B.apply_plan(read(spark, d, "terminology"), plan(spark, d)).select("id", "source_text", "target_text", "domain")


# Messages and papers


@query(r"""SELECT DISTINCT paper_doc_id, CASE WHEN source_path LIKE 'http%' THEN 'url' WHEN regexp_matches(source_path, '^\d+\.\d+(v\d+)?$') THEN 'arxiv_id' ELSE 'file' END AS source_type FROM parsed_papers""")
def q_source_type(spark, d):
    return read(spark, d, "parsed_papers", "paper_doc_id", "source_path").select("paper_doc_id", T.fetch_kind(F.col("source_path")).alias("source_type")).distinct()


@query(r"""SELECT DISTINCT paper_id, CASE WHEN regexp_matches(arxiv_id, '^\d+\.\d+(v\d+)?$') THEN arxiv_id END AS clean_id FROM semantic_scholar_papers WHERE arxiv_id IS NOT NULL""")
def q_arxiv_id(spark, d):
    return read(spark, d, "semantic_scholar_papers", "paper_id", "arxiv_id").where("arxiv_id is not null").select("paper_id", T.arxiv_id(F.col("arxiv_id")).alias("clean_id")).distinct()


@query("""WITH m AS (SELECT DISTINCT user_id, event_id, ts, event_type FROM events) SELECT user_id, arg_max(event_type, {'t': ts, 'e': event_id}) AS last_type, CAST(count(*) AS BIGINT) AS n FROM m GROUP BY 1""")
def q_last_message(spark, d):
    rows = read(spark, d, "events", "user_id", "event_id", "ts", "event_type")
    return rows.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("last_type"), F.count("*").alias("n"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def q_json_props(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", F.from_json("props", "k long").k.alias("k"))


@query("""SELECT DISTINCT id, source_text, new_target_text AS new_target, CAST(0.5 AS DOUBLE) AS confidence FROM term_changes WHERE new_target_text IS NOT NULL""")
def q_json_array(spark, d):
    """Items out of a reply that holds a JSON array among other words; a missing confidence is 0.5."""
    rows = read(spark, d, "term_changes", "id", "source_text", "new_target_text").where("new_target_text is not null")
    item = F.struct("source_text", F.col("new_target_text").alias("new_target"))
    reply = F.concat(F.lit("Result: "), F.to_json(F.array(item)), F.lit(" done."))
    parsed = F.from_json(F.regexp_extract(reply, r"(?s)(\[.*\])", 1), "array<struct<source_text:string,new_target:string,confidence:double>>")
    return rows.select("id", F.explode(parsed).alias("x")).select("id", "x.source_text", "x.new_target", F.coalesce("x.confidence", F.lit(0.5)).alias("confidence"))


@query("""SELECT DISTINCT paper_id, title, citation_count FROM (SELECT DISTINCT paper_id, title, citation_count FROM semantic_scholar_papers WHERE citation_count >= 10 AND year BETWEEN 2018 AND 2024
  AND regexp_matches(lower(concat_ws(' ', title, abstract)), 'parsing|retrieval')) ORDER BY citation_count DESC, paper_id LIMIT 50""")
def q_top_cited(spark, d):
    rows = PAPERS.search_papers(read(spark, d, "semantic_scholar_papers"), ["Parsing", "retrieval"], None, 2018, 2024, 10)
    return rows.select("paper_id", "title", "citation_count").distinct().orderBy(F.desc("citation_count"), "paper_id").limit(50)


@query("""SELECT DISTINCT arxiv_id, published FROM arxiv_papers WHERE list_has_any(categories, ['cs.CL', 'cs.AI']) ORDER BY published DESC, arxiv_id LIMIT 100""")
def q_recent_papers(spark, d):
    rows = PAPERS.search_papers(read(spark, d, "arxiv_papers"), [], ["cs.CL", "cs.AI"])
    return rows.select("arxiv_id", "published").distinct().orderBy(F.desc("published"), "arxiv_id").limit(100)


@query("""SELECT arxiv_id, CASE WHEN len(authors) > 2 THEN array_to_string(authors[1:2], ', ') || ' +' || (len(authors) - 2) ELSE array_to_string(authors, ', ') END AS author_line FROM (SELECT DISTINCT arxiv_id, authors FROM arxiv_papers)""")
def q_author_line(spark, d):
    return read(spark, d, "arxiv_papers", "arxiv_id", "authors").select("arxiv_id", T.author_line(F.col("authors")).alias("author_line"))

"""Queries of the stored tables and the paper searches, with their SQL.

There is no table of translations among the test tables: it is taken from the papers, the history from the translated chunks.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import feedback as B
from docloom.plans.queries import CHUNK, PLAN, UPSERT, plan, query, read
from docloom.sources import io as S
from docloom.sources import papers as P
from docloom.sources import store as R

TRANSLATIONS = """(SELECT DISTINCT CAST(paper_doc_id AS VARCHAR) AS id, title AS paper_title, arxiv_id, source_path AS output_path, md5(raw_text) AS original_md_hash, md5(title) AS current_md_hash,
  total_pages AS total_chunks, CASE WHEN total_pages IS NULL THEN 'failed' ELSE 'completed' END AS status, CAST(NULL AS VARCHAR) AS error_message, parsed_at AS created_at, parsed_at AS updated_at FROM parsed_papers)"""


def now():
    """The time that these queries write: a fixed one."""
    return F.lit("2025-01-01 00:00:00").cast("timestamp_ntz")


def translations(spark, d):
    rows = read(spark, d, "parsed_papers")
    return rows.select(
        F.col("paper_doc_id").cast("string").alias("id"), F.col("title").alias("paper_title"), "arxiv_id", F.col("source_path").alias("output_path"), F.md5("raw_text").alias("original_md_hash"),
        F.md5("title").alias("current_md_hash"), F.col("total_pages").alias("total_chunks"), F.when(F.col("total_pages").isNull(), "failed").otherwise("completed").alias("status"),
        F.lit(None).cast("string").alias("error_message"), F.col("parsed_at").alias("created_at"), F.col("parsed_at").alias("updated_at"),
    ).distinct()


# Look-ups


@query(f"SELECT id, paper_title, status FROM {TRANSLATIONS} WHERE id = (SELECT CAST(min(paper_doc_id) AS VARCHAR) FROM parsed_papers)")
def q_translation_by_id(spark, d):
    asked = str(spark.read.parquet(f"{d}/parsed_papers.parquet").agg(F.min("paper_doc_id")).first()[0])
    return R.one(translations(spark, d), ["id"], id=asked).select("id", "paper_title", "status")


@query(f"SELECT id, arxiv_id FROM {TRANSLATIONS} WHERE arxiv_id = (SELECT max(arxiv_id) FROM parsed_papers) ORDER BY id LIMIT 1")
def q_translation_by_arxiv_id(spark, d):
    asked = spark.read.parquet(f"{d}/parsed_papers.parquet").agg(F.max("arxiv_id")).first()[0]
    return R.one(translations(spark, d), ["id"], arxiv_id=asked).select("id", "arxiv_id")


@query(f"SELECT id, status FROM {TRANSLATIONS} WHERE status = 'completed' ORDER BY created_at DESC NULLS LAST, id LIMIT 50")
def q_newest_translations(spark, d):
    return R.newest(translations(spark, d), 50, "completed").select("id", "status")


@query(f"SELECT id, output_path FROM {TRANSLATIONS} WHERE contains(lower(output_path), 'a1')")
def q_translations_by_path(spark, d):
    return R.by_output_path(translations(spark, d), "A1").select("id", "output_path")


LARGEST = "(SELECT translation_id FROM translated_chunks GROUP BY 1 ORDER BY count(*) DESC, translation_id LIMIT 1)"


def largest(spark, d):
    return spark.read.parquet(f"{d}/translated_chunks.parquet").groupBy("translation_id").count().orderBy(F.desc("count"), "translation_id").first()[0]


@query(f"SELECT DISTINCT chunk_index, status FROM translated_chunks WHERE translation_id = {LARGEST}")
def q_history_of_translation(spark, d):
    rows = read(spark, d, "translated_chunks", *CHUNK, "status")
    return R.by_value(rows, translation_id=largest(spark, d)).orderBy("chunk_index").select("chunk_index", "status")


@query(f"SELECT DISTINCT chunk_index, translated_text FROM translated_chunks WHERE translation_id = {LARGEST} AND chunk_index = 3")
def q_history_chunk(spark, d):
    rows = read(spark, d, "translated_chunks", *CHUNK, "translated_text")
    return R.by_value(rows, translation_id=largest(spark, d), chunk_index=3).select("chunk_index", "translated_text")


@query("SELECT id, source_text FROM terminology WHERE (contains(lower(source_text), 'tidal') OR contains(lower(target_text), 'tidal')) AND domain = 'NLP' ORDER BY source_text, id LIMIT 50")
def q_search_terms_limited(spark, d):
    return R.search_terms(read(spark, d, "terminology"), "Tidal", "NLP").select("id", "source_text")


@query("SELECT id, target_text FROM terminology WHERE id = (SELECT min(id) FROM terminology)")
def q_term_by_id(spark, d):
    terms = read(spark, d, "terminology")
    return R.one(terms, ["id"], id=terms.agg(F.min("id")).first()[0]).select("id", "target_text")


@query("SELECT id, terminology_id FROM (SELECT DISTINCT id, terminology_id, created_at FROM term_changes) WHERE terminology_id = (SELECT max(terminology_id) FROM term_changes)")
def q_changes_of_term(spark, d):
    rows = read(spark, d, "term_changes", "id", "terminology_id", "created_at")
    return R.newest(R.by_value(rows, terminology_id=rows.agg(F.max("terminology_id")).first()[0]), 1_000_000).select("id", "terminology_id")


# Appended rows


@query(f"SELECT md5(coalesce(paper_title, '') || chr(1) || coalesce(output_path, '')) AS id, paper_title, arxiv_id, 'in_progress' AS status, total_chunks FROM {TRANSLATIONS}")
def q_new_translations(spark, d):
    rows = translations(spark, d).select("paper_title", "output_path", "arxiv_id", "total_chunks")
    return R.new_translations(rows, now()).select("id", "paper_title", "arxiv_id", "status", "total_chunks")


@query("""SELECT DISTINCT md5(translation_id || chr(1) || chunk_index) AS id, translation_id, chunk_index, translated_text, total_tokens AS tokens_used FROM translated_chunks""")
def q_new_history(spark, d):
    rows = read(spark, d, "translated_chunks", *CHUNK, "translated_text", F.col("total_tokens").alias("tokens_used"))
    return R.new_history(rows, now()).select("id", *CHUNK, "translated_text", "tokens_used")


@query("""SELECT DISTINCT translation_id, terminology_id, coalesce(change_type, 'update') AS change_type, old_target_text, new_target_text, source_text, coalesce(detected_from, 'user_feedback') AS detected_from FROM term_changes""")
def q_log_changes(spark, d):
    rows = read(spark, d, "term_changes", "translation_id", "terminology_id", "change_type", F.col("old_target_text").alias("old_target"), F.col("new_target_text").alias("new_target"), "source_text", F.col("detected_from").alias("change_reason"))
    return R.new_changes(rows, now()).drop("id", "created_at")


@query("""WITH t AS (SELECT id AS terminology_id, source_text, target_text FROM terminology) SELECT terminology_id, 'add' AS change_type, source_text, CAST(NULL AS VARCHAR) AS old_target_text, target_text AS new_target_text FROM t
  UNION ALL SELECT terminology_id, 'update', source_text, target_text, upper(target_text) FROM t UNION ALL SELECT terminology_id, 'delete', source_text, target_text, NULL FROM t""")
def q_log_typed(spark, d):
    """Log rows of terms that are added, changed and deleted."""
    t = read(spark, d, "terminology").select(F.col("id").alias("terminology_id"), "source_text", "target_text")
    add = R.new_changes(t.withColumn("new_target", F.col("target_text")), now(), "add")
    update = R.new_changes(t.select("terminology_id", "source_text", F.col("target_text").alias("old_target"), F.upper("target_text").alias("new_target")), now(), "update")
    gone = R.new_changes(t.withColumn("old_target", F.col("target_text")), now(), "delete")
    return add.unionByName(update).unionByName(gone).select("terminology_id", "change_type", "source_text", "old_target_text", "new_target_text")


@query("""SELECT DISTINCT md5(source_text || chr(1) || 'General') AS id, source_text, new_target_text AS target_text, 'word' AS mapping_type, 'General' AS domain, CAST(1.0 AS DOUBLE) AS confidence, true AS is_user_defined, CAST(0 AS INT) AS usage_count
  FROM term_changes WHERE new_target_text IS NOT NULL AND source_text IS NOT NULL""")
def q_new_terms(spark, d):
    rows = read(spark, d, "term_changes", "source_text", F.col("new_target_text").alias("target_text")).where("target_text is not null and source_text is not null")
    return R.new_terms(rows, now()).drop("created_at", "updated_at")


# Changed rows


@query(f"""SELECT id, CASE WHEN status = 'failed' THEN 'completed' ELSE 'failed' END AS status, CASE WHEN status = 'failed' THEN error_message ELSE 'lost' END AS error_message, true AS touched FROM {TRANSLATIONS}""")
def q_set_status(spark, d):
    rows = translations(spark, d)
    failed = F.col("status") == "failed"
    changes = rows.select("id", F.when(failed, "completed").otherwise("failed").alias("status"), F.when(failed, "").otherwise("lost").alias("error_message"))
    return R.set_status(rows, changes, now()).select("id", "status", "error_message", (F.col("updated_at") == now()).alias("touched"))


@query(f"""SELECT id, md5(paper_title || 'x') AS original_md_hash, CASE WHEN status = 'failed' THEN md5(paper_title || 'x') ELSE md5(paper_title || 'y') END AS current_md_hash FROM {TRANSLATIONS}""")
def q_set_hashes(spark, d):
    rows = translations(spark, d)
    current = F.when(F.col("status") == "failed", "").otherwise(F.md5(F.concat("paper_title", F.lit("y"))))
    changes = rows.select("id", F.md5(F.concat("paper_title", F.lit("x"))).alias("original"), current.alias("current"))
    return R.set_hashes(rows, changes, now()).select("id", "original_md_hash", "current_md_hash")


@query(f"""SELECT id, original_md_hash, CASE WHEN status = 'failed' THEN original_md_hash ELSE current_md_hash END AS current_md_hash, status = 'failed' OR updated_at = TIMESTAMP '2025-01-01' AS touched FROM {TRANSLATIONS}""")
def q_set_current_hash(spark, d):
    rows = translations(spark, d)
    changes = rows.where("status = 'failed'").select("id", F.col("original_md_hash").alias("current_md_hash"))
    return R.set_current_hash(rows, changes, now()).select("id", "original_md_hash", "current_md_hash", (F.col("updated_at") == now()).alias("touched"))


@query("""SELECT DISTINCT translation_id || '/' || chunk_index AS id, CASE WHEN status = 'failed' THEN '(none)' ELSE translated_text END AS translated_text FROM translated_chunks""")
def q_set_text(spark, d):
    key = F.concat_ws("/", "translation_id", F.col("chunk_index").cast("string")).alias("id")
    rows = read(spark, d, "translated_chunks", *CHUNK, "translated_text", "status").select(key, "translated_text", "status")
    changes = rows.where("status = 'failed'").select("id", F.lit("(none)").alias("translated_text"))
    return R.set_text(rows, changes).select("id", "translated_text")


@query("""WITH u AS (SELECT terminology_id AS id, max(new_target_text) AS target_text FROM term_changes WHERE change_type = 'update' AND terminology_id IS NOT NULL GROUP BY 1)
  SELECT t.id, coalesce(u.target_text, t.target_text) AS target_text, u.id IS NOT NULL AS touched FROM terminology t LEFT JOIN u USING (id)""")
def q_update_terms(spark, d):
    changes = read(spark, d, "term_changes", "id", "change_type", "terminology_id", "new_target_text").where("change_type = 'update' and terminology_id is not null")
    changes = changes.groupBy(F.col("terminology_id").alias("id")).agg(F.max("new_target_text").alias("target_text"))
    return R.update_terms(read(spark, d, "terminology"), changes, now()).select("id", "target_text", (F.col("updated_at") == now()).alias("touched"))


@query(UPSERT + """ SELECT CAST(count(*) FILTER (t.id IS NULL) AS BIGINT) AS added, CAST(count(*) FILTER (t.id IS NOT NULL) AS BIGINT) AS updated, CAST(0 AS BIGINT) AS errors FROM n LEFT JOIN terminology t ON n.source_text = t.source_text AND n.domain = t.domain""")
def q_upsert_counts(spark, d):
    new = read(spark, d, "term_changes", "id", "source_text", "change_type", "new_target_text").where("change_type <> 'delete' and new_target_text is not null").groupBy("source_text").agg(F.max("new_target_text").alias("target_text"))
    return R.upsert_counts(read(spark, d, "terminology"), new.withColumn("domain", F.lit("General")), ["source_text", "domain"])


@query("SELECT DISTINCT id, terminology_id FROM term_changes WHERE terminology_id IS NOT NULL AND terminology_id NOT IN (SELECT id FROM terminology)")
def q_broken_references(spark, d):
    return R.broken_references(read(spark, d, "term_changes", "id", "terminology_id"), "terminology_id", read(spark, d, "terminology"))


@query("SELECT translation_id, chunk_index, CAST(count(*) AS BIGINT) AS n FROM chunks GROUP BY 1, 2 HAVING count(*) > 1")
def q_repeated_keys(spark, d):
    return R.repeated_keys(spark.read.parquet(f"{d}/chunks.parquet"), CHUNK)


# Synchronised files


STEM = r"lower(regexp_replace(regexp_extract({}, '([^/]*)$', 1), '\.[^.]*$', ''))"
FILES_SQL = f"(SELECT DISTINCT '/out/' || regexp_extract(source_path, '([^/]*)$', 1) AS path, md5(raw_text || 'x') AS hash FROM parsed_papers)"


def files(spark, d):
    rows = read(spark, d, "parsed_papers", "source_path", "raw_text")
    return rows.select(F.concat(F.lit("/out/"), T.last_part(F.col("source_path"))).alias("path"), F.md5(F.concat("raw_text", F.lit("x"))).alias("hash")).distinct()


KNOWN_FILES = f"""WITH f AS {FILES_SQL}, k AS (SELECT {STEM.format('output_path')} AS stem, min({{'i': id, 'h': current_md_hash}}) AS k FROM {TRANSLATIONS} GROUP BY 1 HAVING stem <> ''),
  j AS (SELECT path, hash, k.k.i AS translation_id, k.k.h AS stored_hash FROM f LEFT JOIN k ON k.stem = {STEM.format('path')})"""


@query(KNOWN_FILES + " SELECT * FROM j")
def q_known_files(spark, d):
    return B.known_by_stem(files(spark, d), translations(spark, d))


def hash_items(spark, d):
    return B.hash_items(B.known_by_stem(files(spark, d), translations(spark, d)).select("translation_id", F.col("stored_hash").alias("old_hash"), F.col("hash").alias("new_hash")))


@query(KNOWN_FILES + " SELECT translation_id, 'update_hash' AS action, stored_hash AS old_hash, hash AS new_hash FROM j WHERE translation_id IS NOT NULL AND (stored_hash IS NULL OR stored_hash <> hash)")
def q_hash_items(spark, d):
    return hash_items(spark, d)


@query(KNOWN_FILES + f", n AS (SELECT translation_id, max(hash) AS h FROM j WHERE translation_id IS NOT NULL AND (stored_hash IS NULL OR stored_hash <> hash) GROUP BY 1) SELECT t.id, coalesce(n.h, t.current_md_hash) AS current_md_hash FROM {TRANSLATIONS} t LEFT JOIN n ON n.translation_id = t.id")
def q_update_hashes(spark, d):
    return B.update_hashes(translations(spark, d), hash_items(spark, d)).select("id", "current_md_hash")


@query(PLAN + """ SELECT term_id AS terminology_id, CASE action WHEN 'add_term' THEN 'add' ELSE 'update' END AS change_type, source_text, new_target AS new_target_text, 'user_feedback' AS detected_from FROM p WHERE action IN ('update_term', 'add_term')""")
def q_change_log(spark, d):
    return B.change_log(plan(spark, d), now()).drop("id", "created_at")


# Papers

SCHOLAR = "(SELECT DISTINCT paper_id, title, influential_citation_count, year, abstract FROM semantic_scholar_papers)"


@query(f"""SELECT paper_id, influential_citation_count FROM {SCHOLAR} WHERE year >= 2020 AND regexp_matches(lower(concat_ws(' ', title, abstract)), 'tuned|parsing') ORDER BY influential_citation_count DESC, paper_id LIMIT 30""")
def q_influential(spark, d):
    rows = read(spark, d, "semantic_scholar_papers", "paper_id", "title", "influential_citation_count", "year", "abstract", "citation_count")
    return P.most_cited(rows, ["tuned", "parsing"], 30, "influential_citation_count", 2020).select("paper_id", "influential_citation_count")


A = "(SELECT DISTINCT arxiv_id, title, abstract, categories, published, updated FROM arxiv_papers)"


def archive(spark, d):
    return read(spark, d, "arxiv_papers", "arxiv_id", "title", "abstract", "categories", "published", "updated")


@query(f"SELECT arxiv_id, updated FROM {A} ORDER BY updated, arxiv_id LIMIT 40")
def q_sorted_papers(spark, d):
    return P.ordered(archive(spark, d), "lastUpdatedDate", False, "arxiv_id", 40).select("arxiv_id", "updated")


@query(f"SELECT arxiv_id, published FROM {A} WHERE list_has_any(categories, ['cs.CL', 'cs.AI']) AND published >= TIMESTAMP '2025-01-01' - INTERVAL 200 DAY ORDER BY published DESC, arxiv_id LIMIT 60")
def q_recent_days(spark, d):
    return P.recent(archive(spark, d), "NLP", now(), 200, 60).select("arxiv_id", "published")


@query(f"SELECT arxiv_id, published FROM {A} WHERE list_has_any(categories, ['cs.CV', 'cs.AI']) AND regexp_matches(lower(concat_ws(' ', title, abstract)), 'diffusion|vision transformer|vit|image generation') ORDER BY published DESC, arxiv_id LIMIT 60")
def q_trending(spark, d):
    return P.trending(archive(spark, d), "CV", 60).select("arxiv_id", "published")


@query("SELECT DISTINCT paper_id, arxiv_id FROM semantic_scholar_papers WHERE arxiv_id = (SELECT min(arxiv_id) FROM semantic_scholar_papers) ORDER BY paper_id LIMIT 1")
def q_paper_lookup(spark, d):
    rows = read(spark, d, "semantic_scholar_papers", "paper_id", "arxiv_id")
    return P.paper_by_id(rows.orderBy("paper_id"), "arxiv_id", rows.agg(F.min("arxiv_id")).first()[0]).select("paper_id", "arxiv_id")


def replies(spark, d):
    rows = read(spark, d, "semantic_scholar_papers", "paper_id", "title", "authors", "citation_count", "arxiv_id", "fields_of_study")
    fields = F.struct(F.col("paper_id").alias("paperId"), "title", F.col("citation_count").alias("citationCount"), F.transform("authors", lambda a: F.struct(a.alias("name"))).alias("authors"), F.struct(F.col("arxiv_id").alias("ArXiv")).alias("externalIds"), F.col("fields_of_study").alias("fieldsOfStudy"))
    return rows.select("paper_id", fields.alias("fields"))


@query("SELECT DISTINCT paper_id, title, authors, coalesce(citation_count, 0) AS citation_count, CAST(0 AS INT) AS influential_citation_count, arxiv_id, coalesce(fields_of_study, []) AS fields_of_study FROM (SELECT * REPLACE (coalesce(authors, []) AS authors, coalesce(title, '') AS title) FROM semantic_scholar_papers)")
def q_service_rows(spark, d):
    """Nested JSON replies of a search service as typed rows."""
    made = P.service_rows(replies(spark, d).select(F.to_json("fields").alias("reply")), "reply")
    return made.select("paper_id", "title", "authors", "citation_count", "influential_citation_count", "arxiv_id", "fields_of_study")


@query("SELECT DISTINCT paper_id, coalesce(title, '') AS title FROM semantic_scholar_papers")
def q_citing_rows(spark, d):
    """A reply that lists citing papers, one of its entries empty."""
    entry = lambda c: F.struct(c.alias("citingPaper"))
    rows = replies(spark, d).select(F.to_json(F.struct(F.array(entry(F.col("fields")), entry(F.lit(None).cast(dict(replies(spark, d).dtypes)["fields"]))).alias("data"))).alias("reply"))
    return P.citing_rows(rows, "reply").select("paper_id", "title").distinct()


@query("SELECT DISTINCT arxiv_id, authors, title FROM arxiv_papers")
def q_entry_rows(spark, d):
    rows = read(spark, d, "arxiv_papers", "arxiv_id", "authors", "title")
    entries = rows.select(F.concat(F.lit("http://archive.example/abs/"), "arxiv_id").alias("entry_id"), F.transform("authors", lambda a: F.struct(a.alias("name"))).alias("authors"), "title")
    return P.entry_rows(entries)


@query("""SELECT DISTINCT '{"arxiv_id":"' || arxiv_id || '","published":"' || strftime(published, '%Y-%m-%dT%H:%M:%S') || '"}' AS json FROM arxiv_papers""")
def q_paper_json(spark, d):
    return P.as_json(read(spark, d, "arxiv_papers", "arxiv_id", "published"), ["published"])


@query("""WITH a AS (SELECT DISTINCT coalesce(arxiv_id, '-') AS id, title, CASE WHEN len(authors) > 2 THEN array_to_string(authors[1:2], ', ') || ' +' || (len(authors) - 2) ELSE array_to_string(authors, ', ') END AS authors FROM arxiv_papers)
  SELECT id, CASE WHEN length(title) > 45 THEN substr(title, 1, 45) || '...' ELSE title END AS title, CASE WHEN length(authors) > 20 THEN substr(authors, 1, 20) || '...' ELSE authors END AS authors FROM a""")
def q_paper_display(spark, d):
    return P.display(read(spark, d, "arxiv_papers", "arxiv_id", "title", "authors"), "arxiv_id")


_CAT = " ".join(f"WHEN '{k}' THEN {v!r}" for k, v in P.DOMAIN_CATEGORIES.items())


@query(f"SELECT id, CASE domain {_CAT} ELSE ['cs.AI', 'cs.LG'] END AS categories FROM terminology")
def q_domain_categories(spark, d):
    """The categories of each term's domain, General's for domains without any."""
    known = F.create_map(*[F.lit(x) if isinstance(x, str) else F.array(*map(F.lit, x)) for pair in P.DOMAIN_CATEGORIES.items() for x in pair])
    return read(spark, d, "terminology").select("id", F.coalesce(F.try_element_at(known, F.col("domain")), F.array(*map(F.lit, P.categories_of("")))).alias("categories"))


@query("""SELECT action, CAST(count(*) AS BIGINT) AS n FROM (SELECT source_text, domain, CASE WHEN k.id IS NULL THEN 'add' ELSE 'update' END AS action FROM
  (SELECT DISTINCT source_text, new_target_text AS target_text, 'General' AS domain FROM term_changes WHERE source_text <> '' AND new_target_text <> '') r LEFT JOIN terminology k USING (source_text, domain)) GROUP BY 1""")
def q_import_counts(spark, d):
    raw = read(spark, d, "term_changes", "source_text", F.col("new_target_text").alias("target_text"))
    return S.import_actions(S.normalize_terms(raw), read(spark, d, "terminology"), overwrite=True).groupBy("action").agg(F.count("*").alias("n"))

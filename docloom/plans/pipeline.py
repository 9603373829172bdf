"""The document dataflow end to end: parse, chunk, match, enrich, validate, correct, assemble, render. One lazy plan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import documents as D
from docloom.operators import enrich as E
from docloom.operators import terms as M
from docloom.plans.hooks import Settings


def parse(papers: DataFrame, key: str, raw: str, exclude_references: bool = True) -> DataFrame:
    """Sections of page-marked papers, cleaned, without reference lists unless they are asked for."""
    made = D.sections(papers, key, raw)
    made = D.drop_references(made) if exclude_references else made
    return made.withColumn("content", T.clean_text(F.col("content")))


def heads(papers: DataFrame, key: str, raw: str, source: str | None = None) -> DataFrame:
    """(key, title, arxiv_id, total_pages): what a paper's text and source say of it."""
    pages = F.size(F.regexp_extract_all(F.col(raw), F.lit(r"\[PAGE \d+\]"), F.lit(0)))
    found = T.arxiv_id(F.col(source)) if source else F.lit(None).cast("string")
    return papers.select(key, D.document_title(F.col(raw)).alias("title"), found.alias("arxiv_id"), pages.alias("total_pages"))


def chunk(parsed: DataFrame, key: str, strategy: str = "hybrid", max_tokens: int = 800, overlap: int = 100) -> DataFrame:
    return D.section_chunks(parsed, key, strategy, max_tokens, overlap)


def preprocess(chunks: DataFrame, key: str, terms: DataFrame, limit: int = 20, titles: DataFrame | None = None, extra: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(chunks with the prompt of their best terms and the hint of their place, the terms of each chunk by rank).

    titles: key, title. extra: key, ord, source_text, target_text, for all chunks of a document.
    """
    keys = [key, "chunk_index"]
    ranked = M.top_terms(M.match_terms(chunks, keys, "content", terms), keys, limit)
    if extra is not None:
        ranked = M.extra_terms(chunks, ranked, extra, keys, [key], limit, limit)
    ranked = ranked.select(*keys, "rank", "source_text", "target_text")
    prompts = M.term_prompt(ranked, keys)
    rows = chunks.join(prompts, keys, "left")
    rows = rows.join(titles.select(key, "title"), key, "left") if titles is not None else rows.withColumn("title", F.lit(""))
    hint = D.context_hint(F.coalesce("title", F.lit("")), F.col("section_title"), F.col("section_index"))
    return rows.withColumns({"prompt": F.coalesce("prompt", F.lit("")), "hint": hint}).drop("title"), ranked


def postprocess(done: DataFrame, ranked: DataFrame, key: str, threshold: float = 0.8, least: float | None = None, fuzzy: bool = True, auto_correct: bool = True) -> tuple[DataFrame, DataFrame]:
    """(chunks with their corrected text, a row for each check of a term).

    done: key, chunk_index, content, output, status. Terms are checked in completed chunks alone; a mismatched term's first
    occurrence is replaced by the expected one, term after term in their rank.
    """
    keys = [key, "chunk_index"]
    rows = ranked.join(done.where("status = 'completed'").select(*keys, "content", "output"), keys)
    checks = M.validate(rows, "source_text", "target_text", "content", "output", threshold, least, fuzzy)
    wrong = (F.col("found_status") == "mismatched") & F.col("found_text").isNotNull()
    checks = checks.withColumn("corrected", F.lit(auto_correct) & wrong).drop("content", "output")
    if not auto_correct:
        return done.withColumn("text", F.coalesce("output", F.lit(""))), checks
    change = F.struct("rank", F.col("found_text").alias("old"), F.col("target_text").alias("new"))
    changes = checks.where("corrected").groupBy(*keys).agg(F.array_sort(F.collect_list(change)).alias("_changes"))
    both = done.join(changes, keys, "left")
    text = F.coalesce("output", F.lit(""))
    return both.withColumn("text", F.when(F.col("_changes").isNotNull(), M.correct(text, F.col("_changes"))).otherwise(text)).drop("_changes"), checks


def translate_documents(
    papers: DataFrame, key: str, raw: str, terms: DataFrame, call: Callable[[str, str, str], str], settings: Settings | None = None,
    source: str | None = None, extra: DataFrame | None = None, date: Column | None = None, fuzzy: bool = True, keep: Callable[[DataFrame], DataFrame] = lambda df: df,
) -> DataFrame:
    """(key, filename, markdown, md5_hash, content_length) of papers.

    ``call`` (text, terms, hint) works on each chunk; chunks that failed add nothing. ``keep`` should store the called chunks
    (a table or a checkpoint) where calls are dear: several later steps read them.
    """
    c = settings or Settings()
    top = heads(papers, key, raw, source)
    chunks = chunk(parse(papers, key, raw), key, c.strategy, c.max_tokens, c.overlap)
    ready, ranked = preprocess(chunks, key, terms, c.term_limit, top, extra)
    called = keep(E.enrich(ready, [key, "chunk_index"], ["content", "prompt", "hint"], call, c.attempts, c.retry_delay))
    done = ready.select(key, "chunk_index", "section_title", "content", "token_count").join(called, [key, "chunk_index"])
    texts, checks = postprocess(done, ranked, key, c.threshold, fuzzy=fuzzy, auto_correct=c.auto_correct)
    rates = M.status_summary(checks, [key], "found_status").select(key, "match_rate")
    figures = done.groupBy(key).agg(F.count("*").alias("total_chunks"), F.sum("token_count").alias("total_tokens"))
    none = F.lit(None).cast("string")
    head = top.join(figures, key).join(rates, key, "left").withColumns(
        {"title_ko": none, "authors": F.array().cast("array<string>"), "translated_date": none if date is None else date, "domain": none, "abstract": none, "match_rate": F.col("match_rate").cast("decimal(5,2)")}
    )
    used = M.terms_used(ranked, key, ["chunk_index", "rank"])
    made = D.render_full(D.assemble(texts, key), head, used, key)
    name = T.filename(F.col("title"), "paper", F.col("arxiv_id"))
    return made.join(top.select(key, name.alias("filename")), key).select(key, "filename", "markdown", "md5_hash", "content_length")

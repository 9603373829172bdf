"""Queries of the corpus operators over the project's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import contamination, entity_match, lookalike, packing, residue, scan_noise, sentence_align, splitting, truncation
from docloom.llm.common import cut_lineage, spread, table


def p1_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = table(spark, sf_dir, "term_changes")
    checks = table(spark, sf_dir, "term_validations")
    part = lambda df, key, field: df.select(F.col(key).alias("record_id"), F.lit(field).alias("field_name"), F.col(field).alias("value"))
    return (
        part(changes, "id", "new_target_text")
        .unionByName(part(changes, "id", "source_text"))
        .unionByName(part(checks, "validation_id", "actual_target"))
        .where("value is not null")
        .distinct()
    )


def p1_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value of the three fields with its one consistent form."""
    return lookalike.canonical_text(p1_values(spark, sf_dir), "value")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_canonical(spark, sf_dir).where("canonical <> value").select("record_id", "field_name").distinct()


def p2_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The probability of a cut for every completed translated text."""
    keys = ["translation_id", "chunk_index"]
    rows = table(spark, sf_dir, "translated_chunks").where("status = 'completed'").select(*keys, "source_name", "translated_text")
    return truncation.score_truncation(spread(rows, *keys).distinct(), keys, "translated_text", "source_name", keep=cut_lineage)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_scores(spark, sf_dir).where("p_cut >= 0.5").select("translation_id", "chunk_index").distinct()


def p2_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of cut texts of each source."""
    return truncation.truncation_rates(p2_scores(spark, sf_dir), "source_name")


def p3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chunk as pieces of at most 220 tokens with an overlap of 30."""
    rows = table(spark, sf_dir, "chunks").select("translation_id", "chunk_index", "content").distinct()
    return splitting.split_items(rows, ["translation_id", "chunk_index"], "content")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_pieces(spark, sf_dir).where("n_pieces > 1").select("translation_id", "chunk_index").distinct()


def p4_noise(spark: SparkSession, sf_dir: str) -> scan_noise.PageNoise:
    papers = table(spark, sf_dir, "parsed_papers").select(F.col("paper_doc_id").alias("doc"), F.col("raw_text").alias("raw"))
    sections = table(spark, sf_dir, "parsed_sections").select(
        F.col("paper_doc_id").alias("doc"), F.col("section_ord").alias("part"), F.col("content").alias("raw")
    )
    return scan_noise.PageNoise(papers, sections, cut_lineage)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = p4_noise(spark, sf_dir).all_findings()
    return rows.select(F.col("doc").alias("paper_doc_id"), F.col("part").alias("section_ord"), "line_no", "noise_kind").distinct()


def p4_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers (section_ord -1) and sections as continuous paragraphs."""
    rows = p4_noise(spark, sf_dir).repaired()
    return rows.select(F.col("doc").alias("paper_doc_id"), F.col("part").alias("section_ord"), "text")


def p5_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of both paper tables that describe the same work, with a confidence."""
    arxiv = table(spark, sf_dir, "arxiv_papers").select(
        F.col("arxiv_id").alias("id"), F.regexp_replace("arxiv_id", r"v\d+$", "").alias("work"), "title", "authors", F.year("published").alias("year")
    )
    scholar = table(spark, sf_dir, "semantic_scholar_papers").select(F.col("paper_id").alias("id"), "title", "authors", "year", F.col("arxiv_id").alias("ref"))
    found = entity_match.match_records(arxiv, scholar, keep=cut_lineage)
    return found.select(F.col("left_id").alias("arxiv_id"), F.col("right_id").alias("paper_id"), "confidence")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_matches(spark, sf_dir).select("arxiv_id", "paper_id").distinct()


def p6_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentences of each chunk and its translation that translate each other, with a score."""
    keys = ["translation_id", "chunk_index"]
    # texts are shuffled once, by key; copies and partners meet there
    chunks = spread(table(spark, sf_dir, "chunks").where("content <> ''").select(*keys, "content"), *keys).distinct()
    translated = spread(table(spark, sf_dir, "translated_chunks").where("translated_text <> ''").select(*keys, "translated_text"), *keys).distinct()
    return sentence_align.align_sentences(chunks.join(translated, keys), keys, "content", "translated_text", keep=cut_lineage)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p6_links(spark, sf_dir).select("translation_id", "chunk_index", "source_no", "target_no").distinct()


def p7_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of 2,048 tokens of every document."""
    return packing.pack_items(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fill_rates(p7_bins(spark, sf_dir))


def p8_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest match of every document and the items leaked into it."""
    return contamination.find_leaks(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "benchmark"), "item_id", "text")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_matches(spark, sf_dir).select("doc_id", "item_id")


def p8_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus without the documents that hold passages of items."""
    return contamination.remove_leaks(table(spark, sf_dir, "documents"), "doc_id", p8_matches(spark, sf_dir)).distinct()


def p9_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.find_residue(table(spark, sf_dir, "documents").select("doc_id", "text").distinct(), "text")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = residue.find_residue(table(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    return rows.where("residue_kind is not null").select("doc_id").distinct()


def p9_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus without these records."""
    return residue.find_residue(table(spark, sf_dir, "documents"), "text").where("residue_kind is null").drop("residue_kind").distinct()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": p1_found,
        "p1_canonical": p1_canonical,
        "p2_found": p2_found,
        "p2_scores": p2_scores,
        "p2_rates": p2_rates,
        "p3_found": p3_found,
        "p3_pieces": p3_pieces,
        "p4_found": p4_found,
        "p4_repaired": p4_repaired,
        "p5_found": p5_found,
        "p5_matches": p5_matches,
        "p6_found": p6_found,
        "p6_links": p6_links,
        "p7_bins": p7_bins,
        "p7_fill": p7_fill,
        "p8_found": p8_found,
        "p8_matches": p8_matches,
        "p8_clean": p8_clean,
        "p9_found": p9_found,
        "p9_kinds": p9_kinds,
        "p9_clean": p9_clean,
    }


def oracle_sql() -> dict[str, str]:
    return {
        # tokens: runs of characters that are not white space in Unicode
        "p3_found": r"""
            SELECT DISTINCT translation_id, chunk_index FROM chunks
            WHERE len(regexp_extract_all(content, '[^\s\x0b\x1c-\x1f\x85\p{Z}]+')) > 220
        """,
    }

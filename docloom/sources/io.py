"""Reading and writing: documents, term lists, and tables that are replaced as a whole."""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TERM_COLUMNS = {"mapping_type": "word", "domain": "General", "confidence": 1.0, "is_user_defined": True, "usage_count": 0}
TABLES = {
    "terminology": "id string, source_text string, target_text string, mapping_type string, domain string, confidence double, is_user_defined boolean, usage_count int, created_at timestamp, updated_at timestamp",
    "translations": "id string, paper_title string, paper_url string, arxiv_id string, domain string, original_md_hash string, current_md_hash string, output_path string, total_chunks int, status string, error_message string, created_at timestamp, updated_at timestamp",
    "translation_history": "id string, translation_id string, chunk_index int, section_title string, original_text string, translated_text string, terms_applied array<struct<source:string,target:string>>, tokens_used int, created_at timestamp",
    "term_changes": "id string, translation_id string, terminology_id string, change_type string, old_target_text string, new_target_text string, source_text string, detected_from string, created_at timestamp",
}


def read_pdf_bytes(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of files that begin as PDF files do."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.where(F.substring("content", 1, 4) == F.lit(b"%PDF"))


def pages_to_text(pages: Column) -> Column:
    """Page texts as one text with a mark line before each page."""
    marked = F.transform(pages, lambda p, i: F.concat(F.lit("[PAGE "), (i + 1).cast("string"), F.lit("]\n"), F.coalesce(p, F.lit(""))))
    return F.array_join(marked, "\n\n")


def read_markdown(spark: SparkSession, folder: str) -> DataFrame:
    """(path, text) of the markdown files of a folder."""
    return spark.read.text(folder, wholetext=True, pathGlobFilter="*.md").select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def write_documents(df: DataFrame, path: str, text: str) -> None:
    df.select(F.col(text).alias("value")).write.mode("overwrite").text(path)


def write_named(df: DataFrame, folder: str, name: str, text: str, ending: str = ".md") -> DataFrame:
    """Write each text to a file of its own in a folder that all executors share; (file_path, filename, md5_hash, content_length) of what was written.

    Nothing is written before an action on the result. A file is written beside its place and moved there, so a task that
    runs twice leaves whole files.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.makedirs(folder, exist_ok=True)
        for pdf in batches:
            out = []
            for n, t in zip(pdf["_name"], pdf["_text"]):
                path, data = os.path.join(folder, f"{n}{ending}"), t.encode()
                part = f"{path}.{uuid.uuid4().hex}"
                with open(part, "wb") as f:
                    f.write(data)
                os.replace(part, path)
                out.append((path, n, hashlib.md5(data).hexdigest(), len(t)))
            yield pd.DataFrame(out, columns=["file_path", "filename", "md5_hash", "content_length"])

    rows = df.select(F.col(name).alias("_name"), F.coalesce(text, F.lit("")).alias("_text")).where("_name is not null")
    return rows.mapInPandas(write, "file_path string, filename string, md5_hash string, content_length long")


def read_terms(spark: SparkSession, path: str) -> DataFrame:
    """A term list from JSON or CSV, by the name's ending, with defaults for columns that are missing."""
    raw = spark.read.json(path, multiLine=True) if path.endswith(".json") else spark.read.csv(path, header=True)
    return normalize_terms(raw)


def normalize_terms(raw: DataFrame) -> DataFrame:
    """Rows with a source and a target; other columns get their defaults and types."""
    types = dict(f.split(" ") for f in TABLES["terminology"].split(", "))
    rows = raw
    for name, default in TERM_COLUMNS.items():
        given = F.col(name).cast(types[name]) if name in raw.columns else F.lit(None).cast(types[name])
        rows = rows.withColumn(name, F.coalesce(given, F.lit(default).cast(types[name])))
    return rows.where("source_text <> '' and target_text <> ''").select("source_text", "target_text", *TERM_COLUMNS)


def write_terms(df: DataFrame, path: str, kind: str = "json") -> None:
    writer = df.write.mode("overwrite")
    writer.json(path) if kind == "json" else writer.option("header", True).csv(path)


def create_tables(spark: SparkSession, database: str = "default") -> None:
    for name, columns in TABLES.items():
        if not spark.catalog.tableExists(f"{database}.{name}"):
            spark.sql(f"CREATE TABLE {database}.{name} ({columns}) USING parquet")


def replace_table(df: DataFrame, folder: str, version: str) -> str:
    """Write a new version of a table beside the old one, so that what is being read is never overwritten; gives its place."""
    path = f"{folder}/version={version}"
    df.write.mode("errorifexists").parquet(path)
    return path


# Changes of stored tables, as joins


def upsert(old: DataFrame, new: DataFrame, keys: list[str], now: Column | None = None) -> DataFrame:
    """All rows of both, in all columns of the old side; where the key is in both, the new side's values that are not null.

    The new side must be unique in its key. ``now`` is written to updated_at of the rows that the new side touches, and to
    created_at of the rows that it adds.
    """
    use = [c for c in new.columns if c in old.columns and c not in keys]
    fresh = new.select(*keys, *[F.col(c).alias(f"_{c}") for c in use], F.lit(True).alias("_new"))
    both = old.withColumn("_old", F.lit(True)).join(fresh, keys, "full_outer")
    made = {c: F.coalesce(f"_{c}", c) if c in use else F.col(c) for c in old.columns}
    if now is not None:
        for c, touched in (("updated_at", F.col("_new")), ("created_at", F.col("_new") & F.col("_old").isNull())):
            if c in made:
                made[c] = F.when(touched, now).otherwise(made[c])
    return both.select(*[e.alias(c) for c, e in made.items()])


def update_columns(df: DataFrame, key: str, changes: DataFrame, allowed: list[str], now: Column | None = None) -> DataFrame:
    """Rows with the non-null values of ``changes`` in the allowed columns; other columns of ``changes`` are left out.

    ``now`` is written to updated_at of the rows that are among ``changes``.
    """
    use = [c for c in changes.columns if c in allowed]
    given = changes.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_{c}") for c in use])
    both = df.join(given, F.col(key) == F.col("_key"), "left")
    made = {c: F.coalesce(f"_{c}", c) if c in use else F.col(c) for c in df.columns}
    if now is not None and "updated_at" in made:
        made["updated_at"] = F.when(F.col("_key").isNotNull(), now).otherwise(F.col("updated_at"))
    return both.select(*[e.alias(c) for c, e in made.items()])


def increment(df: DataFrame, key: str, counter: str, used: DataFrame) -> DataFrame:
    """The counter plus the number of rows of ``used`` with the key."""
    n = used.groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("_n"))
    both = df.join(n, F.col(key) == F.col("_key"), "left")
    return both.select(*[(F.col(c) + F.coalesce("_n", F.lit(0))).alias(c) if c == counter else F.col(c) for c in df.columns])


def delete_keys(df: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    return df.join(gone.select(F.col(gone.columns[0]).alias(key)), key, "left_anti")


def null_references(df: DataFrame, reference: str, gone: DataFrame) -> DataFrame:
    """Rows whose reference is among the deleted keys keep all but the reference."""
    keys = gone.select(F.col(gone.columns[0]).alias("_gone")).distinct()
    both = df.join(keys, F.col(reference) == F.col("_gone"), "left")
    return both.select(*[F.when(F.col("_gone").isNull(), F.col(c)).alias(c) if c == reference else F.col(c) for c in df.columns])


def import_actions(rows: DataFrame, terms: DataFrame, overwrite: bool) -> DataFrame:
    """The action for each row of a term list: add, update or skip, by the exact key of source and domain."""
    known = terms.select("source_text", "domain", F.lit(True).alias("known")).distinct()
    action = F.when(F.col("known").isNull(), "add").when(F.lit(overwrite), "update").otherwise("skip")
    return rows.join(known, ["source_text", "domain"], "left").withColumn("action", action).drop("known")

"""Stored tables: look-ups, rows to append, and changes as joins. Writing is replacing by a new version (``io.replace_table``)."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.sources.io import TABLES, update_columns

TERM_FIELDS = ["target_text", "mapping_type", "domain", "confidence", "is_user_defined"]


# Look-ups: filters that reach the scan


def by_value(df: DataFrame, **values) -> DataFrame:
    """The rows with the given values; columns whose value is None are not asked."""
    for name, value in values.items():
        if value is not None:
            df = df.where(F.col(name) == F.lit(value))
    return df


def one(df: DataFrame, order: list[str], **values) -> DataFrame:
    """The first row by ``order`` of those with the given values."""
    return by_value(df, **values).orderBy(*order).limit(1)


def newest(df: DataFrame, n: int, status: str | None = None, time: str = "created_at", key: str = "id") -> DataFrame:
    """The ``n`` newest rows, of one status if that is given."""
    return (by_value(df, status=status) if status is not None else df).orderBy(F.desc_nulls_last(time), key).limit(n)


def search_terms(terms: DataFrame, keyword: str, domain: str | None = None, n: int = 50) -> DataFrame:
    """The first ``n`` terms whose source or target holds the keyword as it is written, without regard to case."""
    low = F.lit(keyword.lower())
    hits = by_value(terms, domain=domain).where(F.lower("source_text").contains(low) | F.lower("target_text").contains(low))
    return hits.orderBy("source_text", "id").limit(n)


def by_output_path(translations: DataFrame, part: str) -> DataFrame:
    return translations.where(F.lower("output_path").contains(F.lit(part.lower())))


def is_reachable(df: DataFrame) -> bool:
    """Whether a row of the table can be read."""
    try:
        df.limit(1).collect()
    except Exception:  # noqa: BLE001
        return False
    return True


# Rows to append


def shaped(df: DataFrame, name: str) -> DataFrame:
    """``df`` in the columns and types of a stored table; columns it lacks are null, others are left out."""
    fields = [f.split(" ", 1) for f in split_fields(TABLES[name])]
    return df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(kind).alias(c) for c, kind in fields])


def split_fields(text: str) -> list[str]:
    out, depth = [""], 0
    for ch in text:
        depth += (ch == "<") - (ch == ">")
        if ch == "," and not depth:
            out.append("")
        else:
            out[-1] += ch
    return [f.strip() for f in out]


def new_id(*parts: str) -> Column:
    """A repeatable key, so that a task that runs twice makes equal rows."""
    return F.md5(F.concat_ws("\u0001", *[F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts]))


def new_terms(df: DataFrame, now: Column) -> DataFrame:
    """Term rows with their defaults."""
    given = lambda c, v: F.coalesce(F.col(c), F.lit(v)) if c in df.columns else F.lit(v)
    rows = df.withColumns({"mapping_type": given("mapping_type", "word"), "domain": given("domain", "General"), "confidence": given("confidence", 1.0), "is_user_defined": given("is_user_defined", True), "usage_count": F.lit(0), "created_at": now, "updated_at": now})
    return shaped(rows.withColumn("id", new_id("source_text", "domain")), "terminology")


def new_translations(df: DataFrame, now: Column) -> DataFrame:
    """Translation rows that have begun."""
    rows = df.withColumns({"id": new_id("paper_title", "output_path"), "status": F.lit("in_progress"), "created_at": now, "updated_at": now})
    return shaped(rows, "translations")


def new_history(df: DataFrame, now: Column) -> DataFrame:
    """A history row for each translated chunk."""
    return shaped(df.withColumns({"id": new_id("translation_id", "chunk_index"), "created_at": now}), "translation_history")


def new_changes(df: DataFrame, now: Column, kind: str | None = None) -> DataFrame:
    """Log rows; old_target, new_target and change_reason take their stored names, other columns are left out.

    ``kind``: add, update or delete for all rows; otherwise that of the rows, update where it is missing.
    """
    names = {"old_target": "old_target_text", "new_target": "new_target_text", "change_reason": "detected_from"}
    rows = df.select(*[F.col(c).alias(names.get(c, c)) for c in df.columns])
    has = lambda c, v: F.coalesce(F.col(c), F.lit(v)) if c in rows.columns else F.lit(v)
    rows = rows.withColumns({"change_type": F.lit(kind) if kind else has("change_type", "update"), "detected_from": has("detected_from", "user_feedback"), "created_at": now})
    parts = [c for c in ("translation_id", "terminology_id", "source_text", "new_target_text", "change_type") if c in rows.columns]
    return shaped(rows.withColumn("id", new_id(*parts)), "term_changes")


# Changes


def set_status(translations: DataFrame, changes: DataFrame, now: Column) -> DataFrame:
    """``changes`` (id, status, error_message): an empty error message leaves the stored one."""
    given = changes.withColumn("error_message", F.nullif("error_message", F.lit("")))
    return update_columns(translations, "id", given, ["status", "error_message"], now)


def set_hashes(translations: DataFrame, changes: DataFrame, now: Column) -> DataFrame:
    """``changes`` (id, original, current): a current hash that is missing or empty is the original one."""
    given = changes.select("id", F.col("original").alias("original_md_hash"), F.coalesce(F.nullif("current", F.lit("")), "original").alias("current_md_hash"))
    return update_columns(translations, "id", given, ["original_md_hash", "current_md_hash"], now)


def set_current_hash(translations: DataFrame, changes: DataFrame, now: Column) -> DataFrame:
    """``changes`` (id, current_md_hash)."""
    return update_columns(translations, "id", changes, ["current_md_hash"], now)


def set_text(history: DataFrame, changes: DataFrame) -> DataFrame:
    """``changes`` (id, translated_text)."""
    return update_columns(history, "id", changes, ["translated_text"])


def update_terms(terms: DataFrame, changes: DataFrame, now: Column) -> DataFrame:
    """``changes`` (id and any of TERM_FIELDS)."""
    return update_columns(terms, "id", changes, TERM_FIELDS, now)


def upsert_counts(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """How many rows of ``new`` are added, change a row or can't be used (a null key)."""
    known = old.select(*keys, F.lit(True).alias("_known")).distinct()
    bad = ~F.expr(" and ".join(f"{k} is not null" for k in keys))
    rows = new.join(known, keys, "left")
    return rows.agg(F.count_if(~bad & F.col("_known").isNull()).alias("added"), F.count_if(~bad & F.col("_known")).alias("updated"), F.count_if(bad).alias("errors"))


# Schema


def run_migrations(spark: SparkSession, folder: str) -> list[tuple[str, str | None]]:
    """Run the statements of the *.sql files of a folder in the order of their names; (file, error), ends at the first error."""
    done: list[tuple[str, str | None]] = []
    for path in sorted(Path(folder).glob("*.sql")):
        try:
            for statement in path.read_text().split(";"):
                if statement.strip():
                    spark.sql(statement)
        except Exception as e:  # noqa: BLE001
            return [*done, (path.name, str(e))]
        done.append((path.name, None))
    return done


def missing_tables(spark: SparkSession, database: str = "default") -> list[str]:
    return [t for t in TABLES if not spark.catalog.tableExists(f"{database}.{t}")]


def broken_references(child: DataFrame, column: str, parent: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose reference has no row in the parent table: the constraint as a check."""
    return child.where(F.col(column).isNotNull()).join(parent.select(F.col(key).alias(column)).distinct(), column, "left_anti")


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")

"""Changes of edited texts: line differences, inferred term changes, and the plan of updates."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.functions.similarity import similarity
from docloom.operators.terms import match_terms


def line_changes(df: DataFrame, key: str, old: str, new: str, context: int = 2) -> DataFrame:
    """(key, seq, change_type, old_text, new_text, line_no, context): removed and added lines of texts that differ.

    Equal texts are left out by their hash before any text reaches Python. line_no counts lines of the new text from 1.
    """
    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("key"), F.coalesce(old, F.lit("")).alias("old"), F.coalesce(new, F.lit("")).alias("new")).where(F.md5("old") != F.md5("new"))

    def diff(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k, a, b in zip(pdf["key"], pdf["old"], pdf["new"]):
                x, y, seq = a.split("\n") if a else [], b.split("\n") if b else [], 0
                for op, i1, i2, j1, j2 in SequenceMatcher(None, x, y, autojunk=False).get_opcodes():
                    if op == "equal":
                        continue
                    around = "\n".join(y[max(0, j1 - context) : j1])
                    for i in range(i1, i2):
                        out.append((k, seq, "removed", x[i], None, j1 + 1, around))
                        seq += 1
                    for j in range(j1, j2):
                        out.append((k, seq, "added", None, y[j], j + 1, around))
                        seq += 1
            yield pd.DataFrame(out, columns=["key", "seq", "change_type", "old_text", "new_text", "line_no", "context"])

    made = rows.mapInPandas(diff, f"key {kind}, seq int, change_type string, old_text string, new_text string, line_no int, context string")
    return made.withColumnRenamed("key", key)


def merge_changes(changes: DataFrame, key: str, threshold: float = 0.6) -> DataFrame:
    """Neighbouring removed and added lines of enough similarity become one modified line."""
    order = W.partitionBy(key).orderBy("seq")
    pair = (F.col("change_type") == "removed") & (F.lead("change_type").over(order) == "added")
    rows = changes.withColumns({"_pair": pair, "_next": F.lead("new_text").over(order), "_next_line": F.lead("line_no").over(order)})
    # the similarity of neighbours alone is asked
    rows = rows.withColumn("_ratio", F.when(F.col("_pair"), similarity(F.when(F.col("_pair"), F.col("old_text")), F.when(F.col("_pair"), F.col("_next")))))
    rows = rows.withColumn("_merged", F.coalesce(F.col("_ratio") >= threshold, F.lit(False)))
    rows = rows.withColumn("_used", F.coalesce(F.lag("_merged").over(order), F.lit(False))).where("not _used")
    merged = F.col("_merged")
    return rows.select(
        key, "seq", F.when(merged, "modified").otherwise(F.col("change_type")).alias("change_type"), "old_text",
        F.when(merged, F.col("_next")).otherwise(F.col("new_text")).alias("new_text"), F.when(merged, F.col("_next_line")).otherwise(F.col("line_no")).alias("line_no"), "context",
    )


def line_multiset_changes(df: DataFrame, key: str, old: str, new: str) -> DataFrame:
    """(key, line, n_removed, n_added): lines that one text has more often than the other, without regard to order."""
    lines = lambda c, sign: df.select(key, F.explode(F.split(c, "\n", -1)).alias("line")).withColumn("n", F.lit(sign))
    n = lines(old, -1).unionByName(lines(new, 1)).groupBy(key, "line").agg(F.sum("n").alias("n")).where("n <> 0")
    return n.select(key, "line", F.greatest(-F.col("n"), F.lit(0)).cast("long").alias("n_removed"), F.greatest(F.col("n"), F.lit(0)).cast("long").alias("n_added"))


def inferred_terms(modified: DataFrame, terms: DataFrame, word: str = "[가-힣]+", confidence: float = 0.6) -> DataFrame:
    """Term changes that modified lines suggest: a target of the old line that the new line lacks, and the first other word of it.

    Of several sources with one target the last one given (by ``ord``, else by source) counts.
    """
    latest = F.max_by("source_text", F.struct("ord", "source_text")) if "ord" in terms.columns else F.max("source_text")
    t = terms.where("target_text <> ''").groupBy("target_text").agg(latest.alias("source_text"))
    rows = modified.where("change_type = 'modified'")
    # the whole rows go along, so that the changes are not worked out a second time
    hits = match_terms(rows, rows.columns, "old_text", t, "target_text").drop("match_count")
    hits = hits.where(F.col("old_text").contains(F.col("target_text")) & ~F.col("new_text").contains(F.col("target_text")))
    words = F.filter(F.regexp_extract_all("new_text", F.lit(f"({word})"), F.lit(1)), lambda w: (F.length(w) >= 2) & (w != F.col("target_text")))
    return hits.withColumns({"new_target": F.try_element_at(words, F.lit(1)), "confidence": F.lit(confidence)}).where("new_target is not null")


def known_term(changes: DataFrame, terms: DataFrame, key: str, keyword: str) -> DataFrame:
    """``changes`` with term_id of the best term whose source or target holds the keyword: exact first, then the shortest; null if none.

    Distinct keywords meet the terms in a join on letters: the first three of a keyword against every run of as many in a
    term; whole keywords are checked after that. The best term is an aggregate, so no keyword's terms are held in one place.
    """
    t = terms.select(F.col("id").alias("term_id"), F.lower("source_text").alias("_s"), F.lower("target_text").alias("_t"))
    runs = lambda c: F.flatten(F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.array(*[F.substring(F.col(c), i, F.lit(n)) for n in (1, 2, 3)])))
    own = lambda c: F.when(F.length(c) > 0, runs(c)).otherwise(F.array().cast("array<string>"))
    index = t.withColumn("_gram", F.explode(F.array_distinct(F.concat(F.coalesce(own("_s"), F.array()), F.coalesce(own("_t"), F.array())))))
    asked = changes.select(F.lower(keyword).alias("_k")).where("_k <> ''").distinct().withColumn("_gram", F.substring("_k", 1, 3))
    hits = asked.join(index, "_gram").where(F.col("_s").contains(F.col("_k")) | F.col("_t").contains(F.col("_k")))
    rank = F.struct(F.when(F.col("_s") == F.col("_k"), 0).otherwise(1).alias("far"), F.length("_s").alias("n"), F.col("_s"), F.col("term_id"))
    best = hits.groupBy("_k").agg(F.min_by("term_id", rank).alias("term_id"))
    return changes.withColumn("_k", F.lower(keyword)).join(best, "_k", "left").drop("_k")


def sync_plan(changes: DataFrame, terms: DataFrame, key: str, least: float = 0.7) -> DataFrame:
    """An action for each term change (skip, update_term or add_term), and a log entry for each that is not skipped.

    changes: key, source_text, new_target, confidence.
    """
    rows = known_term(changes, terms, key, "source_text")
    action = F.when(F.col("confidence") < least, "skip").when(F.col("term_id").isNull(), "add_term").otherwise("update_term")
    rows = rows.withColumn("_action", action)
    steps = F.when(F.col("_action") == "skip", F.array(F.col("_action"))).otherwise(F.array(F.col("_action"), F.lit("log_change")))
    return rows.withColumn("action", F.explode(steps)).drop("_action")


def hash_items(files: DataFrame) -> DataFrame:
    """An update_hash item for each translation whose file changed. files: translation_id, old_hash, new_hash."""
    return files.where("translation_id is not null and (old_hash is null or old_hash <> new_hash)").select("translation_id", F.lit("update_hash").alias("action"), "old_hash", "new_hash")


def plan_preview(plan: DataFrame, first: int = 5) -> DataFrame:
    """Of each action: how many, and the first few items; only the first few of a task go through the shuffle."""
    counts = plan.groupBy("action").agg(F.count("*").alias("n_items"))
    order = W.partitionBy("action").orderBy("source_text", "new_target")
    top = plan.withColumn("place", F.row_number().over(order)).where(F.col("place") <= first)
    return top.join(F.broadcast(counts), "action").select("action", "n_items", "place", "source_text", "new_target")


def preview_text(preview: DataFrame, first: int = 5) -> DataFrame:
    """(action, text): the items of a preview as lines, and how many more there are."""
    line = F.concat(F.lit("  • "), F.col("source_text"), F.lit(" → "), F.coalesce("new_target", F.lit("")))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))), lambda x: x.line), "\n")
    made = preview.groupBy("action", "n_items").agg(lines.alias("body"))
    head = F.concat(F.col("action"), F.lit(" ("), F.col("n_items").cast("string"), F.lit(")\n"))
    more = F.when(F.col("n_items") > first, F.concat(F.lit("\n  ... "), (F.col("n_items") - first).cast("string"))).otherwise("")
    return made.select("action", F.concat(head, "body", more).alias("text"))


def apply_plan(terms: DataFrame, plan: DataFrame) -> DataFrame:
    """The dictionary after the plan: updated targets and added terms."""
    latest = plan.where("action = 'update_term'").groupBy("term_id").agg(F.max("new_target").alias("_new"))
    updated = terms.join(latest, F.col("id") == F.col("term_id"), "left").select(*[F.coalesce("_new", c).alias(c) if c == "target_text" else F.col(c) for c in terms.columns])
    added = plan.where("action = 'add_term'").groupBy("source_text").agg(F.max("new_target").alias("target_text"))
    given = {"id": F.md5(F.concat(F.col("source_text"), F.lit("\u0001General"))), "source_text": F.col("source_text"), "target_text": F.col("target_text"), "domain": F.lit("General"), "mapping_type": F.lit("word"), "confidence": F.lit(1.0), "is_user_defined": F.lit(True), "usage_count": F.lit(0)}
    return updated.unionByName(added.select(*[given.get(c, F.lit(None)).cast(terms.schema[c].dataType).alias(c) for c in terms.columns]))


def update_hashes(translations: DataFrame, items: DataFrame) -> DataFrame:
    """``translations`` with the new current hash of those among ``items``."""
    new = items.groupBy(F.col("translation_id").alias("_id")).agg(F.max("new_hash").alias("_new"))
    both = translations.join(new, F.col("id") == F.col("_id"), "left")
    return both.select(*[F.coalesce("_new", c).alias(c) if c == "current_md_hash" else F.col(c) for c in translations.columns])


def change_log(plan: DataFrame, now: Column) -> DataFrame:
    """The log rows of a plan: what was updated or added, with its term, in the log's columns."""
    rows = plan.where("action in ('update_term', 'add_term')")
    kind = F.when(F.col("action") == "add_term", "add").otherwise("update")
    return rows.select(F.md5(F.concat_ws("\u0001", "source_text", "new_target", kind)).alias("id"), F.col("term_id").alias("terminology_id"), kind.alias("change_type"), "source_text", F.col("new_target").alias("new_target_text"), F.lit("user_feedback").alias("detected_from"), now.alias("created_at"))


def applied_counts(plan: DataFrame, by: list[str]) -> DataFrame:
    """Updated, added and logged items of each group, and whether a hash was updated."""
    n = lambda a: F.count_if(F.col("action") == a)
    return plan.groupBy(*by).agg(n("update_term").alias("terms_updated"), n("add_term").alias("terms_added"), n("log_change").alias("changes_logged"), F.bool_or(F.col("action") == "update_hash").alias("hash_updated"))


def sync_summary(results: DataFrame) -> DataFrame:
    """One row over files (success, terms_updated, terms_added, changes_logged)."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    return results.agg(F.count("*").alias("total_files"), F.count_if("success").alias("success"), F.count_if(~F.col("success")).alias("failed"), total("terms_updated"), total("terms_added"), total("changes_logged"))


def change_summary(changes: DataFrame, key: str) -> DataFrame:
    """Line changes of each text by type; texts without changes have no row."""
    n = lambda t: F.count_if(F.col("change_type") == t)
    return changes.groupBy(key).agg(F.count("*").alias("total_changes"), n("added").alias("n_added"), n("removed").alias("n_removed"), n("modified").alias("n_modified"))


def changes_text(changes: DataFrame, key: str) -> DataFrame:
    """(key, diff): the changes of a text as lines in their order, as a reader or a model is asked about them."""
    line = (
        F.when(F.col("change_type") == "modified", F.concat(F.lit("- 기존: "), "old_text", F.lit("\n+ 변경: "), "new_text"))
        .when(F.col("change_type") == "removed", F.concat(F.lit("- 삭제: "), "old_text"))
        .otherwise(F.concat(F.lit("+ 추가: "), F.col("new_text")))
    )
    rows = changes.withColumn("_line", line)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("seq", "_line"))), lambda x: x["_line"])
    return rows.groupBy(key).agg(F.array_join(lines, "\n").alias("diff"))


def diff_report(changes: DataFrame, key: str, first: int = 10, width: int = 50) -> DataFrame:
    """(key, report): how many changes, and the first few of them with their line and shortened texts."""
    cut = lambda c, sign: F.when(F.col(c) != "", F.concat(F.lit(f"\n   {sign} "), F.substring(c, 1, width), F.lit("..."))).otherwise("")
    rows = changes.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy("seq")))
    top = rows.where(F.col("_n") <= first).withColumn("_line", F.concat(F.col("_n").cast("string"), F.lit(". ["), "change_type", F.lit("] "), F.col("line_no").cast("string"), cut("old_text", "-"), cut("new_text", "+")))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "_line"))), lambda x: x["_line"]), "\n")
    made = top.groupBy(key).agg(lines.alias("_body")).join(changes.groupBy(key).agg(F.count("*").alias("_all")), key)
    more = F.when(F.col("_all") > first, F.concat(F.lit("\n   ... "), (F.col("_all") - first).cast("string"))).otherwise("")
    return made.select(key, F.concat(F.lit("## "), F.col("_all").cast("string"), F.lit("\n"), "_body", more).alias("report"))


def known_by_stem(files: DataFrame, known: DataFrame) -> DataFrame:
    """Files (path, hash) with the translation whose output path ends in the file's name: the first by id; null if none.

    Both sides meet in a join on the file name's stem, so that no file is compared with every translation.
    """
    stem = lambda c: F.lower(F.regexp_replace(F.element_at(F.split(c, "/", -1), -1), r"\.[^.]*$", ""))
    k = known.select(stem(F.col("output_path")).alias("_stem"), F.struct("id", "current_md_hash").alias("_k")).where("_stem <> ''").groupBy("_stem").agg(F.min("_k").alias("_k"))
    both = files.withColumn("_stem", stem(F.col("path"))).join(k, "_stem", "left")
    return both.select(*files.columns, F.col("_k.id").alias("translation_id"), F.col("_k.current_md_hash").alias("stored_hash"))


def changed_files(files: DataFrame, known: DataFrame) -> DataFrame:
    """Files (path, hash) that are unknown or whose known hash differs; a file known without a hash counts as unchanged."""
    k = known.select(F.col("path").alias("_path"), F.col("hash").alias("_hash"))
    both = files.join(k, F.col("path") == F.col("_path"), "left")
    return both.where(F.col("_path").isNull() | (F.col("_hash").isNotNull() & (F.col("_hash") != F.col("hash")))).select("path", "hash", F.col("_path").isNull().alias("is_new"))


def differs(a: str, b: str) -> Column:
    """Both are there and unequal."""
    return F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))

"""Dictionary operators: matching, ranking, validation and correction of terms."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.functions.similarity import best_word

BROADCAST_BYTES = 8 << 20  # of a dictionary that becomes one automaton
BROADCAST_RUNS = 200_000  # beginnings of terms, of three letters each


def match_terms(texts: DataFrame, keys: list[str], text: str, terms: DataFrame, term: str = "source_text", word_boundary: bool = False, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(keys, terms' columns, match_count): every text with every term that it holds, without regard to case.

    ``keys`` name a text. The dictionary's size is measured. Up to ``broadcast_bytes`` its terms become one automaton that
    reads every text once. A larger one is joined on letters: the runs of three characters of the texts that begin a term
    meet the terms that they begin, keys alone go through that join, and the whole terms are checked in the texts after it.
    Terms of one or two characters, whose number is bounded by the alphabet, always go through the automaton.
    """
    t = terms.where(F.col(term) != "").withColumn("_low", F.lower(term))
    rows = texts.select(*keys, F.lower(text).alias("_text")).where("_text <> ''")
    size = t.agg(F.sum(F.length("_low") * 4 + 64)).first()[0] or 0
    if size <= broadcast_bytes:
        both = read_once(rows, t)
    else:
        head = t.where("length(_low) >= 3").withColumn("_gram", F.substring("_low", 1, 3))
        # all runs of three characters in one pass, as a substring by place reads a text from its beginning
        grams = F.array_distinct(F.regexp_extract_all("_text", F.lit("(?s)(?=(...))"), F.lit(1)))
        begins = head.select("_gram").distinct()
        # their number is measured: few are sent to all tasks, so that runs that begin no term are not shuffled
        begins = F.broadcast(begins) if begins.count() <= BROADCAST_RUNS else begins
        asked = rows.where("length(_text) >= 3").select(*keys, F.explode(grams).alias("_gram")).join(begins, "_gram", "left_semi")
        pairs = asked.join(head, "_gram").drop("_gram").join(rows, keys).where(F.col("_text").contains(F.col("_low")))
        both = pairs.withColumn("match_count", T.occurrences(F.col("_text"), F.col("_low"))).unionByName(read_once(rows, t.where("length(_low) < 3")))
    if word_boundary:
        both = both.where(F.rlike("_text", F.concat(F.lit(r"(?U)(?<!\w)\Q"), F.col("_low"), F.lit(r"\E(?!\w)"))))
    return both.select(*keys, *terms.columns, "match_count")


def read_once(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """``rows`` (_text) with the terms (_low) they hold and how often without overlap; the terms are of bounded size."""
    words = [r[0] for r in terms.select("_low").distinct().collect()]
    shared = rows.sparkSession.sparkContext.broadcast(words)

    @F.pandas_udf("array<struct<word:string,n:long>>")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automaton = ahocorasick.Automaton()
        for w in shared.value:
            automaton.add_word(w, w)
        if shared.value:
            automaton.make_automaton()
        for texts in batches:
            out = []
            for text in texts:
                n: dict[str, list[int]] = {}
                for end, w in automaton.iter(text) if shared.value else ():
                    seen = n.get(w)
                    if seen is None:
                        n[w] = [1, end]
                    elif end - len(w) >= seen[1]:
                        seen[0] += 1
                        seen[1] = end
                out.append([(w, x[0]) for w, x in n.items()])
            yield pd.Series(out)

    hits = rows.withColumn("_hit", F.explode(found("_text")))
    hits = hits.select("*", F.col("_hit.word").alias("_low"), F.col("_hit.n").alias("match_count")).drop("_hit")
    return hits.join(F.broadcast(terms), "_low")


def top_terms(matched: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The first ``k`` matches of each text by use, count and source, with their rank from 1."""
    order = W.partitionBy(*keys).orderBy(F.desc_nulls_last("usage_count"), F.desc("match_count"), "source_text", "id")
    return matched.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def first_by_usage(terms: DataFrame, n: int) -> DataFrame:
    return terms.orderBy(F.desc_nulls_first("usage_count"), "source_text", "id").limit(n)


def extra_terms(texts: DataFrame, matched: DataFrame, extra: DataFrame, keys: list[str], share: list[str], most: int, k: int) -> DataFrame:
    """Matches (at most ``most`` a text), then terms given for all texts of ``share`` whose source was not matched, cut to ``k`` a text.

    extra: share, ord, source_text, target_text; duplicates among the extras stay. Of the extras of one share only those
    are sent to its texts that can be among the first ``k`` there: the first ``k`` rows of the first ``most + k`` sources.
    """
    low = lambda df: df.withColumn("_low", F.lower("source_text"))
    order = W.partitionBy(*share, "_low").orderBy("ord", "source_text")
    near = low(extra).withColumn("_nth", F.row_number().over(order)).where(F.col("_nth") <= k)
    near = near.withColumn("_first", F.first("ord").over(order))
    near = near.withColumn("_place", F.dense_rank().over(W.partitionBy(*share).orderBy("_first", "_low"))).where(F.col("_place") <= most + k)
    more = texts.select(*keys).join(near, share).join(low(matched).select(*keys, "_low").distinct(), [*keys, "_low"], "left_anti")
    own = matched.select(*keys, "source_text", "target_text", F.lit(0).alias("_kind"), F.col("rank").alias("_ord"))
    both = own.unionByName(more.select(*keys, "source_text", "target_text", F.lit(1).alias("_kind"), F.col("ord").alias("_ord")))
    place = F.row_number().over(W.partitionBy(*keys).orderBy("_kind", "_ord", "source_text"))
    return both.withColumn("rank", place).where(F.col("rank") <= k).drop("_kind", "_ord")


def term_prompt(ranked: DataFrame, keys: list[str], description: str | None = None) -> DataFrame:
    """(keys, prompt): a line for each term in rank order, with its description in brackets where a column of it is given."""
    line = F.concat(F.lit("- "), F.col("source_text"), F.lit(" → "), F.col("target_text"))
    if description:
        line = F.concat(line, F.when(F.col(description) != "", F.concat(F.lit(" ("), F.col(description), F.lit(")"))).otherwise(""))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x.line)
    return ranked.groupBy(*keys).agg(F.array_join(lines, "\n").alias("prompt"))


def validate(df: DataFrame, source: str, expected: str, original: str, output: str, threshold: float = 0.8, least: float | None = None, fuzzy: bool = True) -> DataFrame:
    """``df`` with found_status, found_text, found_similarity and found_position of the expected term.

    Absent from the original: matched. Expected in the output: matched, with its place. Otherwise the most similar words:
    similar from ``threshold`` on, mismatched from ``least`` on (by default the threshold, so that there are none), else missing.
    """
    least = threshold if least is None else least
    absent = ~F.lower(original).contains(F.lower(source))
    exact = F.lower(output).contains(F.lower(expected))
    rows = df.withColumns({"_absent": F.coalesce(absent, F.lit(True)), "_exact": F.coalesce(exact, F.lit(False))})
    if fuzzy:
        # only rows that the exact tests leave open reach Python
        need = F.when(~F.col("_absent") & ~F.col("_exact"), F.col(output))
        rows = rows.withColumn("_best", best_word(need, F.col(expected), F.lit(float(least))))
    else:
        rows = rows.withColumn("_best", F.lit(None).cast("struct<word:string,score:double,position:int>"))
    score = F.col("_best.score")
    status = (
        F.when(F.col("_absent") | F.col("_exact"), "matched").when(score >= threshold, "similar").when(score >= least, "mismatched").otherwise("missing")
    )
    place = F.when(F.col("_absent"), -1).when(F.col("_exact"), T.position(F.col(output), F.col(expected))).otherwise(F.coalesce("_best.position", F.lit(-1)))
    found = F.when(F.col("_absent"), F.lit(None).cast("string")).when(F.col("_exact"), F.col(expected)).otherwise(F.col("_best.word"))
    similar = F.when(F.col("_absent") | F.col("_exact"), 1.0).otherwise(F.coalesce(score, F.lit(0.0)))
    return rows.withColumns({"found_status": status, "found_text": found, "found_similarity": similar, "found_position": place.cast("long")}).drop("_absent", "_exact", "_best")


def correct(text: Column, changes: Column) -> Column:
    """The text after each change (an array of structs old, new) has replaced its first occurrence, in order."""
    return F.aggregate(changes, text, lambda acc, c: T.replace_first(acc, c["old"], c["new"]))


def status_summary(checks: DataFrame, by: list[str], status: str = "status") -> DataFrame:
    """Checks by status and the share of matched and similar ones in percent; null without checks."""
    n = lambda s: F.count_if(F.col(status) == s)
    good = F.count_if(F.col(status).isin("matched", "similar"))
    return checks.groupBy(*by).agg(
        F.count("*").alias("n_checks"), n("matched").alias("n_matched"), n("similar").alias("n_similar"), n("mismatched").alias("n_mismatched"), n("missing").alias("n_missing"),
        *([F.count_if("corrected").alias("n_corrected"), F.round(F.count_if("corrected") * 100.0 / F.nullif(F.count("*"), F.lit(0)), 2).alias("correction_rate")] if "corrected" in checks.columns else []),
        F.round(good * 100.0 / F.nullif(F.count("*"), F.lit(0)), 2).alias("match_rate"),
    )


def places(text: Column, term: Column) -> Column:
    """(start, end) of every occurrence of the term, from 0, without overlap and without regard to case."""
    n = T.occurrences(text, term)
    low, t = F.lower(text), F.lower(term)
    # the parts between the occurrences give their places
    parts = F.transform(F.split(low, F.concat(F.lit(r"\Q"), t, F.lit(r"\E")), -1), F.length)
    starts = F.transform(F.sequence(F.lit(1), n.cast("int")), lambda i: F.aggregate(F.slice(parts, F.lit(1), i), F.lit(0), lambda a, x: a + x) + (i - 1) * F.length(t))
    return F.when(n > 0, F.transform(starts, lambda s: F.struct(s.cast("int").alias("start"), (s + F.length(t)).cast("int").alias("end")))).otherwise(F.array())


def check_chunks(checks: DataFrame, chunks: DataFrame, keys: list[str], status: str = "status") -> DataFrame:
    """``chunks`` with missing_terms, mismatched_terms and corrections; only completed ones are counted, others get zeros."""
    n = checks.groupBy(*keys).agg(F.count_if(F.col(status) == "missing").alias("_m"), F.count_if(F.col(status) == "mismatched").alias("_x"), F.count_if("corrected").alias("_c"))
    both = chunks.join(n, keys, "left")
    counted = lambda c: F.when(F.col("chunk_status") == "completed", F.coalesce(c, F.lit(0))).otherwise(0).cast("long")
    return both.withColumns({"missing_terms": counted("_m"), "mismatched_terms": counted("_x"), "corrections": counted("_c")}).drop("_m", "_x", "_c")


def terms_used(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """(key, source_text, target_text, ord): distinct terms, the first target of each, in the order in which they first appear."""
    at = F.struct(*order)
    made = df.groupBy(key, "source_text").agg(F.min(at).alias("_at"), F.min_by("target_text", at).alias("target_text"))
    return made.select(key, "source_text", "target_text", (F.row_number().over(W.partitionBy(key).orderBy("_at", "source_text")) - 1).cast("int").alias("ord"))

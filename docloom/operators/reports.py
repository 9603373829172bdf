"""Summaries and reports over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import text as T


def matching_summary(chunks: DataFrame, matched: DataFrame, keys: list[str], by: str, first: int = 10) -> DataFrame:
    """(by, total_chunks, chunks_with_terms, total_matches, unique_terms, top_terms): the first distinct sources in the order in which they appear.

    matched: keys (with ``by``), rank, source_text. The first places are added up before the few first are chosen.
    """
    order = [k for k in keys if k != by]
    n = matched.groupBy(*keys).agg(F.count("*").alias("n"))
    totals = chunks.select(*keys).distinct().join(n, keys, "left").groupBy(by).agg(F.count("*").alias("total_chunks"), F.count_if(F.col("n") > 0).alias("chunks_with_terms"), F.coalesce(F.sum("n"), F.lit(0)).alias("total_matches"))
    seen = matched.groupBy(by, "source_text").agg(F.min(F.struct(*order, "rank")).alias("at"))
    top = seen.groupBy(by).agg(F.count("*").alias("unique_terms"), F.transform(F.slice(F.array_sort(F.collect_list(F.struct("at", "source_text"))), 1, first), lambda x: x["source_text"]).alias("top_terms"))
    both = totals.join(top, by, "left")
    return both.select(by, "total_chunks", "chunks_with_terms", "total_matches", F.coalesce("unique_terms", F.lit(0)).alias("unique_terms"), F.coalesce("top_terms", F.array().cast("array<string>")).alias("top_terms"))


def token_estimate(df: DataFrame, by: list[str], prompt: Column, text: Column, overhead: int = 10, growth: float = 1.5, seconds: float = 2.0) -> DataFrame:
    """Chunks, tokens that their calls will take and give, and the time, before any call is made."""
    rows = df.select(*by, (T.token_count(prompt) + T.token_count(text) + overhead).alias("_n"))
    made = rows.groupBy(*by).agg(F.count("*").alias("total_chunks"), F.sum("_n").alias("input_tokens"))
    return made.select(*by, "total_chunks", "input_tokens", F.floor(F.col("input_tokens") * growth).alias("output_tokens"), (F.col("total_chunks") * seconds).alias("seconds"))


def message_tokens(messages: DataFrame, by: list[str], fields: list[str], overhead: int = 4, reply: int = 2) -> DataFrame:
    """Tokens of the messages of each conversation: those of all values, a few for each message, and those of the reply's start."""
    n = sum((T.token_count(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in fields), F.lit(overhead))
    return messages.groupBy(*by).agg((F.sum(n) + reply).alias("tokens"))


def action_counts(plan: DataFrame, actions: list[str], by: list[str] | None = None) -> DataFrame:
    """One column for each action with its number of rows."""
    return plan.groupBy(*(by or [])).agg(*[F.count_if(F.col("action") == a).alias(a) for a in actions])


def stage_counts(key: str, stages: dict[str, DataFrame]) -> DataFrame:
    """(key, a column for each stage): how many rows of each document every stage holds."""
    tall = None
    for name, df in stages.items():
        part = df.groupBy(key).agg(F.count("*").alias("n")).withColumn("stage", F.lit(name))
        tall = part if tall is None else tall.unionByName(part)
    pick = lambda s: F.coalesce(F.sum(F.when(F.col("stage") == s, F.col("n"))), F.lit(0)).alias(s)
    return tall.groupBy(key).agg(*[pick(s) for s in stages])


def correction_report(checks: DataFrame, key: str, chunk: str = "chunk_index") -> DataFrame:
    """(key, report): a summary and, by chunk, the terms that are missing or mismatched.

    checks: key, chunk, section_title, validation_id, source_text, expected_target, actual_target, status, corrected.
    Only those terms, not all checks, are brought together.
    """
    n = lambda s: F.count_if(F.col("status") == s).cast("string")
    rate = F.count_if(F.col("status").isin("matched", "similar")) * 100 / F.count("*")
    head = checks.groupBy(key).agg(
        F.concat_ws(
            "\n", F.lit("# 용어 교정 보고서\n"), F.lit("## 요약\n"), F.concat(F.lit("- 검사 용어: "), F.count("*").cast("string")), F.concat(F.lit("- 매칭 성공: "), n("matched")),
            F.concat(F.lit("- 유사 매칭: "), n("similar")), F.concat(F.lit("- 누락 용어: "), n("missing")), F.concat(F.lit("- 불일치 용어: "), n("mismatched")),
            F.concat(F.lit("- 교정 횟수: "), F.count_if("corrected").cast("string")), F.concat(F.lit("- 매칭률: "), F.round(rate, 2).cast("decimal(5,2)").cast("string"), F.lit("%")), F.lit("\n## 상세 내역\n"),
        ).alias("_head")
    )
    sign = F.when(F.col("status") == "missing", "❌").otherwise("⚠️")
    line = F.concat(F.lit("- "), sign, F.lit(" **"), "source_text", F.lit("**: 예상 '"), "expected_target", F.lit("', 실제 '"), F.coalesce(F.nullif("actual_target", F.lit("")), F.lit("(없음)")), F.lit("'"), F.when(F.col("corrected"), " ✅ 교정됨").otherwise(""))
    bad = checks.where("status in ('missing', 'mismatched')").withColumn("_line", line)
    joined = lambda sort, value, separator: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*sort, F.col(value).alias("_v")))), lambda x: x["_v"]), separator)
    parts = bad.groupBy(key, chunk).agg(F.min("section_title").alias("_title"), joined(["validation_id"], "_line", "\n").alias("_lines"))
    parts = parts.withColumn("_part", F.concat(F.lit("### 청크 "), F.col(chunk).cast("string"), F.lit(" ("), F.coalesce("_title", F.lit("")), F.lit(")\n\n"), "_lines", F.lit("\n")))
    body = parts.groupBy(key).agg(joined([chunk], "_part", "\n").alias("_body"))
    return head.join(body, key, "left").select(key, F.concat_ws("\n", "_head", "_body").alias("report"))

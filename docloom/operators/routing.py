"""Messages to requests, requests to results, results to messages: one plan for all conversations, split by columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import text as T


def last_messages(messages: DataFrame, key: str, turn: list[str], content: str = "content") -> DataFrame:
    return messages.groupBy(key).agg(F.max_by(content, F.struct(*turn)).alias("content"))


def parse_sources(df: DataFrame, content: str = "content") -> DataFrame:
    """``df`` with url, arxiv_id, domain and wanted (whether a source was found).

    A message that names the archive or begins with an address gives its first address, and the identifier in that; other
    messages give the first identifier. A domain that ``df`` already has counts before that of the message.
    """
    c = F.coalesce(F.col(content), F.lit(""))
    address = c.contains("arxiv.org") | c.startswith("http")
    url = F.when(address, T.message_url(c))
    found = F.when(address, T.message_id(url)).otherwise(T.message_id(c))
    domain = F.coalesce(F.col("domain"), T.message_domain(c)) if "domain" in df.columns else T.message_domain(c)
    return df.withColumns({"url": url, "arxiv_id": found, "domain": domain}).withColumn("wanted", F.col("url").isNotNull() | F.col("arxiv_id").isNotNull())


def requests_of(df: DataFrame, file: str | None = None) -> DataFrame:
    """``df`` with request_source: the identifier before the address before the file; ready where there is one."""
    empty = lambda c: F.nullif(F.col(c), F.lit(""))
    source = F.coalesce(empty("arxiv_id"), empty("url"), *([empty(file)] if file else []))
    return df.withColumn("request_source", source).withColumn("ready", source.isNotNull())


def request_error(source: Column, domain: Column, exists: Column) -> Column:
    """What is wrong with a request: its source, its file or its domain; null if nothing is."""
    blank = F.coalesce(T.strip(source), F.lit("")) == ""
    lost = (T.source_type(source) == "file") & ~exists
    return F.when(blank, "no_source").when(lost, "no_file").when(~domain.isin(*T.DOMAINS), "unknown_domain")


def chosen(df: DataFrame) -> Column:
    """Requests that are ready and not turned down; who was not asked agrees."""
    return F.col("ready") & (F.coalesce(F.col("user_confirmed"), F.lit(True)) if "user_confirmed" in df.columns else F.lit(True))


def attach_results(requests: DataFrame, results: DataFrame, key: str = "request_source") -> DataFrame:
    """Requests with success, output_path, title, error_code and error_message; a request without a result is a failed one."""
    got = results.select(key, "success", "output_path", "title", "error_code", "error_message")
    both = requests.join(got, key, "left")
    lost = F.col("success").isNull()
    return both.withColumns({"error_code": F.when(lost, F.lit("NO_RESULT")).otherwise(F.col("error_code")), "success": F.coalesce("success", F.lit(False))})


def response(df: DataFrame) -> Column:
    """The message to the user."""
    done = F.concat_ws("\n", F.lit("번역이 완료되었습니다!"), F.lit(""), F.concat(F.lit("**논문**: "), F.coalesce("title", F.lit("제목 없음"))), F.concat(F.lit("**출력 파일**: "), F.coalesce("output_path", F.lit(""))))
    failed = F.concat_ws("\n", F.lit("번역에 실패했습니다."), F.lit(""), F.concat(F.lit("**오류 코드**: "), F.coalesce("error_code", F.lit("UNKNOWN"))), F.concat(F.lit("**오류 메시지**: "), F.coalesce("error_message", F.lit("알 수 없는 오류"))))
    return F.when(F.col("success"), done).otherwise(failed)


def route(messages: DataFrame, key: str, turn: list[str], results: DataFrame) -> DataFrame:
    """(key, request_source, domain, success, reply) of every conversation whose last message names a source and is not turned down.

    Conversations without one pass by with the reply null: one conditional step, as a column and not as two jobs.
    """
    asked = requests_of(parse_sources(last_messages(messages, key, turn)))
    answered = attach_results(asked, results)
    reply = F.when(chosen(answered), response(answered))
    return answered.select(key, "request_source", "domain", F.when(chosen(answered), F.col("success")).alias("success"), reply.alias("reply"))


def request_row(df: DataFrame, now: Column) -> DataFrame:
    """Requests as they are shown: with their type and time."""
    return df.select("*", T.source_type(F.col("request_source")).alias("source_type"), F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss").alias("created_at"))


def status_of(requests: DataFrame, request_id: str) -> DataFrame:
    """The status of a request and whether it still runs."""
    return requests.where(F.col("request_id") == request_id).select("request_id", "status", F.col("status").isin("pending", "running").alias("is_running"))


def progress(nodes: DataFrame, key: str, steps: int = 8) -> DataFrame:
    """(key, completed, percent) of distinct completed steps."""
    done = F.countDistinct("node")
    return nodes.groupBy(key).agg(F.array_sort(F.collect_set("node")).alias("completed"), (done / steps * 100).alias("percent"))

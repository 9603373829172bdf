"""Page-marked text to lines, sections and token-bounded chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.functions import text as T


def lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no, line, line_start): lines numbered from 0, with the place of their first character."""
    rows = df.select(key, F.posexplode(F.split(text, "\n", -1)).alias("line_no", "line"))
    before = W.partitionBy(key).orderBy("line_no").rowsBetween(W.unboundedPreceding, -1)
    return rows.withColumn("line_start", F.coalesce(F.sum(F.length("line") + 1).over(before), F.lit(0)).cast("long"))


def sections(df: DataFrame, key: str, text: str, keep_preamble: bool = False) -> DataFrame:
    """(key, section_ord, title, content, page_start, page_end) of the parts that header lines open.

    The page of a section's end is the one on which the next header stands. Text before the first header is left out unless
    ``keep_preamble``; a text without headers is one section "Main Content".
    """
    order = W.partitionBy(key).orderBy("line_no")
    so_far = order.rowsBetween(W.unboundedPreceding, 0)
    rows = df.select(key, F.posexplode(F.split(text, "\n", -1)).alias("line_no", "line"))
    mark = F.regexp_extract("line", r"^\s*\[PAGE (\d+)\]", 1)
    rows = rows.withColumns({"header": T.is_header(F.col("line")), "mark": F.when(mark != "", mark.cast("int"))})
    rows = rows.withColumns({"sid": F.sum(F.col("header").cast("int")).over(so_far), "page": F.coalesce(F.last("mark", True).over(so_far), F.lit(1))})
    rows = rows.where("mark is null")
    whole = W.partitionBy(key)
    rows = rows.withColumn("headers", F.max("sid").over(whole))
    if not keep_preamble:
        rows = rows.where("sid > 0 or headers = 0")
    body = F.transform(F.array_sort(F.collect_list(F.when(~F.col("header"), F.struct("line_no", "line")))), lambda x: x.line)
    made = rows.groupBy(key, "sid").agg(
        F.coalesce(T.strip(F.max(F.when(F.col("header"), F.col("line")))), F.lit("Main Content")).alias("title"),
        T.strip(F.array_join(body, "\n")).alias("content"),
        F.min("page").alias("page_start"),
        F.max("page").alias("last_page"),
    )
    in_text = W.partitionBy(key).orderBy("sid")
    made = made.withColumns({"section_ord": (F.row_number().over(in_text) - 1).cast("int"), "page_end": F.coalesce(F.lead("page_start").over(in_text), F.col("last_page"))})
    return made.select(key, "section_ord", "title", "content", "page_start", "page_end")


def drop_references(df: DataFrame, title: str = "title") -> DataFrame:
    """Sections but those whose title says references or bibliography."""
    low = F.lower(title)
    return df.where(~(low.contains("reference") | low.contains("bibliography")) | F.col(title).isNull())


def document_title(text: Column) -> Column:
    """The first stripped line of more than ten characters that does not begin with a bracket, else "Unknown"."""
    fit = F.filter(F.transform(F.split(text, "\n", -1), T.strip), lambda x: (F.length(x) > 10) & ~x.startswith("["))
    return F.coalesce(F.try_element_at(fit, F.lit(1)), F.lit("Unknown"))


def token_chunks(df: DataFrame, keys: list[str], text: str, max_tokens: int = 800, overlap: int = 100, cut_sentences: bool = False, drop_contained_tail: bool = False) -> DataFrame:
    """(keys, chunk_index, content, token_count, has_overlap): windows of tokens at fixed steps.

    Starts are known in advance, so every text is cut without a loop. With ``cut_sentences`` a window ends at a sentence
    end if that lies in its second half; the next start does not move with it.
    """
    step = max(1, max_tokens - overlap)
    rows = df.select(*keys, T.tokens(F.col(text)).alias("_t")).where("size(_t) > 0")
    n = F.size("_t")
    starts = F.when(n <= max_tokens, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), n - 1, F.lit(step)))
    rows = rows.select(*keys, "_t", F.posexplode(starts).alias("chunk_index", "_s"))
    if drop_contained_tail:
        rows = rows.where((F.col("_s") == 0) | (F.col("_s") - step + max_tokens < n))
    content = F.array_join(F.slice("_t", F.col("_s") + 1, F.lit(max_tokens)), " ")
    rows = rows.withColumn("content", content)
    if cut_sentences:
        cut = T.sentence_boundary(F.col("content"))
        last = F.col("_s") + max_tokens >= n
        rows = rows.withColumn("content", F.when(~last & (cut > F.length("content") * 0.5), F.rtrim(F.substring(F.col("content"), F.lit(1), cut))).otherwise(F.col("content")))
    return rows.select(*keys, F.col("chunk_index").cast("int"), "content", T.token_count(F.col("content")).cast("int").alias("token_count"), (F.col("chunk_index") > 0).alias("has_overlap"))


def chunk_headers(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_start, title): lines that open a part of a text, with the place of their first character."""
    rows = lines(df, key, text).withColumn("title", T.chunk_header(F.col("line")))
    return rows.where("title is not null").select(key, "line_start", "title")


def whole_chunks(df: DataFrame, key: str, text: str, max_tokens: int = 800, overlap: int = 100) -> DataFrame:
    """The chunks of a text without regard to sections; start places run on by whole lengths."""
    made = token_chunks(df, [key], text, max_tokens, overlap)
    length = F.length("content")
    before = F.sum(length).over(W.partitionBy(key).orderBy("chunk_index").rowsBetween(W.unboundedPreceding, -1))
    made = made.withColumn("start_char", F.coalesce(before, F.lit(0)).cast("long"))
    return made.select(key, "chunk_index", F.lit("Full Document").alias("section_title"), F.col("chunk_index").alias("section_index"), "content", "token_count", "start_char", (F.col("start_char") + length).alias("end_char"), "has_overlap")


def first_tables(chunks: DataFrame, tables: DataFrame, keys: list[str], first: str = "section_index") -> DataFrame:
    """``chunks`` with the column tables: those of their section (or text) on its first chunk, none on others."""
    empty = F.array().cast(tables.schema["tables"].dataType)
    both = chunks.join(tables.select(*keys, F.col("tables").alias("_tables")), keys, "left")
    return both.withColumn("tables", F.when(F.col(first) == 0, F.coalesce("_tables", empty)).otherwise(empty)).drop("_tables")


def section_chunks(df: DataFrame, key: str, strategy: str = "hybrid", max_tokens: int = 800, overlap: int = 100) -> DataFrame:
    """(key, chunk_index, section_title, section_index, content, token_count, start_char, end_char, has_overlap) of sections.

    "section" keeps every section whole, other strategies cut long ones; chunks are numbered through the document. Start
    places run on with the part of a chunk's length that the overlap takes left out. The strategy "token" takes no sections:
    ``whole_chunks``.
    """
    parts = df.select(key, "section_ord", F.col("title").alias("section_title"), "content")
    if strategy == "section":
        made = parts.select(key, "section_ord", "section_title", F.lit(0).alias("section_index"), "content", T.token_count(F.col("content")).alias("token_count"), F.lit(False).alias("has_overlap"))
    else:
        made = token_chunks(parts, [key, "section_ord", "section_title"], "content", max_tokens, overlap).withColumnRenamed("chunk_index", "section_index")
    order = W.partitionBy(key).orderBy("section_ord", "section_index")
    length = F.length("content")
    shared = F.when(F.col("has_overlap") & (F.col("token_count") > 0), F.floor(length * overlap / F.col("token_count"))).otherwise(0)
    before = F.sum(length - shared).over(order.rowsBetween(W.unboundedPreceding, -1))
    made = made.withColumns({"chunk_index": (F.row_number().over(order) - 1).cast("int"), "start_char": F.coalesce(before, F.lit(0)).cast("long")})
    return made.select(key, "chunk_index", "section_title", "section_index", "content", "token_count", "start_char", (F.col("start_char") + length).alias("end_char"), "has_overlap")


def chunk_summary(df: DataFrame, by: list[str]) -> DataFrame:
    """Chunks, tokens, their whole-number mean, sections, chunks with overlap and tables."""
    return df.groupBy(*by).agg(
        F.count("*").alias("total_chunks"),
        F.coalesce(F.sum("token_count"), F.lit(0)).cast("long").alias("total_tokens"),
        F.coalesce(F.floor(F.sum("token_count") / F.count("*")), F.lit(0)).cast("long").alias("avg_tokens"),
        F.countDistinct("section_title").alias("n_sections"),
        F.count_if("has_overlap").alias("n_overlap"),
        F.coalesce(F.sum(F.size("tables")), F.lit(0)).cast("long").alias("n_tables"),
    )


def context_hint(title: Column, section: Column, section_index: Column) -> Column:
    """Title, section and part, joined by bars; absent ones left out."""
    return F.concat_ws(
        " | ",
        F.when(title != "", F.concat(F.lit("Paper: "), title)),
        F.when((section != "") & (section != "Main Content"), F.concat(F.lit("Section: "), section)),
        F.when(section_index > 0, F.concat(F.lit("Part "), (section_index + 1).cast("string"))),
    )


def join_ordered(value: str, order: list[str], separator: str) -> Column:
    """Aggregate: the values in the given order, joined."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("_v")))), lambda x: x["_v"]), separator)


def assemble(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, section_title, title_ko, section_ord, content, tables): chunks by section title, in the order in which titles first appear.

    Tables of the chunks, where ``df`` has any, follow each other in the same order.
    """
    rows = df if "tables" in df.columns else df.withColumn("tables", F.lit(None).cast("array<string>"))
    listed = F.array_sort(F.collect_list(F.struct("chunk_index", F.coalesce("tables", F.array().cast("array<string>")).alias("_v"))))
    made = rows.groupBy(key, "section_title").agg(
        F.min("chunk_index").alias("_first"), join_ordered(text, ["chunk_index"], "\n\n").alias("content"), F.flatten(F.transform(listed, lambda x: x["_v"])).alias("tables")
    )
    place = F.row_number().over(W.partitionBy(key).orderBy("_first", "section_title")) - 1
    return made.select(key, "section_title", T.section_title(F.col("section_title")).alias("title_ko"), place.cast("int").alias("section_ord"), "content", "tables")


def section_part(with_tables: bool) -> Column:
    part = F.concat(F.lit("## "), F.coalesce("title_ko", "section_title", F.lit("")), F.lit("\n\n"), F.col("content"))
    shown = F.when(F.size("tables") > 0, F.concat(F.lit("\n\n"), F.array_join("tables", "\n\n"))).otherwise("")
    return F.concat(part, shown) if with_tables else part


def render(assembled: DataFrame, key: str) -> DataFrame:
    """(key, markdown, md5_hash, content_length): sections under headings."""
    made = assembled.withColumn("_part", section_part(False)).groupBy(key).agg(join_ordered("_part", ["section_ord"], "\n\n").alias("markdown"))
    return hashed(made, key)


def hashed(made: DataFrame, key: str) -> DataFrame:
    return made.select(key, "markdown", F.md5("markdown").alias("md5_hash"), F.length("markdown").cast("long").alias("content_length"))


def render_simple(assembled: DataFrame, head: DataFrame, key: str, footer: str = "") -> DataFrame:
    """As ``render``, between a title, the identifier and date if there are any, and a footer. head: key, title, arxiv_id, translated_date."""
    made = assembled.withColumn("_part", section_part(False)).groupBy(key).agg(join_ordered("_part", ["section_ord"], "\n\n").alias("_body"))
    line = lambda name, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"> {name}: "), c))
    text = F.concat_ws("\n\n", F.concat(F.lit("# "), F.col("title")), line("ArXiv", F.col("arxiv_id")), line("번역일", F.col("translated_date")), F.lit("---"), "_body", F.lit("---"), *([F.lit(footer)] if footer else []))
    return hashed(made.join(head, key).withColumn("markdown", text), key)


def render_full(assembled: DataFrame, head: DataFrame, terms: DataFrame, key: str, footer: str = "", most_terms: int = 20) -> DataFrame:
    """(key, markdown, md5_hash, content_length): head, abstract, sections with their tables, figures of the run and its terms.

    head: key, title, title_ko, arxiv_id, authors, translated_date, domain, abstract, total_pages, total_chunks, total_tokens,
    match_rate; what is null or empty is left out, and missing figures read N/A. terms: key, ord, source_text, target_text; the
    first ``most_terms`` are shown and the others counted.
    """
    body = assembled.withColumn("_part", section_part(True)).groupBy(key).agg(join_ordered("_part", ["section_ord"], "\n\n").alias("_body"))
    shown = terms.where(F.col("ord") < most_terms).withColumn("_line", F.concat(F.lit("| "), F.coalesce("source_text", F.lit("")), F.lit(" | "), F.coalesce("target_text", F.lit("")), F.lit(" |")))
    used = shown.groupBy(key).agg(join_ordered("_line", ["ord"], "\n").alias("_terms")).join(terms.groupBy(key).agg(F.count("*").alias("_n_terms")), key)
    rows = body.join(head, key, "left").join(used, key, "left")
    given = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) != ""
    link = F.concat(F.lit("> **ArXiv**: ["), F.col("arxiv_id"), F.lit("](https://arxiv.org/abs/"), F.col("arxiv_id"), F.lit(")"))
    top = F.concat_ws(
        "\n", F.concat(F.lit("> **원제**: "), F.coalesce("title", F.lit("Unknown"))), F.when(given("arxiv_id"), link),
        F.when(F.size("authors") > 0, F.concat(F.lit("> **저자**: "), F.array_join("authors", ", "))),
        F.when(given("translated_date"), F.concat(F.lit("> **번역일**: "), F.col("translated_date"))), F.when(given("domain"), F.concat(F.lit("> **분야**: "), F.col("domain"))),
    )
    figure = lambda name, c: F.concat(F.lit(f"| {name} | "), F.coalesce(F.col(c).cast("string"), F.lit("N/A")), F.lit(" |"))
    figures = F.concat_ws("\n", F.lit("| 항목 | 값 |\n|------|-----|"), figure("원본 페이지", "total_pages"), figure("총 청크 수", "total_chunks"), figure("번역 토큰", "total_tokens"), figure("용어 매칭률", "match_rate"))
    more = F.when(F.col("_n_terms") > most_terms, F.concat(F.lit("\n| ... | ("), (F.col("_n_terms") - most_terms).cast("string"), F.lit("개 더) |"))).otherwise("")
    listed = F.when(F.col("_n_terms") > 0, F.concat(F.lit("### 사용된 전문용어\n\n| 원문 | 번역 |\n|------|------|\n"), F.col("_terms"), more))
    text = F.concat_ws(
        "\n\n", F.concat(F.lit("# "), F.coalesce(F.nullif("title_ko", F.lit("")), "title", F.lit("알 수 없음"))), top, F.lit("---"),
        F.when(given("abstract"), F.concat(F.lit("## 초록 (Abstract)\n\n"), F.col("abstract"), F.lit("\n\n---"))), "_body", F.lit("---"), F.concat(F.lit("## 번역 정보\n\n"), figures), listed,
        *([F.lit("---"), F.lit(footer)] if footer else []),
    )
    return hashed(rows.withColumn("markdown", text), key)

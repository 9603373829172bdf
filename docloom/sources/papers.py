"""Paper tables: records of search services as typed rows, and searches over stored papers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import text as T

# Categories of each domain.
DOMAIN_CATEGORIES = {
    "NLP": ["cs.CL", "cs.AI"], "CV": ["cs.CV", "cs.AI"], "ML": ["cs.LG", "stat.ML"], "RL": ["cs.AI", "cs.LG"],
    "Speech": ["eess.AS", "cs.CL"], "General": ["cs.AI", "cs.LG"],
}
# Words that stand for what is much read in a domain.
TRENDING_WORDS = {
    "NLP": ["large language model", "transformer", "GPT", "LLM"],
    "CV": ["diffusion", "vision transformer", "ViT", "image generation"],
    "ML": ["deep learning", "neural network", "optimization"],
    "RL": ["reinforcement learning", "policy gradient", "Q-learning"],
    "General": ["deep learning", "transformer", "neural network"],
}
SORT_COLUMNS = {"lastUpdatedDate": "updated", "submittedDate": "published"}
SERVICE_SCHEMA = (
    "paperId string, title string, abstract string, year int, citationCount int, influentialCitationCount int, venue string, url string, externalIds struct<ArXiv:string>, "
    "openAccessPdf struct<url:string>, authors array<struct<name:string>>, fieldsOfStudy array<string>, publicationDate string"
)


def categories_of(domain: str) -> list[str]:
    return DOMAIN_CATEGORIES.get(domain, DOMAIN_CATEGORIES["General"])


def service_rows(df: DataFrame, reply: str) -> DataFrame:
    """Typed rows of JSON replies: nested fields flat, missing counts 0, missing lists empty."""
    r = df.select(F.from_json(reply, SERVICE_SCHEMA).alias("r")).select("r.*")
    return r.select(
        F.coalesce("paperId", F.lit("")).alias("paper_id"), F.coalesce("title", F.lit("")).alias("title"),
        F.transform(F.filter(F.coalesce("authors", F.array()), lambda a: a.isNotNull()), lambda a: F.coalesce(a["name"], F.lit(""))).alias("authors"),
        "abstract", "year", F.coalesce("citationCount", F.lit(0)).alias("citation_count"), F.coalesce("influentialCitationCount", F.lit(0)).alias("influential_citation_count"),
        "venue", F.coalesce("url", F.lit("")).alias("url"), F.col("externalIds.ArXiv").alias("arxiv_id"), F.col("openAccessPdf.url").alias("pdf_url"),
        F.coalesce("fieldsOfStudy", F.array()).alias("fields_of_study"), F.col("publicationDate").alias("publication_date"),
    )


def citing_rows(df: DataFrame, reply: str, n: int | None = None) -> DataFrame:
    """The papers in a reply that lists what cites a paper; entries without a paper are left out."""
    schema = f"data array<struct<citingPaper:struct<{SERVICE_SCHEMA.replace(' array', ':array').replace(' struct', ':struct').replace(' string', ':string').replace(' int', ':int')}>>>"
    rows = df.select(F.explode(F.from_json(reply, schema)["data"]).alias("x")).where("x.citingPaper is not null").select(F.to_json("x.citingPaper").alias("_reply"))
    made = service_rows(rows, "_reply")
    return made if n is None else made.limit(n)


def entry_rows(df: DataFrame) -> DataFrame:
    """Feed entries (entry_id as an address, authors as structs with a name) as rows."""
    rest = [c for c in df.columns if c not in ("entry_id", "authors")]
    return df.select(T.last_part(F.col("entry_id")).alias("arxiv_id"), F.transform("authors", lambda a: a["name"]).alias("authors"), *rest)


def as_json(df: DataFrame, times: list[str]) -> DataFrame:
    """A JSON object for each row, times in ISO form."""
    return df.select(F.to_json(F.struct(*[F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss").alias(c) if c in times else F.col(c) for c in df.columns])).alias("json"))


def words_in(text: Column, words: list[str]) -> Column:
    """Whether the text holds one of the words as it is written, without regard to case."""
    low = F.lower(text)
    return T.any_of([low.contains(F.lit(w.lower())) for w in words])


def search_papers(
    papers: DataFrame, words: list[str] | None = None, categories: list[str] | None = None, year_from: int | None = None, year_to: int | None = None,
    least_citations: int = 0, fields: list[str] | None = None, since: Column | None = None,
) -> DataFrame:
    """Papers with one of the words in title or abstract and within the other limits; all filters come before any limit."""
    out = papers.where(words_in(F.concat_ws(" ", "title", "abstract"), words)) if words else papers
    if categories:
        out = out.where(F.arrays_overlap("categories", F.array(*map(F.lit, categories))))
    if fields:
        out = out.where(F.arrays_overlap("fields_of_study", F.array(*map(F.lit, fields))))
    if year_from is not None:
        out = out.where(F.col("year") >= year_from)
    if year_to is not None:
        out = out.where(F.col("year") <= year_to)
    if since is not None:
        out = out.where(F.col("published") >= since)
    return out.where(F.col("citation_count") >= least_citations) if least_citations else out


def ordered(papers: DataFrame, sort_by: str, descending: bool, key: str, n: int | None = None) -> DataFrame:
    """Papers by a named criterion; relevance has no order of its own among stored papers and sorts by the key."""
    c = SORT_COLUMNS.get(sort_by)
    made = papers.orderBy(*([F.desc(c) if descending else F.asc(c)] if c else []), key)
    return made if n is None else made.limit(n)


def recent(papers: DataFrame, domain: str, now: Column, days: int, n: int) -> DataFrame:
    """The newest papers of a domain of the last days before ``now``."""
    rows = search_papers(papers, categories=categories_of(domain), since=now - F.make_interval(days=F.lit(days)))
    return ordered(rows, "submittedDate", True, "arxiv_id", n)


def trending(papers: DataFrame, domain: str, n: int) -> DataFrame:
    """The newest papers of a domain that hold one of its much read words."""
    rows = search_papers(papers, TRENDING_WORDS.get(domain, TRENDING_WORDS["General"]), categories_of(domain))
    return ordered(rows, "submittedDate", True, "arxiv_id", n)


def most_cited(papers: DataFrame, words: list[str], n: int, by: str = "citation_count", year_from: int | None = None, least: int = 0) -> DataFrame:
    return search_papers(papers, words, year_from=year_from, least_citations=least).orderBy(F.desc(by), "paper_id").limit(n)


def paper_by_id(papers: DataFrame, key: str, value: str) -> DataFrame:
    return papers.where(F.col(key) == value).limit(1)


def year_range(year_from: int | None, year_to: int | None, this_year: int) -> str | None:
    """The years of a query as text; an open end goes to this year, an open beginning is left open."""
    if year_from is None and year_to is None:
        return None
    return f"{'' if year_from is None else year_from}-{this_year if year_to is None else year_to}"


def query_text(words: str, categories: list[str] | None = None) -> str:
    """The query of a search service: the words, and any of the categories."""
    wanted = " OR ".join(f"cat:{c}" for c in categories or [])
    return f"({words}) AND ({wanted})" if words and wanted else words or wanted


def retry_wait(attempt: int, retry_after: float | None = None, delay: float = 5.0) -> float:
    """Seconds before the next request after an attempt (from 0): what the service asks for, at least delay times the attempts."""
    return max(delay if retry_after is None else retry_after, delay * (attempt + 1))


def display(papers: DataFrame, key: str, title_width: int = 45, author_width: int = 20) -> DataFrame:
    """Rows for a list on screen: shortened titles and authors, a sign for missing values."""
    authors = T.author_line(F.col("authors"))
    return papers.select(F.coalesce(key, F.lit("-")).alias("id"), T.short(F.col("title"), title_width).alias("title"), T.short(authors, author_width).alias("authors"))


def check_arguments(source: str, query: str | None = None, trending: bool = False, highly_cited: bool = False, page: int = 1, per_page: int = 10) -> list[str]:
    """What is wrong with the arguments of a search, in words."""
    wrong = []
    if source not in ("arxiv", "semantic-scholar", "s2"):
        wrong.append(f"unknown source {source}")
    if sum((bool(query), trending, highly_cited)) == 0:
        wrong.append("one of query, trending and highly_cited is needed")
    if page < 1:
        wrong.append("pages begin with 1")
    if not 1 <= per_page <= 100:
        wrong.append("1 to 100 rows a page")
    return wrong

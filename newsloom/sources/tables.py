"""The data model over the parquet tables: articles, topics and what links them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.operators.storage import one_of_each

#: Corpora by year: a year claimed twice goes to the corpus of the higher rank.
CORPORA = [("A", 0, 1996, 2000), ("B", 1, 2004, 2006), ("C", 2, 2006, 2008)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each id; a delivery repeated has the same date, headline and paragraphs."""
    return one_of_each(table(spark, sf_dir, "articles"), "id", ["date", "headline", "paragraphs"])


def docset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(topic_id, id): articles asked for by each topic."""
    return table(spark, sf_dir, "article_queries").where("topic_id is not null and full_article_id is not null").select("topic_id", F.col("full_article_id").alias("id")).distinct()


def topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each topic id, the longest non-null title and narrative."""
    return table(spark, sf_dir, "topics").where("id is not null").groupBy(F.col("id").alias("topic_id")).agg(F.max("title").alias("title"), F.max("narrative").alias("narrative"))


def article_date(article_id: Column) -> Column:
    """The eight digits from the first one on, as a date; null where there are none."""
    return F.to_date(F.nullif(F.regexp_extract(article_id, r"^[^0-9]*(\d{8})", 1), F.lit("")), "yyyyMMdd")


def parse_id(article_id: Column) -> dict[str, Column]:
    """journal_id, language, file_id, article_id and year of an article id in either form."""
    head, tail = F.split_part(article_id, F.lit("."), F.lit(1)), F.split_part(article_id, F.lit("."), F.lit(2))
    new = F.contains(head, F.lit("_"))
    file_id = F.when(new, F.split_part(head, F.lit("_"), F.lit(3))).otherwise(F.regexp_extract(head, r"^[^0-9]*(.*)$", 1))
    return {
        "journal_id": F.when(new, F.split_part(head, F.lit("_"), F.lit(1))).otherwise(F.regexp_extract(head, r"^([^0-9]*)", 1)),
        "language": F.when(new, F.split_part(head, F.lit("_"), F.lit(2))).otherwise("ENG"),
        "file_id": file_id,
        "article_id": tail,
        "year": F.try_to_number(F.substring(file_id, 1, 4), F.lit("9999")).cast("int"),
    }


def corpus_by_year(spark: SparkSession) -> DataFrame:
    """(year, corpus): a dozen rows; the highest rank wins."""
    rows = [(y, name, rank) for name, rank, lo, hi in CORPORA for y in range(lo, hi + 1)]
    return spark.createDataFrame(rows, "year int, corpus string, rank int").groupBy("year").agg(F.max_by("corpus", "rank").alias("corpus"))


def file_path(corpus: Column, journal: Column, file_id: Column) -> Column:
    """Where an article's file lies in the layout of its corpus."""
    lower = F.lower(journal)
    old = F.concat(lower, F.lit("/"), F.substring(file_id, 1, 4), F.lit("/"), file_id, F.lit("_"), F.when(journal == "XIE", "XIN").otherwise(journal), F.when(journal == "NYT", "").otherwise("_ENG"))
    month = F.concat(lower, F.lit("_eng/"), lower, F.lit("_eng_"), F.substring(file_id, 1, 6))
    return F.when(corpus == "A", old).when(corpus == "B", F.concat(month, F.lit(".xml"))).when(corpus == "C", F.concat(month, F.lit(".gz")))


def routed(queries: DataFrame, spark: SparkSession) -> DataFrame:
    """Queries with their corpus and file: what file pruning reads. The side of a dozen rows is broadcast."""
    q = queries.select(*queries.columns, *(c.alias(n) for n, c in parse_id(F.col("id")).items() if n in ("journal_id", "file_id", "year")))
    return q.join(F.broadcast(corpus_by_year(spark)), "year").withColumn("path", file_path(F.col("corpus"), F.col("journal_id"), F.col("file_id")))


def asked_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(topic_id, id, place): each row that asks for an article, with its place in the table."""
    rows = table(spark, sf_dir, "article_queries").where("topic_id is not null and full_article_id is not null")
    return rows.select("topic_id", F.col("full_article_id").alias("id"), F.struct(F.col("_metadata.file_path").alias("f"), F.col("_metadata.row_index").alias("r")).alias("place"))


def last_topic_of_file(routed_queries: DataFrame) -> DataFrame:
    """Strict compatibility: an article asked for several times in one file goes to the topic that asks last, by place,
    and only once."""
    return routed_queries.groupBy("path", "id").agg(F.max_by("topic_id", "place").alias("topic_id"))


def require_complete(docs: DataFrame, queries: DataFrame, most: int = 20) -> DataFrame:
    """Raises where an article asked for is absent."""
    missing = queries.select("id").distinct().join(docs.select("id"), "id", "left_anti").limit(most).collect()
    if missing:
        raise ValueError(f"articles not found: {[r.id for r in missing]}")
    return docs

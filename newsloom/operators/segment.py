"""Articles to cleaned paragraphs, sentences and tokens, without a shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.functions import text as T


def cleaned(articles: DataFrame) -> DataFrame:
    """Adds clean: the cleaned paragraphs that aren't empty."""
    paras = F.filter(F.coalesce("paragraphs", F.array().cast("array<string>")), lambda p: p.isNotNull())
    return articles.withColumn("clean", F.filter(T.clean_all(paras), lambda p: p != ""))


def paragraphs(articles: DataFrame) -> DataFrame:
    return cleaned(articles).select("id", F.posexplode("clean").alias("para_idx", "text")).withColumn("para_idx", F.col("para_idx").cast("long"))


def sentences(articles: DataFrame) -> DataFrame:
    """(id, date, para_idx, sent_index, text, n_words); sent_index runs through an article's paragraphs."""
    parts = F.flatten(F.transform("clean", lambda p, i: F.transform(T.split_sentences(p), lambda s: F.struct(i.alias("para_idx"), s.alias("text")))))
    df = cleaned(articles).select("id", "date", F.posexplode(parts).alias("sent_index", "s"))
    return df.select("id", "date", F.col("s.para_idx").cast("long").alias("para_idx"), F.col("sent_index").cast("long").alias("sent_index"), F.col("s.text").alias("text"), T.words_in(F.col("s.text")).alias("n_words"))


def sentence_tokens(sents: DataFrame, stop_words: list[str]) -> DataFrame:
    """Adds tokens: accepted words, lower-cased, in order."""
    keep = (lambda t: ~t.isin(stop_words)) if stop_words else (lambda t: F.lit(True))
    return sents.withColumn("tokens", F.filter(T.tokens(F.col("text")), keep))


def typed_spans(articles: DataFrame, topics: DataFrame) -> DataFrame:
    """(id, span_type, text): headlines, titles and narratives, cleaned, without empty ones."""
    rows = [articles.select("id", F.lit("article_headline").alias("span_type"), F.col("headline").alias("text"))]
    rows += [topics.select(F.col("topic_id").alias("id"), F.lit(kind).alias("span_type"), F.col(c).alias("text")) for kind, c in (("topic_title", "title"), ("narrative", "narrative"))]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).where("text is not null").withColumn("text", T.clean_text(F.col("text"))).where("text <> ''")
